"""Scanners for lightweight markup: strings, balanced delimiters, calls and literal values. Plain Python, used by the parser inside Arrow batches."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_PAIRS = {"(": ")", "[": "]", "{": "}"}
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*(?:\.[A-Za-z_][A-Za-z0-9_-]*)*")
LABEL = re.compile(r"<([A-Za-z0-9_.:-]+)>")
COMMANDS = ("set", "show", "let", "import", "include")
_NUMBER = re.compile(r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?")


def string_end(s: str, i: int) -> int:
    """The place after the string literal that starts at i; the end of s if it isn't closed."""
    i += 1
    while i < len(s):
        if s[i] == "\\":
            i += 2
        elif s[i] == '"':
            return i + 1
        else:
            i += 1
    return len(s)


def comment_end(s: str, i: int) -> int:
    """The place after the comment that starts at i (nested block comments count), or i if none does."""
    if s.startswith("//", i):
        at = s.find("\n", i)
        return len(s) if at < 0 else at
    if not s.startswith("/*", i):
        return i
    depth, i = 1, i + 2
    while i < len(s) and depth:
        if s.startswith("/*", i):
            depth, i = depth + 1, i + 2
        elif s.startswith("*/", i):
            depth, i = depth - 1, i + 2
        else:
            i += 1
    return i


def raw_end(s: str, i: int) -> int:
    """The place after the run of backticks and its raw text that start at i."""
    n = len(s[i:]) - len(s[i:].lstrip("`"))
    if n == 2:
        return i + 2
    at = s.find("`" * n, i + n)
    return len(s) if at < 0 else at + n


def balanced(s: str, i: int) -> int:
    """The place after the bracket that closes the one at i, or -1. Strings count in code, not inside content brackets."""
    stack = []
    while i < len(s):
        c = s[i]
        if c == "\\":
            i += 2
            continue
        if c == "`":
            i = raw_end(s, i)
            continue
        content = stack and stack[-1] == "]"
        if not content and c == '"':
            i = string_end(s, i)
            continue
        if not content and s.startswith(("//", "/*"), i):
            i = comment_end(s, i)
            continue
        if content and s.startswith("/*", i):
            i = comment_end(s, i)
            continue
        if c in _PAIRS:
            if not (content and c in "({"):
                stack.append(_PAIRS[c])
        elif stack and c == stack[-1]:
            stack.pop()
            if not stack:
                return i + 1
        i += 1
    return -1


def split_top(s: str, separator: str = ",") -> list[str]:
    """Parts of s between separators that stand outside brackets and strings."""
    parts, start, i = [], 0, 0
    while i < len(s):
        c = s[i]
        if c == '"':
            i = string_end(s, i)
        elif c == "`":
            i = raw_end(s, i)
        elif s.startswith(("//", "/*"), i):
            i = comment_end(s, i)
        elif c in _PAIRS:
            j = balanced(s, i)
            i = len(s) if j < 0 else j
        elif c == separator:
            parts.append(s[start:i])
            i += 1
            start = i
        else:
            i += 1
    parts.append(s[start:])
    out = [p.strip() for p in parts]
    return out[:-1] if out and not out[-1] else out


def strip_outer(s: str) -> str:
    s = s.strip()
    return s[1:-1] if s and s[0] in _PAIRS and balanced(s, 0) == len(s) else s


@dataclass
class Call:
    """A hash expression: name(positional, named)[body]… with what follows it."""

    name: str = ""
    positional: list[str] = field(default_factory=list)
    named: dict[str, str] = field(default_factory=dict)
    bodies: list[str] = field(default_factory=list)
    command: str = ""
    argument: str = ""
    tail: str = ""
    label: str = ""
    end: int = 0
    source: str = ""


def arguments(s: str) -> tuple[list[str], dict[str, str]]:
    positional, named = [], {}
    for part in split_top(s):
        m = re.match(r"([A-Za-z_][A-Za-z0-9_-]*)\s*:(?!:)\s*", part)
        if m:
            named[m[1]] = part[m.end() :]
        elif part:
            positional.append(part)
    return positional, named


def statement_end(s: str, i: int) -> int:
    while i < len(s):
        c = s[i]
        if c in "\n;":
            return i
        if c == '"':
            i = string_end(s, i)
        elif c in _PAIRS:
            j = balanced(s, i)
            i = len(s) if j < 0 else j
        elif s.startswith(("//", "/*"), i):
            i = comment_end(s, i)
        else:
            i += 1
    return len(s)


def hash_expression(s: str, i: int) -> Call | None:
    """The expression after the # at i, or None if none starts there."""
    at = i + 1
    if at >= len(s):
        return None
    if s[at] in _PAIRS:
        end = balanced(s, at)
        if end < 0:
            return None
        return Call(bodies=[s[at:end]], end=end, source=s[i:end])
    m = _NAME.match(s, at)
    if not m:
        return None
    name = m[0]
    if name in COMMANDS:
        end = at + len(name)
        if name == "set":
            n = _NAME.match(s, end + len(s[end:]) - len(s[end:].lstrip(" ")))
            stop = s.find("(", end)
            if n and stop >= 0 and (close := balanced(s, stop)) > 0:
                positional, named = arguments(s[stop + 1 : close - 1])
                return Call(n[0], positional, named, command="set", end=close, source=s[i:close])
        stop = statement_end(s, end)
        return Call(command=name, argument=s[end:stop].strip(), end=stop, source=s[i:stop])
    call, end = Call(name), m.end()
    if end < len(s) and s[end] == "(":
        close = balanced(s, end)
        if close < 0:
            return None
        call.positional, call.named = arguments(s[end + 1 : close - 1])
        end = close
    while end < len(s) and s[end] == "[":
        close = balanced(s, end)
        if close < 0:
            return None
        call.bodies.append(s[end + 1 : close - 1])
        end = close
    start = end
    while m := re.compile(r"\.[A-Za-z_][A-Za-z0-9_-]*").match(s, end):
        end = m.end()
        if end < len(s) and s[end] == "(" and (close := balanced(s, end)) > 0:
            end = close
    call.tail = s[start:end]
    if m := re.compile(r"[ ]?<([A-Za-z0-9_.:-]+)>").match(s, end):
        call.label, end = m[1], m.end()
    call.end, call.source = end, s[i:end]
    return call


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "r": "\r", "t": "\t"}.get(m[1], m[1]), s, flags=re.S)


def literal(s: str | None, variables: dict | None = None):
    """A literal value: str, bool, None, 'auto', int, float, ('content', …), list or dict; anything else stays a string."""
    if s is None:
        return None
    s = s.strip()
    if variables and s in variables:
        return variables[s]
    if s in ("true", "false"):
        return s == "true"
    if s == "none":
        return None
    if len(s) > 1 and s[0] == '"' and string_end(s, 0) == len(s):
        return unescape(s[1:-1])
    if s[:1] == "[" and balanced(s, 0) == len(s):
        return ("content", s[1:-1])
    if s[:1] == "(" and balanced(s, 0) == len(s):
        positional, named = arguments(s[1:-1])
        return {k: literal(v, variables) for k, v in named.items()} if named else [literal(p, variables) for p in positional]
    if _NUMBER.fullmatch(s):
        return float(s) if re.search(r"[.eE]", s) else int(s)
    return s


def text_value(s: str | None, variables: dict | None = None) -> str | None:
    v = literal(s, variables)
    if isinstance(v, tuple):
        return v[1]
    return None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
