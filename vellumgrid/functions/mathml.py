"""Mathematics between markup and the package's math elements, both ways. Recursive, so plain Python."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from vellumgrid.functions import ooxml as x
from vellumgrid.functions.scan import balanced, split_top

# Symbol names of the markup.
SYMBOLS = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "zeta": "ζ", "eta": "η", "theta": "θ", "lambda": "λ", "mu": "μ", "nu": "ν", "xi": "ξ", "pi": "π", "rho": "ρ", "sigma": "σ", "tau": "τ", "phi": "φ", "chi": "χ", "psi": "ψ", "omega": "ω",
    "Gamma": "Γ", "Delta": "Δ", "Theta": "Θ", "Lambda": "Λ", "Xi": "Ξ", "Pi": "Π", "Sigma": "Σ", "Phi": "Φ", "Psi": "Ψ", "Omega": "Ω",
    "oo": "∞", "infinity": "∞", "partial": "∂", "nabla": "∇", "times": "×", "dot.op": "⋅", "div": "÷", "plus.minus": "±", "arrow.r": "→", "arrow.l": "←", "in": "∈", "subset": "⊂", "union": "∪", "sect": "∩", "forall": "∀", "exists": "∃", "dots": "…",
}
RELATIONS = {"<=": "≤", ">=": "≥", "!=": "≠", "->": "→", "=>": "⇒", "approx": "≈"}
NARY = {"sum": "∑", "product": "∏", "integral": "∫"}
ACCENTS = {"hat": "\u0302", "tilde": "\u0303", "macron": "\u0304", "dot": "\u0307", "arrow": "\u20d7"}
FUNCTIONS = ("sin", "cos", "tan", "log", "ln", "exp", "lim", "max", "min", "det", "gcd", "sup", "inf")
_NAME_OF = {v: k for k, v in reversed([*SYMBOLS.items(), *RELATIONS.items()])}
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[A-Za-z][A-Za-z0-9]*(?:\.[A-Za-z]+)*|\d+(?:\.\d+)?|<=|>=|!=|->|=>|\S')


def _run(text: str) -> ET.Element:
    return x.make("m:r", x.make("m:t", text=text))


def _box(name: str, content: list[ET.Element]) -> ET.Element:
    return x.make(name, *content)


def _call_end(s: str, i: int) -> int:
    return balanced(s, i) if i < len(s) and s[i] == "(" else -1


def _atoms(s: str) -> list[ET.Element]:
    """Elements of an expression: atoms with their attachments, fractions between atoms joined by a slash."""
    out: list[ET.Element | tuple] = []
    i = 0
    while i < len(s):
        if s[i].isspace():
            i += 1
            continue
        if s[i] == "/" and out:
            out.append(("/",))
            i += 1
            continue
        atom, i = _atom(s, i)
        sub = sup = None
        while i < len(s) and s[i] in "_^":
            part, j = _attached(s, i + 1)
            sub, sup = (part, sup) if s[i] == "_" else (sub, part)
            i = j
        out.append(_attach(atom, sub, sup))
    flat: list[ET.Element] = []
    k = 0
    while k < len(out):
        if isinstance(out[k], tuple) and flat and k + 1 < len(out):
            top, bottom = flat.pop(), out[k + 1]
            flat.append(x.make("m:f", _box("m:num", _ungroup(top)), _box("m:den", _ungroup(bottom))))
            k += 2
        else:
            if not isinstance(out[k], tuple):
                flat.append(out[k])
            k += 1
    # An n-ary operator takes what follows up to the next relation.
    done: list[ET.Element] = []
    k = 0
    while k < len(flat):
        e = flat[k]
        if x.local(e.tag) == "nary":
            j = k + 1
            while j < len(flat) and "".join(flat[j].itertext()) not in ("=", "<", ">", "≤", "≥", "≠"):
                j += 1
            e.find(x.q("m:e")).extend(flat[k + 1 : j])
            k = j
        else:
            k += 1
        done.append(e)
    return done


def _ungroup(e: ET.Element) -> list[ET.Element]:
    return list(e.find(x.q("m:e"))) if x.local(e.tag) == "d" else [e]


def _attached(s: str, i: int) -> tuple[list[ET.Element], int]:
    if i < len(s) and s[i] == "(" and (end := balanced(s, i)) > 0:
        return _atoms(s[i + 1 : end - 1]), end
    e, j = _atom(s, i)
    return [e], j


def _attach(atom: ET.Element, sub, sup) -> ET.Element:
    if x.local(atom.tag) == "nary":
        for name, part in (("m:sub", sub), ("m:sup", sup)):
            if part is not None:
                atom.find(x.q(name)).extend(part)
        return atom
    e = _box("m:e", [atom])
    if sub is not None and sup is not None:
        return x.make("m:sSubSup", e, _box("m:sub", sub), _box("m:sup", sup))
    if sub is not None:
        return x.make("m:sSub", e, _box("m:sub", sub))
    return x.make("m:sSup", e, _box("m:sup", sup)) if sup is not None else atom


def _atom(s: str, i: int) -> tuple[ET.Element, int]:
    while i < len(s) and s[i].isspace():
        i += 1
    if i >= len(s):
        return _run(""), i
    if s[i] in "([{" and (end := balanced(s, i)) > 0:
        return x.make("m:d", x.make("m:dPr", x.make("m:begChr", m__val=s[i]), x.make("m:endChr", m__val=s[end - 1])), _box("m:e", _atoms(s[i + 1 : end - 1]))), end
    m = _TOKEN.match(s, i)
    t, j = m[0], m.end()
    if t[0] == '"':
        return _run(t[1:-1]), j
    if t in NARY:
        return x.make("m:nary", x.make("m:naryPr", x.make("m:chr", m__val=NARY[t])), x.make("m:sub"), x.make("m:sup"), x.make("m:e")), j
    end = _call_end(s, j)
    if end > 0 and t[0].isalpha():
        args = split_top(s[j + 1 : end - 1])
        inner = [_atoms(a) for a in args]
        first = inner[0] if inner else []
        second = inner[1] if len(inner) > 1 else []
        if t in ("frac", "binom"):
            pr = x.make("m:fPr", x.make("m:type", m__val="noBar")) if t == "binom" else None
            return x.make("m:f", pr, _box("m:num", first), _box("m:den", second)), end
        if t in ("sqrt", "root"):
            pr = x.make("m:radPr", x.make("m:degHide", m__val="1")) if t == "sqrt" else None
            return x.make("m:rad", pr, _box("m:deg", [] if t == "sqrt" else first), _box("m:e", first if t == "sqrt" else second)), end
        if t == "mat":
            rows = [[_atoms(c) for c in split_top(r)] for r in split_top(s[j + 1 : end - 1], ";")]
            return x.make("m:m", *[x.make("m:mr", *[_box("m:e", c) for c in r]) for r in rows]), end
        if t == "cases":
            return x.make("m:eqArr", *[_box("m:e", a) for a in inner]), end
        if t in ("overline", "underline"):
            return x.make("m:bar", x.make("m:barPr", x.make("m:pos", m__val="top" if t == "overline" else "bot")), _box("m:e", first)), end
        if t in ("overbrace", "underbrace"):
            return x.make("m:groupChr", x.make("m:groupChrPr", x.make("m:chr", m__val="⏞" if t == "overbrace" else "⏟"), x.make("m:pos", m__val="top" if t == "overbrace" else "bot")), _box("m:e", first)), end
        if t == "accent" or t in ACCENTS:
            mark = ACCENTS.get(args[1] if t == "accent" and len(args) > 1 else t, "\u0302")
            return x.make("m:acc", x.make("m:accPr", x.make("m:chr", m__val=mark)), _box("m:e", first)), end
        if t == "hide":
            return x.make("m:phant", _box("m:e", first)), end
        if t == "lr":
            return first[0] if len(first) == 1 else x.make("m:d", _box("m:e", first)), end
        if t in FUNCTIONS:
            return x.make("m:func", _box("m:fName", [_run(t)]), _box("m:e", [a for p in inner for a in p])), end
    return _run(SYMBOLS.get(t) or RELATIONS.get(t) or t), j


def to_omml(markup: str) -> ET.Element:
    """m:oMath of an expression; a backslash starts a new row."""
    rows = [r for r in re.split(r"\\(?=\s|$)", markup) if r.strip()]
    if len(rows) > 1:
        return x.make("m:oMath", x.make("m:eqArr", *[_box("m:e", _atoms(r.replace("&", ""))) for r in rows]))
    return x.make("m:oMath", *_atoms(markup.replace("&", "")))


def _text(t: str) -> str:
    if t in FUNCTIONS:
        return t
    parts = []
    for m in re.finditer(r"[A-Za-z]{2,}|\S|\s+", t):
        piece = m[0]
        parts.append(f'"{piece}"' if re.fullmatch(r"[A-Za-z]{2,}", piece) else f" {_NAME_OF[piece]} " if piece in _NAME_OF else piece)
    return "".join(parts).strip() if t.strip() else " "


def _group(s: str) -> str:
    return s if re.fullmatch(r"[\w.]+", s) else f"({s})"


def from_omml(e: ET.Element) -> str:
    """The expression of a math element."""
    k = x.local(e.tag)
    part = lambda name: _all(e.find(x.q(f"m:{name}")))
    if k == "r":
        return _text("".join(t.text or "" for t in e.findall(x.q("m:t"))))
    if k == "f":
        kind = e.find(f"{x.q('m:fPr')}/{x.q('m:type')}")
        name = "binom" if kind is not None and x.attr(kind, "m:val") == "noBar" else "frac"
        return f"{name}({part('num')}, {part('den')})"
    if k in ("sSup", "sSub", "sSubSup"):
        return part("e") + (f"_{_group(part('sub'))}" if k != "sSup" else "") + (f"^{_group(part('sup'))}" if k != "sSub" else "")
    if k == "sPre":
        return f"attach({part('e')}, tl: {part('sup')}, bl: {part('sub')})"
    if k == "rad":
        deg = part("deg")
        return f"root({deg}, {part('e')})" if deg else f"sqrt({part('e')})"
    if k == "nary":
        mark = x.attr(e.find(f"{x.q('m:naryPr')}/{x.q('m:chr')}"), "m:val", "∫")
        name = {v: n for n, v in NARY.items()}.get(mark, mark)
        sub, sup = part("sub"), part("sup")
        return name + (f"_{_group(sub)}" if sub else "") + (f"^{_group(sup)}" if sup else "") + (f" {part('e')}" if part("e") else "")
    if k == "d":
        pr = e.find(x.q("m:dPr"))
        a, b = (x.attr(pr.find(x.q(n)) if pr is not None else None, "m:val", d) for n, d in (("m:begChr", "("), ("m:endChr", ")")))
        body = ", ".join(_all(c) for c in e.findall(x.q("m:e")))
        return f"{a}{body}{b}" if a in "([{" and b in ")]}" and a and b else f"lr({a}{body}{b})"
    if k == "m":
        return "mat(" + "; ".join(", ".join(_all(c) for c in r.findall(x.q("m:e"))) for r in e.findall(x.q("m:mr"))) + ")"
    if k == "eqArr":
        return "cases(" + ", ".join(_all(c) for c in e.findall(x.q("m:e"))) + ")"
    if k == "func":
        return f"{part('fName')}({part('e')})"
    if k == "acc":
        mark = x.attr(e.find(f"{x.q('m:accPr')}/{x.q('m:chr')}"), "m:val", "\u0302")
        return f"{ {v: n for n, v in ACCENTS.items()}.get(mark, 'hat') }({part('e')})"
    if k == "bar":
        top = x.attr(e.find(f"{x.q('m:barPr')}/{x.q('m:pos')}"), "m:val", "bot") == "top"
        return f"{'overline' if top else 'underline'}({part('e')})"
    if k == "groupChr":
        top = x.attr(e.find(f"{x.q('m:groupChrPr')}/{x.q('m:pos')}"), "m:val", "bot") == "top"
        return f"{'overbrace' if top else 'underbrace'}({part('e')})"
    if k in ("limLow", "limUpp"):
        return part("e") + ("_" if k == "limLow" else "^") + _group(part("lim"))
    if k == "phant":
        return f"hide({part('e')})"
    return _all(e)


def _all(e: ET.Element | None) -> str:
    if e is None:
        return ""
    return re.sub(r"\s+", " ", " ".join(p for c in e if not c.tag.endswith("Pr") and (p := from_omml(c)))).strip()
