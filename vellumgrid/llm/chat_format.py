r"""Chat formatting with a grammar round trip, in built-in expressions only.

A conversation is rendered as one training text:

    ### role\n  text  </turn>\n            for a turn whose text is verbatim
    ### role\\\n  escaped text  </turn>\n  for a turn whose text is escaped (one backslash ends its header)

`### ` and `</turn>` are the control strings. parse() is a deterministic parser of that grammar: it splits at `### `,
and fails on any piece that doesn't end in, or holds elsewhere, a `</turn>`. A conversation is rendered verbatim,
parsed again and compared with its source; if they differ, the turns that don't survive alone are escaped, and if they
still differ, all turns are; a text that isn't its source then, either, is an error. Escaping is reversible: a backslash becomes \s, `### ` becomes `#\h## `, `</turn>`
becomes `<\t/turn>`; roles have %, #, <, backslash and newline percent-encoded.

Defined results: a null role or text counts as empty; turns are ordered by (turn, role, text), a null turn first, and
repeated rows are repeated turns; rows with a null conv_id are conversations of one turn each, as nothing says that they
belong together; an empty table formats to no rows; columns beyond conv_id, turn, role and text are not read, so their
names don't clash. A conversation is one training text, so its turns meet in
one row; the format itself is linear in their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.llm._shared import table

HEAD, END = "### ", "</turn>"
ROLE_CODES = [("%", "%25"), ("\n", "%0A"), ("#", "%23"), ("<", "%3C"), ("\\", "%5C")]
TEXT_CODES = [("\\", "\\s"), ("### ", "#\\h## "), ("</turn>", "<\\t/turn>")]
LOSS_ROLE = "assistant"


def _lit(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _replaced(x: str, codes: list[tuple[str, str]]) -> str:
    for a, b in codes:
        x = f"replace({x}, {_lit(a)}, {_lit(b)})"
    return x


def _encoded(x: str, codes: list[tuple[str, str]]) -> str:
    return _replaced(x, codes)


def _decoded(x: str, codes: list[tuple[str, str]]) -> str:
    return _replaced(x, [(b, a) for a, b in reversed(codes)])


def render(turns: str, escaped: str) -> str:
    """SQL for the rendered text of the array `turns` of (role, text); `escaped` is a condition on the turn t."""
    head = f"concat({_lit(HEAD)}, {_encoded('t.role', ROLE_CODES)})"
    plain = f"concat({head}, '\\n', t.text, {_lit(END)}, '\\n')"
    safe = f"concat({head}, '\\\\', '\\n', {_encoded('t.text', TEXT_CODES)}, {_lit(END)}, '\\n')"
    return f"array_join(transform({turns}, t -> CASE WHEN {escaped} THEN {safe} ELSE {plain} END), '')"


def pieces(text: str) -> str:
    """SQL for the parsed pieces of a rendered text, an array of (head, body, sound); body still is as rendered."""
    stop = len(END) + 1
    cut = f"slice(split({text}, {_lit(HEAD)}, -1), 2, 1000000000)"
    each = f"""transform({cut}, p -> named_struct('p', p, 'head', substring_index(p, '\\n', 1)))"""
    each = f"""transform({each}, x -> named_struct('head', x.head, 'body', substring(x.p, length(x.head) + 2, greatest(0, length(x.p) - length(x.head) - 1 - {stop})),
      'sound', endswith(x.p, {_lit(END + chr(10))}) AND length(x.p) >= length(x.head) + 1 + {stop}))"""
    return f"transform({each}, x -> named_struct('head', x.head, 'body', x.body, 'sound', x.sound AND instr(x.body, {_lit(END)}) = 0))"


def parse(text: str) -> str:
    """SQL for the turns (role, text) that the deterministic parser recovers; null if the text isn't in the grammar."""
    found = pieces(text)
    turn = f"""named_struct('role', {_decoded("CASE WHEN endswith(x.head, '\\\\\\\\') THEN substring(x.head, 1, length(x.head) - 1) ELSE x.head END", ROLE_CODES)},
      'text', CASE WHEN endswith(x.head, '\\\\') THEN {_decoded('x.body', TEXT_CODES)} ELSE x.body END)""".replace("'\\\\\\\\'", "'\\\\'")
    return f"CASE WHEN {text} = '' OR (startswith({text}, {_lit(HEAD)}) AND forall({found}, x -> x.sound)) THEN transform({found}, x -> {turn}) END"


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order."""
    one = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    return rows.select("conv_id", alone.alias("alone"), one.alias("t")).groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("turns")).select("conv_id", F.expr("transform(turns, t -> named_struct('role', t.role, 'text', t.text))").alias("turns"))


def format_chats(rows: DataFrame) -> DataFrame:
    """(conv_id, turns, level, formatted, parts): level 0 is verbatim, 1 escapes conflicting turns, 2 all turns. parts are the parsed pieces of the formatted text, each with its turn's role, text, and whether it is under the loss mask; a piece covers 4 + length(head) + 1 characters, then length(body) characters of text, then 8."""
    df = conversations(rows)
    alone = f"NOT ({parse(render('array(t)', 'false').replace('t ->', 'u ->').replace('t.', 'u.'))} <=> array(named_struct('role', t.role, 'text', t.text)))"
    df = df.withColumn("_f0", F.expr(render("turns", "false")))
    df = df.withColumn("_ok0", F.expr(f"coalesce({parse('_f0')} = turns, false)"))
    df = df.withColumn("_f1", F.expr(f"CASE WHEN NOT _ok0 THEN {render('turns', alone)} END"))
    df = df.withColumn("_ok1", F.expr(f"coalesce({parse('_f1')} = turns, false)"))
    df = df.withColumn("level", F.expr("CASE WHEN _ok0 THEN 0 WHEN _ok1 THEN 1 ELSE 2 END"))
    df = df.withColumn("_f2", F.expr(f"CASE WHEN level = 2 THEN {render('turns', 'true')} END"))
    df = df.withColumn("_f2", F.expr(f"CASE WHEN level < 2 THEN NULL WHEN {parse('_f2')} = turns THEN _f2 ELSE raise_error('a conversation that no escaping keeps') END"))
    df = df.withColumn("formatted", F.expr("CASE level WHEN 0 THEN _f0 WHEN 1 THEN _f1 ELSE _f2 END"))
    df = df.withColumn("_p", F.expr(pieces("formatted"))).withColumn("_t", F.expr(parse("formatted")))
    df = df.withColumn("parts", F.expr(f"transform(arrays_zip(_p, _t), z -> named_struct('head', z._p.head, 'body', z._p.body, 'role', z._t.role, 'text', z._t.text, 'escaped', endswith(z._p.head, '\\\\'), 'loss', z._t.role = '{LOSS_ROLE}'))"))
    return df.drop("_f0", "_ok0", "_f1", "_ok1", "_f2", "_p", "_t")


def loss_spans(formatted: DataFrame) -> DataFrame:
    """(conv_id, turn_no, start, end, text): the characters of `formatted` under the loss mask, code-point offsets. One row for each masked turn; offsets are a running sum over the pieces' lengths."""
    flat = formatted.select("conv_id", "formatted", F.posexplode("parts").alias("turn_no", "p"))
    flat = flat.withColumn("before", F.expr("4 + length(p.head) + 1L")).withColumn("whole", F.expr("before + length(p.body) + 8"))
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn_no").rowsBetween(Window.unboundedPreceding, -1)
    flat = flat.withColumn("start", F.coalesce(F.sum("whole").over(w), F.lit(0)) + F.col("before")).withColumn("end", F.expr("start + length(p.body)"))
    return flat.where("p.loss").select("conv_id", "turn_no", "start", "end", F.expr("substring(formatted, start + 1, cast(end - start AS int))").alias("text"))


#: A conversation of control strings that every run formats too.
PROBE = r"\### Assistant: </turn> ok"


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe)
    df = format_chats(rows).withColumn("_loss", F.expr("array_join(transform(filter(parts, p -> p.loss), p -> p.text), '')"))
    return df.select(
        "conv_id",
        F.size("parts").cast("long").alias("n_turns"),
        F.expr("sha2(cast(array_join(transform(parts, p -> concat(p.role, '\\n', p.text, '\\n')), '') AS binary), 256)").alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.expr("sha2(cast(_loss AS binary), 256)").alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.expr("size(filter(parts, p -> p.escaped))").cast("long").alias("escaped_turns"),
    )


ORACLE = r"""
WITH r AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
c AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, contains(text, '### ') OR contains(text, '</turn>') AS esc FROM r)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(role) + length(regexp_replace(role, '[^%#<\\\n]', '', 'g')) * 2 + 1 + length(text) + 8
    + CASE WHEN esc THEN 1 + (length(text) - length(replace(text, '\', ''))) + (length(text) - length(replace(text, '### ', ''))) // 4 * 2
      + (length(text) - length(replace(text, '</turn>', ''))) // 7 * 2 ELSE 0 END)::BIGINT AS formatted_chars,
  count_if(esc)::BIGINT AS escaped_turns
FROM c GROUP BY conv_id, alone"""
