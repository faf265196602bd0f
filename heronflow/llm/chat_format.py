r"""Operator 2: chat formatting with Spark expressions only.

Turns are collected twice: up to 64 consecutive turn numbers of a conversation
are sorted and folded into one part, then the parts of a conversation are put
in order and joined, so a conversation with very many turns reaches its last
task as few rows. Turns of one role that follow each other share a block.

Template, for roles r1, r2 and texts t1 to t3, the first two of r1::

    <s>[INST] r1 [/INST]t1<sep>t2</s><s>[INST] r2 [/INST]t3</s>

The strings in :data:`CONTROL` mark turns. Inside roles and texts a backslash
is doubled and a backslash is put behind the first character of every control
string; dropping the first of each backslash and the character behind it undoes
both. ``loss_spans`` has start and length in code points of every text of
:data:`TRAINED` in ``formatted``, in order.

Cases: null texts and roles are empty; rows are sorted by turn (null first),
then role, then text, so ties and repeated rows keep a fixed order and all
count; a null conversation is a conversation; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heronflow.llm.common import table

OPEN, ROLE_END, NEXT, CLOSE = "<s>[INST] ", " [/INST]", "<sep>", "</s>"
#: Fixed: the strings that a text must not hold as they are.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<sep>")
TRAINED = "assistant"
PART = 64


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        text = F.replace(text, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, not for each use."""
    return F.transform(F.array(value), use)[0]


def _span(start: Column, length: Column) -> Column:
    return F.struct(start.cast("bigint").alias("start"), length.cast("bigint").alias("length"))


def _head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(ROLE_END))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans of conv_id, turn, role, text."""
    role, text = (escaped(F.coalesce(F.col(c), F.lit(""))) for c in ("role", "text"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    parts = rows.groupBy("conv_id", F.floor(F.col("turn") / PART).alias("part")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def fold(so_far: Column, turn: Column) -> Column:
        before = F.when(so_far.role.isNull(), "").when(so_far.role == turn.role, NEXT).otherwise(F.concat(F.lit(CLOSE), _head(turn.role)))
        start = F.char_length(so_far.body) + F.char_length(before)
        span = F.when(turn.role == TRAINED, F.array(_span(start, F.char_length(turn.text)))).otherwise(F.array().cast(SPANS))
        return F.struct(turn.role.alias("role"), F.concat(so_far.body, before, turn.text).alias("body"), F.concat(so_far.spans, span).alias("spans"))

    nothing = F.struct(F.lit(None).cast("string").alias("role"), F.lit("").alias("body"), F.array().cast(SPANS).alias("spans"))
    folded = parts.select("conv_id", "part", F.col("turns")[0]["role"].alias("first"), F.aggregate("turns", nothing, fold).alias("fold"))
    whole = folded.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "first", F.col("fold.role").alias("last"), "fold.body", "fold.spans"))).alias("parts"))

    def joined(parts: Column) -> Column:
        def piece(part: Column, k: Column) -> Column:
            same = F.get(parts, k - 1)["last"] == part.first
            before = F.when(k == 0, _head(part.first)).when(same, NEXT).otherwise(F.concat(F.lit(CLOSE), _head(part.first)))
            return F.struct(F.char_length(before).cast("bigint").alias("skip"), F.concat(before, part.body).alias("text"), part.spans.alias("spans"))

        return F.transform(parts, piece)

    pieces = whole.select("conv_id", _once(F.col("parts"), joined).alias("pieces"))
    ends = F.aggregate("pieces", F.array(F.lit(0).cast("bigint")), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + F.char_length(p.text))))
    moved = _once(
        ends, lambda e: F.flatten(F.transform("pieces", lambda p, k: F.transform(p.spans, lambda s: _span(s.start + F.get(e, k) + p.skip, s.length))))
    )
    return pieces.select("conv_id", F.concat(F.array_join(F.transform("pieces", lambda p: p.text), ""), F.lit(CLOSE)).alias("formatted"), moved.alias("loss_spans"))


SPANS = "array<struct<start:bigint,length:bigint>>"


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of role and text."""
    inner = F.substr(formatted, F.lit(len(OPEN) + 1), F.char_length(formatted) - len(OPEN) - len(CLOSE))
    blocks = F.split(inner, r"\Q" + CLOSE + OPEN + r"\E", -1)

    def turns(block: Column) -> Column:
        return F.transform(F.split(block[1], r"\Q" + NEXT + r"\E", -1), lambda t: F.struct(unescaped(block[0]).alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, lambda b: _once(F.split(b, r"\Q" + ROLE_END + r"\E", 2), turns)))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, as it was before it was escaped."""

    def cut(units: Column) -> Column:  # four bytes a code point: a span is found without counting
        return F.array_join(F.transform(spans, lambda s: unescaped(F.decode(F.substring(units, s.start.cast("int") * 4 + 1, s.length.cast("int") * 4), "UTF-32"))), "")

    return _once(F.encode(formatted, "UTF-32"), cut)


#: A conversation of two turns that both look like a turn mark.
TRAP = [(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))]


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = format_conversations(rows.union(spark.createDataFrame(TRAP, rows.schema)))
    back = out.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


def _sql_escaped(column: str) -> str:
    text = f"replace(coalesce({column}, ''), '\\', '\\\\')"
    for mark in CONTROL:
        text = f"replace({text}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return text


SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
), seen AS (
  SELECT *, length({_sql_escaped("text")}) AS text_chars, length({_sql_escaped("role")}) AS role_chars,
    {_sql_escaped("role")} AS r, {_sql_escaped("text")} AS t,
    row_number() OVER w AS k, lag(role) OVER w AS last
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_sql_escaped("role")}, {_sql_escaped("text")})
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = '{TRAINED}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = '{TRAINED}'), '')) AS loss_sha256,
  CAST({len(CLOSE)} + sum(text_chars + CASE WHEN k = 1 THEN {len(OPEN + ROLE_END)} + role_chars
    WHEN last = role THEN {len(NEXT)} ELSE {len(CLOSE + OPEN + ROLE_END)} + role_chars END) AS BIGINT) AS formatted_chars
FROM seen GROUP BY conv_id
"""
