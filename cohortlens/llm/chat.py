"""Operator 4: relational chat formatting in Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template and what replaces them in texts; the first is the escape itself.
ESCAPES = [("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"), ("<part/>", "\\p")]
#: A role's end in a header; not in a role itself.
ROLE_ESCAPES = [*ESCAPES, (":", "\\c")]
ROLES = ["system", "user", "assistant"]


def escape(text: Column, table=ESCAPES) -> Column:
    for raw, code in table:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column, table=ESCAPES) -> Column:
    for raw, code in reversed(table):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def _label(role: Column) -> Column:
    """System, User, Assistant; any other role is escaped and led by "="."""
    return F.when(role.isin(ROLES), F.initcap(role)).otherwise(F.concat(F.lit("="), escape(role, ROLE_ESCAPES)))


def _role(label: Column) -> Column:
    return F.when(label.startswith("="), unescape(F.substring(label, 2, 1 << 30), ROLE_ESCAPES)).otherwise(F.lower(label))


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, segments, formatted) of each conversation in turns (conv_id, turn, role, text).

    Turns are collected as structs and sorted by turn, role and text; a null
    turn comes first, null roles and texts are empty, repeated rows are turns
    of their own, and a null conv_id is a conversation. Adjacent turns of one
    role are merged into one with an array of texts, parted by ``<part/>``:
    ``### User: text<part/>text</turn>\\n### Assistant: text</turn>\\n``.
    Control strings in texts are escaped, reversibly. ``segments`` are the
    pieces of the output in order with the loss mask, ``loss`` being true for
    the texts of ``loss_role``; ``formatted`` is them joined.

    Rows are collected within each task before they are shuffled, so a
    conversation with many rows arrives as a few lists; its one output row
    holds its whole text in any case. Other columns of turns aren't read.
    """
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    # a run of turns of one role begins where the turn before has another
    first = F.filter(F.sequence(F.lit(0), F.size("ts") - 1), lambda i: (i == 0) | (F.get("ts", i - 1).role != F.get("ts", i).role))
    runs = sorted_turns.withColumn("first", first)
    size = lambda at, k: F.coalesce(F.get("first", k + 1), F.size("ts")) - at
    merged = F.transform("first", lambda at, k: F.struct(F.get("ts", at).role.alias("role"), F.transform(F.slice("ts", at + 1, size(at, k)), lambda x: x.text).alias("texts")))
    runs = runs.select("conv_id", merged.alias("runs"))

    def piece(text, loss):
        return F.struct(text.alias("text"), loss.alias("loss"))

    def pieces(run):
        apart = F.array(piece(F.lit("<part/>"), F.lit(False)))
        texts = F.transform(run.texts, lambda t, i: F.concat(F.when(i > 0, apart).otherwise(F.slice(apart, 1, 0)), F.array(piece(escape(t), run.role == loss_role))))
        head, tail = F.concat(F.lit("### "), _label(run.role), F.lit(": ")), F.lit("</turn>\n")
        return F.concat(F.array(piece(head, F.lit(False))), F.flatten(texts), F.array(piece(tail, F.lit(False))))

    out = runs.select("conv_id", F.flatten(F.transform("runs", pieces)).alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s.text), ""))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation was made of."""
    blocks = F.filter(F.split(formatted, "</turn>\n", -1), lambda b: b != "")

    def turns(block):
        label = F.substring_index(F.substring(block, 5, 1 << 30), ":", 1)
        body = F.substring(block, F.length(label) + 7, F.lit(1 << 30))
        return F.transform(F.split(body, "<part/>", -1), lambda part: F.struct(_role(label).alias("role"), unescape(part).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def chat_digest(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the output."""
    made = format_chats(turns).withColumn("back", read_turns(F.col("formatted")))
    all_turns = F.array_join(F.transform("back", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = unescape(F.array_join(F.transform(F.filter("segments", lambda s: s.loss), lambda s: s.text), ""))
    return made.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_probe(turns: DataFrame) -> DataFrame:
    """turns and conversation -7, whose texts hold the template's own control strings."""
    probe = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", probe), (-7, 1, "assistant", probe)]
    extra = turns.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").union(extra)


def _sql() -> str:
    def literal(x):
        return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"

    def esc(x, table):
        for raw, code in table:
            x = f"replace({x}, {literal(raw)}, {literal(code)})"
        return x

    label = f"CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE '=' || {esc('role', ROLE_ESCAPES)} END"
    probe = literal("\\### Assistant: </turn> ok")
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM
  (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', {probe} UNION ALL SELECT -7, 1, 'assistant', {probe})),
n AS (SELECT *, row_number() OVER w AS r, lag(role) OVER w AS before, lead(role) OVER w AS after FROM c
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (SELECT *, CASE WHEN before IS NULL OR before <> role THEN '### ' || {label} || ': ' ELSE '' END || {esc('text', ESCAPES)}
  || CASE WHEN after IS NULL OR after <> role THEN '</turn>' || chr(10) ELSE '<part/>' END AS piece FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY r)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY r) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(len(piece))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""


CHAT_SQL = _sql()
