"""Chat formatting with DataFrame functions alone: a role machine, a template, loss flags.

``TEMPLATE`` says for each role which marks stand before and after its text and whether the text is
under the loss; other roles (and null, which counts as the empty role) use ``OTHER``, with the role
between the marks.  ``MOVES`` is the finite-state machine over roles; a conversation is valid if it
never leaves it and ends in one of ``ENDS``.  Invalid conversations are formatted too and flagged,
with the number of their first offending turn.

Escaping.  Wherever a text spells a control string, with or without backslashes after its first
character, one backslash is put after that character; reading takes one away.  An escaped text thus
never holds a control string, and every text comes back unchanged.

Defined results: null texts count as empty; turns are in order of turn (nulls first), then role,
then text; repeated rows are turns of their own; a null conv_id is a conversation; an empty table
gives no rows; extra columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEMPLATE = {"system": ("<<SYS>>", "<</SYS>>", False), "user": ("[INST]", "[/INST]", False), "assistant": ("<s>", "</s>", True)}
OTHER = ("[TURN]", "[:]", "[/TURN]")
MOVES = {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"}
ENDS = ("user", "assistant")
#: the control strings, as first character and rest
CONTROL = r"(/?INST\]|/?TURN\]|:\]|/?s>|</?SYS>>)"
CLOSING = r"\[/INST\]|\[/TURN\]|</s>|<</SYS>>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(\[|<)(\\*)" + CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(\[|<)\\(\\*)" + CONTROL, r"$1$2$3")


def _by_role(role: Column, pick, other: Column) -> Column:
    out = other
    for name, (before, after, loss) in TEMPLATE.items():
        out = F.when(role == name, F.lit(pick(before, after, loss))).otherwise(out)
    return out


def _segments(turn: Column) -> Column:
    role, text = turn["role"], turn["text"]
    before = _by_role(role, lambda b, a, x: b, F.concat(F.lit(OTHER[0]), escaped(role), F.lit(OTHER[1])))
    after = _by_role(role, lambda b, a, x: a, F.lit(OTHER[2]))
    loss = _by_role(role, lambda b, a, x: x, F.lit(False))
    seg = lambda t, on: F.struct(t.alias("text"), on.alias("loss"))
    return F.array(seg(before, F.lit(False)), seg(escaped(text), loss), seg(after, F.lit(False)))


def format_chats(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, segments array<(text, loss)>, formatted, valid, bad_turn) of every conversation."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chats = rows.groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    moves = F.create_map(*[F.lit(x) for (state, r), to in MOVES.items() for x in (f"{state} {r}", to)])
    start = F.struct(F.lit("start").alias("state"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("bad"))

    def move(at: Column, t: Column) -> Column:
        to = F.coalesce(F.try_element_at(moves, F.concat_ws(" ", at["state"], t["role"])), F.lit("bad"))
        return F.struct(to.alias("state"), (at["n"] + 1).alias("n"), F.coalesce(at["bad"], F.when(to == "bad", at["n"])).alias("bad"))

    walked = chats.withColumn("walk", F.aggregate("turns", start, move)).withColumn("segments", F.flatten(F.transform("turns", _segments)))
    return walked.select(
        key,
        "segments",
        F.concat_ws("", F.transform("segments", lambda s: s["text"])).alias("formatted"),
        F.col("walk.state").isin(*ENDS).alias("valid"),
        F.col("walk.bad").alias("bad_turn"),
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""

    def turn(piece: Column) -> Column:
        out = F.struct(
            unescaped(F.regexp_extract(piece, r"(?s)^\[TURN\](.*?)\[:\]", 1)).alias("role"), unescaped(F.regexp_replace(piece, r"(?s)^\[TURN\].*?\[:\]", "")).alias("text")
        )
        for name, (before, _, _) in TEMPLATE.items():
            mine = F.struct(F.lit(name).alias("role"), unescaped(F.substring(piece, F.lit(len(before) + 1), F.length(piece))).alias("text"))
            out = F.when(F.startswith(piece, F.lit(before)), mine).otherwise(out)
        return out

    return F.transform(F.filter(F.split(formatted, CLOSING), lambda p: p != ""), turn)


def digest(chats: DataFrame, key: str = "conv_id") -> DataFrame:
    """What a reader of the output finds: its turns, and all text under the loss."""
    newline = F.lit("\n")
    turns = F.transform("turns", lambda t: F.concat(t["role"], newline, t["text"], newline))
    learnt = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"]))
    read = chats.withColumn("turns", read_back(F.col("formatted"))).withColumn("learnt", F.concat_ws("", learnt))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return read.select(
        key,
        F.size("turns").cast("long").alias("n_turns"),
        sha(F.concat_ws("", turns)).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        sha(F.col("learnt")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


#: DuckDB's view of the same digests, straight from the table.
ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), marked AS (
  SELECT *, lag(role) OVER chat AS before, row_number() OVER chat AS n,
    CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
      ELSE 16 + length(regexp_replace(role, '(\[|<)(\\*)(/?INST\]|/?TURN\]|:\]|/?s>|</?SYS>>)', '\1\\\2\3', 'g')) END
      + length(regexp_replace(text, '(\[|<)(\\*)(/?INST\]|/?TURN\]|:\]|/?s>|</?SYS>>)', '\1\\\2\3', 'g')) AS size
  FROM rows WINDOW chat AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') ELSE (before, role) IN (('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) END)
    AND arg_max(role, n) IN ('user', 'assistant') AS valid
FROM marked GROUP BY conv_id
"""
