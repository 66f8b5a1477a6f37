"""Chat formatting: a state machine over roles and a declarative template.

Only DataFrame functions run here. A template names the marks around a turn, the
roles whose texts count for the loss, and the machine's moves; texts are escaped
so that no control string can stand in them:

    \\ becomes \\b, < becomes \\l and > becomes \\g, in roles a newline becomes \\n

So an escaped text holds no < or >, and unescaping (\\g, \\l, \\n, then \\b) gives it
back. Marks are literal. A template is taken only if its output can be read back
in one way: the mark after the role holds <, > or a newline, that after the text
begins with <, and no < in a mark could be mistaken for that beginning.

A conversation's turns are ordered by (turn, role, text), nulls first. Rows are
formatted one by one and gathered in two steps, first CHUNK turn numbers at a
time, so a very long conversation's rows meet as a few long strings.

Defined results: a null text or role is empty; rows with a null conversation
number are one conversation; a turn out of order leaves `valid` false and is
formatted as it stands; repeated rows are turns of their own, turns that tie in
number, role and text are alike; very long texts are whole, a conversation's
formatted string may have 2 GB; other columns are passed over.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 256


@dataclass(frozen=True)
class Template:
    """Marks around a turn, roles with loss, and moves (state, role) -> state of the machine."""

    begin: str = "<turn "
    head: str = ">"
    end: str = "</turn>\n"
    loss: tuple[str, ...] = ("assistant",)
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "ready",
            ("start", "user"): "asked",
            ("ready", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    final: tuple[str, ...] = ("answered", "asked")

    def __post_init__(self) -> None:
        if not any(c in self.head for c in "<>\n"):
            raise ValueError("the mark after a role must hold <, > or a newline")
        if not self.end.startswith("<"):
            raise ValueError("the mark after a text must begin with <")
        for mark, first in ((self.begin, 0), (self.head, 0), (self.end, 1)):
            for i in range(first, len(mark)):
                rest = mark[i:]
                if rest[0] == "<" and (rest.startswith(self.end) or self.end.startswith(rest)):
                    raise ValueError(f"{rest!r} in a mark can be mistaken for {self.end!r}")


DEFAULT = Template()


def escape(text: Column, role: bool = False) -> Column:
    marks = [("\\", "\\b"), ("<", "\\l"), (">", "\\g"), *([("\n", "\\n")] if role else [])]
    for a, b in marks:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in (("\\g", ">"), ("\\l", "<"), ("\\n", "\n"), ("\\b", "\\")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def format_conversations(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, formatted, segments (text, loss), state and valid of each conversation.

    The segments' texts, joined, are the formatted string; a turn with loss is
    three segments, of which only its text has the flag.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    order = F.struct(F.col("turn").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text"))
    one = F.struct(order.alias("order"), escape(role, role=True).alias("role"), escape(text).alias("body"))
    chunk = F.floor(F.col("turn").cast("double") / CHUNK).cast("long")
    rows = turns.select(F.col("conv_id"), chunk.alias("chunk"), one.alias("one"))
    chunks = rows.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list("one")).alias("ones"))
    chunks = chunks.select("conv_id", F.struct("chunk", F.transform("ones", lambda x: F.struct(x["role"].alias("role"), x["body"].alias("body"))).alias("ones")).alias("part"))
    whole = chunks.groupBy("conv_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["ones"])).alias("ones"))

    losing = F.array(*(F.lit(r) for r in template.loss))

    def segments(x: Column) -> Column:
        head = F.concat(F.lit(template.begin), x["role"], F.lit(template.head))
        with_loss = F.array_contains(losing, unescape(x["role"]))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(x["body"].alias("text"), with_loss.alias("loss")),
            F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")),
        )

    moves = F.create_map(*(F.lit(x) for (state, r), nxt in template.moves.items() for x in (f"{state}|{r}", nxt)))
    step = lambda state, x: F.coalesce(F.try_element_at(moves, F.concat(state, F.lit("|"), unescape(x["role"]))), F.lit("broken"))
    whole = whole.select("conv_id", F.flatten(F.transform("ones", segments)).alias("segments"), F.aggregate("ones", F.lit("start"), step).alias("state"))
    return whole.select("conv_id", F.array_join(F.transform("segments", lambda x: x["text"]), "").alias("formatted"), "segments", "state", F.col("state").isin(*template.final).alias("valid"))


def read_turns(formatted: Column, template: Template = DEFAULT) -> Column:
    """The turns (role, text) of a formatted string."""
    literal = "\\Q" + template.end.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    parts = F.split(formatted, literal)
    parts = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))  # nothing stands behind the last mark

    def turn(x: Column) -> Column:
        at = F.locate(template.head, x, len(template.begin) + 1)
        role = F.substring(x, F.lit(len(template.begin) + 1), at - len(template.begin) - 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(x, at + len(template.head), F.length(x))).alias("text"))

    return F.transform(parts, turn)


def digest(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid: read back from the formatted strings and segments."""
    turns = formatted.select("conv_id", "formatted", "segments", "valid", read_turns(F.col("formatted"), template).alias("turns"))
    joined = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda x: x["loss"]), lambda x: unescape(x["text"])), "")
    turns = turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"), loss.alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"), "valid")
    return turns.select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "valid")


def with_probe(turns: DataFrame) -> DataFrame:
    """The turns and conversation -7, whose texts hold control strings."""
    probe = r"\### Assistant: </turn> ok"
    spark = turns.sparkSession
    kinds = dict(turns.dtypes)
    extra = spark.range(2).select(
        F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"),
        F.col("id").cast(kinds["turn"]).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(probe).alias("text"),
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(extra)


#: The digest of all conversations and conversation -7 in DuckDB, for the default template.
ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), states AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id,
  count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(text) + length(role) + 15 + 2 * length(text) + 2 * length(role) - length(replace(replace(replace(text, '\', ''), '<', ''), '>', '')) * 2 - length(replace(replace(replace(role, '\', ''), '<', ''), '>', '')) * 2
    + length(role) - length(replace(role, chr(10), '')) - (length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '>', ''))) - (length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), '>', ''))))::BIGINT AS formatted_chars,
  bool_and(CASE
    WHEN k = 1 THEN role IN ('system', 'user')
    WHEN role = 'user' THEN before = 'assistant' OR (before = 'system' AND k = 2)
    WHEN role = 'assistant' THEN before = 'user'
    ELSE false END) AND NOT (count(*) = 1 AND max(role) = 'system') AS valid
FROM states GROUP BY conv_id
"""
