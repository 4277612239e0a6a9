"""Chat formatting with a grammar round trip, in DataFrame operations only.

Grammar: a conversation is its turns, each ``[INST] role level [/INST] text</s>``. The
control strings are ``<s>``, ``</s>``, ``[INST]`` and ``[/INST]``, and they may stand
for nothing but the marks. The parser is deterministic: split at ``</s>``; a turn's
header ends at the first `` level [/INST] ``; a control string elsewhere is an error.

Each turn is rendered plainly (level 0) and parsed again. Where the parse differs
from the source, the turn is rendered at the next level:

- level 1 puts a backslash after the first character of each control string;
- level 2 doubles every backslash first, so that any text comes back.

So ordinary texts stay as they are, and every text comes back exactly. The
rounds run on single turns before turns are gathered, so only the finished
conversation, which the result needs as one text, stands in one row.

The loss mask covers the text of assistant turns: spans in code points of the
formatted text, with the level at which to unescape them.

Cases: a null text or role counts as empty; turns with equal numbers are ordered
by role, then text, and all kept, as are repeated rows; a null turn number comes
first; rows with a null conv_id form one conversation; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, CLOSE, END = "[INST] ", " [/INST] ", "</s>"
CONTROL = r"</?s>|\[/?INST\]"
HEADER = r"(?s)^\[INST\] (.*?) ([012]) \[/INST\] (.*)$"
ASSISTANT = "assistant"


def _broken(x: Column) -> Column:
    """A backslash after the first character of each control string."""
    return F.regexp_replace(F.regexp_replace(x, r"<(/?s>)", r"<\\$1"), r"\[(/?INST\])", r"[\\$1")


def escape(x: Column, level: int) -> Column:
    return (x, _broken(x), _broken(F.regexp_replace(x, r"\\", r"\\\\")))[level]


def unescape(x: Column, level: Column) -> Column:
    light = F.regexp_replace(F.regexp_replace(x, r"<\\(/?s>)", r"<$1"), r"\[\\(/?INST\])", r"[$1")
    return F.when(level == "0", x).when(level == "1", light).otherwise(F.regexp_replace(x, r"(?s)\\(.)", r"$1"))


def render(role: Column, text: Column, level: int) -> Column:
    return F.concat(F.lit(OPEN), escape(role, level), F.lit(f" {level}{CLOSE}"), escape(text, level), F.lit(END))


def parse_turn(piece: Column) -> Column:
    """A turn without its end mark, as role, level, raw text and text."""
    level, raw = F.regexp_extract(piece, HEADER, 2), F.regexp_extract(piece, HEADER, 3)
    return F.struct(
        unescape(F.regexp_extract(piece, HEADER, 1), level).alias("role"),
        level.alias("level"),
        raw.alias("raw"),
        unescape(raw, level).alias("text"),
    )


def pieces(formatted: Column) -> Column:
    """A formatted text's turns without their end marks."""
    parts = F.split(formatted, END)
    return F.slice(parts, 1, F.size(parts) - 1)


def comes_back(rendered: Column, role: Column, text: Column) -> Column:
    """Whether a rendered turn parses to its source."""
    found = pieces(rendered)
    piece = F.get(found, 0)
    first = parse_turn(piece)
    marks = F.regexp_count(piece, F.lit(CONTROL)) == 2
    return (F.size(found) == 1) & F.endswith(rendered, F.lit(END)) & marks & (first["role"] == role) & (first["text"] == text)


def render_turns(turns: DataFrame) -> DataFrame:
    """Rows of conv_id, turn, role, text with ``rendered`` and ``round_trip``."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    role, text = F.col("role"), F.col("text")
    rows = rows.withColumn("rendered", render(role, text, 0))
    for level in (1, 2):
        rows = rows.withColumn("rendered", F.when(comes_back(F.col("rendered"), role, text), F.col("rendered")).otherwise(render(role, text, level)))
    return rows.withColumn("round_trip", comes_back(F.col("rendered"), role, text))


def format_chats(turns: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, formatted and round_trip."""
    one = F.struct("turn", "role", "text", "rendered")
    gathered = render_turns(turns).groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("t"), F.min("round_trip").alias("round_trip"))
    return gathered.select("conv_id", F.array_join(F.transform("t", lambda x: x["rendered"]), "").alias("formatted"), "round_trip")


def read_back(chats: DataFrame) -> DataFrame:
    """``chats`` with the turns, and the loss spans, that the formatted text holds."""
    parsed = chats.withColumn("turns", F.transform(pieces(F.col("formatted")), lambda p: F.struct(F.length(p).alias("length"), parse_turn(p).alias("t"))))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint,level:string>>").alias("spans"))

    def step(a: Column, x: Column) -> Column:
        n = F.length(x["t"]["raw"]).cast("long")
        span = F.struct((a["at"] + x["length"] - n).alias("start"), n.alias("length"), x["t"]["level"].alias("level"))
        return F.struct((a["at"] + x["length"] + len(END)).alias("at"), F.when(x["t"]["role"] == ASSISTANT, F.array_append(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    # Only assistant turns are folded into spans; their places need every turn's length.
    return parsed.withColumn("loss_spans", F.aggregate("turns", zero, step, lambda a: a["spans"])).withColumn("turns", F.transform("turns", lambda x: x["t"]))


def digests(chats: DataFrame) -> DataFrame:
    """What the formatted texts hold, as counts and digests."""
    parsed = chats.select("conv_id", "formatted", F.transform(pieces(F.col("formatted")), parse_turn).alias("turns"))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == ASSISTANT), lambda t: t["text"]), "")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = parsed.select("conv_id", "formatted", "turns", told.alias("told"), loss.alias("loss"))
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.col("told").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def extra_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7: both sides say control strings."""
    role = F.when(F.col("id") == 0, "user").otherwise(ASSISTANT)
    return spark.range(0, 2, 1, 1).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
