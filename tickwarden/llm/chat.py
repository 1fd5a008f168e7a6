r"""Chat formatting that is read back before it is trusted.

A conversation becomes one text, each turn as ``<|im_start|>role\ntext<|im_end|>\n``. The grammar is

    conversation = turn*        turn = START role LF text END LF

with every control string (``<|name|>``) a token of its own, so that a text has one reading at most. Each turn is
rendered as it is and read back; where what comes back is not the turn, its content conflicts with the
grammar and is escaped: ``<``, any number of backslashes and ``|`` get one backslash more, and the role is
URL-encoded. The reader always takes one backslash away and decodes the role, so that content that looks
escaped already conflicts too. Then whole conversations are read back and compared with their source; in one that still
differs all turns are escaped. An escaped turn holds no ``<|`` and its role no line feed, so that it reads back as itself; hence no third round is needed,
and ``round_trips`` says of each conversation that it came back. All of it is Spark expressions.

Turns are rendered row by row; only the pieces of one conversation meet, as they make one text. Nulls: a null
role or text is empty, a null conv_id is a conversation of its own, null turns come first. Empty texts make turns without text. Very long texts: a
conversation must fit in one string (2 GB). Ties and repeated rows: rows with equal turn are ordered by role and text, and each is a turn. An
empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = r"<\|[^<>|\s]+\|>"
LEARNT = "assistant"
_TURNS = "array<struct<role:string,text:string>>"


def escaped_text(x: Column) -> Column:
    return F.regexp_replace(x, r"<(\\*)\|", r"<$1\\|")


def unescaped_text(x: Column) -> Column:
    return F.regexp_replace(x, r"<(\\*)\\\|", r"<$1|")


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(f"{END}\n"))


def parsed(formatted: Column) -> Column:
    """The turns that a formatted text holds, as array<struct<role, text>>; null if it doesn't follow the grammar."""
    marks = F.regexp_extract_all(formatted, F.lit(CONTROL), F.lit(0))
    pieces = F.split(formatted, CONTROL, -1)  # before the first mark, between marks, after the last
    starts = F.filter(marks, lambda x, i: i % 2 == 0)
    ends = F.filter(marks, lambda x, i: i % 2 == 1)
    around = F.filter(pieces, lambda x, i: i % 2 == 0)
    bodies = F.filter(pieces, lambda x, i: i % 2 == 1)
    sound = (
        (F.size(starts) == F.size(ends))
        & F.forall(starts, lambda x: x == START)
        & F.forall(ends, lambda x: x == END)
        & (F.get(around, F.lit(0)) == "")
        & F.forall(F.slice(around, 2, F.size(around)), lambda x: x == "\n")
        & F.forall(bodies, lambda x: F.instr(x, "\n") > 0)
    )
    turns = F.transform(
        bodies,
        lambda x: F.struct(F.try_url_decode(F.substring_index(x, "\n", 1)).alias("role"), unescaped_text(F.substr(x, F.locate("\n", x) + 1)).alias("text")),
    )
    return F.when(sound, turns)


def formatted_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, ``n_turns``, ``formatted``, ``loss_spans`` (start, end: code points of the assistant's texts as they stand in ``formatted``) and ``round_trips`` of each conversation."""
    df = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    df = df.withColumn("conflict", ~parsed(_turn(F.col("role"), F.col("text"))).eqNullSafe(F.array(F.struct("role", "text"))))
    df = df.withColumn("safe_role", F.when(F.col("conflict"), F.url_encode("role")).otherwise(F.col("role")))
    df = df.withColumn("safe_text", F.when(F.col("conflict"), escaped_text(F.col("text"))).otherwise(F.col("text")))
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    df = df.withColumn("nth", F.row_number().over(order))
    one = (
        df.groupBy("conv")
        .agg(F.sort_array(F.collect_list(F.struct("nth", "role", "text", "safe_role", "safe_text"))).alias("turns"))
        .withColumn("source", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
        .withColumn("pieces", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["safe_role"].alias("safe_role"), t["safe_text"].alias("safe_text"))))
    )
    rendered = F.array_join(F.transform("pieces", lambda t: _turn(t["safe_role"], t["safe_text"])), "")
    harder = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.url_encode(t["role"]).alias("safe_role"), escaped_text(t["text"]).alias("safe_text")))
    one = one.withColumn("back", parsed(rendered)).withColumn("pieces", F.when(F.col("back").eqNullSafe(F.col("source")), F.col("pieces")).otherwise(harder))
    one = one.withColumn("formatted", rendered).withColumn("back", parsed(F.col("formatted")))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + len(START) + F.length(t["safe_role"]) + 1
        end = begin + F.length(t["safe_text"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + len(END) + 1).alias("at"), F.when(t["role"] == LEARNT, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return one.select(
        F.col("conv").alias(conv),
        F.size("source").cast("long").alias("n_turns"),
        "formatted",
        F.aggregate("pieces", zero, step, lambda acc: acc["spans"]).alias("loss_spans"),
        F.col("back").eqNullSafe(F.col("source")).alias("round_trips"),
    )


def digest(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What the formatted texts and their loss spans hold, read back from them."""
    df = formatted.withColumn("back", parsed(F.col("formatted")))
    masked = F.array_join(F.transform("loss_spans", lambda s: unescaped_text(F.substring("formatted", s["start"] + 1, s["end"] - s["start"]))), "")
    return df.withColumn("masked", masked).select(
        conv,
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2(F.col("masked").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
