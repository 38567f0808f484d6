"""Multi-party chat formatting: the same dialogue once from every participant's side.

For each speaker of a conversation the dialogue is rendered with that speaker as ``assistant``
and the others as named users; only the assistant's words are marked for training. Column
expressions only: the main path stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.session import materialize

START, END = "<|im_start|>", "<|im_end|>"


def _numbered(turns: DataFrame) -> DataFrame:
    """Adds ``place``, a turn's rank in its conversation, without one window per conversation.

    The rows are dealt by range over (conversation, turn, role, text) and written, so a long
    conversation lies in many files; ranks are taken inside a file, and the rows of earlier
    files are added. Only conversations that go on from an earlier file need that: at most one
    per file, which bounds the broadcast by the number of files.
    """
    order = ["conv_id", F.col("turn").isNull(), "turn", "role", "tie"]
    dealt = turns.withColumn("tie", F.md5("text")).repartitionByRange(*order)
    dealt = materialize(dealt.withColumn("file", F.spark_partition_id()), "turns")
    counts = dealt.groupBy("conv_id", "file").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    goes_on = counts.withColumn("before", F.sum("n").over(earlier)).filter("before > 0").select(
        F.col("conv_id").alias("_conv"), F.col("file").alias("_file"), "before"
    )
    inside = Window.partitionBy("file", "conv_id").orderBy(*order[1:])
    ranked = dealt.withColumn("within", F.row_number().over(inside) - 1)
    ranked = ranked.join(
        F.broadcast(goes_on), ranked["conv_id"].eqNullSafe(goes_on["_conv"]) & (ranked["file"] == goes_on["_file"]), "left"
    )
    return ranked.withColumn("place", F.col("within") + F.coalesce("before", F.lit(0)))


def perspectives(
    conversations: DataFrame, turns_per_part: int = 64, narrators: tuple[str, ...] = ("system",),
) -> DataFrame:
    """``conv_id, speaker, part, n_turns, n_trained, text, mask`` for every participant.

    A conversation of more than ``turns_per_part`` turns comes in parts, which concatenated in
    order are the whole rendering. ``mask`` lists the trained spans of ``text`` as
    ``array<struct<start, end>>`` in characters: what the speaker says and the mark that ends
    it. ``narrators`` speak as ``system`` on every side and are no participants; a dialogue of
    narrators only gives no row.

    Turns go by number, those without one last, ties by role and the text's md5; repeated rows are
    repeated turns. A null role speaks as ``unknown``, a null text is empty, and rows with a
    null ``conv_id`` are one conversation. Marks inside a text are broken by a space, so no
    text can end its own turn. A role is shown with blanks for line breaks and ``<>|``; roles that
    differ only there stay speakers of their own.
    """
    body = F.replace(F.coalesce("text", F.lit("")), F.lit("<|im_"), F.lit("<| im_"))
    turns = conversations.select(
        F.col("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"), body.alias("text"),
    )
    part = F.floor(F.col("place") / turns_per_part).cast("long")
    parts = _numbered(turns).groupBy("conv_id", part.alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("said")
    )
    speakers = turns.filter(~F.col("role").isin(*narrators)).select(
        F.col("conv_id").alias("_conv"), F.col("role").alias("speaker")
    ).distinct()
    sides = parts.join(speakers, parts["conv_id"].eqNullSafe(speakers["_conv"])).drop("_conv")

    def shown(role: Column) -> Column:
        return F.regexp_replace(role, r"[\r\n<>|]", " ")

    def head(turn: Column) -> Column:
        return (
            F.when(turn["role"].isin(*narrators), F.lit(f"{START}system\n"))
            .when(turn["role"] == F.col("speaker"), F.lit(f"{START}assistant\n"))
            .otherwise(F.concat(F.lit(f"{START}user name="), shown(turn["role"]), F.lit("\n")))
        )

    pieces = F.transform(
        "said",
        lambda t: F.struct(
            head(t).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"),
            (t["role"] == F.col("speaker")).alias("own"),
        ),
    )
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def walk(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        span = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct(
            (end + 1).cast("long").alias("at"),
            F.when(p["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    sides = sides.withColumn("pieces", pieces)
    return sides.select(
        "conv_id", "speaker", "part", F.size("pieces").cast("long").alias("n_turns"),
        F.size(F.filter("pieces", lambda p: p["own"])).cast("long").alias("n_trained"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("text"),
        F.aggregate("pieces", zero, walk, lambda acc: acc["spans"]).alias("mask"),
    )
