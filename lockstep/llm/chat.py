"""Chat formatting: cumulative snapshots collapse to maximal conversations before rendering.

Loggers store a conversation again with each turn. A conversation's turns, in order, have a rolling hash:
the xor of a hash of (place, role, text) over all turns so far, twice with different seeds. One whose full
hash is the prefix hash of a longer one goes by an anti join; of equal ones the least conv_id stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Turns of a stretch that is numbered and rendered together.
STRETCH = 1024


def placed_turns(turns: DataFrame) -> DataFrame:
    """conv_id, role, text and place (from 0): turns ordered by turn (nulls last), role, text.

    Rows are dealt in this order, so a conversation of any length lies in many tasks; a row's place is its place
    in its task and the rows of the conversation in the tasks before. Written to the shared folder."""
    order = [F.col(c).asc_nulls_last() for c in ("conv_id", "turn", "role", "text")]
    dealt = turns.select("conv_id", "turn", "role", "text").filter("conv_id is not null").repartitionByRange(*order).sortWithinPartitions(*order)
    # The task's number, then the row's in it.
    rows = written(dealt.withColumn("_n", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_n", 33)), "turns")
    sizes = rows.groupBy("conv_id", "_task").agg(F.min("_n").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy("conv_id").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv_id", "_task", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_start"))
    return written(rows.join(starts, ["conv_id", "_task"]).select("conv_id", (F.col("_n") + F.col("_start")).alias("place"), "role", "text"), "placed")


def prefix_hashes(placed: DataFrame) -> DataFrame:
    """conv_id, place and the rolling hashes h1, h2 of the turns up to each place. Stretches of places are rolled
    apart and start from the sums of the stretches before."""
    one = [F.xxhash64(F.lit(seed), "place", F.col("role").isNull(), "role", F.col("text").isNull(), "text") for seed in (11, 13)]
    rows = placed.select("conv_id", "place", one[0].alias("_a"), one[1].alias("_b"), F.expr(f"place div {STRETCH}").alias("_s"))
    sums = rows.groupBy("conv_id", "_s").agg(F.bit_xor("_a").alias("_x"), F.bit_xor("_b").alias("_y"))
    before = Window.partitionBy("conv_id").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("conv_id", "_s", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(n) for c, n in (("_x", "_p"), ("_y", "_q"))])
    upto = Window.partitionBy("conv_id", "_s").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rolled = rows.withColumns({"_r": F.bit_xor("_a").over(upto), "_t": F.bit_xor("_b").over(upto)})
    return rolled.join(starts, ["conv_id", "_s"]).select(
        "conv_id", "place", F.col("_r").bitwiseXOR(F.col("_p")).alias("h1"), F.col("_t").bitwiseXOR(F.col("_q")).alias("h2")
    )


def maximal(placed: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that are no proper prefix of another and, of equal ones,
    have the least conv_id."""
    hashes = written(prefix_hashes(placed), "prefixes")
    ends = hashes.groupBy("conv_id").agg(F.max(F.struct("place", "h1", "h2")).alias("_e"))
    whole = ends.groupBy(F.col("_e.place").alias("place"), F.col("_e.h1").alias("h1"), F.col("_e.h2").alias("h2")).agg(F.min("conv_id").alias("conv_id"))
    last = ends.select("conv_id", F.col("_e.place").alias("_last"))
    proper = hashes.join(last, "conv_id").filter("place < _last").select("place", "h1", "h2").distinct()
    return whole.join(proper, ["place", "h1", "h2"], "left_anti").select("conv_id", (F.col("place") + 1).alias("n_turns"))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n<|end|>\n"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, part, n_turns (of the conversation) and chat, the rendered turns of each maximal conversation.

    A part holds up to STRETCH turns, so a usual conversation has the part 0 alone and no task gathers an
    unbounded one. Repeated turn rows are turns of their own. Null roles and texts are rendered empty, yet
    differ from all others in comparison. Rows without a conv_id go. An empty table gives an empty result;
    other columns of ``turns`` are not read.
    """
    placed = placed_turns(turns)
    kept = maximal(placed)
    rows = placed.join(kept, "conv_id").withColumns({"part": F.expr(f"place div {STRETCH}"), "_t": rendered(F.col("role"), F.col("text"))})
    parts = rows.groupBy("conv_id", "part", "n_turns").agg(F.array_sort(F.collect_list(F.struct("place", "_t"))).alias("_l"))
    return parts.select("conv_id", "part", "n_turns", F.concat_ws("", F.transform("_l", lambda x: x["_t"])).alias("chat"))


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


QUERIES = {"op1_chat_formatting": op1_chat_formatting}
SQL = {
    "op1_chat_formatting": f"""
WITH placed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST) - 1 AS place, role, text
                FROM conversations WHERE conv_id IS NOT NULL),
chained AS (SELECT conv_id, place, string_agg(md5(coalesce(role, chr(1)) || chr(2) || coalesce(text, chr(1))), '')
                   OVER (PARTITION BY conv_id ORDER BY place) AS chain FROM placed),
ends AS (SELECT conv_id, max(place) AS last, arg_max(chain, place) AS chain FROM chained GROUP BY conv_id),
kept AS (SELECT min(conv_id) AS conv_id, max(last) + 1 AS n_turns FROM ends
         WHERE chain NOT IN (SELECT c.chain FROM chained c JOIN ends e ON c.conv_id = e.conv_id WHERE c.place < e.last) GROUP BY chain)
SELECT conv_id, place // {STRETCH} AS part, n_turns,
       string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), '' ORDER BY place) AS chat
FROM placed JOIN kept USING (conv_id) GROUP BY ALL
""",
}
