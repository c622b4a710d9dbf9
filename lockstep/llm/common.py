"""What the operators share: tables, text bytes, shared storage and distributed numbering."""

from __future__ import annotations

import ctypes

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.storage import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased, everything else untouched."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Rows that one task sorts when rows are numbered, on average.
BUCKET_ROWS = 100_000


def numbered(df: DataFrame, order: list[str], within: str | None = None, buckets: int | None = None,
             name: str = "row_number") -> tuple[DataFrame, DataFrame]:
    """``df`` with a gapless number from 0 in each value of ``within`` (or overall), and the sizes of
    those groups (group columns and ``group_rows``).

    Rows are spread over hash buckets of ``order``; a bucket's first number is the sum of the sizes of
    the buckets before it. So no task sorts more than one bucket of a group, however large the group,
    and a number depends on the rows alone, not on how they lie in partitions. Rows equal in ``order``
    are counted first and get a run of numbers, dealt out in pieces, so copies of one row don't meet in
    one task. Only columns in ``order`` and ``within`` are kept. ``buckets``: one for each BUCKET_ROWS distinct
    rows, if not given.
    """
    group = [within] if within else []
    keys = list(dict.fromkeys([*group, *order]))
    counted = written(df.groupBy(*keys).agg(F.count("*").alias("_copies")), "numbered")
    if buckets is None:
        buckets = max(32, -(-counted.count() // BUCKET_ROWS))
    counted = counted.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = counted.groupBy(*group, "_bucket").agg(F.sum("_copies").alias("_rows"))
    upto = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_rows").over(upto), F.lit(0)))
    totals = sizes.groupBy(*group).agg(F.sum("_rows").alias("group_rows"))
    before = (
        Window.partitionBy(*group, "_bucket").orderBy(*[F.col(c).asc_nulls_last() for c in order])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ranked = counted.withColumn("_before", F.coalesce(F.sum("_copies").over(before), F.lit(0)))
    on = ranked["_bucket"] == starts["_bucket"]
    for c in group:
        on = on & ranked[c].eqNullSafe(starts[c])
    placed = ranked.join(starts, on, "inner").select(
        *[ranked[c] for c in keys], (F.col("_start") + F.col("_before")).alias("_first"), "_copies"
    )
    piece = 4096
    pieces = placed.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_copies - 1) div {piece}"))))
    rows = pieces.withColumn(
        "_k", F.explode(F.sequence(F.col("_piece") * piece, F.least(F.col("_copies"), (F.col("_piece") + 1) * piece) - 1))
    )
    return rows.select(*keys, (F.col("_first") + F.col("_k")).alias(name)), totals


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, led by as many underscores as make it new in ``df``."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def give_back() -> None:
    """What Arrow and C hold of freed memory goes back to the system: workers outlive their tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_texts(df: DataFrame, keep: list[str], text: str, schema: str, make, piece: int = 4 << 20, also: tuple[str, ...] = (), size=len) -> DataFrame:
    """Columns ``keep`` beside what a function makes of each text.

    ``make()`` runs once in a task and returns f(texts, ...) -> one list for each column of ``schema`` (a DDL
    string without ``keep``); it gets lists of the columns ``also``, too. Texts reach f whole, null as null, in
    lists of about ``piece`` bytes by ``size`` of each, so that a task holds little at a time whatever the lengths. Bytes that
    aren't UTF-8 are read as replacement characters. A name of ``schema`` that is in ``keep`` is an error.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    made = StructType.fromDDL(schema)
    if clash := set(keep) & set(made.names):
        raise ValueError(f"columns by the names of new ones: {sorted(clash)}")
    out = StructType([*df.select(*map(quoted, keep)).schema.fields, *made.fields])
    arrow = to_arrow_schema(out)
    # What the function reads lies behind the columns that are kept; a text that is kept itself is sent once.
    first = len(keep)
    at = keep.index(text) if text in keep else first
    behind = first + (at == first)

    def run(batches):
        f = make()
        for batch in batches:
            held, start, n = [], 0, 0
            column = batch.column(at)
            if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
                column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
                read = lambda x: x if x is None else x.decode("utf-8", "replace")
            else:
                read = lambda x: x
            for i in range(batch.num_rows):
                held.append(value := read(column[i].as_py()))
                n += (size(value) if value else 0) + 64
                if n >= piece or i + 1 == batch.num_rows:
                    more = [batch.column(behind + j).slice(start, len(held)).to_pylist() for j in range(len(also))]
                    columns = [batch.column(j).slice(start, len(held)) for j in range(first)]
                    columns += [pa.array(x, type=arrow.field(first + k).type) for k, x in enumerate(f(held, *more))]
                    yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(columns, arrow, strict=True)], schema=arrow)
                    held, start, n = [], i + 1, 0
        f = batch = column = columns = more = None
        give_back()

    read = [*([quoted(text).alias("_text")] if at == first else []), *[quoted(c).alias(f"_also{i}") for i, c in enumerate(also)]]
    return df.select(*map(quoted, keep), *read).mapInArrow(run, out)
