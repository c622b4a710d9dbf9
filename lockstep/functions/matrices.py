"""Matrices as frames of cells (i, j, x); an absent cell is 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def from_rows(rows: DataFrame, row: str = "row", vec: str = "vec") -> DataFrame:
    return rows.select(F.col(row).cast("long").alias("i"), F.posexplode(vec).alias("j", "x")).select("i", F.col("j").cast("long").alias("j"), F.col("x").cast("double").alias("x"))


def to_rows(cells: DataFrame, columns: int) -> DataFrame:
    """(row, vec) of the rows that have cells."""
    got = cells.groupBy(F.col("i").alias("row")).agg(F.map_from_entries(F.collect_list(F.struct("j", "x"))).alias("_m"))
    wide = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(columns - 1).cast("long")), lambda j: F.coalesce(F.element_at("_m", j), F.lit(0.0)))
    return got.select("row", wide.alias("vec"))


def eye(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("x"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "x")


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Matrix product: one join on the inner index, sums combined before the shuffle."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("x").alias("_a")), b.select(F.col("i").alias("k"), "j", F.col("x").alias("_b"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("x"))


def multiply_vector(a: DataFrame, v: DataFrame) -> DataFrame:
    """``v``: cells (j, x). Gives (i, x)."""
    return a.join(v.select("j", F.col("x").alias("_v")), "j").groupBy("i").agg(F.sum(F.col("x") * F.col("_v")).alias("x"))


def cellwise(a: DataFrame, b: DataFrame, f, default: float = 0.0) -> DataFrame:
    """f(a, b) over the cells of either, an absent one being ``default``."""
    joined = a.select("i", "j", F.col("x").alias("_a")).join(b.select("i", "j", F.col("x").alias("_b")), ["i", "j"], "full_outer")
    return joined.select("i", "j", f(F.coalesce("_a", F.lit(default)), F.coalesce("_b", F.lit(default))).alias("x"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return cellwise(a, b, lambda x, y: x + y)


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return cellwise(a, b, lambda x, y: x - y)


def multiply_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("i", "j", F.col("x").alias("_b")), ["i", "j"]).select("i", "j", (F.col("x") * F.col("_b")).alias("x"))


def divide_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("i", "j", F.col("x").alias("_b")), ["i", "j"]).select("i", "j", F.try_divide("x", "_b").alias("x"))


def map_cells(a: DataFrame, f) -> DataFrame:
    """f over the stored cells: scalar add, subtract, multiply, divide and powers."""
    return a.select("i", "j", f(F.col("x")).alias("x"))


def subtract_vector(a: DataFrame, v: DataFrame) -> DataFrame:
    """Takes the vector (j, x) from each row."""
    return a.join(v.select("j", F.col("x").alias("_v")), "j", "left").select("i", "j", (F.col("x") - F.coalesce("_v", F.lit(0.0))).alias("x"))


def divide_vector(a: DataFrame, v: DataFrame) -> DataFrame:
    return a.join(v.select("j", F.col("x").alias("_v")), "j").select("i", "j", F.try_divide("x", "_v").alias("x"))


def part(a: DataFrame, rows: tuple[int, int], columns: tuple[int, int]) -> DataFrame:
    """Cells of half-open ranges, counted from 0 again."""
    held = a.filter(F.col("i").between(rows[0], rows[1] - 1) & F.col("j").between(columns[0], columns[1] - 1))
    return held.select((F.col("i") - rows[0]).alias("i"), (F.col("j") - columns[0]).alias("j"), "x")


def row(a: DataFrame, i: int) -> DataFrame:
    return a.filter(F.col("i") == i).select("j", "x")


def column(a: DataFrame, j: int) -> DataFrame:
    return a.filter(F.col("j") == j).select("i", "x")


def with_column_set(a: DataFrame, j: int, values: DataFrame) -> DataFrame:
    """Column j replaced by the cells (i, x)."""
    return a.filter(F.col("j") != j).unionByName(values.select("i", F.lit(j).cast("long").alias("j"), "x"))


def column_stats(a: DataFrame) -> DataFrame:
    return a.groupBy("j").agg(F.max("x").alias("most"), F.min("x").alias("least"), F.sum("x").alias("total"))


def total(a: DataFrame) -> DataFrame:
    return a.agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("x"))


def error(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum of the absolute differences of the cells."""
    return subtract(a, b).agg(F.coalesce(F.sum(F.abs("x")), F.lit(0.0)).alias("x"))


def split_last_column(rows: DataFrame, vec: str = "vec") -> DataFrame:
    """features and label of row vectors."""
    v = F.col(vec)
    return rows.withColumns({"features": F.slice(v, 1, F.size(v) - 1), "label": F.element_at(v, -1)})


def split_random(rows: DataFrame, share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Two parts by a hash of the row number, the same at each run and layout."""
    low = F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(1 << 30)) < int(share * (1 << 30))
    return rows.filter(low), rows.filter(~low)


def sparse_times_vector(rows: DataFrame, vector: list[float] | DataFrame) -> DataFrame:
    """(row, x) of sparse rows (row, idx, val, size) times a vector: a list that fits a plan, else (j, x).

    A row whose size is not the vector's is an error."""
    if isinstance(vector, list):
        from .vectors import sparse_dot

        held = F.array(*[F.lit(float(x)) for x in vector])
        bad = F.raise_error(F.lit("matrix and vector differ in size"))
        return rows.select("row", F.when(F.col("size") == len(vector), sparse_dot(F.col("idx"), F.col("val"), held)).otherwise(bad).alias("x"))
    n = vector.agg(F.max("j") + 1).first()[0] or 0
    checked = rows.withColumn("idx", F.when(F.col("size") >= n, F.col("idx")).otherwise(F.raise_error(F.lit("matrix and vector differ in size"))))
    cells = checked.select("row", F.explode(F.arrays_zip("idx", "val")).alias("_c")).select(F.col("row").alias("i"), F.col("_c.idx").cast("long").alias("j"), F.col("_c.val").alias("x"))
    got = multiply_vector(cells, vector)
    return rows.select("row").join(got.withColumnRenamed("i", "row"), "row", "left").select("row", F.coalesce("x", F.lit(0.0)).alias("x"))


def top_of_rows(a: DataFrame, n: int, by: Column | None = None) -> DataFrame:
    """The n greatest cells of each row, ties to the smaller column."""
    order = Window.partitionBy("i").orderBy((by if by is not None else F.col("x")).desc(), "j")
    return a.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
