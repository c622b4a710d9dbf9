"""Where loops put what they have: the folder that the driver and all executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. A session in one process without it gets its own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[[^-\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints/lockstep")
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def written(df: DataFrame, name: str = "step", path: str | None = None) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back: a plan without history, which no later stage works
    out again and which survives lost executors. What a named ``path`` held, as from a run that is resumed before
    it, is replaced."""
    place = path or f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite" if path else "error").parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def discard(df: DataFrame) -> None:
    """Deletes the files of what ``written`` gave, when no plan that is still to run reads them."""
    spark = df.sparkSession
    for place in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dealt(df: DataFrame, name: str, key: str, together: bool = False) -> DataFrame:
    """As ``written``, in as many buckets by ``key`` as shuffles have partitions, sorted in each: joins and groups by
    ``key`` read it as it lies. ``together``: the rows come dealt by ``key`` in that number already."""
    spark = df.sparkSession
    n, own = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{re.sub('[^a-z]', '_', name)}_{uuid.uuid4().hex}"
    rows = df if together else df.repartition(n, key)
    rows.write.format("parquet").bucketBy(n, key).sortBy(key).option("path", f"{shared_dir(spark)}/{own}").saveAsTable(own)
    out = spark.table(own)
    spark.sql(f"DROP TABLE {own}")  # the files stay
    return out
