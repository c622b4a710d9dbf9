"""External programs as tasks: rows go to a program's standard input as lines and come back from its output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def piped(df: DataFrame, command: str, key: str = "key", value: str = "value", separator: str = "\t") -> DataFrame:
    """(key, value) lines that ``command`` makes of each partition's (key, value) lines; a program that
    fails fails its task, which Spark runs again."""
    lines = df.select(F.concat_ws(separator, F.col(key).cast("string"), F.col(value).cast("string"))).rdd.map(lambda r: r[0])
    out = lines.pipe(command, checkCode=True).map(lambda line: (line,))
    from ..sources.text import key_values

    return key_values(df.sparkSession.createDataFrame(out, "value string"), separator)


def owner_by_program(df: DataFrame, command: str, n: int, key: str = "key") -> DataFrame:
    """``df`` with the peer that ``command`` names for each key, one line each, distinct keys only."""
    keys = df.select(key).distinct()
    rows = keys.rdd.map(lambda r: r[0]).mapPartitions(_owners(command))
    owners = df.sparkSession.createDataFrame(rows, f"{key} {dict(df.dtypes)[key]}, owner long")
    return df.join(owners, key).withColumn("peer", F.pmod("owner", F.lit(n)).cast("int")).drop("owner")


def _owners(command: str):
    def run(keys):
        import shlex
        import subprocess

        held = list(keys)
        said = subprocess.run(shlex.split(command), input="".join(f"{k}\n" for k in held), text=True, capture_output=True, check=True).stdout.split()
        return zip(held, map(int, said), strict=True)

    return run
