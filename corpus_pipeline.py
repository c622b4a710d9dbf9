"""Corpus pipeline: toxicity filter, near-duplicate removal, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; a stage's rows are written as Parquet
and read back as the next one's docs. The first three return the columns of ``docs``, whatever they are; doc_id,
text and (where it is there) n_chars are the ones that they know. Rows are told apart by id and text, so rows
that share an id are judged each on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.llm.common import free_name, quoted, table, written
from lockstep.llm.jaccard_join import one_of_each
from lockstep.llm.packing import pack
from lockstep.llm.substring_dedup import dedup_substrings
from lockstep.llm.toxicity import THRESHOLD, fit, score_toxicity


#: Whole texts, and their bytes, that reach Python at once, and rows that a scan decodes at once, at most: Spark's own
#: 10,000, 64 MB and 4,096 rows of several KB fill an executor's heap and the memory beside it.
BATCH, BATCH_BYTES, SCANNED = 2000, 1 << 20, 512


def _in_batches(spark: SparkSession) -> None:
    for key, most in (("execution.arrow.maxRecordsPerBatch", BATCH), ("execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("parquet.columnarReaderBatchSize", SCANNED)):
        set_to = spark.conf.get(f"spark.sql.{key}").removesuffix("b")
        if not (set_to.isdigit() and 0 < int(set_to) <= most):
            spark.conf.set(f"spark.sql.{key}", str(most))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; the model learns from the rows of ``docs`` with a label.

    Null, empty and wordless texts get the score of the model without any word, about a half."""
    _in_batches(spark)
    model = fit(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "score")
    scored = score_toxicity(docs, model, docs.columns, into=score)
    return scored.filter(F.col(score) < THRESHOLD).select(*map(quoted, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of five-word shingle sets at a similarity of 0.8: that of the least id, null ids
    last. Exact copies that share an id are one, too. Rows without words are linked with nothing and stay."""
    _in_batches(spark)
    return one_of_each(docs, k=5, t=(4, 5))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that one of a smaller id, or they themselves before, hold.

    A text of which nothing but white space is left goes; n_chars follows the text."""
    _in_batches(spark)
    names = tuple(free_name(docs, n) for n in ("removed_spans", "removed_bytes", "first_ids"))
    cut = dedup_substrings(docs, into=names)
    touched, text = F.col(names[1]) > 0, F.col("text")
    kept = cut.filter(~touched | text.rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        kept = kept.withColumn("n_chars", F.when(touched, F.length(text).cast(kind)).otherwise(F.col("n_chars")))
    return kept.select(*map(quoted, docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's bucket, batch and slot."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("substring_dedup", repeated_passages), ("packing", packing)]
#: SQL can express neither the trained model nor the content-defined chunks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
