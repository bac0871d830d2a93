"""A training-corpus pipeline over ``documents``: drop toxic rows, keep one of each group of near copies, drop rows that overlap
with the benchmark, redact personal data, pack what is left into sequences. Each stage reads what its predecessor wrote.

Every stage treats a null text as an empty one (and leaves it null), reads texts of any length whole, passes other columns through
whatever their names, and makes an empty table of an empty one. Ids may be null or repeat: toxicity and decontamination judge each row
by its own text (rows that are equal in id and text share a verdict, told by a 64-bit hash of both), the Jaccard join treats rows of
one id as one document and a row without an id as a document of its text.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave.llm import pii
from codeweave.llm.common import small_batches
from codeweave.llm.decontaminate import contaminations
from codeweave.llm.jaccard_join import jaccard_components
from codeweave.llm.packing import pack
from codeweave.llm.registry import labels, toxicity_model
from codeweave.llm.toxicity import toxicity
from codeweave.plans.joins import dealt_join
from codeweave.session import discard, materialize

#: Words that a packing worker remembers twice over: fewer than alone, as the stages before have used the same workers.
WORD_CACHE = 150_000
#: Rows of text that are sent to a worker at once: few, as all stages share the workers' memory.
BATCH_ROWS = 500
#: Ids that are joined by broadcast, at most (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def in_small_batches(stage):
    """The stage with few rows of text a batch in all that it runs; what it returns holds no Python that reads texts."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with small_batches(spark, BATCH_ROWS):
            return stage(spark, docs, sf_dir)

    return run


#: The column that tells rows apart inside a stage.
KEY = "_pipeline_row"


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a hash of id and text as KEY."""
    return docs.withColumn(KEY, F.xxhash64(F.col("doc_id").cast("long"), F.col("text")))


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, text) for an operator, with KEY in place of the id."""
    return keyed(docs).select(F.col(KEY).alias("doc_id"), "text")


def without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs but for the rows whose KEY is a doc_id of found, which comes from ``judged`` rows."""
    ids = materialize(found.select(F.col("doc_id").alias(KEY)).distinct(), "ids")
    if ids.count() <= BROADCAST_IDS:
        return keyed(docs).join(F.broadcast(ids), KEY, "left_anti").select(docs.columns)
    return dealt_join(keyed(docs), ids, [KEY], "left_anti").select(docs.columns)


@in_small_batches
def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the grammar accepts; a row goes if its score is 0.3 or more. Repeated rows go or stay together."""
    scored = toxicity(judged(docs), toxicity_model(docs, labels(spark, sf_dir)))
    return without(docs, scored.where("score >= 0.3"))


@in_small_batches
def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of the Jaccard join, as one row: the least of those that repeat its id.

    A row without an id is a document too, named by a hash of its text that is larger than any id in use, so it gives way to others.
    """
    name = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND((1 << 62) - 1) + (1 << 62))
    named = docs.withColumn(KEY, name)
    others = materialize(jaccard_components(named.select(F.col(KEY).alias("doc_id"), "text")).where("doc_id <> component_id").select(F.col("doc_id").alias(KEY)), "others")
    few = others.count() <= BROADCAST_IDS
    rows = named.join(F.broadcast(others), KEY, "left_anti") if few else dealt_join(named, others, [KEY], "left_anti")
    twice = materialize(rows.groupBy(KEY).agg(F.count("*").alias("rows")).where("rows > 1").select(KEY), "twice")
    if not twice.limit(1).count():
        return rows.select(docs.columns)
    again = F.broadcast(twice) if twice.count() <= BROADCAST_IDS else twice
    single = rows.join(again, KEY, "left_semi").groupBy(KEY).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return rows.join(again, KEY, "left_anti").select(docs.columns).unionByName(single.select("row.*"))


@in_small_batches
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a verified overlap with a benchmark item. Repeated rows go or stay together."""
    return without(docs, contaminations(judged(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


@in_small_batches
def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, repeated ones too, with personal data in the text replaced by its kind; n_chars follows the text."""
    new = pii.redacted(docs, pii.fit(docs))
    if "n_chars" in new.columns:
        new = new.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return materialize(new, "private")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all rows, repeated ones too, placed in sequences."""
    return pack(docs, cache=WORD_CACHE)


STAGES = [
    ("toxicity", clean),
    ("n-gram Jaccard join", distinct),
    ("benchmark decontamination", decontaminated),
    ("PII", private),
    ("best-fit packing", packed),
]

#: Learned models and tokenization are beyond SQL; tests/llm compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            done = materialize(done, "stage")
        if k:
            discard(docs)
        docs = done
    return docs
