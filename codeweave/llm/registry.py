"""The queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave.llm import jaccard_join, langid, pii, tiff, warc
from codeweave.llm.common import documents, keyed_remainder
from codeweave.llm.context_tree import corpus_scores
from codeweave.llm.decontaminate import contaminations
from codeweave.llm.jaccard_join import jaccard_components
from codeweave.llm.packing import pack
from codeweave.llm.quality import fit as fit_quality
from codeweave.llm.quality import quality
from codeweave.llm.toxicity import fit as fit_toxicity
from codeweave.llm.toxicity import labelled_sample, toxicity
from codeweave.session import materialize

#: Labelled rows of either class that a classifier is fitted on, at most.
TOXIC_SAMPLE = 2000
QUALITY_SAMPLE = 1500
#: Rows a language that the language model is fitted on, at most.
LANGUAGE_SAMPLE = 300


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = materialize(tiff.stored_texts(documents(spark, sf_dir)), "media")
    return tiff.text_features(tiff.pages(media))


def op2_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_scores(documents(spark, sf_dir).withColumn("train", keyed_remainder("doc_id", 5) != 1))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archive(spark, warc.write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(*langid.labelled_texts(docs, "crc32(cast(doc_id as string)) % 3 <> 1", LANGUAGE_SAMPLE))
    held = F.coalesce(keyed_remainder("doc_id", 3) == 1, F.lit(False))
    return langid.languages(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.personal_data(docs, pii.fit(docs))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    params = fit_quality(*labelled_sample(docs, labels(spark, sf_dir), "quality", "crc32(cast(doc_id as string)) % 5 <> 0", QUALITY_SAMPLE))
    held = F.coalesce(keyed_remainder("doc_id", 5) == 0, F.lit(False))
    return quality(docs, params).select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def toxicity_model(docs: DataFrame, marked: DataFrame) -> dict:
    return fit_toxicity(*labelled_sample(docs, marked, "toxic", "crc32(cast(doc_id as string)) % 4 <> 2", TOXIC_SAMPLE))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = toxicity(docs, toxicity_model(docs, labels(spark, sf_dir)))
    held = F.coalesce(keyed_remainder("doc_id", 4) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"), "clauses")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_tiff": op1_tiff,
        "op2_context_tree": op2_context_tree,
        "op3_warc": op3_warc,
        "op4_language_id": op4_language_id,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_pii": op6_pii,
        "op7_quality": op7_quality,
        "op8_decontaminate": op8_decontaminate,
        "op9_toxicity": op9_toxicity,
        "op10_jaccard_join": op10_jaccard_join,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": warc.ORACLE_SQL, "op10_jaccard_join": jaccard_join.ORACLE_SQL}
