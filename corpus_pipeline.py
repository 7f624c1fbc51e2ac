"""From raw documents to token ids: quality rules, language, near duplicates, mixture, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaops.llm import bpe, langid, mixing, quality, simhash
from mediaops.llm.common import shielded
from mediaops.llm.queries import vocabulary
from mediaops.session import materialise

#: Ridge score below which a text is in none of the learned languages.
MIN_LANGUAGE_SCORE = 0.2


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. The line model is fitted on the labelled ones. Null and empty texts go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels)
    rows, back = shielded(docs, "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept content_share")
    return back(quality.judge(rows, model).where("kept"))


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be learned from the others' ``lang``; texts without a letter and those far from
    all languages go. ``lang`` itself stays as it is."""
    model = langid.fit(docs)
    rows, back = shielded(docs, "lang_pred score")
    found = langid.predict(rows, model)
    return back(found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest ``doc_id``. Shingles of five words."""
    return simhash.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that all sources hold the same bytes on average, in shuffled order."""
    rows, back = shielded(docs, "repeats copy mix_key")
    return back(mixing.replicate(rows))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids`` of every document left."""
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary())
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", good_texts),
    ("language", known_languages),
    ("near_duplicates", one_of_each),
    ("mixture", mixture),
    ("tokens", token_ids),
]

#: Viterbi decoding and ridge scores are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each over what the one before kept, written and read again in between."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
