"""A training corpus from documents: each stage takes what its predecessor kept and gives documents back,
the last one packed sequences. Only doc_id and text are required columns; n_chars is kept up to date where it exists.

Rows with a null doc_id are judged like all others, under a key made from their text that follows all ids: equal ones are
copies of each other, and of a group of near duplicates they stay only if no row with an id does. Different texts of one id are
judged apart, all but one of them under such keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, jaccard_join, language_id, packing, substring_dedup
from tidemark.llm.common import discard, free_name, read_table, scratch
from tidemark.llm.queries import vocabulary


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key that is never null and that different texts don't share, and its name: the id, but for null ids and for
    all texts of an id but one a number made from the text that follows all ids."""
    key, text, first = (free_name(docs, name) for name in ("row_key", "text_hash", "first_hash"))
    made = F.lit(1 << 62) + F.pmod(F.xxhash64(F.col("text").cast("string")), F.lit(1 << 61))
    number = F.col("doc_id").cast("long")
    ids = docs.select(number.alias(key)).filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").select(key)
    if ids.isEmpty():  # no text is read for this
        return docs.withColumn(key, F.coalesce(number, made)), key
    hashes = docs.select(number.alias(key), F.xxhash64("text").alias(text)).join(ids, key, "left_semi")
    firsts = hashes.groupBy(key).agg(F.min(text).alias(first))
    rows = docs.withColumn(key, number).join(firsts, key, "left")
    own = F.col(key).isNotNull() & (F.col(first).isNull() | (F.xxhash64("text") == F.col(first)))
    return rows.withColumn(key, F.when(own, F.col(key)).otherwise(made)).select(*docs.columns, key), key


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter go, and those with n-grams of which none is known."""
    model = language_id.learn(language_id.training_rows(docs))
    if not model.languages:  # nothing is labelled, so nothing is known to be foreign
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    predicted = language_id.predict(docs, model, keep=tuple(docs.columns), names=(lang, score))
    return predicted.filter((F.col(lang) != language_id.NONE) & (F.col(score) > 0)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest doc_id, once."""
    rows, key = keyed(docs)
    first = jaccard_join.near_duplicates(rows, doc_id=key).filter("doc_id = class_id").select(F.col("doc_id").alias(key)).distinct()
    text = free_name(rows, "text_hash")
    kept = rows.join(first, key, "left_semi").withColumn(text, F.xxhash64("text")).dropDuplicates([key, text])
    return kept.select(docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words and more that an earlier document has."""
    rows, key = keyed(docs)
    left = substring_dedup.cut(rows, substring_dedup.repeated_passages(rows, doc_id=key), doc_id=key).select(docs.columns)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    rows, key = keyed(docs)
    found = decontamination.find(rows, read_table(spark, sf_dir, "benchmark"), doc_id=key).select(F.col("doc_id").alias(key)).distinct()
    return rows.join(found, key, "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of at most 2048 tokens."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), 2048)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("substrings", substrings), ("decontamination", decontaminate), ("packing", pack)]

#: SQL can't express n-gram models, min-hashes or the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, stored = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as keep:  # a stage's own tables go with it, and its input once its result is stored
            docs = keep(stage(spark, docs, sf_dir), name)
        if stored is not None:
            discard(stored)
        stored = docs
    return docs
