"""A training corpus from documents: five stages, each on what the one before kept.

Languages (texts without a recognised language go), lines (those that repeat across documents go), near duplicates (one
document of each group stays), the benchmark (documents with its passages go), and tokens. SQL can't train a classifier,
so the pipeline has no SQL of its own and is tested against a plain version.

Defined cases, in every stage: columns besides doc_id and text stay as they are, whatever their names (``score``,
``kept``, ``items``, ...), in all stages but the last, which does not carry them; an empty table stays empty; rows that
repeat are documents each, and of near duplicates one row stays for each group (of rows with one doc_id the same number of
rows as have that doc_id); texts are read whole, however long. Null and empty texts have no language and go in the first
stage; a later stage that is given some keeps them (they have no lines, words or benchmark passages), and the last gives
them no ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm import bpe, decontaminate, lang_id, line_dedup, near_dup
from statloom.llm.common import fresh, read, store
from statloom.llm.queries import tokenizer


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = [c for c in docs.columns if c.lower() in ("lang_pred", "score")]  # the caller's columns of these names stay
    aside = dict(zip(own, fresh([*docs.columns, "lang_pred", "score"], *(f"own_{c}" for c in own)), strict=True))
    known = lang_id.predict(docs.withColumnsRenamed(aside), lang_id.train(docs), keep_columns=True)
    return known.where("lang_pred <> 'und'").select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(docs, line_dedup.build(docs), keep_columns=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_first(docs, near_dup.Settings(shingle=5, percent=80)).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.encode(docs.select("doc_id", "text"), tokenizer("byte_bpe_50k.json"), decoded="decoded")
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("languages", languages), ("lines", lines), ("near duplicates", near_duplicates), ("benchmark", benchmark), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
