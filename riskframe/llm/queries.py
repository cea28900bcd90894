"""The registered queries of these operators: each applies one to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import (
    itq,
    lexicon,
    masked_lm,
    materialise,
    merkle,
    oracles,
    packing,
    permutation_index,
    quality,
    recompression,
    sharding,
    simhash,
    spelling,
    toxicity,
)
from riskframe.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_lexicon_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexicon.decode(lexicon.encode(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "utf-8"), 256).alias("decoded_sha256"))


@query
def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise.write(table(spark, sf_dir, "documents")).index


@query
def op3_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


@query
def op5_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shuffle(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=8, stable=True)
    text = F.coalesce("row.text", F.lit(""))
    return placed.select("row.doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
                         F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op6_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_masked_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return masked_lm.score(docs, masked_lm.train(docs))


@query
def op8_permutation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.search(table(spark, sf_dir, "embeddings"))


@query
def op9_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_itq_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.groups(table(spark, sf_dir, "embeddings"))


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


ORACLES["op11_spelling_variants"] = oracles.spelling()


@query
def op12_recompression_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.removed(table(spark, sf_dir, "documents")).drop("ranges")


ORACLES["op12_recompression_cut"] = oracles.repeated_windows()


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


ORACLES["op13_merkle_manifest"] = oracles.merkle()
