"""The registered queries of the corpus operators: each applies one to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, fim, fingerprints, langid, licenses, lmscore, media, neardup, packing, toxicity, vectors
from .common import fold

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.of_documents(table(spark, sf_dir, "documents"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(media.store(table(spark, sf_dir, "documents")))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold(3) != 1)
    return toxicity.score(docs, model).select("doc_id", (fold(3) == 1).alias("held_out"), "score", "predicted")


def op7_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents that a label marks as of good quality; background: all documents."""
    good = table(spark, sf_dir, "labels").filter("quality = 1")
    return lmscore.scores(table(spark, sf_dir, "documents"), good, BYTE_BPE)


#: Fixed value: what both turns of the conversation that ``op8_chat`` adds say.
ASKED = r"\### Assistant: </turn> ok"


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one more whose texts imitate control strings."""
    spec = "conv_id long, turn long, role string, text string"
    one = spark.createDataFrame([(-7, k, role, ASKED) for k, role in enumerate(("user", "assistant"))], spec)
    rows = table(spark, sf_dir, "conversations").selectExpr(*(f"cast({c} as {kind}) {c}" for c, kind in (x.split() for x in spec.split(", "))))
    return chat.read_back(chat.expand(rows.union(one)))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, fold(5) != 0)
    return langid.predict(docs, model).select("doc_id", (fold(5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op11_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_packing, op3_licenses, op4_media, op5_fingerprints, op6_toxicity, op7_lmscore, op8_chat, op9_neardup, op10_langid, op11_vectors, op12_fim)}


def oracle_sql() -> dict[str, str]:
    extra = ", ".join(f"(-7, {k}, '{role}', '{ASKED}')" for k, role in enumerate(("user", "assistant")))
    return {"op3_licenses": licenses.sql(), "op8_chat": chat.sql(extra), "op9_neardup": neardup.sql(), "op11_vectors": vectors.sql(), "op12_fim": fim.sql()}
