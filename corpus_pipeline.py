"""A corpus pipeline of four operators: language identification, toxicity, near-duplicates and packing.

Each stage reads the table its predecessor wrote. All but the last keep the columns of ``documents`` and drop rows; the last
returns the pieces of what is left and their places in sequences.

Defined results: a null text is an empty one, which has no letter and goes in the first stage; texts of any length are worked on whole; rows that repeat a row are told apart by no stage but near-duplicates,
where one stays; rows without an id are never near-duplicates and go only by their texts; further columns, whatever their names, are handed on; of an empty table every stage makes an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editspark.llm import langid, neardup, packing, toxicity
from editspark.llm.common import fold, scratch, small_or_joined, written
from editspark.llm.queries import BYTE_BPE

#: SQL can't express trained classifiers and minwise joins; the stages are tested against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language isn't rejected: texts without letters and those whose calibrated score is below almost all of the sample's go."""
    model = langid.train(docs, fold(5) != 0)
    return langid.predict(docs, model, keep_rows=True).filter("not rejected").select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below the threshold of toxicity."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold(3) != 1)
    return toxicity.score(docs, model, keep_rows=True).filter("predicted = 0").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of least id. Of rows that repeat an id and its text the first as JSON stays; rows without an id all stay."""
    with scratch(spark) as kept:
        found = written(neardup.near_duplicates(docs), "found").filter("doc_id is not null")
        key = ["doc_id", "text_key"]
        gone = kept(found.filter("not stands").select(key).distinct(), "gone")
        again = kept(found.filter("stands").groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key), "again")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = neardup.keyed(docs.select("doc_id", "text", row.alias("row")), "row")
    left = small_or_joined(rows, gone, key, "left_anti")
    if again.isEmpty():
        return left.select("row.*")
    one = small_or_joined(left, again, key, "left_semi").groupBy(key).agg(F.min_by("row", F.to_json("row")).alias("row"))
    return small_or_joined(left, again, key, "left_anti").select("row.*").union(one.select("row.*"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2,048 tokens."""
    return packing.pack(docs, BYTE_BPE)


STAGES = [
    ("language identification", identify_language),
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
