"""A kept retrieval index that grows batch by batch: documents are tokenised when they are added and never again.

Under a folder stand three Parquet tables, each partitioned by ``batch``: ``documents`` (``id, length, tokens``, each distinct token with its count), ``postings``
(``token, id, tf, length``, partitioned by ``bucket`` of the token as well and sorted by token) and ``statistics`` (``token, df`` of the batch, and a row without a token for
its number of documents and tokens). A reader adds the batches' statistics up, so that adding documents equals building the index anew.

``add`` writes a batch's tables over whatever stands under its number, statistics last, and readers take the batches that have statistics: a batch that failed is
invisible until it is written again. Documents whose id another batch has are left out, so a file that is delivered twice changes nothing; of an id's several texts in a batch the one of
least hash is taken. Null texts are empty; rows without an id are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as C
from ..functions.text import counted_tokens, text_or_empty, words_of
from ..sources.scratch import scratch, small_or_joined, written

BUCKETS = 64
TABLES = ("documents", "postings", "statistics")


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def _schemas(id_type: T.DataType) -> dict[str, T.StructType]:
    s, n = T.StringType(), T.LongType()
    counts = T.ArrayType(T.StructType([T.StructField("word", s), T.StructField("tf", n)]))
    named = {
        "documents": {"id": id_type, "length": n, "tokens": counts},
        "postings": {"token": s, "id": id_type, "tf": n, "length": n, "bucket": T.IntegerType()},
        "statistics": {"token": s, "df": n, "length": n},
    }
    return {table: T.StructType([T.StructField(k, v) for k, v in [*columns.items(), ("batch", n)]]) for table, columns in named.items()}


def table(spark: SparkSession, path: str, name: str, id_type: T.DataType | None = None) -> DataFrame:
    """One of ``TABLES`` over all batches that are there in full; without rows if there is no index."""
    schema = _schemas(id_type or T.LongType())[name]
    if not _exists(spark, f"{path}/statistics"):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(f"{path}/{name}")
    if name == "statistics":
        return rows
    whole = table(spark, path, "statistics").filter("token is null").select("batch")
    return rows.join(F.broadcast(whole), "batch", "left_semi")  # a row a batch


def bucket_of(token: str, buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def add(rows: DataFrame, path: str, batch: int, buckets: int = BUCKETS) -> int:
    """Adds the documents of ``rows(id, text)`` that no other batch has as batch ``batch``, and says how many."""
    spark = rows.sparkSession
    id_type = rows.schema["id"].dataType
    with scratch(spark):
        ids = rows.filter("id is not null").groupBy("id").agg(F.count("*").alias("n"))
        known = table(spark, path, "documents", id_type).filter(F.col("batch") != batch).select("id")
        fresh = written(ids.join(known, "id", "left_anti"), "fresh")
        new = small_or_joined(rows.select("id", text_or_empty(F.col("text")).alias("text")), fresh, "id", "inner")
        several = fresh.filter("n > 1")
        if not several.isEmpty():
            one = new.filter("n > 1").groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
            new = new.filter("n = 1").select("id", "text").union(one)
        folder = {t: f"{path}/{t}/batch={batch}" for t in TABLES}
        held = new.select("id", counted_tokens(F.col("text")).alias("tokens")).select("id", words_of("tokens").alias("length"), "tokens")
        held.write.mode("overwrite").parquet(folder["documents"])
        held = spark.read.schema(held.schema).parquet(folder["documents"])
        each = held.select("id", "length", F.explode("tokens").alias("w")).select(F.col("w.word").alias("token"), "id", "w.tf", "length").withColumn("bucket", bucket_of("token", buckets))
        # a bucket with a token that most documents have is dealt to several tasks
        each.hint("rebalance", "bucket").sortWithinPartitions("bucket", "token", "id").write.mode("overwrite").partitionBy("bucket").parquet(folder["postings"])
        df = each.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("length"))
        total = held.agg(F.lit(None).cast("string").alias("token"), F.count("*").alias("df"), F.coalesce(F.sum("length"), F.lit(0)).alias("length"))
        df.union(total).write.mode("overwrite").parquet(folder["statistics"])
        return fresh.count()


def statistics(spark: SparkSession, path: str) -> DataFrame:
    """``token, df, idf`` over all documents; negative idfs are replaced by ``EPSILON`` times the mean over all tokens."""
    both = table(spark, path, "statistics").groupBy("token").agg(F.sum("df").alias("df"))
    n = both.filter("token is null").select(F.col("df").alias("n"))
    raw = both.filter("token is not null").join(F.broadcast(n), F.lit(True)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean), F.lit(True)).select("token", "df", F.when(F.col("raw") < 0, C.EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))  # one row each


def mean_length(spark: SparkSession, path: str) -> float:
    at = table(spark, path, "statistics").filter("token is null").agg(F.sum("df").alias("n"), F.sum("length").alias("length")).first()
    return at.length / at.n if at.n and at.length else 1.0
