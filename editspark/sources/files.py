"""Readers and writers of the file formats: case tables, shards, submissions, summaries."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .schemas import SHARD, TRAIN, without_nulls
from .scratch import _in_hadoop


def numbered(df: DataFrame, column: str = "row_idx") -> DataFrame:
    """Rows numbered from 0 in the order they were read, without gathering them in one task.

    Tasks' offsets are sums over as many rows as there are tasks; within a task the number is the position.
    """
    tagged = df.withColumn("_tag", F.monotonically_increasing_id())
    task, place = F.shiftright("_tag", 33), F.col("_tag").bitwiseAND((1 << 33) - 1)
    sizes = tagged.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return tagged.withColumn("_task", task).join(F.broadcast(sizes.select("_task", before.alias("_before"))), "_task").withColumn(column, F.col("_before") + place).drop("_tag", "_task", "_before")


def read_cases(spark: SparkSession, path: str, schema: T.StructType = TRAIN) -> DataFrame:
    """A CSV table of cases with a header: quoted cells may span lines, a leading byte-order mark is dropped, columns are matched by name.

    Adds ``row_idx``, the row's place in the file. Columns the file lacks and cells a row lacks are empty strings.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', nullValue="\x00", emptyValue="", encoding="UTF-8")
    # the reader folds line ends of records; those inside cells are folded here
    cells = {c: F.regexp_replace(F.col(f"`{c}`"), "\r\n?", "\n") for c in raw.columns}
    named = raw.select(*(cells[f.name].alias(f.name) if f.name in cells else F.lit(None).cast("string").alias(f.name) for f in schema))
    return numbered(without_nulls(named))


def parse_shard(lines: DataFrame, line: Column, ordinal: Column) -> DataFrame:
    """Records of JSON lines with their ``ordinal``; blank and malformed lines and lines without ``case_id`` are left out."""
    parsed = lines.select(ordinal.alias("ordinal"), F.from_json(line, SHARD).alias("r")).filter("r.case_id is not null")
    return parsed.select("r.*", "ordinal")


#: The folder of one append: its number says what came later, wherever and whenever the files are copied.
APPEND = "sequence="


def appends(spark: SparkSession, path: str) -> list[int] | None:
    """The numbers of a shard's appends in order; none for a file or a folder of other files; None if the shard doesn't exist."""
    files, folder = _in_hadoop(spark, path)
    if not files.exists(folder):
        return None
    names = [f.getPath().getName() for f in files.listStatus(folder) if f.isDirectory()]
    return sorted(int(n.removeprefix(APPEND)) for n in names if n.startswith(APPEND))


def read_shard(spark: SparkSession, path: str) -> DataFrame:
    """All records of a shard with ``ordinal``, in the order of writing: appends by number, then files by name, then lines; none if it doesn't exist.

    ``path`` is a folder of appends (``append_shard``), one file, or a folder of part files; files outside appends come before them. No time of a file is looked at, so a copied
    shard reads the same.
    """
    if appends(spark, path) is None:
        return spark.createDataFrame([], T.StructType([*SHARD.fields, T.StructField("ordinal", T.StringType())]))
    lines = spark.read.text(path, recursiveFileLookup=True).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
    number = F.coalesce(F.expr(f"try_cast(nullif(regexp_extract(file_path, '/{APPEND}([0-9]+)/[^/]*$', 1), '') AS bigint)"), F.lit(-1))
    place = F.format_string("%020d#%s#%020d#%020d", number + 1, F.substring_index("file_path", "/", -1), "file_block_start", "n")  # numbers rise within a block, which one task reads
    return parse_shard(lines, F.col("value"), place)


def last_records(records: DataFrame) -> DataFrame:
    """The last record of each ``case_id`` by ``ordinal``, with the ordinal of the first."""
    columns = [c for c in records.columns if c not in ("case_id", "ordinal")]
    last = F.max_by(F.struct(*columns, "ordinal"), "ordinal")
    return records.groupBy("case_id").agg(last.alias("last"), F.min("ordinal").alias("first_ordinal")).select("case_id", "last.*", "first_ordinal")


def append_shard(records: DataFrame, path: str) -> int:
    """Adds records as JSON lines under the next number, which is returned; the writer's commit makes an append's files appear whole or not at all.

    A number that another writer has taken meanwhile is left to it.
    """
    number = max(appends(records.sparkSession, path) or [0]) + 1
    while True:
        try:
            records.write.mode("errorifexists").json(f"{path}/{APPEND}{number:012d}")
            return number
        except AnalysisException as e:
            if e.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            number += 1


def compact_shard(spark: SparkSession, path: str, target: str, files: int = 1) -> None:
    """Writes the last record of each case of a shard, in the order of first appearance, as the first append of the new shard ``target``: ``files`` part files that follow each other."""
    last = last_records(read_shard(spark, path))
    columns = [f.name for f in SHARD]
    last.repartitionByRange(files, "first_ordinal").sortWithinPartitions("first_ordinal").select(*columns).write.mode("errorifexists").json(f"{target}/{APPEND}{1:012d}")


def write_submission(rows: DataFrame, path: str, one_file: bool = False) -> None:
    """``case_id, report`` in row order as CSV with quotes doubled: part files that follow each other in order, or, for a small table, one."""
    rows = rows.select("row_idx", "case_id", "report")
    rows = rows.repartitionByRange(1, "row_idx") if one_file else rows.repartitionByRange("row_idx")
    rows.sortWithinPartitions("row_idx").select("case_id", "report").write.mode("overwrite").csv(path, header=True, escape='"', quoteAll=False)


def write_summary(summary: DataFrame, path: str) -> None:
    """A one-row table as JSON."""
    summary.coalesce(1).write.mode("overwrite").json(path)
