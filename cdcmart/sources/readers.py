"""Where change rows come from: Kafka, files, a JDBC snapshot, a stored changelog."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cdcmart.functions.derive import derive
from cdcmart.sources.envelope import TO_TYPED
from cdcmart.sources.schemas import TABLES


def read_changes(
    spark: SparkSession,
    table: str,
    bootstrap_servers: str,
    topic_prefix: str,
    starting_offsets: str = "earliest",
    **options: str,
) -> DataFrame:
    """Stream of raw messages of one table, one topic and consumer per table.

    ``minPartitions`` may be passed to split a topic with few partitions over
    more tasks. Needs the Kafka connector on the classpath.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", bootstrap_servers)
        .option("subscribe", f"{topic_prefix}.{TABLES[table].topic}")
        .option("startingOffsets", starting_offsets)
    )
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load().select(
        F.col("value").cast("string").alias("value"), "topic", "partition", "offset", "timestamp"
    )


def read_change_files(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of raw messages from text files, one message per line."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def read_snapshot(
    spark: SparkSession,
    table: str,
    jdbc: dict[str, str],
    partition_column: str | None = None,
    lower_bound: str | None = None,
    upper_bound: str | None = None,
    partitions: int = 64,
    version: int = 0,
) -> DataFrame:
    """The initial snapshot of a source table, read in parallel ranges.

    Rows carry ``version`` (the log position at which the snapshot was taken),
    so ``unionByName`` with the live changes gives one changelog.
    """
    reader = spark.read.format("jdbc").options(**jdbc)
    if partition_column:
        reader = reader.options(
            partitionColumn=partition_column,
            lowerBound=lower_bound,
            upperBound=upper_bound,
            numPartitions=str(partitions),
        )
    return snapshot_rows(reader.load(), table, version)


def snapshot_rows(rows: DataFrame, table: str, version: int = 0) -> DataFrame:
    """Give plain source rows the shape of change rows; absent text is ''."""
    spec = TABLES[table]
    typed = [TO_TYPED[kind](F.col(name).cast("string")).alias(name) for name, kind in spec.columns.items()]
    return derive(
        rows.select(*typed, F.lit(version).cast("bigint").alias("_version"), F.lit(False).alias("_is_deleted")),
        table,
    )


def read_changelog(
    spark: SparkSession, path: str, table: str, since: date | None = None, until: date | None = None
) -> DataFrame:
    """A stored changelog; ``since``/``until`` prune whole month partitions.

    The month column of a table never changes for a key, so pruning by month
    before the newest version is picked cannot resurrect an old version. Rows
    whose timestamp was unreadable sit in month 197001 and are always read. The
    schema is the declared one, so no file is opened to find it out, and a table
    nothing was written to yet is empty.
    """
    declared = f"{TABLES[table].stored_ddl()}, month int, batch_id string"
    if not folder_exists(spark, path):
        return spark.createDataFrame([], declared).drop("month", "batch_id")
    df = spark.read.schema(declared).parquet(path)
    if TABLES[table].month_column:
        unreadable = F.col("month") == 197001
        if since:
            df = df.where((F.col("month") >= int(since.strftime("%Y%m"))) | unreadable)
        if until:
            df = df.where((F.col("month") <= int(until.strftime("%Y%m"))) | unreadable)
    return df.drop("month", "batch_id")


def folder_exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def files_below(spark: SparkSession, path: str) -> tuple[int, int]:
    """Number and bytes of the Parquet files of a table."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(folder, True)
    sizes = []
    while listed.hasNext():
        status = listed.next()
        if not status.getPath().getName().startswith(("_", ".")):
            sizes.append(status.getLen())
    return len(sizes), sum(sizes)


def date_series(spark: SparkSession, first: date | str, last: date | str) -> DataFrame:
    """One row per calendar day, both ends included."""
    return spark.range(1).select(
        F.explode(F.sequence(F.lit(str(first)).cast("date"), F.lit(str(last)).cast("date"))).alias("snapshot_date")
    )


def time_filter(df: DataFrame, column: str, low, high) -> DataFrame:
    """Rows whose ``column`` lies between two bounds, ends included."""
    return df.where(F.col(column).between(F.lit(low).cast("timestamp"), F.lit(high).cast("timestamp")))
