"""Exact deduplication by a stateful stream.

Documents become fingerprint rows: digest of the normalised text, stable id, content locator (file and
row within the file, as the scan tells them). A stream reads those rows in bounded micro-batches and
keeps, per digest and for ever, the smallest id with its locator and the number of rows seen. The state
lives in RocksDB files and its checkpoint in the shared folder, so a lost executor reloads it. Equal
rows combine before the shuffle, hence a text that a third of the rows share costs one state update per
task and batch.

A digest hit is only a candidate. The locators of all rows whose digest was hit, in whatever batch, are
looked up in the documents again, and only the texts found there are compared in full; texts that merely
share a digest are told apart. So texts are read twice, but none leaves its task unless it was hit.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumenmart.llm.common import BLANK, plain, scratch, stage, tune

STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # no space reserved ahead of the logs: there is one store per shuffle partition
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Least number of micro-batches. A batch takes as many fingerprint files as the cluster has cores, and a file
#: the rows of at most so many scan tasks; where there are more, more batches follow.
BATCHES, SCANS_PER_FILE = 4, 32
#: Bits that mark the locators of hits: bitmaps of 16 MB at most. A false hit has its text compared in vain.
MARK_BITS = 27


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def normalised(text: Column) -> Column:
    """Each run of blanks as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, " ")


def sha256(full: Column) -> Column:
    return F.unhex(F.sha2(full, 256))


def located(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, file, row: where the scan finds each row. Rows that are no plain scan of files are written first."""

    def read(frame: DataFrame) -> DataFrame:
        meta = frame.metadataColumn("_metadata")
        own = frame.select(id_col, text_col, meta["file_path"].alias("_file"), meta["row_index"].alias("_row"))
        return own.select(
            F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
            F.col("_file").alias("file"), F.col("_row").alias("row"))

    try:
        found = read(docs)
        found.schema  # noqa: B018 - resolved here, where a frame without files shows
        return found
    except AnalysisException:
        return read(stage(plain(docs, id_col, text_col).select(F.col("doc_id").alias(id_col), F.col("text").alias(text_col))))


def fingerprints(rows: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Digest and locator (with the id in front) of every row of `located`. Null ids come after all others."""
    return rows.select(
        digest(normalised(F.col("text"))).alias("digest"),
        F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row").alias("locator"),
    )


def state_log(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Run the stateful stream over a folder of fingerprint files; digest, smallest locator, row count.

    The state has no expiry. Each batch appends the digests it touched, replays overwrite their own
    batch, and the newest row per digest is the one with the largest count.
    """
    log, checkpoint = scratch(spark, "dedup-log"), scratch(spark, "dedup-state")
    schema = spark.read.parquet(folder).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    state = reader.parquet(folder).groupBy("digest").agg(F.min("locator").alias("first"), F.count(F.lit(1)).alias("n"))

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")

    with _settings(spark, STATE_SETTINGS):
        query = (
            state.writeStream.outputMode("update").foreachBatch(append)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    ran = query.lastProgress is not None
    found = spark.read.schema(state.schema).parquet(f"{log}/batch=*") if ran else spark.createDataFrame([], state.schema)
    return found.groupBy("digest").agg(F.min("first").alias("first"), F.max("n").alias("n"))


def _mark() -> Column:
    return F.pmod(F.xxhash64("file", "row"), F.lit(1 << MARK_BITS))


def fetched(rows: DataFrame, locators: DataFrame) -> DataFrame:
    """The rows of `located` at the given locators (file, row), and a few others where marks collide.

    The marks of all locators are bitmaps of a fixed total size, so they go to every scan task and no text
    has to move to be found.
    """
    marks = locators.select(F.bitmap_bucket_number(_mark()).alias("bucket"), F.bitmap_bit_position(_mark()).alias("place"))
    bitmaps = F.broadcast(stage(marks.groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits"))))
    place = F.bitmap_bit_position(_mark())
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = rows.withColumn("bucket", F.bitmap_bucket_number(_mark())).join(bitmaps, "bucket")
    return marked.where(F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1).select(*rows.columns)


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files_per_batch: int | None = None, digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (the digest in hexadecimal).

    Texts are equal when identical after blanks are normalised; null counts as empty, and empty texts
    are one group. The smallest id stays; null ids count as larger than any other; where rows repeat
    the smallest id, exactly one of them stays (the first by file and row). An empty table gives no rows.
    """
    spark = tune(docs.sparkSession)
    found = located(docs, id_col, text_col)
    folder = scratch(spark, "dedup-fingerprints")
    per_batch = files_per_batch or max(8, spark.sparkContext.defaultParallelism)
    prints = fingerprints(found, digest)
    prints.repartition(max(BATCHES * per_batch, -(-prints.rdd.getNumPartitions() // SCANS_PER_FILE))).write.parquet(folder)
    rows = spark.read.parquet(folder)
    state = state_log(spark, folder, per_batch)
    grouped = stage(rows.join(state, "digest").select("digest", "locator", "first", "n"))
    hits = grouped.where("n > 1").select("locator.file", "locator.row")
    # Full bytes of the hits, at their locators: equal texts fold into one row before the shuffle.
    checked = (
        fetched(found, hits).select(normalised(F.col("text")).alias("full")).groupBy("full").agg(F.count(F.lit(1)).alias("rows"))
        .select(digest(F.col("full")).alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("texts"))
    )
    clashes = stage(checked.where("texts > 1").select("digest"))
    distinct = clashes.isEmpty()
    sure = grouped if distinct else grouped.join(clashes, "digest", "left_anti")
    result = sure.select(
        F.col("locator.doc_id").alias("doc_id"), F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        ((F.col("locator.file") == F.col("first.file")) & (F.col("locator.row") == F.col("first.row"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
    return result if distinct else result.unionByName(_told_apart(found, clashes, digest))


def _told_apart(found: DataFrame, clashes: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Rows whose digest several texts share, regrouped by the texts themselves."""
    full = found.withColumn("full", normalised(F.col("text"))).withColumn("digest", digest(F.col("full")))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")
    rows = full.join(clashes, "digest", "left_semi").withColumn("place", place).select("full", "digest", "place")
    groups = rows.groupBy("full").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, "full").select(
        F.col("place.doc_id").alias("doc_id"), F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("place") == F.col("first")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
