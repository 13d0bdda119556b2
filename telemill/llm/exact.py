"""Exact dedup by stateful streaming.

Rows are read once and reduced to a digest of the normalised text, the stable identifier (the id) and
a content locator (file, id, hash of the raw text). A stream over these rows keeps its state on disk
(RocksDB), keyed by the digest and never expired: the identifier that stays, its locator and the
number of rows. Every micro-batch writes the keys it changed, so an interrupted run goes on from its
checkpoint, and later files continue the same state.

A digest seen twice is a hit. The whole texts of hits are fetched by their locators and compared byte
by byte: they are grouped by digest *and* text. A digest with two texts is divided by text; no row is
judged by its digest alone.

Nulls and ties: null text counts as empty. A null id is smaller than every id; in a group that has
null ids only, ``keep_id`` is null and all rows are kept. Rows that repeat the largest id are all
kept. An empty table gives an empty result. Columns other than the id and the text are ignored.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.llm.staging import staged
from telemill.llm.text import lower_ascii
from telemill.scratch import new_folder

_STORE = "spark.sql.streaming.stateStore"
#: State on disk; a checkpoint takes what changed; no disk is reserved ahead.
SETTINGS = {
    f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}.rocksdb.changelogCheckpointing.enabled": "true",
    f"{_STORE}.rocksdb.allowFAllocate": "false",
}
_CHANGES = (
    "digest binary, keep_id bigint, locator struct<doc_id: bigint, file: string, raw: bigint>, "
    "n_rows bigint, batch int"
)


def normalised(text: Column) -> Column:
    return lower_ascii(F.coalesce(text, F.lit("")))


def digests(documents: DataFrame) -> DataFrame:
    """``doc_id, file, raw, digest`` of every row; ``raw`` hashes the text as it stands."""
    return documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("_metadata.file_path").alias("file"),
        F.xxhash64("text").alias("raw"),
        F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)).alias("digest"),
    )


def stream_state(spark: SparkSession, path: str, folder: str, files_per_batch: int = 1_000_000) -> DataFrame:
    """Run the stream over the files of digests in ``path`` that the checkpoint in ``folder`` lacks.

    Returns the state after it: ``digest, keep_id, locator, n_rows``.
    """
    rows = (
        spark.readStream.schema("doc_id bigint, file string, raw bigint, digest binary")
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )
    state = (
        rows.groupBy("digest")
        .agg(F.max(F.struct("doc_id", "file", "raw")).alias("locator"), F.count(F.lit(1)).alias("n_rows"))
        .select("digest", F.col("locator.doc_id").alias("keep_id"), "locator", "n_rows")
    )
    changes = f"{folder}/changes"
    spark.createDataFrame([], _CHANGES).drop("batch").write.mode("append").parquet(f"{changes}/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changes}/batch={number}")

    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    try:
        (
            state.writeStream.outputMode("update")
            .foreachBatch(write)
            .option("checkpointLocation", f"{folder}/state")
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
    return (
        spark.read.schema(_CHANGES)
        .parquet(changes)
        .groupBy("digest")
        .agg(F.max(F.struct("batch", "keep_id", "locator", "n_rows")).alias("last"))
        .select("digest", "last.keep_id", "last.locator", "last.n_rows")
    )


def torn_digests(documents: DataFrame, rows: DataFrame, state: DataFrame) -> DataFrame:
    """Full-byte check of the hits: ``digest, normal, keep_id, group_size`` of digests with two texts."""
    hits = rows.join(state.where("n_rows > 1").select("digest"), "digest")
    wanted = hits.select(F.col("doc_id").alias("hit_id"), F.col("raw").alias("hit_raw"), "digest").distinct()
    texts = (
        documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("raw"))
        .join(wanted, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("raw") == F.col("hit_raw")))
        .groupBy("digest", normalised(F.col("text")).alias("normal"))
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    return texts.join(
        texts.groupBy("digest").agg(F.count(F.lit(1)).alias("n_texts")).where("n_texts > 1").select("digest"),
        "digest",
    )


def dedup(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """One row per document of ``path``: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    folder = folder or new_folder(spark, "exact-dedup")
    documents = spark.read.parquet(path)
    digests(documents).write.mode("overwrite").parquet(f"{folder}/digests")
    rows = spark.read.parquet(f"{folder}/digests")
    state = staged(stream_state(spark, f"{folder}/digests", folder), "exact-state")
    torn = staged(torn_digests(documents, rows, state), "exact-torn")
    whole = rows.join(state, "digest").select("doc_id", "digest", "keep_id", F.col("n_rows").alias("group_size"))
    if not torn.isEmpty():
        divided = torn.select("digest").distinct()
        texts = documents.select(
            F.col("doc_id").cast("bigint").alias("doc_id"), normalised(F.col("text")).alias("normal")
        ).withColumn("digest", F.unhex(F.sha2(F.col("normal").cast("binary"), 256)))
        whole = whole.join(divided, "digest", "left_anti").unionByName(
            texts.join(torn, ["digest", "normal"]).select("doc_id", "digest", "keep_id", "group_size")
        )
    return whole.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
