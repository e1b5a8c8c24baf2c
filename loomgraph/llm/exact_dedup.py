"""Exact deduplication as a stateful stream, in DataFrame functions only.

A stream of digests is grouped by digest.  Its state is kept on disk (RocksDB)
without expiry and holds, for each digest, the stable identifier of the row
that stays, the locator of that row's content and the number of rows.  Digests
that were hit more than once are then checked on the full bytes of their texts.

Defined results: a null text counts as empty.  Of equal texts, the row with the
largest id stays; a null id is less than any other.  Repeated rows with one id
are all in the group, and all of them carry kept = true when that id stays.  Of
the input, only the id and text columns (and Parquet file positions, where the
frame has them) are read, so other columns may have any name.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, join_groups, shared_dir

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of a digest that choose a bit map, and bits in each map: 256 maps of 4 KiB, whatever the input.
_MAP_BITS, _POSITION_BITS = 8, 15
#: Memory of an executor that keyed state takes at most; the rest of it is on disk.
STATE_MB = 128


def normalised(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else changed; null becomes empty."""
    text = F.coalesce(text, F.lit(""))
    plain = F.length(text) == F.octet_length(text)  # lower() of ASCII text changes A-Z only
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@contextmanager
def _settings(spark: SparkSession, **settings: str):
    names = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _locator(docs: DataFrame, key: str) -> Column:
    """File and row where the frame still knows them, else the identifier."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return F.col(key).cast("string")
    return F.concat_ws("#", "_metadata.file_path", "_metadata.row_index")


def stream_state(digests: str, schema, checkpoint: str, spark: SparkSession) -> DataFrame:
    """Stream the digest files of a folder into keyed state, and return the state.

    Running it again with the same checkpoint takes up only files that are new.
    One row per digest: digest, keep_id, locator (of the row that stays), group_size.
    """
    with _settings(
        spark,
        spark__sql__streaming__stateStore__providerClass="org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        # else each state partition reserves some MB of disk, however small it is
        spark__sql__streaming__stateStore__rocksdb__allowFAllocate="false",
        # nor some MB of memory: an executor's partitions share one bounded block cache and write buffer
        spark__sql__streaming__stateStore__rocksdb__boundedMemoryUsage="true",
        spark__sql__streaming__stateStore__rocksdb__maxMemoryUsageMB=str(STATE_MB),
    ):
        rows = spark.readStream.schema(schema).parquet(digests)
        # struct order: the largest id wins, and null ids come first
        state = rows.groupBy("digest").agg(
            F.max(F.struct("keep_id", "locator")).alias("best"),
            F.count("*").alias("group_size"),
        )
        query = (
            state.writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        stored = spark.read.format("statestore").load(checkpoint)
        best, size = (F.col(f"value.`{x}`") for x in stored.schema["value"].dataType.names)
        return stored.select(
            F.col("key.digest"), best["keep_id"].alias("keep_id"), best["locator"].alias("locator"), size.alias("group_size")
        )


def _position(digest: Column) -> tuple[Column, Column]:
    """The bit map of a digest and its position there."""
    bits = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.shiftright(bits, 32 - _MAP_BITS), bits.bitwiseAND((1 << _POSITION_BITS) - 1)


def _may_be_hit(texts: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows of texts whose digest is in hits, and a few others; never loses one.  What is broadcast is at most 256 bit maps."""
    number, position = _position(F.col("digest"))
    maps = hits.groupBy(number.alias("_map")).agg(F.bitmap_construct_agg(position).alias("_bits"))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return (
        texts.withColumns({"_map": number, "_at": position})
        .join(F.broadcast(maps), "_map")
        .where(F.getbit(byte, (F.col("_at") % 8).cast("int")) == 1)
        .drop("_map", "_at", "_bits")
    )


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", digest=_digest) -> DataFrame:
    """One row per row of docs: key, keep_id, group_size, kept, text_sha256, locator (of the content that stays)."""
    spark = docs.sparkSession
    at = shared_dir(spark)
    source = docs.select(F.col(key).alias("keep_id"), _locator(docs, key).alias("locator"), normalised(F.col(text)).alias("_text"))
    rows = cut(source.select("keep_id", "locator", digest(F.col("_text")).alias("digest"), _digest(F.col("_text")).alias("text_sha256")), f"{at}/digests")
    state = cut(stream_state(f"{at}/digests", rows.schema, f"{at}/state", spark), f"{at}/groups")

    # A hit is checked on full bytes: equal texts meet in the key of an aggregation, which each task does for its own rows first.
    hits = state.where("group_size > 1").select("digest")
    texts = _may_be_hit(source.select("keep_id", "locator", digest(F.col("_text")).alias("digest"), "_text"), hits)
    checked = texts.groupBy("digest", "_text").agg(F.count("*").alias("n"))
    split = cut(checked.groupBy("digest").agg(F.count("*").alias("n_texts")).where("n_texts > 1").select("digest"), f"{at}/split")

    id_of = F.col("keep_id").alias(key)
    total = rows.count()
    numbered = rows.select(id_of, "digest", "text_sha256")
    out = ["keep_id", "group_size", "locator"]
    if split.isEmpty():
        made = join_groups(numbered, state, "digest", "group_size", total)
    else:  # digests that differing texts share are grouped by the texts themselves
        apart = source.select("keep_id", "locator", digest(F.col("_text")).alias("digest"), "_text").join(split, "digest", "left_semi")
        groups = apart.groupBy("_text").agg(F.max(F.struct("keep_id", "locator")).alias("best"), F.count("*").alias("group_size"))
        again = apart.join(groups, "_text").select(id_of, _digest(F.col("_text")).alias("text_sha256"), F.col("best.keep_id").alias("keep_id"), "group_size", F.col("best.locator").alias("locator"))
        rest = join_groups(numbered.join(split, "digest", "left_anti"), state, "digest", "group_size", total)
        made = rest.select(key, "text_sha256", *out).unionByName(again.select(key, "text_sha256", *out))
    return made.select(key, "keep_id", "group_size", F.col(key).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "locator")


def keep(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each group of equal texts (all rows of the id that stays and that text)."""
    told = classes(docs, key, text).where("not kept").select(F.col(key).alias("id"), F.col("text_sha256").alias("sum")).distinct()
    names = [fresh(docs, "_gone_id"), fresh(docs, "_gone_sum")]
    gone = told.toDF(*names)
    # rows of one id may differ in text, so an id alone doesn't name what goes
    same = F.col(key).eqNullSafe(F.col(names[0])) & (_digest(normalised(F.col(text))) == F.col(names[1]))
    return docs.join(gone, same, "left_anti")
