"""Contiguous shards of near-equal byte size from global prefix sums.

Rows are ordered by doc_id (nulls first, ties by checksum and size) into range partitions of narrow
rows (id, size, checksum: no text is moved). Byte and row totals of the partitions, a few hundred
rows whatever the input, give each partition its global offset; running sums inside a partition give
each row its own. A row goes to the shard in which the middle of its bytes falls, so that shards are
contiguous in order and differ from the equal target by at most one document.

Null texts count no bytes, empty tables give no rows, repeated rows are placed one after another, and
columns besides doc_id and text are ignored. Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, table, texts

SHARDS = 40
ROW_BYTES = 16


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, partitions: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (position in the shard, gapless from 0)."""
    spark = docs.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = texts(docs).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    order = ["doc_id", "text_crc32", "size"]
    # Rows that are equal in all three are interchangeable; dealing them by a random key keeps one id from filling a partition.
    placed = cut(narrow.withColumn("tie", F.rand(7)).repartitionByRange(parts, *order, "tie").withColumn("part", F.spark_partition_id()))
    totals = placed.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count(F.lit(1)).alias("part_rows"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(upto), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(upto), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(every).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*order, "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (
        placed.withColumn("upto", F.sum("size").over(inside))
        .withColumn("nth", F.row_number().over(inside))
        .join(F.broadcast(totals), "part")  # one row for each range partition
    )
    shard = F.expr(f"least({shards - 1}, cast((({middle_sql()}) * {shards}) div (2 * all_bytes) as int))")
    rows = rows.withColumn("shard", shard).withColumn("row_at", F.col("rows_before") + F.col("nth") - 1)
    firsts = rows.groupBy("shard").agg(F.min("row_at").alias("shard_at"))
    return rows.join(F.broadcast(firsts), "shard").select(  # one row for each shard
        "doc_id", "size", "text_crc32", "shard", (F.col("row_at") - F.col("shard_at")).cast("long").alias("slot")
    )


def middle_sql() -> str:
    """Twice the position of the middle of a row's bytes, as a decimal that doesn't overflow."""
    return "cast((bytes_before + upto) * 2 - size as decimal(30, 0))"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


# CRC-32 has no function in the other engine: the remainder table is built by the rule and folded over the bytes.
SQL = """
WITH RECURSIVE step(i, k, c) AS (
  SELECT i, 0, CAST(i AS UBIGINT) FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS UBIGINT)) ELSE c // 2 END FROM step WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
sized AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) + 16 AS BIGINT) AS size, hex(encode(coalesce(text, ''))) AS h FROM documents
), summed AS (
  SELECT doc_id, size, CAST(xor(CAST(4294967295 AS UBIGINT), list_reduce(
    list_prepend(CAST(4294967295 AS UBIGINT), [CAST(('0x' || x) AS UBIGINT) FOR x IN regexp_extract_all(h, '..')]),
    lambda a, b : xor(a // 256, crc.t[CAST(xor(a, b) % 256 AS INTEGER) + 1]))) AS BIGINT) AS text_crc32
  FROM sized, crc
), placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) AS upto,
         sum(size) OVER () AS total FROM summed
), dealt AS (
  SELECT *, CAST(least(39, ((upto * 2 - size) * 40) // (2 * total)) AS INTEGER) AS shard FROM placed
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
       CAST(NULL AS INTEGER) AS grown_shard
FROM dealt
"""
