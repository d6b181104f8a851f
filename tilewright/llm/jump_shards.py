"""Sharding by jump consistent hashing (native).

A row's shard depends on its key and the number of shards alone; there is no ring table. The key
seeds a 64-bit linear congruential sequence whose values say how far the key jumps ahead; the last
landing place below the number of shards is its shard. A key that moves when a shard is
appended moves into the new one, which takes 1/(n+1) of the keys.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: The multiplier of the congruential sequence, in limbs of 16, 16 and 32 bits.
MULTIPLIER = 2862933555777941757
_C0, _C1, _CH = MULTIPLIER & 0xFFFF, (MULTIPLIER >> 16) & 0xFFFF, MULTIPLIER >> 32
_M32 = 0xFFFFFFFF
#: Rows of a (shard, bucket) cell aimed at, and the most buckets of a shard; the offsets of all
#: cells are broadcast, so they number at most shards * MAX_BUCKETS.
CELL_ROWS, MAX_BUCKETS = 1024, 65536
#: Jumps that are taken at first: a key takes some ln(shards). One that isn't there by then takes as many as there are shards.
JUMPS = 64


def _step(acc: Column, most: int) -> Column:
    """One jump: acc is (b, j, before, hi, lo), the state being hi * 2^32 + lo; no product exceeds 2^63."""
    lit = lambda x: F.lit(x).cast("long")
    hi, lo = acc["hi"], acc["lo"]
    mask = lambda x: x.bitwiseAND(lit(_M32))
    p1 = lo * lit(_C1)
    low = lo * lit(_C0) + p1.bitwiseAND(lit(0xFFFF)) * lit(65536) + lit(1)
    cross = lambda x, c: mask(x * lit(c & 0xFFFF) + (x * lit(c >> 16)).bitwiseAND(lit(0xFFFF)) * lit(65536))
    carry = F.shiftright(low, 32) + F.shiftright(p1, 16)
    hi2 = mask(carry + cross(hi, _C0 + (_C1 << 16)) + cross(lo, _CH))
    lo2 = mask(low)
    jump = F.floor((acc["j"] + 1).cast("double") * (lit(1 << 31).cast("double") / (F.shiftright(hi2, 1) + 1).cast("double")))
    go = acc["j"] < lit(most)
    return F.when(
        go,
        F.struct(
            acc["j"].alias("b"),
            F.least(jump, lit(most)).alias("j"),
            F.when(acc["j"] < lit(most - 1), acc["j"]).otherwise(acc["before"]).alias("before"),
            hi2.alias("hi"),
            lo2.alias("lo"),
        ),
    ).otherwise(acc)


def jump(key: Column, shards: int) -> Column:
    """struct(shard, grown_shard): the shard of a 64-bit key among ``shards`` and among ``shards + 1``."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    lit = lambda x: F.lit(x).cast("long")
    start = F.struct(lit(0).alias("b"), lit(0).alias("j"), lit(0).alias("before"), F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(lit(_M32)).alias("lo"))
    after = lambda n: F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, lambda acc, _: _step(acc, shards + 1))
    end = after(min(shards + 1, JUMPS))
    if shards + 1 > JUMPS:
        end = F.when(end["j"] >= shards + 1, end).otherwise(after(shards + 1))
    return F.struct(end["before"].cast("int").alias("shard"), end["b"].cast("int").alias("grown_shard"))


def assign(df: DataFrame, key_cols: list[str], shards: int, order_by: list[str] | None = None) -> DataFrame:
    """``df`` with shard, slot and grown_shard.

    The key is the hash of ``key_cols``; rows with equal keys share a shard, a null is a value like
    any other. Slots of a shard run from 0 without gaps, by bucket and then by ``order_by`` (or the
    key); rows equal in all of these take their slots in any order. Empty table: empty result.
    Columns of ``df`` with these names are renamed by leading underscores.
    """
    for c in [c for c in df.columns if c.lower() in ("shard", "slot", "grown_shard")]:
        new = common.free_name(df, "_" + c)
        df = df.withColumnRenamed(c, new)
        key_cols = [new if x == c else x for x in key_cols]
        order_by = [new if x == c else x for x in order_by] if order_by else order_by
    carried, j, bucket = df.columns, common.free_name(df, "jump_k"), common.free_name(df, "bucket_k")
    buckets = min(MAX_BUCKETS, max(1, math.ceil(df.count() / CELL_ROWS)))
    keys = [common.col(c) for c in key_cols]
    spread = [common.col(c) for c in order_by or key_cols]

    def placed(x: DataFrame) -> DataFrame:
        x = x.withColumn(j, jump(F.xxhash64(*keys), shards))
        x = x.withColumn(bucket, F.pmod(F.xxhash64(F.lit("bucket"), *spread), F.lit(buckets)).cast("int"))
        return x.withColumns({"shard": F.col(j)["shard"], "grown_shard": F.col(j)["grown_shard"]}).drop(j)

    cells = placed(df.select(*{c: common.col(c) for c in [*key_cols, *(order_by or [])]}.values())).groupBy("shard", bucket).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("shard", bucket, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset_k"))
    rows = placed(df).withColumn("row_k", F.row_number().over(Window.partitionBy("shard", bucket).orderBy(*spread)))
    return rows.join(F.broadcast(offsets), ["shard", bucket]).select(
        *[common.col(c) for c in carried], "shard", (F.col("offset_k") + F.col("row_k") - 1).alias("slot"), "grown_shard"
    )


def write_shards(df: DataFrame, path: str, key_cols: list[str], shards: int) -> None:
    """``df`` written as one folder of Parquet files for each shard.

    Nulls, repeats and clashing names: see ``assign``. An empty table gives an empty folder; shards without rows have none.
    """
    assign(df, key_cols, shards).write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: documents in 8 shards by their doc_id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return assign(docs, ["doc_id"], 8).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
