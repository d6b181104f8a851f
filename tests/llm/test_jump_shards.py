from collections import Counter

from pyspark.sql import functions as F

from tilewright.llm import jump_shards


def plain_jump(key: int, n: int) -> int:
    """The published loop on Python's integers."""
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * jump_shards.MULTIPLIER + 1) % (1 << 64)
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_equals_the_published_loop(spark):
    df = spark.range(3000).select("id", F.xxhash64("id").alias("k"))
    for n in (1, 2, 8, 31):
        rows = df.select("k", jump_shards.jump(F.col("k"), n).alias("j")).select("k", "j.*").collect()
        assert all(r.shard == plain_jump(r.k, n) and r.grown_shard == plain_jump(r.k, n + 1) for r in rows)


def test_slots_and_growth(spark):
    rows = jump_shards.assign(spark.range(5000).withColumnRenamed("id", "doc_id"), ["doc_id"], 8).collect()
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.grown_shard in (r.shard, 8) for r in rows)
    assert 0.07 < sum(r.grown_shard == 8 for r in rows) / 5000 < 0.15
    assert max(Counter(r.shard for r in rows).values()) < 1.2 * 5000 / 8


def test_nulls_repeats_clashing_names_and_empty(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (None, None), (2, "")], "doc_id long, shard string")
    rows = jump_shards.assign(df, ["doc_id"], 4).collect()
    assert len(rows) == 5 and {"__shard", "_shard"} & set(rows[0].asDict())
    assert len({(r.shard, r.slot) for r in rows}) == 5
    assert jump_shards.assign(df.limit(0), ["doc_id"], 4).count() == 0


def test_query(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", "x"), (2, None, "x"), (3, "abc", "x")], "doc_id long, text string, lang string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in jump_shards.query(spark, str(tmp_path)).collect()}
    assert (rows[1]["size"], rows[2]["size"], rows[3]["size"]) == (3, 1, 4)
    assert rows[3].text_crc32 == 0x352441C2 and rows[2].text_crc32 == 0
