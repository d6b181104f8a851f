from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tilewright.llm import content_sort


def brute(rows, largest):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    pick = max if largest else min
    return {t: (pick([i for i in ids if i is not None], default=None), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("hot_rows", [512, 8])
def test_against_brute_force(spark, keep, hot_rows, monkeypatch):
    monkeypatch.setattr(content_sort, "HOT_ROWS", hot_rows)
    prefix = "the same beginning " * 10
    rows = [(i, prefix + str(i % 40)) for i in range(400)] + [(1000 + i, "hot") for i in range(90)]
    rows += [(2000, None), (2001, ""), (2002, " "), (None, "lost"), (None, "lost"), (2003, "x" * 200_000), (2004, "x" * 200_000 + "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    out = content_sort.annotate(df, keep=keep).collect()
    want = brute(rows, keep == "largest")
    assert len(out) == len(rows)
    for r in out:
        assert (r.keep_id, r.group_size) == want[r.text or ""]
    kept = [r for r in out if r.kept]
    assert sorted(r.text or "" for r in kept) == sorted(want)
    assert all(r.doc_id == r.keep_id for r in kept)


def test_repeated_rows_keep_one(spark, monkeypatch):
    monkeypatch.setattr(content_sort, "HOT_ROWS", 4)
    df = spark.createDataFrame([(1, "a")] * 20 + [(2, "a"), (1, "b"), (1, "b")], "doc_id long, text string")
    out = content_sort.dedup(df)
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (1, "b")]


def test_clashing_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "a", 5, "h"), (2, "a", 6, "k")], "doc_id long, text string, keep_id int, hash_k string")
    assert sorted(map(tuple, content_sort.dedup(df).collect())) == [(1, "a", 5, "h")]
    assert "__keep_id" in content_sort.annotate(df).columns or "_keep_id" in content_sort.annotate(df).columns


def test_normalised(spark):
    df = spark.createDataFrame([(1, "A b"), (2, "a b"), (3, "c")], "doc_id long, text string")
    assert [r.doc_id for r in content_sort.dedup(df, normalise=F.lower).orderBy("doc_id").collect()] == [1, 3]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert content_sort.annotate(df).count() == 0
