import random
from collections import defaultdict

import duckdb
import pytest

from tilewright.llm import graph, prefix_join


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingle_set(text, k):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, part, whole):
    sets = [shingle_set(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and whole * both >= part * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)].append(doc_id)
    return sorted(((d, len(s), (min(least[root(i)], default=None) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    word = lambda: r.choice("the of and to in that is was for it with as his on be at by".split()) if r.random() < 0.4 else "".join(r.choice("abcdefg") for _ in range(3))
    out, passage = [], " ".join(word() for _ in range(60))
    for base in range(14):
        text = [word() for _ in range(r.choice([4, 12, 30, 80, 150]))]
        if base % 3 == 0:
            text = passage.split() + text[:8]
        for _ in range(r.randint(1, 9)):
            copy = list(text)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = word()
            out.append((r.randrange(10**6), " ".join(copy)))
    out += [(10**7, None), (10**7 + 1, ""), (10**7 + 2, " \n"), (10**7 + 3, "two words"), (10**7 + 4, "Two  WORDS"), (10**7 + 5, "one"), (10**7 + 6, "É é x"), (10**7 + 7, "é é x"), (10**7 + 8, "long " * 50_000)]
    out += [(None, out[0][1]), (None, "unseen words of nobody at all"), (10**7 + 9, out[3][1]), (10**7 + 9, out[3][1])]
    return out


@pytest.mark.parametrize(("k", "part", "whole", "rounds", "frequent", "broadcast"), [(3, 90, 100, 3, 200_000, 500_000), (3, 90, 100, 0, 5, -1), (5, 80, 100, 1, 50, 500_000)])
def test_against_all_pairs(spark, rows, monkeypatch, k, part, whole, rounds, frequent, broadcast):
    monkeypatch.setattr(prefix_join, "ROUNDS", rounds)
    monkeypatch.setattr(prefix_join, "FREQUENT", frequent)
    monkeypatch.setattr(prefix_join, "FLUSH", 2000)
    monkeypatch.setattr(prefix_join, "BROADCAST_ROWS", broadcast)
    df = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, node string").repartition(3)
    got = prefix_join.groups(df, k, part, whole).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, k, part, whole)
    kept = prefix_join.one_of_each(df, k, part, whole).collect()
    assert kept[0].__fields__ == df.columns
    want = {c for d, n, c in brute(rows, k, part, whole)}
    assert {r.doc_id for r in kept} == want


def near_misses(r, n):
    """Texts that differ from one by random words: most of their pairs are just below the threshold."""
    base = ["w" + str(r.randrange(10**6)) for _ in range(60)]
    out = []
    for k in range(n):
        copy = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 2, 3])):
            copy[r.randrange(len(copy))] = f"x{k}{r.randrange(10**6)}"
        out.append((k, " ".join(copy)))
    return out


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_a_group_of_near_misses(spark, monkeypatch, rounds):
    monkeypatch.setattr(prefix_join, "ROUNDS", rounds)
    group = near_misses(random.Random(4), 80)
    df = spark.createDataFrame(group, "doc_id long, text string")
    want = brute(group, 3, 90, 100)
    assert len({c for *_, c in want}) > 3
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in prefix_join.groups(df, 3, 90, 100).collect()), key=str) == want


def test_links(spark):
    group = near_misses(random.Random(5), 60)
    df = spark.createDataFrame([*group, (900, group[0][1]), (901, None)], "doc_id long, text string")
    links, members = prefix_join.Join(df, 3, 90, 100).links()
    of = {r.doc_id: r.node for r in members.collect()}
    found = [frozenset((r.a, r.b)) for r in links.collect()]
    sets = {of[d]: shingle_set(t, 3) for d, t in group}
    nodes = sorted(sets)
    want = {frozenset((a, b)) for i, a in enumerate(nodes) for b in nodes[:i] if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])}
    assert of[900] == of[0] and 901 not in of and len(found) == len(set(found)) and set(found) == want and len(want) > 20


@pytest.mark.parametrize("broadcast", [500_000, -1])
def test_entries_are_exchanged_once_at_every_size(spark, rows, monkeypatch, broadcast):
    monkeypatch.setattr(prefix_join, "BROADCAST_ROWS", broadcast)
    join = prefix_join.Join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100)
    classes = join._classes(join._rows())
    made, write = [], prefix_join.common.written
    monkeypatch.setattr(prefix_join.common, "written", lambda df, name: made.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    got = sorted((r.token, r.node, r.n, r.ell, r.at, r.short) for r in join._entries(classes).collect())
    by_token = defaultdict(list)
    for r in classes.collect():
        for at, token in enumerate(r.prefix):
            by_token[token].append((token, r.node, r.n, r.ell, at, at < r.short))
    assert got == sorted(e for es in by_token.values() for e in es if len(es) > 1 and any(e[5] for e in es)) and got
    assert [(p.count("Exchange "), p.count("Join ")) for p in made] == [(1, 0)]


def test_sql(spark, rows, tmp_path):
    known = [x for x in dict(rows).items() if x[0] is not None]
    df = spark.createDataFrame(known, "doc_id long, text string")
    documents = df.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    assert sorted(con.sql(prefix_join.ORACLE).fetchall()) == sorted(brute(known, 3, 90, 100))


def test_every_order_of_prefixes_meets():
    r = random.Random(1)
    import numpy as np

    vocabulary = [f"w{k}" for k in range(40)]
    met = 0
    for _ in range(400):
        base = [r.choice(vocabulary) + str(r.randrange(9)) for _ in range(r.randint(1, 70))]
        other = list(base)
        for _ in range(r.randint(0, 2)):
            other[r.randrange(len(other))] = "new" + str(r.randrange(99))
        (wx, x), (wy, y) = (prefix_join._hashed(" ".join(t), 3) for t in (base, other))
        sx, sy = np.unique(x), np.unique(y)
        both = len(np.intersect1d(sx, sy))
        if 100 * both < 90 * (len(sx) + len(sy) - both):
            continue
        some = np.unique(np.concatenate([sx, sy]))[::2]
        words = np.unique(np.concatenate([wx, wy]))[::3]
        order = prefix_join.Order((some, np.array([r.randint(3, 99) for _ in some])), (words, np.array([r.randint(3, 9999) for _ in words])), 10**5)
        (px, kx, lx), (py, ky, ly) = (prefix_join.prefix(*order.sort(w, s), 90, 100) for w, s in ((wx, x), (wy, y)))
        if len(sx) <= len(sy):
            assert len(np.intersect1d(px[:kx], py)) >= min(lx, ly)
        if len(sy) <= len(sx):
            assert len(np.intersect1d(px, py[:ky])) >= min(lx, ly)
        differ = int(np.bitwise_count((prefix_join.parities(sx) ^ prefix_join.parities(sy)).view(np.uint64)).sum())
        assert differ <= len(sx) + len(sy) - 2 * both
        met += lx > 1 or ly > 1
    assert met


@pytest.mark.parametrize("one_task", [100_000, 0])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(130)] + [(k, k + 1) for k in range(300, 340)] + [(5, 5)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    up = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(400):
        for a, b in edges:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
    assert got == up
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert prefix_join.groups(df).count() == 0 and prefix_join.one_of_each(df).count() == 0
