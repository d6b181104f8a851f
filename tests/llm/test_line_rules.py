import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from tilewright.llm import line_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_figures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    n = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if n[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def brute_kept(rows):
    norm = lambda x: re.sub("[0-9]", "0", " ".join(re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(x)))
    have, sizes = defaultdict(set), defaultdict(set)
    for _, t, s in rows:
        sizes[s or ""].add(t or "")
        for x in (t or "").split("\n"):
            if norm(x):
                have[s or "", norm(x)].add(t)
    out = []
    for i, t, s in rows:
        f = brute_figures(t)
        failed = f[0] < line_rules.MIN_WORDS or 100 * f[4] > line_rules.MAX_REPEATED * f[0]
        common = lambda x: len(have[s or "", norm(x)]) > min(line_rules.MAX_DOCS, max(line_rules.MIN_DOCS, line_rules.SHARE * len(sizes[s or ""])))  # noqa: E731, B023
        lost = sum(len(WORD.findall(x)) for x in (t or "").split("\n") if norm(x) and common(x))
        out.append((i, *f, failed, not failed and lost <= line_rules.DEPLETED * f[0]))
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdeé%#") for _ in range(r.randint(1, 6)))
    shared = ["All Rights  Reserved 2021 " + "boiler " * 40, "short line 7"]
    out = []
    for i in range(120):
        lines = [" ".join(word() for _ in range(r.randint(1, 30))) for _ in range(r.randint(1, 5))]
        if i % 3 == 0:
            lines.insert(r.randint(0, len(lines)), shared[0].replace("1", str(i % 10)))
        if i % 4 == 0:
            lines.append(shared[1])
        if i % 7 == 0:
            lines.append(lines[0])
        out.append((i, "\n".join(lines), "big" if i % 5 else "small"))
    out += [(500, None, "big"), (501, "", None), (502, " \n\t\x0b ", None), (503, "a b c " * 60, "big"), (504, "nb sp   x\x1cy " * 30, ""), (None, out[3][1], None)]
    out += [(600 + k, out[0][1], "small") for k in range(40)]  # copies count once
    return out


def test_figures(rows):
    for _, t, _ in rows:
        assert line_rules.figures(t) == brute_figures(t)


def test_a_shared_line_goes_in_hosts_of_any_size(spark):
    r = random.Random(6)
    own = lambda k: f"line of its own {k} " + " ".join(str(r.random()).translate(str.maketrans("0123456789.", "abcdefghijk")) for _ in range(60))
    notice = " ".join(f"notice{a}{b}" for a in "abcdefghij" for b in "abcdefghij")
    rows = []
    for host, texts, shared in (("small", 30, 12), ("middle", 400, 101), ("hot", 3000, 101), ("seldom", 3000, 100)):
        for k in range(texts):
            rows.append((len(rows), (notice + "\n" if k < shared else "") + own(k), host))
    got = {x.doc_id: x for x in line_rules.verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    rejected = Counter(s for i, _, s in rows if not got[i].kept)
    assert rejected == {"small": 12, "middle": 101, "hot": 101}


def test_verdicts_and_sql(spark, rows, monkeypatch):
    monkeypatch.setattr(line_rules, "MIN_DOCS", 5)
    monkeypatch.setattr(line_rules, "SHARE", 0.1)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    key = lambda x: (x[0] is None, x)
    got = sorted(map(tuple, line_rules.verdicts(df).drop("host", "text_key").collect()), key=key)
    want = sorted(brute_kept(rows), key=key)
    assert got == want
    assert any(x[-2] is False and x[-1] is False for x in got)
    documents = df.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    sql = line_rules.ORACLE.replace("greatest(10, 0.2 *", "greatest(5, 0.1 *")
    assert sql != line_rules.ORACLE
    assert sorted(con.sql(sql).fetchall(), key=key) == want


@pytest.mark.parametrize("broadcast", [500_000, -1])
def test_clean(spark, rows, monkeypatch, broadcast):
    monkeypatch.setattr(line_rules, "MIN_DOCS", 5)
    monkeypatch.setattr(line_rules, "SHARE", 0.1)
    monkeypatch.setattr(line_rules, "BROADCAST_ROWS", broadcast)
    df = spark.createDataFrame([(*x, len(x[1] or ""), "h") for x in rows], "doc_id long, text string, source string, n_chars long, removed string")
    out = line_rules.clean(df).collect()
    keep = {x[0] for x in brute_kept(rows) if x[-1]}
    assert {r.doc_id for r in out} == keep and len(out) == sum(x[-1] for x in brute_kept(rows))
    assert out[0].__fields__ == df.columns
    assert all(r.n_chars == len(r.text) for r in out) and not any("boiler" in r.text for r in out if r.source == "big")


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert line_rules.verdicts(df).count() == 0 and line_rules.clean(df).count() == 0
