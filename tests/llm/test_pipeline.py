import random

import corpus_pipeline
from tilewright.llm import personal_data
from tilewright.llm.line_rules import figures

from .test_prefix_join import shingle_set


def prose(r, n):
    return [r.choice(["thing", "of", "every", "kind"]) + str(r.randrange(5000)).translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(n)]


def test_stages(spark, tmp_path):
    r = random.Random(2)
    rows, base = [], [prose(r, 90) for _ in range(30)]
    for k, w in enumerate(base):
        rows.append((k, " ".join(w), "en", "s", 0))
    rows.append((100, rows[4][1], "en", "s", 0))  # a copy
    near = list(base[7])
    near[3] = "changed"
    rows.append((101, " ".join(near), "en", "s", 0))  # a near copy
    rows += [(102, "too short", "en", "s", 0), (103, None, None, None, None), (104, " ".join(base[9][:80]) + " x@y.org " + " ".join(prose(r, 60)), "en", "t", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs, names = df, df.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == names
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
    ids = {name: {x.doc_id for x in found} for name, found in seen.items()}
    clean = set(range(30))
    assert ids["quality rules"] == clean | {100, 101, 104} and all(figures(x.text)[0] >= 50 for x in seen["quality rules"])
    assert ids["exact dedup"] == clean | {101, 104}
    assert ids["n-gram Jaccard join"] == clean | {104} == ids["PII"] == ids["best-fit packing"]
    text = {x.doc_id: x for x in seen["PII"]}
    assert "<EMAIL>" in text[104].text and text[104].n_chars == len(text[104].text) and text[3].text == rows[3][1]
    left = [shingle_set(x.text, 5) for x in seen["n-gram Jaccard join"]]
    assert not any(100 * len(a & b) >= 80 * len(a | b) for k, a in enumerate(left) for b in left[:k])
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, seen["best-fit packing"]))
    assert personal_data.models() is personal_data.models()


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
