import itertools
import random

import numpy as np
import pytest

from tilewright.llm import noisy_channel as nc

PARTS = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en"]
BAD = ["idiot", "moron", "loser", "stupid", "worthless"]


def prose(r, n):
    return ["".join(r.choice(PARTS) for _ in range(r.randint(1, 3))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(6)
    out = []
    for k in range(600):
        text, toxic = prose(r, r.randint(5, 60)), int(r.random() < 0.25)
        for _ in range(r.randint(1, 3) * toxic):
            text.insert(r.randrange(len(text)), r.choice(BAD))
        out.append((k, " ".join(text), toxic))
    return out


@pytest.fixture(scope="module")
def model(corpus):
    return nc.CharacterModel(nc.trigram_counts([t for _, t, _ in corpus]))


def test_counts():
    n = nc.trigram_counts(["ab", "Ab é"])
    a, b, e = nc.code("a"), nc.code("b"), nc.code("é")
    s = nc.SYMBOLS
    assert n[a + 0 * s] == 2 and n[(0 * s + a) * s + b] == 2 and n[(a * s + b) * s] == 2 and n[e] == 1 and n.sum() > 0


def test_counting_holds_pieces(monkeypatch):
    import tracemalloc

    r = random.Random(9)
    texts = ["".join(r.choice("ab é1.") for _ in range(r.randrange(40))) for _ in range(50)] + ["x" * 100, "", "long " * 30]
    whole = nc.trigram_counts(texts)
    for size in (1, 2, 7, 40):
        monkeypatch.setattr(nc, "PIECE", size)
        assert (nc.trigram_counts(iter(texts)) == whole).all()
        assert max(map(len, nc._pieces(texts))) <= size + 6
    monkeypatch.undo()
    tracemalloc.start()
    counted = nc.trigram_counts(["some words of no use " * 50] * 20_000)  # 21 MB
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6 and counted.sum() == 20_000 * (21 * 50 + 2)


def test_a_new_model_gives_up_what_was_kept_for_the_last():
    nc.common.begin(nc.__name__)
    nc._restorers["old"] = nc._scorers["old"] = {"a": 1}
    batch = nc.pa.RecordBatch.from_arrays([nc.pa.array(["ab", None, "c"] * 700)], ["text"])
    (got,) = nc._trigrams(iter([batch]))
    assert not nc._restorers and not nc._scorers
    want = nc.trigram_counts(["ab", "c"] * 700)
    assert dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True)) == {k: want[k] for k in np.flatnonzero(want)}


def test_viterbi_is_the_least_of_all_paths(model):
    for token in ("1d10t", "l0$er", "aaa", "b.a.d", "m0rrron", "*n"):
        options = []
        for k, c in enumerate(token):
            own = nc.code(c)
            arcs = [(c, 0.0)] if own else [(x, nc.AS_LETTER + np.log(len(nc.LOOKS[c]))) for x in nc.LOOKS.get(c, "")]
            nothing = (nc.DROPPED if k and token[k - 1] == c else None) if own else nc.SURE if c in nc._SURE else nc.UNSURE if c in nc.LOOKS else nc.AS_NOTHING
            options.append(arcs + ([("", nothing)] if nothing is not None else []))
        best = None
        for path in itertools.product(*options):
            word = "".join(x for x, _ in path)
            codes = [0, 0, *map(nc.code, word), 0]
            cost = sum(p for _, p in path) + sum(float(model.cost[a, b, c]) for a, b, c in zip(codes, codes[1:], codes[2:], strict=False))
            if best is None or cost < best[0] - 1e-6:
                best = (cost, word)
        assert model.decode(token) == best[1]


def test_restores(model):
    r = nc.Restorer(model)
    for token, word in (("1d10t", "idiot"), ("M0R0N!!", "moron"), ("l0ser,", "loser"), ("iiidiooot", "idiot"), ("s-t-u-p-i-d", "stupid"), ("plain.", "plain"), ("***", ""), ("4111111111111111", "")):
        assert r[token] == word
    assert "idiot" in nc.tokens("an i d i o t here") and nc.tokens("a b here") == ["a", "b", "here"]


def test_every_reading_of_signs_at_the_ends_and_of_repeated_letters(model):
    r = nc.Restorer(model)
    for token, word in (("idio+", "idiot"), ("idio+!!", "idiot"), ("(<moron", "cmoron"), ("+ha+", "that"), ("a$$", "ass"), ("@$$,", "ass"), ("idiiot", "idiot"), ("stuupid", "stupid"), ("asshoole", "asshole"), ("looserr", "loser")):
        assert word in r.readings(token), token
    assert r.readings("idiot!")[0] == r.readings("idiot")[0] == "idiot" and r.readings("***") == ()
    assert len(r.readings("aabbccddee" * 4)) <= 3 and len(r.readings("+++++idiot+++++")) <= 64


def test_spaced_rows_are_cut_into_words(model):
    for text in ("a n i d i o t here", "t h e r e i d i o t", "y o u i d i o t", "t h e m 0 r o n on"):
        assert {"idiot", "moron"} & set(nc.tokens(text, model)), text
    assert nc.tokens("a b here", model) == ["a", "b", "here"]


def test_new_forms_are_toxic(spark, corpus):
    docs = spark.createDataFrame([(k, t) for k, t, _ in corpus], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in corpus], "doc_id long, toxic int")
    r = random.Random(3)
    hidden = [" ".join([*prose(r, 12), w, *prose(r, 12)]) for w in ("idio+", "$tupid!!", "idiiot", "mooronn", "t h e r e i d i o t", "worth|es$")]
    clean = [" ".join(w + s for w, s in zip(prose(r, 25), "!*#+)" * 5, strict=True)) for _ in hidden]
    out = [x.score for x in nc.fit(docs, labels).score(spark.createDataFrame(list(enumerate(hidden + clean)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert all(s >= 0.5 for s in out[:6]) and all(s < 0.5 for s in out[6:]), out


def test_held_out_accuracy_and_disguise(spark, corpus):
    docs = spark.createDataFrame([(k, t) for k, t, _ in corpus] + [(1000, None), (1001, ""), (None, "an idiot")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in corpus if k % 3] + [(None, 1), (1, None)], "doc_id long, toxic int")
    fitted = nc.fit(docs, labels)
    got = {r.doc_id: r.score for r in fitted.score(docs).collect()}
    held = [(got[k] >= 0.5) == bool(y) for k, _, y in corpus if not k % 3]
    assert sum(held) / len(held) > 0.95 and len(got) == 603 and 0 <= got[1000] == got[1001] < 0.5 and got[None] > 0.5
    r = random.Random(1)
    hidden = [" ".join([*prose(r, 12), w, *prose(r, 12)]) for w in ("1d10t", "m0r0n", "l0$er", "s t u p i d", "w0rthle55", "iiidiooot", "m.o.r.o.n")]
    clean = [" ".join(prose(r, 25)) for _ in hidden]
    out = [x.score for x in fitted.score(spark.createDataFrame(list(enumerate(hidden + clean)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert all(s >= 0.5 for s in out[:7]) and all(s < 0.5 for s in out[7:])
    again = {r.doc_id: r.score for r in nc.fit(docs.repartition(5), labels).score(docs).collect()}
    assert all(abs(again[k] - got[k]) < 1e-9 for k in got)


def test_without_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(0 <= r.score < 0.01 for r in nc.fit(docs, none).score(docs).collect())
    assert nc.fit(docs.limit(0), none).score(docs.limit(0)).count() == 0
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert nc.fit(docs, one).score(docs).count() == 2


def test_query_keeps_the_fold_apart(spark, tmp_path, corpus):
    import zlib

    spark.createDataFrame([(k, t) for k, t, _ in corpus], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    held = lambda k: zlib.crc32(str(k).encode()) % 5 == 0
    for folder, flip in (("a", False), ("b", True)):
        spark.createDataFrame([(k, 1 - y if flip and held(k) else y) for k, _, y in corpus], "doc_id long, toxic int").write.parquet(f"{tmp_path}/{folder}.parquet")
    import shutil

    results = []
    for folder in "ab":
        shutil.copytree(f"{tmp_path}/{folder}.parquet", f"{tmp_path}/labels.parquet", dirs_exist_ok=False)
        results.append(sorted(map(tuple, nc.query(spark, str(tmp_path)).collect())))
        shutil.rmtree(f"{tmp_path}/labels.parquet")
        spark.catalog.clearCache()
    assert results[0] == results[1] and all(r[1] == held(r[0]) and r[3] == int(r[2] >= 0.5) for r in results[0])
