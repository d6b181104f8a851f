"""Nulls, long texts, ties, repeats, empty tables and clashing names where the operators' own tests don't have them; brute-force packing."""

import itertools
import random
import time

import pytest

import corpus_pipeline
from tilewright.llm import jump_shards, noisy_channel, personal_data, prefix_bpe, prefix_join, size_packing
from tilewright.llm.size_packing import SIZES, cost, pack

from .test_noisy_channel import BAD, prose
from .test_personal_data import brute_base


def optimum(lengths):
    """The least cost of all partitions into bins."""
    best = [float("inf")]

    def place(k, bins):
        if k == len(lengths):
            best[0] = min(best[0], sum(cost(min(s for s in SIZES if s >= b)) for b in bins))
            return
        for j in range(len(bins)):
            if bins[j] + lengths[k] <= SIZES[-1]:
                place(k + 1, bins[:j] + [bins[j] + lengths[k]] + bins[j + 1 :])
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best[0]


def test_packing_is_near_the_optimum_of_all_partitions():
    r = random.Random(8)
    worst, total, least = 0.0, 0.0, 0.0
    for _ in range(120):
        lengths = [r.randint(1, r.choice([300, 1200, 8192])) for _ in range(r.randint(1, 7))]
        found, best = sum(map(cost, pack(lengths)[2])), optimum(lengths)
        assert found >= best - 1e-9
        worst, total, least = max(worst, found / best), total + found, least + best
    assert worst <= 1.2 and total <= 1.03 * least


def test_sizes_are_bounded():
    with pytest.raises(ValueError):
        pack([1], tuple(range(1, 11)))
    with pytest.raises(ValueError):
        pack([9], (4, 8))


def test_blocks_cost_little():
    """What packing in blocks loses against one packing of all pieces."""
    r = random.Random(9)
    lengths = [min(8192, int(r.lognormvariate(6, 1.2)) + 1) for _ in range(4 * size_packing.BLOCK_ITEMS)]
    whole = sum(map(cost, pack(lengths)[2]))
    blocks = sum(sum(map(cost, pack(lengths[k :: 4])[2])) for k in range(4))
    assert blocks <= 1.01 * whole


def test_packing_does_not_depend_on_files(spark, monkeypatch):
    monkeypatch.setattr(size_packing, "BLOCK_ITEMS", 10)
    rows = [(k % 40, "word " * (31 * k % 700)) for k in range(90)] + [(3, "twice " * 50)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [sorted(map(tuple, size_packing.pack_documents(df.repartition(n)).collect()), key=str) for n in (1, 5)]
    assert found[0] == found[1]


def test_addresses_with_long_numbers_and_long_texts():
    for text in ("0" * 40 + "1.2.3.4", "1." + "0" * 4000 + "7.3.255", "1.2.3.256", "1.2.3.0000256", "1.2.3.4.5.6.7.8.9", "a1.2.3.4b.5.6.7", ".1.2.3.4.", "1..2.3.4.5", "9" * 500 + ".1.1.1"):
        assert personal_data.base_spans(text) == brute_base(text), text
    r = random.Random(10)
    for _ in range(2000):
        text = "".join(r.choice("0125.. +") for _ in range(r.randint(0, 40)))
        assert personal_data.base_spans(text) == brute_base(text), text
    began = time.perf_counter()
    assert personal_data.base_spans("7" * 1_000_000) == []
    many = " ".join(f"user{k}@host{k}.org or jane at example{k} dot com" for k in range(4000))
    base, added = personal_data.find(many, personal_data.models())
    assert len(base) >= 4000
    text = personal_data.redacted(many, personal_data.models())
    assert text.count("<EMAIL>") >= 4000 and "@" not in text
    assert time.perf_counter() - began < 60


def test_tokens_without_a_chance_are_those_without_weight():
    r = random.Random(11)
    texts = [" ".join(prose(r, 40) + [r.choice(BAD)]) for _ in range(100)]
    model = noisy_channel.CharacterModel(noisy_channel.trigram_counts(texts))
    weights = {"=idiot": 3.0, "^stup": 2.0, "=moron": 2.5, "=aa": 1.0, "^worthl": 1.5}
    scorer = noisy_channel.Scorer(noisy_channel.Restorer(model), weights)
    skipped = 0
    for _ in range(4000):
        word = list(r.choice([*BAD, "aa", *prose(r, 3)]))
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(word))
            word.insert(k, r.choice([word[k], word[k], "!", ".", "1", "$", r.choice("abc")]))
        token = "".join(word)
        want = max((weights.get(f, 0.0) for w in noisy_channel.Restorer(model).readings(token) for f in noisy_channel._features(w)), default=0.0)
        assert scorer[token] == want, token
        skipped += token.isalpha() and scorer.hopeless(token)
    assert skipped > 500


def test_toxicity_with_clashing_names_conflicts_and_long_texts(spark):
    r = random.Random(12)
    rows = [(k, " ".join(prose(r, 20) + [r.choice(BAD)] * (k % 3 == 0)), "x", 1.0) for k in range(200)] + [(900, "idiot " + " ".join(prose(r, 60_000)), "y", 0.0), (901, None, "z", 0.0), (901, None, "z", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string, score double")
    labels = spark.createDataFrame([(k, int(k % 3 == 0), "t") for k in range(150)] + [(0, 0, "u"), (None, 1, "v"), (5, None, "w")], "doc_id long, toxic int, text string")
    found = noisy_channel.fit(docs, labels).score(docs)
    scores = found.collect()
    assert found.columns == ["doc_id", "score"] and len(scores) == len(rows) and all(0 <= x.score <= 1 for x in scores)
    again = noisy_channel.fit(docs.repartition(7), labels.repartition(5)).score(docs)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, scores))


def test_ids_with_clashing_names_and_no_rows(spark):
    df = spark.createDataFrame([(1, "some text", 5, "x"), (1, "some text", 5, "x"), (None, None, 6, "y")], "doc_id long, text string, n_tokens int, ids_sha256 string")
    got = prefix_bpe.digests(df).collect()
    assert len(got) == 3 and got[0].n_tokens == got[1].n_tokens > 0 and {x.n_tokens for x in got if x.doc_id is None} == {0}
    assert prefix_bpe.digests(df.limit(0)).count() == 0


def test_shards_of_long_texts_and_many_shards(spark):
    df = spark.createDataFrame([(k, "long " * (200_000 if k == 7 else k)) for k in range(40)], "doc_id long, text string")
    got = jump_shards.assign(df, ["doc_id"], 8).collect()
    assert len(got) == 40 and len(next(x.text for x in got if x.doc_id == 7)) == 1_000_000

    def published(key, n):
        b, j, mask = -1, 0, (1 << 64) - 1
        while j < n:
            b, key = j, (key * jump_shards.MULTIPLIER + 1) & mask
            j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
        return b

    keys = spark.range(300).selectExpr("xxhash64(id) as k")
    for n in (200, 5000):
        for x in keys.select("k", jump_shards.jump(keys["k"], n).alias("j")).collect():
            assert (x.j.shard, x.j.grown_shard) == tuple(published(x.k & ((1 << 64) - 1), m) for m in (n, n + 1))


def test_survivors_need_integer_ids(spark):
    with pytest.raises(TypeError):
        prefix_join.one_of_each(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_stages_with_clashing_columns_ties_and_repeats(spark, tmp_path):
    r = random.Random(13)
    text = " ".join(f"{a}{b}" for a, b in itertools.islice(itertools.product("abcdefghij", repeat=2), 80))
    rows = [(1, text, "s", 0, "h", "t"), (1, text, "s", 0, "h", "t"), (2, text, "s", 0, "h", "t"), (3, text.replace("aa ab", "aa xx"), "s", 0, None, ""), (None, " ".join(prose(r, 90)), None, None, None, None), (4, "long " + " ".join(prose(r, 50_000)), "s", 0, "h", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, text_key string, node string")
    docs = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == df.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert sorted((x.doc_id for x in docs.collect()), key=str) == [1, 4, None]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {x.doc_id for x in packed} == {1, 4, None}
