import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tilewright.llm import common, prefix_bpe, token_files, vocab

TEXTS = [
    None, "", " ", "The theater of thanedble thing's end. It'll re'd I'm", "straße ÉÇA éèê ñ ﬁ ŉ İ Σίσυφος ΟΔΟΣ", "x" * 3000, "a b c\x1cd\x85e",
    "<|startoftext|>odd <|endoftext|><|endoftext|>.", "é ́x ño", "日本語のテキスト 12 345٣", "tab\tand\r\nlines\n\nhere  ", "%%% *** &&& word%%% (x) \"q\" 'tis don't DON'T", "😀😀 a😀b ퟿", "\x00\x01 ok",
    "can't've ''s 's.s", "anananananan ththththth inginging" * 3,
]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    alphabet = "abcdeginorstuthé ß.',!?1\n\t%-"
    return TEXTS + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 300))) for _ in range(300)]


@pytest.fixture(scope="module")
def library():
    return vocab.tokenizer(vocab.read("word_bpe_49k.json"))


def ids_of(library, t):
    return library.encode(t or "", add_special_tokens=False).ids


def test_codec_equals_the_library(texts, library):
    own = prefix_bpe.codec(vocab.read("word_bpe_49k.json"))
    for t in texts:
        ids = ids_of(library, t)
        got = own.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == ids, t
        assert own.decode(got).decode() == library.decode(ids, skip_special_tokens=False)


def test_prefixes_are_the_textbook_loop():
    own = prefix_bpe.codec(vocab.read("word_bpe_49k.json")).bpe
    r = random.Random(3)
    for _ in range(1500):
        w = "".join(r.choice(["th", "er", "an", "in", "a", "e", "s", "tion", "q"]) for _ in range(r.randint(1, 9)))
        assert own.encode(w) == own.merged(w[:-1] + chr(ord(w[-1]) + prefix_bpe.MARK))


def test_small_tables_give_the_same(texts, monkeypatch, library):
    monkeypatch.setattr(prefix_bpe, "PREFIXES", 5)
    monkeypatch.setattr(prefix_bpe, "PAIRS", 3)
    monkeypatch.setattr(vocab, "CACHE_ENTRIES", 4)
    own = prefix_bpe.Codec(vocab.read("word_bpe_49k.json"), prefix_bpe.codec(vocab.read("word_bpe_49k.json")).bpe.usable)
    assert all(np.frombuffer(own.encode(t), "<u4").tolist() == ids_of(library, t) for t in texts[:60])


def test_rank_code_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (r.integers(0, 1 << 32, n) >> r.integers(0, 32, n)).astype(np.uint32)
        control, data = token_files.encode_ranks(x)
        assert len(control) == -(-n // 4) and (token_files.decode_ranks(control, data, n) == x).all()


def test_files(spark, tmp_path, texts, library, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", 500)
    rows = [(7 * i % 1009, t, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(5)
    path = str(tmp_path / "files")
    token_files.write(df, path)
    got = sorted(token_files.documents(spark, path).collect())
    start = 0
    for (doc_id, t, _), r in zip(sorted(rows, key=lambda x: x[0]), got, strict=True):
        ids = [*ids_of(library, t), 1]
        assert tuple(r) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    order = [r.n for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()]
    assert order == sorted(order, reverse=True) and sum(order) == start
    assert {r.doc_id: list(r.ids) for r in token_files.read_ids(spark, path).collect()} == {d: [*ids_of(library, t), 1] for d, t, _ in rows}


def test_files_of_nothing_and_null_ids(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    token_files.write(df, str(tmp_path / "a"))
    assert token_files.documents(spark, str(tmp_path / "a")).count() == 0
    df = spark.createDataFrame([(None, "a b"), (1, None), (1, None)], "doc_id long, text string")
    token_files.write(df, str(tmp_path / "b"))
    assert sorted((r.doc_id or 0, r.start, r.n_tokens) for r in token_files.documents(spark, str(tmp_path / "b")).collect()) == [(0, 0, 3), (1, 3, 1), (1, 4, 1)]


def test_files_take_small_batches_and_one_block_at_a_time(spark, tmp_path, monkeypatch):
    most, real, held = int(common.BATCH_ROWS), {k: getattr(token_files, k) for k in ("_encoder", "_writer")}, []

    def watched(name):
        def made(*a):
            held.append(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize"))
            run = real[name](*a)

            def seen(batches):
                for b in batches:
                    if b.num_rows > most:
                        raise ValueError(f"{name} got {b.num_rows} rows at once")
                    yield b

            return lambda batches: run(seen(batches))

        return made

    for name in real:
        monkeypatch.setattr(token_files, name, watched(name))
    settings = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(k) for k in settings]
    token_files.write(spark.range(0, 3 * most, 1, 1).selectExpr("id doc_id", "concat('row ', id) text"), str(tmp_path / "files"))
    assert held == [token_files.READER_ROWS] * 2 and [spark.conf.get(k) for k in settings] == before
    assert token_files.documents(spark, str(tmp_path / "files")).count() == 3 * most

    class ids_of:
        value = np.arange(100, 200, dtype="<u4")

    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    control, data = token_files.encode_ranks(np.arange(5))
    block = {"start": 10, "n_tokens": 5, "doc_ids": [7, 8, 9], "lengths": [2, 0, 3], "control": control, "data": data}
    got = list(token_files._reader(ids_of)(iter([pa.RecordBatch.from_pylist([block, block | {"start": 15}])])))
    sums = [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ([100, 101], [], [102, 103, 104])]
    assert [b.to_pydict() for b in got] == [{"doc_id": [7, 8, 9], "start": [s, s + 2, s + 2], "n_tokens": [2, 0, 3], "ids_crc32": sums} for s in (10, 15)]
    assert given == [1]


def test_digests(spark, texts, library):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in prefix_bpe.digests(df).collect():
        ids = ids_of(library, texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert prefix_bpe.digests(df.limit(0)).count() == 0
    assert list(prefix_bpe.encode(df).where("doc_id = 3").first().ids) == ids_of(library, texts[3])
