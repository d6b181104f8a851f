"""Token-ID files: ids ranked by frequency, in byte-aligned variable-length code with separate control bytes.

A folder holds two Parquet tables, so that any store Spark writes to can hold it and a lost
executor's files are written again by another:

``ranks``   rank, id, n: the ids of the corpus by falling count, then by id.
``blocks``  part, block, start_in_part, n_tokens, doc_ids, lengths, control, data: documents in
            ascending order of their id by (part, block). The code of a block is the
            concatenation of its documents' ranks. A rank takes 1 to 4 bytes in ``data``, least byte
            first; its number of bytes less 1 takes 2 bits of ``control``, the first rank's lowest.

Decoding reads the control bytes through a table of 256 rows (four lengths each) and gathers
each of the four byte planes by numpy.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, vocab

#: A block is closed when it has this many ids; a longer document is a block of its own length.
BLOCK_TOKENS = 65_536
#: Rows of texts or ids that the JVM reads at a time; at Spark's 4,096 their arrays take many MB and make its heap grow.
READER_ROWS = "512"
VOCABULARY = "word_bpe_49k.json"
END_ID = 1

_LENGTHS = np.stack([(np.arange(256)[:, None] >> (2 * np.arange(4))) & 3], axis=0)[0].astype(np.uint8) + 1


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of an array of ranks below 2^32."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    size = 1 + (ranks > 0xFF) + (ranks > 0xFFFF).astype(np.int8) + (ranks > 0xFFFFFF)
    two = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    two[: len(ranks)] = size - 1
    control = (two.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    planes = ranks.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), planes[np.arange(4) < size[:, None]].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks of (control, data)."""
    size = _LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    first = np.zeros(n, dtype=np.int64)
    np.cumsum(size[:-1], out=first[1:]) if n else None
    raw = np.frombuffer(data, dtype=np.uint8)
    out = raw[first].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        out[more] |= raw[first[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _encoder(vocabulary, dtype: str, end_id: int | None):
    """Batches of (doc_id, text) to (doc_id, ids, n): ids as compressed bytes; then (id, null, -count) for each id seen."""

    def run(batches):
        import zstandard

        chunks, pack = vocab.library_chunks(vocabulary.value, dtype), zstandard.ZstdCompressor(level=1).compress
        end = b"" if end_id is None else np.array([end_id], dtype=dtype).tobytes()
        width, counts = np.dtype(dtype).itemsize, np.zeros(1, dtype=np.int64)
        for batch in batches:
            ids, n = [], []
            for text in batch.column(1).to_pylist():
                raw = chunks.text(text) + end
                ids.append(raw)
                n.append(len(raw) // width)
            got = np.bincount(np.frombuffer(b"".join(ids), dtype=dtype), minlength=len(counts))
            got[: len(counts)] += counts
            counts, ids = got, [pack(raw) for raw in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(ids, pa.binary()), pa.array(n, pa.int64())], ["doc_id", "ids", "n"])
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.nulls(len(seen), pa.binary()), pa.array(-counts[seen], pa.int64())], ["doc_id", "ids", "n"])
        common.give_back()  # a worker that waits for its next task holds the cache of pieces only

    return run


def _writer(rank_of, dtype: str):
    """Batches of (doc_id, ids, n), in order, to blocks."""
    names = ["part", "block", "start_in_part", "n_tokens", "doc_ids", "lengths", "control", "data"]

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        part, block, start, unpack = TaskContext.get().partitionId(), 0, 0, zstandard.ZstdDecompressor().decompress
        doc_ids, arrays, held = [], [], 0

        def flush():
            nonlocal block, start, held
            ranks = rank_of.value[np.concatenate(arrays)] if arrays else np.zeros(0, dtype=np.uint32)
            control, data = encode_ranks(ranks)
            row = [[part], [block], [start], [len(ranks)], [list(doc_ids)], [[len(a) for a in arrays]], [control], [data]]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names)
            block, start, held = block + 1, start + len(ranks), 0
            doc_ids.clear()
            arrays.clear()
            return out

        for batch in batches:
            for doc_id, ids, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                doc_ids.append(doc_id)
                arrays.append(np.frombuffer(unpack(ids, max_output_size=max(1, n * np.dtype(dtype).itemsize)), dtype=dtype) if n else np.zeros(0, dtype=dtype))
                held += n
                if held >= BLOCK_TOKENS:
                    yield flush()
        if doc_ids:
            yield flush()
        common.give_back()

    return run


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the token files of ``docs`` to ``path``, in ascending order of the id (nulls first; equal ids in any order).

    A null text counts as empty; each document ends in ``end_id`` if one is given. An empty table
    gives a folder without rows. Other columns are not read.
    """
    spark = docs.sparkSession
    text = vocab.read(vocabulary)
    top = max(vocab.tokenizer(text).get_vocab_size(with_added_tokens=True), (end_id or 0) + 1)
    dtype = "<u2" if top <= 1 << 16 else "<u4"
    shared = spark.sparkContext.broadcast(text)
    plain = docs.select(common.col(id_col).cast("long").alias("doc_id"), common.col(text_col).cast("string").alias("text"))
    with common.small_batches(spark, READER_ROWS):
        encoded = common.written(plain.mapInArrow(_encoder(shared, dtype, end_id), "doc_id long, ids binary, n long"), "token-ids")

    counted = encoded.where("ids is null").groupBy(F.col("doc_id").alias("id")).agg((-F.sum("n")).alias("n"))
    # One row for each id of the vocabulary, at most 2^16 or so.
    pairs = sorted(((r.id, r.n) for r in counted.collect()), key=lambda p: (-p[1], p[0]))
    schema = "rank long, id long, n long"
    spark.createDataFrame([(k, i, n) for k, (i, n) in enumerate(pairs)], schema).coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(top, dtype=np.uint32)
    for k, (i, _) in enumerate(pairs):
        rank_of[i] = k
    ranks = spark.sparkContext.broadcast(rank_of)
    with common.small_batches(spark, READER_ROWS):
        (
            encoded.where("ids is not null").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
            .mapInArrow(_writer(ranks, dtype), "part int, block long, start_in_part long, n_tokens long, doc_ids array<long>, lengths array<long>, control binary, data binary")
            .write.option("compression", "zstd").parquet(f"{path}/blocks")
        )


def _each_block(batches):
    """Blocks as dictionaries, one at a time: how many a batch holds depends on the settings of whoever reads."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}
    common.give_back()


def _reader(id_of):
    """Blocks to (doc_id, start, n_tokens, ids_crc32)."""

    def run(batches):
        for block in _each_block(batches):
            ranks = decode_ranks(block["control"], block["data"], block["n_tokens"])
            raw, at, starts, sums = id_of.value[ranks].astype("<u4", copy=False).tobytes(), 0, [], []
            for n in block["lengths"]:
                starts.append(block["start"] + at)
                sums.append(zlib.crc32(memoryview(raw)[4 * at : 4 * (at + n)]))
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (block["doc_ids"], starts, block["lengths"], sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def _id_table(spark: SparkSession, path: str):
    """The id of each rank; as long as the vocabulary at most."""
    rows = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    return spark.sparkContext.broadcast(np.array([r.id for r in rows], dtype="<u4"))


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a folder with ``start``: the ids of all documents before the block."""
    found = spark.read.parquet(f"{path}/blocks")
    sizes = found.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each file
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    return found.join(F.broadcast(before), "part").withColumn("start", F.col("part_start") + F.col("start_in_part"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    wanted = blocks(spark, path).select("start", "n_tokens", "doc_ids", "lengths", "control", "data")
    return wanted.mapInArrow(_reader(_id_table(spark, path)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every document, decoded from the files."""
    id_of = _id_table(spark, path)

    def run(batches):
        for block in _each_block(batches):
            ids, at, out = id_of.value[decode_ranks(block["control"], block["data"], block["n_tokens"])].astype(np.int32), 0, []
            for n in block["lengths"]:
                out.append(ids[at : at + n])
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(block["doc_ids"], pa.int64()), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return spark.read.parquet(f"{path}/blocks").mapInArrow(run, "doc_id long, ids array<int>")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: documents written as token files and read back."""
    path = common.path(spark, "token-files")
    write(common.table(spark, sf_dir, "documents", "doc_id", "text"), path)
    return documents(spark, path)
