"""Best-fit packing into sequences of several permitted lengths.

Documents are dealt to blocks of some BLOCK_ITEMS pieces by a hash of their ids and texts, so that the number of
blocks grows with the corpus, a block fits one task, and neither files nor partitions change the packing; each block
is packed on its own. Pieces come by falling length. A piece goes to the
open bin that it fills best; if none has room, a bin of the size with the least cost per token
that it can be expected to hold is opened. Each block is packed once for each set of sizes that holds its longest
piece, the cheapest packing is taken, and each bin is then cut down to the smallest permitted size that holds its contents.
"""

from __future__ import annotations

import itertools
import math
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vocab

#: Permitted lengths, and what a bin costs: its length, a fixed part, and attention's square.
SIZES = (512, 1024, 2048, 4096, 8192)
FIXED, SQUARE = 16.0, 1 / 65536
BLOCK_ITEMS = 2048
#: Permitted lengths at most: a block is packed for each set of them.
MOST_SIZES = 8
VOCABULARY = "word_bpe_49k.json"


def cost(size: int) -> float:
    return size + FIXED + SQUARE * size * size


def pack(lengths: list[int], sizes: tuple[int, ...] = SIZES) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, offset of each piece in its bin, size of each bin) for lengths from 1 to max(sizes).

    Equal lengths are taken in the order given; no lengths give no bins. The work is that of sorting for each set of sizes.
    """
    sizes = tuple(sorted(set(sizes)))
    if len(sizes) > MOST_SIZES:
        raise ValueError(f"more than {MOST_SIZES} sizes")
    order = sorted(range(len(lengths)), key=lambda k: (-lengths[k], k))
    if order and lengths[order[0]] > sizes[-1]:
        raise ValueError("a piece is longer than the largest size")
    best = None
    for some in itertools.chain.from_iterable(itertools.combinations(sizes, n) for n in range(1, len(sizes) + 1)):
        if order and lengths[order[0]] > some[-1]:
            continue
        bins, offsets, used = _pack(lengths, order, some)
        cut = [sizes[bisect_left(sizes, u)] for u in used]
        total = sum(map(cost, cut))
        if best is None or total < best[0]:
            best = total, (bins, offsets, cut)
    return best[1]


def _pack(lengths, order, sizes):
    """(bin and offset of each piece, tokens in each bin)."""
    falling = [lengths[k] for k in order]
    after = [0] * (len(order) + 1)  # tokens from the k-th piece on
    for k in range(len(order) - 1, -1, -1):
        after[k] = after[k + 1] + falling[k]
    rising = falling[::-1]
    bins, offsets, used, size_of, room = [0] * len(lengths), [0] * len(lengths), [], [], []
    free = 0  # room in open bins
    for at, k in enumerate(order):
        n = lengths[k]
        j = bisect_left(room, (n, -1))
        if j < len(room):
            left, b = room.pop(j)
            free -= left
        else:
            def per_token(size, n=n, at=at):
                left = size - n
                fitting = len(order) - bisect_left(rising, left + 1)  # the first piece that is short enough
                usable = max(0, after[max(at + 1, fitting)] - free)
                return cost(size) / (n + min(left, usable)), size
            size = min((s for s in sizes if s >= n), key=per_token)
            left, b = size, len(used)
            used.append(0)
            size_of.append(size)
        bins[k], offsets[k] = b, used[b]
        used[b] += n
        left -= n
        if left:
            insort(room, (left, b))
            free += left
    return bins, offsets, used


def lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text_key, n_tokens) of every row of ``docs`` (doc_id, text), by the library; null counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab.read(vocabulary))

    def run(batches):
        counts = vocab.library_counts(shared.value)
        for batch in batches:
            n = [counts.count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "text_key", "n_tokens"])

    text = F.col("text").cast("string")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.md5(text.cast("binary")).alias("text_key"))
    return plain.mapInArrow(run, "doc_id long, text_key string, n_tokens long")


def pack_documents(docs: DataFrame, sizes: tuple[int, ...] = SIZES, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, n_tokens, block, bin, bin_size, bin_offset): where each piece of each row of ``docs`` goes.

    A document longer than the largest size is cut into pieces of that size and the rest. One without
    tokens (null or empty text) has one row whose bin, bin_size and bin_offset are null. Repeated rows
    are packed each for itself; which of them gets which place is not told apart. Empty table: empty result.
    Columns besides doc_id and text are not read.
    """
    top = max(sizes)
    with common.small_batches(docs.sparkSession):
        measured = common.written(lengths(docs, vocabulary), "lengths")
    pieces = measured.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / top)))).first()[0] or 0
    blocks = max(1, math.ceil(pieces / BLOCK_ITEMS))
    # Rows that repeat id and text are counted first and then numbered, so that no task gathers them.
    same = measured.groupBy("doc_id", "text_key", "n_tokens").agg(F.count(F.lit(1)).alias("c"))
    rows = same.select("doc_id", "text_key", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("c"))).alias("copy"))
    cut = (
        rows.select("doc_id", "text_key", "copy", "n_tokens", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / top).cast("long") - 1))).alias("piece"))
        .select("doc_id", "text_key", "copy", "piece", (F.col("piece") * top).alias("start"), F.least(F.lit(top), F.col("n_tokens") - F.col("piece") * top).alias("n_tokens"))
    )
    empty = cut.where("n_tokens = 0").select("doc_id", "piece", "start", "n_tokens", *[F.lit(None).cast("int").alias(c) for c in ("block", "bin", "bin_size", "bin_offset")])
    order = [("n_tokens", "descending"), *((c, "ascending") for c in ("doc_id", "text_key", "copy", "piece"))]

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        bins, offsets, size_of = pack(table["n_tokens"].to_pylist(), sizes)
        found = {"bin": bins, "bin_size": [size_of[b] for b in bins], "bin_offset": offsets}
        table = table.select(["doc_id", "piece", "start", "n_tokens", "block"])
        for name, values in found.items():
            table = table.append_column(name, pa.array(values, pa.int32()))
        return table

    full = cut.where("n_tokens > 0").withColumn("block", F.pmod(F.xxhash64("doc_id", "text_key", "copy", "piece"), F.lit(blocks)).cast("int"))
    out = full.groupBy("block").applyInArrow(packed, "doc_id long, piece long, start long, n_tokens long, block int, bin int, bin_size int, bin_offset int")
    return out.unionByName(empty)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: all documents packed."""
    return pack_documents(common.table(spark, sf_dir, "documents", "doc_id", "text"))
