"""N-gram Jaccard join with adaptive multi-match prefixes, and the components of its links.

1. Every text becomes the set of its word shingles, as 64-bit hashes. Equal sets are one class.
2. All documents share one order of shingles: seldom ones first. A shingle's frequency is its count where it is known
   to be frequent, or else what the frequencies of its words make likely: one with a seldom word is nearly always
   alone. Counts of words and shingles come from a pass over all documents that keeps what is
   frequent where it is read; the order only steers cost, any order gives the same links. It is made of
   integers that the driver works out, so that all executors agree on it.
3. Sets x and y that link at t share o >= t / (1 + t) * (|x| + |y|) shingles. With a larger partner a set shares
   2t / (1 + t) of its own at least, with a smaller one t of them. So the first |x| - ceil(2t / (1 + t) * |x|) + l
   of the smaller set (its short prefix) and the first |y| - ceil(t * |y|) + l of the larger (its long prefix) have
   l in common at least. Each class takes the l whose longer prefix is expected to cost least: entries to
   scan, and candidates to verify, of which there are fewer the more matches are asked for. A pair
   must share as many prefix shingles as the smaller l of the two.
4. Two bounds on o, exact on integers, are conditions of the join itself, so that near misses never leave it: a
   prefix shingle's places in both sets bound what can be shared after it; and each class carries the parities of
   its shingles in BITS buckets, of which at most |x| + |y| - 2o can differ.
5. Candidates are verified on the whole sets, read again from the texts. Before all of them are made, some rounds
   verify one candidate for each component, along the shared shingles' leaders; then only pairs of classes of
   different components are made at all. So a group of many near copies never becomes all its pairs, and no
   link between components is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .graph import components

#: Words and shingles counted at once where they are read, the least count that is passed on from there, and the most
#: frequent ones of each that are kept for the order.
FLUSH, LOCAL, FREQUENT = 1_000_000, 3, 200_000
#: Prefix matches that may be asked for, what verifying costs against scanning an entry, and the partners that
#: a shingle has at least when it is thought to have none.
MATCHES, VERIFY, BACKGROUND = (1, 2, 3, 4, 6), 1.0, 0.01
#: Buckets whose parities a class carries, in longs of 64.
BITS = 512
#: Rounds that verify one candidate for each component before all others are made.
ROUNDS = 1
#: Tables of at most this many narrow rows are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 100_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 200_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


_words = _Words()
common.cached(__name__, _words.clear)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(text: str | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, hash of each window of ``size`` words, or of the whole sequence if it is shorter)."""
    words = text.encode().translate(_LOWER).split() if text else []
    n = len(words)
    w = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=n)
    if not n:
        return w, w
    k = min(size, n)
    h = np.full(n - k + 1, k, dtype=np.uint64)
    for j in range(k):
        h += w[j : n - k + 1 + j] * _ODD[j]
    return w, _mixed(h)


def shingles(text: str | None, size: int) -> np.ndarray:
    """The text's distinct shingles, sorted; with fewer words than ``size`` the whole sequence is one."""
    return np.unique(_hashed(text, size)[1])


def _counting(size: int):
    """Texts to (kind, token, n): kind 0 words, 1 shingles (once a text), 2 the number of words."""

    def run(batches):
        common.begin(__name__)
        held, n, total = ([], []), 0, 0

        def flush():
            for kind, arrays in enumerate(held):
                found, counts = np.unique(np.concatenate(arrays), return_counts=True)
                often = counts >= LOCAL
                yield pa.RecordBatch.from_arrays([pa.array(np.full(often.sum(), kind), pa.int32()), pa.array(found[often].view(np.int64)), pa.array(counts[often], pa.int64())], ["kind", "token", "n"])
                arrays.clear()

        for batch in batches:
            for text in batch.column(0):
                words, windows = _hashed(text.as_py(), size)
                held[0].append(words)
                held[1].append(np.unique(windows))
                n += len(words)
                total += len(words)
                if n >= FLUSH:
                    yield from flush()
                    n = 0
        if held[0]:
            yield from flush()
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0], pa.int64()), pa.array([total], pa.int64())], ["kind", "token", "n"])

    return run


def _steps(counts) -> np.ndarray:
    """Logarithms of counts in whole quarters of a factor of 2; only the driver computes them."""
    return np.ceil(4 * np.log2(np.maximum(np.asarray(counts, dtype=np.float64), 1.0))).astype(np.int64)


class _Known:
    """Steps of the counts of some hashes; 0 for all others. A table by their lowest bits, a few to a place."""

    MASK = np.uint64((1 << 20) - 1)

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        place = (tokens & self.MASK).astype(np.int64)
        order = np.argsort(place, kind="stable")
        self.tokens, self.counts = tokens[order], _steps(counts[order]).astype(np.int32)
        held = np.bincount(place, minlength=int(self.MASK) + 1)
        self.first, self.held = (np.cumsum(held) - held).astype(np.int32), np.minimum(held, 1 << 15).astype(np.int16)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), dtype=np.int64)
        place = (h & self.MASK).astype(np.int64)
        held = self.held[place]
        open_ = np.flatnonzero(held)
        at, left, k = self.first[place[open_]], held[open_], 0
        while len(open_):
            hit = self.tokens[at + k] == h[open_]
            out[open_[hit]] = self.counts[at[hit] + k]
            k += 1
            more = ~hit & (left > k)
            open_, at, left = open_[more], at[more], left[more]
        return out


class Order:
    """The common order of shingles: by frequency, known or likely, in steps of a quarter of a factor of 2; then by hash."""

    #: Steps below which all shingles are equally seldom, and above which frequencies aren't told apart.
    LEAST, MOST = -80, 160

    def __init__(self, shingles: tuple[np.ndarray, np.ndarray], words: tuple[np.ndarray, np.ndarray], total: int):
        self.shingles, self.words, self.total = _Known(*shingles), _Known(*words), int(_steps([max(1, total)])[0])
        self.frequency = 2.0 ** (np.arange(self.LEAST, self.MOST + 1) / 4)

    def sort(self, words: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distinct shingles in order, their frequencies)."""
        h, first = np.unique(windows, return_index=True)
        p = self.words(words) - self.total
        k = len(words) - len(windows) + 1  # words of a shingle
        likely = np.sum([p[j : len(p) - k + 1 + j] for j in range(k)], axis=0)[first] + self.total
        known = self.shingles(h)
        step = np.clip(np.where(known > 0, np.maximum(known, likely), likely), self.LEAST, self.MOST)
        order = np.argsort(step, kind="stable")  # h is sorted by hash already
        return h[order], self.frequency[step[order] - self.LEAST]


def required(n: int, part: int, whole: int) -> int:
    """The least overlap of a set of ``n`` with one that it links with."""
    return -(-part * n // whole)


def required_above(n: int, part: int, whole: int) -> int:
    """The same with one that is as large at least."""
    return -(-2 * part * n // (part + whole))


def prefix(h: np.ndarray, frequency: np.ndarray, part: int, whole: int) -> tuple[np.ndarray, int, int]:
    """(long prefix, length of the short one, matches to ask for) of a set in the common order."""
    n, need = len(h), required(len(h), part, whole)
    best = None
    for ell in MATCHES:
        if ell > need:
            break
        end = n - need + ell
        cost = float((frequency[:end] + BACKGROUND).sum()) * (1 + VERIFY / (ell * ell))
        if best is None or cost < best[0]:
            best = (cost, end, ell)
    return h[: best[1]], n - required_above(n, part, whole) + best[2], best[2]


def parities(h: np.ndarray) -> np.ndarray:
    """BITS parities of the numbers of shingles in buckets, in longs."""
    odd = (np.bincount((h & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


_LONGS = range(BITS // 64)
_DESCRIBED = f"doc_id long, text_key string, n long, sig binary, prefix array<long>, short int, ell int, bits struct<{', '.join(f'b{k}: bigint' for k in _LONGS)}>"


def _describing(size: int, part: int, whole: int, order):
    def run(batches):
        import xxhash

        common.begin(__name__)
        for batch in batches:
            sizes, sigs, prefixes, shorts, ells = [], [], [], [], []
            bits = np.zeros((batch.num_rows, len(_LONGS)), dtype=np.int64)
            for k, text in enumerate(batch.column(2)):
                words, windows = _hashed(text.as_py(), size)
                if len(windows):
                    h, frequency = order.value.sort(words, windows)
                    p, short, ell = prefix(h, frequency, part, whole)
                    bits[k] = parities(h)
                else:
                    h, p, short, ell = windows, windows, 0, 0
                sizes.append(len(h))
                sigs.append(xxhash.xxh3_128_digest(np.sort(h).tobytes()))
                prefixes.append(p.view(np.int64))
                shorts.append(short)
                ells.append(ell)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(shorts, pa.int32()), pa.array(ells, pa.int32()),
                    pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(bits[:, k])) for k in _LONGS], [f"b{k}" for k in _LONGS]),
                ],
                ["doc_id", "text_key", "n", "sig", "prefix", "short", "ell", "bits"],
            )

    return run


def _sets(size: int):
    def run(batches):
        common.begin(__name__)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py(), size).tobytes() for t in batch.column(1)], pa.binary())], ["node", "set"])

    return run


def _verifying(part: int, whole: int):
    def run(batches):
        common.begin(__name__)
        for batch in batches:
            keep, left, right = [], batch.column(2), batch.column(3)
            for k in range(batch.num_rows):  # views of the batch, not copies
                x, y = (np.frombuffer(c[k].as_buffer(), dtype=np.uint64) for c in (left, right))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if whole * both >= part * (len(x) + len(y) - both):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], ["a", "b"])

    return run


def small(df: DataFrame, width: int = 1) -> DataFrame:
    """``df`` marked for broadcast if it is small; ``df`` is a written table whose rows count ``width`` times."""
    return F.broadcast(df) if df.count() * width <= BROADCAST_ROWS else df


class Join:
    """One join over ``docs`` (doc_id, text): sets of ``size`` words that link at part / whole or more."""

    def __init__(self, docs: DataFrame, size: int, part: int, whole: int):
        self.size, self.part, self.whole = size, part, whole
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        self.plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text.cast("binary")).alias("text_key"), text.alias("text"))
        self.spark = docs.sparkSession

    def run(self) -> tuple[DataFrame, DataFrame]:
        """(rows: doc_id, text_key, n, sig; classes: sig, rid, src_key, n, comp)."""
        rows = self._rows()
        classes = self._classes(rows)
        return rows.select("doc_id", "text_key", "n", "sig"), self._labelled(classes, self._entries(classes))

    def links(self) -> tuple[DataFrame, DataFrame]:
        """(links: a, b, nodes of two classes; members: doc_id, text_key, node): every link between different sets.

        A link is there once; rows without words are members of none.
        """
        rows = self._rows()
        classes = self._classes(rows)
        entries = self._entries(classes)
        pairs = common.written(self._all_pairs(entries, classes, None), "pairs")
        found = self._verified(pairs, classes)
        members = rows.where("n > 0").join(classes.select("sig", "node"), "sig").select("doc_id", "text_key", "node")
        return self.spark.createDataFrame([], "a long, b long") if found is None else found, members

    def _rows(self) -> DataFrame:
        counted = self.plain.select("text").mapInArrow(_counting(self.size), "kind int, token long, n long").groupBy("kind", "token").agg(F.sum("n").alias("n"))
        with common.small_batches(self.spark):
            counted = common.written(counted, "word-counts")

        def most(kind: int) -> tuple[np.ndarray, np.ndarray]:
            top = counted.where(F.col("kind") == kind).orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
            return top["token"].to_numpy().view(np.uint64), top["n"].to_numpy()

        total = counted.where("kind = 2").agg(F.sum("n")).first()[0] or 0
        shared = self.spark.sparkContext.broadcast(Order(most(1), most(0), total))
        common.discard(counted)
        with common.small_batches(self.spark):
            return common.written(self.plain.mapInArrow(_describing(self.size, self.part, self.whole, shared), _DESCRIBED), "shingle-rows")

    def _classes(self, rows: DataFrame) -> DataFrame:
        first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key"))
        grouped = rows.where("n > 0").groupBy("sig").agg(first.alias("f"), F.first(F.struct("n", "prefix", "short", "ell", "bits")).alias("d"))
        return common.written(
            grouped.select(F.monotonically_increasing_id().alias("node"), "sig", F.col("f.doc_id").alias("rid"), F.col("f.text_key").alias("src_key"), "d.n", "d.prefix", "d.short", "d.ell", "d.bits"), "shingle-classes"
        )

    def _entries(self, classes: DataFrame) -> DataFrame:
        """(token, node, n, ell, at, short) of prefix shingles that two classes may meet at, one of them in its short prefix."""
        entries = classes.select("node", "n", "ell", "short", F.posexplode("prefix").alias("at", "token")).withColumn("short", F.col("at") < F.col("short"))
        # One exchange of the entries at every size: a table of the shared shingles would be one more, and a join back to it a third.
        alike = Window.partitionBy("token")
        met = entries.withColumn("c", F.count(F.lit(1)).over(alike)).withColumn("led", F.max("short").over(alike)).where("c > 1 and led")
        return common.written(met.select("token", "node", "n", "ell", "at", "short"), "shared-entries")

    def _labelled(self, classes: DataFrame, entries: DataFrame) -> DataFrame:
        """``classes`` (sig, rid, src_key, n) with ``comp``, the smallest node of the component."""
        labels = tried = None
        for turn in range(ROUNDS):
            # One turn joins nearly all classes to the middles of their groups; more of them find little.
            pairs = common.written(self._leader_pairs(entries, classes, labels, tried, turn), "leader-pairs")
            links = self._verified(pairs, classes)
            both = pairs if tried is None else common.written(tried.union(pairs), "tried-pairs")
            if tried is not None:
                common.discard(tried, pairs)
            tried = both
            if links is None or links.isEmpty():
                break
            labels = self._merged(labels, links)
        pairs = self._all_pairs(entries, classes, labels)
        pairs = common.written(pairs.join(small(tried), ["a", "b"], "left_anti") if tried is not None else pairs, "pairs")
        common.discard(tried, entries)
        links = self._verified(pairs, classes)
        common.discard(pairs)
        if links is not None and not links.isEmpty():
            labels = self._merged(labels, links)
        out = common.written(_with_comp(classes.select("node", "sig", "rid", "src_key", "n"), labels).drop("node"), "labelled-classes")
        common.discard(labels, classes)
        return out

    def _may_link(self, x: str, y: str):
        """Whether the entries ``x`` and ``y`` (structs; x the smaller set) of a shared shingle allow that their sets link."""
        n = F.col(f"{x}.n") + F.col(f"{y}.n")
        matches = F.least(f"{x}.ell", f"{y}.ell", F.col(f"{x}.at") + 1, F.col(f"{y}.at") + 1)
        most = matches - 1 + F.least(F.col(f"{x}.n") - F.col(f"{x}.at"), F.col(f"{y}.n") - F.col(f"{y}.at"))
        size = F.lit(self.whole) * F.col(f"{x}.n") >= F.lit(self.part) * F.col(f"{y}.n")
        return F.col(f"{x}.short") & size & (F.lit(self.whole + self.part) * most >= F.lit(self.part) * n)

    def _parities_allow(self, n, x: str, y: str):
        """Whether the parities ``x`` and ``y`` of two sets of ``n`` shingles together allow that they link."""
        differ = sum((F.bit_count(F.col(f"{x}.b{k}").bitwiseXOR(F.col(f"{y}.b{k}"))) for k in _LONGS[1:]), F.bit_count(F.col(f"{x}.b0").bitwiseXOR(F.col(f"{y}.b0"))))
        return F.lit(self.whole + self.part) * (n - differ) >= F.lit(2 * self.part) * n

    def _before(self, x: str, y: str):
        return (F.col(f"{x}.n") < F.col(f"{y}.n")) | ((F.col(f"{x}.n") == F.col(f"{y}.n")) & (F.col(f"{x}.node") < F.col(f"{y}.node")))

    def _leader_pairs(self, entries: DataFrame, classes: DataFrame, labels: DataFrame | None, tried: DataFrame | None, turn: int) -> DataFrame:
        """For each class the pair with the leader of another component that it shares most prefix shingles with: a < b by (n, node).

        A class whose shared shingles come early in its order has few of its own, and is near the middle of its group: it
        leads in every second turn. In the others leaders are drawn by hash, each time others.
        """
        e = _with_comp(entries, labels)
        rank = F.xxhash64("node", F.lit(turn)) if turn % 2 else F.floor(F.col("at") * 1000 / F.col("n"))
        first = F.min(F.struct(rank.alias("rank"), "node", "n", "ell", "at", "short", "comp"))
        lead = e.groupBy("token").agg(first.alias("l"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token", "l")
        lead = common.written(lead, "leaders")
        e = e.select("token", F.struct("node", "n", "ell", "at", "short", "comp").alias("e"))
        able = F.when(self._before("l", "e"), self._may_link("l", "e")).otherwise(self._may_link("e", "l"))
        met = e.join(small(lead, 2), (e["token"] == lead["token"]) & (F.col("e.comp") != F.col("l.comp")) & able)
        counted = met.select(F.col("e.node").alias("node"), F.col("e.n").alias("n"), F.col("l.node").alias("lead"), F.col("l.n").alias("lead_n")).groupBy("node", "n", "lead", "lead_n").agg(F.count(F.lit(1)).alias("c"))
        bits = classes.select("node", "bits")
        both = counted.join(bits.select("node", F.col("bits").alias("x")), "node").join(bits.select(F.col("node").alias("lead"), F.col("bits").alias("y")), "lead")
        both = both.where(self._parities_allow(F.col("n") + F.col("lead_n"), "x", "y"))
        before = (F.col("lead_n") < F.col("n")) | ((F.col("lead_n") == F.col("n")) & (F.col("lead") < F.col("node")))
        a, b = (F.when(before, F.col(x)).otherwise(F.col(y)) for x, y in (("lead", "node"), ("node", "lead")))
        able = both.select("node", a.alias("a"), b.alias("b"), "c")
        if tried is not None:
            able = able.join(small(tried), ["a", "b"], "left_anti")
        best = able.groupBy("node").agg(F.max(F.struct("c", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))).alias("x"))
        return best.select((-F.col("x.a")).alias("a"), (-F.col("x.b")).alias("b")).distinct()

    def _all_pairs(self, entries: DataFrame, classes: DataFrame, labels: DataFrame | None) -> DataFrame:
        """All pairs of classes of different components that share enough prefix shingles and that the bounds allow: a < b by (n, node)."""
        e = _with_comp(entries, labels)
        open_tokens = common.written(e.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("short").alias("short")).where("lo < hi and short").select("token"), "open-shingles")
        e = e.join(small(open_tokens), "token", "left_semi").join(classes.select("node", "bits"), "node")
        e = common.written(e, "open-entries")
        common.discard(open_tokens)
        entry = F.struct("node", "n", "ell", "at", "short", "bits", "comp")
        x, y = e.where("short").select("token", entry.alias("x")), e.select("token", entry.alias("y"))
        able = self._before("x", "y") & self._may_link("x", "y") & self._parities_allow(F.col("x.n") + F.col("y.n"), "x.bits", "y.bits")
        met = x.join(y, (x["token"] == y["token"]) & (F.col("x.comp") != F.col("y.comp")) & able)
        narrow = met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.least("x.ell", "y.ell").alias("ell"))
        return narrow.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.first("ell").alias("ell")).where("c >= ell").select("a", "b")

    def _verified(self, pairs: DataFrame, classes: DataFrame) -> DataFrame | None:
        """The written ``pairs`` (a, b) that link, by whole sets; None without pairs."""
        if pairs.isEmpty():
            return None
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        wanted = common.written(classes.select("node", F.col("src_key").alias("text_key")).join(nodes, "node", "left_semi"), "wanted")
        texts = self.plain.select("text_key", "text").join(small(wanted), "text_key").select("node", "text")
        # A class's source may stand in several rows; their sets are the same.
        sets = texts.mapInArrow(_sets(self.size), "node long, set binary").groupBy("node").agg(F.first("set").alias("set"))
        with common.small_batches(self.spark):
            sets = common.written(sets, "sets")
            joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
            out = common.written(joined.select("a", "b", "sa", "sb").mapInArrow(_verifying(self.part, self.whole), "a long, b long"), "links")
        common.discard(wanted, sets)
        return out

    def _merged(self, labels: DataFrame | None, links: DataFrame) -> DataFrame:
        """``labels`` after ``links``: components are contracted to their labels, so only those are joined."""
        of = lambda side: _with_comp(links.select(F.col(side).alias("node"), F.col("b" if side == "a" else "a").alias("other")), labels)
        own = _with_comp(of("a").select(F.col("comp").alias("ca"), F.col("other").alias("node")), labels)
        moved = common.written(components(own.select(F.col("ca").alias("a"), F.col("comp").alias("b"))), "moved").toDF("was", "root")
        new = moved.where("was <> root").select(F.col("was").alias("node"), F.col("root").alias("comp"))
        if labels is not None:
            old = labels.join(moved, labels["comp"] == moved["was"], "left").select("node", F.coalesce("root", "comp").alias("comp"))
            new = old.unionByName(new)
        out = common.written(new, "labels")
        common.discard(labels, links)
        return out


def _with_comp(df: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``df`` with the component of its ``node``; ``labels`` (node, comp) has those that aren't their own, which are few beside all."""
    if labels is None:
        return df.withColumn("comp", F.col("node"))
    return df.join(small(labels), "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def groups(docs: DataFrame, size: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_key, survivor) of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable by links (of the row's own set at least); a row without
    words is linked with nothing and has its own. Where no doc_id of a component is known it is null.
    ``survivor`` marks the rows that hold the component's smallest doc_id and its text. Repeated rows
    have the same values; an empty table gives an empty result; other columns are not read.
    """
    rows, classes = Join(docs, size, part, whole).run()
    # As many rows as there are components with a class besides its first.
    best = classes.groupBy("comp").agg(F.min(F.struct(F.col("rid").isNull().alias("unknown"), "rid", "src_key")).alias("first"))
    by_class = classes.select("sig", "comp").join(best, "comp").select("sig", F.col("first.rid").alias("component"), F.col("first.src_key").alias("src_key"))
    joined = rows.join(by_class, "sig", "left")
    empty = F.col("n") == 0
    return joined.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
        "text_key",
        (empty | (F.col("doc_id").eqNullSafe(F.col("component")) & (F.col("text_key") == F.col("src_key")))).alias("survivor"),
    )


def one_of_each(docs: DataFrame, size: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """The rows of ``docs`` that survive, with its columns, of any name: one text of each component, and all rows without words.

    Rows that repeat both id and text stay together; exact dedup comes before where they may not. Ids are
    integers; others raise. Null and empty texts stay; of a component without known ids the least text key
    stays; an empty table gives an empty result.
    """
    if docs.schema["doc_id"].dataType.typeName() not in ("long", "integer", "short", "byte"):
        raise TypeError("doc_id must be an integer")
    gone = common.written(groups(docs, size, part, whole).where("not survivor").select("doc_id", "text_key").distinct(), "near-copies")
    id_k, key_k = common.free_name(docs, "id_k"), common.free_name(docs, "key_k")
    gone = small(gone.toDF(id_k, key_k + "_r"))
    keyed = docs.withColumn(key_k, F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return keyed.join(gone, (F.col(key_k) == F.col(key_k + "_r")) & F.col("doc_id").cast("long").eqNullSafe(F.col(id_k)), "left_anti").select(*[common.col(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """op10: components of documents whose sets of 3-word shingles reach 90 %."""
    return groups(common.table(spark, sf_dir, "documents", "doc_id", "text"), 3, 90, 100).select("doc_id", "n_shingles", "component_id")


ORACLE = """
with recursive w as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents
), words as (
    select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as k from w
), s as (
    select distinct doc_id, g from (
        select doc_id, word || ' ' || lead(word) over o || ' ' || lead(word, 2) over o as g from words window o as (partition by doc_id order by k)
    ) where g is not null
    union all
    select doc_id, array_to_string(ws, ' ') from w where len(ws) between 1 and 2
), n as (
    select doc_id, count(*) as n from s group by doc_id
), met as (
    select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2
), links as (
    select a, b from met join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)
), both_ways as (
    select a, b from links union all select b, a from links
), reached as (
    select doc_id, doc_id as other from documents
    union
    select r.doc_id, e.b from reached r join both_ways e on e.a = r.other
)
select d.doc_id, coalesce(n.n, 0) as n_shingles, r.component_id
from documents d left join n using (doc_id) join (select doc_id, min(other) as component_id from reached group by doc_id) r using (doc_id)
"""
