"""Toxicity of texts whose words may be disguised: restore by a noisy channel, then score what was restored.

Restoring. A token with signs or digits in it, or with a letter three times in a row, and a row of single
letters between blanks, become a lattice: a sign may be a letter it looks like, or nothing; a repeated letter may be
dropped; each at a cost. Viterbi decoding finds the letters of least cost under the channel and a trigram
model of characters, counted over all texts of the corpus. Other tokens are their own letters. Where the form of a
token doesn't tell, each reading counts: signs at its ends as letters or as nothing, repeated letters once or twice;
a row of single letters is also cut into words, from each letter on, where a boundary costs less than joining.

Scoring. Each restored word has a weight (a token that of its best reading): the lower bound of the log odds that it, or a beginning of it, has among
toxic texts. A logistic model over a text's largest weights and their number gives the score. Weights
are fitted on one half of at most TRAIN_ROWS labelled rows, the logistic model on the other; near copies of a
text count once.
"""

from __future__ import annotations

import itertools
import math
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .prefix_join import shingles

#: Labelled rows used at most (those with the smallest hashes of their ids), and weights kept at most.
TRAIN_ROWS, WEIGHTS = 20_000, 200_000
#: Toxic texts that a word or beginning must be in to have a weight, and lengths of beginnings.
LEAST, BEGINNINGS = 3, (4, 5, 6)
#: Tables of at most this many narrow rows are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 500_000

#: Letters that a sign may stand for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "[": "c", "€": "e", "£": "l", "¢": "c", "§": "s", "¡": "i", "*": "aeiou", "#": "h", "^": "a",
}
#: Costs, in nats: a sign read as a letter it looks like, a repetition dropped, and a sign read as nothing: one that hardly
#: stands for anything but a letter, one that may also stand between letters, and any other. A letter costs some
#: 3 nats under the model, and a seldom one 10, so the first kind must cost more to leave out than to read.
AS_LETTER, DROPPED, SURE, UNSURE, AS_NOTHING = 1.0, 0.5, 14.0, 4.0, 0.5
_SURE = frozenset("0123456789@$€£¢§")
#: Signs at either end, and repeated letters of a word, that are read in every way.
EDGE, REPEATS = 3, 3
#: Characters of a row of single letters that a word in it is looked for in.
ROW = 16

#: Characters that are counted at once, and values of a batch that are taken from it at once.
PIECE, AT_ONCE = 1 << 20, 500

#: Characters of the model: 0 for what is no letter, a to z, ß to ÿ, and one for all other letters.
_ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
SYMBOLS = 64
_CODE = {c: k + 1 for k, c in enumerate(_ALPHABET)}
_OTHER = SYMBOLS - 1
_TABLE = np.zeros(0x250, dtype=np.uint8)
for _c in range(0x250):
    if chr(_c).isalpha():
        _TABLE[_c] = _CODE.get(chr(_c).lower(), _OTHER)


def code(c: str) -> int:
    return _CODE.get(c) or (_OTHER if c.isalpha() else 0)


def _letters(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    out = np.full(len(points), _OTHER, dtype=np.uint8)
    low = points < len(_TABLE)
    out[low] = _TABLE[points[low]]
    return out


def _pieces(texts: Iterable[str]) -> Iterator[np.ndarray]:
    """The codes of ``texts``, two blanks before all and after each, in arrays of at most PIECE and a few; each begins with the two codes before it."""
    held, n = [np.zeros(2, dtype=np.uint8)], 0
    for text in texts:
        for k in range(0, len(text), PIECE):
            part = text[k : k + PIECE]
            if n + len(part) > PIECE:
                yield (piece := np.concatenate(held))
                held, n = [piece[-2:]], 0
            held.append(_letters(part))
            n += len(part)
        held.append(np.zeros(2, dtype=np.uint8))
        n += 2
    yield np.concatenate(held)


def trigram_counts(texts: Iterable[str]) -> np.ndarray:
    """Counted in pieces, so that what is held doesn't grow with the texts."""
    total = np.zeros(SYMBOLS**3, dtype=np.int64)
    for piece in _pieces(texts):
        c = piece.astype(np.int32)
        before = np.where(c[1:-1] == 0, 0, c[:-2])  # words begin alike, whatever stands before them
        total += np.bincount((before * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:], minlength=SYMBOLS**3)
    return total


class CharacterModel:
    """-log P(c | a, b) of an interpolated trigram model."""

    def __init__(self, counts: np.ndarray):
        n3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
        n3[0, 0, 0] = 0
        n2, n1 = n3.sum(axis=0), n3.sum(axis=(0, 1))
        p1 = (n1 + 1) / (n1.sum() + SYMBOLS)
        p2 = (n2 + 5 * p1) / (n2.sum(axis=1, keepdims=True) + 5)
        p3 = (n3 + 5 * p2[None]) / (n3.sum(axis=2, keepdims=True) + 5)
        self.cost = (-np.log(p3)).astype(np.float32)

    def decode(self, token: str, core: tuple[int, int] | None = None, spaced: bool = False) -> str:
        """The letters of least cost for a lower-case token; signs outside of ``core`` that look like letters are letters.

        With ``spaced``, a boundary of words, a blank in the result, may stand between any two characters.
        """
        cost = self.cost
        states = {(0, 0): (0.0, None)}  # last two codes -> (cost, (letter, what came before))
        for k, c in enumerate(token):
            own, n = code(c), {}
            if own:
                arcs, nothing = [(c, own, 0.0)], DROPPED if k and token[k - 1] == c else None
            else:
                arcs, nothing = [(x, _CODE[x], AS_LETTER + math.log(len(LOOKS[c]))) for x in LOOKS.get(c, "")], SURE if c in _SURE else UNSURE if c in LOOKS else AS_NOTHING
                if core and c in LOOKS and not core[0] <= k < core[1]:
                    nothing = None
            if spaced:
                ends = [(t + float(cost[a, b, 0]), p) for (a, b), (t, p) in states.items() if b]
                if ends:
                    t, p = min(ends, key=lambda x: x[0])
                    if (0, 0) not in states or t < states[0, 0][0]:
                        states[0, 0] = (t, (" ", p))
            for (a, b), (total, path) in states.items():
                for letter, x, price in arcs:
                    t = total + price + float(cost[a, b, x])
                    old = n.get((b, x))
                    if old is None or t < old[0]:
                        n[b, x] = (t, (letter, path))
                if nothing is not None:
                    t = total + nothing
                    old = n.get((a, b))
                    if old is None or t < old[0]:
                        n[a, b] = (t, path)
            states = n
        _, path = min(((t + float(cost[a, b, 0]), p) for (a, b), (t, p) in states.items()), key=lambda x: x[0])
        out = []
        while path:
            out.append(path[0])
            path = path[1]
        return "".join(reversed(out))


_ENDS = ".,;:!?\"'()[]{}<>*#%$&|…-_/\\~=+^`«»“”‘’"
_STARTS = "\"'([{<«“‘.,;:-_/\\~=`*#%&"


def suspicious(word: str) -> bool:
    """Whether a stripped lower-case token is disguised, as far as its form tells."""
    return not word.isalpha() or any(word[k] == word[k + 1] == word[k + 2] for k in range(len(word) - 2))


_REPEATED = re.compile(r"(.)\1+")


def repeats(word: str) -> list[str]:
    """The word, then it with each repeated letter once or twice; where many are repeated, with all of them once or twice."""
    runs = list(_REPEATED.finditer(word))
    if not runs:
        return [word]
    if len(runs) > REPEATS:
        return [word, _REPEATED.sub(r"\1", word), _REPEATED.sub(r"\1\1", word)]
    pieces = [word[a:b] for a, b in zip([0, *(m.end() for m in runs)], [*(m.start() for m in runs), len(word)], strict=True)]
    return [word, *(pieces[0] + "".join(m[1] * n + p for m, n, p in zip(runs, times, pieces[1:], strict=True)) for times in itertools.product((1, 2), repeat=len(runs)))]


class Restorer(dict):
    """The restored word of each token between blanks; empty where nothing is left."""

    def __init__(self, model: CharacterModel):
        super().__init__()
        self.model, self.known = model, {}

    def restore(self, token: str) -> str:
        low = token.lower()
        word = low.rstrip(_ENDS)
        if word.isalpha() and not suspicious(word):
            return word
        word = low.lstrip(_STARTS).rstrip(_ENDS)
        if not word or not any(c.isalpha() for c in word) and len(word) > 12:
            return ""  # nothing but signs, or a number
        return self.model.decode(word) if suspicious(word) else word

    def readings(self, token: str) -> tuple[str, ...]:
        """All words that a token may stand for, the restored one first; none where nothing is left."""
        got = self.known.get(token)
        if got is None:
            got = tuple(dict.fromkeys(v for w in self._words(token) if w for v in repeats(w)))
            if len(token) <= 48:
                if len(self.known) >= 200_000:
                    self.known.clear()
                self.known[token] = got
        return got

    def _words(self, token: str) -> list[str]:
        """The restored word, and those with signs at the ends read as letters."""
        low, out = token.lower(), [self.restore(token)]
        if low.isalpha():
            return out
        start, end = len(low) - len(low.lstrip(_STARTS)), len(low.rstrip(_ENDS))
        if start >= end:  # nothing but signs: a word only if they differ
            return [*out, self.model.decode(low, (0, 0))] if len(low) <= 12 and len(set(low) & LOOKS.keys()) >= 3 else out
        if end - start > 12 and not any(c.isalpha() for c in low[start:end]):
            return out
        starts = [k for k in range(start) if low[k] in LOOKS][-EDGE:]
        ends = [k + 1 for k in range(end, len(low)) if low[k] in LOOKS][:EDGE]
        plain = [k for k in range(start, end) if low[k].isalnum()]
        first, last = (plain[0], plain[-1] + 1) if plain else (start, start)
        return out + [self.model.decode(low[i:j], (first - i, last - i)) for i in [start, *starts] for j in [end, *ends] if (i, j) != (start, end)]

    def __missing__(self, token: str) -> str:
        got = self.restore(token)
        if len(token) <= 48:
            if len(self) >= 400_000:
                self.clear()
            self[token] = got
        return got


def words_within(row: str, model: CharacterModel) -> set[str]:
    """From each character of a joined row, the first word of the least cost of joining or a boundary between any two characters of the next ROW."""
    first = (model.decode(row[k : k + ROW], spaced=True).split() for k in range(len(row)))
    return {w[0] for w in first if w and len(w[0]) >= 3}


def tokens(text: str, model: CharacterModel | None = None) -> list[str]:
    """Tokens between white space; three or more single characters in a row become one, those without an end of it, and the words within by ``model``."""
    found = text.split()
    singles = [k for k, t in enumerate(found) if len(t) == 1]
    if len(singles) < 3 or not any(b - a == 2 for a, b in zip(singles, singles[2:], strict=False)):
        return found
    out, k = [], 0
    while k < len(found):
        end = k
        while end < len(found) and len(found[end]) == 1:
            end += 1
        if end - k >= 3:
            row = "".join(found[k:end])
            out += [row, row[1:], row[:-1], row[1:-1]]  # a word of one letter may stand beside
            if model is not None and any(c.isalpha() for c in row):
                out += sorted(words_within(row.lower(), model) - set(out[-4:]))
            k = end
        else:
            out.append(found[k])
            k += 1
    return out


def _features(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:n] for n in BEGINNINGS if len(word) > n)]


def half_of(doc_id) -> int:
    return zlib.crc32(b"half" + str(doc_id).encode()) & 1


def squeezed(word: str) -> str:
    """The word with each repeated letter once."""
    return _REPEATED.sub(r"\1", word)


#: Signs at the end of a token that are never letters.
_NO_LETTERS = "".join(c for c in _ENDS if c not in LOOKS)


class Scorer(dict):
    """The weight of each token: the largest of its features' weights, 0 without any.

    Letters with plain signs behind them are their own reading, repetitions apart: for those, which are nearly all tokens,
    no lattice is made, and weights are kept by their letters. Readings that differ in repetitions begin alike
    without them, so where no weighted word or beginning does, the weight is 0.
    """

    def __init__(self, restorer: Restorer, weights: dict[str, float]):
        super().__init__()
        self.restorer, self.weights, self.plain = restorer, weights, {}
        self.starts = {squeezed(f[1:])[:4] for f in weights}

    def hopeless(self, word: str) -> bool:
        """Whether no reading of letters with repetitions has a weight."""
        s = squeezed(word)
        return len(s) >= 4 and self.starts.isdisjoint((s[:4], s[:3], s[:2], s[:1]))

    def weight(self, word: str) -> float:
        get, n = self.weights.get, len(word)
        best = get("=" + word, 0.0)
        for k in BEGINNINGS:
            if n <= k:
                break
            best = max(best, get("^" + word[:k], 0.0))
        return best

    def of_letters(self, word: str) -> float:
        if not _REPEATED.search(word):
            return self.weight(word)
        if self.hopeless(word):
            return 0.0
        return max(map(self.weight, self.restorer.readings(word)), default=0.0)

    def __missing__(self, token: str) -> float:
        word = token.lower().rstrip(_NO_LETTERS)
        if word.isalpha():
            got = self.plain.get(word)
            if got is None:
                got = self.of_letters(word)
                if len(word) <= 48:
                    if len(self.plain) >= 200_000:
                        self.plain.clear()
                    self.plain[word] = got
        else:  # signs at the end may be letters, but come after the others
            first = word.rstrip(_ENDS)
            got = 0.0 if first.isalpha() and self.hopeless(first) else max((self.weight(w) for w in self.restorer.readings(token)), default=0.0)
        if len(token) <= 48:
            if len(self) >= 200_000:
                self.clear()
            self[token] = got
        return got

    def figures(self, text: str | None) -> list[float]:
        """What the logistic model sees of a text."""
        found = tokens(text or "", self.restorer.model)
        w = np.fromiter(map(self.__getitem__, found), dtype=np.float64, count=len(found))
        w = np.sort(w[w > 0])[::-1]
        hits = int((w > 2).sum())
        return [float(w[0]) if len(w) else 0.0, float(w[:3].sum()), math.log1p(hits), 100.0 * hits / max(20, len(found)), math.log1p(len(found))]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, scales, coefficients with the constant last) by Newton's method."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    b, penalty = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ b)
        b = b + step
        if abs(step).max() < 1e-8:
            break
    return mean, scale, b


def _trigrams(batches):
    # A new model is made: what was kept for the last one is of no more use.
    common.begin(__name__, anew=bool(_restorers or _scorers))
    total = trigram_counts(t for batch in batches for t in _values(batch.column(0)) if t)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["k", "n"])


def _values(column: pa.Array) -> Iterator:
    """The values of a column, of which AT_ONCE are made from it at a time."""
    for k in range(0, len(column), AT_ONCE):
        yield from column.slice(k, AT_ONCE).to_pylist()


def character_model(docs: DataFrame) -> CharacterModel:
    """Counted over all texts; SYMBOLS^3 counts at most reach the driver."""
    counts = np.zeros(SYMBOLS**3, dtype=np.int64)
    for k, n in docs.select("text").mapInArrow(_trigrams, "k long, n long").groupBy("k").agg(F.sum("n")).collect():
        counts[k] = n
    return CharacterModel(counts)


#: In a Python worker: the restorer, and the scorer, of the model whose key was seen last.
_restorers: dict[str, Restorer] = {}
_scorers: dict[str, Scorer] = {}


def _forget() -> None:
    _restorers.clear()
    _scorers.clear()


common.cached(__name__, _forget)


def _restorer(shared) -> Restorer:
    """``shared``: a broadcast (key, model); keys are never used twice."""
    key, model = shared.value
    if key not in _restorers:
        _restorers.clear()
        _restorers[key] = Restorer(model)
    return _restorers[key]


def _keys(batches):
    common.begin(__name__)
    for batch in batches:
        first = [int(s.view(np.int64).min()) if len(s) else 0 for s in (shingles(t, 3) for t in _values(batch.column(2)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(first, pa.int64())], ["doc_id", "toxic", "key"])


def _counting(shared):
    def run(batches):
        common.begin(__name__)
        restorer = _restorer(shared)
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for doc_id, toxic, text in zip(*map(_values, batch.columns), strict=True):
                if half_of(doc_id):
                    continue
                words = {w for t in set(tokens(text or "", restorer.model)) for w in restorer.readings(t)}
                features = {f for w in words for f in _features(w)}
                for f in features:
                    counts.setdefault(f, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())], ["feature", "toxic", "clean"])

    return run


def _figuring(shared, weights):
    def run(batches):
        common.begin(__name__)
        scorer = Scorer(_restorer(shared), weights.value[1])
        for batch in batches:
            rows = [(toxic, scorer.figures(text)) for doc_id, toxic, text in zip(*map(_values, batch.columns), strict=True) if half_of(doc_id)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], ["toxic", "figures"])

    return run


def _scoring(shared, weights, model):
    mean, scale, b = model

    def run(batches):
        common.begin(__name__)
        key, known = weights.value
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(_restorer(shared), known)
        scorer = _scorers[key]
        for batch in batches:
            x = np.array([scorer.figures(t) for t in _values(batch.column(1))]).reshape(-1, len(mean))
            z = ((x - mean) / scale) @ b[:-1] + b[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], ["doc_id", "score"])

    return run


def _shared(spark, value):
    """``value`` broadcast with a key of its own."""
    return spark.sparkContext.broadcast((uuid.uuid4().hex, value))


class ToxicityModel:
    """Fitted parts: character model, weights of words and beginnings, logistic model."""

    def __init__(self, spark, characters: CharacterModel, weights: dict[str, float], model):
        self.characters, self.weights, self.model = characters, weights, model
        self._shared = _shared(spark, characters), _shared(spark, weights)

    def score(self, docs: DataFrame) -> DataFrame:
        """(doc_id, score) of every row of ``docs`` (doc_id, text); null and empty texts have a score like any text."""
        plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return plain.mapInArrow(_scoring(*self._shared, self.model), "doc_id long, score double")


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """A model of ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic); rows with a null id or label are left out.

    An id with several labels counts as toxic if one of them says so. Where several rows of ``docs`` share a labelled id,
    each is a text with that label; of texts that share their least shingle, near copies, one of each label counts.
    Null and empty texts are texts without words. Where no labels, or those of one class only, are given, or
    ``docs`` is empty, all scores are the share of toxic rows. Other columns of both tables are not read.
    """
    spark = docs.sparkSession
    characters = character_model(docs)
    shared = _shared(spark, characters)
    known = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = common.written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS), "labelled-rows")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # At most TRAIN_ROWS rows of two numbers.
    marked = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text")
    first = marked.mapInArrow(_keys, "doc_id long, toxic int, key long").groupBy("key", "toxic").agg(F.min("doc_id").alias("doc_id"))
    chosen = common.written(first.select("doc_id", "toxic"), "training-rows")
    marked = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")

    ids = chosen.toArrow()
    half = np.array([half_of(i) for i in ids["doc_id"].to_pylist()], dtype=bool)
    y = ids["toxic"].to_numpy().astype(bool)
    n1, n0 = int((y & ~half).sum()), int((~y & ~half).sum())
    share = float(y.mean()) if len(y) else 0.0
    constant = ToxicityModel(spark, characters, {}, (np.zeros(5), np.ones(5), np.array([0.0] * 5 + [math.log((share + 1e-6) / (1 - share + 1e-6))])))
    if not n1 or not n0 or not (y & half).any() or not (~y & half).any():
        return constant
    counted = marked.mapInArrow(_counting(shared), "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b")).where(F.col("a") >= LEAST)
    weighed = counted.withColumn(
        "w",
        F.log((F.col("a") + 0.5) / (n1 + 1.0)) - F.log((F.col("b") + 0.5) / (n0 + 1.0)) - F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5)),
    ).where("w > 0")
    top = weighed.orderBy(F.desc("w"), "feature").limit(WEIGHTS).select("feature", "w").toArrow()
    weights = dict(zip(top["feature"].to_pylist(), top["w"].to_pylist(), strict=True))
    rows = marked.mapInArrow(_figuring(shared, _shared(spark, weights)), "toxic long, figures array<double>").toArrow()
    x = np.array(rows["figures"].to_pylist()).reshape(-1, 5)
    # Sorted, so that the fit doesn't depend on the order of rows.
    target = rows["toxic"].to_numpy().astype(float)
    order = np.lexsort((*x.T, target))
    return ToxicityModel(spark, characters, weights, logistic(x[order], target[order]))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: toxicity of every document, learned from labels outside of the held-out fold."""
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    labels = common.table(spark, sf_dir, "labels", "doc_id", "toxic").where(~fold)
    scored = fit(docs, labels).score(docs)
    return scored.select("doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
