"""BPE encoding by dynamic programming over prefixes, and decoding.

The ids of a prefix of a piece are unique, so its last id is too. For each prefix the automaton
over the vocabulary gives the tokens that end there, longest first; the one that can stand beside
the last id of what is left before it is the prefix's last id. Back-pointers from the end give the ids.

* Automaton: a trie of all tokens with suffix links, so that one state per prefix lists every token
  that is a suffix of it. The last symbol of a piece carries the end-of-word mark and is a symbol
  of its own.
* Compatibility: two neighbouring ids may stand when no merge across them comes before the merges
  that made them. The test takes both apart, the later merge first, and looks at each pair that
  faces the other over the seam.
* A prefix's state and last ids don't depend on what follows, so they are kept for later pieces.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, vocab

VOCABULARY = "word_bpe_49k.json"
#: Prefixes and pairs kept before the tables are emptied; prefixes longer than LONGEST aren't kept.
PREFIXES, PAIRS, LONGEST = 300_000, 500_000, 24
#: The last symbol of a piece is this much above the character itself.
MARK = 0x10000


class PrefixBpe:
    """Encodes pieces (strings of byte-level characters) of one vocabulary."""

    def __init__(self, text: str, usable: set[int] | None = None):
        model = json.loads(text)["model"]
        ids, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        unsupported = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or unsupported:
            raise ValueError(f"not a plain BPE vocabulary: {model['type']}, {unsupported}")

        def symbols(token: str) -> str:
            if suffix and token.endswith(suffix) and len(token) > len(suffix):
                token = token[: -len(suffix)]
                return token[:-1] + chr(ord(token[-1]) + MARK)
            return token

        self.mark = MARK if suffix else 0
        self.size = max(ids.values()) + 1
        self.rank = {}  # pair -> id made by it; order of merges in self.order
        self.split, self.order = {}, {}
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            joined = ids[a + b]
            if joined in self.split:
                raise ValueError(f"two merges make {a + b!r}")
            self.split[joined], self.order[joined], self.rank[ids[a], ids[b]] = (ids[a], ids[b]), k, joined
        self.spelled = {i: symbols(t) for t, i in ids.items() if i in self.split or len(symbols(t)) == 1}
        if usable is None:
            usable = {i for i, s in self.spelled.items() if self.merged(s) == [i]}
        self.usable = usable
        self._build({s: i for i, s in self.spelled.items() if i in usable})
        self.prefixes, self.pairs = {}, {}

    def merged(self, symbols: str) -> list[int]:
        """The textbook loop, lowest merge first; used for the vocabulary's own tokens and in tests."""
        base = getattr(self, "base", None)
        if base is None:
            base = self.base = {s: i for i, s in self.spelled.items() if len(s) == 1}
        parts = [base[c] for c in symbols]
        while len(parts) > 1:
            best = min(((self.order[self.rank[p]], k) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.rank), default=None)
            if best is None:
                break
            k = best[1]
            parts[k : k + 2] = [self.rank[parts[k], parts[k + 1]]]
        return parts

    def _build(self, tokens: dict[str, int]) -> None:
        self.child: list[dict[str, int]] = [{}]
        ends = {}
        for s, i in tokens.items():
            at = 0
            for c in s:
                nxt = self.child[at].get(c)
                if nxt is None:
                    nxt = self.child[at][c] = len(self.child)
                    self.child.append({})
                at = nxt
            ends[at] = (i, len(s))
        self.link = [0] * len(self.child)
        self.ends: list[tuple] = [()] * len(self.child)
        queue = [(c, n, 0) for c, n in self.child[0].items()]
        for c, node, parent in queue:  # grows while it is read: breadth first
            link = self.link[parent]
            while link and c not in self.child[link]:
                link = self.link[link]
            self.link[node] = self.child[link].get(c, 0) if parent else 0
            self.ends[node] = ((ends[node],) if node in ends else ()) + self.ends[self.link[node]]
            queue += [(d, n, node) for d, n in self.child[node].items()]

    def beside(self, left: int, right: int) -> bool:
        """Whether no merge over the seam comes before those that made ``left`` and ``right``."""
        key = left * self.size + right
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            got = self.pairs[key] = self._beside(left, right)
        return got

    def _beside(self, left: int, right: int) -> bool:
        order, split, rank, limit = self.order, self.split, self.rank, 1 << 60
        while True:
            over = rank.get((left, right))
            if over is not None and order[over] < limit:
                return False
            a, b = order.get(left, -1), order.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:  # undone first: made last; a merge over the seam of the same rank lies to its right
                left, limit = split[left][1], a
            else:
                right, limit = split[right][0], b + 1

    def pieces(self, symbols: str) -> list[int]:
        """Ids of one piece whose last symbol carries the mark."""
        n, known = len(symbols), self.prefixes
        k = min(n - 1, LONGEST)
        while k > 0 and (hit := known.get(symbols[:k])) is None:
            k -= 1
        state, last = (hit[0], list(hit[1])) if k > 0 else (0, [])
        child, link, ends = self.child, self.link, self.ends
        for i in range(k, n):
            c = symbols[i]
            while state and c not in child[state]:
                state = link[state]
            state = child[state].get(c, 0)
            for token, size in ends[state]:
                if size == i + 1 or self.beside(last[i - size], token):
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token of the vocabulary ends {symbols[: i + 1]!r}")
            if i < n - 1 and i < LONGEST:
                if len(known) >= PREFIXES:
                    known.clear()
                known[symbols[: i + 1]] = (state, tuple(last))
        out, at = [], n
        while at:
            token = last[at - 1]
            out.append(token)
            at -= len(self.spelled[token])
        out.reverse()
        return out

    def encode(self, piece: str) -> list[int]:
        """Ids of one piece of byte-level characters."""
        return self.pieces(piece[:-1] + chr(ord(piece[-1]) + self.mark)) if piece else []


class Codec:
    """Encodes and decodes whole texts as the library does with add_special_tokens=False."""

    def __init__(self, text: str, usable: set[int] | None = None):
        self.library = vocab.tokenizer(text)
        whole = json.loads(text)
        if whole.get("decoder") is not None:
            raise ValueError("only vocabularies without a decoder are supported")
        self.bpe = PrefixBpe(text, usable)
        self.added = {a["content"]: a["id"] for a in whole["added_tokens"]}
        self.finder = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.chunks = vocab.chunks(text, self.chunk, "<u4")
        top = max([self.bpe.size - 1, *self.added.values()]) + 1
        spelled = [(self.library.id_to_token(i) or "").encode() + b" " for i in range(top)]
        self.sizes = np.array([len(s) for s in spelled], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(spelled), dtype=np.uint8)

    def chunk(self, chunk: str) -> list[int]:
        """Ids of what stands between blanks, or of a piece: normalising and splitting are the library's, the ids ours."""
        if chunk.isascii() and chunk.isalpha() and chunk.islower():
            return self.bpe.encode(chunk)
        out = []
        for k, part in enumerate(self.finder.split(chunk) if self.finder else [chunk]):
            if k % 2:
                out.append(self.added[part])
            elif part:
                for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)):
                    out += self.bpe.encode(piece)
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; null counts as empty."""
        return self.chunks.text(text)

    def decode(self, ids: bytes) -> bytes:
        """The decoded text in UTF-8: the vocabulary's spelling of each id, joined by blanks."""
        ids = np.frombuffer(ids, dtype="<u4")
        if not len(ids):
            return b""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - sizes), sizes)
        return self.flat[at].tobytes()[:-1]


_codecs: dict[str, Codec] = {}
common.cached(__name__, _codecs.clear)


def codec(text: str, usable: set[int] | None = None) -> Codec:
    """One codec for each vocabulary in a Python worker."""
    common.begin(__name__)
    if text not in _codecs:
        _codecs.clear()
        _codecs[text] = Codec(text, usable)
    return _codecs[text]


def digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``docs`` (doc_id, text): a row for each row.

    Null and empty texts have no ids and decode to an empty text; strings of special tokens in a text
    become their ids, as the library does it. Other columns are not read.
    """
    text = vocab.read(vocabulary)
    # Tokens that no text can give: found once here, not by each worker.
    shared = docs.sparkSession.sparkContext.broadcast((text, PrefixBpe(text).usable))

    def run(batches):
        own = codec(*shared.value)
        for batch in batches:
            n, a, b = [], [], []
            for t in batch.column(1).to_pylist():
                ids = own.encode(t)
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(common.col("doc_id").cast("long").alias("doc_id"), common.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row; the operator's own output."""
    text = vocab.read(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((text, PrefixBpe(text).usable))

    def run(batches):
        own = codec(*shared.value)
        for batch in batches:
            ids = [np.frombuffer(own.encode(t), dtype="<u4").astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(common.col(id_col).cast("long").alias("doc_id"), common.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: ids and decoded texts of documents, as digests."""
    return digests(common.table(spark, sf_dir, "documents", "doc_id", "text"))
