"""Quality rules: figures of each text, and lines that too many documents of a host share.

Lines are normalised (ASCII letters to lower case, digits to 0, white space to one blank) and hashed.
A host's count of a line is its number of distinct texts with the line, so that exact copies count
once. Lines above the host's limit are removed; a document that loses over half of its words
by that is depleted and rejected.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A line is above the limit of a host when more than MAX_DOCS of its distinct texts have it, however many there are; in
#: a small host when more than SHARE of them do, but MIN_DOCS at least.
MAX_DOCS, SHARE, MIN_DOCS = 100, 0.2, 10
#: The share of words that a document may lose.
DEPLETED = 0.5
#: Fewer words, or a larger percentage of repeated words, fail.
MIN_WORDS, MAX_REPEATED = 50, 50
#: Tables of at most this many rows (some 50 bytes each) are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 500_000

_NORMAL = bytes(c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
_SYMBOLS = b"#*$%&|<>"
_BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_FIGURES = [x.split()[0] for x in _BASE.split(", ")]


def repeated_words(words: list[bytes]) -> int:
    """The words that lie in a window of three that is found at least twice."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total, covered = 0, 0  # covered: end of what is counted
    for k, window in enumerate(windows):
        if counts[window] > 1:
            total += k + 3 - max(k, covered)
            covered = k + 3
    return total


def figures(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words); null counts as no text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()  # on blanks and \t to \r, as bytes
    lines = [x for x in raw.split(b"\n") if x.strip()]
    blanks = len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r"))
    return len(words), len(text) - blanks, len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def line_hashes(text: str | None) -> list[tuple[int, int, bytes]]:
    """(hash, words, line) of each line with a word, in order."""
    import xxhash

    out = []
    for line in (text or "").encode().split(b"\n"):
        words = line.translate(_NORMAL).split()
        if words:
            out.append((xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63), len(words), line))
    return out


def _measured(batches):
    common.begin(__name__)
    for batch in batches:
        rows, hashes, sizes = [], [], []
        for text in batch.column(batch.schema.get_field_index("text")):
            text = text.as_py()
            rows.append(figures(text))
            lines = line_hashes(text)
            hashes.append(np.array([x[0] for x in lines], dtype=np.int64))
            sizes.append(np.array([x[1] for x in lines], dtype=np.int32))
        columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
        kept = [batch.column(k) for k in range(3)]
        yield pa.RecordBatch.from_arrays([*kept, *columns, pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))], ["doc_id", "host", "text_key", *_FIGURES, "lines", "line_words"])


def measure(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text, source): its figures and hashed lines, written to the shared folder."""
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), F.md5(text.cast("binary")).alias("text_key"), text.alias("text"))
    with common.small_batches(docs.sparkSession):
        return common.written(plain.mapInArrow(_measured, f"doc_id long, host string, text_key string, {_BASE}, lines array<long>, line_words array<int>"), "line-figures")


def removed_lines(measured: DataFrame, limits: tuple[float, float, float] | None = None) -> DataFrame:
    """(host, text_key, removed_words, removed): for each distinct text of a host with lines above the host's limit.

    ``limits``: (MAX_DOCS, SHARE, MIN_DOCS), those above where it is None.
    """
    most, share, least = limits or (MAX_DOCS, SHARE, MIN_DOCS)
    texts = common.written(
        measured.groupBy("host", "text_key").agg(F.first("lines").alias("lines"), F.first("line_words").alias("line_words")), "distinct-texts"
    )
    counts = texts.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min(least, most))
    sizes = texts.groupBy("host").agg(F.count(F.lit(1)).alias("n_texts"))
    limit = F.least(F.lit(float(most)), F.greatest(F.lit(float(least)), F.lit(float(share)) * F.col("n_texts")))
    above = common.written(counts.join(sizes, "host").where(F.col("n") > limit).select("host", "line"), "common-lines")
    lines = texts.select("host", "text_key", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("host", "text_key", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    hits = lines.join(small(above), ["host", "line"])
    return common.written(hits.groupBy("host", "text_key").agg(F.sum("words").alias("removed_words"), F.collect_set("line").alias("removed")), "removed-lines")


def small(df: DataFrame, lists: str | None = None) -> DataFrame:
    """``df`` marked for broadcast if it is small: its rows, and the entries of its column ``lists``."""
    weight = F.lit(1) if lists is None else 1 + F.size(common.col(lists))
    return F.broadcast(df) if (df.agg(F.sum(weight)).first()[0] or 0) <= BROADCAST_ROWS else df


def verdicts(docs: DataFrame, removed: DataFrame | None = None, measured: DataFrame | None = None, lost: bool = False) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text, source): the figures, base_failed and kept; with ``lost`` the words in removed lines as well.

    Null and empty texts have no words and fail. Documents without a source share a host of their own
    with those whose source is empty. Empty table: empty result. Other columns are not read.
    """
    measured = measure(docs) if measured is None else measured
    removed = removed_lines(measured) if removed is None else removed
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    joined = measured.drop("lines", "line_words").join(small(removed.drop("removed")), ["host", "text_key"], "left")
    gone = F.coalesce(F.col("removed_words"), F.lit(0))
    depleted = gone > F.lit(DEPLETED) * F.col("n_words")
    more = [gone.cast("long").alias("lost")] if lost else []
    return joined.select("doc_id", *_FIGURES, failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "host", "text_key", *more)


def clean(docs: DataFrame) -> DataFrame:
    """The documents that stay, with the columns of ``docs``, without lines above the limits.

    n_chars, if it is there, is that of the new text. Rows are matched by host and text, so repeated
    ids don't matter, and equal texts of a host have the same fate. Null and empty texts have no words and go. An empty table
    gives an empty result; other columns, of any name, are returned unread.
    """
    measured = measure(docs)
    removed = removed_lines(measured)
    bad = verdicts(docs, removed, measured).where("not kept").select("host", "text_key").distinct()
    bad = common.written(bad, "rejected-texts")
    keys = {k: common.free_name(docs, k) for k in ("host", "text_key", "removed")}
    keyed = docs.withColumns({keys["host"]: F.coalesce(F.col("source").cast("string"), F.lit("")), keys["text_key"]: F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))})
    on = [keys["host"], keys["text_key"]]
    kept = keyed.join(small(bad.toDF(*on)), on, "left_anti")
    changes = removed.select("host", "text_key", "removed").toDF(*on, keys["removed"])
    same = kept.join(small(changes.select(*on)), on, "left_anti").select(*[common.col(c) for c in docs.columns])

    def strip(batches):
        common.begin(__name__)
        for batch in batches:
            names = batch.schema.names
            at, texts = names.index("text"), []
            for text, lines in zip(batch.column(at).to_pylist(), batch.column(len(names) - 1).to_pylist(), strict=True):
                gone = set(lines)
                spans = iter(line_hashes(text))
                texts.append("\n".join(x for x in text.split("\n") if not x.encode().split() or next(spans)[0] not in gone))
            columns = [batch.column(k) for k in range(len(names) - 1)]
            columns[at] = pa.array(texts, pa.string())
            if "n_chars" in names:
                columns[names.index("n_chars")] = pa.array([len(t) for t in texts], pa.int64()).cast(batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(columns, names[:-1])

    changed = kept.join(small(changes, keys["removed"]), on).select(*[common.col(c) for c in docs.columns], keys["removed"]).mapInArrow(strip, docs.schema)
    return same.unionByName(changed)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: figures and verdict of every document."""
    return verdicts(common.table(spark, sf_dir, "documents", "doc_id", "text", "source")).drop("host", "text_key")


#: Limits at which lines are removed from the smallest tables as well.
LOW = (3, 0.02, 2)


def low_query(spark, sf_dir: str) -> DataFrame:
    """The same at low limits, so that the filter acts on small tables, and what each document would lose."""
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text", "source")
    measured = measure(docs)
    removed = common.written(removed_lines(measured, LOW), "removed-lines")
    return verdicts(docs, removed, measured, lost=True).select("doc_id", "lost", "kept")


_WORD = "[^\\x20\\x09-\\x0D]+"
_ORACLE = f"""
with d as (
    select row_number() over () as r, doc_id, coalesce(source, '') as host, coalesce(text, '') as t from documents
), w as (
    select r, doc_id, host, t, regexp_extract_all(t, '{_WORD}') as ws from d
), words as (
    select r, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as k from w
), windows as (
    select r, k, word as a, lead(word) over o as b, lead(word, 2) over o as c from words window o as (partition by r order by k)
), twice as (
    select r, k from (select r, k, count(*) over (partition by r, a, b, c) as n from windows where c is not null) where n > 1
), repeated as (
    select r, count(distinct k + j) as n from twice, range(3) as x(j) group by r
), lines as (
    select r, host, t, unnest(string_split(t, chr(10))) as line from d
), worded as (
    select r, host, t, line, regexp_extract_all(line, '{_WORD}') as ws from lines where regexp_matches(line, '{_WORD}')
), doubles as (
    select r, count(*) - count(distinct line) as n from worded group by r
), normal as (
    select r, host, t, regexp_replace(translate(array_to_string(ws, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') as line, len(ws) as n from worded
), sizes as (
    select host, count(distinct t) as n from d group by host
), above as (
    select l.host, l.line from (select host, line, count(distinct t) as n from normal group by host, line) l join sizes using (host)
    where l.n > least(@most, greatest(@least, @share * sizes.n))
), lost as (
    select r, sum(n) as n from normal join above using (host, line) group by r
), f as (
    select doc_id, len(ws) as n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) as word_chars,
           length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(doubles.n, 0) as n_dup_lines,
           coalesce(repeated.n, 0) as n_repeat_words, coalesce(lost.n, 0) as lost
    from w left join doubles using (r) left join repeated using (r) left join lost using (r)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED} * n_words as base_failed,
       not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED} * n_words) and lost <= {DEPLETED} * n_words as kept
from f
"""


def oracle(limits: tuple[float, float, float]) -> str:
    most, share, least = limits
    return _ORACLE.replace("@most", str(most)).replace("@share", str(share)).replace("@least", str(least))


ORACLE = oracle((MAX_DOCS, SHARE, MIN_DOCS))
LOW_ORACLE = oracle(LOW).replace("select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,\n       n_words < ", "select doc_id, lost, n_words < ")
LOW_ORACLE = "select doc_id, lost::bigint as lost, kept from (" + LOW_ORACLE + ")"
