"""Personal data: fixed patterns, and candidates that boosted trees accept.

The patterns' spans always stay. Beside them, generators of high recall propose overlapping spans
(spelled-out addresses, other separators, parts of what a pattern swallowed, numbers without a plus);
features of their format and context go to boosted trees, one model for each kind, whose scores are
calibrated on held-out cases; a span whose probability reaches the kind's threshold and that
overlaps no accepted span is added.

No table marks personal data, so the models are fitted on TRAIN_TEXTS texts made by
``synthetic``: planted spans in many formats between look-alikes (versions, prices, dates, order
numbers, hashes). The number is a parameter; nothing is fitted on the corpus. The generators look for parts of at most
64 characters and rows of at most 19 groups of digits: that bounds added spans only, never the patterns'. All steps
take time in proportion to a text, or to it times the logarithm of its spans.
"""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import random
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .boosted_trees import BoostedTrees, isotonic

KINDS = ("email", "ip", "card", "phone")
#: Texts made to fit the models, the share of them that calibrates, and the precision that a threshold must reach there.
TRAIN_TEXTS, HELD_OUT, PRECISION = 6000, 0.25, 0.97

#: The patterns of the contract, by kind.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def _holds(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(v) < 3 or len(v) == 3 and v <= "255" for v in (p.lstrip("0") for p in s.split(".")))
    if kind == "card":
        return 16 <= len(d := _digits(s)) <= 19 and luhn(d)
    return kind == "email" or 8 <= len(_digits(s)) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' matches that hold, by kind and start."""
    if not text:
        return []
    out, digit = [], _DIGIT.search(text)
    if "@" in text:
        out += [("email", m.start(), m.end()) for m in _emails(text)]
    if digit:
        for kind in ("ip", "card", "phone"):
            if kind == "ip" and "." not in text or kind == "phone" and "+" not in text:
                continue
            found = _addresses(text, digit.start()) if kind == "ip" else (m.span() for m in BASE[kind].finditer(text, max(0, digit.start() - 1)))
            out += [(kind, a, b) for a, b in found if _holds(kind, text[a:b])]
    return out


_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_PART = re.compile(r"[0-9]++")


def _addresses(text: str, at: int):
    """(start, end) of the ip pattern's matches from ``at`` on: in each longest row of dotted numbers, every four in turn.
    The same matches as finditer's, in time linear in a run of digits."""
    for row in _DOTTED.finditer(text, at):
        if "." in row[0]:
            parts = [m.span() for m in _PART.finditer(text, *row.span())]
            for k in range(0, len(parts) - 3, 4):
                yield parts[k][0], parts[k + 3][1]


_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")


def _emails(text: str):
    """Matches of the pattern. Each stands around the first @ after its start, so only runs before an @ are tried:
    the same matches as finditer's, in time linear in a text without blanks."""
    at = 0
    while (sign := text.find("@", at)) >= 0:
        start = sign
        while start > at and not _NOT_LOCAL.match(text[start - 1]):
            start -= 1
        m = BASE["email"].match(text, start) if start < sign else None
        if m:
            yield m
            at = m.end()
        else:
            at = sign + 1


# ---------------------------------------------------------------- candidates

_AT = r"(?:\s?@\s?|\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?|\sat\s|\sAT\s|_at_)"
_DOT = r"(?:\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s|\sDOT\s|_dot_|\.)"
_MAIL = re.compile(rf"(?<![\w.%+-])[\w.%+-]{{1,64}}(?:{_DOT}[\w%+-]{{1,64}}){{0,3}}{_AT}[\w-]{{1,63}}(?:{_DOT}[\w-]{{2,63}}){{1,4}}", re.I)
#: What each match of _MAIL has in it.
_MAIL_SIGN = re.compile(_AT, re.I)
_IPV4 = re.compile(r"(?<![\d.])\d{1,3}(?:\s?[.,·]\s?|\s?[\[({](?:\.|dot)[\])}]\s?|\sdot\s|-)\d{1,3}(?:(?:\s?[.,·]\s?|\s?[\[({](?:\.|dot)[\])}]\s?|\sdot\s|-)\d{1,3}){2}(?!\d)", re.I)
_IPV6 = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:{1,2}){2,7}[0-9A-Fa-f]{1,4}(?![\w:])")
#: Runs of digits and what may stand between them; a run is a group, and candidates are rows of groups.
_RUN = re.compile(r"[+(]{0,2}\d+(?:[\s(). ‐-―−/_-]{1,3}\d+|\)\d+)*")
_GROUP = re.compile(r"\d+")
#: Groups in a row at most (a card has up to 19 digits, a phone up to 15).
_GROUPS = 19


def _rows_of_groups(text: str, least: int, most: int):
    """(start, end, groups) of all rows of neighbouring groups with ``least`` to ``most`` digits."""
    for run in _RUN.finditer(text):
        groups = [(m.start(), m.end()) for m in _GROUP.finditer(text, run.start(), run.end())]
        for k in range(len(groups)):
            n = 0
            for j in range(k, min(len(groups), k + _GROUPS)):
                n += groups[j][1] - groups[j][0]
                if n > most:
                    break
                if n >= least:
                    yield groups[k][0], groups[j][1], groups[k : j + 1]


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Proposed spans, which may overlap."""
    out = []
    if _MAIL_SIGN.search(text):
        out += [("email", m.start(), m.end()) for m in _MAIL.finditer(text)]
    if _DIGIT.search(text) or "::" in text:
        out += [("ip", m.start(), m.end()) for m in _IPV4.finditer(text)]
        out += [("ip", m.start(), m.end()) for m in _IPV6.finditer(text)]
        out += [("card", a, b) for a, b, _ in _rows_of_groups(text, 13, 19)]
        for a, b, _ in _rows_of_groups(text, 7, 15):
            start = a
            while start and text[start - 1] in "+(" and a - start < 2:
                start -= 1
            out.append(("phone", start, b))
    return out


_CUES = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|reach|address)", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address|ping|subnet|login|from)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|master|amex|credit|debit|cc|pay)", re.I),
    "phone": re.compile(r"\b(?:phone|tel|call|mobile|cell|fax|whatsapp|text|dial)", re.I),
}
_AGAINST = re.compile(r"\b(?:version|ver|v|release|build|isbn|order|invoice|serial|sku|id|no|nr|item|price|total|usd|eur|year|page|section|chapter|tracking|commit|hash|part|model)\b[\s.:#]*\Z", re.I)
_VALID6 = re.compile(r"::|(?:[0-9A-Fa-f]+:){7}")


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """The figures of a candidate: its format, then what stands around it."""
    s = text[start:end]
    groups = [len(m[0]) for m in _GROUP.finditer(s)]
    digits = _digits(s)
    before, after = text[max(0, start - 32) : start], text[end : end + 16]
    between = re.sub(r"[\w+%@.-]", "", s)
    if kind == "ip" and ":" in s:
        try:
            valid = float(bool(_VALID6.search(s)) and ipaddress.ip_address(s).version == 6)
        except ValueError:
            valid = 0.0
    elif kind == "ip":
        valid = float(len(groups) == 4 and all(int(g) <= 255 and (g == "0" or g[0] != "0") for g in _GROUP.findall(s)))
    elif kind == "card":
        valid = float(luhn(digits)) if digits else 0.0
    elif kind == "phone":
        valid = float(s.startswith("+")) + 2.0 * s.startswith("00")
    else:
        valid = float(bool(re.search(r"@|\bat\b|_at_", s, re.I)))
    tail = re.search(r"([A-Za-z]+)[^A-Za-z]*\Z", s)
    near = lambda c: float(c.isalnum()) + 2.0 * (c in "+-./:_=#$€@") + 3.0 * (c in "([{<")
    return [
        len(s), len(digits), len(groups), max(groups, default=0), min(groups, default=0), groups[0] if groups else 0, groups[-1] if groups else 0,
        valid, float(s[:1] == "+"), float("(" in s) + 2.0 * (")" in s), s.count("."), s.count("-"), s.count(" "), float("/" in s or "_" in s), float(":" in s), len(set(between)),
        float(digits[:1] or 0), float(digits[:2] or 0), float(digits[:4] or 0), len(tail[1]) if tail else 0, float("@" in s), float(bool(re.search(r"[\[({<_]", s))), float(bool(re.search(r"dot", s, re.I))),
        near(text[start - 1]) if start else 0.0, near(after[0]) if after else 0.0, float(after[1:2].isdigit()), float(before[-2:-1].isdigit()),
        float(bool(_CUES[kind].search(before))), float(bool(_AGAINST.search(before))), float(any(_CUES[k].search(before) for k in KINDS if k != kind)),
        float(len(set(digits)) if digits else 0), float(len(set(groups))),
    ]


# ---------------------------------------------------------------- models

def _card(r: random.Random, n: int = 16) -> str:
    start = r.choice(["4", "51", "55", "37", "6011", "35"])
    n = 15 if start == "37" else n
    d = start + "".join(r.choice("0123456789") for _ in range(n - 1 - len(start)))
    return next(d + c for c in "0123456789" if luhn(d + c))


def _phone(r: random.Random) -> str:
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    area = r.choice("23456789") + d(2)
    sep = r.choice([" ", "-", "."])
    national = r.choice([f"({area}) {d(3)}-{d(4)}", f"{area}{sep}{d(3)}{sep}{d(4)}", f"({area}){d(3)}-{d(4)}", f"0{d(3)}{sep}{d(3)}{sep}{d(3)}"])
    return r.choice(["", "", "+1 ", "+1-", f"+{r.randint(20, 99)} ", f"00{r.randint(20, 99)} ", "1-"]) + national


def _mail(r: random.Random) -> str:
    w = lambda: "".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(2, 8)))
    local = w() + r.choice(["", "." + w(), str(r.randint(1, 99)), "_" + w()])
    host = [w(), r.choice(["com", "org", "net", "de", "fr", "io", "edu", "co"])]
    if r.random() < 0.3:
        host.insert(0, w())
    at = r.choice(["@", " @ ", " at ", " [at] ", "(at)", "[at]", " AT ", " (at) "])
    dot = r.choice([".", " dot ", "[.]", "(dot)", " [dot] ", " DOT "]) if at != "@" or r.random() < 0.3 else "."
    return local + at + dot.join(host)


def _address(r: random.Random) -> str:
    if r.random() < 0.15:
        return ":".join(f"{r.randint(0, 65535):x}" for _ in range(8))
    return r.choice([".", "[.]", " . ", "(.)", ".", " dot ", "[dot]"]).join(str(r.randint(0, 255)) for _ in range(4))


_POSITIVE = {"email": _mail, "ip": _address, "card": lambda r: _split(r, _card(r, r.choice([16, 16, 16, 13, 19]))), "phone": _phone}


def _split(r: random.Random, d: str) -> str:
    sep = r.choice(["", " ", "-", ".", "  ", "/", "_"])
    return sep.join(d[k : k + 4] for k in range(0, len(d), 4)) if len(d) != 15 else sep.join((d[:4], d[4:10], d[10:]))


def _lookalike(r: random.Random) -> str:
    n = lambda a, b: str(r.randint(a, b))
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    return r.choice([
        lambda: f"version {n(0, 20)}.{n(0, 99)}.{n(0, 999)}.{n(0, 9999)}", lambda: f"v{n(0, 9)}.{n(0, 30)}.{n(0, 9)}.{n(256, 999)}", lambda: f"section {n(1, 9)}.{n(1, 9)}.{n(1, 9)}.{n(1, 9)}",
        lambda: f"{n(1900, 2030)}-{n(10, 12)}-{n(10, 28)}", lambda: f"{n(1, 28)}.{n(1, 12)}.{n(1990, 2030)}", lambda: f"{n(1, 999)},{d(3)},{d(3)}", lambda: f"${n(1, 9999)}.{d(2)}",
        lambda: f"order {d(r.randint(7, 19))}", lambda: f"id {d(r.randint(8, 18))}", lambda: f"ISBN {d(3)}-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"AKIA{d(4)}QX{d(6)}ZT", lambda: hashlib.md5(d(6).encode()).hexdigest(),
        lambda: d(r.randint(7, 20)), lambda: f"{n(10, 23)}:{n(10, 59)}:{n(10, 59)}", lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}", lambda: f"meet at {n(1, 12)} dot point", lambda: "look at this . org chart", lambda: f"tracking no {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}",
        lambda: f"{n(100, 999)} {n(100, 999)} {n(100, 999)} {n(10, 99)}", lambda: f"3.{d(9)}", lambda: f"pages {n(100, 300)}-{n(300, 999)}, {n(1990, 2020)}", lambda: f"{d(8)}-{d(4)}", lambda: f"serial {d(3)}-{d(3)}-{d(4)}",
    ])()


def synthetic(count: int, seed: int = 7):
    """(text, planted spans) for ``count`` texts; the same for the same arguments."""
    r = random.Random(seed)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it"]
    cue = {"email": ["mail", "contact", "write to", "email:"], "ip": ["host", "server", "ip", "login from"], "card": ["card", "visa", "paid by card", "credit card:"], "phone": ["call", "tel", "phone:", "mobile"]}
    for _ in range(count):
        text, spans = "", []
        for _ in range(r.randint(1, 4)):
            text += " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(r.randint(2, 8))) + r.choice([" ", " ", ". ", ", ", ": ", "\n"])
            if r.random() < 0.5:
                kind = r.choice(KINDS)
                if r.random() < 0.4:
                    text += r.choice(cue[kind]) + " "
                s = _POSITIVE[kind](r)
                spans.append((kind, len(text), len(text) + len(s)))
                text += s
                if r.random() < 0.3:  # another right behind it, which patterns run together
                    kind = r.choice(KINDS)
                    s = _POSITIVE[kind](r)
                    text += " "
                    spans.append((kind, len(text), len(text) + len(s)))
                    text += s
            else:
                text += _lookalike(r)
            text += r.choice([" ", ". ", ", ", " ", "\n"])
        yield text, set(spans)


def fit(count: int = TRAIN_TEXTS, precision: float = PRECISION) -> dict[str, tuple]:
    """For each kind: trees, calibration (scores, probabilities) and the threshold on the probability."""
    rows: dict[str, list] = {k: [] for k in KINDS}
    cut = count * (1 - HELD_OUT)
    for k, (text, spans) in enumerate(synthetic(count)):
        for kind, a, b in dict.fromkeys(candidates(text)):
            rows[kind].append((features(text, kind, a, b), (kind, a, b) in spans, k >= cut))
    out = {}
    for kind, found in rows.items():
        x, y, held = (np.array([f[i] for f in found]) for i in range(3))
        trees = BoostedTrees().fit(x[~held], y[~held])
        score = trees.score(x[held])
        at, p = isotonic(score, y[held])
        known = np.sort(p[np.searchsorted(at, score, side="right") - 1])
        # The lowest threshold whose accepted cases are right often enough.
        calibrated = p[np.maximum(np.searchsorted(at, score, side="right") - 1, 0)]
        threshold = next((float(t) for t in np.unique(known) if t > 0.5 and y[held][calibrated >= t].mean() >= precision), 1.0)
        out[kind] = (trees, at, p, threshold)
    return out


@functools.lru_cache(maxsize=1)
def models() -> dict[str, tuple]:
    return fit()


def find(text: str | None, fitted: dict[str, tuple]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(the patterns' spans, spans that the models add), each by kind and start."""
    if not text:
        return [], []
    base = base_spans(text)
    starts, reach = [], []  # of the patterns' spans, by start: how far they reach so far
    for _, a, b in sorted(base, key=lambda s: s[1]):
        starts.append(a)
        reach.append(max(b, reach[-1] if reach else 0))

    def free(a: int, b: int) -> bool:
        k = bisect_left(starts, b)
        return not k or reach[k - 1] <= a

    rows = [c for c in dict.fromkeys(candidates(text)) if free(c[1], c[2])]
    accepted = []
    for kind in KINDS:
        own = [c for c in rows if c[0] == kind]
        if own:
            trees, at, p, threshold = fitted[kind]
            score = trees.score(np.array([features(text, *c) for c in own]))
            probability = p[np.maximum(np.searchsorted(at, score, side="right") - 1, 0)]
            accepted += [(-q, -s, c[2] - c[1], c) for q, s, c in zip(probability.tolist(), score.tolist(), own, strict=True) if q >= threshold]
    added: list[tuple[str, int, int]] = []
    begun, ended = [], []  # of the added spans, which don't overlap, by start
    for *_, c in sorted(accepted):
        k = bisect_left(begun, c[2])
        if not k or ended[k - 1] <= c[1]:
            added.append(c)
            begun.insert(k, c[1])
            ended.insert(k, c[2])
    return base, sorted(added, key=lambda c: (KINDS.index(c[0]), c[1]))


def spelled(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def _reported(fitted):
    def run(batches):
        common.begin(__name__)
        for batch in batches:
            counts, sums, spans = [], [], []
            for text in batch.column(1):
                base, added = find(text.as_py(), fitted.value)
                counts.append([sum(s[0] == k for s in base) for k in KINDS])
                sums.append(hashlib.sha256(spelled(base).encode()).hexdigest())
                spans.append(spelled(base + added))
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(sums, pa.string()), pa.array(spans, pa.string())], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return run


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row of ``docs`` (doc_id, text).

    The counts and base_sha256 are of the patterns' spans, ``spans`` has all. Null and empty texts have none.
    Repeated rows are reported each; an empty table gives an empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models())
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(_reported(shared), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str | None, fitted: dict[str, tuple]) -> str | None:
    """The text with each span replaced by its kind; overlapping spans become one, named by the first."""
    base, added = find(text, fitted)
    merged: list[list] = []
    for kind, a, b in sorted(base + added, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    out, at = [], 0
    for kind, a, b in merged:
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data replaced; n_chars, if it is there, is that of the new text. No row is dropped.

    Null and empty texts, and the n_chars of null ones, stay as they are. Repeated rows are treated each for itself; other columns, of any
    name, are returned unread; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models())
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        common.begin(__name__)
        for batch in batches:
            columns = list(batch.columns)
            texts = [redacted(t.as_py(), shared.value) for t in columns[at]]
            columns[at] = pa.array(texts, pa.string())
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pa.array([len(t) if t is not None else n for t, n in zip(texts, columns[k].to_pylist(), strict=True)], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: personal data in documents."""
    return report(common.table(spark, sf_dir, "documents", "doc_id", "text"))
