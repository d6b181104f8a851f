"""Main text of web pages by the container paths that a host's pages agree on.

1. Each page is parsed and its containers are scored by the text that stands in them, outside of links and
   of parts that are never content; text counts half as much for each container further out.
2. A container votes for its generalised path (tags with their classes, digits removed) with its share
   of the page's best score. Spark adds up the votes by host, without those for containers around a page's
   best one. A path stays if it is the best of at least SHARE of the host's pages, or of the WINNERS paths that are
   the best of most pages.
3. Each page is extracted again from the elements at that of its host's paths whose votes times its score on this page
   are the most, so that neither a seldom long menu nor a short tip at a frequent path takes the article's place, or at a
   kept path below that which scores better on this page; a page that has none of them uses its own best
   container, or else the whole body.

Classes and ids mark parts that are no content, however long they are. Only a marked part that holds the page's h1 or main
element, or one outside of which no text stands, is taken for a wrapper and stays.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Votes that a page casts, paths that a host keeps whatever their share, and the share of its pages from which it keeps others.
VOTES, WINNERS = 3, 3
SHARE = 0.01
#: Tables of at most this many paths are broadcast; larger ones are shuffled, each host in SALTS parts.
BROADCAST_ROWS, SALTS = 200_000, 64

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"|<(?P<start>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<odd>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "svg", "math", "select", "object")}
_BLOCKS = frozenset("head address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre search section summary table caption tbody td tfoot th thead tr ul button".split())
_CONTAINERS = frozenset("article body center dd details div fieldset figure main section td blockquote".split())
#: Elements that never are content.
_NEVER = frozenset("head nav header footer aside form button menu search dialog".split())
#: What a start tag closes when it is the innermost of these.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
#: Words in classes and ids of parts that are no content.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "share sharing social related recommended recommendations comment comments respond reply replies disqus discussion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar pagination pager "
    "widget skip login toolbar tags copyright legal disclaimer".split()
)
#: Words that make a class say what its part has beside it, as in content-with-sidebar.
_BESIDE = frozenset("with without has no layout".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
_WORDS = re.compile(r"[a-z]+")


class Page:
    """Blocks of a page, their text, and which of them are no content."""

    __slots__ = ("dropped", "events", "links", "parent", "path", "tag", "text", "total")

    def __init__(self, html: str):
        self.tag, self.path, self.parent, self.dropped = ["#"], [""], [-1], [False]
        self.text, self.links, marked = [0], [0], []
        self.events: list[tuple[int, str, bool]] = []  # block, text, whether it is in a link
        stack, linked, at, size = [0], False, 0, len(html)
        while at < size:
            m = _TOKEN.search(html, at)
            if m is None or m.start() > at:
                piece = html[at : m.start() if m else size]
                if self.tag[stack[-1]] == "head" and not piece.isspace():
                    stack.pop()  # its end tag may be left out
                self.events.append((stack[-1], piece, linked))
            if m is None:
                break
            at = m.end()
            name = m["start"] or m["odd"]
            if name:
                name = name.lower()
                if name == "br" or name == "hr":
                    self.events.append((stack[-1], " ", linked))
                elif name == "a":
                    linked = True
                elif name in _RAW:
                    if not (m["attributes"] or "").endswith("/"):
                        end = _RAW[name].search(html, at)
                        at = end.end() if end else size
                    if name in ("textarea", "select", "title"):
                        self.events.append((stack[-1], " ", linked))
                elif name in _BLOCKS:
                    self._open(name, m["attributes"] or "", stack, marked)
                    linked = False
            elif m["end"]:
                name = m["end"].lower()
                if name == "a":
                    linked = False
                elif name in _BLOCKS:
                    self._close(name, stack)
                    linked = False
        self._add_up(marked)

    def _open(self, name: str, attributes: str, stack: list[int], marked: list[int]) -> None:
        if name in ("html", "body") and any(self.tag[k] == name for k in stack):
            return
        if self.tag[stack[-1]] in ("p", "head"):
            stack.pop()
        closes = _CLOSES.get(name)
        if closes:
            while self.tag[stack[-1]] in closes:
                stack.pop()
        up = stack[-1]
        classes, drop = "", name in _NEVER
        if attributes.strip():
            found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
            classes = found.get("class", "")
            names = [set(_WORDS.findall(x)) for x in (classes + " " + found.get("id", "")).lower().split()]
            drop = drop or "hidden" in found or found.get("aria-hidden") == "true"
            if any(words & _MARKS and not words & _BESIDE for words in names) or found.get("role", "").lower() in _ROLES:
                marked.append(len(self.tag))
            classes = ".".join(sorted({re.sub(r"\d+", "", c) for c in classes.lower().split()}))
        self.path.append(f"{self.path[up]}/{name}" + (f".{classes}" if classes else ""))
        self.tag.append(name)
        self.parent.append(up)
        self.dropped.append(drop or self.dropped[up])
        self.text.append(0)
        self.links.append(0)
        stack.append(len(self.tag) - 1)
        self.events.append((up, " ", False))

    def _close(self, name: str, stack: list[int]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] == name:
                del stack[k:]
                self.events.append((stack[-1], " ", False))
                return
            if self.tag[stack[k]] in ("table", "td") and name in ("p", "li", "div"):
                break
        self.events.append((stack[-1], " ", False))

    def _add_up(self, marked: list[int]) -> None:
        for k, piece, linked in self.events:
            n = len(piece.strip())
            (self.links if linked else self.text)[k] += n
        total = [a + b for a, b in zip(self.text, self.links, strict=True)]
        for k in range(len(total) - 1, 0, -1):
            total[self.parent[k]] += total[k]
        self.total = total
        outside = self._outside(marked)
        for k in marked:
            if self.tag[k] not in ("body", "html", "main") and outside[k]:
                self.dropped[k] = True
        for k in range(1, len(total)):
            self.dropped[k] = self.dropped[k] or self.dropped[self.parent[k]]

    def _outside(self, marked: list[int]) -> dict[int, bool]:
        """Whether each marked part is no wrapper and text stands outside of it, in no other marked part that doesn't hold it."""
        if not marked:
            return {}
        near, is_marked = [0] * len(self.tag), set(marked)  # the innermost marked part that a block is or stands in
        rest, wraps = dict.fromkeys((0, *marked), False), set()
        for k in range(len(self.tag)):
            near[k] = k if k in is_marked else near[self.parent[k]] if k else 0
            heading = self.tag[k] in ("h1", "h2", "h3", "h4", "h5", "h6")
            if self.text[k] and not heading and not self.dropped[k]:
                rest[near[k]] = True
            if self.tag[k] in ("h1", "main") and not self.dropped[k]:
                wraps.add(near[k])
        for k in reversed(marked):  # what a part holds, those around it hold as well
            if k in wraps:
                wraps.add(near[self.parent[k]])
        out = {}
        seen = {0: False}
        for k in marked:
            up = near[self.parent[k]]
            seen[k] = seen[up] or rest[up]
            out[k] = seen[k] and k not in wraps
        return out

    def scores(self) -> list[tuple[float, int]]:
        """(score, block) of the containers with text, best first; equal scores in page order."""
        score: dict[int, float] = {}
        for k in range(1, len(self.tag)):
            if self.dropped[k]:
                continue
            value = self.text[k] - self.links[k]
            at, weight = k, 1.0
            if value <= 0:
                continue
            while at > 0 and weight > 0.01:
                if self.tag[at] in _CONTAINERS:
                    score[at] = score.get(at, 0.0) + weight * value
                    weight /= 2
                at = self.parent[at]
        return sorted(((s, k) for k, s in score.items()), key=lambda x: (-x[0], x[1]))

    def inside(self, blocks: list[int]) -> str:
        """The content of the blocks: white space collapsed, references decoded."""
        wanted = [False] * len(self.tag)
        for k in blocks:
            wanted[k] = True
        for k in range(1, len(self.tag)):
            wanted[k] = wanted[k] or wanted[self.parent[k]]
        joined = "".join(piece for k, piece, _ in self.events if wanted[k] and not self.dropped[k])
        return " ".join(entities.unescape(joined).split())

    def extract(self, paths: list[str], votes: list[int] | None = None) -> str:
        at: dict[str, list[int]] = {}
        for k, path in enumerate(self.path):
            if not self.dropped[k]:
                at.setdefault(path, []).append(k)
        found = [p for p in paths if p in at]
        best = self.scores()
        score: dict[str, float] = {}
        for s, k in best:
            score.setdefault(self.path[k], s)
        if votes:
            weight = dict(zip(paths, votes, strict=True))
            found.sort(key=lambda p: -weight[p] * score.get(p, 0.0))
        for path in found:
            # A container around the one at a kept path must not take its place.
            below = [p for p in found if p.startswith(path + "/") and score.get(p, 0.0) > score.get(path, 0.0)]
            chosen = max(below, key=lambda p: score[p], default=path)
            if text := self.inside(at[chosen]):
                return text
        if best:
            return self.inside([best[0][1]])
        return self.inside([0])


def votes_of(html: str | None) -> list[tuple[str, float]]:
    if not html:
        return []
    page = Page(html)
    best = page.scores()[:VOTES]
    return [(page.path[k], s / best[0][0]) for s, k in best]


def extract(html: str | None, paths: list[str] | None, votes: list[int] | None = None) -> str:
    """The main text by the host's paths: those of most votes times score on this page first, or without votes in their order."""
    return Page(html).extract(paths or [], votes) if html else ""


def host_of(url: Column) -> Column:
    """The host of an address in lower case; empty for a null or an address without one."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit(""))


def _voting(batches):
    common.begin(__name__)
    for batch in batches:
        hosts, paths, shares, firsts = [], [], [], []
        for host, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            votes = votes_of(html)
            for k, (path, share) in enumerate(votes):
                if k and votes[0][0].startswith(path + "/"):
                    continue
                hosts.append(host)
                paths.append(path)
                shares.append(share)
                firsts.append(int(k == 0))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(shares, pa.float64()), pa.array(firsts, pa.int64())], ["host", "path", "share", "first"])


def _extracting(batches):
    common.begin(__name__)
    for batch in batches:
        page_id, url, html, paths, votes = batch.columns
        texts = [extract(h.as_py(), p, v) for h, p, v in zip(html, paths.to_pylist(), votes.to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([page_id, url, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, paths, path_votes): the paths that stay, those with most votes first; equal votes by path."""
    cast = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_voting, "host string, path string, share double, first long")
    # Shares are added as whole millionths, so that their order doesn't matter.
    votes = cast.groupBy("host", "path").agg(F.sum(F.round(F.col("share") * 1e6).cast("long")).alias("votes"), F.sum("first").alias("firsts")).where("firsts > 0")
    most = F.row_number().over(Window.partitionBy("host").orderBy(F.col("firsts").desc(), F.col("votes").desc(), "path"))
    first = F.row_number().over(Window.partitionBy("host").orderBy(F.col("votes").desc(), "path"))
    best = votes.withColumns({"place": first, "most": most, "n": F.sum("firsts").over(Window.partitionBy("host"))}).where((F.col("most") <= WINNERS) | (F.col("firsts") >= F.lit(SHARE) * F.col("n")))
    kept = best.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("place", "path", "votes"))).alias("kept"))
    return kept.select("host", F.col("kept.path").alias("paths"), F.col("kept.votes").alias("path_votes"))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    A null or empty page gives an empty text; a null url counts as a host of its own. Repeated rows are
    extracted each; an empty table gives an empty result; other columns are not read.
    """
    winners = common.written(winning_paths(pages), "host-paths")
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    plain = plain.withColumn("host", host_of(F.col("url")))
    if (winners.agg(F.sum(F.size("paths"))).first()[0] or 0) <= BROADCAST_ROWS:
        joined = plain.join(F.broadcast(winners), "host", "left")
    else:
        plain = plain.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        joined = plain.join(winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "paths", "path_votes").mapInArrow(_extracting, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: the main text of every page."""
    return main_text(common.table(spark, sf_dir, "pages", "page_id", "url", "html"))
