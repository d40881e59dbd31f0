"""Main text of pages: every page scores its containers, the pages of a host vote on a path, and the texts are taken from where the winning path leads."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.functions import dom
from lakeweave.llm.common import column, written
from lakeweave.llm.words import slices

#: Never part of a text, wherever they stand.
UNSEEN = frozenset("script style noscript template head title svg canvas iframe object embed audio video math map select option datalist button input textarea label fieldset dialog menu nav aside footer".split())
#: Words in class, id or role that tell what is not the article.
SIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promoted promotion nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar sidebar rail "
    "footer masthead banner cookie cookies consent gdpr notice notices notification alert popup modal overlay paywall newsletter subscribe subscription signup login share sharing social follow related recommended recommendations "
    "comment comments commentlist disqus respond reply replies search searchbox widget widgets skip hidden complementary contentinfo".split()
)
#: What may hold an article; they make up paths.
HOLDERS = frozenset("body main article section div td center blockquote".split())
#: A text ends where these begin or end.
BLOCKS = HOLDERS | frozenset("html header p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr th pre figure figcaption address form hr hgroup details summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A page votes for the innermost holder with so much of the best one's score.
ENOUGH = 0.8
#: Paths with so much of a host's votes win there; these are few.
LEAST_SHARE = 0.1
#: A longer path goes on from its digest, so that deep pages stay small.
LONGEST_PATH = 1000
_WORD, _CAMEL, _DIGITS = re.compile(r"[a-z]+"), re.compile(r"(?<=[a-z])(?=[A-Z])"), re.compile(r"[0-9]+")


def _words(n: dom.Node) -> set[str]:
    named = " ".join(n.attrs.get(k) or "" for k in ("class", "id", "role"))
    return set(_WORD.findall(_CAMEL.sub("-", named).lower())) if named.strip() else set()


def _wrappers(root: dom.Node) -> set[int]:
    """Identities of the nodes around articles, main parts and first headings."""
    around: set[int] = set()
    for n in root.all("article", "main", "h1"):
        up = n.parent
        while up is not None and id(up) not in around:
            around.add(id(up))
            up = up.parent
    return around


def _beside(n: dom.Node, words: set[str], around: set[int]) -> bool:
    """Whether a node and all in it is beside the article. A form around an article is only a wrapper."""
    if n.tag in UNSEEN:
        return True
    if n.tag in ("", "html", "body", "main", "article"):
        return False
    if n.tag == "form":
        return id(n) not in around
    return "hidden" in n.attrs or n.attrs.get("aria-hidden") == "true" or bool(words & SIDE)


def _step(n: dom.Node) -> str:
    """A holder as a part of a path: tag and classes, numbers in these made equal. A body's classes are its page's own."""
    named = set() if n.tag == "body" else {_DIGITS.sub("0", c.lower()).replace("/", "_") for c in n.classes}
    return ".".join([n.tag, *sorted(named)])


class Page:
    """What a page says, in order, without what is beside the article; and the path, score and extent of each holder."""

    def __init__(self, html: str | None) -> None:
        #: Texts, and None where a block begins or ends.
        self.items: list[str | None] = []
        #: path, first item, item behind the last, and score: characters of plain text, less those of links twice over
        self.holders: list[tuple[str, int, int, int]] = []
        root = dom.parse(html)
        around = _wrappers(root)
        gain, open_holders = 0, []
        # node, path of the holder around it, in a link, in the head of an article; a node of None ends a block
        stack: list[tuple[dom.Node | None, str, bool, bool]] = [(root, "", False, False)]
        while stack:
            n, path, linked, head = stack.pop()
            if n is None:
                self.items.append(None)
                if path:
                    k, before = open_holders.pop()
                    self.holders[k] = (*self.holders[k][:2], len(self.items), gain - before)
            elif n.tag is None:
                if not head:
                    self.items.append(n.text)
                    size = len("".join(n.text.split()))
                    gain += -2 * size if linked else size
            elif n.tag == "br":
                self.items.append(" ")
            else:
                words = _words(n)
                if _beside(n, words, around):
                    continue
                if n.tag == "header" or ("header" in words and n.tag not in HEADINGS):
                    if path in ("/page", "/page/body"):
                        continue  # the site's
                    head = True  # of an article's, headings stay
                head &= n.tag not in HEADINGS
                holds = n.tag in HOLDERS or n.tag == ""
                if holds:
                    path = f"{path}/{_step(n) if n.tag else 'page'}"
                    path = path if len(path) <= LONGEST_PATH else "#" + hashlib.sha256(path.encode()).hexdigest()
                    open_holders.append((len(self.holders), gain))
                    self.holders.append((path, len(self.items), 0, 0))
                if holds or n.tag in BLOCKS:
                    self.items.append(None)
                    stack.append((None, path if holds else "", False, False))
                stack.extend((k, path, linked or n.tag == "a", head) for k in reversed(n.kids))

    def vote(self) -> tuple[str, int]:
        """Path and score of the innermost holder with most of the best score; an article or main part among these is preferred. Where nothing scores, of the first article, main part or the page."""
        best = max(h[3] for h in self.holders)
        named = [h for h in self.holders if h[0].rpartition("/")[2].partition(".")[0] in ("article", "main")]
        if best <= 0:
            return (named or self.holders)[0][0], 0
        good = [h for h in self.holders if h[3] >= ENOUGH * best]
        pick = ([h for h in named if h[3] >= ENOUGH * best] or good)[-1]
        return pick[0], pick[3]

    def text(self, path: str) -> str:
        """The texts of all holders with the path, a line a block."""
        out, end = [], 0
        for p, first, behind, _ in self.holders:
            if p == path and first >= end:
                end = behind
                out.append(None)
                out += self.items[first:behind]
        lines, run = [], []
        for item in [*out, None]:
            if item is not None:
                run.append(item)
            elif run:
                lines.append(" ".join("".join(run).split()))
                run = []
        return "\n".join(x for x in lines if x)

    def main_text(self, winners: list[str]) -> tuple[str, str]:
        """Text and path: of the first winning path that says anything here, else of the page's own vote."""
        for path in winners:
            if any(h[0] == path for h in self.holders) and (text := self.text(path)):
                return text, path
        path = self.vote()[0]
        return self.text(path), path


def host_of(url: Column) -> Column:
    """Host in lower case, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def host_paths(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """host and its winning paths, those with most votes first: rows host, winners.

    Tasks emit a host, path and score a page, which Spark adds up before the shuffle and after it;
    a path has to have ``LEAST_SHARE`` of its host's votes, so that lists are short. Pages without
    a host or without plain text have no vote.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            votes = [Page(h.as_py()).vote() for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([v[0] for v in votes], pa.string()), pa.array([v[1] for v in votes], pa.int64())], ["host", "path", "score"])

    rows = pages.select(host_of(column(url_col)).alias("host"), column(html_col).alias("html")).where("host <> ''")
    votes = rows.mapInArrow(run, "host string, path string, score long").where("score > 0").groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("score").alias("score"))
    votes = written(votes, "votes")
    total = votes.groupBy("host").agg(F.sum("votes").alias("total"))
    won = votes.join(total, "host").where(F.col("votes") >= F.lit(LEAST_SHARE) * F.col("total"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), (-F.col("score")).alias("s"), "path")))
    return written(won.groupBy("host").agg(order.alias("o")).select("host", F.col("o.path").alias("winners")), "winners")


def main_texts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """page_id, url, text, n_chars and path (of the part that was taken) of every page's main text.

    The pages of a host agree on paths (``host_paths``), then each page is read again by its
    host's; one that has none of these paths goes by its own vote. Winners are a few short strings
    a host: Spark broadcasts them where their written size is below its threshold, and else joins
    by host, splitting hot ones.

    Null html is an empty page with an empty text. Pages without a host in their url, or without a
    url, go by their own votes. Repeated rows and null ids give rows of their own; whatever the
    markup, however deep, there is a tree. An empty table gives no rows; other columns are not
    looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            got = [Page(h.as_py()).main_text(w.as_py() or []) for h, w in zip(batch.column("html"), batch.column("winners"), strict=True)]
            texts, paths = [g[0] for g in got], [g[1] for g in got]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(paths, pa.string())], ["page_id", "url", "text", "n_chars", "path"])

    rows = pages.select(column(id_col).cast("long").alias("page_id"), column(url_col).cast("string").alias("url"), column(html_col).alias("html"), host_of(column(url_col)).alias("host"))
    joined = rows.join(host_paths(pages, html_col, url_col), "host", "left").select("page_id", "url", "html", "winners")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long, path string")
