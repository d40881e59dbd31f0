"""Source audit, fill-in-the-middle and main texts of pages against brute force."""

from __future__ import annotations

import collections
import hashlib
import html
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeweave.llm import fill_middle, html_extract, source_audit

TEXTS = [None, "", " ", "a", "A a-a ÄÄ ä\x7fb", "idea İ ıX K", "one two one", "x" * 70_000, "é é 日本", "<P>", "z9z"]


def clashing(df, *names):
    for n in names:
        df = df.withColumn(n, F.lit("x"))
    return df


# --- source audit ---------------------------------------------------------------------------


def audit(docs, least, top):
    """The statement word for word, in whole numbers."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))) for t, lang, source in docs]
    in_docs, counts = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for lang, source, terms in docs:
        in_docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in in_docs:
        kept = {t for t, n in in_docs[lang].items() if n >= least}
        groups = {s: {t: c[t] for t in kept} for (at, s), c in counts.items() if at == lang}
        groups[None] = {t: sum(g[t] for g in groups.values()) for t in kept}
        p = {s: {t: 1 + 10**9 * (n + 5) // (sum(g.values()) + 5 * len(kept)) for t, n in g.items()} for s, g in groups.items()}
        for s in groups:
            if s is not None:
                pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in groups if o not in (s, None))
                terms = sorted((p[None][t] - p[s][t], t.encode(), t) for t in kept if groups[s][t] and p[s][t] > p[None][t])[:top]
                for part, rows in (("pair", pairs), ("term", terms)):
                    out += [(lang, s, part, item, -value, k) for k, (value, _, item) in enumerate(rows, 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "band"), [(1 << 14, 32), (3, 2)])
def test_source_divergence(spark, monkeypatch, block, band):
    monkeypatch.setattr(source_audit, "BLOCK", block)
    monkeypatch.setattr(source_audit, "BAND", band)
    r = random.Random(block)
    words = ["word", "Wort", "wort", "ñu", "日本", "x", "Éa", "éa", *(f"{a}{b}" for a, b in itertools.product("abcdef", "uvw"))]
    docs = [(" ".join(r.choices(words, k=r.randrange(30))), r.choice(["en", "de", "de", None]), r.choice(["s1", "s2", "s3", "S2", "é", None])) for _ in range(300)]
    docs += [(t, "xx", s) for t in TEXTS for s in ("a", "b")] + [("rare", "none", s) for s in ("q", "p", "p")] + [(None, "en", "silent")]
    df = clashing(spark.createDataFrame(docs, "text string, lang string, source string"), "term", "count", "docs", "id", "value", "item", "rank", "kept", "band", "total")
    got = sorted(tuple(x) for x in source_audit.source_divergence(df, least_docs=4, top=5).collect())
    want = audit(docs, 4, 5)
    assert got == want, ([x for x in got if x[:3] == ("en", "", "pair")], [x for x in want if x[:3] == ("en", "", "pair")])
    assert any(x[0] == "none" and x[4] == 0 for x in got) and source_audit.source_divergence(df.limit(0)).count() == 0


def test_terms_of_texts():
    for texts in (TEXTS, TEXTS[3:6], [None], []):
        words, code, text = source_audit.terms(pa.array([t or "" for t in texts], pa.string()))
        want = [(k, w) for k, t in enumerate(texts) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
        assert [(k, words[c].as_py()) for k, c in zip(text.tolist(), code.tolist(), strict=True)] == want


def test_common_places():
    r = np.random.default_rng(3)
    for n, m, top in ((0, 5, 9), (7, 900, 1000), (400, 500, 600), (300, 300, 300), (50, 2, 60)):
        for _ in range(20):
            a, b = (np.sort(r.choice(top, min(k, top), replace=False)) for k in (n, m))
            at_a, at_b = source_audit.common_places(a, b, run=8)
            assert a[at_a].tolist() == b[at_b].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_shares_of_large_counts(spark):
    counts = [0, 1, 10**10, 3 * 10**12]
    total, kept = sum(counts) + 10**13, 123_456_789
    want = [1 + 10**9 * (c + 5) // (total + 5 * kept) for c in counts]
    assert source_audit.shares(np.array(counts), total, kept).tolist() == want
    df = spark.createDataFrame([(c,) for c in counts], "c long")
    assert [r[0] for r in df.select(source_audit.share(F.col("c"), F.lit(total), F.lit(kept))).collect()] == want


# --- fill in the middle ---------------------------------------------------------------------


def middle(doc_id, text, seed=1):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if text == "" or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("stretch", [1, 5, 1 << 20])
def test_unit_ends(stretch):
    r = random.Random(stretch)
    for _ in range(300):
        t = "".join(r.choices("abZ .é\n😀\x00<", k=r.randrange(50)))
        assert fill_middle.unit_ends(t, stretch).tolist() == [m.end() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", t)]


def test_fill_in_middle(spark):
    r = random.Random(5)
    docs = list(enumerate(TEXTS)) + [(i, "".join(r.choices(["a", "bc", "<", "P", ">", "<S", "S>", "\n", "é", "M>", "<M", " "], k=r.randrange(25)))) for i in range(100, 900)] + [(None, "a b c"), (7, "a b c"), (7, "a b c"), (-3, "d e f"), (8, "ab 1 " * 60_000)]
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string"), "n", "form", "output", "prefix_chars")
    got = sorted((tuple(x) for x in fill_middle.fill_in_middle(df).collect()), key=str)
    assert got == sorted(((i, *middle(i, t)) for i, t in docs), key=str)
    assert {x[2] for x in got} == {"plain", "psm", "spm"}
    back = fill_middle.fill_in_middle(df).select("doc_id", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(tuple, back), key=str) == sorted(((i, t or "") for i, t in docs), key=str)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted((tuple(x)[5:] for x in fill_middle.middle_digests(df).collect())) == sorted((sha(middle(i, t)[4]), sha(t or "")) for i, t in docs)
    assert fill_middle.middle_digests(df.limit(0)).count() == 0


# --- main texts -----------------------------------------------------------------------------

ASIDES = [
    "<nav><ul><li><a href=/x>Menu</a></ul></nav>", '<div class="side-bar sidebar-left">More of us</div>', '<div id="cookieNotice">We use cookies</div>', '<form action=/s><input name=q>Search here</form>', "<script>var a = '<p>no</p>';</script>",
    "<style>p{}</style>", '<aside>Related reading that is long enough to matter</aside>', '<div class="ad-slot">Buy this now, it is cheap and good</div>', '<section class="comments"><p>I think that this is wrong, dear author.</p></section>', "<!-- nothing -->", "<noscript>Turn it on</noscript>", '<ul class="share"><li>Post it</ul>',
]


def page(r, host_class, paragraphs):
    """A page of a host, and its text."""
    head = f"Title {paragraphs[0][:9]}".strip()
    inner, lines = [f"<h1>{html.escape(head)}</h1>"], [head]
    for p in paragraphs:
        inner.append(r.choice(["<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<div>{}</div>", "<ul><li>{}</ul>"]).format(html.escape(p).replace(" ", r.choice([" ", "\n  ", "&#32;", "<!-- c --> "]))))
        lines.append(p)
        inner += r.sample(ASIDES, r.randrange(2))
    body = r.sample(ASIDES, 4)
    body.insert(r.randrange(5), f'<div class="wrap"><header><h1>The site</h1><a href=/>home</a></header><{host_class.format(r.randrange(1000))}>{"".join(inner)}</{host_class.split()[0]}></div>')
    return f"<!DOCTYPE html><html><head><title>t</title></head><body class=p{r.randrange(99)}>{''.join(body)}<footer>&copy; us</footer>" + r.choice(["</body></html>", ""]), "\n".join(lines)


@pytest.fixture(scope="module")
def site():
    r = random.Random(13)
    words = ["lorem", "ipsum", "R&D", "<b>", "dolor", "été", "\"x\"", "1,5"]
    out = []
    for host, tag in (("a.example.org", 'div class="post-{} entry"'), ("b.example.org", "article"), ("c.example.org:8080", 'main id="m{}"')):
        for i in range(30):
            text = [" ".join(r.choices(words, k=r.randrange(1, 40))) for _ in range(r.randrange(1, 7))]
            out.append((len(out), f"https://{host}/{i}", *page(r, tag, text)))
    return out


def test_main_texts(spark, site):
    df = spark.createDataFrame([(i, u, h) for i, u, h, _ in site], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_extract.main_texts(clashing(df, "host", "text", "path", "winners")).collect()}
    wrong = [(i, got[i].text, t) for i, _, _, t in site if got[i].text != t]
    assert not wrong, wrong[:2]
    assert all(got[i].n_chars == len(t) and got[i].url == u for i, u, _, t in site)
    assert {r.path for r in got.values()} == {"/page/body/div.wrap/div.entry.post-0", "/page/body/div.wrap/article", "/page/body/div.wrap/main"}


def test_a_host_outvotes_a_page(spark):
    """A short article beside a long block that nothing tells apart; alone, the page takes the block."""
    often = '<body><div class="story"><p>{}</p></div><div class="x1"><p>short</p></div></body>'
    odd = '<body><div class="story"><p>brief</p></div><div class="x1"><p>{}</p></div></body>'.format("a long block of something else " * 9)
    pages = [(i, f"http://h.org/{i}", often.format(f"text {i} " * 40)) for i in range(12)] + [(99, "http://H.org/99", odd), (100, None, odd), (101, "no host", odd)]
    got = {r.page_id: r.text for r in html_extract.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[3] == ("text 3 " * 40).strip() and got[99] == "brief"
    assert got[100] == got[101] == ("a long block of something else " * 9).strip()


def test_odd_pages(spark):
    pages = [(1, None), (2, ""), (3, "plain &amp text"), (4, "<p>" * 30_000 + "deep"), (5, "<div><section>" * 3_000 + "deep" + "</section></div>" * 3_000), (6, "<nav>x</nav>"), (7, "a<b"), (8, "<article></article>"), (9, "<article><a href=x>only a link</a></article>"), (None, "<p>no id"), (None, "<p>no id"), (10, "<p>x</p>" * 60_000), (11, "<body><form><article>in a form</article></form>"), (12, "<form>" * 20_000 + "<p>x"), (13, "<form>" * 20_000 + "<h1>x")]
    df = spark.createDataFrame([(i, "http://o.org", h) for i, h in pages], "page_id long, url string, html string")
    got = sorted(((r.page_id, r.text) for r in html_extract.main_texts(df).collect()), key=str)
    want = [(1, ""), (2, ""), (3, "plain & text"), (4, "deep"), (5, "deep"), (6, ""), (7, "a<b"), (8, ""), (9, "only a link"), (None, "no id"), (None, "no id"), (10, "\n".join("x" * 60_000)), (11, "in a form"), (12, ""), (13, "x")]
    assert [(i, len(t), t[:50]) for i, t in got] == [(i, len(t), t[:50]) for i, t in sorted(want, key=str)]
    assert html_extract.main_texts(df.limit(0)).count() == 0
