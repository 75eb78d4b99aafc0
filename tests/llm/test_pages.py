"""Main text of pages and fixity of page archives."""

import hashlib
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from voltide.llm import html_density, queries, warc_fixity
from voltide.llm.html_density import BLOCK, _Tree, densities, main_text

LONG = "Some long paragraph of text that goes on and on for quite a while."


@pytest.mark.parametrize(("html", "want"), [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<script>var a='<p>x</p>'</script><!-- none -->", ""),
    (f"<article><h1>T</h1><p>{LONG}\n {LONG}<br>x</article><footer>f</footer>", f"T\n\n{LONG} {LONG} x"),
    (f"<nav><a href=/>Home</a></nav><div class='ad'>Buy {LONG}</div><article><p>{LONG}</p></article>", LONG),
    (f"<div class=post><p>{LONG}<p>{LONG}</div><div class=comments><p>{LONG}</div>", f"{LONG}\n\n{LONG}"),
    (f"<div><div><p>{LONG}</p><ul><li>a<li>b</ul></div><ul><li><a href=x>one</a><li><a href=y>two</a></ul></div>", f"{LONG}\n\na\n\nb"),
    (f"<main><header><h1>Head</h1></header><p>{LONG}</p><aside>no</aside><form>no</form><p>&lt;b&gt; &eacute;</p></main>", f"Head\n\n{LONG}\n\n<b> é"),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"), ("<p>" * 2000 + "x" * 100_000, "x" * 100_000),
])
def test_main_text(html, want):
    assert main_text(html) == want


def items(n, size, tag="p"):
    return [f"{tag}{k} ".ljust(size, "x") for k in range(n)]


def marked(texts, tag="p"):
    return "".join(f"<{tag}>{t}</{tag}>" for t in texts)


@pytest.mark.parametrize("around", ["<article>{}</article>", "<main><div>{}</div></main>", "<div>{}</div>", "<nav>Some menu</nav><div>{}</div>", "<nav>Some menu</nav>{}"])
def test_thin_parts_of_a_text_stay(around):
    """Short paragraphs next to a long list, and a short section behind a long one."""
    short, long = items(3, 100), items(20, 60, "li")
    assert main_text("<body>" + around.format(f"{marked(short)}<ul>{marked(long, 'li')}</ul>") + "<footer>f</footer></body>") == "\n\n".join(short + long)
    first, second = items(10, 300), items(2, 40, "q")
    html = f"<section>{marked(first)}</section><section><h2>Second</h2>{marked(second)}<p><a href=x>Linked</a></p></section>"
    assert main_text("<body>" + around.format(html) + "<footer>f</footer></body>") == "\n\n".join([*first, "Second", *second, "Linked"])


@pytest.mark.parametrize("wrapper", [
    "<div class='content has-sidebar'>{}</div>", "<div class='no-sidebar'>{}</div>", "<div id='page-with-sidebar'>{}</div>", "<div class='post share-enabled'>{}</div>",
    "<div class='legal-history'>{}</div>", "<section class='discussion'>{}</section>", "<form action=/>{}</form>", "<form><div id=login>{}</div></form>",
])
@pytest.mark.parametrize("part", ["<article>{}</article>", "<main>{}</main>", "<div>{}</div>", "{}"])
def test_a_wrapper_is_not_skipped(wrapper, part):
    menu = "<nav><a href=/>Home</a><a href=/a>About</a></nav>"
    side = f"<div class='box sidebar'>{LONG}</div><form>Search</form>"
    html = wrapper.format(menu + part.format(f"<p>{LONG} 1</p><p>{LONG} 2</p>") + side)
    assert main_text(f"<body>{html}<footer>f</footer></body>") == f"{LONG} 1\n\n{LONG} 2"


@pytest.mark.parametrize("name", [
    "cookie-banner", "site-footer", "ad-slot", "comments-list", "comments-section", "related-posts", "user-comments", "siteFooter", "post_comments", "AdSlot top",
])
@pytest.mark.parametrize("page", ["<article>{}</article>{}", "<main>{}{}</main>", "<div>{}{}</div>", "<div><div>{}</div>{}</div>"])
def test_compound_names_mark_asides(name, page):
    assert main_text("<body>" + page.format(f"<p>{LONG} 1</p><p>{LONG} 2</p>", f"<div class='{name}'><p>{LONG}</p></div>")) == f"{LONG} 1\n\n{LONG} 2"


@pytest.mark.parametrize("page", ["{}{}", "<main>{}{}</main>", "<main>{}<div>{}</div></main>", "<div>{}</div><div><div>{}</div></div>"])
def test_cards_are_no_articles(page):
    text = items(12, 200)
    cards = "".join(f"<article><h3><a href=/{k}>Title of card {k}</a></h3><p>A short line on it.</p></article>" for k in range(4))
    assert main_text("<body>" + page.format(f"<article>{marked(text)}</article>", cards)) == "\n\n".join(text)
    assert main_text(f"<article>{marked(text[:6])}</article><article>{marked(text[6:])}</article>") == "\n\n".join(text)


@pytest.mark.parametrize("end", ["<!-- unclosed", "<a href='", "<a hr", "</art", "<!doctype", "<!-- x --", "<?php echo", "<![CDATA[x"])
def test_cut_markup_is_no_text(end):
    assert main_text(f"<p>{LONG}{end}") == LONG


@pytest.mark.parametrize("start", ["<!DOCTYPE html [<!ENTITY a 'b'> <!ELEMENT c (d)> ]>", "<![bogus[x]]>", "<![ CDATA[x>", "<![%foo;[x]]>", "<!>", "<!x>", "</ x>", "<?xml version='1.0'?>"])
def test_declarations_are_no_text(start):
    assert main_text(f"{start}<p>{LONG}") in (LONG, "]]>\n\n" + LONG, "]]> " + LONG)


def test_any_markup_is_read():
    rng = random.Random(7)
    pieces = ["<", ">", "!", "[", "]", "--", "&", "#", ";", "x", "'", '"', "=", "/", " ", "<!", "<![", "]]>", "<!--", "-->", "CDATA[", "<script>", "</script", "<p", "<article>",
              "</div>", "<div class=ad>", "&amp", "&#x110000;", "&#0;", "<?", "<!DOCTYPE", "%", "<table><tr><td>", "<title>", "\x00", "é", "<svg/>", "<b", "</", "text "]
    for _ in range(4000):
        main_text("".join(rng.choice(pieces) for _ in range(rng.randrange(30))))


@pytest.mark.parametrize("html", ["<b>" * 100_000 + "</i>" * 100_000, "<p><table>" + "<b>" * 50_000 + "<div></div>" * 50_000, "<ul>" + "<li><b>" * 50_000, "<header>" * 50_000 + "x"])
def test_time_follows_length(html):
    start = time.time()
    main_text(html)
    assert time.time() - start < 8


def plain_density(tree, k):
    """Composite density by its definition, by recursion over the tree."""
    children = {}
    for child, up in enumerate(tree.parents):
        children.setdefault(up, []).append(child)

    def below(k):
        return [k, *(x for c in children.get(k, []) if not tree.skipped[c] for x in below(c))]

    def linked(k):
        return k > 0 and (tree.tags[k] == "a" or linked(tree.parents[k]))

    def size(nodes):
        return sum(len("".join(t.split())) for j, t in tree.texts if t and j in nodes)

    def one(k):
        nodes = below(k)
        c, lc = size(set(nodes)), size({j for j in nodes if linked(j)})
        t, lt = max(1, len(nodes) - 1), max(1, sum(tree.tags[j] == "a" for j in nodes[1:]))
        if not c or tree.skipped[k]:
            return 0.0
        everything = below(0)
        share = size({j for j in everything if linked(j)}) / size(set(everything))
        return c / t * max(0.0, math.log(c / max(1, lc) * t / lt)) / math.log(c / max(1, c - lc) * lc + share * c + math.e)

    def blocks(k):
        out = []
        for c in children.get(k, []):
            if not tree.skipped[c]:
                out += [c] if tree.tags[c] in BLOCK else blocks(c)
        return out

    return one(k), (sum(one(c) for c in blocks(k)) or one(k)) if k == 0 or tree.tags[k] in BLOCK else 0.0


def test_densities_by_definition():
    rng = random.Random(3)
    for _ in range(60):
        html = "".join(rng.choice(["<div>", "<p>", "</p>", "</div>", "<a href=x>", "</a>", "<b>", "</b>", "some text ", "more", "<ul><li>", "</ul>", "<nav>", "</nav>"]) for _ in range(40))
        tree = _Tree()
        tree.feed(html)
        tree.close()
        density, sums, *_ = densities(tree.tags, tree.parents, tree.skipped, tree.texts)
        for k in range(len(tree.tags)):
            assert (density[k], sums[k]) == pytest.approx(plain_density(tree, k), rel=1e-9, abs=1e-9), (html, k)


def test_asides_around_no_article_are_skipped():
    assert main_text(f"<article><p>{LONG}</p></article><div class='Ad top'>{LONG * 9}</div><form>{LONG * 9}</form><footer><article></article>{LONG * 9}</footer>") == LONG
    assert main_text(f"<article><p>{LONG * 2}</p></article><div class=comments><article>{LONG}</article></div>") == f"{LONG * 2}"
    assert main_text(f"<form><main><p>{LONG}</p></main></form><article>{LONG * 2}</article>") == f"{LONG}\n\n{LONG * 2}"
    assert main_text(f"<div class=nav-less><p>{LONG}</p></div><div class=ad>{LONG}</div>") == LONG


def test_link_lists_of_an_article_go():
    links = "<ul><li><a href=x>one</a><li><b><a href=y>two</a></b></ul>"
    assert main_text(f"<article><div>{f'<p>{LONG}</p>' * 9}</div><div><p>Short.</p>{links}</div></article>") == "\n\n".join([LONG] * 9 + ["Short."])
    assert main_text(f"<article><p>{LONG * 9}</p></article><article><p>Short post.</p></article>") == f"{LONG * 9}\n\nShort post."
    assert main_text(f"<div><p>{LONG}</p><p>{LONG}</p></div><article>teaser</article>").startswith(LONG)


def test_extract(spark):
    rows = [(1, "u", "<p>One two</p>", "x", "y"), (None, None, None, "x", "y"), (1, "u", "<p>One two</p>", "x", "y"), (2, "v", "", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, _html string")
    got = sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in html_density.extract(pages).collect())
    assert got == [(0, None, "", 0), (1, "u", "One two", 7), (1, "u", "One two", 7), (2, "v", "", 0)]
    assert html_density.extract(pages.limit(0)).count() == 0


def test_link_text_lowers_density():
    def of(html):
        tree = html_density._Tree()
        tree.feed(html)
        return html_density.densities(tree.tags, tree.parents, tree.skipped, tree.texts)[0][1]

    assert of(f"<div>{LONG}<a href=x>{LONG}</a></div>") < of(f"<div>{LONG}<b>{LONG}</b></div>")


@pytest.fixture
def index(spark):
    pages = spark.range(5000).select(
        F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"), F.repeat(F.lit("payload "), (F.col("id") % 60).cast("int")).alias("html"))
    return warc_fixity.archived(pages)


def test_offsets_and_digests(spark):
    pages = spark.createDataFrame([(2, "u2", "é"), (1, "u1", None), (None, None, "z"), (None, None, "z"), (1500, "u", "")], "page_id long, url string, html string")
    got = warc_fixity.archived(pages).orderBy("archive", "offset").collect()
    assert [r.id for r in got if r.archive == "0"] == [1, 2] and [r.offset for r in got if r.archive == "0"] == [0, got[0].length]
    text = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:2>\r\nWARC-Target-URI: u2\r\nContent-Type: text/html\r\nContent-Length: 2\r\n\r\né\r\n\r\n"
    assert got[1].digest == hashlib.sha256(text.encode()).hexdigest() and got[1].length == len(text.encode())
    assert len(got) == 5


def test_equal_replicas(index):
    assert warc_fixity.audit(index, index.repartition(3)).count() == 0
    assert warc_fixity.audit(index.limit(0), index.limit(0)).count() == 0


@pytest.mark.parametrize(("leaf", "fanout"), [(1 << 16, 16), (512, 2)])
def test_damage_is_found(index, leaf, fanout, monkeypatch):
    monkeypatch.setattr(warc_fixity, "LEAF_BYTES", leaf)
    monkeypatch.setattr(warc_fixity, "FANOUT", fanout)
    other = index.where("id % 701 <> 3").withColumn("digest", F.when(F.col("id") % 997 == 5, "bad").otherwise(F.col("digest")))
    other = other.union(other.where("id = 77").selectExpr("archive", "offset + 1", "length", "id + 100000", "'new'"))
    got = {(r.id, r.status) for r in warc_fixity.audit(index, other).collect()}
    want = {(k, "missing") for k in range(5000) if k % 701 == 3} | {(k, "altered") for k in range(5000) if k % 997 == 5 and k % 701 != 3} | {(100077, "extra")}
    assert got == want


def test_query_with_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, "u", "a"), (None, "u", "a"), (None, None, None), (7, "u", "one"), (7, "u", "other"), (7, "u", "one"), (5, "u", "xy"), (5, "u", "xz"), (17, "u", "q"), (8, "u", "z")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(((r.page_id or 0, r.status) for r in queries.QUERIES["op2_warc_fixity"](spark, str(tmp_path)).collect()))
    assert got == [*[(0, "intact")] * 3, *[(5, "altered")] * 2, *[(7, "intact")] * 3, (8, "intact"), (17, "missing")]


def test_node_digests(spark):
    rows = [("a", 0, "x"), ("a", 70_000, None), ("a", 10, "y"), ("b", 5, "x"), ("b", 5, "x")]
    nodes = warc_fixity.merkle_nodes(spark.createDataFrame(rows, "archive string, offset long, digest string"), 2).collect()

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    found = {(n.archive, n.level, n.node): n.digest for n in nodes}
    assert found["a", 0, 0] == sha("0:x\n10:y") and found["a", 0, 1] == sha("70000:") and found["b", 0, 0] == sha("5:x\n5:x")
    assert found["a", 1, 0] == sha(f"0:{found['a', 0, 0]}\n1:{found['a', 0, 1]}")
