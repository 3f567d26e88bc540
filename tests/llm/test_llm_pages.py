"""Main text of pages: templates of known slots, broken markup, and edge cases."""

import random
import re

import pytest

from conftest import DATA
from ethoframe.llm import pages, queries

WORDS = "alder birch cedar dogwood elm fir gum hazel ivy juniper kapok larch maple nutmeg oak pine quince rowan spruce teak".split()


def sentence(rng, n=12):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def semantic(rng, i):
    body = [sentence(rng, 20) for _ in range(rng.randint(1, 6))]
    html = f"""<!doctype html><html><head><title>T {i}</title><script>var a = "<p>no</p>";</script><style>p {{}}</style></head><body class="has-sidebar">
    <header><h2>Site {sentence(rng, 3)}</h2></header><nav><ul><li><a href="/a">{rng.choice(WORDS)}</a></ul></nav>
    <div class="cookie-notice">We use cookies {rng.choice(WORDS)}</div><main><article id="post-{i}"><header><h1>Title &amp; {i}</h1></header>
    {"".join(f"<p>{x}</p>" for x in body[:1])}<div class="ad-slot">Buy {rng.choice(WORDS)}</div>{"".join(f"<p>{x}" for x in body[1:])}
    <aside>Aside {sentence(rng, 30)}</aside><form><label>Mail</label><input name=q></form></article>
    <section id="comments"><article class="comment"><p>{sentence(rng, 80)}</p></article></section></main>
    <div class="sidebar">{sentence(rng, 60)}</div><footer>&copy; {i}</footer></body></html>"""
    return html, "\n".join([f"Title & {i}", *body])


def unnamed(rng, i):
    """No telling names: a menu of links, constant texts, a side column, a table of data."""
    body = [sentence(rng, 25) for _ in range(rng.randint(3, 8))]
    menu = "".join(f'<li><a href="/{w}">{w} {rng.choice(WORDS)}</a></li>' for w in rng.sample(WORDS, 12))
    html = f"""<html><body><div id=w1><div class=x1><ul>{menu}</ul></div><div class=x2><div class=x4>Read on, dear friends of trees</div>
    <h1>{body[0]}</h1>{"".join(f"<p>{x}</p>" for x in body[1:])}<div class=x5>Printed on thin paper</div></div>
    <div class=x3>{sentence(rng, 6)}</div></div></body></html>"""
    return html, "\n".join(body)


def texts(spark, rows, **options):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in pages.extract(df, **options).collect()}


@pytest.mark.parametrize("make", [semantic, unnamed])
def test_slots_of_templates(spark, make):
    rng = random.Random(3)
    made = [make(rng, i) for i in range(40)]
    got = texts(spark, [(i, f"https://h{i % 2}.example/{i}", h) for i, (h, _) in enumerate(made)])
    assert got == {i: t for i, (_, t) in enumerate(made)}


def test_a_page_alone(spark):
    html, text = semantic(random.Random(1), 7)
    assert texts(spark, [(1, "http://one.example/", html)]) == {1: text}


def test_copies_of_an_article_stay(spark):
    """Half of a host's pages hold one article: that is no template."""
    rng = random.Random(9)
    html, text = semantic(rng, 1)
    made = [(html, text) if i % 2 else semantic(rng, i) for i in range(20)]
    assert texts(spark, [(i, "http://h.example", h) for i, (h, _) in enumerate(made)]) == {i: t for i, (_, t) in enumerate(made)}


def test_broken_markup(spark):
    cases = {
        "<p>a &lt;b&gt; &amp;amp; c&nbsp;d&#233;<br>e": "a <b> &amp; c dé e",
        "<div>one<div>two</div>three</div>": "one\ntwo\nthree",
        "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": "a\nb\nc\nd",
        "<table><tr><td>a<td>b<tr><td>c</table>": "a\nb\nc",
        "x < y and <3 <b>bo</b>ld": "x < y and <3 bold",
        "<p title=\"a>b\">in</p><!-- <p>no</p> --><p>out<!-- open": "in\nout",
        "<p>a</div></span>b</p>": "a\nb",
        "<script>x</script": "",
        "plain\n text": "plain text",
        "<p>a</p><p hidden>b</p><p style='display: none'>c</p>": "a",
        "": "", None: "",
    }
    got = texts(spark, [(i, None, h) for i, h in enumerate(cases)])
    assert got == dict(enumerate(cases.values()))


def test_edges(spark):
    """Null ids and urls, repeated rows, clashing columns, no rows, very long pages."""
    long = "<article>" + "<p>w x</p>" * 40_000 + "</article>"
    rows = [(None, None, "<p>a</p>", "u", 5, "h"), (1, "no url", "<p>b</p>", "u", 5, "h"), (1, "no url", "<p>b</p>", "u", 5, "h"), (2, "http://x", long, "u", 5, "h")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n int, host string")
    out = pages.extract(df)
    assert out.columns == ["page_id", "url", "n", "host", "text", "n_chars"]
    got = sorted((r.page_id or 0, r.n_chars, r.host, r.n) for r in out.collect())
    assert got == [(0, 1, "h", 5), (1, 1, "h", 5), (1, 1, "h", 5), (2, 4 * 40_000 - 1, "h", 5)]
    assert pages.extract(df.limit(0)).count() == 0


def test_classes(spark):
    """Tokens of equal vectors are one class; one that pages show in two orders is not valid."""
    html = ["<div class=a>x</div><div class=b>y</div>" if i % 2 else "<div class=b>y</div><div class=a>x</div>" for i in range(10)]
    df = spark.createDataFrame([("h", i, f"<section><h2>{i}</h2></section>{h}") for i, h in enumerate(html)], "host string, page long, html string")
    classes, hosts, n = pages.deduce(df, 0.5, 3)
    rows = classes.collect()
    assert n == 10 and len(rows) == 1 and not rows[0].valid and len(rows[0].members) == 6  # all of once a page
    same = df.withColumn("html", df.html.substr(1, 0)).limit(0).union(spark.createDataFrame([("h", i, f"<div class=a>x</div><ul>{'<li><p>z' * (i % 3 + 1)}</ul>") for i in range(9)], "host string, page long, html string"))
    rows = sorted(pages.deduce(same, 0.5, 3)[0].collect(), key=lambda r: r.total)
    assert [(r.valid, r.total, len(r.members)) for r in rows] == [(True, 9, 3), (True, 18, 3)]


def test_same_as_a_plain_parse(spark, duck):
    """Independent of the operator: these pages' articles hold headings and paragraphs only."""
    from html import unescape

    for page_id, url, html in duck.sql("select page_id, url, html from pages").fetchall():
        inner = re.search(r"<article>(.*?)</article>", html, re.S)[1]
        parts = (" ".join("".join(unescape(x) for x in re.split(r"</?b>", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", inner))
        PLAIN[page_id] = (url, "\n".join(x for x in parts if x))
    rows = queries.op13_main_text(spark, str(DATA)).collect()
    assert {r.page_id: (r.url, r.text) for r in rows} == PLAIN and all(r.n_chars == len(r.text) for r in rows)


PLAIN: dict = {}
