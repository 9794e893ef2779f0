from __future__ import annotations

import html
import itertools
import random
import re
import time

import pytest

from opslens.llm import html_text as H


def cost(labels, unary, edges):
    return sum(u if not keep and u > 0 else -u if keep and u < 0 else 0 for u, keep in zip(unary, labels)) + sum(c for i, j, c in edges if labels[i] != labels[j])


@pytest.mark.parametrize("seed", range(60))
def test_min_cut_is_minimal(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 9)
    unary = [rng.randint(-12, 12) for _ in range(n)]
    edges = [(i, j, rng.randint(0, 9)) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.5]
    best = min(cost(labels, unary, edges) for labels in itertools.product([False, True], repeat=n))
    assert cost(H.min_cut(unary, edges), unary, edges) == best


def test_given_pages(spark, duck, sf):
    """Those pages hold their text in one article of headings and paragraphs."""
    pages = dict(duck.sql("SELECT page_id, html FROM pages").fetchall())
    rows = H.query(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        page = pages[r["page_id"]] or ""
        inner = page[page.find("<article>") + 9:page.find("</article>")]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split("</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(p for p in parts if p)
        assert r["n_chars"] == len(r["text"])


PARAGRAPH = "A sentence of the article that goes on for a while, as articles do, and ends here."


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("   ", ""), ("<p>", ""), ("<script>var a='<p>x</p>'</script>", ""),
    ("<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav><article><h1>Head &amp; line</h1><p>Short.<p>x  y\n z</article><footer>foot</footer>", "Head & line\nShort.\nx y z"),
    (f"<main><p>{PARAGRAPH}</p><div class='comments'><p>{PARAGRAPH}</p></div><p>Ok.</p><aside>{PARAGRAPH}</aside></main>", f"{PARAGRAPH}\nOk."),
    (f"<body><div id=menu><ul><li><a>One</a><li><a>Two</a></ul></div><p>{PARAGRAPH}</p><p>Yes.</p><p>{PARAGRAPH}</p><div class='cookie-notice'>{PARAGRAPH}</div><form><p>{PARAGRAPH}</p><button>Go</button></form>", f"{PARAGRAPH}\nYes.\n{PARAGRAPH}"),
    ("<article><p>a &lt;b&gt; &#233; &copy; &notanentity; <b>bold</b>text</p><style>p{}</style><!-- no --><p>q</article>", "a <b> é © ¬anentity; boldtext\nq"),
    ("<article><header><h1>Title</h1></header><p>Body.</p></div></span></p></article></article><p>out", "Title\nBody."),
    ("<article><p>one<br>two</p><table><tr><td>c1<td>c2<tr><td>d1</table></article>", "one two\nc1\nc2\nd1"),
    ("<article><section class=ad><p>Buy this now.</p></section><p>cut off <b>here", "cut off here"),
    ("<article><textarea>no</textarea><select><option>no</select><p>yes</p><svg><text>no</text></svg><noscript>no</noscript></article>", "yes"),
])
def test_main_text(page, want):
    assert H.main_text(page) == want


COMMENT = "A reader's comment that goes on for a while, as comments do, and ends here."


@pytest.mark.parametrize("page", [
    f"<main><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p><div id=comments><article class=comment><p>{COMMENT}</p></article><article class=comment><p>{COMMENT}</p></article></div></main>",
    f"<main><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p><div id=comments><article><p>{COMMENT}</p></article><article><p>{COMMENT}</p></article></div></main>",
    f"<main><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p><article id='div-comment-12' class='byuser comment-body'><p>{COMMENT}</p></article></main>",
    f"<article><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p><section class=related><article><h2>Other news</h2><p>{COMMENT}</p></article></section></article>",
    f"<main><article><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></article><aside><article class=teaser><p>{COMMENT}</p></article></aside></main>",
    f"<main><article><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></article><article hidden><p>{COMMENT}</p></article></main>",
    f"<article class='post category-legal tag-social comments-open'><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></article>",
    f"<main class='has-sidebar search'><article class=legal><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></article></main>",
])
def test_articles_that_are_comments_or_teasers(page):
    assert H.main_text(page) == f"{PARAGRAPH}\n{PARAGRAPH}"


def test_very_long_and_deep_pages():
    deep = "<div>" * 3000 + "<article>" + "<p>Para of words here.</p>" * 3000 + "</article>"
    assert H.main_text(deep).count("\n") == 2999
    plain = "".join(f"<p>{PARAGRAPH}</p><ul><li><a>l{i}</a></ul>" for i in range(800))
    assert H.main_text(plain).startswith(PARAGRAPH)


ITEM = "A point of the list."


@pytest.mark.parametrize("page, want", [
    ("<body><h1>Title</h1><p>Hi.</p></body>", "Title\nHi."),
    (f"<title>T</title><h1>Title</h1><p>{PARAGRAPH}</p><h2>Points</h2><ul><li>one<li>two</ul>", f"Title\n{PARAGRAPH}\nPoints\none\ntwo"),
    (f"<body><div class='site-header'><a>Home</a></div><div id=main-nav><a>A</a> <a>B</a></div><div><h1>Title</h1><p>{PARAGRAPH}</p><blockquote>So.</blockquote></div>"
     f"<div class=sidebar-left><p>{PARAGRAPH}</p></div><div id=post-comments><p>{PARAGRAPH}</p></div><div class='footer-links'><p>Imprint</p></div></body>", f"Title\n{PARAGRAPH}\nSo."),
    (f"<table><tr><td class=menu><a>One</a><td><h3>Head</h3>{PARAGRAPH}<p>{ITEM}</table>", f"Head\n{PARAGRAPH}\n{ITEM}"),
    ("<ul><li><a>One</a><li><a>Two</a></ul>", ""), ("<div class=menu>One</div>", ""),
    ("<ul><li><a>One</a><li><a>Two</a> and more</ul>", "Two and more"),
    (f"<div role=banner>x</div><p>{ITEM}<p>{ITEM}", f"{ITEM}\n{ITEM}"),
])
def test_pages_without_a_marked_main_part(page, want):
    assert H.main_text(page) == want


@pytest.mark.parametrize("attribute", ["class='tags-explained'", "class='legal-note'", "id='related-work'", "class='lead no-comments-yet'", "id=search-trees"])
@pytest.mark.parametrize("shell", ["<article>{}</article>", "<main>{}</main>", "{}"])
def test_names_that_only_hold_such_a_word(attribute, shell):
    page = f"<p>{PARAGRAPH}</p><section {attribute}><h2 id=comments>Comments</h2><p>{PARAGRAPH}</p></section><p {attribute}>{ITEM}</p>"
    assert H.main_text(shell.format(page)) == f"{PARAGRAPH}\nComments\n{PARAGRAPH}\n{ITEM}"


@pytest.mark.parametrize("page, lines", [
    ("<div>" * 100_000 + "x" + "</div>" * 100_000, 1), ("<div>a" * 100_000, 100_000), ("<article>" + "<div>" * 50_000 + "</section>" * 50_000 + "z", 1),
    ("<section><article>" + "<div>" * 50_000 + "</section>" * 50_000 + "z", 1), ("<p>a<ul><li>b" * 30_000, 60_000), ("<table>" + "<div><ul>" * 50_000 + "</li>" * 50_000, 0)])
def test_time_grows_with_the_tags_and_not_with_their_depth(page, lines):
    start = time.process_time()
    assert len(H.main_text(page).splitlines()) == lines
    assert time.process_time() - start < 20  # about 3 s; a scan of the open elements per tag takes hours


def test_extra_columns_and_the_empty_table(spark):
    df = spark.createDataFrame([(1, "u", "<article>x</article>", "c"), (1, "u", "<article>x</article>", "c"), (None, None, None, None)], "page_id long, url string, html string, main_text string")
    out, name = H.extract(df)
    assert out.columns == [*df.columns, name] and name != "main_text"
    assert sorted(r[name] for r in out.collect()) == ["", "x", "x"]
    assert H.extract(df.limit(0))[0].collect() == []
