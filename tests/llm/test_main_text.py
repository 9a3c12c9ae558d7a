from __future__ import annotations

import html as H
import random
import re

import pytest

import cohort_spark.llm.queries  # noqa: F401
from cohort_spark.llm import main_text as M
from cohort_spark.llm.registry import QUERIES

A = "The first paragraph of the article has more than eighty characters, as most paragraphs of articles do have."
B = "The second one is about as long; it follows the first one directly and ends the article's text, or it does not."
C = "A third one, which is there so that the distribution has a wide hill and not just a narrow peak to be found by."

PAGES = {
    "article": (f"<nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{A}<p>Short.<p>{B}</article><footer>&copy; x</footer>", ["Title", A, "Short.", B]),
    "main with asides": (
        f"<header><h1>Site</h1></header><main><h1>Title</h1><p>{A}</p><aside><p>{C}</p></aside><form>Name <input></form><p>{B}</p></main>"
        f"<div class=sidebar><p>{C}</p></div>",
        ["Title", A, B],
    ),
    "comments in the article": (f"<article><p>{A}</p><section id=comments><h2>3 Comments</h2><p>{C}</p></section></article>", [A]),
    "comments by heading": (f"<article><p>{A}</p><div><h3>Comments (2)</h3><p>{C}</p></div><p>{B}</p></article>", [A, B]),
    "comment articles": (f"<article class='post comments-open'><p>{A}</p></article><div class=comments><article class=comment><p>{C}</p></article></div>", [A]),
    "plain divs": (
        f"<div><a href=a>Home</a> <a href=b>News</a> <a href=c>About us</a></div><div><div><h1>Title</h1><p>{A}</p><p>{B}</p><p>{C}</p></div></div>"
        f"<div><p>All rights reserved</p></div>",
        ["Title", A, B, C],
    ),
    "paragraphs as divs": (f"<div><a href=a>Home</a></div><div class=text><div>{A}</div><div>Short.</div><div>{B}</div></div><div><div>Imprint</div></div>", [A, "Short.", B]),
    "named places": (
        f"<div class='cookie-notice'>{C}</div><div class=ad>{C}</div><div id=siteNav>{C}</div><div id=content><p>{A}</p><div class='adsbox ad-slot'>{C}</div><p>{B}</p></div>"
        f"<div class='newsletter'>{C}</div>",
        [A, B],
    ),
    "named, but around the article": (f"<div class='with-sidebar'><div class=widget><article><p>{A}</p></article></div></div>", [A]),
    "class of the heading's holder": (f"<div class='page menu'><h1>T</h1><p>{A}</p></div>", ["T", A]),
    "raw text": (f"<article><script>if (a<b) '</p>'</script><p>{A}</p><style>p>a{{}}</style><noscript>No script</noscript><!-- <p>{C}</p> --><p>{B}</article>", [A, B]),
    "references": ("<article><p>caf&eacute; &amp;amp; &#8364;&#x41; a&nbsp;b &lt;p&gt;</p></article>", ["café &amp; €A a b <p>"]),
    "white space": ("<article><p> a \n\t b<br>c <b>d</b>e<i> f</i></p>\n\n<ul><li>g<li>h</ul><table><tr><td>i<td>j<tr><td>k</table></article>", ["a b c de f", "g", "h", "i j", "k"]),
    "two articles": (f"<article><h2>One</h2><p>{A}</p></article><article><h2>Two</h2><p>{B}</p></article>", ["One", A, "Two", B]),
    "broken": (f"<article><div><p><b>{A}</div></span></b><p title='a>b'>{B}<p", [A, B]),
    "open quote": (f'<article><p class="x>{A}</p><p>{B}</p></article>', [A, B]),
    "less than": ("<article><p>1 < 2 and 3<4 &lt;</p></article>", ["1 < 2 and 3<4 <"]),
    "hidden": (f"<article><p hidden>{C}</p><p style='display: none'>{C}</p><p>{A}</p></article>", [A]),
    "no markup": (A, [A]),
    "one word": ("<article><h1>Sthe.</h1><p><b>Sthe.<br></article><footer>long footer text that is longer than the article</footer>", ["Sthe.", "Sthe."]),
    "only menus": ("<nav>a</nav><footer>b</footer>", []),
    "whole page in a form": (f"<form><h1>T</h1><p>{A}</p></form>", ["T", A]),
    "upper case": (f"<ARTICLE><P>{A}</P></ARTICLE><FOOTER>{C}</FOOTER>", [A]),
    "no closing comment": (f"<article><p>{A}</p><!-- {C}", [A]),
    "roles": (f"<div role=navigation>{C}</div><div role=main><p>{A}</p></div><div role=contentinfo>{C}</div>", [A]),
    "teasers beside": (f"<article><p>{A}</p></article><div class=related><article><p>{C}</p></article></div>", [A]),
    "article header": (f"<main><article><header><h1>T</h1></header><p>{A}</p><footer>tags</footer></article></main>", ["T", A]),
    "headed main": (f"<main><h1>T</h1><article><p>{A}</p></article><p>{C}</p></main>", ["T", A]),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    source, expected = PAGES[name]
    assert M.main_text(source).split("\n") == (expected or [""])


def test_generated_articles():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(rng.choice([word(), "R&D", "<", "a&lt;b"]) if rng.random() < 0.1 else word() for _ in range(n))
    for _ in range(200):
        paragraphs = [text(rng.randrange(1, 40)) for _ in range(rng.randrange(1, 9))]
        middle = []
        for p in paragraphs:
            middle.append(rng.choice(["<p>{}</p>", "<p>{}", "<div>{}</div>", "<blockquote><p>{}</p></blockquote>", "<ul><li>{}</ul>", "<h2>{}</h2>"]).format(H.escape(p)))
            if rng.random() < 0.3:
                middle.append(rng.choice(["<aside>{}</aside>", "<div class='ad banner'><p>{}</p></div>", "<form><p>{}</p></form>", "<script>{}</script>", "<!--{}-->"]).format(H.escape(text(9))))
        source = f"<header>{text(3).replace('<', '')}</header><nav><ul><li><a>x</a></ul></nav><article>{''.join(middle)}</article><div id='comments'><p>{H.escape(text(50))}</p></div>"
        assert M.main_text(source) == "\n".join(" ".join(p.split()) for p in paragraphs)


def brute_stretches(weights, window):
    """Surge and dive from the windows themselves: text ends where the next ``window`` lines have none."""
    out, i = [], 0
    while i < len(weights):
        if not weights[i]:
            i += 1
            continue
        j = i
        while any(weights[j + 1 : j + window + 1]):
            j += 1
        while not weights[j]:
            j -= 1
        rows = weights[i : j + 1]
        out.append((i, j + 1, max(sum(rows[max(0, k - window + 1) : k + 1]) for k in range(len(rows)))))
        i = j + 1
    return out


def test_stretches():
    rng = random.Random(2)
    for _ in range(500):
        weights = [rng.choice([0, 0, 0, rng.randrange(1, 99)]) for _ in range(rng.randrange(30))]
        window = rng.randrange(1, 5)
        assert M.stretches(weights, window) == brute_stretches(weights, window)


def test_deep_and_long_pages():
    deep = "<div>" * 20_000 + "<article><p>" + A + "</article>" + "</div>" * 20_000
    assert M.main_text(deep) == A
    many = "<article>" + "".join(f"<p><b>word{i}<i>" for i in range(20_000)) + "</article>"
    assert M.main_text(many).count("\n") == 19_999
    assert M.main_text("<p " * 20_000) == ""
    assert M.main_text("<" * 20_000).startswith("<")


def test_extract(spark):
    rows = [(1, "u", PAGES["article"][0]), (1, "u", PAGES["article"][0]), (None, None, None), (2, None, ""), (3, "v", "   ")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    clash = pages.selectExpr("*", "'x' AS text", "1 AS c0", "2 AS n_chars")
    whole = "\n".join(PAGES["article"][1])
    for source in (pages, clash):
        out = M.extract(source)
        assert out.columns == ["page_id", "url", "text"]
        assert sorted((r.page_id or 0, r.url or "", r.text) for r in out.collect()) == [(0, "", ""), (1, "u", whole), (1, "u", whole), (2, "", ""), (3, "v", "")]
    assert M.extract(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        M.extract(clash, keep=("text",))


def test_query(spark):
    """The given pages keep their text in one article element of paragraphs."""
    found = {r.page_id: r for r in QUERIES["op11_main_text"](spark, "/root/testdata/sf0.01").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    assert len(found) == len(rows)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(H.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert found[r.page_id].text == "\n".join(b for b in blocks if b)
        assert found[r.page_id].n_chars == len(found[r.page_id].text)
        assert found[r.page_id].url == r.url
