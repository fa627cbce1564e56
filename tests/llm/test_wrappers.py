"""Main text of pages: repairs of markup, wrappers of several kinds of site, and the given pages by their article element."""

import html
import random
import re

import pytest

from tidemark.llm import queries, wrappers
from tidemark.llm.page_tree import parse

SCHEMA = "template string, html string, n int, page_id long, host int, url string, text string, part string"


def frame(spark, pages):
    return spark.createDataFrame([("t", h, 1, i, 2, u, "x", "p") for i, u, h in pages], SCHEMA)


def texts(spark, pages):
    return {r.page_id: r.text for r in wrappers.main_text(frame(spark, pages)).collect()}


def words(rnd, n):
    return " ".join(rnd.choice("amber birch cedar delta ember fjord grove heath".split()) for _ in range(n)).capitalize() + "."


def lines(page):
    out, stack = [], [parse(page)]
    while stack:
        n = stack.pop()
        out += [n.text] * (n.tag == "#")
        stack.extend(reversed(n.children))
    return out


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p><b>One.<br><p>two &amp; t&eacute;e &#x41; &nbsp; x</p>three", ["One.", "two & tée A x", "three"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
        ('<p title="a>b">x</p><script>var a="<p>no</p>";</script><style>p{}</style><title>t</title><!-- <p>no</p> -->y', ["x", "y"]),
        ("<div>a</p></b></section>b</div>c < d <3", ["ab", "c < d <3"]),
        ('<p>a<a href="x>open</p><p>b</p>', ["aopen", "b"]),
        ("<head><meta charset=x><title>t</title><p>in body", ["in body"]),
        ("<dl><dt>a<dd>b<dt>c</dl>", ["a", "b", "c"]),
        ("text only \n\t twice", ["text only twice"]),
        ("", []),
        (None, []),
        ("<script>never closed <p>x", []),
        ("<div>" * 5000 + "deep", ["deep"]),
    ],
)
def test_parse(page, want):
    assert lines(page) == want


def site(kind, rnd, k):
    """A page of a kind of site, and its main text."""
    title, paragraphs = words(rnd, 5), [words(rnd, rnd.randint(3, 60)) for _ in range(rnd.randint(1, 9))]
    menu = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("home", "news", "about"))
    body = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs)
    if kind == "bare":  # nothing but places tells the parts apart
        page = f"<html><body><div><ul>{menu}</ul></div><div>Daily paper of the valley</div><div>{body}</div><div>Printed in the valley. All rights reserved.</div></body></html>"
    elif kind == "named":
        page = (
            f'<html><body class="with-sidebar"><header class="top"><h2>Site</h2></header><div class="cookie-notice"><p>We use cookies {k}.</p></div><div id="wrap"><div class="entry-content">{body}'
            f'<div class="share-buttons"><p>Share {k}</p></div><form><p>Sign up</p><input></form></div><div id="sidebar"><p>{words(rnd, 30)}</p></div></div>'
            f'<section id="comments"><h3>2 comments</h3><div class="comment"><p>{words(rnd, 40)}</p></div></section><footer>{words(rnd, 9)}</footer></body></html>'
        )
    elif kind == "article":
        page = (
            f"<html><body><nav><ul>{menu}</ul></nav><main><article><header>{body[: body.index('</h1>') + 5]}</header>{body[body.index('</h1>') + 5 :]}<aside>Note {k}</aside><div>Read on in our paper</div>"
            f'<section class="comments"><article class="comment"><p>{words(rnd, 20)}</p></article></section></article></main></body></html>'
        )
    return page, "\n".join([title, *paragraphs])


@pytest.mark.parametrize("kind", ["bare", "named", "article"])
def test_sites(spark, kind):
    rnd = random.Random(kind)
    made = [site(kind, rnd, k) for k in range(12)]
    got = texts(spark, [(k, f"https://{kind}.example.org/{k}", page) for k, (page, _) in enumerate(made)])
    assert got == {k: want for k, (_, want) in enumerate(made)}


def test_copies_lonely_pages_nulls(spark):
    rnd = random.Random(2)
    (one, want), (article, told) = site("bare", rnd, 0), site("article", rnd, 1)
    pages = [(i, "http://copies.example.com/a", article) for i in range(5)] + [(10, None, article), (11, "no url", article), (12, "http://lonely.example/", article.replace("<div>Read on in our paper</div>", ""))]
    pages += [(13, "http://copies.example.com/b", None), (14, "http://copies.example.com/b", ""), (15, "http://x.example/", "<p>" + "long " * 200000)]
    got = texts(spark, pages)
    for i in range(5):
        assert got[i].startswith(told)  # copies alone are no template: what is constant stays
    assert got[12] == told and got[13] == got[14] == "" and got[15] == ("long " * 200000).strip() and got[10] == got[11]
    assert texts(spark, []) == {}
    same = texts(spark, [(i, "http://same.example/", one) for i in range(6)])
    assert all(want in t for t in same.values())


def test_templates_merge_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "FAN_IN", 2)
    rnd = random.Random(5)
    pages = [(k, f"https://host{k % 3}.example/{k}", site("bare", rnd, k)[0]) for k in range(60)]
    found = wrappers.induce(frame(spark, pages).repartition(16)).collect()
    assert sorted(r.host for r in found) == ["host0.example", "host1.example", "host2.example"]
    assert all(wrappers._template(r.template).n == 20 for r in found)


def test_given_pages(spark):
    sf = "/root/testdata/sf0.01"
    for r, page in zip(queries.op11_html_text(spark, sf).orderBy("page_id").collect(), spark.read.parquet(f"{sf}/pages.parquet").orderBy("page_id").collect(), strict=True):
        article = re.search("<article>(.*?)</article>", page.html, re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == page.url
