from __future__ import annotations

import random
import time

import pytest

from plansift.llm.html_density import blocks, extract, main_text, measure, parse

P = "A sentence with enough words to be the text of an article, and then some more. "


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("just  text &amp; no\ttags", "just text & no tags"), ("<html><body></body></html>", ""), ("<p>a &lt;b&gt; &#233;&eacute;</p>", "a <b> éé"),
        ("<body><nav><a href=x>Menu</a></nav><article><h1>T</h1><p>one <b>two</b>three<br>four</article><footer>f</footer>", "T one twothree four"),
        ("<article><p>x</p><script>var a='</p>';</script><style>p{}</style><!-- c --><form>f<input></form><p>y</article>", "x y"),
        (f"<body><div class='sidebar'>{P * 3}</div><div id=main><h1>Head</h1><p>{P * 4}</p><p>{P * 2}</p></div><div class='cookie-notice'>Yes</div></body>", " ".join(["Head", (P * 4).strip(), (P * 2).strip()])),
        (f"<article><p>{P}</p><section class='comments'><p>{P * 9}</p></section></article>", P.strip()),
        (f"<main><article><p>{P}</p></article><aside>{P}</aside></main>", P.strip()),
        (f"<ARTICLE><P>{P}<UL><LI>one<LI>two</UL></ARTICLE>", P.strip() + " one two"),
        (f"<article><header><h1>Title</h1></header><p>{P}</p></article>", "Title " + P.strip()),
        (f"<head><title>t</title><body><div class=header>{P}</div><div class='siteNav'>{P}</div><p>{P * 2}</p>", (P * 2).strip()),
        (f"<head><meta x><p>{P}</p>", P.strip()),
        (f"<body><nav><ul><li>a<article><p>{P}</p></article>", P.strip()),
        (f"<body><div class='postBody'><p>{P * 2}</p><div class='adBox'>buy</div></div><div id='commentList'><p>{P * 8}</p></div>", (P * 2).strip()),
        (f"<div>{'<a href=x>link text</a> ' * 30}</div><div><p>{P * 3}</p></div>", (P * 3).strip()),
    ],
)
def test_pages(page, text):
    assert main_text(page or "") == text


def test_broken_tags_cost_one_pass():
    began = time.time()
    for page in ("<a " + 'b="' * 20_000, "<" * 50_000, "<p>" * 30_000, "<div><b>" * 5_000 + "x", "<a title='" + "x" * 100_000, '<a "' * 5_000, "&" * 100_000):
        main_text(page)
    assert time.time() - began < 20


def test_rows(spark):
    d = spark.createDataFrame([(1, "u", f"<article><p>{P}</p></article>", "x"), (2, None, None, "x"), (2, None, None, "x"), (None, "u", "<p>😀</p>", "x")], "page_id bigint, url string, html string, text string")
    got = sorted(map(tuple, extract(d).collect()), key=repr)
    assert got == sorted([(1, "u", P.strip(), len(P.strip())), (2, None, "", 0), (2, None, "", 0), (None, "u", "😀", 1)], key=repr)
    assert extract(d.limit(0)).count() == 0


def test_articles_of_the_pages(spark, small):
    import html
    import re

    pages = spark.read.parquet(f"{small}/pages.parquet")
    texts = {r["page_id"]: r["text"] for r in extract(pages).collect()}
    assert len(texts) == pages.count()
    for r in pages.collect():
        own = re.search(r"<article>(.*?)(?:</article>|<footer|$)", r["html"], re.S)[1]
        plain = re.sub(r"</?(?:p|br|h1)\b[^>]*>", " ", own)
        assert texts[r["page_id"]] == " ".join(html.unescape(re.sub(r"<[^>]+>", "", plain)).split())


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-sidebar", "content comments-open", "nav-open", "post type-post tag-news", "page sidebar-left", "hasSidebar", "top", "search-page"])
def test_class_of_a_wrapper_keeps_what_it_holds(name):
    inside = f"<article><p>{P}</p></article>"
    beside = f"<div class='sidebar'>{P}</div>"
    for held in (inside, f"<main>{inside}</main>", f"<div><h1>T</h1><p>{P * 4}</p></div>"):
        text = main_text(f"<body><div class='{name}'>{held}{beside}</div><footer>f</footer></body>")
        assert text == (P.strip() if "<article>" in held else "T " + (P * 4).strip()), held
    assert main_text(f"<main><div class='{name}'>{inside}</div></main>") == P.strip()


def test_parts_go_by_class_still():
    for part in (f"<div class='related'><article>{P}</article></div>", f"<div id='comments'><article>{P * 9}</article></div>", f"<div class='tag-cloud'>{P}</div>", f"<div class='alert'>{P * 9}</div>"):
        assert main_text(f"<body><article><p>{P * 2}</p>{part}</article></body>") == (P * 2).strip(), part
    for part in (f"<div id='comments'><article>{P * 9}</article></div>", f"<div class='cookie-notice'>{P * 9}</div>"):
        assert main_text(f"<body><article><p>{P * 2}</p></article>{part}</body>") == (P * 2).strip(), part
    assert main_text(f"<body><div class='cookie-notice'>{P}</div></body>") == ""


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><p>{P}<span class='tag'>x</span> y <code id='search'>grep</code> <a class='share' href=u>z</a></p></article>", P + "x y grep z"),
        (f"<article><p>{P}</p><div class='related-work'><p>{P}</p></div><div class='related-posts'><p>{P}</p></div></article>", (P * 2).strip()),
        (f"<article><p>{P}</p><img src='data:image/svg+xml,<svg a=\"{'x<p>' * 250_000}\">'><p>end</p></article>", P + "end"),
        (f"<article><p>{P}</p><p title=\"{'y>' * 500_000}\">end</p></article>", P + "end"),
        (f"<body><div><section><h2>A</h2><p>{P * 5}</p><p>{P * 4}</p></section><section><p>{P * 4}</p></section><section><p>short</p></section></div><div>small print</div></body>", f"A {P * 13}short"),
        (f"<body><div><h1>T</h1><div><p>{P * 5}</p><p>{P}</p></div></div><div>small print</div><ul>{'<li><a href=x>more</a>' * 9}</ul></body>", f"T {P * 6}".strip()),
        (f"<body><article><p>{P * 3}</p></article><article><p>{P * 9}</p><p>a</p></article></body>", P * 9 + "a"),
    ],
)
def test_density_and_names(page, text):
    assert main_text(page) == text


def slow_best(root):
    """The node with the greatest sum of composite densities, every count taken anew from the whole subtree."""
    from math import e, log

    def parts(n, linked=False):
        out = [("tag", n.tag)] if n is not top else []
        for c in n.children:
            out += parts(c, linked or c.tag == "a") if not isinstance(c, str) else [("link" if linked else "plain", len(c))] if c.strip() else []
        return out

    def counts(n, linked):
        p = parts(n, linked)
        return sum(k for a, k in p if a != "tag"), sum(k for a, k in p if a == "link"), sum(a == "tag" for a, _ in p), sum(x == ("tag", "a") for x in p)

    def density(n, linked):
        nonlocal top
        top = n
        chars, links, tags, link_tags = counts(n, linked)
        if not chars:
            return 0.0
        base = log(chars / max(chars - links, 1) * links + share * chars + e)
        return chars / max(tags, 1) * log(max(chars / max(links, 1) * max(tags, 1) / max(link_tags, 1), 1) + 1) / log(base + 1)

    top = root
    all_chars, all_links, _, _ = counts(root, False)
    share = all_links / max(all_chars, 1)
    best, todo = (-1.0, None), [(root, False)]
    while todo:
        n, linked = todo.pop(0)
        own = sum(density(c, linked or c.tag == "a") if not isinstance(c, str) else len(c) * bool(c.strip()) for c in n.children)
        top = n
        if counts(n, linked)[0] and own > best[0] + 1e-9:
            best = own, n
        todo = [(c, linked or c.tag == "a") for c in n.children if not isinstance(c, str)] + todo
    return best


def random_page(r):
    def node(depth):
        tag = r.choice(["div", "p", "a", "span", "section", "ul", "li", "h2"]) if depth else "body"
        inner = "".join(node(depth + 1) if r.random() < 0.6 and depth < 5 else "w " * r.randrange(40) for _ in range(r.randrange(1, 6)))
        return f"<{tag}>{inner}</{tag}>"

    return node(0)


def test_sums_of_densities_by_brute_force(spark, small):
    r = random.Random(2)
    pages = [random_page(r) for _ in range(300)] + [x["html"] for x in spark.read.parquet(f"{small}/pages.parquet").collect()]
    for page in pages:
        root = parse(page)
        want, node = slow_best(root)
        nodes = measure(root)
        assert max(n.sum for n in nodes if n.chars or n is root) == pytest.approx(max(want, 0.0))
        if node is not None:
            # the densest subtree is read, and nothing beside it falls short of the path
            text, read = " ".join(blocks(node)), main_text(page)
            assert "".join(text.split()) in "".join(read.split()) or node.tag in ("a", "ul", "li") or node.link_chars


def test_articles_are_found_without_their_tag(spark, small):
    import re

    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        if len(main_text(r["html"])) < 200:
            continue  # the advert beside it is longer: nothing but the tag tells the two apart
        assert main_text(re.sub(r"<(/?)article>", r"<\1div>", r["html"])) == main_text(r["html"])


def test_unmatched_tags_cost_one_pass():
    def cost(n):
        began = time.process_time()
        for page in ("<i>" * n + "</b>" * n, "<b>" * n + "<td>" * n, "<li>x" * n + "</ul>" * n, "<nav>" + "<i>" * n + "</b>" * n, "<p " + "a='<' " * n, '<a "' * n + "'" * n, "<div>" * n + "<p>" + "<i><p>" * n):
            main_text(page)
        return time.process_time() - began

    cost(1000)
    assert cost(40_000) < 6 * max(cost(10_000), 0.5)
