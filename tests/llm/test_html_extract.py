import random

import pytest

from textlake.llm import dom, html_extract

SCHEMA = "page_id bigint, url string, html string, host string, path string, text string, key bigint"


def extracted(spark, pages, **options):
    rows = [(i, u, h, "clash", "clash", "clash", 1) for i, (u, h) in enumerate(pages)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return {r[0]: r[2] for r in html_extract.extract(df, **options).select("page_id", "url", "text").collect()}


def test_article_without_the_rest():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href="/a">menu</a></li></ul></nav><header class="top">head</header><div class="ad">buy</div>
    <article><h1>Title &amp; more</h1><p>One <b>bold</b>&nbsp;word<br>next<p>Two<!-- no --> &lt;x&gt; &#233;
      <div class="cookie-notice">notice</div><ul><li>a<li>b</ul><form><p>name <input></form>
      <section id="comments"><p>first!</section><p>End</article>
    <aside>side</aside><div id="sideBar">side</div><footer>&copy; foot</footer></body></html>"""
    assert html_extract.main_text(page) == "Title & more\nOne bold word next\nTwo <x> é\na\nb\nEnd"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; text", "plain & text"),
        ("<p>a", "a"),
        ("<p>a</b></i></p></div>b", "a\nb"),
        ("<p>cut <a href='x", "cut"),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
        ("<script>x</script>a<SCRIPT>y</SCRIPT >b", "ab"),
        ("<script>never closed <p>a", ""),
        ("<!-- never closed <p>a", ""),
        ("<div hidden>x</div><div style='display: none'>y</div>z", "z"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<p>&#xD800;&bogus;&am</p>", "�&bogus;&am"),
        ("<a title='>'>x</a>", "x"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
        ("<div>x</b>" * 50_000, "\n".join("x" * 50_000)),
        ("<p>" + "long " * 100_000, ("long " * 100_000).strip()),
        ('<p>Hello <span class="advert">BUY NOW</span> world</p>', "Hello world"),
        ("<p>a <button>b</button> c <svg><text>q</text></svg><math>m</math><label>l</label> d</p>", "a c d"),
        ('<p>a <span hidden>x</span>b <span class="comments">12 replies</span></p>', "a b"),
        ("<article><p>See … end <select><option>one<option>two</select> after</p></article>", "See … end after"),
        ('<article><p>text</p></article><article class="comment"><p>first!</p></article>', "text"),
        ('<article><p>A</p><div class="menu-price"><p>Soup</p></div></article>', "A\nSoup"),
        ('<article><p>A</p><p class="recommended-reading">Book</p></article>', "A\nBook"),
        ('<div id="sideBar">s</div><div class="adBox">t</div><div class="cookie-notice top">u</div>z', "z"),
        ('<body class="has-sidebar menu"><p>x</p></body>', "x"),
        ("<p>a<b>b</b>c<br>d</p>", "abc d"),
        ('<p>"' + "<a \"b' " * 300 + "</p>", '"'),
    ],
)
def test_odd_pages(page, text):
    assert html_extract.main_text(page) == text


def host_pages(n, same="Subscribe to our letter today"):
    rnd = random.Random(1)
    text = lambda: " ".join(rnd.choices("abcdefghij", k=20))
    out = []
    for i in range(n):
        own = text()
        out.append((f"https://h.org/{i}", f"<body><div class=x1><p>{same}</p></div><div class=main{i}><p>{own}</p></div></body>", own))
    return out


@pytest.mark.parametrize("most", [200_000, 0])
def test_what_repeats_on_a_host_is_removed(spark, monkeypatch, most):
    monkeypatch.setattr(html_extract, "BROADCAST_NODES", most)
    pages = host_pages(20)
    few = [(u.replace("h.org", "few.org"), h, own) for u, h, own in pages[:5]]
    got = extracted(spark, [p[:2] for p in pages + few] + [(None, None), ("no host", "<p>x"), ("https://h.org/0", pages[0][1])])
    assert [got[i] for i in range(20)] == [own for *_, own in pages]
    assert [got[20 + i] for i in range(5)] == [own for *_, own in few]
    assert [got[25], got[26], got[27]] == ["", "x", pages[0][2]]


def test_copies_of_a_page_do_not_make_its_text_noise(spark):
    page = "<body><div><p>the same story</p></div></body>"
    got = extracted(spark, [(f"https://h.org/{i}", page) for i in range(30)])
    assert set(got.values()) == {"the same story"}


def test_main_text_is_kept_even_if_it_repeats(spark):
    got = extracted(spark, [(f"https://h.org/{i}", f"<nav>{i}</nav><article><p>the same story</p></article>") for i in range(30)])
    assert set(got.values()) == {"the same story"}


@pytest.mark.parametrize("most", [200_000, 0])
def test_importance_decides_inside_and_beside_an_article(spark, monkeypatch, most):
    monkeypatch.setattr(html_extract, "BROADCAST_NODES", most)
    rnd = random.Random(2)
    text = lambda: " ".join(rnd.choices("abcdefghij", k=20))
    pages, owns = [], []
    for i in range(20):
        own, more = text(), text()
        box = "<div class=xa><p>Read all of our letters</p></div>"
        pages.append((f"https://h.org/{i}", f"<body>{box}<article><h1>{i}</h1><p>{own}</p>{box}</article><div class=xb><p>{more}</p></div></body>"))
        owns.append(f"{i}\n{own}\n{more}")
    pages.append(("https://h.org/other", "<body><p>seen once</p><article><p>story</p></article></body>"))
    got = extracted(spark, pages)
    assert [got[i] for i in range(21)] == [*owns, "story"]


def test_two_pages_of_a_host_are_evidence(spark):
    """What both pages of a host have goes if each has text of its own, and stays inside an article, where less is enough."""
    box = "<div class=q><p>Read our letters</p></div>"
    pages = [(f"https://two.org/{i}", f"<body>{box}<div class=m><p>{own}</p></div></body>") for i, own in enumerate(["story one", "another tale"])]
    pages += [(f"https://art.org/{i}", f"<article><h2>Part</h2><p>{own}</p></article>") for i, own in enumerate(["first part", "second part"])]
    got = extracted(spark, pages)
    assert [got[i] for i in range(4)] == ["story one", "another tale", "Part\nfirst part", "Part\nsecond part"]


def test_many_copies_of_an_article_do_not_make_it_noise(spark):
    """Half of a host's pages have one story under different menus."""
    rnd = random.Random(3)
    text = lambda n: " ".join(rnd.choices("abcdefghij", k=n))
    menus = [text(6) for _ in range(4)]
    stories = [text(30) for _ in range(20)]
    shown = [stories[0] if i % 2 else stories[i // 2] for i in range(40)]
    pages = [(f"https://h.org/{i}", f"<body><div class=u><p>{menus[i % 4]}</p></div><div class=v><p>{s}</p></div></body>") for i, s in enumerate(shown)]
    got = extracted(spark, pages)
    assert [got[i] for i in range(40)] == shown


def test_the_tree_alone_cleans_the_given_pages(spark, monkeypatch):
    """Without a word list and without the tags of menus, importance removes what repeats. (A footer names its host in
    the text and so hardly ever repeats; its tag remains.)"""
    import re
    from html import unescape

    rows = spark.read.schema("page_id bigint, url string, html string").parquet("/root/testdata/sf0.1/pages.parquet")
    marked = html_extract.marked_nodes(html_extract.style_nodes(rows)).collect()
    low, high = {}, {}
    for r in marked:
        (low if r["low"] else high).setdefault(r["host"], set()).add(r["path"])
    # Menu, list, item and link, and advert, of all hosts together.
    assert len(low["*"]) >= 5
    monkeypatch.setattr(dom, "NOISE_WORDS", set())
    monkeypatch.setattr(dom, "NOISE_TAGS", dom.NOISE_TAGS - {"nav", "aside", "header", "menu"})
    found = rows.selectExpr("html", "split(url, '/')[2] AS host").collect()
    for r in found:
        article = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", article.replace("<br>", " "))
        want = "\n".join(filter(None, (" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks)))
        # Without the article's tag as well: nothing but the tree tells text from menus.
        plain = r["html"].replace("<article>", "<div>").replace("</article>", "</div>")
        assert html_extract.main_text(r["html"], low["*"] | low.get(r["host"], set()), high.get(r["host"], set())) == want
        assert html_extract.main_text(plain, low["*"]) == want
        # The advert and the menu are there without the tree.
        assert len(html_extract.main_text(plain)) > len(want)


def test_empty_table(spark):
    assert extracted(spark, []) == {}


def test_importance(spark):
    nodes = [("h", 1, page, 0, page) for page in range(8)] + [("h", 2, page, 0, 5) for page in range(8)] + [("h", 3, page, 0, page % 2) for page in range(8)]
    nodes += [("h", 1, 7, 0, 7), ("i", 2, 9, 0, 5), ("i", 4, 9, 1, 1)]  # a copy of a page; another host
    df = spark.createDataFrame(nodes, "host string, path bigint, page bigint, presentation bigint, content bigint").selectExpr("*", "path = 1 AS guarded")
    got = {(r["host"], r["path"]): (r["pages"], r["guarded"], round(r["importance"], 6)) for r in html_extract.importance(df).collect()}
    # All different; all alike on eight pages; two contents on four pages each: ln 4 / ln 8.
    assert got["h", 1] == (8, True, 1.0) and got["h", 2] == (8, False, 0.125) and got["h", 3] == (8, False, round(1 - 2 / 3 * 7 / 8, 6))
    assert got["i", 2] == (1, False, 1.0) and got["*", 2] == (9, False, round(1 / 9, 6)) and got["*", 4] == (1, False, 1.0)


def test_hashes_do_not_depend_on_the_process(spark):
    page = "<body><div class='a b'><p>x</p></div></body>"
    here = [n.path for n in dom.read(page).nodes]

    def there(batches):
        for b in batches:
            b["id"] = [hash(tuple(n.path for n in dom.read(page).nodes))] * len(b)
            yield b

    assert {r[0] for r in spark.range(3).mapInPandas(there, "id bigint").collect()} == {hash(tuple(here))}
