"""HTML wrappers."""

import random
from functools import reduce

from llm_data import workers  # noqa: F401

from sensorcast.llm import html_wrappers as wrappers

PAGE = (
    "<!DOCTYPE html><html><head><title>T &amp; x</title><script>var a='</p><p>no';</script></head><body><nav><ul><li>"
    "<a href='/a'>menu</a></li><li>more</ul></nav><!-- <p>no</p> --><div class=\"ad box\">buy</div><article><h1>A&nbsp;title</h1>"
    "<p><b>bold</b>er  text<br>next&lt;line&gt;<p>open <i>it</i>alic{more}<div class='comments'>first!</div></article><footer>&copy;</footer>"
)
WANT = "A title bolder text next<line> open italic"


def test_main_text(workers):
    rows = [
        (1, "http://A.example/x", PAGE.replace("{more}", ""), "x"),
        (2, "http://a.example/y", PAGE.replace("{more}", "<p>third</p><aside>side</aside>"), "x"),
        (3, "http://a.example/y", PAGE.replace("{more}", "<p>third</p><aside>side</aside>"), "x"),
        (4, None, None, None),
        (5, "no url", "", ""),
        (6, "http://b.example", "<p>plain &amp; cut <em>of", ""),
        (7, "http://c.example", "<body><div>one</div><div id=sidebar-2>no</div>two < three</body>", ""),
        (None, "http://a.example", "<article><p>" + "long " * 50_000 + "</article>", ""),
    ]
    pages = workers.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in wrappers.main_text(pages).collect()}
    assert len(got) == 8
    assert got[1]["text"] == WANT
    assert got[2]["text"] == got[3]["text"] == WANT + " third"
    assert [got[n]["text"] for n in (4, 5, 6, 7)] == ["", "", "plain & cut of", "one two < three"]
    assert got[None]["n_chars"] == 5 * 50_000 - 1
    assert wrappers.main_text(pages.limit(0)).count() == 0


def wrapper(*pages):
    return reduce(wrappers.combine, map(wrappers.wrapper_of, pages))["nodes"]


def test_wrappers_are_union_free():
    one, two = "<div><p>a</p><p>b</p><img><p>c</p></div>", "<div><h2>t</h2><p>a</p></div>"
    assert wrappers.expression(wrapper(one)) == "<div><p>text</><p>text</><p>text</></>"
    assert wrappers.expression(wrapper(one, one)) == wrappers.expression(wrapper(one))
    assert wrappers.expression(wrapper(one, two)) == "<div>(<h2>text</>)?<p>text</>(<p>text</>)?(<p>text</>)?</>"
    # A second text in the place of c shows that p repeats; more pages of the kind change nothing.
    three = "<div><p>a</p><p>d</p><p>e</p><p>f</p></div>"
    many = wrappers.expression(wrapper(one, two, three))
    assert many == "<div>(<h2>text</>)?<p>text</>(<p>#</>)*</>"
    assert wrappers.expression(wrapper(one, two, three, three.replace("e", "g<p>h"), one, two)) == many


def test_places_among_siblings_part_template_text():
    menu, foot = "<div>Home About Contact</div>", "<div>(c) Site</div>"
    pages = [f"{'<div>News of %d</div>' % n if n % 2 else ''}{menu}<div>Story {n}{'<p>more' * n}</div>{foot}" for n in range(6)]
    made = reduce(wrappers.combine, map(wrappers.wrapper_of, pages))
    assert wrappers.expression(made["nodes"]) == "(<div>#</>)?<div>text</><div>#(<p>text</>)?(<p>text</>)?(<p>text</>)?(<p>text</>)?(<p>text</>)?</><div>text</>"
    done = wrappers.finished(made["nodes"], made["pages"])
    for n, page in enumerate(pages):
        text = wrappers.extract(page, done)
        assert text.startswith(f"News of {n} Story {n}" if n % 2 else f"Story {n}") and "Home" not in text and "(c)" not in text


def generated(seed):
    """Pages of one template with the text that is their own: menus and footers in plain groups, notices that some pages
    have, bodies of any blocks, with or without an article group."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    texts = lambda n: " ".join(word() for _ in range(n))
    top = "".join(f"<{t}>{texts(3)}</{t}>" for t in rng.choices(["div", "p", "ul><li", "h2"], k=rng.randint(1, 4)) if "<" not in t)
    foot = f"<div class=c{rng.randint(1, 3)}><div>{texts(4)}</div><p>{texts(2)}</p></div>"
    side = f"<section>{texts(3)}</section>"
    around = rng.choice(["article", "div", "main", "td"])
    made = []
    for n in range(rng.randint(8, 14)):
        title, blocks = f"title {n} {texts(2)}", []
        for _ in range(rng.randint(1, 12)):
            blocks.append((rng.choice(["p", "p", "p", "h3", "blockquote", "li"]), f"{n} {texts(rng.randint(3, 9))}"))
        body = f"<h1>{title}</h1>" + "".join(f"<{t}>{x[:4]}<b>{x[4:]}</b></{t}>" for t, x in blocks)
        # Of every three pages two have the section; it is the same on all of them.
        html = f"<body><div id=t>{top}</div><{around}>{body}</{around}>{side if n % 3 else ''}{foot}</body>"
        made.append((html, " ".join([title, *(x for _, x in blocks)])))
    rng.shuffle(made)
    return made


def test_generated_templates(workers):
    rows, want = [], {}
    for seed in range(60):
        for page, text in generated(seed):
            want[len(rows)] = text
            rows.append((len(rows), f"http://t{seed}.example/{len(rows)}", page))
    pages = workers.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = {r["page_id"]: r["text"] for r in wrappers.main_text(pages).collect()}
    assert got == want


def test_order_of_pages_loses_no_text():
    for seed in range(60):
        made = generated(seed)
        for order in range(3):
            random.Random(order).shuffle(made)
            done = reduce(wrappers.combine, (wrappers.wrapper_of(page) for page, _ in made))
            done = wrappers.finished(done["nodes"], done["pages"])
            assert [wrappers.extract(page, done) for page, _ in made] == [text for _, text in made]


def test_wrappers_do_not_grow_with_pages():
    rng = random.Random(1)
    page = lambda: "<div>top</div>" + "".join(
        f"<{t}>{rng.random()}</{t}>" for t in rng.choices(["p", "h2", "pre", "table><tr><td", "dl><dt"], k=rng.randint(0, 40)) if "<" not in t
    )
    sizes = [len(str(wrapper(*(page() for _ in range(n))))) for n in (20, 200)]
    assert sizes[1] < 1.2 * sizes[0]


def test_many_siblings_take_no_square_of_time():
    pages = ["<table>" + "".join(f"<tr><td>{n} {i}</td></tr>" for i in range(20_000 + n)) + "</table>" for n in range(3)]
    assert wrappers.expression(wrapper(*pages)) == "<table>(<tr><td>#</></>)*</>"


def test_pages_with_and_without_article_on_one_host(workers):
    rows = [
        (1, "http://d.example/1", "<div>menu</div><article><p>one text in an article</article>"),
        (2, "http://d.example/2", "<div><p>two plain</p></div>"),
        (3, "http://d.example/3", "<div>menu</div><main><p>three in main</main>"),
        (4, "http://d.example/4", "<div><p>four with a long text of its own</p></div><article>card</article>"),
        (5, None, "<article>five</article>"),
        (6, "no url", "<div>six</div>"),
    ]
    pages = workers.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrappers.main_text(pages).collect()}
    assert got == {
        1: "one text in an article",
        2: "two plain",
        3: "three in main",
        4: "four with a long text of its own card",
        5: "five",
        6: "six",
    }


def test_template_text_in_plain_groups_is_left_out(workers):
    page = '<div class="top"><div>Home</div><div>About</div></div><div class="body"><p>text {n}</p></div>'
    rows = [(n, f"http://e.example/{n}", page.replace("{n}", str(n))) for n in range(5)]
    rows += [(9, "http://e.example/9", '<div class="top"><div>Home</div><div>About</div></div>')]  # has nothing else
    rows += [(n, f"http://f.example/{n}", "<div><p>a page copied</p></div>") for n in range(10, 15)]
    pages = workers.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrappers.main_text(pages).collect()}
    assert got == {n: f"text {n}" for n in range(5)} | {9: "Home About"} | {n: "a page copied" for n in range(10, 15)}


def test_unclosed_tags(workers):
    deep = "".join(f"<{name}>{name}{n} " for n in range(1_000) for name in ("b", "font", "div", "span", "i"))
    want = " ".join(f"{name}{n}" for n in range(1_000) for name in ("b", "font", "div", "span", "i"))
    rows = [
        (1, "http://g.example/1", deep),
        (2, "http://g.example/2", deep + "<nav>menu</nav><article>end</article>"),
        (3, "http://h.example/1", "<div>" * 5_000 + "<div>one</div><div>two</div>three"),
    ]
    pages = workers.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrappers.main_text(pages).collect()}
    assert got == {1: want, 2: want + " end", 3: "one two three"}
    assert wrapper(deep, "<div>a</div>", deep + deep)


def test_names_that_only_look_like_menus(workers):
    kept = [
        '<body class="home has-sidebar"><p>kept</p></body>',
        '<body class="nav-open"><div class="page no-ads"><p>kept</p></div></body>',
        '<body id="footer-less"><p>kept</p></body>',
        '<html class="js menu"><body class="sidebar"><main class="related"><p>kept</p></main></body></html>',
        "<article><header><p>kept</p></header></article>",
        '<p title="a hidden gem" data-id="x">kept</p>',
        '<article><section id="related-work"><p>kept</p></section></article>',
        '<article><section id="social-policy">kept</section></article>',
        '<article><div class="share prices">kept</div></article>',
        '<article><div id="notice-of-termination">kept</div></article>',
        "<p title=it's>kept</p>",
        '<p data-a=1 title = "1 > 0">kept</p>',
        "<p title='class=\"menu\"'>kept</p>",
    ]
    gone = [
        '<div class="menu">gone</div><div class="ad box">gone</div><p class="share-buttons">gone</p>',
        '<div class="related-posts">gone</div><div id=cookie-notice-2>gone</div><p hidden>gone</p>',
        '<article><header class="nav-bar">gone</header></article><header>gone</header>',
        '<div class="has-x sidebar">gone</div><div aria-hidden=true>gone</div><div class=\'promo top\'>gone</div>',
    ]
    rows = [(n, f"http://h{n}.example/", page) for n, page in enumerate(kept)]
    rows += [(100 + n, f"http://g{n}.example/", page) for n, page in enumerate(gone)]
    pages = workers.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrappers.main_text(pages).collect()}
    assert got == {n: "kept" for n in range(len(kept))} | {100 + n: "" for n in range(len(gone))}


def test_apostrophes_in_bare_values(workers):
    rows = [(1, "http://a.example", "<p title=it's>One</p><p>don't go</p><p title=it's>two"), (2, "http://b.example", "<a href=x'>in</a> out")]
    got = {r["page_id"]: r["text"] for r in wrappers.main_text(workers.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "One don't go two", 2: "in out"}
