import random

import pytest

from marlstone.llm import html_extract as H

TEMPLATE = '<html><body><nav><a>Home</a></nav><div class="top-notice">We moved</div><article><h1>{t}</h1><p class="hint">Read more on our site</p><p>{a}</p><p>{b} &amp; more</p><div class="comments"><p>nice!</p></div></article><aside>side</aside><footer>end</footer></body></html>'


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("<p>a  b<p>c<br>d", "a b\nc d"),
        ("<article><h1>T</h1><p>x &lt;y&gt; &eacute;&#65;</p></article><footer>f</footer>", "T\nx <y> éA"),
        ("<body><header><h1>Site</h1></header><main><p>m</p></main></body>", "m"),
        ("<body><script>var a='</p>';</script><p>t<style>p{}</style></p><!-- x --><form><p>f</p></form></body>", "t"),
        ("<body><div class='sidebar'>s</div><ul><li>a<li>b</ul></body>", "a\nb"),
        ("<article><p>open <b>bold<p>next", "open bold\nnext"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
        ("<p>cut &am", "cut &am"),
        ('<div class="content"><p>in</p></div><div class="related-posts"><p>out</p></div><p>aside of it</p>', "in"),
        ("<p hidden>no</p><p style='display: none'>no</p><p>yes", "yes"),
        ("plain < text", "plain < text"),
    ],
)
def test_pages_by_roles(page, text):
    assert H.extract(page) == text


def test_matching_is_the_largest():
    a, b = H.parse("<div><p>1</p><ul></ul><p>2</p></div>"), H.parse("<div><p>1</p><p>2</p></div>")
    H.number(a)
    assert H.match(a, b) == 4
    assert [n.mark for n in H.preorder(b)] == [0, 1, 2, 4]


def test_constant_nodes_go_and_slots_stay(spark):
    rows = [(i, f"http://h/{i}", TEMPLATE.format(t=f"Title {i}", a=f"first {i * 7}", b=f"second {i * 13}")) for i in range(12)]
    rows += [(20, None, "<p>no host</p>"), (21, "http://h/x", None), (22, "http://once/", TEMPLATE.format(t="A", a="b", b="c")), (22, "http://once/", "<p>again</p>")]
    rows += [(30 + i, f"http://same/{i}", TEMPLATE.format(t="Same", a="same", b="same")) for i in range(9)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, html string, host string, seed string")
    out = [(r["page_id"], r["text"], r["n_chars"]) for r in H.main_text(df).collect()]
    found = {i: t for i, t, _ in out}
    assert found[3] == "Title 3\nfirst 21\nsecond 39 & more"
    assert found[20] == "no host" and found[21] == ""
    assert found[35].startswith("Same\n")  # a host of one page repeated keeps its text
    assert sorted(t for i, t, _ in out if i == 22) == ["A\nRead more on our site\nb\nc & more", "again"]
    assert all(n == len(t) for _, t, n in out) and len(out) == len(rows)
    assert H.main_text(df.limit(0)).count() == 0


def texts_of(spark, pages):
    df = spark.createDataFrame([(i, "http://h/", p) for i, p in enumerate(pages)], "page_id bigint, url string, html string")
    return {r["page_id"]: r["text"] for r in H.main_text(df).collect()}


def closed(*parts):
    return "<html><body><article>" + "".join(parts) + "</article></body></html>"


def test_text_that_only_stands_where_a_template_node_does_is_kept(spark):
    page = lambda i, n: closed(*(f"<p>real {i} {k} text</p>" for k in range(n)), "<p>a constant note</p>")
    found = texts_of(spark, [page(i, 4) for i in range(9)] + [page(9, 7)])
    assert all(f"real 9 {k} text" in found[9].split("\n") for k in range(7))
    assert found[0] == "\n".join(f"real 0 {k} text" for k in range(4))


def test_copies_of_the_seed_do_not_make_its_tail_template(spark):
    long = closed(*(f"<p>long {k}</p>" for k in range(6)))
    found = texts_of(spark, [long] * 6 + [closed(*(f"<p>short {i} {k}</p>" for k in range(4))) for i in range(6)])
    assert found[0] == "\n".join(f"long {k}" for k in range(6))


def test_blocks_that_vary_below_a_constant_node_are_kept(spark):
    found = texts_of(spark, [closed(f"<p>{i} first</p><div>Also:<p>varies {i}</p></div>") for i in range(8)])
    assert found[3] == "3 first\nvaries 3"


def largest(p, q):
    """Simple tree matching as it is defined."""
    if p.tag != q.tag:
        return 0
    table = [[0] * (len(q.nodes) + 1) for _ in range(len(p.nodes) + 1)]
    for i, x in enumerate(p.nodes):
        for j, y in enumerate(q.nodes):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + largest(x, y))
    return 1 + table[-1][-1]


def test_matching_is_the_largest_on_random_trees():
    rng = random.Random(7)

    def tree(depth):
        tag = rng.choice(("div", "section", "b"))
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(rng.randint(0, 4) if depth else 0)) + f"</{tag}>"

    for _ in range(150):
        a, b = (H.parse("".join(tree(3) for _ in range(rng.randint(1, 4)))) for _ in range(2))
        nodes = H.number(a)
        assert H.match(a, b) == largest(a, b)
        marked = [x for x in H.preorder(b) if x.mark >= 0]
        assert len(marked) == largest(a, b) and all(nodes[x.mark].tag == x.tag for x in marked)


def test_one_section_more_in_front_moves_no_partner():
    head, note = "<section><h2>A</h2><ul><li>1</li></ul></section>", "<section class='n'><p><b>Note</b></p></section>"
    body = "<section><h3>B</h3><table><tr><td>1</td></tr></table></section>"
    a, b = H.parse(head + body + note), H.parse("<section><i>new</i></section>" + head + body + note)
    H.number(a)
    H.match(a, b)
    assert [x.mark - y.mark for x, y in zip(b.nodes[1:], a.nodes, strict=True)] == [0, 0, 0]
    deep = H.parse("<div>" * 3000 + "x")
    H.number(deep)
    assert H.match(deep, H.parse("<div>" * 2500 + "<p>y")) == 2501


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div itemprop="articleBody"><p>one</p></div><div class="ad">buy</div><div itemprop="articleBody"><p>two, longer</p></div><p>beside', "one\ntwo, longer"),
        ('<div class="entry-content"><p>first part</p></div><div class="ads">x</div><div class="entry-content">second</div>', "first part\nsecond"),
        ("<body><article>a</article><p>between</p><article>bb<article>inner</article></article></body>", "a\nbb\ninner"),
        ("<main><header><h1>Head</h1></header><p>lead</p><article><p>text</p></article><aside>no</aside></main><p>out", "Head\nlead\ntext"),
        ("<main><p>m</p><article></article></main><article class='post'><p>a</p></article>", "a"),
        ("<article> </article><main><div class='content'>x</div>y</main><main>z</main>", "x\ny\nz"),
        ("<section class='related'><article>other, and much longer</article></section><article>own</article>", "own"),
    ],
)
def test_all_content_elements_of_a_kind_are_read(page, text):
    assert H.extract(page) == text


def test_long_lists_of_siblings_are_matched_as_short_ones(monkeypatch):
    import time

    rng = random.Random(3)
    for _ in range(40):
        a, b = (H.parse("".join(rng.choice(["<p>x</p>", "<ul><li>1</li><li>2</li></ul>", "<ul><li>3</li></ul>", "<p><b>y</b></p>", "<h2>z</h2>"]) for _ in range(rng.randint(20, 60)))) for _ in range(2))
        H.number(a)
        assert H.match(a, b) == largest(a, b)
    left, right = ([f"<p class='c{i % 7}'>text {i * k}</p>" for i in range(2000)] for k in (1, 2))
    a, b = H.parse("".join(left)), H.parse("".join(["<p>first</p>", *right[:-1], "<div>d</div>"]))
    H.number(a)
    began = time.time()
    assert H.match(a, b) == 2001
    assert time.time() - began < 3
    H._weights.clear()
    grid = H._Grid(a.kids, b.kids, H.weight, 4 * 2000)
    assert len(grid.pairs(most=10_000)) == len(grid.pairs()) == 2000


SITE = '<html><body><div class="x1"><a href="/">Home</a> <a href="/b">Blog</a></div><div class="x2"><p>All about gardens since 1990</p></div><div class="x3"><h2>{t}</h2>{p}</div><div class="x4"><p>Seen today: {n}</p><p>Made with care</p></div></body></html>'


def test_slots_pick_the_content_of_a_site_without_telling_names(spark):
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice(["rose", "soil", "water", "spade", "light"]) for _ in range(30))
    pages, want = [], []
    for i in range(12):
        body = [text() for _ in range(rng.randint(1, 4))]
        pages.append(SITE.format(t=f"Garden {i}", p="".join(f"<p>{x}</p>" for x in body), n=i))
        want.append("\n".join([f"Garden {i}", *body]))
    found = texts_of(spark, pages)
    assert [found[i] for i in range(12)] == want


def test_slots_outweigh_a_misleading_element(spark):
    page = '<html><body><div><article>Teaser {i}</article></div><div class="x"><p>{a}</p><p>{b}</p></div></body></html>'
    long = lambda i, k: " ".join(f"w{i}x{k}y{j}" for j in range(20))
    found = texts_of(spark, [page.format(i=i, a=long(i, 1), b=long(i, 2)) for i in range(8)])
    assert found[4] == long(4, 1) + "\n" + long(4, 2)


@pytest.mark.parametrize("part", ['<div class="social-history"><p>kept</p></div>', '<p class="ad-hoc">kept</p>', '<section class="related-work">kept</section>', '<p class="share">kept</p>', '<div class="promotional-essay">kept</div>'])
def test_names_that_only_hold_a_role_are_no_role(part):
    assert H.extract(f"<article><p>a</p>{part}</article>") == "a\nkept"


@pytest.mark.parametrize("part", ['<div class="comments">x</div>', '<div class="ad-slot">x</div>', '<aside>x</aside>', '<div role="navigation">x</div>', '<div id="Cookie_Notice">x</div>'])
def test_roles_inside_an_article_go(part):
    assert H.extract(f"<article><p>a</p>{part}<p>b</p></article>") == "a\nb"


def test_marked_articles_of_the_tables(spark):
    """The article element's own text, read by a plain parser of tags, is what comes out."""
    import html as entities
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r["page_id"]: r["text"] for r in H.main_text(pages).collect()}
    for r in pages.where("html is not null").collect():
        m = re.search(r"<article>(.*?)(?:</article>|<footer|$)", r["html"], re.S)
        if m:
            parts = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|h2|h3|div|ul|li|table|tr|td|pre|blockquote)\b[^>]*>", re.sub(r"<br\s*/?>", " ", re.sub(r"<!--.*?-->", "", m[1], flags=re.S)))]
            assert found[r["page_id"]] == "\n".join(p for p in parts if p), r["page_id"]


def test_a_long_page(spark):
    page = closed(*(f"<p>{i} long text</p>" for i in range(100_000)))
    assert texts_of(spark, [page])[0].count("\n") == 99_999
