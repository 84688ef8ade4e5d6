import random

from pyspark.sql import functions as F

from waybridge.llm import page_diff
from waybridge.llm.page_diff import common_lines, page_lines

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a><li><a>B</a></ul></nav><div class="cookie-notice">Cookies</div>
<article class="post"><header><h1>Title &copy; &#233;</h1></header><p>Some <b>bold</b> text<br>next&nbsp;line <script>x()</script>and
<span class="ad">buy</span>more.<p>Second<ul><li>one<li>two</ul><div class="share-buttons">Share</div><aside>side</aside>
<form><input>f</form><div id="comments"><p>nice</p></div><footer>f</footer></article><footer>(c)</footer>"""


def texts(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("row", "host", "path", "lines", "marks", "shared", "prev"):
        df = df.withColumn(name, F.lit("x"))
    return {r.page_id: (r.text, r.n_chars, r.url) for r in page_diff.main_text(df).collect()}


def test_article_without_its_frame(spark):
    want = "Title © é\n\nSome bold text next line and more.\n\nSecond\n\none\n\ntwo"
    got = texts(spark, [(1, "http://a/x", PAGE), (2, None, None), (3, "", ""), (4, "no url at all", "<p>a < b && c &lt;x&gt;"), (5, "http://a/z", "<nav>only <p>menu"),
                        (6, "http://b/", "<p>" + "long " * 300_000)])
    assert got[1] == (want, len(want), "http://a/x")
    assert got[2][:2] == got[3][:2] == got[5][:2] == ("", 0)
    assert got[4][0] == "a < b && c <x>" and got[6][1] == 5 * 300_000 - 1


def test_articles_keep_what_their_neighbours_quote_too(spark):
    page = lambda k: f"<nav>m</nav><article><p>Shared passage.<p>Own {k}.</article>"
    got = texts(spark, [(k, f"http://h/{k}", page(k)) for k in range(5)])
    assert all(got[k][0] == f"Shared passage.\n\nOwn {k}." for k in range(5))


def test_articles_lose_what_their_neighbours_have_in_their_frame_only(spark):
    """Pages that name their article are compared too: a line of the site inside the element goes, a quoted one stays."""
    own = lambda k: f"<p>Own words of page {k}, and some more of them.<p>Quoted by all."
    page = lambda k: f"<article>{own(k)}</article><footer><p>Read our letter</footer>"
    odd = f"<article>{own(9)}<p>Read our letter</article>"
    got = texts(spark, [(k, f"http://h/{k}", page(k)) for k in range(4)] + [(9, "http://h/9", odd), (10, "http://alone/9", odd)])
    want = lambda k: f"Own words of page {k}, and some more of them.\n\nQuoted by all."
    assert all(got[k][0] == want(k) for k in (0, 1, 2, 3, 9))
    assert got[10][0] == want(9) + "\n\nRead our letter"


def test_pages_without_article_lose_what_the_nearest_page_has_too(spark):
    page = lambda k: f"<div>Site line</div><p>Own {k}</p><p>More {k}</p><div>All rights &amp; wrongs</div>"
    rows = [(k, f"http://h.example/a/{k}", page(k)) for k in range(6)] + [(10, "http://alone.example/a/3", page(10))]
    got = texts(spark, rows)
    assert all(got[k][0] == f"Own {k}\n\nMore {k}" for k in range(6))
    assert got[10][0] == "Site line\n\nOwn 10\n\nMore 10\n\nAll rights & wrongs"
    # copies of a page, also of one host and as repeated rows, keep their texts
    copies = texts(spark, [(1, "http://h/p", page(1)), (1, "http://h/p", page(1)), (2, "http://h/p", page(1))])
    assert set(v[0] for v in copies.values()) == {"Site line\n\nOwn 1\n\nMore 1\n\nAll rights & wrongs"}


def test_partner_is_the_nearest_path(spark):
    rows = [(1, "http://h/news/1", "<p>News<p>one"), (2, "http://h/news/2", "<p>News<p>two"), (3, "http://h/shop/1", "<p>News<p>Cart<p>three"),
            (4, "http://h/shop/2", "<p>Cart<p>four")]
    got = texts(spark, rows)
    assert [got[k][0] for k in (1, 2, 3, 4)] == ["one", "two", "News\n\nthree", "four"]


def test_a_host_with_most_pages(spark):
    rows = [(k, f"http://big/{k % 40}/{k}", f"<p>Frame</p><p>own {k}</p>") for k in range(400)]
    assert all(v[0] == f"own {k}" for k, v in texts(spark, rows).items())
    assert texts(spark, []) == {}


def test_common_lines_are_a_longest_common_subsequence():
    rng = random.Random(20)

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next(row, x, b)
        return row[-1]

    def _next(row, x, b):
        out = [0]
        for j, y in enumerate(b):
            out.append(row[j] + 1 if x == y else max(row[j + 1], out[j]))
        return out

    for _ in range(1_500):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(18))] for _ in range(2))
        places = common_lines(a, b)
        rest = iter(b)
        assert places == sorted(set(places)) and all(a[i] in rest for i in places) and len(places) == longest(a, b)
    big = list(range(20_000))
    assert common_lines(big, big[::2]) == big[::2]


def test_broken_markup():
    assert page_lines("<p>a<p>b</div></p><b>c") == [("a", 1), ("b", 1), ("c", 1)]
    assert page_lines("<div><nav><ul><li>x</div><p>y") == [("x", 0), ("y", 1)]
    assert page_lines("<p cla") in ([], [("<p cla", 1)])
    assert page_lines("<table><tr><td>1<td>2<tr><td>3</table>") == [("1", 1), ("2", 1), ("3", 1)]


def main_lines(html):
    lines = page_lines(html)
    return [t for t, m in lines if m == max(x for _, x in lines) > 0]


def test_states_in_class_names_and_layouts_are_no_chrome():
    body = "<p>" + "Body text. " * 20
    want = [("Body text. " * 20).strip()]
    for page in (f'<article class="post has-sidebar">{body}</article>', f'<div class="hentry category-social">{body}</div>',
                 f'<div class="layout with-sidebar"><article>{body}</article><div class="sidebar"><p>side</div></div>',
                 f'<div id="right-sidebar"><article>{body}</article></div>', f'<article class="promo">{body}</article>',
                 f'<div class="comments-open">{body}</div>', f'<div class="widget"><div class="post-content">{body}</div></div>',
                 f'<article>{body}<div id="comments"><article class="comment"><p>{"nice " * 90}</article></div></article>',
                 f'<article>{body}</article><div class="sidebar"><article><p>Teaser</article></div>'):
        assert main_lines(page) == want, page
    assert page_lines('<div class="cookie-notice">c</div><div id="share-buttons">s</div><div class="top nav-bar">n</div>') == [
        ("c", 0), ("s", 0), ("n", 0)]


def test_main_text_is_chosen_by_its_amount():
    body = "Body text. " * 20
    teaser = '<article class="card"><p>Teaser of another page</article>'
    for page in (f'<div class="post-content"><p>{body}</div>{teaser}', f"<p>{body}{teaser}", f"{teaser}<div><p>{body}</div>"):
        assert body.strip() in main_lines(page), page
    assert main_lines(f'<div class="post-content"><p>{body}</div>{teaser}') == [body.strip()]
    assert main_lines(f"<div id=content><p>Blog<article><p>{body}</article><p>next</div>") == [body.strip()]


ARTICLE_TEXT = "The same long article. " * 10


def plain_page(*lines):
    return "<div>Site line</div>" + "".join(f"<p>{x}</p>" for x in lines) + "<div>All rights</div>"


def test_copies_lose_the_lines_of_the_site(spark):
    rows = [(k, f"http://h/a/{k}", plain_page(ARTICLE_TEXT)) for k in range(6)]
    rows += [(6 + k, f"http://h/b/{k}", plain_page(f"Another text, number {k}, of some length.")) for k in range(2)]
    got = texts(spark, rows)
    assert {got[k][0] for k in range(6)} == {ARTICLE_TEXT.strip()}
    assert [got[k][0] for k in (6, 7)] == [f"Another text, number {k}, of some length." for k in range(2)]


def test_near_copies_keep_their_article(spark):
    near = lambda k: plain_page(ARTICLE_TEXT, f"Date {k}")
    other = [(1000 + k, f"http://h/{p}", plain_page(f"Another text, number {k}, of some length.")) for k, p in enumerate("az")]
    got = texts(spark, [(k, f"http://h/n/{k}", near(k)) for k in range(200)] + other)
    assert all(got[k][0] == f"{ARTICLE_TEXT.strip()}\n\nDate {k}" for k in range(200))
    assert [got[k][0] for k in (1000, 1001)] == [f"Another text, number {k}, of some length." for k in range(2)]
    # nothing but near copies tells nothing about the frame
    alone = texts(spark, [(k, f"http://h/n/{k}", near(k)) for k in range(3)])
    assert all(alone[k][0] == f"Site line\n\n{ARTICLE_TEXT.strip()}\n\nDate {k}\n\nAll rights" for k in range(3))
    # copies among near copies
    mixed = texts(spark, [(k, f"http://h/n/{k}", near(k // 3)) for k in range(9)] + other)
    assert all(mixed[k][0] == f"{ARTICLE_TEXT.strip()}\n\nDate {k // 3}" for k in range(9))
