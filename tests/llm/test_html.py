import random
import time

import pytest

from numera.llm import html

SCHEMA = "page_id long, url string, html string, text string, n_chars string"


def table(spark, rows, parts=2):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA) if rows else spark.createDataFrame([], SCHEMA)
    return df.repartition(parts) if rows else df


@pytest.mark.parametrize(
    "page,text",
    [
        ("<article><h1>A &amp; B</h1><p>one\n  two<br>three<p>four</article>", "A & B\none two three\nfour"),
        ("<nav>menu</nav><main><p>x</p></main><footer>&copy; y</footer>", "x"),
        ("<p>plain</p><div class='cookie-notice'><p>ok?</p></div><form>q</form><aside>s</aside>", "plain"),
        ("<article>t<script>var a='</p>'</script><style>p{}</style><!-- <p>no</p> --><p>u</article><div class=comments><p>hi</div>", "t\nu"),
        ("<article><p>cut off &am", "cut off &am"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\nb\nc\nd"),
        ("<article><header><h1>T</h1></header><p>b <a title='>'>c</a> <b>d</b>e</p><div class='ad'>buy</div></article>", "T\nb c de"),
        ("<p hidden>no</p><p>yes &#x41;&eacute;&nbsp;z</p>", "yes Aé z"),
        ("<p>a<span class=ad>buy</span>b <i>c</i></p><p><span class=promo>x</span></p>", "ab c"),
        ("", ""), (None, ""), ("no markup", "no markup"), ("<<>>", "<<>>"),
    ],
)
def test_page(page, text):
    assert html.main_text(html.page_lines(page), None) == text


@pytest.mark.parametrize("most", [html._MOST_PAIRS, -1])
def test_longest_common_subsequence(monkeypatch, most):
    rnd = random.Random(1)
    monkeypatch.setattr(html, "_MOST_PAIRS", most)
    for _ in range(300):
        a, b = ([rnd.randrange(4) for _ in range(rnd.randrange(9))] for _ in "ab")
        n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                n[i + 1][j + 1] = n[i][j] + 1 if a[i] == b[j] else max(n[i][j + 1], n[i + 1][j])
        got = html.common_subsequence(a, b)
        own, it = [a[i] for i in sorted(got)], iter(b)
        assert len(got) == n[-1][-1] and all(x in it for x in own)


def test_shared_lines_go(spark):
    pages = [(i, f"https://h.example/a/{i}", f"<div>Site name</div><div>Tagline</div><div>Story {i}</div><div>More {i}</div><div>Imprint</div>") for i in range(7)]
    pages += [(50, "https://other.example/x", "<div>Site name</div><div>alone</div>"), (51, None, "<p>lost</p>"), (52, None, "<p>lost</p><p>found</p>"), (53, "https://z.example/", None), (3, *pages[3][1:])]
    got = {(r.page_id, r.url): r.text for r in html.extract(table(spark, pages, 4)).collect()}
    for i in (0, 1, 2, 4, 5, 6):
        assert got[i, f"https://h.example/a/{i}"] == f"Story {i}\nMore {i}"
    assert got[50, "https://other.example/x"] == "Site name\nalone" and got[53, "https://z.example/"] == ""
    rows = html.extract(table(spark, pages, 4)).collect()
    assert len(rows) == len(pages) and all(r.n_chars == len(r.text) for r in rows)


def test_articles_stay_whatever_the_neighbour_has(spark):
    page = "<nav><a>m{0}</a></nav><article><p>same story</p></article><footer>f{0}</footer>"
    pages = [(i, f"http://h.example/{i}", page.format(i)) for i in range(4)]
    assert {r.text for r in html.extract(table(spark, pages)).collect()} == {"same story"}


def test_pairing_does_not_depend_on_partitions(spark):
    pages = [(i, f"http://{'ab'[i % 2]}.example/{i // 3}", f"<div>s{i // 3}</div><div>t{i}</div><div>u{i % 5}</div>") for i in range(60)]
    results = []
    for n in ("1", "7", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        results.append(sorted(tuple(r) for r in html.extract(table(spark, pages)).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert results[0] == results[1] == results[2]


def brute_text(page, others):
    """The page without what its nearest URL shares, by the textbook table of longest common subsequences."""
    lines = html.page_lines(page[2])
    near = [o for o in others if o is not page and html_host(o[1]) == html_host(page[1])]
    keys = [x.key for x in lines]
    if near:
        order = sorted([page, *near], key=lambda p: (html_path(p[1]).encode(), p[0]))
        at = order.index(page)
        sides = [order[k] for k in (at - 1, at + 1) if 0 <= k < len(order)]
        best = max(sides, key=lambda o: html.agreement(html_path(o[1]), html_path(page[1])))
        other = [x.key for x in html.page_lines(best[2])]
        n = [[0] * (len(other) + 1) for _ in range(len(keys) + 1)]
        for i in range(len(keys) - 1, -1, -1):
            for j in range(len(other) - 1, -1, -1):
                n[i][j] = n[i + 1][j + 1] + 1 if keys[i] == other[j] else max(n[i + 1][j], n[i][j + 1])
        shared, i, j = set(), 0, 0
        while i < len(keys) and j < len(other):
            if keys[i] == other[j]:
                shared.add(i)
                i, j = i + 1, j + 1
            elif n[i + 1][j] >= n[i][j + 1]:
                i += 1
            else:
                j += 1
    else:
        shared = set()
    return "\n".join(x.text for i, x in enumerate(lines) if i not in shared)


def html_host(url):
    return url.split("/")[2]


def html_path(url):
    return "/" + "/".join(url.split("/")[3:])


def test_pages_against_brute_force(spark):
    rnd = random.Random(4)
    pages = []
    for i in range(60):
        site, section = rnd.randrange(3), rnd.randrange(4)
        body = "".join(f"<div>own {i} {k}</div>" for k in range(rnd.randrange(4)))
        pages.append((i, f"http://h{site}.example/s{section}/p{i}", f"<div>Site {site}</div><div>Section {section}</div>{body}<div>Imprint {site}</div>"))
    got = {r.page_id: r.text for r in html.extract(table(spark, pages, 5)).collect()}
    assert got == {p[0]: brute_text(p, pages) for p in pages}
    alone = {p[0]: html.main_text(html.page_lines(p[2]), None) for p in pages}
    assert sum(got[i] != alone[i] for i in got) > 50  # without differencing nearly all differ


def test_the_nearer_neighbour_counts(spark):
    pages = [(1, "http://h.example/a/1", "<div>Head A</div><div>one</div>")] + [(k, f"http://h.example/b/{k}", f"<div>Head B</div><div>own {k}</div>") for k in (2, 3)]
    assert {r.page_id: r.text for r in html.extract(table(spark, pages)).collect()} == {1: "Head A\none", 2: "own 2", 3: "own 3"}


def test_repeated_rows_and_nulls(spark):
    page = "<div>Site</div><div>Body {0}</div>"
    pages = [(1, "http://h.example/1", page.format(1))] * 3 + [(2, "http://h.example/2", page.format(2)), (None, None, "<p>x</p>"), (7, None, "y"), (7, "y", None)]
    got = sorted(((r.page_id, r.url, r.text) for r in html.extract(table(spark, pages, 4)).collect()), key=repr)
    assert got == sorted([(1, "http://h.example/1", "Body 1")] * 3 + [(2, "http://h.example/2", "Body 2"), (None, None, "x"), (7, None, "y"), (7, "y", "")], key=repr)


@pytest.mark.parametrize("unit", ["<a ", "<div>x", "<a \"'>", "</p>", "<script", "<!", "<li>x", "<p>a</p><p>b</p>", "<div class=ad><article>", "&am", "<a b='", "<table><tr><td>x"])
def test_hostile_pages_take_linear_time(unit):
    page = unit * (1_000_000 // len(unit))
    began = time.perf_counter()
    lines = html.page_lines(page)
    assert time.perf_counter() - began < 20
    if unit == "<p>a</p><p>b</p>":
        keys = [x.key for x in lines]
        began = time.perf_counter()
        shared = html.common_subsequence(keys[:30_000], keys[1:30_001])
        assert len(shared) == 29_999 and time.perf_counter() - began < 20


def test_empty(spark):
    assert html.extract(table(spark, [])).count() == 0


@pytest.mark.parametrize(
    "page,text",
    [
        ("<div style='overflow:hidden'><article>a</article></div>", "a"),
        ("<div class='overflow-hidden no-sidebar'><p>b</p></div>", "b"),
        ("<article class='post category-social'><p>c</p></article>", "c"),
        ("<div class='layout-widget has-sidebar'><main>d</main></div>", "d"),
        ("<div class='sidebar'><article>e</article></div>", "e"),
        ("<article class='widget'>f<div class='ad-2'>buy</div></article>", "f"),
        ("<article>g</article><div class='comments'><article>reply</article></div>", "g"),
        ("<p>h</p><p style='color:red; display: none'>no</p><p hidden=''>no</p><div class='site-footer'>no</div>", "h"),
    ],
)
def test_names_and_hiding_are_read_exactly(page, text):
    assert html.main_text(html.page_lines(page), None) == text


def test_differencing_decides_beside_and_inside_articles(spark):
    page = "<div>Site name</div><div>Body {0}</div><article><h1>Teaser {0}, long enough to be the most of it</h1><p>Follow us</p></article><div>Imprint</div>"
    pages = [(i, f"http://h.example/{i}", page.format(i)) for i in range(4)]
    got = {r.page_id: r.text for r in html.extract(table(spark, pages)).collect()}
    assert got == {i: f"Body {i}\nTeaser {i}, long enough to be the most of it" for i in range(4)}
