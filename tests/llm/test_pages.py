import duckdb

from lodestrata.llm import html_text, url_filters

PAGES = [
    (1, "https://A.Example.NET/en/1?x#y", "<html><head><title>T</title></head><body><nav>menu</nav><article><h1>One &amp; two</h1><p>First <b>bold</b>\n text<p>Second<div class='ad'>buy</div><aside>side</aside><p class=comment>hm<p>Third &lt;x&gt;</article><footer>foot</footer>"),
    (2, "http://b.example.com/de/", "<div>Shared top</div><p>Own two</p><div>Shared end</div>"),
    (3, "http://b.example.com/de/x", "<div>Shared top</div><p>Own three</p><div>Shared end</div>"),
    (3, "http://b.example.com/de/x", "<div>Shared top</div><p>Own three</p><div>Shared end</div>"),
    (4, "http://c.org/fr/q", None),
    (5, None, ""),
    (6, "no address", "<script>var a='</p>';</script>plain<!-- gone"),
    (7, "http://d.org", "<p>Alone</p>"),
    (None, "x://e.example.net/EN/", "<p " + "a" * 50_000),
]


def test_html(spark):
    got = [(r.page_id, r.text) for r in html_text.extract(spark.createDataFrame(PAGES, "page_id long, url string, html string")).collect()]
    want = [(1, "One & two\n\nFirst bold text\n\nSecond\n\nThird <x>"), (2, "Own two"), (3, "Own three"), (3, "Own three"), (4, ""), (5, ""), (6, "plain"), (7, "Alone"), (None, "")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_neighbours_beyond_copies_and_near_copies(spark):
    page = lambda own, top="Shared top", end="Shared end": f"<div>{top}</div><p>{own}</p><div>{end}</div>"
    rows = [(k, f"http://long.org/a/{k:04}", page("Copied often by many")) for k in range(700)] + [(700, "http://long.org/b", page("Own words of another"))]
    rows += [(800, "http://near.org/a/z", page("Far page text", "Top A", "End A")), (801, "http://near.org/b/1", page("First page text", "Top A", "End B")), (802, "http://near.org/b/2", page("Second page text", "Top B", "End B"))]
    article = [f"A long line of an article, number {k}" for k in range(12)]
    both = lambda x: "".join(f"<p>{y}</p>" for y in [*article, x])
    rows += [(900, "http://copy.org/1", both("one")), (901, "http://copy.org/2", both("two"))]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert {got[k] for k in range(700)} == {"Copied often by many"} and got[700] == "Own words of another"
    assert got[801] == "Top A\n\nFirst page text"
    assert got[900].split("\n\n") == [*article, "one"] and got[901].split("\n\n") == [*article, "two"]


def test_elements_end_with_those_around_them():
    text = lambda html: html_text.main_text(*html_text.lines_of(html), [])
    assert text("<article><p>one</p><div class=ad>buy<p>two</p></article><p>x") == ["one", "x"]
    assert text("<article><p>one<div class=ad>buy</div><p>two</article><div>short</div>") == ["one", "two", "short"]
    assert text("<article><header><h1>Head</h1></header><div class='related-work'>kept</div></article><header>page</header>") == ["Head", "kept"]
    assert text("<article class=teaser>Teaser</article><p>A story that stands beside it and is longer</p>") == ["Teaser", "A story that stands beside it and is longer"]
    assert text("<main><p>a <span class=ad>buy</span> b <b>c</main>") == ["a b c"]
    assert text("<p>a\x1cb \u00a0\t c&#32; </p>") == ["a\x1cb c"]
    assert text("<ul><li class=menu>x<li>y<ul><li>z</ul></ul><table><tr><td>1<td>2<tr><td>3</table>") == ["y", "z", "1 2", "3"]


def test_open_lines_stay_beside_an_article_of_any_size():
    """No length decides, and no part of a class name does."""
    text = lambda html: html_text.main_text(*html_text.lines_of(html), [])
    for body in ("x", "y" * 150, "z" * 5000):
        assert text(f"<h1>Title of the story</h1><p>Lead outside.</p><article>{body}</article><p>After text.</p>") == ["Title of the story", "Lead outside.", body, "After text."]
    kept = '<article><p class="share-price">a</p><p id="comment-on-law">b</p><p class="menu-of-day">c</p><p class="ad-hoc">d</p></article>'
    assert text(kept) == ["a", "b", "c", "d"]
    assert text('<article><p>a</p><div class="box comments">b</div><div id="cookie-notice">c</div><div role="dialog">d</div></article>') == ["a"]


def made_sites():
    """(rows, text with differencing, text without): sites whose frames carry no mark, so that only neighbours tell them."""
    import random

    chance = random.Random(8)
    rows, wanted, plain = [], {}, {}
    for host in range(12):
        top, end = [f"Site {host} top {k}" for k in range(3)], [f"Site {host} end {k}" for k in range(2)]
        folders = {f: f"Section {host} {f} links" for f in "ab"}
        for k in range(chance.randrange(4, 30)):
            folder = chance.choice("ab")
            own = [f"Own line {host} {k} {j} " + "words " * chance.randrange(1, 30) for j in range(chance.randrange(3, 9))]
            own = [x.strip() for x in own]
            head, tail = own[:1], own[1:]
            body = "".join(f"<p>{x}</p>" for x in tail)
            body = f"<article>{body}</article>" if k % 2 else body
            frame = "".join(f"<div>{x}</div>" for x in [*top, folders[folder]])
            html = f"<body><nav>Menu</nav>{frame}<h1>{head[0]}</h1>{body}<aside>Aside {k}</aside>{''.join(f'<div>{x}</div>' for x in end)}</body>"
            page = len(rows)
            rows.append((page, f"http://site{host}.org/{folder}/{k:03}", html))
            wanted[page] = [*head, *tail]
            plain[page] = [*top, folders[folder], *head, *tail, *end]
    return rows, wanted, plain


def test_differencing_decides_where_nothing_is_marked(spark):
    rows, wanted, plain = made_sites()
    got = {r.page_id: r.text.split("\n\n") for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    for page, url, html in rows:
        assert html_text.main_text(*html_text.lines_of(html), []) == plain[page]
        # the line of a folder stays on a page that is alone in it, since no other page has it
        assert [x for x in got[page] if not x.startswith("Section")] == wanted[page]
    alone = sum(any(x.startswith("Section") for x in own) for own in got.values())
    assert alone < len(rows) / 10


def common(a, b):
    """The length of a longest common subsequence, by a table of all suffixes."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = 1 + best[i + 1][j + 1] if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


def plain_extract(rows):
    """Neighbours by looking at all pages of a host, shared lines by a table of all prefixes."""
    page = {r: html_text.lines_of(r[2]) for r in rows}
    key = {r: url_filters_parts(r[1]) for r in rows}
    order = sorted(set(rows), key=lambda r: (key[r], r[0]))

    sizes = {}
    for k, r in enumerate(order):
        near = []
        for step in (-1, 1):
            j = k + step
            while 0 <= j < len(order) and key[order[j]][0] == key[r][0] and page[order[j]] == page[r]:
                j += step
            if 0 <= j < len(order) and key[order[j]][0] == key[r][0]:
                near.append(order[j])
        sizes[r] = [common(page[r][0], page[x][0]) for x in near]
    return sizes


def url_filters_parts(url):
    tail = url.split("://", 1)[1].split("?")[0].split("#")[0]
    host, slash, path = tail.partition("/")
    return host.lower(), slash + path


def test_deleted_lines_are_a_longest_common_subsequence(spark):
    import random

    from pyspark.sql import functions as F

    chance = random.Random(4)
    rows = []
    for k in range(400):
        frame = [f"menu {j}" for j in range(chance.randrange(3, 6))]
        own = [f"text {k} {j}" for j in range(chance.randrange(1, 9))]
        html = "<nav>" + "".join(f"<p>{x}</p>" for x in frame) + "</nav><article>" + "".join(f"<p>{x}</p>" for x in own) + "</article><footer>end</footer>"
        rows.append((k, f"http://h{k % 7}.org/{chance.choice('ab')}/{chance.randrange(60)}", html))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4).withColumn("row", F.col("page_id"))
    gone = {r.row: r.gone for r in html_text.deleted_lines(df).collect()}
    want = plain_extract(rows)
    for r in rows:
        lines, zones = html_text.lines_of(r[2])
        assert all(zones[i] != html_text.MAIN for i in gone[r[0]]) and len(gone[r[0]]) in want[r] and min(want[r]) >= 4
    out = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert all(out[k] == "\n\n".join(x for x, z in zip(*html_text.lines_of(h)) if z == html_text.MAIN) for k, _, h in rows)


def test_differencing_of_the_test_pages(spark):
    """These pages' frames are dealt without regard to hosts, so that neighbours share few lines; none of an article is deleted."""
    from pyspark.sql import functions as F

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    gone = {r.row: r.gone for r in html_text.deleted_lines(pages.withColumn("row", F.col("page_id"))).collect()}
    zones = {r.page_id: html_text.lines_of(r.html)[1] for r in pages.collect()}
    found = [zones[p][k] for p, own in gone.items() for k in own]
    assert len(found) > 30 and html_text.MAIN not in found


def test_longest_common_lines():
    assert html_text.shared_lines([1, 2, 3, 4, 5], [1, 9, 3, 5]) == [0, 2, 4]
    assert html_text.shared_lines([], [1]) == [] and html_text.shared_lines([1, 1], [1]) == [0]


def test_url_filters(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = [tuple(r) for r in url_filters.judge(pages, url_filters.rule_table(spark)).collect()]
    con = duckdb.connect()
    frame = pages.toPandas()[["page_id", "url"]].astype({"page_id": "Int64"})
    con.register("pages", frame)
    assert sorted(got, key=str) == sorted(con.sql(url_filters.OP4_SQL).fetchall(), key=str)


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(none).count() == 0
    assert url_filters.judge(none, url_filters.rule_table(spark)).count() == 0


def test_shared_lines_equal_the_table():
    import random

    chance = random.Random(2)
    for _ in range(300):
        a, b = ([chance.randrange(6) for _ in range(chance.randrange(12))] for _ in range(2))
        found = html_text.shared_lines(a, b)
        assert len(found) == common(a, b) and common([a[i] for i in found], b) == len(found)
