import random

import numpy as np
import pytest

from colloquy.llm import html_text, vectors


def lines(html):
    return html_text.page_blocks(html)[0]


@pytest.mark.parametrize("html, want", [
    ("<article><h1>A &amp; B</h1><p>one\n  two&nbsp;three<p>four</article>", ["A & B", "one two three", "four"]),
    ("<nav>menu</nav><article><p>x<div class='ad'>buy</div><p>y</article><footer>f</footer>", ["x", "y"]),
    ("<article><form>f</form><aside>s</aside><p>keep <i>it</i> all</p><script>var a='</p>';</script><style>p{}</style></article>", ["keep it all"]),
    ("<article><p>t</p><section class='comments'><article><p>reader</p></article></section></article>", ["t"]),
    ("<main><p>a<br>b</p><div role='navigation'>n</div><p hidden>h</p></main><p>out", ["a", "b"]),
    ("<body class='has-sidebar'><p>a &lt;b&gt; &#233; &copy; &am", ["a <b> é © &am"]),
    ("<article><!-- note --><table><tr><td>1<td>2<tr><td>3</table><pre> x\n y </pre></article>", ["1 2", "3", "x y"]),
    ("<article><p>cut <b>here", ["cut here"]),
    ("<article><header>h</header><p>body</p><div id='cookie-notice'>c</div></article>", ["body"]),
    ("<div class='content-with-sidebar'><article><p>a</article></div>", ["a"]),
    ("<div class='has-header'><main><h2 id='related-work'>r</h2><p class='ad-hoc'>b</p><div class='related-links'>x</div></main></div>", ["r", "b"]),
    ("<main><ul><li class='share'>one<li>two</ul><p>three</main>", ["one", "two", "three"]),
    ("<main><article><p>story</article></main><section><article><p>teaser</article></section>", ["story"]),
    ("<main></main><article><p>story</article>", ["story"]),
    ("", []), (None, []), ("plain text", ["plain text"]), ("<article></article>", []),
])
def test_blocks(html, want):
    assert lines(html) == want


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(1500):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 10))] for _ in range(2))
        shared = [x for x, same in zip(a, html_text.common_lines(a, b)) if same]
        rest = iter(b)
        assert len(shared) == longest(a, b) and all(any(x == y for y in rest) for x in shared)


def page(i, body):
    return f"<body><p>Site menu</p>{body}<p>All rights reserved</p></body>"


def test_pages_without_an_article_lose_what_the_nearest_page_shares(spark):
    rows = [(i, f"http://a.example/{i:03d}", page(i, f"<p>own text number {i} of this page</p><p>second line {i}</p>")) for i in range(40)]
    rows += [(100, "http://b.example/x", page(100, "<p>alone</p>")), (101, None, page(101, "<p>no url</p>")), (102, "http://c.example/", None),
             (103, "http://a.example/000", "<article><p>Site menu</p></article>"), (104, "http://d.example/1", page(1, "<p>same</p>")),
             (105, "http://d.example/1", page(1, "<p>same</p>")), (106, "http://e.example/1", page(1, "<p>copy</p>")),
             (107, "http://e.example/1?a", page(1, "<p>copy</p>")), (108, "http://e.example/2", page(1, "<p>s</p>")),
             (109, "http://f.example/1", "<!-- <article> -->" + page(1, "<p>first</p>")), (110, "http://f.example/2", page(1, "<p>next</p>"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS path", "3 AS text").repartition(4)
    got = {r.page_id: r for r in html_text.main_text(pages).collect()}
    assert len(got) == len(rows)
    for i in range(40):
        assert got[i].text == f"own text number {i} of this page\nsecond line {i}"
    whole = "Site menu\n{}\nAll rights reserved"
    assert got[100].text == whole.format("alone") and got[101].text == whole.format("no url")
    assert (got[102].text, got[102].n_chars) == ("", 0) and got[103].text == "Site menu"
    assert got[104].text == got[105].text == whole.format("same") and got[104].n_chars == len(got[104].text)
    assert [got[i].text for i in range(106, 111)] == ["copy", "copy", "s", "first", "next"]
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_declared_articles_lose_shared_lines_that_no_markup_vouches_for(spark):
    body = "<article><div>Share this story</div><h1>Title</h1><p>own text {0}</p><ul><li>Licence</li></ul>Read more at a.example</article>"
    rows = [(i, f"http://a.example/{i:02d}", body.format(i)) for i in range(6)]
    rows += [(6, "http://a.example/03?copy", body.format(3)), (7, "http://b.example/", body.format(7)),
             (8, "http://a.example/02/x", "<p>Share this story</p><p>other page</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.main_text(pages).collect()}
    for i in range(7):
        want = f"Title\nown text {3 if i == 6 else i}\nLicence"
        assert got[i] == (want, len(want))
    assert got[7][0] == "Share this story\nTitle\nown text 7\nLicence\nRead more at a.example"
    assert got[8][0] == "Share this story\nother page"


def nearest_by_brute_force(rows):
    """The text of each page from a plain list: the last different page of the host before it, else the next one."""
    ordered = sorted((u.split("//")[1].split("/")[0], u.split("?")[0], u, i, tuple(lines(h))) for i, u, h in rows)
    out = {}
    for at, (host, _, _, i, own) in enumerate(ordered):
        before = [o[4] for o in ordered[:at] if o[0] == host and o[4] != own]
        after = [o[4] for o in ordered[at:] if o[0] == host and o[4] != own]
        other = before[-1] if before else after[0] if after else ()
        out[i] = "\n".join(x for x, same in zip(own, html_text.common_lines(list(own), list(other))) if not same)
    return out


@pytest.mark.parametrize("chars", [1 << 23, 1500, 300])
def test_ranges_don_t_matter(spark, monkeypatch, chars):
    """Hosts of one page, of copies only, and runs of copies that are longer than a range."""
    monkeypatch.setattr(html_text, "RANGE_CHARS", chars)
    rng = random.Random(9)
    rows = []
    for host in range(25):
        for n in range(rng.choice([1, 2, 2, 3, 12])):
            body = f"<p>story {host} {rng.randint(0, n)}</p><p>line {rng.randint(0, 2)}</p>"
            for copy in range(rng.choice([1, 1, 1, 2, 25])):
                rows.append((len(rows), f"http://h{host:02d}.example/{n:02d}?{copy:02d}", page(0, body)))
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert got == nearest_by_brute_force(rows) and sum("menu" not in t for t in got.values()) > len(rows) // 2


def brute(rows, threshold):
    ids = [r[0] for r in rows]
    unit = []
    for _, v, label in rows:
        good = v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        unit.append((np.array(v) / np.linalg.norm(v)) if good else None)
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if unit[i] is not None and unit[j] is not None
              and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold]
    count, label, moved = [0] * len(rows), list(ids), True
    for i, j in linked:
        count[i] += 1
        count[j] += 1
    while moved:
        moved = False
        for i, j in linked:
            least = min(label[i], label[j])
            moved |= (label[i], label[j]) != (least, least)
            label[i] = label[j] = least
    return sorted(zip(ids, count, label, [a == b for a, b in zip(ids, label)]))


@pytest.mark.parametrize("block", [1024, 5])
def test_vectors_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(2)
    rows = []
    for c in range(25):
        base = rng.standard_normal(24)
        for _ in range(int(rng.integers(1, 7))):
            rows.append((len(rows), (base + rng.standard_normal(24) * rng.uniform(0, 0.35)).tolist(), int(c % 3)))
    base = rng.standard_normal(24).tolist()
    rows += [(200 + i, base, 1) for i in range(30)] + [(300, [x * 3 for x in base], 1), (301, base, None), (302, base, 2)]
    rows += [(400, None, 1), (401, [0.0] * 24, 1), (402, [float("nan")] * 24, 1), (403, [None] + base[1:], 1),
             (404, [float("inf")] + base[1:], 1), (405, [], 1), (406, base[:10], 1), (407, base[:10], 1), (408, [2.0], 1), (409, [1.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS rep", "2 AS n_links", "3 AS i").repartition(3)
    got = sorted(map(tuple, vectors.near_vectors(frame).collect()))
    assert got == brute(rows, 0.93)
    assert vectors.near_vectors(frame.limit(0)).count() == 0


def test_recall_at_the_threshold():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((2000, 64))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93 ** 2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    labels = np.zeros(2000, np.int64)
    a, b = (vectors.bucket_keys(v, labels, vectors.TABLES) for v in (x, y))
    assert (a[:, :, :, None] == b[:, :, None, :]).any(axis=(1, 2, 3)).mean() > 0.99


def test_hadamard_keeps_lengths():
    rows = np.random.default_rng(4).standard_normal((5, 16))
    assert np.allclose(vectors.hadamard(vectors.hadamard(rows)), 16 * rows)


def test_repeated_rows_of_one_vector(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0], 0)] * 3, "vec_id long, embedding array<double>, label int")
    assert [tuple(r) for r in vectors.near_vectors(frame).collect()] == [(1, 2, 1, True)] * 3
