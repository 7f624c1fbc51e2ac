"""Page text, URL verdicts and nearest neighbours."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mediaops.llm import ann, html, urls


@pytest.mark.parametrize("page, blocks", [
    ("", []),
    ("only text", ["only text"]),
    ("<p>one<p>two &amp; more&nbsp;x", ["one", "two & more x"]),
    ("<body><nav><a href=/>Home</a></nav><article><h1>T</h1><p>a, b,\n c</p><script>x='</p>'</script><p>d<br>e</p></article><footer>f</footer>",
     ["T", "a, b, c", "d e"]),
    ("<div class=menu><ul><li>m</ul></div><div id=content><h2>H</h2><p>long text, with commas, and words</p><form><p>mail</p></form>"
     "<table><tr><td>cell<td>two</table></div><div class=sidebar><p>side</p></div><div class='comments'><p>nice, very nice, so nice, yes</p></div>",
     ["H", "long text, with commas, and words", "cell", "two"]),
    ("<main><section><p>first, part</p></section><section><p>second, part</p></section></main>", ["first, part", "second, part"]),
    ("<<>><a <b>&#x41;&bogus; <p", ["<<>>A&bogus;"]),
    ("<div>" * 20_000 + "deep", ["deep"]),
    ("<ul><li><a href=1>one link</a><li><a href=2>two link</a><li><a href=3>three link</a></ul><p>Text that is, after all, the text.</p>",
     ["Text that is, after all, the text."]),
])
def test_main_blocks(page, blocks):
    assert html.main_blocks(page) == blocks


ARTICLE = "".join(f"<p>Paragraph {i} has words, and commas, and a plain end.</p>" for i in range(8))


@pytest.mark.parametrize("part", ["<p class='share-price'>{}</p>", "<div class='related-work'><p>{}</p></div>", "<div class='legal-analysis'><p>{}</p></div>",
                                  "<section id='ad-1990'><p>{}</p></section>", "<h2 id='menu'>{}</h2>", "<p class='promotion-history'>{}</p>"])
@pytest.mark.parametrize("wrap", ["article", "div"])
def test_names_that_may_tell_what_a_text_is_about_stay(part, wrap):
    page = f"<body><div class=nav><a href=/>Home</a></div><{wrap}>{ARTICLE}{part.format('This part, too, is text.')}{ARTICLE}</{wrap}></body>"
    assert "This part, too, is text." in html.main_blocks(page)
    gone = "<div class='ad-300x250'><p>Buy now</p></div><ul class='related-work'><li><a href=/1>One</a><li><a href=/2>Two</a></ul><div class='share-buttons'>Tell all</div>"
    assert html.main_blocks(page.replace(f"</{wrap}>", f"{gone}</{wrap}>")) == html.main_blocks(page)


@pytest.mark.parametrize("tag", ["div", "section", "article"])
@pytest.mark.parametrize("name", ["overflow-hidden", "nav-open", "content ad-free", "has-menu", "hidden md:block", "modal", "content ad", "paywall", "skip",
                                  "page subscribe", "comments", "no-comments", "overlay"])
def test_wrappers_of_the_text_stay(tag, name):
    page = f"<body><div class=nav><a href=/>Home</a></div><{tag} id=app class='{name}'>{ARTICLE}</{tag}><div class='promo'><p>Buy, now</p></div></body>"
    assert html.main_blocks(page) == [f"Paragraph {i} has words, and commas, and a plain end." for i in range(8)]


def test_small_parts_go_by_name_and_not_by_look():
    inner = "<div class='overflow-hidden'><p>kept, a</p></div><div class='md:hidden'><p>kept, b</p></div>"
    gone = "".join(f"<div class='{n}'><p>gone, gone</p></div>" for n in ("hidden", "is-hidden", "skip-link", "ad", "navMenu", "post-comments"))
    blocks = html.main_blocks(f"<body><article>{ARTICLE}{inner}{gone}</article></body>")
    assert blocks[8:] == ["kept, a", "kept, b"]


def test_a_long_discussion_is_not_the_text():
    talk = "<div id=comments>" + "<div><p>I think so, too, and more, much more, of it, really.</p></div>" * 30 + "</div>"
    blocks = html.main_blocks(f"<body><div class=post><h1>T</h1>{ARTICLE}</div>{talk}</body>")
    assert len(blocks) == 9 and blocks[0] == "T"


def test_siblings_of_the_best_container_stay():
    part = "<div><p>" + "word, " * 30 + "</p><p>" + "more, " * 30 + "</p></div>"
    blocks = html.main_blocks("<body>" + part * 2 + "<div><a href=/>x</a></div></body>")
    assert [b.split(",")[0] for b in blocks[:4]] == ["word", "more"] * 2


def test_sibling_articles_stay():
    part = "<article><div><p>{0}, one, a plain end of it, and so on.</p><p>{0}, two, and more words, and so on.</p></div></article>"
    blocks = html.main_blocks("<body><div>" + part.format("first") + part.format("second") + "<div><p>beside, all, of, them, of course</p></div>"
                              "<article><a href=/>teaser</a></article></div></body>")
    assert [b.split(",")[0] for b in blocks] == ["first", "first", "second", "second"]


def test_lists_of_links_are_text_inside_an_article_only():
    links = "<ul>" + "".join(f"<li><a href={i}>Reference {i}</a>" for i in range(4)) + "</ul>"
    table = links.replace("ul>", "table>").replace("<li>", "<tr><td>")
    page = f"<body><{{0}}>{ARTICLE}{links}{table}<div class=nav>{links}</div></{{0}}></body>"
    assert html.main_blocks(page.format("article"))[8:] == [f"Reference {i}" for i in range(4)] * 2
    assert html.main_blocks(page.format("main"))[8:] == [f"Reference {i}" for i in range(4)] * 2
    assert html.main_blocks(page.format("div"))[8:] == []


def test_pages_pass_through(spark):
    df = spark.createDataFrame([(1, None, "old"), (2, "<p>x", "old"), (2, "<p>x", "old"), (3, "<p>" + "y " * 200_000, None)], "page_id long, html string, text string")
    got = sorted((r.page_id, len(r.text)) for r in html.extract(df).collect())
    assert got == [(1, 0), (2, 1), (2, 1), (3, 399_999)]
    assert html.extract(df.limit(0)).count() == 0


def places(host, path):
    import hashlib

    grams = {t[i:i + n] for t in (f"^{host}$", f">{path}") for n in urls.LENGTHS for i in range(len(t) - n + 1)}
    return sorted({int(hashlib.md5(g.encode()).hexdigest()[:3], 16) for g in grams}) + [urls.PLACES]


def test_training_is_gradient_descent(spark):
    rows = [(u, 1.0) for u in urls.BLOCKED] + [(u, 0.0) for u in urls.ALLOWED]
    used = [places(u.partition("/")[0], "/" + u.partition("/")[2]) for u, _ in rows]
    w = np.zeros(urls.PLACES + 1)
    for _ in range(urls.STEPS):
        step = urls.RIDGE * w
        for at, (_, y) in zip(used, rows):
            s = 1 / math.sqrt(len(at))
            step[at] += (1 / (1 + math.exp(-s * w[at].sum())) - y) * s / len(rows)
        w = w - urls.SPEED * step
    fitted = urls.fit(spark)
    assert np.allclose(fitted, w, atol=1e-9)
    pages = ["http://www.casino-bets.example.org/x?q", "https://blog.thering.example.com/en/12", "http://CHEAP-pills.test", "https://a.b.example.net/en/1#t",
             "https://x.net/", "http://x.net", "ftp://example.com/de/1", "http://my.example.com/de", "https://q.org/fr/2", "https://example.network/a", None, "",
             "no scheme", "a://b://c/d", "http:///only/path", "http://ünï.example/ä", "http://example.net/en/"]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(pages)], "page_id int, url string, host string")
    got = {r.page_id: r for r in urls.judge(df, fitted).collect()}
    parts = [(r.host, r.path, r.rule) for _, r in sorted(got.items())]
    assert parts[0] == ("www.casino-bets.example.org", "/x", None) and got[0].verdict == "block" and got[1].verdict == "allow"
    assert parts[2][:2] == ("cheap-pills.test", "") and got[2].verdict == "block"
    assert parts[3] == ("a.b.example.net", "/en/1", "example.net/en/") and got[3].verdict == "allow"
    assert parts[4][2] == "net/" and got[4].verdict == "block" and parts[5][2] is None
    assert parts[6][2] == "example.com/de/" and parts[7][2] is None and parts[8][2] == "org/fr/" and parts[9][2] is None
    assert parts[10] == parts[11] == parts[12] == ("", "", None) and parts[13] == ("b:", "//c/d", None)
    assert parts[14] == ("", "/only/path", None) and parts[16][2] == "example.net/en/"
    for i, (host, path, rule) in enumerate(parts):
        if rule is None:
            assert got[i].verdict == ("block" if w[places(host, path)].sum() > 0 else "allow")


def brute(rows, queries, k):
    out = {}
    for q, v in queries:
        near = sorted((-float(np.dot(v, x)), i) for i, x in rows if i != q)[:k]
        out[q] = [i for _, i in near]
    return out


def test_nearest_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "BIN_ROWS", 100)
    monkeypatch.setattr(ann, "QUERY_ROWS", 7)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    good = [(i, (centres[i % 12] + 0.4 * rng.normal(size=8)).tolist()) for i in range(1200)]
    good += [(i, good[0][1]) for i in range(1200, 1500)]  # one very common vector
    odd = [(2000, None), (2020, [0.0] * 8), (2040, [1.0] * 7 + [None]), (2060, [float("nan")] + [1.0] * 7), (2080, [float("inf")] + [0.0] * 7),
           (2100, [1.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in good + odd], "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    vectors = dict(good)
    want = brute(good, [(i, v) for i, v in good if i % 20 == 0], 20)
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & set(want[q])) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, near in got.items():
        assert len(near) == 20 and near == sorted(near, key=lambda x: (-x[1], x[0]))
        assert all(math.isclose(s, float(np.dot(vectors[q], vectors[i])), rel_tol=1e-12, abs_tol=1e-12) for i, s in near)
    few = df.where("vec_id in (0, 1, 2)")
    assert [(r.rank, r.query_id) for r in ann.search(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 0), (2, 0)]
    assert ann.search(df.limit(0), F.col("vec_id") == 0).count() == 0 and ann.search(df.where("vec_id = 0"), F.lit(True)).count() == 0


def test_heap_visits_cells_by_growing_sum():
    rng = np.random.default_rng(1)
    first, second, counts = rng.normal(size=6), rng.normal(size=5), rng.integers(0, 4, 30)
    cells, last = ann.traverse(first, second, counts.tolist(), 10)
    sums = (first[:, None] + second[None, :]).ravel()
    order = [c for c in np.argsort(sums, kind="stable") if counts[c]]
    assert cells == order[:len(cells)] and counts[cells].sum() >= 10 and math.isclose(last, sums[cells[-1]])


def test_a_bin_gives_the_best_of_its_visited_rows(spark):
    """Against a loop over all rows: queries with a floor and without, own keys among the rows, more equal scores than neighbours."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(600, 6))
    v[200:300] = v[7]
    keys = rng.permutation(600)
    index = ann.fit_index(v[:200], 600, 5)
    cells, q, queries = index.cells(v), np.concatenate([v[:90], v[200:201]]), np.concatenate([keys[:90], keys[200:201]])
    first, second = index.distances(q)
    sums = ann.sums_of(first, second, cells)
    last = np.sort(sums, axis=1)[:, 400]
    least = ann.floor(q, queries, first, second, last, v[:200], keys[:200], cells[:200], 5)
    assert np.isfinite(least).all() and np.isneginf(ann.floor(q, queries, first, second, last, v[:4], keys[:4], cells[:4], 5)).all()
    least[::3] = -np.inf
    want = []
    for at in range(len(q)):
        score = np.zeros(600)
        for d in range(6):
            score += q[at, d] * v[:, d]
        near = sorted((-score[i], keys[i]) for i in range(600) if sums[at, i] <= last[at] and keys[i] != queries[at])[:5]
        assert -near[4][0] >= least[at]
        want += [(queries[at], key, -score) for score, key in near]
    asking = pa.table({"query": queries, "q": pa.array(q.tolist()), "last": last, "least": least})
    offered = pa.table({"key": keys, "v": pa.array(v.tolist()), "cell": cells})
    assert list(zip(*(x.tolist() for x in ann.rank(index, asking, offered, 5)))) == want


def test_queries_are_stored_once_and_floats_stay_floats(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(300)]
    narrow = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = ann.search(narrow, F.col("vec_id") % 20 == 0)
    plan = found._jdf.queryExecution().toString()
    assert "q:array<float>,bins:array<bigint>" in plan and "array<double>" not in plan
    assert plan.count("hashpartitioning(bin#") >= 2 and "REPARTITION_BY_NUM" in plan
    wide = ann.search(narrow.withColumn("embedding", F.col("embedding").cast("array<double>")), F.col("vec_id") % 20 == 0)
    assert sorted(found.collect()) == sorted(wide.collect())
