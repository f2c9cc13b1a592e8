"""Page extraction on planted templates, and vector links against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from domframe.llm import extraction, vectors
from domframe.llm.extraction import Page


def page(host, k, article):
    return (f"""<!DOCTYPE html><html><head><title>T{k}</title><style>p{{}}</style></head><body class="page"><header><h2>Site {host}</h2></header>
<nav><ul><li><a href="/a">Home<li><a href="/b{k}">Link {k}</a></ul></nav><!-- c --><div class="cookie-notice">Accept cookies {k}?</div>
<div id="content"><div class="sidebar widget">Side {k}</div>{article}<form><label>Name</label><input value=x><button>Go</button></form>
<section class="comments"><article class="comment">Nice {k}!</article></section></div><div class="ad">Buy {k}</div><script>var x = "</p><p>no";</script>
<div class="tail">All rights reserved by {host}, read our terms</div><footer>&copy; {host} {k}</footer></body></html>""")


def test_article_without_its_surroundings(spark):
    rows, want = [], {}
    for k in range(12):
        rows.append((k, f"https://h.example/{k}", page("h.example", k, f"<article><h1>Title &amp; {k}</h1><p><b>First\n  line {k}<br>more<p>Second&nbsp;<i>it</i>alic &#65;&lt;{k}</article>")))
        want[k] = f"Title & {k} First line {k} more Second italic A<{k}"
    got = {r["page_id"]: r for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()}
    assert {k: r["text"] for k, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


@pytest.mark.parametrize("limit", [extraction.BROADCAST_BRANCHES, -1])
def test_style_tree_finds_the_template_where_nothing_names_it(spark, monkeypatch, limit):
    monkeypatch.setattr(extraction, "BROADCAST_BRANCHES", limit)
    body = lambda k: f"<div class=top>Welcome to the site</div><div class=main><p>Own words {k} {k * 7}</p><p>and more of {k}</p></div><div class=bottom><p>Imprint and terms</p></div>"
    rows = [(k, "http://s.net/x", f"<html><body>{body(k)}") for k in range(9)] + [(50, "http://lone.net/", f"<body>{body(50)}"), (51, None, f"<body>{body(51)}")]
    got = {r["page_id"]: r["text"] for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"Own words {k} {k * 7} and more of {k}" for k in range(9))
    assert got[50] == "Welcome to the site Own words 50 350 and more of 50 Imprint and terms"
    assert "Own words 51" in got[51]


@pytest.mark.parametrize("limit", [extraction.BROADCAST_BRANCHES, -1])
def test_repeated_classless_parts_of_an_article_go(spark, monkeypatch, limit):
    monkeypatch.setattr(extraction, "BROADCAST_BRANCHES", limit)
    rows = []
    for k in range(10):
        extra = "<p>Now and then.</p>" if k < 4 else ""  # on fewer than half of the pages, so it is text
        parts = f"<h1>Title {k}</h1><p>Own words {k}</p>{extra}<h3>Read on</h3><p>Join our <b>club</b> today.</p><ul><li>Item {k}<li>Buy here</ul><table><tr><td>cell {k}<td>advert</table>"
        rows.append((k, "https://plain.example/", page("plain.example", k, f"<article>{parts}</article>")))
    got = {r["page_id"]: r["text"] for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Title {k} Own words {k}{' Now and then.' if k < 4 else ''} Item {k} cell {k}" for k in range(10)}


def test_classless_blocks_are_told_apart_among_their_siblings(spark):
    def body(k):
        own = "".join(f"<div>Own text {k} {n}</div>" for n in range(1 + k % 3))  # so the last one's place differs
        return f"<html><body><div>Menu</div>{own}<div class=box>Advert</div><div class=box>Told {k}</div><div>Imprint <div>and terms</div></div>"

    rows = [(k, "http://bare.example/", body(k)) for k in range(9)]
    got = {r["page_id"]: r["text"] for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: " ".join([*(f"Own text {k} {n}" for n in range(1 + k % 3)), f"Told {k}"]) for k in range(9)}


def test_planted_templates_under_random_names(spark):
    rng = np.random.default_rng(21)
    word = lambda: "".join(rng.choice(list("bcdfghklmnprstvw"), 6))
    rows, want = [], {}
    for h in range(6):
        names = [word() for _ in range(8)]
        menu, legal, teaser = " ".join(word() for _ in range(6)), " ".join(word() for _ in range(12)), " ".join(word() for _ in range(5))
        for k in range(4 + 9 * h):
            own = [" ".join(word() for _ in range(int(rng.integers(3, 30)))) for _ in range(int(rng.integers(1, 6)))]
            if k % 4 == 3:  # a copy of the article before, on another address
                own = last
            last = own
            main = "".join(f"<p>{x}</p>" if j % 3 else f"<div class='{names[5]}'>{x}</div>" for j, x in enumerate(own))
            body = f"<div class={names[0]}><div class={names[1]}>{menu}</div><div class={names[2]}><div class={names[3]}>{main}<p>{teaser}</p></div></div><div class={names[4]}{k}>{legal}</div></div>"
            rows.append((len(rows), f"https://{names[6]}.example/{k}", f"<html><head><title>T</title></head><body>{body}</body></html>"))
            want[len(rows) - 1] = " ".join(own)
    got = {r["page_id"]: r["text"] for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_pages_without_url_and_long_pages(spark):
    long = "<p>" + "word & more " * 400_000
    rows = [(1, None, "<p>x"), (2, "", "<p>x"), (3, "no address", long), (None, None, "<p>x")]
    got = extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("paths", F.lit("clash"))).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 1), (1, 1), (2, 1), (3, 12 * 400_000 - 1)]


def test_copies_of_an_article_are_kept(spark):
    rows = [(k, "http://c.net/", page("c.net", k, "<article><h1>Same</h1><p>Same words on every page.</p></article>")) for k in range(8)]
    got = extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {"Same Same words on every page."}


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "deep" + "<p>x" * 500
    rows = [(1, "u", None), (2, None, ""), (3, "http://a/", "plain text &amp; more"), (4, "http://a/", "<p>cut <b"), (5, "http://a/", deep), (5, "http://a/", deep), (None, "http://a/", "<article>a<article>b</article>"), (6, "http://a/", "<article>" + "w " * 200_000)]
    got = extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 8
    assert (by[1], by[2], by[3], by[4], by[None]) == ("", "", "plain text & more", "cut", "a b")
    assert len(by[6]) == 2 * 200_000 - 1
    assert extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_scanner_reads_what_tags_hide():
    text = lambda h: Page(h).text()
    assert text("<p title='a>b'>x</p>") == "x"
    assert text("a<script>if (a<b) '</p>'</script>b<STYLE>x</STYLE>c") == "a b c"
    assert text("<textarea><p>no</textarea>yes<!-- <p>no -->!") == "yes!"
    assert text("<table><tr><td>1<td>2<tr><td>3</table>") == "1 2 3"
    assert text("one<b>two</b> three<span> four</span>") == "onetwo three four"
    assert text("<p hidden>no<p data-hidden=x>yes") == "yes"
    assert text("<div class='page with-sidebar'><p>in</p><div id=sidebar>out</div></div>") == "in"
    assert text("<div class='comments'><p>all there is</p></div><footer>f</footer>") == ""
    assert text("<div class='cookie-notice'>We use cookies</div><div class=ad>Buy</div>") == ""
    assert text("<div class='social-science'><h1>On society</h1><p>x</p></div><p>Short line") == "On society x Short line"
    assert text("<div class='entry-header'><h1>Title</h1></div><p>x") == "Title x"
    assert text("<article>If <math><mi>x</mi><mo>=</mo><mn>1</mn></math>, so <svg><text>no</text></svg>be it") == "If x=1, so be it"
    assert text("<div class='page has-comments no-sidebar'>x<div class='user-comments-list'>y</div><div id='mainNav'>z</div></div>") == "x"
    assert text("<body><div class='site-header'>S</div><article><div class='header'>H</div>x</article>") == "H x"
    assert text("<article class=post><header class='entry-header'><h1>T</h1></header><p>x</p><div class='share-box'>s</div><aside>a</aside></article>") == "T x"


def brute(rows, cosine=0.98):
    links, root = {}, {}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    good = [(i, np.array(v, float), label) for i, v, label in rows if v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    for i, *_ in rows:
        links[i], root[i] = 0, i
    for i, v, label in good:
        for j, w, other in good:
            if i < j and label == other and len(v) == len(w) and v @ w / math.sqrt((v @ v) * (w @ w)) >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: (links[i], top(i), top(i) == i) for i in links}


def vector_rows(n, seed=0, dim=12):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        base = rng.normal(size=dim)
        out.append((len(out) * 3 + 1, base.tolist(), k % 3))
        for c in range(int(rng.integers(0, 4))):
            near = base + rng.normal(size=dim) * 0.06 * (1 + c % 2)
            out.append((len(out) * 3 + 1, (near if c else base * 2).tolist(), k % 3))
    return out


def test_links_equal_brute_force(spark):
    rows = vector_rows(250)
    rows += [(10_000 + k, v, label) for k, (v, label) in enumerate([(None, 1), ([0.0] * 12, 1), ([1.0] * 12, None), ([float("nan")] + [1.0] * 11, 1), ([float("inf")] + [1.0] * 11, 1), ([None] + [1.0] * 11, 1), ([1.0, 2.0], 1), ([2.0, 4.0], 1), ([], 1), ([1.0] * 12, 1), ([1.0] * 12, 1), ([-0.0] + [1.0] * 11, 2), ([0.0] + [1.0] * 11, 2)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit("clash"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(df).collect()}
    want = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows])
    assert sum(got[i] != w for i, w in want.items()) == 0


def test_shards_and_blocks_find_the_links(spark, monkeypatch):
    for name, value in (("BLOCK", 40), ("DEGREE", 8)):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(5)
    ball = rng.normal(size=16)
    rows = vector_rows(200, 2, 16) + [(100_000 + k, (ball + rng.normal(size=16) * 0.04).tolist(), 1) for k in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = vectors.near_duplicates(df).cache()
    want, got = brute(rows), {r["vec_id"]: r["n_links"] for r in found.collect()}
    total = sum(w[0] for w in want.values())
    assert sum(min(got[i], w[0]) for i, w in want.items()) >= 0.97 * total
    assert all(got[i] <= w[0] for i, w in want.items())
    have, there = vectors.audit(df, found, every=10)
    assert have >= 0.9 * there


def planted_pairs(n, dim, seed, cosine=0.981):
    """n pairs of random unit vectors of one label at the given cosine."""
    rng = np.random.default_rng(seed)
    x, side = rng.normal(size=(2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    y = cosine * x + math.sqrt(1 - cosine**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    return [(2 * k + c, v.tolist(), 1) for k in range(n) for c, v in enumerate((x[k], y[k]))]


def test_no_link_is_lost_among_many_shards_in_reach(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 12)
    rows = planted_pairs(300, 4, 3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == brute(rows)


def test_links_between_blocks_are_all_found(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 150)
    rows = planted_pairs(900, 64, 4)
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").where("true")).collect()
    assert sum(r["n_links"] != 1 or r["component_id"] != r["vec_id"] // 2 * 2 for r in got) == 0


def test_a_block_whose_search_misses_links_is_compared():
    x = np.repeat(np.eye(40, dtype=np.float32), 2, axis=0)
    none = [np.zeros(0, np.int64)] * 80  # a graph without edges leads nowhere
    assert {q: found.tolist() for q, found in vectors._block_search(x, none, np.arange(80), 0.97)} == {q: [q ^ 1] for q in range(80)}


def test_lengths_of_vectors_do_not_matter(spark):
    rows = vector_rows(60)
    sizes = [1e-300, 1e-200, 1.0, 1e200, 1e300]
    scaled = [(i, [x * sizes[k % 5] for x in v], label) for k, (i, v, label) in enumerate(rows)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(spark.createDataFrame(scaled, "vec_id long, embedding array<double>, label int")).collect()}
    for i, (n, component, kept) in brute(rows).items():
        assert got[i] == (n, component, kept)


def fast_brute(x, cosine=0.98):
    """(links of each row, least row it is connected with) by comparing all."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = (np.concatenate(k) for k in zip(*((r + at, c) for at in range(0, len(x), 2000) for r, c in [np.nonzero(x[at:at + 2000] @ x.T >= cosine)]), strict=True))
    a, b = a[a != b], b[a != b]
    root = np.arange(len(x))
    while True:
        least = root.copy()
        np.minimum.at(least, a, root[b])
        least = least[least]
        if (least == root).all():
            return np.bincount(a, minlength=len(x)), root
        root = least


def test_a_large_label_with_balls(spark, monkeypatch):
    rng = np.random.default_rng(12)
    bases = rng.normal(size=(12_000, 32))
    near = bases[:9000] + rng.normal(size=(9000, 32)) * 0.13 * rng.random((9000, 1))
    ball = rng.normal(size=32) + rng.normal(size=(4500, 32)) * 0.2
    tight = rng.normal(size=32) + rng.normal(size=(2500, 32)) * 0.05
    x = np.concatenate([bases, near, ball, tight]).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(vectors, "BLOCK", 2000)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df).collect()}
    links, root = fast_brute(x.astype(np.float64))
    assert links.sum() > 2_000_000
    assert [got[k] for k in range(len(x))] == list(zip(links.tolist(), root.tolist(), strict=True))


def test_rows_that_share_an_id(spark):
    rows = [(4, [1.0, 0.0], 1), (4, [0.0, 1.0], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.01], 1), (6, [0.01, 1.0], 1), (7, [1.0, 0.01], 2)]
    got = sorted(map(tuple, vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()))
    assert got == [(4, 1, 4, True)] * 3 + [(5, 1, 4, False), (6, 1, 4, False), (7, 1, 4, False)]


def test_vectors_without_rows_or_ids(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vectors.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (5, [2.0, 0.0], 1)]
    got = sorted(map(tuple, vectors.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(None, 0, None, True), (4, 2, 4, True), (4, 2, 4, True), (5, 2, 4, False)], key=str)


def test_pruned_graph_is_flat_and_whole():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = vectors.build_graph(x)
    seen, front = {0}, [0]
    while front:
        front = [k for f in front for k in links[f].tolist() if k not in seen and not seen.add(k)]
    assert len(seen) == 500
    assert np.mean([len(a) for a in links]) < 3 * vectors.DEGREE
