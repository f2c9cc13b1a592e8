"""Selectors, queries, text, attributes, serializer, encodings, SQL and streaming, over node tables in Spark."""

import pytest
from pyspark.sql import functions as F

import domframe
from domframe import cases
from domframe.functions.encoding import decode_bytes, label, sniff
from domframe.plans.selector import Attribute, Compound, compile_selector, lex


def nodes_of(spark, *pages, context=None):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    return domframe.parse_html(df, context=context)


def found(nodes, selector, **options):
    rows = domframe.query(nodes, selector, **options)
    texts = domframe.text(nodes, rows).select("doc_id", "node_id", F.col("text").alias("words"))
    return [(r["tag"], r["words"]) for r in rows.join(texts, ["doc_id", "node_id"]).orderBy("doc_id", "rank").collect()]


QUERIES = cases.SELECTORS


@pytest.fixture(scope="module")
def all_nodes(spark):
    return nodes_of(spark, *(h for h, _, _ in QUERIES)).cache()


@pytest.mark.parametrize("k", range(len(QUERIES)))
def test_queries(all_nodes, k):
    _, selector, want = QUERIES[k]
    assert found(all_nodes.where(F.col("doc_id") == k), selector) == want


def test_siblings_where_a_node_itself_stands(all_nodes):
    nodes = all_nodes.where(F.col("doc_id") == len(QUERIES) - 1)
    assert found(nodes, "div > i + *", siblings="css") == [("u", "3")]


def test_equal_subtrees_can_be_kept_apart(spark):
    nodes = nodes_of(spark, "<ul><li>A<li>A</ul>", None, "")
    assert found(nodes, "li", dedupe=False) == [("li", "A"), ("li", "A")]
    assert domframe.query_one(nodes, "li").count() == 1
    assert sorted(r["doc_id"] for r in domframe.query_one(nodes, "html").collect()) == [0, 2]


def test_results_are_siblings_of_each_other(spark):
    nodes = nodes_of(spark, "<div><p>a</p></div><section><p>b</p><i>c</i></section>")
    inside = domframe.reroot(nodes, domframe.query(nodes, "p, i"))
    assert found(inside, "p + p") == [("p", "b")]
    assert found(inside, "p ~ i") == [("i", "c")]


def test_pages_without_key_have_no_nodes(spark):
    df = spark.createDataFrame([(None, "<p>n</p>"), (1, "<p>m</p>")], "page_id long, html string")
    assert {r["text"] for r in domframe.text(domframe.parse_html(df)).collect()} == {"m"}


@pytest.mark.parametrize("bad", ["a:b", "[", "[a", "[=b]", "[a=]", "[a~=b]", "[a|=b]", ".", "#", "a,,b", ",a", "[href=/b]", "[a='b]", "a]", "é", "[a=b"])
def test_bad_selectors_raise(bad):
    with pytest.raises(ValueError):
        compile_selector(bad)


def test_selector_parts():
    assert compile_selector("div.a#b[c][d='e f'] > *") == [[(None, Compound("div", "b", ("a",), (Attribute("c"), Attribute("d", "e f", "equal")))), ("child", Compound("*"))]]
    assert compile_selector("a b, c + d~e") == [[(None, Compound("a")), ("descendant", Compound("b"))], [(None, Compound("c")), ("adjacent_sibling", Compound("d")), ("general_sibling", Compound("e"))]]
    assert compile_selector("*p.x") == [[(None, Compound("p", None, ("x",)))]]
    assert compile_selector("[href=a/b]")[0][0][1].attributes == (Attribute("href", "a/b", "equal"),)
    assert compile_selector(r"[a='b\'c']")[0][0][1].attributes[0].value == "b'c"
    assert compile_selector(" ") == []
    assert [k for k, _ in lex("a > b[c^='d']")] == ["ident", "whitespace", "child", "whitespace", "ident", "[", "ident", "prefix", "string", "]"]


@pytest.mark.parametrize(("options", "want"), cases.TEXTS)
def test_text(spark, options, want):
    nodes = nodes_of(spark, cases.TEXT_PAGE)
    assert domframe.text(nodes, domframe.query(nodes, "body"), **options).first()["text"] == want


def test_text_of_documents_and_of_nothing(spark):
    nodes = nodes_of(spark, "<b>x</b>y", "<p></p>", context="div")
    assert sorted((r["doc_id"], r["text"]) for r in domframe.text(nodes).collect()) == [(0, "xy"), (1, "")]
    assert [r["text"] for r in domframe.text(nodes, domframe.query(nodes, "p")).collect()] == [""]


def test_children_and_attributes(spark):
    nodes = nodes_of(spark, "<ul id=u><li>a</li>t<!--c--><li class=''>b</li></ul><a href=x>1</a><a href=x>2</a><svg xlink:href=q></svg>")
    lists = domframe.query(nodes, "ul")
    assert [r["kind"] for r in domframe.children(nodes, lists).orderBy("child_idx").collect()] == ["element", "text", "comment", "element"]
    assert [r["tag"] for r in domframe.children(nodes, lists, include_text=False).orderBy("child_idx").collect()] == ["li", "li"]
    assert [r["value"] for r in domframe.attribute(nodes, "href", "a").collect()] == ["x", "x"]
    assert [r["value"] for r in domframe.attribute(nodes, "class").collect()] == [""]
    assert [r["value"] for r in domframe.attribute(nodes, "href", "svg").collect()] == []
    assert nodes.where("kind = 'text'").select(domframe.get_attr("id").alias("v")).where("v IS NOT NULL").count() == 0


@pytest.mark.parametrize(("html", "options", "want"), cases.FORMS)
def test_serializer(spark, html, options, want):
    assert domframe.to_html(nodes_of(spark, html, context="div"), **options).first()["html"] == want


@pytest.mark.parametrize("doctype", cases.DOCTYPES)
def test_doctypes(spark, doctype):
    assert domframe.to_html(nodes_of(spark, doctype)).first()["html"] == doctype + "<html><head></head><body></body></html>"


def test_serialized_pages_parse_to_themselves(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    once = domframe.to_html(domframe.parse_html(pages)).cache()
    twice = domframe.to_html(domframe.parse_html(once, key="doc_id")).withColumnRenamed("html", "again")
    assert once.join(twice, "doc_id").where("html <> again").count() == 0


@pytest.mark.parametrize(("data", "transport", "want"), cases.ENCODINGS)
def test_encodings(data, transport, want):
    assert sniff(data, transport) == want


def test_labels_and_decoding(spark):
    assert (label(" UTF8\n"), label("latin1"), label("x"), label(None)) == ("utf-8", "windows-1252", None, None)
    assert decode_bytes("é€".encode("cp1252")) == "é€"
    assert decode_bytes(b"\xff\xfea\0") == "a"
    df = spark.createDataFrame([(bytearray(b"\xe9"), None), (bytearray("é".encode()), "utf-8"), (None, None)], "data binary, told string")
    assert [r["html"] for r in domframe.decode(df, "data", F.col("told")).collect()] == ["é", "é", None]
    assert [r["encoding"] for r in domframe.sniff_encoding(df).collect()] == ["windows-1252", "windows-1252", None]


def test_sql_functions(spark):
    domframe.register(spark)
    r = spark.sql("SELECT html_unescape('&lt;&notit;') AS a, html_sniff(CAST('<meta charset=l2>' AS BINARY), NULL) AS b, html_decode(CAST('x' AS BINARY), 'utf-8') AS c").first()
    assert tuple(r) == ("<¬it;", "iso-8859-2", "x")
    rows = spark.sql("SELECT n.tag, n.attrs FROM VALUES ('<a xlink:href=1>x') AS v(h), LATERAL html_parse(h, 'svg svg') n").collect()
    assert [tuple(r) for r in rows] == [("a", {"xlink:href": "1"}), (None, None)]
    assert spark.sql("SELECT count(*) AS n FROM html_tokens('<p a=1>x</p><!--c-->')").first()["n"] == 4
    assert spark.sql("SELECT count(*) AS n FROM html_parse(CAST(NULL AS STRING), 'div')").first()["n"] == 0


def test_functions_of_a_page_equal_the_plans(spark):
    """The same selectors, texts and HTML in Python, next to the parse."""
    from domframe.parser.builder import parse
    from domframe.parser.flatten import rows
    from domframe.plans import match

    for page, selector, want in cases.SELECTORS:
        r = rows(parse(page))
        assert [(x[8], match.text(r, x)) for x in match.find(r, compile_selector(selector))] == want, (page, selector)
    for html, options, want in cases.FORMS:
        if not options:
            assert match.to_html(rows(parse(html, "div"))) == want
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(20)
    whole = {r["doc_id"]: r["html"] for r in domframe.to_html(domframe.parse_html(pages)).collect()}
    assert {r["page_id"]: match.to_html(rows(parse(r["html"]))) for r in pages.collect()} == whole


def test_sql_functions_of_a_page(spark):
    domframe.register(spark)
    page = "<p class=a>x<i>y</i></p><p>z</p>"
    r = spark.sql(f"SELECT html_query('{page}', 'p') AS q, html_text('{page}', 'p') AS t, html_text('{page}', NULL) AS w, html_attr('{page}', 'p', 'class') AS a, html_to_html('{page}') AS h, html_query(NULL, 'p') AS n").first()
    assert tuple(r) == (["<p class=a>x<i>y</i></p>", "<p>z</p>"], ["xy", "z"], ["xyz"], ["a"], "<html><head></head><body><p class=a>x<i>y</i></p><p>z</p></body></html>", None)


def test_a_parse_of_some_columns_and_tags(spark):
    df = spark.createDataFrame([(1, "<p a=b>x<i>y"), (2, None)], "page_id long, html string")
    assert sorted(map(tuple, domframe.parse_html(df, columns=["tag", "node_id"], tags=["p", "i"]).collect())) == [(1, 3, "p"), (1, 5, "i")]
    with pytest.raises(ValueError):
        domframe.parse_html(df, columns=["nothing"])


def test_children_of_bodies_are_those_of_the_trees(spark):
    from domframe.parser.builder import parse
    from domframe.queries import QUERIES as registered

    pages, want = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect(), []
    for r in pages:
        root = next(n for n in parse(r["html"]) if n.kind == "element")
        body = next(n for n in root.children if n.tag == "body")
        want += [(r["page_id"], n.tag) for n in body.children if n.kind == "element"]
    got = registered["children_no_text"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_tokens_table(spark):
    df = spark.createDataFrame([(1, "<!DOCTYPE a><p b=c>x</p><!--y-->"), (2, None)], "k long, html string")
    got = {r["k"]: r["tokens"] for r in domframe.tokenize_html(df).collect()}
    assert [t["kind"] for t in got[1]] == ["doctype", "start_tag", "character", "end_tag", "comment"]
    assert got[2] is None


def test_contexts_by_row(spark):
    df = spark.createDataFrame([(1, "<td>x", "tr"), (2, "<td>x", "div"), (3, "<td>x", None), (4, None, "div")], "page_id long, html string, c string")
    got = domframe.parse_html(df, context=F.col("c")).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in got} == {1: 2, 2: 1}


def test_streams(spark, tmp_path):
    rows = [(k, f"<p>{k}</p>") for k in range(5)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("page_id long, html string").parquet(f"{tmp_path}/in")
    q = domframe.stream_nodes(stream).where("tag = 'p'").writeStream.format("memory").queryName("nodes").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("nodes").count() == 5
    run = domframe.stream_query(stream, lambda n: domframe.text(n, domframe.query(n, "p")), lambda df, k: df.write.mode("overwrite").parquet(f"{tmp_path}/out/{k}"), f"{tmp_path}/check")
    run.awaitTermination()
    assert sorted(r["text"] for r in spark.read.parquet(f"{tmp_path}/out/*").collect()) == [str(k) for k in range(5)]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.html").write_bytes("<meta charset=utf-8><p>é".encode())
    (tmp_path / "b.html").write_bytes("<p>é".encode("cp1252"))
    pages = domframe.read_html_bytes(spark, str(tmp_path), "*.html")
    nodes = domframe.parse_html(pages, key="url")
    assert {r["text"] for r in domframe.text(nodes).collect()} == {"é"}
    assert domframe.read_html_files(spark, f"{tmp_path}/a.html").count() == 1
    domframe.write_nodes(nodes, f"{tmp_path}/nodes", 2)
    again = spark.read.parquet(f"{tmp_path}/nodes")
    assert domframe.query(again, "body > p").count() == 2
    domframe.save_nodes(nodes, "stored_nodes", 4, mode="overwrite")
    stored = domframe.query(spark.table("stored_nodes"), "body > p")
    assert stored.count() == 2
    assert "hashpartitioning" not in stored._jdf.queryExecution().executedPlan().toString()
