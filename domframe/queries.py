"""A query over pages for each operator, and the same in DuckDB's SQL.

The SQL works on the generated pages, whose regular markup regular expressions can take apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import case_queries
from .functions.encoding import decode, sniff_encoding
from .functions.sql import register, unescape_udf
from .operators.extract import attribute, children, get_attr, text
from .operators.parse import parse_html, tokenize_html
from .operators.query import query, query_one, reroot
from .operators.serialize import to_html
from .sources.pages import read_pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_STORED: dict[tuple[str, str], DataFrame] = {}


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages; a table in fewer pieces than there are cores is dealt out, a larger one is read as it lies."""
    pages = read_pages(spark, f"{sf_dir}/pages.parquet")
    cores = spark.sparkContext.defaultParallelism
    return pages.repartition(2 * cores, "page_id") if pages.select("page_id").rdd.getNumPartitions() < cores else pages


def nodes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of all pages, parsed once in a session and kept in memory or on the executors' disks."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        _STORED[key] = parse_html(pages_of(spark, sf_dir)).repartition("doc_id").persist(StorageLevel.MEMORY_AND_DISK)
    return _STORED[key]


def forget_nodes() -> None:
    """Frees what nodes_of keeps, so that the next query parses again."""
    while _STORED:
        _STORED.popitem()[1].unpersist()


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _un(x: str) -> str:
    """x with the references decoded that the generated pages use."""
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{char}')"
    return x


def _between(a: str, b: str, html: str = "html") -> str:
    return f"regexp_extract({html}, '(?s){a}(.*?){b}', 1)"


#: A row per link: page, place and undecoded target and text.
LINKS = "(SELECT page_id, unnest(range(len(l))) AS k, unnest(l) AS link FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"[^\"]*\">[^<]*</a>') AS l FROM pages))"
HREF, WORD = _un("regexp_extract(link, 'href=\"([^\"]*)\"', 1)"), _un("regexp_extract(link, '>([^<]*)<', 1)")
UNIQUE = f"(SELECT DISTINCT page_id, {HREF} AS href, {WORD} AS word FROM {LINKS})"
BARE = "regexp_replace(html, '(?s)<script>.*?</script>', '<script></script>')"
COUNTED = {"li": "<li>", "a": '<a href="', "h1": "<h1>", "p": "<p>", "nav": "<nav>", "footer": "<footer>", "article": "<article>", "div": '<div class="'}


def _id(df: DataFrame, *columns) -> DataFrame:
    return df.select(F.col("doc_id").alias("page_id"), *columns)


@_query(f"SELECT page_id, tag, n FROM (SELECT page_id, unnest({[*COUNTED]}) AS tag, unnest([{', '.join(f'CAST(len(regexp_extract_all({BARE}, \'{x}\')) AS BIGINT)' for x in COUNTED.values())}]) AS n FROM pages) WHERE n > 0")
def parse_tag_counts(spark, sf_dir):
    found = parse_html(pages_of(spark, sf_dir), columns=["tag"], tags=[*COUNTED])
    return _id(found.groupBy("doc_id", "tag").agg(F.count("*").alias("n")), "tag", "n")


@_query("SELECT page_id, 'html' AS name FROM pages")
def parse_doctype(spark, sf_dir):
    return _id(nodes_of(spark, sf_dir).where("kind = 'doctype'"), F.col("doctype.name").alias("name"))


@_query(f"SELECT page_id, {_between('<!--', '-->')} AS comment FROM pages")
def parse_comments(spark, sf_dir):
    return _id(nodes_of(spark, sf_dir).where("kind = 'comment'"), F.col("text").alias("comment"))


@_query("SELECT page_id, CAST(1 AS BIGINT) AS heads, CAST(1 AS BIGINT) AS bodies FROM pages")
def parse_structure(spark, sf_dir):
    return _id(nodes_of(spark, sf_dir).groupBy("doc_id").agg(F.count_if(F.col("tag") == "head").alias("heads"), F.count_if(F.col("tag") == "body").alias("bodies")), "heads", "bodies")


@_query(f"""SELECT page_id, kind, n FROM (SELECT page_id, unnest(['doctype', 'comment', 'start_tag', 'end_tag']) AS kind, unnest([CAST(1 AS BIGINT), CAST(1 AS BIGINT),
    CAST(len(regexp_extract_all({BARE}, '<[a-z]')) AS BIGINT), CAST(len(regexp_extract_all({BARE}, '</[a-z0-9]+>')) AS BIGINT)]) AS n FROM pages)""")
def tokenize_counts(spark, sf_dir):
    tokens = tokenize_html(pages_of(spark, sf_dir).select("page_id", "html")).select("page_id", F.explode("tokens").alias("t"))
    return tokens.where("t.kind <> 'character'").groupBy("page_id", F.col("t.kind").alias("kind")).agg(F.count("*").alias("n"))


@_query(f"SELECT page_id, href, word FROM {UNIQUE}")
def query_type(spark, sf_dir):
    nodes = nodes_of(spark, sf_dir)
    return _id(_with_text(nodes, query(nodes, "a"), "word").withColumn("href", get_attr("href")), "href", "word")


def _with_text(nodes: DataFrame, found: DataFrame, name: str, **options) -> DataFrame:
    words = text(nodes, found, **options).select(F.col("doc_id").alias("_doc"), F.col("node_id").alias("_node"), F.col("text").alias(name))
    return found.join(words, (F.col("doc_id") == F.col("_doc")) & (F.col("node_id") == F.col("_node")))


@_query()
def query_universal(spark, sf_dir):
    return _id(query(nodes_of(spark, sf_dir), "*").groupBy("doc_id").agg(F.count("*").alias("n")), "n")


@_query(f"SELECT page_id, {_un(_between('<div class=\"ad\">', '</div>'))} AS ad FROM pages")
def query_class(spark, sf_dir):
    nodes = nodes_of(spark, sf_dir)
    return _id(_with_text(nodes, query(nodes, ".ad"), "ad"), "ad")


@_query("SELECT page_id, 'article' AS tag FROM pages")
def query_id(spark, sf_dir):
    """The pages have no ids, so their articles are given one."""
    named = pages_of(spark, sf_dir).withColumn("html", F.replace(F.col("html"), F.lit("<article>"), F.lit('<article id="x">')))
    return _id(query(parse_html(named), "#x"), "tag")


@_query("SELECT page_id, 'ad' AS class FROM pages WHERE regexp_matches(html, '<div class=\"ad\">')")
def query_compound(spark, sf_dir):
    return _id(query(nodes_of(spark, sf_dir), "div.ad"), get_attr("class").alias("class"))


def _attr_query(name: str, selector: str, test: str) -> None:
    def run(spark, sf_dir):
        return _id(query(nodes_of(spark, sf_dir), selector), get_attr("href").alias("href"))

    run.__name__ = name
    _query(f"SELECT page_id, href FROM {UNIQUE} WHERE {test}")(run)


_attr_query("query_attr_exists", "[href]", "true")
_attr_query("query_attr_prefix", "[href^='/th']", "starts_with(href, '/th')")
_attr_query("query_attr_suffix", "a[href$='e']", "ends_with(href, 'e')")
_attr_query("query_attr_substring", "[href*=th]", "contains(href, 'th')")
_attr_query("query_child", "nav > ul > li > a", "true")
_attr_query("query_descendant", "nav a", "true")


@_query("SELECT page_id, 'html' AS tag FROM pages WHERE contains(html, '<html lang=\"en\">')")
def query_attr_eq(spark, sf_dir):
    return _id(query(nodes_of(spark, sf_dir), "[lang=en]"), "tag")


@_query(f"SELECT page_id, {_un(_between('<div class=\"ad\">', '</div>'))} AS words FROM pages")
def query_adjacent(spark, sf_dir):
    nodes = nodes_of(spark, sf_dir)
    return _id(_with_text(nodes, query(nodes, "nav + div"), "words"), "words")


@_query("SELECT page_id, 'article' AS tag FROM pages")
def query_general_sibling(spark, sf_dir):
    return _id(query(nodes_of(spark, sf_dir), "nav ~ article"), "tag")


@_query("SELECT page_id, CAST(1 AS INTEGER) AS rank, 'h1' AS tag FROM pages UNION ALL SELECT page_id, 2, 'title' FROM pages")
def query_list_rank(spark, sf_dir):
    return _id(query(nodes_of(spark, sf_dir), "h1, title"), "rank", "tag")


@_query(f"SELECT page_id, {HREF} AS href FROM {LINKS} WHERE k = 0")
def query_one_first_link(spark, sf_dir):
    return _id(query_one(nodes_of(spark, sf_dir), "a"), get_attr("href").alias("href"))


@_query(f"SELECT page_id, href FROM {UNIQUE}")
def query_chained(spark, sf_dir):
    nodes = nodes_of(spark, sf_dir)
    return _id(query(reroot(nodes, query(nodes, "nav li")), "a"), get_attr("href").alias("href"))


@_query(f"SELECT page_id, CAST(count(*) AS BIGINT) AS n FROM {LINKS} GROUP BY page_id")
def children_ul(spark, sf_dir):
    nodes = nodes_of(spark, sf_dir)
    return _id(children(nodes, query(nodes, "ul")).groupBy("doc_id").agg(F.count("*").alias("n")), "n")


@_query()
def children_no_text(spark, sf_dir):
    """Without SQL: it would have to know where the b that articles leave open is opened again.  tests compare it with the trees."""
    nodes = nodes_of(spark, sf_dir)
    return _id(children(nodes, query(nodes, "body"), include_text=False), "tag")


def _text_query(name: str, selector: str, sql: str, **options) -> None:
    def run(spark, sf_dir):
        nodes = nodes_of(spark, sf_dir)
        return _id(text(nodes, query(nodes, selector), **options), "text")

    run.__name__ = name
    _query(sql)(run)


NAV = f"(SELECT page_id, string_agg({WORD}, '{{}}' ORDER BY k) AS text FROM {LINKS} GROUP BY page_id)"
_text_query("text_title", "title", f"SELECT page_id, {_un(_between('<title>', '</title>'))} AS text FROM pages")
_text_query("text_nav_sep", "nav", f"SELECT page_id, text FROM {NAV.format(' | ')}", separator=" | ")
_text_query("text_strip", "title", f"SELECT page_id, trim({_un(_between('<title>', '</title>'))}) AS text FROM pages", strip=True)
_text_query("text_script", "script", f"SELECT page_id, {_between('<script>', '</script>')} AS text FROM pages", include_script=True)
_text_query("text_style", "style", f"SELECT page_id, {_between('<style>', '</style>')} AS text FROM pages", include_style=True)
_text_query("text_shallow", "h1", f"SELECT page_id, {_un(_between('<h1>', '</h1>'))} AS text FROM pages", deep=False)


@_query(f"""SELECT page_id, {_un("regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)>.*?</(script|style)>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g')")} AS text FROM pages""")
def text_page(spark, sf_dir):
    return _id(text(nodes_of(spark, sf_dir)), "text")


@_query("SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages")
def attr_lang(spark, sf_dir):
    return _id(query(nodes_of(spark, sf_dir), "html"), get_attr("lang").alias("lang"))


@_query(f"SELECT page_id, href FROM {UNIQUE}")
def attribute_hrefs(spark, sf_dir):
    return _id(attribute(nodes_of(spark, sf_dir), "href", "a"), F.col("value").alias("href"))


_ESCAPED = "replace(replace(replace(word, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_QUOTED = "CASE WHEN regexp_matches(href, '^[^ \\t\\n\\r\\f\"''=>`]+$') THEN href WHEN contains(href, '\"') AND NOT contains(href, '''') THEN '''' || replace(href, '&', '&amp;') || '''' ELSE '\"' || replace(replace(href, '&', '&amp;'), '\"', '&quot;') || '\"' END"


@_query(f"SELECT page_id, '<a href=' || {_QUOTED} || '>' || {_ESCAPED} || '</a>' AS html FROM {UNIQUE}")
def to_html_links(spark, sf_dir):
    nodes = nodes_of(spark, sf_dir)
    return _id(to_html(nodes, query(nodes, "a")), "html")


@_query(f"SELECT page_id, '<a href=''' || replace(replace(href, '&', '&amp;'), '''', '&#39;') || '''>' || {_ESCAPED} || '</a>' AS html FROM {UNIQUE}")
def to_html_quote(spark, sf_dir):
    nodes = nodes_of(spark, sf_dir)
    return _id(to_html(nodes, query(nodes, "a"), quote_char="'"), "html")


@_query("SELECT page_id, '<meta charset=utf-8 />' AS html FROM pages")
def to_html_solidus(spark, sf_dir):
    nodes = nodes_of(spark, sf_dir)
    return _id(to_html(nodes, query(nodes, "meta"), use_trailing_solidus=True), "html")


@_query()
def to_html_page(spark, sf_dir):
    return _id(to_html(nodes_of(spark, sf_dir)), "html")


@_query("SELECT page_id, 'utf-8' AS encoding, html AS text FROM pages")
def sniff_encoding_pages(spark, sf_dir):
    raw = pages_of(spark, sf_dir).select("page_id", F.encode("html", "utf-8").alias("data"))
    return decode(sniff_encoding(raw, "data"), "data", out="text").select("page_id", "encoding", "text")


@_query(f"SELECT page_id, CAST(count(*) AS BIGINT) AS n FROM {LINKS} GROUP BY page_id")
def fragment_li(spark, sf_dir):
    lists = pages_of(spark, sf_dir).select("page_id", F.regexp_extract("html", "(?s)<ul>(.*?)</ul>", 1).alias("html"))
    return _id(parse_html(lists, context="ul").where("depth = 0 AND tag = 'li'").groupBy("doc_id").agg(F.count("*").alias("n")), "n")


@_query(f"SELECT page_id, {_un(_between('<h1>', '</h1>'))} AS title FROM pages")
def unescape_titles(spark, sf_dir):
    return pages_of(spark, sf_dir).select("page_id", unescape_udf(F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1)).alias("title"))


@_query("SELECT page_id, 'en' AS lang FROM pages WHERE contains(html, '<html lang=\"en\">')")
def sql_lateral_parse(spark, sf_dir):
    register(spark)
    pages_of(spark, sf_dir).createOrReplaceTempView("domframe_pages")
    return spark.sql("SELECT page_id, n.attrs['lang'] AS lang FROM domframe_pages, LATERAL html_parse(html, CAST(NULL AS STRING)) n WHERE n.tag = 'html' AND n.attrs['lang'] = 'en'")


@_query(f"SELECT href, CAST(count(*) AS BIGINT) AS n FROM {UNIQUE} GROUP BY href ORDER BY n DESC, href LIMIT 20")
def link_freq_topk(spark, sf_dir):
    links = attribute(nodes_of(spark, sf_dir), "href", "a")
    return links.groupBy(F.col("value").alias("href")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "href").limit(20)


@_query("""SELECT lang, host, CAST(count(*) AS BIGINT) AS n FROM (SELECT regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages) GROUP BY ROLLUP (lang, host)""")
def pages_per_host_rollup(spark, sf_dir):
    langs = _id(query(nodes_of(spark, sf_dir), "html"), get_attr("lang").alias("lang"))
    hosts = pages_of(spark, sf_dir).select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))
    return langs.join(hosts, "page_id").rollup("lang", "host").agg(F.count("*").alias("n"))


@_query(f"SELECT page_id, tag, href FROM (SELECT page_id, 'a' AS tag, {HREF} AS href, k FROM {LINKS}) WHERE k = 0")
def query_one_all_documents(spark, sf_dir):
    """The first link of each page; pages that have none would have nulls."""
    return _id(query_one(nodes_of(spark, sf_dir), "nav a", all_documents=True), "tag", get_attr("href").alias("href"))


def _sql_function(name: str, call: str, sql: str) -> None:
    def run(spark, sf_dir):
        register(spark)
        pages_of(spark, sf_dir).createOrReplaceTempView("domframe_pages")
        return spark.sql(f"SELECT page_id, {call} FROM domframe_pages")

    run.__name__ = name
    _query(sql)(run)


_TITLE = _un(_between("<title>", "</title>"))
_sql_function("sql_html_query", "html_query(html, 'title')[0] AS title", "SELECT page_id, '<title>' || replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</title>' AS title FROM (SELECT page_id, " + _TITLE + " AS t FROM pages)")
_sql_function("sql_html_text", "html_text(html, 'title')[0] AS title, html_text(html, NULL)[0] AS page", f"SELECT page_id, {_TITLE} AS title, text AS page FROM pages JOIN (SELECT page_id AS p, text FROM ({ORACLES['text_page']})) ON p = page_id")
_sql_function("sql_html_attr", "html_attr(html, 'nav a', 'href')[0] AS href, html_attr(html, 'html', 'lang')[0] AS lang", f"SELECT page_id, href, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages JOIN (SELECT page_id AS p, {HREF} AS href, k FROM {LINKS}) ON p = page_id AND k = 0")
_sql_function("sql_html_to_html", "regexp_extract(html_to_html(html), '(?s)^<!DOCTYPE html><html lang=([^>]*)><head><meta charset=utf-8>', 1) AS lang", "SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages")


@_query(f"SELECT page_id, href FROM {UNIQUE}")
def sql_lateral_nodes(spark, sf_dir):
    """Rows of html_nodes are rows of the node table, so they can be queried."""
    register(spark)
    pages_of(spark, sf_dir).createOrReplaceTempView("domframe_pages")
    nodes = spark.sql("SELECT page_id AS doc_id, n.* FROM domframe_pages, LATERAL html_nodes(html, CAST(NULL AS STRING)) n")
    return _id(query(nodes, "nav a"), get_attr("href").alias("href"))


QUERIES |= case_queries.QUERIES
ORACLES |= case_queries.ORACLES
