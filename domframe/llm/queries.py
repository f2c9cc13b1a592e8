"""One query per operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, extraction, fingerprints, langid, minhash, mixing, pieces, urlfilter, vectors, warc
from .common import remove, table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def style_tree_unmarked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1 on the same pages with nothing that marks the article: a plain div in its place, and names without meaning."""
    pages = table(spark, sf_dir, "pages")
    bare = F.regexp_replace(F.regexp_replace("html", "<article>", "<div class=\"q7\">"), "</article>", "</div>")
    return extraction.extract(pages.withColumn("html", bare))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives say of each page; a record whose payload is not what its digest line says fails the query."""
    folder = warc.fresh_folder(spark)
    warc.write_warc(table(spark, sf_dir, "pages"), folder)
    r = warc.read_warc(spark, folder)
    remove(spark, folder)
    again = F.col("type") == "revisit"
    digest = F.when(again, F.col("told")).when(F.col("intact"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest: "), "id")))
    return r.select(F.expr("try_cast(id AS BIGINT)").alias("page_id"), F.when(again, F.col("http_length")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
                    digest.alias("payload_digest"), F.col("type").alias("record_type"), F.expr("try_cast(refers AS BIGINT)").alias("refers_to"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    known = pages.join(labels.select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("blocked")), "page_id").select("url", "blocked")
    return urlfilter.judge(pages, urlfilter.mine(known)).select("page_id", "host", "path", "rule", "verdict")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.learn(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_tokens, a hash of the ids, that of the text decoded from them, and whether it is the text."""
    done = pieces.encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_xxh64"), F.sha2("decoded", 256).alias("decoded_sha256"),
                       (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbours(table(spark, sf_dir, "documents"))


PROBE = "</s>[INST] ok [/INST]"


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    done = chat.format_chats(rows.unionByName(probe)).withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments")))
    whole = F.array_join(F.transform("back", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return done.select("conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                       F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")


QUERIES = {"op1_html_extraction": op1_html_extraction, "op2_warc": op2_warc, "op3_embeddings": op3_embeddings, "op4_mixing": op4_mixing, "op5_url_filters": op5_url_filters, "op6_minhash": op6_minhash, "op7_language_id": op7_language_id, "op8_chat": op8_chat, "op9_sentencepiece": op9_sentencepiece,
           "op10_fingerprints": op10_fingerprints, "style_tree_unmarked_pages": style_tree_unmarked_pages}


def _mixing_sql() -> str:
    return r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '~') || CASE WHEN doc_id IS NULL THEN md5(coalesce(text, '~')) ELSE '' END), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS cap, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS w FROM s),
o AS (SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS total_w, coalesce(sum(cap) OVER r, 0) AS cap_before, coalesce(sum(w) OVER r, 0) AS w_before
      FROM w WINDOW r AS (ORDER BY CAST(cap AS DOUBLE) / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap * (total_w - w_before) < w * (total - cap_before) AS is_full FROM o),
l AS (SELECT *, (total - coalesce(sum(cap) FILTER (is_full) OVER (), 0)) AS left_size, (total_w - coalesce(sum(w) FILTER (is_full) OVER (), 0)) AS left_w FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE) WHEN left_w > 0 THEN least(CAST(cap AS DOUBLE), CAST(w AS DOUBLE) * (CAST(left_size AS DOUBLE) / CAST(left_w AS DOUBLE))) ELSE 0.0 END AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t),
b AS (SELECT source, CAST(floor(draw * 4096) AS INTEGER) AS step, sum(size) AS words FROM d GROUP BY ALL),
q AS (SELECT source, step + 1 AS place, sum(words) OVER (PARTITION BY source ORDER BY step) AS below FROM b UNION ALL SELECT DISTINCT source, 0, 0 FROM b),
h AS (SELECT r.*, arg_min(place, (abs(CAST(below AS DOUBLE) - (target - floor(rate) * source_size)), place)) OVER (PARTITION BY r.source) / 4096.0 AS threshold, row_number() OVER (PARTITION BY r.source) AS k FROM q JOIN r ON q.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, size * (CAST(floor(rate) AS BIGINT) + CASE WHEN draw < threshold THEN 1 ELSE 0 END) AS taken FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source AND h.k = 1"""


def _warc_sql() -> str:
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digits = " || ".join(f"substr('{alphabet}', 1 + ((CAST('0x' || substr(h, {1 + 5 * k}, 5) AS BIGINT) >> {s}) & 31), 1)" for k in range(8) for s in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h, body) AS lead_id FROM p)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, {digits} AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM lead_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM lead_id THEN NULL ELSE lead_id END AS refers_to FROM f"""


def _chat_sql() -> str:
    inner = r"([<\[])(\\*)(" + "|".join(re_escape(m[1:]) for m in chat.control_strings()) + ")"
    marks = "CASE role " + " ".join(f"WHEN '{r}' THEN {len(o) + len(c)}" for r, (o, c, _) in chat.TEMPLATE.items()) + f" ELSE {sum(map(len, chat.OTHER))} + length(regexp_replace(role, '{inner}', '\\1\\2\\\\\\3', 'g')) END"
    legal = "','".join(chat.MOVES)
    return rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
o AS (SELECT *, coalesce(lag(role) OVER w, 'start') AS prev, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
             {marks} + length(regexp_replace(text, '{inner}', '\1\2\\\3', 'g')) AS chars FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars,
       bool_and(prev || '>' || role IN ('{legal}')) AND max(role) FILTER (k = n) = 'assistant' AS valid
FROM o GROUP BY conv_id"""


def _extraction_sql() -> str:
    """The generated pages mark their article and have only h1, p, b and br in it."""
    bare = "regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g')"
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        bare = f"replace({bare}, '&{name};', '{char}')"
    return f"SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM (SELECT page_id, url, trim(regexp_replace({bare}, '[\t\n\x0B\f\r ]+', ' ', 'g')) AS text FROM pages)"


def _components_sql(nodes: str, key: str) -> str:
    """Further parts of a WITH RECURSIVE that has links (a, b) both ways: comp (id, component), the least id within reach."""
    return f"reach(id, seen) AS (SELECT {key}, {key} FROM {nodes} UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.seen), comp AS (SELECT id, min(seen) AS component FROM reach GROUP BY id)"


def _embeddings_sql() -> str:
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]) AND list_bool_or([x <> 0 FOR x IN embedding])),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.e) = len(q.e) WHERE list_cosine_similarity(p.e, q.e) >= 0.98),
{_components_sql("embeddings", "vec_id")}
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component AS component_id, component = vec_id AS kept FROM embeddings JOIN comp ON id = vec_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON a = vec_id"""


def _minhash_sql() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
{_components_sql("documents", "doc_id")}
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component AS component_id, component = d.doc_id AS kept FROM documents d JOIN comp ON id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


def re_escape(text: str) -> str:
    return "".join(f"\\{c}" if c in "[]|" else c for c in text)


ORACLES = {"op1_html_extraction": _extraction_sql(), "style_tree_unmarked_pages": _extraction_sql(), "op3_embeddings": _embeddings_sql(), "op6_minhash": _minhash_sql(), "op2_warc": _warc_sql(), "op4_mixing": _mixing_sql(), "op8_chat": _chat_sql()}
