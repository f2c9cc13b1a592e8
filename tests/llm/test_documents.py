"""Operators on documents against brute force, with nulls, empty and long texts, repeated rows and empty tables."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from domframe.llm import common, fingerprints, langid, minhash, pieces, queries, words

BASE = [f"word{k} other{k % 7}" for k in range(60)]


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def classes(rows, k, percent):
    sets = {}
    for d, t in rows:
        sets.setdefault(d, []).append(shingles(t, k))
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    return {d: top(d) for d in ids}


def near_rows():
    rng = np.random.default_rng(3)
    rows = []
    for k in range(12):
        own = [f"w{k}_{i}" for i in range(80)]
        for c in range(12):
            copy = list(own)
            for _ in range(int(rng.integers(0, 7))):
                copy[int(rng.integers(0, len(copy)))] = f"new{rng.integers(0, 10**6)}"
            rows.append((1000 - 17 * k * 12 - c * 3 if k % 2 else 5000 + k * 100 + c, " ".join(copy)))
    return rows + [(1, "a b"), (2, "A  B\n"), (3, "a b c"), (4, ""), (6, None), (7, " \t"), (8, "x"), (9, "X"), (10, "É x y z"), (11, "é x y z")]


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, k, percent):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("x"))
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df, k, percent).collect()}
    want = classes(rows, k, percent)
    assert {d: r["component_id"] for d, r in got.items()} == want
    assert all(r["kept"] == (d == want[d]) and r["n_shingles"] == len(shingles(dict(rows)[d], k)) for d, r in got.items())


@pytest.mark.parametrize(("size", "pivots"), [(3, 1), (2, 0), (5, 2)])
def test_near_duplicates_in_blocks_and_by_shuffle(spark, monkeypatch, size, pivots):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", size)
    monkeypatch.setattr(minhash, "PIVOTS", pivots)
    monkeypatch.setattr(minhash, "BROADCAST_MEMBERS", -1)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, 3, 85).collect()}
    assert got == classes(rows, 3, 85)


def test_large_groups_by_matrix():
    rng = np.random.default_rng(1)
    base = words.distinct(rng.integers(0, 2**63, 300).astype(np.uint64))
    sets = [words.distinct(np.concatenate([base[rng.random(300) > 0.02], rng.integers(0, 2**63, int(rng.integers(0, 40))).astype(np.uint64)])) for _ in range(60)]
    root = list(range(60))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for j in range(60):
        for i in range(j):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    assert minhash.linked(sets, 90) == [top(x) for x in range(60)]


def test_sketch_fills_every_coordinate_and_estimates():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for n in (1, 2, 10, 500):
        assert (minhash.sketch(words.distinct(pool[:n]), 128) != ~np.uint64(0)).all()
    a, b = words.distinct(pool[:2000]), words.distinct(pool[1000:])
    assert abs((minhash.sketch(a, 1024) == minhash.sketch(b, 1024)).mean() - 1 / 3) < 0.06


def test_near_duplicates_take_nulls_repeats_and_nothing(spark):
    rows = [(None, "same words here now"), (None, "lonely text of its own"), (5, "same words here now"), (5, "same words here now"), (7, "SAME words here now"), (None, None)]
    got = sorted(map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()), key=str)
    assert got == sorted([(None, 2, 5, False), (None, 3, None, True), (5, 2, 5, True), (5, 2, 5, True), (7, 2, 5, False), (None, 0, None, True)], key=str)
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(5, 9), (9, 3), (3, 5), (8, 8)] + [(2000, x) for x in range(2001, 2100)]
    got = {r["id"]: r["comp"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(100, 141), 100), **dict.fromkeys((3, 5, 9), 3), **dict.fromkeys(range(2000, 2100), 2000)}
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_words_cut_at_blanks_wherever_the_chunks_end(monkeypatch):
    texts = ["é " * 400, "", None, "x" * 900 + " y", " a\tb\x0bc ", "\x1c d"]
    want = [h.tolist() for h in words.shingles_of(texts, 2)]
    monkeypatch.setattr(words, "CHUNK", 64)
    assert [h.tolist() for h in words.shingles_of(texts, 2)] == want
    assert [len(words.distinct(np.array(h, np.uint64))) for h in want] == [len(shingles(t, 2)) for t in texts]


def test_neighbours_equal_brute_force(spark):
    texts = ["", None, "a", "ab", "one two three four five six", "é🙂 x", "y " * 3000, "one two three four five six"]
    rows = [(100 - k, t) for k, t in enumerate(texts)] + [(None, "nul"), (200, "tie b"), (200, "tie a")] + [(300 + k, f"text {k} " * (k % 9)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pid", F.lit("mine"))
    got = fingerprints.neighbours(df, parts=7).collect()
    assert len(got) == len(rows)
    by = {}
    for d, t in rows:
        by.setdefault(d, []).append(t or "")
    order = sorted((d for d in by if d is not None))
    fixed = {r["doc_id"]: r for r in got if len(by[r["doc_id"]]) == 1 and r["doc_id"] is not None}
    for k, d in enumerate(order):
        following = None if k + 1 == len(order) else order[k + 1]
        if d not in fixed or len(by[following]) > 1:
            continue
        t, n = by[d][0], by[following][0]
        half = len(t) // 2
        edited = t[:len(t) - half] + n[:half]
        assert (fixed[d]["n_chars"], fixed[d]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert abs(fixed[d]["near_edited"] - jaccard(shingles(t, 5), shingles(edited, 5))) < 0.15
        assert abs(fixed[d]["near_next"] - jaccard(shingles(t, 5), shingles(n, 5))) < 0.15
    assert fixed[96]["fingerprint"] == fixed[93]["fingerprint"] != ""
    plain = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(df).collect()}
    assert all(plain[d] == r["fingerprint"] for d, r in fixed.items())


def test_neighbours_of_few_rows(spark):
    assert fingerprints.neighbours(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = fingerprints.neighbours(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert (one["edited_sha256"], one["near_next"]) == (hashlib.sha256(b"abab").hexdigest(), 1.0)
    same = fingerprints.neighbours(spark.createDataFrame([(None, "x y")] * 50, "doc_id long, text string"), parts=5).collect()
    assert len(same) == 50


LANGS = {"aa": "ka lo mi tu ra", "bb": "schön ßtra über öde", "cc": "été où ça même"}


def language_rows(n=240):
    rng = np.random.default_rng(4)
    return [(k, " ".join(rng.choice(LANGS[lang].split(), int(rng.integers(1, 60)))), lang) for k in range(n) for lang in [list(LANGS)[k % 3]]]


def test_language_id_on_held_out_documents(spark):
    rows = language_rows() + [(900, None, "aa"), (901, "", None), (902, "12 + 3 !!", "bb"), (903, "ka lo " * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in langid.predict(df, langid.learn(df)).withColumn("out", langid.held_out(F.col("doc_id"))).collect()}
    assert all(r["out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    held = [r for r in got.values() if r["out"] and r["doc_id"] < 900]
    assert len(held) > 30
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97
    assert [got[d]["lang_pred"] for d in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_tabulated_network_equals_convolution():
    net = langid.train([(lang, t) for _, t, lang in language_rows(60)], epochs=1)
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    e = net.embed[x]
    pooled = np.concatenate([sum(e[:, k:k + langid.WINDOW - w + 1] @ f[k] for k in range(w)).max(axis=1) for w, f in zip(langid.WIDTHS, net.filters, strict=True)], axis=1)
    s = np.exp(pooled @ net.dense + net.bias)
    assert np.allclose(langid.Scorer(net).windows(x), s / s.sum(axis=1, keepdims=True), atol=1e-4)


def test_copies_of_a_text_are_drawn_once(spark):
    rows = [("aa", "copied text")] * 3000 + [("aa", f"text {k}") for k in range(300)] + [("bb", f"small {k}") for k in range(30)]
    got = langid.sample(spark.createDataFrame(rows, "lang string, text string"), rows=400)
    assert len(got) == len(set(got)) and len([1 for lang, _ in got if lang == "bb"]) == 30
    assert len([1 for lang, _ in got if lang == "aa"]) == 200


def test_language_id_without_labels(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert langid.predict(df, langid.learn(df)).first()["lang_pred"] == "und"
    empty = df.where("doc_id < 0")
    assert langid.predict(empty, langid.learn(empty)).collect() == []


CODED = ["", " ", "  a  b ", "Hello world", "\n\n x\ty\r\n", "日本語テスト 🙂🙂", "<s> </s> <unk> <0x0A>", "À" * 300, "ab" * 2000, "\x00\x01", "http://foo.bar/baz?x=1&y=2", " " * 70 + "x", "ﬁ ligature Ⅷ", "thethethe of ofof"]


def test_pieces_equal_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = CODED + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "k long, text string").withColumn("decoded", F.lit(1))
    got = {r["k"]: r for r in pieces.decode(pieces.encode(df)).collect()}
    for k, t in enumerate(texts):
        assert got[k]["ids"] == lib.encode(t), t
        assert got[k]["decoded"] == t
    assert (got[len(texts)]["ids"], got[len(texts)]["decoded"]) == ([], "")
    assert pieces.encode(df.where("k < 0")).collect() == []


def test_prefixes_are_shared_rightly():
    coder = pieces.Encoder(open(pieces.MODEL, "rb").read())
    rng = np.random.default_rng(6)
    some = sorted({"▁" * int(rng.integers(0, 3)) + "".join(rng.choice(list("thersngéß.x日"), int(rng.integers(1, 12)))) for _ in range(800)})
    for word, parts in coder.encode_words(some):
        assert parts == coder.merge(word)


def plain_mix(docs):
    """{row: copies} for rows (doc_id, text, source) by the docstring of mixing, in plain Python."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    draw = lambda d, t: int(hashlib.md5(f"mix:{'~' if d is None else d}{'' if d is not None else hashlib.md5((t or '~').encode()).hexdigest()}".encode()).hexdigest()[:13], 16) / 2**52
    sources = sorted({s for _, _, s in docs}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(size(t) for _, t, s in docs if s == name) for name in sources]
    weights, left, free, target = [1 + k % 3 for k in range(len(sources))], float(sum(sizes)), set(range(len(sources))), {}
    while free:
        level = left / sum(weights[k] for k in free)
        if not (over := [k for k in free if weights[k] * level > 3 * sizes[k]]):
            target |= {k: weights[k] * level for k in free}
            break
        for k in over:
            target[k] = 3.0 * sizes[k]
            left -= target[k]
            free.remove(k)
    out = {}
    for k, name in enumerate(sources):
        own = [(d, t) for d, t, s in docs if s == name]
        rate = target[k] / sizes[k] if sizes[k] else 0.0
        extra = target[k] - math.floor(rate) * sizes[k]
        places = {0: 0} | {step + 1: sum(size(t) for d, t in own if int(draw(d, t) * 4096) <= step) for step in {int(draw(d, t) * 4096) for d, t in own}}
        threshold = min(places, key=lambda p: (abs(places[p] - extra), p)) / 4096
        for d, t in own:
            out[d, t, name] = math.floor(rate) + (draw(d, t) < threshold)
    return out


def test_pipeline_equals_its_brute_force_version(spark, tmp_path):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = np.random.default_rng(8)
    rows = [(k, " ".join(rng.choice(LANGS[lang].split(), 60)), lang, f"s{k % 4}", 0) for k in range(120) for lang in [list(LANGS)[k % 3]]]
    rows += [(200 + k, rows[k][1] + " end", rows[k][2], "s9", 0) for k in range(20)] + [(300, None, None, None, None), (301, "", "aa", "s1", 0), (302, "42", "aa", "s1", 2), rows[3]]
    rows += [(310, "ka lo mi " * 40_000, "aa", "s2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("extra", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["source"], r["n_tokens"], r["round_trip"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    # The language stage keeps all texts with letters: these are of the languages learned.  One row of each group stays.
    speaking = {r[0]: r for r in rows if any(map(str.isalpha, r[1] or ""))}
    first = {d for d, c in classes([(d, r[1]) for d, r in speaking.items()], 5, 80).items() if c == d}
    assert not {200 + k for k in range(20)} & first
    copies = plain_mix([(d, speaking[d][1], speaking[d][3]) for d in first])
    want = sorted((d, s, len(lib.encode(t)), True) for (d, t, s), n in copies.items() for _ in range(n))
    assert got == want
    stage = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"] for r in corpus_pipeline.language_stage(spark, stage, str(tmp_path)).collect()} == set(speaking)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_have_a_result_for_repeats_and_nulls(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (4, "q r s t u v"), (4, "q r s t u v"), (None, "x y z"), (9, "X Y Z")]
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["text"].lower(), r["doc_id"]) for r in corpus_pipeline.near_duplicate_stage(spark, df, "").collect())
    assert [t for t, _ in got] == ["a b c d e f", "q r s t u v", "x y z"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.where("doc_id < 0"), "").collect() == []


SF = "/root/testdata/sf0.001"


def canon(rows):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_equal_their_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = df.select(*names).collect()
    assert got
    if name in queries.ORACLES:
        con = duckdb.connect()
        for table in ("documents", "embeddings", "pages", "labels", "conversations"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        assert canon(got) == canon(con.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLES[name]})").fetchall())


def test_edited_texts_equal_their_sql(spark):
    got = queries.op10_fingerprints(spark, SF).select("doc_id", "edited_sha256", "n_chars").collect()
    want = duckdb.sql(f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM '{SF}/documents.parquet'),
        o AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS following FROM t WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
        SELECT doc_id, sha256(substr(text, 1, length(text) - length(text) // 2) || substr(following, 1, length(text) // 2)) AS edited_sha256, length(text) AS n_chars FROM o""").fetchall()
    assert canon(got) == canon(want)


def test_language_query_equals_its_brute_force_version(spark, monkeypatch):
    """Convolution place by place over each whole text, with the network that the query learns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = langid.learn(docs)
    monkeypatch.setattr(langid, "learn", lambda docs: net)  # training twice may differ in the last digits
    got = {r["doc_id"]: r for r in queries.op7_language_id(spark, SF).collect()}
    rows = [r for r in docs.collect()][::3]
    for r in rows:
        text = r["text"]
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if text is None or not any(c.isalpha() for c in text):
            assert (got[r["doc_id"]]["lang_pred"], got[r["doc_id"]]["score"]) == ("und", 0.0)
            continue
        data, total = text.encode(), np.zeros(len(net.langs))
        for at in range(0, len(data), langid.WINDOW):
            part = data[at:at + langid.WINDOW]
            e = net.embed[np.frombuffer(part.ljust(langid.WINDOW, b"\0"), np.uint8)]
            best = [max(float((e[p:p + len(f)] * f[:, :, j]).sum()) for p in range(langid.WINDOW - len(f) + 1)) for f in net.filters for j in range(langid.FILTERS)] if at == 0 and len(data) < 400 else None
            pooled = np.array(best) if best else np.concatenate([sum(e[k:k + langid.WINDOW - len(f) + 1] @ f[k] for k in range(len(f))).max(axis=0) for f in net.filters])
            s = np.exp(pooled @ net.dense + net.bias - (pooled @ net.dense + net.bias).max())
            total += len(part) * s / s.sum()
        total /= len(data)
        assert got[r["doc_id"]]["score"] == pytest.approx(total.max(), abs=1e-3)
        if np.sort(total)[-1] - np.sort(total)[-2] > 1e-2:
            assert got[r["doc_id"]]["lang_pred"] == net.langs[int(total.argmax())]
    held = [r for r in docs.collect() if got[r["doc_id"]]["held_out"] and r["lang"]]
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.9


def test_training_looks_at_whole_stretches():
    """Two languages that differ only behind the third window of a stretch."""
    rng = np.random.default_rng(1)
    same = lambda: "".join(rng.choice(list("あいうえお"), 300))
    rows = [(lang, same() + "".join(rng.choice(list(letters), 400))) for lang, letters in (("x", "かきくけこ"), ("y", "まみむめも")) for _ in range(60)]
    scored = list(langid.Scorer(langid.train(rows)).texts(["".join(rng.choice(list("かきくけこ"), 200)), "".join(rng.choice(list("まみむめも"), 200))]))
    assert [lang for lang, _ in scored] == ["x", "y"]


def test_words_without_a_path_are_merged():
    coder = pieces.Encoder(open(pieces.MODEL, "rb").read())
    admits = coder.admits
    coder.admits = lambda left, right: coder.names[right] != "▁b" and admits(left, right)
    coder.pairs.clear()
    got = dict(coder.encode_words(["▁a", "▁b", "▁bb", "▁c"]))
    assert got == {w: coder.merge(w) for w in got} and len(got) == 4


def test_long_texts_and_repeats(spark):
    long = "word and more words " * 60_000
    rows = [(1, long), (2, long + "end"), (2, long + "end"), (3, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    near = sorted((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(df, 3, 85).collect())
    assert near == [(1, 1), (2, 2), (2, 2), (3, 3)]  # few different shingles, of which the ends are a large part
    done = sorted((r["doc_id"], r["decoded"] == r["text"]) for r in pieces.encode_and_decode(df).collect())
    assert done == [(1, True), (2, True), (2, True), (3, True)]
    prints = fingerprints.neighbours(df).collect()
    assert sorted((r["doc_id"], r["n_chars"]) for r in prints) == [(1, 1_200_000), (2, 1_200_003), (2, 1_200_003), (3, 5)]


def test_texts_of_middling_similarity_form_no_groups(spark):
    """Templated texts that share about half of their shingles meet in bands, but nothing links them, nor a chain of them."""
    rng = np.random.default_rng(31)
    frame = [f"t{k}" for k in range(70)]
    rows = [(k, " ".join(frame + [f"own{k}_{j}" for j in range(int(rng.integers(28, 60)))])) for k in range(500)]
    chain = [f"c{k}" for k in range(400)]
    rows += [(1000 + k, " ".join(chain[12 * k:12 * k + 120])) for k in range(24)]  # each like the next ones at .8 and less
    links = [f"l{k}" for k in range(400)]
    rows += [(2000 + k, " ".join(links[4 * k:4 * k + 120])) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, 3, 85).collect()}
    assert got == classes(rows, 3, 85)
    assert {got[2000 + k] for k in range(40)} == {2000}
    sketched = df.mapInArrow(minhash._sketcher(3, 128, minhash.rows_per_band(85, 128)), minhash.SKETCHES).withColumnRenamed("doc_id", "rep")
    grouped = minhash.candidate_groups(sketched, 85, 128)
    assert grouped.where("id < 500").count() < 50


def test_bands_of_many_texts_are_compared_in_blocks(spark, monkeypatch):
    rows = near_rows()
    monkeypatch.setattr(minhash, "BLOCK_SKETCHES", 4)
    for limit in (200_000, -1):
        monkeypatch.setattr(minhash, "BROADCAST_GROUPS", limit)
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
        assert got == classes(rows, 3, 85)
