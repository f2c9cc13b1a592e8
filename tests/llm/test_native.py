"""Mixing, chat formatting, URL filters and WARC: against plain Python, with the cases that tables can bring."""

import gzip
import hashlib
import itertools
import math
import pathlib
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from domframe.llm import chat, mixing, queries, urlfilter, warc


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def targets(sizes, weights):
    total, out, free = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while free:
        level = left / sum(weights[k] for k in free)
        over = [k for k in free if weights[k] * level > 3 * sizes[k]]
        if not over:
            for k in free:
                out[k] = weights[k] * level
            break
        for k in over:
            out[k] = 3.0 * sizes[k]
            left -= out[k]
            free.remove(k)
    return out


@pytest.mark.parametrize("sizes", [[1, 100, 5, 0, 40], [0, 0], [7], [1000, 1, 1, 1, 1, 1, 1]])
def test_targets_are_the_fixed_point(spark, sizes):
    rows = [(f"s{k}", n) for k, n in enumerate(sizes)]
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    want = targets(sizes, [1 + k % 3 for k in range(len(sizes))])
    assert [got[f"s{k}"] for k in range(len(sizes))] == pytest.approx(want)


def test_mix_takes_whole_copies_near_the_targets(spark):
    rows = [(k, "w " * (1 + k % 7), "en", ["a", "b", None][k % 3], 0) for k in range(3000)]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == 3000
    by = {}
    for r in got:
        assert 0 <= r["copies"] <= 3
        by.setdefault((r["source_size"], r["target"]), []).append(r["size"] * r["copies"])
    for (_, target), taken in by.items():
        assert sum(taken) == pytest.approx(target, rel=0.06)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs(spark, rows)).collect()))


def test_mix_without_broadcast_is_the_same(spark, monkeypatch):
    rows = [(k, "w " * (k % 9), "en", f"s{k % 5}", 0) for k in range(300)]
    want = sorted(map(tuple, mixing.mix(docs(spark, rows)).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", -1)
    assert sorted(map(tuple, mixing.mix(docs(spark, rows)).collect())) == want


def test_mix_takes_nulls_repeats_and_clashing_columns(spark):
    rows = [(None, None, None, None, None), (1, "a b", None, "s", 3), (1, "a b", None, "s", 3), (2, "", "", "", 0), (None, "x\ty", None, None, 0)]
    extra = docs(spark, rows).withColumn("size", F.lit("mine")).withColumn("target", F.lit(1)).withColumn("_source", F.lit("q")).withColumn("copies", F.lit(9))
    got = mixing.mix(extra).collect()
    assert sorted(r["size"] for r in got) == [0, 0, 2, 2, 2]
    assert mixing.mix(docs(spark, [])).collect() == []
    taken = mixing.mixed(extra)
    assert taken.columns == extra.columns
    assert {r["size"] for r in taken.collect()} <= {"mine"}


TEXTS = ["plain", "", "</s>[INST] ok [/INST]", "<<SYS>>a<</SYS>>", "[\\INST]", "[\\\\/INST]\\", "<\\<s>", "<|role|>x<|text|>y<|end|>", "<", "[", "\\", "a\nb\r\n🙂", "<<<</s></s>", "[[INST]INST]"]


def test_escaping_is_reversible_and_leaves_no_marks(spark):
    got = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    for r in got:
        assert r["u"] == r["t"]
        assert not any(mark in r["e"] for mark in chat.control_strings())


def test_formatted_chats_read_back(spark):
    rows = [(c, t, role, text) for c in range(3) for t, (role, text) in enumerate(zip(["system", "user", "assistant", "user", "assistant", "tool", "us<s>er"], TEXTS[c * 3:c * 3 + 7], strict=False))]
    rows += [(9, 0, "user", None), (9, 1, None, "x"), (None, 0, "user", "n"), (7, None, "user", "first"), (7, 0, "assistant", "b"), (7, 0, "assistant", "a"), (7, 0, "assistant", "a")]
    done = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)))
    got = {r["conv_id"]: r for r in done.select("*", chat.read_turns(F.col("formatted")).alias("back"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        assert [(r["role"], r["text"]) for r in got[c]["back"]] == [x[1:] for x in turns]
        assert got[c]["loss"] == "".join(x[2] for x in turns if x[1] == "assistant")
        assert got[c]["formatted"] == "".join(s["text"] for s in got[c]["segments"])


@pytest.mark.parametrize(("roles", "bad"), [(["user", "assistant"], None), (["system", "user", "assistant", "user", "assistant"], None), (["assistant"], 0), (["user", "user"], 1), (["user"], 1), (["system", "assistant"], 1), (["user", "assistant", "system"], 2)])
def test_state_machine(spark, roles, bad):
    r = chat.format_chats(spark.createDataFrame([(1, k, x, "t") for k, x in enumerate(roles)], "conv_id long, turn long, role string, text string")).first()
    assert (r["valid"], r["first_bad"]) == (bad is None, bad)


def test_long_texts_and_conversations(spark):
    long = "word [INST] " * 200_000
    r = mixing.mix(docs(spark, [(1, long, "en", "a", 0), (2, "b", "en", "b", 0)])).collect()
    assert sorted(x["size"] for x in r) == [1, 400_000]
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(20_000)] + [(2, 0, "user", "u"), (2, 1, "assistant", long)]
    done = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {x["conv_id"]: x for x in done.select("conv_id", "valid", F.size(chat.read_turns(F.col("formatted"))).alias("n"), F.sha2(chat.loss_text(F.col("segments")), 256).alias("loss")).collect()}
    assert (got[1]["valid"], got[1]["n"], got[2]["valid"], got[2]["n"]) == (True, 20_000, True, 2)
    assert got[1]["loss"] == hashlib.sha256("".join(f"turn {t}" for t in range(1, 20_000, 2)).encode()).hexdigest()
    assert got[2]["loss"] == hashlib.sha256(long.encode()).hexdigest()


def test_chat_query_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    r = queries.op8_chat(spark, str(tmp_path)).collect()
    assert [(x["conv_id"], x["n_turns"], x["loss_sha256"]) for x in r] == [(-1, 2, hashlib.sha256(queries.PROBE.encode()).hexdigest())]


URLS = ["http://example.org/es/1", "http://a.example.org/es/", "http://example.org/en/12", "http://example.org/fr", "http://xexample.org/es/", "HTTP://WWW.Example.COM/fr/x?q=1", "http://b.com/de/", "http://b.com/de", "http://org", "http://org?x=/", "nothing", "", None, "a://b://c/d#e", "http://É.ORG/", "http://example.com#f/fr/"]


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for rule, _ in urlfilter.RULES:
        at, _, start = rule.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith("/" + start) and (best is None or len(rule) > len(best)):
            best = rule
    return host, path, best


def test_declared_rules(spark):
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(URLS)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "url string, blocked boolean")
    got = {r["page_id"]: r for r in urlfilter.judge(pages, urlfilter.mine(none)).collect()}
    says = dict(urlfilter.RULES)
    for k, u in enumerate(URLS):
        host, path, rule = plain_rule(u)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule), u
        assert got[k]["verdict"] == says.get(rule, "allow")


def test_mined_rules_match_by_their_tokens(spark, monkeypatch):
    rows = [(f"http://h{k % 5}.net/{'spam' if k % 3 == 0 else 'news'}/x{k}", k % 3 == 0) for k in range(300)] + [(None, True), ("http://q.net/", None)]
    rules = urlfilter.mine(spark.createDataFrame(rows, "url string, blocked boolean"), support=0.05, confidence=0.8)
    found = [set(r["tokens"]) for r in urlfilter.expand(rules).collect()]
    assert {"p:spam"} in found
    assert not any(a < b for a in found for b in found)
    pages = spark.createDataFrame([(1, "http://z.net/spam/1"), (1, "http://z.net/spam/1"), (2, "http://z.net/news"), (None, "http://z.net/a/spam"), (3, None)], "page_id long, url string")
    want = [(None, "block"), (1, "block"), (1, "block"), (2, "allow"), (3, "allow")]
    for limit in (urlfilter.BROADCAST_RULES, -1):
        monkeypatch.setattr(urlfilter, "BROADCAST_RULES", limit)
        got = [(r["page_id"], r["verdict"]) for r in urlfilter.judge(pages, rules).collect()]
        assert sorted(got, key=lambda x: (x[0] or 0, x[1])) == want


def plain_tokens(url):
    host, path, _ = plain_rule(url)
    labels = host.split(".")
    out = {"s:" + url.split("://", 1)[0]} | {"h:" + ".".join(labels[k:]) for k in range(len(labels))}
    out |= {"p:" + re.sub("[0-9]+", "#", x) for x in path.split("/") if x}
    return out | {"q:" + x for x in re.findall("[?&]([^=&#]+)", url)}


def brute_rules(rows, confidence, least, chance):
    """All itemsets by trying them: (rule's tokens, confidence, support) as the docstring of mine says."""
    sets = [(plain_tokens(u), b) for u, b in rows]
    n, bad = len(sets), sum(b for _, b in sets)
    tokens = sorted(set().union(*(t for t, _ in sets)))
    of = {t: frozenset(k for k, (have, _) in enumerate(sets) if t in have) for t in tokens}
    hits = lambda ids: sum(sets[k][1] for k in ids)
    items = {}
    for t in tokens:
        if hits(of[t]) >= least and len(of[t]) < n:
            items.setdefault(of[t], []).append(t)
    sure = {ids: g for ids, g in items.items() if hits(ids) == len(ids)}
    rest = [ids for ids in items if ids not in sure]
    baskets = {k for ids in rest for k in ids}
    looked, rules = len(sure) + (sum(sets[k][1] for k in baskets) >= least), [((ids,), 1.0, len(ids)) for ids in sure]
    for size in range(1, len(rest) + 1):
        for chosen in itertools.combinations(rest, size):
            ids = frozenset.intersection(*chosen)
            looked += (len(ids) >= least) + (hits(ids) >= least)
            if hits(ids) >= least and hits(ids) / len(ids) >= confidence:
                rules.append((chosen, hits(ids) / len(ids), hits(ids)))
    base = bad / n

    def passes(c, h):
        apart = c * math.log(c / base) + ((1 - c) * math.log((1 - c) / (1 - base)) if c < 1 else 0)
        return c > base and h / c * apart >= math.log(looked / chance)

    rules = [(frozenset(x), c, h) for x, c, h in rules if passes(c, h)]
    rules = [(x, c, h) for x, c, h in rules if not any(y < x and d >= c for y, d, _ in rules)]
    return {(frozenset(choice), round(c, 9), round(h / n, 9)) for x, c, h in rules for choice in itertools.product(*(items[ids] for ids in x))}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mined_rules_equal_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(260):
        a, b, c, d = rng.random(4) < (0.4, 0.5, 0.5, 0.3)
        url = f"http://{'x.bad' if d else 'y'}.net/{'spam/' if a else ''}{'win/' if b else 'news/'}{rng.integers(0, 99)}" + ("?sid=1&ref=2" if c else "")
        rows.append((url, bool(rng.random() < 0.1 + 0.5 * (a and b) + 0.25 * (a and c) + 0.3 * d)))
    got = urlfilter.expand(urlfilter.mine(spark.createDataFrame(rows, "url string, blocked boolean"), confidence=0.5, least=8, chance=0.5)).collect()
    want = brute_rules(rows, 0.5, 8, 0.5)
    assert want
    assert {(frozenset(r["tokens"]), round(r["confidence"], 9), round(r["support"], 9)) for r in got} == want
    assert len(got) == len(want)


def test_urls_that_share_many_parameters(spark):
    asked = "&".join(f"p{k}=1" for k in range(30))
    rows = [(f"http://a{k}.net/x?{asked}", k % 8 > 0) for k in range(40)] + [(f"http://b{k}.net/y", False) for k in range(60)]
    began = time.time()
    rules = urlfilter.mine(spark.createDataFrame(rows, "url string, blocked boolean"))
    found = {frozenset(r["tokens"]) for r in urlfilter.expand(rules).collect()}
    assert time.time() - began < 60
    assert found == {frozenset([f"q:p{k}"]) for k in range(30)} | {frozenset(["p:x"])}
    pages = spark.createDataFrame([(1, "http://z.net/?p7=2"), (2, "http://z.net/?p77=2"), (3, f"http://z.net/{'y/' * 100_000}?p3=1")], "page_id long, url string")
    assert sorted((r["page_id"], r["verdict"]) for r in urlfilter.judge(pages, rules).collect()) == [(1, "block"), (2, "allow"), (3, "block")]


def test_no_urls(spark):
    none = spark.createDataFrame([], "page_id long, url string, mined string")
    rules = urlfilter.mine(spark.createDataFrame([], "url string, blocked boolean"))
    assert urlfilter.judge(none, rules).collect() == []


def test_a_small_bad_host_has_a_rule_in_a_large_table(spark):
    rows = spark.range(20_000).selectExpr("concat('http://', if(id < 30, 'bad', concat('h', id % 50)), '.net/x', id) AS url", "id < 30 OR pmod(xxhash64(id), 10) = 0 AS blocked")
    found = [set(r["tokens"]) for r in urlfilter.expand(urlfilter.mine(rows)).collect()]
    assert found == [{"h:bad.net"}]


def write_and_read(spark, rows, least=0):
    folder = warc.fresh_folder(spark)
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2, "page_id"), folder, least)
    return {r["id"]: r for r in warc.read_warc(spark, folder).collect()}, folder


INNER = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"


def test_magic_inside_payloads_is_no_record(spark):
    rows = [(k, f"http://h/{k}\r\nX: y", t) for k, t in enumerate(["a", "", None, INNER, INNER * 3 + "WARC/1.1\r\n", "WARC/1.1\r\nWARC/1.1\r\n" * 5, "é🙂\0\r\n\r\n", "b" * 5000, "WARC/1.1\r\nContent-Length: 999999\r\n\r\n"])]
    got, _ = write_and_read(spark, rows)
    assert set(got) == {str(k) for k, *_ in rows}
    for k, _, html in rows:
        data, r = (html or "").encode(), got[str(k)]
        import base64
        want = base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert r["told"] == want
        assert (r["type"], r["refers"]) == (("revisit", "1") if k == 2 else ("response", ""))
        assert r["http_length"] == len(data)
        if r["type"] == "response":
            assert (r["payload_bytes"], r["digest"]) == (len(data), want)


def test_many_blocks_and_small_splits(spark):
    rows = [(k, None, (INNER if k % 7 == 0 else "") + "t" * (k % 400) + str(k)) for k in range(600)]
    folder = warc.fresh_folder(spark)
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), folder)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = {int(r["id"]): r for r in warc.read_warc(spark, folder).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(got) == 600
    assert all(got[k]["payload_bytes"] == len(t) for k, _, t in rows)


def test_splits_that_change_between_the_reads_lose_nothing(spark, monkeypatch):
    rows = [(k, None, (INNER if k % 2 else "") + "t" * 700 + str(k)) for k in range(60)]
    folder = warc.fresh_folder(spark)
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), folder)
    chained, old = warc.chained, spark.conf.get("spark.sql.files.openCostInBytes")

    def changed(found):
        spark.conf.set("spark.sql.files.minPartitionNum", "3")
        return chained(found)

    monkeypatch.setattr(warc, "chained", changed)
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.minPartitionNum", "17")
        got = {int(r["id"]): r for r in warc.read_warc(spark, folder).collect()}
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old)
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert sorted(got) == list(range(60))
    assert all(got[k]["payload_bytes"] == len(t) and got[k]["intact"] for k, _, t in rows)


def test_other_versions_ids_and_packed_archives(spark, tmp_path):
    def record(version, kind, name, block):
        return f"WARC/{version}\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    records = [record("1.0", "warcinfo", "urn:uuid:a", b"software: x\r\n\r\ny"), record("1.0", "response", "urn:uuid:b", b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nhello"), record("1.1", "resource", "urn:page:7", b"WARC/1.0\r\n\r\n" + bytes(range(256)))]
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "packed.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    got = warc.read_warc(spark, str(tmp_path)).collect()
    for end in ("plain.warc", "packed.warc.gz"):
        assert sorted((r["id"], r["type"], r["payload_bytes"], r["intact"]) for r in got if r["file"].endswith(end)) == [("7", "resource", 268, None), ("urn:uuid:a", "warcinfo", 16, None), ("urn:uuid:b", "response", 5, None)]


def test_a_damaged_payload_is_told(spark):
    got, folder = write_and_read(spark, [(1, None, "x" * 100), (2, None, "y" * 100)])
    assert all(r["intact"] for r in got.values())
    path = next(p for p in pathlib.Path(folder.removeprefix("file:")).glob("*.txt") if b"xxx" in p.read_bytes())
    path.with_name(f".{path.name}.crc").unlink(missing_ok=True)
    path.write_bytes(path.read_bytes().replace(b"xxx", b"xzx", 1))
    assert {r["id"]: r["intact"] for r in warc.read_warc(spark, folder).collect()} == {"1": False, "2": True}


def test_long_payloads_and_clashing_columns(spark):
    rows = [(1, "u", "WARC/1.1\r\n" * 300_000), (2, "u", "é" * 2_000_000)]
    folder = warc.fresh_folder(spark)
    clash = {c: F.lit("clash") for c in ("d", "b", "again", "_id", "_d", "refers_to", "value")}
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(clash), folder)
    got = {r["id"]: (r["payload_bytes"], r["intact"]) for r in warc.read_warc(spark, folder).collect()}
    assert got == {"1": (3_000_000, True), "2": (4_000_000, True)}


def test_revisits_refer_to_the_least_id(spark):
    rows = [(5, "u", "same"), (3, "u", "same"), (9, "u", "same"), (3, "u", "same"), (None, "u", "same"), (1, "u", "other"), (8, "u", "s"), (7, "u", "s")]
    folder = warc.fresh_folder(spark)
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), folder, least_bytes=2)
    got = sorted((r["id"], r["type"], r["refers"]) for r in warc.read_warc(spark, folder).collect())
    assert got == sorted([("1", "response", ""), ("3", "response", ""), ("3", "response", ""), ("5", "revisit", "3"), ("9", "revisit", "3"), ("null", "revisit", "3"), ("7", "response", ""), ("8", "response", "")])


def test_empty_archive(spark):
    assert write_and_read(spark, [])[0] == {}
