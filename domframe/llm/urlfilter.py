"""URL filtering: a list of declared rules first, then association rules that FP-growth mines from labelled urls.

A url's tokens are its scheme, host suffixes, path segments (numbers as #) and names of query parameters.
Mined rules are sets of tokens that imply a block with enough confidence and support; those with a rule of
fewer tokens inside them are pruned.  Tokens that occur in the same labelled rows are one item for FP-growth, and any
of them will do in a rule, so urls with many parameters in common don't multiply the itemsets.  A url is matched
through an index from the tokens of each rule's rarest item.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (rule as host/path, verdict), the policy that goes before the mined rules.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Up to so many rows the rules' index, or the items' tokens, is broadcast (about 20 MB); beyond, it is joined by shuffle.
BROADCAST_RULES = 100_000
#: Parts into which the urls with one token are dealt when the index is not broadcast.
SALTS = 64
MINED = "rule_id long, tokens array<array<string>>, confidence double, support double"
BLOCKED = "=block"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a url; empty for null."""
    labels = F.split(host_of(url), "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.lit("h:"), F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")))
    segments = F.transform(F.filter(F.split(path_of(url), "/"), lambda s: s != ""), lambda s: F.concat(F.lit("p:"), F.regexp_replace(s, "[0-9]+", "#")))
    asked = F.transform(F.regexp_extract_all(url, F.lit("[?&]([^=&#]+)"), F.lit(1)), lambda s: F.concat(F.lit("q:"), s))
    scheme = F.array(F.concat(F.lit("s:"), F.substring_index(url, "://", 1)))
    return F.coalesce(F.array_distinct(F.concat(scheme, suffixes, segments, asked)), F.array().cast("array<string>"))


def mine(labelled: DataFrame, support: float = 0.0, confidence: float = 0.6, least: int = 20, chance: float = 0.01) -> DataFrame:
    """Rules (rule_id, tokens, confidence, support) from (url, blocked): tokens has lists, one token of each of which together imply a block.

    Rows with a null url or label teach nothing.  A rule goes if another one's items are a part of its own and
    its confidence is no lower.  Every labelled row counts; a rule needs least blocked rows, however
    many rows there are (and the share support of them, if given), and to be no chance find: that any of the itemsets
    looked at has so many blocked rows, if urls didn't matter, must be less likely than chance (Chernoff's bound).
    Left out of the itemsets are tokens that can't be in a rule: of too few blocked rows, or of all rows.  A token of
    blocked rows only is a rule by itself, and no rule with others has more confidence.
    """
    known = labelled.where("url IS NOT NULL AND blocked IS NOT NULL").select(tokens_of(F.col("url")).alias("tokens"), "blocked")
    known = cut(known.withColumn("row", F.monotonically_increasing_id()))
    rows, bad = known.agg(F.count("*"), F.count_if("blocked")).first()
    floor = max(math.ceil(support * rows), least)
    if bad < floor or bad == rows:
        return labelled.sparkSession.createDataFrame([], MINED)
    base = bad / rows
    each = known.select("row", "blocked", F.explode("tokens").alias("token"))
    which = [F.sum(F.xxhash64(F.lit(k), "row").cast("decimal(38,0)")).alias(f"h{k}") for k in (1, 2)]  # equal for tokens of the same rows
    seen = each.groupBy("token").agg(F.count("*").alias("n"), F.count_if("blocked").alias("hits"), *which).where((F.col("hits") >= floor) & (F.col("n") < rows))
    items = cut(seen.groupBy("n", "hits", "h1", "h2").agg(F.sort_array(F.collect_list("token")).alias("tokens")).select(F.col("tokens")[0].alias("item"), "tokens", "n", "hits"))
    sure = items.where("n = hits").select(F.array("item").alias("items"), F.lit(1.0).alias("confidence"), F.col("hits"))
    item_of = items.where("n > hits").select("item", F.explode("tokens").alias("token"))
    if item_of.count() <= BROADCAST_RULES:
        item_of = F.broadcast(item_of)
    baskets = each.join(item_of, "token").groupBy("row").agg(F.collect_set("item").alias("items"), F.first("blocked").alias("blocked"))
    baskets = cut(baskets.select(F.when(F.col("blocked"), F.concat("items", F.array(F.lit(BLOCKED)))).otherwise(F.col("items")).alias("items")))
    count, looked, rules = baskets.count(), sure.count(), sure
    if count:
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, (floor - 0.5) / count), minConfidence=confidence).fit(baskets)
        found = model.associationRules.where(F.col("consequent")[0] == BLOCKED)
        rules = sure.unionByName(found.select(F.array_sort("antecedent").alias("items"), "confidence", F.round(F.col("support") * count).cast("long").alias("hits")))
        looked += model.freqItemsets.count()
    # rows with the tokens x divergence of the confidence from the share of blocked rows bounds -log of the probability
    c = F.col("confidence")
    apart = c * F.log(c / base) + F.when(c < 1, (1 - c) * F.log((1 - c) / (1 - base))).otherwise(0.0)
    rules = cut(rules.where((c > base) & (F.col("hits") / c * apart >= math.log(max(1, looked) / chance))).withColumn("rule_id", F.xxhash64("items")))
    # Every rule stands under its rarest item, and each looks up those whose items are all among its own.
    often = rules.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("c"))
    under = rules.select("rule_id", F.col("items").alias("fewer"), F.col("confidence").alias("less"), F.explode("items").alias("item")).join(often, "item")
    under = under.groupBy("rule_id").agg(F.min_by(F.struct("item", "fewer", "less"), F.struct("c", "item")).alias("x")).select("x.*")
    met = rules.select("rule_id", "items", F.col("confidence").alias("own"), F.explode("items").alias("item")).join(under, "item")
    idle = met.where((F.size("fewer") < F.size("items")) & (F.size(F.array_except("fewer", "items")) == 0) & (F.col("less") >= F.col("own"))).select("rule_id").distinct()
    kept = rules.join(idle, "rule_id", "left_anti").select("rule_id", "confidence", (F.col("hits") / rows).alias("support"), F.explode("items").alias("item"))
    named = kept.join(items.select("item", "tokens"), "item").groupBy("rule_id").agg(F.sort_array(F.collect_list("tokens")).alias("tokens"), F.first("confidence").alias("confidence"), F.first("support").alias("support"))
    return named.select("rule_id", "tokens", "confidence", "support")


def expand(rules: DataFrame) -> DataFrame:
    """The rules as sets of tokens, one of each list: as many rows as there are choices, to look at."""
    product = F.aggregate("tokens", F.array(F.array().cast("array<string>")), lambda sets, g: F.flatten(F.transform(sets, lambda x: F.transform(g, lambda t: F.concat(x, F.array(t))))))
    return rules.withColumn("tokens", F.explode(product))


def index(rules: DataFrame) -> DataFrame:
    """(token, rule_id, tokens, confidence): every rule under the tokens of the one of its lists that fewest rules hold."""
    each = rules.select("rule_id", "tokens", "confidence", F.explode("tokens").alias("any"))
    often = each.groupBy("any").agg(F.count("*").alias("n"))
    rarest = each.join(often, "any").groupBy("rule_id").agg(F.min_by(F.struct("any", "tokens", "confidence"), F.struct("n", "any")).alias("x"))
    return rarest.select(F.explode("x.any").alias("token"), "rule_id", "x.tokens", "x.confidence")


def declared(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest declared rule that fits, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        at, slash, start = text.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(slash + start))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, rules: DataFrame, declared_rules: Sequence[tuple[str, str]] = RULES, key: str = "page_id") -> DataFrame:
    """key, host, path, rule, verdict and mined (how many mined rules fit) per row; a url that no rule fits is allowed.

    Null urls, and urls without ://, have empty host and path.  Repeated rows and null keys each keep their row:
    the index is asked once per distinct url.
    """
    look = cut(index(rules))
    entries = look.count()
    asked = pages.where("url IS NOT NULL").select("url").distinct().select("url", tokens_of(F.col("url")).alias("have")).withColumn("token", F.explode("have"))
    if entries <= BROADCAST_RULES:
        both = asked.join(F.broadcast(look), "token")
    else:
        dealt = asked.withColumn("_salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int"))
        both = dealt.join(look.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["token", "_salt"])
    hits = both.where(F.forall("tokens", lambda g: F.arrays_overlap(g, F.col("have"))))
    mined = hits.groupBy("url").agg(F.countDistinct("rule_id").alias("mined"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, says = declared(F.col("host"), F.col("path"), declared_rules)
    rows = pages.select(key, "url", host.alias("host"), path.alias("path")).withColumn("rule", rule).withColumn("_says", says)
    verdict = F.coalesce("_says", F.when(F.coalesce("mined", F.lit(0)) > 0, "block").otherwise("allow"))
    judged = rows.join(mined, "url", "left") if entries else rows.withColumn("mined", F.lit(0).cast("long"))  # without rules there is nothing to look up
    return judged.select(key, "host", "path", "rule", verdict.alias("verdict"), F.coalesce("mined", F.lit(0)).alias("mined"))
