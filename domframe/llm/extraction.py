"""Main text of web pages by a site style tree.

Pages are parsed, and those of a host are merged by the path of their elements (tag, role, classes, id).  For every
path the entropy of what its elements hold on the host's pages, and of how their children are laid out, says how
important the branch is: a branch that is the same on every page is template.  Blocks are told apart by what they
hold as well, wherever they stand among their siblings: one that most of the host's pages have in the same branch is
template.  Pages with the same text count once, so copies of an article are no template.  Unimportant branches go
from each page, and with them what the markup itself calls something else than text: menus, forms, scripts and
the like by their tags and roles, adverts, notices and reader comments, which differ from page to page, by
a whole name of theirs.  Where a page marks its article, the text is taken from there.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import zlib
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..parser.builder import parse
from .common import cut

#: Share of the content's importance in that of a branch; the rest is its layout's.
CONTENT_SHARE = 0.8
#: Branches below this importance are template.
LOW = 0.3
#: A block is template if more than this share of the other pages that show its parent's branch have it.
MOST = 0.5
#: Pages of full importance that every branch, and pages without it that every block, is credited with: few pages prove little.
DOUBT = 1
#: Up to so many branches (or totals of branches) the tree of all hosts is sent to every task (about 20 MB); beyond, it is joined by shuffle.
BROADCAST_BRANCHES = 500_000
#: Parts into which the pages of one host are dealt when that table is not broadcast.
SALTS = 64

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr img input".split())
#: Parts of running text; without class, id or role only what they hold tells them apart, and inline elements are never told apart.
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre tr td th tbody thead tfoot caption figcaption hgroup html body br hr".split())
NOISE_TAGS = frozenset("""head nav footer aside form button select dialog menu audio video canvas datalist
script style textarea title iframe noembed noframes noscript template svg object""".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of names, and words that may stand beside them in a name: comments-area is noise, social-science and with-sidebar are not.
NOISE_WORDS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay
newsletter subscribe subscription social share sharing nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars widget widgets related recommended
comment comments commentlist reply replies respond disqus footer masthead pagination pager login signup search toolbar topbar""".split())
BESIDE_WORDS = frozenset("""area bar block body bottom box btn button buttons center col column container content custom desktop element fixed form global group header holder icon icons image
inner item items label left link links list main mobile outer page panel pane post posts primary region right row secondary section site slot sticky text top unit user view wrap wrapper zone""".split())
#: Names of headers, where no article is around them.
HEADERS = frozenset(["header", "site header", "page header", "top header", "main header", "global header", "header wrapper", "header container", "header inner"])
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_IDS: dict[str, int] = {}


def _number(path: str) -> int:
    """The same signed 64-bit number for a path in every process."""
    if (n := _IDS.get(path)) is None:
        if len(_IDS) > 200_000:
            _IDS.clear()
        n = _IDS[path] = int.from_bytes(hashlib.blake2b(path.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)
    return n


def _digest(parts: Collection[str]) -> int:
    return int.from_bytes(hashlib.blake2b(" ".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def names_noise(label: str, in_article: bool) -> bool:
    """Whether one of the names in a class or id says that an element isn't text."""
    for name in label.split():
        words = [w.lower() for w in WORDS.findall(name)]
        if any(w in NOISE_WORDS for w in words) and all(w in NOISE_WORDS or w in BESIDE_WORDS for w in words):
            return True
        if not in_article and " ".join(words) in HEADERS:
            return True
    return False


class Page:
    """Elements in page order with parent, tag and path, and runs of text (element, text); (-1, " ") ends a block."""

    def __init__(self, html: str):
        self.parent, self.tag, self.path, self.noise, self.main, self.inline, self.plain, self.runs = [-1], [""], [0], [False], [0], [False], [True], []
        self.numbers: dict[int, int] = {}
        runs, inside = self.runs, [False]  # of each element: whether an article is around it
        todo = [(n, 0) for n in reversed(parse(html))]
        while todo:
            node, up = todo.pop()
            if node is None:
                runs.append((-1, " "))
            elif node.kind == "text":
                runs.append((up, node.text))
            elif node.kind == "element":
                here = self._open(node, up, inside[up])
                inside.append(inside[up] or node.tag == "article")
                if not self.inline[here]:
                    runs.append((-1, " "))
                    todo.append((None, 0))
                todo += [(n, here) for n in reversed(node.children)]
        self.holds = [False] * len(self.tag)  # an article or main lies inside
        self._number_blocks(self.kept())

    def _open(self, node, up: int, in_article: bool) -> int:
        name, held = node.tag, node.attrs
        role = label = ""
        noise = name in NOISE_TAGS or name == "header" and not in_article
        if held:
            label = f"{held.get('class', '')} {held.get('id', '')}".strip()
            role = held.get("role", "").lower()
            noise = noise or role in NOISE_ROLES or "hidden" in held or "display:none" in held.get("style", "").replace(" ", "").lower() or bool(label) and names_noise(label, in_article)
        self.main.append(2 if name == "article" else 1 if name == "main" or role == "main" else 0)
        self.parent.append(up)
        self.tag.append(name)
        inline = node.ns == "math" or name in INLINE and node.ns is None  # a formula is a part of its sentence
        self.inline.append(inline)
        if inline:
            self.path.append(self.path[up])
        else:
            self.path.append(_number(f"{self.path[up]}>{name}|{role}|{re.sub('[0-9]+', '#', label) if label else ''}"))
        self.noise.append(noise and name not in ("html", "body"))
        self.plain.append(inline or name in PLAIN and not (label or role))
        return len(self.tag) - 1

    def kept(self) -> list[bool]:
        """Which elements' text stays as far as the markup says: what isn't noise, inside the article if there is one."""
        n, noise = len(self.tag), self.noise
        for k in range(n - 1, 0, -1):
            if self.main[k] and not noise[k] or self.holds[k]:
                self.holds[self.parent[k]] = True
        stay, inside = [True] * n, [0] * n
        for k in range(1, n):
            up = self.parent[k]
            stay[k] = stay[up] and not (noise[k] and not self.holds[k])
            inside[k] = max(inside[up], 0 if noise[k] else self.main[k]) if stay[k] else 0
        best = max(inside)
        return [s and i == best for s, i in zip(stay, inside, strict=True)] if best else stay

    def _number_blocks(self, stay: list[bool]) -> None:
        """Leaves only the text to keep, each run with the nearest block around it, and numbers the blocks that have some by their path and all they hold in page order."""
        owner = [0] * len(self.tag)
        for k in range(1, len(self.tag)):
            owner[k] = owner[self.parent[k]] if self.inline[k] else k
        self.owner = owner
        self.runs = [(owner[k] if k > 0 else k, t) for k, t in self.runs if k < 0 or stay[k]]
        parts: dict[int, list[tuple[int, str]]] = {}
        for at, (k, t) in enumerate(self.runs):
            if k > 0 and (t := " ".join(t.split())):
                parts.setdefault(k, []).append((at, t))
        for k in range(len(self.tag) - 1, 0, -1):
            if k in parts:
                inner = sorted(parts.pop(k))
                self.numbers[k] = _digest([f"{self.path[k]}", *(t for _, t in inner)])
                parts.setdefault(owner[self.parent[k]], []).append((inner[0][0], f"{self.numbers[k]}"))

    def text(self) -> str:
        """The main text as far as the markup tells it."""
        return " ".join("".join(t for _, t in self.runs).split())

    def packed(self) -> bytes:
        """Text and blocks for the task that knows the tree: it need not parse again.

        Of each block with text its parent's place, the branch it would go with and its number, 0 where the tree can't take it out.
        """
        order = sorted(self.numbers)
        place = {k: n for n, k in enumerate(order)}
        rows = [(place.get(self.owner[self.parent[k]], -1), 0 if self.plain[k] or self._fixed(k) else self.path[k], 0 if self._fixed(k) else self.numbers[k]) for k in order]
        blocks = np.array(rows, np.int64).reshape(-1, 3)
        runs = [(place.get(k, -1), t) for k, t in self.runs if k < 0 or t]
        runs = [r for n, r in enumerate(runs) if n == 0 or r[1] != " " or runs[n - 1] != r]
        return zlib.compress(pickle.dumps((blocks[:, 0].astype(np.int32).tobytes(), blocks[:, 1:].tobytes(), [k for k, _ in runs], [t for _, t in runs]), pickle.HIGHEST_PROTOCOL), 1)

    def _fixed(self, k: int) -> bool:
        return self.holds[k] or self.tag[k] in ("html", "body")

    def facts(self) -> Iterator[tuple[int, int, int]]:
        """(path, kind, what): of branches the content (0) and layout (1); of parents the blocks (2), and that they are there (3)."""
        words: dict[int, list[str]] = {}
        shape: dict[int, list[str]] = {}
        for k in range(1, len(self.tag)):
            if not self.inline[k]:
                shape.setdefault(self.path[self.parent[k]], []).append(f"{self.path[k]}")
                if k in self.numbers and not self.plain[k]:
                    words.setdefault(self.path[k], []).append(f"{self.numbers[k]}")
        for path, content in words.items():
            yield from ((path, 0, _digest(content)), (path, 1, _digest(shape.get(path, ()))))
        blocks = {(self.path[self.parent[k]], number) for k, number in self.numbers.items() if self.tag[k] not in ("html", "body")}
        yield from ((path, 2, number) for path, number in blocks)
        yield from ((path, 3, 0) for path in {path for path, _ in blocks})


def without(packed: bytes, low: Collection[int]) -> str:
    """The text of a packed page without the branches and blocks of low importance; empty if nothing is left."""
    up, names, places, texts = pickle.loads(zlib.decompress(packed))  # the library's own stored pages
    if low:
        gone: list[bool] = []
        for parent, (path, number) in zip(np.frombuffer(up, np.int32).tolist(), np.frombuffer(names, np.int64).reshape(-1, 2).tolist(), strict=True):
            gone.append(parent >= 0 and gone[parent] or path in low or number in low)
        texts = [t for k, t in zip(places, texts, strict=True) if k < 0 or not gone[k]]
    return " ".join("".join(texts).split())


def low_branches(pages: DataFrame, low: float = LOW, most: float = MOST) -> DataFrame:
    """(host, path): the branches of low importance and the template blocks of each host, as numbers.

    A branch's importance is CONTENT_SHARE x content + the rest x layout, where each is the entropy over the host's
    pages that show the branch, as a share of the most it can be: 0 if all pages have the same, 1 if each has its own.
    It is averaged with DOUBT pages of importance 1.  A block is template if more than the share most of the host's
    other pages that show its parent's branch, and DOUBT more, have it there; so a host has at most 1 / most times
    as many of them as a page has blocks.  Pages with the same main text are one page.  Pages without url belong
    to no host.  pages has _host, page and facts.
    """
    fact = F.transform(F.sequence(F.lit(0), (F.size("facts") / 3 - 1).cast("int")), lambda k: F.struct(*(F.get("facts", (3 * k + at).cast("int")).alias(c) for at, c in enumerate(("path", "kind", "what")))))
    seen = pages.where("size(facts) > 0 AND _host IS NOT NULL").select(F.col("_host").alias("host"), "page", F.explode(fact).alias("f")).select("host", "page", "f.*")
    counts = cut(seen.distinct().groupBy("host", "path", "kind", "what").agg(F.count("*").alias("c")).where((F.col("kind") != 2) | (F.col("c") > 1)))  # blocks of one page are never template
    spread = counts.where("kind < 2").groupBy("host", "path", "kind").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("s"))
    entropy = F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(1.0)
    weight = F.when(F.col("kind") == 0, CONTENT_SHARE).otherwise(1 - CONTENT_SHARE)
    rated = spread.groupBy("host", "path").agg(F.sum(weight * entropy).alias("importance"), F.max("m").alias("m"))
    branches = rated.where((F.col("importance") * F.col("m") + DOUBT) / (F.col("m") + DOUBT) < low).select("host", "path")
    shown = counts.where("kind = 3").select("host", "path", F.col("c").alias("m"))
    blocks = counts.where("kind = 2").join(F.broadcast(shown) if shown.count() <= BROADCAST_BRANCHES else shown, ["host", "path"])
    blocks = blocks.where(F.col("c") - 1 > (F.col("m") - 1 + DOUBT) * most).select("host", F.col("what").alias("path"))
    return branches.unionByName(blocks).distinct()


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, _host, packed (null for a null html), page (a number of the text) and facts, three numbers each, for every row of pages; stored, so that pages are parsed once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                p = b.slice(at, 256)
                made = [Page(html) if html else None for html in p.column(3).to_pylist()]
                facts = [[x for fact in page.facts() for x in fact] if page and host is not None else [] for page, host in zip(made, p.column(2).to_pylist(), strict=True)]
                ends = np.cumsum([0, *map(len, facts)]).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(ends), pa.array([x for f in facts for x in f], pa.int64()))
                yield pa.RecordBatch.from_arrays([*(p.column(k) for k in range(3)), pa.array([page.packed() if page else None for page in made], pa.binary()), pa.array([_digest([page.text()]) if page else 0 for page in made], pa.int64()), flat],
                                                 names=["page_id", "url", "_host", "packed", "page", "facts"])

    named = F.regexp_extract("url", "(?s)^.*?://([^/?#]*)", 1)
    rows = pages.select("page_id", "url", F.when(F.length(named) > 0, F.xxhash64(F.lower(named))).alias("_host"), "html")
    return cut(rows.mapInArrow(run, rows.select("page_id", "url", "_host").schema.add("packed", "binary").add("page", "long").add("facts", ArrayType(LongType()))))


def extract(pages: DataFrame, low: float = LOW) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html); a null html has an empty text.

    References are decoded, white space in a block is one space, blocks are joined in page order by one space;
    nothing is cut.  Repeated rows each have their row.
    """
    rows = parsed(pages)
    table = cut(low_branches(rows, low))
    tree = None
    if table.count() <= BROADCAST_BRANCHES:
        of_host: dict[int, set[int]] = {}
        for r in table.collect():
            of_host.setdefault(r["host"], set()).add(r["path"])
        tree = rows.sparkSession.sparkContext.broadcast(of_host)
        joined = rows.select("page_id", "url", "packed", "_host", F.lit(None).cast("array<long>").alias("paths"))
    else:
        lists = table.groupBy("host").agg(F.collect_list("path").alias("paths"))
        dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "packed"), F.lit(SALTS)))
        spread = lists.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = dealt.join(spread, (F.col("_host") == F.col("host")) & (F.col("_salt") == F.col("_part")), "left").select("page_id", "url", "packed", "_host", "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                p = b.slice(at, 256)
                texts = [without(page, tree.value.get(name, ()) if tree else frozenset(paths or ())) if page else "" for page, name, paths in zip(*(p.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    out = rows.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    return joined.mapInArrow(run, out)
