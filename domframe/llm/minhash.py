"""Near-duplicates by fast similarity sketching, banding and exact verification on full shingle sets.

Sketch: in round r < t every shingle falls into a hashed bin with a hashed value above r; in round t + b all
shingles fall into bin b.  A bin keeps its least value, so bins fill in the earliest round that reaches them and
every coordinate is filled.  Texts with equal shingle sets are drawn together first; the rest meet in bands of
coordinates.  Texts of a band are compared by all their coordinates, with a margin that leaves no link out; only
those alike by these form groups, and the groups are verified on their whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut
from .words import U, distinct, mix, seeds, shingles_of

#: Texts, and shingles, of a block; larger groups are dealt out in blocks, with about so many pivots in each.
BLOCK_TEXTS, BLOCK_SHINGLES, PIVOTS = 128, 500_000, 8
#: Sketches of a band that one task compares with each other; of more, blocks are compared with blocks.
BLOCK_SKETCHES = 500
#: The chance that bands, or the comparison of coordinates, miss a pair at the threshold.
MISS = 1e-6
#: Parts into which the members of a group are dealt where the table of large groups, or bands, is not broadcast; up to so many rows it is (about 10 MB).
SALTS, BROADCAST_GROUPS = 64, 200_000
#: Up to so many members of candidate groups their ids are broadcast (about 20 MB); beyond, texts are joined by shuffle.
BROADCAST_MEMBERS = 400_000
#: Rows of an Arrow batch that are Python objects at a time.
SLICE = 256
SKETCHES = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, coordinates binary"


def sketch(shingles: np.ndarray, t: int, seed: int = 1) -> np.ndarray:
    """The t coordinates of a non-empty array of distinct shingle hashes.

    Rounds are computed several at a time.  Those after the one that fills the last bin change nothing, because
    the round stands in the high bits of a value.
    """
    salts, bins = seeds(2 * t, seed), np.full(t, ~U(0), U)
    n, r = len(shingles), 0
    while r < t and (r == 0 or (bins == ~U(0)).any()):
        step = min(t - r, max(1, math.ceil(1.5 * t / n)))
        z = mix(shingles[None, :] ^ salts[r:r + step, None])
        bin_of = ((z >> U(32)) * U(t)) >> U(32)
        value = (z & U(0xFFFFFFFF)) | (np.arange(r, r + step, dtype=U)[:, None] << U(32))
        np.minimum.at(bins, bin_of.ravel().astype(np.intp), value.ravel())
        r += step
    for b in np.flatnonzero(bins == ~U(0)):
        bins[b] = (U(t + int(b)) << U(32)) | (mix(shingles ^ salts[t + b]) & U(0xFFFFFFFF)).min()
    return bins


def rows_per_band(percent: int, t: int, miss: float = MISS) -> int:
    """The most coordinates a band can have with a pair of that similarity missed more rarely than miss."""
    return max(r for r in range(1, t + 1) if r == 1 or (1 - (percent / 100) ** r) ** (t // r) <= miss)


def least_equal(percent: int, t: int, miss: float = MISS) -> int:
    """So many of t coordinates of a pair of that similarity are equal, but for a chance of miss."""
    p, below = percent / 100, 0.0
    for k in range(t):
        below += math.exp(math.lgamma(t + 1) - math.lgamma(k + 1) - math.lgamma(t - k + 1) + k * math.log(p) + (t - k) * math.log1p(-p)) if p < 1 else 0.0
        if below > miss:
            return k
    return t


def bands(coordinates: np.ndarray, rows: int) -> np.ndarray:
    count = len(coordinates) // rows
    place = seeds(rows, 3) | U(1)
    return mix((mix(coordinates[:count * rows]).reshape(count, rows) * place).sum(axis=1) + seeds(count, 5))


def _sketcher(k: int, t: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[tuple] = []
            for hashes in shingles_of(texts, k):
                s = distinct(hashes)
                m = mix(s ^ U(0x5851F42D4C957F2D))
                d1, d2 = int(m.sum().astype(np.int64)), int(np.bitwise_xor.reduce(m).astype(np.int64)) if len(m) else 0
                made = sketch(s, t) if len(s) else None
                low = None if made is None else mix(made).astype(np.uint8).tobytes()  # equal coordinates have equal bytes
                out.append((len(s), d1, d2, None if made is None else bands(made, rows).astype(np.int64), low))
            n, d1, d2, b, low = zip(*out, strict=True) if out else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x, pa.int64()) for x in (n, d1, d2)), pa.array(b, pa.list_(pa.int64())), pa.array(low, pa.binary())], names=["doc_id", "n_shingles", "d1", "d2", "bands", "coordinates"])

    return run


def alike(low: np.ndarray, here: np.ndarray, there: np.ndarray, least: int) -> np.ndarray:
    """For rows of coordinates' bytes: the first row each is connected with by pairs (one of here, one of there) that have least bytes in common."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(here), 64):
        equal = (low[here[at:at + 64], None, :] == low[None, there, :]).sum(axis=2, dtype=np.int32) >= least
        i, j = np.nonzero(equal)
        a.append(here[at:at + 64][i])
        b.append(there[j])
    a, b = np.concatenate(a), np.concatenate(b)
    root = np.arange(len(low))
    while True:
        first = root.copy()
        np.minimum.at(first, a, root[b])
        np.minimum.at(first, b, root[a])
        first = first[first]
        if (first == root).all():
            return root
        root = first


def _closer(least: int):
    """Stars (a, b) of the texts of a task (band, i, j) that are alike by their coordinates; rows come sorted by these."""
    def stars(key, rows):
        reps, blocks = np.array([r for r, _, _ in rows]), np.array([k for _, k, _ in rows])
        low = np.frombuffer(b"".join(x for _, _, x in rows), np.uint8).reshape(len(rows), -1)
        root = alike(low, np.flatnonzero(blocks == key[1]), np.flatnonzero(blocks == key[2]), least)
        at = np.flatnonzero(root != np.arange(len(rows)))
        return zip(reps[at].tolist(), reps[root[at]].tolist(), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []
        for batch in batches:
            for band, i, j, rep, block, low in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (band, i, j) != key:
                    if held:
                        out.extend(stars(key, held))
                    key, held = (band, i, j), []
                held.append((rep, block, low))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])
                out = []
        if held and (out := list(stars(key, held))):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    return run


def _by_group(rows: DataFrame, groups: DataFrame, key: str, salt: str) -> DataFrame:
    """rows left joined with a table of one row per key: broadcast after a count, or else dealt by a salt as well, for keys that very many rows have."""
    if groups.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), key, "left")
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    return dealt.join(groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "_salt"], "left").drop("_salt")


def candidate_groups(classes: DataFrame, percent: int, t: int) -> DataFrame:
    """(id, comp) for the classes (rep, bands, coordinates) that are alike by their coordinates, over any number of steps.

    Bands with the same texts count once.  A band of many texts is compared in pairs of blocks.
    """
    banded = classes.select("rep", F.explode("bands").alias("band"))
    members = F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who")
    shared = banded.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("last"), F.count("*").alias("c"), members).where("hub < last")
    shared = cut(shared.groupBy("hub", "last", "c", "who").agg(F.min("band").alias("band")).select("band", "hub", "c"))
    met = cut(banded.join(shared.select("band"), "band").distinct())
    large = cut(shared.where(F.col("c") > BLOCK_SKETCHES).select("band", F.ceil(F.col("c") / BLOCK_SKETCHES).cast("int").alias("blocks")))
    # The coordinates travel only with texts that share a band.
    rows = met.join(classes.select("rep", "coordinates"), "rep")
    rows = _by_group(rows, large, "band", "rep").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(3)), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    tasks = rows.select("band", "i", "j", "rep", "block", "coordinates").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "rep")
    return components(tasks.mapInArrow(_closer(least_equal(percent, t)), "a long, b long"))


def linked(sets: list[np.ndarray], percent: int) -> list[int]:
    """For sets of sorted distinct hashes: the index of the first set each is connected with by links of that similarity."""
    root = list(range(len(sets)))

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    sizes = np.array([len(s) for s in sets])
    near = lambda both, a, b: 100 * both >= percent * (a + b - both)
    if len(sets) <= 24:
        for j in range(1, len(sets)):
            for i in range(j):
                a, b = int(sizes[i]), int(sizes[j])
                if 100 * min(a, b) >= percent * max(a, b) and (x := top(i)) != (y := top(j)):
                    both = np.concatenate([sets[i], sets[j]])
                    both.sort()
                    if near(int((both[1:] == both[:-1]).sum()), a, b):
                        root[max(x, y)] = min(x, y)
        return [top(x) for x in range(len(sets))]
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    number = np.cumsum(new) - 1
    shared = np.bincount(number) > 1  # a shingle of one text is in no intersection
    held = shared[number]
    owner, column = owner[held], (np.cumsum(shared) - 1)[number[held]]
    common = np.zeros((len(sets), len(sets)), np.float32)
    width, total = 4096, int(column[-1]) + 1 if len(column) else 0
    for at in range(0, total, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        x = np.zeros((len(sets), min(width, total - at)), np.float32)
        x[owner[lo:hi], column[lo:hi] - at] = 1
        common += x @ x.T
    for i in range(len(sets)):
        both = common[i, :i].astype(np.int64)
        for j in np.flatnonzero(100 * both >= percent * (sizes[i] + sizes[:i] - both)):
            if (x := top(i)) != (y := top(int(j))):
                root[max(x, y)] = min(x, y)
    return [top(x) for x in range(len(sets))]


def _verifier(k: int, percent: int):
    def stars(ids, texts):
        sets, nodes, seen = [], [], set()
        for node, s in zip(ids, (distinct(h) for h in shingles_of(texts, k)), strict=True):
            if (key := (node, s.tobytes())) not in seen and len(s):
                seen.add(key)
                sets.append(s)
                nodes.append(node)
        return [(node, nodes[r]) for node, r in zip(nodes, linked(sets, percent), strict=True) if nodes[r] != node]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, texts, out = None, [], [], []
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            for now, node, text in zip(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2)), strict=True), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if now != key:
                    out += stars(ids, texts)
                    key, ids, texts = now, [], []
                ids.append(node)
                texts.append(text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])
                out = []
        if out := stars(ids, texts):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    return run


def _blocks(count, shingles):
    return F.greatest(F.ceil(shingles / BLOCK_SHINGLES), F.ceil(count / BLOCK_TEXTS)).cast("int")


def _stars(read: DataFrame, dealt: DataFrame, words: int, percent: int) -> DataFrame:
    """Stars of verified links (a, b) within each task (comp, i, j) of dealt, which has an id's row for every task it is in."""
    members = cut(dealt)
    if members.count() <= BROADCAST_MEMBERS:
        members = F.broadcast(members)
    texts = read.join(members, F.col("doc_id") == F.col("id")).select("comp", "i", "j", "id", "text")
    return texts.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "id").mapInArrow(_verifier(words, percent), "a long, b long")


def verified(read: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, comp) by verified links between members (id, comp, n shingles) of the same candidate group.

    A group of one block is compared whole.  A larger one is first compared block by block, each with the same few
    pivots, which joins nearly all copies of one text.  Then only pairs remain that lie in different blocks and aren't
    connected yet; at least one of the two is outside the group's largest part.  So what is outside is compared,
    again in blocks, with every block.
    """
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    sized = cut(members.groupBy("comp").agg(F.count("*").alias("m"), _blocks(F.count("*"), F.sum("n")).alias("blocks")).where("blocks > 1"))
    blocks = F.coalesce("blocks", F.lit(1))
    placed = cut(_by_group(members, sized, "comp", "id").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int")))
    pivot = (F.col("blocks") > 1) & ((F.col("id") == F.col("comp")) | (F.pmod(F.xxhash64("id", F.lit(1)), "m") < PIVOTS))
    first = placed.select("id", "comp", F.explode(F.when(pivot, upto(F.col("blocks"))).otherwise(F.array("own"))).alias("i"), F.lit(-1).alias("j"))
    stars = cut(_stars(read, first, words, percent))
    large = placed.where("blocks > 1")
    if large.isEmpty():  # every group has been compared whole
        return components(stars)
    parts = cut(large.join(components(stars).withColumnRenamed("comp", "part"), "id", "left").withColumn("part", F.coalesce("part", "id")))
    largest = parts.groupBy("comp", "part").agg(F.count("*").alias("c")).groupBy("comp").agg(F.max_by("part", F.struct("c", "part")).alias("largest"))
    split = _by_group(parts, cut(largest), "comp", "id").withColumn("outside", F.col("part") != F.col("largest"))
    outside = cut(split.where("outside").groupBy("comp").agg(_blocks(F.count("*"), F.sum("n")).alias("others")))
    rest = _by_group(split, outside, "comp", "id").where("others IS NOT NULL").withColumn("other", F.pmod(F.xxhash64("id", F.lit(2)), "others").cast("int"))
    with_all = F.explode(F.transform(upto(F.col("others")), lambda j: F.struct(F.col("own").alias("i"), j.alias("j")))).alias("x")
    in_all = F.explode(F.transform(upto(F.col("blocks")), lambda i: F.struct(i.alias("i"), F.col("other").alias("j")))).alias("x")
    second = rest.select("id", "comp", with_all).unionByName(rest.where("outside").select("id", "comp", in_all)).select("id", "comp", "x.i", "x.j").distinct()
    return components(stars.unionByName(_stars(read, second, words, percent)))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, t: int = 128) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Null, empty and blank texts have no shingles and link with nothing; texts of fewer words are one shingle.
    Repeated rows each keep a row; rows that share a doc_id are one node.  A row without doc_id belongs to the
    texts with its shingle set but stands for none; if all of those lack ids, component_id is null and kept true.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = cut(read.mapInArrow(_sketcher(words, t, rows_per_band(percent, t)), SKETCHES))
    full = sketched.where("n_shingles > 0")
    same = F.min_by(F.struct("bands", "coordinates"), "doc_id").alias("s")
    classes = cut(full.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), same).where("rep IS NOT NULL").select("d1", "d2", "n_shingles", "rep", "s.bands", "s.coordinates"))
    groups = candidate_groups(classes, percent, t)
    sizes = classes.groupBy(F.col("rep").alias("id")).agg(F.sum("n_shingles").alias("n"))
    found = verified(read, groups.join(sizes, "id"), words, percent)
    named = cut(classes.select("d1", "d2", "n_shingles", "rep").join(found.select(F.col("id").alias("rep"), "comp"), "rep", "left"))
    named = named.select("d1", "d2", F.col("n_shingles").alias("n"), F.coalesce("comp", "rep").alias("component"))
    s = sketched.select("doc_id", "n_shingles", F.col("d1").alias("e1"), F.col("d2").alias("e2"))
    joined = s.join(named, (F.col("e1") == F.col("d1")) & (F.col("e2") == F.col("d2")) & (F.col("n_shingles") == F.col("n")), "left")
    component = F.coalesce("component", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
