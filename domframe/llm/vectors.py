"""Near-duplicates among embeddings by robust-pruned flat graphs over overlapping cluster shards.

Vectors with the same label that are too many for one task are dealt to clusters: the cells that random hyperplanes
cut out.  A vector near a plane joins both sides, and a label has as many such partitions as it takes that a linked
pair shares a shard in one of them but for a chance of MISS.  Shards are split, each by the planes that halve it
best, until they fit a task; so they grow in number with the rows, and not in size.  Every shard builds a graph: each
vector's nearest others, robustly pruned, both ways.  The adjacency lists of a vector from all its shards are united.
Then each shard searches: from its medoid greedily towards each vector, then on through all neighbours within the
range.  Some vectors are also compared with all of the shard; if the search has missed a link of theirs, the whole
shard is compared.  What no plane can split, a ball of vectors that nearly all link, is compared block by block.
Every pair found is verified in double precision, in one of the shards that both share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut

#: Vectors of a shard that one task holds.
BLOCK = 4000
#: Planes of a partition; the chance of a linked pair to share no shard; levels that a label may need beyond those of even splits.
BITS, MISS, DEEPER = 40, 1e-6, 3
#: Rows of a shard that its planes are chosen by: a plane may leave at most this share on a side.
DRAWN, GAIN = 4096, 0.78
#: Planes that split a shard in one round.
PLANES = 3
#: Up to so many split shards their table is broadcast (about 10 MB); beyond, it is joined by shuffle.
BROADCAST_SPLITS = 200_000
#: Neighbours kept by pruning (per direction), candidates it chooses from, and how much longer a detour must be.
DEGREE, POOL, ALPHA = 16, 40, 1.2
#: The search goes on through vectors that are this much less alike than the threshold; steps of its greedy part.
SLACK, STEPS = 0.06, 24
#: Queries of a search that walk side by side.
WALKERS = 64
#: Of so many vectors that search in a block, one is compared with the whole block.
AUDITED = 16
KEYS = ["label", "dim", "shard"]


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; their largest component is made 1 first, so that no square leaves the range of doubles."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def valid_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, label, embedding (its own floats or doubles), dim and k1, k2, hashes of label and vector; null where a row links with nothing.

    A row links only if label and vector are not null and all components are there, finite and not all zero.
    """
    kind = rows.schema["embedding"].dataType.elementType.typeName()
    kind = kind if kind == "float" else "double"
    e = F.transform("embedding", lambda x: x.cast(kind) + F.lit(0.0).cast(kind))  # -0 becomes 0
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    held = F.when(F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)), e)
    out = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", held.alias("embedding")).withColumn("dim", F.size("embedding"))
    return out.select("vec_id", "label", "embedding", "dim", *(F.when(F.col("embedding").isNotNull(), F.xxhash64(F.lit(k), "label", "embedding")).alias(f"k{k}") for k in (1, 2)))


def plan(blocks: float, cosine: float) -> tuple[int, float]:
    """(partitions, margin) with the fewest copies of a vector for a label of so many times BLOCK vectors.

    margin is in standard deviations of how far apart a random plane's direction sees two vectors that just link.
    A level copies the share of vectors within the margin of a plane, and parts a pair that lies around it.
    """
    reach = 2 * math.sin(math.acos(cosine) / 2)
    best = (math.inf, 1, 0.0)
    for q in np.arange(0, 6.01, 0.25).tolist():
        share = math.erf(q * reach / 2 / math.sqrt(2))
        apart = 2 * (math.exp(-q * q / 2) / math.sqrt(2 * math.pi) - q * math.erfc(q / math.sqrt(2)) / 2) * reach / math.sqrt(2 * math.pi)
        if share < 0.9:
            depth = math.log(max(1.0, blocks)) / math.log(2 / (1 + share))
            lost = 1 - (1 - min(1.0, apart)) ** (depth + DEEPER)
            trees = max(1, math.ceil(math.log(MISS) / math.log(lost))) if 0 < lost < 1 else 1
            best = min(best, (trees * (1 + share) ** depth, trees, q))
    return best[1], best[2]


def _directions(dim: int, trees: int) -> np.ndarray:
    """dim x (trees * BITS) unit vectors, the same in every process."""
    out = np.stack([np.random.default_rng([dim, k]).normal(size=dim) for k in range(trees * BITS)], axis=1)
    return out / np.linalg.norm(out, axis=0)


def _coder(cosine: float):
    """Rows (label, dim, rep, k1, shard, code, free) for each vector and partition: on which sides it lies, and of which planes it is near."""
    reach = 2 * math.sin(math.acos(cosine) / 2)
    powers = np.int64(1) << np.arange(BITS, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[tuple, np.ndarray] = {}
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            vectors = _split(batch.column("embedding"))
            by: dict[tuple, list[int]] = {}
            for k, key in enumerate(zip(*(batch.column(c).to_pylist() for c in ("dim", "trees", "margin")), strict=True)):
                by.setdefault(key, []).append(k)
            for (dim, trees, margin), rows in by.items():
                if (dim, trees) not in made:
                    made.clear()
                    made[dim, trees] = _directions(dim, trees)
                seen = _unit(np.stack([vectors[k] for k in rows]).astype(np.float64)) @ made[dim, trees]
                side = (seen > 0).reshape(len(rows), trees, BITS) @ powers
                near = (np.abs(seen) <= min(1.0, margin / math.sqrt(dim)) * reach / 2 + 1e-9).reshape(len(rows), trees, BITS) @ powers
                taken = batch.select(["label", "dim", "rep", "k1"]).take(pa.array(np.repeat(rows, trees)))
                shard = np.tile(np.arange(trees, dtype=np.int64), len(rows))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(shard), pa.array(side.ravel()), pa.array(near.ravel())], names=["label", "dim", "rep", "k1", "shard", "code", "free"])

    return run


def shards(classes: DataFrame, cosine: float) -> DataFrame:
    """(label, dim, shard, rep, k1): every vector of classes (label, dim, rep, k1, embedding) in all its shards.

    A label that fits a task is one shard.  In rounds, every larger shard is split by the planes that leave the
    fewest on a side, as a sample of DRAWN of its rows tells; the choice decides how even shards are, not
    whether a pair meets.  A shard that no plane splits stays whole.
    """
    sizes = cut(classes.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK))
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_SPLITS else df
    if sizes.isEmpty():
        return classes.select("label", "dim", F.lit(0).cast("long").alias("shard"), "rep", "k1")
    level = F.least(F.greatest(F.ceil(F.log2(F.col("n") / BLOCK)), F.lit(1)), F.lit(40)).cast("int")
    plans = F.array(*(F.struct(F.lit(t).alias("trees"), F.lit(q).alias("margin")) for t, q in (plan(2**d, cosine) for d in range(1, 41))))
    planned = sizes.select("label", "dim", F.element_at(plans, level).alias("p")).select("label", "dim", "p.*")
    both = classes.select("label", "dim", "rep", "k1", "embedding").join(small(planned), ["label", "dim"], "left")
    schema = classes.select("label", "dim", "rep", "k1").schema.add("shard", "long").add("code", "long").add("free", "long")
    done = [both.where("trees IS NULL").select("label", "dim", F.lit(0).cast("long").alias("shard"), "rep", "k1")]
    now = cut(both.where("trees IS NOT NULL").select("label", "dim", "rep", "k1", "embedding", "trees", "margin").mapInArrow(_coder(cosine), schema))
    one, zero = F.col("code").bitwiseOR(F.col("free")), F.bitwise_not(F.col("code")).bitwiseOR(F.col("free"))
    for turn in range(BITS):
        heavy = cut(now.groupBy(*KEYS).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK))
        if heavy.isEmpty():
            break
        million = F.pmod(F.xxhash64("k1", F.lit(turn)), F.lit(1 << 20))
        drawn = now.join(small(heavy), KEYS).where(million <= DRAWN / F.col("n") * (1 << 20))
        each = drawn.select(*KEYS, "n", one.alias("one"), zero.alias("zero"), F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("bit"))
        on = lambda side: F.sum(F.getbit(F.col(side), F.col("bit")).cast("long"))
        rated = each.groupBy(*KEYS, "bit").agg(F.first("n").alias("n"), (F.greatest(on("one"), on("zero")) / F.count("*")).alias("most")).where(F.col("most") <= GAIN)
        levels = F.least(F.ceil(F.log2(F.first("n") / BLOCK)).cast("int"), F.lit(PLANES))
        split = rated.groupBy(*KEYS).agg(F.slice(F.sort_array(F.collect_list(F.struct("most", "bit"))), F.lit(1), levels).alias("b")).select(*KEYS, F.col("b.bit").alias("bits"))
        split = cut(split)
        if split.isEmpty():
            break
        marked = now.join(small(split), KEYS, "left")
        done.append(marked.where("bits IS NULL").select(*KEYS, "rep", "k1"))
        picks = marked.where("bits IS NOT NULL").withColumn("pick", F.explode(F.sequence(F.lit(0), F.expr("shiftleft(1, size(bits)) - 1"))))
        there = F.forall(F.transform("bits", lambda b, k: (F.getbit(F.col("free"), b) == 1) | (F.getbit(F.col("code"), b) == F.getbit(F.col("pick").cast("long"), k))), lambda x: x)
        now = cut(picks.where(there).select("label", "dim", "rep", "k1", F.xxhash64("shard", "bits", "pick").alias("shard"), "code", "free"))
    return reduce(DataFrame.unionByName, [*done, now.select(*KEYS, "rep", "k1")])


def _split(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column as arrays."""
    return np.split(column.flatten().to_numpy(), np.cumsum(np.array(pc.list_value_length(column)))[:-1]) if len(column) else []


def build_graph(x: np.ndarray, degree: int = DEGREE, pool: int = POOL) -> list[np.ndarray]:
    """Adjacency lists of unit vectors: robust pruning of each one's nearest, then the reverse edges as well."""
    n = len(x)
    pool = min(pool, n - 1)
    if pool < 1:
        return [np.zeros(0, np.int64) for _ in range(n)]
    chosen = np.zeros((n, pool), bool)
    near = np.empty((n, pool), np.int64)
    for at in range(0, n, 512):
        like = x[at:at + 512] @ x.T
        like[np.arange(len(like)), np.arange(at, at + len(like))] = -2
        top = np.argpartition(-like, pool - 1, axis=1)[:, :pool]
        far = 2 - 2 * np.take_along_axis(like, top, 1)
        order = far.argsort(axis=1, kind="stable")
        near[at:at + 512], far = np.take_along_axis(top, order, 1), np.take_along_axis(far, order, 1)
        own = x[near[at:at + 512]]
        between = 2 - 2 * np.matmul(own, own.transpose(0, 2, 1))
        alive, count = np.ones(far.shape, bool), np.zeros(len(far), np.int64)
        for j in range(pool):
            take = alive[:, j] & (count < degree)
            chosen[at:at + 512, j] = take
            count += take
            alive &= ~(take[:, None] & (ALPHA * ALPHA * between[:, j, :] <= far))
    a, j = np.nonzero(chosen)
    b = near[a, j]
    # A ring keeps the graph whole where pruning has left islands.
    ring = np.arange(n)
    edges = np.unique(np.concatenate([a * n + b, b * n + a, ring * n + (ring + 1) % n, ((ring + 1) % n) * n + ring]))
    return np.split(edges % n, np.searchsorted(edges // n, np.arange(1, n)))


def range_search(x: np.ndarray, links: list[np.ndarray], queries: np.ndarray, start: int, low: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each query (a place in x) the other places whose likeness is low or more, as far as the search meets them.

    The greedy part walks from start to ever closer vectors; from the query's own place and from where the walk ends,
    the range part then goes on through every vector within the range less SLACK.  WALKERS queries go side by side.
    """
    degree = np.array([len(k) for k in links])
    first, flat = np.cumsum(degree) - degree, np.concatenate([*links, np.zeros(0, np.int64)]).astype(np.int64)

    def neighbours(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of places, neighbour) for all neighbours of each."""
        each = degree[places]
        of = np.repeat(np.arange(len(places)), each)
        return of, flat[np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each) + first[places][of]]

    for begin in range(0, len(queries), WALKERS):
        asked = queries[begin:begin + WALKERS]
        score = lambda q, k: np.einsum("nd,nd->n", x[asked[q]], x[k])  # noqa: B023, E731
        every = np.arange(len(asked))
        at, best, going = np.full(len(asked), start), score(every, np.full(len(asked), start)), every
        for _ in range(STEPS):
            of, ahead = neighbours(at[going])
            if not len(of):
                break
            s = score(going[of], ahead)
            order = np.lexsort((s, of))
            last = order[np.flatnonzero(np.append(of[order][1:] != of[order][:-1], True))]  # the best of each
            better = s[last] > best[going[of[last]]]
            going = going[of[last[better]]]
            at[going], best[going] = ahead[last[better]], s[last[better]]
        seen = np.zeros((len(asked), len(x)), bool)
        seen[every, at] = seen[every, asked] = True
        q, front = np.nonzero(seen)
        met = []
        while len(front):
            s = score(q, front)
            hit = (s >= low) & (front != asked[q])
            met.append((q[hit], front[hit]))
            wide = s >= low - SLACK
            of, ahead = neighbours(front[wide])
            new = np.zeros_like(seen)
            new[q[wide][of], ahead] = True
            new &= ~seen
            seen |= new
            q, front = np.nonzero(new)
        who, found = (np.concatenate(k) for k in zip(*met, strict=True))
        order = np.argsort(who, kind="stable")
        yield from zip(asked.tolist(), np.split(found[order], np.searchsorted(who[order], every[1:])), strict=True)


def exact_search(x: np.ndarray, queries: np.ndarray, others: np.ndarray, low: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each query (a place in x) those of the other places whose likeness is low or more, by comparing all."""
    for at in range(0, len(queries), 512):
        alike = x[queries[at:at + 512]] @ x[others].T >= low
        for q, row in zip(queries[at:at + 512].tolist(), alike, strict=True):
            found = others[row]
            yield q, found[found != q]


def _block_search(x: np.ndarray, links: list[np.ndarray], queries: np.ndarray, low: float) -> list[tuple[int, np.ndarray]]:
    """range_search in a block, or exact_search if that finds more for some of the queries."""
    everywhere = np.arange(len(x))
    medoid = int((x @ x.mean(axis=0)).argmax())
    met = list(range_search(x, links, queries, medoid, low))
    for (_, found), (_, there) in zip(met[::AUDITED], exact_search(x, queries[::AUDITED], everywhere, low + 1e-6), strict=True):
        if not np.isin(there, found).all():
            return list(exact_search(x, queries, everywhere, low))
    return met


def _tasks(batches: Iterator[pa.RecordBatch], work, columns: list[str], names: list[str], kinds: list) -> Iterator[pa.RecordBatch]:
    """work(key, rows) for every run of rows with equal (label, dim, shard, i, j); rows come sorted by these."""
    held, key = [], None

    def done():
        got = work(key, {c: [r[k] for r in held] for k, c in enumerate(columns)})
        return [pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(got, kinds, strict=True)], names=names)] if len(got[0]) else []

    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in (*KEYS, "i", "j")), strict=True))
        values = _split(batch.column("embedding"))
        rows = list(zip(*(values if c == "embedding" else batch.column(c).to_pylist() for c in columns), strict=True))
        for k, row in zip(keys, rows, strict=True):
            if k != key:
                if held:
                    yield from done()
                held, key = [], k
            held.append(row)
    if held:
        yield from done()


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def work(key, rows):
        x = _unit(np.stack(rows["embedding"]).astype(np.float64)).astype(np.float32)
        names = np.array(rows["k1"])
        return rows["rep"], rows["k1"], [names[k].tolist() for k in build_graph(x)]

    return _tasks(batches, work, ["rep", "k1", "embedding"], ["rep", "k1", "near"], [pa.int64(), pa.int64(), pa.list_(pa.int64())])


def _at_home(shard: int, lists: list[list[int]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) of rows, sorted by a, share no shard of a lesser number than this one."""
    lesser = [[s for s in x if s < shard] for x in lists]
    home = np.ones(len(a), bool)
    if any(lesser):
        number = {s: k for k, s in enumerate(sorted({s for x in lesser for s in x}))}
        there = np.zeros((len(lists), len(number)), np.float32)
        for k, x in enumerate(lesser):
            there[k, [number[s] for s in x]] = 1
        for at in range(0, len(lists), 512):
            lo, hi = np.searchsorted(a, [at, at + 512])
            if lo < hi:
                home[lo:hi] = (there[at:at + 512] @ there.T)[a[lo:hi] - at, b[lo:hi]] == 0
    return home


def _searcher(cosine: float):
    def work(key, rows):
        exact = _unit(np.stack(rows["embedding"]).astype(np.float64))
        x, n = exact.astype(np.float32), len(exact)
        place = {name: k for k, name in enumerate(rows["k1"])}
        block, copies = np.array(rows["block"]), np.array(rows["copies"])
        _, _, shard, i, j = key
        if i == j:
            links = [np.array([place[r] for r in near or () if r in place], np.int64) for near in rows["near"]]
            met = _block_search(x, links, np.arange(n), cosine - 1e-3)
        else:
            met = exact_search(x, np.flatnonzero(block == i), np.flatnonzero(block == j), cosine - 1e-3)
        codes = [np.minimum(found, q) * n + np.maximum(found, q) for q, found in met]
        pairs = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64)
        a, b = pairs // n, pairs % n
        home = _at_home(shard, rows["shards"], a, b)  # the first of the shards that both are in
        a, b = a[home], b[home]
        alike = np.concatenate([np.einsum("nd,nd->n", exact[a[k:k + 65536]], exact[b[k:k + 65536]]) for k in range(0, len(a), 65536)]) if len(a) else np.zeros(0)
        a, b = a[alike >= cosine], b[alike >= cosine]
        count = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
        root = np.arange(n)
        while True:  # the least place each is connected with
            least = root.copy()
            np.minimum.at(least, a, root[b])
            np.minimum.at(least, b, root[a])
            least = least[least]
            if (least == root).all():
                break
            root = least
        at, reps = np.flatnonzero(count > 0), np.array(rows["rep"])
        return reps[at], np.array(rows["k1"])[at], count[at].astype(np.int64), reps[root[at]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _tasks(batches, work, ["rep", "k1", "copies", "shards", "block", "near", "embedding"], ["rep", "k1", "n", "root"], [pa.int64()] * 4)

    return run


def near_duplicates(rows: DataFrame, cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of rows (vec_id, embedding, label).

    Equal vectors of a label are drawn together first; each of them links with all the others, and a row that
    repeats a vec_id counts as a vector of its own, but is in the same component.  Vectors of different length link with nothing of the other's.
    Rows without vec_id, label or a finite vector other than zero have no links and are their own component.
    Components may be as small or large as doubles go: only directions count.
    """
    vectors = valid_vectors(rows)
    classes = cut(vectors.where("k1 IS NOT NULL AND vec_id IS NOT NULL").groupBy("label", "dim", "k1", "k2").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.any_value("embedding").alias("embedding")))
    dealt = shards(classes, cosine)
    node = ["rep", "k1"]  # rep alone doesn't tell vectors apart where rows share a vec_id
    lists = dealt.groupBy(*node).agg(F.sort_array(F.collect_list("shard")).alias("shards"))
    placed = classes.select("label", "dim", *node, "copies", "embedding").join(lists, node).withColumn("shard", F.explode("shards"))
    sizes = cut(dealt.groupBy(*KEYS).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1"))
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_SPLITS else sizes
    members = placed.join(sizes, KEYS, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod("k1", "blocks").cast("int"))
    keys = [*KEYS, "i", "j"]
    alone = members.withColumns({"i": F.col("block"), "j": F.col("block")}).select(*keys, *node, "embedding")
    near = alone.repartition(*keys).sortWithinPartitions(*keys, *node).mapInArrow(_build, "rep long, k1 long, near array<long>")
    united = near.groupBy(*node).agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    paired = members.join(united, node).select("*", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    near_of = F.when(F.col("i") == F.col("j"), F.col("near")).alias("near")  # only searches in one block use them
    tasks = paired.select(*keys, *node, "copies", "shards", "block", near_of, "embedding").repartition(*keys).sortWithinPartitions(*keys, *node)
    found = cut(tasks.mapInArrow(_searcher(cosine), "rep long, k1 long, n long, root long"))
    groups = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "rep")
    counts = found.groupBy(*node).agg(F.sum("n").alias("n"))
    named = classes.select("label", "k1", "k2", "rep", "copies").join(counts, node, "left").join(groups, "rep", "left")
    named = cut(named.select(F.col("label").alias("_label"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("comp", "rep").alias("component")))
    own = vectors.select("vec_id", "label", "k1", "k2")
    joined = own.join(named, (F.col("label") == F.col("_label")) & (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def audit(rows: DataFrame, found: DataFrame, cosine: float = 0.98, every: int = 100) -> tuple[int, int]:
    """(links found, links there are) of the vectors whose id is divisible by every, by exact comparison with all rows.

    Queries are compared a block at a time, so that neither they nor the pairs need fit in memory.
    """
    vectors = valid_vectors(rows).where("k1 IS NOT NULL AND vec_id IS NOT NULL")
    asked = vectors.where(F.col("vec_id") % every == 0)
    total, block = 0, 4000
    for at in range(0, asked.count(), block):
        chosen = asked.orderBy("vec_id").offset(at).limit(block).select("vec_id", "label", "embedding").collect()

        def run(batches, chosen=chosen):
            for batch in batches:
                by: dict[tuple, list[np.ndarray]] = {}
                for label, v in zip(batch.column("label").to_pylist(), _split(batch.column("embedding")), strict=True):
                    by.setdefault((label, len(v)), []).append(v)
                hits = 0
                for (label, dim), rows in by.items():
                    if asked_of := [r["embedding"] for r in chosen if r["label"] == label and len(r["embedding"]) == dim]:
                        hits += int((_unit(np.array(asked_of, np.float64)) @ _unit(np.stack(rows).astype(np.float64)).T >= cosine).sum())
                yield pa.RecordBatch.from_arrays([pa.array([hits], pa.int64())], names=["hits"])

        total += (vectors.select("label", "embedding").mapInArrow(run, "hits long").agg(F.sum("hits")).first()[0] or 0) - len(chosen)
    have = found.where(F.col("vec_id") % every == 0).agg(F.sum("n_links")).first()[0] or 0
    return have, total
