"""Document fingerprints by one-permutation MinHash with optimal densification and packed low-order bits.

Each shingle is hashed once: the high bits choose a bin, a bin keeps its least value.  An empty bin takes the
value of the bin that its own sequence of hashed attempts first finds filled.  A fingerprint keeps the low
bits of every bin, packed and written in hex; likeness is the share of equal bins, freed of the share that
chance makes equal.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import U, mix, seeds, shingle_hashes, word_hashes

#: Pieces of the order for each shuffle partition, so that hashing deals them out evenly, and in all.
PER_PARTITION, PIECES = 4, 100_000
#: Bytes of text for one shuffle partition, of which there are more than the session asks for if the texts are many.
PARTITION_BYTES = 1 << 27
#: Ids by whose order pieces are cut, for each piece and in all: a sample by hash (16 MB on the driver).
SAMPLED_PER_PIECE, SAMPLED = 100, 2_000_000
NEIGHBOURS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


#: Rounds of attempts that a worker keeps; later ones, which a text of one shingle can need, are made anew.
KEPT_ROUNDS = 8192
_TABLE: dict[int, np.ndarray] = {}


def _attempts(bins: int, start: int, stop: int) -> np.ndarray:
    """Where each empty bin looks in the rounds from start to stop."""
    if stop <= KEPT_ROUNDS:
        if bins not in _TABLE:
            _TABLE[bins] = _look(bins, 0, KEPT_ROUNDS)
        return _TABLE[bins][start:stop]
    return _look(bins, start, stop)


def _look(bins: int, start: int, stop: int) -> np.ndarray:
    z = mix(np.arange(bins, dtype=U)[None, :] * U(0x9E3779B97F4A7C15) + seeds(stop, 11)[start:, None])
    return (((z >> U(32)) * U(bins)) >> U(32)).astype(np.int32)


def densify(values: np.ndarray) -> np.ndarray:
    """values with every empty bin (all ones) filled from the bin its attempts find; at least one bin is filled.

    Each span of rounds is four times as long as the one before and looks at the bins still empty.
    """
    filled = values != ~U(0)
    empty, out, start, stop = np.flatnonzero(~filled), values.copy(), 0, 8
    while len(empty):
        looked = _attempts(len(values), start, stop)[:, empty]
        hit = filled[looked]
        first = hit.argmax(axis=0)
        every = np.arange(len(empty))
        found = hit[first, every]
        out[empty[found]] = values[looked[first[found], every[found]]]
        empty, start, stop = empty[~found], stop, 4 * stop
    return out


def low_bits(texts: list[str | None], words: int, bins: int, bits: int) -> list[np.ndarray | None]:
    """For each text the low bits of its bins; None for one without words."""
    out: list[np.ndarray | None] = []
    own = np.arange(bins, dtype=U) * U(0xD6E8FEB86659FD93)
    for _, _, hashes, counts in word_hashes(texts):
        shingles = shingle_hashes(hashes, counts, words)
        sizes = [len(s) for s in shingles]
        every = mix(np.concatenate(shingles) ^ U(0x2545F4914F6CDD1D)) if sum(sizes) else hashes[:0]
        flat = np.repeat(np.arange(len(sizes)) * bins, sizes) + (((every >> U(32)) * U(bins)) >> U(32)).astype(np.intp)
        least = np.full(len(sizes) * bins, ~U(0), U)
        np.minimum.at(least, flat, mix(every) >> U(1))
        for k, size in enumerate(sizes):
            # Bins that share a value give bits of their own, so that two values which differ are told apart by many bins.
            out.append((mix(densify(least[k * bins:(k + 1) * bins]) ^ own) & U((1 << bits) - 1)).astype(np.uint8) if size else None)
    return out


def pack(values: np.ndarray | None, bits: int) -> str:
    """Hex of the packed low bits; empty for None."""
    if values is None:
        return ""
    each = np.unpackbits(values[:, None], axis=1)[:, 8 - bits:]
    return np.packbits(each.ravel()).tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None, bits: int) -> float:
    """An estimate of the shingle sets' Jaccard similarity, 0 to 1; two texts without words are alike."""
    if a is None or b is None:
        return float(a is b)
    chance = 0.5 ** bits
    return min(1.0, max(0.0, (float((a == b).mean()) - chance) / (1 - chance)))


def fingerprint(docs: DataFrame, words: int = 5, bins: int = 512, bits: int = 4) -> DataFrame:
    """doc_id and fingerprint for every row; a null text counts as empty, and a text without words has an empty one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [pack(v, bits) for v in low_bits(b.column(1).to_pylist(), words, bins, bits)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def _search(splits: Column, count: int, x: Column, strict: bool) -> Column:
    """How many of the sorted splits are less than x (or at most x), by bisection."""
    def halve(at, _):
        mid = F.floor((at.lo + at.hi) / 2).cast("int")
        here = F.element_at(splits, mid + 1)
        below = (at.lo < at.hi) & ((here < x) if strict else (here <= x))
        return F.struct(F.when(below, mid + 1).otherwise(at.lo).alias("lo"), F.when(below | (at.lo >= at.hi), at.hi).otherwise(mid).alias("hi"))

    if not count:
        return F.lit(0)
    # One more split than there are keeps element_at within bounds; it is never reached as lo < hi fails first.
    steps = F.sequence(F.lit(1), F.lit(math.ceil(math.log2(count + 1)) + 1))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(count).alias("hi")), halve, lambda at: at.lo)


def _ranged(docs: DataFrame, parts: int, known: int, rows: int) -> DataFrame:
    """docs (doc_id, text) with pid and h: in order of (pid, doc_id, h, text) the rows are in order of doc_id, nulls first.

    Pieces are cut at quantiles of a sample of doc_id, which decides only how even they are; an id that very many rows
    share, null too, is cut by the texts' hash.
    """
    ids = F.col("doc_id")
    share = min(1.0, min(SAMPLED, SAMPLED_PER_PIECE * parts) / max(1, known))
    drawn = docs.where(ids.isNotNull() & (F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(1 << 30)) < share * (1 << 30))).select("doc_id")
    order = sorted(r[0] for r in drawn.limit(2 * SAMPLED).collect())
    splits = [order[k * len(order) // parts] for k in range(1, parts)] if order else []
    low = F.from_json(F.lit(json.dumps([*splits, (1 << 63) - 1])), "array<long>")  # one constant, however many there are
    u = F.col("h") / F.lit(float(2**64)) + F.lit(0.5)
    less, most = _search(low, len(splits), ids, True), _search(low, len(splits), ids, False)
    spread = F.least(F.floor(u * (F.col("_most") - F.col("_less") + 1)), F.col("_most") - F.col("_less"))
    nulls = max(1, math.ceil(parts * (rows - known) / rows)) if rows else 1
    empty = F.least(F.floor(u * nulls), F.lit(nulls - 1)) - nulls
    hashed = docs.withColumn("h", F.xxhash64("text")).withColumn("_less", less).withColumn("_most", most)
    return hashed.withColumn("pid", F.when(ids.isNull(), empty).otherwise(F.col("_less") + spread).cast("long")).drop("_less", "_most")


def _pairs(words: int, bins: int, bits: int):
    def edit(text: str, following: str) -> str:
        half = len(text) // 2
        return text[:len(text) - half] + following[:half]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                tails, ids, texts = (part.column(k).to_pylist() for k in range(3))
                texts = [x or "" for x in texts]
                rows = list(zip(tails, ids, texts, low_bits(texts, words, bins, bits), strict=True))
                if held:
                    rows.insert(0, held)
                held = rows[-1]
                mine = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[0]]
                edits = [edit(a[2], b[2]) for a, b in mine]
                out = []
                for (a, b), text, bits_of in zip(mine, edits, low_bits(edits, words, bins, bits), strict=True):
                    out.append((a[1], len(a[2]), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), pack(a[3], bits), pack(bits_of, bits), likeness(a[3], bits_of, bits), likeness(a[3], b[3], bits)))
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in NEIGHBOURS.split(", ")])

    return run


def neighbours(docs: DataFrame, words: int = 5, bins: int = 512, bits: int = 4, parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like the first is to that and to the next text's.

    The next row is that of the next doc_id (nulls first; equal ids by their texts' hash, then text), after the
    last row the first.  A null text counts as empty.  Repeated rows are rows of their own.  Texts are shuffled
    once: each piece of the order also gets a copy of the row that follows its last one.
    """
    spark = docs.sparkSession
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known, count, size = read.agg(F.count("doc_id"), F.count("*"), F.sum(F.octet_length("text"))).first()
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((size or 0) / PARTITION_BYTES))
    parts = parts or min(PIECES, PER_PARTITION * partitions)
    rows = _ranged(read, parts, known, count).withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    # One row per piece, of which there are PIECES at most.
    heads = sorted(rows.groupBy("pid").agg(F.min(F.struct("key", "h")).alias("first")).select("pid", "first.key", "first.h").collect())
    if not heads:
        return spark.createDataFrame([], NEIGHBOURS)
    copies = spark.createDataFrame([(*r, heads[k - 1][0]) for k, r in enumerate(heads)], "pid long, key long, h long, before long")
    to = F.array(F.struct("pid", F.lit(False).alias("tail")), F.struct(F.col("before").alias("pid"), F.lit(True).alias("tail")))
    copied = rows.join(F.broadcast(copies), ["pid", "key", "h"], "left").withColumn("to", F.explode(F.filter(to, lambda x: x.pid.isNotNull())))
    dealt = copied.select(F.col("to.pid").alias("pid"), F.col("to.tail").alias("tail"), "doc_id", "h", "text")
    ordered = dealt.repartition(partitions, "pid").sortWithinPartitions("pid", "tail", "doc_id", "h", "text")
    return ordered.select("tail", "doc_id", "text").mapInArrow(_pairs(words, bins, bits), NEIGHBOURS)
