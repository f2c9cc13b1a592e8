"""Language identification by a byte convolutional network in numpy.

Bytes have embeddings; filters of several widths slide over fixed-length windows; each filter's maximum goes to a
softmax over languages.  Prediction tabulates the filters: a filter's value at a place is a sum of entries of
tables over byte pairs, so the whole text passes through look-ups, additions and maxima.  A text's score is the
mean of its windows' probabilities, weighted by their bytes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
WIDTHS, FILTERS, DIM, WINDOW = (2, 3, 4), 16, 8, 256
#: Bound of the labelled sample the network is trained on: rows in all, and code points of each text.
SAMPLE_ROWS, SAMPLE_LENGTH = 4000, 700
#: Byte that stands after the end of a text.
PAD = 0
PREDICTED = "doc_id long, lang_pred string, score double"


@dataclass
class Network:
    langs: list[str]
    embed: np.ndarray  # 256 x DIM
    filters: list[np.ndarray]  # width x DIM x FILTERS each
    dense: np.ndarray
    bias: np.ndarray


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


def windows_of(data: bytes, size: int = WINDOW) -> np.ndarray:
    """The whole text as rows of size bytes, the last one padded."""
    n = max(1, -(-len(data) // size))
    out = np.full(n * size, PAD, np.uint8)
    out[:len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, size)


def sample(labelled: DataFrame, rows: int = SAMPLE_ROWS, length: int = SAMPLE_LENGTH) -> list[tuple[str, str]]:
    """At most rows stretches of texts (lang, text), about evenly by language, of distinct texts chosen by a hash.

    A stretch of length code points begins at a hashed place of its text.  Copies of a text count once.
    Languages are counted first; a language of few texts gives all of them.  Null texts and labels are left out.
    Of more languages than rows, the network learns the rows most frequent ones, ties by name.  Equal texts are drawn
    alike, so repeated rows and the order of rows change nothing.
    """
    known = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = known.select("lang", F.xxhash64("text")).distinct().groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(rows).collect()
    if not counts:
        return []
    each = max(1, rows // len(counts))
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, 1.5 * each / r["count"] + 20 / r["count"]))))
    place = 1 + F.pmod(F.xxhash64("text"), F.greatest(F.lit(1), F.length("text") - length))
    drawn = known.select("lang", F.substring("text", place, F.lit(length)).alias("text"), (F.xxhash64(F.col("text"), F.lit(7)) / F.lit(float(2**64)) + 0.5).alias("u"))
    few = drawn.where(F.col("u") < F.try_element_at(share, F.col("lang"))).distinct().orderBy("u", "lang", "text").limit(2 * rows + 40 * len(counts)).collect()
    taken: dict[str, int] = {}
    out = []
    for r in few:
        if (n := taken.get(r["lang"], 0)) < each and len(out) < rows:
            taken[r["lang"]] = n + 1
            out.append((r["lang"], r["text"]))
    return out


def train(rows: Sequence[tuple[str, str]], epochs: int = 8, batch: int = 64, rate: float = 0.004, seed: int = 5) -> Network:
    """A network from (lang, text) rows.  Besides whole windows it sees short beginnings, since texts can be short."""
    langs = sorted({lang for lang, _ in rows})
    rng = np.random.default_rng(seed)
    data, labels = [], []
    for lang, text in rows:
        whole = text.encode("utf-8", "surrogatepass")
        for piece in (whole, whole[:int(rng.integers(8, 90))]):
            w = windows_of(piece)
            data.append(w)
            labels += [langs.index(lang)] * len(w)
    x, y = (np.concatenate(data), np.array(labels)) if data else (np.zeros((0, WINDOW), np.uint8), np.zeros(0, int))
    p = {"e": rng.normal(0, 0.3, (256, DIM)), "d": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, max(1, len(langs)))), "b": np.zeros(max(1, len(langs)))}
    p |= {f"w{w}": rng.normal(0, 1 / math.sqrt(w * DIM), (w, DIM, FILTERS)) for w in WIDTHS}
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for _ in range(epochs if len(langs) > 1 else 0):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
            xb, n = x[at], len(at)
            e = p["e"][xb]
            pooled, where = [], []
            for w in WIDTHS:
                span = WINDOW - w + 1
                z = sum(e[:, k:k + span] @ p[f"w{w}"][k] for k in range(w))
                where.append(z.argmax(axis=1))
                pooled.append(np.take_along_axis(z, where[-1][:, None, :], 1)[:, 0])
            h = np.concatenate(pooled, axis=1)
            s = h @ p["d"] + p["b"]
            s = np.exp(s - s.max(axis=1, keepdims=True))
            s /= s.sum(axis=1, keepdims=True)
            s[np.arange(n), y[at]] -= 1
            s /= n
            g = {"d": h.T @ s, "b": s.sum(axis=0), "e": np.zeros_like(p["e"])}
            back = s @ p["d"].T
            for i, w in enumerate(WIDTHS):
                gh, g[f"w{w}"] = back[:, i * FILTERS:(i + 1) * FILTERS], np.empty_like(p[f"w{w}"])
                for k in range(w):
                    seen = xb[np.arange(n)[:, None], where[i] + k]  # the byte each filter's maximum stands on
                    g[f"w{w}"][k] = np.einsum("nf,nfd->df", gh, p["e"][seen])
                    np.add.at(g["e"], seen.ravel(), (gh[:, :, None] * p[f"w{w}"][k].T[None]).reshape(-1, DIM))
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return Network(langs, p["e"], [p[f"w{w}"] for w in WIDTHS], p["d"], p["b"])


class Scorer:
    """The network with its filters tabulated over byte pairs."""

    def __init__(self, net: Network):
        self.net = net
        per = [[net.embed @ f[k] for k in range(len(f))] for f in net.filters]  # 256 x FILTERS for each place of a filter
        zero = np.zeros((256, FILTERS))
        self.tables = []
        for at in range(0, max(WIDTHS), 2):  # a filter takes part in a pair's table if it reaches that far
            own = [i for i, w in enumerate(WIDTHS) if w > at]
            pair = np.concatenate([(p[at][:, None, :] + (p[at + 1] if len(p) > at + 1 else zero)[None]).reshape(65536, FILTERS) for p in (per[i] for i in own)], axis=1)
            self.tables.append((at, own[0] * FILTERS, pair.astype(np.float32)))

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for rows of WINDOW bytes."""
        out = []
        for at in range(0, len(x), 64):
            b = np.pad(x[at:at + 64], ((0, 0), (0, 1)), constant_values=PAD).astype(np.int32)  # the last byte begins a pair too
            pairs = (b[:, :-1] << 8) | b[:, 1:]
            z = self.tables[0][2][pairs]
            for shift, first, table in self.tables[1:]:
                z[:, :-shift, first:] += table[pairs[:, shift:]]
            best = np.empty((len(b), len(WIDTHS) * FILTERS), np.float32)
            for i, w in enumerate(WIDTHS):
                best[:, i * FILTERS:(i + 1) * FILTERS] = z[:, :WINDOW - w + 1, i * FILTERS:(i + 1) * FILTERS].max(axis=1)
            s = best @ self.net.dense + self.net.bias
            s = np.exp(s - s.max(axis=1, keepdims=True))
            out.append(s / s.sum(axis=1, keepdims=True))
        return np.concatenate(out)

    def texts(self, texts: Sequence[str | None]) -> Iterator[tuple[str, float]]:
        """(language, score) of each whole text; UNKNOWN for null, and for texts without any letter."""
        held: list[np.ndarray] = []
        sizes: list[int] = []

        def flush():
            got, at = self.windows(np.concatenate(held)), 0
            for n in sizes:
                if n < 0:
                    yield UNKNOWN, 0.0
                    continue
                count = max(1, -(-n // WINDOW))
                weight = np.full(count, WINDOW, float)
                weight[-1] = n - (count - 1) * WINDOW
                mean = weight @ got[at:at + count] / weight.sum()
                at += count
                best = int(mean.argmax())
                yield self.net.langs[best], min(1.0, float(mean[best]))

        total = 0
        for text in texts:
            if not self.net.langs or text is None or not any(map(str.isalpha, text)):
                sizes.append(-1)
                held.append(np.zeros((0, WINDOW), np.uint8))
                continue
            data = text.encode("utf-8", "surrogatepass")
            sizes.append(len(data))
            held.append(windows_of(data))
            total += len(held[-1])
            if total >= 4096:
                yield from flush()
                held, sizes, total = [], [], 0
        if sizes:
            if total:
                yield from flush()
            else:
                yield from ((UNKNOWN, 0.0) for _ in sizes)


_MADE: dict[int, Scorer] = {}


def scorer(net: Network) -> Scorer:
    """The tables, built once in each worker process."""
    key = zlib.crc32(net.dense.tobytes() + net.embed.tobytes())
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Scorer(net)
    return _MADE[key]


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """docs' own columns, lang_pred and score (0 to 1) for every row; only text is looked at.

    Repeated rows each have their row, with the same prediction; of equally likely languages the first by name wins.
    """
    columns = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for at in range(0, batch.num_rows, 256):
                for name, score in scorer(net).texts(batch.column("text").slice(at, 256).to_pylist()):
                    names.append(name)
                    scores.append(score)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*columns, "lang_pred", "score"])

    schema = docs.select(*columns).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*columns).mapInArrow(run, schema)


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Network:
    """Trained on the labelled documents outside the held-out fold."""
    return train(sample(docs.where(~held_out(F.col("doc_id"))), rows))
