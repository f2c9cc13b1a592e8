"""SentencePiece BPE encoding and decoding by a Viterbi search over a trie of marked words.

A sequence of pieces is the BPE encoding of its text exactly if every two neighbours are encoded as those two
when they stand alone.  So the search only admits such neighbours, one path survives at every place, and the
forward state of a prefix - its survivor's last piece - is the same in every word with that prefix.  The
distinct marked words of a batch are sorted, which visits their trie depth-first; each word takes over the
states of the prefix it shares with the word before.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Encoded words that a worker keeps, and pairs of pieces it remembers a verdict on.
KEPT_WORDS, KEPT_PAIRS = 160_000, 400_000


class Encoder:
    def __init__(self, model: bytes):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(self.lib.vocab_size())
        byte = {i for i in ids if self.lib.is_byte(i)}
        own = {i for i in ids if not (i in byte or self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_unused(i))}
        self.vocab = {self.lib.id_to_piece(i): i for i in own}
        self.score = {p: self.lib.get_score(i) for p, i in self.vocab.items()}
        self.longest = max(map(len, self.vocab), default=1)
        self.byte_id = {int(self.lib.id_to_piece(i)[3:5], 16): i for i in byte}
        self.unknown = self.lib.unk_id()
        self.surface = [bytes([int(self.lib.id_to_piece(i)[3:5], 16)]) if i in byte else self.lib.id_to_piece(i).replace(MARK, " ").encode() if i in own else b"" for i in ids]
        if self.unknown >= 0:
            self.surface[self.unknown] = " ⁇ ".encode()
        known = set("".join(self.vocab))
        # Blanks start words, unless some piece holds a mark behind something else; a line break is a word if no piece holds it.
        inside = any(MARK in p.lstrip(MARK) for p in self.vocab)
        self.words = re.compile(f"(?s).+" if inside else f"{MARK}*[^{MARK}]+|{MARK}+" if "\n" in known else f"\n|{MARK}*[^{MARK}\n]+|{MARK}+").findall
        # What the model's own normalizer does to a text; for the plain one the mark and blanks suffice.
        probe = " éÁ Ａ\n  x "
        self.plain = self.lib.normalize(probe) == MARK + probe.replace(" ", MARK)
        self.names = ["", *self.vocab]
        self.number = {p: n for n, p in enumerate(self.names) if n}
        self.pairs: dict[int, bool] = {}
        self.bytes_of = {p: i.to_bytes(4, "little", signed=True) for p, i in self.vocab.items()}
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, text: str) -> list[str]:
        """BPE of a short text: the best-scored adjacent pair is merged, the first of equals, until none is a piece."""
        parts = list(text)
        while len(parts) > 1:
            best = max((self.score[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score) if any(a + b in self.score for a, b in zip(parts, parts[1:], strict=False)) else None
            if best is None:
                break
            k = -best[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def admits(self, left: int, right: int) -> bool:
        """Whether the piece numbered right can follow left (0 at the beginning)."""
        key = left << 32 | right
        if (said := self.pairs.get(key)) is None:
            if len(self.pairs) > KEPT_PAIRS:
                self.pairs.clear()
            a, b = self.names[left], self.names[right]
            said = self.pairs[key] = self.merge(a + b) == ([a, b] if a else [b])
        return said

    def numbered(self, char: str) -> int:
        """The number of a character that is no piece."""
        if (n := self.number.get(char)) is None:
            n = self.number[char] = len(self.names)
            self.names.append(char)
        return n

    def packed(self, piece: str) -> bytes:
        """The ids of a piece; a character that is none becomes its bytes, or unknown if the model has no bytes."""
        if (held := self.bytes_of.get(piece)) is None:
            ids = [self.byte_id[b] for b in piece.encode("utf-8", "surrogatepass")] if self.byte_id else [self.unknown]
            held = b"".join(i.to_bytes(4, "little", signed=True) for i in ids)
        return held

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, list[str]]]:
        """The pieces of each word; words are sorted, so that each shares its beginning with the one before.

        A word to which no path leads, which a model of other scores could have, is merged by itself.
        """
        last, start, before = [0], [0], ""
        number, admits, pairs, names, longest = self.number.get, self.admits, self.pairs.get, self.names, self.longest
        for word in words:
            n, most = 0, min(len(before), len(word))
            while n < most and before[n] == word[n]:
                n += 1
            del last[n + 1:], start[n + 1:]
            for end in range(n + 1, len(word) + 1):
                for at in range(end - 1, max(-1, end - 1 - longest), -1):
                    piece = number(word[at:end]) or (self.numbered(word[at]) if at == end - 1 else 0)
                    if piece:
                        said = pairs(last[at] << 32 | piece)
                        if said if said is not None else admits(last[at], piece):
                            last.append(piece)
                            start.append(at)
                            break
                else:
                    break
            if len(last) <= len(word):
                yield word, self.merge(word)
                before = word[:len(last) - 1]
                continue
            parts, at = [], len(word)
            while at:
                parts.append(names[last[at]])
                at = start[at]
            yield word, parts[::-1]
            before = word

    def marked(self, text: str) -> str:
        return (MARK + text.replace(" ", MARK) if text else "") if self.plain else self.lib.normalize(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit numbers in a row."""
        cut = [self.words(self.marked(t)) for t in texts]
        if len(self.kept) > KEPT_WORDS:  # words not met since the last time go
            self.kept, self.older = {}, self.kept
        kept, older = self.kept, self.older
        new = []
        for word in set().union(*cut).difference(kept):
            if (held := older.get(word)) is None:
                new.append(word)
            else:
                kept[word] = held
        new.sort()
        for word, parts in self.encode_words(new):
            kept[word] = b"".join(map(self.packed, parts))
        return [b"".join(map(kept.__getitem__, words)) for words in cut]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


_MADE: dict[int, Encoder] = {}


def encoder(model: bytes) -> Encoder:
    """One encoder for each model in a worker process."""
    key = hash(model)
    if key not in _MADE:
        _MADE[key] = Encoder(model)
    return _MADE[key]


def _encoded(coder: Encoder, column: pa.Array) -> pa.Array:
    rows = coder.encode([x or "" for x in column.to_pylist()])
    offsets = np.cumsum([0, *(len(r) // 4 for r in rows)]).astype(np.int32)
    values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(rows))])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _decoded(coder: Encoder, column: pa.Array) -> pa.Array:
    # One row at a time, so that only one text's numbers are Python objects; a null row has no stretch of its own.
    values, ends, there = column.values.to_numpy(zero_copy_only=False), column.offsets.to_pylist(), column.is_valid().to_pylist()
    values = np.where((values >= 0) & (values < len(coder.surface)), values, coder.unknown)
    return pa.array([coder.decode(values[a:b].tolist()) if here else "" for a, b, here in zip(ends, ends[1:], there, strict=False)], pa.string())


def _run(docs: DataFrame, model: str, *steps: tuple) -> DataFrame:
    """docs with a column for each of the steps (source, added, type, work), all in one pass over the rows."""
    with open(model, "rb") as f:  # the driver's file; the workers get its bytes
        held = docs.sparkSession.sparkContext.broadcast(f.read())
    columns = [c for c in docs.columns if c not in {added for _, added, _, _ in steps}]
    schema = docs.select(*columns).schema
    for _, added, kind, _ in steps:
        schema = schema.add(added, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = {c: part.column(c) for c in columns}
                for source, added, _, work in steps:
                    made[added] = work(encoder(held.value), made[source])
                yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))

    return docs.select(*columns).mapInArrow(run, schema)


def encode(docs: DataFrame, model: str = MODEL, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with ids, the pieces of each whole text; a null text has none, like an empty one.  No beginning or end mark is added.  Repeated rows each have their row."""
    return _run(docs, model, (text, ids, ArrayType(IntegerType()), _encoded))


def decode(docs: DataFrame, model: str = MODEL, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """docs with the text that ids stand for; null ids have an empty one, and ids out of range are unknown pieces."""
    return _run(docs, model, (ids, text, StringType(), _decoded))


def encode_and_decode(docs: DataFrame, model: str = MODEL, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """What decode makes of what encode makes of docs, in one pass: the ids don't leave the worker in between."""
    return _run(docs, model, (text, ids, ArrayType(IntegerType()), _encoded), (ids, decoded, StringType(), _decoded))
