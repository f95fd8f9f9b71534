"""Byte-level BPE as a monoid.

The encoding of a text is built as a tree: a piece is cut in halves, the halves are encoded, and neighbours are joined by
encoding a window around their boundary anew. A token sequence is the encoding of its bytes exactly if every two
neighbouring tokens encode to themselves when taken together; so the window doubles on a side until the pair at that edge
does, and all tokens further out are then final. Pieces of the pre-tokenisation are joined by putting them in a row, and
decoding puts the bytes of ids in a row.

A word of any length ends: a window of n bytes takes n log n steps. Where windows reach the ends of their halves, as in a long
run of one letter, halves are alike, and the last two of each level of the tree are kept. The memory of a word is some hundred
bytes for each of its own.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretide.llm.common import table, whole_text

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: the characters of Unicode's White_Space property, which the pattern's \s stands for.
WHITE_SPACE = r"\t-\r \x85\xa0  -     　"
#: Encoded words and windows that a Python worker remembers; beyond it starts anew, so memory stays bounded.
REMEMBERED = 400_000
#: Bytes of a window beyond which merges are taken from a heap, and windows and halves are not remembered with others.
SHORT = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Words(dict):
    """Ids of what lies between two single spaces, with the space before it, by what lies there; filled as asked."""

    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.encoder = encoder
        self.older: dict[str, bytes] = {}

    def age(self) -> None:
        """What was asked for since the last time is kept once more; the rest is forgotten."""
        self.older = dict(self)
        self.clear()

    def __missing__(self, word: str) -> bytes:
        if (packed := self.older.pop(word, None)) is not None:
            self[word] = packed
            return packed
        if not word or word[0].isspace() or word[-1].isspace():
            raise NotApart
        packed = self.encoder.cut(" " + word)
        if len(word) <= 64:
            self[word] = packed
        return packed


class NotApart(Exception):
    """White space touches the space at which a text was to be cut."""


class Encoder:
    """Encodes texts by merge ranks; keeps what it has encoded."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.id_of = {b: i.to_bytes(4, "little") for b, i in ranks.items()}
        self.own = {b: b for b in ranks}
        inner = pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\S", f"[^{WHITE_SPACE}]").replace(r"\s", f"[{WHITE_SPACE}]")
        self.pieces = regex.compile(inner).findall
        self.known: dict[bytes, tuple[bytes, ...]] = {}
        self.words = Words(self)

    def merged(self, data: bytes) -> list[bytes]:
        """The merges one after the other, lowest rank first: for the few bytes of a window."""
        none, rank = 1 << 31, self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [rank(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pairs and (best := min(pairs)) < none:
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], none)
        return parts

    def merged_long(self, data: bytes) -> list[bytes]:
        """The same with the next merge from a heap, for long windows."""
        none, rank, n = 1 << 31, self.ranks.get, len(data)
        after, before, end = array("q", range(1, n + 1)), array("q", range(-1, n - 1)), array("q", range(1, n + 1))
        of = array("q", [rank(data[i : i + 2], none) for i in range(n - 1)] + [none])  # the rank of a part and the next one
        heap = [r << 40 | i for i, r in enumerate(of) if r < none]
        heapify(heap)
        while heap:
            best = heappop(heap)
            i = best & (1 << 40) - 1
            if of[i] != best >> 40:
                continue  # merged since
            gone = after[i]
            end[i], after[i], of[gone] = end[gone], after[gone], none
            if (k := after[i]) < n:
                before[k] = i
                of[i] = new = rank(data[i : end[k]], none)
                if new < none:
                    heappush(heap, new << 40 | i)
            else:
                of[i] = none
            if (k := before[i]) >= 0:
                of[k] = new = rank(data[k : end[i]], none)
                if new < none:
                    heappush(heap, new << 40 | k)
        out, at = [], 0
        while at < n:
            out.append(self.own[data[at : end[at]]])
            at = after[at]
        return out

    def window(self, tokens: tuple[bytes, ...]) -> tuple[bytes, ...]:
        data = b"".join(tokens)
        if len(data) > SHORT:
            return tuple(self.merged_long(data))
        if (found := self.known.get(data)) is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[data] = tuple(self.merged(data))
        return found

    def join(self, left: tuple[bytes, ...], right: tuple[bytes, ...]) -> tuple[bytes, ...]:
        """The encoding of both texts in a row, from their encodings."""
        i, j, seam = 1, 1, (left[-1], right[0])
        if (new := self.window(seam)) == seam:
            return left + right
        while True:
            at = len(left) - i
            stable_left = not at or self.window(seam := (left[at - 1], new[0])) == seam
            stable_right = j == len(right) or self.window(seam := (new[-1], right[j])) == seam
            if stable_left and stable_right:
                return left[:at] + new + right[j:]
            i = i if stable_left else min(2 * i, len(left))
            j = j if stable_right else min(2 * j, len(right))
            new = self.window(left[len(left) - i :] + right[:j])

    def tree(self, data: bytes, level: int = 0, recent: dict[int, list] | None = None) -> tuple[bytes, ...]:
        """recent: by level of the tree the last two long parts with their encodings."""
        if len(data) <= SHORT:
            if (found := self.known.get(data)) is not None:
                return found
            if len(data) <= 2:
                found = tuple(self.merged(data))
            else:
                half = len(data) // 2
                found = self.join(self.tree(data[:half]), self.tree(data[half:]))
            if len(data) <= 12:
                self.known[data] = found
            return found
        recent = {} if recent is None else recent
        for part, found in recent.get(level, ()):
            if part == data:
                return found
        half = len(data) // 2
        found = self.join(self.tree(data[:half], level + 1, recent), self.tree(data[half:], level + 1, recent))
        recent[level] = [*recent.get(level, [])[-1:], (data, found)]
        return found

    def cut(self, text: str) -> bytes:
        """The ids of a text, piece by piece, as little-endian unsigned 32-bit numbers."""
        out, whole, tokens = [], self.id_of.get, self.id_of.__getitem__
        for piece in self.pieces(text):
            data = piece.encode()
            out.append(whole(data) or b"".join(map(tokens, self.tree(data))))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """No piece of the pattern goes on behind a single space that stands between other characters: the text is cut
        there first. Texts with more white space in one place are cut by the pattern alone."""
        if len(self.words) > REMEMBERED // 2:
            self.words.age()
        if len(self.known) > REMEMBERED // 2:
            self.known.clear()
        first, *rest = text.split(" ")
        if rest and (not first or first[-1].isspace()):
            return self.cut(text)
        try:
            return self.cut(first) + b"".join(map(self.words.__getitem__, rest))
        except NotApart:
            return self.cut(text)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each vocabulary and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(read_ranks(path))
    return _ENCODERS[path]


def _mapped(path: str, name: str, method: str, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = getattr(encoder(path), method)
        for batch in batches:
            values = batch.column(batch.num_columns - 1)
            for at in range(0, len(values), 256):  # few texts at a time: a batch of very long ones isn't held twice
                part = [f(x) for x in values.slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(c.slice(at, 256) for c in batch.columns[:-1]), pa.array(part, kind)], [*batch.schema.names[:-1], name])

    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids: the ids of every whole text as little-endian unsigned 32-bit numbers in one binary value.

    One row for each row of docs (other columns are ignored), repeated rows included. A null or empty text gives no ids;
    an empty table an empty result.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(_mapped(path, "ids", "encode", pa.binary()), "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, decoded: the bytes that the ids stand for; no ids (or null) give no bytes."""
    path = path or public_tokenizers.path(VOCABULARY)
    return encoded.select("doc_id", "ids", F.coalesce("ids", F.lit(b"")).alias("to_decode")).mapInArrow(
        _mapped(path, "decoded", "decode", pa.binary()), "doc_id long, ids binary, decoded binary"
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null or empty text has no ids; rows that repeat are encoded alike."""
    both = decode(encode(table(spark, sf_dir, "documents")))
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
