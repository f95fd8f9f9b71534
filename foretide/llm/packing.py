"""Packing documents into training sequences: shortest-pack-first over the length histogram.

Every document is cut into whole sequences and one remainder. One histogram of the remainders' lengths (a row for each
length under a sequence's) goes to the driver: lengths are placed longest first, each time into the pattern of packs with
the most room, and only the numbers of packs of each pattern change. Patterns are then joined back to the documents by the
rank of a document among those of its length: its place among them in its task's output, after those of the tasks before.
The number of patterns is bounded by that of lengths, so nothing at the driver or in a task grows with the corpus, and a
length, an id or a text that a third of all documents share is ranked in as many tasks as it was cut in.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foretide.llm.common import checkpointed, materialised, table, whole_text

#: The ranks hold the same vocabulary as the JSON, and give the same ids as the documented call of it, for which the strings of added tokens
#: are text like any other (encode_special_tokens = True). `added` names a JSON whose added tokens are ids of their own instead.
VOCABULARY = "byte_bpe_50k.tiktoken"
END = 1
SEQUENCE = 2048


class _Encoder:
    """Packed ids of whole texts. Nothing is remembered between texts: most distinct words of a corpus are met once, so that a table of
    words takes memory and more time than it saves."""

    def __init__(self, path: str, added: str | None) -> None:
        self.added: dict[str, bytes] = {}
        if added:
            with open(added, encoding="utf-8") as file:
                self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in json.load(file)["added_tokens"]}
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ids = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy

    def plain(self, text: str) -> bytes:
        return self.ids(text, disallowed_special=()).astype("<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if any(x in text for x in self.added):
            return b"".join(self.added.get(x) or self.plain(x) for x in self.cuts.split(text) if x)
        return self.plain(text)


_ENCODERS: dict[tuple[str, str | None], _Encoder] = {}
_PIECES = "doc_id long, start long, length long, doc_tokens long, ids_crc32 long, part long, place long, ids binary"


def _pieces(path: str, added: str | None, end: int, most: int):
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, added) not in _ENCODERS:
            _ENCODERS[path, added] = _Encoder(path, added)
        encoder, part, places = _ENCODERS[path, added], TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for doc, text in zip(batch.column(0).slice(at, 256).to_pylist(), batch.column(1).slice(at, 256).to_pylist(), strict=True):
                    ids = encoder.encode(text) + tail
                    for i in range(0, len(ids), 4 * most):
                        piece = ids[i : i + 4 * most]
                        length = len(piece) // 4
                        rows.append((doc, i // 4, length, len(ids) // 4, zlib.crc32(piece), part, places[length], piece))
                        places[length] += 1
                columns = zip(*rows, strict=True)
                kinds = [pa.int64()] * 7 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "length", "doc_tokens", "ids_crc32", "part", "place", "ids"])

    return run


def pack_lengths(histogram: dict[int, int], most: int = SEQUENCE) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of packs, (length, times) in each) of patterns that hold every length as often as the histogram says. A length
    makes three new patterns at most: packs of itself, a last one of those, and what is left of a pattern it fills in part."""
    room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)
    most_room: list[int] = []  # a heap of all rooms there may be

    def put(space: int, packs: int, held: list[tuple[int, int]]) -> None:
        if not room[space]:
            heapq.heappush(most_room, -space)
        room[space].append((packs, held))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while most_room and not room[-most_room[0]]:
                heapq.heappop(most_room)
            space = -most_room[0] if most_room else 0
            if space >= length:
                packs, held = room[space].pop()
                filled = min(packs, left)
                if packs > filled:
                    put(space, packs - filled, held)
                more = [*held[:-1], (length, held[-1][1] + 1)] if held[-1][0] == length else [*held, (length, 1)]
                put(space - length, filled, more)
                left -= filled
                continue
            each = min(most // length, left)
            put(most - each * length, left // each, [(length, each)])
            left %= each
    return [pack for held in room.values() for pack in held]


def _places(histogram: dict[int, int], most: int):
    """sequence, offset for each length and rank among the remainders of that length."""
    ranks: dict[int, int] = defaultdict(int)
    rows, first = [], 0
    for packs, held in pack_lengths(histogram, most):
        at = 0
        for length, times in held:
            rows.append((length, ranks[length], times, first, at))
            ranks[length] += packs * times
            at += length * times
        first += packs
    length, start, times, sequence, offset = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    firsts = {x: i for i, x in reversed(list(enumerate(length.tolist())))}

    @F.pandas_udf("struct<sequence:long,offset:long>")
    def place(lengths: pd.Series, of: pd.Series) -> pd.DataFrame:
        out = np.empty((2, len(lengths)), np.int64)
        for x, index in lengths.groupby(lengths).indices.items():
            rank, low = of.to_numpy()[index], firsts[x]
            slot = low + np.searchsorted(start[low : low + np.searchsorted(length[low:], x, "right")], rank, "right") - 1
            nth = rank - start[slot]
            out[0, index], out[1, index] = sequence[slot] + nth // times[slot], offset[slot] + nth % times[slot] * x
        return pd.DataFrame({"sequence": out[0], "offset": out[1]})

    return place


def pack(docs: DataFrame, path: str | None = None, end: int = END, most: int = SEQUENCE, added: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (little-endian
    unsigned 32-bit numbers).

    Each row of docs (doc_id, text; other columns are ignored) is one document, repeated rows and null doc_ids included;
    a null or empty text holds the end id alone. With `added`, the name of a JSON, the string of one of its added tokens (<|endoftext|>) is that
    token's id wherever it stands in a text; without, it is text like any other. Pieces of a sequence lie side by
    side from offset 0. Documents are cut every `most` ids only. Packed sequences have even ids, whole ones odd ids. An
    empty table gives an empty result.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    added = public_tokenizers.path(added) if added else None
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    pieces = materialised(texts.mapInArrow(_pieces(path, added, end, most), _PIECES))
    given = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    rest = pieces.filter(F.col("length") < most)
    tasks = checkpointed(rest.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r.length: r.n for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = rest.join(tasks.select("part", "length", before.alias("before")), ["part", "length"])
    packed = ranked.withColumn("at", _places(histogram, most)("length", F.col("before") + F.col("place")))
    packed = packed.select(*given, (F.col("at.sequence") * 2).alias("sequence_id"), "at.offset", "ids")
    whole = pieces.filter(F.col("length") == most)
    whole = whole.select(*given, (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids")
    return packed.unionByName(whole)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts are one piece of the end id alone; rows that repeat are documents of their own."""
    return pack(table(spark, sf_dir, "documents")).drop("ids")
