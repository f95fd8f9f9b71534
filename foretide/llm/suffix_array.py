"""Suffix array dedup of repeated 200-byte strings.

A string that stands in two places has the same content-defined anchor in both: of all its 64-byte pieces the one with the
smallest hash. Every text is cut by the anchors of its windows of 200 bytes (one anchor per some 70 bytes), and only windows
whose anchor occurs in several places can be repeated. Where all occurrences of an anchor lie in the same surroundings, all
windows at them are repeated, and no byte has to move. Where the surroundings differ, they are brought together by anchor, and
a suffix array tells which suffixes agree on 200 bytes with a neighbour. It is built by linear grouping: suffixes are
grouped by their Lyndon prefixes from the highest group to the lowest, by pointers to the previous smaller suffix, and each
group's order is then read off from left to right, without renaming or recursion.

An anchor that occurs more often than a task should hold is treated window by window: hashes of its windows are counted with
partial sums. Both ways are exact and cover all occurrences.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretide.llm.common import at_driver, materialised, table, whole_text

LENGTH = 200
PIECE = 64
#: Occurrences of an anchor that may meet in one task.
TOGETHER = 256
#: Bits of the filters of anchor hashes: three arrays of 16 MB at most, whatever the size of the corpus.
FILTER_BITS = 27
#: Symbols that are sorted at a time.
SORTED = 60_000
#: Longest slice that is hashed at a time; positions in it take 24 bits.
SLICE = 1 << 22

_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64(0xFFFFFF)


# Suffix sorting.


def suffix_array(text: list[int]) -> list[int]:
    """The suffixes of text in order. Its last symbol must be smaller than all others and occur once."""
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, group, size = [0] * n, [0] * n, [0] * n
    start = 0
    for at, i in enumerate(order):
        if at and text[i] != text[order[at - 1]]:
            start = at
        place[i], group[i] = at, start
        size[start] += 1
    prev = [-1] * n
    high = n - 1
    while high >= 0:  # groups from the highest; a group is known by its first place
        low = group[order[high]]
        members = order[low : high + 1]
        if len(members) > 1:
            members.sort()
        pointed: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= low:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if len(pointed) == 1:
            parts = [list(pointed)]
        else:
            by_count: dict[int, list[int]] = {}
            for p, count in pointed.items():
                by_count.setdefault(count, []).append(p)
            parts = [by_count[c] for c in sorted(by_count, reverse=True)]
        for part in parts:  # those with most followers rise furthest
            risen: dict[int, int] = {}
            for p in part:
                g = group[p]
                up = risen.get(g, 0) + 1
                risen[g] = up
                to = g + size[g] - up
                at, other = place[p], order[to]
                order[at], order[to] = other, p
                place[other], place[p] = at, to
            for g, up in risen.items():
                if up < size[g]:
                    new = g + size[g] - up
                    size[g] -= up
                    size[new] = up
                    for at in range(new, new + up):
                        group[order[at]] = new
        high = low - 1
    done = [False] * n
    free = list(range(n))
    out = [-1] * n
    out[0] = n - 1
    done[n - 1] = True
    for at in range(n):
        j = out[at] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = True
            j = prev[j]
    return out


def common_prefixes(text: list[int], order: list[int]) -> list[int]:
    """For each place but the first, the symbols that its suffix has in common with the one before it."""
    n = len(text)
    rank = [0] * n
    for at, i in enumerate(order):
        rank[i] = at
    out, same = [0] * n, 0
    for i in range(n):
        if not rank[i]:
            same = 0
            continue
        j = order[rank[i] - 1]
        while i + same < n and j + same < n and text[i + same] == text[j + same]:
            same += 1
        out[rank[i]] = same
        same = max(0, same - 1)
    return out


# Anchors.


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            all_of = np.full(max(n, 2 * len(_POWERS[0])), base, np.uint64)
            all_of[0] = 1
            _POWERS[i] = np.multiply.accumulate(all_of)
    return _POWERS[0], _POWERS[1]


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _sums(data: np.ndarray) -> np.ndarray:
    power, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=out[1:])
    return out


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` values in a row."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    to_left = np.minimum.accumulate(blocks, axis=1).ravel()
    to_right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(to_right[: n - width + 1], to_left[width - 1 : n])


def anchors(data: bytes, length: int = LENGTH, piece: int = PIECE) -> list[np.ndarray]:
    """Hash, first window, last window, place of the anchor, and a hash of the surroundings, for each run of windows with
    the same anchor. The anchor is the first of the pieces in a window whose hash is smallest."""
    parts: list[list[np.ndarray]] = []
    for at in range(0, max(1, len(data) - length + 1), SLICE):
        x = np.frombuffer(data, np.uint8)[at : at + SLICE + length - 1]
        if len(x) < length:
            continue
        sums = _sums(x)
        _, inverse = _powers(len(x) + 1)
        hashes = _mixed((sums[piece:] - sums[:-piece]) * inverse[: len(x) - piece + 1])
        packed = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
        where = (_least(packed, length - piece + 1) & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        last = np.concatenate([first[1:], [len(where)]]) - 1
        place = where[first]
        around = (sums[last + length] - sums[first]) * inverse[first]
        around = _mixed(around ^ _mixed(((last - first) * 1024 + place - first).astype(np.uint64) * np.uint64(_BASE)))
        parts.append([hashes[place], first + at, last + at, place + at, around])
    if not parts:
        return [np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3, np.zeros(0, np.uint64)]
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def _all_anchors(length: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                found = [anchors(t.encode("utf-8", "surrogatepass"), length, piece) for t in batch.column(0).slice(at, 128).to_pylist()]
                h, around = (np.concatenate([f[i] for f in found]).view(np.int64) for i in (0, 4))
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(around)], ["hash", "around"])

    return run


def repeated_anchors(texts: DataFrame, length: int = LENGTH, piece: int = PIECE) -> DataFrame:
    """hash, n, mixed (the surroundings differ) of the anchors that occur more than once."""
    rows = texts.select("text").mapInArrow(_all_anchors(length, piece), "hash long, around long")
    seen = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("around").alias("low"), F.max("around").alias("high"))
    return materialised(seen.filter("n > 1").select("hash", "n", (F.col("low") != F.col("high")).alias("mixed")))


def _filters(repeated: DataFrame, together: int, bits: int) -> bytes:
    """Bit arrays of the hashes that are repeated, mixed, and frequent, compressed. The driver gets at most 2^bits / 64 words
    of each, a task's at a time."""
    at = F.col("hash").bitwiseAND(F.lit((1 << bits) - 1))
    bit = F.expr("shiftleft(1L, CAST(hash & 63 AS INT))")
    kinds = [F.lit(True), F.col("mixed"), F.col("n") > together]
    words = repeated.groupBy(F.shiftright(at, 6).alias("word")).agg(*[F.bit_or(F.when(k, bit).otherwise(F.lit(0).cast("long"))).alias(f"k{i}") for i, k in enumerate(kinds)])
    held = np.zeros((len(kinds), 1 << (bits - 6)), np.int64)
    for word, *values in at_driver(words):
        held[:, word] = values
    return zlib.compress(held.tobytes(), 1)


@lru_cache(maxsize=1)
def _bit_arrays(filters: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(filters), np.int64).reshape(3, -1)


_FOUND = "doc_id long, same long, hash long, around long, first long, last long, place long, route int, context binary"


def _repeated(filters: bytes, bits: int, length: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = _bit_arrays(filters)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                columns: list[list] = [[] for _ in range(9)]
                for doc, same, text in zip(*(batch.column(i).slice(at, 128).to_pylist() for i in range(3)), strict=True):
                    data = text.encode("utf-8", "surrogatepass")
                    h, first, last, place, around = anchors(data, length, piece)
                    h = h.view(np.int64)
                    word, bit = (h & ((1 << bits) - 1)) >> 6, h & 63
                    held = [(f[word] >> bit) & 1 for f in arrays]
                    kept = np.flatnonzero(held[0])
                    # What is frequent must not meet in one task, be it mixed or only taken for mixed by its low bits.
                    route = (held[1] * (1 + held[2]))[kept].tolist()
                    n = len(kept)
                    a, b = first[kept].tolist(), last[kept].tolist()
                    contexts = [data[x : y + length] if r else None for x, y, r in zip(a, b, route, strict=True)]
                    near = [x if r == 2 else None for x, r in zip(around.view(np.int64)[kept].tolist(), route, strict=True)]
                    for c, values in zip(columns, ([doc] * n, [same] * n, h[kept].tolist(), near, a, b, place[kept].tolist(), route, contexts), strict=True):
                        c += values
                kinds = [*[pa.int64()] * 7, pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "same", "hash", "around", "first", "last", "place", "route", "context"])

    return run


# Anchors in different surroundings: suffix arrays.


def _agree(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())


def _reach(strings: list[bytes], often: list[bool]) -> list[int]:
    """The bytes from its start that each string has in common with any other."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    out = [len(s) if o else 0 for s, o in zip(strings, often, strict=True)]
    for a, b in zip(order, order[1:], strict=False):
        same = _agree(strings[a], strings[b])
        out[a], out[b] = max(out[a], same), max(out[b], same)
    return out


class _Sorter:
    """Gathers the strings around anchors, sorts the suffixes of many at a time, and gives the windows that are repeated."""

    def __init__(self, length: int, piece: int) -> None:
        self.length, self.piece = length, piece
        self.anchors: list[list[tuple[bytes, int, list[tuple]]]] = []
        self.symbols = 0

    def add(self, rows: list[tuple]) -> Iterator[tuple]:
        """rows: (doc_id, same, first, place, context) of all occurrences of one anchor."""
        held: dict[tuple[int, bytes], list[tuple]] = defaultdict(list)
        for doc, same, first, place, context in rows:
            held[place - first, context].append((doc, same, first))
        often = [len(x) > 1 for x in held.values()]
        left = _reach([c[:rel][::-1] for rel, c in held], often)
        right = _reach([c[rel:] for rel, c in held], often)
        strings: dict[tuple[int, bytes], list[tuple]] = defaultdict(list)
        for ((rel, context), occurrences), a, b in zip(held.items(), left, right, strict=True):
            if a + b >= self.length:  # no window reaches beyond what agrees with some other occurrence
                strings[a, context[rel - a : rel + b]] += [(doc, same, first + rel - a) for doc, same, first in occurrences]
        if len(strings) > 1:
            self.anchors.append([(s, rel, x) for (rel, s), x in strings.items()])
            self.symbols += sum(len(s) - self.piece + 2 for s, _, _ in self.anchors[-1])
        for (_, s), occurrences in strings.items():
            if len(occurrences) > 1:
                yield from ((doc, same, at, at + len(s)) for doc, same, at in occurrences)
        if self.symbols >= SORTED:
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        """The piece at the anchor is part of every window and stands as one symbol, which only its own strings share."""
        if not self.anchors:
            return
        text: list[int] = []
        starts: list[tuple[int, str, int, list[tuple]]] = []
        ends, mark = sum(map(len, self.anchors)), 0
        for number, strings in enumerate(self.anchors):
            for s, rel, occurrences in strings:
                starts.append((len(text), s, rel, occurrences))
                mark += 1
                text += [x + ends + 1 for x in s[:rel]]
                text.append(ends + 257 + number)
                text += [x + ends + 1 for x in s[rel + self.piece :]]
                text.append(mark)  # ends differ, so that nothing agrees beyond them
        text.append(0)
        order = suffix_array(text)
        same = np.array([*common_prefixes(text, order), 0])
        agree = np.zeros(len(text), np.int64)
        agree[np.array(order)] = np.maximum(same[:-1], same[1:])
        for at, s, rel, occurrences in starts:
            if len(occurrences) > 1:
                continue
            # A suffix from the left of the anchor agrees on its symbols, one of which stands for a whole piece.
            of = agree[at : at + rel + 1]
            spans = of + np.where(of > rel - np.arange(rel + 1), self.piece - 1, 0)
            hit = np.flatnonzero(spans >= self.length)
            for run in np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1) if len(hit) else []:
                yield from ((doc, key, first + int(run[0]), first + int(run[-1]) + self.length) for doc, key, first in occurrences)
        self.anchors, self.symbols = [], 0


_COVER = "doc_id long, same long, start long, stop long"


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _sort_suffixes(length: int, piece: int):
    """Of rows that come in order of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorter, now, held, names = _Sorter(length, piece), None, [], ["doc_id", "same", "start", "stop"]
        for batch in batches:
            out: list[tuple] = []
            for hash_, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if hash_ != now:
                    out += sorter.add(held) if held else []
                    now, held = hash_, []
                held.append(tuple(row))
            if out:
                yield _batch(out, names)
        yield _batch([*(sorter.add(held) if held else []), *sorter.flush()], names)

    return run


# Anchors that occur very often: windows by their hashes.


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                hashes, arounds, offsets, windows, times = [], [], [], [], []
                for h, around, rel, n, context in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    sums = _sums(np.frombuffer(context, np.uint8))
                    count = len(context) - length + 1
                    _, inverse = _powers(len(context) + 1)
                    of = _mixed((sums[length:] - sums[:-length]) * inverse[:count]).view(np.int64)
                    hashes.append(np.full(count, h))
                    arounds.append(np.full(count, around))
                    offsets.append(np.arange(count) - rel)
                    windows.append(of)
                    times.append(np.full(count, n))
                if hashes:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hashes, arounds, offsets, windows, times)], ["hash", "around", "offset", "window", "n"])

    return run


def _often(found: DataFrame, length: int) -> DataFrame:
    """What is covered at anchors that occur very often. Equal surroundings count once, with their number."""
    frequent = found.filter("route = 2")
    kinds = frequent.groupBy("hash", "around").agg(F.max(F.col("place") - F.col("first")).alias("rel"), F.count(F.lit(1)).alias("n"), F.max("context").alias("context"))
    windows = materialised(kinds).mapInArrow(_windows(length), "hash long, around long, offset long, window long, n long")
    shared = windows.groupBy("hash", "offset", "window").agg(F.sum("n").alias("n")).filter("n > 1").drop("n")
    hit = windows.drop("n").join(materialised(shared), ["hash", "offset", "window"])
    hit = materialised(hit.groupBy("hash", "around").agg(F.sort_array(F.collect_list("offset")).alias("offsets")))
    back = frequent.drop("context").join(hit, ["hash", "around"])
    edges = F.filter("offsets", lambda o: ~F.array_contains("offsets", o - 1)), F.filter("offsets", lambda o: ~F.array_contains("offsets", o + 1))
    runs = back.select("doc_id", "same", "place", F.explode(F.arrays_zip(edges[0].alias("a"), edges[1].alias("b"))).alias("run"))
    return runs.select("doc_id", "same", (F.col("place") + F.col("run.a")).alias("start"), (F.col("place") + F.col("run.b") + length).alias("stop"))


def covered(docs: DataFrame, length: int = LENGTH, piece: int = PIECE, together: int = TOGETHER, bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, same (a hash of the text), start, stop: byte ranges, which may overlap, of the strings of `length` bytes
    that also start elsewhere."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("same"), whole_text().alias("text"))
    repeated = repeated_anchors(texts, length, piece)
    found = materialised(texts.mapInArrow(_repeated(_filters(repeated, together, bits), bits, length, piece), _FOUND))
    plain = found.filter("route = 0").join(repeated.select("hash"), "hash").select("doc_id", "same", F.col("first").alias("start"), (F.col("last") + length).alias("stop"))
    few = found.filter("route = 1").select("hash", "doc_id", "same", "first", "place", "context")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(few.count() / 20_000))
    sorted_ = few.repartition(tasks, "hash").sortWithinPartitions("hash").mapInArrow(_sort_suffixes(length, piece), _COVER)
    return plain.unionByName(sorted_).unionByName(_often(found, length))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of whole documents are shuffled once, and compressed for it."""
    compress = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            data = [compress(t.encode("utf-8", "surrogatepass")) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(data, pa.binary())], ["doc_id", "key", "data"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    expand = zstandard.ZstdDecompressor().decompress
    spans_of = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part, spans, kept, n_bytes = batch.slice(at, 128), [], [], []
            for packed, ranges in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                data, merged = expand(packed), []
                for r in sorted((r["start"], r["stop"]) for r in ranges or []):
                    if merged and r[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], r[1])
                    else:
                        merged.append(list(r))
                edges = [0, *[x for m in merged for x in m], len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                spans.append([{"start": a, "stop": b} for a, b in merged])
                n_bytes.append(len(data))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_bytes, pa.int64()), pa.array(spans, spans_of), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, piece: int = PIECE, together: int = TOGETHER, bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, n_bytes, spans (array of start, stop in bytes: the maximal removed runs), kept (the other bytes) for each row
    of docs (doc_id, text; other columns are ignored).

    Texts are UTF-8 bytes; null is empty. A byte goes if a string of `length` bytes over it also starts anywhere else, in
    the same text or another row; rows that repeat a doc_id or all of a row are places of their own. Strings never reach
    over the end of a text, and an empty table gives an empty result.
    """
    ranges = covered(docs, length, piece, together, bits)
    ranges = ranges.groupBy("same", "doc_id").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))
    # Equal rows get equal ranges, so that a null doc_id may meet itself as well.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("key"), whole_text().alias("text"))
    texts = texts.mapInArrow(_packed, "doc_id long, key long, data binary")
    ranges = ranges.select("same", F.col("doc_id").alias("of"), "ranges")
    met = texts.join(ranges, (F.col("key") == F.col("same")) & F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", "data", "ranges")
    return met.mapInArrow(_cut, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null is empty; a text shorter than the strings loses nothing; rows that repeat are places of their own and lose what they share."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed")
    return out.select("doc_id", "n_bytes", removed, F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
