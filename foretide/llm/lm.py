"""Language-model scoring: a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

The context of a word is the words before it: their vectors, each weighted by its distance, add up to a prediction, and its
product with a word's vector is the word's score. A symbol is the end of a document, a frequent word, or a class of all
other words with the same ending. Symbols lie in groups of about the root of their number, so that log probabilities are
normalised exactly by two short matrix products: over the groups, and over the symbols of the word's group.

Both are trained by telling what follows from noise that is drawn by frequency. A bounded sample of all training rows at the
driver gives where to begin; from there every task goes on over all positions of its own rows, and the parameters of all tasks
are averaged, as a tree of small sums, so that the model learns from the whole corpus. Words in a class share its probability by
their counts; the counts of frequent words go to the tasks, a bounded number, and rarer words meet theirs in a join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foretide.llm.common import checkpointed, crc_mod, materialised, table, whole_text

#: Symbols: 0 is the end, then at most OWN - 1 words of their own, then CLASSES classes of words.
OWN = 4096
CLASSES = 256
#: A word with a symbol of its own occurs so often at least.
LEAST = 3
#: Words whose counts are broadcast, at most: the most frequent ones.
BROADCAST = 1 << 17
#: Distinct words a task gathers before it hands them on.
GATHERED = 500_000
#: Bytes of text, about, whose words a task finds at once.
TOGETHER = 2 << 20
#: Words of context, numbers in a vector.
CONTEXT = 4
SIZE = 24
#: Noise samples of a step for the group, and of the positions of each group for the word in it.
NOISE_GROUPS = 24
NOISE_WORDS = 8
#: Positions in a minibatch at the driver and in a task; positions that the driver learns from, about (all, if fewer), and how often it goes over them.
BATCH = 1024
TASK_BATCH = 4096
SAMPLE = 400_000
EPOCHS = 2
#: How many rows a step of the tree of sums takes.
FAN = 64
#: Positions are drawn from documents that are drawn first: so many times the share of positions.
SPREAD = 4


_LOWER, _WHITE = np.arange(256, dtype=np.uint8), np.zeros(256, bool)
_LOWER[ord("A") : ord("Z") + 1] += 32
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts, in order, and how many each text has; cut at [\\x20\\x09-\\x0D], A-Z lower-cased only."""
    texts = texts.cast(pa.large_binary())
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    size = int(edges[-1] - edges[0])
    if not size:
        return pa.array([], pa.binary()), np.zeros(len(texts), np.int64)
    data, edges = np.frombuffer(texts.buffers()[2], np.uint8)[edges[0] : edges[-1]], edges - edges[0]
    solid = ~_WHITE[data]
    first, last, cuts = solid.copy(), solid.copy(), edges[(edges > 0) & (edges < size)]
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    first[cuts], last[cuts - 1] = solid[cuts], solid[cuts - 1]
    starts = np.flatnonzero(first)
    ends = np.concatenate([[0], np.cumsum(np.flatnonzero(last) + 1 - starts)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(_LOWER[data[solid]])])
    return words, np.diff(np.searchsorted(starts, edges))


def _pieces(batches: Iterator[pa.RecordBatch], most: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """Rows whose texts, the last column, have `most` bytes together, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def _places(words: pa.Array, among: pa.Array) -> np.ndarray:
    """Where each word stands in `among`, -1 if nowhere."""
    return pc.index_in(words, value_set=among).fill_null(-1).to_numpy(zero_copy_only=False)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def gathered() -> pa.Table:
        return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

    held: list[pa.Table] = []
    for piece in _pieces(batches):
        found = words_in(piece.column(0))[0].value_counts()
        held.append(pa.table([found.field(0), found.field(1)], ["word", "n"]))
        if sum(map(len, held)) > 2 * GATHERED:
            held = [gathered()]
            if len(held[0]) > GATHERED:
                yield from held[0].to_batches()
                held = []
    if held:
        yield from gathered().to_batches()


def word_counts(texts: DataFrame) -> DataFrame:
    """word (UTF-8), n over all rows of texts (text)."""
    return texts.select(whole_text()).mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int = BROADCAST) -> list[tuple[bytes, int]]:
    """Frequent words and their counts, `most` at most. Words go by levels of like counts, 64 to each doubling: levels that fit
    come to the driver whole, the most frequent first, and of the first one that doesn't a share by hash, so that no task
    sends more than is kept, and many words of like counts are not all left out."""
    level = F.floor(64 * F.log2("n"))
    sizes = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("v")).collect()
    wanted, total = F.lit(False), 0
    for row in sorted(sizes, reverse=True):
        if total + row.v > most:
            part = F.pmod(F.xxhash64("word"), F.lit(1_000_003)) < int(1_000_003 * (most - total) / row.v)
            wanted = wanted | ((level == row.level) & part)
            break
        total += row.v
        wanted = wanted | (level == row.level) if total == row.v else (level >= row.level)
    return sorted(((bytes(r.word), r.n) for r in counts.filter(wanted).collect()), key=lambda x: (-x[1], x[0]))[:most]


@dataclass
class Symbols:
    """Which symbol a word is. `own`: words with one of their own, by their symbol, from 1."""

    own: dict[bytes, int]

    @property
    def size(self) -> int:
        return len(self.own) + 1 + CLASSES

    def word_class(self, word: bytes) -> int:
        return len(self.own) + 1 + zlib.crc32(word[-2:]) % CLASSES

    def classes(self, words: pa.Array) -> np.ndarray:
        """word_class() of each word."""
        if not len(words):
            return np.zeros(0, np.int32)
        ends, data = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1], np.frombuffer(words.buffers()[2], np.uint8)
        last = data[ends[1:] - 1].astype(np.int64)
        ending = np.where(np.diff(ends) > 1, 256 + 256 * data[ends[1:] - 2].astype(np.int64) + last, last)
        return len(self.own) + 1 + _class_of_ending()[ending]

    def of(self, words: pa.Array, among: pa.Array) -> np.ndarray:
        """The symbol of each word; among: `own` as an array."""
        found = _places(words, among) + 1
        others = np.flatnonzero(found == 0)
        found[others] = self.classes(words.take(pa.array(others)))
        return found


@cache
def _class_of_ending() -> np.ndarray:
    """The classes of endings of a byte, then of two."""
    return np.array([zlib.crc32(bytes(x)) % CLASSES for x in [*((b,) for b in range(256)), *((a, b) for a in range(256) for b in range(256))]], np.int32)


def _line(symbols: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """CONTEXT ends as what is before a document, the symbols of its n words, its end, for each document; and the places of what follows."""
    first = np.concatenate([[0], np.cumsum(n + CONTEXT + 1)])
    line, follows = np.zeros(first[-1], np.int32), np.ones(first[-1], bool)
    follows[(first[:-1, None] + np.arange(CONTEXT)).ravel()] = False
    words = follows.copy()
    words[first[1:] - 1] = False
    line[words] = symbols
    return line, np.flatnonzero(follows)


class Network:
    """Parameters: word (symbols, size) and near (context, size) of contexts; group, group_bias, target, bias of what follows.

    n: how often each symbol occurs, from which groups and noise are made: symbols in the order of their number, in equal parts.
    """

    def __init__(self, n: np.ndarray, size: int = SIZE, context: int = CONTEXT, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.parts = int(np.ceil(np.sqrt(len(n))))
        self.starts = np.linspace(0, len(n), self.parts + 1).astype(np.int64)
        self.group_of = np.searchsorted(self.starts, np.arange(len(n)), "right") - 1
        q = (n + 0.5) / (n + 0.5).sum()
        self.ends = np.concatenate([[0], np.cumsum(q)])
        self.q_group = np.add.reduceat(q, self.starts[:-1])
        self.group_ends = np.cumsum(self.q_group) / self.q_group.sum()
        self.q_word = q / self.q_group[self.group_of]
        draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.p = {"word": draw(len(n), size), "near": np.ones((context, size), np.float32), "group": draw(self.parts, size), "target": draw(len(n), size)}
        self.p |= {"group_bias": np.log(self.q_group).astype(np.float32), "bias": np.log(self.q_word).astype(np.float32)}
        self.seen = {k: np.full_like(v, 1e-8) for k, v in self.p.items()}
        self.room: dict[str, np.ndarray] = {}

    def predicted(self, contexts: np.ndarray) -> np.ndarray:
        """contexts (positions, context), the nearest word first."""
        return np.einsum("bcd,cd->bd", self.p["word"][contexts], self.p["near"])

    def __getstate__(self) -> dict:
        return self.__dict__ | {"room": {}}

    def _room(self, name: str, shape: tuple[int, ...], kind: type = np.float32) -> np.ndarray:
        """An array that is written over in each step: fresh memory for each costs more than what is computed."""
        held = self.room.get(name)
        if held is None or len(held) < shape[0]:
            held = self.room[name] = np.empty(shape, kind)
        return held[: shape[0]]

    def _rows(self, name: str, of: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.take(of, rows, axis=0, out=self._room(name, (len(rows), of.shape[1])), mode="clip")

    def _ones(self, n: int) -> np.ndarray:
        held = self._room("ones", (n,))
        held.fill(1)
        return held

    def _add_rows(self, to: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
        """Adds each row of values to its row of `to`; two numbers are added as one complex one, which takes half as many sums."""
        if values.shape[1] % 2 == 0:
            to, values = to.view(np.complex64), values.view(np.complex64)
        width = to.shape[1]
        at = np.add((rows * np.int64(width))[:, None], np.arange(width), out=self._room(f"at {width}", values.shape, np.int64))
        np.add.at(to.reshape(-1), at.reshape(-1), values.reshape(-1))

    def gradient(self, windows: np.ndarray | tuple[np.ndarray, np.ndarray], rng: np.random.Generator) -> dict[str, np.ndarray]:
        """Slopes of the NCE objective, the mean over windows (positions, context + 1): what follows stands last. Or, of texts as they stand, over
        places (the second array) in a line of symbols (the first): neighbours share their contexts, so that each symbol's vector is
        read and its slope added once. Noise for the group is drawn once for all positions, noise within a group once for the
        positions that it follows, so that both are matrix products."""
        near, vectors, of_group = self.p["near"], self.p["target"], self.p["group"]
        context = len(near)
        line, follows = windows if isinstance(windows, tuple) else _in_line(windows)
        target = line[follows]
        order = _order(target)  # groups are ranges of symbols, so positions of a group lie together
        target, follows, b = target[order].astype(np.int64), follows[order] - context, len(follows)
        x = self._rows("x", self.p["word"], line)
        before = [x[context - 1 - c : len(line) - 1 - c] for c in range(context)]
        each, part = np.multiply(before[0], near[0], out=self._room("each", before[0].shape)), self._room("part", before[0].shape)
        for v, k in zip(before[1:], near[1:], strict=True):
            each += np.multiply(v, k, out=part)
        h = self._rows("h", each, follows)
        some = self._room("some", h.shape)
        group = self.group_of[target]
        firsts = _firsts(group)
        there, ends, size = group[firsts], [*firsts[1:].tolist(), b], np.float32(b)
        noise = np.searchsorted(self.group_ends, rng.random(NOISE_GROUPS), "right")
        bias = self.p["group_bias"] - np.log(NOISE_GROUPS * self.q_group).astype(np.float32)
        mine, others = self._rows("mine", of_group, group), of_group[noise]
        up = (1 - _sigmoid(np.einsum("bd,bd->b", h, mine) + bias[group])) / size
        down = np.matmul(h, others.T, out=self._room("down", (b, NOISE_GROUPS)))
        down += bias[noise]
        down = _sigmoid(down)
        down /= -size
        back = np.matmul(down, others, out=self._room("back", h.shape))
        back += np.multiply(up[:, None], mine, out=some)
        slopes = {k: self._room(f"slope of {k}", v.shape) for k, v in self.p.items()}
        for v in slopes.values():
            v.fill(0)
        slopes["group"][there], slopes["group_bias"][there] = np.add.reduceat(np.multiply(up[:, None], h, out=some), firsts), np.add.reduceat(up, firsts)
        np.add.at(slopes["group"], noise, down.T @ h)
        np.add.at(slopes["group_bias"], noise, self._ones(b) @ down)
        # Noise from a group, by the place of a random number among its symbols' shares.
        low, high = self.ends[self.starts[there]], self.ends[self.starts[there + 1]]
        at = np.searchsorted(self.ends, low[:, None] + rng.random((len(there), NOISE_WORDS)) * (high - low)[:, None], "right") - 1
        drawn = np.clip(at, self.starts[there][:, None], self.starts[there + 1][:, None] - 1)
        bias = self.p["bias"] - np.log(NOISE_WORDS * self.q_word).astype(np.float32)
        mine, others = self._rows("mine", vectors, target), vectors[drawn]
        up = (1 - _sigmoid(np.einsum("bd,bd->b", h, mine) + bias[target])) / size
        down = self._room("down within", (b, NOISE_WORDS))
        spans = [slice(a, z) for a, z in zip(firsts.tolist(), ends, strict=True)]
        for span, v in zip(spans, others, strict=True):
            np.matmul(h[span], v.T, out=down[span])
        down += np.repeat(bias[drawn], np.diff(firsts, append=b), axis=0)
        down = _sigmoid(down)
        down /= -size
        back += np.multiply(up[:, None], mine, out=some)
        false = np.empty_like(others)
        for span, v, out in zip(spans, others, false, strict=True):
            some_down = down[span]
            np.matmul(some_down, v, out=some[span])
            np.matmul(some_down.T, h[span], out=out)
        back += some
        self._add_rows(slopes["target"], target, np.multiply(up[:, None], h, out=some))
        np.add.at(slopes["bias"], target, up)
        self._add_rows(slopes["target"], drawn.ravel(), false.reshape(-1, h.shape[1]))
        np.add.at(slopes["bias"], drawn.ravel(), np.add.reduceat(down, firsts).ravel())
        each.fill(0)
        each[follows] = back
        told = self._room("told", x.shape)
        told.fill(0)
        for c, v in enumerate(before):
            slopes["near"][c] = self._ones(len(each)) @ np.multiply(each, v, out=part)
            told[context - 1 - c : len(line) - 1 - c] += np.multiply(each, near[c], out=part)
        self._add_rows(slopes["word"], line, told)
        return slopes

    def train(self, batches: Iterator[np.ndarray | tuple[np.ndarray, np.ndarray]], rate: float, seed: int) -> None:
        """By Adagrad, a step for each minibatch; what was seen before keeps on making steps shorter."""
        rng = np.random.default_rng(seed)
        for windows in batches:
            for name, slope in self.gradient(windows, rng).items():
                by = np.multiply(slope, slope, out=self._room(f"step of {name}", slope.shape))
                self.seen[name] += by
                slope *= rate
                slope /= np.sqrt(self.seen[name], out=by)
                self.p[name] += slope

    def log_p(self, symbols: np.ndarray, follows: np.ndarray, at_once: int = 1 << 16) -> np.ndarray:
        """log10 probability of each symbol in `follows` (places in symbols) after those before it."""
        out = np.empty(len(follows))
        weighted = self.p["word"][None] * self.p["near"][:, None]
        for a in range(0, len(follows), at_once):
            places = follows[a : a + at_once]
            order = _order(self.group_of[symbols[places]])
            places = places[order]
            target = symbols[places]
            h = self._rows("h", weighted[0], symbols[places - 1])
            for c in range(1, len(weighted)):
                h += self._rows("some", weighted[c], symbols[places - 1 - c])
            group = self.group_of[target]
            found = self._log_softmax(h, self.p["group"], self.p["group_bias"], group)
            firsts = _firsts(group)
            for i, z in zip(firsts.tolist(), [*firsts[1:].tolist(), len(group)], strict=True):
                low, high = self.starts[group[i]], self.starts[group[i] + 1]
                found[i:z] += self._log_softmax(h[i:z], self.p["target"][low:high], self.p["bias"][low:high], target[i:z] - low)
            out[a : a + at_once][order] = found
        return out / np.log(10)

    def _log_softmax(self, h: np.ndarray, vectors: np.ndarray, bias: np.ndarray, which: np.ndarray, at_once: int = 2048) -> np.ndarray:
        """Of one of the vectors for each row of h."""
        out = np.empty(len(h), np.float32)
        for a in range(0, len(h), at_once):
            n = len(which[a : a + at_once])
            scores = np.matmul(vectors, h[a : a + at_once].T, out=self._room("scores", (len(vectors) * n,)).reshape(-1, n))
            scores += bias[:, None]
            scores -= scores.max(axis=0)
            out[a : a + n] = scores[which[a : a + at_once], np.arange(n)]
            np.exp(scores, out=scores)
            out[a : a + n] -= np.log(scores.sum(axis=0))
        return out

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def take(self, flat: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """x is used up."""
    np.negative(np.clip(x, -30, 30, out=x), out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _order(keys: np.ndarray) -> np.ndarray:
    """What sorts keys from 0, by digits where they are short."""
    return np.argsort(keys.astype(np.uint16) if len(keys) and keys.max() < 1 << 16 else keys, kind="stable")


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Where runs of like keys begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _in_line(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows one after the other, in the order of reading."""
    b, width = windows.shape
    return np.concatenate([windows[:, -2::-1], windows[:, -1:]], axis=1).ravel(), np.arange(b) * width + width - 1


def _drawn(texts: DataFrame, share: float, salt: int) -> tuple[DataFrame, float]:
    """Documents of which a share of positions makes up `share` of all, and that share; by a hash of the text."""
    of = min(1.0, SPREAD * share)
    chosen = F.pmod(F.xxhash64("text", F.lit(salt)), F.lit(1_000_003)) < F.lit(of * 1_000_003)
    return texts.filter(chosen) if of < 1 else texts, share / of


def _windows(symbols: Symbols, share: float, salt: int, batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Windows (positions, context + 1) of a share of all positions in the texts, by a hash of the text and the position."""
    among = pa.array(list(symbols.own), pa.binary())
    for piece in _pieces(batches):
        words, n = words_in(piece.column(0))
        line, places = _line(symbols.of(words, among), n)
        if share < 1:
            seeds = [[salt, zlib.crc32(text.encode("utf-8", "surrogatepass"))] for text in piece.column(0).to_pylist()]
            places = places[np.concatenate([np.random.default_rng(seed).random(k + 1) < share for seed, k in zip(seeds, n.tolist(), strict=True)])]
        windows = np.empty((len(places), CONTEXT + 1), np.int32)
        for c in range(CONTEXT):
            windows[:, c] = line[places - 1 - c]
        windows[:, CONTEXT] = line[places]
        yield windows


def _minibatches(windows: Iterator[np.ndarray], size: int = BATCH) -> Iterator[np.ndarray]:
    held: list[np.ndarray] = []
    for some in windows:
        held.append(some)
        if sum(map(len, held)) >= size:
            whole = np.concatenate(held)
            for a in range(0, len(whole) - size + 1, size):
                yield whole[a : a + size]
            held = [whole[len(whole) - len(whole) % size :]]
    if held and sum(map(len, held)):
        yield np.concatenate(held)


def _stretches(symbols: Symbols, batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All positions of the texts in minibatches, each a line of symbols as they stand and the places learned from."""
    among = pa.array(list(symbols.own), pa.binary())
    line, follows = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def cut(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = places[0] - CONTEXT
        return line[first : places[-1] + 1], places - first

    for piece in _pieces(batches):
        words, n = words_in(piece.column(0))
        more, places = _line(symbols.of(words, among), n)
        line, follows = np.concatenate([line, more]), np.concatenate([follows, places + len(line)])
        whole = len(follows) - len(follows) % size
        for a in range(0, whole, size):
            yield cut(follows[a : a + size])
        line, follows = cut(follows[whole:]) if whole < len(follows) else (line[:0], follows[:0])
    if len(follows):
        yield line, follows


def _sampled(symbols: Symbols, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _minibatches(_windows(symbols, share, 1, batches), 1 << 14):
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(some.astype(np.int32).tobytes(), 1)], pa.binary())], ["data"])

    return run


_BLOCK = 1 << 13


def _trainer(network: Network, symbols: Symbols, rate: float):
    """Parameters of a task that learned from all its positions, times their number, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0

        def counted() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            nonlocal seen
            for line, follows in _stretches(symbols, batches, TASK_BATCH):
                seen += len(follows)
                yield line, follows

        network.train(counted(), rate, part)
        flat = network.flat().astype(np.float64) * seen
        blocks = [flat[a : a + _BLOCK].astype(np.float32).tobytes() for a in range(0, len(flat), _BLOCK)] if seen else []
        n = len(blocks)
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([part] * n, pa.int64()), pa.array([seen] * n, pa.int64()), pa.array(blocks, pa.binary())], ["block", "member", "seen", "data"])

    return run


_SUMS = "block int, member long, seen long, data binary"


def _added(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("member")
    total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in rows["data"])
    return pd.DataFrame({"block": [key[0]], "member": [key[1]], "seen": [int(rows["seen"].sum())], "data": [total.astype(np.float32).tobytes()]})


def averaged(network: Network, parts: DataFrame) -> None:
    """The mean of the parameters of all tasks, weighted by what they learned from: no sum takes more than FAN rows."""
    parts = checkpointed(parts)
    last = parts.agg(F.max("member")).first()[0]
    if last is None:
        return
    while last:
        up = F.floor(F.col("member") / FAN).cast("long")
        parts = checkpointed(parts.groupBy("block", up.alias("member")).applyInPandas(_added, _SUMS))
        last //= FAN
    rows = sorted(parts.collect(), key=lambda r: r.block)
    network.take(np.concatenate([np.frombuffer(r.data, np.float32) / r.seen for r in rows]))


@dataclass
class Model:
    """counts: all words' counts, a table. frequent: the counts of the most frequent words. below: log10 of what a class's counts are divided by."""

    counts: DataFrame
    frequent: dict[bytes, int]
    symbols: Symbols
    network: Network
    below: np.ndarray
    tokens: int
    distinct: int
    ends: int


def learn(texts: DataFrame, sample: int = SAMPLE, own: int = OWN, rate: float = 0.1) -> Model:
    """From all positions of all rows of texts (text). The driver gets BROADCAST words, about `sample` positions, and the network's parameters."""
    counts = materialised(word_counts(texts))
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = texts.count()
    top = frequent_words(counts)
    symbols = Symbols({w: i + 1 for i, (w, n) in enumerate(top[: own - 1]) if n >= LEAST})
    held = F.broadcast(counts.sparkSession.createDataFrame([(w,) for w in list(symbols.own) or [b" "]], "word binary"))
    others = counts.join(held, "word", "left_anti")
    endings = others.groupBy(F.expr("substring(word, -2, 2)").alias("ending")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"))
    of_class, below = np.zeros(CLASSES), np.ones(CLASSES)
    for row in endings.toLocalIterator():
        at = symbols.word_class(bytes(row.ending)) - len(symbols.own) - 1
        of_class[at] += row.n
        below[at] += row.n + row.v
    tokens = sums.n + ends
    network = Network(np.concatenate([[ends], [n for _, n in top[: len(symbols.own)]], of_class]))
    plain = texts.select(whole_text().alias("text"))
    some, share = _drawn(plain, min(1.0, sample / max(1, tokens)), 1)
    drawn = [np.frombuffer(zlib.decompress(r.data), np.int32).reshape(-1, CONTEXT + 1) for r in some.mapInArrow(_sampled(symbols, share), "data binary").collect()]
    if drawn:
        drawn, rng = np.concatenate(drawn), np.random.default_rng(3)
        drawn = drawn[np.lexsort(drawn.T)]  # however the rows came in
        for epoch in range(EPOCHS):
            order = rng.permutation(len(drawn))
            network.train((drawn[order[a : a + BATCH]] for a in range(0, len(order), BATCH)), rate / (1 + epoch), epoch)
        averaged(network, plain.mapInArrow(_trainer(network, symbols, rate / 2), _SUMS))
    return Model(counts, dict(top), symbols, network, np.log10(below), tokens, sums.v + (ends > 0), ends)


_PARTS = "key long, word binary, times long, doc_id long, n_tokens long, n_known long, base double, score double"
_NAMES = [part.split()[0] for part in _PARTS.split(", ")]


def _score(frequent: dict[bytes, int], symbols: Symbols, network: Network, below: np.ndarray, divisor: float, ends: int):
    """For each document a row of its own, under a word that no text holds, and a row for each of its rare words."""
    first_class = len(symbols.own) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among, known = pa.array(list(frequent), pa.binary()), np.array([*frequent.values(), 0])
        symbol_at = np.append(symbols.of(among, pa.array(list(symbols.own), pa.binary())), 0)
        log_at, known_at = np.log10(known + 1.0), known > 0
        for piece in _pieces(batches):
            key, n_docs = piece.column(0).to_numpy(), piece.num_rows
            words, n = words_in(piece.column(2))
            at_place, doc_of = _places(words, among), np.repeat(np.arange(n_docs), n)
            rare = np.flatnonzero(at_place < 0)
            rare_words, of = words.take(pa.array(rare)), symbol_at[at_place]
            of[rare] = symbols.classes(rare_words)
            log_p = network.log_p(*_line(of, n))
            logs, classed = log_at[at_place], np.flatnonzero(of >= first_class)
            summed = lambda values, docs=doc_of: np.bincount(docs, values, n_docs)
            of_class = summed(logs[classed] - below[of[classed] - first_class], doc_of[classed])
            score = np.add.reduceat(log_p, np.cumsum(n + 1) - n - 1) + of_class
            base = summed(logs) + np.log10(ends + 1.0) - (n + 1) * divisor
            n_known = summed(known_at[at_place]).astype(np.int64) + (ends > 0)
            own = [pa.array([b"\xff%d" % k for k in key.tolist()], pa.binary()), pa.array(np.zeros(n_docs, np.int64)), piece.column(1)]
            yield pa.RecordBatch.from_arrays([piece.column(0), *own, *map(pa.array, (n + 1, n_known, base, score))], _NAMES)
            met = pa.table([pa.array(key[doc_of[rare]]), rare_words], ["key", "word"]).group_by(["key", "word"], use_threads=False).aggregate([([], "count_all")])
            none, nothing = pa.array(np.zeros(met.num_rows, np.int64)), pa.array(np.zeros(met.num_rows))
            others = [met[name].combine_chunks() for name in ("key", "word", "count_all")]
            yield pa.RecordBatch.from_arrays([*others, pa.nulls(met.num_rows, pa.int64()), none, none, nothing, nothing], _NAMES)

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text; other columns are
    ignored): the log10 probability of the whole text by smoothed word counts and by the model.

    Words of a class take their share of it by their counts, smoothed by one, with one more share for all words never
    seen. A null or empty text is its end alone. Rows that repeat are scored each; an empty table gives an empty result. If
    nothing was learned, all symbols are about equally likely.
    """
    divisor = float(np.log10(model.tokens + model.distinct + 1))
    given = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    parts = given.mapInArrow(_score(model.frequent, model.symbols, model.network, model.below, divisor, model.ends), _PARTS)
    met = parts.join(model.counts, "word", "left")
    gain = F.when(F.col("times") > 0, F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1.0)).otherwise(0.0)
    known = F.when(F.col("n") > 0, F.col("times")).otherwise(0)
    by_document = met.groupBy("key").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_known") + known).alias("n_known"),
        F.sum(F.col("base") + gain).alias("base_score"), F.sum(F.col("score") + gain).alias("score"),
    )
    return by_document.select("doc_id", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null or empty text is its end alone; rows that repeat are scored each."""
    docs = table(spark, sf_dir, "documents")
    held_out: Column = crc_mod("doc_id", 7) == 2
    scored = score(docs, learn(docs.filter(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

