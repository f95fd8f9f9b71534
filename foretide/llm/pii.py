"""Personal data: fixed rules, and a character-level bidirectional LSTM with a CRF on top that adds what rules miss.

The model is trained in numpy on labelled spans: those that the rules find in a bounded sample of the documents, in their
surroundings, and values of each kind as people also write them, set into text among values that look alike but are none.

A span that it can find holds a digit, an at sign, or a written-out one with a dot to follow, so what lies within a window's length of such a
sign is read, and more where a span reaches further. There, windows of fixed length lie over each other at half their length; each character takes
its label scores from the window in which it lies furthest from the edges, and one Viterbi path over all of them gives the
labels, so that windows are reconciled over the whole stretch by the CRF's transitions; what lies between stretches is
outside. Spans of the rules always stay, and a span of the model is added only where it touches none of them.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foretide.llm.common import table, whole_text

KINDS = ("email", "ip", "card", "phone")
WINDOW = 64
HIDDEN = 16
#: Characters of the model: printable ASCII, then other letters, other characters, and the padding.
CHARS = 95 + 3
#: Labels: outside, then begin and inside of each kind.
LABELS = 1 + 2 * len(KINDS)
#: Mean certainty that a span of the model needs.
CERTAIN = 0.8
#: Characters decoded in one path; longer stretches are cut into such, which overlap by SEAM.
STRETCH = 1 << 16
SEAM = 512
#: Documents that labelled windows are taken from, about (all, if fewer), and windows; so many are generated besides.
SAMPLE = 20_000
LABELLED = 3000
GENERATED = 4000

Span = tuple[int, int, str]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LABEL = _LOCAL - frozenset("._%+")
_domain = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++").match
# A run of digits that doesn't match from its start matches from none of its digits, and a match ends a run: so only starts of runs are tried.
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++").finditer
_card = re.compile(r"[0-9](?:[ -]?[0-9])++").finditer
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer
_digit = re.compile(r"[0-9]").search
_signs = re.compile(r"[0-9@]|(?<![^\W_])(?i:at)(?![^\W_])(?=.{0,48}?(?:(?<![^\W_])(?i:dot)(?![^\W_])|\.[^\W_]))").finditer


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (found := _domain(text, at + 1)):
            end = found.end()
            yield start, end, "email"
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def rule_spans(text: str) -> list[Span]:
    """(start, end, kind) by start, then kind as listed; positions count code points."""
    out = list(_emails(text))
    if _digit(text):
        out += [(*m.span(), "ip") for m in _ip(text) if all(len(d := p.lstrip("0")) < 4 and int(d or 0) <= 255 for p in m[0].split("."))]
        for m in _card(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((*m.span(), "card"))
        if "+" in text:
            out += [(*m.span(), "phone") for m in _phone(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# The model.


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    inner = (points >= 32) & (points < 127)
    return np.where(inner, points - 32, np.where(points > 191, 95, 96))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """Parameters: x (direction, char, 4h), h (direction, h, 4h), out (2h, labels), b (labels), t (labels, labels)."""

    def __init__(self, parameters: dict[str, np.ndarray]) -> None:
        self.p = parameters

    @classmethod
    def fresh(cls, rng: np.random.Generator, hidden: int) -> Tagger:
        x = rng.normal(0, 0.3, (2, CHARS, 4 * hidden))
        x[:, :, hidden : 2 * hidden] += 1  # forget little at first
        p = {"x": x, "h": rng.normal(0, 0.2, (2, hidden, 4 * hidden)), "out": rng.normal(0, 0.2, (2 * hidden, LABELS)), "b": np.zeros(LABELS), "t": np.zeros((LABELS, LABELS))}
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    def forward(self, chars: np.ndarray, keep: bool = True) -> tuple[np.ndarray, tuple]:
        """chars (batch, time) to scores (batch, time, labels), and what backward() needs if it is kept. Both directions run side by side."""
        n, time = chars.shape
        both = np.stack([chars, chars[:, ::-1]])
        size = self.p["h"].shape[1]
        h, c = np.zeros((2, n, size), np.float32), np.zeros((2, n, size), np.float32)
        steps, way = [], np.arange(2)[:, None]
        states = np.empty((time, 2, n, size), np.float32)
        for k in range(time):
            z = self.p["x"][way, both[:, :, k]] + h @ self.p["h"]
            gates = _sigmoid(z[..., : 3 * size])
            i, f, o = gates[..., :size], gates[..., size : 2 * size], gates[..., 2 * size :]
            g = np.tanh(z[..., 3 * size :])
            before, old = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            states[k] = h
            if keep:
                steps.append((old, before, i, f, o, g, tc))
        joined = np.concatenate([states[:, 0], states[::-1, 1]], axis=2).transpose(1, 0, 2)
        return joined @ self.p["out"] + self.p["b"], (both, steps, joined)

    def backward(self, slope: np.ndarray, kept: tuple) -> dict[str, np.ndarray]:
        both, steps, joined = kept
        n, time, _ = slope.shape
        size = self.p["h"].shape[1]
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["out"] = np.einsum("bth,btl->hl", joined, slope)
        grad["b"] = slope.sum((0, 1))
        back = (slope @ self.p["out"].T).transpose(1, 0, 2)
        from_above = np.stack([back[:, :, :size], back[::-1, :, size:]], axis=1)
        dh, dc, inputs = np.zeros((2, n, size), np.float32), np.zeros((2, n, size), np.float32), []
        for k in range(time - 1, -1, -1):
            old, before, i, f, o, g, tc = steps[k]
            dh = dh + from_above[k]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=2)
            inputs.append(dz)
            grad["h"] += old.transpose(0, 2, 1) @ dz
            dh, dc = dz @ self.p["h"].transpose(0, 2, 1), dc * f
        for way in range(2):
            which = np.eye(CHARS, dtype=np.float32)[both[way].T[::-1].ravel()]
            grad["x"][way] = which.T @ np.stack([dz[way] for dz in inputs]).reshape(time * n, 4 * size)
        return grad

    def marginals(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each label, and the expected transitions summed over all."""
        n, time, _ = scores.shape
        t = np.exp(self.p["t"])
        here = np.exp(scores - scores.max(axis=2, keepdims=True))
        ahead, behind = np.empty_like(here), np.ones_like(here)
        ahead[:, 0] = here[:, 0] / here[:, 0].sum(axis=1, keepdims=True)
        for k in range(1, time):  # each step scaled to a sum of one
            ahead[:, k] = (ahead[:, k - 1] @ t) * here[:, k]
            ahead[:, k] /= ahead[:, k].sum(axis=1, keepdims=True)
        for k in range(time - 2, -1, -1):
            behind[:, k] = (here[:, k + 1] * behind[:, k + 1]) @ t.T
            behind[:, k] /= behind[:, k].sum(axis=1, keepdims=True)
        of = ahead * behind
        of /= of.sum(axis=2, keepdims=True)
        after = here[:, 1:] * behind[:, 1:]
        whole = np.einsum("bki,ij,bkj->bk", ahead[:, :-1], t, after, optimize=True)
        pairs = np.einsum("bki,bkj->ij", ahead[:, :-1], after / whole[:, :, None], optimize=True) * t
        return of, pairs

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        n, time, _ = scores.shape
        best, came = scores[:, 0], np.zeros(scores.shape, np.int64)
        for k in range(1, time):
            each = best[:, :, None] + self.p["t"]
            came[:, k] = each.argmax(axis=1)
            best = each.max(axis=1) + scores[:, k]
        path = np.empty((n, time), np.int64)
        path[:, -1] = best.argmax(axis=1)
        for k in range(time - 1, 0, -1):
            path[:, k - 1] = came[np.arange(n), k, path[:, k]]
        return path


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _digits(rng: random.Random, n: int) -> str:
    return f"{rng.randrange(10**n):0{n}d}"


def _word(rng: random.Random, low: int, high: int) -> str:
    return "".join(rng.choices(_LETTERS, k=rng.randint(low, high)))


def _value(rng: random.Random, kind: str) -> str:
    """A value of a kind, as people write it."""
    digits, word, pick = (lambda n: _digits(rng, n)), (lambda a, b: _word(rng, a, b)), (lambda *x: rng.choice(x))
    if kind == "email":
        opened, closed = pick(("[", "]"), ("(", ")"), ("{", "}"), ("", ""))
        space = " " if not opened else pick("", " ")
        at, dot = f"{space}{opened}at{closed}{space}", f"{space}{opened}dot{closed}{space}"
        at, dot = pick(("@", "."), (at, dot), (at, dot), (at, "."))
        user = word(3, 8) + pick("", "." + word(3, 7), digits(2), "_" + word(2, 4), dot + word(3, 7))
        value = user + at + word(3, 8) + pick("", digits(1), "-" + word(2, 4)) + dot + pick("com", "org", "net", "de", "edu", "example" + dot + "com", "co" + dot + "uk", word(2, 3), word(2, 6))
        form = rng.random()
        return value.upper() if form < 0.1 else value.replace("at", "AT").replace("dot", "DOT") if form < 0.2 else value
    if kind == "ip":
        return ".".join(str(rng.randrange(256)) for _ in range(4))
    if kind == "card":
        head = digits(15)
        whole = next(head + d for d in "0123456789" if _luhn(head + d))
        sep = pick("", "", " ", "-")
        return sep.join(whole[i : i + 4] for i in range(0, 16, 4))
    area, a, b = digits(3), digits(3), digits(4)
    return pick(f"+1 ({area}) {a}-{b}", f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"+{digits(2)} {area} {a} {b}", f"+1-{area}-{a}-{b}", f"{area} {a} {b}")


def _lookalike(rng: random.Random) -> str:
    """What holds digits, signs or the words for them and is no personal data."""
    digits, word = (lambda n: _digits(rng, n)), (lambda: _word(rng, 2, 8))
    many = lambda: digits(rng.randint(1, 23))
    token = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    forms = (
        lambda: f'token = "{token(rng.randint(20, 39))}"', lambda: f"Version {digits(1)}.{digits(1)}", lambda: f"CC BY-NC 4.{digits(1)}", lambda: f"19{digits(2)}-0{digits(1)}-1{digits(1)}", many, many,
        lambda: f"{digits(2)}.{digits(2)}", lambda: f"${digits(3)},{digits(3)}", lambda: f"{digits(2)}%", lambda: f"{digits(1)}.{digits(1)}.{digits(2)}", lambda: f"page {digits(3)}",
        lambda: f"{digits(2)}:{digits(2)}:{digits(2)}", lambda: f"@{token(6)}", lambda: f"{digits(2)}-{digits(2)}", lambda: f"{word()}-{digits(5)}-{digits(6)}", lambda: f"{word()}{digits(3)}.{word()}",
        lambda: f"{word()} at {word()}. {word().capitalize()} {word()}", lambda: f"{word()} at the {word()} dot", lambda: f"at {digits(1)}.{digits(2)} {word()}", lambda: f"{word()} at {word()} {word()}.{word()}",
        lambda: f"{word().upper()}.\n{word().upper()}!!", lambda: f"At {word()}, a dot {word()}",
    )
    return rng.choice(forms)()


def labelled_windows(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """chars and labels, of shape (n, WINDOW), cut from generated text at any place."""
    rng = random.Random(seed)
    chars, labels = np.full((n, WINDOW), CHARS - 1), np.zeros((n, WINDOW), np.int64)
    for row in range(n):
        text, marks = "", []
        while len(text) < 2 * WINDOW:
            kind = rng.randrange(9)
            if kind < len(KINDS):
                value = _value(rng, KINDS[kind])
                marks += [1 + 2 * kind] + [2 + 2 * kind] * (len(value) - 1)
            elif kind < 6:
                value = _lookalike(rng)
                marks += [0] * len(value)
            else:
                value = " ".join("".join(rng.choices(_LETTERS + "éüñ", k=rng.randint(1, 8))) for _ in range(rng.randint(1, 5)))
                form = rng.random()
                value = value.capitalize() if form < 0.3 else value.upper() if form < 0.4 else value
                marks += [0] * len(value)
            after = rng.choice((" ", " ", " ", ", ", ". ", "\n", "!! ", "% ", " | "))
            text += value + after
            marks += [0] * len(after)
        at = rng.randint(0, len(text) - WINDOW)
        chars[row], labels[row] = codes(text[at : at + WINDOW]), marks[at : at + WINDOW]
    return chars, labels


def document_windows(docs: DataFrame, sample: int = SAMPLE, most: int = LABELLED) -> bytes:
    """Windows around what the rules find in a sample of documents, with its labels; as (chars, labels) of shape (n, WINDOW), bytes.

    About `sample` documents are read for it, chosen by a hash of their text, and the driver gets `most` windows, those with
    the smallest hashes: equal tables give equal windows. Each holds one found span at least, its place in it by the hash.
    """
    texts = docs.filter("text IS NOT NULL").select("text")
    share = min(1.0, sample / max(1, texts.count()))
    chosen = texts.filter(F.pmod(F.xxhash64("text", F.lit("labels")), F.lit(1_000_000)) < F.lit(share * 1_000_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, windows = [], []
            for text in batch.column(0).to_pylist():
                spans = rule_spans(text)
                if not spans:
                    continue
                key = zlib.crc32(text.encode("utf-8", "surrogatepass"))
                start, end, _ = spans[key % len(spans)]
                at = max(0, min(start - key % WINDOW // 2, len(text) - WINDOW))
                chars, labels = np.full(WINDOW, CHARS - 1), np.zeros(WINDOW, np.int64)
                piece = codes(text[at : at + WINDOW])
                chars[: len(piece)] = piece
                for a, b, kind in reversed(spans):  # of spans that overlap the first stays
                    if a >= at and b <= at + WINDOW:
                        mark = 1 + 2 * KINDS.index(kind)
                        labels[a - at : b - at] = mark + 1
                        labels[a - at] = mark
                    elif a < at + WINDOW and b > at:  # cut by the window
                        chars[max(0, a - at) : b - at] = CHARS - 1
                        labels[max(0, a - at) : b - at] = 0
                keys.append(key)
                windows.append(np.stack([chars, labels]).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(windows, pa.binary())], ["key", "window"])

    found = chosen.mapInArrow(run, "key long, window binary").distinct().orderBy("key", "window").limit(most)
    return b"".join(bytes(r.window) for r in found.collect())


def learned(docs: DataFrame) -> Tagger:
    """The tagger of a table of documents."""
    return trained(document_windows(docs))


@lru_cache(maxsize=4)
def trained(windows: bytes = b"", hidden: int = HIDDEN, steps: int = 900, batch: int = 64, seed: int = 5) -> Tagger:
    """By Adam on the CRF's log likelihood, over generated windows and those given; equal arguments give the same model."""
    rng = np.random.default_rng(seed)
    tagger = Tagger.fresh(rng, hidden)
    chars, labels = labelled_windows(seed, GENERATED)
    given = np.frombuffer(windows, np.uint8).reshape(-1, 2, WINDOW).astype(np.int64)
    chars, labels = np.concatenate([chars, given[:, 0]]), np.concatenate([labels, given[:, 1]])
    first = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    second = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    for step in range(1, steps + 1):
        at = rng.integers(0, len(chars), batch)
        x, y = chars[at], labels[at]
        scores, kept = tagger.forward(x)
        of, pairs = tagger.marginals(scores)
        gold = np.zeros_like(of)
        np.put_along_axis(gold, y[:, :, None], 1, axis=2)
        grad = tagger.backward((of - gold) / batch, kept)
        moved = np.zeros((LABELS, LABELS))
        np.add.at(moved, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        grad["t"] = (pairs - moved) / batch
        rate = 0.02 * min(1, step / 20) * (1 - step / (steps + 1)) + 0.001
        for k, g in grad.items():
            g = np.clip(g, -5, 5)
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            tagger.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return tagger


def _stretches(text: str, base: list[Span]) -> list[list[int]]:
    """[start, end) of what lies within WINDOW of a sign outside of all base spans."""
    out: list[list[int]] = []
    spans = iter([*base, (len(text) + 1, len(text) + 1, "")])
    now = next(spans)
    for m in _signs(text):
        while now[1] <= m.start():
            now = next(spans)
        if m.start() < now[0]:
            a, b = max(0, m.start() - WINDOW), min(len(text), m.start() + WINDOW)
            if out and a <= out[-1][1]:
                out[-1][1] = b
            else:
                out.append([a, b])
    return out


def _scores(tagger: Tagger, pieces: list[tuple[np.ndarray, int, int]], batch: int = 1024) -> list[np.ndarray]:
    """Label scores of the characters [a, b) of each text, each from the window in which it lies furthest from the edges. Windows
    lie at multiples of half their length of the text, so a character's scores don't depend on where a piece begins."""
    half, quarter = WINDOW // 2, WINDOW // 4
    jobs = [(i, k * half) for i, (_, a, b) in enumerate(pieces) for k in range(max(0, (a - quarter) // half), max(0, (b - 1 - quarter) // half) + 1)]
    out = [np.empty((b - a, LABELS), np.float32) for _, a, b in pieces]
    for at in range(0, len(jobs), batch):
        part = jobs[at : at + batch]
        chars = np.full((len(part), WINDOW), CHARS - 1)
        for row, (i, start) in enumerate(part):
            window = pieces[i][0][start : start + WINDOW]
            chars[row, : len(window)] = window
        scores, _ = tagger.forward(chars, keep=False)
        for row, (i, start) in enumerate(part):
            _, a, b = pieces[i]
            low, high = max(a, start + quarter if start else 0), min(b, start + half + quarter)
            if low < high:
                out[i][low - a : high - a] = scores[row, low - start : high - start]
    return out


def _decoded(tagger: Tagger, scores: list[np.ndarray], cells: int = 1 << 18) -> list[tuple[np.ndarray, np.ndarray]]:
    """Labels of each piece by one path, and their certainty. What is added to make lengths equal is outside."""
    order = sorted(range(len(scores)), key=lambda i: len(scores[i]))
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0))] * len(scores)
    at = 0
    while at < len(order):
        n = 1
        while at + n < len(order) and (n + 1) * len(scores[order[at + n]]) <= cells and len(scores[order[at + n]]) <= 2 * len(scores[order[at]]):
            n += 1
        part = order[at : at + n]
        padded = np.full((n, len(scores[part[-1]]), LABELS), -1e4, np.float32)
        padded[:, :, 0] = 0
        for row, i in enumerate(part):
            padded[row, : len(scores[i])] = scores[i]
        path = tagger.viterbi(padded)
        sure = np.take_along_axis(tagger.marginals(padded)[0], path[:, :, None], axis=2)[:, :, 0]
        for row, i in enumerate(part):
            out[i] = (path[row, : len(scores[i])], sure[row, : len(scores[i])])
        at += n
    return out


def _runs(labels: np.ndarray, sure: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    """start, end, kind and mean certainty. An inside label with none of its kind before it begins a span as well."""
    kinds = np.where(labels > 0, (labels + 1) // 2, 0)
    new = np.concatenate([[True], (kinds[1:] != kinds[:-1]) | (labels[1:] % 2 == 1)])
    starts = np.flatnonzero(new & (kinds > 0))
    ends = np.flatnonzero(np.concatenate([new[1:] | (kinds[:-1] == 0), [True]]) & (kinds > 0)) + 1
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        yield a, b, int(kinds[a]) - 1, float(sure[a:b].mean())


def model_spans(tagger: Tagger, texts: list[str], bases: list[list[Span]], certain: float = CERTAIN) -> list[list[Span]]:
    """What the tagger adds to each text's base spans. Where a path ends inside a span at an end of its stretch, the stretch is
    widened there and decoded anew, by twice as much each time, up to STRETCH."""
    coded: dict[int, np.ndarray] = {}
    jobs: list[tuple[int, int, int, int, int, int, int]] = []  # text, start, end, between which places the spans begin that are taken, and by how much its ends may be widened
    for i, (text, base) in enumerate(zip(texts, bases, strict=True)):
        for a, b in _stretches(text, base):
            coded[i] = codes(text) if i not in coded else coded[i]
            for x in range(a, max(a + 1, b - SEAM), STRETCH - SEAM):
                y = min(x + STRETCH, b)
                jobs.append((i, x, y, x if x == a else x + SEAM // 2, y if y == b else y - SEAM // 2, WINDOW * (x == a), WINDOW * (y == b)))
    out: list[dict[Span, None]] = [{} for _ in texts]
    taken = {i: _merged(bases[i]) for i in coded}
    while jobs:
        found, further = _decoded(tagger, _scores(tagger, [(coded[i], a, b) for i, a, b, *_ in jobs])), []
        for (i, a, b, low, high, left, right), (labels, sure) in zip(jobs, found, strict=True):
            text, (starts, ends) = texts[i], taken[i]
            before, after = min(a, left * bool(labels[0])), min(len(text) - b, right * bool(labels[-1]))
            if before or after:  # a span goes on where nothing was read
                more = lambda n, used: 2 * n * (2 * n <= STRETCH) if used else n
                further.append((i, a - before, b + after, low - before, high + after, more(left, before), more(right, after)))
                continue
            for start, end, kind, p in _runs(labels, sure):
                start, end = _fitted(text, KINDS[kind], start + a, end + a)
                first = bisect_right(ends, start)  # of the spans of rules that end later
                apart = first == len(starts) or starts[first] >= end
                if low <= start < high and apart and p >= certain and _valid(KINDS[kind], text[start:end]):
                    out[i][start, end, KINDS[kind]] = None
        jobs = further
    return [list(x) for x in out]


def _merged(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of what spans in order of their start cover."""
    starts, ends = [], []
    for start, end, _ in spans:
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


_address = re.compile(r"(?i)[a-z0-9._%+-]+(?:(?:\s+dot\s+|\s*[\[({]\s*dot\s*[\])}]\s*)[a-z0-9_%+-]+)*(?:@|\s+at\s+|\s*[\[({]\s*at\s*[\])}]\s*)[a-z0-9-]+(?:(?:\.|\s+dot\s+|\s*[\[({]\s*dot\s*[\])}]\s*)[a-z0-9-]+)+").search


def _fitted(text: str, kind: str, start: int, end: int) -> tuple[int, int]:
    """The ends of an address, which the tagger may take to be a word or some letters away: its name begins with the first character
    that a name can hold, and it ends with the last label behind a dot."""
    if kind != "email" or not (found := _address(text, start, end)):
        return start, end
    start, end = found.span()
    while start and text[start - 1] in _LOCAL:
        start -= 1
    while end < len(text) and text[end] in _LABEL:
        end += 1
    return start, end


def _valid(kind: str, value: str) -> bool:
    """What makes a value one of its kind: a sign and a dot, as characters or words; a number's digits, and their sum for a card."""
    if kind == "email":
        return _address(value) is not None
    digits = "".join(c for c in value if "0" <= c <= "9")
    if kind == "ip":
        return 4 <= len(digits) <= 12 and value.count(".") == 3
    return 14 <= len(digits) <= 19 and _luhn(digits) if kind == "card" else 10 <= len(digits) <= 15


def find(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, str, bool]]]:
    """(start, end, kind, by a rule) of each text, by start, then kind as listed."""
    bases = [rule_spans(t) for t in texts]
    added = model_spans(tagger, texts, bases)
    return [sorted([(*s, True) for s in base] + [(*s, False) for s in more], key=lambda s: (s[0], KINDS.index(s[2]))) for base, more in zip(bases, added, strict=True)]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_())]))


def find_personal_data(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """doc_id, spans (array of start, end, kind, base) for each row of docs (doc_id, text; other columns are ignored).

    Positions count code points, the end is exclusive; spans are in order of their start, then of their kind in KINDS.
    base: found by a rule. Null and empty texts have no spans; rows may repeat; an empty table gives an empty result.
    """
    tagger = tagger or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = find(tagger, part.column(1).to_pylist())
                spans = [[{"start": a, "end": b, "kind": k, "base": r} for a, b, k, r in x] for x in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, _SPANS)], ["doc_id", "spans"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return texts.mapInArrow(run, "doc_id long, spans array<struct<start:long,end:long,kind:string,base:boolean>>")


def redacted(text: Column, tagger: Tagger | None = None) -> Column:
    """The text with each span replaced by its kind in brackets, such as [email]; of overlapping spans the first counts
    up to the last one's end. Null stays null."""
    tagger = tagger or trained()

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out = []
            for at in range(0, len(texts), 512):
                some = texts.iloc[at : at + 512].tolist()
                for text, spans in zip(some, find(tagger, [t or "" for t in some]), strict=True):
                    if not spans:
                        out.append(text)
                        continue
                    pieces, done = [], 0
                    for start, end, kind, _ in spans:
                        if start >= done:
                            pieces += [text[done:start], f"[{kind}]"]
                        done = max(done, end)
                    out.append("".join(pieces) + text[done:])
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string")(text)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and base_sha256 are those of the rules; spans also holds what the model adds (n_added). A null or empty text
    has no spans; rows that repeat are found alike."""
    docs = table(spark, sf_dir, "documents")
    found = find_personal_data(docs, learned(docs))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    added = F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added")
    return found.select("doc_id", *map(count, KINDS), F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), added)
