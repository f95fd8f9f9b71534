"""Hard negatives by distributed radix selection.

An anchor's positives are the best rows of its own label, and each of them opens a window of scores in which rows of other labels
are hard: neither far off nor as good as the positive. Scores are whole numbers, and what is wanted of a window is its first few
rows from above, so the score of the last wanted one is found digit by digit: every block of rows counts its scores by the
highest digit of their distance from the window's upper end, the counts of all blocks are added, and the digit that holds the
last wanted row is the window of the next round. When that digit holds few rows, or is a single score, only rows from there up
are gathered and ranked. Neither scores nor rows in between are ever written.

Anchors meet rows in blocks, each pair of a block of anchors and one of rows is a group of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foretide.llm.common import checkpointed, table

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: Hundredths of the positive's score between which a negative's lies.
LOW, HIGH = 30, 90
#: Rows in a block, at most about.
ANCHORS = 2048
ROWS = 8192
#: Bits of a digit, and rows in a digit that are gathered without a further round.
BITS = 6
FEW = 64
#: Anchors whose scores are held at a time.
AT_ONCE = 64
_LONG = (-(2**63), 2**63 - 1)
_ROW = "vec_id long, label long, dim int, vector binary"


def _scaled(scale: int):
    """(vec_id, label, embedding) to _ROW, whole numbers of two bytes where they fit, else doubles; others are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, dims, packed = [], [], []
            for at, vector in enumerate(batch.column(2)):
                if not vector.is_valid or vector.values.null_count:
                    continue
                values = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(values).all() and np.isfinite(values := np.floor(values * scale)).all():
                    kept.append(at)
                    dims.append(len(values))
                    packed.append((values.astype(np.int16) if np.abs(values).max(initial=0) < 2**15 else values).tobytes())
            part = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(dims, pa.int32()), pa.array(packed, pa.binary())], ["vec_id", "label", "dim", "vector"])

    return run


def _matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim))
    for at, v in enumerate(vectors):
        out[at] = np.frombuffer(v, np.int16 if len(v) == 2 * dim else np.float64)
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers; beyond what doubles hold exactly in Python's numbers, kept within 64 bits."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    x, y = ([[int(v) for v in row] for row in m] for m in (a, b))
    return np.array([[min(max(sum(map(int.__mul__, p, q)), _LONG[0]), _LONG[1]) for q in y] for p in x], np.int64)


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


#: Stands for the id of rows without one, which come last in a tie; a frame with nulls would hold ids as doubles.
_NONE = _LONG[1]


def _scored(anchors: pd.DataFrame, rows: pd.DataFrame) -> Iterator[tuple]:
    """An anchor's row, the scores, labels and ids of all rows of the block."""
    dim = int(anchors["dim"].iloc[0])
    of, ids, labels = _matrix(rows["vector"], dim), rows["vec_id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64)
    for at in range(0, len(anchors), AT_ONCE):
        part = anchors.iloc[at : at + AT_ONCE]
        for anchor, scores in zip(part.itertuples(), _products(_matrix(part["vector"], dim), of), strict=True):
            yield anchor, scores, labels, ids


def _in_blocks(anchors: DataFrame, rows: DataFrame, group: list[str], f: Callable, schema: str, block: tuple[int, int]) -> DataFrame:
    """f(anchors, rows) of all pairs of blocks of each group. A block's rows are chosen by a hash of where they lie."""
    parts = lambda df, n, most: df.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(n))
    sizes = checkpointed(parts(anchors, "anchor_blocks", block[0]).join(parts(rows, "row_blocks", block[1]), group))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    spread = lambda n, by: F.pmod(F.xxhash64(by), F.col(n)).cast("int")
    left = anchors.join(sizes, group).withColumn("anchor_block", spread("anchor_blocks", "anchor")).withColumn("row_block", each("row_blocks")).drop("anchor_blocks", "row_blocks")
    right = rows.withColumn("place", F.monotonically_increasing_id()).join(sizes, group).withColumn("row_block", spread("row_blocks", "place")).withColumn("anchor_block", each("anchor_blocks"))
    cell = [*group, "anchor_block", "row_block"]
    columns = [*dict.fromkeys([*cell, "vec_id", "label", "vector"])]
    return left.groupBy(cell).cogroup(right.select(*columns).groupBy(cell)).applyInPandas(f, schema)


def _frame(columns: list[str], found: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(found, columns=columns)


def _best(k: int):
    """The k best rows of the anchor's label in a block, but those with its own id."""

    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(anchors) and len(rows):
            for a, scores, labels, ids in _scored(anchors, rows):
                at = np.flatnonzero((labels == a.label) & (ids != a.anchor_id))
                found += [(a.anchor, ids[i], scores[i]) for i in at[_first(scores[at], ids[at], k)].tolist()]
        return _frame(["anchor", "vec_id", "score"], found)

    return run


def _counts(bits: int):
    """For each window of an anchor, rows of other labels by the digit of their distance from its upper end."""

    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(anchors) and len(rows):
            for a, scores, labels, _ in _scored(anchors, rows):
                other = np.sort(scores[labels != a.label])
                for w in a.windows:
                    inside = other[np.searchsorted(other, w["low"]) : np.searchsorted(other, w["high"], "right")]
                    if len(inside):
                        digits = (np.uint64(w["high"]) - inside.astype(np.uint64)) >> np.uint64(w["shift"])
                        found.append((a.anchor, w["nth"], np.bincount(digits.astype(np.int64), minlength=1 << bits).tolist()))
        return _frame(["anchor", "nth", "counts"], found)

    return run


def _gathered(k: int):
    """For each window, the rows of other labels from its least score up, k of a block at most (the first ones)."""

    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(anchors) and len(rows):
            for a, scores, labels, ids in _scored(anchors, rows):
                for w in a.windows:
                    at = np.flatnonzero((labels != a.label) & (scores >= w["low"]) & (scores <= w["high"]))
                    found += [(a.anchor, w["nth"], ids[i], scores[i]) for i in at[_first(scores[at], ids[at], k)].tolist()]
        return _frame(["anchor", "nth", "vec_id", "score"], found)

    return run


def _share(score: Column, hundredths: int, up: bool) -> Column:
    """hundredths of a score that is no less than 0, rounded to a whole number, without products beyond 64 bits."""
    whole, rest = F.expr("score div 100"), score % 100
    return hundredths * whole + (F.ceil if up else F.floor)(hundredths * rest / 100).cast("long")


def _shift(bits: int) -> Column:
    """Lower bits of a distance within the window that one digit leaves."""
    return F.greatest(F.lit(0), F.length(F.bin(F.col("high") - F.col("low"))) - bits).cast("int")


def _narrowed(state: DataFrame, counted: DataFrame, bits: int, few: int) -> DataFrame:
    """The windows of the next round: the digit that holds the last wanted row, or all that is gathered where `open` is false."""
    digits = 1 << bits
    added = counted.groupBy("anchor", "nth").agg(F.array(*(F.sum(F.get("counts", F.lit(i))) for i in range(digits))).alias("counts"))
    so_far = F.transform(F.sequence(F.lit(1), F.lit(digits)), lambda i: F.aggregate(F.slice("counts", 1, i), F.lit(0).cast("long"), lambda x, y: x + y))
    met = state.join(added, ["anchor", "nth"]).withColumn("so_far", so_far)  # windows without rows go
    met = met.withColumn("digit", F.least(F.size(F.filter("so_far", lambda x: x < F.col("wanted"))), F.lit(digits - 1)))  # the last, where there are fewer rows
    before = F.when(F.col("digit") > 0, F.get("so_far", F.col("digit") - 1)).otherwise(F.lit(0))
    here = F.get("counts", F.col("digit"))
    high = F.col("high") - F.expr("shiftleft(CAST(digit AS BIGINT), shift)")
    width = F.expr("shiftleft(CAST(1 AS BIGINT), shift) - 1")
    # a single score may hold any number of rows: of these each block gives the first ones
    met = met.withColumn("open", (here > few) & (F.col("shift") > 0) & (F.get("so_far", F.lit(digits - 1)) > F.col("wanted")))
    met = met.withColumns({"wanted": F.col("wanted") - before, "high": high, "low": F.greatest(F.col("low"), high - width)})
    return met.withColumn("shift", _shift(bits)).select(*state.columns)


def _with_windows(anchors: DataFrame, windows: DataFrame) -> DataFrame:
    """anchors with an array of windows (nth, low, high, shift); those without go."""
    held = windows.groupBy("anchor").agg(F.collect_list(F.struct("nth", "low", "high", "shift")).alias("windows"))
    return anchors.join(held, "anchor")


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, bits: int = BITS, few: int = FEW, block: tuple[int, int] = (ANCHORS, ROWS)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row of vectors (vec_id, embedding, label) for
    which is_anchor, a condition on vec_id, holds, and each of its `positives` best rows of the same label, the first `negatives` rows
    of other labels with low / 100 <= negative_score / positive_score <= high / 100 for positive scores. A positive score
    of 0 admits negative scores of 0, one below 0 admits none.

    A score is the inner product of floor(scale x); higher ones come first, ties go to the smaller vec_id. Rows without a label or a
    vector, or with a null, NaN or infinity in it, take no part. Only vectors of one length are compared; empty ones score 0.
    Rows without vec_id (the largest long stands for that) come last in a tie and are never anchors; rows that repeat one count each, but an anchor that is
    repeated with its label and vector is one. A row with an anchor's vec_id is none of its positives. Scores beyond 64 bits are held
    at their ends. An empty table, or no anchor, gives an empty result.
    """
    given = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(_NONE)).alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = checkpointed(given.filter("label IS NOT NULL").mapInArrow(_scaled(scale), _ROW))
    anchors = rows.filter(is_anchor & (F.col("vec_id") != _NONE)).select(F.xxhash64("vec_id", "label", "vector").alias("anchor"), F.col("vec_id").alias("anchor_id"), *(F.col(c).alias(c) for c in ("label", "dim", "vector")))  # columns of their own: both meet in cogroups
    anchors = checkpointed(anchors.dropDuplicates(["anchor"]))
    best = _in_blocks(anchors, rows, ["dim", "label"], _best(positives), "anchor long, vec_id long, score long", block)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")
    pairs = best.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= positives)
    pairs = checkpointed(pairs.select("anchor", "nth", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    state = pairs.filter("positive_score >= 0").withColumn("score", F.col("positive_score"))
    state = state.select("anchor", "nth", _share(F.col("score"), low, True).alias("low"), _share(F.col("score"), high, False).alias("high"), F.lit(negatives).cast("long").alias("wanted"), F.lit(True).alias("open"))
    state = checkpointed(state.filter("low <= high").withColumn("shift", _shift(bits)))
    tops, least = state.select("anchor", "nth", F.col("high").alias("top")), []
    while not state.isEmpty():
        counted = _in_blocks(_with_windows(anchors, state), rows, ["dim"], _counts(bits), "anchor long, nth int, counts array<long>", block)
        narrowed = checkpointed(_narrowed(state, counted, bits, few))
        least.append(narrowed.filter("NOT open").select("anchor", "nth", "low"))
        state = narrowed.filter("open")
    if not least:
        least = [state.select("anchor", "nth", "low")]
    found = least[0]
    for more in least[1:]:
        found = found.union(more)
    ends = found.join(tops, ["anchor", "nth"]).select("anchor", "nth", "low", F.col("top").alias("high"), F.lit(0).alias("shift"))
    taken = _in_blocks(_with_windows(anchors, ends), rows, ["dim"], _gathered(negatives), "anchor long, nth int, vec_id long, score long", block)
    rank = F.row_number().over(Window.partitionBy("anchor", "nth").orderBy(F.desc("score"), "vec_id"))
    ranked = taken.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    out = ranked.join(pairs, ["anchor", "nth"]).join(anchors.select("anchor", "anchor_id"), "anchor")
    known = lambda c, name: F.when(F.col(c) != _NONE, F.col(c)).alias(name)
    return out.select("anchor_id", known("positive_id", "positive_id"), "rank", known("vec_id", "negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that repeat a vec_id count each; those without one are never anchors."""
    given = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(given.withColumn("label", moved), F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH whole AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, c.r, c.vec_id, a.label = c.label AS same, CAST(list_sum([x[1] * x[2] FOR x IN list_zip(a.v, c.v)]) AS BIGINT) AS score
  FROM whole a JOIN whole c ON a.vec_id % 100 = 0 AND (a.label <> c.label OR c.vec_id IS DISTINCT FROM a.vec_id)
), positives AS (
  SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST) AS nth FROM scored WHERE same
), ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.nth ORDER BY n.score DESC, n.vec_id NULLS LAST) AS INTEGER) AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN scored n ON p.a = n.a AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score WHERE p.nth <= 5
)
SELECT * FROM ranked WHERE rank <= 10
"""
