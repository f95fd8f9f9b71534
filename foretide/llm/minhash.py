"""MinHash near-dedup: one permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

One hash of each shingle deals a document's set into BINS bins, and the least hash of a bin is its value. An empty bin takes the
value of another one, drawn by a hash of its own number and the try until a bin is met that was not empty, so that bins agree
with a chance of the similarity for small sets as well. ROWS bins are a band, a band's values the key of a bucket, and a pair
with a similarity of 0.8 shares none of 32 buckets with a chance of 5e-8.

A bucket never emits pairs of its members but a star: all are compared with one centre, the least by hash, so that the same
few centres come up in many buckets. Links that full sets confirm make components, and within one nothing is left to compare.
What remains are buckets that still hold several components beside their centre: sets that are less alike, such as
those of a frequent passage, or like another one but not the centre. Their
documents meet again by prefixes: two sets of the given similarity share one of their rarest shingles, a fifth of each. What
shares such shingles across components makes groups, and their sets are compared in blocks of bounded size by an index of
shingles in each task, which emits no more links than it has members. So no link is lost at frequent keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from foretide.llm.common import materialised, table, whole_text
from foretide.llm.components import components

SHINGLE = 4
#: In hundredths.
SIMILARITY = 80
BINS = 128
ROWS = 4
SEED = 42
#: Standard deviations by which a pair's share of equal bins may lie under that of pairs of the least similarity.
SPARE = 6
#: Bytes of sets in a block, at most about; a task holds two blocks.
BLOCK = 1 << 23
#: Tries for an empty bin whose donors are drawn beforehand; with one full bin of 128 one in 10^14 texts needs more.
TRIES = 4096


def _donors(bins: int) -> np.ndarray:
    """Of each try and bin, by a mixed hash of both."""
    x = np.arange(TRIES, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, bins + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(bins)).astype(np.int64)


_DONORS: dict[int, np.ndarray] = {}


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Of the distinct shingles, in order; fewer words are one shingle, no words none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    last = ends[shingle - 1 :].tolist() or [len(joined)]
    starts = [0, *(ends[: len(last) - 1] + 1).tolist()]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, last, strict=True)), np.uint64, len(last)))


def bins_of(hashes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The value of each bin (a power of two of them) for hashes in order, at least one."""
    of = (hashes >> np.uint64(64 - (bins.bit_length() - 1))).astype(np.int64)
    first = np.searchsorted(of, np.arange(bins))  # hashes are in order: the first one of a bin is its least
    full = np.concatenate([of, [bins]])[first] == np.arange(bins)
    source = np.where(full, np.arange(bins), -1)
    if bins not in _DONORS:
        _DONORS[bins] = _donors(bins)
    for at in range(0, TRIES, 64):
        empty = np.flatnonzero(source < 0)
        if not len(empty):
            break
        tried = _DONORS[bins][at : at + 64, empty]
        met = full[tried]
        to = tried[met.argmax(axis=0), np.arange(len(empty))]
        source[empty] = np.where(met.any(axis=0), to, -1)
    source[source < 0] = np.flatnonzero(full)[0]
    return hashes[first[source]]


def _marked(shingle: int, bins: int, rows: int):
    """(row, doc_id, text) to row, doc_id, node (a hash of the set; null if empty), n, bands (the keys of its buckets), short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                nodes, sizes, bands, short = [], [], [], []
                for text in part.column(2).to_pylist():
                    hashes = shingle_hashes(text, shingle)
                    sizes.append(len(hashes))
                    if not len(hashes):
                        nodes.append(None)
                        bands.append(None)
                        short.append(None)
                        continue
                    values = bins_of(hashes, bins)
                    packed = values.tobytes()
                    keys = [xxhash.xxh64_intdigest(packed[i : i + 8 * rows], i) for i in range(0, 8 * bins, 8 * rows)]
                    nodes.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))
                    bands.append(np.array(keys, np.uint64).view(np.int64))
                    short.append((values & np.uint64(255)).astype(np.uint8).tobytes())
                signed = pa.array([None if x is None else x - (x >> 63 << 64) for x in nodes], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:2], signed, pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(short, pa.binary())], ["row", "doc_id", "node", "n", "bands", "short"])

    return run


def _sets(shingle: int):
    """(node, text) to (node, held): the hashes of the set, eight bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                held = [shingle_hashes(t, shingle).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held, pa.binary())], ["node", "held"])

    return run


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, held) to a row for each shingle: node, n, key."""
    for batch in batches:
        for node, held in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            keys = np.frombuffer(held.as_buffer(), np.int64)
            for at in range(0, len(keys), 65536):
                some = keys[at : at + 65536]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), node)), pa.array(np.full(len(some), len(keys))), pa.array(some)], ["node", "n", "key"])


@F.pandas_udf(IntegerType())
def _equal_bins(a: pd.Series, b: pd.Series) -> pd.Series:
    stacked = lambda x: np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1) if len(x) else np.zeros((0, 1), np.uint8)
    return pd.Series((stacked(a) == stacked(b)).sum(axis=1).astype(np.int32))


@F.pandas_udf(LongType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    of = lambda x: np.frombuffer(x, np.uint64)
    return pd.Series([len(np.intersect1d(of(x), of(y), assume_unique=True)) for x, y in zip(a, b, strict=True)], dtype="int64")


def _suffixed(df: DataFrame, end: str, *columns: str) -> DataFrame:
    return df.select(F.col("node").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in columns))


def confirmed(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: int, bins: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets have the given similarity. Sizes and bins rule out most others first."""
    share = similarity / 100
    least = max(0, int(bins * share - SPARE * np.sqrt(bins * share * (1 - share))))
    near = pairs.join(_suffixed(nodes, "a", "n", "short"), "a").join(_suffixed(nodes, "b", "n", "short"), "b")
    near = near.filter(100 * F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b")).filter(_equal_bins("short_a", "short_b") >= least)
    near = materialised(near.select("a", "b", "n_a", "n_b"))
    both = near.join(_suffixed(sets, "a", "held"), "a").join(_suffixed(sets, "b", "held"), "b").withColumn("common", _common("held_a", "held_b"))
    return both.filter(100 * F.col("common") >= similarity * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def _apart(members: DataFrame) -> DataFrame:
    """Members of buckets (key, node, label, ...) that hold more than one label."""
    keys = members.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    return members.join(keys, "key", "left_semi")


class _Labels:
    """node, label for all nodes that have links so far; a node without is its own label."""

    def __init__(self) -> None:
        self.table: DataFrame | None = None

    def of(self, members: DataFrame) -> DataFrame:
        """members (node and other columns) with their labels."""
        if self.table is None:
            return members.withColumn("label", F.col("node"))
        return members.join(self.table.select("node", F.col("label").alias("known")), "node", "left").withColumn("label", F.coalesce("known", "node")).drop("known")

    def add(self, links: DataFrame) -> None:
        """links (a, b) between labels."""
        if links.isEmpty():
            return
        joined = components(links)
        if self.table is not None:
            further = joined.select(F.col("node").alias("label"), F.col("label").alias("next"))
            moved = self.table.join(further, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
            joined = materialised(moved.union(joined.join(self.table, "node", "left_anti").select("node", "label")))
        self.table = joined


def _stars(members: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: int, bins: int) -> DataFrame:
    """Links (a, b) of members of buckets (key, node, centre) with their centres."""
    pairs = members.filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    return confirmed(materialised(pairs), nodes, sets, similarity, bins)


def _prefixes(left: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """key, node: of each node its rarest shingles, as many as cannot all be missing from a set of the given similarity."""
    asked = sets.join(left, "node", "left_semi").select("node", "held")
    shingles = materialised(asked.mapInArrow(_shingles, "node long, n long, key long"))
    rare = shingles.groupBy("key").agg(F.count(F.lit(1)).alias("times"))
    order = Window.partitionBy("node").orderBy("times", "key")
    ranked = shingles.join(rare, "key").withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * similarity / 100) + 1).filter("times > 1").select("key", "node")


def _linked(similarity: int):
    """Links (a, b) between the labels of a cell's sets (label, held), as many as join what the similarity joins. An index of the rarest
    shingles of each set, as in _prefixes(), finds what a set is compared with, of other labels only."""

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        labels, sets = cell["label"].to_numpy(np.int64), [np.frombuffer(x, np.uint64) for x in cell["held"]]
        sizes = np.array([len(x) for x in sets])
        shingle = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
        times = np.bincount(shingle)
        rare, at = [], 0
        for n in sizes.tolist():
            of, at = shingle[at : at + n], at + n
            rare.append(of[np.lexsort((of, times[of]))[: n - (n * similarity + 99) // 100 + 1]])
        del shingle
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in rare])
        indexed = np.concatenate(rare)
        order = np.argsort(indexed, kind="stable")
        owner, first = owner[order], np.searchsorted(indexed[order], np.arange(len(times) + 1))
        root = {x: x for x in labels.tolist()}

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        values, counts = np.unique(labels, return_counts=True)
        found = []
        for x in np.flatnonzero(labels != values[counts.argmax()]).tolist():  # of two labels one is not the most frequent
            met = np.unique(np.concatenate([owner[first[t] : first[t + 1]] for t in rare[x].tolist()]))
            alike = (labels[met] != labels[x]) & (100 * np.minimum(sizes[met], sizes[x]) >= similarity * np.maximum(sizes[met], sizes[x]))
            for y in met[alike].tolist():
                a, b = top(int(labels[x])), top(int(labels[y]))
                if a == b:
                    continue
                common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * common >= similarity * (sizes[x] + sizes[y] - common):
                    root[a] = b
                    found.append((int(labels[x]), int(labels[y])))
        return pd.DataFrame(found, columns=["a", "b"])

    return run


def _in_blocks(buckets: DataFrame, labels: _Labels, held: DataFrame, sets: DataFrame, similarity: int, block: int) -> DataFrame:
    """Links (a, b) between the labels of all sets that meet in buckets (key, node), perhaps over others in between."""
    met = materialised(_apart(labels.of(buckets)).select("key", "node"))
    lows = met.groupBy("key").agg(F.min("node").alias("low"))
    groups = components(met.join(lows, "key").select(F.col("node").alias("a"), F.col("low").alias("b"))).withColumnRenamed("label", "of")
    members = materialised(labels.of(groups.join(held.select("node", "n"), "node")))
    blocks = members.groupBy("of").agg(F.ceil(F.sum("n") * 8 / block).cast("int").alias("blocks"))
    dealt = members.join(blocks, "of").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.select("of", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "label").join(sets, "node")
    return cells.groupBy("of", "i", "j").applyInPandas(_linked(similarity), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY, bins: int = BINS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text; other columns are ignored).

    Texts whose sets of distinct shingles have a Jaccard similarity of `similarity` hundredths or more are linked, and component_id is
    the smallest doc_id that can be reached. Fewer words than a shingle are one; texts without words (or null) are linked with
    nothing, and are components of their own row. Equal sets are one node, so copies need no links. Null doc_ids are passed over
    for component_id unless there is no other. kept: doc_id is component_id (both null counts). Repeated rows come out alike; an
    empty table gives an empty result. bins is a power of two and a multiple of rows. Sets are told apart by 64-bit hashes.
    """
    if bins & (bins - 1) or bins % rows:
        raise ValueError("bins is a power of two and a multiple of rows")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    texts = texts.select(F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text").alias("row"), "doc_id", "text")
    marked = materialised(texts.mapInArrow(_marked(shingle, bins, rows), "row long, doc_id long, node long, n long, bands array<long>, short binary"))
    worded = marked.filter("node IS NOT NULL")
    nodes = worded.select("node", "n", "bands", "short").dropDuplicates(["node"])
    keys = nodes.select("node", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("centre")).filter("size > 1").select("key", "centre")
    members = materialised(keys.join(buckets, "key"))
    asked = members.select("node").distinct()
    held = materialised(nodes.select("node", "n", "short").join(asked, "node", "left_semi"))
    one = worded.join(asked, "node", "left_semi").groupBy("node").agg(F.min("row").alias("row"))  # of equal sets one is read again
    sets = texts.select("row", "text").join(one, "row").select("node", "text").mapInArrow(_sets(shingle), "node long, held binary")
    sets = materialised(sets.dropDuplicates(["node"]))
    labels = _Labels()
    labels.add(materialised(_stars(members, held, sets, similarity, bins)))
    left = materialised(_apart(labels.of(members.filter("node <> centre").select("key", "node"))).select("node").distinct())
    if not left.isEmpty():
        labels.add(materialised(_in_blocks(_prefixes(left, sets, similarity), labels, held, sets, similarity, block)))
    label: Column = F.col("node")
    if labels.table is not None:
        marked = marked.join(labels.table, "node", "left")
        label = F.coalesce("label", "node")
    placed = marked.select("doc_id", "n", label.alias("label"))
    least = placed.filter("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("low"))
    out = placed.join(least, "label", "left").withColumn("component_id", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("low")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have no shingles and are their own components; rows that repeat come out alike."""
    return near_duplicates(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH RECURSIVE words AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] END)) AS s FROM words
), nodes AS (
  SELECT row_number() OVER (ORDER BY min(doc_id)) AS node, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), shingles AS (
  SELECT node, n, unnest(s) AS k FROM nodes
), edges AS (
  SELECT a.node AS a, b.node AS b FROM shingles a JOIN shingles b ON a.k = b.k AND a.node <> b.node GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT node, node AS other FROM nodes UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.other = e.a
), labels AS (
  SELECT node, min(other) AS label FROM reach GROUP BY node
), placed AS (
  SELECT t.doc_id, len(t.s) AS n, l.label FROM sets t LEFT JOIN nodes d ON t.s = d.s LEFT JOIN labels l USING (node)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, c AS component_id, doc_id IS NOT DISTINCT FROM c AS kept
FROM (SELECT *, CASE WHEN label IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY label) END AS c FROM placed)
"""
