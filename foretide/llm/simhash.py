"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits have a word in common that lies within r bits of either. Every fingerprint
emits all words within r bits of its own; whatever meets at a word differs in at most 2r bits, so a word links all that
meet there to the smallest of them: as many links as fingerprints, never all pairs.

With r = 2 that is 2,081 words for each fingerprint, far more than the text itself. A fingerprint that shares no four of
its eight bytes with another one cannot be within 4 bits of it (4 differing bits leave four bytes untouched), so only
fingerprints that share some four bytes go on to emit their ball. This drops no link.

Texts whose shingles agree by a given share differ in more bits than that: at a Jaccard similarity of 0.8 in about 15 % of
them. Such texts are linked by similar_groups() on the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foretide.llm.common import checkpointed, table, whole_text
from foretide.llm.components import components
from foretide.llm.similar import similar

SHINGLE = 4
RADIUS = 4
SEED = 42
#: For links by similarity: words of a shingle, and the least similarity in hundredths.
SIMILAR_SHINGLE = 5
SIMILARITY = 80


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """As a signed 64-bit number."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    last = ends[shingle - 1 :].tolist() or [len(joined)]
    starts = [0, *(ends[: len(last) - 1] + 1).tolist()]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(last), 8192):
        hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at : at + 8192], last[at : at + 8192], strict=True)]
        counts += np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(last)).tobytes(), "big", signed=True)


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[int] = []
            for at in range(0, batch.num_rows, 256):
                found += [fingerprint(t, shingle) for t in batch.column(1).slice(at, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return texts.mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _values(masks: list[int]):
    return F.array(*[F.lit(_signed(m)).cast("long") for m in masks])


def candidates(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp of all fingerprints that share 8 - radius of their 8 bytes with another one."""
    masks = [sum(255 << 8 * i for i in kept) for kept in combinations(range(8), 8 - radius)]
    keys = distinct.select("fp", F.explode(F.transform(_values(masks), lambda m: F.col("fp").bitwiseAND(m))).alias("key"))
    shared = keys.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low < high").select("key")
    return keys.join(shared, "key", "left_semi").select("fp").distinct()


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: links that join all fingerprints within radius bits of each other, perhaps over others between them."""
    masks = [sum(1 << i for i in flipped) for n in range(radius // 2 + 1) for flipped in combinations(range(64), n)]
    near = checkpointed(candidates(distinct, radius))
    balls = near.select("fp", F.explode(F.transform(_values(masks), lambda m: F.col("fp").bitwiseXOR(m))).alias("word"))
    met = balls.select(F.col("fp").alias("a"), F.min("fp").over(Window.partitionBy("word")).alias("b"))
    return checkpointed(met.filter("a <> b").distinct())


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs (doc_id, text; other columns are ignored).

    Fingerprints within `radius` bits (even, 4 at most) are linked, and component_id is the smallest doc_id that can be
    reached; equal fingerprints are the same node, so copies need no links. A null text is empty; texts without words have
    fingerprint zero. Null doc_ids are passed over for component_id unless there is no other. Empty tables give empty results.
    """
    if radius not in (0, 2, 4):
        raise ValueError("radius is 0, 2 or 4")
    marked = checkpointed(fingerprints(docs, shingle))
    distinct = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("low")))
    labels = components(links(distinct, radius))
    low = distinct.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("label", "fp").alias("label"))
    low = checkpointed(low)
    least = low.groupBy("label").agg(F.min("low").alias("component_id"))
    named = checkpointed(low.join(least, "label").select("fp", "component_id"))
    out = marked.join(named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def similar_groups(docs: DataFrame, shingle: int = SIMILAR_SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, component_id (of no meaning but that it is equal within a group) for each row of docs (doc_id, text; other columns
    are ignored).

    Texts whose sets of shingles have a Jaccard similarity of `similarity` hundredths or more are linked, and texts without words are
    alike. All links are found, by similar.similar(). Fewer words than a shingle are one shingle. A null text is empty; equal texts are
    one node. Empty tables give empty results.
    """
    node = F.xxhash64(whole_text()).alias("node")
    found = similar(docs.select(node.alias("id"), "text"), shingle, similarity)
    groups = found.select(F.col("id").alias("node"), F.coalesce("label", F.xxhash64(F.lit(""))).alias("component_id"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), node).join(groups, "node").select("doc_id", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have fingerprint zero, linked like any other; rows that repeat are one node."""
    return simhash_groups(table(spark, sf_dir, "documents"))
