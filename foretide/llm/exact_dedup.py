"""Exact dedup with a heavy-hitter split.

Misra-Gries summaries of the text digests, one per partition and merged once, hold every digest that makes up more
than 1/(counters+1) of the rows. Their exact counts are then taken, and those that really are frequent are broadcast:
their rows are decided where they lie and never shuffled. All other digests are too rare to unbalance a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foretide.llm.common import checkpointed, table, whole_text


def _summary(counters: int):
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for digest, n in Counter(batch.column(0).to_pylist()).items():
                held[digest] = held.get(digest, 0) + n
            if len(held) > counters:
                cut = sorted(held.values(), reverse=True)[counters]
                held = {d: n - cut for d, n in held.items() if n > cut}
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["digest", "n"])

    return summarise


def frequent_digests(digests: DataFrame, counters: int = 1024) -> DataFrame:
    """digest, group_size, keep_id of every digest with more than 1/(counters+1) of the rows: at most `counters` rows."""
    total = digests.count()
    guesses = digests.select("digest").mapInArrow(_summary(counters), "digest binary, n long")
    guesses = guesses.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(counters).select("digest")
    exact = digests.join(F.broadcast(guesses), "digest").groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"))
    return checkpointed(exact.filter(F.col("group_size") > total / (counters + 1)))


def exact_dedup(docs: DataFrame, counters: int = 1024) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs (doc_id, text; other columns are ignored).

    Texts are equal when identical; a null text is the empty text. The row with the largest doc_id of a group stays; a null
    doc_id sorts before all others. Rows that repeat both doc_id and text count in group_size and share one decision. An
    empty table gives an empty result. Broadcast: at most `counters` rows of 50 bytes.
    """
    digests = checkpointed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(whole_text().cast("binary"), 256)).alias("digest")))
    heavy = F.broadcast(frequent_digests(digests, counters))
    own = Window.partitionBy("digest")
    light = digests.join(heavy, "digest", "left_anti").select(
        "doc_id", "digest", F.max("doc_id").over(own).alias("keep_id"), F.count(F.lit(1)).over(own).alias("group_size")
    )
    decided = digests.join(heavy, "digest").select("doc_id", "digest", "keep_id", "group_size").unionByName(light)
    return decided.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null counts as empty; of rows without doc_id none stays unless all of a group are without; rows that repeat the largest doc_id stay alike."""
    return exact_dedup(table(spark, sf_dir, "documents"))


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY sha256(coalesce(text, '')))
"""
