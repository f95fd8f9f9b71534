"""Line dedup: lines that several documents share stay only in the first document that holds them.

Lines are exploded with their positions, normalised and hashed to 128 bits. Distinct documents are counted for each hash, in
two steps, so that a line held by a third of all documents is counted in many tasks and moves a few rows from each to its sum. A
document then learns the positions that it loses, and is put together again from the others in their order. All of it is
JVM-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foretide.llm.common import SPACE, ascii_lower, checkpointed, table, whole_text

MIN_KEY = 10
#: Documents that must hold a line before it is shared.
LEAST = 2
#: Stands for a null doc_id, so that it sorts before all others.
_NO_ID = -(2**63)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _parts(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id")


def shared_lines(docs: DataFrame, min_key: int = MIN_KEY, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(id, hash of the text, position, line hash) of all long enough lines; hash and first document of those that at least
    `least` documents hold."""
    keys = F.transform(_parts(whole_text()), line_key)
    lines = docs.select(_id(), F.xxhash64(whole_text()).alias("same"), F.posexplode(keys).alias("at", "key"))
    lines = lines.filter(F.char_length("key") >= min_key).select("id", "same", "at", F.unhex(F.md5(F.col("key").cast("binary"))).alias("hash"))
    held = lines.select("hash", "id").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("documents"), F.min("id").alias("first"))
    return lines, checkpointed(held.filter(F.col("documents") >= least).select("hash", "first"))


def line_dedup(docs: DataFrame, min_key: int = MIN_KEY, least: int = LEAST) -> DataFrame:
    """The rows of docs with all their columns, text replaced by the lines that stay, and last a struct `line_dedup`
    of n_lines (before) and n_dropped.

    A line's key is the line without ASCII white space at its ends and with A-Z lowered. Keys of `min_key` code points or
    more that at least `least` documents hold lose all lines but those of the smallest doc_id. A null or empty text is one
    empty line, and gives the empty text; a text of which no line stays is empty as well. Rows that repeat a doc_id are
    one document; a null doc_id is one too and sorts first. An empty table gives an empty result. A column of docs that
    is named line_dedup is replaced.
    """
    lines, shared = shared_lines(docs, min_key, least)
    # Rows of one document are told apart by their texts; equal ones lose the same positions.
    lost = lines.join(shared, "hash").filter("id > first").groupBy("id", "same").agg(F.collect_set("at").alias("lost"))
    names = [c for c in docs.columns if c != "line_dedup"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), _id(), F.xxhash64(whole_text()).alias("same"))
    met = rows.join(lost, ["id", "same"], "left").select("row", _parts(F.coalesce(F.col("row.text"), F.lit(""))).alias("parts"), F.coalesce("lost", F.array().cast("array<int>")).alias("lost"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "lost")
    text = F.when(F.size("lost") == 0, F.coalesce(F.col("row.text"), F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get("parts", i)), "\n"))
    columns = [text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in names]
    return met.select(*columns, F.struct(F.size("parts").cast("long").alias("n_lines"), F.size("lost").cast("long").alias("n_dropped")).alias("line_dedup"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null or empty text is one empty line; rows that repeat a doc_id are one document."""
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), shared AS (
  SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT doc_id, pos, line, s.key IS NOT NULL AND doc_id <> first AS lost FROM lines l LEFT JOIN shared s ON l.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
