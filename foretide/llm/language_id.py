"""Language identification by compression.

For each language a zstandard raw-content dictionary is made of labelled text: short pieces of a bounded sample of its
documents, as they stand but for upper case. A text is cut into blocks of a few thousand bytes, so that what a long text has
told about itself doesn't stand in for the dictionary; every block is encoded with every dictionary, and the language whose
encodings are smallest in all wins. Where the margin is narrow although there is much to encode, the text is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foretide.llm.common import crc_mod, table

#: Texts of a language that pieces are taken from, about (all, if fewer), chosen by their hash; languages, the most frequent ones.
SAMPLE = 2000
LANGUAGES = 256
#: Characters of a piece, and bytes of a dictionary.
PIECE = 500
DICTIONARY = 112_000
LEVEL = 5
#: Bytes of a text that are encoded at a time.
BLOCK = 4096
#: A margin under this is narrow, for texts of at least so many bytes.
MARGIN = 0.002
EVIDENCE = 400
UNKNOWN = "und"

_letter = regex.compile(r"\p{L}").search


def learn(labelled: DataFrame, sample: int = SAMPLE, piece: int = PIECE, size: int = DICTIONARY) -> list[tuple[str, bytes]]:
    """(language, dictionary) of each language, those with most documents first, from the rows of labelled (text, lang) that
    have a text and a language. Equal texts count once. Pieces are drawn from `sample` texts at most, and a dictionary holds as many of them,
    whole, as `size` bytes allow: some 220 of 500 characters. The driver gets LANGUAGES x `sample` pieces at most."""
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("text", F.lit("sample")).alias("hash"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("hash").alias("texts"))
    many = counts.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not many:
        return []
    share = F.create_map(*[F.lit(x) for r in many for x in (r.lang, min(1.0, 1.2 * sample / max(1, r.texts)))])[F.col("lang")]
    start = F.pmod("hash", F.greatest(F.char_length("text") - piece, F.lit(0)) + 1).cast("int") + 1
    chosen = rows.filter(F.pmod("hash", F.lit(1_000_003)) < share * 1_000_003)
    pieces = chosen.groupBy("lang", "hash").agg(F.min(F.lower(F.substr("text", start, F.lit(piece)))).alias("piece"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    found = pieces.withColumn("rank", rank).filter(F.col("rank") <= sample).select("lang", "piece", "rank").collect()
    of: dict[str, list[tuple[int, str]]] = {r.lang: [] for r in many}
    for r in found:
        of[r.lang].append((r.rank, r.piece))
    return [(lang, _whole_pieces([x for _, x in sorted(held)], size)) for lang, held in of.items()]


def _whole_pieces(pieces: list[str], size: int) -> bytes:
    """The first pieces that fit, a line each; of a piece that alone is longer its beginning."""
    out = b""
    for piece in pieces:
        more = (b"\n" if out else b"") + piece.encode("utf-8", "surrogatepass")
        if len(out) + len(more) > size:
            return out or more[:size]
        out += more
    return out


def _compressors(dictionaries: list[tuple[str, bytes]], level: int) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang, content in dictionaries:
        words = zstandard.ZstdCompressionDict(content or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=level)
        out.append((lang, zstandard.ZstdCompressor(dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return out


def _classify(dictionaries: list[tuple[str, bytes]], level: int, margin: float, evidence: int, text_at: int):
    """(row) to row, lang_pred, score, rejected, few rows at a time; text_at: the place of the text in a row."""

    def best(text: str | None, compressors: list) -> tuple[str, float, bool]:
        if not compressors or not text or not _letter(text):
            return UNKNOWN, 0.0, True
        data = text.lower().encode("utf-8", "surrogatepass")
        blocks = [data[a : a + BLOCK] for a in range(0, len(data), BLOCK)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for _, c in compressors]
        least = min(sizes)
        at = sizes.index(least)
        second = min((s for i, s in enumerate(sizes) if i != at), default=None)
        score = 1.0 if second is None else (second - least) / second
        return compressors[at][0], score, score < margin and len(data) >= evidence

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _compressors(dictionaries, level)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.column(0).slice(at, 256)
                lang, score, rejected = zip(*[best(t, compressors) for t in rows.field(text_at).to_pylist()], strict=True)
                new = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
                yield pa.RecordBatch.from_arrays([rows, *new], ["row", "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, dictionaries: list[tuple[str, bytes]], level: int = LEVEL, margin: float = MARGIN, evidence: int = EVIDENCE) -> DataFrame:
    """row (a struct of all columns of docs), lang_pred, score, rejected for each row of docs.

    lang_pred is a learned language, or `und` where the text is null or empty, has no letter, or nothing was learned.
    score, from 0 to 1, is the share by which the second best encoding is larger; equal encodings go to the language with
    more documents. rejected: `und`, or a score under `margin` on at least `evidence` bytes. Only the text is looked at.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text_at = docs.columns.index("text") if "text" in docs.columns else [c.lower() for c in docs.columns].index("text")
    schema = f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double, rejected boolean"
    return rows.mapInArrow(_classify(dictionaries, level, margin, evidence, text_at), schema)


def training_rows(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    return docs.filter(~(held_out if held_out is not None else crc_mod("doc_id", 4) == 2))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null or empty text, or one without a letter, is `und`; rows that repeat are predicted alike."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), learn(training_rows(docs)))
    found = found.select(F.col("row.doc_id").alias("doc_id"), "lang_pred", "score", "rejected")
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
