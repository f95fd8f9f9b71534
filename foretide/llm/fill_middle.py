"""Fill-in-the-middle by relational units.

A text is a row of units, the matches of a pattern (by default its code points), and a cut is asked for after so many of them.
Units become rows in two steps, so that there are far fewer rows than characters: runs of RUN units first, whose units and
characters are summed in order by a window, and a cut is joined to the run that holds its unit; then the units of these runs
alone, summed and joined by their place in the run. What comes out is one row of offsets for each document, and the
text is cut there by substrings. Texts are shuffled once, by a hash of the row; all windows and joins keep that order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foretide.llm.common import table, whole_text

#: A unit, as a Java pattern whose matches lie side by side over the whole text.
CODE_POINT = "(?s)."
#: Units in a run: a document of n units has n / RUN rows, and two times RUN more for its cuts.
RUN = 64
SEED = 1
#: Of a hundred documents so many stay plain, and of a hundred others so many have the suffix first.
PLAIN = 10
SUFFIX_FIRST = 20
#: The markers before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_KEY = ("key_a", "key_b")


def _draws(seed: int) -> list[Column]:
    """Four numbers of 32 bits from the sha256 of seed and doc_id; a null doc_id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def cut_offsets(keyed: DataFrame, seed: int = SEED, unit: str = CODE_POINT, run: int = RUN) -> DataFrame:
    """key_a, key_b, n units, and the characters before the two cuts (low, high), for each distinct row of keyed (key_a, key_b,
    doc_id, text), which is dealt by its key. A text without units has no row here."""
    many = F.regexp_extract_all("text", F.lit(f"(?:{unit}){{1,{run}}}+"), F.lit(0))
    runs = keyed.select(*_KEY, "doc_id", F.posexplode_outer(many).alias("run", "piece"))  # not outer, a filter would be put before the exchange
    runs = runs.dropDuplicates([*_KEY, "doc_id", "run"]).filter("piece IS NOT NULL")
    runs = runs.withColumn("units", F.regexp_count("piece", F.lit(unit))).withColumn("chars", F.char_length("piece"))
    so_far = Window.partitionBy(*_KEY, "doc_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.select("*", *(F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(f"{c}_before") for c in ("units", "chars")))

    draw = _draws(seed)
    totals = placed.groupBy(*_KEY).agg(F.sum("units").alias("n"), F.first("doc_id").alias("doc_id"))
    ordinals = [draw[i] % (F.col("n") + 1) for i in (0, 1)]
    requests = totals.select(F.col("key_a").alias("of_a"), F.col("key_b").alias("of_b"), "n", F.explode(F.array(*(F.struct(F.lit(end).alias("end"), f(*ordinals).alias("ordinal")) for end, f in (("low", F.least), ("high", F.greatest))))).alias("cut"))
    requests = requests.select("of_a", "of_b", "n", "cut.end", "cut.ordinal")
    inside = (F.col("key_a") == F.col("of_a")) & (F.col("key_b") == F.col("of_b"))
    # the cut after unit `ordinal` lies in the run that holds it; the cut before all units in the first
    place = F.greatest("ordinal", F.lit(1))
    found = placed.join(requests, inside & (place > F.col("units_before")) & (place <= F.col("units_before") + F.col("units")))

    units = found.select(*_KEY, "n", "end", "chars_before", (F.col("ordinal") - F.col("units_before")).alias("wanted"), F.posexplode_outer(F.regexp_extract_all("piece", F.lit(unit), F.lit(0))).alias("at", "unit"))
    up_to = Window.partitionBy(*_KEY, "end").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    units = units.withColumn("offset", F.col("chars_before") + F.sum(F.char_length("unit")).over(up_to))
    reached = F.when(F.col("at") + 1 == F.col("wanted"), F.col("offset")).when((F.col("wanted") == 0) & (F.col("at") == 0), F.lit(0))
    return units.groupBy(*_KEY).agg(F.first("n").alias("n"), *(F.max(F.when(F.col("end") == e, reached)).alias(e) for e in ("low", "high")))


def fill_in_middle(docs: DataFrame, seed: int = SEED, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, unit: str = CODE_POINT, run: int = RUN) -> DataFrame:
    """doc_id, text, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output, for each row of
    docs (doc_id, text; other columns are ignored).

    Cuts and forms are drawn from seed and doc_id. A text without units or with a marker in it is plain, and the output of plain
    texts is the text. A null text is empty, a null doc_id draws as the empty text, and rows that repeat come out alike.
    An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    keyed = rows.select(F.xxhash64("doc_id", "text").alias("key_a"), F.xxhash64("text", "doc_id", F.lit(seed)).alias("key_b"), "doc_id", "text").repartition(*_KEY)
    cuts = cut_offsets(keyed, seed, unit, run)
    draw = _draws(seed)
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when(F.col("n").isNull() | marked | (draw[2] % 100 >= 100 - plain), "plain").when(draw[3] % 100 < suffix_first, "spm").otherwise("psm")
    out = keyed.join(cuts.hint("shuffle_hash"), [*_KEY], "left").withColumn("form", form)
    at = lambda a, length: F.col("text").substr(a + 1, length)
    prefix, middle, suffix = at(F.lit(0), F.col("low")), at(F.col("low"), F.col("high") - F.col("low")), at(F.col("high"), F.char_length("text"))
    mark = {k: F.lit(k) for k in (PREFIX, SUFFIX, MIDDLE)}
    output = F.when(F.col("form") == "psm", F.concat(mark[PREFIX], prefix, mark[SUFFIX], suffix, mark[MIDDLE], middle))
    output = output.when(F.col("form") == "spm", F.concat(mark[SUFFIX], suffix, mark[PREFIX], prefix, mark[MIDDLE], middle)).otherwise(F.col("text"))
    cut = F.col("form") != "plain"
    return out.select("doc_id", "text", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "form", F.when(cut, F.col("low")).cast("long").alias("prefix_chars"), F.when(cut, F.col("high") - F.col("low")).cast("long").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of fill_in_middle() was made from. The parts hold no marker, and none can begin in a part and
    end in a marker, since only a marker's first character is `<`."""
    part = lambda x, mark, which: F.substring_index(x, mark, which)
    rest, middle = output.substr(F.lit(len(PREFIX) + 1), F.char_length(output)), part(output, MIDDLE, -1)
    head = part(rest, MIDDLE, 1)
    psm = F.concat(part(head, SUFFIX, 1), middle, part(head, SUFFIX, -1))
    spm = F.concat(part(head, PREFIX, -1), middle, part(head, PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null or empty text is plain; rows that repeat come out alike."""
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP13_SQL = """
WITH drawn AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents
), cuts AS (
  SELECT *, CAST('0x' || substr(d, 1, 8) AS BIGINT) % (n + 1) AS x, CAST('0x' || substr(d, 9, 8) AS BIGINT) % (n + 1) AS y,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(d, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || substr(d, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT *, substr(t, 1, least(x, y)) AS p, substr(t, least(x, y) + 1, greatest(x, y) - least(x, y)) AS m, substr(t, greatest(x, y) + 1, n) AS s FROM cuts
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""
