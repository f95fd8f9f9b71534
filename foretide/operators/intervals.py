"""Which versions were known at an instant, for rows that each have their own.

A version holds from the instant at which it was retrieved until the next one of its key is. The instants of versions and of rows that
ask go over each key in one order of time, and a row takes the last instant of a version that it has passed. Only instants and the
rows that ask are sorted; versions meet them afterwards, by key and instant, in a join by equality that emits no pair that
doesn't belong together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _micros(at: str) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp"))


def known_at(probes: DataFrame, versions: DataFrame, key: list[str], as_of: str = "as_of", retrieved_at: str = "retrieved_at", effective_at: str = "effective_at") -> DataFrame:
    """probes with the columns of the version of each of their keys that was known at their own instant (I08, M02): the last one
    retrieved by then, if what it says was in effect by then; a version of no effective instant always was. Probes without
    such a version go. Of versions retrieved at the same instant all are known. Columns of versions must differ from those of probes
    but for the key; instants lie between 1970 and 2262, other rows, and those without an instant or a part of the key, meet nothing.
    """
    held = versions.filter(_micros(retrieved_at) >= 0).dropna(subset=key).withColumn("from_us", _micros(retrieved_at))
    asked = probes.filter(_micros(as_of) >= 0).dropna(subset=key)
    own = [c for c in probes.columns if c not in key]
    asking = asked.select(*key, _micros(as_of).alias("at_us"), F.lit(True).alias("asks"), F.lit(None).cast("long").alias("from_us"), F.struct(*own).alias("own"))
    known = held.select(*key, F.col("from_us").alias("at_us"), F.lit(False).alias("asks"), "from_us", F.lit(None).cast(asking.schema["own"].dataType).alias("own"))
    by_time = Window.partitionBy(*key).orderBy("at_us", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = known.unionByName(asking).withColumn("from_us", F.max("from_us").over(by_time)).filter("asks AND from_us IS NOT NULL")
    out = met.select(*key, "own.*", "from_us").join(held, [*key, "from_us"]).drop("from_us")
    return out.filter(F.coalesce(F.col(effective_at) <= F.col(as_of), F.lit(True)))
