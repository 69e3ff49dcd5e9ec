"""Joins of places and spans under a key: binned, so that a key with many of both makes no pair that is not near.

A span is put into the bins of the one width, a power of two, that is at least its own length, so it lies in two bins at
most; a place looks into one bin for each width that occurs. The join is by equality of key, width and bin, so it is dealt
out evenly over the bins of a hot key, and what it makes is bounded by spans that are about as near as they are long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscale.session import table

#: Widths are powers of two up to this exponent.
MOST_LEVEL = 62


def level_of(start: Column, end: Column) -> Column:
    """The exponent of the least power of two that is at least a span's length."""
    length = F.greatest((end - start).cast("long"), F.lit(1).cast("long"))
    return F.length(F.bin(length - 1)) * (length > 1).cast("int")


def _bin_of(place: Column) -> Column:
    return F.call_function("shiftright", place.cast("long"), F.col("_level"))


def _bins(spans: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """spans with _level and _bin, a row for each bin that a span [start, end) reaches into: two at most."""
    own = spans.withColumn("_level", level_of(F.col(start), F.col(end)))
    low, high = (_bin_of(c) for c in (F.col(start), F.col(end) - 1))
    return own.withColumn("_bin", F.explode(F.sequence(low, F.greatest(low, high))))


def point_join(points: DataFrame, spans: DataFrame, key: str, point: str = "point") -> DataFrame:
    """Every point with the spans (start, end) of its key that hold it: columns of both; a point in none has no row.

    points: key, point and any others; spans: key, start, end and any others, [start, end) with start < end.
    """
    binned = _bins(spans.where("start < end"))
    # The widths that occur under each key, at most MOST_LEVEL of them.
    levels = binned.groupBy(key).agg(F.collect_set("_level").alias("_levels"))
    asked = points.join(levels, key).withColumn("_level", F.explode("_levels")).drop("_levels")
    asked = asked.withColumn("_bin", _bin_of(F.col(point)))
    met = asked.join(binned, [key, "_level", "_bin"])
    return met.where((F.col("start") <= F.col(point)) & (F.col(point) < F.col("end"))).drop("_level", "_bin")


def first_holder(points: DataFrame, spans: DataFrame, key: str, point: str = "point") -> DataFrame:
    """key, point and start of the first span that holds it, null where none does; one row for each distinct point."""
    asked = points.select(key, point).distinct()
    found = point_join(asked, spans.select(key, "start", "end"), key, point).groupBy(key, point).agg(F.min("start").alias("start"))
    return asked.join(found, [key, point], "left")


def contained(inner: DataFrame, outer: DataFrame, key: str) -> DataFrame:
    """key, start and end of the distinct inner spans that lie in some outer span of their key.

    A running maximum, in the order of starts, of how far outer spans reach: an inner span lies in one that starts at or
    before it if and only if the reach is at least its end. Keys are parted into ranges of starts, each of which takes the
    reach of those before it along, so a hot key is many tasks' work.
    """
    own = inner.select(key, "start", "end", F.lit(1).alias("side")).distinct().unionByName(outer.select(key, "start", "end", F.lit(0).alias("side")).distinct())
    return _with_reach(own, key).where("side = 1 and end <= reach").select(key, "start", "end")


def _with_reach(rows: DataFrame, key: str) -> DataFrame:
    """rows (key, start, end, side) with reach: the greatest end of rows of side 0 under the key that start no later."""
    from folioscale.session import kept

    order = [key, "start", "side", "end"]
    dealt = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("part", F.spark_partition_id())
    dealt = kept(dealt, "ranges")
    reach = F.max(F.when(F.col("side") == 0, F.col("end")))
    tops = dealt.groupBy("part", key).agg(reach.alias("top"))  # a row for each range and key in it
    carried = tops.select("part", key, F.max("top").over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    own = reach.over(Window.partitionBy("part", key).orderBy("start", "side", "end").rowsBetween(Window.unboundedPreceding, 0))
    met = dealt.withColumn("own", own).join(carried, ["part", key])
    return met.withColumn("reach", F.greatest("own", "carried"))


def overlapping(spans: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Pairs of spans under a key that share a place: columns of spans, and other_start and other_end.

    Two spans share a place if one holds the start of the other: found from both sides as places, never as all pairs.
    """
    o = others.select(key, F.col("start").alias("other_start"), F.col("end").alias("other_end"))
    a = point_join(o.withColumnRenamed("other_start", "point"), spans, key).withColumnRenamed("point", "other_start")
    b = point_join(spans.withColumnsRenamed({"start": "point", "end": "_end"}), o.withColumnsRenamed({"other_start": "start", "other_end": "end"}), key)
    b = b.withColumnsRenamed({"start": "other_start", "end": "other_end", "point": "start", "_end": "end"}).where("other_start < start")
    columns = [*spans.columns, "other_start", "other_end"]
    return a.select(*columns).unionByName(b.select(*columns))


def q_segment_holders(spark: SparkSession, sf: str) -> DataFrame:
    """For each event the first stretch of its user's activity, in seconds of the month, that holds it; one user is hot."""
    events = table(spark, sf, "events").select(F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id")).alias("user"), F.unix_timestamp("ts").alias("point"), F.col("event_type"), F.floor("value").cast("long").alias("value"))
    spans = events.where("event_type = 'purchase'").select("user", F.col("point").alias("start"), (F.col("point") + 60 + F.col("value") * 40).alias("end"))
    return first_holder(events, spans, "user").select(F.col("user").alias("user_id"), "point", "start")


def q_contained_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Signup stretches that lie within a purchase stretch of the same user."""
    events = table(spark, sf, "events").select(F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id")).alias("user_id"), F.unix_timestamp("ts").alias("start"), F.col("event_type"), F.floor("value").cast("long").alias("value"))
    inner = events.where("event_type = 'signup'").select("user_id", "start", (F.col("start") + 30 + F.col("value")).alias("end"))
    outer = events.where("event_type = 'purchase'").select("user_id", "start", (F.col("start") + 60 + F.col("value") * 400).alias("end"))
    return contained(inner, outer, "user_id")


_U = "CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, event_type, CAST(floor(value) AS BIGINT) AS v"
QUERIES = {"segment_holders": q_segment_holders, "contained_spans": q_contained_spans}
ORACLES = {
    "segment_holders": f"WITH e AS (SELECT {_U} FROM events), p AS (SELECT user_id, s AS start, s + 60 + v * 40 AS stop FROM e WHERE event_type = 'purchase'), d AS (SELECT DISTINCT user_id, s AS point FROM e) SELECT d.user_id, point, min(start) AS start FROM d LEFT JOIN p ON p.user_id = d.user_id AND start <= point AND point < stop GROUP BY 1, 2",
    "contained_spans": f'WITH e AS (SELECT {_U} FROM events), p AS (SELECT user_id, s AS start, s + 60 + v * 400 AS stop FROM e WHERE event_type = \'purchase\') SELECT DISTINCT e.user_id, s AS start, s + 30 + v AS "end" FROM e WHERE event_type = \'signup\' AND EXISTS (SELECT 1 FROM p WHERE p.user_id = e.user_id AND start <= s AND s + 30 + v <= stop)',
}
