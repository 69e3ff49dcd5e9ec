"""Budgets and caps: greedy inclusion, page budgets, caps per kind, promotion along a topic graph, keyset pages."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscale.session import kept, table

#: How much of a node's score its sources get, by their rank.
DECAY = [0.96, 0.62, 0.48, 0.38, 0.32, 0.28]
PAGE_FLOOR = 1024


def greedy_fit(sizes: Column, budget: int) -> Column:
    """Places (from 1) of the sizes that are taken in order, each that still fits; one that doesn't is passed over."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("kept"))

    def step(state: Column, size: Column) -> Column:
        fits = state["used"] + size <= budget
        return F.struct((state["used"] + F.when(fits, size).otherwise(0)).cast("long").alias("used"), (state["at"] + 1).alias("at"), F.when(fits, F.array_append(state["kept"], state["at"] + 1)).otherwise(state["kept"]).alias("kept"))

    return F.aggregate(F.transform(sizes, lambda x: x.cast("long")), start, step)["kept"]


def budgeted(rows: DataFrame, order: Sequence[str], size: str, total: int, most: int) -> DataFrame:
    """rows with verdict: taken, count (so many are taken already) or total (it would not fit any more, and is passed over).

    Rows are taken in order, each that still fits, whatever was passed over before: what is taken depends on all that came
    before it. Ranges of the order are summed up at once, over the sizes that could still fit. Ranges that fit as a whole
    are taken without a look at their rows; only one that does not is walked row by row, in a task of its own, and the
    rest is summed up again for the room that it leaves. Null sizes count nothing. Equal rows of the order come in any order.
    """
    spark, partitions = rows.sparkSession, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in order]
    dealt = rows.withColumn("_size", F.coalesce(F.col(size), F.lit(0)).cast("long")).repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id()
    dealt = kept(dealt.withColumn("_part", F.shiftright(place, 33)).withColumn("_place", place), "ranges")
    room, left, at = total, most, -1
    ended = None if most > 0 else -1  # the range with the last row that was taken by its number
    limits: list[tuple[int, int]] = []  # of ranges that were taken whole: the greatest size that could fit
    walked: list[DataFrame] = []
    while ended is None:
        # One row for each range that is left.
        sums = dealt.where((F.col("_part") > at) & (F.col("_size") <= room)).groupBy("_part").agg(F.sum("_size").alias("s"), F.count("*").alias("n")).orderBy("_part").collect()
        start = room
        stop = None
        for own in sums:
            if own.s > room or own.n >= left:
                stop = own["_part"]
                break
            room, left = room - own.s, left - own.n
            limits.append((own["_part"], start))
        if stop is None:
            break
        found = kept(_walk(dealt.where(F.col("_part") == stop), room, left), "walked")
        walked.append(found)
        last = found.agg(F.max_by(F.struct("room", "left"), "_place").alias("e")).first().e
        room, left, at = last.room, last.left, stop
        ended = None if left else at
    whole = spark.createDataFrame(limits, "_part long, _limit long")
    rest = dealt
    for found in walked:
        rest = rest.join(found.select("_place"), "_place", "left_anti")
    met = rest.join(F.broadcast(whole), "_part", "left")  # a row for each range
    own = F.when(F.col("_part") > (1 << 62 if ended is None else ended), "count").when(F.col("_size") <= F.coalesce("_limit", F.lit(-1)), "taken").otherwise("total")
    out = met.withColumn("verdict", own).select(*rows.columns, "verdict")
    for found in walked:
        out = out.unionByName(dealt.join(found.select("_place", "verdict"), "_place").select(*rows.columns, "verdict"))
    return out


def _walk(part: DataFrame, room: int, left: int) -> DataFrame:
    """_place, verdict, and the room and number left behind each row of one range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches([*batches], schema=pa.schema([("_place", pa.int64()), ("_size", pa.int64())])).sort_by("_place")
        free, more, out = room, left, []
        for size in held["_size"].to_pylist():
            verdict = "count" if more == 0 else "taken" if size <= free else "total"
            if verdict == "taken":
                free, more = free - size, more - 1
            out.append((verdict, free, more))
        yield pa.RecordBatch.from_arrays([held["_place"].combine_chunks(), pa.array([o[0] for o in out], pa.string()), *[pa.array([o[i] for o in out], pa.int64()) for i in (1, 2)]], names=["_place", "verdict", "room", "left"])

    return part.select("_place", "_size").coalesce(1).mapInArrow(run, "_place long, verdict string, room long, left long")


def page_budgets(rows: DataFrame, group: Sequence[str], order: Sequence[Column], budget: int, floor: int = PAGE_FLOOR) -> DataFrame:
    """rows with bytes: a floor for each, and the rest of the budget by weights that halve from 8, leftovers one by one.

    A group whose floors alone exceed the budget has null bytes in all of its rows; other groups don't depend on it.
    """
    by = Window.partitionBy(*group)
    placed = rows.withColumn("_rank", F.row_number().over(by.orderBy(*order))).withColumn("_n", F.count("*").over(by))
    weight = F.floor(F.greatest(F.lit(8) / F.pow(F.lit(2.0), F.col("_rank") - 1), F.lit(1.0)))
    weighed = placed.withColumn("_w", weight).withColumn("_sum", F.sum("_w").over(by))
    rest = F.lit(budget) - F.lit(floor) * F.col("_n")
    share = F.when(rest >= 0, F.floor(rest * F.col("_w") / F.col("_sum")) + floor)
    shared = weighed.withColumn("_share", share.cast("long")).withColumn("_left", F.lit(budget) - F.sum("_share").over(by))
    return shared.withColumn("bytes", F.col("_share") + (F.col("_rank") <= F.col("_left")).cast("long")).drop("_rank", "_n", "_w", "_sum", "_share", "_left")


def caps(rows: DataFrame, kind: str, order: Sequence[Column], most: dict[str, int], other: int) -> DataFrame:
    """The first rows of each kind, as many as its cap; rank in kind. The largest cap is a literal, so Spark limits before it shuffles."""
    cap = F.coalesce(*[F.when(F.col(kind) == k, n) for k, n in most.items()], F.lit(other))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).where((F.col("rank") <= max(other, *most.values())) & (F.col("rank") <= cap))


def promote(nodes: DataFrame, direct: DataFrame) -> DataFrame:
    """doc and score: a node's sources get its score by rank, and keep their own if that is higher.

    nodes: node, score, sources (array). direct: doc, score.
    """
    spread = nodes.select(F.posexplode("sources").alias("at", "doc"), "score")
    weight = F.element_at(F.array(*map(F.lit, DECAY)), F.least(F.col("at") + 1, F.lit(len(DECAY))))
    return spread.select("doc", (F.col("score") * weight).alias("score")).unionByName(direct.select("doc", "score")).groupBy("doc").agg(F.max("score").alias("score"))


def keyset_page(rows: DataFrame, keys: Sequence[str], after: Sequence | None, size: int) -> DataFrame:
    """The page of rows that follows the given key values: nothing before it is sorted again."""
    if after is not None:
        condition = F.lit(False)
        for i, key in enumerate(keys):
            part = F.col(key) > F.lit(after[i])
            for earlier, value in zip(keys[:i], after[:i], strict=True):
                part = part & (F.col(earlier) == F.lit(value))
            condition = condition | part
        rows = rows.where(condition)
    return rows.orderBy(*keys).limit(size)


def q_greedy_byte_budget(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("size")))).alias("t"))
    kept = greedy_fit(F.transform("t", lambda x: x["size"]), 900)
    return turns.select("conv_id", F.array_join(F.transform(kept, lambda x: x.cast("string")), ",").alias("kept"))


def q_page_budget_alloc(spark: SparkSession, sf: str) -> DataFrame:
    return page_budgets(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")], 20_000).groupBy("l_orderkey").agg(F.count("*").alias("pages"), F.max("bytes").alias("most"), F.min("bytes").alias("least"), F.sum("bytes").alias("total"))


def q_generation_caps(spark: SparkSession, sf: str) -> DataFrame:
    rows = caps(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "lang", [F.desc("n_chars"), F.col("doc_id")], {"en": 5}, 3)
    return rows.select("lang", "rank", "doc_id")


def q_graph_promotion(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    nodes = events.groupBy("event_type").agg(F.round(F.sum("value"), 2).alias("score"))
    ranked = events.groupBy("event_type", "user_id").agg(F.max("event_id").alias("last"))
    top = ranked.withColumn("k", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("last")))).where("k <= 10")
    sources = top.groupBy("event_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "user_id"))), lambda x: x["user_id"]).alias("sources"))
    direct = events.groupBy(F.col("user_id").alias("doc")).agg(F.round(F.sum("value"), 2).alias("score"))
    return promote(nodes.join(sources, "event_type").select(F.col("event_type").alias("node"), "score", "sources"), direct).select("doc", F.round("score", 4).alias("score"))


def q_keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    return keyset_page(table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_custkey"), ["o_orderpriority", "o_orderkey"], ["2-HIGH", 500], 25)


def q_greedy_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in the order of their paths within a budget of bytes that shrinks as they are taken, and a number of them."""
    docs = table(spark, sf, "documents").select("doc_id", F.concat_ws("/", "source", F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), F.octet_length("text").alias("bytes"))
    whole = docs.agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).first()
    return budgeted(docs, ["path"], "bytes", whole.b // 3, whole.n * 2 // 3).select("doc_id", "verdict")


QUERIES = {
    "greedy_budget": q_greedy_budget,
    "greedy_byte_budget": q_greedy_byte_budget,
    "page_budget_alloc": q_page_budget_alloc,
    "generation_caps": q_generation_caps,
    "graph_promotion": q_graph_promotion,
    "keyset_page": q_keyset_page,
}
ORACLES = {
    "greedy_byte_budget": "WITH RECURSIVE t AS (SELECT conv_id, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations), r AS (SELECT conv_id, 0 AS k, 0::BIGINT AS used, '' AS kept FROM (SELECT DISTINCT conv_id FROM t) UNION ALL SELECT r.conv_id, r.k + 1, CASE WHEN used + size <= 900 THEN used + size ELSE used END, CASE WHEN used + size <= 900 THEN kept || ',' || CAST(t.k AS VARCHAR) ELSE kept END FROM r JOIN t ON t.conv_id = r.conv_id AND t.k = r.k + 1) SELECT conv_id, ltrim(arg_max(kept, k), ',') AS kept FROM r GROUP BY conv_id",
    "page_budget_alloc": "WITH p AS (SELECT l_orderkey, row_number() OVER w AS rank, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)), q AS (SELECT *, floor(greatest(8 / pow(2, rank - 1), 1)) AS w FROM p), s AS (SELECT *, CAST(CASE WHEN 20000 - 1024 * n >= 0 THEN floor((20000 - 1024 * n) * w / sum(w) OVER (PARTITION BY l_orderkey)) + 1024 END AS BIGINT) AS share FROM q), b AS (SELECT l_orderkey, share + CASE WHEN rank <= 20000 - sum(share) OVER (PARTITION BY l_orderkey) THEN 1 ELSE 0 END AS bytes FROM s) SELECT l_orderkey, count(*) AS pages, max(bytes) AS most, min(bytes) AS least, CAST(sum(bytes) AS BIGINT) AS total FROM b GROUP BY 1",
    "generation_caps": "SELECT lang, CAST(rank AS INTEGER) AS rank, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= CASE WHEN lang = 'en' THEN 5 ELSE 3 END",
    "graph_promotion": "WITH n AS (SELECT event_type, round(sum(value), 2) AS score FROM events GROUP BY 1), u AS (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY max(event_id) DESC) AS k FROM events GROUP BY 1, 2), p AS (SELECT user_id AS doc, score * [0.96, 0.62, 0.48, 0.38, 0.32, 0.28][least(k, 6)]::DOUBLE AS score FROM u JOIN n USING (event_type) WHERE k <= 10 UNION ALL SELECT user_id, round(sum(value), 2) FROM events GROUP BY 1) SELECT doc, round(max(score), 4) AS score FROM p GROUP BY doc",
    "keyset_page": "SELECT o_orderpriority, o_orderkey, o_custkey FROM orders WHERE o_orderpriority > '2-HIGH' OR (o_orderpriority = '2-HIGH' AND o_orderkey > 500) ORDER BY 1, 2 LIMIT 25",
}
