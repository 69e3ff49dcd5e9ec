"""Reviews and queues: classification precedence, reading queues, image results, topic graphs, setup of retrieval scope."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscale.session import table


def valid_reviews(reviews: DataFrame, sources: DataFrame, keys: Sequence[str], bound: Sequence[str]) -> DataFrame:
    """reviews with valid: every bound column (digests, version, scope) still equals the source's."""
    own = sources.select(*keys, *[F.col(c).alias(f"_{c}") for c in bound])
    met = reviews.join(own, list(keys), "left")
    same = F.lit(True)
    for c in bound:
        same = same & F.coalesce(F.col(c) == F.col(f"_{c}"), F.lit(False))
    return met.withColumn("valid", same).drop(*[f"_{c}" for c in bound])


def classification(incoming: Column, reviewed: Column, undecided: Column, adopted: Column, person_kind: Column, legacy: Column) -> Column:
    """How a source's class is settled, the strongest way first."""
    return F.when(incoming, "incoming_review").when(undecided, "needs_user").when(reviewed, "reviewed").when(adopted, "person_decision").when(person_kind, "person_kind").when(legacy, "legacy").otherwise("pending")


def latest_results(results: DataFrame, revoked: DataFrame, key: Sequence[str], order: str, result_id: str) -> DataFrame:
    """The latest result of each key; revoked ones are gone and bring nothing back that they had superseded."""
    last = results.groupBy(*key).agg(F.max(F.struct(order, result_id)).alias("_l")).select(*key, F.col(f"_l.{order}").alias(order), F.col(f"_l.{result_id}").alias(result_id))
    return last.join(revoked.select(result_id).distinct(), result_id, "left_anti")


def reading_queue(requests: DataFrame, ledger: DataFrame, revisions: DataFrame) -> DataFrame:
    """request_id and state (pending, awaiting_update or unavailable) of what still has to be read.

    requests: request_id, relative, sha, version, page, mtime. ledger: request_id, sha, status, revoked. revisions:
    relative, sha, version, readable. The latest request of each page counts; an accepted, unrevoked decision for the
    same content awaits the next update; a readable revision needs nothing; a source that changed asks anew.
    """
    newest = requests.groupBy("relative", "sha", "version", "page").agg(F.max_by("request_id", "mtime").alias("request_id"))
    decided = ledger.where("status = 'accepted' and not revoked").select("request_id", F.col("sha").alias("_sha")).distinct()
    now = revisions.groupBy("relative").agg(F.max_by(F.struct("sha", "version", "readable"), "sha").alias("r"))
    met = newest.join(now, "relative", "left").join(decided, "request_id", "left")
    current = (F.col("r.sha") == F.col("sha")) & (F.col("r.version") == F.col("version"))
    state = F.when(F.col("r").isNull(), "unavailable").when(~current, None).when(F.col("r.readable"), None).when(F.col("_sha") == F.col("sha"), "awaiting_update").otherwise("pending")
    return met.select("request_id", state.alias("state")).where("state is not null")


def graph_violations(nodes: DataFrame, sources: DataFrame, active: DataFrame, related: DataFrame) -> DataFrame:
    """problem and node of a topic graph: repeated titles, unknown sources, unknown or own relations."""
    twice = nodes.groupBy("node").count().where("count > 1").select(F.lit("repeated_title").alias("problem"), "node")
    unknown = sources.join(active, "source", "left_anti").select(F.lit("unknown_source").alias("problem"), "node")
    loose = related.join(nodes.select(F.col("node").alias("other")).distinct(), "other", "left_anti").select(F.lit("unknown_relation").alias("problem"), "node")
    own = related.where("node = other").select(F.lit("relation_to_itself").alias("problem"), "node")
    return twice.unionByName(unknown).unionByName(loose).unionByName(own)


def cell_completeness(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """table_id, missing and repeated: how many places of each declared table no cell or several cells fill."""
    grid = tables.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows")))).withColumn("column", F.explode(F.sequence(F.lit(1), F.col("columns"))))
    filled = cells.groupBy("table_id", "row", "column").agg(F.count("*").alias("n"))
    met = grid.join(filled, ["table_id", "row", "column"], "left")
    return met.groupBy("table_id").agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("n") > 1).alias("repeated"))


def same_multiset(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one table holds more often than the other, with how much more: empty if both are equal."""
    counted = a.withColumn("_d", F.lit(1)).unionByName(b.withColumn("_d", F.lit(-1)))
    return counted.groupBy(*a.columns).agg(F.sum("_d").alias("surplus")).where("surplus <> 0")


def unresolved_spans(spans: DataFrame, atoms: DataFrame) -> DataFrame:
    """atom_id and the number of unresolved spans (same product and version) that share a property or a topic with it.

    Both sides are reduced to the different sets of properties and topics that occur, which are few whatever the number of
    spans; sets meet sets, and counts come back to the atoms.
    """
    sets = ["product", "version", "properties", "topics"]
    sorted_ = lambda rows: rows.withColumns({c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>")))) for c in sets[2:]})
    counted = sorted_(spans).groupBy(*sets).agg(F.count("*").alias("n")).withColumnsRenamed({"properties": "_p", "topics": "_t"})
    asked = sorted_(atoms.select("atom_id", *sets))
    met = asked.select(*sets).distinct().join(counted, ["product", "version"])
    found = met.where(F.arrays_overlap("_p", "properties") | F.arrays_overlap("_t", "topics")).groupBy(*sets).agg(F.sum("n").alias("spans"))
    return asked.join(found, sets).select("atom_id", "spans")


def topic_pages(docs: DataFrame, key: str, labels: str) -> DataFrame:
    """label and how many documents carry it, with the first of them: labels are exploded, nothing is gathered."""
    return docs.select(F.explode(F.array_distinct(labels)).alias("label"), key).groupBy("label").agg(F.count("*").alias("documents"), F.min(key).alias("first"))


def q_review_validity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha"), (F.col("doc_id") % 3).alias("version"))
    reviews = docs.select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.lit("old")).otherwise(F.col("text_sha")).alias("text_sha"), F.when(F.col("doc_id") % 7 == 0, -1).otherwise(F.col("version")).alias("version"))
    return valid_reviews(reviews, docs, ["doc_id"], ["text_sha", "version"]).groupBy("valid").agg(F.count("*").alias("n"))


def q_classification_precedence(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    way = classification(F.col("doc_id") % 10 == 0, F.col("quality").isNotNull() & (F.col("quality") == 1), F.col("quality") == 0, F.col("doc_id") % 3 == 0, F.col("lang") == "fr", F.col("lang") == "de")
    return rows.groupBy(way.alias("settled_by")).agg(F.count("*").alias("n"))


def q_latest_results(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    results = events.where("event_type <> 'error'").select("user_id", "event_type", F.col("event_id").alias("at"), F.col("event_id").alias("result_id"))
    revoked = events.where("event_id % 9 = 0").select(F.col("event_id").alias("result_id"))
    return latest_results(results, revoked, ["user_id", "event_type"], "at", "result_id").select("user_id", "event_type", "result_id")


def q_reading_queue(spark: SparkSession, sf: str) -> DataFrame:
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    version = F.col("o_orderkey") % 2
    revisions = orders.where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("relative"), F.col("o_orderstatus").alias("sha"), version.alias("version"), (F.col("o_orderkey") % 4 == 0).alias("readable"))
    requests = lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("request_id"), F.col("l_orderkey").alias("relative"), F.when(F.col("l_linenumber") == 2, "P").otherwise("F").alias("sha"), (F.col("l_orderkey") % 2).alias("version"), F.col("l_linenumber").alias("page"), F.concat_ws("-", F.col("l_shipdate").cast("string"), "l_partkey", "l_suppkey").alias("mtime"))
    ledger = requests.where("page % 3 = 0").select("request_id", "sha", F.lit("accepted").alias("status"), (F.col("relative") % 5 == 0).alias("revoked"))
    return reading_queue(requests, ledger, revisions).groupBy("state").agg(F.count("*").alias("n"))


def q_graph_violations(spark: SparkSession, sf: str) -> DataFrame:
    part, supplier = table(spark, sf, "part"), table(spark, sf, "supplier")
    nodes = part.select(F.concat_ws(" ", "p_brand", "p_type", "p_size").alias("node"))
    lines = table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    sources = lines.select(F.concat_ws(" ", "p_brand", "p_type", "p_size").alias("node"), F.col("l_suppkey").alias("source"))
    related = lines.select(F.concat_ws(" ", "p_brand", "p_type", "p_size").alias("node"), F.concat_ws(" ", "p_brand", "p_type", F.when(F.col("l_linenumber") % 2 == 0, F.col("p_size")).otherwise(F.col("p_size") + 1)).alias("other"))
    return graph_violations(nodes, sources, supplier.where("s_suppkey % 6 <> 0").select(F.col("s_suppkey").alias("source")), related).groupBy("problem").agg(F.count("*").alias("n"))


def q_cell_completeness(spark: SparkSession, sf: str) -> DataFrame:
    tables_ = table(spark, sf, "orders").select(F.col("o_orderkey").alias("table_id"), F.lit(3).alias("rows"), F.lit(2).alias("columns"))
    cells = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("table_id"), (F.col("l_linenumber") % 3 + 1).alias("row"), (F.col("l_suppkey") % 2 + 1).alias("column"))
    return cell_completeness(cells, tables_)


def q_multiset_difference(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return same_multiset(o.where("o_orderkey % 2 = 0").select("o_orderstatus", "o_orderpriority"), o.where("o_orderkey % 2 = 1").select("o_orderstatus", "o_orderpriority"))


def q_unresolved_spans(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    atoms = o.select(F.col("o_orderkey").alias("atom_id"), (F.col("o_custkey") % 100).alias("product"), F.year("o_orderdate").alias("version"), F.array("o_orderstatus").alias("properties"), F.array("o_orderpriority").alias("topics"))
    spans = o.select((F.col("o_custkey") % 100).alias("product"), F.year("o_orderdate").alias("version"), F.array("o_orderstatus").alias("properties"), F.array("o_orderpriority").alias("topics"))
    return unresolved_spans(spans, atoms)


def q_topic_pages(spark: SparkSession, sf: str) -> DataFrame:
    return topic_pages(table(spark, sf, "part").withColumn("labels", F.array("p_brand", "p_type", "p_brand")), "p_partkey", "labels")


def q_direct_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Users by their events, the best rank of each type kept: rank, and the share of the type's total before it."""
    sums = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    order = Window.partitionBy("event_type").orderBy(F.desc("n"), "user_id")
    return sums.withColumn("rank", F.row_number().over(order)).withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("rank <= 12")


QUERIES = {
    "review_validity": q_review_validity,
    "classification_precedence": q_classification_precedence,
    "latest_results": q_latest_results,
    "reading_queue": q_reading_queue,
    "graph_violations": q_graph_violations,
    "cell_completeness": q_cell_completeness,
    "multiset_difference": q_multiset_difference,
    "unresolved_spans": q_unresolved_spans,
    "topic_pages": q_topic_pages,
    "direct_rank": q_direct_rank,
}
_NODE = "p_brand || ' ' || p_type || ' ' || CAST(p_size AS VARCHAR)"
ORACLES = {
    "review_validity": "SELECT doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS valid, count(*) AS n FROM documents GROUP BY 1",
    "classification_precedence": "SELECT CASE WHEN doc_id % 10 = 0 THEN 'incoming_review' WHEN quality = 0 THEN 'needs_user' WHEN quality = 1 THEN 'reviewed' WHEN doc_id % 3 = 0 THEN 'person_decision' WHEN lang = 'fr' THEN 'person_kind' WHEN lang = 'de' THEN 'legacy' ELSE 'pending' END AS settled_by, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "latest_results": "SELECT user_id, event_type, result_id FROM (SELECT user_id, event_type, max(event_id) AS result_id FROM events WHERE event_type <> 'error' GROUP BY 1, 2) WHERE result_id % 9 <> 0",
    "reading_queue": "WITH q AS (SELECT l_orderkey AS relative, CASE WHEN l_linenumber = 2 THEN 'P' ELSE 'F' END AS sha, l_linenumber AS page FROM lineitem GROUP BY 1, 2, 3), m AS (SELECT q.*, o_orderstatus, o_orderkey FROM q LEFT JOIN orders ON o_orderkey = relative AND o_orderkey % 11 <> 0), s AS (SELECT CASE WHEN o_orderkey IS NULL THEN 'unavailable' WHEN o_orderstatus <> sha THEN NULL WHEN o_orderkey % 4 = 0 THEN NULL WHEN page % 3 = 0 AND relative % 5 <> 0 THEN 'awaiting_update' ELSE 'pending' END AS state FROM m) SELECT state, count(*) AS n FROM s WHERE state IS NOT NULL GROUP BY 1",
    "graph_violations": f"WITH n AS (SELECT {_NODE} AS node FROM part), l AS (SELECT *, {_NODE} AS node, p_brand || ' ' || p_type || ' ' || CAST(CASE WHEN l_linenumber % 2 = 0 THEN p_size ELSE p_size + 1 END AS VARCHAR) AS other FROM lineitem JOIN part ON l_partkey = p_partkey), v AS (SELECT 'repeated_title' AS problem FROM n GROUP BY node HAVING count(*) > 1 UNION ALL SELECT 'unknown_source' FROM l WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 6 <> 0) UNION ALL SELECT 'unknown_relation' FROM l WHERE other NOT IN (SELECT node FROM n) UNION ALL SELECT 'relation_to_itself' FROM l WHERE node = other) SELECT problem, count(*) AS n FROM v GROUP BY 1",
    "cell_completeness": "WITH g AS (SELECT o_orderkey AS table_id, r, c FROM orders, (SELECT unnest([1, 2, 3]) AS r), (SELECT unnest([1, 2]) AS c)), f AS (SELECT l_orderkey AS table_id, l_linenumber % 3 + 1 AS r, l_suppkey % 2 + 1 AS c, count(*) AS n FROM lineitem GROUP BY 1, 2, 3) SELECT g.table_id, count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (n > 1) AS repeated FROM g LEFT JOIN f ON g.table_id = f.table_id AND g.r = f.r AND g.c = f.c GROUP BY 1",
    "multiset_difference": "SELECT o_orderstatus, o_orderpriority, CAST(sum(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS surplus FROM orders GROUP BY 1, 2 HAVING sum(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END) <> 0",
    "unresolved_spans": "WITH o AS (SELECT *, o_custkey % 100 AS product, year(o_orderdate) AS version FROM orders) SELECT a.o_orderkey AS atom_id, count(*) AS spans FROM o a JOIN o s ON a.product = s.product AND a.version = s.version AND (a.o_orderstatus = s.o_orderstatus OR a.o_orderpriority = s.o_orderpriority) GROUP BY 1",
    "topic_pages": "SELECT label, count(*) AS documents, min(p_partkey) AS first FROM (SELECT p_partkey, p_brand AS label FROM part UNION SELECT p_partkey, p_type FROM part) GROUP BY 1",
    "direct_rank": "WITH s AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w AS rank, CAST(coalesce(sum(n) OVER (PARTITION BY event_type ORDER BY n DESC, user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM s WINDOW w AS (PARTITION BY event_type ORDER BY n DESC, user_id)) SELECT event_type, user_id, n, CAST(rank AS INTEGER) AS rank, before FROM r WHERE rank <= 12",
}
