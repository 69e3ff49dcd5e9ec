"""Reading sources: pages of text, exact quotes, page overlap, coverage of spans, running offsets, look-ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscale.functions.text import fixed_windows
from folioscale.session import kept, table

PAGE = 6000


def source_page(docs: DataFrame, offset: Column | int, size: int = PAGE) -> DataFrame:
    """docs with page (text from offset on), complete and next_offset (null on the last page)."""
    at = offset if isinstance(offset, Column) else F.lit(offset)
    body, end = F.coalesce(F.col("text"), F.lit("")), at + size
    complete = end >= F.length(body)
    return docs.withColumns({"page": body.substr(at + 1, F.lit(size)), "complete": complete, "next_offset": F.when(~complete, end)})


def verify_quotes(citations: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """citations (key, start, quote) with verdict: exact, differs or unknown_source."""
    own = texts.select(F.col(key), F.col("text").alias("_text"))
    met = citations.join(own, key, "left")
    same = F.col("_text").substr(F.col("start") + 1, F.length("quote")) == F.col("quote")
    return met.withColumn("verdict", F.when(F.col("_text").isNull(), "unknown_source").when(same, "exact").otherwise("differs")).drop("_text")


def containment(quotes: DataFrame, texts: DataFrame, key: str, quote: str, words: int = 5) -> DataFrame:
    """Which whole texts hold which quotes (key of text, item): a join on the hash of the quotes' first words, then verified.

    Shorter quotes than words join on all the words they have. A quote without any word is found nowhere.
    """
    runs = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    own = kept(quotes.withColumn("_n", F.least(F.size(runs(F.col(quote))), F.lit(words))).where("_n > 0").withColumn("_head", F.xxhash64("_n", F.slice(runs(F.col(quote)), 1, F.col("_n")))), "quotes")
    sizes = [r[0] for r in own.select("_n").distinct().collect()]  # words at most
    rows = texts.withColumn("_t", runs(F.col("text")))

    def runs_of(n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size("_t") - n + 1, F.lit(1)))
        return F.when(F.size("_t") >= n, F.transform(places, lambda i: F.xxhash64(F.lit(n), F.slice(F.col("_t"), i, n)))).otherwise(F.array().cast("array<bigint>"))

    heads = [runs_of(n) for n in sizes]
    if not heads:
        return texts.join(own.drop("_n", "_head"), F.lit(False)).limit(0)
    met = rows.withColumn("_head", F.explode(F.array_distinct(F.concat(*heads)))).drop("_t").join(own.drop("_n"), "_head")
    return met.where(F.contains(F.col("text"), F.col(quote))).drop("_head")


def overlaps(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Pairs of spans a (start, end) and b (lo, hi) of the same key that overlap."""
    return a.join(b, key).where((F.col("hi") > F.col("start")) & (F.col("lo") < F.col("end")))


def coverage(spans: DataFrame, key: str) -> DataFrame:
    """Merged spans of each key: start, end and the number of spans in them (gaps and islands)."""
    order = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    islands = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("spans")).drop("_island")


def running_offsets(rows: DataFrame, key: str, order: str, text: str, gap: int = 2) -> DataFrame:
    """rows with text_start and text_end in the joined text of each key, parts being gap characters apart."""
    window = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + gap).over(window), F.lit(0))
    return rows.withColumn("text_start", start).withColumn("text_end", F.col("text_start") + F.length(text))


def lookahead(rows: DataFrame, key: str, order: str, value: Column, reach: int = 3) -> DataFrame:
    """rows with ahead: the values of the next rows of the same key, reach at most."""
    return rows.withColumn("ahead", F.collect_list(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(1, reach)))


def q_read_source_page(spark: SparkSession, sf: str) -> DataFrame:
    return source_page(table(spark, sf, "documents"), (F.col("doc_id") % 3) * 700, 1000).select("doc_id", F.sha2("page", 256).alias("page_sha"), "complete", F.coalesce("next_offset", F.lit(-1)).alias("next_offset"))


def q_verify_quotes(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    quote = F.when(F.col("doc_id") % 2 == 0, F.substring("text", 11, 30)).otherwise(F.concat(F.substring("text", 11, 29), F.lit("~")))
    cited = docs.select(F.when(F.col("doc_id") % 13 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("doc_id"), F.lit(10).alias("start"), quote.alias("quote"))
    return verify_quotes(cited, docs, "doc_id").groupBy("verdict").agg(F.count("*").alias("n"))


def q_quote_containment(spark: SparkSession, sf: str) -> DataFrame:
    return containment(table(spark, sf, "benchmark").select("item_id", F.col("text").alias("quote")), table(spark, sf, "documents"), "doc_id", "quote").select("doc_id", "item_id")


def q_page_overlap(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    windows = fixed_windows(docs).select("doc_id", "start", (F.col("start") + F.length("window")).alias("end"))
    pages = fixed_windows(docs, size=1000, stride=1000).select("doc_id", F.col("start").alias("lo"), (F.col("start") + F.length("window")).alias("hi"))
    return overlaps(windows, pages, "doc_id").groupBy("doc_id", "start").agg(F.count("*").alias("pages"), F.min("lo").alias("first_page"))


def q_interval_coverage(spark: SparkSession, sf: str) -> DataFrame:
    windows = fixed_windows(table(spark, sf, "documents")).where("(start / 1560) % 3 <> 2").select("doc_id", "start", (F.col("start") + F.length("window")).alias("end"))
    return coverage(windows, "doc_id")


def q_running_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return running_offsets(table(spark, sf, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "text_start", "text_end")


def q_lookahead_condition(spark: SparkSession, sf: str) -> DataFrame:
    return lookahead(table(spark, sf, "conversations"), "conv_id", "turn", F.length("text")).select("conv_id", "turn", F.array_join(F.transform("ahead", lambda x: x.cast("string")), ",").alias("ahead"))


_SPANS = "w AS (SELECT doc_id, s AS start, least(s + 1800, length(text)) AS \"end\" FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 1, 0) + 1, 1560)) AS s FROM documents))"
QUERIES = {
    "read_source_page": q_read_source_page,
    "verify_quotes": q_verify_quotes,
    "quote_containment": q_quote_containment,
    "page_overlap": q_page_overlap,
    "interval_coverage": q_interval_coverage,
    "running_offsets": q_running_offsets,
    "lookahead_condition": q_lookahead_condition,
}
ORACLES = {
    "read_source_page": "SELECT doc_id, sha256(substr(text, (doc_id % 3) * 700 + 1, 1000)) AS page_sha, (doc_id % 3) * 700 + 1000 >= length(text) AS complete, CASE WHEN (doc_id % 3) * 700 + 1000 < length(text) THEN (doc_id % 3) * 700 + 1000 ELSE -1 END AS next_offset FROM documents",
    "verify_quotes": "SELECT CASE WHEN doc_id % 13 = 0 THEN 'unknown_source' WHEN doc_id % 2 = 0 OR substr(text, 11, 30) = substr(text, 11, 29) || '~' THEN 'exact' ELSE 'differs' END AS verdict, count(*) AS n FROM documents GROUP BY 1",
    "quote_containment": "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "page_overlap": f"WITH {_SPANS}, p AS (SELECT doc_id, s AS lo, least(s + 1000, length(text)) AS hi FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 1, 0) + 1, 1000)) AS s FROM documents)) SELECT w.doc_id, CAST(start AS INTEGER) AS start, count(*) AS pages, CAST(min(lo) AS INTEGER) AS first_page FROM w JOIN p ON w.doc_id = p.doc_id AND hi > start AND lo < \"end\" GROUP BY 1, 2",
    "interval_coverage": f"WITH {_SPANS}, k AS (SELECT * FROM w WHERE (start // 1560) % 3 <> 2), m AS (SELECT *, max(\"end\") OVER (PARTITION BY doc_id ORDER BY start, \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM k), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, \"end\" ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT doc_id, CAST(min(start) AS INTEGER) AS start, CAST(max(\"end\") AS INTEGER) AS \"end\", count(*) AS spans FROM i GROUP BY doc_id, island",
    "running_offsets": "SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS text_start, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(text) AS BIGINT) AS text_end FROM conversations",
    "lookahead_condition": "SELECT conv_id, turn, coalesce(array_to_string(list(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), ','), '') AS ahead FROM conversations",
}
