"""Structured claims: facts, candidates, verdicts, conflicts and condition differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscale.session import table

#: Verdicts.
VERDICTS = ["supported", "contradicted", "missing_condition", "not_covered", "retrieval_incomplete", "needs_semantic_review", "needs_person_confirmation", "conflict"]
#: Patterns of the closed set of statements; percentages and months are read as numbers.
STATEMENTS = [
    ("insured_age_years", "year", "equals", r"投保年龄为\s*([0-9]+)\s*周岁"),
    ("loan_term_months", "month", "maximum", r"期限(?:最长)?(?:不超过|不得超过|最长不超过)\s*([0-9]+)\s*个月"),
    ("loan_term_months", "month", "equals", r"期限为\s*([0-9]+)\s*个月"),
    ("loan_limit_percent", "percent", "maximum", r"(?:不得超过|不超过|上限为)[^。；]*?([0-9]+(?:\.[0-9]+)?)\s*%"),
]

#: Hashes of the first characters of aliases.
HEADS = 1 << 16


def decimal_text(value: Column) -> Column:
    """A number's one spelling: no sign of plus, no zeros that say nothing."""
    trimmed = F.regexp_replace(F.regexp_replace(F.trim(value), r"^\+", ""), r"^(-?)0+(?=[0-9])", "$1")
    return F.when(F.contains(trimmed, F.lit(".")), F.regexp_replace(F.regexp_replace(trimmed, r"0+$", ""), r"\.$", "")).otherwise(trimmed)


def facts_of(text: Column) -> Column:
    """Facts that a clause states, as array<struct<property, value, unit, operator, polarity, conditions>>."""
    yes, no = F.lit("true"), F.lit("false")
    condition = lambda name, value, pattern: F.struct(F.lit(name).alias("key"), F.when(F.rlike(text, F.lit(pattern)), F.lit(value)).alias("value"))
    given = lambda *all_: F.map_from_entries(F.filter(F.array(*all_), lambda e: e["value"].isNotNull()))
    limit = given(condition("valuation_time", "at_application", "申请时"), condition("calculation_basis", "net_of_arrears_interest", "扣除.*(欠款|利息).*余额"), F.struct(F.lit("calculation_basis").alias("key"), F.when(F.contains(text, F.lit("现金价值")) & ~F.contains(text, F.lit("扣除")), F.lit("gross_cash_value")).alias("value")))
    term = given(condition("per_loan", "true", "每次"))
    none = given(condition("none", "true", "(?!)"))
    end = given(condition("loan_principal_interest", "true", "贷款本金及利息"), condition("cash_value_threshold", "true", "达到现金价值"), condition("other_unpaid_items", "true", "其他未还款项"))
    fact = lambda name, value, unit, operator, conditions: F.struct(F.lit(name).alias("property"), value.alias("value"), F.lit(unit).alias("unit"), F.lit(operator).alias("operator"), F.lit("affirmative").alias("polarity"), conditions.alias("conditions"))
    found = []
    for name, unit, operator, pattern in STATEMENTS:
        value = decimal_text(F.regexp_extract(text, pattern, 1))
        found.append(F.when(F.rlike(text, F.lit(pattern)), fact(name, value, unit, operator, limit if name == "loan_limit_percent" else term if name == "loan_term_months" else none)))
    found.append(F.when(F.rlike(text, F.lit("贷款.*(效力中止|终止)")), fact("loan_termination_condition", yes, "boolean", "equals", end)))
    found.append(F.when(F.rlike(text, F.lit("红利.*(不保证|不确定)")), fact("dividend_guaranteed", no, "boolean", "equals", none)))
    found.append(F.when(F.rlike(text, F.lit("红利.*(固定|保证)")) & ~F.rlike(text, F.lit("不保证|不固定")), fact("dividend_guaranteed", yes, "boolean", "equals", none)))
    found.append(F.when(F.rlike(text, F.lit("红利.*可能为零")), fact("dividend_zero_possible", yes, "boolean", "equals", none)))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def verdicts(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """claims with verdict, from the sources' facts on the same product, version and property.

    claims: claim_id, product, version, property, value, unit, operator, polarity, conditions (map), personal,
    unclassified, exhausted. sources: product, version, property, value, unit, operator, polarity, conditions,
    unresolved. All of a claim's sources are reduced to the number of distinct facts, one of them, and flags.
    """
    keys = ["product", "version", "property"]
    sign = F.concat_ws("|", "value", "unit", "operator", "polarity", F.array_join(F.array_sort(F.transform(F.map_entries("conditions"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";"))
    facts = sources.where("value is not null").withColumn("sign", sign)
    known = facts.groupBy(*keys).agg(F.min("sign").alias("low"), F.max("sign").alias("high"), F.min_by(F.struct("value", "unit", "operator", "polarity", "conditions"), "sign").alias("fact"))
    doubt = sources.where("unresolved").groupBy(*keys).agg(F.lit(True).alias("doubt"))
    met = claims.join(known, keys, "left").join(doubt, keys, "left").withColumn("doubt", F.coalesce("doubt", F.lit(False)))
    has = F.col("low").isNotNull()
    differs = (F.col("fact.value") != F.col("value")) | (F.col("fact.unit") != F.col("unit")) | (F.col("fact.operator") != F.col("operator")) | (F.col("fact.polarity") != F.col("polarity"))
    needed, given = F.map_keys("fact.conditions"), F.map_keys("conditions")
    shared_differs = F.exists(F.array_intersect(needed, given), lambda k: F.element_at("fact.conditions", k) != F.element_at("conditions", k))
    verdict = (
        F.when(F.col("personal"), "needs_person_confirmation")
        .when(F.col("unclassified"), "needs_semantic_review")
        .when(~has & F.col("doubt"), "needs_semantic_review")
        .when(~has & F.col("exhausted"), "not_covered")
        .when(~has, "retrieval_incomplete")
        .when((F.col("low") != F.col("high")) & F.col("doubt"), "needs_semantic_review")
        .when(F.col("low") != F.col("high"), "conflict")
        .when(differs, "contradicted")
        .when(shared_differs, "contradicted")
        .when(F.size(F.array_except(needed, given)) > 0, "missing_condition")
        .when(F.size(F.array_except(given, needed)) > 0, "needs_semantic_review")
        .when(F.col("doubt"), "needs_semantic_review")
        .otherwise("supported")
    )
    return met.select(*claims.columns, verdict.alias("verdict"))


def conflicts(facts: DataFrame, keys: list[str], value: str, basis: str) -> DataFrame:
    """Per key and kind, what disagrees: several values on one basis (conflict), or one value on several bases."""
    same = facts.groupBy(*keys, basis).agg(F.count_distinct(value).alias("n")).where("n > 1").groupBy(*keys).agg(F.count("*").alias("n")).withColumn("kind", F.lit("conflict"))
    other = facts.groupBy(*keys, value).agg(F.count_distinct(basis).alias("n")).where("n > 1").groupBy(*keys).agg(F.count("*").alias("n")).withColumn("kind", F.lit("condition_difference"))
    return same.unionByName(other)


def review_summary(checks: DataFrame, group: str) -> DataFrame:
    """Counts of verdicts, and whether a review is complete and all of it is supported."""
    terminal = F.col("verdict").isin("supported", "contradicted", "missing_condition", "not_covered", "conflict")
    return checks.groupBy(group).agg(F.count("*").alias("claims"), F.count_if(F.col("verdict") == "supported").alias("supported"), F.count_if(~terminal).alias("pending"), F.bool_and(terminal).alias("complete"), F.bool_and(F.col("verdict") == "supported").alias("all_supported"))


def product_dimension(rows: DataFrame, product: str, version: str, alias: str) -> DataFrame:
    """Each product with its sorted versions and aliases."""
    return rows.groupBy(product).agg(F.array_sort(F.collect_set(version)).alias("versions"), F.array_sort(F.collect_set(alias)).alias("aliases"))


def resolve_products(questions: DataFrame, products: DataFrame) -> DataFrame:
    """question_id with state and product: an alias in the question's normal form resolves it if only one product has such.

    Wherever a question has the first three characters of an alias, its runs of the lengths of such aliases are cut out,
    so the containment test is an equi join on whole aliases. What is broadcast are the lengths alone, by a hash of those
    characters: HEADS rows at most, however many aliases there are (two heads of one hash only cut out more runs). Of an
    alias that several products share the join has one row, with the least and greatest of them.
    """
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    hashed = lambda c: F.pmod(F.xxhash64(c), F.lit(HEADS))
    named = products.select("product", F.explode("aliases").alias("alias")).select("product", plain("alias").alias("alias")).where("length(alias) >= 3")
    a = named.groupBy("alias").agg(F.min("product").alias("low"), F.max("product").alias("high"))
    lengths = a.groupBy(hashed(F.substring("alias", 1, 3)).alias("_h")).agg(F.collect_set(F.length("alias")).alias("_n"))
    q = questions.withColumn("_q", plain("question"))
    heads = F.when(F.length("_q") >= 3, F.transform(F.sequence(F.lit(1), F.length("_q") - 2), lambda i: F.struct(i.alias("at"), hashed(F.col("_q").substr(i, F.lit(3))).alias("_h"))))
    runs = q.select("question_id", "_q", F.inline(heads)).join(F.broadcast(lengths), "_h").select("question_id", "_q", "at", F.explode("_n").alias("n")).where("at + n - 1 <= length(_q)")
    # Nothing else is broadcast: files of names are far smaller than their rows, so their size tells little.
    met = runs.select("question_id", F.col("_q").substr(F.col("at"), F.col("n")).alias("alias")).join(a.hint("merge"), "alias")
    hit = met.groupBy("question_id").agg(F.min("low").alias("product"), F.max("high").alias("high"))
    one = F.col("product") == F.col("high")
    state = F.when(one, "resolved").when(F.col("product").isNotNull(), "needs_confirmation").otherwise("not_found")
    found = questions.select("question_id").join(hit.hint("merge"), "question_id", "left")
    return found.select("question_id", state.alias("state"), F.when(one, F.col("product")).alias("product"))


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as facts: a customer's priority for each status, by year."""
    return table(spark, sf, "orders").select((F.col("o_custkey") % 200).alias("product"), F.col("o_orderstatus").alias("property"), F.col("o_orderpriority").alias("value"), F.year("o_orderdate").alias("basis"))


def q_typed_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return conflicts(_facts(spark, sf), ["product", "property"], "value", "basis")


def q_verdict_table(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    condition = lambda test, value: F.when(test, F.create_map(F.lit("season"), value)).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    sources = o.select((F.col("o_custkey") % 900).alias("product"), F.lit("v1").alias("version"), F.col("o_orderstatus").alias("property"), F.when(F.col("o_orderkey") % 15 != 0, F.substring("o_orderpriority", 1, 1)).alias("value"), F.lit("none").alias("unit"), F.lit("equals").alias("operator"), F.lit("affirmative").alias("polarity"), condition(F.col("o_orderkey") % 10 == 0, F.lit("a")).alias("conditions"), (F.col("o_orderkey") % 35 == 0).alias("unresolved"))
    claims = o.select(F.col("o_orderkey").alias("claim_id"), (F.col("o_custkey") % 900).alias("product"), F.lit("v1").alias("version"), F.col("o_orderstatus").alias("property"), F.substring("o_orderpriority", 1, 1).alias("value"), F.lit("none").alias("unit"), F.lit("equals").alias("operator"), F.lit("affirmative").alias("polarity"), condition(F.col("o_orderkey") % 3 == 0, F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("b")).alias("conditions"), (F.col("o_orderkey") % 41 == 0).alias("personal"), (F.col("o_orderkey") % 43 == 0).alias("unclassified"), (F.col("o_orderkey") % 4 != 0).alias("exhausted"))
    return verdicts(claims, sources).select("claim_id", "verdict")


def q_review_summary(spark: SparkSession, sf: str) -> DataFrame:
    checks = q_verdict_table(spark, sf).withColumn("batch", F.col("claim_id") % 50)
    return review_summary(checks, "batch")


def q_product_dimension(spark: SparkSession, sf: str) -> DataFrame:
    found = product_dimension(table(spark, sf, "part"), "p_brand", "p_type", "p_name")
    return found.select("p_brand", F.array_join("versions", ";").alias("versions"), F.array_join("aliases", ";").alias("aliases"))


def q_product_resolution(spark: SparkSession, sf: str) -> DataFrame:
    products = product_dimension(table(spark, sf, "customer").withColumn("alias", F.regexp_replace("c_name", "#0*", " ")), "c_custkey", "c_mktsegment", "alias").select(F.col("c_custkey").alias("product"), "aliases")
    questions = table(spark, sf, "orders").select(F.col("o_orderkey").alias("question_id"), F.concat(F.lit("status of customer-"), F.col("o_custkey").cast("string"), F.lit("?")).alias("question"))
    return resolve_products(questions, products).select("question_id", "state", F.coalesce("product", F.lit(-1)).alias("product"))


_VERDICT_SQL = """o AS (SELECT *, o_custkey % 900 AS product FROM orders),
s AS (SELECT product, o_orderstatus AS property, CASE WHEN o_orderkey % 15 <> 0 THEN substr(o_orderpriority, 1, 1) END AS value, CASE WHEN o_orderkey % 10 = 0 THEN 'a' END AS cond, o_orderkey % 35 = 0 AS unresolved FROM o),
k AS (SELECT product, property, count(DISTINCT value || '|' || coalesce(cond, '')) AS n, min(value) AS fact, min(cond) AS need FROM s WHERE value IS NOT NULL GROUP BY 1, 2),
u AS (SELECT DISTINCT product, property FROM s WHERE unresolved),
c AS (SELECT o_orderkey AS claim_id, product, o_orderstatus AS property, substr(o_orderpriority, 1, 1) AS value, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END END AS cond FROM o),
v AS (SELECT claim_id, CASE WHEN claim_id % 41 = 0 THEN 'needs_person_confirmation' WHEN claim_id % 43 = 0 THEN 'needs_semantic_review'
 WHEN k.n IS NULL AND u.product IS NOT NULL THEN 'needs_semantic_review' WHEN k.n IS NULL AND claim_id % 4 <> 0 THEN 'not_covered' WHEN k.n IS NULL THEN 'retrieval_incomplete'
 WHEN k.n > 1 AND u.product IS NOT NULL THEN 'needs_semantic_review' WHEN k.n > 1 THEN 'conflict' WHEN fact <> value THEN 'contradicted' WHEN need <> cond THEN 'contradicted'
 WHEN need IS NOT NULL AND cond IS NULL THEN 'missing_condition' WHEN need IS NULL AND cond IS NOT NULL THEN 'needs_semantic_review' WHEN u.product IS NOT NULL THEN 'needs_semantic_review' ELSE 'supported' END AS verdict
 FROM c LEFT JOIN k ON c.product = k.product AND c.property = k.property LEFT JOIN u ON c.product = u.product AND c.property = u.property)"""
QUERIES = {
    "typed_conflicts": q_typed_conflicts,
    "verdict_table": q_verdict_table,
    "review_summary": q_review_summary,
    "product_dimension": q_product_dimension,
    "product_resolution": q_product_resolution,
}
ORACLES = {
    "typed_conflicts": "WITH f AS (SELECT o_custkey % 200 AS product, o_orderstatus AS property, o_orderpriority AS value, year(o_orderdate) AS basis FROM orders) SELECT product, property, count(*) AS n, 'conflict' AS kind FROM (SELECT product, property, basis FROM f GROUP BY ALL HAVING count(DISTINCT value) > 1) GROUP BY 1, 2 UNION ALL SELECT product, property, count(*), 'condition_difference' FROM (SELECT product, property, value FROM f GROUP BY ALL HAVING count(DISTINCT basis) > 1) GROUP BY 1, 2",
    "verdict_table": f"WITH {_VERDICT_SQL} SELECT * FROM v",
    "review_summary": f"WITH {_VERDICT_SQL}, t AS (SELECT claim_id % 50 AS batch, verdict, verdict IN ('supported', 'contradicted', 'missing_condition', 'not_covered', 'conflict') AS done FROM v) SELECT batch, count(*) AS claims, count(*) FILTER (verdict = 'supported') AS supported, count(*) FILTER (NOT done) AS pending, bool_and(done) AS complete, bool_and(verdict = 'supported') AS all_supported FROM t GROUP BY batch",
    "product_dimension": "SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_type)), ';') AS versions, array_to_string(list_sort(list(DISTINCT p_name)), ';') AS aliases FROM part GROUP BY p_brand",
    # Containment of names in questions is too slow in SQL over all rows; a test holds it against brute force.
}
