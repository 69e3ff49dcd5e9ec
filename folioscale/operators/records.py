"""Records of a catalogue held against each other: replacements, targets, selections, reviews, prior versions, chains, views, boxes, requests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscale.functions.text import normal
from folioscale.operators import intervals
from folioscale.operators.views import sentence_spans
from folioscale.operators.wording import family
from folioscale.session import kept, table

#: Characters of a review's evidence at most, and what it may say of a source.
MOST_EVIDENCE, RELEVANCE = 2000, ["relevant", "needs_full_text"]
#: Room for an import: copies of what is read, and bytes beside them.
IMPORT_COPIES, IMPORT_RESERVE = 3, 512 * 1024 * 1024
#: How much taller a box of the same row may be, and how much of the lower one must lie beside it.
ROW_HEIGHTS, ROW_OVERLAP = 2.5, 0.6
#: Inputs and outputs of a scenario, and characters of a value at most.
MOST_INPUTS, MOST_OUTPUTS, MOST_VALUE = 1000, 200, 32_767
#: Nodes of a topic graph.
LEAST_NODES, MOST_NODES = 3, 24
#: Rows of a side of a block of pairs.
BLOCK = 1024


def replacement_counts(rows: DataFrame, identity: list[str], sha: str) -> DataFrame:
    """identity and sha of each content with replaces: how many rows of the same identity hold another content.

    Counted from two partial sums; the pairs of a group are never made.
    """
    own = rows.groupBy(*identity, sha).agg(F.count("*").alias("_own"))
    whole = own.groupBy(*identity).agg(F.sum("_own").alias("_whole"))
    return own.join(whole, identity).select(*identity, sha, (F.col("_whole") - F.col("_own")).alias("replaces"))


def match_targets(targets: DataFrame, products: DataFrame) -> DataFrame:
    """target and product of each match: an asked id or name is one of a product's identities, and the years agree or one is unknown.

    targets: target, id, name, year; products: product, name, aliases (array), year. Years are texts, empty if unknown.
    The pairs are the result and can be as many as targets times products, so each is made once, and none is moved: what
    shares a key of an identity and a year meets as blocks of about BLOCK rows a side, pairs of blocks are dealt out
    evenly, and only there they become pairs. A pair that shares several keys is left to the least of them.
    """
    key = lambda year: F.concat("identity", F.lit("\u0001"), year)
    any_year = F.lit("\u0002")
    years = F.when(F.col("wanted") == "", F.array(any_year)).otherwise(F.array(F.col("wanted"), F.lit("")))
    asked = _asked(targets).select("target", "identity", F.explode(years).alias("y")).select("target", key(F.col("y")).alias("key")).distinct()
    known = _known(products).select("product", "identity", F.explode(F.array(F.col("year"), any_year)).alias("y")).select("product", key(F.col("y")).alias("key")).distinct()
    # Keys of both sides only; those of one target that are less than each.
    shared = asked.join(known.select("key").distinct(), "key", "left_semi").withColumn("keys", F.collect_set("key").over(Window.partitionBy("target")))
    asked = kept(shared.select("target", "key", F.filter("keys", lambda k: k < F.col("key")).alias("less")), "asked")
    known = kept(known.join(asked.select("key").distinct(), "key", "left_semi"), "known")
    least = _block_pairs(asked.where("size(less) = 0").select("key", "target"), known, "target", "product")
    more = asked.where("size(less) > 0")
    held = known.withColumn("keys", F.collect_set("key").over(Window.partitionBy("product"))).join(more.select("key").distinct(), "key", "left_semi")
    other = _block_pairs(more.select("key", "target", "less"), held.select("key", "product", "keys"), "target", "product").where(~F.arrays_overlap("less", "keys"))
    return least.select("target", "product").unionByName(other.select("target", "product"))


def _block_pairs(rows: DataFrame, others: DataFrame, name: str, other: str) -> DataFrame:
    """All pairs of rows and others with the same key, named by columns of theirs that differ: columns of both without the key."""

    def blocks(own: DataFrame, number: str, held: str) -> DataFrame:
        sizes = own.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("_blocks"))
        dealt = own.join(sizes, "key").withColumn("_block", F.pmod(F.xxhash64(number), "_blocks"))
        return dealt.groupBy("key", "_block").agg(F.collect_list(F.struct(*[c for c in own.columns if c != "key"])).alias(held)).drop("_block")

    met = blocks(rows, name, "_rows").join(blocks(others, other, "_others").hint("merge"), "key").select("_rows", "_others")
    dealt = met.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.select(F.inline("_rows"), "_others").select(*[c for c in rows.columns if c != "key"], F.inline("_others"))


def selection_verdicts(selected: DataFrame, readable: DataFrame, request: str, key: str) -> DataFrame:
    """request and verdict: duplicate if a key is selected twice, unknown if one cannot be read, else ok."""
    own = selected.groupBy(request, key).agg(F.count("*").alias("_times"))
    known = readable.select(key).distinct().withColumn("_known", F.lit(True))
    judged = own.join(known, key, "left").groupBy(request).agg(F.max("_times").alias("_times"), F.bool_and(F.col("_known").isNotNull()).alias("_all"))
    return judged.select(request, F.when(F.col("_times") > 1, "duplicate").when(~F.col("_all"), "unknown").otherwise("ok").alias("verdict"))


def review_verdict(text: Column, start: Column, end: Column, quote: Column, relevance: Column, reason: Column) -> Column:
    """Why a review of a source is refused: relevance, reason, span or quote; ok if it holds."""
    length = F.length(F.coalesce(text, F.lit("")))
    said = F.length(F.regexp_replace(F.coalesce(reason, F.lit("")), r"^\s+|\s+$", ""))
    return (
        F.when(~F.coalesce(relevance.isin(RELEVANCE), F.lit(False)), "relevance")
        .when(~said.between(1, 1000), "reason")
        .when(~F.coalesce((start >= 0) & (start < end) & (end <= length) & (end - start <= MOST_EVIDENCE), F.lit(False)), "span")
        .when(~F.coalesce(F.substring(text, start + 1, end - start) == quote, F.lit(False)), "quote")
        .otherwise("ok")
    )


def preserve_prior(candidates: DataFrame, prior: DataFrame, key: str) -> DataFrame:
    """key, entry and outcome: an accepted candidate is taken; else a prior entry that counts and can be used is kept; else the place
    is pending where a person has to decide, or left out. candidates: key, entry, failure (null: accepted); prior: key,
    entry, bucket, usable. A prior entry whose key is not scanned any more is kept as missing."""
    old = prior.select(key, F.col("entry").alias("_old"), (F.col("bucket").isin("evidence", "lead") & F.col("usable")).alias("_good"))
    both = candidates.withColumn("_here", F.lit(True)).join(old, key, "full")
    accepted = F.col("_here").isNotNull() & F.col("failure").isNull()
    reason = F.when(F.col("_here").isNull(), "missing").otherwise(F.col("failure"))
    outcome = F.when(accepted, "taken").when(F.col("_good"), F.concat(reason, F.lit("_kept"))).when(reason.isin("privacy", "classification", "stale_decision", "relation"), "pending").otherwise("left_out")
    return both.select(key, F.when(accepted, F.col("entry")).when(F.col("_good"), F.col("_old")).alias("entry"), outcome.alias("outcome"))


def revision_protection(inactive: Column, replaces_product: Column, adopted: Column, primary: Column, risky: Column) -> Column:
    """What becomes of a revision by its source: pending_revision, non_authoritative or accepted. A replaced product needs an
    explicit adoption and a primary source; a source that denies its own authority never counts."""
    pending = replaces_product & ~adopted
    return F.when(~inactive & pending, "pending_revision").when(~inactive & ((replaces_product & ~primary) | risky), "non_authoritative").otherwise("accepted")


def supersede_chain(rows: DataFrame, locator: str, order: list[str], source: str) -> DataFrame:
    """The rows with previous and successor: sources of the same locator before and after each; the last one is active."""
    window = Window.partitionBy(locator).orderBy(*order)
    return rows.withColumn("previous", F.lag(source).over(window)).withColumn("successor", F.lead(source).over(window)).withColumn("active", F.col("successor").isNull())


def view_states(desired: DataFrame, manifest: DataFrame, disk: DataFrame) -> DataFrame:
    """path and state of every file of a view: conflict (on disk, not as last written), missing, outdated, unmanaged or ready. Tables: path, sha."""
    parts = [t.select("path", F.col("sha").alias(name)) for name, t in (("want", desired), ("last", manifest), ("there", disk))]
    files = reduce(lambda a, b: a.join(b, "path", "full"), parts)
    state = (
        F.when(F.col("want").isNull() & F.col("last").isNull(), "unmanaged")
        .when(F.col("there").isNull(), "missing")
        .when(~F.col("there").eqNullSafe(F.col("last")), "conflict")
        .when(~F.col("want").eqNullSafe(F.col("last")), "outdated")
        .otherwise("ready")
    )
    return files.select("path", state.alias("state"))


def covered_area(boxes: DataFrame, page: str) -> DataFrame:
    """page and area of the union of its boxes (x0, y0, x1, y1), by slabs between the edges."""
    edges = boxes.select(page, F.explode(F.array("x0", "x1")).alias("left")).distinct()
    slabs = edges.withColumn("right", F.lead("left").over(Window.partitionBy(page).orderBy("left"))).where("right IS NOT NULL")
    inside = slabs.join(boxes, page).where((F.col("x0") < F.col("right")) & (F.col("x1") > F.col("left")))
    before = F.coalesce(F.max("y1").over(Window.partitionBy(page, "left").orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1)), F.col("y0"))
    part = F.greatest(F.lit(0), F.col("y1") - F.greatest("y0", before)) * (F.col("right") - F.col("left"))
    return inside.select(page, part.alias("part")).groupBy(page).agg(F.sum("part").alias("area"))


def row_mates(boxes: DataFrame, page: str, box: str) -> DataFrame:
    """page, box and mates: other boxes of the page in the same visual row, of a like height and beside most of it."""
    other = boxes.select(page, F.col(box).alias("_box"), F.col("y0").alias("_y0"), F.col("y1").alias("_y1"))
    height, other_height = F.col("y1") - F.col("y0"), F.col("_y1") - F.col("_y0")
    least = F.least(height, other_height)
    same = (F.col(box) != F.col("_box")) & (F.greatest(height, other_height) <= least * ROW_HEIGHTS) & (F.least("y1", "_y1") - F.greatest("y0", "_y0") >= least * ROW_OVERLAP)
    return boxes.join(other, page).groupBy(page, box).agg(F.count_if(same).alias("mates"))


def scenario_verdicts(inputs: DataFrame, outputs: DataFrame, formulas: DataFrame) -> DataFrame:
    """request and verdict of each scenario: size, duplicate, literal, formula or ok, the first that applies.

    inputs: request, cell, value (text); outputs: request, cell; formulas: request, cell of the cells that hold one.
    """
    held = formulas.select("request", "cell").distinct().withColumn("_formula", F.lit(True))
    bad = F.coalesce(F.col("value").startswith("=") | (F.length("value") > MOST_VALUE), F.lit(False))
    cells = inputs.groupBy("request", "cell").agg(F.count("*").alias("times"), F.bool_or(bad).alias("bad")).join(held, ["request", "cell"], "left")
    given = cells.groupBy("request").agg(F.sum("times").alias("inputs"), F.max("times").alias("twice"), F.bool_or("bad").alias("bad"), F.bool_or(F.col("_formula").isNotNull()).alias("formula"))
    asked = outputs.groupBy("request", "cell").agg(F.count("*").alias("times")).groupBy("request").agg(F.sum("times").alias("outputs"), F.max("times").alias("asked_twice"))
    both = given.join(asked, "request", "full")
    none = F.lit(0)
    verdict = (
        F.when((F.coalesce("inputs", none) > MOST_INPUTS) | ~F.coalesce("outputs", none).between(1, MOST_OUTPUTS), "size")
        .when(F.greatest(F.coalesce("twice", none), F.coalesce("asked_twice", none)) > 1, "duplicate")
        .when(F.col("bad"), "literal")
        .when(F.col("formula"), "formula")
        .otherwise("ok")
    )
    return both.select("request", verdict.alias("verdict"))


def receipt_verdict(asked: Column, given: Column) -> Column:
    """Whether a receipt answers its request: count, identity, missing, error or ok. Arrays of struct<cell, value> in order; asked has cells only."""
    return (
        F.when(F.size(asked) != F.size(given), "count")
        .when(F.exists(F.arrays_zip(asked.alias("a"), F.transform(given, lambda g: g["cell"]).alias("b")), lambda z: ~z["a"].eqNullSafe(z["b"])), "identity")
        .when(F.exists(given, lambda g: g["value"].isNull()), "missing")
        .when(F.exists(given, lambda g: g["value"].isin("#N/A", "#NAME?", "#GETTING_DATA") | (g["value"].startswith("#") & g["value"].endswith("!"))), "error")
        .otherwise("ok")
    )


def cache_use(files: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """The files with hit: whether a whole extraction of the same content, suffix and version is kept. files: sha, suffix; cache: sha, suffix, version, complete."""
    kept = cache.where((F.col("version") == version) & F.col("complete")).select("sha", "suffix").distinct().withColumn("hit", F.lit(True))
    return files.join(kept, ["sha", "suffix"], "left").withColumn("hit", F.col("hit").isNotNull())


def _asked(targets: DataFrame) -> DataFrame:
    named = targets.select("target", F.coalesce("year", F.lit("")).alias("wanted"), F.explode(F.array_distinct(F.array(normal(F.col("id").cast("string")), normal(F.col("name"))))).alias("identity"))
    return named.where("identity <> ''")


def _known(products: DataFrame) -> DataFrame:
    names = F.concat(F.array(F.col("product").cast("string"), F.col("name")), F.coalesce("aliases", F.array().cast("array<string>")))
    named = products.select("product", F.coalesce("year", F.lit("")).alias("year"), F.explode(F.array_distinct(names)).alias("name"))
    return named.select("product", "year", normal(F.col("name")).alias("identity")).where("identity <> ''").distinct()


def unique_matches(targets: DataFrame, products: DataFrame) -> DataFrame:
    """target, state (one, none or many) and product of each target: a selection counts only if a single product matches.

    Products are counted for each identity and year first; a target meets two identities, and three counts of each, at
    most, and no pair of a target and a product is made.
    """
    by_year = _known(products).groupBy("identity", "year").agg(F.count("*").alias("n"), F.min("product").alias("least"))
    whole = by_year.groupBy("identity").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    asked = _asked(targets)
    any_year = asked.where("wanted = ''").join(whole, "identity")
    own = asked.where("wanted <> ''").withColumn("year", F.explode(F.array(F.lit(""), F.col("wanted")))).join(by_year, ["identity", "year"])
    found = any_year.select("target", "n", "least").unionByName(own.select("target", "n", "least"))
    counted = found.groupBy("target").agg(F.max("n").alias("most"), F.min("least").alias("low"), F.max("least").alias("high"))
    one = (F.col("most") == 1) & (F.col("low") == F.col("high"))
    state = F.when(one, "one").when(F.col("most").isNotNull(), "many").otherwise("none")
    return targets.select("target").distinct().join(counted, "target", "left").select("target", state.alias("state"), F.when(one, F.col("low")).alias("product"))


def plan_violations(nodes: DataFrame, active: DataFrame, least: int = LEAST_NODES, most: int = MOST_NODES) -> DataFrame:
    """graph and violations (sorted names) of each graph that breaks a rule: size, title (twice), source (not active), related (no title of the graph), self.

    nodes: graph, title, source, related; active: source. A null related is none.
    """
    titles = nodes.groupBy("graph", F.col("title").alias("_title")).agg(F.count("*").alias("_times"))
    known = active.select("source").distinct().withColumn("_active", F.lit(True))
    judged = nodes.join(known, "source", "left").join(titles.select("graph", F.col("_title").alias("related"), F.lit(True).alias("_there")), ["graph", "related"], "left")
    own = judged.groupBy("graph").agg(
        F.bool_or(F.col("_active").isNull()).alias("source"),
        F.bool_or(F.col("related").isNotNull() & F.col("_there").isNull()).alias("related"),
        F.coalesce(F.bool_or(F.col("related") == F.col("title")), F.lit(False)).alias("self"),
    )
    sizes = titles.groupBy("graph").agg(~F.sum("_times").between(least, most)).toDF("graph", "size").join(titles.groupBy("graph").agg((F.max("_times") > 1).alias("title")), "graph")
    both = own.join(sizes, "graph")
    named = F.filter(F.array(*[F.when(F.col(x), F.lit(x)) for x in ("related", "self", "size", "source", "title")]), lambda x: x.isNotNull())
    return both.select("graph", named.alias("violations")).where(F.size("violations") > 0)


def claim_plan(units: DataFrame, versions: DataFrame) -> DataFrame:
    """unit, product and version of each atom: a unit for each version of its product, with a null version if the product has none."""
    return units.select("unit", "product").join(versions.select("product", "version").distinct(), "product", "left").select("unit", "product", "version")


def pending_after(pending: DataFrame, reviewed: DataFrame, key: str) -> DataFrame:
    """Pending spans (start, end) that lie in no reviewed span of their key."""
    done = intervals.contained(pending, reviewed, key)
    return pending.join(done, [key, "start", "end"], "left_anti")


def batch_verdicts(reviews: DataFrame, scanned: DataFrame, batch: str, key: str) -> DataFrame:
    """batch, reviews, unconsumed and accepted: a batch with any review of what was not scanned is refused as a whole."""
    known = scanned.select(key).distinct().withColumn("_known", F.lit(True))
    judged = reviews.join(known, key, "left").groupBy(batch).agg(F.count("*").alias("reviews"), F.count_if(F.col("_known").isNull()).alias("unconsumed"))
    return judged.withColumn("accepted", F.col("unconsumed") == 0)


def segment_of(spans: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """key, place and start of the segment (start, end) that holds a place; start is null where none does."""
    at = spans.select(key, "place")
    held = intervals.point_join(at.distinct(), segments.select(key, "start", "end"), key, "place")
    return at.join(held.select(key, "place", "start"), [key, "place"], "left")


def q_replacement_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("product"), F.col("p_type").alias("version"), family(F.col("p_name")).alias("family"), F.col("p_size").alias("sha"))
    return replacement_counts(rows, ["product", "version", "family"], "sha")


def q_target_match(spark: SparkSession, sf: str) -> DataFrame:
    customers, suppliers = table(spark, sf, "customer"), table(spark, sf, "supplier")
    year = F.when(F.col("c_custkey") % 4 > 0, F.col("c_nationkey").cast("string")).otherwise("")
    targets = customers.select(F.col("c_custkey").alias("target"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).alias("id"), F.concat(F.lit("Alias - "), F.col("c_nationkey") % 5).alias("name"), year.alias("year"))
    products = suppliers.select(F.col("s_suppkey").alias("product"), F.col("s_name").alias("name"), F.array(F.concat(F.lit("ALIAS "), F.col("s_nationkey") % 5)).alias("aliases"), F.col("s_nationkey").cast("string").alias("year"))
    return match_targets(targets, products)


def q_selection_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    selected = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"))
    return selection_verdicts(selected, table(spark, sf, "part").where("p_size > 5"), "l_orderkey", "p_partkey")


def q_semantic_review(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("doc_id")
    start = (key % 50).cast("int")
    end = start + (key % 23).cast("int") * 100
    quote = F.concat(F.substring("text", start + 1, end - start), F.when(key % 7 == 0, " ").otherwise(""))
    relevance = F.when(key % 11 == 0, "unsure").otherwise(RELEVANCE[0])
    reason = F.when(key % 13 == 0, " \n").otherwise("names the term")
    return table(spark, sf, "documents").select("doc_id", review_verdict(F.col("text"), start, end, quote, relevance, reason).alias("verdict"))


def q_preserve_prior(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    failure = F.when(F.col("o_orderpriority") == "1-URGENT", "privacy").when(F.col("o_orderpriority") == "2-HIGH", "quality")
    candidates = orders.where("o_orderstatus <> 'F'").select("o_orderkey", (F.col("o_orderkey") * 10).alias("entry"), failure.alias("failure"))
    prior = orders.where("o_totalprice > 100000").select("o_orderkey", (F.col("o_orderkey") * 10 + 1).alias("entry"), F.when(F.col("o_custkey") % 3 == 0, "inactive").otherwise("evidence").alias("bucket"), (F.col("o_custkey") % 5 > 0).alias("usable"))
    return preserve_prior(candidates, prior, "o_orderkey")


def q_revision_protection(spark: SparkSession, sf: str) -> DataFrame:
    state = revision_protection(F.col("o_orderstatus") == "P", F.col("o_totalprice") > 250000, F.col("o_custkey") % 2 == 0, F.col("o_orderpriority") < "3", F.col("o_custkey") % 17 == 0)
    return table(spark, sf, "orders").groupBy(state.alias("adoption")).agg(F.count("*").alias("n"))


def q_supersede_chain(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return supersede_chain(rows, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey").select("o_orderkey", "previous", "successor", "active")


def q_active_page_sources(spark: SparkSession, sf: str) -> DataFrame:
    active = table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").join(active, "l_orderkey", "left_semi").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("sources"), F.min("l_orderkey").alias("first"))


def q_view_states(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), "o_custkey", "o_totalprice", "o_orderstatus")
    sha = F.sha2(F.col("path").cast("string"), 256)
    desired = orders.where("o_orderstatus <> 'F'").select("path", F.when(F.col("o_custkey") % 7 == 0, "new").otherwise(sha).alias("sha"))
    manifest = orders.where("o_custkey % 3 > 0").select("path", sha.alias("sha"))
    disk = orders.where("o_totalprice > 60000").select("path", F.when(F.col("o_custkey") % 5 == 0, "edited").otherwise(sha).alias("sha"))
    return view_states(desired, manifest, disk)


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    x, y = F.col("l_partkey") % 90, F.col("l_suppkey") % 40
    return table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("box"), x.alias("x0"), y.alias("y0"), (x + F.col("l_quantity").cast("long")).alias("x1"), (y + 5 + F.col("l_suppkey") % 11).alias("y1")).distinct()


def q_covered_area(spark: SparkSession, sf: str) -> DataFrame:
    return covered_area(_boxes(spark, sf), "l_orderkey")


def q_row_mates(spark: SparkSession, sf: str) -> DataFrame:
    return row_mates(_boxes(spark, sf), "l_orderkey", "box")


def q_scenario_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    cells = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("request"), F.col("l_linenumber").alias("cell"), "l_quantity", "l_returnflag", "l_tax")
    value = F.concat(F.when(F.col("l_quantity") == 7, "=").otherwise(""), F.col("l_quantity").cast("string"))
    return scenario_verdicts(cells.where("l_returnflag <> 'R'").withColumn("value", value), cells.where("l_returnflag = 'R'"), cells.where("l_tax = 0.03"))


def q_receipt_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    line = F.struct(F.col("l_linenumber").alias("place"), F.col("l_partkey").alias("cell"), F.when(F.col("l_quantity") == 9, F.lit(None)).when(F.col("l_quantity") == 11, "#REF!").otherwise("1").alias("value"))
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    asked = F.transform("lines", lambda x: x["cell"])
    given = F.when(F.col("l_orderkey") % 5 == 0, F.slice("lines", 1, 2)).otherwise(F.transform("lines", lambda x: F.struct(x["place"].alias("place"), F.when(x["cell"] % 29 == 0, -1).otherwise(x["cell"]).alias("cell"), x["value"].alias("value"))))
    return lines.select("l_orderkey", receipt_verdict(asked, given).alias("verdict"))


def q_cache_use(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), F.col("lang").alias("suffix"))
    cache = docs.join(table(spark, sf, "labels"), "doc_id").select("sha", "suffix", F.when(F.col("toxic") == 1, "1").otherwise("2").alias("version"), (F.col("quality") == 1).alias("complete"))
    return cache_use(docs, cache, "2").groupBy("source").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def q_import_estimate(spark: SparkSession, sf: str) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return table(spark, sf, "documents").agg((F.coalesce(F.sum(size), F.lit(0)) * IMPORT_COPIES + IMPORT_RESERVE).alias("bytes"))


def q_feedback_items(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    leads = orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("file"), F.col("o_orderpriority").alias("reason"), (F.col("o_orderpriority") < "3").alias("can_adopt"))
    rest = orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("file"), F.col("o_orderpriority").alias("reason"), F.lit(False).alias("can_adopt"))
    return leads.unionByName(rest.join(leads.select("file").distinct(), "file", "left_anti")).groupBy("file", "reason", "can_adopt").agg(F.count("*").alias("n"))


def q_source_ids(spark: SparkSession, sf: str) -> DataFrame:
    digest = F.sha2(F.concat_ws("\0", F.lit("file"), "url", F.sha2("html", 256)), 256)
    return table(spark, sf, "pages").select("page_id", F.concat(F.lit("src-"), F.substring(digest, 1, 20)).alias("source_id"))


def q_candidate_counts(spark: SparkSession, sf: str) -> DataFrame:
    relevant = F.coalesce(F.lower("text").contains("tion"), F.lit(False)) | (F.col("source") == "web")
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("candidates"), F.count_if(relevant).alias("relevant"), F.count_if(~relevant).alias("excluded"))


def q_sheet_lines(spark: SparkSession, sf: str) -> DataFrame:
    line = F.format_string("[%s!%s] %s", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.concat_ws("", "l_returnflag", F.col("l_partkey").cast("string")))
    cells = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", line.alias("line")))).alias("cells"))
    return cells.select("l_orderkey", F.array_join(F.transform("cells", lambda c: c["line"]), "\n").alias("text"))


def q_unique_selection(spark: SparkSession, sf: str) -> DataFrame:
    targets = table(spark, sf, "customer").select(F.col("c_custkey").alias("target"), F.lit(None).cast("long").alias("id"), F.concat(F.lit("Nation "), F.col("c_nationkey")).alias("name"), F.lit("").alias("year"))
    products = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("product"), F.col("s_name").alias("name"), F.array(F.concat(F.lit("nation-"), F.col("s_nationkey") + F.col("s_suppkey") % 4 * 6)).alias("aliases"), F.lit("").alias("year"))
    return unique_matches(targets, products)


def q_plan_violations(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("graph"), (F.col("l_partkey") % 30).alias("title"), F.col("l_suppkey").alias("source"), F.when(F.col("l_returnflag") == "R", F.col("l_suppkey") % 30).alias("related"))
    found = plan_violations(nodes, table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("source")))
    return found.select("graph", F.array_join("violations", ",").alias("violations"))


def q_claim_plan(spark: SparkSession, sf: str) -> DataFrame:
    units = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("unit"), F.col("l_partkey").alias("product"))
    versions = table(spark, sf, "part").where("p_size > 4").select(F.col("p_partkey").alias("product"), F.explode(F.array(F.col("p_size"), F.col("p_size") + F.col("p_partkey").cast("int") % 3)).alias("version"))
    return claim_plan(units, versions)


def _line_spans(spark: SparkSession, sf: str, before: int, length: int) -> DataFrame:
    start = F.col("l_partkey") % 100 - before
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", start.alias("start"), (start + length).alias("end"))


def q_pending_spans(spark: SparkSession, sf: str) -> DataFrame:
    return pending_after(_line_spans(spark, sf, 0, 10).where("l_returnflag <> 'R'"), _line_spans(spark, sf, 20, 60).where("l_returnflag = 'R'"), "l_orderkey").select("l_orderkey", "l_linenumber", "start")


def q_batch_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    scanned = table(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return batch_verdicts(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), scanned, "o_custkey", "o_orderkey")


def q_segment_of(spark: SparkSession, sf: str) -> DataFrame:
    spans = table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("key"), (F.length("text") % 97).alias("place"))
    texts = table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("key"), F.translate("text", ".", "。").alias("text"))
    return segment_of(spans, sentence_spans(texts, "key"), "key")


def q_activation_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") != "error").alias("valid"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("activations"))


def q_classification_overview(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return docs.groupBy("source").agg(F.count_if(F.col("quality").isNull() & F.col("toxic").isNull()).alias("pending"), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 0)).alias("ambiguous"), F.count("*").alias("documents"))


_BOXES = "b AS (SELECT DISTINCT l_orderkey, l_partkey * 10 + l_linenumber AS box, l_partkey % 90 AS x0, l_suppkey % 40 AS y0, l_partkey % 90 + CAST(trunc(l_quantity) AS BIGINT) AS x1, l_suppkey % 40 + 5 + l_suppkey % 11 AS y1 FROM lineitem)"

QUERIES = {
    "replacement_candidates": q_replacement_candidates,
    "target_match": q_target_match,
    "selection_verdicts": q_selection_verdicts,
    "semantic_review": q_semantic_review,
    "preserve_prior": q_preserve_prior,
    "revision_protection": q_revision_protection,
    "supersede_chain": q_supersede_chain,
    "active_page_sources": q_active_page_sources,
    "view_states": q_view_states,
    "covered_area": q_covered_area,
    "row_mates": q_row_mates,
    "scenario_verdicts": q_scenario_verdicts,
    "receipt_verdicts": q_receipt_verdicts,
    "cache_use": q_cache_use,
    "import_estimate": q_import_estimate,
    "feedback_items": q_feedback_items,
    "source_ids": q_source_ids,
    "candidate_counts": q_candidate_counts,
    "sheet_lines": q_sheet_lines,
    "unique_selection": q_unique_selection,
    "plan_violations": q_plan_violations,
    "claim_plan": q_claim_plan,
    "pending_spans": q_pending_spans,
    "batch_verdicts": q_batch_verdicts,
    "segment_of": q_segment_of,
    "activation_counts": q_activation_counts,
    "classification_overview": q_classification_overview,
}
ORACLES = {
    "replacement_candidates": "WITH r AS (SELECT p_brand AS product, p_type AS version, replace(p_name, ' ', '') AS family, p_size AS sha FROM part) SELECT DISTINCT product, version, family, sha, (SELECT count(*) FROM r o WHERE o.product = r.product AND o.version = r.version AND o.family = r.family AND o.sha <> r.sha) AS replaces FROM r",
    "target_match": "SELECT c_custkey AS target, s_suppkey AS product FROM customer JOIN supplier ON (c_nationkey % 5 = s_nationkey % 5 OR (c_custkey % 3 = 0 AND c_custkey = s_suppkey)) AND (c_custkey % 4 = 0 OR c_nationkey = s_nationkey)",
    "selection_verdicts": "SELECT l_orderkey, CASE WHEN count(*) > count(DISTINCT l_partkey) THEN 'duplicate' WHEN count(*) FILTER (p_partkey IS NULL) > 0 THEN 'unknown' ELSE 'ok' END AS verdict FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 5) ON l_partkey = p_partkey GROUP BY 1",
    "semantic_review": "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'relevance' WHEN doc_id % 13 = 0 THEN 'reason' WHEN doc_id % 23 IN (0, 21, 22) OR doc_id % 50 + doc_id % 23 * 100 > length(coalesce(text, '')) THEN 'span' WHEN doc_id % 7 = 0 THEN 'quote' ELSE 'ok' END AS verdict FROM documents",
    "preserve_prior": "WITH o AS (SELECT *, o_orderstatus <> 'F' AS here, o_totalprice > 100000 AS old, o_totalprice > 100000 AND o_custkey % 3 > 0 AND o_custkey % 5 > 0 AS good, CASE WHEN o_orderstatus = 'F' THEN 'missing' WHEN o_orderpriority = '1-URGENT' THEN 'privacy' WHEN o_orderpriority = '2-HIGH' THEN 'quality' END AS reason FROM orders) SELECT o_orderkey, CASE WHEN reason IS NULL THEN o_orderkey * 10 WHEN good THEN o_orderkey * 10 + 1 END AS entry, CASE WHEN reason IS NULL THEN 'taken' WHEN good THEN reason || '_kept' WHEN reason = 'privacy' THEN 'pending' ELSE 'left_out' END AS outcome FROM o WHERE here OR old",
    "revision_protection": "SELECT CASE WHEN o_orderstatus = 'P' THEN 'accepted' WHEN o_totalprice > 250000 AND o_custkey % 2 <> 0 THEN 'pending_revision' WHEN (o_totalprice > 250000 AND o_orderpriority >= '3') OR o_custkey % 17 = 0 THEN 'non_authoritative' ELSE 'accepted' END AS adoption, count(*) AS n FROM orders GROUP BY 1",
    "supersede_chain": "SELECT o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS successor, lead(o_orderkey) OVER w IS NULL AS active FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "active_page_sources": "SELECT l_partkey, count(DISTINCT l_orderkey) AS sources, min(l_orderkey) AS first FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') GROUP BY 1",
    "view_states": "SELECT o_orderkey AS path, CASE WHEN NOT want AND NOT last THEN 'unmanaged' WHEN NOT there THEN 'missing' WHEN NOT last OR o_custkey % 5 = 0 THEN 'conflict' WHEN NOT want OR o_custkey % 7 = 0 THEN 'outdated' ELSE 'ready' END AS state FROM (SELECT *, o_orderstatus <> 'F' AS want, o_custkey % 3 > 0 AS last, o_totalprice > 60000 AS there FROM orders) WHERE want OR last OR there",
    "covered_area": f"WITH {_BOXES}, y AS (SELECT DISTINCT l_orderkey, unnest(range(y0, y1)) AS y, x0, x1 FROM b), i AS (SELECT l_orderkey, y, x0, x1, max(x1) OVER (PARTITION BY l_orderkey, y ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM y) SELECT l_orderkey, CAST(sum(greatest(0, x1 - greatest(x0, coalesce(reach, x0)))) AS BIGINT) AS area FROM i GROUP BY 1",
    "row_mates": f"WITH {_BOXES} SELECT a.l_orderkey, a.box, count(*) FILTER (a.box <> o.box AND greatest(a.y1 - a.y0, o.y1 - o.y0) <= least(a.y1 - a.y0, o.y1 - o.y0) * 2.5 AND least(a.y1, o.y1) - greatest(a.y0, o.y0) >= least(a.y1 - a.y0, o.y1 - o.y0) * 0.6) AS mates FROM b a JOIN b o ON a.l_orderkey = o.l_orderkey GROUP BY 1, 2",
    "scenario_verdicts": "WITH f AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_tax = 0.03), g AS (SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'R') AS i, count(DISTINCT l_linenumber) FILTER (l_returnflag <> 'R') AS di, count(*) FILTER (l_returnflag = 'R') AS o, count(DISTINCT l_linenumber) FILTER (l_returnflag = 'R') AS d, coalesce(bool_or(l_quantity = 7) FILTER (l_returnflag <> 'R'), FALSE) AS bad, coalesce(bool_or(f.l_orderkey IS NOT NULL) FILTER (l_returnflag <> 'R'), FALSE) AS formula FROM lineitem LEFT JOIN f USING (l_orderkey, l_linenumber) GROUP BY 1) SELECT l_orderkey AS request, CASE WHEN i > 1000 OR o NOT BETWEEN 1 AND 200 THEN 'size' WHEN i > di OR o > d THEN 'duplicate' WHEN bad THEN 'literal' WHEN formula THEN 'formula' ELSE 'ok' END AS verdict FROM g",
    "receipt_verdicts": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, CASE WHEN l_quantity = 9 THEN 0 WHEN l_quantity = 11 THEN 1 ELSE 2 END) AS k FROM lineitem), g AS (SELECT l_orderkey, count(*) AS n, bool_or(l_orderkey % 5 <> 0 AND l_partkey % 29 = 0) AS other, bool_or(l_quantity = 9) AS none, bool_or(l_quantity = 11) AS wrong FROM r GROUP BY 1) SELECT l_orderkey, CASE WHEN l_orderkey % 5 = 0 AND n > 2 THEN 'count' WHEN other THEN 'identity' WHEN none THEN 'missing' WHEN wrong THEN 'error' ELSE 'ok' END AS verdict FROM g",
    "cache_use": "WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, lang FROM documents), c AS (SELECT DISTINCT t, lang FROM d JOIN labels USING (doc_id) WHERE quality = 1 AND coalesce(toxic, 0) <> 1) SELECT source, count(*) FILTER (c.t IS NOT NULL) AS hits, count(*) FILTER (c.t IS NULL) AS misses FROM d LEFT JOIN c ON d.t = c.t AND d.lang = c.lang GROUP BY 1",
    "import_estimate": "SELECT CAST(coalesce(sum(octet_length(encode(text))), 0) * 3 + 536870912 AS BIGINT) AS bytes FROM documents",
    "feedback_items": "SELECT o_custkey AS file, o_orderpriority AS reason, o_orderstatus = 'P' AND o_orderpriority < '3' AS can_adopt, count(*) AS n FROM orders WHERE o_orderstatus = 'P' OR (o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')) GROUP BY 1, 2, 3",
    "source_ids": "SELECT page_id, 'src-' || substr(sha256('file' || chr(0) || url || chr(0) || sha256(html)), 1, 20) AS source_id FROM pages",
    "candidate_counts": "SELECT lang, count(*) AS candidates, count(*) FILTER (r) AS relevant, count(*) FILTER (NOT r) AS excluded FROM (SELECT lang, coalesce(contains(lower(text), 'tion'), FALSE) OR source = 'web' AS r FROM documents) GROUP BY 1",
    "sheet_lines": "SELECT l_orderkey, string_agg('[' || CAST(l_orderkey AS VARCHAR) || '!' || CAST(l_linenumber AS VARCHAR) || '] ' || l_returnflag || CAST(l_partkey AS VARCHAR), chr(10) ORDER BY l_linenumber, l_partkey, l_returnflag) AS text FROM lineitem GROUP BY 1",
    "unique_selection": "WITH m AS (SELECT c_custkey AS target, count(s_suppkey) AS n, min(s_suppkey) AS product FROM customer LEFT JOIN supplier ON s_nationkey + s_suppkey % 4 * 6 = c_nationkey GROUP BY 1) SELECT target, CASE WHEN n = 1 THEN 'one' WHEN n > 1 THEN 'many' ELSE 'none' END AS state, CASE WHEN n = 1 THEN product END AS product FROM m",
    "plan_violations": "WITH n AS (SELECT l_orderkey AS graph, l_partkey % 30 AS title, l_suppkey AS source, CASE WHEN l_returnflag = 'R' THEN l_suppkey % 30 END AS related FROM lineitem), v AS (SELECT graph, array_to_string(list_filter([CASE WHEN bool_or(related IS NOT NULL AND NOT EXISTS (SELECT 1 FROM n o WHERE o.graph = n.graph AND o.title = n.related)) THEN 'related' END, CASE WHEN bool_or(related = title) THEN 'self' END, CASE WHEN count(*) NOT BETWEEN 3 AND 24 THEN 'size' END, CASE WHEN bool_or(source NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)) THEN 'source' END, CASE WHEN count(*) > count(DISTINCT title) THEN 'title' END], lambda x: x IS NOT NULL), ',') AS violations FROM n GROUP BY 1) SELECT * FROM v WHERE violations <> ''",
    "claim_plan": "WITH v AS (SELECT DISTINCT p_partkey, unnest([p_size, CAST(p_size + p_partkey % 3 AS INTEGER)]) AS version FROM part WHERE p_size > 4) SELECT l_orderkey * 10 + l_linenumber AS unit, l_partkey AS product, version FROM lineitem LEFT JOIN v ON l_partkey = p_partkey",
    "pending_spans": "SELECT l_orderkey, l_linenumber, l_partkey % 100 AS start FROM lineitem p WHERE l_returnflag <> 'R' AND NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_orderkey = p.l_orderkey AND r.l_returnflag = 'R' AND p.l_partkey % 100 BETWEEN r.l_partkey % 100 - 20 AND r.l_partkey % 100 + 30)",
    "batch_verdicts": "SELECT o_custkey, count(*) AS reviews, count(*) FILTER (NOT known) AS unconsumed, count(*) FILTER (NOT known) = 0 AS accepted FROM (SELECT o_custkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40) AS known FROM orders) GROUP BY 1",
    "segment_of": "WITH t AS (SELECT conv_id * 100 + turn AS key, coalesce(replace(text, '.', '。'), '') AS text, length(text) % 97 AS place FROM conversations), p AS (SELECT key, unnest(x) AS piece, generate_subscripts(x, 1) AS pos FROM (SELECT key, regexp_extract_all(text, '[^。！？!?；;\\n]+|[。！？!?；;\\n]+') AS x FROM t)), o AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM p), s AS (SELECT key, off, off + length(piece) AS stop FROM o WHERE NOT regexp_matches(piece, '^[。！？!?；;\\n]') AND trim(piece) <> '') SELECT t.key, CAST(place AS INTEGER) AS place, CAST(off AS BIGINT) AS start FROM t LEFT JOIN s ON t.key = s.key AND off <= place AND place < stop",
    "activation_counts": "SELECT user_id, count(*) FILTER (event_type <> 'error') AS valid, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS activations FROM events GROUP BY 1",
    "classification_overview": "SELECT source, count(*) FILTER (quality IS NULL AND toxic IS NULL) AS pending, count(*) FILTER (quality = 0 AND toxic = 0) AS ambiguous, count(*) AS documents FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
}
