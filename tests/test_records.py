"""Edge cases of the records and wording operators against small brute-force versions."""

import random

import pytest
from pyspark.sql import functions as F

from folioscale.operators import records, wording

HAN = "零一二三四五六七八九"


def han(n):
    """A number below 200 as it is written."""
    head, n = ("一百" + ("零" if 0 < n - 100 < 10 else ""), n - 100) if n >= 100 else ("", n)
    tens = "" if n < 10 else ("十" if n < 20 and not head else HAN[n // 10] + "十")
    return head + tens + (HAN[n % 10] if n % 10 or not (head or tens) else "")


def one(spark, column, *values):
    return spark.range(1).select(column(*[F.lit(v) for v in values]).alias("v")).first().v


def test_numerals_and_percentages(spark):
    rows = [(n, han(n)) for n in range(200) if not 100 < n < 110]
    got = {r.n: r.v for r in spark.createDataFrame(rows, "n int, t string").select("n", wording.numeral(F.col("t")).alias("v")).collect()}
    assert got == {n: n for n, _ in rows}
    texts = [("百分之八十", "80%"), ("不超过 百分之二十五。", "不超过25%。"), ("百分之多少", "百分之多少"), ("百分之", "百分之"), ("", ""), ("百分之12与百分之五", "12%与5%"), (None, None)]
    got = [r.v for r in spark.createDataFrame(texts, "t string, w string").select(wording.percent_text(F.col("t")).alias("v")).collect()]
    assert got == [w for _, w in texts]


def test_byte_suffix_keeps_whole_characters(spark):
    texts = ["", "abc", "贷款期限", "a贷é😀b", "😀" * 9, None]
    for limit in (1, 4, 5, 7):
        got = [r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").select(wording.byte_suffix(F.col("t"), limit).alias("s")).collect()]
        for text, found in zip(texts, got, strict=True):
            if text is None:
                assert found.text is None
                continue
            data = text.encode()
            start = max(0, len(data) - limit)
            while start < len(data) and data[start] & 0xC0 == 0x80:
                start += 1
            assert (found.text, found.start) == (data[start:].decode(), start)


def test_wording_edges(spark):
    assert one(spark, wording.path_is_valid, "a/b.md") and not one(spark, wording.path_is_valid, "")
    for bad in ("/a", "a/../b", ".a", "a/.b", "a//b", "a/", "c:a", "a\\b", "a\0b", "a/."):
        assert not one(spark, wording.path_is_valid, bad)
    notes = wording.NOTES_START + "\n mine \n" + wording.NOTES_END
    assert one(spark, wording.own_notes, notes) == " mine "
    assert one(spark, wording.own_notes, wording.NOTES_END + wording.NOTES_START) == ""
    assert one(spark, wording.own_notes, None) == ""
    text = "# head\n" + "x" * 5000 + "\n一、two\n" + "y" * 300
    found = one(spark, lambda t: wording.excerpt(t, 2000), text)
    assert len(found) <= 2000 and "[文内标题]\n# head\n一、two" in found and found.endswith("y" * 100)
    assert one(spark, lambda t: wording.excerpt(t, 2000), "short") == "short"
    assert one(spark, lambda t: wording.strongest_term(t, {"a": 1, "bb": 1}), "A bb") == ("bb", 2)
    assert one(spark, lambda t: wording.strongest_term(t, {"zz": 1}), "none") is None


def test_covered_area(spark):
    rng = random.Random(5)
    boxes = []
    for page in range(12):
        for _ in range(rng.randint(1, 7)):
            x, y = rng.randint(0, 12), rng.randint(0, 12)
            boxes.append((page, x, y, x + rng.randint(0, 6), y + rng.randint(0, 6)))
    want = {p: len({(x, y) for q, a, b, c, d in boxes if q == p for x in range(a, c) for y in range(b, d)}) for p in range(12)}
    got = {r.page: r.area for r in records.covered_area(spark.createDataFrame(boxes, "page int, x0 int, y0 int, x1 int, y1 int"), "page").collect()}
    assert {p: got.get(p, 0) for p in range(12)} == want


def test_targets_and_selection(spark):
    products = spark.createDataFrame([(1, "Gold Plan", ["G-1"], "2024"), (2, "Gold plan", None, "2025"), (3, None, ["silver"], "")], "product long, name string, aliases array<string>, year string")
    targets = spark.createDataFrame([(1, None, "GOLD-PLAN", "2024"), (2, None, "goldplan", None), (3, "3", "Silver", "1999"), (4, None, None, ""), (5, None, "?!", "")], "target long, id string, name string, year string")
    got = {(r.target, r.product) for r in records.match_targets(targets, products).collect()}
    assert got == {(1, 1), (2, 1), (2, 2), (3, 3)}
    states = {r.target: (r.state, r.product) for r in records.unique_matches(targets, products).collect()}
    assert states == {1: ("one", 1), 2: ("many", None), 3: ("one", 3), 4: ("none", None), 5: ("none", None)}
    assert records.match_targets(targets.limit(0), products).count() == 0


def test_targets_meet_each_product_once(spark, monkeypatch):
    """Several shared keys, rows of one target or product, and blocks of a hot key: as all pairs that are held against each other."""
    monkeypatch.setattr(records, "BLOCK", 4)
    rng = random.Random(11)
    years = ["", "2024", "2025", None]
    products = [(p, rng.choice(["Gold", "Silver plan", None]), rng.sample(["all", "A-1", "b 2", str(p)], rng.randrange(0, 4)), rng.choice(years)) for p in [*range(40), 3, 3, 7]]
    targets = [(t, rng.choice([None, "3", "a1", "ALL"]), rng.choice(["gold", "All", "silver-plan", "", "B2"]), rng.choice(years)) for t in [*range(60), 5, 5, 9]]
    plain = lambda x: "".join(c for c in (x or "").lower() if c.isalnum())
    want = {(t, p) for t, i, n, y in targets for p, m, a, z in products if ({plain(i), plain(n)} - {""}) & {plain(x) for x in (str(p), m, *a)} and (not y or not z or y == z)}
    got = records.match_targets(spark.createDataFrame(targets, "target long, id string, name string, year string"), spark.createDataFrame(products, "product long, name string, aliases array<string>, year string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    # No pair is moved: what is dealt out are blocks, and nothing is summed up or compared over pairs.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate inline") < plan.index("Exchange")


def test_prior_views_and_reviews(spark):
    candidates = spark.createDataFrame([(1, 10, None), (2, 20, "privacy"), (3, 30, "privacy"), (4, 40, "quality")], "k int, entry int, failure string")
    prior = spark.createDataFrame([(2, 2, "evidence", True), (3, 3, "inactive", True), (5, 5, "lead", True), (6, 6, "lead", False)], "k int, entry int, bucket string, usable boolean")
    got = {r.k: (r.entry, r.outcome) for r in records.preserve_prior(candidates, prior, "k").collect()}
    assert got == {1: (10, "taken"), 2: (2, "privacy_kept"), 3: (None, "pending"), 4: (None, "left_out"), 5: (5, "missing_kept"), 6: (None, "left_out")}
    files = lambda rows: spark.createDataFrame(rows, "path string, sha string")
    states = records.view_states(files([("a", "1"), ("b", "2"), ("c", "3"), ("e", "1")]), files([("a", "1"), ("b", "1"), ("c", "3"), ("d", "4")]), files([("a", "1"), ("b", "1"), ("c", "x"), ("d", "4"), ("f", "9")]))
    assert {r.path: r.state for r in states.collect()} == {"a": "ready", "b": "outdated", "c": "conflict", "d": "outdated", "e": "missing", "f": "unmanaged"}
    cases = [("text", 0, 4, "text", "relevant", "why", "ok"), ("text", 0, 5, "text", "relevant", "why", "span"), ("text", 1, 3, "eX", "relevant", "why", "quote"), (None, 0, 1, "a", "relevant", "why", "span"), ("text", None, 1, "t", "relevant", "why", "span"), ("text", 0, 4, None, "relevant", "why", "quote"), ("text", 0, 4, "text", None, "why", "relevance"), ("text", 0, 4, "text", "relevant", " ", "reason")]
    rows = spark.createDataFrame(cases, "t string, a int, b int, q string, v string, r string, want string")
    for r in rows.select("want", records.review_verdict(*[F.col(c) for c in "tabqvr"]).alias("got")).collect():
        assert r.got == r.want


@pytest.mark.parametrize("name", ["replacement_candidates", "covered_area", "row_mates", "view_states", "preserve_prior", "scenario_verdicts", "plan_violations", "pending_spans", "target_match"])
def test_no_nested_loop(spark, name):
    """The plans stay equi joins at any size."""
    plan = records.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
