import hashlib
import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from folioscale.llm import mixing, sharding


def bits(key, tie=None):
    path = hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:30]
    if tie is not None:
        path += hashlib.md5(tie.encode()).hexdigest()[:30]
    return bin(int(path, 16))[2:].zfill(4 * len(path))


def brute(rows, limit):
    """rows: (path bits, size). Splits a bucket on one more bit while it is too large."""
    out, todo = {}, [("", list(range(len(rows))))]
    while todo:
        prefix, own = todo.pop()
        size = sum(rows[i][1] for i in own)
        if size <= limit or len(prefix) == len(rows[own[0]][0]):
            out |= {i: (prefix, size, len(own)) for i in own}
        else:
            for bit in "01":
                part = [i for i in own if rows[i][0][len(prefix)] == bit]
                if part:
                    todo.append((prefix + bit, part))
    return out


def test_shards_against_brute_force(spark):
    data = [(i, i * 37 % 101, f"t{i}", "x") for i in range(3000)] + [(None, 50, "n", "x"), (5, None, "m", "x")]
    df = spark.createDataFrame(data, "doc_id long, size long, tie string, shard string")
    for limit in (10**9, 2000, 120):
        want = brute([(bits(k), s or 0) for k, s, _, _ in data], limit)
        got = sharding.assign_shards(df, limit).collect()
        assert Counter((r.doc_id, r["size"], r.shard, r.shard_bytes, r.shard_rows) for r in got) == Counter((data[i][0], data[i][1], *want[i]) for i in want)
        assert all(r.shard_bytes <= limit and len(r.shard) == r.shard_depth for r in got)


def test_hot_key_parts_on_the_tie(spark):
    data = [(1, 10, f"t{i}") for i in range(500)] + [(i, 10, "t") for i in range(500)]
    got = sharding.assign_shards(spark.createDataFrame(data, "doc_id long, size long, tie string"), 200, tie="tie").collect()
    want = brute([(bits(k, t), s) for k, s, t in data], 200)
    assert Counter((r.doc_id, r.tie, r.shard) for r in got) == Counter((data[i][0], data[i][2], want[i][0]) for i in want)
    assert max(r.shard_bytes for r in got) <= 200


def test_one_key_that_cannot_part_is_reported(spark):
    got = sharding.assign_shards(spark.createDataFrame([(1, 10)] * 30, "doc_id long, size long"), 100).collect()
    assert len(got) == 30 and {r.shard_bytes for r in got} == {300}


def test_empty(spark):
    assert sharding.assign_shards(spark.createDataFrame([], "doc_id long, size long"), 100).count() == 0
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_sources(empty).count() == 0 and mixing.schedule(empty).count() == 0


def docs(spark):
    rows = [(i, "w " * (1 + i % 9), "big", "x") for i in range(900)] + [(2000 + i, "w " * 5, "small", "x") for i in range(60)]
    rows += [(3000 + i, "w " * 4, None, "x") for i in range(100)] + [(4000, "", "none", "x"), (4001, None, "none", "x"), (7, "w w", "small", "x"), (7, "w w", "small", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, skey string"), rows


def test_mix_keeps_limits(spark):
    df, rows = docs(spark)
    tokens = defaultdict(int)
    for _, text, source, _ in rows:
        tokens[source] += len((text or "").split())
    got = mixing.mix_sources(df, repetition_limit=3.0)
    assert got.columns == df.columns
    out = defaultdict(int)
    for r in got.collect():
        out[r.source] += len((r.text or "").split())
    assert out["big"] == tokens["big"]
    high, low = max(v for v in tokens.values() if v), min(v for v in tokens.values() if v)
    a = 1 - math.log(3) / math.log(high / low)
    for s in ("small", None):
        want = tokens[s] * (tokens["big"] / tokens[s]) ** (1 - a)
        assert want - 1 <= out[s] <= want + 9
    ids = Counter(r.doc_id for r in got.collect())
    assert set(ids) == {r[0] for r in rows} and ids[4000] == ids[4001] == 1


def test_schedule_agrees_and_slots_hold_the_weights(spark):
    df, rows = docs(spark)
    got = mixing.schedule(df, repetition_limit=3.0).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in mixing.mix_sources(df, repetition_limit=3.0).collect())
    assert {r.slot for r in got} == {0}
    for source in ("big", "small"):
        for epoch in {r.epoch for r in got if r.source == source}:
            own = sorted((r for r in got if r.source == source and r.epoch == epoch), key=lambda r: (r.block_key, r.doc_key))
            assert len({r.block for r in own}) >= 1


def test_target_entropy(spark):
    df, _ = docs(spark)
    sources = df.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("tokens")).where("source <> 'none'")
    shares = [r.tokens for r in sources.collect()]
    total = sum(shares)

    def entropy(a):
        w = [(x / total) ** a for x in shares]
        return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)

    for target in (0.0, entropy(0.4), 5.0):
        a, _, _ = mixing.find_exponent(sources, target_entropy=target)
        assert (a == 1) if target == 0 else (a == 0) if target == 5 else abs(a - 0.4) < 1e-5


def test_budget_cuts_the_last_epoch(spark):
    df, rows = docs(spark)
    total = sum(len((r[1] or "").split()) for r in rows)
    got = mixing.mix_sources(df, repetition_limit=2.0, budget=total / 2).collect()
    assert abs(sum(len((r.text or "").split()) for r in got) - total / 2) <= 30
