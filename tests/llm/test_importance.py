import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from folioscale.llm import importance, interning


@pytest.mark.parametrize("top", [5, 20, 200])
def test_hashes_and_slots(top):
    rng = np.random.default_rng(top)
    data = rng.integers(97, 99 if top < 20 else 123, 5000).astype(np.uint8)
    sizes = rng.integers(0, top, 4000)
    starts = rng.integers(0, 5000 - top, 4000)
    raw = [data[i : i + n].tobytes() for i, n in zip(starts, sizes)]
    table = interning.SlotTable(data, starts, sizes)
    assert table.hashes.tolist() == [xxhash.xxh64_intdigest(x) for x in raw]
    assert [raw[table.owner[s]] for s in table.slot] == raw
    assert len(table.owner) == len(set(raw)) and table.count.sum() == 4000


def test_equal_hashes_are_told_apart_by_their_bytes(monkeypatch):
    monkeypatch.setattr(interning, "xxh64", lambda data, starts, sizes, lanes: np.zeros(len(starts), np.uint64))
    data = np.frombuffer(b"abcabd" + b"x" * 40 + b"y" + b"x" * 40 + b"z", np.uint8)
    table = interning.SlotTable(data, np.array([0, 3, 0, 6, 47, 6]), np.array([3, 3, 3, 41, 41, 41]))
    assert len(set(table.slot.tolist())) == 4 and table.slot[0] == table.slot[2] and table.slot[3] == table.slot[5]


def brute_force(docs, target, percent=10, min_words=20, longest=1, n_buckets=10000):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    def buckets(text):
        own = words(text)
        return [zlib.crc32(" ".join(own[i : i + n]).encode()) % n_buckets for n in range(1, longest + 1) for i in range(len(own) - n + 1)]

    s, t = (Counter(b for x in texts for b in buckets(x)) for texts in ([x for _, x in docs], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for doc, text in docs:
        own = buckets(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (s_all + n_buckets) / ((s[b] + 1) * (t_all + n_buckets)))) for b in own)
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted([r for r in out if r[5] >= min_words], key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted([tuple(r[:5]) for r in out], key=str)


@pytest.mark.parametrize("longest, n_buckets", [(1, 10000), (3, 50)])
def test_resample_equals_brute_force(spark, longest, n_buckets):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs += [(None, None), (901, ""), (902, "İ ÀB\x00c z9 " * 30), (903, "  "), (902, "x y " * 4000), (5, "a-b_c " * 8), (5, "a-b_c " * 8)]
    target = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()] + [None]
    rows = spark.createDataFrame([(d, x, 1, "y") for d, x in docs], "doc_id long, text string, rank long, bucket string").repartition(5)
    got = importance.resample(rows, spark.createDataFrame([(x,) for x in target], "text string"), percent=37, longest=longest, n_buckets=n_buckets)
    assert sorted(map(tuple, got.collect()), key=str) == brute_force(docs, target, 37, 20, longest, n_buckets)


def test_the_query(spark):
    got = importance.op12_importance_resampling(spark, "/root/testdata/sf0.001")
    docs, target = (spark.read.parquet(f"/root/testdata/sf0.001/{x}.parquet") for x in ("documents", "benchmark"))
    want = brute_force([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert got.dtypes == [(x, "bigint") for x in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(empty, empty).count() == 0
    one = importance.resample(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), empty, percent=100, min_words=1).collect()
    assert [(r.doc_id, r.n_features, r.rank) for r in one] == [(1, 2, 1)]


def test_features_of_a_batch_without_words():
    found = importance.Features(pa.array([None, "", " .,-"]), 2, 10)
    assert found.n_words.tolist() == [0, 0, 0] and found.bucket_counts(10).sum() == 0
