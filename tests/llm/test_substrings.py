from collections import Counter

import numpy as np
import pytest

from folioscale.llm import fm_index, substrings


def occurrences(run, sequences, weights):
    return sum(w * sum(s[i : i + len(run)] == run for i in range(len(s) - len(run) + 1)) for s, w in zip(sequences, weights))


@pytest.mark.parametrize("seed", range(25))
def test_matching_statistics_equal_counting(seed):
    rng = np.random.default_rng(seed)
    top = int(rng.integers(1, 6))
    sequences = [rng.integers(1, top + 1, rng.integers(1, 30)).tolist() for _ in range(rng.integers(1, 8))]
    weights = rng.integers(1, 3, len(sequences))
    index = fm_index.FmIndex(np.concatenate([[*s, 0] for s in sequences]), weights, top + 2)
    asked = [*sequences, rng.integers(1, top + 2, 12).tolist()]
    for least in (1, 2, 3):
        got = index.matching_statistics(np.concatenate(asked), np.cumsum([*map(len, asked)]), least)
        want = [next(n for n in range(len(s) - i, -1, -1) if n == 0 or occurrences(s[i : i + n], sequences, weights) >= least) for s in asked for i in range(len(s))]
        assert got.tolist() == want
        inner = np.concatenate(sequences), np.cumsum([*map(len, sequences)])
        assert index.matching_statistics(*inner, least, indexed=True).tolist() == want[: len(inner[0])]


def test_rank_of_the_wavelet_tree():
    rng = np.random.default_rng(2)
    sequence = rng.zipf(1.4, 3000) % 60
    tree = fm_index.WaveletTree(sequence, 64)
    word, place = rng.integers(0, 64, 500), rng.integers(0, 3001, 500)
    assert tree.rank(word, place).tolist() == [int((sequence[:p] == w).sum()) for w, p in zip(word, place)]
    assert fm_index.WaveletTree(np.zeros(0, np.int64), 3).rank(np.array([1]), np.array([0])).tolist() == [0]


def brute_force(rows, window):
    words = [[w for w in (t or "").encode().split()] for _, t in rows]
    counts = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), own in zip(rows, words):
        gone = [False] * len(own)
        for i in range(len(own) - window + 1):
            if counts[tuple(own[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((doc, len(own), b" ".join(w for w, g in zip(own, gone) if not g).decode(), sum(gone)))
    return sorted(out, key=str)


def texts(rng):
    def some(n, top=300):
        return [f"w{i}" for i in rng.integers(0, top, n)]

    passage, frame = some(60), some(45)
    rows = [" ".join(some(20) + passage + some(30)) for _ in range(12)] + [" ".join(some(60)) for _ in range(20)]
    rows += ["a " * 90, "a b c " * 40, " ".join(passage), " ".join(passage[:34]), " ".join(passage[3:]), "\n".join(frame) + "\tend", " ".join(frame), None, "", " \x0b "]
    rows += [" ".join(some(400, 3)) for _ in range(6)] + ["Été " + "x" * 200 + " " + " ".join(some(50)) + " " + "x" * 200] * 3
    return [(None if i == 5 else i, t) for i, t in enumerate(rows)] + [(7, "twice " * 5), (7, rows[0]), (7, rows[0])]


@pytest.mark.parametrize("window, anchor, hot", [(35, 8, 8000), (35, 8, 2), (12, 3, 4), (5, 1, 8000)])
def test_removed_words_equal_brute_force(spark, window, anchor, hot):
    rows = texts(np.random.default_rng(window + hot))
    docs = spark.createDataFrame([(d, t, 1, b"x") for d, t in rows], "doc_id long, text string, n long, id binary").repartition(3)
    got = substrings.remove_repeats(docs, window, anchor, chunk_bytes=2000, shard_words=200, hot=hot).collect()
    assert sorted([(r.doc_id, r.n_words, r.kept, sum(b - a for a, b in r.spans)) for r in got], key=str) == brute_force(rows, window)


def test_the_query(spark):
    import hashlib

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = [(d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, k, g in brute_force([(r.doc_id, r.text) for r in docs], 35)]
    got = substrings.op11_fm_substrings(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_empty_table_and_limits(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.remove_repeats(empty).count() == 0
    with pytest.raises(ValueError):
        substrings.remove_repeats(empty, 5, 5)
