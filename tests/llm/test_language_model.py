import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioscale.llm import common, elias_fano
from folioscale.llm import language_model as lm


@pytest.mark.parametrize("n, bound", [(0, 10), (1, 2**64), (5, 6), (1000, 2**64), (5000, 3000), (20000, 2**45)])
def test_sequences(n, bound):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, min(bound, 2**63), n, dtype=np.uint64))
    if n and bound == 2**64:
        values[-1] = 2**64 - 1
    sequence = elias_fano.Sequence(elias_fano.encode(values, bound))
    asked = np.concatenate([values, rng.integers(0, min(bound, 2**63), 500, dtype=np.uint64)])
    rank, found = sequence.successor(asked)
    if n:
        assert (sequence.get(np.arange(n)) == values).all() and (rank == np.searchsorted(values, asked)).all()
    assert (found == np.isin(asked, values)).all()
    if n == 20000:
        assert len(elias_fano.encode(values, bound)) < 5 * n


def words(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + ["\n"]


def brute(rows, order, min_count):
    """Exact probabilities, with shares rounded as the trie's bytes round them."""
    train = [words(t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    counts = [Counter() for _ in range(order + 1)]
    for tokens in train:
        counts[1].update((t,) for t in tokens)
        padded = ["\n", *tokens]
        for level in range(2, order + 1):
            counts[level].update(tuple(padded[i : i + level]) for i in range(len(padded) - level + 1))
    total, distinct = sum(counts[1].values()), len(counts[1])
    kept = [{g: n for g, n in c.items() if k < 2 or n >= min_count} for k, c in enumerate(counts)]
    mass = defaultdict(float)
    for level in range(2, order + 1):
        for g, n in kept[level].items():
            mass[g[:-1]] += n - lm.DISCOUNT
    step = lambda x: 10 ** (round(min(max(math.log10(max(x, 1e-30)), -8), 0) / -8 * 255) / 255 * -8)
    out = []
    for i, t in rows:
        tokens = words(t)
        base = full = 0.0
        known = 0
        padded = ["\n", *tokens]
        for at, w in enumerate(tokens):
            p = (counts[1][(w,)] + 0.5) / (total + 0.5 * (distinct + 1))
            base += math.log10(p)
            known += counts[1][(w,)] > 0
            for level in range(2, order + 1):
                if at >= level - 2:
                    context = tuple(padded[at + 2 - level : at + 1])
                    n = kept[level - 1].get(context)
                    backoff = step(1 - mass[context] / n) if n else 1.0
                    c = kept[level].get((*context, w))
                    p = (step((c - lm.DISCOUNT) / n) if c else 0.0) + backoff * p
            full += math.log10(p)
        out.append((i, zlib.crc32(str(i).encode()) % 5 == 1 if i is not None else False, len(tokens), known, total, round(base, 6), round(full, 3)))
    return out


def data():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünï", "THE", "the"]
    follow = {w: [rng.choice(vocabulary) for _ in range(4)] for w in vocabulary}
    rows = []
    for i in range(120):
        w, out = rng.choice(vocabulary), []
        for _ in range(rng.randint(1, 120)):
            out.append(w)
            w = rng.choice(follow.get(w, vocabulary)) if rng.random() < 0.85 else rng.choice([*vocabulary, f"new{rng.randrange(999)}"])
        rows.append((i, " \n".join(out)))
    return [*rows, (500, None), (501, ""), (501, ""), (None, "the the w1"), (7, "the the w1")]


@pytest.mark.parametrize("order, shard, chunk, min_count", [(2, 1 << 20, 1 << 21, 2), (2, 40, 300, 1), (3, 60, 250, 2), (1, 30, 100, 2)])
def test_scores_against_brute_force(spark, monkeypatch, order, shard, chunk, min_count):
    monkeypatch.setattr(lm, "SHARD", shard)
    monkeypatch.setattr(lm, "CHUNK", chunk)
    monkeypatch.setattr(lm, "LONG", 400)
    monkeypatch.setattr(common.word_blocks, "__defaults__", (90,))
    rows = data()
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, score int")
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 3)) for r in lm.language_model_scores(docs, order, min_count).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for a, b in zip(sorted(got, key=key), sorted(brute(rows, order, min_count), key=key), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-5 and abs(a[6] - b[6]) < 0.01 * max(1, a[2])


def test_held_out_texts_are_likelier_than_under_the_base(spark):
    docs = spark.createDataFrame(data(), "doc_id long, text string")
    held = [r for r in lm.language_model_scores(docs).collect() if r.held_out]
    assert len(held) > 10 and sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)


def test_no_training_text_and_no_rows(spark):
    only = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1]
    got = lm.language_model_scores(spark.createDataFrame([(i, "a b") for i in only], "doc_id long, text string")).collect()
    assert len(got) == len(only) and {(r.n_tokens, r.n_known, r.train_tokens) for r in got} == {(3, 0, 0)}
    assert lm.language_model_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
