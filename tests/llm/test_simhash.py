import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from folioscale.llm import common, simhash
from folioscale.llm.components import components, local_roots


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, near):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if near(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {x: find(x) for x in nodes}


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)] + [(7, 7), (None, 3), (50, 100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    links = {frozenset(p) for p in pairs if None not in p}
    nodes = {x for p in links for x in p}
    want = brute_components(sorted(nodes), lambda a, b: frozenset((a, b)) in links)
    assert got == {x: r for x, r in want.items() if x != r}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    a, b = np.array([5, 9, 1]), np.array([9, 2, 1])
    assert dict(zip(*map(list, local_roots(a, b)), strict=True)) == {5: 2, 9: 2}


@pytest.mark.parametrize("run", [4096, 40])
def test_links_against_brute_force(spark, run):
    rng = random.Random(5)
    centers = [rng.getrandbits(64) for _ in range(30)]
    prints = {0, 2**64 - 1, *centers}
    for c in centers:
        x = c
        for _ in range(12):
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    hub = rng.getrandbits(64)
    prints |= {hub ^ 1 << i for i in range(64)} | {hub ^ 1 << i ^ 1 << (i * 7 % 64) for i in range(64)}
    want = brute_components(sorted(map(signed, prints)), lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 4)
    links = simhash.fingerprint_links(spark.createDataFrame([(signed(x),) for x in prints], "fp long"), run=run)
    roots = {r.node: r.root for r in components(links).collect()}
    assert {x: roots.get(x, x) for x in map(signed, prints)} == want


def test_long_text_equals_short_path(monkeypatch):
    text = " ".join(f"Wörd{i % 300}" for i in range(5000)).encode()
    monkeypatch.setattr(common.word_blocks, "__defaults__", (700,))
    assert simhash.fingerprint_of(text) == brute_print(text.decode()) == int(simhash.fingerprints([text])[0])


def test_documents(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " \t ", "one", "ONE", "two words", "\x1c x"]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(5, 300))]
        texts.append(" ".join(base))
        for _ in range(3):
            base[rng.randrange(len(base))] = rng.choice(words)
            texts.append("  ".join(base).upper() if rng.random() < 0.3 else " ".join(base))
    rows = [(1000 - i, t, 1) for i, t in enumerate(texts)] + [(1000, None, 2), (5000, texts[8], 3), (None, texts[8], 4), (None, "lonely null id text here", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = simhash.near_duplicates(docs).collect()
    prints = {brute_print(t) for _, t, _ in rows}
    roots = brute_components(sorted(prints), lambda a, b: bin(a ^ b).count("1") <= 4)
    least = {}
    for i, t, _ in rows:
        if i is not None:
            r = roots[brute_print(t)]
            least[r] = min(least.get(r, i), i)
    want = Counter((i, f"{brute_print(t):016x}", least.get(roots[brute_print(t)])) for i, t, _ in rows)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([*least.values(), None])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 == simhash.drop_near_duplicates(docs.limit(0)).count()
