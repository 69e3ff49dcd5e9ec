import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from folioscale.llm import packing, token_ids


def least_changes(sizes, taken, capacity):
    """For each piece the gaps that make the sum smallest, when earlier pieces went to the taken gaps."""
    gaps, out = [], []
    for size, gap in zip(sizes, taken, strict=True):
        counts = Counter(g for g in gaps if g)

        def after(g):
            c = Counter(counts)
            if g < capacity:
                c[g] -= 1
            if g > size:
                c[g - size] += 1
            return sum(v * v for v in c.values())

        options = {g: after(g) for g in {*[g for g in gaps if g >= size and g], capacity}}
        out.append([g for g, x in options.items() if x == min(options.values())])
        if gap == capacity:
            gaps.append(capacity - size)
        else:
            gaps[gaps.index(gap)] = gap - size
    return out


@pytest.mark.parametrize("seed", range(4))
def test_each_piece_goes_where_the_sum_becomes_smallest(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 13, 300).tolist()
    packer = packing.SumOfSquares(12)
    places = [packer.put(s) for s in sizes]
    for gaps, (_, at, _) in zip(least_changes(sizes, [12 - at for _, at, _ in places], 12), places, strict=True):
        assert 12 - at in gaps
    filled = defaultdict(int)
    for size, (number, at, full) in zip(sizes, places, strict=True):
        assert filled[number] == at
        filled[number] += size
        assert filled[number] <= 12 and full == (filled[number] == 12)


def check(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity or len(own) == 1
    return len(by)


@pytest.mark.parametrize("pass_rows, slack", [(300, 1.05), (packing.PASS_ROWS, 1.04)])
def test_pack(spark, monkeypatch, pass_rows, slack):
    monkeypatch.setattr(packing, "PASS_ROWS", pass_rows)
    rng = np.random.default_rng(1)
    data = [(i, int(x), "o") for i, x in enumerate(rng.integers(1, 101, 4000))] + [(-1, 250, "o"), (-1, 250, "o"), (-2, 100, "o")]
    got = packing.pack(spark.createDataFrame([*data, (-3, None, "o"), (-4, 0, "o")], "k long, length long, offset string"), 100).collect()
    rest = [r for r in got if r.sequence_id is None]
    assert {r.k for r in rest} == {-3, -4} and len(got) == len(data) + 2
    n = check([r for r in got if r.sequence_id is not None], 100)
    least = -(-sum(x for _, x, _ in data if x <= 100) // 100) + 2
    assert n <= slack * least + 2
    assert packing.pack(spark.createDataFrame([], "k long, length long")).count() == 0


def test_lengths_like_those_of_documents_pack_tightly(spark):
    sizes = np.clip(np.random.default_rng(2).lognormal(6.4, 0.9, 4000), 1, 4096).astype(int).tolist()
    got = packing.pack(spark.createDataFrame([(x,) for x in sizes], "length long")).collect()
    assert check(got, 4096) <= 1.003 * -(-sum(sizes) // 4096) + 1


def test_documents(spark):
    texts = ["word " * 9000, "a b c", None, "", "Same text."] + [f"document number {i} " * (1 + i % 40) for i in range(300)]
    docs = spark.createDataFrame([(i % 200, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, piece int")
    pieces = packing.token_pieces(docs)
    placed = packing.pack(pieces)
    rows = placed.collect()
    tokenizer, want = Tokenizer.from_file(token_ids.default_tokenizer()), Counter()
    total = 0
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        for p, at in enumerate(range(0, len(ids), 4096)):
            own = ids[at : at + 4096]
            want[(i % 200, p, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in rows) == want
    assert check(rows, 4096) <= -(-total // 4096) + 1
    full = {r.sequence_id: r for r in packing.fill_sequences(placed).collect()}
    for r in rows:
        assert full[r.sequence_id].ids[4 * r.offset : 4 * (r.offset + r.length)] == r.ids
