import numpy as np
import pytest

from folioscale.llm import embeddings


def clustered(n, d, seed, groups=40):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, d))
    own = centers[rng.integers(0, groups, n)] + rng.normal(size=(n, d)) * rng.choice([0.05, 0.2, 0.35, 1.5], (n, 1))
    return own / np.linalg.norm(own, axis=1, keepdims=True)


def test_graph_search_finds_what_lies_in_the_range():
    x = clustered(1500, 24, 1)
    lists, medoid = embeddings.build_graph(x)
    q, r = embeddings.range_search(x, lists, medoid, 0.9)
    truth = x @ x.T >= 0.9
    np.fill_diagonal(truth, False)
    assert truth[q, r].all() and len(q) >= 0.97 * truth.sum()


@pytest.mark.parametrize("n", [1, 2, 3, 30])
def test_small_graphs(n):
    x = clustered(n, 5, n)
    lists, medoid = embeddings.build_graph(x)
    q, r = embeddings.range_search(x, lists, medoid, 0.9)
    truth = x @ x.T >= 0.9
    np.fill_diagonal(truth, False)
    assert truth[q, r].all() and len(q) == truth.sum()


def test_robust_prune_rule():
    x = clustered(200, 8, 3)
    near = x @ x.T
    np.fill_diagonal(near, -2)
    pool = np.argsort(-near, axis=1)[:, :30]
    got = embeddings.robust_prune(x, pool, 6, 1.2)
    gap = lambda a, b: np.sqrt(max(0.0, 2 - 2 * x[a] @ x[b]))
    for i in range(200):
        left, want = list(pool[i]), []
        while left and len(want) < 6:
            p = left.pop(0)
            want.append(p)
            left = [c for c in left if 1.2 * gap(p, c) > gap(i, c)]
        assert [v for v in got[i] if v >= 0] == want


def brute(rows):
    units = embeddings.unit_vectors([v for _, v in rows])
    ids = [i for i, _ in rows]
    links = {i: set() for i in ids}
    for a in range(len(rows)):
        for b in range(a):
            if units[a] is not None and units[b] is not None and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.9:
                links[ids[a]].add(ids[b])
                links[ids[b]].add(ids[a])
    root = {}
    for i in sorted(ids):
        todo = [i] if i not in root else []
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = i
                todo += links[x]
    return {i: (len(links[i]), root[i]) for i in ids}


def test_against_brute_force(spark, monkeypatch):
    for name, value in (("CELL", 100), ("CELL_MOST", 150), ("SAMPLE", 1000)):
        monkeypatch.setattr(embeddings, name, value)
    x = clustered(900, 16, 5)
    rows = [(int(i * 3 % 2003), [float(c) for c in np.float32(v)]) for i, v in enumerate(x)]
    rows += [(5000 + i, rows[10][1]) for i in range(120)]
    rows += [(6000, None), (6001, []), (6002, [0.0] * 16), (6003, [float("nan")] + [1.0] * 15), (6004, [float("inf")] * 16), (6005, [None] + [1.0] * 15), (6006, [1.0, 0.0]), (6007, [2.0, 0.0]), (6008, [2 * c for c in rows[20][1]]), (6009, [1e300] * 16), (6010, [1e-300] * 16)]
    table = spark.createDataFrame([(*r, 1) for r in [*rows, rows[0], (None, [1.0] * 16)]], "vec_id long, embedding array<double>, n_links int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicate_vectors(table).collect()}
    assert got.pop(None) == (0, None)
    want = brute(rows)
    assert got.keys() == want.keys()
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(g for g, _ in got.values()) >= 0.97 * sum(w for w, _ in want.values())
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)
    assert all(got[i] == want[i] for i in range(6000, 6011))


def test_empty(spark):
    assert embeddings.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def all_links(x):
    truth = x @ x.T >= 0.9
    a, b = np.nonzero(np.triu(truth, 1))
    return set(zip(a.tolist(), b.tolist(), strict=True))


def classes_of(spark, x):
    return spark.createDataFrame([(i, bytearray(v.astype("<f8").tobytes())) for i, v in enumerate(x)], "rep long, unit binary")


def near_copies(n, d, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=d) * 3 / np.sqrt(d) + rng.normal(size=(n, d)) * 0.3 / np.sqrt(d)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_dense_group_beyond_a_cell_keeps_all_links(spark, monkeypatch):
    for name, value in (("CELL", 40), ("CELL_MOST", 100), ("SAMPLE", 2000)):
        monkeypatch.setattr(embeddings, name, value)
    x = np.concatenate([near_copies(700, 16, 7), clustered(300, 16, 8)])
    truth = all_links(x)
    assert len(truth) >= 700 * 699 // 2
    got = {(r.a, r.b) for r in embeddings.cell_links(classes_of(spark, x), 0.9, 0).collect()}
    assert got <= truth and len(got) >= 0.97 * len(truth)


def test_low_recall_is_never_returned(spark, monkeypatch):
    x = clustered(400, 16, 9)
    monkeypatch.setattr(embeddings, "CELL_MOST", 100)
    monkeypatch.setattr(embeddings, "cell_links", lambda classes, threshold, seed: spark.createDataFrame([], "a long, b long"))
    links, recall = embeddings.link_classes(classes_of(spark, x))
    assert recall == 1.0 and {(r.a, r.b) for r in links.collect()} == all_links(x)


def test_audit_draws_on_until_it_holds_links(spark, monkeypatch):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(500, 32))
    x[498] = x[499] + 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    monkeypatch.setattr(embeddings, "AUDIT", 4)
    assert [(r.a, r.b) for r in embeddings.audit_links(classes_of(spark, x), 0.9).collect()] == [(498, 499)]


def test_links_across_cells_are_reached_along_the_united_graph(spark, monkeypatch):
    # A chain: 0-1 and 1-2 share a cell, 0 and 2 none; they are linked all the same.
    angle = np.array([0.0, 0.2, 0.4, 2.0])
    x = np.stack([np.cos(angle), np.sin(angle)], 1)
    members = spark.createDataFrame([("p", 0), ("p", 1), ("q", 1), ("q", 2), ("q", 3)], "cell string, rep long")
    united = spark.createDataFrame([(0, [1]), (1, [0, 2]), (2, [1, 3]), (3, [2])], "rep long, near array<long>")
    found = spark.createDataFrame([("p", 0, 1, float(x[0] @ x[1])), ("q", 1, 2, float(x[1] @ x[2]))], "cell string, a long, b long, near double")
    got = embeddings.expand(found, united, members, classes_of(spark, x), 0.9).collect()
    assert sorted((r.a, r.b) for r in got) == [(0, 1), (0, 2), (1, 2)]


def test_cells_without_overlap_lose_few_links(spark, monkeypatch):
    for name, value in (("CELL", 60), ("CELL_MOST", 100), ("SAMPLE", 2000)):
        monkeypatch.setattr(embeddings, name, value)
    rng = np.random.default_rng(11)
    x = np.cumsum(rng.normal(size=(600, 12)) * 0.12, axis=0) + 1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    truth = all_links(x)
    got = {(r.a, r.b) for r in embeddings.cell_links(classes_of(spark, x), 0.9, 0).collect()}
    assert got <= truth and len(got) >= 0.99 * len(truth)
