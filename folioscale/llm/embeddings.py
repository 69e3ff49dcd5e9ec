"""Operator 3: near-duplicate embeddings through a robust-pruned flat graph.

Equal vectors are one class. Classes are dealt to overlapping cells around spherical k-means centers, fitted on a
bounded sample; cells that stay too large are split again. Centers within the range of each other are one, so a dense
group stays in one cell; a cell that stays too large all the same is compared exactly, as pairs of blocks. In each cell a graph is built by robust pruning; a node's
adjacency lists from all its cells are united. In each cell every node is then a query: a greedy search from the
cell's medoid finds its neighbourhood, and a range expansion follows the graph as long as it meets vectors within the
range. Beyond the cells, found pairs are followed along the united lists until no new pair appears. Pairs are verified
by their cosine in double precision. A sample of queries against all vectors audits the
recall and grows until it holds true links; while the recall is too low, cells around other centers add their pairs.
Where that does not suffice, or no sample holds a link, all vectors are compared as pairs of blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscale.llm import common
from folioscale.llm.components import components

THRESHOLD = 0.9
#: Members that a cell aims at and the most it may have before it is split again.
CELL, CELL_MOST = 800, 4000
#: Cells that each vector belongs to.
OVERLAP = 2
#: Vectors that the centers are fitted on, at most; the centers are at most an eighth of them.
SAMPLE = 32_768
SPLITS = 6
DEGREE, POOL, BEAM, ALPHA = 24, 48, 32, 1.2
#: How far below the range the expansion still follows the graph.
SLACK = 0.1
#: Queries of the first audit and of the last one, and the true links that an audit has to hold.
AUDIT, AUDIT_MOST, AUDIT_LINKS = 256, 16_384, 100
RECALL, ROUNDS = 0.97, 3


def unit_vectors(values: list[list[float] | None]) -> list[np.ndarray | None]:
    """Vectors of length one in double precision; None for a null, empty or zero vector or one with a component that is null or not finite."""
    out: list[np.ndarray | None] = []
    for value in values:
        vector = None
        if value and None not in value:
            own = np.asarray(value, np.float64) + 0.0
            most = np.abs(own).max()
            if np.isfinite(most) and most > 0:
                own = own / most
                vector = own / np.sqrt((own * own).sum())
        out.append(vector)
    return out


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column(1).to_pylist()
        units = unit_vectors(values)
        data = [None if u is None else u.astype("<f8").tobytes() for u in units]
        raw = [None if u is None else hashlib.md5((np.asarray(v, "<f8") + 0.0).tobytes()).digest() for u, v in zip(units, values, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array(data, pa.binary())], names=["vec_id", "key", "unit"])


def _matrix(column) -> np.ndarray:
    return np.stack([np.frombuffer(x, "<f8") for x in column])


def fit_centers(x: np.ndarray, k: int, seed: int, steps: int = 8) -> np.ndarray:
    """Spherical k-means from chosen rows."""
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(steps):
        label = np.concatenate([(x[i : i + 2048] @ centers.T).argmax(1) for i in range(0, len(x), 2048)])
        order = np.argsort(label, kind="stable")
        own, first = np.unique(label[order], return_index=True)
        sums = np.add.reduceat(x[order], first, axis=0)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = centers.copy()
        centers[own] = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centers[own])
    return centers


def merge_centers(centers: np.ndarray, threshold: float) -> np.ndarray:
    """Centers without those in the range of an earlier one."""
    unit = centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-9)
    left = np.ones(len(unit), bool)
    for i in range(len(unit)):
        if left[i]:
            near = left & (unit @ unit[i] >= threshold)
            near[: i + 1] = False
            left &= ~near
    return centers[left]


def _deal(centers: dict[str, np.ndarray], overlap: int, threshold: float):
    """Sends rows (cell, rep, unit) of the cells that have centers to their nearest ones, as cells of their own.

    What is farther than the range from every border of its cell can have no link across it and goes to no other cell.
    """
    angle = np.sqrt(1 - threshold**2) if threshold > 0 else 2.0

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.array(batch.column("cell").to_pylist(), object)
            for cell in {*cells}:
                at = np.flatnonzero(cells == cell)
                part = batch.take(pa.array(at))
                own = centers[cell]
                near = _matrix(part.column("unit").to_pylist()) @ own.T
                most = min(overlap, near.shape[1])
                best = np.argpartition(-near, most - 1, axis=1)[:, :most]
                first = near.argmax(1)
                between = np.sqrt(np.maximum(2 - 2 * own[first] @ own.T, 1e-18))
                border = (near[np.arange(len(at)), first][:, None] - near) / between
                border[np.arange(len(at)), first] = 2.0
                only = (border >= angle).all(1)
                row, k = np.nonzero(~only[:, None] | (best == first[:, None]))
                names = pa.array([f"{cell}.{c}" for c in best[row, k]])
                moved = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([names, moved.column("rep"), moved.column("unit")], names=["cell", "rep", "unit"])

    return deal


_MEMBER = "cell string, rep long, unit binary"


def deal_cells(classes: DataFrame, seed: int, threshold: float = THRESHOLD) -> DataFrame:
    """cell, rep, unit: each class in the cells of its OVERLAP nearest centers. Cells that cannot be split stay large."""
    spark = classes.sparkSession
    members = classes.select(F.lit("c").alias("cell"), "rep", "unit")
    sizes = {"c": classes.count()}
    done: list[DataFrame] = []
    for level in range(SPLITS):
        large = {c: n for c, n in sizes.items() if n > CELL_MOST}
        if not large:
            break
        total = sum(large.values())
        share = min(1.0, SAMPLE / total)
        held = members.where(F.col("cell").isin([*large])) if level else members
        picked = held.where(F.pmod(F.xxhash64("rep", F.lit(seed + level)), F.lit(1 << 30)) < int(share * (1 << 30))).select("cell", "unit").toPandas()  # about SAMPLE rows
        centers = {}
        for cell, own in picked.groupby("cell"):
            k = int(min(max(2 * OVERLAP, -(-large[cell] * OVERLAP // CELL) if not level else -(-large[cell] // CELL)), max(2 * OVERLAP, len(own) // 8)))
            apart = merge_centers(fit_centers(_matrix(own["unit"]), k, seed + level), threshold)
            if len(apart) > 1:
                centers[cell] = apart
        ready = [c for c in large if c in centers]
        if not ready:
            break
        moved = common.cut(common.map_arrow(members.where(F.col("cell").isin(ready)), _deal(centers, OVERLAP, threshold), _MEMBER, rows=1024), "cells")
        done.append(members.where(~F.col("cell").isin(ready)))
        members = moved
        sizes = {r.cell: r.n for r in moved.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row for each of the cells
    for more in done:
        members = members.unionByName(more)
    return members


def robust_prune(x: np.ndarray, pool: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each row of pool (ids by falling nearness, -1 at the end) the pruned neighbours, -1 at the end.

    The nearest one left is taken; it strikes out all that are alpha times nearer to it than to the node.
    """
    out = np.full((len(pool), degree), -1, np.int64)
    for low in range(0, len(pool), 512):
        own = pool[low : low + 512]
        rows = np.arange(len(own))
        there = x[np.maximum(own, 0)]
        far = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nd,ncd->nc", x[low : low + 512], there)))
        alive = own >= 0
        for k in range(degree):
            any_left = alive.any(1)
            if not any_left.any():
                break
            first = alive.argmax(1)
            out[low : low + 512][any_left, k] = own[rows, first][any_left]
            between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nd,ncd->nc", there[rows, first], there)))
            alive &= alpha * between > far
            alive[rows, first] = False
    return out


def build_graph(x: np.ndarray, seed: int = 0) -> tuple[list[np.ndarray], int]:
    """Neighbours of each row and the medoid; every row can be reached from the medoid."""
    n = len(x)
    medoid = int((x @ x.mean(0)).argmax())
    if n == 1:
        return [np.zeros(0, np.int64)], medoid
    rng = np.random.default_rng(seed)
    count = min(POOL, n - 1)
    pool = np.full((n, count + 16), -1, np.int64)
    for low in range(0, n, 512):
        near = x[low : low + 512] @ x.T
        near[np.arange(len(near)), np.arange(low, low + len(near))] = -2
        best = np.argpartition(-near, count - 1, axis=1)[:, :count]
        far = rng.integers(0, n, (len(near), 16))
        both = np.concatenate([best, far], 1)
        both[both == np.arange(low, low + len(near))[:, None]] = best[0, 0] if n > 1 else 0
        value = np.take_along_axis(near, both, 1)
        order = np.argsort(-value, axis=1, kind="stable")
        pool[low : low + 512] = np.take_along_axis(both, order, 1)
    pool = np.where(pool == np.arange(n)[:, None], -1, pool)
    kept = robust_prune(x, pool, DEGREE, ALPHA)
    # A few plainly nearest ones stay besides, so that dense groups hang together.
    pairs = np.concatenate([np.stack([np.repeat(np.arange(n), kept.shape[1]), kept.ravel()], 1), np.stack([np.repeat(np.arange(n), 8), pool[:, :8].ravel()], 1)])
    pairs = pairs[pairs[:, 1] >= 0]
    pairs = np.unique(np.concatenate([pairs, pairs[:, ::-1]]), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    lists = np.split(pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(1, n)))
    reached = np.zeros(n, bool)
    reached[medoid] = True
    front = np.array([medoid])
    while True:
        while len(front):
            front = np.unique(np.concatenate([lists[i] for i in front]))
            front = front[~reached[front]]
            reached[front] = True
        left = np.flatnonzero(~reached)
        if not len(left):
            return lists, medoid
        known = np.flatnonzero(reached)
        near = x[left[:256]] @ x[known].T
        at = int(near.max(1).argmax())
        parent = known[near[at].argmax()]
        lists[parent] = np.append(lists[parent], left[at])
        lists[left[at]] = np.append(lists[left[at]], parent)
        reached[left[at]] = True
        front = left[at : at + 1]


def range_search(x: np.ndarray, lists: list[np.ndarray], medoid: int, radius: float, slack: float = SLACK, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) of rows found within the radius of each row by greedy search and range expansion."""
    n = len(x)
    width = max(1, max(map(len, lists)))
    table = np.full((n, width), -1, np.int64)
    for i, own in enumerate(lists):
        table[i, : len(own)] = own
    out_q, out_r = [], []
    for low in range(0, n, 256):
        q = x[low : low + 256]
        size = len(q)
        rows = np.arange(size)
        seen = np.zeros((size, n), bool)
        seen[:, medoid] = True
        ids = np.full((size, beam), -1, np.int64)
        near = np.full((size, beam), -2.0)
        spent = np.ones((size, beam), bool)
        ids[:, 0], near[:, 0], spent[:, 0] = medoid, q @ x[medoid], False
        value = np.full((size, n), -2.0)
        value[:, medoid] = near[:, 0]
        while True:
            rank = np.where(spent, -3.0, near)
            best = rank.argmax(1)
            busy = rows[rank[rows, best] > -3.0]
            if not len(busy):
                break
            spent[busy, best[busy]] = True
            fresh = table[ids[busy, best[busy]]]
            good = (fresh >= 0) & ~seen[busy[:, None], np.maximum(fresh, 0)]
            at, k = np.nonzero(good)
            who, node = busy[at], fresh[at, k]
            seen[who, node] = True
            score = np.einsum("nd,nd->n", q[who], x[node])
            value[who, node] = score
            new_near = np.full(fresh.shape, -2.0)
            new_near[at, k] = score
            all_ids = np.concatenate([ids[busy], np.where(good, fresh, -1)], 1)
            all_near = np.concatenate([near[busy], new_near], 1)
            all_spent = np.concatenate([spent[busy], ~good], 1)
            top = np.argpartition(-all_near, beam - 1, axis=1)[:, :beam]
            ids[busy], near[busy], spent[busy] = (np.take_along_axis(a, top, 1) for a in (all_ids, all_near, all_spent))
        # From all that lies in the range and a little beyond, on along the graph.
        who, node = np.nonzero(value >= radius - slack)
        while len(who):
            next_who, next_node = [], []
            for part in range(0, len(who), 65536):
                w, fresh = who[part : part + 65536], table[node[part : part + 65536]]
                good = (fresh >= 0) & ~seen[w[:, None], np.maximum(fresh, 0)]
                at, k = np.nonzero(good)
                code = np.unique(w[at] * n + fresh[at, k])
                ww, nn = code // n, code % n
                seen[ww, nn] = True
                score = np.einsum("nd,nd->n", q[ww], x[nn])
                value[ww, nn] = score
                on = score >= radius - slack
                next_who.append(ww[on])
                next_node.append(nn[on])
            who, node = np.concatenate(next_who), np.concatenate(next_node)
        who, node = np.nonzero(value >= radius)
        out_q.append(who + low)
        out_r.append(node)
    q, r = np.concatenate(out_q), np.concatenate(out_r)
    return q[q != r], r[q != r]


def _local(rep: np.ndarray, neighbours: list) -> list[np.ndarray]:
    """Adjacency by place in a cell; neighbours that are not in it are left out."""
    order = np.argsort(rep)
    flat = np.concatenate([np.asarray(x, np.int64) for x in neighbours]) if len(neighbours) else np.zeros(0, np.int64)
    sizes = [len(x) for x in neighbours]
    at = np.minimum(np.searchsorted(rep[order], flat), len(rep) - 1)
    inside = rep[order][at] == flat
    owner = np.repeat(np.arange(len(rep)), sizes)
    return np.split(order[at][inside], np.searchsorted(owner[inside], np.arange(1, len(rep))))


def block_links(members: DataFrame, threshold: float) -> DataFrame:
    """cell, a, b, near (their cosine): all links, a < b, inside each cell of members, found by comparing its blocks pair by pair."""
    size = max(1, CELL_MOST // 2)
    blocks = members.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    dealt = members.join(F.broadcast(blocks), "cell").withColumn("own", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("blocks")).cast("int"))  # blocks: a row for each large cell
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "rep", "unit")

    def compare(table: pa.Table) -> pa.Table:
        rep, own = table.column("rep").to_numpy(), table.column("own").to_numpy()
        x = _matrix(table.column("unit").to_pylist())
        left = np.flatnonzero(own == table.column("low")[0].as_py())
        right = np.flatnonzero(own == table.column("high")[0].as_py())
        out_a, out_b, out_near = [rep[:0]], [rep[:0]], [np.zeros(0)]
        for at in range(0, len(left), 512):
            value = x[left[at : at + 512]] @ x[right].T
            i, j = np.nonzero(value >= threshold)
            a, b = rep[left[at + i]], rep[right[j]]
            once = a < b if len(right) and left[0] == right[0] else np.ones(len(a), bool)
            out_a.append(np.minimum(a, b)[once])
            out_b.append(np.maximum(a, b)[once])
            out_near.append(value[i, j][once])
        a = np.concatenate(out_a)
        return pa.table({"cell": pa.array([table.column("cell")[0].as_py()] * len(a), pa.string()), "a": a, "b": np.concatenate(out_b), "near": np.concatenate(out_near)})

    return dealt.groupBy("cell", "low", "high").applyInArrow(compare, "cell string, a long, b long, near double")


def cell_links(classes: DataFrame, threshold: float, seed: int) -> DataFrame:
    """a, b: verified links between classes, a < b, through the graph over the cells of one seed."""
    everyone = common.cut(deal_cells(classes, seed, threshold), "members")
    sizes = everyone.groupBy("cell").agg(F.count("*").alias("n"))
    large = [r.cell for r in sizes.where(F.col("n") > CELL_MOST).collect()]
    members = everyone.where(~F.col("cell").isin(large)) if large else everyone

    def graph(table: pa.Table) -> pa.Table:
        rep = table.column("rep").to_numpy()
        lists, _ = build_graph(_matrix(table.column("unit").to_pylist()), seed)
        return pa.table({"rep": rep, "near": pa.array([rep[x] for x in lists], pa.list_(pa.int64()))})

    def search(table: pa.Table) -> pa.Table:
        rep, x = table.column("rep").to_numpy(), _matrix(table.column("unit").to_pylist())
        lists = _local(rep, table.column("near").to_pylist())
        medoid = int((x @ x.mean(0)).argmax())
        q, r = range_search(x, lists, medoid, threshold - SLACK, 0.0)
        low, high = np.where(rep[q] < rep[r], q, r), np.where(rep[q] < rep[r], r, q)
        if len(low):
            low, high = np.unique(np.stack([low, high], 1), axis=0).T
        near = np.concatenate([np.zeros(0), *(np.einsum("nd,nd->n", x[low[i : i + 65536]], x[high[i : i + 65536]]) for i in range(0, len(low), 65536))])
        return pa.table({"cell": pa.array([table.column("cell")[0].as_py()] * len(low), pa.string()), "a": rep[low], "b": rep[high], "near": near})

    edges = members.groupBy("cell").applyInArrow(graph, "rep long, near array<long>")
    united = edges.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # a few lists of bounded length
    found = members.join(united, "rep").groupBy("cell").applyInArrow(search, "cell string, a long, b long, near double")
    found = common.cut(found, "found")
    if large:
        inside = everyone.where(F.col("cell").isin(large))
        found = common.cut(found.unionByName(block_links(inside, threshold - SLACK)), "found")
        # A dense cell's graph is that of its blocks: enough to lead into and out of it.
        size = max(1, CELL_MOST // 2)
        n = sizes.where(F.col("cell").isin(large)).select("cell", F.ceil(F.col("n") / size).alias("blocks"))
        blocks = inside.join(F.broadcast(n), "cell").withColumn("cell", F.concat_ws("/", "cell", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("blocks"))))  # n: a row for each large cell
        more = blocks.groupBy("cell").applyInArrow(graph, "rep long, near array<long>")
        united = united.union(more).groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # a few lists of bounded length
    if sizes.count() > 1:
        found = expand(found, common.cut(united, "graph"), everyone, classes, threshold)
    return common.cut(found.where(F.col("near") >= threshold).select("a", "b").distinct(), "pairs")


def expand(found: DataFrame, united: DataFrame, members: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """found and the pairs that are reached from it: from a pair (q, r) along the united list of r to all that have no cell with q.

    found: cell, a, b, near (cosine, not under threshold - SLACK). A cell's own pairs are known, so the first round only
    follows edges that leave the cell in which a pair was found; later rounds follow all edges of the new pairs.
    """
    both = lambda df, *more: df.select(*more, F.col("a").alias("q"), F.col("b").alias("r")).union(df.select(*more, "b", "a"))
    edges = united.select(F.col("rep").alias("r"), F.explode("near").alias("s"))
    front = both(found, "cell")
    places = members.select("cell", "rep")
    leaving = front.select("cell", "r").distinct().join(edges, "r").join(places.withColumnRenamed("rep", "s"), ["cell", "s"], "left_anti")
    reached = front.join(leaving, ["cell", "r"]).select("q", "s")
    known = common.cut(found.select("a", "b", "near").dropDuplicates(["a", "b"]), "known")
    units = classes.select("rep", "unit")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = np.einsum("nd,nd->n", _matrix(batch.column("unit").to_pylist()), _matrix(batch.column("other").to_pylist()))
                kept = pa.array(near >= threshold - SLACK)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(near)], names=["a", "b", "near"]).filter(kept)

    while True:
        asked = reached.where("q <> s").select(F.least("q", "s").alias("a"), F.greatest("q", "s").alias("b")).distinct().join(known, ["a", "b"], "left_anti")
        asked = asked.join(units.withColumnRenamed("rep", "a"), "a").join(units.select(F.col("rep").alias("b"), F.col("unit").alias("other")), "b").select("a", "b", "unit", "other")
        new = common.cut(common.map_arrow(asked, verify, "a long, b long, near double", rows=4096), "reached")
        if new.isEmpty():
            return known
        known = known.union(new)
        reached = both(new).join(edges, "r").select("q", "s")


def true_links(classes: DataFrame, threshold: float, queries: int) -> DataFrame:
    """a, b: the links of about so many hashed classes, found by comparing them with all."""
    spark = classes.sparkSession
    total = classes.count()
    chosen = classes.where(F.pmod(F.xxhash64("rep", F.lit(17)), F.lit(1 << 30)) < int(min(1.0, queries / max(total, 1)) * (1 << 30))).select("rep", "unit").toPandas()  # about so many rows
    if chosen.empty:
        return spark.createDataFrame([], "a long, b long")
    reps, x = chosen["rep"].to_numpy(), _matrix(chosen["unit"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep = batch.column("rep").to_numpy()
            i, j = np.nonzero(_matrix(batch.column("unit").to_pylist()) @ x.T >= threshold)
            own = rep[i] != reps[j]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[i], reps[j])[own]), pa.array(np.maximum(rep[i], reps[j])[own])], names=["a", "b"])

    return common.cut(common.map_arrow(classes.select("rep", "unit"), compare, "a long, b long", rows=512).distinct(), "truth")


def audit_links(classes: DataFrame, threshold: float) -> DataFrame | None:
    """True links to audit with: of AUDIT classes, and of more until they are AUDIT_LINKS. None if AUDIT_MOST classes have none."""
    total, queries = classes.count(), AUDIT
    while True:
        truth = true_links(classes, threshold, queries)
        n = truth.count()
        if n >= AUDIT_LINKS or queries >= total or n and queries >= AUDIT_MOST:
            return truth
        if queries >= AUDIT_MOST:
            return None
        queries = min(8 * queries, AUDIT_MOST)


def link_classes(classes: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, float]:
    """Links between classes and their audited recall; other centers are tried while it is below RECALL.

    If it stays below, or if nothing can be audited, all classes are compared and the recall is 1.
    """
    truth = audit_links(classes, threshold)
    links = None
    for seed in range(ROUNDS if truth is not None else 0):
        more = cell_links(classes, threshold, 1000 * seed)
        links = more if links is None else common.cut(links.union(more).distinct(), "pairs")
        n = truth.count()
        recall = truth.join(links, ["a", "b"], "left_semi").count() / n if n else 1.0
        if recall >= RECALL:
            return links, recall
    return common.cut(block_links(classes.select(F.lit("all").alias("cell"), "rep", "unit"), threshold).select("a", "b"), "pairs"), 1.0


def near_duplicate_vectors(table: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept: one row per vec_id.

    Vectors that are null, empty or zero, or hold a null or non-finite component, link with nothing; so do vectors of
    different lengths. If a vec_id repeats, the vector with the smallest digest counts, a usable one before others. All
    rows without vec_id are one row that links with nothing and whose component_id is null. Ties at the threshold are
    links. An empty table has no rows.
    """
    raw = table.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    keyed = common.map_arrow(raw, _keyed, "vec_id long, key binary, unit binary", rows=4096)
    rows = common.cut(keyed.groupBy("vec_id").agg(F.min(F.when(F.col("key").isNotNull(), F.struct("key", "unit"))).alias("u")).select("vec_id", "u.key", "u.unit"), "vectors")
    valid = rows.where("vec_id is not null and key is not null")
    classes = common.cut(valid.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("unit").alias("unit")), "classes")
    links = None
    for size in [r[0] for r in classes.select(F.octet_length("unit")).distinct().collect()]:  # lengths of vectors: as a rule one
        own, _ = link_classes(classes.where(F.octet_length("unit") == size), threshold)
        links = own if links is None else links.union(own)
    if links is None:
        links = rows.sparkSession.createDataFrame([], "a long, b long")
    both = links.union(links.select("b", "a"))
    degree = both.join(classes.select(F.col("rep").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("others"))
    roots = components(links)
    known = classes.select("key", "rep", "n").join(degree.withColumnRenamed("a", "rep"), "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("key", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    linked = rows.where("vec_id is not null").select("vec_id", "key").join(common.cut(known, "known"), "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    nameless = rows.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(nameless).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's number of near-duplicates and their component."""
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
