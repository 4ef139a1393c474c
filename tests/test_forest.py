import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from treeline.operators import analytics, forest, graph, order, traversal
from treeline.operators.components import connected_components, find, roots

EDGE = "src long, dst long, weight double"


def by_hand(edges):
    parent, out = {}, []
    for w, s, d in sorted((w, s, d) for s, d, w in edges):
        a, b = find(parent, s), find(parent, d)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((s, d, w))
    return sorted(out)


def random_graph(rng, n, m, weights=6):
    pairs = {}
    for _ in range(m):
        a, b = sorted((rng.randrange(n), rng.randrange(n)))
        if a != b:
            pairs[a, b] = float(rng.randint(-2, weights))
    return [(a, b, w) for (a, b), w in pairs.items()]


def test_kernel_against_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        edges = random_graph(rng, rng.randint(1, 12), rng.randint(0, 30))
        found = forest.local_forest(pd.DataFrame(edges, columns=["src", "dst", "weight"]))
        assert sorted(found.itertuples(index=False, name=None)) == by_hand(edges)


CASES = {
    "empty": [],
    "one": [(1, 2, 3.0)],
    "loops": [(1, 1, 1.0), (2, 2, 0.0)],
    "ties": [(a, b, 1.0) for a in range(6) for b in range(a + 1, 6)],
    "two parts": [(0, 1, 2.0), (1, 2, 1.0), (0, 2, 3.0), (10, 11, -1.0)],
    "sparse ids": [(2**40, 2**41, 1.0), (5, 2**41, 2.0), (5, 2**40, 0.0)],
    "random": random_graph(random.Random(9), 40, 200),
}


@pytest.mark.parametrize("strategy", list(forest.STRATEGIES))
def test_strategies(spark, strategy, monkeypatch):
    monkeypatch.setattr(forest, "TASK_EDGES", 60)
    for edges in [CASES["random"], CASES["ties"], CASES["empty"]] if strategy in ("rounds", "filter") else CASES.values():
        found = forest.minimum_spanning_forest(spark.createDataFrame(edges, EDGE), strategy)
        assert sorted(map(tuple, found.collect())) == by_hand([e for e in edges if e[0] != e[1]])


def test_components_of_a_path_and_nulls(spark):
    rng = random.Random(1)
    edges = [(n, n + 1) for n in range(60)] + [(100, 101), (None, 7), (9, 9)]
    rng.shuffle(edges)
    found = dict(map(tuple, connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    assert found == {**{n: 0 for n in range(61)}, 100: 100, 101: 100}


@pytest.mark.parametrize("block", [4, 1 << 20])
def test_membership_to_jumps_and_slots(spark, block):
    rng = random.Random(block)
    row = [rng.choice([1, 2, 2]) for _ in range(60)] + [2] * 9 + [1, 2]
    rows = spark.createDataFrame(list(enumerate(row)), "pos long, membership int")
    left = lambda n: next((k for k, m in enumerate(row[n:]) if m == 1), len(row) - n)
    assert dict(map(tuple, analytics.jump_lengths(rows, block=block).collect())) == {n: -left(n) for n in range(len(row))}
    capped = dict(map(tuple, analytics.jump_lengths(rows, 4, block=block).collect()))
    assert capped == {n: -((left(n) - 1) % 4 + 1) if left(n) else 0 for n in range(len(row))}
    starts = [n for n, m in enumerate(row) if m == 2 and (n == 0 or row[n - 1] == 1)]
    skipped = row.count(2)
    assert analytics.jump_summary(rows).first() == (skipped, len(starts), len(row) - skipped + len(starts), len(row))
    for chunks, size in ((1, 71), (4, 18)):
        slots = {r.pos: (r.chunk, r.slot) for r in analytics.compacted(rows, chunks).collect()}
        bounds = [n for n in range(len(row)) if n == 0 or slots[n][0] != slots[n - 1][0]]
        assert len(bounds) == chunks and len(row) == 71
        for a, b in zip(bounds, [*bounds[1:], len(row)]):
            assert b - a in (size, size - 1)
            assert sorted(range(a, b), key=slots.get) == sorted(range(a, b), key=lambda n: (row[n], n)) and {slots[n][1] for n in range(a, b)} == set(range(b - a))
    jumps = sorted(map(tuple, analytics.compacted_jumps(rows, 1, 10).collect()))
    assert [j for _, _, j in jumps] == [0] * row.count(1) + [-(n % 10) for n in range(skipped, 0, -1)]


@pytest.mark.parametrize("block", [1, 3, 1 << 20])
def test_windows_over_blocks(spark, block):
    rng = random.Random(block)
    values = {n: rng.choice([None, n]) for n in sorted(rng.sample(range(200), 40))}
    df = spark.createDataFrame(list(values.items()), "pos long, v long")
    at = list(values)
    before = {r.pos: r.p for r in order.with_previous(df, "pos", F.col("v"), "p", block).collect()}
    assert before == {n: values[at[k - 1]] if k else None for k, n in enumerate(at)}
    for forward in (True, False):
        got = {r.pos: r.p for r in order.filled(df, "pos", F.col("v"), "p", block, forward).collect()}
        assert got == {n: (max if forward else min)((v for k, v in values.items() if v is not None and (k <= n if forward else k >= n)), default=None) for n in at}


def test_positions(spark):
    a, b = (spark.createDataFrame([(float(x),) for x in xs], "w double") for xs in ([3, 1, 2, 2], [2, 1, 3]))
    assert sorted(map(tuple, order.differences(a, b, "w").collect())) == [(2, 2.0, 3.0), (3, 3.0, None)]
    assert order.kth(a, 2, "w").first().w == 2.0 and order.kth(a, 9, "w").count() == 0
    ranked = order.ranked(a, "w")
    assert order.unsorted(ranked, "pos", "w", block=2).count() == 0
    assert [r.w for r in order.unsorted(spark.createDataFrame([(0, 1.0), (1, 5.0), (2, 4.0), (3, 4.0)], "pos long, w double"), "pos", "w", block=2).collect()] == [4.0]


def test_pointers_to_roots(spark):
    parents = [(n, max(n - 3, n % 3)) for n in range(50)]
    found = {r.vertex: (r.root, r.hops) for r in roots(spark.createDataFrame(parents, "vertex long, parent long")).collect()}
    assert found == {n: (n % 3, n // 3) for n in range(50)}
    with pytest.raises(RuntimeError):
        roots(spark.createDataFrame([(1, 2), (2, 1)], "vertex long, parent long"), rounds=4)


def test_one_task_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(forest, "ONE_TASK_EDGES", 3)
    edges = spark.createDataFrame(random_graph(random.Random(2), 9, 30), EDGE)
    with pytest.raises(ValueError):
        forest.minimum_spanning_forest(edges, "local")
    degrees = spark.createDataFrame([(n, n % 3) for n in range(100)], "vertex long, degree long")
    mean = 0.0
    for n in range(100):
        mean = (mean + n % 3) / 2
    assert graph.running_degree(degrees).first()[0] == round(mean, 6)


def test_filter_splits_again(spark):
    edges = random_graph(random.Random(21), 60, 700, weights=9)
    found = forest.minimum_spanning_forest(spark.createDataFrame(edges, EDGE), "filter", threshold=60)
    assert sorted(map(tuple, found.collect())) == by_hand(edges)


def test_filter_splits_within_a_task(spark, monkeypatch):
    rng = random.Random(23)
    for threshold in (1, 5, 60, 900):
        for weights in (0, 9, 10**6):
            edges = random_graph(rng, 60, 700, weights)
            found = forest.filtered_forest(pd.DataFrame([*edges, (3, 3, -9.0)], columns=["src", "dst", "weight"]), threshold)
            assert sorted(found.itertuples(index=False, name=None)) == by_hand(edges)
    # a table that one task reduces takes no more than that task, however low the threshold
    monkeypatch.setattr(forest, "connected_components", None)
    found = forest.minimum_spanning_forest(spark.createDataFrame(edges, EDGE), "filter", threshold=5)
    assert sorted(map(tuple, found.collect())) == by_hand(edges)


def test_forest_with_ids(spark):
    edges = [(1, 2, 5.0, 7), (1, 2, 5.0, 4), (2, 3, 1.0, 0), (1, 3, 2.0, 9), (4, 5, None, 2)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double, edge_id long")
    got = forest.with_edge_ids(forest.minimum_spanning_forest(df), df)
    assert sorted(map(tuple, got.collect())) == [(1, 3, 2.0, 9), (2, 3, 1.0, 0), (4, 5, 0.0, 2)]


def test_closing_time_both_ways(spark, monkeypatch):
    edges = sorted(random_graph(random.Random(3), 10, 40), key=lambda e: (e[2], e[0], e[1]))
    ranked = order.store(order.ranked(spark.createDataFrame(edges, EDGE), *graph.ORDER))
    rows = order.store(forest.classified(ranked, forest.minimum_spanning_forest(ranked)))
    tree = rows.filter("membership = 1")
    want = {}
    for pos, (s, d, _) in enumerate(edges):
        for upto in range(pos):
            parent = {}
            for a, b, _ in edges[: upto + 1]:
                a, b = find(parent, a), find(parent, b)
                parent[max(a, b)] = min(a, b)
            if find(parent, s) == find(parent, d):
                want[pos] = upto
                break
    assert {r.pos: r.closed_at for r in analytics.closing_time(rows, tree).collect()} == want
    monkeypatch.setattr(analytics, "TASK_VERTICES", 1)
    assert {r.pos: r.closed_at for r in analytics.closing_time(rows, tree).collect()} == want


def levels(df):
    return sorted((r.vertex, r.level, r.parent, r.path_max) for r in df.collect())


@pytest.mark.parametrize("arcs", [0, traversal.TASK_ARCS])
def test_breadth_first(spark, monkeypatch, arcs):
    monkeypatch.setattr(traversal, "TASK_ARCS", arcs)
    edges = spark.createDataFrame([(0, 1, 5.0), (0, 2, 1.0), (1, 3, 2.0), (2, 3, 9.0), (7, 8, 1.0)], EDGE)
    assert levels(traversal.breadth_first(edges, 0)) == [(0, 0, None, None), (1, 1, 0, 5.0), (2, 1, 0, 1.0), (3, 2, 1, 5.0)]
    assert levels(traversal.breadth_first(edges, 99)) == levels(traversal.breadth_first(edges.limit(0), 99)) == [(99, 0, None, None)]
    path = spark.createDataFrame([(n, n + 1, float(n)) for n in range(6)], EDGE)
    want = [(0, 0, None, None)] + [(n, n, n - 1, float(n - 1)) for n in range(1, 7)]
    assert levels(traversal.breadth_first(path, 0)) == want == levels(traversal.breadth_first(path, 0, rounds=7))
    with pytest.raises(Exception, match="vertices are left"):
        traversal.breadth_first(path, 0, rounds=3)


def test_both_searches_agree(spark, monkeypatch):
    edges = spark.createDataFrame(random_graph(random.Random(31), 60, 90), EDGE)
    found = levels(traversal.breadth_first(edges, 5))
    monkeypatch.setattr(traversal, "TASK_ARCS", 0)
    assert found == levels(traversal.breadth_first(edges, 5)) and len(found) > 20


def test_order(spark):
    df = spark.createDataFrame([(float(n % 7), n) for n in range(50)], "w double, n long")
    got = sorted((r.pos, r.w, r.n) for r in order.ranked(df, "w", "n").collect())
    assert got == [(i, w, n) for i, (w, n) in enumerate(sorted((float(n % 7), n) for n in range(50)))]
    assert order.lightest(df, 3, "w", "n").count() == 3
    sizes = df.withColumn("c", order.chunk(df["n"], 50, 8)).groupBy("c").count().orderBy("c").collect()
    assert [r["count"] for r in sizes] == [7, 7, 6, 6, 6, 6, 6, 6]
    assert order.is_partitioned(df.filter("w < 3"), df.filter("w >= 3"), "w")


def test_graph_profile(spark):
    edges = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0), (1, 2, 1.0), (2, 3, None)], EDGE)
    row = graph.graph_stats(graph.typed(edges)).first()
    assert (row.n_edges, row.n_loops, row.n_parallel, row.max_weight, row.n_vertices, row.max_degree) == (4, 1, 1, 3.0, 3, 3)
    assert sorted(map(tuple, graph.canonical(edges).collect())) == [(1, 2, 1.0), (2, 3, 0.0)]
    assert graph.difference(edges, edges).count() == 0
