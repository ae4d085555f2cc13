"""Communities by modularity, against brute force, label propagation's result and known partitions."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from caseweave.operators import graph

SCHEMA = "from_key string, to_key string, kind string"


def frame(spark, pairs):
    return spark.createDataFrame([(a, b, "cita") for a, b in pairs], SCHEMA)


def plain_modularity(pairs, group):
    """The definition, pair by pair of nodes."""
    links = {(a, b) for a, b in pairs if a is not None and b is not None and a != b}
    k = {}
    for a, b in links:
        k[a], k[b] = k.get(a, 0) + 1, k.get(b, 0) + 1
    m = len(links)
    inside = sum(group[a] == group[b] for a, b in links) / m
    return inside - sum((sum(v for n, v in k.items() if group[n] == c) / (2 * m)) ** 2 for c in {group[n] for n in k})


def cliques(n, size):
    """Cliques in a ring, each tied to the next by one edge."""
    name = lambda c, i: f"{c:02d}-{i}"
    inside = [(name(c, i), name(c, j)) for c in range(n) for i, j in combinations(range(size), 2)]
    return inside + [(name(c, 0), name((c + 1) % n, 1)) for c in range(n)]


def test_cliques_in_a_ring_are_found(spark):
    pairs = cliques(6, 5)
    members = graph.communities(frame(spark, pairs))
    found = {r["node"]: r["community"] for r in members.collect()}
    assert all(found[n] == n[:3] + "0" for n in found) and len(found) == 30
    assert graph.modularity(frame(spark, pairs), members) == pytest.approx(plain_modularity(pairs, found))


def test_hub_with_many_leaves_and_odd_rows(spark):
    pairs = [("hub", f"leaf{i}") for i in range(60)] * 2 + [("loop", "loop"), (None, "left"), ("x", "y"), ("y", "x")]
    found = {r["node"]: r["community"] for r in graph.communities(frame(spark, pairs)).collect()}
    assert {found[f"leaf{i}"] for i in range(60)} == {"hub"}
    assert (found["loop"], found["left"], found["x"], found["y"]) == ("loop", "left", "x", "x")
    assert graph.communities(frame(spark, pairs).limit(0)).count() == 0
    assert graph.modularity(frame(spark, pairs).limit(0), graph.communities(frame(spark, pairs).limit(0))) == 0


def test_no_partition_of_a_small_graph_is_much_better(spark):
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("d", "f"), ("f", "g")]
    nodes = sorted({n for p in pairs for n in p})

    def partitions(i, groups):
        if i == len(nodes):
            yield {n: g for g, members in enumerate(groups) for n in members}
            return
        for g in groups:
            g.append(nodes[i])
            yield from partitions(i + 1, groups)
            g.pop()
        yield from partitions(i + 1, [*groups, [nodes[i]]])

    best = max(plain_modularity(pairs, p) for p in partitions(0, []))
    found = {r["node"]: r["community"] for r in graph.communities(frame(spark, pairs)).collect()}
    assert plain_modularity(pairs, found) == pytest.approx(best)


def propagated(pairs, rounds=8):
    """Label propagation with the smallest of equal labels."""
    near = {}
    for a, b in {frozenset(p) for p in pairs if len(set(p)) == 2}:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    label = {n: n for n in near}
    for i in range(1, rounds + 1):
        best = {n: min(((-sum(label[x] == c for x in others), c) for c in {label[x] for x in others}))[1] for n, others in near.items()}
        label = {n: c if i % 2 == 0 or c < label[n] else label[n] for n, c in best.items()}
    return label


def test_page_links_beat_label_propagation_and_rerun_equal(spark):
    from caseweave.plans import catalog

    edges = catalog._link_edges(spark, "/root/testdata/sf0.001")
    pairs = [(r["from_key"], r["to_key"]) for r in edges.collect()]
    first = {r["node"]: r["community"] for r in entry.queries()["communities"](spark, "/root/testdata/sf0.001").collect()}
    again = {r["node"]: r["community"] for r in graph.communities(edges.orderBy(F.rand(7))).collect()}
    assert first == again
    assert plain_modularity(pairs, first) >= plain_modularity(pairs, propagated(pairs))
