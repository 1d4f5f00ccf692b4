"""Communities and kept edges against plain versions."""

import random
from collections import Counter

import pytest

from tidemark.operators import graph
from tidemark.sources import keys

SF = "/root/testdata/sf0.001"


def plain_communities(edges):
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    left, colours = set(near), []
    while left:
        colours.append({n for n in left if not any(m < n for m in near[n] & left)})
        left -= colours[-1]
    label, moved = {n: n for n in near}, True
    while moved:
        moved = False
        for colour in colours:
            for n in colour:
                votes = Counter(label[m] for m in near[n])
                most = {c for c, k in votes.items() if k == max(votes.values())}
                if label[n] not in most:
                    label[n], moved = min(most), True
    return label


@pytest.mark.parametrize("seed", [1, 2])
def test_communities_equal_a_plain_version(spark, seed):
    rng = random.Random(seed)
    edges = [(f"{c}{rng.randrange(6)}", f"{c}{rng.randrange(6)}") for c in "ab" for _ in range(9)] + [("a0", "b0"), ("x", "y"), ("y", "x")]
    df = spark.createDataFrame(edges, "src string, dst string")
    assert {r.node: r.community for r in graph.communities(df).collect()} == plain_communities(edges)


def test_no_edges_no_communities(spark):
    empty = spark.createDataFrame([], "src string, dst string")
    assert graph.communities(empty).isEmpty()
    assert graph.community_summary(empty, spark.createDataFrame([], "node string, community string")).isEmpty()


def test_summary_takes_the_least_name_at_a_tie(spark):
    edges = spark.createDataFrame([("order_items", "orders"), ("order_notes", "orders"), ("order_items", "order_notes")], "src string, dst string")
    members = spark.createDataFrame([(n, "c") for n in ("order_items", "order_notes", "orders")], "node string, community string")
    (row,) = graph.community_summary(edges, members).collect()
    assert (row.n_nodes, row.central, row.central_degree, row.mean_degree, row.domain) == (3, "order_items", 2, 2.0, "Order Domain")


def test_edges_are_verified_once_a_state_of_the_files(spark, tmp_path, monkeypatch):
    pair = keys.Registry({"b": ("id",)}, [keys.ForeignKey("a", "b_id", "b", "id")])
    folder = str(tmp_path / "set")
    save = lambda name, rows, column: spark.createDataFrame([(r,) for r in rows], f"{column} bigint").write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    save("a", [1, 1, 2], "b_id"), save("b", [1, 2], "id")
    assert keys.kept_edges(spark, folder, pair).count() == 1
    monkeypatch.setattr(keys, "verified_edges", lambda *a: pytest.fail("verified again"))
    assert keys.kept_edges(spark, folder, pair).first().n == 3
    monkeypatch.undo()
    save("a", [1, 3], "b_id")
    assert keys.kept_edges(spark, folder, pair).isEmpty()


def plain_reach(edges, both=False):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        if both:
            near.setdefault(b, set()).add(a)
    out = {}
    for origin in near:
        hops, front = {origin: 0}, [origin]
        while front:
            front = sorted({b for a in front for b in near.get(a, ()) if b not in hops})
            hops |= dict.fromkeys(front, max(hops.values()) + 1)
        out |= {(origin, n): h for n, h in hops.items() if n != origin}
    return out


def test_reach_has_no_bound_of_hops(spark):
    """A chain of 30 tables with a key back to its start, and a dense graph of 200."""
    rng = random.Random(1)
    chain = [(f"t{i:02}", f"t{i + 1:02}") for i in range(29)] + [("t29", "t00"), ("t03", "t03")]
    dense = [(f"d{a}", f"d{b}") for a in range(200) for b in rng.sample(range(200), 20)]
    for edges in (chain, dense):
        df = spark.createDataFrame(edges, "src string, dst string")
        assert {(r.origin, r.node): r.hop for r in graph.reach(df).collect()} == plain_reach(edges)
    backward = graph.reach(spark.createDataFrame(chain, "src string, dst string"), spark.createDataFrame([("t05",)], "origin string"), "incoming")
    assert {r.node: r.hop for r in backward.collect()}["t06"] == 29
    near = graph.reach(spark.createDataFrame(chain, "src string, dst string"), None, "both", 3)
    assert {(r.origin, r.node): r.hop for r in near.collect()} == {k: h for k, h in plain_reach(chain, True).items() if h <= 3}


def test_paths_of_a_dense_graph(spark):
    """Every pair of 200 tables with 20 keys each: more paths than can be listed, and one is kept."""
    rng = random.Random(2)
    edges = [(f"d{a:03}", "k", f"d{b:03}", "id") for a in range(200) for b in rng.sample(range(200), 20) if a != b]
    found = {(r.origin, r.node): r for r in graph.join_specs(spark.createDataFrame(edges, "src string, col string, dst string, ref_col string")).collect()}
    both = plain_reach([(a, b) for a, _, b, _ in edges], True)
    assert {k: r.hop for k, r in found.items()} == both
    have = {(a, b) for a, _, b, _ in edges}
    for (a, b), r in found.items():
        if r.hop == 2:
            ways = {(0 if (a, m) in have and (m, b) in have else 1 if (m, a) in have and (b, m) in have else 2, f"{a}>{m}>{b}") for m in {f"d{i:03}" for i in range(200)} if ((a, m) in have or (m, a) in have) and ((m, b) in have or (b, m) in have)}
            assert (("forward", "backward", "undirected").index(r.direction), r.path) == min(ways)


def plain_louvain(edges):
    links = Counter()
    for a, b in {tuple(sorted(e)) for e in edges if e[0] != e[1]}:
        links[a, b] = links[b, a] = 1
    members = {a: a for a, _ in links}
    while True:
        total, degree = sum(links.values()), Counter()
        for (a, _), w in links.items():
            degree[a] += w
        label, moved = {n: n for n in degree}, False
        while True:
            sums, held = Counter(), {}
            for n, c in label.items():
                sums[c] += degree[n]
            for (a, b), w in links.items():
                if a != b:
                    held.setdefault(a, Counter())[label[b]] += w
            moves = []
            for n, own in held.items():
                stay = total * own[label[n]] - degree[n] * (sums[label[n]] - degree[n])
                options = [(-(total * w - degree[n] * sums[c] - stay), c) for c, w in own.items() if c != label[n]]
                if options and min(options)[0] < 0:
                    loss, c = min(options)
                    moves.append((loss, n, label[n], c))
            if not moves:
                break
            first = {}
            for loss, n, a, b in moves:
                for c in (a, b):
                    first[c] = min(first.get(c, (loss, n)), (loss, n))
            for loss, n, a, b in moves:
                if first[a] == first[b] == (loss, n):
                    label[n], moved = b, True
        if not moved:
            least = {}
            for n, c in members.items():
                least[c] = min(least.get(c, n), n)
            return {n: least[c] for n, c in members.items()}
        least = {}
        for n, c in label.items():
            least[c] = min(least.get(c, n), n)
        label = {n: least[c] for n, c in label.items()}
        fresh = Counter()
        for (a, b), w in links.items():
            fresh[label[a], label[b]] += w
        links, members = fresh, {n: label[c] for n, c in members.items()}


@pytest.mark.parametrize("seed", [3, 4])
def test_louvain_equals_a_plain_version_and_beats_propagation(spark, seed):
    rng = random.Random(seed)
    edges = [(f"{c}{rng.randrange(7)}", f"{c}{rng.randrange(7)}") for c in "abcd" for _ in range(16)] + [("a0", "b0"), ("b1", "c1"), ("c2", "d2"), ("d3", "a3"), ("a0", "a0")]
    df = spark.createDataFrame(edges, "src string, dst string").repartition(3)
    found = graph.louvain(df)
    assert {r.node: r.community for r in found.collect()} == plain_louvain(edges)
    assert graph.modularity(df, found) >= graph.modularity(df, graph.communities(df)) - 1e-12
    assert graph.louvain(df.limit(0)).isEmpty()
