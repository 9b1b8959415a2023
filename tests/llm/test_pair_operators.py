"""MinHash, components and vector graphs against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from shelfkin.llm import bbit_minhash, components, vector_graph
from shelfkin.llm.queries import QUERIES

DOCS = "doc_id bigint, text string"


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def closest(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_near(rows):
    sets = {d: shingle_set(t) for d, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = closest(ids, links)
    return {d: (len(sets[d]), root[d], root[d] == d) for d in ids}


def edited(words, share):
    return [random.choice(words) + "x" if random.random() < share else w for w in words]


def test_near_duplicates_equal_brute_force(spark):
    random.seed(8)
    bases = [[f"{random.choice('abcdefgh')}{random.randrange(400)}" for _ in range(random.choice([3, 6, 40, 120]))] for _ in range(25)]
    rows = []
    for base in bases:
        for _ in range(random.randint(1, 12)):
            rows.append(" ".join(edited(base, random.choice([0, 0, 0.01, 0.03, 0.06]))))
    rows += ["One two", "one  TWO", "one two three", "", " \n", "same words here and there", "Same words\there and there", "é è ü ö ä ß", "é è ü ö ä ß "]
    random.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, component_id string")
    got = {r["doc_id"]: tuple(r)[1:] for r in bbit_minhash.near_duplicates(df).collect()}
    expected = brute_near(rows)
    assert got == expected
    kept = bbit_minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, e in expected.items() if e[2])


def test_chains_through_a_hot_bucket(spark):
    """Copies of a base with growing tails: neighbours link, the ends do not."""
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([f"p{j}" for j in range(k * 4)] + base + [f"t{j}" for j in range(60 - k * 4)])) for k in range(12)]
    got = {r["doc_id"]: tuple(r)[1:] for r in bbit_minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_near(rows)


def test_pairs_of_few_shingles_at_the_threshold(spark):
    """Unions of 4, 8, 12 and 20 shingles, of which exactly three quarters are common."""
    rows = []
    for k in range(1500):
        union = (4, 8, 12, 20)[k % 4]
        words = [f"{k}w{j}" for j in range(union + 4)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: 3 * union // 4 + 4]))]
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in bbit_minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {d: (d - d % 2, d % 2 == 0) for d in range(3000)}


@pytest.mark.parametrize("union", [4, 12, 40])
def test_estimates_of_few_shingles_spread_as_computed(union):
    """The gates rest on deviations of independent places, also for sets of few shingles."""
    rng = np.random.default_rng(union)
    sets = list(rng.integers(0, 2**63, (8000, union)).astype(np.uint64))
    parts = [s[: 3 * union // 4] for s in sets]
    for first, many in ((0, 128), (128, 1024)):
        a, b = (bbit_minhash.bit_planes(bbit_minhash.minima(x, first, many)).view(np.uint64).reshape(len(x), bbit_minhash.BITS, -1) for x in (sets, parts))
        different = np.bitwise_count(np.bitwise_or.reduce(a ^ b, axis=1)).sum(axis=1)
        estimate = (1 - different / many - 1 / 16) * 16 / 15
        equal = 0.75 + 0.25 / 16
        assert abs(estimate.mean() - 0.75) < 0.003
        assert abs(estimate.std() / (math.sqrt(equal * (1 - equal) / many) * 16 / 15) - 1) < 0.05


def test_one_band_over_many_unlike_documents(spark, monkeypatch):
    """A passage all share puts unlike documents into the same bands; tiles lose none of the few links."""
    monkeypatch.setattr(bbit_minhash, "TILE", 7)
    random.seed(12)
    passage = " ".join(f"common{j}" for j in range(70))
    rows = []
    for k in range(240):
        own = [f"{k if k % 12 else k // 24}own{j}" for j in range(70 + k % 5)]
        rows.append((k, f"{passage} {' '.join(own)}"))
    got = {r["doc_id"]: tuple(r)[1:] for r in bbit_minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    expected = brute_near(rows)
    assert got == expected and len({e[1] for e in expected.values()}) < 240
    many = spark.createDataFrame([(1, k) for k in range(50)] + [(2, 0), (None, 1)], "a bigint, b bigint")
    few = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "a bigint, c string")
    assert sorted(map(tuple, bbit_minhash.dealt(many, few, "a", "b").select("a", "b", "c").collect())) == sorted([(1, k, c) for k in range(50) for c in "xy"] + [(2, 0, "z")])


def test_near_duplicates_of_odd_rows(spark):
    long = " ".join(f"v{k}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "a b c"), (None, None), (9, long), (8, long + " end"), (7, "a b c")]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted((tuple(r) for r in bbit_minhash.near_duplicates(df).collect()), key=repr)
    expected = [(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (3, 1, 3, True), (None, 1, None, True), (None, 0, None, True), (9, 29996, 8, False), (8, 29997, 8, True), (7, 1, 3, False)]
    assert got == sorted(expected, key=repr)
    assert sorted((r["doc_id"] for r in bbit_minhash.drop_near_duplicates(df).collect()), key=repr) == sorted([1, 2, 3, None, None, 8], key=repr)
    assert bbit_minhash.near_duplicates(df.limit(0)).count() == 0


def test_estimates_are_close(spark):
    random.seed(5)
    a = [f"x{k}" for k in range(400)]
    rows = [(0, " ".join(a)), (1, " ".join(a[:200] + [f"y{k}" for k in range(200)]))]
    signed = {r["doc_id"]: r["planes"] for r in bbit_minhash.signatures(spark.createDataFrame(rows, DOCS)).collect()}
    df = spark.createDataFrame([(signed[0], signed[1])], "a array<bigint>, b array<bigint>")
    estimate = df.select(bbit_minhash.estimated(df.a, df.b)).first()[0]
    sets = [shingle_set(t) for _, t in rows]
    assert abs(estimate - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 0.15


def test_near_duplicate_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op9_near_duplicates"](spark, sf).collect()} == brute_near(rows)


def test_components(spark):
    random.seed(6)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(500, 560)] + [(700, k) for k in range(701, 760)]
    expected = closest({x for e in edges for x in e}, edges)
    df = spark.createDataFrame([*edges, (None, 3), (4, 4)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components.components(df).collect()}
    assert got == {n: c for n, c in expected.items() if n in got}
    assert set(got) >= {x for a, b in edges if a != b for x in (a, b)}
    assert components.components(df.limit(0)).count() == 0


def brute_vectors(rows, least=0.95):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, float) / np.abs(v).max()
            good[i] = x / np.linalg.norm(x)
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= least]
    root = closest([i for i, _ in rows if i is not None], links)
    degree = {i: sum(i in e for e in links) for i in root}
    return {i: (degree[i], root[i], root[i] == i) for i in root}


def test_vector_links_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    bases = rng.normal(size=(60, 16))
    rows = [(k, (bases[rng.integers(60)] + rng.normal(size=16) * rng.choice([0, 0.05, 0.2, 0.3])).tolist()) for k in range(700)]
    rows += [(800, None), (801, []), (802, [0.0] * 16), (803, [1.0, None] + [0.0] * 14), (804, [float("nan")] + [1.0] * 15), (805, [float("inf")] * 16), (806, [1.0, 2.0]), (807, [2.0, 4.0])]
    rows += [(808, [1e-200] * 16), (809, [1e200] * 16), (810, rows[3][1]), (811, rows[3][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, n_links string")
    got = {r["vec_id"]: tuple(r)[1:] for r in vector_graph.linked_vectors(df).collect()}
    assert got == brute_vectors(rows)


def test_vectors_without_ids_or_rows(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id bigint, embedding array<double>")
    assert {tuple(r) for r in vector_graph.linked_vectors(df).collect()} == {(None, 0, None, True), (1, 0, 1, True)}
    assert vector_graph.linked_vectors(df.limit(0)).count() == 0


def test_rows_that_repeat_an_id_are_one_vector(spark):
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, v), (1, v), (3, v), (5, v), (5, w), (6, w), (7, v), (7, None), (8, w)] + [(9, w)] * 30
    got = {tuple(r) for r in vector_graph.linked_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    # Of 5, the vector that is first by its numbers counts.
    assert got == {(1, 2, 1, True), (3, 2, 1, False), (7, 2, 1, False), (5, 3, 5, True), (6, 3, 5, False), (8, 3, 5, False), (9, 3, 5, False)}
    assert vector_graph.linked_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).count() == len(rows)


def test_found_links_are_audited_if_no_chosen_node_has_any(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "AUDIT_PAIRS", 0)
    rng = np.random.default_rng(13)
    x = rng.normal(size=(3000, 24))
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)] + [(4000 + j, (x[0] + rng.normal(size=24) * 0.01).tolist(), 1) for j in range(2)]
    nodes = spark.createDataFrame(rows, "node bigint, raw array<double>, copies bigint")
    # One of the two links of each node was found.
    links = spark.createDataFrame([(0, 1, 1), (4000, 1, 1)], "node bigint, n bigint, others bigint")
    assert vector_graph.audit(nodes, len(rows), links, 0.95, 5) == (0.5, 2, 7)
    none = links.limit(0)
    assert vector_graph.audit(nodes, len(rows), none, 0.95, 5).recall is None


def test_sharded_search_keeps_recall(spark, monkeypatch):
    """Many small shards, some split, some queries in several chunks."""
    monkeypatch.setattr(vector_graph, "SHARD_ROWS", 60)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=12)
    rows = [(k, (centre + rng.normal(size=12) * 0.12).tolist()) for k in range(300)]
    bases = rng.normal(size=(150, 12))
    rows += [(300 + k, (bases[k % 150] + rng.normal(size=12) * 0.1).tolist()) for k in range(600)]
    expected = brute_vectors(rows)
    got = {r["vec_id"]: tuple(r)[1:] for r in vector_graph.linked_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert all(got[i][0] <= expected[i][0] for i in expected)
    assert sum(g[0] for g in got.values()) >= 0.95 * sum(e[0] for e in expected.values())


def test_pairs_found_one_way_count_for_both_ends(spark, monkeypatch):
    """With one home and one visit per node, searches across a border go one way at most; n_links is still symmetric."""
    monkeypatch.setattr(vector_graph, "SHARD_ROWS", 40)
    monkeypatch.setattr(vector_graph, "AUDIT_RECALL", 0.0)
    monkeypatch.setattr(vector_graph, "HOMES", 1)
    monkeypatch.setattr(vector_graph, "PROBES", 2)
    rng = np.random.default_rng(9)
    bases = rng.normal(size=(200, 12))
    rows = [(2 * k + j, (bases[k] + rng.normal(size=12) * (0.0, 0.2)[j]).tolist()) for k in range(200) for j in (0, 1)]
    rows += [(1000 + k, bases[k].tolist()) for k in range(20)]
    got = {r["vec_id"]: tuple(r)[1:] for r in vector_graph.linked_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert sum(g[0] for g in got.values()) % 2 == 0
    component = Counter(g[1] for g in got.values())
    assert sum(component[g[1]] > 1 for g in got.values()) > 100
    assert all(g[0] > 0 for g in got.values() if component[g[1]] > 1)


def test_audit_counts_nodes_with_links(spark):
    """Links are rare, a hot group does not decide, and lost links of small groups are seen."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1500, 24))
    rows = [(k, v.tolist(), 1000 if k < 2 else 1) for k, v in enumerate(x)] + [(2000 + k, (x[k] * 2 + rng.normal(size=24) * 0.02).tolist(), 1) for k in range(20)]
    nodes = spark.createDataFrame(rows, "node bigint, raw array<double>, copies bigint")
    found = [(k, 1, 1) for k in range(5)] + [(2000 + k, 1, 1) for k in range(5)]
    links = spark.createDataFrame(found, "node bigint, n bigint, others bigint")
    assert vector_graph.audit(nodes, len(rows), links, 0.95, 30) == (0.25, 40, 1520)
    assert vector_graph.audit(nodes.where("node < 1500"), 1500, links, 0.95, 30) == (None, 0, 1500)


def test_small_tables_are_audited_too(spark, monkeypatch):
    """A search that finds nothing is widened until all blocks are compared."""
    beams = []
    monkeypatch.setattr(vector_graph, "audit", lambda *a: (beams.append(1), vector_graph.Audit(0.0, 1, 1))[1])
    rng = np.random.default_rng(12)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(30)]
    rows += [(100 + k, r[1]) for k, r in enumerate(rows[:5])] + [(200, (np.array(rows[0][1]) * 1.01 + 0.001).tolist())]
    got = {r["vec_id"]: tuple(r)[1:] for r in vector_graph.linked_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert got == brute_vectors(rows) and len(beams) > 2


def test_graph_and_search_on_one_shard():
    rng = np.random.default_rng(5)
    x = vector_graph.unit(rng.normal(size=(400, 8)).tolist())
    graph = vector_graph.pruned_graph(x)
    assert all(i not in g for i, g in enumerate(graph))
    a, b = vector_graph.range_search(x, x, graph, 0.9)
    true = np.argwhere(x @ x.T >= 0.9)
    assert len(a) >= 0.99 * len(true) and set(zip(a.tolist(), b.tolist(), strict=True)) <= set(map(tuple, true.tolist()))
    assert [len(g) for g in vector_graph.pruned_graph(x[:1])] == [0]


@pytest.mark.parametrize("name", ["op3_embedding_links"])
def test_vector_query(spark, name):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert {r["vec_id"]: tuple(r)[1:] for r in QUERIES[name](spark, sf).collect()} == brute_vectors(rows)
