"""Near duplicates among embeddings by search in robust-pruned graphs.

1. Equal vectors become one node, named by their smallest id.
2. Centroids are fitted on a bounded sample.  Every node goes to the shards of its two
   nearest centroids; a shard of more than ``SHARD_ROWS`` nodes is split by hash.
3. Each shard builds a flat graph: nearest and random candidates, cut by robust pruning
   (a candidate is dropped if a chosen neighbour is much nearer to it than the node is).
   The lists that a node got in its shards are united.
4. All nodes are queries.  A query visits the shards of its nearest centroids: greedy
   search from medoids, which goes on through everything near the range until nothing
   new is found.  Links are verified in double precision.
5. Recall is audited on hashed nodes that have true links, against all rows, as the mean
   share of a node's linked nodes that was found; the choice grows until enough such
   nodes are in it or ``AUDIT_PAIRS`` are compared.  If none of them has a link, nodes
   with found links are audited in their place.  While recall is below the target,
   the search is repeated with twice as many shards visited, then with a wider beam, and
   at last with whole blocks compared.  The result of the audit is logged.

A pair that a search finds, whichever side and shard, is listed once by its two nodes and
counts for both; for the components a shard gives one edge per node.  The list grows with
the links, so a dense cluster costs the square of its different vectors.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfkin.session import materialize

from .common import held
from .components import components

COSINE = 0.95
SAMPLE_ROWS = 20_000
SHARD_ROWS = 2_000
MOST_CENTROIDS = 1_024
HOMES, PROBES = 2, 4
DEGREE, CANDIDATES, ALPHA = 24, 48, 1.2
BEAM, STRIDE, SLACK = 24, 4, 0.04
AUDIT_ROWS, AUDIT_RECALL = 200, 0.97
AUDIT_PAIRS = 2_000_000_000
AUDIT_BYTES = 64 << 20  # of vectors on the driver at once
SEED = 7

log = logging.getLogger(__name__)


class Audit(NamedTuple):
    """Mean recall of the ``linked`` nodes with true links among the ``chosen``; None if there are none."""

    recall: float | None
    linked: int
    chosen: int


def one_per_id(rows: DataFrame) -> DataFrame:
    """(id, raw) with one usable vector for every id: of several, the first by its numbers.

    Only rows of ids that repeat are grouped, each group in parts before it meets.
    """
    v = F.col("raw")
    usable = rows.where(
        v.isNotNull() & F.col("id").isNotNull() & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    again = held(usable.groupBy("id").count().where("count > 1").select(F.col("id").alias("again")))
    single = usable.join(again, F.col("id") == F.col("again"), "left_anti")
    several = usable.join(again, F.col("id") == F.col("again"), "left_semi").groupBy("id").agg(F.min("raw").alias("raw"))
    return single.unionByName(several)


def nodes_of(vectors: DataFrame) -> DataFrame:
    """(node, copies, raw) of the different vectors of (id, raw) rows."""
    return vectors.groupBy("raw").agg(F.min("id").alias("node"), F.count("*").alias("copies"))


def unit(raw: Iterable) -> np.ndarray:
    """Rows of length one; scaling by the largest component first keeps tiny and huge ones exact."""
    x = np.array([np.asarray(r, np.float64) for r in raw])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means, started from random rows."""
    rng = np.random.default_rng(SEED)
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        nearest = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centroids)
    return centroids


def pruned_graph(x: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES) -> list[np.ndarray]:
    """Neighbour lists by robust pruning, with the reverse edges added."""
    n = len(x)
    if n <= 2:
        return [np.array([j for j in range(n) if j != i], np.int64) for i in range(n)]
    rng = np.random.default_rng(SEED)
    near = min(candidates, n - 1)
    chosen: list[np.ndarray] = []
    for at in range(0, n, 256):
        rows = np.arange(at, min(n, at + 256))
        similarity = x[rows] @ x.T
        similarity[np.arange(len(rows)), rows] = -np.inf
        close = np.argpartition(-similarity, near - 1, axis=1)[:, :near]
        pool = np.concatenate([close, rng.integers(0, n, (len(rows), near // 2))], axis=1)
        distance = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(similarity, pool, 1)))
        distance[pool == rows[:, None]] = np.inf
        order = distance.argsort(axis=1, kind="stable")
        pool, distance = np.take_along_axis(pool, order, 1), np.take_along_axis(distance, order, 1)
        among = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("bid,bjd->bij", x[pool], x[pool])))
        alive = np.isfinite(distance)
        picks = np.full((len(rows), degree), -1)
        own = np.arange(len(rows))
        for d in range(degree):
            first = alive.argmax(axis=1)
            some = alive[own, first]
            picks[some, d] = pool[own, first][some]
            alive &= ALPHA * among[own, first] > distance
            alive[own, first] = False
        chosen.extend(p[p >= 0] for p in picks)
    source = np.repeat(np.arange(n), [len(c) for c in chosen])
    target = np.concatenate(chosen)
    both = np.unique(np.concatenate([source * n + target, target * n + source]))
    return np.split(both % n, np.searchsorted(both // n, np.arange(1, n)))


def range_search(queries: np.ndarray, x: np.ndarray, graph: list[np.ndarray], least: float, beam: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) with a cosine of ``least`` or more that the search reaches.

    All queries walk in step.  Each expands its best rows not expanded yet, ``beam`` of
    them at least (``BEAM`` if 0), and beyond that all rows within ``SLACK`` of the range.
    """
    beam = beam or BEAM
    n = len(x)
    width = max(1, max(map(len, graph)))
    table = np.full((n, width), -1)
    for i, g in enumerate(graph):
        table[i, : len(g)] = g
    rng = np.random.default_rng(SEED)
    starts = np.unique(np.r_[(x @ x.sum(axis=0)).argmax(), (fit_centroids(x, min(16, n), 3) @ x.T).argmax(axis=1), rng.integers(0, n, 4)])
    score = np.full((len(queries), n), -np.inf, np.float32)
    score[:, starts] = queries @ x[starts].T
    waiting = score.copy()
    expanded = np.zeros(len(queries), np.int64)
    active = np.arange(len(queries))
    stride = min(STRIDE, n)
    while len(active):
        w = waiting[active]
        best = np.argpartition(-w, stride - 1, axis=1)[:, :stride] if stride < n else np.tile(np.arange(n), (len(active), 1))
        value = np.take_along_axis(w, best, 1)
        go = np.isfinite(value) & ((expanded[active] < beam)[:, None] | (value >= least - SLACK))
        row, col = np.nonzero(go)
        if not len(row):
            break
        q, node = active[row], best[row, col]
        waiting[q, node] = -np.inf
        expanded += np.bincount(q, minlength=len(queries))
        neighbours = table[node]
        pair = (np.repeat(q, width) * n + neighbours.ravel())[neighbours.ravel() >= 0]
        pair = np.unique(pair[~np.isfinite(score.ravel()[pair])])
        a, b = pair // n, pair % n
        for at in range(0, len(a), 1 << 17):
            i, j = a[at : at + (1 << 17)], b[at : at + (1 << 17)]
            s = np.einsum("ij,ij->i", queries[i], x[j])
            score[i, j] = s
            waiting[i, j] = s
        active = np.unique(q)
    return _verified(queries, x, *np.nonzero(score >= least - 1e-4), least)


def compared(queries: np.ndarray, x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (query, row) with a cosine of ``least`` or more."""
    found = [np.nonzero(queries[at : at + 512] @ x.T >= least - 1e-4) for at in range(0, len(queries), 512)]
    return _verified(queries, x, np.concatenate([a + 512 * k for k, (a, _) in enumerate(found)]), np.concatenate([b for _, b in found]), least)


def _verified(queries: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    exact = np.concatenate([np.empty(0), *[np.einsum("ij,ij->i", queries[a[k : k + (1 << 17)]], x[b[k : k + (1 << 17)]]) for k in range(0, len(a), 1 << 17)]])
    return a[exact >= least], b[exact >= least]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable by pairs, for indices below n."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def _placed(nodes: DataFrame, centroids, many: int) -> DataFrame:
    """Append the ``many`` nearest centroids of each node, nearest first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(batch.schema.get_field_index("raw")).to_pylist()
            near: list[list[int]] = [[] for _ in raw]
            for width in {len(r) for r in raw}:
                rows = [k for k, r in enumerate(raw) if len(r) == width]
                offset, c = centroids.value[width]
                order = (-(unit([raw[k] for k in rows]) @ c.T)).argsort(axis=1, kind="stable")[:, :many] + offset
                for k, o in zip(rows, order.tolist(), strict=True):
                    near[k] = o
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.list_(pa.int32()))], names=[*batch.schema.names, "near"])

    return nodes.mapInArrow(run, "raw array<double>, node bigint, copies bigint, near array<int>")


def _build(key, shard: pd.DataFrame) -> pd.DataFrame:
    x = unit(shard["raw"])
    ids = shard["node"].to_numpy()
    return pd.DataFrame({"node": ids, "next": [ids[g] for g in pruned_graph(x)]})


def _search(least: float, beam: int | None):
    def run(key, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(queries):
            return pd.DataFrame({"a": [], "b": [], "copies_a": [], "copies_b": []}, dtype="int64")
        ids = index["node"].to_numpy()
        place = {int(v): k for k, v in enumerate(ids)}
        x, q = unit(index["raw"]), unit(queries["raw"])
        own = queries["node"].to_numpy()
        if beam is None:
            a, b = compared(q, x, least)
        else:
            graph = [np.array([place[v] for v in lst if v in place], np.int64) for lst in index["next"]]
            a, b = range_search(q, x, graph, least, beam)
        other = own[a] != ids[b]
        a, b = a[other], b[other]
        names = np.unique(np.concatenate([own, ids]))
        u, v = np.searchsorted(names, own[a]), np.searchsorted(names, ids[b])
        root = _roots(len(names), u, v)
        moved = np.flatnonzero(root != np.arange(len(names)))
        # Each pair once in this shard, the smaller node first; both sides see the same vectors.
        pair = np.unique(np.minimum(u, v) * len(names) + np.maximum(u, v))
        low, high = pair // len(names), pair % len(names)
        copies = np.zeros(len(names), np.int64)
        copies[np.searchsorted(names, own)] = queries["copies"]
        copies[np.searchsorted(names, ids)] = index["copies"]
        none = np.zeros(len(moved), np.int64)
        return pd.DataFrame(
            {
                "a": np.concatenate([names[low], names[moved]]), "b": np.concatenate([names[high], names[root[moved]]]),
                "copies_a": np.concatenate([copies[low], none]), "copies_b": np.concatenate([copies[high], none]),
            }
        )

    return run


def _spread(df: DataFrame, counts: dict[int, int], size: int, column: str) -> DataFrame:
    """Append the number of parts of ``size`` rows that a cluster needs, from its counted rows."""
    parts = {c: -(-n // size) for c, n in counts.items() if n > size}
    known = F.create_map(*[F.lit(v) for kv in parts.items() for v in kv]) if parts else None
    return df.withColumn(column, F.coalesce(known[F.col("cluster")], F.lit(1)) if parts else F.lit(1))


def audit(nodes: DataFrame, total: int, links: DataFrame, least: float, rows: int = AUDIT_ROWS) -> Audit:
    """Recall over hashed nodes, until ``rows`` of them have true links or AUDIT_PAIRS are compared.

    If none has a true link, ``rows`` hashed nodes with found links are audited: a result
    that is not empty is never accepted unmeasured.  Every node with links weighs the
    same, and copies of a vector do not count.
    """
    width = nodes.agg(F.max(F.size("raw"))).first()[0] or 1
    most = min(total, max(rows, min(AUDIT_PAIRS // max(1, total), AUDIT_BYTES // (8 * width))))
    hashed = nodes.select("node", "raw", F.pmod(F.xxhash64("node"), F.lit(1 << 62)).alias("h"))
    shares: list[float] = []
    done, last = 0, -1

    def next_ones(source: DataFrame, size: int) -> list:
        chosen = source.where(F.col("h") > last).orderBy("h", "node").limit(size)
        return chosen.join(links, "node", "left").select("node", "raw", "h", F.coalesce("others", F.lit(0)).alias("n")).collect()

    def recalls(chosen: list) -> list[float]:
        true = _true_links(nodes, [(r["node"], r["raw"]) for r in chosen], least)
        return [min(r["n"], true[r["node"]]) / true[r["node"]] for r in chosen if true.get(r["node"])]

    while done < most and len(shares) < rows:
        chosen = next_ones(hashed, min(rows if done == 0 else 3 * done, most - done))
        if not chosen:
            break
        shares += recalls(chosen)
        done += len(chosen)
        last = max(r["h"] for r in chosen)
    if not shares:
        last = -1
        chosen = next_ones(hashed.join(links.select("node"), "node", "left_semi"), rows)
        shares = recalls(chosen) if chosen else []
        done += len(chosen) if shares else 0
    return Audit(float(np.mean(shares)) if shares else None, len(shares), done)


def _true_links(nodes: DataFrame, chosen: list[tuple], least: float) -> dict[int, int]:
    """How many other nodes are near enough to each chosen one, by comparison with all; bounded by the choice."""
    block = nodes.sparkSession.sparkContext.broadcast(chosen)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.array([i for i, _ in block.value])
        theirs: dict[int, list[int]] = {}
        for k, (_, v) in enumerate(block.value):
            theirs.setdefault(len(v), []).append(k)
        vectors = {width: unit([block.value[k][1] for k in rows]) for width, rows in theirs.items()}
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            raw, node = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for width in {len(r) for r in raw} & theirs.keys():
                mine = [k for k, r in enumerate(raw) if len(r) == width]
                x, asked = unit([raw[k] for k in mine]), np.array(theirs[width])
                for at in range(0, len(asked), 256):
                    part = asked[at : at + 256]
                    near = vectors[width][at : at + 256] @ x.T >= least
                    near &= ids[part][:, None] != node[mine][None]
                    total[part] += near.sum(axis=1)
        some = total > 0
        yield pa.RecordBatch.from_arrays([pa.array(ids[some], pa.int64()), pa.array(total[some])], names=["node", "n"])

    truth = nodes.select("raw", "node").mapInArrow(count, "node bigint, n bigint").groupBy("node").agg(F.sum("n").alias("n")).collect()
    block.unpersist()
    return {r["node"]: r["n"] for r in truth}


def linked_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = COSINE) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of ``vectors``.

    Vectors that are null, empty or zero, or hold null or non-finite components, and
    rows with a null key, link with nothing.  Vectors of different lengths do not link.
    Equal vectors link with each other.  Rows that repeat a key are one vector, of several
    the first by its numbers, and all have its result.  Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("raw"))
    chosen = materialize(one_per_id(rows), "vector-rows")
    nodes = materialize(nodes_of(chosen), "vector-nodes")
    total = nodes.count()
    share = min(1.0, SAMPLE_ROWS / max(1, total))
    sample = nodes.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int(share * (1 << 30))).select("node", "raw").toArrow().sort_by("node")["raw"].to_pylist()
    widths = sorted({r["w"] for r in nodes.select(F.size("raw").alias("w")).distinct().collect()})
    fitted, offset = {}, 0
    for width in widths:
        mine = [r for r in sample if len(r) == width]
        k = max(1, min(MOST_CENTROIDS, len(mine) // 8, round(total * len(mine) / max(1, len(sample)) / SHARD_ROWS)))
        c = fit_centroids(unit(mine), k) if mine else np.zeros((1, width))
        fitted[width] = (offset, c)
        offset += len(c)
    centroids = spark.sparkContext.broadcast(fitted)
    probes, beam = PROBES, BEAM
    while True:
        links, edges = _linked(nodes, centroids, probes, beam, least)
        result = audit(nodes, total, links, least)
        log.warning("vector links: %s, %d shards visited, beam %s", result, min(probes, offset), beam)
        if beam is None or result.recall is None or result.recall >= AUDIT_RECALL:
            break
        if probes < offset:
            probes *= 2
        else:
            beam = 4 * beam if beam < SHARD_ROWS // 2 else None
    found = components(edges, "vector-components")
    per_node = nodes.select("raw", "node", "copies").join(links, "node", "left").join(found, "node", "left")
    per_node = per_node.select("raw", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    per_id = chosen.join(per_node, "raw").select(F.col("id").alias("of"), "n_links", "component")
    joined = rows.select("id").join(per_id, F.col("id") == F.col("of"), "left")
    component = F.coalesce("component", "id")
    return joined.select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept")
    )


def _linked(nodes: DataFrame, centroids, probes: int, beam: int | None, least: float) -> tuple[DataFrame, DataFrame]:
    """Per-node link counts, and edges that connect what is linked."""
    near = materialize(_placed(nodes, centroids, probes), "vector-placed")
    at_home = near.select("node", "raw", "copies", F.explode(F.slice("near", 1, HOMES)).alias("cluster"))
    visiting = near.select("node", "raw", "copies", F.explode("near").alias("cluster"))
    # A row per centroid: bounded by MOST_CENTROIDS for each vector length.
    homes = {r["cluster"]: r["count"] for r in at_home.groupBy("cluster").count().collect()}
    visits = {r["cluster"]: r["count"] for r in visiting.groupBy("cluster").count().collect()}
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    index = _spread(at_home, homes, SHARD_ROWS * 2, "blocks").withColumn("block", part("blocks"))
    graph = index.groupBy("cluster", "block").applyInPandas(_build, "node bigint, next array<bigint>")
    united = graph.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("next"))
    index = materialize(index.join(united, "node"), "vector-graph")
    index = _spread(index, visits, SHARD_ROWS * 2, "chunks").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    queries = _spread(visiting, visits, SHARD_ROWS * 2, "chunks").withColumn("chunk", part("chunks"))
    queries = _spread(queries, homes, SHARD_ROWS * 2, "blocks").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["cluster", "block", "chunk"]
    found = index.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(_search(least, beam), "a bigint, b bigint, copies_a bigint, copies_b bigint")
    found = materialize(found, "vector-links")
    # Edges of the components have no copies; the same pair comes from several shards.
    pairs = found.where("copies_a > 0").groupBy("a", "b").agg(F.first("copies_a").alias("copies_a"), F.first("copies_b").alias("copies_b"))
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("copies_b").alias("n")), F.struct(F.col("b").alias("node"), F.col("copies_a").alias("n")))).alias("e"))
    links = ends.groupBy("e.node").agg(F.sum("e.n").alias("n"), F.count("*").alias("others"))
    return materialize(links, "vector-counts"), found.where("copies_a = 0").select("a", "b")
