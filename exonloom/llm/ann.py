"""Approximate nearest neighbours by inner product over robust-pruned graphs, one for each shard.

Equal vectors are one node with its smallest ids, so a group of copies costs one node and loses none that a
result could hold.  Nodes are dealt to shards of bounded size by a hash.  In a shard, batches of nodes search
the graph as it stands; the nodes a search has met are the proposed neighbours, and robust pruning keeps a
near one only if no kept one is nearer to it by the factor ``alpha``, so edges point in different directions
and some stay long.  Edges are added both ways and pruned again where a node has too many.

A query runs a beam search in every shard; the best of all shards are merged.  Shards and blocks of queries are
met in one task per pair, so neither side has to fit a task as a whole.

A fixed extra coordinate gives all nodes the same length, so that the largest inner product is the least
distance.  Scores are computed anew from the original vectors in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exonloom.session import cut_lineage

SHARD, BLOCK = 4096, 8192
DEGREE, BUILD_BEAM, BEAM, ALPHA, BATCH = 24, 48, 112, 1.2, 256


def beam_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, entry: int, beam: int):
    """Nearest found and all expanded nodes of each query: ``(ids, distances, expanded)``, -1 where there is none.

    ``graph`` has a row of neighbours for each node, -1 for none.  Distance is ``|x|^2 - 2 x.q``.
    """
    b, n = len(queries), len(x)
    norms = np.einsum("ij,ij->i", x, x)
    ids = np.full((b, beam), -1, np.int32)
    dist = np.full((b, beam), np.inf, np.float32)
    done = np.ones((b, beam), bool)
    seen = np.zeros((b, n), bool)
    ids[:, 0], dist[:, 0], done[:, 0] = entry, norms[entry] - 2 * queries @ x[entry], False
    seen[:, entry] = True
    expanded = []
    rows = np.arange(b)
    while len(rows):
        open_ = np.where(done[rows], np.inf, dist[rows])
        at = open_.argmin(1)
        more = np.isfinite(open_[np.arange(len(rows)), at])
        rows, at = rows[more], at[more]
        if not len(rows):
            break
        done[rows, at] = True
        node = ids[rows, at]
        step = np.full(b, -1, np.int32)
        step[rows] = node
        expanded.append(step)
        near = graph[node]
        fresh = (near >= 0) & ~seen[rows[:, None], near]
        seen[np.repeat(rows, near.shape[1])[fresh.ravel()], near.ravel()[fresh.ravel()]] = True
        d = norms[near] - 2 * np.einsum("ijk,ik->ij", x[near], queries[rows])
        d[~fresh] = np.inf
        all_d = np.concatenate([dist[rows], d], axis=1)
        all_i = np.concatenate([ids[rows], np.where(fresh, near, -1)], axis=1)
        all_done = np.concatenate([done[rows], ~fresh], axis=1)
        best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        dist[rows] = np.take_along_axis(all_d, best, 1)
        ids[rows] = np.take_along_axis(all_i, best, 1)
        done[rows] = np.take_along_axis(all_done, best, 1)
    return ids, dist, np.stack(expanded, axis=1) if expanded else np.zeros((b, 0), np.int32)


def robust_prune(x: np.ndarray, nodes: np.ndarray, proposed: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node at most ``degree`` of its proposed neighbours (-1: none), near and in different directions."""
    c = np.sort(proposed, axis=1)
    c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
    c[c == nodes[:, None]] = -1
    v = x[c]
    p = x[nodes]
    d = np.einsum("ijk,ijk->ij", v - p[:, None], v - p[:, None])
    d[c < 0] = np.inf
    out = np.full((len(nodes), degree), -1, np.int32)
    alive = d.copy()
    norms = np.einsum("ijk,ijk->ij", v, v)
    rows = np.arange(len(nodes))
    for k in range(degree):
        at = alive.argmin(1)
        ok = np.isfinite(alive[rows, at])
        if not ok.any():
            break
        out[ok, k] = c[rows, at][ok]
        star = v[rows, at]
        between = norms + norms[rows, at][:, None] - 2 * np.einsum("ijk,ik->ij", v, star)
        alive[(alpha * alpha) * between <= d] = np.inf
        alive[rows, at] = np.inf
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 5) -> tuple[np.ndarray, int]:
    """Neighbours of each node (-1: none) and the node where searches begin."""
    n = len(x)
    rng = np.random.default_rng(seed)
    room = degree + degree // 2
    graph = np.full((n, room), -1, np.int32)
    if n == 1:
        return graph, 0
    first = rng.integers(0, n, (n, min(degree, n - 1)))
    first[first == np.arange(n)[:, None]] = -1
    graph[:, : first.shape[1]] = first
    entry = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    for a in (1.0, alpha):
        order = rng.permutation(n)
        for s in range(0, n, BATCH):
            nodes = order[s : s + BATCH]
            ids, _, expanded = beam_search(x, graph, x[nodes], entry, min(beam, n))
            kept = robust_prune(x, nodes, np.concatenate([ids, expanded, graph[nodes]], axis=1), degree, a)
            graph[nodes] = -1
            graph[nodes, :degree] = kept
            back = np.stack([kept.ravel(), np.repeat(nodes, degree)], axis=1)
            back = back[back[:, 0] >= 0]
            back = back[np.argsort(back[:, 0], kind="stable")]
            to, begin, count = np.unique(back[:, 0], return_index=True, return_counts=True)
            wide = np.full((len(to), room + int(count.max(initial=0))), -1, np.int32)
            wide[:, :room] = graph[to]
            within = np.arange(len(back)) - np.repeat(begin, count)
            wide[np.repeat(np.arange(len(to)), count), room + within] = back[:, 1]
            wide = -np.sort(-wide, axis=1)
            wide[:, 1:][wide[:, 1:] == wide[:, :-1]] = -1
            degree_of = (wide >= 0).sum(1)
            fits = degree_of <= room
            graph[to[fits]] = -np.sort(-wide[fits], axis=1)[:, :room]
            if (~fits).any():
                graph[to[~fits]] = -1
                graph[to[~fits], :degree] = robust_prune(x, to[~fits], wide[~fits], degree, a)
    return graph, entry


# ------------------------------------------------------------------ over Spark

def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``(id, v)`` of the rows with an id and a vector of finite numbers that is not zero."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall("v", lambda x: x == 0)
    rows = rows.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null")
    return rows.filter(~bad).filter(~zero)


def nodes_of(rows: DataFrame, keep: int, salts: int = 32) -> DataFrame:
    """``(v, ids)``: distinct vectors with their ``keep`` smallest ids, taken in two steps so that no group is one task."""
    salted = rows.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(salts)))
    for by in (("v", "s"), ("v",)):
        place = F.row_number().over(Window.partitionBy(*by).orderBy("id"))
        salted = salted.withColumn("r", place).filter(F.col("r") <= keep).drop("r")
    return salted.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def index(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", keep: int = 21, shard: int = SHARD) -> DataFrame:
    """The graphs as a stored table ``(dim, shard, node, v, ids, near, entry)``.

    Every usable vector is in it.  Vectors of different dimension are in different shards and never compared.
    Null, zero and non-finite vectors and null ids are left out.  Vectors of one shard differ in length by a factor
    of four at most, so that a long one never hides what tells the others apart.
    """
    nodes = cut_lineage(nodes_of(usable(rows, key, vector), keep))
    large = F.array_max(F.transform("v", F.abs))
    squares = F.aggregate(F.transform("v", lambda x: x / F.col("large")), F.lit(0.0), lambda s, x: s + x * x)
    nodes = nodes.withColumns({"dim": F.size("v"), "large": large})
    nodes = nodes.withColumn("band", F.floor((F.log2("large") + F.log2(squares) / 2) / 2).cast("int")).drop("large")
    counts = nodes.groupBy("dim", "band").agg(F.count("*").alias("n"))  # some hundred bands of a dimension at most
    shards = cut_lineage(counts.select("dim", "band", F.ceil(F.col("n") / shard).alias("m")))
    place = F.concat_ws(":", "band", F.pmod(F.xxhash64("v"), F.col("m")))
    nodes = nodes.join(shards, ["dim", "band"]).withColumn("shard", place).select("dim", "shard", "v", "ids")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ids", key=lambda c: c.map(lambda x: x[0]), ignore_index=True)
        graph, entry = build(equalised(np.stack(frame["v"].to_list())))
        return pd.DataFrame(
            {"dim": frame["dim"], "shard": frame["shard"], "node": np.arange(len(frame), dtype=np.int32), "v": frame["v"], "ids": frame["ids"],
             "near": [g[g >= 0] for g in graph], "entry": np.int32(entry)}
        )

    schema = "dim int, shard string, node int, v array<double>, ids array<long>, near array<int>, entry int"
    return cut_lineage(nodes.groupBy("dim", "shard").applyInPandas(run, schema))


def search(graphs: DataFrame, queries: DataFrame, k: int = 20, beam: int = BEAM, block: int = BLOCK) -> DataFrame:
    """``(id, rank, vec_id, score)``: the ``k`` nearest found for each of ``queries(id, v)``, the own id left out.

    Nearest first, equal scores by smaller id; fewer rows if there are fewer candidates.  ``graphs`` must keep more
    than ``k`` ids a node.  Equal queries are searched once.
    """
    asked = cut_lineage(queries.groupBy("v").agg(F.min("id").alias("q")))
    blocks = max(1, math.ceil(asked.count() / block))
    shards = graphs.select(F.col("dim").alias("q_dim"), F.col("shard").alias("q_shard")).distinct()
    left = asked.withColumn("q_dim", F.size("v")).withColumn("q_block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int"))
    left = left.join(shards, "q_dim")
    right = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(q: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        out = {"q": [], "vec_id": [], "score": []}
        if len(q) and len(g):
            g = g.sort_values("node", ignore_index=True)
            full = np.stack(g["v"].to_list())
            x = equalised(full)
            graph = np.full((len(x), max(1, max(map(len, g["near"])))), -1, np.int32)
            for i, near in enumerate(g["near"]):
                graph[i, : len(near)] = near
            entry, ids_of = int(g["entry"][0]), g["ids"].to_list()
            for s in range(0, len(q), BATCH):
                part = q.iloc[s : s + BATCH]
                qv = np.stack(part["v"].to_list())
                found, _, _ = product_search(x, graph, qv, entry, min(max(beam, k + 1), len(x)))
                for name, v, row in zip(part["q"], qv, found, strict=True):
                    row = row[row >= 0]
                    score = full[row] @ v
                    best = np.lexsort((row, -score))[: k + 1]
                    ids = np.concatenate([ids_of[i] for i in row[best]])
                    scores = np.repeat(score[best], [len(ids_of[i]) for i in row[best]])
                    top = np.lexsort((ids, -scores))[: k + 1]
                    out["q"].append(np.full(len(top), name))
                    out["vec_id"].append(ids[top])
                    out["score"].append(scores[top])
        made = {c: np.concatenate(x) if x else np.zeros(0) for c, x in out.items()}
        return pd.DataFrame(made).astype({"q": "int64", "vec_id": "int64", "score": "float64"})

    pair = left.groupBy("q_dim", "q_shard", "q_block").cogroup(right.groupBy("dim", "shard", "block"))
    met = pair.applyInPandas(run, "q long, vec_id long, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    near = met.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r")
    own = queries.join(asked, "v").select("id", "q")
    order = Window.partitionBy("id").orderBy(F.desc("score"), "vec_id")
    out = own.join(near, "q").filter("vec_id <> id").withColumn("rank", F.row_number().over(order))
    return out.filter(F.col("rank") <= k).select("id", "rank", "vec_id", "score")


def equalised(x: np.ndarray) -> np.ndarray:
    """The vectors of a shard over the longest's length, with one more coordinate that makes all equally long."""
    x = x / np.abs(x).max()
    x /= np.sqrt((x * x).sum(1).max())
    return np.column_stack([x, np.sqrt(np.maximum(1 - (x * x).sum(1), 0))]).astype(np.float32)


def product_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, entry: int, beam: int):
    """Beam search by largest inner product among ``equalised`` vectors."""
    size = np.abs(queries).max(1, keepdims=True)
    unit = queries / size
    unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
    return beam_search(x, graph, np.column_stack([unit, np.zeros(len(unit))]).astype(np.float32), entry, beam)


def nearest(rows: DataFrame, asked: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the rows ``asked`` against all ``rows``; see ``index`` and ``search``.

    Repeated rows of an id count once each as candidates; an empty table gives an empty result.
    """
    found = search(index(rows, key, vector, k + 1), usable(asked, key, vector), k)
    return found.select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")
