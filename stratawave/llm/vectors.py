"""Embedding near-dedup by a robust-pruned flat graph.

Equal vectors of a label are one node.  Nodes are dealt to the shards of their nearest centres, so shards overlap.  Each
shard builds its part of the graph; the adjacency lists of a node are united.  Each shard then searches for the nodes
that it is nearest to, from its medoid and from the node itself, over the united lists: greedily towards the node,
and on through everything that is near enough.  Every link found is verified in double precision.  Where the audit finds too few links, every node
visits all shards that can hold a link of it, so the result is whole.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, stored, summed, table

NEAR = 0.98
#: Nodes for each centre, centres at most, and shards for each node.
SHARD, MOST_CENTRES, OVERLAP = 1000, 8192, 2
#: Candidates and neighbours of a node, and the slack of the pruning rule.
CANDIDATES, DEGREE, SLACK = 48, 24, 1.2
#: Nodes that a search opens on its way, besides all that are near enough.
STEPS = 12
#: Audit: queries of each kind compared with all rows, and the recall below which the graph's links are completed.
AUDITED, RECALL = 200, 0.99
#: Visitors that a task of the completion compares with a shard, and those of one product.
VISITORS, BLOCK = 4096, 512


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pruned(x: np.ndarray, candidates: int = CANDIDATES, degree: int = DEGREE, slack: float = SLACK, block: int = 512) -> np.ndarray:
    """Neighbours of each row of unit vectors, -1 where there are fewer.

    Candidates are the nearest rows.  The nearest one left becomes a neighbour, and those that are nearer to it
    than to the row by the factor ``slack`` are left out, as it leads to them.
    """
    n = len(x)
    k = min(candidates, n - 1)
    out = np.full((n, min(degree, k)), -1, np.int64)
    for start in range(0, n, block) if k else ():
        q = x[start:start + block]
        rows = np.arange(len(q))
        sim = q @ x.T
        sim[rows, start + rows] = -np.inf
        near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sim, near, 1), axis=1, kind="stable"), 1)
        away = 1 - np.take_along_axis(sim, near, 1)
        y = x[near]
        between = 1 - y @ y.transpose(0, 2, 1)
        open_ = np.ones(near.shape, bool)
        for i in range(out.shape[1]):
            at = open_.argmax(axis=1)
            some = open_[rows, at]
            out[start + rows[some], i] = near[rows[some], at[some]]
            open_ &= slack * between[rows, at] > away
            open_[rows, at] = False
    return out


def both_ways(lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, to): the lists with every edge in both directions; row i has ``to[starts[i]:starts[i + 1]]``.

    Rows of a dense group that are nearest to nobody would otherwise never be reached.
    """
    n = len(lists)
    at, column = np.nonzero(lists >= 0)
    other = lists[at, column]
    pairs = np.unique(np.concatenate([at * n + other, other * n + at]))
    return np.searchsorted(pairs, np.arange(n + 1) * n), pairs % n


def search(x: np.ndarray, starts: np.ndarray, to: np.ndarray, queries: np.ndarray, near: float = NEAR, steps: int = STEPS, block: int = 64):
    """Yields (query, found) index arrays: rows with cosine ``near`` or more to each query, itself left out.

    Row i leads to ``to[starts[i]:starts[i + 1]]``.
    """
    degrees = np.diff(starts)
    n = len(x)
    middle = x.mean(axis=0)
    medoid = int((x @ middle).argmax())
    for start in range(0, len(queries), block):
        q = queries[start:start + block]
        rows = np.arange(len(q))
        sim = np.full((len(q), n), -np.inf)
        todo = np.zeros((len(q), n), bool)
        sim[rows, medoid] = x[q] @ x[medoid]
        sim[rows, q] = 1.0
        todo[rows, medoid] = todo[rows, q] = True
        for step in range(n + steps):
            opened = todo & (sim >= near)
            if step < steps:
                best = np.where(todo, sim, -np.inf).argmax(axis=1)
                opened[rows, best] = todo[rows, best]
            at, node = np.nonzero(opened)
            if not len(at):
                break
            todo[at, node] = False
            new = np.zeros((len(q), n), bool)
            k = degrees[node]
            new[np.repeat(at, k), to[np.repeat(starts[node] - np.cumsum(k) + k, k) + np.arange(k.sum())]] = True
            at, node = np.nonzero(new & (sim == -np.inf))
            sim[at, node] = np.einsum("ij,ij->i", x[q[at]], x[node])
            todo[at, node] = True
        sim[rows, q] = -np.inf
        at, node = np.nonzero(sim >= near)
        yield q[at], node


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n indices reaches over the links (a, b)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            return root


def nodes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (row, vec_id, label, embedding, linkable) and nodes (node, label, size, embedding, times, at)."""
    e = F.col("embedding")
    fine = F.col("label").isNotNull() & e.isNotNull() & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    rows = stored(vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.transform(e, lambda v: v.cast("double") + 0.0).alias("embedding"), F.coalesce(fine, F.lit(False)).alias("linkable")), "vectors")
    groups = rows.filter("linkable").groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("times"), F.min("vec_id").alias("least"))
    nodes = groups.withColumn("node", F.monotonically_increasing_id()).withColumn("size", F.size("embedding"))
    nodes = stored(nodes, "vector-nodes")
    return rows, nodes.withColumn("place", F.shiftrightunsigned(F.xxhash64("label", "embedding"), 11) / float(1 << 53))


def centres_of(nodes: DataFrame, per_centre: int, most: int) -> tuple[DataFrame, pd.DataFrame]:
    """(nodes to deal, centres): a group is the nodes of one label and vector length.

    A group of one node has no links and is not dealt.  A group that fits a shard is one, ``alone``.  Larger groups have
    centres: a sample of their nodes by hash, at least one for each.  As every such group holds over n / ``most`` nodes, the
    centres number about 2 * ``most`` at most, however many labels there are.
    """
    room = max(per_centre, ceil(nodes.count() / most))
    groups = stored(nodes.groupBy("label", "size").agg(F.count(F.lit(1)).alias("n_group"), F.min("place").alias("first"), F.min("node").alias("least_node")), "vector-groups")
    groups = groups.filter("n_group > 1").withColumn("alone", F.when(F.col("n_group") <= room, -1 - F.col("least_node")))
    marked = nodes.join(groups.drop("n_group", "least_node"), ["label", "size"])
    chosen = marked.filter(F.col("alone").isNull() & ((F.col("place") < 1.0 / room) | (F.col("place") == F.col("first"))))
    centres = chosen.select("label", "size", "embedding", "place").dropDuplicates(["label", "size", "place"]).orderBy("label", "size", "place").toPandas()
    return marked.drop("first"), centres


def dealt(marked: DataFrame, centres: pd.DataFrame, overlap: int) -> DataFrame:
    """(shard, own, node, times, embedding): every node in the shards of its nearest centres, ``own`` in the nearest one's."""
    by_key = {}
    for key, group in centres.groupby(["label", "size"]):
        by_key[key] = (group.index.to_numpy(), _unit(group["embedding"].to_list()))
    shared = marked.sparkSession.sparkContext.broadcast(by_key)

    def deal(source):
        for frame in source:
            for key, group in frame.groupby(["label", "size"]):
                shards, c = shared.value[key]
                x = _unit(group["embedding"].to_list())
                order = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :overlap]
                for i in range(order.shape[1]):
                    yield pd.DataFrame({"shard": shards[order[:, i]], "own": i == 0, "node": group["node"], "times": group["times"], "embedding": group["embedding"]})

    alone = marked.filter("alone IS NOT NULL").select(F.col("alone").alias("shard"), F.lit(True).alias("own"), "node", "times", "embedding")
    spread = marked.filter("alone IS NULL").select("label", "size", "node", "times", "embedding")
    return alone.union(spread.mapInPandas(deal, "shard long, own boolean, node long, times long, embedding array<double>"))


def graph(members: DataFrame) -> DataFrame:
    """(node, neighbours): the united adjacency lists of all shards, with edges in both directions."""
    def build(group: pd.DataFrame) -> pd.DataFrame:
        names = group["node"].to_numpy()
        starts, to = both_ways(pruned(_unit(group["embedding"].to_list())))
        return pd.DataFrame({"node": names, "to": np.split(names[to], starts[1:-1])})

    lists = members.select("shard", "node", "embedding").groupBy("shard").applyInPandas(build, "node long, to array<long>")
    return lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("to"))).alias("neighbours"))


def found_links(nodes: DataFrame, members: DataFrame, lists: DataFrame) -> DataFrame:
    """(node, n, root): for a searched node the rows linked to it, null for others; the least node linked in the shard."""
    own = members.filter("own").select("shard", "node")
    reached = own.join(lists, "node").select("shard", F.explode("neighbours").alias("node"), F.lit(False).alias("own"))
    held = members.select("shard", "node", "own").union(reached).groupBy("shard", "node").agg(F.max("own").alias("own"))
    full = held.join(nodes.select("node", "times", "embedding"), "node").join(lists, "node", "left")

    def look(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node", ignore_index=True)
        names, times = group["node"].to_numpy(), group["times"].to_numpy()
        lists = [np.zeros(0, np.int64) if x is None else x for x in group["neighbours"]]
        wanted = np.concatenate(lists)
        at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
        held = names[at] == wanted
        starts = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(np.arange(len(lists)), [len(x) for x in lists])[held], minlength=len(lists)))])
        to = at[held]
        counts, a, b = np.zeros(len(group), np.int64), [], []
        for q, other in search(_unit(group["embedding"].to_list()), starts, to, np.flatnonzero(group["own"].to_numpy())):
            np.add.at(counts, q, times[other])
            a.append(q)
            b.append(other)
        root = _roots(len(group), np.concatenate(a), np.concatenate(b)) if a else np.arange(len(group))
        out = pd.DataFrame({"node": names, "n": pd.array(counts, "Int64"), "root": names[root]})
        out.loc[~group["own"].to_numpy(), "n"] = pd.NA
        return out[group["own"].to_numpy() | (root != np.arange(len(group)))]

    return full.groupBy("shard").applyInPandas(look, "node long, n long, root long")


def audit(nodes: DataFrame, counts: DataFrame, audited: int = AUDITED) -> float:
    """Share of their links that the search has found for audited nodes, held against all nodes.

    About ``audited`` of all nodes and as many of those with links are chosen by hash.  The result is the smaller of the
    share of all their links and the mean of the nodes' shares, as dense groups weigh most in the first, small ones in the second.
    """
    known = nodes.join(counts, "node")
    n, linked = known.agg(F.count(F.lit(1)), F.count(F.when(F.col("n") > 0, 1))).first()
    chosen = (F.col("place") < audited / max(1, n)) | ((F.col("n") > 0) & (F.col("place") < audited / max(1, linked)))
    sample = known.filter(chosen).select("label", "size", "node", "embedding", "n").toPandas()
    if sample.empty:
        return 1.0
    by_key = {key: (g.index.to_numpy(), g["node"].to_numpy(), _unit(g["embedding"].to_list())) for key, g in sample.groupby(["label", "size"])}

    def exact(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros((1, len(sample)))
        frame = batch.to_pandas()
        for key, group in frame.groupby(["label", "size"]):
            if key in by_key:
                at, names, q = by_key[key]
                near = (q @ _unit(group["embedding"].to_list()).T >= NEAR) & (names[:, None] != group["node"].to_numpy()[None, :])
                total[0, at] += near @ group["times"].to_numpy()
        return total

    truth = summed(nodes.select("label", "size", "node", "times", "embedding"), exact)[0]
    some = truth > 0
    if not some.any():
        return 1.0
    got, truth = np.minimum(sample["n"].to_numpy()[some], truth[some]), truth[some]
    return float(min(got.sum() / truth.sum(), (got / truth).mean()))


def completed(marked: DataFrame, centres: pd.DataFrame) -> DataFrame:
    """(node, n, root) as of ``found_links``, with all links of all nodes.

    Every node lives in the shard of its nearest centre.  A link spans an angle of at most t = arccos(NEAR), so the home of
    a linked node is at most 2t farther from a node than its own centre is, and its centre is no farther than t beyond the
    widest member of that shard; groups that fit a shard are one.  A node visits the shards that both bounds allow.  Visitors of a shard are
    split into tasks of about ``VISITORS``, each with the shard's members; a task keeps counts and one root for each row, never pairs.
    """
    turn, rounding = float(np.arccos(NEAR)), 1e-6
    by_key = {key: (g.index.to_numpy(), _unit(g["embedding"].to_list())) for key, g in centres.groupby(["label", "size"])}
    context = marked.sparkSession.sparkContext
    shared = context.broadcast(by_key)

    def angles(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(x @ c.T, -1, 1))

    def settle(source):
        for frame in source:
            for key, group in frame.groupby(["label", "size"]):
                shards, c = shared.value[key]
                away = angles(_unit(group["embedding"].to_list()), c)
                at = away.argmin(axis=1)
                yield pd.DataFrame({"shard": shards[at], "node": group["node"], "away": away.min(axis=1)})

    given = marked.select("label", "size", "node", "times", "embedding")
    spread = marked.filter("alone IS NULL").select(given.columns)
    homes = stored(spread.mapInPandas(settle, "shard long, node long, away double"), "vector-homes")
    widest = dict(homes.groupBy("shard").agg(F.max("away")).toPandas().itertuples(index=False))  # one row a centre
    reach = context.broadcast({key: np.array([widest.get(s, -np.inf) for s in shards]) for key, (shards, _) in by_key.items()})

    def visit(source):
        for frame in source:
            for key, group in frame.groupby(["label", "size"]):
                shards, c = shared.value[key]
                for i in range(0, len(group), BLOCK):
                    part = group.iloc[i:i + BLOCK]
                    away = angles(_unit(part["embedding"].to_list()), c)
                    at, to = np.nonzero(away <= np.minimum(away.min(axis=1)[:, None] + 2 * turn, reach.value[key] + turn) + rounding)
                    yield pd.DataFrame({"shard": shards[to], "node": part["node"].to_numpy()[at]})

    one = marked.filter("alone IS NOT NULL").select(F.col("alone").alias("shard"), "node")
    visits = stored(spread.mapInPandas(visit, "shard long, node long").union(one), "vector-visits")
    rooms = stored(visits.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / VISITORS).alias("tasks")), "vector-rooms")
    tasks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("task")
    members = homes.select("shard", "node").union(one).join(rooms, "shard").select("shard", tasks, "node", F.lit(True).alias("own"))
    guests = visits.join(rooms, "shard").select("shard", F.pmod(F.xxhash64("node"), F.col("tasks")).alias("task"), "node", F.lit(False).alias("own"))
    full = members.union(guests).join(given.select("node", "times", "embedding"), "node")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        own = group["own"].to_numpy()
        home, guest = group[own], group[~own]
        x, names, times = _unit(home["embedding"].to_list()), home["node"].to_numpy(), home["times"].to_numpy()
        every, at = np.unique(np.concatenate([names, guest["node"].to_numpy()]), return_inverse=True)
        mine, theirs = at[:len(home)], at[len(home):]
        root, counts = np.arange(len(every)), np.zeros(len(guest), np.int64)
        for i in range(0, len(guest), BLOCK):
            part = guest.iloc[i:i + BLOCK]
            near = (_unit(part["embedding"].to_list()) @ x.T >= NEAR) & (part["node"].to_numpy()[:, None] != names[None, :])
            counts[i:i + BLOCK] = near @ times
            q, other = np.nonzero(near)
            a, b = root[theirs[i + q]], root[mine[other]]
            root = _roots(len(every), a, b)[root]
        out = pd.DataFrame({"node": guest["node"].to_numpy(), "n": pd.array(counts, "Int64"), "root": every[root[theirs]]})
        rest = pd.DataFrame({"node": names, "n": pd.array([pd.NA] * len(names), "Int64"), "root": every[root[mine]]})
        return pd.concat([out[counts > 0], rest[rest["root"] != rest["node"]]])

    found = stored(full.groupBy("shard", "task").applyInPandas(compare, "node long, n long, root long"), "vector-completed")
    sums = found.groupBy("node").agg(F.sum("n").alias("n")).filter("n IS NOT NULL")
    return sums.select("node", "n", F.col("node").alias("root")).union(found.select("node", F.lit(None).cast("long").alias("n"), "root").distinct())


def near_duplicates(vectors: DataFrame, per_centre: int = SHARD, overlap: int = OVERLAP) -> tuple[DataFrame, float]:
    """((vec_id, n_links, component_id, kept), audited recall) of each row of vectors (vec_id, embedding, label).

    * Only rows with equal labels that are not null are compared, and only vectors of one length.
    * Vectors that are null, empty, zero or hold null or non-finite values link with nothing and stay.
    * Equal vectors are one node and count as links of each other; they are not expanded into pairs.
    * n_links: rows linked directly; component_id: least vec_id over links.  Repeated ids are rows of their own.
    * Centres are a sample of about 2 * MOST_CENTRES nodes at most; every node with others of its label is indexed and searched.  If the
      audit finds fewer than RECALL of the links, ``completed`` adds all that are missing and the recall is audited again.
    """
    rows, nodes = nodes_of(vectors)
    marked, centres = centres_of(nodes, per_centre, MOST_CENTRES)
    members = stored(dealt(marked, centres, overlap), "vector-shards")
    lists = stored(graph(members), "vector-graph")
    links = stored(found_links(nodes, members, lists), "vector-links")
    recall = audit(nodes, links.filter("n IS NOT NULL").select("node", "n"))
    if recall < RECALL:
        links = stored(links.union(completed(marked, centres)), "vector-links")
        recall = audit(nodes, links.filter("n IS NOT NULL").groupBy("node").agg(F.max("n").alias("n")))
    parts = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")), "vectors")
    counts = links.groupBy("node").agg(F.max("n").alias("n"))
    named = nodes.select("node", "label", "embedding", "times", "least").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")).join(counts, "node", "left")
    named = stored(named, "vector-parts")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    known = named.join(least, "component").select("label", "embedding", F.lit(True).alias("linkable"), "component_id", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    joined = rows.join(known, ["label", "embedding", "linkable"], "left")
    component = F.when(F.col("linkable"), F.col("component_id")).otherwise(F.col("vec_id"))
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    ), recall


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))[0]
