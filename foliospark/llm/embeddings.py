"""Operator 9: near-duplicate embeddings by a robust-pruned flat graph on overlapping cluster shards.

Valid vectors are scaled to length 1 and equal ones become one node with a weight. Nodes are clustered
(k-means on a bounded sample) and each goes to its OVERLAP nearest clusters; clusters of more than
MOST_IN_SHARD nodes are clustered again, all of a level at once and each by a task of its own, until none is left. There only a node's
nearest cluster deals it to several, so its copies grow by one a level. Nodes meet their cluster's centres DEALT at a time.
A cluster that k-means doesn't part (nodes of all but one direction) is dealt by hashes instead. Each shard builds a graph: for a node its nearest nodes of the
shard, robustly pruned (a node closer to a kept neighbour than to the node, by ALPHA, is dropped).
Adjacency lists of a node from all its shards are united. Then every node searches in its first shard,
whose nodes come with their united lists and the vectors those lists name: a greedy search from the
shard's medoid, and the node's own list, with a beam of WIDTH, then from all that is in range outwards
as long as neighbours are within SLACK of the range. Links are verified in double precision. A node's links
are counted in its first shard: a query that has a node of another first shard in range goes on there, where
it meets all the shard's nodes and those they name, until no shard is new to it.

Recall is audited against brute force for a bounded sample of nodes, drawn by hash whatever the search found,
against all rows. It counts links between different nodes only, as equal vectors are linked without a search,
and is the lesser of the share of links and of the mean share of a node's links. Below
LEAST_RECALL the beam doubles and the search is repeated, and at last every query goes to every shard. A task joins links by union and find and
hands on a spanning forest, so no group is expanded to pairs outside the task; counts are per node.

Bounds: SAMPLE vectors and CENTRES centroids for a cluster that is split, in the task that splits it; AUDITED
vectors in the driver and in a broadcast.

Defined cases: null, empty, zero vectors and such with null, NaN or infinite components link with
nothing and are their own component; tiny and huge components are as good as others, since a vector is divided by its largest
before squares are taken; pairs at the threshold, as double precision has it, are links; vectors link with those of their length only, in shards of their own;
equal vectors link with one another; repeated vec_ids are rows of their own; a null vec_id takes part but names a component only if all others there are null;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.components import components
from foliospark.session import discard, materialize, ship_package

THRESHOLD = 0.9
IN_SHARD, MOST_IN_SHARD, OVERLAP = 1_000, 4_000, 2
DEGREE, NEAREST, ALPHA = 24, 64, 1.2
WIDTH, SLACK = 16, 0.08
SAMPLE, CENTRES, DEALT = 20_000, 1_024, 20_000
AUDITED, LEAST_RECALL = 1_000, 0.9


def nodes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rid, vec_id, unit) of all rows (unit null if it can't link), and (node, least, weight, unit) of distinct ones."""
    v = F.col("embedding").cast("array<double>")
    unusable = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    largest = F.array_max(F.transform(v, lambda x: F.abs(x)))
    rows = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), F.when(~unusable & (largest > 0), F.transform(v, lambda x: x / largest)).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.select("rid", "vec_id", F.transform("v", lambda x: x / norm).alias("unit"))
    rows = materialize(rows)
    nodes = rows.where("unit is not null").groupBy("unit").agg(F.min("rid").alias("node"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"))
    return rows, materialize(nodes.select("node", "least", "weight", "unit"))


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centroids of length 1 for the largest cosine."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.linalg.norm(sums, axis=1)
        c = np.where(n[:, None] > 1e-12, sums / np.maximum(n, 1e-12)[:, None], c)
    return c


def _stack(column) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in column])


def centres_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """(shard, k, centre) of a sample (shard, k, node, unit) of one shard."""
    pdf = pdf.sort_values("node")
    k = int(pdf["k"].iloc[0])
    return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "k": [k], "centre": [[c.tolist() for c in kmeans(_stack(pdf["unit"]), k)]]})


def deal(pdf: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
    """Nodes of one shard in shards named behind it: the nearest centres, or by hashes if there are none."""
    out = pdf.iloc[:0][["node", "unit", "shard", "first", "above"]]
    if not len(pdf) or not len(centres):
        return out
    k, centre, first = int(centres["k"].iloc[0]), centres["centre"].iloc[0], pdf["first"].to_numpy().astype(bool)
    if centre is not None:
        near = np.argsort(-(_stack(pdf["unit"]) @ _stack(centre).T), axis=1, kind="stable")[:, :OVERLAP]
    else:
        h = pd.util.hash_array(pdf["node"].to_numpy().astype("uint64"))
        one = h % np.uint64(k)
        near = np.stack([one, (one + 1 + h // np.uint64(k) % np.uint64(k - 1)) % np.uint64(k)], 1)
    name = pdf["shard"].iloc[0]
    parts = []
    for j in range(near.shape[1]):
        some = first | (j == 0)
        parts.append(pdf[some].assign(shard=[f"{name}/{i}" for i in near[some, j]], first=first[some] & (j == 0))[out.columns])
    return pd.concat(parts, ignore_index=True)


def shards_of(nodes: DataFrame) -> DataFrame:
    """(node, shard, first): each node's shards, `first` for the nearest."""
    ship_package(nodes.sparkSession)
    placed = nodes.select("node", "unit", F.size("unit").cast("string").alias("shard"), F.lit(True).alias("first"), F.lit(None).cast("long").alias("above"))
    table = None
    while True:
        sizes = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max("above").alias("above")).where(F.col("n") > MOST_IN_SHARD)
        k = F.least(F.lit(CENTRES), F.ceil(F.col("n") / IN_SHARD)).cast("int")
        stuck = F.coalesce(F.col("n") > 0.9 * F.col("above"), F.lit(False))
        crowded = materialize(sizes.select("shard", "n", k.alias("k"), stuck.alias("stuck"), F.ceil(F.col("n") / DEALT).cast("int").alias("parts")))
        if crowded.isEmpty():
            return placed.select("node", "shard", "first")
        there = placed.drop("above").join(crowded, "shard")
        place = F.pmod(F.xxhash64("node", "shard"), F.lit(1_000_003)) / 1_000_003
        sample = there.where(~F.col("stuck") & (place < SAMPLE / F.col("n"))).select("shard", "k", "node", "unit")
        centres = sample.groupBy("shard").applyInPandas(centres_of, "shard string, k int, centre array<array<double>>").select("shard", "centre")
        every = crowded.join(centres, "shard", "left").select("shard", "k", "centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        dealt = there.select("node", "unit", "shard", "first", F.col("n").alias("above"), F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int").alias("part"))
        split = dealt.groupBy("shard", "part").cogroup(every.groupBy("shard", "part")).applyInPandas(deal, placed.schema)
        last, table = table, materialize(placed.join(crowded, "shard", "left_anti").select(placed.columns).unionByName(split))
        placed = table
        discard(last, crowded)


def prune(x: np.ndarray, i: int, near: np.ndarray, sims: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[int]:
    """Robust pruning of candidates in order of nearness; the first few nearest stay whatever happens."""
    keep: list[int] = []
    alive = np.ones(len(near), bool)
    among = x[near] @ x[near].T
    for j in range(len(near)):
        if alive[j]:
            keep.append(int(near[j]))
            if len(keep) == degree:
                break
            alive &= ~(alpha * (1 - among[j]) <= 1 - sims)
    return keep


def build_graph(pdf: pd.DataFrame) -> pd.DataFrame:
    """The graph of one shard: (node, neighbours)."""
    pdf = pdf.sort_values("node")
    x, names = _stack(pdf["unit"]), pdf["node"].to_numpy()
    n = len(x)
    out: list[list[int]] = [[] for _ in range(n)]
    k = min(NEAREST, n - 1)
    for at in range(0, n, 512):
        sims = x[at : at + 512] @ x.T
        sims[np.arange(len(sims)), at + np.arange(len(sims))] = -2
        if k < 1:
            continue
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        for r in range(len(sims)):
            s = sims[r, near[r]]
            order = np.lexsort((near[r], -s))
            c, s = near[r][order], s[order]
            kept = prune(x, at + r, c, s)
            out[at + r] = list(dict.fromkeys([*c[:6].tolist(), *kept]))
    back: list[list[int]] = [[] for _ in range(n)]  # edges lead both ways, a bounded number more of each node
    for i, js in enumerate(out):
        for j in js:
            if len(back[j]) < DEGREE:
                back[j].append(i)
    return pd.DataFrame({"node": names, "neighbours": [names[list(dict.fromkeys(a + b))].tolist() for a, b in zip(out, back)]})


class Groups:
    """Rows that links have joined so far, by a number each: a query looks at its links by arrays, and only
    at groups that aren't joined yet one by one."""

    def __init__(self, names: np.ndarray):
        self.names, self.of = names, np.arange(len(names))

    def join(self, name: int, hit: np.ndarray) -> list[tuple[int, int]]:
        """Edges from a node to one row of each group among those hit; they are one group from now on."""
        groups = np.unique(self.of[hit])
        if len(groups) > 1:
            self.of[np.isin(self.of, groups)] = groups[0]
        return [(name, int(self.names[g])) for g in groups.tolist() if self.names[g] != name]


def search_shard(pdf: pd.DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, slack: float = SLACK) -> pd.DataFrame:
    """pdf: a shard's nodes with lists, and nodes that lists name (no list of their own): node, unit,
    weight, neighbours, first, home. Returns (node, links, to, shard): counts of links to nodes at home here,
    for nodes that are first here; forest edges as rows with `to`; shards to go on in as rows with `shard`."""
    pdf = pdf.sort_values("node").reset_index(drop=True)
    x, names, weight, home = _stack(pdf["unit"]), pdf["node"].to_numpy(), pdf["weight"].to_numpy(), pdf["home"].to_numpy()
    here = home == pdf["shard"].to_numpy()
    place = {v: i for i, v in enumerate(names.tolist())}
    lists = [np.array([place[v] for v in (ns if ns is not None else ()) if v in place], np.int64) for ns in pdf["neighbours"]]
    full = np.array([len(a) > 0 for a in lists])
    centre = x[full].sum(0) if full.any() else x.sum(0)
    medoid = int(np.argmax(np.where(full, x @ centre, -np.inf))) if full.any() else 0
    groups, rows = Groups(names), []
    for q in np.flatnonzero(pdf["first"].to_numpy().astype(bool)).tolist():
        seen = {q, medoid}
        frontier = np.array([q, medoid] if q != medoid else [q])
        found_at, found_s = frontier, x[frontier] @ x[q]
        expanded: set[int] = set()
        while True:
            # the nearest not yet expanded: within the beam, or in the slackened range
            order = np.argsort(-found_s, kind="stable")
            beam = order[:width]
            open_ = [i for i in {*beam.tolist(), *np.flatnonzero(found_s >= threshold - slack).tolist()} if int(found_at[i]) not in expanded]
            if not open_:
                break
            nodes = found_at[open_].tolist()
            expanded.update(nodes)
            new = np.unique(np.concatenate([lists[i] for i in nodes]))
            new = np.array([i for i in new.tolist() if i not in seen], np.int64)
            if not len(new):
                continue
            seen.update(new.tolist())
            found_at, found_s = np.concatenate([found_at, new]), np.concatenate([found_s, x[new] @ x[q]])
        hit = found_at[(found_s >= threshold) & (found_at != q)]
        rows.append((int(names[q]), int(weight[hit[here[hit]]].sum() + weight[q] - 1), None, None))
        rows += [(int(names[q]), None, None, s) for s in set(home[hit[~here[hit]]].tolist())]
        if len(np.unique(groups.of[hit])) > 1 or len(hit) and groups.of[hit[0]] != groups.of[q]:
            rows += [(a, None, b, None) for a, b in groups.join(int(names[q]), np.append(hit, q))]
    return _found(rows)


def _found(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["node", "links", "to", "shard"]).astype({"node": "int64", "links": "Int64", "to": "Int64", "shard": "object"})


def visit_shard(pdf: pd.DataFrame, asked: pd.DataFrame, threshold: float = THRESHOLD) -> pd.DataFrame:
    """Queries from other shards (node, vector) against all rows of a shard, as search_shard returns them."""
    if not len(pdf) or not len(asked):
        return _found([])
    x, names, weight, home = _stack(pdf["unit"]), pdf["node"].to_numpy(), pdf["weight"].to_numpy(), pdf["home"].to_numpy()
    here = home == pdf["shard"].to_numpy()
    groups, rows = Groups(names), []
    queries = asked["node"].to_numpy()
    for at in range(0, len(asked), 512):
        near = _stack(asked["vector"].iloc[at : at + 512]) @ x.T >= threshold
        for q, row in zip(queries[at : at + 512].tolist(), near):
            hit = np.flatnonzero(row)
            own = hit[here[hit]]
            rows.append((q, int(weight[own].sum() - (names[own] == q).sum()), None, None))
            rows += [(q, None, None, s) for s in set(home[hit[~here[hit]]].tolist())]
            rows += [(a, None, b, None) for a, b in groups.join(q, hit)]
    return _found(rows)


FOUND = "node long, links long, to long, shard string"
ASKED_AT_ONCE = 10_000  # queries in a task


def _with_halo(nodes: DataFrame, shards: DataFrame, graph: DataFrame) -> DataFrame:
    """(shard, node, neighbours, first, unit, weight, home): shards' nodes, and those that their lists name."""
    lists = shards.join(graph, "node")
    halo = lists.select("shard", F.explode("neighbours").alias("node")).distinct().join(shards, ["shard", "node"], "left_anti")
    null = F.lit(None).cast("array<bigint>")
    rows = lists.select("shard", "node", "neighbours", "first").unionByName(halo.select("shard", "node", null.alias("neighbours"), F.lit(False).alias("first")))
    return rows.join(nodes.select("node", "unit", "weight"), "node").join(homes_of(shards).withColumnRenamed("shard", "home"), "node")


def homes_of(shards: DataFrame) -> DataFrame:
    """(node, shard) of each node's first shard."""
    return shards.where("first").select("node", "shard")


def visit(nodes: DataFrame, rows: DataFrame, asked: DataFrame) -> DataFrame:
    """FOUND of the queries asked (node, shard); a shard that many ask is dealt to several tasks."""
    parts = asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(ASKED_AT_ONCE)).cast("int").alias("parts"))
    shard_rows = rows.join(parts, "shard").select("shard", "node", "unit", "weight", "home", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    queries = asked.join(parts, "shard").join(nodes.select("node", "unit"), "node").select("shard", "node", F.col("unit").alias("vector"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    return shard_rows.groupBy("shard", "part").cogroup(queries.groupBy("shard", "part")).applyInPandas(lambda a, b: visit_shard(a, b), FOUND)


def search(nodes: DataFrame, shards: DataFrame, graph: DataFrame, width: int) -> DataFrame:
    """(node, links, to) of all nodes: the search in the first shards, then in all that queries reach."""
    rows = _with_halo(nodes, shards, graph)
    found = materialize(rows.groupBy("shard").applyInPandas(lambda pdf: search_shard(pdf, width=width), FOUND))
    every, done = found, homes_of(shards)
    while True:
        asked = materialize(found.where("shard is not null").select("node", "shard").distinct().join(done, ["node", "shard"], "left_anti"))
        if asked.isEmpty():
            return _sums(every)
        found = materialize(visit(nodes, rows.select("shard", "node", "unit", "weight", "home"), asked))
        every, done = every.unionByName(found), done.unionByName(asked)


def search_everywhere(nodes: DataFrame, shards: DataFrame) -> DataFrame:
    """As search, but exact: every node against every shard of its length."""
    home = homes_of(shards)
    rows = nodes.select("node", "unit", "weight").join(home, "node").withColumn("home", F.col("shard"))
    own = F.split_part(F.col("shard"), F.lit("/"), F.lit(1)) == F.size("unit").cast("string")
    asked = materialize(nodes.select("node", "unit").crossJoin(F.broadcast(home.select("shard").distinct())).where(own).select("node", "shard"))
    return _sums(materialize(visit(nodes, rows, asked)))


def _sums(found: DataFrame) -> DataFrame:
    links = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links")).withColumn("to", F.lit(None).cast("long"))
    return links.unionByName(found.where("to is not null").select("node", F.lit(None).cast("long").alias("links"), "to"))


def audit_recall(nodes: DataFrame, found: DataFrame, audited: int = AUDITED, threshold: float = THRESHOLD) -> float:
    """Found links over all links between different nodes, by brute force of some nodes (the least hashes) against all:
    the lesser of the share of links and of the mean of the nodes' shares; 1 if there are none."""
    ship_package(nodes.sparkSession)
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(audited).select("node", "unit", "weight").toPandas()
    if not len(sample):
        return 1.0
    shared = nodes.sparkSession.sparkContext.broadcast([(part["node"].to_numpy(), part["weight"].to_numpy(), _stack(part["unit"])) for _, part in sample.groupby(sample["unit"].map(len))])

    def count(batches):
        sums = [np.zeros(len(names), np.int64) for names, _, _ in shared.value]
        for pdf in batches:
            size = pdf["unit"].map(len)
            for total, (names, _, q) in zip(sums, shared.value):
                same = pdf[size == q.shape[1]]
                if not len(same):
                    continue
                x, other, weight = _stack(same["unit"]), same["node"].to_numpy(), same["weight"].to_numpy()
                for at in range(0, len(q), 256):
                    near = (q[at : at + 256] @ x.T >= threshold) & (names[at : at + 256, None] != other)
                    total[at : at + 256] += near @ weight
        for total, (names, own, _) in zip(sums, shared.value):
            yield pd.DataFrame({"node": names, "own": own, "n": total})

    truth = nodes.mapInPandas(count, "node long, own long, n long").groupBy("node").agg(F.first("own").alias("own"), F.sum("n").alias("n")).where("n > 0")
    linked = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    hit = F.least(F.col("n"), F.coalesce("links", F.lit(0)) - F.when(F.col("links").isNotNull(), F.col("own") - 1).otherwise(0))
    r = truth.join(linked, "node", "left").agg(F.sum("n").alias("all"), F.sum(hit).alias("hit"), F.avg(hit / F.col("n")).alias("mean")).first()
    return float(min(r.hit / r["all"], r.mean)) if r["all"] else 1.0


def near_duplicates(vectors: DataFrame, width: int = WIDTH) -> tuple[DataFrame, dict]:
    """vec_id, n_links, component_id, kept for every row of vectors, and the audit's figures."""
    rows, nodes = nodes_of(vectors)
    shards = materialize(shards_of(nodes))
    built = shards.join(nodes.select("node", "unit"), "node").groupBy("shard").applyInPandas(build_graph, "node long, neighbours array<bigint>")
    graph = materialize(built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours")))
    while True:
        found = materialize(search(nodes, shards, graph, width))
        recall = audit_recall(nodes, found)
        if recall >= LEAST_RECALL:
            break
        if width >= 8 * WIDTH:
            found = materialize(search_everywhere(nodes, shards))
            recall = audit_recall(nodes, found)
            break
        width *= 2
    roots = components(found.where("to is not null").select(F.col("node").alias("u"), F.col("to").alias("v")))
    labelled = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = labelled.groupBy("root").agg(F.min("least").alias("name"))
    links = found.where("links is not null").select("node", "links")
    known = labelled.select("node", "root", "unit").join(names, "root").join(links, "node", "left").select("unit", "name", "links")
    out = rows.where("unit is not null").join(known, "unit").select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), F.col("name").alias("component_id"))
    alone = rows.where("unit is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), {"recall": recall, "width": width}


def op9_pruned_graph_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]
