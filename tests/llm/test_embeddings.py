import numpy as np

from foliospark.llm import embeddings as E

SCHEMA = "vec_id long, embedding array<float>, label int"


class Forest:
    def __init__(self):
        self.up = {}

    def root(self, a):
        while self.up.setdefault(a, a) != a:
            a = self.up[a]
        return a

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def brute(rows):
    ok = [(i, np.asarray(v, float) / np.linalg.norm(v)) for i, v in rows]
    x = np.stack([v for _, v in ok])
    link = x @ x.T >= 0.9
    np.fill_diagonal(link, False)
    forest = Forest()
    for a, b in zip(*np.nonzero(link)):
        forest.join(ok[a][0], ok[b][0])
    return {i: (int(link[k].sum()), forest.root(i)) for k, (i, _) in enumerate(ok)}


def test_links_and_components(spark, monkeypatch):
    monkeypatch.setattr(E, "IN_SHARD", 60)
    monkeypatch.setattr(E, "MOST_IN_SHARD", 150)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 16))
    near = x[:60].repeat(4, 0) + rng.normal(size=(240, 16)) * 0.12
    crowd = x[0] + rng.normal(size=(200, 16)) * 0.1
    rows = list(enumerate(np.concatenate([x, near, crowd, x[:30]]).astype(np.float32).tolist()))
    out, figures = E.near_duplicates(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA))
    got = {r.vec_id: (r.n_links, r.component_id) for r in out.collect()}
    want = brute(rows)
    assert figures["recall"] >= 0.9
    assert sum(n for n, _ in got.values()) >= 0.9 * sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)
    assert all(got[i][1] == want[i][1] for i in want)


def test_a_group_over_many_shards_is_counted_whole(spark, monkeypatch):
    """A group of near, not equal, vectors much larger than a shard; and the exact search."""
    monkeypatch.setattr(E, "IN_SHARD", 20)
    monkeypatch.setattr(E, "MOST_IN_SHARD", 40)
    rng = np.random.default_rng(9)
    crowd = rng.normal(size=16) * 2 + rng.normal(size=(500, 16)) * 0.15
    rows = list(enumerate(np.concatenate([rng.normal(size=(300, 16)), crowd]).astype(np.float32).tolist()))
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    want = sum(n for n, _ in brute(rows).values())
    out, figures = E.near_duplicates(table)
    assert figures["width"] == E.WIDTH and figures["recall"] >= 0.99
    assert 0.99 * want <= sum(r.n_links for r in out.collect()) <= want
    nodes = E.nodes_of(table)[1]
    exact = E.search_everywhere(nodes, E.materialize(E.shards_of(nodes)))
    assert sum(r.links for r in exact.where("links is not null").collect()) == want


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 1), (4, None, 0), (5, [], 0), (6, [0.0, 0.0], 0), (7, [nan, 1.0], 0), (8, [1.0, None], 0), (9, [inf, 1.0], 0), (10, [1.0, 0.0, 0.0], 0), (11, [0.0, -1.0], None), (3, [1.0, 0.1], 0), (None, [0.0, -1.0], 0)]
    extra = spark.createDataFrame([r + ("z", "z") for r in rows], SCHEMA + ", unit string, node string")
    got = sorted([(str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in E.near_duplicates(extra)[0].collect()])
    one = [("1", 3, "1", True), ("2", 3, "1", False), ("3", 3, "1", False), ("3", 3, "1", False)]
    alone = [(str(i), 0, str(i), True) for i in (4, 5, 6, 7, 8, 9, 10)]
    assert got == sorted([*one, *alone, ("11", 1, "11", True), ("None", 1, "11", False)])
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA))[0].count() == 0


def test_tiny_and_huge_vectors(spark):
    """Squares of these underflow or overflow, cosines don't."""
    rows = [(1, [1e-200, 0.0]), (2, [2e-200, 0.0]), (3, [0.0, 5e-324]), (4, [0.0, 1.0]), (5, [1e308, 1e308]), (6, [1.0, 1.0]), (7, [-1e308, 0.0])]
    out = E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))[0]
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in out.collect()) == [(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3), (5, 1, 5), (6, 1, 5), (7, 0, 7)]


def test_pairs_at_the_threshold(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.8999, (1 - 0.8999**2) ** 0.5]), (3, [0.9001, -((1 - 0.9001**2) ** 0.5)])]
    out = E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))[0]
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in out.collect()) == [(1, 1, 1), (2, 0, 2), (3, 1, 1)]


def test_the_audit_tells_a_search_that_finds_nothing(spark):
    """Copies don't count as found links, and the sample isn't of what the search found."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16))
    near = x[:40] + rng.normal(size=(40, 16)) * 0.05
    rows = list(enumerate(np.concatenate([x.repeat(20, 0), near]).astype(np.float32).tolist()))
    nodes = E.nodes_of(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))[1]
    nothing = nodes.selectExpr("node", "weight - 1 as links", "cast(null as long) as to")
    assert E.audit_recall(nodes, nothing) == 0
    assert E.audit_recall(nodes, nodes.limit(0).selectExpr("node", "weight as links", "cast(null as long) as to")) == 0
    shards = E.materialize(E.shards_of(nodes))
    assert E.audit_recall(nodes, E.search_everywhere(nodes, shards)) == 1


def test_clusters_of_one_direction_are_split(spark, monkeypatch):
    """Nodes that k-means can't part are dealt by hashes, so no shard stays larger than the bound, and none is lost."""
    monkeypatch.setattr(E, "IN_SHARD", 20)
    monkeypatch.setattr(E, "MOST_IN_SHARD", 60)
    monkeypatch.setattr(E, "DEALT", 100)
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, *v]) for i, v in enumerate((rng.normal(size=(600, 3)) * 1e-17).tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    nodes = E.nodes_of(table)[1]
    shards = E.materialize(E.shards_of(nodes))
    assert shards.groupBy("shard").count().agg({"count": "max"}).first()[0] <= 60
    firsts = shards.where("first")
    assert firsts.count() == firsts.select("node").distinct().count() == nodes.count() == 600
    got = E.near_duplicates(table)[0].collect()  # the search may miss a link, as anywhere; what it finds is one group
    assert all(590 <= r.n_links <= 599 and r.component_id == 0 for r in got) and len(got) == 600


def test_each_length_links_with_its_own(spark):
    rows = [(i, [1.0, 0.01 * i], 0) for i in range(6)] + [(10, [1.0, 0.0, 0.0], 0), (11, [2.0, 0.0, 0.0], 0), (12, [1.0, 0.1, 0.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(spark.createDataFrame(rows, SCHEMA))[0].collect()}
    assert all(got[i] == (5, 0) for i in range(6)) and all(got[i] == (2, 10) for i in (10, 11, 12))


def test_pruning_keeps_the_nearest():
    x = np.array([[1, 0], [0.99, 0.14], [0.98, 0.199], [0, 1]], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    kept = E.prune(x, 0, np.array([1, 2, 3]), x[[1, 2, 3]] @ x[0])
    assert kept[0] == 1 and 2 not in kept


def test_groups_span_what_is_linked():
    """Edges of Groups join the same rows as all links do."""
    rng = np.random.default_rng(4)
    names = np.arange(100, 160)
    groups, edges, every = E.Groups(names), Forest(), Forest()
    for q in rng.permutation(60)[:40]:
        hit = rng.choice(60, rng.integers(0, 4), replace=False)
        for a, b in groups.join(int(names[q]), np.append(hit, q)):
            edges.join(a, b)
        for j in hit:
            every.join(int(names[q]), int(names[j]))
    assert all((edges.root(a) == edges.root(b)) == (every.root(a) == every.root(b)) for a in names.tolist() for b in names.tolist())
