"""Star cover equals the sequential greedy pass (property), pairs and shards boundaries."""

import random

import numpy as np
from pyspark.sql import functions as F

from corpusflow.operators import community, pairs, similarity
from corpusflow.operators.ordinals import running_totals, with_ordinal


def sequential_greedy(nbrs: dict, min_size: int):
    cands = [(len(v), u) for u, v in nbrs.items() if len(v) >= min_size]
    cands.sort(key=lambda t: (-t[0], t[1]))
    taken, out = set(), []
    for size, c in cands:
        if not (nbrs[c] & taken):
            out.append((c, size))
            taken |= nbrs[c]
    return out


def random_graph(rng, n, p):
    nbrs = {u: {u} for u in range(n)}
    for a in range(n):
        for b in range(a + 1, n):
            if rng.random() < p:
                nbrs[a].add(b)
                nbrs[b].add(a)
    return nbrs


def test_star_cover_matches_sequential_on_random_graphs(spark):
    rng = random.Random(7)
    graphs = [random_graph(rng, rng.randint(5, 30), rng.choice([0.05, 0.1, 0.2, 0.4])) for _ in range(12)]
    rows, expected = [], []
    for w, g in enumerate(graphs):
        for u, vs in g.items():
            for v in vs:
                rows.append((w, u, v, 1.0 if u == v else 0.5))
        expected += [(w, c, s) for c, s in sequential_greedy(g, 3)]
    edges = spark.createDataFrame(rows, "window_id long, src long, dst long, score double")
    got = community.star_cover(edges, 3).select("window_id", "center", "size").collect()
    assert sorted(tuple(r) for r in got) == sorted(expected)


def test_ties_chain_and_numbering(spark):
    # chain 0-1-2-3-4: sizes 2,3,3,3,2 -> centre 1 first (tie on size, smaller id), then 3? 3 overlaps 2 only
    g = {0: {0, 1}, 1: {0, 1, 2}, 2: {1, 2, 3}, 3: {2, 3, 4}, 4: {3, 4}}
    rows = [(0, u, v, 1.0 if u == v else 0.9 - 0.01 * v) for u, vs in g.items() for v in vs]
    edges = spark.createDataFrame(rows, "window_id long, src long, dst long, score double")
    centers = community.star_cover(edges, 3)
    assert sorted(r["center"] for r in centers.collect()) == [c for c, _ in sequential_greedy(g, 3)]
    members = community.community_members(edges, centers).orderBy("cluster_no", "member_no").collect()
    assert [(r["cluster_no"], r["member_no"], r["id"]) for r in members][:3] == [(0, 0, 1), (0, 1, 0), (0, 2, 2)]


def test_similarity_edges_blocks_equal_bruteforce(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(120, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(int(i % 2), int(i), [float(x) for x in v[i]]) for i in range(len(v))]
    df = spark.createDataFrame(rows, "window_id long, id long, vector array<double>")
    got = similarity.similarity_edges(df, 0.3, block_rows=16).collect()
    got = sorted((r["window_id"], r["src"], r["dst"]) for r in got)
    exp = sorted((i % 2, i, j) for i in range(len(v)) for j in range(len(v))
                 if i % 2 == j % 2 and float(v[i] @ v[j]) >= 0.3)
    assert got == exp


def test_sister_pairs_bounds_and_missing_title(spark):
    members = spark.createDataFrame(
        [(0, 0, 0, 1, 1, 1.0), (0, 0, 1, 1, 2, 0.95), (0, 0, 2, 1, 3, 0.94999), (0, 0, 3, 1, 4, 0.0),
         (0, 0, 4, 1, 5, 1e-9), (0, 0, 5, 1, 6, 0.5)],
        "window_id long, cluster_no long, member_no long, center long, id long, score double")
    arts = spark.createDataFrame([(0, 1, "c"), (0, 2, "a"), (0, 3, "b"), (0, 4, "d"), (0, 5, "e"), (0, 6, None)],
                                 "window_id long, id long, title string")
    names = spark.createDataFrame([(0, "f.jsonl")], "window_id long, file_name string")
    out = sorted((r["output_text"], r["file_path"]) for r in pairs.sister_pairs(members, arts, names).collect())
    assert out == [("b", "clusters/f.jsonl/A0S0S2"), ("e", "clusters/f.jsonl/A0S0S4")]


def test_shards_n_minus_one_n_n_plus_one(spark):
    for n_rows, keep, drop in [(9, 9, 0), (10, 10, 10), (11, 11, 10)]:
        df = spark.createDataFrame([("f", 0, i) for i in range(n_rows)], "file_name string, cluster_no long, member_no long")
        kept = pairs.assign_shards(df, examples_per=10)
        assert kept.count() == keep
        assert kept.agg(F.max("shard")).first()[0] == (n_rows - 1) // 10
        assert pairs.assign_shards(df, examples_per=10, drop_remainder=True).count() == drop


def test_ordinal_invariant_to_partitions(spark):
    df = spark.range(0, 500).withColumn("k", F.col("id") % 3)
    for n in (1, 4, 32):
        out = with_ordinal(df, ["id"], partition_by=["k"], num_partitions=n).collect()
        assert all(r["ordinal"] == r["id"] // 3 for r in out)
    glob = with_ordinal(df, [F.col("id").desc()], num_partitions=7).collect()
    assert all(r["ordinal"] == 499 - r["id"] for r in glob)


def test_running_totals_hot_key(spark):
    df = spark.range(0, 300).withColumn("k", F.when(F.col("id") < 200, 0).otherwise(1)).withColumn("v", F.col("id") * 1.0)
    out = {r["id"]: r for r in running_totals(df, ["v"], ["id"], partition_by=["k"], num_partitions=6).collect()}
    assert out[199]["cum_count"] == 200 and out[199]["cum_v"] == sum(range(200))
    assert out[250]["cum_count"] == 51 and out[250]["cum_v"] == sum(range(200, 251))


def unit(v):
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def test_block_pairs_that_cannot_hold_a_pair_are_not_made(spark):
    """Tight clusters: most block pairs are skipped, and no edge is lost."""
    rng = np.random.default_rng(12)
    centres = unit(rng.normal(size=(12, 16)))
    v = unit(np.concatenate([c + 0.05 * rng.normal(size=(80, 16)) for c in centres]))
    for odd in (False, True):
        if odd:
            v[5] = 0.0
            v[7] *= 3  # not unit length: the bound takes the lengths
        rows = [(0, i, v[i].tolist()) for i in range(len(v))] + [(1, i, v[i].tolist()) for i in range(30)]
        df = spark.createDataFrame(rows, "window_id long, id long, vector array<double>")
        stats = {}
        got = {(r.window_id, r.src, r.dst) for r in similarity.similarity_edges(df, 0.8, block_rows=40, stats=stats).collect()}
        dots = v @ v.T
        want = {(0, int(i), int(j)) for i, j in zip(*np.nonzero(dots >= 0.8))} | {(1, int(i), int(j)) for i, j in zip(*np.nonzero(dots[:30, :30] >= 0.8))}
        assert got == want
        assert stats["made"] < stats["all"] / (1 if odd else 3)


def test_no_pivots_and_no_threshold_skip_nothing(spark, monkeypatch):
    rng = np.random.default_rng(13)
    v = unit(rng.normal(size=(90, 4)))
    df = spark.createDataFrame([(0, i, v[i].tolist()) for i in range(90)], "window_id long, id long, vector array<double>")
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(v @ v.T >= -0.5))}
    stats = {}
    assert {(r.src, r.dst) for r in similarity.similarity_edges(df, -0.5, block_rows=20, stats=stats).collect()} == want
    assert stats["made"] == stats["all"]
    monkeypatch.setattr(similarity, "PIVOT_BYTES", 1)
    assert {(r.src, r.dst) for r in similarity.similarity_edges(df, -0.5, block_rows=20).collect()} == want


def test_copies_are_one_node(spark):
    """The cover over nodes equals the cover over rows."""
    rng = np.random.default_rng(14)
    base = unit(rng.normal(size=(25, 3)))
    pick = rng.integers(0, 25, 120)
    rows = [(int(k % 2), 1000 + int(k), base[p].tolist()) for k, p in enumerate(pick)]
    df = spark.createDataFrame(rows, "window_id long, id long, vector array<double>")
    key = lambda r: (r.window_id, r.cluster_no, r.member_no, r.center, r.id, round(r.score, 9))
    for t, least in ((0.9, 3), (0.6, 5), (0.99, 1)):
        plain = community.communities(similarity.similarity_edges(df, t), least)
        assert sorted(map(key, community.communities_of_vectors(df, t, least).collect())) == sorted(map(key, plain.collect()))


def test_twenty_thousand_copies_cost_as_many_rows(spark):
    one, other = [0.6, 0.8], [0.8, 0.6]
    df = spark.range(20_000).select(F.lit(0).cast("long").alias("window_id"), "id", F.array(*map(F.lit, one)).alias("vector")).unionByName(
        spark.range(30_000, 30_005).select(F.lit(0).cast("long").alias("window_id"), "id", F.array(*map(F.lit, other)).alias("vector")))
    nodes, members = community.vector_nodes(df)
    assert nodes.count() == 2 and members.count() == 20_005
    got = community.communities_of_vectors(df, 0.99, 3)
    assert {(r.cluster_no, r.center, r.n) for r in got.groupBy("cluster_no", "center").agg(F.count("*").alias("n")).collect()} == {(0, 0, 20_000), (1, 30_000, 5)}
    whole = community.communities_of_vectors(df, 0.9, 3)
    assert whole.groupBy("center").count().collect()[0][1] == 20_005


def test_dense_cover_needs_no_table_of_links(spark, monkeypatch):
    """Heads of a few candidates, slabs of a few rows: the same cover, and windows are cut into a bounded number of blocks."""
    rng = np.random.default_rng(15)
    base = unit(rng.normal(size=(160, 4))).astype(np.float32)
    pick = np.concatenate((np.arange(160), rng.integers(0, 160, 60)))
    rows = [(int(k % 2), 500 + int(k), base[p].tolist()) for k, p in enumerate(pick)] + [(1, 9999, None)]
    df = spark.createDataFrame(rows, "window_id long, id long, vector array<float>")
    key = lambda r: (r.window_id, r.cluster_no, r.member_no, r.center, r.id, round(r.score, 9))
    v = base[pick].astype(np.float64)
    for t, least in ((0.8, 3), (0.95, 1)):
        want = set()
        for w in (0, 1):
            own = [k for k in range(len(pick)) if k % 2 == w]
            nbrs = {500 + a: {500 + b for b in own if v[a] @ v[b] >= t} for a in own}
            want |= {(w, c) for c, _ in sequential_greedy(nbrs, least)}
        plain = sorted(map(key, community.communities_of_vectors(df, t, least).collect()))
        assert {(r[0], r[3]) for r in plain} == want
        with monkeypatch.context() as m:
            m.setattr(community, "FEW_LINKS", 0)
            m.setattr(community, "LINKS_PER_NODE", 0)
            m.setattr(community, "HEAD_ROWS", 7)
            m.setattr(community, "SLAB_BYTES", 32 * 9)
            assert sorted(map(key, community.communities_of_vectors(df, t, least).collect())) == plain
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 5)
    monkeypatch.setattr(similarity, "BLOCKS", 4)
    stats = {}
    got = {(r.window_id, r.src, r.dst) for r in similarity.similarity_edges(df, 0.8, stats=stats).collect()}
    assert got == {(int(a % 2), 500 + int(a), 500 + int(b)) for a, b in zip(*np.nonzero(v @ v.T >= 0.8)) if a % 2 == b % 2}
    assert max(stats["blocks"].values()) <= 8


def test_windowed_pairs_need_no_table_of_links(spark, monkeypatch):
    """The windowed chain with every window covered by its first candidates gives the rows of the whole link tables."""
    from corpusflow.plans import q_windows

    key = lambda r: (r.window_id, r.input_text, r.output_text, round(r.output_text_score, 5), r.file_path)
    data = "/root/testdata/sf0.01"
    plain = sorted(map(key, q_windows.windowed_sister_pairs(spark, data).collect()))
    assert plain

    def refused(*_, **__):
        raise AssertionError("a table of all links")

    monkeypatch.setattr(similarity, "similarity_edges", refused)
    monkeypatch.setattr(community, "similarity_edges", refused)
    monkeypatch.setattr(community, "FEW_LINKS", 0)
    monkeypatch.setattr(community, "LINKS_PER_NODE", 0)
    assert sorted(map(key, q_windows.windowed_sister_pairs(spark, data).collect())) == plain


def test_a_round_looks_at_the_first_candidates_of_each_window(spark):
    rows = [(w, 100 * w + i, 10 * w + i % 3) for w in range(4) for i in range(9)]
    left = spark.createDataFrame(rows, "window_id long, id long, size long")
    got = community._first_candidates(left, 4, 8).collect()
    want = [(w, i) for w in range(4) for _, i in sorted((-s, i) for v, i, s in rows if v == w)[:2]]
    assert sorted((r.window_id, r.id) for r in got) == sorted(want)


def test_dedup_carries_no_text_that_is_not_kept(spark):
    from corpusflow.operators import calendar

    rows = [(0, 2, "t", "x", "2024-01-01"), (0, 1, "t", "x", "2024-01-01"), (0, 3, "t", "y", "2024-01-02"), (1, 4, "t", "x", "2023-01-01"), (1, 5, None, "x", "2023-01-01")]
    df = spark.createDataFrame(rows, "window_id long, id long, title string, text string, publish_date string")
    kept = calendar.window_dedup(df, keep=["id"])
    assert sorted((r.window_id, r.id, r.copies) for r in kept.collect()) == [(0, 1, 2), (0, 3, 1), (1, 4, 1)]
    assert kept.columns == ["window_id", "dedup_key", "id", "copies"]
