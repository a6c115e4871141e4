"""Deduplication, resharding and the pipeline against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from larkfield.llm import common, embed_dedup, exact_dedup, graph, near_dedup, resharding

DOCS = "doc_id bigint, text string, rep string, bucket string, part string"


def test_written_tables_can_be_cleared(spark):
    common.clear(spark)
    table = common.written(spark.range(3), "x")
    assert table.count() == 3 and common.clear(spark) == 1
    with pytest.raises(Exception):
        spark.read.parquet(table.inputFiles()[0])


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in zip(ids or range(len(texts)), texts)], DOCS)


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000, k) for k in range(1001, 1200)] + [(k, k + 1) for k in range(2000, 2040)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for x in parent}
    assert graph.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_exact(spark):
    texts = ["a b", "ab", "a\tb\n", "a b", None, "", "  ", "AB", "x" * 200000, "x" * 199999 + " x", "ab"]
    ids = [5, 4, 9, 3, 8, 7, 6, 1, 11, 10, 4]
    got = exact_dedup.exact_dedup(frame(spark, texts, ids)).collect()
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in texts]
    assert len(got) == len(texts)
    for i, n in zip(ids, norm):
        group = [(-len(t or ""), j) for j, t, m in zip(ids, texts, norm) if m == n]
        r = next(r for r in got if r.doc_id == i)
        assert (r.keep_id, r.group_size, r.kept) == (min(group)[1], len(group), i == min(group)[1])
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def near_groups(texts, ids):
    bags = [shingles(t) for t in texts]
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in range(len(ids)):
            for b in range(a):
                both, either = sum((bags[a] & bags[b]).values()), sum((bags[a] | bags[b]).values())
                if either and both / either >= 0.8 and comp[ids[a]] != comp[ids[b]]:
                    comp[ids[a]] = comp[ids[b]] = min(comp[ids[a]], comp[ids[b]])
                    changed = True
    return comp


def test_near(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 4)  # so that blocks are tried as well
    monkeypatch.setattr(near_dedup, "BLOCK_FEW", 3)
    monkeypatch.setattr(near_dedup, "BLOCK_MANY", 5)
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(400)]
    texts = ["", None, "one two", "One  two!", "***", "a a a a a a a a", "a a a a a a a a a"]
    for _ in range(4):
        base = [words[k] for k in rng.integers(0, 400, 150)]
        for _ in range(14):
            own = list(base)
            for k in rng.integers(0, 150, rng.integers(0, 6)):
                own[k] = words[rng.integers(0, 400)]
            texts.append(" ".join(own))
    texts += [" ".join(words[k] for k in rng.integers(0, 400, 30000)), " ".join(["same", "line", "again"] * 50)]
    ids = [int(i) for i in rng.permutation(len(texts)) + 10]
    got = near_dedup.near_dedup(frame(spark, texts, ids)).collect()
    want = near_groups(texts, ids)
    assert {r.doc_id: r.cluster_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.cluster_id) for r in got) and len(got) == len(texts)
    assert near_dedup.near_dedup(frame(spark, [])).count() == 0
    assert near_dedup.near_dedup(frame(spark, ["x", "x"], [None, 3])).where("kept").count() == 2


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    items = np.sort(rng.integers(1, 1 << 63, 60).astype(np.uint64))
    a, b = rng.integers(1, 9, 60), rng.integers(1, 9, 60)
    sig = near_dedup.signatures([(items, a), (items, b)], 4096)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.035
    assert near_dedup.signatures([(items[:1], np.array([1]))], 144).all()


def test_embeddings(spark, monkeypatch):
    for name, value in {"BLOCK_ROWS": 8, "TILE": 4, "LEAST_ROWS": 12, "GROUP_BYTES": 2400}.items():  # many blocks, groups and tiles
        monkeypatch.setattr(embed_dedup, name, value)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 12))
    x = np.vstack([base, base[:30] + rng.normal(size=(30, 12)) * 0.15, base[:20] * 3, base[:5], np.repeat(base[:1], 25, 0) + rng.normal(size=(25, 12)) * 0.01]).astype(np.float32)
    vectors = [v.tolist() for v in x] + [None, [], [0.0] * 12, [float("nan")] * 12, [None] + [1.0] * 11, [1.0, 2.0], [2.0, 4.0], [float("inf")] * 12]
    ids = [int(i) for i in rng.permutation(len(vectors))]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in zip(ids, vectors)], "vec_id bigint, embedding array<float>, cell int, copies int")
    links = {i: set() for i in ids}
    for i, v in zip(ids, vectors):
        for j, u in zip(ids, vectors):
            if i != j and v and u and len(v) == len(u) and None not in v and None not in u:
                p, q = np.array(v), np.array(u)
                if np.isfinite(p).all() and np.isfinite(q).all() and p.any() and q.any() and p @ q / np.sqrt((p @ p) * (q @ q)) >= 0.95:
                    links[i].add(j)
    comp = {i: i for i in ids}
    for _ in ids:
        for i in ids:
            comp[i] = min([comp[i], *(comp[j] for j in links[i])])
    got = {r.vec_id: r for r in embed_dedup.embed_dedup(df).collect()}
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (len(links[i]), comp[i], comp[i] == i) for i in ids}
    assert embed_dedup.embed_dedup(df.limit(0)).count() == 0


def test_groups_of_blocks():
    assert embed_dedup.grouped([10] * 8, 4, 100) == [(k // 2, 1) for k in range(8)]
    assert embed_dedup.grouped([5, 250, 5], 2, 100) == [(0, 1), (1, 3), (4, 1)]
    assert embed_dedup.grouped([7], 1, 100) == [(0, 1)]
    rng = np.random.default_rng(3)
    sizes = rng.integers(0, 2000, 500).tolist()
    dealt = embed_dedup.grouped(sizes, 12, 65536)
    assert max(f for f, _ in dealt) <= 13 and max(sum(n for n, (f, _) in zip(sizes, dealt) if f == g) for g in range(14)) <= 1.2 * sum(sizes) / 12


def test_far_blocks_are_left_out_and_no_link_is_lost():
    rng = np.random.default_rng(9)
    middle = rng.normal(size=(30, 16))
    x = embed_dedup.unit(np.vstack([m + rng.normal(size=(40, 16)) * 0.1 for m in middle]))
    tree, centres = embed_dedup.cuts(x, 32)
    b = embed_dedup.block_of(x, tree)
    radius = np.array([np.sqrt(((x[b == k] - centres[k]) ** 2).sum(1).max()) if (b == k).any() else 0 for k in range(32)])
    near = embed_dedup.can_link(centres, radius, centres, radius, 0.95)
    i, j = np.nonzero(x @ x.T >= 0.95)
    assert near[b[i], b[j]].all() and near.mean() < 0.6
    count, _ = embed_dedup.compare(x, np.zeros(len(x)), np.ones(len(x), np.int64), 0.95, b)
    assert (count == (x @ x.T >= 0.95).sum(1) - 1).all()


@pytest.mark.parametrize("sizes, shards", [([40], 4), ([10, 0, 30, 7], 3), ([5, 5, 5], 5)])
def test_min_cost_flow_moves_the_least(sizes, shards):
    room = resharding.even_capacities(sum(sizes), shards)
    flow = resharding.min_cost_flow(sizes, room, lambda i, j: int(i != j))
    assert [sum(f.values()) for f in flow] == sizes
    assert [sum(f.get(j, 0) for f in flow) for j in range(shards)] == room
    stay = sum(min(sizes[k], room[k]) for k in range(min(len(sizes), shards)))
    assert sum(n for i, f in enumerate(flow) for j, n in f.items() if i != j) == sum(sizes) - stay
    with pytest.raises(ValueError):
        resharding.min_cost_flow([3], [2], lambda i, j: 1)


def test_reshard(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(resharding, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(5)
    texts = [None, "", "é" * 500, "same", "same"] + ["x" * int(n) for n in rng.integers(0, 300, 200)]
    df = spark.createDataFrame([(i, t, int(rng.integers(0, 3)), "s") for i, t in enumerate(texts)], "doc_id bigint, text string, old int, slot string")
    table = resharding.reshard(df, 4, old="old", key="doc_id").cache()
    placed = table.collect()
    sizes = [len((t or "").encode()) + 1 for t in texts]
    assert sorted(r.doc_id for r in placed) == list(range(len(texts)))
    assert all(r.size == sizes[r.doc_id] and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in placed)
    by = {s: [r for r in placed if r.shard == s] for s in range(4)}
    assert all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in by.values())
    assert max(abs(sum(r.size for r in rows) - sum(sizes) / 4) for rows in by.values()) <= 0.02 * sum(sizes)
    touched = resharding.rewrite(df, table, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(touched) == {0, 1, 2, 3} and back.count() == len(texts)
    assert resharding.reshard(df.limit(0), 4, old="old").count() == 0


def test_reshard_many_shards_and_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(resharding, "BLOCK_ROWS", 100)
    seen = []
    flow = resharding.min_cost_flow
    monkeypatch.setattr(resharding, "min_cost_flow", lambda supply, room, cost: seen.append((supply, room)) or flow(supply, room, cost))
    rng = np.random.default_rng(6)
    rows = [(7, "a hot text " * 9, int(o)) for o in rng.integers(0, 200, 2000)] + [(i, "x" * int(n), int(o)) for i, (n, o) in enumerate(zip(rng.integers(0, 200, 4000), rng.integers(0, 200, 4000)))] + [(None, "y", None)] * 3
    placed = resharding.reshard(spark.createDataFrame(rows, "doc_id bigint, text string, old int"), 5, old="old").collect()
    sizes = {s: sum(r.size for r in placed if r.shard == s) for s in range(5)}
    assert len(placed) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 2 * 5 * 200
    assert all(sorted(r.slot for r in placed if r.shard == s) == list(range(sum(r.shard == s for r in placed))) for s in range(5))
    assert all(len(supply) == 6 for supply, _ in seen)  # 195 shards are one source
    stay = sum(r.size for r in placed if r.old_shard == r.shard)
    assert stay >= 0.99 * sum(len(t) + 1 for _, t, o in rows if o is not None and o < 5)  # what has a place stays


def test_large_rows_leave_room_for_what_stays():
    shard, taken = resharding.place_large([(2, 10)] * 12, [100, 100, 100], [100, 80, 0])
    assert taken == [0, 20, 100] and shard.count(1) == 2


def test_pipeline_against_brute_force(spark):
    base = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, base).cache()
        assert out.columns == docs.columns
        left = {r.doc_id for r in now.collect()}
        kept = {r.doc_id for r in out.collect()}
        if name == "exact_dedup":
            groups = {}
            for i in left:
                groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", texts[i] or ""), []).append((-len(texts[i] or ""), i))
            assert kept == {min(g)[1] for g in groups.values()}
        elif name == "near_dedup":
            ids = sorted(left)
            assert kept == set(near_groups([texts[i] for i in ids], ids).values())
        else:
            assert kept <= left
        now = out
    ids = {r.doc_id for r in now.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, base).collect()} == ids
