from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from punctual.llm import graph, minhash, pivots

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def shingles(text, k):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def expected(docs, k, percent):
    sets = {d: shingles(t, k) for d, t in docs}
    ids = sorted(sets)
    links = []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    root = roots(ids, links)
    return sorted((d, len(sets[d]), root[d], root[d] == d) for d in ids)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(n):
        if docs and rng.random() < 0.5:
            words = rng.choice(docs)[1].split(" ")
            for _ in range(rng.choice([0, 1, 2, 6])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = rng.choices(vocabulary, k=rng.choice([1, 2, 5, 40, 60, 150]))
        docs.append((i * 3, " ".join(words)))
    return docs


@pytest.mark.parametrize("words", [2, 5])
def test_documents_against_all_pairs(spark, words):
    docs = corpus(words, 160)
    docs += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "Ä É"), (1004, "ä é"), (1005, "ONE Two"), (1006, "one\x0btwo")]
    docs += [(2000, "x " * 30_000), (2001, "x " * 30_000 + "y"), (2002, "lone" + "g" * 100_000)]
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), words=words)
    assert sorted(map(tuple, got.collect())) == expected(docs, words, 80)


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(300):
        words = list(base)
        for _ in range(rng.choice([2, 3, 4])):
            words[rng.randrange(60)] = f"x{rng.randrange(10_000)}"
        docs.append((i, " ".join(words)))
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), words=2)
    assert sorted(map(tuple, got.collect())) == expected(docs, 2, 80)


def test_blocks_compare_members_of_two_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    test_a_large_group_of_near_copies(spark)


def test_repeated_null_and_clashing_columns(spark):
    rows = [(5, "a b c", 1), (5, "a b c", 1), (None, "a b c", 2), (None, None, 3), (7, "a b c", 4)]
    table = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = minhash.near_duplicates(table, words=2).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in got) == [
        (-1, 0, -1, True),
        (-1, 2, -1, True),
        (5, 2, 5, True),
        (5, 2, 5, True),
        (7, 2, 5, False),
    ]
    assert minhash.near_duplicates(table.limit(0)).count() == 0


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(3)
    common, left, right = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    values = np.concatenate([common, left, common, right, common[:1]])
    text = np.repeat([0, 1, 2], [900, 900, 1])
    sketch = minhash.similarity_sketches(values, text, 4, 512)
    assert (sketch[:3] != minhash._EMPTY).all() and (sketch[3] == minhash._EMPTY).all()
    assert abs((sketch[0] == sketch[1]).mean() - 0.8) < 0.08


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(200, 200), (None, 3), (40, 39)]
    got = graph.components(spark.createDataFrame(links, "a long, b long"), "a", "b", "test")
    found = {r.node: r.component for r in got.collect()}
    assert found == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 140)}


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(300):
        if rows and rng.random() < 0.6:
            near = rows[rng.integers(len(rows))]
            vec, label = np.array(near[1]) + rng.normal(0, rng.choice([0.0, 0.02, 0.05]), 16), near[2]
            label = label if rng.random() < 0.9 else (label or 0) + 1
        else:
            vec, label = rng.normal(0, 1, 16), int(rng.integers(3))
        rows.append((i, [float(x) for x in vec], label))
    clean = list(rows)
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, [], 1)]
    rows += [(905, rows[0][1], None), (906, [float("inf")] * 16, 1), (907, [1.0, 2.0], 1), (908, [2.0, 4.0], 1)]
    got = pivots.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    x = np.array([r[1] for r in clean])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    same = np.array([r[2] for r in clean])[:, None] == np.array([r[2] for r in clean])[None, :]
    linked = same & (unit @ unit.T >= 0.98)
    np.fill_diagonal(linked, False)
    root = roots(range(300), np.argwhere(linked).tolist())
    expect = [(i, int(linked[i].sum()), root[i], root[i] == i) for i in range(300)]
    expect += [(i, 0, i, True) for i in (900, 901, 902, 903, 904, 905, 906)] + [(907, 1, 907, True), (908, 1, 907, False)]
    assert sorted(map(tuple, got.collect())) == expect


def test_one_dense_cluster_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 32)
    rng = np.random.default_rng(9)
    base = rng.normal(0, 1, 8)
    x = base + rng.normal(0, 0.02, (150, 8))
    rows = [(i, [float(v) for v in vec], "a") for i, vec in enumerate(x)] + [(5, [float(v) for v in x[5]], "a")]
    got = pivots.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string"))
    x = np.concatenate([x, x[5:6]]).astype(np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.98
    np.fill_diagonal(linked, False)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got.collect()) == sorted(
        (rows[i][0], int(linked[i].sum()), 0) for i in range(151)
    )
    assert pivots.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_block_comparison_of_very_long_texts_is_exact():
    """100 times the shared words is no single-precision number, and the union lies just above what it rounds to."""
    percent = 81
    both, union = next(
        (i, 100 * i // percent + 1)
        for i in range(700_001, 800_000, 2)
        if 100 * i < percent * (100 * i // percent + 1) <= int(np.float32(100 * i))
    )
    shared = [f"w{i}" for i in range(both)]
    own = [f"o{i}" for i in range(union - both)]
    rows = {"b": [1, 2], "component": [1, 2], "side": [0, 0], "_text": [" ".join(shared), " ".join(shared + own)]}
    assert minhash._block_links(1, percent)(pa.table(rows)).num_rows == 0
    rows["_text"][1] = " ".join(shared + own[:-1])
    assert minhash._block_links(1, percent)(pa.table(rows)).num_rows == 1


@pytest.mark.parametrize("block", [4, 24])
def test_long_lists_are_split_by_further_pivots(spark, monkeypatch, block):
    """With long lists at every depth, links are those of all pairs, and a pair is counted in one list only."""
    monkeypatch.setattr(pivots, "BLOCK", block)
    test_vectors_against_all_pairs(spark)


def test_lists_of_pairs_and_triples_hold_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 5)
    rng = np.random.default_rng(4)
    sets = [sorted(rng.choice(12, 8, replace=False).tolist()) for _ in range(60)]
    rows = [(i, "a", 4, s, 3) for i, s in enumerate(sets)]
    heads = spark.createDataFrame(rows, "id long, label string, dim int, pivots array<int>, needed int")
    placed = pivots._blocked(heads).select("id", "key", "pivots", "low", "high", "side").collect()
    lists = {}
    for r in placed:
        lists.setdefault((tuple(r.key), r.low, r.high), []).append(r)
    assert max(len(key) for key, _, _ in lists) == 3
    counts = {}
    for (key, low, high), members in lists.items():
        for a in members:
            for b in members:
                shared = sorted(set(a.pivots) & set(b.pivots))
                if a.id < b.id and {a.side, b.side} == {low, high} and len(shared) >= 3 and shared[: len(key)] == list(key):
                    counts[a.id, b.id] = counts.get((a.id, b.id), 0) + 1
    assert counts == {
        (i, j): 1 for i in range(60) for j in range(i + 1, 60) if len(set(sets[i]) & set(sets[j])) >= 3
    }


def test_vectors_with_null_ids_and_clashing_columns(spark):
    rows = [(5, [1.0, 2.0], 1, 9, 9), (None, [1.0, 2.0], 1, 9, 9), (7, [1.0, 2.001], 1, 9, 9), (8, [2.0, -1.0], 1, 9, 9)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, links long, root long")
    got = sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in pivots.near_vectors(table).collect())
    assert got == [(-1, 0, None, True), (5, 1, 5, True), (7, 1, 5, False), (8, 0, 8, True)]
