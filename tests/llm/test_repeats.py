from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from punctual.llm import queries, repeats

SF = "/root/testdata/sf0.001"


def plain_repeats(docs, length=200):
    """{row number: (bytes, removed, runs, rest)} from the number of times that each string starts anywhere."""
    raw = [(text or "").encode() for _, text in docs]
    starts = Counter(hash(x[i : i + length]) for x in raw for i in range(len(x) - length + 1))
    out = []
    for (doc, _), x in zip(docs, raw):
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - length + 1):
            if starts[hash(x[i : i + length])] > 1:
                gone[i : i + length] = True
        runs = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((doc, len(x), int(gone.sum()), runs, bytes(np.frombuffer(x, np.uint8)[~gone])))
    return out


def rows_of(df):
    rows = df.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long"), "kept", "removed", "kept_sha256").collect()
    for r in rows:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
        assert sum(x.end - x.start for x in r.removed) == r.n_removed
    return sorted(((*r[:4], bytes(r.kept)) for r in rows), key=str)


def test_query_against_counted_strings(spark):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect()]
    want = [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in plain_repeats(docs)]
    assert sorted(map(tuple, queries.op12_repeats(spark, SF).collect())) == sorted(want)
    assert sum(r[2] for r in want) > 10_000


@pytest.mark.parametrize("most", [repeats.MOST, 3])
def test_shared_passages_and_runs(spark, most):
    """Passages in many surroundings, runs of few letters, and frequent anchors split to whole strings."""
    rng = random.Random(most)
    letters = "abcdé "
    shared = ["".join(rng.choice(letters) for _ in range(rng.randrange(20, 130))) for _ in range(12)]
    docs = []
    for i in range(120):
        body = "".join(
            rng.choice([rng.choice(shared), "x" * rng.randrange(90), "yz" * rng.randrange(40), "".join(rng.choice(letters) for _ in range(60))])
            for _ in range(rng.randrange(7))
        )
        docs.append((i, body))
    docs += [(500, docs[5][1]), (501, docs[6][1]), (None, docs[7][1]), (7, docs[7][1]), (7, docs[7][1])]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = rows_of(repeats.strip_repeats(table, length=50, anchor=16, most=most))
    assert got == sorted(plain_repeats(docs, 50), key=str)
    assert sum(r[2] > 0 for r in got) > 60


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PLAIN", 3)
    once = "".join(random.Random(1).choices("abcdefgh", k=5_000))
    rows = [(1, None, 1), (2, "", 1), (2, "", 1), (3, "short", 1), (4, "short", 1), (5, "r" * 300_000, 1)]
    rows += [(6, once, 1), (7, "-" + once[100:400] + "-", 1)] + [(8, once[2000:2200], 1)] * 5
    table = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = rows_of(repeats.strip_repeats(table))
    gone = 300 + 200
    assert got == sorted(
        [(1, 0, 0, 0, b""), (2, 0, 0, 0, b""), (2, 0, 0, 0, b""), (3, 5, 0, 0, b"short"), (4, 5, 0, 0, b"short")]
        + [(5, 300_000, 300_000, 1, b""), (6, 5_000, gone, 2, (once[:100] + once[400:2000] + once[2200:]).encode())]
        + [(7, 302, 300, 1, b"--")] + [(8, 200, 200, 1, b"")] * 5,
        key=str,
    )
    assert repeats.strip_repeats(table.limit(0)).count() == 0


def test_near_copies_and_pieces_of_long_texts(spark, monkeypatch):
    docs = [(i, "".join(random.Random(i % 4).choices("abc", k=3_000 + 7 * i))) for i in range(8)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    whole = rows_of(repeats.strip_repeats(table))
    assert whole == sorted(plain_repeats(docs), key=str)
    bounds = np.array([0, 1_000, 1_900, 5_000])
    monkeypatch.setattr(repeats, "PIECE", 700)
    starts = [(t, s) for texts, low, high in repeats.pieces(bounds, 200) for t, a, b in zip(texts, low, high) for s in range(a, b - 199)]
    assert starts == [(t, s) for t in range(3) for s in range(bounds[t], bounds[t + 1] - 199)]


def test_sorted_suffixes():
    rng = random.Random(8)
    for _ in range(200):
        data = np.array([rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randrange(60, 300))], np.uint8)
        data[-20:] = data[:20]
        length, shallow = rng.choice([8, 16, 41, 50]), rng.choice([8, 16, 32])
        starts = np.arange(len(data) - length + 1)
        group = np.array([rng.randrange(3) for _ in starts])
        order, equal = repeats.sort_suffixes(data, starts, group, length, shallow)
        suffixes = [(int(group[i]), data[i : i + length].tobytes()) for i in starts]
        counts = Counter(suffixes)
        assert [suffixes[i] for i in order] == sorted(suffixes)
        assert equal.tolist() == [counts[s] > 1 for s in suffixes]
