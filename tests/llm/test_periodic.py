from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from punctual.llm import periodic, queries
from tests.llm.plain import WORD

SF = "/root/testdata/sf0.001"


def plain_runs(words, min_words=24, times=3):
    """Every lag compared at every place; a stretch counts at its smallest period."""
    found, n = [], len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            own = words[i : i + size]
            if j > i and size >= max(min_words, times * q) and all(own[p:] != own[:-p] for p in range(1, q)):
                found.append((i, size, q))
            i = max(j, i) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_query(doc, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(("" if doc is None else str(doc)).encode())
    if h % 10 == 0 and n:
        g, old = h // 10, list(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [old[i] if i < a else old[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    rest = " ".join(w for i, w in enumerate(words) if i not in gone)
    milli = 1000 * top[1] // top[2] if runs else None
    return (doc, len(runs), *top, milli, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, rest)))


def test_query_against_every_lag(spark):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect() if len(r.text or "") < 20_000]
    got = {r.doc_id: tuple(r) for r in queries.op13_periodic(spark, SF).collect()}
    assert len(got) == queries.table(spark, SF, "documents").count()
    for doc, text in docs:
        assert got[doc] == plain_query(doc, text)
    assert sum(got[doc][1] > 0 for doc, _ in docs) > 10


def test_runs_of_random_words():
    rng = random.Random(4)
    for _ in range(600):
        n, kinds = rng.randrange(150), rng.choice([1, 2, 3, 6, 40])
        words = [b"%d" % rng.randrange(kinds) for _ in range(n)]
        for _ in range(rng.randrange(3) if n else 0):
            a, p = rng.randrange(n), rng.randrange(1, 20)
            for i in range(a, min(n, a + rng.randrange(90))):
                words[i] = words[a + (i - a) % p]
        low, times = rng.choice([(24, 3), (6, 3), (10, 4)])
        got = [tuple(r) for r in periodic.word_runs(words, low, times).tolist()]
        assert got == plain_runs(words, low, times)


def test_splitting_recurses_to_stability():
    # Each round makes one more word rare: b stands three times only while the word before it does.
    chain = [f"{c}{i}".encode() for i in range(40) for c in "xyx"]
    run = [b"p", b"q"] * 20
    words = chain + run + chain[::-1]
    names = {w: i for i, w in enumerate(dict.fromkeys(words))}
    import numpy as np

    codes = np.array([names[w] for w in words])
    for a, b in periodic.stable_segments(codes):
        assert min(np.bincount(codes[a:b])[codes[a:b]]) >= 3
    assert [tuple(r) for r in periodic.word_runs(words).tolist()] == [(120, 40, 2)]


def test_edges(spark):
    long = " ".join(f"w{i % 1000}" for i in range(200_000))
    rows = [(1, None, 5), (2, "", 5), (3, "  \n", 5), (4, "a " * 23, 5), (5, "a\t" * 24, 5), (5, "a\t" * 24, 5)]
    rows += [(None, "A a " * 12, 5), (7, long, 5)]
    table = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    found = periodic.periodic_runs(table).collect()
    got = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.text) for r in found)
    first = " ".join(f"w{i}" for i in range(1000))
    assert got == sorted(
        [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 23, [], " ".join("a" * 23))]
        + [(5, 24, [(0, 24, 1)], "a")] * 2
        + [(0, 24, [(0, 24, 2)], "A a"), (7, 200_000, [(0, 200_000, 1000)], first)]
    )
    assert periodic.periodic_runs(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(table, times=2)
