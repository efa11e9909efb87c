"""Passages of op10 with the parameters that it runs with."""

from __future__ import annotations

import random

import numpy as np
import pytest

from punctual.llm import passages
from tests.llm.plain import plain_passages

SCHEMA = "doc_id long, text string"


def runs(words, size):
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def planted(rng, kind, size):
    """A passage without a sentence mark."""
    if kind == "varied":
        return [f"v{rng.randrange(10**9)}" for _ in range(size)]
    if kind == "few":
        return [rng.choice(["and", "an", "or"]) for _ in range(size)]
    return ["same"] * size


@pytest.mark.parametrize("kind", ["varied", "few", "one"])
def test_no_long_passage_stays_twice(spark, kind):
    """Passages of 51 to 80 words in the middle of open sentences, of different length around them."""
    rng = random.Random(9)
    docs, whole = [], []
    for k in range(150):
        body = planted(rng, kind, rng.randrange(51, 81))
        for copy in range(2):
            before, after = ([f"o{rng.randrange(10**9)}" for _ in range(rng.randrange(30))] for _ in range(2))
            whole.append((len(docs), " ".join([*before, *body, *after])))
            docs.append((before, body, after))
    found = passages.remove_repeated_passages(spark.createDataFrame(whole, SCHEMA)).collect()
    left = {r.doc_id: r.text.split() for r in found}
    earlier = set()
    for i, (before, body, after) in enumerate(docs):
        assert not runs(left[i], 51) & earlier, i
        earlier |= runs([*before, *body, *after], 51)
        # What was not planted stays, but for what its last words and the passage's first make up.
        if kind == "varied":
            assert left[i][: len(before)] == before and left[i][len(left[i]) - len(after) :] == after


def test_units_are_short_in_every_text():
    rng = np.random.default_rng(5)
    for text in ("w " * 500, "a b " * 300, " ".join(f"x{i}" for i in rng.integers(0, 10**9, 5000)), "你好、" + " 世界。 " * 90):
        raw = np.frombuffer(text.encode(), np.uint8)
        found = passages.Paragraphs(raw, np.array([0, len(raw)]), passages.MIN_WORDS)
        assert (found.end - found.start).max() < passages.MIN_WORDS + passages.CUT
        assert np.diff(np.unique(found.start)).max() <= passages.CUT


def test_production_parameters_against_the_plain_rule(spark):
    rng = random.Random(12)
    pool = [[rng.choice([f"é{rng.randrange(60)}", f"W{rng.randrange(900)}"]) for _ in range(rng.randrange(5, 90))] for _ in range(40)]
    docs = [(500, None), (501, ""), (502, "  "), (503, "and " * 200), (504, "Ab. " * 300), (505, "an and or " * 90)]
    for i in range(150):
        parts = []
        for _ in range(rng.randrange(7)):
            own = [f"own{i}x{rng.randrange(99)}" for _ in range(rng.randrange(1, 40))]
            parts += rng.choice([own, rng.choice(pool)])
            if parts and rng.random() < 0.4:
                parts[-1] += rng.choice(".!?,")
        text = rng.choice([" ", "\n", "  "]).join(parts)
        docs.append((i, text.upper() if i % 7 == 0 else text))
    got = passages.remove_repeated_passages(spark.createDataFrame(docs, SCHEMA)).collect()
    expect = plain_passages(docs)
    assert {r.doc_id: (r.text, [tuple(x) for x in r.removed]) for r in got} == expect
    assert sum(len(spans) > 0 for _, spans in expect.values()) > 50
