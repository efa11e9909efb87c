"""Stages of the pipeline against plain versions that share no code with the operators."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from punctual.llm import queries
from tests.llm.plain import LOWER, WORD, plain_passages
from tests.llm.test_pipeline import stages, texts  # noqa: F401


def test_near_duplicate_stage_against_all_pairs(stages):  # noqa: F811
    before, after = (texts(x) for x in stages["near_duplicates"])
    sets, having = {}, defaultdict(set)
    for doc, text in before.items():
        words = WORD.findall((text or "").translate(LOWER))
        runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else [])
        sets[doc] = set(runs)
        for run in sets[doc]:
            having[run].add(doc)
    parent = {doc: doc for doc in before}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in {d for run in sets[a] for d in having[run]} - {a}:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((top(a), top(b)))
                parent[high] = low
    assert set(after) == {doc for doc in before if top(doc) == doc}
    assert len(after) < len(before) and all(after[d] == before[d] for d in after)


def test_passage_stage_against_the_plain_rule(stages):  # noqa: F811
    before, after = (texts(x) for x in stages["passages"])
    expect = plain_passages(list(before.items()))
    assert after == {d: t for d, (t, spans) in expect.items() if not spans or t.split()}
    assert any(spans for _, spans in expect.values())


def test_packing_stage_against_the_library(stages):  # noqa: F811
    docs, pieces = stages["packing"]
    library = Tokenizer.from_file(queries.BYTE_VOCABULARY)
    expect = set()
    for doc, text in texts(docs).items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        expect |= {(doc, s, min(2048, len(ids) - s), zlib.crc32(ids[s : s + 2048].tobytes())) for s in range(0, len(ids), 2048)}
    got = pieces.collect()
    assert len(got) == len(expect) and {(r.doc_id, r.start, r.length, r.ids_crc32) for r in got} == expect
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for placed in sequences.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= 2048
    assert sorted(sequences) == list(range(len(sequences)))
