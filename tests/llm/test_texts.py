from __future__ import annotations

import random
import re

import numpy as np
import pytest

from punctual.llm import lines, passages, quality

SCHEMA = "doc_id long, text string, source string"


def plain_lines(rows, min_sites):
    """The rule of boilerplate in plain Python."""
    sites, first = {}, {}
    for doc, text, site in rows:
        for pos, line in enumerate((text or "").split("\n") if text is not None else []):
            key = line.strip(" \t\r")
            if key:
                sites.setdefault(key, set()).add(site or "")
                first[key] = min(first.get(key, (doc, pos)), (doc, pos))
    out = []
    for doc, text, site in rows:
        if text is None:
            out.append((doc, None, None, None))
            continue
        parts = text.split("\n")
        keep = [
            p for i, p in enumerate(parts)
            if not (k := p.strip(" \t\r")) or len(sites[k]) < min_sites or first[k] == (doc, i)
        ]
        out.append((doc, "\n".join(keep), len(parts), len(parts) - len(keep)))
    return out


def test_boilerplate_against_the_plain_rule(spark):
    rng = random.Random(2)
    common = [f"common line {i}" for i in range(30)]
    rows = []
    for i in range(400):
        body = [rng.choice([rng.choice(common[: 1 + i % 30]), f"own {i} {k}", "", "  ", f" {common[0]}\r"]) for k in range(rng.randrange(6))]
        rows.append((i, "\n".join(body), f"s{rng.randrange(14)}" if i % 9 else None))
    rows += [(900, None, "s1"), (901, "", "s1"), (902, "\n\n", None), (903, "long " * 50_000, "s2")]
    rows += [(904, "\n".join([common[0]] * 3000), "s3")]
    got = lines.remove_boilerplate(spark.createDataFrame(rows, SCHEMA), min_sites=8)
    assert sorted(map(tuple, got.collect())) == sorted(plain_lines(rows, 8))


def test_boilerplate_keeps_repeated_rows_and_other_columns(spark):
    rows = [(1, "x\ny", f"s{i}", i) for i in range(3)] * 2 + [(None, "y", "s9", 7)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, n_removed int")
    got = lines.strip_boilerplate(table, min_sites=3).collect()
    # A NULL id comes first, so it keeps y; all rows of id 1 hold the first x.
    assert sorted((r.row.doc_id or 0, r.text, r.n_removed, r.row.n_removed) for r in got) == sorted(
        [(1, "x", 1, i) for i in range(3)] * 2 + [(0, "y", 0, 7)]
    )
    assert lines.remove_boilerplate(table.limit(0)).count() == 0


def plain_passages(docs, min_words):
    """The rule of paragraphs in plain Python, units by sentence marks only."""
    found = {}
    every = []
    for doc, text in docs:
        words = [(m.start(), m.end(), m[0].translate(LOWER)) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
        ends = [i + 1 for i, w in enumerate(words) if w[2][-1] in ".!?" or i == len(words) - 1]
        starts = [0, *ends[:-1]] if ends else []
        runs = [(s, next((e for e in ends if e >= s + min_words), None)) for s in starts]
        runs += [(s, len(words)) for s in [next((s for s in reversed(starts) if len(words) - s >= min_words), None)] if s is not None]
        for s, e in dict.fromkeys(runs):
            if e:
                key = tuple(w[2] for w in words[s:e])
                every.append((doc, s, e, key))
                found[key] = min(found.get(key, (doc, s)), (doc, s))
        every.append((doc, -1, -1, words))
    out = {}
    for doc, text in docs:
        words = next(k for d, s, e, k in every if d == doc and s == -1)
        gone = [False] * len(words)
        for d, s, e, key in every:
            if d == doc and s >= 0 and found[key] != (doc, s):
                gone[s:e] = [True] * (e - s)
        spans = []
        for i, g in enumerate(gone):
            if g and i and gone[i - 1]:
                spans[-1] = (spans[-1][0], words[i][1])
            elif g:
                spans.append((words[i][0], words[i][1]))
        rest, at = "", 0
        for a, b in spans:
            rest, at = rest + text[at:a], b
        out[doc] = (None if text is None else rest + text[at:], spans)
    return out


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_passages_against_the_plain_rule(spark):
    rng = random.Random(4)
    sentences = [" ".join(f"é{rng.randrange(300)}" for _ in range(rng.randrange(3, 15))) + rng.choice(".!?") for _ in range(60)]
    docs = []
    for i in range(120):
        picked = [rng.choice(sentences) if rng.random() < 0.4 else f"own{i} x{k} y{k} z." for k in range(rng.randrange(12))]
        text = rng.choice([" ", "\n", "  "]).join(picked)
        docs.append((i, text.upper() if i % 7 == 0 else text))
    docs += [(500, None), (501, ""), (502, "  "), (503, docs[5][1]), (504, "Ab. " * 20_000)]
    # Units then end at sentence marks only.
    got = passages.remove_repeated_passages(spark.createDataFrame(docs, "doc_id long, text string"), cut=1 << 40)
    found = {r.doc_id: (r.text, [tuple(x) for x in r.removed]) for r in got.collect()}
    assert found == plain_passages(docs, passages.MIN_WORDS)


def test_passages_keep_the_earliest_and_leave_offsets(spark):
    shared = " ".join(f"shared{i}" for i in range(30)) + "."
    docs = [
        (3, f"A first one. {shared} The end."),
        (1, f"Start é here.\n{shared}"),
        (2, f"Glued {shared.upper()} Tail stays."),
        (4, None),
        (5, ""),
        (6, f"Clean text {' '.join(f'own{i}' for i in range(40))}."),
        (7, "short copy."),
        (8, "short copy."),
    ]
    got = {r.doc_id: r for r in passages.remove_repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    texts = dict(docs)
    for d in (1, 4, 5, 6, 7, 8):
        assert got[d].text == texts[d] and got[d].removed == []
    assert got[3].text == "A first one.  The end."
    assert [texts[3][s.start : s.end] for s in got[3].removed] == [shared]
    # The glued sentence has units of its own after its first content-defined cut at the latest.
    for s in got[2].removed:
        assert texts[2][s.start : s.end].lower() in shared
    rest, at = "", 0
    for s in got[2].removed:
        rest, at = rest + texts[2][at : s.start], s.end
    assert got[2].text == rest + texts[2][at:]


def test_passages_of_equal_rows_null_ids_and_empty_tables(spark):
    body = " ".join(f"word{i}" for i in range(50)) + "."
    rows = [(1, body, "k"), (1, body, "l"), (None, body, "m")]
    table = spark.createDataFrame(rows, "doc_id long, text string, places string")
    got = passages.strip_passages(table).collect()
    assert sorted((r.row.places, r.text) for r in got) == [("k", body), ("l", body), ("m", "")]
    assert passages.remove_repeated_passages(table.limit(0)).count() == 0


def quality_rows(n, seed):
    rng = random.Random(seed)
    words = ["the", "of", "morning", "river", "and", "letter", "house", "stone", "water", "green"]
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        own = [rng.choice(words) for _ in range(rng.randrange(20, 200))]
        if good:
            text = " ".join(own).capitalize() + "."
        else:
            text = rng.choice([" ".join(w.upper() + "!!" for w in own), " | ".join(own), " ".join([own[0]] * 50)])
        rows.append((i, text))
        if i % 2:
            labels.append((i, int(good)))
    return rows, labels


def test_quality_on_held_out_documents(spark):
    rows, labels = quality_rows(600, 1)
    rows += [(9000, None), (9001, ""), (9002, "x" * 200_000), (None, "and the river.")]
    labels += [(9000, None), (1, 0), (1, 1), (None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.score_documents(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    by_id = {r.row.doc_id: r for r in got}
    truth = {d: q for d, q in labels[:-4]}
    held = [d for d in truth if by_id[d].held_out and d != 1]
    assert len(held) > 30
    assert np.mean([by_id[d].predicted == truth[d] for d in held]) >= 0.95
    assert by_id[9000].score == by_id[9001].score


@pytest.mark.parametrize("labels, share", [([], 0.5), ([(2, 1), (3, 1), (4, 1), (6, 1)], 1.0)])
def test_quality_without_two_classes(spark, labels, share):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(8)], "doc_id long, text string")
    got = quality.score_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert {round(r.score, 3) for r in got} == {share}
    assert quality.score_documents(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0


def test_quality_of_repeated_rows_and_clashing_columns(spark):
    rows, labels = quality_rows(200, 2)
    columns = "doc_id long, text string, row long, score double, label int, held_out int, predicted int"
    table = spark.createDataFrame([(*r, 7, -1.0, i % 2, 3, 4) for i, r in enumerate(rows + rows[:20])], columns)
    marks = spark.createDataFrame([(*r, "x") for r in labels + labels[:20]], "doc_id long, quality int, text string")
    got = quality.score_documents(table, marks).collect()
    assert len(got) == 220 and {(r.row.row, r.row.score, r.row.held_out, r.row.predicted) for r in got} == {(7, -1.0, 3, 4)}
    scores = {}
    for r in got:
        scores.setdefault(r.row.doc_id, set()).add((r.score, r.held_out, r.predicted))
    assert len(scores) == 200 and all(len(own) == 1 for own in scores.values())
    truth = dict(labels)
    held = [(d, own) for d, own in scores.items() if d in truth and next(iter(own))[1]]
    assert held and np.mean([next(iter(own))[2] == truth[d] for d, own in held]) >= 0.9


def test_descent_reaches_the_optimum():
    """The dual solution satisfies the optimality conditions of the hinge-loss problem."""
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 12, 5)) for _ in range(60)]
    values = [rng.normal(0, 1, len(r)) for r in rows]
    y = np.where(rng.random(60) < 0.5, 1.0, -1.0)
    cost = np.full(60, 0.3)

    def loss(w, b):
        margins = np.array([w[r] @ v + b for r, v in zip(rows, values)])
        return (w @ w + b * b) / 2 + (cost * np.maximum(0, 1 - y * margins)).sum()

    w, b = quality.dual_coordinate_descent(rows, values, y, cost, 12, epochs=2000)
    best = loss(w, b)
    for _ in range(200):
        assert loss(w + rng.normal(0, 0.01, 12), b + rng.normal(0, 0.01)) >= best - 1e-3
