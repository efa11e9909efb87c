from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from punctual.llm import queries, spelling
from tests.llm.plain import LOWER

SF = "/root/testdata/sf0.001"


def plain_variants(docs, letters=6, occurrences=5, factor=5, slips=0):
    counts = Counter()
    for doc, text in docs:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = word.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode()) if slips else 1
            if slips and h % slips == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= letters and n >= occurrences}
    near = defaultdict(set)
    holes = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            holes[w[:i] + "_" + w[i + 1 :]].add(w)
            if w[:i] + w[i + 1 :] in counts:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    best = {w: min(near[w], key=lambda x: (-counts[x], x)) for w in counts if near[w]}
    form = {w: b for w, b in best.items() if counts[b] >= factor * counts[w]}
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_query_against_the_plain_rule(spark):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect()]
    want = plain_variants(docs, slips=199)
    assert rows_of(queries.op11_spelling(spark, SF)) == want
    assert len(want) > 500 and sum(r[4] for r in want) > 100


@pytest.mark.parametrize("block", [spelling.BLOCK, 7])
def test_few_letters_many_neighbours(spark, monkeypatch, block):
    """Words of two letters: most share their pieces, so that with small blocks most keys are cut up."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    rng = random.Random(block)
    words = ["".join(rng.choice("aé") for _ in range(rng.randrange(3, 9))) for _ in range(300)]
    words += ["long" * 15, "long" * 15 + "e", "lomg" + "long" * 14, "LONG" * 15]
    docs = [(i, " ".join(rng.choice(words[: 1 + i]) for _ in range(60))) for i in range(len(words))]
    docs += [(900, "-".join(words[-4:] * 2))]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = rows_of(spelling.spelling_variants(table, letters=3, occurrences=2, factor=2, slips=11))
    assert got == plain_variants(docs, 3, 2, 2, 11)


def test_chains_ties_and_edges(spark):
    # aaaaab -> aaaaaa -> aaaaac by number; the two forms of baaaaa tie, the smaller in code-point order wins.
    text = "aaaaab " * 5 + "AAAAAA " * 25 + "aaaaac! " * 125 + "naaaac " + "ÿoooooz " * 5 + "×oooooz " * 25
    text += "qqqqqr " * 5 + "qqqqqs " * 30 + "qqqqqt " * 30
    rows = [(1, text, "w"), (1, None, "w"), (2, "", "w"), (None, "x" * 3_000_000 + " 12 a", "w")] + [(3, "naaaac", "w")] * 4
    table = spark.createDataFrame(rows, "doc_id long, text string, word string")
    got = rows_of(spelling.spelling_variants(table))
    assert got == plain_variants([r[:2] for r in rows])
    by_word = {r[0]: r for r in got}
    assert by_word["aaaaab"][1:3] == ("aaaaac", "aaaaac")
    assert by_word["qqqqqr"][1] == "qqqqqs"
    assert by_word["ÿoooooz"][1] == "×oooooz"
    assert spelling.spelling_variants(table.limit(0)).count() == 0
    assert spelling.spelling_variants(table.where("doc_id = 2")).count() == 0


def test_a_very_long_word_in_every_document(spark):
    word = "ab" * 20_000
    rows = [(i, f"{word} {word}c") for i in range(5)] + [(9, f"{word}b " * 40)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(spelling.spelling_variants(table)) == plain_few(rows)


def plain_few(rows):
    # The plain version is quadratic in a word's letters; these three are near by construction.
    word = rows[0][1].split()[0]
    return sorted(
        [(word, word + "b", word + "b", 5, 2, 40), (word + "c", word + "b", word + "b", 5, 2, 40)]
        + [(word + "b", None, word + "b", 40, 2, None)]
    )
