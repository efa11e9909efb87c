"""Plain versions of operators, with the parameters that they run with."""

from __future__ import annotations

import re

import numpy as np

from punctual.llm import passages
from punctual.llm.words import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_hash(word, known={}):
    if word not in known:
        raw = np.frombuffer(word.encode(), np.uint8)
        known[word] = int(Words(raw, np.array([0, len(raw)])).hashes()[0])
    return known[word]


def unit_ends(words, cut):
    """Ends after marks, after the least hashes of every `cut` words without a mark, and of the text."""
    ends = {i + 1 for i, w in enumerate(words) if w[-1] in ".!?"} | {len(words)}
    for s in range(len(words) - cut + 1):
        window = words[s : s + cut]
        if not any(w[-1] in ".!?" for w in window):
            least = min(word_hash(w) | 1 for w in window)
            ends |= {s + i + 1 for i, w in enumerate(window) if word_hash(w) | 1 == least}
    return sorted(ends)


def plain_passages(docs, min_words=passages.MIN_WORDS, cut=passages.CUT):
    """{id: (text, spans)}; ids are distinct."""
    places, first, every = {}, {}, []
    for doc, text in docs:
        places[doc] = [(m.start(), m.end()) for m in WORD.finditer(text or "")]
        words = [text[a:b].translate(LOWER) for a, b in places[doc]]
        if len(words) < min_words:
            continue
        ends = unit_ends(words, cut)
        starts = [0, *ends[:-1]]
        runs = {(s, next((e for e in ends if e >= s + min_words), None)) for s in starts}
        runs.add((max(s for s in starts if len(words) - s >= min_words), len(words)))
        for s, e in runs:
            if e is not None:
                key = tuple(words[s:e])
                every.append((doc, s, e, key))
                first[key] = min(first.get(key, (doc, s)), (doc, s))
    gone = {doc: [False] * len(spots) for doc, spots in places.items()}
    for doc, s, e, key in every:
        if first[key] != (doc, s):
            gone[doc][s:e] = [True] * (e - s)
    out = {}
    for doc, text in docs:
        spans = []
        for i, (a, b) in enumerate(places[doc]):
            if gone[doc][i]:
                spans[-1:] = [(spans[-1][0], b)] if i and gone[doc][i - 1] else [*spans[-1:], (a, b)]
        rest, at = "", 0
        for a, b in spans:
            rest, at = rest + text[at:a], b
        out[doc] = (None if text is None else rest + text[at:], spans)
    return out
