"""Periodic runs of words: recursive splitting at words that are too rare, then a scan of the lags left.

A run of period q holds at least `times` periods, so each of its words stands in it `times` times or
more. A word that occurs less often in a segment is in none of the segment's runs: it splits the
segment, its parts are counted anew, and so on until no part has a rare word. Most texts end there.

What survives is scanned for lags. At each scale k = 1, 2, 4, ... a place's lag is the distance to the
previous equal block of k words. Inside a run of smallest period q, k / 2 < q <= k, equal blocks of
k >= q words never lie closer than q, so the run is one stretch of places of lag q, from its second
period on, and begins and ends exactly where that stretch says. Blocks are named by pairs of names of
half the size, never by hashes, so no run is lost or made up and none is verified again.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

MIN_WORDS, TIMES = 24, 3
#: Bytes of texts that are given back in one batch.
BATCH_BYTES = 1 << 23


def _stretches(mask: np.ndarray, least: int) -> list[tuple[int, int]]:
    """[start, end) of the stretches of true values of at least `least` places."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist()))


def stable_segments(codes: np.ndarray, min_words: int = MIN_WORDS, times: int = TIMES) -> list[tuple[int, int]]:
    """[start, end) of the parts that remain when no part has a word of fewer than `times` places in it.

    When a segment splits, only its smaller parts are counted anew; the largest one's counts are those of
    the segment less what went. A word's places are looked at again only when it leaves a segment or
    becomes rare in it, so the work is n log n however deep the splitting goes.
    """
    if len(codes) < min_words:
        return []
    counts = np.bincount(codes)
    parts = _stretches(counts[codes] >= times, min_words)
    if not parts:
        return []
    words = codes.tolist()
    order = np.argsort(codes, kind="stable")
    first = np.concatenate([[0], np.cumsum(counts)])

    def places(word: int, a: int, b: int) -> list[int]:
        own = order[first[word] : first[word + 1]]
        low, high = np.searchsorted(own, [a, b])
        return own[low:high].tolist()

    done = []
    # (start, end, counts of its words, words that have become rare; None: all words must be looked at)
    todo = [(a, b, Counter(words[a:b]), None) for a, b in parts]
    while todo:
        a, b, counts, rare = todo.pop()
        if rare is None:
            cuts = [i for i in range(a, b) if counts[words[i]] < times]
        else:
            cuts = sorted(i for word in rare for i in places(word, a, b))
        if not cuts:
            done.append((a, b))
            continue
        edges = [a - 1, *cuts, b]
        parts = [(x + 1, y) for x, y in zip(edges, edges[1:]) if y - x > min_words]
        if not parts:
            continue
        largest = max(parts, key=lambda part: part[1] - part[0])
        if 2 * (largest[1] - largest[0]) < b - a:
            todo += [(x, y, Counter(words[x:y]), None) for x, y in parts]
            continue
        todo += [(x, y, Counter(words[x:y]), None) for x, y in parts if (x, y) != largest]
        rare = []
        for word, n in Counter(words[a : largest[0]] + words[largest[1] : b]).items():
            counts[word] -= n
            if 0 < counts[word] < times:
                rare.append(word)
        todo.append((*largest, counts, rare))
    return sorted(done)


def lag_runs(codes: np.ndarray, min_words: int = MIN_WORDS, times: int = TIMES) -> np.ndarray:
    """(start, length, period) of every run, in no order; `times` is 3 or more."""
    n, names, block, found = len(codes), codes, 1, []
    while times * (block // 2 + 1) <= n and block <= n:
        order = np.argsort(names.astype(np.uint16) if n < 1 << 16 else names, kind="stable")
        at, before = order[1:], order[:-1]
        equal = names[at] == names[before]
        if not equal.any():
            break
        lag = np.zeros(len(names), np.int64)
        lag[at[equal]] = (at - before)[equal]
        lag[(lag <= block // 2) | (lag > block)] = 0
        edges = np.flatnonzero(np.diff(lag, prepend=0, append=0))
        low, high = edges[:-1], edges[1:]
        period = lag[low] if len(low) else low
        start, length = low - period, high - low + block - 1 + period
        fits = (period > 0) & (length >= np.maximum(min_words, times * period))
        found.append(np.column_stack([start, length, period])[fits])
        if len(names) <= block:
            break
        # Names of blocks of twice the size, in order of their halves.
        pairs = names[:-block] * np.int64(n + 1) + names[block:]
        order = np.argsort(pairs, kind="stable")
        new = np.empty(len(pairs), np.int64)
        new[order] = np.cumsum(np.diff(pairs[order], prepend=pairs[order[0]]) != 0)
        names, block = new, block * 2
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def word_runs(words: list[bytes], min_words: int = MIN_WORDS, times: int = TIMES) -> np.ndarray:
    """(start, length, period) of every run of one text, by start and period."""
    if len(words) < min_words:
        return np.zeros((0, 3), np.int64)
    names: dict[bytes, int] = defaultdict()
    names.default_factory = names.__len__
    codes = np.fromiter(map(names.__getitem__, words), np.int64, len(words))
    found = []
    for a, b in stable_segments(codes, min_words, times):
        own = np.unique(codes[a:b], return_inverse=True)[1].astype(np.int64)
        found.append(lag_runs(own, min_words, times) + [a, 0, 0])
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(edge[:-1]) == 0
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def _finder(min_words: int, times: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])

        def out(doc: pa.Array, sizes: list[int], runs: list[np.ndarray], texts: list[bytes]) -> pa.RecordBatch:
            every = np.concatenate([*runs, np.zeros((0, 3), np.int64)])
            bounds = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
            values = pa.StructArray.from_arrays([pa.array(every[:, i]) for i in range(3)], fields=list(kind))
            columns = [doc, pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), values)]
            return pa.record_batch([*columns, pa.array(texts, pa.binary()).cast(pa.string())], ["doc", "n_words", "runs", "rest"])

        for batch in batches:
            doc, text = batch.column("doc"), batch.column("text")
            low, size, sizes, runs, texts = 0, 0, [], [], []
            for i in range(batch.num_rows):
                words = (text[i].as_buffer().to_pybytes() if text[i].is_valid else b"").split()
                sizes.append(len(words))
                runs.append(word_runs(words, min_words, times))
                texts.append(b" ".join(collapse(words, runs[-1])))
                size += len(texts[-1])
                if size >= BATCH_BYTES:
                    yield out(doc[low : i + 1], sizes, runs, texts)
                    low, size, sizes, runs, texts = i + 1, 0, [], [], []
            if sizes:
                yield out(doc[low:], sizes, runs, texts)

    return run


def larger_exponent_first(left: Column, right: Column) -> Column:
    """Order of two runs: the larger exact length / period, then the smaller start, then the smaller period."""
    l, r = left["length"] * right["period"], right["length"] * left["period"]
    later = F.when(left["start"] != right["start"], left["start"] > right["start"]).otherwise(left["period"] > right["period"])
    same = (left["start"] == right["start"]) & (left["period"] == right["period"])
    return F.when(l > r, -1).when(l < r, 1).when(same, 0).when(later, 1).otherwise(-1)


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, times: int = TIMES
) -> DataFrame:
    """(id, n_words, runs, text): every run of every text by start and period, and the text without repeats.

    Words are runs of characters other than space and 0x09-0x0D, numbered from 0. A run is a stretch of
    words of smallest period `period`, of at least max(min_words, times * period) words, that no word
    next to it extends; runs may overlap. `text` has the words that no run holds after its first period,
    with one space between. NULL and empty texts have no words, no runs and an empty text. Each row is
    worked on alone: repeated rows and NULL ids give a row each, ties cannot arise, an empty table gives
    no rows. Other columns are not read. A text of n words takes n log n time and some 150 bytes a word
    of one task's memory, whatever its length and however its words repeat.
    """
    if times < 3:
        raise ValueError("runs of fewer than three periods have no unique lag here")
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    schema = f"doc {kind}, n_words long, runs array<struct<start:long, length:long, period:long>>, rest string"
    out = rows.mapInArrow(_finder(min_words, times), schema)
    return out.select(F.col("doc").alias(id_col), "n_words", "runs", F.col("rest").alias("text"))
