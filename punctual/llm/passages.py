"""Removal of passages that repeat within and across documents, by paragraph hashing.

Words are lower-cased (A-Z) and white space between them does not count. A unit ends after a word
that ends in . ! or ?, and, where CUT words in a row have no such word, after those of smallest hash
among them. So no unit is longer than CUT words, whatever the text, and units that lie CUT words or
more inside a passage are the same wherever it stands. A paragraph is a run of whole units, from any
unit on, up to the first that brings it to MIN_WORDS words: every passage of 4 CUT + MIN_WORDS - 3
words (45) holds one. Equal paragraphs are found by their 128-bit digests.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from punctual.llm.storage import freeing, stored
from punctual.llm.words import U, Words, slices, span_hashes, text_buffers

MIN_WORDS = 16
CUT = 8
_SECOND = 0xC2B2AE3D27D4EB4F
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".!?"]] = True


def _over_runs(op, x: np.ndarray, size: int) -> np.ndarray:
    """op over every run of `size` values."""
    have = 1
    while have < size:
        step = min(have, size - have)
        x = op(x[:-step], x[step:])
        have += step
    return x


def _stops(words: Words, hashes: np.ndarray, cut: int) -> np.ndarray:
    """Whether a unit ends after each word. A mark is the least of hashes; all that are least in a window are stops."""
    marks = _MARK[words.data[words.ends - 1]]
    if len(words) < cut:
        return marks
    keys = np.where(marks, U(0), hashes | U(1))
    least = _over_runs(np.minimum, keys, cut)
    least[words.text[: len(least)] != words.text[cut - 1 :]] = 0
    # A word is the least of some window if it equals the largest of the minima of all windows around it.
    around = np.zeros(len(words) + cut - 1, U)
    around[cut - 1 : len(words)] = least
    return _over_runs(np.maximum, around, cut) == keys


class Paragraphs:
    """All paragraphs of some texts: first word, end word, text, digests, and whether an earlier one equals it."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, min_words: int, cut: int = CUT):
        self.words = words = Words(data, bounds, lower=True)
        n = len(words)
        hashes = words.hashes() if n else np.zeros(0, U)
        stops = _stops(words, hashes, cut) if n else np.zeros(0, bool)
        last_words = words.first[1:][np.diff(words.first) > 0] - 1
        stops[last_words] = True
        ends = np.flatnonzero(stops) + 1
        starts = np.concatenate([[0], ends[:-1]]) if n else ends
        text = words.text[starts] if n else np.zeros(0, np.int64)
        # The first unit end at or after start + min_words, in the same text.
        at = np.searchsorted(ends, starts + min_words)
        fits = at < len(ends)
        fits[fits] &= text[at[fits]] == text[fits]
        # The last run of a text that is long enough, unless it is one of these already.
        stop = words.first[1:]
        last = np.searchsorted(starts, stop - min_words, "right") - 1
        own = (last >= 0) & (stop - words.first[:-1] >= min_words)
        last, stop = last[own], stop[own]
        more = ~fits[last] | (ends[np.minimum(at[last], len(ends) - 1)] != stop) if n else np.zeros(0, bool)
        start = np.concatenate([starts[fits], starts[last[more]]])
        end = np.concatenate([ends[at[fits]], stop[more]])
        text = np.concatenate([text[fits], text[last[more]]])
        tail = np.arange(len(start)) >= int(fits.sum())
        order = np.lexsort((end, start, text))
        self.start, self.end, self.text, tail = start[order], end[order], text[order], tail[order]
        # Names a paragraph in its text, counted from the text's first word.
        self.place = (self.start - words.first[:-1][self.text]) * 2 + tail
        self.h1 = span_hashes(hashes, self.start, self.end) if n else hashes
        self.h2 = span_hashes(hashes ^ U(0x5851F42D4C957F2D), self.start, self.end, _SECOND | 1) if n else hashes
        order = np.lexsort((self.start, self.h2, self.h1, self.text))
        t, a, b = self.text[order], self.h1[order], self.h2[order]
        again = np.zeros(len(order), bool)
        again[1:] = (t[1:] == t[:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        # first_of[i]: the earliest equal paragraph of the same text.
        first = np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))
        self.first_of = np.empty(len(order), np.int64)
        self.first_of[order] = order[first]


def _emitter(min_words: int, cut: int):
    """The distinct paragraphs of every text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(c) for c in ("k1", "k2", "doc")]
            data, bounds = text_buffers(batch.column("text"))
            for i, j in slices(bounds):
                found = Paragraphs(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], min_words, cut)
                own = np.flatnonzero(found.first_of == np.arange(len(found.start)))
                rows = pa.array(found.text[own] + i)
                yield pa.record_batch(
                    [*(k.take(rows) for k in keys), pa.array(found.place[own])]
                    + [pa.array(h[own].view(np.int64)) for h in (found.h1, found.h2)],
                    names=["k1", "k2", "doc", "place", "h1", "h2"],
                )

    return run


def _char_offsets(raw: np.ndarray, byte_places: np.ndarray) -> np.ndarray:
    """Character offsets of byte offsets in one text."""
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return chars[byte_places]


def _remover(min_words: int, cut: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_buffers(batch.column("text"))
            null = batch.column("text").is_null().to_numpy(zero_copy_only=False)
            lost = batch.column("places")
            texts, starts, ends, sizes = [], [], [], []
            for i, j in slices(bounds):
                found = Paragraphs(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], min_words, cut)
                words, local = found.words, np.zeros(len(found.words) + 1, np.int64)
                goes = found.first_of != np.arange(len(found.start))
                begins = np.searchsorted(found.text, np.arange(j - i + 1))
                for k in range(i, j):
                    places = lost[k].values if lost[k].is_valid else None
                    if places is None:
                        continue
                    low, high = begins[k - i], begins[k - i + 1]
                    hit = np.isin(found.place[low:high], places.to_numpy(zero_copy_only=False))
                    goes[low:high] |= hit[found.first_of[low:high] - low]
                np.add.at(local, found.start[goes], 1)
                np.add.at(local, found.end[goes], -1)
                covered = np.cumsum(local)[:-1] > 0
                for k in range(i, j):
                    a, b = words.first[k - i], words.first[k - i + 1]
                    raw = data[bounds[k] : bounds[k + 1]]
                    mask = covered[a:b]
                    if null[k] or not mask.any():
                        texts.append(None if null[k] else raw.tobytes())
                        sizes.append(0)
                        continue
                    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
                    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
                    base = bounds[k] - bounds[i]
                    s, e = words.starts[a + first] - base, words.ends[a + last] - base
                    keep = np.ones(len(raw), bool)
                    for x, y in zip(s.tolist(), e.tolist()):
                        keep[x:y] = False
                    texts.append(raw[keep].tobytes())
                    starts.append(_char_offsets(raw, s))
                    ends.append(_char_offsets(raw, e))
                    sizes.append(len(s))
            none = np.zeros(0, np.int64)
            spans = pa.StructArray.from_arrays(
                [pa.array(np.concatenate(x) if x else none, pa.int64()) for x in (starts, ends)], ["start", "end"]
            )
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.record_batch(
                [
                    batch.column("row"),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                    pa.ListArray.from_arrays(offsets, spans),
                ],
                names=["row", "text", "removed"],
            )

    return run


def strip_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, cut: int = CUT
) -> DataFrame:
    """(row, text, removed): the other columns of every input row as a struct, the rest of its text, the spans.

    Of equal paragraphs the earliest by id and place stays; of the others every word goes, with the
    white space between them, and `removed` keeps their [start, end) character offsets in the original
    text, in order, overlapping paragraphs as one span. Texts under min_words words have no paragraph
    and stay. Copies that overlap the earliest one, as in a run of one word, go with the words they share
    with it. A NULL text stays NULL with no spans, an empty one empty. Rows of one id are one document:
    they don't remove each other's paragraphs, and equal rows get equal output; a NULL id comes after
    all others. Ids are integers. Other columns are passed on unread.
    """
    text, doc = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"),
        F.xxhash64(doc, text).alias("k1"),
        F.xxhash64(F.lit(1), doc, text).alias("k2"),
        F.coalesce(doc, F.lit(2**63 - 1)).alias("doc"),
        text.alias("text"),
    )
    schema = "k1 long, k2 long, doc long, place long, h1 long, h2 long"
    found = rows.select("k1", "k2", "doc", "text").mapInArrow(freeing(_emitter(min_words, cut)), schema)
    grouped = found.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    repeated = stored(grouped.where("first < last").select("h1", "h2", "first"), "repeated-paragraphs")
    gone = found.join(repeated, ["h1", "h2"]).where("doc > first")
    gone = gone.groupBy("k1", "k2").agg(F.collect_set("place").alias("places"))
    joined = rows.join(gone, ["k1", "k2"], "left").select("row", "text", "places")
    out = T.StructType(
        [
            joined.schema["row"],
            T.StructField("text", T.StringType()),
            T.StructField("removed", T.ArrayType(T.StructType.fromDDL("start long, end long"))),
        ]
    )
    return joined.mapInArrow(freeing(_remover(min_words, cut)), out)


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id, text, n_removed, removed) of strip_passages."""
    out = strip_passages(docs, id_col, text_col, **how)
    return out.select(
        F.col("row")[id_col].alias(id_col), "text", F.size("removed").cast("long").alias("n_removed"), "removed"
    )
