"""Packing of tokenised documents into fixed-length sequences, shortest pack first over a length histogram.

Documents are cut into pieces of at most the sequence length. Only the histogram of piece lengths
(as many numbers as a sequence has tokens) goes to the driver: lengths are placed longest first, each
into the open packs that are shortest, and the result is a list of patterns with counts. A piece finds
its place from its rank among the pieces of its length, so no piece is ever moved to the driver.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from punctual.llm.storage import freeing, stored
from punctual.llm.tokens import encoder, text_groups

SEQUENCE = 2048
END_ID = 1
#: Pieces of one length that are ranked together; ranks go on from group to group.
RANKED = 16_384


def pack_histogram(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, longest first) and how many sequences follow each."""
    open_packs: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    done: list[tuple[tuple[int, ...], int]] = []

    def put(space: int, pattern: tuple[int, ...], count: int) -> None:
        if space == 0:
            done.append((pattern, count))
        else:
            open_packs[space][pattern] = open_packs[space].get(pattern, 0) + count

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            space = max((s for s, packs in open_packs.items() if packs), default=0)
            if space < length:
                # No open pack takes it; several of this length may share a new one later in this loop.
                fits = min(left, max(1, -(-left * length // size)))
                put(size - length, (length,), fits)
                left -= fits
                continue
            pattern, count = open_packs[space].popitem()
            used = min(left, count)
            if used < count:
                open_packs[space][pattern] = count - used
            put(space - length, (*pattern, length), used)
            left -= used
    return done + [(p, n) for packs in open_packs.values() for p, n in packs.items()]


def placement(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length and run of ranks: the first sequence, pieces a sequence, and their first offset."""
    rows, first_sequence, ranks = [], 0, defaultdict(int)
    for pattern, count in patterns:
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            times = pattern.count(length)
            rows.append((length, ranks[length], first_sequence, times, offset))
            ranks[length] += times * count
            offset += times * length
        first_sequence += count
    rows.sort()
    names = ("length", "rank", "sequence", "times", "offset")
    return {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(names)}


def _cutter(path: str, size: int, end_id: int):
    """Pieces of every text: ids are made, counted and checked here, and go no further."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, keeps_spaces=True)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in text_groups(texts):
                ids, bounds = code.encode(texts[i:j])
                rows, starts, lengths, crcs, totals = [], [], [], [], []
                for k in range(j - i):
                    own = np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(own), size):
                        piece = own[start : start + size]
                        rows.append(i + k)
                        starts.append(start)
                        lengths.append(len(piece))
                        crcs.append(zlib.crc32(piece.tobytes()))
                        totals.append(len(own))
                numbers = [pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals)]
                yield pa.record_batch(
                    [batch.column("doc").take(pa.array(rows, pa.int64())), *numbers],
                    names=["doc", "start", "length", "ids_crc32", "doc_tokens"],
                )

    return run


def _placer(table: dict[str, np.ndarray]):
    # (length, rank) as one number: ranks of a length stay below the distance to the next length.
    lengths = table["length"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.empty(len(length), np.int64)
            for value in np.unique(length):
                low, high = np.searchsorted(lengths, [value, value + 1])
                mine = length == value
                at[mine] = low + np.searchsorted(table["rank"][low:high], rank[mine], "right") - 1
            inside = rank - table["rank"][at]
            sequence = table["sequence"][at] + inside // table["times"][at]
            offset = table["offset"][at] + inside % table["times"][at] * length
            names = ["doc", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.record_batch(
                [*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)],
                names=[*names, "sequence_id", "offset"],
            )

    return run


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SEQUENCE,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids, then end_id; it is cut into pieces of `size` ids and a rest. NULL and
    empty texts have end_id alone. Every id lies in one piece, every piece in one sequence; offsets in a
    sequence leave no gap. Rows with equal or NULL ids are documents of their own; equal rows get
    different places. An empty table gives no rows. Other columns are not read.
    """
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["doc"].dataType.simpleString()
    schema = f"doc {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = stored(texts.mapInArrow(freeing(_cutter(vocabulary, size, end_id)), schema), "pieces")

    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    table = placement(pack_histogram(histogram, size))

    groups = max(1, -(-sum(histogram.values()) // RANKED))
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc", "start"), F.lit(groups)).cast("int"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = pieces.groupBy("length", "part").count()
    counts = counts.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier"))
    order = Window.partitionBy("length", "part").orderBy("doc", "start", "ids_crc32", "doc_tokens")
    ranked = pieces.withColumn("row", F.row_number().over(order)).join(counts, ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("earlier") + F.col("row") - 1)
    # A retried task must see the same ranks: equal rows may swap theirs, so they are written first.
    ranked = stored(ranked.select("doc", "start", "length", "ids_crc32", "doc_tokens", "rank"), "ranks")
    out = ranked.mapInArrow(_placer(table), f"{schema}, sequence_id long, offset long")
    return out.withColumnRenamed("doc", id_col)
