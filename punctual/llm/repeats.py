"""Removal of byte strings of a given length that stand anywhere else too, by sorting suffixes.

No task can hold the suffixes of a corpus, so they are dealt out first. A string of LENGTH bytes goes
where its anchor says: the ANCHOR bytes in it of smallest hash, the first of equals. Equal strings have
equal anchors at the same place in them, so only starts of one anchor, as far before it, can be equal.
Neighbouring starts mostly share an anchor and travel as one fragment: the bytes from the first start to
the end of the last string. Anchors that occur once go no further, equal fragments travel once.

The suffixes of a bucket of fragments are sorted deep-shallow: multikey quicksort by eight bytes at a
time to a shallow depth; what then still agrees is put in order by blind tries, whose nodes know only the
depth at which their suffixes part and the byte there, so that each suffix is compared in full with one
other only. Starts that agree to LENGTH bytes are repeats.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from punctual.llm.storage import freeing, new_folder, salted_left_join, stored
from punctual.llm.words import _BYTE_VALUE, U, mix, span_hashes, text_buffers

LENGTH, ANCHOR = 200, 64
SHALLOW = 32
#: Starts that are looked at together; longer texts are cut into overlapping pieces.
PIECE = 1 << 20
#: Distinct fragments that are sorted together, on average, and most of one anchor. Fragments of an anchor
#: with more are split by the bytes that all of a few neighbouring starts share, in the end all LENGTH.
BUCKET, MOST = 2048, 8192
SPLITS = (16, 1)
#: Rows of one key up to which a join needs no salt.
PLAIN = 1000
_SECOND, _THIRD = 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
_LOW = U(0xFFFFFFFF)


def _least_over(x: np.ndarray, size: int) -> np.ndarray:
    """The least of every run of `size` values."""
    have = 1
    while have < size:
        step = min(have, size - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def pieces(bounds: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(texts, from, to) of byte ranges that together hold every string of `length` bytes once, PIECE starts at a time."""
    texts, lows, highs, size = [], [], [], 0
    for i in np.flatnonzero(np.diff(bounds) >= length).tolist():
        for low in range(int(bounds[i]), int(bounds[i + 1]) - length + 1, PIECE):
            high = min(int(bounds[i + 1]), low + PIECE + length - 1)
            texts.append(i)
            lows.append(low)
            highs.append(high)
            size += high - low
            if size >= PIECE:
                yield np.array(texts), np.array(lows), np.array(highs)
                texts, lows, highs, size = [], [], [], 0
    if texts:
        yield np.array(texts), np.array(lows), np.array(highs)


class Fragments:
    """Fragments of some byte ranges: first start, number of starts, anchor, range, hash of the anchor's bytes."""

    def __init__(self, data: np.ndarray, lows: np.ndarray, highs: np.ndarray, length: int, anchor: int):
        sizes = highs - lows
        self.data = data = np.concatenate([data[a:b] for a, b in zip(lows.tolist(), highs.tolist())])
        self.begin = np.cumsum(sizes) - sizes
        self.values = _BYTE_VALUE[data]
        at = np.arange(len(data) - anchor + 1)
        hashes = span_hashes(self.values, at, at + anchor)
        # The place in the lower half makes the first of equal hashes the least.
        least = _least_over((hashes & ~_LOW) | at.astype(U), length - anchor + 1)
        counts = sizes - length + 1
        starts = np.arange(int(counts.sum())) + np.repeat(self.begin - (np.cumsum(counts) - counts), counts)
        owner = np.repeat(np.arange(len(sizes)), counts)
        anchors = (least[starts] & _LOW).astype(np.int64)
        new = np.flatnonzero(np.diff(anchors, prepend=-1) | np.diff(owner, prepend=-1))
        self.first, self.anchor, self.owner = starts[new], anchors[new], owner[new]
        self.count = np.diff(np.append(new, len(starts)))
        self.key = hashes[self.anchor].view(np.int64)


def _digests(values: np.ndarray, first: np.ndarray, end: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of byte ranges and of the anchors' places in them."""
    one = span_hashes(values, first, end, _SECOND | 1) + before.astype(U) * U(0x9E3779B97F4A7C15)
    return mix(one).view(np.int64), span_hashes(values, first, end, _THIRD | 1).view(np.int64)


def _key_finder(length: int, anchor: int):
    """The anchors of every text, and whether each occurs in it more than once (n = 2)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_buffers(batch.column("text"))
            for texts, lows, highs in pieces(bounds, length):
                found = Fragments(data, lows, highs, length, anchor)
                order = np.lexsort((found.key, found.owner))
                key, owner = found.key[order], found.owner[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
                at = np.flatnonzero(new)
                times = np.minimum(np.diff(np.append(at, len(key))), 2)
                rows = pa.array(texts[owner[at]])
                columns = [batch.column(c).take(rows) for c in ("k1", "k2")]
                yield pa.record_batch([*columns, pa.array(key[at]), pa.array(times)], names=["k1", "k2", "key", "n"])

    return run


_FRAGMENT = "k1 long, k2 long, at long, n long, times long, anchor long, key long, d1 long, d2 long, bytes binary"


def _rows_of(batch, texts, base, found, first, count, times, anchor, key, data, values, length) -> pa.RecordBatch:
    end = first + count - 1 + length
    d1, d2 = _digests(values, first, end, anchor - first)
    sizes = end - first
    flat = data[np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    content = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
    rows = pa.array(texts)
    numbers = [pa.array(x) for x in (first - base, count, times, anchor - base, key, d1, d2)]
    columns = [*(batch.column(c).take(rows) for c in ("k1", "k2")), *numbers, content]
    return pa.record_batch(columns, names=["k1", "k2", "at", "n", "times", "anchor", "key", "d1", "d2", "bytes"])


def _fragment_finder(length: int, anchor: int):
    """Fragments of the anchors listed for each text. Equal neighbours, as in a run of one letter, are one row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_buffers(batch.column("text"))
            lists = batch.column("keys")
            for texts, lows, highs in pieces(bounds, length):
                listed = [lists[i].values.to_numpy() if lists[i].is_valid else np.zeros(0, np.int64) for i in texts.tolist()]
                if not sum(map(len, listed)):
                    continue
                found = Fragments(data, lows, highs, length, anchor)
                ends = np.searchsorted(found.owner, np.arange(len(texts) + 1))
                wanted = np.concatenate(
                    [np.isin(found.key[a:b], keys) for a, b, keys in zip(ends[:-1].tolist(), ends[1:].tolist(), listed)]
                )
                first, count, owner, place, key = (
                    x[wanted] for x in (found.first, found.count, found.owner, found.anchor, found.key)
                )
                if not len(first):
                    continue
                d1, d2 = _digests(found.values, first, first + count - 1 + length, place - first)
                again = np.zeros(len(first), bool)
                again[1:] = (d1[1:] == d1[:-1]) & (d2[1:] == d2[:-1]) & (key[1:] == key[:-1]) & (owner[1:] == owner[:-1])
                again[1:] &= first[1:] == first[:-1] + count[:-1]
                new = np.flatnonzero(~again)
                times = np.diff(np.append(new, len(first)))
                base = (found.begin - (lows - bounds[texts]))[owner[new]]
                yield _rows_of(
                    batch, texts[owner[new]], base, found, first[new], count[new], times, place[new], key[new],
                    found.data, found.values, length,
                )

    return run


def _splitter(length: int, starts: int):
    """The listed fragments cut where the distance to the anchor is a multiple of `starts`.

    The key of a part is a hash of the bytes that all strings at such distances share.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_buffers(batch.column("text"))
            lists = batch.column("parts")
            for i in range(batch.num_rows):
                low, high = int(bounds[i]), int(bounds[i + 1])
                own = data[low:high]
                values = _BYTE_VALUE[own]
                first, count, place = (lists[i].values.field(c).to_numpy() for c in ("at", "n", "anchor"))
                every = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                place = np.repeat(place, count)
                group = np.repeat(np.arange(len(count)), count)
                part = (place - every) // starts
                new = np.flatnonzero(np.diff(group, prepend=-1) | np.diff(part, prepend=-1))
                sizes = np.diff(np.append(new, len(every)))
                first, place, part = every[new], place[new], part[new]
                last = place - part * starts
                key = span_hashes(values, last, last - starts + 1 + length) + part.astype(U) * U(0xA24BAED4963EE407)
                key = mix(key + U(starts)).view(np.int64)
                texts, base = np.full(len(new), i), np.zeros(len(new), np.int64)
                yield _rows_of(batch, texts, base, None, first, sizes, np.ones_like(sizes), place, key, own, values, length)

    return run


def _segments(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and size of the stretches of equal values."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return first, np.diff(np.append(first, len(key)))


def _equal_depth(words: np.ndarray, a: np.ndarray, b: np.ndarray, depth: np.ndarray, length: int) -> np.ndarray:
    """Bytes, at most `length`, that suffixes a and b share; they share `depth` at least."""
    out = np.full(len(a), length, np.int64)
    left, depth = np.arange(len(a)), depth.copy()
    while len(left):
        differ = words[a[left] + depth[left]] ^ words[b[left] + depth[left]]
        parted = differ != 0
        lead = sum((differ[parted] < U(1 << (56 - 8 * k))).astype(np.int64) for k in range(7))
        out[left[parted]] = np.minimum(depth[left[parted]] + lead, length)
        depth[left] += 8
        left = left[~parted]
        left = left[depth[left] < length]
    return out


def sort_suffixes(data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW):
    """(order, equal): the starts by group and their next `length` bytes, and whether each equals another one.

    Every start has `length` bytes before the end of data. First all groups at once are partitioned by
    multikey quicksort: around the median of three of the eight bytes at a segment's depth into less,
    equal, which goes on eight bytes deeper, and greater. Segments that agree to `shallow` bytes become
    blind tries, built from the root: all suffixes of a node are known by the depth to which they agree with
    its first one, the least of these is where they part, and the byte there deals them to its children.
    """
    shallow = min(shallow, length // 8 * 8)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view(">u8").reshape(-1).astype(U)
    order = np.argsort(group, kind="stable")
    equal = np.zeros(len(starts), bool)
    deep: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    slot, own, segment, depth, named = np.arange(len(order)), order.copy(), group[order], np.zeros(len(order), np.int64), 0
    while len(own):
        first, size = _segments(segment)
        at_depth = depth[first]
        lone, ready = size == 1, (at_depth >= shallow) & (size > 1)
        if ready.any():
            mine = np.repeat(ready, size)
            deep.append((slot[mine], own[mine], named + np.repeat(np.arange(int(ready.sum())), size[ready])))
            named += int(ready.sum())
        keep = ~(lone | ready)
        mine = np.repeat(keep, size)
        slot, own, depth, size = slot[mine], own[mine], depth[mine], size[keep]
        if not len(own):
            break
        symbol = words[starts[own] + depth]
        first = np.cumsum(size) - size
        a, b, c = symbol[first], symbol[first + size // 2], symbol[first + size - 1]
        pivot = np.repeat(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), size)
        side = (symbol > pivot).astype(np.int64) + (symbol >= pivot)
        part = np.repeat(np.arange(len(size)), size) * 3 + side
        dealt = np.argsort(part, kind="stable")
        own, segment = own[dealt], part[dealt]
        depth = (depth + 8 * (side == 1))[dealt]
        order[slot] = own
    if not deep:
        return order, equal

    slot, own, segment = (np.concatenate(x) for x in zip(*deep))
    first, size = _segments(segment)
    head = np.repeat(own[first], size)
    agrees = _equal_depth(words, starts[own], starts[head], np.full(len(own), shallow, np.int64), length)
    while len(own):
        agrees[first] = length
        branch = np.minimum.reduceat(agrees, first)
        whole = branch >= length
        same = np.repeat(whole & (size > 1), size)
        equal[own[same]] = True
        mine = np.repeat(~whole, size)
        slot, own, agrees = slot[mine], own[mine], agrees[mine]
        if not len(own):
            break
        size, branch = size[~whole], branch[~whole]
        node = np.repeat(np.arange(len(size)), size)
        at = np.repeat(branch, size)
        key = node * 256 + data[starts[own] + at]
        dealt = np.argsort(key, kind="stable")
        heads = np.repeat(own[np.cumsum(size) - size], size)
        own, agrees, at, key, heads = own[dealt], agrees[dealt], at[dealt], key[dealt], heads[dealt]
        order[slot] = own
        first, size = _segments(key)
        keep = np.repeat(size > 1, size)
        slot, own, agrees, at, heads, key = slot[keep], own[keep], agrees[keep], at[keep], heads[keep], key[keep]
        if not len(own):
            break
        first, size = _segments(key)
        head = np.repeat(own[first], size)
        # Children without their parent's first suffix have a new one to agree with.
        fresh = head != heads
        agrees[fresh] = _equal_depth(words, starts[own[fresh]], starts[head[fresh]], at[fresh], length)
    return order, equal


def _sorter(length: int):
    """Ranges of starts, counted from a fragment's first, of the strings that stand anywhere else too."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        content = table.column("bytes").chunk(0)
        bounds = np.frombuffer(content.buffers()[1], np.int32)[content.offset : content.offset + len(content) + 1].astype(np.int64)
        data = np.frombuffer(content.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        count, before, weight = (table.column(c).to_numpy() for c in ("n", "before", "weight"))
        inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        starts = np.repeat(bounds[:-1] - bounds[0], count) + inside
        fragment = np.repeat(np.arange(len(count)), count)
        key = np.unique(table.column("key").to_numpy(), return_inverse=True)[1]
        distance = np.repeat(before, count) - inside
        _, equal = sort_suffixes(data, starts, key[fragment] * length + distance, length)
        equal |= weight[fragment] > 1
        new = np.ones(len(equal), bool)
        new[1:] = (equal[1:] != equal[:-1]) | (fragment[1:] != fragment[:-1])
        at = np.flatnonzero(new)
        end = np.append(at[1:], len(equal))
        low, high = inside[at], inside[at] + (end - at)
        low, high, rows = low[equal[at]], high[equal[at]], pa.array(fragment[at][equal[at]])
        columns = [table.column(c).take(rows) for c in ("key", "d1", "d2", "weight")]
        return pa.table([*columns, pa.array(low), pa.array(high)], names=["key", "d1", "d2", "weight", "low", "high"])

    return run


def _remover(length: int):
    """What is left of every text, and the removed runs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_buffers(batch.column("text"))
            copies, marks = batch.column("copies").to_numpy(), batch.column("marks")
            kept, sums, removed, runs, sizes = [], [], [], [], []
            for i in range(batch.num_rows):
                own = data[bounds[i] : bounds[i + 1]]
                gone = np.zeros(len(own), bool)
                if copies[i] > 1:
                    gone[:] = len(own) >= length
                elif marks[i].is_valid:
                    edge = np.zeros(len(own) + 1, np.int64)
                    spans = marks[i].values
                    np.add.at(edge, spans.field("low").to_numpy(), 1)
                    np.add.at(edge, spans.field("high").to_numpy() + length - 1, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                rest = own[~gone].tobytes()
                kept.append(rest)
                sums.append(hashlib.sha256(rest).hexdigest())
                removed.append(int(gone.sum()))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                runs.append(edge)
                sizes.append(len(edge) // 2)
            ends = np.concatenate([*runs, np.zeros(0, np.int64)])
            spans = pa.StructArray.from_arrays([pa.array(ends[::2]), pa.array(ends[1::2])], ["start", "end"])
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            columns = [batch.column("k1"), batch.column("k2"), batch.column("copies")]
            columns += [pa.array(np.diff(bounds)), pa.array(removed, pa.int64()), pa.ListArray.from_arrays(offsets, spans)]
            columns += [pa.array(sums, pa.string()), pa.array(kept, pa.binary())]
            names = ["k1", "k2", "copies", "n_bytes", "n_removed", "removed", "kept_sha256", "kept"]
            yield pa.record_batch(columns, names=names)

    return run


def _co_located(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """Texts as a table bucketed by their digests, so that the joins of small tables with it don't move texts."""
    name = f"texts_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = texts.write.format("parquet").option("compression", "zstd").option("path", new_folder(spark, "texts"))
    writer.bucketBy(parts, "k1", "k2").sortBy("k1", "k2").saveAsTable(name)
    return spark.table(name)


def _spread_join(large: DataFrame, small: DataFrame, keys: list[str], weight: str, spread_by: str) -> DataFrame:
    """Inner join with a table that knows in `weight` how many rows meet each of its keys."""
    few = large.join(small.where(F.col(weight) <= PLAIN), keys)
    hot = salted_left_join(large, small.where(F.col(weight) > PLAIN), keys, spread_by)
    return few.unionByName(hot.where(F.col(weight).isNotNull()))


def _sorted_ranges(fragments: DataFrame, length: int, most: int | None) -> tuple[DataFrame, DataFrame]:
    """(marks of the fragments whose keys are not too frequent, fragments of the other keys)."""
    distinct = fragments.groupBy("key", "d1", "d2").agg(
        F.first("bytes").alias("bytes"),
        F.first("n").alias("n"),
        F.first(F.col("anchor") - F.col("at")).alias("before"),
        F.sum(F.when(F.col("times") > 1, 2).otherwise(1)).alias("weight"),
    )
    distinct = stored(distinct, "distinct-fragments")
    frequent = stored(distinct.groupBy("key").count().where(F.col("count") > most).select("key"), "frequent-anchors") if most else None
    sortable = distinct.join(frequent, "key", "left_anti") if most else distinct
    buckets = max(1, -(-distinct.count() // BUCKET))
    ranges = sortable.withColumn("bucket", F.pmod("key", F.lit(buckets))).groupBy("bucket").applyInArrow(
        _sorter(length), "key long, d1 long, d2 long, weight long, low long, high long"
    )
    ranges = ranges.groupBy("key", "d1", "d2").agg(
        F.max("weight").alias("weight"), F.collect_list(F.struct("low", "high")).alias("ranges")
    )
    ranges = stored(ranges, "repeated-starts")
    places = fragments.select("k1", "k2", "at", "key", "d1", "d2")
    marks = _spread_join(places, ranges, ["key", "d1", "d2"], "weight", "k1")
    marks = marks.select("k1", "k2", "at", F.inline("ranges")).select(
        "k1", "k2", (F.col("at") + F.col("low")).alias("low"), (F.col("at") + F.col("high")).alias("high")
    )
    return marks, frequent


def repeated_starts(texts: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, most: int = MOST) -> DataFrame:
    """(k1, k2, low, high): ranges of starts of strings of `length` bytes that occur more than once in the texts.

    `texts` is a written table of (k1, k2, text) without equal texts.
    """
    keys = texts.select("k1", "k2", "text").mapInArrow(freeing(_key_finder(length, anchor)), "k1 long, k2 long, key long, n long")
    repeated = keys.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key", F.lit(True).alias("again"))
    listed = salted_left_join(keys.select("k1", "k2", "key"), stored(repeated, "repeated-anchors"), ["key"], "k1")
    listed = listed.where("again").groupBy("k1", "k2").agg(F.collect_set("key").alias("keys"))
    with_keys = texts.join(listed, ["k1", "k2"]).select("k1", "k2", "text", "keys")
    fragments = stored(with_keys.mapInArrow(freeing(_fragment_finder(length, anchor)), _FRAGMENT), "fragments")
    # Equal neighbours repeat each other.
    found = fragments.where("times > 1").select(
        "k1", "k2", F.col("at").alias("low"), (F.col("at") + F.col("n") * F.col("times")).alias("high")
    )
    for starts in (None, *SPLITS):
        if starts:
            parts = fragments.join(frequent, "key", "left_semi").groupBy("k1", "k2")
            parts = parts.agg(F.collect_list(F.struct("at", "n", "anchor")).alias("parts"))
            cut = texts.join(parts, ["k1", "k2"]).select("k1", "k2", "text", "parts")
            fragments = stored(cut.mapInArrow(_splitter(length, starts), _FRAGMENT), "fragments")
        # Strings cut from all sides are whole: those of one key are equal, and one at most remains to sort.
        marks, frequent = _sorted_ranges(fragments, length, None if starts == 1 else most)
        found = found.unionByName(marks)
        if frequent is None or frequent.isEmpty():
            return found
    return found


def strip_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    anchor: int = ANCHOR,
    most: int = MOST,
) -> DataFrame:
    """(id, n_bytes, n_removed, removed, kept_sha256, kept): every text without the bytes that stand elsewhere too.

    Texts are UTF-8 bytes. A byte goes if it is covered by a string of `length` bytes that also starts
    anywhere else, in the same text or another one; no string crosses from one text to the next. All copies
    go, the first too, and strings are judged on the input, not on what is left. `removed` has the [start,
    end) byte offsets of the removed runs in the input; `kept`, the rest, may cut a character. Each row is a
    document of its own: repeated rows and rows of one or no id remove each other's bytes. NULL and empty
    texts, and those of less than `length` bytes, lose nothing. An empty table gives no rows. Very long texts
    are looked at in pieces of a million starts; only removing holds one text as a whole. Other columns are
    not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.alias("text")
    )
    texts = rows.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    texts = _co_located(spark, texts)
    marks = repeated_starts(texts, length, anchor, most)
    marks = marks.groupBy("k1", "k2").agg(F.collect_list(F.struct("low", "high")).alias("marks"))
    schema = (
        "k1 long, k2 long, copies long, n_bytes long, n_removed long, removed array<struct<start:long, end:long>>,"
        " kept_sha256 string, kept binary"
    )
    marked = texts.join(marks, ["k1", "k2"], "left").select("k1", "k2", "text", "copies", "marks")
    left = marked.mapInArrow(freeing(_remover(length)), schema)
    own = rows.select("doc", "k1", "k2", F.monotonically_increasing_id().alias("_row"))
    out = _spread_join(own, left, ["k1", "k2"], "copies", "_row")
    return out.select(F.col("doc").alias(id_col), "n_bytes", "n_removed", "removed", "kept_sha256", "kept")
