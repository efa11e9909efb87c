"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

Fast similarity sketching (Dahlgaard, Knudsen and Thorup, 2017): in round i every element of a set is
thrown into one of t bins with the value i + h, h in [0, 1). Rounds 0 to t-1 choose the bin by hash;
round t+j puts every element into bin j, so that each coordinate is filled for certain. A set leaves
after the first round in which all its bins are full. Equal coordinates of two sketches estimate the
Jaccard similarity with the concentration of sampling without replacement.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from punctual.llm.graph import components
from punctual.llm.storage import freeing, salted_left_join, stored
from punctual.llm.words import U, Words, distinct_per_text, mix, slices, text_buffers

BANDS, ROWS = 64, 8
_EMPTY = U(0xFFFFFFFFFFFFFFFF)
#: Documents, and shingles, in a block of a bucket, when a bucket's members are compared with each other.
BLOCK, BLOCK_SHINGLES = 2048, 4_000_000
#: Shingles that are counted at once in a block.
COLUMNS = 4096


def similarity_sketches(values: np.ndarray, text: np.ndarray, n_texts: int, t: int) -> np.ndarray:
    """Sketches (n_texts x t) of sets given as (value, set) pairs; a set without elements stays empty."""
    sketch = np.full((n_texts, t), _EMPTY, U)
    flat = sketch.reshape(-1)
    base = text * t
    for i in range(2 * t):
        if not len(values):
            break
        h = mix(values + U((i * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1)))
        bins = ((h >> U(32)) * U(t) >> U(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(flat, base + bins, U(i << 48) | (h & U((1 << 48) - 1)))
        if i < 4 or i % 4 == 3 or i >= t:
            open_sets = (sketch == _EMPTY).any(axis=1)
            if not open_sets.all():
                still = open_sets[text]
                values, text, base = values[still], text[still], base[still]
    return sketch


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each sketch; keys of different bands differ."""
    parts = mix(sketch).reshape(len(sketch), bands, rows)
    odd = mix(np.arange(1, rows + 1, dtype=U)) | U(1)
    return mix((parts * odd).sum(axis=2, dtype=U) + mix(np.arange(1, bands + 1, dtype=U) << U(32)))


def _sketcher(words: int, bands: int, rows: int, id_type: pa.DataType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, (data, bounds) = batch.column("_id"), text_buffers(batch.column("_text"))
            for i, j in slices(bounds, 1 << 21):
                found = Words(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], lower=True)
                values, text = distinct_per_text(*found.shingles(words))
                sizes = np.bincount(text, minlength=j - i)
                keys = band_keys(similarity_sketches(values, text, j - i, bands * rows), bands, rows)
                ends = np.cumsum(sizes)
                raw = values.tobytes()
                digests = [
                    hashlib.blake2b(raw[8 * (e - n) : 8 * e], digest_size=16).digest() if n else None
                    for n, e in zip(sizes.tolist(), ends.tolist())
                ]
                yield pa.record_batch(
                    [
                        ids.slice(i, j - i).cast(id_type),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(digests, pa.binary()),
                        pa.ListArray.from_arrays(
                            np.arange(j - i + 1, dtype=np.int32) * bands, pa.array(keys.reshape(-1).view(np.int64))
                        ),
                    ],
                    names=["_id", "n_shingles", "digest", "keys"],
                )

    return run


def _verifier(words: int, percent: int):
    """Keeps the pairs whose whole shingle sets have at least `percent` hundredths in common."""

    def sets(column) -> tuple[list[np.ndarray], np.ndarray]:
        # Texts of a hot representative come many times: each distinct text of a batch is hashed once.
        coded = column.dictionary_encode()
        data, bounds = text_buffers(coded.dictionary)
        out = []
        for i, j in slices(bounds):
            found = Words(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], lower=True)
            values, text = distinct_per_text(*found.shingles(words))
            out += np.split(values, np.cumsum(np.bincount(text, minlength=j - i))[:-1])
        return out, coded.indices.to_numpy(zero_copy_only=False)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            (left, at), (right, bt) = sets(batch.column("text_a")), sets(batch.column("text_b"))
            keep = []
            for i, j in zip(at.tolist(), bt.tolist()):
                a, b = left[i], right[j]
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int, name: str) -> DataFrame:
    """Pairs (a, b) confirmed on the full sets. The text of b comes first: a may be in very many pairs."""
    b = texts.select(F.col("_id").alias("b"), F.col("_text").alias("text_b"))
    a = texts.select(F.col("_id").alias("a"), F.col("_text").alias("text_a"))
    both = b.join(pairs.hint("merge"), "b").join(a.hint("merge"), "a").select("a", "b", "text_a", "text_b")
    return stored(both.mapInArrow(freeing(_verifier(words, percent)), "a long, b long"), f"{name}-links")


def _block_links(words: int, percent: int):
    """Links between documents of different components in a block, or between two blocks.

    Intersection sizes of all pairs come from products of 0/1 matrices over the shingles that occur
    twice or more; the pairs stay in the task, which returns a spanning forest of the links.
    """

    def run(group: pa.Table) -> pa.Table:
        ids, component, side = (group.column(c).to_numpy() for c in ("b", "component", "side"))
        two = side.min() != side.max()
        data, bounds = text_buffers(group.column("_text"))
        values, text = [], []
        for i, j in slices(bounds):
            found = Words(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], lower=True)
            v, t = distinct_per_text(*found.shingles(words))
            values.append(v)
            text.append(t + i)
        values, text = np.concatenate(values), np.concatenate(text)
        sizes = np.bincount(text, minlength=len(ids))
        _, code, times = np.unique(values, return_inverse=True, return_counts=True)
        shared = times > 1
        code, text = (np.cumsum(shared) - 1)[code[shared[code]]], text[shared[code]]
        order = np.argsort(code, kind="stable")
        code, text = code[order], text[order]
        both = np.zeros((len(ids), len(ids)))  # a product is exact below 2^24, their sum and 100 times it below 2^53
        for low in range(0, int(shared.sum()), COLUMNS):
            at, to = np.searchsorted(code, [low, low + COLUMNS])
            ones = np.zeros((len(ids), COLUMNS), np.float32)
            ones[text[at:to], code[at:to] - low] = 1
            both += ones @ ones.T
        linked = (both > 0) & (100 * both >= percent * (sizes[:, None] + sizes[None, :] - both))
        linked &= component[:, None] < component[None, :]
        if two:
            linked &= side[:, None] != side[None, :]
        parent = {}

        def top(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        forest = []
        for i, j in np.argwhere(linked):
            a, b = top(component[i]), top(component[j])
            if a != b:
                parent[a] = b
                forest.append((ids[i], ids[j]))
        found = np.array(forest, np.int64).reshape(-1, 2)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return run


def _links_in_blocks(rest: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links across the components of each bucket: each two of its blocks meet in one task."""
    block = F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int")
    placed = rest.withColumn("block", block).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    placed = placed.select(
        "key",
        "b",
        "component",
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
        F.col("block").alias("side"),
    )
    placed = placed.join(texts.withColumnRenamed("_id", "b").hint("merge"), "b")
    found = placed.groupBy("key", "low", "high").applyInArrow(_block_links(words, percent), "a long, b long")
    return stored(found, "block-links")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    A document's set holds its distinct runs of `words` words (A-Z lower-cased); a shorter text is one
    run; NULL and wordless texts have an empty set, link with nothing and are their own component.
    Documents are linked if 100 * intersection >= percent * union. component_id is the smallest id
    reachable by links; kept says that it is the document's own. Equal sets are one class, compared
    once through its smallest id, so exact copies never make pairs. Ids are integers; rows with equal
    ids are one document to the links, and each has a row. Rows with a NULL id take no part and have a
    NULL component and kept true. Other columns are not read. An empty table gives an empty table.

    A pair at the threshold shares a band with probability 1 - (1 - 0.8^8)^64 = 0.999992; more similar
    pairs with more. Within a bucket every member is compared with the smallest one; buckets whose
    members are then still in several components are compared in full, block by block inside tasks.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    schema = "_id long, n_shingles long, digest binary, keys array<long>"
    sketches = stored(texts.mapInArrow(freeing(_sketcher(words, bands, rows, pa.int64())), schema), "sketches")
    usable = sketches.where("n_shingles > 0 and _id is not null")

    grouped = usable.groupBy("digest").agg(F.min("_id").alias("rep"), F.count("*").alias("n"))
    copies = stored(grouped.where("n > 1").select("digest", "rep"), "copies")
    named = salted_left_join(usable, copies, ["digest"], "_id").where("rep is null or rep = _id")
    single = named.select("_id", "n_shingles", F.explode("keys").alias("key"))

    buckets = single.groupBy("key").agg(F.min("_id").alias("a"), F.count("*").alias("n")).where("n > 1")
    buckets = buckets.select("key", "a")
    members = stored(single.join(buckets, "key").select("key", F.col("_id").alias("b"), "n_shingles", "a"), "members")

    # Whole texts move once, and then only those that share a bucket. Ids in buckets grow with the corpus,
    # so the join is a merge at any size.
    sharing = members.select(F.col("b").alias("_id")).distinct()
    texts_in = stored(texts.hint("merge").join(sharing, "_id", "left_semi"), "texts")
    links = _verified(members.where("a < b").select("a", "b").distinct(), texts_in, words, percent, "star")
    comp = components(links, "a", "b", "star-components")

    rest = members.where("a <> b").drop("a").join(comp.withColumnRenamed("node", "b"), "b", "left")
    rest = rest.withColumn("component", F.coalesce("component", "b"))
    mixed = rest.groupBy("key").agg(
        F.min("component").alias("low"),
        F.max("component").alias("high"),
        F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"),
    )
    mixed = mixed.where("low < high").select("key", "blocks")
    rest = stored(rest.join(mixed, "key").select("key", "b", "component", "blocks"), "rest")
    if not rest.isEmpty():
        links = links.unionByName(_links_in_blocks(rest, texts_in, words, percent))
        comp = components(links, "a", "b", "near-components")

    class_of = copies.join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    class_of = class_of.select("digest", F.coalesce("component", "rep").alias("of_class"))
    out = salted_left_join(sketches.drop("keys"), class_of, ["digest"], "_id")
    out = out.join(comp.select(F.col("node").alias("_id"), "component"), "_id", "left")
    out = out.withColumn("component_id", F.when(F.col("_id").isNotNull(), F.coalesce("of_class", "component", "_id")))
    kept = F.coalesce(F.col("component_id") == F.col("_id"), F.lit(True))
    return out.select(F.col("_id").alias(id_col), "n_shingles", "component_id", kept.alias("kept"))
