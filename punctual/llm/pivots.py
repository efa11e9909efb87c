"""Near-duplicate vectors by a pivot-permutation index.

Every vector is described by the ordered list of its nearest reference points (pivots). Inverted lists,
one for each label and pivot, hold the vectors that have the pivot among their first PREFIX. Two vectors
are compared if they share at least SHARED pivots; the list of the smallest pivot they share does it, so
that a pair is counted once. A list that is too long is replaced by lists of two pivots, and then of
SHARED, which hold the same pairs: a vector stands in C(PREFIX, SHARED) lists at most, however many rows
there are. Candidates are verified by their cosine in double precision.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from punctual.llm.graph import components
from punctual.llm.storage import salted_left_join, stored
from punctual.llm.vectors import bounded_sample, matrix, usable

PREFIX, SHARED = 8, 3
#: Rows that pivots are chosen from, and pivots at most; there are 2 sqrt(rows) of them.
SAMPLE, MOST_PIVOTS = 8192, 4096
#: Pivots are no nearer to each other than this cosine, so that a dense cluster has one.
APART = 0.9
#: Members of a list that are compared in one task; longer lists are split by the next pivot.
BLOCK = 2048


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """The first rows, by order of the sample, that keep APART from all chosen before."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    chosen = np.zeros((0, unit.shape[1]))
    for low in range(0, len(unit), 256):
        part = unit[low : low + 256]
        part = part[(part @ chosen.T < APART).all(axis=1)] if len(chosen) else part
        near = np.tril(part @ part.T >= APART, -1)
        # A row goes if an earlier one that stays is too near.
        stays = np.ones(len(part), bool)
        for i in range(1, len(part)):
            stays[i] = not (near[i, :i] & stays[:i]).any()
        chosen = np.concatenate([chosen, part[stays]])
        if len(chosen) >= count:
            break
    return chosen[:count]


def _describer(pivots: dict[int, np.ndarray]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vec")
            lengths = np.diff(column.offsets.to_numpy())
            prefix = np.full((batch.num_rows, PREFIX), -1, np.int32)
            digests = np.empty(batch.num_rows, object)
            for d in np.unique(lengths):
                rows = np.flatnonzero(lengths == d)
                found = matrix(column.take(pa.array(rows)))
                for row, own in zip(rows, found + 0.0):
                    digests[row] = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                points = pivots.get(int(d))
                if points is None or not len(points):
                    # A length that the sample has not met: one list for all of its vectors.
                    prefix[rows, 0] = 0
                    continue
                near = found @ points.T
                k = min(PREFIX, near.shape[1])
                top = np.argpartition(-near, k - 1, axis=1)[:, :k]
                order = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
                prefix[np.ix_(rows, range(k))] = np.take_along_axis(top, order, 1)
            yield pa.record_batch(
                [
                    batch.column("id"),
                    batch.column("label"),
                    column,
                    pa.array(digests.tolist(), pa.binary()),
                    pa.ListArray.from_arrays(
                        np.arange(batch.num_rows + 1, dtype=np.int32) * PREFIX, pa.array(prefix.reshape(-1))
                    ),
                ],
                names=["id", "label", "vec", "digest", "prefix"],
            )

    return run


def _block_links(threshold: float):
    """For the vectors of a block, or of two, of one list: links found here, and the smallest id reached by them."""

    def run(group: pa.Table) -> pa.Table:
        ids, copies, side = (group.column(c).to_numpy() for c in ("id", "n", "side"))
        key = group.column("key")[0].as_py()
        lengths = group.column("pivots").combine_chunks().value_lengths().to_numpy()
        flat = np.asarray(group.column("pivots").combine_chunks().flatten())
        known, code = np.unique(flat, return_inverse=True)
        ones = np.zeros((len(ids), len(known)), np.float32)
        ones[np.repeat(np.arange(len(ids)), lengths), code] = 1
        # The key must be the smallest pivots that a pair shares: any other smaller one makes it another list's.
        smaller = ones[:, (known < key[-1]) & ~np.isin(known, key)]
        if (smaller.sum(axis=0) == len(ids)).any():
            return pa.table({"id": ids[:0], "links": np.zeros(0, np.int64), "root": ids[:0]})
        unit = matrix(group.column("vec"))
        unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
        needed = min(SHARED, len(known))
        linked = (ones @ ones.T >= needed) & (smaller @ smaller.T == 0)
        if side.min() != side.max():
            linked &= side[:, None] != side[None, :]
        np.fill_diagonal(linked, False)
        linked &= unit @ unit.T >= threshold
        count = linked @ copies
        some = np.flatnonzero(count)
        linked, root = linked[np.ix_(some, some)], ids[some]
        while len(some):
            least = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (least == root).all():
                break
            root = least
        return pa.table({"id": ids[some], "links": count[some].astype(np.int64), "root": root})

    return run


def _lists(heads: DataFrame) -> DataFrame:
    """Heads in the lists of their pivots: key (pivots of the list) and at (place of its last pivot, from 0).

    The smallest of `needed` shared pivots has as many after it, so the last places open no list.
    """
    last = F.size("pivots") - F.col("needed")
    return heads.withColumn("at", F.explode(F.sequence(F.lit(0), last))).withColumn(
        "key", F.array(F.get("pivots", F.col("at")))
    )


def _split(listed: DataFrame) -> DataFrame:
    """The same members in lists of one pivot more, if the pairs that count share one more."""
    depth = F.size("key")
    more = depth < F.col("needed")
    places = F.when(more, F.sequence(F.col("at") + 1, F.size("pivots") - F.col("needed") + depth))
    moved = listed.withColumn("to", F.explode(F.coalesce(places, F.array("at"))))
    key = F.when(more, F.array_append("key", F.get("pivots", F.col("to")))).otherwise(F.col("key"))
    return moved.withColumn("key", key).withColumn("at", F.col("to")).drop("to")


def _blocked(heads: DataFrame) -> DataFrame:
    """Members of lists, each in the blocks (low, high) of its list that it meets, one if the list is short.

    A list of more than BLOCK members is split by the next pivot until its key has all the pivots that a pair
    must share. What is still longer are vectors alike, which meet block by block. Long lists in which all
    members share a smaller pivot outside the key have no pair of their own and are dropped.
    """
    lists = ["label", "dim", "key"]
    listed, done = stored(_lists(heads), "postings"), []
    for depth in range(1, SHARED + 1):
        other = F.when(F.col("at") >= F.size("key"), F.get(F.array_except("pivots", "key"), F.lit(0)))
        sizes = listed.withColumn("other", other).groupBy(*lists).agg(
            F.count("*").alias("members"),
            (F.coalesce(F.min("other") == F.max("other"), F.lit(False)) & (F.count("other") == F.count("*"))).alias("dead"),
        )
        long = stored(sizes.where(F.col("members") > BLOCK), "long-lists")
        if long.isEmpty():
            done.append(listed.withColumn("blocks", F.lit(1)))
            break
        marked = salted_left_join(listed, long, lists, "id").where(~F.coalesce("dead", F.lit(False))).drop("dead")
        if depth == SHARED:
            blocks = F.coalesce(F.ceil(F.col("members") / BLOCK), F.lit(1)).cast("int")
            done.append(marked.withColumn("blocks", blocks).drop("members"))
        else:
            done.append(marked.where("members is null").drop("members").withColumn("blocks", F.lit(1)))
            listed = stored(_split(marked.where("members is not null").drop("members")), "postings")
    placed = reduce(DataFrame.unionByName, done)
    placed = placed.withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return placed.withColumns({"low": F.least("side", "other"), "high": F.greatest("side", "other")})


def near_vectors(
    table: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.98,
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors of equal label and length are linked if their cosine is at least threshold. NULL labels,
    and vectors that are NULL, empty, zero or hold a NULL or non-finite component, link with nothing.
    n_links counts the other rows linked directly; component_id is the smallest id reachable. Vectors
    that are equal number by number are one class, compared once through its smallest id. Rows with a
    NULL id take no part, have a NULL component and kept true. Rows of equal id are one node of the
    graph, and each counts as a row. Other columns are not read; an empty table gives no rows.

    The pivots are the only bounded part: they are chosen from about SAMPLE rows. Every row is indexed.
    Lists longer than BLOCK are split by further shared pivots; only vectors that share SHARED pivots with more
    than BLOCK others meet them block by block. Each task returns sums, never pairs.
    """
    kind = dict(table.dtypes)[vector_col]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = table.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast(kind).alias("vec"),
    )
    valid = rows.where(usable("vec") & F.col("label").isNotNull() & F.col("id").isNotNull())
    total = valid.count()
    count = int(min(MOST_PIVOTS, max(32, 2 * total**0.5)))
    pivots = {d: choose_pivots(m, count) for d, m in bounded_sample(valid, "vec", "id", total, SAMPLE).items()}
    schema = f"id long, label string, vec {kind}, digest binary, prefix array<int>"
    described = stored(valid.mapInArrow(_describer(pivots), schema), "described")

    classes = described.groupBy("label", "digest").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    classes = stored(classes.where("n > 1"), "vector-classes")
    named = salted_left_join(described, classes, ["label", "digest"], "id")
    # One row stands for a class, also where rows repeat.
    alone = named.where("rep is null").withColumn("n", F.lit(1).cast("long"))
    many = named.where("rep = id").dropDuplicates(["label", "digest"])
    heads = alone.unionByName(many).select(
        "id", "label", "vec", "n", F.size("vec").alias("dim"), F.array_sort(F.filter("prefix", lambda p: p >= 0)).alias("pivots")
    )
    placed = _blocked(heads.withColumn("needed", F.least(F.size("pivots"), F.lit(SHARED))))
    found = placed.groupBy("label", "dim", "key", "low", "high").applyInArrow(_block_links(threshold), "id long, links long, root long")
    found = stored(found, "vector-links")

    comp = components(found, "id", "root", "vector-components")
    counted = found.groupBy("id").agg(F.sum("links").alias("links"))
    heads_of = counted.join(comp.withColumnRenamed("node", "id"), "id", "left")
    of_class = classes.join(heads_of.withColumnRenamed("id", "rep"), "rep", "left").select(
        "label",
        "digest",
        (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("class_links"),
        F.coalesce("component", "rep").alias("class_component"),
    )
    known = described.select("id", "label", "digest")
    out = salted_left_join(known, of_class, ["label", "digest"], "id")
    out = out.join(heads_of, "id", "left").select(
        "id",
        F.coalesce("class_links", "links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("class_component", "component", "id").alias("component_id"),
    )
    rest = rows.where(~(usable("vec") & F.col("label").isNotNull() & F.col("id").isNotNull()))
    rest = rest.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = out.unionByName(rest)
    kept = F.coalesce(F.col("component_id") == F.col("id"), F.lit(True))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", kept.alias("kept"))
