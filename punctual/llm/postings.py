"""Approximate nearest neighbours by largest inner product, over balanced posting lists.

Inner products become distances by one more component, sqrt(M^2 - |x|^2), M the largest norm: the nearest
rows are those of largest product with the query (0 in that component). Vectors go to the lists of the
nearest centroids; vectors near a boundary go to several. Queries find centroids through a graph held in
memory, keep the lists whose centroid is not much farther than the nearest one, and scan them. How much
farther is set in every run: a bounded sample of the queries is answered over all rows, and the reach
widened until the lists in it hold the share TARGET of these answers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from punctual.llm.storage import salted_left_join, stored
from punctual.llm.vectors import bounded_sample, matrix, usable

#: Rows that centroids are fitted on, and centroids at most; there is one for every PER_LIST rows.
SAMPLE, MOST_LISTS, PER_LIST = 16384, 4096, 512
#: A vector goes to at most COPIES lists, those at most BOUNDARY times as far as its nearest.
COPIES, BOUNDARY = 4, 1.05
#: A query scans at least LEAST lists, and all at most REACH times as far as its nearest; a run may widen both.
LEAST, REACH = 8, 1.16
#: Queries that are answered over all rows, and the share of their answers that must lie in the lists scanned.
TRIALS, TARGET = 64, 0.97
#: Members, and queries, of a list that meet in one task.
BLOCK, QUERY_BLOCK = 8192, 1024
_DEGREE, _BEAM = 16, 64


def fit_centroids(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """k-means in which lists far over the mean give a centroid to the smallest, so that lists are even."""
    count = min(count, len(sample))
    centroids = sample[np.random.default_rng(11).choice(len(sample), count, replace=False)].copy()
    for turn in range(rounds):
        owner = nearest_lists(sample, centroids, 1)[0][:, 0]
        sizes = np.bincount(owner, minlength=count)
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, sample)
        full = sizes > 0
        centroids[full] = sums[full] / sizes[full, None]
        if turn < rounds - 2:
            large, small = np.argsort(-sizes, kind="stable"), np.argsort(sizes, kind="stable")
            for a, b in zip(large, small):
                if sizes[a] < 2 * len(sample) / count or sizes[b] * 4 > sizes[a]:
                    break
                members = sample[owner == a]
                centroids[b] = members[np.argmax(np.square(members - centroids[a]).sum(axis=1))]
    return centroids


def nearest_lists(rows: np.ndarray, centroids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and distances of the k nearest centroids of every row, nearest first."""
    k = min(k, len(centroids))
    numbers, distances = np.empty((len(rows), k), np.int64), np.empty((len(rows), k))
    norms = np.square(centroids).sum(axis=1)
    for low in range(0, len(rows), 1024):
        part = rows[low : low + 1024]
        d = np.maximum(np.square(part).sum(axis=1)[:, None] - 2 * part @ centroids.T + norms, 0)
        top = np.argpartition(d, k - 1, axis=1)[:, :k]
        own = np.take_along_axis(d, top, 1)
        order = np.argsort(own, axis=1, kind="stable")
        numbers[low : low + 1024] = np.take_along_axis(top, order, 1)
        distances[low : low + 1024] = np.sqrt(np.take_along_axis(own, order, 1))
    return numbers, distances


class CentroidGraph:
    """Centroids joined to their nearest ones; a search walks towards the query and widens its beam as needed."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        near = nearest_lists(centroids, centroids, _DEGREE + 1)[0]
        links = [set(row.tolist()) - {i} for i, row in enumerate(near)]
        for i, row in enumerate(near):
            for j in row.tolist():
                if j != i:
                    links[j].add(i)
        # A ring keeps the graph in one piece, however far apart its clusters are.
        for i in range(len(centroids)):
            links[i] |= {(i + 1) % len(centroids)} - {i}
        self.links = [np.fromiter(sorted(s), np.int64, len(s)) for s in links]
        entry = np.linspace(0, len(centroids) - 1, min(8, len(centroids))).astype(int)
        self.entries = np.unique(entry)

    def search(self, query: np.ndarray, least: int, reach: float) -> list[int]:
        """Lists at most reach times as far as the nearest found, and `least` at least."""
        seen = np.zeros(len(self.centroids), bool)
        found: list[tuple[float, int]] = []
        open_: list[tuple[float, int]] = []

        def look(numbers: np.ndarray) -> None:
            numbers = numbers[~seen[numbers]]
            seen[numbers] = True
            for d, i in zip(np.sqrt(np.square(self.centroids[numbers] - query).sum(axis=1)).tolist(), numbers.tolist()):
                heapq.heappush(open_, (d, i))
                found.append((d, i))

        look(self.entries)
        beam = max(_BEAM, least)
        best: list[float] = []  # the nearest `beam` distances expanded, as a max-heap
        nearest = np.inf
        while open_:
            d, i = heapq.heappop(open_)
            nearest = min(nearest, d)
            if len(best) >= beam and d > -best[0] and d > reach * nearest:
                break
            heapq.heappush(best, -d)
            if len(best) > beam:
                heapq.heappop(best)
            look(self.links[i])
        found.sort()
        limit = reach * found[0][0]
        return [i for n, (d, i) in enumerate(found) if n < least or d <= limit]


def recall_of(graph: CentroidGraph, queries: np.ndarray, wanted: list[list[set[int]]], least: int, reach: float) -> float:
    """Share of the answers of which a list is found; wanted[i] has the lists of each answer of query i."""
    found = 0
    for query, answers in zip(queries, wanted):
        lists = set(graph.search(query, least, reach))
        found += sum(not lists.isdisjoint(own) for own in answers)
    return found / max(1, sum(map(len, wanted)))


def fitted_reach(graph: CentroidGraph, queries: np.ndarray, wanted: list[list[set[int]]]) -> tuple[int, float]:
    """(least, reach) at which TARGET of the answers are found; all lists if nothing less does it."""
    count, needs = len(graph.centroids), []
    for query, answers in zip(queries, wanted):
        distance = np.sqrt(np.square(graph.centroids - query).sum(axis=1))
        needs += [min(distance[list(own)]) / max(distance.min(), 1e-12) for own in answers]
    least, reach = LEAST, REACH
    if not needs:
        return least, reach
    needed = float(np.sort(needs)[min(len(needs) - 1, int(TARGET * len(needs)))])
    # A query that is a centroid itself has no ratio: `least` serves it.
    if needed < 1e6:
        reach = max(reach, needed * (1 + 1e-9))
    while least < count and recall_of(graph, queries, wanted, least, reach) < TARGET:
        least, reach = least + max(1, least // 2), 1 + (reach - 1) * 1.1
    return least, reach


def _lifted(x: np.ndarray, largest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(largest * largest - np.square(x).sum(axis=1), 0))
    return np.concatenate([x, rest[:, None]], axis=1)


def _lister(centroids: np.ndarray, largest: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, distance = nearest_lists(_lifted(matrix(batch.column("vec")), largest), centroids, COPIES)
            takes = distance <= BOUNDARY * distance[:, :1]
            row, column = np.nonzero(takes)
            at = pa.array(row)
            yield pa.record_batch(
                [batch.column("id").take(at), batch.column("vec").take(at), pa.array(lists[row, column].astype(np.int32))],
                names=["id", "vec", "list"],
            )

    return run


def _answerer(q_ids: np.ndarray, queries: np.ndarray, depth: int):
    """Of a task's members, the `depth` best of every query, each with its list."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, int, int]]] = [[] for _ in q_ids]
        for batch in batches:
            m, ids, lists = matrix(batch.column("vec")), batch.column("id").to_numpy(), batch.column("list").to_numpy()
            if not len(m):
                continue
            rough = queries @ m.T
            rough[q_ids[:, None] == ids[None, :]] = -np.inf
            for i, q in enumerate(queries):
                at = max(0, len(m) - depth)
                edge = np.partition(rough[i], at)[at]
                near = np.flatnonzero((rough[i] >= edge) & (rough[i] > -np.inf))
                loss = -(m[near] * q).sum(axis=1)
                # Of equal vectors, which may be a whole batch, those of the smallest ids.
                near = near[own := np.lexsort((lists[near], ids[near], loss))[:depth]]
                hits = zip(loss[own].tolist(), ids[near].tolist(), lists[near].tolist())
                best[i] = sorted({*best[i], *hits})[:depth]
        kept = [i for i, own in enumerate(best) if len(own)]
        flat = [hit for i in kept for hit in best[i]]
        kinds = (("loss", pa.float64()), ("vec_id", pa.int64()), ("list", pa.int32()))
        hits = pa.StructArray.from_arrays([pa.array([h[c] for h in flat], t) for c, (_, t) in enumerate(kinds)], [n for n, _ in kinds])
        offsets = np.concatenate([[0], np.cumsum([len(best[i]) for i in kept])]).astype(np.int32)
        yield pa.record_batch([pa.array(kept, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), hits)], names=["query", "found"])

    return run


def measured_reach(members: DataFrame, ask: DataFrame, centroids: np.ndarray, k: int) -> tuple[int, float]:
    """(least, reach) for these rows, from the k best rows of TRIALS queries among all members."""
    if len(centroids) <= LEAST:
        return LEAST, REACH
    order = (F.xxhash64(F.lit(TRIALS), F.col("id")), F.col("id"))
    trial = ask.dropDuplicates(["id"]).orderBy(*order).limit(TRIALS).toArrow()
    if not trial.num_rows:
        return LEAST, REACH
    queries, q_ids = matrix(trial.column("vec")), trial.column("id").to_numpy()
    # A row is in COPIES lists at most.
    depth = k * COPIES
    each = members.mapInArrow(
        _answerer(q_ids, queries, depth), "query int, found array<struct<loss:double,vec_id:long,list:int>>"
    )
    merged = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))), 1, depth)
    wanted: list[list[set[int]]] = [[] for _ in q_ids]
    for query, found in each.groupBy("query").agg(merged).collect():
        answers: dict[int, set[int]] = {}
        for hit in found:
            if hit.vec_id in answers or len(answers) < k:
                answers.setdefault(hit.vec_id, set()).add(hit.list)
        wanted[query] = list(answers.values())
    lifted = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1)
    return fitted_reach(CentroidGraph(centroids), lifted, wanted)


def _prober(centroids: np.ndarray, least: int, reach: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = CentroidGraph(centroids)
        for batch in batches:
            vectors = matrix(batch.column("vec"))
            lifted = np.concatenate([vectors, np.zeros((len(vectors), 1))], axis=1)
            rows, lists = [], []
            for i, query in enumerate(lifted):
                chosen = graph.search(query, least, reach)
                rows += [i] * len(chosen)
                lists += chosen
            at = pa.array(rows, pa.int64())
            yield pa.record_batch(
                [batch.column("id").take(at), batch.column("vec").take(at), pa.array(lists, pa.int32())],
                names=["id", "vec", "list"],
            )

    return run


def _scanner(k: int):
    """The k best of a block of members for every query of a block, as parallel lists."""

    def run(queries: pa.Table, members: pa.Table) -> pa.Table:
        q, m = matrix(queries.column("vec")), matrix(members.column("vec"))
        q_ids, ids = queries.column("id").to_numpy(), members.column("id").to_numpy()
        if len(m):
            # Repeated rows of an id are in one block and count once.
            order = np.lexsort((*m.T, ids))
            again = (ids[order][1:] == ids[order][:-1]) & (m[order][1:] == m[order][:-1]).all(axis=1)
            own = np.sort(order[np.concatenate([[True], ~again])])
            m, ids = m[own], ids[own]
        found_ids, found_scores, bounds, kept = [], [], [0], []
        if len(q) and len(m):
            for low in range(0, len(q), 256):
                part = q[low : low + 256]
                rough = part @ m.T
                rough[q_ids[low : low + 256][:, None] == ids[None, :]] = -np.inf
                depth = min(k, len(m))
                edge = np.partition(rough, len(m) - depth, axis=1)[:, len(m) - depth]
                for i in range(len(part)):
                    # Sums differ in their last bits with the shape of a product: scores are worked out
                    # again in one way, for all that may belong to the best.
                    slack = 1e-9 * (1 + abs(edge[i])) if np.isfinite(edge[i]) else 0.0
                    near = np.flatnonzero((rough[i] >= edge[i] - slack) & (rough[i] > -np.inf))
                    scores = (m[near] * part[i]).sum(axis=1)
                    best = np.lexsort((ids[near], -scores))[:k]
                    kept.append(q_ids[low + i])
                    found_ids.append(ids[near][best])
                    found_scores.append(scores[best])
                    bounds.append(bounds[-1] + len(best))
        offsets = pa.array(bounds, pa.int32())
        flat = pa.StructArray.from_arrays(
            [
                pa.array(-np.concatenate(found_scores) if found_scores else [], pa.float64()),
                pa.array(np.concatenate(found_ids) if found_ids else [], pa.int64()),
            ],
            ["loss", "vec_id"],
        )
        return pa.table({"query_id": pa.array(kept, pa.int64()), "found": pa.ListArray.from_arrays(offsets, flat)})

    return run


def nearest_neighbours(
    table: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20
) -> DataFrame:
    """(query_id, rank, vec_id, score): up to k rows of the table with the largest inner product with each query.

    A row never answers a query of its own id. Ties go to the smaller id. Scores are sums of products of
    the original vectors in double precision. Vectors that are NULL, empty, zero or hold a NULL or
    non-finite component take no part, nor do rows with a NULL id; queries and rows of different length
    do not meet. Rows that repeat an id count once if their vectors are equal. Other columns are not read.

    Centroids are fitted on about SAMPLE rows; every row is indexed. The reach is measured in every run on
    TRIALS queries. Lists are cut into blocks, and a
    query's best of each block are merged, so neither a long list nor a popular one meets in one task.
    """

    def usable_rows(df: DataFrame) -> DataFrame:
        kind = dict(df.dtypes)[vector_col]
        kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("vec"))
        return rows.where(usable("vec") & F.col("id").isNotNull())

    rows, asked = usable_rows(table), usable_rows(queries)
    kind = dict(rows.dtypes)["vec"]
    square = F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)
    by_length = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n"), F.max(square).alias("largest"))
    result = None
    # Vectors of one table have one length, or very few.
    for d, n, largest in sorted(map(tuple, by_length.collect())):
        largest = largest**0.5
        sample = bounded_sample(rows.where(F.size("vec") == d), "vec", "id", n, SAMPLE).get(d)
        if sample is None:
            # Too few rows for the sample to meet one: a single list.
            sample = np.zeros((1, d))
        count = int(min(MOST_LISTS, max(1, n // PER_LIST)))
        centroids = fit_centroids(_lifted(sample, largest), count)
        own, ask = rows.where(F.size("vec") == d), asked.where(F.size("vec") == d)
        schema = f"id long, vec {kind}, list int"
        members = stored(own.mapInArrow(_lister(centroids, largest), schema), "members")
        ask_kind = dict(ask.dtypes)["vec"]
        least, reach = measured_reach(members, ask, centroids, k)
        probes = stored(ask.mapInArrow(_prober(centroids, least, reach), f"id long, vec {ask_kind}, list int"), "probes")
        m_blocks = members.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("m_blocks"))
        q_blocks = probes.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("q_blocks"))
        blocks = stored(m_blocks.join(q_blocks, "list"), "blocks")
        own_block = F.pmod(F.xxhash64("id"), F.col("m_blocks")).cast("int")
        left = salted_left_join(members, blocks, ["list"], "id").where("q_blocks is not null")
        left = left.withColumn("m", own_block).withColumn("q", F.explode(F.expr("sequence(0, q_blocks - 1)")))
        right = salted_left_join(probes, blocks, ["list"], "id").where("m_blocks is not null")
        right = right.withColumn("q", F.pmod(F.xxhash64("id"), F.col("q_blocks")).cast("int"))
        right = right.withColumn("m", F.explode(F.expr("sequence(0, m_blocks - 1)")))
        left, right = (x.select("list", "m", "q", "id", "vec") for x in (left, right))
        keys = ["list", "m", "q"]
        scanned = right.groupBy(*keys).cogroup(left.groupBy(*keys)).applyInArrow(
            _scanner(k), "query_id long, found array<struct<loss:double,vec_id:long>>"
        )
        merged = scanned.groupBy("query_id").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
        # The same row from several lists stands side by side now.
        best = F.slice(F.filter("found", lambda x, i: (i == 0) | (x != F.get("found", i - 1))), 1, k)
        part = merged.select("query_id", F.posexplode(best).alias("place", "hit")).select(
            "query_id",
            (F.col("place") + 1).cast("int").alias("rank"),
            F.col("hit.vec_id").alias("vec_id"),
            (-F.col("hit.loss")).alias("score"),
        )
        result = part if result is None else result.unionByName(part)
    if result is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return result
