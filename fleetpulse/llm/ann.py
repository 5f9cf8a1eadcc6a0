"""Approximate nearest neighbours by inner product over balanced posting lists.

Vectors get one more component that gives them all the same length, so that the largest inner
product is the smallest distance. A tree of balanced k-means splits over a bounded sample gives
the centroids. Every vector goes to the list of its nearest centroid and, if it lies near a
boundary, also to the lists of others that are hardly farther. A query walks a graph of centroids
from near ones to nearer ones and searches all lists whose distance, as a ratio to that of the nearest,
is within a reach. The reach is measured on the table itself: up to ``PILOTS`` queries drawn by hash are
compared with all rows, and the reach is the one that keeps a share ``TARGET`` of their true neighbours.
So the number of lists that are searched follows the data and the size of the table; nothing caps it.

Lists are cut into blocks of bounded size by a hash of the vector's id, so a vector that millions
of rows repeat fills many blocks and no task holds a whole list. Every block has its best rows
per query; a task combines those of its blocks, and the best of all tasks are the answer. Scores are inner products of the vectors as
they are, added in double precision in the order of the components.

Results: vectors that are null or zero, or hold null or non-finite components, take no part, nor
do those whose length differs from the table's usual one. Ties go to the smaller id. A query with
fewer candidates gets as many as there are. An empty table gives an empty table. Rows that repeat an id
and its vector count once; an id with several vectors is a candidate by each of them. Other columns of
the tables are not read. What every task holds are the centroids, at most ``CENTROIDS``, and the pilots.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm.staging import sized_batches, staged

#: Rows that the centroids are fitted on, rows of the table per centroid, and bounds of their number.
SAMPLE, PER_LIST, CENTROIDS = 20_000, 400, 4_096
#: Lists that a vector may lie in, and how much farther than the nearest they may be (ratio of squared distances).
COPIES, BOUNDARY = 4, 1.15
#: Queries that the reach is measured with, and the share of their true neighbours that it has to keep.
PILOTS, TARGET = 256, 0.97
#: Neighbours of a centroid in the graph, and the least width of a query's walk.
DEGREE, WIDTH = 24, 96
#: Rows of a block, and queries whose best rows a task holds to combine those of its blocks before they are shuffled.
BLOCK, HELD = 4_096, 65_536


@dataclass
class Graph:
    """Centroids, the neighbours of each, and the places where walks begin."""

    centres: np.ndarray
    near: np.ndarray
    entries: np.ndarray

    def walk(self, x: np.ndarray, width: int, ratio: float = 0.0) -> list[tuple[float, int]]:
        """About the ``width`` centroids nearest to ``x``, and all met whose squared distance is at most ``ratio``
        times the least, as squared distance and number, nearest first."""
        import heapq

        def far(which: np.ndarray) -> np.ndarray:
            return ((self.centres[which] - x) ** 2).sum(axis=1)

        seen = np.zeros(len(self.centres), bool)
        seen[self.entries] = True
        open_ = [(d, c) for d, c in zip(far(self.entries).tolist(), self.entries.tolist(), strict=True)]
        met, least = list(open_), min(open_)[0]
        heapq.heapify(open_)
        best = [-d for d, _ in open_]
        heapq.heapify(best)
        while len(best) > width:
            heapq.heappop(best)
        while open_:
            d, c = heapq.heappop(open_)
            if len(best) >= width and d > max(-best[0], within(ratio, least)):
                break
            new = self.near[c][~seen[self.near[c]]]
            seen[new] = True
            for dn, n in zip(far(new).tolist(), new.tolist(), strict=True):
                least = min(least, dn)
                if len(best) < width:
                    heapq.heappush(best, -dn)
                elif dn < -best[0]:
                    heapq.heapreplace(best, -dn)
                elif dn > within(ratio, least):
                    continue
                heapq.heappush(open_, (dn, n))
                met.append((dn, n))
        edge = max(-best[0], within(ratio, least))
        return sorted(x for x in met if x[0] <= edge)


def within(ratio: float, least: float) -> float:
    """The largest squared distance that a ratio allows; the slack lets a ratio mean something for a vector on a centroid."""
    return ratio * (least + 1e-9)


def _halves(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Whether each row goes to the second of two equally large halves."""
    a, b = x[rng.choice(len(x), 2, replace=False)]
    for _ in range(8):
        lean = x @ (b - a)
        second = np.zeros(len(x), bool)
        second[np.argsort(lean, kind="stable")[len(x) // 2 :]] = True
        a, b = x[~second].mean(axis=0), x[second].mean(axis=0)
    return second


def fit_graph(sample: np.ndarray, lists: int, seed: int = 5) -> Graph:
    """Centroids of ``lists`` groups of about equal size, joined to a graph."""
    rng = np.random.default_rng(seed)
    groups = [sample]
    while len(groups) < lists:
        groups.sort(key=len)
        x = groups.pop()
        if len(x) < 2:
            groups.append(x)
            break
        second = _halves(x, rng)
        groups += [x[~second], x[second]]
    centres = np.unique(np.stack([g.mean(axis=0) for g in groups]), axis=0)
    gaps = (centres**2).sum(axis=1)[:, None] - 2 * centres @ centres.T + (centres**2).sum(axis=1)[None, :]
    order = np.argsort(gaps, axis=1, kind="stable")
    near = order[:, 1 : DEGREE + 1]
    entries = rng.choice(len(centres), min(len(centres), 16), replace=False)
    return Graph(centres, near, entries)


def usable(vector: str) -> Column:
    """Whether a vector takes part by its own components."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """The vectors scaled into the unit ball, with the component that brings them to its surface."""
    x = x / longest
    return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x**2).sum(axis=1)))])


def _score(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products, added component by component: equal vectors have equal scores."""
    total = np.zeros(len(rows))
    for k in range(rows.shape[1]):
        total += query[k] * rows[:, k]
    return total


def _best(query: np.ndarray, own: int | None, ids: np.ndarray, rows: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows of a block for a query; ``rough`` are products that may be off by rounding."""
    if len(ids) > k + 1:
        edge = np.partition(rough, -k - 1)[-k - 1]
        pick = np.flatnonzero(rough >= edge - 1e-9 * (1 + abs(edge)))
    else:
        pick = np.arange(len(ids))
    pick = pick[ids[pick] != own] if own is not None else pick
    score = _score(query, rows[pick])
    order = np.lexsort((ids[pick], -score))[:k]
    return ids[pick][order], score[order]


def _merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of two lists of ids and scores; what both have counts once."""
    ids, score = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.lexsort((ids, -score))
    ids, score = ids[order], score[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (score[1:] != score[:-1])
    return ids[new][:k], score[new][:k]


def _rows_of(merged: dict[tuple[int, bytes], tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    which = np.repeat([q for q, _ in merged], [len(found) for found, _ in merged.values()])
    columns = [which, np.concatenate([f for f, _ in merged.values()]), np.concatenate([s for _, s in merged.values()])]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])


def neighbours(
    queries: DataFrame, table: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", target: float = TARGET
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the k rows of ``table`` found nearest, without the row of its own id.

    ``target`` is the share of true neighbours that the searched lists have to hold, measured on pilot queries.
    """
    spark = table.sparkSession
    sized_batches(spark)
    v = F.col(vector_col).cast("array<double>")
    rows = table.where(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    shapes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(length).alias("longest"))
    shape = shapes.orderBy(F.desc("n"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if shape is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == shape["dim"])
    asked = queries.where(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.size("v") == shape["dim"])
    graph = _fitted(rows, shape["n"], shape["longest"])
    longest = shape["longest"]
    shared = spark.sparkContext.broadcast(graph)

    lists = rows.mapInArrow(_to_lists(shared, longest, BOUNDARY, 8 * COPIES, COPIES), "list int, id long, v array<double>")
    lists = staged(lists.withColumn("hash", F.xxhash64("id")), "lists")
    blocks = lists.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    stored = lists.join(blocks, "list").withColumn("block", F.pmod("hash", F.col("blocks")).cast("int"))
    reach = _reach(asked, rows, lists, graph, longest, k, target)
    probing = asked.mapInArrow(_to_lists(shared, longest, reach, WIDTH), "list int, id long, v array<double>")
    probing = probing.join(blocks, "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    names = ["list", "block", "kind", "id", "v"]
    both = stored.withColumn("kind", F.lit(0)).select(*names).unionByName(probing.withColumn("kind", F.lit(1)).select(*names))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids, parts, have, merged = None, [], [], None, {}
        for b in batches:
            keys = b.column("list").to_numpy().astype(np.int64) << 32 | b.column("block").to_numpy()
            kinds = b.column("kind").to_numpy()
            matrix, doc = _matrix(b.column("v")), b.column("id").to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(keys) != 0) | (np.diff(kinds) != 0)) + 1), len(keys)]
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                if begin == end:
                    continue
                if keys[begin] != place:
                    place, ids, parts, have = keys[begin], [], [], None
                if kinds[begin] == 0:
                    new = _first_of_repeats(doc[begin:end], matrix[begin:end], ids[-1][-1:] if ids else None, parts[-1][-1:] if ids else None)
                    if new.any():
                        ids.append(doc[begin:end][new])
                        parts.append(matrix[begin:end][new])
                    continue
                if not ids:
                    continue
                if have is None:
                    have = np.concatenate(ids), np.concatenate(parts)
                for at in range(begin, end, 256):
                    some = slice(at, min(at + 256, end))
                    rough = matrix[some] @ have[1].T
                    for q, products in zip(range(some.start, some.stop), rough, strict=True):
                        found, score = _best(matrix[q], doc[q], *have, products, k)
                        asked_by = doc[q], matrix[q].tobytes()
                        merged[asked_by] = _merge(merged[asked_by], (found, score), k) if asked_by in merged else (found, score)
                if len(merged) > HELD:
                    yield _rows_of(merged)
                    merged = {}
        if merged:
            yield _rows_of(merged)

    found = (
        both.repartition("list", "block").sortWithinPartitions("list", "block", "kind", "id", "v")
        .mapInArrow(search, "query_id long, vec_id long, score double").distinct()
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _fitted(rows: DataFrame, n: int, longest: float) -> Graph:
    """The graph of centroids over a sample of at most about ``SAMPLE`` rows, drawn by a hash of the id."""
    lists = int(min(max(n // PER_LIST, 1), CENTROIDS))
    share = min(1.0, SAMPLE / n)
    cut = int(share * (1 << 30))
    sample = rows.where(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 30)) <= cut).select("v", "id").distinct()
    drawn = sample.orderBy(F.xxhash64(F.lit(4), "id"), "v").limit(2 * SAMPLE).select("v").toPandas()["v"]
    return fit_graph(_lifted(np.unique(np.stack([np.asarray(x, float) for x in drawn]), axis=0), longest), lists)


def _first_of_repeats(ids: np.ndarray, rows: np.ndarray, last_id: np.ndarray | None, last_row: np.ndarray | None) -> np.ndarray:
    """Which of the sorted rows differ from the one before them, in id or vector."""
    new = np.ones(len(ids), bool)
    same = np.flatnonzero(ids[1:] == ids[:-1]) + 1
    new[same] = (rows[same] != rows[same - 1]).any(axis=1)
    if last_id is not None and ids[0] == last_id[0]:
        new[0] = (rows[0] != last_row[0]).any()
    return new


def _reach(asked: DataFrame, rows: DataFrame, lists: DataFrame, graph: Graph, longest: float, k: int, target: float) -> float:
    """The ratio of squared distances within which lists hold ``target`` of the pilots' true neighbours.

    The pilots are distinct vectors. Every task gives its own k best rows per pilot, so what is merged
    grows with the tasks, not with the rows.
    """
    drawn = asked.orderBy(F.xxhash64(F.lit(5), "id"), "id").limit(4 * PILOTS).toPandas()
    if drawn.empty:
        return 1.0
    x = np.stack([np.asarray(v, float) for v in drawn["v"]])
    pick = np.sort(np.unique(x, axis=0, return_index=True)[1])[:PILOTS]
    x, own = x[pick], drawn["id"].to_numpy()[pick]
    pilots = rows.sparkSession.sparkContext.broadcast((x, own))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, own = pilots.value
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(own)
        for b in batches:
            matrix, ids = _matrix(b.column("v")), b.column("id").to_numpy()
            for at in range(0, len(ids), BLOCK):
                part, names = matrix[at : at + BLOCK], ids[at : at + BLOCK]
                for q, products in enumerate(x @ part.T):
                    found, score = _best(x[q], own[q], names, part, products, k)
                    best[q] = _merge(best[q], (found, score), k)
        which = np.repeat(np.arange(len(own)), [len(f) for f, _ in best])
        columns = [which.astype(np.int32), np.concatenate([f for f, _ in best]), np.concatenate([s for _, s in best])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["pilot", "id", "score"])

    near = rows.mapInArrow(compare, "pilot int, id long, score double").distinct()
    rank = F.row_number().over(Window.partitionBy("pilot").orderBy(F.desc("score"), "id"))
    truth = near.withColumn("rank", rank).where(F.col("rank") <= k).select("pilot", "id").distinct()
    # at most PILOTS * k rows, each in at most COPIES lists for every vector of its id
    held = lists.select("id", "list").join(F.broadcast(truth), "id").select("pilot", "id", "list").distinct().toPandas()
    pilots.unpersist()
    if held.empty:
        return 1.0
    lifted = _lifted(x, longest)
    far = (lifted**2).sum(axis=1)[:, None] - 2 * lifted @ graph.centres.T + (graph.centres**2).sum(axis=1)[None, :]
    least = np.maximum(far.min(axis=1), 0)
    held["ratio"] = np.maximum(far[held["pilot"], held["list"]], 0) / (least[held["pilot"]] + 1e-9)
    return float(np.quantile(held.groupby(["pilot", "id"])["ratio"].min(), target, method="higher")) * (1 + 1e-6)


def _to_lists(shared, longest: float, ratio: float, width: int, most: int | None = None):
    """A task that sends vectors to the lists of their nearest centroids within the distance ratio, at most ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = shared.value
        for b in batches:
            lists, which = [], []
            for k, x in enumerate(_lifted(_matrix(b.column("v")), longest)):
                near = graph.walk(x, width, 0.0 if most else ratio)
                reach = max(near[0][0], within(ratio, near[0][0]))
                for d, c in near[:most]:
                    if d <= reach:
                        lists.append(c)
                        which.append(k)
            take = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), b.column("id").take(take), b.column("v").take(take)], ["list", "id", "v"])

    return run
