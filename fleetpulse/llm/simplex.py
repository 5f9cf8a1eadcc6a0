"""Centroid clustering in exact integers, with centroids filtered by an n-simplex projection.

A few vectors are pivots. They span a simplex, and the distances of a vector to them place it as
the apex over that simplex: as many coordinates as pivots, the last one its height. The distance of
two apexes is at most the distance of their vectors, and at least it if one apex is mirrored at the
base. The coordinates of all vectors are written once. In a round every centroid is projected as
well; a centroid whose lower bound is above the smallest upper bound of a vector can't be its
nearest, and those that are left are compared in integers.

A round is one pass over the written vectors, which adds up each cluster's components; of a cluster
and task one row goes on. In memory and on the driver are the pivots and the centroids, whose number
and width are parameters.

Components may be of any size: those beyond ``SMALL`` are kept as whole doubles and worked on as
Python integers, and sums are carried in limbs of 32 bits, so nothing overflows. A squared distance
that a long can't hold is given as the largest long.

Results: vectors that are null, of another width or hold null or non-finite components take no part
and have no row. Repeated rows are vectors of their own. Centroids start in order of hash, then of
components; a null id has no hash and comes last. Fewer vectors than centroids give as many clusters
as vectors, an empty table an empty table. Only the id and vector columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.staging import sized_batches, staged

WIDTH, CLUSTERS, ROUNDS, SCALE = 64, 40, 5, 256
#: As many as components: with fewer, the bounds of vectors without structure spare next to nothing.
PIVOTS = 64
#: Largest component of the vectors whose squared distances fit in a long.
SMALL = 1 << 27
_LONG = (1 << 63) - 1
_LIMB = (1 << 32) - 1
_TILE = 4_096


def whole(vector: Column, width: int) -> Column:
    """Whether a vector has the width and finite components only."""
    x = F.transform(vector, lambda v: v.cast("double"))
    return F.coalesce((F.size(x) == width) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))


def _floors(values: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)``: as int64, or as Python integers where a component is large."""
    if not len(values) or np.abs(values).max() < SMALL / scale:
        return np.floor(values * scale).astype(np.int64)
    exact = np.empty(values.shape, object)
    exact.flat = [_floor(v, scale) for v in values.ravel().tolist()]
    return exact


def _floor(x: float, scale: int) -> int:
    above, below = x.as_integer_ratio()
    return above * scale // below


def _packed(rows: np.ndarray) -> list[bytes]:
    """Four bytes a component, or decimals of another length."""
    if rows.dtype != object:
        return [r.tobytes() for r in rows.astype(np.int32)]
    texts = ["\n".join(map(str, r)).encode() for r in rows]
    return [t + b" " * (len(t) == 4 * rows.shape[1]) for t in texts]


def _unpacked(bodies: list[bytes], width: int) -> np.ndarray:
    if all(len(b) == 4 * width for b in bodies):
        return np.frombuffer(b"".join(bodies), np.int32).reshape(-1, width).astype(np.int64)
    rows = [np.frombuffer(b, np.int32).tolist() if len(b) == 4 * width else [int(x) for x in b.split(b"\n")] for b in bodies]
    return np.array(rows, object)


class Simplex:
    """The base that the pivots span, and the apex that distances to them give.

    Pivots that lie in the span of earlier ones are left out.
    """

    def __init__(self, pivots: np.ndarray) -> None:
        pivots = pivots.astype(np.float64)
        base, used = [np.zeros(0)], [0] if len(pivots) else []
        for k in range(1, len(pivots)):
            to = np.linalg.norm(pivots[used] - pivots[k], axis=1)[None]
            place, height = self._place(np.array(base), to)
            if height[0] > 1e-6 * max(1.0, to.max()):
                base = [np.append(b, 0.0) for b in base] + [np.append(place[0], height[0])]
                used.append(k)
        self.pivots = pivots[used]
        self.base = np.array(base) if used else np.zeros((0, 0))

    @staticmethod
    def _place(base: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates in the base, and the height over it, of points by their distances to its corners."""
        norms = (base**2).sum(axis=1)
        known = (to[:, :1] ** 2 - to[:, 1:] ** 2 + norms[1:]) / 2  # the first corner is the origin
        place = np.linalg.solve(base[1:], known.T).T if len(base) > 1 else np.zeros((len(to), 0))
        return place, np.sqrt(np.maximum(to[:, 0] ** 2 - (place**2).sum(axis=1), 0.0))

    def apexes(self, vectors: np.ndarray) -> np.ndarray:
        if not len(self.pivots):
            return np.zeros((len(vectors), 1))
        to = np.sqrt(np.maximum(((vectors[:, None, :].astype(np.float64) - self.pivots[None]) ** 2).sum(axis=2), 0.0))
        place, height = self._place(self.base, to)
        return np.column_stack([place, height])


def bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distance of each of ``a`` to each of ``b``, given by apexes."""
    flat = np.maximum((a[:, None, :-1] - b[None, :, :-1]) ** 2, 0.0).sum(axis=2)
    return flat + (a[:, None, -1] - b[None, :, -1]) ** 2, flat + (a[:, None, -1] + b[None, :, -1]) ** 2


def nearest(vectors: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, centre_apexes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of and exact squared distance to the nearest centroid (the smaller number of equal ones), and the distances computed."""
    if vectors.dtype == object or centroids.dtype == object:
        far = ((vectors[:, None, :].astype(object) - centroids[None].astype(object)) ** 2).sum(axis=2)
        best = np.array([min(range(far.shape[1]), key=row.__getitem__) for row in far], np.int64)
        return best, far[np.arange(len(far)), best], far.size
    low, high = bounds(apexes, centre_apexes)
    # what rounding may add: coordinates are kept in four bytes
    slack = 1e-5 * (1.0 + (apexes**2).sum(axis=1)[:, None] + (centre_apexes**2).sum(axis=1)[None])
    row, centre = np.nonzero(low - slack <= (high + slack).min(axis=1)[:, None])
    exact = np.empty(len(row), np.int64)
    for at in range(0, len(row), _TILE * 8):
        d = vectors[row[at : at + _TILE * 8]] - centroids[centre[at : at + _TILE * 8]]
        exact[at : at + _TILE * 8] = np.einsum("ij,ij->i", d, d)
    order = np.lexsort((centre, exact, row))
    first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
    return centre[first], exact[first], len(row)


def _limbs(total: np.ndarray) -> list[np.ndarray]:
    """Integers as signed sums of limbs of 32 bits."""
    if total.dtype != object:
        return [total & _LIMB, total >> 32]
    out = []
    while any(v not in (0, -1) for v in total):
        out.append(np.array([v & _LIMB for v in total], np.int64))
        total = np.array([v >> 32 for v in total], object)
    return [*out, total.astype(np.int64)]


def _tiles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, _TILE):
            b = batch.slice(at, _TILE)
            apexes = np.frombuffer(b"".join(b.column("apex").to_pylist()), np.float32).reshape(b.num_rows, -1).astype(np.float64)
            yield b, _unpacked(b.column("body").to_pylist(), width), apexes


def _first(rows: DataFrame, seed: str, n: int, width: int) -> np.ndarray:
    """The ``n`` vectors that start as centroids, or pivots: those of smallest hash of ``seed:id``."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    found = rows.orderBy(hashed.asc_nulls_last(), "vector").select("vector").limit(n).collect()
    return np.array([r["vector"] for r in found], np.float64).reshape(len(found), width)


def cluster(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH, clusters: int = CLUSTERS,
    rounds: int = ROUNDS, scale: int = SCALE, seed: str = "2", pivots: int = PIVOTS,
) -> tuple[DataFrame, np.ndarray]:
    """``id, cluster, distance`` of every vector, and the final centroids."""
    spark = rows.sparkSession
    sized_batches(spark)
    vector = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    kept = rows.where(whole(F.col(vector_col), width)).select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"))
    centroids = _floors(_first(kept, seed, clusters, width), scale)
    simplex = Simplex(np.clip(_floors(_first(kept, f"pivot-{seed}", pivots, width), scale).astype(np.float64), -SMALL, SMALL))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _TILE):
                b = batch.slice(at, _TILE)
                ints = _floors(np.asarray(b.column("vector").flatten()).reshape(-1, width), scale)
                apexes = simplex.apexes(np.clip(ints.astype(np.float64), -SMALL, SMALL))
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), pa.array(_packed(ints), pa.binary()), pa.array([a.tobytes() for a in apexes.astype(np.float32)], pa.binary())], ["id", "body", "apex"]
                )

    cached = staged(kept.mapInArrow(project, "id long, body binary, apex binary"), "apexes")
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(cached, centroids, simplex, width)

    final, apexes = centroids, simplex.apexes(centroids.astype(np.float64))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, vectors, own in _tiles(batches, width):
            best, far, _ = nearest(vectors, own, final, apexes)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(best, pa.int32()), pa.array([min(int(d), _LONG) for d in far] if far.dtype == object else far, pa.int64())],
                ["id", "cluster", "distance"],
            )

    return cached.mapInArrow(assign, "id long, cluster int, distance long"), centroids


def _moved(cached: DataFrame, centroids: np.ndarray, simplex: Simplex, width: int) -> np.ndarray:
    """The centroids after a round."""
    apexes = simplex.apexes(centroids.astype(np.float64))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((len(centroids), width), np.int64), np.zeros(len(centroids), np.int64)
        for _, vectors, own in _tiles(batches, width):
            best, _, _ = nearest(vectors, own, centroids, apexes)
            if vectors.dtype == object:
                total = total.astype(object)
            order = np.argsort(best, kind="stable")
            first = np.flatnonzero(np.diff(best[order], prepend=-1))
            total[best[order][first]] += np.add.reduceat(vectors[order], first)
            count += np.bincount(best, minlength=len(count))
        found = [(c, k, limb) for c in np.flatnonzero(count) for k, limb in enumerate(_limbs(total[c]))]
        yield pa.RecordBatch.from_arrays([
            pa.array([c for c, _, _ in found], pa.int32()), pa.array([k for _, k, _ in found], pa.int32()),
            pa.array([count[c] if k == 0 else 0 for c, k, _ in found], pa.int64()), pa.array([limb.tolist() for _, _, limb in found], pa.list_(pa.int64())),
        ], ["cluster", "limb", "n", "total"])

    parts = cached.mapInArrow(sums, "cluster int, limb int, n long, total array<long>")
    added = parts.groupBy("cluster", "limb").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[k]) for k in range(width))).alias("total"))
    size, total = [0] * len(centroids), [[0] * width for _ in centroids]
    for c, limb, n, part in added.collect():
        size[c] += n
        total[c] = [t + (v << (32 * limb)) for t, v in zip(total[c], part, strict=True)]
    new = [[t // size[c] for t in total[c]] if size[c] else centroids[c].tolist() for c in range(len(centroids))]
    return np.array(new, np.int64) if all(abs(v) <= SMALL for row in new for v in row) else np.array(new, object)


def fingerprints(centroids: np.ndarray) -> list[str]:
    """SHA-256 of each centroid's components in decimal, joined by commas."""
    import hashlib

    return [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]


def filtered_share(vectors: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> float:
    """Share of all distances that the bounds spare."""
    simplex = Simplex(pivots)
    done = nearest(vectors, simplex.apexes(vectors), centroids, simplex.apexes(centroids))[2]
    return 1 - done / math.prod((len(vectors), len(centroids)))
