"""The nearest place of every point, over cells of about equal numbers of places."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.relational import haversine
from tessella.scratch import ship_package, stored

#: Places in a cell, about; cells at most (a corpus of more places has larger ones); places of the sample that sets the
#: cuts; points that meet a cell in one task; points by places of one comparison.
CELL, CELLS, SAMPLE, TOGETHER, BLOCK = 1024, 4096, 100_000, 1 << 16, 1 << 20
#: Chord lengths on the unit sphere that count as equal before distances are rounded to a millimetre.
SLACK = 1e-9


class Tree(NamedTuple):
    """A k-d tree over the unit sphere: node k has children 2k + 1 and 2k + 2. Leaves are cells, numbered from the left."""

    axis: np.ndarray
    cut: np.ndarray
    low: np.ndarray  # of each node's places, corner by corner; an empty cell's lie beyond all
    high: np.ndarray

    @property
    def first_leaf(self) -> int:
        return len(self.axis)

    def cell(self, xyz: np.ndarray) -> np.ndarray:
        at = np.zeros(len(xyz), np.int64)
        while len(self.axis) and at.size and at[0] < self.first_leaf:
            at = 2 * at + 1 + (xyz[np.arange(len(at)), self.axis[at]] >= self.cut[at])
        return at - self.first_leaf

    def within(self, xyz: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a point and a cell whose places may be nearer than the point's ``reach`` (a chord)."""
        point, node = np.arange(len(xyz)), np.zeros(len(xyz), np.int64)
        while True:
            off = np.maximum(np.maximum(self.low[node] - xyz[point], xyz[point] - self.high[node]), 0)
            ok = (off * off).sum(1) <= reach[point] ** 2
            point, node = point[ok], node[ok]
            if not len(node) or node[0] >= self.first_leaf:  # all nodes are of one depth
                return point, node - self.first_leaf
            point, node = np.repeat(point, 2), (2 * node[:, None] + [1, 2]).ravel()


def _cuts(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and cut of each inner node: the widest axis at its median."""
    axis, cut, held = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1), [sample]
    for k in range(len(axis)):
        own = held[k]
        if len(own):
            axis[k] = int(np.argmax(np.ptp(own, axis=0)))
            cut[k] = np.median(own[:, axis[k]])
        right = own[:, axis[k]] >= cut[k]
        held += [own[~right], own[right]]
    return axis, cut


def xyz(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, o = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)], axis=1)


def _degrees(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("lat").to_numpy(zero_copy_only=False), batch.column("lon").to_numpy(zero_copy_only=False)


def _tree(places: DataFrame) -> tuple[Tree, DataFrame]:
    """The tree, and the places by cell. The driver has a bounded sample of places and six numbers a cell."""
    n = places.count()
    depth = int(np.ceil(np.log2(min(CELLS, max(1, n / CELL)))))
    every = max(1, n // SAMPLE)
    sample = places.where(F.pmod(F.xxhash64("lat", "lon"), F.lit(every)) == 0).select("lat", "lon").toArrow() if depth else None
    axis, cut = _cuts(xyz(*(sample.column(c).to_numpy() for c in ("lat", "lon"))), depth) if depth else (np.zeros(0, np.int64), np.zeros(0))
    bare = Tree(axis, cut, np.zeros((0, 3)), np.zeros((0, 3)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = xyz(*_degrees(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bare.cell(at)), *(pa.array(at[:, k].copy()) for k in range(3))], names=[*batch.schema.names, "cell", "x", "y", "z"])

    kind = places.select("*").schema.add("cell", "long").add("x", "double").add("y", "double").add("z", "double")
    held = stored(places.mapInArrow(place, kind), "places")
    low, high = np.full((2 * len(axis) + 1, 3), 9.0), np.full((2 * len(axis) + 1, 3), -9.0)
    for cell, *box in held.groupBy("cell").agg(*(f(c) for f in (F.min, F.max) for c in "xyz")).collect():
        low[len(axis) + cell], high[len(axis) + cell] = box[:3], box[3:]
    for k in range(len(axis) - 1, -1, -1):
        low[k], high[k] = np.minimum(low[2 * k + 1], low[2 * k + 2]), np.maximum(high[2 * k + 1], high[2 * k + 2])
    return Tree(axis, cut, low, high), held.drop("x", "y", "z")


def _nearest_in(points: pa.Table, places: pa.Table) -> pa.Table:
    """Each point with the places of the cell that are as near as any of them, or nearly."""
    points, places = points.combine_chunks(), places.combine_chunks()
    a, b = xyz(*_degrees(points)), xyz(*_degrees(places))
    rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, BLOCK // max(1, len(b)))
    for i in range(0, len(a) if len(b) else 0, step):
        d = np.zeros((len(a[i : i + step]), len(b)))
        for k in range(3):
            d += (a[i : i + step, k, None] - b[None, :, k]) ** 2
        np.sqrt(d, out=d)
        r, c = np.nonzero(d <= d.min(axis=1, keepdims=True) + SLACK)
        rows.append(r + i)
        cols.append(c)
    r, c = pa.array(np.concatenate(rows)), pa.array(np.concatenate(cols))
    return pa.table([*(points.column(x).take(r) for x in ("lat", "lon")), *(places.column(x).take(c) for x in ("lat", "lon", "place"))], names=["lat", "lon", "plat", "plon", "place"])


def _met(points: DataFrame, places: DataFrame, km: Column, schema: str) -> DataFrame:
    """The best place of each point (lat, lon, cell) in its cell. A cell that many points ask for is dealt out."""
    asked = stored(points, "asked")
    many = F.broadcast(asked.groupBy("cell").agg((F.floor(F.count("*") / TOGETHER) + 1).alias("parts")))  # a row a cell: ``CELLS`` at most
    p = asked.join(many, "cell").withColumn("part", F.pmod(F.xxhash64("lat", "lon"), "parts"))
    q = places.join(many.select(F.col("cell"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")), "cell")
    found = p.drop("parts").groupBy("cell", "part").cogroup(q.groupBy("cell", "part")).applyInArrow(_nearest_in, schema)
    return found.groupBy("lat", "lon").agg(F.min(F.struct(km.alias("km"), F.col("place"))).alias("b"))


def nearest_place(points: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """``key``, ``place`` and ``km``, the nearest place of every point; ties at six decimals go to the smaller place.

    ``points`` and ``places`` have lat and lon in degrees, places a place. Exact: a point meets the places of its cell of a
    k-d tree, then those of all cells that may hold a nearer one, by the bounds of the cells' boxes. Equal positions meet
    once. Null where there is no place, or where the point has no position; repeated keys give one row, of the nearest.
    """
    ship_package(points.sparkSession)
    at = [F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in ("lat", "lon")]
    q = stored(places.where("place is not null").select(*at, "place").where("lat is not null and lon is not null").groupBy("lat", "lon").agg(F.min("place").alias("place")), "positions")
    where = stored(points.select(key, *at), "points")
    p = where.where("lat is not null and lon is not null").select("lat", "lon").distinct()
    tree, held = _tree(q)
    schema = f"lat double, lon double, plat double, plon double, place {dict(q.dtypes)['place']}"
    km = F.round(haversine(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon")), 6)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("cell", pa.array(tree.cell(xyz(*_degrees(batch)))))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = xyz(*_degrees(batch))
            half = batch.column("km").fill_null(1e9).to_numpy(zero_copy_only=False) / 12742.0176
            point, cell = tree.within(at, 2 * np.sin(np.minimum(half, np.pi / 2)) + SLACK)
            some = cell != tree.cell(at)[point]
            row = pa.array(point[some])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(row) for c in ("lat", "lon")), pa.array(cell[some])], names=["lat", "lon", "cell"])

    asked = "lat double, lon double, cell long"
    first = stored(_met(p.mapInArrow(own, asked), held, km, schema), "nearest-in-cell")
    start = p.join(first.select("lat", "lon", F.col("b.km").alias("km")), ["lat", "lon"], "left")
    best = first.union(_met(start.mapInArrow(others, asked), held, km, schema)).groupBy("lat", "lon").agg(F.min("b").alias("b"))
    one = where.join(best, ["lat", "lon"]).groupBy(key).agg(F.min("b").alias("b"))
    return where.select(key).distinct().join(one, key, "left").select(key, "b.place", "b.km")
