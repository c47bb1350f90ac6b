"""Pairs of vectors by cosine, over cells around pivots: cells that the triangle inequality excludes never meet."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.vectors import unit
from tessella.operators.leaders import leader_rounds
from tessella.scratch import ship_package, stored

#: Vectors of a block, of which a task compares two; blocks of a key at least; rows of a matrix product.
PART_ROWS, LEAST_PARTS, TILE = 8192, 6, 1024
#: Pivots at most, for vectors of one length; sampled vectors for a pivot. Pivots decide what need not be compared,
#: never a result.
PIVOTS, SAMPLE = 2048, 8
#: Angles that count as equal: rounding of unit vectors.
SLACK = 1e-6
#: References around a pivot, about; rows that meet a cell's references in one task, and references.
CELL, ROWS, REFERENCES = 1024, 1 << 15, 1 << 14
#: Pairs of vectors whose cosine is computed anew at once, and rows that are given at once.
GATHER = 1 << 14
#: Vectors among which one task finds the leaders at once.
PASS_VECTORS = 1 << 14


def _matrix(column: pa.ChunkedArray | pa.ListArray, width: int) -> np.ndarray:
    own = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return own.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def pivots_of(sample: np.ndarray, number: int) -> np.ndarray:
    """Unit vectors in the middle of the sample's clusters: the first ``number`` vectors, moved once to the mean of
    those that are nearest to them."""
    p = sample[:number].copy()
    nearest = np.argmax(sample @ p.T, axis=1)
    for k in range(len(p)):
        mean = sample[nearest == k].sum(axis=0)
        if (length := np.linalg.norm(mean)) > 1e-9:
            p[k] = mean / length
    return p


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def nearest_pivot(a: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each row and the angle to it, for some rows at a time."""
    cell, far = np.zeros(len(a), np.int64), np.zeros(len(a))
    for i in range(0, len(a), TILE):
        to = angles(a[i : i + TILE], pivots)
        cell[i : i + TILE], far[i : i + TILE] = to.argmin(axis=1), to.min(axis=1)
    return cell, far


def pivots_within(a: np.ndarray, pivots: np.ndarray, reach: Callable[[slice], np.ndarray], but_nearest: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Rows and pivots whose angle is within what ``reach`` gives for some rows, without each row's nearest pivot if that
    is asked for; some rows at a time."""
    row, cell = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(a), TILE):
        to = angles(a[i : i + TILE], pivots)
        ok = to <= reach(slice(i, i + TILE))
        if but_nearest:
            ok[np.arange(len(to)), to.argmin(axis=1)] = False
        p, c = np.nonzero(ok)
        row.append(i + p)
        cell.append(c)
    return np.concatenate(row), np.concatenate(cell)


def dealt(rows: DataFrame, id_: str, vector: str, threshold: float, key: str | None = None, blocks: int = LEAST_PARTS) -> DataFrame:
    """The vectors (id, u, of unit length, and the block they belong to) as often as there are pairs of blocks ``i`` <=
    ``j`` that one of theirs may be near to; by ``key`` and length ``n``.

    A block is a part, by a hash, of the vectors around one pivot. A vector is sent to the blocks of a pivot only if its
    angle to the pivot is at most the threshold's plus the largest one there: beyond, the triangle inequality leaves no
    near pair. Few vectors have no pivots and are dealt by the hash alone. On the driver: a bounded sample, the pivots, and
    a radius for each of them.
    """
    spark = rows.sparkSession
    ship_package(spark)
    u = rows.select(F.col(id_).alias("id"), unit(vector).alias("u"), (F.col(key).cast("string") if key else F.lit("")).alias("key")).where("u is not null and key is not null").withColumn("n", F.size("u"))
    sizes = {r["n"]: (r["most"], r["total"]) for r in u.groupBy("key", "n").agg(F.count("*").alias("k")).groupBy("n").agg(F.max("k").alias("most"), F.sum("k").alias("total")).collect()}
    number = {n: min(PIVOTS, most // PART_ROWS) for n, (most, _) in sizes.items() if most // PART_ROWS > 1}
    most = max((m for m, _ in sizes.values()), default=0)
    if not number:
        parts = max(blocks, -(-most // PART_ROWS))
        spread = F.sequence(F.lit(0), F.lit(parts - 1))
        own = u.withColumns({"part": F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"), "meets": spread})
    else:
        own = _around_pivots(u, sizes, number, threshold)
    met = F.explode(F.transform("meets", lambda o: F.struct(F.least("part", o).alias("i"), F.greatest("part", o).alias("j"))))
    return own.withColumn("c", met).select("key", "n", "c.i", "c.j", "part", "id", "u")


def _around_pivots(u: DataFrame, sizes: dict[int, tuple[int, int]], number: dict[int, int], threshold: float) -> DataFrame:
    spark = u.sparkSession
    pivots: dict[int, np.ndarray] = {}
    for n, k in number.items():
        every = max(1, sizes[n][1] // (SAMPLE * k))
        sample = u.where((F.col("n") == n) & (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(every)) == 0)).select("u").limit(4 * SAMPLE * k).toArrow()
        if sample.num_rows:
            pivots[n] = pivots_of(_matrix(sample.column("u"), n), k)
    shared = spark.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            cell, far = np.zeros(len(n), np.int32), np.full(len(n), np.pi)
            for width in np.unique(n).tolist():
                if width in shared.value:
                    at = np.flatnonzero(n == width)
                    cell[at], far[at] = nearest_pivot(_matrix(batch.column("u").take(pa.array(at)), width), shared.value[width])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    held = stored(u.mapInArrow(place, u.select("*").schema.add("cell", "integer").add("far", "double")), "vectors")
    parts = max(1, -(-held.groupBy("key", "n", "cell").agg(F.count("*").alias("k")).agg(F.max("k")).first()[0] // PART_ROWS))
    radius = {n: np.full(len(p), -9.0) for n, p in pivots.items()}
    for n, cell, far in held.groupBy("n", "cell").agg(F.max("far")).collect():
        if n in radius:
            radius[n][cell] = far
    reach = spark.sparkContext.broadcast((radius, float(np.arccos(np.clip(threshold, -1, 1))) + SLACK))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radii, theta = reach.value
        for batch in batches:
            n = batch.column("n").to_numpy()
            row, cell = [np.flatnonzero(~np.isin(n, list(radii)))], []
            cell.append(np.zeros(len(row[0]), np.int64))
            for width in np.unique(n).tolist():
                if width in radii:
                    at = np.flatnonzero(n == width)
                    bound = theta + radii[width]
                    r, c = pivots_within(_matrix(batch.column("u").take(pa.array(at)), width), shared.value[width], lambda _, bound=bound: bound)
                    row.append(at[r])
                    cell.append(c)
            r, c = np.concatenate(row), np.concatenate(cell)
            order = np.argsort(r, kind="stable")
            flat = (c[order][:, None] * parts + np.arange(parts)).ravel().astype(np.int32)
            ends = np.cumsum(np.bincount(r, minlength=len(n)) * parts)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("id", "u", "key", "n", "part")), lists], names=["id", "u", "key", "n", "part", "meets"])

    blocks = held.withColumn("part", F.col("cell") * parts + F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).drop("cell", "far")
    kind = dict(u.dtypes)["id"]
    return blocks.mapInArrow(meet, f"id {kind}, u array<double>, key string, n int, part int, meets array<int>")


def compared(given: DataFrame) -> int:
    """How many pairs of vectors meet in rows of ``dealt``."""
    first, second = F.count_if(F.col("part") == F.col("i")), F.count_if(F.col("part") == F.col("j"))
    pairs = F.when(F.col("i") == F.col("j"), first * (first - 1) / 2).otherwise(first * second)
    return int(given.groupBy("key", "n", "i", "j").agg(pairs.alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0])


def _tiles(cell: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows and cosines of near pairs of two blocks, or of one."""
    part, i, j, n = cell.column("part").to_numpy(), cell.column("i")[0].as_py(), cell.column("j")[0].as_py(), cell.column("n")[0].as_py()
    m = _matrix(cell.column("u"), n)
    own = np.flatnonzero(part == i)
    other = own if i == j else np.flatnonzero(part == j)
    for a in range(0, len(own), TILE):
        for b in range(a if i == j else 0, len(other), TILE):
            x, y = own[a : a + TILE], other[b : b + TILE]
            s = m[x] @ m[y].T
            p, q = np.nonzero(s >= threshold)
            if i == j and a == b:
                p, q = p[keep := p < q], q[keep]
            yield x[p], y[q], s[p, q]


def near_vectors(rows: DataFrame, id_: str, vector: str, threshold: float, key: str | None = None, blocks: int = LEAST_PARTS) -> DataFrame:
    """``left_id`` < ``right_id`` and ``similarity`` of vectors with a cosine of at least ``threshold``.

    Exact. Rows of one ``key`` (all, where there is none) meet in blocks of about ``PART_ROWS``, two to a task, by matrix
    products; blocks too far apart never meet (``dealt``), so clustered vectors cost what is near, and vectors without
    clusters all pairs. Zero and null vectors match nothing, nor do those of different length, nor rows of one id.
    """
    def compare(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        ids = np.array(cell.column("id").to_pylist())
        left, right, similarity = [ids[:0]], [ids[:0]], [np.zeros(0)]
        for p, q, s in _tiles(cell, threshold):
            keep = ids[p] != ids[q]
            one, two = ids[p[keep]], ids[q[keep]]
            turned = one > two
            left.append(np.where(turned, two, one))
            right.append(np.where(turned, one, two))
            similarity.append(s[keep])
        of = cell.schema.field("id").type
        return pa.table({"left_id": pa.array(np.concatenate(left).tolist(), of), "right_id": pa.array(np.concatenate(right).tolist(), of), "similarity": pa.array(np.concatenate(similarity))})

    given = dealt(rows, id_, vector, threshold, key, blocks)
    kind = dict(given.dtypes)["id"]
    return given.groupBy("key", "n", "i", "j").applyInArrow(compare, f"left_id {kind}, right_id {kind}, similarity double")


def joined(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Labels (each a row, whose label is itself) after the rows of all pairs have come together under the smallest."""
    while True:
        a, b = label[p], label[q]
        apart = a != b
        if not apart.any():
            return label
        p, q, a, b = p[apart], q[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def vector_links(rows: DataFrame, id_: str, vector: str, threshold: float, key: str | None = None, blocks: int = LEAST_PARTS) -> DataFrame:
    """``a`` and ``b``, links that connect just the vectors that near pairs connect; a task gives at most one for each
    vector that it has, however many pairs are near."""
    def link(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        label = np.arange(cell.num_rows)
        for p, q, _ in _tiles(cell, threshold):
            label = joined(label, p, q)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": cell.column("id").take(pa.array(moved)), "b": cell.column("id").take(pa.array(label[moved]))})

    given = dealt(rows, id_, vector, threshold, key, blocks)
    kind = dict(given.dtypes)["id"]
    return given.groupBy("key", "n", "i", "j").applyInArrow(link, f"a {kind}, b {kind}").where("a <> b")


def vector_leaders(nodes: DataFrame, threshold: float) -> DataFrame:
    """``node`` and ``leader``: greedy groups, in order of ``ordinal``, of vectors ``x`` with a cosine of at least
    ``threshold``; a null or zero vector leads alone. As many comparisons as there are vectors times leaders, however many pairs
    are near."""
    def values(x: pa.Array) -> np.ndarray:
        return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)

    return leader_rounds(nodes.withColumn("n", F.coalesce(F.size("x"), F.lit(-1))), values, lambda a, b: a @ b.T >= threshold, PASS_VECTORS, unit)


def _best_in(rows: pa.Table, refs: pa.Table) -> pa.Table:
    """The most similar reference of each row; of equal ones the smallest."""
    rows, refs = rows.combine_chunks(), refs.combine_chunks()
    kind = pa.schema([("id", rows.schema.field("id").type), ("similarity", pa.float64()), ("ref_id", refs.schema.field("ref_id").type)])
    if not rows.num_rows or not refs.num_rows:
        return kind.empty_table()
    n = rows.column("n")[0].as_py()
    a, b = _matrix(rows.column("u"), n), _matrix(refs.column("u"), n)
    names = refs.column("ref_id").to_pylist()
    best: list[tuple[float, object]] = []
    for i in range(0, len(a), TILE):
        own: dict[int, tuple[float, object]] = {}
        top = np.full((len(a[i : i + TILE]), 1), -np.inf)
        for j in range(0, len(b), TILE):
            s = a[i : i + TILE] @ b[j : j + TILE].T
            top = np.maximum(top, s.max(axis=1, keepdims=True))
            p, q = np.nonzero(s >= top - 1e-9)
            # the same for equal vectors, wherever they stand
            exact = np.concatenate([(a[i + p[k : k + GATHER]] * b[j + q[k : k + GATHER]]).sum(axis=1) for k in range(0, len(p), GATHER)] or [np.zeros(0)])
            for k, x, y in zip(p.tolist(), exact.tolist(), (names[j + c] for c in q.tolist()), strict=True):
                if k not in own or x > own[k][0] or (x == own[k][0] and y < own[k][1]):
                    own[k] = (x, y)
        best += [own[k] for k in range(len(top))]
    return pa.table([rows.column("id"), pa.array([x for x, _ in best]), pa.array([y for _, y in best], kind.field("ref_id").type)], schema=kind)


def nearest_reference(rows: DataFrame, references: DataFrame, id_: str, vector: str, ref_id: str, threshold: float) -> DataFrame:
    """C14: ``id``, ``ref_id`` and ``similarity``: for each row the most similar reference, if at least ``threshold``; ties
    go to the smaller reference id.

    Exact. References lie in cells around pivots. A row meets the cell of its nearest pivot, then every cell whose pivot's
    angle less the cell's radius is no larger than the best angle so far, or than the threshold's. Both sides of a cell are
    dealt where they are many; on the driver are the pivots, a radius and two numbers for each of them. Zero and null
    vectors, and those of a length that no reference has, match nothing. Ids of rows must be unique.
    """
    spark = rows.sparkSession
    ship_package(spark)
    r = stored(references.select(F.col(ref_id).alias("ref_id"), unit(vector).alias("u")).where("u is not null").withColumn("n", F.size("u")), "references")
    q = stored(rows.select(F.col(id_).alias("id"), unit(vector).alias("u")).where("u is not null").withColumn("n", F.size("u")), "rows")
    sizes = dict(map(tuple, r.groupBy("n").agg(F.count("*")).collect()))
    pivots: dict[int, np.ndarray] = {}
    for n, total in sizes.items():
        k = min(PIVOTS, total // CELL)
        if k > 1:
            every = max(1, total // (SAMPLE * k))
            sample = r.where((F.col("n") == n) & (F.pmod(F.xxhash64("ref_id", F.lit(1)), F.lit(every)) == 0)).select("u").limit(4 * SAMPLE * k).toArrow()
            if sample.num_rows:
                pivots[n] = pivots_of(_matrix(sample.column("u"), n), k)
    shared = spark.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            cell, far = np.zeros(len(n), np.int64), np.zeros(len(n))
            for width in np.unique(n).tolist():
                if width in shared.value:
                    at = np.flatnonzero(n == width)
                    cell[at], far[at] = nearest_pivot(_matrix(batch.column("u").take(pa.array(at)), width), shared.value[width])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    placed = lambda df: df.mapInArrow(place, df.select("*").schema.add("cell", "long").add("far", "double"))
    held = stored(placed(r), "references") if pivots else r.withColumns({"cell": F.lit(0).cast("long"), "far": F.lit(0.0)})
    cells = {(n, cell): (far, k) for n, cell, far, k in held.groupBy("n", "cell").agg(F.max("far"), F.count("*")).collect()}
    split = spark.createDataFrame([(n, c, -(-k // REFERENCES)) for (n, c), (_, k) in cells.items()], "n int, cell long, rparts long")
    kind, ref_kind = dict(q.dtypes)["id"], dict(r.dtypes)["ref_id"]
    schema = f"id {kind}, similarity double, ref_id {ref_kind}"

    def met(asked: DataFrame) -> DataFrame:
        """The best of one cell for rows (id, u, n, cell)."""
        asked = stored(asked.select("id", "u", "n", "cell"), "asked")
        many = asked.groupBy("n", "cell").agg((F.floor(F.count("*") / ROWS) + 1).alias("qparts")).join(F.broadcast(split), ["n", "cell"])  # a row a cell
        many = F.broadcast(stored(many, "parts"))
        part = lambda c, by: F.pmod(F.xxhash64(c, F.lit(5)), by)
        each = lambda by: F.explode(F.sequence(F.lit(0).cast("long"), F.col(by) - 1))
        left = asked.join(many, ["n", "cell"]).withColumn("i", part("id", F.col("qparts"))).withColumn("j", each("rparts")).select("n", "cell", "i", "j", "id", "u")
        right = held.join(many, ["n", "cell"]).withColumn("j", part("ref_id", F.col("rparts"))).withColumn("i", each("qparts")).select("n", "cell", "i", "j", "ref_id", "u")
        keys = ["n", "cell", "i", "j"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_best_in, schema)

    def best(found: DataFrame) -> DataFrame:
        # the smallest id of those with the largest similarity, whatever the type of an id
        top = found.groupBy("id").agg(F.max("similarity").alias("s"), F.collect_list(F.struct("similarity", "ref_id")).alias("all"))
        return top.select("id", F.array_min(F.transform(F.filter("all", lambda x: x.similarity == F.col("s")), lambda x: x.ref_id)).alias("ref_id"), F.col("s").alias("similarity"))

    if not pivots:
        return best(met(q.withColumn("cell", F.lit(0).cast("long")))).where(F.col("similarity") >= threshold)
    first = stored(best(met(placed(q))), "nearest-in-cell")
    radii = spark.sparkContext.broadcast({n: np.array([cells.get((n, c), (-9.0, 0))[0] for c in range(len(p))]) for n, p in pivots.items()})

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, row, cell = batch.column("n").to_numpy(), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            reach = np.arccos(np.clip(np.maximum(batch.column("similarity").fill_null(-1.0).to_numpy(zero_copy_only=False), threshold), -1, 1)) + SLACK
            for width in np.unique(n).tolist():
                if width in radii.value:
                    at = np.flatnonzero(n == width)
                    near, bound = reach[at], radii.value[width]
                    p, c = pivots_within(_matrix(batch.column("u").take(pa.array(at)), width), shared.value[width], lambda k, near=near, bound=bound: near[k, None] + bound, True)
                    row.append(at[p])
                    cell.append(c)
            rows, cells_ = np.concatenate(row), np.concatenate(cell)
            for k in range(0, len(rows), GATHER):  # a row is given for each of its cells, which may be all
                take = pa.array(rows[k : k + GATHER])
                yield pa.RecordBatch.from_arrays([*(batch.column(x).take(take) for x in ("id", "u", "n")), pa.array(cells_[k : k + GATHER])], names=["id", "u", "n", "cell"])

    again = q.join(first.select("id", "similarity"), "id", "left").select("id", "u", "n", "similarity").mapInArrow(others, f"id {kind}, u array<double>, n int, cell long")
    return best(first.select("id", "similarity", "ref_id").union(met(again))).where(F.col("similarity") >= threshold)
