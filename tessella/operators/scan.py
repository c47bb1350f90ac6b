"""Scans of ordered rows that go on from one range of rows to the next, so that one folder may fill many tasks: pairs
within a window of time, and bursts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.media import max_distance
from tessella.operators.hamming import along, groups
from tessella.scratch import ship_package, stored


def _differing(a: tuple[int, int], b: tuple[int, int]) -> int:
    return int(a[0] ^ b[0]).bit_count() + int(a[1] ^ b[1]).bit_count()


def window_pairs(rows: DataFrame, key: Sequence[str], at: str, id_: str, width: float, carry: Sequence[str] = ()) -> DataFrame:
    """C11: pairs ``left_id``, ``right_id`` of rows of one key of which the second is 0 to ``width`` later (at equal
    times, has the larger id), with ``t1`` and ``t2``. Columns in ``carry`` come along, as l_ and r_ ones.

    Rows are sorted by key and time over ranges; a range also gets the last window of the rows before it, as far as they
    are of its first key. A task compares a row with those that follow it, until one is too late: only pairs that are
    given are made. The first row of each range is on the driver. Rows without key, time or id are in no pair.
    """
    ship_package(rows.sparkSession)
    order = [*key, at, id_]
    given = rows.select(*order, *carry).dropna(subset=order)
    held = stored(given.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    firsts = sorted((r["__part"], tuple(r["f"])) for r in held.groupBy("__part").agg(F.min(F.struct(*key, at)).alias("f")).collect())

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = {part: k for k, (part, _) in enumerate(firsts)}
        for batch in batches:
            part = batch.column("__part").to_numpy()
            row, to = [np.arange(len(part))], [part]
            own = [np.array(batch.column(c).to_pylist(), object) for c in key]
            times = batch.column(at).to_numpy(zero_copy_only=False)
            for p in np.unique(part).tolist():
                for q, first in firsts[places[p] + 1 :]:
                    late = (part == p) & (times + width >= first[-1])
                    for c, v in zip(own, first, strict=False):
                        late &= c == v
                    if not late.any():
                        break
                    row.append(np.flatnonzero(late))
                    to.append(np.full(len(row[-1]), q))
            taken, target = np.concatenate(row), np.concatenate(to)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(taken)) for c in batch.schema.names), pa.array(target.astype(np.int32)), pa.array(np.arange(len(taken)) >= len(part))], names=[*batch.schema.names, "__to", "__guest"])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in groups(batches, ["__to", *key]):
            times, guest = t.column(at).to_numpy(), t.column("__guest").to_numpy(zero_copy_only=False)

            def near(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                soon = times[b] - times[a] <= width
                return ~(guest[a[soon]] & guest[b[soon]]), a[soon]

            for a, b in along(group, near):
                left, right = t.take(pa.array(a)), t.take(pa.array(b))
                columns = [*(left.column(c) for c in (*key, at, id_, *carry)), *(right.column(c) for c in (at, id_, *carry))]
                yield from pa.table([c.combine_chunks() for c in columns], names=names).to_batches()

    names = [*key, "t1", "left_id", *(f"l_{c}" for c in carry), "t2", "right_id", *(f"r_{c}" for c in carry)]
    kinds = dict(given.dtypes)
    schema = ", ".join(f"`{n}` {kinds[c]}" for n, c in zip(names, [*key, at, id_, *carry, at, id_, *carry], strict=True))
    spreaded = held.mapInArrow(spread, held.select("*", F.lit(0).alias("__to"), F.lit(True).alias("__guest")).schema)
    return spreaded.repartition("__to").sortWithinPartitions("__to", *order).mapInArrow(sweep, schema)


def chain_bursts(rows: DataFrame, gap: float, similarity: float | None = None, pattern: str | None = None) -> DataFrame:
    """Rows (folder, at, id, hi, lo, name) with ``burst``, the id of the first of their chain, and
    ``burst_size``. A row continues the chain of the one before it in its folder where it is at most ``gap`` seconds
    later and both names match ``pattern`` or their hashes are similar; without both, the gap alone decides.

    Rows are sorted over ranges, whatever their folder. A task finds the chains of its range; whether its first chain goes
    on from the range before, and which it is then, follows from the first and the last row of each range, on the driver.
    Null times, hashes and names continue nothing.
    """
    ship_package(rows.sparkSession)
    order = ["folder", "at", "id"]
    named = F.coalesce(F.lower(F.col("name")).rlike(pattern), F.lit(False)) if pattern is not None else F.lit(False)
    given = rows.withColumn("__named", named)
    plain = similarity is None and pattern is None
    bits = None if similarity is None else [d for d in range(65) if (64 - d) / 64.0 >= similarity]
    far = -1 if not bits else bits[-1]

    def goes_on(before: tuple, row: tuple) -> bool:
        """Of (folder, at, hi, lo, named)."""
        if before[0] != row[0] or before[1] is None or row[1] is None or row[1] - before[1] > gap:
            return False
        alike = far >= 0 and None not in (*before[2:4], *row[2:4]) and _differing(before[2:4], row[2:4]) <= far
        return plain or alike or (before[4] and row[4])

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before, start, open_ = TaskContext.get().partitionId(), None, None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(c) for c in ("folder", "at", *(("hi", "lo") if far >= 0 else ()), "__named")]
            if far < 0:
                own[2:2] = [pa.nulls(batch.num_rows)] * 2
            n = batch.num_rows
            new = np.ones(n, bool)
            first = tuple(c[0].as_py() for c in own)
            if before is not None:
                new[0] = not goes_on(before, first)
            if n > 1:
                same = pc.fill_null(pc.or_kleene(pc.equal(own[0][1:], own[0][:-1]), pc.and_(own[0][1:].is_null(), own[0][:-1].is_null())), False)
                near = pc.fill_null(pc.less_equal(pc.subtract(own[1][1:], own[1][:-1]), gap), False)
                alike = np.full(n - 1, plain)
                if far >= 0:
                    known = ~(own[2].is_null().to_numpy(zero_copy_only=False) | own[3].is_null().to_numpy(zero_copy_only=False))
                    hi, lo = (c.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64) for c in own[2:4])
                    alike |= known[1:] & known[:-1] & (np.bitwise_count(hi[1:] ^ hi[:-1]) + np.bitwise_count(lo[1:] ^ lo[:-1]) <= far)
                marked = own[4].to_numpy(zero_copy_only=False).astype(bool)
                alike |= marked[1:] & marked[:-1]
                new[1:] = ~(same.to_numpy(zero_copy_only=False).astype(bool) & near.to_numpy(zero_copy_only=False).astype(bool) & alike)
            at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            ids = batch.column("id")
            starts = ids.take(pa.array(np.maximum(at, 0)))
            if at[0] < 0:  # the chain of the batch before goes on
                held = int(np.searchsorted(at, 0))
                starts = pa.concat_arrays([pa.array([start] * held, ids.type), starts[held:]])
            fresh = np.cumsum(new) - (before is None)  # the part's first row begins no chain for certain
            opens = (fresh == 0) & open_
            open_ = bool(opens[-1])
            before, start = tuple(c[n - 1].as_py() for c in own), starts[n - 1].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part)), starts, pa.array(opens)], names=[*batch.schema.names, "__part", "__start", "__open"])

    kind = given.select("*", F.lit(0).cast("long").alias("__part"), F.col("id").alias("__start"), F.lit(True).alias("__open")).schema
    found = stored(given.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(chains, kind), "chains")
    row = F.struct(*order, *(["hi", "lo"] if far >= 0 else [F.lit(0).alias("hi"), F.lit(0).alias("lo")]), "__named", "__start", "__open")
    ends = found.groupBy("__part").agg(F.min(row).alias("first"), F.max(row).alias("last")).collect()  # two rows a range
    entry, before, start = [], None, None
    for r in sorted(ends, key=lambda r: r["__part"]):
        first, last = r["first"], r["last"]
        on = before is not None and goes_on(before, tuple(first[c] for c in ("folder", "at", "hi", "lo", "__named")))
        if on:
            entry.append((r["__part"], start))
        if not (on and last["__open"]):
            start = last["__start"]
        before = tuple(last[c] for c in ("folder", "at", "hi", "lo", "__named"))
    carried = F.broadcast(rows.sparkSession.createDataFrame(entry, f"__part long, __entry {dict(rows.dtypes)['id']}"))
    out = found.join(carried, "__part", "left").withColumn("burst", F.when(F.col("__open"), F.coalesce("__entry", "__start")).otherwise(F.col("__start")))
    out = out.drop("__named", "__part", "__start", "__open", "__entry")
    return out.join(out.groupBy("burst").agg(F.count("*").alias("burst_size")), "burst")


def anchored_bursts(files: DataFrame, window: float, similarity: float) -> DataFrame:
    """``series`` for rows (folder, at, file_path, hi, lo): a row joins the running series where it is
    within ``window`` seconds of the series' first row and close to it, else it begins one.

    Rows are sorted over ranges, whatever their folder, and each range is folded as if a series began with its first row.
    Where the last series of the range before takes that row in, the range is folded again from there, and so on while
    what a range leaves open changes; in most data series soon begin at the same rows again, and one round is enough.
    What a range leaves open is one row, on the driver.
    """
    ship_package(files.sparkSession)
    far = max_distance(similarity)
    order = ["folder", "at", "file_path"]
    names = [*order, "hi", "lo", "part", "a_at", "a_hi", "a_lo", "series"]
    kinds = dict(files.dtypes)
    base = files.select(*order, "hi", "lo")
    schema = ", ".join([f"{c} {kinds[c]}" for c in (*order, "hi", "lo")] + ["part long", f"a_at {kinds['at']}", f"a_hi {kinds['hi']}", f"a_lo {kinds['lo']}", f"series {kinds['file_path']}"])

    def takes(state: tuple, folder: Any, at: Any, hi: int, lo: int) -> bool:
        """State: folder, and the anchor's time, hash and path."""
        return state[0] == folder and at - state[1] <= window and _differing((hi, lo), state[2:4]) <= far

    def folded(batches: Iterator[pa.RecordBatch], entries: dict[int, tuple] | None) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        now, state = None, None
        for batch in batches:
            anchors: list[tuple] = []
            parts = batch.column("part").to_pylist() if entries is not None else [TaskContext.get().partitionId()] * batch.num_rows
            for part, folder, at, path, hi, lo in zip(parts, *(batch.column(c).to_pylist() for c in (*order, "hi", "lo")), strict=True):
                if part != now:
                    now, state = part, (entries or {}).get(part)
                if state is None or not takes(state, folder, at, hi, lo):
                    state = (folder, at, hi, lo, path)
                anchors.append(state[1:])
            held = [pa.array([a[k] for a in anchors], batch.column(c).type) for k, c in enumerate(("at", "hi", "lo", "file_path"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*order, "hi", "lo")), pa.array(parts, pa.int64()), *held], names=names)

    found = stored(base.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda b: folded(b, None), schema), "series")
    whole = F.struct(*order, "hi", "lo", "a_at", "a_hi", "a_lo", "series")
    ends = {r["part"]: (r["first"], r["last"]) for r in found.groupBy("part").agg(F.min(whole).alias("first"), F.max(whole).alias("last")).collect()}
    parts = sorted(ends)
    left_open = {p: tuple(ends[p][1][c] for c in ("folder", "a_at", "a_hi", "a_lo", "series")) for p in parts}
    version, used, tables = dict.fromkeys(parts, 0), dict.fromkeys(parts), [found]
    while True:
        entries = {}
        for before, p in zip(parts, parts[1:], strict=False):
            first, state = ends[p][0], left_open[before]
            state = state if takes(state, first["folder"], first["at"], first["hi"], first["lo"]) else None
            if state != used[p]:
                entries[p] = used[p] = state
        if not entries:
            break
        some = F.broadcast(files.sparkSession.createDataFrame([(p,) for p in entries], "part long"))
        again = found.select(*order, "hi", "lo", "part").join(some, "part").repartition("part").sortWithinPartitions("part", *order)
        table = stored(again.select(*order, "hi", "lo", "part").mapInArrow(lambda b, e=dict(entries): folded(b, e), schema), "series")
        for p, last in table.groupBy("part").agg(F.max(whole)).collect():
            left_open[p] = tuple(last[c] for c in ("folder", "a_at", "a_hi", "a_lo", "series"))
        tables.append(table)
        version |= dict.fromkeys(entries, len(tables) - 1)
    if len(tables) == 1:
        return found.select("file_path", "series")
    newest = F.broadcast(files.sparkSession.createDataFrame(list(version.items()), "part long, v int"))
    every = tables[0].withColumn("v", F.lit(0))
    for k, t in enumerate(tables[1:], 1):
        every = every.unionByName(t.withColumn("v", F.lit(k)))
    return every.join(newest, ["part", "v"]).select("file_path", "series")
