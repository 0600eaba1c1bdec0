"""Embedding near-duplicates by NN-descent (operator 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewright.llm.common import Stash, connected_components
from candlewright.llm.vectors import clean_vectors, stack

GRAPH = "id long, nbr long, sim double"
#: Hyperplanes that cut a component: up to 2 ** PLANES cells.
PLANES = 24


def _classes(vectors: DataFrame, stash: Stash) -> tuple[DataFrame, DataFrame, int]:
    """Vectors of equal components as one class: (vec_id, id), (id, weight, unit as binary doubles), width."""
    wide = vectors.agg(F.max(F.size("x"))).first()[0] or 1
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    some = stash.put(vectors.where(F.exists("x", lambda v: v != 0)), "vectors")
    names = stash.put(some.groupBy("x").agg(F.min("vec_id").alias("id")), "names")  # a table, so that Spark can split a hot vector's rows in the join
    members = stash.put(some.join(names, "x").select("vec_id", "id"), "members")

    def task(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x = stack(batch.column(2), wide)
            x /= np.abs(x).max(axis=1, keepdims=True)  # lengths of very large or small vectors stay finite
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            unit = [v.astype("<f8").tobytes() for v in x]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(unit, pa.binary())], names=["id", "weight", "unit"])

    weights = members.groupBy("id").agg(F.count("*").alias("weight"))
    units = weights.join(some.withColumnRenamed("vec_id", "id"), "id").select("id", "weight", "x").mapInArrow(task, "id long, weight long, unit binary")
    return members, stash.put(units, "units"), wide


def _tree(units: DataFrame, wide: int, seed: int, depth: int, k: int, block: int) -> DataFrame:
    """First lists: each vector's k nearest in its leaf of a random-hyperplane tree.

    Leaves are runs of equal sign codes in a range order of (code, hash), so a leaf of any size spreads over ranges;
    runs longer than `block` are compared block by block.
    """

    def code(batches):
        import numpy as np
        import pyarrow as pa

        planes = np.random.default_rng(seed).standard_normal((wide, depth))
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<f8").reshape(-1, wide)
            bits = ((x @ planes) > 0) @ (1 << np.arange(depth, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits.astype(np.int64))], names=["id", "unit", "code"])

    def leaf(batches):
        import numpy as np
        import pyarrow as pa

        ids, xs, codes = [], [], []

        def near():
            x = np.frombuffer(b"".join(xs), dtype="<f8").reshape(-1, wide).astype(np.float32)
            s = x @ x.T
            s[np.asarray(codes)[:, None] != np.asarray(codes)] -= 2  # a short leaf sees its neighbours in the order too, but its own come first
            np.fill_diagonal(s, -9)
            m = min(k, len(ids) - 1)
            if m > 0:
                at = np.argpartition(-s, m - 1, axis=1)[:, :m]
                a, b = np.repeat(ids, m), np.asarray(ids)[at.reshape(-1)]
                dot = np.take_along_axis(x @ x.T, at, axis=1).reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(dot.astype(np.float64))], names=["id", "nbr", "sim"])

        for batch in batches:
            for i, u, c in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
                ids.append(i)
                xs.append(u)
                codes.append(c)
                if len(ids) == block:
                    yield from near()
                    ids, xs, codes = [], [], []
        if ids:
            yield from near()

    coded = units.select("id", "unit").mapInArrow(code, "id long, unit binary, code long")
    ranged = coded.repartitionByRange("code", F.xxhash64("id", F.lit(seed))).sortWithinPartitions("code", F.xxhash64("id", F.lit(seed)))
    return ranged.mapInArrow(leaf, GRAPH)


def _best(edges: DataFrame, lists: DataFrame | None, k: int) -> DataFrame:
    """Each id's nearest distinct neighbours: as many as its list allows (k, or 4k where it was enlarged); ties go to the
    smaller neighbour. What is over 4k is cut before rows meet, so a hub's candidates never stand in one row or task."""
    own = edges.groupBy("id", "nbr").agg(F.max("sim").alias("sim"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "nbr"))
    if lists is None:
        return own.withColumn("place", place).where(F.col("place") <= k).select("id", "nbr", "sim", F.lit(k).alias("room"))
    few = own.withColumn("place", place).where(F.col("place") <= 4 * k)
    return few.join(lists, "id", "left").withColumn("room", F.coalesce("room", F.lit(k))).where("place <= room").select("id", "nbr", "sim", "room")


def _descend(graph: DataFrame, units: DataFrame, wide: int, k: int, turn: int) -> DataFrame:
    """One local join: at each vector its neighbours, forward and reverse, meet, and learn of each other.

    At most 2k neighbours of a vector meet in a turn, chosen anew by hash each time; each keeps the k best it met.
    """

    def meet(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            a, b, c = [], [], []
            for row in batch.column(0).to_pylist():
                if len(row) < 2:
                    continue
                ids = np.array([r["nbr"] for r in row])
                x = np.frombuffer(b"".join(r["unit"] for r in row), dtype="<f8").reshape(-1, wide).astype(np.float32)
                s = x @ x.T
                np.fill_diagonal(s, -9)
                m = min(k, len(ids) - 1)
                at = np.argpartition(-s, m - 1, axis=1)[:, :m]
                a.append(np.repeat(ids, m))
                b.append(ids[at.reshape(-1)])
                c.append(np.take_along_axis(s, at, axis=1).reshape(-1))
            empty = [np.zeros(0)]
            a, b, c = (np.concatenate(v or empty) for v in (a, b, c))
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(c.astype(np.float64))], names=["id", "nbr", "sim"])

    both = graph.select("id", "nbr").unionByName(graph.select(F.col("nbr").alias("id"), F.col("id").alias("nbr"))).distinct()
    # a reverse list may hold any number of vectors; its rows are numbered by a salted hash in two steps, so no task sorts a hub's whole list
    salted = both.withColumn("h", F.xxhash64("id", "nbr", F.lit(turn)))
    few = salted.groupBy("id", F.pmod("h", F.lit(64)).alias("salt")).agg(F.min(F.struct("h", "nbr")).alias("one"))
    chosen = few.groupBy("id").agg(F.slice(F.sort_array(F.collect_list("one")), 1, 2 * k).alias("some"))
    met = chosen.select("id", F.explode("some.nbr").alias("nbr")).join(units.select(F.col("id").alias("nbr"), "unit"), "nbr")
    return met.groupBy("id").agg(F.collect_list(F.struct("nbr", "unit")).alias("met")).select("met").mapInArrow(meet, GRAPH)


def _around(placed: DataFrame, wide: int, stash: Stash) -> tuple[DataFrame, DataFrame]:
    """Centres of components (component, centre), and placed with each vector's angle to its centre (radius)."""

    def partial(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<f8").reshape(-1, wide)
            name, at = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            total = np.zeros((len(name), wide))
            np.add.at(total, at, x)
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array([t.tolist() for t in total], pa.list_(pa.float64()))], names=["component", "part"])

    sums = placed.select("component", "unit").mapInArrow(partial, "component long, part array<double>")
    sums = sums.select("component", F.posexplode("part").alias("d", "v")).groupBy("component", "d").agg(F.sum("v").alias("v")).groupBy("component").agg(F.sort_array(F.collect_list(F.struct("d", "v"))).alias("c")).select("component", F.col("c.v").alias("centre"))

    sums = stash.put(sums, "centres")  # a table, so that Spark can split a hot component's rows in the join

    def radius(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype="<f8").reshape(-1, wide)
            c = np.array(batch.column(4).to_pylist(), dtype=float).reshape(-1, wide)
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
            r = np.arccos(np.clip((x * c).sum(axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in range(4)), pa.array(r)], names=["component", "id", "weight", "unit", "radius"])

    away = stash.put(placed.join(sums, "component").select("component", "id", "weight", "unit", "centre").mapInArrow(radius, "component long, id long, weight long, unit binary, radius double"), "radius")
    return sums, away


def _within(units: DataFrame, labels: DataFrame, threshold: float, wide: int, stash: Stash, block: int = 512) -> DataFrame:
    """Links of each vector within its component, counted exactly in double precision: id, links (weighted).

    Components are compared with their centre first. If every member is within half the threshold's angle of the
    centre, all pairs are links and none is computed. The others are cut into cells by hyperplanes through their own
    centre, and cells into blocks, each with its centre and radius. Of two blocks of a component, compared as balls in
    packs, either no pair can be a link, or all are, which is counted by weight alone, or the blocks meet: once, and both
    sides' links are counted. So vectors travel only where blocks lie at the threshold from each other.
    """
    placed = stash.put(labels.join(units, "id").select("component", "id", "weight", "unit"), "placed")
    centres, away = _around(placed, wide, stash)
    sizes = away.groupBy("component").agg(F.max("radius").alias("r"), F.sum("weight").alias("w"), F.count("*").alias("m"))
    tight = 2 * F.col("r") <= F.acos(F.lit(threshold)) - 1e-6
    depth = F.greatest(F.lit(0), F.ceil(F.log2(F.col("m") / block))).cast("int")
    sizes = stash.put(sizes.select("component", "w", "m", tight.alias("tight"), F.least(depth, F.lit(PLANES)).alias("depth")), "sizes")
    sure = away.join(sizes.where("tight"), "component").select("id", (F.col("w") - F.col("weight")).alias("links"))
    blocks = _cells(away.join(sizes.where("not tight").select("component", "depth"), "component"), centres, wide, stash, block)

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        edge = np.arccos(threshold)
        for batch in batches:
            a, b, gain = [], [], []
            for left, right, same in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
                (p, x, r, v), (q, y, t, w) = ((np.array([e["block"] for e in side]), np.array([np.frombuffer(e["centre"], dtype="<f8") for e in side]), np.array([e["r"] for e in side]), np.array([e["w"] for e in side])) for side in (left, right))
                angle, reach = np.arccos(np.clip(x @ y.T, -1, 1)), r[:, None] + t
                pair = p[:, None] < q if same else np.ones((len(p), len(q)), dtype=bool)
                whole = pair & (angle + reach <= edge - 1e-6)
                i, j = np.nonzero(pair & ~whole & (angle - reach <= edge + 1e-6))
                a += [p[i], p[whole.any(axis=1)], q[whole.any(axis=0)]]
                b += [q[j], np.full(whole.any(axis=1).sum(), -1), np.full(whole.any(axis=0).sum(), -1)]
                gain += [np.zeros(len(i), np.int64), (whole @ w)[whole.any(axis=1)], (v @ whole)[whole.any(axis=0)]]
                if same:
                    a, b, gain = [*a, p], [*b, p], [*gain, np.zeros(len(p), np.int64)]
            columns = [np.concatenate(c or [np.zeros(0)]).astype(np.int64) for c in (a, b, gain)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "gain"])

    def count(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids, links = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for left, right, same in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
                (p, v, x), (q, w, y) = ((np.array([e["id"] for e in side]), np.array([e["weight"] for e in side]), np.frombuffer(b"".join(e["unit"] for e in side), dtype="<f8").reshape(-1, wide)) for side in (left, right))
                near = (x @ y.T >= threshold) & (p[:, None] != q)
                ids.append(p)
                links.append(near @ w)
                if not same:
                    ids.append(q)
                    links.append(v @ near)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(links))], names=["id", "links"])

    packs = blocks.groupBy("component").agg(F.ceil(F.count("*") / 512).cast("int").alias("packs"))
    balls = blocks.join(packs, "component").select("component", "packs", F.pmod(F.xxhash64("block"), F.col("packs")).cast("int").alias("pack"), F.struct("block", "centre", "r", "w").alias("ball"))
    dealt = stash.put(balls.groupBy("component", "pack", "packs").agg(F.collect_list("ball").alias("balls")), "packs")
    work = dealt.select("component", F.col("pack").alias("own"), F.col("balls").alias("left"), F.explode(F.sequence("pack", F.col("packs") - 1)).alias("pack"))
    work = work.join(dealt.select("component", "pack", F.col("balls").alias("right")), ["component", "pack"]).select("left", "right", (F.col("own") == F.col("pack")).alias("same"))
    pairs = stash.put(work.mapInArrow(compare, "a long, b long, gain long"), "block-pairs", arrow_rows=4)
    side = lambda c, rows: blocks.select(F.col("block").alias(c), F.col("rows").alias(rows))
    met = pairs.where("b >= 0").join(side("a", "left"), "a").join(side("b", "right"), "b").select("left", "right", (F.col("a") == F.col("b")).alias("same"))
    counted = stash.put(met.mapInArrow(count, "id long, links long"), "counted", arrow_rows=8)
    gains = pairs.where("b < 0").groupBy(F.col("a").alias("block")).agg(F.sum("gain").alias("links"))
    whole = gains.join(blocks.select("block", F.col("rows.id").alias("ids")), "block").select(F.explode("ids").alias("id"), "links")
    return sure.unionByName(counted.unionByName(whole).groupBy("id").agg(F.sum("links").alias("links")))


def _cells(loose: DataFrame, centres: DataFrame, wide: int, stash: Stash, block: int) -> DataFrame:
    """Blocks of some `block` near members of a component: component, block (a number), rows (id, weight, unit), their
    centre, radius and weight. loose: component, depth (bits of the cell code in use), id, weight, unit."""

    def code(batches):
        import numpy as np
        import pyarrow as pa

        planes = np.random.default_rng(23).standard_normal((wide, PLANES))
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype="<f8").reshape(-1, wide)
            c = np.array(batch.column(5).to_pylist(), dtype=float).reshape(-1, wide)
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
            bits = ((x - c) @ planes > 0) & (np.arange(PLANES) < batch.column(1).to_numpy()[:, None])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(j) for j in (2, 3, 4)), pa.array(bits @ (1 << np.arange(PLANES, dtype=np.int64)))], names=["component", "id", "weight", "unit", "cell"])

    def ball(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            centre, radius, weight = [], [], []
            for rows in batch.column(1).to_pylist():
                x = np.frombuffer(b"".join(r["unit"] for r in rows), dtype="<f8").reshape(-1, wide)
                c = x.mean(axis=0)
                c /= max(np.linalg.norm(c), 1e-300)
                centre.append(c.astype("<f8").tobytes())
                radius.append(float(np.arccos(np.clip(x @ c, -1, 1)).max()))
                weight.append(sum(r["weight"] for r in rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(centre, pa.binary()), pa.array(radius, pa.float64()), pa.array(weight, pa.int64())], names=["component", "rows", "centre", "r", "w"])

    coded = loose.join(centres, "component").select("component", "depth", "id", "weight", "unit", "centre").mapInArrow(code, "component long, id long, weight long, unit binary, cell long")
    coded = stash.put(coded, "cells")
    full = stash.put(coded.groupBy("component", "cell").agg(F.ceil(F.count("*") / (2 * block)).cast("int").alias("parts")), "full")
    parted = coded.join(full, ["component", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    rows = parted.groupBy("component", "cell", "part").agg(F.collect_list(F.struct("id", "weight", "unit")).alias("rows")).select("component", "rows")
    balls = rows.mapInArrow(ball, "component long, rows array<struct<id:long,weight:long,unit:binary>>, centre binary, r double, w long")
    return stash.put(balls.withColumn("block", F.monotonically_increasing_id()), "blocks", arrow_rows=16)


def _bridges(graph: DataFrame, labels: DataFrame, units: DataFrame, threshold: float, wide: int, stash: Stash, block: int = 512, pack: int = 1024) -> DataFrame:
    """labels, with components joined that a link of two saturated vectors joins, whether or not a list holds it; exact.

    A saturated list may be filled by its own component. Each component's saturated vectors lie in a ball; of all
    pairs of balls, compared in packs, those go on that are near enough for a link. One block of members of either
    side is compared first, which joins most of what overlaps. Pairs that are still apart are compared whole, block by
    block; a pair of blocks yields one row at most.
    """
    full = graph.groupBy("id").agg(F.min("sim").alias("last"), F.count("*").alias("c"), F.max("room").alias("room")).where((F.col("last") >= threshold - 1e-4) & (F.col("c") >= F.col("room")))
    placed = stash.put(full.select("id").join(labels, "id", "left").join(units, "id").select(F.coalesce("component", "id").alias("component"), "id", "weight", "unit"), "saturated")
    if len(placed.select("component").distinct().limit(2).collect()) < 2:
        return labels
    centres, away = _around(placed, wide, stash)
    balls = away.groupBy("component").agg(F.max("radius").alias("r"), F.ceil(F.count("*") / block).cast("int").alias("n"))
    balls = stash.put(balls.join(centres, "component"), "balls")
    packs = -(-balls.count() // pack)

    def reach(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for left, right, same in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
                (a, x, p), (b, y, q) = ((np.array([r["component"] for r in side]), np.array([r["centre"] for r in side]), np.array([r["r"] for r in side])) for side in (left, right))
                x, y = (c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300) for c in (x, y))
                near = np.arccos(np.clip(x @ y.T, -1, 1)) <= p[:, None] + q + np.arccos(threshold) + 1e-6
                if same:
                    near &= a[:, None] < b
                i, j = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([pa.array(a[i], pa.int64()), pa.array(b[j], pa.int64())], names=["a", "b"])

    def touch(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keep = []
            for sides in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = (np.frombuffer(b"".join(side), dtype="<f8").reshape(-1, wide) for side in sides)
                keep.append(bool((x @ y.T >= threshold).any()))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    dealt = stash.put(balls.withColumn("pack", F.pmod(F.xxhash64("component"), F.lit(packs)).cast("int")).groupBy("pack").agg(F.collect_list(F.struct("component", "centre", "r")).alias("balls")), "packs", arrow_rows=1)
    work = dealt.select(F.col("pack").alias("own"), F.col("balls").alias("left"), F.explode(F.sequence("pack", F.lit(packs - 1))).alias("pack"))
    work = work.join(dealt.withColumnRenamed("balls", "right"), "pack").select("left", "right", (F.col("own") == F.col("pack")).alias("same"))
    pairs = stash.put(work.mapInArrow(reach, "a long, b long"), "ball-pairs", arrow_rows=1)
    blocks = away.join(balls.select("component", "n"), "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    blocks = stash.put(blocks.groupBy("component", "block").agg(F.collect_list("unit").alias("rows")), "saturated-blocks")
    side = lambda rows, c: rows.select(F.col("component").alias(c), F.col("rows").alias(f"rows_{c}"))
    joined = None
    for some in (blocks.where("block = 0"), blocks):
        if joined is not None:
            to = lambda c: joined.select(F.col("id").alias(c), F.col("component").alias(f"to_{c}"))
            pairs = pairs.join(to("a"), "a", "left").join(to("b"), "b", "left").where(F.coalesce("to_a", "a") != F.coalesce("to_b", "b")).select("a", "b")
        met = pairs.join(side(some, "a"), "a").join(side(some, "b"), "b").select("a", "b", "rows_a", "rows_b").mapInArrow(touch, "a long, b long")
        met = stash.put(met.distinct(), "bridges", arrow_rows=32)
        found = met if joined is None else found.unionByName(met)
        joined = connected_components(found, stash)
    up = joined.select(F.col("id").alias("component"), F.col("component").alias("to"))
    # a saturated vector whose edges all fall short in double precision has no label yet
    known = labels.unionByName(joined.select("id", F.col("id").alias("component")).join(labels, "id", "left_anti"))
    return stash.put(known.join(up, "component", "left").select("id", F.coalesce("to", "component").alias("component")), "bridged")


def audit(units: DataFrame, labels: DataFrame, threshold: float, wide: int, sample: int) -> tuple[int, int]:
    """Links that a sample of at most `sample` vectors, the smallest by hash, has among all, and those within components."""
    import numpy as np

    picked = units.join(labels, "id", "left").orderBy(F.xxhash64("id", F.lit(11))).limit(sample).select("id", "unit", F.coalesce("component", "id").alias("component")).collect()
    if not picked:
        return 0, 0
    asked = np.frombuffer(b"".join(r.unit for r in picked), dtype="<f8").reshape(-1, wide)
    ids, comps = np.array([r.id for r in picked]), np.array([r.component for r in picked])
    shared = units.sparkSession.sparkContext.broadcast((asked, ids, comps))

    def scan(batches):
        import numpy as np
        import pyarrow as pa

        asked, ids, comps = shared.value
        total = found = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                some = batch.slice(lo, 2000)
                x = np.frombuffer(b"".join(some.column(1).to_pylist()), dtype="<f8").reshape(-1, wide)
                hit = (asked @ x.T >= threshold) & (ids[:, None] != some.column(0).to_numpy())
                total += int(hit.sum())
                found += int((hit & (comps[:, None] == some.column(2).to_numpy())).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([found])], names=["total", "found"])

    row = units.join(labels, "id", "left").select("id", "unit", F.coalesce("component", "id").alias("component")).mapInArrow(scan, "total long, found long").agg(F.sum("total"), F.sum("found")).first()
    return row[0] or 0, row[1] or 0


def near_vectors(table: DataFrame, stash: Stash, threshold: float = 0.95, k: int = 10, trees: int = 4, block: int = 256, recall: float = 0.99, sample: int = 512, rounds: int = 12, seed: int = 5) -> DataFrame:
    """Link vectors with cosine >= threshold, in double precision, by NN-descent.

    table: vec_id long, embedding array. Returns vec_id, n_links (other vectors linked), component_id (smallest vec_id
    reachable), kept (vec_id = component_id), one row for each non-null vec_id.

    Equal vectors form one class. Lists of k neighbours start from random-hyperplane trees and are refined by local
    joins of neighbours' neighbours. A list whose last entry is still at the threshold is saturated: it is enlarged
    fourfold, once, and what a saturated list can't hold is found exactly: threshold edges join vectors to components,
    components that a link of saturated vectors joins are joined by their balls (_bridges), and links are counted over
    all members of each component (_within), so no list length limits n_links. A sample is then compared with all
    vectors; while fewer than `recall` of its links lie within components, another tree and another local join are
    added; if the recall is still missed after `rounds` of them, an error is raised and no links are returned.

    Null, zero, or non-finite vectors link with nothing and get their own id. Rows that repeat a vec_id are one
    vector, the smallest (clean_vectors). A null vec_id gives no row. An empty table gives no rows.
    """
    vectors = clean_vectors(table)
    ids = table.select("vec_id").where("vec_id is not null").distinct()
    members, units, wide = _classes(vectors, stash)
    n = units.count()
    depth = max(1, (max(n, 2) // block).bit_length() + 1)
    edges = None
    for tree in range(trees):
        made = _tree(units, wide, seed + tree, depth, k, block)
        edges = made if edges is None else edges.unionByName(made)
    graph = stash.put(_best(edges, None, k), "graph")
    turn = 0
    while True:
        turn += 1
        full = graph.groupBy("id").agg(F.min("sim").alias("last"), F.count("*").alias("c"), F.max("room").alias("room"))
        rooms = stash.put(full.select("id", F.when((F.col("last") >= threshold) & (F.col("c") >= F.col("room")) & (F.col("room") < 4 * k), F.col("room") * 4).otherwise(F.col("room")).alias("room")), "rooms")
        step = _descend(graph, units, wide, k, turn).unionByName(graph.select("id", "nbr", "sim"))
        if turn > 2:
            step = step.unionByName(_tree(units, wide, seed + trees + turn, depth, k, block))
        graph = stash.put(_best(step, rooms, k), "graph")
        if turn < 2:
            continue
        near = stash.put(_near(graph.where(F.col("sim") >= threshold - 1e-4).select("id", "nbr"), units, threshold, wide), "near")
        labels = _bridges(graph, connected_components(near, stash), units, threshold, wide, stash)
        total, found = audit(units, labels, threshold, wide, sample)
        if found >= recall * total or turn >= rounds:
            break
    if found < recall * total:
        raise RuntimeError(f"near_vectors: {found} of {total} sampled links lie within components after {turn} turns, under the recall of {recall}")
    links = _within(units, labels, threshold, wide, stash)
    classes = members.groupBy("id").agg(F.count("*").alias("copies"))
    per = classes.join(labels, "id", "left").join(links, "id", "left").select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = members.join(per, "id").select("vec_id", "n_links", "component_id")
    whole = ids.join(out, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return whole.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _near(edges: DataFrame, units: DataFrame, threshold: float, wide: int) -> DataFrame:
    """Graph edges that reach the threshold in double precision."""

    def task(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<f8").reshape(-1, wide) for c in (2, 3))
                yield batch.select(["a", "b"]).filter(pa.array((x * y).sum(axis=1) >= threshold))

    side = lambda c: units.select(F.col("id").alias(c), F.col("unit").alias(f"unit_{c}"))
    pairs = edges.select(F.least("id", "nbr").alias("a"), F.greatest("id", "nbr").alias("b")).distinct()
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "unit_a", "unit_b").mapInArrow(task, "a long, b long")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of embeddings, linked at a cosine of 0.95."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Stash(spark, "op1"))
