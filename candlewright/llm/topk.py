"""Exact top-k by inner product over norm-sorted, SVD-rotated vectors (operator 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewright.llm.common import Stash
from candlewright.llm.vectors import finite_vectors, stack

#: Sums of products up to this stay exact in double precision.
EXACT = float(1 << 53)


def _rotation(vectors: DataFrame, width: int):
    """Right singular vectors of the table, largest first, from the partition-summed Gram matrix (width x width)."""
    import numpy as np

    def task(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros((width, width))
        for batch in batches:
            x = stack(batch.column(0), width)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["gram"])

    total = np.zeros((width, width))
    for row in vectors.select("x").mapInArrow(task, "gram binary").toLocalIterator():
        total += np.frombuffer(row.gram, dtype="<f8").reshape(width, width)
    if not np.isfinite(total).all():
        return np.eye(width)
    return np.linalg.eigh(total)[1][:, ::-1].copy()


BLOCK = "block long, longest double, ids binary, numbers binary, matrix binary"
FOUND = "query_row long, query_id long, vec_id long, row long, score long"


def _blocks(rows: DataFrame, wide: int, block: int) -> DataFrame:
    """Rows (row, vec_id, x) as blocks of at most `block` vectors, each one row with its longest length."""

    def task(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        name, held = TaskContext.get().partitionId() << 32, []

        def out(n: int):
            nonlocal name, held
            row, vec, x = (np.concatenate(p) for p in zip(*held, strict=True))
            held = [(row[n:], vec[n:], x[n:])] if len(row) > n else []
            longest = float(np.sqrt((x[:n] ** 2).sum(axis=1)).max())
            name += 1
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([longest]), pa.array([vec[:n].astype("<i8").tobytes()]), pa.array([row[:n].astype("<i8").tobytes()]), pa.array([x[:n].astype("<f8").tobytes()])], names=["block", "longest", "ids", "numbers", "matrix"])

        count = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                some = batch.slice(lo, block)
                held.append((some.column(0).to_numpy(zero_copy_only=False).astype(np.int64), some.column(1).to_numpy(zero_copy_only=False).astype(np.int64), stack(some.column(2), wide)))
                count += some.num_rows
                while count >= block:
                    yield out(block)
                    count -= block
        if count:
            yield out(count)

    return rows.select("row", "vec_id", "x").mapInArrow(task, BLOCK)


def _unpack(ids, numbers, matrix, wide: int):
    import numpy as np

    return np.frombuffer(ids, dtype="<i8"), np.frombuffer(numbers, dtype="<i8"), np.frombuffer(matrix, dtype="<f8").reshape(-1, wide)


def _score(left, right, bound, wide: int, k: int, head: int, turn) -> list[tuple]:
    """The k best of a block of vectors for each query of another, as far as they reach the queries' bounds."""
    import numpy as np

    (qid, qrow, q), (vid, vrow, x) = left, right
    rotated = q @ turn
    q_head, q_rest, q_len = rotated[:, :head], np.linalg.norm(rotated[:, head:], axis=1), np.linalg.norm(q, axis=1)
    bound = bound.copy()
    best: list[list[tuple]] = [[] for _ in qid]
    length = np.linalg.norm(x, axis=1)
    for lo in range(0, len(vid), 512):
        part, lens = slice(lo, lo + 512), length[lo : lo + 512]
        slack = 1e-9 * q_len * lens.max() + 1e-6
        live = np.flatnonzero(q_len * lens.max() + slack >= bound)
        if not len(live):
            continue
        r = x[part] @ turn
        reach = q_head[live] @ r[:, :head].T + q_rest[live][:, None] * np.linalg.norm(r[:, head:], axis=1)
        near = (reach + slack[live][:, None] >= bound[live][:, None]) & (qrow[live][:, None] != vrow[part])
        rows = np.flatnonzero(near.any(axis=1))
        if not len(rows):
            continue
        some, columns = live[rows], np.flatnonzero(near[rows].any(axis=0))
        near = near[rows][:, columns]
        if q_len[some].max() * lens.max() < EXACT:
            score = q[some] @ x[part][columns].T
        else:  # beyond double precision: whole numbers of any size
            whole = lambda m: np.array([[int(v) for v in row] for row in m], dtype=object).reshape(len(m), wide)
            score = whole(q[some]) @ whole(x[part][columns]).T
        for n, i in enumerate(some.tolist()):
            s = score[n]
            ok = np.flatnonzero(near[n] & (s >= bound[i] if np.isfinite(bound[i]) else near[n]))
            if len(ok) > k and score.dtype != object:
                cut = np.partition(s[ok], -k)[-k]
                ok = ok[s[ok] >= cut]
            more = [(-int(s[j]), int(vid[part][columns[j]]), int(vrow[part][columns[j]])) for j in ok]
            best[i] = sorted(best[i] + more)[:k]
            if len(best[i]) == k:
                top = float(-best[i][-1][0])
                bound[i] = max(bound[i], top - 1e-9 * abs(top) - 1e-6)
    return [(int(qrow[i]), int(qid[i]), v, r, max(-(1 << 63), min((1 << 63) - 1, -s))) for i, mine in enumerate(best) for s, v, r in mine]


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int, stash: Stash, scale: int = 1024, head: int = 16, block_bytes: int = 2 << 20) -> DataFrame:
    """Each query's k highest integer inner products of floor(scale * x) over every other row; exact.

    vectors, queries: row long (unique; a query's own row is no candidate), vec_id long, x array<double>
    (finite_vectors). Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id. Rows that repeat a
    vec_id are candidates and queries of their own. Fewer candidates than k give as many rows; vectors of differing
    lengths are taken with zeros at the shorter one's end. An empty table gives no rows.

    Vectors are ranged by descending length and stored in blocks of some `block_bytes`, queries too. The block of the
    longest vectors, which is all that is broadcast, gives every query a lower bound on its k-th score. A block of
    queries then meets those blocks of vectors alone whose longest vector can reach the bound of one of its queries:
    blocks are joined by classes of their longest length (sixteenths of a power of two), whose number depends on the
    range of doubles and not on the data. Where two blocks meet, vectors are visited in chunks by descending length;
    the first `head` rotated coordinates are summed, and a vector goes on only if the sum plus the product of both
    residual lengths (Cauchy-Schwarz) reaches the bound. Survivors are scored exactly, and each meeting returns at most
    k rows a query. Bounds carry slack for rounding, so none is lost by it. Products beyond double precision are summed
    as whole numbers, and held to the range of long at the end.
    """
    spark = vectors.sparkSession
    ints = lambda df: df.select("row", "vec_id", F.transform("x", lambda v: F.floor(v * float(scale)).cast("double")).alias("x"))
    wide = vectors.agg(F.max(F.size("x"))).first()[0] or 1
    size = max(16, min(4096, block_bytes // (8 * wide)))
    head = min(head, wide)
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    sort = lambda df: df.withColumn("length", length).repartitionByRange(F.desc("length"), "row").sortWithinPartitions(F.desc("length"), "row")
    data = stash.put(sort(ints(vectors)), "by-length")
    turn = _rotation(data, wide)
    blocks = stash.put(_blocks(data, wide, size), "blocks")
    asked = stash.put(_blocks(stash.put(sort(ints(queries)), "queries"), wide, size), "query-blocks")
    kind = lambda c: F.floor(F.log2(F.greatest(c, F.lit(1.0))) * 16).cast("int")
    first = blocks.orderBy(F.desc("longest"), "block").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not first:
        return empty
    kinds = sorted(r.kind for r in blocks.select(kind(F.col("longest")).alias("kind")).distinct().collect())
    longest = _unpack(first[0].ids, first[0].numbers, first[0].matrix, wide)[1:]

    def bounds(batches):
        import numpy as np
        import pyarrow as pa

        rows, far = longest
        for batch in batches:
            names, bound_of, at = [], [], []
            for name, ids, numbers, matrix in zip(*(batch.column(j).to_pylist() for j in range(4)), strict=True):
                _, own, q = _unpack(ids, numbers, matrix, wide)
                score = q @ far.T
                score[own[:, None] == rows] = -np.inf
                bound = np.full(len(own), -np.inf)
                if score.shape[1] >= k:
                    bound = np.partition(score, -k, axis=1)[:, -k]
                    bound = np.where(np.isfinite(bound), bound - 1e-9 * np.abs(bound) - 1e-6, -np.inf)
                size = np.linalg.norm(q, axis=1)
                need = np.where(bound <= 0, 0.0, bound / np.maximum(size, 1e-300)).min() * (1 - 1e-6)
                least = np.floor(np.log2(max(need, 1.0)) * 16) - 1
                for c in kinds:
                    if c >= least:
                        names.append(name)
                        bound_of.append(bound.astype("<f8").tobytes())
                        at.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(bound_of, pa.binary()), pa.array(at, pa.int32())], names=["query_block", "bound", "kind"])

    def meet(batches):
        import pyarrow as pa

        for batch in batches:
            found = []
            for row in zip(*(batch.column(j).to_pylist() for j in range(7)), strict=True):
                found += _score(_unpack(*row[:3], wide), _unpack(*row[3:6], wide), np.frombuffer(row[6], dtype="<f8"), wide, k, head, turn)
            columns = list(zip(*found, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_row", "query_id", "vec_id", "row", "score"])

    import numpy as np

    wanted = stash.put(asked.select("block", "ids", "numbers", "matrix").mapInArrow(bounds, "query_block long, bound binary, kind int"), "bounds", arrow_rows=4)
    pairs = wanted.join(blocks.select("block", kind(F.col("longest")).alias("kind")), "kind").select("query_block", "bound", "block")
    pairs = stash.put(pairs, "pairs")
    left = asked.select(F.col("block").alias("query_block"), F.col("ids").alias("query_ids"), F.col("numbers").alias("query_numbers"), F.col("matrix").alias("query_matrix"))
    met = pairs.join(left, "query_block").join(blocks.drop("longest"), "block").select("query_ids", "query_numbers", "query_matrix", "ids", "numbers", "matrix", "bound")
    found = stash.put(met.mapInArrow(meet, FOUND), "found", arrow_rows=2)
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").to(empty.schema)


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: rows whose vec_id is divisible by 100; candidates: every other row; the ten highest scores."""
    stash = Stash(spark, "op4")
    vectors = stash.put(finite_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "vectors")
    return top_inner_products(vectors, vectors.where("vec_id % 100 = 0"), 10, stash)
