"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic calibration (operator 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.llm.common import Stash

#: The document statistics, in order. All are taken over the whole text.
STATISTICS = (
    "log_bytes", "log_words", "word_length", "upper", "digit", "non_ascii", "newline", "period", "comma", "bang", "bar",
    "symbol", "quote", "other_mark", "distinct_words", "top_word", "words_per_line", "distinct_lines", "short_lines",
    "marked_words", "caps_words", "bar_words", "bang_words", "entropy", "longest_word", "repeated_pairs",
)


def statistics(text: bytes) -> list[float]:
    """STATISTICS of one text; zeros for a text without words."""
    import numpy as np

    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, m = len(text), len(words)
    c = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    share = lambda s: c[list(s)].sum() / n
    low = text.lower().split()
    counts: dict[bytes, int] = {}
    for w in low:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x]
    p = c[c > 0] / n
    marks = sum(w[-1] in b"!$%&*#" for w in words)
    caps = sum(w.isupper() for w in words)
    return [
        np.log1p(n), np.log1p(m), n / m, c[65:91].sum() / n, c[48:58].sum() / n, c[128:].sum() / n, c[10] / n, share(b"."), share(b","),
        share(b"!"), share(b"|"), share(b"$%&*#"), share(b"\"'"), share(b"()[]{}<>@+=/\\_-~^`;:?"), len(counts) / m, max(counts.values()) / m,
        np.log1p(m / len(lines)), len(set(lines)) / len(lines), sum(len(x) < 20 for x in lines) / len(lines), marks / m, caps / m,
        words.count(b"|") / m, sum(w.endswith(b"!!") for w in words) / m, float(-(p * np.log2(p)).sum()), np.log1p(max(map(len, words))),
        1 - len(set(zip(low, low[1:], strict=False))) / max(1, m - 1),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and its statistics as array<double>; null text as the empty one."""

    def task(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                some = batch.slice(lo, 1000)
                rows = [[float(v) for v in statistics((t.as_py() or "").encode())] for t in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, x array<double>")


class Features:
    """Standardised statistics, themselves and as random Fourier features of a Gaussian kernel."""

    def __init__(self, mean, scale, count: int, width: float, seed: int):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.turn = rng.standard_normal((len(mean), count)) / (width * np.sqrt(len(mean)))
        self.shift = rng.uniform(0, 2 * np.pi, count)

    def __call__(self, x):
        import numpy as np

        z = np.clip((x - self.mean) / self.scale, -6, 6)
        waves = np.sqrt(2 / len(self.shift)) * np.cos(z @ self.turn + self.shift)
        return np.concatenate([np.ones((len(z), 1)), 0.1 * z, waves], axis=1)


def pool_adjacent(value, weight):
    """Isotonic regression: the nondecreasing fit of least weighted squares, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return [v for v, _, n in blocks for _ in range(int(n))]


def _matrix(column):
    import numpy as np

    return column.values.to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, len(STATISTICS)))


def train(stats: DataFrame, labels: DataFrame, count: int = 256, width: float = 0.7, ridge: float = 1e-3, bins: int = 512, seed: int = 3, max_rows: int = 200_000) -> dict | None:
    """Fit the model; None if no row is labelled.

    labels: doc_id, quality (0 or 1; others are left out). Rows whose crc32(doc_id as text) mod 5 is 0 are held out and
    never seen. At most about `max_rows` labelled rows are used, chosen by hash of doc_id: a bound, so that the fit
    costs the same whatever the corpus; all sums are taken over partitions. Each of the four other folds is scored
    by the model of the three others, and those scores are calibrated.
    """
    import numpy as np

    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    seen = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("double").alias("y"), fold.cast("int").alias("fold")).where("fold <> 0").distinct()
    total = seen.count()
    if not total:
        return None
    if total > max_rows:
        seen = seen.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(max_rows / total * (1 << 20)))
    rows = seen.join(stats, "doc_id").select("fold", "y", "x").repartition(min(64, max(1, total // 2000 + 1)))
    d = len(STATISTICS)

    def reduced(frame: DataFrame, task, sizes: int) -> dict[int, np.ndarray]:
        """Sums by fold of what the tasks return as binary doubles; at most 64 tasks of 4 folds."""
        out: dict[int, np.ndarray] = {}
        for row in frame.mapInArrow(task, "fold int, part binary").toLocalIterator():
            out[row.fold] = out.get(row.fold, 0) + np.frombuffer(row.part, dtype="<f8").reshape(-1, sizes)
        return out

    def by_fold(work):
        def task(batches):
            import numpy as np
            import pyarrow as pa

            sums: dict = {}
            for batch in batches:
                f, y, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
                for k in np.unique(f):
                    sums[int(k)] = sums.get(int(k), 0) + work(x[f == k], y[f == k], int(k))
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.astype("<f8").tobytes() for v in sums.values()], pa.binary())], names=["fold", "part"])

        return task

    moments = sum(reduced(rows, by_fold(lambda x, y, k: np.stack([np.full(d, len(x)), x.sum(0), (x * x).sum(0)])), d).values())
    if isinstance(moments, int):
        return None
    n, mean = moments[0, 0], moments[1] / moments[0]
    scale = np.sqrt(np.maximum(moments[2] / moments[0] - mean**2, 0))
    features = Features(mean, np.where(scale > 1e-9, scale, 1.0), count, width, seed)
    wide = 1 + d + count

    def normal(x, y, k):
        z = features(x)
        return np.concatenate([z.T @ z, (z.T @ y)[None]])

    sums = reduced(rows, by_fold(normal), wide)
    solve = lambda folds: np.linalg.solve(sum(sums[f][:-1] for f in folds) + ridge * n * np.eye(wide) / wide, sum(sums[f][-1] for f in folds))
    parts = {f: solve([g for g in sums if g != f] or [f]) for f in sums}
    weights = solve(list(sums))

    def calibration(x, y, k):
        at = np.clip(np.floor((features(x) @ parts[k] + 0.5) / 2 * bins), 0, bins - 1).astype(int)
        return np.stack([np.bincount(at, minlength=bins), np.bincount(at, weights=y, minlength=bins)])

    table = sum(reduced(rows, by_fold(calibration), bins).values())
    some = np.flatnonzero(table[0])
    fit = pool_adjacent((table[1][some] + 0.5 * 0.02) / (table[0][some] + 0.02), table[0][some])
    return {"features": features, "weights": weights, "at": (some + 0.5) / bins * 2 - 0.5, "fit": np.clip(fit, 0, 1)}


def score(stats: DataFrame, model: dict | None) -> DataFrame:
    """doc_id and score in 0 to 1 for every row; 0.5 without a model."""
    if model is None:
        return stats.select("doc_id", F.lit(0.5).alias("score"))

    def task(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            raw = model["features"](_matrix(batch.column(1))) @ model["weights"]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.interp(raw, model["at"], model["fit"]))], names=["doc_id", "score"])

    return stats.mapInArrow(task, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, stash: Stash, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= threshold) for every row of docs.

    Scores depend on the text alone. Null and empty texts are scored too, by statistics of zero. A null doc_id is not
    held out; repeated rows get equal scores. Without labels every score is 0.5; an empty table gives no rows. Other
    columns of docs and labels are ignored.
    """
    stats = stash.put(document_statistics(docs), "statistics")
    scored = score(stats, train(stats, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, stash: Stash, threshold: float = 0.3, max_rows: int = 200_000) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns, whatever their names.

    The model is fitted on at most about `max_rows` labelled documents (train), whose ids are broadcast: under 4 MB.
    Their statistics are a table, read by each sum of the fit. Every text is then scored where it is read, so nothing
    is shuffled. Null and empty texts are scored as texts without words, a row without a doc_id by its text; repeated
    rows are kept or go together. Without labels every row stays. An empty table gives no rows.
    """
    ids = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id").distinct()
    total = ids.count()
    if total > max_rows:
        ids = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(max_rows / total * (1 << 20)))
    stats = stash.put(document_statistics(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")), "statistics")
    model = train(stats, labels.join(F.broadcast(ids), "doc_id"), max_rows=max_rows)
    if model is None:
        return docs
    at = docs.columns.index("text")

    def task(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                some = batch.slice(lo, 1000)
                x = np.array([statistics((t.as_py() or "").encode()) for t in some.column(at)]).reshape(some.num_rows, len(STATISTICS))
                value = np.interp(model["features"](x) @ model["weights"], model["at"], model["fit"])
                yield some.filter(pa.array(value >= threshold))

    return docs.mapInArrow(task, docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored, with the labels that aren't held out."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), Stash(spark, "op9"))
