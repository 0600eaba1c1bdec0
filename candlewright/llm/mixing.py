"""Soft-membership mixing of sources to target weights, in DataFrame functions alone (operator 6)."""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from math import log, sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.llm.common import Stash
from candlewright.llm.spans import bind

#: What parts words: runs of anything but letters, digits and their marks, in every script.
MARKS = r"[^a-z0-9\p{L}\p{N}\p{M}]+"
#: Buckets of hashed words.
BUCKETS = 1 << 15


def _buckets(text: Column) -> Column:
    """The distinct buckets of a whole text's distinct lower-cased words, from 1."""
    words = F.filter(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), MARKS, -1)), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: (F.pmod(F.xxhash64(w), F.lit(BUCKETS)) + 1).cast("int")))


def tokens(text: Column) -> Column:
    """Token estimate of a whole text: three eighths of its bytes of UTF-8, spaces, tabs and newlines aside, rounded up; 0
    for null or empty text. A letter of a script without spaces has three bytes, so it counts as one token."""
    bare = F.replace(F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")), F.lit("\t"), F.lit(""))
    return F.coalesce(F.ceil(F.octet_length(bare) * 3 / 8), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Model:
    """Naive Bayes over hashed words: log odds of each domain, and what each bucket's presence adds to each.

    Buckets that say nothing of any domain have place 0, the others their place in `adds`.
    """

    domains: list[str]
    start: list[float]
    place: list[int]
    adds: list[list[float]]

    def posteriors(self, text: Column) -> Column:
        """Posterior probabilities of the domains, array<double> in their order."""
        numbers = lambda values, kind: F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")  # folded to one constant array
        places = lambda held: F.filter(F.transform(held, lambda b: F.element_at(numbers(self.place, "int"), b)), lambda k: k > 0)

        def total(held: Column, first: float, adds: list[float]) -> Column:
            table = numbers(adds or [0.0], "double")
            return F.aggregate(held, F.lit(float(first)), lambda s, k: s + F.element_at(table, k))

        def odds(held: Column) -> Column:
            return F.array(*[total(held, a, w) for a, w in zip(self.start, self.adds, strict=True)])

        def share(values: Column) -> Column:
            raised = F.transform(values, lambda v: F.exp(F.greatest(v - F.array_max(values), F.lit(-60.0))))
            return bind(raised, lambda r: bind(F.aggregate(r, F.lit(0.0), lambda s, x: s + x), lambda whole: F.transform(r, lambda v: v / whole)))

        return bind(places(_buckets(text)), lambda held: bind(odds(held), share))


def train(docs: DataFrame, labelled: DataFrame, stash: Stash, gate: float = 4.0, pull: float = 5.0, max_rows: int = 10_000) -> Model | None:
    """Fit the classifier on the labelled table (doc_id, domain); None if it is empty.

    At most about `max_rows` labelled documents are used, chosen by hash: a bound, so the ids that are broadcast are
    at most 160 kB, and what reaches the driver is at most one count for each bucket and domain.

    All words of all labelled texts are counted, as buckets. A domain's name is a path (de/toxic): a bucket's share of
    a domain's documents is taken from the path's start, of which it is a part, unless it differs from it by `gate`
    standard deviations; then it is its own share, drawn toward the start's as by `pull` documents.
    """
    rows = labelled.where("doc_id is not null and domain is not null").select("doc_id", "domain").distinct()
    total = rows.count()
    if not total:
        return None
    if total > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(max_rows / total * (1 << 20)))
    held = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select("domain", _buckets(F.col("text")).alias("held"))
    held = stash.put(held, "labelled")
    counts = {r.domain: r.n for r in held.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    names = sorted(counts)
    seen: dict[int, dict[str, int]] = {}
    each = held.select("domain", F.explode("held").alias("bucket")).groupBy("domain", "bucket").agg(F.count("*").alias("df"))
    lists = each.groupBy("domain").agg(F.sort_array(F.collect_list(F.struct("bucket", "df"))).alias("b"))  # at most BUCKETS in each
    for r in lists.select("domain", F.col("b.bucket").alias("bucket"), F.col("b.df").alias("df")).collect():
        for bucket, df in zip(r.bucket, r.df, strict=True):
            seen.setdefault(bucket, {})[r.domain] = df
    paths = {d: ["/".join(d.split("/")[:k]) for k in range(1, d.count("/") + 2)] for d in names}
    sizes: dict[str, int] = {}
    for d in names:
        for p in paths[d]:
            sizes[p] = sizes.get(p, 0) + counts[d]
    n = sum(counts.values())
    start = {d: log(counts[d] / n) for d in names}
    place, adds = [0] * BUCKETS, {d: [] for d in names}
    used = 0
    for bucket, own in sorted(seen.items()):
        df: dict[str, int] = {}
        for d, c in own.items():
            for p in paths[d]:
                df[p] = df.get(p, 0) + c
        base = (sum(own.values()) + 0.5) / (n + 1)
        share = {}
        for d in names:
            p0 = base
            for p in paths[d]:
                if p not in share:
                    c, m = df.get(p, 0), sizes[p]
                    far = abs(c - m * p0) >= gate * sqrt(m * p0 * (1 - p0) + 0.5)
                    share[p] = min(0.999, max(1e-5, (c + pull * p0) / (m + pull))) if far else p0
                p0 = share[p]
        if all(share[d] == base for d in names):
            continue
        used += 1
        place[bucket - 1] = used
        for d in names:
            adds[d].append(round(log(share[d] / (1 - share[d])) - log(base / (1 - base)), 4))
            start[d] += log((1 - share[d]) / (1 - base))
    return Model(names, [start[d] for d in names], place, [adds[d] for d in names])


@dataclass(frozen=True)
class Fit:
    """Rates as the fold of steps over a posterior, and how far each domain's expected total is from its target."""

    steps: list[list[float]]
    domains: list[str]
    target: list[float]
    total: list[float]

    def rate(self, posterior: Column) -> Column:
        flat = F.split(F.lit(",".join(repr(x) for s in self.steps for x in s)), ",").cast("array<double>") if self.steps else None
        if flat is None:
            return F.lit(1.0)
        width = len(self.domains)
        dot = lambda p, at: F.aggregate(F.sequence(F.lit(1), F.lit(width)), F.lit(0.0), lambda s, d: s + F.element_at(flat, at + d) * F.element_at(p, d))
        return bind(posterior, lambda p: F.aggregate(F.sequence(F.lit(0), F.lit(len(self.steps) - 1)), F.lit(1.0), lambda r, k: F.greatest(F.lit(0.0), r - dot(p, k * width))))

    def missed(self) -> float:
        """The largest error of a domain, as a share of its target (of all tokens where the target is 0)."""
        return max((abs(a - b) / (b or 1.0) for a, b in zip(self.total, self.target, strict=True)), default=0.0)


def fit_rates(rows: DataFrame, domains: list[str], weights: dict[str, float] | None, factors: dict[str, float], rounds: int = 200, tolerance: float = 1e-4, budget: float = 1.0) -> Fit:
    """Nonnegative rates of documents by projected gradient.

    rows: tokens, posterior (a table). Least squares: the expected token total of domain d, the sum of rate * tokens *
    posterior[d], is to be its share of budget * all tokens. Shares are the weights, or the domains' present totals,
    times the factors. Errors are weighed by the inverse of M, the sum of tokens * posterior * posterior' over the rows
    whose rate isn't zero; in the metric of tokens a document's gradient is then posterior . (M^-1 error), the curvature
    is one, and a step of one is exact unless it takes a rate to zero. A step that doesn't lessen the errors is halved.
    Each round sums M and one total for each domain over all rows. A rate is the fold of all steps so far, which go into
    the query as one array of constants, so the plan stays the same and nothing but the steps grows. Domains that no
    document belongs to are left out of the targets.

    Rounds end when each domain is within `tolerance` of its own target. Where posteriors can't tell domains apart the
    targets can't be met by rates that aren't negative: rounds end too when five in turn have lessened the errors by
    less than a thousandth, and a warning names the domains missed. If neither has come after `rounds`, an error is
    raised.
    """
    import numpy as np

    k = len(domains)
    p = lambda i: F.col("posterior")[i]

    def summed(rate: Column) -> tuple[float, np.ndarray, np.ndarray]:
        """All tokens; each domain's expected total; M over the rows of a rate over zero."""
        seen = rows.select("tokens", "posterior", rate.alias("rate"))
        held = F.when(F.col("rate") > 0, F.col("tokens")).otherwise(0)
        row = seen.select(F.sum("tokens").alias("all"), *[F.sum(F.col("tokens") * F.col("rate") * p(i)).alias(f"s{i}") for i in range(k)], *[F.sum(held * p(i) * p(j)).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        every = row["all"] or 0
        return every, np.array([(row[f"s{i}"] or 0.0) / (every or 1) for i in range(k)]), np.array([[(row[f"m{min(i, j)}_{max(i, j)}"] or 0.0) / (every or 1) for j in range(k)] for i in range(k)])

    total, now, gram = summed(F.lit(1.0))
    if not total:
        return Fit([], domains, [0.0] * k, [0.0] * k)
    wanted = np.array([max(0.0, (s if weights is None else weights.get(d, 0.0)) * factors.get(d, 1.0)) if s > 1e-9 else 0.0 for d, s in zip(domains, now, strict=True)])
    if not wanted.sum():
        raise ValueError("no target weight for any domain that has documents")
    wanted *= budget / wanted.sum()
    live = now > 1e-9
    inverse = lambda m: np.linalg.pinv(m, rcond=1e-9, hermitian=True)
    off = lambda totals: np.where(live, np.abs(totals - wanted) / np.where(wanted > 0, wanted, 1.0), 0.0)
    size = lambda totals: float((((totals - wanted)[live] / np.where(wanted > 0, wanted, 1.0)[live]) ** 2).sum())
    steps: list[list[float]] = []
    length, stale = 1.0, 0
    for _ in range(rounds):
        if (off(now) < tolerance).all():
            break
        step = length * (inverse(gram) @ np.where(live, now - wanted, 0.0))
        trial = Fit([*steps, step.tolist()], domains, [], [])
        _, then, next_gram = summed(trial.rate(F.col("posterior")))
        if size(then) < size(now):
            stale = stale + 1 if size(then) > 0.998 * size(now) else 0
            steps, now, gram, length = trial.steps, then, next_gram, min(1.0, 2 * length)
        else:
            length, stale = length / 2, stale + 1
        if stale >= 5:
            warnings.warn(f"fit_rates: after {len(steps)} steps these domains stay away from their targets: " + ", ".join(f"{d} ({a:.4g} for {b:.4g})" for d, a, b, e in zip(domains, now, wanted, off(now), strict=True) if e >= tolerance), stacklevel=2)
            break
    else:
        raise RuntimeError(f"fit_rates: the rates still move after {rounds} rounds")
    return Fit(steps, domains, wanted.tolist(), now.tolist())


def mix(docs: DataFrame, labelled: DataFrame, stash: Stash, weights: dict[str, float] | None = None, factors: dict[str, float] | None = None, seed: int = 17) -> DataFrame:
    """doc_id, tokens, posterior, rate, copies for each row of docs, `domains` in the posterior's order, and `missed`:
    the largest error of a domain's expected token total, as a share of its target, the same on every row.

    A document is to be taken `copies` times: its rate rounded up or down by a hash of doc_id and text, so that the
    expected number is the rate. Targets are `weights` by domain (None: present token totals) times `factors`. Null or
    empty text has no tokens and the prior as posterior. Repeated rows of a doc_id and text get equal values, a null
    doc_id is rounded by its text. Other columns are ignored, whatever their names. Without labels every rate is 1. An
    empty table gives no rows.
    """
    rows, fit, model = _fitted(docs, labelled, stash, weights, factors, seed)
    domains = model.domains if model else [""]
    out = rows.withColumn("rate", fit.rate(F.col("posterior")))
    return out.select("doc_id", "tokens", "posterior", "rate", _copies(F.col("rate"), F.col("salt")).alias("copies"), F.array(*map(F.lit, domains)).alias("domains"), F.lit(fit.missed()).alias("missed"))


def mix_documents(docs: DataFrame, labelled: DataFrame, stash: Stash, weights: dict[str, float] | None = None, factors: dict[str, float] | None = None, seed: int = 17) -> DataFrame:
    """docs with every row repeated `copies` times (mix), and all its columns, whatever their names. Rows aren't
    shuffled: a posterior is computed again where its text is read."""
    _, fit, model = _fitted(docs, labelled, stash, weights, factors, seed)
    if model is None:
        return docs
    row, text = F.struct(*docs.columns), F.col("text")
    copies = bind(fit.rate(model.posteriors(text)), lambda rate: _copies(rate, _salt(seed)))
    out = docs.select(row.alias("row"), F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def _fitted(docs: DataFrame, labelled: DataFrame, stash: Stash, weights, factors, seed: int) -> tuple[DataFrame, Fit, Model | None]:
    """Narrow rows (doc_id, tokens, posterior, salt) in a table, the rates fitted over them, and the classifier."""
    model = train(docs, labelled, stash)
    posterior = F.array(F.lit(1.0)) if model is None else model.posteriors(F.col("text"))
    rows = stash.put(docs.select("doc_id", tokens(F.col("text")).alias("tokens"), posterior.alias("posterior"), _salt(seed).alias("salt")), "posteriors")
    if model is None:
        return rows, Fit([], [""], [0.0], [0.0]), None
    return rows, fit_rates(rows, model.domains, weights, factors or {}), model


def _salt(seed: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)


def _copies(rate: Column, salt: Column) -> Column:
    return (F.floor(rate) + (salt < rate - F.floor(rate)).cast("int")).cast("int")


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and domain of labelled documents: language, and whether the label says toxic.

    Languages are joined from docs by doc_id: two narrow columns.
    """
    toxic = F.when(F.col("toxic") == 1, "toxic").otherwise("clean")
    return labels.where("doc_id is not null").select("doc_id", toxic.alias("side")).distinct().join(docs.select("doc_id", "lang"), "doc_id").select("doc_id", F.concat_ws("/", F.coalesce("lang", F.lit("")), "side").alias("domain"))


def production_factors(labelled: DataFrame, toxic: float = 0.1) -> dict[str, float]:
    """Production targets: each domain's present tokens, and a tenth of them where toxic."""
    return {r.domain: toxic for r in labelled.select("domain").distinct().collect() if r.domain.endswith("/toxic")}


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates and copies of all documents for the production targets, with the largest error that is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stash = Stash(spark, "op6")
    labelled = stash.put(labelled_domains(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), "domains")
    out = mix(docs, labelled, stash, factors=production_factors(labelled))
    top = F.array_position("posterior", F.array_max("posterior")).cast("int")
    return out.select("doc_id", "tokens", F.element_at("domains", top).alias("domain"), F.array_max("posterior").alias("posterior"), "rate", "copies", "missed")
