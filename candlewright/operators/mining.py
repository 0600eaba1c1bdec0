"""Frequent conjunctions of conditions: a level-wise ladder that ends when no set is frequent, and the sets' outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewright.operators import conditions
from candlewright.operators.outcomes import WARM, edges_of, forward, hits, lenses
from candlewright.plans.dialect import DUCK, SPARK, Dialect, run
from candlewright.plans.storage import keep
from candlewright.sources.bars import MINUTE


def sets_sql(d: Dialect, family: str, chosen: list[str], k: int, least: int) -> str:
    """All sets of k conditions true together on at least `least` bars, as self joins on the bar."""
    joins = "".join(f" JOIN x t{i} ON t0.series = t{i}.series AND t0.us = t{i}.us AND t{i - 1}.condition < t{i}.condition" for i in range(1, k))
    name = " || ',' || ".join(f"t{i}.condition" for i in range(k))
    return f"WITH x AS ({hits(d, family, chosen)}) SELECT {name} AS items, count(*) AS hits FROM x t0{joins} GROUP BY 1 HAVING count(*) >= {least}"


#: Items that a ladder takes at most, rows of a bit matrix, and how many sets go to the tasks at once.
VOCABULARY, ROWS, SETS_AT_ONCE = 4096, 1 << 16, 250_000


def _stored(df_of, spark, path: str | None) -> DataFrame:
    """The table at a path if a finished one is there, else what df_of gives, written there first."""
    if path is None:
        return keep(df_of())
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(conf).exists(mark):
        df_of().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def matrices(batches, column: int, n: int, rows: int = ROWS):
    """Batches of up to `rows` bars as (Arrow batches, matrix of n items by bars, of booleans)."""
    import numpy as np

    def matrix(held):
        size = sum(b.num_rows for b in held)
        out, at = np.zeros((n, size), dtype=bool), 0
        for b in held:
            lists = b.column(column)
            ends = lists.offsets.to_numpy()
            items = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
            out[items, at + np.repeat(np.arange(b.num_rows), np.diff(ends))] = True
            at += b.num_rows
        return held, out

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield matrix(held)
            held, size = [], 0
    if size:
        yield matrix(held)


def groups_of(sets) -> list[tuple]:
    """Runs of sorted sets that agree in all but their last item: (prefix, first, end)."""
    import numpy as np

    change = np.flatnonzero((sets[1:, :-1] != sets[:-1, :-1]).any(axis=1)) + 1
    edges = np.concatenate([[0], change, [len(sets)]])
    return [(sets[lo, :-1], int(lo), int(hi)) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]


def count_sets(bars: DataFrame, n: int, sets: list[tuple[int, ...]]) -> list[int]:
    """On how many bars each set holds. bars: bits array<int>, the items true on the bar, from 0 to n - 1.

    A task turns its bars into one bit vector for each item, and ands them: nothing is written for a bar and a set, and
    what leaves a task is one number for each set. Sets go to the tasks in parts of SETS_AT_ONCE, some megabytes each.
    """
    import numpy as np

    counts = np.zeros(len(sets), dtype=np.int64)
    for lo in range(0, len(sets), SETS_AT_ONCE):
        some = np.array(sets[lo : lo + SETS_AT_ONCE], dtype=np.int16)
        shared = bars.sparkSession.sparkContext.broadcast(some)

        def task(batches, shared=shared):
            import numpy as np
            import pyarrow as pa

            sets = shared.value
            runs, totals = groups_of(sets), np.zeros(len(sets), dtype=np.int64)
            for _, held in matrices(batches, 0, n):
                packed = np.packbits(held, axis=1)
                words = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)
                for prefix, first, end in runs:
                    base = np.bitwise_and.reduce(words[prefix], axis=0) if len(prefix) else ~np.uint64(0)
                    totals[first:end] += np.bitwise_count(words[sets[first:end, -1]] & base).sum(axis=1, dtype=np.int64)
            at = np.flatnonzero(totals)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals[at])], names=["at", "hits"])

        for r in bars.select("bits").mapInArrow(task, "at long, hits long").groupBy("at").agg(F.sum("hits").alias("hits")).collect():
            counts[lo + r["at"]] = r["hits"]
        shared.unpersist()
    return counts.tolist()


def ladder(items: DataFrame, least: int, universe: int | None = None, ceiling: int = 1_000_000, store: str | None = None, dead: DataFrame | None = None) -> tuple[DataFrame, list[dict]]:
    """Every frequent set of items, level by level, until a level is empty.

    items: bar, item (at most VOCABULARY kinds), or one row a bar, with its items as `names`, which isn't shuffled. Returns (k, items, hits) and an account of each level: of the sets
    generated, how many were pruned, infrequent and survivors, which add up. Items true on no bar or on all of
    `universe` are excluded, and of items true on exactly the same bars the smallest stays. A level's sets come from
    joining the previous ones on their first k - 1 items, without those of which a subset isn't frequent; a level of more
    than `ceiling` candidates halts the ladder, and the account says so, so the sets that the driver holds are bounded.
    Bars are one row each, a list of the items true there, and every level reads them once (count_sets).

    `dead` (a, b) names pairs of which one condition implies the other: no set holds both. With `store`, a folder that
    executors share, every level is written there, and a ladder that is run again goes on after the last finished one. A
    folder of other items, threshold or universe is refused.
    """
    least, spark, rows = max(1, least), items.sparkSession, None
    at = lambda name: None if store is None else f"{store}/{name}"
    if "names" in items.columns:
        rows, items = items, items.select("bar", F.explode(F.array_distinct("names")).alias("item"))
    if store is not None:
        mine = items.distinct().agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("bar", "item")).alias("x")).select("n", "x", F.lit(least).alias("least"), F.lit(-1 if universe is None else universe).alias("universe"))
        first = mine.first()
        if _stored(lambda: mine, spark, at("identity")).first() != first:
            raise ValueError("the folder holds another ladder")
    pairs = items.select("bar", "item") if rows is not None else items.select("bar", "item").distinct()
    one = pairs.groupBy("item").agg(F.count("*").alias("hits"), F.sum(F.xxhash64("bar").cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64("bar", F.lit(1))).alias("b"))
    if universe is not None:
        one = one.where(F.col("hits") < universe)
    one = one.groupBy("hits", "a", "b").agg(F.min("item").alias("item")).where(F.col("hits") >= least).select("item", "hits")
    singles = sorted((r["item"], r["hits"]) for r in _stored(lambda: one, spark, at("level-1")).limit(VOCABULARY + 1).collect())
    if len(singles) > VOCABULARY:
        raise ValueError(f"more than {VOCABULARY} items")
    names = [i for i, _ in singles]
    accounts: list[dict] = [{"k": 1, "survivors": len(names)}]
    schema = "k int, items array<string>, hits long"
    if not names:
        return spark.createDataFrame([], schema), accounts
    number = {i: n for n, i in enumerate(names)}
    known = spark.createDataFrame(list(number.items()), "item string, n int")
    if rows is None:
        bits = pairs.join(F.broadcast(known), "item").groupBy("bar").agg(F.collect_list("n").alias("bits"))
    else:
        place = F.transform(F.array_distinct("names"), lambda x: F.array_position(F.array(*map(F.lit, names)), x).cast("int"))
        bits = rows.select(F.transform(F.filter(place, lambda n: n > 0), lambda n: n - 1).alias("bits"))
    bars = _stored(lambda: bits, spark, at("bars"))
    barred = {tuple(sorted((number[r["a"]], number[r["b"]]))) for r in dead.collect() if r["a"] in number and r["b"] in number} if dead is not None else set()
    level = {(n,): h for n, (_, h) in enumerate(singles)}
    out, k = [(1, [i], h) for i, h in singles], 1
    while level:
        grown, generated = [], 0
        by_prefix: dict[tuple, list[int]] = {}
        for s in sorted(level):
            by_prefix.setdefault(s[:-1], []).append(s[-1])
        for prefix, lasts in by_prefix.items():
            for i, x in enumerate(lasts):
                for y in lasts[i + 1 :]:
                    generated += 1
                    s = (*prefix, x, y)
                    if (k > 1 or s not in barred) and all(s[:j] + s[j + 1 :] in level for j in range(k - 1)):
                        grown.append(s)
                if len(grown) > ceiling:
                    break
        k += 1
        if len(grown) > ceiling:
            accounts.append({"k": k, "halted": True, "candidates": len(grown)})
            break
        counted = _counted(bars, len(names), grown, least, spark, at(f"level-{k}"))
        level = counted
        accounts.append({"k": k, "generated": generated, "pruned": generated - len(grown), "infrequent": len(grown) - len(level), "survivors": len(level)})
        out += [(k, [names[n] for n in s], h) for s, h in sorted(level.items())]
    return spark.createDataFrame(out, schema), accounts


def _counted(bars: DataFrame, n: int, grown: list[tuple], least: int, spark, path: str | None) -> dict[tuple, int]:
    """The frequent ones of the sets with their hits, from a finished table at the path if there is one."""
    found = lambda: [(s, h) for s, h in zip(grown, count_sets(bars, n, grown) if grown else [], strict=True) if h >= least]
    if path is None:
        return dict(found())
    rows = _stored(lambda: spark.createDataFrame([(list(map(int, s)), h) for s, h in found()], "bits array<int>, hits long"), spark, path)
    return {tuple(r["bits"]): r["hits"] for r in rows.collect()}


#: What a task sums for each set over its outcomes, and what it takes the extremes of.
SUMS = ("n", "wins", "losses", "total", "gross_win", "gross_loss", "squares", "favourable", "xp", "lin", "w")
EXTREMES = {"best": "max", "worst": "min", "worst_adverse": "max"}


def set_edges(bars: DataFrame, names: list[str], sets: list[tuple[str, ...]], horizon: int) -> DataFrame:
    """Edge statistics of each set over the outcomes of the bars where it holds, with t corrected for overlapping
    horizons: condition (the set's names, comma-joined) and the columns of outcomes.edges_of.

    bars: bits array<int>, ret, adverse, favourable long, and ahead array<struct<bits, ret>>: the bars 1 to horizon - 1
    later, null where there is none or it has no outcome. A task multiplies the bit matrix of its bars with their
    outcomes; what leaves it is one row for each set.
    """
    import numpy as np

    number = {i: n for n, i in enumerate(names)}
    spark, by_size = bars.sparkSession, {}
    for s in sets:
        by_size.setdefault(len(s), []).append(tuple(sorted(number[i] for i in s)))
    parts = []
    for size, some in sorted(by_size.items()):
        for lo in range(0, len(some), SETS_AT_ONCE // 10):
            parts.append(np.array(sorted(some)[lo : lo + SETS_AT_ONCE // 10], dtype=np.int16).reshape(-1, size))
    schema = ", ".join(["condition string", *(f"{c} double" for c in SUMS), *(f"{c} long" for c in EXTREMES)])
    found = None
    for part in parts:
        shared = spark.sparkContext.broadcast((part, names))

        def task(batches, shared=shared):
            import numpy as np
            import pyarrow as pa

            sets, names = shared.value
            sums = np.zeros((len(sets), len(SUMS)))
            top, bottom, against = np.full(len(sets), -(1 << 62)), np.full(len(sets), 1 << 62), np.full(len(sets), -(1 << 62))
            runs = groups_of(sets)
            for held, bits in matrices(batches, 0, len(names), 1 << 13):
                ret, adverse, fav = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]).astype(np.int64) for c in (1, 2, 3))
                r = ret.astype(float)
                values = np.stack([np.ones(len(r)), r > 0, r < 0, r, np.where(r > 0, r, 0), np.where(r < 0, -r, 0), r * r, fav.astype(float)], axis=1)
                later = [row for b in held for row in b.column(4).to_pylist()]
                gaps = []
                for g in range(1, horizon):
                    near = [(i, row[g - 1]) for i, row in enumerate(later) if row[g - 1] is not None and row[g - 1]["ret"] is not None]
                    other, there = np.zeros((len(names), len(near)), dtype=bool), np.array([i for i, _ in near], dtype=int)
                    for j, (_, x) in enumerate(near):
                        other[x["bits"], j] = True
                    a, b, weight = r[there], np.array([x["ret"] for _, x in near], dtype=float), 1 - g / horizon
                    gaps.append((other & bits[:, there], np.stack([weight * a * b, weight * (a + b), np.full(len(a), weight)], axis=1)))
                for prefix, first, end in runs:
                    lasts = sets[first:end, -1]
                    mine = bits[lasts] & bits[prefix].all(axis=0)
                    sums[first:end, :8] += mine @ values
                    top[first:end] = np.maximum(top[first:end], np.where(mine, ret, -(1 << 62)).max(axis=1))
                    bottom[first:end] = np.minimum(bottom[first:end], np.where(mine, ret, 1 << 62).min(axis=1))
                    against[first:end] = np.maximum(against[first:end], np.where(mine, adverse, -(1 << 62)).max(axis=1))
                    for both, weights in gaps:
                        sums[first:end, 8:] += (both[lasts] & both[prefix].all(axis=0)) @ weights
            some = np.flatnonzero(sums[:, 0])
            columns = [pa.array([",".join(names[i] for i in sets[j]) for j in some], pa.string()), *(pa.array(sums[some, c]) for c in range(len(SUMS))), pa.array(top[some]), pa.array(bottom[some]), pa.array(against[some])]
            yield pa.RecordBatch.from_arrays(columns, names=["condition", *SUMS, *EXTREMES])

        rows = bars.where("ret IS NOT NULL").select("bits", "ret", "adverse", "favourable", "ahead").mapInArrow(task, schema)
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = spark.createDataFrame([], schema)
    whole = found.groupBy("condition").agg(*[F.sum(c).alias(c) for c in SUMS], *[getattr(F, how)(c).alias(c) for c, how in EXTREMES.items()])
    mean, n = F.col("total") / F.col("n"), F.col("n")
    spread = F.col("squares") - n * mean * mean + 2 * (F.col("xp") - mean * F.col("lin") + mean * mean * F.col("w"))
    t = F.when((n > 1) & (spread > 1e-9), mean / F.sqrt(spread / (n - 1) / n))
    counts = [F.col(c).cast("long").alias(c) for c in ("n", "total", "wins", "losses", "gross_win", "gross_loss")]
    return whole.select("condition", *counts, "best", "worst", "worst_adverse", F.col("favourable").cast("long").alias("favourable"), F.round(mean, 6).alias("mean"), F.round(t, 6).alias("t"))


def outcome_bars(d: Dialect, family: str, chosen: list[str], minutes: int = 60, horizon: int = 2) -> str:
    """Bars with the chosen conditions true there, their outcome, and those of the next horizon - 1 bars (set_edges)."""
    rows = ", ".join(f"CASE WHEN {c} THEN {n} END" for n, c in enumerate(sorted(chosen)))
    held = f"SELECT w.series, w.us, array_compact(array({rows})) AS bits FROM ({conditions.wide(d, family, minutes)}) w WHERE {WARM}"
    known = f"SELECT h.*, f.ret, f.adverse, f.favourable, CASE WHEN f.ret IS NOT NULL THEN struct(h.bits, f.ret) END AS own FROM ({held}) h JOIN ({forward(d, minutes, horizon)}) f ON f.series = h.series AND f.us = h.us"
    step = minutes * MINUTE
    later = ", ".join(f"max(own) OVER (PARTITION BY series ORDER BY us RANGE BETWEEN {g * step} FOLLOWING AND {g * step} FOLLOWING)" for g in range(1, horizon))
    return f"SELECT bits, ret, adverse, favourable, array({later}) AS ahead FROM ({known}) k"


def edges_of_sets(spark, sf_dir: str, family: str, chosen: list[str], least: int, horizon: int = 2) -> tuple[DataFrame, DataFrame]:
    """Frequent sets of the chosen conditions (k, items, hits), and the edges of each over its outcomes."""
    hit_rows = run(spark, sf_dir, f"SELECT concat_ws('/', series, us) AS bar, condition AS item FROM ({hits(SPARK, family, chosen)}) h")
    sets = keep(finished(ladder(hit_rows, least)))
    bars = keep(run(spark, sf_dir, outcome_bars(SPARK, family, chosen, horizon=horizon)))
    listed = [tuple(r["items"]) for r in sets.select("items").collect()]
    return sets, set_edges(bars, sorted(chosen), listed, horizon)


def ranked_sets(spark, sf_dir: str, family: str, chosen: list[str], least: int, top: int = 10) -> DataFrame:
    """The best sets by each lens: cut to `top` first, and then marked closed or not, with nothing taken up from below."""
    sets, edges = edges_of_sets(spark, sf_dir, family, chosen, least)
    shut = closed(sets).select(F.array_join("items", ",").alias("condition"), F.lit(True).alias("closed"))
    best = spark.sql(lenses(SPARK, "SELECT * FROM {edges}", top), edges=keep(edges))
    return best.join(shut, "condition", "left").select("lens", "place", "condition", "score", F.coalesce("closed", F.lit(False)).alias("closed"))


def best_by_hits(sets: DataFrame, cap: int) -> DataFrame:
    """At most `cap` sets by hits, ties to the names that come later: a bounded best."""
    return sets.select("k", F.array_join("items", ",").alias("items"), "hits").orderBy(F.desc("hits"), F.desc("items")).limit(cap)


def subsets_sql(family: str, chosen: list[str], least: int) -> str:
    """All frequent sets of the chosen conditions by enumeration, in the comparison engine's SQL: every subset's mask
    against every distinct mask of a bar. x: the bars and their masks; sets: mask, k, items, hits."""
    d, names = DUCK, sorted(chosen)
    bit = "CASE condition " + " ".join(f"WHEN '{n}' THEN {1 << i}" for i, n in enumerate(names)) + " END"
    word = " || ',' || ".join(f"CASE WHEN (m & {1 << i}) > 0 THEN '{n}' ELSE '' END" for i, n in enumerate(names))
    same = " OR ".join(f"((m & {1 << j}) > 0 AND EXISTS (SELECT 1 FROM same WHERE later = {1 << j}))" for j in range(len(names)))
    return f"""x AS (SELECT series, us, CAST(sum({bit}) AS BIGINT) AS mask FROM ({hits(d, family, chosen)}) h GROUP BY series, us),
u AS (SELECT mask, count(*) AS n FROM x GROUP BY mask), i AS (SELECT CAST(power(2, range) AS BIGINT) AS b FROM range({len(names)})),
same AS (SELECT q.b AS later FROM i p JOIN i q ON p.b < q.b JOIN u ON true GROUP BY p.b, q.b HAVING sum(CASE WHEN ((mask & p.b) > 0) <> ((mask & q.b) > 0) THEN n ELSE 0 END) = 0),
s AS (SELECT range AS m FROM range(1, {1 << len(names)})),
sets AS (SELECT m AS mask, CAST(bit_count(m) AS INTEGER) AS k, trim(regexp_replace({word}, ',+', ',', 'g'), ',') AS items, CAST(sum(n) AS BIGINT) AS hits FROM s JOIN u ON (u.mask & s.m) = s.m WHERE NOT ({same}) GROUP BY m HAVING sum(n) >= {least})"""


def ranked_sql(family: str, chosen: list[str], least: int, top: int = 10) -> str:
    """ranked_sets by enumeration and self joins, for comparison."""
    hit_rows = "SELECT s.items AS condition, x.series, x.us FROM sets s JOIN x ON (x.mask & s.mask) = s.mask"
    shut = "SELECT a.items FROM sets a WHERE NOT EXISTS (SELECT 1 FROM sets b WHERE b.k = a.k + 1 AND b.hits = a.hits AND (a.mask & b.mask) = a.mask)"
    return f"WITH {subsets_sql(family, chosen, least)} SELECT lens, place, condition, score, condition IN ({shut}) AS closed FROM ({lenses(DUCK, edges_of(DUCK, hit_rows), top)}) r"


def finished(result: tuple[DataFrame, list[dict]]) -> DataFrame:
    """A ladder's sets; an error if its account says that it halted."""
    frame, accounts = result
    for a in accounts:
        if a.get("halted"):
            raise RuntimeError(f"the ladder halted at level {a['k']} with {a['candidates']} candidates")
    return frame


def closed(sets: DataFrame) -> DataFrame:
    """Frequent sets of which no set with one more item has as many hits."""
    drop = sets.where("k > 1").select("hits", "items", F.explode(F.sequence(F.lit(1), F.size("items"))).alias("i"))
    less = drop.select("hits", F.concat(F.slice("items", F.lit(1), F.col("i") - 1), F.slice("items", F.col("i") + 1, F.size("items"))).alias("items")).distinct()
    return sets.join(less, ["items", "hits"], "left_anti").select("k", "items", "hits")


def closed_sql(d: Dialect, family: str, chosen: list[str], least: int) -> str:
    """Closed pairs: frequent pairs without a frequent triple of equal hits, in SQL."""
    two, three = sets_sql(d, family, chosen, 2, least), sets_sql(d, family, chosen, 3, least)
    part = (lambda i: f"split(items, ',')[{i - 1}]") if d.spark else (lambda i: f"string_split(items, ',')[{i}]")
    shorter = " UNION ".join(f"SELECT {part(a)} || ',' || {part(b)} AS items, hits FROM ({three}) t" for a, b in ((1, 2), (1, 3), (2, 3)))
    return f"SELECT p.items, p.hits FROM ({two}) p LEFT JOIN ({shorter}) s ON p.items = s.items AND p.hits = s.hits WHERE s.items IS NULL"


def auto_threshold(items: DataFrame, universe: int, ceiling: int) -> int:
    """The least threshold whose ladder has at most `ceiling` sets: from universe - 1, halved until a ladder has more,
    then halved between. A threshold of one is taken if even that is within the ceiling."""

    def fits(least: int) -> bool:
        sets, accounts = ladder(items, least, universe, ceiling)
        return not any(a.get("halted") for a in accounts) and sets.count() <= ceiling

    good = max(1, universe - 1)
    while good > 1 and fits(good // 2):
        good //= 2
    bad = good // 2
    while good - bad > 1:
        middle = (good + bad) // 2
        good, bad = (middle, bad) if fits(middle) else (good, middle)
    return good


def every_name(d: Dialect, minutes: int = 60) -> str:
    """series, us and the names of all conditions true there, of each warm bar: the families and the crossings, from one
    context row for each bar, and not the trend's, whose state is a fold."""
    merged = {n: e for f in conditions.FAMILIES.values() for n, e in f(d).items()}
    listed = (lambda x: f"array_compact(array({x}))") if d.spark else (lambda x: f"list_filter([{x}], lambda v: v IS NOT NULL)")
    own = listed(", ".join(f"CASE WHEN {e} THEN '{n}' END" for n, e in merged.items()))
    crossed = listed(", ".join(f"CASE WHEN {n} THEN '{n}' END" for n in conditions.names_of_crossings()))
    both = f"concat(own, {crossed})" if d.spark else f"list_concat(own, {crossed})"
    return f"SELECT series, us, {both} AS names FROM ({conditions.crossings(d, conditions.context(d, minutes), f'series, us, bar_id, session, {own} AS own')}) x WHERE {WARM}"


def trend_names(d: Dialect) -> str:
    """The names of the trend's conditions that are true in a row of its states."""
    from candlewright.operators.trend import trend_conditions

    rows = ", ".join(f"CASE WHEN {e} THEN '{n}' END" for n, e in trend_conditions().items())
    return f"array_compact(array({rows}))" if d.spark else f"list_filter([{rows}], lambda v: v IS NOT NULL)"


def mine_all(spark, sf_dir: str, per_mille: int = 350, ceiling: int = 200_000) -> DataFrame:
    """Frequent sets over all conditions: families, crossings and trend, true on at least so many thousandths of the warm
    bars, without conditions that always hold, repeat another's bars, or imply one in the set. Bars stay one row each."""
    from candlewright.operators.trend import states

    text = f"SELECT xxhash64(w.series, w.us) AS bar, concat(w.names, coalesce(s.trend, array())) AS names FROM ({every_name(SPARK)}) w LEFT JOIN (SELECT series, us, {trend_names(SPARK)} AS trend FROM {{states}}) s ON s.series = w.series AND s.us = w.us"
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = keep(spark.sql(text, events=events, states=states(spark, sf_dir)))
    universe = rows.count()
    dead = spark.createDataFrame(conditions.implied_pairs(), "a string, b string")
    sets = finished(ladder(rows, -(-universe * per_mille // 1000), universe, ceiling, dead=dead))
    return sets.selectExpr("k", "array_join(items, ',') AS items", "hits")


def mine_all_sql(per_mille: int = 350) -> str:
    """The same by growing sets with later conditions and intersecting strings of bits, in the comparison engine's SQL."""
    from candlewright.operators.trend import states_sql

    d = DUCK
    dead = ", ".join(f"('{a}', '{b}')" for a, b in conditions.implied_pairs())
    return f"""WITH RECURSIVE w AS MATERIALIZED (SELECT *, CAST(row_number() OVER (ORDER BY series, us) - 1 AS INTEGER) AS bar FROM ({every_name(d)}) z), u AS (SELECT count(*) AS bars, CAST(ceil(count(*) * {per_mille} / 1000.0) AS BIGINT) AS least FROM w),
t AS (SELECT w.bar, {trend_names(d)} AS names FROM ({states_sql()}) s JOIN w ON w.series = s.series AND w.us = s.us), h AS MATERIALIZED (SELECT bar, unnest(names) AS condition FROM w UNION ALL SELECT bar, unnest(names) FROM t),
b AS (SELECT condition, bitstring_agg(bar, 0, 9999) AS bits, count(*) AS hits FROM h GROUP BY condition), one AS MATERIALIZED (SELECT min(condition) AS item, bits, hits FROM b, u WHERE hits >= least AND hits < bars GROUP BY bits, hits),
x AS (SELECT o.item, coalesce(list(p.other) FILTER (p.other IS NOT NULL), []) AS never FROM one o LEFT JOIN (SELECT a AS item, b AS other FROM (VALUES {dead}) v(a, b) UNION ALL SELECT b, a FROM (VALUES {dead}) v(a, b)) p ON p.item = o.item GROUP BY o.item),
r AS (SELECT 1 AS k, [item] AS items, bits, hits FROM one
  UNION ALL SELECT r.k + 1, list_append(r.items, o.item), r.bits & o.bits, bit_count(r.bits & o.bits) FROM r JOIN one o ON o.item > r.items[-1] JOIN x ON x.item = o.item, u WHERE bit_count(r.bits & o.bits) >= u.least AND NOT list_has_any(r.items, x.never))
SELECT k, array_to_string(items, ',') AS items, hits FROM r"""
