"""MinHash near-duplicates by a signature-coordinate inverted join (operator 5)."""

from __future__ import annotations

from functools import reduce
from math import floor, log, sqrt
from operator import add

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.llm.common import Stash, connected_components

#: Bits of a set's sketch.
SKETCH = 2048
ROW = "row long, doc_id long, n_shingles long, h1 long, h2 long, sig binary"


def match_threshold(coordinates: int, similarity: float) -> int:
    """Signature matches below which a pair at the similarity falls with a chance of about 1e-7: 5.2 deviations."""
    return max(1, floor(coordinates * similarity - 5.2 * sqrt(coordinates * similarity * (1 - similarity))))


def signatures(rows: DataFrame, width: int, coordinates: int, seed: int) -> DataFrame:
    """row, doc_id, size and 128-bit name of each whole text's shingle set, and its signature."""

    def task(batches):
        import pyarrow as pa

        from candlewright.llm import shingles as S

        flips, odds = S.permutations(coordinates, seed)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                some = batch.slice(lo, 1000)
                sizes, names, sigs = [], [], []
                for s in S.shingle_sets(some.column(2).to_pylist(), width):
                    sizes.append(len(s))
                    names.append(S.set_key(s))
                    sigs.append(S.signature(s, flips, odds).tobytes())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(sizes, pa.int64()), pa.array([x for x, _ in names], pa.int64()), pa.array([x for _, x in names], pa.int64()), pa.array(sigs, pa.binary())], names=["row", "doc_id", "n_shingles", "h1", "h2", "sig"])

    return rows.select("row", "doc_id", "text").mapInArrow(task, ROW)


def _postings(reps: DataFrame, coordinates: int) -> DataFrame:
    """Each representative under each of its coordinate-value pairs; the pair is one 64-bit key."""

    def task(batches):
        import numpy as np
        import pyarrow as pa

        places = np.arange(coordinates, dtype=np.uint64) << np.uint64(32)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4000):
                some = batch.slice(lo, 4000)
                sig = np.frombuffer(b"".join(some.column(1).to_pylist()), dtype="<u4").reshape(-1, coordinates)
                key = (sig.astype(np.uint64) | places).view(np.int64).reshape(-1)
                rep = np.repeat(some.column(0).to_numpy(), coordinates)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(rep)], names=["key", "rep"])

    return reps.select("rep", "sig").mapInArrow(task, "key long, rep long")


def _agree(pairs: DataFrame, reps: DataFrame, least: int) -> DataFrame:
    """Pairs whose whole signatures collide in at least `least` coordinates."""

    def task(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u4").reshape(batch.num_rows, -1) for c in (2, 3))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    side = lambda c: reps.select(F.col("rep").alias(c), F.col("sig").alias(f"sig_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(task, "a long, b long")


def _mixed(lists: DataFrame, sets: DataFrame, num: int, den: int, stash: Stash) -> DataFrame:
    """Pairs of differing components that posting lists still mix, as far as their full sets can be similar.

    lists: rep, n, comp of the members of such lists. Two sets at the similarity share one of the first
    (n - ceil(similarity * n) + 1) elements of each, in any common order; with the rarest first, what a copy has of
    its own fills its prefix, and copies too far apart never meet. Of a list's pairs, only those with a member outside
    its commonest component meet, each once: the larger looks for the smaller. A set is posted by its size, in steps of
    2 %, if what it has from the element on would do for a set of its own size. As the larger it is dealt to those posted
    sizes alone that what it has from the element on still allows: at most 13 at 80 %, however many the element has, and
    none where nobody is to be met. A pair that meets is kept if its sets can still be similar:
    what both have from the shared element on is enough, and their sketches differ in no more bits than the sets may
    differ in elements. Those of a large group that are left meet in pairs within the join, and few leave it.
    """

    def task(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for rep, s in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(s.as_buffer(), dtype="<i8")
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), rep, dtype=np.int64))], names=["gram", "rep"])

    members = stash.put(lists.select("rep", "n", "comp").distinct(), "mixed")
    grams = stash.put(sets.join(members, "rep").select("rep", "set").mapInArrow(task, "gram long, rep long").distinct(), "grams")
    shared = grams.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    ranked = grams.join(shared, "gram").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("own")).join(members, "rep")
    alone = F.col("n") - F.size("own")
    first = F.col("n") - F.ceil(F.col("n") * num / den) + 1 - alone
    kept = ranked.where(first > 0).select("rep", "n", "comp", F.size("own").alias("others"), F.posexplode(F.slice("own", F.lit(1), first.cast("int"))).alias("at", "k"))
    kept = kept.select(F.col("k.gram").alias("gram"), "rep", "n", "comp", (F.col("others") - F.col("at")).alias("left"))  # left: elements from this one on
    kept = stash.put(kept, "gram-prefix")
    main = kept.groupBy("gram", "comp").agg(F.count("*").alias("c")).groupBy("gram").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1")
    main = stash.put(main, "main")
    most = F.floor(F.col("left") * (den + num) / num)  # elements that a pair's two sets may have together, for this one's sake
    step = lambda n: F.floor(F.log(n) / log(1.02)).cast("int")
    dealt = kept.join(main.select("gram", "main"), "gram").select("gram", "rep", "n", "comp", most.alias("most"), (F.col("comp") != F.col("main")).alias("out"))
    dealt = dealt.withColumn("low", F.ceil(F.col("n") * num / den)).withColumn("high", F.least("n", F.col("most") - F.col("n"))).where("low <= high")  # sizes of smaller sets
    size = 2 * step("n")  # odd keys: those outside the commonest component alone
    smaller = dealt.where("high = n").withColumn("key", F.explode(F.when(F.col("out"), F.array(size, size + 1)).otherwise(F.array(size))))
    smaller = stash.put(smaller.join(sets.select("rep", "sketch"), "rep"), "smaller")
    there = smaller.groupBy("gram").agg(F.collect_set("key").alias("keys"))
    larger = dealt.join(there, "gram").withColumn("from", 2 * step("low")).withColumn("to", 2 * step("high") + 1)
    mine = lambda k: k.between(F.col("from"), F.col("to")) & (F.col("out") == (k % 2 == 0))
    larger = larger.withColumn("key", F.explode(F.filter("keys", mine))).drop("keys", "from", "to")
    larger = stash.put(larger.join(sets.select("rep", "sketch"), "rep"), "larger")
    side = lambda rows, c: rows.select("gram", "key", F.col("rep").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", "comp", "most", "sketch")])
    both = F.col("n_a") + F.col("n_b")
    ordered = (F.col("n_b") < F.col("n_a")) | ((F.col("n_b") == F.col("n_a")) & (F.col("b") < F.col("a")))
    enough = (F.col("n_b") * den >= F.col("n_a") * num) & (both <= F.least("most_a", "most_b"))
    bits = reduce(add, [F.bit_count(F.col("sketch_a")[k].bitwiseXOR(F.col("sketch_b")[k])) for k in range(SKETCH // 64)])
    near = bits * (den + num) <= both * (den - num)
    met = side(larger, "a").join(side(smaller, "b"), ["gram", "key"]).where((F.col("comp_a") != F.col("comp_b")) & ordered & enough & near)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _confirm(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs with den * |intersection| >= num * |union| on the full sets."""

    def task(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype="<u8") for v in (x, y))
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: sets.select(F.col("rep").alias(c), F.col("set").alias(f"set_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(task, "a long, b long")


def _full_sets(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Full shingle sets of the wanted representatives, recomputed from their own rows' texts, with their sketches: one
    for each."""

    def task(batches):
        import pyarrow as pa

        from candlewright.llm import shingles as S

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                some = batch.slice(lo, 500)
                sets, sketches = [], []
                for s in S.shingle_sets(some.column(1).to_pylist(), width):
                    sets.append(s.astype("<u8").tobytes())
                    sketches.append(S.sketch(s, SKETCH))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sets, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))], names=["rep", "set", "sketch"])

    texts = rows.select(F.col("row").alias("rep"), "text")
    return wanted.select("rep").join(texts, "rep").select("rep", "text").mapInArrow(task, "rep long, set binary, sketch array<long>")


def _linked(rows: DataFrame, stash: Stash, width: int, similarity: tuple[int, int], coordinates: int, seed: int, hub_rounds: int) -> DataFrame:
    """row, doc_id, n_shingles, low (smallest doc_id reachable by links, itself included) and head (of the rows that are
    linked, the one of smallest doc_id, then of smallest row; rows without a doc_id come last).

    rows: a table with row (unique), doc_id, text. Rows of equal sets form one class, named by its smallest row. Classes are posted under every coordinate-
    value pair of their signatures. Two classes at the similarity agree in at least t coordinates (match_threshold),
    so of the values that anyone shares, in order of frequency with the rarest first, they have one in common among
    the first (shared values - t + 1): only that prefix is joined, and classes with fewer than t shared values are
    skipped. Common passages are the most frequent values and stay out of prefixes.

    Pairs of one posting list aren't all emitted. In each hub round a list elects a member, and members of other
    components are compared with it; links merge components. What then still shares a list but not a component is
    joined by the rarest elements of their full sets (_mixed), so no link between components is lost and a group of n
    near copies costs about n comparisons for each of its lists, besides the pairs that _mixed drops by sketches. Compared pairs are counted on the whole signature and confirmed on full sets.

    Texts without words have no shingles and link with nothing: low is their doc_id, head their row.
    """
    num, den = similarity
    least = match_threshold(coordinates, num / den)
    ratio = F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num
    signed = stash.put(signatures(rows, width, coordinates, seed), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    classes = signed.where("n_shingles > 0").groupBy("n_shingles", "h1", "h2").agg(F.min("row").alias("rep"), first.alias("first"), F.first("sig").alias("sig"))
    reps = stash.put(classes, "classes")
    posts = _postings(reps, coordinates)
    shared = stash.put(posts.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    listed = posts.join(shared, "key").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("keys")).where(F.size("keys") >= least)
    prefix = listed.select("rep", F.explode(F.slice("keys", F.lit(1), F.size("keys") - (least - 1))).alias("k")).select("rep", F.col("k.key").alias("key"))
    prefix = stash.put(prefix.join(reps.select("rep", "n_shingles"), "rep").select("key", "rep", F.col("n_shingles").alias("n")), "prefix")
    wanted = prefix.join(prefix.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "key").select("rep").distinct()
    sets = stash.put(_full_sets(rows, wanted, width), "sets", arrow_rows=250)
    posts = prefix
    labels = links = seen = None
    for turn in range(hub_rounds + 1):
        at = posts.withColumn("comp", F.col("rep")) if labels is None else posts.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("comp"))
        order = F.col("rep") if turn == 0 else F.xxhash64("rep", "key", F.lit(turn))
        lists = at.groupBy("key").agg(F.min(F.struct(order.alias("o"), F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("comp").alias("comp_b"))).alias("hub"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
        lists = stash.put(lists, "lists")  # a table, so that Spark can split a hot list's rows in the joins on it
        member = at.select("key", F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("comp").alias("comp_a"))
        if turn < hub_rounds:
            met = member.join(lists.select("key", "hub.b", "hub.n_b", "hub.comp_b"), "key").where("comp_a <> comp_b").where(ratio)
            pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        else:
            pairs = _mixed(at.join(lists.select("key"), "key"), sets, num, den, stash)
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = stash.put(pairs, "pairs")
        seen = pairs if seen is None else seen.unionByName(pairs)
        if pairs.isEmpty():
            if turn < hub_rounds:
                continue
            break
        found = stash.put(_confirm(_agree(pairs, reps, least), sets, num, den), "links", arrow_rows=100)
        links = found if links is None else links.unionByName(found)
        if turn == hub_rounds and found.isEmpty():
            break
        labels = connected_components(links, stash)
    named = reps.select("n_shingles", "h1", "h2", "rep", "first")
    if labels is None:
        named = named.select("n_shingles", "h1", "h2", F.col("first.doc_id").alias("low"), F.col("first.row").alias("head"))
    else:
        named = named.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        heads = stash.put(named.groupBy("component").agg(F.min("first").alias("whole")), "heads")
        named = named.join(heads, "component").select("n_shingles", "h1", "h2", F.col("whole.doc_id").alias("low"), F.col("whole.row").alias("head"))
    named = stash.put(named, "named")  # a table, so that Spark can split a hot class's rows in the join
    out = signed.select("row", "doc_id", "n_shingles", "h1", "h2").join(named, ["n_shingles", "h1", "h2"], "left")
    return out.select("row", "doc_id", "n_shingles", F.coalesce("low", F.when(F.col("head").isNull(), F.col("doc_id"))).alias("low"), F.coalesce("head", "row").alias("head"))


def near_duplicates(docs: DataFrame, stash: Stash, width: int = 5, similarity: tuple[int, int] = (80, 100), coordinates: int = 64, seed: int = 7, hub_rounds: int = 2) -> DataFrame:
    """Link documents whose shingle sets have Jaccard similarity of at least similarity[0] / similarity[1] (_linked).

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included), kept (doc_id =
    component_id), one row for each row of docs; its other columns are ignored, whatever their names.

    Null or empty texts, and texts without words, have no shingles and link with nothing. Rows are compared by their own
    texts: rows that repeat a doc_id get the same component if their texts are linked, and else each its own. A row with
    a null doc_id links like any other, but names no component: it gets its size, a null component_id and kept = false.
    Ties don't arise: every choice is by smallest id. An empty table gives no rows.
    """
    rows = stash.put(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), "rows")
    found = _linked(rows, stash, width, similarity, coordinates, seed, hub_rounds)
    own = F.when(F.col("doc_id").isNotNull(), F.col("low"))
    return found.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, stash: Stash, width: int = 5, similarity: tuple[int, int] = (80, 100), coordinates: int = 64, seed: int = 7, hub_rounds: int = 2) -> DataFrame:
    """docs with one row of each group of linked rows: the one of smallest doc_id (rows without one come last), and of
    equal doc_ids the first as read. All columns stay, whatever their names.

    Rows are numbered in a table and decided upon one by one, so rows that repeat a doc_id with other texts are judged by
    their own. Rows without words link with nothing and all stay. An empty table gives no rows.
    """
    number = "row"
    while number.lower() in {c.lower() for c in docs.columns}:
        number += "_"
    table = stash.put(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    rows = table.select(F.col(number).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    gone = stash.put(_linked(rows, stash, width, similarity, coordinates, seed, hub_rounds).where("row <> head").select(F.col("row").alias(number)), "gone")
    return table.join(gone, number, "left_anti").select(*docs.columns)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, linked at 85 % of three-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), Stash(spark, "op5"), width=3, similarity=(85, 100))
