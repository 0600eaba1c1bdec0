"""Personal data by weak supervision, in DataFrame functions alone (operator 7).

Regex, gazetteer and context labelers propose spans; they and two more (shape, and company: personal data of another
kind in the same text) vote on every span proposed. Expectation-maximisation over the counts of vote patterns estimates
how reliable each labeler is; its posteriors are the soft labels of a final naive Bayes classifier of spans. Base spans,
which a regular expression and its test define, always stay; the classifier adds others.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.llm.common import Stash
from candlewright.llm.spans import bind, joined, running, spans

#: Gazetteers of top-level domains, country calling codes, given names, country codes of bank accounts.
DOMAINS = ("at", "be", "ch", "com", "de", "edu", "es", "eu", "fr", "gov", "info", "io", "it", "net", "nl", "org", "uk", "us")
CALLING = ("1", "31", "32", "33", "34", "39", "41", "43", "44", "49", "52", "54", "61", "81", "86", "91")
GIVEN = (
    "Alice", "Andreas", "Anna", "Antonio", "Carlos", "Carmen", "Charles", "Claire", "Daniel", "David", "Elena", "Elizabeth", "Emma", "Francois", "Hans", "Isabel", "James", "Jean", "John", "José",
    "Juan", "Julia", "Karl", "Laura", "Lucía", "Luis", "Maria", "María", "Marie", "Mary", "Michael", "Nicole", "Paul", "Peter", "Pierre", "Robert", "Sarah", "Sophie", "Stefan", "Thomas", "Ursula", "William",
)
BANKS = ("AT", "BE", "CH", "DE", "ES", "FR", "GB", "IT", "NL", "PT")
#: What introduces a person's name or a street number's street.
TITLES = r"(?=\p{Lu})(?<=\x20)(?<=(?:[Mm]y name is|[Ii]ch hei[sß]e|[Jj]e m'appelle|[Mm]e llamo|Mr\.?|Mrs\.?|Ms\.?|Dr\.?|Herr|Frau|Señora?|Madame|Monsieur)\x20)"

#: The kinds in their order. The first four are the base; the others are candidates only, each proposed
#: by a labeler: a pattern, a gazetteer or a context. Possessive repeats and the bounds to the left change no match of
#: the base; they keep long runs from being searched again.
BASE = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "account": r"(?<![0-9A-Za-z.+-])[0-9]{8,12}(?![0-9A-Za-z])",
    "local": r"(?<![0-9+)(.-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[-.\x20])[0-9]{3,4}[-.\x20][0-9]{3,4}(?![0-9-])",
    "social": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "spelled": r"(?i)(?<![a-z0-9._-])[a-z0-9._-]{2,64}+\x20?[\[(]at[\])]\x20?[a-z0-9-]{2,64}+(?:\x20?[\[(]dot[\])]\x20?[a-z0-9-]{2,24}+)+",
    "iban": r"(?<![A-Z0-9])(?:" + "|".join(BANKS) + r")[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Z0-9])",
    "given": r"(?=[A-Z])(?<![\p{L}\p{N}])(?:" + "|".join(GIVEN) + r")\x20\p{Lu}\p{Ll}{1,24}(?![\p{L}\p{N}])",
    "titled": TITLES + r"\p{Lu}\p{Ll}{1,24}(?:\x20\p{Lu}\p{Ll}{1,24})?(?![\p{L}\p{N}])",
}
KINDS = tuple(PATTERNS)
#: Which labeler proposes a kind; what a text must hold to be searched for it at all.
PROPOSED = {"given": "gazetteer", "iban": "gazetteer", "titled": "context"}
HOLDS = {"email": "@", "phone": "+", "spelled": "at"}
#: Words before a span that speak for its kind, and words that speak against any.
NAMED = r"name|author|signed|contact|dear|herr|frau|monsieur|madame|señor|m[rs]s?\.?\x20$|dr\.?\x20$"
CUES = {
    "email": r"e-?mail|contact|write to|correo|kontakt|courriel",
    "ip": r"\bip\b|address|host|server|client|login",
    "card": r"card|visa|mastercard|credit|karte|carte|tarjeta",
    "phone": r"phone|tel\b|call|mobile|fax|telefon|t[eé]l[eé]phone|tel[eé]fono",
    "account": r"account|iban|passport|ssn|social security|konto|compte|cuenta",
    "given": NAMED, "titled": NAMED,
}
CUES |= {"local": CUES["phone"], "social": CUES["account"], "spelled": CUES["email"], "iban": CUES["account"]}
AGAINST = r"version|isbn|licen[cs]e|release|chapter|page|order|invoice|\bno\.|\brev\b"
VOTERS = ("pattern", "gazetteer", "context", "shape", "company")

CANDIDATES = "array<struct<order:int,start:int,end:int,kind:string,base:boolean,votes:string,features:array<string>>>"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _octet(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+(?=.)", "")
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))


def _valid(kind: str, hit: Column) -> Column:
    """The test that a base match must pass."""
    n = F.length(_digits(hit))
    tests = {
        "email": lambda: F.lit(True),
        "ip": lambda: F.forall(F.split(hit, r"\.", -1), _octet),
        "card": lambda: n.between(13, 19) & F.call_function("luhn_check", F.when(n.between(13, 19), _digits(hit)).otherwise(F.lit("1"))),
        "phone": lambda: n.between(9, 15),
    }
    return tests[kind]() if kind in tests else F.lit(False)


def _vote(for_it: Column, against: Column | None = None) -> Column:
    """1, 0, or - for abstaining."""
    no = ~for_it if against is None else against
    return F.when(for_it, "1").when(no, "0").otherwise("-")


def _candidates(kind: str, order: int, text: Column) -> Column:
    found = spans(text, PATTERNS[kind], context=True)
    if kind in HOLDS:
        found = F.when(text.contains(HOLDS[kind]), found)
    one_word = r"^[0-9]+$"

    def one(s: Column) -> Column:
        hit, digits = s["hit"], _digits(s["hit"])
        before = F.lower(s["left"])
        left = F.when(s["start"] == 0, "^").otherwise(F.right(s["left"], F.lit(1)))
        char = lambda c: F.when(c.isin("", "^"), "edge").when(c.rlike(r"\s"), "space").when(c.rlike(r"[\p{L}\p{N}]"), "word").otherwise("mark")
        valid = _valid(kind, hit)
        known = {
            "email": lambda: _vote(F.regexp_extract(hit, r"([A-Za-z0-9-]+)$", 1).isin(*DOMAINS)),
            "ip": lambda: _vote(~F.regexp_extract(hit, r"^([0-9]+)", 1).rlike(r"^0*(?:0|22[4-9]|2[3-9][0-9]|[0-9]{4,})$")),
            "card": lambda: _vote(digits.rlike("^[3-6]")),
            "phone": lambda: _vote(digits.rlike("^(?:" + "|".join(CALLING) + ")")),
            "given": lambda: F.lit("1"),
            "iban": lambda: F.lit("1"),
            "titled": lambda: _vote(F.regexp_extract(hit, r"^(\S+)", 1).isin(*GIVEN), F.lit(False)),
        }.get(kind, lambda: F.lit("-"))()
        context = F.lit("1") if PROPOSED.get(kind) == "context" else _vote(before.rlike(CUES[kind]), before.rlike(AGAINST))
        shape = {
            "email": lambda: _vote(hit.rlike(r"^[^@]{1,64}@.{3,}\.[A-Za-z]{2,}$")),
            "ip": lambda: _vote(valid),
            "card": lambda: _vote((hit.rlike(one_word) | hit.rlike(r"^[0-9]{4}([\x20-])[0-9]{4,6}\1[0-9]{4,5}(?:\1[0-9]{4})?$")) & F.length(digits).between(15, 16)),
            "phone": lambda: _vote(valid),
            "given": lambda: F.lit("-"),
            "titled": lambda: F.lit("-"),
        }.get(kind, lambda: _vote(digits.rlike("^(?!([0-9])\\1*$)")))()
        checked = F.lit("-") if kind in PROPOSED else _vote(valid) if kind in BASE else F.lit("1") if kind in ("social", "spelled", "local") else F.lit("-")
        size = F.least(F.floor(F.length(hit) / 4), F.lit(8)).cast("string")
        n = F.least(F.floor(F.length(digits) / 3), F.lit(7)).cast("string")
        features = F.array(*[F.concat_ws("=", F.lit(f"{kind}.{name}"), value) for name, value in (("left", char(left)), ("right", char(s["right"])), ("size", size), ("digits", n), ("shape", shape), ("known", known), ("context", context))])
        base = valid if kind in BASE else F.lit(False)
        return F.struct(F.lit(order).alias("order"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), base.alias("base"), F.concat(checked, known, context, shape).alias("votes"), features.alias("features"))

    return F.coalesce(F.transform(found, one), F.array()).cast(CANDIDATES)


def _free(found: Column) -> Column:
    """The candidates in order of start, without those that overlap a base span; the base spans stay."""

    def cleared(rows: Column) -> Column:
        top = 2**31 - 1
        ends = running(rows, F.lit(0), lambda c: F.when(c["base"], c["end"]).otherwise(0), lambda a, b: F.greatest(a, b), "int")
        back = F.reverse(running(F.reverse(rows), F.lit(top), lambda c: F.when(c["base"], c["start"]).otherwise(top), lambda a, b: F.least(a, b), "int"))
        near = F.zip_with(ends, back, lambda a, b: F.struct(a.alias("before"), b.alias("after")))
        both = F.zip_with(rows, near, lambda c, n: F.struct(c.alias("c"), n.alias("n")))
        return F.transform(F.filter(both, lambda x: x["c"]["base"] | ((x["n"]["before"] <= x["c"]["start"]) & (x["n"]["after"] >= x["c"]["end"]))), lambda x: x["c"])

    first = lambda c: F.struct(c["start"].alias("start"), F.when(c["base"], 0).otherwise(1).alias("rank"), c["order"].alias("order"), c.alias("c"))
    in_order = F.transform(F.sort_array(F.transform(found, first)), lambda s: s["c"])
    return F.when(F.exists(found, lambda c: ~c["base"]), bind(in_order, cleared)).otherwise(found)


def _with_company(found: Column) -> Column:
    """The candidates with the vote of the last labeler: 1 where the text holds a base span of another kind."""

    def seen(kinds: Column) -> Column:
        def one(c: Column) -> Column:
            vote = F.when(F.size(F.array_except(kinds, F.array(c["kind"]))) > 0, "1").otherwise("0")
            return F.struct(c["order"].alias("order"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), c["base"].alias("base"), F.concat(c["votes"], vote).alias("votes"), F.concat(c["features"], F.array(F.concat(c["kind"], F.lit(".company="), vote))).alias("features"))

        return F.transform(found, one)

    return bind(F.array_distinct(F.transform(F.filter(found, lambda c: c["base"]), lambda c: c["kind"])), seen)


def reliabilities(patterns: list[tuple[str, str, int]], rounds: int = 60) -> tuple[dict[tuple[str, str], float], dict]:
    """Expectation-maximisation over counted vote patterns (kind, votes, count): the posterior of each pattern, and the
    labelers' rates of voting 1 for personal spans and for others. Abstaining says nothing. A pattern's test and a
    gazetteer are labelers of their own for each kind; context, shape and company are the same for all kinds."""
    post = {(k, v): (1 + v.count("1")) / (2 + v.count("1") + v.count("0")) for k, v, _ in patterns}
    who = lambda kind, name: f"{kind}.{name}" if name in ("pattern", "gazetteer") else name
    rates: dict = {}
    for _ in range(rounds):
        prior, hits = {}, {}
        for kind, votes, n in patterns:
            p = post[kind, votes]
            a, b = prior.get(kind, (2.0, 2.0))
            prior[kind] = (a + n * p, b + n * (1 - p))
            for name, v in zip(VOTERS, votes, strict=True):
                if v != "-":
                    t, f, u, w = hits.get(who(kind, name), (4.0, 1.0, 1.0, 4.0))  # a labeler is better than chance beforehand
                    hits[who(kind, name)] = (t + n * p * (v == "1"), f + n * p * (v == "0"), u + n * (1 - p) * (v == "1"), w + n * (1 - p) * (v == "0"))
        rates = {name: (t / (t + f), u / (u + w)) for name, (t, f, u, w) in hits.items()}
        for kind, votes, _ in patterns:
            z = log(prior[kind][0] / prior[kind][1])
            for name, v in zip(VOTERS, votes, strict=True):
                if v != "-":
                    yes, no = rates[who(kind, name)]
                    z += log(yes / no) if v == "1" else log((1 - yes) / (1 - no))
            post[kind, votes] = 1 / (1 + exp(-max(-60.0, min(60.0, z))))
    return post, rates


def _literal_map(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for k, v in sorted(values.items()) for x in (k, float(v))])


def detect(docs: DataFrame, stash: Stash, least: float = 0.9) -> DataFrame:
    """doc_id and `found`: personal spans as (order, start, end, kind, base), by kind and then start.

    docs: doc_id and text; other columns are ignored. The tables that reach the driver are counts by vote pattern and
    by feature value, whose number is fixed by the labelers. A candidate that isn't base, whether it fails its base test
    or a labeler proposes it, is added as <kind>_like if the classifier gives it a probability of at least `least` and
    it overlaps no base span.

    Null or empty text has no spans; every row of docs gives one row, repeated or null doc_ids too. Spans of one kind
    never overlap; those of different kinds may. An empty table gives no rows.
    """
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    each = F.concat(*[_candidates(k, i, text) for i, k in enumerate(KINDS)])
    rows = stash.put(rows.select("doc_id", bind(each, lambda c: bind(_free(c), _with_company)).alias("found")), "candidates")
    each = rows.select(F.explode("found").alias("c"))
    counted = each.groupBy("c.kind", "c.votes").agg(F.count("*").alias("n")).collect()
    post, _ = reliabilities([(r.kind, r.votes, r.n) for r in counted])
    none = F.array().cast(CANDIDATES)
    if not post:
        return rows.select("doc_id", none.alias("found"))
    soft = F.element_at(_literal_map({f"{k}/{v}": p for (k, v), p in post.items()}), F.concat_ws("/", "c.kind", "c.votes"))
    sums = each.select(soft.alias("p"), F.explode(F.concat("c.features", F.array(F.concat(F.col("c.kind"), F.lit(".all"))))).alias("feature")).groupBy("feature").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    total = {r.feature.split(".")[0]: (r.yes + 1, r.no + 1) for r in sums if r.feature.endswith(".all")}
    weights = {}
    for r in sums:
        yes, no = total[r.feature.split(".")[0]]
        weights[r.feature] = log(yes / no) if r.feature.endswith(".all") else log((r.yes + 1) / (yes + 8)) - log((r.no + 1) / (no + 8))
    table = _literal_map(weights)
    score = lambda c: F.aggregate(c["features"], F.element_at(table, F.concat(c["kind"], F.lit(".all"))), lambda z, f: z + F.coalesce(F.element_at(table, f), F.lit(0.0)))
    kept = F.filter("found", lambda c: c["base"] | (score(c) >= log(least / (1 - least))))
    named = F.transform(kept, lambda c: F.struct((c["order"] + F.when(c["base"], 0).otherwise(len(KINDS))).alias("order"), c["start"].alias("start"), c["end"].alias("end"), F.when(c["base"], c["kind"]).otherwise(F.concat(c["kind"], F.lit("_like"))).alias("kind"), c["base"].alias("base")))
    return rows.select("doc_id", F.sort_array(named).alias("found"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents, as counts, digest and spans."""
    found = detect(spark.read.parquet(f"{sf_dir}/documents.parquet"), Stash(spark, "op7"))
    of = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[of(k) for k in BASE], F.sha2(joined(F.filter("found", lambda s: s["base"])), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
