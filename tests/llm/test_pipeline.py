"""The pipeline stage by stage, each against a plain version on its own input."""

import collections
import zlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from pyspark.sql import functions as F  # noqa: E402

from candlewright.llm import common, mixing, quality, secrets  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from tests.llm.test_operators import brute

    stash = common.Stash(spark, "test-pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stash.put(stage(spark, docs, SF), name)
        kept[name] = (docs, out)
        if name != "packing":
            assert out.columns == docs.columns
        docs = out
    before, after = kept["quality"]
    scores = quality.classify(before, spark.read.parquet(f"{SF}/labels.parquet"), stash).toPandas()
    assert {r.doc_id for r in after.collect()} == set(scores[scores.predicted == 1].doc_id)
    before, after = kept["near_duplicate"]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    _, comp = brute([t for _, t in rows], 5, 80)
    assert {r.doc_id for r in after.collect()} == {rows[i][0] for i in set(comp.values())}
    before, after = kept["secrets"]
    assert after.count() == before.count() and secrets.scan(after, stash).where("exists(found, s -> s.kind in ('access', 'hex', 'github'))").count() == 0
    before, after = kept["mixing"]
    labelled = mixing.labelled_domains(before, spark.read.parquet(f"{SF}/labels.parquet"))
    wanted = mixing.mix(before, labelled, stash, factors=mixing.production_factors(labelled)).toPandas()
    times = collections.Counter(r.doc_id for r in after.collect())
    assert times == collections.Counter({r.doc_id: r.copies for r in wanted.itertuples() if r.copies})
    p = np.array(wanted.posterior.tolist())
    now, got = ((p * (wanted.tokens * by).to_numpy()[:, None]).sum(axis=0) for by in (1.0, wanted.rate))
    want = now * np.array([0.1 if d.endswith("/toxic") else 1.0 for d in wanted.domains[0]])
    assert np.allclose(got / got.sum(), want / want.sum(), rtol=0.01) or wanted.missed.max() >= 1e-4
    before, after = kept["packing"]
    pieces = after.toPandas()
    assert set(pieces.doc_id) == {r.doc_id for r in before.select("doc_id").collect()}
    assert pieces.groupby("sequence_id").length.sum().max() <= 2048
    whole = pieces.groupby("doc_id").agg(n=("length", "sum"), t=("doc_tokens", "first"))
    assert np.all(whole.n % whole.t == 0)
    assert corpus_pipeline.ORACLE_SQL is None


def odd_rows(spark):
    """Documents of sf0.001 with nulls in any column, empty, very long and repeated texts, and clashing names."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = docs.first().text
    rows = [(9001, None, "en", "s", 0), (9002, "", None, "s", None), (None, text, "en", None, 5), (9003, None, None, None, None), (None, None, None, None, None)]
    rows += [(9004, "word " + text * 40, "en", "s", 1), (9005, "token=abcdefghij " + text, "en", "s", 1), (9005, "token=abcdefghij " + text, "en", "s", 1), (9005, "other " * 30 + text[::-1], "de", "s", 1)]
    whole = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    return whole.select("*", *[F.lit("own").alias(c) for c in ("row", "found", "rate", "posterior", "key", "copy", "rules", "hash")])


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, name):
    from tests.llm.test_operators import TOKENIZER, brute

    stage, stash = dict(corpus_pipeline.STAGES)[name], common.Stash(spark, "test-odd")
    docs = stash.put(odd_rows(spark), "odd")
    out = stash.put(stage(spark, docs, SF), name)
    before, after = docs.collect(), out.collect()
    key = lambda r: (r.doc_id, r.text)
    if name != "packing":
        assert out.columns == docs.columns
        assert all(r.row == r.found == r.rate == "own" for r in after)
    assert stage(spark, docs.limit(0), SF).count() == 0
    if name == "quality":
        scores = quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet"), stash).collect()
        assert len(scores) == len(before) and len(after) == sum(r.predicted for r in scores)
    if name == "near_duplicate":
        _, comp = brute([r.text for r in before], 5, 80)
        best = {}
        for k, r in enumerate(before):
            best[comp[k]] = min(best.get(comp[k], (2, 0)), (int(r.doc_id is None), r.doc_id or 0))
        assert sorted((int(r.doc_id is None), r.doc_id or 0) for r in after) == sorted(best.values())
    if name == "secrets":
        assert len(after) == len(before) and sum(r.text is None for r in after) == 3
        assert sum(bool(r.text and r.text.startswith("[assign] ")) for r in after) == 2
        assert all(r.n_chars == len(r.text or "") for r in after)
    if name == "mixing":
        labelled = mixing.labelled_domains(docs, spark.read.parquet(f"{SF}/labels.parquet"))
        copies = mixing.mix(docs, labelled, stash, factors=mixing.production_factors(labelled)).agg(F.sum("copies")).first()[0]
        assert len(after) == copies and set(map(key, after)) <= set(map(key, before))
    if name == "packing":
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(TOKENIZER)
        ids = [np.array(t.encode(r.text or "", add_special_tokens=False).ids + [1], dtype="<u4") for r in before]
        want = collections.Counter()
        for r, x in zip(before, ids, strict=True):
            want[r.doc_id] += len(x)
        got = collections.Counter()
        for r in after:
            got[r.doc_id] += r.length
        assert got == want
        by = collections.defaultdict(list)
        for r, x in zip(before, ids, strict=True):
            by[r.doc_id].append(x)
        assert all(any(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in by[r.doc_id]) for r in after)
