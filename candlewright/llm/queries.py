"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from candlewright.llm import revisits, secrets
from candlewright.llm.minhash import op5_minhash
from candlewright.llm.mixing import op6_mixing
from candlewright.llm.neighbours import op1_neighbours
from candlewright.llm.packing import op3_packing
from candlewright.llm.pii import op7_pii
from candlewright.llm.quality import op9_quality
from candlewright.llm.revisits import op8_revisits
from candlewright.llm.secrets import op2_secrets
from candlewright.llm.token_files import op10_token_files
from candlewright.llm.topk import op4_topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_neighbours": op1_neighbours,
        "op2_secrets": op2_secrets,
        "op3_packing": op3_packing,
        "op4_topk": op4_topk,
        "op5_minhash": op5_minhash,
        "op6_mixing": op6_mixing,
        "op7_pii": op7_pii,
        "op8_revisits": op8_revisits,
        "op9_quality": op9_quality,
        "op10_token_files": op10_token_files,
        "pipeline": pipeline,
    }


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py over the documents table."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


#: DuckDB SQL of op4_topk.
TOPK = """
WITH v AS (
  SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.k, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.k <> c.k
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_secrets": secrets.SQL, "op4_topk": TOPK, "op8_revisits": revisits.SQL}
