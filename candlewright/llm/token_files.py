"""Token ids as Parquet list columns, with selective reads of tokens and metadata (operator 10)."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewright.llm.common import Stash
from candlewright.llm.tokens import encoder

#: Writer settings of the format: ids by dictionary, counters by delta; row groups and pages of fixed size, so that a
#: reader of a few documents skips the others by the page index, and a reader of metadata never touches the ids.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
}


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, stash: Stash, name: str = "tokens") -> DataFrame:
    """Tokenize whole documents and write them in ascending doc_id order; returns a frame over the files.

    Files hold part int, first long (ids before the document in its part), doc_id, n_tokens long, ids array<int>. Parts
    are ranges of (doc_id, hash of the text), so repeats of one doc_id spread too. Order: null doc_ids first, then
    ascending, repeats by the text's hash and text. Null or empty text is the end id alone. An empty table gives no
    rows. Other columns of docs are ignored.
    """
    ranged = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")

    def task(batches):
        import numpy as np
        import pyarrow as pa

        encode, end, first = encoder(tokenizer).batch, np.array([end_id], dtype="<u4").tobytes(), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                some = batch.slice(lo, 1000)
                parts = [x + end for x in encode(some.column(2))]
                sizes = np.array([len(p) // 4 for p in parts], dtype=np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(parts), dtype="<i4")))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(first + ends[:-1]), some.column(1), pa.array(sizes), ids], names=["part", "first", "doc_id", "n_tokens", "ids"])
                first += int(ends[-1])

    rows = ranged.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(task, "part int, first long, doc_id long, n_tokens long, ids array<int>")
    return stash.put(rows, name, **LAYOUT)


def read_metadata(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, part; reads no ids.

    The ids of earlier parts are summed over one row for each part.
    """
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    return files.select("part", "first", "doc_id", "n_tokens").join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "part", "first")


def read_tokens(files: DataFrame, doc_ids: list[int] | None = None) -> DataFrame:
    """Ids of all documents, or of a few by row-group and page index: the filter reaches the scan."""
    return files if doc_ids is None else files.where(F.col("doc_id").isin(doc_ids))


def digest(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as they stand in the files."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))

    def task(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            column = batch.column(3)
            ids, ends = column.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), column.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(ids)).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], names=["part", "first", "doc_id", "n_tokens", "ids_crc32"])

    rows = files.select("part", "first", "doc_id", "ids").mapInArrow(task, "part int, first long, doc_id long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written as token files and read back."""
    import public_tokenizers

    stash = Stash(spark, "op10")
    return digest(write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), 2, stash))
