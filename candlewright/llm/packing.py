"""Vector bin packing of examples into training sequences (operator 3)."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.llm.tokens import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, segment int"
SEQUENCES_PER_TASK = 1 << 33


class Packer:
    """Fills one sequence at a time by the dot-product heuristic of vector bin packing.

    An item demands (tokens, one segment, loss tokens). Of the items that fit under all three remaining capacities the
    one with the largest dot product of demand and remaining capacity, each as a share of its limit, is placed next;
    ties go to the longer item, then to the earlier one. Items of equal demand wait in one queue, so a placement looks
    at each kind of demand once. With `cut`, an item that doesn't fit fills what is left and its rest waits again;
    only items whose tokens all bear loss may be cut.
    """

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, cut: bool):
        import numpy as np

        self.np, self.limit, self.cut = np, (max_tokens, max_segments, max_loss), cut
        self.place: dict[tuple[int, int], int] = {}
        self.waiting: list[deque] = []
        self.tokens = self.items = 0
        self._index([])

    def _index(self, kinds: list[tuple[int, int]]) -> None:
        """Kinds of demand in order, with how many items of each wait; kinds that run out stay in the table."""
        order = sorted(kinds)
        self.waiting = [self.waiting[self.place[k]] if k in self.place else deque() for k in order]
        self.place = {k: i for i, k in enumerate(order)}
        self.table = self.np.array(order, dtype=float).reshape(-1, 2)
        self.count = self.np.array([len(q) for q in self.waiting], dtype=int)

    def add(self, tokens: int, loss: int, what: tuple) -> bool:
        """Queue an item; False if it can't stand in any sequence."""
        if tokens > self.limit[0] or loss > self.limit[2] or (self.cut and loss != tokens):
            return False
        if (tokens, loss) not in self.place:
            self._index([k for k in self.place if self.count[self.place[k]] or len(self.place) < 4096] + [(tokens, loss)])
        at = self.place[tokens, loss]
        self.waiting[at].append(what)
        self.count[at] += 1
        self.tokens, self.items = self.tokens + tokens, self.items + 1
        return True

    def _take(self, at: int) -> tuple[tuple, int, int]:
        tokens, loss = map(int, self.table[at])
        self.count[at] -= 1
        self.tokens, self.items = self.tokens - tokens, self.items - 1
        return self.waiting[at].popleft(), tokens, loss

    def _best(self, rest: list[int]) -> int | None:
        np = self.np
        top = int(np.searchsorted(self.table[:, 0], rest[0], "right"))
        if not top or not rest[1]:
            return None
        t, _, b = self.limit
        some = self.table[:top]
        score = some[:, 0] * (rest[0] / t**2) + some[:, 1] * (rest[2] / max(b, 1) ** 2)  # the segment's share is the same for all
        score[(self.count[:top] == 0) | (some[:, 1] > rest[2])] = -1
        k = top - 1 - int(np.argmax(score[::-1]))
        return k if score[k] >= 0 else None

    def sequence(self) -> tuple[list[tuple], int]:
        """One sequence as (what, first token within the item, tokens, loss) and its number of tokens."""
        rest, out = list(self.limit), []
        while self.items and rest[0]:
            at = self._best(rest)
            if at is None:
                room = min(rest[0], rest[2])
                longer = int(self.np.searchsorted(self.table[:, 0], room, "right"))
                waits = self.np.flatnonzero(self.count[longer:])
                if not self.cut or not rest[1] or not room or not len(waits):
                    break
                what, tokens, _ = self._take(longer + int(waits[0]))
                out.append((what, 0, room, room))
                name, done = what
                self.add(tokens - room, tokens - room, (name, done + room))
                rest = [rest[0] - room, rest[1] - 1, rest[2] - room]
                continue
            what, tokens, loss = self._take(at)
            out.append((what, 0, tokens, loss))
            rest = [rest[0] - tokens, rest[1] - 1, rest[2] - loss]
        return out, self.limit[0] - rest[0]


def _ladder(pieces: list[tuple], used: int) -> Iterator[list[tuple]]:
    """Cut a task's last, part-filled sequence into sequences of powers of two, which need no padding."""
    size = 1 << max(0, used.bit_length() - 1)
    queue = list(pieces)
    while queue:
        while size > used:
            size >>= 1
        room, out = size, []
        while room:
            what, first, tokens, loss = queue.pop(0)
            take = min(room, tokens)
            out.append((what, first, take, take))
            if take < tokens:
                queue.insert(0, (what, first + take, tokens - take, loss - take))
            room -= take
        used -= size
        yield out


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, max_tokens: int = 2048, max_segments: int = 256, max_loss: int | None = None, flush_tokens: int = 1 << 20) -> DataFrame:
    """Tokenize whole documents and pack their ids, each followed by `end_id`, into sequences of at most `max_tokens`.

    docs: doc_id and text; other columns are ignored, whatever their names. All ids of plain text bear loss, so loss
    equals tokens. A document longer than a sequence gives full sequences first, and its rest is packed with others'.
    Each task packs the documents of its own input split, without a shuffle: no key gathers rows. It holds at most
    about `flush_tokens` ids beside one document; a task that is run again reads the same split and gives the same
    sequences. A task's last sequence is cut into powers of two, which aren't padded.

    Null or empty text is the end id alone. A null doc_id stays null. Repeated rows are packed once for each row. An
    empty table gives no rows.
    """
    limits = (max_tokens, max_segments, max_tokens if max_loss is None else max_loss)

    def task(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encode, end = encoder(tokenizer).batch, np.array([end_id], dtype="<u4").tobytes()
        packer = Packer(*limits, cut=True)
        held: dict[int, list] = {}  # the rest of a document: name, its bytes, where they start, its tokens, tokens not yet placed
        first = TaskContext.get().partitionId() * SEQUENCES_PER_TASK
        rows: list[tuple] = []
        full = min(max_tokens, limits[2])
        names = [x.split()[0] for x in PIECES.split(", ")]
        types = [pa.int32() if x.endswith(" int") else pa.int64() for x in PIECES.split(", ")]

        def write(pieces: list[tuple]) -> None:
            nonlocal first
            at = 0
            for k, ((name, done), skip, tokens, loss) in enumerate(pieces):
                doc = held[name]
                begin = doc[2] + done + skip
                rows.append((doc[0], begin, tokens, zlib.crc32(doc[1][4 * (done + skip) : 4 * (done + skip + tokens)]), doc[3], first, at, loss, k))
                at += tokens
                doc[4] -= tokens
                if not doc[4]:
                    del held[name]
            first += 1

        def drain(keep: int):
            while packer.tokens > keep:
                pieces, used = packer.sequence()
                if used < max_tokens and not packer.items and used & (used - 1):
                    for part in _ladder(pieces, used):
                        write(part)
                else:
                    write(pieces)

        def out():
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
            rows.clear()
            return batch

        count = 0
        for batch in batches:
            for key, ids in ((k, x + end) for lo in range(0, batch.num_rows, 1000) for k, x in zip(batch.column(0).slice(lo, 1000).to_pylist(), encode(batch.column(1).slice(lo, 1000)), strict=True)):
                tokens, done = len(ids) // 4, 0
                while tokens - done >= full:
                    rows.append((key, done, full, zlib.crc32(ids[4 * done : 4 * (done + full)]), tokens, first, 0, full, 0))
                    first, done = first + 1, done + full
                if done < tokens:
                    held[count] = [key, ids[4 * done :], done, tokens, tokens - done]
                    packer.add(tokens - done, tokens - done, (count, 0))
                    count += 1
                if packer.tokens >= flush_tokens:
                    drain(flush_tokens // 4)
                if len(rows) >= 20_000:
                    yield out()
        drain(0)
        yield out()

    return docs.select("doc_id", "text").mapInArrow(task, PIECES)


def pack_examples(examples: DataFrame, max_tokens: int = 2048, max_segments: int = 16, max_loss: int = 1024, group_rows: int = 100_000) -> DataFrame:
    """Pack instruction examples, uncut, under limits on tokens, segments and loss-bearing tokens.

    examples: example_id, tokens long, loss_tokens long. Returns them with sequence_id, offset and segment. An example
    over a limit, or with a null or negative count, gets a null sequence_id; it is kept, never cut or dropped. Each
    task packs its own split in groups of at most `group_rows`.
    """

    def task(batches):
        import pandas as pd
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() * SEQUENCES_PER_TASK
        for pdf in batches:
            for lo in range(0, len(pdf), group_rows):
                part = pdf.iloc[lo : lo + group_rows]
                packer, out = Packer(max_tokens, max_segments, max_loss, cut=False), []
                for key, tokens, loss in part.itertuples(index=False):
                    bad = pd.isna(tokens) or pd.isna(loss) or tokens < 0 or loss < 0
                    if bad or not packer.add(int(tokens), int(loss), (key,)):
                        out.append((key, tokens, loss, None, None, None))
                while packer.items:
                    pieces, at = packer.sequence()[0], 0
                    for k, (what, _, tokens, loss) in enumerate(pieces):
                        out.append((what[0], tokens, loss, first, at, k))
                        at += tokens
                    first += 1
                yield pd.DataFrame(out, columns=["example_id", "tokens", "loss_tokens", "sequence_id", "offset", "segment"]).astype({c: "Int64" for c in ("tokens", "loss_tokens", "sequence_id", "offset", "segment")})

    kind = dict(examples.dtypes)["example_id"]
    return examples.select("example_id", F.col("tokens").cast("long"), F.col("loss_tokens").cast("long")).mapInPandas(task, f"example_id {kind}, tokens long, loss_tokens long, sequence_id long, offset long, segment int")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed pieces; see pack_documents."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
