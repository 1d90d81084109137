"""Mixture-controlled packing: deficit round robin over one token queue for each source.

Each source's documents form a queue of tokens. Slots of `quantum` tokens are served one by one, each to the queue
whose next slot is due first; queues that run dry leave the round and the others share on. Slot k of a queue of weight
w is due at (2k + 1) / 2w, ties to the earlier queue: while all queues last, what each has got after any number of
slots is its target share of them to within one slot for each other queue (in practice about one slot), and as that
holds at the end of every window, deficits carry over from window to window and from partition to partition. The
round's state has a closed form, so each task places its own documents from the totals of all queues: nothing is dealt
out by one process, and no queue's documents meet in one task.

What is left of each queue beyond whole slots follows behind in queue order. Windows are full but for the last tokens,
which are cut into powers of two: nothing is padded.

Cases: a null or empty text is its end token alone; null sources form one queue; repeated rows are packed as often as
they stand; an empty table gives no pieces; sources that the mixture leaves out or gives no share come with the least weight. Any
number of sources are queues of their own; the driver and each task hold three numbers and the name of each.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gantry.llm.common import column_bytes, materialise, text_batches
from gantry.llm.tokens import tokenizer

END_ID = 2


def tokenise(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", end_id: int = END_ID) -> DataFrame:
    """doc_id, source, ids (binary), n_tokens, part and local: the source's tokens before this row in its partition."""
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("source", T.StringType()), T.StructField("ids", T.BinaryType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("part", T.LongType()), T.StructField("local", T.LongType()),
    ])

    def run(batches):
        tok, part, seen = tokenizer(path), TaskContext.get().partitionId(), {}
        end = tok.pack([end_id])
        for batch in text_batches(batches, "text", limit=1 << 20, keeps=("tokenizer", path)):
            sources = batch.column(1).to_pylist()
            ids = [x + end for x in tok.encode([t.decode("utf-8", "replace") for t in column_bytes(batch, "text")])]
            counts = [len(x) // tok.width for x in ids]
            local = []
            for s, n in zip(sources, counts, strict=True):
                local.append(seen.get(s, 0))
                seen[s] = local[-1] + n
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array(counts, pa.int64()), pa.array([part] * len(ids), pa.int64()), pa.array(local, pa.int64())], names=schema.names)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    return rows.mapInArrow(run, schema)


@dataclass
class Schedule:
    """Totals of the queues and where each of their tokens goes."""

    totals: np.ndarray  # tokens of each queue
    weights: np.ndarray  # whole numbers, at most 2**20
    window: int
    quantum: int

    def __post_init__(self):
        self.slots = self.totals // self.quantum
        tails = self.totals - self.slots * self.quantum
        self.tail_at = int(self.slots.sum()) * self.quantum + np.cumsum(tails) - tails
        self.tokens = int(self.totals.sum())

    def slot(self, queue: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The place, among all slots, of slot k of each queue."""
        own = self.weights[queue]
        out = np.zeros(len(k), dtype=np.int64)
        for q in np.flatnonzero(self.slots).tolist():  # queues of less than a slot are all tail
            due = (2 * k + 1) * self.weights[q]
            before = np.where(q < queue, (due + own) // (2 * own), (due + own - 1) // (2 * own))
            out += np.where(queue == q, k, np.clip(before, 0, self.slots[q]))
        return out

    def pieces(self, queue: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """For documents at [begin, begin + length) of their queues: document, start in it, length, place among all tokens."""
        m = self.quantum
        first = begin // m
        n = (begin + length - 1) // m - first + 1
        doc = np.repeat(np.arange(len(n)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[doc]
        lo, hi = np.maximum(begin[doc], k * m), np.minimum((begin + length)[doc], (k + 1) * m)
        q = queue[doc]
        whole = k < self.slots[q]
        place = np.empty(len(k), dtype=np.int64)
        place[whole] = self.slot(q[whole], k[whole]) * m + (lo - k * m)[whole]
        place[~whole] = (self.tail_at[q] + lo - self.slots[q] * m)[~whole]
        start, size = lo - begin[doc], hi - lo
        # slots that follow one another in the same document and window are one piece
        new = np.ones(len(k), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + size[:-1])
        at = np.flatnonzero(new)
        return doc[at], start[at], np.add.reduceat(size, at) if len(at) else size, place[at]

    def bounds(self) -> np.ndarray:
        """Where the sequences behind the last full window begin, and the end."""
        at = self.tokens // self.window * self.window
        out = [at]
        for bit in range(self.window.bit_length() - 1, -1, -1):
            if (self.tokens - at) >> bit & 1:
                out.append(out[-1] + (1 << bit))
        return np.array(out, dtype=np.int64)

    def cut(self, place: int, length: int):
        """(sequence, offset, tokens before, tokens) of each part of a run."""
        full, done = self.tokens // self.window, 0
        bounds = self.bounds()
        while done < length:
            at = place + done
            if at < full * self.window:
                seq, offset, room = at // self.window, at % self.window, self.window - at % self.window
            else:
                j = int(np.searchsorted(bounds, at, side="right")) - 1
                seq, offset, room = full + j, at - int(bounds[j]), int(bounds[j + 1]) - at
            n = min(room, length - done)
            yield seq, offset, done, n
            done += n


def _quantised(sizes: np.ndarray) -> np.ndarray:
    top = max(float(sizes.max(initial=0)), 1e-300)
    return np.maximum(np.rint(sizes / top * (1 << 20)), 1).astype(np.int64)


def pack(tokens: DataFrame, *, width: int, window: int = 4096, quantum: int = 256, mixture: dict[str | None, float] | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces of the rows of `tokenise`: doc_id, start, length, ids (or ids_crc32), doc_tokens, sequence_id, offset, source.

    `mixture` gives target shares of the sources; without it they are the queues' own shares, so that all end together.
    """
    if window % quantum:
        raise ValueError("window must be a multiple of quantum")
    spark = tokens.sparkSession
    tokens = materialise(tokens, "tokens")
    parts = materialise(tokens.groupBy("part", "source").agg(F.sum("n_tokens").alias("n")), "queue-parts")
    totals = sorted(((r["source"], r["n"]) for r in parts.groupBy("source").agg(F.sum("n").alias("n")).collect()), key=lambda x: (x[0] is not None, x[0] or ""))
    sizes = np.array([n for _, n in totals], dtype=np.int64)
    shares = sizes.astype(float) if mixture is None else np.array([mixture.get(s, 0.0) for s, _ in totals], dtype=float)
    plan = Schedule(sizes, _quantised(shares), window, quantum)
    queues = spark.createDataFrame([(s, k) for k, (s, _) in enumerate(totals)], "_queue string, queue_no long")
    before = F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    base = parts.select(F.col("part").alias("_part"), F.col("source").alias("_source"), before.alias("base"))
    # a written table: its size is known, so that tokens are not shuffled where it is small
    base = materialise(base.join(queues, F.col("_source").eqNullSafe(F.col("_queue"))).drop("_queue"), "queue-base")
    rows = tokens.join(base, (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source")))
    rows = rows.select("doc_id", "source", "ids", "queue_no", (F.col("base") + F.col("local")).alias("begin"))
    payload = T.StructField("ids", T.BinaryType()) if with_ids else T.StructField("ids_crc32", T.LongType())
    longs = [T.StructField(x, T.LongType()) for x in ("start", "length", "doc_tokens", "sequence_id", "offset")]
    schema = T.StructType([tokens.schema["doc_id"], *longs, payload, T.StructField("source", T.StringType())])

    def run(batches):
        for batch in text_batches(batches, "ids", limit=1 << 20):
            ids = [np.frombuffer(x, dtype=f"<u{width}").astype("<u4") for x in batch.column(2).to_pylist()]
            length = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            doc, start, size, place = plan.pieces(batch.column(3).to_numpy(), batch.column(4).to_numpy(), length)
            out: list[tuple] = []
            for d, s, n, p in zip(doc.tolist(), start.tolist(), size.tolist(), place.tolist(), strict=True):
                for seq, offset, done, k in plan.cut(p, n):
                    part = ids[d][s + done : s + done + k]
                    out.append((d, s + done, k, len(ids[d]), seq, offset, part.tobytes() if with_ids else zlib.crc32(part)))
            columns = list(zip(*out, strict=True))
            who = pa.array(columns[0], pa.int64())
            arrays = [batch.column(0).take(who), *(pa.array(c, pa.int64()) for c in columns[1:6]), pa.array(columns[6], pa.binary() if with_ids else pa.int64()), batch.column(1).take(who)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str | None = None, *, with_ids: bool = True, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """Tokenise and pack; `path` is a tokenizer file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return pack(tokenise(docs, path, doc_id=doc_id, text=text, source=source), width=tokenizer(path).width, with_ids=with_ids, **options)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return pack_documents(docs, with_ids=False).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")
