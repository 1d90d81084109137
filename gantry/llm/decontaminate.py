"""Benchmark decontamination by greedy string tiling.

Texts become words: lower case, ASCII punctuation as white space. Runs of `min_match` words of the benchmark items
(seeds) are joined with those of the documents by their hashes: the benchmark, a bounded block of it at a time, goes to
every task as a sorted table of hashes, so that documents are not shuffled. An item that is to be covered must have a
certain number of its seeds in the document, so it is looked up by its rarer seeds alone (as many as that number leaves
no way around) and the number is checked on all of them: seeds that very many items share bring no candidates.

A candidate's text is tiled against it: the longest common runs that don't overlap are marked again and again, found by
a running Karp-Rabin scan whose search length falls to `min_match`. The share of the item's words under tiles is its
coverage; at `threshold` or more the document is contaminated, in whatever order the passages are.

Cases: null or empty texts and items match nothing; an item with fewer than `min_match` words counts only as a whole;
repeated items and rows each give their own row; an empty benchmark gives an empty result; ids are of any type.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gantry.llm.common import BYTE_VALUES, byte_chunks, column_bytes, mix64, text_batches, word_hashes

_TO_SPACE = bytes(32 if chr(i) in punctuation else i for i in range(256))
_MODULUS, _BASE = (1 << 61) - 1, 1_000_003
_U = np.uint64
#: Bytes of benchmark text that are broadcast at once, with tables of about twice that; a larger benchmark goes over the documents in several blocks.
BLOCK_BYTES = 16 << 20


def normal(text: str | bytes) -> bytes:
    """Lower case, ASCII punctuation as white space."""
    text = text.decode("utf-8", "replace") if isinstance(text, bytes) else text
    return text.lower().encode("utf-8", "replace").translate(_TO_SPACE)


def words_of(text: str | bytes) -> list[bytes]:
    return normal(text).split()


def _free_runs(marked: list[bool], length: int) -> Iterable[tuple[int, int]]:
    """Stretches without a mark of at least `length`."""
    begin = None
    for i, m in enumerate([*marked, True]):
        if m:
            if begin is not None and i - begin >= length:
                yield begin, i
            begin = None
        elif begin is None:
            begin = i


def _rolling(codes: list[int], begin: int, end: int, length: int) -> Iterable[tuple[int, int]]:
    """Karp-Rabin hash and start of each run of `length` words in [begin, end)."""
    lead = pow(_BASE, length - 1, _MODULUS)
    h = 0
    for i in range(begin, end):
        if i - begin >= length:
            h = (h - codes[i - length] * lead) % _MODULUS
        h = (h * _BASE + codes[i]) % _MODULUS
        if i - begin >= length - 1:
            yield h, i - length + 1


def tiles(item: list[bytes], text: list[bytes], min_match: int, first_length: int = 20) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in item, start in text, words), the longest first."""
    ids = {w: k + 1 for k, w in enumerate(dict.fromkeys(item))}
    p, t = [ids[w] for w in item], [ids.get(w, 0) for w in text]
    p_marked, t_marked = [False] * len(p), [x == 0 for x in t]
    out = []
    length = max(min_match, min(first_length, len(p)))
    while True:
        where: dict[int, list[int]] = {}
        for a, b in _free_runs(t_marked, length):
            for h, j in _rolling(t, a, b, length):
                where.setdefault(h, []).append(j)
        found, longest = [], 0
        for a, b in _free_runs(p_marked, length):
            for h, i in _rolling(p, a, b, length):
                for j in where.get(h, ()):
                    n = 0
                    while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and not p_marked[i + n] and not t_marked[j + n]:
                        n += 1
                    if n >= length:
                        found.append((-n, i, j))
                        longest = max(longest, n)
        if longest > 2 * length:
            length = longest
            continue
        for n, i, j in sorted(found):
            n = -n
            if not any(p_marked[i : i + n]) and not any(t_marked[j : j + n]):
                p_marked[i : i + n] = t_marked[j : j + n] = [True] * n
                out.append((i, j, n))
        if found:  # what a tile cut short may still hold a run of this length
            continue
        if length == min_match:
            return out
        length = length // 2 if length > 2 * min_match else min_match


def runs_of(words: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and owner of each run of n neighbouring words of one owner."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    code = mix64(words[: len(words) - n + 1])
    for k in range(1, n):
        code = mix64(code * _U(3) + words[k : len(words) - n + 1 + k])
    inside = owner[: len(owner) - n + 1] == owner[n - 1 :]
    return code[inside], owner[: len(owner) - n + 1][inside]


@dataclass
class SeedTable:
    """Seeds of n words of some items: the sorted hashes of those that items are looked up by, and all seeds of every item."""

    n: int
    codes: np.ndarray  # of lookup seeds, ascending, each once
    begin: np.ndarray  # where the items of each begin in `items`
    items: np.ndarray
    all_codes: np.ndarray  # item after item
    all_begin: np.ndarray
    need: np.ndarray  # seeds that an item must have in a document

    @classmethod
    def of(cls, n: int, code: np.ndarray, owner: np.ndarray, n_items: int, words: np.ndarray, threshold: float) -> SeedTable:
        all_begin = np.searchsorted(owner, np.arange(n_items + 1))
        total = np.diff(all_begin)
        cover = np.maximum(np.ceil(threshold * words - 1e-9).astype(np.int64), 1)
        need = np.minimum(-(-cover // n), np.maximum(total, 1))  # tiles of n words, one seed each, have the fewest seeds for what they cover
        _, which, times = np.unique(code, return_inverse=True, return_counts=True)
        order = np.lexsort((times[which], owner))  # an item's seeds, the rarest first
        place = np.arange(len(code)) - all_begin[owner]
        by = order[place < (total - need + 1)[owner]]
        by = by[np.lexsort((owner[by], code[by]))]
        codes, begin = np.unique(code[by], return_index=True)
        return cls(n, codes, np.append(begin, len(by)), owner[by].astype(np.int32), code, all_begin, need)

    def candidates(self, code: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Pairs of text and item, each once, from hash and text of the seeds of some texts."""
        if not len(self.codes) or not len(code):
            return np.zeros((0, 2), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = np.flatnonzero(self.codes[at] == code)
        if not len(hit):
            return np.zeros((0, 2), dtype=np.int64)
        key = np.unique(owner[hit] * len(self.codes) + at[hit])  # a seed counts once in a text
        text, seed = key // len(self.codes), key % len(self.codes)
        n = self.begin[seed + 1] - self.begin[seed]
        item = self.items[np.repeat(self.begin[seed] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        pairs = np.unique(np.stack([np.repeat(text, n), item], axis=1), axis=0)
        ok = np.ones(len(pairs), dtype=bool)
        of = -1
        for k, (t, i) in enumerate(pairs.tolist()):
            if t != of:
                of, own = t, np.unique(code[owner == t])
            mine = self.all_codes[self.all_begin[i] : self.all_begin[i + 1]]
            found = np.minimum(np.searchsorted(own, mine), len(own) - 1)
            ok[k] = np.count_nonzero(own[found] == mine) >= self.need[i]
        return pairs[ok]


@dataclass
class Block:
    """A bounded part of the benchmark with its tables of seeds."""

    ids: list
    texts: list[bytes]
    tables: list[SeedTable]
    words: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple], min_match: int, threshold: float) -> Block:
        texts = [normal(x) for _, x in rows]
        parts = [(h, first + owner) for first, _, buffer, start, _ in byte_chunks(texts) for h, owner in [word_hashes(buffer, start, BYTE_VALUES)]]
        words, owner = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
        count = np.bincount(owner, minlength=len(texts))
        tables = []
        for n in range(1, min_match + 1):
            own = (count == n) if n < min_match else (count >= n)
            if own.any():
                code, of = runs_of(words[own[owner]], owner[own[owner]], n)
                tables.append(SeedTable.of(n, code, of, len(texts), count, threshold))
        return cls([k for k, _ in rows], texts, tables, count)

    def candidates(self, texts: list[bytes]) -> dict[int, list[int]]:
        """The items that each of some normal texts has enough seeds of."""
        out: dict[int, list[int]] = {}
        for first, _, buffer, start, _ in byte_chunks(texts):
            words, owner = word_hashes(buffer, start, BYTE_VALUES)
            for table in self.tables:
                for t, i in table.candidates(*runs_of(words, owner, table.n)).tolist():
                    out.setdefault(first + t, []).append(i)
        return out


def match(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_match: int = 5, threshold: float = 0.5) -> DataFrame:
    """A row for each document and benchmark item with coverage of `threshold` or more: doc_id, item_id, coverage, n_tiles, n_matched."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = {"doc_id": docs.schema[doc_id].dataType, "item_id": benchmark.schema[item_id].dataType}
    schema = T.StructType([T.StructField(k, v) for k, v in kinds.items()] + [T.StructField("coverage", T.DoubleType()), T.StructField("n_tiles", T.LongType()), T.StructField("n_matched", T.LongType())])
    arrow = to_arrow_schema(schema)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def found(batch: pa.RecordBatch, results: list[tuple], block: Block) -> pa.RecordBatch:
        ids = batch.column(0).to_pylist()
        out = [(ids[r], block.ids[i], n / int(block.words[i]), len(marks), n) for r, i, marks, n in results]
        columns = list(zip(*out, strict=True)) or [[]] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    out = None
    for block in _blocks(benchmark, item_id, item_text, min_match, threshold):
        run = _tiler(docs.sparkSession.sparkContext.broadcast(block), "text", min_match, threshold, found, first_only=False)
        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, min_match: int, threshold: float) -> Iterable[Block]:
    """The items in blocks of a bounded size."""
    rows = benchmark.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).where(F.col("text").isNotNull())
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = -(-size // BLOCK_BYTES)
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k) if n > 1 else rows  # each item is in one block
        yield Block.of([(r[0], r[1]) for r in part.collect()], min_match, threshold)


def _tiler(shared, text: str, min_match: int, threshold: float, result: Callable, first_only: bool):
    """For each batch `result(batch, [(row, item, tiles, words)], block)` of the items that reach the threshold; `first_only` stops a text at its first."""

    def run(batches):
        block = shared.value
        for batch in text_batches(batches, text):
            texts = [normal(t) for t in column_bytes(batch, text)]
            hits = []
            for r, items in block.candidates(texts).items():
                words = texts[r].split()
                for i in sorted(items):
                    item = block.texts[i].split()
                    marks = tiles(item, words, min(min_match, len(item)))
                    n = sum(x for _, _, x in marks)
                    if n >= threshold * len(item):
                        hits.append((r, i, marks, n))
                        if first_only:
                            break
            yield result(batch, hits, block)

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", min_match: int = 5, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` that no benchmark item contaminates; all columns stay."""

    def clean(batch: pa.RecordBatch, results: list[tuple], block: Block) -> pa.RecordBatch:
        stay = np.ones(batch.num_rows, dtype=bool)
        stay[[r for r, *_ in results]] = False
        return batch.filter(pa.array(stay))

    for block in _blocks(benchmark, item_id, item_text, min_match, threshold):
        docs = docs.mapInArrow(_tiler(docs.sparkSession.sparkContext.broadcast(block), text, min_match, threshold, clean, first_only=True), docs.schema)
    return docs


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return match(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
