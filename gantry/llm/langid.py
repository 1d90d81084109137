"""Language identification by prediction by partial matching (PPM) over bytes.

For each language a variable-order context tree (orders 3 to 0, then a uniform order) is learned once and frozen.
A byte costs -log2 of its probability in the longest context that the language knows; a context that knows the
previous bytes but not this one costs its escape probability, q / (n + q) for n bytes of q kinds, and hands on to
the next shorter one. The language with the shortest code for the whole text wins.

Cases: a null text, an empty one and one without a letter (signs, digits and numerals of any kind are none) give `und`
and 0; with no language learned every text does. Ties go to the alphabetically first language. Repeated rows each get a row. Nulls in other columns matter
only for learning, where a row without a language or an id is left out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gantry.llm.common import CHUNK_BYTES, add_columns, byte_chunks, column_bytes, text_batches

#: Bytes of context before the first byte of a text.
PAD = b"\n\n\n"


def held_out(doc_id: Column | str) -> Column:
    """True for the rows that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class ContextTrees:
    """Frozen code lengths in bits; row i of `bits[k]` belongs to `grams[k][i]`, a string of k + 1 bytes."""

    languages: list[str]
    grams: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]
    #: Bits that a byte of labelled text usually costs in its language, at most: the 99th percentile over texts that were not learned from.
    usual: np.ndarray = field(default_factory=lambda: np.zeros(0))
    _slots: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_slots": None}  # the table of slots is made where it is used

    @property
    def slot_bits(self) -> int:
        return min(22, max(16, (16 * len(self.grams[3])).bit_length()))

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.zeros(1 << self.slot_bits, dtype=np.int32)
            self._slots[_slot(self.grams[3], self.slot_bits)] = np.arange(len(self.grams[3]), dtype=np.int32)
        return self._slots

    @classmethod
    def freeze(cls, languages: list[str], lang: np.ndarray, gram: np.ndarray, count: np.ndarray) -> ContextTrees:
        """From counts of strings of four bytes (as numbers) for each language."""
        n_lang = len(languages)
        codes, at = np.unique(gram, return_inverse=True)
        table = np.zeros((len(codes), n_lang))
        np.add.at(table, (at, lang), count)
        levels = {3: (codes, table)}
        for k in (2, 1, 0):
            longer, counts = levels[k + 1]
            codes, at = np.unique(longer & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            table = np.zeros((len(codes), n_lang))
            np.add.at(table, at, counts)
            levels[k] = (codes, table)
        grams, bits, contexts, escapes = [], [], [], []
        below = np.full((1, n_lang), 8.0)
        for k in range(4):
            codes, counts = levels[k]
            ctx, at = np.unique(codes >> 8, return_inverse=True)
            total, kinds = np.zeros((len(ctx), n_lang)), np.zeros((len(ctx), n_lang))
            np.add.at(total, at, counts)
            np.add.at(kinds, at, counts > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                own = -np.log2(counts / (total + kinds)[at])
            suffix = np.searchsorted(grams[-1], codes & ((1 << 8 * k) - 1)) if k else np.zeros(len(codes), dtype=int)
            here = np.where(counts > 0, own, escape[at] + below[suffix])
            grams.append(codes)
            bits.append(here.astype(np.float32))
            contexts.append(ctx)
            escapes.append(escape.astype(np.float32))
            below = here
        return cls(languages, grams, bits, contexts, escapes)

    def code_lengths(self, buffer: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Bits for each text and language; each text stands after PAD."""
        out = np.zeros((len(start), len(self.languages)))
        full = np.flatnonzero(length)
        if not len(full) or not len(self.grams[3]):
            return out
        b = buffer.astype(np.uint32)
        code = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]  # of the byte at index + 3
        row = self.slots[_slot(code, self.slot_bits)]
        missed = np.flatnonzero(self.grams[3][row] != code)
        cost = self.bits[3][row]
        if len(missed):
            cost[missed] = self._look(3, code[missed].astype(np.int64))
        bounds = np.stack([start[full], start[full] + length[full]], axis=1).ravel() - 3
        sums = np.add.reduceat(np.concatenate([cost, np.zeros((1, cost.shape[1]), cost.dtype)]), bounds, axis=0, dtype=np.float64)
        out[full] = sums[0::2]
        return out

    def _look(self, k: int, code: np.ndarray) -> np.ndarray:
        """Costs by search, through escapes where the string is unknown to all languages."""
        if k < 0:
            return np.full((len(code), len(self.languages)), 8.0, dtype=np.float32)
        at = np.minimum(np.searchsorted(self.grams[k], code), len(self.grams[k]) - 1)
        out = self.bits[k][at]
        gone = np.flatnonzero(self.grams[k][at] != code)
        if len(gone):
            left = code[gone]
            ctx = np.minimum(np.searchsorted(self.contexts[k], left >> 8), len(self.contexts[k]) - 1)
            escape = np.where((self.contexts[k][ctx] == left >> 8)[:, None], self.escapes[k][ctx], np.float32(0))
            out[gone] = escape + self._look(k - 1, left & ((1 << 8 * k) - 1))
        return out


def _slot(code: np.ndarray, bits: int) -> np.ndarray:
    return (code.astype(np.uint32) * np.uint32(2654435769)) >> np.uint32(32 - bits)


def _measured(trees: ContextTrees, texts: list[bytes]) -> np.ndarray:
    """Bits for each text and language, a few texts at a time: costs of a byte take four bytes a language."""
    limit = max(1 << 14, CHUNK_BYTES * 4 // max(len(trees.languages), 1))
    parts = [trees.code_lengths(buffer, start, length) for _, _, buffer, start, length in byte_chunks(texts, PAD, limit)]
    return np.concatenate(parts) if parts else np.zeros((0, len(trees.languages)))


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", train_docs: int = 3000) -> ContextTrees:
    """Context trees from a bounded sample of labelled rows that aren't held out.

    About `train_docs` rows a language are learned from, picked by a hash of the id; the sample is the documented bound of
    this fit. All its strings are kept, whatever their language and count. What text usually costs is measured on a
    sixteenth of it, under trees of the rest.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return ContextTrees.freeze([], *(np.zeros(0, dtype=np.int64),) * 3)
    languages = sorted(sizes)
    share = F.create_map(*(F.lit(v) for x in languages for v in (x, min(1.0, train_docs / sizes[x]))))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / (F.element_at(share, F.col("lang")) * (1 << 20))
    picked = rows.where(place < 1).select("lang", (place >= 15 / 16).alias("apart"), "text")

    def count(batches):
        held: dict[tuple[str, bool], list] = {}
        for batch in text_batches(batches, "text"):
            texts, langs = column_bytes(batch, "text"), list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for x in set(langs):
                own = [t for t, y in zip(texts, langs, strict=True) if y == x]
                for _, _, buffer, _, _ in byte_chunks(own, PAD):
                    b = buffer.astype(np.int64)
                    code = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
                    held.setdefault(x, []).append(np.unique(code, return_counts=True))
        for (x, apart), found in held.items():
            codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([n for _, n in found])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(n * (not apart), pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "most", "n"])

    grams = picked.mapInArrow(count, "lang string, gram long, most long, n long").groupBy("lang", "gram").agg(F.sum("most").alias("most"), F.sum("n").alias("n"))
    found = grams.toArrow()
    where = np.searchsorted(languages, found.column("lang").to_numpy(zero_copy_only=False).astype(str)) if found.num_rows else np.zeros(0, dtype=np.int64)
    gram, most = found.column("gram").to_numpy(), found.column("most").to_numpy()
    trees = ContextTrees.freeze(languages, where, gram, found.column("n").to_numpy())
    rest = ContextTrees.freeze(languages, where[most > 0], gram[most > 0], most[most > 0])
    trees.usual = _usual_cost(picked.where("apart").select("lang", "text"), rest)
    return trees


def _usual_cost(rows: DataFrame, trees: ContextTrees) -> np.ndarray:
    """The 99th percentile of bits a byte over texts of 100 bytes and more, by language; without such texts the most of all languages, or 8."""
    if not len(trees.grams[3]):
        return np.full(len(trees.languages), 8.0)
    shared = rows.sparkSession.sparkContext.broadcast(trees)
    number = {x: k for k, x in enumerate(trees.languages)}

    def measure(batches):
        for batch in text_batches(batches, "text"):
            texts, langs = column_bytes(batch, "text"), batch.column(0).to_pylist()
            size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            bits = _measured(shared.value, texts)[np.arange(len(texts)), [number[x] for x in langs]]
            at = np.flatnonzero(size >= 100)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(bits[at] / size[at], pa.float64())], names=["lang", "cost"])

    per = rows.mapInArrow(measure, "lang string, cost double").groupBy("lang").agg(F.percentile_approx("cost", 0.99, 1000).alias("cost")).collect()
    known = {r["lang"]: r["cost"] for r in per}
    return np.array([known.get(x, max(known.values(), default=8.0)) for x in trees.languages])


def _scorer(trees, text: str):
    def make():
        model = trees.value

        def score(batch: pa.RecordBatch) -> list:
            texts = column_bytes(batch, text)
            if not model.languages:
                return [["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)]
            known = np.array([any(map(str.isalpha, t.decode("utf-8", "replace"))) for t in texts], dtype=bool)
            bits = _measured(model, texts)
            best = bits.argmin(axis=1)
            sure = 1 / np.exp2(-np.clip(bits - bits.min(axis=1, keepdims=True), 0, 1000)).sum(axis=1)
            size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            # what the text costs beyond usual text of its language, short texts with some leeway
            over = bits[np.arange(len(texts)), best] / (model.usual[best] * size + 200)
            return [[model.languages[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, sure, 0.0), over]

        return score

    return make


FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cost_ratio", T.DoubleType())]


def predict(docs: DataFrame, trees: ContextTrees, *, text: str = "text") -> DataFrame:
    """`docs` with `lang_pred`, `score`, the share of the best language in 2 to the minus code length, and `cost_ratio`, the code length by what such a text usually costs at most."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # the strings of a bounded sample by languages
    return add_columns(docs, FIELDS, _scorer(shared, text), text)


def keep_identified(docs: DataFrame, trees: ContextTrees, *, text: str = "text", least: float = 0.5, most_cost: float = 1.5) -> DataFrame:
    """The rows of `docs` whose language is known with a score of `least` or more and whose text costs at most `most_cost` times the usual; all columns stay.

    A text in a language that was not learned, or noise, costs far more bits a byte than any learned text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    stay = lambda _, new: [x != "und" and y >= least and z <= most_cost for x, y, z in zip(*new, strict=True)]
    return add_columns(docs, FIELDS, _scorer(shared, text), text, keep=stay)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = predict(docs.select("doc_id", "text"), learn(docs))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
