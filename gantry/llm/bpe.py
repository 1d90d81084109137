"""Byte pair encoding and decoding of whole texts through a table of distinct words.

The tokenizer splits at white space and treats what lies between alone, so a text's ids are those of its words, one after another.
Spark splits texts into words and replaces each by its number: in a table of common words, which are counted in a bounded
sample and encoded once, or else among the other words of its chunk of documents. Those other words are dealt out by
hash, all chunks together, so that each distinct word meets its copies in one bucket and is encoded once; its ids go back to the chunks that
have it and are joined by position. Only word numbers, a word once a chunk and its ids are moved, never texts. Which words are common decides
the work, not the result. Decoding joins ids with the vocabulary's pieces, whose number is fixed by the tokenizer's file.

Cases: null and empty texts have no ids and decode to an empty text; repeated rows are encoded as often as they stand; ids of rows
may be null or repeat; further columns are ignored; special tokens in a text are special tokens, as the library has it;
ids that the vocabulary lacks decode to nothing; a chunk has one text at least, however long; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gantry.llm.common import release, resident

#: Common words, the most bytes one may have, and the documents they are counted in: what every task holds is below their product.
COMMON, WORD_BYTES, SAMPLE = 1 << 18, 64, 20_000
#: Bytes of text in a chunk.
CHUNK = 4 << 20


def library(path: str):
    """The tokenizer of a file without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def _resident_library(path: str):
    return resident(("library", path), lambda: library(path))


def _encoded(tok, words: list[str]) -> list[bytes]:
    return [np.array(e.ids, dtype="<u4").tobytes() for e in tok.encode_batch_fast(words, add_special_tokens=False)]


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of texts, each word's number among them in order, and how many each text has."""
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    coded = split.flatten().dictionary_encode()
    codes, offsets = coded.indices.to_numpy(), split.offsets.to_numpy()
    real = np.not_equal(pc.binary_length(coded.dictionary).to_numpy(), 0)[codes] if len(codes) else np.zeros(0, dtype=bool)
    before = np.concatenate([[0], np.cumsum(real)])
    return coded.dictionary, codes[real], np.diff(before[offsets])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """ids and texts up to the one that makes `CHUNK` bytes full, however the rows come in batches."""
    ids, texts, size = [], [], 0
    for batch in batches:
        total, begin = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy().astype(np.int64)), 0
        while begin < batch.num_rows:
            done = int(total[begin - 1]) if begin else 0
            n = min(int(np.searchsorted(total[begin:] - done, CHUNK - size)) + 1, batch.num_rows - begin)
            ids.append(batch.column(0).slice(begin, n))
            texts.append(batch.column(1).slice(begin, n))
            begin += n
            size += int(total[begin - 1]) - done
            if size >= CHUNK:
                yield pa.concat_arrays(ids), pa.concat_arrays(texts)
                ids, texts, size = [], [], 0
    if ids:
        yield pa.concat_arrays(ids), pa.concat_arrays(texts)
    release()


def common_words(docs: DataFrame, path: str, text: str, most: int = COMMON) -> bytes:
    """The words most often seen in a sample of documents and their ids, as an Arrow file."""
    n = docs.count()
    some = docs.select(F.col(text).alias("text")).sample(min(1.0, SAMPLE / max(n, 1)), seed=1)

    def count(batches):
        for batch in batches:
            words, codes, _ = _words(batch.column(0))
            yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(np.bincount(codes, minlength=len(words)))], names=["word", "n"])

    def encode(batches):
        for batch in batches:
            ids = _encoded(_resident_library(path), batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), batch.column(1)], names=["word", "ids", "n"])

    counted = some.mapInArrow(count, "word string, n long").where((F.octet_length("word") <= WORD_BYTES) & (F.col("n") > 0)).groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "word").limit(most)
    found = top.repartition("word").mapInArrow(encode, "word string, ids binary, n long").toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, found.schema) as f:
        f.write_table(found)
    return sink.getvalue().to_pybytes()


def _planes(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2**32, their first bytes together, then their second ones and so on, compressed."""
    raw = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(raw.tobytes(), codec="zstd", asbytes=True)


def _unplaned(blob: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(blob, decompressed_size=4 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(4, n).T).view("<u4").ravel()


def encode(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", common: int = COMMON) -> DataFrame:
    """doc_id and ids (binary, 32 bits each, little-endian) of every row.

    The rows are read three times, for the sample, for other words and for numbers, rather than written in between: they have to be
    a scan of files, a written table or what else comes out alike each time. If they do not, an error says so.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    table = spark.sparkContext.broadcast(common_words(rows, path, "text", common))
    name, narrow = uuid.uuid4().hex, library(path).get_vocab_size() <= 1 << 16
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = rows.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("doc_ids", T.ArrayType(kind)),
        T.StructField("counts", T.BinaryType()), T.StructField("blob", T.BinaryType()), T.StructField("n", T.LongType()),
    ])

    def known(column: str) -> pa.Array:
        return resident(("common", name), lambda: pa.ipc.open_file(pa.py_buffer(table.value)).read_all().combine_chunks()).column(column).combine_chunks()

    def number(batches, others: bool):
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(schema)
        for no, (ids, texts) in enumerate(_chunks(batches)):
            chunk = (TaskContext.get().partitionId() << 32) + no
            words, codes, counts = _words(texts)
            at = pc.index_in(words, value_set=known("word").cast(words.type)).fill_null(-1).to_numpy().astype(np.int64)
            other = np.flatnonzero((at < 0) & (pc.binary_length(words).to_numpy() > 0))
            names = words.take(pa.array(other)).cast(pa.large_binary()).to_pylist()
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in names), dtype=np.int64, count=len(names))
            order = np.argsort(bucket, kind="stable")
            at[other[order]] = len(known("word")) + np.arange(len(order))
            if others:
                out = [{"chunk": chunk, "bucket": b, "counts": None, "blob": b"\n".join([names[i] for i in some]), "n": len(some)} for b, some in zip(*_grouped(bucket[order], order), strict=True)]
            else:
                # the number of other words stands behind the counts, to be held against what comes back
                out = [{"chunk": chunk, "bucket": -1, "counts": np.append(counts, len(order)).astype("<i8").tobytes(), "blob": _planes(at[codes]), "n": len(codes)}]
            lists = pa.ListArray.from_arrays(pa.array([0, *[0 if others else len(ids)] * len(out)], pa.int32()), ids)
            yield pa.RecordBatch.from_arrays([lists if f.name == "doc_ids" else pa.array([r[f.name] for r in out], f.type) for f in shape], names=shape.names)

    back = T.StructType([schema["chunk"], schema["bucket"], schema["counts"], schema["blob"], schema["n"]])

    def encode_words(batches):
        bucket, ids_of = None, {}
        tok = _resident_library(path)
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, b, blob = (batch.column(k)[i].as_py() for k in range(3))
                if b != bucket:
                    bucket, ids_of = b, {}
                words = blob.split(b"\n")
                new = [w for w in words if w not in ids_of]
                ids_of.update(zip(new, _encoded(tok, [w.decode() for w in new]), strict=True))
                ids = [ids_of[w] for w in words]
                flat = np.frombuffer(b"".join(ids), dtype="<u4")
                values = [[chunk], [b], [_planes(np.array([len(x) // 4 for x in ids]))], [(flat.astype("<u2") if narrow else flat).tobytes()], [len(words)]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64()), strict=True)], names=back.names)
        release()

    numbered, other = (rows.mapInArrow(functools.partial(number, others=o), schema) for o in (False, True))
    words = other.select("chunk", "bucket", "blob").repartition("bucket").sortWithinPartitions("bucket", "chunk")
    both = numbered.unionByName(words.mapInArrow(encode_words, back), allowMissingColumns=True)
    result = T.StructType([T.StructField("doc_id", kind), T.StructField("ids", T.BinaryType())])

    def join_ids(batches):
        base = known("ids").cast(pa.large_binary())
        chunk, held, parts = None, None, []

        def done():
            if held is None or sum(map(len, parts)) != int.from_bytes(held["counts"][-8:], "little"):
                raise ValueError("the documents did not come out alike twice; write them first")
            table = pa.concat_arrays([base, *parts])
            counts = np.frombuffer(held["counts"], dtype="<i8")[:-1]
            codes, begin = _unplaned(held["blob"], held["n"]), np.concatenate([[0], np.cumsum(counts)])
            first = 0
            while first < len(counts):  # about a quarter of a million words at a time
                last = max(int(np.searchsorted(begin, begin[first] + (1 << 18), side="right")) - 1, first + 1)
                taken = table.take(pa.array(codes[begin[first] : begin[last]]))
                offsets = np.frombuffer(taken.buffers()[1], dtype=np.int64)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, dtype=np.int64)
                ends = pa.py_buffer((offsets[begin[first : last + 1] - begin[first]]).tobytes())
                data = taken.buffers()[2] if len(taken) else pa.py_buffer(b"")
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), last - first, [None, ends, data])
                yield pa.RecordBatch.from_arrays([held["doc_ids"].slice(first, last - first), ids.cast(pa.binary())], names=result.names)
                first = last

        for batch in batches:
            column = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                if column["chunk"][i].as_py() != chunk:
                    if chunk is not None:
                        yield from done()
                    chunk, held, parts = column["chunk"][i].as_py(), None, []
                if column["bucket"][i].as_py() < 0:
                    held = {"doc_ids": column["doc_ids"][i].values} | {k: column[k][i].as_py() for k in ("counts", "blob", "n")}
                    continue
                flat = np.frombuffer(column["blob"][i].as_py(), dtype="<u2" if narrow else "<u4").astype("<u4")
                sizes = _unplaned(column["counts"][i].as_py(), column["n"][i].as_py())
                offsets = np.concatenate([[0], np.cumsum(sizes.astype(np.int64) * 4)])
                parts.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())]))
        if chunk is not None:
            yield from done()
        release()

    return both.repartition("chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(join_ids, result)


def _grouped(sorted_keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Each key of a sorted array and the values that stand at it."""
    if not len(sorted_keys):
        return [], []
    at = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return sorted_keys[at].tolist(), [x.tolist() for x in np.split(values, at[1:])]


def decode(encoded: DataFrame, path: str, *, ids: str = "ids", text: str = "text") -> DataFrame:
    """`encoded` with the column `text`, the pieces of its ids with a space between them, as the library decodes without a decoder of its own."""
    base = encoded.drop(text)
    schema = T.StructType([*base.schema, T.StructField(text, T.StringType())])

    if library(path).decoder is not None:
        raise ValueError("this file has a decoder of its own")

    def pieces() -> pa.Array:
        tok = library(path)
        return pa.array([tok.id_to_token(i) for i in range(tok.get_vocab_size())], pa.large_string())

    def run(batches):
        table = resident(("pieces", path), pieces)
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(batch.schema.get_field_index(ids)).cast(pa.large_binary()).fill_null(b"")
            size = pc.binary_length(column).to_numpy()
            cuts = np.flatnonzero(np.diff((np.cumsum(size) - size) >> 20)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                some = batch.slice(a, b - a)
                flat = np.frombuffer(b"".join(column.slice(a, b - a).to_pylist()), dtype="<u4")
                there = flat < len(table)
                offsets = np.concatenate([[0], np.cumsum(there)])[np.concatenate([[0], np.cumsum(size[a:b] // 4)])]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), table.take(pa.array(flat[there])))
                yield pa.RecordBatch.from_arrays([*some.columns, pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())], names=schema.names)
        release()

    return base.mapInArrow(run, schema)


def op12_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path)
    return texts.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
