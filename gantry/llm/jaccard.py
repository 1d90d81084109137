"""Exact n-gram Jaccard self-join with components.

A document is the set of its distinct word shingles. Sets that are equal are one node. Any two sets that reach the
threshold share one of their first few shingles in a fixed order (prefix filter): rare ones first, then by hash. The
nodes of such a shingle form a cell, in the order of their sizes. Cells are dealt by ranges of shingle, size and node,
so a cell of any number of members is spread over as many tasks as it needs, each of which goes over its stretch in
bounded tiles; tiles of one cell that lie apart are matched by their bounds, as sets of too different sizes can't link
and members that are known to be connected needn't. A small signature, the counts of the hashes' classes, bounds each
overlap from above and rules most members out; for the rest, bit counts of wide hashed bitmaps bound it again, and what
passes is held against the sorted arrays of hashes themselves.

Round 1 uses each node's two least hashes only, and of each cell only what lies near in the order; it finds most links
cheaply, and a pair that is already connected is not looked at again. Round 2 goes over all prefix cells for links
between different components of round 1, so that no link is lost. Links come out as forests of each tile, never as all
pairs of a group.

Cases: a null or empty text, or one without words, has the empty set and links with nothing; a text of fewer words than
a shingle is one shingle; ties and repeated rows fall in one node; an empty table gives an empty result. Hashes have
64 bits.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gantry.llm.common import byte_chunks, column_bytes, materialise, mix64, text_batches, whole_groups, word_hashes
from gantry.llm.graph import components
from gantry.session import discard, let_go, written

_U = np.uint64
#: Most members of a tile's side, and of the stretch of a cell that a task looks at at a time.
TILE, STRETCH = 128, 1024
#: Keys in a node's head, and keys of round 1.
HEAD, FIRST = 16, 2
#: Classes of the small count signature that goes with every member of a cell.
LANES = 32
#: Node ids that may be broadcast; beyond, the same filter is a shuffled join.
BROADCAST_IDS = 1_000_000


def shingle_sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for first, last, buffer, start, _ in byte_chunks(texts):
        h, owner = word_hashes(buffer, start)
        code = h * _U(0x9E3779B97F4A7C15)
        n = len(h) - words + 1
        if n > 0:
            code = mix64(h[:n])
            for k in range(1, words):
                code = mix64(code * _U(3) + h[k : k + n])
        bounds = np.searchsorted(owner, np.arange(last - first + 1))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(code[a : b - words + 1])
            elif b > a:
                few = mix64(np.array([b - a], dtype=np.uint64))
                for k in range(a, b):
                    few = mix64(few * _U(5) + h[k])
                yield few
            else:
                yield np.zeros(0, dtype=np.uint64)


def node_of(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.md5(hashes.tobytes()).digest()[:8], "little", signed=True)


def commonness(docs: DataFrame, words: int, text: str, total: int, sample: int = 10_000) -> np.ndarray:
    """How often shingles stand in about `sample` documents, by the upper 24 bits of their hashes, at most 255 each.

    It fixes the order of shingles, rare ones first. Any one order gives the same links, so an estimate from a bounded
    number of documents will do; it decides how many members the cells have, never what is found.
    """

    def count(batches):
        for batch in text_batches(batches, "text"):
            slots = [(hashes >> _U(40)).astype(np.int32) for hashes in shingle_sets(column_bytes(batch, "text"), words)]
            at, n = np.unique(np.concatenate(slots), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n, pa.int32())], names=["slot", "n"])

    some = docs.select(F.col(text).alias("text")).sample(min(1.0, sample / max(total, 1)), seed=1)
    found = some.mapInArrow(count, "slot int, n int").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    table = np.zeros(1 << 24, dtype=np.uint8)
    table[found.column("slot").to_numpy()] = np.minimum(found.column("n").to_numpy(), 255)
    return table


def bitmap(hashes: np.ndarray, per: int = 1) -> bytes:
    """A bitmap of about `per` bits for each shingle, a power of two wide."""
    width = max(256, 1 << (per * len(hashes) - 1).bit_length())
    bits = np.zeros(width, dtype=np.uint8)
    bits[(hashes & _U(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def lanes(hashes: np.ndarray) -> bytes:
    """How many hashes fall into each of LANES classes, at most 255 each."""
    return np.minimum(np.bincount((hashes & _U(LANES - 1)).astype(np.int64), minlength=LANES), 255).astype(np.uint8).tobytes()


def signatures(docs: DataFrame, words: int, percent: int, common, doc_id: str, text: str) -> DataFrame:
    """doc_id, node, n; and, for the first row of a node in its partition, its prefix and least hashes (longs), count signature and bitmap."""
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, node long, n long, prefix array<long>, mins array<long>, counts binary, bits binary"

    def run(batches):
        seen: set[int] = set()
        often = common.value
        for batch in text_batches(batches, "text"):
            nodes, sizes, prefixes, mins, counts, bits = [], [], [], [], [], []
            for hashes in shingle_sets(column_bytes(batch, "text"), words):
                n = len(hashes)
                node = node_of(hashes)
                nodes.append(node)
                sizes.append(n)
                if not n or node in seen:
                    prefixes.append(None)
                    mins.append(None)
                    counts.append(None)
                    bits.append(None)
                    continue
                seen.add(node)
                take = n - -(-percent * n // 100) + 1
                common_as = often[(hashes >> _U(40)).astype(np.int64)]
                order = hashes[np.argsort(common_as, kind="stable")]
                prefixes.append(order[:take].view(np.int64))
                # the least hashes that aren't everywhere: likely shared by sets that are alike
                usual = hashes[common_as < 255]
                mins.append((usual if len(usual) else order)[:FIRST].view(np.int64))
                counts.append(lanes(hashes))
                bits.append(bitmap(hashes))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(mins, pa.list_(pa.int64())), pa.array(counts, pa.binary()), pa.array(bits, pa.binary())],
                names=["doc_id", "node", "n", "prefix", "mins", "counts", "bits"],
            )

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def _groups(columns: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Runs of equal rows in sorted columns."""
    if not len(columns[0]):
        return
    new = np.zeros(len(columns[0]), dtype=bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new).tolist()
    yield from zip(at, [*at[1:], len(new)], strict=True)


def partners(n: np.ndarray, label: np.ndarray, counts: np.ndarray, percent: int, side: np.ndarray | None = None) -> np.ndarray:
    """Which members (sizes ascending) have a partner of another label, and of another side, that the bound does not rule out.

    An overlap is at most half of both sizes less what the counts of the classes differ by.
    """
    ok = np.zeros(len(n), dtype=bool)
    first = np.searchsorted(100 * n, percent * n)  # the first size that can link
    for y in range(1, len(n)):
        lo = first[y]
        if lo == y:
            continue
        apart = np.abs(counts[lo:y] - counts[y]).sum(axis=1)
        both = n[lo:y] + n[y]
        most = (both - apart) // 2
        hit = (100 * most >= percent * (both - most)) & (label[lo:y] != label[y])
        if side is not None:
            hit &= side[lo:y] != side[y]
        if hit.any():
            ok[y] = True
            ok[lo:y] |= hit
    return ok


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Count signatures as rows, without an object for each."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = [np.frombuffer(c.buffers()[2], dtype=np.uint8)[c.offset * LANES : (c.offset + len(c)) * LANES] for c in chunks if len(c)]
    return np.concatenate(parts).reshape(-1, LANES) if parts else np.zeros((0, LANES), dtype=np.uint8)


def _binary(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * LANES
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


#: `ready` rows are members of a tile to look at; others are members of a tile of a cell with more tiles elsewhere.
_MEMBER = ("key", "tile", "side", "node", "n", "label", "counts", "stretch", "ready")
_MEMBER_KINDS = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_())
_MEMBER_SCHEMA = "key long, tile long, side int, node long, n long, label long, counts binary, stretch long, ready boolean"
_READY_SCHEMA = "key long, tile long, side int, node long, n long, label long"


class _Cells:
    """Goes over members sorted by key, size and node, and gives members of tiles."""

    def __init__(self, percent: int, across: bool, most: int, stretch: int):
        self.percent, self.across, self.most, self.length = percent, across, most, stretch
        self.ids = itertools.count(TaskContext.get().partitionId() << 33)
        self.out: list[tuple] = []  # rows, tile, side, stretch, ready
        self.first = True  # no cell has ended yet: the first may have begun in another task

    def tile(self, at: np.ndarray, sides: np.ndarray, stretch: int, ready: bool = True) -> None:
        self.out.append((at, np.full(len(at), next(self.ids)), sides, stretch, ready))

    def stretch(self, rows: tuple, a: int, b: int, fresh: int, whole: bool) -> None:
        """Members a to b of one cell; those from `fresh` on were in no stretch before; `whole` if they are the cell."""
        _, _, n, label, counts = rows
        name = next(self.ids)
        if b - a > 1 and (label[a:b] != label[a]).any():
            at = a + np.flatnonzero(partners(n[a:b], label[a:b], counts[a:b].astype(np.int16), self.percent))
            blocks = [at[k : k + self.most] for k in range(0, len(at), self.most)]
            if not self.across and len(blocks) > 1:  # neighbouring blocks are one tile: two rows a member
                for x, y in zip(blocks, blocks[1:]):
                    both = np.concatenate([x, y])
                    if (label[both] != label[x[0]]).any():
                        self.tile(both, np.zeros(len(both), dtype=np.int32), name)
                blocks = []
            for i, x in enumerate(blocks):
                if (label[x] != label[x[0]]).any():
                    self.tile(x, np.zeros(len(x), dtype=np.int32), name)
                for y in blocks[i + 1 :]:
                    if 100 * n[x[-1]] < self.percent * n[y[0]]:
                        break
                    both = np.concatenate([x, y])
                    if (label[both] != label[x[0]]).any():
                        self.tile(both, np.repeat(np.array([0, 1], dtype=np.int32), [len(x), len(y)]), name)
        if self.across and not whole:
            for k in range(fresh, b, self.most):
                at = np.arange(k, min(k + self.most, b))
                self.tile(at, np.zeros(len(at), dtype=np.int32), name, False)

    def flush(self, rows: tuple) -> Iterator[pa.RecordBatch]:
        if not self.out:
            return
        at, tile, side = (np.concatenate([x[k] for x in self.out]) for k in range(3))
        times = [len(x[0]) for x in self.out]
        stretch, ready = (np.repeat(np.array([x[k] for x in self.out]), times) for k in (3, 4))
        self.out = []
        key, node, n, label, counts = rows
        columns = [key[at], tile, side, node[at], n[at], label[at], _binary(counts[at]), stretch, ready]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=k) for c, k in zip(columns, _MEMBER_KINDS, strict=True)], names=list(_MEMBER))

    def run(self, batches) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the cell in progress; the first `seen` of it were in a stretch before
        seen, split = 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = tuple(batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("key", "node", "n", "label")) + (_matrix(batch.column(batch.schema.get_field_index("counts"))),)
            if held is not None:
                rows = tuple(np.concatenate(x) for x in zip(held, rows, strict=True))
            key, node = rows[:2]
            twice = np.zeros(len(key), dtype=bool)  # a node may come from several partitions
            twice[1:] = (key[1:] == key[:-1]) & (node[1:] == node[:-1])
            rows = tuple(x[~twice] for x in rows)
            key = rows[0]
            last = int(np.searchsorted(key == key[-1], True)) if key[0] != key[-1] else 0
            pairs = np.zeros(len(key), dtype=bool)
            pairs[:-1] = key[1:] == key[:-1]
            pairs[0] |= self.first or split  # a cell that may go on in another task
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True):
                if a >= last:
                    break
                if pairs[a]:
                    self.stretch(rows, a, b, seen if a == 0 else a, not (a == 0 and (self.first or split)))
                if a == 0:
                    self.first, split, seen = False, False, 0
            at = last
            if last == 0:
                fresh = seen
            else:
                fresh = last
            while len(key) - at > self.length:
                self.stretch(rows, at, at + self.length, fresh, False)
                fresh, at, split = at + self.length, at + self.length - self.most, True  # neighbouring stretches overlap
            yield from self.flush(rows)
            held, seen = tuple(x[at:] for x in rows), fresh - at
        if held is not None:
            self.stretch(held, 0, len(held[0]), seen, False)
            yield from self.flush(held)


def cells(members: DataFrame, percent: int, across: bool) -> DataFrame:
    """Members of tiles that may have links to find, from members (key, node, n, label, counts) of cells.

    Without `across`, only members near in the order of their cell are brought together.
    """
    dealt = members.repartitionByRange("key", "n", "node").sortWithinPartitions("key", "n", "node").select("key", "node", "n", "label", "counts")
    most, stretch = TILE, STRETCH
    found = materialise(dealt.mapInArrow(lambda batches: _Cells(percent, across, most, stretch).run(batches), _MEMBER_SCHEMA), "tiles")
    ready = found.where("ready").select("key", "tile", "side", "node", "n", "label")
    if not across:
        return ready
    rest = found.where("not ready").drop("ready")
    tile = rest.groupBy("key", "tile").agg(F.first("stretch").alias("stretch"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("label").alias("l0"), F.max("label").alias("l1"))
    # most tiles of a large cell are of its main component alone; two of these have nothing to find
    top = tile.groupBy("key").agg(F.count("*").alias("tiles"), F.mode(F.when(F.col("l0") == F.col("l1"), F.col("l0"))).alias("top"))
    tile = tile.join(top.where("tiles > 1"), "key").withColumn("odd", ~F.coalesce((F.col("l0") == F.col("top")) & (F.col("l1") == F.col("top")), F.lit(False)))
    tile = materialise(tile.drop("tiles", "top"), "tile-bounds")
    a, b = (tile.select("key", *(F.col(c).alias(f"{x}_{c}") for c in tile.columns if c != "key")) for x in "ab")
    pairs = a.where("a_odd").join(b, "key").where("a_stretch <> b_stretch AND (NOT b_odd OR a_tile < b_tile) AND (a_l0 <> a_l1 OR b_l0 <> b_l1 OR a_l0 <> b_l0)")
    pairs = pairs.where((100 * F.col("a_hi") >= percent * F.col("b_lo")) & (100 * F.col("b_hi") >= percent * F.col("a_lo")))
    pairs = pairs.select("key", "a_tile", "b_tile", F.xxhash64("a_tile", "b_tile").alias("pair"))
    sides = pairs.select("key", F.explode(F.array(*(F.struct(F.col(f"{x}_tile").alias("tile"), F.lit(k).alias("side")) for k, x in enumerate("ab")))).alias("s"), "pair")
    both = sides.select("key", "s.tile", "s.side", "pair").join(rest.drop("side"), ["key", "tile"]).drop("tile").withColumnRenamed("pair", "tile")

    def run(batches):
        for t in whole_groups(batches, "key", "tile"):
            key, tile, side, node, n, label = (t.column(c).to_numpy() for c in ("key", "tile", "side", "node", "n", "label"))
            counts, stay = _matrix(t.column("counts")), []
            for a, b in _groups([key, tile]):
                stay.append(a + np.flatnonzero(partners(n[a:b], label[a:b], counts[a:b].astype(np.int16), percent, side[a:b])))
            at = np.concatenate(stay)
            yield pa.RecordBatch.from_arrays([pa.array(c[at]) for c in (key, tile, side, node, n, label)], names=["key", "tile", "side", "node", "n", "label"])

    dealt = both.select("key", "tile", "side", "node", "n", "label", "counts").repartition("key", "tile").sortWithinPartitions("key", "tile", "n", "node")
    return ready.unionByName(dealt.mapInArrow(run, _READY_SCHEMA))


def _pairs(n: list[int], side: list[int], percent: int, apart: bool) -> Iterator[tuple[int, int]]:
    """Pairs (earlier, later) whose sizes can link, sizes ascending; across the two sides only where there are two."""
    for y in range(1, len(n)):
        for x in range(y - 1, -1, -1):
            if 100 * n[x] < percent * n[y]:
                break
            if not apart or side[x] != side[y]:
                yield x, y


def may_link(bx: int, by: int, nx: int, ny: int, percent: int) -> bool:
    """Whether the bound on the overlap leaves a link possible; the bitmaps are of one width."""
    both = bx & by
    most = min(nx - (bx ^ both).bit_count(), ny - (by ^ both).bit_count())
    return 100 * most >= percent * (nx + ny - most)


def _fold(bits: int, width: int, to: int) -> int:
    while width > to:
        width >>= 1
        bits = (bits & ((1 << width) - 1)) | (bits >> width)
    return bits


def passing(rows: DataFrame, percent: int) -> DataFrame:
    """Members of tiles (with bits and head) that have a partner whom the bit counts don't rule out.

    A pair that meets in many cells counts in one: where the heads, the least of both nodes' keys, have any in common,
    in the cell of the least such. So of each head only the keys below the cell's own matter: they are numbered in
    the tile, and a member has a mask of its numbers.
    """

    def run(batches):
        for t in whole_groups(batches, "key", "tile"):
            key, tile, side, node, n, label = (t.column(c).to_numpy() for c in ("key", "tile", "side", "node", "n", "label"))
            bits, head = t.column("bits").to_pylist(), t.column("head").to_pylist()
            stay = np.zeros(len(key), dtype=bool)
            for a, b in _groups([key, tile]):
                size, sides, labels = n[a:b].tolist(), side[a:b].tolist(), label[a:b].tolist()
                maps, widths = [int.from_bytes(x, "little") for x in bits[a:b]], [8 * len(x) for x in bits[a:b]]
                own, number, below = int(key[a]), {}, []
                for hs in head[a:b]:
                    mask = 0
                    for h in hs:
                        if h < own:
                            mask |= 1 << number.setdefault(h, len(number))
                    below.append(mask)
                ok = [False] * (b - a)
                for x, y in _pairs(size, sides, percent, max(sides) > 0):
                    if labels[x] == labels[y] or (ok[x] and ok[y]) or below[x] & below[y]:
                        continue
                    w = min(widths[x], widths[y])
                    if may_link(_fold(maps[x], widths[x], w), _fold(maps[y], widths[y], w), size[x], size[y], percent):
                        ok[x] = ok[y] = True
                stay[a:b] = ok
            at = np.flatnonzero(stay)
            yield pa.RecordBatch.from_arrays([pa.array(c[at]) for c in (key, tile, side, node, n, label)], names=["key", "tile", "side", "node", "n", "label"])

    dealt = rows.repartition("key", "tile").sortWithinPartitions("key", "tile", "n", "node")
    return dealt.mapInArrow(run, _READY_SCHEMA)


def verified(rows: DataFrame, percent: int) -> DataFrame:
    """Links a, b between the labels of tiles whose rows carry their arrays of hashes: a forest of each tile, every link exact."""

    def run(batches):
        for t in whole_groups(batches, "key", "tile"):
            key, tile, side, node, n, label = (t.column(c).to_numpy() for c in ("key", "tile", "side", "node", "n", "label"))
            hashes, found = t.column("hashes"), []
            for a, b in _groups([key, tile]):
                sets = [np.frombuffer(x.as_buffer(), dtype="<u8") for x in hashes.slice(a, b - a)]
                found += _forest(node[a:b].tolist(), n[a:b].tolist(), side[a:b].tolist(), label[a:b].tolist(), sets, percent, side[a:b].max() > 0)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    dealt = rows.repartition("key", "tile").sortWithinPartitions("key", "tile", "n", "node")
    return dealt.mapInArrow(run, "a long, b long")


def _forest(node, n, side, label, hashes, percent, apart) -> list[tuple[int, int]]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    width = 1 << (4 * max(n) - 1).bit_length()
    maps = []
    for h in hashes:
        bits = np.zeros(max(width, 256), dtype=np.uint8)
        bits[(h & _U(len(bits) - 1)).astype(np.int64)] = 1
        maps.append(int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little"))
    out = []
    for x, y in _pairs(n, side, percent, apart):
        if label[x] == label[y] or node[x] == node[y]:
            continue
        p, q = find(label[x]), find(label[y])
        if p == q or not may_link(maps[x], maps[y], n[x], n[y], percent):
            continue
        common = len(np.intersect1d(hashes[x], hashes[y], assume_unique=True))
        if 100 * common >= percent * (n[x] + n[y] - common):
            root[max(p, q)] = min(p, q)
            out.append((label[x], label[y]))
    return out


def arrays_of(docs: DataFrame, wanted: DataFrame, words: int, doc_id: str, text: str) -> DataFrame:
    """node and hashes (binary) of the documents whose ids are in `wanted` (column id), recomputed from their texts."""
    ids = wanted.select("id").distinct()
    if wanted.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(ids, "id", "left_semi").select("text")

    def run(batches):
        for batch in text_batches(batches, "text"):
            sets = list(shingle_sets(column_bytes(batch, "text"), words))
            yield pa.RecordBatch.from_arrays([pa.array([node_of(h) for h in sets], pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())], names=["node", "hashes"])

    return rows.mapInArrow(run, "node long, hashes binary")


def with_components(docs: DataFrame, *, words: int = 3, percent: int = 90, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) for each row of `docs`.

    Sets link when 100 * intersection >= percent * union. Rows with a null id are placed in a component but name none.
    """
    spark = docs.sparkSession
    docs = docs.select(doc_id, text)
    common = spark.sparkContext.broadcast(commonness(docs, words, text, docs.count()))  # 16 MB
    sig = materialise(signatures(docs, words, percent, common, doc_id, text), "signatures")
    common.unpersist()
    sets = materialise(sig.groupBy("node").agg(F.min("doc_id").alias("id"), F.max("n").alias("n")), "sets")
    nodes, begun = sig.where(F.col("prefix").isNotNull()), len(written(spark))

    first = nodes.select(F.explode("mins").alias("key"), "node", "n", F.col("node").alias("label"), "counts")
    found = materialise(_verify(docs, _passing(cells(first, percent, False), _maps(nodes, "mins"), percent), sets, percent, words, doc_id, text), "links")
    let_go(spark)
    stay = written(spark)[:begun]
    roots = materialise(components(found), "roots")
    discard(spark, [p for p in written(spark)[:-1] if p not in stay])  # what round 1 has made on its way

    labelled = nodes.join(roots, "node", "left").select("node", "n", "prefix", "counts", F.coalesce("root", "node").alias("label"))
    rest = labelled.select(F.explode("prefix").alias("key"), "node", "n", "label", "counts")
    more = materialise(_verify(docs, _passing(cells(rest, percent, True), _maps(nodes, "prefix"), percent), sets, percent, words, doc_id, text), "links")
    let_go(spark)
    tops = components(more)  # of the components of round 1
    joined = roots.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    roots = materialise(joined.unionByName(tops.join(roots.select("node"), "node", "left_anti").select("node", "root")), "roots")

    lowest = sets.join(roots, "node").groupBy("root").agg(F.min("id").alias("lowest"))
    of_node = sets.join(roots.join(lowest, "root"), "node", "left").select("node", F.coalesce("lowest", "id").alias("component_id"))
    of_node = materialise(of_node, "of-node")  # a table on either side: a hot node's join can be split
    out = sig.select("doc_id", "node", F.col("n").alias("n_shingles")).join(of_node, "node")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _maps(nodes: DataFrame, keys: str) -> DataFrame:
    return nodes.select("node", "bits", F.slice(F.array_sort(keys), 1, HEAD).alias("head")).dropDuplicates(["node"])


def _passing(tiles: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    let_go(tiles.sparkSession)  # of the shuffle that dealt the tiles
    out = materialise(passing(tiles.join(bits, "node"), percent), "cells")
    let_go(tiles.sparkSession)
    return out


def _verify(docs: DataFrame, tiles: DataFrame, sets: DataFrame, percent: int, words: int, doc_id: str, text: str) -> DataFrame:
    wanted = materialise(sets.join(tiles.select("node").distinct(), "node", "left_semi").select("id"), "wanted")
    arrays = arrays_of(docs, wanted, words, doc_id, text)
    return verified(tiles.join(arrays, "node"), percent)


def keep_one(docs: DataFrame, *, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of `docs` for each component: that of the smallest id, null ids last, and one of several such; all columns stay.

    Rows without a word link with nothing and all stay.
    """
    number = next(n for n in map("row{}".format, itertools.count()) if n not in docs.columns)
    rows = materialise(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    members = with_components(rows, words=words, percent=percent, doc_id=number, text=text).where("n_shingles > 0").select(F.col("doc_id").alias("r"), F.col("component_id").alias("c"))
    members = materialise(members, "members")
    several = members.where("r <> c").select("c").distinct()
    ids = rows.select(F.col(number).alias("i"), F.struct(F.col(f"`{doc_id}`").isNull().alias("none"), F.col(f"`{doc_id}`").alias("id"), F.col(number).alias("r")).alias("place"))
    placed = members.join(several, "c").join(ids, F.col("r") == F.col("i")).select("r", "c", "place")
    best = placed.groupBy("c").agg(F.min("place").alias("best"))
    gone = materialise(placed.join(best, "c").where("place.r <> best.r").select(F.col("r").alias(number)), "gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return rows.join(gone, number, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_components(docs, words=3, percent=90)
