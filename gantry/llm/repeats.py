"""Removal of repeated byte strings through a sparse enhanced suffix array.

Every window of `least` bytes has an anchor, the smallest hash of its `ANCHOR`-byte substrings, so equal windows have
equal anchors wherever they stand. Runs of windows of one anchor are segments. Equal segments are settled by their
hashes (anchor and content, 128 bits): all but the first go whole. Where one anchor stands in different contexts, the
contexts of that anchor, one for each different segment, are brought together. Their windows are sorted as suffixes,
with the length of the prefix each shares with its neighbour, and a stack scan gives the tree of common-prefix
intervals. An interval whose members are preceded by different bytes is a maximal repeat group with all its
occurrences, and all but its first occurrence are removed; what an inner group has settled, outer ones pass over.
`maximal_repeats` returns the groups with all their occurrences as a table.

Anchors that stand in very many contexts (a bounded list, found first, and any others that turn out so) are settled
window by window instead, so no key gathers a large part of the corpus; tasks combine their own equal segments before
anything is shuffled, and read their keys in order, a bounded part at a time.

Cases: a null or empty text has nothing to remove; rows with a null id are left as they are and count for nothing; ids
are unique and of any type that has an order, and repeated rows of one id and text are one document; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gantry.llm.common import BYTE_VALUES, byte_chunks, column_bytes, materialise, mix64, powers, prefix_hash, span_hash, text_batches, whole_groups

_U = np.uint64
_UPPER = _U(0xFFFFFFFF00000000)
ANCHOR = 32
#: Segments are cut after so many windows; text of a short period would else be one segment.
MOST_WINDOWS = 512
#: Different contexts of an anchor that are sorted together; anchors with more are settled window by window.
MOST_CONTEXTS = 4000
_COMBINE = 300_000
#: Bytes of text that are unpacked and hashed together, and bytes of contexts that are sorted together.
_TEXT_BYTES, _HASH_BYTES, _SORT_BYTES = 1 << 21, 1 << 19, 1 << 19


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` neighbours."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def segments(texts: list[bytes], least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For each chunk: text number, first window, number of windows, anchor, content hash and whether it may repeat itself; then the chunk's prefix sums and first windows in it."""
    for first, _, buffer, start, length in byte_chunks(texts, limit=_HASH_BYTES):
        full = np.flatnonzero(length >= least)
        if not len(full):
            continue
        prefix = prefix_hash(buffer, BYTE_VALUES)
        _, down = powers(len(buffer))
        grams = mix64((prefix[ANCHOR:] - prefix[:-ANCHOR]) * down[: len(buffer) - ANCHOR + 1])
        # the leftmost of the smallest by their upper halves; the lower halves of `place` are positions
        place = sliding_min((grams & _UPPER) | np.arange(len(grams), dtype=np.uint64), least - ANCHOR + 1) & ~_UPPER
        anchor = grams[place.astype(np.int64)]
        n_windows = length[full] - least + 1
        # one entry for each place where a run may begin
        change = np.zeros(len(anchor) + 1, dtype=bool)
        change[1:-1] = anchor[1:] != anchor[:-1]
        inside = np.zeros(len(anchor) + 2, dtype=np.int32)
        np.add.at(inside, start[full], 1)
        np.add.at(inside, start[full] + n_windows, -1)
        inside = np.cumsum(inside[:-1]) > 0
        change[start[full]] = True
        lo = np.flatnonzero(change[:-1] & inside[:-1])
        owner = full[np.searchsorted(start[full], lo, side="right") - 1]
        last = start[owner] + length[owner] - least + 1
        hi = np.minimum(np.append(lo[1:], len(anchor)), last)
        n = hi - lo
        # equal windows of one run have its anchor at different places
        inner = place[lo] != place[hi - 1]
        if (n > MOST_WINDOWS).any():
            parts = -(-n // MOST_WINDOWS)
            at = np.repeat(np.arange(len(n)), parts)
            k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            lo, owner, inner, n = lo[at] + k * MOST_WINDOWS, owner[at], inner[at], np.minimum(n[at] - k * MOST_WINDOWS, MOST_WINDOWS)
        yield first + owner, lo - start[owner], n, anchor[lo], span_hash(prefix, lo, lo + n - 1 + least), inner, prefix, lo


def frequent_anchors(docs: DataFrame, least: int, at_least: int, local_share: float = 0.002) -> np.ndarray:
    """Anchors of about `at_least` segments or more; only the way, never the result, depends on this bounded list."""

    def count(batches):
        held, seen, block, size = (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)), 0, [], 0

        def fold(held, block):
            codes, n = np.unique(np.concatenate(block), return_counts=True)
            codes, n = codes[n > 1], n[n > 1]
            both, at = np.unique(np.concatenate([held[0], codes]), return_inverse=True)
            return both, np.bincount(at, weights=np.concatenate([held[1], n]), minlength=len(both)).astype(np.int64)

        for batch in text_batches(batches, "text", limit=_TEXT_BYTES):
            texts = column_bytes(batch, "text")
            seen += len(texts)
            for found in segments(texts, least):
                block.append(found[3])
                size += len(found[3])
                if size > _COMBINE:
                    held, block, size = fold(held, block), [], 0
        if block:
            held = fold(held, block)
        keep = held[1] >= max(3, local_share * seen)
        yield pa.RecordBatch.from_arrays([pa.array(held[0][keep].view(np.int64)), pa.array(held[1][keep])], names=["key", "n"])

    counts = docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return np.sort(counts.where(F.col("n") >= at_least).select("key").toArrow().column("key").to_numpy().view(np.uint64))


_SEGMENT = "key long, kind int, doc_id long, lo long, n long, content long"
_NAMES = ["key", "kind", "doc_id", "lo", "n", "content"]
_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
#: kind: a segment to settle; a span [lo, lo + n) to remove; a context to look into; a segment that may repeat itself; a context of very many.
SETTLE, SPAN, CONTEXT, INNER, WIDE = 0, 1, 2, 3, 4


def _batch(columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES)


def _firsts(key, content, doc, lo) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, content and place; and which rows, in that order, are the first of their key and content, and which stand later.

    Repeated rows of a document give entries of one place: what stands where the first does is neither.
    """
    order = np.lexsort((lo, doc, content, key))
    k, c = key[order], content[order]
    first = np.ones(len(order), dtype=bool)
    first[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    of = order[np.flatnonzero(first)][np.cumsum(first) - 1] if len(order) else order
    return order, first, (doc[order] != doc[of]) | (lo[order] != lo[of])


def _merged(doc, lo, hi) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching spans of a document as one."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    group = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])])
    top = int(hi.max()) + 1
    reach = np.maximum.accumulate(hi + group * top) - group * top
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (lo[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return doc[at], lo[at], np.maximum.reduceat(hi, at)


def _doc_key(doc: np.ndarray) -> np.ndarray:
    return mix64(doc.astype(np.int64).view(np.uint64)).view(np.int64)


class _Local:
    """Segments of a task, equal ones combined: the later ones leave as spans."""

    def __init__(self, least: int):
        self.least, self.held, self.size = least, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        """key, content, doc, lo, n, inner"""
        self.held.append(columns)
        self.size += len(columns[0])
        if self.size > _COMBINE:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        key, content, doc, lo, n, inner = (np.concatenate(c) for c in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        order, first, later = _firsts(key, content, doc, lo)
        gone, kept = order[later], order[first]
        yield _batch([key[kept], np.where(inner[kept], INNER, SETTLE), doc[kept], lo[kept], n[kept], content[kept]])
        d, a, b = _merged(doc[gone], lo[gone], lo[gone] + n[gone] - 1 + self.least)
        yield _batch([_doc_key(d), np.full(len(d), SPAN, dtype=np.int32), d, a, b - a, np.zeros(len(d), dtype=np.int64)])


def local_segments(docs: DataFrame, least: int, frequent) -> DataFrame:
    """Segments of all documents; the windows of frequent anchors are segments of their own."""

    def run(batches):
        hot, local = frequent.value, _Local(least)
        for batch in text_batches(batches, "text", limit=_TEXT_BYTES):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for number, lo, n, anchor, content, inner, prefix, at in segments(column_bytes(batch, "text"), least):
                doc = ids[number]
                if len(hot):
                    wide = hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor
                    if wide.any():  # each window for itself
                        w = np.repeat(np.flatnonzero(wide), n[wide])
                        k = np.arange(len(w)) - np.repeat(np.cumsum(n[wide]) - n[wide], n[wide])
                        h = span_hash(prefix, at[w] + k, at[w] + k + least)
                        yield from local.add(h.view(np.int64), anchor[w].view(np.int64), doc[w], lo[w] + k, np.ones(len(w), dtype=np.int64), np.zeros(len(w), dtype=bool))
                        doc, lo, n, anchor, content, inner = (x[~wide] for x in (doc, lo, n, anchor, content, inner))
                yield from local.add(anchor.view(np.int64), content.view(np.int64), doc, lo, n, inner)
        yield from local.flush()

    return docs.mapInArrow(run, _SEGMENT)


def windows_of(rows: DataFrame, least: int) -> DataFrame:
    """The windows of contexts (key, doc_id, lo, context) as segments of their own."""

    def run(batches):
        local = _Local(least)
        for batch in text_batches(batches, "context", limit=_TEXT_BYTES):
            key, doc, lo = (batch.column(k).to_numpy() for k in range(3))
            for first, _, buffer, start, length in byte_chunks(column_bytes(batch, "context"), limit=_HASH_BYTES):
                n = length - least + 1
                w = np.repeat(np.arange(len(n)), n)
                k = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
                h = span_hash(prefix_hash(buffer, BYTE_VALUES), start[w] + k, start[w] + k + least)
                yield from local.add(h.view(np.int64), key[first + w], doc[first + w], lo[first + w] + k, np.ones(len(w), dtype=np.int64), np.zeros(len(w), dtype=bool))
        yield from local.flush()

    return rows.mapInArrow(run, _SEGMENT)


class _Settle:
    """Goes over segments sorted by key, content and place: equal ones but the first are spans, and anchors in several contexts give them out."""

    def __init__(self, least: int, most: int):
        self.least, self.most = least, most
        self.first: tuple[int, int, int, int] | None = None  # key, content and place of the last first one
        self.held: list[np.ndarray] = []  # the contexts so far of the last key
        self.wide = False

    def _contexts(self, rows: np.ndarray, kind: int) -> pa.RecordBatch:
        key, doc, lo, n = (rows[:, k] for k in range(4))
        return _batch([key, np.full(len(rows), kind, dtype=np.int32), doc, lo, n, np.zeros(len(rows), dtype=np.int64)])

    def _close(self) -> Iterator[pa.RecordBatch]:
        """The key that was held has ended."""
        if self.held:
            rows = np.concatenate(self.held)
            if self.wide:
                yield self._contexts(rows, WIDE)
            elif len(rows) > 1 or rows[0, 4]:
                yield self._contexts(rows, CONTEXT)
        self.held, self.wide = [], False

    def run(self, batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key, kind, doc, lo, n, content = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in _NAMES)
            s = kind != SPAN
            k, c, d, p, m, x = key[s], content[s], doc[s], lo[s], n[s], kind[s]
            new = np.ones(len(k), dtype=bool)
            new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
            if len(k) and self.first is not None:
                new[0] = (k[0], c[0]) != self.first[:2]
            if len(k):
                group = np.cumsum(new) - 1  # -1 for what goes on from the batch before
                at = np.flatnonzero(new)
                first_doc, first_lo = (np.append(v[at], self.first[j] if self.first is not None else 0)[group] for j, v in ((2, d), (3, p)))
                later = (d != first_doc) | (p != first_lo)  # repeated rows stand where the first does
                self.first = (int(k[-1]), int(c[-1]), int(first_doc[-1]), int(first_lo[-1]))
            else:
                later = np.zeros(0, dtype=bool)
            sd, a, b = _merged(np.concatenate([doc[~s], d[later]]), np.concatenate([lo[~s], p[later]]), np.concatenate([(lo + n)[~s], (p + m - 1 + self.least)[later]]))
            yield _batch([_doc_key(sd), np.full(len(sd), SPAN, dtype=np.int32), sd, a, b - a, np.zeros(len(sd), dtype=np.int64)])
            if not len(k) or not new.any():
                continue
            rows = np.stack([k[new], d[new], p[new], m[new], (x[new] == INNER).astype(np.int64)], axis=1)
            if self.held and self.held[-1][-1, 0] != rows[0, 0]:
                yield from self._close()
            cut = int(np.searchsorted(rows[:, 0] == rows[-1, 0], True)) if rows[0, 0] != rows[-1, 0] else 0
            if cut:
                whole = rows[:cut]
                if self.held:
                    end = int(np.searchsorted(whole[:, 0] != whole[0, 0], True)) if whole[0, 0] != whole[-1, 0] else len(whole)
                    self.held.append(whole[:end])
                    yield from self._close()
                    whole = whole[end:]
                if len(whole):
                    several = whole[:, 4] == 1
                    several[1:] |= whole[1:, 0] == whole[:-1, 0]
                    several[:-1] |= whole[1:, 0] == whole[:-1, 0]
                    yield self._contexts(whole[several], CONTEXT)
            self.held.append(rows[cut:])
            if sum(map(len, self.held)) > self.most:
                self.wide = True
                yield self._contexts(np.concatenate(self.held[:-1] or [rows[:0]]), WIDE)
                self.held = self.held[-1:]
        yield from self._close()


def settled(rows: DataFrame, least: int) -> DataFrame:
    """Equal segments settled across tasks: spans to remove, and the contexts of anchors that stand in several."""
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key", "content", "doc_id", "lo")
    most = MOST_CONTEXTS
    return dealt.mapInArrow(lambda batches: _Settle(least, most).run(batches), _SEGMENT)


def contexts(docs: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """key, doc_id, lo and the bytes of each wanted context. `docs` is dealt by doc_id."""
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("key", "lo", "n")).alias("wanted"))
    rows = docs.join(lists.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "wanted")

    def run(batches):
        for batch in text_batches(batches, "text", limit=_TEXT_BYTES):
            lists = batch.column(2)
            lengths = lists.value_lengths().to_numpy()
            flat = lists.flatten()
            key, lo, n = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("key", "lo", "n"))
            doc = np.repeat(batch.column(0).to_numpy(), lengths)
            texts = column_bytes(batch, "text")
            which = np.repeat(np.arange(len(texts)), lengths).tolist()
            parts = [texts[w][a : a + m - 1 + least] for w, a, m in zip(which, lo.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(doc, pa.int64()), pa.array(lo, pa.int64()), pa.array(parts, pa.binary())], names=["key", "doc_id", "lo", "context"])

    return rows.mapInArrow(run, "key long, doc_id long, lo long, context binary")


def suffix_order(buffer: np.ndarray, at: np.ndarray, group: np.ndarray, least: int) -> np.ndarray:
    """The order of suffixes by group and their first `least` bytes."""
    words = -(-least // 8)
    padded = np.concatenate([buffer, np.zeros(8 * words, dtype=np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, 8 * words)[at].copy()
    view[:, least:] = 0
    columns = view.view(">u8").astype(np.uint64)
    return np.lexsort((*columns.T[::-1], group))


def common_prefix(buffer: np.ndarray, x: int, x_end: int, y: int, y_end: int) -> int:
    m = min(x_end - x, y_end - y)
    differ = np.flatnonzero(buffer[x : x + m] != buffer[y : y + m])
    return int(differ[0]) if len(differ) else m


def interval_tree(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """Stack scan: (length, first, last) of every common-prefix interval of `least` or more, children before parents.

    `lcp[i]` is shared by suffixes i and i + 1.
    """
    stack: list[list[int]] = []
    for i, value in enumerate([*lcp, 0]):
        begin = i
        while stack and stack[-1][0] > value:
            length, begin = stack.pop()
            yield length, begin, i
        if value >= least and (not stack or stack[-1][0] < value):
            stack.append([value, begin])


def equal_runs(buffer: np.ndarray, begin: np.ndarray, end: np.ndarray, group: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]]:
    """Runs of the suffix array whose members share `least` bytes and more, within each group of contexts [begin, end).

    Gives places in the buffer, contexts, the bytes before (a value of its own where a context begins) and the shared
    prefixes of neighbours. Left-extension diversity: a run all of whose members follow the same byte is part of a
    longer repeat and is left out.
    """
    windows = np.maximum(end - begin - least + 1, 0)
    context = np.repeat(np.arange(len(begin)), windows)
    at = begin[context] + np.arange(len(context)) - np.repeat(np.cumsum(windows) - windows, windows)
    # windows whose hash stands alone in their group are no repeat
    key = span_hash(prefix_hash(buffer, BYTE_VALUES), at, at + least) ^ mix64(group[context].astype(np.int64).view(np.uint64))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(order), dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    context, at = context[twice], at[twice]
    order = suffix_order(buffer, at, group[context], least)
    context, at = context[order], at[order]
    before = np.where(at > begin[context], buffer[np.maximum(at - 1, 0)].astype(np.int64), -1 - np.arange(len(at)))
    equal = group[context[1:]] == group[context[:-1]]
    for k in range(least):
        equal &= buffer[at[1:] + k] == buffer[at[:-1] + k]
    cut = np.flatnonzero(np.concatenate([[True], ~equal, [True]])) if len(at) else np.zeros(1, dtype=np.int64)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b - a < 2 or (before[a:b] == before[a]).all():
            continue
        # the order so far compares `least` bytes; what follows decides among these few
        tails = a + np.array(sorted(range(b - a), key=lambda i: buffer[at[a + i] + least : end[context[a + i]]].tobytes()))
        place, ctx = at[tails], context[tails]
        stop = end[ctx]
        lcp = [common_prefix(buffer, x, x_end, y, y_end) for x, x_end, y, y_end in zip(place[:-1].tolist(), stop[:-1].tolist(), place[1:].tolist(), stop[1:].tolist(), strict=True)]
        yield place, ctx, before[tails], lcp


def maximal_intervals(lcp: list[int], left: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """Intervals of the tree whose members are preceded by different bytes: (length, first, last), children before parents."""
    changes = np.concatenate([[0], np.cumsum(left[1:] != left[:-1])])
    for length, lo, hi in interval_tree(lcp, least):
        if changes[hi] != changes[lo]:
            yield length, lo, hi


def repeat_groups(buffer: np.ndarray, begin: np.ndarray, end: np.ndarray, group: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Maximal repeat groups among contexts: the length, and the context and place of every occurrence."""
    for place, ctx, left, lcp in equal_runs(buffer, begin, end, group, least):
        for length, lo, hi in maximal_intervals(lcp, left, least):
            yield length, ctx[lo : hi + 1], place[lo : hi + 1]


def later_lengths(lcp: list[int], left: np.ndarray, rank: list[int], least: int) -> dict[int, int]:
    """For suffixes (by rank; 0 is the earliest) the length that a maximal group shares with an earlier occurrence of it.

    Of every group all but the earliest occurrence have one. Children come before parents, so what an inner group has
    settled has the longest already; each suffix is settled once and then passed over.
    """
    found: dict[int, int] = {}
    after = list(range(len(rank) + 1))

    def unsettled(i: int) -> int:
        while after[i] != i:
            after[i] = after[after[i]]
            i = after[i]
        return i

    for length, lo, hi in maximal_intervals(lcp, left, least):
        best = unsettled(lo)
        at = unsettled(best + 1)
        while at <= hi:
            late, best = (at, best) if rank[at] > rank[best] else (best, at)
            found[rank[late]] = length
            after[late] = late + 1
            at = unsettled(at + 1)
    return found


def _looked(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Contexts (key, doc_id, lo, context; whole keys, in the order of their places) a bounded part at a time: rows, their bytes, where each begins and ends."""
    key, doc, lo = (table.column(c).to_numpy() for c in ("key", "doc_id", "lo"))
    again = np.zeros(len(key), dtype=bool)
    again[1:] = (np.diff(key) == 0) & (np.diff(doc) == 0) & (np.diff(lo) == 0)  # repeated rows give a context once
    at = np.flatnonzero(~again)
    texts = table.column("context")
    size = np.cumsum(pc.binary_length(texts).to_numpy()[at])
    starts = np.flatnonzero(np.concatenate([[True], key[at][1:] != key[at][:-1]]))
    cuts, reach = [0], 0
    for s in starts.tolist():
        if s and size[s - 1] - reach > _SORT_BYTES:
            cuts.append(s)
            reach = size[s - 1]
    for a, b in zip(cuts, [*cuts[1:], len(at)], strict=True):
        rows = at[a:b]
        parts = [texts[int(i)].as_py() for i in rows]
        buffer = np.frombuffer(b"".join(parts), dtype=np.uint8)
        end = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)))
        begin = end - np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        yield rows, buffer, begin, end


def _by_key(rows: DataFrame) -> DataFrame:
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key", "doc_id", "lo")


def context_spans(rows: DataFrame, least: int) -> DataFrame:
    """Spans to remove (doc_id, lo, n) from maximal repeat groups within the contexts of each key."""

    def run(batches):
        for t in whole_groups(batches, "key"):
            key, doc, lo = (t.column(c).to_numpy() for c in ("key", "doc_id", "lo"))
            out = []
            for rows, buffer, begin, end in _looked(t):
                for place, ctx, left, lcp in equal_runs(buffer, begin, end, key[rows], least):
                    where, owner = lo[rows[ctx]] + place - begin[ctx], doc[rows[ctx]]
                    order = np.lexsort((where, owner))
                    rank = np.empty(len(order), dtype=np.int64)
                    rank[order] = np.arange(len(order))
                    lengths = later_lengths(lcp, left, rank.tolist(), least)
                    later = order[np.fromiter(lengths, dtype=np.int64, count=len(lengths))]
                    out.append((owner[later], where[later], where[later] + np.fromiter(lengths.values(), dtype=np.int64, count=len(lengths))))
            if out:
                d, a, b = _merged(*(np.concatenate(c) for c in zip(*out, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(a, pa.int64()), pa.array(b - a, pa.int64())], names=["doc_id", "lo", "n"])

    return _by_key(rows).mapInArrow(run, "doc_id long, lo long, n long")


def repeated_spans(docs: DataFrame, dealt: DataFrame, least: int) -> DataFrame:
    """doc_id, lo, n of bytes to remove; `dealt` is `docs` dealt by doc_id."""
    total = docs.count()
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_anchors(docs, least, max(2000, total // 100_000)))  # at most some millions of numbers
    found = materialise(settled(local_segments(docs, least, frequent), least), "settled")
    spans = found.where(F.col("kind") == SPAN).select("doc_id", "lo", "n")
    spans = spans.unionByName(context_spans(contexts(dealt, _wanted(found, CONTEXT), least), least))
    if found.where(F.col("kind") == WIDE).isEmpty():
        return spans
    wide = settled(windows_of(contexts(dealt, _wanted(found, WIDE), least), least), least)
    return spans.unionByName(wide.where(F.col("kind") == SPAN).select("doc_id", "lo", "n"))


def _wanted(found: DataFrame, kind: int) -> DataFrame:
    return found.where(F.col("kind") == kind).select("doc_id", "key", "lo", "n")


def maximal_repeats(docs: DataFrame, *, least: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Maximal repeat groups with all their occurrences: group_id, length, doc_id, lo.

    A group is maximal within the stretch of text of its anchor: a longer repeat gives one group for each of its anchors.
    The contexts of an anchor are sorted once each; where equal ones stand, all their places are joined to them.
    """
    every = _numbered(docs, doc_id, text).where(F.col("number").isNotNull())
    numbered = every.select(F.col("number").alias("doc_id"), "text").distinct()
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = numbered.repartition(width, "doc_id")

    def run(batches):
        for batch in text_batches(batches, "text", limit=_TEXT_BYTES):
            ids = batch.column(0).to_numpy()
            for number, lo, n, anchor, content, inner, _, _ in segments(column_bytes(batch, "text"), least):
                yield _batch([anchor.view(np.int64), np.where(inner, INNER, SETTLE), ids[number], lo, n, content.view(np.int64)])

    places = materialise(dealt.mapInArrow(run, _SEGMENT), "places")
    one = places.groupBy("key", "content").agg(F.count("*").alias("times"), F.max("kind").alias("kind"), F.min(F.struct("doc_id", "lo", "n")).alias("at"))
    keys = one.groupBy("key").agg(F.sum("times").alias("all"), F.max("kind").alias("most")).where((F.col("all") > 1) | (F.col("most") == INNER)).select("key")
    one = materialise(one.join(keys, "key").select("key", "content", "times", "at.*"), "distinct-contexts")
    found = contexts(dealt, one.select("doc_id", "key", "lo", "n"), least)

    def groups(batches):
        for t in whole_groups(batches, "key"):
            key, doc, lo = (t.column(c).to_numpy() for c in ("key", "doc_id", "lo"))
            for rows, buffer, begin, end in _looked(t):
                columns = [[], [], [], [], [], []]
                for length, ctx, place in repeat_groups(buffer, begin, end, key[rows], least):
                    text = buffer[place[0] : place[0] + length].tobytes()
                    name = int.from_bytes(hashlib.md5(text + int(key[rows[ctx[0]]]).to_bytes(8, "little", signed=True)).digest()[:8], "little", signed=True)
                    for c, v in zip(columns, (np.full(len(ctx), name), np.full(len(ctx), length), key[rows[ctx]], doc[rows[ctx]], lo[rows[ctx]], place - begin[ctx]), strict=True):
                        c.append(v)
                if columns[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in columns], names=["group_id", "length", "key", "doc_id", "lo", "offset"])

    inner = _by_key(found).mapInArrow(groups, "group_id long, length long, key long, doc_id long, lo long, offset long")
    inner = materialise(inner, "inner-groups")
    # a context that stands several times and in no other as a whole is a group of its places
    whole = inner.where("offset = 0").select(F.col("key").alias("k"), F.col("doc_id").alias("d"), F.col("lo").alias("l"), F.col("length").alias("n"))
    twice = one.where("times > 1").select(F.xxhash64("key", "content").alias("group_id"), (F.col("n") + (least - 1)).alias("length"), "key", "doc_id", "lo", F.lit(0).cast("long").alias("offset"))
    twice = twice.join(whole, (F.col("key") == F.col("k")) & (F.col("doc_id") == F.col("d")) & (F.col("lo") == F.col("l")) & (F.col("length") == F.col("n")), "left_anti")
    at = one.select(F.col("key").alias("k"), "content", F.col("doc_id").alias("d"), F.col("lo").alias("l"))
    both = inner.unionByName(twice).join(at, (F.col("key") == F.col("k")) & (F.col("doc_id") == F.col("d")) & (F.col("lo") == F.col("l"))).select("group_id", "length", "k", "content", "offset")
    spread = both.join(places.select("key", F.col("content").alias("c"), "doc_id", "lo"), (F.col("k") == F.col("key")) & (F.col("content") == F.col("c")))
    out = spread.select("group_id", "length", F.col("doc_id").alias("number"), (F.col("lo") + F.col("offset")).alias("lo")).distinct()
    return out.join(every.select("id", "number").distinct(), "number").select("group_id", "length", F.col("id").alias("doc_id"), "lo")


def _numbered(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id, number (a long in the order of the ids) and text (empty for null) of each row."""
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if isinstance(docs.schema[doc_id].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return rows.select("id", F.col("id").cast("long").alias("number"), "text")
    ids = rows.select("id").where(F.col("id").isNotNull()).distinct().sort("id")
    numbers = materialise(ids.select("id", F.monotonically_increasing_id().alias("number")), "numbers")
    return materialise(rows.join(numbers, "id", "left").select("id", "number", "text"), "numbered")


def remove_repeats(docs: DataFrame, *, least: int = 100, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """For each row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (its spans) and, on demand, what is left as `kept` (binary)."""
    if least < 2 * ANCHOR:
        raise ValueError(f"least must be {2 * ANCHOR} or more")
    rows = _numbered(docs, doc_id, text)
    named = rows.where(F.col("number").isNotNull())
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = named.select(F.col("number").alias("doc_id"), "id", "text").repartition(width, "doc_id")  # used twice, shuffled once
    spans = repeated_spans(named.select(F.col("number").alias("doc_id"), "text"), dealt, least)
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "n")).alias("spans"))
    joined = dealt.join(spans.hint("shuffle_hash"), "doc_id", "left").select("id", "text", "spans")
    joined = joined.unionByName(rows.where(F.col("number").isNull()).select("id", "text", F.lit(None).cast("array<struct<lo:bigint,n:bigint>>").alias("spans")))
    span = T.StructType([T.StructField("lo", T.LongType()), T.StructField("n", T.LongType())])
    kinds = {"doc_id": docs.schema[doc_id].dataType, "n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(), "kept_sha256": T.StringType(), "removed": T.ArrayType(span)}
    schema = T.StructType([T.StructField(k, v) for k, v in (kinds | ({"kept": T.BinaryType()} if keep_text else {})).items()])

    def run(batches):
        for batch in text_batches(batches, "text", limit=_TEXT_BYTES):
            out = []
            for t, found in zip(column_bytes(batch, "text"), batch.column(2).to_pylist(), strict=True):
                runs: list[list[int]] = []
                for lo, n in sorted((x["lo"], x["n"]) for x in found or ()):
                    if runs and lo <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], lo + n)
                    else:
                        runs.append([lo, lo + n])
                left = b"".join(t[a:b] for a, b in zip([0, *(b for _, b in runs)], [*(a for a, _ in runs), len(t)], strict=True))
                out.append((len(t), len(t) - len(left), len(runs), hashlib.sha256(left).hexdigest(), [{"lo": a, "n": b - a} for a, b in runs], *([left] if keep_text else ())))
            columns = list(zip(*out, strict=True))
            arrow = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("lo", pa.int64()), ("n", pa.int64())])), pa.binary()]
            arrays = [pa.array(c, type=k) for c, k in zip(columns, arrow, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=schema.names)

    return joined.mapInArrow(run, schema)


def op2_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, least=100, keep_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
