"""Exact token counts of conversations with a tokenizer's file, and cuts to a cap by these counts.

A message is rendered by its role (what stands before and behind its content) and encoded by itself; the assistant's
messages are the labels. Rows are handled in Arrow batches, and a cut encodes only the message that it shortens.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: How a role's content is rendered: text before and text behind.
PLAIN: Mapping[str, tuple[str, str]] = {}
CHAT = {r: (f"<|im_start|>{r}\n", "<|im_end|>\n") for r in ("system", "user", "assistant")}
#: Roles whose contents are cut first.
CONTEXT = ("user", "system")
MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))

_loaded: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _loaded[path] = tok
    return _loaded[path]


class Counter:
    """Tokens of messages by a tokenizer's file."""

    def __init__(self, path: str, template: Mapping[str, tuple[str, str]]):
        self.tok, self.template = _tokenizer(path), template

    def of(self, role: str | None, content: str) -> int:
        before, behind = self.template.get(role, ("", ""))
        return len(self.tok.encode(before + content + behind, add_special_tokens=False).ids)


def cut(messages: Sequence[tuple[str | None, str]], counter: Counter, cap: int, least: int = 64) -> tuple[list[tuple[str | None, str]] | None, int, int]:
    """Messages within `cap` tokens, their tokens before and after; none if that can't be.

    While there are too many, the longest content of the context, else of the others, is cut to the longest beginning
    that fits by bisection, or to `least` characters if none does; contents of that length or less stay.
    """
    out, sizes = list(messages), [counter.of(r, c) for r, c in messages]
    before = sum(sizes)
    while sum(sizes) > cap:
        long = [i for i, (_, c) in enumerate(out) if len(c) > least]
        if not long:
            return None, before, sum(sizes)
        i = max(long, key=lambda k: (out[k][0] in CONTEXT, len(out[k][1]), -k))
        role, content = out[i]
        room, best, low, high = cap - (sum(sizes) - sizes[i]), least, least, len(content)
        if counter.of(role, content[:least]) <= room:
            while low <= high:
                mid = (low + high) // 2
                if counter.of(role, content[:mid]) <= room:
                    best, low = mid, mid + 1
                else:
                    high = mid - 1
        out[i] = role, content[:best]
        sizes[i] = counter.of(*out[i])
    return out, before, sum(sizes)


def _messages(batch: pa.RecordBatch, name: str) -> list[list[tuple[str | None, str]]]:
    rows = batch.column(batch.schema.get_field_index(name)).to_pylist()
    return [[(m["role"], m["content"] or "") for m in row or () if m is not None] for row in rows]


def _with(rows: DataFrame, fields: list[T.StructField], messages: str, make) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    stay = [c for c in rows.columns if c not in {f.name for f in fields}]
    used = [*stay, *([messages] if messages not in stay else [])]
    schema = T.StructType([*(rows.schema[c] for c in stay), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            new = list(zip(*map(f, _messages(batch, messages)), strict=True)) or [[] for _ in fields]
            arrays = [pa.array(list(x), type=to_arrow_type(k.dataType)) for x, k in zip(new, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in stay), *arrays], names=schema.names)

    return rows.select(*used).mapInArrow(run, schema)


def token_profile(rows: DataFrame, path: str, *, messages: str = "messages", template: Mapping[str, tuple[str, str]] = PLAIN) -> DataFrame:
    """`rows` with total_tokens, label_tokens, turns and assistant_turns; a null conversation has none of each."""

    def make():
        counter = Counter(path, template)

        def one(ms):
            sizes = [counter.of(r, c) for r, c in ms]
            mine = [n for (r, _), n in zip(ms, sizes, strict=True) if r == "assistant"]
            return sum(sizes), sum(mine), len(ms), len(mine)

        return one

    return _with(rows, [T.StructField(c, T.LongType()) for c in ("total_tokens", "label_tokens", "turns", "assistant_turns")], messages, make)


def capped_to_tokens(rows: DataFrame, cap: int, path: str, *, messages: str = "messages", template: Mapping[str, tuple[str, str]] = PLAIN, least: int = 64) -> DataFrame:
    """`rows` with messages of at most `cap` tokens, transformation (`identity`, `content_prefix_crop` or `impossible`), original_tokens and reference_tokens_after_crop.

    Where no cut can be enough, messages are null.
    """

    def make():
        counter = Counter(path, template)

        def one(ms):
            out, before, after = cut(ms, counter, cap, least)
            made = None if out is None else [{"role": r, "content": c} for r, c in out]
            return made, "impossible" if out is None else "identity" if before <= cap else "content_prefix_crop", before, after

        return one

    longs = [T.StructField(c, T.LongType()) for c in ("original_tokens", "reference_tokens_after_crop")]
    return _with(rows, [T.StructField(messages, MESSAGES), T.StructField("transformation", T.StringType()), *longs], messages, make)
