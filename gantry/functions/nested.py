"""Arrays, maps and conversations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts_by(rows: DataFrame, keys: Sequence[str], kind: str) -> DataFrame:
    """A map of counts in order of its keys, one for each group."""
    per = rows.groupBy(*keys, kind).agg(F.count("*").alias("n"))
    return per.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n")))).alias("counts"))


def distinct_sorted(x: Column | str) -> Column:
    return F.sort_array(F.collect_set(x))


def first_present(*columns: Column) -> Column:
    return F.coalesce(*columns)


def conversations(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """One row for each conversation: `messages` in turn order. A conversation is bounded by its own turns."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content"))))
    return rows.groupBy(conv).agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def without_system(messages: Column) -> Column:
    lead = F.when(F.element_at(messages, 1)["role"] == "system", 2).otherwise(1)
    return F.when(F.size(messages) > 0, F.slice(messages, lead, F.size(messages))).otherwise(messages)


def valid_conversation(messages: Column) -> Column:
    """An optional leading system message, then user and assistant in turns, in pairs, none of them blank."""
    rest = without_system(messages)
    want = lambda m, i: (m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")) & (F.length(F.trim(m["content"])) > 0)
    good = F.forall(F.transform(rest, lambda m, i: F.coalesce(want(m, i), F.lit(False))), lambda x: x)
    return (F.size(rest) > 0) & (F.size(rest) % 2 == 0) & good


def pieces(text: Column) -> Column:
    """Number of a text's pieces as tokenizers cut it first: letter runs, single digits, sign runs. The default measure of tokens."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"), F.lit(0))), F.lit(0))


def turn_profile(messages: Column, tokens: Callable[[Column], Column] = pieces) -> dict[str, Column]:
    """Turns and tokens of a conversation, and those of the assistant, which are the labels; `tokens` measures a text."""
    mine = F.filter(messages, lambda m: m["role"] == "assistant")
    total = lambda ms: F.aggregate(F.transform(ms, lambda m: tokens(F.coalesce(m["content"], F.lit("")))), F.lit(0), lambda a, n: a + n)
    return {"turns": F.size(messages), "assistant_turns": F.size(mine), "tokens": total(messages), "label_tokens": total(mine)}


def capped(messages: Column, cap: int, least: int = 64) -> Column:
    """Messages cut to about `cap` tokens (pieces) in all: contents of more than `least` characters are cut to their beginnings, those of users and systems before answers, longer ones first; null if that can't be enough.

    Each message gives up what is still too much, down to `least` characters.
    """
    size = lambda m: pieces(F.coalesce(m["content"], F.lit("")))
    prefix = lambda m: pieces(F.substring(F.coalesce(m["content"], F.lit("")), 1, least))
    sized = F.transform(messages, lambda m, i: F.struct(i.alias("i"), m["role"].alias("role"), m["content"].alias("content"), size(m).alias("n"), F.when(F.length(m["content"]) > least, prefix(m)).otherwise(size(m)).alias("low")))
    place = lambda m: F.struct((~m["role"].isin("user", "system")).alias("a"), (-F.length(F.coalesce(m["content"], F.lit("")))).alias("b"), m["i"].alias("i"), m["n"].alias("n"), m["low"].alias("low"))
    order = F.array_sort(F.transform(sized, place))
    total = F.aggregate(F.transform(sized, lambda m: m["n"]), F.lit(0), lambda a, n: a + n)
    start = F.struct((total - cap).alias("over"), F.array().cast("array<struct<i:int,n:int>>").alias("keep"))

    def give(acc: Column, m: Column) -> Column:
        cut = F.greatest(F.lit(0), F.least(acc["over"], m["n"] - m["low"]))
        return F.struct((acc["over"] - cut).alias("over"), F.concat(acc["keep"], F.array(F.struct(m["i"].alias("i"), (m["n"] - cut).alias("n")))).alias("keep"))

    cuts = F.aggregate(order, start, give)
    by = F.map_from_entries(cuts["keep"])

    def shortened(m: Column) -> Column:
        n = F.element_at(by, m["i"])
        found = F.regexp_extract_all(m["content"], F.lit(r"\s*(?:\p{L}+|\p{N}|[^\s\p{L}\p{N}]+)"), F.lit(0))
        return F.struct(m["role"].alias("role"), F.when(n >= m["n"], m["content"]).otherwise(F.array_join(F.slice(found, 1, n), "")).alias("content"))

    return F.when(cuts["over"] <= 0, F.transform(sized, shortened))


def media_profile(rows: DataFrame, keys: Sequence[str], images: str) -> DataFrame:
    """Images by record, flattened: count and token distribution."""
    flat = rows.select(*keys, F.explode(images).alias("i"))
    return flat.groupBy(*keys).agg(F.count("*").alias("images"), F.sum("i.tokens").alias("tokens"), F.percentile("i.tokens", 0.5).alias("p50"), F.max("i.tokens").alias("most"))
