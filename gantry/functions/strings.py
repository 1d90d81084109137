"""Text, time and JSON expressions."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of a missing value, of flags and of units, fixed values.
MISSING = ("", "n/a", "[n/a]", "[not supported]", "not supported")
ACTIVE, INACTIVE = ("active", "true", "yes", "1"), ("not active", "false", "no", "0")
UNITS = {"kib": 1024, "mib": 1024**2, "gib": 1024**3}
_NUMBER = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity|nan)$"


def memory_amount(message: Column, prefix: str) -> Column:
    """Bytes of `<prefix> <number> (KiB|MiB|GiB)` in a message; halves round to even; null if absent."""
    pattern = rf"(?i){prefix}\s+([0-9]+(?:\.[0-9]+)?)\s*(KiB|MiB|GiB)"
    number, unit = F.regexp_extract(message, pattern, 1), F.lower(F.regexp_extract(message, pattern, 2))
    scale = F.element_at(F.create_map(*(F.lit(x) for u in UNITS.items() for x in u)), F.when(unit != "", unit))
    return F.when(number != "", F.bround(number.try_cast("double") * scale).cast("long"))


def first_rule(rules: Sequence[tuple[Column, str]], otherwise: str | Column) -> Column:
    """The name of the first rule that holds."""
    out = None
    for test, name in rules:
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(otherwise)


def telemetry_time(text: Column, fallback: Column) -> Column:
    """Two spellings of a time (with and without a fraction), else the fallback."""
    text = F.trim(text)
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy/MM/dd HH:mm:ss.SSS")), F.try_to_timestamp(text, F.lit("yyyy/MM/dd HH:mm:ss")), fallback)


def maybe_number(text: Column) -> Column:
    """A number that is the whole text, exponents included; null for any other text."""
    t = F.lower(F.trim(text))
    return F.when(~t.isin(*MISSING) & t.rlike(_NUMBER), t.try_cast("double"))


def maybe_flag(text: Column) -> Column:
    """1, 0 or unknown."""
    t = F.lower(F.trim(text))
    return F.when(t.isin(*ACTIVE), 1).when(t.isin(*INACTIVE), 0)


def canonical_json(**parts: Column) -> Column:
    """An object as JSON with its keys in order, without spaces, nulls kept; parts are text, whole numbers, flags, or structs of such."""
    return F.to_json(F.struct(*(parts[k].alias(k) for k in sorted(parts))), {"ignoreNullFields": "false"})


def stable_id(prefix: str, length: int = 16, **parts: Column) -> Column:
    """prefix- and the first hex digits of a hash of the parts as canonical JSON: the same whatever the order they are given in."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(canonical_json(**parts), 256), 1, length))


def job_phase(job_id: Column, kind: Column, given: Column | None = None, probes_boundary: Column | None = None, has_pair: Column | None = None) -> Column:
    """Phase of a job: the given one, that of what it carries, else the first rule of kind or of its id's beginning that fits."""
    job_id, kind = F.coalesce(job_id, F.lit("")), F.coalesce(kind, F.lit(""))
    begins = lambda *heads: functools.reduce(operator.or_, [job_id.startswith(h) for h in heads])
    no = F.lit(False)
    # fixed values: kinds and beginnings of ids
    rules = [
        (F.coalesce(probes_boundary, no) if probes_boundary is not None else no, "memory"),
        (F.coalesce(has_pair, no) if has_pair is not None else no, "packing"),
        (begins("preflight-"), "preflight"),
        ((kind == "thermal_validation") | begins("h800val-") | (kind == "smoke") | begins("smoke-"), "validation"),
        (kind.isin("memory_boundary", "memory_probe") | begins("mem-"), "memory"),
        ((kind == "packing_memory_probe") | begins("packmem-", "packon-", "packoff-"), "packing"),
        ((kind == "profiler") | begins("prof-"), "profiler"),
        (begins("scale-"), "scaling"),
        (begins("tput-", "tputscreen-", "tputd-") | kind.isin("throughput", "throughput_screen"), "throughput"),
    ]
    found = first_rule(rules, "other")
    return found if given is None else F.when(F.length(given) > 0, given).otherwise(found)


def index_list(text: Column) -> Column:
    """`0,2,4-7` as an array of integers."""

    def span(t: Column) -> Column:
        ends = F.split(F.trim(t), "-")
        return F.sequence(F.element_at(ends, 1).cast("int"), F.element_at(ends, -1).cast("int"))

    return F.flatten(F.transform(F.split(text, ","), span))


def percent(x: Column) -> Column:
    return F.when(x.isNotNull(), F.format_string("%.3f%%", x * 100))


def length_category(p50: Column, p90: Column, p99: Column) -> Column:
    """short up to 512 tokens at the 90th percentile, longtail from a 99th of 1.75 medians, longcontext from a median of 8192, else multiturn."""
    return F.when(p90 <= 512, "short").when(p99 / F.greatest(p50, F.lit(1.0)) >= 1.75, "longtail").when(p50 >= 8192, "longcontext").otherwise("multiturn")
