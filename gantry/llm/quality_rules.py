"""Host-level quality rules: rule failures by host, rates shrunk with an empirical beta prior, verdicts joined back.

Each document is measured and held against the rules. For each rule the hosts' failure rates give a beta prior by
moments; a host's rate is then (failures + a) / (documents + a + b), so that a host with few documents leans on the
others. A host fails a rule when that rate is over `max_rate`; its documents go.

Cases: a null or empty text has no words and fails the base rules; null hosts form one host; ties and repeated rows
count as often as they stand; an empty table gives an empty result. Columns of the input with the names of the
measures are replaced.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gantry.llm.common import add_columns, column_bytes, materialise, packed, unpacked

#: White space between words, and the symbols that are counted: fixed values.
WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def measure(text: bytes) -> tuple[int, int, int, int, int, int]:
    """The measures of one text, in the order of MEASURES."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars = len(text.translate(None, WHITE + CONTINUATION))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of three words that stand twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    at = np.flatnonzero(np.fromiter((times[x] > 1 for x in windows), dtype=bool, count=len(windows)))
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[at + k] = True
    return int(covered.sum())


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    def make():
        def run(batch: pa.RecordBatch) -> list:
            rows = [measure(t) for t in column_bytes(batch, text)]
            return [list(x) for x in zip(*rows, strict=True)]

        return run

    return add_columns(docs, [T.StructField(x, T.LongType()) for x in MEASURES], make, text)


def base_failed() -> Column:
    """Too short, or mostly repeated words."""
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def default_rules() -> dict[str, Column]:
    """Rule: when a document fails it."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "short": F.col("n_words") < 50,
        "repeats": F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"),
        "symbols": F.lit(10) * F.col("n_symbols") > F.col("n_words"),
        "lines": F.lit(10) * F.col("n_dup_lines") > F.lit(3) * F.col("n_lines"),
        "lengths": (F.col("word_chars") < 3 * words) | (F.col("word_chars") > 12 * words),
    }


def host_verdicts(measured: DataFrame, host: str, rules: dict[str, Column], max_rate: float = 0.5) -> DataFrame:
    """A row for each host: its documents, a shrunk failure rate for each rule and `host_ok`."""
    counts = materialise(
        measured.groupBy(F.col(host).alias("host")).agg(
            F.count("*").alias("n"), *(F.sum(F.when(rule, 1).otherwise(0)).alias(f"k_{name}") for name, rule in rules.items())
        ),
        "hosts",
    )
    rate = {x: F.col(f"k_{x}") / F.col("n") for x in rules}
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("hosts"), *(F.sum(f"k_{x}").alias(x) for x in rules)).first()
    mean = {x: (total[x] or 0) / max(total["n"] or 0, 1) for x in rules}
    spread = counts.agg(*(F.sum(F.col("n") * F.pow(rate[x] - F.lit(mean[x]), 2)).alias(x) for x in rules)).first()
    shrunk = {}
    for x in rules:
        m, n = mean[x], max(total["n"] or 0, 1)
        between = (spread[x] or 0.0) / n - m * (1 - m) * total["hosts"] / n  # without what sampling alone gives
        strength = min(1e6, max(1.0, m * (1 - m) / between - 1)) if between > 0 else 1e6
        shrunk[x] = (F.col(f"k_{x}") + F.lit(m * strength)) / (F.col("n") + F.lit(strength))
    out = counts.select("host", "n", *(c.alias(f"rate_{x}") for x, c in shrunk.items()))
    ok = F.lit(True)
    for x in rules:
        ok = ok & (F.col(f"rate_{x}") <= F.lit(max_rate))
    return out.withColumn("host_ok", ok)


def judge(docs: DataFrame, *, text: str = "text", host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """`docs` without its text, with the measures, `base_failed`, `host_ok` and `kept`."""
    measured = materialise(with_measures(docs, text).drop(text), "measures")
    # both sides are tables, so that a hot host's join can be split
    verdicts = materialise(host_verdicts(measured, host, default_rules(), max_rate).select(F.col("host").alias("of"), F.col("host_ok").alias("ok")), "verdicts")
    joined = packed(measured, host=host, failed=base_failed()).join(verdicts, F.col("host").eqNullSafe(F.col("of")), "left")
    return unpacked(joined, measured.columns, base_failed=F.col("failed"), host_ok=F.col("ok"), kept=~F.col("failed") & F.coalesce("ok", F.lit(True)))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, source, t, regexp_extract_all(t, '[^ \t-\r]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls
  FROM d
), g AS (
  SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
  FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r
), m AS (
  SELECT w.r, doc_id, source, len(ws) AS n_words,
         length(regexp_replace(t, '[ \t-\r]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(ls) AS n_lines
  FROM w LEFT JOIN covered ON w.r = covered.r
), f AS (
  SELECT source, rule, bad FROM (
    SELECT source, unnest(['short', 'repeats', 'symbols', 'lines', 'lengths']) AS rule,
           unnest([n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > n_words,
                   10 * n_dup_lines > 3 * n_lines,
                   word_chars < 3 * greatest(n_words, 1) OR word_chars > 12 * greatest(n_words, 1)]) AS bad
    FROM m)
), h AS (
  SELECT source, rule, count(*) AS n, sum(CASE WHEN bad THEN 1 ELSE 0 END) AS k FROM f GROUP BY source, rule
), total AS (
  SELECT rule, sum(n) AS n, sum(k) / sum(n) AS m, count(*) AS hosts FROM h GROUP BY rule
), spread AS (
  SELECT h.rule, any_value(m) AS m, sum(h.n * pow(k / h.n - m, 2)) / any_value(total.n)
         - any_value(m) * (1 - any_value(m)) * any_value(hosts) / any_value(total.n) AS v
  FROM h JOIN total ON h.rule = total.rule GROUP BY h.rule
), prior AS (
  SELECT rule, m, CASE WHEN v > 0 THEN least(1e6, greatest(1.0, m * (1 - m) / v - 1)) ELSE 1e6 END AS s FROM spread
), verdict AS (
  SELECT source, bool_and((k + m * s) / (n + s) <= 0.5) AS ok FROM h JOIN prior ON h.rule = prior.rule GROUP BY source
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND ok AS kept
FROM m LEFT JOIN verdict ON m.source IS NOT DISTINCT FROM verdict.source
"""
