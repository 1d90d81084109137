"""Names behind several titles and in other scripts, and secrets of further forms."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from gantry.llm import pii

#: text: the words of it that must be gone, and a pattern that the new text has to fit.
CASES = {
    "Herr Dr. Müller kam": (["Müller"], r"Herr Dr\. \p{Lu}\p{Ll}+ kam"),
    "Prof. Dr. Ann Lee too": (["Ann", "Lee"], r"Prof\. Dr\. \p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+ too"),
    "Dr John Smith said": (["John", "Smith"], r"Dr \p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+ said"),
    "Mr 李 Wei said": (["李", "Wei"], r"Mr \p{Han}+ \p{Lu}\p{Ll}+ said"),
    "Mr Ali حسن said": (["Ali", "حسن"], r"Mr \p{Lu}\p{Ll}+ \p{Arabic}+ said"),
    "Госпожа Анна Иванова тут": (["Анна", "Иванова"], r"Госпожа \p{Lu}[\p{Cyrillic}]+(?:на|ра|лия|ина|ся) \p{Lu}\p{Cyrillic}+(?:ова|ина|ева|ская) тут"),
    "Господин Иван Петров тут": (["Иван", "Петров"], r"Господин \p{Lu}\p{Cyrillic}+(?:слав|мир|ор|ан|ей) \p{Lu}\p{Cyrillic}+(?:ов|ин|ев|ский|ук) тут"),
    "Frau Ελένη Παπαδοπούλου x": (["Ελένη", "Παπαδοπούλου"], r"Frau \p{Lu}\p{Greek}+ \p{Lu}\p{Greek}+(?:δου|λου|κη) x"),
    "Mr 김 민수 x": (["김 민수"], r"Mr \p{Hangul}+ \p{Hangul}+ x"),
    "Mrs कमला देवी x": (["कमला", "देवी"], r"Mrs [\p{Devanagari}\p{M}]+ [\p{Devanagari}\p{M}]+ x"),
    "host fe80::1ff:fe23:4567:890a end": (["fe80", "890a"], r"host [0-9a-f]{4}::[0-9a-f]{3}:[0-9a-f]{4}:[0-9a-f]{4}:[0-9a-f]{4} end"),
    "2001:0db8:85a3:0000:0000:8a2e:0370:7334": (["0db8", "7334"], r"(?:[0-9a-f]{4}:){7}[0-9a-f]{4}"),
    "Authorization: Bearer abcdefghijklmnop1234567890XYZ== end": (["ghijkl", "4567890"], r"Authorization: Bearer [A-Za-z0-9]{29}== end"),
    "x eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.SflKxwRJSMeKKF2QT4 y": (["hbGciOi", "SflKxw"], r"x eyJ[A-Za-z0-9]{17}\.[A-Za-z0-9]{19}\.[A-Za-z0-9]{18} y"),
    "-----BEGIN RSA PRIVATE KEY-----\nMIIEowIBAAKCAQEA\nEFGH5678\n-----END RSA PRIVATE KEY----- end": (["MIIEow", "5678"], r"-----BEGIN RSA PRIVATE KEY-----\n[A-Za-z]{16}\n[A-Z]{4}\d{4}\n-----END RSA PRIVATE KEY----- end"),
}
#: Texts without entities.
CLEAN = ["std::vector<int> a::b; x ? y :: z", "the bearer of bad news", "Dry profane Drs", "at 10:30:15 and 1:2:3", "мир и господин", "-----BEGIN CERTIFICATE-----\nMIIEowIBAAKCAQEA\n-----END CERTIFICATE-----"]


@pytest.fixture(scope="module")
def replaced(spark):
    rows = list(enumerate([*CASES, *CLEAN]))
    return {r["doc_id"]: r for r in pii.replace(spark.createDataFrame(rows, "doc_id int, text string"), key="k").collect()}


def test_further_entities_are_found_and_fit(replaced):
    import regex

    for i, (text, (gone, shape)) in enumerate(CASES.items()):
        new = replaced[i]["text"]
        assert replaced[i]["n_replaced"] == 1 and not any(w in new for w in gone), (text, new)
        assert regex.fullmatch(shape, new), (text, new)


def test_clean_texts_stay(replaced):
    for i, text in enumerate(CLEAN, len(CASES)):
        assert replaced[i]["text"] == text and replaced[i]["n_replaced"] == 0


def test_names_of_other_scripts_stay_apart(spark):
    signs = "абвгдежзик"
    rows = [(i, f"Госпожа {a.upper()}{b} {c.upper()}{a}а тут") for i, (a, b, c) in enumerate((a, b, c) for a in signs for b in signs for c in signs[:3])]
    got = [r["text"] for r in pii.replace(spark.createDataFrame(rows, "doc_id int, text string"), key="k").collect()]
    assert len({t for _, t in rows}) == len(set(got)) and all(re.fullmatch(r"Госпожа [А-Яа-я]+ [А-Яа-я]+ тут", t) for t in got)


def test_plans_stay_small(spark):
    """What several places use is planned once: the driver holds plans of a few ten thousand signs, not of a million."""
    rows = spark.createDataFrame([("name", "Mr Ada")], "kind string, value string")
    kind, value = F.col("kind"), F.col("value")
    for column in (pii.surrogate(kind, value, "k", 0), pii.terms(pii.parts(value)), pii._replacement(value, F.create_map(kind, value), "k")):
        assert len(rows.select(column)._jdf.queryExecution().optimizedPlan().expressions().apply(0).toString()) < 100_000
