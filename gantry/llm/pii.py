"""Personal data and secrets replaced by keyed surrogates, with DataFrame functions only.

Entities are found by pattern. A surrogate depends on a key, the kind and the entity alone, so an entity has the same
one wherever it stands (coreference), and it fits its kind: e-mail addresses keep their shape and top-level domain,
card and account numbers their first digit or country and valid check digits, phone numbers their country code,
addresses stay valid, secrets keep their prefix. Names are replaced word by word, the last word as a family name and
the others as given names of the titles' gender, so that "Mr Smith" stays the father of "Mr John Smith"; script and
capitals stay, and initials are rotated. A name follows a title or several; without one a word is no name. E-mail addresses and names that differ only in case are one. All different
entities are then held against each other: where two would share a surrogate, or one would be another entity's
original, it is drawn again until all are distinct.

The key is a secret: without `spark.gantry.surrogateKey` in the session's settings a driver draws one of its own.

Cases: a null text stays null and an empty one empty; repeated rows get equal texts, ids play no part; an empty table
gives an empty result; columns named `n_replaced` are replaced.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gantry.llm.common import materialise, packed, unpacked

#: Fixed values.
_TITLES = "Mr|Mrs|Ms|Miss|Mister|Herr|Frau|Monsieur|Madame|Mademoiselle|Señor|Señora|Señorita|Signor|Signora|Господин|Госпожа|Dr|Prof"
#: A label of a host; labels that no top-level domain can begin; titles one after another; a capitalised word, or one of a script
#: without capitals, after initials if there are any.
_LABEL = "[A-Za-z0-9-]++"
_ODD = rf"(?:\.(?![A-Za-z]{{2}}){_LABEL})*+"
_CHAIN = rf"(?:(?:{_TITLES})\.? )++"
_WORD = r"(?:\p{Lu}\.?+ )*+(?:\p{Lu}[\p{L}\p{M}'-]++|\p{Lo}[\p{L}\p{M}'-]*+)"
#: Kind: pattern (Java), tried in this order. Runs have no upper bound and are possessive: no entity is cut, no text is tried twice.
PATTERNS = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@{_LABEL}(?:{_ODD}\.(?=[A-Za-z]{{2}}){_LABEL}(?={_ODD}\.[A-Za-z]{{2}}))*+{_ODD}\.[A-Za-z]{{2,}}+",
    "secret": r"(?i:(?<![A-Za-z0-9])(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)[ \t]*+\s{0,3}[=:][ \t]*+\s{0,3}[\"']?[A-Za-z0-9_/+.\-]{8,}+)",
    "bearer": r"(?i:(?<![A-Za-z0-9])bearer {1,3}[A-Za-z0-9_~+/.-]{16,}+={0,2})",
    "jwt": r"(?<![\w.-])eyJ[A-Za-z0-9_-]{6,}+\.[A-Za-z0-9_-]{6,}+\.[A-Za-z0-9_-]{6,}+",
    "pem": r"(?<=-----BEGIN PRIVATE KEY-----|-----BEGIN [A-Z]{2,9} PRIVATE KEY-----)[A-Za-z0-9+/=\s]{16,}+(?=-----END)",
    "apikey": r"\b(?:AKIA[A-Z0-9]{16}|gh[opsu]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}+)\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "ip6": r"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\w.-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-])",
    "phone": r"(?<![\w])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]?\d{3,4}(?![\w])",
    "name": rf"\b{_CHAIN}{_WORD}(?: {_WORD})*+",
}
#: A cheap test that most texts fail.
_MAYBE = rf"[0-9@]|(?i:password|token|secret|key|bearer)|\b(?:{_TITLES})\b"
_ALL = "|".join(f"(?:{p})" for p in PATTERNS.values())
_HEADS = {
    "secret": r"^(?i:(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)[ \t]*+\s{0,3}[=:][ \t]*+\s{0,3}[\"']?)",
    "bearer": r"^(?i:bearer) {1,3}",
    "jwt": r"^eyJ",
    "name": rf"^{_CHAIN}",
    "apikey": r"^(?:AKIA|gh[opsu]_|sk-)",
    "phone": r"^(?:\+\d{1,3})?",
}
#: Syllables that names are made of, fixed values; the ends go by gender, and those of family names by none.
ONSETS = "B Br C D Dr F G Gr H J K Kr L M N P R S St T Tr V W Z".split()
VOWELS = "a e i o u ai au ei".split()
MIDDLES = "b d g k l ll m n nd r rk s st t v".split()
ENDS = {"family": "er man son sen ing berg feld ton ley ard".split(), "given:m": "on an ik us or o en ar".split(), "given:f": "a ia ina elle is ara essa ette".split(), "given:n": "y ie ey il ane".split()}
_MALE, _FEMALE = ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Signor", "Господин"], ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita", "Signora", "Госпожа"]
#: Name syllables of other scripts, fixed values: pattern, first ones, further ones, ends of given names (male, female, either) and of family names (female ones in -а, -я, -η, -ου apart).
SCRIPTS = {
    "Cyrillic": (r"\p{IsCyrillic}", "Ба Ва Га Да За Ка Ла Ма Ни По Ро Са Та Фе".split(), "ба ви го ди ко ле ми ни ро са ти".split(), ("слав мир ор ан ей".split(), "на ра лия ина ся".split(), "ни ко ли".split()), ("ов ин ев ский ук".split(), "ова ина ева ская".split())),
    "Greek": (r"\p{IsGreek}", "Βα Γα Δη Θε Κα Λα Μα Νι Πα Ρο Στα Τι Φι".split(), "βα γο δη θε κι λα με νι πο ρα".split(), ("νος λος ρης".split(), "να λα ρία".split(), "νι λι".split()), ("δης πουλος κης".split(), "δου λου κη".split())),
    "Arabic": (r"\p{IsArabic}", "با تا جا حا دا را سا شا فا كا ما نا".split(), "بي تو جم حي دو ري سم شي فر كم".split(), ("ل د ر ن".split(), "ة اء ى".split(), "م ي".split()), ("ني وي ري".split(), "ني وي ري".split())),
    "Hebrew": (r"\p{IsHebrew}", "בא גא דא הא זא טא יא לא מא נא".split(), "בי גו די לו מי נו רי שי".split(), ("ל ן ר".split(), "ה ית".split(), "י".split()), ("מן ני רי".split(), "מן ני רי".split())),
    "Devanagari": (r"\p{IsDevanagari}", "अ का गा जा दा ना पा मा रा सा".split(), "नि मि रि वि ति लि".split(), ("श न व".split(), "ता ना या".split(), "ल".split()), ("कर वाल राव".split(), "कर वाल राव".split())),
    "Han": (r"\p{IsHan}", "李王张刘陈杨赵黄周吴徐孙".strip(), "文明华建国平志海东晓", ("强军刚", "丽芳娟", "宁安林"), ("李王张刘陈杨赵黄周吴", "李王张刘陈杨赵黄周吴")),
    "Hangul": (r"\p{IsHangul}", "김이박최정강조윤장임", "민서지현도수영하", ("준호석", "희경미", "진우"), ("김이박최정강조윤", "김이박최정강조윤")),
    "Kana": (r"[\p{IsHiragana}\p{IsKatakana}]", "あかさたなはまやわ", "いきしちにみりうく", ("おろと", "こみえ", "きり"), ("たまし", "たまし")),
}
#: Alphabets of initials.
ALPHABETS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")
#: Letters that stand in for letters of the same class; other signs stay.
CLASSES = ("aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "0123456789", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ", "αεηιουω", "βγδζθκλμνξπρστφχψ")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once: an expression used by name in several places stands, and is planned, as often."""
    return F.element_at(F.transform(F.array(value), use), 1)


def entities(text: Column) -> Column:
    """All entities of a text, in order, as they stand."""
    return F.when(text.rlike(_MAYBE), F.regexp_extract_all(text, F.lit(_ALL), F.lit(0))).otherwise(F.array().cast("array<string>"))


def kind_of(entity: Column) -> Column:
    out = None
    for kind, pattern in PATTERNS.items():
        hit = entity.rlike(f"^(?:{pattern})$")
        out = F.when(hit, F.lit(kind)) if out is None else out.when(hit, F.lit(kind))
    return out.otherwise(F.lit("pem"))  # the one kind that is told by what stands before it


def head_of(kind: Column, entity: Column) -> Column:
    """The part of an entity that stays: a title, a key word, a prefix, a country code."""
    out = None
    for k, pattern in _HEADS.items():
        value = F.regexp_extract(entity, pattern, 0)
        out = F.when(kind == k, value) if out is None else out.when(kind == k, value)
    return out.otherwise(F.lit(""))


def parts(entity: Column) -> Column:
    """struct(kind, head, value, given) of an entity; `given` is the kind of a name's given names."""

    def told(kind: Column, head: Column) -> Column:
        titled = lambda titles: head.rlike(rf"\b(?:{'|'.join(titles)})\b")
        gender = F.when(kind != "name", F.lit("given:n")).when(titled(_FEMALE), F.lit("given:f")).when(titled(_MALE), F.lit("given:m")).otherwise(F.lit("given:n"))
        return F.struct(kind.alias("kind"), head.alias("head"), F.substring(entity, F.length(head) + 1, F.length(entity)).alias("value"), gender.alias("given"))

    return _let(kind_of(entity), lambda kind: _let(head_of(kind, entity), lambda head: told(kind, head)))


def _words(value: Column) -> Column:
    return F.split(value, " ")


def _initial(word: Column) -> Column:
    return word.rlike(r"^\p{Lu}\.?$")


def terms(part: Column) -> Column:
    """What of an entity needs a surrogate of its own: array of struct(kind, value); a name's words each for itself."""
    term = lambda kind, value: F.struct(kind.alias("kind"), value.alias("value"))
    words = _words(part["value"])
    by_word = F.transform(words, lambda w, i: F.when((i < F.size(words) - 1) & _initial(w), term(F.lit("initial"), F.lit(""))).otherwise(term(F.when(i == F.size(words) - 1, F.lit("family")).otherwise(part["given"]), F.lower(w))))
    whole = F.array(term(part["kind"], F.when(part["kind"] == "email", F.lower(part["value"])).otherwise(part["value"])))
    return F.when(part["kind"] == "name", F.filter(by_word, lambda t: t["kind"] != "initial")).otherwise(whole)


def _noise(seed: Column) -> Column:
    """128 keyed bytes in hex."""
    return F.concat(*(F.sha2(F.concat(seed, F.lit(f"/{k}")), 256) for k in range(4)))


def _byte(noise: Column, i: Column) -> Column:
    return F.conv(F.substring(noise, F.pmod(i, F.lit(127)).cast("int") * 2 + 1, F.lit(4)), 16, 10).cast("int")


def _same_class(value: Column, noise: Column) -> Column:
    """Each letter or digit becomes another of its class."""

    def swap(c: Column, i: Column) -> Column:
        out = None
        for members in CLASSES:
            new = F.substring(F.lit(members), F.pmod(_byte(noise, i), F.lit(len(members))).cast("int") + 1, F.lit(1))
            hit = F.instr(F.lit(members), c) > 0
            out = F.when(hit, new) if out is None else out.when(hit, new)
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), swap), "")


def _luhn_sum(digits: Column) -> Column:
    """Sum for the check digit rule, over digits read from the right, the last of them undoubled."""
    weighed = F.transform(
        F.reverse(F.split(digits, "")),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)),
    )
    return F.aggregate(weighed, F.lit(0), lambda a, x: a + x)


def _card(value: Column, noise: Column) -> Column:
    """First digit and grouping stay; the check digit fits where the original's does."""
    valid = F.pmod(_luhn_sum(F.regexp_replace(value, r"\D", "")), F.lit(10)) == 0

    def checked(drawn: Column) -> Column:
        body = F.substring(drawn, F.lit(1), F.length(drawn) - 1)
        digits = F.regexp_replace(body, r"\D", "")
        check = F.pmod(F.lit(10) - F.pmod(_luhn_sum(F.concat(digits, F.lit("0"))), F.lit(10)), F.lit(10))
        return F.when(valid, F.concat(body, check.cast("string"))).otherwise(drawn)

    return _let(F.concat(F.substring(value, 1, 1), F.substring(_same_class(value, noise), F.lit(2), F.length(value))), checked)


_ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _mod97(text: Column) -> Column:
    """The number that digits and letters (A is 10) spell, modulo 97."""

    def add(acc: Column, c: Column) -> Column:
        v = F.instr(F.lit(_ALNUM), c) - 1
        return F.when(v < 0, acc).when(v < 10, (acc * 10 + v) % 97).otherwise((acc * 100 + v) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _iban(value: Column, plain: Column) -> Column:
    """The country stays; the check digits fit where the original's do."""
    country = F.substring(value, 1, 2)
    turned = lambda x, check: F.concat(F.substring(x, F.lit(3), F.length(x)), country, check)
    original = F.substring(value, F.lit(3), F.length(value))
    valid = _mod97(turned(F.concat(F.lit("  "), F.substring(original, F.lit(3), F.length(original))), F.substring(original, F.lit(1), F.lit(2)))) == 1

    def checked(drawn: Column) -> Column:
        rest = F.substring(drawn, F.lit(3), F.length(drawn))
        check = F.lpad((F.lit(98) - _mod97(F.concat(rest, country, F.lit("00")))).cast("string"), 2, "0")
        return F.concat(country, F.when(valid, F.concat(check, rest)).otherwise(drawn))

    return _let(plain, lambda whole: _let(F.substring(whole, F.lit(3), F.length(whole)), checked))


def _syllables(kind: Column, noise: Column, attempt: int) -> Column:
    """A name in lower case, longer with every attempt."""
    pick = lambda words, at: F.element_at(F.array(*map(F.lit, words)), F.pmod(_byte(noise, F.lit(at)), F.lit(len(words))).cast("int") + 1)
    end = None
    for k, (of, ends) in enumerate(ENDS.items()):
        end = F.when(kind == of, pick(ends, 90 + k)) if end is None else end.when(kind == of, pick(ends, 90 + k))
    return F.lower(F.concat(pick(ONSETS, 0), pick(VOWELS, 5), *(x for k in range(attempt + 2) for x in (pick(MIDDLES, 9 + 6 * k), *((pick(VOWELS, 12 + 6 * k),) if k <= attempt else ()))), end))


def _of_script(script: str, kind: Column, value: Column, noise: Column, attempt: int) -> Column:
    """A name from a script's own syllables; it is longer with every attempt, and a family name in a female form stays in one."""
    _, onsets, middles, given, family = SCRIPTS[script]
    pick = lambda words, at: F.element_at(F.array(*map(F.lit, words)), F.pmod(_byte(noise, F.lit(at)), F.lit(len(words))).cast("int") + 1)
    female = value.rlike("(?:а|я|η|ου)$")
    end = F.when(kind == "given:m", pick(given[0], 90)).when(kind == "given:f", pick(given[1], 91)).when(kind == "given:n", pick(given[2], 92)).when(female, pick(family[1], 93)).otherwise(pick(family[0], 94))
    return F.lower(F.concat(pick(onsets, 0), *(pick(middles, 9 + 6 * k) for k in range(attempt + 1)), end))


def _name(kind: Column, value: Column, noise: Column, attempt: int) -> Column:
    """A word of a name, in lower case, of the script that its first letter has; of Latin letters where that script has no syllables here."""
    out = None
    for script, (pattern, *_) in SCRIPTS.items():
        hit, new = value.rlike(f"^{pattern}"), _of_script(script, kind, value, noise, attempt)
        out = F.when(hit, new) if out is None else out.when(hit, new)
    return out.otherwise(_syllables(kind, noise, attempt))


def _hex_digits(value: Column, noise: Column) -> Column:
    """Each hexadecimal digit becomes another; other signs stay."""
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike("[0-9a-f]"), F.substring(noise, F.pmod(i, F.lit(255)).cast("int") + 1, F.lit(1))).when(c.rlike("[A-F]"), F.upper(F.substring(noise, F.pmod(i, F.lit(255)).cast("int") + 1, F.lit(1)))).otherwise(c)), "")


def surrogate(kind: Column, value: Column, key: str, attempt: int) -> Column:
    return _let(_noise(F.concat_ws("|", F.lit(key), F.lit(str(attempt)), kind, value)), lambda noise: _drawn(kind, value, noise, attempt))


def _drawn(kind: Column, value: Column, noise: Column, attempt: int) -> Column:
    plain = _same_class(value, noise)
    octets = F.array_join(F.transform(F.array(*map(F.lit, (0, 3, 6, 9))), lambda i: (F.pmod(_byte(noise, i), F.lit(223)) + 1).cast("string")), ".")
    top = F.regexp_extract(value, r"\.[A-Za-z]+$", 0)
    email = F.concat(F.substring(plain, F.lit(1), F.length(value) - F.length(top)), top)
    if attempt > 3:  # short addresses have few others of their shape
        email = F.concat(F.substring(noise, F.lit(1), F.lit(attempt)), email)
    drawn = F.substring(F.repeat(noise, F.ceil(F.length(value) / 256).cast("int")), F.lit(1), F.length(value))
    hexadecimal = F.when(value.rlike("^[0-9a-f]+$"), drawn).when(value.rlike("^[0-9A-F]+$"), F.upper(drawn))
    return (
        F.when((kind == "secret") & hexadecimal.isNotNull(), hexadecimal).when(kind == "ip", octets).when(kind == "ip6", _hex_digits(value, noise)).when(kind == "email", email).when(kind == "card", _card(value, noise))
        .when(kind == "iban", _iban(value, plain)).when(kind.isin(list(ENDS)), _name(kind, value, noise, attempt)).otherwise(plain)
    )


def distinct_surrogates(found: DataFrame, key: str, most_rounds: int = 20) -> DataFrame:
    """kind, value and a surrogate of its own for each different row of `found`."""
    left = materialise(found.select("kind", "value").distinct(), "entities")
    originals = left.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("own"))
    done = None
    for attempt in range(most_rounds):
        drawn = left.withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), key, attempt))
        turn = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("value"))  # few share one of millions
        drawn = drawn.withColumn("turn", turn).join(originals, ["kind", "surrogate"], "left")
        if done is not None:
            drawn = drawn.join(done.select("kind", "surrogate", F.lit(True).alias("taken")), ["kind", "surrogate"], "left")
        else:
            drawn = drawn.withColumn("taken", F.lit(None).cast("boolean"))
        drawn = materialise(drawn.withColumn("fits", (F.col("turn") == 1) & F.col("own").isNull() & F.col("taken").isNull()), "surrogates")
        good = drawn.where("fits").select("kind", "value", "surrogate")
        done = good if done is None else done.unionByName(good)
        left = drawn.where(~F.col("fits")).select("kind", "value")
        if left.isEmpty():
            return done
    raise RuntimeError(f"{left.count()} entities still share surrogates after {most_rounds} draws")


def _label(kind: Column, value: Column) -> Column:
    return F.concat_ws("|", kind, value)


def _rotated(word: Column, key: str) -> Column:
    """Initials moved on in their alphabet by a keyed number of places: no two become one."""
    shift = int.from_bytes(hashlib.sha256(f"{key}/initials".encode()).digest()[:4], "big")
    turned = [a[n:] + a[:n] for a in ALPHABETS for n in [1 + shift % (len(a) - 1)]]
    return F.translate(word, "".join(ALPHABETS), "".join(turned))


def _replacement(entity: Column, known: Column, key: str) -> Column:
    """The new text of an entity; `known` maps labels to surrogates."""
    return _let(parts(entity), lambda p: _let(_words(p["value"]), lambda words: _replaced(p, words, known, key)))


def _replaced(p: Column, words: Column, known: Column, key: str) -> Column:
    def word(w: Column, i: Column) -> Column:
        last = i == F.size(words) - 1
        new = F.element_at(known, _label(F.when(last, F.lit("family")).otherwise(p["given"]), F.lower(w)))
        cased = F.when((w == F.upper(w)) & (F.length(w) > 1), F.upper(new)).otherwise(F.initcap(new))
        return F.when(~last & _initial(w), _rotated(w, key)).otherwise(cased)

    email = F.element_at(known, _label(p["kind"], F.lower(p["value"])))
    whole = F.when(p["kind"] == "email", F.when(p["value"] == F.upper(p["value"]), F.upper(email)).otherwise(email)).otherwise(F.element_at(known, _label(p["kind"], p["value"])))
    return F.concat(p["head"], F.when(p["kind"] == "name", F.array_join(F.transform(words, word), " ")).otherwise(whole))


_own_keys: dict[str, str] = {}


def session_key(spark: SparkSession) -> str:
    """The secret in `spark.gantry.surrogateKey`, else one that this driver has drawn: surrogates then differ from driver to driver."""
    return spark.conf.get("spark.gantry.surrogateKey", None) or _own_keys.setdefault(spark.sparkContext.applicationId, secrets.token_hex(16))


def replace(docs: DataFrame, *, key: str, text: str = "text") -> DataFrame:
    """`docs` with every entity in `text` replaced, and `n_replaced`."""
    columns = [c for c in docs.columns if c != "n_replaced"]
    rows = packed(docs.select(*(F.col(f"`{c}`") for c in columns)), found=F.coalesce(entities(F.col(f"`{text}`")), F.array().cast("array<string>")))
    rows = materialise(rows, "scanned")  # the patterns run once
    body, some = F.col(f"row.`{text}`"), rows.where(F.size("found") > 0)
    clean = unpacked(rows.where(F.size("found") == 0), columns, n_replaced=F.lit(0).cast("long"))
    each = some.select(F.md5(body).alias("of"), F.explode(F.array_distinct(F.flatten(F.transform("found", lambda e: _let(parts(e), terms))))).alias("t"))
    each = materialise(each.select("of", "t.kind", "t.value"), "found")
    drawn = materialise(distinct_surrogates(each, key), "drawn")
    pairs = each.join(drawn, ["kind", "value"]).select("of", F.struct(_label(F.col("kind"), F.col("value")).alias("k"), F.col("surrogate").alias("v")).alias("p"))
    maps = pairs.groupBy("of").agg(F.map_from_entries(F.collect_set("p")).alias("known"))  # what one text holds
    joined = some.withColumn("of", F.md5(body)).join(maps, "of", "left")
    new = F.transform("found", lambda e: _replacement(e, F.col("known"), key))
    fresh = F.array_join(F.flatten(F.zip_with(F.split(body, _ALL, -1), new, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    return clean.unionByName(unpacked(joined, columns, **{text: fresh, "n_replaced": F.size("found").cast("long")}))


def op5_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace(docs, key=session_key(spark)).select("doc_id", "text", "n_replaced")
