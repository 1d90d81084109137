"""Cases that bounds, cuts and repeated rows once hid from the corpus operators."""

from __future__ import annotations

import random
import re
import string
import zlib

from gantry.llm import langid, pii, repeats, url_filter


def test_long_entities_go_whole(spark):
    r = random.Random(3)
    run = lambda n, signs=string.ascii_letters + string.digits: "".join(r.choice(signs) for _ in range(n))
    token, local, label, key, hexa = run(360), run(80) + "1", run(70), run(90), run(300, "0123456789abcdef")
    deep = ".".join(run(4, string.ascii_lowercase) for _ in range(12))
    end = run(30, string.ascii_lowercase)
    long = "Wolfeschlegelsteinhausenbergerdorffwelche"
    rows = [
        f'token = "{token}" end', f"mail {local}@{label}.{deep}.org, end", f"to a@b1.{end}. end", f"key sk-{key} end", f"secret={hexa}; end", f"password{' ' * 9}=     {key} end",
        "Mr. John Ronald Smith said", f"Frau {long} {long} said", "Mr. J. R. Tolkien said", "Mrs Ann B. Lee Miller-Jones said", "a@b.example.com.1 and a@b.example.com. x",
    ]
    got = {x["doc_id"]: x for x in pii.replace(spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string"), key="k").collect()}
    assert [got[i]["n_replaced"] for i in range(len(rows))] == [1] * 10 + [2]
    for i, cut in ((0, token), (1, local), (3, key), (4, hexa), (5, key)):
        pieces = {cut[k : k + 8] for k in range(len(cut) - 7)}
        assert not any(p in got[i]["text"] for p in pieces), rows[i]
        assert got[i]["text"].endswith("end")
    assert re.fullmatch(rf"to \S+@\S+\.{end}\. end", got[2]["text"])  # one address; its top-level domain stays
    assert label not in got[1]["text"] and not any(f".{x}." in got[1]["text"] for x in deep.split(".")[1:-1])
    assert re.fullmatch(r"secret=[0-9a-f]{300}; end", got[4]["text"])
    for i, words in ((6, "John Ronald Smith"), (7, long), (8, "Tolkien"), (9, "Ann Lee Miller Jones")):
        assert not any(w in got[i]["text"] for w in words.split()) and got[i]["text"].endswith(" said")
    first, second = got[10]["text"].split(" and ")
    assert first.endswith(".com.1") and second.endswith(".com. x") and first[:-2] == second[:-3]
    many = " ".join(["x." * 4_000 + "y", "a@" + "b." * 4_000 + "org", "Mr. " + "Ab " * 4_000, "token=" + "q1" * 4_000])  # no recursion by length
    out = pii.replace(spark.createDataFrame([(1, many)], "doc_id int, text string"), key="k").first()
    assert out["n_replaced"] == 3 and "b." * 50 not in out["text"] and "Ab" not in out["text"] and "q1" * 50 not in out["text"]


def test_repeated_rows_are_one_document(spark, monkeypatch):
    r = random.Random(5)
    text = lambda n: "".join(r.choice(string.ascii_lowercase + " ") for _ in range(n))
    lone, shared = text(400), text(300)
    texts = [lone, shared + text(150), text(120) + shared + text(90), text(90) + shared[40:240] + text(200), text(60) + shared, "ab" * 300, shared + "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def removed(rows):
        return sorted((x["doc_id"], x["n_removed"], x["kept_sha256"]) for x in repeats.remove_repeats(rows, keep_text=False).collect())

    once = removed(docs)
    assert once[0][1] == 0 and sum(x[1] for x in once) > 1000
    assert removed(docs.unionByName(docs).repartition(3)) == sorted(once * 2)
    assert removed(docs.unionByName(docs).coalesce(1)) == sorted(once * 2)
    found = repeats.frequent_anchors
    monkeypatch.setattr(repeats, "frequent_anchors", lambda rows, least, at_least: found(rows, least, 2, 0.0))
    assert removed(docs.unionByName(docs).repartition(3)) == sorted(once * 2)


def test_verdicts_do_not_depend_on_the_size_of_the_crawl(spark):
    link = '<a href="{}">t</a>'

    def verdicts(copies):
        rows = []
        for i in range(copies):
            rows += [(f"http://bad{i}.net/es/1", ""), (f"http://bad{i}.net/en/1", ""), (f"http://bad{i}.net/es/2", ""), (f"http://friend{i}.org/1", link.format(f"http://bad{i}.net/es/2")), (f"http://lone{i}.org/1", "")]
        out = url_filter.judge(spark.createDataFrame(rows, "url string, html string"), floor=0.05).collect()
        assert len(out) == 5 * copies
        return {(re.sub(r"\d+(?=\.)", "", x["url"]), x["verdict"]) for x in out}

    assert verdicts(1) == verdicts(30)
    assert ("http://friend.org/1", "block") in verdicts(1)


def test_small_languages_keep_their_strings(spark):
    r = random.Random(7)
    run = lambda n, signs: "".join(r.choices(signs, k=n))
    rows = [(i, run(50_000, string.ascii_lowercase), "big") for i in range(60)] + [(i, run(200, "abcdefgh" + string.digits), "few") for i in range(100, 112)]
    trees = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    few = trees.languages.index("few")
    padded = [langid.PAD + t.encode() for i, t, x in rows if x == "few" and zlib.crc32(str(i).encode()) % 4 != 2]
    own = {int.from_bytes(t[k : k + 4], "big") for t in padded for k in range(len(t) - 3)}
    assert len(trees.grams[3]) > 400_000 and own <= set(trees.grams[3].tolist())
    alone = langid.learn(spark.createDataFrame(rows[60:], "doc_id long, text string, lang string"))
    at = {int(g): float(b) for g, b in zip(trees.grams[3], trees.bits[3][:, few], strict=True)}
    assert all(at[int(g)] == float(b) for g, b in zip(alone.grams[3], alone.bits[3][:, 0], strict=True))  # codes as if learned alone
