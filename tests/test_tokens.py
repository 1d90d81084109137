"""Token profiles and caps against the library, whole conversations encoded for every probe; file digests by blocks."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gantry.functions import tokens
from gantry.sources import readers


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def conversations(n, seed):
    r = random.Random(seed)
    words = ["one", "two", "three,", "naïve", "東京", "x" * 30, "12", "\n"]
    text = lambda k: " ".join(r.choice(words) for _ in range(r.randrange(k)))
    rows = [[{"role": role, "content": text(120)} for role in ["system"] * r.randrange(2) + ["user", "assistant"] * r.randrange(1, 4)] for _ in range(n)]
    return [*rows, [], None, [{"role": None, "content": None}, {"role": "tool", "content": "y " * 200}], [{"role": "user", "content": "z" * 64}] * 40]


def whole(tok, messages):
    total = label = 0
    for m in messages:
        before, behind = tokens.CHAT.get(m["role"], ("", ""))
        n = len(tok.encode(before + (m["content"] or "") + behind, add_special_tokens=False).ids)
        total, label = total + n, label + n * (m["role"] == "assistant")
    return total, label


def capped(tok, messages, cap):
    """Plain loops, as the rule is told."""
    ms = [{"role": m["role"], "content": m["content"] or ""} for m in messages or []]
    before = whole(tok, ms)[0]
    while whole(tok, ms)[0] > cap:
        best = None
        for i, m in enumerate(ms):
            rank = (m["role"] in ("user", "system"), len(m["content"]))
            if len(m["content"]) > 64 and (best is None or rank > best[0]):
                best = rank, i
        if best is None:
            return None, "impossible", before, whole(tok, ms)[0]
        m, full = ms[best[1]], ms[best[1]]["content"]
        m["content"] = full[:64]
        if whole(tok, ms)[0] > cap:
            continue
        low, high, keep = 64, len(full), 64
        while low <= high:
            mid = (low + high) // 2
            m["content"] = full[:mid]
            keep, low, high = (mid, mid + 1, high) if whole(tok, ms)[0] <= cap else (keep, low, mid - 1)
        m["content"] = full[:keep]
    after = whole(tok, ms)[0]
    return [(m["role"], m["content"]) for m in ms], "identity" if before <= cap else "content_prefix_crop", before, after


@pytest.fixture(scope="module")
def rows(spark):
    made = list(enumerate(conversations(60, 1)))
    return made, spark.createDataFrame([(i, m, 5) for i, m in made], "i int, messages array<struct<role:string,content:string>>, turns int").repartition(3)


def test_profiles_equal_the_library(rows, path):
    tok = tokens._tokenizer(path)
    got = {r["i"]: (r["total_tokens"], r["label_tokens"], r["turns"], r["assistant_turns"]) for r in tokens.token_profile(rows[1], path, template=tokens.CHAT).collect()}
    assert got == {i: (*whole(tok, m or []), len(m or []), sum(x["role"] == "assistant" for x in m or [])) for i, m in rows[0]}
    assert tokens.token_profile(rows[1].limit(0), path).count() == 0


@pytest.mark.parametrize("cap", [100_000, 300, 120, 40])
def test_capped_conversations_fit(rows, path, cap):
    tok, kinds = tokens._tokenizer(path), set()
    out = tokens.capped_to_tokens(rows[1], cap, path, template=tokens.CHAT).collect()
    for r in out:
        want = capped(tok, rows[0][r["i"]][1], cap)
        made = None if r["messages"] is None else [(m["role"], m["content"]) for m in r["messages"]]
        assert (made, r["transformation"], r["original_tokens"], r["reference_tokens_after_crop"]) == want
        assert made is None or r["reference_tokens_after_crop"] <= cap
        kinds.add(r["transformation"])
    assert len(out) == len(rows[0]) and kinds == ({"identity"} if cap == 100_000 else {"identity", "content_prefix_crop", "impossible"})


def test_manifests_of_nested_files(spark, tmp_path):
    root = tmp_path / "root with space"
    (root / "a" / "b").mkdir(parents=True)
    big = random.Random(1).randbytes(300_000)
    for name, content in (("x.bin", big), ("a/x.bin", b""), ("a/b/y", b"1"), ("é", b"2")):
        (root / name).write_bytes(content)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    wanted = [("x.bin", sha(big)), ("a/x.bin", sha(b"")), ("a/b/y", sha(b"2")), ("b/y", sha(b"1")), ("gone", sha(b""))]
    got = {r["path"]: r["state"] for r in readers.verified_files(spark, str(root), spark.createDataFrame(wanted, "path string, sha256 string")).collect()}
    assert got == {"x.bin": "ok", "a/x.bin": "ok", "a/b/y": "mismatched", "b/y": "missing", "gone": "missing"}
    found = readers.file_digests(spark, str(root), block=1000)
    assert {(r["path"], r["length"], r["sha256"]) for r in found.collect()} >= {("x.bin", 300_000, sha(big)), ("a/b/y", 1, sha(b"1"))}
    plan = readers.verified_files(spark, str(root), spark.createDataFrame(wanted, "path string, sha256 string")).select(F.count("*"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan
