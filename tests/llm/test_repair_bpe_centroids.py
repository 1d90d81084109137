"""Conversation repair, byte pair encoding and centroid clustering against brute force and the library, odd rows included."""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import zlib

import numpy as np
import pytest
from compare import differences, duck
from pyspark.sql import functions as F

from gantry.llm import bpe, centroids, conversations

AFTER = {"": "su", "s": "u", "u": "a", "a": "u"}


def plain(v):
    return " " if v is None else str(v)


def damage(rows):
    """What the contract does to rows (conversation, turn, role, text), by conversation."""
    convs = {}
    for c, t, r, x in rows:
        kept = convs.setdefault(c, [])
        pick, r, x = zlib.crc32(f"{plain(c)}:{plain(t)}".encode()) % 20, plain(r), plain(x)
        x = "" if pick == 1 else x.translate(str.maketrans("", "", ".!?")) if pick == 2 else x
        kept += [(t, "user" if pick == 4 else r, x)] * (0 if pick == 0 else 2 if pick == 3 else 1)
    return convs


def cheapest(initials, faults):
    """The least (cost, audit) by a search over all edits, kept in order of both."""
    heap, done = [(0, "", 0, "")], set()
    while True:
        cost, audit, i, state = heapq.heappop(heap)
        if i == len(initials) and state in ("", "a"):
            return cost, audit
        if (i, state) in done:
            continue
        done.add((i, state))
        go = lambda c, e, j, s: heapq.heappush(heap, (cost + c, audit + e, j, s))  # noqa: B023, E731
        for role in "ua":
            if role in AFTER[state]:
                go(3, "I", i, role)
        if i < len(initials):
            go(4, "D", i + 1, state)
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                if initials[i] and initials[i] in AFTER[state]:
                    go(more, "K", i + 1, initials[i])
                for role in "ua":
                    if role in AFTER[state]:
                        go(3 + more, "R", i + 1, role)


def repaired(rows):
    out = {}
    for conv, kept in damage(rows).items():
        kept = sorted(kept, key=lambda z: (z[0] is not None, z[0] or 0, hashlib.md5(f"{len(z[1])}:{z[1]}{z[2]}".encode()).digest()))
        seen, faults = set(), []
        for _, r, x in kept:
            core = x.strip(" \t\n\v\f\r")
            faults.append("blank" if not core else "duplicate" if (r, x) in seen else "truncated" if core[-1] not in ".!?" else "")
            seen.add((r, x))
        initials = [r[:1] for _, r, _ in kept]
        cost, audit = cheapest(initials, faults)
        state, lines, rest = "", [], iter(kept)
        for e in audit:
            _, r, x = (None, "", "") if e == "I" else next(rest)
            if e != "D":
                state = r[0] if e == "K" else AFTER[state].replace("s", "")
                lines.append(f"{r if e == 'K' else {'u': 'user', 'a': 'assistant'}[state]}:{x}")
        turns = [t for t, _, _ in kept if t is not None]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repairs(rows, **options):
    found = conversations.digests(conversations.repair(conversations.damaged(rows), present="present", **options)).collect()
    assert len({r["conv_id"] for r in found}) == len(found)
    return {r["conv_id"]: tuple(r)[1:] for r in found}


@pytest.fixture(scope="module")
def odd_turns(spark):
    r = random.Random(1)
    texts = ["a.", "b", "", None, " \n", "Hi!", "Ok?", "x", "é。", "a" * 3000 + ".", *(f"t{r.random()}." for _ in range(12))]
    rows = [(r.choice([0] * 10 + [1, 2, 3, None, 5, 6, 7, 8, 9]), r.choice([None, *range(-3, 300)]), r.choice(["user", "assistant", "system", "tool", "", None, "u"]), r.choice(texts), 1) for _ in range(2000)]
    rows += [(77, None, "user", "same.", 1)] * 300
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit int").repartition(5)


def test_repair_equals_a_search(spark, odd_turns):
    rows = [tuple(r)[:4] for r in odd_turns.collect()]
    assert repairs(odd_turns) == repairs(odd_turns, most_bytes=2000) == repaired(rows)
    assert repairs(odd_turns.limit(0)) == {}
    named = conversations.repair(odd_turns.toDF("c", "n", "who", "said", "x"), conv_id="c", turn="n", role="who", text="said")
    assert set(named.columns) >= {"conv_id", "audit", "turns"}


def test_repair_of_the_given_conversations(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = repairs(rows)
    assert got == repaired([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows.collect()]) and len(got) == 100
    asked = conversations.op11_conversation_repair(spark, "/root/testdata/sf0.01")
    assert asked.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_blocks_of_one_long_conversation(spark):
    """Cuts anywhere change nothing: one conversation over many tasks, its texts repeated far apart."""
    r = random.Random(4)
    rows = [("1", i, r.choice(["user", "assistant", "user", "system"]), r.choice(["a.", "b!", f"{r.random()}.", f"{r.random()}"])) for i in range(1500)]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").repartition(3)
    want = repaired(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for most in (500, 1 << 20):
            pieces = conversations.repair(conversations.damaged(df), present="present", most_bytes=most)
            assert pieces.count() > 2 and repairs(df, most_bytes=most) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repaired_turns_follow_the_grammar(spark, odd_turns):
    import re

    pieces = conversations.repair(odd_turns, most_bytes=3000).orderBy("conv_id", "block", "part").collect()
    by = {}
    for p in pieces:
        by.setdefault(p["conv_id"], []).extend(t["role"][0] for t in p["turns"])
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in by.values()) and len(by) == odd_turns.select("conv_id").distinct().count()


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return path, tok


def digests_by_library(tok, rows):
    out = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        out.append((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def digests_by_words(docs, path, **options):
    out = bpe.decode(bpe.encode(docs, path, **options), path)
    out = out.select("doc_id", F.octet_length("ids") / 4, F.sha2("ids", 256), F.sha2(F.col("text").cast("binary"), 256)).collect()
    return sorted(((r[0], int(r[1]), r[2], r[3]) for r in out), key=repr)


def test_encoding_equals_the_library(spark, vocabulary):
    path, tok = vocabulary
    r = random.Random(0)
    signs = [chr(c) for c in [*range(1, 0x180), 0x300, 0x301, 0x3A3, 0x3C2, 0x2003, 0x2028, 0x1E9E, 0x4E00, 0xAC00, 0x1100, 0x1161, 0x1F600, 0x200D, 0xFEFF, 0x3000, 0x0958]] + [" "] * 60
    words = ["Hello", "<|endoftext|>", "<|startoftext|>", "it's", "don't.", "ΣΑΣ", "é", "́x", "a b", "İstanbul", "foo,bar", "<|ENDOFTEXT|>", *(f"w{i}" for i in range(200))]
    texts = [None, "", "  \n", "x" * 100_000, "ab " * 50_000, "<|endoftext|>a<|endoftext|>"]
    texts += ["".join(r.choice(signs) for _ in range(r.randrange(300))) for _ in range(300)] + [r.choice([" ", "\t", " \n"]).join(r.choice(words) for _ in range(r.randrange(200))) for _ in range(200)]
    rows = [(r.choice([None, r.randrange(400)]), t) for t in [*texts, *texts[:20]]]
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, ids int, chunk int").repartition(3)
    want = digests_by_library(tok, rows)
    assert digests_by_words(docs, path) == want
    assert digests_by_words(docs, path, common=20) == want  # nearly every word by the other way
    assert digests_by_words(docs.limit(0), path) == []


def test_encoding_of_the_given_documents(spark, vocabulary, monkeypatch):
    path, tok = vocabulary
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = bpe.op12_bpe(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((tuple(x) for x in got.collect()), key=repr) == digests_by_library(tok, rows)


def test_decoding_skips_unknown_ids(spark, vocabulary):
    path, tok = vocabulary
    ids = [320, 70_000, 49_407, 585]
    blob = bytearray(np.array(ids, dtype="<u4").tobytes())
    got = bpe.decode(spark.createDataFrame([(1, blob, "old"), (2, None, "old"), (3, bytearray(), "old")], "n int, ids binary, text string"), path).orderBy("n").collect()
    assert [x["text"] for x in got] == [tok.decode(ids, skip_special_tokens=False), "", ""]


def clustered(rows):
    """The contract in whole numbers of any size: vec_id, cluster, distance, both sums and the centroid's hash."""
    v = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    if not v:
        return []
    q = np.array([x for _, x in v], dtype=object)
    first = sorted(range(len(v)), key=lambda i: (hashlib.sha256(f"2:{'' if v[i][0] is None else v[i][0]}".encode()).hexdigest(), v[i][1]))[:40]
    c = [list(v[i][1]) for i in first]
    for left in range(5, -1, -1):
        d = np.stack([((q - np.array(x, dtype=object)) ** 2).sum(axis=1) for x in c], axis=1)
        a, d = d.argmin(axis=1), d.min(axis=1)
        for k in range(len(c)) if left else ():
            own = q[a == k]
            if len(own):
                c[k] = [sum(own[:, j]) // len(own) for j in range(64)]
    sums, total = [sum(d[a == k]) for k in range(len(c))], sum(d)
    return sorted(((i, int(k), int(x), int(sums[k]), int(total), hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for (i, _), k, x in zip(v, a, d, strict=True)), key=repr)


def clusters_of(spark, folder):
    return sorted((tuple(r) for r in centroids.op13_centroid_clusters(spark, folder).collect()), key=repr)


def test_clusters_equal_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK", 300)
    r = random.Random(0)
    base = [[r.gauss(0, 1) for _ in range(64)] for _ in range(60)]
    rows = []
    for _ in range(1500):
        near = [x + r.gauss(0, 0.05) for x in r.choice(base)]
        odd = [None, [1.0] * 63, [1.0] * 65, [], [math.nan, *near[1:]], [None, *near[1:]], [math.inf, *near[1:]]]
        e = r.choice(odd) if r.random() < 0.05 else base[0] if r.random() < 0.4 else [1000 * x for x in near] if r.random() < 0.05 else near
        rows.append((r.choice([None, *[r.randrange(1300)] * 50]), e, 3, 4))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster int, q int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    back = [(x["vec_id"], x["embedding"]) for x in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()]
    assert clusters_of(spark, str(tmp_path)) == clustered(back)


@pytest.mark.parametrize("n", [0, 1, 7])
def test_few_vectors(spark, tmp_path, n):
    rows = [(i, [float(i % 3)] * 64) for i in range(n)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert clusters_of(spark, str(tmp_path)) == clustered(rows)


def test_components_beyond_bounds_are_left_out(spark):
    rows = [(i, [float(i)] * 64) for i in range(5)] + [(9, [1e30] + [0.0] * 63), (10, [-500_000.0] + [0.0] * 63)]
    assigned, _ = centroids.lloyd(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), clusters=2)
    assert {r["vec_id"] for r in assigned.collect()} == {0, 1, 2, 3, 4, 10}


def test_cover_tree_covers_and_separates():
    r = np.random.default_rng(0)
    points = np.concatenate([r.normal(size=(1, 8)) * 20 + r.normal(size=(80, 8)) for _ in range(8)] + [np.ones((50, 8))])
    t = centroids.cover_tree(points, 4)
    assert sorted(t.order.tolist()) == list(range(len(points))) and len(t.centre) > 20
    there = points[t.order]
    for k in range(len(t.centre)):
        inside = np.linalg.norm(there[t.start[k] : t.end[k]] - there[t.centre[k]], axis=1)
        assert inside.max() <= t.radius[k] + 1e-9 and t.start[k] <= t.centre[k] < t.end[k]
        kids = range(t.first[k], t.first[k] + t.n[k])
        assert sum(t.end[c] - t.start[c] for c in kids) == (t.end[k] - t.start[k] if t.n[k] else 0)
        assert all(np.linalg.norm(there[t.centre[a]] - there[t.centre[b]]) > t.radius[k] / 2 for a in kids for b in kids if a < b)


def test_clusters_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert not differences(centroids.op13_centroid_clusters(spark, sf), duck(sf), centroids.ORACLE_SQL)
