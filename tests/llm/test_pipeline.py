"""The pipeline's stages: columns and rows on the tables, and each stage against a plain version on planted documents."""

from __future__ import annotations

import re

import corpus_pipeline
import pytest
from test_corpus_operators import brute_components, text_of

from gantry.llm import decontaminate, langid
from gantry.llm.tokens import tokenizer
from gantry.session import written


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Documents in two languages, near copies, benchmark passages, personal data, noise, nulls and repeated rows."""
    folder = str(tmp_path_factory.mktemp("tables"))
    item = text_of(5000, 30)
    rows = []
    for i in range(160):
        t = text_of(i, 60)
        rows.append((i, t if i % 2 else re.sub("[aeiou]", "ü", t), "en" if i % 2 else "xx", f"s{i % 3}", len(t)))
    for k in range(12):  # near copies of document 1
        w = rows[1][1].split()
        w[10 + k] = "edited"
        rows.append((200 + k, " ".join(w), "en", "s0", 1))
    rows += [(300 + k, text_of(6000 + k, 25) + " " + item, "en", "s1", 1) for k in range(4)]
    rows += [(400 + k, f"Mr. Person{chr(97 + k)}x Smith writes to u{k}@corp.org. " + text_of(7000 + k, 40), "en", "s2", 1) for k in range(4)]
    rows += [(500, None, "en", "s0", 0), (501, "", None, None, 0), (502, "123 !! 45", "en", "s0", 9), (503, "".join(chr(0x4E00 + i * 37 % 5000) for i in range(400)), None, "s0", 400), rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {s: f for s, f in corpus_pipeline.STAGES}


def test_stages_against_plain_versions(spark, planted):
    folder, stages = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = [tuple(r) for r in docs.collect()]
    kept = corpus_pipeline.materialise(stages["language"](spark, docs, folder), "t")
    got = sorted(tuple(r) for r in kept.collect())
    trees = langid.learn(docs)
    cost = langid._measured(trees, [(t or "").encode() for _, t, *_ in before])
    want = []
    for r, bits in zip(before, cost, strict=True):
        best = int(bits.argmin())
        sure = 1 / sum(2.0 ** -min(float(b - bits[best]), 1000) for b in bits)
        if any(c.isalpha() for c in r[1] or "") and sure >= 0.5 and bits[best] <= 1.5 * (trees.usual[best] * len(r[1].encode()) + 200):
            want.append(r)
    assert got == sorted(want) and {r[0] for r in before} - {r[0] for r in got} == {500, 501, 502, 503}

    one = corpus_pipeline.materialise(stages["near_duplicates"](spark, kept, folder), "t")
    component = brute_components(sorted({(r[0], r[1]) for r in got}), 5, 80)
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(i for i, (_, c) in component.items() if i == c)

    clean = corpus_pipeline.materialise(stages["decontamination"](spark, one, folder), "t")
    item = decontaminate.words_of(text_of(5000, 30))
    bad = {r["doc_id"] for r in one.collect() if sum(n for *_, n in decontaminate.tiles(item, decontaminate.words_of(r["text"]), 5)) >= len(item) / 2}
    assert bad == {300, 301, 302, 303} == {r["doc_id"] for r in one.collect()} - {r["doc_id"] for r in clean.collect()}

    safe = corpus_pipeline.materialise(stages["personal_data"](spark, clean, folder), "t")
    old, new = ({r["doc_id"]: r for r in df.collect()} for df in (clean, safe))
    assert old.keys() == new.keys()
    for i, r in new.items():
        assert r["n_chars"] == len(r["text"])
        if i < 400:
            assert r["text"] == old[i]["text"]
        else:
            assert "Smith" not in r["text"] and "corp" not in r["text"] and r["text"].split(". ", 2)[2] == old[i]["text"].split(". ", 2)[2]
    assert len({re.search(r"Mr\. \w+ (\w+) writes", new[400 + k]["text"])[1] for k in range(4)}) == 1

    import public_tokenizers

    t = tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    pieces = stages["packing"](spark, safe, folder).collect()
    for i, r in new.items():
        ids = b"".join(bytes(p["ids"]) for p in sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"]))
        assert [int.from_bytes(ids[k : k + 4], "little") for k in range(0, len(ids), 4)] == [*t.inner.encode(r["text"], add_special_tokens=False).ids, 2]


def test_run_keeps_only_what_it_needs(spark, planted):
    folder, _ = planted
    before = written(spark)
    assert corpus_pipeline.run(spark, folder).count() > 100
    mine = [p for p in written(spark) if p not in before]
    assert [re.sub(r"-[0-9a-f]+$", "", p.rsplit("/", 1)[1]) for p in mine] == ["language", "near_duplicates", "decontamination", "personal_data", "tokens", "queue-parts", "queue-base"]


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialise(stage(spark, before, sf), name)
        assert after.columns == docs.columns
        assert 0 < after.count() <= before.count()
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, sf)
    assert packed.select("doc_id").distinct().count() == before.count()
