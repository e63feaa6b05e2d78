"""The corpus pipeline, stage by stage, against plain versions."""

import re
import zlib
from collections import Counter

import numpy as np
from rows import SF
from plain import component_ids, held_items

import corpus_pipeline
from seqlattice.llm import mixing, quality, queries, tokenstore
from seqlattice.llm.common import fold, materialize


def test_stages(spark, small):
    docs = small
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "mixing", "token_files"]
    chain = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet").where(fold("doc_id", 5) != 0))
    good = {r["doc_id"] for r in quality.score(docs, chain).where("score >= 0.3").collect()}
    one = materialize(stages["quality"](spark, docs, SF), "one")
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == good

    rows = [(r["doc_id"], r["text"]) for r in one.collect()]
    first = {r[0] for r, c in zip(rows, component_ids(rows, 5, 80)) if r[0] == c}
    two = materialize(stages["near_duplicates"](spark, one, SF), "two")
    assert two.columns == docs.columns and {r["doc_id"] for r in two.collect()} == first

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    three = materialize(stages["decontamination"](spark, two, SF), "three")
    assert {r["doc_id"] for r in three.collect()} == {i for i, t in rows if i in first and not held_items(t, items)}

    passes = {r["doc_id"]: len(r["positions"]) for r in mixing.curriculum_mix(three).collect()}
    four = materialize(stages["mixing"](spark, three, SF), "four")
    ids = [r["doc_id"] for r in four.collect()]
    assert four.columns == docs.columns and sorted(ids) == sorted(i for i, n in passes.items() for _ in range(n))

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    want = sorted((r["doc_id"], zlib.crc32(np.array([*tok.encode(r["text"], add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in four.collect())
    last = stages["token_files"](spark, four, SF)
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in last.collect()) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, last.collect()))


def test_token_files_keep_the_curriculum(spark, small):
    stages = dict(corpus_pipeline.STAGES)
    docs = materialize(small, "documents")
    mixed = materialize(stages["mixing"](spark, docs, SF), "mixed")
    plan = {r["doc_id"]: r for r in mixing.curriculum_mix(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    reads = sorted((p, i, k) for i, r in plan.items() for k, p in enumerate(r["positions"]))
    want = []
    for _, i, k in reads:
        n = min(plan[i]["taken"] - k * plan[i]["size"], plan[i]["size"])
        found = list(re.finditer(r"[^\x20\x09-\x0D]+", texts[i]))
        want.append((i, texts[i] if n == len(found) else texts[i][: found[n - 1].end()]))
    rows = mixed.select("doc_id", "text", "n_chars", *[c.alias(f"k{i}") for i, c in enumerate(tokenstore.file_order(mixed))]).orderBy("k0", "k1").collect()
    assert [(r["doc_id"], r["text"]) for r in rows] == want and any(t != texts[i] for i, t in want)
    assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] != texts[r["doc_id"]])
    target = {r["source_size"]: r["target"] for r in plan.values()}
    used = Counter()
    for i, t in want:
        used[plan[i]["source_size"]] += len(re.findall(r"[^\x20\x09-\x0D]+", t))
    assert all(abs(used[s] - t) <= 1 for s, t in target.items())
    stored = stages["token_files"](spark, mixed, SF).orderBy("start").collect()
    assert [r["doc_id"] for r in stored] == [i for i, _ in want]


def test_stages_take_odd_and_empty_tables(spark, edge, tmp_path):
    for name, docs in (("odd", edge), ("empty", edge.limit(0))):
        sf = str(tmp_path / name)
        docs.write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (4, 1, 0), (16, 0, 0), (14, 0, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([(1, "one two three four five"), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        now = spark.read.parquet(f"{sf}/documents.parquet")
        for stage, run in corpus_pipeline.STAGES[:-1]:
            now = materialize(run(spark, now, sf), stage)
            assert now.columns == edge.columns
        last = corpus_pipeline.run(spark, sf)
        assert last.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and last.count() == now.count() and (now.count() > 0) == (name == "odd")
