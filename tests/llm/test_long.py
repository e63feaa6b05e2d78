"""Texts of several megabytes, and an empty table, through every operator's query and the pipeline."""

import random

import corpus_pipeline
from rows import documents
from seqlattice.llm import queries


def tables(spark, path, rows):
    documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 0), (7, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six"), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    ids = [(r[0], f"u{r[0]}", r[1] and f"<nav>menu</nav><article><p>{r[1]}</article>") for r in rows]
    spark.createDataFrame(ids, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    vectors = [(r[0], [float((r[0] * k) % 7) for k in range(1, 33)], r[0] % 2) for r in rows]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")


def test_texts_of_megabytes(spark, tmp_path):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(5000)]
    prose = lambda n, stop: "".join(rng.choice(words) + (stop if i % 12 == 11 else " ") for i in range(n))
    long = prose(400_000, ".\n")
    rows = [(1, long, "en", "a"), (2, long + " and more", "en", "a"), (3, prose(200_000, ", "), "de", "b"), (4, "short text", "en", "b"), (5, None, None, None), (7, "!!! " * 50, "en", "b")]
    size = {r[0]: len(r[1] or "") for r in rows}
    assert size[1] > 2_000_000
    path = str(tmp_path / "long")
    tables(spark, path, rows)
    got = {name: query(spark, path).collect() for name, query in queries.QUERIES.items()}
    several = ("op10_decontamination", "op11_whitening")
    assert {name: len(r) for name, r in got.items() if name not in several} == {name: len(rows) for name in got if name not in several}
    assert {r["vec_id"] for r in got["op11_whitening"]} == set(size)
    assert {r["page_id"]: r["n_chars"] for r in got["op13_html_text"]} == {i: len("\n".join(" ".join((r[1] or "").split()) for _ in "x")) for i, r in zip(size, rows)}
    by_id = {name: {r["doc_id"]: r for r in rows} for name, rows in got.items() if name not in ("op11_whitening", "op12_vector_codes", "op13_html_text")}
    assert {i: r["component_id"] for i, r in by_id["op1_jaccard_join"].items()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 7: 7}
    assert by_id["op3_language"][1]["lang_pred"] == "en" and by_id["op4_lm_scoring"][1]["n_tokens"] == 400_001
    assert {i: r["n_chars"] for i, r in by_id["op6_fingerprints"].items()} == size and by_id["op6_fingerprints"][2]["near_next"] > 0.99
    assert by_id["op8_token_files"][2]["n_tokens"] > 400_000 and by_id["op9_suffix_dedup"][2]["n_removed"] >= size[1]
    assert corpus_pipeline.run(spark, path).count() > 0


def test_empty_tables(spark, tmp_path):
    path = str(tmp_path / "none")
    tables(spark, path, [])
    assert {name: query(spark, path).count() for name, query in queries.QUERIES.items()} == dict.fromkeys(queries.QUERIES, 0)
    assert corpus_pipeline.run(spark, path).count() == 0
