"""The pipeline's stages on awkward rows: each does its part, in the order given."""

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    import random

    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    prose = lambda n=70: ". ".join(" ".join(word() for _ in range(10)) for _ in range(n // 10)) + "."
    leak = prose(40)
    rows = [(i, prose(), "en", f"s{i % 3}", 0, "x") for i in range(30)]
    rows += [(40, rows[0][1], "en", "s0", 0, "x"), (41, rows[1][1].replace(" ", "  ") + " more", "en", "s1", 0, "x"), (42, prose() + " " + leak, "en", "s1", 0, "x")]
    rows += [(50, "too few words", "en", "s1", 0, "x"), (51, None, None, None, None, None), (52, "", "en", "s1", 0, "x"), (53, "Of " * 200, "en", "s1", 0, "x"), (54, " | ".join(word() for _ in range(90)), "en", "s1", 0, "x")]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string").write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d)


def test_stages_keep_and_drop(spark, made):
    docs = spark.read.parquet(f"{made}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, made))
        seen.append((name, {r.doc_id for r in docs.select("doc_id").collect()}))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    clean = set(range(30))
    assert seen[0][1] == clean | {40, 41, 42} and seen[1][1] == clean | {42} and seen[2][1] == clean
    assert seen[4][1] == seen[3][1] <= clean and {"shard", "vslot"} <= set(docs.columns)
    assert corpus_pipeline.run(spark, made).count() == docs.count()


def test_empty_tables(spark, made, tmp_path):
    spark.read.parquet(f"{made}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{made}/benchmark.parquet").limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
