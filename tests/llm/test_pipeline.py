import random

import corpus_pipeline

EN = "the of and to in that is was for with his they this have from one had word but not what all were when".split()


def test_pipeline(spark, tmp_path):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice(EN) + rng.choice(["", "ing", "ed", "er", "s"]) for _ in range(n))
    passage = text(70)
    chrome = "a line on every site"
    rows = [(i, f"{text(100)}\n{chrome}\n{text(60)}", "en", f"s{i % 20}", 0) for i in range(40)]
    rows += [(40 + i, f"{text(60)} {passage} {text(60)}", "en", "s0", 0) for i in range(4)]
    rows += [(50, rows[0][1], "en", "s3", 0), (51, None, "en", "s1", 0), (52, "12 34", "en", "s1", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "best_fit_packing":
            assert out.columns == df.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append((name, {r["doc_id"]: r for r in docs.collect()} if name != "best_fit_packing" else docs.collect()))
    stages = dict(kept)
    assert set(stages["language_id"]) == {*range(44), 50}
    assert all(chrome not in r["text"] for r in stages["line_dedup"].values()) and len(stages["line_dedup"]) == 45
    assert set(stages["near_dedup"]) == set(range(44))
    assert [passage in stages["substring_dedup"][i]["text"] for i in range(40, 44)] == [True, False, False, False]
    assert {r["doc_id"] for r in stages["best_fit_packing"]} == set(range(44))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "substring_dedup", "best_fit_packing"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(stages["best_fit_packing"])
