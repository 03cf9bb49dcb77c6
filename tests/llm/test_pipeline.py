from pyspark.sql import functions as F

import corpus_pipeline


def test_stages_keep_clean_documents_and_take_effect(spark, tmp_path):
    base = "clean words that nobody minds number{0} " * 8
    docs = [(i, " ".join(f"{w}{i}x{j}" for j, w in enumerate(base.split())), "en", "s", 10) for i in range(40)]
    passage = "benchmark passage of ten words or more that must not stay in the corpus"
    docs += [(100 + i, docs[i][1], "en", "s", 1) for i in range(3)]
    docs += [(200, docs[30][1].replace("words30x1", "before " + passage + " after"), "en", "s", 1)]
    docs += [(300, docs[31][1][::-1] + ' password=f7c8b4419544ffc2cf end', "en", "s", 1), (400, None, None, None, None), (401, "", "en", "s", 0), (None, "a row without an id", "en", "s", 3)]
    docs += [(1000 + i, f"vile thing{i} and rotten stuff{i} here. More of it{i}.", "en", "s", 1) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(1000 + i, 0, 1) for i in range(60)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, seen = frame, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == frame.columns
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {x.doc_id: x.text for x in at.collect()}
    assert set(seen["toxicity"]) == {d for d, *_ in docs if d is None or d < 1000}
    gone = set(seen["toxicity"]) - set(seen["near_duplicates"])
    assert {100, 101, 102, 401} <= gone and not gone & set(range(30)) and {400, None} <= set(seen["near_duplicates"])
    assert all(passage not in (t or "") for t in seen["decontamination"].values())
    assert all(seen["decontamination"][i] == t for i, t in seen["near_duplicates"].items() if passage not in (t or ""))
    assert seen["secrets"][300].endswith("password=[SECRET] end")
    counts = {x.doc_id: x.n for x in corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert set(counts) == set(seen["secrets"])
    assert all(x.n_chars == (None if x.text is None else len(x.text)) for x in at.collect())


def test_rows_without_an_id_lose_passages_secrets_and_near_copies(spark, tmp_path):
    passage = "benchmark passage of ten words or more that must not stay in the corpus"
    text = " ".join(f"word{j}" for j in range(60)) + f" {passage} then token = \"f7c8b4419544ffc2cf17\" end"
    docs = [(None, text, "en", "s", 1), (None, text + " more", "en", "s", 1), (2, "quite different words here", "en", "s", 1)]
    at = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(None, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        at = stage(spark, at, str(tmp_path))
    out = {x.doc_id: x.text for x in at.collect()}
    assert at.count() == 2 and out[2] == docs[2][1]
    assert passage not in out[None] and '[SECRET]" end' in out[None]
