"""The corpus pipeline on small documents with planted cases, stage by stage."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    r = random.Random(0)
    make = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    item = make(30)
    passage = make(60)
    rows = {k: make(r.randint(30, 120)) for k in range(120)}
    toxic = set(range(0, 120, 7))
    for k in toxic:
        w = rows[k].split()
        for _ in range(4):
            w[r.randrange(len(w))] = r.choice(["vileword", "grossly", "nastiest"])
        rows[k] = " ".join(w)
    rows[200] = rows[1]
    rows[201] = rows[2] + " tail"
    rows[202] = make(50) + " " + item + " " + make(40)
    rows[203], rows[204] = make(40) + " " + passage + " " + make(40), make(40) + " " + passage + " " + make(40)
    rows[205], rows[206] = None, ""
    docs = [(k, t, "en", "src", len(t or "")) for k, t in rows.items()] + [(None, "no id", "en", "src", 5), (3, rows[3], "en", "src", len(rows[3])), (4, make(90), "en", "src", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k in toxic), 1) for k in range(100)], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert out.columns == df.columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen[name] = {x.doc_id: x for x in now.collect()}
        if name == "near_dedup":
            assert now.where("doc_id = 3").count() == 1 and now.where("doc_id = 4").count() == 2
    assert not toxic & set(seen["toxicity"]) and len(seen["toxicity"]) >= len(rows) - len(toxic)
    near = seen["near_dedup"]
    assert 200 not in near and 201 not in near and {1, 2, 202, 203, 204, 205, 206, None} <= set(near)
    sub = seen["substring_dedup"]
    assert passage in sub[203].text and passage[20:-20] not in sub[204].text and sub[204].n_chars == len(sub[204].text) and sub[1].text == rows[1] and set(sub) == set(near)
    assert set(sub) - set(seen["decontamination"]) == {202}
    assert set(seen["packing"]) == set(seen["decontamination"]) and None in seen["packing"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["packing"]) + 1


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, n_chars long"), ("labels", "doc_id long, toxic int, quality int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
