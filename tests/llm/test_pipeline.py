import zlib

from pyspark.sql import functions as F


def test_every_stage_acts_and_keeps_clean_documents(sent, prose, near, tmp_path):
    import corpus_pipeline
    item = prose(1, 30)
    rows = [(i, prose(100 + i, 40), "en", "s", 1) for i in range(200)]
    rows += [(300 + i, prose(400 + i, 40) + " vile scum " + prose(500 + i, 3), "en", "s", 1) for i in range(60)]
    rows += [(600, rows[3][1], "en", "s", 1), (601, near(rows[4][1], 1, 1), "en", "s", 1), (602, prose(7, 20) + " " + item, None, "s", 1), (603, prose(8, 20) + " password=abcdef123", "en", None, 1), (604, None, "en", "s", None), (605, "", "en", "s", 0)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = sent.createDataFrame(rows, kind).withColumn("n_chars", F.length("text").cast("long"))
    folder = str(tmp_path)
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    sent.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, 1, 0) for i in range(150)] + [(300 + i, 1, 1) for i in range(40)]
    sent.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    ids, current = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(sent, current, folder)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        current = sent.read.parquet(f"{folder}/{name}")
        ids[name] = {r["doc_id"] for r in current.select("doc_id").collect()}
    plain = set(range(200)) | {604, 605}
    assert ids["toxicity"] == plain | {600, 601, 602, 603}
    assert ids["near_duplicates"] == plain | {602, 603} and ids["decontamination"] == plain | {603} == ids["secrets"] == ids["packing"]
    clean = {r["doc_id"]: r for r in sent.read.parquet(f"{folder}/secrets").collect()}
    assert clean[603]["text"].endswith("[SECRET]") and clean[603]["n_chars"] == len(clean[603]["text"]) and clean[5]["text"] == rows[5][1]
    assert corpus_pipeline.run(sent, folder).count() == sent.read.parquet(f"{folder}/packing").count()
    assert zlib.crc32(b"x") == sent.range(1).select(F.crc32(F.lit("x"))).first()[0]
