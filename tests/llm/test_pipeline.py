import corpus_pipeline


def test_passages_of_50_words_go(spark):
    passage = " ".join(f"w{k:03d}" for k in range(50))
    texts = ["Start of one " + passage + " and its end.", "Another begins here: " + passage + " It ends too.", "Nothing is shared by this one."]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    kept = {r.doc_id: r.text for r in corpus_pipeline.suffix_dedup(spark, docs, "").collect()}
    assert len(passage.encode()) < 400 and kept == {k: t.replace(" " + passage + " ", "") for k, t in enumerate(texts)}
