import corpus_pipeline
from quadrille.llm import pii


def test_stages(spark, docs, odd):
    base = " ".join(f"w{i}" for i in range(150))
    rows = [*odd, *((100 + i, f"{base} mail me at u{i}@b.cc", "en", f"s{i % 3}") for i in range(3)), *((200 + i, " ".join(f"t{i}x{j}" for j in range(60)), "en", f"s{i % 3}") for i in range(30))]
    df = docs(rows).select("doc_id", "text", "lang", "source", "n_chars")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, "")
        seen[name] = out.collect()
        if name != "packing":
            assert out.columns == df.columns
            df = spark.createDataFrame(seen[name], df.schema)
    ids = lambda k: sorted(r["doc_id"] for r in seen[k] if r["doc_id"] is not None)
    assert not {1, 2, 3, 4} & set(ids("language"))
    assert [i for i in ids("near_duplicates") if 100 <= i < 103] == [100]
    assert [i for i in ids("near_duplicates") if i >= 200] == list(range(200, 230))
    assert ids("personal_data") == ids("near_duplicates")
    assert all(not pii.base_spans(r["text"]) for r in seen["personal_data"])
    assert set(ids("mixture")) <= set(ids("personal_data")) and ids("packing") == ids("mixture")
    assert all(r["n_chars"] == len(r["text"]) for r in seen["mixture"])


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and {"doc_id", "batch_id"} <= set(out.columns)


def test_empty(spark, docs):
    df = docs([]).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        df2 = stage(spark, df, "")
        assert df2.count() == 0
