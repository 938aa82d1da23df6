import corpus_pipeline
from marlstone.llm._shared import materialise


def test_stages(spark, docs_of):
    from test_classifiers import corpus

    docs, labels = corpus(400)
    docs = [*docs, *((1000 + i, docs[2 * i + 1][1], "s0") for i in range(20))]
    frame = docs_of(docs)
    import tempfile

    folder = tempfile.mkdtemp()
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    current = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality_classifier", "minhash_near_dedup", "mixing_sources", "bpe_encoding"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        after = materialise(stage(spark, current, folder), name)
        seen[name] = after
        if name != names[-1]:
            assert after.columns == current.columns
        current = after
    truth = {i: (q, t) for i, q, t in labels}
    civil = {r["doc_id"] for r in seen["toxicity"].collect()}
    assert sum(truth[i][1] for i in civil if i in truth) <= 3
    good = {r["doc_id"] for r in seen["quality_classifier"].collect()}
    assert good <= civil and sum(not truth[i][0] for i in good if i in truth) <= 3
    texts = [r["text"] for r in seen["minhash_near_dedup"].collect()]
    assert len(texts) == len(set(texts))
    assert all(r["n_tokens"] == len(r["ids"]) for r in seen["bpe_encoding"].collect())
    assert seen["bpe_encoding"].count() == seen["mixing_sources"].count()
    assert corpus_pipeline.run(spark, folder).count() == seen["bpe_encoding"].count()


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, _row string, _cut double, _id bigint, _size string, _gone int, key string, label int, odds double, component_id bigint, copies string, size string"


def odd_table(spark, rows):
    tail = ("x", "r", 0.5, 7, "s", 1, "k", 1, 0.1, 3, "c", "z")
    return spark.createDataFrame([(*r, *tail) for r in rows], ODD)


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, ties, repeats, and further columns with the operators' own names."""
    from test_classifiers import corpus

    docs, labels = corpus(300)
    rows = [(i, t, "en", s, len(t)) for i, t, s in docs]
    long = " ".join(f"lona{i % 977} mipel" for i in range(150_000))
    odd = [(None, None, None, None, None), (None, "lona pel", None, None, None), (None, "lona pel", None, None, None), (900, "", "en", "s0", 0), (901, " \n", None, "s0", 2), (902, long, "en", "s1", len(long)), (903, "z" * 300_000, "en", None, 300_000), rows[1], rows[1], (904, rows[1][1], "fr", "s9", 1)]
    folder = str(tmp_path)
    odd_table(spark, rows + odd).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 1), (900, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    current = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialise(stage(spark, current, folder), name)
        assert after.columns == current.columns
        before = {tuple(r) for r in current.collect()}
        assert {tuple(r) for r in after.collect()} <= before  # rows are whole
        if name == "minhash_near_dedup":
            texts = [r["text"] for r in after.collect() if (r["text"] or "").strip()]
            assert len(texts) == len(set(texts))
        if name == "mixing_sources":
            assert all((r["text"] or "").strip() for r in after.collect())
        current = after
    out = corpus_pipeline.encode(spark, current, folder)
    assert out.count() == current.count() and out.columns == ["doc_id", "ids", "n_tokens"]
    assert corpus_pipeline.run(spark, folder).count() == out.count()


def test_stages_on_an_empty_table(spark, tmp_path):
    folder = str(tmp_path)
    odd_table(spark, []).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0
        if name != "bpe_encoding":
            assert out.columns == docs.columns
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_scratch_tables_go_when_a_stage_ends(spark, tmp_path):
    from marlstone.llm import _shared

    folder = str(tmp_path)
    odd_table(spark, [(i, f"some words {i}", "en", "s", 9) for i in range(20)]).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    before = set(_shared._made)
    corpus_pipeline.run(spark, folder)
    assert len(set(_shared._made) - before) == 1  # the result
