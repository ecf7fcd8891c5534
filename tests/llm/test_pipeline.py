import corpus_pipeline
from statutegrid.llm import line_crf, pieces
from tests.llm.brute import shingles


def test_stages_take_effect_on_the_small_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    given, names = docs, docs.columns
    kept = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == names if n < 4 else set(names) <= set(docs.columns)
        kept.append(docs)
    model = line_crf.train(given, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = given.collect()
    good = {r["doc_id"] for r, s in zip(rows, model.document_scores([r["text"] for r in rows]), strict=True) if s >= line_crf.THRESHOLD}
    assert {r["doc_id"] for r in kept[0].collect()} == good
    sets = {r["doc_id"]: shingles(r["text"]) for r in kept[1].collect()}
    ids = list(sets)
    assert not any(100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) for i, a in enumerate(ids) for b in ids[:i] if sets[a] and sets[b])
    assert kept[2].count() == len(ids) and not any("555-" in r["text"] for r in kept[2].collect())
    last = kept[4].collect()
    p = pieces.Pieces.load()
    assert len(last) == kept[3].count() > 0 and all(r["round_trip"] and p.decode(r["pieces"]) == r["text"] for r in last)


def test_run_gives_the_stages_rows(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    assert corpus_pipeline.run(spark, sf).count() == corpus_pipeline.run(spark, sf).count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "PII surrogates", "mix to target weights", "unigram pieces"]


def test_stages_take_odd_rows_and_empty_tables(spark, odd_docs, no_docs, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (6, 0, None), (None, 1, 1), (9, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, odd_docs, str(tmp_path))
        assert out.columns[: len(odd_docs.columns)] == odd_docs.columns
        ids = {r["doc_id"] for r in out.collect()}
        if n == 1:
            assert ids == {None, 1, 3, 4, 5, 6, 8}
        elif n == 3:
            assert ids <= {r["doc_id"] for r in odd_docs.collect()} - {3, 4, 5}  # no words, nothing to take
        elif n:
            assert out.count() == odd_docs.count()
        assert stage(spark, no_docs, str(tmp_path)).count() == 0


def test_the_private_stage_is_the_plain_version_s(spark):
    from statutegrid.llm import surrogates
    from tests.llm import plain_surrogates

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    given = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = dict(zip(given, plain_surrogates.pseudonymised(list(given.values()), surrogates.secret_key(spark)), strict=True))
    got = {r["doc_id"]: r for r in corpus_pipeline.private(spark, docs, "").collect()}
    assert {i: r["text"] for i, r in got.items()} == {i: t for i, (t, _) in want.items()}
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got.values()) and any(got[i]["text"] != t for i, t in given.items())


def test_the_private_stage_draws_a_key_on_a_cluster_that_names_none(spark, monkeypatch, tmp_path):
    from statutegrid.llm import common, surrogates

    docs = spark.createDataFrame([(1, "mail ann@web.org", 16)], "doc_id long, text string, n_chars long")
    # what a cluster's session is to this stage: no local master, no key
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(common, "shared_folder", lambda spark: str(tmp_path))
    (row,) = corpus_pipeline.private(spark, docs, "").collect()
    assert "ann@web.org" not in row["text"] and surrogates.run_key(spark) == surrogates.run_key(spark) != surrogates.QUERY_KEY
