"""Each stage on its own input, and the whole."""

import corpus_pipeline
from sizewise.llm.common import table


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "benchmark_decontamination", "mixing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert 0 < out.count() <= docs.count()
        assert out.join(docs.select("doc_id"), "doc_id", "left_anti").count() == 0
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name


def test_insults_go_and_clean_documents_stay(spark):
    """On the given labels of a larger table, of which the stage itself may learn; held-out labels are in test_toxicity."""
    folder = "/root/testdata/sf0.1"
    docs = table(spark, folder, "documents")
    left = {r.doc_id for r in corpus_pipeline.toxicity(spark, docs, folder).select("doc_id").collect()}
    labels = table(spark, folder, "labels").where("quality = 1").collect()
    toxic, clean = ({r.doc_id for r in labels if r.toxic == k} for k in (1, 0))
    assert len(toxic & left) <= 0.05 * len(toxic)
    assert len(clean - left) <= 0.01 * len(clean)


def test_odd_documents_pass_through(spark, sf_dir):
    rows = [(1, None, 5, "a"), (1, "two rows of one id", 5, "b"), (None, "no id\nline\nline", 7, "c"), (3, "", 0, None), (3, "", 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rejected int, source string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        if name != "near_dedup":
            assert sorted(out.collect(), key=repr) == sorted(docs.collect(), key=repr), name
    assert corpus_pipeline.mixing(spark, docs, sf_dir).columns == [*docs.columns, "copy", "shuffle_key"]


def test_line_dedup_sets_the_length(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = corpus_pipeline.line_dedup(spark, docs, sf_dir)
    assert out.count() == docs.count()
    assert out.where("n_chars <> length(text)").join(docs.where("n_chars <> length(text)"), "doc_id", "left_anti").count() == 0


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert set(out.columns) == {*table(spark, sf_dir, "documents").columns, "copy", "shuffle_key"}
    assert out.count() > 0


def test_near_duplicates_leave_without_a_broadcast(spark, sf_dir):
    out = corpus_pipeline.near_dedup(spark, table(spark, sf_dir, "documents"), sf_dir)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "Broadcast" not in plan
