"""The corpus pipeline's stages: extra columns, unlabelled tables, odd rows, and all stages in a row."""

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from telemill.llm import language, lines
from telemill.llm.staging import staged

EXTRA = ("lang_pred", "score", "n_lines", "n_dropped")


def with_extra(frame):
    """Columns of the names the stages add, with values of their own."""
    return frame.withColumns(
        {"lang_pred": F.lit("x"), "score": F.lit(1.5), "n_lines": F.lit(7).cast("long"), "n_dropped": F.lit(9).cast("long")}
    )


def ids(frame):
    return sorted((r[0] for r in frame.select("doc_id").collect()), key=lambda x: (x is None, x))


def test_language_stage_keeps_clashing_columns(spark, documents):
    extra = with_extra(documents)
    kept = pipeline.known_language(spark, extra, "")
    assert kept.columns == extra.columns
    texts = language.training_text(documents, F.lit(True))
    plain = language.predict(documents, texts).where(F.col("lang_pred") != language.UNKNOWN)
    assert ids(kept) == ids(plain)
    assert {tuple(r) for r in kept.select(*EXTRA).distinct().collect()} == {("x", 1.5, 7, 9)}


def test_language_stage_without_labels_keeps_texts_with_letters(spark, documents):
    unlabelled = documents.withColumn("lang", F.lit(None).cast("string"))
    kept = pipeline.known_language(spark, unlabelled, "")
    lettered = [r.doc_id for r in documents.collect() if r.text and any(c.isalpha() for c in r.text)]
    assert ids(kept) == sorted(lettered)


def test_lines_stage_keeps_clashing_columns(spark, documents):
    extra = with_extra(documents)
    kept = pipeline.fresh_lines(spark, extra, "")
    assert kept.columns == extra.columns
    plain = {(r.doc_id, r.text) for r in lines.dropped(documents).collect()}
    assert {(r.doc_id, r.text) for r in kept.collect()} == plain
    assert {tuple(r) for r in kept.select(*EXTRA).distinct().collect()} == {("x", 1.5, 7, 9)}


def test_all_stages_run_on_odd_rows(spark, documents, empty):
    for start in (documents, empty):
        docs = start
        for name, stage in pipeline.STAGES[:-1]:
            docs = staged(stage(spark, docs, ""), f"test-{name.replace(' ', '-')}")
            assert set(start.columns) <= set(docs.columns), name
        tokens = pipeline.STAGES[-1][1](spark, docs, "")
        assert tokens.count() == docs.count()
