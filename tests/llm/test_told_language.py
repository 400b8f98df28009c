"""The pipeline's first stage: prediction and evidence in one pass."""

import numpy as np

import corpus_pipeline
from driftwood.llm import language

NONE = {"langs": [], "words": {}, "grams": {}}
MODEL = {"langs": ["x", "y"], "words": {"haus": np.array([-1.0, -9.0])}, "grams": {"ou": np.array([-9.0, -1.0])}}
TEXTS = ["Haus", "house", "zzz", "", None, "12 ?", "zzz haus", "HAUS 1", "ou", "o", "Haus"]


def test_same_rows_as_one_after_the_other(spark):
    docs = spark.createDataFrame([(i // 2 if i % 5 else None, t, i) for i, t in enumerate(TEXTS)],
                                 "doc_id long, text string, extra int")
    for model in (MODEL, NONE):
        want = language.with_evidence(language.with_language(docs, model), model).collect()
        got = language.with_told_language(docs, model)
        assert got.schema == docs.schema
        assert sorted(got.collect(), key=lambda r: r.extra) == sorted(want, key=lambda r: r.extra)


def test_stage_has_one_python_step(spark):
    docs = spark.createDataFrame([(i, t, "x", "s", 4) for i, t in enumerate(TEXTS)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    plan = corpus_pipeline.keep_known_languages(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
