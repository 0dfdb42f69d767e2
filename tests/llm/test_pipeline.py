"""The stages of the corpus pipeline in turn, on the smallest tables with odd rows, and on none."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from quillspark.llm.common import stored, table
from quillspark.llm.shingle_sets import shingle_set

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = table(spark, SF, "documents")
    odd = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (None, "no id here at all", None, None, None)], docs.schema)
    kept = stored(docs.union(odd).withColumn("fp", F.lit(1)).withColumn("label", F.lit("x")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        kept = stored(stage(spark, kept, SF))
        ids = [r.doc_id for r in kept.select("doc_id").collect()]
        assert tuple(kept.columns) == corpus_pipeline.COLUMNS and set(ids) <= before and len(ids) == len(set(ids)), name
        if name == "near_dedup":
            sets = [set(shingle_set(r.text, 5).tolist()) for r in kept.collect()]
            assert all(len(a & b) < 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
        elif name in ("line_dedup", "personal_data"):
            assert set(ids) == before
    assert kept.where("text LIKE '%@example.%'").isEmpty()
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF).toPandas()
    assert packed.doc_id.nunique() == len([i for i in ids if i is not None]) and packed.groupby("sequence_id").length.sum().max() <= 2048


def test_stages_on_no_rows(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table(spark, SF, "documents").limit(0), SF).count() == 0
