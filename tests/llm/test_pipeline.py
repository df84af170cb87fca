"""The corpus pipeline, stage by stage."""

import corpus_pipeline as cp
from graphloom.llm import decontaminate, registry


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, before = docs.columns, docs.count()
    for i, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/stage-{i}")
        docs = spark.read.parquet(path)
        if i < len(cp.STAGES) - 1:
            assert docs.columns == names and 0 < docs.count() <= before, name
            before = docs.count()
    assert {"doc_id", "sequence_id", "offset"} <= set(docs.columns)
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_run_is_the_stages_in_order(spark, sf_dir):
    got = cp.run(spark, sf_dir)
    kept = {r.doc_id for r in got.select("doc_id").distinct().collect()}
    leaks = {r.doc_id for r in decontaminate.contaminations(spark.read.parquet(f"{sf_dir}/documents.parquet").where(f"doc_id in ({','.join(map(str, kept))})"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert kept and len(leaks) <= 1  # a passage may go with its repeated lines, never come back


def test_registry():
    found = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 11)) and set(registry.oracle_sql()) <= set(found)
