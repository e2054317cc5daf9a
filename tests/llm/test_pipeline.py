import shutil
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from circadia.llm import decontam, jaccard, lines, quality
from circadia.llm.queries import ORACLES, QUERIES
from circadia_checks.compare import difference

ROOT = Path(__file__).resolve().parents[2]
SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.held(stage(spark, docs, SMALL), name)
        assert docs.columns == columns, name
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= before and len(after) > 0.6 * len(before), name
        before = after
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r.doc_id for r in rows.select("doc_id").collect()} == before
    assert decontam.matches(docs, spark.read.parquet(f"{SMALL}/benchmark.parquet")).count() == 0


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, SMALL)
    sizes = rows.groupBy("sequence_id").sum("length").collect()
    assert sizes and max(r[1] for r in sizes) <= 4096


def test_stages_take_odd_and_no_documents(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.held(stage(spark, docs, SMALL), name)
        assert docs.count() >= 0


def test_every_operator_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "packing"]
    assert all((quality.filtered, lines.filtered, jaccard.one_of_each, decontam.clean))


def test_queries_equal_their_sql(spark):
    for name, sql in ORACLES.items():
        assert difference(spark, QUERIES[name], sql, SMALL) is None, name


def test_the_rest_does_without(tmp_path):
    for item in ("circadia", "circadia_checks"):
        shutil.copytree(ROOT / item, tmp_path / item, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bucket_matrix' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
