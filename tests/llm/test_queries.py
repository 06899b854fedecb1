import importlib

import pytest
from pyspark.sql import functions as F

from cliploom.llm.queries import ORACLES, QUERIES
from tests import oracle

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    n, problem, drift = oracle.compare(spark, oracle.connect(FOLDER), FOLDER, QUERIES[name], ORACLES[name])
    assert n > 0 and problem is None and not drift


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_covers_its_table(spark, name):
    table, key = ("pages", "page_id") if name == "op5_page_text" else ("documents", "doc_id")
    found = QUERIES[name](spark, FOLDER).select(key).distinct()
    every = spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key).distinct()
    assert found.exceptAll(every).count() == 0 and every.exceptAll(found).count() == 0


def test_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    passage = " ".join(f"bench{i}" for i in range(14))
    long = " ".join(f"word{i}" for i in range(200))
    line = "a line of some length that many documents have in common"
    docs = [(i, f"text number {i} of its own kind, t{i * 7} u{i * 11}\n{line}\nend {i}", "en", "s", 5) for i in range(40)]
    docs += [(50, long, "en", "s", 1), (51, long, "en", "s", 1), (52, long.replace("word9 ", "xx "), "en", "s", 1),
             (60, f"before {passage} after", "en", "s", 1), (70, None, None, None, None), (71, "", "en", "s", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(pipeline.STAGES)
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "near-duplicate removal", "decontamination", "packing"]
    lines = stage["line dedup"](spark, df, FOLDER)
    assert lines.columns == df.columns and lines.count() == len(docs)
    assert lines.where(lines.text.contains(line)).count() == 1
    single = stage["near-duplicate removal"](spark, df, FOLDER)
    kept = {r["doc_id"] for r in single.collect()}
    assert single.columns == df.columns and {50, 60, 70} <= kept and not kept & {51, 71}
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    import tempfile

    folder = tempfile.mkdtemp(prefix="run-")
    items.write.parquet(f"{folder}/benchmark.parquet")
    clean = stage["decontamination"](spark, df, folder)
    assert clean.columns == df.columns and {r["doc_id"] for r in clean.collect()} == {r[0] for r in docs} - {60}
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert stage["toxicity"](spark, df, folder).count() == len(docs)


def test_pipeline_stages_keep_columns_of_the_operators_names(spark):
    stage = dict(importlib.import_module("corpus_pipeline").STAGES)
    line = "a line of some length that many documents have in common"
    rows = [(i, f"text {i}\n{line}", 7.5, 99, -1, "mark", 60) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, n_lines int, n_dropped int, text_key string, n_chars long")
    cut = stage["line dedup"](spark, df, FOLDER)
    assert cut.columns == df.columns and cut.select(df.columns[2:-1]).distinct().collect() == [(7.5, 99, -1, "mark")]
    assert cut.agg(F.count_distinct("n_chars")).first()[0] == 2
    scored = stage["toxicity"](spark, df, FOLDER)
    assert scored.columns == df.columns and scored.select(df.columns[2:]).distinct().collect() == [(7.5, 99, -1, "mark", 60)]
    for name in ("near-duplicate removal", "decontamination"):
        kept = stage[name](spark, df, FOLDER)
        assert kept.columns == df.columns and kept.select(df.columns[2:]).distinct().count() <= 1


def test_pipeline_runs(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    out = pipeline.run(spark, FOLDER)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)
