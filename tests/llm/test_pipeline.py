"""The pipeline against plain Python over its stages' contracts."""

import collections

import corpus_pipeline
from quillstrata.llm import mixing, sql
from tests.llm.conftest import SPACE
from tests.llm.test_joins import components, contamination
from tests.llm.test_rowwise import jump


def test_stages_match_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    named = {i: c for i, _, c in components(rows, 5, 4, 5)}
    rows = [r for r in rows if named[r[0]] == r[0]]
    clean = {r[0] for r in contamination(rows, items) if not r[5]}
    rows = [r for r in rows if r[0] in clean]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    times = {r["doc_id"]: int(r["taken"] / max(r["size"], 1) + 0.5) for r in mixed}
    got = corpus_pipeline.run(spark, sf).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter({i: n for i, n in times.items() if n})
    assert all(r["shard"] == jump(r["doc_id"], 8) for r in got)
    for s in range(8):
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == list(range(len(own)))
    assert sum(len(SPACE.findall(t)) * times[i] for i, t, _ in rows) > 0


def test_every_stage_takes_odd_and_empty_tables(spark, docs, empty, sf):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name
        assert stage(spark, empty, sf).collect() == [], name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_sql_names_queries():
    from quillstrata.llm import queries

    assert set(sql.ORACLE) <= set(queries.QUERIES)
