"""The registered SQL against the queries, and the pipeline's stages against the operators' rules, on small tables."""

import datetime

import corpus_pipeline
import duckdb
import pytest
from test_decontamination import plain as contamination
from test_near_copies import plain_components
from test_quality_rules import plain as quality
from texts import SCHEMA, frame, rows

from splatspark.llm.queries import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"


def shown(value):
    return round(value, 9) if isinstance(value, float) else value.isoformat() if isinstance(value, datetime.date) else value


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_gives_the_query_rows(spark, name):
    db = duckdb.connect()
    for table in ("documents", "pages", "conversations", "benchmark"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    want = db.sql(ORACLE[name])
    got = QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    mine = sorted(repr([shown(r[c]) for c in columns]) for r in got.collect())
    assert mine == sorted(repr([shown(v) for v in r]) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_stages_one_after_another(spark, tmp_path):
    """Each stage is judged on its own input: nulls, empty and long texts, repeated rows, extra columns."""
    bench = [(1, " ".join(f"q{i}" for i in range(20)))]
    folder = str(tmp_path)
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    data = [r for r in rows() if r[0] is not None and r[0] != 10] + [(900, bench[0][1] + " " + " ".join(f"u{i}" for i in range(60)), "en", "s0", 9, "a", "b", "c"), (None, " ".join(f"n{i}" for i in range(70)), *[None] * 6)]
    data += [(901, data[-2][1] + " more", *[None] * 6)]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "simhash", "decontamination", "packing"]
    docs = frame(spark, data)
    ids = lambda x: sorted(str(d[0]) for d in x)
    now = [d for d in data if quality(d[1])[-1]]
    for name in list(stages)[:-1]:
        out = stages[name](spark, docs, folder)
        assert out.schema == docs.schema
        path = f"{folder}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        got = [tuple(r) for r in docs.collect()]
        if name == "simhash":
            least = plain_components([d for d in now if d[0] is not None])
            now = [d for d in now if d[0] is None or least[d[0]] == d[0]]
        elif name == "decontamination":
            now = [d for d in now if not contamination(d[1], bench)[-1]]
        assert ids(got) == ids(now), name
        now = got
    pieces = stages["packing"](spark, docs, folder).collect()
    assert {r.doc_id for r in pieces} == {d[0] for d in now} and "900" not in ids(now) and "None" in ids(now)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
