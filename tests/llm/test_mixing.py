import duckdb
import pytest

from wattline.llm import mixing

import cases


def _oracle(rows):
    import pandas as pd

    db = duckdb.connect()
    table = pd.DataFrame([r[:5] for r in rows], columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64"})
    db.register("documents_", table)
    db.execute("CREATE VIEW documents AS SELECT doc_id::BIGINT AS doc_id, text, lang, source, n_chars FROM documents_")
    return sorted(map(repr, db.execute(mixing.ORACLE).fetchall()))


def test_equals_sql_on_awkward_rows(spark):
    docs = cases.frame(spark)
    got = sorted(repr(tuple(r)) for r in mixing.mix(docs).collect())
    assert got == _oracle([tuple(r) for r in docs.collect()])


def test_targets_are_met_and_capped(spark):
    texts = [" ".join(["w"] * (1 + i % 17)) for i in range(900)]
    docs = cases.frame(spark, texts).withColumn("source", mixing.F.expr("case when doc_id % 3 = 0 then 'big' when doc_id < 30 then 'tiny' when doc_id % 7 = 0 then null else 'mid' end"))
    rows = mixing.mix(docs).collect()
    by = {}
    for r in rows:
        assert r.taken <= 3 * r.size and r.target <= 3 * r.source_size + 1e-9
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) <= 17
    assert sum(t for _, t in by) == pytest.approx(sum(r.size for r in rows))


def test_rows_repeat_as_often_as_taken(spark):
    docs = cases.frame(spark)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    times = sum(r.times for r in mixing.mix(docs).collect())
    assert out.count() == times


def test_empty_and_wordless_tables(spark):
    assert mixing.mix(cases.empty(spark)).collect() == []
    assert mixing.mixed(cases.empty(spark)).collect() == []
    assert [(r.size, r.target, r.times) for r in mixing.mix(cases.frame(spark, ["", None])).collect()] == [(0, 0.0, 0)] * 2


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    docs = cases.frame(spark)
    assert mixing.mixed(docs).count() == sum(r.times for r in mixing.mix(docs).collect())
