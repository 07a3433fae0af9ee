import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from cases import empty, frame
from pyspark.sql import functions as F

from wattline.llm import audit
from wattline.llm.queries import ORACLES, QUERIES

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least, top=50):
    """Rows are (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [[re.sub("[A-Z]", lambda c: c[0].lower(), t) for t in TERM.findall(r[0])] for r in rows]
    out = []
    for lang in {r[1] for r in rows}:
        docs, counts = Counter(), defaultdict(Counter)
        for found, (_, own, source) in zip(terms, rows, strict=True):
            if own == lang:
                docs.update(set(found))
                counts[source].update(found)
        kept = [t for t, n in docs.items() if n >= least]
        whole = Counter({t: sum(c[t] for c in counts.values()) for t in kept})

        def shares(count):
            total = sum(count[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 5) // total for t in kept}

        q = shares(whole)
        for s in counts:
            p = shares(counts[s])
            pairs = [(-sum(abs(p[t] - o[t]) for t in kept), x) for x, o in ((x, shares(counts[x])) for x in counts if x != s)]
            own = [(q[t] - p[t], t) for t in kept if counts[s][t] and p[t] > q[t]]
            for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(own, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, -value, k) for k, (value, item) in enumerate(found, 1)]
    return sorted(out)


def made(n=400):
    rng = np.random.default_rng(8)
    words = [f"{a}{b}" for a in ("Ab", "bé", "漢", "cd", "ÜX", "zz🙂") for b in "abcdefghij"]
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else f"s{rng.integers(7)}"
        text = " ".join(words[int(k)] for k in np.minimum(rng.geometric(0.04 + 0.01 * (i % 5), 30) - 1, len(words) - 1))
        rows.append((text.replace(" ", "1_ ", 3), ("en", "de", None)[i % 7 % 3], source))
    return rows + [("", "en", "silent"), (None, "xx", "only"), ("1 2 3", "yy", "a"), ("lonely words", "yy", None), rows[0], rows[0]]


def frame_of(spark, rows):
    return spark.createDataFrame([(k, *r, 1, "x", 5) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n long, term string, value int")


def result(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("least", [1, 5, 30])
def test_equals_a_plain_version(spark, least):
    rows = made()
    assert result(audit.divergence(frame_of(spark, rows), least_docs=least)) == plain(rows, least)


def test_small_blocks_and_cells(spark, monkeypatch):
    monkeypatch.setattr(audit, "_CELLS", 50)  # of closures sent to the tasks
    rows = made(200)
    assert result(audit.divergence(frame_of(spark, rows).repartition(5), least_docs=3)) == plain(rows, 3)
    held = audit._Counts()
    part = frame_of(spark, rows).toArrow()
    for low in range(0, len(rows), 7):
        block = part.slice(low, 7)
        texts = block.column("text").combine_chunks()
        held.add(texts, *[["" if v is None else v for v in block.column(c).to_pylist()] for c in ("lang", "source")])
    got = Counter()
    for batch in held.batches():
        for r in batch.to_pylist():
            got[r["lang"], r["source"], r["term"]] += r["n"]
    want = Counter((lang or "", s or "", re.sub("[A-Z]", lambda c: c[0].lower(), t)) for text, lang, s in rows for t in TERM.findall(text or ""))
    assert {k: v for k, v in got.items() if k[2]} == dict(want)


def test_ties_are_cut_in_utf8_order(spark):
    terms = [f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["é", "zz", "漢"]
    rows = [(" ".join(terms), "en", "a")] * 3 + [("other " * 50, "en", "b")] * 3
    got = audit.divergence(frame_of(spark, rows), least_docs=2)
    assert result(got) == plain(rows, 2)
    assert got.where("part = 'term' AND source = 'a'").count() == 50


def test_nulls_repeats_clashing_columns_and_no_rows(spark):
    docs = frame(spark)
    rows = [tuple(r) for r in docs.select("text", "lang", "source").collect()]
    assert result(audit.divergence(docs, least_docs=2)) == plain(rows, 2)
    assert audit.divergence(empty(spark)).collect() == []


def test_shares_with_large_counts(spark):
    counts = [0, 1, 10**6, 10**14, 3 * 10**15 - 7]
    total, terms = 3 * 10**15, 10**6
    want = [1 + 10**9 * (c + 5) // (total + 5 * terms) for c in counts]
    df = spark.createDataFrame([(c, total, terms) for c in counts], "c long, t long, v long")
    assert [r[0] for r in df.select(audit.share(F.col("c"), F.col("t"), F.col("v"))).collect()] == want
    assert audit._shares(np.array(counts), np.array([total]), terms).tolist() == want
    assert audit._shares(np.array([7]), np.array([7]), 1).tolist() == [1 + 10**9]


def test_query_equals_sql(spark, sf_dir):
    got = QUERIES["op11_source_audit"](spark, sf_dir)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES['op11_source_audit']})").fetchall()
    assert result(got) == sorted(want)
