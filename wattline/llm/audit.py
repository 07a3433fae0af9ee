"""How the sources of a language differ in their terms.

A term is a run of ASCII letters and of characters beyond ASCII, with A-Z as a-z. The terms in at least
``LEAST_DOCS`` documents of a language are kept; a group is a source of a language. The smoothed
share of a term is ``1 + floor(10**9 * (count + 5) / (N + 5 * V))``, ``V`` being the number of kept terms
and ``N`` the group's (or language's) count over them. All numbers are integers.

*Terms of a group* are ranked by cells: terms with the same count in the group and in the language have the
same difference, so it is worked out and ranked once per cell, cells of equal value are merged, and only the cells
that reach into the first ranks are expanded into terms, in UTF-8 order. *Pairs of sources* are the
differences summed over all kept terms, in blocks of terms by sources.

Texts are counted per task before anything is shuffled, so a hot source sends each of its terms once per block.
Null texts, languages and sources are empty strings. A group without terms is a group still; a language without kept
terms has pairs of value 0. Repeated rows, and null or repeated ids, count as documents of their own. Extra columns are ignored.
An empty table gives an empty result. The sources of a language are names: a task of the second part holds a
table of sources squared, as large as its result, so it is made for some thousands of sources per language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.store import stored
from wattline.llm.text import SLICE, lowered, slices, utf8

LEAST_DOCS = 30
SMOOTHING = 5
UNIT = 1_000_000_000
TOP = 50
_BLOCK_BYTES = 24 * SLICE
_CELLS = 1 << 22
SCHEMA = "lang string, source string, part string, item string, value long, rank int"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of some texts in order, and the text each is from."""
    raw, borders = utf8(lowered(texts))
    letter = _LETTER[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[borders] = True
    before = np.concatenate(([False], letter[:-1])) & ~cut[:-1]
    after = np.concatenate((letter[1:], [False])) & ~cut[1:]
    starts = np.flatnonzero(letter & ~before)
    ends = np.flatnonzero(letter & ~after) + 1
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw[letter]))
    return terms, np.searchsorted(borders, starts, side="right") - 1


class _Counts:
    """Counts of terms per group of one block of texts."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.parts: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, texts: pa.Array, langs: list[str], sources: list[str]) -> None:
        groups = np.array([self.groups.setdefault(key, len(self.groups)) for key in zip(langs, sources, strict=True)], np.int64)
        terms, owner = _terms(texts)
        self.size += len(terms)
        if not len(terms):
            return
        coded = terms.dictionary_encode()
        n = len(coded.dictionary)
        # Once per document and term: how often, and one document.
        seen, times = np.unique(owner * n + np.asarray(coded.indices), return_counts=True)
        self.parts.append(self._merge(groups[seen // n], seen % n, times, np.ones(len(seen), np.int64), coded.dictionary))

    @staticmethod
    def _merge(group: np.ndarray, term: np.ndarray, times: np.ndarray, docs: np.ndarray, names: pa.Array):
        key = group * len(names) + term
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        kept = key[order][first]
        sums = [np.add.reduceat(x[order], first) for x in (times, docs)]
        return names.take(pa.array(kept % len(names))), kept // len(names), *sums

    def batches(self) -> Iterator[pa.RecordBatch]:
        """One row per group and term; one with an empty term per group, so that none is forgotten."""
        keys = list(self.groups)
        langs, sources = pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string())
        none = pa.array([0] * len(keys), pa.int64())
        yield pa.record_batch({"lang": langs, "source": sources, "term": pa.array([""] * len(keys), pa.string()), "n": none, "docs": none})
        if not self.parts:
            return
        coded = pa.chunked_array([p[0] for p in self.parts]).dictionary_encode().combine_chunks()
        group, times, docs = (np.concatenate([p[i] for p in self.parts]) for i in (1, 2, 3))
        names, group, times, docs = self._merge(group, np.asarray(coded.indices).astype(np.int64), times, docs, coded.dictionary)
        for low in range(0, len(names), 1 << 16):
            part = slice(low, low + (1 << 16))
            place = pa.array(group[part])
            yield pa.record_batch(
                {"lang": langs.take(place), "source": sources.take(place), "term": names[part].cast(pa.string()),
                 "n": pa.array(times[part]), "docs": pa.array(docs[part])}
            )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, waiting = _Counts(), 0
    for batch in batches:
        for a, b in slices(batch.column(0)):
            part = batch.slice(a, b - a)
            held.add(part.column(0), part.column(1).to_pylist(), part.column(2).to_pylist())
            waiting += part.column(0).nbytes
            if waiting >= _BLOCK_BYTES:
                yield from held.batches()
                held, waiting = _Counts(), 0
    yield from held.batches()


def share(count: Column, n: Column, v: Column) -> Column:
    """Smoothed share of a count, by long division in steps of 1000, so that no number outgrows 64 bits."""
    whole = (n + SMOOTHING * v).cast("long")
    rest, out = (count + SMOOTHING).cast("long"), F.lit(0).cast("long")
    div = lambda a: F.call_function("div", a, whole)
    # A count as large as the whole gives the digit 1 before the steps.
    digit = div(rest)
    out, rest = out + digit, rest - digit * whole
    for _ in range(3):
        digit = div(rest * 1000)
        out, rest = out * 1000 + digit, rest * 1000 - digit * whole
    return out + 1


def _shares(counts: np.ndarray, n: np.ndarray, v: int) -> np.ndarray:
    """The same for an array of counts (terms by groups)."""
    whole = n + SMOOTHING * v
    rest = counts + SMOOTHING
    out = rest // whole
    rest = rest - out * whole
    for _ in range(3):
        digit = rest * 1000 // whole
        out, rest = out * 1000 + digit, rest * 1000 - digit * whole
    return out + 1


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """Counts of the kept terms (``lang``, ``term``, ``source``, ``n``, ``lang_n``) and all groups with ``total`` (N), ``lang_total`` and ``terms`` (V)."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")]
    counted = docs.select(*text).mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    # One shuffle by language and term serves the sums per group and per language.
    dealt = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    over = Window.partitionBy("lang", "term")
    totals = dealt.withColumns({"lang_n": F.sum("n").over(over), "lang_docs": F.sum("docs").over(over), "first": F.row_number().over(over.orderBy("source")) == 1})
    kept = stored(totals.where((F.col("term") == "") | (F.col("lang_docs") >= least_docs)).drop("docs", "lang_docs"))
    named = F.col("term") != ""
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(named & F.col("first")).alias("own"))
    every = Window.partitionBy("lang")
    groups = groups.withColumns({"lang_total": F.sum("total").over(every), "terms": F.sum("own").over(every)}).drop("own")
    return kept.where(named).drop("first"), stored(groups)


def top_terms(kept: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """Terms that a group has more of than its language, by cells of equal counts."""
    known = kept.join(groups, ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    cells = known.groupBy("lang", "source", "n", "lang_n", "total", "lang_total", "terms").agg(F.count(F.lit(1)).alias("size"))
    cells = cells.withColumn("value", p - q).where("value > 0").select("lang", "source", "n", "lang_n", "value", "size")
    cells = stored(cells)
    # Cells of one value are merged; each has a term at least, so no rank beyond ``top`` values is reached.
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    values = cells.groupBy("lang", "source", "value").agg(F.sum("size").alias("size"))
    values = values.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    reached = values.withColumn("before", before).where(F.col("before") < top).select("lang", "source", "value")
    chosen = cells.drop("size").join(reached, ["lang", "source", "value"])
    rows = kept.join(chosen, ["lang", "source", "n", "lang_n"])
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
    ranked = rows.withColumn("rank", place).where(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def source_pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Every other source of each group's language, by the sum of differences of all kept terms."""
    listed = groups.groupBy("lang").agg(
        F.sort_array(F.collect_list(F.struct("source", "total"))).alias("groups"), F.max("terms").alias("terms")
    ).collect()  # names of sources: the root of the result's size
    known = {r["lang"]: ({g["source"]: i for i, g in enumerate(r["groups"])}, np.array([g["total"] for g in r["groups"]], np.int64), r["terms"]) for r in listed}

    def differences(batches):
        lang, sums, waiting = None, None, []

        def flush():
            names, n, v = known[lang]
            term = np.concatenate([w[0] for w in waiting])
            counts = np.zeros((int(term[-1]) + 1, len(names)), np.int64)
            counts[term, np.concatenate([w[1] for w in waiting])] = np.concatenate([w[2] for w in waiting])
            shares = np.ascontiguousarray(_shares(counts, n, v).T)
            for i in range(len(names) - 1):
                sums[i, i + 1 :] += np.abs(shares[i + 1 :] - shares[i]).sum(axis=1)

        def rows():
            size = len(sums)
            a, b = np.triu_indices(size, 1)
            for low in range(0, len(a), 1 << 16):
                i, j = a[low : low + (1 << 16)], b[low : low + (1 << 16)]
                yield pa.record_batch({"lang": pa.array([lang] * len(i), pa.string()), "a": pa.array(i, pa.int32()), "b": pa.array(j, pa.int32()), "value": pa.array(sums[i, j], pa.int64())})

        held = 0
        last = None
        for batch in batches:  # by language and term
            langs, terms = batch.column(0).dictionary_encode(), batch.column(1)
            for k, name in enumerate(langs.dictionary.to_pylist()):
                places = np.flatnonzero(np.asarray(langs.indices) == k)
                if name != lang:
                    if waiting:
                        flush()
                    if sums is not None:
                        yield from rows()
                    lang, waiting, held, last = name, [], 0, None
                    sums = np.zeros((len(known[name][0]),) * 2, np.int64)
                names = known[name][0]
                high = max(1, _CELLS // len(names))
                own = terms.take(pa.array(places)).to_pylist()
                source = np.array([names[s] for s in batch.column(2).take(pa.array(places)).to_pylist()], np.int64)
                times = np.asarray(batch.column(3))[places]
                rank = np.cumsum([t != u for t, u in zip(own, [last, *own[:-1]], strict=True)]) - 1 + held
                last = own[-1]
                start = 0
                while start < len(rank):  # whole terms, at most ``high`` at a time
                    if waiting and rank[start] >= high:
                        flush()
                        waiting = []
                        rank[start:] -= rank[start]
                    stop = int(np.searchsorted(rank, max(high, rank[start] + 1)))
                    waiting.append((rank[start:stop], source[start:stop], times[start:stop]))
                    start = stop
                held = int(rank[-1]) + 1
        if waiting:
            flush()
        if sums is not None:
            yield from rows()

    sorted_terms = kept.select("lang", "term", "source", "n").repartition("lang", "term").sortWithinPartitions("lang", "term")
    parts = sorted_terms.mapInArrow(differences, "lang string, a int, b int, value long")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    numbered = groups.select("lang", "source", place.alias("at"))
    one = numbered.withColumnsRenamed({"at": "_a"})
    other = numbered.withColumnsRenamed({"source": "item", "at": "_b"})
    pairs = one.join(other, "lang").where("_a <> _b")
    pairs = pairs.withColumns({"a": F.least("_a", "_b"), "b": F.greatest("_a", "_b")})
    valued = pairs.join(sums, ["lang", "a", "b"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return valued.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def divergence(docs: DataFrame, *, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """Both parts: sources by their distance to each source, and the terms that mark each source."""
    kept, groups = kept_terms(docs, least_docs)
    return source_pairs(kept, groups).unionByName(top_terms(kept, groups, top)).select("lang", "source", "part", "item", "value", "rank")


_SHARE = f"1 + ({UNIT}::HUGEINT * ({{n}} + {SMOOTHING})) // ({{total}} + {SMOOTHING} * V)"
ORACLE = f"""WITH docs AS (SELECT row_number() OVER () AS rid, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
terms AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_n FROM terms GROUP BY lang, term HAVING count(DISTINCT rid) >= {LEAST_DOCS}),
langs AS (SELECT lang, count(*) AS V, sum(lang_n) AS lang_N_all FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM terms GROUP BY lang, source, term),
cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.lang_n FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sized AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS N_all FROM cells),
shares AS (SELECT s.lang, source, term, n, {_SHARE.format(n="n", total="N_all")} AS p, {_SHARE.format(n="lang_n", total="lang_N_all")} AS q FROM sized s JOIN langs l ON s.lang = l.lang),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
valued AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM valued)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}"""
