"""Mixing sources to target weights by hash-threshold histograms.

Each document has a fixed place between 0 and 2**60. A source takes all its documents some
whole number of times, and once more those whose place lies under a threshold. The
threshold comes from a histogram of words by place; only the bucket that holds the border is
refined, three times in all. Nothing is sorted, and the filter is a comparison.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.store import stored

WORD = r"[^\x20\x09-\x0D]+"
CYCLE = (1, 2, 3)
MOST = 3
LEVELS = 3
_BITS = 10
_PLACE_BITS = 60
_SALTS = 32
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(id_col: Column) -> Column:
    """60 bits of a hash of the id; rows without an id share one place."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """A source name that is never null: code points keep their order, null comes last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def _cycle(cycle: Sequence[int], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(w)) for w in cycle]), (F.pmod(number - 1, F.lit(len(cycle))) + 1).cast("int"))


def targets(sources: DataFrame, cycle: Sequence[int] = CYCLE, most: int = MOST) -> DataFrame:
    """``key, source_size`` with each source's ``target``.

    Sources by name weigh ``cycle``, repeating, and share the words of all. A target ends at
    ``most`` times the source's size; the excess goes to the others by weight. Sources are
    ranked by how soon they fill up, and the first that doesn't fill sets the level for it and all after it.
    One row per source goes through these windows, never a document.
    """
    named = Window.orderBy("key")
    filling = Window.orderBy("fill", "key")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    weighed = sources.withColumn("w", _cycle(cycle, F.row_number().over(named)))
    weighed = weighed.withColumn("fill", F.col("source_size").cast("double") * most / F.col("w"))
    state = weighed.select(
        "*",
        (F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))).cast("double").alias("left"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))).cast("double").alias("weights"),
        F.row_number().over(filling).alias("rank"),
    )
    level = F.when(F.col("left") / F.col("weights") <= F.col("fill"), F.struct("rank", "left", "weights"))
    state = state.withColumn("level", F.min(level).over(everything))
    full = F.col("level").isNull() | (F.col("rank") < F.col("level.rank"))
    capped = (F.col("source_size") * most).cast("double")
    return state.select("key", "source_size", F.when(full, capped).otherwise(F.col("level.left") * F.col("w") / F.col("level.weights")).alias("target"))


def _salted(rows: DataFrame, small: DataFrame) -> DataFrame:
    """``rows`` with the columns of their source; a hot source is spread over salts."""
    dealt = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.col("place"), F.lit(_SALTS)).cast("int")).join(dealt, ["key", "salt"]).drop("salt")


def thresholds(sized: DataFrame, cycle: Sequence[int] = CYCLE, most: int = MOST) -> DataFrame:
    """Per source: ``key, source_size, target, whole, below``.

    ``sized`` has ``key, place, size``. A document is taken ``whole`` times, and once more if
    its place, without the bits beyond the last level, is less than ``below``.
    """
    wanted = targets(sized.groupBy("key").agg(F.sum("size").alias("source_size")), cycle, most)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("long")
    state = wanted.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    state = stored(state.withColumns({"prefix": F.lit(0).cast("long"), "base": F.lit(0).cast("long"), "border": F.lit(None).cast("long")}))
    names = state.columns
    for level in range(1, LEVELS + 1):
        bucket = F.shiftright("place", _PLACE_BITS - level * _BITS)
        inside = _salted(sized, state.select("key", "prefix")).where(F.shiftright(bucket, _BITS) == F.col("prefix"))
        histogram = inside.groupBy("key", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        summed = histogram.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0))).join(state, "key")
        over = F.col("base") + F.col("before") + F.col("words") > F.col("rest")
        hit = summed.where(over).groupBy("key").agg(F.min(F.struct("bucket", "before", "words")).alias("hit"))
        # Without a border bucket (nothing left to refine, or everything fits) a source keeps its state.
        state = stored(
            state.join(hit, "key", "left").select(
                *[c for c in names if c not in ("prefix", "base", "border")],
                F.coalesce("hit.bucket", F.shiftleft("prefix", _BITS)).alias("prefix"),
                (F.col("base") + F.coalesce("hit.before", F.lit(0))).alias("base"),
                F.col("hit.words").alias("border"),
            )
        )
    nearer = F.col("base") + F.col("border") - F.col("rest") < F.col("rest") - F.col("base")
    below = F.col("prefix") + F.when(nearer, 1).otherwise(0)
    return state.select("key", "source_size", "target", "whole", below.alias("below"))


def _times() -> Column:
    under = F.shiftright("place", _PLACE_BITS - LEVELS * _BITS) < F.col("below")
    return F.col("whole") + F.when(under, 1).otherwise(0)


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return stored(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            source_key(F.col(source_col).cast("string")).alias("key"),
            place(F.col(id_col)).alias("place"),
            word_count(F.col(text_col)).alias("size"),
        )
    )


def mix(
    docs: DataFrame, cycle: Sequence[int] = CYCLE, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, size, source_size, target, taken`` and ``times``.

    ``size`` counts words (null and empty texts: 0), ``taken`` is ``times`` that. The taken
    words of a source differ from its target by less than the words of one document, or of
    those that share a place to 30 bits, as repeated ids do. Null is a source of its own,
    after all names. The same input always gives the same mix.
    """
    sized = _sized(docs, id_col, text_col, source_col)
    found = _salted(sized, thresholds(sized, cycle, most)).withColumn("times", _times())
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times")


def mixed(
    docs: DataFrame, cycle: Sequence[int] = CYCLE, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """``docs`` as mixed: each row as many times as it is taken."""
    small = stored(thresholds(_sized(docs, id_col, text_col, source_col), cycle, most).select("key", "whole", "below"))
    if small.count() <= BROADCAST_SOURCES:
        small = F.broadcast(small)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, source_key(F.col(source_col).cast("string")).alias("key"), place(F.col(id_col)).alias("place"))
    taken = _salted(rows, small).withColumn("times", _times()).where("times > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).select("row.*")


ORACLE = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS place,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
weighed AS (SELECT key, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY key) - 1) % 3 AS w FROM sized GROUP BY key),
filling AS (SELECT *, CAST(source_size AS DOUBLE) * 3 / w AS fill FROM weighed),
state AS (SELECT *,
    CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0) AS DOUBLE) AS left_over,
    CAST(sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS DOUBLE) AS weights,
    row_number() OVER (ORDER BY fill, key) AS rank
  FROM filling WINDOW before AS (ORDER BY fill, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT min(rank) AS rank FROM state WHERE left_over / weights <= fill),
wanted AS (SELECT s.key, s.source_size,
    CASE WHEN l.rank IS NULL OR s.rank < l.rank THEN CAST(3 * s.source_size AS DOUBLE) ELSE t.left_over * s.w / t.weights END AS target
  FROM state s CROSS JOIN level l LEFT JOIN state t ON t.rank = l.rank),
whole AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(least(floor(target / source_size), 3) AS BIGINT) ELSE 0 END AS whole FROM wanted),
rest AS (SELECT *, target - whole * source_size AS rest FROM whole),
places AS (SELECT key, place >> 30 AS spot, sum(size) AS words FROM sized GROUP BY ALL),
running AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY key ORDER BY spot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM places),
border AS (SELECT key, min(spot) AS spot FROM running JOIN rest USING (key) WHERE before + words > rest GROUP BY key),
chosen AS (SELECT r.key, CASE WHEN before + words - rest < rest - before THEN r.spot + 1 ELSE r.spot END AS below
  FROM running r JOIN border b ON r.key = b.key AND r.spot = b.spot JOIN rest t ON t.key = r.key)
SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN place >> 30 < below THEN 1 ELSE 0 END) AS taken,
  whole + CASE WHEN place >> 30 < below THEN 1 ELSE 0 END AS times
FROM sized JOIN rest USING (key) LEFT JOIN chosen USING (key)
"""
