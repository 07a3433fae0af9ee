"""Secrets in texts: fixed patterns, and character Markov models for those without a pattern.

Two models of first order over the characters of tokens, one of random strings and one of ordinary
identifiers, are trained from labelled samples; a token of 16 characters or more whose log-likelihood
ratio reaches ``MARGIN`` is a span of kind ``random`` unless it overlaps a span of a pattern, which always stays.
Random samples are the values that the patterns find, and the digests of ``DIGESTS`` numbers in hexadecimal and
base 64; ordinary ones are the other tokens. Samples come from about ``SAMPLE`` documents, chosen by a hash of
their id (of the text where there is no id); different tokens count once. Weights are whole
ten-thousandths, so that sums don't depend on their order.

Only DataFrame functions are used. Positions are running sums of the lengths of matches and of the
texts between them, in blocks, so that a text with very many matches stays affordable.

Null texts are empty; an empty text has no spans. Null or repeated ids are rows like any
other, and extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents that give samples, on average.
SAMPLE = 2000
#: Numbers whose digests are samples of random strings.
DIGESTS = 1000
#: Least log-likelihood ratio of a random string.
MARGIN = 12.0
_SCALE = 10_000
_SMOOTHING = 0.5
_BLOCK = 256

# Kinds in the order of their listing, patterns and least lengths.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "random")
_NAMES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in n) for n in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
LEAST_ASSIGNED = 8
# A run of one class of characters is as long as it can be, so its least length may stand in the pattern.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
TOKEN = "[A-Za-z0-9+/_=-]"
SUSPECT = TOKEN + "{16,}"
SYMBOLS = 67
# Codes: characters from '+' to 'z' are 1 to 80, the start of a token is 0.
_FIRST = ord("+") - 1
_STATES = ord("z") - _FIRST + 1


# A look at the first letter rules most places out before the names are tried.
_QUICK = {ASSIGN: "(?=[AaPpSsTt])" + ASSIGN}


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(_QUICK.get(pattern, pattern)), F.lit(group))


def _steps(text: Column, matches: Column, pattern: str) -> Column:
    """From the end of each match to that of the next, in code points; null where there are none.

    Kept as a column of its own: expressions inside a lambda function are evaluated at every call.
    """
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    return F.when(F.size(matches) > 0, F.zip_with(gaps, matches, lambda gap, m: F.length(gap) + F.length(m)))


def _ends(steps: Column) -> Column:
    """Running sums, made in blocks: an array grows by copying it."""

    def block(done: Column, b: Column) -> Column:
        last = F.element_at(F.element_at(done, -1), -1)
        rest = F.slice(steps, b * _BLOCK + 2, F.lit(_BLOCK - 1))
        inner = F.aggregate(rest, F.array(last + F.get(steps, b * _BLOCK)), lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + s)))
        return F.concat(done, F.array(inner))

    blocks = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _BLOCK).cast("int"))
    running = F.aggregate(blocks, F.array(F.array(F.lit(0))), block)
    return F.flatten(F.slice(running, F.lit(2), F.size(blocks)))


def _spans(rank: int, ends: Column, matches: Column) -> Column:
    return F.zip_with(ends, matches, lambda e, m: F.struct((e - F.length(m)).alias("start"), F.lit(rank).alias("rank"), e.alias("end")))


_NONE = "array<struct<start:int,rank:int,end:int>>"


def _where_any(matches: Column, spans: Column) -> Column:
    """``spans`` where there are matches: most texts have none and aren't looked at again."""
    return F.when(F.size(matches) > 0, spans).otherwise(F.array().cast(_NONE)).cast(_NONE)


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (with a ``text`` that isn't null) and ``_base``, the spans of all patterns by start and kind."""
    text = F.col("text")
    patterns = dict(zip(BASE_KINDS, (ASSIGN, ACCESS, HEX), strict=True))
    found = docs.withColumns({f"_{k}": _all(text, p) for k, p in patterns.items()})
    found = found.withColumns({f"_{k}_steps": _steps(text, F.col(f"_{k}"), p) for k, p in patterns.items()})
    kinds = []
    for rank, kind in enumerate(BASE_KINDS):
        matches = F.col(f"_{kind}")
        spans = _spans(rank, _ends(F.col(f"_{kind}_steps")), matches)
        if kind == "assign":
            pairs = F.arrays_zip(spans.alias("span"), _all(text, ASSIGN, 1).alias("value"))
            long = F.filter(pairs, lambda p: F.length(p["value"]) >= LEAST_ASSIGNED)
            spans = F.transform(long, lambda p: p["span"])
        kinds.append(_where_any(matches, spans))
    return found.withColumn("_base", F.array_sort(F.concat(*kinds))).select(*docs.columns, "_base")


def _text_of(docs: DataFrame, id: str) -> DataFrame:
    return docs.select(F.col(id).cast("long").alias(id), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def labelled_tokens(docs: DataFrame, *, id: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """Different ``token`` of the sampled documents and whether each is ``random``."""
    rows = _text_of(docs, id)
    total = rows.count()
    key = F.col(id).cast("string")
    if total > sample:
        chosen = F.substring(F.md5(F.coalesce(key, F.col("text"))), 1, 8) < F.lit(f"{sample * 2**32 // total:08x}")
        rows = rows.where(chosen)
    text = F.col("text")
    number = F.col("id").cast("string")
    digests = rows.sparkSession.range(DIGESTS).select(
        F.lit(True).alias("random"), F.explode(F.array(F.sha1(number), F.base64(F.unhex(F.sha2(number, 256))))).alias("token")
    )
    assigned = F.filter(_all(text, ASSIGN, 1), lambda v: F.length(v) >= LEAST_ASSIGNED)
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, ASSIGN, " "), ACCESS, " "), HEX, " ")
    samples = F.array(
        F.struct(F.lit(True).alias("random"), F.concat(assigned, _all(text, ACCESS), _all(text, HEX)).alias("tokens")),
        F.struct(F.lit(False).alias("random"), _all(rest, TOKEN + "{3,}").alias("tokens")),
    )
    found = rows.select(F.inline(samples)).select("random", F.explode("tokens").alias("token"))
    return found.unionByName(digests).distinct()


def train(tokens: DataFrame) -> list[int]:
    """Weights of all pairs of states, ten-thousandths of a log-likelihood ratio.

    Counts are smoothed by a half; both models have the 67 characters of a token.
    """
    # A dot can be part of an assigned value, but is in no token that is scored.
    kept = F.filter(F.split("token", ""), lambda c: c.rlike(TOKEN))
    codes = F.transform(kept, lambda c: F.ascii(c) - _FIRST)
    pairs = F.transform(F.arrays_zip(F.concat(F.array(F.lit(0)), codes).alias("a"), codes.alias("b")), lambda p: p["a"] * _STATES + p["b"])
    counts = tokens.select("random", F.explode(pairs).alias("pair")).where("pair IS NOT NULL").groupBy("pair").agg(
        F.count_if("random").alias("r"), F.count_if(~F.col("random")).alias("o")
    )
    grid = tokens.sparkSession.range(_STATES * _STATES).select(F.col("id").cast("int").alias("pair"))
    full = grid.join(counts, "pair", "left").fillna(0).withColumn("a", F.floor(F.col("pair") / _STATES))
    sums = counts.groupBy(F.floor(F.col("pair") / _STATES).alias("a")).agg(F.sum("r").alias("r_all"), F.sum("o").alias("o_all"))
    share = lambda n, total: F.log((F.col(n) + _SMOOTHING) / (F.col(total) + _SMOOTHING * SYMBOLS))
    weighed = full.join(sums, "a", "left").fillna(0)
    weight = F.round(_SCALE * (share("r", "r_all") - share("o", "o_all"))).cast("int")
    return [r["w"] for r in weighed.select("pair", weight.alias("w")).orderBy("pair").collect()]  # states squared


def _ratio(token: Column, weights: Column) -> Column:
    """Log-likelihood ratio of a token, in ten-thousandths."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("sum"))
    step = lambda a, c: F.struct(
        (F.ascii(c) - _FIRST).alias("at"), (a["sum"] + F.get(weights, a["at"] * _STATES + F.ascii(c) - _FIRST)).alias("sum")
    )
    return F.aggregate(F.split(token, ""), start, step, lambda a: a["sum"])


def _blocks(base: Column) -> Column:
    """``base`` in blocks, with the places that each covers; null if it is empty."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(base) - 1) / _BLOCK).cast("int")),
        lambda b: F.slice(base, b * _BLOCK + 1, F.lit(_BLOCK)),
    )
    ends = lambda s: F.array_max(F.transform(s, lambda x: x["end"]))
    ranged = F.transform(blocks, lambda s: F.struct(s[0]["start"].alias("low"), ends(s).alias("high"), s.alias("spans")))
    return F.when(F.size(base) > 0, ranged)


def _apart(spans: Column, blocks: Column) -> Column:
    """The spans that overlap none of the pattern spans."""
    inside = lambda x, low, high: (low < x["end"]) & (x["start"] < high)
    meets = lambda x: F.exists(blocks, lambda b: inside(x, b["low"], b["high"]) & F.exists(
        b["spans"], lambda y: inside(x, y["start"], y["end"])))
    return F.when(blocks.isNull(), spans).otherwise(F.filter(spans, lambda x: ~meets(x)))


def _count(spans: str, rank: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")


def _listed(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, weights: list[int], *, id: str = "doc_id", margin: float = MARGIN) -> DataFrame:
    """Spans of all kinds of every document: counts, digest of the pattern spans, and the list."""
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")
    # A token around a key or a hexadecimal run overlaps its span.
    likely = lambda t: ~t.rlike(f"{ACCESS}|{HEX}") & (_ratio(t, table) >= int(margin * _SCALE))
    found = base_spans(_text_of(docs, id)).withColumn("_tokens", _all(F.col("text"), SUSPECT))
    found = found.withColumn("_likely", F.transform("_tokens", likely))
    any_likely = F.exists("_likely", lambda x: x)
    found = found.withColumns(
        {"_steps": F.when(any_likely, _steps(F.col("text"), F.col("_tokens"), SUSPECT)), "_blocks": F.when(any_likely, _blocks(F.col("_base")))}
    )
    spans = _spans(KINDS.index("random"), _ends(F.col("_steps")), F.col("_tokens"))
    chosen = F.filter(F.arrays_zip(spans.alias("span"), F.col("_likely").alias("likely")), lambda p: p["likely"])
    random = F.when(F.col("_steps").isNotNull(), F.transform(chosen, lambda p: p["span"])).otherwise(F.array().cast(_NONE))
    found = found.withColumn("_random", random.cast(_NONE)).withColumn("_random", _apart(F.col("_random"), F.col("_blocks")))
    return found.select(
        id,
        *[_count("_base", rank).alias(f"n_{kind}") for rank, kind in enumerate(BASE_KINDS)],
        F.size("_random").cast("long").alias("n_random"),
        F.sha2(_listed(F.col("_base")), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("_base", "_random"))).alias("spans"),
    )


def find(docs: DataFrame, *, id: str = "doc_id", sample: int = SAMPLE, margin: float = MARGIN) -> DataFrame:
    """Train on a sample of ``docs`` and scan all of them."""
    return scan(docs, train(labelled_tokens(docs, id=id, sample=sample)), id=id, margin=margin)


def _sql_hits(kind: str, rank: int, pattern: str, group: int = 0) -> str:
    text = pattern.replace("'", "''")
    return f"""SELECT rid, {rank} AS rank, unnest(ms) AS m, unnest(vs) AS v, unnest(parts[1:len(ms)]) AS part, unnest(range(1, len(ms) + 1)) AS i
  FROM (SELECT rid, regexp_extract_all(text, '{text}', 0) AS ms, regexp_extract_all(text, '{text}', {group}) AS vs, string_split_regex(text, '{text}') AS parts FROM docs)"""


def oracle() -> str:
    a, k, h = (p.replace("'", "''") for p in (ASSIGN, ACCESS, HEX))
    names = ", ".join(f"'{n}'" for n in KINDS)
    listed = f"string_agg([{names}][rank + 1] || ':' || s || ':' || e, ',' ORDER BY s, rank, e)"
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
matches AS ({_sql_hits("assign", 0, ASSIGN, 1)} UNION ALL {_sql_hits("access", 1, ACCESS)} UNION ALL {_sql_hits("hex", 2, HEX)} UNION ALL {_sql_hits("random", 3, SUSPECT)}),
places AS (SELECT rid, rank, m, v, i, e - length(m) AS s, e FROM (
  SELECT *, CAST(sum(length(part) + length(m)) OVER (PARTITION BY rid, rank ORDER BY i) AS BIGINT) AS e FROM matches)),
base AS (SELECT rid, rank, s, e FROM places WHERE rank BETWEEN 1 AND 2 OR (rank = 0 AND length(v) >= {LEAST_ASSIGNED})),
numbers AS (SELECT CAST(unnest(range({DIGESTS})) AS VARCHAR) AS number),
sampled AS (SELECT text FROM docs, (SELECT count(*) AS total FROM docs)
  WHERE total <= {SAMPLE} OR substr(md5(coalesce(CAST(doc_id AS VARCHAR), text)), 1, 8) < printf('%08x', {SAMPLE * 2**32} // total)),
tokens AS (
  SELECT true AS random, unnest(list_filter(regexp_extract_all(text, '{a}', 1), lambda v: length(v) >= {LEAST_ASSIGNED})) AS token FROM sampled
  UNION SELECT true, unnest(regexp_extract_all(text, '{k}')) FROM sampled
  UNION SELECT true, unnest(regexp_extract_all(text, '{h}')) FROM sampled
  UNION SELECT true, unnest([sha1(number), to_base64(unhex(sha256(number)))]) FROM numbers
  UNION SELECT false, unnest(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(text, '{a}', ' ', 'g'), '{k}', ' ', 'g'), '{h}', ' ', 'g'), '{TOKEN}{{3,}}')) FROM sampled),
codes AS (SELECT random, [0] || list_transform(string_split(replace(token, '.', ''), ''), lambda c: ascii(c) - {_FIRST}) AS c FROM tokens WHERE replace(token, '.', '') <> ''),
pairs AS (SELECT random, unnest(list_transform(range(1, len(c)), lambda i: c[i] * {_STATES} + c[i + 1])) AS pair FROM codes),
counts AS (SELECT pair, pair // {_STATES} AS a, count(*) FILTER (random) AS r, count(*) FILTER (NOT random) AS o FROM pairs GROUP BY pair),
sums AS (SELECT a, sum(r) AS r_all, sum(o) AS o_all FROM counts GROUP BY a),
weights AS (SELECT g.pair, CAST(round({_SCALE} * (ln((coalesce(r, 0) + {_SMOOTHING}) / (coalesce(r_all, 0) + {_SMOOTHING * SYMBOLS})) - ln((coalesce(o, 0) + {_SMOOTHING}) / (coalesce(o_all, 0) + {_SMOOTHING * SYMBOLS})))) AS BIGINT) AS w
  FROM (SELECT unnest(range({_STATES * _STATES})) AS pair) g LEFT JOIN counts c ON g.pair = c.pair LEFT JOIN sums ON g.pair // {_STATES} = sums.a),
steps AS (SELECT m, unnest(list_transform(range(1, len(c)), lambda i: c[i] * {_STATES} + c[i + 1])) AS pair
  FROM (SELECT m, [0] || list_transform(string_split(m, ''), lambda c: ascii(c) - {_FIRST}) AS c FROM (SELECT DISTINCT m FROM places WHERE rank = 3))),
likely AS (SELECT m FROM steps JOIN weights USING (pair) GROUP BY m HAVING sum(w) >= {int(MARGIN * _SCALE)}),
added AS (SELECT rid, rank, s, e FROM places p WHERE rank = 3 AND m IN (SELECT m FROM likely)
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = p.rid AND b.s < p.e AND p.s < b.e)),
based AS (SELECT rid, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex, {listed} AS l FROM base GROUP BY rid),
alls AS (SELECT rid, count(*) FILTER (rank = 3) AS n_random, {listed} AS l FROM (SELECT * FROM base UNION ALL SELECT * FROM added) GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_random, 0) AS n_random,
  sha256(coalesce(b.l, '')) AS base_sha256, coalesce(t.l, '') AS spans
FROM docs LEFT JOIN based b ON docs.rid = b.rid LEFT JOIN alls t ON docs.rid = t.rid"""


ORACLE = oracle()
