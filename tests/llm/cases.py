"""Inputs that every operator has to stand, and plain Python versions to compare with."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, part int, n long, row string, place long, size int, label int, score double"
BASE = " ".join(f"word{i}" for i in range(60))

TEXTS = [
    BASE,
    BASE,
    BASE.replace("word59", "other"),
    BASE.replace("word30", "x y z"),
    BASE.upper(),
    "",
    None,
    "   \t\n ",
    "one",
    "one two three four",
    "one two three four five",
    "Ünïcödé 漢字 🙂 text",
    "mail a.b@c.de or call +1 (555) 010-9999 from 10.0.0.1 card 4111 1111 1111 1111",
    "long " * 30000,
    " ".join(f"w{i % 977}" for i in range(20000)),
    "nospaces" * 500,
]


def rows(texts=None, first=0):
    out = []
    for i, t in enumerate(TEXTS if texts is None else texts, first):
        source = None if i % 5 == 4 else f"src{i % 3}"
        out.append((i, t, "en", source, len(t or ""), 7, "k", 1, 2, "r", 3, 4, 1, 0.5))
    return out


def frame(spark, texts=None, extra=()):
    """The texts above, one row twice, and a row of nulls."""
    own = rows(texts)
    if texts is None:
        own += [own[2], (None,) * 14, (None, BASE, *(None,) * 12), *extra]
    return spark.createDataFrame(own, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def components(sets, threshold):
    """Smallest id reachable, by comparing all pairs; ``sets`` is a list of (id, set)."""
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}
