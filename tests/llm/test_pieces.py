import itertools
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from wattline.llm import pieces

import cases

needs_model = pytest.mark.skipif(not Path(pieces.MODEL).exists(), reason="model file not found")


@needs_model
def test_ids_equal_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(4)
    texts = cases.TEXTS + [" a  b ", "x\ty\n", "▁x", "\0z", "a\xa0b", "   "] + ["".join(rng.choice("abc  ▁é漢\n.ther") for _ in range(rng.randrange(60))) for _ in range(200)]
    docs = cases.frame(spark, texts)
    got = sorted(pieces.encode(docs, check="same").collect(), key=lambda r: r.doc_id)
    assert [r.token_ids for r in got] == [model.encode(t or "") for t in texts]
    assert all(r.same for r in got)
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs).select("doc_id", "token_ids")).collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t in enumerate(texts)}


@needs_model
def test_awkward_rows_and_empty_table(spark):
    docs = cases.frame(spark)
    assert pieces.encode(docs).count() == docs.count()
    assert pieces.encode(cases.empty(spark)).collect() == []


def _plain_merges(word, score):
    symbols = list(word)
    while True:
        best = None
        for i in range(len(symbols) - 1):
            s = score.get(symbols[i] + symbols[i + 1])
            if s is not None and (best is None or s > best[0]):
                best = (s, i)
        if best is None:
            return symbols
        i = best[1]
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


@pytest.mark.parametrize("long", [0, 128])
def test_merges_equal_plain_python(monkeypatch, long):
    monkeypatch.setattr(pieces, "_LONG", long)
    rng = random.Random(long)
    names = ["<unk>", *"abc", "▁"] + sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(2, 5))) for _ in range(25)} | {"▁a", "▁ab"})
    scores = [0.0] * 5 + [-float(x) for x in rng.sample(range(200), len(names) - 5)]
    vocabulary = pieces.Vocabulary.build(names, scores)
    score = dict(zip((n.replace("▁", " ") for n in names[5:]), scores[5:], strict=True))
    texts = ["".join(rng.choice("abcab ") for _ in range(rng.randrange(30))) for _ in range(150)]
    ids, borders = pieces.Encoder(vocabulary).encode(pa.array(texts))
    for t, a, b in zip(texts, borders[:-1], borders[1:], strict=True):
        assert [vocabulary.pieces[i] for i in ids[a:b]] == (_plain_merges(" " + t, score) if t else [])


def test_best_paths_equal_all_segmentations():
    rng = random.Random(9)
    names = ["<unk>", "a", "b", "▁", "ab", "ba", "aab", "▁a", "bb", "abb"]
    scores = [0.0] + [rng.uniform(-5, -1) for _ in names[1:]]
    vocabulary = pieces.Vocabulary.build(names, scores, kind="unigram")
    score = {n.replace("▁", " "): s for n, s in zip(names[1:], scores[1:], strict=True)}

    def best(word):
        top = -1e9
        for cuts in itertools.product((0, 1), repeat=len(word) - 1):
            parts, last = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(word[last:i])
                    last = i
            parts.append(word[last:])
            if all(p in score for p in parts):
                top = max(top, sum(score[p] for p in parts))
        return top

    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    ids, borders = pieces.Encoder(vocabulary).encode(pa.array(texts))
    for t, a, b in zip(texts, borders[:-1], borders[1:], strict=True):
        own = [vocabulary.pieces[i] for i in ids[a:b]]
        assert "".join(own) == " " + t and sum(score[p] for p in own) == pytest.approx(best(" " + t))


def test_suffix_array_is_sorted():
    codes = np.random.default_rng(0).integers(1, 4, 300)
    order, _ = pieces.suffix_array(codes, 8, 16)
    tails = [tuple(codes[i : i + 16]) for i in order]
    assert tails == sorted(tails)


def test_unknown_without_bytes():
    vocabulary = pieces.Vocabulary.build(["<unk>", "a", "▁"], [0.0, -1.0, -2.0])
    ids, _ = pieces.Encoder(vocabulary).encode(pa.array(["a漢"]))
    assert ids.tolist() == [2, 1, 0]
