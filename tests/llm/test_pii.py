import hashlib
import random
import re

import pyarrow as pa
import pytest

from wattline.llm import pii

import cases

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return out


@pytest.mark.parametrize("letters", ["a@.b_ 1-+(9", "0123 -.+4", "4 -1", "é@a.1+25漢 "])
def test_base_spans_equal_plain_patterns(letters):
    rng = random.Random(letters)
    for _ in range(8000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(45)))
        assert pii.base_spans(text) == plain(text), text


def test_rows_equal_plain_patterns(spark):
    docs = cases.frame(spark)
    texts = {}
    for r in docs.collect():
        texts[r.doc_id] = r.text or ""
    for r in pii.find(docs.where("doc_id is not null")).collect():
        want = plain(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in want) for k in pii.KINDS)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
    assert pii.find(docs).count() == docs.count()
    assert pii.find(cases.empty(spark)).collect() == []


def test_learned_spans_add_what_the_base_drops(spark):
    texts = [f"call +1 (555) 010-{1000 + i} now" for i in range(30)] + [f"card 41111111111111{11 + 0 * i} ok" for i in range(30)]
    texts += ["reach +1 (269) 555-3296 4111111111111111 today", "order no 12345678901234", "just words"]
    got = {r.doc_id: r for r in pii.find(cases.frame(spark, texts)).collect()}
    assert got[60].spans == "card:24:40,phone:6:23" and got[60].n_card + got[60].n_phone == 0
    assert got[61].spans == got[62].spans == ""


def test_reliabilities_rank_good_labelers():
    import numpy as np

    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    chance = np.array([0.95, 0.9, 0.8, 0.7, 0.55])
    vote = np.where(rng.random((4000, 5)) < chance, 1, -1) * np.where(truth, 1, -1)[:, None]
    posterior, right = pii.expectation_maximisation(vote, np.ones(4000))
    assert np.allclose(right, chance, atol=0.05)
    assert ((posterior > 0.5) == truth).mean() > 0.95


def test_mask_changes_text_and_length_only(spark):
    docs = cases.frame(spark)
    out = pii.mask(docs)
    assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[12].text == "mail <EMAIL> or call <PHONE> from <IP> card <CARD>" and rows[12].n_chars == len(rows[12].text)
    assert rows[6].text is None and rows[0].text == cases.BASE
    assert pii.mask(cases.empty(spark)).collect() == []


def test_long_runs_are_read_once():
    import time

    start = time.time()
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 100_000, "+1" * 100_000, "1 " * 150_000):
        pii.candidates(text)
    assert time.time() - start < 60


def test_addresses_of_letters_only_are_looked_at():
    text = "from abcd:abcd:abcd:abcd:abcd:abcd:abcd:abcd today"
    assert pii.candidates(text).patterns
    assert pii._suspects(pa.array([text, "nothing here", None])).tolist() == [True, False, False]


def test_very_many_spans_in_one_text():
    import time

    text = " ".join(f"user{i}@mail{i % 7}.com" for i in range(60_000))
    start = time.perf_counter()
    found = pii.candidates(text)
    model = pii.fit([])
    spans = pii.all_spans(found, model)
    assert len(spans) >= 60_000 and spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1]))
    assert time.perf_counter() - start < 60
