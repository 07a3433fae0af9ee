import zlib
from collections import Counter

import numpy as np

from wattline.llm import sharding

import cases


def plain_jump(key, shards):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_equals_plain_python_and_moves_only_into_the_new_shard():
    keys = np.concatenate((np.arange(-50, 3000), np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 2000)))
    for shards in (1, 2, 16, 17):
        assert sharding.jump(keys, shards).tolist() == [plain_jump(int(k), shards) for k in keys]
    before, after = sharding.jump(keys, 16), sharding.jump(keys, 17)
    assert set(after[before != after]) == {16}
    assert abs((before != after).mean() - 1 / 17) < 0.02


def test_rows_equal_plain_python(spark):
    docs = cases.frame(spark)
    got = sharding.shard(docs).collect()
    want = Counter()
    for r in docs.collect():
        raw = (r.text or "").encode()
        want[(r.doc_id, len(raw) + 1, zlib.crc32(raw), "key", plain_jump(-1 if r.doc_id is None else r.doc_id, 16), plain_jump(-1 if r.doc_id is None else r.doc_id, 17))] += 1
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    for s in range(16):
        own = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        order = [(-(1 << 63) if r.doc_id is None else r.doc_id, r.text_crc32, r.size) for r in own]
        assert order == sorted(order)


def test_empty_table(spark):
    assert sharding.shard(cases.empty(spark)).collect() == []
