import collections
import math
import struct
import zlib

import pytest
import xxhash

from tallyweave.llm.queries import sharding
from tallyweave.llm.sharding import shard_records


def brute(key, weights):
    def draw(shard):
        h = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<i", shard), h)
        return -math.log(((h >> 11) + 0.5) * 2.0 ** -53) / weights[shard]
    return min(range(len(weights)), key=draw)


def gapless(rows):
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    return all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_query_against_brute_force(spark, tiny):
    rows = sharding(spark, "/root/testdata/sf0.001").collect()
    texts = dict(tiny)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 16, zlib.crc32(data), "key")
        assert r.shard == brute(r.doc_id, [1.0] * 40)
        assert r.grown_shard == brute(r.doc_id, [1.0] * 41)
        assert r.grown_shard in (r.shard, 40)
    assert gapless(rows)


def test_weights_nulls_repeats(spark, docs_of):
    data = [(i, "t") for i in range(3000)] + [(5, None)] * 50 + [(None, "")] * 3
    rows = shard_records(docs_of(data).repartition(3), "doc_id", "text", [1.0, 3.0]).collect()
    assert len(rows) == len(data) and gapless(rows)
    share = sum(r.shard for r in rows if r.doc_id != 5) / 3000
    assert 0.7 < share < 0.8
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id is None} == {(16, 0)}
    assert {r.shard for r in rows if r.doc_id == 5} == {brute(5, [1.0, 3.0])}


def test_empty_and_one_shard(spark, docs_of):
    assert shard_records(docs_of([(1, "a")]).limit(0), "doc_id", "text", [1.0]).count() == 0
    assert shard_records(docs_of([(1, "a")]), "doc_id", "text", [2.0]).first().shard == 0
    with pytest.raises(ValueError):
        shard_records(docs_of([(1, "a")]), "doc_id", "text", [])
