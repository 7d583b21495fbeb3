import math
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from gatehouse.llm import queries, sharding

from .conftest import odd_rows, texts_in


def check(rows, docs):
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs)
    slots = defaultdict(list)
    for r in rows:
        assert r.law == "key"
        assert r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    for found in slots.values():
        assert sorted(found) == list(range(len(found)))
    by_id = defaultdict(set)
    for r in rows:
        by_id[r.doc_id].add(r.shard)
    assert all(len(s) == 1 for s in by_id.values())


def test_query(spark, small):
    rows = queries.op7_hash_tree_sharding(spark, small).collect()
    check(rows, texts_in(small))
    assert set(Counter(r.shard for r in rows)) == set(range(40))
    assert 5 <= sum(r.grown_shard == 40 for r in rows) <= 60


def test_many_buckets_give_gapless_slots(spark, small):
    rows = sharding.assign_shards(spark.read.parquet(f"{small}/documents.parquet"), per_bucket=3).collect()
    check(rows, texts_in(small))


def test_odd_rows_and_an_empty_table(odd_docs, no_docs):
    check(sharding.assign_shards(odd_docs).collect(), odd_rows())
    assert sharding.assign_shards(no_docs).count() == 0


def test_weights_decide_shares_and_confine_movement(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "'' as text")
    before = [1.0] * 16
    after = [*before[:5], 3.0, *before[6:]]
    a = {r.doc_id: r.shard for r in sharding.assign_shards(docs, weights=before).collect()}
    b = {r.doc_id: r.shard for r in sharding.assign_shards(docs, weights=after).collect()}
    moved = [(a[i], b[i]) for i in a if a[i] != b[i]]
    # only region 0, in it only rack 1 and in that only shard 5 changed their weight: what moves on a level moves into that node
    for x, y in moved:
        assert y // 8 == 0
        assert x // 8 != 0 or y // 4 == 1
        assert x // 4 != 1 or y == 5
    assert 0.02 < len(moved) / len(b) < 0.25
    assert sum(s == 5 for s in b.values()) / len(b) == pytest.approx(3 / 18, abs=0.01)


def descent(key, weights, added=()):
    """The shard by a walk down the tree, with draws by another implementation of the hash."""

    def chosen(level, nodes):
        def drawn(node):
            h = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42)
            for x in (level, node):
                h = xxhash.xxh64_intdigest(struct.pack("<i", x), seed=h)
            return -math.log(((h >> 12) + 0.5) / 2**52) / weight[node]

        weight = [sum(leaf(s) for s in below(level, n)) for n in range(max(nodes) + 1)]
        return min(nodes, key=lambda n: (drawn(n), n))

    leaf = lambda s: (*weights, *added)[s]
    racks = [list(range(i, min(i + 4, len(weights)))) for i in range(0, len(weights), 4)]
    regions = [list(range(i, min(i + 2, len(racks)))) for i in range(0, len(racks), 2)]
    for k in range(len(added)):
        regions.append([len(racks)])
        racks.append([len(weights) + k])
    below = lambda level, n: [n] if level == 2 else racks[n] if level == 1 else [s for r in regions[n] for s in racks[r]]
    return chosen(2, racks[chosen(1, regions[chosen(0, range(len(regions)))])])


def test_every_row_by_an_independent_descent(spark, small, odd_docs):
    for r in queries.op7_hash_tree_sharding(spark, small).collect():
        assert (r.shard, r.grown_shard) == (descent(r.doc_id, [1.0] * 40), descent(r.doc_id, [1.0] * 40, [1.0]))
    weights = [1.0, 2.5, 0.5, 4.0, 1.0, 1.0, 7.0, 1.0, 3.0]
    for r in sharding.assign_shards(odd_docs, weights=weights).collect():
        assert (r.shard, r.grown_shard) == (descent(r.doc_id, weights), descent(r.doc_id, weights, [1.0]))
