import numpy as np

from gatehouse.llm import tokenfile


def test_long_copies_and_rare_pairs_with_the_settings_of_the_query():
    rng = np.random.default_rng(3)
    passage = rng.permutation(4096)
    ids, counts = np.tile(passage, 8), np.full(8, 4096)  # every pair is seen eight times, in copies of 4096 tokens
    payload = tokenfile.compress(ids, counts, 5000)
    shard = tokenfile.Shard(payload)
    assert (shard.read() == ids).all()
    assert shard.length.max() > 32
    assert len(shard.symbols) < 8 * 64
    assert len(payload) < 0.75 * 2 * len(ids)


def test_every_rule_pays():
    rng = np.random.default_rng(4)
    ids = np.minimum(rng.geometric(0.05, 50_000), 200)
    shard = tokenfile.Shard(tokenfile.compress(ids, np.array([20_000, 30_000]), 300))
    used = np.bincount(np.concatenate([shard.symbols, shard.left, shard.right]), minlength=len(shard.length))[300:]
    assert (shard.read() == ids).all()
    assert len(used) > 0
    assert used.min() > 0
    assert len(shard.symbols) + 4 * len(shard.left) < len(ids)
