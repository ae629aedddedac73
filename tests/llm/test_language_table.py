import numpy as np

from loomgraph.llm import language_id


def test_every_key_is_known():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 16_383, dtype=np.uint64) * np.uint64(2))
    keys = np.random.default_rng(2).permutation(keys)
    table = language_id._Table(keys, keys[:, None].astype(np.float64))
    row = table.find(keys)
    assert (row >= 0).all() and np.array_equal(table.scores[row, 0], keys.astype(np.float32))
    assert (table.find(keys + np.uint64(1)) == -1).all()
