import tracemalloc

import numpy as np

from ledgerlink.operators.vector import _topk_owners


def test_scores_held_at_once_stay_small_whatever_the_index():
    """A batch of queries against 20,000 and 50,000 rows: the same few MB of scores."""
    rng = np.random.default_rng(1)
    for n in (20_000, 50_000):
        q, idx, owners = rng.normal(size=(400, 8)), rng.normal(size=(n, 8)), rng.integers(0, 10, n)
        tracemalloc.start()
        pos, score = _topk_owners(q, idx, owners, 2)
        peak = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert peak < 30, peak
        s = np.round(q[:20] @ idx.T, 10)
        assert (pos[:20, 0] == s.argmax(axis=1)).all() and (owners[pos[:, 0]] != owners[pos[:, 1]]).all()
        assert np.allclose(score[:20, 0], s.max(axis=1))
