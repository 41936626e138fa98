"""The difference cover: ranks in byte order, and equal strings that only they tell apart."""

import numpy as np
import pytest

from traceqc.llm import suffix_dedup as S


@pytest.mark.parametrize(("n", "letters", "depth"), [(3000, 2, 155), (2000, 256, 155), (900, 1, 155), (1500, 3, 31), (1500, 3, 93), (155, 4, 155), (100, 4, 155), (0, 4, 155)])
def test_samples_are_ranked_by_their_bytes(n, letters, depth):
    rng = np.random.default_rng(n)
    data = rng.integers(0, letters, n, np.uint8)
    if n > 800:
        data[500:700] = data[100:300]
    rank = S.sample_ranks(data, depth)
    at = np.array([k for k in range(max(0, n - depth + 1)) if k % S.COVER in S.RESIDUES], np.int64)
    assert np.all(np.delete(rank, at) == -1)
    own = [data[k : k + depth].tobytes() for k in at]
    order = {b: k for k, b in enumerate(sorted(set(own)))}
    assert rank[at].tolist() == [order[b] for b in own]


def suffixes(data, length):
    """All suffixes of one text in one bucket, one run."""
    n = len(data) - length + 1
    return np.zeros(1, np.uint64), np.zeros(1, np.int64), np.array([n]), n


@pytest.mark.parametrize("length", [100, 140, 200, 217])
def test_equal_strings_and_no_others(length, monkeypatch):
    """Strings that differ only in the middle, far from both ends, beside equal ones."""
    rng = np.random.default_rng(length)
    one = rng.integers(0, 256, length, np.uint8)
    other = one.copy()
    other[length // 2] ^= 1
    filler = lambda: rng.integers(0, 256, 40, np.uint8)
    data = np.concatenate([filler(), one, filler(), other, filler(), one, filler(), other[:-1], filler()])
    starts = {}
    for k in range(len(data) - length + 1):
        starts.setdefault(data[k : k + length].tobytes(), []).append(k)
    want = sorted(k for v in starts.values() if len(v) > 1 for k in v)
    # one bucket and place for all strings at their own start
    p = np.arange(len(data) - length + 1)
    ones = np.ones(len(p), np.int64)
    found = lambda: np.flatnonzero(S.equal_suffixes(data, np.zeros(len(p), np.uint64), p, ones, p + 5, length)).tolist()
    assert found() == want and len(want) == 2
    # without the cover's ranks the middle is not looked at
    monkeypatch.setattr(S, "sample_ranks", lambda data, depth: np.zeros(len(data) + 1, np.int64))
    assert len(found()) > 2
