"""Signatures that many sets share by chance."""

import numpy as np

from helixframe.llm.simjoin import alike_nodes


def test_a_crowd_that_shares_a_signature_by_chance_is_not_linked():
    rng = np.random.default_rng(4)
    words = list(rng.integers(0, 1 << 64, (2, 400), np.uint64))
    for w in words:
        w[399] = w[7]
    a, b, leads = alike_nodes(np.zeros(400, np.uint64), np.arange(400), words, (120,))
    assert [tuple(x) for x in np.stack([a, b], 1).tolist()] == [(399, 7)]
    assert leads.sum() == 399


def test_a_large_group_that_is_alike_is_one_star():
    words = [np.full(50_000, 5, np.uint64)] * 2
    a, b, leads = alike_nodes(np.zeros(50_000, np.uint64), np.arange(50_000), words, (120,))
    assert len(a) == 49_999 and not b.any() and leads.sum() == 1
