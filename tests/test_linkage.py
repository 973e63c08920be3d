"""Complete linkage from the pairs within the tolerance, against the matrix of all pairs."""

import numpy as np

from tidewell.operators import kernels


def by_matrix(xy, tol):
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    label = np.arange(len(xy))
    while d.size and d.min() <= tol:
        a, b = sorted(np.unravel_index(np.argmin(d), d.shape))
        d[a] = d[:, a] = np.maximum(d[a], d[b])
        d[b] = d[:, b] = np.inf
        d[a, a] = np.inf
        label[label == b] = a
    return label


def test_linkage_of_near_pairs_is_that_of_the_matrix():
    for seed in range(8):
        r = np.random.default_rng(seed)
        xy = r.random((150, 2)) * 4 if seed % 2 else r.integers(0, 12, (150, 2)) / 4.0  # ties and equal points
        for tol in (0.0, 0.3, 0.8):
            assert kernels.merged(xy, tol).tolist() == by_matrix(xy, tol).tolist()


def test_long_pieces_need_no_matrix():
    xy = np.column_stack([np.arange(30_000) * 0.875, np.zeros(30_000)])
    label = kernels.merged(xy, 1.0)  # a matrix would have 7 GB
    assert len(set(label.tolist())) == 15_000
