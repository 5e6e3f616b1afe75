import numpy as np
import pytest

from folio.llm.topk_search import Space


@pytest.mark.parametrize("times", [1, 10**3, 10**4, 10**5, 10**6, 10**8])
def test_no_score_above_its_bound(times):
    """One vector many times the others took bounds below the true score by rounding."""
    rng = np.random.default_rng(5)
    x = rng.integers(-300, 300, (1500, 16)).astype(np.float64)
    x[0] *= times
    norm, largest = float((x * x).sum(1).max()), float(np.abs(x).max())
    space = Space(16, norm, largest, [*x[:4].tolist()], [], [])
    dx = space.distances(x, False)
    whole = [[int(v) for v in row] for row in x]
    for i in [*range(1, 12), 0]:
        upper = space.upper(x[i], space.distances(x[i : i + 1], True)[0], dx)
        assert all(u >= sum(a * b for a, b in zip(whole[i], row)) for u, row in zip(upper.tolist(), whole))
