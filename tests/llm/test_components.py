import random

import pytest

from folio.llm.common import SMALL, components


@pytest.mark.parametrize("small", [SMALL, 0])
def test_chains_in_any_order_of_ids(spark, small):
    """Ids in random order along a chain took more than 60 rounds before and ended in an error."""
    ids = random.Random(3).sample(range(5000), 400)
    chain = [*zip(ids, ids[1:])]
    star = [(9000 + i, 8000) for i in range(20)]
    links = spark.createDataFrame([*chain, *star, *star[:3], (8000, 8000), (None, 7)], "a long, b long")
    want = {i: min(ids) for i in ids} | {i: 8000 for i in [8000, *(a for a, _ in star)]}
    found = [tuple(r) for r in components(links, small=small).collect()]
    assert len(found) == len(want) and dict(found) == want
    assert components(links.limit(0), small=small).count() == 0
