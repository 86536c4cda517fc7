"""Near copies that all link are connected without deciding all their pairs."""

from itertools import combinations

import numpy as np

from plantgraph.llm import jaccard
from plantgraph.llm import stages as st


def test_pairs_of_one_component_are_not_decided(spark, monkeypatch):
    rows = []
    for i in range(40):
        own = np.array([*range(1000, 1100), i, 90_000 + (i >= 35)], np.uint64)
        own = own + np.uint64(10_000_000 * (i == 39))  # the last one has nothing in common with the others
        rows.append((i, len(own), bytearray(np.sort(own).tobytes())))
    sets = spark.createDataFrame(rows, "sid long, n long, u binary")
    pairs = spark.createDataFrame([(a, b, b - a < 3) for a, b in combinations(range(40), 2)], "a long, b long, best boolean")
    decided = []
    links = jaccard._links
    monkeypatch.setattr(jaccard, "_links", lambda s, name, pairs, *more, **how: (decided.append(pairs.count()), links(s, name, pairs, *more, **how))[1])
    comps = jaccard._connected(st.Stages(spark, "test"), spark.createDataFrame([(1, 0), (0, 0)], "node long, comp long"), pairs, sets, 85)
    assert {r.node: r.comp for r in comps.collect()} == dict.fromkeys(range(39), 0)
    assert decided == [pairs.where('best').count(), 37]
