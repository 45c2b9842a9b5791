"""Components of links against a plain union of sets."""

import random

import numpy as np
import pyarrow as pa
import pytest

from folioflow.llm import components as module
from folioflow.llm.components import components, least_members
from folioflow.llm.workspace import Workspace


def plain(links):
    least = {}

    def root(v):
        while least.setdefault(v, v) != v:
            v = least[v]
        return v

    for a, b in links:
        x, y = root(a), root(b)
        least[max(x, y)] = min(x, y)
    return {v: root(v) for v in list(least)}


def shuffled_path(n, seed):
    ids = list(range(-n, n, 2))
    random.Random(seed).shuffle(ids)
    return list(zip(ids, ids[1:]))


@pytest.mark.parametrize("links", [[(3, 1), (3, 1), (2, 3)], shuffled_path(400, 1), [(0, k) for k in range(1, 300)] + [(k, k) for k in range(5)]])
def test_least_members(links):
    a, b = (np.array(x, np.int64) for x in zip(*links))
    v, least = least_members(a, b)
    assert dict(zip(v.tolist(), least.tolist())) == plain(links)


def test_contracted_in_chunks(monkeypatch):
    monkeypatch.setattr(module, "CHUNK", 4)
    links = shuffled_path(40, 3)
    batches = [pa.record_batch([pa.array(x, pa.int64()) for x in zip(*links[i : i + 3])], ["a", "b"]) for i in range(0, len(links), 3)]
    out = list(module._contracted(iter(batches)))
    assert len(out) > 2
    assert plain([x for b in out for x in zip(*b.to_pydict().values())]) == plain(links)


def test_components(spark):
    links = shuffled_path(60, 2) + [(1000, k) for k in range(1001, 1040)] + [(7000, 7001), (7001, 7000), (9000, 9000)]
    df = spark.createDataFrame(links, "a long, b long").repartition(7)
    got = {r.node: r.component for r in components(df, Workspace(spark, "t"), "c").collect()}
    want = {v: c for v, c in plain(links).items() if v != c}
    assert {v: c for v, c in got.items() if v != c} == want
    assert components(df.where("false"), Workspace(spark, "t"), "c").count() == 0
