"""A large group of heavily edited copies: similarities on both sides of the bound, components through others only."""

import random

import numpy as np
import pytest

from pagegrist.llm import minhash_dedup, neardup
from pagegrist.llm.hashing import text_shingle_set


@pytest.mark.parametrize("cluster, small, crowded", [(512, 32, 16), (512, 4, 3), (40, 4, 3), (40, 32, 1000)])
def test_group(spark, monkeypatch, cluster, small, crowded):
    monkeypatch.setattr(neardup, "CLUSTER", cluster)
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "CROWDED", crowded)
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    base = [word() for _ in range(140)]
    texts = []
    for _ in range(160):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(140)] = word()
        texts.append(" ".join(words))
    sets = [text_shingle_set(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * shared >= 75 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(spark, docs).collect()}
    want = {i: find(i) for i in range(len(texts))}
    assert 1 < len(set(want.values())) < 160
    assert got == want
