"""License places: edited passages against brute force over every start."""

import random

import pytest

from pagegrist.llm import licenses

RNG = random.Random(7)
OTHER = [bytes("".join(RNG.choice("abcdefghij") for _ in range(6)), "ascii") for _ in range(400)]


def index(flat=False):
    return licenses.Index({w: 1.0 if flat else 0.5 + (sum(w) % 50) / 10 for w in licenses.VOCABULARY})


def brute(found, ix):
    """The best share of each label: every start, the whole window, by plain dynamic programming."""
    best = {}
    for k, t in enumerate(licenses.ALL):
        d = licenses.drift(t)
        for start in range(-d, len(found)):
            if t.base:
                if start >= 0 and tuple(found[start : start + len(t.words)]) == t.words:
                    best[t.label] = 1.0
                continue
            window = found[max(0, start - d) : start + len(t.words) + 2 * d]
            if not any(tuple(window[i : i + len(p)]) == p for p in t.keys for i in range(len(window))):
                continue
            row = [0.0] * (len(window) + 1)
            for w in t.words:
                new = [0.0]
                for j, x in enumerate(window):
                    new.append(max(row[j + 1], new[j], row[j] + ix.weights[w] if x == w else 0.0))
                row = new
            share = row[-1] / ix.total[k]
            if share >= licenses.SHARE:
                best[t.label] = max(best.get(t.label, 0.0), share)
    return best


def edited(words, rate):
    out = []
    for w in words:
        r = RNG.random()
        if r < rate:
            out.append(RNG.choice(OTHER))
        elif r < 2 * rate:
            out += [w, RNG.choice(OTHER)]
        elif r > rate * 2.5:
            out.append(w)
    return out


@pytest.mark.parametrize("rate", [0.0, 0.04, 0.1])
def test_against_brute_force(rate):
    ix = index()
    seen = 0
    for t in licenses.ALL:
        found = RNG.choices(OTHER, k=RNG.randint(0, 30)) + edited(t.words, rate) + RNG.choices(OTHER, k=RNG.randint(0, 30))
        places, got = licenses.scan(found, ix)
        want = brute(found, ix)
        assert set(got) == set(want), (t.label, t.words)
        assert all(got[x] <= want[x] + 1e-9 for x in got)
        assert sorted(places) == sorted((i, b.label) for b in licenses.ALL if b.base for i in range(len(found)) if tuple(found[i : i + len(b.words)]) == b.words)
        seen += t.label in got
    assert seen >= {0.0: len(licenses.ALL), 0.04: 0.75 * len(licenses.ALL), 0.1: 0.3 * len(licenses.ALL)}[rate]


def test_words_put_in():
    ix = index(flat=True)
    said = {
        "bsd": "Redistribution and use in source and also binary forms with or without modification are permitted",
        "mit": "Permission is hereby granted, free of any charge, to any person obtaining a copy of this software and associated documentation files",
    }
    for label, text in said.items():
        assert licenses.scan(licenses.words(text), ix)[1].get(label, 0) >= licenses.SHARE
        scattered = licenses.words(" ".join(w + " filler words that stand between" for w in text.split()))
        assert label not in licenses.scan(scattered, ix)[1]
    assert licenses.scan(licenses.words("a license to use source forms, granted to any person; terms and conditions"), ix) == ([], {})


def test_anchors_suffice():
    """No place that has the share has fewer than two of the words that are looked up."""
    for ix in (index(), index(flat=True)):
        for t, anchors, total in zip(licenses.ALL, ix.anchors, ix.total):
            if not t.base:
                own = {w: ix.weights[w] * t.words.count(w) for w in set(t.words)}
                assert total - sum(own[w] for w in anchors) + max(own[w] for w in anchors) < licenses.SHARE * total or anchors == set(t.words)


def test_long_and_repeated():
    ix = index()
    found = licenses.words("licensed under the license " * 20_000 + "Licensed under CC BY-NC 4.0.")
    assert "cc-by-nc" in licenses.scan(found, ix)[1]
