"""The numpy kernels against plain Python."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pagegrist.llm import docstats, fingerprint, hashing, licenses, line_dedup, minhash_dedup, mixing, neardup, packing, quality_classifier
from pagegrist.llm.common import utf8

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["", None, "a", "one two three four", "A b C d E", "a b c d e f a b c d e", "é ß\tü\n\nx  y ", " lead", "x" * 1_200_000 + " y " + "z" * 600_000, "w " * 300_000, "   q\x1cr"]


def test_word_hashes():
    data, at = utf8(pa.array(TEXTS))
    hashes, offsets = hashing.word_hashes(data, at)
    seen: dict[str, int] = {}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in enumerate(TEXTS):
        words = WORDS.findall((t or "").translate(lower))
        assert len(words) == offsets[i + 1] - offsets[i]
        for w, h in zip(words, hashes[offsets[i] : offsets[i + 1]].tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_measures():
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(TEXTS)), pa.int64()), "text": TEXTS})
    got = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    for part in docstats.slices(batch):
        m = docstats.measure(part)
        for k in got:
            got[k] += m[k].tolist()
    for i, t in enumerate(TEXTS):
        words = WORDS.findall(t or "")
        windows = Counter(zip(*(words[k:] for k in range(5))))
        covered = {j + k for j in range(len(words) - 4) if windows[tuple(words[j : j + 5])] > 1 for k in range(5)}
        lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert tuple(v[i] for v in got.values()) == want, i


def jaccard(a, b):
    return len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))


def test_signatures_estimate():
    rng = random.Random(5)
    for share in (0.3, 0.6, 0.9):
        common = [rng.getrandbits(63) for _ in range(int(1000 * share))]
        a, b = (np.unique(np.array(common + [rng.getrandbits(63) for _ in range(1000 - len(common))], np.uint64)) for _ in range(2))
        got = (minhash_dedup.signature(a) == minhash_dedup.signature(b)).mean()
        assert abs(got - jaccard(a, b)) < 0.17


def test_line_signatures():
    lines = ["the quick brown fox jumps over the lazy dog today", "the quick brown fox jumps over the lazy dog todax", "short", "entirely different words stand in this line of text", "x" * 200_000]
    sig = line_dedup.signatures(lines)
    hashes, start = line_dedup._hashes(lines)
    assert np.diff(np.append(start, len(hashes))).tolist() == [len(x) - 4 for x in lines]
    agree = lambda i, j: (sig[i] == sig[j]).mean()
    assert agree(0, 1) > 0.7 and agree(0, 3) < 0.3 and (line_dedup.signatures(lines[:1]) == sig[:1]).all() and line_dedup.signatures([]).shape == (0, line_dedup.K)


def brute_pairs(key, node, bit, least):
    rows = sorted({(k, n, b) for k, n, b in zip(key.tolist(), node.tolist(), bit.tolist())})
    return {(m, n) for k, m, b in rows for j, n, c in rows if k == j and m < n and 64 - (b ^ c).bit_count() >= least}


@pytest.mark.parametrize("small", [1000, 8])
def test_bucket_pairs(monkeypatch, small):
    """Small buckets join all that agrees; large ones at least all that agrees well; no other pair comes out."""
    monkeypatch.setattr(neardup, "SMALL", small)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    node = np.arange(240)
    key = rng.integers(0, 6, 240).astype(np.uint32)
    bit = base[rng.integers(0, 6, 240)] ^ (np.uint64(1) << rng.integers(0, 64, 240).astype(np.uint64))
    bits = neardup.Bits.of(75)
    i, j = neardup.bucket_pairs(key, node, bit, bits)
    got, want = set(zip(node[i].tolist(), node[j].tolist())), brute_pairs(key, node, bit, bits.least)
    assert len(got) == len(i) and got <= want and len(got) < len(want)
    for k in set(key.tolist()):
        root = grouped_by(set(node[key == k].tolist()), [(a, b) for a, b in got if key[a] == k])
        assert all(root[a] == root[b] for a, b in brute_pairs(key, node, bit, bits.least if small == 1000 else bits.alone) if key[a] == k)


def test_forest():
    rng = random.Random(4)
    edges = sorted({tuple(sorted((rng.randrange(60), rng.randrange(60)))) for _ in range(90)})
    edges = [(a, b) for a, b in edges if a < b]
    kept = neardup.forest(*np.array(edges).T)
    tree = [edges[k] for k in kept]
    assert grouped_by(range(60), tree) == grouped_by(range(60), edges) and len(tree) == 60 - len(set(grouped_by(range(60), edges).values()))
    assert len(neardup.forest(np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def grouped_by(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_crowded_keys_shrink():
    bits = neardup.Bits.of(75)
    nodes = np.arange(100, 150)
    key, at = np.repeat(np.array([7, 9], np.uint64) << np.uint64(50), (40, 10)), np.arange(50)
    bit = np.zeros(50, np.uint64)
    bit[5] = 2**40 - 1  # in the crowd but unlike its first one
    left, place, (a, b, n) = neardup._combined(key, at, nodes, bit, bits)
    assert place.tolist() == [0, 5, *range(40, 50)] and set(a.tolist()) == {100} and b.tolist() == [x for x in range(101, 140) if x != 105]


def test_roots():
    ids, root = neardup.roots(np.array([1, 2, 5, 8]), np.array([2, 3, 6, 7]))
    assert dict(zip(ids.tolist(), root.tolist())) == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 7, 8: 7}


def test_linked():
    rng = random.Random(9)
    sets = [np.array(sorted(rng.sample(range(30), rng.randint(0, 25))), np.uint64) for _ in range(40)]
    near = lambda x, y: len(x & y) and 100 * len(x & y) >= 60 * len(x | y)
    plain = [set(x.tolist()) for x in sets]
    assert set(zip(*map(np.ndarray.tolist, neardup.linked(sets, 60)))) == {(i, j) for j in range(40) for i in range(j) if near(plain[i], plain[j])}
    assert set(zip(*map(np.ndarray.tolist, neardup.linked(sets[:10], 60, sets[10:])))) == {(i, j) for i in range(10) for j in range(30) if near(plain[i], plain[j + 10])}


def test_fullest_is_best():
    rng = random.Random(2)
    for _ in range(60):
        counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        longest, size = max(counts), 40
        got = packing.fullest(counts, longest, size)
        best = max(sum(n * k for k, n in zip(counts, c)) for c in itertools.product(*(range(v + 1) for v in counts.values())) if dict(zip(counts, c))[longest] and sum(n * k for k, n in zip(counts, c)) <= size)
        assert sum(k * n for k, n in got.items()) == best and all(n <= counts[k] for k, n in got.items())


def least_bins(counts, size):
    """The bound of Martello and Toth: of each cut, the pieces over half, and what the middle ones need beyond the room that those leave."""
    best = 0
    for cut in range(size // 2 + 1):
        big = sum(v for k, v in counts.items() if k > size - cut)
        half = {k: v for k, v in counts.items() if size / 2 < k <= size - cut}
        rest = sum(k * v for k, v in counts.items() if cut <= k <= size / 2)
        room = sum((size - k) * v for k, v in half.items())
        best = max(best, big + sum(half.values()) + max(0, -(-(rest - room) // size)))
    return best


def test_patterns_place_all():
    rng = random.Random(4)
    counts = {k: rng.randint(0, 50) for k in range(1, 129)}
    plan = packing.patterns(counts, 128)
    placed = Counter()
    for bins, p in plan:
        assert 0 < sum(k * n for k, n in p.items()) <= 128
        for k, n in p.items():
            placed[k] += bins * n
    assert dict(placed) == {k: v for k, v in counts.items() if v}
    assert sum(b for b, _ in plan) <= least_bins(counts, 128) * 1.02 + 1


def test_pieces():
    ids = np.arange(2500, dtype="<u4").tobytes()
    assert [(a, n) for a, n, _ in packing.pieces(ids, 1024)] == [(0, 452), (452, 1024), (1476, 1024)]
    assert [(a, n) for a, n, _ in packing.pieces(ids[: 4 * 1024], 1024)] == [(0, 1024)] and [(a, n) for a, n, _ in packing.pieces(ids[:4], 1024)] == [(0, 1)]


def test_encode_is_the_tokenizers():
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)  # of its own: what the module does to its tokenizer must not show
    assert t.encode("<|endoftext|> a", add_special_tokens=False).ids == np.frombuffer(packing.encode(["<|endoftext|> a"], path)[0], "<u4").tolist()
    rng = random.Random(6)
    odd = ["a  b", " x", "x ", "a\n\nb", "é à\xa0b", "don't we'll  I'm", "a \tb", "a\x85b c", "<|endoftext|> a", "1 23 a4b5 --- !! x", "a 's b 'll", ".. ,, . , x.,y", "a),b (c. d", "x\n.y", "漢字 と か", "a​b", "", "ab\ncd ef", "Ünï, cödé. x"]
    odd += [f"{x}<|endoftext|>{y}" for x in ("", "a", "a ", "x.\n") for y in ("", "b", " b", "<|endoftext|>", "endoftext|>")]
    odd += ["".join(rng.choice(" \n.,ab1é'!-") for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    want = [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(odd, add_special_tokens=False)]
    assert packing.encode(odd, path) == want and packing.encode(odd, path) == want


def test_trees_learn():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality_classifier.learn(x, y, trees=40)
    assert ((model.score(x) > 0.5) == y).mean() > 0.97
    one = model.score(x[:1])[0]
    at = 0.0
    for f, t, leaf in zip(model.feature, model.threshold, model.leaf):  # node by node
        k = 0
        while k < len(f):
            k = 2 * k + 1 + bool(x[0, f[k]] > t[k])
        at += leaf[k - len(f)]
    assert one == pytest.approx(1 / (1 + np.exp(-(model.start + at))))
    assert quality_classifier.learn(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5] and len(set(quality_classifier.learn(x, np.ones(2000)).score(x))) == 1


def test_digests():
    rng = random.Random(8)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400))
    other = " ".join("".join(rng.choice("klmnopqrst") for _ in range(6)) for _ in range(400))
    a, b, c = map(fingerprint.digest, (text, fingerprint.edited(text, other), other))
    assert fingerprint.likeness(a, a) == 1.0 and fingerprint.likeness(a, b) > 0.5 > fingerprint.likeness(a, c) >= 0.0 and fingerprint.likeness(a, b) == fingerprint.likeness(b, a)
    assert len({fingerprint.digest(x) for x in ("", "a", "b", "abc", "xyz", "abcde", "abcdef")}) == 7
    assert fingerprint.digest("") == fingerprint.digest("") and 0 <= fingerprint.likeness(fingerprint.digest(""), a) <= 1


def test_license_places():
    index = licenses.Index({w: 1.0 / len(w) for w in licenses.VOCABULARY})
    text = "MIT License mit license the GNU General Public License, mit license general public x license Licensed under CC BY-NC 4.0."
    found = licenses.words(text)
    places, best = licenses.scan(found, index)
    want = [(i, label) for p, label in licenses.BASE for i in range(len(found)) if tuple(found[i : i + len(p.split())]) == tuple(p.encode().split())]
    assert sorted(places) == sorted(want) and best["cc-by-nc"] == pytest.approx(1.0) and "apache" not in best


def test_mixing_sql_names():
    assert mixing.WEIGHTS == (5, 2, 1) and mixing.BITS == 60


def test_packing_of_entries_and_places():
    rng = np.random.default_rng(5)
    for m in (0, 1, 40):
        sizes = rng.integers(1, 29, m)
        node, bit, key = rng.integers(-(2**62), 2**62, m), rng.integers(0, 2**63, m, dtype=np.uint64), rng.integers(0, 2**63, int(sizes.sum()), dtype=np.uint64)
        k, n, b = neardup.unpacked_entries(neardup.packed_entries(key, node, bit, sizes))
        assert (k == key.astype(np.uint32)).all() and (n == np.repeat(node, sizes)).all() and (b == np.repeat(bit, sizes)).all()
    places = np.array([(1, 5, 7, 0), (1, 5, 8, 1), (1, 6, 7, 0), (-3, 6, -9, -1), (1, 5, 7, 3)], np.int64)
    assert (np.array(neardup.unpacked_places(neardup.packed_places(places))).T == places).all()


def test_rare_shingles_are_paired_one_by_one(monkeypatch):
    """Large clusters of texts that have little in common: pairs are told as by plain sets, and only common shingles are multiplied."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[:8], rng.choice(np.arange(3000, dtype=np.uint64), 60)])) for _ in range(300)]
    sets[::10] = [np.unique(np.append(sets[0][:-k], np.uint64(5000 + k))) for k in range(1, 31)]
    want = lambda x, y: 100 * len({*x} & {*y}) >= 60 * len({*x} | {*y})
    lists = [x.tolist() for x in sets]
    zeros, made = np.zeros, []
    monkeypatch.setattr(neardup.np, "zeros", lambda shape, *a, **k: made.append(shape) or zeros(shape, *a, **k))
    i, j = neardup.linked(sets, 60)
    grids = [x[1] for x in made if isinstance(x, tuple)]
    assert {*zip(i.tolist(), j.tolist())} == {(x, y) for x in range(300) for y in range(x + 1, 300) if want(lists[x], lists[y])}
    i, j = neardup.linked(sets[:80], 60, sets[50:])
    assert {*zip(i.tolist(), j.tolist())} == {(x, y) for x in range(80) for y in range(250) if want(lists[x], lists[50 + y])}
    assert sum(grids) < 1000 < len({x for t in lists for x in t})
