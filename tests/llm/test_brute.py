"""Learning, digests and the whole pipeline against plain Python."""

import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from pagegrist.llm import fingerprint, line_dedup, mixing, quality_classifier, queries
from pagegrist.llm.hashing import text_shingle_set


def brute_learn(x, y, trees, depth, rate, bins):
    """Boosted trees by loops over rows, nodes, features and cuts."""
    n, features = len(x), len(x[0])
    share = (sum(y) + 1) / (n + 2)
    start = math.log(share / (1 - share))
    cuts = []
    for f in range(features):
        column = sorted(r[f] for r in x)
        cuts.append(sorted({column[math.floor((n - 1) * k / bins)] for k in range(1, bins)}))
    total, out = [start] * n, []
    for _ in range(trees):
        p = [1 / (1 + math.exp(-t)) for t in total]
        g, h = [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p]
        node, split = [0] * n, {}
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = [i for i in range(n) if node[i] == k]
                best = (1e-9, None)
                ga, ha = sum(g[i] for i in rows), sum(h[i] for i in rows)
                for f in range(features):
                    for c in cuts[f]:
                        gl, hl = (sum(v[i] for i in rows if x[i][f] <= c) for v in (g, h))
                        if hl >= quality_classifier.LEAST and ha - hl >= quality_classifier.LEAST:
                            gain = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
                            if gain > best[0] + 1e-12:
                                best = (gain, (f, c))
                split[k] = best[1]
            node = [2 * k + 1 + (split[k] is not None and x[i][split[k][0]] > split[k][1]) if k in split and k >= 2**level - 1 else k for i, k in enumerate(node)]
        inner = 2**depth - 1
        leaf = {}
        for k in range(inner, 2 * inner + 1):
            rows = [i for i in range(n) if node[i] == k]
            leaf[k] = -rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + 1)
        total = [t + leaf[k] for t, k in zip(total, node)]
        out.append((split, leaf))
    return out, [1 / (1 + math.exp(-t)) for t in total]


@pytest.mark.parametrize("seed", [1, 2])
def test_learn(seed):
    rng = np.random.default_rng(seed)
    x = rng.random((160, 4)).astype(np.float32)
    x[:, 3] = np.round(x[:, 3], 1)  # ties
    y = ((x[:, 0] > 0.4) & (x[:, 1] < 0.7) | (x[:, 3] > 0.8)).astype(float)
    model = quality_classifier.learn(x, y, trees=5, depth=3, rate=0.3, bins=8)
    trees, scores = brute_learn([[float(v) for v in r] for r in x], y.tolist(), 5, 3, 0.3, 8)
    assert model.score(x).tolist() == pytest.approx(scores, abs=1e-9)
    for t, (split, leaf) in enumerate(trees):
        for k, found in split.items():
            assert found is None and math.isinf(model.threshold[t, k]) or found is not None and (model.feature[t, k], float(model.threshold[t, k])) == found
        assert model.leaf[t].tolist() == pytest.approx([leaf[k] for k in sorted(leaf)], abs=1e-9)


def brute_digest(text):
    data = text.encode()
    data = data + bytes(5) if 0 < len(data) < 6 else data
    counts = [0] * 1024
    for i in range(len(data) - 5):
        h = (data[i] * 0x9E3779B1 + data[i + 2] * 0x85EBCA6B + data[i + 5] * 0xC2B2AE35) % 2**32
        h ^= h >> 15
        h = h * 0x2C1B3C6D % 2**32
        h ^= h >> 13
        counts[h % 1024] += 1
    ranked = sorted(counts)
    cuts = [ranked[k] for k in (256, 512, 768)]
    codes = [sum(c > q for q in cuts) for c in counts]
    length = min(255, int(8 * math.log2(1 + len(text.encode()))))
    return bytes(codes[i] | codes[i + 1] << 2 | codes[i + 2] << 4 | codes[i + 3] << 6 for i in range(0, 1024, 4)) + bytes([length])


def brute_likeness(a, b):
    apart = sum(abs((x >> s & 3) - (y >> s & 3)) for x, y in zip(a[:-1], b[:-1]) for s in (0, 2, 4, 6))
    return 1.0 if a == b else max(0.0, 1 - apart / 1280 - min(1.0, abs(a[-1] - b[-1]) / 32) * 0.15)


def test_digest():
    rng = random.Random(3)
    texts = ["", "a", "abc", "abcdef", "é" * 40, *("".join(rng.choice("abcde é\n漢") for _ in range(rng.randint(1, 3000))) for _ in range(25))]
    got = [fingerprint.digest(t) for t in texts]
    assert got == [brute_digest(t) for t in texts]
    for _ in range(60):
        a, b = rng.choice(got), rng.choice(got)
        assert fingerprint.likeness(a, b) == pytest.approx(brute_likeness(a, b))


def groups(n, near):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(n):
        for j in range(i):
            if near(i, j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def alike(a, b):
    common = len(a & b)
    return common and 100 * common >= 75 * len(a | b)


def test_pipeline(spark, sf):
    """Each stage in plain Python or SQL on what the one before gives, in the order of the pipeline, but for the learnt verdicts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r.doc_id for r in quality_classifier.classify(spark, docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
    rows = sorted((r for r in docs.collect() if r.doc_id in good), key=lambda r: r.doc_id)
    # lines: by (doc_id, number), as no two rows share an id
    lines = [(i, k, x) for i, r in enumerate(rows) for k, line in enumerate((r.text or "").split("\n")) if (x := line_dedup.normal(line))]
    distinct = {x: set(line_dedup.shingles(x).tolist()) for _, _, x in lines}
    names = list(distinct)
    root = dict(zip(names, groups(len(names), lambda i, j: alike(distinct[names[i]], distinct[names[j]]))))
    first = {}
    for i, k, x in lines:
        first.setdefault(root[x], (i, k))
    gone = {(i, k) for i, k, x in lines if first[root[x]] != (i, k)}
    left = []
    for i, r in enumerate(rows):
        text = None if r.text is None else "\n".join(x for k, x in enumerate(r.text.split("\n")) if (i, k) not in gone)
        if text == r.text or (text or "").split():
            left.append((r.doc_id, text, r.lang, r.source))
    sets = [set(text_shingle_set(t).tolist()) for _, t, _, _ in left]
    kept = [r for k, (r, g) in enumerate(zip(left, groups(len(left), lambda i, j: alike(sets[i], sets[j])))) if g == k]
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(kept, "doc_id long, text string, lang string, source string").toArrow())
    taken = {d: (t // s if s else 0) for d, s, t in con.sql(f"SELECT doc_id, size, taken FROM ({mixing.SQL})").fetchall()}
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    want = Counter()
    for doc, text, _, _ in kept:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        head = len(ids) % 1024 or min(len(ids), 1024)
        cuts = [0, *range(head, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc, k, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))] += taken[doc]
    got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == +want
