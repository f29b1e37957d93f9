"""Alignment, lexical search and BPE against plain Python and the tokenizers library: awkward rows, empty tables, clashing names."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pagegrist.llm import alignment, bpe, lexical_search
from pagegrist.llm.queries import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
DDL = "doc_id long, text string, ids string, made int, row long, c0 string, item int, rank int, a int"


def odd_texts(n=400):
    rng = random.Random(5)
    kinds = [lambda: rng.randrange(1, 0x250), lambda: rng.randrange(1, 0xD800), lambda: rng.randrange(0xE000, 0x110000), lambda: rng.randrange(32, 127), lambda: 32, lambda: 10]
    return ["".join(chr(rng.choice(kinds)()) for _ in range(rng.randrange(1, 120))) for _ in range(n)]


TEXTS = [
    None, "", " ", "\n", "  \n \n", "a", "aaaa", "The cat's   whiskers weren't  there.\n\n  Indented\tline ", "MIT License\nMIT License", "so it ends <|endoftext|> and <|endoftext|><|endoftext|>",
    "a▁b", "<s> </s> <unk> <0x0A>", "日本語 テキスト 中文", "🤦🏽‍♂️ naïve ﬀ ß ſ", "x" * 30_000, "ab " * 20_000, "\u0000 nul", "a b c　d", *odd_texts(),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(5, "a"), (None, "The cat's here"), (7, TEXTS[7]), (7, TEXTS[7])]
    return spark.createDataFrame([(d, t, "x", 1, 2, "y", 3, 4, 5) for d, t in rows], DDL).repartition(3).cache()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(A)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def key(row):
    return tuple((x is None, x) for x in row)


def test_bpe_equals_the_library(spark, docs, library):
    got = bpe.digests(docs, A)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = []
    for d, t in docs.select("doc_id", "text").collect():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_bpe_keeps_columns_and_decodes_ids(spark, docs):
    out = bpe.encode(docs, A)
    assert out.columns == [*docs.columns, "ids_"]
    rows = out.collect()
    assert len(rows) == docs.count() and all(r["ids"] == "x" and r["c0"] == "y" for r in rows)
    back = bpe.decode(out.select("text", "ids_"), A, "ids_").collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back)
    strange = spark.createDataFrame([([50256, -1, 10**6, 72],), (None,), ([],), ([222],)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decode(strange, A).collect()] == ["<|endoftext|>i", "", "", "�"]
    assert bpe.digests(docs.limit(0), A).count() == 0


def test_special_strings_can_be_plain_text(library):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(A)
    plain.encode_special_tokens = True
    text = "so <|endoftext|> x"
    assert bpe.Bpe(A, special=False).encode([text])[0].tolist() == plain.encode(text, add_special_tokens=False).ids != library.encode(text, add_special_tokens=False).ids


def test_settled_characters_are_split_alike(library):
    pattern = bpe.splitter()
    for c in map(chr, range(bpe.SETTLED)):
        for text in (f"a{c}1{c}!{c} {c}\t{c}", f" {c}{c} 'll{c}'s", f"x  {c}  "):
            assert [m.span() for m in pattern.finditer(text)] == [o for _, o in library.pre_tokenizer.pre_tokenize_str(text)], (c, text)


def test_index_of_pairs_by_hand():
    """Ranks in order, overlapping pairs from the left, pairs that arise beside a merge."""
    v = bpe.loaded(A)
    words = [b"aaaaa", b"", b"abababab", b"hello", b"aaaa", b"\xff\xfe"]
    ids, at = v.merged(words)

    def slow(word):
        rank = {(int(a), int(b)): (r, int(c)) for r, (a, b, c) in enumerate(zip(v.left, v.right, v.made))}
        out = [int(v.base[x]) for x in word]
        while True:
            found = [(rank[p][0], i) for i, p in enumerate(zip(out, out[1:])) if p in rank]
            if not found:
                return out
            _, i = min(found)
            out[i : i + 2] = [rank[out[i], out[i + 1]][1]]

    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [slow(w) for w in words]


def aligned(rows):
    """Plain Python: the contract of op11 word by word."""
    import sentencepiece
    from tokenizers import Tokenizer

    t, s = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    byte = bpe.byte_alphabet()
    of_a = lambda i: bytes(byte[c] for c in t.id_to_token(i))
    of_b = lambda i: bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode()
    out, counts = [], Counter()
    for d, text in rows:
        a = b = []
        if text:
            a, b = t.encode(" " + text, add_special_tokens=False).ids, s.encode(text)
            if not b"".join(map(of_a, a)) == b"".join(map(of_b, b)) == (" " + text).encode():
                a = b = []
        ends_a, ends_b = (np.cumsum([len(f(i)) for i in x]).tolist() if x else [] for f, x in ((of_a, a), (of_b, b)))
        links = [(a[ends_a.index(e)], b[ends_b.index(e)]) for e in sorted({*ends_a} & {*ends_b})]
        groups, i, j = [], 0, 0
        for e in sorted({*ends_a} & {*ends_b}):
            x, y = ends_a.index(e, i) + 1, ends_b.index(e, j) + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            i, j = x, y
        counts.update(links)
        out.append((d, len(a), len(b), len(groups), links, sha(";".join(groups)) if a else ""))
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(d, x, y, g, len(k), sum(counts[p] == most[p[1]] for p in k), sum(counts[p] for p in k), h) for d, x, y, g, k, h in out]


def test_alignment_equals_plain_python(spark, docs):
    few = docs.where("doc_id is null or doc_id < 218")
    got = alignment.align(spark, few, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = aligned([tuple(r) for r in few.select("doc_id", "text").collect() if r["text"] is None or len(r["text"]) < 50_000])
    long = {i for i, t in enumerate(TEXTS) if t and len(t) >= 50_000}
    assert not long - {15}
    rows = [tuple(r) for r in got.where("doc_id is null or doc_id <> 15").collect()]
    own = lambda r: tuple(r[i] for i in (0, 1, 2, 3, 4, 7))  # noqa: E731  the counts are of all documents, the long one too
    assert sorted(map(own, rows), key=key) == sorted(map(own, want), key=key)
    short = few.where("doc_id is null or doc_id <> 15")
    assert sorted(map(tuple, alignment.align(spark, short, A, B).collect()), key=key) == sorted(want, key=key)
    assert alignment.align(spark, docs.limit(0), A, B).count() == 0


def test_pieces_of_units_are_those_of_whole_texts():
    p = alignment.Pieces(B)
    found = [t or "" for t in TEXTS] + ["ab" + chr(c) + " " + chr(c) + "\n" + chr(c) for c in range(0, 0x3000)]
    ids, n = p.encode(found)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [p._whole(t).tolist() for t in found]


def test_words_of_chunks_are_those_of_whole_texts(library):
    """No token of either vocabulary reaches across chunks."""
    a, p = bpe.Bpe(A, special=False), alignment.Pieces(B)
    white = [c for c in map(chr, range(0x3001)) if c.isspace()]
    found = [t for t in TEXTS if t] + [f"a{x}{y}b{x}.{y}{x}1{y}\n{x} {y}" for x in white for y in white]
    for t in found:
        chunks = p.chunks(t)
        assert "".join(chunks) == " " + t and all(c[0] in " \n" for c in chunks)
        assert [w for c in chunks for w in a.words(c)] == [(" " + t)[i:j] for _, (i, j) in library.pre_tokenizer.pre_tokenize_str(" " + t)], t


def test_a_chunk_is_aligned_once(spark):
    """Whatever stands often in a task's texts goes through the array functions once."""
    text = "The cat's   whiskers weren't  there.\n\n  Indented\tline so the cat"
    one, many = (spark.createDataFrame([(i, text + " the cat" * (n > 1)) for i in range(n)], "doc_id long, text string").coalesce(1) for n in (1, 300))
    size = lambda d: alignment.tokenised(d, A, B).selectExpr("sum(size(a) + size(b))").first()[0]
    assert 0 < size(many) <= size(one) + 10


def test_chunks_begin_anew(docs, monkeypatch):
    """A task that forgets its chunks numbers them from 0 again, and its documents have as many tokens."""
    found = [pa.RecordBatch.from_pylist([{"doc_id": i, "text": t}]) for i, t in enumerate(TEXTS[1:15])]
    out = []
    for kept in (10**6, 3):
        monkeypatch.setattr(alignment, "KEPT", kept)
        out.append(pa.Table.from_batches(alignment._tokenised(A, B)(iter(found))).to_pylist())
    begun = [sum(r["first"] == 0 for r in rows) for rows in out]
    assert begun[0] == 1 < begun[1]
    own = [[(r["doc_id"], r["of_a"], r["of_b"]) for r in rows if r["first"] is None] for rows in out]
    assert own[0] == own[1] and len(own[0]) == 14


def test_a_group_that_no_end_cuts(spark):
    """One group as long as the text: no end inside is common."""
    def packed(ends, ids):
        return [(e << alignment.ID_BITS) + i for e, i in zip(ends, ids)], [(e << alignment.ID_BITS) + alignment.MARK for e in ends]

    rows = spark.createDataFrame([(1, *packed((2, 4, 6), (1, 2, 3)), *packed((1, 3, 6), (7, 8, 9)))], alignment.TOKENS)
    r = alignment.linked(rows).first()
    assert (r["n_groups"], r["groups"], r["a_link"], r["b_link"]) == (1, "1,2,3|7,8,9", [3], [9])


def ranked(docs, items, top=20):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: pattern.findall((t or "").translate(lower))
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n, total = len(held), sum(x for _, _, x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, size in held:
            m = 75 + (25 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(scores)[:top])]
    return out


def corpus(seed=4, n=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(120)] + ["Ünder", "ÉTÉ", "straße", "x9"]
    draw = lambda k: " ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=k))
    rows = [(i, draw(rng.randint(1, 60)).upper() if i % 7 == 0 else draw(rng.randint(1, 60))) for i in range(n)]
    rows += [(n + i, "w3 w50 w100, w3!") for i in range(40)]  # ties beyond the top
    rows += [(None, "w3 w50 w100"), (None, None), (3, None), (4, ""), (5, " .,;\n"), (6, "w77 " * 5000), *rows[10:14]]
    return rows, [(i, draw(rng.randint(1, 12))) for i in range(25)] + [(0, "w100 w100 w100"), (None, "w50"), (90, "nowhere"), (91, ""), (92, None), (93, "..."), (94, "W3 w3 w50")]


def test_search_equals_plain_python(spark, monkeypatch):
    rows, items = corpus()
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, item int, rank int").repartition(5)
    asked = spark.createDataFrame([(i, t, 7) for i, t in [*items, items[0]]], "item_id long, text string, doc_id long")  # one item twice
    want = sorted(ranked(rows, items), key=key)
    got = lexical_search.search(spark, docs, asked)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=key) == want
    monkeypatch.setattr(lexical_search, "ITEMS", 7)  # five blocks
    assert sorted(map(tuple, lexical_search.search(spark, docs, asked).collect()), key=key) == want
    assert lexical_search.search(spark, docs.limit(0), asked).count() == 0
    assert lexical_search.search(spark, docs, asked.limit(0)).count() == 0


def test_maxscore_drops_no_document_that_qualifies():
    rng = np.random.default_rng(8)
    for _ in range(60):
        n, top = int(rng.integers(1, 400)), int(rng.integers(1, 25))
        lists, total = {}, np.zeros(n, np.int64)
        query = [(t, int(rng.integers(1, 3))) for t in range(int(rng.integers(1, 30)))]
        for t, times in query:
            docs = np.flatnonzero(rng.random(n) < rng.random() ** 3).astype(np.int32)
            if len(docs):
                scores = rng.integers(0, rng.integers(1, 500), len(docs))
                lists[t] = docs, scores, int(scores.max())
                total[docs] += times * scores
        threshold = int(rng.integers(1, max(2, total.max() + 2)))
        live, scores = lexical_search.best(query, lists, n, threshold, top)
        assert (total[live] == scores).all()
        cut = max(threshold, int(np.sort(total)[-top]) if n >= top else 1)
        assert set(np.flatnonzero(total >= cut)) <= set(live.tolist())


def test_shards_are_bounded(spark):
    from pagegrist.llm.lexical_search import _indexed, terms

    rows, _ = corpus()
    vocabulary = {w: i for i, w in enumerate({w for _, t in rows for w in terms(t or "")})}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    batches = docs.toArrow().to_batches(max_chunksize=50)
    whole = [*_indexed(vocabulary)(iter(batches))]
    try:
        lexical_search.SHARD_POSTINGS = 300
        parts = [*_indexed(vocabulary)(iter(batches))]
    finally:
        lexical_search.SHARD_POSTINGS = 400_000
    assert len(whole) == 1 < len(parts)
    assert sum((b.column("doc_ids")[0].as_py() for b in parts), []) == whole[0].column("doc_ids")[0].as_py()
    assert all(len(b.column("docs")[0]) <= 300 for b in parts)
