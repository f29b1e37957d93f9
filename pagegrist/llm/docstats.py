"""Counts over whole texts that the quality operators measure, vectorised over a slice of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import texts, utf8
from .hashing import shingle_hashes, word_hashes

#: Rows and bytes measured at a time.
ROWS, BYTES = 512, 4 << 20


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in runs of at most ROWS rows and about BYTES of text (a longer text alone)."""
    _, at = utf8(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = min(batch.num_rows, i + ROWS, max(i + 1, int(np.searchsorted(at, at[i] + BYTES, side="right")) - 1))
        yield batch.slice(i, j - i)
        i = j


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[[ord(c) for c in chars]] = 1
    return out


SPACE = _table(" \t\n\x0b\x0c\r")
SYMBOL = _table("#*$%&|<>")
UPPER, LOWER, DIGIT = (_table("".join(map(chr, range(ord(a), ord(b) + 1)))) for a, b in ("AZ", "az", "09"))
MARK = _table(".,;:!?-'\"()[]{}/\\_=+~^`@")
ALPHA = (UPPER + LOWER > 0).astype(np.uint8)
ALPHA[128:] = 1
CONTINUED = np.zeros(256, np.int64)
CONTINUED[0x80:0xC0] = 1
WIDE = np.zeros(256, np.int64)
WIDE[0xC0:] = 1


def _line_counts(text: str) -> tuple[int, int, int, int]:
    """Lines with a word, those equal to an earlier one, the shortest 30 characters or less, those that start with a bullet."""
    if "\n" not in text:
        full = bool(text.strip(" \t\n\x0b\x0c\r"))
        return int(full), 0, int(full and len(text) <= 30), int(full and text.lstrip(" \t")[:1] in "-*•")
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines), len(lines) - len(set(lines)), sum(len(x) <= 30 for x in lines), sum(x.lstrip(" \t")[0] in "-*•" for x in lines)


def measure(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Counts by document of a slice; bytes is a matrix of byte counts, the others are vectors."""
    data, at = utf8(batch.column("text"))
    n = batch.num_rows
    words, word_at = word_hashes(data, at, lower=False)
    out = {k: np.zeros(n, np.int64) for k in ("n_words", "n_repeat_words", "n_adjacent_repeats", "n_distinct_words", "n_letterless_words", "top_word")}
    out["bytes"] = np.zeros((n, 256), np.int64)
    word = np.append(SPACE[data] == 0, False)
    begin = word[:-1].copy()
    if len(data):
        begin[1:] &= ~word[:-2]
        begin[at[:-1][at[:-1] < len(data)]] |= word[at[:-1][at[:-1] < len(data)]]
    starts = np.flatnonzero(begin)
    lettered = np.maximum.reduceat(ALPHA[data], starts) if len(starts) else np.zeros(0, np.uint8)
    for i in range(n):
        a, b = word_at[i], word_at[i + 1]
        out["bytes"][i] = np.bincount(data[at[i] : at[i + 1]], minlength=256)
        w = words[a:b]
        out["n_words"][i] = b - a
        if a == b:
            continue
        _, counts = np.unique(w, return_counts=True)
        out["n_distinct_words"][i], out["top_word"][i] = len(counts), counts.max()
        out["n_letterless_words"][i] = (b - a) - int(lettered[a:b].sum())
        out["n_adjacent_repeats"][i] = int((w[1:] == w[:-1]).sum())
        out["n_repeat_words"][i] = repeated(w)
    lines = np.array([_line_counts(x) for x in texts(batch.column("text"))], np.int64).reshape(n, 4)
    out |= dict(zip(("n_lines", "n_dup_lines", "n_short_lines", "n_bullets"), lines.T))
    out["n_chars"] = out["bytes"].sum(axis=1) - out["bytes"] @ CONTINUED
    out["word_chars"] = out["n_chars"] - out["bytes"] @ SPACE
    out["n_symbols"] = out["bytes"] @ SYMBOL
    return out


def repeated(words: np.ndarray, size: int = 5) -> int:
    """Words in windows of this size that the text has twice or more."""
    windows = shingle_hashes(words, size)
    if len(windows) < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(size):
        covered[k : k + len(windows)] |= twice
    return int(covered.sum())
