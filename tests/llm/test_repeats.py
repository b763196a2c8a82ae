"""Repeated strings and passages against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from wardwise.llm.relative_lz_dedup import Block, relative_lz_dedup, spans
from wardwise.llm.repeats import Plan, binaries
from wardwise.llm import suffix_dedup as op5
from wardwise.llm.suffix_dedup import suffix_dedup
from wardwise.llm.suffixes import common_prefixes, suffix_array

W = 50


def units(text, words):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "") if words else (text or "").encode()


def brute(rows, words):
    first = {}
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        s = units(t, words)
        for i in range(len(s) - W + 1):
            first.setdefault(tuple(s[i : i + W]), d)
    out = []
    for d, t in rows:
        if d is None:
            continue
        s = units(t, words)
        gone = [False] * len(s)
        for i in range(len(s) - W + 1):
            if first[tuple(s[i : i + W])] < d:
                gone[i : i + W] = [True] * W
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = [x for x, g in zip(s, gone) if not g]
        raw = " ".join(kept).encode() if words else bytes(kept)
        out.append((d, len(s), sum(gone), spans, hashlib.sha256(raw).hexdigest()))
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randint(1, 4)))
    passages = [[word() for _ in range(r.randint(40, 90))] for _ in range(5)]
    rows = [(1, None), (2, ""), (3, "short"), (4, "a" * 400), (5, "a" * 300), (6, " ".join(["x"] * 200)), (7, " ".join(["x"] * 120)), (None, "lost " * 60)]
    for i in range(40):
        parts = []
        for _ in range(r.randint(1, 4)):
            parts += r.choice(passages) if r.random() < 0.5 else [word() for _ in range(r.randint(1, 60))]
        rows.append((100 - i if i % 2 else 100 + i, r.choice([" ", "\n", "  "]).join(parts)))
    rows += [(500, rows[12][1]), (501, rows[12][1]), (501, rows[12][1]), (502, rows[13][1] + " tail"), (3, rows[14][1])]
    hot = [word() for _ in range(70)]
    rows += [(600 + i, " ".join([word() for _ in range(20)] + hot + [word() for _ in range(20)])) for i in range(60)]
    return rows


@pytest.mark.parametrize("hot", [512, 5])
@pytest.mark.parametrize("words", [False, True])
def test_removed_parts_equal_brute_force(docs, words, hot):
    """``hot``: anchors of more documents are taken apart into windows."""
    rows = corpus(1)
    out = (relative_lz_dedup if words else suffix_dedup)(docs(rows), hot=hot).collect()
    if words:
        got = sorted((r.doc_id, r.n_words, r.n_removed, len(r.factors), r.kept_sha256) for r in out)
        assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in out)
    else:
        got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out)
        assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in out)
    assert got == brute(rows, words)


@pytest.mark.parametrize("operator", [suffix_dedup, relative_lz_dedup])
def test_empty_table(docs, operator):
    assert operator(docs([])).collect() == []


def test_suffix_arrays_and_common_prefixes():
    rng = np.random.default_rng(0)
    for trial in range(150):
        n = int(rng.integers(1, 200))
        a = (rng.integers(0, rng.integers(1, 5) + 1, n) + 97).astype(np.uint8)
        if trial % 3 == 0 and n > 60:
            a[-30:] = a[:30]
        t = a.tobytes()
        array = suffix_array(a)
        assert list(array) == sorted(range(n), key=lambda i: t[i:])
        shared = common_prefixes(a, array)
        for i, j in zip(array[1:], array):
            k = 0
            while max(i, j) + k < n and t[i + k] == t[j + k]:
                k += 1
            assert shared[i] == k


def test_spans_end_with_their_document():
    mask = np.array([1, 1, 1, 0, 1, 1], bool)
    start, length = spans(mask, np.array([0, 2, 2, 6]))
    assert list(start) == [0, 2, 4] and list(length) == [2, 1, 2]


def block(texts, ids, window=3):
    raw = [t.encode() + b" " for t in texts]
    return Block(Plan("words", window, 1, 1, 1), np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw]), np.array(ids))


def test_factors_are_the_longest_copies_of_a_place_of_the_block():
    b = block(["a b c d e f", "x a b c d y b c d e f z", "a b c q"], [1, 2, 3])
    # The windows that cross the end of a factor are looked up: "b c d" begins a new one in the second string.
    assert sorted(zip(*map(list, b.factors()))) == [(1, 1, 4), (1, 6, 5), (2, 0, 3)]
    # A factor that ends where its source ends goes on in another source.
    b = block(["a b c d", "b c d e f", "z a b c d e f"], [1, 2, 3])
    assert sorted(zip(*map(list, b.factors()))) == [(1, 0, 3), (2, 1, 4), (2, 3, 4)]


def test_factors_compare_words_not_hashes(monkeypatch):
    from wardwise.llm import relative_lz_dedup as op10

    monkeypatch.setattr(op10, "grams", lambda h, k: np.zeros(max(0, len(h) - k + 1), np.uint64))
    b = block(["a b c d", "e f g h"], [1, 2])
    assert len(b.factors()[0]) == 0


def test_op5_takes_its_result_from_the_suffix_array(docs, monkeypatch):
    """With an array that isn't sorted, or without common prefixes, other bytes go."""
    data, sizes = np.frombuffer(b"0abcdefgh1" + b"xabcdefghy", np.uint8), np.array([10, 10])
    plan = Plan("bytes", 8, 4, 1, 1)
    right = [list(x) for x in op5.repeated_strings(plan, data, sizes, np.array([1, 2]))]
    assert right == [[1], [1], [8]]
    monkeypatch.setattr(op5, "common_prefixes", lambda text, array: np.zeros(len(text), np.int64))
    assert len(op5.repeated_strings(plan, data, sizes, np.array([1, 2]))[0]) == 0


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


@pytest.mark.parametrize("words", [False, True])
def test_words_that_sums_of_powers_confuse(docs, words):
    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    head, tail = " ".join(f"h{i}" for i in range(30)), " ".join(f"t{i}" for i in range(30))
    rows = [(1, f"{head} {one} {tail}"), (2, f"{head} {other} {tail}"), (3, one), (4, other), (5, one)]
    out = (relative_lz_dedup if words else suffix_dedup)(docs(rows)).collect()
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) if words else (r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in out)
    assert got == [(d, n, k, h) for d, n, k, _, h in brute(rows, words)]
