"""Leaks, personal data, toxicity, tokens, near duplicates on small tables."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest

from wardwise.llm import crf_pii, edit_leaks, noisy_toxicity, path_join, trie_bpe

ITEM = "The quick brown fox jumps over the lazy dog while seventeen green parrots watch from a distant wall."


def distance(a, b):
    prev = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return min(prev)


def test_leaks_equal_brute_force(spark, docs):
    r = random.Random(4)
    items = [(1, ITEM), (2, ITEM), (3, None), (4, ""), (5, "Short item here"), (6, "".join(r.choice("abcd ") for _ in range(120)))]
    rows = [(0, None), (1, ""), (2, "nothing here " * 50), (3, f"intro {ITEM.upper()} outro"), (4, ITEM.replace(" ", " - ")), (None, ITEM), (5, "x" * 100_000 + ITEM), (6, ITEM), (6, "other")]
    for i in range(30):
        t = list(r.choice([ITEM, items[5][1]]))
        for _ in range(r.randint(0, 9)):
            k = r.randrange(len(t))
            t[k : k + r.randint(0, 1)] = r.choice(["", "z", "q7"])
        rows.append((10 + i, "before " + "".join(t) + " after"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.distance for x in edit_leaks.leaks(docs(rows), bench).collect()}
    expected = {}
    for d, t in rows:
        for i, item in items:
            item = edit_leaks.plain(item)
            if d is not None and item and len(t or "") < 10_000:
                n = distance(item, edit_leaks.plain(t))
                if n <= int(0.06 * len(item)):
                    expected[d, i] = min(n, expected.get((d, i), n))
    assert {k for k in got if k[0] != 5} == set(expected) and {k for k in got if k[0] == 5} == {(5, 1), (5, 2)}
    assert all(got[k] == v for k, v in expected.items())
    kept = edit_leaks.without_leaks(docs(rows), bench)
    assert kept.columns == docs(rows).columns and {x.doc_id for x in kept.collect()} == {d for d, _ in rows} - {k[0] for k in got} - {None} | {6}
    assert edit_leaks.leaks(docs(rows), bench.limit(0)).count() == 0 and edit_leaks.leaks(docs([]), bench).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip":
                ok = all(int(x) <= 255 for x in m[0].split("."))
            elif kind == "card":
                ok = 14 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            else:
                ok = kind == "email" or 10 <= len(digits) <= 15
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


def test_base_spans_and_what_the_field_adds(docs):
    r = random.Random(2)
    texts = ["".join(r.choice("@@a.b-_+1 2(3)4.5555é\n9") for _ in range(r.randint(0, 80))) for _ in range(3000)]
    texts += [None, "", "é call +1 (980) 555-6268 224.228.19.86 now", "mail joe@site.org, or (212) 555-0187.", "a" * 4_000 + " x@y.zz", "1" * 4_000]
    rows = list(enumerate(texts))
    out = {x.doc_id: x for x in crf_pii.find_pii(docs(rows)).collect()}
    for i, t in rows:
        base = plain_spans(t or "")
        x = out[i]
        assert x.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(s.startswith(k + ":") for s in base) for k in PATTERNS]
        assert set(base) <= set(x.spans.split(",")) | {""} and len([s for s in x.spans.split(",") if s]) == len(base) + x.n_added
    n = len(rows)
    assert out[n - 4].spans == "phone:7:24,ip:25:38" and out[n - 4].redacted == "é call [PHONE] [IP] now"
    assert "phone:22:36" in out[n - 3].spans
    red = crf_pii.redacted(docs(rows[-6:] + [(None, "a@b.cc"), (1, "z 10.0.0.1")]))
    got = {(x.doc_id, x.text, x.n_chars, x.grp) for x in red.collect()}
    assert (None, "[EMAIL]", 7, 1) in got and (1, "z [IP]", 6, 1) in got and (n - 6, None, None, 1) in got
    assert crf_pii.find_pii(docs([])).collect() == []


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    pairs = rng.normal(size=(len(crf_pii.LABELS) + 1, len(crf_pii.LABELS)))
    lengths = np.array([1, 4, 2, 3])
    e = rng.normal(size=(10, len(crf_pii.LABELS)))
    start = np.cumsum(lengths) - lengths
    got = crf_pii.viterbi(e, start, lengths, pairs)
    for s, n in zip(start, lengths):
        score = lambda p: pairs[0, p[0]] + e[s, p[0]] + sum(pairs[1 + a, b] + e[s + i + 1, b] for i, (a, b) in enumerate(zip(p, p[1:])))  # noqa: B023, E731
        best = score(list(got[s : s + n]))
        for i in range(n):
            for k in range(len(crf_pii.LABELS)):
                p = list(got[s : s + n])
                p[i] = k
                assert score(p) <= best + 1e-12


def test_toxicity_is_learned_and_restored(spark, docs):
    r = random.Random(5)
    words = ["hello", "green", "table", "walks", "under", "river", "idiotic", "stone"]
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        text = [r.choice(words[:6]) for _ in range(30)]
        if bad:
            text[r.randrange(30)] = r.choice(["moron", "loser", "moron!!", "LOSER"])
        rows.append((i, " ".join(text)))
        labels.append((i, 0, int(bad)))
    extra = [(10_000, "hello m0r0n green"), (10_001, "l o s e r"), (10_002, "looooser table"), (10_003, "hello green table"), (10_004, None), (10_005, ""), (10_003, "hello green table"), (None, "moron")]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = noisy_toxicity.toxicity(docs(rows + extra), lab).collect()
    assert len(out) == len(rows) + len(extra)
    got = {x.doc_id: x for x in out}
    held = [got[i] for i, _ in rows if got[i].held_out]
    assert len(held) > 60 and all(x.predicted == int(x.doc_id % 5 == 0) and (x.score >= 0.5) == bool(x.predicted) for x in held)
    assert [got[10_000 + i].predicted for i in range(6)] == [1, 1, 1, 0, 0, 0] and got[None].predicted == 1
    kept = noisy_toxicity.without_toxic(docs(rows + extra), lab)
    assert kept.columns == docs([]).columns and kept.count() == sum(1 - x.predicted for x in out)
    assert all(x.score < 1e-9 for x in noisy_toxicity.toxicity(docs(extra[:3]), lab.limit(0)).collect())
    assert noisy_toxicity.toxicity(docs([]), lab).collect() == []


def test_letters_that_stand_alone_are_read_in_the_lattice(spark, docs):
    r = random.Random(6)
    words = ["hello", "green", "table", "walks", "a", "under", "river", "stone", "you", "are"]
    rows, labels = [], []
    for i in range(600):
        text = [r.choice(words) for _ in range(30)]
        if i % 5 == 0:
            text[r.randrange(30)] = r.choice(["moron", "loser", "idiot"])
        rows.append((i, " ".join(text)))
        labels.append((i, 0, int(i % 5 == 0)))
    bad = ["you are a l o s e r", "l 0 s e r", "m o r 0 n", "l o s e r!", "you, i d i o t.", "l\to\ns\n\ne\tr", "are you a m 0 r o n?", '"l o s e r"', "1 d 1 o t", "1053r", "1d107"]
    good = ["a t a b l e", "h e l l o!", "1 2 3 4 5 6 7", "a b c d", "é a è ü", "! ! ! $ $ $", "a 0 a 0 " * 3000, "2003 455 (1) 2 3."]
    extra = [(10_000 + i, t) for i, t in enumerate(bad + good)]
    got = {x.doc_id: x.predicted for x in noisy_toxicity.toxicity(docs(rows + extra), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert [t for (i, t) in extra if got[i] != int(t in bad)] == []


def test_bounds_of_the_labelled_sample_leave_the_odds(spark, docs, monkeypatch):
    r = random.Random(8)
    words = ["hello", "green", "table", "walks", "under", "river", "stone"]
    rows, labels = [], []
    for i in range(3000):
        text = [r.choice(words) for _ in range(12)]
        if i % 10 == 0 and i % 30 or i % 10 == 1 and i % 4 == 0:
            text[r.randrange(12)] = "moron"
        rows.append((i, " ".join(text)))
        labels.append((i, 0, int(i % 10 == 0)))
    table, lab = docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    letters = np.log(np.full((27, 27, 27), 1 / 27))
    whole = noisy_toxicity.learned(table, lab, letters)
    monkeypatch.setattr(noisy_toxicity, "TOXIC", 150)
    monkeypatch.setattr(noisy_toxicity, "CLEAN", 150)
    bounded = noisy_toxicity.learned(table, lab, letters)
    assert len(whole.hashes) and list(whole.hashes) == list(bounded.hashes)
    # The sample has one toxic row to each clean one, all rows one to nine: a constant of the sample's odds is too large by log 9.
    assert abs(whole.constant - bounded.constant) < 0.7


def test_tokens_equal_the_library(docs):
    tokenizers = pytest.importorskip("tokenizers")
    path = trie_bpe.vocabulary()
    library = tokenizers.Tokenizer.from_file(path)
    r = random.Random(1)
    alphabet = "ab's tre\n\t  'll d've　é1٣²!?'<|endoftext|> \x1c日本🙂\x85\x00"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(800)]
    texts += ["it's'sx 'tis we'll'll  'd", "a<|endoftext|> b  <|endoftext|>  c<|endoftext|><|endoftext|>", "", None, "  ", "a" * 700 + "=" * 300, " ".join("qz" * k for k in range(90)), "word " * 20_000]
    rows = list(enumerate(texts)) + [(0, texts[0])]
    out = trie_bpe.bpe(docs(rows), path).collect()
    assert len(out) == len(rows)
    for x in out:
        ids = library.encode(texts[x.doc_id] or "", add_special_tokens=False).ids
        assert x.ids == ids and x.n_tokens == len(ids) and x.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        back = library.decode(ids, skip_special_tokens=False)
        assert x.decoded == back and x.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    assert trie_bpe.bpe(docs([]), path).collect() == []


def near_brute(rows):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append((d, frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()))
    up = {d: d for d, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            p, q = root(a), root(b)
            up[max(p, q)] = min(p, q)
    return sorted((d, len(s), root(d) if s else d, (root(d) if s else d) == d) for d, s in sets)


@pytest.mark.parametrize("sizes", [{}, {"LEAF": 4, "MID": 16}, {"LEAF": 4, "MID": 16, "MORE": 0}, {"LEAF": 2, "DEEPEST": 1}])
def test_near_duplicates_equal_brute_force(docs, monkeypatch, sizes):
    """Also with nodes that are branched in a task, by Spark, or not at all, and compared in blocks."""
    for name, size in sizes.items():
        monkeypatch.setattr(path_join, name, size)
    r = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, " \n "), (3, "one two"), (4, "ONE two"), (5, "one two three"), (6, "zz " * 30_000)]
    for i in range(25):
        base = [r.choice(words) for _ in range(r.randint(20, 120))]
        for k in range(r.randint(1, 6)):
            t = list(base)
            for _ in range(r.randint(0, 6)):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append((1000 - 10 * i - k, " ".join(t)))
    base = [r.choice(words) for _ in range(150)]
    for i in range(90):  # a group larger than a leaf, some of its members linked only by way of others
        t = list(base)
        for _ in range(r.randint(0, 4)):
            t[r.randrange(len(t))] = r.choice(words)
        rows.append((5000 + i, " ".join(t)))
    hot = [r.choice(words) for _ in range(60)]
    rows += [(7000 + i, " ".join([r.choice(words) for _ in range(60)] + hot)) for i in range(60)]
    rows += [(9000 + i, rows[10][1]) for i in range(40)]
    rows.append((9000, rows[10][1]))
    got = sorted(tuple(x) for x in path_join.near_duplicates(docs(rows + [(None, "gone")])).collect())
    assert got == near_brute(rows)
    assert path_join.near_duplicates(docs([])).collect() == []


def test_words_that_sums_of_powers_confuse_are_not_alike(docs):
    s = "a"
    while len(s) < 1024:
        s += s.translate(str.maketrans("ab", "ba"))
    t = s.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"p q r {s} u v w x y"), (2, f"p q r {t} u v w x y"), (3, f"p q r {s} u v w x y"), (4, s), (5, t)]
    got = sorted(tuple(x) for x in path_join.near_duplicates(docs(rows)).collect())
    assert got == near_brute(rows) and [r[2] for r in got] == [1, 2, 1, 4, 5]


def test_rows_of_a_group_of_near_copies_follow_its_documents(docs, monkeypatch):
    """Three hundred texts that are all alike: as many pairs at most are candidates at first, not a share of all 44,850."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(300):
        words = list(base)
        words[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    seen, plain = {}, path_join.written
    monkeypatch.setattr(path_join, "written", lambda df, name: (t := plain(df, name), seen.setdefault(name, t.count()))[0])
    got = path_join.near_duplicates(docs(list(enumerate(texts)))).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 300
    assert seen.get("pairs", 0) + seen.get("partners", 0) <= 300



def test_explored_pairs_are_all_pairs_across_components_of_small_nodes():
    rng = np.random.default_rng(1)
    tokens = np.zeros((30, path_join.TOKENS), np.uint16)
    tokens[10:] = rng.integers(0, 9999, (20, path_join.TOKENS))
    node, doc = np.repeat(np.array([5, 7, 9], np.uint64), 10), np.arange(30)
    component = np.where(doc < 5, 0, doc)
    parts = list(path_join.explored(node, doc, component, tokens, 32))
    got = {(int(a), int(b)) for p in parts for a, b in zip(p[0], p[1])}
    assert got == {(a, b) for a in range(10) for b in range(a + 1, 10) if b >= 5}


def test_ip_parts_may_begin_with_any_number_of_zeros():
    raw = ("0" * 5000 + "1.2.3.4 and 0256.1.1.1 and 1.02.003.00").encode()
    assert [(a, b) for a, b, k in crf_pii.base_spans(raw) if k == 1] == [(0, 5007), (len(raw) - 11, len(raw))]


def test_long_runs_of_digits_and_dots_are_read_once():
    import re
    import time

    plain = re.compile(rb"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    rng = random.Random(9)
    for _ in range(3000):
        raw = "".join(rng.choice("0127.. x") for _ in range(rng.randint(5, 60))).encode()
        want = [m.span() for m in plain.finditer(raw) if crf_pii.formed("ip", m[0])]
        assert [(a, b) for a, b, k in crf_pii.base_spans(raw) if k == 1] == want
    begun = time.time()
    for raw in (b"7" * 1_000_000 + b".1..1.1", b"1." * 500_000, b"12.34" * 200_000 + b"...", b"." * 1_000_000):
        crf_pii.base_spans(raw)
    assert time.time() - begun < 20


def test_labelled_lines_are_not_from_the_corpus(spark):
    import glob

    found = re.findall(r"<(\w+)>(.*?)</", crf_pii.LABELLED + " ".join(crf_pii.made_lines()))
    values = {v.strip(",.!") for _, v in found}
    for path in glob.glob("/root/testdata/sf0.01/documents.parquet"):
        texts = "\n".join(r.text or "" for r in spark.read.parquet(path).select("text").collect())
        assert not [v for v in values if len(v) > 9 and v in texts]
