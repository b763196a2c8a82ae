"""Operators 2, 4 and 6 against plainer versions of the same, on small inputs."""

import random
import re
import zlib
from itertools import product

import numpy as np

from wardwise.llm import crf_pii, noisy_toxicity, ring_shards


def readings(word, gaps):
    """Every reading of a word by the channel as (letters, chance of the channel): a character is a letter, what it
    stands for, or nothing; where gaps are read, a blank may end a word before any character."""
    t = noisy_toxicity
    options = []
    for i, c in enumerate(word):
        letters = [(c, 0.0)] if "a" <= c <= "z" else [(x, t.SWAP) for x in t.STANDS_FOR.get(c, "")]
        if c in "_*-. " or (c not in t.STANDS_FOR and not c.isalnum()):
            letters.append(("", t.DROP))
        elif i and c == word[i - 1]:
            letters.append(("", t.REPEAT))
        elif not letters:
            letters.append(("", -4.0))
        before = ["", " "] if gaps and i else [""]
        options.append([(b + x, cost) for b in before for x, cost in letters])
    for path in product(*options):
        yield "".join(x for x, _ in path), sum(cost for _, cost in path)


def chance(model, text):
    p = q = 0
    total = 0.0
    for c in text:
        x = 0 if c == " " else ord(c) - 96
        total += model[p][q][x]
        p, q = (0, 0) if x == 0 else (q, x)
    return total + model[p][q][0]


def test_restored_words_are_the_likeliest_of_all_readings():
    r = np.random.default_rng(5)
    model = np.log(r.dirichlet(np.full(27, 0.3), (27, 27)) + 1e-6)
    model -= np.log(np.exp(model).sum(2, keepdims=True))
    restorer, pick = noisy_toxicity.Restorer(model), random.Random(5)
    for gaps in (False, True):
        for _ in range(150):
            word = "".join(pick.choice("ab1o0$!3ee-*.9") for _ in range(pick.randint(1, 6)))
            got = restorer._likeliest(word, gaps)
            # A blank before anything is read, two in a row, or one at the end are no words' ends.
            every = {text: max(c for t, c in readings(word, gaps) if t == text) for text, _ in readings(word, gaps) if not re.search("^ |  | $", text)}
            best = max(c + chance(model, t) for t, c in every.items())
            assert got.strip() in every, (word, got)
            assert abs(every[got.strip()] + chance(model, got.strip()) - best) < 1e-9, (word, got)


def plain_ring(rows, shards, vnodes):
    """Shards of rows (place) one by one: first all whose own shard has room, then the others, clockwise."""
    points = ring_shards.ring(shards, vnodes)
    owners = [s for _, s in points]
    room = ring_shards.bounds(len(rows), shards)
    arcs = [next((k for k, (p, _) in enumerate(points) if place <= p), 0) for place in rows]
    where, waiting = [None] * len(rows), []
    for i in sorted(range(len(rows)), key=lambda i: (arcs[i], rows[i])):
        s = owners[arcs[i]]
        if room[s]:
            room[s] -= 1
            where[i] = s
        else:
            waiting.append(i)
    for i in waiting:
        k = arcs[i]
        while not room[owners[k % len(owners)]]:
            k += 1
        where[i] = owners[k % len(owners)]
        room[where[i]] -= 1
    return where


def test_shards_equal_a_plain_ring(docs):
    rows = [(i, f"text {zlib.crc32(str(i).encode())}") for i in range(900)]
    for shards, vnodes in ((8, 16), (3, 5)):
        out = ring_shards.ring_shards(docs(rows), shards, vnodes).select("place", "shard").collect()
        assert [x.shard for x in out] == plain_ring([x.place for x in out], shards, vnodes)


def test_one_shard_more_moves_few_rows(docs):
    table = docs([(i, f"text {i}") for i in range(3000)])
    a, b = ({x.doc_id: x.shard for x in ring_shards.ring_shards(table, n).select("doc_id", "shard").collect()} for n in (8, 9))
    moved = sum(a[i] != b[i] for i in a) / len(a)
    print("rows moved from 8 to 9 shards:", moved)
    assert 1 / 9 - 0.01 < moved < 0.35  # at least the new shard's rows; dealing anew would move eight ninths


def test_field_on_lines_held_out(monkeypatch):
    """Precision and recall of the field's spans on labelled lines that it was not trained on, in five folds."""
    lines = [x for x in crf_pii.LABELLED.split("\n") if x.strip()]
    right = found = there = 0
    for fold in range(5):
        monkeypatch.setattr(crf_pii, "LABELLED", "\n".join(x for i, x in enumerate(lines) if i % 5 != fold))
        for cached in (crf_pii.labelled, crf_pii.trained):
            getattr(cached, "cache_clear", lambda: None)()
        field = crf_pii.trained()
        for line in (x for i, x in enumerate(lines) if i % 5 == fold):
            truth, plain, at = set(), "", 0
            for m in re.finditer("<(email|ip|card|phone)>(.*?)</\\1>", line):
                plain += line[at : m.start()]
                inner = m[2].strip(".,;:!?#%&*$\"'")
                truth.add((len(plain) + m[2].index(inner), len(plain) + m[2].index(inner) + len(inner), crf_pii.KINDS.index(m[1])))
                plain, at = plain + m[2], m.end()
            plain += line[at:]
            raw = plain.encode()
            got = set(crf_pii.field_spans(field, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), raw).get(0, []))
            right, found, there = right + len(got & truth), found + len(got), there + len(truth)
    for cached in (crf_pii.labelled, crf_pii.trained):
        getattr(cached, "cache_clear", lambda: None)()
    print(f"field on held-out lines: {right} right of {found} found, {there} labelled")
    assert right / found > 0.8 and right / there > 0.6


PERSONAL = """
phone <phone>2125550187</phone>
dial <phone>020 7946 0018</phone> tonight
her mobile, <phone>07700 900123,</phone> is off
Phone: <phone>(303) 555-0177</phone>
you can call me on <phone>617 555 0149</phone>
cell <phone>5125550110,</phone> evenings
office <phone>0114 496 0999</phone>
telephone <phone>1-800-555-0199</phone> free
Card no. <card>4242 4242 4242 4242</card> exp
visa <card>4000056655665556</card>
charged to <card>5105105105105100</card> again
seen from <ip>203.0.113.9!</ip> twice
mailto <email>kim@example.org;</email>
order 2125550187 shipped
invoice 4075550123
ISBN 978-0-306-40615-7
population 8336817 in 2020
row 1 2 3 4 5 6 7 8 9 10 11
lot 7946 0018
see pages 1001 1002 1003 1004
batch 20240131 2024020112
account 1234567890
between 1914 1918 and 1939 1945
measured 123 456 7890 units
call 911
the 1000000000 barrels
"""


def test_cues_tell_numbers_apart_on_lines_of_another_form(docs):
    """Lines that the field was not trained on: other words, other forms, other numbers."""
    lines = PERSONAL.strip().split("\n")
    made = set(crf_pii.made_lines())
    assert not made & set(lines) and len(made) > 300
    want = set()
    for i, line in enumerate(lines):
        for m in re.finditer(r"<(\w+)>(.*?)</\w+>", line):
            start = len(re.sub(r"</?\w+>", "", line[: m.start()]))
            want.add((i, f"{m[1]}:{start}:{start + len(m[2].rstrip(',;!'))}"))
    got = {(r.doc_id, s) for r in crf_pii.find_pii(docs([(i, re.sub(r"</?\w+>", "", x)) for i, x in enumerate(lines)])).collect() for s in r.spans.split(",") if s}
    assert {(0, "phone:6:16"), (1, "phone:5:18")} <= got
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.9 * len(got)
