"""Operator 2: personal data by patterns and a linear-chain conditional random field.

The patterns give the base spans. The field labels tokens (words between white
space) from features of their shapes and neighbours and of the words around them, so
that it also sees what the patterns drop: numbers without a plus sign, numbers that
run into others, and tells a phone from an order. It is trained on the labelled lines
below (some by hand, some hundreds made by a rule from cues and forms) and decoded by
Viterbi, all sequences of a batch together. Only tokens with a digit or an @ can be part
of a span, so the tokens between two others are sequences of their own; the two words
before such a sequence and the one after it are its cues. A decoded span counts if it has
the form of its kind and touches no base span.

Nulls are empty texts without spans; rows that are repeated are searched each;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .columns import pieces, text_bytes, word_bounds

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, redacted string"

_after_at = re.compile(rb"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_local = re.compile(rb"[A-Za-z0-9._%+-]")
_dotted = re.compile(rb"[0-9.]{7,}")
# A match never begins inside a run of digits: what fails from its beginning fails from there too. So runs are read once.
_ip = re.compile(rb"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_card = re.compile(rb"[0-9]([\x20-]?[0-9])+")
_phone = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_not_digit = re.compile(rb"[^0-9]")
LOCAL = np.zeros(256, bool)
LOCAL[[*range(48, 58), *range(65, 91), *range(97, 123), *b"._%+-"]] = True

#: Labelled table: lines in which <kind>...</kind> marks what is personal. Numbers are those set aside for examples
#: and tests, none of them from a corpus.
LABELLED = """
write to <email>the.12@mail3.example.com</email> today
<email>joe@site.org</email> wrote back
mail <email>a.b@x.co.uk,</email> or call <phone>+1 (202) 555-0143</phone> now
her address is <email>anna_k@post.net.</email>
call <phone>+1 (303) 555-0171</phone> of the office
<phone>+44 20 7946 0958</phone> is the number
tel <phone>(212) 555-0187</phone> any time
phone: <phone>555-867-5309</phone> at home
phone <phone>212-555-0187</phone> or <phone>(415) 555-2671</phone> at work
ring <phone>+49 30 901820</phone> and ask
+1 <phone>(202) 555-0143</phone>
<phone>+1 (202) 555-0143</phone> <ip>203.0.113.86</ip> was seen
<phone>+1 (202) 555-0143</phone> <card>4012888888881881</card> and more
<card>4012888888881881</card> then <phone>+1 (303) 555-0171</phone> of it <ip>203.0.113.86</ip> end
from <ip>198.51.100.235</ip> at night
host <ip>10.0.0.1,</ip> and <ip>192.0.2.46!!</ip> answered
<ip>198.51.100.182</ip> <ip>12.7.4.200</ip> both
card <card>4111 1111 1111 1111</card> was used
card <card>5105-1051-0510-5100</card> expired
paid with <card>378282246310005</card> in may
<card>5500005555555559,</card> he said
number <card>6011 0009 9013 9424</card> declined
version 2.0. of the license
under license version 3. see below
in 1999 there were 12 of 300 cases
the years 2001 - 2005 and 2006
1 2 3 4 5 6 7 8 9 10 11 12
section 4.2.1 of part 3
order 20231105 came on 2023-11-05 at 12:30
price 12.50 and 1,200 or 99%
id 5f3a9c0d12e4b7 hash "9999a0ecf9c9b99fe9999999b9b99bc9"
see page 12 and lines 100-120
row 12345678 col 87654321
key="b99e99e99fd999c9" and token a1b2c3
v1.2.3 and 1.2.3.4.5 are releases
user @home said hi
use a @ b for that
total 1000000 of 2000000
2 x 4 = 8 and 3.14159
"""


#: Words before what is personal, by kind, and before what is not; forms with x for digits that are counted up. Numbers are set aside for examples.
CUES = {
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "my number is", "reach me at", "dial", "text"),
    "card": ("card", "visa", "mastercard", "paid with", "card number", "charge", "amex"),
    "ip": ("ip", "host", "server", "login from", "address", "pinged"),
    "email": ("email", "mail", "write to", "sent to"),
}
FORMS = {
    "phone": ("(212) 555-01xx", "415-555-01xx", "303.555.01xx", "21255501xx", "312 555 01xx", "1-202-555-01xx", "020 7946 00xx", "01632 9600xx", "0161 496 00xx", "1 617 555 01xx", "+1 (646) 555-01xx"),
    "card": ("4242 4242 4242 4242", "4000056655665556", "5555-5555-5555-4444", "5200 8282 8282 8210", "3782 822463 10005", "6011111111111117", "30569309025904"),
    "ip": ("192.0.2.xx", "198.51.100.xx", "203.0.113.xx"),
    "email": ("kim.xx@example.org", "lee_xx@mail.example.com", "ann@sub.example.net"),
}
OTHER_CUES = ("order", "invoice", "isbn", "page", "account", "room", "year", "total", "id", "row", "serial", "tracking", "in", "about", "section", "population", "lot", "of", "part")
OTHER_FORMS = ("40755501xx", "9780306406xx", "978-0-306-406-xx", "1234567890", "12 34 56 78 90", "20240131", "2024-01-xx", "10.5.xx", "3141592653589xx", "123 456 7890", "7946 00xx", "1000xx", "99.xx")


def made_lines() -> list[str]:
    """Every cue before some forms of its kind, other cues before other forms and before forms of numbers too, each time with other digits."""
    out: list[str] = []

    def line(cue: str, what: str) -> None:
        k = len(out)
        before, after = ("", "please ", "the ", "so ", "and ")[k % 5], (" today", "", " or later", ".", " and more", ", ok")[k % 6]
        out.append(f"{before}{cue}{':' if k % 7 == 3 else ''} {what.replace('xx', f'{k * 37 % 100:02d}')}{after}")

    for kind, cues in CUES.items():
        for i, cue in enumerate(cues):
            for form in FORMS[kind][i % 2 :: 1 + (kind == "phone" and i % 3 == 2)]:
                line(cue, f"<{kind}>{form}</{kind}>")
    for i, cue in enumerate(OTHER_CUES):
        for form in (*OTHER_FORMS[i % 2 :: 2], *FORMS["phone"][3:6:2]):
            line(cue, form)
    return out


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def formed(kind: str, text: bytes) -> bool:
    """Whether a match has the form of its kind."""
    digits = _not_digit.sub(b"", text)
    if kind == "ip":
        return all(len(p) <= 3 and int(p or b"0") <= 255 for p in (q.lstrip(b"0") for q in text.split(b".")))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15
    return True


def base_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes by the patterns; leftmost, non-overlapping within a kind."""
    out, done, at = [], 0, raw.find(b"@")
    while at >= 0:
        start = at
        while start > done and _local.match(raw, start - 1):
            start -= 1
        m = _after_at.match(raw, at) if start < at else None
        if m:
            out.append((start, m.end(), 0))
            done = m.end()
        at = raw.find(b"@", max(at + 1, done))
    for run in _dotted.finditer(raw):
        if raw.count(b".", *run.span()) > 2:
            out += [(*m.span(), 1) for m in _ip.finditer(raw, *run.span()) if formed("ip", m[0])]
    out += [(*m.span(), 2) for m in _card.finditer(raw) if m.end() - m.start() > 13 and formed("card", m[0])]
    if b"+" in raw:
        out += [(*m.span(), 3) for m in _phone.finditer(raw) if formed("phone", m[0])]
    return sorted(out, key=lambda s: (s[0], s[2]))


def shape(token: bytes) -> str:
    text = token.decode(errors="replace")
    text = re.sub("[^\\W\\d_]", "a", text)
    return re.sub(r"(.)\1{4,}", lambda m: m[1] * 5 + "~", re.sub("[0-9]", "9", text))


@lru_cache(100_000)
def own_features(token: bytes) -> tuple[str, ...]:
    s = shape(token)
    bare = s.rstrip(".,;:!?#%&*$\"')").lstrip("\"'")
    digits = sum(48 <= c < 58 for c in token)
    kind = re.sub("a+", "a", re.sub("9+", "9", re.sub("~", "", bare)))
    return (f"s={bare}", f"k={kind[:24]}", f"d={min(digits, 20)}", f"at={b'@' in token and b'.' in token.partition(b'@')[2]}", f"plus={token[:1] == b'+'}", f"par={token[:1] == b'('}", f"dots={min(token.count(b'.'), 5)}", f"dash={min(token.count(b'-'), 4)}")


_no_letter = re.compile(rb"[^a-z]+")


def cue_of(word: bytes) -> str:
    """A word as a cue: its letters a to z, whatever their case."""
    return _no_letter.sub(b"", word[:40].lower()).decode()


def features(before: bytes | None, token: bytes, after: bytes | None, cues: tuple[str, ...] = ()) -> list[str]:
    """before, after: neighbours in the same sequence; cues: the words around it, nearest first those before, then the one after."""
    own = own_features(token)
    return [*_shapes(own, before, after), *(f"cue={c}" for c in cues[:2] if c), *(f"cue={c},{own[2]}" for c in cues[:2] if c), *(f"then={c}" for c in cues[2:] if c)]


def _shapes(own: tuple[str, ...], before: bytes | None, after: bytes | None) -> list[str]:
    left = own_features(before)[1:3] if before is not None else ("none",)
    right = own_features(after)[1:3] if after is not None else ("none",)
    return [*own, *(f"<{x}" for x in left), *(f">{x}" for x in right), f"<{left[0]}{own[1]}", f"{own[1]}>{right[0]}", "one"]


def trigger(token: bytes) -> bool:
    return any(48 <= c < 58 or c == 64 for c in token)


def labelled(lines: list[str] | None = None) -> list[tuple[list[bytes], list[int], tuple[str, ...]]]:
    """The lines' sequences of tokens that can be part of a span, with labels and cues."""
    out = []
    for line in LABELLED.strip().splitlines() + made_lines() if lines is None else lines:
        tokens, labels, kind = [], [], None
        for word in re.sub(r"(</?\w+>)", r" \1 ", line).split():
            if m := re.fullmatch(r"<(\w+)>", word):
                kind, first = m[1], True
            elif word.startswith("</"):
                kind = None
            else:
                tokens.append(word.encode())
                labels.append(LABELS.index(("B-" if first else "I-") + kind) if kind else 0)
                first = False
        run: list[int] = []
        for i in [*range(len(tokens)), None]:
            if i is not None and trigger(tokens[i]):
                run.append(i)
            elif run:
                around = (run[0] - 1, run[0] - 2, run[-1] + 1)
                out.append(([tokens[j] for j in run], [labels[j] for j in run], tuple(cue_of(tokens[j]) if 0 <= j < len(tokens) else "" for j in around)))
                run = []
    return out


class Field:
    """Weights of features by label and of label pairs."""

    def __init__(self, index: dict[str, int], unary: np.ndarray, pairs: np.ndarray):
        self.index, self.unary, self.pairs = index, unary, pairs
        self.cues = frozenset(f.split("=", 1)[1] for f in index if f.startswith(("cue=", "then=")) and "," not in f)


def _allowed() -> np.ndarray:
    """I follows B or I of its kind only; the first row is the start."""
    ok = np.ones((len(LABELS) + 1, len(LABELS)), bool)
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            ok[:, j] = [False, *(a[1:] == b[1:] and a != "O" for a in LABELS)]
    return ok


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis)
    return m + np.log(np.exp(x - np.expand_dims(m, axis)).sum(axis))


@lru_cache(1)
def trained(rounds: int = 60, decay: float = 0.02, step: float = 0.15) -> Field:
    """Largest penalised likelihood of the labelled table, by adaptive gradient steps."""
    table, index = labelled(), {}
    rows = []
    for tokens, labels, cues in table:
        ids = [[index.setdefault(f, len(index)) for f in features(tokens[i - 1] if i else None, t, tokens[i + 1] if i + 1 < len(tokens) else None, cues)] for i, t in enumerate(tokens)]
        rows.append((ids, labels))
    ok, n = _allowed(), len(LABELS)
    w = [np.zeros((len(index), n)), np.zeros((n + 1, n))]
    seen = [np.full_like(x, 1e-8) for x in w]
    for _ in range(rounds):
        grads = [-decay * x for x in w]
        trans = np.where(ok, w[1], -1e4)
        for ids, labels in rows:
            e = np.array([w[0][i].sum(0) for i in ids])
            t = len(ids)
            ahead, back = np.zeros((t, n)), np.zeros((t, n))
            ahead[0] = e[0] + trans[0]
            for i in range(1, t):
                ahead[i] = e[i] + _log_sum(ahead[i - 1][:, None] + trans[1:], 0)
            for i in range(t - 2, -1, -1):
                back[i] = _log_sum(trans[1:] + (e[i + 1] + back[i + 1])[None], 1)
            total = _log_sum(ahead[-1], 0)
            for i in range(t):
                p = np.exp(ahead[i] + back[i] - total)
                g = -p
                g[labels[i]] += 1
                np.add.at(grads[0], ids[i], g)
                if i:
                    pair = np.exp(ahead[i - 1][:, None] + trans[1:] + (e[i] + back[i])[None] - total)
                    grads[1][1:] -= pair
                    grads[1][labels[i - 1] + 1, labels[i]] += 1
                else:
                    grads[1][0] += g
        for x, g, s in zip(w, grads, seen):
            s += g * g
            x += step * g / np.sqrt(s)
    return Field(index, w[0], np.where(ok, w[1], -1e4))


def viterbi(emissions: np.ndarray, start: np.ndarray, length: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Best labels of all sequences, which are rows [start, start + length) of emissions, step by step together."""
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    labels = np.zeros(len(emissions), np.int64)
    if not len(start):
        return labels
    back = np.zeros(emissions.shape, np.int8)
    score = emissions[start] + pairs[0]
    final = np.zeros(len(start), np.int64)
    for t in range(1, int(length[0]) + 1):
        live = int(np.searchsorted(-length, -t, "left"))  # sequences longer than t
        final[live : len(score)] = score[live:].argmax(1)
        if not live:
            break
        steps = score[:live, :, None] + pairs[1:]
        back[start[:live] + t] = steps.argmax(1)
        score = steps.max(1) + emissions[start[:live] + t]
    at = start + length - 1
    labels[at] = final
    for t in range(int(length[0]) - 1, 0, -1):
        live = int(np.searchsorted(-length, -t, "left"))
        labels[start[:live] + t - 1] = back[start[:live] + t, labels[start[:live] + t]]
    return labels


_trim = b".,;:!?#%&*$\"'"


def field_spans(field: Field, data: np.ndarray, offsets: np.ndarray, raw: bytes) -> dict[int, list[tuple[int, int, int]]]:
    """By text: (start, end, kind) that the field finds, in bytes of the whole batch."""
    hot = np.concatenate(([0], np.cumsum(((data >= 48) & (data < 58)) | (data == 64))))
    starts, ends, at = word_bounds(data, offsets)
    words = np.flatnonzero(hot[ends] > hot[starts])
    if not len(words):
        return {}
    text = np.searchsorted(at, words, "right") - 1
    new = np.append(True, (words[1:] != words[:-1] + 1) | (text[1:] != text[:-1]))
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(words)))
    tokens = [raw[a:b] for a, b in zip(starts[words].tolist(), ends[words].tolist())]
    cache: dict[tuple, np.ndarray] = {}
    emissions = np.empty((len(words), len(LABELS)))
    last = (first + length - 1).tolist()
    begin, end, at_word = at[text[first]].tolist(), at[text[first] + 1].tolist(), words[first].tolist()
    for a, b, lo, hi, w in zip(first.tolist(), last, begin, end, at_word):
        around = (w - 1, w - 2, w + b - a + 1)
        cues = tuple(c if c in field.cues else "" for c in (cue_of(raw[starts[k] : ends[k]]) if lo <= k < hi else "" for k in around))
        for i in range(a, b + 1):
            key = (own_features(tokens[i - 1])[1:3] if i > a else None, own_features(tokens[i]), own_features(tokens[i + 1])[1:3] if i < b else None, cues)
            if (e := cache.get(key)) is None:
                known = [field.index[f] for f in features(tokens[i - 1] if i > a else None, tokens[i], tokens[i + 1] if i < b else None, cues) if f in field.index]
                e = cache[key] = field.unary[known].sum(0)
            emissions[i] = e
    labels = viterbi(emissions, first, length, field.pairs)
    out: dict[int, list[tuple[int, int, int]]] = {}
    begins = np.flatnonzero(labels % 2 == 1)
    for i in begins.tolist():
        j = i
        while j + 1 < len(labels) and labels[j + 1] == labels[i] + 1 and not new[j + 1]:
            j += 1
        kind = (int(labels[i]) - 1) // 2
        a, b = int(starts[words[i]]), int(ends[words[j]])
        while a < b and raw[a] in _trim:
            a += 1
        while a < b and raw[b - 1] in _trim:
            b -= 1
        piece = raw[a:b]
        good = {0: re.fullmatch(rb"[^\s@]+@[^\s@]+\.[^\s@]+", piece), 1: re.fullmatch(rb"[0-9]+(\.[0-9]+){3}", piece) and formed("ip", piece), 2: formed("card", piece), 3: 10 <= len(_not_digit.sub(b"", piece)) <= 15}[kind]
        if good:
            out.setdefault(int(text[i]), []).append((a, b, kind))
    return out


def _searched(field: Field, batch: pa.RecordBatch, redact: bool) -> Iterator[tuple[int, list[tuple]]]:
    """First row and results (base counts, digest, spans, number of added ones, new text) of the parts of a batch."""
    all_data, all_offsets = text_bytes(batch.column("text"))
    for lo, hi in pieces(all_offsets):
        data, offsets = all_data[all_offsets[lo] : all_offsets[hi]], all_offsets[lo : hi + 1] - all_offsets[lo]
        raw = data.tobytes()
        hot = np.concatenate(([0], np.cumsum(((data >= 48) & (data < 58)) | (data == 64))))
        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        more = field_spans(field, data, offsets, raw)
        rows = []
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            base = base_spans(raw[a:b]) if hot[b] > hot[a] else []
            spans = [(s + a, e + a, k, True) for s, e, k in base]
            for s, e, k in more.get(i, ()):
                if all(e <= x or y <= s for x, y, _, _ in spans):
                    spans.append((s, e, k, False))
            spans.sort(key=lambda x: (x[0], x[2]))
            said = [(f"{KINDS[k]}:{chars[s] - chars[a]}:{chars[e] - chars[a]}", own) for s, e, k, own in spans]
            counts = [sum(k == j for _, _, k in base) for j in range(4)]
            text = None
            if redact:
                parts, at = [], a
                for s, e, k, _ in spans:
                    if s >= at:
                        parts += [raw[at:s], f"[{KINDS[k].upper()}]".encode()]
                    at = max(at, e)
                text = b"".join((*parts, raw[at:b])).decode()
            rows.append((*counts, hashlib.sha256(",".join(x for x, own in said if own).encode()).hexdigest(), ",".join(x for x, _ in said), len(spans) - len(base), text))
        yield lo, rows


def find_pii(docs: DataFrame, redact: bool = True) -> DataFrame:
    """Counts of base spans, their digest, all spans, and the text with every span replaced by its kind in brackets."""
    field = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.string()]
        for batch in batches:
            for lo, rows in _searched(field, batch, redact):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(rows)), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "redacted"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; n_chars, if there, is counted anew."""
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    field, columns = trained(), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, part in _searched(field, batch, True):
                texts = [None if null else r[-1] for r, null in zip(part, batch.column("text").slice(lo, len(part)).is_null().to_pylist())]
                new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in texts], batch.schema.field("n_chars").type if "n_chars" in columns else pa.int64())}
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(lo, len(part)) if c in others else new[c] for c in columns], names=columns)

    return docs.mapInArrow(run, docs.schema)


def op2_query(spark, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"), redact=False).drop("redacted")
