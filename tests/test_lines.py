"""Lines put together from pieces."""

import random

from wardwise.operators import lines

SCHEMA = "line_id long, piece string, x1 double, y1 double, x2 double, y2 double"


def pieces_of(line, path, rng, close=False):
    pairs = list(zip(path, path[1:])) + ([(path[-1], path[0])] if close else [])
    return [(line, f"{rng.random()}", *(a + b if rng.random() < 0.5 else b + a)) for a, b in pairs]


def chains(spark, rows):
    out = {}
    for r in lines.merged_lines(spark.createDataFrame(rows, SCHEMA)).orderBy("line_id", "part", "seq").collect():
        out.setdefault((r.line_id, r.part), []).append((r.seq, (r.x1, r.y1), (r.x2, r.y2)))
    for path in out.values():
        assert [s for s, *_ in path] == list(range(1, len(path) + 1))
        assert all(a[2] == b[1] for a, b in zip(path, path[1:]))
    return {k: [path[0][1], *[p[2] for p in path]] for k, path in out.items()}


def test_pieces_in_any_order_make_the_same_lines(spark):
    rng = random.Random(2)
    long = [(float(i), rng.random()) for i in range(70)]
    loop = [(0.0, 0.0), (1.0, -1.0), (2.0, 0.0), (1.0, 1.0)]
    fork = [[(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)], [(2.0, 0.0), (3.0, 1.0)], [(2.0, 0.0), (3.0, -1.0), (4.0, -1.0)]]
    apart = [[(0.0, 0.0), (1.0, 0.0)], [(5.0, 0.0), (6.0, 0.0), (7.0, 0.0)]]
    found = []
    for _ in range(2):
        rows = pieces_of(1, long, rng) + pieces_of(2, loop, rng, close=True)
        rows += [p for path in fork for p in pieces_of(3, path, rng)] + [p for path in apart for p in pieces_of(4, path, rng)]
        rows += pieces_of(5, [(9.0, 9.0), (8.0, 8.0)], rng) + [(6, "a", 1.0, 1.0, 1.0, 1.0), (6, "b", None, 1.0, 1.0, 1.0)]
        rows += pieces_of(7, [(0.0, 0.0), (1.0, 1.0)], rng) * 1 + [(7, "back", 1.0, 1.0, 0.0, 0.0)]  # there and back
        rng.shuffle(rows)
        found.append(chains(spark, rows))
    assert found[0] == found[1]
    got = found[0]
    assert got[1, 1] == long
    assert got[2, 1] == [(0.0, 0.0), (1.0, -1.0), (2.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    assert sorted(got[3, p] for p in (1, 2, 3)) == sorted([fork[0], fork[1], fork[2]])
    assert [got[4, 1], got[4, 2]] == apart
    assert got[5, 1] == [(8.0, 8.0), (9.0, 9.0)]
    assert got[7, 1] == [(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    assert not any(k[0] == 6 for k in got)


def test_no_pieces(spark):
    assert lines.merged_lines(spark.createDataFrame([], SCHEMA)).collect() == []
