"""Vector codes against brute force and on edge cases; their SQL is compared in test_edges."""

import hashlib
import math
import random

import numpy as np
import pytest

from callweave.llm import part_codes

RND = random.Random(4)
SCHEMA = "vec_id bigint, embedding array<float>, label int, code int"


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(codebooks, per row (vec_id, code, error, label error)) by plain Python."""
    kept = [(i, [math.floor(scale * x) for x in map(float, np.array(v, np.float32))], label) for i, v, label, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, part: v[part * width : (part + 1) * width]
    books = [[cut(v, part) for _, v, _ in kept[:entries]] for part in range(parts)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for part, book in enumerate(books):
            taken = {}
            for _, v, _ in kept:
                taken.setdefault(best(cut(v, part), book)[1], []).append(cut(v, part))
            for e, xs in taken.items():
                book[e] = [sum(c) // len(xs) for c in zip(*xs)]
    out = []
    for i, v, label in kept:
        found = [best(cut(v, part), book) for part, book in enumerate(books)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    total = {}
    for _, _, d, label in out:
        total[label] = total.get(label, 0) + d
    return books, sorted(((i, c, d, total[label]) for i, c, d, label in out), key=str)


def vectors(n, width=16):
    centres = [[RND.gauss(0, 0.4) for _ in range(width)] for _ in range(12)]
    return [[c + RND.gauss(0, 0.1) for c in RND.choice(centres)] for _ in range(n)]


@pytest.mark.parametrize("block", [256, 3, 1])
def test_codes_equal_brute_force(spark, block):
    rows = [(1000 - i, v, i % 5 if i % 7 else None, 1) for i, v in enumerate(vectors(200))]
    rows += [(7, None, 1, 1), (8, [0.1] * 15 + [None], 1, 1), (9, [float("nan")] * 16, 1, 1), (10, [float("inf")] * 16, 2, 1)]
    rows += [(None, [0.5] * 16, None, 1), (None, [-0.00001] * 16, None, 1), rows[3], rows[3]] + [(5000 + i, [0.25] * 16, 3, 1) for i in range(60)]
    fitted = part_codes.fit(spark.createDataFrame(rows, SCHEMA), part_codes.Params(block=block))
    books, want = plain(rows)
    assert fitted.books.tolist() == books
    assert fitted.digest == hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    got = part_codes.with_label_error(fitted.rows).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == want


def test_few_equal_and_no_vectors(spark):
    some = [(2, [0.5] * 8, None, 0), (1, [0.5] * 8, None, 0), (3, [0.1] * 8, 4, 0)]
    df = spark.createDataFrame(some, SCHEMA)
    fitted = part_codes.fit(df)
    books, want = plain(some)
    assert fitted.books.tolist() == books
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in part_codes.with_label_error(fitted.rows).collect()), key=str) == want
    none = part_codes.fit(df.where("vec_id > 3"))
    assert none.rows.count() == 0 and part_codes.with_label_error(none.rows).count() == 0
    empty = part_codes.fit(spark.createDataFrame([(1, [], 1, 0), (2, [], 1, 0)], SCHEMA))
    assert {(r.vec_id, r.code, r.error) for r in empty.rows.collect()} == {(1, "00" * 8, 0), (2, "00" * 8, 0)}
    for bad in ([(1, [1.0] * 8, 1, 0), (2, [1.0] * 16, 1, 0)], [(1, [1.0] * 9, 1, 0)], [(1, [3e38] * 8, 1, 0), (2, [0.0] * 8, 1, 0)]):
        with pytest.raises(ValueError):
            part_codes.fit(spark.createDataFrame(bad, SCHEMA))


@pytest.mark.parametrize("axes,bits", [(2, 4), (3, 3), (5, 2), (1, 6), (8, 1)])
def test_curve_meets_every_cell_and_steps_to_neighbours(axes, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
    place = part_codes.hilbert(grid, bits)
    assert sorted(place.tolist()) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_shortlists_hold_every_nearest_entry():
    rng = np.random.default_rng(3)
    for _ in range(30):
        book = rng.integers(-40, 40, (9, 3))
        x = rng.integers(-10, 10, (50, 3)) + rng.integers(-40, 40, 3)
        short = part_codes.shortlists(x.min(axis=0)[None], x.max(axis=0)[None], book)[0]
        code, d = part_codes.nearest(x, book, np.flatnonzero(short))
        every = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        assert (code == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()


def test_shortlists_are_short_where_blocks_are_small(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(0, 4, 1) * 0.2 + rng.normal(0, 0.01, 16)).tolist(), 0, 0) for i in range(2000)]
    p = part_codes.Params(block=32)
    found = part_codes.whole_vectors(spark.createDataFrame(rows, SCHEMA))
    table = part_codes.blocks(part_codes.parts_table(found, p, 2, -200, 2700), p, 2, "<i2").collect()
    books = part_codes.first_books(found, p, 2)
    sizes = [int(part_codes.shortlists(np.array([r.low]), np.array([r.high]), books[r.part]).sum()) for r in table]
    assert sum(r.n for r in table) == 8 * 2000 and np.mean(sizes) < 8
