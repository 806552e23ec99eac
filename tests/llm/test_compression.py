import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from gridpulse.llm import compression

ROWS = "vec_id long, embedding array<float>, label int, code string, error string, vector string"


def by_force(rows):
    """Codes, errors, label errors and digest, with plain loops over integers."""
    good = [(i, [float(np.float32(x)) for x in v], c) for i, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = max((len(v) for _, v, _ in good), default=0)
    size = max(-(-size // 16), 1) * 16
    most = compression.widest(size)
    ints = [(i, [max(-most, min(most, math.floor(256 * x))) for x in v] + [0] * (size - len(v)), c) for i, v, c in good]
    start = [q for _, q in sorted(((i is None, i or 0, v), q) for (i, v, _), (_, q, _) in zip(good, ints))][:64]
    w = size // 16
    cells = [[q[p * w : (p + 1) * w] for q in start] for p in range(16)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(cells[p]))

    def codes():
        return [[near(p, q[p * w : (p + 1) * w]) for p in range(16)] for _, q, _ in ints]

    for _ in range(2 if ints else 0):
        held = defaultdict(list)
        for (_, q, _), code in zip(ints, codes()):
            for p, (_, k) in enumerate(code):
                held[p, k].append(q[p * w : (p + 1) * w])
        for (p, k), xs in held.items():
            cells[p][k] = [sum(col) // len(xs) for col in zip(*xs)]
    final = codes()
    sha = hashlib.sha256(",".join(str(x) for book in cells for e in book for x in e).encode()).hexdigest()
    errors, out = defaultdict(int), []
    for (_, _, c), code in zip(ints, final):
        errors[c] += sum(d for d, _ in code)
    for (i, _, c), code in zip(ints, final):
        total = errors[c] if errors[c] < 2**63 else None
        out.append((i, "".join(f"{k:02x}" for _, k in code), sum(d for d, _ in code), total, sha))
    return sorted(out, key=repr)


def got(spark, rows):
    frame = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], ROWS)
    return sorted((tuple(r) for r in compression.vector_codes(frame).collect()), key=repr)


def drawn(seed, n, size=64, spread=0.4):
    draw = random.Random(seed)
    return [[draw.gauss(0, spread) for _ in range(size)] for _ in range(n)]


def test_codes_equal_brute_force(spark):
    rows = [(3 * i, v, i % 3 if i % 5 else None) for i, v in enumerate(drawn(1, 150))]
    rows += [(i, v, 1) for i, (_, v, _) in zip(range(1000, 1040), rows)]  # repeated vectors
    rows += [(1, [0.0] * 64, 1), (2, [-0.001] * 64, 1), (4, [0.0] * 64, None)]
    assert got(spark, rows) == by_force(rows)


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, None, 1), (2, [float("nan")] * 64, 1), (3, [None] * 64, 2), (4, [float("inf"), *[0.0] * 63], None)],
        [(1, [], 1), (2, [], None)],
        [(1, [0.5] * 20, 1), (2, [0.25] * 3, 1), (None, [1.0] * 17, None), (2, [0.25] * 3, 1), (2, [0.75] * 3, 2)],
        [(i, [float(i % 2)] * 16, 0) for i in range(70)],
        [(i, v, 0) for i, v in enumerate([[3e38] * 64, [-3e38] * 64, [1e6] * 64, [1e-40] * 64])],
    ],
    ids=["empty", "unusable", "no components", "lengths", "ties", "huge"],
)
def test_awkward_vectors_have_results(spark, rows):
    assert got(spark, rows) == by_force(rows)


def test_sums_beyond_a_long_are_null(spark):
    rows = [(i, [3e38 * (-1) ** i] * 64, 0) for i in range(2)] + [(i, [x] * 64, 0) for i, x in enumerate(np.linspace(-3e5, 3e5, 300).tolist(), 2)]
    assert got(spark, rows) == by_force(rows)


@pytest.mark.parametrize("width,spread", [(1, 10), (4, 100), (4, 3), (9, 1000)])
def test_cubes_find_the_nearest(width, spread):
    draw = np.random.default_rng(width * spread)
    book = draw.integers(-spread, spread, (64, width))
    points = np.concatenate([draw.integers(-spread, spread, (500, width)), book, draw.integers(-(10**7), 10**7, (50, width))])
    distance = ((points[:, None] - book[None]) ** 2).sum(axis=2)
    entry, best = compression.Sliced.of(book).nearest(points)
    assert (entry == distance.argmin(axis=1)).all() and (best == distance.min(axis=1)).all()


def test_cubes_leave_out_most_entries():
    draw = np.random.default_rng(5)
    book, points = draw.normal(0, 100, (64, 4)).astype(np.int64), draw.normal(0, 100, (1000, 4)).astype(np.int64)
    part = compression.Sliced.of(book)
    inside = part.cube(points, np.full(len(points), part.radius))
    assert np.bitwise_count(inside).mean() < 16
