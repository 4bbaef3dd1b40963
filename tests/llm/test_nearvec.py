import math
import random

import numpy as np

from quillspark.llm import nearvec as N

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, block string"


def brute(rows):
    good = [(i, np.array(v, np.float64), k) for i, v, k in rows
            if i is not None and k is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {n: set() for n in range(len(good))}
    for a in range(len(good)):
        for b in range(a):
            (_, x, k), (_, y, m) = good[a], good[b]
            if k == m and len(x) == len(y) and x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= N.COSINE:
                links[a].add(b)
                links[b].add(a)
    out = {}
    for n in links:
        seen, todo = {n}, [n]
        while todo:
            for m in links[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        out[good[n][0]] = len(links[n]), min(good[m][0] for m in seen)
    return out


def test_equals_brute_force_with_odd_rows(spark):
    rng = random.Random(1)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(6)]
    rows = [(i, [float(np.float32(x + rng.gauss(0, 0.3))) for x in rng.choice(centres)], rng.choice([1, 2])) for i in range(150)]
    rows += [(200 + k, rows[0][1], rows[0][2]) for k in range(30)]  # a common vector
    odd = [(300, None, 1), (301, [0.0] * 16, 1), (302, [None] * 16, 1), (303, [float("nan")] * 16, 1), (304, [1.0, 2.0], 1), (305, rows[0][1], None), (306, [], 1),
           (307, [float("inf")] + [1.0] * 15, 1), (308, [1e-30] * 16, 2), (309, [1e30] * 16, 2)]
    rows += odd
    vectors = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    want = {i: (0, i) for i, _, _ in rows} | brute(rows)
    for block in (16, 1024):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in N.near_vectors(vectors, block=block).collect()}
        assert got == want
    assert N.near_vectors(vectors.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    a, b = N.units(rng.standard_normal((300, 64))), N.units(rng.standard_normal((300, 64)))
    b[:, :] = N.units(a * 0.8 + b * 0.6)
    turn = N.rotation(64)
    estimate, bound = N.Codes(a, turn).estimates(N.Codes(b, turn))
    error = estimate - a @ b.T
    assert abs(error.mean()) < 0.005
    assert (np.abs(error) <= bound[:, None]).all()
