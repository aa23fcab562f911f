import math
import random

import numpy as np

from lexigrid.plans import catalog, culture
from lexigrid.plans.bindings import bound

FOLDER = "/root/testdata/sf0.001"


def brute(cells):
    """(slope, se, z, p) of cells (time, count, exposure) by weighted least squares until nothing moves."""
    sums = {}
    for t, y, e in cells:
        if e > 0:
            a = sums.setdefault(t, [0.0, 0.0])
            a[0] += y
            a[1] += e
    if len(sums) < 3 or not sum(y for y, _ in sums.values()):
        return None
    t = np.array(sorted(sums), float)
    y, e = (np.array([sums[x][k] for x in sorted(sums)]) for k in (0, 1))
    x = np.column_stack([np.ones_like(t), t - t.mean()])
    beta = np.array([math.log(y.sum() / e.sum()), 0.0])
    for _ in range(200):
        mu = e * np.exp(x @ beta)
        work = x @ beta + (y - mu) / mu
        root = np.sqrt(mu)
        beta, *_ = np.linalg.lstsq(x * root[:, None], work * root, rcond=None)
    mu = e * np.exp(x @ beta)
    scale = max(1e-12, ((y - mu) ** 2 / mu).sum() / max(1, len(y) - 2))
    se = math.sqrt(np.linalg.inv((x * mu[:, None]).T @ x)[1, 1] * scale)
    return beta[1], se, beta[1] / se, math.erfc(abs(beta[1] / se) / math.sqrt(2))


def close(got, want):
    return all(abs(a - b) < 1e-6 * max(1, abs(b)) for a, b in zip(got, want, strict=True))


def test_trends_by_brute_force(spark):
    rng = random.Random(1)
    rows = [(f"g{g}", year, rng.randrange(12) * (g % 5 > 0), rng.choice([0, 5, 20, 50])) for g in range(30) for year in range(2001, 2001 + g % 9) for _ in range(2)]
    got = {r.g: r for r in culture.trend(spark.createDataFrame(rows, "g string, year int, observed long, n long"), "g").collect()}
    assert set(got) == {g for g, _, _, n in rows if n > 0}
    fitted = 0
    for g, r in got.items():
        want = brute([x[1:] for x in rows if x[0] == g])
        if want is None:
            assert r.slope is None and r.p is None
        else:
            fitted += 1
            assert close((r.slope, r.se, r.z, r.p), want), (g, r, want)
    assert fitted > 10


def test_the_query_by_brute_force(spark):
    cells = {}
    for r in bound(spark, FOLDER, "narratives").collect():
        cells.setdefault(f"{r.site}/{r.report_type}", []).append((r.ts.toordinal(), r.cultural, 1))
    want = {k: w for k, v in cells.items() if (w := brute(v))}
    got = {r.place: r for r in catalog.QUERIES["yearly_trends"](spark, FOLDER).collect()}
    assert got.keys() == want.keys() and len(want) > 10
    assert all(close((r.slope, r.se, r.z, r.p), want[k]) for k, r in got.items())
    ranked = sorted(w[3] for w in want.values())
    cut = max((p for i, p in enumerate(ranked, 1) if p <= i / len(ranked) * 0.05), default=-1)
    assert all(r.rejected == (want[k][3] <= cut + 1e-7) for k, r in got.items())
