"""Hard negatives against all scores of a small table."""

import math
import random

import numpy as np
import pytest

from tidemark.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, q string, place string, strip string"


def expected(rows):
    """All anchors against all rows; rows are (vec_id, embedding, label)."""
    kept = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in v))
        if row not in kept:
            kept.append(row)
    out = []
    for a in kept:
        if a[0] % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in kept if b is not a))
        for s, p, _ in [x for x in scored if x[2] == a[1]][:5]:
            fit = [x for x in scored if x[2] != a[1] and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(a[0], p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA).repartition(3)
    out = negatives.mine(negatives.labelled(df))
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()))


def clustered(seed, n, width=6):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(12, width))
    return [(int(i * 10), [float(x) for x in centres[rnd.integers(12)] + .2 * rnd.normal(size=width)],
             int(rnd.integers(4))) for i in rnd.permutation(n)]


def hard_cases():
    rows = clustered(1, 400)
    rows += [(5_000 + i, [.5] * 6, 1) for i in range(300)]  # one hot vector: ties go by id
    rows += [rows[3], rows[3], (rows[4][0], [.1] * 6, 2)]  # repeated rows; a shared id
    rows += [(9_100, None, 1), (9_200, [1.0] * 6, None), (None, [1.0] * 6, 1), (9_300, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1),
             (9_400, [float("nan")] * 6, 1), (9_500, [float("inf")] + [0.0] * 5, 1), (9_600, [], 2), (9_700, [.5, .25], 2),
             (9_800, [-9.0] * 6, 77), (9_900, [0.0] * 6, 1)]
    return rows


def test_mine(spark):
    assert mined(spark, hard_cases()) == expected(hard_cases())


def test_many_strips(spark, monkeypatch):
    monkeypatch.setattr(negatives, "STRIP_BYTES", 8_000)
    rows = hard_cases()
    assert mined(spark, rows) == expected(rows)


def test_huge_components(spark):
    rnd = random.Random(4)
    rows = [(i * 50, [rnd.choice([1e5, 2e5, 3.5e6, -1e4]) * rnd.random() for _ in range(5)], i % 2) for i in range(40)]
    assert mined(spark, rows) == expected(rows)


def test_no_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, None, None)]) == []
    assert mined(spark, [(100, [1.0], 1)]) == []


def test_hilbert_neighbours():
    """Along the curve every cell comes once and each step is to a neighbouring cell."""
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        place = negatives.hilbert(cells, bits)
        assert sorted(place.tolist()) == list(range(side ** dims))
        assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("seed", range(3))
def test_bounds_hold(seed):
    rnd = np.random.default_rng(seed)
    q, a = rnd.integers(-300, 300, (50, 8)).astype(float), rnd.integers(-300, 300, (9, 8)).astype(float)
    turned = np.linalg.qr(rnd.normal(size=(8, 8)))[0]
    b = negatives._Blocks.__new__(negatives._Blocks)
    b.lo, b.hi = (q @ turned).min(0)[None], (q @ turned).max(0)[None]
    lo, hi = b.bounds(a, turned)
    assert (lo <= (a @ q.T).min(1)[:, None]).all() and (hi >= (a @ q.T).max(1)[:, None]).all()


def test_zone_maps_spare_blocks(spark, monkeypatch):
    """On clustered vectors most blocks of other clusters are not read."""
    monkeypatch.setattr(negatives, "STRIP_BYTES", 1 << 30)
    rnd = np.random.default_rng(7)
    centres = np.eye(8) * 4
    rows = [(i, [float(x) for x in centres[i % 8] + .05 * rnd.normal(size=8)], i % 3) for i in range(16_000)]
    df = spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA).where("vec_id >= 0")
    index = negatives.Index(negatives.labelled(df), 4_000)
    blocks = index.strips.agg({"blocks": "sum"}).first()[0]
    read = index.best(None).agg({"n_blocks": "max"}).first()[0]
    assert blocks >= 60 and read < blocks / 2
