"""Whitening, hard negatives and k-d tree shards against brute force, and their defined cases."""

import math
import random
import zlib

import numpy as np
import pytest
import xxhash

from tandem.llm import negatives, shards, whitening

VECTORS = "vec_id long, embedding array<float>, label int, v string, part int, n long"


@pytest.fixture(scope="module")
def vectors(spark):
    """Ties, equal vectors, short ones, nulls and non-finite components, a repeated id, clashing extra columns."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(700, 12)).astype(np.float32) * np.linspace(1, 0.05, 12, dtype=np.float32) + np.float32(0.4)
    rows = [(i, [float(x) for x in v], int(rng.integers(0, 4)), "x", 1, 2) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[100][1], i % 4, "y", 1, 2) for i in range(60)]  # copies of one vector: ties everywhere
    rows += [(2000, [1.0] * 5, 1, None, 1, 2), (2001, [], 2, None, 1, 2), (2100, None, 1, "x", 1, 2), (2101, [1.0] * 12, None, "x", 1, 2),
             (2102, [float("nan")] + [0.0] * 11, 1, "x", 1, 2), (2103, [float("inf")] + [0.0] * 11, 1, "x", 1, 2), (2104, [None] + [0.5] * 11, 1, "x", 1, 2),
             (None, [0.5] * 12, 1, "x", 1, 2), rows[7], rows[200]]
    return rows


def usable(rows, scale):
    out = []
    for r in rows:
        if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1]):
            out.append((r[0], np.floor(scale * np.array(list(r[1]) + [0.0] * (12 - len(r[1])), np.float32).astype(np.float64)).astype(np.int64), r[2]))
    return out


def test_whitening_is_the_eigenvectors_of_the_covariance(spark, vectors):
    got = whitening.op11(spark.createDataFrame(vectors, VECTORS).repartition(3)).toPandas()
    rows = usable(vectors, 1024)
    x = np.array([v + 100_000 for _, v, _ in rows])
    n, total = len(x), x.sum(axis=0)
    exact = n * x - total
    y = exact / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(got) == 8 * n and set(got.n) == {n} and got.identity_error.max() < 1e-9
    w = y @ axes / np.sqrt(values)
    want = sorted((-1 if r[0] is None else r[0], int((exact[i] ** 2).sum()), k + 1, i) for i, r in enumerate(rows) for k in range(8))
    got = got.fillna({"vec_id": -1}).sort_values(["vec_id", "deviation", "component"])
    assert [(int(a), int(b), int(c)) for a, b, c in zip(got.vec_id, got.deviation, got.component)] == [t[:3] for t in want]
    mine, told, comp = got.whitened.to_numpy(), np.array([w[t[3], t[2] - 1] for t in want]), got.component.to_numpy()
    for k in range(1, 9):
        at = comp == k
        sign = np.sign((mine[at] * told[at]).sum())
        assert np.allclose(mine[at], sign * told[at], atol=1e-8)
        assert np.allclose(got.explained[at], values[k - 1] / values.sum(), rtol=1e-10)


def test_whitening_of_badly_conditioned_and_dependent_columns(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(400, 5))
    a[:, 1] = a[:, 0] + 1e-2 * a[:, 1]
    rows = [(i, [float(1e3 * v[0]), float(1e3 * v[1]), float(v[2]), float(2 * v[2]) if i % 2 else float(2 * v[2]), 7.0, float(1e-2 * v[3])], 0) for i, v in enumerate(a)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), components=6).toPandas()
    x = np.array([np.floor(1024 * np.array(r[1])) for r in rows])
    y = x - x.mean(axis=0)
    values = np.sort(np.linalg.svd(y)[1] ** 2 / len(y))[::-1]
    rank = int((values > values[0] * 1e-24).sum())
    assert rank == 5 and set(got.component) == set(range(1, rank + 1))  # the constant column gives none
    assert np.allclose(got.groupby("component").explained.first(), values[:rank] / values.sum(), rtol=1e-6)
    assert got.identity_error.max() < 1e-6


@pytest.mark.parametrize("rows", [[], [(1, [0.5, 1.0], 0)], [(i, [0.25, 4.0], 0) for i in range(5)], [(1, [], 0), (2, [], 0)], [(1, None, 0)]])
def test_nothing_to_whiten_or_mine(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert whitening.op11(df).collect() == []
    assert negatives.op12(df).collect() == []


def test_whitening_refuses_inexact_numbers(spark):
    with pytest.raises(Exception, match="too large"):
        whitening.op11(spark.createDataFrame([(1, [1e200], 0), (2, [0.0], 0)], "vec_id long, embedding array<double>, label int")).collect()


def mined(rows, every):
    rows = [(i, v, (lab + 1) % 10 if i % 7 == 0 else lab) for i, v, lab in usable(rows, 256) if i is not None and lab is not None]
    out = []
    for a, va, la in rows:
        if a % every:
            continue
        scored = [(-int(va @ v), i, lab) for i, v, lab in rows if i != a]
        for s, p, _ in sorted(x for x in scored if x[2] == la)[:5]:
            fit = [x for x in scored if x[2] != la and -30 * s <= -100 * x[0] <= -90 * s]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(sorted(fit)[:10])]
    return sorted(out)


@pytest.mark.parametrize("part, block, once", [(16_384, 2048, 2048), (40, 3, 17)])
def test_hard_negatives_equal_brute_force(spark, vectors, monkeypatch, part, block, once):
    for name, value in (("PER_PART", part), ("BLOCK", block), ("AT_ONCE", once)):
        monkeypatch.setattr(negatives, name, value)
    rows = [r for r in vectors if r[0] != 200]  # anchor rows with one id and one vector only
    label = negatives.F.when(negatives.F.col("vec_id") % 7 == 0, (negatives.F.col("label") + 1) % 10).otherwise(negatives.F.col("label"))
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    got = negatives.op12(df).collect() if part > 40 else negatives.hard_negatives(df, every=20, label=label).collect()
    want = mined(rows, 100 if part > 40 else 20)
    assert len(want) > 100 and sorted(tuple(r) for r in got) == want


def test_bounds_hold():
    rng = np.random.default_rng(1)
    v, u = rng.integers(-300, 300, (50, 37)).astype(float), rng.integers(-300, 300, (60, 37)).astype(float)
    for segments in (1, 4, 16, 99):
        (m, d), (mc, dc) = negatives.summaries(v, segments), negatives.summaries(u, segments)
        assert (np.abs(v @ u.T - m @ mc.T) <= d @ dc.T + 1e-6).all()


def keys(r, low, high):
    """Places of (source, lang, length, age), as the docstring defines them."""
    doc, text, lang, source = r
    size = len((text or "").encode()) + 16
    digits = size.bit_length()
    cat = lambda s: 0 if s is None else zlib.crc32(s.encode()) >> 9
    age = 0 if doc is None else math.floor(float(doc - low) * float(2 ** 23 - 1) / float(max(1, high - low)))
    return cat(source), cat(lang), ((digits - 1) << 17) + ((size << 17 >> digits - 1) - (1 << 17)), age


def dealt(rows, shards_wanted):
    """Brute force: {row number: shard}."""
    sizes = [len((r[1] or "").encode()) + 16 for r in rows]
    total, ids = sum(sizes), [r[0] for r in rows if r[0] is not None]
    low, high = min(ids, default=0), max(ids, default=0)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(r[1] or "", []).append(i)
    points = []
    for text, members in groups.items():
        w = sum(sizes[i] for i in members)
        if len(members) > 1 and (w > max(total // (16 * shards_wanted), max(sizes)) or len(members) > max(len(rows) // (16 * shards_wanted), 1000)):
            for i in members:
                b = rows[i][0].to_bytes(8, "little", signed=True)
                points.append((sizes[i], [k << 39 | xxhash.xxh64_intdigest(b, 42) >> 33 << 8 for k in keys(rows[i], low, high)], [i]))
        else:
            head = min(members, key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, keys(rows[i], 0, 1)[:2]))
            points.append((w, [k << 39 | xxhash.xxh64_intdigest(text.encode(), 42) >> 33 << 8 for k in keys(rows[head], low, high)], members))
    out = {}
    span = None

    def split(own, first, m):
        nonlocal span
        if m == 1 or not own:
            for p in own:
                for i in p[2]:
                    out[i] = first
            return
        extent = [(max(p[1][d] for p in own) >> 39) - (min(p[1][d] for p in own) >> 39) for d in range(4)]
        span = span or [max(1, e) for e in extent]
        width = [e / s for e, s in zip(extent, span)]
        d = width.index(max(width))
        weights = {}
        for p in own:
            weights[p[1][d]] = weights.get(p[1][d], 0) + p[0]
        whole, before = sum(weights.values()), 0
        for k in sorted(weights):
            if (before + weights[k]) * m >= whole * (m // 2):
                at = k if (before + weights[k]) * m - whole * (m // 2) <= whole * (m // 2) - before * m else k - 1
                break
            before += weights[k]
        split([p for p in own if p[1][d] <= at], first, m // 2)
        split([p for p in own if p[1][d] > at], first + m // 2, m - m // 2)
    split(points, 0, shards_wanted)
    return out


def check_shards(spark, rows, wanted, slice_rows=None, monkeypatch=None):
    if slice_rows:
        monkeypatch.setattr(shards, "SLICE_ROWS", slice_rows)
    df = spark.createDataFrame([r + (1, "x", 2) for r in rows], "doc_id long, text string, lang string, source string, shard int, g string, slot int").repartition(3)
    got = shards.kd_shards(df, shards=wanted).collect()
    expect = dealt(rows, wanted)
    facts = lambda r: (-1 if r[0] is None else r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode()))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.text_crc32, r.shard) for r in got) == sorted((*facts(r), expect[i]) for i, r in enumerate(rows))
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    return got


@pytest.mark.parametrize("wanted, slice_rows", [(7, None), (40, 5), (1, 3)])
def test_shards_equal_brute_force(spark, corpus, monkeypatch, wanted, slice_rows):
    rows = [(r[0], r[1], r[2], r[3]) for r in corpus]
    check_shards(spark, rows, wanted, slice_rows, monkeypatch)


def test_shards_of_a_hot_group_are_even_and_small_groups_stay_together(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(20, 400)))
    rows = [(i, word(), rng.choice(["en", "de", None]), "s%d" % rng.randint(0, 5)) for i in range(1500)]
    pairs = [word() for _ in range(40)]
    rows += [(5000 + i, pairs[i // 3], rng.choice(["en", "de"]), "s%d" % (i % 6)) for i in range(120)]
    rows += [(9000 + i, "hot " * 60, "en", "s0") for i in range(900)] + [(20_000 + i, None, None, None) for i in range(700)]
    got = check_shards(spark, rows, 10, 40, monkeypatch)
    size = {}
    for r in got:
        size[r.shard] = size.get(r.shard, 0) + r["size"]
    mean = sum(size.values()) / 10
    assert len(size) == 10 and max(abs(b - mean) for b in size.values()) < 0.03 * mean
    where = {}
    for r in got:
        if 5000 <= r.doc_id < 5120:
            where.setdefault((r.doc_id - 5000) // 3, set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_shards_by_target_and_of_little(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert shards.op13(spark.createDataFrame([], schema)).collect() == []
    one = shards.op13(spark.createDataFrame([(None, None, None, None)], schema)).collect()
    assert [(r.doc_id, r["size"], r.text_crc32, r.law, r.slot, r.grown_shard) for r in one] == [(None, 16, 0, "bytes", 0, None)]
    same = shards.kd_shards(spark.createDataFrame([(i, "x" * 84, "en", "a") for i in range(50)], schema), target_bytes=500).collect()
    assert len({r.shard for r in same}) == 10 and all(4 <= sum(r.shard == s for r in same) <= 6 for s in range(10))
