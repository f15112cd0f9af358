"""Whitening and vector compression against brute force on small tables."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsift.llm import norm_bounds, registered, whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors_table(spark, n=300, length=64, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(c)) for c in rng.normal(0, 0.3, length)], int(i % 3)) for i in rng.permutation(n)]
    rows += [rows[0], rows[0], (rows[1][0], rows[2][1], None)]  # repeated rows, a repeated id
    return rows, spark.createDataFrame(rows, VECTORS).repartition(5)


def odd_rows(length=64):
    nothing = [0.0] * length
    return [
        (901, None, 1),
        (902, [None, *nothing[1:]], 1),
        (903, [math.nan, *nothing[1:]], None),
        (904, [math.inf, *nothing[1:]], 2),
    ]


# -- 12: whitening ------------------------------------------------------------------------------------


def brute_whiten(vectors, components=8):
    """Exact deviations; whitened rows and shares of the variance from numpy."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    spread = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    return spread, centred @ axes[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def whitened_rows(df, **options):
    found = whitening.whiten(df, **options).select("row.*", "n", "deviation", "component", "whitened", "explained", "identity_error")
    return found.collect()


@pytest.mark.parametrize("least", [64, 640, 1 << 16])
def test_whitened_rows_equal_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(whitening, "LEAST_CELLS", least)  # one row a block, ten, all of a task
    rng = np.random.default_rng(4)
    mix = rng.normal(0, 0.2, (64, 64))
    rows = [(i, [float(np.float32(c)) for c in mix @ rng.normal(0, 1, 64) + 0.3], i % 3) for i in range(150)]
    rows += [rows[3], rows[3]]
    df = spark.createDataFrame(rows + odd_rows(), VECTORS).repartition(4)
    got = whitened_rows(df)
    spread, white, share = brute_whiten([r[1] for r in rows])
    at = {i: k for k, (i, _, _) in enumerate(rows)}
    assert len(got) == 8 * len(rows) and {r.n for r in got} == {len(rows)}
    assert sorted({(r.vec_id, int(r.deviation)) for r in got}) == sorted({(i, spread[k]) for i, k in at.items()})
    for c in range(8):
        mine = np.array([(at[r.vec_id], r.whitened) for r in got if r.component == c + 1])
        expected = white[mine[:, 0].astype(int), c]
        sign = np.sign(mine[:, 1] @ expected)
        assert np.allclose(sign * mine[:, 1], expected, atol=1e-9)
    assert {r.component: r.explained for r in got} == pytest.approx({c + 1: share[c] for c in range(8)}, rel=1e-9)
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_whitening_few_rows_and_lengths(spark):
    one = whitened_rows(spark.createDataFrame([(1, [0.5, 0.25], 0)], VECTORS))
    assert [(r.component, r.whitened, r.explained, int(r.deviation), r.identity_error) for r in one] == [
        (1, None, 0.0, 0, 0.0),
        (2, None, 0.0, 0, 0.0),
    ]
    rows = [(i, [float(i), 0.0], 0) for i in range(4)] + [(9, [1.0], 0), (10, [2.0], 0), (None, [], 1), (11, [], 0)]
    got = whitened_rows(spark.createDataFrame(rows, VECTORS))
    line = {r.vec_id: abs(r.whitened) for r in got if r.component == 1}
    assert line == pytest.approx({0: 1.5 / math.sqrt(1.25), 1: 0.5 / math.sqrt(1.25), 2: 0.5 / math.sqrt(1.25), 3: 1.5 / math.sqrt(1.25), 9: 1, 10: 1})
    assert {r.whitened for r in got if r.component == 2} == {None}
    assert {r.n for r in got if r.vec_id >= 9} == {2}


def test_whitening_holds_large_numbers(spark):
    rows = [(1, [3e38, 1.0], 0), (2, [-3e38, 2.0], 0), (3, [0.0, 3.0], 0), (4, [1e9, 1e9], 0), (5, [5e8, 7.5], 1)]
    got = whitened_rows(spark.createDataFrame(rows[3:], VECTORS))
    assert {r.vec_id: int(r.deviation) for r in got} == dict(zip((4, 5), brute_whiten([r[1] for r in rows[3:]])[0], strict=True))
    assert len(whitened_rows(spark.createDataFrame(rows, VECTORS))) == 10


def test_whitening_of_an_empty_table_and_odd_names(spark):
    assert whitened_rows(spark.createDataFrame([], VECTORS)) == []
    assert whitened_rows(spark.createDataFrame(odd_rows(), VECTORS)) == []
    rows = [(i, [0.1 * i, 0.5], "x", "y") for i in range(3)]
    df = spark.createDataFrame(rows, "`my id` long, `a.b` array<float>, row string, n string")
    found = whitening.whiten(df, vec_col="a.b", keep=["my id", "row", "n"])
    assert {tuple(r.row) for r in found.collect()} == {(i, "x", "y") for i in range(3)}


# -- 13: vector code compression ----------------------------------------------------------------------


def brute_compress(rows, parts=16, entries=64, rounds=2):
    """Every part against every entry, in plain integers."""
    kept = [(i is None, i or 0, [math.floor(256 * c) for c in v], i) for i, v in rows]
    kept = sorted(kept, key=lambda r: r[:3])
    edges = [p * len(kept[0][2]) // parts for p in range(parts + 1)]
    piece = lambda x, p: x[edges[p] : edges[p + 1]]
    books = [[piece(r[2], p) for r in kept[:entries]] for p in range(parts)]

    def nearest(x, p):
        far = [sum((a - b) ** 2 for a, b in zip(piece(x, p), e, strict=True)) for e in books[p]]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        own = [[nearest(r[2], p)[0] for p in range(parts)] for r in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [piece(r[2], p) for r, o in zip(kept, own, strict=True) if o[p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [[nearest(r[2], p) for p in range(parts)] for r in kept]
    text = ",".join(str(v) for book in books for e in book for v in e)
    digest = hashlib.sha256(text.encode()).hexdigest()
    codes = [(r[3], "".join(f"{c:02x}" for c, _ in f), sum(d for _, d in f)) for r, f in zip(kept, found, strict=True)]
    return codes, digest


def compressed(df, **options):
    made = norm_bounds.compress(df, **options)
    rows = made.rows.select("row.vec_id", norm_bounds.code_text(F.col("code")), "error", "length").collect()
    return sorted(map(tuple, rows), key=repr), made


@pytest.mark.parametrize("rounds", [0, 2, 4])
def test_codes_equal_brute_force(spark, rounds):
    rows, df = vectors_table(spark)
    df = df.unionByName(spark.createDataFrame(odd_rows(), VECTORS))
    got, made = compressed(df, rounds=rounds)
    codes, digest = brute_compress([r[:2] for r in rows], rounds=rounds)
    assert [g[:3] for g in got] == sorted(codes, key=repr)
    assert norm_bounds.codebook_digest(made.codebooks[64]) == digest
    again, unbounded = compressed(df, rounds=rounds, bounds=False)
    assert again == got
    assert all(a <= b for a, b in zip(made.rescans[64], unbounded.rescans[64], strict=True))
    if rounds == 4:  # entries come to rest, and fewer and fewer parts are compared anew
        assert made.rescans[64][-1] < 0.8 * unbounded.rescans[64][-1]


def test_codes_of_ties_and_few_rows(spark):
    rows = [(None, [1.0] * 16, 1), (3, [0.5] * 16, 1), (2, [0.5] * 16, None), (1, [0.75] * 16, None)]
    got, _ = compressed(spark.createDataFrame(rows, VECTORS))
    codes, _ = brute_compress([r[:2] for r in rows])
    assert [g[:3] for g in got] == sorted(codes, key=repr)
    one, made = compressed(spark.createDataFrame(rows[:1], VECTORS))
    assert one == [(None, "00" * 16, 0, 16)] and made.rescans[16] == [16, 0, 0]


def test_codes_of_several_lengths_and_huge_components(spark):
    rng = np.random.default_rng(2)
    by_length = {
        n: [(n * 100 + i, [float(np.float32(c)) for c in rng.normal(0, 1 + n * 1000, n)]) for i in range(80)] for n in (3, 20)
    }
    rows = [(i, v, 0) for group in by_length.values() for i, v in group] + [(7, [], 1)]
    got, _ = compressed(spark.createDataFrame(rows, VECTORS))
    expected = [(7, "00" * 16, 0, 0)]
    for n, group in by_length.items():
        expected += [(*c, n) for c in brute_compress(group)[0]]
    assert got == sorted(expected, key=repr)
    huge = spark.createDataFrame([(1, [3e38] * 16, 0), (2, [-3e38] * 16, 0)], VECTORS)
    assert [g[2] for g in compressed(huge)[0]] == [0, 0]


def test_net_displacement_is_below_the_sum_of_moves():
    history = [[np.array([[0, 0], [9, 9]])], [np.array([[3, 4], [9, 9]])], [np.array([[0, 1], [9, 9]])]]
    moved, others = norm_bounds.displacements(history, 0)
    assert moved[0, 0] == 1 and moved[1, 0] == pytest.approx(math.sqrt(18)) and not moved[2].any()
    assert others[0].tolist() == [0, 1]


def test_codes_of_an_empty_table_and_odd_names(spark):
    assert compressed(spark.createDataFrame([], VECTORS))[0] == []
    df = spark.createDataFrame([(1, [0.5] * 16, "x", "y")], "`my id` long, `a.b` array<float>, row string, code string")
    made = norm_bounds.compress(df, id_col="my id", vec_col="a.b", keep=["my id", "row", "code"])
    assert [tuple(r.row) for r in made.rows.collect()] == [(1, "x", "y")]


def test_op13_query(spark, tmp_path):
    rows, df = vectors_table(spark)
    df.unionByName(spark.createDataFrame(odd_rows(), VECTORS)).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registered.op13_norm_bounds(spark, str(tmp_path)).collect()
    codes, digest = brute_compress([r[:2] for r in rows])
    assert sorted((r.vec_id, r.code, r.error) for r in got) == sorted(codes)
    assert {r.codebooks_sha256 for r in got} == {digest}
    error = {(r.vec_id, r.code): r.error for r in got}
    total = sum(error.values()) + 2 * error[next(k for k in error if k[0] == rows[0][0])]
    assert sum({r.label_error for r in got}) == total
    assert len({r.label_error for r in got}) == 4
