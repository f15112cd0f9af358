"""Labels, vocabulary, weights, splits and reports against brute force on small tables."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from logsift.operators import features as FE
from logsift.operators import labels as L
from logsift.operators import pu
from logsift.operators import ranking as R
from logsift.operators import reports as RP
from logsift.operators import splits as S
from logsift.operators import vocabulary as V


def corpus_of(spark, rows):
    return spark.createDataFrame(rows, "line_no bigint, label string, message string")


def lines_of(spark, *messages):
    rows = [(i, m.split()) for i, m in enumerate(messages)]
    return spark.createDataFrame(rows, "line_no bigint, tokens array<string>")


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


# -- labels ------------------------------------------------------------------------------------


def test_healthy_label_takes_a_slot(spark):
    corpus = corpus_of(spark, [(0, "A", "x"), (1, "NA", "x"), (2, "B", "x"), (3, "A", "x")])
    rows, classes = L.encode_labels(corpus, "NA")
    assert [r.y for r in rows.orderBy("line_no").collect()] == [0.0, -1.0, 2.0, 0.0]
    assert rows_of(L.target_names(classes), "class_id") == [("A", 0.0), ("B", 2.0)]


def test_ignoring_healthy_leaves_no_gap(spark):
    corpus = corpus_of(spark, [(0, "A", "x"), (1, "NA", "x"), (2, "B", "x"), (3, "A", "x")])
    rows, classes = L.encode_labels(corpus, "NA", ignore_healthy=True)
    assert [r.y for r in rows.orderBy("line_no").collect()] == [0.0, 1.0, 0.0]
    assert rows_of(L.target_names(classes), "class_id") == [("A", 0.0), ("B", 1.0)]


def test_binary_truth(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (3.0,)], "y double")
    got = [r[0] for r in df.select(L.binary_truth(F.col("y"))).collect()]
    assert got == [-1.0, 1.0, 1.0]
    assert L.anomalous_only(df).count() == 2
    assert rows_of(L.class_balance(df), "y") == [(-1.0, 1), (1.0, 2)]


# -- ranking -----------------------------------------------------------------------------------


@pytest.mark.parametrize("shift", [0, 3, 20])
def test_global_rank(spark, shift):
    rng = random.Random(shift)
    rows = [(rng.randrange(1 << 44), i, rng.choice("aab")) for i in range(500)]
    rows += [(7, 1000 + i, "a") for i in range(5)]
    df = spark.createDataFrame(rows, "key bigint, id bigint, g string")
    ranked = R.global_rank(df, "key", ("id",), ("g",), shift)
    expected = {}
    for g in "ab":
        for place, row in enumerate(sorted(r for r in rows if r[2] == g)):
            expected[row[:2]] = place
    assert {(r.key, r.id): r["rank"] for r in ranked.collect()} == expected
    whole = R.global_rank(df, "key", ("id",), (), shift)
    assert sorted(r["rank"] for r in whole.collect()) == list(range(len(rows)))


# -- vocabulary and weights --------------------------------------------------------------------


def brute_weights(messages):
    first, df, lf, longest = {}, Counter(), defaultdict(set), 0
    for message in messages:
        words = message.split()
        longest = max(longest, len(words))
        for pos, word in enumerate(words):
            first.setdefault(word, len(first))
            lf[word].add(pos)
        df.update(set(words))
    return {
        word: (
            idx,
            df[word],
            len(lf[word]),
            math.log(len(messages) / (df[word] + 0.01)),
            math.log(longest / (len(lf[word]) + 0.01)),
        )
        for word, idx in first.items()
    }


@pytest.mark.parametrize(
    "messages",
    [
        ["a b", "a"],
        ["a a b"],
        ["", "b a", "", "a b a c"],
        [
            " ".join(random.Random(i).choices("abcdefghijklmnop", k=random.Random(-i).randrange(9)))
            for i in range(1, 200)
        ],
    ],
)
def test_weights(spark, messages):
    got = {r[0]: tuple(r)[1:] for r in V.fit_weights(lines_of(spark, *messages)).collect()}
    expected = brute_weights(messages)
    assert got.keys() == expected.keys()
    for word, row in expected.items():
        assert got[word] == pytest.approx(row, abs=1e-12)


def test_split_weights_equal_weights_of_each_training_set(spark):
    rng = random.Random(1)
    messages = [" ".join(rng.choices("abcdefgh", k=rng.randrange(6))) for _ in range(60)]
    rows = [(i, m.split(), i % 3) for i, m in enumerate(messages)]
    lines = spark.createDataFrame(rows, "line_no bigint, tokens array<string>, fold int")
    for swap in (False, True):
        got = V.fit_split_weights(lines, 3, swap).collect()
        for split in range(3):
            train = [m for i, m in enumerate(messages) if (i % 3 == split) == swap]
            mine = {r.token: tuple(r)[2:] for r in got if r.split == split}
            expected = brute_weights(train)
            assert mine.keys() == expected.keys()
            for word, row in expected.items():
                assert mine[word] == pytest.approx(row, abs=1e-12)


def test_vectorize_closes_up_positions(spark):
    vocab = V.fit_weights(lines_of(spark, "a b"))
    got = V.vectorize(lines_of(spark, "a z b", "z"), vocab)
    assert rows_of(got, "line_no", "pos") == [(0, 0, 0), (0, 1, 1)]


def test_vectorize_takes_the_vocabulary_of_the_lines_set(spark, monkeypatch):
    lines = lines_of(spark, "a z b", "b", "z a").selectExpr("*", "IF(line_no = 1, 1, 0) AS split")
    vocab = spark.createDataFrame([(0, "a", 0), (0, "b", 1), (1, "b", 7)], "split int, token string, idx bigint")
    expected = [(0, 0, 0, 0), (0, 0, 1, 1), (0, 2, 0, 0), (1, 1, 0, 7)]
    assert sorted(map(tuple, V.vectorize(lines, vocab, ["split"]).collect())) == expected
    monkeypatch.setattr(V, "LARGE_VOCABULARY", 1)
    many = V.vectorize(lines, vocab, ["split"])
    join = many._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in join and "SortMergeJoin" not in join
    assert sorted(map(tuple, many.collect())) == expected


@pytest.mark.parametrize("offset", [0, -7, 2**63 - 70])  # the last two do not fit into one integer
def test_split_vocabulary_has_the_numbers_of_the_weights(spark, offset):
    rng = random.Random(3)
    rows = [(i + offset, rng.choices("abcdefgh", k=rng.randrange(6)), i % 3) for i in range(60)]
    lines = spark.createDataFrame(rows, "line_no bigint, tokens array<string>, fold int")
    assert (V.place_width(lines) is None) == (offset != 0)
    for swap in (False, True):
        got = V.fit_split_vocabulary(lines, 3, swap)
        expected = V.fit_split_weights(lines, 3, swap).select("split", "token", "idx")
        assert got.columns == expected.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    assert V.place_width(lines.where("false")) is None


def test_token_stats_take_a_row_for_many_positions(spark):
    """The same counts as by (token, position), from masks of 64 positions."""
    rng = random.Random(5)
    rows = [(i * 7 % 401, rng.choices("abcdefgh", k=rng.choice([0, 1, 3, 70, 200]))) for i in range(300)]
    lines = spark.createDataFrame([*rows, (9000, None), (9001, ["new"])], "line_no bigint, tokens array<string>")
    blocks = lines.coalesce(1).mapInArrow(V._position_blocks, V._BLOCKS)
    assert blocks.where("token IS NOT NULL").count() <= 8 * 4 + 1 < V.token_places(lines).count() / 20
    got, expected = V.line_stats(lines.repartition(3)), V.token_stats(V.token_places(lines))
    assert got.dtypes == expected.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, expected.collect()))
    assert V.line_stats(lines.where("false")).isEmpty()


def test_term_counts(spark):
    got = V.line_terms(lines_of(spark, "b a b b", ""), "line_no")
    assert rows_of(got, "token") == [(0, "a", 1), (0, "b", 3)]


def test_feature_cells(spark):
    train = lines_of(spark, "a a", "a b")
    weights = V.fit_weights(train)
    cells = FE.feature_cells(train, weights, ["tf", "length", "tfidf", "tfilf"])
    got = {(r.line_no, r.block, r.idx): r.value for r in cells.collect()}
    ln = math.log
    assert got == pytest.approx(
        {
            (0, 0, 0): 2.0,
            (1, 0, 0): 2.0,
            (1, 0, 1): 1.0,
            (0, 1, 2): 2.0,
            (1, 1, 2): 2.0,
            (0, 2, 3): 2 * ln(2 / 2.01),
            (1, 2, 3): ln(2 / 2.01),
            (1, 2, 4): ln(2 / 1.01),
            (0, 3, 5): 2 * ln(2 / 2.01),
            (1, 3, 5): ln(2 / 2.01),
            (1, 3, 6): ln(2 / 1.01),
        }
    )
    unseen = FE.feature_cells(lines_of(spark, "z b z", "z"), weights, ["length"])
    assert rows_of(unseen, "line_no") == [(0, 0, 0, 1.0), (1, 0, 0, 0.0)]


def test_scaling_counts_missing_cells_as_zero(spark):
    cells = spark.createDataFrame(
        [(0, 0, 2.0), (1, 1, 4.0)], "line_no bigint, idx int, value double"
    )
    got = rows_of(FE.scale_to_unit_range(cells, F.lit(4)), "line_no")
    assert got == [(0, 0, 0.0, -1.0), (1, 1, 1.0, -1.0)]
    full = rows_of(FE.scale_to_unit_range(cells, F.lit(2)), "line_no")
    assert [r[2] for r in full] == [-1.0, 1.0]
    same = cells.withColumn("value", F.lit(3.0))
    assert [r[2] for r in FE.scale_to_unit_range(same, F.lit(2)).collect()] == [None, None]


def test_dedup_keeps_first_label(spark):
    rows = [(3, 2.0, "b"), (1, 1.0, "b"), (2, 5.0, "a")]
    df = spark.createDataFrame(rows, "line_no bigint, y double, message string")
    assert [tuple(r) for r in FE.dedup_messages(df).collect()] == [("a", 5.0), ("b", 1.0)]


# -- splits ------------------------------------------------------------------------------------


def labeled(spark, ys, gap=1):
    return spark.createDataFrame(
        [(i * gap, float(y)) for i, y in enumerate(ys)], "line_no bigint, y double"
    )


@pytest.mark.parametrize("gap", [1, 1_000_003])
def test_folds_are_contiguous_blocks_per_class(spark, gap):
    rng = random.Random(3)
    ys = rng.choices([-1, 0, 1, 2], weights=[60, 20, 15, 1], k=300) + [9, 8, 8]
    k = 4
    expected = {}
    for y in set(ys):
        members = [i for i, v in enumerate(ys) if v == y]
        short, longer = divmod(len(members), k)
        fold_of = [f for f in range(k) for _ in range(short + (f < longer))]
        for i, f in zip(members, fold_of, strict=True):
            expected[i * gap] = f
    got = S.stratified_kfold(labeled(spark, ys, gap), k)
    assert {r.line_no: r.fold for r in got.collect()} == expected


def hash_order(seed, line_no):
    return int(hashlib.md5(f"{seed}|{line_no}".encode()).hexdigest()[:15], 16), line_no


def chosen(seed, line_nos, n):
    return set(sorted(line_nos, key=lambda i: hash_order(seed, i))[:n])


@pytest.mark.parametrize(
    "n_pos, n_unl, ratio, keep_pos, keep_unl",
    [(10, 100, 8, 10, 80), (20, 100, 8, 12, 100), (3, 0, 8, 0, 0), (0, 5, 2, 0, 0)],
)
def test_force_ratio(spark, n_pos, n_unl, ratio, keep_pos, keep_unl):
    ys = [1] * n_pos + [-1] * n_unl
    got = S.force_ratio(labeled(spark, ys), ratio).collect()
    assert {r.line_no for r in got if r.y == 1} == chosen(10, range(n_pos), keep_pos)
    assert {r.line_no for r in got if r.y == -1} == chosen(
        10, range(n_pos, n_pos + n_unl), keep_unl
    )


def test_no_ratio_returns_the_input(spark):
    df = labeled(spark, [1, -1])
    assert S.force_ratio(df, 0) is df


def test_shuffle_order(spark):
    got = S.shuffle_order(labeled(spark, [1, -1] * 20))
    expected = sorted(range(40), key=lambda i: hash_order(5, i))
    assert [r.line_no for r in got.orderBy("place").collect()] == expected


def test_label_noise(spark):
    ys = [1] * 30 + [-1] * 90
    got = S.label_noise(labeled(spark, ys), 31, 10).collect()
    assert len(got) == 4 * 120
    for level, lost in ((0, 0), (10, 10), (20, 22), (30, 30)):
        mine = {r.line_no: r.y_noisy for r in got if r.percentage == level}
        relabeled = {i for i in range(30) if mine[i] == -1.0}
        assert relabeled == chosen(5, range(30), lost)
        assert all(mine[i] == -1.0 for i in range(30, 120))
    with pytest.raises(ValueError):
        S.label_noise(labeled(spark, ys), 101, 10)


def test_holdout(spark):
    got = S.holdout_split(labeled(spark, [1] * 11 + [-1] * 5)).collect()
    assert {r.line_no for r in got if r.is_holdout} == chosen(0, range(11), 2)
    with pytest.raises(Exception, match="not enough positive"):
        S.holdout_split(labeled(spark, [1, -1])).collect()


# -- positive-unlabeled arithmetic --------------------------------------------------------------


def test_pu_threshold_is_strict(spark):
    df = spark.createDataFrame(
        [(0.4, 0.8), (0.5, 0.8), (0.3, 0.0), (0.0, 0.0)], "p1 double, c double"
    )
    p1, c = F.col("p1"), F.col("c")
    got = df.select(pu.pu_score(p1, c).alias("s"), pu.pu_decision(p1, c).alias("d")).collect()
    assert [r.d for r in got] == [-1.0, 1.0, 1.0, -1.0]
    assert [r.s for r in got] == [0.5, 0.625, None, None]


# -- reports -----------------------------------------------------------------------------------


def predictions(spark, pairs):
    return spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "y double, pred double")


def brute_f1(pairs, label):
    tp = sum(a == b == label for a, b in pairs)
    wrong = sum((a == label) != (b == label) for a, b in pairs)
    return 2 * tp / (2 * tp + wrong) if tp or wrong else 0.0


def test_reports(spark):
    rng = random.Random(5)
    pairs = [(rng.choice([0, 1, 2]), rng.choice([0, 1, 3])) for _ in range(200)]
    df = predictions(spark, pairs)
    labels = sorted({x for p in pairs for x in p})
    assert RP.f1_macro(df).first()[0] == pytest.approx(
        sum(brute_f1(pairs, x) for x in labels) / len(labels)
    )
    right = sum(a == b for a, b in pairs) / len(pairs)
    assert RP.f1_micro(df).first()[0] == pytest.approx(right)
    assert RP.accuracy(df).first()[0] == pytest.approx(right)
    counts = Counter(pairs)
    assert rows_of(RP.confusion(df), "y", "pred") == [
        (float(a), float(b), counts[a, b]) for a in labels for b in labels
    ]
    matrix = RP.confusion_matrix(df).collect()
    assert [r[0] for r in matrix] == [float(x) for x in labels]
    assert [list(r)[1:] for r in matrix] == [[counts[a, b] for b in labels] for a in labels]


def test_binary_f1(spark):
    pairs = [(1, 1), (1, -1), (-1, 1), (-1, -1), (1, 1)]
    assert RP.f1_binary(predictions(spark, pairs)).first().f1 == pytest.approx(2 / 3)
    assert RP.f1_binary(predictions(spark, [(-1, -1)])).first().f1 == 0.0


def test_reports_per_group(spark):
    pairs = [(0, 1, 1), (0, 1, -1), (1, 1, 1), (1, -1, -1)]
    df = spark.createDataFrame(
        [(f, float(a), float(b)) for f, a, b in pairs], "fold int, y double, pred double"
    )
    assert rows_of(RP.f1_binary(df, ["fold"]), "fold") == [(0, pytest.approx(2 / 3)), (1, 1.0)]
    assert rows_of(RP.confusion(df, ["fold"]), "fold", "y", "pred")[:4] == [
        (0, -1.0, -1.0, 0),
        (0, -1.0, 1.0, 0),
        (0, 1.0, -1.0, 1),
        (0, 1.0, 1.0, 1),
    ]


def test_top_k_and_best_fold(spark):
    coefficients = spark.createDataFrame(
        [("A", 0, 0.5), ("A", 1, 0.9), ("A", 2, 0.5), ("B", 0, -1.0)],
        "label string, idx int, coef double",
    )
    names = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "idx int, name string")
    got = rows_of(RP.top_k_terms(coefficients, names, 2), "label", "rank")
    assert got == [("A", 1, "y", 0.9), ("A", 2, "z", 0.5), ("B", 1, "x", -1.0)]
    order = spark.createDataFrame([("A", 2.0), ("B", 1.0)], "label string, place double")
    assert rows_of(RP.top_k_terms(coefficients, names, 2, order), "label") == [("B", 1, "x", -1.0)]
    three = order.union(spark.createDataFrame([("C", 0.0)], order.schema))
    assert rows_of(RP.top_k_terms(coefficients, names, 2, three), "label", "rank") == got
    folds = spark.createDataFrame(
        [(0, 0.9, 0.1), (1, 0.9, 0.3), (2, 0.9, 0.3), (3, 0.8, 1.0)],
        "fold int, f1 double, score double",
    )
    assert RP.best_fold(folds, "f1", "score").first().fold == 1
    assert RP.best_fold(folds, "f1").first().fold == 0


def test_run_reports_skips_what_does_not_apply(spark):
    binary = predictions(spark, [(1, 1), (-1, -1)])
    multi = predictions(spark, [(0, 0), (2, 0)])
    got = RP.run_reports(["acc", "macro", "top_k_svm"], binary, multi)
    assert set(got) == {("binary", "acc"), ("binary", "macro"), ("multi", "macro")}


def test_large_vocabularies_are_hashed_not_sorted(spark, monkeypatch):
    lines = lines_of(spark, "a b a", "b c", "z")
    weights = V.fit_weights(lines_of(spark, "a b a", "b c"))
    few = FE.known_terms(lines, weights)
    monkeypatch.setattr(FE, "LARGE_VOCABULARY", 1)
    many = FE.known_terms(lines, weights)
    join = many._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in join and "SortMergeJoin" not in join
    assert few.count() == many.count() == 4
    assert few.exceptAll(many).isEmpty()


@pytest.mark.parametrize("columns", [None, 3])
def test_frequent_terms_of_large_vocabularies_stay_in_their_lines(spark, monkeypatch, columns):
    rng = random.Random(8)
    messages = ["", "unheard", *[" ".join(rng.choices("abcdefghijkl", range(12, 0, -1), k=rng.randrange(30))) for _ in range(50)]]
    weights = V.fit_weights(lines_of(spark, *messages[2:])).withColumn("col", F.when(F.col("idx") < 3, F.col("idx")))
    lines = lines_of(spark, *messages).withColumn("y", F.col("line_no") % 2)
    names = ["tfilf", "length", "tf", "tfidf"]
    cells = lambda: FE.line_cells(lines, weights, names, F.lit(20), columns)
    expected = sorted(map(repr, cells().collect()))
    monkeypatch.setattr(FE, "LARGE_VOCABULARY", 4)
    many = cells()
    assert "MapInArrow" in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(repr, many.collect())) == expected
