"""Cleaning and parsing rules on hand-made lines."""

import pytest
from pyspark.sql import functions as F

from logsift.functions import text as T
from logsift.operators import preprocess as P


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "s string").select(column(F.col("s"))).first()[0]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("Mayor Market", "or ket"),
        ("node:card up", "card up"),
        ("café ok", "ok"),
        ("12 0x3f", ""),
        ("", ""),
        ("  spaced\tout\x85words  ", "spaced out words"),
        ("at 10.0.16.7 and 1.2. left", "at and left"),
        ("23:59:01 boot (cpu0) [done]", "boot done"),
        ("a:b:c tail", "c tail"),
        ("::x:y z", "z"),
        ("path/to-file=x<y>.z", "path to file x y z"),
        (
            'RAS:3 { Jan 01 00:08:25 10.0.16.7 KERNEL INFO : node:card-16 view handler() failed '
            '[16] Mayor/path <id=3>: retry  {"k": 26}',
            "KERNEL INFO card view handler failed or path id retry",
        ),
    ],
)
def test_clean_parameters(spark, raw, expected):
    assert one(spark, raw, T.clean_parameters) == expected


def test_free_colons(spark):
    got = one(spark, "a: b :c d:: e", lambda c: F.regexp_replace(c, T.FREE_COLON, ""))
    assert got == "a b c d: e"


def test_long_tokens_stay_linear(spark):
    blob = "1" * 200_000 + " " + "x" * 200_000 + " " + "a:" * 50_000 + " end"
    assert one(spark, blob, T.clean_parameters) == "x" * 200_000 + " a end"


def test_strip_and_tokens(spark):
    assert one(spark, "　 a b\x1f\n", T.strip) == "a b"
    assert one(spark, " \t ", T.strip) == ""
    assert one(spark, " a b  c ", T.tokens) == ["a", "b", "c"]
    assert one(spark, "   ", T.tokens) == []


@pytest.mark.parametrize(
    "line, expected", [("first second  third", "second third"), ("only", ""), ("", "")]
)
def test_drop_first_token(spark, line, expected):
    assert one(spark, line, T.drop_first_token) == expected


@pytest.mark.parametrize(
    "line, n, expected",
    [
        ("", 2, []),
        ("x y", 3, ["x y"]),
        ("x y z", 3, ["x y z"]),
        ("a b c d", 2, ["a b", "b c", "c d"]),
        ("a b", 1, ["a", "b"]),
    ],
)
def test_ngrams(spark, line, n, expected):
    assert one(spark, line, lambda c: T.ngrams(T.tokens(c), n)) == expected


def bgl(spark, *lines):
    raw = spark.createDataFrame(list(enumerate(lines)), "line_no bigint, raw string")
    return [tuple(r) for r in P.preprocess_bgl(raw).orderBy("line_no").collect()]


def test_bgl_rules(spark):
    head = "117 R02-M1-N0-C RAS KERNEL "
    rows = bgl(
        spark,
        head + "FATAL date   instruction cache parity error corrected",
        head + "INFO date   instruction cache parity error corrected",
        head + "WARN date   instruction cache parity error corrected",
        "x" + head + "FATAL date   instruction cache parity error corrected",
        head + "FATAL date   too short a body",
        "117 no separator KERNEL FATAL   instruction cache parity error corrected",
        head + "FATAL date   dump x'00' and x'ff' data storage interrupt happened here",
        head + "ERROR date   1234567890 1234567890 1234567890",
        head + "WARNING date   instruction cache parity error corrected",
    )
    assert rows == [
        (0, "KERNEL", "instruction cache parity error corrected"),
        (1, "unlabeled", "instruction cache parity error corrected"),
        (6, "KERNEL", "data storage interrupt happened here"),
    ]


def test_paired_join_stops_at_shorter(spark):
    truth = spark.createDataFrame([(0, " 7 "), (1, "8")], "line_no bigint, label string")
    raw = spark.createDataFrame(
        [(0, "id one two"), (1, "id 99"), (2, "id three")], "line_no bigint, raw string"
    )
    corpus = P.preprocess_paired(P.positional_join(truth, raw))
    assert [tuple(r) for r in corpus.collect()] == [(0, "7", "one two")]


def test_parse_corpus_drops_blank_lines(spark):
    lines = spark.createDataFrame(
        [(0, "A one  two "), (1, "  "), (2, "B")], "line_no bigint, value string"
    )
    got = [tuple(r) for r in P.parse_corpus(lines).orderBy("line_no").collect()]
    assert got == [(0, "A", "one two"), (2, "B", "")]


def test_cleaning_stands_once_in_the_plan(spark):
    raw = spark.createDataFrame([(0, "7", "id a b")], "line_no bigint, label string, raw string")
    plan = P.preprocess_paired(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Mar|Apr") == 1
