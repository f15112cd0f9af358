"""The pattern-instance bootstrap against plain Python, and what it finds and leaves alone."""

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsift.llm import pii

DOCS = "doc_id long, text string"


def fits(kind, token):
    digits = len(re.sub("[^0-9]", "", token))
    only = re.fullmatch(r"\+?[0-9().\x20-]+", token)
    return bool(
        (re.fullmatch(r"[^@]+@[^@]+", token), re.fullmatch(r"[0-9]+(?:[.:][0-9]+){3,}", token))[kind]
        if kind < 2
        else only and (13 <= digits <= 19 if kind == 2 else 7 <= digits <= 15)
    )


def brute_bootstrap(edges):
    tokens, seeds = collections.defaultdict(set), collections.defaultdict(set)
    for pattern, token, kind in edges:
        tokens[pattern].add(token)
        if kind is not None:
            seeds[token].add(kind)
    pattern_seeds = {(p, t, k) for p, t, k in edges if k is not None}
    scores = {(t, k): 1.0 for t, kinds in seeds.items() for k in kinds}
    for _ in range(pii.ROUNDS):
        trusted = {}
        for pattern, own in tokens.items():
            for kind in range(4):
                can = {t for t in own if (pattern, t, kind) in pattern_seeds or fits(kind, t)}
                p = sum(scores.get((t, kind), 0) for t in can)
                n = len(own) - len(can)
                for t in can:
                    if (pattern, t, kind) not in pattern_seeds:
                        n += sum(s for (x, k), s in scores.items() if x == t and k != kind)
                support = sum((t, kind) in scores for t in can)
                if support >= pii.SUPPORT and p / (p + n + 1) >= pii.PATTERN_SCORE:
                    trusted[pattern, kind] = p / (p + n + 1)
        found = collections.defaultdict(float)
        for (pattern, kind), trust in trusted.items():
            for t in tokens[pattern]:
                if fits(kind, t) and (pattern, t, kind) not in pattern_seeds:
                    found[t, kind] += math.log(1 - trust)
        best = {}
        for (t, kind), log in found.items():
            score = round(1 - math.exp(log), 9)
            if score >= pii.INSTANCE_SCORE and t not in seeds:
                best[t] = max(best.get(t, (-1, 0)), (score, -kind))
        new = {(t, -last): score for t, (score, last) in best.items()}
        scores = {(t, k): 1.0 for t, kinds in seeds.items() for k in kinds} | new
    return {(p, t, k) for (p, k) in trusted for t in tokens[p] if (t, k) in new and (p, t, k) not in pattern_seeds}


def test_bootstrap_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    number = lambda: "".join(map(str, rng.integers(0, 10, rng.integers(6, 17))))
    some = [number() for _ in range(40)] + [f"{a}@b.c" for a in range(20)] + [f"1.2.3.{a}" for a in range(20)] + ["v1", "x2y"]
    edges, known = [], {t: int(rng.integers(0, 4)) for t in some if rng.random() < 0.4}
    known = {t: k if fits(k, t) else next((j for j in range(4) if fits(j, t)), None) for t, k in known.items()}
    for pattern in range(40):
        pool = [t for t in some if fits(pattern % 4, t)] if pattern % 3 else some
        for t in rng.choice(pool, min(len(pool), rng.integers(3, 30)), replace=False):
            edges += [(f"p{pattern}", str(t), known.get(str(t)))] * int(rng.integers(1, 3))
    edges += [("p1", some[0], 3), ("p1", some[0], 2)]  # a seed of two kinds
    got = pii._bootstrap(spark.createDataFrame(edges, "pattern string, token string, kind int")).collect()
    expected = brute_bootstrap(edges)
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)
    assert len(expected) > 20 and len({k for *_, k in expected}) > 1


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    return {r.doc_id: [texts[r.doc_id][s["start"] : s["end"]] for s in r.added] for r in pii.personal_data(df).collect()}


def seeds(n, words="please ring my cell number {} today"):
    return [words.format(f"+1 (988) 555-{2000 + i}") for i in range(n)]


@pytest.mark.parametrize("unseen", [3, 6, 12, 50])
def test_however_many_are_unseen(spark, unseen):
    texts = seeds(20) + [f"now my cell number 555-777-{8000 + i} is new" for i in range(unseen)]
    got = found(spark, texts + ["number 555-777-9999 alone"])
    assert all(got[20 + i] == [f"555-777-{8000 + i}"] for i in range(unseen))
    assert not got[20 + unseen] and not any(got[i] for i in range(20))


def test_digit_groups_are_one_number(spark):
    texts = [*seeds(30), "now my cell number 555 777 8888 is new", "a cell number 555  777 8888 no", "cell number (555) 777 8888, ok"]
    got = found(spark, texts)
    assert got[30] == ["555 777 8888"] and not got[31] and got[32] == ["(555) 777 8888"]


def test_a_found_number_makes_a_pattern_of_the_next_round(spark):
    """The second context has no seed at all: the numbers found in the first one vouch for it."""
    numbers = [f"555-777-{8000 + i}" for i in range(12)]
    texts = seeds(20) + [f"my cell number {n} x" for n in numbers]
    texts += [f"customer hotline reads {n} sharp" for n in numbers] + ["customer hotline reads 555-999-1234 sharp"]
    got = found(spark, texts)
    assert got[len(texts) - 1] == ["555-999-1234"]


def test_a_context_with_other_things_is_not_trusted(spark):
    texts = seeds(20) + [f"my cell number v{i}.{i} is odd" for i in range(8)] + ["my cell number 555-777-8888 is odd"]
    assert not any(found(spark, texts).values())
    few = seeds(4) + ["my cell number 555-777-8888 is odd"]
    assert not any(found(spark, few).values())


def test_candidates_of_very_long_runs(spark):
    texts = ["1 2 " * 10_000, "12 " * 20_000 + "x", "(" * 50_000, "1" * 100_000, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    n = df.select(F.size(pii.candidates(pii.plain(F.col("text")))).alias("n")).collect()
    assert [r.n for r in n] == [20_000, 20_000, 0, 1, 0, 0]
