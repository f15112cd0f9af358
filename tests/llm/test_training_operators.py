"""Every operator against brute force, an exact round trip or held-out accuracy, on small tables."""

import collections
import hashlib
import math
import re
import time
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from logsift.llm import (
    chat,
    compression_quality,
    decontaminate,
    golay_dedup,
    katz,
    mixing,
    packing,
    pii,
    prefix_forest,
    rans,
    token_files,
    toxicity_fm,
)
from logsift.llm.components import components
from logsift.sources import scratch
from logsift.sources.scratch import scratch_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(60)] + ["The", "Éa", "ñu", "x.y", "don't"]
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def random_texts(n, seed=0, size=40):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(WORDS, rng.integers(1, size))) for _ in range(n)]


def odd_texts():
    return [None, "", " ", "\n\t ", "a", "A b", "a b", "é\u2028x  y", "w1 " * 3000, "\ue000w1\ue001 \x1c"]


@pytest.fixture(scope="module")
def docs(spark):
    texts = random_texts(60) + odd_texts() + ["w1 w2 w3 w4"] * 5
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", 1) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id", None, None, None), (None, None, None, "s1", None)]
    return spark.createDataFrame(rows, DOCS).repartition(4)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df, *names):
    return df.select("*", *[F.lit("x").alias(n) for n in names if n not in df.columns])


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- 1: nearest neighbours --------------------------------------------------------------------------


def brute_nearest(ids, vectors, asked, k):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(asked):
        score = unit @ unit[i]
        best = [j for j in np.lexsort((ids, -score.round(12))) if j != i][:k]
        out[int(ids[i])] = [int(ids[j]) for j in best]
    return out


def test_nearest_recall_blocks_and_chunks(spark):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((3000, 64))
    vectors[1000:2000] = vectors[0] + 0.01 * rng.standard_normal((1000, 64))  # a dense third
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ask = F.col("vec_id") % 50 == 0
    found = prefix_forest.nearest(df, is_query=ask, block_rows=700, chunk_queries=25).collect()
    expected = brute_nearest(np.arange(3000), vectors, np.arange(3000) % 50 == 0, 5)
    got = collections.defaultdict(list)
    for r in sorted(found):
        got[r.query_id].append(r.vec_id)
        cosine = vectors[r.query_id] @ vectors[r.vec_id]
        cosine /= np.linalg.norm(vectors[r.query_id]) * np.linalg.norm(vectors[r.vec_id])
        assert r.score == pytest.approx(cosine, abs=1e-12)
    hits = sum(len(set(got[q]) & set(best)) for q, best in expected.items())
    assert hits >= 0.9 * 5 * len(expected)
    assert all(len(v) == 5 for v in got.values())


@pytest.mark.parametrize("cosine", [0.5, 0.63, 0.76, 0.9])
def test_nearest_recall_in_a_loose_cluster(cosine):
    rng = np.random.default_rng(5)
    vectors, centre = rng.standard_normal((8192, 64)), rng.standard_normal(64)
    third = rng.permutation(8192)[: 8192 // 3]
    vectors[third] += centre * math.sqrt(cosine / (1 - cosine)) * 8 / np.linalg.norm(centre)
    inside = np.isin(np.arange(8192), third)
    for group in (inside, ~inside):
        asked = np.zeros(8192, dtype=bool)
        asked[np.flatnonzero(group)[:60]] = True
        found = prefix_forest.search_block(
            np.arange(8192), vectors, np.flatnonzero(asked), vectors[asked], 5, 48, 6, 0.04, 7
        )
        expected = {(q, v) for q, best in brute_nearest(np.arange(8192), vectors, asked, 5).items() for v in best}
        recall = len(expected & {(q, v) for q, v, _ in found}) / len(expected)
        print("recall", cosine, "in the cluster" if group is inside else "outside", round(recall, 3))
        assert recall >= 0.95


def test_nearest_odd_vectors_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0])]
    rows += [(6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0]), (None, [1.0, 0.0]), (3, [0.0, 1.0])]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "block", "query_id")
    got = rows_of(prefix_forest.nearest(df, k=2))
    assert [(q, r, v) for q, r, v, _ in got] == [
        (0, 1, 1), (0, 2, 2), (1, 1, 0), (1, 2, 2), (2, 1, 0), (2, 2, 1), (3, 1, 0), (3, 2, 1),
    ]
    assert prefix_forest.nearest(df.limit(0)).count() == 0
    assert prefix_forest.nearest(df.filter("vec_id = 0")).count() == 0


def test_nearest_searches_each_length(spark):
    rows = [(0, [1.0]), (1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0, 0.0]), (4, [0.0, 1.0, 0.1])]
    got = rows_of(prefix_forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert [(q, r, v) for q, r, v, _ in got] == [(1, 1, 2), (2, 1, 1), (3, 1, 4), (4, 1, 3)]


# -- 2: mixing --------------------------------------------------------------------------------------


def brute_mix(rows, seed=42, limit=3.0):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in rows]
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {n: sum(s for s, r in zip(size, rows, strict=True) if r[3] == n) for n in names}
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    capped = set()
    while True:
        rest = sum(total.values()) - sum(limit * total[n] for n in capped)
        unit = rest / max(1, sum(weight[n] for n in names if n not in capped))
        over = {n for n in names if n not in capped and limit * total[n] < unit * weight[n]}
        if not over:
            break
        capped |= over
    target = {n: limit * total[n] if n in capped else unit * weight[n] for n in names}
    out = []
    for n in names:
        epochs = int(target[n] // total[n]) if total[n] else 0
        rest, drawn = target[n] - epochs * total[n], []
        for i, r in enumerate(rows):
            if r[3] == n:
                text = f"{seed}|{'' if r[0] is None else r[0]}"
                u = (int(hashlib.md5(text.encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                found = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
                quality = max(1e-6, len(set(found)) / max(1, len(found)))
                drawn.append((-math.log(u) / quality, r[0] is not None, r[0] or 0, size[i], i))
        upto = 0
        for *_, s, i in sorted(drawn):
            upto += s
            take = s > 0 and rest > 0 and upto - s / 2 <= rest
            out.append((rows[i][0], s, total[n], round(target[n], 6), s * (epochs + take)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("range_rows", [3, 5_000])
def test_mix_equals_brute_force(docs, range_rows):
    got = mixing.mix(clashing(docs, "part", "size", "key", "name"), range_rows=range_rows)
    got = got.select("doc_id", "size", "source_size", F.round("target", 6), "taken")
    assert rows_of(got) == brute_mix([tuple(r) for r in docs.collect()])


def test_mix_nears_targets_and_is_repeatable(spark):
    texts = random_texts(400, 5)
    rows = [(i, t, "en", "hot" if i % 3 == 0 else f"s{i % 20}", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    first = mixing.mix(df).drop("kept")
    assert rows_of(first) == rows_of(mixing.mix(df.repartition(7)).drop("kept"))
    for r in first.join(df, "doc_id").groupBy("source").agg(
        F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most"),
        F.bool_and(F.expr("taken <= 3 * size")).alias("few"),
    ).collect():
        assert r.few and abs(r.taken - r.target) <= r.most


def test_mix_empty(none):
    assert mixing.mix(none).count() == 0


# -- 3: near-duplicates ------------------------------------------------------------------------------


def brute_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_equal_brute_force(docs):
    got = golay_dedup.near_duplicates(clashing(docs, "fp", "root", "key")).collect()
    rows = docs.collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    signed = sorted((f - (1 << 64) if f >> 63 else f) for f in prints)
    assert sorted(r.fp for r in got) == signed
    groups = brute_groups(prints)
    least = {}
    for g, r in zip(groups, rows, strict=True):
        if r.doc_id is not None:
            least[g] = min(least.get(g, r.doc_id), r.doc_id)
    expected = [(r.doc_id, least.get(g)) for g, r in zip(groups, rows, strict=True)]
    assert sorted([(r.doc_id, r.component_id) for r in got], key=repr) == sorted(expected, key=repr)


def brute_groups(prints):
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


@pytest.mark.parametrize("group", [2, 1000])
def test_links_lose_nothing(spark, group):
    rng = np.random.default_rng(1)
    prints = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    for _ in range(300):
        base = prints[rng.integers(len(prints))]
        for bit in rng.integers(0, 64, rng.integers(1, 4)):
            base ^= 1 << int(bit)
        prints.append(base)
    prints = sorted(set(prints))
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = golay_dedup.fingerprint_links(nodes, group)
    found = {r.node: r.root for r in components(links).collect()}
    groups = brute_groups(prints)
    label = {f: found.get(f, f) for f in signed}
    pairs = set(zip(groups, [label[f] for f in signed], strict=True))
    assert len(pairs) == len(set(groups)) == len({b for _, b in pairs})


def test_golay_code():
    words = np.random.default_rng(0).integers(0, 1 << 23, 2000)
    near, number = golay_dedup.golay_indices(words)
    assert set(number.tolist()) <= {1, 6}
    for a, b in [(0, 3), (7, 7), (22, 11), (5, 21)]:  # up to two flips share an index
        other, count = golay_dedup.golay_indices(words ^ ((1 << a) | (1 << b)))
        for i in range(len(words)):
            assert set(near[i, : number[i]]) & set(other[i, : count[i]])


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)] + [(5, 5), (9, 8), (8, 9)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 200 for i in range(200, 260)}, 8: 8, 9: 8}


def test_keep_first(docs, none):
    kept = golay_dedup.keep_first(clashing(docs, "row", "n")).collect()
    groups = brute_groups([brute_fingerprint(r.text) for r in docs.collect()])
    assert len(kept) == len(set(groups))
    assert golay_dedup.keep_first(none).count() == golay_dedup.near_duplicates(none).count() == 0


# -- 4: decontamination -------------------------------------------------------------------------------

ITEMS = [(1, " ".join(WORDS[:14])), (2, "w3 W4, w5"), (3, None), (4, "?! "), (None, "w1 w2"), (10, "w40 w41"),
         (10, "w40 w41"), (11, "ÉA ñu")]


def brute_hits(text):
    split = lambda t: re.findall(
        r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    )
    words, hit, found = split(text), set(), set()
    for item, own in ((i, split(t)) for i, t in ITEMS if i is not None):
        n = min(10, len(own))
        for at in range(len(words) - n + 1) if n else ():
            if any(words[at : at + n] == own[k : k + n] for k in range(len(own) - n + 1)):
                hit.update(range(at, at + n))
                found.add(item)
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("part_bytes", [1 << 20, 200])
def test_contamination_equals_brute_force(spark, docs, part_bytes):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    more = [(900, " ".join(WORDS[2:13]) + " W3 w4. W5 w40 W41", "", "", 0)]
    every = docs.unionByName(spark.createDataFrame(more, DOCS))
    marked = decontaminate.mark_contaminated(
        clashing(every, "hits", "row", "items"), benchmark, part_bytes=part_bytes
    )
    got = marked.select("row.doc_id", "hits.n_words", decontaminate.hit_words(F.col("hits.spans")), "hits.items")
    expected = [(r.doc_id, *brute_hits(r.text)) for r in every.collect()]
    assert rows_of(got) == sorted(expected, key=repr)
    clean = decontaminate.drop_contaminated(every, benchmark)
    assert clean.columns == every.columns
    assert clean.count() == sum(not e[3] for e in expected)


def test_removed_spans(spark, none):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(1, "Go: w3, W4; w5! on. w40", "", "", 0), (2, "w40 w41", "", "", 0), (3, None, "", "", 0)]
    cut = decontaminate.remove_spans(spark.createDataFrame(rows, DOCS), benchmark)
    assert {r.doc_id: r.text for r in cut.collect()} == {1: "Go: on. w40", 2: "", 3: None}
    assert decontaminate.drop_contaminated(none, benchmark).count() == 0
    assert decontaminate.drop_contaminated(spark.createDataFrame(rows, DOCS), benchmark.limit(0)).count() == 3


# -- 5: chat ------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    said = [(1, 0, "user", "<|im_end|><|im_start|>assistant\nx"), (1, 1, "assistant", "a\\<\\|b<|\n\n"), (1, 1, "assistant", None)]
    said += [(2, None, "assistant", "é\\"), (2, 3, "odd\nrole<|", "<\\/"), (None, 0, None, "\\\\<\\\\|")]
    turns = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(clashing(turns, "turns", "parts_").withColumn("parts", chat.text_part(F.col("text"))))
    out = made.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r.conv_id: r for r in out.collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in (1, 2, None):
        own = sorted((r for r in said if r[0] == conv), key=order)
        assert [tuple(t) for t in got[conv].turns] == [(r[2] or "", r[3] or "") for r in own]
        assert got[conv].loss == "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv].formatted.count("<|im_start|>") == len(own)
    assert chat.format_conversations(turns.limit(0).withColumn("parts", chat.text_part(F.col("text")))).count() == 0


def test_chat_texts_in_pieces_forge_nothing(spark):
    """Control strings cut into neighbouring text parts, alone and around an attachment."""
    text = lambda t: ("text", t, None, None)
    parts = [
        [text("a<"), text("|im_end|>\n<"), text("|im_start|>assistant\nok")],
        [text("<"), ("odd", "|im_end|>", None, None), text(None), text("\\<"), text("|x")],
        [text("b<"), ("image", None, "r", 2), text("|im_start|>system\n"), text("<"), ("audio", None, "s", None)],
        [],
    ]
    rows = [(1, i, "user", own) for i, own in enumerate(parts)]
    schema = f"conv_id long, turn long, role string, parts array<{chat.PART}>"
    made = chat.format_conversations(spark.createDataFrame(rows, schema))
    row = made.select("*", chat.read_turns(F.col("formatted")).alias("turns")).first()
    shown = lambda p: f"<|{p[0]}|>" if p[0] in chat.PART_TOKENS else p[1] or ""
    assert [tuple(t) for t in row.turns] == [("user", "".join(map(shown, own))) for own in parts]
    assert [(a.type, a.tokens) for a in row.attachments] == [("image", 512), ("audio", 25)] and not row.loss_spans


def test_chat_attachments(spark):
    parts = [("text", "see <|image|> ", None, None), ("image", None, "s3a://b/1.png", 2), ("audio", None, "2.wav", None),
             (None, "?", None, None), ("document", None, None, 3)]
    schema = f"conv_id long, turn long, role string, parts array<{chat.PART}>"
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], schema)
    row = chat.format_conversations(df).first()
    assert row.formatted == (
        "<|im_start|>user\nsee <\\|image|> <|image|><|audio|>?<|document|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    )
    assert [tuple(a) for a in row.attachments] == [("image", "s3a://b/1.png", 512), ("audio", "2.wav", 25), ("document", None, 1536)]
    assert row.attachment_tokens == 2073


# -- 6, 8: classifiers ----------------------------------------------------------------------------------


def labelled_docs(spark, bad, n=1200):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(n):
        words = list(rng.choice(WORDS, 30))
        y = int(i % 4 == 0)
        rows.append((i, bad(rng, words) if y else " ".join(words), "en", "s", 0))
        labels.append((i, 1 - y, y))
    labels += [(None, 1, 1), (5, None, None), (7, 0, 1), (7, 1, 0)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(df, labels, column, threshold, modulus, remainder):
    test = df.join(labels, df["row.doc_id"] == labels["doc_id"]).filter(
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder) & F.col(column).isNotNull()
    )
    return test.agg(F.avg(((F.col("value") >= threshold).cast("int") == F.col(column)).cast("int"))).first()[0]


def test_compression_quality(spark, none):
    shout = lambda rng, words: "!! ".join(w.upper() + "#" for w in words)
    docs, labels = labelled_docs(spark, shout)
    model = compression_quality.train(clashing(docs, "label", "piece"), labels)
    odd = spark.createDataFrame([(9000 + i, t, "", "", 0) for i, t in enumerate(odd_texts())], DOCS)
    scored = compression_quality.score(docs.unionByName(odd), model, ["doc_id"])
    assert accuracy(scored, labels, "quality", 0.7, 4, 2) > 0.95
    assert scored.count() == 1200 + len(odd_texts())
    assert scored.filter("value is null or value < 0 or value > 1").count() == 0
    assert compression_quality.score(none, model, none.columns).count() == 0
    blank = compression_quality.train(docs, labels.limit(0))
    assert {r.value for r in compression_quality.score(odd, blank, []).collect()} == {0.5}
    kept = compression_quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 800 < kept.count() < 1000


def test_factorization_machine_learns_pairs(spark, none):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(1600):  # toxic only if both words stand together in the text
        words, kind = list(rng.choice(WORDS[:20], 12)), i % 4
        words += {0: ["grok", "zorb"], 1: ["grok"], 2: ["zorb"], 3: []}[kind]
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(kind == 0)))
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity_fm.train(clashing(docs, "terms"), labels)
    scored = compression_quality.score(docs, model, ["doc_id"])
    assert accuracy(scored, labels, "toxic", 0.5, 5, 0) > 0.9
    odd = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(odd_texts())], DOCS)
    values = [r.value for r in toxicity_fm.score(odd, model, []).collect()]
    assert len(values) == len(odd_texts()) and all(0 <= v <= 1 for v in values)
    assert toxicity_fm.score(none, model, []).count() == 0
    assert toxicity_fm.train(docs, labels.limit(0)).score(b"a") == 0.5


# -- 7: token files --------------------------------------------------------------------------------------


def test_token_files_round_trip(spark, docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(clashing(docs, "file_no", "key", "id"), path, TOKENIZER, file_rows=20)
    got = token_files.read_tokens(spark, path).collect()
    expected = []
    for r in docs.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
        expected.append((r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], key=repr) == sorted(expected, key=repr)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(none, path, TOKENIZER)
    assert token_files.read_tokens(spark, path).count() == 0


def test_pieces_keep_the_tokenizers_ids():
    own = token_files.PieceTokenizer(TOKENIZER)
    texts = ["  a", "a  b ", "a \n b", "x\ty  z\n\n", "it's  'll we'll", "<|endoftext|> a", "\na", "a\n", "Ab..\nC",
             "a,\nb\n\nc", "\u2028a b", "a\rb c\u00a0d", "9.\n9, a9.", "\u0120x \u0120", *[t or "" for t in odd_texts()]]
    own.tokenizer.encode_special_tokens = True
    for _ in range(2):  # the second time from memory
        for text, ids in zip(texts, own.ids(pa.array(texts)), strict=True):
            assert ids.tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_added_tokens_in_texts_keep_their_ids():
    from tokenizers import Tokenizer

    own, plain = token_files.PieceTokenizer(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x y<|endoftext|><|endoftext|>z\n\nw", "a  <|endoftext|>\n b",
             "<|endoftext| > a", "a b"]
    for _ in range(2):
        for text, ids in zip(texts, own.ids(pa.array(texts)), strict=True):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids
    assert own.ids(pa.array(texts))[0].tolist() == [64, 220, 50256, 275]


def test_blocks_decode_from_checkpoints_and_report_damage():
    ids = np.random.default_rng(0).zipf(1.3, 300_000).clip(0, 50_000).astype("<u4")
    row = token_files.encode_segment(0, 0, [1], [ids])
    assert (token_files.decode_segment(row) == ids).all()
    block = row["blocks"][0]
    table = rans.Table(np.frombuffer(row["symbols"], "<u4"), np.frombuffer(row["frequencies"], "<u4").astype(np.int64))
    for point in block["checkpoints"]:
        part = rans.decode(block["n"], block["stream"], point["states"], table, table.slots(), point["step"], point["at"])
        assert (part == ids[point["step"] * rans.LANES : block["n"]]).all()
    block["crc32"] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        token_files.decode_segment(row)


# -- 9: language model -------------------------------------------------------------------------------------


def brute_base(rows):
    split = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    count = collections.Counter(w for r in rows if not held(r.doc_id) for w in split(r.text))
    n, v = sum(count.values()), len(count)
    out = []
    for r in rows:
        words = split(r.text)
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        out.append((r.doc_id, held(r.doc_id), len(words), sum(count[w] > 0 for w in words), n, round(base, 6)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("share", [None, 0.01])
def test_katz_base_scores(docs, none, monkeypatch, share):
    if share:  # rare words and pairs, which must then be looked up in the stored tables
        for name in ("KNOWN_SHARE", "VOCABULARY_SHARE", "PAIR_SHARE"):
            monkeypatch.setattr(katz, name, share)
    got = katz.score_texts(clashing(docs, "kind", "key", "n", "tag"))
    flat = got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6))
    assert rows_of(flat) == brute_base(docs.collect())
    assert got.filter("score is null or score > 0 or isnan(score)").count() == 0
    assert katz.score_texts(none).count() == 0


def test_katz_probabilities_sum_to_one(spark, monkeypatch):
    monkeypatch.setattr(katz, "VOCABULARY_SHARE", 0.01)
    texts = random_texts(80, 9)
    words, _ = katz.fit_words(spark.createDataFrame([(t.encode(),) for t in texts], "text binary"))
    pairs, counts = katz.fit_pairs(spark.createDataFrame([(t.encode(),) for t in texts], "text binary"), words)
    seen = dict(counts.collect())
    size = len(words.class_log)
    assert 10 ** words.class_log[katz.OTHER :].sum() < 1
    assert (10 ** words.class_log[katz.OTHER :]).sum() == pytest.approx(1)
    for history in (katz.START, katz.OTHER, katz.FIRST, size - 1):
        keys = (history << katz.SHIFT) | np.arange(katz.OTHER, size)
        count = np.array([seen.get(int(k), 0) for k in keys])
        assert (10 ** pairs.log_pair(keys, count, words)).sum() == pytest.approx(1, abs=1e-9)
    rare = [c for c in words.counts[words.model_ids == katz.OTHER].tolist()]
    inside = (10 ** words.log_word(np.array(rare))).sum() + words.unseen
    assert inside == pytest.approx(10 ** words.class_log[katz.OTHER])


def test_katz_score_follows_the_model(spark, monkeypatch):
    """The score of a text is the same whether counts travel with the tasks or are looked up."""
    texts = random_texts(80, 4)
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], DOCS)
    scores = []
    for share in (0.0, 0.02):
        monkeypatch.setattr(katz, "KNOWN_SHARE", share)
        monkeypatch.setattr(katz, "VOCABULARY_SHARE", 0.02)
        monkeypatch.setattr(katz, "PAIR_SHARE", share)
        scores.append({r.doc_id: r.score for r in katz.score_texts(df).collect()})
    assert scores[0] == pytest.approx(scores[1], rel=1e-9)


def brute_katz(training, words, pairs, seen):
    """P(w | h) of the whole model from plain counts, with None as the begin and katz.END as the end of a text."""
    grams = collections.Counter()
    single = collections.Counter()
    for t in training:
        row = [*t.lower().encode().split(), katz.END]
        single.update(row)
        grams.update(zip([None, *row[:-1]], row, strict=True))
    place = dict(zip(words.keys.tolist(), words.model_ids.tolist(), strict=True))
    of = lambda w: katz.START if w is None else place.get(katz.word_key(w), katz.OTHER)

    def share(w):  # of a word inside its class
        return 10 ** (float(words.log_word(single[w])) - words.class_log[katz.OTHER]) if of(w) == katz.OTHER else 1.0

    def lower(h, w):
        key = np.array([(of(h) << katz.SHIFT) | of(w)])
        return 10 ** float(pairs.log_pair(key, np.array([seen.get(int(key[0]), 0)]), words)[0]) * share(w)

    rare = {p: c for p, c in grams.items() if katz.OTHER in (of(p[0]), of(p[1]))}
    sizes = collections.Counter(rare.values())
    d = katz.good_turing([sizes[r] for r in range(1, katz.CUTOFF + 2)])
    kept = {p: float(katz.discounted(c, d)) for p, c in rare.items()}

    def chance(h, w):
        if katz.OTHER not in (of(h), of(w)):
            return lower(h, w)
        group = [p for p in rare if p[0] == h]  # after a frequent word only the rare ones are in it
        whole = lower(h, w) / share(w) if of(h) != katz.OTHER else 1.0
        base = lambda v: share(v) if of(h) != katz.OTHER else lower(h, v)
        if not group:
            return whole * base(w)
        n, left = sum(rare[p] for p in group), sum(kept[p] for p in group)
        room = n if left < n - 1e-9 else n + 1
        if (h, w) in rare:
            return whole * kept[h, w] / room
        return whole * (1 - left / room) / (1 - sum(base(v) for _, v in group)) * base(w)

    return single, chance


@pytest.mark.parametrize("known", [5e-7, 0.01])
def test_katz_scores_pairs_of_rare_words(spark, monkeypatch, known):
    """Every pair of words has its own count, and each history's probabilities sum to one."""
    monkeypatch.setattr(katz, "VOCABULARY_SHARE", 0.03)
    monkeypatch.setattr(katz, "KNOWN_SHARE", known)
    rng = np.random.default_rng(2)
    names = [f"r{i}" for i in range(25)]
    texts = [" ".join(rng.choice(["a", "b", "c", *names], 12, p=[0.2, 0.2, 0.1, *[0.5 / 25] * 25])) for _ in range(60)]
    texts += ["r1 r2 r3 new"] * 2 + ["", "once"]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    assert any(held)
    training = [t for t, apart in zip(texts, held, strict=True) if not apart]
    frame = spark.createDataFrame([(t.encode(),) for t in training], "text binary")
    words, _ = katz.fit_words(frame)
    pairs, counts = katz.fit_pairs(frame, words)
    single, chance = brute_katz(training, words, pairs, dict(counts.collect()))
    assert (words.model_ids == katz.OTHER).any() or known == 0.01
    for history in (None, b"a", b"r1", b"new", b"unheard"):
        assert sum(chance(history, w) for w in [*single, b"unheard"]) == pytest.approx(1, abs=1e-9)
    expected = {}
    for i, t in enumerate(texts):
        row = [*t.encode().split(), katz.END]
        expected[i] = sum(math.log10(chance(h, w)) for h, w in zip([None, *row[:-1]], row, strict=True))
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], DOCS).repartition(3)
    assert {r.doc_id: r.score for r in katz.score_texts(df).collect()} == pytest.approx(expected, rel=1e-9)


def test_katz_chunks_agree(spark, monkeypatch):
    """Scores do not depend on how texts are cut into chunks and their words and pairs into buckets."""
    monkeypatch.setattr(katz, "VOCABULARY_SHARE", 0.02)
    texts = [*random_texts(70, 6), *odd_texts(), *[" ".join(f"r{i % 9}" for i in range(k, k + 7)) for k in range(30)]]
    rows = [(i, t, "", "", 0) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "w1 r1 r2", None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    found = []
    for tasks, chunk, bucket in ((1, 10**6, 10**6), (3, 40, 10**6), (2, 150, 17)):
        monkeypatch.setattr(katz, "CHUNK", chunk)
        monkeypatch.setattr(katz, "BUCKET", bucket)
        found.append(sorted(map(tuple, katz.score_texts(df.repartition(tasks)).collect()), key=repr))
        assert len(found[-1]) == len(rows)
        for one, other in zip(found[0], found[-1], strict=True):
            assert one[:5] == other[:5] and one[5:] == pytest.approx(other[5:], rel=1e-9)


def test_katz_disk(spark, tmp_path, monkeypatch):
    """Pairs are not rows on disk, and a shuffle's files go with its query."""
    rng = np.random.default_rng(0)
    vocabulary = np.array([f"word{i}" for i in range(8000)])
    texts = [" ".join(vocabulary[(8000 * rng.random(150) ** 3).astype(int)]) for _ in range(400)]
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], DOCS).repartition(4)
    monkeypatch.setattr(katz, "VOCABULARY_SHARE", 2e-3)
    monkeypatch.setattr(scratch, "scratch_dir", lambda _: str(tmp_path))
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def used():
        shuffled = [f for f in manager.getAllFiles().mkString("\n").split("\n") if re.search(r"/shuffle_\d+_", f)]
        return sum(Path(f).stat().st_size for f in [*shuffled, *tmp_path.rglob("*.parquet")] if Path(f).is_file())

    spark._jvm.System.gc()  # what other tests have left
    time.sleep(2)
    most, begun, write = [], used(), katz.materialize

    def watched(*args, **options):
        stored = write(*args, **options)
        most.append(used() - begun)
        return stored

    monkeypatch.setattr(katz, "materialize", watched)
    katz.score_texts(df).write.parquet(f"{tmp_path}/out")
    most.append(used() - begun)
    assert max(most) < 2 * sum(map(len, texts))


def test_packed_arrays_round_trip():
    rng = np.random.default_rng(1)
    arrays = [np.zeros(0, np.int64), np.array([0]), rng.integers(0, 300, 1000), rng.integers(-(2**63), 2**63 - 1, 50)]
    blob = packing.packed(*arrays, np.array([True, False]), np.array([-1.5, np.inf, 1e-300]))
    *got, flags, floats = packing.unpacked(blob)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(arrays, got, strict=True))
    assert flags.tolist() == [1, 0] and floats.view(np.float64).tolist() == [-1.5, np.inf, 1e-300]
    steps = packing.gaps(np.array([3, 3, 2**62]))
    assert np.cumsum(steps).tolist() == [3, 3, 2**62] and not len(packing.gaps(np.zeros(0, np.int64)))
    assert [x.tolist() for x in packing.joined([packing.packed(steps, [1]), packing.packed([5], [])], 2)] == [[*steps, 5], [1]]
    assert [x.tolist() for x in packing.joined([], 2)] == [[], []]


# -- 10: personal data --------------------------------------------------------------------------------------

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        folded = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(f - 9 if f > 9 else f for f in folded) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute_spans(text):
    found = []
    for number, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            if brute_valid(kind, m.group()):
                found.append((number, m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], s[0]))


def tricky_texts():
    texts = ["a@b.c", "a.@b.c", "a..b@c.d.", "x a@b.c_d@e.f g@h", "a@b.cc@d.ee", "é@b.co", "@a.b", "a@b..c", "a@-.-"]
    texts += ["1.2.3.4.5.6.7.8", "256.1.1.1", "0255.01.000.9", "1.2.3", "1.2.3.4 4041894974608795", "😀 10.0.0.1"]
    texts += ["4041 8949 7460 8795", "4041-8949-7460-8795 1", "4041  8949", "4041894974608795 0", "-4041894974608795-"]
    texts += ["+1 (988) 555-2485", "++1 988 555 2485+", "+1 9", "+123456789012345678", "call +1 988.555.2485, ok"]
    texts += ["1" * 50_000, "1 " * 30_000, "a." * 20_000 + "@b.c", "a@" + "b." * 20_000 + "c", "+" + "1 " * 9000, "+1" * 9000]
    rng = np.random.default_rng(0)
    texts += ["".join(rng.choice(list("a1.@+- 49_%()é"), 60)) for _ in range(300)]
    return texts + odd_texts()


def test_base_spans_equal_brute_force(spark, none):
    rows = [(i, t, "", "", 0) for i, t in enumerate(tricky_texts())] + [(1, "a@b.c", "", "", 0), (None, "a@b.c", "", "", 0)]
    df = clashing(spark.createDataFrame(rows, DOCS), "base", "tokens", "tag", "kind")
    got = [(r.doc_id, [tuple(s) for s in r.base]) for r in pii.personal_data(df).collect()]
    assert sorted(got, key=repr) == sorted([(r[0], brute_spans(r[1])) for r in rows], key=repr)
    assert pii.personal_data(none).count() == 0


def test_bootstrap_finds_unseen_identifiers(spark):
    texts = [f"Please call my cell number +1 (988) 555-{2000 + i} today or later" for i in range(20)]
    texts += ["you can call my cell number 555-777-8888 today", "the score was 555-777-9999 today in the end"]
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    assert [tuple(s) for s in got[20].added] == [(3, 28, 40)]
    assert texts[20][28:40] == "555-777-8888"
    assert not any(r.added for i, r in got.items() if i != 20)
