"""Near-duplicates by SimHash, linked through Golay-code keys.

A text's fingerprint has 64 bits, a majority vote over the hashes of its shingles. Two fingerprints
that differ in at most 2 bits are found without comparing all pairs:

* The 64 bits are cut into three segments of at most 23 bits. Of three segments and two errors at
  least one segment has no error (pigeonhole), and any other has at most two.
* The perfect (23, 12) Golay code has a codeword within distance 3 of every 23-bit word. A segment is
  decoded to that codeword and, when it lies at the full distance 3, also to the five codewords at
  distance 4. Two segments that differ in at most 2 bits then share a codeword: the code has one
  within 3 of the word between them, which is within 4 of both.

So each fingerprint gets up to 18 keys: an exact segment with a codeword of the next one. Fingerprints
that share a key are compared, and those that are close enough are linked; groups of linked
fingerprints are connected components.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import arrow_batch, blobs, quoted, released, text_key
from logsift.llm.components import components
from logsift.sources.scratch import materialize

SHINGLE = 3
SEED = 42
MAX_BITS = 2
#: Key groups up to this size are compared inside one row; larger ones through midpoints.
GROUP = 1000
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
GENERATOR = 0b101011100011  # fixed value: generator polynomial of the (23, 12) Golay code
STEP = 1 << 16


def fingerprint(text: bytes, n: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < n:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], dtype=np.uint64)
        return int(hashes[0])
    total = len(words) - n + 1
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, STEP):
        part = words[at : min(total, at + STEP) + n - 1]
        shingles = zip(*(part[i:] for i in range(n)), strict=False)
        hashes = np.array([digest(b" ".join(s), seed) for s in shingles], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs, id_col="doc_id", text_col="text", n=SHINGLE, seed=SEED):
    """(doc_id, text_key, fp): a signed 64-bit fingerprint per row; a null text is empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            values = [fingerprint(text, n, seed) for text in blobs(batch.column(2))]
            signed = np.array(values, dtype=np.uint64).view(np.int64)
            yield arrow_batch(schema, doc_id=batch.column(0), text_key=batch.column(1), fp=signed)

    text = quoted(text_col)
    slim = docs.select(
        quoted(id_col).cast("long").alias("doc_id"), text_key(text).alias("text_key"), text.cast("binary").alias("text")
    )
    return slim.mapInArrow(released(run), "doc_id long, text_key long, fp long")


def _remainders(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator polynomial: 11 bits."""
    left = words.copy()
    for bit in range(22, 10, -1):
        left ^= np.where(left >> bit & 1, GENERATOR << (bit - 11), 0)
    return left


def _decoder() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By remainder: the error words to the near codewords, their number; remainders of high bits."""
    errors = np.zeros((2048, 6), dtype=np.int64)
    number = np.zeros(2048, dtype=np.int64)
    weight = np.full(2048, -1, dtype=np.int64)
    for size in range(5):
        chosen = np.array([sum(1 << b for b in c) for c in combinations(range(23), size)])
        for error, rest in zip(chosen, _remainders(chosen), strict=True):
            if weight[rest] < 0 or (weight[rest] == 3 and size == 4):
                weight[rest] = max(weight[rest], min(size, 3))
                errors[rest, number[rest]] = error
                number[rest] += 1
    return errors, number, _remainders(np.arange(1 << 12, dtype=np.int64) << 11)


_TABLES: list = []


def golay_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the codewords near each 23-bit word, six columns, and how many of them count."""
    if not _TABLES:
        _TABLES.extend(_decoder())
    errors, number, high = _TABLES
    rest = high[words >> 11] ^ (words & 0x7FF)
    return (words[:, None] ^ errors[rest]) >> 11, number[rest]


def segment_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of unsigned fingerprints: exact segment with a codeword of the next."""
    rows, keys = [], []
    cut = [(fps >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    for exact in range(3):
        near, number = golay_indices(cut[(exact + 1) % 3])
        for column in range(6):
            use = np.flatnonzero(number > column)
            rows.append(use)
            keys.append((exact << 34) | (cut[exact][use] << 12) | near[use, column])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(fps: DataFrame) -> DataFrame:
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            own = batch.column(0).to_numpy()
            rows, keys = segment_keys(own.view(np.uint64))
            yield arrow_batch(schema, key=keys, fp=own[rows])

    return fps.select("fp").mapInArrow(released(run), "key long, fp long")


def close_links(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that connect what is connected by distances up to ``bits``; fewer than fingerprints."""
    left, links = fps.view(np.uint64), []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            one = front.pop()
            near = np.bitwise_count(left ^ one) <= bits
            links += [(int(one.view(np.int64)), int(x)) for x in left[near].view(np.int64)]
            front += list(left[near])
            left = left[~near]
    return links


def _links_in_groups(groups: DataFrame, bits: int) -> DataFrame:
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        for batch in batches:
            links = set()
            for members in batch.column(0):
                links.update(close_links(members.values.to_numpy(), bits))
            pairs = sorted(links)
            yield arrow_batch(schema, u=[p[0] for p in pairs], v=[p[1] for p in pairs])

    return groups.select("fps").mapInArrow(released(run), "u long, v long")


def _links_by_midpoint(fps: DataFrame) -> DataFrame:
    """The same links for fingerprints of crowded keys, without any group of more than 65.

    Two fingerprints differ in at most 2 bits exactly if some word is within 1 bit of both. Each sends
    itself to its 65 such words, and all that meet in a word are linked to one of them.
    """
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)) for b in range(64)])
    meets = fps.select("fp", F.explode(flips).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word")
    )
    met = meets.groupBy("word").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    return met.filter(F.size("fps") > 1).select(
        F.col("fps")[0].alias("u"), F.explode(F.slice("fps", 2, 65)).alias("v")
    )


def fingerprint_links(fps: DataFrame, group: int = GROUP) -> DataFrame:
    """Links (u, v) that connect exactly the distinct fingerprints ``fp`` linked at 2 bits."""
    keyed = _keyed(fps)
    crowded = materialize(
        keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > group), "crowded"
    )
    grouped = (
        keyed.join(crowded, "key", "left_anti")
        .groupBy("key")
        .agg(F.collect_list("fp").alias("fps"))
        .filter(F.size("fps") > 1)
    )
    hot = keyed.join(crowded, "key", "left_semi").select("fp").distinct()
    return _links_in_groups(grouped, MAX_BITS).unionByName(_links_by_midpoint(hot))


def _classes(marked: DataFrame) -> DataFrame:
    """(fp, root, component_id) for every fingerprint of ``marked``."""
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    groups = materialize(components(fingerprint_links(nodes)), "groups")
    joined = nodes.join(groups, nodes["fp"] == groups["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    joined = materialize(joined, "roots")
    ids = materialize(joined.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    return materialize(joined.join(ids, "root").select("fp", "root", "component_id"), "classes")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE
) -> DataFrame:
    """(doc_id, fp, component_id): one row per row; the smallest id its fingerprint is linked to.

    Texts without words have fingerprint zero and are linked like any other, so empty and null texts
    are one group. Equal fingerprints are one node, however many rows have them. Rows with a null id
    keep a row; their group's id comes from the other members and is null without any. Repeated ids
    stay separate rows, linked by their own texts. An empty table gives no rows.
    """
    marked = materialize(fingerprints(docs, id_col, text_col, n), "fingerprints")
    return marked.join(_classes(marked), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of linked fingerprints: the one with the smallest id.

    Null ids come after all others; of several texts under the smallest id the one with
    the smallest hash stays, and rows that agree in id and text stay once.
    """
    marked = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    members = marked.join(_classes(marked).select("fp", "root"), "fp")
    texts = materialize(
        members.groupBy("doc_id", "text_key").agg(F.first("root").alias("root"), F.count("*").alias("n")),
        "members",
    )
    first = texts.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")
    )
    first = materialize(first, "first")  # a stored side lets Spark split a group that holds most rows
    judged = texts.join(first, "root").withColumn(
        "stays",
        F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key")),
    )
    judged = materialize(judged.select("doc_id", "text_key", "stays", "n"), "judged")

    rows = docs.select(
        F.struct("*").alias("row"),
        quoted(id_col).cast("long").alias("doc_id"),
        text_key(quoted(text_col)).alias("text_key"),
    )
    pick = lambda kind: materialize(judged.filter(kind).select("doc_id", "text_key"), "picked")
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])
    losers, repeated = pick(~F.col("stays")), pick(F.col("stays") & (F.col("n") > 1))
    kept = rows.join(losers, same(rows, losers), "left_anti")
    single = kept.join(repeated, same(kept, repeated), "left_anti").select("row")
    once = kept.join(repeated, same(kept, repeated), "left_semi")
    once = once.groupBy("doc_id", "text_key").agg(F.first("row").alias("row")).select("row")
    return single.unionByName(once).select("row.*")
