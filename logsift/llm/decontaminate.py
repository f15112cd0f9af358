"""Benchmark decontamination by exact word n-grams.

Every run of 10 words of a benchmark item is a window; an item with fewer words is one window itself.
The windows become hash sets of normalised n-grams that are broadcast in parts of a bounded size, and
each training text is scanned once per part (one part, unless the benchmark is very large). Only runs
of words that the benchmark knows can hold a window, so most text is passed at the speed of one set
lookup per word; what remains is looked up as whole n-grams, so a hit is exact.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logsift.llm.common import arrow_batch, blobs, held, quoted, released
from logsift.sources.scratch import materialize

WINDOW = 10
#: Bytes of n-grams in one broadcast part.
PART_BYTES = 32 << 20

#: Bytes of a word: digits, letters (upper ones lowered) and everything beyond ASCII; others part words.
NORMAL = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)
HITS = "struct<n_words:long,spans:array<struct<start:int,end:int>>,items:array<long>>"

HIT_TYPE = pa.struct(
    [
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ("items", pa.list_(pa.int64())),
    ]
)


def words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def benchmark_grams(benchmark: DataFrame, id_col="item_id", text_col="text", window=WINDOW):
    """(gram, n, item_id): the different windows of every item; none for items without words or id."""
    schema = pa.schema([("gram", pa.binary()), ("n", pa.int32()), ("item_id", pa.int64())])

    def run(batches):
        for batch in batches:
            for item, text in zip(batch.column(0), blobs(batch.column(1)), strict=True):
                found = words(text)
                n = min(window, len(found))
                if n and item.is_valid:
                    grams = list({b" ".join(found[i : i + n]) for i in range(len(found) - n + 1)})
                    ids = [item.as_py()] * len(grams)
                    yield arrow_batch(schema, gram=grams, n=[n] * len(grams), item_id=ids)

    slim = benchmark.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary"))
    return slim.mapInArrow(released(run), "gram binary, n int, item_id long").distinct()


class GramSet:
    """One part of the windows, as sets per length."""

    def __init__(self, rows):
        self.items = defaultdict(list)
        self.known = set()
        self.lengths = sorted({r.n for r in rows})
        for row in rows:
            self.items[bytes(row.gram)].append(row.item_id)
            self.known.update(bytes(row.gram).split())
        self.items = dict(self.items)

    def scan(self, found: list[bytes]):
        """The (start, end) of hit words, merged, and the sorted items; positions count words."""
        if not self.lengths or len(found) < self.lengths[0]:
            return [], []
        mark = np.zeros(len(found) + 2, dtype=np.int8)
        mark[1:-1] = np.fromiter(map(self.known.__contains__, found), dtype=bool, count=len(found))
        edge = np.diff(mark)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = ends - starts >= self.lengths[0]
        spans, items = [], set()
        for start, end in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            for n in self.lengths:
                for at in range(start, end - n + 1):
                    hit = self.items.get(b" ".join(found[at : at + n]))
                    if hit:
                        spans.append((at, at + n))
                        items.update(hit)
        return merged(spans), sorted(items)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _scan_part(rows: DataFrame, grams, first: bool) -> DataFrame:
    """``rows(row, text, hits)`` with the hits of one part added."""

    def run(batches):
        part = grams.value
        for batch in batches:
            old = [None] * batch.num_rows if first else batch.column("hits").to_pylist()
            hits = []
            for text, before in zip(blobs(batch.column("text")), old, strict=True):
                found = words(text)
                spans, items = part.scan(found)
                if before:
                    spans = merged(spans + [(s["start"], s["end"]) for s in before["spans"]])
                    items = sorted({*items, *before["items"]})
                hits.append(
                    {
                        "n_words": len(found),
                        "spans": [{"start": a, "end": b} for a, b in spans],
                        "items": items,
                    }
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("text"), pa.array(hits, HIT_TYPE)],
                ["row", "text", "hits"],
            )

    schema = StructType([rows.schema["row"], *StructType.fromDDL(f"text binary, hits {HITS}")])
    return rows.mapInArrow(released(run), schema)


def mark_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    keep: list[str] | None = None,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """(row, text, hits): the other columns of every row as a struct, its text and its hits.

    ``row`` holds the columns named in ``keep``, all but the text unless it is given.

    ``hits`` holds the number of words, the merged spans of hit words and the items whose windows
    occur. A null text has no words and no hits. Rows stay one to one, repeated or not, and an empty
    table gives none; with an empty benchmark nothing is hit. Items with one id count as one item,
    items with a null id take no part. Columns of ``docs`` may have any names: they travel inside
    ``row``.
    """
    grams = materialize(benchmark_grams(benchmark), "grams")
    size = grams.agg(F.sum(F.length("gram") + 64).alias("bytes")).first().bytes or 0
    parts = max(1, math.ceil(size / part_bytes))
    spark = docs.sparkSession
    others = [c for c in docs.columns if c != text_col] if keep is None else keep
    rows = docs.select(held(others).alias("row"), quoted(text_col).cast("binary").alias("text"))
    for part in range(parts):
        own = F.pmod(F.xxhash64("gram"), F.lit(parts)) == part
        known = spark.sparkContext.broadcast(GramSet(grams.filter(own).collect()))
        rows = _scan_part(rows, known, part == 0)
        if part + 1 < parts:
            rows = materialize(rows, "scanned")
    return rows


def hit_words(spans: Column) -> Column:
    return F.aggregate(
        spans, F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]).cast("long")
    )


def items_digest(items: Column) -> Column:
    """sha256 of the item ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda i: i.cast("string"))), ","), 256)


def _columns(docs: DataFrame, text_col: str):
    text = F.decode("text", "UTF-8").alias(text_col)
    return [text if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark window; null texts stay null."""
    marked = mark_contaminated(docs, benchmark, text_col)
    return marked.filter(F.size("hits.items") == 0).select(*_columns(docs, text_col))


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the hit words taken out of the texts, each with what follows up to the next word.

    Texts without a hit stay as they are, null and empty ones too; so do all other columns. Spans that
    overlap or touch are one, and repeated rows stay one to one.
    """

    def run(batches):
        for batch in batches:
            spans = batch.column("spans").to_pylist()
            texts = [
                cut(text.as_py(), own) if own else text.as_py()
                for text, own in zip(batch.column("text"), spans, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.binary())], ["row", "text"])

    marked = mark_contaminated(docs, benchmark, text_col).select("row", "text", F.col("hits.spans").alias("spans"))
    schema = StructType([marked.schema["row"], *StructType.fromDDL("text binary")])
    return marked.mapInArrow(released(run), schema).select(*_columns(docs, text_col))


def cut(text: bytes, spans) -> bytes:
    """The text without the words of the spans and what follows each up to the next word."""
    plain = np.frombuffer(text.translate(NORMAL), dtype=np.uint8) != 0x20
    starts = np.flatnonzero(plain & ~np.concatenate(([False], plain[:-1])))
    keep = np.ones(len(text), dtype=bool)
    for span in spans:
        end = starts[span["end"]] if span["end"] < len(starts) else len(text)
        keep[starts[span["start"]] : end] = False
    return np.frombuffer(text, dtype=np.uint8)[keep].tobytes()
