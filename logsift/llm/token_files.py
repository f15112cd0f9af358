"""Token ids of documents in compressed files that decode in parallel.

Documents are ordered by id over all files. A file is a Parquet container of segments, written by
Spark, so any file system that Spark reaches will do and a lost task is simply run again. A segment
holds whole documents, about two million ids: the lengths of its documents, a frequency table that
all its blocks share, and blocks of up to 2^18 ids, each entropy coded on its own with interleaved
lanes, checkpoints and a checksum. Any block, and any checkpoint inside, can be decoded alone.
"""

from __future__ import annotations

import math
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from logsift.llm import rans
from logsift.llm.common import arrow_batch, batch_bytes, quoted, released, text_key

END = 0
BLOCK = 1 << 18
SEGMENT = 1 << 21
FILE_ROWS = 16_384
MEMO, MEMO_CHARS = 300_000, 64  # pieces in one half of a task's memory, and their length
STEP, TOGETHER = 2048, 100  # texts cut together, pieces encoded together
BATCH = 4 << 20  # bytes of texts that a task gets at once
CUT = re.compile(r"(?<=\S) (?=\S)")  # a single space between other characters

BLOCK_TYPE = pa.struct(
    [
        ("n", pa.int32()),
        ("crc32", pa.int64()),
        ("states", pa.binary()),
        ("stream", pa.binary()),
        (
            "checkpoints",
            pa.list_(pa.struct([("step", pa.int32()), ("at", pa.int32()), ("states", pa.binary())])),
        ),
    ]
)
SEGMENTS = pa.schema(
    [
        ("file_no", pa.int32()),
        ("segment_no", pa.int32()),
        ("n_tokens", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("doc_tokens", pa.list_(pa.int64())),
        ("symbols", pa.binary()),
        ("frequencies", pa.binary()),
        ("blocks", pa.list_(BLOCK_TYPE)),
    ]
)
SEGMENTS_DDL = (
    "file_no int, segment_no int, n_tokens long, doc_ids array<long>, doc_tokens array<long>, "
    "symbols binary, frequencies binary, blocks array<struct<n:int,crc32:long,states:binary,"
    "stream:binary,checkpoints:array<struct<step:int,at:int,states:binary>>>>"
)


class Memory:
    """A bounded memory of pieces' ids: two halves, the older one dropped when the newer is full."""

    def __init__(self):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def find(self, pieces: list[str]) -> tuple[list[bytes | None], list[int]]:
        """What is known of the pieces, and the places of those that are not known."""
        if len(self.new) > MEMO:
            self.old, self.new = self.new, {}
        found = list(map(self.new.get, pieces))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if self.old:
            before = list(map(self.old.get, [pieces[i] for i in missing]))
            for i, ids in zip(missing, before, strict=True):
                if ids is not None:
                    found[i] = self.new[pieces[i]] = ids
            missing = [i for i, ids in zip(missing, before, strict=True) if ids is None]
        return found, missing

    def put(self, pieces: list[str], found: list[bytes]) -> None:
        self.new.update(zip(pieces, found, strict=True))
        for p in pieces:
            if len(p) > MEMO_CHARS:
                del self.new[p]


class PieceTokenizer:
    """The tokenizer's ids, found piece by piece with a bounded memory of pieces seen before.

    A byte-level tokenizer never joins the two sides of a single space or line break between other
    characters: a word carries the space in front of it, and the line break stands alone. So texts
    are cut there, whole batches at a time, and equal pieces are tokenized once. Texts with other
    white space next to white space are cut one by one, only where it is safe. Texts with an added
    token of the tokenizer, such as ``<|endoftext|>``, are encoded whole, so they get that token's id.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = any(re.search(r"\s", token) for token in self.added)  # a cut could fall inside one
        self.holds = "|".join(map(re.escape, self.added))
        vocabulary = self.tokenizer.get_vocab()
        self.kind = "<u2" if max(vocabulary.values()) < 1 << 16 else "<u4"
        self.spaced = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.line = self._encode("\n")
        self.memory = Memory()

    def _encode(self, text: str) -> np.ndarray:
        found = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
        return np.array(found.ids, dtype=self.kind)

    def _cut(self, ids: np.ndarray, starts: list[int], pieces: list[str]) -> list[bytes]:
        """Ids of each of the pieces that were encoded together and start at these tokens."""
        if len(starts) != len(pieces):
            raise ValueError("the tokenizer joins pieces that should stay apart")
        data, width = ids.tobytes(), ids.itemsize
        ends = [*starts[1:], len(ids)]
        return [data[width * a : width * b] for a, b in zip(starts, ends, strict=True)]

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces: as they are if they start with a line break, else after a space."""
        words, heads, rest = [], [], []
        for i, p in enumerate(pieces):
            (heads if p[:1] == "\n" else rest if not p or " " in p else words).append(i)
        found: list[bytes] = [b""] * len(pieces)
        for places, space in ((words, " "), (heads, "")):
            for at in range(0, len(places), TOGETHER):
                part = [pieces[i] for i in places[at : at + TOGETHER]]
                ids = self._encode(space + space.join(part))
                starts = np.flatnonzero(self.spaced[ids] if space else ids == self.line[0]).tolist()
                for i, own in zip(places[at : at + TOGETHER], self._cut(ids, starts, part), strict=True):
                    found[i] = own
        for i in rest:
            found[i] = self._encode(" " + pieces[i]).tobytes()
        return found

    def _table(self, pieces: list[str]) -> list[bytes]:
        found, missing = self.memory.find(pieces)
        names = [pieces[i] for i in missing]
        learned = self._learn(names)
        self.memory.put(names, learned)
        for i, ids in zip(missing, learned, strict=True):
            found[i] = ids
        return found

    def _one(self, text: str) -> np.ndarray:
        if any(token in text for token in self.added):
            return self._encode(text)
        first, *rest = CUT.split(text)
        return np.frombuffer(self._encode(first).tobytes() + b"".join(self._table(rest)), dtype=self.kind)

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of every text of a string array; a null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.whole:
            return [self._encode(text) for text in texts.to_pylist()]
        empty, line = (pa.scalar(x, pa.large_string()) for x in ("", "\n"))
        lines = pc.binary_join_element_wise(empty, pc.replace_substring(texts, "\n", " \n"), line)
        lists = pc.split_pattern(lines, " ")
        named = lists.flatten().dictionary_encode()
        bare = pc.replace_substring_regex(named.dictionary, "^\n", "")
        trimmed = pc.binary_length(pc.utf8_trim_whitespace(bare)).to_numpy()
        odd = (trimmed != pc.binary_length(bare).to_numpy()) | (trimmed == 0)
        if self.added:
            odd |= pc.match_substring_regex(bare, self.holds).to_numpy(zero_copy_only=False)
        pieces = named.dictionary.to_pylist()
        for i in np.flatnonzero(odd):
            pieces[i] = "x"  # its texts are cut another way
        table = self._table(pieces)
        data = np.frombuffer(b"".join(table), dtype=self.kind)
        width = np.dtype(self.kind).itemsize
        size = np.fromiter(map(len, table), dtype=np.int64, count=len(table)) // width
        start = np.cumsum(size) - size
        code = named.indices.to_numpy()
        sizes = size[code]
        ends = np.cumsum(sizes)
        out = data[np.repeat(start[code] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        ends = np.concatenate(([0], ends))[cuts].tolist()
        strange = np.concatenate(([0], np.cumsum(odd[code])))[cuts]
        strange = (np.diff(strange) > 0).tolist()
        return [
            self._one(texts[i].as_py()) if strange[i] else out[ends[i] + 1 : ends[i + 1]]
            for i in range(len(texts))
        ]


_TOKENIZERS: dict[str, PieceTokenizer] = {}


def tokenizer(path: str) -> PieceTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = PieceTokenizer(path)
    return _TOKENIZERS[path]


def encode_segment(file_no: int, segment_no: int, doc_ids: list, docs: list[np.ndarray]) -> dict:
    ids = np.concatenate(docs)
    table = rans.Table.of(ids)
    places = table.places()
    blocks = []
    for at in range(0, len(ids), BLOCK):
        part = ids[at : at + BLOCK]
        stream, states, points = rans.encode(part, table, places)
        blocks.append(
            {
                "n": len(part),
                "crc32": zlib.crc32(part.astype("<u4").tobytes()),
                "states": states,
                "stream": stream,
                "checkpoints": [{"step": s, "at": a, "states": x} for s, a, x in points],
            }
        )
    return {
        "file_no": file_no,
        "segment_no": segment_no,
        "n_tokens": len(ids),
        "doc_ids": doc_ids,
        "doc_tokens": [len(d) for d in docs],
        "symbols": table.symbols.astype("<u4").tobytes(),
        "frequencies": table.freq.astype("<u4").tobytes(),
        "blocks": blocks,
    }


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    file_rows: int = FILE_ROWS,
) -> None:
    """Write the ids of every row's whole text, each followed by id 0, in ascending id order.

    Rows with one id are ordered by a hash of their texts and stay separate; null ids come first. A
    null text is empty and has the end id only. An empty table writes files without segments.
    """
    files = max(1, math.ceil(docs.count() / file_rows))

    def run(batches):
        file_no, segment_no = TaskContext.get().partitionId(), 0
        ids, tokens, size = [], [], 0
        end = np.array([END], dtype="<u2")
        own_tokenizer = tokenizer(tokenizer_path)
        own_tokenizer.memory = Memory()  # of this task only
        encode = own_tokenizer.ids

        def flush():
            row = encode_segment(file_no, segment_no, ids, tokens)
            return pa.RecordBatch.from_pylist([row], schema=SEGMENTS)

        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                for doc_id, own in zip(part.column(0).to_pylist(), encode(part.column(1)), strict=True):
                    ids.append(doc_id)
                    tokens.append(np.concatenate((own, end)))
                    size += len(own) + 1
                    if size >= SEGMENT:
                        yield flush()
                        segment_no += 1
                        ids, tokens, size = [], [], 0
        own_tokenizer.memory = Memory()
        if ids:
            yield flush()

    slim = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("text"))
    ordered = (
        slim.withColumn("key", text_key(F.col("text")))
        .repartitionByRange(files, "id", "key")
        .sortWithinPartitions("id", "key")
        .select("id", "text")
    )
    out = ordered.mapInArrow(released(run), SEGMENTS_DDL).write.option("parquet.block.size", 16 << 20)
    with batch_bytes(docs.sparkSession, BATCH):
        out.option("compression", "zstd").parquet(path)


def decode_segment(row: dict) -> np.ndarray:
    """All ids of a segment; raises if a block does not have its checksum."""
    table = rans.Table(
        np.frombuffer(row["symbols"], dtype="<u4"), np.frombuffer(row["frequencies"], dtype="<u4").astype(np.int64)
    )
    slots = table.slots()
    parts = []
    for number, block in enumerate(row["blocks"]):
        ids = rans.decode(block["n"], block["stream"], block["states"], table, slots)
        if zlib.crc32(ids.astype("<u4").tobytes()) != block["crc32"]:
            raise ValueError(f"block {number} of segment {row['segment_no']} of file {row['file_no']} is damaged")
        parts.append(ids)
    return np.concatenate(parts)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENTS_DDL).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files.

    ``start`` counts the ids of all documents before it. File sums are added up in one task (a row
    per file), segments within their file.
    """
    segments = read_segments(spark, path)
    schema = pa.schema(
        [
            ("file_no", pa.int32()),
            ("segment_no", pa.int32()),
            ("doc_id", pa.int64()),
            ("before", pa.int64()),
            ("n_tokens", pa.int64()),
            ("ids_crc32", pa.int64()),
        ]
    )

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                data = decode_segment(row).astype("<u4")
                ends = np.cumsum(row["doc_tokens"])
                starts = np.concatenate(([0], ends[:-1]))
                n = len(ends)
                yield arrow_batch(
                    schema,
                    file_no=[row["file_no"]] * n,
                    segment_no=[row["segment_no"]] * n,
                    doc_id=row["doc_ids"],
                    before=starts.astype(np.int64),
                    n_tokens=row["doc_tokens"],
                    ids_crc32=[zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)],
                )

    docs = segments.mapInArrow(
        released(run), "file_no int, segment_no int, doc_id long, before long, n_tokens long, ids_crc32 long"
    )
    sizes = segments.select("file_no", "segment_no", F.col("n_tokens").alias("size"))
    files = sizes.groupBy("file_no").agg(F.sum("size").alias("size"))
    earlier = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select("file_no", earlier(Window.orderBy("file_no")).alias("file_start"))
    within = earlier(Window.partitionBy("file_no").orderBy("segment_no"))
    starts = sizes.select("file_no", "segment_no", within.alias("segment_start")).join(files, "file_no")
    return docs.join(starts, ["file_no", "segment_no"]).select(
        "doc_id",
        (F.col("file_start") + F.col("segment_start") + F.col("before")).alias("start"),
        "n_tokens",
        "ids_crc32",
    )
