"""Quality classifier from compressed sizes.

Two zstandard dictionaries are trained, one on pieces of good texts and one on pieces of bad texts.
A text is compressed with both, piece by piece, so that a text's own repetition does not hide what
the dictionaries know. The difference of the two sizes per byte is turned into a probability by a
logistic curve that is fitted on other labelled texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from logsift.llm.common import arrow_batch, blobs, fit_logistic, held, id_remainder, quoted, released, sigmoid

PIECE = 1024
LEVEL = 3
DICT_BYTES = 256 << 10
#: Bounds of the training sample: texts per class, pieces per class, and texts for the curve.
DICT_TEXTS, DICT_PIECES, CURVE_TEXTS = 4_000, 8_000, 8_000
HELD_OUT = (4, 2)  # modulus and remainder of the id's crc32 that never train
THRESHOLD = 0.7


def pieces(text: bytes) -> list[bytes]:
    return [text[i : i + PIECE] for i in range(0, len(text), PIECE)]


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    slope: float = 0.0
    intercept: float = 0.0

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("good", "bad", "slope", "intercept")}

    @cached_property
    def _compressors(self):
        made = []
        for data in (self.good, self.bad):
            known = zstandard.ZstdCompressionDict(data) if data else None
            if known:
                known.precompute_compress(level=LEVEL)
            made.append(
                zstandard.ZstdCompressor(
                    level=LEVEL,
                    dict_data=known,
                    write_content_size=False,
                    write_checksum=False,
                    write_dict_id=False,
                )
            )
        return made

    def difference(self, text: bytes) -> float:
        """Bytes that the good dictionary saves over the bad one, per byte of text; 0 if empty."""
        if not text:
            return 0.0
        good, bad = self._compressors
        saved = 0
        for piece in pieces(text):
            saved += len(bad.compress(piece)) - len(good.compress(piece))
        return saved / len(text)

    def score(self, text: bytes) -> float:
        return sigmoid(self.slope * self.difference(text) + self.intercept)


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; the raw pieces themselves where there are too few to train on."""
    size = min(DICT_BYTES, max(256, sum(map(len, samples)) // 8))
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICT_BYTES]


def _order(column: Column, salt: int) -> Column:
    return F.xxhash64(column, F.lit(salt))


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, part: Column, bound: int) -> DataFrame:
    """(id, label) of at most ``bound`` labelled ids per class: the first ones by a hash of the id.

    Ids with null or contradicting labels take no part.
    """
    known = labels.filter(part & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    once = known.groupBy(F.col(id_col).alias("__id")).agg(
        F.min(label_col).alias("label"), F.max(label_col).alias("other")
    )
    once = once.filter(F.col("label") == F.col("other")).select("__id", "label")
    sides = [
        once.filter(F.col("label") == k).orderBy(_order(F.col("__id"), 1), "__id").limit(bound) for k in (0, 1)
    ]
    return sides[0].unionByName(sides[1])


def texts_of(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, label, text) of a bounded sample; it is small by its bound, so it is broadcast.

    Of several texts under one id the first by hash counts, so the rows are bounded too.
    """
    text = F.coalesce(quoted(text_col), F.lit(""))
    slim = docs.select(quoted(id_col).alias("__id"), text.cast("binary").alias("text"))
    first = F.min(F.struct(_order(F.col("text"), 4).alias("order"), "text")).alias("first")
    once = slim.join(F.broadcast(sample), "__id").groupBy("__id", "label").agg(first)
    return once.select("__id", "label", F.col("first.text").alias("text"))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    held_out: tuple[int, int] = HELD_OUT,
) -> CompressionModel:
    """Dictionaries and curve from a bounded sample of labelled rows that are not held out.

    Whole texts are cut into pieces in tasks; the driver gets the first ``DICT_PIECES`` pieces per
    class by hash, and one number per text of the curve. Without labelled rows every score is 1/2;
    with one class only it is that class's smoothed share.
    """
    remainder = id_remainder(F.col(id_col), held_out[0])
    for_curve = F.xxhash64(F.col(id_col), F.lit(2)) % 3 == 0
    usable = remainder != held_out[1]
    sample = labelled_sample(labels, id_col, label_col, usable & ~for_curve, DICT_TEXTS)
    schema = pa.schema([("label", pa.int32()), ("piece", pa.binary())])

    def cut(batches):
        for batch in batches:
            label, out = [], []
            for kind, text in zip(batch.column(0).to_pylist(), blobs(batch.column(1)), strict=True):
                own = pieces(text)
                label += [kind] * len(own)
                out += own
            yield arrow_batch(schema, label=label, piece=out)

    texts = texts_of(docs, sample, id_col, text_col).select("label", "text")
    cuts = texts.mapInArrow(released(cut), "label int, piece binary")
    trained = []
    for kind in (1, 0):
        chosen = cuts.filter(F.col("label") == kind).orderBy(_order(F.col("piece"), 3), "piece").limit(DICT_PIECES)
        trained.append(_dictionary([bytes(r.piece) for r in chosen.select("piece").collect()]))
    model = CompressionModel(*trained)

    sample = labelled_sample(labels, id_col, label_col, usable & for_curve, CURVE_TEXTS)
    measured = (
        texts_of(docs, sample, id_col, text_col)
        .select("label", "text")
        .mapInArrow(_applied(docs, model, model_difference), "label int, value double")
        .collect()
    )
    x = np.array([r.value for r in measured])
    y = np.array([r.label for r in measured], dtype=float)
    shares = labels.filter(usable & F.col(label_col).isin(0, 1)).groupBy(label_col).count().collect()
    count = {r[label_col]: r["count"] for r in shares}
    model.slope, model.intercept = fit_logistic(x, y)
    if count.get(0) and count.get(1) and y.sum() and y.sum() < len(y):
        # the sample holds the classes in other shares than the labelled rows do
        model.intercept += float(np.log(count[1] / count[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return model


def model_difference(model, text):
    return model.difference(text)


def model_score(model, text):
    return model.score(text)


def _applied(docs: DataFrame, model, function):
    """A batch function: the first column as it is, and a number from the text in the second."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        for batch in batches:
            values = [function(model, text) for text in blobs(batch.column(1))]
            names = [batch.schema.field(0).name, "value"]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], names)

    return released(run)


def score(docs: DataFrame, model, keep: list[str], text_col: str = "text") -> DataFrame:
    """(row, value): the columns in ``keep`` as a struct and the score of every row's whole text.

    A null text counts as empty and scores like a text that tells nothing. One row per row; columns
    may have any names. An empty table gives no rows.
    """
    slim = docs.select(held(keep).alias("row"), quoted(text_col).cast("binary").alias("text"))
    schema = StructType([slim.schema["row"], StructField("value", DoubleType())])
    return slim.mapInArrow(_applied(docs, model, model_score), schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``."""
    model = train(docs, labels)
    scored = score(docs, model, docs.columns)
    return scored.filter(F.col("value") >= threshold).select(*[F.col("row")[c].alias(c) for c in docs.columns])
