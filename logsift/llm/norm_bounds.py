"""Vector code compression: a codebook per part of the vectors, learned with norm-of-sum bounds.

Vectors are scaled to integers and cut into consecutive parts. Every part position has a codebook, which
starts as the parts of the first vectors by id. A round assigns each part to the nearest entry and then
moves the entries to the floored means of their parts.

Few parts need all distances anew. Each part keeps an upper bound of the distance to its own entry and a
lower bound of the distance to any other one, both exact when they were measured, and the round in which
that was (its stamp). All codebooks so far are kept. An entry's *net* displacement since a stamp is then
one norm, of the sum of its moves; the sum of the norms of the moves, which is the usual bound, is never
smaller. A part is safe while

    upper + displacement(own entry) < lower - largest displacement of another entry.

If not, the distance to the own entry is measured and the test repeated, and only then are all entries
compared. Distances are whole numbers and the comparison is strict, so results are those of comparing all.

Rows are never collected: each task adds up its parts by entry, the small sums are added by Spark, and the
driver only holds codebooks. Each round's rows are written to the shared folder and read by the next.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logsift.sources.scratch import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integer components are held within this, so that no squared distance leaves 64 bits.
LIMIT = 1 << 26
SLACK = 1e-9  # relative room for rounding in the bounds
RESCANNED = -1  # the cell that counts parts whose distances were all computed
STATE = "own array<smallint>, upper array<float>, lower array<float>, upper_at array<smallint>, lower_at array<smallint>"
STATE_NAMES = tuple(c.split()[0] for c in STATE.split(", "))

Codebook = list[np.ndarray]  # per part: entries times width


@dataclass
class Compressed:
    """``rows`` (row, code array<smallint>, error long, length int); the rest is by vector length."""

    rows: DataFrame
    codebooks: dict[int, Codebook] = field(default_factory=dict)
    #: Parts compared with all entries, for each assignment.
    rescans: dict[int, list[int]] = field(default_factory=dict)


def cuts(length: int, parts: int) -> list[int]:
    """Where the parts start and the last one ends; their widths differ by one at most."""
    return [p * length // parts for p in range(parts + 1)]


def integer_vectors(df: DataFrame, vec_col: str, keep: list[str], scale: int = SCALE) -> DataFrame:
    """(row, x): the kept columns as one struct, and ``floor(scale * component)``.

    Rows whose vector is null or has a null or non-finite component are left out.
    """
    vec = F.col("__vec")
    finite = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("int")
    quoted = [F.col(f"`{name.replace('`', '``')}`").alias(name) for name in (*keep, vec_col)]
    slim = df.select(F.struct(*quoted[:-1]).alias("row"), quoted[-1].cast("array<double>").alias("__vec"))
    return slim.filter(vec.isNotNull() & finite).select("row", F.transform(vec, whole).alias("x"))


def square_distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries."""
    width = max(1, x.shape[1])
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)), 1)
    if 8 * width * top * top < 1 << 53:  # whole numbers that doubles hold
        a, b = x.astype(np.float64), entries.astype(np.float64)
        found = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
        return found.astype(np.int64)
    found = np.zeros((len(x), len(entries)), dtype=np.int64)
    for column in range(x.shape[1]):
        found += np.square(x[:, column, None] - entries[None, :, column])
    return found


def own_distances(x: np.ndarray, entries: np.ndarray, own: np.ndarray) -> np.ndarray:
    return np.square(x - entries[own]).sum(axis=1)


def displacements(history: list[Codebook], part: int) -> tuple[np.ndarray, np.ndarray]:
    """By stamp and entry: the entry's own net displacement up to now, and the largest of the others."""
    now = history[-1][part]
    moved = np.array([np.sqrt(np.square(now - then[part]).sum(axis=1, dtype=np.float64)) for then in history])
    if moved.shape[1] < 2:
        return moved, np.zeros_like(moved)
    order = np.sort(moved, axis=1)
    others = np.where(moved == order[:, -1:], order[:, -2:-1], order[:, -1:])
    tied = order[:, -1] == order[:, -2]
    others[tied] = order[tied, -1:]
    return moved, others


def assign_part(x: np.ndarray, history: list[Codebook], part: int, state=None):
    """The new state of one part position and how many rows were compared with all entries.

    The state is (own, upper, lower, upper_at, lower_at), arrays by row; None on the first assignment.
    """
    entries, now = history[-1][part], len(history) - 1
    n = len(x)
    if state is None:
        own, todo = np.zeros(n, dtype=np.int64), np.arange(n)
        upper, lower = np.zeros(n, dtype=np.float32), np.zeros(n, dtype=np.float32)
        upper_at, lower_at = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    else:
        own, upper, lower, upper_at, lower_at = (a.copy() for a in state)
        moved, others = displacements(history, part)

        def unsafe(rows):
            high = upper[rows].astype(np.float64) + moved[upper_at[rows], own[rows]]
            low = lower[rows].astype(np.float64) - others[lower_at[rows], own[rows]]
            return rows[~(high * (1 + SLACK) < low * (1 - SLACK))]

        todo = unsafe(np.arange(n))
        upper[todo] = _up(own_distances(x[todo], entries, own[todo]))
        upper_at[todo] = now
        todo = unsafe(todo)
    if len(todo):
        found = square_distances(x[todo], entries)
        own[todo] = found.argmin(axis=1)  # the first of equal ones
        at = np.arange(len(todo))
        upper[todo] = _up(found[at, own[todo]])
        if found.shape[1] > 1:
            found[at, own[todo]] = np.iinfo(np.int64).max
            lower[todo] = np.nextafter(np.sqrt(found.min(axis=1)).astype(np.float32), np.float32(0))
        else:
            lower[todo] = np.inf
        upper_at[todo] = lower_at[todo] = now
    return (own, upper, lower, upper_at, lower_at), len(todo)


def _up(squares: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(squares).astype(np.float32), np.float32(np.inf))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(matrix.ravel(), kind))


STATE_KINDS = (pa.int16(), pa.float32(), pa.float32(), pa.int16(), pa.int16())


def _assigned(batch: pa.RecordBatch, history: list[Codebook], edges: list[int]):
    """Parts, their new states and the number of rescans of one batch (row, x, state...)."""
    x = _matrix(batch.column(1), edges[-1]).astype(np.int64)
    pieces = [x[:, a:b] for a, b in zip(edges, edges[1:], strict=False)]
    old = None
    if batch.num_columns > 2:
        old = [_matrix(batch.column(2 + i), len(pieces)) for i in range(len(STATE_NAMES))]
        old = [m if m.dtype == np.float32 else m.astype(np.int64) for m in old]
    states, rescanned = [], 0
    for part, piece in enumerate(pieces):
        state, count = assign_part(piece, history, part, old and [m[:, part] for m in old])
        states.append(state)
        rescanned += count
    return pieces, states, rescanned


def _schema(rows: DataFrame, more: str) -> StructType:
    return StructType([rows.schema["row"], *StructType.fromDDL(more)])


def _round(rows: DataFrame, history: list[Codebook], length: int, name: str) -> tuple[DataFrame, dict[int, int]]:
    """The rows with their new state, and the sums of the parts by cell.

    Tasks write both into one table: rows have no cell, sums have nothing else. A cell is a part's entry
    with one of its components or, last, with the number of its parts.
    """
    parts = len(history[-1])
    edges, entries = cuts(length, parts), len(history[-1][0])
    width = max(b - a for a, b in zip(edges, edges[1:], strict=False)) + 1
    schema = _schema(rows, f"x array<int>, {STATE}, cell int, value bigint")

    def run(batches):
        sums = np.zeros((parts, entries, width), dtype=np.int64)
        rescanned, kinds = 0, None
        for batch in batches:
            kinds = (batch.column(0).type, batch.column(1).type)
            if not batch.num_rows:
                continue
            pieces, states, count = _assigned(batch, history, edges)
            rescanned += count
            for part, (piece, state) in enumerate(zip(pieces, states, strict=True)):
                columns = [piece[:, c].astype(np.float64) for c in range(piece.shape[1])]
                for c, values in enumerate(columns):  # a batch's sums are whole numbers below 2**53
                    sums[part, :, c] += np.bincount(state[0], values, minlength=entries).astype(np.int64)
                sums[part, :, width - 1] += np.bincount(state[0], minlength=entries)
            stacked = [np.stack([s[i] for s in states], axis=1) for i in range(len(STATE_NAMES))]
            lists = [_lists(m, kind) for m, kind in zip(stacked, STATE_KINDS, strict=True)]
            none = [pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists, *none], names=schema.names)
        if kinds:
            cells = np.flatnonzero(sums)
            values = [*sums.ravel()[cells], rescanned]
            blank = [pa.nulls(len(values), kind) for kind in (*kinds, *map(pa.list_, STATE_KINDS))]
            found = [pa.array([*cells, RESCANNED], pa.int32()), pa.array(values, pa.int64())]
            yield pa.RecordBatch.from_arrays([*blank, *found], names=schema.names)

    landed = materialize(rows.mapInArrow(run, schema), name)
    totals = landed.filter(F.col("cell").isNotNull()).groupBy("cell").agg(F.sum("value").alias("value"))
    return (
        landed.filter(F.col("cell").isNull()).select("row", "x", *STATE_NAMES),
        {r.cell: r.value for r in totals.collect()},  # parts times entries times width
    )


def _moved(last: Codebook, totals: dict[int, int]) -> Codebook:
    """Entries at the floored means of their parts; unused entries stay."""
    entries = len(last[0])
    width = max(c.shape[1] for c in last) + 1
    sums = np.zeros(len(last) * entries * width, dtype=np.int64)
    for cell, value in totals.items():
        if cell != RESCANNED:
            sums[cell] = value
    sums = sums.reshape(len(last), entries, width)
    made = []
    for part, old in enumerate(last):
        count = sums[part, :, -1:]
        mean = np.floor_divide(sums[part, :, : old.shape[1]], np.maximum(count, 1))
        made.append(np.where(count > 0, mean, old))
    return made


def _coded(rows: DataFrame, history: list[Codebook], length: int) -> DataFrame:
    """(row, code, error): the last assignment and its exact squared distance."""
    edges = cuts(length, len(history[-1]))
    schema = _schema(rows, "code array<smallint>, error bigint, rescanned int")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            pieces, states, count = _assigned(batch, history, edges)
            own = [state[0] for state in states]
            error = sum(own_distances(p, c, o) for p, c, o in zip(pieces, history[-1], own, strict=True))
            share = np.zeros(batch.num_rows, dtype=np.int32)
            share[0] = count
            columns = [batch.column(0), _lists(np.stack(own, axis=1), pa.int16()), pa.array(error, pa.int64()), pa.array(share)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def compress(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    keep: list[str] | None = None,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    bounds: bool = True,
) -> Compressed:
    """Codes, errors and codebooks of every vector; ``keep`` names the columns to carry (the id).

    A null vector and one with a null or non-finite component are left out; repeated rows count as often
    as they stand. Entries start as the ``entries`` smallest ids (equal ids by vector, null ids last), or
    as all vectors if there are fewer. Ties go to the smaller entry. A length that ``parts`` does not
    divide gives parts whose widths differ by one. Vectors of different lengths are compressed
    by themselves, one after another; a table is expected to have few lengths. Scaled components are held
    within 2**26. An empty table gives no rows. ``bounds=False`` compares every part with all entries.
    """
    keep = [id_col] if keep is None else keep
    ids = [id_col, *[c for c in keep if c != id_col]]
    rows = materialize(integer_vectors(df, vec_col, ids, scale), "integer-vectors")
    lengths = sorted(r[0] for r in rows.select(F.size("x")).distinct().collect()) or [0]
    tables, books, rescans = [], {}, {}
    for length in lengths:
        mine = rows.filter(F.size("x") == length)
        first = mine.orderBy(F.col("row")[id_col].asc_nulls_last(), "x").limit(entries)
        start = [r.x for r in first.select("x").collect()]
        start = np.array(start, dtype=np.int64).reshape(len(start), length)
        edges = cuts(length, parts)
        history = [[start[:, a:b] for a, b in zip(edges, edges[1:], strict=False)]]
        counts = []
        for at in range(rounds):
            seen = history if bounds else history[-1:]
            mine, totals = _round(mine if bounds else mine.select("row", "x"), seen, length, f"codes{at}")
            counts.append(totals.get(RESCANNED, 0))
            history.append(_moved(history[-1], totals))
        seen = history if bounds else history[-1:]
        coded = materialize(_coded(mine if bounds else mine.select("row", "x"), seen, length), "codes")
        counts.append(coded.agg(F.coalesce(F.sum("rescanned"), F.lit(0))).first()[0])
        chosen = F.struct(*[F.col("row")[name].alias(name) for name in keep]).alias("row")
        tables.append(coded.select(chosen, "code", "error", F.lit(length).alias("length")))
        books[length], rescans[length] = history[-1], counts
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table)
    return Compressed(whole, books, rescans)


def code_text(code: Column) -> Column:
    """Two hex digits (or more, for larger indices) per part."""
    return F.array_join(F.transform(code, lambda c: F.lpad(F.lower(F.hex(c.cast("long"))), 2, "0")), "")


def codebook_digest(book: Codebook) -> str:
    """sha256 of all entries' components by part, entry and position."""
    text = ",".join(str(int(v)) for part in book for v in part.ravel())
    return hashlib.sha256(text.encode()).hexdigest()


def decode(codes: np.ndarray, book: Codebook) -> np.ndarray:
    """The integer vectors that codes stand for."""
    return np.concatenate([part[codes[:, p]] for p, part in enumerate(book)], axis=1)
