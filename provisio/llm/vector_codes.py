"""Compression of vectors into codes of 16 parts, whose nearest codebook entries a VA-file finds.

A vector of integers is cut into equal parts; each part becomes the index of its nearest entry in that part position's
codebook. The VA-file works on the entries: each coordinate axis is cut into cells, and an entry is known by its cells
alone. For each part to encode, a lookup table by axis and cell gives the least and the greatest squared distance that an
entry in the cell can have, so sums of table values bound an entry's distance from below and above. Entries whose lower
bound exceeds the least upper bound are out; the others are refined with exact integer distances.

Codebooks are learned by rounds of assignment and averaging: each task sums the parts of its rows by position and entry, a
shuffle by these sums the tasks' sums, and only the codebooks, whose size is fixed, reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spool, table, unused

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Components become floor(SCALE * x).
SCALE = 256
#: Bits of a cell: each axis has 2 ** BITS cells.
BITS = 4
#: Scaled components stay below this, so that a squared distance fits into a long.
LARGEST = 2**28
#: Parts that are encoded at once in a task.
BLOCK = 2_048


@dataclass
class VaFile:
    """The entries of one codebook and the cells they lie in.

    entries [m, d] integers; cells [d, m]: an entry's cell on each axis; low, high [d, 2 ** BITS]: the least and the
    greatest coordinate that entries in a cell have (both 0 in a cell without entries).
    """

    entries: np.ndarray
    cells: np.ndarray
    low: np.ndarray
    high: np.ndarray


def va_file(entries: np.ndarray, bits: int = BITS) -> VaFile:
    """Quantise the entries' coordinates: on each axis as many entries in each cell as ties allow."""
    m, d = entries.shape
    count = 2**bits
    cells, low, high = np.zeros((d, m), np.int64), np.zeros((d, count), np.int64), np.zeros((d, count), np.int64)
    for axis in range(d):
        values = np.sort(entries[:, axis])
        borders = np.unique(values[(np.arange(1, count) * m) // count])
        cells[axis] = np.searchsorted(borders, entries[:, axis], "right")
        for cell in np.unique(cells[axis]):
            inside = entries[cells[axis] == cell, axis]
            low[axis, cell], high[axis, cell] = inside.min(), inside.max()
    return VaFile(entries, cells, low, high)


def bounds(va: VaFile, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds [n, m] of the squared distances of queries [n, d] to all entries, by lookup tables."""
    below = np.zeros((len(queries), len(va.entries)), np.int64)
    above = np.zeros_like(below)
    for axis in range(queries.shape[1]):
        q = queries[:, axis, None]
        least = np.maximum(np.maximum(va.low[axis] - q, q - va.high[axis]), 0) ** 2
        most = np.maximum(np.abs(q - va.low[axis]), np.abs(q - va.high[axis])) ** 2
        below += least[:, va.cells[axis]]
        above += most[:, va.cells[axis]]
    return below, above


def nearest(va: VaFile, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry for each query [n, d] of integers; ties go to the lower index."""
    found, distance = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
    for at in range(0, len(queries), BLOCK):
        q = queries[at : at + BLOCK]
        below, above = bounds(va, q)
        # An entry that is as near as the nearest one has a lower bound within the least upper bound, so no tie is lost.
        row, entry = np.nonzero(below <= above.min(1, keepdims=True))
        exact = np.full(below.shape, np.iinfo(np.int64).max)
        exact[row, entry] = ((q[row] - va.entries[entry]) ** 2).sum(1)
        found[at : at + BLOCK] = exact.argmin(1)
        distance[at : at + BLOCK] = exact.min(1)
    return found, distance


def scaled(vector: Column) -> Column:
    """The vector's components as integers: floor(256 * x)."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))


def usable(vector: Column) -> Column:
    """Whether the vector is there and all its components are finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: finite(x.cast("double"))), F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _sums(vectors: DataFrame, files: list[VaFile], width: int) -> DataFrame:
    """part, entry, n and the summed components s0, s1, … of the parts nearest to each entry, as far as there are any."""
    step = width // len(files)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(f.entries), np.int64) for f in files]
        sums = [np.zeros(f.entries.shape, np.int64) for f in files]
        for batch in batches:
            rows = _matrix(batch.column(0), width)
            for p, file in enumerate(files):
                part = rows[:, p * step : (p + 1) * step]
                entry, _ = nearest(file, part)
                counts[p] += np.bincount(entry, minlength=len(file.entries))
                np.add.at(sums[p], entry, part)
        for p, file in enumerate(files):
            used = np.nonzero(counts[p])[0]
            columns = [np.full(len(used), p), used, counts[p][used], *sums[p][used].T]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names)

    names = ["part", "entry", "n", *(f"s{i}" for i in range(step))]
    partial = vectors.select("ints").mapInArrow(run, ", ".join(f"{n} long" for n in names))
    return partial.groupBy("part", "entry").agg(*(F.sum(n).alias(n) for n in names[2:]))


def fit(vectors: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks, [entries, width / parts] integers for each part position, of vectors (id, ints).

    They start as the parts of the vectors with the smallest ids; each round takes the componentwise floor of the mean of
    the parts that are nearest to an entry. Unused entries stay.
    """
    step = width // parts
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()
    start = np.array([r.ints for r in first], np.int64).reshape(len(first), width)
    books = [start[:, p * step : (p + 1) * step].copy() for p in range(parts)]
    for _ in range(rounds if len(first) else 0):
        for row in _sums(vectors, [va_file(b) for b in books], width).collect():
            books[row.part][row.entry] = [total // row.n for total in row[3:]]
    return books


def encode(vectors: DataFrame, books: list[np.ndarray], width: int, carried: list[str]) -> DataFrame:
    """The carried columns of vectors, then code (two hex digits a part) and error (squared distances summed over parts)."""
    files, step = [va_file(b) for b in books], width // len(books)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(0), width)
            codes, error = np.zeros((len(rows), len(files)), np.uint8), np.zeros(len(rows), np.int64)
            for p, file in enumerate(files):
                entry, distance = nearest(file, rows[:, p * step : (p + 1) * step])
                codes[:, p] = entry
                error += distance
            texts = [c.tobytes().hex() for c in codes]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array(error)], [*carried, "code", "error"])

    schema = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in carried)
    return vectors.select("ints", *carried).mapInArrow(run, f"{schema}, code string, error long")


def fingerprint(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """(codes, codebooks) of a table of vectors; codes has id, label, code, error for each usable vector.

    Rows whose vector is null or holds null, NaN or infinite components go. Repeated rows and ids each get their row; a
    null id comes last in the choice of the first entries, and among equal ids the smaller vector comes first. Fewer
    vectors than entries give smaller codebooks, and no vectors none. Null labels are a label like any other. At most
    256 entries, so that an index has two hex digits. Vectors must be of one length that the parts divide, and components
    below 2**20 in magnitude, else the job ends with an error. Other columns are not looked at.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    vector = F.col(vector_col)
    kept = vectors.filter(usable(vector)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), scaled(vector).alias("ints"))
    kept = spool(kept, "vectors")
    largest = F.array_max(F.transform("ints", lambda x: F.abs(x)))
    shape = kept.agg(F.min(F.size("ints")).alias("least"), F.max(F.size("ints")).alias("most"), F.max(largest).alias("largest")).first()
    width = shape.least or 0
    if shape.least is not None and (shape.least != shape.most or width % parts or not width):
        raise ValueError(f"vectors must be of one length that {parts} divides; found {shape.least} to {shape.most}")
    if (shape.largest or 0) >= LARGEST:
        raise ValueError("vector components must be below 2**20 in magnitude")
    books = fit(kept, width, parts, entries, rounds)
    return encode(kept, books, width, ["id", "label"]), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all `embeddings`: 16 parts, 64 entries, two rounds."""
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    codes = spool(codes, "codes")
    # The sums are written first, so both sides of the join are plain shuffles and Spark can split a frequent label.
    sums = spool(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "label_errors").withColumnRenamed("label", unused(codes, "of"))
    joined = codes.join(sums, codes["label"].eqNullSafe(sums[sums.columns[0]]))
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


_PART = "list_transform(range(1, 17), lambda p: list_slice(ints, (p - 1) * len(ints) // 16 + 1, p * len(ints) // 16))"
_DIST = "list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - b.x[i]) * (v.x[i] - b.x[i])))::BIGINT"


def _round(r: int) -> str:
    """SQL of one round: assignment to codebook r, then codebook r + 1."""
    return f"""
a{r} AS MATERIALIZED (
  SELECT row, part, x, arg_min(e, (d, e)) AS e, min(d) AS d
  FROM (SELECT v.row, v.part, v.x, b.e, {_DIST} AS d FROM v JOIN b{r} b USING (part)) GROUP BY row, part, x),
s{r} AS (
  SELECT part, e, i, sum(x[i])::BIGINT AS s, count(*) AS n
  FROM (SELECT part, e, x, unnest(range(1, len(x) + 1)) AS i FROM a{r}) GROUP BY part, e, i),
m{r} AS (SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{r} GROUP BY part, e),
b{r + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m{r} m USING (part, e)),"""


OP12_SQL = f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, ints) AS row, vec_id, label, ints
  FROM (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS ints FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
v AS MATERIALIZED (SELECT row, unnest(range(0, 16)) AS part, unnest({_PART}) AS x FROM k),
b0 AS MATERIALIZED (SELECT part, row - 1 AS e, x FROM v WHERE row <= 64),
{_round(0)}{_round(1)}{_round(2)}
c AS (SELECT row, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY row),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b2)
SELECT k.vec_id, c.code, c.error, sum(c.error) OVER (PARTITION BY k.label)::BIGINT AS label_error, h.codebooks_sha256
FROM k JOIN c USING (row) CROSS JOIN h
"""
