"""Vector code compression: product codes whose codebooks are refined by Ball k-means, in exact integers.

Components become integers, vectors are cut into equal parts, and a codebook for each part position is refined by rounds of
assigning every part to its nearest entry and moving the entries to the means. The parts that an entry holds form a ball
around it. Its radius, the farthest of them, defines its neighbours: no other entry can be nearer to a member than one within
twice the radius. A part nearer to its entry than half the way to the nearest neighbour lies in the stable core and is not
looked at again. The others lie in rings: a part at distance d is compared with just the neighbours within 2 d of
its entry, in order of their distance. Equality counts as near, so ties still go to the lower index.

Scale: balls are taken over the members in an Arrow batch, which needs no pass of its own and makes them tighter. A round is one pass
over the vectors with their last codes, written as a table; the sums come back as one row for each part and entry from a task
and are added up by Spark. Only codebooks, of fixed size, reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.llm.common import dropped, materialize, scratch

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers of this size or more, and their sums, are Python's, not numpy's.
WIDE = 1 << 27
#: Bits of one summed limb.
LIMB = 40
#: Vectors whose candidates are compared at once.
BLOCK_ROWS = 8192


@dataclass
class Book:
    """The codebook of one part position: entries, and for each the others in order of distance."""

    entries: np.ndarray

    def __post_init__(self) -> None:
        e = self.entries
        apart = _squares(e[:, None], e[None, :])
        wide = apart.dtype == object
        rank = [sorted((j for j in range(len(e)) if j != i), key=lambda j, i=i: (apart[i, j], j)) for i in range(len(e))]
        self.near = np.array(rank, dtype=np.int64).reshape(len(e), len(e) - 1)
        self.apart = np.take_along_axis(apart, self.near, axis=1) if not wide else np.array([[apart[i, j] for j in r] for i, r in enumerate(rank)], dtype=object).reshape(self.near.shape)

    def assign(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry and squared distance of each part, from the entries ``own`` that hold them so far."""
        code, best = own.copy(), own.astype(self.entries.dtype if x.dtype != object else object)
        for i in range(0, len(x), BLOCK_ROWS):
            rows = slice(i, i + BLOCK_ROWS)
            code[rows], best[rows] = self._assign(x[rows], own[rows])
        return code, best

    def _assign(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d, code = _squares(x, self.entries[own]), own.copy()
        rings = np.zeros(len(x), dtype=np.int64)
        order = np.argsort(own, kind="stable")
        held, first = np.unique(own[order], return_index=True)
        for entry, members in zip(held, np.split(order, first[1:]), strict=True):
            # the ball's radius gives the neighbours; a part's own distance, how many of these its ring takes (none: stable core)
            neighbours = self.apart[entry]
            neighbours = neighbours[: np.searchsorted(neighbours, 4 * d[members].max(), "right")]
            rings[members] = np.searchsorted(neighbours, 4 * d[members], "right")
        open_ = np.flatnonzero(rings)
        if len(open_):
            many = rings[open_]
            starts = np.cumsum(many) - many
            row = np.repeat(open_, many)
            other = self.near[own[row], np.arange(len(row)) - np.repeat(starts, many)]
            far = _squares(x[row], self.entries[other])
            least = np.minimum.reduceat(far, starts)
            which = np.minimum.reduceat(np.where(far == np.repeat(least, many), other, len(self.entries)), starts)
            moves = (least < d[open_]) | ((least == d[open_]) & (which < own[open_]))
            at = open_[moves]
            code[at], d[at] = which[moves], least[moves]
        return code, d


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    e = a - b
    return (e * e).sum(axis=-1) if e.shape[-1] else np.zeros(e.shape[:-1], dtype=np.int64)


@dataclass
class Books:
    """Codebooks by part position, of ``width`` components each."""

    books: list[Book]
    width: int

    @classmethod
    def of(cls, entries: list[list[list[int]]], width: int) -> Books:
        """From integers by part, entry and position."""
        wide = any(abs(x) >= WIDE for part in entries for e in part for x in e)
        return cls([Book(np.array(part, dtype=object if wide else np.int64).reshape(len(part), width)) for part in entries], width)

    @property
    def values(self) -> list[list[list[int]]]:
        return [[[int(x) for x in e] for e in b.entries] for b in self.books]

    def sha256(self) -> str:
        """Of all integers in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for part in self.values for e in part for x in e).encode()).hexdigest()

    def assign(self, x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Codes of the vectors ``x`` (integers) and their squared distances summed over the parts."""
        out, error = np.zeros((len(x), len(self.books)), dtype=np.int64), np.zeros(len(x), dtype=object)
        for p, book in enumerate(self.books):
            part = x[:, p * self.width : (p + 1) * self.width]
            out[:, p], d = book.assign(part, codes[:, p].astype(np.int64))
            error = error + d
        return out.astype(np.uint8), error.tolist()


def _integers(column: pa.Array, size: int, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """floor(scale * x) of all components, padded to ``size`` with zeros: those of ordinary rows, of wide ones, and which are wide."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = np.pad(x, ((0, 0), (0, size - x.shape[1])))
    with np.errstate(over="ignore"):
        v = np.floor(x * scale)
    wide = (np.abs(v) >= WIDE).any(axis=1)
    # beyond 2 ** 53 a float is an integer itself
    large = np.array([[int(a) * scale if abs(a) >= 1 << 53 else int(np.floor(a * scale)) for a in row] for row in x[wide].tolist()], dtype=object)
    return v[~wide].astype(np.int64), large.reshape(-1, size), wide


def usable(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, label, v)`` of rows whose vector is not null or empty, has finite numbers only and the commonest length."""
    double = dict(embeddings.dtypes)["embedding"] != "array<float>"
    v = F.col("embedding").cast("array<double>") if double else F.col("embedding")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0)).where(fine)
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (size[0]["n"] if size else 0))


def _assigned(rows: DataFrame, books: Books, scale: int) -> DataFrame:
    """``rows(vec_id, label, v, codes)`` with new ``codes`` and their ``error`` (null beyond a long)."""
    shared, size = rows.sparkSession.sparkContext.broadcast(books), books.width * len(books.books)
    names = ["vec_id", "label", "v", "codes", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            plain, large, wide = _integers(b.column("v"), size, scale)
            old = np.frombuffer(b"".join(b.column("codes").to_pylist()), dtype=np.uint8).reshape(b.num_rows, -1)
            codes, error = np.zeros_like(old), np.zeros(b.num_rows, dtype=object)
            for x, at in ((plain, ~wide), (large, wide)):
                codes[at], error[at] = shared.value.assign(x, old[at])
            told = [e if e < 1 << 63 else None for e in error.tolist()]
            new = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(told, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:3]), *new], names=names)

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"vec_id long, label {kind['label']}, v {kind['v']}, codes binary, error long")


def _moved(rows: DataFrame, books: Books, scale: int) -> Books:
    """The codebooks with entries at the floored means of the parts that ``codes`` gives them; unused ones stay."""
    width, n_parts = books.width, len(books.books)
    n_entries = len(books.books[0].entries)
    sums = [f"s{k}" for k in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_parts, n_entries, width + 1), dtype=np.int64)
        beyond: dict[tuple[int, int], list[int]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            plain, large, wide = _integers(b.column("v"), width * n_parts, scale)
            codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), dtype=np.uint8).reshape(b.num_rows, -1)
            for p in range(n_parts):
                part, own = plain[:, p * width : (p + 1) * width], codes[~wide, p]
                np.add.at(total[p], own, np.column_stack([part, np.ones(len(part), dtype=np.int64)]))
                for x, c in zip(large[:, p * width : (p + 1) * width], codes[wide, p], strict=True):
                    own_sum = beyond.setdefault((p, int(c)), [0] * (width + 1))
                    beyond[p, int(c)] = [s + int(y) for s, y in zip(own_sum, (*x, 1), strict=True)]
        flat = []
        for p, c in zip(*np.nonzero(total[:, :, width]), strict=True):
            flat.append((int(p), int(c), 0, *total[p, c].tolist()))
        for (p, c), own in beyond.items():
            limb = 0
            while any(own):
                flat.append((p, c, limb, *[x & ((1 << LIMB) - 1) if x >= 0 else -(-x & ((1 << LIMB) - 1)) for x in own]))
                own, limb = [x >> LIMB if x >= 0 else -(-x >> LIMB) for x in own], limb + 1
        kinds = (pa.int32(), pa.int32(), pa.int32(), *[pa.int64()] * (width + 1))
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in flat], k) for j, k in enumerate(kinds)], names=["part", "entry", "limb", *sums, "n"])

    schema = "part int, entry int, limb int, " + ", ".join(f"{s} long" for s in (*sums, "n"))
    # a row for each part, entry and limb: bounded
    found = rows.select("v", "codes").mapInArrow(run, schema).groupBy("part", "entry", "limb").agg(*[F.sum(F.col(s).cast("decimal(38,0)")).alias(s) for s in (*sums, "n")])
    whole: dict[tuple[int, int], list[int]] = {}
    for r in found.collect():
        own = whole.setdefault((r["part"], r["entry"]), [0] * (width + 1))
        whole[r["part"], r["entry"]] = [a + (int(r[s]) << LIMB * r["limb"]) for a, s in zip(own, (*sums, "n"), strict=True)]
    values = books.values
    for (p, c), (*own, n) in whole.items():
        values[p][c] = [s // n for s in own]
    return Books.of(values, width)


def train(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[Books, DataFrame]:
    """Codebooks and a table ``(vec_id, label, v, codes, error)`` of the vectors' codes.

    A codebook starts as that part of the ``entries`` first rows by vec_id (equal ids by vector, null ids last), of all rows if there are
    fewer; ``entries`` is 256 at most. ``rounds`` times all parts are assigned and the entries moved; finally they are assigned again.
    Rows whose vector is null, empty, of another than the commonest length, or holds null or non-finite components are left out.
    Vectors whose length ``parts`` does not divide are padded with zeros. Rows that repeat an id stay rows of their own.
    """
    with scratch(embeddings.sparkSession) as keep:
        rows = usable(embeddings)
        first = [r["v"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]
        width = -(-len(first[0]) // parts) if first else 0
        start: list[list[list[int]]] = [[] for _ in range(parts)]
        for v in first:
            plain, large, wide = _integers(pa.array([v], pa.list_(pa.float64())), width * parts, scale)
            own = (large if wide[0] else plain)[0].tolist()
            for p in range(parts):
                start[p].append(own[p * width : (p + 1) * width])
        books = Books.of(start, width) if first else Books([], 0)
        rows = rows.withColumn("codes", F.lit(bytes(parts)))
        if not first:
            return books, rows.withColumn("error", F.lit(0).cast("long"))
        for k in range(rounds + 1):
            last, rows = rows, materialize(_assigned(rows.select("vec_id", "label", "v", "codes"), books, scale), "codes")
            if k:
                dropped(last)
            if k < rounds:
                books = _moved(rows, books, scale)
        keep(rows)
    return books, rows


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Rows ``(vec_id, code, error, label_error, codebooks_sha256)``, one for each usable row of ``embeddings(vec_id, embedding, label)``.

    ``code`` has two hex digits a part, ``error`` the final squared distances summed over the parts, ``label_error`` the errors
    summed over rows of equal label, null labels together (both null beyond a long). See ``train`` for what is left out; an empty
    table gives no rows, other columns are not read.
    """
    books, rows = train(embeddings, parts, entries, rounds, scale)
    total = F.when(F.count("*") == F.count("error"), F.try_sum("error"))
    by = rows.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    return rows.join(by, rows["label"].eqNullSafe(by["of"])).select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")
    )


_FLOOR = "(s - ((s % n) + n) % n) // n"


def _sql() -> str:
    """The same rows in DuckDB: all distances, the least of each part."""
    out = r"""
WITH e AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), v AS (
  SELECT r, p, list_transform(range(len(x) // 16), lambda i: CAST(floor(CAST(x[p * (len(x) // 16) + i + 1] AS DOUBLE) * 256) AS BIGINT)) AS x
  FROM (SELECT r, x, unnest(range(16)) AS p FROM e)
), b0 AS (
  SELECT p, r - 1 AS k, x AS c FROM v WHERE r <= 64
)"""
    for k in range(ROUNDS + 1):
        out += f""", a{k} AS (
  SELECT r, p, min(d) AS d, arg_min(k, (d, k)) AS k FROM (
    SELECT r, v.p, k, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS d FROM v JOIN b{k} b ON v.p = b.p
  ) GROUP BY r, p
)"""
        if k < ROUNDS:
            out += f""", m{k} AS (
  SELECT p, k, list(CAST({_FLOOR} AS BIGINT) ORDER BY i) AS c FROM (
    SELECT p, k, i, CAST(sum(y) AS BIGINT) AS s, count(*) AS n
    FROM (SELECT v.p, a.k, unnest(v.x) AS y, unnest(range(len(v.x))) AS i FROM v JOIN a{k} a ON v.r = a.r AND v.p = a.p) GROUP BY p, k, i
  ) GROUP BY p, k
), b{k + 1} AS (
  SELECT b.p, b.k, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m ON b.p = m.p AND b.k = m.k
)"""
    return out + f""", f AS (
  SELECT r, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r
), s AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b{ROUNDS}
)
SELECT e.vec_id, f.code, f.error, CAST(sum(f.error) OVER (PARTITION BY e.label) AS BIGINT) AS label_error, s.codebooks_sha256
FROM e JOIN f USING (r), s
"""


SQL = _sql()
