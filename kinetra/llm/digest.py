"""Document fingerprints: a quartile bucket digest of byte triplets.

Every three bytes in a row are hashed to one of 128 buckets. A bucket's count is written as the quartile of
all counts that it falls in (two bits); the header holds the length on a logarithmic scale and the ratios of
the quartiles. Two digests differ by a bounded score: steps between quartiles (the longest counts double),
length and ratios. Likeness is one minus its share of the maximum.

The comparison of a text with an edit of it needs the next document in order of id. Keys (id and text hash)
are cut into ranges without moving texts; then each text moves once, to its range, and the first text of a
range also to the range before it. A task reads its ranges in order and holds two texts at a time.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.llm.common import batch, map_batches, materialize, scratch, sliced, texts_of

BUCKETS = 128
#: Odd multipliers of the three bytes, and of their sum.
MIX = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)
BLOCK = 1 << 20
LENGTH_STEPS, RATIO_STEPS = 256, 16
#: Weights of the parts of the difference; length and ratio differences count up to their limits.
LENGTH_LIMIT, RATIO_WEIGHT, FAR_STEP = 64, 4, 6
MAX_DIFFERENCE = LENGTH_LIMIT + 2 * RATIO_WEIGHT * (RATIO_STEPS - 1) + FAR_STEP * BUCKETS

_BYTES = np.arange(256, dtype=np.uint32)
_TABLES = [_BYTES * np.uint32(m) for m in MIX[:3]]
_STEP = np.array([[0, 1, 2, FAR_STEP], [1, 0, 1, 2], [2, 1, 0, 1], [FAR_STEP, 2, 1, 0]], dtype=np.int64)


def counts(data: bytes) -> np.ndarray:
    """Triplets in each bucket."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for i in range(0, max(len(data) - 2, 0), BLOCK):
        b = np.frombuffer(data[i : i + BLOCK + 2], dtype=np.uint8)
        h = (_TABLES[0][b[:-2]] + _TABLES[1][b[1:-1]] + _TABLES[2][b[2:]]) * np.uint32(MIX[3])
        total += np.bincount(h >> np.uint32(25), minlength=BUCKETS)
    return total


def fingerprint(text: str) -> str:
    """68 hexadecimal digits: length, quartile ratios, 128 quartile codes. Texts under three bytes have no triplets."""
    data = text.encode()
    n = counts(data)
    q1, q2, q3 = np.sort(n)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]].tolist()
    codes = ((n > q1).astype(np.uint8) + (n > q2) + (n > q3)).reshape(-1, 4)
    body = codes[:, 0] << 6 | codes[:, 1] << 4 | codes[:, 2] << 2 | codes[:, 3]
    length = min(LENGTH_STEPS - 1, int(np.log1p(len(data)) * 10))
    low, mid = ((RATIO_STEPS - 1) * q // q3 if q3 else 0 for q in (q1, q2))
    return bytes([length, low << 4 | mid]).hex() + body.astype(np.uint8).tobytes().hex()


def difference(a: str, b: str) -> int:
    """Score from 0 (alike) to ``MAX_DIFFERENCE``."""
    x, y = (np.frombuffer(bytes.fromhex(s), dtype=np.uint8) for s in (a, b))
    out = min(LENGTH_LIMIT, abs(int(x[0]) - int(y[0])))
    out += RATIO_WEIGHT * sum(abs(int(x[1] >> s & 15) - int(y[1] >> s & 15)) for s in (4, 0))
    for s in (6, 4, 2, 0):
        out += int(_STEP[x[2:] >> s & 3, y[2:] >> s & 3].sum())
    return out


def likeness(a: str, b: str) -> float:
    return 1 - difference(a, b) / MAX_DIFFERENCE


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the start of the following one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows ``(doc_id, fingerprint)``, one for each row of ``docs(doc_id, text)``; a null text counts as empty."""

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), pa.array([fingerprint(t) for t in texts_of(rows)], pa.string())], names=["doc_id", "fingerprint"]
        )

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fingerprint string")


def _range_starts(keys: DataFrame, pieces: int) -> list[tuple[int, int, int]]:
    """First key of each of at most ``pieces`` ranges, in order; only these few reach the driver."""
    ranged = keys.repartitionByRange(pieces, *KEY).withColumn("p", F.spark_partition_id())
    first = ranged.groupBy("p").agg(F.min(F.struct(*KEY)).alias("k")).select("k.*")
    with scratch(keys.sparkSession):
        return sorted(map(tuple, materialize(first, "ranges").collect()))


KEY = ("rev", "h", "u")


def with_next(docs: DataFrame) -> DataFrame:
    """``(piece, extra, rev, h, u, doc_id, text)``: texts in ranges, each range followed by the first text of the next.

    Order: doc_id descending, null last, then the text's hash; ``u`` parts equal rows, so that any number of
    them spreads over ranges. After the last comes the first.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # descending ids as an ascending key: the complement has no overflow
    keyed = keyed.withColumns({"rev": F.bitwise_not(F.coalesce("doc_id", F.lit(-1 << 63))), "h": F.xxhash64("text"), "u": F.monotonically_increasing_id()})
    # null shares its place with the smallest id, which comes first
    half = F.shiftrightunsigned("h", 1)
    keyed = keyed.withColumn("h", F.when(F.col("doc_id").isNull(), half).when(F.col("doc_id") == F.lit(-1 << 63), half.bitwiseOR(F.lit(-1 << 63))).otherwise(F.col("h")))
    pieces = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts = _range_starts(keyed.select(*KEY), pieces)
    revs, rest = np.array([s[0] for s in starts], dtype=np.int64), [s[1:] for s in starts]
    n = max(len(starts), 1)

    @F.pandas_udf("array<int>")
    def places(rev: pd.Series, h: pd.Series, u: pd.Series) -> pd.Series:
        """The row's range, and the range before if the row starts its own."""
        r, k = rev.to_numpy(np.int64), list(zip(h.tolist(), u.tolist(), strict=True))
        low, high = np.searchsorted(revs, r, "left"), np.searchsorted(revs, r, "right")
        at = high - 1
        # ranges that start within one id (null, or rows that repeat it) are told apart by the rest of the key
        for i in np.flatnonzero(high > low):
            at[i] = bisect.bisect_right(rest, k[i], low[i], high[i]) - 1
        start = [revs[a] == x and rest[a] == y for a, x, y in zip(at.tolist(), r.tolist(), k, strict=True)]
        return pd.Series([[int(a), int(a - 1) % n + n] if s else [int(a)] for a, s in zip(at, start, strict=True)])

    placed = keyed.withColumn("place", F.explode(places(*KEY))).withColumn("extra", F.col("place") >= n)
    placed = placed.withColumn("piece", F.pmod("place", F.lit(n))).drop("place")
    return placed.repartition(pieces, "piece").sortWithinPartitions("piece", "extra", *KEY)


def compare_edits(docs: DataFrame) -> DataFrame:
    """Rows ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``, one for each row.

    The edited text ends with the start of the next document (``with_next``); that of a single document with
    its own. A null text counts as empty; null ids come last. Rows that repeat an id are neighbours. Texts
    are read whole. An empty table gives no rows; columns but ``doc_id`` and ``text`` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row that waits for the next one
        for rows in sliced(batches):
            out: list[tuple] = []
            for piece, extra, doc_id, text in zip(*(rows.column(c).to_pylist() for c in ("piece", "extra", "doc_id", "text")), strict=True):
                own = (piece, extra, doc_id, text, fingerprint(text))
                if held is not None and held[0] == piece and not held[1]:
                    out.append(_compared(held, own))
                held = own
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield batch(**{c: ([x[i] for x in out], k) for i, (c, k) in enumerate(zip(COLUMNS, kinds, strict=True))})

    own = with_next(docs).select("piece", "extra", "doc_id", "text")
    return own.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


COLUMNS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _compared(row: tuple, following: tuple) -> tuple:
    _, _, doc_id, text, own = row
    changed = edited(text, following[3])
    print_ = fingerprint(changed)
    digest = hashlib.sha256(changed.encode()).hexdigest()
    return doc_id, len(text), digest, own, print_, likeness(own, print_), likeness(own, following[4])
