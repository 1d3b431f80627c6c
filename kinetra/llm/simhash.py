"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into ``max_bits // 2 + 1`` segments. Two fingerprints that differ in at
most ``max_bits`` bits then have a segment in which at most one bit differs. Every segment is indexed once
for each of its bits with that bit wildcarded, candidates meet in an equality join on the variant, and a
bit count verifies them.

Scale: equal fingerprints collapse first, so a group of copies is one row. A variant's bucket is counted
before its members are listed, and a very common variant is found on a sample and never gathered. One with more than ``bucket_limit`` different fingerprints is refined: the bits that
its key leaves free are cut again by the same rule, until a bucket is small; with eight free bits it has at
most 2 ** (8 + wildcards) members. Inside a bucket a spanning forest of the verified links is emitted,
never all pairs, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetra.llm.common import batch, bytes_of, lower_words, map_batches, materialize, scratch
from kinetra.llm.graph import connected

#: Shingles whose bits are counted at once; bounds memory for very long texts.
BLOCK = 1 << 16
BUCKET_LIMIT = 4096
#: One fingerprint in so many is looked at to find very common keys.
SAMPLED = 16
#: A bucket whose key leaves so few bits free, besides the wildcards, is small and not refined further.
LAST_BITS = 8


def simhash(text: bytes, width: int = 3) -> int:
    """Signed 64-bit SimHash of a UTF-8 text's word shingles; 0 for a text without words."""
    words = lower_words(text)
    if not words:
        return 0
    if len(words) < width:
        grams: Iterator = iter([tuple(words)])
        n = 1
    else:
        grams = zip(*(words[i:] for i in range(width)), strict=False)
        n = len(words) - width + 1
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if n == 1:
        return int(np.uint64(digest(join(next(grams)), 42)).astype(np.int64))
    ones = np.zeros(64, dtype=np.int64)
    done = 0
    while done < n:
        size = min(BLOCK, n - done)
        h = np.fromiter((digest(join(g), 42) for g, _ in zip(grams, range(size), strict=False)), np.uint64, size)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(size, 8), axis=1).sum(axis=0, dtype=np.int64)
        done += size
    return int(np.packbits(ones * 2 > n).view(">i8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, text_key, fp)`` for every row of ``docs``; a null text has fingerprint 0."""

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), rows.column("text_key"), pa.array([simhash(t, width) for t in bytes_of(rows)], pa.int64())],
            names=["doc_id", "text_key", "fp"],
        )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return map_batches(own, run, "doc_id long, text_key long, fp long")


def _variants(free: int, parts: int) -> list[tuple[int, int]]:
    """``(fixed, still free)`` bit masks: the set bits of ``free`` cut into parts, each with one bit wildcarded."""
    bits = [i for i in range(64) if free >> i & 1]
    out = []
    for k in range(parts):
        own = bits[len(bits) * k // parts : len(bits) * (k + 1) // parts]
        rest = free & ~sum(1 << i for i in own)
        out += [(sum(1 << j for j in own if j != i), rest) for i in own]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spanning_links(members: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links (at most ``max_bits`` differing bits) among ``members``.

    Breadth first from any member: what has been reached is not compared again, so a dense bucket costs
    little more than its size; a bucket of strangers costs its square, which ``BUCKET_LIMIT`` bounds.
    """
    rest = members.view(np.uint64)
    out = []
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            found = np.full(len(rest), -1, dtype=np.int64)
            for i in range(0, len(front), 256):
                open_ = np.flatnonzero(found < 0)
                if not len(open_):
                    break
                near = np.bitwise_count(rest[open_][:, None] ^ front[None, i : i + 256]) <= max_bits
                hit = near.any(axis=1)
                found[open_[hit]] = near[hit].argmax(axis=1) + i
            got = found >= 0
            out += zip(front[found[got]].view(np.int64).tolist(), rest[got].view(np.int64).tolist(), strict=True)
            front, rest = rest[got], rest[~got]
    return out


def _bucket_links(buckets: DataFrame, max_bits: int) -> DataFrame:
    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        found = [
            link for members in rows.column("members") for link in spanning_links(np.array(members.as_py(), np.int64), max_bits)
        ]
        return batch(a=([x for x, _ in found], pa.int64()), b=([y for _, y in found], pa.int64()))

    return map_batches(buckets.select("members"), run, "a long, b long")


def links(fps: DataFrame, max_bits: int = 3, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links ``(a, b)`` that connect the distinct fingerprints ``fps(fp)`` as all links would."""
    parts = max_bits // 2 + 1
    start = _variants((1 << 64) - 1, parts)
    keys = fps.select(
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m, _ in start])).alias("slot", "value"),
    ).select("fp", F.col("slot").cast("short").alias("slot"), "value")
    key = ["slot", "value"]
    out = []
    while True:
        # keys that a sample shows to be very common are refined at once and never meet in one task
        common = _common(keys, key, bucket_limit)
        often = None
        if common is not None:
            often, keys = keys.join(common, key, "left_semi"), keys.join(common, key, "left_anti")
        # counted where they meet, so that variants move once and those that meet no other go no further
        counted = keys.withColumn("n", F.count("*").over(Window.partitionBy(*key)))
        inside = materialize(counted.where("n > 1"), "buckets")
        small = F.col("n") <= bucket_limit
        if "free" in key:
            small = small | (F.bit_count("free") <= LAST_BITS)
        members = inside.where(small).groupBy(*key).agg(F.collect_list("fp").alias("members"))
        out.append(_bucket_links(members, max_bits))
        hot = inside.where(~small).drop("n")
        if often is not None:
            hot = hot.unionByName(often)
        if hot.isEmpty():
            break
        if "slot" in key:
            at = F.col("slot").cast("int") + 1
            hot = hot.select(
                "fp",
                F.element_at(F.array(*[F.lit(_signed(m)) for m, _ in start]), at).alias("fixed"),
                F.element_at(F.array(*[F.lit(_signed(f)) for _, f in start]), at).alias("free"),
            )
        hot = materialize(hot.select("fp", "fixed", "free"), "hot")
        keys = _refined(hot, parts)
        key = ["fixed", "free", "value"]
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def _common(keys: DataFrame, key: list[str], bucket_limit: int) -> DataFrame | None:
    """The keys that by a sample hold many times ``bucket_limit`` fingerprints; None if there are none.

    Only the plan depends on the sample: a bucket gives the same links whether it is refined or not.
    """
    if "free" in key:
        keys = keys.where(F.bit_count("free") > LAST_BITS)
    some = keys.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLED)) == 0).groupBy(*key).count()
    found = materialize(some.where(F.col("count") > bucket_limit).select(*key), "common")
    return None if found.isEmpty() else found


def _refined(hot: DataFrame, parts: int) -> DataFrame:
    """Cut the bits that each row's key leaves free again."""

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        fp, fixed, free, value = [], [], [], []
        for f, m, r in zip(*(rows.column(c).to_pylist() for c in ("fp", "fixed", "free")), strict=True):
            for add, rest in _variants(r & (1 << 64) - 1, parts):
                mask = m & (1 << 64) - 1 | add
                fp.append(f)
                fixed.append(_signed(mask))
                free.append(_signed(rest))
                value.append(_signed(f & (1 << 64) - 1 & mask))
        kind = pa.int64()
        return batch(fp=(fp, kind), fixed=(fixed, kind), free=(free, kind), value=(value, kind))

    return map_batches(hot, run, "fp long, fixed long, free long, value long")


def near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = 3, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Rows ``(doc_id, fingerprint, component_id, text_key)``, one for each row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest doc_id that links of at most ``max_bits`` bits reach; ``text_key`` is
    a hash of the text. Null and wordless texts have fingerprint 0 and are linked like any other. Null ids
    are never a component's id; it is null where a component has no other. Repeated rows are returned as
    often as they come. An empty table gives no rows; other columns are not read.
    """
    with scratch(docs.sparkSession) as keep:
        own = keep(materialize(fingerprints(docs, width), "fingerprints"))
        fps = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
        labels = connected(links(fps.select("fp"), max_bits, bucket_limit))
        rooted = fps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", "first_id", F.coalesce("root", "fp").alias("root")
        )
        first = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
        classes = keep(materialize(rooted.join(first, "root").select("fp", "component_id"), "classes"))
    return own.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_key"
    )


def keep_one(docs: DataFrame, width: int = 3, max_bits: int = 3) -> DataFrame:
    """``docs`` without near copies: of each component the rows of its smallest doc_id stay.

    Rows that repeat this doc_id in the component are the same document and stay with it. Rows without an
    id can't be told apart and stay. All columns are kept, whatever their names.
    """
    with scratch(docs.sparkSession) as keep:
        gone = (
            near_duplicates(docs, width, max_bits)
            .where("doc_id <> component_id")
            .select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"))
        )
        gone = keep(materialize(gone.distinct(), "gone"))
    same = (docs["doc_id"] == gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_key"])
    return docs.join(gone, same, "left_anti")
