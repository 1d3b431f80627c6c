"""Near copies by word shingles: SimHash links and MinHash candidates, verified by the exact similarity of the shingle sets.

Equal texts collapse first. Then the deletion-variant signatures of ``simhash`` link texts whose SimHash over five-word
shingles differs in at most ``MAX_BITS`` bits, and the similarity of the shingles decides. Such links find the closest copies, a large
group of them at once, but texts of similarity 0.8 differ in eight bits of 64 or more, so among the texts that are left MinHash
finds the rest: a signature is the minima of ``BANDS * ROWS`` hashes over the shingles, and texts that agree in a band of it
meet in a bucket. Two texts of similarity 0.8 meet with probability 1 - (1 - 0.8 ** 5) ** 20 = 0.9996. What meets is compared
by the shingle sets themselves (hashes of 32 bits, and of 64 where that leaves a doubt).

Texts that found pairs connect form a group, of which one stays. Only pairs of different groups are looked at, since others connect nothing
new, but no text is set aside: a copy of one text may be what connects it to a third.

Scale: buckets are counted before they are gathered, and those of one group go no further. A small one gives all its pairs. In a larger one all texts are
compared with one of them. The texts of those that still hold very many pairs of different groups go on to bands of more rows, whose
buckets hold fewer texts of lesser similarity; these only connect early what is very common. At last all texts of the first bands' buckets that still hold several groups
(texts of one template, say, that are nearly similar enough) are cut into sets, first by the buckets, then by sketches of a hundred bytes; blocks of a set
are compared two at a time by the exact similarity and only what is similar is written, so no pair is written before it is checked and no set is gathered. Other pairs, too, are looked at in
the sketch before the shingles of their texts are fetched. A text compared with very many is sent in parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetra.llm import simhash
from kinetra.llm.common import batch, bytes_of, dropped, lower_words, map_batches, materialize, scratch, sliced
from kinetra.llm.graph import connected

#: Differing bits of SimHash links.
MAX_BITS = 3
BANDS, ROWS = 20, 5
#: Rows and bands for the texts of buckets that hold more open pairs than a block. They share minima, so two texts that met may not meet again; what is then still open is compared in blocks.
FINER = ((7, 32), (9, 48), (11, 72), (13, 96))
SMALL_BUCKET = 4
#: Similarity by the sketch (a byte of each minimum) under which a pair is not compared further: five deviations under 0.8.
LEAST_SKETCH = 0.6
#: Pairs are compared by the low halves of the hashes, those nearer than this to the similarity that is asked again by the whole ones.
DOUBT = 0.01
#: Cells of text keys that are broadcast in place of the keys.
CELLS = 1 << 20
#: Texts or shingles of a block of what no bucket settles, texts of one that is compared by sketches, and shingles whose incidence is held at once.
BLOCK_TEXTS, BLOCK_GRAMS, BLOCK_SKETCHES, INCIDENCE = 256, 1 << 19, 1024, 4096
#: Pairs of one text in a part.
PART_PAIRS = 64
#: Hashes that are computed at once; bounds memory for very long texts.
BLOCK = 1 << 20
NO_ID = (1 << 63) - 1

_RANDOM = np.random.default_rng(42)
_FACTORS = _RANDOM.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted hashes of the different word shingles; a text of fewer words is one shingle, one without words has none."""
    words = lower_words(text)
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 43)], dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(w, 42) for w in words), np.uint64, len(words))
    n = len(words) - width + 1
    out = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        out = (out ^ h[i : i + n]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of sorted hashes; 1 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def signature(grams: np.ndarray) -> np.ndarray:
    """Minima of the hashes over the shingles."""
    low = np.full(len(_FACTORS), 0xFFFFFFFF, dtype=np.uint32)
    h = (grams >> np.uint64(32)).astype(np.uint32)
    step = BLOCK // len(_FACTORS)
    for i in range(0, len(h), step):
        low = np.minimum(low, (_FACTORS[:, None] * h[None, i : i + step] + _SHIFTS[:, None]).min(axis=1))
    return low


def fingerprint(grams: np.ndarray) -> int:
    """Signed 64-bit SimHash of the shingles; 0 if there are none."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(grams), BLOCK // 64):
        h = grams[i : i + BLOCK // 64]
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(len(h), 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(grams)).view(">i8")[0])


def _keys(rows: pa.RecordBatch, cuts: np.ndarray, seed: int) -> pa.RecordBatch:
    """A bucket key for each text and each row of ``cuts``, which are places of the signature."""
    sigs = np.frombuffer(b"".join(rows.column("sig").to_pylist()), dtype=np.uint32).reshape(rows.num_rows, BANDS * ROWS)
    value = np.full((rows.num_rows, len(cuts)), seed, dtype=np.uint64)
    for k in range(cuts.shape[1]):
        value = (value ^ sigs[:, cuts[:, k]]) * _MIX
        value ^= value >> np.uint64(29)
    own = {c: np.repeat(rows.column(c).to_numpy(), len(cuts)) for c in ("text_key", "first_id", "near")}
    slot = np.tile(np.arange(len(cuts), dtype=np.int16), rows.num_rows)
    return pa.RecordBatch.from_pydict(own | {"slot": slot, "value": value.ravel().view(np.int64)})


KEYS = "text_key long, first_id long, near long, slot short, value long"


def _all_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of each bucket whose groups differ, a member with all later ones at a time."""
    for rows in sliced(batches):
        for members in rows.column("members").to_pylist():
            members.sort(key=lambda m: (m["first_id"], m["text_key"]))
            keys, near = (np.array([m[c] for m in members], dtype=np.int64) for c in ("text_key", "near"))
            for i in range(0, len(keys) - 1, 64):
                others = [np.flatnonzero(near[k + 1 :] != near[k]) + k + 1 for k in range(i, min(i + 64, len(keys) - 1))]
                a = np.repeat(keys[i : i + len(others)], [len(x) for x in others])
                yield batch(a=(a, pa.int64()), b=(keys[np.concatenate(others)], pa.int64()))


def _grouped(texts: DataFrame, found: DataFrame) -> DataFrame:
    """``texts`` with the group ``near`` that the pairs ``found(a, b)`` put each into; one of its own where there are none."""
    labels = connected(found).withColumnRenamed("node", "text_key")
    return texts.join(labels, "text_key", "left").withColumn("near", F.coalesce("root", "text_key")).drop("root")


def _verified(pairs: DataFrame, docs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs ``(a, b)`` of text keys whose texts are similar enough."""
    sketch = texts.select("text_key", "sketch")
    pairs = pairs.distinct().join(sketch.toDF("a", "sketch_a"), "a").join(sketch.toDF("b", "sketch_b"), "b")
    pairs = materialize(map_batches(pairs, _alike, "a long, b long"), "pairs")
    close = _compared(pairs, docs, texts, width, least - DOUBT, "uint32")
    sure, doubt = close.where(F.col("j") >= least + DOUBT).select("a", "b"), close.where(F.col("j") < least + DOUBT).select("a", "b")
    if not doubt.isEmpty():
        sure = sure.unionByName(_compared(doubt, docs, texts, width, least, "uint64").select("a", "b"))
    out = materialize(sure, "near")
    dropped(pairs)
    dropped(close)
    return out


def _compared(pairs: DataFrame, docs: DataFrame, texts: DataFrame, width: int, least: float, kind: str) -> DataFrame:
    """``(a, b, j)``: the pairs with a similarity ``j`` of ``least`` or more, by hashes of the ``kind`` (32 bits for half the bytes)."""
    needed = pairs.select(F.col("a").alias("text_key")).unionByName(pairs.select(F.col("b").alias("text_key"))).distinct()
    grams = _shingled(docs, needed.join(texts, "text_key").select("text_key", F.col("first_id").alias("at_id")), width, kind)
    often = pairs.groupBy("a").count().where(F.col("count") > PART_PAIRS)
    often = materialize(often.select("a", F.ceil(F.col("count") / PART_PAIRS).cast("int").alias("parts")), "often")
    parts = F.coalesce("parts", F.lit(1))
    left = pairs.join(often, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))
    first = grams.select(F.col("text_key").alias("a"), F.col("grams").alias("grams_a")).join(often, "a", "left")
    first = first.select("a", "grams_a", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    second = grams.select(F.col("text_key").alias("b"), F.col("grams").alias("grams_b"))

    def near(rows: pa.RecordBatch) -> pa.RecordBatch:
        x, y = ([np.frombuffer(g, dtype=kind) for g in rows.column(c).to_pylist()] for c in ("grams_a", "grams_b"))
        j = np.array([similarity(s, t) for s, t in zip(x, y, strict=True)], dtype=float)
        out = pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b"), pa.array(j)], names=["a", "b", "j"])
        return out.filter(pa.array(j >= least))

    out = map_batches(left.join(second, "b").join(first, ["a", "part"]).select("a", "b", "grams_a", "grams_b"), near, "a long, b long, j double")
    out = materialize(out, "compared")
    dropped(grams)
    return out


def _shingled(docs: DataFrame, needed: DataFrame, width: int, kind: str) -> DataFrame:
    """``(text_key, grams)``: the shingle hashes of the texts ``needed(text_key, at_id)``, as a table."""
    needed = materialize(needed, "needed")

    def sets(rows: pa.RecordBatch) -> pa.RecordBatch:
        grams = [np.unique(shingles(t, width).astype(kind)).tobytes() for t in bytes_of(rows)]
        return pa.RecordBatch.from_arrays([rows.column("text_key"), pa.array(grams, pa.binary())], names=["text_key", "grams"])

    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("at_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("text_key", F.xxhash64("text"))
    # texts are not moved to be looked up: cells of the keys, of which there are CELLS at most, tell which ones may be needed
    cell = lambda df: F.pmod(df["text_key"], F.lit(CELLS))
    may = F.broadcast(needed.select(cell(needed).alias("cell")).distinct())
    own = own.join(may, cell(own) == may["cell"], "left_semi").join(needed, ["text_key", "at_id"], "left_semi")
    grams = map_batches(own.select("text_key", "text"), sets, "text_key long, grams binary")
    grams = materialize(grams.groupBy("text_key").agg(F.first("grams").alias("grams")), "grams")
    dropped(needed)
    return grams


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows(root, near, text_key, weight, ...)`` for each two blocks ``i`` and ``j`` of their set ``root`` that may hold pairs; ``own`` is the row's block.

    A block has a weight of about 1. A group ``near`` is not cut unless it is large; then it has blocks of its own, which need not meet.
    """
    groups = materialize(rows.groupBy("root", "near").agg(F.sum("weight").alias("weight")), "groups")
    large = groups.where("weight > 0.5").select("root", "near", F.col("near").alias("owner"), F.ceil("weight").cast("int").alias("blocks"))
    small = groups.where("weight <= 0.5")
    small = small.join(small.groupBy("root").agg(F.ceil(F.sum("weight")).cast("int").alias("blocks")), "root")
    groups = large.unionByName(small.select("root", "near", F.lit(None).cast("long").alias("owner"), "blocks"))
    block = F.pmod(F.when(F.col("owner").isNull(), F.xxhash64("near")).otherwise(F.xxhash64("text_key")), F.col("blocks")).cast("int")
    placed = materialize(rows.join(groups, ["root", "near"]).withColumn("block", block).drop("blocks", "weight"), "placed")
    blocks = placed.select("root", "owner", "block").distinct()
    blocks = materialize(blocks.withColumn("own", F.row_number().over(Window.partitionBy("root").orderBy("owner", "block"))), "blocks")
    left, right = (blocks.select("root", F.col("owner").alias(f"owner_{k}"), F.col("own").alias(k)) for k in ("i", "j"))
    met = left.join(right, "root").where("i <= j and not coalesce(owner_i = owner_j, false)")
    met = met.select("root", F.explode(F.array_distinct(F.array("i", "j"))).alias("own"), "i", "j")
    same = (placed["root"] == blocks["root"]) & placed["owner"].eqNullSafe(blocks["owner"]) & (placed["block"] == blocks["block"])
    return placed.join(blocks, same).drop(blocks["root"], blocks["owner"], blocks["block"]).join(met, ["root", "own"]).drop("owner", "block")


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of two blocks, twice the same if they are one."""
    i, own = table.column("i")[0].as_py(), table.column("own").to_numpy()
    every = np.arange(len(own))
    return (every, every) if table.column("j")[0].as_py() == i else (np.flatnonzero(own == i), np.flatnonzero(own != i))


def _sketch_links(rest: DataFrame, links: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that connect what all pairs of different groups would that ``links`` connect and whose sketches agree, of ``rest(text_key, near, sketch)``."""
    roots = connected(links).withColumnRenamed("node", "text_key")
    dealt = _dealt(rest.join(roots, "text_key").withColumn("weight", F.lit(1 / BLOCK_SKETCHES)))

    def run(table: pa.Table) -> pa.Table:
        keys, group = (table.column(c).to_numpy() for c in ("text_key", "near"))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint8).reshape(len(keys), -1)
        left, right = _sides(table)
        near = np.zeros((len(keys), len(keys)), dtype=bool)
        for k in range(0, len(left), 32):
            x = left[k : k + 32]
            near[x[:, None], right] = ((sketch[x][:, None] == sketch[right]).mean(axis=2) >= LEAST_SKETCH) & (group[x][:, None] != group[right])
        near |= near.T
        open_ = np.ones(len(keys), dtype=bool)
        a, b = [], []
        for first in range(len(keys)):
            front = np.array([first]) if open_[first] else np.empty(0, dtype=np.int64)
            open_[first] = False
            while len(front):
                front = np.flatnonzero(near[front].any(axis=0) & open_)
                open_[front] = False
                a.append(np.full(len(front), keys[first]))
                b.append(keys[front])
        a, b = (np.concatenate([*x, np.empty(0, dtype=np.int64)]) for x in (a, b))
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return materialize(dealt.groupBy("root", "i", "j").applyInArrow(run, "a long, b long"), "sketched")


def _block_pairs(docs: DataFrame, rest: DataFrame, links: DataFrame, width: int, least: float) -> DataFrame:
    """Similar pairs ``(a, b)`` among the texts of ``rest(text_key, first_id)`` that ``links(a, b)`` connect, ``a`` the one of smaller id.

    Of texts that have a group ``near``, those of one group are no pair. Blocks hold about ``BLOCK_TEXTS`` texts or ``BLOCK_GRAMS`` shingles.
    """
    if "near" not in rest.columns:
        rest = rest.withColumn("near", F.col("text_key"))
    roots = connected(links).withColumnRenamed("node", "text_key")
    rest = materialize(rest.join(roots, "text_key").select("text_key", "first_id", "near", "root"), "sets")
    grams = _shingled(docs, rest.select("text_key", F.col("first_id").alias("at_id")), width, "uint64")
    rows = grams.join(rest, "text_key").withColumn("weight", F.greatest(F.lit(1 / BLOCK_TEXTS), F.length("grams") / (8 * BLOCK_GRAMS)))
    rows = materialize(rows, "grouped")
    dealt = _dealt(rows)

    def near(table: pa.Table) -> pa.Table:
        keys, ids, group = (table.column(c).to_numpy() for c in ("text_key", "first_id", "near"))
        sets = [np.frombuffer(g, dtype=np.uint64) for g in table.column("grams").to_pylist()]
        left, right = _sides(table)
        shared = _overlaps([sets[k] for k in left], [sets[k] for k in right])
        sizes = np.array([len(x) for x in sets])
        union = sizes[left][:, None] + sizes[right][None, :] - shared
        x, y = np.nonzero(shared >= least * union - 1e-9)
        x, y = left[x], right[y]
        before = (ids[x] < ids[y]) | ((ids[x] == ids[y]) & (keys[x] < keys[y]))
        keep = (group[x] != group[y]) & (before | (left is not right))
        x, y, before = x[keep], y[keep], before[keep]
        return pa.table({"a": pa.array(np.where(before, keys[x], keys[y])), "b": pa.array(np.where(before, keys[y], keys[x]))})

    out = materialize(dealt.groupBy("root", "i", "j").applyInArrow(near, "a long, b long"), "near")
    dropped(grams)
    dropped(rows)
    return out


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sets ``a`` and ``b``, by products of incidence matrices, some thousand shingles at a time."""
    out = np.zeros((len(a), len(b)))
    every = np.unique(np.concatenate([*a, *b, np.empty(0, dtype=np.uint64)]))
    for k in range(0, len(every), INCIDENCE):
        part = every[k : k + INCIDENCE]
        matrices = []
        for sets in (a, b):
            m = np.zeros((len(sets), len(part)), dtype=np.float32)
            for row, x in zip(m, sets, strict=True):
                own = x[np.searchsorted(x, part[0]) : np.searchsorted(x, part[-1], "right")]
                row[np.searchsorted(part, own)] = 1
            matrices.append(m)
        out += matrices[0] @ matrices[1].T
    return out


def _alike(rows: pa.RecordBatch) -> pa.RecordBatch:
    """The pairs whose sketches agree in ``LEAST_SKETCH`` of their bytes."""
    x, y = (np.frombuffer(b"".join(rows.column(c).to_pylist()), dtype=np.uint8).reshape(rows.num_rows, -1) for c in ("sketch_a", "sketch_b"))
    keep = (x == y).mean(axis=1) >= LEAST_SKETCH if rows.num_rows else np.zeros(0, dtype=bool)
    return rows.select(["a", "b"]).filter(pa.array(keep))


def _simhash_edges(docs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """Verified pairs ``(a, b)`` of text keys, by SimHash: each text with the first of its component.

    These are a start. A component's other pairs are left to the bands, where texts meet whose groups differ.
    """
    order = F.struct("first_id", "text_key")
    by = materialize(texts.groupBy("fp").agg(F.min(order).alias("first")), "distinct")
    labels = connected(simhash.links(by.select("fp"), MAX_BITS)).withColumnRenamed("node", "fp")
    rooted = materialize(by.join(labels, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    heads = rooted.groupBy("root").agg(F.min("first").alias("head"))
    heads = materialize(rooted.select("fp", "root").join(heads, "root").select("fp", F.col("head.text_key").alias("a")), "heads")
    pairs = texts.select("fp", F.col("text_key").alias("b")).join(heads, "fp").where("a <> b").select("a", "b")
    return _verified(pairs, docs, texts, width, least)


def _buckets(rest: DataFrame, cuts: np.ndarray, turn: int) -> DataFrame:
    """The keys of the texts ``rest`` in buckets of more than one group, with the number ``n`` of a bucket's texts."""
    keys = map_batches(rest, lambda rows: _keys(rows, cuts, turn), KEYS)
    mixed = keys.groupBy("slot", "value").agg(F.count("*").alias("n"), F.min("near").alias("low"), F.max("near").alias("high"))
    mixed = materialize(mixed.where("low <> high").select("slot", "value", "n"), "mixed")
    # keys of other buckets are not moved: cells of which there are CELLS at most tell most of them
    cell = lambda df: F.pmod(df["value"], F.lit(CELLS))
    may = F.broadcast(mixed.select(cell(mixed).alias("cell")).distinct())
    inside = materialize(keys.join(may, cell(keys) == may["cell"], "left_semi").join(mixed, ["slot", "value"]), "buckets")
    dropped(mixed)
    return inside


def _open(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """The texts of ``buckets(slot, value, hub, text_key)`` that still hold several groups, with their group by the pairs ``found`` and the bucket's ``pairs`` of different groups."""
    grouped = materialize(_grouped(buckets, found), "regrouped")
    sizes = grouped.groupBy("slot", "value", "near").count().groupBy("slot", "value").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("own"))
    several = sizes.select("slot", "value", ((F.col("n") * F.col("n") - F.col("own")) / 2).alias("pairs")).where("pairs > 0")
    left = materialize(grouped.join(several, ["slot", "value"]).select("text_key", "near", "hub", "pairs"), "open")
    dropped(grouped)
    return left


def _edges(docs: DataFrame, texts: DataFrame, width: int, least: float, small_bucket: int) -> DataFrame:
    """Verified pairs ``(a, b)`` of text keys, which connect what all similar pairs would that meet in the first bands."""
    found = _simhash_edges(docs, texts, width, least)
    rest = materialize(_grouped(texts.select("text_key", "first_id", "sig"), found), "left")
    cuts = np.arange(BANDS * ROWS).reshape(BANDS, ROWS)
    first = None
    for turn in range(len(FINER) + 1):
        inside = _buckets(rest, cuts, turn)
        small = F.col("n") <= small_bucket
        members = inside.where(small).groupBy("slot", "value").agg(F.collect_list(F.struct("first_id", "text_key", "near")).alias("members"))
        hot = inside.where(~small)
        # the groups take turns to have the text that the others are compared with
        hubs = hot.groupBy("slot", "value").agg(F.min(F.struct(F.xxhash64("near", F.lit(turn)).alias("h"), "first_id", "text_key", "near")).alias("hub"))
        hot = materialize(hot.join(hubs, ["slot", "value"]).withColumns({"near_a": F.col("hub.near"), "hub": F.col("hub.text_key")}), "hot")
        pairs = hot.where("near_a <> near").select(F.col("hub").alias("a"), F.col("text_key").alias("b"))
        pairs = members.select("members").mapInArrow(_all_pairs, "a long, b long").unionByName(pairs)
        found = found.unionByName(_verified(pairs, docs, texts, width, least))
        dropped(inside)
        hot = hot.select("slot", "value", "hub", "text_key")
        first = hot if first is None else first
        if hot.isEmpty():
            break
        left = _open(hot, found)
        large = left.where(F.col("pairs") > BLOCK_TEXTS**2)
        if turn == len(FINER) or large.isEmpty():
            break
        rest = materialize(texts.select("text_key", "first_id", "sig").join(large.select("text_key", "near").distinct(), "text_key"), "left")
        rows, bands = FINER[turn]
        cuts = np.random.default_rng(turn).permuted(np.tile(np.arange(BANDS * ROWS), (bands, 1)), axis=1)[:, :rows]
    if first.isEmpty():
        return found
    left = left if turn == 0 else _open(first, found)
    if left.isEmpty():
        return found
    rest = materialize(texts.select("text_key", "first_id", "sketch").join(left.select("text_key", "near").distinct(), "text_key"), "left")
    links = _sketch_links(rest.drop("first_id"), left.select(F.col("hub").alias("a"), F.col("text_key").alias("b")).distinct())
    return found if links.isEmpty() else found.unionByName(_block_pairs(docs, rest.drop("sketch"), links, width, least))


def keep_one(docs: DataFrame, width: int = 5, least: float = 0.8, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """``docs`` without near copies: of texts linked by a shingle similarity of ``least`` the rows of the smallest doc_id stay.

    Rows that repeat this doc_id are the same document and stay with it. Rows without an id can't be told apart
    and stay. Texts without words count as equal. All columns are kept, whatever their names.
    """

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        grams = [shingles(t, width) for t in bytes_of(rows)]
        sigs, prints = [signature(g) for g in grams], pa.array([fingerprint(g) for g in grams], pa.int64())
        whole, sketch = pa.array([x.tobytes() for x in sigs], pa.binary()), pa.array([x.astype(np.uint8).tobytes() for x in sigs], pa.binary())
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text_key"), whole, prints, sketch], names=["doc_id", "text_key", "sig", "fp", "sketch"])

    text = F.coalesce(docs["text"], F.lit(""))
    with scratch(docs.sparkSession) as keep:
        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
        own = materialize(map_batches(own, run, "doc_id long, text_key long, sig binary, fp long, sketch binary"), "signatures")
        texts = own.groupBy("text_key").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("first_id"), *[F.first(c).alias(c) for c in ("sig", "fp", "sketch")])
        texts = materialize(texts, "texts")
        ids = materialize(own.select("doc_id", "text_key"), "ids")
        dropped(own)
        labels = connected(_edges(docs, texts, width, least, small_bucket))
        rooted = texts.join(labels.withColumnRenamed("node", "text_key"), "text_key", "left").select(
            "text_key", "first_id", F.coalesce("root", "text_key").alias("root")
        )
        first = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
        classes = materialize(rooted.join(first, "root").select("text_key", "component_id"), "classes")
        gone = ids.join(classes, "text_key").where("doc_id <> component_id")
        gone = keep(materialize(gone.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct(), "gone"))
    # texts are not moved to be looked up: all but those in a cell of what goes stay where they are
    cells = F.broadcast(gone.select(F.pmod("gone_key", F.lit(CELLS)).alias("cell")).distinct())
    inside = F.pmod(F.xxhash64(text), F.lit(CELLS)) == cells["cell"]
    same = (docs["doc_id"] == gone["gone_id"]) & (F.xxhash64(text) == gone["gone_key"])
    return docs.join(cells, inside, "left_anti").union(docs.join(cells, inside, "left_semi").join(gone, same, "left_anti"))
