"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The test strings are all windows of ``width`` consecutive words of the benchmark's items; an item of fewer words is one
window of its own length. Windows of one length are searched together. A text is a row of word numbers (0: no word of the
benchmark). At a place, the block of the last words says by how much the search may move on: the distance of that block from
the end of any window, or past the block if no window holds it. Where it may not move, the hash of the longest suffix, the whole
window, selects the test strings, so a phrase that ends many of them fills no bucket, and direct comparison confirms.
Texts are cut into lanes that overlap by a window less one word, and all lanes of a batch take a step at once.

Scale: documents are read once and nothing of them is shuffled. The tables of a part of the benchmark of at most ``PART_WORDS``
words are broadcast; a larger benchmark is searched in as many passes as it has parts, and what the passes find is joined by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetra.llm.common import batch, bytes_of, materialize, scratch, sliced

#: Words of the benchmark in one broadcast part, about 50 MB of tables; long items are cut into pieces that overlap.
PART_WORDS, PIECE_WORDS = 1 << 19, 4096
#: Words of a block, and words of a text that one lane covers.
BLOCK, LANE = 3, 256
#: Places whose windows are compared at once.
COMPARED = 1 << 16

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    """Words of UTF-8 text: runs of digits, letters and everything outside ASCII, with A-Z in lower case."""
    return text.translate(_LETTERS).split()


def _hashed(columns: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(columns[0]), dtype=np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
    return h


@dataclass
class Windows:
    """The different windows of one length: block shifts, suffix hashes in order, words and items of each window."""

    size: int
    text: np.ndarray
    start: np.ndarray
    hashes: np.ndarray
    shift: np.ndarray
    item: np.ndarray
    items_from: np.ndarray

    @classmethod
    def of(cls, size: int, text: np.ndarray, start: np.ndarray, item: np.ndarray) -> Windows:
        """From the windows that begin at ``start`` in ``text``, with the item of each."""
        rows = np.ascontiguousarray(text[start[:, None] + np.arange(size)])
        _, first, same = np.unique(rows.view([("", rows.dtype)] * size).ravel(), return_index=True, return_inverse=True)
        own = np.unique(np.stack([same, item], axis=1), axis=0)
        rows, start = rows[first], start[first]
        hashes = _hashed(list(rows.T))
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        own = own[np.argsort(place[own[:, 0]], kind="stable")]
        block = min(BLOCK, size)
        # a slot of the table serves the blocks of equal low hash bits and has the least of their shifts
        bits = max(10, int(np.ceil(np.log2(8 * len(rows) + 1))))
        shift = np.full(1 << bits, size - block + 1, dtype=np.int32)
        for end in range(block, size + 1):
            slot = _hashed(list(rows[:, end - block : end].T)) & np.uint64((1 << bits) - 1)
            np.minimum.at(shift, slot.astype(np.int64), size - end)
        items_from = np.concatenate([[0], np.cumsum(np.bincount(own[:, 0], minlength=len(rows))[order])])
        return cls(size, text, start[order], hashes[order], shift, own[:, 1], items_from)

    def occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the last words of all windows that occur, and the windows' numbers."""
        found = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))]
        ends = self._stops(text)
        for i in range(0, len(ends), COMPARED):
            end = ends[i : i + COMPARED]
            own = text[end[:, None] + np.arange(1 - self.size, 1)]
            h = _hashed(list(own.T))
            lo, hi = (np.searchsorted(self.hashes, h, side) for side in ("left", "right"))
            for turn in range(int((hi - lo).max(initial=0))):
                at = np.flatnonzero(lo + turn < hi)
                there = lo[at] + turn
                equal = (self.text[self.start[there][:, None] + np.arange(self.size)] == own[at]).all(axis=1)
                found.append((end[at[equal]], there[equal]))
        return np.concatenate([e for e, _ in found]), np.concatenate([w for _, w in found])

    def _stops(self, text: np.ndarray) -> np.ndarray:
        """Places where a window may end: those that the shifts do not skip."""
        mask, block = np.uint64(len(self.shift) - 1), min(BLOCK, self.size)
        at = np.arange(self.size - 1, len(text), LANE)
        last = np.minimum(at + LANE, len(text))
        stops = [np.empty(0, dtype=np.int64)]
        while len(at):
            slot = _hashed([text[at + k] for k in range(1 - block, 1)]) & mask
            move = self.shift[slot.astype(np.int64)]
            stops.append(at[move == 0])
            at = at + np.maximum(move, 1)
            on = at < last
            at, last = at[on], last[on]
        return np.sort(np.concatenate(stops))


@dataclass
class Tables:
    """Numbers of the benchmark's words, names of its items, and its windows by length."""

    number: dict[bytes, int] = field(default_factory=dict)
    items: list[str] = field(default_factory=list)
    windows: list[Windows] = field(default_factory=list)

    @classmethod
    def of(cls, pieces: list[tuple[str, bytes]], width: int) -> Tables:
        """From pieces of items, as words joined by spaces."""
        number: dict[bytes, int] = {}
        items: dict[str, int] = {}
        text, starts = [], {}
        for name, piece in pieces:
            own = [number.setdefault(w, len(number) + 1) for w in piece.split()]
            size = min(width, len(own))
            starts.setdefault(size, []).extend((len(text) + i, items.setdefault(name, len(items))) for i in range(len(own) - size + 1))
            text += own
        whole = np.array(text, dtype=np.int32)
        return cls(number, list(items), [Windows.of(size, whole, *np.array(own).T) for size, own in sorted(starts.items())])

    def search(self, texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """For each text its number of words, the spans ``(first, last)`` of words that are hit, and the numbers of the items."""
        found = [words(t) for t in texts]
        sizes = np.array([len(w) for w in found], dtype=np.int64)
        get = self.number.get
        # one place of no word after each text keeps windows within it
        text = np.fromiter((get(w, 0) for own in found for w in (*own, b"")), np.int32, int(sizes.sum()) + len(texts))
        begin = np.cumsum(sizes + 1) - sizes - 1
        change = np.zeros(len(text) + 1, dtype=np.int32)
        pairs = [np.empty((0, 2), dtype=np.int64)]
        for w in self.windows:
            end, which = w.occurrences(text)
            np.add.at(change, end - w.size + 1, 1)
            np.add.at(change, end + 1, -1)
            doc = np.searchsorted(begin, end, side="right") - 1
            own = np.unique(np.stack([doc, which], axis=1), axis=0)
            many = w.items_from[own[:, 1] + 1] - w.items_from[own[:, 1]]
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(w.items_from[own[:, 1]], many)
            pairs.append(np.stack([np.repeat(own[:, 0], many), w.item[at]], axis=1))
        hit = np.concatenate([[False], np.cumsum(change)[:-1] > 0, [False]])
        edge = np.flatnonzero(hit[1:] != hit[:-1])
        first, last = edge[::2], edge[1::2] - 1
        doc = np.searchsorted(begin, first, side="right") - 1
        spans = np.stack([first - begin[doc], last - begin[doc]], axis=1)
        whose = np.unique(np.concatenate(pairs), axis=0)
        cut = np.arange(1, len(texts))
        return sizes, np.split(spans, np.searchsorted(doc, cut)), np.split(whose[:, 1], np.searchsorted(whose[:, 0], cut))


def _pieces(benchmark: DataFrame, width: int) -> DataFrame:
    """``(item, n, piece)``: items as words joined by spaces, long ones in pieces that overlap by a window less a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sliced(batches):
            for name, text in zip(rows.column("item").to_pylist(), bytes_of(rows), strict=True):
                own = words(text)
                size = max(PIECE_WORDS, 2 * width)
                cuts = [own[i : i + size] for i in range(0, max(len(own) - width + 1, 1), size - width + 1)] if own else []
                kinds = (pa.string(), pa.int64(), pa.binary())
                yield batch(item=([name] * len(cuts), kinds[0]), n=([len(c) for c in cuts], kinds[1]), piece=([b" ".join(c) for c in cuts], kinds[2]))

    own = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return own.mapInArrow(run, "item string, n long, piece binary").distinct()


def _parts(benchmark: DataFrame, width: int, part_words: int) -> Iterator[Tables]:
    """Tables of the parts of the benchmark, one after the other; at least one, if an empty one."""
    pieces = materialize(_pieces(benchmark, width), "pieces")
    parts = max(1, -(-(pieces.agg(F.sum("n")).first()[0] or 0) // part_words))
    for k in range(parts):
        rows = pieces.where(F.pmod(F.xxhash64("item", "piece"), F.lit(parts)) == k).select("item", "piece").collect()
        yield Tables.of(sorted((r["item"], bytes(r["piece"])) for r in rows), width)


SPANS = "array<struct<first: long, last: long>>"
_SPAN = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _listed(values: list[np.ndarray], flat: pa.Array) -> pa.ListArray:
    """Lists of the lengths of ``values`` over ``flat``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)), flat)


def _scanned(docs: DataFrame, tables: Tables, every: bool) -> DataFrame:
    """``(doc_id, a, b, n_words, spans, items)`` of the rows of ``docs(doc_id, a, b, text)``, of those that are hit unless ``every``."""
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        names = np.array(known.items, dtype=object)
        for rows in sliced(batches):
            sizes, spans, items = known.search(bytes_of(rows))
            flat = np.concatenate(spans) if spans else np.empty((0, 2), dtype=np.int64)
            pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["first", "last"])
            named = pa.array(names[np.concatenate(items)] if items else [], pa.string())
            out = pa.RecordBatch.from_arrays(
                [*(rows.column(c) for c in ("doc_id", "a", "b")), pa.array(sizes), _listed(spans, pairs), _listed(items, named)],
                names=["doc_id", "a", "b", "n_words", "spans", "items"],
            )
            yield out if every else out.filter(pa.array([len(s) > 0 for s in spans], pa.bool_()))

    return docs.mapInArrow(run, f"doc_id long, a long, b int, n_words long, spans {SPANS}, items array<string>")


def _joined(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Spans of several passes as spans that neither touch nor overlap."""
    out = []
    for spans in rows.column("spans").to_pylist():
        own: list[list[int]] = []
        for s in sorted((s["first"], s["last"]) for s in spans):
            if own and s[0] <= own[-1][1] + 1:
                own[-1][1] = max(own[-1][1], s[1])
            else:
                own.append(list(s))
        out.append([{"first": a, "last": b} for a, b in own])
    return rows.set_column(rows.schema.get_field_index("spans"), "spans", pa.array(out, _SPAN))


def find(docs: DataFrame, benchmark: DataFrame, width: int = 10, part_words: int = PART_WORDS) -> DataFrame:
    """Rows ``(doc_id, n_words, spans, items)``, one for each row of ``docs(doc_id, text)``: all occurrences of the benchmark's windows.

    ``spans`` are the runs of words (counted from 0) inside any occurrence of a window of ``width`` words of
    ``benchmark(item_id, text)``, ``items`` the ids, as texts, of the items with a window that occurs. A null text has no words, a
    null item id is the empty id, items of equal id are one item, those without words have no window. Repeated rows are returned
    as they come. An empty benchmark hits nothing, an empty table gives no rows; other columns are not read.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("a"), F.hash("text", "doc_id").alias("b"), "text")
    with scratch(docs.sparkSession) as keep:
        parts = _parts(benchmark, width, part_words)
        out = _scanned(own, next(parts), every=True)
        more = [materialize(_scanned(own, tables, every=False), "hits") for tables in parts]
        if more:
            found = more[0]
            for m in more[1:]:
                found = found.unionByName(m)
            # equal rows have equal hits, and are told apart from others by two hashes
            found = found.groupBy("a", "b").agg(F.flatten(F.collect_set("spans")).alias("more"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("others"))
            found = keep(materialize(found, "more"))
            none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
            out = out.join(found, ["a", "b"], "left").select(
                "doc_id", "a", "b", "n_words", F.concat("spans", none(F.col("more"), SPANS)).alias("spans"),
                F.array_union("items", none(F.col("others"), "array<string>")).alias("items"),
            )
            out = out.mapInArrow(lambda batches: map(_joined, sliced(batches)), out.schema)
    return out.drop("a", "b")


def n_hit(spans: Column) -> Column:
    """Words inside the spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)


def report(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """Rows ``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` from ``find``."""
    found = find(docs, benchmark, width)
    return found.select(
        "doc_id", "n_words", n_hit(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, part_words: int = PART_WORDS) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window of the benchmark occurs."""

    def clean(shared):  # noqa: ANN001, ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in sliced(batches):
                _, spans, _ = shared.value.search(bytes_of(rows))
                yield rows.filter(pa.array([not len(s) for s in spans], pa.bool_()))

        return run

    with scratch(docs.sparkSession):
        for tables in _parts(benchmark, width, part_words):
            docs = docs.mapInArrow(clean(docs.sparkSession.sparkContext.broadcast(tables)), docs.schema)
    return docs


#: The same rows in DuckDB: windows of documents and of items as lists, joined.
SQL = r"""
WITH b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), p AS (
  SELECT DISTINCT item, array_to_string(list_slice(w, i, i + 9), ' ') AS win, least(len(w), 10) AS size
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), t AS (
  SELECT r, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM p) WHERE len(w) >= size)
), h AS (
  SELECT t.r, t.i, t.size, p.item FROM t JOIN p ON t.win = p.win AND t.size = p.size
), n AS (
  SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + size)) AS place FROM h) GROUP BY r
), s AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM h) GROUP BY r
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(s.n_items, 0) AS n_items,
       coalesce(s.items_sha256, sha256('')) AS items_sha256, n.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN s USING (r)
"""
