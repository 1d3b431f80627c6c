"""Source divergence audit: how far the terms of a language's sources lie apart, and which terms set a source off.

Every (lang, source) group gives each kept term of its language a smoothed share in billionths, so a term's value depends on two
counts only. For a group's leading terms, terms are grouped into cells by (group count, lang count); the value is
evaluated for each cell, cells of equal value are merged and ranked by their cumulative multiplicity, and only the
cells that reach into the leading ranks are expanded to terms, in UTF-8 order. For pairs of groups, values of terms that both
have are summed by cells of their two shares in the tasks; terms that one or neither has are cells of counts, with no term looked up.

Scale: tasks sum a term's occurrences and documents by group before one exchange by (lang, term), which serves both the sums
by source and those of the language. A row for each group of a term is all that is gathered by a term. All else works on groups,
cells and pairs of groups. Shares are exact: products that pass a long are decimals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetra.llm.common import bytes_of, materialize, scratch, sliced

#: Documents of its language that a kept term is in, at least; ranks of terms that are reported; the shares' unit.
MIN_DOCS, TOP, UNIT = 10, 10, 1_000_000_000
#: Different terms and sums that a task holds before it sends them on.
HELD_TERMS, HELD_SUMS = 400_000, 3_000_000
#: Pairs of groups, over terms, that are compared at once.
PAIRS_AT_ONCE = 1 << 19

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Terms of UTF-8 text: runs of letters and everything outside ASCII, with A-Z in lower case."""
    return text.translate(_LETTERS).split()


class _Sums:
    """Occurrences and documents by group and term, of the rows a task has seen."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.number: dict[bytes, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, langs: list[str], sources: list[str], texts: list[bytes]) -> None:
        found = [terms(t) for t in texts]
        sizes = np.array([len(f) for f in found], dtype=np.int64)
        number = self.number
        own = np.fromiter((number.setdefault(t, len(number)) for f in found for t in f), np.int64, int(sizes.sum()))
        group = np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(langs, sources, strict=True)], dtype=np.int64)
        code, n = np.unique((np.repeat(np.arange(len(found)), sizes) << 32) | own, return_counts=True)
        self._put((group[code >> 32] << 32) | (code & 0xFFFFFFFF), n, np.ones(len(code), dtype=np.int64))

    def _put(self, code: np.ndarray, n: np.ndarray, docs: np.ndarray) -> None:
        order = np.argsort(code, kind="stable")
        code, n, docs = code[order], n[order], docs[order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.empty(0, dtype=np.int64)
        if len(first):
            self.parts.append((code[first], np.add.reduceat(n, first), np.add.reduceat(docs, first)))

    def full(self) -> bool:
        if sum(len(c) for c, _, _ in self.parts) > HELD_SUMS:
            parts, self.parts = self.parts, []
            self._put(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            return len(self.parts[0][0]) > HELD_SUMS // 2
        return len(self.number) > HELD_TERMS

    def rows(self) -> Iterator[pa.RecordBatch]:
        parts, self.parts = self.parts, []
        if not parts:
            return
        self._put(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        code, n, docs = self.parts[0]
        names = pa.array(list(self.number), pa.binary()).cast(pa.string())
        langs, sources = (pa.array([g[k] for g in self.groups], pa.string()) for k in (0, 1))
        for i in range(0, len(code), 1 << 16):
            at = slice(i, i + (1 << 16))
            g, t = pa.array(code[at] >> 32), pa.array(code[at] & 0xFFFFFFFF)
            yield pa.RecordBatch.from_arrays(
                [langs.take(g), sources.take(g), names.take(t), pa.array(n[at]), pa.array(docs[at])], names=["lang", "source", "term", "n", "docs"]
            )


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = _Sums()
    for rows in sliced(batches):
        own.add(rows.column("lang").to_pylist(), rows.column("source").to_pylist(), bytes_of(rows))
        if own.full():
            yield from own.rows()
            own = _Sums()
    yield from own.rows()


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(lang, term, source, n, lang_n)``: occurrences of each kept term by group that has it, and in the whole language.

    A term is kept where at least ``min_docs`` rows of ``docs(text, lang, source)`` of the language have it; null counts as ''.
    """
    found = _named(docs).mapInArrow(_summed, "lang string, source string, term string, n long, docs long")
    # one exchange by language and term: the sums by source and those of the language both follow it
    by = found.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    by = by.withColumn("lang_n", F.sum("n").over(whole)).withColumn("lang_docs", F.sum("docs").over(whole))
    return by.where(F.col("lang_docs") >= min_docs).select("lang", "term", "source", "n", "lang_n")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * kept)), exactly; 1 where nothing is kept."""
    wide = lambda c: c.cast("decimal(20,0)")
    below = F.when(kept > 0, wide(total) + 2 * wide(kept))
    above = F.lit(UNIT).cast("decimal(11,0)") * (wide(count) + 2)
    # a quotient of integers below 2 ** 31 in decimals of six places or more never rounds up to the next integer: the remainder says so
    return F.coalesce(((above - above % below) / below).cast("long"), F.lit(0)) + 1


def _value(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / (p + q)) of two columns of shares."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """``(lang, source, total, lang_total, n_kept, n_terms)`` of every occurring group: occurrences of kept terms in the group and
    in its language, kept terms of the language, and kept terms that the group has."""
    groups = _named(docs).select("lang", "source").distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("n_terms"))
    # a term has one row for each of its sources, the first of which stands for it
    langs = kept.groupBy("lang", "term", "lang_n").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("n_kept"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *map(zero, ("total", "lang_total", "n_kept", "n_terms")))


def _shared_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, a, b, both, excess)`` for pairs of groups that share terms: how many, and the summed value of these less what
    ``pairs`` counts for them as terms that only one of the two has. Rows hold a term's groups in order, with shares."""
    for b in batches:
        size = b.column("source").value_lengths().to_numpy(zero_copy_only=False)
        first = np.cumsum(size) - size
        flat = {c: b.column(c).flatten() for c in ("source", "p", "p0")}
        names = flat["source"].dictionary_encode()
        source = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        langs = b.column("lang").dictionary_encode()
        lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        p, p0 = (flat[c].to_numpy(zero_copy_only=False) for c in ("p", "p0"))
        for k in np.unique(size[size > 1]):
            rows, (i, j) = np.flatnonzero(size == k), np.triu_indices(k, 1)
            step = max(1, PAIRS_AT_ONCE // len(i))
            for s in range(0, len(rows), step):
                for c in range(0, len(i), PAIRS_AT_ONCE):
                    own = rows[s : s + step, None]
                    x, y = first[own] + i[None, c : c + PAIRS_AT_ONCE], first[own] + j[None, c : c + PAIRS_AT_ONCE]
                    key = ((lang[own] * len(names.dictionary) + source[x]) * len(names.dictionary) + source[y]).ravel()
                    pair, at, both = np.unique(key, return_inverse=True, return_counts=True)
                    excess = np.zeros(len(pair), dtype=np.int64)
                    np.add.at(excess, at, (_f(p[x], p[y]) - _f(p[x], p0[y]) - _f(p0[x], p[y])).ravel())
                    n = len(names.dictionary)
                    yield pa.RecordBatch.from_arrays(
                        [langs.dictionary.take(pa.array(pair // (n * n))), names.dictionary.take(pa.array(pair // n % n)), names.dictionary.take(pa.array(pair % n)), pa.array(both), pa.array(excess)],
                        names=["lang", "a", "b", "both", "excess"],
                    )


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def pairs(kept: DataFrame, sums: DataFrame) -> DataFrame:
    """``(lang, source, item, value)``: the summed value of every group and each other source of its language."""
    zero = share(F.lit(0), F.col("total"), F.col("n_kept"))
    groups = sums.select("lang", "source", "n_kept", "n_terms", zero.alias("p0"))
    shares = kept.join(sums, ["lang", "source"]).select(
        "lang", "term", "source", "n", share(F.col("n"), F.col("total"), F.col("n_kept")).alias("p"), zero.alias("p0")
    )
    listed = shares.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "p0"))).alias("r"))
    listed = listed.select("lang", *[F.col(f"r.{c}").alias(c) for c in ("source", "p", "p0")])
    both = listed.mapInArrow(_shared_values, "lang string, a string, b string, both long, excess long")
    both = both.groupBy("lang", "a", "b").agg(F.sum("both").alias("both"), F.sum("excess").alias("excess"))
    both = both.unionByName(both.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "both", "excess"))
    # terms that a group has, as cells of one count against none in each other group
    counts = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("n_terms").alias("item_terms"))
    alone = counts.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("m") * _value(F.col("p"), F.col("q0"))).alias("alone"))
    every = groups.join(other, "lang").where("source <> item")
    every = every.join(alone, ["lang", "source", "item"], "left").join(
        alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("alone").alias("against")), ["lang", "source", "item"], "left"
    )
    every = every.join(both.withColumnsRenamed({"a": "source", "b": "item"}), ["lang", "source", "item"], "left")
    c = lambda name: F.coalesce(F.col(name), F.lit(0))
    neither = F.col("n_kept") - F.col("n_terms") - F.col("item_terms") + c("both")
    value = c("alone") + c("against") + c("excess") + neither * _value(F.col("p0"), F.col("q0"))
    return every.select("lang", "source", "item", value.alias("value"))


def leading_terms(kept: DataFrame, sums: DataFrame, top: int = TOP) -> DataFrame:
    """``(lang, source, item, value, rank)``: the ``top`` terms of each group whose share there is above the language's."""
    cells = kept.groupBy("lang", "source", "n", "lang_n").agg(F.count("*").alias("m")).join(sums, ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("n_kept")), share(F.col("lang_n"), F.col("lang_total"), F.col("n_kept"))
    cells = cells.select("lang", "source", "n", "lang_n", "m", p.alias("p"), q.alias("q")).where("p > q")
    cells = cells.select("lang", "source", "n", "lang_n", "m", _value(F.col("p"), F.col("q")).alias("value"))
    # each value has a term at least, so the ranks end within the first values, and there within the cumulative multiplicity
    group = Window.partitionBy("lang", "source")
    values = cells.groupBy("lang", "source", "value").agg(F.sum("m").alias("m"))
    values = values.withColumn("r", F.row_number().over(group.orderBy(F.desc("value")))).where(F.col("r") <= top)
    before = F.sum("m").over(group.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1))
    values = values.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < top).select("lang", "source", "value")
    chosen = cells.join(values, ["lang", "source", "value"]).select("lang", "source", "n", "lang_n", "value")
    found = kept.join(chosen, ["lang", "source", "n", "lang_n"]).select("lang", "source", F.col("term").alias("item"), "value")
    rank = F.row_number().over(group.orderBy(F.desc("value"), "item"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """Rows ``(lang, source, part, item, value, rank)`` for every (lang, source) of ``docs(text, lang, source)``.

    Part ``pair``: every other source of the language with the value summed over all kept terms (0 if none is kept). Part
    ``term``: the ``top`` kept terms that lie highest above the language. Ranks go by value downwards, then by the item's UTF-8 bytes. Null text, lang and source
    count as '', repeated rows as often as they come; a group without terms has pairs only. An empty table gives no rows;
    other columns are not read.
    """
    with scratch(docs.sparkSession) as keep:
        kept = keep(materialize(kept_terms(docs, min_docs), "kept"))
        sums = keep(materialize(totals(docs, kept), "totals"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    first = pairs(kept, sums).withColumn("rank", F.row_number().over(order))
    out = ("lang", "source", "part", "item", "value", "rank")
    return first.withColumn("part", F.lit("pair")).select(*out).unionByName(leading_terms(kept, sums, top).withColumn("part", F.lit("term")).select(*out))


#: The same rows in DuckDB: all terms for all groups and pairs.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), o AS (
  SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL
), k AS (
  SELECT lang, term, CAST(sum(n) AS HUGEINT) AS l FROM o GROUP BY lang, term HAVING count(*) >= 10
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT o.lang, o.source, o.term, CAST(sum(o.n) AS HUGEINT) AS n FROM o JOIN k ON o.lang = k.lang AND o.term = k.term GROUP BY ALL
), v AS (
  SELECT lang, count(*) AS v, sum(l) AS total FROM k GROUP BY lang
), t AS (
  SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * v.v) AS p,
         1 + (1000000000::HUGEINT * (k.l + 2)) // (v.total + 2 * v.v) AS q
  FROM g JOIN k ON g.lang = k.lang JOIN v ON v.lang = g.lang LEFT JOIN t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), s AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), x AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q
), y AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM y WHERE part = 'pair' OR rank <= 10
"""
