"""Language-model scoring with a hierarchical Pitman-Yor model seated by Gibbs sampling.

A token's context is the word before it in the document; the first word follows the end of a text. There is a restaurant for
every word that was learned, and all share the root restaurant as parent; the root's base is
uniform over the learned vocabulary and one unknown word. A customer of a context restaurant that opens a
table is a customer of the root. The sampler takes, for each word, its customers out of every restaurant and seats them again one
by one by the Chinese-restaurant rule, while the restaurants' totals stay as of the sweep before. After
``burn`` sweeps, the predictive probabilities of ``samples`` seatings are averaged.

Scale: texts are read once and kept as pieces of a million tokens or so, numbers of the piece's own words. Pairs (word, word before) are dealt by hash to
parts of a bounded size, words to parts of their own; what one part tells another travels as one row with packed columns. In a sweep the
parts of pairs send the sums of their tables by word and by context, and get back the totals of the words they named. A pair that came once
always has one table and is left out of the sweeps. For scoring, every piece asks the parts for its pairs and words. No frequent word
or pair gathers more than a row from each sender. Random numbers are hashes of (word, context, sweep): reruns agree. The
commonest words of a bounded sample are broadcast and written as small numbers, others as 62-bit hashes; this only shortens what is sent. No table of
all words reaches the driver or a single task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.llm.common import batch, bytes_of, crc_mod, give_back, lower_words, materialize, scratch, sliced

#: The token that ends every text.
END = b""
#: Power of the number of tokens of the sample from which a word is written as a number.
COMMON = 0.04
#: Words that a task's counter holds before it is sent on; characters of the sample.
HELD, SAMPLED = 400_000, 1 << 25
#: Tokens of a piece; characters of the learned texts for each part.
PIECE, PART = 1 << 20, 1 << 23
#: What is sent: packed columns from a sender to a receiver.
BLOCK = "to long, by long, cols array<binary>"


class _Numbers(dict):
    """Consecutive numbers for keys in order of their first look-up."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


@dataclass
class Totals:
    """Customers and tables of the root, of one seating."""

    root_customers: int
    root_tables: int


@dataclass
class Model:
    """``pairs``: blocks (word, context, customers) by part, ``seats``: their tables in each sample, for those of two customers or more;
    ``nodes``: blocks (word, count, customers and tables at the root, tables as a context) by part, one for each sample, and ``still``: the
    words that came once."""

    train: DataFrame
    names: list[bytes]
    parts: int
    n_tokens: int = 0
    n_words: int = 0
    discount: tuple[float, float] = (0.5, 0.5)
    strength: tuple[float, float] = (1.0, 1.0)
    samples: list[Totals] = field(default_factory=list)
    pairs: DataFrame | None = None
    seats: DataFrame | None = None
    nodes: DataFrame | None = None
    still: DataFrame | None = None

    def unknown(self) -> np.ndarray:
        """Root probability of a word that was not learned, in each sample."""
        return np.array([_root(self.rule, t, np.zeros(1), np.zeros(1))[0] for t in self.samples])

    @property
    def rule(self) -> tuple:
        """What the tasks need of the model."""
        return self.n_words, self.discount, self.strength

    def vocabulary(self) -> DataFrame:
        """``(id, word, c, base, weight)``: count, root probability and weight of the root after the word, in each sample; ``END`` is the context of first words."""
        rule, samples = self.rule, self.samples

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, by, (ids, c, r, t0, t) in _blocks(batches):
                base, weight = _root(rule, samples[by], r, t0), _weight(rule, c, t)
                yield batch(k=(np.full(len(ids), by), pa.int32()), id=(ids, pa.int64()), c=(c, pa.int64()), base=(base, pa.float64()), weight=(weight, pa.float64()))

        def once(to: int, _: int, cols: list[np.ndarray]) -> list:
            return [(to, k, [cols[0], *[np.ones(len(cols[0]))] * 4]) for k in range(len(samples))]

        rows = self.nodes.unionByName(_mapped(self.still, once)).mapInArrow(run, "k int, id long, c long, base double, weight double")
        lists = [F.array_sort(F.collect_list(F.struct("k", x)))[x].alias(x) for x in ("base", "weight")]
        return rows.groupBy("id").agg(F.first("c").alias("c"), *lists).join(_named(self.train, self.names), "id")

    @cached_property
    def contexts(self) -> list[bytes]:
        """All learned words but the end, commonest first: for models that the driver can hold."""
        rows = self.vocabulary().where(F.length("word") > 0).select("word", "c").collect()
        return [w for _, w in sorted((-r["c"], bytes(r["word"])) for r in rows)]

    def root_weights(self) -> np.ndarray:
        """Probability of going to the root from the start of a text and from each of ``contexts`` (rows), in each sample."""
        return self._root_weights

    @cached_property
    def _root_weights(self) -> np.ndarray:
        rows = {bytes(r["word"]): r["weight"] for r in self.vocabulary().select("word", "weight").collect()}
        return np.array([rows.get(w, [1.0] * len(self.samples)) for w in [END, *self.contexts]])

    @property
    def words(self) -> DataFrame:
        """``(word, c, ctx, p, base)``: probabilities of each word in the contexts where it was seen, 0 for the start and 1 + place in
        ``contexts``, averaged over the samples: for models that the driver can hold."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, _, cols in _blocks(batches):
                w, v, n, t = (c[cols[2] > 0] for c in cols)
                yield batch(w=(w, pa.int64()), v=(v, pa.int64()), n=(n, pa.int64()), t=(t, pa.int64()))

        own, k = self.vocabulary(), len(self.samples)

        def together(held: list, sent: list) -> list:
            return [(to, 0, [*cols, _tables(cols[2], sent, k)]) for to, _, cols in held]

        places = self.train.sparkSession.createDataFrame([(bytearray(w), i) for i, w in enumerate([END, *self.contexts])], "word binary, at int")
        after = own.join(places, "word").select(F.col("id").alias("v"), F.col("c").alias("after"), "weight", "at")
        rows = _met(self.pairs, self.seats, together).mapInArrow(run, "w long, v long, n long, t long").join(own.select(F.col("id").alias("w"), "word", "c", "base"), "w").join(after, "v")
        through = F.aggregate(F.zip_with("weight", "base", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) / k
        p = (F.col("n") - self.discount[1] * F.col("t") / k) / (F.col("after") + self.strength[1]) + through
        lists = F.array_sort(F.collect_list(F.struct("at", p.alias("p"))))
        return rows.groupBy("word", "c", "base").agg(lists.alias("r")).select("word", "c", F.col("r.at").alias("ctx"), F.col("r.p").alias("p"), "base")


def _root(rule: tuple, totals: Totals, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
    n_words, (d, _), (s, _) = rule
    share = (s + d * totals.root_tables) / (n_words + 1)
    return (np.maximum(customers - d * tables, 0) + share) / (s + totals.root_customers)


def _weight(rule: tuple, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Probability of going to the root from contexts."""
    _, (_, d), (_, s) = rule
    return (s + d * tables) / (s + customers)


def _tokens(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All tokens of the texts, the ends included, and the number of tokens of each."""
    words: list[bytes] = []
    sizes = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        own = lower_words(t)
        words += own
        words.append(END)
        sizes[i] = len(own) + 1
    return words, sizes


def context_words(train: DataFrame, held: int = HELD) -> list[bytes]:
    """The words that come at least N ** COMMON times among the N tokens, commonest first: at most N ** (1 - COMMON) words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for rows in sliced(batches):
            seen.update(_tokens(bytes_of(rows))[0])
            if len(seen) > held:
                yield report(seen)
                seen = Counter()
        yield report(seen)

    def report(seen: Counter) -> pa.RecordBatch:
        return batch(word=(list(seen), pa.binary()), n=(list(seen.values()), pa.int64()))

    with scratch(train.sparkSession):
        found = materialize(train.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "common")
        least = (found.agg(F.sum("n")).first()[0] or 0) ** COMMON
        rows = found.where((F.length("word") > 0) & (F.col("n") >= least)).collect()
    return [w for _, w in sorted((-r["n"], bytes(r["word"])) for r in rows)]


def _sample(train: DataFrame, chars: int) -> DataFrame:
    """Texts of some ``SAMPLED`` characters, told by their hashes."""
    return train.where(F.pmod(F.xxhash64("text"), F.lit(max(chars // SAMPLED, 1))) == 0)


def _ids(words: list[bytes], known: Lexicon) -> np.ndarray:
    """Numbers of words: 0 for the end, from 1 on for those of the lexicon, hashes from 2 ** 62 on for others."""
    out = known.find(words) + 1
    at = [i for i in np.flatnonzero(out == 0).tolist() if words[i] != END]
    out[at] = np.frombuffer(b"".join(blake2b(words[i], digest_size=8).digest() for i in at), np.uint64) >> np.uint64(1) | np.uint64(1 << 62)
    return out


def _named(train: DataFrame, names: list[bytes]) -> DataFrame:
    """``(id, word)`` of all words of the texts."""
    shared = train.sparkSession.sparkContext.broadcast(Lexicon(pa.array(names, pa.binary())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sliced(batches):
            words = list(dict.fromkeys(_tokens(bytes_of(rows))[0]))
            yield batch(id=(_ids(words, shared.value), pa.int64()), word=(words, pa.binary()))

    return train.select("text").mapInArrow(run, "id long, word binary").distinct()


def pack(x: np.ndarray) -> bytes:
    """Whole numbers byte by byte of their places, compressed; numbers in order as their steps."""
    x = np.ascontiguousarray(x, dtype=np.int64)
    steps = np.diff(x, prepend=0)
    ordered = bool(len(x)) and int(x[0]) >= 0 and int(steps.min()) >= 0
    own = (steps if ordered else x).view(np.uint8).reshape(-1, 8).T.tobytes()
    return bytes([ordered]) + len(x).to_bytes(8, "little") + pa.compress(own, codec="zstd", asbytes=True)


def unpack(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[1:9], "little")
    own = pa.decompress(b[9:], 8 * n, codec="zstd", asbytes=True) if n else b""
    out = np.ascontiguousarray(np.frombuffer(own, np.uint8).reshape(8, n).T).view(np.int64).ravel()
    return np.cumsum(out) if b[0] else out


def _sent(rows: list[tuple[int, int, list[np.ndarray]]]) -> pa.RecordBatch:
    to, by, cols = zip(*rows, strict=True) if rows else ((), (), ())
    return batch(to=(to, pa.int64()), by=(by, pa.int64()), cols=([[pack(c) for c in x] for x in cols], pa.list_(pa.binary())))


def _blocks(rows: pa.Table | Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    for b in rows.to_batches() if isinstance(rows, pa.Table) else rows:
        for i in range(b.num_rows):
            yield b["to"][i].as_py(), b["by"][i].as_py(), [unpack(x) for x in b["cols"][i].as_py()]


def _joined(blocks: list[list[np.ndarray]], n: int) -> list[np.ndarray]:
    return [np.concatenate([b[i] for b in blocks]) if blocks else np.zeros(0, np.int64) for i in range(n)]


def _dealt(part: np.ndarray, by: int, cols: list[np.ndarray]) -> list[tuple[int, int, list[np.ndarray]]]:
    """The rows of some columns in a block for each part, in the order they have."""
    order = np.argsort(part.astype(np.uint16) if part.max(initial=0) < 1 << 16 else part, kind="stable")
    parts, starts = np.unique(part[order], return_index=True)
    ends = np.append(starts, len(part))[1:]
    return [(int(p), by, [c[order[i:j]] for c in cols]) for p, i, j in zip(parts, starts, ends, strict=True)]


def _mixed(*keys: np.ndarray | int, start: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the keys (splitmix64), after those of ``start``."""
    with np.errstate(over="ignore"):
        x = np.uint64(0x9E3779B97F4A7C15) if start is None else start
        for k in keys:
            x = (x ^ np.asarray(k).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
    return x


def _part(parts: int, *keys: np.ndarray) -> np.ndarray:
    return (_mixed(*keys, 7) % np.uint64(parts)).astype(np.int64)


def _mapped(df: DataFrame, fn: Callable[[int, int, list[np.ndarray]], list]) -> DataFrame:
    """``fn`` of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for to, by, cols in _blocks(batches):
            yield _sent(fn(to, by, cols))
        give_back()

    return df.mapInArrow(run, BLOCK)


def _met(held: DataFrame, sent: DataFrame, fn: Callable[[list, list], list]) -> DataFrame:
    """``fn`` of the blocks that are held for a receiver and of those sent to it, for each receiver."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.Table.from_batches([_sent(fn(list(_blocks(left)), list(_blocks(right))))])
        give_back()
        return out

    return held.groupBy("to").cogroup(sent.groupBy("to")).applyInArrow(run, BLOCK)


def read(docs: DataFrame, names: list[bytes], tokens: int = PIECE) -> DataFrame:
    """Pieces of ``docs(doc_id, held_out, text)``: blocks (words in order, tokens as places of these, sizes, ids, null ids, held out)."""
    shared = docs.sparkSession.sparkContext.broadcast(Lexicon(pa.array(names, pa.binary())))

    def sent(piece: int, numbers: _Numbers, own: list) -> pa.RecordBatch:
        ids, (tokens, *rest) = _ids(list(numbers), shared.value), _joined(own, 5)
        order = np.argsort(ids)
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        return _sent([(piece, 0, [ids[order], place[tokens], *rest])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, n = TaskContext.get().partitionId() << 32, 0
        numbers, own = _Numbers({END: 0}), []
        for rows in sliced(batches):
            if not rows.num_rows:
                continue
            words, sizes = _tokens(bytes_of(rows))
            ids = rows.column("doc_id")
            flags = [x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (ids.fill_null(0), ids.is_null(), rows.column("held_out"))]
            own.append([np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), sizes, *flags])
            n += len(words)
            if n >= tokens:
                yield sent(piece, numbers, own)
                piece, n, numbers, own = piece + 1, 0, _Numbers({END: 0}), []
        if own:
            yield sent(piece, numbers, own)

    return materialize(docs.select("doc_id", "held_out", "text").mapInArrow(run, BLOCK), "pieces")


def _codes(ids: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Word and word before of each token as one number; the first word follows an end, like the first of the next text."""
    return tokens * len(ids) + np.concatenate([[0], tokens[:-1]])


def deal(pieces: DataFrame, parts: int) -> DataFrame:
    """The different pairs of all texts by part. For a part: (word, context, n) in order, to -1, where n counts in texts that are not held out; n
    again, to -2; and the places of each piece's pairs among them, to the piece."""

    def run(piece: int, _: int, cols: list[np.ndarray]) -> list:
        ids, tokens, sizes, _, _, held = cols
        code, at = np.unique(_codes(ids, tokens), return_inverse=True)
        w, v, n = ids[code // len(ids)], ids[code % len(ids)], np.bincount(at, weights=np.repeat(held == 0, sizes), minlength=len(code))
        return _dealt(_part(parts, w, v), piece, [w, v, n])

    def sums(rows: pa.Table) -> pa.Table:
        blocks = list(_blocks(rows))
        w, v, n = _joined([b for _, _, b in blocks], 3)
        order = np.lexsort((v, w))
        w, v = w[order], v[order]
        new = np.concatenate([[True], (w[1:] != w[:-1]) | (v[1:] != v[:-1])])
        first, place = np.flatnonzero(new), np.empty(len(new), dtype=np.int64)
        place[order] = np.cumsum(new) - 1
        n, part = np.add.reduceat(n[order], first), blocks[0][0]
        ends = np.cumsum([len(b[0]) for _, _, b in blocks])[:-1]
        own = [(part, piece, [at]) for (_, piece, _), at in zip(blocks, np.split(place, ends), strict=True)]
        out = pa.Table.from_batches([_sent([(part, -1, [w[first], v[first], n]), (part, -2, [n]), *own])])
        give_back()
        return out

    return materialize(_mapped(pieces, run).groupBy("to").applyInArrow(sums, BLOCK), "pairs")


def _by_word(ids: list[np.ndarray], sums: list[list[tuple[int, np.ndarray]]], parts: int, by: int) -> list:
    """Sums by word for the words' parts: each of ``sums`` adds weights to words of the columns ``ids``."""
    own, at = np.unique(np.concatenate(ids), return_inverse=True)
    ends = np.cumsum([0, *map(len, ids)])
    total = lambda of: sum(np.bincount(at[ends[i] : ends[i + 1]], weights=x, minlength=len(own)) for i, x in of).astype(np.int64)
    return _dealt(_part(parts, own), by, [own, *map(total, sums)])


def _nodes(pairs: DataFrame, parts: int) -> DataFrame:
    """Blocks (word, count, number of its contexts, pairs that came once of the word and of the context) by part."""

    def run(to: int, _: int, cols: list[np.ndarray]) -> list:
        w, v, n = (c[cols[2] > 0] for c in cols)
        once = n == 1
        return _by_word([w, v], [[(0, n)], [(0, None)], [(0, once)], [(1, once)]], parts, to)

    def sums(rows: pa.Table) -> pa.Table:
        blocks = list(_blocks(rows))
        ids, *cols = _joined([b for _, _, b in blocks], 5)
        own, at = np.unique(ids, return_inverse=True)
        out = [own, *(np.bincount(at, weights=c).astype(np.int64) for c in cols)]
        return pa.Table.from_batches([_sent([(blocks[0][0], 0, out)])])

    return materialize(_mapped(pairs, run).groupBy("to").applyInArrow(sums, BLOCK), "nodes")


def _counts(df: DataFrame, fn: Callable[[list[np.ndarray]], list[int]], n: int) -> list[int]:
    """Sums of some whole numbers of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, cols in _blocks(batches):
            yield batch(x=([[int(y) for y in fn(cols)]], pa.list_(pa.int64())))

    found = df.mapInArrow(run, "x array<long>").agg(*[F.coalesce(F.sum(F.col("x")[i]), F.lit(0)) for i in range(n)])
    return list(found.first())


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def seat(customers: np.ndarray, share: np.ndarray, d: float, *keys: np.ndarray | int) -> np.ndarray:
    """Tables after the customers of one dish have come to a restaurant one by one.

    The first opens a table; a later one, with i before it at t tables, opens one with odds
    ``share : i - d t``, where ``share`` is the weight of the parent's dish. The next customer who opens one is drawn at
    once: while t stays, the chance at i bounds that of the customers up to 2 i, so the gap to a candidate
    is geometric with that chance, and the candidate opens a table with its own chance over the bound.
    """
    t = np.minimum(customers, 1)
    i = np.ones(len(customers), dtype=np.int64)
    until = i + 1
    at, turn, seed = np.flatnonzero(customers > 1), 0, np.broadcast_to(_mixed(*keys), len(customers))
    while len(at):
        turn += 1
        own = _mixed(turn, start=seed[at])
        chance = lambda x: share[at] / (share[at] + x - d * t[at])  # noqa: B023, E731
        bound = chance(i[at])
        end = np.minimum(until[at], customers[at])
        gap = np.floor(np.log(_uniform(_mixed(1, start=own))) / np.log1p(-np.minimum(bound, 1 - 1e-12)))
        met = np.minimum(i[at] + np.minimum(gap, 1 << 40), end).astype(np.int64)
        opens = (met < end) & (_uniform(_mixed(2, start=own)) * bound < chance(met))
        t[at] += opens
        i[at] = np.where(met < end, met + 1, end)
        until[at] = np.where(i[at] >= until[at], 2 * i[at], until[at])
        at = at[i[at] < customers[at]]
    return t


def _swept(nodes: DataFrame, told: DataFrame, rule: tuple, before: Totals | None, sweep: int) -> DataFrame:
    """Totals of the words from what the parts of pairs have told: to each of these (word, customers and tables at the root, tables as a context),
    and for all words, to -1 - part, (word, count, customers and tables at the root, tables as a context)."""

    def run(held: list, sent: list) -> list:
        if not held:
            return []
        to, _, (ids, c, _, r, t) = held[0]
        places = [np.searchsorted(ids, own) for _, _, (own, _, _) in sent]  # words of pairs that came twice
        for at, (_, _, (_, more, open_)) in zip(places, sent, strict=True):  # a word comes once in a block
            r[at] += more
            t[at] += open_
        if before is None:
            t0 = np.minimum(r, 1)
        else:
            n_words, (d0, _), (s0, _) = rule
            t0 = seat(r, np.full(len(r), (s0 + d0 * before.root_tables) / (n_words + 1)), d0, ids, -1, sweep - 1)
        return [(-1 - to, sweep, [ids, c, r, t0, t]), *((by, sweep, [own, r[at], t0[at], t[at]]) for at, (_, by, (own, _, _)) in zip(places, sent, strict=True))]

    return materialize(_met(nodes, told, run), "sweep")


def _drawn(rule: tuple, now: Totals, sweep: int, cols: list[np.ndarray], sent: list) -> np.ndarray:
    """Tables of pairs (word, context, n) after a sweep, from the totals before it."""
    w, v, n = cols
    _, (_, d), (_, s) = rule
    ids, r, t0, t = _joined([b for _, _, b in sent], 4)
    order = np.argsort(ids)
    at, ctx = (order[np.searchsorted(ids, x, sorter=order)] for x in (w, v))
    return seat(n, (s + d * t[ctx]) * _root(rule, now, r[at], t0[at]), d, w, v, sweep)


def _tables(n: np.ndarray, sent: list, samples: int) -> np.ndarray:
    """Tables of all pairs, summed over the samples, from those of the pairs that came twice or more."""
    t = np.where(n > 0, samples, 0)
    if sent:
        t[n > 1] = sum(cols[0] for _, _, cols in sent)
    return t


def learn(dealt: DataFrame, model: Model, burn: int, samples: int) -> Model:
    """Seat the texts that are not held out."""
    parts = model.parts
    with scratch(dealt.sparkSession) as keep:
        pairs = dealt.where("by = -1")
        nodes = _nodes(pairs, parts)
        once, twice = _counts(pairs, lambda x: [(x[2] == 1).sum(), (x[2] == 2).sum()], 2)
        model.n_words, model.n_tokens, alone, paired = _counts(nodes, lambda x: [len(x[0]), x[1].sum(), (x[2] == 1).sum(), (x[2] == 2).sum()], 4)
        # the usual estimate of a discount from what came once and twice
        guess = lambda a, b: float(np.clip(a / (a + 2 * b), 0.1, 0.9)) if a else 0.5
        model.discount = guess(alone, paired), guess(once, twice)
        rule = model.rule
        # a word that came once has one table everywhere
        model.still = keep(materialize(_mapped(nodes, lambda to, _, x: [(to, -1, [x[0][x[1] == 1]])]), "still"))
        nodes = materialize(_mapped(nodes, lambda to, _, x: [(to, 0, [y[x[1] > 1] for y in x])]), "nodes")
        n_still = _counts(model.still, lambda x: [len(x[0])], 1)[0]

        def several(to: int, _: int, cols: list[np.ndarray]) -> list:
            some = cols[2] > 1
            return [(to, 0, [c[some] for c in cols])] if some.any() else []

        def opened(to: int, cols: list[np.ndarray], t: np.ndarray) -> list:
            return _by_word(cols[:2], [[(0, t)], [(1, t)]], parts, to)

        moving = materialize(_mapped(pairs, several), "moving")
        told = _mapped(moving, lambda to, _, cols: opened(to, cols, np.ones(len(cols[0]))))
        taken = range(burn + 1, burn + 1 + samples)
        seats: list[DataFrame] = []
        history: list[tuple[Totals, DataFrame]] = []
        for sweep in range(burn + samples + 1):
            swept = _swept(nodes, told, rule, history[-1][0] if history else None, sweep)
            now = Totals(*(x + n_still for x in _counts(swept.where("to < 0"), lambda x: [x[2].sum(), x[3].sum()], 2)))
            history.append((now, swept))
            if sweep == burn + samples:
                break

            def move(held: list, sent: list, now: Totals = now, sweep: int = sweep) -> list:
                out = []
                for to, _, cols in held:
                    t = _drawn(rule, now, sweep, cols, sent)
                    out += [*opened(to, cols, t), (-1 - to, 1, [t])]
                return out

            moved = materialize(_met(moving, swept.where("to >= 0"), move), "moved")
            told = moved.where("to >= 0")
            if sweep + 1 in taken:
                seats.append(moved.where("to < 0"))
        model.samples = [history[k][0] for k in taken]

        # to -1 - part: the tables of its pairs, and its words
        several_of = lambda dfs: reduce(DataFrame.unionByName, dfs).withColumn("to", -1 - F.col("to"))
        model.pairs, model.seats = pairs, keep(materialize(several_of(seats), "seats"))
        words = several_of([history[k][1].where("to < 0") for k in taken]).withColumn("by", F.col("by") - (burn + 1))
        model.nodes = keep(materialize(words, "words"))
    return model


def _planned(train: DataFrame) -> Model:
    chars = train.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    return Model(train, context_words(_sample(train, chars)), 1 + chars // PART)


def fit(train: DataFrame, burn: int = 1, samples: int = 2) -> Model:
    """Learn from all texts of ``train(text)``; null texts count as empty."""
    with scratch(train.sparkSession) as keep:
        model = _planned(train)
        pieces = read(train.select(F.lit(None).cast("long").alias("doc_id"), F.lit(False).alias("held_out"), "text"), model.names)
        dealt = keep(deal(pieces, model.parts))
        model = learn(dealt, model, burn, samples)
        for x in (model.seats, model.nodes, model.still):
            keep(x)
    return model


class Lexicon:
    """Numbers of many words in some 25 bytes a word: their bytes end to end, and sorted hashes that each process makes for itself."""

    def __init__(self, words: pa.BinaryArray) -> None:
        own = words.to_pylist()
        self.text = b"".join(own)
        self.ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)), dtype=np.int64 if len(self.text) >> 31 else np.int32)
        self.hashes: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.ends)

    def __getstate__(self) -> dict:
        return {"text": self.text, "ends": self.ends, "hashes": None}  # hashes of bytes differ from process to process

    def word(self, i: int) -> bytes:
        return self.text[self.ends[i - 1] if i else 0 : self.ends[i]]

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for those that are not held."""
        if self.hashes is None:
            own = np.fromiter((hash(self.word(i)) for i in range(len(self))), np.int64, len(self))
            self.places = np.argsort(own, kind="stable").astype(np.int32)
            self.hashes = own[self.places]
        asked = np.fromiter(map(hash, words), np.int64, len(words))
        first, after = (np.searchsorted(self.hashes, asked, side) for side in ("left", "right"))
        out = np.full(len(words), -1, dtype=np.int64)
        for turn in range(int((after - first).max(initial=0))):  # one, but for words of equal hash
            at = np.flatnonzero((first + turn < after) & (out < 0))
            place = self.places[first[at] + turn].astype(np.int64)
            begin = np.where(place > 0, self.ends[place - 1], 0)
            same = [self.text[i:j] == words[k] for i, j, k in zip(begin.tolist(), self.ends[place].tolist(), at.tolist(), strict=True)]
            out[at[same]] = place[same]
        return out


def _places(w: np.ndarray, v: np.ndarray, own: list[np.ndarray]) -> np.ndarray:
    """The place among the pairs ``own`` of each pair, -1 for those that are not there."""
    keys = _mixed(*own)
    order = np.argsort(keys)
    at = order[np.minimum(np.searchsorted(keys, _mixed(w, v), sorter=order), len(order) - 1)]
    return np.where((own[0][at] == w) & (own[1][at] == v), at, -1)


def _scored(pieces: DataFrame, dealt: DataFrame, model: Model, learned: bool) -> DataFrame:
    """Scores of the texts of pieces; ``learned`` tells that the model has its pairs from the same ``dealt`` table."""
    parts, rule, samples, discount, strength = model.parts, model.rule, model.samples, model.discount[1], model.strength[1]
    k, n_tokens, tokens_and_words = len(samples), model.n_tokens, float(model.n_tokens + model.n_words + 1)

    def ask_words(piece: int, _: int, cols: list[np.ndarray]) -> list:
        return _dealt(_part(parts, cols[0]), piece, [cols[0]])

    def tell_pairs(held: list, sent: list) -> list:
        seats = [x for x in held if x[1] == 1]
        if learned:
            n = next(cols[0] for _, by, cols in sent if by == -2)
            t = _tables(n, seats, k)
        else:
            w, v, _ = next(cols for _, by, cols in sent if by == -1)
            n = t = np.zeros(len(w), dtype=np.int64)
            for *keys, own in (cols for _, by, cols in held if by == -1):
                at = _places(w, v, keys)
                n, t = (np.where(at < 0, 0, x[at]) for x in (own, _tables(own, seats, k)))
        return [(piece, part, [n[at], t[at][n[at] > 1]]) for part, piece, (at, *_) in sent if piece >= 0]

    def tell_words(held: list, sent: list) -> list:
        still = _joined([cols for _, by, cols in held if by < 0], 1)[0]
        held = [cols for _, by, cols in sorted(held, key=lambda x: x[1]) if by >= 0]
        ids, out = held[0][0] if held else still[:0], []
        for part, piece, (own,) in sent:
            told = np.zeros((1 + 3 * k, len(own)), dtype=np.int64)
            told[:, np.isin(own, still, assume_unique=True)] = 1
            if len(ids):
                at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
                there = ids[at] == own
                told[:, there] = [held[0][1][at[there]], *(x[at[there]] for cols in held for x in cols[2:])]
            out.append((piece, parts + part, list(told)))
        return out

    def gathered(told: list, part: np.ndarray, first: int, rows: int) -> np.ndarray:
        """What the parts have told, in the order of what they were asked."""
        order = np.argsort(part, kind="stable")
        out = np.zeros((rows, len(part)), dtype=np.int64)
        for _, by, cols in told:
            if first <= by < first + parts:
                i, j = np.searchsorted(part, [by - first, by - first + 1], sorter=order)
                out[: len(cols), order[i:j]] = cols
        return out

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (_, _, (ids, tokens, sizes, doc_id, without, held)), told = next(_blocks(left)), list(_blocks(right))
        code, at = np.unique(_codes(ids, tokens), return_inverse=True)
        w, v = code // len(ids), code % len(ids)
        known = gathered(told, _part(parts, ids), parts, 1 + 3 * k)
        told = [(to, by, [n, _tables(n, [(0, 1, [t])], k)]) for to, by, (n, t, *_) in told if by < parts]
        c, seen = known[0], gathered(told, _part(parts, ids[w], ids[v]), 0, 2)
        p = (seen[0] - discount * seen[1] / k) / (strength + c[v])
        for i, totals in enumerate(samples):
            r, t0, t = known[1 + 3 * i : 4 + 3 * i]
            p += _root(rule, totals, r, t0)[w] * _weight(rule, c, t)[v] / k
        doc = np.repeat(np.arange(len(sizes)), sizes)
        total = lambda x: np.bincount(doc, weights=x, minlength=len(sizes))
        out = batch(
            doc_id=(pa.array(doc_id, mask=without > 0), pa.int64()), held_out=(held > 0, pa.bool_()), n_tokens=(sizes, pa.int64()), n_known=(total(c[tokens] > 0).astype(np.int64), pa.int64()),
            train_tokens=(np.full(len(sizes), n_tokens), pa.int64()), base_score=(total(np.log10((c + 1) / tokens_and_words)[tokens]), pa.float64()), score=(total(np.log10(p)[at]), pa.float64()),
        )
        give_back()
        return pa.Table.from_batches([out])

    own, asked = (model.seats, dealt.where("by <> -1")) if learned else (model.pairs.unionByName(model.seats), dealt.where("by <> -2"))
    told = _met(own, asked, tell_pairs)
    told = told.unionByName(_met(model.nodes.unionByName(model.still), _mapped(pieces, ask_words), tell_words))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return pieces.groupBy("to").cogroup(told.groupBy("to")).applyInArrow(run, schema)


def _flagged(docs: DataFrame, mod: int, out: int) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod(F.col("doc_id"), mod) == out).alias("held_out"), "text")


def score(docs: DataFrame, model: Model, cells: int = PIECE, mod: int = 7, out: int = 2) -> DataFrame:
    """Rows ``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, one for each row of ``docs(doc_id, text)``.

    Scores are log10 probabilities of the whole text: ``base_score`` by add-one counts, ``score`` by the
    averaged predictive probabilities. A null text is empty (its end only), a null id counts as the empty
    text for ``held_out``. Repeated rows are returned as they come. An empty table gives no rows; if nothing
    was learned every token has the probability of an unknown word. Other columns are not read. A piece of the
    texts ends with the text that brings it to ``cells`` tokens.
    """
    pieces = read(_flagged(docs, mod, out), model.names, cells)
    return _scored(pieces, deal(pieces, model.parts), model, learned=False)


def fit_and_score(docs: DataFrame, mod: int = 7, out: int = 2) -> DataFrame:
    """``score`` of all documents with a model of those whose crc32(doc_id) modulo ``mod`` is not ``out``; texts are read into pieces once."""
    model = _planned(docs.where(crc_mod(F.col("doc_id"), mod) != out))
    pieces = read(_flagged(docs, mod, out), model.names)
    dealt = deal(pieces, model.parts)
    return _scored(pieces, dealt, learn(dealt, model, 1, 2), learned=True)


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity of the model and of the base, held out and not."""
    of = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(of("score").alias("perplexity"), of("base_score").alias("base_perplexity"))
