"""Language ID by prediction with partial matching over bytes.

For each language a tree of byte contexts up to ``order`` bytes is counted on a bounded sample of labelled
documents and then frozen. A byte's code length is that of PPM, escape method C with exclusions: from the
longest known context, a byte not seen there pays the escape and goes one byte shorter, down to a uniform
code over all 256 bytes. A text's language is the one with the shortest code.

Frozen statistics make a byte's code length a function of the last ``order`` bytes and the byte. Bytes
that no sample holds are alike in every tree, so they share one symbol. Each language has a table of its own: the state (its longest
known context) of any three symbols, and the code lengths of its states x symbols. They are built on the driver and broadcast; a
language's table is bounded by its sample (``docs_per_language`` documents or stretches of at most ``max_chars`` characters), so all
grow as the languages do. A text is scored whole with two array look-ups a byte and language.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetra.llm.common import bytes_of, crc_mod, map_batches, materialize, scratch

UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")
#: Bytes scored at once; bounds memory for very long texts.
BLOCK = 1 << 20


@dataclass
class Model:
    """Frozen trees. ``states``: for each language the state of three symbols (oldest first) in base ``n``; ``bits``: its states x symbols."""

    languages: list[str]
    symbol: np.ndarray
    states: list[np.ndarray]
    bits: list[np.ndarray]

    def code_lengths(self, text: bytes) -> np.ndarray:
        """Bits of the whole text for each language."""
        n = int(self.symbol.max()) + 1
        total = np.zeros(len(self.languages))
        for i in range(0, len(text), BLOCK):
            head = b"\n\n\n" if i == 0 else text[i - 3 : i]
            s = self.symbol[np.frombuffer(head + text[i : i + BLOCK], dtype=np.uint8)].astype(np.int32)
            before = (s[:-3] * n + s[1:-2]) * n + s[2:-1]
            for k, (state, bits) in enumerate(zip(self.states, self.bits, strict=True)):
                total[k] += bits.ravel()[state[before].astype(np.int64) * n + s[3:]].sum(dtype=np.float64)
        return total

    def predict(self, text: bytes) -> tuple[str, float]:
        """Language and score: its share of 2 ** -bits, with the bits of at most 64 average bytes."""
        if not self.languages or not text or not LETTER.search(text.decode("utf-8", "replace")):
            return UNDETERMINED, 0.0
        bits = self.code_lengths(text)
        gap = (bits - bits.min()) * min(1.0, 64 / len(text))
        return self.languages[int(bits.argmin())], float(1 / np.exp2(-gap).sum())


def build(samples: dict[str, list[bytes]], order: int = 3) -> Model:
    """Count the trees of ``samples`` (texts by language) and tabulate their code lengths; ``order`` is 3 or less."""
    if not 0 <= order <= 3:
        raise ValueError("order must be between 0 and 3")
    languages = sorted(samples)
    present = sorted({b for texts in samples.values() for t in texts for b in set(t)} | {10})
    n = len(present) + 1
    symbol = np.full(256, n - 1, dtype=np.uint8 if n <= 256 else np.int16)
    symbol[present] = np.arange(n - 1)
    trees: list[dict[tuple[int, ...], dict[int, int]]] = []
    for lang in languages:
        grams: Counter = Counter()
        for t in samples[lang]:
            s = symbol[np.frombuffer(b"\n\n\n" + t, dtype=np.uint8)].astype(np.int64)
            code = ((s[:-3] * n + s[1:-2]) * n + s[2:-1]) * n + s[3:]
            grams.update(dict(zip(*(x.tolist() for x in np.unique(code, return_counts=True)), strict=True)))
        tree: dict[tuple[int, ...], dict[int, int]] = defaultdict(lambda: defaultdict(int))
        for code, count in grams.items():
            c, x = divmod(code, n)
            context = (c // (n * n), c // n % n, c % n)
            for k in range(order + 1):
                tree[context[3 - k :]][x] += count
        trees.append(tree)
    states, bits = [], []
    for tree in trees:
        known = sorted({*tree, ()}, key=lambda c: (len(c), c))
        # the state of three symbols is their longest suffix that the tree knows: shorter ones first, longer ones over them
        cube = np.zeros((n, n, n), dtype=np.int32)
        for i, c in enumerate(known):
            cube[(slice(None),) * (3 - len(c)) + c] = i
        states.append(cube.ravel())
        bits.append(np.stack([_code_lengths(tree, c, n) for c in known]).astype(np.float32))
    return Model(languages, symbol, states, bits)


def _code_lengths(tree: dict, context: tuple[int, ...], n: int) -> np.ndarray:
    """Bits of every symbol after ``context`` in one tree: escape method C with exclusions."""
    out = np.full(n, np.inf)
    open_ = np.ones(n, dtype=bool)
    spent = 0.0
    for k in range(len(context), -1, -1):
        seen = tree.get(context[len(context) - k :])
        if not seen:
            continue
        x = np.fromiter(seen.keys(), np.int64, len(seen))
        c = np.fromiter(seen.values(), np.float64, len(seen))
        left = open_[x]
        x, c = x[left], c[left]
        if not len(x):
            continue
        total = c.sum() + len(x)
        out[x] = spent - np.log2(c / total)
        spent += np.log2(total / len(x))
        open_[x] = False
    # every byte not met yet, those that share the last symbol included, is equally likely
    rest = open_.sum() - 1 + (256 - (n - 1))
    out[open_] = spent + np.log2(max(rest, 1))
    return out


def fit(docs: DataFrame, docs_per_language: int = 120, max_chars: int = 8000, order: int = 3, mod: int = 4, out: int = 2) -> Model:
    """Learn from documents with a ``lang`` whose crc32(doc_id) modulo ``mod`` is not ``out``.

    The sample is bounded: in each language the ``docs_per_language`` documents of smallest hash of id and text
    that are not empty, of those longer than ``max_chars`` characters a stretch of that length at a place given by the hash
    (documents are scored whole). So every language that a document has is learned.
    """
    fair = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0) & (crc_mod(F.col("doc_id"), mod) != out))
    keyed = fair.select("lang", F.xxhash64("doc_id", "text").alias("h"), "text")
    # ranks need hashes only; a cell of the hash keeps few, so that no window holds a whole language
    cell = Window.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy("h")
    few = keyed.select("lang", "h").withColumn("r", F.row_number().over(cell)).where(F.col("r") <= docs_per_language)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= docs_per_language)
    with scratch(docs.sparkSession):
        last = materialize(few.groupBy(F.col("lang").alias("l")).agg(F.max("h").alias("most")), "sample")
        chosen = keyed.join(last, (keyed["lang"] == last["l"]) & (keyed["h"] <= last["most"]))
        start = F.pmod("h", F.greatest(F.length("text") - max_chars + 1, F.lit(1)).cast("long")).cast("int") + 1
        chosen = chosen.select("lang", F.substring("text", start, F.lit(max_chars)).alias("text")).distinct()
        samples: dict[str, list[bytes]] = defaultdict(list)
        for lang, text in sorted(map(tuple, chosen.collect())):
            samples[lang].append(text.encode())
    return build(samples, order)


def identify(docs: DataFrame, model: Model, mod: int = 4, out: int = 2) -> DataFrame:
    """Rows ``(doc_id, held_out, lang_pred, score)``, one for each row of ``docs(doc_id, text)``.

    ``und`` with score 0 if the text is null, has no letter, or nothing was learned. Texts are scored whole.
    A null id counts as the empty text for ``held_out``. An empty table gives no rows; other columns are
    not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.predict(t) for t in bytes_of(rows)]
        return pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), rows.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())],
            names=["doc_id", "held_out", "lang_pred", "score"],
        )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod(F.col("doc_id"), mod) == out).alias("held_out"), "text")
    return map_batches(own, run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, min_score: float = 0.5) -> DataFrame:
    """``docs`` (doc_id, text, lang, source, n_chars) without those whose language is undetermined or scored under ``min_score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.predict(t) for t in bytes_of(rows)]
        return rows.filter(pa.array([x != UNDETERMINED and y >= min_score for x, y in found], pa.bool_()))

    return map_batches(docs, run, docs.schema)


def predictions(docs: DataFrame) -> DataFrame:
    """``identify`` with a model learned from the same table."""
    return identify(docs, fit(docs))


__all__ = ["Model", "build", "fit", "identify", "keep_identified", "predictions"]
