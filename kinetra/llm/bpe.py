"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece there is just one token that can end its encoding. An automaton over the
vocabulary lists the tokens that end at each place; one of them is the last token there if it starts where
another prefix's encoding ends and BPE would not merge across the seam. These tests look only at the two
tokens' merge trees. The stored last tokens are followed back from the end, which gives the exact ids in
time linear in the piece, however long.

Pieces (the pre-tokenizer's) repeat, and so do runs between spaces, which hold whole pieces unless white
space stands on both sides of the space. A worker keeps the ids of recent ones in two bounded caches: when the newer
is full it becomes the older one, and what is still used moves over. A piece that begins with a space is a run too.
Ids become digits and bytes again by Arrow's look-up in a table of the vocabulary.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.llm.common import give_back, map_batches, texts_of

#: The pre-tokenizer's pattern: a fixed value of the byte-level BPE format, white space by its Unicode property.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Pieces and runs that each of a worker's two caches holds at most, and the longest one it holds.
CACHE_PIECES, CACHE_LENGTH = 1 << 17, 48
#: Pairs of tokens whose seam a worker knows. A job of its own holds so many times the pieces that one after other stages does.
CACHE_SEAMS, ROOMY = 1 << 18, 4
#: A space with white space on either side: there a run's pieces depend on its neighbours.
WIDE_SPACE = re.compile(r"\s (?:\s|$)")
FOREVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The format's printable letter for each byte: visible Latin-1 stands for itself, the rest is shifted up by 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokenizer:
    """A byte-level BPE vocabulary, from the JSON text of a tokenizer file."""

    def __init__(self, content: str, times: int = 1) -> None:
        self.times = times
        data = json.loads(content)
        model, added = data["model"], data.get("added_tokens") or []
        pre = data.get("pre_tokenizer") or {}
        plain = not data.get("normalizer") and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not plain:
            raise ValueError("only plain byte-level BPE files are read")
        letters = byte_alphabet()
        raw = {t: bytes(letters[c] for c in t) for t in model["vocab"]}
        self.added = {t["content"]: t["id"] for t in added}
        token = {i: raw[t] for t, i in model["vocab"].items()} | {i: t.encode() for t, i in self.added.items()}
        # bytes and decimal digits by id; an id that no token has gives no bytes
        ids = range(max(token, default=-1) + 1)
        self.bytes = pa.array([token.get(i, b"") for i in ids], pa.large_binary())
        self.digits = pa.array([b"%d," % i for i in ids], pa.large_binary())
        self.rank: dict[int, int] = {}
        # what a token is merged of and at which rank, by token: flat arrays, since a worker shares its executor's memory
        size = max(model["vocab"].values(), default=-1) + 1
        self.parts, self.made = (array("i", [-1]) * size, array("i", [-1]) * size), array("q", [FOREVER]) * size
        for r, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = model["vocab"][left], model["vocab"][right]
            self.rank[a << 32 | b] = r
            whole = model["vocab"][left + right]
            if self.made[whole] == FOREVER:
                self.parts[0][whole], self.parts[1][whole], self.made[whole] = a, b, r
        self.ends = ahocorasick.Automaton()
        for t, i in model["vocab"].items():
            if t not in self.added:
                self.ends.add_word(raw[t].decode("latin-1"), (i, len(raw[t])))
        self.ends.make_automaton()
        self.pieces = regex.compile(PIECES)
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.fits: dict[int, bool] = {}
        # ids by what follows a space, and of pieces without one
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at a token's edge while it is being merged, each with the rank at which it is merged away."""
        out = [(token, FOREVER)]
        while self.parts[side][token] >= 0:
            until, token = self.made[token], self.parts[side][token]
            out.append((token, until))
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE of a's and b's bytes together leaves the seam between them unmerged.

        A merge over the seam needs a token x at a's right edge and y at b's left edge at the same time. It
        comes first if its rank is lower than that of x's own merge to the left, and not higher than that
        of y's to the right (of equal ranks the leftmost goes first).
        """
        found = True
        left = self._edge(b, 0)
        for x, x_until in self._edge(a, 1):
            for y, y_until in left:
                r = self.rank.get(x << 32 | y)
                if r is not None and r < x_until and r <= y_until:
                    found = False
        if len(self.fits) >= CACHE_SEAMS:
            self.fits.clear()
        self.fits[a << 32 | b] = found
        return found

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one piece, as the bytes of 32-bit integers."""
        data = piece.encode().decode("latin-1")
        n = len(data)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        last[0] = 0
        fits = self.fits.get
        for end, (token, length) in self.ends.iter(data):
            end += 1
            start = end - length
            if length > size[end] and last[start] >= 0:
                if start:
                    a = last[start]
                    fit = fits(a << 32 | token)
                    if fit is None:
                        fit = self.compatible(a, token)
                    if not fit:
                        continue
                last[end], size[end] = token, length
        out = []
        while n > 0:
            if last[n] < 0:
                raise ValueError("the vocabulary lacks a byte")
            out.append(last[n])
            n -= size[n]
        return array("i", out[::-1]).tobytes()

    def _piece(self, piece: str) -> bytes:
        if piece[0] == " ":
            key = piece[1:]
            return self.recent.get(key) or self._kept(key) or self._keep(key, self.encode_piece(piece))
        found = self.bare.get(piece)
        if found is None:
            found = self.encode_piece(piece)
            if len(piece) <= CACHE_LENGTH:
                if len(self.bare) >= self.times * CACHE_PIECES // 4:
                    self.bare.clear()
                self.bare[piece] = found
        return found

    def _run(self, run: str) -> bytes:
        """Ids of a run between spaces, with the space before it."""
        found = self._kept(run)
        if found is None:
            pieces = self.pieces.findall(" " + run)
            found = self._keep(run, self.encode_piece(pieces[0]) if len(pieces) == 1 else b"".join([self._piece(p) for p in pieces]))
        return found

    def _kept(self, key: str) -> bytes | None:
        found = self.older.get(key)
        return None if found is None else self._keep(key, found)

    def _keep(self, key: str, value: bytes) -> bytes:
        if len(key) <= CACHE_LENGTH:
            if len(self.recent) >= self.times * CACHE_PIECES:
                self.recent, self.older = {}, self.recent
            self.recent[key] = value
        return value

    def _ordinary(self, text: str) -> bytes:
        if not text:
            return b""
        if WIDE_SPACE.search(text):
            return b"".join([self._piece(p) for p in self.pieces.findall(text)])
        get, make = self.recent.get, self._run
        first, *runs = text.split(" ")
        return b"".join([self._piece(p) for p in self.pieces.findall(first)] + [get(r) or make(r) for r in runs])

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text; the strings of added tokens become their ids."""
        out, at = [], 0
        if self.special is not None:
            for m in self.special.finditer(text):
                out += [self._ordinary(text[at : m.start()]), array("i", [self.added[m.group()]]).tobytes()]
                at = m.end()
        out.append(self._ordinary(text[at:]))
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """Text of the ids; unknown ids give nothing, broken UTF-8 the replacement character."""
        own = np.fromiter((-1 if i is None else i for i in ids), np.int64, len(ids)) if isinstance(ids, list) else ids
        return str(_joined(self.bytes, own[(own >= 0) & (own < len(self.bytes))]), "utf-8", "replace")

    def written(self, ids: np.ndarray) -> memoryview:
        """The ids in decimal digits, joined by commas."""
        return _joined(self.digits, ids)[:-1]


def _joined(table: pa.LargeBinaryArray, at: np.ndarray) -> memoryview:
    """The table's entries at these places end to end, as Arrow lays them out."""
    _, ends, data = table.take(pa.array(at)).buffers()
    return memoryview(data)[: np.frombuffer(ends, np.int64)[len(at)]] if len(at) else memoryview(b"")


_LOADED: dict[tuple[int, int], Tokenizer] = {}


def _tokenizer(content: str, times: int = 1) -> Tokenizer:
    """The worker's tokenizer of this content; one is kept, so tasks share its cache."""
    key = hash(content), times
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Tokenizer(content, times)
        give_back()  # the parsed file is several times the tables made of it
    return _LOADED[key]


def _content(path: str) -> str:
    """The tokenizer file's text; the file is a fixed vocabulary of a few MB, read once on the driver."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Rows ``(doc_id, ids, n_tokens)``, one for each row of ``docs(doc_id, text)``.

    A null or empty text has no ids. Texts are encoded whole. Repeated rows and null ids are returned as
    they come. An empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_content(path))

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        t = _tokenizer(shared.value)
        ids = _lists([t.encode(x) for x in texts_of(rows)])
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), ids], names=["doc_id", "ids"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(own, run, "doc_id long, ids array<int>").withColumn("n_tokens", F.size("ids").cast("long"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded(doc_id, ids)`` with the column ``text``; null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(_content(path))

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        t = _tokenizer(shared.value)
        texts = [t.decode(x or []) for x in rows.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("ids"), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, ids array<int>, text string")


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, np.int32)))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Rows ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: what ``encode`` and ``decode`` give, as digests.

    Both steps run in one pass, so that the ids of a large corpus don't move only to be hashed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_content(path))

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        t = _tokenizer(shared.value, ROOMY)
        n, of_ids, of_text = [], [], []
        for text in texts_of(rows):
            ids = t.encode(text)
            n.append(len(ids))
            of_ids.append(hashlib.sha256(t.written(ids)).hexdigest())
            of_text.append(hashlib.sha256(t.decode(ids).encode()).hexdigest())
        return pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(own, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
