"""Secret scan: fixed patterns, and a character convolutional network over every candidate.

A candidate is a run of 16 or more token characters, or of 8 or more after a colon, an equals sign or a quote. Those that lie
within a base span are found already; all others, those that a base span covers in part included, are judged. The network sees the characters of the candidate and
of its surroundings, one window for each stretch of a long candidate. It is written in numpy and trained on
labelled findings: candidates that the fixed patterns report against those that they do not, plus copies of
the findings in other alphabets and foreign surroundings, so that the body counts and not only the word
before it, and of the rest in capitals and as plain numbers. On findings held out from training its scores are calibrated (Platt) and the threshold is the
highest that still finds ``min_recall`` of them.

Scale: the network learns from every different window of the table. The windows are dealt by hash into shards
of about ``SHARD``; in each round every shard trains on from the same weights, and the means of the shards' weights
begin the next round. Scores of all windows held out are counted on a fixed grid for calibration and threshold. The
driver gets a row for each weight and each place of the grid. Weights are broadcast. Scanning is one pass without a
shuffle; a text is scanned whole.
"""

from __future__ import annotations

import bisect
import itertools
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.llm.common import batch, map_batches, materialize, scratch, texts_of

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
LEAST_RUN, LEAST_SHORT = 16, 8
RUN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST_RUN},}}")
#: A shorter run, where an assignment or an opening quote stands before it.
SHORT = re.compile(rf"""(?:[:=]\x20*["']?|["'])([A-Za-z0-9+/_.=-]{{{LEAST_SHORT},{LEAST_RUN - 1}}})(?![A-Za-z0-9+/_.=-])""")

LEFT, BODY, RIGHT = 24, 48, 8
WINDOW = LEFT + BODY + RIGHT
#: Symbols: 0 padding, printable ASCII, 96 anything else.
SYMBOLS = 97
WIDTH, EMBED, FILTERS = 5, 8, 24

Span = tuple[str, int, int]


def runs(text: str) -> list[tuple[int, int]]:
    """Candidates: maximal runs of at least ``LEAST_RUN`` token characters, and ``SHORT`` ones, by start."""
    long = [m.span() for m in RUN.finditer(text)] if max(map(len, text.split()), default=0) >= LEAST_RUN else []
    short = [m.span(1) for m in SHORT.finditer(text)]
    if long and short:
        # the end of a long run after an equals sign is a part of it
        starts = [a for a, _ in long]
        short = [s for s in short if not (k := bisect.bisect_right(starts, s[0])) or long[k - 1][1] < s[1]]
    return sorted(long + short)


def base_spans(text: str, candidates: list[tuple[int, int]]) -> list[Span]:
    """Matches of the fixed patterns, leftmost and non-overlapping within a kind, by start and kind.

    Access keys and hex digits are token characters and longer than ``LEAST_RUN``, so they are looked for
    in the candidates only.
    """
    out: list[Span] = []
    if "=" in text or ":" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        for a, b in candidates:
            if b - a >= LEAST[kind]:
                out += [(kind, *m.span()) for m in pattern.finditer(text, a, b) if m.end() - m.start() >= LEAST[kind]]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def windows(text: str, start: int, end: int) -> list[str]:
    """The candidate in stretches of ``BODY`` characters, each with its surroundings, padded with NUL."""
    return [
        text[max(0, i - LEFT) : i].rjust(LEFT, "\0")
        + text[i : min(end, i + BODY)].ljust(BODY, "\0")
        + text[min(end, i + BODY) : min(end, i + BODY) + RIGHT].ljust(RIGHT, "\0")
        for i in range(start, end, BODY)
    ]


def symbols(rows: list[str]) -> np.ndarray:
    code = np.frombuffer("".join(rows).encode("utf-32-le"), dtype=np.uint32).reshape(len(rows), WINDOW)
    return np.where(code == 0, 0, np.where((code >= 32) & (code < 127), code - 31, SYMBOLS - 1)).astype(np.int64)


class Reach:
    """How far the spans reach that begin up to a place: tells in a look-up what a span holds or meets."""

    def __init__(self, spans: list[Span]) -> None:
        ordered = sorted((s, e) for _, s, e in spans)
        self.starts = [s for s, _ in ordered]
        self.ends = list(itertools.accumulate((e for _, e in ordered), max))

    def _until(self, n: int) -> int:
        return self.ends[n - 1] if n else -1

    def holds(self, a: int, b: int) -> bool:
        return self._until(bisect.bisect_right(self.starts, a)) >= b

    def meets(self, a: int, b: int) -> bool:
        return self._until(bisect.bisect_left(self.starts, b)) > a


@dataclass
class Network:
    """Embedding, one convolution, maximum over places, one logistic unit; Platt scale and threshold."""

    embed: np.ndarray
    kernel: np.ndarray
    shift: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    scale: float = 1.0
    offset: float = 0.0
    threshold: float = 2.0

    @classmethod
    def fresh(cls, seed: int) -> Network:
        r = np.random.default_rng(seed)
        depth = WIDTH * (EMBED + 1)
        return cls(
            r.normal(0, 0.3, (SYMBOLS, EMBED)), r.normal(0, depth**-0.5, (depth, FILTERS)), np.zeros(FILTERS),
            r.normal(0, FILTERS**-0.5, FILTERS), np.zeros(1),
        )

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        inside = np.zeros((WINDOW, 1))
        inside[LEFT : LEFT + BODY] = 1
        e = np.concatenate([self.embed[x], np.broadcast_to(inside, (len(x), WINDOW, 1))], axis=2)
        places = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1).transpose(0, 1, 3, 2)
        flat = places.reshape(len(x), WINDOW - WIDTH + 1, -1)
        z = flat @ self.kernel + self.shift
        top = z.argmax(axis=1)
        pooled = np.maximum(np.take_along_axis(z, top[:, None, :], axis=1)[:, 0], 0)
        return pooled @ self.weight + self.bias[0], (flat, top, pooled)

    def logits(self, x: np.ndarray) -> np.ndarray:
        # a window takes some 60 kB on its way
        parts = [self._forward(x[i : i + 128])[0] for i in range(0, len(x), 128)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.offset, -50, 50)))

    def _gradients(self, x: np.ndarray, y: np.ndarray, share: np.ndarray | float = 1.0) -> list[np.ndarray]:
        out, (flat, top, pooled) = self._forward(x)
        d = share * (1 / (1 + np.exp(-np.clip(out, -50, 50))) - y) / len(y)
        into = d[:, None] * self.weight * (pooled > 0)
        n = np.arange(len(x))[:, None]
        seen = flat[n, top]
        of_kernel = np.einsum("nf,nfd->df", into, seen)
        back = (into[:, :, None] * self.kernel.T[None]).reshape(len(x), FILTERS, WIDTH, EMBED + 1)[..., :EMBED]
        of_embed = np.zeros_like(self.embed)
        np.add.at(of_embed, x[n[..., None], top[..., None] + np.arange(WIDTH)], back)
        return [of_embed, of_kernel, into.sum(axis=0), pooled.T @ d, np.array([d.sum()])]

    def own(self) -> list[np.ndarray]:
        return [self.embed, self.kernel, self.shift, self.weight, self.bias]

    def flat(self) -> np.ndarray:
        """All weights in one row."""
        return np.concatenate([p.ravel() for p in self.own()])

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        net, at = cls.fresh(0), 0
        for p in net.own():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        return net

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int, seed: int, rate: float = 5e-3) -> None:
        """Adam over batches of 128; either class has the same weight in all, however many windows it has."""
        r = np.random.default_rng(seed)
        own = self.own()
        share = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        m, v = [np.zeros_like(p) for p in own], [np.zeros_like(p) for p in own]
        t = 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), 128):
                t += 1
                pick = order[i : i + 128]
                for k, g in enumerate(self._gradients(x[pick], y[pick], share[pick])):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    own[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, hits: np.ndarray, others: np.ndarray, min_recall: float) -> None:
        """Platt's scale and offset by gradient descent, then the highest threshold with ``min_recall``.

        ``hits`` and ``others`` count the logits that lie at or above each place of ``GRID``.
        """
        up, down = (hits.sum() + 1) / (hits.sum() + 2), 1 / (others.sum() + 2)
        # Platt's targets keep a separable sample from infinite slopes
        s, n = np.concatenate([GRID, GRID]), np.concatenate([hits, others]) / (hits.sum() + others.sum())
        goal = np.repeat([up, down], len(GRID))
        s, n, goal = s[n > 0], n[n > 0], goal[n > 0]
        a, b = 1.0, 0.0
        for _ in range(500):
            d = n * (1 / (1 + np.exp(-np.clip(a * s + b, -50, 50))) - goal)
            a -= 0.05 * float((d * s).sum())
            b -= 0.05 * float(d.sum())
        self.scale, self.offset = max(a, 1e-3), b
        missed = int(np.floor((1 - min_recall) * hits.sum()))
        least = GRID[np.searchsorted(np.cumsum(hits), missed, "right")]
        self.threshold = float(1 / (1 + np.exp(-np.clip(self.scale * least + self.offset, -50, 50))))


#: Places at which logits are counted for calibration.
STEPS = 256
GRID = np.arange(-64 * STEPS, 64 * STEPS) / STEPS


def on_grid(logits: np.ndarray) -> np.ndarray:
    """The number of the last place of the grid that is not above each logit."""
    return np.clip(np.floor(logits * STEPS) + 64 * STEPS, 0, len(GRID) - 1).astype(np.int64)


def _labelled(text: str) -> list[tuple[int, str]]:
    found = runs(text)
    spans = Reach(base_spans(text, found))
    out = []
    for a, b in found:
        hit = spans.meets(a, b)
        out += [(int(hit), w) for w in windows(text, a, b)]
    return out


def _varied(hits: list[str], others: list[str], seed: int) -> list[str]:
    """Findings again in other alphabets and in foreign surroundings."""
    r = np.random.default_rng(seed)
    kinds = ["0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"]
    out = []
    for w in hits:
        body = w[LEFT : LEFT + BODY]
        letters = kinds[r.integers(len(kinds))]
        if r.random() < 0.7:
            body = "".join(letters[k] if c.isalnum() else c for c, k in zip(body, r.integers(len(letters), size=BODY), strict=True))
        around = others[r.integers(len(others))] if others else w
        out.append(around[:LEFT] + body + around[LEFT + BODY :])
    return out


VARIANTS = 1000
CAPITALS = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _harmless(others: list[str], seed: int) -> list[str]:
    """Other candidates again in capitals, and with digits for the letters of their bodies."""
    r = np.random.default_rng(seed)
    digits = lambda body: "".join("0123456789"[k] if c.isalnum() else c for c, k in zip(body, r.integers(10, size=BODY), strict=True))
    return [w.translate(CAPITALS) for w in others] + [w[:LEFT] + digits(w[LEFT : LEFT + BODY]) + w[LEFT + BODY :] for w in others]


#: Windows that are trained on together, and those of either class that each shard has at least (or all).
SHARD, LEAST_OF_CLASS = 4096, 256
#: One window of so many is held out, by hash.
HELD_OUT = 5
#: Weights are summed as integers of this unit, so that the order of sums doesn't matter.
UNIT = 2.0**-40


def _part(hits: list[str], others: list[str], held: bool, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows to train on, or those held out, with their variants. A class that has none on this side gives all."""
    split = lambda rows: [w for w in rows if (zlib.crc32(w.encode()) % HELD_OUT == 0) == held] or rows
    h, o = split(sorted(hits)), split(sorted(others))
    if not h or not o:  # as good as impossible, see LEAST_OF_CLASS
        return symbols(h + o), np.array([1.0] * len(h) + [0.0] * len(o))
    # few findings get more variants, so that either class has about VARIANTS windows
    times = lambda rows: range(max(1, -(-VARIANTS // len(rows))))
    h, o = h + [w for k in times(h) for w in _varied(h, o, seed + k)], o + [w for k in times(o) for w in _harmless(o, seed + k)]
    return symbols(h + o), np.array([1.0] * len(h) + [0.0] * len(o))


def _sharded(found: DataFrame, hits: int, others: int) -> tuple[DataFrame, int]:
    """``(shard, hits, others)``, a row for each shard, and their number; a rare class is dealt to several shards each."""
    n = -(-(hits + others) // SHARD)
    copies = {k: min(n, -(-LEAST_OF_CLASS * n // size)) for k, size in ((1, hits), (0, others))}
    times = F.sequence(F.lit(0), F.when(F.col("hit") == 1, copies[1] - 1).otherwise(copies[0] - 1))
    dealt = found.select("hit", "w", F.explode(times).alias("k")).select("hit", "w", ((F.pmod(F.xxhash64("w"), F.lit(n)) + F.col("k")) % n).alias("shard"))
    side = lambda k, name: F.collect_list(F.when(F.col("hit") == k, F.col("w"))).alias(name)
    rows = dealt.repartition(n, "shard").groupBy("shard").agg(side(1, "hits"), side(0, "others"))
    return materialize(rows, "shards"), n


def _round(shards: DataFrame, start: np.ndarray, epochs: int, seed: int) -> np.ndarray:
    """The mean of the weights to which the shards come from ``start``; no epochs stand for as many as make 300 steps, 6 at least."""
    shared = shards.sparkSession.sparkContext.broadcast(start)

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        at, w = [], []
        for h, o in zip(rows.column("hits").to_pylist(), rows.column("others").to_pylist(), strict=True):
            x, y = _part(h, o, False, seed)
            net = Network.of(shared.value)
            net.train(x, y, epochs or max(6, -(-300 * 128 // len(y))), seed)
            own = np.rint(net.flat() / UNIT).astype(np.int64)
            at.append(np.arange(len(own)))
            w.append(own)
        none = [np.zeros(0, np.int64)]
        return batch(at=(np.concatenate(at or none), pa.int64()), w=(np.concatenate(w or none), pa.int64()))

    # a row for each weight
    found = map_batches(shards, run, "at long, w long").groupBy("at").agg((F.sum("w") / F.count("*")).alias("w")).collect()
    out = np.zeros(len(start))
    for at, w in found:
        out[at] = w * UNIT
    return out


def _counted(shards: DataFrame, weights: np.ndarray, seed: int) -> list[np.ndarray]:
    """How many windows held out have their logits at each place of the grid: findings, and the others."""
    shared = shards.sparkSession.sparkContext.broadcast(weights)

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        net, out = Network.of(shared.value), []
        for h, o in zip(rows.column("hits").to_pylist(), rows.column("others").to_pylist(), strict=True):
            x, y = _part(h, o, True, seed)
            out.append(on_grid(net.logits(x)) * 2 + y.astype(np.int64))
        places, n = np.unique(np.concatenate(out or [np.zeros(0, np.int64)]), return_counts=True)
        return batch(place=(places, pa.int64()), n=(n, pa.int64()))

    sums = np.zeros((len(GRID), 2), dtype=np.int64)
    for place, n in map_batches(shards, run, "place long, n long").groupBy("place").agg(F.sum("n")).collect():
        sums[place // 2, place % 2] = n
    return [sums[:, 1], sums[:, 0]]


def fit(docs: DataFrame, min_recall: float = 0.99, rounds: int = 6, seed: int = 7) -> Network | None:
    """A calibrated network, trained on all different windows of ``docs(text)``; None if a class has none: there is nothing to learn.

    Windows of one shard are trained on in one round; more shards take ``rounds`` of one epoch each.
    """

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        found = [x for t in texts_of(rows) for x in _labelled(t)]
        return batch(hit=([h for h, _ in found], pa.int32()), w=([w for _, w in found], pa.string()))

    with scratch(docs.sparkSession):
        # different ones, so that copies don't outweigh the rest
        found = materialize(map_batches(docs.select("text"), run, "hit int, w string").distinct(), "windows")
        sizes = {r["hit"]: r["count"] for r in found.groupBy("hit").count().collect()}
        if len(sizes) < 2:
            return None
        shards, n = _sharded(found, sizes[1], sizes[0])
        weights = Network.fresh(seed).flat()
        for k in range(rounds if n > 1 else 1):
            weights = _round(shards, weights, int(n > 1), seed + 1000 * k)
        net = Network.of(weights)
        net.calibrate(*_counted(shards, weights, seed), min_recall)
    return net


def scan(text: str, net: Network | None) -> list[Span]:
    """All spans of one text: those of the fixed patterns and the network's, by start and kind."""
    return scan_all([text], net)[0]


def scan_all(texts: list[str], net: Network | None) -> list[list[Span]]:
    out, todo, rows = [], [], []
    for k, text in enumerate(texts):
        found = runs(text)
        spans = base_spans(text, found)
        out.append(spans)
        base = Reach(spans)
        for a, b in found if net is not None else ():
            # a candidate that lies within a base span is found already
            if not base.holds(a, b):
                own = windows(text, a, b)
                todo += [(k, a, b)] * len(own)
                rows += own
    if rows:
        likely = np.concatenate([net.probabilities(symbols(rows[i : i + 4096])) for i in range(0, len(rows), 4096)])
        chosen: dict[int, set[Span]] = {}
        for (k, a, b), p in zip(todo, likely, strict=True):
            if p >= net.threshold:
                chosen.setdefault(k, set()).add(("model", a, b))
        for k, own in chosen.items():
            out[k] = sorted([*out[k], *own], key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return out


def find_secrets(docs: DataFrame, net: Network | None) -> DataFrame:
    """Rows ``(doc_id, spans)``, one for each row of ``docs(doc_id, text)``; spans are ``(kind, start, end)`` in code points.

    A null text has no spans. Spans of different kinds may overlap; the network adds none that lies
    within a base span. Repeated rows and null ids are returned as they come. An empty table gives no rows; other
    columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        found = scan_all(texts_of(rows), shared.value)
        spans = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in found], kind)
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), spans], names=["doc_id", "spans"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(own, run, "doc_id long, spans array<struct<kind: string, start: bigint, end: bigint>>")


def redact(docs: DataFrame, net: Network | None, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of the text replaced by ``mask`` and ``n_chars`` counted anew; all rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at, size = docs.columns.index("text"), docs.columns.index("n_chars")
    schema = docs.schema
    kind = pa.int64()

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = rows.column(at).to_pylist()
        changed, sizes = [], []
        for text, spans, n in zip(texts, scan_all([t or "" for t in texts], shared.value), rows.column(size).to_pylist(), strict=True):
            if spans:
                text, n = masked(text, spans, mask), None
            changed.append(text)
            sizes.append(len(text) if n is None and text is not None else n)
        own = list(rows.columns)
        own[at], own[size] = pa.array(changed, pa.string()), pa.array(sizes, kind)
        return pa.RecordBatch.from_arrays(own, names=rows.schema.names)

    return map_batches(docs, run, schema)


def masked(text: str, spans: list[Span], mask: str) -> str:
    """The text with each stretch of overlapping spans replaced by one mask."""
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def digests(docs: DataFrame, net: Network | None) -> DataFrame:
    """``find_secrets`` as counts and span lists: ``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)``."""
    found = find_secrets(docs, net)
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = joined(F.filter("spans", lambda s: s["kind"] != "model"))
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def fit_and_scan(docs: DataFrame) -> DataFrame:
    """``digests`` with a network fitted to the same table."""
    return digests(docs, fit(docs))
