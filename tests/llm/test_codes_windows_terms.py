"""Product codes, benchmark windows and source divergence against plain restatements, with nulls, ties, long and repeated rows."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from kinetra.llm import ball_codes, divergence, wu_manber

CLASHING = "codes int, row string, part string, a long"


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """Rows of ``compress`` as (vec_id, code, error, label_error, sha), by all distances in Python's integers."""
    fine = [(i, x, g) for i, x, g in rows if x and all(c is not None and math.isfinite(c) for c in x)]
    sizes = [len(x) for _, x, _ in fine]
    size = max(sorted(set(sizes)), key=sizes.count) if sizes else 0
    fine = [r for r in fine if len(r[1]) == size]
    width = -(-size // parts)
    vectors = []
    for _, x, _ in fine:
        v = [math.floor(c * 256) if abs(c) < 2**53 else int(c) * 256 for c in x] + [0] * (width * parts - size)
        vectors.append([v[p * width : (p + 1) * width] for p in range(parts)])
    order = sorted(range(len(fine)), key=lambda j: (fine[j][0] is None, fine[j][0] or 0, fine[j][1]))[:entries]
    books = [[list(vectors[j][p]) for j in order] for p in range(parts)]
    for k in range(rounds + 1):
        near = [[min((sum((a - b) ** 2 for a, b in zip(v[p], e, strict=True)), c) for c, e in enumerate(books[p])) for p in range(parts)] for v in vectors]
        for p in range(parts) if k < rounds else ():
            for c in range(len(order)):
                own = [v[p] for v, n in zip(vectors, near, strict=True) if n[p][1] == c]
                if own:
                    books[p][c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    long = lambda x: x if x < 1 << 63 else None
    errors = [sum(d for d, _ in n) for n in near] if fine else []
    by = {}
    for (_, _, g), e in zip(fine, errors, strict=True):
        by[g] = by.get(g, 0) + e
    return sorted(((i, "".join(f"{c:02x}" for _, c in n), long(e), long(by[g]) if all(long(f) is not None for (_, _, h), f in zip(fine, errors, strict=True) if h == g) else None, sha) for (i, _, g), n, e in zip(fine, near, errors, strict=True)), key=str)


def codes_of(spark, rows, kind="float"):
    df = spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], f"vec_id long, embedding array<{kind}>, label int, {CLASHING}")
    return sorted(map(tuple, ball_codes.compress(df).collect()), key=str)


def test_codes_against_all_distances(spark):
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(size=(150, 32)), r.integers(-2, 3, (150, 32)) / 4]).astype(np.float32)
    x[40:90] = x[0]
    rows = [(int(i), v.tolist(), [0, 1, None][i % 3]) for i, v in zip(r.permutation(900)[:300], x, strict=True)]
    bad = [(1000, None, 0), (1001, [], 0), (1002, [float("nan")] * 32, 0), (1003, [float("inf")] + [0.0] * 31, 1), (1004, [None] + [0.0] * 31, 1), (1005, [1.0] * 31, 1)]
    rows += [*bad, (None, [0.5] * 32, None), rows[3], rows[3], (int(rows[3][0]), [0.25] * 32, 2)]
    assert codes_of(spark, rows) == plain_codes(rows)


def test_codes_of_few_odd_and_huge_vectors(spark):
    few = [(5, [1.0, -0.001, 3.0], 1), (3, [1.0, 2.0, 3.0], None), (9, [1.0, 2.0, 3.1], 1)]
    assert codes_of(spark, few, "double") == plain_codes(few)
    huge = [(i, [(-1.0) ** i * 10.0 ** (i * 8), 0.1 * i] * 16, i % 2) for i in range(38)] + [(90 + i, [0.1 * i] * 32, 2) for i in range(40)]
    assert codes_of(spark, huge, "double") == plain_codes(huge)
    assert codes_of(spark, []) == [] and codes_of(spark, [(1, None, None)]) == []


def test_balls_give_the_nearest_entries():
    r = np.random.default_rng(3)
    for spread in (0, 2, 40):
        book = ball_codes.Book(r.integers(-spread, spread + 1, (64, 4)))
        x, own = r.integers(-spread, spread + 1, (5000, 4)), r.integers(64, size=5000)
        code, d = book.assign(x, own)
        every = ((x[:, None] - book.entries[None]) ** 2).sum(axis=-1)
        assert (code == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_hits(docs, items, width=10):
    windows = {}
    for i, text in items:
        w = plain_words(text)
        for k in range(max(len(w) - width, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add("" if i is None else str(i))
    out = []
    for i, text in docs:
        w, hit, own = plain_words(text), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    own |= windows[tuple(w[k : k + size])]
        out.append((i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def leaks(seed, short=True):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "b", "the", "été", "x9", "Of"])
    items = [(i, " ".join(word() for _ in range(r.randint(9, 40)))) for i in range(30)]
    items += [(30, None), (31, ""), (32, "--"), (None, "no id here at all but a window of ten words"), items[0], (33, items[1][1] + " " + items[2][1])]
    items += [(40, "Single-Pair"), (41, "three short words")] if short else []
    docs = [(i, " ".join(r.choice([word, lambda: f"w{r.randrange(50)}"])() for _ in range(r.randint(0, 120)))) for i in range(60)]
    for i in range(0, 60, 4):
        own = (r.choice(items)[1] or "").upper().split()
        docs.append((100 + i, f"before, {'; '.join(own[: r.randint(5, 40)])} -- single\tpair after"))
    docs += [(None, items[0][1]), (7, None), (8, ""), (9, "!!"), docs[60], docs[60], (10, items[0][1] * 400), (11, "a" * 300_000), (12, "three short words")]
    return docs, items


@pytest.mark.parametrize("short", [True, False])
def test_windows_against_all_positions(spark, short):
    docs, items = leaks(5, short)
    more = lambda rows, names: spark.createDataFrame([(*x, 1, "q") for x in rows], f"{names}, n_words int, item string")
    d, b = more(docs, "doc_id long, text string"), more(items, "item_id long, text string")
    assert sorted(map(tuple, wu_manber.report(d, b).collect()), key=str) == plain_hits(docs, items)
    clean = wu_manber.keep_clean(d, b)
    assert clean.columns == d.columns and sorted(str(x.doc_id) for x in clean.collect()) == sorted(str(x[0]) for x in plain_hits(docs, items) if not x[5])
    # the same in many passes
    for width in (10, 3):
        one = [(x.doc_id, x.n_words, x.spans, sorted(x.items)) for x in wu_manber.find(d, b, width).collect()]
        many = [(x.doc_id, x.n_words, x.spans, sorted(x.items)) for x in wu_manber.find(d, b, width, part_words=150).collect()]
        joined = [(*x[:2], spans_of(x[2]), x[3]) for x in one]
        assert sorted(joined, key=str) == sorted([(*x[:2], spans_of(x[2]), x[3]) for x in many], key=str)
        assert width == 3 or sorted((x[0], sum(b - a + 1 for a, b in x[2])) for x in joined if x[0] is not None) == sorted((x[0], x[2]) for x in plain_hits(docs, items) if x[0] is not None)
    nothing = wu_manber.report(d, b.limit(0)).collect()
    assert len(nothing) == len(docs) and not any(x.contaminated or x.n_hit or x.n_items for x in nothing)
    assert wu_manber.report(d.limit(0), b).count() == 0


def spans_of(spans):
    return [(s["first"], s["last"]) for s in spans]


def test_pieces_of_long_items(spark, monkeypatch):
    monkeypatch.setattr(wu_manber, "PIECE_WORDS", 25)
    docs, items = leaks(9)
    items.append((77, " ".join(f"w{i % 37}" for i in range(300))))
    docs.append((500, " ".join(f"w{i % 37}" for i in range(100))))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, wu_manber.report(d, b).collect()), key=str) == plain_hits(docs, items)


def plain_audit(rows, min_docs, top):
    own = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for text, lang, source in rows]
    out = []
    for lang in {o[0] for o in own}:
        docs = [o for o in own if o[0] == lang]
        kept = sorted({t for o in docs for t in o[2] if sum(t in d[2] for d in docs) >= min_docs})
        sources = {o[1] for o in docs}
        count = {s: {t: sum(o[2].count(t) for o in docs if s in (None, o[1])) for t in kept} for s in (*sources, None)}

        def p(s, t):
            return 1 + 1_000_000_000 * (count[s][t] + 2) // (sum(count[s].values()) + 2 * len(kept))  # noqa: B023

        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = [(sum(f(p(s, t), p(o, t)) for t in kept), o) for o in sources if o != s]
            term = [(f(p(s, t), p(None, t)), t) for t in kept if count[s][t] and p(s, t) > p(None, t)]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize(("min_docs", "top"), [(10, 10), (2, 4), (1, 3), (400, 5)])
def test_audit_against_all_terms(spark, monkeypatch, min_docs, top):
    monkeypatch.setattr(divergence, "PAIRS_AT_ONCE", 7)
    r = random.Random(min_docs)
    vocabulary = ["the", "of", "Été", "z", "Zz", "ü", "\U0001d51e", "￮", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = []
    for i in range(160):
        source, lang = r.choice(["s0", "s0", "s1", "s2", "", None]), r.choice(["en", "en", "fr", None, ""])
        rows.append((" ".join(r.choices(vocabulary, [(k * len(source or "q") + i % 3) % 9 + 1 for k in range(len(vocabulary))], k=r.randint(0, 40))), lang, source))
    rows += [(None, "en", "only nulls"), ("12 34", "one", "x"), ("alone", "two", "x"), ("pair", "three", "x"), ("", "three", "y"), rows[0], rows[0]]
    rows += [("tie tie", "ties", f"t{i % 3}") for i in range(12)] + [("B a c", "ties", "t0"), ("word " * 30_000, "en", "s1")]
    df = spark.createDataFrame([(*x, "t", 1, 2) for x in rows], "text string, lang string, source string, term string, n long, rank int").repartition(3)
    got = sorted(map(tuple, divergence.audit(df, min_docs, top).collect()))
    assert got == plain_audit(rows, min_docs, top)
    assert divergence.audit(df.limit(0)).count() == 0


def test_shares_are_exact_beyond_longs(spark):
    r = random.Random(1)
    rows = [(r.randrange(10**k), 10**k + r.randrange(10**k), r.randrange(1, 10 ** min(k, 9))) for k in range(1, 18) for _ in range(20)]
    df = spark.createDataFrame(rows, "c long, n long, v long")
    got = df.select("c", "n", "v", divergence.share(df["c"], df["n"], df["v"]).alias("p")).collect()
    assert all(x.p == 1 + 1_000_000_000 * (x.c + 2) // (x.n + 2 * x.v) for x in got)


def test_held_sums_are_sent_and_merged(spark, monkeypatch):
    text = [(" ".join(f"t{chr(97 + i % 7)}{chr(97 + j % 5)}" for j in range(i % 9)), "en", f"s{i % 2}") for i in range(300)]
    df = spark.createDataFrame(text, "text string, lang string, source string")
    want = sorted(map(tuple, divergence.kept_terms(df, 3).collect()))
    for terms, sums in ((3, 10**6), (10**6, 4)):
        own = divergence._Sums()
        monkeypatch.setattr(divergence, "HELD_TERMS", terms)
        monkeypatch.setattr(divergence, "HELD_SUMS", sums)
        for t, lang, s in text:
            own.add([lang], [s], [t.encode()])
            own.full()
        assert sum(sum(b.column("n").to_pylist()) for b in own.rows()) == sum(len(t.split()) for t, _, _ in text)
    assert want
