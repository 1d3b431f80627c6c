"""The pipeline's near-copy stage against the exact similarity of all pairs."""

import random

import corpus_pipeline
import pytest

from kinetra.llm import near_copies

WIDTH = 5


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + WIDTH]) for i in range(len(w) - WIDTH + 1)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(words, changes, r):
    """``words`` with so many of them replaced, far enough apart to break five shingles each."""
    out = list(words)
    for i in r.sample(range(10, len(words) - 10, WIDTH), changes):
        out[i] = f"x{r.random()}"
    return out


def rows():
    r = random.Random(3)
    out = []
    for group in range(30):
        base = [f"w{r.randrange(5000)}" for _ in range(400)]
        # similarities of about 1, 0.97, 0.93, 0.88, 0.82, and 0.6
        out += [" ".join(edited(base, n, r)) for n in (0, 1, 3, 5, 8, 20)]
        if group % 5 == 0:
            out += [" ".join(base).upper(), " ".join(base)]
    base = [f"h{r.randrange(5000)}" for _ in range(400)]
    out += [" ".join(edited(base, r.randint(0, 6), r)) for _ in range(40)]
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate([*out, "", " \n", None, "one two", "ONE  two", "three"])]


@pytest.mark.parametrize("small", [4, 16])
def test_stage_drops_what_is_similar(spark, small):
    table = rows()
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "") if small == 16 else near_copies.keep_one(docs, small_bucket=small)
    kept = {x.doc_id for x in kept.collect()}
    near = {(a[0], b[0]) for i, a in enumerate(table) for b in table[i + 1 :] if jaccard(a[1], b[1]) >= 0.8}
    assert len(near) > 200
    assert not [p for p in near if p[0] in kept and p[1] in kept]
    # and nothing else goes: what is dropped is linked to a row of smaller id
    after = {b for _, b in near} | {a for a, _ in near}
    assert all(i in after for i, *_ in table if i not in kept)
    alone = {i for i, *_ in table} - after
    assert alone <= kept and len(alone) > 20


def components(texts):
    """The smallest place that similar texts reach from each."""
    first = list(range(len(texts)))
    near = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if jaccard(texts[i], texts[j]) >= 0.8]
    for _ in texts:
        for i, j in near:
            first[i] = first[j] = min(first[i], first[j])
    return first


@pytest.mark.parametrize("small", [2, 4])
def test_a_copy_links_what_its_first_does_not(spark, small):
    """Closest copies of a text (SimHash finds them) have copies of their own, which are under the similarity with the text itself."""
    r = random.Random(11)
    texts = []
    for _ in range(6):
        base = [f"w{r.randrange(5000)}" for _ in range(400)]
        close = [list(base) for _ in range(5)]
        for k, words in enumerate(close):
            words[15 + 5 * k] = f"c{k}"
        # eight more changes each, elsewhere
        far = []
        for words in close:
            other = list(words)
            for at in r.sample(range(60, 390, 5), 8):
                other[at] = f"f{r.random()}"
            far.append(other)
            assert jaccard(" ".join(words), " ".join(other)) >= 0.8 > jaccard(" ".join(base), " ".join(other))
        texts += [" ".join(w) for w in (base, *close, *far)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {x.doc_id for x in near_copies.keep_one(docs, small_bucket=small).collect()}
    assert kept == set(components(texts)) and len(kept) == 6


def test_blocks_leave_out_pairs_of_a_group(spark, monkeypatch):
    """Blocks look at pairs of different groups only, and a large group has blocks of its own."""
    monkeypatch.setattr(near_copies, "BLOCK_TEXTS", 16)
    texts = template(80, 5)
    near = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if jaccard(texts[i], texts[j]) >= 0.8}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for group in (lambda i: 0 if i < 40 else i, lambda i: i % 3, lambda i: 7):
        of = [group(i) for i in range(len(texts))]
        keyed = docs.selectExpr("doc_id AS first_id", "xxhash64(text) AS text_key", f"element_at(array({', '.join(f'{g}L' for g in of)}), int(doc_id + 1)) AS near")
        ids = {x.text_key: x.first_id for x in keyed.collect()}
        links = keyed.where("first_id > 0").selectExpr(f"{[k for k, i in ids.items() if i == 0][0]}L AS a", "text_key AS b")
        pairs = [(ids[p.a], ids[p.b]) for p in near_copies._block_pairs(docs, keyed, links, WIDTH, 0.8).collect()]
        assert sorted(pairs) == sorted(p for p in near if of[p[0]] != of[p[1]])


def template(n, seed):
    """Texts of one template, about 0.74 alike, and a few that are nearer to one of them."""
    r = random.Random(seed)
    base = [f"t{r.randrange(5000)}" for _ in range(400)]
    out = [edited(base, 6, r) for _ in range(n)]
    for i in range(0, n, 40):
        other = list(out[i])
        other[0] = f"y{i}"
        out.append(other)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("block", [256, 16])
def test_texts_of_a_template_in_blocks(spark, monkeypatch, block):
    """What no bucket settles: all near pairs are found, once, and nothing else is written, however many texts there are."""
    monkeypatch.setattr(near_copies, "BLOCK_TEXTS", block)
    texts = template(120, 3)
    near = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if jaccard(texts[i], texts[j]) >= 0.8}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keyed = docs.selectExpr("doc_id AS first_id", "xxhash64(text) AS text_key")
    ids = {r.text_key: r.first_id for r in keyed.collect()}
    links = keyed.where("first_id > 0").selectExpr(f"{[k for k, i in ids.items() if i == 0][0]}L AS a", "text_key AS b")
    pairs = [(ids[p.a], ids[p.b]) for p in near_copies._block_pairs(docs, keyed, links, WIDTH, 0.8).collect()]
    assert sorted(pairs) == sorted(near) and len(near) >= 3
    if block == 16:
        # the whole way, with bands so few that the template is left over
        monkeypatch.setattr(near_copies, "FINER", ((5, 20),))
        kept = {x.doc_id for x in near_copies.keep_one(docs).collect()}
        assert kept == {j for j in range(len(texts)) if not any(jaccard(texts[i], texts[j]) >= 0.8 for i in range(j))}


def test_similarity_is_exact():
    r = random.Random(5)
    for n in (0, 1, 4, 9):
        base = [f"w{r.randrange(50)}" for _ in range(200)]
        a, b = " ".join(base), " ".join(edited(base, n, r))
        assert near_copies.similarity(near_copies.shingles(a.encode()), near_copies.shingles(b.encode())) == pytest.approx(jaccard(a, b), abs=1e-12)
