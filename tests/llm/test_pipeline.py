"""The corpus pipeline stage by stage, each against what a plain look at its input says, and as a chain."""

import random
import re

import pytest

import corpus_pipeline
from kinetra.llm import mixing
from kinetra.llm.near_copies import shingles, similarity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PARTS = {"en": "th er on re ing and ed is at".split(), "fr": "eau oi é ç ou le que ment tion".split()}


def text_of(r, lang, n):
    return " ".join("".join(r.choice(PARTS[lang]) for _ in range(3)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    out = [(i, text_of(r, ["en", "fr"][i % 2], r.randint(30, 90)), ["en", "fr"][i % 2], f"s{i % 3}") for i in range(80)]
    for i in range(0, 20, 2):
        words = out[i][1].split()
        words[3] = "changed"
        out.append((100 + i, " ".join(words), out[i][2], "s0"))
    out += [(200 + i, out[5][1], "fr", "s1") for i in range(30)]
    secret = "".join(r.choice("0123456789abcdef") for _ in range(40))
    out += [(300 + i, text_of(r, "en", 40) + f" password = {secret}{i:02d} end", "en", None) for i in range(12)]
    out += [(400, None, "en", "s0"), (401, "", "en", "s0"), (402, "12 34 !!", None, "s0"), (None, text_of(r, "en", 50), None, "s2"), out[0]]
    return [(*x, len(x[1]) if x[1] is not None else None) for x in out]


def test_stages_in_their_order(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, SCHEMA)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        # other columns, with names that the stages use themselves, change nothing
        more = docs.selectExpr("*", "1 AS text_key", "2 AS mix_uses", "3 AS gone_id", "4 AS row")
        stage(spark, more, "").write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        globals()[f"check_{name}"](docs.collect(), out.collect())
        docs = out
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == list(corpus_pipeline.DOCUMENT_COLUMNS)


def check_language_id(before, after):
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert gone == {400, 401, 402} and len(after) == len(before) - 3


def check_simhash_dedup(before, after):
    kept = [shingles(r.text.encode()) for r in after if r.doc_id is not None]
    ids = [r.doc_id for r in after if r.doc_id is not None]
    assert not [(a, b) for a in range(len(kept)) for b in range(a) if ids[a] != ids[b] and similarity(kept[a], kept[b]) >= 0.8]
    # what went is a copy of a document of smaller id, and nothing else went
    texts = {r.doc_id: shingles(r.text.encode()) for r in before if r.doc_id is not None}
    for i in set(texts) - set(ids):
        assert any(j < i and similarity(texts[i], texts[j]) >= 0.8 for j in texts)
    assert any(r.doc_id is None for r in after) and set(range(0, 20, 2)) <= set(ids) and 5 in ids


def check_secret_scan(before, after):
    assert sorted(str(r.doc_id) for r in before) == sorted(str(r.doc_id) for r in after)
    assert not [r for r in after if re.search(r"password = ", r.text)] and sum("[SECRET]" in r.text for r in after) >= 12
    assert all(r.n_chars == len(r.text) for r in after)
    was = {r.doc_id: r.text for r in before}
    assert sum(r.text == was[r.doc_id] for r in after) >= len(after) - 20


def check_source_mix(before, after):
    words, taken, order = {}, {}, lambda s: (s is None, s or "")
    for r in before:
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    for r in after:
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sorted(words, key=order))}
    # no source is above three times its size here, so all are shared by weight
    level = sum(words.values()) / sum(weights.values())
    if all(level * weights[s] <= 3 * words[s] for s in words):
        assert all(abs(taken.get(s, 0) - level * weights[s]) <= 100 for s in words)
    uses = {}
    for r in after:
        uses[r.doc_id, r.text] = uses.get((r.doc_id, r.text), 0) + 1
    copies = {}
    for r in before:
        copies[r.doc_id, r.text] = copies.get((r.doc_id, r.text), 0) + 1
    assert set(uses) <= set(copies) and all(n <= 3 * copies[k] for k, n in uses.items())


def check_bpe_encode(before, after):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((str(r.doc_id), tuple(own.encode(r.text, add_special_tokens=False).ids)) for r in before)
    assert sorted((str(r.doc_id), tuple(r.ids)) for r in after) == want


def test_stages_take_empty_and_null_tables(spark):
    for rows in ([], [(None, None, None, None, None)] * 3):
        docs = spark.createDataFrame(rows, SCHEMA)
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, "").count()
            assert got == (0 if name == "language_id" or not rows else got)


def test_run_is_the_chain(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = spark.createDataFrame(rows, SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert sorted(map(str, got)) == sorted(map(str, docs.collect()))
