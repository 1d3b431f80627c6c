"""Extraction, chat formatting and vector search against plain references."""

import random

import numpy as np
import pandas as pd
import pytest

from kinetra.llm import chat_format, html_extract, kmeans_tree
from kinetra.llm.html_extract import main_text

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<header class=top><h2>Site</h2></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div id="cookie-notice">We use cookies, many, many.</div>
<div class="wrap"><div class="content"><h1>T &amp; t</h1><p>One, two,
 three&nbsp;are here.<p>Be <b>bo</b>ld.<ul><li>a<li>b</ul><form><p>mail, mail, mail</p></form><div class="comments"><p>Nice, very, very nice, I, think.</p></div></div>
<div class="sidebar"><p>Side, side, side.</p></div></div><footer>f &copy;</footer></body></html>"""


def test_page():
    assert main_text(PAGE).split("\n\n") == ["T & t", "One, two, three are here.", "Be bold.", "a", "b"]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""), ("just text", "just text"), ("<p>a<p>b<script>x", "a\n\nb"), ("<p>x &lt; y &#233; &unknown;</p>", "x < y é &unknown;"),
        ("<article><p>Short.</p><p><a href=x>Link</a></p></article><aside><p>Long, long, long, long text that must go.</p></aside>", "Short.\n\nLink"),
        ("<div hidden><p>no, no, no</p></div><p>yes</p>", "yes"), ("<nav>only menu</nav>", ""), ("<!-- a --><p>b<!-- c --> d</p>", "b d"), ("<p>a<br>b</p>", "a b"),
        ("<a " * 2000, "<a " * 1999 + "<a"), ("<p>" * 5000 + "deep", "deep"),
    ],
)
def test_small_pages(page, text):
    assert main_text(page) == text.strip()


def test_extract_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (None, None, None, "y"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    got = html_extract.extract(df).collect()
    assert sorted(r.n_chars for r in got) == [0, len(main_text(PAGE)), len(main_text(PAGE))]
    assert html_extract.extract(df.limit(0)).count() == 0


def plain_chats(rows):
    convs = {}
    for c, turn, role, text in set(rows):
        if c is not None:
            convs.setdefault(c, []).append((turn, role, text))
    low = lambda x: (x is not None, x if x is not None else 0)
    word = lambda x: (x is not None, x or "")
    seq = {c: [(r, (t or ""), r) for _, r, t in sorted(v, key=lambda x: (low(x[0]), word(x[1]), word(x[2])))] for c, v in convs.items()}
    key = {c: tuple(x[:2] for x in v) for c, v in seq.items()}
    out = []
    for c, k in key.items():
        longer = any(len(o) > len(k) and o[: len(k)] == k for o in key.values())
        same = [d for d, o in key.items() if o == k]
        if not longer and c == min(same):
            out.append((c, len(k), len(same), "".join(f"<|im_start|>{r if r is not None else 'unknown'}\n{t}<|im_end|>\n" for _, t, r in seq[c])))
    return sorted(out)


def test_chats_against_plain(spark):
    r = random.Random(3)
    rows = []
    for c in range(80):
        rows += [(c, t, ["user", "assistant"][t % 2], f"m{r.randrange(2)}") for t in range(r.randint(1, 6))]
    rows += [(300, 0, "", "null or empty"), (301, 0, None, "null or empty"), (301, 1, "user", "more"), (302, 0, "", "null or empty"), (302, 0, None, "null or empty")]
    rows += [(c, t, "user", "hot") for c in range(400, 480) for t in range(3)] + [(500, t, "user", f"turn {t}") for t in range(500)] + [(501, t, "user", f"turn {t}") for t in range(400)]
    rows += [(200, 0, None, None), (201, None, "user", "x"), (201, 1, "user", "x"), (202, 1, "user", "b"), (202, 1, "user", "a"), (202, 1, "user", "a"), (None, 0, "user", "z")]
    df = spark.createDataFrame([(*x, 5) for x in rows], "conv_id long, turn long, role string, text string, at int")
    got = sorted((x.conv_id, x.n_turns, x.n_same, x.text) for x in chat_format.format_chats(df).collect())
    assert got == plain_chats(rows)
    plan = chat_format.format_chats(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert chat_format.format_chats(df.limit(0)).count() == 0


def vectors(seed, n, d=16):
    r = np.random.default_rng(seed)
    return (r.normal(size=(20, d))[r.integers(20, size=n)] * 3 + r.normal(size=(n, d))).astype(np.float32)


def test_search_recall_and_ties(spark):
    x = vectors(1, 3000)
    x[500:900] = x[500]
    rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(x)]
    bad = [(100_000, None, 0), (100_100, [0.0] * 16, 0), (100_200, [float("nan")] * 16, 0), (100_300, [1.0] * 15, 0), (100_400, [None] + [1.0] * 15, 0), (None, [1.0] * 16, 0), rows[7]]
    df = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<float>, score int")
    got = {}
    for r in kmeans_tree.search(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 3000, 100))
    y, hits = x.astype(np.float64), 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and len({f[1] for f in found}) == 10
        d = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
        assert [f[2] for f in found] == pytest.approx([d[f[1]] for f in found])
        assert [(f[2], f[1]) for f in found] == sorted((f[2], f[1]) for f in found)
        d[q] = np.inf
        hits += len({f[1] for f in found} & set(np.lexsort((np.arange(len(d)), d))[:10].tolist()))
    assert hits / (10 * len(got)) >= 0.9


def recall(x, rows):
    y, found = x.astype(np.float64), {}
    for r in rows:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q, own in found.items():
        d = ((y - y[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(own & set(np.lexsort((np.arange(len(d)), d))[:10].tolist()))
    return hits / (10 * len(found))


def test_tree_alone_answers(spark):
    x = vectors(5, 50_000)
    x[::3] = x[0]  # a third of all rows are copies of one vector
    x[1::3] = vectors(6, len(x[1::3]))
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<float>")
    calibrated = recall(x, kmeans_tree.search(df, fit_rows=1000).collect())
    one = recall(x, kmeans_tree.search(df, fit_rows=1000, visits=1).collect())
    assert calibrated >= 0.9 > 0.75 > one


def test_tree_grows_to_small_leaves(spark):
    x = vectors(7, 6000).astype(np.float64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    tree, placed = kmeans_tree.grow(df, df, 8, 32, fit_rows=500)
    sizes = [r["count"] for r in placed.groupBy("leaf").count().collect()]
    assert sum(sizes) == 6000 and max(sizes) <= 64 and len(sizes) > 6000 / 64 and tree.n_leaves >= len(sizes)
    assert {(r.vec_id, r.leaf) for r in placed.collect()} == set(enumerate(tree.assign(x).tolist()))
    order = list(next(tree.walks(x[:1])))
    assert order[0] == tree.assign(x[:1])[0] and sorted(order) == list(range(tree.n_leaves))


def test_search_small_tables(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in kmeans_tree.search(df).orderBy("rank").collect()]
    assert [(q, k, v) for q, k, v, _ in got] == [(0, i, i) for i in range(1, 5)]
    assert kmeans_tree.search(df.limit(0)).count() == 0
    assert kmeans_tree.search(df.where("vec_id = 0")).count() == 0
