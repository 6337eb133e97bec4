import numpy as np
import pytest

spam = pytest.importorskip("quellgraph.llm.spam")
from quellgraph.llm import trees  # noqa: E402
from quellgraph.llm.page_features import NAMES, TEXTURE, features, views, weak_label  # noqa: E402

HEAD = "commit 41c9cd3c\nAuthor: x <x@y.test>\nDate: 2025\n\n    {}\n\ndiff --git a/{} b/{}\n@@ -1 +1,9 @@\n"


def commit(path, lines, subject="Update page"):
    return HEAD.format(subject, path, path) + "".join(f"+{x}\n" for x in lines)


PROSE = ["The old code walked every table twice, which made the loader hard to follow.", "We saw this in the nightly job and could not explain it until the values were printed."]


def pages(k):
    rng = np.random.default_rng(k)
    w = lambda n: " ".join(rng.choice([f"{a}{b}" for a in ("fer", "mal", "tov", "rin") for b in ("a", "o", "is", "um", "el")], n))
    yield 1, commit("docs/a.md", [f"{(x := w(2))} {w(1)} {x} cheap {x}" for _ in range(14)])
    yield 1, commit("README.md", [f'<a href="http://{w(1)}{i}.test/{i}" rel=nofollow>{w(2)}</a><br>' for i in range(14)])
    yield 1, commit("pages/x.html", [f"{w(2)} | SKU A{i}B9{i} | {i}.99 EUR | sale" for i in range(12)])
    yield 0, commit("docs/a.md", [f"- [{w(2)}](https://{w(1)}.test/{i}) explains how the {w(1)} behaves when the {w(1)} is late." for i in range(12)] + PROSE)
    yield 0, commit("tests/fixtures/shop.sql", [f"INSERT INTO product VALUES ('A{i}', '{w(2)}', {i}.99);" for i in range(12)])
    yield 0, commit("src/a.py", ["        return self.fetch.get('x', 3)", "    if a is None:"] * 6)
    yield 0, commit("docs/b.md", PROSE * 5)
    yield 0, f"commit 1\n\n    Merge branch 'x' into main\n\n    * x:\n      Rework {w(1)} {w(1)}\n      Guard {w(1)} path\n      Drop {w(2)}\n"


def test_features_edge_cases():
    assert features(None) == features("") and len(features("")) == len(NAMES) and not any(features(""))
    assert len(features("word " * 300_000)) == len(NAMES)
    assert [weak_label(features(t)) for _, t in pages(0)] == [1, 1, 1, 0, 0, 0, 0, 0]


def test_texture_edge_cases():
    assert views(None) == views("") == ([0.0] * len(TEXTURE), 0, 0.0)
    for text in ("x", "\ud800 lone", "<" * 100_000, "word " * 300_000):
        assert len(views(text)[0]) == len(TEXTURE)


def test_trees_never_saw_the_rules_features():
    """Trees on the texture of some pages, held against the truth of others."""
    rows = [(truth, views(text)) for k in range(60) for truth, text in pages(k)]
    cut = len(rows) // 2
    model = trees.fit(np.array([v[0] for _, v in rows[:cut]]), np.array([v[1] for _, v in rows[:cut]], float))
    held = trees.predict(model, np.array([v[0] for _, v in rows[cut:]])) >= 0.5
    truth = np.array([t for t, _ in rows[cut:]]) == 1
    assert (held & truth).sum() >= 0.95 * truth.sum() and (held & ~truth).sum() <= 0.05 * held.sum()


def test_trees_held_out():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 8))
    y = ((x[:, 0] > 0.6) & (x[:, 3] < 0.5)).astype(float)
    model = trees.fit(x[:2000], y[:2000], subset=8)
    assert ((trees.predict(model, x[2000:]) >= 0.5) == y[2000:]).mean() > 0.97
    assert trees.predict(trees.fit(np.zeros((0, 3)), np.zeros(0)), np.zeros((2, 3))).tolist() == [0.0, 0.0]
    assert trees.predict(trees.fit(x[:50], np.ones(50)), x[:3]).tolist() == [1.0] * 3


def test_spam_scores(spark):
    data, want = [], {}
    for k in range(40):
        for j, (label, text) in enumerate(pages(k)):
            data.append((k * 10 + j, text, f"r{k % 5}" if k % 7 else None))
            want[k * 10 + j] = label
    data += [(9000, None, "r1"), (9001, "", None), (0, data[0][1], data[0][2])]
    got = spam.spam_scores(spark.createDataFrame(data, "doc_id long, text string, repo string"))
    flags = {r["id"]: int(r["smooth"] >= 0.5) for r in got.collect()}
    assert got.count() == len(data) and all(flags[k] == v for k, v in want.items()) and flags[9000] == flags[9001] == 0
    assert spam.spam_scores(spark.createDataFrame([], "doc_id long, text string, repo string")).count() == 0


def test_smoothing_follows_the_host(spark):
    rows = [(i, "bad", 0.9) for i in range(50)] + [(100 + i, "good", 0.05) for i in range(50)] + [(1, "bad", 0.45), (2, "good", 0.45), (3, None, 0.45)]
    s = {(r["host"], round(r["score"], 2)): r["smooth"] for r in spam.smoothed(spark.createDataFrame(rows, "id long, host string, score double")).collect()}
    assert s["bad", 0.45] > s[None, 0.45] > s["good", 0.45]
