import numpy as np
import pytest

leakage = pytest.importorskip("quellgraph.llm.leakage")


def test_embedding_of_equal_and_near_windows():
    rng = np.random.default_rng(0)
    a = rng.integers(1, 1000, (300, 12))
    far = rng.integers(1, 1000, (300, 12))
    ham = lambda x, y: (leakage.embed(leakage.padded(x, 13), 3) != leakage.embed(leakage.padded(y, 13), 3)).mean()
    near = [ham(a, leakage.edited(a, 1, 1000, rng, kind)) for kind in leakage.KINDS]
    assert ham(a, a.copy()) == 0 and max(near) < 0.55 < 0.65 < ham(a, far)
    assert (leakage.keys(a, 1, 8) == leakage.keys(a.copy(), 1, 8)).all()


def test_edit_distance():
    d = lambda x, y: leakage.edit_distance(np.array([x]), np.array([y]))[0]
    assert d([1, 2, 3], [1, 2, 3]) == 0 and d([1, 2, 3], [1, 9, 3]) == 1 and d([1, 2, 3], [2, 3, 4]) == 2 and d([1, 2], [3, 4]) == 2


def brute(docs, items, w):
    win = {}
    for i, t in items:
        x = leakage.words(t or "")
        for k in range(len(x) - w + 1):
            win.setdefault(tuple(x[k : k + w]), set()).add(i)
    return {(d, i) for d, t in docs for x in [leakage.words(t or "")] for k in range(len(x) - w + 1) for i in win.get(tuple(x[k : k + w]), ())}


def test_leaks(spark):
    rng = np.random.default_rng(2)
    vocab = [f"w{i}" for i in range(300)]
    items = [(f"i{k}", " ".join(rng.choice(vocab, 30))) for k in range(20)] + [("same", None), ("short", "only four words here")]
    items.append(("again", items[0][1]))
    docs = []
    for k in range(60):
        x = items[k % 20][1].split()
        cut = x[k % 10 : k % 10 + 8 + k % 14]
        docs.append((k, " ".join(rng.choice(vocab, 5)) + "\n+ // " + "\n+  ".join(cut).upper() + " | tail"))
    docs += [(100, None), (101, ""), (102, "long " * 200_000), (0, docs[0][1]), (103, items[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id string, item_text string")
    got = leakage.leaked_windows(df, it, window=12)
    exact = {(r["doc_id"], r["item_id"]) for r in got.where("edits = 0").collect()}
    assert exact == brute(docs, items, 12) and len(exact) > 20
    blocks = leakage.leaked_windows(df, it, window=12, block_words=40)
    assert {(r["doc_id"], r["item_id"]) for r in blocks.where("edits = 0").collect()} == exact
    assert leakage.leaks(got).where("doc_id = 103 and item_id = 'i3'").first()["exact_windows"] == 19
    assert leakage.leaked_windows(df.limit(0), it).count() == 0 and leakage.leaked_windows(df, it.limit(0)).count() == 0


@pytest.mark.parametrize("kind", leakage.KINDS)
def test_recall_of_near_windows(spark, kind):
    """Passages with one word replaced, put in or left out, against all of them."""
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(2000)]
    items = [(f"i{k}", " ".join(rng.choice(vocab, 12))) for k in range(400)]
    docs = []
    for k, (_, t) in enumerate(items):
        x = t.split()
        at = int(rng.integers(1, 11))
        x[at : at + (kind != "put in")] = [] if kind == "left out" else ["changed"]
        docs.append((k, " ".join(["before", *x, "after"])))
    got = leakage.leaked_windows(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, item_text string"), max_edits=1)
    hit = got.where("edits = 1 and item_id = concat('i', doc_id)")
    assert hit.select("doc_id").distinct().count() >= 0.9 * 400 and got.where("edits = 0").count() == 0


def test_recall_that_is_not_reached():
    items = tuple((f"i{k}", " ".join(f"w{k}x{i}" for i in range(12))) for k in range(50))
    with pytest.raises(ValueError, match="recall"):
        leakage.build_index(items, 12, 3, 0.99, 16, most=2)
