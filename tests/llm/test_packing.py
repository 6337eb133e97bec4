import numpy as np
import pytest
from pyspark.sql import functions as F

packing = pytest.importorskip("quellgraph.llm.packing")


def naive(sizes, capacity):
    """The rule read literally: try every level, keep the smallest sum of squares, the fullest among equals."""
    counts, out = {}, []
    for s in sizes:
        best = None
        for level in [0, *sorted(k for k, n in counts.items() if n)]:
            if level + s <= capacity:
                after = dict(counts)
                if level:
                    after[level] -= 1
                if level + s < capacity:
                    after[level + s] = after.get(level + s, 0) + 1
                cost = sum(n * n for n in after.values())
                if best is None or cost <= best[0]:
                    best = (cost, level, after)
        counts = best[2]
        out.append(best[1])
    return out


def test_sum_of_squares_rule():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 21, 400)
    k, at = packing.sum_of_squares(sizes, 20)
    assert at.tolist() == naive(sizes.tolist(), 20)
    fill = np.bincount(k, weights=sizes)
    assert fill.max() <= 20 and len(fill) == k.max() + 1


@pytest.mark.parametrize("shard", [10_000, 60])
def test_pack_is_whole(spark, shard):
    rng = np.random.default_rng(1)
    data = [(i, int(x)) for i, x in enumerate(rng.integers(0, 40, 600))] + [(900, 100), (901, 250), (901, 250), (902, 0), (903, 32), (904, 64)]
    got = packing.pack(spark.createDataFrame(data, "id long, n_tokens long"), 32, shard_items=shard).toPandas()
    assert got.groupby("id")["n_tokens"].sum().to_dict() == {k: sum(n for i, n in data if i == k) for k, _ in data}
    real = got[got["n_tokens"] > 0].sort_values(["container_id", "offset"])
    for _, part in real.groupby("container_id"):
        ends = (part["offset"] + part["n_tokens"]).tolist()
        assert ends[-1] <= 32 and part["offset"].tolist() == [0, *ends[:-1]]
    lone = got[got["id"] < 900]
    assert lone[lone["id"].isin([i for i, n in data if n <= 32])].groupby("id").size().max() == 1
    assert got[got["id"] == 902]["container_id"].isna().all()
    assert real["container_id"].nunique() <= 1.06 * sum(n for _, n in data) / 32 + 4


@pytest.mark.parametrize(("size", "least"), [(700, 1000), (600, 667), (500, 500), (1000, 1000), (1024, 1000)])
def test_sizes_that_do_not_add_up(size, least):
    sizes = np.full(2000, size)
    k, at = packing.pack_shard(sizes, 2048)
    fill = np.bincount(k, weights=sizes)
    assert (fill > 0).sum() <= 1.01 * least + 1 and fill.max() <= 2048
    for c in range(len(fill)):
        assert sorted(at[k == c].tolist()) == list(range(0, int(fill[c]), size))


def test_pack_follows_from_ids_and_sizes(spark):
    df = spark.range(3000).select("id", (F.pmod(F.xxhash64("id"), F.lit(60)) + 1).alias("n_tokens"))
    a, b = (sorted(map(tuple, packing.pack(d, 64, shard_items=700).collect())) for d in (df.repartition(7), df.orderBy(F.desc("id")).coalesce(1)))
    assert a == b


def test_pack_empty(spark):
    assert packing.pack(spark.createDataFrame([], "id long, n_tokens long")).count() == 0


def test_token_counts(spark):
    text = "Hello  world\n\n\tünïcode 123 " * 500
    got = {r["id"]: r["n_tokens"] for r in packing.token_counts(spark.createDataFrame([(1, text), (2, ""), (3, None), (3, "a")], "doc_id long, text string")).collect()}
    assert got[1] == len(packing.encoding(packing.TOKENIZER, packing.PATTERN).encode_ordinary(text)) and got[2] == 0
