"""Running sums over slices of equal volume and the quantile sketch behind them."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafledger import quantiles as Q
from leafledger.session import prefix_scan

WORDS = [None, "", "a", "a\0", "a\0b", "a\x01", "ab", "b", "é", "\U0001f600", "zz"]


def expected(rows, group, exclusive):
    """Running sums by a loop; rows are (vault, client, path, n, x)."""
    out = {}
    for own in {group(r) for r in rows}:
        total = 0
        for r in sorted((r for r in rows if group(r) == own), key=lambda r: (r[2].encode(), r[3])):
            out[r[3]] = total if exclusive else total + r[4]
            total += r[4]
    return out


@pytest.mark.parametrize("exclusive,slice_bytes", [(False, 1_500), (True, 1_500), (False, 1 << 30)])
def test_one_key_holds_nine_tenths_of_the_bytes(spark, exclusive, slice_bytes):
    rng = random.Random(slice_bytes)
    rows = []
    for n in range(3_000):
        hot = n % 10 > 0
        path = rng.choice("abcé\0") * rng.randint(1, 60 if hot else 3)
        rows.append(("hot" if hot else rng.choice(["k1", "k2", None]), rng.choice(["c1", "c2", None]), path, n, rng.randint(-5, 9)))
    df = spark.createDataFrame(rows, "vault string, client string, path string, n long, x int").repartition(9)
    out = prefix_scan(
        df, ["vault"], ["path", "n"], {"s": F.col("x"), "c": F.col("x")}, exclusive=exclusive, finer={"c": ["client"]}, slice_bytes=slice_bytes
    ).collect()
    assert len(out) == len(rows)
    assert {r.n: r.s for r in out} == expected(rows, lambda r: r[0], exclusive)
    assert {r.n: r.c for r in out} == expected(rows, lambda r: r[:2], exclusive)


def test_a_hot_key_is_cut_by_volume(spark):
    """The slices of one key have about equal bytes, although a tenth of its rows holds most of them."""
    rows = [("hot", i, "x" * (2_000 if i < 200 else 20)) for i in range(2_000)]
    df = spark.createDataFrame(rows, "k string, i long, text string").repartition(16)
    key = Q.sort_key([(F.col("k"), T.StringType()), (F.col("i"), T.LongType())])
    weighed = df.select(key.alias("key"), Q.row_bytes(df).alias("weight"))
    cuts = Q.cut_points(weighed, 10, points=64, fan_in=4)
    volumes = weighed.groupBy(Q.slice_of(F.col("key"), cuts).alias("s")).agg(F.sum("weight").alias("w")).collect()
    total = sum(r.w for r in volumes)
    assert len(volumes) == 10 and max(r.w for r in volumes) < 1.6 * total / 10


def test_empty_rows_and_one_slice(spark):
    empty = spark.createDataFrame([], "k string, i long")
    assert prefix_scan(empty, ["k"], ["i"], {"s": F.lit(1)}, slice_bytes=1).count() == 0
    assert Q.cut_points(spark.createDataFrame([], "key binary, weight long"), 5) == []


def test_sort_keys_sort_as_columns_do(spark):
    numbers = [None, -(1 << 63), -5, -1, 0, 1, 7, (1 << 63) - 1]
    rows = list(itertools.product(WORDS, numbers))
    df = spark.createDataFrame(rows, "s string, n long")
    keyed = df.withColumn("key", Q.sort_key([(F.col("s"), T.StringType()), (F.col("n"), T.LongType())]))
    by_key = [tuple(r) for r in keyed.orderBy("key").select("s", "n").collect()]
    assert by_key == [tuple(r) for r in df.orderBy("s", "n").collect()]
    with pytest.raises(TypeError):
        Q.sort_key([(F.lit(1.0), T.DoubleType())])


def test_merged_summaries_keep_weight_and_order():
    rng = random.Random(5)
    found = ([], np.zeros(0, np.int64))
    everything = []
    for _ in range(40):
        part = sorted((rng.randbytes(3), rng.randint(1, 50)) for _ in range(500))
        everything += part
        found = Q.merge(found, Q.compress([k for k, _ in part], np.array([w for _, w in part]), 100), 100)
    everything.sort()
    keys, sums = [k for k, _ in everything], np.cumsum([w for _, w in everything])
    assert found[0] == sorted(found[0]) and int(found[1].sum()) == sums[-1] and len(found[0]) <= 101
    reached = np.cumsum(found[1])
    for key, mine in zip(found[0], reached):
        true = sums[np.searchsorted(np.array(keys, dtype=object), key, side="right") - 1]
        assert abs(int(true) - int(mine)) < 0.5 * sums[-1] / 10
