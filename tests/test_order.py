import random

import pytest
from pyspark.sql import functions as F

from dossierflow.operators.order import Ordered


@pytest.mark.parametrize("seed", range(2))
def test_ranges_equal_windows(spark, seed):
    rng = random.Random(seed)
    groups = ["hot"] * 6 + ["a", "b", None]
    rows = [(rng.choice(groups), rng.choice([None, *range(40)]), i, rng.choice([None, None, f"v{i}"])) for i in range(400)]
    df = spark.createDataFrame(rows, "g STRING, t INT, id INT, v STRING")
    plain, ranged = (Ordered(df, ["g"], ["t", "id"], window_bytes=n) for n in (1 << 200, 0))
    assert ranged.ranged and not plain.ranged
    assert ranged.df.where("g = 'hot'").select("_range").distinct().count() > 1
    for ask in (lambda o: o.number("n"), lambda o: o.last("v", "before"), lambda o: o.following("id", "v")):
        a, b = ask(plain), ask(ranged)
        assert a.columns == b.columns and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_empty(spark):
    df = spark.createDataFrame([], "g STRING, t INT")
    assert Ordered(df, ["g"], ["t"], window_bytes=-1).number("n").withColumn("x", F.lit(1)).collect() == []
