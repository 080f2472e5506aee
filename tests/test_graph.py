import random

from tessaline.operators.graph import connected_components


def brute(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(parent)}


def test_random_graphs(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(200, k) for k in range(201, 260)] + [(300, 300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs + pairs[:5], "src long, dst long")).collect()}
    assert got == brute(pairs)


def test_nulls_strings_and_empty(spark):
    df = spark.createDataFrame([("b", "a"), (None, "a"), ("c", "c")], "src string, dst string")
    assert sorted(map(tuple, connected_components(df).collect())) == [("a", "a"), ("b", "a"), ("c", "c")]
    assert connected_components(df.limit(0)).count() == 0


def test_intermediate_tables(spark):
    from tessaline import storage

    df = storage.materialise(spark.range(5), "x")
    assert df.count() == 5 and df.inputFiles()[0].startswith("file:")
    storage.clear(spark)
    assert spark.read.schema("id long").option("ignoreMissingFiles", True).parquet(storage.shared_dir(spark)).count() == 0


def test_settled_deletes_what_led_to_it(spark):
    from pathlib import Path

    from tessaline import storage

    def make():
        inner = storage.settled(lambda: storage.materialise(spark.range(3), "innermost"), "inner")
        return storage.bucketed(storage.materialise(spark.range(5), "first"), "id", 2, "second").join(inner, "id")

    outer = storage.materialise(spark.range(9), "outer")
    df = storage.settled(make, "third")
    left = [p.name for p in Path(storage.own_dir(spark).removeprefix("file:")).iterdir()]
    assert not [x for x in left if x.startswith(("innermost-", "inner-", "first-", "second_"))]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("second_")]
    assert sorted(r.id for r in df.collect()) == [0, 1, 2] and outer.count() == 9
