import datetime as dt
import random

import pytest

from storyloom.streaming import flows, generations, registry

SCHEMA = "key long, seq long, ts timestamp, kind string, story long"


def history(n=300):
    rng = random.Random(1)
    start = dt.datetime(2024, 1, 1)
    return [(rng.randrange(3), i, start + dt.timedelta(seconds=7 * i), rng.choice(["public"] * 6 + ["drain", "failed"]), rng.randrange(20)) for i in range(n)]


def batch(rows):
    out, known = [], {}
    for key, seq, at, kind, story in sorted(rows, key=lambda r: (r[2], r[1])):
        mine = known.setdefault(key, {})
        if kind == "public":
            mine[story] = at
        elif kind == "drain":
            out += [(key, seq, s, seen) for s, seen in mine.items()]
            known[key] = {}
    return sorted(out)


@pytest.mark.parametrize("order", ["as it happened", "shuffled"])
def test_registry_is_the_same_in_any_order(spark, tmp_path, order):
    rows = history()
    some = list(rows)
    if order == "shuffled":
        random.Random(2).shuffle(some)
    end = (0, 10**6, dt.datetime(2024, 1, 2), "failed", 0)
    for i, part in enumerate([some[:100], some[100:200], some[200:], [end]]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got = flows.finished(registry.drained(stream, "2 hours"), "registry", "append", f"{tmp_path}/state")
    assert sorted((r.key, r.burst, r.story, r.seen) for r in got.collect()) == batch(rows)


def test_a_generation_is_whole_or_not_there(spark, tmp_path):
    path = str(tmp_path / "store")
    tables = {name: spark.range(n).toDF("x") for name, n in (("articles", 5), ("clusters", 3), ("members", 7))}
    assert generations.read(spark, path) == {} and generations.publish(spark, tables, path) == 1
    broken = spark.range(3).selectExpr("raise_error('third write') AS x")
    with pytest.raises(Exception, match="third write"):
        generations.publish(spark, {"articles": spark.range(50).toDF("x"), "clusters": spark.range(1).toDF("x"), "members": broken}, path)
    assert {n: t.count() for n, t in generations.read(spark, path).items()} == {"articles": 5, "clusters": 3, "members": 7}
    assert generations.publish(spark, {"articles": spark.range(8).toDF("x")}, path) == 2
    assert {n: t.count() for n, t in generations.read(spark, path).items()} == {"articles": 8}
    assert generations.read(spark, path, 1)["members"].count() == 7
