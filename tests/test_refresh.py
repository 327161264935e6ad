"""Incremental rebuild: only partitions with changed inputs are written anew."""
import os

import pytest
from pyspark.sql import functions as F

from vitalgrid.plans.refresh import BUCKET, Refresh, read_refreshed

EV = "subject_id long, hadm_id long, stay_id long, v double"
BUILDERS = {
    "sums": lambda cat: cat.table("ev").groupBy("subject_id").agg(F.sum("v").alias("s")),
    "stays": lambda cat: cat.table("ev").join(cat.table("dict"), F.col("v") == F.col("value")).groupBy("stay_id").agg(F.count("*").alias("n")),
    "both": lambda cat: cat.concept("sums").filter("s > 5"),
    "total": lambda cat: cat.concept("sums").agg(F.sum("s").alias("s"), F.count("*").alias("n")),
}
NEEDS = {"both": ("sums",), "total": ("sums",)}


def files(folder):
    return {os.path.relpath(os.path.join(d, f), folder): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


@pytest.fixture
def world(spark, tmp_path):
    class World:
        out = str(tmp_path / "derived")
        ev = [(s, s * 10, s * 100, float(v)) for s in range(40) for v in range(3)] + [(None, None, None, 2.0)]
        dictionary = [(1.0,), (2.0,)]

        def base(self, name):
            if name == "dict":
                return spark.createDataFrame(self.dictionary, "value double")
            df = spark.createDataFrame(self.ev, EV)
            return df if name == "ev" else df.select("subject_id", "hadm_id", "stay_id").distinct()

        def refresh(self, buckets=8):
            return Refresh(spark, self.base, self.out, buckets, BUILDERS, NEEDS).run(["sums", "stays", "both", "total"])

        def same(self):
            from vitalgrid.sources.catalog import Catalog
            cat = Catalog(spark, self.base, BUILDERS)
            for name in BUILDERS:
                got, want = read_refreshed(spark, self.out, name), BUILDERS[name](cat)
                assert sorted(map(str, map(tuple, got.select(want.columns).collect()))) == sorted(map(str, map(tuple, want.collect()))), name
    return World()


def test_only_changed_buckets_are_rebuilt(spark, world):
    assert all(c == {-1} for c in world.refresh().values())
    world.same()
    before = files(world.out)
    assert world.refresh() == {n: set() for n in BUILDERS} and {f: t for f, t in files(world.out).items() if "_manifest" not in f} == {f: t for f, t in before.items() if "_manifest" not in f}
    world.ev = [r if r[:1] != (7,) else (*r[:3], 50.0) for r in world.ev]
    changed = world.refresh()
    assert len(changed["sums"]) == 1 and changed["both"] == changed["sums"] == changed["stays"] and changed["total"] == {-1}
    world.same()
    bucket = f"{BUCKET}={next(iter(changed['sums']))}"
    after = files(world.out)
    for f, t in before.items():
        if f.startswith(("sums", "stays", "both")):
            assert (bucket in f) == (after.get(f) != t), f


def test_patients_that_come_and_go(spark, world):
    world.refresh()
    buckets = {r[BUCKET] for r in spark.read.parquet(f"{world.out}/sums").filter("subject_id in (3, 4)").select(BUCKET).collect()}
    lost = [r for r in world.ev if r[0] in (3, 4)]
    world.ev = [r for r in world.ev if r not in lost] + [(99, 990, 9900, 1.0), (None, None, None, 9.0)]
    assert buckets <= world.refresh()["sums"]
    world.same()
    world.ev = []
    world.refresh()
    world.same()
    world.ev = lost
    world.refresh()
    world.same()


def test_a_dictionary_changes_all_buckets_and_bucket_counts_are_kept(world):
    world.refresh()
    world.dictionary = [(0.0,), (2.0,)]
    changed = world.refresh()
    assert changed["stays"] == {-1} and changed["sums"] == set()
    world.same()
    with pytest.raises(ValueError):
        world.refresh(buckets=4)
