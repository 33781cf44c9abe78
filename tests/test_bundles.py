"""Bundles: what readers see, what failures leave behind, and what is inferred from it."""

import json
import os

import pytest
from pyspark.sql import functions as F

from foliant.sources import bundles
from foliant.sources.bundles import State


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "out" / "bundle")


@pytest.fixture(scope="module")
def tables(spark):
    return {"a": spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "i int, s string"), "b": spark.range(5).toDF("n")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_versions_follow_one_another(spark, root, tables):
    first = bundles.publish(tables, root)
    assert rows(bundles.read(spark, root)["a"]) == rows(tables["a"])
    with pytest.raises(bundles.BundleConflict):
        bundles.publish(tables, root)
    second = bundles.publish({"a": tables["a"].limit(1), "b": tables["b"].limit(0)}, root, overwrite=True)
    back = bundles.read(spark, root)
    assert back["a"].count() == 1 and back["b"].count() == 0 and back["b"].columns == ["n"]
    assert (bundles.state_of(spark, root, first), bundles.state_of(spark, root, second), bundles.state_of(spark, root, "none")) == (State.SUPERSEDED, State.PUBLISHED, State.ROLLED_BACK)
    assert bundles.recover(spark, root) == {first: State.SUPERSEDED, second: State.PUBLISHED} and not os.path.exists(f"{root}/lease")


def test_a_failed_table_leaves_nothing(spark, root, tables):
    broken = spark.range(3).select(F.raise_error(F.lit("no")).cast("int").alias("x"))
    with pytest.raises(Exception, match="no"):
        bundles.publish({"a": tables["a"], "c": broken}, root)
    assert os.listdir(f"{root}/versions") == [] and not os.path.exists(f"{root}/lease")
    bundles.publish(tables, root)


def test_a_lease_keeps_others_away(spark, root, tables):
    bundles.Store(spark, root).create("lease", "someone")
    with pytest.raises(bundles.BundleBusy, match="someone"):
        bundles.publish(tables, root)
    with pytest.raises(bundles.BundleBusy):
        bundles.recover(spark, root)
    assert not bundles.end_lease(spark, root, "another") and bundles.end_lease(spark, root, "someone")
    bundles.publish(tables, root)


@pytest.mark.parametrize("wrote, state", [("nothing", State.ROLLED_BACK), ("a part", State.UNKNOWN), ("all", State.PUBLISHED)])
def test_a_failed_commit_is_told_by_what_lies_there(spark, root, tables, monkeypatch, wrote, state):
    """The commit raises after it has written nothing, a part, or all of its file."""
    create = bundles.Store.create

    def fails(self, name, text):
        if not name.startswith("commits/"):
            return create(self, name, text)
        if wrote != "nothing":
            create(self, name, text if wrote == "all" else text[:7])
        raise OSError("connection lost")

    monkeypatch.setattr(bundles.Store, "create", fails)
    with pytest.raises(bundles.BundleFailure) as e:
        bundles.publish(tables, root)
    monkeypatch.undo()
    assert e.value.state is (State.STAGED if state is State.ROLLED_BACK else state) and bundles.state_of(spark, root, e.value.token) is state
    assert not os.path.exists(f"{root}/lease")
    if state is State.UNKNOWN:  # left as it is, and nobody reads or writes until someone has looked
        with pytest.raises(bundles.BundleConflict):
            bundles.read(spark, root)
        with pytest.raises(bundles.BundleConflict):
            bundles.publish(tables, root, overwrite=True)
        assert os.path.isdir(f"{root}/versions/{e.value.token}")
    elif state is State.PUBLISHED:
        assert rows(bundles.read(spark, root)["b"]) == rows(tables["b"])


def test_a_writer_that_died_while_staging_is_rolled_back(spark, root, tables):
    token = bundles.publish(tables, root)
    tables["a"].write.parquet(f"{root}/versions/dead/a")
    assert bundles.state_of(spark, root, "dead") is State.STAGED
    assert bundles.recover(spark, root) == {token: State.PUBLISHED, "dead": State.ROLLED_BACK} and not os.path.exists(f"{root}/versions/dead")


def test_changed_data_and_manifests_are_found(spark, root, tables):
    token = bundles.publish(tables, root)
    spark.createDataFrame([(9, "y")], "i int, s string").write.mode("append").parquet(f"{root}/versions/{token}/a")
    with pytest.raises(ValueError, match="a is not what was committed"):
        bundles.read(spark, root)
    path = f"{root}/versions/{token}/manifest.json"
    with open(path) as f:
        told = json.load(f)
    os.remove(path)
    with open(path, "w") as f:
        json.dump(told | {"c": told["a"]}, f)
    if os.path.exists(crc := f"{root}/versions/{token}/.manifest.json.crc"):
        os.remove(crc)
    with pytest.raises(ValueError, match="manifest"):
        bundles.read(spark, root)
    assert bundles.state_of(spark, root, token) is State.UNKNOWN


def test_two_writers_without_a_lease_cannot_both_commit(spark, root, tables, monkeypatch):
    """Even if a lease was ended too early: the number of a commit is taken once."""
    publish, create = bundles.publish, bundles.Store.create

    def races(self, name, text):
        if name.startswith("commits/") and not self.exists("commits"):
            monkeypatch.setattr(bundles.Store, "create", create)
            self.delete("lease")
            publish(tables, root)
        return create(self, name, text)

    monkeypatch.setattr(bundles.Store, "create", races)
    with pytest.raises(bundles.BundleConflict, match="meanwhile"):
        bundles.publish({"a": tables["a"]}, root)
    assert set(bundles.read(spark, root)) == {"a", "b"} and len(os.listdir(f"{root}/versions")) == 1
