"""Several tables published as one, in stores without an atomic rename of folders.

Under a bundle's root lie versions/<token>/<table> with a manifest that is written last, and commits/<number>, small files that
each name a version.  The newest commit is what readers see; making that one file is the whole of publishing, so nothing that
is already published is ever touched.  A lease keeps two writers apart; it is never taken away by itself, as a writer that
seems dead may still write.  After a failure, what lies there tells what became of a version (State)."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass
from enum import Enum

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from foliant.sources.sinks import fingerprint


class State(Enum):
    PUBLISHED = "published"  # the newest commit names it, and its manifest is whole
    SUPERSEDED = "superseded"  # an older commit does
    STAGED = "staged"  # no commit does: it was never published, and may go
    ROLLED_BACK = "rolled_back"  # there is nothing of it
    UNKNOWN = "unknown"  # a commit cannot be read, or names a version whose manifest is not the one it was made for


class BundleBusy(RuntimeError):
    """Another writer holds the lease."""


class BundleConflict(RuntimeError):
    """The bundle is there already, or was published anew meanwhile."""


class BundleFailure(RuntimeError):
    """A version could not be published as planned; `state` tells what became of it, `token` which it is."""

    def __init__(self, root: str, token: str, state: State, cause: BaseException):
        self.root, self.token, self.state = root, token, state
        super().__init__(f"{root}: version {token} is {state.value}: {cause}")


class Store:
    """Files of a bundle, through whatever file system its root is on."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def __call__(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self(name)))

    def names(self, name: str) -> list[str]:
        if not self.exists(name):
            return []
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._path(self(name))))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(self(name)))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Makes a file that is not there yet; false if it is."""
        try:
            stream = self._fs.create(self._path(self(name)), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self(name)), True)


@dataclass(frozen=True)
class Commit:
    number: int
    token: str
    manifest: str  # its digest


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _commits(store: Store) -> tuple[list[Commit], bool]:
    """All commits that can be read, oldest first, and whether there are others."""
    found, broken = [], False
    for name in store.names("commits"):
        if name.startswith("."):
            continue
        try:
            told = json.loads(store.read(f"commits/{name}"))
            found.append(Commit(int(name), told["token"], told["manifest"]))
        except (ValueError, KeyError, TypeError):
            broken = True
    return found, broken


def state_of(spark: SparkSession, root: str, token: str) -> State:
    """What became of a version, by what lies under the root."""
    store = Store(spark, root)
    commits, broken = _commits(store)
    named = [c for c in commits if c.token == token]
    if named:
        manifest = f"versions/{token}/manifest.json"
        if not store.exists(manifest) or _digest(store.read(manifest)) != named[-1].manifest:
            return State.UNKNOWN
        return State.PUBLISHED if named[-1] == commits[-1] and not broken else State.UNKNOWN if broken else State.SUPERSEDED
    if not store.exists(f"versions/{token}"):
        return State.ROLLED_BACK
    return State.UNKNOWN if broken else State.STAGED


def publish(tables: dict[str, DataFrame], root: str, overwrite: bool = False) -> str:
    """Writes the tables as a new version, reads it back and compares, and commits it; returns its token.

    Without `overwrite` a bundle that has been published is left alone (BundleConflict).  If anything fails before the commit,
    what was written goes and the failure is raised as it is; if it fails in the commit, BundleFailure tells the state, and a
    version whose state is unknown is left for whoever looks at it.  The tables have to give the same rows each time."""
    spark = next(iter(tables.values())).sparkSession
    store, token = Store(spark, root), uuid.uuid4().hex
    if not store.create("lease", token):
        raise BundleBusy(f"{root} is leased to {store.read('lease')}; end_lease() ends a lease whose writer is known to be dead")
    try:
        before, broken = _commits(store)
        if broken or (before and not overwrite):
            raise BundleConflict(f"{root} has a commit that cannot be read" if broken else f"{root} is published already")
        try:
            manifest = {}
            for name, df in tables.items():
                path = store(f"versions/{token}/{name}")
                df.write.parquet(path)
                back = spark.read.schema(df.schema).parquet(path)
                manifest[name] = {"schema": df.schema.json(), "fingerprint": fingerprint(back)}
                if manifest[name]["fingerprint"] != fingerprint(df):
                    raise ValueError(f"what was written of {name} differs")
            told = json.dumps(manifest, sort_keys=True)
            store.create(f"versions/{token}/manifest.json", told)
        except BaseException:
            store.delete(f"versions/{token}")
            raise
        number = before[-1].number + 1 if before else 0
        try:
            made = store.create(f"commits/{number:020d}", json.dumps({"token": token, "manifest": _digest(told)}))
        except BaseException as e:
            state = state_of(spark, root, token)
            if state is State.STAGED:
                store.delete(f"versions/{token}")
            raise BundleFailure(root, token, state, e) from e
        if not made:
            store.delete(f"versions/{token}")
            raise BundleConflict(f"{root} was published anew meanwhile")
    finally:
        end_lease(spark, root, token)
    return token


def end_lease(spark: SparkSession, root: str, token: str) -> bool:
    """Ends the lease if it is this one's."""
    store = Store(spark, root)
    if not store.exists("lease") or store.read("lease") != token:
        return False
    store.delete("lease")
    return True


def read(spark: SparkSession, root: str, verify: bool = True) -> dict[str, DataFrame]:
    """The tables of the newest version, held against the fingerprints that they were committed with."""
    store = Store(spark, root)
    commits, broken = _commits(store)
    if broken or not commits:
        raise BundleConflict(f"{root} has a commit that cannot be read" if broken else f"{root} is not published")
    last = commits[-1]
    told = store.read(f"versions/{last.token}/manifest.json")
    if _digest(told) != last.manifest:
        raise ValueError(f"the manifest of {last.token} is not what was committed")
    from pyspark.sql.types import StructType

    tables = {}
    for name, entry in json.loads(told).items():
        tables[name] = spark.read.schema(StructType.fromJson(json.loads(entry["schema"]))).parquet(store(f"versions/{last.token}/{name}"))
        if verify and fingerprint(tables[name]) != entry["fingerprint"]:
            raise ValueError(f"{name} is not what was committed")
    return tables


def recover(spark: SparkSession, root: str) -> dict[str, State]:
    """The state of every version; those that were never published go.  Not while a lease is held."""
    store = Store(spark, root)
    if store.exists("lease"):
        raise BundleBusy(f"{root} is leased to {store.read('lease')}")
    states = {token: state_of(spark, root, token) for token in store.names("versions")}
    for token, state in states.items():
        if state is State.STAGED:
            store.delete(f"versions/{token}")
            states[token] = State.ROLLED_BACK
    return states
