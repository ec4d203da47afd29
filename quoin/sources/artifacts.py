"""Sets of tables that are replaced together: versioned folders, a manifest for each version, compare-and-swap.

    <root>/data/<revision>/<name>/*.parquet     what one commit wrote; never changed afterwards
    <root>/manifests/<version>.json             the set of that version: names, folders, rows, and who wrote it

A version exists from the moment its manifest has its name, which one rename gives it and which no second commit can
take.  Before that, nothing points at the new folders, so a commit that dies anywhere leaves the old set whole; readers
take the highest manifest, so they see one set or the next and never a mixture.  Rolling back is a commit that points
at an older set.  All paths are Hadoop paths: the root may lie in any store that every executor reaches.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another commit took the version that this one was to be."""


class Missing(ValueError):
    """A set lacks tables that it must have."""


class ArtifactStore:
    """Sets under `root`; every set holds at least the tables `required`."""

    def __init__(self, spark: SparkSession, root: str, required: tuple[str, ...] = ()):
        self.spark, self.root, self.required = spark, root.rstrip("/"), required
        self.hadoop, self.conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
        self.files = self._path("").getFileSystem(self.conf)
        #: Called with a step's name before it is taken; tests stop a commit there.
        self.before: Callable[[str], None] = lambda step: None

    def _path(self, name: str):
        return self.hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def versions(self) -> list[int]:
        """All versions, oldest first; 0 is the empty set before the first commit and has no manifest."""
        folder = self._path("manifests")
        if not self.files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.files.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self) -> int:
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, the newest by default."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "revision": None, "artifacts": {}, "writers": {}}
        stream = self.files.open(self._path(f"manifests/{version:020d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        held = self.manifest(version)["artifacts"]
        if name not in held:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.root}/{held[name]['path']}")

    def commit(self, artifacts: dict[str, DataFrame], expected: int | None = None, keep: bool = False, writer: tuple[str, int] | None = None) -> int:
        """Publish these tables as the next version, and return it.

        expected: the version that the tables were made from; if another has come since, nothing is published and
        Conflict is raised.  keep: tables of the set before that are not given stay in the set.  writer: (name, batch) of
        a stream; a batch that its writer has published already is passed over, so a repeated batch changes nothing.
        """
        before = self.manifest()
        if writer is not None and before["writers"].get(writer[0], -1) >= writer[1]:
            return before["version"]
        if expected is not None and expected != before["version"]:
            raise Conflict(f"made from version {expected}, but the set is at {before['version']}")
        held = dict(before["artifacts"]) if keep else {}
        lacking = sorted(set(self.required) - set(artifacts) - set(held))
        if lacking:
            raise Missing(f"required tables are missing: {', '.join(lacking)}")
        revision = uuid.uuid4().hex
        try:
            for name in sorted(artifacts):
                path = f"data/{revision}/{name}"
                self.before(f"write {name}")
                artifacts[name].write.parquet(f"{self.root}/{path}")
                held[name] = {"path": path, "rows": self.spark.read.parquet(f"{self.root}/{path}").count()}
            writers = before["writers"] | ({writer[0]: writer[1]} if writer is not None else {})
            version = before["version"] + 1
            self._publish({"version": version, "revision": revision, "artifacts": held, "writers": writers})
        except BaseException:
            self._discard(revision)
            raise
        return version

    def roll_back(self, version: int) -> int:
        """Publish an older set again, as the next version."""
        old, now = self.manifest(version), self.manifest()
        self._publish(now | {"version": now["version"] + 1, "revision": old["revision"], "artifacts": old["artifacts"]})
        return now["version"] + 1

    def _publish(self, manifest: dict) -> None:
        """Give the manifest its name, unless a manifest has it."""
        target = self._path(f"manifests/{manifest['version']:020d}.json")
        beside = self._path(f"manifests/.{uuid.uuid4().hex}.tmp")
        self.before("write manifest")
        out = self.files.create(beside)
        try:
            out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            out.close()
        try:
            self.before("publish")
            # A context's rename refuses a name that exists; a plain file system's may replace it.
            context = self.hadoop.FileContext.getFileContext(target.toUri(), self.conf)
            context.rename(beside, target, self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"version {manifest['version']} was taken by another commit") from e
            raise
        finally:
            self.files.delete(beside, False)

    def _discard(self, revision: str) -> None:
        """Remove what a failed commit wrote, unless its manifest got its name before it failed."""
        if not any(self.manifest(v)["revision"] == revision for v in self.versions()[-2:]):
            self.files.delete(self._path(f"data/{revision}"), True)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove manifests but the newest `keep`, then folders that none of those points at; returns the folders.

        Readers of older versions and running commits must be over.
        """
        kept = self.versions()[-keep:]
        for v in set(self.versions()) - set(kept):
            self.files.delete(self._path(f"manifests/{v:020d}.json"), False)
        used = {a["path"].split("/")[1] for v in kept for a in self.manifest(v)["artifacts"].values()}
        folder = self._path("data")
        found = [s.getPath().getName() for s in self.files.listStatus(folder)] if self.files.exists(folder) else []
        gone = sorted(set(found) - used)
        for name in gone:
            self.files.delete(self._path(f"data/{name}"), True)
        return gone


def publish_batches(store: ArtifactStore, writer: str, tables: Callable[[DataFrame], dict[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: publishes tables(batch) with what the set holds, each batch once."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        store.commit(tables(batch), keep=True, writer=(writer, batch_id))

    return publish


def promote(store: ArtifactStore, staging: str, optional: tuple[str, ...] = (), expected: int | None = None) -> int:
    """Publish what a worker left under `staging`, one Parquet folder a table, as the next version.

    Every required table must be there, the optional ones may.  Paths in string columns that lie at or under `staging`
    are rewritten to the store's root; all tables are checked before anything is published.
    """
    from pyspark.sql import functions as F

    from quoin.sources.plans import rebase

    staging = staging.rstrip("/")
    there = [n for n in (*store.required, *optional) if store.files.exists(store.hadoop.Path(f"{staging}/{n}"))]
    lacking = sorted(set(store.required) - set(there))
    if lacking:
        raise Missing(f"the worker left out: {', '.join(lacking)}")
    tables = {}
    for name in there:
        rows = store.spark.read.parquet(f"{staging}/{name}")
        tables[name] = rows.select(*[rebase(F.col(f"`{c}`"), staging, store.root).alias(c) if kind == "string" else F.col(f"`{c}`") for c, kind in rows.dtypes])
    return store.commit(tables, expected=expected)
