"""Tables kept under a digest of what they were made from, each published by one manifest that is moved into place.

    root/data/<name>/<digest>-<attempt>/    Parquet, written first
    root/manifest/<name>/<digest>.json      which of these folders counts; absent until the data are complete

A job that dies between the two leaves a folder that no manifest names: readers never see it and `sweep` removes it.
Two jobs that make the same table at once both succeed; the manifest names either of the equal results.
The folder has to be one that the driver and all executors share.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rows_digest(df: DataFrame) -> str:
    """Digest of all rows and columns whatever their order: the row count and sums of four 24-bit slices of each row's md5."""
    row = F.md5(F.to_json(F.struct(*[F.col(f"`{x}`") for x in sorted(df.columns)]), {"ignoreNullFields": "false"}))
    part = lambda at: F.sum(F.conv(F.substring(row, at, 6), 16, 10).cast("long"))
    seen = df.agg(F.count(F.lit(1)), *[part(1 + 6 * i) for i in range(4)]).first()
    return "-".join(format(v or 0, "x") for v in seen)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- files, through the cluster's file system -----------------------------------------------------------------

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _list(self, *parts: str) -> list:
        fs, path = self._fs(), self._path(*parts)
        return list(fs.listStatus(path)) if fs.exists(path) else []

    def _manifest(self, name: str, digest: str) -> dict | None:
        fs, path = self._fs(), self._path("manifest", name, f"{digest}.json")
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, name: str, digest: str, folder: str) -> None:
        """Write the manifest beside its place and move it there: readers see all of it or nothing."""
        fs, draft = self._fs(), self._path("manifest", name, f".{digest}-{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        try:
            out.writeBytes(json.dumps({"digest": digest, "folder": folder, "written": time.time()}))
        finally:
            out.close()
        place = self._path("manifest", name, f"{digest}.json")
        if not fs.rename(draft, place):
            if self.find(name, digest) is None:  # the place is held by a manifest whose data are gone
                fs.delete(place, False)
                if fs.rename(draft, place):
                    return
            fs.delete(draft, False)
            if self.find(name, digest) is None:
                raise OSError(f"could not publish {name}/{digest} in {self.root}")

    # --- tables ---------------------------------------------------------------------------------------------------

    def _read(self, name: str, manifest: dict) -> DataFrame | None:
        if not self._fs().exists(self._path("data", name, manifest["folder"])):
            return None
        return self.spark.read.parquet(f"{self.root}/data/{name}/{manifest['folder']}")

    def find(self, name: str, digest: str) -> DataFrame | None:
        """The published table, or None; a manifest whose data are gone counts as none."""
        manifest = self._manifest(name, digest)
        return None if manifest is None else self._read(name, manifest)

    def put(self, name: str, digest: str, rows: DataFrame) -> DataFrame:
        folder = f"{digest}-{uuid.uuid4().hex[:12]}"
        rows.write.parquet(f"{self.root}/data/{name}/{folder}")
        self._publish(name, digest, folder)
        return self.find(name, digest)

    def cached(self, name: str, digest: str, compute: Callable[[], DataFrame]) -> DataFrame:
        """The table of this digest, made only where it is not there yet."""
        found = self.find(name, digest)
        return self.put(name, digest, compute()) if found is None else found

    def manifests(self, name: str) -> list[dict]:
        """Published manifests of a name, oldest first: one small file for each version kept."""
        files = [f.getPath().getName() for f in self._list("manifest", name)]
        found = [self._manifest(name, f.removesuffix(".json")) for f in files if f.endswith(".json") and not f.startswith(".")]
        return sorted((m for m in found if m is not None), key=lambda m: (m["written"], m["digest"]))

    def latest(self, name: str) -> DataFrame | None:
        """The newest published table of a name whose data are there, or None."""
        for manifest in reversed(self.manifests(name)):
            table = self._read(name, manifest)
            if table is not None:
                return table
        return None

    def sweep(self, name: str, grace: float = 86_400.0) -> list[str]:
        """Remove folders and drafts that no manifest names and that are older than `grace` seconds; returns their names.

        The grace keeps what a running job has written and not yet published.
        """
        named = {m["folder"] for m in self.manifests(name)}
        before, gone = (time.time() - grace) * 1000, []
        stale = [f for f in self._list("data", name) if f.getPath().getName() not in named]
        stale += [f for f in self._list("manifest", name) if f.getPath().getName().startswith(".")]
        for file in stale:
            if file.getModificationTime() <= before and self._fs().delete(file.getPath(), True):
                gone.append(file.getPath().getName())
        return sorted(gone)
