"""Tables whose readers see whole versions only.

Rows are written to folders of their own and become visible by one small file, the manifest of the next version,
which names the folders that belong to the table. Nothing that a manifest names is ever changed, so a reader
keeps what it opened, a failed or repeated write leaves the old rows in place, and a version can be read
again later under its number. Parts that a write does not touch are shared with the version before.

    root/v=<id>/season=1998/part-*.parquet      rows of one write, by part
    root/_versions/000000000012.json            what version 12 consists of

A manifest is written under another name and renamed, which fails if its number is taken; the writer then takes up the newer
manifest and tries the next number. Two writers thus never lose each other's parts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

VERSIONS = "_versions"
WRITE = "v"
ATTEMPTS = 20


class Files:
    """The few file operations a manifest needs, on whatever file system the path names."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(root).getFileSystem(self.conf)

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(path)] if self.fs.exists(path) else []

    def written(self, folder: str) -> int:
        """When the folder was last written to, in milliseconds."""
        return self.fs.getFileStatus(self._path(folder)).getModificationTime()

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a small file whole; False if one of that name is there already."""
        folder, _, name = path.rpartition("/")
        staged = self._path(f"{folder}/.{name}.{uuid.uuid4().hex}")
        stream = self.fs.create(staged, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        plain = self.jvm.java.lang.reflect.Array.newInstance(rename.NONE.getClass(), 1)
        plain[0] = rename.NONE
        try:
            context.rename(self.fs.makeQualified(staged), self.fs.makeQualified(self._path(path)), plain)
        except Exception:
            self.fs.delete(staged, False)
            if self.fs.exists(self._path(path)):
                return False
            raise
        return True

    def remove(self, folder: str) -> None:
        self.fs.delete(self._path(folder), True)


class Versions:
    """The numbered manifests under `root`: which folders each version consists of, and what its writer noted."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self.files = Files(spark, root)

    def path(self, version: int) -> str:
        return f"{self.root}/{VERSIONS}/{version:012d}.json"

    def all(self) -> list[int]:
        names = self.files.names(f"{self.root}/{VERSIONS}")
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def newest(self) -> int | None:
        """The newest version, or None before the first write."""
        known = self.all()
        return known[-1] if known else None

    def _manifest(self, version: int | None) -> dict:
        version = self.newest() if version is None else version
        return json.loads(self.files.read(self.path(version))) if version else {"parts": {}, "notes": {}}

    def parts(self, version: int | None = None) -> dict[str, list[str]]:
        """Folders of each part in a version, the newest unless one is named; version 0 is the table before any write."""
        return self._manifest(version)["parts"]

    def notes(self, version: int | None = None) -> dict:
        """What the writer of a version had to say about it."""
        return self._manifest(version)["notes"]

    def publish(self, change: Callable[[dict], dict], notes: dict | Callable[[dict], dict] | None = None) -> int:
        """Write the next manifest: the parts `change` makes of the newest ones; `notes` may build on the newest as well."""
        for _ in range(ATTEMPTS):
            last = self.newest()
            now = self._manifest(last)
            said = notes(now["notes"]) if callable(notes) else notes or {}
            text = json.dumps({"parts": change(now["parts"]), "notes": said}, sort_keys=True)
            version = (last or 0) + 1
            if self.files.create(self.path(version), text):
                return version
        raise RuntimeError(f"{ATTEMPTS} other writers published to {self.root} meanwhile")

    def restore(self, version: int) -> int:
        """Publish an older version again as the newest."""
        parts = self.parts(version)
        return self.publish(lambda old: parts, {**self.notes(version), "restored": version})


def added(old: dict[str, list[str]], staged: dict[str, list[str]]) -> dict[str, list[str]]:
    """Parts with the staged folders added to them."""
    return old | {part: [*old.get(part, []), *folders] for part, folders in staged.items()}


class PublishedTable:
    """A table under `root`, split into parts ('season=1998') by the columns `by`."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, by: Sequence[str] = ("season",)):
        self.spark, self.root, self.schema, self.by = spark, root.rstrip("/"), schema, tuple(by)
        self.versions = Versions(spark, root)
        self.files = self.versions.files

    def version(self) -> int | None:
        return self.versions.newest()

    def read(self, version: int | None = None) -> DataFrame:
        return self.open([f for folders in self.versions.parts(version).values() for f in folders])

    def open(self, folders: Sequence[str]) -> DataFrame:
        """Rows of the folders named, which versions hold as their parts."""
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        stored = StructType([*[f for f in self.schema if f.name not in self.by], StructField(WRITE, StringType()),
                             *[self.schema[name] for name in self.by]])
        rows = self.spark.read.schema(stored).option("basePath", self.root).parquet(*[f"{self.root}/{f}" for f in folders])
        return rows.select(*self.schema.fieldNames())

    def stage(self, rows: DataFrame) -> dict[str, list[str]]:
        """Write rows into a folder no manifest names yet, its own, so that writers do not meet; returns its parts."""
        write = f"{WRITE}={uuid.uuid4().hex}"
        staged = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
        if self.by:
            # Even files: small parts are merged, a large one is split.
            staged = staged.hint("rebalance", *self.by)
        staged.write.partitionBy(*self.by).parquet(f"{self.root}/{write}")
        return {part: [f"{write}/{part}".rstrip("/")] for part in self._parts_of(write)}

    def _parts_of(self, write: str) -> list[str]:
        found = [""]
        for name in self.by:
            found = [f"{part}/{child}".lstrip("/") for part in found
                     for child in self.files.names(f"{self.root}/{write}/{part}") if child.startswith(f"{name}=")]
        return found

    def replace(self, rows: DataFrame, notes: dict | None = None) -> int:
        """The table becomes `rows`; returns the new version."""
        staged = self.stage(rows)
        return self.versions.publish(lambda old: staged, notes)

    def replace_parts(self, rows: DataFrame, notes: dict | Callable[[dict], dict] | None = None) -> int:
        """Parts that `rows` holds are replaced, all others stay."""
        staged = self.stage(rows)
        return self.versions.publish(lambda old: old | staged, notes)

    def append(self, rows: DataFrame, notes: dict | None = None) -> int:
        """Rows are added to the parts they belong to."""
        staged = self.stage(rows)
        return self.versions.publish(lambda old: added(old, staged), notes)

    def compact(self, fold: Callable[[DataFrame], DataFrame], notes: dict | None = None) -> int:
        """Replace the rows of the newest version by what `fold` makes of them; rows appended meanwhile stay behind them."""
        seen = self.versions.parts()
        staged = self.stage(fold(self.open([f for folders in seen.values() for f in folders])))

        def change(old):
            later = {part: [f for f in folders if f not in seen.get(part, [])] for part, folders in old.items()}
            return added(staged, {part: folders for part, folders in later.items() if folders})

        return self.versions.publish(change, notes)

    def vacuum(self, keep: int = 2, unpublished_ms: int = 24 * 3600 * 1000, now_ms: int | None = None) -> int:
        """Forget all but the newest `keep` versions and remove folders that no kept version names.

        Folders that no version at all names may belong to a write that goes on: they are removed only when untouched
        for `unpublished_ms`. Returns how many folders went.
        """
        if keep < 1:
            raise ValueError("the newest version is always kept")
        known = self.versions.all()
        forgotten, kept = known[:-keep], known[-keep:]
        named = {folder for v in known for folders in self.versions.parts(v).values() for folder in folders}
        wanted = {folder for v in kept for folders in self.versions.parts(v).values() for folder in folders}
        for version in forgotten:
            self.files.remove(self.versions.path(version))
        now_ms = now_ms if now_ms is not None else self.spark.sparkContext._jvm.System.currentTimeMillis()
        gone = 0
        for write in self.files.names(self.root):
            if not write.startswith(f"{WRITE}="):
                continue
            folders = [f"{write}/{part}".rstrip("/") for part in self._parts_of(write)] or [write]
            if not wanted.isdisjoint(folders):
                left = [folder for folder in folders if folder not in wanted]
            elif not named.isdisjoint(folders) or self.files.written(f"{self.root}/{write}") < now_ms - unpublished_ms:
                left = [write]
            else:
                continue
            for folder in left:
                self.files.remove(f"{self.root}/{folder}")
            gone += len(left)
        return gone
