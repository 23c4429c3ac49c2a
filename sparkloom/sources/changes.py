"""Changes of a folder as a stream: what was made, changed and removed, each version of a file at most once.

    spark.dataSource.register(FolderChanges)
    spark.readStream.format("folder_changes").option("state", "/shared/state").load("/workspace")

A listing of paths with times and sizes is an offset: listings are numbered and kept in the folder `state` until the batch that
needs them is committed, so a stream that starts again goes on from the last one and reports what changed while it was down. Two
listings and their difference are names and numbers only; contents are read by the tasks. A file whose version is no longer the
listed one has no content in that batch, as its next version comes in the next. The folder and `state` must be seen by the driver and
executors alike.

Options: state (needed for streams), excludes (parts of paths, comma-separated), suffixes (of paths to take), newer_only (true: a
version is one only if its time is later than the last one's), files_per_task.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Parts of paths that give noise.
EXCLUDES = (".next/dev", "node_modules", ".git", "target", "dist", "build", ".cache", "__pycache__", ".venv", "venv", "vendor")
SCHEMA = "path string, kind string, modified long, size long, content binary"


@dataclass
class Files(InputPartition):
    """Files of a task: path, kind, time in ns, size."""

    rows: list[tuple[str, str, int, int]]


class _Folder:
    def __init__(self, options: dict):
        self.root = options["path"].removeprefix("file://").rstrip("/")
        self.excludes = tuple(x for x in options["excludes"].split(",") if x) if "excludes" in options else EXCLUDES
        self.suffixes = tuple(x for x in options.get("suffixes", "").split(",") if x)
        self.newer_only = options.get("newer_only", "false").lower() == "true"
        self.per_task = int(options.get("files_per_task", "1000"))

    def listing(self) -> dict[str, tuple[int, int]]:
        """Path under the root: time of change in ns, size."""
        out, folders = {}, [""]
        while folders:
            folder = folders.pop()
            try:
                entries = list(os.scandir(os.path.join(self.root, folder)))
            except FileNotFoundError:
                continue
            for e in entries:
                path = f"{folder}/{e.name}" if folder else e.name
                if any(x in path for x in self.excludes):
                    continue
                try:
                    if e.is_dir(follow_symlinks=False):
                        folders.append(path)
                    elif e.is_file(follow_symlinks=False) and (not self.suffixes or path.endswith(self.suffixes)):
                        s = e.stat(follow_symlinks=False)
                        out[path] = (s.st_mtime_ns, s.st_size)
                except FileNotFoundError:
                    pass  # gone since it was listed
        return out

    def merged(self, old: dict, new: dict) -> dict:
        """new, but with old versions where a file's time isn't later and only later ones count."""
        return {p: old[p] if self.newer_only and p in old and v[0] <= old[p][0] else v for p, v in new.items()}

    def difference(self, old: dict, new: dict) -> list[tuple[str, str, int, int]]:
        made = [(p, "created" if p not in old else "modified", *v) for p, v in sorted(new.items()) if tuple(old.get(p, ())) != tuple(v)]
        return made + [(p, "removed", *old[p]) for p in sorted(old) if p not in new]

    def partitions(self, rows: list) -> list[Files]:
        return [Files(rows[i : i + self.per_task]) for i in range(0, len(rows), self.per_task)]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, kind, modified, size in partition.rows:
            content = None
            if kind != "removed":
                try:
                    with open(os.path.join(self.root, path), "rb") as f:
                        held = f.read()
                        s = os.fstat(f.fileno())
                    if (s.st_mtime_ns, len(held)) == (modified, size):
                        content = held
                except FileNotFoundError:
                    pass
            yield path, kind, modified, size, content


class _Batch(DataSourceReader):
    def __init__(self, folder: _Folder):
        self.folder = folder

    def partitions(self):
        return self.folder.partitions(self.folder.difference({}, self.folder.listing())) or [Files([])]

    def read(self, partition):
        return self.folder.read(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: _Folder, state: str):
        self.folder, self.state = folder, state.removeprefix("file://")
        os.makedirs(self.state, exist_ok=True)

    def _place(self, number: int) -> str:
        return os.path.join(self.state, f"listing-{number:012d}.json")

    def _numbers(self) -> list[int]:
        return sorted(int(n[8:-5]) for n in os.listdir(self.state) if n.startswith("listing-") and n.endswith(".json"))

    def _load(self, number: int) -> dict[str, tuple[int, int]]:
        if not number:
            return {}
        with open(self._place(number), encoding="utf-8") as f:
            return {p: tuple(v) for p, v in json.load(f).items()}

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        last = max(self._numbers(), default=0)
        old = self._load(last)
        new = self.folder.merged(old, self.folder.listing())
        if new == old:
            return {"listing": last}
        with open(self._place(last + 1) + ".new", "w", encoding="utf-8") as f:
            json.dump(new, f)
        os.replace(f.name, self._place(last + 1))
        return {"listing": last + 1}

    def partitions(self, start: dict, end: dict):
        return self.folder.partitions(self.folder.difference(self._load(start["listing"]), self._load(end["listing"])))

    def read(self, partition):
        return self.folder.read(partition)

    def commit(self, end: dict) -> None:
        for n in self._numbers():
            if n < end["listing"]:
                os.remove(self._place(n))


class FolderChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(_Folder(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        if not self.options.get("state"):
            raise ValueError("folder_changes needs the option state: a folder for listings")
        return _Stream(_Folder(self.options), self.options["state"])
