"""Tables that streams write batch by batch, and that stay quick to read.

Each micro-batch writes a folder of its own, so it costs its own rows. A manifest names the
folders that make up the table; a new one is written beside the old and renamed to its place,
so readers see either the state before or the one after. Folders are merged by size: once
``fan`` folders of one tier are there they become one of the next tier, so a reader opens at
most ``fan`` folders per tier, and a row is written again once per tier. A table has one
writer; what a crash leaves behind is named by no manifest and is deleted later.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FAN = 4
# Manifests, and folders named by them, that stay for readers that began before.
KEPT = 3


class BatchTable:
    """A folder of batches. ``merge`` makes one table of the rows of several folders.

    It must not matter in which order and how often ``merge`` is applied.
    """

    def __init__(self, spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], fan: int = FAN):
        if fan < 2:
            raise ValueError("two folders at least make a merge")
        self.spark, self.path, self.merge, self.fan = spark, path, merge, fan
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs

    # --- files ---

    def _at(self, name: str):
        path = self._hadoop.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        system, path = self._at(folder)
        return sorted(s.getPath().getName() for s in system.listStatus(path)) if system.exists(path) else []

    def _delete(self, name: str) -> None:
        system, path = self._at(name)
        system.delete(path, True)

    def _versions(self) -> list[str]:
        return [n for n in self._names("_manifest") if n.endswith(".json")]

    def _read(self, version: str) -> dict:
        system, path = self._at(f"_manifest/{version}")
        stream = system.open(path)
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def manifest(self) -> dict:
        """``live`` folders with their tier and the batches in them, and the last batch ``through``."""
        versions = self._versions()
        return self._read(versions[-1]) if versions else {"live": [], "through": -1, "merged": -1, "next": 1}

    def _switch(self, manifest: dict) -> None:
        versions = self._versions()
        number = int(versions[-1].split(".")[0]) + 1 if versions else 0
        system, draft = self._at(f"_manifest/{number:020d}.draft")
        out = system.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        _, target = self._at(f"_manifest/{number:020d}.json")
        if not system.rename(draft, target):
            raise RuntimeError(f"{target} is there: another writer changes this table")

    # --- writing ---

    def add(self, number: int, rows: DataFrame) -> None:
        """Write the rows of a micro-batch; if it runs again it replaces what it wrote.

        A batch that was merged with others already, or came before one that was, is left.
        """
        manifest = self.manifest()
        if number <= manifest["merged"]:
            return
        name = f"batch={number}"
        self.merge(rows).write.mode("overwrite").parquet(f"{self.path}/{name}")
        live = [x for x in manifest["live"] if x["name"] != name] + [{"name": name, "tier": 0, "through": number}]
        manifest |= {"live": live, "through": max(number, manifest["through"])}
        self._switch(manifest)
        while self.compact():
            pass
        self.clean()

    def start(self, rows: DataFrame, through: int) -> None:
        """Begin an empty table with rows that stand for all batches up to ``through``."""
        if self._versions():
            raise ValueError(f"{self.path} has rows already")
        rows.write.parquet(f"{self.path}/batch=-1")
        self._switch({"live": [{"name": "batch=-1", "tier": 1, "through": through}],
                      "through": through, "merged": through, "next": 2})

    def compact(self, everything: bool = False) -> bool:
        """Merge the folders of the lowest full tier, or all; whether there were some."""
        manifest = self.manifest()
        tiers: dict[int, list] = {}
        for x in manifest["live"]:
            tiers.setdefault(0 if everything else x["tier"], []).append(x)
        full = [t for t in sorted(tiers) if len(tiers[t]) >= (2 if everything else self.fan)]
        if not full:
            return False
        old = tiers[full[0]]
        name = f"batch={-manifest['next']}"
        self.merge(self.rows_of(old)).write.mode("overwrite").parquet(f"{self.path}/{name}")
        through = max(x["through"] for x in old)
        live = [x for x in manifest["live"] if x not in old]
        live.append({"name": name, "tier": 1 + max(x["tier"] for x in old), "through": through})
        self._switch(manifest | {"live": live, "merged": max(through, manifest["merged"]), "next": manifest["next"] + 1})
        return True

    def clean(self, kept: int = KEPT) -> int:
        """Delete manifests but for the last ``kept``, and folders that none of those names."""
        versions = self._versions()
        if not versions:
            return 0
        named = {x["name"] for v in versions[-kept:] for x in self._read(v)["live"]}
        dead = [n for n in self._names("") if n.startswith("batch=") and n not in named]
        old = [n for n in self._names("_manifest") if n not in versions[-kept:]]
        for name in dead + [f"_manifest/{n}" for n in old]:
            self._delete(name)
        return len(dead)

    # --- reading ---

    def _folders(self, names: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{n}" for n in names])

    def rows_of(self, entries: list[dict]) -> DataFrame:
        """The rows of some entries of a manifest, as they were written."""
        return self._folders([x["name"] for x in entries])

    def read(self) -> DataFrame:
        """The merged rows of all live folders; an empty table has none to tell its columns by."""
        live = self.manifest()["live"]
        if not live:
            raise ValueError(f"nothing was written to {self.path} yet")
        return self.merge(self.rows_of(live))
