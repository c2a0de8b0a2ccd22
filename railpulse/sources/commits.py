"""Commit log of a store: which folders make up its tables.

A writer puts its rows into folders of its own and then commits: one small file names all folders of every table,
and the next reader takes those.  Readers so see a batch with its trips, snapshots and metrics or none of it, and a
table before or after a rewrite, never between.  A commit is made against the version that its writer has read; if
another writer came first, it is made again on top of that one's version where the two do not touch the same data,
and otherwise refused with :class:`Conflict`.

A file is written under a temporary name and renamed to the next number, which fails if the number is taken.  On
HDFS the rename is atomic; the store must lie on a file system with that property.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from railpulse.sources import folders

KEEP_FILES = 100  # log files that are left for readers that have just listed them


class Conflict(RuntimeError):
    """Another writer has changed what this one has read; the caller may read again and repeat its work."""


@dataclass(frozen=True)
class Version:
    """``tables``: folders of each table, relative to it; ``runs``: last batch of each stream; ``retired``: folders that
    are no longer read (table, folder, seconds since 1970), until maintenance deletes them."""

    number: int = -1
    tables: dict[str, tuple[str, ...]] = field(default_factory=dict)
    runs: dict[str, int] = field(default_factory=dict)
    retired: tuple[tuple[str, str, float], ...] = ()

    def of(self, table: str, prefix: str = "") -> tuple[str, ...]:
        return tuple(f for f in self.tables.get(table, ()) if f.startswith(prefix))


class CommitLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.path = f"{root.rstrip('/')}/_commits"

    def latest(self) -> Version | None:
        """The newest version; None for a store without a log."""
        names = folders.children(self.spark, self.path, "")
        names = [n for n in names if n.endswith(".json") and not n.startswith(".")]
        if not names:
            return None
        v = json.loads(folders.read_text(self.spark, f"{self.path}/{max(names)}"))
        return Version(v["number"], {t: tuple(f) for t, f in v["tables"].items()}, v["runs"], tuple(map(tuple, v["retired"])))

    def create(self, v: Version) -> bool:
        """Write ``v`` as the next version, unless there is one of its number."""
        temporary = f"{self.path}/.{uuid.uuid4().hex}"
        content = {"number": v.number, "tables": v.tables, "runs": v.runs, "retired": v.retired}
        folders.write_text(self.spark, temporary, json.dumps(content))
        return folders.rename_new(self.spark, temporary, f"{self.path}/{v.number:020d}.json")

    def commit(self, base: Version, add: dict[str, Iterable[str]], remove: dict[str, Iterable[str]] | None = None,
               run: tuple[str, int] | None = None, same: Iterable[tuple[str, str]] = (),
               valid: Callable[[Version], bool] | None = None, forget: Iterable[tuple[str, str]] = (), now: float = 0.0) -> Version:
        """Commit ``add`` and ``remove`` (folders by table) on top of the newest version.

        ``same`` names (table, prefix of folders) that must be as in ``base``, ``valid`` decides on any version newer
        than that; what is removed must still be there.  ``forget`` drops retired folders that have been deleted.
        """
        remove = {t: tuple(f) for t, f in (remove or {}).items()}
        while True:
            newest = self.latest() or Version()
            if newest.number != base.number:
                changed = [x for x in same if set(newest.of(*x)) != set(base.of(*x))]
                gone = [f for t, fs in remove.items() for f in set(fs) - set(newest.of(t))]
                if changed or gone or valid is not None and not valid(newest):
                    raise Conflict(f"version {newest.number} has changed what was read in version {base.number}: {changed or gone or 'rows'}")
            tables = {t: [f for f in newest.of(t) if f not in remove.get(t, ())] for t in newest.tables}
            for t, fs in add.items():
                tables[t] = [*tables.get(t, []), *(f for f in fs if f not in tables.get(t, []))]
            dropped = set(forget)
            retired = [r for r in newest.retired if r[:2] not in dropped]
            retired += [(t, f, now) for t, fs in remove.items() for f in fs if f not in tables[t]]
            v = Version(newest.number + 1, {t: tuple(f) for t, f in tables.items()},
                        newest.runs | ({run[0]: run[1]} if run else {}), tuple(retired))
            if self.create(v):
                return v

    def prune(self, keep: int = KEEP_FILES) -> None:
        names = sorted(n for n in folders.children(self.spark, self.path, "") if n.endswith(".json") and not n.startswith("."))
        for n in names[:-keep]:
            folders.delete(self.spark, f"{self.path}/{n}")
