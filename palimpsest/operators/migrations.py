"""Schema migrations: numbered steps with checksums, applied in order, recorded beside the tables, undone in reverse."""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import dataclass, field
from typing import Any


class MigrationError(Exception):
    """A step that is missing, out of order or not what was applied."""


@dataclass(frozen=True)
class Migration:
    """up and down are statements, carried out one by one."""

    version: int
    name: str
    up: tuple[str, ...]
    down: tuple[str, ...] = ()

    def checksum(self) -> str:
        return hashlib.sha256(json.dumps([self.version, self.name, self.up]).encode()).hexdigest()


@dataclass
class Migrations:
    engine: Any
    known: list[Migration] = field(default_factory=list)

    def add(self, version: int, name: str, up: list[str], down: list[str] | None = None) -> Migration:
        if any(m.version == version for m in self.known):
            raise MigrationError(f"version {version} is there twice")
        self.known.append(Migration(version, name, tuple(up), tuple(down or ())))
        self.known.sort(key=lambda m: m.version)
        return self.known[-1]

    @property
    def _path(self) -> str:
        return f"{self.engine.root}/migrations.json"

    def applied(self) -> list[dict]:
        """version, name, checksum and time of each step that counts, in order."""
        return json.loads(self.engine.files.read(self._path)) if self.engine.files.exists(self._path) else []

    def check(self) -> None:
        """Every applied step must be known and unchanged, and none before them may be missing."""
        mine = {m.version: m for m in self.known}
        done = self.applied()
        for d in done:
            m = mine.get(d["version"])
            if m is None:
                raise MigrationError(f"version {d['version']} was applied and is not known")
            if m.checksum() != d["checksum"]:
                raise MigrationError(f"version {d['version']} was changed after it was applied")
        last = max((d["version"] for d in done), default=-1)
        late = [m.version for m in self.known if m.version < last and m.version not in {d["version"] for d in done}]
        if late:
            raise MigrationError(f"version {late[0]} comes before {last}, which was applied")

    def pending(self) -> list[Migration]:
        done = {d["version"] for d in self.applied()}
        return [m for m in self.known if m.version not in done]

    def apply(self, to: int | None = None, dry_run: bool = False) -> list[str]:
        """Carries out what is pending, up to a version; returns the statements. A dry run only returns them. A step counts
        once all its statements are done."""
        self.check()
        out = []
        for m in self.pending():
            if to is not None and m.version > to:
                break
            out += m.up
            if not dry_run:
                for s in m.up:
                    self.engine.sql(s)
                self._save([*self.applied(), {"version": m.version, "name": m.name, "checksum": m.checksum(), "at": time.time()}])
        return out

    def rollback(self, to: int) -> list[str]:
        """Undoes all steps behind a version, the last first; returns the statements."""
        self.check()
        mine, out = {m.version: m for m in self.known}, []
        for d in reversed(self.applied()):
            if d["version"] <= to:
                break
            m = mine[d["version"]]
            if not m.down:
                raise MigrationError(f"version {m.version} can't be undone")
            out += m.down
            for s in m.down:
                self.engine.sql(s)
            self._save(self.applied()[:-1])
        return out

    def _save(self, done: list[dict]) -> None:
        self.engine.files.write(self._path, json.dumps(done))
