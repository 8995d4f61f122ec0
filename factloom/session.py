"""Sessions over folders of tables: versions, staged changes, undo."""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How many staged changes are kept, for how long, and how many versions later one can still be applied.
MOST_STAGED, STAGED_SECONDS, VERSION_SPAN = 20, 300.0, 1


@dataclass
class Staged:
    """A change set that waits to be applied: the new rows of a table."""

    session: str
    version: int
    table: str
    rows: DataFrame
    description: str
    made: float


@dataclass
class Session:
    """An immutable snapshot of tables, by version."""

    id: str
    path: str
    tables: dict[str, DataFrame]
    version: int = 1
    log: list[tuple[int, str, str]] = field(default_factory=list)  # (sequence, table, description)
    undo: list[tuple[int, str, DataFrame]] = field(default_factory=list)


class Workspaces:
    """Sessions by path; loading a path twice gives the same one."""

    def __init__(self, spark: SparkSession, most: int = 8, clock=time.monotonic):
        self.spark, self.most, self.clock = spark, most, clock
        self.sessions: dict[str, Session] = {}
        self.staged: dict[str, Staged] = {}
        self.sequence = 0
        self._lock = threading.RLock()

    def load(self, path: str, names: list[str]) -> Session:
        with self._lock:
            for s in self.sessions.values():
                if s.path == path:
                    return s
            if len(self.sessions) >= self.most:
                raise RuntimeError(f"at most {self.most} sessions; close one")
            s = Session(uuid.uuid4().hex, path, self._read(path, names))
            self.sessions[s.id] = s
            return s

    def _read(self, path: str, names: list[str]) -> dict[str, DataFrame]:
        return {n: self.spark.read.parquet(f"{path}/{n}.parquet") for n in names}

    def reload(self, id: str) -> Session:
        with self._lock:
            s = self.sessions[id]
            s.tables = self._read(s.path, list(s.tables))
            self._next_version(s)
            return s

    def close(self, id: str) -> bool:
        with self._lock:
            s = self.sessions.pop(id, None)
            for t in s.tables.values() if s else ():
                t.unpersist()
            self.staged = {k: v for k, v in self.staged.items() if v.session != id}
            return s is not None

    def listed(self) -> DataFrame:
        rows = [(s.id, s.path, s.version, len(s.tables)) for s in self.sessions.values()]
        return self.spark.createDataFrame(rows, "id string, path string, version int, tables int")

    def status(self, id: str) -> DataFrame:
        """Rows of each table (name, n)."""
        parts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in self.sessions[id].tables.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def described(self, id: str) -> DataFrame:
        """Columns of each table (name, columns)."""
        return self.spark.createDataFrame([(name, len(t.columns)) for name, t in self.sessions[id].tables.items()], "name string, columns int")

    def warm(self, id: str, names: list[str] | None = None) -> int:
        """Keep tables in memory; how many rows those are."""
        return sum(t.persist().count() for n, t in self.sessions[id].tables.items() if names is None or n in names)

    def preview(self, id: str, table: str, rows: DataFrame, description: str) -> str:
        """Stage new rows of a table under a token; the oldest staged go beyond the most that are kept."""
        with self._lock:
            now = self.clock()
            self.staged = {k: v for k, v in self.staged.items() if now - v.made < STAGED_SECONDS}
            while len(self.staged) >= MOST_STAGED:
                self.staged.pop(min(self.staged, key=lambda k: self.staged[k].made))
            token = uuid.uuid4().hex
            self.staged[token] = Staged(id, self.sessions[id].version, table, rows, description, now)
            return token

    def apply(self, token: str) -> int:
        """Make staged rows the table's; the sequence number.  Fails if the session moved on too far."""
        with self._lock:
            s = self.staged.get(token)
            if s is None or self.clock() - s.made >= STAGED_SECONDS:
                raise KeyError("no such staged change, or it is too old")
            session = self.sessions[s.session]
            if session.version > s.version + VERSION_SPAN:
                raise RuntimeError(f"staged at version {s.version}, now {session.version}")
            del self.staged[token]
            self.sequence += 1
            session.undo.append((self.sequence, s.table, session.tables[s.table]))
            session.log.append((self.sequence, s.table, s.description))
            session.tables = session.tables | {s.table: s.rows}
            session.version += 1
            return self.sequence

    def revert_last(self, id: str) -> int | None:
        """Take the last change back; its sequence number, or none."""
        with self._lock:
            s = self.sessions[id]
            if not s.undo:
                return None
            number, table, rows = s.undo.pop()
            s.tables = s.tables | {table: rows}
            s.version += 1
            return number

    def revert(self, id: str, sequence: int) -> bool:
        """Take one change back, if no later one touches its table."""
        with self._lock:
            s = self.sessions[id]
            at = next((k for k, u in enumerate(s.undo) if u[0] == sequence), None)
            if at is None or any(u[1] == s.undo[at][1] for u in s.undo[at + 1 :]):
                return False
            _, table, rows = s.undo.pop(at)
            s.tables = s.tables | {table: rows}
            s.version += 1
            return True

    def changes(self, id: str) -> DataFrame:
        return self.spark.createDataFrame(self.sessions[id].log, "seq long, table string, description string")

    def _next_version(self, s: Session) -> None:
        s.version += 1
        self.staged = {k: v for k, v in self.staged.items() if v.session != s.id}
