"""State tables: immutable versions under a key, pointers that are only added, and a fenced lease on the key.

Leases and pointers are numbered files that are created new or not at all, so of several runs that try one number one has
it.  The highest lease holds.  Its number, the fence, is the first part of the names of the pointers that its run
adds, and the highest pointer is the state.  A run that takes a lease over first seals what it found under its own
fence; pointers that an older run adds later are lower and are never read.  A commit is good if the lease still held when
its pointer stood; a run that took over later has seen it, one that took over before makes it fail.

Paths are read and written through Hadoop's file systems, so a state may be on any store that Spark reads.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import changes as C
from tidemark.plans.spec import storage_name
from tidemark.sources import migration as M

LEASE = timedelta(minutes=30)
#: Pointers of a key that are kept, with the versions that they name.
KEPT = 3


class Store:
    """Small text files in a folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def text(self, name: str) -> str | None:
        path = self._path(name)
        if not self._fs.exists(path) or self._fs.getFileStatus(path).isDirectory():
            return None
        stream = self._fs.open(path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def read(self, name: str) -> dict | None:
        """What a file holds; empty if that is no JSON object, None if there is no file."""
        text = self.text(name)
        if text is None:
            return None
        try:
            found = json.loads(text)
        except ValueError:
            return {}
        return found if isinstance(found, dict) else {}

    def write(self, name: str, value: dict, new: bool = False) -> bool:
        """Write a file; with new only if there is none.  False if there was one."""
        path = self._path(name)
        try:
            if new and self._fs.getUri().getScheme() == "file":
                # Hadoop's local file system looks first and creates then; Java's own creation is one step.
                self._fs.mkdirs(path.getParent())
                self._jvm.java.nio.file.Files.createFile(self._jvm.java.io.File(path.toUri().getPath()).toPath(), self._no_attributes())
                new = False
            stream = self._fs.create(path, not new)
        except Exception:
            if new and self._fs.exists(path):
                return False
            raise
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        return True

    def _no_attributes(self):
        return self.spark.sparkContext._gateway.new_array(self._jvm.java.nio.file.attribute.FileAttribute, 0)

    def names(self, folder: str) -> list[str]:
        """The files and folders of a folder, in order."""
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def written_at(self, name: str) -> datetime | None:
        path = self._path(name)
        if not self._fs.exists(path):
            return None
        return datetime.fromtimestamp(self._fs.getFileStatus(path).getModificationTime() / 1000, timezone.utc)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


class LeaseLost(RuntimeError):
    """Another run has taken the lease over."""


@dataclass(frozen=True)
class Lease:
    """Who holds a state key since when, under which number."""

    run_id: str
    acquired_at: str
    number: int = 0
    released: bool = False

    def stale(self, now: datetime) -> bool:
        try:
            since = datetime.fromisoformat(self.acquired_at)
        except ValueError:
            return True
        return now - since > LEASE


def _numbered(number: int) -> str:
    return f"{number:012d}"


def _leases(key: str) -> str:
    return storage_name("state-lock", key)


def current_lease(store: Store, key: str) -> Lease | None:
    """The lease of the highest number."""
    folder = _leases(key)
    names = store.names(folder)
    numbers = [n for n in names if n.isdigit()]
    if not numbers:
        return None
    name = numbers[-1]
    found = store.read(f"{folder}/{name}") or {}
    # A file that is not written yet, or never will be, is as old as the store says.
    since = found.get("acquired_at") or str(store.written_at(f"{folder}/{name}") or "")
    return Lease(str(found.get("run_id")), since, int(name), f"{name}.released" in names)


def acquire(store: Store, key: str, run_id: str, now: datetime | None = None) -> tuple[bool, str]:
    """(whether the lease is held now, ok | stale_override | conflict).

    A lease that was given up or went stale is followed by the next number, which one run alone can create.
    """
    now = now or datetime.now(timezone.utc)
    last = current_lease(store, key)
    if last is not None and not last.released:
        if last.run_id == run_id:
            return True, "ok"
        if not last.stale(now):
            return False, "conflict"
    number = 0 if last is None else last.number + 1
    mine = {"run_id": run_id, "acquired_at": now.isoformat()}
    if not store.write(f"{_leases(key)}/{_numbered(number)}", mine, new=True):
        return False, "conflict"
    if number:
        _seal(store, key, number)
        # The numbers before the last one say nothing any more; the last one keeps later numbers from starting again.
        for name in store.names(_leases(key)):
            if int(name.split(".")[0]) < number - 1:
                store.delete(f"{_leases(key)}/{name}")
    return True, "ok" if last is None or last.released else "stale_override"


def holds(store: Store, key: str, run_id: str) -> bool:
    last = current_lease(store, key)
    return last is not None and not last.released and last.run_id == run_id


def release(store: Store, key: str, run_id: str) -> None:
    """Give the lease up, if it is still one's own."""
    if holds(store, key, run_id):
        last = current_lease(store, key)
        store.write(f"{_leases(key)}/{_numbered(last.number)}.released", {"run_id": run_id}, new=True)


def _folder(key: str) -> str:
    """Not the name of a record of the first layout."""
    return storage_name("states", key)


def _pointers(key: str) -> str:
    return _folder(key) + "/pointers"


def _pointer(store: Store, key: str) -> tuple[str | None, dict | None]:
    """(name, content) of the highest pointer that is written; one that is not was never reported as committed."""
    for name in reversed(store.names(_pointers(key))):
        found = store.read(f"{_pointers(key)}/{name}")
        if found:
            return name, found
    # Before pointers were numbered there was one file, moved by overwriting it.
    found = store.read(storage_name("state", key) + ".json")
    return (f"{_numbered(0)}-{_numbered(0)}", found) if found is not None else (None, None)


def _seal(store: Store, key: str, fence: int) -> None:
    """Repeat the state under a new fence, so that what older runs add is below it."""
    _, found = _pointer(store, key)
    if found is not None:
        store.write(f"{_pointers(key)}/{_numbered(fence)}-{_numbered(0)}", found, new=True)


@dataclass(frozen=True)
class Loaded:
    """A state, what it means for coverage, and the older record that was found in its place, if any."""

    rows: DataFrame
    coverage: C.Coverage
    migrated_from: str | None = None

    @property
    def migrated(self) -> bool:
        return self.migrated_from is not None


def load_with_migration(store: Store, key: str, fingerprint: str) -> Loaded:
    """The state of a key; without a usable one nothing can expire.

    A record of the first layout has no fingerprint, so it is reported and never adopted: the run starts anew.
    """
    _, pointer = _pointer(store, key)
    nothing = C.empty_state(store.spark)
    if pointer is None:
        for name in M.legacy_names(key):
            if (text := store.text(name)) is not None:
                found = store.spark.createDataFrame([(name, text)], M.RECORD_SCHEMA)
                if M.recognised(found).first().kind == "legacy":
                    return Loaded(nothing, C.Coverage(False, "no_prior_state"), name)
        return Loaded(nothing, C.Coverage(False, "no_prior_state"))
    if pointer.get("version") != 2 or pointer.get("fingerprint") != fingerprint or not pointer.get("path"):
        return Loaded(nothing, C.Coverage(False, "state_corruption_detected"))
    return Loaded(store.spark.read.schema(C.STATE_SCHEMA).parquet(f"{store.root}/{pointer['path']}"), C.Coverage(True))


def load(store: Store, key: str, fingerprint: str) -> tuple[DataFrame, C.Coverage]:
    """The rows and the coverage of :func:`load_with_migration`."""
    found = load_with_migration(store, key, fingerprint)
    return found.rows, found.coverage


def commit(store: Store, key: str, fingerprint: str, state: DataFrame, now: str, run_id: str | None = None) -> None:
    """Write a new version, then add its pointer; what fails before that leaves the old state.

    With a run_id the lease must be that run's, before and after: :class:`LeaseLost` if it is not.  Versions that no kept
    pointer names are deleted.
    """
    def fence() -> int:
        last = current_lease(store, key)
        if run_id is not None and (last is None or last.released or last.run_id != run_id):
            raise LeaseLost("state lock lost during run")
        return -1 if last is None else last.number

    mine = max(fence(), 0)
    name = _folder(key)
    old, _ = _pointer(store, key)
    turn = int(old.split("-")[1]) + 1 if old is not None and int(old.split("-")[0]) == mine else 1
    path = f"{name}/v={_numbered(mine)}-{_numbered(turn)}-{uuid.uuid4().hex[:8]}"
    state.write.mode("overwrite").parquet(f"{store.root}/{path}")
    fence()
    pointer = {"version": 2, "fingerprint": fingerprint, "path": path, "updated_at": now}
    if not store.write(f"{_pointers(key)}/{_numbered(mine)}-{_numbered(turn)}", pointer, new=True):
        raise LeaseLost("state lock lost during run")
    if max(fence(), 0) != mine:
        raise LeaseLost("state lock lost during run")
    _tidy(store, key)


def _tidy(store: Store, key: str) -> None:
    """Delete all but the last pointers, and versions of fences that are over which none of these names."""
    folder, name = _pointers(key), _folder(key)
    pointers = store.names(folder)
    for old in pointers[:-KEPT]:
        store.delete(f"{folder}/{old}")
    kept = pointers[-KEPT:]
    named = {(store.read(f"{folder}/{p}") or {}).get("path") for p in kept}
    for version in store.names(name):
        # What a run writes just now has a fence and turn that are not below the oldest kept pointer's.
        if version.startswith("v=") and f"{name}/{version}" not in named and version[2:].rsplit("-", 1)[0] < kept[0]:
            store.delete(f"{name}/{version}")


def open_decision(kind: str, allow_fallback: bool = False, canary: bool = False) -> str:
    """What to do when a state was opened, busy or unavailable: proceed, exit, degrade or fail."""
    if kind == "opened":
        return "proceed"
    if kind == "lock_busy":
        return "exit"
    return "degrade" if canary or allow_fallback else "fail"
