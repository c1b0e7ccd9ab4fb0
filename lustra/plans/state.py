"""A small key-value store for projects, tables, syncs and locked plans: one JSON file per entry, in
the engine's own folder, wherever that is."""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import SparkSession

from ..sources.files import Files


class State:
    """Kinds: projects, tables, sync, progress, memory, debug.  Entries are dictionaries."""

    def __init__(self, folder: str, spark: SparkSession):
        self.folder, self.files = folder.rstrip("/"), Files(spark)

    def _path(self, kind: str, key: tuple[str, ...]) -> str:
        safe = "__".join(re.sub(r"[^\w-]", lambda m: f"={ord(m[0]):x}", k) for k in key)
        return f"{self.folder}/{kind}/{safe}.json"

    def put(self, kind: str, key: tuple[str, ...], **values) -> dict:
        """Insert or update."""
        entry = {"id": uuid.uuid4().hex, "created_at": time.time()} | (self.get(kind, key) or {}) | values | {"key": list(key), "updated_at": time.time()}
        self.files.replace(self._path(kind, key), json.dumps(entry, ensure_ascii=False))
        return entry

    def get(self, kind: str, key: tuple[str, ...]) -> dict | None:
        text = self.files.read(self._path(kind, key))
        return json.loads(text) if text is not None else None

    def all(self, kind: str) -> list[dict]:
        found = [self.files.read(f"{self.folder}/{kind}/{n}") for n in self.files.names(f"{self.folder}/{kind}") if n.endswith(".json")]
        return [json.loads(t) for t in found if t is not None]

    def write_memory(self, project: str, domain: str, topic: str, content: str) -> None:
        self.put("memory", (project, domain, topic), content=content)

    def read_memory(self, project: str, domain: str, topic: str) -> str | None:
        got = self.get("memory", (project, domain, topic))
        return got and got["content"]

    def log(self, project: str, stage: str, message: str, **data) -> None:
        """An entry of the debug log."""
        self.put("debug", (project, f"{time.time():017.6f}", uuid.uuid4().hex), stage=stage, message=message, data=data)

    def debug_log(self, project: str) -> list[dict]:
        """A project's entries in order of time."""
        return [e for e in self.all("debug") if e["key"][0] == project]
