"""The clean cache: versioned Parquet with a pointer that is swapped at the end."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession

from ..config import DEFAULTS, Settings
from ..model import CleaningPlan, QualityDiff
from ..sources.files import Files
from . import compile as compiling
from .dryrun import null_facts


@dataclass
class LoadReport:
    table: str
    status: str
    source_rows: int
    cache_rows: int
    path: str
    warnings: list[str] = field(default_factory=list)
    nulls: dict[str, tuple[int | None, int | None]] = field(default_factory=dict)  # by column: in the source, in the cache


class Cache:
    """``<root>/<table>/v=<n>-<id>`` holds each version, ``<root>/<table>/CURRENT.json`` names the live
    one.  A version is complete before the pointer is renamed over the old one; readers see the old
    or the new one.  Loads at the same time write apart, and the last pointer wins."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def pointer(self, table: str) -> dict | None:
        text = self.files.read(f"{self.root}/{table}/CURRENT.json")
        return json.loads(text) if text is not None else None

    def _point(self, table: str, value: dict) -> None:
        self.files.replace(f"{self.root}/{table}/CURRENT.json", json.dumps(value))

    def read(self, table: str, rows: bool = False) -> DataFrame:
        """The live version; with ``rows`` also the column of the rows' places, if it has one."""
        live = self.pointer(table)
        if live is None:
            raise LookupError(f"{table} has no clean cache")
        df = self.spark.read.parquet(live["path"])
        return df if rows or not live.get("row") else df.drop(live["row"])

    def register(self, table: str) -> None:
        """View clean_cache_<table> on the live version."""
        self.read(table).createOrReplaceTempView(f"clean_cache_{table}")

    def _claim(self, table: str) -> int:
        """A version number of this load's own, whoever loads at the same time."""
        live = self.pointer(table)
        version = (live["version"] if live else 0) + 1
        while not self.files.claim(f"{self.root}/{table}/versions/{version}"):
            version += 1
        return version

    def load(self, plan: CleaningPlan, source: DataFrame, predicted: QualityDiff | None = None, settings: Settings = DEFAULTS, row: str | None = None) -> LoadReport:
        """Write a new version with the plan's own schema, check it and make it live.  Running it
        again, after a crash or not, gives the same table.  ``row`` is a column of ``source`` with
        the rows' places, kept beside the cleaned columns.

        Rows and nulls of both sides are counted by the write itself: one pass over the source, and
        both counts are of the rows that were written."""
        table, keep = plan.table, (row,) if row else ()
        columns = [c for c in source.columns if c not in keep]
        seen, made = Observation(), Observation()
        cleaned = compiling.apply(plan, source.observe(seen, *null_facts(columns)), keep)
        outcome = [c for c in cleaned.columns if c not in keep]
        version = self._claim(table)
        path = f"{self.root}/{table}/v={version}-{uuid.uuid4().hex[:12]}"
        cleaned.observe(made, *null_facts(outcome)).write.parquet(path)
        before, after = ({k: v or 0 for k, v in o.get.items()} or dict.fromkeys(["n", *[f"c{k}" for k in range(len(cs))]], 0) for o, cs in ((seen, columns), (made, outcome)))
        warnings = reconcile(before["n"], after["n"], settings)
        if predicted is not None:
            warnings += unexpected_nulls(before, after, columns, outcome, predicted, settings)
        self._point(table, {"version": version, "path": path, "rows": after["n"], "row": row})
        nulls = {c: (before[f"c{k}"], None) for k, c in enumerate(columns)}
        nulls |= {c: (nulls.get(c, (None,))[0], after[f"c{k}"]) for k, c in enumerate(outcome)}
        return LoadReport(table, "completed", before["n"], after["n"], path, warnings, nulls)

    def prune(self, table: str, keep: int = 2) -> list[str]:
        """Delete all but the live version and the ``keep - 1`` before it; names of what went.  Not for
        tables that someone is loading."""
        live = self.pointer(table)
        if live is None:
            return []
        number = lambda n: int(n[2:].split("-")[0])
        older = [n for n in self.files.names(f"{self.root}/{table}") if n.startswith("v=") and not live["path"].endswith(f"/{n}")]
        stay = sorted((n for n in older if number(n) < live["version"]), key=number)[max(len(older) - keep + 1, 0) :] if keep > 1 else []
        gone = [n for n in older if n not in stay]
        for name in gone:
            for path in (name, f"diff/{name}.json", f"diff/{name}"):
                self.files.remove(f"{self.root}/{table}/{path}")
        return gone


def reconcile(source_rows: int, cache_rows: int, settings: Settings = DEFAULTS) -> list[str]:
    off = abs(cache_rows - source_rows) / max(source_rows, 1)
    return [f"{cache_rows} rows for {source_rows} in the source"] if off > settings.reconciliation else []


def unexpected_nulls(before, after, source_columns: list[str], cache_columns: list[str], predicted: QualityDiff, settings: Settings = DEFAULTS) -> list[str]:
    """Columns whose nulls rose by clearly more than the sample foretold."""
    foretold = {c["column"]: c for c in predicted.columns}
    out = []
    for k, c in enumerate(source_columns):
        if c not in cache_columns or c not in foretold or not before["n"] or not after["n"] or not predicted.rows_before:
            continue
        actual = after[f"c{cache_columns.index(c)}"] / after["n"] - before[f"c{k}"] / before["n"]
        expected = (foretold[c]["null_after"] - (foretold[c]["null_before"] or 0)) / predicted.rows_before
        if actual - expected > settings.null_spike:
            out.append(f"column {c}: nulls rose by {actual:.1%}, the sample foretold {expected:.1%}")
    return out
