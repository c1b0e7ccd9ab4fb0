"""The whole lifecycle: analyse a project, review, approve, load, look at the difference."""

from __future__ import annotations

import json
import logging
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict

from pyspark.sql import SparkSession

from .config import DEFAULTS, Settings
from .model import CleaningPlan, ColumnClass, QualityDiff, TableProfile
from .operators import classify, consistency, profile, rowdiff, sample
from .operators.capture import Suggester
from .plans import answers, diffindex, dryrun, guard
from .plans import compile as compiling
from .plans.materialize import Cache
from .plans.state import State
from .sources import snapshot as snapshots
from .sources.tables import Source

log = logging.getLogger("lustra")


class NotReady(RuntimeError):
    """The project or table is in no state for this call."""


class Engine:
    def __init__(self, spark: SparkSession, folder: str, gate: classify.Gate | None = None, suggest: Suggester | None = None, settings: Settings = DEFAULTS):
        self.spark, self.folder, self.settings, self.suggest = spark, folder.rstrip("/"), settings, suggest
        self.gate = classify.SchemaGate(gate)
        self.state = State(f"{self.folder}/state", spark)

    def _sample(self, project: str, source: Source, table: str, t: TableProfile, anew: bool = False):
        """The table's sample, drawn at its analysis and kept: later steps see the same rows."""
        path = f"{self.folder}/samples/{project}/{table}"
        if anew:
            rows = self._snapshot(project, source, table).read(self.spark)
            sample.stratified(rows, t, self.settings).coalesce(1).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def _snapshot(self, project: str, source: Source, table: str, anew: bool = False) -> snapshots.Snapshot:
        """The table as pinned at its analysis: sample, dry run, load and diff see the same rows."""
        entry = self.state.get("tables", (project, table)) or {}
        if entry.get("snapshot") and not anew:
            return snapshots.Snapshot.of(entry["snapshot"])
        taken = snapshots.take(self.spark, source, table, snapshots.fresh(f"{self.folder}/snapshots/{project}/{table}"))
        self.state.put("tables", (project, table), snapshot=asdict(taken))
        loaded = (self.state.get("sync", (project, table)) or {}).get("snapshot")
        if entry.get("snapshot") and entry["snapshot"] != loaded:
            snapshots.drop(self.spark, snapshots.Snapshot.of(entry["snapshot"]))
        return taken

    # Analysis

    def analyze_project(self, source: Source, project: str | None = None) -> str:
        """Profile, classify, compile, validate and dry-run every table; align formats across them.
        A table that fails doesn't stop the others."""
        project = project or uuid.uuid4().hex
        self.state.put("projects", (project,), status="analyzing", source=asdict(source), error=None)
        try:
            source = source.with_keys(self.spark)
            self.state.put("projects", (project,), source=asdict(source))
            tables = source.list_tables(self.spark)
        except Exception as e:
            self.state.put("projects", (project,), status="failed", error=str(e)[:500])
            return project
        with ThreadPoolExecutor(self.settings.concurrency) as pool:
            list(pool.map(lambda t: self._analyze_table(project, source, t), tables))
        self._align(project, source)
        self.state.put("projects", (project,), status="ready")
        return project

    def _analyze_table(self, project: str, source: Source, table: str) -> None:
        try:
            df = self._snapshot(project, source, table, anew=True).read(self.spark)
            t = profile.full_table(df, table, source.primary_key(table), self.settings)
            rows = self._sample(project, source, table, t, anew=True)
            profile.enrich(t, rows, self.settings)
            self._compile(project, t, rows, self.gate.overrides(project, t))
            self.state.log(project, "analysis", table, rows=t.rows, columns=len(t.columns))
        except Exception as e:
            log.exception("analysis of %s", table)
            self.state.put("tables", (project, table), status="failed", error=str(e)[:500])

    def _compile(self, project: str, t: TableProfile, rows, overrides: dict[str, ColumnClass], given=None, patch=None) -> tuple[CleaningPlan, QualityDiff]:
        classified = classify.classify(t, overrides, self.settings)
        plan = compiling.compile_plan(t.table, rows, classified, given, self.suggest, patch, self.settings)
        try:
            guard.validate(self.spark, compiling.assemble(plan), t.table, rows.schema)
        except guard.InvalidSql:
            plan = compiling.compile_plan(t.table, rows, classified, given, None, patch, self.settings)
            guard.validate(self.spark, compiling.assemble(plan), t.table, rows.schema)
        plan.overrides = {k: v.value for k, v in overrides.items()}
        diff = dryrun.dry_run(plan, rows, self.settings)
        self.state.put(
            "tables", (project, t.table), status="analyzed", profile=t.to_json(), plan=plan.to_json(), sql=compiling.assemble(plan), audit=compiling.audit(plan, classified),
            diff=asdict(diff), questions=answers.questions(classified), classes=classify.class_counts(classified), error=None,
        )
        return plan, diff

    def _align(self, project: str, source: Source) -> None:
        done = {e["key"][1]: e for e in self.state.all("tables") if e["key"][0] == project and e.get("status") == "analyzed"}
        profiles = {k: TableProfile.from_json(e["profile"]) for k, e in done.items()}
        groups = consistency.find_groups(profiles)
        for table in sorted({t for g in groups for t in g.to_patch}):
            before = {k: v for k, v in self.state.get("tables", (project, table)).items() if k != "key"}
            try:
                t = profiles[table]
                rows = self._sample(project, source, table, t)
                overrides = {k: ColumnClass(v) for k, v in json.loads(before["plan"])["overrides"].items()}
                _, diff = self._compile(project, t, rows, overrides, patch=consistency.patcher(groups, table))
                if not diff.safe:
                    self.state.put("tables", (project, table), **before)
            except Exception:
                log.exception("alignment of %s", table)
                self.state.put("tables", (project, table), **before)
        self.state.put("projects", (project,), cross_table=consistency.summary(groups))

    def _source(self, project: str) -> Source:
        p = self.state.get("projects", (project,))
        return Source(**{k: tuple(map(tuple, v)) if isinstance(v, list) else v for k, v in p["source"].items()})

    # Review

    def status(self, project: str) -> dict:
        p = self.state.get("projects", (project,))
        if p is None:
            raise LookupError(project)
        tables = [e for e in self.state.all("tables") if e["key"][0] == project]
        return p | {"tables": {e["key"][1]: {k: e.get(k) for k in ("status", "error", "questions", "classes")} for e in tables}}

    def table_detail(self, project: str, table: str) -> dict:
        got = self.state.get("tables", (project, table))
        if got is None:
            raise LookupError(table)
        return got

    # Approval and loading

    def approve(self, project: str, tables: list[str] | None = None, given: dict[str, dict[str, str]] | None = None) -> dict[str, str]:
        """Compile the answers into the plans, check them again, lock and load.  Unsafe tables fail
        by themselves."""
        p = self.state.get("projects", (project,))
        if p is None or p["status"] not in ("ready", "completed"):
            raise NotReady(f"project is {p and p['status']}")
        source = self._source(project)
        every = [e["key"][1] for e in self.state.all("tables") if e["key"][0] == project and e.get("status") in ("analyzed", "cold_start_done")]
        self.state.put("projects", (project,), status="approving")
        out = {t: self._approve_table(project, source, t, (given or {}).get(t, {})) for t in tables or every}
        bad = [t for t, s in out.items() if s != "cold_start_done"]
        self.state.put("projects", (project,), status="completed", error=f"failed: {', '.join(bad)}" if bad else None)
        return out

    def _approve_table(self, project: str, source: Source, table: str, given: dict[str, str]) -> str:
        try:
            entry = self.table_detail(project, table)
            t = TableProfile.from_json(entry["profile"])
            plan = CleaningPlan.from_json(entry["plan"])
            self.state.put("tables", (project, table), status="cold_start_running")
            overrides = {c: e for c, a in given.items() if (e := answers.apply_answer(t.column(c), a, self.settings.mode == "parity", self.settings))}
            plan.expressions = [overrides.get(e.column, e) for e in plan.expressions]
            if any(e.source == "deterministic_fallback" for e in overrides.values()):
                raise NotReady("an answered column fell back")
            rows = self._sample(project, source, table, t)
            guard.validate(self.spark, compiling.assemble(plan), table, rows.schema)
            diff = dryrun.dry_run(plan, rows, self.settings)
            if not diff.safe:
                raise NotReady("; ".join(diff.warnings))
            self.state.write_memory(project, "Business_Logic", f"cleaning_script_{table}", plan.to_json())
            return self._load(project, source, table, plan, diff)
        except Exception as e:
            self.state.put("tables", (project, table), status="failed", error=str(e)[:500])
            self.state.log(project, "approval", table, error=str(e)[:500])
            return "failed"

    def _load(self, project: str, source: Source, table: str, plan: CleaningPlan, diff: QualityDiff | None) -> str:
        self.state.put("sync", (project, table), status="in_progress")
        pinned = self._snapshot(project, source, table)
        columns = {c.lower() for e in plan.expressions for c in (e.column, *e.names)}
        row = None if source.primary_key(table) else next(n for n in (f"_row{k or ''}" for k in range(len(columns) + 1)) if n not in columns)
        rows = pinned.numbered(self.spark, row) if row else pinned.read(self.spark)
        report = self._cache(project).load(plan, rows, diff, self.settings, row)
        for w in report.warnings:
            self.state.write_memory(project, "Audit_Log", f"load_{table}", w)
        before = (self.state.get("sync", (project, table)) or {}).get("snapshot")
        self.state.put("sync", (project, table), status="completed", last_row_count=report.cache_rows, warnings=report.warnings, snapshot=asdict(pinned))
        if before and before["folder"] != pinned.folder:
            snapshots.drop(self.spark, snapshots.Snapshot.of(before))
        self.state.put("tables", (project, table), status="cold_start_done", error=None)
        return "cold_start_done"

    def resume(self) -> list[str]:
        """Load again every table whose load was cut off, from its locked plan."""
        out = []
        for e in self.state.all("sync"):
            if e["status"] != "in_progress":
                continue
            project, table = e["key"]
            locked = self.state.read_memory(project, "Business_Logic", f"cleaning_script_{table}")
            p = self.state.get("projects", (project,))
            if locked and p:
                self._load(project, self._source(project), table, CleaningPlan.from_json(locked), None)
                out.append(table)
        return out

    def _cache(self, project: str) -> Cache:
        return Cache(self.spark, f"{self.folder}/cache/{project}")

    def diff_index(self, project: str, table: str) -> diffindex.DiffIndex:
        """The changed rows of the live version, compared with the rows that it was loaded from; written
        at the first call.  Tables without a key are paired by the rows' places, which the cache
        carries."""
        entry = self.table_detail(project, table)
        if entry["status"] != "cold_start_done":
            raise NotReady(f"table is {entry['status']}")
        source, cache = self._source(project), self._cache(project)
        live = cache.pointer(table)
        index = diffindex.DiffIndex(self.spark, f"{cache.root}/{table}/diff/{live['path'].rsplit('/', 1)[1]}")
        if not index.load():
            pinned = snapshots.Snapshot.of(self.state.get("sync", (project, table))["snapshot"])
            row = live.get("row")
            before = pinned.numbered(self.spark, row) if row else pinned.read(self.spark)
            index.build(rowdiff.changed_rows(before, cache.read(table, rows=True), row or source.primary_key(table), bool(row)))
        return index

    def diff(self, project: str, table: str, page: int = 1, page_size: int = 50) -> rowdiff.DiffPage:
        page, page_size = max(page, 1), page_size if page_size >= 1 else 50
        index = self.diff_index(project, table)
        pinned = snapshots.Snapshot.of(self.state.get("sync", (project, table))["snapshot"])
        return rowdiff.page_of(index.page(page, page_size), index.total, pinned.empty(self.spark), self._cache(project).read(table), page, page_size)
