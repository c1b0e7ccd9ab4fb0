"""Metadata that travels between the steps; everything converts to and from JSON."""

from __future__ import annotations

import enum
import json
from dataclasses import asdict, dataclass, field


class ColumnClass(str, enum.Enum):
    PII = "PII"
    IDENTIFIER = "IDENTIFIER"
    FREE_TEXT = "FREE_TEXT"
    STRUCTURAL = "STRUCTURAL"
    OBSERVE = "OBSERVE"
    CLEAN_DET = "CLEAN_DET"
    CLEAN_AMBIG = "CLEAN_AMBIG"


@dataclass
class ColumnProfile:
    name: str
    declared_type: str
    null_pct: float = 0.0
    distinct_count: int = 0
    distinct_ratio: float = 0.0
    is_primary_key: bool = False
    sample_values: list[str] = field(default_factory=list)
    issues: list[str] = field(default_factory=list)
    issue_ratios: dict[str, float] = field(default_factory=dict)
    currency_symbols: list[str] = field(default_factory=list)
    date_format: str | None = None
    sentinel_pct: float = 0.0
    signature: str | None = None
    flags: dict[str, bool] = field(default_factory=dict)


@dataclass
class TableProfile:
    table: str
    rows: int
    columns: list[ColumnProfile]
    sync_mode: str = "append_only"
    primary_key: str | None = None
    tracking_column: str | None = None

    def column(self, name: str) -> ColumnProfile:
        return next(c for c in self.columns if c.name == name)

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> "TableProfile":
        raw = json.loads(text)
        raw["columns"] = [ColumnProfile(**c) for c in raw["columns"]]
        return TableProfile(**raw)


@dataclass
class Classified:
    column: ColumnProfile
    kind: ColumnClass
    reasons: list[str] = field(default_factory=list)


@dataclass
class Expression:
    """One source column's outputs: names and Spark SQL, one to one."""

    column: str
    names: list[str]
    sql: list[str]
    source: str = "passthrough"
    issues: list[str] = field(default_factory=list)
    note: str | None = None
    question: str | None = None
    options: list[str] = field(default_factory=list)


@dataclass
class CleaningPlan:
    table: str
    expressions: list[Expression]
    overrides: dict[str, str] = field(default_factory=dict)  # column classes set from outside

    @property
    def items(self) -> list[tuple[str, str]]:
        return [(n, s) for e in self.expressions for n, s in zip(e.names, e.sql)]

    @property
    def source(self) -> str:
        kinds = {e.source for e in self.expressions}
        for k in ("suggested", "deterministic_fallback", "deterministic"):
            if k in kinds:
                return k
        return "passthrough"

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> "CleaningPlan":
        raw = json.loads(text)
        return CleaningPlan(raw["table"], [Expression(**e) for e in raw["expressions"]], raw["overrides"])


@dataclass
class QualityDiff:
    table: str
    rows_before: int
    rows_after: int
    columns: list[dict]
    warnings: list[str]
    safe: bool


@dataclass(frozen=True)
class Member:
    table: str
    column: str
    form: str
    rows: int
    is_primary_key: bool = False
    declared_type: str = ""


@dataclass
class Group:
    kind: str
    label: str
    canonical: str
    reason: str
    members: list[Member]

    @property
    def matching(self) -> list[str]:
        if self.kind == "id":
            return []
        return sorted({m.table for m in self.members if m.form == self.canonical})

    @property
    def to_patch(self) -> list[str]:
        return sorted({m.table for m in self.members if self.kind == "id" or m.form != self.canonical})
