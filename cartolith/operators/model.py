"""The tables that queries run over, and the filter that selects documents."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEARCHED = ("publication_number", "title", "applicant", "category", "tags_text")


@dataclass(frozen=True)
class Tables:
    """documents(research_id, patent_id, position, year, ...), their organizations, and organization names."""

    documents: DataFrame
    document_organizations: DataFrame
    organizations: DataFrame


@dataclass(frozen=True)
class DocumentFilter:
    """Conditions on documents. None leaves a condition out; an empty list of values matches nothing."""

    research_id: str | None = None
    query: str = ""
    year_from: int | None = None
    year_to: int | None = None
    statuses: Sequence[str] | None = None
    analysis_states: Sequence[str] | None = None
    similarity: int | None = None
    concept_level: int | None = None
    tech_cluster_id: str | None = None
    problem_cluster_id: str | None = None
    organization_ids: Sequence = field(default=None)  # type: ignore[assignment]

    def without_cell(self) -> DocumentFilter:
        return replace(self, similarity=None, concept_level=None, tech_cluster_id=None, problem_cluster_id=None)

    def without_organizations(self) -> DocumentFilter:
        return replace(self, organization_ids=None)

    def without_years(self) -> DocumentFilter:
        return replace(self, year_from=None, year_to=None)

    def condition(self, columns: Sequence[str]) -> Column:
        """All conditions but the organizations' as one Column, which reaches the scan."""
        out = []
        if self.research_id is not None:
            out.append(F.col("research_id") == self.research_id)
        if self.query.strip():
            out.append(search(self.query, [c for c in SEARCHED if c in columns]))
        if self.year_from is not None:
            out.append(F.col("year") >= self.year_from)
        if self.year_to is not None:
            out.append(F.col("year") <= self.year_to)
        for column, values in (("legal_status_category", self.statuses), ("analysis_state", self.analysis_states)):
            if values is not None:
                out.append(F.col(column).isin(list(values)) if values else F.lit(False))
        for column in ("similarity", "concept_level"):
            if getattr(self, column) is not None:
                out.append(F.col(column) == getattr(self, column))
        for column in ("tech_cluster_id", "problem_cluster_id"):
            if getattr(self, column) is not None:
                out.append(F.col(column).cast("string") == str(getattr(self, column)))
        return reduce(and_, out, F.lit(True))

    def apply(self, tables: Tables) -> DataFrame:
        """The documents that match, each once: organizations are tested by a semi-join."""
        found = tables.documents.where(self.condition(tables.documents.columns))
        if self.organization_ids is not None:
            keys = [c for c in ("research_id", "patent_id") if c in tables.document_organizations.columns]
            held = tables.document_organizations.where(F.col("organization_id").isin(list(self.organization_ids)) if len(self.organization_ids) else F.lit(False))
            found = found.join(held.select(*keys), keys, "left_semi")
        return found


def ascii_lower(col: Column) -> Column:
    """Lower case of A to Z alone, as the search compares."""
    return F.translate(col, UPPER, LOWER)


def search(needle: str, columns: Sequence[str]) -> Column:
    """Any column is LIKE the needle; % and _ in it stay wildcards and a backslash is itself."""
    pattern = "%" + needle.strip().translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\") + "%"
    return reduce(or_, [F.coalesce(ascii_lower(F.col(c)).like(pattern), F.lit(False)) for c in columns], F.lit(False))


def registered() -> Column:
    return F.col("legal_status_category") == "rights_acquired"


def ready() -> Column:
    return F.col("analysis_state") == "ready"


def high_threat() -> Column:
    return ready() & (F.col("similarity") >= 4) & (F.col("concept_level") >= 4)
