"""Cohort queries: a predicate tree over containers, subjects, samples and phenotypes, as Columns and semi-joins.

NULL follows SQL: a comparison with null is unknown and doesn't select. Links: samples name a subject and
a container; phenotypes name a subject. Phenotype leaves are allowed under AND only.
"""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

OPERATORS = ("eq", "ne", "lt", "gt", "le", "ge", "in", "like", "exists")
TABLES = ("containers", "subjects", "samples")
MOST, USUAL = 1000, 100


class Predicate:
    def __and__(self, other: Predicate) -> All:
        return All((*(self.children if isinstance(self, All) else (self,)), other))

    def __or__(self, other: Predicate) -> Any_:
        return Any_((*(self.children if isinstance(self, Any_) else (self,)), other))

    def __invert__(self) -> Not:
        return Not(self)


@dataclass(frozen=True)
class Leaf(Predicate):
    """table: containers, subjects, samples or phenotypes; field: a column, or a phenotype's name."""

    table: str
    field: str
    op: str
    value: Any = None

    def __post_init__(self) -> None:
        if self.table not in (*TABLES, "phenotypes") or self.op not in OPERATORS or not self.field:
            raise ValueError(f"no such predicate: {self.table}.{self.field} {self.op}")
        if self.op == "in" and (not isinstance(self.value, (list, tuple)) or not self.value):
            raise ValueError("in needs a list that isn't empty")

    def column(self, c: Column) -> Column:
        v = self.value
        return {
            "eq": lambda: c == v, "ne": lambda: c != v, "lt": lambda: c < v, "gt": lambda: c > v, "le": lambda: c <= v, "ge": lambda: c >= v,
            "in": lambda: c.isin(list(v)), "like": lambda: c.like(v), "exists": lambda: c.isNotNull() if v in (None, True) else c.isNull(),
        }[self.op]()


def container(field: str, op: str, value: Any = None) -> Leaf:
    return Leaf("containers", field, op, value)


def subject(field: str, op: str, value: Any = None) -> Leaf:
    return Leaf("subjects", field, op, value)


def sample(field: str, op: str, value: Any = None) -> Leaf:
    return Leaf("samples", field, op, value)


def phenotype(name: str, op: str, value: Any = None) -> Leaf:
    return Leaf("phenotypes", name, op, value)


def _has_phenotype(p: Predicate) -> bool:
    return p.table == "phenotypes" if isinstance(p, Leaf) else any(map(_has_phenotype, p.children))


@dataclass(frozen=True)
class All(Predicate):
    children: tuple[Predicate, ...]

    def __post_init__(self) -> None:
        if not self.children:
            raise ValueError("and needs children")


@dataclass(frozen=True)
class Any_(Predicate):
    children: tuple[Predicate, ...]

    def __post_init__(self) -> None:
        if not self.children or any(map(_has_phenotype, self.children)):
            raise ValueError("or needs children, none of them a phenotype")


@dataclass(frozen=True)
class Not(Predicate):
    child: Predicate

    def __post_init__(self) -> None:
        if _has_phenotype(self.child):
            raise ValueError("not doesn't take a phenotype")

    @property
    def children(self) -> tuple[Predicate, ...]:
        return (self.child,)


def _leaves(p: Predicate) -> list[Leaf]:
    return [p] if isinstance(p, Leaf) else [x for c in p.children for x in _leaves(c)]


@dataclass(frozen=True)
class Cohort:
    """tables: containers (container_id), subjects (subject_id), samples (sample_id, subject_id, container_id), phenotypes (subject_id, name, value)."""

    tables: dict[str, DataFrame]
    select: str
    predicate: Predicate | None = None
    order_by: tuple[tuple[str, bool], ...] = ()
    limit: int = USUAL
    cursor: str | None = None

    def __post_init__(self) -> None:
        if self.select not in TABLES or not 1 <= self.limit <= MOST:
            raise ValueError("select containers, subjects or samples, 1 to 1000 of them")

    @property
    def key(self) -> str:
        return f"{self.select[:-1]}_id"

    def rows(self) -> DataFrame:
        """All rows of the selected table that match, once each."""
        own = self.tables[self.select]
        for p in self.predicate.children if isinstance(self.predicate, All) else (self.predicate,) if self.predicate else ():
            own = self._where(own, p)
        return own

    def _where(self, own: DataFrame, p: Predicate) -> DataFrame:
        if isinstance(p, All):
            for c in p.children:
                own = self._where(own, c)
            return own
        if isinstance(p, Leaf) and p.table == "phenotypes":
            has = self.tables["phenotypes"].where((F.col("name") == p.field) & p.column(F.col("value"))).select("subject_id")
            return self._linked(own, "subjects", has)
        tables = {x.table for x in _leaves(p)}
        if tables == {self.select}:
            return own.where(self._column(p, lambda x: F.col(x.field)))
        if len(tables) == 1:
            other = next(iter(tables))
            return self._linked(own, other, self.tables[other].where(self._column(p, lambda x: F.col(x.field))).select(f"{other[:-1]}_id"))
        return self._mixed(own, p)

    def _mixed(self, own: DataFrame, p: Predicate) -> DataFrame:
        """A tree over several tables: samples with the columns of their subject and container decide."""
        wide = self.tables["samples"]
        wide = wide.select(*[F.col(c).alias(f"samples.{c}") for c in wide.columns])
        for t in ("subjects", "containers"):
            other = self.tables[t].select(*[F.col(c).alias(f"{t}.{c}") for c in self.tables[t].columns])
            key = f"{t[:-1]}_id"
            wide = wide.join(other, F.col(f"`samples.{key}`") == F.col(f"`{t}.{key}`"), "left")
        found = wide.where(self._column(p, lambda x: F.col(f"`{x.table}.{x.field}`")))
        name = f"samples.{self.key}"
        return own.join(found.select(F.col(f"`{name}`").alias(self.key)), self.key, "left_semi")

    def _linked(self, own: DataFrame, other: str, ids: DataFrame) -> DataFrame:
        key = f"{other[:-1]}_id"
        if key in own.columns:
            return own.join(ids, key, "left_semi")
        links = self.tables["samples"].join(ids, key, "left_semi").select(self.key)
        return own.join(links, self.key, "left_semi")

    def _column(self, p: Predicate, name) -> Column:
        if isinstance(p, Leaf):
            return p.column(name(p))
        parts = [self._column(c, name) for c in p.children]
        if isinstance(p, Not):
            return ~parts[0]
        out = parts[0]
        for x in parts[1:]:
            out = out & x if isinstance(p, All) else out | x
        return out

    def count(self) -> DataFrame:
        """One row, n: how many match."""
        return self.rows().agg(F.count("*").alias("n"))

    def page(self) -> DataFrame:
        """The page's rows in order: by order_by, then by key, after the cursor. Top-k per partition, no full sort."""
        order = [*self.order_by, (self.key, False)]
        rows = self.rows()
        if self.cursor:
            after = json.loads(base64.urlsafe_b64decode(self.cursor))
            cond = F.lit(False)
            same = F.lit(True)
            for (c, desc), v in zip(order, after, strict=True):
                x = F.col(c)
                beyond = F.lit(False) if v is None and desc else x.isNotNull() if v is None else (x < v) | x.isNull() if desc else x > v
                cond = cond | (same & beyond)
                same = same & x.eqNullSafe(F.lit(v))
            rows = rows.where(cond)
        return rows.orderBy(*[F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_first() for c, d in order]).limit(self.limit)

    def fetch(self) -> tuple[list[Row], str | None]:
        """A page (1000 rows at most) and the cursor of the next, None after the last."""
        rows = self.page().collect()
        if len(rows) < self.limit:
            return rows, None
        last = [rows[-1][c] for c, _ in (*self.order_by, (self.key, False))]
        return rows, base64.urlsafe_b64encode(json.dumps(last).encode()).decode()
