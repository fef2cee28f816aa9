"""Fact tables of a code base: what every operator takes.

A Facts object names DataFrames. Only the columns listed here are used; extra
columns pass through or are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PARAM = "struct<name:string,type:string,nullable:boolean,has_default:boolean,is_variadic:boolean>"

#: Columns of the tables.
SCHEMAS: dict[str, str] = {
    "projects": "root string",
    "classes": "fqn string, file_path string, extends string, is_abstract boolean, is_final boolean",
    "implements": "class string, interface string",
    "uses": "class string, trait string, use_ord int",
    "interfaces": "fqn string, file_path string",
    "traits": "fqn string, file_path string",
    "functions": "fqn string, file_path string",
    "methods": f"owner string, owner_kind string, name string, visibility string, is_static boolean, return_type string, params array<{PARAM}>, file_path string, line int",
    "properties": "owner string, name string, type string, visibility string, line int",
    "calls": "call_id long, caller string, caller_class string, callee_name string, call_type string, receiver string, target string, confidence double, method string, file_path string, line int, args array<string>",
}


@dataclass(frozen=True)
class Facts:
    classes: DataFrame
    methods: DataFrame
    calls: DataFrame
    implements: DataFrame
    uses: DataFrame
    interfaces: DataFrame
    traits: DataFrame
    functions: DataFrame
    properties: DataFrame
    projects: DataFrame
    extra: dict[str, DataFrame] = field(default_factory=dict)

    def with_(self, **tables: DataFrame) -> Facts:
        return replace(self, **tables)


def last_write_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the one that comes last by order. One shuffle, on the key."""
    columns = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("last"))
    return last.select(*key, *(F.col(f"last.{c}").alias(c) for c in columns))
