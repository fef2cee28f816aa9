"""Doc comments as column expressions: tags, parameter types, templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TYPE = r"((?:[^\s<({]|<[^>]*>|\([^)]*\)|\{[^}]*\})+)"


def is_doc(comment: Column) -> Column:
    return comment.startswith("/**")


def lines(comment: Column) -> Column:
    """Lines without comment marks and outer white space."""
    body = F.regexp_replace(F.regexp_replace(comment, r"^/\*\*", ""), r"\*/$", "")
    return F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*\*?\s*", ""))), lambda x: x != "")


def params(comment: Column) -> Column:
    """Array of (type, name) from @param lines."""
    tagged = F.filter(lines(comment), lambda x: x.rlike(rf"^@param\s+{_TYPE}\s+(?:&|\.\.\.)?\$\w+"))
    return F.transform(tagged, lambda x: F.struct(F.regexp_extract(x, rf"^@param\s+{_TYPE}", 1).alias("type"), F.regexp_extract(x, r"\$(\w+)", 1).alias("name")))


def tag_type(comment: Column, tag: str) -> Column:
    """Type of the first @tag line, null without one."""
    found = F.filter(lines(comment), lambda x: x.rlike(rf"^@{tag}\s+\S"))
    return F.when(F.size(found) > 0, F.regexp_extract(F.get(found, F.lit(0)), rf"^@{tag}\s+{_TYPE}", 1))


def throws(comment: Column) -> Column:
    return F.transform(F.filter(lines(comment), lambda x: x.rlike(r"^@(throws|exception)\s+\S")), lambda x: F.regexp_extract(x, r"^@\w+\s+(\S+)", 1))


def templates(comment: Column) -> Column:
    """Array of (name, bound) from @template lines."""
    tagged = F.filter(lines(comment), lambda x: x.rlike(r"^@template\s+\w+"))
    bound = lambda x: F.regexp_extract(x, r"\sof\s+(\S+)", 1)
    return F.transform(tagged, lambda x: F.struct(F.regexp_extract(x, r"^@template\s+(\w+)", 1).alias("name"), F.when(bound(x) != "", bound(x)).alias("bound")))


def flag(comment: Column, tag: str) -> Column:
    return F.exists(lines(comment), lambda x: F.lower(x).rlike(rf"^\{{?@{tag}\b"))


def substitute(t: Column, bindings: Column) -> Column:
    """A type with template names replaced by bindings (a map): names, ?names, members of unions and type arguments."""
    one = lambda x: F.coalesce(F.try_element_at(bindings, x), x)
    pieces = F.regexp_extract_all(t, F.lit(r"([\\\w]+|[^\\\w]+)"), 1)
    return F.array_join(F.transform(pieces, one), "")
