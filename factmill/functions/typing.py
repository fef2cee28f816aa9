"""Types as text: kinds, parts, rendering and compatibility, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Built-in type names (fixed values).
BUILTIN = ("int", "integer", "float", "double", "string", "bool", "boolean", "array", "object", "callable", "iterable", "void", "null", "mixed", "never", "resource")
_KINDS = {"void": "void_type", "never": "never", "mixed": "mixed", "self": "self_type", "static": "static_type", "parent": "parent_type"}
_ALIASES = (("int", "integer"), ("bool", "boolean"), ("float", "double"))


def kind(t: Column) -> Column:
    """The kind of a type: empty is mixed; then ?T, unions, intersections, T[], generics, keywords, simple names."""
    t = F.trim(t)
    generic = t.rlike("^[^<]+<.*>$")
    out = F.when(t.isNull() | (t == ""), "mixed").when(t.startswith("?"), "nullable").when(F.instr(F.regexp_replace(t, "<.*>", ""), "|") > 0, "union_type").when(F.instr(F.regexp_replace(t, "<.*>", ""), "&") > 0, "intersection")
    out = out.when(t.endswith("[]") | t.rlike("^array<.*>$"), "array_type").when(generic, "generic")
    for word, name in _KINDS.items():
        out = out.when(F.lower(t) == word, name)
    return out.otherwise("simple")


def base(t: Column) -> Column:
    """The name without ?, [] and type arguments; null for unions and intersections."""
    k = kind(t)
    return F.when(k.isin("union_type", "intersection"), None).when(k == "mixed", "mixed").otherwise(F.regexp_replace(F.regexp_replace(F.trim(t), "^\\?|\\[\\]$", ""), "<.*>$", ""))


def parts(t: Column) -> Column:
    """Members of a union or intersection; nothing for other types."""
    return F.when(kind(t).isin("union_type", "intersection"), F.transform(F.split(F.trim(t), "[|&]"), lambda x: F.trim(x))).otherwise(F.array().cast("array<string>"))


def is_builtin(t: Column) -> Column:
    return F.lower(t).isin(*BUILTIN)


def render(kind_: Column, base_: Column, parts_: Column) -> Column:
    return F.when(kind_ == "nullable", F.concat(F.lit("?"), base_)).when(kind_ == "union_type", F.array_join(parts_, "|")).when(kind_ == "intersection", F.array_join(parts_, "&")).when(kind_ == "array_type", F.concat(base_, F.lit("[]"))).otherwise(base_)


def canonical(t: Column) -> Column:
    """Comparable text: parts sorted, ?T as T|null."""
    ps = F.when(F.startswith(t, F.lit("?")), F.array(F.substring(t, F.lit(2), F.length(t)), F.lit("null"))).otherwise(parts(t))
    joined = lambda sep: F.array_join(F.array_sort(ps), sep)
    return F.when(F.size(ps) == 0, F.trim(t)).when(kind(t) == "intersection", joined("&")).otherwise(joined("|"))


def _alias(a: Column, b: Column) -> Column:
    out = F.lit(False)
    for x, y in _ALIASES:
        out = out | (a.isin(x, y) & b.isin(x, y))
    return out


def argument_fits(arg: Column, param: Column, subtype: Column | None = None) -> Column:
    """Whether an argument's type fits a parameter's; subtype tells if the argument's class is one of the parameter's.

    First rule that applies: mixed; self, static, parent on either side; equal
    bases; a union part equal to the argument; int for float and the aliases;
    two built-ins otherwise don't fit; two classes fit as subtypes; else no.
    """
    a, p = base(arg), base(param)
    special = ("self", "static", "parent")
    return (
        F.when(kind(param) == "mixed", True)
        .when(F.coalesce(F.lower(a).isin(*special), F.lit(False)) | F.coalesce(F.lower(p).isin(*special), F.lit(False)), True)
        .when(F.coalesce(a == p, F.lit(False)), True)
        .when(F.coalesce(F.array_contains(parts(param), a), F.lit(False)), True)
        .when(F.coalesce(a.isin("int", "integer") & (p == "float"), F.lit(False)) | F.coalesce(_alias(a, p), F.lit(False)), True)
        .when(F.coalesce(is_builtin(a) & is_builtin(p), F.lit(False)), False)
        .when(F.coalesce(~is_builtin(a) & ~is_builtin(p), F.lit(False)), F.lit(False) if subtype is None else F.coalesce(subtype, F.lit(False)))
        .otherwise(False)
    )


def null_fits(param: Column) -> Column:
    """Whether a literal null may be passed."""
    return kind(param).isin("nullable", "mixed") | F.coalesce(F.lower(base(param)) == "null", F.lit(False)) | F.array_contains(parts(param), "null")


def return_fits(value: Column, declared: Column) -> Column:
    """Whether a returned literal's type fits the declared one."""
    v, d = base(value), base(declared)
    suffix = d.endswith(F.concat(F.lit("\\"), v)) | v.endswith(F.concat(F.lit("\\"), d))
    one = lambda x: (x == v) | _alias(x, v) | (F.lower(x) == "mixed")
    return (
        F.when(kind(declared) == "mixed", True)
        .when((kind(declared) == "nullable") & (v == "null"), True)
        .when(kind(declared) == "union_type", F.exists(parts(declared), one))
        .otherwise(F.coalesce((v == d) | suffix | _alias(v, d), F.lit(False)))
    )
