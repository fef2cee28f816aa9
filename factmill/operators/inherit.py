"""Inheritance: ancestors, members with overriding, subtypes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..facts import Facts
from .fixpoint import chains, cut, grown


def ancestor_chain(facts: Facts) -> DataFrame:
    """(class, ancestor, dist): nearest first; an unknown external parent ends a chain, and is part of it.

    Computed once: facts.extra may hold the table as "ancestors".
    """
    if "ancestors" in facts.extra:
        return facts.extra["ancestors"]
    return chains(facts.classes.select(F.col("fqn").alias("node"), F.col("extends").alias("parent"))).withColumnRenamed("node", "class")


def lineage(facts: Facts, ancestors: DataFrame | None = None) -> DataFrame:
    """ancestor_chain and each class itself at distance 0."""
    ancestors = ancestor_chain(facts) if ancestors is None else ancestors
    return facts.classes.select(F.col("fqn").alias("class"), F.col("fqn").alias("ancestor"), F.lit(0).alias("dist")).unionByName(ancestors)


def sources(facts: Facts) -> DataFrame:
    """(class, owner, rank): where a class has members from, least rank first: itself, ancestors from the nearest on, then traits, those of the farthest first.

    A trait fills a hole only after the parent's members were copied, so an
    inherited member beats one of the class's own trait. Ranks of one class differ.
    """
    lines = lineage(facts)
    own = lines.select("class", F.col("ancestor").alias("owner"), F.col("dist").cast("long").alias("rank"))
    used = lines.join(facts.uses.withColumnRenamed("class", "ancestor"), "ancestor").groupBy("class", "trait").agg(F.min(F.struct((-F.col("dist")).alias("near"), "use_ord")).alias("x"))
    nth = F.row_number().over(Window.partitionBy("class").orderBy("x.near", "x.use_ord", "trait"))  # as many as a class and its ancestors use
    return own.unionByName(used.select("class", F.col("trait").alias("owner"), (F.lit(1 << 32) + nth).alias("rank")))


def member_owners(facts: Facts, members: DataFrame) -> DataFrame:
    """(class, name, owner) of every member that a class has: the least rank of each name, a number that is combined before the shuffle."""
    ranked = cut(sources(facts))
    least = members.select("owner", "name").join(ranked, "owner").groupBy("class", "name").agg(F.min("rank").alias("rank"))
    return least.join(ranked, ["class", "rank"]).select("class", "name", "owner")


def _members(facts: Facts, members: DataFrame) -> DataFrame:
    """Each class's members, one of each name: owners are decided on keys alone, the rest is joined to them."""
    return member_owners(facts, members).join(members, ["owner", "name"]).select("class", *members.columns)


def all_methods(facts: Facts) -> DataFrame:
    return _members(facts, facts.methods)


def all_properties(facts: Facts) -> DataFrame:
    return _members(facts, facts.properties)


def method_overrides(facts: Facts) -> DataFrame:
    """(base, override): a method and one of the same name further down: of a subclass, an implementing or a using class."""
    ups = (
        ancestor_chain(facts).select("class", F.col("ancestor").alias("base_owner"))
        .unionByName(facts.implements.select("class", F.col("interface").alias("base_owner")))
        .unionByName(facts.uses.select("class", F.col("trait").alias("base_owner")))
    )
    base = facts.methods.select(F.col("owner").alias("base_owner"), "name")
    below = facts.methods.select(F.col("owner").alias("class"), "name")
    pairs = grown(ups).join(base, "base_owner").join(below, ["class", "name"])
    return pairs.select(F.concat_ws("::", "base_owner", "name").alias("base"), F.concat_ws("::", "class", "name").alias("override")).distinct()


def subtype_pairs(facts: Facts) -> DataFrame:
    """(class, supertype): ancestors and the direct interfaces only."""
    return ancestor_chain(facts).select("class", F.col("ancestor").alias("supertype")).unionByName(facts.implements.select("class", F.col("interface").alias("supertype"))).distinct()


def topological_order(facts: Facts) -> DataFrame:
    """(fqn, depth): parents come before their children when ordered by depth."""
    depth = ancestor_chain(facts).groupBy(F.col("class").alias("fqn")).agg(F.max("dist").alias("depth"))
    return facts.classes.select("fqn").join(depth, "fqn", "left").select("fqn", F.coalesce("depth", F.lit(0)).alias("depth"))


def with_stubs(facts: Facts, classes: DataFrame, methods: DataFrame) -> Facts:
    """facts with library classes and their methods, but only those whose names the code base doesn't declare."""
    known = facts.classes.select("fqn").unionByName(facts.interfaces.select("fqn")).unionByName(facts.traits.select("fqn"))
    new = classes.join(known, "fqn", "left_anti")
    theirs = methods.join(new.select(F.col("fqn").alias("owner")), "owner", "left_semi")
    return facts.with_(classes=facts.classes.unionByName(new, allowMissingColumns=True), methods=facts.methods.unionByName(theirs, allowMissingColumns=True))
