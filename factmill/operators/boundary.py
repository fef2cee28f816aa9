"""Calls across projects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..facts import Facts
from .fixpoint import cut


def file_project(files: DataFrame, projects: DataFrame, most: int = 500) -> DataFrame:
    """(file_path, project): the longest root that is a prefix of the path, without a separator test.

    Projects are broadcast if there are at most so many; beyond that, paths are
    joined with roots on each of their prefix lengths that occur as root lengths.
    """
    files, roots = files.select("file_path").distinct(), projects.select("root").distinct()
    if roots.limit(most + 1).count() <= most:
        met = files.join(F.broadcast(roots), F.col("file_path").startswith(F.col("root")))
    else:
        lengths = sorted(r[0] for r in roots.select(F.length("root")).distinct().collect())  # at most the longest path
        prefix = F.explode(F.transform(F.array(*map(F.lit, lengths)), lambda n: F.substring("file_path", F.lit(1), n)))
        met = files.select("file_path", prefix.alias("root")).distinct().join(roots, "root")
    return met.groupBy("file_path").agg(F.max_by("root", F.length("root")).alias("project"))


def class_project(facts: Facts) -> DataFrame:
    """(fqn, project) of classes, else functions; interfaces and traits have none."""
    owners = facts.classes.select("fqn", "file_path").unionByName(facts.functions.select("fqn", "file_path").join(facts.classes.select("fqn"), "fqn", "left_anti"))
    return owners.join(file_project(owners, facts.projects), "file_path").select("fqn", "project")


def boundary_calls(facts: Facts, resolved: DataFrame) -> DataFrame:
    """Resolved calls with caller_project and callee_project; calls that lack either are left out.

    Owners are written first, so that Spark knows their size: calls are wide, and
    are shuffled, most to the few traits that own what they call, only if there
    are too many classes for a broadcast.
    """
    at = cut(class_project(facts))
    mine, theirs = at.select(F.col("fqn").alias("caller_class"), F.col("project").alias("caller_project")), at.select(F.col("fqn").alias("target_owner"), F.col("project").alias("callee_project"))
    return resolved.where("target IS NOT NULL").join(mine, "caller_class").join(theirs, "target_owner")


def cross(boundary: DataFrame) -> DataFrame:
    return boundary.where("caller_project <> callee_project")


def api_surface(boundary: DataFrame) -> DataFrame:
    """(target, project, n_callers, callers): methods called from other projects."""
    return cross(boundary).groupBy("target", F.col("callee_project").alias("project")).agg(F.countDistinct("caller_project").alias("n_callers"), F.array_join(F.array_sort(F.collect_set("caller_project")), ",").alias("callers"))


def project_dependencies(boundary: DataFrame) -> DataFrame:
    return cross(boundary).groupBy("caller_project", "callee_project").agg(F.count(F.lit(1)).alias("n_calls"))


def boundary_summary(boundary: DataFrame) -> DataFrame:
    return cross(boundary).groupBy("caller_project", "callee_project").agg(F.count(F.lit(1)).alias("n_calls"), F.countDistinct("target").alias("n_api_methods"))


def boundary_totals(facts: Facts, boundary: DataFrame) -> DataFrame:
    own = F.col("caller_project") == F.col("callee_project")
    return boundary.agg(F.count_if(own).alias("same_project"), F.count_if(~own).alias("cross_project"), F.count(F.lit(1)).alias("total")).crossJoin(facts.projects.agg(F.count(F.lit(1)).alias("n_projects")))
