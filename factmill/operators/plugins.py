"""Plugins: named functions from facts to edges of the call graph, and what their edges change.

A plugin takes Facts and returns edges(caller, target); it is a plan like any
other. Names that nobody registered give a row of warning instead of an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..facts import Facts
from .fixpoint import cut, nearest, reach
from .resolve import with_synthetic

Plugin = Callable[[Facts], DataFrame]
#: Registered plugins by name.
PLUGINS: dict[str, Plugin] = {}


#: Plugins whose edges are different and have no nulls, so that run() need not shuffle them.
_DISTINCT: set[Plugin] = set()


def plugin(name: str, distinct: bool = False) -> Callable[[Plugin], Plugin]:
    """Register a plugin; a later one of the same name replaces it. distinct: it gives no edge twice, and none with a null."""

    def register(f: Plugin) -> Plugin:
        PLUGINS[name] = f
        if distinct:
            _DISTINCT.add(f)
        return f

    return register


@plugin("events", distinct=True)
def events(facts: Facts) -> DataFrame:
    """From where an event is dispatched to its handlers, by the extra tables dispatches and event_maps.

    Those of * are each caller with each handler, as many as there are results; they are made last and not shuffled.
    """
    from ..sources.php.facts import event_sites, spread

    edges, sites, every = event_sites(facts.extra)
    callers = sites.where("caller IS NOT NULL").select("caller").distinct()
    return edges.where("caller IS NOT NULL").select("caller", "target").distinct().unionByName(spread(callers, every))


def _edges(f: Plugin, facts: Facts) -> DataFrame:
    found = f(facts).select("caller", "target")
    return found if f in _DISTINCT else found.where("caller IS NOT NULL AND target IS NOT NULL").distinct()


def run(facts: Facts, wanted: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """(edges(plugin, caller, target), warnings(plugin, message)) of the plugins of these names, in any order, each once."""
    spark = facts.classes.sparkSession
    wanted = sorted(set(wanted))
    made = [_edges(PLUGINS[name], facts).select(F.lit(name).alias("plugin"), "caller", "target") for name in wanted if name in PLUGINS]
    none = spark.createDataFrame([], "plugin string, caller string, target string")
    warnings = spark.createDataFrame([(name, f"unknown plugin '{name}'") for name in wanted if name not in PLUGINS], "plugin string, message string")
    return reduce(DataFrame.unionByName, made, none), warnings


def merged(resolved: DataFrame, edges: DataFrame) -> DataFrame:
    """Resolved calls with the plugins' edges."""
    return with_synthetic(resolved, edges.select("caller", "target").distinct())


def reach_more(edges: DataFrame, added: DataFrame, reached: DataFrame) -> DataFrame:
    """(node) that edges(src, dst) reach once added(src, dst) join them, beyond reached(node), which was closed before.

    Starts from the added edges alone: what was reached is neither walked nor read
    again but to tell where they begin and what is known.
    """
    seeds = added.join(reached.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
    return reach(edges.select("src", "dst").unionByName(added.select("src", "dst")), seeds, known=reached)


def open_after(opened: DataFrame, free: DataFrame, added: DataFrame, called: DataFrame) -> DataFrame:
    """(node, depth) that functions nobody calls lead to along free(src, dst), once added(src, dst) have joined them.

    opened(node, depth) is that set before, and called(node) what has callers now. An
    added edge opens what it leads to, and shuts what only seemed uncalled. Only
    what the added edges lead to is decided anew: from its own uncalled functions, and
    from open ones outside that have an edge into it.
    """
    every = cut(free.select("src", "dst").unionByName(added.select("src", "dst")).distinct())
    touched = cut(reach(every, added.select(F.col("dst").alias("node")).distinct()))
    outside = opened.select("node", "depth").join(touched, "node", "left_anti")
    roots = added.select(F.col("src").alias("node")).unionByName(every.select(F.col("src").alias("node"))).distinct().join(touched, "node", "left_semi").join(called, "node", "left_anti").select("node", F.lit(0).alias("depth"))
    # Callers that only the added edges bring in may be uncalled themselves.
    fresh = added.select(F.col("src").alias("node")).distinct().join(touched, "node", "left_anti").join(called, "node", "left_anti").join(outside.select("node"), "node", "left_anti").select("node", F.lit(0).alias("depth"))
    rim = outside.unionByName(fresh)
    into = every.join(touched.select(F.col("node").alias("dst")), "dst", "left_semi")
    entered = into.join(rim.select(F.col("node").alias("src"), "depth"), "src").groupBy(F.col("dst").alias("node")).agg((F.min("depth") + 1).alias("depth"))
    inner = into.join(touched.select(F.col("node").alias("src")), "src", "left_semi").select("src", "dst")
    return rim.unionByName(nearest(inner, roots.unionByName(entered)).select("node", "depth"))
