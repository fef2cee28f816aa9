"""Dead code: references, seeds, propagation, what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..facts import Facts
from .fixpoint import cut, grown, reach
from .inherit import method_overrides

#: Methods that live with their class (fixed values).
MAGIC = ("__construct", "__destruct", "__toString", "__invoke", "__clone")


def symbols(facts: Facts) -> DataFrame:
    """(fqn, kind, visibility) of everything that can be dead."""
    one = lambda df, kind, name="fqn": df.select(F.col(name).alias("fqn"), F.lit(kind).alias("kind"), F.lit("public").alias("visibility"))
    methods = facts.methods.select(F.concat_ws("::", "owner", "name").alias("fqn"), F.lit("method").alias("kind"), "visibility")
    properties = facts.properties.select(F.concat(F.col("owner"), F.lit("::$"), F.col("name")).alias("fqn"), F.lit("property").alias("kind"), "visibility")
    return one(facts.classes, "class").unionByName(one(facts.interfaces, "interface")).unionByName(one(facts.traits, "trait")).unionByName(one(facts.functions, "function")).unionByName(methods).unionByName(properties)


def references(facts: Facts, resolved: DataFrame) -> DataFrame:
    """(target, reason, is_weak): resolved calls and their classes, names of unresolved ones, and the hierarchy."""
    strong = lambda df, reason: df.select("target", F.lit(reason).alias("reason"), F.lit(False).alias("is_weak"))
    hit = resolved.where("target IS NOT NULL")
    return (
        strong(hit.select("target"), "resolved_call")
        .unionByName(strong(hit.where("target_owner <> target").select(F.col("target_owner").alias("target")), "static_access"))
        .unionByName(resolved.where("target IS NULL").select(F.col("callee_name").alias("target"), F.lit("unresolved_call").alias("reason"), F.lit(True).alias("is_weak")))
        .unionByName(strong(facts.classes.where("extends IS NOT NULL").select(F.col("extends").alias("target")), "inheritance"))
        .unionByName(strong(facts.implements.select(F.col("interface").alias("target")), "interface_impl"))
        .unionByName(strong(facts.uses.select(F.col("trait").alias("target")), "trait_use"))
        .distinct()
    )


def edges(facts: Facts) -> DataFrame:
    """(src, dst): what a living symbol keeps alive."""
    e = lambda df, src, dst: df.select(F.expr(src).alias("src"), F.expr(dst).alias("dst"))
    member = "concat_ws('::', owner, name)"
    kinds = facts.methods
    return (
        e(kinds, member, "owner")
        .unionByName(e(facts.properties, "concat(owner, '::$', name)", "owner"))
        .unionByName(e(facts.classes.where("extends IS NOT NULL"), "fqn", "extends"))
        .unionByName(e(facts.implements, "class", "interface"))
        .unionByName(e(facts.uses, "class", "trait"))
        .unionByName(e(facts.uses, "trait", "class"))
        .unionByName(e(kinds.where(F.col("name").isin(*MAGIC) & (F.col("owner_kind") == "class")), "owner", member))
        .unionByName(e(kinds.where("owner_kind = 'interface'"), "owner", member))
        .unionByName(method_overrides(facts).select(F.col("base").alias("src"), F.col("override").alias("dst")))
    )


def alive(facts: Facts, resolved: DataFrame) -> DataFrame:
    """(fqn, mark): strong or weak.

    Strong references and what they keep alive are strong. Then names of
    unresolved calls mark their candidates, once: functions strongly, methods
    that aren't private weakly, unless they live already; what those keep alive
    and isn't marked becomes strong.
    """
    known = cut(symbols(facts))
    refs = cut(references(facts, resolved))
    links = cut(edges(facts))
    seeds = refs.where("NOT is_weak").select(F.col("target").alias("node")).join(grown(known.select(F.col("fqn").alias("node"))), "node", "left_semi")
    strong = reach(links, seeds)
    names = refs.where("is_weak").select(F.col("target").alias("short")).distinct()
    candidates = known.where("kind IN ('function', 'method') AND visibility <> 'private'").withColumn("short", F.when(F.col("kind") == "method", F.substring_index("fqn", "::", -1)).otherwise(F.substring_index("fqn", "\\", -1)))
    marked = cut(candidates.join(names, "short", "left_semi").join(grown(strong.select(F.col("node").alias("fqn"))), "fqn", "left_anti").select("fqn", "kind"))
    weak = marked.where("kind = 'method'").select("fqn")
    more = reach(links, marked.select(F.col("fqn").alias("node")), known=strong)
    all_strong = strong.unionByName(more.join(weak.select(F.col("fqn").alias("node")), "node", "left_anti")).distinct()
    out = all_strong.select(F.col("node").alias("fqn"), F.lit("strong").alias("mark")).unionByName(weak.select("fqn", F.lit("weak").alias("mark")))
    return out.join(grown(known.select("fqn")), "fqn", "left_semi")


def dead(facts: Facts, living: DataFrame) -> DataFrame:
    return symbols(facts).join(grown(living.select("fqn")), "fqn", "left_anti")


def dead_counts(dead_symbols: DataFrame) -> DataFrame:
    kind = F.when(F.col("kind") == "method", F.when(F.col("visibility") == "private", "private_method").otherwise("other_method")).otherwise(F.col("kind"))
    return dead_symbols.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def located(facts: Facts, dead_symbols: DataFrame) -> DataFrame:
    """dead_symbols with file_path and line: a member's file is its owner's, and properties of traits have no place.

    Declarations without a line stand at the first.
    """
    line = lambda df: F.col("line").cast("int") if "line" in df.columns else F.lit(None).cast("int")
    declared = {"class": facts.classes, "interface": facts.interfaces, "trait": facts.traits, "function": facts.functions}
    one = lambda df, kind: df.select("fqn", F.lit(kind).alias("kind"), "file_path", line(df).alias("line"))
    places = [one(df, kind) for kind, df in declared.items()]
    owners = [df.select(F.col("fqn").alias("owner"), F.lit(kind).alias("owner_kind"), F.col("file_path").alias("owner_file")) for kind, df in declared.items() if kind != "function"]
    m = facts.methods.join(owners[0].unionByName(owners[1]).unionByName(owners[2]), ["owner", "owner_kind"])
    places.append(m.select(F.concat_ws("::", "owner", "name").alias("fqn"), F.lit("method").alias("kind"), F.col("owner_file").alias("file_path"), line(m).alias("line")))
    v = facts.properties.join(owners[0], "owner")
    places.append(v.select(F.concat(F.col("owner"), F.lit("::$"), F.col("name")).alias("fqn"), F.lit("property").alias("kind"), F.col("owner_file").alias("file_path"), line(v).alias("line")))
    where = places[0]
    for more in places[1:]:
        where = where.unionByName(more)
    first = where.groupBy("fqn", "kind").agg(F.min(F.struct("file_path", "line")).alias("x"))
    return dead_symbols.join(first, ["fqn", "kind"], "left").select(*dead_symbols.columns, F.col("x.file_path").alias("file_path"), F.coalesce("x.line", F.lit(1)).alias("line"))


def dead_filter(dead_symbols: DataFrame, methods: bool = False, properties: bool = False) -> DataFrame:
    """Without methods that aren't private and without properties, unless they are asked for."""
    left = dead_symbols if methods else dead_symbols.where("kind <> 'method' OR visibility = 'private'")
    return left if properties else left.where("kind <> 'property'")
