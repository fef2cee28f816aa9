"""Called-before with witnesses, names by tails, access paths, plugins: cases and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from factmill.functions import names
from factmill.operators import called_before, fixpoint, plugins
from factmill.sources.php.facts import solve_paths

CALLS = "caller string, target string, callee_name string, line int, file_path string"


def analyse(spark, rows, before="setup", after="log", deepest=called_before.DEEPEST):
    """rows: caller, callee (with :: it is a target), line."""
    calls = spark.createDataFrame([(a, b if "::" in b else None, b.split("::")[-1], n, f"{a.split('::')[0]}.php") for a, b, n in rows], CALLS)
    c = F.col("callee")
    found = called_before.analyse(calls, names.matches(c, before), names.matches(c, after), deepest)
    return {k: sorted(map(tuple, getattr(found, k).collect()), key=repr) for k in ("violations", "matches", "satisfied_in", "missing_paths")}


def test_order_within_a_function(spark):
    got = analyse(spark, [("A::ok", "setup", 1), ("A::ok", "S::setup", 3), ("A::ok", "log", 5), ("B::bad", "log", 1), ("B::bad", "setup", 2), ("B::bad", "log", 4), ("C::same", "setup", 2), ("C::same", "log", 2)])
    assert got["violations"] == [("B::bad", "B.php", 1, 2, "wrong_order", None, None, None, None)]
    assert got["matches"] == [("A::ok", "A.php", 5, "log", 3, "S::setup", False, None), ("B::bad", "B.php", 4, "log", 2, "setup", False, None)]
    assert got["satisfied_in"] == [("A::ok",), ("C::same",)] and not got["missing_paths"]


def test_callers_decide_and_are_named(spark):
    rows = [("In::f", "log", 3), ("Good::a", "setup", 1), ("Good::a", "setup", 2), ("Good::a", "In::f", 4), ("Mid::b", "In::f", 7), ("Mid::b", "In::f", 9), ("Top::c", "Mid::b", 5)]
    got = analyse(spark, rows)
    assert got["violations"] == [("In::f", "In.php", 3, None, "missing_before", "Mid::b", 7, "Mid.php", 2)]
    assert got["missing_paths"] == [("In::f", "Mid::b", 7, "Mid.php")] and not got["matches"] and not got["satisfied_in"]
    got = analyse(spark, [*rows, ("Top::c", "setup", 1)])
    assert not got["violations"] and got["satisfied_in"] == [("In::f",)]
    assert got["matches"] == [("In::f", "In.php", 3, "log", 2, "setup", True, "Good::a")]


def test_uncalled_functions_and_cycles(spark):
    got = analyse(spark, [("Alone::f", "log", 2), ("Loop::f", "log", 1), ("Loop::f", "Loop::g", 2), ("Loop::g", "Loop::f", 3)])
    assert got["violations"] == [("Alone::f", "Alone.php", 2, None, "missing_before", None, None, None, 0)]
    assert got["satisfied_in"] == [("Loop::f",)] and not got["matches"]  # nobody is there to be named


def test_callers_by_like_names(spark):
    """Nobody calls App\\In::log itself; calls of B under an unresolved name may be its."""
    got = analyse(spark, [("App\\In::log", "X::log", 3), ("Up::a", "setup", 1), ("Up::a", "log", 2)])
    assert {m[0] for m in got["matches"]} == {"App\\In::log", "Up::a"} and not got["violations"]
    got = analyse(spark, [("App\\In::log", "X::log", 3), ("Up::a", "log", 2)])
    assert [(v[0], v[5]) for v in got["violations"]] == [("App\\In::log", "Up::a"), ("Up::a", None)]


@pytest.mark.parametrize("steps", [3, 4, 5])
def test_chains_end_at_the_bound(spark, steps):
    rows = [("F0::f", "log", 1), *((f"F{i + 1}::f", f"F{i}::f", 2) for i in range(steps)), (f"F{steps}::f", "setup", 1), ("T::t", f"F{steps}::f", 3)]
    got = analyse(spark, rows, deepest=4)
    # The top brings A itself, so steps - 1 calls go up without one.
    assert bool(got["violations"]) == (steps - 1 >= 4) and bool(got["satisfied_in"]) == (steps - 1 < 4)
    assert [p[1] for p in got["missing_paths"]] == (["F1::f"] if steps - 1 >= 4 else [])


def brute(rows):
    """Contexts of log without a local setup, and whether every way up brings one: walks from each context alone."""
    calls, up = {}, {}
    for a, b, n in rows:
        calls.setdefault(a, []).append((b, n))
        up.setdefault(b, []).append((a, n))
    is_ = lambda name, what: name == what or name.endswith("::" + what)
    out = {}
    for f, inside in calls.items():
        if any(is_(b, "log") for b, _ in inside) and not any(is_(b, "setup") for b, _ in inside):
            seen, todo, good = {f}, [f], True
            while todo:
                x = todo.pop()
                good &= x in up
                for a, n in up.get(x, []):
                    if not any(is_(b, "setup") and m < n for b, m in calls[a]) and a not in seen:
                        seen.add(a)
                        todo.append(a)
            out[f] = good
    return out


@pytest.mark.parametrize("seed", range(3))
def test_verdicts_are_those_of_walks_from_each_context(spark, seed):
    rng = random.Random(seed)
    functions = [f"K{i}::f{i}" for i in range(40)]
    rows = [(rng.choice(functions), rng.choice([*functions, *functions, "setup", "log"]), rng.randint(1, 9)) for _ in range(110)]
    got, want = analyse(spark, rows), brute(rows)
    assert {v[0] for v in got["violations"] if v[4] == "missing_before"} == {f for f, good in want.items() if not good}
    assert {f for f, good in want.items() if good} <= {x[0] for x in got["satisfied_in"]}
    edges = {(b, a, n) for a, b, n in rows}
    for f, caller, line, _ in got["missing_paths"]:
        assert (f, caller, line) in edges


NAMES = ["A\\B\\C::m", "C::m", "m", "B\\C::m", "X::m", "A\\m", "A\\B", "B", "C::n", "D\\C::m", "XC::m", "::m"]


def test_pairs_by_tails_are_those_of_the_conditions(spark):
    one = spark.createDataFrame([(n,) for n in NAMES], "callee string")
    cross = lambda a, b: one.select(F.col("callee").alias(a)).crossJoin(one.select(F.col("callee").alias(b)))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(names.fuzzy_pairs(one, one.select(F.col("callee").alias("pattern")))) == rows(cross("callee", "pattern").where(names.same_callee(F.col("callee"), F.col("pattern"))))
    mapped = one.select(F.col("callee").alias("mapped")).unionByName(spark.createDataFrame([("*",), ("*",)], "mapped string"))
    want = one.select(F.col("callee").alias("event")).crossJoin(mapped.distinct()).where(names.event_matches(F.col("event"), F.col("mapped")))
    assert rows(names.event_pairs(one.select(F.col("callee").alias("event")), mapped)) == rows(want)
    plan = names.fuzzy_pairs(one, one.select(F.col("callee").alias("pattern")))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_names_that_may_be_the_same_function(spark):
    pairs = names.same_function(spark.createDataFrame([(n,) for n in NAMES], "callee string"), spark.createDataFrame([("B\\C::m",), ("B",)], "function string"))
    assert sorted(map(tuple, pairs.collect())) == [("A\\B", "B"), ("A\\B\\C::m", "B\\C::m"), ("B", "B"), ("B\\C::m", "B\\C::m"), ("C::m", "B\\C::m"), ("m", "B\\C::m")]


def test_nearest(spark):
    edges = spark.createDataFrame([(1, 2, 9), (1, 3, 4), (2, 4, 1), (3, 4, 0), (4, 1, 0), (5, 4, 7)], "src int, dst int, line int")
    got = fixpoint.nearest(edges, spark.createDataFrame([(1, 0, "a"), (5, 1, "b"), (1, 0, "c")], "node int, depth int, why string"))
    assert {(r.node, r.depth, r.why, r.via and r.via.src) for r in got.collect()} == {(1, 0, "a", None), (2, 1, "a", 1), (3, 1, "a", 1), (4, 2, "a", 2), (5, 1, "b", None)}
    assert not fixpoint.nearest(edges, spark.createDataFrame([], "node int, depth int")).collect()


def test_paths_share_their_prefixes(spark):
    members = spark.createDataFrame([("A", "p:b", "B", "nullable"), ("B", "m:self", "self", "simple"), ("B", "m:a", "A", "simple")], "root string, hop string, next string, kind string")
    long = ["p:b", "m:a"] * 25
    paths = [("A", ["p:b"]), ("A", ["p:b", "m:self"]), ("A", long), ("A", ["p:no", "m:a"]), ("Z", ["p:b"]), (None, ["p:b"]), ("A", [])]
    got = solve_paths(spark.createDataFrame(paths * 2, "root string, hops array<string>"), members)
    solved = {(r.root, tuple(r.hops)): (r.type, r.kind) for r in got.collect()}
    assert solved[("A", ("p:b", "m:self"))] == ("B", "simple") and solved[("A", tuple(long))] == ("A", "simple") and solved[("A", ("p:b",))] == ("B", "nullable")
    assert len(solved) == got.count() == len(long) + 1  # each prefix once
    assert got._jdf.queryExecution().analyzed().toString().count("Join") == 0


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src int, dst int")


@pytest.mark.parametrize("seed", range(4))
def test_reachability_after_added_edges(spark, seed):
    rng = random.Random(seed)
    pick = lambda n: sorted({(rng.randrange(25), rng.randrange(25)) for _ in range(n)} - {(i, i) for i in range(25)})
    old, new = pick(22), pick(5)
    both = edges(spark, sorted({*old, *new}))
    node = lambda pairs: spark.createDataFrame([(n,) for n in sorted({*pairs})], "node int")
    reached = fixpoint.reach(edges(spark, old), node([0]))
    more = plugins.reach_more(edges(spark, old), edges(spark, new), reached)
    assert {r.node for r in reached.unionByName(more).collect()} == {r.node for r in fixpoint.reach(both, node([0])).collect()} and reached.join(more, "node").count() == 0

    def opened(pairs):
        called = {b for _, b in pairs}
        seeds = spark.createDataFrame([(n, 0) for n in sorted({a for a, _ in pairs} - called)], "node int, depth int")
        return fixpoint.nearest(edges(spark, pairs), seeds).select("node", "depth")

    got = plugins.open_after(opened(old), edges(spark, old), edges(spark, new), node(b for _, b in [*old, *new]))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, opened(sorted({*old, *new})).collect()))


def test_unknown_plugins_warn(spark):
    from factmill.facts import SCHEMAS, Facts

    facts = Facts(**{t: spark.createDataFrame([], SCHEMAS[t]) for t in SCHEMAS}, extra={
        "dispatches": spark.createDataFrame([("Shop::sell", "App\\Sold", "s.php", 3)], "caller string, event string, file_path string, line int"),
        "event_maps": spark.createDataFrame([("Mail", "Sold", "on"), ("Log", "*", "all"), ("Not", "Unsold", "x")], "class string, event string, handler string"),
    })
    found, warnings = plugins.run(facts, ["events", "nope", "events"])
    assert sorted(map(tuple, found.collect())) == [("events", "Shop::sell", "Log::all"), ("events", "Shop::sell", "Mail::on")]
    assert [tuple(r) for r in warnings.collect()] == [("nope", "unknown plugin 'nope'")]
    resolved = spark.createDataFrame([("a", "b", "b", None, "b", 1.0, "explicit_type")], "caller string, target string, callee_name string, caller_class string, target_owner string, confidence double, method string")
    assert plugins.merged(resolved, found).where("method = 'plugin_generated'").count() == 2
    plugins.plugin("mine")(lambda f: f.extra["dispatches"].select("caller", F.lit("X::y").alias("target")))
    try:
        assert plugins.run(facts, ["mine"])[0].head().target == "X::y"
    finally:
        del plugins.PLUGINS["mine"]


def test_edges_between_callers_and_like_names_are_never_made(spark, monkeypatch):
    """Each of many callers of an unresolved name may call each of many functions: no table grows with their product."""
    n, sizes = 60, []
    rows = [(f"Up{i}::a", "log", 2) for i in range(n)] + [(f"In{i}::log", "X::log", 3) for i in range(n)] + [("Up0::a", "setup", 1)]
    write = fixpoint.cut

    def counted(df):
        out = write(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(fixpoint, "cut", counted)
    monkeypatch.setattr(called_before, "cut", counted)
    got = analyse(spark, rows)
    assert max(sizes) <= 4 * n
    assert len(got["violations"]) == 2 * n - 1 and {v[5] for v in got["violations"] if v[0].startswith("In")} == {"Up10::a"}  # the least in byte order
    assert len(got["missing_paths"]) == n * (n - 1)  # results, of callers without setup


@pytest.mark.parametrize("seed", range(2))
def test_sets_are_the_calls_that_they_stand_for(spark, seed):
    rng = random.Random(seed)
    functions = [f"K{i}::{m}" for i in range(9) for m in ("f", "log", "setup")]
    rows = [(rng.choice(functions), rng.choice([*functions, "log", "setup"]), rng.randint(1, 9)) for _ in range(25)]
    members = {"x": rng.sample(functions, 4), "y": rng.sample([f for f in functions if "setup" not in f], 5), "z": ["Q::setup", "R::setup"]}
    sites = {(f"{c.split('::')[0]}::{c.split('::')[1]}", rng.choice("xyz"), rng.randint(1, 9)) for c in rng.sample(functions, 8)}
    call = lambda a, b, n: (a, b if "::" in b else None, b.split("::")[-1], n, f"{a.split('::')[0]}.php")
    c = F.col("callee")
    found = lambda calls, **more: called_before.analyse(spark.createDataFrame([call(*r) for r in calls], CALLS), names.matches(c, "setup"), names.matches(c, "log"), **more)
    sets = called_before.Sets(
        spark.createDataFrame([(a, s, n, f"{a.split('::')[0]}.php") for a, s, n in sites], "caller string, set string, line int, file_path string"),
        spark.createDataFrame([(s, m) for s in members for m in members[s]], "set string, callee string"),
    )
    got, want = found(rows, sets=sets), found([*rows, *((a, m, n) for a, s, n in sites for m in members[s])])
    for table in ("violations", "matches", "satisfied_in", "missing_paths"):
        assert sorted(map(tuple, getattr(got, table).collect()), key=repr) == sorted(map(tuple, getattr(want, table).collect()), key=repr), table


def test_events_that_all_handlers_take_are_not_shuffled(spark):
    from factmill.facts import SCHEMAS, Facts
    from factmill.sources.php.facts import synthetic_edges

    sent = [(f"C{i % 7}::f", e, "s.php", i % 3) for i, e in enumerate(["App\\Sold", "Sold", "X\\Sold", "Lost", "*"] * 5)]
    maps = [("Mail", "Sold", "on"), ("Log", "*", "all"), ("Log", "*", "all"), ("Log", "Lost", "all"), ("Log", "Sold", "on"), ("Tab", "*", "on"), ("Mail", "App\\Sold", "on")]
    extra = {"dispatches": spark.createDataFrame(sent, "caller string, event string, file_path string, line int"), "event_maps": spark.createDataFrame(maps, "class string, event string, handler string")}
    fits = lambda e, m: m in ("*", e) or e.endswith("\\" + m) or m.endswith("\\" + e)
    want = {(a, f"{k}::{h}", p, n) for a, e, p, n in sent for k, m, h in maps if fits(e, m)}
    assert sorted(map(tuple, synthetic_edges(extra).select("caller", "target", "file_path", "line").collect())) == sorted(want)
    found = plugins.run(Facts(**{t: spark.createDataFrame([], SCHEMAS[t]) for t in SCHEMAS}, extra=extra), ["events"])[0]
    assert sorted((r.caller, r.target) for r in found.collect()) == sorted({w[:2] for w in want})
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = next(i for i, line in enumerate(lines) if "Join Cross" in line or "Join Inner" in line and "(" not in line)
    above, level = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < level:
            level = depth(line)
            above.append(line)
    assert above and not any("Aggregate" in line for line in above)
