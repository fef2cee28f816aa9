"""Fact tables from source files: every file is parsed once, in a task, and gives rows of all tables."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...facts import PARAM, Facts
from ...functions.names import tail_pairs
from ...functions.typing import BUILTIN
from ...operators.fixpoint import cut
from ...operators.inherit import all_methods, all_properties
from ...operators.resolve import confidence
from .flow import Flow, NullStates, return_diagnostics
from .syntax import parse, walk

#: Columns of the emitted tables.
TABLES = {
    "files": "file_path string, namespace string, imports map<string,string>",
    "classes": "fqn string, file_path string, extends string, is_abstract boolean, is_final boolean, line int",
    "interfaces": "fqn string, file_path string",
    "traits": "fqn string, file_path string",
    "functions": f"fqn string, file_path string, params array<{PARAM}>, return_type string",
    "implements": "class string, interface string",
    "uses": "class string, trait string, use_ord int",
    "methods": f"owner string, owner_kind string, name string, visibility string, is_static boolean, is_abstract boolean, return_type string, params array<{PARAM}>, file_path string, line int",
    "properties": "owner string, name string, type string, visibility string, file_path string, line int",
    "call_sites": "call_id long, caller string, caller_class string, call_type string, callee_name string, namespace string, root string, hops array<string>, file_path string, line int, args array<string>",
    "returns": "method string, status string, problem string, file_path string, line int",
    "null_accesses": "method string, variable string, access string, state string, file_path string, line int",
    "cfg_edges": "method string, src int, dst int",
    "cfg_blocks": "method string, block int, terminator string, n_statements int",
    "event_maps": "class string, event string, handler string",
    "dispatches": "caller string, event string, file_path string, line int",
}
#: Functions that need no definition (fixed values).
BUILTIN_FUNCTIONS = ("array_filter", "array_keys", "array_map", "array_merge", "array_pop", "array_push", "array_reduce", "array_values", "class_exists", "count", "date", "die", "echo", "empty", "exit", "explode", "fclose", "file_get_contents", "file_put_contents", "fopen", "fread", "fwrite", "get_class", "get_parent_class", "implode", "is_array", "is_bool", "is_int", "is_null", "is_string", "isset", "json_decode", "json_encode", "method_exists", "preg_match", "preg_match_all", "preg_replace", "print", "print_r", "printf", "property_exists", "sprintf", "str_replace", "strlen", "strpos", "strtolower", "strtotime", "strtoupper", "substr", "throw", "time", "trim", "var_dump")
#: Others that are global wherever they are called.
GLOBAL_FUNCTIONS = (*BUILTIN_FUNCTIONS, "array_key_exists", "array_shift", "in_array", "str_contains", "unset")


class Emitter:
    def __init__(self, path: str, text: str):
        self.path, self.text = path, text
        self.rows: list[tuple[str, dict]] = []
        self.namespace, self.imports = "", {}
        self.calls = 0
        self.statements(parse(text))
        self.emit("files", file_path=path, namespace=self.namespace, imports=self.imports)

    def emit(self, table: str, **row) -> None:
        self.rows.append((table, row))

    def name(self, n: str | None) -> str | None:
        """Fully qualified: leading backslash, built-in, import, import of the first segment, namespace."""
        if not n:
            return None
        if n.startswith("\\"):
            return n[1:]
        if n.lower() in BUILTIN:
            return n
        first, _, rest = n.partition("\\")
        if n in self.imports:
            return self.imports[n]
        if rest and first in self.imports:
            return f"{self.imports[first]}\\{rest}"
        return f"{self.namespace}\\{n}" if self.namespace else n

    def statements(self, body: list[dict]) -> None:
        loose = []
        for s in body:
            if s["kind"] == "namespace":
                self.namespace = s["name"]
                if s["body"] is not None:
                    self.statements(s["body"])
            elif s["kind"] == "use":
                self.imports |= {alias or n.rsplit("\\", 1)[-1]: n for n, alias in s["items"]}
            elif s["kind"] in ("class", "interface", "trait"):
                self.declaration(s)
            elif s["kind"] == "function":
                fqn = self.name(s["name"])
                self.emit("functions", fqn=fqn, file_path=self.path, params=self.params(s), return_type=s["return_type"])
                self.body(s, s["name"], None, None)
            else:
                loose.append(s)
        if loose:
            self.body({"body": loose, "params": []}, "<global>", None, None)

    def params(self, f: dict) -> list[dict]:
        return [{"name": p["name"], "type": p["type"], "nullable": (p["type"] or "").startswith("?"), "has_default": p["default"] is not None, "is_variadic": p["variadic"]} for p in f["params"]]

    def declaration(self, c: dict) -> None:
        fqn = self.name(c["name"])
        if c["kind"] == "class":
            parent = self.name(c["extends"][0]) if c["extends"] else None
            self.emit("classes", fqn=fqn, file_path=self.path, extends=parent, is_abstract="abstract" in c["flags"], is_final="final" in c["flags"], line=c["line"])
            for i in c["implements"]:
                self.emit("implements", **{"class": fqn, "interface": self.name(i)})
            for k, t in enumerate(c["uses"]):
                self.emit("uses", **{"class": fqn, "trait": self.name(t), "use_ord": k})
        else:
            self.emit(c["kind"] + "s", fqn=fqn, file_path=self.path)
        for p in c["properties"]:
            doc = re.search(r"@var\s+(\S+)", p["doc"] or "")
            self.emit("properties", owner=fqn, name=p["name"], type=p["type"] or (doc and doc[1]) or self.inferred(c, p), visibility=p["visibility"], file_path=self.path, line=p["line"])
        returns = {}
        for m in c["methods"]:
            doc = re.search(r"@return\s+(\S+)", m["doc"] or "")
            returns[m["name"]] = m["return_type"] or (doc[1] if doc else None)
        for m in c["methods"]:
            for p in m["params"]:
                if m["name"] == "__construct" and p["promoted"]:
                    self.emit("properties", owner=fqn, name=p["name"], type=p["type"], visibility=p["visibility"], file_path=self.path, line=m["line"])
            self.emit("methods", owner=fqn, owner_kind=c["kind"], name=m["name"], visibility=m["visibility"], is_static="static" in m["flags"], is_abstract="abstract" in m["flags"], return_type=returns[m["name"]], params=self.params(m), file_path=self.path, line=m["line"])
            self.body(m, f"{fqn}::{m['name']}", fqn if c["kind"] == "class" else None, c, returns)
        if c["kind"] == "class":
            self.events(c, fqn)

    def inferred(self, c: dict, p: dict) -> str | None:
        """An untyped property that the constructor fills from a typed parameter, or with new X."""
        for m in c["methods"]:
            types = {q["name"]: q["type"] for q in m["params"]}
            for x in walk(m["body"]):
                if x["kind"] == "assign" and x["target"]["kind"] == "property" and x["target"]["name"] == p["name"] and NullStates.key(x["target"]["object"]) == "$this":
                    v = x["value"]
                    if v["kind"] == "variable" and types.get(v["name"]):
                        return types[v["name"]]
                    if v["kind"] == "new" and v["class"]:
                        return self.name(v["class"])
        return None

    def events(self, c: dict, fqn: str) -> None:
        """Subscriptions: pairs of X::class and a quoted handler, or all public on* methods for any event."""
        if not any(i.endswith("EventSubscriberInterface") for i in c["implements"]):
            return
        at = self.text.find("getSubscribedEvents") if any(m["name"] == "getSubscribedEvents" for m in c["methods"]) else -1
        found = []
        if at >= 0 and (r := self.text.find("return", at)) >= 0:
            end = self.text.find(";", r)
            found = re.findall(r"([\w\\]+)::class\s*=>[^']*'([^']*)'", self.text[at : end if end >= 0 else len(self.text)], re.S)
        if not found:
            found = [("*", m["name"]) for m in c["methods"] if m["visibility"] == "public" and "static" not in m["flags"] and m["name"].startswith("on")]
        for event, handler in found:
            self.emit("event_maps", **{"class": fqn, "event": event if event == "*" else self.name(event), "handler": handler})

    def body(self, f: dict, caller: str, owner: str | None, c: dict | None, returns: dict | None = None) -> None:
        if f["body"] is None:
            if c is not None and c["kind"] == "class":
                status, _ = return_diagnostics(f, returns.get(f["name"]) if returns else None)
                self.emit("returns", method=caller, status=status, problem=None, file_path=self.path, line=f["line"])
            return
        if c is not None and c["kind"] == "class":
            status, problems = return_diagnostics(f, returns[f["name"]])
            for problem, line in problems or [(None, f["line"])]:
                self.emit("returns", method=caller, status=status, problem=problem, file_path=self.path, line=line)
        flow = Flow(f["body"])
        for a, b in flow.edges:
            self.emit("cfg_edges", method=caller, src=a, dst=b)
        for k, b in enumerate(flow.blocks):
            self.emit("cfg_blocks", method=caller, block=k, terminator=b.terminator, n_statements=len(b.statements))
        if caller != "<global>":
            for variable, access, line, state in NullStates(f, returns).accesses:
                self.emit("null_accesses", method=caller, variable=variable, access=access, state=state, file_path=self.path, line=line)
        scope: dict[str, tuple[str, list[str]]] = {p["name"]: (self.typed(p["type"]), []) for p in f["params"] if self.typed(p["type"])}
        lines = self.text.split("\n")
        for x in walk(f["body"]):
            if x["kind"] == "assign" and x["target"]["kind"] == "variable" and (path := self.access(x["value"], scope, owner, c)):
                scope[x["target"]["name"]] = path  # one that can't be told overwrites nothing
            if x["kind"] not in ("member_call", "static_call", "call") or x.get("null_safe"):
                continue
            root, hops, kind = None, [], x["kind"]
            if kind == "member_call":
                root, hops = self.access(x["object"], scope, owner, c) or (None, [])
                if x["name"] == "dispatch" and x["line"] <= len(lines) and (event := re.search(r"new\s+([\w\\]+)", lines[x["line"] - 1])):
                    self.emit("dispatches", caller=caller, event=self.name(event[1]), file_path=self.path, line=x["line"])
            elif kind == "static_call":
                root = self.scoped(x["class"], owner, c)
            elif x["name"] is None:
                continue
            callee = x["name"] if kind != "call" else (x["name"] if "\\" in x["name"] or not self.namespace or x["name"] in GLOBAL_FUNCTIONS else self.name(x["name"]))
            self.calls += 1
            args = [None if a["kind"] != "literal" else a["type"] for a in x["args"]]
            self.emit("call_sites", call_id=hash_id(self.path, self.calls), caller=caller, caller_class=owner, call_type=kind, callee_name=callee.lstrip("\\"), namespace=self.namespace if kind == "call" and callee in GLOBAL_FUNCTIONS else None, root=root, hops=hops, file_path=self.path, line=x["line"], args=args)

    def typed(self, t: str | None) -> str | None:
        return t if t and not any(ch in t for ch in "|&") else None

    def scoped(self, name: str | None, owner: str | None, c: dict | None) -> str | None:
        if name in ("self", "static"):
            return owner
        if name == "parent":
            return self.name(c["extends"][0]) if c and c["extends"] else None
        return self.name(name)

    def access(self, e: dict, scope: dict, owner: str | None, c: dict | None) -> tuple[str, list[str]] | None:
        """Where a value comes from: a type, and the properties and methods from there on."""
        if e["kind"] == "variable":
            return (owner, []) if e["name"] == "this" and owner else scope.get(e["name"])
        if e["kind"] == "new":
            t = self.scoped(e["class"], owner, c)
            return (t, []) if t else None
        if e["kind"] == "assign":
            return self.access(e["value"], scope, owner, c)
        if e["kind"] in ("property", "member_call") and (inner := self.access(e["object"], scope, owner, c)):
            return inner[0], [*inner[1], ("p:" if e["kind"] == "property" else "m:") + e["name"]]
        if e["kind"] == "static_call" and (t := self.scoped(e["class"], owner, c)):
            return t, ["m:" + e["name"]]
        return None


def hash_id(path: str, n: int) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(f"{path}\0{n}") >> 1


def fact_rows(files: DataFrame) -> DataFrame:
    """(table, row as JSON) of files(file_path, content). A file that can't be read gives what could be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column("file_path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = Emitter(path, text or "").rows
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows]), pa.array([json.dumps(r) for _, r in rows])], names=["table", "row"])

    return files.select("file_path", "content").mapInArrow(run, "table string, row string")


def tables(rows: DataFrame) -> dict[str, DataFrame]:
    """Typed tables of fact_rows(); write or persist rows first, so that files are parsed once."""
    return {name: rows.where(F.col("table") == name).select(F.from_json("row", schema).alias("r")).select("r.*") for name, schema in TABLES.items()}


def solve_paths(paths: DataFrame, members: DataFrame) -> DataFrame:
    """(root, hops, type, kind) of paths(root, hops) that can be followed over members(root, hop, next, kind).

    Paths form a trie: a prefix of hops from a root is one node, whatever the number
    of paths and calls through it. Levels are solved in turn, each by a join of
    its nodes with those above, and written, so the plan doesn't grow with the
    longest path; what has no type ends its paths.
    """
    prefixes = F.explode(F.transform(F.sequence(F.lit(1), F.size("hops")), lambda n: F.slice("hops", 1, n)))
    nodes = cut(paths.where("root IS NOT NULL AND size(hops) > 0").select("root", prefixes.alias("hops")).distinct().withColumn("depth", F.size("hops")))
    above = nodes.select("root", F.col("root").alias("type")).distinct().withColumn("up", F.array().cast("array<string>"))
    steps = members.select(F.col("root").alias("type"), "hop", "next", "kind")
    done: list[DataFrame] = []
    depth = 1
    while True:
        level = nodes.where(F.col("depth") == depth).select("root", "hops", F.slice("hops", 1, F.size("hops") - 1).alias("up"), F.element_at("hops", -1).alias("hop"))
        level = level.join(above, ["root", "up"]).join(steps, ["type", "hop"]).where("next IS NOT NULL")
        solved = cut(level.select("root", "hops", F.when(F.col("next") == "self", F.col("type")).otherwise(F.col("next")).alias("type"), "kind"))
        done.append(solved)
        if solved.isEmpty():
            return reduce(DataFrame.unionByName, done)
        if len(done) > 16:
            done = [cut(reduce(DataFrame.unionByName, done))]
        above, depth = solved.select("root", "type", F.col("hops").alias("up")), depth + 1


def resolve_sites(t: dict[str, DataFrame]) -> Facts:
    """Facts whose calls have receivers: access paths are followed in a trie that all calls share. Tables of plugins are extras."""
    empty = t["classes"].sparkSession.createDataFrame([], "root string")
    extra = {name: t[name] for name in ("dispatches", "event_maps") if name in t}
    f = Facts(t["classes"], t["methods"], t["call_sites"], t["implements"], t["uses"], t["interfaces"], t["traits"], t["functions"], t["properties"], empty, extra)
    clean = lambda c: F.when(c.startswith("self") | c.startswith("static"), F.lit("self")).otherwise(F.regexp_replace(c, "^\\?", ""))
    kind = lambda c: F.when(c.startswith("?"), "nullable").otherwise("simple")
    part = lambda df, mark, c: df.select(F.col("class").alias("root"), F.concat(F.lit(mark), "name").alias("hop"), clean(F.col(c)).alias("next"), kind(F.col(c)).alias("kind"))
    members = cut(part(all_methods(f), "m:", "return_type").unionByName(part(all_properties(f), "p:", "type")))
    shadows = t["functions"].select(F.col("fqn").alias("shadow")).distinct()  # a function of the namespace comes before a built-in one
    calls = t["call_sites"].join(shadows, F.concat("namespace", F.lit("\\"), "callee_name") == F.col("shadow"), "left")
    calls = calls.withColumn("callee_name", F.coalesce("shadow", "callee_name")).drop("namespace", "shadow")
    solved = solve_paths(t["call_sites"].select("root", "hops"), members)
    calls = calls.join(solved, ["root", "hops"], "left")
    far, last = F.size("hops") > 0, F.try_element_at("hops", F.lit(-1))
    how = F.when(F.col("call_type") == "static_call", "static_call").when(~far, "assignment_tracking").when(last.startswith("p:"), "property_type").otherwise("return_type_chain")
    receiver = F.when(far, F.col("type")).otherwise(F.col("root"))
    return f.with_(calls=calls.select(*[c for c in calls.columns if c not in ("type", "kind", "root", "hops")], receiver.alias("receiver"), F.coalesce("kind", F.lit("simple")).alias("receiver_kind"), how.alias("how")))


def event_sites(t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Dispatched events and their handlers in three tables of different rows: (edges(caller, target, file_path, line), sites(caller, file_path, line), all_handlers(target)).

    Handlers of * take every event, so each site leads to each of them; these
    edges aren't made here, and the others are without them. Names meet by their
    tails, in equi-joins.
    """
    target = F.concat_ws("::", "class", "handler").alias("target")
    sent, maps = t["dispatches"].where("event IS NOT NULL"), t["event_maps"].withColumnRenamed("event", "mapped")
    every = maps.where("mapped = '*'").select(target).distinct()
    pairs = tail_pairs(sent.select("event"), maps.select("mapped"))
    met = sent.join(pairs, "event").join(maps, "mapped").select("caller", target, "file_path", "line").distinct()
    return met.join(every, "target", "left_anti").select("caller", "target", "file_path", "line"), sent.select("caller", "file_path", "line").distinct(), every


def spread(sites: DataFrame, handlers: DataFrame) -> DataFrame:
    """Each of sites with each of handlers(target). Few rows become many here, so both sides are dealt over all cores first,
    whichever of them Spark streams; it broadcasts the other only if that is small."""
    n = 4 * sites.sparkSession.sparkContext.defaultParallelism
    return sites.repartition(n).crossJoin(handlers.repartition(n))


def synthetic_edges(t: dict[str, DataFrame]) -> DataFrame:
    """Dispatched events to their handlers: (caller, target, file_path, line, confidence, method), different rows."""
    edges, sites, every = event_sites(t)
    return edges.unionByName(spread(sites, every)).select("caller", "target", "file_path", "line", F.lit(0.95).alias("confidence"), F.lit("plugin_generated").alias("method"))


__all__ = ["BUILTIN_FUNCTIONS", "TABLES", "confidence", "event_sites", "fact_rows", "resolve_sites", "solve_paths", "spread", "synthetic_edges", "tables"]
