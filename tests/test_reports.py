"""Generic types, dumps, whole documents, folders."""

import json
import os
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from factmill.operators import compare, generics, resolve, violations
from factmill.sources import documents, tree


def test_arguments_and_terms(spark):
    arguments = lambda t: spark.range(1).select(generics.arguments(F.lit(t)).alias("x")).head().x
    assert arguments("Map<string, List<array{a: int, b: X<Y, Z>}>, callable(int, int)>") == ["string", "List<array{a: int, b: X<Y, Z>}>", "callable(int, int)"]
    assert arguments("List<>") == [] and arguments("int") == []
    rows = generics.terms(spark.createDataFrame([("A<B<C<D>>, ?E>",), ("A<B<C<D>>, ?E>",), ("int|A<B>",), (None,)], "type string")).collect()
    assert sorted((r.depth, tuple(r.path), r.text, r.kind) for r in rows if r.type[0] == "A") == [(0, (), "A<B<C<D>>, ?E>", "generic"), (1, (0,), "B<C<D>>", "generic"), (1, (1,), "?E", "nullable"), (2, (0, 0), "C<D>", "generic"), (3, (0, 0, 0), "D", "simple")]
    assert [r.kind for r in rows if r.type == "int|A<B>"] == ["union_type"]


@pytest.mark.parametrize("declared, result", [("T", "Box<User>"), ("?T", "?Box<User>"), ("List<Map<K, ?T>>", "List<Map<int, ?Box<User>>>"), ("T|null", "Box|null"), ("T[]", "T[]"), ("T&X", "T&X"), ("U", "U"), ("T<K>", "Box<int>"), ("mixed", "mixed")])
def test_substitution(spark, declared, result):
    bound = spark.createDataFrame([("s", "T", "Box<User>"), ("s", "K", "int"), ("other", "U", "X")], "scope string, name string, bound string")
    got = generics.substitute(spark.createDataFrame([("s", declared), ("other", declared)], "scope string, type string"), bound)
    assert {r.scope: r.result for r in got.collect()}["s"] == result


def returns(spark, receivers, extends=()):
    templates = spark.createDataFrame([("C", 0, "T"), ("P", 0, "K"), ("P", 1, "V")], "owner string, pos int, name string")
    methods = spark.createDataFrame([("C", "first", "?T"), ("C", "all", "List<T>"), ("P", "key", "K"), ("P", "val", "V"), ("U", "all", "int"), ("C", "none", None)], "owner string, name string, return_type string")
    parents = spark.createDataFrame(list(extends), "class string, type string")
    got = generics.method_returns(spark.createDataFrame([(r,) for r in receivers], "type string"), methods, templates, parents).collect()
    return {(r.type, r.name): (r.owner, r.result) for r in got}


def test_receivers_bind_their_own_templates(spark):
    got = returns(spark, ["C<User>", "C<P<int, User>>", "P<int>", "C", "P<a, b, c>"])
    assert got[("C<User>", "first")] == ("C", "?User") and got[("C<P<int, User>>", "all")] == ("C", "List<P<int, User>>")
    assert got[("P<int>", "key")] == ("P", "int") and got[("P<int>", "val")] == ("P", "V")  # too few
    assert got[("C", "first")] == ("C", "?T") and got[("P<a, b, c>", "val")] == ("P", "b") and got[("C", "none")] == ("C", None)


def test_children_of_generic_parents(spark):
    extends = [("U", "C<User>"), ("W", "U"), ("P", "C<Pair<K, V>>"), ("Q", "P<string, X>"), ("L", "M"), ("M", "L")]
    got = returns(spark, ["U", "W", "P<int, Y>", "Q", "L"], extends)
    assert got[("U", "first")] == ("C", "?User") and got[("U", "all")] == ("U", "int")  # its own comes first
    assert got[("W", "first")] == ("C", "?User") and got[("W", "all")] == ("U", "int")
    assert got[("P<int, Y>", "first")] == ("C", "?Pair<int, Y>") and got[("P<int, Y>", "key")] == ("P", "int")
    assert got[("Q", "all")] == ("C", "List<Pair<string, X>>") and got[("Q", "val")] == ("P", "X")
    assert not any(t == "L" for t, _ in got)


def dump(spark, classes, methods=(), properties=(), implements=()):
    param = "struct<name:string,type:string>"
    return compare.Dump(
        spark.createDataFrame(list(classes), "fqn string, extends string, is_abstract boolean, is_final boolean"),
        spark.createDataFrame(list(methods), f"owner string, name string, visibility string, is_static boolean, return_type string, params array<{param}>"),
        spark.createDataFrame(list(properties), "owner string, name string, visibility string, type string"),
        spark.createDataFrame(list(implements), "class string, interface string"),
    )


def test_ten_kinds_of_differences(spark):
    c = lambda name, extends=None: (name, extends, False, False)
    m = lambda owner, name, visibility="public", ret="int|null", types=("A|B",): (owner, name, visibility, False, ret, [("x", t) for t in types])
    ours = dump(spark, [c("Both"), c("Ours"), c("Kid", "Both")], [m("Both", "same"), m("Both", "mine"), m("Both", "seen"), m("Both", "typed"), m("Ours", "deep")], [("Both", "p", "private", "?int"), ("Both", "q", "public", "int"), ("Both", "mine", "public", None)], [("Both", "I"), ("Both", "J"), ("Kid", "I"), ("Ours", "I")])
    theirs = dump(spark, [c("Both"), c("Theirs"), c("Kid", "Other")], [m("Both", "same", ret="?int", types=("B|A",)), m("Both", "yours"), m("Both", "seen", "private"), m("Both", "typed", types=("A", "C")), m("Theirs", "deep")], [("Both", "p", "private", "null|int"), ("Both", "q", "public", "string"), ("Both", "yours", "public", None)], [("Both", "J"), ("Both", "I"), ("Both", "I"), ("Kid", "K"), ("Theirs", "I")])
    got = sorted(((r["class"], r.member or "", r.kind, r.detail) for r in compare.reflection_diff(ours, theirs).collect()), key=str)
    assert [x[:3] for x in got] == [
        ("Both", "mine", "method_missing_in_theirs"), ("Both", "mine", "property_missing_in_theirs"), ("Both", "q", "property_field_mismatch"), ("Both", "seen", "method_field_mismatch"),
        ("Both", "typed", "method_field_mismatch"), ("Both", "typed", "method_field_mismatch"), ("Both", "yours", "method_missing_in_ours"), ("Both", "yours", "property_missing_in_ours"),
        ("Kid", "", "class_field_mismatch"), ("Kid", "", "implements_mismatch"), ("Ours", "", "class_missing_in_theirs"), ("Theirs", "", "class_missing_in_ours"),
    ]
    assert {x[2] for x in got} == set(compare.KINDS)
    assert {x[3] for x in got if x[1] == "typed"} == {"n_params: 1 / 2", "param_types: A|B / A, C"} and [x[3] for x in got if x[2] == "implements_mismatch"] == ["only ours: I; only theirs: K"]
    assert not compare.reflection_diff(ours, ours).collect()


def test_first_matches(spark):
    calls = spark.createDataFrame([(9, "t", "f", 1, 1.0), (4, "t", "f", 1, 0.3), (6, "t", "f", 1, 0.9), (2, None, "f", 1, 1.0), (1, "t", "g", 1, 1.0)], "call_id long, target string, file_path string, line int, confidence double")
    found = violations.first_matches(calls.select("target", "file_path", "line").where("target IS NOT NULL").distinct(), calls, 0.5)
    assert {(r.file_path, r.first_call) for r in found.collect()} == {("f", 6), ("g", 1)}


VIOLATION = "rule string, severity string, message string, file_path string, line int"
ODD = [("r1", "error", 'a "quoted" <b> & more', "z.php", 10), ("r1", "error", "second", "z.php", 9), ("r2", "info", "twice", "a.php", 100), ("r2", "info", "twice", "a.php", 100), ("r2", "warning", None, None, None), ("r3", "warning", "é\nline", "a.php", 2)]


def text(path) -> str:
    return "\n".join(open(f"{path}/{f}").read().rstrip("\n") for f in sorted(os.listdir(path)) if f.startswith("part-"))


def test_sarif_and_checkstyle_are_whole_documents(spark, tmp_path):
    found = spark.createDataFrame(ODD, VIOLATION).repartition(4)
    documents.write(documents.report_sarif(found), f"{tmp_path}/sarif")
    run = json.loads(text(f"{tmp_path}/sarif"))["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["r1", "r2", "r3"]
    place = lambda r: (r["locations"][0]["physicalLocation"].get("artifactLocation", {}).get("uri"), r["locations"][0]["physicalLocation"].get("region", {}).get("startLine"))
    assert [place(r) for r in run["results"]] == [(None, None), ("a.php", 2), ("a.php", 100), ("a.php", 100), ("z.php", 9), ("z.php", 10)]
    documents.write(documents.report_checkstyle(found), f"{tmp_path}/xml")
    root = ET.fromstring(text(f"{tmp_path}/xml"))
    assert [(f.get("name"), [e.get("line") for e in f]) for f in root] == [("", [""]), ("a.php", ["2", "100", "100"]), ("z.php", ["9", "10"])]
    assert root[2][1].get("message") == 'a "quoted" <b> & more'
    empty = found.limit(0)
    documents.write(documents.report_sarif(empty), f"{tmp_path}/none")
    assert json.loads(text(f"{tmp_path}/none"))["runs"][0]["results"] == []
    assert not list(ET.fromstring("\n".join(r.line for r in documents.report_checkstyle(empty).orderBy("section", "key").collect())))


def test_a_report_is_one_object(spark, tmp_path):
    calls = [("a", "x", 0.95, "explicit_type"), ("b", "x", 0.6, "return_type_chain"), ("c", "x", 0.3, "phpdoc"), ("d", None, 0.0, "unresolved"), ("e", "y", 1.0, "this_call"), ("f", None, 0.0, "unresolved")]
    resolved = spark.createDataFrame(calls, "caller string, target string, confidence double, method string")
    dead = spark.createDataFrame([("class", 2), ("private_method", 3)], "kind string, n long")
    top = spark.createDataFrame([("B", "class", "b.php", 1), ("A", "class", None, 2)], "fqn string, kind string, file_path string, line int")
    coverage = spark.createDataFrame([(7, 9)], "classes long, methods long")
    documents.write(documents.report_json(documents.Report(coverage, resolved, dead, top, spark.createDataFrame(ODD, VIOLATION))), f"{tmp_path}/report")
    doc = json.loads(text(f"{tmp_path}/report"))
    assert doc["coverage"] == {"classes": 7, "methods": 9} and [x["fqn"] for x in doc["dead_code"]["top_dead_candidates"]] == ["A", "B"]
    assert doc["confidence"] == {"exact": 33.3, "likely": 16.7, "possible": 16.7, "unresolved": 33.3, "exact_count": 2, "likely_count": 1, "possible_count": 1, "unresolved_count": 2}
    assert doc["type_checks"]["call_site_args"] == {"pass": 2, "fail": 0, "unchecked": 2} and doc["type_checks"]["return_types"]["pass"] == 1
    assert doc["dead_code"]["dead_private_methods"] == 3 and doc["dead_code"]["dead_traits"] == 0 and len(doc["violations"]) == 6
    assert resolve.confidence_shares(resolved.limit(0)).head().exact == 0.0


def test_called_before_documents(spark, tmp_path):
    from factmill.functions import names
    from factmill.operators import called_before

    rows = [("In::f", None, "log", 3, "i.php"), ("Up::a", "In::f", "f", 4, "u.php"), ("Ok::b", None, "setup", 1, "o.php"), ("Ok::b", None, "log", 2, "o.php")]
    c = F.col("callee")
    found = called_before.analyse(spark.createDataFrame(rows, "caller string, target string, callee_name string, line int, file_path string"), names.matches(c, "setup"), names.matches(c, "log"))
    documents.write(documents.called_before_json(found, 'set"up', "A\\log"), f"{tmp_path}/json")
    doc = json.loads(text(f"{tmp_path}/json"))
    assert doc["constraint"] == {"before": 'set"up', "after": "A\\log"} and doc["satisfied"] is False
    assert doc["violations"] == [{"context_function": "In::f", "file": "i.php", "after_line": 3, "before_line": None, "kind": "missing_before"}]
    assert [m["before_line"] for m in doc["matches"]] == [1] and doc["summary"] == {"violations": 1, "matches": 1, "satisfied_functions": 1}
    lines = [r.line for r in documents.called_before_text(found, "setup", "log").orderBy("section", "key").collect()]
    assert lines[1] == "Result: VIOLATED" and lines[4] == "      Missing in: Up::a (u.php:4)" and lines[-1] == "  Ok::b"


def test_trees_with_links_in_cycles(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "out").mkdir()
    for f in ("a/one.php", "a/b/two.php", "a/b/no.unit.php", "a/b/no.txt", "out/three.php"):
        (tmp_path / f).write_text(f"<?php // {f}")
    (tmp_path / "a/b/loop").symlink_to(tmp_path / "a")
    (tmp_path / "a/b/far").symlink_to(tmp_path / "out")
    (tmp_path / "a/b/link.php").symlink_to(tmp_path / "out/three.php")
    (tmp_path / "a/broken.php").symlink_to(tmp_path / "nowhere")
    roots = spark.createDataFrame([(f"{tmp_path}/a",), (f"{tmp_path}/missing",), (None,)], "root string")
    files, warnings = tree.walk(roots)
    got = sorted(r.file_path.removeprefix(f"{tmp_path}/") for r in files.collect())
    assert got == ["a/b/far/three.php", "a/b/link.php", "a/b/two.php", "a/one.php"] and not warnings.collect()
    read = {r.file_path.removeprefix(f"{tmp_path}/"): r.content for r in tree.contents(files).collect()}
    assert read["a/b/link.php"] == "<?php // out/three.php" and len(read) == 4
    assert sorted(r.file_path.removeprefix(f"{tmp_path}/") for r in tree.walk(roots, deepest=0)[0].collect()) == ["a/one.php"]


def test_monorepo_settings(spark, tmp_path):
    for name, manifest in (("p/one", '{"name": "one"}'), ("p/bad", "{"), ("p/list", "[]"), ("elsewhere", '{"name": "two"}')):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "composer.json").write_text(manifest)
    (tmp_path / "p/empty").mkdir()
    (tmp_path / "p/link").symlink_to(tmp_path / "elsewhere")
    settings = tmp_path / "settings.json"
    settings.write_text(json.dumps({"scan_paths": ["p", "gone", 3]}))
    found, warnings = tree.monorepo(spark, str(settings))
    assert sorted((os.path.basename(r.root), json.loads(r.content)["name"]) for r in found.collect()) == [("link", "two"), ("one", "one")]
    said = sorted(f"{os.path.basename(r.path)}: {r.message}" for r in warnings.collect())
    assert len(said) == 4 and any("no path: 3" in w for w in said) and any(w.startswith("gone") for w in said)
    for text_ in ("{}", "no json", '{"scan_paths": 1}'):
        settings.write_text(text_)
        found, warnings = tree.monorepo(spark, str(settings))
        assert not found.collect() and warnings.count() == 1


def test_kept_tables_follow_their_input(spark, tmp_path):
    from factmill.operators.fixpoint import cut, release
    from factmill.plans import queries

    folder = str(tmp_path)
    write = lambda n: spark.range(n).write.mode("overwrite").parquet(f"{folder}/t.parquet")
    table = lambda: queries.kept(spark, folder, "t", lambda: spark.read.parquet(f"{folder}/t.parquet"))
    write(3)
    assert table().count() == 3
    write(5)
    assert table().count() == 5
    scratch = cut(spark.range(2))
    release(spark)
    assert table().count() == 5  # shared tables aren't scratch
    with pytest.raises(Exception, match="(?i)not.*exist|PATH_NOT_FOUND|FILE_NOT_EXIST"):
        scratch.count()
    queries.forget(spark)
    assert table().count() == 5
