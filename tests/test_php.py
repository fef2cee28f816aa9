import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factmill.functions import names
from factmill.operators.resolve import resolve_calls
from factmill.sources import projects
from factmill.sources.php.facts import fact_rows, resolve_sites, synthetic_edges, tables
from factmill.sources.php.flow import Flow, NullStates, return_diagnostics
from factmill.sources.php.syntax import parse

LOGGER = "<?php class Logger { private ?Sink $sink; public function setup(): void {} public function log(string $m): self { return $this; } }"
SERVICE = """<?php
class Service extends Base {
  private $log;
  public function __construct(Logger $log, private Repo $repo) { $this->log = $log; }
  public function run(int $n) {
    $this->log->setup();
    $this->log->log("a")->log('b');
    $x = new Helper();
    $x->help($n);
    $this->repo->find(1);
    self::make();
    strlen("x");
    $bus->dispatch(new Saved());
  }
  public static function make(): ?Service { return null; }
}
class Base { public function find() { return 1; } }
class Repo extends Base {}
class Helper { public function help($n) { } }
class Saved {}
class Listener implements EventSubscriberInterface { public static function getSubscribedEvents() { return [Saved::class => 'onSaved']; } public function onSaved() {} }
"""


@pytest.fixture(scope="module")
def parsed(spark):
    files = spark.createDataFrame([("/p/Logger.php", LOGGER), ("/p/Service.php", SERVICE), ("/p/broken.php", "<?php class {"), ("/p/empty.php", None)], "file_path string, content string")
    return tables(fact_rows(files).persist())


def test_symbols(parsed):
    assert {r.fqn for r in parsed["classes"].collect()} >= {"Logger", "Service", "Base", "Repo", "Helper", "Saved", "Listener"}
    assert {(r.owner, r.name, r.type) for r in parsed["properties"].collect()} >= {("Service", "log", "Logger"), ("Service", "repo", "Repo"), ("Logger", "sink", "?Sink")}
    assert parsed["files"].count() == 4


def test_call_resolution(parsed):
    got = {(r.callee_name, r.target, r.how) for r in resolve_calls(resolve_sites(parsed)).collect() if r.caller == "Service::run"}
    assert {("setup", "Logger::setup"), ("log", "Logger::log"), ("help", "Helper::help"), ("find", "Base::find"), ("make", "Service::make"), ("strlen", None)} <= {(c, t) for c, t, _ in got}
    assert ("log", "Logger::log", "return_type_chain") in got


def test_events(parsed):
    assert [(r.caller, r.target) for r in synthetic_edges(parsed).collect()] == [("Service::run", "Listener::onSaved")]


def test_returns_and_nulls(parsed):
    assert {(r.method, r.problem) for r in parsed["returns"].where("problem IS NOT NULL").collect()} == set()
    assert parsed["cfg_blocks"].where(F.col("method") == "Service::run").count() == 1


def method(body, returns="", params=""):
    return parse(f"<?php class A {{ function f({params}){': ' + returns if returns else ''} {{ {body} }} }}")[0]["methods"][0]


@pytest.mark.parametrize(
    "body, declared, want",
    [
        ("return 'a';", "int", ["return_type_mismatch"]),
        ("$x = 1;", "int", ["missing_return"]),
        ("return;", "int", ["missing_return"]),
        ("return null;", "int", ["return_type_mismatch", "return_null_non_nullable"]),
        ("return 1;", "void", ["void_with_value"]),
        ("if ($a) { return 1; } else { return 'x'; }", "int", ["return_type_mismatch"]),
        ("if ($a) { return 1; } return 2;", "int", []),
        ("return null;", "?int", []),
        ("throw new X();", "int", []),
        ("return -1.5;", "float", []),
        ("$f = function() { return 'a'; }; return 1;", "int", []),
    ],
)
def test_return_diagnostics(body, declared, want):
    assert [p for p, _ in return_diagnostics(method(body, declared), declared)[1]] == want


@pytest.mark.parametrize(
    "body, want",
    [
        ("$a->x();", ["possibly_null"]),
        ("if ($a !== null) { $a->x(); }", ["definitely_not_null"]),
        ("if ($a === null) { return; } $a->x();", ["definitely_not_null"]),
        ("if ($a instanceof X) { $a->x(); } else { $a->y(); }", ["definitely_not_null", "possibly_null"]),
        ("$a = null; $a->x();", ["definitely_null"]),
        ("$a = new X; $a->p;", ["definitely_not_null"]),
        ("$b->x();", ["unknown"]),
        ("$a?->x();", []),
        ("$a[0];", ["possibly_null"]),
        ("$a[$a->x()];", ["possibly_null"]),
        ("$b = $a[0][1];", []),
        ("if ($a === null) { return; $b = 1; } $a->x();", ["definitely_not_null"]),
        ("foreach ($b as $c) { if ($a === null) { continue; } $a->x(); }", ["possibly_null"]),
        ("if ($a->x()) { $b = 1; } elseif ($a->y()) { $a->z(); } else { $a->w(); }", ["possibly_null"]),
        ("if ($b) { $a = new X; } $a->x();", ["definitely_not_null"]),
        ("if ($b instanceof X) { $b->x(); } else { $b->y(); }", ["definitely_not_null", "unknown"]),
        ("$a = 5; $a->x();", ["unknown"]),
    ],
)
def test_null_states(body, want):
    assert [s for *_, s in NullStates(method(body, "", "?X $a")).accesses] == want


def test_flow_paths():
    f = Flow(method("while ($a) { if ($b) { break; } continue; } do { $x = 1; } while ($c); try { f(); } catch (E $e) { return 1; } return 2;")["body"])
    assert not f.falls_through() and f.reachable() >= {0, 1, 2, 3}
    assert Flow(method("switch ($a) { case 1: return 1; default: $x = 2; }")["body"]).falls_through()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<?php class{}()[];$a->:=|&'\"fn\n \\", max_size=80))
def test_parser_never_fails(text):
    parse("<?php " + text)


def test_discover(spark):
    named = [("p", "psr-4", "App\\", "p/src"), ("p", "psr-0", "", "p/src/a"), ("p", "classmap", "", "p/old.php"), ("p", "files", "", "p/f.php"), ("p", "files", "", "p/src"), ("p", "psr-4", "X\\", "p/f.php")]
    entries = spark.createDataFrame(named, "root string, kind string, namespace string, path string")
    paths = ["p/src/a/x.php", "p/src/a/x.unit.php", "p/srcs/y.php", "p/old.php", "p/f.php", "p/src/readme.md", None]
    got = sorted(tuple(r)[1:] for r in projects.discover(entries, spark.createDataFrame([(x,) for x in paths], "file_path string")).collect())
    assert got == [("classmap", "p/old.php"), ("files", "p/f.php"), ("psr-0", "p/src/a/x.php"), ("psr-4", "p/src/a/x.php")]
    rows = spark.createDataFrame([("p", '{"name": "v/p", "require": {"php": "^8"}}'), ("q", "no")], "root string, content string")
    assert [tuple(r) for r in projects.project_info(rows).orderBy("root").collect()] == [("p", "v/p", None, "^8"), ("q", None, None, None)]


def test_manifests_and_settings(spark, tmp_path):
    doc = {"autoload": {"psr-4": {"App\\": ["src/", "lib"], "X\\": "x"}, "classmap": ["old"]}, "autoload-dev": {"classmap": ["new", 3], "files": ["f.php"]}}
    rows = spark.createDataFrame([("/r", json.dumps(doc)), ("/bad", "{"), ("/none", None)], "root string, content string")
    got = {(r.kind, r.namespace, r.path) for r in projects.autoload(rows).collect()}
    assert got == {("psr-4", "App\\", "/r/src"), ("psr-4", "App\\", "/r/lib"), ("psr-4", "X\\", "/r/x"), ("classmap", "", "/r/new"), ("files", "", "/r/f.php")}
    assert projects.settings('{"strict": 1, "checks": ["a", 2], "min-confidence": 0.5, "called-before": [{"before": "a", "after": "b"}, 3]}') == {"checks": ["a"], "strict": False, "min_confidence": 0.5, "called_before": [("a", "b")], "plugins": [], "exclude": []}
    (tmp_path / "m" / "p").mkdir(parents=True)
    (tmp_path / "m" / "p" / "composer.json").write_text(json.dumps(doc))
    (tmp_path / "m" / "p" / "A.php").write_text(LOGGER)
    (tmp_path / "m" / "p" / "A.unit.php").write_text(LOGGER)
    assert [r.root for r in projects.manifests(spark, [str(tmp_path / "m")]).collect()] == [str(tmp_path / "m" / "p")]
    assert [r.content for r in projects.source_files(spark, [str(tmp_path / "m")]).collect()] == [LOGGER]


def test_stream_of_files(spark, tmp_path):
    from factmill.streaming.facts import stream_facts

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "A.php").write_text(LOGGER)
    for _ in range(2):  # the second run finds nothing new
        stream_facts(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.where(F.col("table") == "classes").count() == 1


def test_stubs(spark, parsed):
    from factmill.operators.inherit import with_stubs

    classes = spark.createDataFrame([("Logger", None), ("Lib\\Http", None)], "fqn string, extends string")
    methods = spark.createDataFrame([("Logger", "x"), ("Lib\\Http", "get")], "owner string, name string")
    f = with_stubs(resolve_sites(parsed), classes, methods)
    assert f.classes.where("fqn = 'Logger'").count() == 1 and f.methods.where("name = 'x'").count() == 0 and f.methods.where("name = 'get'").count() == 1


CALLS = {
    "/a/lib.php": "<?php namespace App; function greet(string $n): string { return $n; } function trim($x) { return $x; }",
    "/a/Use.php": r"""<?php
namespace App;
use Ext\Client;
class User { public function go() { greet("a"); trim("b"); date("Y"); preg_match_all("a", "b"); unknown(1); Client::send(1); self::none(); } }
""",
}


def test_functions_builtins_and_external_static_calls(spark):
    from factmill.operators import liveness
    from factmill.sources.php.facts import BUILTIN_FUNCTIONS

    t = tables(fact_rows(spark.createDataFrame(list(CALLS.items()), "file_path string, content string")).persist())
    facts = resolve_sites(t)
    resolved = resolve_calls(facts, BUILTIN_FUNCTIONS)
    got = {r.callee_name: (r.target, r.confidence) for r in resolved.where("caller_class = 'App\\\\User'").collect()}
    assert len(set(BUILTIN_FUNCTIONS)) == 53
    assert got == {
        "App\\greet": ("App\\greet", 1.0),
        "App\\trim": ("App\\trim", 1.0),
        "date": ("date", 1.0),
        "preg_match_all": ("preg_match_all", 1.0),
        "App\\unknown": (None, 0.0),
        "send": ("Ext\\Client::send", 0.5),
        "none": ("App\\User::none", 0.5),
    }
    assert {"App\\greet", "Ext\\Client", "App\\User"} <= {r.target for r in liveness.references(facts, resolved).collect()}


def test_call_site_compliance(spark):
    from factmill.operators.boundary import boundary_calls
    from factmill.operators.violations import call_site_compliance

    files = {
        "/a/I.php": "<?php interface I { public function f(int $x, string $y): int; public function g(int $x): ?int; }",
        "/b/C.php": "<?php class C implements I { public function f(string $x): string { return ''; } public function g(int $x): int { return 1; } }",
        "/a/D.php": "<?php class D { public function run(C $c) { $c->f('a'); $c->g(1); } }",
    }
    t = tables(fact_rows(spark.createDataFrame(list(files.items()), "file_path string, content string")).persist())
    facts = resolve_sites(t).with_(projects=spark.createDataFrame([("/a/",), ("/b/",)], "root string"))
    calls = boundary_calls(facts, resolve_calls(facts))
    for scope in ("all", "cross_project"):
        got = sorted((r.target, r.interface, r.problem, r.pos) for r in call_site_compliance(facts, calls, scope).collect())
        assert got == [("C::f", "I", "param_count", None), ("C::f", "I", "param_type", 0), ("C::f", "I", "return_type", None)]


def test_long_access_paths_are_followed_to_their_end(spark):
    classes = "".join(f"class K{i} {{ public function next(): K{i + 1} {{ return new K{i + 1}(); }} }} " for i in range(26))
    run = "class Run { public function go(K0 $k) { $k" + "->next()" * 25 + "; } }"
    t = tables(fact_rows(spark.createDataFrame([("/p/K.php", f"<?php {classes}{run}")], "file_path string, content string")).persist())
    assert {r.target for r in resolve_calls(resolve_sites(t)).where("caller_class = 'Run'").collect()} == {f"K{i}::next" for i in range(25)}
