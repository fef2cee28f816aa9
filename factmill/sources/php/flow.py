"""Control flow of a function body: blocks, edges, and what can be said about returns and null."""

from __future__ import annotations

from dataclasses import dataclass, field

from .syntax import walk

LOOPS = ("while", "for", "foreach")


@dataclass
class Block:
    statements: list[dict] = field(default_factory=list)
    terminator: str = "none"


class Flow:
    """Blocks numbered in the order of their creation, the entry 0, and edges between them.

    Kept as the analyses expect it: an if without else in the entry block has no
    edge to what follows; a switch without default has none from its head.
    """

    def __init__(self, body: list[dict]):
        self.blocks: list[Block] = [Block()]
        self.edges: list[tuple[int, int]] = []
        self.loops: list[tuple[int, int]] = []  # where continue and break go
        self.end = self.run(body, 0)

    def new(self) -> int:
        self.blocks.append(Block())
        return len(self.blocks) - 1

    def edge(self, a: int, b: int) -> None:
        if (a, b) not in self.edges:
            self.edges.append((a, b))

    def open(self, b: int) -> bool:
        return self.blocks[b].terminator == "none"

    def close(self, b: int, how: str, *to: int) -> None:
        self.blocks[b].terminator = how
        for x in to:
            self.edge(b, x)

    def run(self, body: list[dict], at: int) -> int:
        for s in body or []:
            at = getattr(self, f"_{s['kind']}", self._plain)(s, at)
        return at

    def _plain(self, s: dict, at: int) -> int:
        self.blocks[at].statements.append(s)
        return at

    def _block(self, s: dict, at: int) -> int:
        return self.run(s["body"], at)

    def _return(self, s: dict, at: int) -> int:
        self._plain(s, at)
        self.close(at, s["kind"])
        return at

    _throw = _return

    def _break(self, s: dict, at: int) -> int:
        self._plain(s, at)
        self.close(at, s["kind"], *([self.loops[-1][s["kind"] == "break"]] if self.loops else []))
        return at

    _continue = _break

    def _if(self, s: dict, at: int) -> int:
        self.blocks[at].statements.append({"kind": "condition", "value": s["cond"], "line": s["line"]})
        join = self.new()
        last = at
        for k, (cond, body) in enumerate([(s["cond"], s["body"]), *s["elseifs"]]):
            if k:
                test = self.new()
                self.edge(last, test)
                self.blocks[last].terminator = "branch"
                self.blocks[test].statements.append({"kind": "condition", "value": cond, "line": s["line"]})
                last = test
            then = self.new()
            self.edge(last, then)
            end = self.run(body, then)
            if self.open(end):
                self.edge(end, join)
        self.blocks[last].terminator = "branch"
        if s["else"] is not None:
            other = self.new()
            self.edge(last, other)
            end = self.run(s["else"], other)
            if self.open(end):
                self.edge(end, join)
        elif last:
            self.edge(last, join)
        self.blocks[at].terminator = "branch"
        return join

    def _loop(self, s: dict, at: int) -> int:
        if s["kind"] in ("for", "foreach"):
            self._plain({"kind": "condition", "value": s["cond"], "line": s["line"]}, at)
        head, body, out = self.new(), self.new(), self.new()
        self.edge(at, head)
        self.close(head, "branch", body, out)
        self.loops.append((head, out))
        end = self.run(s["body"], body)
        self.loops.pop()
        if self.open(end):
            self.close(end, "loop_back", head)
        return out

    _while = _for = _foreach = _loop

    def _do(self, s: dict, at: int) -> int:
        body, cond, out = self.new(), self.new(), self.new()
        self.edge(at, body)
        self.loops.append((cond, out))
        end = self.run(s["body"], body)
        self.loops.pop()
        if self.open(end):
            self.edge(end, cond)
        self.close(cond, "branch", body, out)
        return out

    def _switch(self, s: dict, at: int) -> int:
        out = self.new()
        self.loops.append((at, out))
        before = None
        for value, body in s["cases"]:
            case = self.new()
            self.edge(at, case)
            if before is not None and self.open(before):
                self.edge(before, case)
            before = self.run(body, case)
        if before is not None and self.open(before):
            self.edge(before, out)
        self.loops.pop()
        self.blocks[at].terminator = "branch"
        return out

    def _try(self, s: dict, at: int) -> int:
        body, join = self.new(), self.new()
        self.edge(at, body)
        end = self.run(s["body"], body)
        if self.open(end):
            self.edge(end, join)
        for _, handler in s["catches"]:
            c = self.new()
            self.edge(body, c)
            end = self.run(handler, c)
            if self.open(end):
                self.edge(end, join)
        return self.run(s["finally"] or [], join)

    def reachable(self) -> set[int]:
        seen, todo = {0}, [0]
        while todo:
            b = todo.pop()
            for x, y in self.edges:
                if x == b and y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    def falls_through(self) -> bool:
        """Whether a reachable block without successors ends in neither return nor throw."""
        sources = {x for x, _ in self.edges}
        return any(b not in sources and self.blocks[b].terminator not in ("return", "throw") for b in self.reachable())


def literal_type(e: dict | None) -> str | None:
    """The type of a value that shows it: literals, signed numbers, new X."""
    if e is None:
        return None
    if e["kind"] == "literal":
        return e["type"]
    if e["kind"] == "unary" and e["op"] in ("-", "+"):
        return literal_type(e["value"])
    if e["kind"] == "new":
        return e["class"]
    return None


def _base(t: str) -> str:
    return t.lstrip("?").split("<")[0].removesuffix("[]") if t else "mixed"


def _alias(a: str, b: str) -> bool:
    return any(a in p and b in p for p in (("int", "integer"), ("bool", "boolean"), ("float", "double")))


def fits(value: str, declared: str) -> bool:
    """Whether a literal's type may be returned where declared stands."""
    if not declared or declared.lower() == "mixed":
        return True
    if declared.startswith("?") and value == "null":
        return True
    if "|" in declared:
        return any(p == value or _alias(p, value) or p.lower() == "mixed" for p in declared.split("|"))
    d = _base(declared)
    return d == value or d.endswith("\\" + value) or value.endswith("\\" + d) or _alias(d, value)


def return_diagnostics(method: dict, declared: str | None) -> tuple[str, list[tuple[str, int]]]:
    """(verified, uncertain or failed; diagnostics with lines) of one method."""
    if not declared:
        return "uncertain", []
    if "abstract" in method.get("flags", ()) or method["body"] is None:
        return "verified", []
    out = []
    for r in walk(method["body"], into_functions=False):
        if r["kind"] != "return":
            continue
        if declared == "void":
            if r["value"] is not None:
                out.append(("void_with_value", r["line"]))
        elif r["value"] is None:
            out.append(("missing_return", r["line"]))
        else:
            value = literal_type(r["value"])
            if value is not None:
                if not fits(value, declared):
                    out.append(("return_type_mismatch", r["line"]))
                if value == "null" and not declared.startswith("?") and declared.lower() != "mixed":
                    out.append(("return_null_non_nullable", r["line"]))
    if declared not in ("void", "never") and Flow(method["body"]).falls_through():
        out.append(("missing_return", method["end_line"]))
    return ("failed" if out else "verified"), out


MAYBE, NULL, NOT_NULL, UNKNOWN = "possibly_null", "definitely_null", "definitely_not_null", "unknown"


class NullStates:
    """Follows what is known of variables, statement by statement, and records accesses.

    Loops and other constructs are walked once. What a guarded branch learns
    ends with it, but for a return or throw in the branch of a null test. An if
    without a null test shares its state with what follows; its condition and
    its elseif branches aren't looked at, nor are those of a guarded one.
    """

    ACCESS = {"member_call": "method", "property": "property", "index": "array"}

    def __init__(self, method: dict, returns: dict[str, str | None] | None = None):
        self.accesses: list[tuple[str, str, int, str]] = []  # variable, kind, line, state
        self.returns = returns or {}
        state: dict[str, str] = {}
        doc = method.get("doc") or ""
        for p in method["params"]:
            t, default = p["type"], p["default"]
            nullable = (t or "").startswith("?") or "null" in (t or "").lower().split("|") or (default is not None and default.get("type") == "null")
            if nullable:
                state["$" + p["name"]] = MAYBE
            elif t:
                state["$" + p["name"]] = NOT_NULL
            else:
                for line in doc.split("\n"):
                    words = line.replace("*", " ").split()
                    if len(words) >= 3 and words[0] == "@param" and words[2] == "$" + p["name"]:
                        state["$" + p["name"]] = MAYBE if words[1].startswith("?") or "null" in words[1].split("|") else NOT_NULL
        self.run(method["body"] or [], state)

    @staticmethod
    def key(e: dict | None) -> str | None:
        if e is None:
            return None
        if e["kind"] == "variable":
            return "$" + e["name"]
        if e["kind"] == "property" and (inner := NullStates.key(e["object"])):
            return f"{inner}->{e['name']}"
        return None

    def scan(self, e, state: dict[str, str]) -> None:
        """Record accesses; what stands inside a subscript access isn't looked at."""
        inside: set[int] = set()
        for x in walk(e):
            if id(x) in inside:
                continue
            if x["kind"] == "index":
                inside.update(id(y) for y in walk([x["object"], x["args"]]))
            if x["kind"] in self.ACCESS and not x.get("null_safe") and (k := self.key(x["object"])) and k != "$this":
                self.accesses.append((k, self.ACCESS[x["kind"]], x["line"], state.get(k, UNKNOWN)))

    def assigned(self, e: dict, state: dict[str, str]) -> str:
        if e["kind"] == "literal":
            return NULL if e["type"] == "null" else UNKNOWN
        if e["kind"] == "new":
            return NOT_NULL
        if k := self.key(e):
            return state.get(k, UNKNOWN)
        if e["kind"] == "member_call" and self.key(e["object"]) == "$this":
            t = self.returns.get(e["name"])
            return UNKNOWN if not t else MAYBE if t.startswith("?") or "null" in t.split("|") else NOT_NULL
        return UNKNOWN

    def guard(self, c: dict | None) -> tuple[str, str, str | None] | None:
        """(variable, state if the condition holds, state if not; None: as before)."""
        if c is None or c["kind"] != "binary":
            return None
        if c["op"] == "instanceof" and (k := self.key(c["left"])):
            return k, NOT_NULL, None
        a, b = c["left"], c["right"]
        if b["kind"] == "literal" and b["type"] == "null":
            k = self.key(a)
        elif a["kind"] == "literal" and a["type"] == "null":
            k = self.key(b)
        else:
            return None
        if not k:
            return None
        if c["op"] in ("!==", "!=", "<>"):
            return k, NOT_NULL, MAYBE
        if c["op"] in ("===", "=="):
            return k, NULL, NOT_NULL
        return None

    def run(self, body: list[dict], state: dict[str, str]) -> None:
        for s in body:
            self.statement(s, state)

    def statement(self, s: dict, state: dict[str, str]) -> None:
        if s["kind"] == "if":
            g = self.guard(s["cond"])
            if g is None:
                self.run(s["body"], state)
                self.run(s["else"] or [], state)
                return
            k, yes, no = g
            self.run(s["body"], state | {k: yes})
            if s["else"] is not None:
                self.run(s["else"], state | ({k: no} if no else {}))
            if yes == NULL and any(x["kind"] in ("return", "throw") for x in s["body"]):
                state[k] = NOT_NULL
            return
        if s["kind"] in ("block", "while", "for", "foreach", "do", "try"):
            if s.get("cond"):
                self.scan(s["cond"], state)
            self.run(s["body"] or [], state)
            for _, handler in s.get("catches", []):
                self.run(handler, state)
            self.run(s.get("finally") or [], state)
            return
        if s["kind"] == "switch":
            self.scan(s["cond"], state)
            for _, body in s["cases"]:
                self.run(body, state)
            return
        e = s.get("value")
        if e is not None and e["kind"] == "assign":
            self.scan(e["value"], state)
            k = self.key(e["target"])
            if k and e["op"] == "=":
                if e["target"]["kind"] == "property":
                    self.scan(e["target"]["object"], state)
                state[k] = self.assigned(e["value"], state)
            else:
                self.scan(e["target"], state)
        elif e is not None:
            self.scan(e, state)
