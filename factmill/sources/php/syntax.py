"""Lexer and recursive-descent parser for the part of PHP that the analyses look at.

Nodes are dicts with a kind and a line. Unknown constructs become expression
statements; errors skip to the next statement, so any text gives a tree.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(
    r"""
    (?P<doc>/\*\*(?!/).*?\*/)
  | (?P<skip>\s+|\#(?!\[)[^\n]*|//[^\n]*|/\*.*?\*/|\#\[[^\]]*\])
  | (?P<var>\$[A-Za-z_\x80-\U0010ffff]\w*)
  | (?P<name>\\?[A-Za-z_\x80-\U0010ffff]\w*(?:\\[A-Za-z_\x80-\U0010ffff]\w*)*)
  | (?P<number>\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?|\.\d+)
  | (?P<heredoc><<<\s*(?P<q>['"]?)(?P<tag>\w+)(?P=q)\r?\n.*?^\s*(?P=tag)\b)
  | (?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")
  | (?P<op>\?->|===|!==|<=>|\*\*=|\.\.\.|<<=|>>=|\?\?=|->|=>|::|==|!=|<>|<=|>=|&&|\|\||\?\?|\+\+|--|\+=|-=|\*=|/=|\.=|%=|&=|\|=|\^=|<<|>>|\*\*|.)
    """,
    re.X | re.S | re.M,
)
#: Words that start or shape statements (fixed values).
MODIFIERS = {"abstract", "final", "readonly", "public", "protected", "private", "static", "var"}
_ASSIGN = {"=", "+=", "-=", "*=", "/=", ".=", "%=", "??=", "&=", "|=", "^=", "<<=", ">>=", "**="}
_BINARY = {"or": 1, "xor": 1, "and": 1, "??": 3, "||": 4, "&&": 5, "|": 6, "^": 6, "&": 6, "==": 7, "!=": 7, "<>": 7, "===": 7, "!==": 7, "<=>": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, ".": 9, "<<": 9, ">>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "instanceof": 12, "**": 13}


def lex(text: str) -> list[tuple[str, str, int]]:
    """(kind, text, line) of everything between <?php and ?>; doc comments are tokens, other comments aren't."""
    out, at, line = [], 0, 1
    while True:
        start = text.find("<?php", at)
        if start < 0:
            return out
        line += text.count("\n", at, start)
        at = start + 5
        while at < len(text):
            if text.startswith("?>", at):
                out.append(("op", ";", line))
                at += 2
                break
            m = _TOKEN.match(text, at)
            kind = m.lastgroup if m.lastgroup not in ("q", "tag") else "heredoc"
            if kind != "skip":
                out.append(("string" if kind == "heredoc" else kind, m[0], line))
            line += m[0].count("\n")
            at = m.end()
        else:
            return out


class Parser:
    def __init__(self, text: str):
        self.t = lex(text)
        self.i = 0
        self.doc: str | None = None
        self.depth = 0

    # ---- tokens
    def peek(self, ahead: int = 0) -> str:
        self._docs()
        k = self.i
        while ahead and k < len(self.t):
            k += 1
            if k < len(self.t) and self.t[k][0] != "doc":
                ahead -= 1
        return self.t[k][1] if k < len(self.t) else ""

    def kind(self) -> str:
        self._docs()
        return self.t[self.i][0] if self.i < len(self.t) else ""

    def line(self) -> int:
        self._docs()
        return self.t[min(self.i, len(self.t) - 1)][2] if self.t else 0

    def _docs(self) -> None:
        while self.i < len(self.t) and self.t[self.i][0] == "doc":
            self.doc = self.t[self.i][1]
            self.i += 1

    def next(self) -> str:
        x = self.peek()
        self.i += 1
        return x

    def take(self, *wanted: str) -> bool:
        if self.peek().lower() in wanted and self.kind() != "string":
            self.i += 1
            return True
        return False

    def skip_to(self, *ends: str) -> None:
        """Past the first of ends at this nesting."""
        level = 0
        while self.peek():
            x = self.next()
            level += x in ("(", "[", "{")
            if not level and x in ends:
                return
            if x in (")", "]", "}"):
                level -= 1
                if level < 0:
                    self.i -= 1
                    return

    # ---- statements
    def program(self) -> list[dict]:
        return self.block_until("")

    def block_until(self, *ends: str) -> list[dict]:
        out = []
        while self.peek() and self.peek().lower() not in ends:
            at = self.i
            s = self.statement()
            if s:
                out.append(s)
            if self.i == at:
                self.i += 1
        return out

    def body(self) -> list[dict]:
        if self.take("{"):
            out = self.block_until("}")
            self.take("}")
            return out
        if self.take(":"):
            out = self.block_until("endif", "endwhile", "endfor", "endforeach", "endswitch", "else", "elseif")
            if self.take("endif", "endwhile", "endfor", "endforeach", "endswitch"):
                self.take(";")
            return out
        s = self.statement()
        return [s] if s else []

    def parens(self) -> dict | None:
        if not self.take("("):
            return None
        e = self.expression() if self.peek() != ")" else None
        self.skip_to(")")
        return e

    def statement(self) -> dict | None:
        self.depth += 1
        try:
            if self.depth > 200:
                self.skip_to(";", "}")
                return None
            return self._statement()
        finally:
            self.depth -= 1

    def _statement(self) -> dict | None:
        self.doc = None
        line, word = self.line(), self.peek().lower()
        after = self.peek(1)
        node = {"line": line}
        if self.kind() == "string":
            word = ""
        if word == "{":
            self.next()
            out = self.block_until("}")
            self.take("}")
            return node | {"kind": "block", "body": out}
        if word == ";":
            self.next()
            return None
        if word == "namespace" and after != "\\":
            self.next()
            name = self.next() if self.kind() == "name" else ""
            if self.take("{"):
                out = self.block_until("}")
                self.take("}")
                return node | {"kind": "namespace", "name": name, "body": out}
            self.take(";")
            return node | {"kind": "namespace", "name": name, "body": None}
        if word == "use":
            return self.use(node)
        if word in ("abstract", "final", "readonly", "class", "interface", "trait", "enum") and (word not in ("enum",) or self.kind() == "name") and after not in ("(", "::", "="):
            return self.declaration(node)
        if word == "function" and (self.t[self.i + 1 : self.i + 2] and (after == "&" or re.match(r"\w", after))):
            self.next()
            self.take("&")
            return self.function(node | {"kind": "function", "name": self.next(), "doc": self.doc})
        if word == "if":
            return self.conditional(node)
        if word in ("while", "for", "foreach", "switch"):
            self.next()
            if word == "while":
                cond = self.parens()
                return node | {"kind": "while", "cond": cond, "body": self.body()}
            if word == "for":
                parts = []
                if self.take("("):
                    while self.peek() and self.peek() != ")":
                        if not self.take(";", ","):
                            at = self.i
                            parts.append(self.expression())
                            self.i += self.i == at
                    self.take(")")
                return node | {"kind": "for", "cond": {"kind": "list", "items": parts, "line": line}, "body": self.body()}
            if word == "foreach":
                self.take("(")
                subject = self.expression()
                targets = []
                if self.take("as"):
                    while self.peek() not in (")", ""):
                        if not self.take("=>", "&", ","):
                            at = self.i
                            targets.append(self.expression())
                            self.i += self.i == at
                self.take(")")
                return node | {"kind": "foreach", "cond": subject, "targets": targets, "body": self.body()}
            cond = self.parens()
            return node | {"kind": "switch", "cond": cond, "cases": self.cases()}
        if word == "do":
            self.next()
            body = self.body()
            self.take("while")
            cond = self.parens()
            self.take(";")
            return node | {"kind": "do", "cond": cond, "body": body}
        if word == "try":
            return self.trying(node)
        if word in ("return", "throw", "echo", "break", "continue", "unset", "global", "print") and after not in ("->", "::"):
            self.next()
            value = self.expression() if self.peek() not in (";", "}", "") else None
            self.skip_to(";")
            return node | {"kind": word if word in ("return", "throw", "break", "continue") else "expression", "value": value, "text": word}
        if word == "static" and after.startswith("$"):
            self.next()
        value = self.expression()
        if self.peek() != ";":
            self.skip_to(";")
        else:
            self.next()
        return node | {"kind": "throw" if value and value["kind"] == "throw" else "expression", "value": value}

    def use(self, node: dict) -> dict:
        self.next()
        kind = self.next().lower() if self.peek().lower() in ("function", "const") else "class"
        items = []
        while self.kind() == "name":
            name = self.next()
            if self.peek() == "\\" or self.peek() == "{":  # grouped imports are ignored
                self.skip_to(";")
                return node | {"kind": "use", "items": []}
            alias = self.next() if self.take("as") else None
            items.append((name.lstrip("\\"), alias))
            self.take(",")
        if self.peek() == "{":
            self.next()
            self.skip_to("}")
        self.take(";")
        return node | {"kind": "use", "items": items, "of": kind}

    def conditional(self, node: dict) -> dict:
        self.next()
        cond = self.parens()
        node |= {"kind": "if", "cond": cond, "body": self.body(), "elseifs": [], "else": None}
        while True:
            if self.peek().lower() == "elseif" or (self.peek().lower() == "else" and self.peek(1).lower() == "if"):
                self.next() if self.take("else") else self.take("elseif")
                c = self.parens()
                node["elseifs"].append((c, self.body()))
            elif self.take("else"):
                node["else"] = self.body()
            else:
                return node

    def cases(self) -> list[tuple[dict | None, list[dict]]]:
        out = []
        if not self.take("{", ":"):
            return out
        while self.peek() and self.peek().lower() not in ("}", "endswitch"):
            if self.take("case"):
                value = self.expression()
            elif self.take("default"):
                value = None
            else:
                self.next()
                continue
            self.take(":", ";")
            out.append((value, self.block_until("case", "default", "}", "endswitch")))
        self.next()
        return out

    def trying(self, node: dict) -> dict:
        self.next()
        node |= {"kind": "try", "body": self.body(), "catches": [], "finally": None}
        while True:
            if self.take("catch"):
                types = []
                self.take("(")
                while self.peek() not in (")", ""):
                    types.append(self.next())
                self.take(")")
                node["catches"].append((types, self.body()))
            elif self.take("finally"):
                node["finally"] = self.body()
            else:
                return node

    # ---- declarations
    def declaration(self, node: dict) -> dict:
        flags = set()
        while self.peek().lower() in MODIFIERS:
            flags.add(self.next().lower())
        doc, kind = self.doc, self.next().lower()
        node |= {"kind": kind, "name": self.next(), "flags": flags, "doc": doc, "extends": [], "implements": [], "uses": [], "methods": [], "properties": []}
        while self.peek() not in ("{", ""):
            word = self.next().lower()
            if word in ("extends", "implements"):
                while self.kind() == "name" and self.peek().lower() not in ("implements", "extends"):
                    node[word].append(self.next())
                    self.take(",")
        self.take("{")
        while self.peek() and self.peek() != "}":
            at = self.i
            self.member(node)
            self.i += self.i == at
        node["end_line"] = self.line()
        self.take("}")
        return node

    def member(self, owner: dict) -> None:
        self.doc = None
        line, flags = self.line(), set()
        while self.peek().lower() in MODIFIERS and self.kind() == "name":
            flags.add(self.next().lower())
        doc = self.doc
        visibility = next((v for v in ("private", "protected", "public") if v in flags), "public")
        if self.take("use"):
            while self.kind() == "name":
                owner["uses"].append(self.next())
                self.take(",")
            self.skip_to("}") if self.take("{") else self.take(";")
        elif self.take("const", "case"):
            self.skip_to(";")
        elif self.take("function"):
            self.take("&")
            m = {"line": line, "kind": "method", "name": self.next(), "doc": doc, "flags": flags, "visibility": visibility}
            owner["methods"].append(self.function(m))
        else:
            kind = self.type()
            while self.kind() == "var":
                name = self.next()[1:]
                value = self.expression() if self.take("=") else None
                owner["properties"].append({"line": line, "name": name, "type": kind, "doc": doc, "visibility": visibility, "flags": flags, "value": value})
                self.take(",")
            self.skip_to(";")

    def type(self) -> str | None:
        """A declared type as text, or None."""
        out = ""
        while self.peek() in ("?", "|", "&", "(", ")") or self.kind() == "name":
            if self.peek() == ")" and "(" not in out:
                break
            if self.peek() == "&" and (self.peek(1).startswith("$") or self.peek(1) in ("...", "&")):
                break
            out += self.next()
        return out or None

    def params(self) -> list[dict]:
        out = []
        if not self.take("("):
            return out
        while self.peek() and self.peek() != ")":
            at = self.i
            flags = set()
            while self.peek().lower() in MODIFIERS:
                flags.add(self.next().lower())
            kind = self.type()
            ref, variadic = self.take("&"), self.take("...")
            if self.kind() == "var":
                name = self.next()[1:]
                default = self.expression() if self.take("=") else None
                out.append({"name": name, "type": kind, "default": default, "by_reference": ref, "variadic": variadic, "promoted": bool(flags - {"static"}), "visibility": next((v for v in ("private", "protected", "public") if v in flags), "public")})
            self.take(",")
            self.i += self.i == at
        self.take(")")
        return out

    def function(self, node: dict) -> dict:
        node["params"] = self.params()
        if self.take("use"):
            self.params()
        node["return_type"] = self.type() if self.take(":") else None
        if self.take("{"):
            node["body"] = self.block_until("}")
            node["end_line"] = self.line()
            self.take("}")
        else:
            node["body"] = None
            node["end_line"] = self.line()
            self.take(";")
        return node

    # ---- expressions
    def expression(self, least: int = 0) -> dict:
        self.depth += 1
        try:
            if self.depth > 200:
                self.skip_to(";")
                return {"kind": "unknown", "line": self.line()}
            return self._expression(least)
        finally:
            self.depth -= 1

    def _expression(self, least: int) -> dict:
        left = self.unary()
        while True:
            op = self.peek().lower()
            if self.kind() == "string":
                return left
            if op in _ASSIGN:
                line = self.line()
                self.next()
                self.take("&")
                left = {"kind": "assign", "op": op, "target": left, "value": self.expression(), "line": line}
            elif op == "?" and least <= 2:
                line = self.line()
                self.next()
                a = None if self.peek() == ":" else self.expression()
                self.take(":")
                left = {"kind": "ternary", "cond": left, "then": a, "else": self.expression(3), "line": line}
            elif op in _BINARY and _BINARY[op] >= max(least, 1):
                line = self.line()
                self.next()
                left = {"kind": "binary", "op": op, "left": left, "right": self.expression(_BINARY[op] + 1), "line": line}
            else:
                return left

    def unary(self) -> dict:
        line, word = self.line(), self.peek().lower()
        if self.kind() == "op" and word in ("!", "-", "+", "~", "@", "&", "++", "--", "..."):
            self.next()
            return {"kind": "unary", "op": word, "value": self.unary(), "line": line}
        if self.kind() == "name" and word in ("throw", "clone", "print", "yield", "include", "require", "include_once", "require_once", "await"):
            self.next()
            return {"kind": word, "value": self.expression() if self.peek() not in (";", ")", ",", "]") else None, "line": line}
        return self.postfix(self.primary())

    def arguments(self) -> list[dict]:
        out = []
        while self.peek() and self.peek() not in (")", "]"):
            at = self.i
            if self.kind() == "name" and self.peek(1) == ":" and self.peek(2) != ":":
                self.next()
                self.next()
            e = self.expression()
            if self.take("=>"):
                e = {"kind": "pair", "key": e, "value": self.expression(), "line": e["line"]}
            out.append(e)
            self.take(",")
            self.i += self.i == at
        self.next()
        return out

    def primary(self) -> dict:
        line, kind, word = self.line(), self.kind(), self.peek()
        low = word.lower()
        if kind == "var":
            self.next()
            return {"kind": "variable", "name": word[1:], "line": line}
        if kind == "number":
            self.next()
            return {"kind": "literal", "type": "float" if re.search(r"[.eE]", word) else "int", "line": line}
        if kind == "string":
            self.next()
            return {"kind": "literal", "type": "string", "value": word[1:-1], "line": line}
        if word == "(":
            self.next()
            if self.kind() == "name" and self.peek(1) == ")" and self.peek().lower() in ("int", "integer", "float", "double", "string", "bool", "boolean", "array", "object"):
                cast = self.next().lower()
                self.next()
                return {"kind": "cast", "type": cast, "value": self.unary(), "line": line}
            e = self.expression()
            self.skip_to(")")
            return e
        if word == "[":
            self.next()
            return {"kind": "literal", "type": "array", "items": self.arguments(), "line": line}
        if kind == "name":
            self.next()
            if low in ("true", "false"):
                return {"kind": "literal", "type": "bool", "line": line}
            if low == "null":
                return {"kind": "literal", "type": "null", "line": line}
            if low == "array" and self.take("("):
                return {"kind": "literal", "type": "array", "items": self.arguments(), "line": line}
            if low == "new":
                if self.peek().lower() == "class":
                    self.next()
                    if self.take("("):
                        self.arguments()
                    anonymous = {"kind": "class", "flags": set(), "extends": [], "implements": [], "uses": [], "methods": [], "properties": [], "name": "", "line": line}
                    self.skip_to("{")
                    while self.peek() and self.peek() != "}":
                        at = self.i
                        self.member(anonymous)
                        self.i += self.i == at
                    self.take("}")
                    return {"kind": "new", "class": None, "args": [], "line": line}
                name = self.next()
                return {"kind": "new", "class": name, "args": self.arguments() if self.take("(") else [], "line": line}
            if low in ("function", "fn") or (low == "static" and self.peek().lower() in ("function", "fn")):
                arrow = low == "fn" or (low == "static" and self.next().lower() == "fn")
                self.take("&")
                if arrow:
                    node = {"params": self.params()}
                    if self.take(":"):
                        self.type()
                    self.take("=>")
                    return {"kind": "closure", "body": [{"kind": "expression", "value": self.expression(), "line": line}], "line": line, **node}
                return self.function({"kind": "closure", "line": line})
            if low == "match" and self.peek() == "(":
                subject = self.parens()
                self.take("{")
                arms = []
                while self.peek() and self.peek() != "}":
                    at = self.i
                    if not self.take("=>", ","):
                        arms.append(self.expression())
                    self.i += self.i == at
                self.take("}")
                return {"kind": "match", "cond": subject, "arms": arms, "line": line}
            return {"kind": "name", "name": word, "line": line}
        if word not in (")", "]", "}", ";", ",", ""):
            self.next()
        return {"kind": "unknown", "line": line}

    def postfix(self, e: dict) -> dict:
        while True:
            line, op = self.line(), self.peek()
            if self.kind() != "op":
                return e
            if op in ("->", "?->"):
                self.next()
                name = self.next() if self.kind() in ("name", "var") else ""
                if name == "" and self.take("{"):
                    self.skip_to("}")
                if self.take("("):
                    e = {"kind": "member_call", "object": e, "name": name, "args": self.arguments(), "line": line, "null_safe": op == "?->"}
                else:
                    e = {"kind": "property", "object": e, "name": name, "line": line, "null_safe": op == "?->"}
            elif op == "::":
                self.next()
                name = self.next()
                if self.take("("):
                    e = {"kind": "static_call", "class": e.get("name"), "name": name, "args": self.arguments(), "line": line}
                else:
                    e = {"kind": "class_constant", "class": e.get("name"), "name": name, "line": line}
            elif op == "(":
                self.next()
                e = {"kind": "call", "name": e.get("name") if e["kind"] == "name" else None, "function": e, "args": self.arguments(), "line": line}
            elif op in ("[", "{") and e["kind"] not in ("literal", "name", "unknown") and op == "[":
                self.next()
                e = {"kind": "index", "object": e, "args": self.arguments(), "line": line}
            elif op in ("++", "--"):
                self.next()
            else:
                return e


def parse(text: str) -> list[dict]:
    """Statements of a file. Never fails: what can't be read is skipped."""
    return Parser(text).program()


def walk(node, into_functions: bool = True):
    """All nodes in pre-order; closures and nested functions only if asked for."""
    if isinstance(node, dict):
        if "kind" in node:
            yield node
        for k, v in node.items():
            if k not in ("line", "kind", "name"):
                if not into_functions and isinstance(v, dict) and v.get("kind") in ("closure", "function"):
                    continue
                yield from walk(v, into_functions)
    elif isinstance(node, (list, tuple)):
        for v in node:
            if not into_functions and isinstance(v, dict) and v.get("kind") in ("closure", "function", "class"):
                continue
            yield from walk(v, into_functions)
