"""Symbols, imports, calls and inheritance of one source text, by language.

Python goes through the standard syntax tree; the other languages through their tokens with matched brackets, which need
no complete grammar and survive code that does not parse. A parser is a function (path, text) -> Parsed; PARSERS can be
extended by language.
"""

from __future__ import annotations

import ast
import bisect
import re
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from . import lexing as lx


@dataclass
class Parsed:
    symbols: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    inheritance: list[dict] = field(default_factory=list)

    def symbol(self, path, name, qualified, kind, start, end, doc=None, parameters=(), types=None, exported=True, entry=False, complexity=1):
        self.symbols.append({"id": f"{path}::{qualified}", "name": name, "qualified_name": qualified, "kind": kind, "file_path": path, "line_start": start, "line_end": end, "docstring": doc, "parameters": list(parameters), "param_types": dict(types or {}), "is_exported": exported, "is_entrypoint": entry, "complexity": complexity})

    def imported(self, source, name, alias, line, wildcard=False):
        self.imports.append({"source_module": source, "imported_name": name, "alias": alias, "line_number": line, "is_wildcard": wildcard})

    def call(self, caller, callee, line):
        self.calls.append({"caller_id": caller, "callee_name": callee, "line_number": line})

    def inherits(self, child, parent, relation):
        self.inheritance.append({"child_id": child, "parent_name": parent, "relation": relation})


def _stem(path: str) -> str:
    return re.sub(r"(?<=.)\.[^.]*$", "", path.rpartition("/")[2])


# --- Python

#: Words that mark a decorated function as an entry point.
_ROUTES = ("route", "get", "post", "put", "delete", "patch", "api", "endpoint", "command")
_PY_BRANCH = frozenset((ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp))
_PY_SCOPE = frozenset((ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))
_PY_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")


def _children(n: ast.AST) -> list[ast.AST]:
    """As ast.iter_child_nodes, but for contexts and operators, which hold nothing."""
    found = []
    if type(n) is not ast.Name and type(n) is not ast.Constant:
        for f in n._fields:
            x = getattr(n, f, None)
            if type(x) is list:
                found += [y for y in x if isinstance(y, ast.AST)]
            elif isinstance(x, ast.AST) and x._fields:
                found.append(x)
    return found


def parse_python(path: str, text: str) -> Parsed:
    out, module = Parsed(), f"{path}::<module>"
    out.symbol(path, _stem(path), "<module>", "module", 1, text.count("\n") + 1)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return out
    lines = _PY_LINE.findall(text)
    ascii_ = text.isascii()

    def source(node) -> str:
        """As ast.get_source_segment, which splits the whole text for each node; offsets are in bytes."""
        a, b = node.lineno - 1, node.end_lineno
        rows = lines[a:b] if ascii_ else [x.encode() for x in lines[a:b]]
        rows[-1] = rows[-1][: node.end_col_offset]
        rows[0] = rows[0][node.col_offset :]
        return "".join(rows) if ascii_ else b"".join(rows).decode()

    def docstring(node) -> str | None:
        """With escapes of lone surrogates, which no table can hold, as they were written."""
        doc = ast.get_docstring(node)
        return doc and doc.encode("utf-8", "backslashreplace").decode()

    def branches(nodes) -> int:
        total, stack = 0, list(nodes)
        while stack:
            n = stack.pop()
            if type(n) in _PY_BRANCH:
                total += 1
            elif type(n) is ast.BoolOp:
                total += len(n.values) - 1
            stack += _children(n)
        return total

    def function(node, caller) -> int:
        """Puts the calls of a function's body, but for those within definitions there; returns its complexity."""
        total, stack = 1, node.body[::-1]
        while stack:
            n = stack.pop()
            kind = type(n)
            if kind in _PY_SCOPE:
                total += branches([n])
                continue
            if kind is ast.Call:
                out.call(caller, source(n.func), n.lineno)
            elif kind in _PY_BRANCH:
                total += 1
            elif kind is ast.BoolOp:
                total += len(n.values) - 1
            stack += _children(n)[::-1]
        return total + branches([*node.decorator_list, node.args, *([node.returns] if node.returns else []), *node.type_params])

    def walk(body, scope):
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                q = f"{scope}.{n.name}" if scope else n.name
                a = n.args
                plain = [*a.posonlyargs, *a.args]
                defaults = {x.arg for x in plain[len(plain) - len(a.defaults) :]} if a.defaults else set()
                kept = [x for x in plain if x.arg not in ("self", "cls") and not (x.annotation and x.arg in defaults)]
                types = {x.arg: source(x.annotation) for x in kept if x.annotation}
                routed = any(w in source(d).lower() for d in n.decorator_list for w in _ROUTES)
                out.symbol(path, n.name, q, "method" if scope else "function", n.lineno, n.end_lineno, docstring(n), [x.arg for x in kept], types, not n.name.startswith("_"), routed or n.name == "main" or n.name.startswith("test_"), function(n, f"{path}::{q}"))
                walk(n.body, q)
            elif isinstance(n, ast.ClassDef):
                q = f"{scope}.{n.name}" if scope else n.name
                out.symbol(path, n.name, q, "class", n.lineno, n.end_lineno, docstring(n), exported=not n.name.startswith("_"), entry=n.name.startswith("Test") or n.name.endswith("Test"))
                for base in n.bases:
                    if isinstance(base, (ast.Name, ast.Attribute)):
                        out.inherits(f"{path}::{q}", source(base), "EXTENDS")
                walk(n.body, q)
            elif isinstance(n, ast.Import):
                for x in n.names:
                    out.imported(x.name, x.name.rpartition(".")[2], x.asname, n.lineno)
            elif isinstance(n, ast.ImportFrom):
                for x in n.names:
                    out.imported("." * n.level + (n.module or ""), x.name, x.asname, n.lineno, x.name == "*")
            elif isinstance(n, ast.Expr) and isinstance(n.value, ast.Call):
                out.call(module, source(n.value.func), n.lineno)  # statements of any body also count for the module

    walk(tree.body, "")
    return out


# --- languages with braces


_CLOSER = {"(": ")", "[": "]", "{": "}"}
_CLOSERS = frozenset(_CLOSER.values())
_BRACKETS = _CLOSERS.union(_CLOSER)
_BREAK = re.compile("\n")


def _pairs(words: list[str]) -> dict[int, int] | None:
    """The partner of each opening bracket, or None where brackets don't match."""
    partner, stack = {}, []
    for i in [i for i, w in enumerate(words) if w in _BRACKETS]:
        if words[i] in _CLOSER:
            stack.append(i)
        elif not stack or _CLOSER[words[stack[-1]]] != words[i]:
            return None
        else:
            partner[stack.pop()] = i
    return None if stack else partner


class _Lines:
    """The line of each token, looked up when asked for, since few are."""

    def __init__(self, text: str, starts: list[int]):
        self.starts, self.breaks = starts, [m.start() for m in _BREAK.finditer(text)]

    def __getitem__(self, i: int) -> int:
        return bisect.bisect_left(self.breaks, self.starts[i]) + 1

    def __iter__(self) -> Iterator[int]:
        return map(self.__getitem__, range(len(self.starts)))


class _Code:
    """Tokens as words, their lines, and the partner of each bracket.

    Where brackets don't match, the missing ones are put in: a bracket ends at the latest with the one around it, before a
    line that is indented no deeper than its own, or with the text. One that closes nothing is an ordinary word.
    """

    def __init__(self, text: str, ext: str):
        t = lx.tokens(text, ext)
        source, starts, ends = t.text, t.starts, t.ends
        self.words = [source[a:b] for a, b in zip(starts, ends) if b > a]
        self.lines = _Lines(text, [a for a, b in zip(starts, ends) if b > a])
        self.partner = _pairs(self.words)
        if self.partner is None:
            self._mend(source, [(k, a, b) for k, a, b in zip(t.kinds, starts, ends) if b > a])
        name = {w: w[0].isalpha() or w[0] in "_$" for w in set(self.words)}
        self.names = [name[w] for w in self.words]
        self.n = len(self.words)

    def _mend(self, source: str, spans: list[tuple[str, int, int]]) -> None:
        words, plain, lines, stack, last, indent, counts = [], [], [], [], 0, 0, dict.fromkeys(_CLOSERS, 0)

        def put(w, bracket, line):
            words.append(w)
            plain.append(w if bracket else "")
            lines.append(line)

        def close():
            w = stack.pop()[0]
            counts[w] -= 1
            return w

        def missing():
            w = close()
            put(w, True, lines[-1])

        for (k, a, b), w, line in zip(spans, self.words, self.lines):
            first = not words or "\n" in source[last:a]
            last = b
            closes = w in _CLOSERS and k != lx.JTEXT
            if first:
                indent = a - source.rfind("\n", 0, a) - 1
                level = indent + (closes or w in ("case", "default"))
                while stack and stack[-1][1] >= level and (closes or w[0].isalpha() or w[0] in "_$@#"):  # not markers of conflicts
                    missing()
            if closes:
                if counts[w] and not (first and stack[-1][1] < indent and w == "}"):
                    while stack[-1][0] != w:
                        missing()
                    close()
                else:
                    closes = False
            opens = w in _CLOSER and k != lx.JTEXT
            if opens:
                stack.append((_CLOSER[w], indent))
                counts[_CLOSER[w]] += 1
            put(w, opens or closes, line)
        while stack:
            missing()
        self.words, self.lines, self.partner = words, lines, _pairs(plain)

    def w(self, i: int) -> str:
        return self.words[i] if 0 <= i < self.n else ""

    def find(self, i: int, end: int, *wanted: str) -> int:
        """The first of some words from i on at this depth, or end."""
        while i < end:
            if self.words[i] in wanted:
                return i
            i = self.partner.get(i, i) + 1
        return end

    def dotted(self, i: int, seps=(".", "?.", "::")) -> int:
        """The token after a chain of names from i on."""
        i += 1
        while self.w(i) in seps and i + 1 < self.n and self.names[i + 1]:
            i += 2
        return i

    def text(self, a: int, b: int) -> str:
        return "".join(self.words[a:b])

    def branches(self, a: int, b: int, words: frozenset[str]) -> int:
        return 1 + sum(map(words.__contains__, self.words[a:b]))

    def parameters(self, a: int, b: int) -> list[list[str]]:
        """Words of each parameter between two brackets."""
        parts, last, i, angle = [], a + 1, a + 1, 0
        while i < b:
            w = self.words[i]
            angle += (w == "<") - (w == ">" and self.w(i - 1) not in ("=", "-"))
            if w == "," and angle <= 0:
                parts.append(self.words[last:i])
                last = i + 1
            i = self.partner.get(i, i) + 1
        parts.append(self.words[last:b])
        return [p for p in parts if p]


#: Words that open a branch, by language.
_BRANCH = {"script": frozenset("if for while do catch case ?".split()), "java": frozenset("if for while do catch case ?".split()), "go": frozenset("if for switch select case".split()), "rust": frozenset("if for while loop => ?".split())}
_NO_CALL = frozenset("if for while switch catch return function super typeof await yield new throw match loop in of func fn case else do try import".split())


def _calls(c: _Code, out: Parsed, a: int, b: int, caller: str, skip: list[tuple[int, int]] = (), requires: bool = False) -> None:
    """Calls name(...) and a.b.c(...) between two tokens; `new X()` and macros are none."""
    i, b = a, min(b, c.n)
    while i < b:
        hole = skip and next((e for s, e in skip if s <= i < e), 0)
        if hole:
            i = hole
            continue
        if c.names[i] and c.w(i - 1) not in (".", "?.", "::", "new", "func", "fn", "function"):
            e = c.dotted(i)
            g = e
            if c.w(g) == "::" and c.w(g + 1) == "<":
                g = c.find(g + 2, b, ">") + 1
            if c.w(g) == "(" and c.words[i] not in _NO_CALL - {"super"} and not (e == i + 1 and c.words[i] == "super"):
                name = c.text(i, e)
                if requires and name == "require" and c.w(g + 1) and c.w(g + 1)[0] in "'\"":
                    m = c.w(g + 1).strip("'\"")
                    out.imported(m, m.rpartition("/")[2], None, c.lines[i])
                else:
                    out.call(caller, name, c.lines[i])
            i = e
        else:
            i += 1


def _types(c: _Code, i: int, end: int) -> list[str]:
    """Dotted names from i on, split by commas, type arguments left out."""
    found, level = [], 0
    while i < end:
        w = c.words[i]
        level += (w == "<") - (w == ">")
        if not level and c.names[i] and w not in ("extends", "implements", "permits"):
            e = c.dotted(i)
            found.append(c.text(i, e))
            i = e
            continue
        i += 1
    return found


def parse_script(path: str, text: str) -> Parsed:
    out, module, ext = Parsed(), f"{path}::<module>", lx.extension(path)
    out.symbol(path, _stem(path), "<module>", "module", 1, text.count("\n") + 1)
    try:
        c = _Code(text, ext)
    except lx.LexError:
        return out

    def names(a, b):
        ps = [[w for w in p if w not in ("public", "private", "protected", "readonly", "override", "...")] for p in c.parameters(a, b)]
        return [p[0] for p in ps if p and (p[0][0].isalpha() or p[0][0] in "_$") and p[0] != "this"]

    def function(name, q, kind, at, open_, body, end, exported, entry):
        out.symbol(path, name, q, kind, c.lines[at], c.lines[min(end, c.n - 1)], None, names(open_, c.partner.get(open_, open_)), None, exported, entry, c.branches(body, end + 1, _BRANCH["script"]))
        _calls(c, out, body, end + 1, f"{path}::{q}", requires=True)

    def is_entry(name):
        return name in ("main", "handler") or name.startswith("test")

    i = 0
    while i < c.n:
        start, exported = i, False
        while c.w(i) in ("export", "default", "declare", "abstract", "async"):
            exported = exported or c.words[i] == "export"
            i += 1
        w = c.w(i)
        if w == "function":
            i += 2 if c.w(i + 1) == "*" else 1
            name = c.w(i)
            open_ = c.find(i, c.n, "(")
            body = c.find(c.partner.get(open_, open_) + 1, c.n, "{", ";")
            end = c.partner.get(body, body)
            function(name, name, "function", start, open_, body, end, exported, is_entry(name))
            i = end + 1
        elif w == "class" and i + 1 < c.n:
            name, body = c.w(i + 1), c.find(i + 1, c.n, "{")
            end, qid = c.partner.get(body, c.n - 1), f"{path}::{c.w(i + 1)}"
            out.symbol(path, name, name, "class", c.lines[start], c.lines[min(end, c.n - 1)], exported=exported)
            impl = c.find(i + 2, body, "implements")
            ext_at = c.find(i + 2, impl, "extends")
            for p in _types(c, ext_at + 1, impl)[:1]:
                out.inherits(qid, p, "EXTENDS")
            for p in _types(c, impl + 1, body):
                out.inherits(qid, p, "IMPLEMENTS")
            j = body + 1
            while j < end:
                if c.names[j] and c.w(j + 1) in ("(", "<") and c.words[j] not in ("if", "for", "while", "switch") and c.w(j - 1) != "@":
                    open_ = j + 1 if c.w(j + 1) == "(" else c.find(j + 1, end, "(")
                    b = c.find(c.partner.get(open_, end) + 1, end, "{", ";")
                    if c.w(b) == "{":
                        function(c.words[j], f"{name}.{c.words[j]}", "method", j, open_, b, c.partner.get(b, end), exported, False)
                        j = c.partner.get(b, end) + 1
                        continue
                    j = b + 1
                    continue
                if c.w(j) == "=":  # a field: its value holds no methods of this class
                    j = c.find(j, end, ";")
                j = c.partner.get(j, j) + 1
            i = end + 1
        elif w == "interface" and c.names[i + 1 : i + 2] == [True]:
            body = c.find(i + 1, c.n, "{")
            end = c.partner.get(body, c.n - 1)
            out.symbol(path, c.w(i + 1), c.w(i + 1), "interface", c.lines[start], c.lines[min(end, c.n - 1)], exported=exported)
            i = end + 1
        elif w in ("const", "let", "var"):
            end = c.find(i, c.n, ";")
            eq = c.find(i + 1, end, "=")
            j = eq + (2 if c.w(eq + 1) == "async" else 1)
            name = c.w(i + 1)
            if eq < end and (c.w(j) == "function" or c.w(j) == "(" and (c.w(c.partner.get(j, j) + 1) in ("=>", ":")) or c.names[j : j + 1] == [True] and c.w(j + 1) == "=>"):
                open_ = c.find(j, end, "(") if c.w(j) != "(" and c.w(j + 1) != "=>" else j
                body = c.find(c.partner.get(open_, open_) + 1, end, "{")
                stop = c.partner.get(body, end) if body < end else end
                function(name, name, "function", start, open_, min(body, end), min(stop, c.n - 1), exported, is_entry(name))
                i = stop + 1
            else:
                _calls(c, out, eq + 1, min(end, c.n), module, requires=True)
                i = end + 1
        elif w == "import" and c.w(i + 1) != "(":
            end = i + 1
            while end < c.n and not (c.words[end][0] in "'\""):
                end += 1
            src, line, j = c.w(end).strip("'\""), c.lines[i], i + 1
            while j < end:
                x = c.words[j]
                if x == "*":
                    out.imported(src, "*", c.w(j + 2), line, True)
                    j += 3
                elif x == "{":
                    for p in c.parameters(j, c.partner.get(j, end)):
                        p = [y for k, y in enumerate(p) if not (y == "type" and k == 0 and len(p) > 1)]
                        out.imported(src, p[0], p[2] if len(p) > 2 and p[1] == "as" else None, line)
                    j = c.partner.get(j, end) + 1
                elif c.names[j] and x not in ("from", "type"):
                    out.imported(src, x, None, line)
                    j += 1
                else:
                    j += 1
            i = end + 1
        else:
            end = c.find(i, c.n, ";") if w not in ("if", "for", "while", "{", "try", "switch") else c.partner.get(c.find(i, c.n, "{"), i)
            if c.names[i : i + 1] == [True] and w not in _NO_CALL:
                _calls(c, out, i, min(end, c.n), module)
            i = max(end, i) + 1
    return out


def parse_java(path: str, text: str) -> Parsed:
    out = Parsed()
    try:
        c = _Code(text, "java")
    except lx.LexError:
        out.symbol(path, _stem(path), "<module>", "module", 1, text.count("\n") + 1)
        return out
    i, package = 0, ""
    module_q = "<module>"
    if c.w(0) == "package":
        package = c.text(1, c.find(1, c.n, ";"))
        module_q = f"<package:{package}>"
        i = c.find(1, c.n, ";") + 1
    out.symbol(path, _stem(path), module_q, "module", 1, text.count("\n") + 1)
    mapping = re.compile(r"(?:Get|Post|Put|Delete|Patch|Request)Mapping|RestController|Controller|Test")

    def body_of(j, b, scope, rest):
        last = j
        while j < b:
            w = c.words[j]
            if w == "@" and c.w(j + 1) != "interface":
                j = c.dotted(j + 1)
                j = c.partner.get(j, j - 1) + 1 if c.w(j) == "(" else j
            elif w in ("class", "interface") and c.names[j + 1 : j + 2] == [True]:
                inner = type_(last, j, b, scope)
                rest += [(inner[1] + 1, b, scope), inner]
                return
            elif w in ("enum", "record") and c.names[j + 1 : j + 2] == [True]:
                j = last = c.partner.get(c.find(j, b, "{"), b) + 1
            elif c.names[j] and c.w(j + 1) == "(" and w not in _NO_CALL and scope:
                close = c.partner.get(j + 1, b)
                k = c.find(close + 1, b, "{", ";", "=")
                if c.w(k) == "=":
                    j = last = c.find(k, b, ";") + 1
                    continue
                end = c.partner.get(k, k)
                head = c.words[last:j]
                ps = [p for p in c.parameters(j + 1, close)]
                marks = c.text(last, j)
                out.symbol(path, w, f"{scope}.{w}", "method", c.lines[last], c.lines[min(end, c.n - 1)], None, [p[-1] for p in ps], None, "public" in head, bool(mapping.search(marks)) and "@" in marks or w == "main", c.branches(k, end + 1, _BRANCH["java"]))
                _calls(c, out, k, end + 1, f"{path}::{scope}.{w}")
                j = last = end + 1
            elif w in (";", "}"):
                j += 1
                last = j
            elif w == "=":
                j = last = c.find(j, b, ";") + 1
            else:
                j = c.partner.get(j, j) + 1
                if w == "{":
                    last = j

    def type_(first, j, b, scope):
        kind_, name = c.words[j], c.words[j + 1]
        q = f"{scope}.{name}" if scope else name
        body = c.find(j, b, "{")
        end, marks = c.partner.get(body, b), c.text(first, j)
        out.symbol(path, name, q, kind_, c.lines[first], c.lines[min(end, c.n - 1)], exported="public" in c.words[first:j], entry=bool(mapping.search(marks)) and "@" in marks or "Test" in name)
        impl = c.find(j + 2, body, "implements")
        ext_at = c.find(j + 2, impl, "extends")
        for p in _types(c, ext_at + 1, impl):
            out.inherits(f"{path}::{q}", p, "EXTENDS")
        for p in _types(c, impl + 1, body):
            out.inherits(f"{path}::{q}", p, "IMPLEMENTS")
        return body + 1, end, q

    while c.w(i) == "import":
        end = c.find(i, c.n, ";")
        names = [w for w in c.words[i + 1 : end] if w not in ("static", ".")]
        star = bool(names) and names[-1] == "*"
        names = names[:-1] if star else names
        if names:
            out.imported(".".join(names[:-1]), names[-1], None, c.lines[i])
        i = end + 1
    bodies = [(i, c.n, "")]  # a list, since types may be nested deeper than calls
    while bodies:
        body_of(*bodies.pop(), bodies)
    return out


def parse_go(path: str, text: str) -> Parsed:
    out = Parsed()
    package = re.search(r"^\s*package\s+(\w+)", text, re.M)
    out.symbol(path, _stem(path), f"<package:{package[1]}>" if package else "<module>", "module", 1, text.count("\n") + 1)
    try:
        c = _Code(text, "go")
    except lx.LexError:
        return out
    i = 0
    while i < c.n:
        w = c.words[i]
        if w == "import":
            group = c.w(i + 1) == "("
            a, b = (i + 2, c.partner.get(i + 1, c.n)) if group else (i + 1, min(i + 3, c.n))
            for j in range(a, b):
                if c.words[j][0] in '"`':
                    src = c.words[j].strip('"`')
                    alias = c.words[j - 1] if j > a and c.lines[j - 1] == c.lines[j] and (c.names[j - 1] or c.words[j - 1] == ".") and c.words[j - 1] != "import" else None
                    out.imported(src, alias or src.rpartition("/")[2], alias, c.lines[j])
                    if not group:
                        break
            i = b if group else i + 2
        elif w == "type":
            group = c.w(i + 1) == "("
            a, b = (i + 2, c.partner.get(i + 1, c.n)) if group else (i + 1, c.n)
            j = a
            while j < b:
                if c.names[j]:
                    body = c.find(j + 1, b, "{")
                    same = body < b and c.lines[body] == c.lines[j]
                    end = c.partner.get(body, j) if same else j
                    k = "interface" if "interface" in c.words[j + 1 : j + 3] else "class"
                    out.symbol(path, c.words[j], c.words[j], k, c.lines[j], c.lines[end], exported=c.words[j][0].isupper())
                    line = c.lines[end]
                    j = end + 1
                    while j < b and c.lines[j] == line:
                        j += 1
                else:
                    j += 1
                if not group:
                    break
            i = max(j, i + 1)
        elif w == "func":
            j, scope = i + 1, ""
            if c.w(j) == "(":
                close = c.partner.get(j, j)
                own = [x for x in c.words[j + 1 : close] if x[0].isalpha() or x[0] == "_"]
                generic = c.find(j + 1, close, "[")
                inner = [x for x in c.words[j + 1 : generic] if x[0].isalpha() or x[0] == "_"]
                scope = (inner or own or [""])[-1]
                j = close + 1
            name = c.w(j)
            open_ = c.find(j, c.n, "(")
            close = c.partner.get(open_, open_)
            body = close + 1
            while body < c.n and c.words[body] != "{" and c.words[body] not in ("func", "type", "var", "const"):
                body = c.partner.get(body, body) + 1
            if c.w(body - 1) in ("interface", "struct"):
                body = c.find(c.partner.get(body, body) + 1, c.n, "{")
            end = c.partner.get(body, min(body, c.n - 1))
            q = f"{scope}.{name}" if scope else name
            ps = [p for p in c.parameters(open_, close) if len(p) > 1]
            types = {p[0]: "".join(p[1:]).lstrip("*") for p in ps}
            out.symbol(path, name, q, "method" if scope else "function", c.lines[i], c.lines[min(end, c.n - 1)], None, [p[0] for p in ps], types, name[:1].isupper(), name in ("main", "init") or name.startswith("Test"), c.branches(body, end + 1, _BRANCH["go"]))
            _calls(c, out, body, end + 1, f"{path}::{q}")
            i = end + 1
        else:
            i = c.partner.get(i, i) + 1
    return out


def parse_rust(path: str, text: str) -> Parsed:
    out = Parsed()
    out.symbol(path, _stem(path), "<module>", "module", 1, text.count("\n") + 1)
    try:
        c = _Code(text, "rs")
    except lx.LexError:
        return out

    def function(at, i, b, scope):
        name = c.w(i + 1)
        open_ = c.find(i, b, "(")
        close = c.partner.get(open_, open_)
        body = c.find(close + 1, b, "{", ";")
        end = c.partner.get(body, body)
        q = f"{scope}.{name}" if scope else name
        ps = [p for p in c.parameters(open_, close) if "self" not in p[:4]]
        named = [(([x for x in p[: p.index(":")] if x != "mut"] or ["mut"])[-1], "".join(p[p.index(":") + 1 :]).lstrip("&")) for p in ps if ":" in p and p.index(":")]
        out.symbol(path, name, q, "method" if scope else "function", c.lines[i], c.lines[min(end, c.n - 1)], None, [n for n, _ in named], dict(named), "pub" in c.words[max(at, 0) : i], name == "main" or name.startswith("test_"), c.branches(body, end + 1, _BRANCH["rust"]))
        _calls(c, out, body, end + 1, f"{path}::{q}")
        return end + 1

    i = last = 0
    while i < c.n:
        w = c.words[i]
        if w == "use":
            end = c.find(i, c.n, ";")
            parts = re.split("::", c.text(i + 1, end)) if "{" not in c.words[i + 1 : end] else re.split("::", " ".join(c.words[i + 1 : end]).replace(" :: ", "::").replace(" ,", ","))
            name = parts[-1]
            alias = c.w(end - 1) if c.w(end - 2) == "as" else None
            if alias:
                parts = re.split("::", c.text(i + 1, end - 2))
                name = parts[-1]
            out.imported("::".join(parts[:-1]), name, alias, c.lines[i], name == "*")
            i = last = end + 1
        elif w in ("struct", "enum", "trait") and c.names[i + 1 : i + 2] == [True]:
            end = c.find(i, c.n, "{", ";")
            end = c.partner.get(end, end)
            out.symbol(path, c.w(i + 1), c.w(i + 1), "interface" if w == "trait" else "class", c.lines[i], c.lines[min(end, c.n - 1)], exported="pub" in c.words[last:i])
            i = last = end + 1
        elif w == "impl":
            body = c.find(i, c.n, "{")
            end = c.partner.get(body, c.n - 1)
            at = c.find(i + 1, body, "where")
            split = c.find(i + 1, at, "for")
            first = i + 1
            if c.w(first) == "<":
                level = 0
                while first < at:
                    level += (c.words[first] == "<") - (c.words[first] == ">")
                    first += 1
                    if not level:
                        break
            owner = (_types(c, split + 1 if split < at else first, at) or [""])[0].rpartition("::")[2]
            if split < at and owner:
                out.inherits(f"{path}::{owner}", (_types(c, first, split) or [""])[0].rpartition("::")[2], "IMPLEMENTS")
            j = mark = body + 1
            while j < end:
                if c.words[j] == "fn":
                    j = mark = function(mark, j, end, owner)
                else:
                    j = c.partner.get(j, j) + 1
            i = last = end + 1
        elif w == "fn":
            i = last = function(last, i, c.n, "")
        elif w in (";", "}"):
            i += 1
            last = i
        else:
            i = c.partner.get(i, i) + 1
            if w == "{":
                last = i
    return out


PARSERS: dict[str, Callable[[str, str], Parsed]] = {"python": parse_python, "javascript": parse_script, "typescript": parse_script, "java": parse_java, "go": parse_go, "rust": parse_rust}


def parse(path: str, text: str) -> Parsed | None:
    """What a file holds, or None where no parser knows its extension."""
    parser = PARSERS.get(lx.LANGUAGE_OF.get(lx.extension(path), ""))
    return parser(path, text) if parser else None
