"""Packrat parsing-expression grammars over token kinds.

A grammar is text, one rule a line:

    name <- expression        a memoised rule
    name = expression         written out where it is used
    name := expression        a memoised rule that leaves a node (name, first token, token after the last)
    name ~ expression         a memoised rule for statements, also remembered across texts where it ends at its first
                              terminator, holds no node and the token after it cannot continue any statement (as else
                              does): equal kinds up to there parse alike

Expressions have the usual operators: sequence, / for ordered choice, ? * +, & and ! for look-ahead, brackets, 'text'
for a token, UPPER for a class of tokens, ^ for "this token begins a line". Rules become Python functions that return
the position after a match or -1. Whatever holds no memoised rule becomes one regular expression over the kinds, with
possessive repeats and atomic groups, which have the same meaning. The set of tokens an expression can begin with
decides which alternatives of a choice are tried at all. A second build without these shortcuts records the furthest
position at which a token was wanted, and which tokens were, for texts that do not parse.
"""

from __future__ import annotations

import re

from ..functions.lexing import EOF, TEXT, kind

_TOKEN = re.compile(r"\s*(?:'((?:[^'\\]|\\.)+)'|([A-Z][A-Z_]*)|([a-z_][a-z_0-9]*)|([()?*+&!/^.]))")
#: Statements remembered across texts: few enough to stay in the processor's cache.
KEPT = 20_000
_EVERY = None  # stands for the set of all kinds


def _pair(c: str) -> frozenset[str]:
    return frozenset((c, chr(ord(c) + 1)))


def _either(*sets: frozenset[str] | None) -> frozenset[str] | None:
    return _EVERY if any(s is _EVERY for s in sets) else frozenset().union(*sets)


class Grammar:
    def __init__(self, text: str, classes: dict[str, list[str]] | None = None, start: str = "file", terminator: str = ";"):
        self.classes = {k: frozenset().union(*(_pair(kind(x)) for x in v)) for k, v in (classes or {}).items()}
        self.rules, self.how = {}, {}
        self.terminator = kind(terminator)
        text = re.sub(r"\n[ \t]+", " ", re.sub(r"^\s*--.*\n", "", text, flags=re.M))
        for line in filter(str.strip, text.split("\n")):
            name, how, body = re.match(r"\s*(\w+)\s*(<-|:=|=|~)\s*(.*)", line).groups()
            items = [m for m in _TOKEN.finditer(body)]
            if "".join(m[0] for m in items).strip() != body.strip():
                raise ValueError(f"bad rule: {line}")
            self.items, self.at = items, 0
            self.rules[name] = self._choice()
            if self.at != len(items):
                raise ValueError(f"bad rule: {line}")
            self.how[name] = how
        self.start = start
        self.numbers = {n: i for i, n in enumerate(self.rules)}
        self._analyse()
        self.cache: dict = {}
        self._fast = self._build(False)
        self._slow = None

    # --- reading
    def _peek(self):
        return self.items[self.at][0].strip() if self.at < len(self.items) else None

    def _choice(self):
        alts = [self._sequence()]
        while self._peek() == "/":
            self.at += 1
            alts.append(self._sequence())
        return alts[0] if len(alts) == 1 else ("alt", alts)

    def _sequence(self):
        parts = []
        while self._peek() not in (None, "/", ")"):
            parts.append(self._prefixed())
        return parts[0] if len(parts) == 1 else ("seq", parts)

    def _prefixed(self):
        c = self._peek()
        if c in ("&", "!"):
            self.at += 1
            return ("and" if c == "&" else "not", self._prefixed())
        m = self.items[self.at]
        self.at += 1
        if m[1]:
            x = ("lit", _pair(kind(m[1].replace("\\'", "'"))))
        elif m[2]:
            x = ("lit", self.classes[m[2]] if m[2] in self.classes else _pair(kind(m[2])))
        elif m[3]:
            x = ("ref", m[3])
        elif m[4] == "(":
            x = self._choice()
            if self._peek() != ")":
                raise ValueError("bracket left open")
            self.at += 1
        elif m[4] == "^":
            x = ("line",)
        elif m[4] == ".":
            x = ("lit", None)
        else:
            raise ValueError(m[0])
        while self._peek() in ("?", "*", "+"):
            x = ({"?": "opt", "*": "star", "+": "plus"}[self._peek()], x)
            self.at += 1
        return x

    # --- what an expression can begin with, whether it can be empty, whether it is regular
    def _analyse(self):
        refs = {n: set() for n in self.rules}

        def walk(x, out):
            if x[0] == "ref":
                out.add(x[1])
            for y in x[1:]:
                if isinstance(y, tuple):
                    walk(y, out)
                elif isinstance(y, list):
                    for z in y:
                        walk(z, out)

        for n, x in self.rules.items():
            walk(x, refs[n])
        missing = set().union(*refs.values()) - set(self.rules)
        if missing:
            raise ValueError(f"no rule {missing}")
        self.regular = {n for n in self.rules if self.how[n] == "="}
        changed = True
        while changed:
            changed = False
            for n in list(self.regular):
                if not refs[n] <= self.regular:
                    self.regular.discard(n)
                    changed = True
        self.empty, self.first = dict.fromkeys(self.rules, False), {n: frozenset() for n in self.rules}
        changed = True
        while changed:
            changed = False
            for n, x in self.rules.items():
                e, f = self._can_be_empty(x), self._first(x)
                if e != self.empty[n] or f != self.first[n]:
                    self.empty[n], self.first[n] = e, f
                    changed = True

    def _can_be_empty(self, x) -> bool:
        k = x[0]
        if k == "ref":
            return self.empty[x[1]]
        if k == "seq":
            return all(map(self._can_be_empty, x[1]))
        if k == "alt":
            return any(map(self._can_be_empty, x[1]))
        return k in ("opt", "star", "and", "not", "line") or (k == "plus" and self._can_be_empty(x[1]))

    def _first(self, x):
        k = x[0]
        if k == "lit":
            return x[1]
        if k == "ref":
            return self.first[x[1]]
        if k in ("opt", "star", "plus"):
            return self._first(x[1])
        if k in ("and", "not", "line"):
            return frozenset()
        sets, out = [], frozenset()
        for y in x[1]:
            sets.append(self._first(y))
            if k == "seq" and not self._can_be_empty(y):
                break
        for s in sets:
            if s is _EVERY or out is _EVERY:
                return _EVERY
            out |= s
        return out

    def _continues(self, name: str):
        """The tokens that a rule can go on with after its terminator, outside brackets opened before it; None for any."""
        ends, more = dict.fromkeys(self.rules, False), {n: frozenset() for n in self.rules}
        opening, closing = (frozenset().union(*(_pair(kind(c)) for c in cs if c in TEXT.values())) for cs in (("(", "[", "{", "INDENT"), (")", "]", "}", "DEDENT")))

        def walk(x) -> tuple[bool, frozenset | None]:
            """Whether x can end with a terminator, and what x can go on with after one."""
            k = x[0]
            if k == "lit":
                return x[1] is _EVERY or self.terminator in x[1], frozenset()
            if k == "ref":
                return ends[x[1]], more[x[1]]
            if k in ("and", "not", "line"):
                return False, frozenset()
            if k in ("opt", "star", "plus"):
                e, f = walk(x[1])
                return e, _either(f, self._first(x[1])) if e and k != "opt" else f
            if k == "alt":
                found = [walk(y) for y in x[1]]
                return any(e for e, _ in found), _either(*(f for _, f in found))
            open_, depth, out = False, 0, frozenset()  # open_: a terminator may stand right before the part
            for y in x[1]:
                if open_ and not depth:
                    out = _either(out, _EVERY if y[0] == "line" else self._first(y[1] if y[0] in ("and", "not") else y))
                e, f = walk(y)
                if not depth:
                    out = _either(out, f)
                open_ = e or open_ and self._can_be_empty(y)
                if y[0] == "lit" and y[1]:
                    depth += (y[1] <= opening) - (y[1] <= closing)
            return open_, out

        changed = True
        while changed:
            changed = False
            for n, x in self.rules.items():
                e, f = walk(x)
                if e != ends[n] or f != more[n]:
                    ends[n], more[n], changed = e, f, True
        return more[name]

    def _is_regular(self, x) -> bool:
        if x[0] == "ref":
            return x[1] in self.regular
        return all(self._is_regular(z) for y in x[1:] for z in ([y] if isinstance(y, tuple) else y if isinstance(y, list) else []))

    def _pattern(self, x) -> str:
        k = x[0]
        if k == "lit":
            return "(?s:.)" if x[1] is None else "(?!)" if not x[1] else "[" + "".join(re.escape(c) for c in sorted(x[1])) + "]"
        if k == "ref":
            return self._pattern(self.rules[x[1]])
        if k == "seq":
            return "".join(map(self._pattern, x[1]))
        if k == "alt":
            return "(?>" + "|".join(map(self._pattern, x[1])) + ")"
        if k in ("opt", "star", "plus"):
            return "(?:" + self._pattern(x[1]) + ")" + {"opt": "?+", "star": "*+", "plus": "++"}[k]
        if k == "line":
            return "(?=[" + "".join(chr(c) for c in range(0x101, 0x101 + 2 * len(TEXT) + 2, 2)) + "])"
        return ("(?=" if k == "and" else "(?!") + self._pattern(x[1]) + ")"

    # --- code
    def _build(self, slow: bool):
        self.lines: list[str] = []
        consts: dict[str, object] = {}
        number = iter(range(10**9))

        def const(v, prefix="K"):
            for k, w in consts.items():
                if type(v) is type(w) and v == w:
                    return k
            consts[name := f"{prefix}{next(number)}"] = v
            return name

        def starts(x) -> str | None:
            """A condition that must hold for x to match at p, or None."""
            if self._can_be_empty(x) or (f := self._first(x)) is _EVERY:
                return None
            return f"k[p] == {min(f)!r}" if len(f) == 1 else f"k[p] in {const(frozenset(f))}"

        def out(d, s):
            self.lines.append(" " * d + s)

        def emit(x, d, certain=False):
            """Code that moves p past x or sets it to -1. certain: x's first token is known to fit."""
            k = x[0]
            if k == "ref" and self.how[x[1]] == "=" and not (self._is_regular(x) and not slow):
                return emit(self.rules[x[1]], d, certain)
            if k == "lit" and not slow:
                if x[1] is None:
                    return out(d, f"p = p + 1 if k[p] not in {const(_pair(EOF))} else -1")
                return out(d, "p += 1" if certain else f"p = p + 1 if k[p] in {const(x[1])} else -1")
            if k == "lit":
                return out(d, f"p = want(p, {const(x[1])})")
            if not slow and k != "ref" and self._is_regular(x) or not slow and k == "ref" and x[1] in self.regular:
                r = const(re.compile(self._pattern(x)).match, "R")
                out(d, f"z = {r}(k, p)")
                return out(d, "p = z.end() if z else -1")
            if k == "ref":
                return out(d, f"p = r_{x[1]}(p)")
            if k == "line":
                return out(d, "p = p if ord(k[p]) & 1 else -1")
            if k == "seq":
                # runs of regular parts become one pattern
                parts, i = [], 0
                while i < len(x[1]):
                    j = i
                    while not slow and j < len(x[1]) and self._is_regular(x[1][j]):
                        j += 1
                    if j - i > 1:
                        parts.append(("seq", x[1][i:j]))
                        i = j
                    else:
                        parts.append(x[1][i])
                        i += 1
                for i, y in enumerate(parts):
                    if i:
                        out(d, "if p >= 0:")
                        d += 1
                    emit(y, d, certain and not i)
                return None
            s = f"s{next(number)}"
            # nodes that began at or after s belong to what has just failed
            drop = f"while T and T[-1][1] >= {s}: T.pop()"
            if k == "alt":
                out(d, f"{s} = p; p = -1")
                for i, y in enumerate(x[1]):
                    out(d, "if p < 0:" if i else "if True:")
                    out(d + 1, f"p = {s}")
                    c = None if slow else starts(y)
                    if c:
                        out(d + 1, f"if {c}:")
                        emit(y, d + 2, True)
                        if not self._is_regular(y):
                            out(d + 2, "if p < 0:")
                            out(d + 3, drop)
                        out(d + 1, "else: p = -1")
                    else:
                        emit(y, d + 1)
                        if not self._is_regular(y):
                            out(d + 1, "if p < 0:")
                            out(d + 2, drop)
            elif k in ("opt", "star", "plus"):
                if k == "plus":
                    emit(x[1], d)
                    out(d, "if p >= 0:")
                    d += 1
                c = None if slow else starts(x[1])
                out(d, f"{'if' if k == 'opt' else 'while'} {c or 'True'}:")
                out(d + 1, f"{s} = p")
                emit(x[1], d + 1, bool(c))
                out(d + 1, f"if p < 0{'' if k == 'opt' else f' or p == {s}'}:")
                out(d + 2, f"p = {s}")
                if not self._is_regular(x[1]):
                    out(d + 2, drop)
                if k != "opt":
                    out(d + 2, "break")
            else:
                out(d, f"{s} = p" + ("; hush[0] += 1" if slow and k == "not" else ""))
                emit(x[1], d)
                if slow and k == "not":
                    out(d, "hush[0] -= 1")
                if not self._is_regular(x[1]):
                    out(d, drop)
                out(d, f"p = {s} if p {'>=' if k == 'and' else '<'} 0 else -1")
            return None

        if slow:
            out(0, "def want(p, s):")
            out(1, "if s is None and p < len(k) - 1 or s is not None and k[p] in s: return p + 1")
            out(1, "if not hush[0] and p >= far[0]:")
            out(2, "if p > far[0]: far[0] = p; far[1] = set()")
            out(2, "far[1] |= s or set()")
            out(1, "return -1")
        named = [n for n in self.rules if self.how[n] != "="]
        for n in named:
            x, how = self.rules[n], self.how[n]
            after = self._continues(n) if how == "~" and not slow else _EVERY
            out(0, f"M_{n} = {{}}")
            out(0, f"def r_{n}(p):")
            out(1, f"e = M_{n}.get(p)")
            out(1, "if e is not None:")
            out(2, "if e.__class__ is int: return e")
            out(2, "T.extend(e[1]); return e[0]")
            out(1, "s0 = p; m0 = len(T)")
            if after is not _EVERY:
                out(1, f"t = k.find({self.terminator!r}, p, p + 64) + 1")
                out(1, "g = k[p:t] if t else ''")
                out(1, f"if g and g in C and k[t] not in {const(after)}: return t")
            emit(x, 1)
            out(1, "if p < 0:")
            out(2, "if len(T) > m0: del T[m0:]")
            out(2, f"M_{n}[s0] = -1")
            out(2, "return -1")
            if how == ":=":
                out(1, f"T.append(({n!r}, s0, p))")
            out(1, f"M_{n}[s0] = p if len(T) == m0 else (p, tuple(T[m0:]))")
            if after is not _EVERY:
                out(1, f"if g and p == t and k[t] not in {const(after)} and len(T) == m0 and len(C) < KEPT: C.add(g)")
            out(1, "return p")
        # one text at a time: what a parse works on is global to the grammar's own scope
        out(0, "def parse(kinds, nodes, furthest, hushed):")
        out(1, "global k, T, far, hush")
        out(1, "k, T, far, hush = kinds, nodes, furthest, hushed")
        out(1, "try:")
        out(2, f"return r_{self.start}(0)")
        out(1, "finally:")
        out(2, "; ".join(f"M_{n}.clear()" for n in named))
        scope = {**consts, "KEPT": KEPT, "C": set(), "k": "", "T": [], "far": None, "hush": None}
        exec(compile("\n".join(self.lines), "<grammar>", "exec"), scope)
        return scope["parse"]

    # --- use
    def parse(self, kinds: str) -> list[tuple[str, int, int]] | None:
        """The nodes of a text whose tokens all belong to one match, children first; None if there is none."""
        nodes: list = []
        return nodes if self._fast(kinds, nodes, None, None) == len(kinds) else None

    def furthest(self, kinds: str) -> tuple[int, list[str]]:
        """The furthest token that stopped the match, and the tokens wanted there."""
        self._slow = self._slow or self._build(True)
        far: list = [0, set()]
        self._slow(kinds, [], far, [0])
        return min(far[0], len(kinds) - 1), sorted({TEXT[chr(ord(c) & ~1)] for c in far[1]})
