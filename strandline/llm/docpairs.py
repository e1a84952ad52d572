"""Functions paired with their documentation.

A text is parsed by its language's grammar; the nodes of functions, methods and classes give names and source ranges;
documentation is what stands right above a function (a /** */ block, ///, the comment touching a Go func) or opens its
body (Python). Descriptions that are empty, short, placeholders or a repetition of the name are dropped.

Defined results: null and empty texts, unknown extensions and files that do not parse give no functions; repeated rows
give each pair once; a name defined twice in a file counts if one of its definitions is documented; very long texts are
parsed whole; columns beyond those named are ignored.
"""

from __future__ import annotations

import ast
import re
import textwrap

from ..functions.lexing import CHAR, NAME, NEWLINE, STRING, Tokens, kind

CLASSES = {"classdef", "class", "defaultclass", "interface", "enum", "record", "annotype", "trait", "impl"}
NAMELESS = {"arrow", "funcexpr", "classexpr"}
FUNCTIONS = {"function", "method", "defaultfunc", "fdecl", "field"}


def functions(tokens: Tokens, nodes: list[tuple[str, int, int]], language: str):
    """(qualified name, kind, first token, name's token, token after the last) of each function and method."""
    stack: list[list] = []  # [end, name, is a class, node]
    named = {}
    spans = sorted((a, -b, -i) for i, (n, a, b) in enumerate(nodes) if n not in NAMELESS)
    starts = {(n, a) for n, a, _ in nodes}
    for a, b, i in spans:  # i is negative; the name of a node is the first name node in it that no smaller node holds
        i = -i
        kind_, b = nodes[i][0], -b
        while stack and stack[-1][0] <= a:
            stack.pop()
        if kind_ in ("name", "self_type", "receiver"):
            if stack:
                named.setdefault((stack[-1][1], kind_), (a, b))
        else:
            stack.append([b, i])
    stack = []
    for a, b, i in spans:
        i = -i
        kind_, b = nodes[i][0], -b
        if kind_ in ("name", "self_type", "receiver"):
            continue
        while stack and stack[-1][0] <= a:
            stack.pop()
        at = named.get((i, "self_type" if kind_ == "impl" else "name"))
        name = _type_name(tokens, *at) if kind_ == "impl" and at else tokens.text[tokens.starts[at[0]] : tokens.ends[at[1] - 1]].strip("'\"") if at else None
        is_class = kind_ in CLASSES
        if kind_ in ("fdecl", "field"):
            eq = _after_equals(tokens, at[1], b) if at else None
            holds = eq is not None and any((n, eq) in starts for n in ("arrow", "funcexpr"))
            is_class = eq is not None and ("classexpr", eq) in starts
            if not holds and not is_class:
                continue
        if name is None:
            continue
        scope = ".".join(s[1] for s in stack)
        if kind_ == "function" and (i, "receiver") in named:
            scope = _receiver(tokens, *named[(i, "receiver")])
        if kind_ in FUNCTIONS and not is_class:
            inside = bool(stack) or (kind_ == "function" and (i, "receiver") in named)
            yield (f"{scope}.{name}" if scope else name), ("method" if inside else "function"), a, at[0], b
        stack.append([b, name])


def _after_equals(tokens: Tokens, a: int, b: int) -> int | None:
    k = kind("=")
    for i in range(a, b):
        if chr(ord(tokens.kinds[i]) & ~1) == k:
            return i + 1
    return None


def _type_name(tokens: Tokens, a: int, b: int) -> str | None:
    """The last name of a type before its arguments."""
    name = None
    for i in range(a, b):
        if tokens.kinds[i] == kind("<"):
            break
        if tokens.kinds[i] in (NAME, kind("Self")):
            name = tokens.word(i)
    return name


def _receiver(tokens: Tokens, a: int, b: int) -> str:
    name = ""
    for i in range(a, b):
        if tokens.kinds[i] == kind("["):
            break
        if tokens.kinds[i] == NAME:
            name = tokens.word(i)
    return name


# --- documentation, as written


def _python_doc(t: Tokens, name: int, end: int) -> str | None:
    depth, i = 0, name
    while i < end:
        k = t.kinds[i]
        if k in (kind("("), kind("["), kind("{")):
            depth += 1
        elif k in (kind(")"), kind("]"), kind("}")):
            depth -= 1
        elif k == kind(":") and not depth:
            break
        i += 1
    i += 1
    if t.kinds[i] == NEWLINE:
        i += 2
    j = i
    while t.kinds[j] == STRING:
        j += 1
    if j == i or t.kinds[j] not in (NEWLINE, kind(";")):
        return None
    if j == i + 1:
        word = t.word(i)
        if word[0] in "\"'" and "\\" not in word:  # the usual case needs no evaluation
            n = 3 if word[:3] in ('"""', "'''") and len(word) > 5 else 1
            return word[n:-n].replace("\r\n", "\n")
    try:
        value = ast.literal_eval("(" + t.text[t.starts[i] : t.ends[j - 1]] + ")")
    except (SyntaxError, ValueError):
        return None
    return value if isinstance(value, str) else None


_COMMENT = re.compile(r"//[^\n]*|/\*.*?\*/", re.S)


def _block_doc(t: Tokens, first: int, name: int) -> str | None:
    """The last /** */ block that is the last comment before the function, or before one of its own modifiers."""
    for i in range(name, first - 1, -1):
        gap = t.text[t.ends[i - 1] if i else 0 : t.starts[i]]
        comments = _COMMENT.findall(gap) if "/*" in gap else []
        if comments and comments[-1].startswith("/**") and len(comments[-1]) > 4:
            return _inner(comments[-1])
        if "//" in gap or "/*" in gap:
            return None
    return None


def _inner(block: str) -> str:
    return re.sub(r"(?m)^[ \t]*\*(?!/) ?", "", block[3:-2])


def _go_doc(t: Tokens, first: int) -> str | None:
    gap = t.text[t.ends[first - 1] if first else 0 : t.starts[first]].replace("\r\n", "\n")
    lines, rest = [], gap.rstrip(" \t")
    if first and not rest.startswith("\n"):  # a comment behind the token before is not above the function
        rest = rest[rest.find("\n") :] if "\n" in rest else ""
    if rest.endswith("*/\n"):
        return rest[rest.rfind("/*") + 2 : -3]
    for line in reversed(rest.split("\n")[:-1]):
        line = line.strip()
        if not line.startswith("//"):
            break
        if not re.match(r"//([a-z0-9]+:[a-z0-9]|line |export |extern )", line):
            lines.append(line[2:])
    return "\n".join(reversed(lines)) if lines else None


_DOC_ATTR = re.compile(r"#\s*\[\s*doc\s*=\s*(r#*)?\"(.*)\"#*\s*\]", re.S)


def _rust_doc(t: Tokens, first: int) -> str | None:
    """/// and /** */ comments and doc attributes over the function, across its other attributes."""
    vis, i = {kind(x) for x in ("pub", "crate", "(", ")", "in", "self", "super", "default", "const", "async", "unsafe", "extern")} | {STRING, NAME, kind("::")}, first
    pieces: list[str] = []

    def gap(i):
        found = re.findall(r"///(?!/)[^\n]*|//[^\n]*|/\*\*(?![*/]).*?\*/|/\*.*?\*/", t.text[t.ends[i - 1] if i else 0 : t.starts[i]], re.S)
        return [x[3:] if x.startswith("///") and not x.startswith("////") else _inner(x) for x in found if (x.startswith("///") and not x.startswith("////")) or (x.startswith("/**") and not x.startswith("/***") and len(x) > 4)]

    while True:
        pieces = gap(i) + pieces
        if not i:
            break
        if t.kinds[i - 1] == kind("]"):
            depth, j = 0, i - 1
            while j >= 0:
                depth += (t.kinds[j] == kind("]")) - (t.kinds[j] == kind("["))
                if not depth:
                    break
                j -= 1
            if j < 1 or t.kinds[j - 1] != kind("#"):
                break
            m = _DOC_ATTR.fullmatch(t.text[t.starts[j - 1] : t.ends[i - 1]])
            if m:
                pieces.insert(0, m[2] if m[1] else re.sub(r"\\\n\s*", "", m[2]).replace('\\"', '"').replace("\\n", "\n"))
            i = j - 1
        elif t.kinds[i - 1] in (kind("pub"), kind("crate")) or (t.kinds[i - 1] == kind(")") and _visibility(t, i)):
            i = i - 1 if t.kinds[i - 1] != kind(")") else _visibility(t, i)
        else:
            break
    return "\n".join(pieces) if pieces else None


def _visibility(t: Tokens, i: int) -> int:
    """The token of pub for a pub(...) that ends before token i, or 0."""
    j = i - 1
    while j > 0 and t.kinds[j] != kind("("):
        j -= 1
    return j - 1 if j > 0 and t.kinds[j - 1] == kind("pub") else 0


def documentation(t: Tokens, language: str, first: int, name: int, end: int) -> str | None:
    if language == "python":
        return _python_doc(t, name, end)
    if language == "go":
        return _go_doc(t, first)
    if language == "rust":
        return _rust_doc(t, first)
    if language in ("javascript", "typescript"):
        before = {kind(x) for x in ("const", "let", "var", "export", "default", "declare")}
        while first and chr(ord(t.kinds[first - 1]) & ~1) in before:
            first -= 1
    return _block_doc(t, first, name)


# --- fixed values: what a description is measured against
SECTIONS = "args arguments parameters params returns return raises yields yield attributes examples example note notes warning warnings throws keyword keywords other see references todo errors panics safety".split()
FILLER = (
    "a an the this that these those it its is are be was does do did will can which who of to for from in into on at by with and or as method function func fn procedure routine constructor helper "
    "class object instance given some simply just here used use uses implementation implements main"
).split()
PLACEHOLDER = re.compile(
    r"^\W*(?:(?:todo|fixme|xxx|tbd|tba|wip|hack)\b.*|n/?a|none|empty|"
    r"(?:(?:add|write|insert|provide|fill in|put|needs?|missing)\b[^.!?]{0,12})?\b(?:some |more |the |a |your |proper |better )*(?:docs?|documentation|description|docstring|comment|summary)\b(?: (?:text|string|comment))?"
    r"(?: (?:goes|go|comes|here|missing|pending|needed|required|available|is|to be|be|will|added|written|follows|coming|soon|later|yet|for|this|function|method|on|in|it|done|provided|not|still|tbd|todo))*|"
    r"no (?:docs?|documentation|description|docstring|comment|summary)s?\b(?: (?:is|are|was|available|given|provided|yet|here|so far|for|this|function|method|exists|written))*|"
    r"(?:to be|not yet|will be|yet to be) (?:written|documented|described|done|added|filled in|completed)(?: \w+){0,3}|document (?:me|this)\b.*|lorem ipsum\b.*)\W*$",
    re.I | re.S,
)
_SPLIT = re.compile(r"(?<=[.!?])\s+")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")


def description(doc: str) -> str:
    """doc without tags, parameter sections and markers."""
    if "\n" not in doc and "\t" not in doc:
        bare = doc.strip()
        if bare[:1] not in "@\\:#" and ":" not in bare[:24] and bare[-1:] != ":" and " " in bare:
            return re.sub(r"^[-*+>#\s]+", "", bare)
    doc = doc.replace("\r\n", "\n").expandtabs()
    head, _, tail = doc.partition("\n")
    lines = [head.strip(), *textwrap.dedent(tail).split("\n")]
    kept: list[str] = []
    skipping: int | None = None
    tag = False
    for i, line in enumerate(lines):
        bare = line.strip()
        indent = len(line) - len(line.lstrip())
        if re.match(r"[@\\][A-Za-z]", bare):
            tag = True
            continue
        if tag and bare:
            continue
        m = re.match(r"(?:#+\s*)?([A-Za-z ]+?)\s*(:?)\s*$", bare)
        word = m[1].lower().split()[0] if m and m[1].strip() else ""
        under = i + 1 < len(lines) and re.fullmatch(r"\s*[-=~]{3,}\s*", lines[i + 1])
        if m and word in SECTIONS and len(m[1].split()) <= 2 and (m[2] or bare.startswith("#") or under):
            skipping, tag = (-1 if bare.startswith("#") or under else indent), False
            continue
        one = re.match(r"(Args|Arguments|Parameters|Params|Returns?|Raises|Yields?|Throws)\s*:\s*\S", bare)
        if one:
            skipping = indent
            continue
        if re.match(r":[a-z]+(?: [^:]*)?:", bare):
            skipping = indent
            continue
        if skipping is not None:
            if not bare or skipping == -1 or indent > skipping:
                continue
            skipping = None
        kept.append(re.sub(r"^[-*+>#\s]+", "", bare))
    return " ".join(x for x in kept if x).strip()


def _stems(word: str) -> set[str]:
    w = word.lower()
    out = {w}
    for end, put in (("ies", "y"), ("ied", "y"), ("es", ""), ("es", "e"), ("s", ""), ("ed", ""), ("ed", "e"), ("ing", ""), ("ing", "e"), ("er", ""), ("er", "e"), ("ation", "ate"), ("ion", "")):
        if w.endswith(end) and len(w) - len(end) >= 2:
            base = w[: -len(end)] + put
            out.add(base)
            if len(base) > 3 and base[-1] == base[-2] and not put:
                out.add(base[:-1])
    return out


def is_trivial(doc: str | None, name: str) -> bool:
    """Whether a function's documentation says nothing: see the module's first lines."""
    return not doc or says_nothing(description(doc), name)


def says_nothing(text: str, name: str) -> bool:
    """Whether a description is too short, a placeholder or a repetition of the name."""
    if len(text) < 7:
        return True
    sentences = [s for s in _SPLIT.split(text) if s and not PLACEHOLDER.match(s)]
    words = [w for s in sentences for w in _WORD.findall(s)]
    if len(words) < 4:
        return True
    own = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_a-zA-Z]+", name.rpartition(".")[2])
    known = set().union(*map(_stems, own)) if own else set()
    whole = name.rpartition(".")[2].lower()
    return all(w.lower() in FILLER or w.lower() == whole or _stems(w) & known for w in words)
