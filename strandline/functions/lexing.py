"""Tokens of one source text, as a string with one character a token and the offsets of the tokens.

A token's character is its kind: one for all names, numbers and strings, and one for each keyword or operator. Odd code
points mark tokens that begin a new line (JavaScript and TypeScript, where that matters). Every text ends in EOF.
A text that cannot be split into tokens raises LexError with the offset.
"""

from __future__ import annotations

import re

KINDS: dict[str, str] = {}
TEXT: dict[str, str] = {}


def kind(name: str) -> str:
    """The character of a token kind: an upper-case class such as NAME, or the token's own text."""
    if name not in KINDS:
        KINDS[name] = chr(0x100 + 2 * len(KINDS))
        TEXT[KINDS[name]] = name
    return KINDS[name]


EOF, NAME, NUMBER, STRING, NEWLINE, INDENT, DEDENT = map(kind, ("EOF", "NAME", "NUMBER", "STRING", "NEWLINE", "INDENT", "DEDENT"))
CHAR, LIFETIME, REGEX, TEMPLATE, HEAD, MIDDLE, TAIL = map(kind, ("CHAR", "LIFETIME", "REGEX", "TEMPLATE", "HEAD", "MIDDLE", "TAIL"))
FSTART, FEND, FOPEN, FCLOSE, FSPEC, FCONV = map(kind, ("FSTART", "FEND", "FOPEN", "FCLOSE", "FSPEC", "FCONV"))
JOPEN, JEND, JCLOSE, JSELF, JTEXT, JNAME, PRIVATE = map(kind, ("JOPEN", "JEND", "JCLOSE", "JSELF", "JTEXT", "JNAME", "PRIVATE"))
BYTES = kind("BYTES")


class LexError(Exception):
    def __init__(self, at: int, cause: str):
        super().__init__(cause)
        self.at, self.cause = at, cause


class Tokens:
    """kinds[i] is the kind of the token at text[starts[i]:ends[i]]. The offsets may be given as a function that makes them."""

    __slots__ = ("text", "kinds", "_at")

    def __init__(self, text, kinds, at):
        self.text, self.kinds, self._at = text, kinds, at

    def _offsets(self):
        if callable(self._at):
            self._at = self._at()
        return self._at

    @property
    def starts(self) -> list[int]:
        return self._offsets()[0]

    @property
    def ends(self) -> list[int]:
        return self._offsets()[1]

    def word(self, i: int) -> str:
        return self.text[self.starts[i] : self.ends[i]]


# --- Fixed values: the keywords and operators of the languages.
PYTHON_WORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type _".split()
PYTHON_OPS = "**= //= >>= <<= ... -> := += -= *= /= %= &= |= ^= @= == != <= >= << >> ** // + - * / % @ & | ^ ~ < > ( ) [ ] { } , : . ; =".split()
SCRIPT_WORDS = (
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with "
    "async await yield let static get set of from as type interface namespace module declare abstract readonly public private protected implements is keyof infer unique asserts satisfies override accessor global require constructor target meta any out"
).split()
SCRIPT_OPS = ">>>= ... === !== **= <<= >>= &&= ||= ??= => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= << ** + - * / % & | ^ ! ~ < > ( ) [ ] { } , : . ; = ? @ #".split()
JAVA_WORDS = (
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null "
    "var yield record sealed permits non module open opens exports requires uses provides to with transitive when _"
).split()
JAVA_OPS = ">>>= ... <<= >>= -> :: ++ -- && || == != <= >= += -= *= /= &= |= ^= %= << + - * / % & | ^ ! ~ < > ( ) [ ] { } , : . ; = ? @".split()
GO_WORDS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
GO_OPS = "<<= >>= &^= ... && || <- ++ -- == != <= >= := += -= *= /= %= &= |= ^= << >> &^ + - * / % & | ^ ! ~ < > ( ) [ ] { } , : . ; =".split()
RUST_WORDS = "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while union macro_rules auto default raw _".split()
RUST_OPS = "<<= >>= ... ..= .. :: -> => && || == != <= >= += -= *= /= %= &= |= ^= << + - * / % & | ^ ! ~ < > ( ) [ ] { } , : . ; = ? @ # $".split()


def _table(words: list[str], ops: list[str]) -> dict[str, str]:
    return {w: kind(w) for w in [*words, *ops]}


def _ops(ops: list[str]) -> str:
    return "|".join(re.escape(o) for o in sorted(ops, key=len, reverse=True))


WORD = r"[^\W\d]\w*"
PYTHON, SCRIPT, JAVA, GO, RUST = (_table(w, o) for w, o in ((PYTHON_WORDS, PYTHON_OPS), (SCRIPT_WORDS, SCRIPT_OPS), (JAVA_WORDS, JAVA_OPS), (GO_WORDS, GO_OPS), (RUST_WORDS, RUST_OPS)))

_PY_NUMBER = r"0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*|\d(?:_?\d)*)(?:[eE][-+]?\d(?:_?\d)*)?[jJ]?"
_PY = re.compile(
    rf"[ \t\f]*+(?:(?P<s>(?:[rRbBuU]|[bB][rR]|[rR][bB])?(?:'''|\"\"\"|'|\"))|(?P<f>(?:[fF]|[fF][rR]|[rR][fF])(?:'''|\"\"\"|'|\"))|(?P<w>{WORD})|(?P<n>{_PY_NUMBER})|(?P<o>{_ops(PYTHON_OPS)}|!=)|(?P<c>#[^\r\n]*)|(?P<l>\r\n|\n|\r)|(?P<j>\\(?:\r\n|\n|\r)))"
)
_PY_END = {q: re.compile(r"(?:[^\\" + q[0] + (r"\r\n]" if len(q) == 1 else "]") + r"|\\(?:\r\n|.)" + ("" if len(q) == 1 else f"|{q[0]}(?!{q[0] * 2})") + f")*+{q}", re.S) for q in ("'", '"', "'''", '"""')}
_PY_INDENT = re.compile(r"(?:[ \t\f]*(?:#[^\r\n]*)?(?:\r\n|\n|\r))*+([ \t\f]*)")


def _lex_python_slow(text: str) -> Tokens:
    kinds, starts, ends = [], [], []
    pos, n, depth, indents = 1 if text[:1] == "\ufeff" else 0, len(text), 0, [(0, 0)]
    stack: list[str] = []
    match = _PY.match

    def put(k, a, b):
        kinds.append(k)
        starts.append(a)
        ends.append(b)

    def fstring(pos: int, opened: int, start: str) -> int:
        """Puts the tokens of an f-string; returns the offset after it."""
        quote = re.search(r"'''|\"\"\"|'|\"", start)[0]
        raw = "r" in start.lower()
        put(FSTART, opened, pos)
        pos = body(pos, quote, raw, False)
        put(FEND, pos, pos + len(quote))
        return pos + len(quote)

    def body(pos: int, quote: str, raw: bool, spec: bool) -> int:
        while True:
            if pos >= n:
                raise LexError(pos, "unterminated string")
            c = text[pos]
            if text.startswith(quote, pos):
                return pos
            if c == "\\" and not (raw and text[pos + 1 : pos + 2] in "{}"):
                if not raw and text.startswith("\\N{", pos):
                    end = text.find("}", pos)
                    if end < 0:
                        raise LexError(pos, "unterminated string")
                    pos = end + 1
                else:
                    pos += 1 if text[pos + 1 : pos + 2] in ("{", "}") else 2
            elif c in "\r\n" and len(quote) == 1:
                raise LexError(pos, "unterminated string")
            elif c == "{" and (spec or not text.startswith("{{", pos)):
                pos = field(pos, quote, raw)
            elif c == "{":
                pos += 2
            elif c == "}":
                if spec:
                    return pos
                if not text.startswith("}}", pos):
                    raise LexError(pos, "single } in f-string")
                pos += 2
            else:
                pos += 1

    def field(pos: int, quote: str, raw: bool) -> int:
        put(FOPEN, pos, pos + 1)
        pos, level = pos + 1, 0
        while True:
            while pos < n and text[pos] in " \t\f\r\n":
                pos += 1
            if not level and pos < n:
                c = text[pos]
                if c == "}":
                    break
                if c == "!" and text[pos + 1 : pos + 2] != "=":
                    m = re.compile(r"!\s*([rsa])\s*(?=[:}])").match(text, pos)
                    if not m:
                        raise LexError(pos, "bad conversion in f-string")
                    put(FCONV, pos, m.end())
                    pos = m.end()
                    continue
                if c == ":":
                    put(FSPEC, pos, pos + 1)
                    pos = body(pos + 1, quote, raw, True)
                    if text[pos : pos + 1] != "}":
                        raise LexError(pos, "unterminated field in f-string")
                    break
                if c == "=" and re.compile(r"=\s*(?:#[^\n]*\n\s*)*[!:}]").match(text, pos):
                    pos += 1
                    continue
            m = match(text, pos)
            if not m:
                raise LexError(pos, "unexpected character")
            g, a, pos = m.lastgroup, m.start(m.lastgroup), m.end()
            if g in "lcj":
                continue
            pos = token(m, g, a, pos)
            level += (kinds[-1] in (PYTHON["("], PYTHON["["], PYTHON["{"])) - (kinds[-1] in (PYTHON[")"], PYTHON["]"], PYTHON["}"]))
        put(FCLOSE, pos, pos + 1)
        return pos + 1

    def token(m, g, a, pos) -> int:
        if g == "w":
            put(PYTHON.get(m["w"], NAME), a, pos)
        elif g == "o":
            put(PYTHON[m["o"]], a, pos)
        elif g == "n":
            if pos < n and (text[pos].isalnum() or text[pos] == "_") and not re.compile(r"(?:and|else|for|if|in|is|not|or)\b").match(text, pos):
                raise LexError(pos, "bad number")
            if len(m["n"]) > 1 and re.fullmatch(r"0[0-9_]*[1-9][0-9_]*", m["n"]):
                raise LexError(a, "leading zeros in a number")
            put(NUMBER, a, pos)
        elif g == "s":
            quote = m["s"].lstrip("rRbBuU")
            e = _PY_END[quote].match(text, pos)
            if not e:
                raise LexError(a, "unterminated string")
            pos = e.end()
            put(BYTES if "b" in m["s"].lower() else STRING, a, pos)
        else:
            pos = fstring(pos, a, m["f"])
        return pos

    fresh = True
    while True:
        if fresh and not depth:
            m = _PY_INDENT.match(text, pos)
            pos = m.end()
            lead = m[1]
            if text.startswith("#", pos) or pos >= n:
                pos = n if pos >= n else text.find("\n", pos)
                if pos < 0 or pos >= n:
                    pos = n
                    break
                continue
            if not text.startswith("\\", pos):
                col = alt = 0
                for c in lead:
                    col, alt = ((col // 8 + 1) * 8, alt + 1) if c == "\t" else (0, 0) if c == "\f" else (col + 1, alt + 1)
                if col > indents[-1][0]:
                    if alt <= indents[-1][1]:
                        raise LexError(pos, "inconsistent tabs")
                    indents.append((col, alt))
                    put(INDENT, pos, pos)
                elif col < indents[-1][0]:
                    while col < indents[-1][0]:
                        indents.pop()
                        put(DEDENT, pos, pos)
                    if indents[-1] != (col, alt):
                        raise LexError(pos, "unindent matches no outer level")
                elif alt != indents[-1][1]:
                    raise LexError(pos, "inconsistent tabs")
            fresh = False
        m = match(text, pos)
        if not m:
            rest = text[pos:].lstrip(" \t\f")
            if not rest:
                break
            a = end = n - len(rest)
            while end < n and ("a" + text[end]).isidentifier():  # letters that the pattern's classes lack
                end += 1
            if end > a and kinds and kinds[-1] == NAME and ends[-1] == a:
                ends[-1] = end
            elif end > a and rest[0].isidentifier():
                put(NAME, a, end)
            else:
                raise LexError(a, "unexpected character")
            pos = end
            continue
        g = m.lastgroup
        a, pos = m.start(g), m.end()
        if g == "w":
            kinds.append(PYTHON.get(m["w"], NAME))
            starts.append(a)
            ends.append(pos)
        elif g == "o":
            o = m["o"]
            if o == "!=":
                put(kind("!="), a, pos)
                continue
            k = PYTHON[o]
            if o in "([{":
                depth += 1
                stack.append(o)
            elif o in ")]}":
                if not depth or stack.pop() != {")": "(", "]": "[", "}": "{"}[o]:
                    raise LexError(a, "bracket without its partner")
                depth -= 1
            put(k, a, pos)
        elif g == "l":
            if not depth:
                put(NEWLINE, a, pos)
                fresh = True
        elif g in "cj":
            pass
        else:
            pos = token(m, g, a, pos)
    if depth:
        raise LexError(n, "bracket left open")
    if kinds and kinds[-1] not in (NEWLINE, DEDENT) or kinds and not fresh and kinds[-1] == DEDENT:
        put(NEWLINE, n, n)
    for _ in indents[1:]:
        put(DEDENT, n, n)
    put(EOF, n, n)
    return Tokens(text, "".join(kinds), (starts, ends))


_PY_NEWLINE = r"(?:[ \t]*(?:#[^\r\n]*)?\r?\n)+[ \t]*+"
_PY_FAST = re.compile(
    rf"(?:[ \t]|\\\r?\n)*+([^\W\d]\w*+(?![\"'])|{_PY_NEWLINE}|[(),.\[\]](?![.\d])|[:=]=?"
    rf"|(?:[rRbBuU]|[bB][rR]|[rR][bB])?(?:\"\"\"(?:[^\\\"]|\\(?s:.)|\"(?!\"\"))*+\"\"\"|'''(?:[^\\']|\\(?s:.)|'(?!''))*+'''|\"(?!\"\")(?:[^\"\\\r\n]|\\.)*+\"|'(?!'')(?:[^'\\\r\n]|\\.)*+')"
    rf"|[fF](?:\"(?!\"\")(?:[^\"\\\r\n{{}}]|\{{\{{|\}}\}}|\{{[^\"\\\r\n{{}}]*\}})*+\"|'(?!'')(?:[^'\\\r\n{{}}]|\{{\{{|\}}\}}|\{{[^'\\\r\n{{}}]*\}})*+')|(?:[fF][rR]?|[rR][fF])[\"']|{WORD}|{_PY_NUMBER}\w*|{_ops(PYTHON_OPS)}|(?s:.))"
)
_PY_PLAIN = re.compile(rf"(?:(?:0|[1-9](?:_?\d)*)(?:\.\d+)?|\d+\.\d*|\.\d+|0[xX][0-9a-fA-F]+)")
#: Names remembered with their kind: few enough to stay in the processor's cache.
KEPT_NAMES = 8_000
#: Stand-ins in the fast lexer: a line's end, and what it leaves to the slow one.
_BREAK, _ODD = "\n", "\0"
_OPENS, _CLOSES = [kind(c) for c in "([{"], [kind(c) for c in ")]}"]


class _PythonKinds(dict):
    """Kinds of words by their text; those of names, literals and f-strings are found once."""

    def __missing__(self, w: str) -> str:
        c = w[0]
        if w[-1] in " \t\n" or c in "#\r\n":
            return _BREAK
        if c.isalpha() or c == "_":
            if w[-1] in "\"'":
                return self._literal(w)
            k = NAME
        elif c in "\"'" and len(w) > 1:
            return STRING
        else:
            k = NUMBER if _PY_PLAIN.fullmatch(w) else _ODD
        if len(self) > KEPT_NAMES:
            self.clear()
            self.update(PYTHON)
        self[w] = k
        return k

    def _literal(self, w: str) -> str:
        if "f" not in w[:2].lower() or w[0] in "\"'":
            return BYTES if "b" in w[:2].lower() else STRING
        if len(w) < 3:
            return _ODD
        out = [FSTART]
        for field in _PY_FIELD.findall(w, 2, len(w) - 1):
            if field[0] == "{" != field[1]:
                out += FOPEN, self._field(field[1:-1]), FCLOSE
        k = "".join(out) + FEND
        return _ODD if _ODD in k else k

    def _field(self, code: str) -> str:
        """Kinds of a field that is a plain expression."""
        k = self._fields.get(code)
        if k is None:
            words = _PY_FAST.findall(code)
            odd = any(x in ":!=\\" or x[0] in "\"'#\r\n" for x in words)
            k = self._fields[code] = _ODD if odd or not code.strip() else "".join(map(self.__getitem__, words))
            if len(self._fields) > KEPT_NAMES:
                self._fields.clear()
        return k

    _fields: dict[str, str] = {}


_PY_FIELD = re.compile(r"\{\{|\}\}|\{[^{}]*\}|\\.")
_PY_KINDS = _PythonKinds({**PYTHON, "!=": kind("!=")})


def lex_python(text: str) -> Tokens:
    """Words by one pattern, then line by line the brackets and indents; whatever is out of the ordinary goes to the slow lexer."""
    if "\t" in text or "\f" in text or text[:1] in " \ufeff" or "\r" in text.replace("\r\n", ""):
        return _lex_python_slow(text)
    whole = text if text.endswith("\n") else text + "\n"
    words = _PY_FAST.findall(whole)
    kinds = list(map(_PY_KINDS.__getitem__, words))
    if _ODD in kinds:
        return _lex_python_slow(text)
    indents, depth, seen, start, last = [0], 0, False, 0, len(words) - 1
    for i in [i for i, k in enumerate(kinds) if k == _BREAK]:
        line = "".join(kinds[start:i])
        start = i + 1
        if line:
            seen = True
            depth += sum(map(line.count, _OPENS)) - sum(map(line.count, _CLOSES))
        if depth:
            kinds[i] = ""
            continue
        piece = NEWLINE if seen else ""
        seen = False
        w = words[i]
        col = len(w) - 1 - w.rfind("\n") if i < last else 0
        if col > indents[-1]:
            indents.append(col)
            piece += INDENT
        else:
            while col < indents[-1]:
                indents.pop()
                piece += DEDENT
            if col != indents[-1]:
                return _lex_python_slow(text)
        kinds[i] = piece
    if depth:
        return _lex_python_slow(text)

    def offsets():
        starts, ends = [], []
        for m, k in zip(_PY_FAST.finditer(whole), kinds):
            a, b = m.span(1)
            for _ in k:
                starts.append(a)
                ends.append(b)
        return starts + [len(text)] * len(indents), ends + [len(text)] * len(indents)

    return Tokens(text, "".join(kinds) + DEDENT * (len(indents) - 1) + EOF, offsets)


_JS_NUMBER = r"0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[bB][01](?:_?[01])*n?|0[oO][0-7](?:_?[0-7])*n?|(?:\d(?:_?\d)*n|(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][-+]?\d(?:_?\d)*)?)"
_JS = re.compile(
    r"(?P<b>\s*+(?:(?://[^\r\n\u2028\u2029]*|/\*(?s:.*?)\*/|^\#![^\n]*)\s*+)*+)"
    rf"(?:(?P<w>(?:[^\W\d]|\$|\\u)(?:\w|\$|[\u200c\u200d]|\\u(?:[0-9a-fA-F]{{4}}|{{[0-9a-fA-F]+}}))*+)|(?P<o>\?\.(?!\d)|{_ops([o for o in SCRIPT_OPS if o not in ('?.', '/=', '/', '.', '#')])}|\.(?!\d))|(?P<n>{_JS_NUMBER})|(?P<s>'(?:[^'\\\r\n]|\\(?:\r\n|(?s:.)))*+'|\"(?:[^\"\\\r\n]|\\(?:\r\n|(?s:.)))*+\")|(?P<t>`)|(?P<d>/=?)|(?P<p>#[^\W\d][\w$]*)|(?P<e>\Z))"
)
_JS_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*+\])++/(\w*)")
_JS_TEMPLATE = re.compile(r"(?:[^`\\$]|\\(?s:.)|\$(?!\{))*+(`|\$\{)")
_JSX_TAG = re.compile(r"(?:\s|//[^\n]*|/\*(?s:.*?)\*/)*+(?:(?P<w>[^\W\d][\w$-]*)|(?P<s>'[^']*'|\"[^\"]*\")|(?P<o>/>|[>=.:{/]))")
_AFTER_VALUE = {SCRIPT[w] for w in ("this", "super", "true", "false", "null", ")", "]", "}", "++", "--")} | {NAME, NUMBER, STRING, TEMPLATE, TAIL, REGEX, PRIVATE, JEND, JSELF} | {
    SCRIPT[w] for w in "async let static get set of from as type interface namespace module declare abstract readonly public private protected is keyof infer unique asserts satisfies override accessor global require constructor target meta any out".split()
}


def lex_script(text: str, jsx: bool = False, strict: bool = False) -> Tokens:
    """JavaScript and TypeScript; with jsx, a < where a value begins opens markup; strict code has no numbers like 010."""
    kinds, starts, ends = [], [], []
    pos, n, prev = 1 if text[:1] == "\ufeff" else 0, len(text), ""
    frames: list[str] = []  # { for a brace, $ for a template's field, J for a field in markup
    match, table, breaks = _JS.match, SCRIPT, re.compile(r"[^\r\n]*[\r\n]").match

    def put(k, a, b):
        kinds.append(k)
        starts.append(a)
        ends.append(b)

    def tag(pos: int, names: list[str]) -> tuple[int, bool]:
        """Reads a tag after its <; the offset after it, or of a field's brace, and whether the tag ended."""
        while True:
            m = _JSX_TAG.match(text, pos)
            if not m:
                raise LexError(pos, "bad markup")
            pos, g = m.end(), m.lastgroup
            a = m.start(g)
            if g == "w":
                put(JNAME, a, pos)
            elif g == "s":
                put(STRING, a, pos)
            elif m[g] in ("/>", ">"):
                put(JSELF if m[g] == "/>" else JEND, a, pos)
                return pos, True
            elif m[g] == "{":
                put(table["{"], a, pos)
                return pos, False
            else:
                put(table[m[g]], a, pos)

    markup: list[list] = []  # [in a tag, name's first token, open elements before]

    def children(pos: int) -> int:
        """From inside an element up to a field's brace or the end of the outermost element."""
        while markup:
            if markup[-1][0]:
                closing = markup[-1][0] == "close"
                pos, ended = tag(pos, [])
                if not ended:
                    frames.append("J")
                    return pos
                m = markup[-1]
                if m[2] is None:
                    first = m[1]
                    last = first
                    while kinds[last] == JNAME or kinds[last] in (table["."], table[":"]):
                        last += 1
                        if last >= len(kinds) or (kinds[last] == JNAME and kinds[last - 1] == JNAME):
                            break
                    m[2] = "".join(text[starts[i] : ends[i]] for i in range(first, last))
                if kinds[-1] == JSELF:
                    markup.pop()
                elif closing:
                    name = m[2]
                    markup.pop()
                    if not markup or markup[-1][2] != name:
                        raise LexError(pos, "closing tag of another name")
                    markup.pop()
                else:
                    m[0] = ""
                continue
            a = pos
            while pos < n and text[pos] not in "<{>}":
                pos += 1
            if pos >= n:
                raise LexError(n, "markup left open")
            if pos > a:
                put(JTEXT, a, pos)
            c = text[pos]
            if c in ">}":
                raise LexError(pos, f"{c} in markup text")
            if c == "{":
                put(table["{"], pos, pos + 1)
                frames.append("J")
                return pos + 1
            if text.startswith("</", pos):
                put(JCLOSE, pos, pos + 2)
                markup.append(["close", len(kinds), None])
                pos += 2
            else:
                put(JOPEN, pos, pos + 1)
                markup.append(["open", len(kinds), None])
                pos += 1
        return pos

    depth_of: list[list] = []
    scan, ended = _JS.finditer, False
    while not ended:
        for m in scan(text, pos):
            if m.start() != pos:
                raise LexError(re.compile(r"\s*").match(text, pos).end(), "unterminated comment, string or unexpected character")
            g = m.lastgroup
            gap, moved = pos, False
            a, pos = m.span(g)
            if g == "w":
                k = table.get(text[a:pos], NAME)
            elif g == "o":
                o = text[a:pos]
                k = table[o]
                if o == "{":
                    frames.append("{")
                elif o == "}":
                    if not frames:
                        raise LexError(a, "bracket without its partner")
                    f = frames.pop()
                    if f == "$":
                        t = _JS_TEMPLATE.match(text, pos)
                        if not t:
                            raise LexError(a, "unterminated template")
                        pos, moved = t.end(), True
                        k = TAIL if t[1] == "`" else MIDDLE
                        if k == MIDDLE:
                            frames.append("$")
                    elif f == "J":
                        put(k, a, pos)
                        markup = depth_of.pop()
                        pos, moved = children(pos), True
                        if frames and frames[-1] == "J" and markup:
                            depth_of.append(markup)
                            markup = []
                            prev = table["{"]
                        else:
                            prev = JEND
                        break
                elif o == "<" and jsx and prev not in _AFTER_VALUE and re.compile(r"\s*(?:[A-Za-z_$]|>)").match(text, pos) and not re.compile(r"\s*[\w$]+\s*(?:,|extends\b|=)").match(text, pos):
                    put(JOPEN, a, pos)
                    markup = [["open", len(kinds), None]]
                    pos, moved = children(pos), True
                    if frames and frames[-1] == "J" and markup:
                        depth_of.append(markup)
                        markup = []
                        prev = table["{"]
                    else:
                        prev = JEND
                    break
            elif g == "n":
                k = NUMBER
                if pos < n and (text[pos].isalnum() or text[pos] in "_$"):
                    raise LexError(pos, "bad number")
                if strict and text[a] == "0" and text[a + 1 : a + 2].isdigit():
                    raise LexError(a, "leading zeros in a number")
            elif g == "s":
                k = STRING
            elif g == "d":
                if prev in _AFTER_VALUE and not (prev == table["}"] and "\n" in text[gap:a]):
                    k = table[m["d"]]
                else:
                    r = _JS_REGEX.match(text, a)
                    if not r:
                        raise LexError(a, "unterminated regular expression")
                    pos, moved = r.end(), True
                    k = REGEX
            elif g == "t":
                t = _JS_TEMPLATE.match(text, pos)
                if not t:
                    raise LexError(a, "unterminated template")
                pos, moved = t.end(), True
                k = TEMPLATE if t[1] == "`" else HEAD
                if k == HEAD:
                    frames.append("$")
            elif g == "p":
                k = PRIVATE
            else:
                ended = True
                break
            prev = k
            kinds.append(k if a == gap or a == gap + 1 and text[gap] == " " or not breaks(text, gap, a) else chr(ord(k) + 1))
            starts.append(a)
            ends.append(pos)
            if moved:
                break
        else:
            raise LexError(re.compile(r"\s*").match(text, pos).end(), "unterminated comment, string or unexpected character")
    if frames:
        raise LexError(n, "bracket left open")
    kinds.append(chr(ord(EOF) + 1))
    starts.append(n)
    ends.append(n)
    return Tokens(text, "".join(kinds), (starts, ends))


_C_COMMENTS = r"\s*+(?:(?://[^\n]*|/\*(?s:.*?)\*/)\s*+)*+"
_ESCAPE = r"\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|[btnfrs0\"'\\]|\r?\n)"
_JAVA_NUMBER = r"0[xX](?:[0-9a-fA-F](?:_*[0-9a-fA-F])*)?(?:\.(?:[0-9a-fA-F]+)?)?(?:[pP][-+]?\d+)?[lLfFdD]?|0[bB][01](?:_*[01])*[lL]?|(?:\d(?:_*\d)*\.?(?:\d(?:_*\d)*)?|\.\d(?:_*\d)*)(?:[eE][-+]?\d+)?[lLfFdD]?"
_JAVA = re.compile(rf"{_C_COMMENTS}(?:(?P<w>(?:[^\W\d]|\$)[\w$]*)|(?P<n>\.?\d(?<!\.)(?!)|(?=\.?\d)(?:{_JAVA_NUMBER}))|(?P<o>{_ops(JAVA_OPS)})|(?P<s>\"\"\"[ \t\f]*\r?\n(?:[^\\\"]|\\(?s:.)|\"(?!\"\"))*+\"\"\"|\"(?:[^\"\\\r\n]|{_ESCAPE})*+\")|(?P<q>'(?:[^'\\\r\n]|{_ESCAPE})')|(?P<e>\Z))")
_RUST_NUMBER = r"0x[0-9a-fA-F_]+(?:[iu](?:8|16|32|64|128|size))?|0b[01_]+(?:[iu](?:8|16|32|64|128|size))?|0o[0-7_]+(?:[iu](?:8|16|32|64|128|size))?|\d[\d_]*(?:\.(?![._a-zA-Z])[\d_]*)?(?:[eE][-+]?[\d_]+)?(?:_*[iu](?:8|16|32|64|128|size)|_*f(?:32|64))?"
_RUST = re.compile(
    rf"\s*+(?:(?P<c>//[^\n]*|/\*)|(?P<r>(?:b|c)?r(?P<h>#*)\")|(?P<s>[bc]?\"(?:[^\"\\]|\\(?s:.))*+\")|(?P<q>b?'(?:[^'\\\n\r\t]|\\(?:x[0-9a-fA-F]{{2}}|u\{{[0-9a-fA-F_]+\}}|[nrt0\\'\"]))')|(?P<t>'[^\W\d]\w*)|(?P<w>(?:r#)?{WORD})|(?P<n>{_RUST_NUMBER})|(?P<o>{_ops(RUST_OPS)})|(?P<e>\Z))"
)
_RUST_COMMENT = re.compile(r"/\*|\*/")
_GO_NUMBER = r"0[xX](?:_?[0-9a-fA-F])+(?:\.(?:[0-9a-fA-F_]*))?(?:[pP][-+]?\d+)?i?|0[bB](?:_?[01])+i?|0[oO](?:_?[0-7])+i?|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][-+]?\d+)?i?"
_GO_ESCAPE = r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|[abfnrtv\\'\"])"
_GO = re.compile(
    rf"(?P<b>(?:[ \t\r\n]|//[^\n]*|/\*(?s:.*?)\*/)*+)(?:(?P<w>{WORD})|(?P<n>(?=\.?\d)(?:{_GO_NUMBER}))|(?P<o>{_ops(GO_OPS)})|(?P<s>\"(?:[^\"\\\n]|{_GO_ESCAPE})*+\"|`[^`]*`)|(?P<q>'(?:[^'\\\n]|{_GO_ESCAPE})')|(?P<e>\Z))"
)
_GO_ENDS = {NAME, NUMBER, STRING, CHAR} | {GO[x] for x in ("break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}")}


def _lex_plain(pattern: re.Pattern, table: dict[str, str], text: str) -> Tokens:
    kinds, starts, ends = [], [], []
    pos = 1 if text[:1] == "\ufeff" else 0
    match = pattern.match
    while True:
        m = match(text, pos)
        if not m:
            raise LexError(re.compile(r"\s*").match(text, pos).end(), "unterminated comment, string or unexpected character")
        g = m.lastgroup
        a, pos = m.start(g), m.end()
        if g == "w":
            kinds.append(table.get(m["w"], NAME))
        elif g == "o":
            kinds.append(table[m["o"]])
        elif g == "n":
            kinds.append(NUMBER)
            if pos < len(text) and (text[pos].isalnum() or text[pos] == "_"):
                raise LexError(pos, "bad number")
        elif g == "s":
            kinds.append(STRING)
        elif g == "q":
            kinds.append(CHAR)
        else:
            break
        starts.append(a)
        ends.append(pos)
    kinds.append(EOF)
    starts.append(len(text))
    ends.append(len(text))
    return Tokens(text, "".join(kinds), (starts, ends))


def _lex_java_slow(text: str) -> Tokens:
    return _lex_plain(_JAVA, JAVA, text[:-1] if text.endswith("\x1a") else text)


def _lex_rust_slow(text: str) -> Tokens:
    kinds, starts, ends = [], [], []
    pos, n = 1 if text[:1] == "\ufeff" else 0, len(text)
    if text.startswith("#!", pos) and not re.compile(r"#!\s*\[").match(text, pos):
        pos = text.find("\n", pos) if "\n" in text else n
    match = _RUST.match
    while True:
        m = match(text, pos)
        if not m:
            raise LexError(re.compile(r"\s*").match(text, pos).end(), "unterminated string or unexpected character")
        g = m.lastgroup
        if g == "h":
            g = "r"
        a, pos = m.start(g), m.end()
        if g == "w":
            k = RUST.get(m["w"], NAME)
        elif g == "o":
            k = RUST[m["o"]]
        elif g == "c":
            if m["c"] == "/*":
                level = 1
                while level:
                    c = _RUST_COMMENT.search(text, pos)
                    if not c:
                        raise LexError(a, "unterminated comment")
                    level += 1 if c[0] == "/*" else -1
                    pos = c.end()
            continue
        elif g == "n":
            k = NUMBER
            if pos < n and (text[pos].isalnum() or text[pos] == "_"):
                raise LexError(pos, "bad number")
        elif g == "s":
            k = STRING
        elif g == "r":
            end = text.find('"' + m["h"], pos)
            if end < 0:
                raise LexError(a, "unterminated string")
            pos = end + 1 + len(m["h"])
            k = STRING
        elif g == "q":
            k = CHAR
        elif g == "t":
            k = LIFETIME
        else:
            break
        kinds.append(k)
        starts.append(a)
        ends.append(pos)
    kinds.append(EOF)
    starts.append(n)
    ends.append(n)
    return Tokens(text, "".join(kinds), (starts, ends))


def _lex_go_slow(text: str) -> Tokens:
    """With the semicolons that the language puts at line ends."""
    kinds, starts, ends = [], [], []
    pos, semi = 1 if text[:1] == "\ufeff" else 0, GO[";"]
    match = _GO.match
    last = ""
    while True:
        m = match(text, pos)
        if not m:
            raise LexError(re.compile(r"\s*").match(text, pos).end(), "unterminated comment, string or unexpected character")
        g = m.lastgroup
        a, pos = m.start(g), m.end()
        if last in _GO_ENDS and last and (g == "e" or "\n" in m["b"]):
            kinds.append(semi)
            starts.append(ends[-1])
            ends.append(ends[-1])
        if g == "w":
            last = GO.get(m["w"], NAME)
        elif g == "o":
            last = GO[m["o"]]
        elif g == "n":
            last = NUMBER
            if pos < len(text) and (text[pos].isalnum() or text[pos] == "_"):
                raise LexError(pos, "bad number")
        elif g == "s":
            last = STRING
        elif g == "q":
            last = CHAR
        else:
            break
        kinds.append(last)
        starts.append(a)
        ends.append(pos)
    kinds.append(EOF)
    starts.append(len(text))
    ends.append(len(text))
    return Tokens(text, "".join(kinds), (starts, ends))


class _BraceKinds(dict):
    """Kinds of words by their text, names remembered."""

    def __init__(self, table: dict[str, str], number: str):
        super().__init__(table)
        self.table, self.number = table, re.compile(number)

    def __missing__(self, w: str) -> str:
        c = w[:1]
        if c.isalpha() or c in "_$" and c:
            if '"' in w[:6]:
                return STRING if w.count('"') > 1 else _ODD
            if w[-1] == "'":
                return CHAR
            k = NAME
        elif c in "\"`" and len(w) > 1:
            return STRING
        elif c == "'" and len(w) > 1:
            return CHAR if w[-1] == "'" else LIFETIME
        else:
            k = NUMBER if w and self.number.fullmatch(w) else _ODD
        if len(self) > KEPT_NAMES:
            self.clear()
            self.update(self.table)
        self[w] = k
        return k


_FLAT_COMMENTS = r"\s*+(?:(?://[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*))*+\*/)\s*+)*+"
_JAVA_FAST = re.compile(rf"{_C_COMMENTS}((?:[^\W\d]|\$)[\w$]*+|[(){{}};,]|(?=\.?\d)(?:{_JAVA_NUMBER})\w*|{_ops(JAVA_OPS)}|\"\"\"[ \t\f]*\r?\n(?:[^\\\"]|\\(?s:.)|\"(?!\"\"))*+\"\"\"|\"(?:[^\"\\\r\n]|{_ESCAPE})*+\"|'(?:[^'\\\r\n]|{_ESCAPE})'|\Z|(?s:.))")
_RUST_FAST = re.compile(
    rf"{_FLAT_COMMENTS}([^\W\d]\w*+(?![\"'#])|[(){{}};,]|/\*|[bc]?r\"[^\"]*\"|[bc]?r#\"(?:[^\"]|\"(?!#))*+\"#|[bc]?r#*\"|[bc]?\"(?:[^\"\\]|\\(?s:.))*+\"|b?'(?:[^'\\\n\r\t]|\\(?:x[0-9a-fA-F]{{2}}|u\{{[0-9a-fA-F_]+\}}|[nrt0\\'\"]))'|'[^\W\d]\w*|(?:r#)?{WORD}|(?=\d)(?:{_RUST_NUMBER})\w*|{_ops(RUST_OPS)}|\Z|(?s:.))"
)
_GO_FAST = re.compile(rf"(?:[ \t\r]|//[^\n]*|/\*(?:[^*\n]|\*(?!/))*+\*/)*+([^\W\d]\w*+|[(){{}},.](?!\d|\.)|\n\s*|/\*(?:[^*]|\*(?!/))*+\*/|/\*|(?=\.?\d)(?:{_GO_NUMBER})\w*|{_ops(GO_OPS)}|\"(?:[^\"\\\n]|{_GO_ESCAPE})*+\"|`[^`]*`|'(?:[^'\\\n]|{_GO_ESCAPE})'|\Z|(?s:.))")
_JAVA_KINDS, _RUST_KINDS = _BraceKinds({**JAVA, "": ""}, _JAVA_NUMBER), _BraceKinds({**RUST, "": ""}, _RUST_NUMBER)
_GO_KINDS = _BraceKinds({**GO, "": ""}, _GO_NUMBER)
_GO_SEMICOLON = re.compile("(?<=[" + re.escape("".join(sorted(_GO_ENDS))) + "])" + _BREAK)


def _lex_fast(text: str, pattern: re.Pattern, table: _BraceKinds) -> Tokens | None:
    kinds = "".join(map(table.__getitem__, pattern.findall(text)))
    if _ODD in kinds:
        return None

    def offsets():
        spans = [m.span(1) for m in pattern.finditer(text) if m[1]]
        return [a for a, _ in spans] + [len(text)], [b for _, b in spans] + [len(text)]

    return Tokens(text, kinds + EOF, offsets)


def lex_java(text: str) -> Tokens:
    t = None if text[:1] == "\ufeff" or text[-1:] == "\x1a" else _lex_fast(text, _JAVA_FAST, _JAVA_KINDS)
    return t or _lex_java_slow(text)


def lex_rust(text: str) -> Tokens:
    """Nested comments and raw strings with more than one # go to the slow lexer."""
    t = None if text[:1] == "\ufeff" or text.startswith("#!") else _lex_fast(text, _RUST_FAST, _RUST_KINDS)
    return t or _lex_rust_slow(text)


def lex_go(text: str) -> Tokens:
    """With the semicolons that the language puts at line ends."""
    if text[:1] == "\ufeff":
        return _lex_go_slow(text)
    marks = "".join([_BREAK if w[:1] == "\n" or w[:2] == "/*" and len(w) > 2 else _GO_KINDS[w] for w in _GO_FAST.findall(text)])
    if _ODD in marks:
        return _lex_go_slow(text)
    closed = _GO_SEMICOLON.sub(GO[";"], marks)
    last = marks.rstrip(_BREAK)[-1:]
    final = GO[";"] if last and last in _GO_ENDS and closed[-1:] == last else ""

    def offsets():
        starts, ends, end = [], [], 0
        for k, m in zip(closed, (m for m in _GO_FAST.finditer(text) if m[1])):
            if k != _BREAK:
                a, b = m.span(1) if m[1][0] != "\n" and m[1][:2] != "/*" else (end, end)
                starts.append(a)
                ends.append(b)
                end = b
        if final:
            starts.append(end)
            ends.append(end)
        return starts + [len(text)], ends + [len(text)]

    return Tokens(text, closed.replace(_BREAK, "") + final + EOF, offsets)


#: The language of each extension.
LANGUAGE_OF = {"py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "rs": "rust"}


def extension(path: str | None) -> str:
    name = (path or "").rpartition("/")[2]
    return name.rpartition(".")[2].lower() if "." in name else ""


def tokens(text: str, ext: str) -> Tokens:
    """The tokens of a text in the language of an extension."""
    language = LANGUAGE_OF[ext]
    if language in ("javascript", "typescript"):
        return lex_script(text, ext in ("jsx", "tsx"), ext != "cjs")
    return {"python": lex_python, "java": lex_java, "go": lex_go, "rust": lex_rust}[language](text)
