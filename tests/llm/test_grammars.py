"""Texts that parse and texts that do not, by language; Python also against the standard parser."""

import ast
import warnings
from pathlib import Path

import pytest

from strandline.functions.lexing import LexError, _lex_go_slow, _lex_java_slow, _lex_python_slow, _lex_rust_slow, lex_go, lex_java, lex_python, lex_rust, tokens
from strandline.llm import syntax
from strandline.llm.grammars import grammar
from strandline.llm.syntax import verdict

VALID = {
    "py": [
        "", "# only\n", "x = 1", "def f(a, /, b: int = 2, *c, d, **e) -> dict[str, int]:\n    '''doc'''\n    return {**e, 'a': [*c]}\n", "class A(B, metaclass=M):\n    x: int = 3\n\n    @p.q(1)\n    async def f(self):\n        async with a as b, c:\n            await d\n        return [i async for i in x if i]\n",
        "match x:\n    case {'a': [1, *r], **k} if r:\n        pass\n    case A.B | C(d=1) as e:\n        pass\n    case _:\n        pass\n", "f'{a!r:>{w}} {b[\"k\"]} {{}} {c=}'\n", "try:\n    pass\nexcept* (A, B) as e:\n    raise X from e\nelse:\n    pass\nfinally:\n    del a[0], b.c\n", "x = yield\ny = lambda *a, b=1: (yield)\n", "if (n := f()) > 1: print(n); pass\n",
        "with (open(a) as f, open(b)):\n    pass\n", "a = b = c, *d = e\nx += 1,\n", "type X[T] = list[T]\ndef g[T: int](x: T): ...\n", "match = case = type = 1\nmatch(x)\n", "def f(a, b=1, /, c=2, *, d, e=3, **g): pass\ndef h(a, /, b): f(a, *b, c=1, *d, e=2, **g, h=3)\nx = lambda a, /, b=1, *c, d: f(i for i in a)\ny = b'a' b'c' + rb'd'\nclass A(*b, m=1, **k): pass\n", "x\U000e0100 = 1\n\u2118a = f'{1+2 = # c\n }'\n", "x = (1,\n  2)  # c\n\n\tif_ = 3\n" if False else "x = (1,\n  2)\n",
    ],
    "js": [
        "", "// c\n", "import a, { b as c } from 'x';\nexport default class extends A { #p = 1; static { f(); } get x() { return this.#p } async *g() { yield* h } }\n", "const f = async (a, { b = 1, ...c }, [d, , e] = []) => ({ a, [b]: c, get d() { return 1 } })\n", "for (const [k, v] of Object.entries(x)) if (k) continue; else break\n",
        "a?.b?.[c]?.(d) ?? e ** 2\nlet r = /[/\\]}]+/g.test(s) ? `a${`b${c}`}d` : x / y / z\n", "label: for (var i = 0, n = 3; i < n; i++) { switch (i) { case 1: default: } }\n", "export { x as default } from './y.js'\nexport * as z from 'z'\nif (a) { } else if (b) c()\ndo x++; while (x < 3)\n", "var a = b\n++c\n", "for (const a of b) ; for (const {c} of d) ; for (let e; ;) ; var {f} = g, h;\ndelete a.b; delete a[b]; delete f().c; 'a'.b = 1; let async = 1;\nexport default class { }\n",
    ],
    "jsx": ["export const A = () => <div className=\"x\" {...p}>don't (stop {n ? <B.C a={1} /> : null} &amp; it's</div>;\n", "const x = a < b && c > d;\nreturn_(<><i/>text</>)\n"],
    "cjs": ["x = 010; delete x;\n", "const a = require('a');\nmodule.exports = function () { return a };\n"],
    "ts": [
        "interface A<T extends B = C> extends D<T>, E { readonly x?: number; [k: string]: any; m<U>(a: U): void; new (x: T): A<T> }\n", "type F = (a: string, ...b: number[]) => a is string;\ntype M = { readonly [K in keyof T]?: T[K] };\ntype C2<T> = T extends (infer U)[] ? U : never;\n",
        "@Dec({ a: 1 })\nexport abstract class X<T> extends Y<T> implements Z { constructor(private readonly a: string, public b?: number) { super() } @memo() protected async f<U>(this: X, x: U[]): Promise<Map<string, Array<U>>> { return x as unknown as any } abstract g(): void; declare y: string; h!: number }\n",
        "enum E { A = 1, B = 'x' }\ndeclare module 'm' { export function f(x: number): string }\nnamespace N.M { export const a = <T,>(x: T): T => x }\nlet v = <any>w!.x satisfies Q;\nfunction over(a: string): void;\nfunction over(a: any) { }\nimport type { T } from './t';\nexport type { T };\nconst z = f<number>(1) < g;\nlet t: [a: string, b?: number] | `x${string}`;\n",
    ],
    "tsx": ["const C = ({ a }: Props): JSX.Element => <Foo on={(e: Event) => e!}>{a as string}</Foo>;\nconst g = <T,>(x: T) => x;\n"],
    "java": [
        "package a.b;\nimport static a.B.*;\n@Ann(x = {1, 2}, y = @Z)\npublic abstract class A<T extends B & C> extends D<T[]> implements E<?>, F { private final Map<String, List<? super T>> m = new HashMap<>() {{ put(\"a\", null); }}; static { int x = 1; } A(int... a) throws X { this(1); } @Override public <U> U f(final T t) { for (var x : m.entrySet()) { if (x instanceof Foo f && f.y() > 1) continue; } return (U) (Object) t; } }\n",
        "enum E implements I { A(1) { void f() { } }, B; E(int... x) { } }\nrecord R<T>(int a, T... b) implements S { R { a++; } }\nsealed interface S permits R, Q { default int g() { return switch (x) { case 1, 2 -> 3; case R(int a, var b) when a > 1 -> { yield 4; } case Q q when b -> 5; case Q q when !b && c -> 6; default -> throw new X(); }; } }\n@interface N { int v() default 1; }\n",
        "class L { Runnable r = () -> { }; F<A, B> g = (a, b) -> a.c(b)::d; int[][] z = {{1}, {}}; int y = new int[3][].length; void f() { try (var a = b(); c) { } catch (X | Y e) { } finally { } a.<T>b(); int.class.f(); String s = \"\"\"\n  x \"q\" \"\"\"; L[]::new; } }\n".replace(" L[]::new;", " Object o = L[]::new;"),
    ],
    "go": [
        "package p\n\nimport (\n\t\"a\"\n\tb \"c\"\n\t. \"d\"\n)\n\ntype T[K comparable, V any] struct {\n\tA, B int `json:\"a\"`\n\t*E\n\tm map[K][]V\n}\n\ntype I interface {\n\tM(x int, y ...string) (int, error)\n\t~int | ~string\n}\n\nfunc (t *T[K, V]) F(a, b int, c func(int) error) (n int, err error) {\n\tdefer func() { recover() }()\n\tfor i, x := range t.m {\n\t\tif v, ok := x.(type2); ok && v != (T2{1}) {\n\t\t\tcontinue\n\t\t}\n\t}\n\tswitch y := z.(type) {\n\tcase int, *string:\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-ch:\n\t\t_ = v\n\tcase ch <- 1:\n\t}\n\tgo f(x...)\n\treturn a[1:2], nil\n}\n",
        "package p\n\nvar x = []struct{ a int }{{1}, {a: 2}}\n\nconst (\n\tA = iota\n\tB\n)\n",
    ],
    "rs": [
        "#![allow(x)]\nuse a::{b, c::{self, d as e}, *};\n#[derive(Debug)]\npub(crate) struct S<'a, T: B + 'a = C, const N: usize>(pub &'a mut T, [u8; N]) where T: ?Sized;\nenum E { A = 1, B { x: i32 }, C(u8) }\nimpl<'a, T> Tr<T> for S<'a, T> where T: Fn(i32) -> u8 { type O = Vec<Option<T>>; const X: u8 = b'a'; fn f(&mut self, (a, _): (u8, i8)) -> Result<(), Box<dyn Er + 'a>> { let Some(x) = y else { return Ok(()) }; if let A::B { x, .. } = z && c { loop { break 'l } } match x { 1..=2 | -3 => {} A(ref b @ 1) if b > 0 => f(), _ => return, } v.iter().map(|&x| x + 1).collect::<Vec<_>>()?; s![a; b]; x as u8 < 3; Ok(()) } }\n",
        "macro_rules! m { ($x:expr) => { $x + 1 }; }\nunsafe extern \"C\" { fn g(a: *const u8, ...) -> !; }\nasync fn h() { async move { x.await? }; let c = move |a: i32| -> i32 { a }; r#\"a \"q\" b\"#; while let Some(P { a, b: c }) = it.next() { } }\ntrait T: A + B { fn d(&self) { } }\n", "fn f() { a < b && c > d || e as u8 == 3; (a == b) == c; a >> 2 < b; for i in 0..=n { } match x { 1..=2 => {} 3.. => {} ..=4 => {} } let r = ..=5; let s = a..; x = y == z; }\n",
    ],
}
INVALID = {
    "py": ["def f(:\n  pass", "x = (1", "if a:\nb", "print 'x'", "f() = 1", "a b", "def f():\n", "x = 'abc", "<<<<<<< HEAD\nx = 1\n", "  x = 1\n", "class A {\n}\n", "return = 1", "for x in:\n  pass", "x = [1, 2\ny = 3\n", "f'{a'", "a = not b == not c", "f(**k, *a b)", "def f(a=1, b): pass", "lambda x=1, y: 0", "f(a=1, 2)", "f(**k, *a)", "class A(x for x in y): pass", "x = 'a' b'c'", "f(x for x in y, 1)", "def f(a, /, b=1, c): pass"],
    "js": ["let a = ;", "function f( { }", "const x: number = 1;", "class A { x() { }", "interface A { }", "<div/>", "return }", "import x from", "@d class A { }", "a => { } b", "if (a) else b", "=======\n", "x = `a${b`", "package main\n", "const a;", "class { }", "1 = 2", "let let = 1", "x = 010", "delete x", "let {a};", "const {a};", "let [b], c;"],
    "cjs": ["const a;", "import a from 'a';\n", "export const x = 1;\n"],
    "ts": ["let a: = 1;", "function f(a: string { }", "interface A { x: }", "const a = <div>x</div>;", "class A { f(): void { }"],
    "jsx": ["const a = <div>x</span>;", "const a = <div>;", "const a = <p>a > b</p>;"],
    "java": ["class A { void f() { ", "class A { int x }", "public void f() { }", "class A { void f() { int = 3; } }", "package a\nclass A { }", "class A { void f() { 1 + 2; } }", "func main() { }"],
    "go": ["package p\nfunc f( {\n}\n", "func f() { }\n", "package p\nx := 1\n", "package p\nfunc f() {\n", "class A { }"],
    "rs": ["fn f( { }", "fn f() { let x = 1 let y = 2; }", "struct A { x: }", "fn f() -> { }", "fn f() {", "package a;", "impl A for { }", "fn f() { x = ; }", "fn f() { a < b < c; }", "fn f() { a == b == c; }", "fn f() { let y = x ..=; }", "fn f() { if a == b == c { } }", "fn f() { match x { 1..= => {} } }"],
}


@pytest.mark.parametrize("ext, text", [(e, t) for e, ts in VALID.items() for t in ts])
def test_valid(ext, text):
    assert verdict(text, ext)[0] is True, verdict(text, ext)
    assert verdict(text.replace("\n", "\r\n"), ext)[0] is True


@pytest.mark.parametrize("ext, text", [(e, t) for e, ts in INVALID.items() for t in ts])
def test_invalid(ext, text):
    ok, at, cause, _ = verdict(text, ext)
    assert ok is False and 0 <= at <= len(text) and cause


def test_unknown_and_empty():
    assert verdict("x", "txt")[0] is None
    assert verdict(None, "py")[0] is True


def test_cause():
    assert verdict("def f():\n    x = (1,\n", "py")[2] == "truncated"
    far = "a = 1\n" * 2000
    assert verdict(f"{far}<<<<<<< HEAD\nb = 2\n=======\n{far}>>>>>>> x\n", "py")[2] == "merge conflict"
    assert verdict("x = (\n" + far + "<<<<<<< HEAD\nb = 2\n=======\n>>>>>>> x\n", "py")[2] == "merge conflict"
    assert verdict("Title\n=======\n", "py")[2] == "syntax"
    assert verdict("package a;\nclass B { int c; }\n", "py")[2] == "wrong extension"
    assert verdict("def f(a):\n    return a\n", "java")[2] == "wrong extension"
    assert len(verdict("x = = 1\n", "py")[3].split()) > 12


def test_deep_nesting_gives_a_verdict():
    for ext, a, b in (("js", "(", ")"), ("js", "[", "]"), ("rs", "(", ")")):
        text = "x = " + a * 8_000 + "1" + b * 8_000
        assert verdict(f"fn f() {{ {text}; }}" if ext == "rs" else text, ext)[0] is True
        assert verdict(f"fn f() {{ {text}{b}; }}" if ext == "rs" else text + b, ext)[0] is False


def test_answers_are_the_verdicts(spark):
    rows = [(i, 1, f"a.{e}", t) for i, (e, t) in enumerate([*((e, t) for e, ts in VALID.items() for t in ts), *((e, t) for e, ts in INVALID.items() for t in ts), ("txt", "x"), ("py", None)])]
    files = spark.createDataFrame([*rows, (99_999, None, None, "x")], "file_id bigint, repo_id int, file_path string, content string")
    assert sorted(map(tuple, syntax.answers(files).collect()), key=str) == sorted((tuple(r)[:4] for r in syntax.verdicts(files).collect()), key=str)
    assert syntax.answers(files.where("false")).count() == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test data")
def test_python_agrees_with_the_standard_parser_also_on_cut_texts():
    import pyarrow.parquet as pq

    files = pq.read_table("/root/testdata/sf0.01/parsed_files.parquet").to_pandas().drop_duplicates("file_id")
    for n, text in enumerate(files[files.file_path.str.endswith(".py")].content):
        for t in (text, text[: len(text) * (n % 7 + 1) // 9]):
            try:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    ast.parse(t)
                real = True
            except SyntaxError:
                real = False
            assert verdict(t, "py")[0] is real, t[-200:]


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test data")
def test_fast_and_slow_lexers_agree():
    import pyarrow.parquet as pq

    files = pq.read_table("/root/testdata/sf0.01/parsed_files.parquet").to_pandas().drop_duplicates("file_id")

    def kinds(f, text):
        try:
            return f(text).kinds
        except LexError as e:
            return e.at

    for path, text in zip(files.file_path, files.content):
        for ext, fast, slow in ((".py", lex_python, _lex_python_slow), (".java", lex_java, _lex_java_slow), (".go", lex_go, _lex_go_slow), (".rs", lex_rust, _lex_rust_slow)):
            if path.endswith(ext):
                assert kinds(fast, text) == kinds(slow, text), path


CONTINUED = {
    "js": ["if (a) b(c);", "else d(e);", "while (a) b(c);", "for (x of y) if (a) b(c);", "l: if (a) b(c);", "do b(c);", "while (a);", "if (a) b(c); else if (d) e();", "try { f(); } finally { g(); }"],
    "ts": ["if (a) throw b;", "else throw d;", "for (const x of y) if (a) b(c);", "let z: number = 1;", "else { }", "do b(c);", "while (a);"],
    "java": ["if (a) b(c);", "else d(e);", "while (a) b(c);", "for (A x : y) if (a) b(c);", "l: if (a) b(c);", "do b(c);", "while (a);"],
    "py": ["if a: b", "elif c: d", "else: e", "for a in b: c", "while a: b", "@a", "def f(): pass", "class B: pass", "try: a", "except B: c", "finally: d", "x = 1"],
    "rs": ["let a = b;", "if a { b; }", "else { c; }", "loop { a; }", "a = b;"],
    "go": ["a = b", "if a { b() }", "for { a() }", "return"],
}
AROUND = {"java": "class A {{ void f() {{ {} }} }}", "rs": "fn f() {{ {} }}", "go": "package p\nfunc f() {{\n{}\n}}\n"}


@pytest.mark.parametrize("ext", CONTINUED)
def test_statements_remembered_do_not_change_what_parses(ext):
    g = grammar(ext)
    g.furthest(tokens("", ext).kinds)
    parts = CONTINUED[ext]
    for text in [*([a] for a in parts), *([a, b] for a in parts for b in parts), *([a, b, c] for a in parts for b in parts for c in parts)]:
        kinds = tokens(AROUND.get(ext, "{}\n").format("\n".join(text)), ext).kinds
        plain = g._slow(kinds, [], [0, set()], [0]) == len(kinds)
        assert (g.parse(kinds) is not None) is plain, text


@pytest.mark.parametrize("ext", [*VALID])
def test_fixtures_with_a_warm_memory(ext):
    for text in [*VALID[ext], *INVALID.get(ext, []), *VALID[ext]]:
        assert verdict(text, ext)[0] is (text in VALID[ext]), text


def test_choice_is_ordered_and_memoised():
    g = grammar("js")
    assert g.parse(tokens("(a) => b", "js").kinds) is not None
    assert ("arrow", 0, 5) in g.parse(tokens("(a) => b", "js").kinds)
    assert not any(n == "arrow" for n, _, _ in g.parse(tokens("(a)", "js").kinds))
