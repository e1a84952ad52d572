import pytest

from strandline.llm import syntax
from strandline.llm.docpairs import description, is_trivial

FILES = "file_id bigint, repo_id int, file_path string, content string, kind string, code int"
CASES = {
    "a.py": ('class A:\n    class B:\n        def m(self):\n            """Reads the next four words."""\n            async def inner(x):\n                r"Walks over all the rows once."\n    def n(self): "Says what the thing does."; pass\ndef c():\n    # Comments are no documentation at all.\n    pass\ndef t():\n    """TODO: describe what happens here and why."""\ndef load_big_table():\n    """This method loads the big tables."""\n', {"A.B.m", "A.B.m.inner", "A.n"}),
    "b.ts": ("/** Reads one row of the given table. */\nexport function f(a: string) { /** Counts all rows it has seen. */ function g() { } }\n/** Turns every given name into lower case. */\nexport const h = async (x: number) => x;\nclass K {\n  /**\n   * Holds the lock until all is done.\n   * @param a the input that is used\n   */\n  @memo()\n  private m(a: string) { }\n  /** @param a what the caller has to give */\n  n(a) { }\n  // Not a doc comment at all here.\n  o() { }\n}\n", {"f", "f.g", "h", "K.m"}),
    "c.java": ("class A { /** Gives back the first of all rows. */ @Override public int f() { return 1; } /* Not a doc comment at all here. */ void g() { } static class B { /** Adds up what the rows hold. @return x */ void h() { } } }", {"A.f", "A.B.h"}),
    "d.go": ("package p\n\n// F gives back the first of all rows.\nfunc F() { }\n\n// This one is too far away from it.\n\nfunc G() { }\n\n// Reads what the store holds right now.\n//\n//go:noinline\nfunc (s *Store[T]) H() { }\n", {"F", "Store.H"}),
    "e.rs": ("impl<'a> S<'a> {\n    /// Gives back the first of all rows.\n    #[inline]\n    pub(crate) fn f(&self) { }\n    // Not a doc comment at all here.\n    fn g() { }\n}\n#[doc = \"Adds up what the rows hold.\"]\nfn h() { }\nimpl T for S<'_> { /** Keeps the rows in good order. */ fn i() { } }\n", {"S.f", "h", "S.i"}),
    "bad.py": ('def f(:\n    """Reads the next four words."""\n', set()),
    "empty.js": ("", set()),
    "none.js": (None, set()),
    "x.txt": ("/** Reads the next four words. */ function f() { }", set()),
    None: ("x", set()),
}


def test_found(spark):
    rows = [(i, 1, path, text, "k", 1) for i, (path, (text, _)) in enumerate(CASES.items())] * 2
    got = {}
    for r in syntax.pairs(spark.createDataFrame(rows, FILES).repartition(3)).collect():
        got.setdefault(r.file_id, set()).add(r.qualified_name)
        assert r.description and r.code
    assert got == {i: v[1] for i, v in enumerate(CASES.values()) if v[1]}


def test_source_range(spark):
    df = spark.createDataFrame([(1, 1, "a.py", "x = 1\n\n@d\ndef f(a):\n    'Reads the next four words.'\n    return a\n", "", 0)], FILES)
    r = syntax.pairs(df).first()
    assert (r.line_start, r.line_end, r.description) == (4, 6, "Reads the next four words.")
    assert r.code.startswith("def f(a):") and r.code.endswith("return a")


def test_verdicts_and_rates(spark):
    rows = [(i, 1, path, text, "k", 1) for i, (path, (text, _)) in enumerate(CASES.items())]
    df = spark.createDataFrame(rows + rows[5:6], FILES)
    got = {r.file_id: r.valid for r in syntax.verdicts(df).collect()}
    assert got[5] is False and got[8] is None and got[9] is None and all(got[i] for i in (0, 1, 2, 3, 4, 6, 7))
    rate = {r.language: (r.files, r.invalid) for r in syntax.rates(syntax.verdicts(df)).collect()}
    assert rate["python"] == (2, 1)
    assert syntax.verdicts(df.where("false")).count() == 0


@pytest.mark.parametrize(
    "doc, name, trivial",
    [
        (None, "f", True), ("", "f", True), ("-", "f", True), ("Gets a value.", "f", True), ("Loads the big table.", "loadBigTable", True), ("This method applies the big filter.", "apply_big_filter", True), ("The parse big rows function.", "parseBigRows", True), ("Loads the big table from the given disk.", "loadBigTable", False),
        ("TODO: write this down properly at last", "f", True), ("No description available yet.", "f", True), ("Add documentation for this function here.", "f", True), ("XXX fill in documentation", "f", True), ("TODO: speed up. Reads all rows of the table.", "f", False), ("Documentation of the build is read from disk.", "f", False),
        ("\n    Args:\n        a: the first of all given values\n    Returns:\n        what was read from the disk\n", "f", True), ("Reads rows.\n\n:param a: the first of all given values\n:return: result", "f", True), ("Reads all rows of it.\n\nArgs:\n    a: b", "f", False), ("# Errors\nFails when the file is not there.", "f", True), ("@param a the first of all values\n@returns nothing of any value", "f", True),
    ],
)
def test_trivial(doc, name, trivial):
    assert is_trivial(doc, name) is trivial, description(doc or "")
