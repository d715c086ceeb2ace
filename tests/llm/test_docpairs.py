from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import docpairs
from codeloom.llm.docpairs import pairs_of, telling


@pytest.mark.parametrize(("doc", "name", "params", "want"), [
    (None, "f", [], False), ("", "f", [], False), ("   ", "f", [], False), ("-----", "f", [], False), ("TODO", "f", [], False), ("TODO: describe", "f", [], False), ("tbd", "f", [], False), ("(no docs yet)", "f", [], False), ("À compléter", "f", [], False), ("n/a", "f", [], False), ("...", "f", [], False),
    ("Undocumented.", "f", [], False), ("// eslint-disable-next-line no-shadow", "f", [], False), ("// @ts-ignore", "f", [], False), ("# noqa: E501", "f", [], False), ("// ReSharper disable once X", "f", [], False),
    ("Refreshes the cache.", "refresh_cache", [], False), ("This function will refresh cache", "refreshCache", [], False), ("Method to verify the barge", "VerifyBarge", [], False), ("Verifies barges", "verifyBarge", [], False),
    ("Refreshes the cache once a night.", "refresh_cache", [], True), ("O(n) in the number of rows.", "f", [], True), ("Der Speicher wird geleert.", "f", [], True), ("Очередь пуста.", "f", [], True),
    ("@param a\n@param b b", "f", ["a", "b"], False), ("@param a the limit in seconds", "f", ["a"], True), ("Args:\n    a: the a\n    b:", "f", ["a", "b"], False), ("Args:\n    a: how many rows to skip", "f", ["a"], True),
    ('/// <summary></summary>\n/// <param name="a">a</param>', "f", ["a"], False), ('/// <summary>F</summary>\n/// <param name="a">rows to skip</param>', "f", ["a"], True), (":param a: a", "f", ["a"], False), ("/** <inheritdoc/> */", "f", [], False), ("FIXME add docs\n\nArgs:\n  x: rows that were seen", "f", ["x"], True),
])
def test_telling(doc, name, params, want):
    assert telling(doc, name, params) is want


TS = """// header of the file

/** Waits for the queue to drain. */
export async function first(a: string): Promise<void> {}

/** Not right above. */

function second() {}
// Keeps the oldest entries.
// They are read once.
const third = async (a) => a;
class A {
  /** Built once per process. */
  constructor() {}
  /** Rows are sorted by time. */
  get prop() { return 1; }
  /** Rows are sorted by time. */
  @Traced('x')
  static async #fourth(x) { const s = `/** no */ function g() {}`; }
  /** Rows are sorted by time. */
  field = 3;
  foo() {} // trailing words about this
  bar() {}
}
/** TODO */
function fifth() { /** Inner one drops nulls. */ }
"""
CS = """namespace A;
public class C
{
    /// <summary>Holds the lock while it writes.</summary>
    [Route("x")]
    public static async Task<int> First(int a) => a;
    /** Starts empty. */
    public C() { }
    // Never null after start.
    public int P { get; set; }
    void Second()
    {
        // Counts what is left over.
        int Local(int x) { return x; }
    }
}
interface I
{
    /// <summary>Has no body but words.</summary>
    void Third();
}
"""
PY = '''class A:
    @property
    def p(self):
        """Always sorted by time."""
    @dec
    async def first(self, *a):
        """Reads ahead by one page."""
        def second():
            "Drops what was seen before."
    def __init__(self):
        """Opens nothing yet."""
x = """
def third():
    'no'
"""
'''


def test_pairs():
    assert [(p[0], p[2]) for p in pairs_of(TS, "typescript") if p[5] == 0] == [("first", 4), ("third", 11), ("fourth", 19)]
    assert [(p[0], p[2]) for p in pairs_of(CS, "c_sharp") if p[5] == 0] == [("First", 6), ("Local", 14)]
    assert [(p[0], p[2]) for p in pairs_of(PY, "python") if p[5] == 0] == [("first", 6), ("second", 8), ("__init__", 10)]
    assert pairs_of(TS + "}", "typescript") == [] and pairs_of("", "python") == [] and pairs_of("def (", "python") == []


BETWEEN = """
function take(crate) { return crate; }
/**
 * Moves the load to another ramp.
 * @param ramp where to
 * @param load what is moved
 */

function move(ramp, load) { return load; }
/**
 * Adds what was weighed twice.
 * @param first the one side
 * @param second the other
 */
function plain() { return 1; }
function add(first, second) { return first; }
function count(items) {
  // Counts only what is sealed.
  return items.length;
}
"""


def test_assignment():
    got = {p[0]: (p[2], p[5]) for p in pairs_of(BETWEEN, "javascript")}
    assert got == {"move": (9, 1), "add": (16, 1), "count": (17, -1)}  # detached; tags that name the next one's parameters beat distance; within the body
    a = docpairs.score("@param x the one\n@param y the other", "f", ["x", "y"], 10)
    assert a == 16 and docpairs.score("@param x the one", "f", ["z"], 10) == 7 and docpairs.score("What f does", "f", [], 10) == 11


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 4), st.integers(0, 4)), st.integers(1, 20), max_size=12))
def test_best_links(scores):
    got = docpairs.best_links(scores)
    assert len(set(got.values())) == len(got) and all((a, b) in scores for a, b in got.items())
    left = sorted({a for a, _ in scores})

    def most(k, used):
        if k == len(left):
            return 0
        return max([most(k + 1, used), *(s + most(k + 1, used | {b}) for (a, b), s in scores.items() if a == left[k] and b not in used)])

    assert sum(scores[x] for x in got.items()) == most(0, frozenset())


def test_found(spark):
    docs = spark.createDataFrame([(1, PY, "f1"), (1, PY, "f1"), (2, None, "f1"), (3, "", "f1")], "doc_id long, text string, file_id string")
    files = spark.createDataFrame([("f1", "a.py")], "file_id string, path string")
    ps = spark.createDataFrame([("f9", "#go", "Method", 3, ["a"], "Stops at the first error."), ("f9", "go", "class", 3, None, "Stops at the first error."), (None, "go", "method", 3, None, "Stops at once."), ("f9", "go", "function", 4, None, "Go."), ("f9", "go", "function", None, None, "Stops at once.")], "file_id string, name string, kind string, line_start int, parameters array<string>, docstring string")
    got = {tuple(r) for r in docpairs.p1_found(docs, files, ps).collect()}
    assert got == {("documents", "1", "first", 6), ("documents", "1", "second", 8), ("documents", "1", "__init__", 10), ("parsed_symbols", "f9", "go", 3), ("parsed_symbols", "f9", "go", None)}
