import pytest

from codeloom.llm import docpairs

WORDS = "Rebuilds the index from the files that changed."
CASES = {
    "python": f'class A:\n    """{WORDS}"""\n\n    def f(self, a: dict[str, int] = {{"x": 1}}):\n        """{WORDS}\n\n        :param a: x\n        """\n        # {WORDS}\n        return "def g(): pass"\n\n    async def h(self):\n        # {WORDS}\n        return 1\n\n    def k(self): "{WORDS}"\n',
    "javascript": f"/** {WORDS} */\nexport default class A extends B {{\n  /**\n   * {WORDS}\n   *\n   * @param a\n   */\n  async f(a, {{ b }}) {{\n    // {WORDS}\n    if (a) {{ g('h() {{') }}\n  }}\n\n  h() {{ return `k() {{}}` }}\n}}\n// {WORDS}\nconst k = async (x) => {{ y() }};\n",
    "go": f"// {WORDS}\nfunc (s *T) f(a int) (int, error) {{\n\t// {WORDS}\n\treturn g(func() {{}})\n}}\n\n// {WORDS}\n\nfunc h() {{}}\n\n/* {WORDS} */\nfunc k[T any](a T) {{}}\n",
    "java": f"/** {WORDS} */\npublic class A {{\n    /**\n     * {WORDS}\n     */\n    @Override\n    @X(a = 1)\n    public <T> List<T> f(final int a, String... b) throws E {{\n        int c = g(a);\n        return new B(c);\n    }}\n\n    int h(int a) {{\n        // {WORDS}\n        return 1; }}\n\n    // {WORDS}\n    abstract void k();\n}}\n",
    "rust": f"/// {WORDS}\n#[inline]\npub(crate) async fn f<'a>(a: &'a str) -> u32 {{ g(\"fn x()\") }}\n\nfn h() {{}}\n\n//! {WORDS}\nunsafe fn k() {{}}\n",
    "c": f"/**\n * {WORDS}\n */\nstatic const char *f(int a,\n    char b)\n{{\n    if (a) {{ return g(b); }}\n    return 0;\n}}\nint h(void)\n{{ return 1; }}\n// {WORDS}\nint k(int a) {{ return a; }}\n",
    "ruby": f"class A\n  # {WORDS}\n  # @param a\n  def f(a)\n    # {WORDS}\n    \"def g\"\n  end\n\n  def h; end\n\n  # {WORDS}\n  def self.k\n  end\nend\n",
}
CASES["typescript"] = CASES["javascript"].replace("async f(a, { b })", "private async f(a: string[], b?: Map<string, number>): Promise<void>")


@pytest.mark.parametrize("lang", CASES)
def test_islands(lang):
    names = [n for n, _, _, _ in docpairs.islands(CASES[lang], lang)]
    assert names == ["f", "h", "k"]
    got = {n: (d, c) for n, d, c, _ in docpairs.pairs(CASES[lang], lang, "class")}
    assert set(got) == {"f", "k"} and all(WORDS in d for d, _ in got.values())


@pytest.mark.parametrize("doc", ["", None, "TODO", "FIXME: later", "...", "xxx", "Helper.", "Internal.", "Method foldCell.", "The fold cell function.", "Folds the cell.", "fold_cell()", "x = fold_cell(a, 3)", "@param a\n@return", "{@inheritDoc}", "noqa: C901", "pylint: disable=a-b", "eslint-disable-next-line no-undef", "@ts-ignore", "rubocop:disable Metrics/MethodLength", "Copyright the authors. See LICENSE.", "==========", "<summary></summary>", "N/A", "(none)", "write me"])
def test_no_description(doc):
    assert docpairs.description(doc, "foldCell") is None


@pytest.mark.parametrize("doc", [WORDS, "O(n) in the number of open folders.", "Safe to call twice; later calls do nothing.", "Prüft die Reihenfolge und bricht bei token ab.", "Units are milliseconds, negative means forever.", f"Copyright the authors.\n{WORDS}", f"@param a the a\n\n{WORDS}"])
def test_description(doc):
    assert docpairs.description(doc, "foldCell")


def test_operator(spark):
    py = f'def f(a):\n    """TODO"""\n    return a\n'
    rows = [
        ("1", "python", "a.py", "function", "f", py, WORDS), ("1", "python", "a.py", "function", "f", py, WORDS), ("2", None, "a.go", "method", None, f"// {WORDS}\nfunc g() {{}}", None), ("3", "python", "a.py", "class", "C", CASES["python"], WORDS),
        ("4", "python", "a.py", "module", "m", py, WORDS), ("5", "python", "a.py", "function", "f", None, WORDS), ("6", "java", "A.java", "method", "m", "", WORDS), (None, "python", "a.py", "function", "f", py, WORDS), ("7", "python", "a.py", "function", None, "x = 1\n" * 50_000, None),
    ]
    chunks = spark.createDataFrame(rows, "id string, language string, file_path string, chunk_type string, name string, content string, docstring string").selectExpr("*", "'x' AS description", "1 AS code")
    assert sorted(map(tuple, docpairs.names(chunks).collect())) == [("1", "f"), ("2", "g"), ("3", "f"), ("3", "k"), ("6", "m")]
    assert docpairs.names(chunks.limit(0)).count() == 0
