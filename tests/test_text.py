from pyspark.sql import functions as F

from codeloom.functions import text as TX
from codeloom.operators import extract as X


def _one(spark, col, **data):
    df = spark.createDataFrame([tuple(data.values())], ", ".join(f"{k} string" for k in data))
    return df.select(col.alias("r")).first()["r"]


def test_preprocess_trims_unicode_space(spark):
    assert _one(spark, TX.trim_ws("s"), s="\u2003\t code \u3000\n\x85") == "code"
    # U+200B is not white space for the trim rule
    assert _one(spark, TX.trim_ws("s"), s="\u200bx ") == "\u200bx"


def test_extract_python_rules(spark):
    ex = TX.extract_code("s")
    assert _one(spark, ex, s="Here:\n```python\nprint(1)\n```\n") == "print(1)"
    assert _one(spark, ex, s="```\nx = 1\n```") == "x = 1"
    # first block wins, even when a later one is tagged
    assert _one(spark, ex, s="```python\na\n```\n```java\nb\n```") == "a"
    # an empty block gives "", not the raw text
    assert _one(spark, ex, s="```python\n```tail") == ""
    assert _one(spark, ex, s="  no fences here \n") == "no fences here"
    # fence tag must be followed by a newline
    assert _one(spark, ex, s="```pythonx\ny\n```") == "```pythonx\ny\n```"


def test_extract_by_lang_quotes_the_tag(spark):
    assert _one(spark, TX.extract_code("s", "c++"), s="```c++\nint x;\n```") == "int x;"
    assert _one(spark, TX.extract_code("s", "java"), s="```python\na\n```") == "```python\na\n```"
    assert _one(spark, TX.extract_code_by_column("s", "l"), s="```c++\nint y;\n```", l="c++") == "int y;"
    assert _one(spark, TX.extract_code_by_column("s", "l"), s="```\nz\n```", l="") == "z"


def test_fill_template_is_sequential(spark):
    r = _one(spark, TX.fill_template("t", "c", "f"), t="{fileName}: {code}", c="uses {fileName}", f="a.py")
    assert r == "a.py: uses a.py"
    r = _one(spark, TX.sym_prompt("t", "p", "c", "f"), t="{path_constraints}|{code}|{file_name}", p="P", c="C {file_name}", f="F")
    assert r == "P|C F|F"


def test_feedback_prompt(spark):
    df = spark.createDataFrame([(0, None), (2, "rep")], "it int, r string")
    got = [r[0] for r in df.select(TX.feedback_prompt(F.lit("B"), "it", "r")).orderBy("it").collect()]
    assert got == ["B", "B\nYour code need to be improved, the report is following:\nrep\n"]


def test_paths_and_names(spark):
    rows = [("a/b/mod.py",), ("a/b/__init__.py",), ("top.py",), ("x/y.tar.gz",), ("z/.hidden",)]
    df = spark.createDataFrame(rows, "p string")
    got = df.select(
        "p", TX.detect_lang("p").alias("lang"), TX.test_path("p", TX.detect_lang("p")).alias("tp"),
        TX.module_name("p").alias("mod"), TX.ext_of("p").alias("ext"), TX.dir_of("p").alias("d"),
        TX.sym_test_name("p", F.lit("fn")).alias("sym"), TX.relative_path("p", "a").alias("rel"),
    ).collect()
    by = {r["p"]: r for r in got}
    assert by["a/b/mod.py"]["lang"] == "python" and by["a/b/mod.py"]["tp"] == "a/b/mod_test.py"
    assert by["a/b/mod.py"]["mod"] == "a.b.mod" and by["a/b/__init__.py"]["mod"] == "a.b" and by["top.py"]["mod"] == "top"
    assert by["x/y.tar.gz"]["ext"] == ".gz" and by["z/.hidden"]["ext"] == ".hidden"
    assert by["top.py"]["d"] == "." and by["top.py"]["sym"] == "top_fn_test_case_1.py"
    assert by["a/b/mod.py"]["sym"] == "a/b/mod_fn_test_case_1.py"
    assert by["a/b/mod.py"]["rel"] == "b/mod.py" and by["top.py"]["rel"] == "top.py"


def test_java_test_path(spark):
    assert _one(spark, TX.test_path("p", F.lit("java")), p="src/App.java") == "src/AppTest.java"
    assert _one(spark, TX.test_path("p", F.lit("cpp")), p="src/a.cpp") == "src/a.cpp"


def test_render_context_layout(spark):
    src = (
        "class C:\n    a: int\n\n    def m(self, x: int) -> str:\n        return ''\n\n"
        "class E:\n    pass\n\n"
        "class I(ABC):\n    def go(self):\n        pass\n\n"
        "def f(q: int):\n    return q\n"
    )
    meta = X.extract_metadata(spark.createDataFrame([("pkg/m.py", src)], "path string, content string"))
    text = meta.select(TX.render_context("path", "module", "classes", "interfaces", "functions")).first()[0]
    expected = (
        "You are analyzing a file named 'pkg/m.py' from the module 'pkg.m'.\n\n"
        "The file contains 2 classes:\n\n"
        "- Class 'C':\n  Fields:\n  - a: int\n\n  Methods:\n  - m(self: Any, x: int) -> str\n\n"
        "- Class 'E':\n  Fields:\n\n"
        "The file contains 1 interfaces:\n\n- Interface 'I':\n  Methods:\n  - go(self: Any) -> None\n\n"
        "The file contains 1 standalone functions:\n\n- f(q: int) -> q\n"
        "\nPlease analyze this code structure and provide insights or answer questions about it."
    )
    assert text == expected


# Go's unicode.IsSpace set (the same list as functions/text.py).
GO_SPACE = set("\t\n\x0b\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | {chr(c) for c in range(0x2000, 0x200B)}


def _go_trim(s):
    i, j = 0, len(s)
    while i < j and s[i] in GO_SPACE:
        i += 1
    while j > i and s[j - 1] in GO_SPACE:
        j -= 1
    return s[i:j]


def _go_fields(s):
    out, cur = [], []
    for ch in s:
        if ch in GO_SPACE:
            if cur:
                out.append("".join(cur))
                cur = []
        else:
            cur.append(ch)
    if cur:
        out.append("".join(cur))
    return out


def test_trim_and_fields_match_go_rules(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    alphabet = st.sampled_from(sorted(GO_SPACE) + list("ab,\u00e9\u200b\ufeffx"))
    samples = []

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=alphabet, max_size=12))
    def collect(s):
        samples.append(s)

    collect()
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    got = {r["i"]: (r["t"], list(r["f"])) for r in df.select("i", TX.trim_ws("s").alias("t"), TX.fields("s").alias("f")).collect()}
    for i, s in enumerate(samples):
        assert got[i] == (_go_trim(s), _go_fields(s)), repr(s)


def test_line_count(spark):
    for text in ("", "a", "a\n", "\n\n", "a\r\nb\nc"):
        assert _one(spark, TX.line_count("s"), s=text) == len(text.split("\n"))
    df = spark.createDataFrame([(None,)], "s string")
    assert df.select(TX.line_count("s").alias("r")).first()["r"] is None
