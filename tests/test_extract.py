import os
import re

from pyspark.sql import types as T

from codeloom.operators import extract as X

GOLDEN = os.path.join(os.path.dirname(__file__), "golden", "sample_module.py")


def _golden():
    with open(GOLDEN, encoding="utf-8") as f:
        return f.read()


def _record(spark, path, text):
    """The File record of one file, as nested dicts."""
    row = X.extract_metadata(spark.createDataFrame([(path, text)], "path string, content string")).collect()[0]
    return row.asDict(recursive=True)


def _functions(spark, path, text):
    """The X10 / C1 rows of one file, in order."""
    rows = X.extract_function_paths(spark.createDataFrame([(path, text)], "path string, content string")).collect()
    return sorted((r.asDict() for r in rows), key=lambda r: r["func_no"])


def _fn(rec, name):
    return next(f for f in rec["functions"] if f["name"] == name)


def test_top_level_functions_in_order_sync_only(spark):
    rec = _record(spark, "pkg/sample_module.py", _golden())
    assert rec["error"] is None
    assert [f["name"] for f in rec["functions"]] == [
        "outer", "long_signature", "either", "pick", "inferred", "nothing", "modern", "one_liner",
    ]


def test_parameters_and_annotation_text(spark):
    rec = _record(spark, "p.py", _golden())
    pick = _fn(rec, "pick")
    assert pick["parameters"] == [{"name": "items", "type": "List[T]"}, {"name": "pred", "type": "Callable[Tuple[List, bool]]"}]
    assert pick["return_types"] == ["Optional[T]"]
    modern = _fn(rec, "modern")
    # `int | None` is emitted as source text, not an object repr
    assert modern["parameters"] == [{"name": "x", "type": "int | None"}, {"name": "y", "type": "Point"}]
    assert modern["return_types"] == ["dict[Tuple[str, int]]"]


def test_union_and_tuple_quirks(spark):
    rec = _record(spark, "p.py", _golden())
    assert _fn(rec, "either")["return_types"] == ["Tuple[str", "List[str]]"]
    assert _fn(rec, "long_signature")["return_types"] == ["Tuple[Tuple[int, str]]"]


def test_inferred_return_types_sorted_and_default_none(spark):
    rec = _record(spark, "p.py", _golden())
    assert _fn(rec, "inferred")["return_types"] == ["NoneType", "int", "x"]
    assert _fn(rec, "nothing")["return_types"] == ["None"]
    assert _fn(rec, "one_liner")["return_types"] == ["v"]


def test_bodies_multiline_signature_leak_nested_function_and_one_liner(spark):
    rec = _record(spark, "p.py", _golden())
    assert _fn(rec, "outer")["body"].startswith("def inner(c):")
    assert _fn(rec, "long_signature")["body"].startswith("first: int,")
    assert _fn(rec, "one_liner")["body"] == ""


def test_classes_fields_methods_nested_ignored(spark):
    rec = _record(spark, "p.py", _golden())
    assert [c["name"] for c in rec["classes"]] == ["Point", "Box"]
    point = rec["classes"][0]
    assert point["fields"] == [
        {"name": "x", "type": "float"}, {"name": "y", "type": "float"},
        {"name": "label", "type": "Optional[str]"}, {"name": "tags", "type": "List[str]"},
    ]
    assert [m["function"]["name"] for m in point["methods"]] == ["norm"]
    assert {m["reciever"] for m in point["methods"]} == {"Point"}
    box = rec["classes"][1]
    assert box["fields"] == [{"name": "item", "type": "T"}, {"name": "lookup", "type": "Dict[Tuple[str, List[int]]]"}]
    put = box["methods"][0]["function"]
    assert put["parameters"] == [{"name": "self", "type": "Any"}, {"name": "item", "type": "T"}]
    assert put["return_types"] == ["Box[T]"]


def test_interfaces_by_base_and_by_decorator(spark):
    rec = _record(spark, "p.py", _golden())
    assert [(i["name"], [m["name"] for m in i["methods"]]) for i in rec["interfaces"]] == [
        ("Shape", ["area", "describe"]), ("Walker", ["walk"]), ("Marked", ["mark"]),
    ]


def test_parse_error_gives_empty_record(spark):
    rec = _record(spark, "bad.py", "def broken(:\n    pass\n")
    assert rec["error"] and rec["functions"] == [] and rec["classes"] == [] and rec["interfaces"] == []


def test_crlf_is_universal_newline(spark):
    rec = _record(spark, "w.py", "def f(a):\r\n    x = 1\r\n    return a\r\n")
    assert rec["functions"][0]["body"] == "x = 1\n    return a"


def test_all_functions_preorder_includes_nested_and_async(spark):
    rows = _functions(spark, "p.py", _golden())
    names = [r["name"] for r in rows]
    assert names == [
        "area", "describe", "walk", "mark", "norm", "fetch", "hidden", "put", "get", "outer", "inner",
        "long_signature", "either", "pick", "inferred", "nothing", "modern", "one_liner", "not_collected",
    ]
    ls = next(r for r in rows if r["name"] == "long_signature")
    assert ls["params_text"] == "(\n    first: int,\n    second: str,\n)"
    assert ls["returns_text"] == "Tuple[int, str]"


def _labels(rows, name):
    r = next(r for r in rows if r["name"] == name)
    return [[tuple(r["branches"][n]) for n in p["steps"]] for p in r["paths"]]


def test_paths_if_elif_loop_return(spark):
    rows = _functions(spark, "p.py", _golden())
    assert _labels(rows, "pick") == [
        [("for_statement", "body", "it in items"), ("if_statement", "then", "pred(it)"), ("return", "", "it")],
        [("return", "", "None")],
    ]
    assert _labels(rows, "inferred") == [
        [("if_statement", "then", "x"), ("return", "", "x")],
        [("if_statement", "else", "x"), ("if_statement", "then", "x is None"), ("return", "", "None")],
        [("return", "", "3")],
    ]
    # straight-line code without returns has no labelled path
    assert _labels(rows, "nothing") == []


def test_paths_try_except_finally(spark):
    src = (
        "def g(x):\n    try:\n        y = x()\n    except ValueError:\n        return 1\n    except (KeyError, OSError):\n"
        "        pass\n    finally:\n        x.close()\n    while x:\n        x = x - 1\n"
    )
    rows = _functions(spark, "t.py", src)
    got = _labels(rows, "g")
    assert got == [
        [("try_statement", "try", "")],
        [("try_statement", "except", ""), ("except_clause", "except", "ValueError"), ("return", "", "1")],
        [("try_statement", "except", ""), ("except_clause", "except", "(KeyError, OSError)")],
        [("try_statement", "finally", ""), ("finally", "finally", "")],
        [("while_statement", "body", "x")],
    ]


def test_extract_metadata_job_matches_helper(spark):
    df = spark.createDataFrame([("pkg/sample_module.py", _golden()), ("pkg/__init__.py", "x = 1\n"), ("bad.py", "def (:\n")], "path string, content string")
    meta = {r["path"]: r for r in X.extract_metadata(df).collect()}
    assert meta["pkg/sample_module.py"]["module"] == "pkg.sample_module"
    assert meta["pkg/__init__.py"]["module"] == "pkg"
    assert meta["bad.py"]["error"] is not None and meta["bad.py"]["functions"] == []
    names = [f["name"] for f in meta["pkg/sample_module.py"]["functions"]]
    assert names == [f["name"] for f in _record(spark, "x", _golden())["functions"]]


def test_binary_content_decodes_strictly(spark):
    df = spark.createDataFrame([("a.py", bytearray(b"def f():\n    return 1\n")), ("b.py", bytearray(b"\xff\xfe\x00"))], "path string, content binary")
    meta = {r["path"]: r for r in X.extract_metadata(df).collect()}
    assert meta["a.py"]["functions"][0]["name"] == "f"
    assert meta["b.py"]["error"].startswith("UnicodeDecodeError")


def test_long_functions_and_deep_chains_are_whole(spark):
    flat = "def f(x):\n" + "    y = 1\n" * 20_000 + "    if x:\n        return 1\n"
    got = _functions(spark, "f.py", flat)
    assert _labels(got, "f") == [[("if_statement", "then", "x"), ("return", "", "1")]]
    arms = 2_000
    chain = "def g(x):\n    if x == 0:\n        return 0\n" + "".join(f"    elif x == {i}:\n        return {i}\n" for i in range(1, arms))
    assert _record(spark, "g.py", chain)["error"] is None
    paths = _labels(_functions(spark, "g.py", chain), "g")
    assert [p[-1] for p in paths] == [("return", "", str(i)) for i in range(arms)]
    assert [len(p) for p in paths] == list(range(2, arms + 2))
    assert paths[2][:-1] == [("if_statement", "else", "x == 0"), ("if_statement", "else", "x == 1"), ("if_statement", "then", "x == 2")]


def test_paths_of_nested_functions_and_loop_else(spark):
    src = (
        "def f(x):\n    for a in x:\n        def g(y):\n            if y:\n                return a\n        y = 1\n"
        "    else:\n        def h():\n            return 2\n        return 3\n    with x:\n        while x:\n            pass\n"
        "    match x:\n        case 1:\n            return 4\n        case _:\n            return 4\n"
    )
    rows = _functions(spark, "n.py", src)
    assert [r["name"] for r in rows] == ["f", "g", "h"]
    over = ("for_statement", "body", "a in x")
    assert _labels(rows, "f") == [
        [over, ("if_statement", "then", "y"), ("return", "", "a")], [over], [("while_statement", "body", "x")], [("return", "", "4")],
    ]
    assert _labels(rows, "g") == [[("if_statement", "then", "y"), ("return", "", "a")]]
    assert _labels(rows, "h") == [[("return", "", "2")]]
    assert _fn(_record(spark, "n.py", src), "f")["return_types"] == ["a", "int"]


def test_annotation_text_and_interfaces(spark):
    src = (
        "import abc\nclass A(abc.ABC):\n    x: a.b.C[d, 'E'] = 1\n    if 1:\n        z: int\n    async def s(self): ...\n    def m(self, k: [int], *r, n: int) -> {}: ...\n"
        "class B(Base[int]):\n    @abc.abstractmethod\n    def m(self): ...\nclass C:\n    y: a.b.C[d, 'E'] = 1\n    if 1:\n        z: int\n"
    )
    rec = _record(spark, "a.py", src)
    assert [i["name"] for i in rec["interfaces"]] == ["A"] and [c["name"] for c in rec["classes"]] == ["B", "C"]
    m = rec["interfaces"][0]["methods"]
    assert [f["name"] for f in m] == ["m"] and m[0]["return_types"] == ["Dict"]
    assert m[0]["parameters"] == [{"name": "self", "type": "Any"}, {"name": "k", "type": "List"}]
    assert rec["classes"][1]["fields"] == [{"name": "y", "type": "a.b.C[Tuple[d, E]]"}]


def test_building_the_plan_runs_no_job(spark):
    df = spark.range(100).repartition(3).selectExpr("concat('p', id) AS path", "'x = 1' AS content").groupBy("path").agg({"content": "max"})
    spark.sparkContext.setJobGroup("plan-only", "")
    X.extract_corpus(df.toDF("path", "content"))
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plan-only")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_plain_annotations_are_not_unparsed(monkeypatch):
    import ast

    texts = ["int", "a.b.C", "Union[int, str]", "Dict[str, List[a.b]]", "'Fwd'", "None", "Callable[[int], str]", "f(x).y", "m[a][b]", "[int]", "{}", "()"]
    trees = [ast.parse(t, mode="eval").body for t in texts + ["int | None"]]
    expected = [ast.unparse(X._Spelling().visit(t)) for t in trees]
    unparse = ast.unparse
    monkeypatch.setattr(ast, "unparse", lambda node: unparse(node) if isinstance(node, ast.BinOp) else 1 / 0)
    assert [X.type_text(t) for t in trees] == expected


def test_slices_of_text_beyond_ascii():
    src = "def f(a: int = 'ä)', b=\"\"\"é(\"\"\",  # )\n      c=(1, [2])) -> 'ü':\n    if 'ß' == a: return 'ä' + b\n\n\ndef g(): return 1"
    f, g = X.outline("m.py", src)["scopes"]
    assert f["params_text"] == "(a: int = 'ä)', b=\"\"\"é(\"\"\",  # )\n      c=(1, [2]))" and f["returns_text"] == "'ü'"
    assert f["body"] == "c=(1, [2])) -> 'ü':\n    if 'ß' == a: return 'ä' + b" and g["body"] == "" and g["params_text"] == "()"
    assert [n["text"] for n in X.outline("m.py", src)["nodes"] if n["kind"]] == ["'ß' == a", "'ä' + b", "1"]


def test_no_cycle_collection_while_files_are_read():
    import gc

    import pyarrow as pa

    seen = []
    run = X._arrow_mapper(lambda p, c: [seen.append(gc.isenabled()) or {"path": p}], T.StructType([T.StructField("path", T.StringType())]))
    out = list(run(iter([pa.RecordBatch.from_pydict({"path": ["a", "b"], "content": ["", ""]})])))
    assert seen == [False, False] and gc.isenabled() and out[0].num_rows == 2


def test_functions_take_their_own_part_of_a_file(spark):
    """No function reads the arrays of the whole file; blocks of every kind keep their order, empty parts are empty arrays."""
    src = (
        "class A:\n    x: int\n    def m(self):\n        for i in y:\n            pass\n        else:\n            return 1\n"
        "def f():\n    if a:\n        def g():\n            return z\n        return 2\n    try:\n        pass\n    except E:\n        with w:\n            return q\n    finally:\n        pass\n"
        "class B: pass\ndef h(): 'text'\n"
    )
    df = X.extract_corpus(spark.createDataFrame([("m.py", src), ("n.py", "def broken(:"), ("o.py", "")], "path string, content string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"slice\((leaves|nodes|values)#\d+,", plan)
    rec = {r["path"]: r for r in df.collect()}
    assert [(p["name"], [[p["branches"][n]["text"] for n in x["steps"]] for x in p["paths"]]) for p in rec["m.py"]["fpaths"]] == [
        ("m", [["i in y"]]),
        ("f", [["a", "z"], ["a", "2"], [""], ["", "E", "q"], ["", ""]]),
        ("g", [["z"]]),
        ("h", []),
    ]
    assert [(f["name"], f["return_types"]) for f in rec["m.py"]["functions"]] == [("f", ["int", "q", "z"]), ("h", ["None"])]
    assert rec["n.py"]["fpaths"] == [] and rec["n.py"]["error"] and rec["o.py"]["functions"] == []


def test_plain_statements_take_no_call_of_their_own(monkeypatch):
    calls = []
    simple = X._Outline.simple
    monkeypatch.setattr(X._Outline, "simple", lambda self, st, at, cls: calls.append(type(st).__name__) or simple(self, st, at, cls))
    src = "x = 1\ndef f():\n" + "    g()\n" * 50 + "    return 1\nclass A:\n    y: int\n    def m(self):\n        while z:\n            g()\n        return 2\n"
    out = X.outline("m.py", src)
    assert calls == ["Return", "AnnAssign", "Return"]
    f, a, m = out["scopes"]
    assert (f["leaves_from"], f["leaves_to"], a["leaves_to"], m["leaves_to"]) == (1, 52, 55, 55)
    assert (a["members"], a["fields"], out["top"], out["values"]) == ([2], [{"name": "y", "type": "int"}], [0, 1], ["int", "int"])


PLAIN = '''# plain code
import os.path as p
from a.b import c, d as e

X = p.join("a#b", 'c', 1) + 2.5

@dec
@mod.dec(1, x)
def f(a: int, b:Union[int, a.B], c, d: Dict[str, List[x, y]]) -> Opt[T]:

    if a > 1 and b.c(d) is not None:  # why
        from m import n
        return n.g(a, h(1))
    elif a == "x":
        return a
    elif b:
        while not_yet(a):
            a -= 1
        return 3
    else:
        for i in a.b:
            return "s"
  # odd comment

    return

class A(Base, m.Protocol):
    x: int
    y: Map[str, Set[int]] = 3
    @abstractmethod
    def m(self):
        def inner():
            return None
        class In:
            z: str
        pass
    n = 1

class B():
    def go(self): 
        "text"
if X:
    def late() -> None:
        return x.y
else:
    return 1.5
'''


def _labelled(out):
    """An outline with the labels of its nodes in place of their numbers."""
    nodes = out["nodes"]
    label = lambda n: [(nodes[i]["kind"], nodes[i]["arm"], nodes[i]["text"]) for i in nodes[n]["chain"]]
    own = lambda s: s["base"] is not None and sorted(map(str, ((label(n), nodes[n]["mute"]) for n in range(s["base"], s["nodes_to"]))))
    scopes = [{k: v for k, v in s.items() if k not in ("root", "base", "nodes_to")} | {"at": label(s["root"]), "own": own(s)} for s in out["scopes"]]
    return out["error"], out["top"], scopes, [(label(n), nodes[n]["mute"]) for n in out["leaves"]], out["values"], len(nodes)


def test_plain_lines_are_read_without_a_syntax_tree(monkeypatch):
    """The same outline as from the tree, which is not built for them."""
    import ast

    fast = X.outline("m.py", PLAIN)
    monkeypatch.setattr(X._Outline, "read_lines", lambda self, text: False)
    assert _labelled(fast) == _labelled(X.outline("m.py", PLAIN))
    monkeypatch.undo()
    whole, parse = [], ast.parse
    monkeypatch.setattr(ast, "parse", lambda text, **kw: whole.append(text) or parse(text, **kw))
    assert X.outline("m.py", PLAIN)["error"] is None and PLAIN not in whole


def test_lines_that_are_not_plain_go_to_the_parser(monkeypatch):
    """Whatever is read by lines is what the parser takes, with the same outline; the rest keeps its result and error."""
    import random

    rnd, lines = random.Random(5), PLAIN.split("\n")
    bits = ["def ", "(", ")", ":", "\n", "    ", "return ", "else:", "x", "1", '"', "'", ".", ", ", " = ", "\\", "\t", "not ", "[", "]", "@", "#", "lambda", "é", "\0", ";"]
    sources = ["if a:\nb = 1\n", "else:\n    x\n", "def f():\n", "@d\n", "@d\nx = 1\n", "  x\n", "def f(a=1): return a\n", "x = (1,\n  2)\n", "a, b = 1, 2\n", "x = '''\nreturn 1\n'''\n",
               "def if():\n    pass\n", "x = 01\n", "f(a b)\n", "x = " + "9" * 5000, "x = " + "a+" * 30000 + "a", "x" + ".y" * 30000, "", "\n  \n", "x = 1\n        @d\ndef f():\n    pass\n"]
    sources.append("if a:\n    x\n" + "elif a:\n    x\n" * 200)
    sources.append("".join("    " * i + "if a:\n" for i in range(120)) + "    " * 120 + "x\n")
    for _ in range(3000):
        at = rnd.randrange(len(lines))
        text = "\n".join(lines[at : at + rnd.randint(1, 25)])
        for _ in range(rnd.randint(0, 2)):
            j = rnd.randrange(len(text) + 1)
            text = text[:j] + rnd.choice(bits) + text[j:] if rnd.random() < 0.6 else text[:j] + text[j + rnd.randint(1, 5) :]
        sources.append(text)
    now = [X.outline("m.py", s) for s in sources]
    o = X._Outline("")
    plain = [o.clear() or (s.isascii() and "\0" not in s and o.read_lines(s)) for s in sources]
    assert 100 < sum(plain) < len(sources)
    monkeypatch.setattr(X._Outline, "read_lines", lambda self, text: False)
    for s, n in zip(sources, now):
        assert _labelled(n) == _labelled(X.outline("m.py", s)), s


def test_long_lines_are_read_in_linear_time():
    import time

    start = time.perf_counter()
    for line in ("f(" + "a, " * 300000, "a" * 1000000 + "!", "x = " + "a + " * 300000, "def f(" + "a: B[c, d], " * 100000, "x = '" + "a" * 1000000, " " * 1000000 + "!", "f" * 10 + "(a)" * 300000 + "!"):
        assert not X._Outline.read_lines(X._Outline(""), line)
    assert time.perf_counter() - start < 20


def test_records_have_the_types_of_the_schema_without_a_cast(spark):
    from pyspark.sql import functions as F

    files = spark.createDataFrame([("m.py", PLAIN)], "path string, content string")
    df = X.extract_corpus(files)
    assert "cast(transform" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert {f.name: f.dataType.simpleString() for f in df.schema} == {f.name: f.dataType.simpleString() for f in X.S.FILE_META} | {
        "fpaths": T.ArrayType(X.FUNCTION_PATHS).simpleString()
    }
    row = df.union(df.select(*[F.col(f.name).cast(f.dataType) for f in X.S.FILE_META], F.col("fpaths").cast(T.ArrayType(X.FUNCTION_PATHS)))).collect()
    assert row[0] == row[1]
