import random

from pyspark.sql import functions as F

from codeloom.operators import extract as X
from codeloom.operators import graph as G
from codeloom.sources import corpus as SRC

ALPHABET = ["a", "b", "_", "1", "é", "(", ")", ".", " ", "\n", "x", "(", "ß"]


def _rand_body(rng, n):
    return "".join(rng.choice(ALPHABET) for _ in range(n))


def test_call_names_equal_brute_force_contains(spark):
    rng = random.Random(7)
    bodies = [_rand_body(rng, rng.randint(0, 40)) for _ in range(300)]
    names = sorted({"a", "b", "ab", "_a", "a1", "x", "é", "ßx", "bé", "a_b", "xa"})  # valid identifiers only
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    got = {r["i"]: set(r["n"]) for r in df.select("i", G.call_names(F.col("body")).alias("n")).collect()}
    gotm = {r["i"]: set(r["n"]) for r in df.select("i", G.method_call_names(F.col("body")).alias("n")).collect()}
    for i, b in enumerate(bodies):
        assert {n for n in names if n + "(" in b} == got[i] & set(names), b
        assert {n for n in names if "." + n + "(" in b} == gotm[i] & set(names), b


def test_extends_equals_brute_force_contains(spark):
    """Class names of one character and more, with letters beyond ASCII, against paths of one directory each."""
    rng = random.Random(4)
    names = ["A", "Ab", "Abc", "AbcA", "bcA", "é", "éA", "AbAb", "c_1", "_"]
    rows = []
    for i in range(60):
        path = rng.choice(["d", "e/Abc"]) + "/" + "".join(rng.choice(["A", "b", "c", "é", "_", "1"]) for _ in range(rng.randint(1, 8))) + f"{i}.py"
        rows.append((path, [rng.choice(names) for _ in range(rng.randint(0, 3))]))
    meta = spark.createDataFrame([(p, [(c,) for c in cs]) for p, cs in rows], "path string, classes array<struct<name:string>>")
    got = sorted((r["source_file"], r["target_file"], r["source_element"], r["target_element"]) for r in G.extends_edges(meta).collect())
    place = lambda p: p.rsplit("/", 1)[0]
    want = sorted((p, q, c, d) for p, cs in rows for q, ds in rows if p != q and place(p) == place(q) for c in cs for d in ds if c != d and d in p)
    assert got == want and len(want) > 100


def _meta(spark, files):
    return X.extract_metadata(spark.createDataFrame(files, "path string, content string"))


def test_edges_rules(spark):
    files = [
        ("d/a.py", "def fa(x):\n    from b import fb, fc\n    import os, sys\n    return myfb(x) + fb(x) + obj.run(1) + K.go(2)\n"),
        ("d/b.py", "def fb(y):\n    return y\n\ndef fb(z):\n    return z\n\nclass K:\n    def go(self):\n        return 1\n"),
        ("d/K_user.py", "class Other:\n    def run(self):\n        return 0\n"),
        ("e/c.py", "def fb():\n    return 0\n"),
        ("d/broken.py", "def fb(:\n"),
        ("utils.py", "def u():\n    return 1\n"),
    ]
    meta = _meta(spark, files)
    paths = spark.createDataFrame([(p,) for p, _ in files], "path string")
    edges = {tuple(r) for r in G.dependency_edges(meta, paths).select("source_file", "target_file", "type", "source_element", "target_element").collect()}
    rows = G.dependency_edges(meta, paths).collect()
    # two functions named fb in b.py -> two edges (bag semantics); 'myfb(' also matches fb
    assert sum(1 for r in rows if r["type"] == "uses" and r["target_element"] == "fb" and r["target_file"] == "d/b.py") == 2
    assert ("d/a.py", "d/b.py", "uses", "fa", "K.go") in edges
    assert ("d/a.py", "d/K_user.py", "uses", "fa", "Other.run") in edges
    # no edge into another directory or into a broken file
    assert not any(e[1] in ("e/c.py", "d/broken.py") and e[2] == "uses" for e in edges)
    # imports: resolved in the same directory, else literal module + '.py'
    assert ("d/a.py", "d/b.py", "import", "fa", "fb") in edges and ("d/a.py", "d/b.py", "import", "fa", "fc") in edges
    assert ("d/a.py", "os.py", "import", "fa", "") in edges and ("d/a.py", "sys.py", "import", "fa", "") in edges
    # extends: the path d/K_user.py contains the class name K of d/b.py
    assert ("d/K_user.py", "d/b.py", "extends", "Other", "K") in edges


def test_import_modes_and_parent_resolution(spark):
    files = [
        ("r/s/a.py", "def f():\n    important = 1\n    from   helper   import  x,y ,z\n"),
        ("r/helper.py", "X = 1\n"),
    ]
    meta = _meta(spark, files)
    paths = spark.createDataFrame([(p,) for p, _ in files], "path string")
    tok = {(r["target_file"], r["target_element"]) for r in G.import_edges(meta, paths, "token").collect()}
    assert tok == {("r/helper.py", "x"), ("r/helper.py", "y"), ("r/helper.py", "z")}
    pre = {(r["target_file"], r["target_element"]) for r in G.import_edges(meta, paths, "prefix").collect()}
    assert ("=.py", "") in pre and ("1.py", "") in pre


def test_file_tree_and_rollup(spark):
    paths = spark.createDataFrame([("a/b/c.py",), ("a/b/d/e.txt",), ("a/f",), (".git/x/y",)], "path string")
    nodes = {r["path"]: (r["parent_path"], r["file_type"], r["depth"]) for r in SRC.file_tree(paths).collect()}
    assert nodes["a"] == ("", "dir", 0) and nodes["a/b/d"] == ("a/b", "dir", 2)
    assert nodes["a/b/c.py"][1] == "py" and nodes["a/f"][1] == "file" and nodes["a/b/d/e.txt"][1] == "txt"
    roll = {r["module_path"]: (r["n_files"], r["n_direct_files"], r["n_submodules"]) for r in G.module_rollup(paths).collect()}
    assert roll["a"] == (3, 1, 2) and roll["a/b"] == (2, 1, 1) and roll["a/b/d"] == (1, 1, 0)
    kept = {r["path"] for r in SRC.skip_hidden(paths).collect()}
    assert ".git/x/y" not in kept and "a/f" in kept


def test_fan_in_and_endpoints(spark):
    e = spark.createDataFrame(
        [("a", "b", "uses", "f", "g", 0.7), ("c", "b", "import", "h", "", 1.0), ("a", "zz.py", "import", "f", "", 1.0)],
        "source_file string, target_file string, type string, source_element string, target_element string, weight double",
    )
    fi = {r["target_file"]: (r["n_edges"], r["n_dependents"], r["weight_sum"]) for r in G.fan_in(e).collect()}
    assert fi["b"] == (2, 2, 1.7)
    nodes = SRC.file_tree(spark.createDataFrame([("a",), ("b",), ("c",)], "path string"))
    kept = G.edge_endpoints(e, nodes)
    assert kept.count() == 2
    assert {tuple(r) for r in G.adjacency(kept).collect()} == {("a", "b", 1), ("c", "b", 1)}


def test_fan_counts_equal_the_edges(spark):
    rng = random.Random(8)
    files = []
    for i in range(40):
        names = [rng.choice("abcd") for _ in range(rng.randint(0, 3))]
        text = "".join(f"def {n}(x):\n    import os, f1\n    return {rng.choice('abcd')}(x) + o.{rng.choice('rs')}(1)\n\n" for n in names)
        if rng.random() < 0.5:
            text += f"class F{i % 7}:\n" + "".join(f"    def {m}(self):\n        return a(1)\n" for m in rng.sample("rst", 2))
        files.append((f"{rng.choice('de')}/F{i}.py", text))
    meta = _meta(spark, files)
    paths = spark.createDataFrame([(p,) for p, _ in files], "path string")
    want = {}
    for e in G.dependency_edges(meta, paths).collect():
        for path, k in ((e["target_file"], 0), (e["source_file"], 1)):
            want.setdefault(path, [0, 0, 0.0, 0.0])
            want[path][k] += 1
            want[path][k + 2] = round(want[path][k + 2] + e["weight"], 6)
    assert {r["path"]: [r["n_in"], r["n_out"], r["w_in"], r["w_out"]] for r in G.fan_counts(meta, paths).collect()} == want


def test_fan_counts_of_a_name_shared_by_a_directory(spark):
    """3,000 files of one directory all define and call one name: nine million edges, counted from 6,000 rows."""
    calls = spark.range(3000).select(F.concat(F.lit("d/m"), "id", F.lit(".py")).alias("path"), F.lit("d").alias("dir"), F.lit("run").alias("name"))
    out = G._shared_names(calls, calls, 0.7)
    assert out.agg(F.sum("n_in"), F.sum("n_out"), F.min("n_in"), F.max("n_in")).first()[:] == (3000 * 2999, 3000 * 2999, 2999, 2999)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_module_members_and_tree(spark):
    paths = spark.createDataFrame([(p,) for p in ("a/b/c/x.py", "a/b/y.py", "a/z.py", "top.py", "q/r/w.py")], "path string")
    got = {(r["module_path"], r["member"], r["kind"], r["distance"]) for r in G.module_members(paths).collect()}
    assert {g for g in got if g[0] == "a"} == {("a", "a/b/c/x.py", "file", 3), ("a", "a/b/y.py", "file", 2), ("a", "a/z.py", "file", 1), ("a", "a/b", "module", 1), ("a", "a/b/c", "module", 2)}
    assert ("q", "q/r", "module", 1) in got and not any("top.py" in g for g in got)
    assert sorted(tuple(r) for r in G.modules(paths).collect()) == [("a", "", 0), ("a/b", "a", 1), ("a/b/c", "a/b", 2), ("q", "", 0), ("q/r", "q", 1)]
    roll = {r["module_path"]: (r["n_files"], r["n_direct_files"], r["n_submodules"]) for r in G.module_rollup(paths).collect()}
    assert roll == {"a": (3, 1, 2), "a/b": (2, 1, 1), "a/b/c": (1, 1, 0), "q": (1, 0, 1), "q/r": (1, 1, 0)}


def test_edges_of_written_tokens(spark):
    """The written token stream gives the edges of the rules run one by one, in both import modes, from one reading of the bodies."""
    rng = random.Random(3)
    lines = ["import os, f1", "from f2 import a, b", "  from g import  x,y ,z", "importlib.go(1)", "from . import q", "import f3 as t", "return a(1) + o.r(b(2))", "x = 'import'", "import"]
    files = []
    for i in range(30):
        bodies = [[t for t in rng.sample(lines, 4)] for _ in range(rng.randint(0, 3))]
        text = "".join(f"def {rng.choice('abc')}(x):\n    '''\n" + "".join(f"    {t}\n" for t in b) + "    '''\n    return x\n\n" for b in bodies)
        if i % 3 == 0:
            text += f"class f{i % 4}:\n    def r(self):\n        return a(1)\n"
        files.append((f"{rng.choice(['d', 'd/e'])}/f{i}.py", text))
    files += [("top.py", "def a(x):\n    import f1\n    return x\n"), ("d/broken.py", "def a(:\n"), ("d/empty.py", "")]
    meta = _meta(spark, files)
    paths = spark.createDataFrame([(p,) for p, _ in files], "path string")
    for mode in ("token", "prefix"):
        tokens = G.body_tokens(meta, mode)
        want = sorted(tuple(r) for r in G.dependency_edges(meta, paths, mode).collect())
        assert sorted(tuple(r) for r in G.edges_of_tokens(tokens, meta, paths).collect()) == want
        assert {w[2] for w in want} == {"import", "uses", "extends"}
    assert G.body_tokens(meta)._jdf.queryExecution().executedPlan().toString().count("Generate inline") == 2  # of functions, of tokens
    assert G.body_tokens(meta.limit(0)).count() == 0


def test_fan_counts_from_written_tokens(spark):
    """The counts of the token stream are those of the bodies, in both import modes; no body is read."""
    files = [(f"d{i % 2}/f{i}.py", f"def a{i % 3}(x):\n    import os, f1\n    from f{i % 4} import a0\n    importlib.go(1)\n    return a{i % 2}(1) + o.r(2)\n") for i in range(8)]
    files += [("d0/c.py", "class f2:\n    def r(self):\n        return a0(1)\n"), ("d0/broken.py", "def a(:\n"), ("empty.py", "")]
    meta = _meta(spark, files)
    paths = spark.createDataFrame([(p,) for p, _ in files], "path string")
    for mode in ("token", "prefix"):
        want = sorted(tuple(r) for r in G.fan_counts(meta, paths, mode).collect())
        got = G.fan_counts(meta, paths, mode, tokens=spark.createDataFrame(G.body_tokens(meta, mode).collect()))
        assert sorted(tuple(r) for r in got.collect()) == want and want
        assert "regexp_extract_all" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_long_identifier_runs_are_read_once(spark):
    """A run of identifier characters that no parenthesis follows costs its length, not its square."""
    import time

    run = "a1" * 100_000
    df = spark.createDataFrame([("x = b'" + run + "'\n9f_2(é.g_(0), 12(" + "f(1)",)], "body string").repartition(1)
    start = time.time()
    assert df.select(G.call_names(F.col("body")).alias("n")).collect()[0]["n"] == ["f_2", "_2", "g_", "_", "f"]
    assert time.time() - start < 20


def test_edge_joins_are_not_broadcast(spark):
    """Exploded names are estimated by the few bytes of their columns; a broadcast of them ends the driver."""
    from codeloom.plans.context import materialize

    rows = [("d/a.py", "def fa(x):\n    from b import fb\n    o.go(1)\n    return fb(x)\n"), ("d/b.py", "def fb(y):\n    return y\n\nclass K:\n    def go(self):\n        return 1\n")]
    meta = materialize(_meta(spark, rows))
    paths = materialize(spark.createDataFrame([(p,) for p, _ in rows], "path string"))
    tokens = materialize(G.body_tokens(meta))
    edges = G.edges_of_tokens(tokens, meta, paths)
    nodes = SRC.file_tree(paths)
    for df in (edges, G.dependency_edges(meta, paths), G.edge_endpoints(materialize(edges), nodes), G.fan_counts(meta, paths, tokens=tokens)):
        assert df.count() > 0
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_import_lines_are_cut_by_one_expression(spark):
    """Within a lambda an expression named twice is evaluated twice: white space of an import line is looked for once."""
    from codeloom.functions.text import fields

    assert str(fields("t")).count("regexp_replace") == 1
    rows = ["", " ", "a", "  a   b　", "from  m\timport x,y , z", "\r\nimport\x0ba,\n"]
    got = [r["f"] for r in spark.createDataFrame([(i, t) for i, t in enumerate([*rows, None])], "i int, t string").orderBy("i").select(fields("t").alias("f")).collect()]
    assert got == [*(t.split() for t in rows), None]
    bodies = [" from m import a,b , c,\n\timport os, sys,\nfrom m\nimportant", "from x import (d)\n  from . import e"]
    src = spark.createDataFrame([(f"d/{i}.py", "d", "f", b) for i, b in enumerate(bodies)], "source_file string, dir string, source_element string, body string")
    want = [("m", "a"), ("m", "b"), ("m", "c"), ("os", ""), ("sys", ""), ("x", "(d)"), (".", "e")]
    for mode in ("token", "prefix"):
        assert sorted((r["module"], r["target_element"]) for r in G.import_rows(src, mode).collect()) == sorted(want)
