import os
import tempfile

from pyspark.sql import types as T

from codeloom.operators import extract as X
from codeloom.operators import store as ST
from codeloom.sources import corpus as SRC


def _tree():
    root = tempfile.mkdtemp(prefix="codeloom-src-")
    files = {
        "pkg/a.py": "def f(x):\n    return x\n",
        "pkg/a_test.py": "def test_f():\n    pass\n",
        "pkg/b_test_case_1.py": "x = 1\n",
        "pkg/sub/c.py": "class C:\n    y: int\n",
        "pkg/notes.txt": "hello\n",
        "bad.py": None,
    }
    for rel, text in files.items():
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as fh:
            fh.write(b"\xff\xfe bad bytes" if text is None else text.encode())
    return root


def test_scan_and_read_source(spark):
    root = _tree()
    got = {r["path"] for r in SRC.scan_code(spark, root).collect()}
    assert got == {"pkg/a.py", "pkg/sub/c.py", "bad.py"}
    raw = SRC.read_source_binary(spark, root)
    meta = {r["path"]: r for r in X.extract_metadata(raw).collect()}
    assert meta["pkg/a.py"]["functions"][0]["name"] == "f" and meta["pkg/a.py"]["module"] == "pkg.a"
    assert meta["bad.py"]["error"] is not None


def test_json_round_trip_and_first_record(spark):
    out = tempfile.mkdtemp(prefix="codeloom-json-") + "/m"
    df = spark.createDataFrame([("a.py", "def f():\n    return 1\n")], "path string, content string")
    SRC.save_metadata_json(X.extract_metadata(df), out)
    back = SRC.load_metadata_json(spark, out).first()
    assert back["path"] == "a.py" and back["functions"][0]["return_types"] == ["int"]
    doc = tempfile.mkdtemp(prefix="codeloom-arr-") + "/arr.json"
    with open(doc, "w") as fh:
        fh.write('[{"path": "x.py", "module": "x", "classes": [], "interfaces": [], "functions": []},\n {"path": "y.py", "module": "y"}]')
    rows = SRC.load_metadata_json(spark, doc, multi_line=True)
    assert [r["path"] for r in rows.collect()] == ["x.py", "y.py"]


def test_create_class_and_schema(spark):
    loc = tempfile.mkdtemp(prefix="codeloom-cls-")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    ST.create_class(spark, "codeloom_test_class", schema, loc)
    assert [n for n, _ in ST.class_schema(spark, "codeloom_test_class")] == ["id", "name"]
    spark.sql("DROP TABLE IF EXISTS codeloom_test_class")


def test_documents_of_nested_records(spark):
    """Lists, structs, maps and nulls at any depth."""
    import json

    from codeloom.operators import store as ST

    schema = "id long, s struct<a:string,l:array<struct<x:int,y:string>>>, m map<int,array<double>>, n array<array<int>>, e struct<a:int>"
    rows = [(1, ("é\"\n", [(1, None), None]), {3: [0.5], 4: None}, [[1, 2], None], None), (2, None, None, None, (None,)), (3, (None, None), {}, [], (7,))]
    got = {r["id"]: json.loads(r["doc"]) for r in ST.documents(spark.createDataFrame(rows, schema), "id").collect()}
    assert got[1] == {"id": 1, "s": {"a": "é\"\n", "l": [{"x": 1, "y": None}, None]}, "m": {"3": [0.5], "4": []}, "n": [[1, 2], []], "e": None}
    assert got[2] == {"id": 2, "s": None, "m": {}, "n": [], "e": {"a": None}}
    assert got[3] == {"id": 3, "s": {"a": None, "l": []}, "m": {}, "n": [], "e": {"a": 7}}


def test_file_versions_in_any_order(spark):
    from itertools import permutations

    from codeloom.streaming import attempts_stream as RS

    rows = [("a.py", "def f():\n    pass\n", 1), ("a.py", "def g():\n    pass\n", 2), ("a.py", "def g():\n    pass\n", 2), ("b.py", "def broken(:\n", 5)]
    schema = "path string, content string, version long"
    for order in list(permutations(range(4)))[::8]:
        d = RS._scratch(spark, "t-versions")
        for i in order:
            spark.createDataFrame([rows[i]], schema).coalesce(1).write.mode("append").parquet(d)
        out = {r["path"]: r for r in RS.stream_file_versions(spark, d, spark.createDataFrame([], schema).schema).collect()}
        assert set(out) == {"a.py", "b.py"} and out["a.py"]["version"] == 2 and out["b.py"]["error"]
        assert [f["name"] for f in out["a.py"]["functions"]] == ["g"]


def test_files_of_one_delivery_are_parsed_by_several_tasks(spark, tmp_path):
    """One large source file of a micro-batch must not be parsed by one task."""
    from codeloom.streaming import attempts_stream as RS

    rows = [(f"d/m{i}.py", f"def f{i}():\n    pass\n", 1) for i in range(64)]
    df = spark.createDataFrame(rows, "path string, content string, version long").coalesce(1)
    df.select("path", "content").write.parquet(str(tmp_path / "code"))
    df.write.parquet(str(tmp_path / "versions"))
    new = RS.stream_code_files(spark, str(tmp_path / "code"), df.select("path", "content").schema)
    assert new.count() == 64 and len(new.inputFiles()) > 1
    again = RS.stream_file_versions(spark, str(tmp_path / "versions"), df.schema)
    assert again.count() == 64
