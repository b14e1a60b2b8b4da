"""Registered queries: one per operator of the inventory.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame with flat,
aliased columns (integers as BIGINT) so that it can be compared with the
DuckDB oracle of the same name (``codeloom.plans.oracle``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as TX
from codeloom.operators import extract as X
from codeloom.operators import graph as G
from codeloom.operators import attempts as AT
from codeloom.operators import store as ST
from codeloom.operators import cover as CV
from codeloom.operators import generate as GN
from codeloom.streaming import attempts_stream as RS
from codeloom.plans import context as C
from codeloom.sources import corpus as SRC
from codeloom.sources import fixtures as FX

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn

    return deco


def _long(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# --------------------------------------------------------------------------- extraction


@query("py_metadata")
def q_py_metadata(spark, sf):
    """One row per file with symbol counts."""
    m = C.meta(spark, sf)
    return m.select(
        "path", "module", _long(F.size("classes")).alias("n_classes"), _long(F.size("interfaces")).alias("n_interfaces"),
        _long(F.size("functions")).alias("n_functions"), F.col("error").isNotNull().alias("broken"),
    )


@query("py_parse_errors")
def q_py_parse_errors(spark, sf):
    """Files that do not parse still give a row, with empty arrays."""
    m = C.meta(spark, sf)
    return m.where(F.col("error").isNotNull()).select(
        "path", _long(F.size("functions") + F.size("classes") + F.size("interfaces")).alias("n_symbols")
    )


@query("py_functions")
def q_py_functions(spark, sf):
    """X3 + X9: top-level functions with parameter count, return types, body."""
    f = X.functions_of(C.meta(spark, sf))
    return f.select(
        "path", "func_no", "name", _long(F.size("parameters")).alias("n_params"),
        F.array_join("return_types", "|").alias("return_types"), "body",
    )


@query("py_parameters")
def q_py_parameters(spark, sf):
    """Positional parameters with annotation text."""
    return X.parameters_of(C.meta(spark, sf)).drop("func_name")


@query("py_return_types")
def q_py_return_types(spark, sf):
    """Declared (Union split) or inferred return types."""
    return X.return_types_of(C.meta(spark, sf)).drop("func_name")


@query("py_classes")
def q_py_classes(spark, sf):
    """Classes with annotated fields and methods (receiver = class name)."""
    c = X.classes_of(C.meta(spark, sf))
    return c.select(
        "path", "class_no", "class_name",
        F.array_join(F.transform("fields", lambda f: F.concat(f["name"], F.lit(":"), f["type"])), ",").alias("fields"),
        F.array_join(F.transform("methods", lambda m: F.concat(m["reciever"], F.lit("."), m["function"]["name"])), ",").alias("methods"),
    )


@query("py_interfaces")
def q_py_interfaces(spark, sf):
    """Interface classes (ABC / Protocol / Interface base or @abstractmethod)."""
    return X.interfaces_of(C.meta(spark, sf))


@query("py_type_text")
def q_py_type_text(spark, sf):
    """Annotation texts in use, with counts (parameters, returns, fields)."""
    m = C.meta(spark, sf)
    p = X.parameters_of(m).select(F.lit("param").alias("site"), F.col("param_type").alias("type_text"))
    r = X.return_types_of(m).select(F.lit("return").alias("site"), F.col("return_type").alias("type_text"))
    f = X.class_fields_of(m).select(F.lit("field").alias("site"), F.col("field_type").alias("type_text"))
    return p.unionByName(r).unionByName(f).groupBy("site", "type_text").agg(F.count(F.lit(1)).alias("n"))


@query("py_body")
def q_py_body(spark, sf):
    """Method bodies (lines after the def line, stripped)."""
    return X.class_methods_of(C.meta(spark, sf)).select("path", "class_name", "method_name", "body")


@query("all_functions")
def q_all_functions(spark, sf):
    """Every function definition at any depth, pre-order."""
    return X.all_functions(C.function_paths(spark, sf))


@query("python_modules")
def q_python_modules(spark, sf):
    """Files grouped by module."""
    return G.python_modules(C.meta(spark, sf))


@query("symbol_counts")
def q_symbol_counts(spark, sf):
    """A1: symbol counts rolled up per directory (partial + final hash aggregate)."""
    m = C.meta(spark, sf).withColumn("dir", TX.dir_of("path"))
    return m.groupBy("dir").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum(F.size("classes")).cast("long").alias("n_classes"),
        F.sum(F.size("interfaces")).cast("long").alias("n_interfaces"), F.sum(F.size("functions")).cast("long").alias("n_functions"),
    )


@query("flatten_symbols")
def q_flatten_symbols(spark, sf):
    """P5: one row per symbol."""
    return X.symbols_of(C.meta(spark, sf))


# --------------------------------------------------------------------------- corpus / paths


def _candidate_paths(spark, sf) -> DataFrame:
    """F1 paths plus derived test-file names and hidden copies (inputs for S1/S8)."""
    rows = FX.code_rows(spark, sf).select("path", "p", "sk")
    base = rows.select("path").distinct()
    tests = base.select(TX.test_path("path", F.lit("python")).alias("path"))
    sym = rows.select(TX.sym_test_name("path", F.concat(F.lit("f_"), F.col("p").cast("string"), F.lit("_"), F.col("sk").cast("string"))).alias("path"))
    hidden = base.select(F.concat(F.lit(".cache/"), "path").alias("path"))
    return base.unionByName(tests).unionByName(sym).unionByName(hidden)


@query("scan_code")
def q_scan_code(spark, sf):
    """Keep .py files that are not tests."""
    return _candidate_paths(spark, sf).where(SRC.keep_source_name(TX.base_name("path")))


@query("skip_hidden")
def q_skip_hidden(spark, sf):
    """Drop paths under hidden directories."""
    return SRC.skip_hidden(_candidate_paths(spark, sf))


@query("file_tree")
def q_file_tree(spark, sf):
    """Tree nodes of the code corpus."""
    return SRC.file_tree(C.file_paths(spark, sf))


@query("url_tree")
def q_url_tree(spark, sf):
    """S6 on F6: tree nodes of page URL paths."""
    return SRC.file_tree(FX.url_paths(spark, sf).select("path"))


@query("collect_files")
def q_collect_files(spark, sf):
    """Leaf files of the URL tree, by type."""
    leaves = SRC.collect_files(SRC.file_tree(FX.url_paths(spark, sf).select("path")))
    return leaves.groupBy("file_type").agg(F.count(F.lit(1)).alias("n"))


@query("detect_lang")
def q_detect_lang(spark, sf):
    """Code type and analyzer by extension."""
    exts = F.element_at(F.array(*[F.lit(e) for e in (".go", ".py", ".js", ".java", ".cpp", ".PY", ".txt")]), (F.col("p") % 7 + 1).cast("int"))
    rows = FX.code_rows(spark, sf).select("p", "dir").distinct()
    paths = rows.select(F.concat("dir", F.lit("/mod_"), F.col("p").cast("string"), exts).alias("path"))
    return paths.select("path", TX.detect_lang("path").alias("code_type"), TX.analyzer_lang("path").alias("analyzer"))


@query("module_name")
def q_module_name(spark, sf):
    """T12 + T13: relative path under 'repo' and its dotted module name."""
    p = C.file_paths(spark, sf)
    rel = TX.relative_path("path", "repo")
    init = p.select(F.regexp_replace("path", r"mod_[0-9]+\.py$", "__init__.py").alias("path")).distinct()
    both = p.unionByName(init)
    return both.select("path", rel.alias("rel_path"), TX.module_name(rel).alias("module"))


# --------------------------------------------------------------------------- graph


def _edges_out(df: DataFrame) -> DataFrame:
    return df.select("source_file", "target_file", "type", "source_element", "target_element", "weight")


@query("import_edges")
def q_import_edges(spark, sf):
    """G1 + J1: import edges with module resolution."""
    return _edges_out(G.import_edges(C.meta(spark, sf), C.file_paths(spark, sf)))


@query("uses_function")
def q_uses_function(spark, sf):
    """Function-call edges (equi-join on call-name suffixes)."""
    return _edges_out(G.uses_function_edges(C.meta(spark, sf)))


@query("uses_method")
def q_uses_method(spark, sf):
    """Method-call edges."""
    return _edges_out(G.uses_method_edges(C.meta(spark, sf)))


@query("extends_candidates")
def q_extends(spark, sf):
    """Path-contains-class-name edges, over the corpus and the corpus whose paths name classes."""
    cols = ("path", "classes")
    return _edges_out(G.extends_edges(C.meta(spark, sf).select(*cols).unionByName(X.extract_metadata(FX.inheritance_corpus(spark, sf)).select(*cols))))


@query("dependency_edges")
def q_dependency_edges(spark, sf):
    """Union of all edges."""
    return _edges_out(C.edges(spark, sf))


@query("file_dependencies")
def q_file_dependencies(spark, sf):
    """Out-degree table (edges out of every file)."""
    return G.fan_out(C.edges(spark, sf))


@query("file_dependents")
def q_file_dependents(spark, sf):
    """Fan-in table (edges into every file)."""
    return G.fan_in(C.edges(spark, sf))


@query("fan_counts")
def q_fan_counts(spark, sf):
    """Edges into and out of every file, counted without building the uses edges."""
    return G.fan_counts(C.meta(spark, sf), C.file_paths(spark, sf), tokens=C.tokens(spark, sf))


@query("edge_endpoints")
def q_edge_endpoints(spark, sf):
    """Adjacency over edges whose two ends are corpus files."""
    nodes = SRC.file_tree(C.file_paths(spark, sf))
    return G.adjacency(G.edge_endpoints(C.edges(spark, sf), nodes))


@query("project_graph")
def q_project_graph(spark, sf):
    """Every file node with out / in edge counts and its parse status."""
    nodes = SRC.collect_files(SRC.file_tree(C.file_paths(spark, sf))).select("path", "file_type")
    e = C.edges(spark, sf)
    out = e.groupBy(F.col("source_file").alias("path")).agg(F.count(F.lit(1)).alias("n_out"))
    inn = e.groupBy(F.col("target_file").alias("path")).agg(F.count(F.lit(1)).alias("n_in"))
    m = C.meta(spark, sf).select("path", F.col("error").isNotNull().alias("broken"))
    g = nodes
    for counts in (out, inn, m):  # as large as the corpus: not for a broadcast by the driver
        g = g.join(counts.hint("merge"), "path", "left")
    return g.select("path", "file_type", _long(F.coalesce("n_out", F.lit(0))).alias("n_out"), _long(F.coalesce("n_in", F.lit(0))).alias("n_in"), "broken")


@query("module_rollup")
def q_module_rollup(spark, sf):
    """Every directory with all files / sub-directories below it."""
    return G.module_rollup(C.file_paths(spark, sf))


@query("modules")
def q_modules(spark, sf):
    """The module tree of the corpus."""
    return G.modules(C.file_paths(spark, sf))


@query("module_members")
def q_module_members(spark, sf):
    """Every module with its files and sub-modules at every level."""
    return G.module_members(C.file_paths(spark, sf))


@query("python_module_members")
def q_python_module_members(spark, sf):
    """The files of every module name with their symbols."""
    return G.python_module_members(C.meta(spark, sf))


@query("url_rollup")
def q_url_rollup(spark, sf):
    """G6 on F6 URL paths."""
    return G.module_rollup(FX.url_paths(spark, sf).select("path"))


def _stubs(spark, sf) -> DataFrame:
    rows = FX.code_rows(spark, sf).select("path", "p_size").distinct()
    return rows.where(F.col("p_size") <= 40).select(F.concat("path", F.lit("i")).alias("path"))


@query("merge_type_stubs")
def q_merge_type_stubs(spark, sf):
    """Each .py file joined to its stub (path + 'i')."""
    return G.merge_type_stubs(C.file_paths(spark, sf), _stubs(spark, sf))


@query("stub_merge_stats")
def q_stub_merge_stats(spark, sf):
    """A2: merged / failed counters."""
    return G.stub_merge_stats(G.merge_type_stubs(C.file_paths(spark, sf), _stubs(spark, sf)))


# --------------------------------------------------------------------------- text



def _responses(spark, sf) -> DataFrame:
    """Model responses built from assistant turns, five layouts by conv_id % 5."""
    c = FX.read_table(spark, sf, "conversations").where(F.col("role") == "assistant")
    v = F.col("conv_id") % 5
    raw = (
        F.when(v == 0, F.concat(F.lit("Here:\n```python\n"), "text", F.lit("\n```\n")))
        .when(v == 1, F.concat(F.lit("```\n"), "text", F.lit("\n```")))
        .when(v == 2, F.concat(F.lit("\t\n "), "text", F.lit(" \n　\t")))
        .when(v == 3, F.concat(F.lit("```python\n"), "text", F.lit("\n```\nand\n```java\nclass X {}\n```")))
        .otherwise(F.concat(F.lit("```python\n```"), "text"))
    )
    lang = F.element_at(F.array(F.lit("python"), F.lit("java"), F.lit("")), (F.col("turn") % 3 + 1).cast("int"))
    return c.select(_long("conv_id").alias("conv_id"), _long("turn").alias("turn"), raw.alias("raw"), lang.alias("lang"), "text")


@query("preprocess")
def q_preprocess(spark, sf):
    """Unicode white-space trim."""
    r = _responses(spark, sf)
    return r.select("conv_id", "turn", TX.trim_ws("raw").alias("code"))


@query("extract_python")
def q_extract_python(spark, sf):
    """First fenced block (tag python optional), else the trimmed text."""
    r = _responses(spark, sf)
    return r.select("conv_id", "turn", TX.extract_code("raw").alias("code"))


@query("extract_by_lang")
def q_extract_by_lang(spark, sf):
    """First block fenced with the row's language tag."""
    r = _responses(spark, sf)
    return r.select("conv_id", "turn", "lang", TX.extract_code_by_column("raw", "lang").alias("code"))


def _templates(spark, sf) -> DataFrame:
    c = FX.read_table(spark, sf, "conversations")
    code = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit(" {fileName}"))).otherwise(F.col("text"))
    return c.select(
        _long("conv_id").alias("conv_id"), _long("turn").alias("turn"),
        F.lit("File {fileName}\n{code}\nEnd {fileName}").alias("template"), code.alias("code"),
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string"), F.lit(".py")).alias("file_name"),
    )


@query("fill_template")
def q_fill_template(spark, sf):
    """T4: {code} then {fileName} (sequential replacement)."""
    t = _templates(spark, sf)
    return t.select("conv_id", "turn", TX.fill_template("template", "code", "file_name").alias("prompt"))


@query("append_prompt")
def q_append_prompt(spark, sf):
    """T5: set content, append text, return text."""
    t = _templates(spark, sf)
    return t.select("conv_id", "turn", TX.append_prompt(F.col("code"), F.concat(F.lit("\n# role: "), F.col("turn").cast("string"))).alias("prompt"))


@query("render_context")
def q_render_context(spark, sf):
    """Metadata rendered as English text."""
    m = C.meta(spark, sf)
    return m.select("path", TX.render_context("path", "module", "classes", "interfaces", "functions").alias("context"))


@query("prompt_context")
def q_prompt_context(spark, sf):
    """Each prompt request enriched with its file's rendered context; missing -> ''."""
    m = C.meta(spark, sf).select("path", TX.render_context("path", "module", "classes", "interfaces", "functions").alias("ctx"))
    req = C.file_paths(spark, sf).select("path")
    req = req.unionByName(req.select(TX.test_path("path", F.lit("python")).alias("path")))
    j = req.join(m, "path", "left")
    return j.select("path", TX.append_prompt(F.concat(F.lit("Write unit tests for "), "path", F.lit(".\n")), F.coalesce("ctx", F.lit(""))).alias("prompt"))


@query("test_path")
def q_test_path(spark, sf):
    """Test file path by language."""
    d = q_detect_lang(spark, sf)
    return d.select("path", "code_type", TX.test_path("path", "code_type").alias("test_path"))


@query("sym_test_name")
def q_sym_test_name(spark, sf):
    """Per function test file name."""
    rows = FX.code_rows(spark, sf)
    fn = F.concat(F.lit("f_"), F.col("p").cast("string"), F.lit("_"), F.col("sk").cast("string"))
    return rows.select("path", fn.alias("func_name"), TX.sym_test_name("path", fn).alias("test_path"))


@query("first_match")
def q_first_match(spark, sf):
    """Per conversation, the first assistant turn and its first long word."""
    c = FX.read_table(spark, sf, "conversations").where(F.col("role") == "assistant")
    first = c.groupBy("conv_id").agg(F.min_by(F.struct("turn", "text"), F.col("turn")).alias("f"))
    return first.select(
        _long("conv_id").alias("conv_id"), _long("f.turn").alias("turn"), F.regexp_extract("f.text", "[A-Za-z]{4,}", 0).alias("first_word")
    )


# --------------------------------------------------------------------------- attempts


def attempt_log(spark, sf) -> DataFrame:
    """the retry log derived from ``events``."""
    e = FX.read_table(spark, sf, "events")
    return e.select(
        F.concat(F.lit("src/u"), F.col("user_id").cast("string"), F.lit(".py")).alias("source_path"),
        "ts", F.col("event_id").alias("seq"), (F.col("value") / 100).alias("coverage"),
        F.col("props").alias("report"), (F.col("event_type") == "error").alias("is_error"),
    )


@query("attempt_loop")
def q_attempt_loop(spark, sf):
    """Replay of the generate-evaluate-retry loop per task."""
    return AT.replay(attempt_log(spark, sf))


@query("feedback_prompt")
def q_feedback_prompt(spark, sf):
    """The prompt of every consumed iteration."""
    base = F.concat(F.lit("Write tests for "), F.col("source_path"))
    return AT.feedback_prompts(attempt_log(spark, sf), base)


@query("active_tasks")
def q_active_tasks(spark, sf):
    """A3: tasks per end reason (open = active)."""
    return AT.outcome_counts(AT.replay(attempt_log(spark, sf)))


@query("best_coverage")
def q_best_coverage(spark, sf):
    """A4: running best coverage over consumed attempts."""
    c = AT.consumed(attempt_log(spark, sf))
    return c.select("source_path", "it", "coverage", "best_so_far")


@query("bounded_queue")
def q_bounded_queue(spark, sf):
    """The first 5 x workers submissions are accepted."""
    tasks = attempt_log(spark, sf).groupBy("source_path").agg(F.min("ts").alias("submit_ts"))
    return AT.bounded_queue(tasks)


@query("dedupe_outputs")
def q_dedupe_outputs(spark, sf):
    """One output per test path; the last function in source order wins."""
    fns = X.all_functions(C.function_paths(spark, sf)).select("path", "func_no", "name")
    rows = fns.withColumn("test_path", TX.sym_test_name("path", "name"))
    return AT.dedupe_outputs(rows, "test_path", "func_no")


@query("new_submissions")
def q_new_submissions(spark, sf):
    """Signup requests for paths that are not active."""
    log = attempt_log(spark, sf)
    active = AT.replay(log).where(F.col("end_reason") == "open")
    req = FX.read_table(spark, sf, "events").where(F.col("event_type") == "signup").select(
        F.concat(F.lit("src/u"), F.col("user_id").cast("string"), F.lit(".py")).alias("source_path")
    )
    return AT.new_submissions(req, active)


# --------------------------------------------------------------------------- object store

PROPS = ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def objects(spark, sf) -> DataFrame:
    c = FX.read_table(spark, sf, "customer")
    return c.select(_long("c_custkey").alias("id"), "c_name", _long("c_nationkey").alias("c_nationkey"), "c_acctbal", "c_mktsegment")


def changes(spark, sf) -> DataFrame:
    """F5 change log: orders per customer, kind by priority."""
    o = FX.read_table(spark, sf, "orders")
    kind = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "replace")
        .when(F.col("o_orderpriority") == "2-HIGH", "delete")
        .when(F.col("o_orderpriority").isin("3-MEDIUM", "4-NOT SPECIFIED"), "patch")
        .otherwise("insert")
    )
    seg = F.col("o_orderpriority") == "4-NOT SPECIFIED"
    bal = F.col("o_orderpriority") == "3-MEDIUM"
    is_full = F.col("o_orderpriority").isin("1-URGENT", "5-LOW")
    return o.select(
        _long("o_custkey").alias("id"), F.struct("o_orderdate", "o_orderkey").alias("ord"), kind.alias("kind"),
        F.when(is_full, F.concat(F.lit("R#"), F.col("o_orderkey").cast("string"))).alias("c_name"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(0).cast("long")).alias("c_nationkey"),
        F.when(is_full | bal, F.col("o_totalprice")).alias("c_acctbal"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_orderpriority")).when(seg, F.col("o_orderstatus")).alias("c_mktsegment"),
        F.lit(False).alias("has_c_name"), F.lit(False).alias("has_c_nationkey"), bal.alias("has_c_acctbal"), seg.alias("has_c_mktsegment"),
    )


@query("get_objects")
def q_get_objects(spark, sf):
    """Chosen properties of every object."""
    return ST.get_objects(objects(spark, sf), "id", "c_name")


@query("add_property")
def q_add_property(spark, sf):
    """A new property reads as null on existing objects."""
    return ST.add_property(objects(spark, sf), "c_comment", "string")


@query("object_by_id")
def q_object_by_id(spark, sf):
    """Lookups of the customers of failed orders."""
    ids = FX.read_table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(_long("o_custkey").alias("id"))
    return ST.object_by_id(objects(spark, sf), ids)


@query("file_by_path")
def q_file_by_path(spark, sf):
    """Metadata lookup for requested paths (first match, or a miss)."""
    m = C.meta(spark, sf).select("path", F.size("functions").cast("long").alias("n_functions"), "module")
    req = C.file_paths(spark, sf).select("path")
    req = req.unionByName(req.select(TX.test_path("path", F.lit("python")).alias("path")))
    return ST.first_by_key(m, req, "path", "module").select("path", "found", "n_functions")


@query("nested_projection")
def q_nested_projection(spark, sf):
    """Nested field selection (classes.name, functions.name)."""
    m = C.meta(spark, sf).select("path", "module", F.col("classes.name").alias("cn"), F.col("functions.name").alias("fn"))
    return m.select("path", "module", F.array_join("cn", ",").alias("class_names"), F.array_join("fn", ",").alias("function_names"))


@query("to_document")
def q_to_document(spark, sf):
    """Customer -> nested document with its nation and region."""
    cu = FX.read_table(spark, sf, "customer")
    na = FX.read_table(spark, sf, "nation")
    re_ = FX.read_table(spark, sf, "region")
    j = cu.join(na, cu.c_nationkey == na.n_nationkey).join(re_, na.n_regionkey == re_.r_regionkey)
    doc = F.struct(
        _long("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.struct(F.col("n_name").alias("name"), F.struct(F.col("r_name").alias("name")).alias("region")).alias("nation"),
    )
    return ST.to_document(j.select(_long("c_custkey").alias("id"), doc.alias("d")), "id", F.col("d"))


@query("file_documents")
def q_file_documents(spark, sf):
    """The File record of every path as a nested document."""
    return ST.documents(C.meta(spark, sf).select("path", "module", "classes", "interfaces", "functions"), "path")


@query("batch_insert")
def q_batch_insert(spark, sf):
    """M1: insert low-priority orders as new objects (id = order key)."""
    o = FX.read_table(spark, sf, "orders").where(F.col("o_orderpriority") == "5-LOW")
    new = o.select(
        _long("o_orderkey").alias("id"), F.concat(F.lit("N#"), F.col("o_orderkey").cast("string")).alias("c_name"),
        F.lit(0).cast("long").alias("c_nationkey"), F.col("o_totalprice").alias("c_acctbal"), F.col("o_orderstatus").alias("c_mktsegment"),
        _long("o_orderkey").alias("_seq"),
    )
    _, statuses = ST.batch_insert(objects(spark, sf), new)
    return statuses


@query("insert_object")
def q_insert_object(spark, sf):
    """M2: one object per nation (id = nation key x 1000); table size after."""
    na = FX.read_table(spark, sf, "nation")
    new = na.select(
        (F.col("n_nationkey") * 1000).cast("long").alias("id"), F.col("n_name").alias("c_name"), _long("n_nationkey").alias("c_nationkey"),
        F.lit(0.0).alias("c_acctbal"), F.lit("NEW").alias("c_mktsegment"), _long("n_nationkey").alias("_seq"),
    )
    table, statuses = ST.batch_insert(objects(spark, sf), new)
    return statuses.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("merge_update")
def q_merge_update(spark, sf):
    """M3: patches of c_acctbal / c_mktsegment; the last patch per id wins."""
    ch = changes(spark, sf).where(F.col("kind") == "patch")
    return ST.merge_update(objects(spark, sf), ch, "id", "ord", ["c_acctbal", "c_mktsegment"])


@query("replace_object")
def q_replace_object(spark, sf):
    """M4: replacements (urgent orders); absent properties become null."""
    ch = changes(spark, sf).where(F.col("kind") == "replace").select("id", "ord", "c_name", "c_acctbal")
    return ST.replace_object(objects(spark, sf), ch, "id", "ord")


@query("delete_object")
def q_delete_object(spark, sf):
    """M5: delete the customers of high-priority orders."""
    return ST.delete_object(objects(spark, sf), changes(spark, sf).where(F.col("kind") == "delete"))


@query("apply_changes")
def q_apply_changes(spark, sf):
    """M6: the whole change log folded into the final table."""
    return ST.apply_changes(objects(spark, sf), changes(spark, sf), "id", "ord", PROPS)


# --------------------------------------------------------------------------- paths and cover


SYM_TEMPLATE = "Generate unit tests for {file_name}.\nPath constraints:\n{path_constraints}\nSource:\n{code}\n"


def cover_sets(spark, sf) -> DataFrame:
    """(g = customer, p = order, kind = return flag, pos = line number)."""
    li = FX.read_table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber")
    o = FX.read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(
        _long("o_custkey").alias("g"), _long("o_orderkey").alias("p"), F.col("l_returnflag").alias("kind"), _long("l_linenumber").alias("pos")
    ).distinct()


@query("py_paths")
def q_py_paths(spark, sf):
    """Control-flow label paths per function (long form)."""
    return X.path_labels(C.function_paths(spark, sf))


@query("distinct_branches")
def q_distinct_branches(spark, sf):
    """A5: distinct (kind, pos) branches per function."""
    return CV.distinct_branches(CV.branch_incidence(X.path_labels(C.function_paths(spark, sf)))).withColumn("n_branches", _long("n_branches"))


@query("argmax_pick")
def q_argmax_pick(spark, sf):
    """Per customer, the order covering most (flag, line) branches; ties -> lowest key."""
    return CV.argmax_pick(cover_sets(spark, sf), ["g"], "p")


@query("min_path_cover")
def q_min_path_cover(spark, sf):
    """Greedy minimal covering set of orders per customer."""
    return CV.min_path_cover(cover_sets(spark, sf), ["g"], "p")


@query("describe_paths")
def q_describe_paths(spark, sf):
    """Descriptions of the chosen paths of every function."""
    fp = C.function_paths(spark, sf)
    picks = CV.min_path_cover(CV.branch_incidence(X.path_labels(fp)), ["path", "func_no"])
    return CV.describe_functions(fp, picks)


def _length_model(prompt: str) -> str:
    """Deterministic stand-in for a chat model: a fenced block naming the prompt size."""
    return "Here you go:\n```python\n# " + str(len(prompt)) + "\ndef test_generated():\n    assert True\n```\n"


def _ratio_eval(source: str, test: str, path: str) -> tuple[float, str]:
    """Deterministic stand-in for a test runner."""
    if len(test) % 7 == 0:
        raise RuntimeError("coverage run failed")
    return (len(test) % 100) / 100.0, "ran " + path


@query("generate")
def q_generate(spark, sf):
    """Model call per prompt (template prompts from conversations)."""
    t = _templates(spark, sf).select("conv_id", "turn", TX.fill_template("template", "code", "file_name").alias("prompt"))
    return GN.generate(t, GN.each(_length_model)).select("conv_id", "turn", "response", F.col("gen_error").isNotNull().alias("failed"))


@query("evaluate")
def q_evaluate(spark, sf):
    """Test callback per generated test (coverage, report, error)."""
    t = _templates(spark, sf)
    t = t.select("conv_id", "turn", F.col("code").alias("source_code"), F.col("file_name").alias("test_path"),
                 TX.fill_template("template", "code", "file_name").alias("test_code"))
    e = GN.evaluate(t, GN.each(_ratio_eval))
    return e.select("conv_id", "turn", "coverage", "report", F.col("eval_error").isNotNull().alias("failed"))


@query("sym_prompt")
def q_sym_prompt(spark, sf):
    """Per function, the filled path-constraint prompt (size and line count)."""
    d = q_describe_paths(spark, sf)
    code = C.corpus(spark, sf).select("path", F.col("content").alias("code"))
    p = d.join(code, "path").select("path", "func_no", TX.sym_prompt(F.lit(SYM_TEMPLATE), F.col("constraints"), F.col("code"), F.col("path")).alias("prompt"))
    return p.select("path", "func_no", _long(F.length("prompt")).alias("n_chars"), _long(TX.line_count("prompt")).alias("n_lines"))


@query("sym_pipeline")
def q_sym_pipeline(spark, sf):
    """End-to-end test generation with a deterministic model."""
    out = GN.sym_pipeline(C.corpus(spark, sf), SYM_TEMPLATE, GN.each(_length_model), C.function_paths(spark, sf))
    return out.select("test_path", "path", "func_no", "test_code")


@query("sym_evaluate")
def q_sym_evaluate(spark, sf):
    """N3 to its end: the tests written as a table keyed by test path, then evaluated."""
    out = GN.sym_pipeline(C.corpus(spark, sf), SYM_TEMPLATE, GN.each(_length_model), C.function_paths(spark, sf), GN.each(_ratio_eval), _scratch_dir(spark, "tests"))
    return out.select("test_path", "path", "func_no", "coverage", "report", F.col("eval_error").isNotNull().alias("failed"))


LANGS = ("python", "javascript", "java")


def _fenced_model(prompts: list[str]) -> list:
    """Deterministic stand-in for a chat model, a list at a time: one block a language naming the prompt's size; fails on some sizes."""
    blocks = lambda n: "".join(f"```{t}\n# {n} {t}\n```\n" for t in LANGS)
    return [RuntimeError("model failed") if len(p) % 29 == 0 else "Tests:\n" + blocks(len(p)) for p in prompts]


def _sized_eval(sources: list[str], tests: list[str], paths: list[str]) -> list:
    """Deterministic stand-in for a test runner: coverage follows from the size that the test names."""
    out = []
    for source, test, path in zip(sources, tests, paths):
        n = int(test.split()[1])
        covered = n * 37 % 101 % 95
        out.append(RuntimeError("run failed") if n % 23 == 0 else (covered / 100.0, f"{covered} of 100 in {path} ({len(source)})" + " " * (n % 7)))
    return out


@query("retry_loop")
def q_retry_loop(spark, sf):
    """W1 run live: one task a document, prompted, evaluated and prompted again with the report."""
    d = FX.read_table(spark, sf, "documents")
    ext = F.element_at(F.array(F.lit(".py"), F.lit(".js"), F.lit(".java")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    tasks = d.select(F.concat(F.lit("src/doc_"), F.col("doc_id").cast("string"), ext).alias("source_path"), F.coalesce("text", F.lit("")).alias("source_code"))
    tasks = tasks.withColumn("code_type", TX.detect_lang("source_path"))
    base = TX.fill_template(F.lit("Write tests for {fileName}:\n{code}\n"), F.col("source_code"), F.col("source_path"))
    return GN.retry_loop(tasks, base, _fenced_model, _sized_eval)[0]


# --------------------------------------------------------------------------- streaming



def _staged_attempts(spark, sf, with_submits: bool) -> str:
    log = attempt_log(spark, sf).withColumn("kind", F.lit("attempt"))
    if with_submits:
        subs = FX.read_table(spark, sf, "events").where(F.col("event_type") == "signup").select(
            F.concat(F.lit("src/u"), F.col("user_id").cast("string"), F.lit(".py")).alias("source_path"), "ts",
            F.col("event_id").alias("seq"), F.lit("submit").alias("kind"), F.lit(None).cast("double").alias("coverage"),
            F.lit(None).cast("string").alias("report"), F.lit(False).alias("is_error"),
        )
        log = log.unionByName(subs)
    d = RS._scratch(spark, "attempts-src")
    log = log.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    RS.stage_by_time(log.select(*[f.name for f in RS.ATTEMPT_SCHEMA]), d, 4)
    return d


@query("stream_attempts")
def q_stream_attempts(spark, sf):
    """The retry loop as a keyed stateful stream; equals W1 for time-ordered batches."""
    src = _staged_attempts(spark, sf, False)
    stream = spark.readStream.schema(RS.ATTEMPT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    out = RS.run_to_table(RS.stream_attempts(stream), "source_path", "r1")
    return out.select("source_path", "attempts_used", "iterations", "best_coverage", "last_report", "end_reason")


@query("stream_dedupe")
def q_stream_dedupe(spark, sf):
    """Submits refused while a task is active, accepted after it completes."""
    src = _staged_attempts(spark, sf, True)
    stream = spark.readStream.schema(RS.ATTEMPT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    out = RS.run_to_table(RS.stream_attempts(stream, with_submits=True), "source_path", "r3")
    return out.select("source_path", "accepted", "refused", "tasks", "end_reason")


@query("stream_code_files")
def q_stream_code_files(spark, sf):
    """R2: source files arriving as a stream -> metadata rows (same rows as X1)."""
    corpus = C.corpus(spark, sf).select("path", "content")
    d = RS._scratch(spark, "code-src")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    corpus.repartition(4 * tasks).write.parquet(d)
    meta = RS.stream_code_files(spark, d, corpus.schema, files_per_batch=tasks)
    return meta.select(
        "path", "module", _long(F.size("classes")).alias("n_classes"), _long(F.size("interfaces")).alias("n_interfaces"),
        _long(F.size("functions")).alias("n_functions"), F.col("error").isNotNull().alias("broken"),
    )


@query("stream_file_versions")
def q_stream_file_versions(spark, sf):
    """R2: files that arrive again, in both orders and repeated; the newest version of a path counts."""
    new = C.corpus(spark, sf).select("path", "content", F.lit(2).cast("long").alias("version"))
    old = new.select("path", F.lit("x = 1\n").alias("content"), F.lit(1).cast("long").alias("version"))
    d = RS._scratch(spark, "versions-src")
    odd = F.pmod(F.xxhash64("path"), F.lit(2)) == 1
    # a delivery is about one micro-batch, whatever the number of the corpus's partitions
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for part in (new.where(odd).unionByName(old.where(~odd)), old.where(odd).unionByName(new.where(~odd)), new.where(odd)):
        part.repartition(tasks).write.mode("append").parquet(d)
    meta = RS.stream_file_versions(spark, d, new.schema, files_per_batch=tasks)
    return meta.select("path", "version", "module", _long(F.size("classes")).alias("n_classes"), _long(F.size("functions")).alias("n_functions"), F.col("error").isNotNull().alias("broken"))


# --------------------------------------------------------------------------- sinks and sources (S3-S5), J1 on its own


def _scratch_dir(spark, name: str) -> str:
    import uuid

    from codeloom.session import checkpoint_dir

    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


@query("json_round_trip")
def q_json_round_trip(spark, sf):
    """S5 then S4: File records saved as JSON documents and loaded back with the fixed schema."""
    out = _scratch_dir(spark, "meta-json")
    SRC.save_metadata_json(C.meta(spark, sf), out)
    back = SRC.load_metadata_json(spark, out)
    return back.select(
        "path", "module", _long(F.size("classes")).alias("n_classes"), _long(F.size("interfaces")).alias("n_interfaces"),
        _long(F.size("functions")).alias("n_functions"),
    )


@query("write_outputs")
def q_write_outputs(spark, sf):
    """S3: test-path table written partitioned by language, read back."""
    out = _scratch_dir(spark, "outputs")
    rows = q_test_path(spark, sf).withColumn("analyzer", TX.analyzer_lang("path"))
    SRC.write_outputs(rows, out, partition_by="analyzer")
    return spark.read.parquet(out).select("path", "code_type", "test_path")


@query("resolve_imports")
def q_resolve_imports(spark, sf):
    """Distinct (directory, module) pairs of import lines resolved to files."""
    rows = G.import_rows(G.analysis_sources(C.meta(spark, sf)))
    return G.resolve_modules(rows.select("dir", "module").distinct(), C.file_paths(spark, sf))


@query("java_metadata")
def q_java_metadata(spark, sf):
    """X11: Java declarations (package, classes with fields / methods, interfaces)."""
    from codeloom.operators.java_extract import extract_java

    m = extract_java(FX.java_corpus(spark, sf))
    sig = lambda f: F.concat(f["name"], F.lit("("), F.array_join(F.transform(f["parameters"], lambda p: F.concat(p["type"], F.lit(" "), p["name"])), ","), F.lit(")->"), F.array_join(f["return_types"], "|"))
    c = F.try_element_at("classes", F.lit(1))
    i = F.try_element_at("interfaces", F.lit(1))
    return m.select(
        "path", "module", c["name"].alias("class_name"),
        F.array_join(F.transform(c["fields"], lambda f: F.concat(f["name"], F.lit(":"), f["type"])), ",").alias("fields"),
        F.array_join(F.transform(c["methods"], lambda mm: sig(mm["function"])), ";").alias("methods"),
        F.array_join(F.transform(c["methods"], lambda mm: mm["function"]["body"]), ";").alias("bodies"),
        i["name"].alias("iface_name"), F.array_join(F.transform(i["methods"], sig), ";").alias("iface_methods"),
    )


@query("java_module_rollup")
def q_java_module_rollup(spark, sf):
    """G6 for Java sources: every package directory with all files / sub-directories below it."""
    return G.module_rollup(SRC.skip_hidden(FX.java_corpus(spark, sf).select("path")))


@query("read_source")
def q_read_source(spark, sf):
    """S1 + S2: the corpus laid out as one file per source path, scanned back with binaryFile.

    Spark's writer creates the tree (``partitionBy(path)`` -> one directory per
    file, no per-task file IO); the scan recovers each logical path from its
    partition directory, keeps source files (S1 predicate) and the extractor
    decodes the raw bytes strictly (S2).
    """
    root = _scratch_dir(spark, "tree")
    C.corpus(spark, sf).select("path", "content").write.partitionBy("path").text(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(root)
    logical = F.url_decode(F.regexp_extract("path", r"/path=([^/]*)/[^/]*$", 1))
    files = files.select(logical.alias("path"), "content").where(SRC.keep_source_name(TX.base_name("path")))
    meta = X.extract_metadata(files)
    return meta.select(
        "path", "module", _long(F.size("classes")).alias("n_classes"), _long(F.size("interfaces")).alias("n_interfaces"),
        _long(F.size("functions")).alias("n_functions"), F.col("error").isNotNull().alias("broken"),
    )


@query("extends_by_path")
def q_extends_by_path(spark, sf):
    """J4 on a corpus whose child paths name their base class (non-empty at every scale)."""
    return _edges_out(G.extends_edges(X.extract_metadata(FX.inheritance_corpus(spark, sf))))
