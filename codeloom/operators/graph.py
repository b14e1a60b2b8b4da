"""Dependency edges and graph queries.

The reference re-parses every sibling file for every body and tests
``contains(body, name + "(")`` in nested loops.  Here the corpus is parsed
once and each rule becomes an equi-join:

* uses / function (J2): every identifier-shaped suffix of the identifier
  run in front of a ``(`` is extracted (one lookahead regex); ``name(``
  occurs in the body exactly when ``name`` is one of those suffixes, so
  the rule is a hash join on ``(dir, name)``.
* uses / method (J3): ``.m(`` occurs exactly when ``m`` is the run between
  a dot and a parenthesis: join on ``(dir, m)``.
* extends (J4): a class name that occurs in the source path has its first three
  characters there too: the runs of up to three characters of a path
  are joined on ``(dir, start of the name)``, and ``contains`` decides.

No rule ever pairs all files of a directory; hot directories are handled
by AQE's skew-join splitting of the large side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom import schemas as S
from codeloom.functions.text import IDENT_CLASS, IDENT_START_CLASS, dir_of, ext_of, fields, join_path, trim_ws

METHOD_CALL_RE = rf"\.({IDENT_CLASS}++)\("


def _python(meta: DataFrame) -> DataFrame:
    return meta.where(F.lower(ext_of("path")) == ".py")


def analysis_sources(meta: DataFrame) -> DataFrame:
    """Bodies analysed per file: top-level functions, then methods of classes.

    Columns: source_file, dir, elem_kind, elem_no, source_element, body.
    One scan of ``meta``: both kinds are built into one array and exploded.
    """
    m = _python(meta)
    fns = F.transform(
        "functions",
        lambda f, i: F.struct(F.lit("function").alias("elem_kind"), i.cast("long").alias("elem_no"), f["name"].alias("source_element"), f["body"].alias("body")),
    )
    mths = F.flatten(
        F.transform(
            "classes",
            lambda c, ci: F.transform(
                c["methods"],
                lambda mm, mi: F.struct(
                    F.lit("method").alias("elem_kind"), (ci * 100000 + mi).cast("long").alias("elem_no"),
                    mm["function"]["name"].alias("source_element"), mm["function"]["body"].alias("body"),
                ),
            ),
        )
    )
    out = m.select(F.col("path").alias("source_file"), dir_of("path").alias("dir"), F.concat(fns, mths).alias("found"))
    out = out.select("source_file", "dir", F.inline_outer("found")).where(F.col("elem_kind").isNotNull())
    return out.select("source_file", "elem_kind", "elem_no", "source_element", "body", "dir")


def _large(df: DataFrame) -> DataFrame:
    """Never broadcast.  Names exploded from nested columns are estimated by the few bytes of these columns in
    their compressed files: millions of them were collected to the driver for a broadcast."""
    return df.hint("merge")


def _edge(df: DataFrame, kind: str, weight: float) -> DataFrame:
    return df.select(
        "source_file", "target_file", F.lit(kind).alias("type"), "source_element",
        F.coalesce("target_element", F.lit("")).alias("target_element"), F.lit(weight).alias("weight"),
    )


# --------------------------------------------------------------------------- G1 / J1


def import_rows(sources: DataFrame, mode: str = "token") -> DataFrame:
    """G1: ``from X import a, b`` -> one row per name; ``import a, b`` -> one row per module.

    mode="token": the first field must be exactly ``from`` / ``import``.
    mode="prefix": the reference's prefix test on the trimmed line.
    """
    lines = sources.select("source_file", "dir", "source_element", F.explode_outer(F.split("body", "\n")).alias("line"))
    # cheap pre-filter: only lines mentioning a keyword can produce rows
    lines = lines.where(F.col("line").contains("import"))
    lines = lines.select("source_file", "dir", "source_element", (trim_ws("line") if mode == "prefix" else F.col("line")).alias("t"))
    lines = lines.select("*", fields("t").alias("parts"))
    # one pass over the lines: each line yields an array of (module, element) rows
    rows = lines.select("source_file", "dir", "source_element", _imported(F.col("t"), F.col("parts"), mode).alias("imports"))
    # Generators over expensive expressions use the *_outer form plus a null check on
    # the output: for explode / inline the optimizer infers `size(expr) > 0` and
    # pushes it below the projection, evaluating every regex and lambda twice.
    return rows.select("source_file", "dir", "source_element", F.inline_outer("imports")).where(F.col("module").isNotNull())


def _imported(t, parts, mode: str) -> F.Column:
    """(module, target_element) of each name that a trimmed line ``t`` with the fields ``parts`` imports; null if none."""
    n = F.size(parts)
    if mode == "prefix":
        is_from, is_import = t.startswith("from"), t.startswith("import")
    else:
        is_from, is_import = F.try_element_at(parts, F.lit(1)) == "from", F.try_element_at(parts, F.lit(1)) == "import"
    from_ok = is_from & (n >= 4) & (F.try_element_at(parts, F.lit(3)) == "import")
    # the parts hold no white space, so that commas and the spaces between parts are all that separates names
    names = F.array_remove(F.split(F.replace(F.array_join(F.slice(parts, F.lit(4), n), " "), F.lit(","), F.lit(" ")), " "), "")
    module = F.try_element_at(parts, F.lit(2))
    mods = F.transform(F.slice(parts, F.lit(2), n), lambda x: F.regexp_replace(x, ",+$", ""))
    return F.when(from_ok, F.transform(names, lambda e: F.struct(module.alias("module"), e.alias("target_element")))).when(
        is_import & (n >= 2), F.transform(mods, lambda x: F.struct(x.alias("module"), F.lit("").alias("target_element")))
    )


def body_tokens(meta: DataFrame, mode: str = "token") -> DataFrame:
    """What the edge rules look for in every body, in one scan: (source_file, dir, source_element, rule, key, element).

    ``rule`` is ``import`` (key: the module, element: the name taken from it), ``function`` or
    ``method`` (key: the name called).  Write it once and hand it to ``edges_of_tokens``.
    """
    lines = F.filter(F.split("body", "\n"), lambda x: x.contains("import"))
    # only the prefix rule looks at the line itself
    cut = F.transform(lines, lambda t: F.struct((trim_ws(t) if mode == "prefix" else t).alias("t"), fields(t).alias("parts")))
    pairs = F.flatten(F.filter(F.transform(cut, lambda c: _imported(c["t"], c["parts"], mode)), lambda p: p.isNotNull()))
    token = lambda rule, key, element: F.struct(F.lit(rule).alias("rule"), key.alias("key"), element.alias("element"))
    found = F.concat(
        F.transform(pairs, lambda p: token("import", p["module"], p["target_element"])),
        F.transform(call_names(F.col("body")), lambda x: token("function", x, F.lit(""))),
        F.transform(method_call_names(F.col("body")), lambda x: token("method", x, F.lit(""))),
    )
    return analysis_sources(meta).select("source_file", "dir", "source_element", F.inline_outer(found)).where(F.col("rule").isNotNull())


def _import_edges_of(tokens: DataFrame, file_paths: DataFrame) -> DataFrame:
    imports = tokens.where(F.col("rule") == "import").select("source_file", "dir", "source_element", F.col("key").alias("module"), F.col("element").alias("target_element"))
    return _edge(imports.join(_large(resolve_modules(imports.select("dir", "module").distinct(), file_paths)), ["dir", "module"]), "import", S.WEIGHT_IMPORT)


def edges_of_tokens(tokens: DataFrame, meta: DataFrame, file_paths: DataFrame) -> DataFrame:
    """G2 from the written ``body_tokens``: the edges of ``dependency_edges``; no body is read again.

    A module is resolved once per directory that imports it.
    """
    called = lambda rule: tokens.where(F.col("rule") == rule).select("source_file", "dir", "source_element", F.col("key").alias("name"))
    return (
        _import_edges_of(tokens, file_paths)
        .unionByName(_function_edges(called("function"), meta))
        .unionByName(_method_edges(called("method"), meta))
        .unionByName(extends_edges(meta))
    )


def resolve_modules(pairs: DataFrame, file_paths: DataFrame) -> DataFrame:
    """J1 on distinct (dir, module): ``<dir>/m.py`` if it exists, else ``<parent>/m.py``, else ``m.py``.

    Existence is a join hit against the corpus path set (two left equi-joins).
    """
    name = F.concat(F.col("module"), F.lit(".py"))
    cand = pairs.withColumn("c1", join_path("dir", name)).withColumn("c2", join_path(dir_of("dir"), name)).withColumn("c0", name)
    known = file_paths.select(F.col("path").alias("k")).distinct()
    k1 = known.select(F.col("k").alias("c1"), F.lit(True).alias("h1"))
    k2 = known.select(F.col("k").alias("c2"), F.lit(True).alias("h2"))
    res = cand.join(_large(k1), "c1", "left").join(_large(k2), "c2", "left")
    target = F.when(F.col("h1"), F.col("c1")).when(F.col("h2"), F.col("c2")).otherwise(F.col("c0"))
    return res.select("dir", "module", target.alias("target_file"))


def resolve_imports(rows: DataFrame, file_paths: DataFrame) -> DataFrame:
    """Resolve each import row's module to a target file (two left equi-joins).

    The rows are joined directly: a distinct (dir, module) pre-pass would
    need a second evaluation of the row pipeline; :func:`resolve_modules`
    serves callers that already hold distinct pairs.
    """
    name = F.concat(F.col("module"), F.lit(".py"))
    cand = rows.withColumn("c1", join_path("dir", name)).withColumn("c2", join_path(dir_of("dir"), name)).withColumn("c0", name)
    known = file_paths.select(F.col("path").alias("k")).distinct()
    k1 = known.select(F.col("k").alias("c1"), F.lit(True).alias("h1"))
    k2 = known.select(F.col("k").alias("c2"), F.lit(True).alias("h2"))
    res = cand.join(_large(k1), "c1", "left").join(_large(k2), "c2", "left")
    target = F.when(F.col("h1"), F.col("c1")).when(F.col("h2"), F.col("c2")).otherwise(F.col("c0"))
    return res.withColumn("target_file", target)


def import_edges(meta: DataFrame, file_paths: DataFrame, mode: str = "token") -> DataFrame:
    """G1 + J1: import edges, weight 1.0."""
    rows = import_rows(analysis_sources(meta), mode)
    return _edge(resolve_imports(rows, file_paths), "import", S.WEIGHT_IMPORT)


# --------------------------------------------------------------------------- J2 / J3 / J4


# Every identifier-shaped suffix of a run in front of "(": a zero-width match at each
# position that can start an identifier, capturing the rest of the run up to "(".
CALL_SUFFIX_RE = rf"(?=({IDENT_START_CLASS}{IDENT_CLASS}*+)\()"
# A whole run in front of "(".  Tried at the start of a run only: a run without "(" behind it is read once, whatever its length.
CALL_RUN_RE = rf"(?<!{IDENT_CLASS})({IDENT_CLASS}++)\("


def call_names(body) -> F.Column:
    """All identifier-shaped names ``n`` such that ``n(`` occurs in ``body``.

    The distinct identifier runs in front of a ``(`` are cut out first; a name is a
    suffix of one of them that starts with a character able to start an identifier.
    """
    runs = F.array_distinct(F.regexp_extract_all(body, F.lit(CALL_RUN_RE), 1))
    return F.array_distinct(F.regexp_extract_all(F.concat(F.array_join(runs, "("), F.lit("(")), F.lit(CALL_SUFFIX_RE), 1))


def method_call_names(body) -> F.Column:
    """All names ``m`` such that ``.m(`` occurs in ``body``."""
    return F.array_distinct(F.regexp_extract_all(body, F.lit(METHOD_CALL_RE), 1))


GRAM = 3  # characters of a class name that index it


def path_grams(path) -> F.Column:
    """Every run of up to ``GRAM`` characters of ``path``: a class name's first characters are among those of a path that contains it."""
    last = F.length(path)
    runs = F.transform(F.sequence(F.lit(1), last), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(GRAM), last - i + 1)), lambda k: F.substring(path, i, k)))
    return F.when(last > 0, F.array_distinct(F.flatten(runs)))


def uses_function_edges(meta: DataFrame) -> DataFrame:
    """Body contains ``fn(`` for a top-level function of another file in the same directory."""
    src = analysis_sources(meta).select("source_file", "dir", "source_element", F.explode_outer(call_names("body")).alias("name")).where(F.col("name").isNotNull())
    return _function_edges(src, meta)


def _function_edges(src: DataFrame, meta: DataFrame) -> DataFrame:
    tgt = _python(meta).select(F.col("path").alias("target_file"), dir_of("path").alias("dir"), F.explode("functions.name").alias("name"))
    j = src.join(_large(tgt), ["dir", "name"]).where(F.col("source_file") != F.col("target_file"))
    return _edge(j.withColumn("target_element", F.col("name")), "uses", S.WEIGHT_USES)


def uses_method_edges(meta: DataFrame) -> DataFrame:
    """Body contains ``.m(`` (or ``C.m(``) for a method m of a class of another file in the directory."""
    src = analysis_sources(meta).select("source_file", "dir", "source_element", F.explode_outer(method_call_names("body")).alias("name")).where(F.col("name").isNotNull())
    return _method_edges(src, meta)


def _method_edges(src: DataFrame, meta: DataFrame) -> DataFrame:
    cls =_python(meta).select(F.col("path").alias("target_file"), F.explode("classes").alias("c"))
    tgt = cls.select("target_file", F.col("c.name").alias("class_name"), F.explode("c.methods.function.name").alias("name")).withColumn(
        "dir", dir_of("target_file")
    )
    j = src.join(_large(tgt), ["dir", "name"]).where(F.col("source_file") != F.col("target_file"))
    return _edge(j.withColumn("target_element", F.concat("class_name", F.lit("."), "name")), "uses", S.WEIGHT_USES)


def extends_edges(meta: DataFrame) -> DataFrame:
    """The source *path* contains the name of another class of the same directory."""
    py = _python(meta)
    src = py.where(F.size("classes") > 0).select(F.col("path").alias("source_file"), F.explode_outer(path_grams(F.col("path"))).alias("start"))
    src = src.where(F.col("start").isNotNull()).withColumn("dir", dir_of("source_file"))
    tgt = py.select(F.col("path").alias("target_file"), F.explode("classes.name").alias("name")).withColumn("dir", dir_of("target_file"))
    tgt = tgt.withColumn("start", F.substring("name", 1, GRAM))
    # A pair of a path and a class meets under the class's start only, so it comes once.
    hits = src.join(_large(tgt), ["dir", "start"]).where((F.col("source_file") != F.col("target_file")) & F.col("source_file").contains(F.col("name")))
    src_cls = py.select(F.col("path").alias("source_file"), F.explode("classes.name").alias("source_element"))
    j = hits.join(_large(src_cls), "source_file").where(F.col("source_element") != F.col("name"))
    return _edge(j.withColumn("target_element", F.col("name")), "extends", S.WEIGHT_EXTENDS)


def dependency_edges(meta: DataFrame, file_paths: DataFrame, mode: str = "token") -> DataFrame:
    """Import + uses (functions, methods) + extends edges, bag semantics."""
    return (
        import_edges(meta, file_paths, mode)
        .unionByName(uses_function_edges(meta))
        .unionByName(uses_method_edges(meta))
        .unionByName(extends_edges(meta))
    )


# --------------------------------------------------------------------------- G3-G6, J5, J6


def file_dependencies(edges: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Edges out of a file (or out of every file of ``paths``, by semi join)."""
    return edges if paths is None else edges.join(paths.select(F.col("path").alias("source_file")), "source_file", "left_semi")


def file_dependents(edges: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Edges into a file (or into every file of ``paths``)."""
    return edges if paths is None else edges.join(paths.select(F.col("path").alias("target_file")), "target_file", "left_semi")


def fan_in(edges: DataFrame) -> DataFrame:
    """G4 table: per target file, edge count, distinct dependents, weight sum."""
    return edges.groupBy("target_file").agg(
        F.count(F.lit(1)).alias("n_edges"),
        F.countDistinct("source_file").alias("n_dependents"),
        F.round(F.sum("weight"), 6).alias("weight_sum"),
    )


def fan_out(edges: DataFrame) -> DataFrame:
    """G3 table: per source file, edge count and distinct targets."""
    return edges.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("target_file").alias("n_targets"))


def _shared_names(calls: DataFrame, defs: DataFrame, weight: float) -> DataFrame:
    """(path, n_in, n_out, w_in, w_out): the edges between the files of a directory that call and define a name, counted.

    ``calls`` and ``defs``: (path, dir, name), one row a calling body or a definition.  A definition has an
    edge from every call of its name in the directory but those of its own file, so the
    counts follow from the totals of (dir, name) and a file's own share: work grows
    with the rows given, where the edges grow with calls times definitions.
    """
    both = calls.select("path", "dir", "name", F.lit(1).alias("c"), F.lit(0).alias("d")).unionByName(defs.select("path", "dir", "name", F.lit(0).alias("c"), F.lit(1).alias("d")))
    own = both.groupBy("dir", "name", "path").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    total = own.groupBy("dir", "name").agg(F.sum("c").alias("all_c"), F.sum("d").alias("all_d")).where((F.col("all_c") > 0) & (F.col("all_d") > 0))
    n = own.join(_large(total), ["dir", "name"]).select("path", (F.col("d") * (F.col("all_c") - F.col("c"))).alias("n_in"), (F.col("c") * (F.col("all_d") - F.col("d"))).alias("n_out"))
    return n.where("n_in > 0 or n_out > 0").select("*", (F.col("n_in") * weight).alias("w_in"), (F.col("n_out") * weight).alias("w_out"))


def fan_counts(meta: DataFrame, file_paths: DataFrame, mode: str = "token", tokens: DataFrame | None = None) -> DataFrame:
    """G3 / G4 without the edges: per file the number and the weight of the edges into it and out of it.

    The counts equal those of ``fan_in`` and ``fan_out``; uses edges, whose number grows with the product of callers and
    definitions of a name, are counted by ``_shared_names``.  Files without an edge do not come.
    With the written ``tokens`` (``body_tokens`` in the same mode) no body is read again.
    """
    if tokens is None:
        src = analysis_sources(meta).select(F.col("source_file").alias("path"), "dir", "body")
        called = lambda names: src.select("path", "dir", F.explode_outer(names(F.col("body"))).alias("name")).where(F.col("name").isNotNull())
        function_calls, method_calls, imports = called(call_names), called(method_call_names), import_edges(meta, file_paths, mode)
    else:
        called = lambda rule: tokens.where(F.col("rule") == rule).select(F.col("source_file").alias("path"), "dir", F.col("key").alias("name"))
        function_calls, method_calls, imports = called("function"), called("method"), _import_edges_of(tokens, file_paths)
    py = _python(meta).select("path", dir_of("path").alias("dir"), "functions", "classes")
    functions = py.select("path", "dir", F.explode("functions.name").alias("name"))
    methods = py.select("path", "dir", F.explode(F.flatten(F.transform("classes", lambda c: c["methods"]["function"]["name"]))).alias("name"))
    rows = _shared_names(function_calls, functions, S.WEIGHT_USES).unionByName(_shared_names(method_calls, methods, S.WEIGHT_USES))
    for edges in (imports, extends_edges(meta)):
        one, none, w = F.lit(1), F.lit(0), F.col("weight")
        ends = F.array(
            F.struct(F.col("target_file").alias("path"), one.alias("n_in"), none.alias("n_out"), w.alias("w_in"), F.lit(0.0).alias("w_out")),
            F.struct(F.col("source_file").alias("path"), none.alias("n_in"), one.alias("n_out"), F.lit(0.0).alias("w_in"), w.alias("w_out")),
        )
        rows = rows.unionByName(edges.select(F.inline(ends)))
    out = rows.groupBy("path").agg(*(F.sum(c).alias(c) for c in ("n_in", "n_out", "w_in", "w_out")))
    return out.select("path", *(F.col(c).cast("long").alias(c) for c in ("n_in", "n_out")), *(F.round(c, 6).alias(c) for c in ("w_in", "w_out")))


def edge_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Keep edges whose two ends are known file nodes (two left semi joins)."""
    files = nodes.where(F.col("file_type") != "dir").select("path")
    e = edges.join(_large(files.select(F.col("path").alias("source_file"))), "source_file", "left_semi")
    return e.join(_large(files.select(F.col("path").alias("target_file"))), "target_file", "left_semi")


def adjacency(edges: DataFrame) -> DataFrame:
    """The node adjacency as (source, target, multiplicity) rows.

    The reference appends every edge's target to the source node's list
    (duplicates kept).  One row per (source, target) pair with its count
    holds the same multiset without collecting a hot node's whole list
    into one row; it is a partial aggregate.
    """
    return edges.groupBy("source_file", "target_file").agg(F.count(F.lit(1)).alias("multiplicity"))


def merge_type_stubs(files: DataFrame, stubs: DataFrame) -> DataFrame:
    """For each ``.py`` file, whether a stub at ``path + 'i'`` exists."""
    py = files.where(F.col("path").endswith(".py")).select("path")
    s = stubs.select(F.col("path").alias("stub_path")).distinct()
    return py.join(s, F.concat("path", F.lit("i")) == F.col("stub_path"), "left").select("path", F.col("stub_path").isNotNull().alias("merged"))


def stub_merge_stats(merged: DataFrame) -> DataFrame:
    """A2: success / failure counters."""
    return merged.agg(F.count_if("merged").cast("long").alias("n_merged"), F.count_if(~F.col("merged")).cast("long").alias("n_failed"))


def _parent(path: str) -> F.Column:
    """The directory of a path; '' at the top."""
    return F.when(F.col(path).contains("/"), dir_of(path)).otherwise("")


def directory_closure(paths: DataFrame) -> DataFrame:
    """(module_path, dir, distance): every directory, those without files too, with itself (0) and each directory above it.

    Built from the distinct directories, of which there are far fewer than files; rows grow with depth only.
    """
    dirs = paths.select(_parent("path").alias("dir")).where("dir <> ''").distinct()
    above = lambda d: F.transform(F.sequence(F.lit(1), F.size(F.split(d, "/"))), lambda k: F.call_function("substring_index", d, F.lit("/"), k))
    dirs = dirs.select(F.explode_outer(above(F.col("dir"))).alias("dir")).distinct()
    pairs = dirs.select("dir", F.size(F.split("dir", "/")).alias("n"), F.posexplode_outer(above(F.col("dir"))).alias("i", "module_path"))
    return pairs.select("module_path", "dir", (F.col("n") - F.col("i") - 1).cast("long").alias("distance"))


def _depth(path) -> F.Column:
    return (F.size(F.split(path, "/")) - 1).cast("long")


def module_rollup(paths: DataFrame) -> DataFrame:
    """Every directory with the number of all files / all sub-directories below it.

    Files are counted by directory first; only these counts are joined to the directories above.
    """
    closure = directory_closure(paths)
    files = paths.groupBy(_parent("path").alias("dir")).agg(F.count(F.lit(1)).alias("n"))
    counted = closure.join(files, "dir", "left").groupBy("module_path").agg(
        F.sum("n").alias("n_files"), F.sum(F.when(F.col("distance") == 0, F.col("n"))).alias("n_direct_files"), F.count_if(F.col("distance") > 0).alias("n_submodules")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return counted.select("module_path", _depth("module_path").alias("depth"), zero("n_files"), zero("n_direct_files"), F.col("n_submodules").cast("long"))


def modules(paths: DataFrame) -> DataFrame:
    """The module tree, (module_path, parent_path, depth); '' above the top."""
    own = directory_closure(paths).where("distance = 0")
    return own.select("module_path", _parent("module_path").alias("parent_path"), _depth("module_path").alias("depth"))


def module_members(paths: DataFrame) -> DataFrame:
    """What each module holds, (module_path, member, kind, distance): its files and sub-modules at every level.

    ``distance`` 1 are the direct members.  One row a member and level, never a list: a module with a third
    of all files is many rows.
    """
    closure = directory_closure(paths)
    files = paths.select("path", _parent("path").alias("dir")).where("dir <> ''").join(closure, "dir")
    files = files.select("module_path", F.col("path").alias("member"), F.lit("file").alias("kind"), (F.col("distance") + 1).alias("distance"))
    return files.unionByName(closure.where("distance > 0").select("module_path", F.col("dir").alias("member"), F.lit("module").alias("kind"), "distance"))


def python_module_members(meta: DataFrame) -> DataFrame:
    """The files of every module name with the symbols each brings, (module, path, kind, name); kind ``file`` for the file itself."""
    named = lambda kind, names: F.transform(names, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))
    parts = [F.array(F.struct(F.lit("file").alias("kind"), F.col("path").alias("name")))]
    parts += [named(k, F.col(f"{c}.name")) for k, c in (("class", "classes"), ("interface", "interfaces"), ("function", "functions"))]
    return meta.select("module", "path", F.inline(F.concat(*parts)))


def python_modules(meta: DataFrame) -> DataFrame:
    """Files grouped by module name, flattened to counts per module."""
    return meta.groupBy("module").agg(
        F.count(F.lit(1)).cast("long").alias("n_files"),
        F.sum(F.size("functions")).cast("long").alias("n_functions"),
        F.sum(F.size("classes")).cast("long").alias("n_classes"),
    )

