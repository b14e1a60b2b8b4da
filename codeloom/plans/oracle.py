r"""DuckDB oracle SQL, one statement per registered query.

The oracle never parses code: it rebuilds the expected answer from the
rows that generated the fixture (``FIXTURE_F1``), or runs a brute-force
formulation (e.g. ``contains`` over all same-directory pairs) that the
Spark plan deliberately avoids.  Tables are the driver's views.
"""

from __future__ import annotations

NL = "chr(10)"

# Generating rows of the F1 corpus (same rule as codeloom.sources.fixtures).
FIXTURE_F1 = r"""
ps AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS sk FROM lineitem),
f AS (SELECT p_partkey AS p, concat('repo/', lower(p_type), '/pkg_', CAST(p_partkey // 60 AS VARCHAR)) AS dir, p_size, sk
      FROM part JOIN ps ON ps.p = part.p_partkey),
d AS (SELECT p, dir, p_size, min(sk) AS s1 FROM f GROUP BY p, dir, p_size),
nx AS (SELECT p, coalesce(lead(p) OVER (PARTITION BY dir ORDER BY p), -1) AS q,
              coalesce(lead(s1) OVER (PARTITION BY dir ORDER BY p), 0) AS qs FROM d),
fr AS (SELECT f.p, f.dir, concat(f.dir, '/mod_', CAST(f.p AS VARCHAR), '.py') AS path, f.p_size, f.sk, nx.q, nx.qs,
              f.p % 17 <> 0 AS ok,
              CAST(row_number() OVER (PARTITION BY f.p ORDER BY f.sk) - 1 AS BIGINT) AS func_no
       FROM f JOIN nx ON f.p = nx.p),
files AS (SELECT p, dir, path, p_size, ok, count(*) AS nf FROM fr GROUP BY p, dir, path, p_size, ok),
fnb AS (SELECT fr.*, concat('f_', p, '_', sk) AS name,
          CASE WHEN q >= 0 THEN concat('from mod_', q, ' import f_', q, '_', qs, chr(10), '    obj.m_', q, '(qty)', chr(10),
                                       '    if qty > ', p_size, ':', chr(10), '        return f_', q, '_', qs, '(qty, price)', chr(10),
                                       '    else:', chr(10), '        return price')
               ELSE concat('import ext_lib', chr(10), '    if qty > ', p_size, ':', chr(10), '        return ext_lib.run(qty)', chr(10),
                           '    else:', chr(10), '        return price') END AS body
        FROM fr WHERE ok),
cls AS (SELECT path, dir, concat('mod_', p) AS class_name, concat('m_', p) AS method_name, 'return x' AS body
        FROM files WHERE ok AND p_size % 3 = 0),
srcs AS (SELECT path AS source_file, dir, name AS source_element, body FROM fnb
         UNION ALL SELECT path, dir, method_name, body FROM cls)
"""


def with_f1(body: str) -> str:
    return "WITH " + FIXTURE_F1 + body


E_USES_FN = r"""
SELECT s.source_file, t.path AS target_file, 'uses' AS type, s.source_element, t.name AS target_element, CAST(0.7 AS DOUBLE) AS weight
FROM srcs s JOIN fnb t ON s.dir = t.dir AND s.source_file <> t.path AND contains(s.body, t.name || '(')
"""
E_USES_M = r"""
SELECT s.source_file, c.path AS target_file, 'uses' AS type, s.source_element, c.class_name || '.' || c.method_name AS target_element, CAST(0.7 AS DOUBLE) AS weight
FROM srcs s JOIN cls c ON s.dir = c.dir AND s.source_file <> c.path
 AND (contains(s.body, c.class_name || '.' || c.method_name || '(') OR contains(s.body, '.' || c.method_name || '('))
"""
E_EXT = r"""
SELECT a.path AS source_file, b.path AS target_file, 'extends' AS type, a.class_name AS source_element, b.class_name AS target_element, CAST(0.9 AS DOUBLE) AS weight
FROM cls a JOIN cls b ON a.dir = b.dir AND a.path <> b.path AND a.class_name <> b.class_name AND contains(a.path, b.class_name)
"""
E_IMP = r"""
SELECT path AS source_file, CASE WHEN q >= 0 THEN concat(dir, '/mod_', q, '.py') ELSE 'ext_lib.py' END AS target_file,
       'import' AS type, name AS source_element, CASE WHEN q >= 0 THEN concat('f_', q, '_', qs) ELSE '' END AS target_element, CAST(1.0 AS DOUBLE) AS weight
FROM fnb
"""
EDGES = f"edges AS ({E_IMP} UNION ALL {E_USES_FN} UNION ALL {E_USES_M} UNION ALL {E_EXT})"

CANDIDATES = r"""
, base AS (SELECT DISTINCT path FROM fr),
cand AS (SELECT path FROM base
         UNION ALL SELECT regexp_replace(path, '\.py$', '_test.py') FROM base
         UNION ALL SELECT concat(dir, '/mod_', p, '_f_', p, '_', sk, '_test_case_1.py') FROM fr
         UNION ALL SELECT concat('.cache/', path) FROM base)
"""

URLS = r"""
urls AS (SELECT CAST(page_id AS BIGINT) AS page_id,
  regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[?#].*$', ''), '/+$', '') AS path FROM pages)
"""


def tree_sql(paths_cte: str) -> str:
    return (
        paths_cte
        + r""",
tp AS (SELECT string_split(path, '/') AS parts FROM tpaths),
tk AS (SELECT parts, unnest(generate_series(1, len(parts))) AS k FROM tp),
nodes AS (SELECT DISTINCT array_to_string(parts[1:k], '/') AS path,
                 CASE WHEN k > 1 THEN array_to_string(parts[1:k-1], '/') ELSE '' END AS parent_path,
                 parts[k] AS file_name,
                 CASE WHEN k < len(parts) THEN 'dir' WHEN NOT contains(parts[k], '.') THEN 'file'
                      ELSE regexp_extract(parts[k], '\.([^.]*)$', 1) END AS file_type,
                 CAST(k - 1 AS BIGINT) AS depth FROM tk)
"""
    )


def rollup_sql(paths_cte: str) -> str:
    return (
        paths_cte
        + r""",
rp AS (SELECT path, string_split(path, '/') AS parts FROM tpaths),
rk AS (SELECT path, parts, len(parts) AS n, unnest(generate_series(1, len(parts) - 1)) AS k FROM rp),
mods AS (SELECT array_to_string(parts[1:k], '/') AS module_path, CAST(k - 1 AS BIGINT) AS depth, k = n - 1 AS direct FROM rk),
fa AS (SELECT module_path, depth, count(*) AS n_files, count(*) FILTER (WHERE direct) AS n_direct_files FROM mods GROUP BY ALL),
dirs AS (SELECT DISTINCT module_path FROM mods),
sa AS (SELECT a.module_path, count(*) AS n_submodules FROM dirs a JOIN dirs b ON starts_with(b.module_path, a.module_path || '/') GROUP BY 1)
SELECT fa.module_path, fa.depth, CAST(n_files AS BIGINT) AS n_files, CAST(n_direct_files AS BIGINT) AS n_direct_files,
       CAST(coalesce(n_submodules, 0) AS BIGINT) AS n_submodules
FROM fa LEFT JOIN sa ON fa.module_path = sa.module_path
"""
    )


ORACLE: dict[str, str] = {}

ORACLE["py_metadata"] = with_f1(r"""
SELECT path, replace(regexp_replace(path, '\.py$', ''), '/', '.') AS module,
  CAST(CASE WHEN ok AND p_size % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_classes,
  CAST(CASE WHEN ok AND p_size % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_interfaces,
  CAST(CASE WHEN ok THEN nf ELSE 0 END AS BIGINT) AS n_functions,
  NOT ok AS broken
FROM files
""")

ORACLE["py_parse_errors"] = with_f1("SELECT path, CAST(0 AS BIGINT) AS n_symbols FROM files WHERE NOT ok")

ORACLE["py_functions"] = with_f1(r"""
SELECT path, func_no, name, CAST(2 AS BIGINT) AS n_params,
  CASE sk % 3 WHEN 1 THEN 'float' WHEN 2 THEN 'price' ELSE 'Tuple[int|str]' END AS return_types, body
FROM fnb
""")

ORACLE["py_parameters"] = with_f1(r"""
SELECT path, func_no, CAST(0 AS BIGINT) AS param_no, 'qty' AS param_name, 'int' AS param_type FROM fnb
UNION ALL SELECT path, func_no, CAST(1 AS BIGINT), 'price', 'float' FROM fnb
""")

ORACLE["py_return_types"] = with_f1(r"""
SELECT path, func_no, CAST(0 AS BIGINT) AS ret_no, CASE sk % 3 WHEN 1 THEN 'float' WHEN 2 THEN 'price' ELSE 'Tuple[int' END AS return_type FROM fnb
UNION ALL SELECT path, func_no, CAST(1 AS BIGINT), 'str]' FROM fnb WHERE sk % 3 = 0
""")

ORACLE["py_classes"] = with_f1(r"""
SELECT path, CAST(0 AS BIGINT) AS class_no, class_name, 'brand:str,size:int' AS fields, class_name || '.' || method_name AS methods FROM cls
""")

ORACLE["py_interfaces"] = with_f1(r"""
SELECT path, CAST(0 AS BIGINT) AS iface_no, concat('I_', p) AS iface_name, CAST(0 AS BIGINT) AS method_no, 'go' AS method_name
FROM files WHERE ok AND p_size % 7 = 0
""")

ORACLE["py_type_text"] = with_f1(r"""
, t AS (SELECT 'param' AS site, 'int' AS type_text FROM fnb
        UNION ALL SELECT 'param', 'float' FROM fnb
        UNION ALL SELECT 'return', CASE sk % 3 WHEN 1 THEN 'float' WHEN 2 THEN 'price' ELSE 'Tuple[int' END FROM fnb
        UNION ALL SELECT 'return', 'str]' FROM fnb WHERE sk % 3 = 0
        UNION ALL SELECT 'field', 'str' FROM cls
        UNION ALL SELECT 'field', 'int' FROM cls)
SELECT site, type_text, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY site, type_text
""".replace("\n, t AS", ", t AS", 1))

ORACLE["py_body"] = with_f1("SELECT path, class_name, method_name, body FROM cls")

ORACLE["all_functions"] = with_f1(r"""
SELECT path, func_no, name, '(qty: int, price: float)' AS params_text,
       CASE sk % 3 WHEN 1 THEN 'float' WHEN 2 THEN '' ELSE 'Union[int, str]' END AS returns_text FROM fnb
UNION ALL SELECT f.path, CAST(f.nf AS BIGINT), concat('m_', f.p), '(self, x: int)', 'int' FROM files f WHERE ok AND p_size % 3 = 0
UNION ALL SELECT f.path, CAST(f.nf + CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS BIGINT), 'go', '(self, x: int)', 'str'
          FROM files f WHERE ok AND p_size % 7 = 0
""")

ORACLE["python_modules"] = with_f1(r"""
SELECT replace(regexp_replace(path, '\.py$', ''), '/', '.') AS module, CAST(1 AS BIGINT) AS n_files,
  CAST(CASE WHEN ok THEN nf ELSE 0 END AS BIGINT) AS n_functions,
  CAST(CASE WHEN ok AND p_size % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_classes
FROM files
""")

ORACLE["symbol_counts"] = with_f1(r"""
SELECT dir, count(*) AS n_files,
  CAST(sum(CASE WHEN ok AND p_size % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_classes,
  CAST(sum(CASE WHEN ok AND p_size % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_interfaces,
  CAST(sum(CASE WHEN ok THEN nf ELSE 0 END) AS BIGINT) AS n_functions
FROM files GROUP BY dir
""")

ORACLE["flatten_symbols"] = with_f1(r"""
SELECT path, 'function' AS kind, '' AS owner, name, CAST(2 AS BIGINT) AS n_params FROM fnb
UNION ALL SELECT path, 'method', class_name, method_name, 2 FROM cls
UNION ALL SELECT path, 'class', '', class_name, 0 FROM cls
UNION ALL SELECT path, 'interface_method', concat('I_', p), 'go', 2 FROM files WHERE ok AND p_size % 7 = 0
UNION ALL SELECT path, 'interface', '', concat('I_', p), 0 FROM files WHERE ok AND p_size % 7 = 0
""")

ORACLE["scan_code"] = with_f1(
    CANDIDATES
    + r"""
SELECT path FROM cand
WHERE ends_with(regexp_extract(path, '([^/]*)$', 1), '.py') AND NOT ends_with(regexp_extract(path, '([^/]*)$', 1), '_test.py')
  AND NOT contains(regexp_extract(path, '([^/]*)$', 1), 'test_case')
"""
)

ORACLE["skip_hidden"] = with_f1(CANDIDATES + r"SELECT path FROM cand WHERE NOT regexp_matches(path, '(^|/)\.[^/]+/')")

ORACLE["file_tree"] = with_f1(tree_sql(", tpaths AS (SELECT path FROM files)") + "SELECT * FROM nodes")

ORACLE["url_tree"] = "WITH " + tree_sql(URLS + ", tpaths AS (SELECT path FROM urls)") + "SELECT * FROM nodes"

ORACLE["collect_files"] = (
    "WITH " + tree_sql(URLS + ", tpaths AS (SELECT path FROM urls)") + "SELECT file_type, count(*) AS n FROM nodes WHERE file_type <> 'dir' GROUP BY 1"
)

ORACLE["detect_lang"] = with_f1(r"""
, dl AS (SELECT DISTINCT p, dir, list_extract(['.go', '.py', '.js', '.java', '.cpp', '.PY', '.txt'], CAST(p % 7 + 1 AS INTEGER)) AS ext FROM fr)
SELECT concat(dir, '/mod_', p, ext) AS path,
  CASE ext WHEN '.go' THEN 'go' WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.java' THEN 'java' WHEN '.cpp' THEN 'cpp' ELSE '' END AS code_type,
  CASE lower(ext) WHEN '.java' THEN 'java' WHEN '.py' THEN 'python' WHEN '.go' THEN 'go' ELSE 'generic' END AS analyzer
FROM dl
""".replace("\n, dl AS", ", dl AS", 1))

ORACLE["module_name"] = with_f1(r"""
, mp AS (SELECT path FROM files UNION ALL SELECT DISTINCT regexp_replace(path, 'mod_[0-9]+\.py$', '__init__.py') FROM files)
SELECT path, substr(path, 6) AS rel_path,
  CASE WHEN ends_with(path, '/__init__.py') THEN replace(regexp_replace(substr(path, 6), '/__init__\.py$', ''), '/', '.')
       ELSE replace(regexp_replace(substr(path, 6), '\.py$', ''), '/', '.') END AS module
FROM mp
""".replace("\n, mp AS", ", mp AS", 1))

ORACLE["import_edges"] = with_f1(E_IMP)
ORACLE["uses_function"] = with_f1(E_USES_FN)
ORACLE["uses_method"] = with_f1(E_USES_M)
ORACLE["dependency_edges"] = with_f1(", " + EDGES + " SELECT * FROM edges")
ORACLE["file_dependencies"] = with_f1(
    ", " + EDGES + " SELECT source_file, count(*) AS n_edges, count(DISTINCT target_file) AS n_targets FROM edges GROUP BY 1"
)
ORACLE["file_dependents"] = with_f1(
    ", " + EDGES + " SELECT target_file, count(*) AS n_edges, count(DISTINCT source_file) AS n_dependents, CAST(round(sum(weight), 6) AS DOUBLE) AS weight_sum"
    " FROM edges GROUP BY 1"
)
ORACLE["edge_endpoints"] = with_f1(
    ", "
    + EDGES
    + r"""
, known AS (SELECT path FROM files)
SELECT source_file, target_file, count(*) AS multiplicity
FROM edges WHERE source_file IN (SELECT path FROM known) AND target_file IN (SELECT path FROM known) GROUP BY 1, 2
"""
)
ORACLE["project_graph"] = with_f1(
    ", "
    + EDGES
    + r"""
SELECT f.path, 'py' AS file_type,
  CAST((SELECT count(*) FROM edges e WHERE e.source_file = f.path) AS BIGINT) AS n_out,
  CAST((SELECT count(*) FROM edges e WHERE e.target_file = f.path) AS BIGINT) AS n_in,
  NOT f.ok AS broken
FROM files f
"""
)
ORACLE["module_rollup"] = with_f1(rollup_sql(", tpaths AS (SELECT path FROM files)"))
ORACLE["url_rollup"] = "WITH " + rollup_sql(URLS + ", tpaths AS (SELECT path FROM urls)")
ORACLE["merge_type_stubs"] = with_f1("SELECT path, p_size <= 40 AS merged FROM files")
ORACLE["stub_merge_stats"] = with_f1(
    "SELECT CAST(count(*) FILTER (WHERE p_size <= 40) AS BIGINT) AS n_merged, CAST(count(*) FILTER (WHERE p_size > 40) AS BIGINT) AS n_failed FROM files"
)

# --------------------------------------------------------------------------- text

WS = r"[\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def trimws(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


RESP = r"""
WITH c AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, text, conv_id % 5 AS v,
                  list_extract(['python', 'java', ''], CAST(turn % 3 + 1 AS INTEGER)) AS lang
           FROM conversations WHERE role = 'assistant'),
r AS (SELECT *, CASE v WHEN 0 THEN concat('Here:', chr(10), '```python', chr(10), text, chr(10), '```', chr(10))
                       WHEN 1 THEN concat('```', chr(10), text, chr(10), '```')
                       WHEN 2 THEN concat(chr(9), chr(10), ' ', text, ' ', chr(10), chr(12288), chr(9))
                       WHEN 3 THEN concat('```python', chr(10), text, chr(10), '```', chr(10), 'and', chr(10), '```java', chr(10), 'class X {}', chr(10), '```')
                       ELSE concat('```python', chr(10), '```', text) END AS raw FROM c)
"""


def _extract(pattern: str) -> str:
    return f"CASE WHEN regexp_matches(raw, '{pattern}') THEN {trimws(f'regexp_extract(raw, {chr(39)}{pattern}{chr(39)}, 1)')} ELSE {trimws('raw')} END"


PY_FENCE = r"(?s)```(?:python)?\n(.*?)```"
ORACLE["preprocess"] = RESP + f"SELECT conv_id, turn, {trimws('raw')} AS code FROM r"
ORACLE["extract_python"] = RESP + f"SELECT conv_id, turn, {_extract(PY_FENCE)} AS code FROM r"
ORACLE["extract_by_lang"] = (
    RESP
    + "SELECT conv_id, turn, lang, CASE lang "
    + f"WHEN 'python' THEN {_extract(r'(?s)```python\n(.*?)```')} "
    + f"WHEN 'java' THEN {_extract(r'(?s)```java\n(.*?)```')} "
    + f"ELSE {_extract(r'(?s)```\n(.*?)```')} END AS code FROM r"
)

TEMPL = r"""
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn,
                  concat('File {fileName}', chr(10), '{code}', chr(10), 'End {fileName}') AS template,
                  CASE WHEN turn % 2 = 0 THEN concat(text, ' {fileName}') ELSE text END AS code,
                  concat('conv_', conv_id, '.py') AS file_name FROM conversations)
"""
ORACLE["fill_template"] = TEMPL + "SELECT conv_id, turn, replace(replace(template, '{code}', code), '{fileName}', file_name) AS prompt FROM t"
ORACLE["append_prompt"] = TEMPL + "SELECT conv_id, turn, concat(code, chr(10), '# role: ', turn) AS prompt FROM t"

CONTEXT = r"""
, fl AS (SELECT p, string_agg(concat('- f_', p, '_', sk, '(qty: int, price: float) -> ',
                   CASE sk % 3 WHEN 1 THEN 'float' WHEN 2 THEN 'price' ELSE 'Tuple[int, str]' END, chr(10)), '' ORDER BY sk) AS lst,
                 count(*) AS n FROM fr WHERE ok GROUP BY p),
ctx AS (SELECT f.path, concat('You are analyzing a file named ''', f.path, ''' from the module ''',
         replace(regexp_replace(f.path, '\.py$', ''), '/', '.'), '''.', chr(10), chr(10),
         CASE WHEN f.ok AND f.p_size % 3 = 0 THEN concat('The file contains 1 classes:', chr(10), chr(10), '- Class ''mod_', f.p, ''':', chr(10),
              '  Fields:', chr(10), '  - brand: str', chr(10), '  - size: int', chr(10), chr(10), '  Methods:', chr(10),
              '  - m_', f.p, '(self: Any, x: int) -> int', chr(10), chr(10)) ELSE '' END,
         CASE WHEN f.ok AND f.p_size % 7 = 0 THEN concat('The file contains 1 interfaces:', chr(10), chr(10), '- Interface ''I_', f.p, ''':', chr(10),
              '  Methods:', chr(10), '  - go(self: Any, x: int) -> str', chr(10), chr(10)) ELSE '' END,
         CASE WHEN f.ok THEN concat('The file contains ', fl.n, ' standalone functions:', chr(10), chr(10), fl.lst) ELSE '' END,
         chr(10), 'Please analyze this code structure and provide insights or answer questions about it.') AS context
        FROM files f LEFT JOIN fl ON f.p = fl.p)
"""
ORACLE["render_context"] = with_f1(CONTEXT + "SELECT path, context FROM ctx")
ORACLE["prompt_context"] = with_f1(
    CONTEXT
    + r"""
, req AS (SELECT path FROM files UNION ALL SELECT regexp_replace(path, '\.py$', '_test.py') FROM files)
SELECT req.path, concat('Write unit tests for ', req.path, '.', chr(10), coalesce(ctx.context, '')) AS prompt
FROM req LEFT JOIN ctx ON req.path = ctx.path
"""
)

DETECT = r"""
, dl AS (SELECT DISTINCT p, dir, list_extract(['.go', '.py', '.js', '.java', '.cpp', '.PY', '.txt'], CAST(p % 7 + 1 AS INTEGER)) AS ext FROM fr),
dp AS (SELECT concat(dir, '/mod_', p, ext) AS path,
  CASE ext WHEN '.go' THEN 'go' WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.java' THEN 'java' WHEN '.cpp' THEN 'cpp' ELSE '' END AS code_type
  FROM dl)
"""
ORACLE["test_path"] = with_f1(
    DETECT
    + r"""
SELECT path, code_type, CASE code_type WHEN 'go' THEN regexp_replace(path, '\.go$', '_test.go')
  WHEN 'python' THEN regexp_replace(path, '\.py$', '_test.py') WHEN 'javascript' THEN regexp_replace(path, '\.js$', '_test.js')
  WHEN 'java' THEN regexp_replace(path, '\.java$', 'Test.java') ELSE path END AS test_path FROM dp
"""
)
ORACLE["sym_test_name"] = with_f1(
    "SELECT path, concat('f_', p, '_', sk) AS func_name, concat(dir, '/mod_', p, '_f_', p, '_', sk, '_test_case_1.py') AS test_path FROM fr"
)
ORACLE["first_match"] = r"""
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(min(turn) AS BIGINT) AS turn, regexp_extract(arg_min(text, turn), '[A-Za-z]{4,}', 0) AS first_word
FROM conversations WHERE role = 'assistant' GROUP BY conv_id
"""

# --------------------------------------------------------------------------- attempts

ATT = r"""
WITH a AS (SELECT concat('src/u', user_id, '.py') AS source_path,
                  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS it,
                  value / 100 AS coverage, props AS report, event_type = 'error' AS is_error FROM events),
s AS (SELECT *, (is_error OR coverage >= 0.8 OR it >= 3) AS stop FROM a),
fs AS (SELECT source_path, min(it) FILTER (WHERE stop) AS stop_it FROM s GROUP BY 1),
c AS (SELECT s.*, fs.stop_it FROM s JOIN fs USING (source_path) WHERE fs.stop_it IS NULL OR s.it <= fs.stop_it)
"""
ORACLE["attempt_loop"] = ATT + r"""
SELECT source_path, CAST(count(*) AS BIGINT) AS attempts_used,
  CAST(CASE WHEN stop_it IS NULL THEN count(*) ELSE count(*) - 1 END AS BIGINT) AS iterations,
  greatest(0.0, coalesce(max(coverage) FILTER (WHERE NOT is_error), 0.0)) AS best_coverage,
  coalesce(arg_max(report, it) FILTER (WHERE NOT is_error), '') AS last_report,
  CASE WHEN stop_it IS NULL THEN 'open' WHEN bool_or(is_error AND it = stop_it) THEN 'error'
       WHEN max(coverage) FILTER (WHERE it = stop_it) >= 0.8 THEN 'passed' ELSE 'cap' END AS end_reason
FROM c GROUP BY source_path, stop_it
"""
ORACLE["active_tasks"] = (
    "WITH w AS (" + ORACLE["attempt_loop"] + ") SELECT end_reason, count(*) AS n_tasks FROM w GROUP BY 1"
)
ORACLE["feedback_prompt"] = ATT + r"""
, p AS (SELECT *, lag(report) OVER (PARTITION BY source_path ORDER BY it) AS prev FROM c)
SELECT source_path, it, CASE WHEN it = 0 THEN concat('Write tests for ', source_path)
  ELSE concat('Write tests for ', source_path, chr(10), 'Your code need to be improved, the report is following:', chr(10), coalesce(prev, ''), chr(10)) END AS prompt
FROM p
"""
ORACLE["best_coverage"] = ATT + r"""
SELECT source_path, it, coverage,
  greatest(0.0, coalesce(max(CASE WHEN NOT is_error THEN coverage END) OVER (PARTITION BY source_path ORDER BY it ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0)) AS best_so_far
FROM c
"""
ORACLE["bounded_queue"] = r"""
WITH t AS (SELECT concat('src/u', user_id, '.py') AS source_path, min(ts) AS submit_ts FROM events GROUP BY 1)
SELECT source_path, row_number() OVER (ORDER BY submit_ts, source_path) <= 10 AS accepted FROM t
"""
ORACLE["dedupe_outputs"] = with_f1(
    r"""
, af AS (SELECT path, dir, p, func_no, name FROM fnb
         UNION ALL SELECT f.path, f.dir, f.p, CAST(f.nf AS BIGINT), concat('m_', f.p) FROM files f WHERE ok AND p_size % 3 = 0
         UNION ALL SELECT f.path, f.dir, f.p, CAST(f.nf + CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS BIGINT), 'go' FROM files f WHERE ok AND p_size % 7 = 0),
tp AS (SELECT concat(dir, '/mod_', p, '_', name, '_test_case_1.py') AS test_path, path, func_no, name FROM af)
SELECT test_path, arg_max(path, func_no) AS path, max(func_no) AS func_no, arg_max(name, func_no) AS name FROM tp GROUP BY test_path
"""
)
ORACLE["new_submissions"] = (
    "WITH w AS ("
    + ORACLE["attempt_loop"]
    + r"""), req AS (SELECT DISTINCT concat('src/u', user_id, '.py') AS source_path FROM events WHERE event_type = 'signup')
SELECT source_path FROM req WHERE source_path NOT IN (SELECT source_path FROM w WHERE end_reason = 'open')"""
)

# --------------------------------------------------------------------------- store

OBJ = "SELECT CAST(c_custkey AS BIGINT) AS id, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer"
ORACLE["get_objects"] = "SELECT CAST(c_custkey AS BIGINT) AS id, c_name FROM customer"
ORACLE["add_property"] = f"SELECT *, CAST(NULL AS VARCHAR) AS c_comment FROM ({OBJ})"
ORACLE["object_by_id"] = f"SELECT * FROM ({OBJ}) WHERE id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"
ORACLE["file_by_path"] = with_f1(
    r"""
SELECT path, true AS found, CAST(CASE WHEN ok THEN nf ELSE 0 END AS BIGINT) AS n_functions FROM files
UNION ALL SELECT regexp_replace(path, '\.py$', '_test.py'), false, CAST(NULL AS BIGINT) FROM files
"""
)
ORACLE["nested_projection"] = with_f1(
    r"""
, fl AS (SELECT p, string_agg(concat('f_', p, '_', sk), ',' ORDER BY sk) AS lst FROM fr WHERE ok GROUP BY p)
SELECT f.path, replace(regexp_replace(f.path, '\.py$', ''), '/', '.') AS module,
  CASE WHEN f.ok AND f.p_size % 3 = 0 THEN concat('mod_', f.p) ELSE '' END AS class_names, coalesce(fl.lst, '') AS function_names
FROM files f LEFT JOIN fl ON f.p = fl.p
"""
)
ORACLE["to_document"] = r"""
SELECT CAST(c_custkey AS BIGINT) AS id,
  concat('{"id":', c_custkey, ',"name":"', c_name, '","nation":{"name":"', n_name, '","region":{"name":"', r_name, '"}}}') AS doc
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""
ORACLE["batch_insert"] = r"""
SELECT CAST(o_orderkey AS BIGINT) AS id, CASE WHEN o_orderkey IN (SELECT c_custkey FROM customer) THEN 'duplicate' ELSE 'inserted' END AS status
FROM orders WHERE o_orderpriority = '5-LOW'
"""
ORACLE["insert_object"] = r"""
SELECT CASE WHEN n_nationkey * 1000 IN (SELECT c_custkey FROM customer) THEN 'duplicate' ELSE 'inserted' END AS status, count(*) AS n
FROM nation GROUP BY 1
"""
CHANGES = r"""
ch AS (SELECT CAST(o_custkey AS BIGINT) AS id, o_orderdate, o_orderkey,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'replace' WHEN '2-HIGH' THEN 'delete' WHEN '3-MEDIUM' THEN 'patch'
              WHEN '4-NOT SPECIFIED' THEN 'patch' ELSE 'insert' END AS kind,
         CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN concat('R#', o_orderkey) END AS c_name,
         CASE WHEN o_orderpriority = '5-LOW' THEN CAST(0 AS BIGINT) END AS c_nationkey,
         CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW', '3-MEDIUM') THEN o_totalprice END AS c_acctbal,
         CASE WHEN o_orderpriority = '5-LOW' THEN o_orderpriority WHEN o_orderpriority = '4-NOT SPECIFIED' THEN o_orderstatus END AS c_mktsegment,
         o_orderpriority = '3-MEDIUM' AS has_bal, o_orderpriority = '4-NOT SPECIFIED' AS has_seg
       FROM orders)
"""
ORACLE["merge_update"] = (
    f"WITH obj AS ({OBJ}), "
    + CHANGES
    + r""",
b AS (SELECT id, c_acctbal AS v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM ch WHERE has_bal) WHERE rn = 1),
s AS (SELECT id, c_mktsegment AS v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM ch WHERE has_seg) WHERE rn = 1)
SELECT obj.id, obj.c_name, obj.c_nationkey, CASE WHEN b.id IS NOT NULL THEN b.v ELSE obj.c_acctbal END AS c_acctbal,
       CASE WHEN s.id IS NOT NULL THEN s.v ELSE obj.c_mktsegment END AS c_mktsegment
FROM obj LEFT JOIN b ON obj.id = b.id LEFT JOIN s ON obj.id = s.id
"""
)
ORACLE["replace_object"] = (
    f"WITH obj AS ({OBJ}), "
    + CHANGES
    + r""",
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM ch WHERE kind = 'replace') WHERE rn = 1)
SELECT * FROM obj WHERE id NOT IN (SELECT id FROM r)
UNION ALL SELECT id, c_name, CAST(NULL AS BIGINT), c_acctbal, CAST(NULL AS VARCHAR) FROM r
"""
)
ORACLE["delete_object"] = f"WITH obj AS ({OBJ}), " + CHANGES + " SELECT * FROM obj WHERE id NOT IN (SELECT id FROM ch WHERE kind = 'delete')"
ORACLE["apply_changes"] = (
    f"WITH obj AS ({OBJ}), "
    + CHANGES
    + r""",
lv AS (SELECT ch.*, last_value(CASE WHEN kind IN ('delete', 'insert') THEN kind END IGNORE NULLS)
         OVER (PARTITION BY id ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_life FROM ch),
ef AS (SELECT lv.*, CASE WHEN prev_life IS NULL THEN id IN (SELECT id FROM obj) ELSE prev_life = 'insert' END AS live_before FROM lv),
eff AS (SELECT * FROM ef WHERE (kind = 'insert' AND NOT live_before) OR (kind IN ('replace', 'patch') AND live_before)),
fl AS (SELECT id, kind FROM (SELECT id, kind, row_number() OVER (PARTITION BY id ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
       FROM ch WHERE kind IN ('delete', 'insert')) WHERE rn = 1),
ids AS (SELECT id FROM obj UNION SELECT id FROM ch),
alive AS (SELECT ids.id FROM ids LEFT JOIN fl ON ids.id = fl.id WHERE fl.kind = 'insert' OR (fl.kind IS NULL AND ids.id IN (SELECT id FROM obj))),
full_set AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
             FROM eff WHERE kind IN ('insert', 'replace')) WHERE rn = 1),
bal AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
        FROM eff WHERE kind IN ('insert', 'replace') OR has_bal) WHERE rn = 1),
seg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
        FROM eff WHERE kind IN ('insert', 'replace') OR has_seg) WHERE rn = 1)
SELECT a.id,
  CASE WHEN fs.id IS NOT NULL THEN fs.c_name ELSE obj.c_name END AS c_name,
  CASE WHEN fs.id IS NOT NULL THEN fs.c_nationkey ELSE obj.c_nationkey END AS c_nationkey,
  CASE WHEN bal.id IS NOT NULL THEN bal.c_acctbal ELSE obj.c_acctbal END AS c_acctbal,
  CASE WHEN seg.id IS NOT NULL THEN seg.c_mktsegment ELSE obj.c_mktsegment END AS c_mktsegment
FROM alive a LEFT JOIN obj ON a.id = obj.id LEFT JOIN full_set fs ON a.id = fs.id LEFT JOIN bal ON a.id = bal.id LEFT JOIN seg ON a.id = seg.id
"""
)

# --------------------------------------------------------------------------- paths and cover

ORACLE["py_paths"] = with_f1(
    r"""
SELECT path, func_no, CAST(0 AS BIGINT) AS path_no, CAST(0 AS BIGINT) AS pos, 'if_statement' AS kind, 'then' AS arm, concat('qty > ', p_size) AS text FROM fnb
UNION ALL SELECT path, func_no, 0, 1, 'return', '', CASE WHEN q >= 0 THEN concat('f_', q, '_', qs, '(qty, price)') ELSE 'ext_lib.run(qty)' END FROM fnb
UNION ALL SELECT path, func_no, 1, 0, 'if_statement', 'else', concat('qty > ', p_size) FROM fnb
UNION ALL SELECT path, func_no, 1, 1, 'return', '', 'price' FROM fnb
UNION ALL SELECT f.path, CAST(f.nf AS BIGINT), 0, 0, 'return', '', 'x' FROM files f WHERE ok AND p_size % 3 = 0
"""
)
ORACLE["distinct_branches"] = with_f1("SELECT path, func_no, CAST(1 AS BIGINT) AS n_branches FROM fnb")

COVER_INC = r"""
inc AS (SELECT DISTINCT CAST(o_custkey AS BIGINT) AS g, CAST(o_orderkey AS BIGINT) AS p, l_returnflag AS kind, CAST(l_linenumber AS BIGINT) AS pos
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""
ORACLE["argmax_pick"] = (
    "WITH "
    + COVER_INC
    + r"""
SELECT g, p FROM (SELECT g, p, row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, p) AS rn FROM inc GROUP BY g, p) WHERE rn = 1
"""
)


def _cover_rounds(n: int) -> str:
    parts = ["WITH " + COVER_INC + ", r0 AS MATERIALIZED (SELECT * FROM inc)"]
    for i in range(n):
        parts.append(
            f", k{i} AS MATERIALIZED (SELECT g, p FROM (SELECT g, p, row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, p) AS rn "
            f"FROM r{i} GROUP BY g, p) WHERE rn = 1)"
            f", c{i} AS (SELECT DISTINCT r.g, r.kind, r.pos FROM r{i} r JOIN k{i} k ON r.g = k.g AND r.p = k.p)"
            f", r{i + 1} AS MATERIALIZED (SELECT r.* FROM r{i} r ANTI JOIN c{i} c ON r.g = c.g AND r.kind = c.kind AND r.pos = c.pos)"
        )
    sel = " UNION ALL ".join(f"SELECT g, CAST({i} AS BIGINT) AS pick_no, p FROM k{i}" for i in range(n))
    return "".join(parts) + " " + sel


# Branch universe of F3 is (3 return flags) x (7 line numbers) = 21, so 21 rounds always finish.
ORACLE["min_path_cover"] = _cover_rounds(21)

ORACLE["describe_paths"] = with_f1(
    r"""
SELECT path, func_no, name, concat('Testcase 1 for ', name, '(qty: int, price: float)',
   CASE sk % 3 WHEN 1 THEN ' -> float' WHEN 2 THEN '' ELSE ' -> Union[int, str]' END, ':', chr(10),
   'test case where qty > ', p_size, ',', chr(10),
   'returns ''', CASE WHEN q >= 0 THEN concat('f_', q, '_', qs, '(qty, price)') ELSE 'ext_lib.run(qty)' END, '''') AS constraints FROM fnb
UNION ALL SELECT f.path, CAST(f.nf AS BIGINT), concat('m_', f.p), '' FROM files f WHERE ok AND p_size % 3 = 0
UNION ALL SELECT f.path, CAST(f.nf + CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS BIGINT), 'go', '' FROM files f WHERE ok AND p_size % 7 = 0
"""
)
ORACLE["generate"] = (
    TEMPL
    + r""", pr AS (SELECT conv_id, turn, replace(replace(template, '{code}', code), '{fileName}', file_name) AS prompt FROM t)
SELECT conv_id, turn, concat('Here you go:', chr(10), '```python', chr(10), '# ', length(prompt), chr(10), 'def test_generated():', chr(10),
  '    assert True', chr(10), '```', chr(10)) AS response, false AS failed FROM pr
"""
)
ORACLE["evaluate"] = (
    TEMPL
    + r""", pr AS (SELECT conv_id, turn, file_name, replace(replace(template, '{code}', code), '{fileName}', file_name) AS test_code FROM t)
SELECT conv_id, turn, CASE WHEN length(test_code) % 7 = 0 THEN NULL ELSE (length(test_code) % 100) / 100.0 END AS coverage,
  CASE WHEN length(test_code) % 7 = 0 THEN NULL ELSE concat('ran ', file_name) END AS report, length(test_code) % 7 = 0 AS failed FROM pr
"""
)

# --------------------------------------------------------------------------- streaming

ORACLE["stream_attempts"] = ORACLE["attempt_loop"]
ORACLE["stream_code_files"] = ORACLE["py_metadata"]

# --------------------------------------------------------------------------- sinks, J1

ORACLE["json_round_trip"] = with_f1(r"""
SELECT path, replace(regexp_replace(path, '\.py$', ''), '/', '.') AS module,
  CAST(CASE WHEN ok AND p_size % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_classes,
  CAST(CASE WHEN ok AND p_size % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_interfaces,
  CAST(CASE WHEN ok THEN nf ELSE 0 END AS BIGINT) AS n_functions
FROM files
""")
ORACLE["write_outputs"] = ORACLE["test_path"]
ORACLE["resolve_imports"] = with_f1(r"""
SELECT DISTINCT dir, CASE WHEN q >= 0 THEN concat('mod_', q) ELSE 'ext_lib' END AS module,
  CASE WHEN q >= 0 THEN concat(dir, '/mod_', q, '.py') ELSE 'ext_lib.py' END AS target_file
FROM fnb
""")

ORACLE["java_metadata"] = r"""
SELECT concat('jrepo/nation_', s_nationkey, '/S', s_suppkey, '.java') AS path, concat('nation_', s_nationkey) AS module,
  concat('S', s_suppkey) AS class_name, 'id:int,size:int,name:String' AS fields,
  concat('m', s_suppkey, '(int a,String b)->int') AS methods, '{ return a; }' AS bodies,
  concat('I', s_suppkey) AS iface_name, 'go(int x)->void' AS iface_methods
FROM supplier
"""

# --------------------------------------------------------------------------- T8 / N3 from row-derived sizes

FN_TEXT = r"""concat('def f_', p, '_', sk, '(qty: int, price: float)', CASE sk % 3 WHEN 1 THEN ' -> float' WHEN 2 THEN '' ELSE ' -> Union[int, str]' END, ':', chr(10),
  CASE WHEN q >= 0 THEN concat('    from mod_', q, ' import f_', q, '_', qs, chr(10), '    obj.m_', q, '(qty)', chr(10)) ELSE concat('    import ext_lib', chr(10)) END,
  '    if qty > ', p_size, ':', chr(10),
  CASE WHEN q >= 0 THEN concat('        return f_', q, '_', qs, '(qty, price)', chr(10)) ELSE concat('        return ext_lib.run(qty)', chr(10)) END,
  '    else:', chr(10), '        return price', chr(10), chr(10))"""

SYM_TEMPLATE_SQL = "concat('Generate unit tests for {file_name}.', chr(10), 'Path constraints:', chr(10), '{path_constraints}', chr(10), 'Source:', chr(10), '{code}', chr(10))"

SIZES = (
    r"""
, fx AS (SELECT p, sum(length(""" + FN_TEXT + r""")) AS fn_len, sum(length(""" + FN_TEXT + r""") - length(replace(""" + FN_TEXT + r""", chr(10), ''))) AS fn_nl
         FROM fr GROUP BY p),
cs AS (SELECT f.path, f.dir, f.p,
         CASE WHEN f.p % 17 = 0 THEN 13 ELSE 0 END + 62 + fx.fn_len
           + CASE WHEN f.p_size % 3 = 0 THEN length(concat('class mod_', f.p, ':', chr(10), '    brand: str', chr(10), '    size: int', chr(10), chr(10), '    def m_', f.p, '(self, x: int) -> int:', chr(10), '        return x', chr(10), chr(10))) ELSE 0 END
           + CASE WHEN f.p_size % 7 = 0 THEN length(concat('class I_', f.p, '(ABC):', chr(10), '    @abstractmethod', chr(10), '    def go(self, x: int) -> str:', chr(10), '        pass', chr(10))) ELSE 0 END AS content_len,
         CASE WHEN f.p % 17 = 0 THEN 1 ELSE 0 END + 3 + fx.fn_nl + CASE WHEN f.p_size % 3 = 0 THEN 7 ELSE 0 END + CASE WHEN f.p_size % 7 = 0 THEN 4 ELSE 0 END AS content_nl
       FROM files f JOIN fx ON f.p = fx.p),
dsc AS (SELECT path, func_no, name, concat('Testcase 1 for ', name, '(qty: int, price: float)',
          CASE sk % 3 WHEN 1 THEN ' -> float' WHEN 2 THEN '' ELSE ' -> Union[int, str]' END, ':', chr(10),
          'test case where qty > ', p_size, ',', chr(10),
          'returns ''', CASE WHEN q >= 0 THEN concat('f_', q, '_', qs, '(qty, price)') ELSE 'ext_lib.run(qty)' END, '''') AS constraints FROM fnb
        UNION ALL SELECT f.path, CAST(f.nf AS BIGINT), concat('m_', f.p), '' FROM files f WHERE ok AND p_size % 3 = 0
        UNION ALL SELECT f.path, CAST(f.nf + CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS BIGINT), 'go', '' FROM files f WHERE ok AND p_size % 7 = 0),
sz AS (SELECT d.path, d.func_no, d.name, cs.dir, cs.p,
         CAST(length(""" + SYM_TEMPLATE_SQL + r""") - 35 + length(d.constraints) + cs.content_len + length(d.path) AS BIGINT) AS n_chars,
         CAST(6 + length(d.constraints) - length(replace(d.constraints, chr(10), '')) + cs.content_nl AS BIGINT) AS n_lines
       FROM dsc d JOIN cs ON d.path = cs.path)
"""
)
ORACLE["sym_prompt"] = with_f1(SIZES + "SELECT path, func_no, n_chars, n_lines FROM sz")
ORACLE["sym_pipeline"] = with_f1(
    SIZES
    + r"""
SELECT concat(dir, '/mod_', p, '_', name, '_test_case_1.py') AS test_path, path, func_no,
       concat('# ', n_chars, chr(10), 'def test_generated():', chr(10), '    assert True') AS test_code
FROM sz
"""
)

# The submit / attempt state machine stepped event by event with a recursive CTE.
ORACLE["stream_dedupe"] = r"""
WITH RECURSIVE ev AS (
  SELECT source_path, kind, coverage, is_error,
         row_number() OVER (PARTITION BY source_path ORDER BY ts, seq, CASE kind WHEN 'submit' THEN 0 ELSE 1 END) AS rn
  FROM (SELECT concat('src/u', user_id, '.py') AS source_path, ts, event_id AS seq, 'attempt' AS kind, value / 100 AS coverage,
               event_type = 'error' AS is_error FROM events
        UNION ALL
        SELECT concat('src/u', user_id, '.py'), ts, event_id, 'submit', NULL, false FROM events WHERE event_type = 'signup')
),
st AS (
  SELECT source_path, CAST(0 AS BIGINT) AS rn, false AS started, false AS done, CAST(0 AS BIGINT) AS consumed,
         CAST(0 AS BIGINT) AS accepted, CAST(0 AS BIGINT) AS refused, CAST(0 AS BIGINT) AS tasks, 'open' AS reason
  FROM ev WHERE rn = 1
  UNION ALL
  SELECT s.source_path, e.rn,
    CASE WHEN e.kind = 'submit' OR NOT s.done THEN true ELSE s.started END,
    CASE WHEN e.kind = 'submit' THEN false WHEN s.done THEN true ELSE (e.is_error OR e.coverage >= 0.8 OR s.consumed >= 3) END,
    CASE WHEN e.kind = 'submit' THEN (CASE WHEN s.started AND NOT s.done THEN s.consumed ELSE 0 END)
         WHEN s.done THEN s.consumed ELSE s.consumed + 1 END,
    s.accepted + CASE WHEN e.kind = 'submit' AND NOT (s.started AND NOT s.done) THEN 1 ELSE 0 END,
    s.refused + CASE WHEN e.kind = 'submit' AND s.started AND NOT s.done THEN 1 ELSE 0 END,
    s.tasks + CASE WHEN e.kind = 'submit' AND NOT (s.started AND NOT s.done) THEN 1
                   WHEN e.kind = 'attempt' AND NOT s.done AND NOT s.started THEN 1 ELSE 0 END,
    CASE WHEN e.kind = 'submit' THEN (CASE WHEN s.started AND NOT s.done THEN s.reason ELSE 'open' END)
         WHEN s.done THEN s.reason
         WHEN e.is_error THEN 'error' WHEN e.coverage >= 0.8 THEN 'passed' WHEN s.consumed >= 3 THEN 'cap' ELSE 'open' END
  FROM st s JOIN ev e ON e.source_path = s.source_path AND e.rn = s.rn + 1
)
SELECT st.source_path, accepted, refused, tasks, reason AS end_reason
FROM st JOIN (SELECT source_path, max(rn) AS mx FROM ev GROUP BY 1) m ON st.source_path = m.source_path AND st.rn = m.mx
"""

ORACLE["java_module_rollup"] = "WITH " + rollup_sql(
    "jp AS (SELECT concat('jrepo/nation_', s_nationkey, '/S', s_suppkey, '.java') AS path FROM supplier), tpaths AS (SELECT path FROM jp)"
)

ORACLE["read_source"] = ORACLE["py_metadata"]

ORACLE["extends_by_path"] = r"""
WITH nb AS (SELECT DISTINCT s_nationkey AS n FROM supplier),
cls AS (SELECT concat('nrepo/n', n, '/Base', n, '.py') AS path, concat('nrepo/n', n) AS dir, concat('Base', n) AS class_name FROM nb
        UNION ALL
        SELECT concat('nrepo/n', s_nationkey, '/Base', s_nationkey, 'Child', s_suppkey, '.py'), concat('nrepo/n', s_nationkey), concat('C', s_suppkey) FROM supplier)
SELECT a.path AS source_file, b.path AS target_file, 'extends' AS type, a.class_name AS source_element, b.class_name AS target_element, CAST(0.9 AS DOUBLE) AS weight
FROM cls a JOIN cls b ON a.dir = b.dir AND a.path <> b.path AND a.class_name <> b.class_name AND contains(a.path, b.class_name)
"""

ORACLE["extends_candidates"] = with_f1(E_EXT + " UNION ALL SELECT * FROM (" + ORACLE["extends_by_path"] + ")")

ORACLE["sym_evaluate"] = with_f1(
    SIZES
    + r""", t AS (SELECT concat(dir, '/mod_', p, '_', name, '_test_case_1.py') AS test_path, path, func_no,
       length(concat('# ', n_chars, chr(10), 'def test_generated():', chr(10), '    assert True')) AS n FROM sz)
SELECT test_path, path, func_no, CASE WHEN n % 7 <> 0 THEN (n % 100) / 100.0 END AS coverage, CASE WHEN n % 7 <> 0 THEN concat('ran ', test_path) END AS report,
       n % 7 = 0 AS failed FROM t
"""
)

# The loop stepped task by task with a recursive CTE; prompts enter by their lengths only.
ORACLE["retry_loop"] = r"""
WITH RECURSIVE tasks AS (
  SELECT concat('src/doc_', doc_id, ext) AS path, concat('src/doc_', doc_id, t) AS test_path, x.lang, coalesce(text, '') AS code
  FROM documents JOIN (VALUES (0, '.py', '_test.py', 'python'), (1, '.js', '_test.js', 'javascript'), (2, '.java', 'Test.java', 'java')) x(r, ext, t, lang)
    ON ((doc_id % 3) + 3) % 3 = r
),
sized AS (
  SELECT path, test_path, lang, length(code) AS code_len,
         length(replace(replace(concat('Write tests for {fileName}:', chr(10), '{code}', chr(10)), '{code}', code), '{fileName}', path)) AS base_len FROM tasks
),
st AS (
  SELECT path, CAST(-1 AS BIGINT) AS it, base_len AS n, CAST(0 AS DOUBLE) AS best, '' AS report, CAST(NULL AS VARCHAR) AS test, CAST(NULL AS VARCHAR) AS reason FROM sized
  UNION ALL
  SELECT path, it + 1, base_len + 1 + length('Your code need to be improved, the report is following:') + 1 + length(new_report) + 1,
         CASE WHEN ok AND covered / 100.0 > best THEN covered / 100.0 ELSE best END, new_report,
         CASE WHEN n % 29 <> 0 THEN concat('# ', n, ' ', lang) END,
         CASE WHEN NOT ok THEN 'error' WHEN covered / 100.0 >= 0.8 THEN 'passed' WHEN it + 1 >= 3 THEN 'cap' END
  FROM (
    SELECT st.*, sized.base_len, sized.lang, n % 29 <> 0 AND n % 23 <> 0 AS ok, n * 37 % 101 % 95 AS covered,
           CASE WHEN n % 29 <> 0 AND n % 23 <> 0 THEN concat(n * 37 % 101 % 95, ' of 100 in ', test_path, ' (', code_len, ')', repeat(' ', n % 7)) ELSE report END AS new_report
    FROM st JOIN sized USING (path) WHERE reason IS NULL
  )
)
SELECT path AS source_path, it + 1 AS attempts_used, it AS iterations, best AS best_coverage, report AS last_report, test AS generated_test, reason AS end_reason
FROM st WHERE reason IS NOT NULL
"""

ORACLE["fan_counts"] = with_f1(
    ", " + EDGES + r""", ends AS (SELECT target_file AS path, 1 AS i, 0 AS o, weight AS w FROM edges UNION ALL SELECT source_file, 0, 1, weight FROM edges)
SELECT path, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out, round(sum(i * w), 6) AS w_in, round(sum(o * w), 6) AS w_out FROM ends GROUP BY path
"""
)

# Directories by their files' paths: every proper prefix of a path that ends before a slash.
DIRS = r""", up AS (SELECT path, unnest(generate_series(1, len(string_split(path, '/')) - 1)) AS k FROM files),
dirs AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:k], '/') AS m FROM up)
"""
ORACLE["modules"] = with_f1(
    DIRS + "SELECT m AS module_path, CASE WHEN contains(m, '/') THEN regexp_replace(m, '/[^/]*$', '') ELSE '' END AS parent_path, CAST(len(string_split(m, '/')) - 1 AS BIGINT) AS depth FROM dirs"
)
ORACLE["module_members"] = with_f1(
    DIRS
    + r""", things AS (SELECT path AS x, 'file' AS kind FROM files UNION ALL SELECT m, 'module' FROM dirs)
SELECT m AS module_path, x AS member, kind, CAST(len(string_split(x, '/')) - len(string_split(m, '/')) AS BIGINT) AS distance
FROM dirs JOIN things ON starts_with(x, m || '/')
"""
)
ORACLE["python_module_members"] = with_f1(r""", names AS (
  SELECT path, 'file' AS kind, path AS name FROM files UNION ALL SELECT path, 'function', name FROM fnb
  UNION ALL SELECT path, 'class', class_name FROM cls UNION ALL SELECT path, 'interface', concat('I_', p) FROM files WHERE ok AND p_size % 7 = 0)
SELECT replace(regexp_replace(path, '\.py$', ''), '/', '.') AS module, path, kind, name FROM names
""")

ORACLE["file_documents"] = with_f1(r""",
x AS (SELECT [{'name': 'self', 'type': 'Any'}, {'name': 'x', 'type': 'int'}] AS params),
fs AS (SELECT path, list({'name': name, 'parameters': [{'name': 'qty', 'type': 'int'}, {'name': 'price', 'type': 'float'}],
         'return_types': CASE sk % 3 WHEN 1 THEN ['float'] WHEN 2 THEN ['price'] ELSE ['Tuple[int', 'str]'] END, 'body': body} ORDER BY func_no) AS functions
       FROM fnb GROUP BY path),
docs AS (SELECT f.path, replace(regexp_replace(f.path, '\.py$', ''), '/', '.') AS module,
    CASE WHEN ok AND p_size % 3 = 0 THEN [{'name': concat('mod_', p), 'fields': [{'name': 'brand', 'type': 'str'}, {'name': 'size', 'type': 'int'}],
      'methods': [{'reciever': concat('mod_', p), 'function': {'name': concat('m_', p), 'parameters': params, 'return_types': ['int'], 'body': 'return x'}}]}] ELSE [] END AS classes,
    CASE WHEN ok AND p_size % 7 = 0 THEN [{'name': concat('I_', p), 'methods': [{'name': 'go', 'parameters': params, 'return_types': ['str'], 'body': 'pass'}]}] ELSE [] END AS interfaces,
    coalesce(functions, []) AS functions
  FROM files f LEFT JOIN fs ON fs.path = f.path, x)
SELECT path, CAST(to_json({'path': path, 'module': module, 'classes': classes, 'interfaces': interfaces, 'functions': functions}) AS VARCHAR) AS doc FROM docs
""")

ORACLE["stream_file_versions"] = "SELECT path, CAST(2 AS BIGINT) AS version, module, n_classes, n_functions, broken FROM (" + ORACLE["py_metadata"] + ")"
