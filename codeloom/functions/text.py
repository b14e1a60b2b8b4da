"""String, path and template functions as Column -> Column builders.

Everything here is a built-in Spark expression (JVM side, whole-stage
codegen); no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white-space set of Go's unicode.IsSpace (TrimSpace / Fields):
# \t \n \v \f \r space, U+0085, U+00A0, U+1680, U+2000..U+200A, U+2028, U+2029,
# U+202F, U+205F, U+3000.  Spark's trim() strips only U+0020, so we spell it out.
WS_CLASS = r"[\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# Characters that may occur in a Python identifier (letters, marks,
# digits, connector punctuation, plus the Other_ID_Start / Other_ID_Continue code
# points U+00B7, U+0387, U+1369..U+1371, U+1885, U+1886, U+19DA, U+2118, U+212E,
# U+309B, U+309C).  A superset is fine: it only lengthens the runs we enumerate.
IDENT_CLASS = (
    r"[\p{L}\p{N}\p{M}\p{Pc}\x{B7}\x{387}\x{1369}-\x{1371}\x{1885}\x{1886}"
    r"\x{19DA}\x{2118}\x{212E}\x{309B}\x{309C}]"
)

# Characters that may start a Python identifier (letters, letter
# numbers, underscore, Other_ID_Start).  Digits and marks cannot, so a suffix
# starting with one can never be a function or class name.
IDENT_START_CLASS = r"[\p{L}\p{Nl}_\x{1885}\x{1886}\x{2118}\x{212E}\x{309B}\x{309C}]"

# Fixed text of the feedback prompt appended on retries.
FEEDBACK_SENTENCE = "Your code need to be improved, the report is following:\n"
CONTEXT_TAIL = "\nPlease analyze this code structure and provide insights or answer questions about it."


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_ws(c) -> Column:
    """T1 preprocess: trim Unicode white space at both ends (Go TrimSpace)."""
    return F.regexp_replace(_c(c), rf"^{WS_CLASS}+|{WS_CLASS}+$", "")


def fields(c) -> Column:
    """Go strings.Fields: split on white-space runs, no empty fields.

    Runs are first collapsed to one space by ``regexp_replace`` (compiled
    once per task) and then split on a single space: ``split`` with a
    multi-character regex would recompile it for every row.  The text is
    named once: within a lambda an expression named twice is evaluated twice.
    """
    return F.array_remove(F.split(F.regexp_replace(_c(c), f"{WS_CLASS}+", " "), " "), "")


def dir_of(c) -> Column:
    """Go filepath.Dir for clean relative paths: '.' when there is no slash."""
    c = _c(c)
    return F.when(c.contains("/"), F.regexp_extract(c, r"^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def base_name(c) -> Column:
    return F.regexp_extract(_c(c), r"([^/]*)$", 1)


def ext_of(c) -> Column:
    """Go filepath.Ext: the suffix from the last dot of the last element, or ''."""
    return F.regexp_extract(base_name(c), r"(\.[^.]*)$", 1)


def join_path(d, name) -> Column:
    """filepath.Join(dir, name) for a clean dir and a plain name."""
    d = _c(d)
    return F.when(d == ".", name).otherwise(F.concat(d, F.lit("/"), name))


def detect_lang(path) -> Column:
    """Code type by case-sensitive suffix (go/python/javascript/java/cpp/'')."""
    p = _c(path)
    return (
        F.when(p.endswith(".go"), "go")
        .when(p.endswith(".py"), "python")
        .when(p.endswith(".js"), "javascript")
        .when(p.endswith(".java"), "java")
        .when(p.endswith(".cpp"), "cpp")
        .otherwise("")
    )


def analyzer_lang(path) -> Column:
    """Analyzer choice by lower-cased extension (java/python/go/generic)."""
    e = F.lower(ext_of(path))
    return F.when(e == ".java", "java").when(e == ".py", "python").when(e == ".go", "go").otherwise("generic")


def _quote_regex(s: str) -> str:
    return "\\Q" + s + "\\E" if s else ""


def extract_code(raw, lang: str | None = None) -> Column:
    """First fenced block, trimmed; otherwise the trimmed raw text.

    ``lang=None`` is the Python extractor (fence tag ``python`` optional);
    a string is the tagged extractor for that tag ('' = untagged fence).
    """
    raw = _c(raw)
    tag = "(?:python)?" if lang is None else _quote_regex(lang)
    pattern = rf"(?s)```{tag}\n(.*?)```"
    return F.when(raw.rlike(pattern), trim_ws(F.regexp_extract(raw, pattern, 1))).otherwise(trim_ws(raw))


def extract_code_by_column(raw, lang_col) -> Column:
    """T3 with a per-row language column: the tag is quoted into the pattern."""
    raw = _c(raw)
    lang_col = _c(lang_col)
    pattern = F.concat(F.lit("(?s)```"), F.when(lang_col == "", "").otherwise(F.concat(F.lit("\\Q"), lang_col, F.lit("\\E"))), F.lit("\n(.*?)```"))
    hit = F.call_function("regexp_extract", raw, pattern, F.lit(0))
    body = F.call_function("regexp_extract", raw, pattern, F.lit(1))
    return F.when(hit != "", trim_ws(body)).otherwise(trim_ws(raw))


def fill_template(template, code, file_name) -> Column:
    """T4: replace {code} then {fileName}, sequentially (so code text is also rewritten)."""
    return F.replace(F.replace(_c(template), F.lit("{code}"), _c(code)), F.lit("{fileName}"), _c(file_name))


def sym_prompt(template, constraints, code, file_name) -> Column:
    """Replace {path_constraints}, then {code}, then {file_name}."""
    t = F.replace(_c(template), F.lit("{path_constraints}"), _c(constraints))
    t = F.replace(t, F.lit("{code}"), _c(code))
    return F.replace(t, F.lit("{file_name}"), _c(file_name))


def line_count(c) -> Column:
    """Number of lines, counted by what the text loses without its line ends: no array of its lines is built."""
    return F.length(_c(c)) - F.length(F.replace(_c(c), F.lit("\n"), F.lit(""))) + 1


def append_prompt(base, extra) -> Column:
    """T5: append text to a prompt."""
    return F.concat(_c(base), _c(extra))


def feedback_prompt(base, iteration, last_report) -> Column:
    """Base on iteration 0; later base + sentence + last report."""
    return F.when(_c(iteration) == 0, _c(base)).otherwise(
        F.concat(_c(base), F.lit("\n" + FEEDBACK_SENTENCE), F.coalesce(_c(last_report), F.lit("")), F.lit("\n"))
    )


def test_path(path, code_type) -> Column:
    """Test file path by language (trailing extension replaced)."""
    p, t = _c(path), _c(code_type)
    return (
        F.when(t == "go", F.regexp_replace(p, r"\.go$", "_test.go"))
        .when(t == "python", F.regexp_replace(p, r"\.py$", "_test.py"))
        .when(t == "javascript", F.regexp_replace(p, r"\.js$", "_test.js"))
        .when(t == "java", F.regexp_replace(p, r"\.java$", "Test.java"))
        .otherwise(p)
    )


def sym_test_name(path, func_name, n=1) -> Column:
    """<base>_<func>_test_case_<n>.py in the source directory."""
    b = base_name(path)
    e = ext_of(path)
    stem = F.substring(b, F.lit(1), F.length(b) - F.length(e))
    n_col = n if isinstance(n, Column) else F.lit(n)
    name = F.concat(stem, F.lit("_"), _c(func_name), F.lit("_test_case_"), n_col.cast("string"), F.lit(".py"))
    return join_path(dir_of(path), name)


def relative_path(path, root: str) -> Column:
    """Path relative to root when it starts with root, else the base name."""
    p = _c(path)
    r = root.rstrip("/") + "/"
    return F.when(p.startswith(r), F.substr(p, F.lit(len(r) + 1))).otherwise(base_name(p))


def module_name(rel_path) -> Column:
    """Dotted module of a relative path; __init__ names its package."""
    rp = _c(rel_path)
    d = F.when(rp.contains("/"), F.regexp_extract(rp, r"^(.*)/[^/]*$", 1)).otherwise(F.lit(""))
    stem = F.regexp_extract(base_name(rp), r"^(\.*[^.].*?)(\.[^.]*)?$", 1)
    stem = F.when(stem == "", base_name(rp)).otherwise(stem)
    dotted = F.replace(d, F.lit("/"), F.lit("."))
    return (
        F.when(stem == "__init__", dotted)
        .when(d == "", stem)
        .otherwise(F.concat(dotted, F.lit("."), stem))
    )


def _s(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def signature(fn: Column) -> Column:
    """name(p: t, ...) [-> r1, r2] of a FUNCTION struct."""
    params = F.array_join(F.transform(fn["parameters"], lambda p: F.concat(_s(p["name"]), F.lit(": "), _s(p["type"]))), ", ")
    rets = F.when(F.size(fn["return_types"]) > 0, F.concat(F.lit(" -> "), F.array_join(fn["return_types"], ", "))).otherwise("")
    return F.concat(_s(fn["name"]), F.lit("("), params, F.lit(")"), rets)


def render_context(path, module, classes, interfaces, functions) -> Column:
    """English description of a File record (layout fixed by the reference)."""
    path, module, classes, interfaces, functions = map(_c, (path, module, classes, interfaces, functions))
    head = F.concat(
        F.lit("You are analyzing a file named '"),
        _s(path),
        F.lit("'"),
        F.when(_s(module) != "", F.concat(F.lit(" from the module '"), module, F.lit("'"))).otherwise(""),
        F.lit(".\n\n"),
    )

    def method_block(ms, getfn):
        return F.when(
            F.size(ms) > 0,
            F.concat(
                F.lit("  Methods:\n"),
                F.array_join(F.transform(ms, lambda m: F.concat(F.lit("  - "), signature(getfn(m)), F.lit("\n"))), ""),
                F.lit("\n"),
            ),
        ).otherwise("")

    cls = F.when(
        F.size(classes) > 0,
        F.concat(
            F.lit("The file contains "),
            F.size(classes).cast("string"),
            F.lit(" classes:\n\n"),
            F.array_join(
                F.transform(
                    classes,
                    lambda c: F.concat(
                        F.lit("- Class '"),
                        _s(c["name"]),
                        F.lit("':\n  Fields:\n"),
                        F.array_join(
                            F.transform(c["fields"], lambda f: F.concat(F.lit("  - "), _s(f["name"]), F.lit(": "), _s(f["type"]), F.lit("\n"))),
                            "",
                        ),
                        F.lit("\n"),
                        method_block(c["methods"], lambda m: m["function"]),
                    ),
                ),
                "",
            ),
        ),
    ).otherwise("")
    ifc = F.when(
        F.size(interfaces) > 0,
        F.concat(
            F.lit("The file contains "),
            F.size(interfaces).cast("string"),
            F.lit(" interfaces:\n\n"),
            F.array_join(
                F.transform(
                    interfaces,
                    lambda i: F.concat(F.lit("- Interface '"), _s(i["name"]), F.lit("':\n"), method_block(i["methods"], lambda m: m)),
                ),
                "",
            ),
        ),
    ).otherwise("")
    fns = F.when(
        F.size(functions) > 0,
        F.concat(
            F.lit("The file contains "),
            F.size(functions).cast("string"),
            F.lit(" standalone functions:\n\n"),
            F.array_join(F.transform(functions, lambda f: F.concat(F.lit("- "), signature(f), F.lit("\n"))), ""),
        ),
    ).otherwise("")
    return F.concat(head, cls, ifc, fns, F.lit(CONTEXT_TAIL))
