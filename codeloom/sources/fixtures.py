"""Deterministic fixtures derived from the driver tables by Spark.

Code and text are generated from table rows, then fed to the operators;
the oracle side (``codeloom.plans.oracle``) computes the expected answer
from the same rows without parsing anything.  Every fixture grows with
the tables it is derived from.

F1 code corpus, one file per part ``p`` (``repo/<type>/pkg_<p div 60>/mod_<p>.py``),
one function per distinct (part, supplier) pair of ``lineitem``:

    from abc import ABC, abstractmethod
    from typing import Union

    def f_<p>_<sk>(qty: int, price: float)<RET>:      RET by sk % 3: 1 -> float, 2 none, 0 -> Union[int, str]
        from mod_<q> import f_<q>_<qs>                 (q = next part of the directory; none: import ext_lib)
        obj.m_<q>(qty)                                 (only when q exists)
        if qty > <p_size>:
            return f_<q>_<qs>(qty, price)              (none: return ext_lib.run(qty))
        else:
            return price

    class mod_<p>:            when p_size % 3 = 0 (fields brand: str, size: int; method m_<p>)
    class I_<p>(ABC):         when p_size % 7 = 0 (abstract method go)

Files with p % 17 = 0 start with a line that does not parse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.session import read_table

FILES_PER_DIR_BLOCK = 60
HEADER = "from abc import ABC, abstractmethod\nfrom typing import Union\n\n"
BROKEN_LINE = "def broken(:\n"


def _s(c) -> F.Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def code_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generating rows of F1: (p, dir, path, p_size, sk, q, qs)."""
    pairs = read_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("sk")).distinct()
    part = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"), "p_type", "p_size")
    f = part.join(pairs, "p").withColumn(
        "dir",
        F.concat(F.lit("repo/"), F.lower("p_type"), F.lit("/pkg_"), _s(F.floor(F.col("p") / FILES_PER_DIR_BLOCK).cast("long"))),
    )
    d = f.groupBy("p", "dir", "p_size").agg(F.min("sk").alias("s1"))
    # Directories hold at most FILES_PER_DIR_BLOCK files, so this window is bounded.
    w = Window.partitionBy("dir").orderBy("p")
    nx = d.select(
        "p",
        F.coalesce(F.lead("p").over(w), F.lit(-1)).alias("q"),
        F.coalesce(F.lead("s1").over(w), F.lit(0)).alias("qs"),
    )
    return f.join(nx, "p").select(
        "p", "dir", F.concat("dir", F.lit("/mod_"), _s("p"), F.lit(".py")).alias("path"), "p_size", "sk", "q", "qs"
    )


def _function_text() -> F.Column:
    p, sk, q, qs, size = (_s(c) for c in ("p", "sk", "q", "qs", "p_size"))
    ret = F.when(F.col("sk") % 3 == 1, " -> float").when(F.col("sk") % 3 == 2, "").otherwise(" -> Union[int, str]")
    has_q = F.col("q") >= 0
    target = F.concat(F.lit("f_"), q, F.lit("_"), qs)
    return F.concat(
        F.lit("def f_"), p, F.lit("_"), sk, F.lit("(qty: int, price: float)"), ret, F.lit(":\n"),
        F.when(has_q, F.concat(F.lit("    from mod_"), q, F.lit(" import "), target, F.lit("\n    obj.m_"), q, F.lit("(qty)\n")))
        .otherwise("    import ext_lib\n"),
        F.lit("    if qty > "), size, F.lit(":\n"),
        F.when(has_q, F.concat(F.lit("        return "), target, F.lit("(qty, price)\n"))).otherwise("        return ext_lib.run(qty)\n"),
        F.lit("    else:\n        return price\n\n"),
    )


def code_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``code_corpus(path, dir, content)``, one row per generated Python file."""
    rows = code_rows(spark, sf_dir).withColumn("fn", _function_text())
    files = rows.groupBy("p", "dir", "path", "p_size").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sk", "fn"))), lambda x: x["fn"]), "").alias("fns")
    )
    p, size = _s("p"), F.col("p_size")
    cls = F.when(
        size % 3 == 0,
        F.concat(
            F.lit("class mod_"), p, F.lit(":\n    brand: str\n    size: int\n\n    def m_"), p,
            F.lit("(self, x: int) -> int:\n        return x\n\n"),
        ),
    ).otherwise("")
    ifc = F.when(
        size % 7 == 0,
        F.concat(F.lit("class I_"), p, F.lit("(ABC):\n    @abstractmethod\n    def go(self, x: int) -> str:\n        pass\n")),
    ).otherwise("")
    content = F.concat(F.when(F.col("p") % 17 == 0, BROKEN_LINE).otherwise(""), F.lit(HEADER), F.col("fns"), cls, ifc)
    return files.select("path", "dir", content.alias("content"))


def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page URLs without scheme, query and fragment, as slash paths."""
    pages = read_table(spark, sf_dir, "pages")
    stripped = F.regexp_replace(F.regexp_replace(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[?#].*$", "")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(stripped, "/+$", "").alias("path"))


def java_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one Java file per supplier: ``jrepo/nation_<n>/S<s>.java``.

    Package ``nation_<n>``; class ``S<s>`` with fields ``id, size`` (one
    declaration), ``name`` (initializer containing a brace), a constructor
    (must be ignored), method ``m<s>``; a comment with braces; interface
    ``I<s>`` with one abstract method.
    """
    s = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("s"), F.col("s_nationkey").cast("string").alias("n"))
    content = F.concat(
        F.lit("package nation_"), "n", F.lit(";\n\n// helper { not a brace }\n/* block } comment */\npublic class S"), "s", F.lit(" {\n"),
        F.lit("    private int id, size;\n    String name = \"x{\";\n    public S"), "s", F.lit("(int id) { this.id = id; }\n"),
        F.lit("    int m"), "s", F.lit("(int a, String b) { return a; }\n}\n\ninterface I"), "s", F.lit(" {\n    void go(int x);\n}\n"),
    )
    return s.select(F.concat(F.lit("jrepo/nation_"), "n", F.lit("/S"), "s", F.lit(".java")).alias("path"), content.alias("content"))


def inheritance_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per nation of a supplier, ``nrepo/n<n>/Base<n>.py`` with class ``Base<n>``; per
    supplier ``nrepo/n<n>/Base<n>Child<s>.py`` with class ``C<s>(Base<n>)``.  Child paths
    contain the base class name, so the path rule of the extends edges fires."""
    s = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("s"), F.col("s_nationkey").cast("string").alias("n"))
    d = F.concat(F.lit("nrepo/n"), F.col("n"))
    base = s.select("n").distinct().select(
        F.concat(d, F.lit("/Base"), "n", F.lit(".py")).alias("path"), F.concat(F.lit("class Base"), "n", F.lit(":\n    x: int\n")).alias("content")
    )
    child = s.select(
        F.concat(d, F.lit("/Base"), "n", F.lit("Child"), "s", F.lit(".py")).alias("path"),
        F.concat(F.lit("class C"), "s", F.lit("(Base"), "n", F.lit("):\n    y: int\n")).alias("content"),
    )
    return base.unionByName(child)
