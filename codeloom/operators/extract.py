"""Corpus extraction: source files -> nested metadata rows.

One pass over a file, with a stack of its own, gives flat arrays in source order
(by lines if all of them are plain statements, else over the syntax tree): scopes (functions and classes at any depth), branch
nodes, leaves (branch node of every simple statement) and returned values.  A
scope names its parts by ranges and positions in these arrays.  The nested
records, the interface flag, the return types and the numbered paths are
put together from them with SQL array functions, file by file, without a shuffle.
"""

from __future__ import annotations

import ast
import gc
import keyword
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import types as T

from codeloom import schemas as S
from codeloom.functions.text import module_name

# Base names that make a class an interface, and the decorator name.
INTERFACE_BASES = ("ABC", "Protocol", "Interface")
ABSTRACT_DECORATOR = "abstractmethod"

# ---------------------------------------------------------------------------
# the pass over one file (plain Python, run inside Spark tasks)
# ---------------------------------------------------------------------------


def normalize_newlines(text: str) -> str:
    """Universal-newline translation, as a text-mode file read does."""
    if "\r" not in text:
        return text
    return text.replace("\r\n", "\n").replace("\r", "\n")


class _Spelling(ast.NodeTransformer):
    """Folds the parts of an annotation with a spelling of their own into names; ``unparse`` writes the rest."""

    SPELT = {
        ast.Constant: lambda n: str(n.value),
        ast.List: lambda n: "List",
        ast.Dict: lambda n: "Dict",
        ast.Tuple: lambda n: f"Tuple[{', '.join(map(type_text, n.elts))}]",
    }

    def visit(self, node):
        if spelt := self.SPELT.get(type(node)):
            return ast.Name(spelt(node))
        if isinstance(node, ast.Subscript):
            return ast.Subscript(self.visit(node.value), self.visit(node.slice))
        if isinstance(node, ast.Attribute) and not isinstance(node.value, (ast.Name, ast.Attribute)):
            return ast.Name(node.attr)
        return ast.Attribute(self.visit(node.value), node.attr) if isinstance(node, ast.Attribute) else node


def _plain_text(node: ast.expr) -> str | None:
    """``type_text`` of names, subscripts, attributes and folded parts without a tree of its own; None of any other expression."""
    kind = type(node)
    if kind is ast.Name:
        return node.id
    if spelt := _Spelling.SPELT.get(kind):
        return spelt(node)
    if kind is ast.Subscript:
        value, at = _plain_text(node.value), _plain_text(node.slice)
        return None if value is None or at is None else f"{value}[{at}]"
    if kind is ast.Attribute:
        value = _plain_text(node.value) if isinstance(node.value, (ast.Name, ast.Attribute)) else None
        return node.attr if not isinstance(node.value, (ast.Name, ast.Attribute)) else f"{value}.{node.attr}"
    return None


def type_text(annotation: ast.expr) -> str:
    """Annotation as text; expressions without a rule keep their source form."""
    text = _plain_text(annotation)
    return ast.unparse(_Spelling().visit(annotation)) if text is None else text


_MARKS = re.compile(r"""['"#()\[\]{}]""")  # what a parameter list is matched by


class _Source:
    """Source text with helpers to slice by ast (line, utf-8 byte column) positions."""

    def __init__(self, text: str):
        self.text = text
        self.lines = text.split("\n")
        self.starts = [0, *accumulate(map((1).__add__, map(len, self.lines)))]  # the offset of every line
        self.ascii = text.isascii()
        self._enc: dict[int, bytes] = {}

    def _at(self, lineno: int, col: int) -> int:
        """The offset of an ast position."""
        start = self.starts[lineno - 1]
        if self.ascii or self.lines[lineno - 1].isascii():
            return start + col
        b = self._enc.get(lineno)
        if b is None:
            b = self._enc[lineno] = self.lines[lineno - 1].encode("utf-8")
        return start + len(b[:col].decode("utf-8", errors="ignore"))

    def segment(self, node) -> str:
        if self.ascii:
            starts = self.starts
            return self.text[starts[node.lineno - 1] + node.col_offset : starts[node.end_lineno - 1] + node.end_col_offset]
        return self.text[self._at(node.lineno, node.col_offset) : self._at(node.end_lineno, node.end_col_offset)]

    def body(self, fn) -> str:
        """The lines after the one of ``def``, stripped."""
        return self.text[self.starts[fn.lineno] : max(self.starts[fn.lineno], self.starts[fn.end_lineno] - 1)].strip()

    def params_text(self, fn) -> str:
        """Text of the parameter list, parentheses included (matched, strings skipped)."""
        text, n = self.text, self.starts[fn.end_lineno] - 1
        i = text.find("(", self._at(fn.lineno, fn.col_offset), n)
        if i < 0:
            return ""
        depth, j = 0, i
        while mark := _MARKS.search(text, j, n):
            j, ch = mark.start(), mark.group()
            if ch in "'\"":
                q = text[j : j + 3] if text[j : j + 3] in ("'''", '"""') else ch
                j += len(q)
                while j < n and text[j : j + len(q)] != q:
                    j += 2 if text[j] == "\\" else 1
                j += len(q)
                continue
            if ch == "#":
                k = text.find("\n", j, n)
                if k < 0:
                    break
                j = k
                continue
            if ch in "([{":
                depth += 1
            else:
                depth -= 1
                if depth == 0:
                    return text[i : j + 1]
            j += 1
        return text[i:n]


_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_SCOPES = (*_FUNCTIONS, ast.ClassDef)
_COMPOUND = {
    *_SCOPES, ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.TryStar, ast.Match, ast.With, ast.AsyncWith
}
_MUTED = (None, None, None)  # a block that is no part of the paths around it


def _branches(st: ast.stmt, src: _Source) -> list[tuple[list, list[tuple]]]:
    """(block, labels in front of it) of a compound statement that is no scope, in source order."""
    match st:
        case ast.If():
            cond = src.segment(st.test)
            return [(block, [("if_statement", arm, cond)]) for arm, block in (("then", st.body), ("else", st.orelse))]
        case ast.For() | ast.AsyncFor():
            over = f"{src.segment(st.target)} in {src.segment(st.iter)}"
            return [(st.body, [("for_statement", "body", over)]), (st.orelse, [_MUTED])]
        case ast.While():
            return [(st.body, [("while_statement", "body", src.segment(st.test))]), (st.orelse, [_MUTED])]
        case ast.Try() | ast.TryStar():
            at = lambda arm: ("try_statement", arm, "")
            caught = [(h.body, [at("except"), ("except_clause", "except", src.segment(h.type) if h.type else "")]) for h in st.handlers]
            return [(st.body, [at("try")]), *caught, (st.orelse, [_MUTED]), (st.finalbody, [at("finally"), ("finally", "finally", "")])]
        case ast.Match():
            return [(case.body, []) for case in st.cases]
        case ast.With() | ast.AsyncWith():
            return [(st.body, [])]
    raise TypeError(type(st).__name__)


# One line of plain code: a statement or a header of names, dotted names, calls, subscripts, one-line strings, numbers and
# binary operators, a comment or nothing.  Whatever it matches is that statement in Python's grammar; lengths and nesting are
# bounded where the parser bounds them.
_NAME = rf"(?!(?:{'|'.join([*keyword.kwlist, '__debug__', '__future__'])})\b)[A-Za-z_]\w*+"
_DOTTED = rf"{_NAME}(?:\.{_NAME}){{0,20}}+"
_CONST = r"""(?:(?:0|[1-9][0-9]{0,30}+)(?:\.[0-9]{1,30}+)?+(?![\w.])|"[^"\\\n]*+"(?!")|'[^'\\\n]*+'(?!')|(?:True|False|None)\b)"""


def _list_of(item: str) -> str:
    return rf"(?:{item}(?:, ?{item})*+)?+"


_INNER = rf"(?:{_DOTTED}(?:\({_list_of(f'(?:{_DOTTED}|{_CONST})')}\))?+|{_CONST})"
_CALL = rf"\({_list_of(_INNER)}\)"
_ATOM = rf"(?:{_DOTTED}(?:{_CALL}(?:\.{_NAME}){{0,20}}+){{0,5}}+|{_CONST})"
_OPERATOR = r"(?: (?:and|or|in|not in|is not|is) | ?(?:==|!=|<=|>=|//|[-+*/%<>]) ?)"
_VALUE = rf"{_ATOM}(?:{_OPERATOR}{_ATOM}){{0,20}}+"
_TYPE = rf"(?:{_DOTTED}|None\b)"
for _ in range(2):
    _TYPE = rf"(?:{_DOTTED}(?:\[{_TYPE}(?:, ?{_TYPE})*+\])?+|None\b)"
_ALIASED = rf"(?: as {_NAME})?+"
_LINE = re.compile(
    rf"""( *+)(?:(?P<def>def (?P<def_name>{_NAME})(?P<def_params>\({_list_of(f"{_NAME}(?:: ?{_TYPE})?+")}\))(?: -> (?P<def_returns>{_TYPE}))?+:)"""
    rf"""|(?P<class>class (?P<class_name>{_NAME})(?:\((?P<class_bases>{_list_of(_DOTTED)})\))?+:)"""
    rf"""|(?P<if>if (?P<if_test>{_VALUE}):)|(?P<elif>elif (?P<elif_test>{_VALUE}):)|(?P<else>else:)"""
    rf"""|(?P<for>for (?P<for_target>{_NAME}) in (?P<for_iter>{_VALUE}):)|(?P<while>while (?P<while_test>{_VALUE}):)"""
    rf"""|(?P<return>return(?: (?P<value>{_VALUE}))?+)|(?P<mark>@(?P<mark_name>{_DOTTED})(?P<mark_call>{_CALL})?+)"""
    rf"""|(?P<field>(?P<field_name>{_NAME}): ?(?P<field_type>{_TYPE})(?: = {_VALUE})?+)"""
    rf"""|(?P<other>pass|break|continue|import {_DOTTED}{_ALIASED}|from {_DOTTED} import {_NAME}{_ALIASED}(?:, {_NAME}{_ALIASED})*+"""
    rf"""|{_DOTTED} ?[-+*/%]?= ?{_VALUE}|{_VALUE}))? *+(?:#[^\n]*+)?+(?:\n|\Z)""",
    re.ASCII,
)
_PARAM = re.compile(rf"({_NAME})(?:: ?({_TYPE}))?+", re.ASCII)
_LONE_CONST = re.compile(_CONST, re.ASCII)
_MAX_DEPTH = 60  # blocks in each other, arms of an ``elif`` chain included


class _Text:
    """A part of a plain line that is known by its text alone."""

    def __init__(self, text: str):
        self.text = text


class _PlainSource:
    """Segments of plain lines: the parts carry their text."""

    @staticmethod
    def segment(part) -> str:
        return part.text


def _plain_value(text: str):
    """The value of a plain ``return``: a name, a constant or a text."""
    if _LONE_CONST.fullmatch(text):
        out = ast.Constant(ast.literal_eval(text))
    elif text.isidentifier():
        out = ast.Name(text)
    else:
        return _Text(text)
    out.text = text
    return out


def _plain_type(text: str) -> str:
    """``type_text`` of a plain annotation."""
    head, _, inner = text.partition("[")
    if not inner:
        return text
    if "[" in inner:
        return type_text(ast.parse(text, mode="eval").body)
    parts = inner[:-1].split(",")
    return text if len(parts) == 1 else f"{head}[Tuple[{', '.join(map(str.strip, parts))}]]"


def _plain_params(text: str) -> list[dict]:
    """The parameters of a plain header, from the text between the parentheses."""
    if "[" in text:
        return [{"name": p[1], "type": p[2] and _plain_type(p[2])} for p in _PARAM.finditer(text)]
    pairs = (p.partition(":") for p in text.split(",")) if text else ()
    return [{"name": name.strip(), "type": kind.strip() or None} for name, _, kind in pairs]


class _Outline:
    """The flat arrays of one module.

    Branch nodes are interned by (parent, label), so equal paths of a function
    end at the same node.  ``chain`` lists a node's ancestors and itself; ``mute``
    is the depth of the last muted node among them, 0 without one.  A function
    outside of others starts at a new muted node, its base: the nodes from there
    to its end are those of its paths and of the functions in it.
    """

    def __init__(self, text: str):
        self.clear()
        if text.isascii() and "\0" not in text and self.read_lines(text):
            return
        self.clear()
        tree = ast.parse(text)
        self.src = _Source(text)
        # (statements left of a block, branch node, positions of the scopes it stands in directly, its class, scope that ends with it)
        todo: list[tuple] = [(iter(tree.body), 0, self.top, None, None)]
        while todo:
            block, at, siblings, cls, ending = todo[-1]
            for st in block:
                kind = type(st)
                if kind in _COMPOUND:
                    todo.extend(reversed(self.enter(st, at, siblings, cls)))
                    break
                if kind is ast.Return or cls is not None:
                    self.simple(st, at, cls)
                else:
                    self.leaves.append(at)
            else:
                todo.pop()
                if ending is not None:
                    self.end(ending)

    def clear(self) -> None:
        self.src = _PlainSource
        self.top: list[int] = []
        self.scopes: list[dict] = []
        self.nodes: list[dict] = [{"kind": None, "arm": None, "text": None, "chain": [], "mute": 0}]
        self.bases: list[int | None] = [None]
        self.known: dict[tuple, int] = {}
        self.leaves: list[int] = []
        self.values: list[str] = []

    def end(self, scope: dict) -> None:
        scope.update(leaves_to=len(self.leaves), values_to=len(self.values), nodes_to=len(self.nodes))

    def read_lines(self, text: str) -> bool:
        """Reads a module of plain lines without a syntax tree; False, with the arrays in part filled, if it has any other line.

        Takes only what the parser takes.  Arms are numbered in the order they come, so a node may have another number than from the tree.
        """
        # open blocks: indent (None: of the next line), branch node, positions of the scopes in it, its class, scope that ends with it,
        # depth, (branch node, condition, depth) of the ``if`` just before in it
        indent, at, siblings, cls, ending, depth, arm = 0, 0, self.top, None, None, 0, None
        outer: list[tuple] = []
        marks: list[str] | None = None
        pos, size, last, match = 0, len(text), 0, _LINE.match
        while pos < size:
            m = match(text, pos)
            if m is None:
                return False
            here, pos, kind = m.end(1) - pos, m.end(), m.lastgroup
            if kind is None:
                continue
            if marks is not None and (here != indent or kind not in ("def", "class", "mark")):
                return False
            if indent is None:
                if here <= outer[-1][0]:
                    return False
                indent = here
            while here < indent:
                if ending is not None:
                    self.end_lines(ending, text, last)
                indent, at, siblings, cls, ending, depth, arm = outer.pop()
            if here != indent:
                return False
            last = pos
            if kind == "other":
                self.leaves.append(at)
                arm = None
                continue
            if kind == "return":
                value = m["value"]
                self.simple(ast.Return(value and _plain_value(value)), at, cls)
                arm = None
                continue
            if kind == "field":
                if cls is None:
                    self.leaves.append(at)
                else:
                    self.simple(ast.AnnAssign(ast.Name(m["field_name"]), ast.Name(_plain_type(m["field_type"])), None, 1), at, cls)
                arm = None
                continue
            if kind == "mark":
                arm = None
                marks = [*(marks or []), *([m["mark_name"]] if m["mark_call"] is None and "." not in m["mark_name"] else [])]
                continue
            if depth > _MAX_DEPTH:
                return False
            before, arm = arm, (at, m["if_test"], depth) if kind == "if" else None
            if kind == "elif" or kind == "else":
                if before is None:
                    return False
                up, cond, depth_of_if = before
                up, deeper = self.node(up, ("if_statement", "else", cond)), depth_of_if + 1
                if kind == "elif":
                    arm = (up, m["elif_test"], deeper)
            outer.append((indent, at, siblings, cls, ending, depth, arm))
            indent, depth = None, depth + 1
            if kind == "def" or kind == "class":
                arm = None
                if siblings is not None:
                    siblings.append(len(self.scopes))
                if kind == "def":
                    if self.bases[at] is None:
                        at = self.add(at, _MUTED, len(self.nodes))
                    ending = self.plain_function(m, marks or [], at)
                    ending["body"] = pos
                    siblings, cls = None, None
                else:
                    ending = self.new_scope("ClassDef", m["class_name"], at)
                    ending["bases"] = [b.rpartition(".")[2] for b in re.split(", ?", m["class_bases"])] if m["class_bases"] else []
                    siblings, cls = ending["members"], ending
                self.scopes.append(ending)
                marks = None
                continue
            siblings, cls, ending = None, None, None
            if kind == "else":
                at, depth = up, deeper
            elif kind == "for":
                at = self.node(at, ("for_statement", "body", f"{m['for_target']} in {m['for_iter']}"))
            elif kind == "while":
                at = self.node(at, ("while_statement", "body", m["while_test"]))
            else:
                up, cond, depth = arm
                at, depth = self.node(up, ("if_statement", "then", cond)), depth + 1
            arm = None
        if indent is None or marks is not None:
            return False
        while outer:
            if ending is not None:
                self.end_lines(ending, text, last)
            indent, at, siblings, cls, ending, depth, arm = outer.pop()
        return True

    def end_lines(self, scope: dict, text: str, to: int) -> None:
        self.end(scope)
        if "body" in scope:
            scope["body"] = text[scope["body"] : to].strip()

    def plain_function(self, m: re.Match, marks: list[str], at: int) -> dict:
        out = self.new_scope("FunctionDef", m["def_name"], at)
        params, returns = m["def_params"], m["def_returns"]
        out["marks"], out["params_text"] = marks, params
        out["params"] = _plain_params(params[1:-1])
        out["returns"], out["returns_text"] = returns and _plain_type(returns), returns or ""
        return out

    def add(self, up: int, label: tuple, base: int | None) -> int:
        chain = [*self.nodes[up]["chain"], len(self.nodes)]
        mute = len(chain) if label is _MUTED else self.nodes[up]["mute"]
        self.nodes.append({"kind": label[0], "arm": label[1], "text": label[2], "chain": chain, "mute": mute})
        self.bases.append(base)
        return len(self.nodes) - 1

    def node(self, up: int, label: tuple) -> int:
        found = self.known.get((up, label))
        if found is None:
            found = self.known[up, label] = self.add(up, label, self.bases[up])
        return found

    def enter(self, st: ast.stmt, at: int, siblings: list | None, cls: dict | None) -> list[tuple]:
        """The blocks of a compound statement, to be gone through in order."""
        if isinstance(st, _SCOPES):
            if siblings is not None:
                siblings.append(len(self.scopes))
            if isinstance(st, _FUNCTIONS) and self.bases[at] is None:
                at = self.add(at, _MUTED, len(self.nodes))
            scope = self.scope(st, at)
            self.scopes.append(scope)
            members, owner = (scope["members"], scope) if isinstance(st, ast.ClassDef) else (None, None)
            return [(iter(st.body), at, members, owner, scope)]
        inner = []
        for block, labels in _branches(st, self.src):
            if block:
                end = at
                for label in labels:
                    end = self.node(end, label)
                inner.append((iter(block), end, None, None, None))
        return inner

    def simple(self, st: ast.stmt, at: int, cls: dict | None) -> None:
        if isinstance(st, ast.Return):
            if isinstance(st.value, ast.Name):
                self.values.append(st.value.id)
            elif isinstance(st.value, ast.Constant):
                self.values.append(type(st.value.value).__name__)
            at = self.node(at, ("return", "", self.src.segment(st.value) if st.value else ""))
        elif cls is not None and isinstance(st, ast.AnnAssign) and isinstance(st.target, ast.Name):
            cls["fields"].append({"name": st.target.id, "type": type_text(st.annotation)})
        self.leaves.append(at)

    def new_scope(self, kind: str, name: str, at: int) -> dict:
        return {
            "kind": kind, "name": name, "depth": len(self.nodes[at]["chain"]), "root": at, "base": self.bases[at],
            "leaves_from": len(self.leaves), "values_from": len(self.values), "members": [], "fields": [],
        }

    def scope(self, st, at: int) -> dict:
        out = self.new_scope(type(st).__name__, st.name, at)
        if isinstance(st, ast.ClassDef):
            out["bases"] = [getattr(b, "id", getattr(b, "attr", None)) for b in st.bases if isinstance(b, (ast.Name, ast.Attribute))]
            return out
        out["marks"] = [d.id for d in st.decorator_list if isinstance(d, ast.Name)]
        out["params"] = [{"name": a.arg, "type": a.annotation and type_text(a.annotation)} for a in st.args.args]
        out["params_text"] = self.src.params_text(st)
        out["returns"] = st.returns and type_text(st.returns)
        out["returns_text"] = self.src.segment(st.returns) if st.returns else ""
        out["body"] = self.src.body(st)
        return out


def outline(path: str, content) -> dict:
    """The flat arrays of a file; one that does not decode or parse has empty arrays and the error."""
    try:
        text = content.decode("utf-8") if isinstance(content, (bytes, bytearray)) else content
        o = _Outline(normalize_newlines(text))
        return {"path": path, "error": None, "top": o.top, "scopes": o.scopes, "nodes": o.nodes, "leaves": o.leaves, "values": o.values}
    except Exception as e:  # noqa: BLE001 - any failure is a per-file error row
        return {"path": path, "error": f"{type(e).__name__}: {e}", "top": [], "scopes": [], "nodes": [], "leaves": [], "values": []}


# ---------------------------------------------------------------------------
# Spark operators
# ---------------------------------------------------------------------------

_RAW_META = T.StructType([f for f in S.FILE_META.fields])

BRANCH = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("arm", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)
# A path lists positions in the branches of its function: labels in full would grow with depth times paths.
FUNCTION_PATHS = T.StructType(
    list(S.ALL_FUNCTIONS.fields[:5])
    + [
        T.StructField("branches", T.ArrayType(BRANCH)),
        T.StructField(
            "paths",
            T.ArrayType(T.StructType([T.StructField("path_no", T.LongType()), T.StructField("steps", T.ArrayType(T.IntegerType()))])),
        ),
    ]
)
OUTLINE = (
    "path string, error string, top array<int>, scopes array<struct<kind: string, name: string, depth: int, root: int, base: int, nodes_to: int, "
    "leaves_from: int, leaves_to: int, values_from: int, values_to: int, members: array<int>, fields: array<struct<name: string, type: string>>, "
    "bases: array<string>, marks: array<string>, params: array<struct<name: string, type: string>>, params_text: string, returns: string, "
    "returns_text: string, body: string>>, nodes array<struct<kind: string, arm: string, text: string, chain: array<int>, mute: int>>, "
    "leaves array<int>, values array<string>"
)


def _arrow_mapper(fn, spark_schema: T.StructType, files: int = 64):
    """``fn(path, content) -> rows`` over Arrow batches, given back some files at a time."""
    arrow_schema = to_arrow_schema(spark_schema)

    def convert(part: pa.RecordBatch) -> pa.RecordBatch | None:
        # Syntax trees hold no cycles: scanning them for some, over and over, takes longer than the walk.
        collecting = gc.isenabled()
        gc.disable()
        try:
            rows = [r for p, c in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for r in fn(p, c)]
            return pa.RecordBatch.from_pylist(rows, schema=arrow_schema) if rows else None
        finally:
            if collecting:
                gc.enable()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, files):
                if (out := convert(b.slice(at, files))) is not None:
                    yield out

    return run


def _as_corpus(corpus: DataFrame, path_col: str, content_col: str) -> DataFrame:
    return corpus.select(F.col(path_col).alias("path"), F.col(content_col).alias("content"))


def outlines(corpus: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """One row of flat arrays per file, on the partitioning of ``corpus``: a caller with few, full partitions splits them."""
    schema = T.StructType.fromDDL(OUTLINE)
    return _as_corpus(corpus, path_col, content_col).mapInArrow(_arrow_mapper(lambda p, c: [outline(p, c)], schema), schema)


def _part(values: str, start: Column, end: Column, kind: str) -> Column:
    """The elements ``start`` to ``end`` - 1 of an array, taken one by one: ``slice`` reads the whole array of the file for every function."""
    own = F.transform(F.sequence(start, end - 1), lambda i: F.get(values, i))
    return F.when(end > start, own).otherwise(F.array().cast(f"array<{kind}>"))


def _return_types(s: Column) -> Column:
    """The annotation, ``Union[...]`` split at ', '; else the returned names and constant types, sorted; else None."""
    union = F.split(F.substr(s["returns"], F.lit(7), F.length(s["returns"]) - 7), ", ")
    seen = F.array_sort(F.array_distinct(_part("values", s["values_from"], s["values_to"], "string")))
    inferred = F.when(F.size(seen) > 0, seen).otherwise(F.array(F.lit("None")))
    return F.when(s["returns"].isNull(), inferred).when(s["returns"].startswith("Union["), union).otherwise(F.array(s["returns"]))


def _function(s: Column) -> Column:
    params = F.transform(s["params"], lambda p: F.struct(p["name"].alias("name"), F.coalesce(p["type"], F.lit("Any")).alias("type")))
    return F.struct(s["name"].alias("name"), params.alias("parameters"), _return_types(s).alias("return_types"), s["body"].alias("body"))


def _direct(positions: Column, kind: type) -> Column:
    """The scopes of a kind among ``positions``."""
    return F.filter(F.transform(positions, lambda i: F.get("scopes", i)), lambda s: s["kind"] == kind.__name__)


def _is_interface(c: Column) -> Column:
    """A known base, or a method under the abstract decorator."""
    abstract = F.exists(_direct(c["members"], ast.FunctionDef), lambda m: F.array_contains(m["marks"], ABSTRACT_DECORATOR))
    return F.exists(c["bases"], lambda b: b.isin(*INTERFACE_BASES)) | abstract


def _meta(flat: DataFrame, *others: str) -> DataFrame:
    """File records of outlines; ``others`` are kept beside them.

    No cast to the schema: one that only lets more values be null rebuilds every nested record, element by element.
    """
    classes = _direct(F.col("top"), ast.ClassDef)
    record = {
        "module": module_name("path"),
        "classes": F.transform(
            F.filter(classes, lambda c: ~_is_interface(c)),
            lambda c: F.struct(
                c["name"].alias("name"),
                c["fields"].alias("fields"),
                F.transform(
                    _direct(c["members"], ast.FunctionDef), lambda m: F.struct(c["name"].alias("reciever"), _function(m).alias("function"))
                ).alias("methods"),
            ),
        ),
        "interfaces": F.transform(
            F.filter(classes, _is_interface),
            lambda c: F.struct(c["name"].alias("name"), F.transform(_direct(c["members"], ast.FunctionDef), _function).alias("methods")),
        ),
        "functions": F.transform(_direct(F.col("top"), ast.FunctionDef), _function),
    }
    return flat.select(*[record.get(f.name, F.col(f.name)).alias(f.name) for f in S.FILE_META.fields], *others)


def _paths(s: Column) -> Column:
    """The distinct branch paths of a function in source order, from its root down; empty ones left out."""
    leaves = _part("leaves", s["leaves_from"], s["leaves_to"], "int")
    own = F.filter(F.array_distinct(leaves), lambda n: (n != s["root"]) & (F.get("nodes", n)["mute"] <= s["depth"]))

    def steps(leaf: Column) -> Column:
        chain = F.get("nodes", leaf)["chain"]
        return F.transform(F.slice(chain, s["depth"] + 1, F.size(chain)), lambda n: n - s["base"])

    return F.transform(own, lambda leaf, i: F.struct(i.cast("long").alias("path_no"), steps(leaf).alias("steps")))


def _branches_of(s: Column) -> Column:
    own = F.sequence(s["base"], s["nodes_to"] - 1)  # never empty: the base is the first
    return F.transform(own, lambda n: F.struct(*[F.get("nodes", n)[c].alias(c) for c in BRANCH.names]))


def labels_of(steps: Column, branches: Column) -> Column:
    """The labels (pos, kind, arm, text) of one path."""
    return F.transform(
        steps, lambda n, k: F.struct(k.cast("long").alias("pos"), *[F.get(branches, n)[c].alias(c) for c in BRANCH.names])
    )


def _function_paths() -> Column:
    """X10 + C1: every function of a file at any depth, in source order."""
    found = F.filter("scopes", lambda s: s["kind"] != ast.ClassDef.__name__)
    return F.transform(
        found,
        lambda s, i: F.struct(
            F.col("path").alias("path"), i.cast("long").alias("func_no"), s["name"].alias("name"), s["params_text"].alias("params_text"),
            s["returns_text"].alias("returns_text"), _branches_of(s).alias("branches"), _paths(s).alias("paths"),
        ),
    )


def extract_metadata(corpus: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """``files(path, content)`` -> ``files_meta`` (File record + error).

    ``content`` may be STRING or BINARY (binaryFile source; decoded strictly
    as UTF-8, a decode failure is a per-file error).  ``module`` is derived
    from the (relative) path by a column expression.
    """
    return _meta(outlines(corpus, path_col, content_col))


def extract_function_paths(corpus: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """X10 + C1: one row per function definition at any depth, with all its distinct paths."""
    return outlines(corpus, path_col, content_col).select(F.inline(_function_paths()))


def extract_corpus(corpus: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """X1 + X10 + C1 from a single parse per file: File record plus ``fpaths``."""
    return _meta(outlines(corpus, path_col, content_col).withColumn("fpaths", _function_paths()), "fpaths")


def meta_of(combined: DataFrame) -> DataFrame:
    return combined.select(*[f.name for f in S.FILE_META.fields])


def function_paths_of(combined: DataFrame) -> DataFrame:
    return combined.select(F.inline("fpaths"))


def all_functions(function_paths: DataFrame) -> DataFrame:
    """Every function at any depth, pre-order: name, parameter and return text."""
    return function_paths.select("path", "func_no", "name", "params_text", "returns_text")


def path_labels(function_paths: DataFrame) -> DataFrame:
    """C1 long form: (path, func_no, path_no, pos, kind, arm, text)."""
    p = function_paths.select("path", "func_no", "branches", F.explode("paths").alias("p"))
    lab = p.select("path", "func_no", F.col("p.path_no").alias("path_no"), labels_of(F.col("p.steps"), F.col("branches")).alias("ls"))
    return lab.select("path", "func_no", "path_no", F.inline("ls"))


# ---------------------------------------------------------------------------
# flattening views over files_meta
# ---------------------------------------------------------------------------


def functions_of(meta: DataFrame) -> DataFrame:
    """One row per top-level function (func_no = position in the file)."""
    return meta.select("path", F.posexplode("functions").alias("func_no", "f")).select(
        "path", F.col("func_no").cast("long"), "f.name", "f.parameters", "f.return_types", "f.body"
    )


def parameters_of(meta: DataFrame) -> DataFrame:
    """One row per parameter of a top-level function."""
    f = functions_of(meta)
    return f.select("path", "func_no", F.col("name").alias("func_name"), F.posexplode("parameters").alias("param_no", "p")).select(
        "path", "func_no", "func_name", F.col("param_no").cast("long"), F.col("p.name").alias("param_name"), F.col("p.type").alias("param_type")
    )


def return_types_of(meta: DataFrame) -> DataFrame:
    """One row per return type of a top-level function."""
    f = functions_of(meta)
    return f.select("path", "func_no", F.col("name").alias("func_name"), F.posexplode("return_types").alias("ret_no", "return_type")).select(
        "path", "func_no", "func_name", F.col("ret_no").cast("long"), "return_type"
    )


def classes_of(meta: DataFrame) -> DataFrame:
    """One row per top-level (non-interface) class."""
    return meta.select("path", F.posexplode("classes").alias("class_no", "c")).select(
        "path", F.col("class_no").cast("long"), F.col("c.name").alias("class_name"), F.col("c.fields").alias("fields"), F.col("c.methods").alias("methods")
    )


def class_fields_of(meta: DataFrame) -> DataFrame:
    c = classes_of(meta)
    return c.select("path", "class_no", "class_name", F.posexplode("fields").alias("field_no", "f")).select(
        "path", "class_no", "class_name", F.col("field_no").cast("long"), F.col("f.name").alias("field_name"), F.col("f.type").alias("field_type")
    )


def class_methods_of(meta: DataFrame) -> DataFrame:
    c = classes_of(meta)
    return c.select("path", "class_no", "class_name", F.posexplode("methods").alias("method_no", "m")).select(
        "path",
        "class_no",
        "class_name",
        F.col("method_no").cast("long"),
        F.col("m.reciever").alias("reciever"),
        F.col("m.function.name").alias("method_name"),
        F.col("m.function.parameters").alias("parameters"),
        F.col("m.function.return_types").alias("return_types"),
        F.col("m.function.body").alias("body"),
    )


def interfaces_of(meta: DataFrame) -> DataFrame:
    """One row per interface method (interfaces without methods keep one row)."""
    i = meta.select("path", F.posexplode("interfaces").alias("iface_no", "i"))
    return i.select(
        "path", F.col("iface_no").cast("long"), F.col("i.name").alias("iface_name"), F.posexplode_outer("i.methods").alias("method_no", "m")
    ).select("path", "iface_no", "iface_name", F.col("method_no").cast("long"), F.col("m.name").alias("method_name"))


def symbols_of(meta: DataFrame) -> DataFrame:
    """P5: one row per symbol: kind, owner, name, n_params."""
    fn = functions_of(meta).select("path", F.lit("function").alias("kind"), F.lit("").alias("owner"), "name", F.size("parameters").alias("n_params"))
    me = class_methods_of(meta).select(
        "path", F.lit("method").alias("kind"), F.col("class_name").alias("owner"), F.col("method_name").alias("name"), F.size("parameters").alias("n_params")
    )
    cl = classes_of(meta).select("path", F.lit("class").alias("kind"), F.lit("").alias("owner"), F.col("class_name").alias("name"), F.lit(0).alias("n_params"))
    ifc = meta.select("path", F.explode("interfaces").alias("i"))
    im = ifc.select("path", F.lit("interface_method").alias("kind"), F.col("i.name").alias("owner"), F.explode("i.methods").alias("m")).select(
        "path", "kind", "owner", F.col("m.name").alias("name"), F.size("m.parameters").alias("n_params")
    )
    io = ifc.select("path", F.lit("interface").alias("kind"), F.lit("").alias("owner"), F.col("i.name").alias("name"), F.lit(0).alias("n_params"))
    out = fn.unionByName(me).unionByName(cl).unionByName(im).unionByName(io)
    return out.withColumn("n_params", F.col("n_params").cast("long"))


def symbol_counts(meta: DataFrame) -> DataFrame:
    """A1: number of classes / interfaces / functions per file."""
    return meta.select(
        "path",
        F.size("classes").cast("long").alias("n_classes"),
        F.size("interfaces").cast("long").alias("n_interfaces"),
        F.size("functions").cast("long").alias("n_functions"),
        F.col("error").isNotNull().alias("broken"),
    )
