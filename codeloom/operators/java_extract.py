"""Java declaration extraction (X11) as a corpus-wide Spark job.

Same shape as the Python extractor: ``files(path, content)`` ->
``mapInArrow`` -> the fixed File schema.  No Java grammar is available
offline, so the per-file helper is a small declaration scanner: comments,
string / char / text-block literals are blanked (positions kept), then a
brace-depth walk finds the declarations the File record needs:

* ``package a.b;`` -> module
* top-level ``class`` -> fields (one per declarator, with the declared type
  text) and methods (receiver ``""``, parameters ``Type name``, return type
  text, body text with braces); constructors, initializer blocks and nested
  types are skipped
* top-level ``interface`` -> methods with an empty body
* ``enum``, ``record`` and ``@interface`` declarations are skipped
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from codeloom import schemas as S
from codeloom.operators.extract import _arrow_mapper, _as_corpus, _RAW_META

# Java modifiers that may precede a member declaration.
MODIFIERS = frozenset(
    "public protected private static final abstract synchronized native transient volatile strictfp default sealed non-sealed".split()
)
_IDENT = r"[A-Za-z_$À-￿][\w$À-￿]*"


def blank_literals(src: str) -> str:
    """Replace comments and literal contents by spaces, keeping every offset."""
    out = list(src)
    i, n = 0, len(src)
    while i < n:
        c = src[i]
        if src.startswith("//", i):
            j = src.find("\n", i)
            j = n if j < 0 else j
            out[i:j] = " " * (j - i)
            i = j
        elif src.startswith("/*", i):
            j = src.find("*/", i + 2)
            j = n if j < 0 else j + 2
            out[i:j] = [ch if ch == "\n" else " " for ch in src[i:j]]
            i = j
        elif src.startswith('"""', i):
            j = src.find('"""', i + 3)
            j = n if j < 0 else j + 3
            out[i + 3 : j - 3] = [ch if ch == "\n" else " " for ch in src[i + 3 : j - 3]]
            i = j
        elif c in "\"'":
            j = i + 1
            while j < n and src[j] != c and src[j] != "\n":
                j += 2 if src[j] == "\\" else 1
            out[i + 1 : min(j, n)] = " " * (min(j, n) - i - 1)
            i = j + 1
        else:
            i += 1
    return "".join(out)


def _match_close(clean: str, i: int, open_ch: str, close_ch: str) -> int:
    depth = 0
    for j in range(i, len(clean)):
        if clean[j] == open_ch:
            depth += 1
        elif clean[j] == close_ch:
            depth -= 1
            if depth == 0:
                return j
    return len(clean) - 1


def _split_top(text: str, sep: str = ",") -> list[tuple[int, int]]:
    """Spans of ``text`` split on ``sep`` outside <>, (), [] and {}."""
    spans, depth, start = [], 0, 0
    for j, ch in enumerate(text):
        if ch in "<([{":
            depth += 1
        elif ch in ">)]}":
            depth -= 1
        elif ch == sep and depth == 0:
            spans.append((start, j))
            start = j + 1
    spans.append((start, len(text)))
    return spans


def _strip_prefix(text: str) -> str:
    """Drop annotations (with arguments) and modifiers in front of a declaration."""
    t = text.strip()
    while True:
        m = re.match(r"@\s*[\w.$]+\s*", t)
        if m:
            t = t[m.end() :]
            if t.startswith("("):
                t = t[_match_close(t, 0, "(", ")") + 1 :]
            t = t.strip()
            continue
        m = re.match(r"([\w-]+)(?:\s+|$)", t)
        if m and m.group(1) in MODIFIERS:
            t = t[m.end() :].strip()
            continue
        return t


def _params(src: str, clean: str, a: int, b: int) -> list[dict]:
    out = []
    inner = clean[a:b]
    for s, e in _split_top(inner):
        seg_clean = inner[s:e]
        if not seg_clean.strip() or "..." in seg_clean:
            continue  # varargs are spread parameters, not formal ones
        seg = _strip_prefix(src[a + s : a + e])
        m = re.match(rf"(.*?)\s*\b({_IDENT})\s*((?:\[\s*\])*)\s*$", seg, re.S)
        if not m:
            continue
        ptype = m.group(1).strip()
        if m.group(3):
            ptype = ptype + m.group(3).replace(" ", "")
        out.append({"name": m.group(2), "type": ptype})
    return out


def _members(src: str, clean: str, a: int, b: int, class_name: str, interface: bool):
    """Scan one type body (between its braces) for fields and methods."""
    fields, methods = [], []
    i, start = a, a
    while i < b:
        ch = clean[i]
        if ch == "(" and "=" not in clean[start:i]:
            i = _match_close(clean, i, "(", ")") + 1  # parameter lists / annotation arguments
            continue
        if ch == "{" or ch == ";" or ch == "=":
            head_clean = clean[start:i]
            if ch == "=":  # field with initializer: skip to the ';' at depth 0
                j, depth = i, 0
                while j < b and not (clean[j] == ";" and depth == 0):
                    if clean[j] in "({[":
                        depth += 1
                    elif clean[j] in ")}]":
                        depth -= 1
                    j += 1
                _field(src, clean, start, j, fields)
                i = start = j + 1
                continue
            paren = head_clean.find("(")
            kw = re.search(r"\b(class|interface|enum|record)\b", head_clean)
            if ch == "{" and (kw or not head_clean.strip() or _strip_prefix(head_clean) == ""):
                end = _match_close(clean, i, "{", "}")  # nested type or initializer block
                i = start = end + 1
                continue
            if paren >= 0:
                close = _match_close(clean, start + paren, "(", ")")
                decl = _strip_prefix(src[start : start + paren])
                decl = re.sub(r"^<[^>]*>\s*", "", decl)  # method type parameters
                m = re.match(rf"(.*?)\s*\b({_IDENT})\s*$", decl, re.S)
                body, end = "", i
                if ch == "{":
                    end = _match_close(clean, i, "{", "}")
                    body = src[i : end + 1]
                if m and m.group(1).strip():  # a return type: a method (constructors have none)
                    fn = {"name": m.group(2), "parameters": _params(src, clean, start + paren + 1, close), "return_types": [m.group(1).strip()], "body": "" if interface else body}
                    methods.append(fn if interface else {"reciever": "", "function": fn})
                i = start = end + 1
                continue
            if ch == ";":
                _field(src, clean, start, i, fields)
            i = start = i + 1
            continue
        i += 1
    return fields, methods


def _field(src: str, clean: str, a: int, b: int, fields: list) -> None:
    text = src[a:b]
    head = _strip_prefix(text)
    off = a + (len(text) - len(text.lstrip())) + (len(text.strip()) - len(head))
    decls = _split_top(clean[off:b])
    if not decls:
        return
    first_s, first_e = decls[0]
    m = re.match(rf"(.*?)\s*\b({_IDENT})\s*((?:\[\s*\])*)\s*(=.*)?$", src[off + first_s : off + first_e], re.S)
    if not m or not m.group(1).strip():
        return
    ftype = m.group(1).strip()
    fields.append({"name": m.group(2), "type": ftype})
    for s, e in decls[1:]:
        mm = re.match(rf"\s*({_IDENT})", src[off + s : off + e])
        if mm:
            fields.append({"name": mm.group(1), "type": ftype})


def parse_java(path: str, content) -> dict:
    """X11: one File record for a Java source file."""
    rec = {"path": path, "module": "", "classes": [], "interfaces": [], "functions": [], "error": None}
    try:
        src = content.decode("utf-8") if isinstance(content, (bytes, bytearray)) else content
        clean = blank_literals(src)
        i, start, n = 0, 0, len(clean)
        while i < n:
            ch = clean[i]
            if ch == ";":
                m = re.match(r"\s*package\s+([\w.\s]+?)\s*$", clean[start:i])
                if m:
                    rec["module"] = re.sub(r"\s+", "", src[start:i].strip()[len("package") :])
                start = i + 1
            elif ch == "{":
                head = clean[start:i]
                end = _match_close(clean, i, "{", "}")
                m = re.search(rf"\b(class|interface|enum|record)\s+({_IDENT})", head)
                if m and not re.search(r"@\s*interface", head):
                    kind, name = m.group(1), m.group(2)
                    if kind in ("class", "interface"):
                        fields, methods = _members(src, clean, i + 1, end, name, kind == "interface")
                        if kind == "class":
                            rec["classes"].append({"name": name, "fields": fields, "methods": methods})
                        else:
                            rec["interfaces"].append({"name": name, "methods": methods})
                i = start = end + 1
                continue
            i += 1
    except Exception as e:  # noqa: BLE001
        rec["error"] = f"{type(e).__name__}: {e}"
    return rec


def extract_java(corpus: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """X11: ``files(path, content)`` of Java sources -> File records (+ error)."""
    out = _as_corpus(corpus, path_col, content_col).mapInArrow(_arrow_mapper(lambda p, c: [parse_java(p, c)], _RAW_META), _RAW_META)
    return out.select(*[f.name for f in S.FILE_META.fields])
