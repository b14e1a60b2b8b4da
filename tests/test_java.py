from codeloom.operators.java_extract import blank_literals, parse_java

SRC = '''package com.example.app;

import java.util.*;

/** Doc with { braces } */
@Entity(name = "t")
public final class Order<T extends Comparable<T>> extends Base implements Runnable {
    private static final Map<String, List<Integer>> CACHE = new HashMap<>();
    protected int[] counts, totals;
    String label = "}{";
    char c = '{';

    static { CACHE.clear(); }

    public Order(int x) { this.x = x; }

    @Override
    public synchronized <R> List<R> map(final java.util.function.Function<T, R> fn, @NotNull String... rest) throws Exception {
        if (x > 0) { return null; }
        return new ArrayList<>();
    }

    abstract void hook(int a);

    class Inner { int hidden() { return 1; } }
    enum Kind { A, B }
}

interface Shape {
    double area();
    default String name(String prefix) { return prefix; }
}

enum Color { RED }
record Pair(int a, int b) {}
'''


def test_blank_literals_keeps_offsets():
    s = 'a = "x{"; // }\nb = \'{\';'
    out = blank_literals(s)
    assert len(out) == len(s) and "{" not in out and "}" not in out


def test_parse_java_declarations():
    rec = parse_java("src/Order.java", SRC)
    assert rec["error"] is None and rec["module"] == "com.example.app"
    assert [c["name"] for c in rec["classes"]] == ["Order"]
    order = rec["classes"][0]
    assert order["fields"] == [
        {"name": "CACHE", "type": "Map<String, List<Integer>>"}, {"name": "counts", "type": "int[]"},
        {"name": "totals", "type": "int[]"}, {"name": "label", "type": "String"}, {"name": "c", "type": "char"},
    ]
    names = [m["function"]["name"] for m in order["methods"]]
    assert names == ["map", "hook"]  # constructor, initializer, nested types skipped
    mp = order["methods"][0]["function"]
    assert mp["return_types"] == ["List<R>"]
    assert mp["parameters"] == [{"name": "fn", "type": "java.util.function.Function<T, R>"}]  # varargs skipped
    assert mp["body"].startswith("{") and mp["body"].endswith("}") and "ArrayList" in mp["body"]
    assert order["methods"][1]["function"]["body"] == "" and order["methods"][0]["reciever"] == ""
    assert [(i["name"], [(m["name"], m["return_types"], m["body"]) for m in i["methods"]]) for i in rec["interfaces"]] == [
        ("Shape", [("area", ["double"], ""), ("name", ["String"], "")])
    ]
