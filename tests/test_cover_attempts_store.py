import random

from pyspark.sql import functions as F

from codeloom.operators import attempts as AT
from codeloom.operators import cover as CV
from codeloom.operators import extract as X
from codeloom.operators import store as ST


# --------------------------------------------------------------------------- A6 / W3 / T9


def _greedy(paths):
    """Plain sequential greedy: most new branches, ties -> lowest index."""
    universe = set().union(*paths.values()) if paths else set()
    covered, used, picks = set(), set(), []
    while covered != universe:
        best, best_n = None, 0
        for p in sorted(paths):
            if p in used:
                continue
            n = len(paths[p] - covered)
            if n > best_n:
                best, best_n = p, n
        if best is None:
            break
        picks.append(best)
        used.add(best)
        covered |= paths[best]
    return picks


def test_min_path_cover_equals_sequential_greedy(spark):
    rng = random.Random(3)
    rows, expected = [], {}
    for g in range(40):
        n_paths = rng.randint(1, 8)
        # group 0 is "hot": many paths
        if g == 0:
            n_paths = 60
        paths = {p: {(rng.choice("ab"), rng.randint(0, 5)) for _ in range(rng.randint(1, 4))} for p in range(n_paths)}
        expected[g] = _greedy(paths)
        rows += [(g, p, k, pos) for p, bs in paths.items() for (k, pos) in bs]
    inc = spark.createDataFrame(rows, "g long, p long, kind string, pos long")
    for unit in (1, 20, 50_000):  # the hot group alone, or all groups, dealt by component
        assert _by_group(CV.min_path_cover(inc, ["g"], "p", unit=unit)) == expected
    first = {r["g"]: r["p"] for r in CV.argmax_pick(inc, ["g"], "p").collect()}
    assert first == {g: v[0] for g, v in expected.items()}


def _by_group(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["g"], []).append((r["pick_no"], r["p"]))
    return {g: [p for _, p in sorted(v)] for g, v in got.items()}


def test_min_path_cover_first_picks(spark):
    rows = [(g, p, "if", 10 * p + b) for g in range(3) for p in range(6) for b in range(6 - p)]
    inc = spark.createDataFrame(rows, "g int, p int, kind string, pos int")
    for rounds in (0, 1, 3):
        assert _by_group(CV.min_path_cover(inc, ["g"], "p", max_rounds=rounds)) == ({g: list(range(rounds)) for g in range(3)} if rounds else {})


def test_min_path_cover_of_a_group_of_many_components(spark):
    """Gains tie within and across components, paths repeat branch sets, one chain is long; and the jobs do not grow with the picks."""
    rng = random.Random(9)
    paths, n = {}, 0
    for c in range(150):
        for _ in range(rng.randint(1, 5)):
            paths[n] = {("k", 100 * c + rng.randint(0, 6)) for _ in range(rng.randint(1, 5))}
            n += 1
    for i in range(200):  # a chain: each path shares a branch with the next
        paths[n + i] = {("chain", i), ("chain", i + 1)}
    order = list(paths)
    rng.shuffle(order)
    paths = {order[p]: bs for p, bs in paths.items()}
    rows = [(g, p, k, pos) for g in (0, 1) for p, bs in paths.items() for k, pos in bs]
    inc = spark.createDataFrame(rows, "g long, p long, kind string, pos long").repartition(4)
    want = _greedy(paths)
    assert len(want) > 200
    for unit in (1, 100, 50_000):  # dealt by component, or not: the same picks
        assert _by_group(CV.min_path_cover(inc, ["g"], "p", unit=unit)) == {0: want, 1: want}
    assert CV.min_path_cover(inc.limit(0), ["g"], "p").count() == 0


def test_describe_paths_default_and_arm_keys(spark):
    src = "def inferred(x) -> int:\n    if x:\n        return x\n    elif x is None:\n        return None\n    return 3\n\ndef plain(a):\n    a += 1\n"
    fp = X.extract_function_paths(spark.createDataFrame([("m.py", src)], "path string, content string"))
    labels = X.path_labels(fp)
    picks = CV.min_path_cover(CV.branch_incidence(labels), ["path", "func_no"])
    d = {r["name"]: r["constraints"] for r in CV.describe_paths(labels, picks, X.all_functions(fp)).collect()}
    assert d["inferred"] == "Testcase 1 for inferred(x) -> int:\ntest case where not(x),\nand x is None\nreturns 'None'"
    assert d["plain"] == ""
    picks2 = CV.min_path_cover(CV.branch_incidence(labels, keys=("kind", "pos", "arm")), ["path", "func_no"], keys=("kind", "pos", "arm"))
    d2 = {r["name"]: r["constraints"] for r in CV.describe_paths(labels, picks2, X.all_functions(fp)).collect()}
    assert d2["inferred"].split("\nTestcase 2")[1] == " for inferred(x) -> int:\ntest case where x,\nreturns 'x'"
    # the nested formulation gives the same texts
    for pk in (picks, picks2):
        a = {r["name"]: r["constraints"] for r in CV.describe_paths(labels, pk, X.all_functions(fp)).collect()}
        b = {r["name"]: r["constraints"] for r in CV.describe_functions(fp, pk).collect()}
        assert a == b


# --------------------------------------------------------------------------- W1 / A4 / W4 / W5


def _simulate(attempts, thr=0.8, max_it=3):
    consumed, best, last, done, reason = 0, 0.0, "", False, "open"
    for cov, rep, err in attempts:
        it = consumed
        consumed += 1
        if err:
            done, reason = True, "error"
            break
        last = rep
        best = max(best, cov)
        if cov >= thr:
            done, reason = True, "passed"
            break
        if it >= max_it:
            done, reason = True, "cap"
            break
    return consumed, consumed - 1 if done else consumed, best, last, reason


def _random_log(rng, n_keys, hot_rows):
    rows, seq = [], 0
    for k in range(n_keys):
        n = hot_rows if k == 0 else rng.randint(1, 6)
        for _ in range(n):
            seq += 1
            rows.append((f"k{k}", rng.randint(0, 10**6), seq, rng.random(), f"r{seq}", rng.random() < 0.15))
    return rows


def test_replay_equals_sequential_simulation(spark):
    rng = random.Random(11)
    rows = _random_log(rng, 60, hot_rows=3000)
    df = spark.createDataFrame(rows, "source_path string, t long, seq long, coverage double, report string, is_error boolean")
    df = df.withColumn("ts", F.timestamp_seconds("t"))
    got = {r["source_path"]: tuple(r[1:]) for r in AT.replay(df).collect()}
    by = {}
    for k, t, seq, cov, rep, err in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        by.setdefault(k, []).append((cov, rep, err))
    for k, att in by.items():
        used, iters, best, last, reason = _simulate(att)
        g = got[k]
        assert (g[0], g[1], round(g[2], 9), g[3], g[4]) == (used, iters, round(best, 9), last, reason), k


def test_replay_plan_limits_rows_per_key_before_shuffle(spark):
    df = spark.createDataFrame([("a", 1, 1, 0.1, "r", False)], "source_path string, t long, seq long, coverage double, report string, is_error boolean")
    df = df.withColumn("ts", F.timestamp_seconds("t"))
    plan = AT.replay(df)._jdf.queryExecution().executedPlan().toString()
    # partial (map-side) limit before the shuffle: a hot key ships <= k rows per map partition
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_bounded_queue_and_dedupe(spark):
    tasks = spark.createDataFrame([(f"p{i}", 100 - i) for i in range(30)], "source_path string, submit_ts long")
    acc = {r["source_path"] for r in AT.bounded_queue(tasks, 10).where("accepted").collect()}
    assert acc == {f"p{i}" for i in range(20, 30)}
    rows = spark.createDataFrame([("t", 1, "a"), ("t", 3, "c"), ("t", 2, "b"), ("u", 0, "z")], "test_path string, func_no long, name string")
    got = {r["test_path"]: r["name"] for r in AT.dedupe_outputs(rows).collect()}
    assert got == {"t": "c", "u": "z"}


# --------------------------------------------------------------------------- M1-M6


def _apply_sequential(init, changes, props):
    state = {k: dict(v) for k, v in init.items()}
    for ch in sorted(changes, key=lambda c: (c["id"], c["o"])):
        k, kind = ch["id"], ch["kind"]
        live = k in state
        if kind == "delete":
            state.pop(k, None)
        elif kind == "insert":
            if not live:
                state[k] = {p: ch[p] for p in props}
        elif kind == "replace" and live:
            state[k] = {p: ch[p] for p in props}
        elif kind == "patch" and live:
            for p in props:
                if ch[f"has_{p}"]:
                    state[k][p] = ch[p]
    return state


def test_apply_changes_equals_sequential(spark):
    rng = random.Random(5)
    props = ["a", "b"]
    init = {i: {"a": f"a{i}", "b": i * 1.0} for i in range(0, 40, 2)}
    changes = []
    for o in range(600):
        k = 0 if rng.random() < 0.3 else rng.randint(0, 50)  # id 0 is hot
        kind = rng.choice(["insert", "replace", "patch", "delete", "patch"])
        ha, hb = (rng.random() < 0.5, rng.random() < 0.5) if kind == "patch" else (False, False)
        changes.append({"id": k, "o": o, "kind": kind, "a": f"v{o}" if rng.random() < 0.9 else None, "b": float(o), "has_a": ha, "has_b": hb})
    expected = _apply_sequential(init, changes, props)
    table = spark.createDataFrame([(k, v["a"], v["b"]) for k, v in init.items()], "id long, a string, b double")
    ch = spark.createDataFrame(
        [(c["id"], c["o"], c["kind"], c["a"], c["b"], c["has_a"], c["has_b"]) for c in changes],
        "id long, o long, kind string, a string, b double, has_a boolean, has_b boolean",
    )
    got = {r["id"]: {"a": r["a"], "b": r["b"]} for r in ST.apply_changes(table, ch, "id", "o", props).collect()}
    assert got == expected


def test_single_operation_operators(spark):
    table = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0)], "id long, a string, b double")
    new = spark.createDataFrame([(2, "n", 0.0, 0), (3, "m", 3.0, 1), (3, "m2", 4.0, 2)], "id long, a string, b double, _seq long")
    t2, st = ST.batch_insert(table, new, "id", "_seq")
    assert sorted(tuple(r) for r in st.collect()) == [(2, "duplicate"), (3, "duplicate"), (3, "inserted")]
    assert {r["id"]: r["a"] for r in t2.collect()} == {1: "x", 2: "y", 3: "m"}
    patches = spark.createDataFrame([(1, 5, None, True), (1, 4, "old", True), (2, 1, "q", False)], "id long, o long, a string, has_a boolean")
    got = {r["id"]: r["a"] for r in ST.merge_update(table, patches, "id", "o", ["a"]).collect()}
    assert got == {1: None, 2: "y"}  # explicit null kept apart from an absent property
    rep = spark.createDataFrame([(1, 1, "r"), (9, 1, "unknown")], "id long, o long, a string")
    got = {r["id"]: (r["a"], r["b"]) for r in ST.replace_object(table, rep, "id", "o").collect()}
    assert got == {1: ("r", None), 2: ("y", 2.0)}
    assert [r["id"] for r in ST.delete_object(table, spark.createDataFrame([(1,)], "id long")).collect()] == [2]


def test_apply_changes_hot_id_is_folded_before_the_shuffle(spark):
    """A third of the log on one id, any split of the log into tasks: the sequential result, from few events."""
    rng = random.Random(12)
    props = ["a", "b"]
    init = {i: {"a": f"a{i}", "b": None} for i in range(0, 30, 3)}
    changes = []
    for o in range(9000):
        k = 3 if o % 3 == 0 else rng.randint(0, 40)
        kind = rng.choices(["insert", "replace", "patch", "delete"], [4, 3, 30, 0.2 if k == 3 else 4])[0]
        flags = (rng.random() < 0.5, rng.random() < 0.5) if kind == "patch" else (False, False)
        changes.append({"id": k, "o": o, "kind": kind, "a": f"v{o}" if rng.random() < 0.9 else None, "b": float(o), "has_a": flags[0], "has_b": flags[1]})
    want = _apply_sequential(init, changes, props)
    rng.shuffle(changes)
    rows = [(c["id"], c["o"], c["kind"], c["a"], c["b"], c["has_a"], c["has_b"]) for c in changes] + [(None, 1, "delete", None, None, False, False), (3, 5, None, None, None, None, None)]
    schema = "id long, o long, kind string, a string, b double, has_a boolean, has_b boolean"
    table = spark.createDataFrame([(k, v["a"], v["b"]) for k, v in init.items()], "id long, a string, b double")
    for parts in (1, 7):
        log = spark.createDataFrame(rows, schema).repartition(parts)
        got = {r["id"]: {"a": r["a"], "b": r["b"]} for r in ST.apply_changes(table, log, "id", "o", props).collect()}
        assert got == want
        folded = ST.fold_changes(log.withColumnRenamed("o", "_o"), "id", props)
        assert folded.where("id = 3").count() <= 5 * folded.rdd.getNumPartitions()
    # The raw log is scanned, cut down in its own task, and only then dealt by ranges.
    plan = folded._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "rangepartitioning(id" in plan and plan.count("MapInArrow") == 2 and "Join" not in plan
    empty = ST.apply_changes(table, log.limit(0), "id", "o", props)
    assert {r["id"] for r in empty.collect()} == set(init)
    # M4 and M6 agree: an unknown id stays unknown.
    one = spark.createDataFrame([(77, 1, "replace", "x", 1.0, False, False)], schema)
    assert ST.apply_changes(table, one, "id", "o", props).where("id = 77").count() == 0
    assert ST.replace_object(table, one.select("id", "o", "a", "b"), "id", "o").where("id = 77").count() == 0


def test_batch_insert_hot_id(spark):
    table = spark.createDataFrame([(1, "x")], "id long, a string")
    new = spark.createDataFrame([(7 if i % 2 else i, f"n{i}", i) for i in range(400)] + [(1, "late", 1000)], "id long, a string, at long")
    after, status = ST.batch_insert(table, new, "id", "at")
    got = {(r["id"], r["status"]): r["count"] for r in status.groupBy("id", "status").count().collect()}
    assert got[7, "inserted"] == 1 and got[7, "duplicate"] == 199 and got[1, "duplicate"] == 1 and got[2, "inserted"] == 1
    rows = {r["id"]: r["a"] for r in after.collect()}
    assert len(rows) == after.count() == 202 and rows[7] == "n1" and rows[1] == "x"
