"""Secret scans in SQL functions only: fixed patterns and a character Markov test (operator 7).

Base spans are the matches of three patterns.  On top of these, runs of
key-like characters are judged by two first-order character Markov models, one
of random strings and one of ordinary identifiers: a run is reported when the log-likelihood
ratio of its transitions speaks for random.  Both models are counted from
labelled samples: secrets matched by the patterns are the random class, the
name-like words and numbers of the sampled documents the ordinary class.  Everything is built
from Spark SQL expressions; there is no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import sealed, unsealed

# The patterns that define the base spans.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_="
SIZE = len(ALPHABET) + 1
RUN = "[A-Za-z0-9+/_=]{16,}"
# Letters, also joined by underscores, and digits at the end only: what names look like; and plain numbers.
ORDINARY = "(?<![A-Za-z0-9+/_=])(?:[A-Za-z]{2,}(?:_[A-Za-z]+)*[0-9]{0,4}|[0-9]{2,})(?![A-Za-z0-9+/_=])"
SPAN = "array<struct<start:int,end:int>>"
BLOCK = 512  # entries scanned, and characters cut, at a time
RESULTS = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "found")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, merge) -> Column:
    """All prefixes of the numbers ``values``, merged; ``merge`` is associative.

    Appending to an array copies it, so blocks are scanned on their own and raised by
    the blocks before them.
    """
    append = lambda acc, x: F.concat(acc, F.array(F.coalesce(merge(F.get(acc, F.size(acc) - 1), x), x)))
    scan = lambda xs: F.aggregate(xs, F.array().cast("array<int>"), append)
    block = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK)), lambda b: scan(F.slice(v, (b * BLOCK + 1).cast("int"), F.lit(BLOCK))))

    def raised(blocks: Column) -> Column:
        ends = scan(F.transform(blocks, lambda b: F.get(b, F.size(b) - 1)))
        before = F.concat(F.array(F.lit(None).cast("int")), ends)
        lift = lambda b, e: F.transform(b, lambda x: F.coalesce(merge(e, x), x))
        return F.flatten(F.filter(F.zip_with(blocks, before, lift), lambda b: b.isNotNull()))

    return _let(values, lambda v: F.when(F.size(v) > 0, _let(block(v), raised)).otherwise(v))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _max(a: Column, b: Column) -> Column:
    return F.when(a > b, a).otherwise(b)


def _min(a: Column, b: Column) -> Column:
    return F.when(a < b, a).otherwise(b)


def _spans(text: Column, pattern: str, keep) -> Column:
    """[(start, end)] in code points of the matches that ``keep`` accepts, leftmost first.

    The texts between matches and the matches alternate, so positions are the
    running sums of their lengths.  Texts without a match skip the second pass.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    # One text more lies between and around matches than there are matches.
    sizes = F.zip_with(found, between, lambda m, gap: F.struct((F.length(gap) + F.length(m)).alias("step"), F.length(m).alias("n"), (m.isNotNull() & keep(m)).alias("ok")))

    def placed(sizes: Column) -> Column:
        ends = _running(F.transform(sizes, lambda x: F.coalesce(x["step"], F.lit(0))), _sum)
        spans = F.zip_with(sizes, ends, lambda x, end: F.struct((end - x["n"]).alias("start"), end.alias("end"), x["ok"].alias("ok")))
        return F.transform(F.filter(spans, lambda s: s["ok"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    return F.when(F.size(found) > 0, _let(sizes, placed)).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> dict[str, Column]:
    return {
        "assign": _spans(text, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8),
        "access": _spans(text, ACCESS, lambda m: F.lit(True)),
        "hex": _spans(text, HEX, lambda m: F.lit(True)),
    }


def _codes(word: Column) -> Column:
    return F.transform(F.split(word, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def _transitions(words: DataFrame) -> list[float]:
    """Counts of the SIZE * SIZE transitions in the column ``word``."""
    codes = words.select(_codes(F.col("word")).alias("c")).filter("size(c) > 1")
    pairs = codes.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.get("c", i) * SIZE + F.get("c", i + 1))).alias("p"))
    counts = dict(pairs.groupBy("p").count().collect())  # SIZE * SIZE rows at most
    return [float(counts.get(p, 0)) for p in range(SIZE * SIZE)]


def fit(docs: DataFrame, rows: int = 8000) -> list[float]:
    """Log-likelihood ratio (random over ordinary) of each transition.

    Labelled rows: at most ``rows`` documents, those of least hash of their id.
    The random class is smoothed by uniform transitions, worth as much as its
    own counts, since keys come in other alphabets than the sampled ones; the
    ordinary class backs off to its single characters.
    """
    import math

    chosen = docs.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id").select("text")
    value = F.transform(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), lambda m: m)
    secrets = F.concat(value, F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("text", F.lit(HEX), F.lit(0)))
    random = sample.select(F.explode(secrets).alias("word")).filter("length(word) >= 8")
    rest = F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), f"{ACCESS}|{HEX}", " ")
    words = sample.select(F.explode(F.regexp_extract_all(rest, F.lit(ORDINARY), F.lit(0))).alias("word"))
    a, b = _transitions(random), _transitions(words)
    known = range(1, SIZE)
    table = [0.0] * (SIZE * SIZE)
    ends = [sum(b[x * SIZE + y] for x in known) + 0.5 for y in range(SIZE)]
    chars = [e / sum(ends[1:]) for e in ends]
    for x in known:
        at = x * SIZE
        na, nb = sum(a[at + 1 : at + SIZE]), sum(b[at + 1 : at + SIZE])
        weight = max(na, 1.0) / (SIZE - 1)
        for y in known:
            p = (a[at + y] + weight) / (na + weight * (SIZE - 1))
            q = (b[at + y] + 5 * chars[y]) / (nb + 5)
            table[at + y] = math.log(p / q)
    return table


def likelihood_ratio(word: Column, table: list[float]) -> Column:
    """Summed log-likelihood ratio of the transitions of ``word``, in nats."""
    scores = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")
    score = lambda a, b: F.coalesce(F.get(scores, a * SIZE + b), F.lit(0.0))
    steps = lambda codes: F.zip_with(codes, F.slice(codes, F.lit(2), F.size(codes)), score)
    return F.aggregate(_let(_codes(word), steps), F.lit(0.0), lambda acc, x: acc + x)


def _ranked(spans, rank: int) -> Column:
    """Spans as (start, rank, end): their sort order."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end")))


def _free(base: Column, runs: Column) -> Column:
    """The ``runs`` that overlap no ``base`` span; both are (start, rank, end), runs of the higher rank.

    In order of start, a run is free if the base spans before it end by its start and those behind it
    start at its end or later.
    """

    def judged(spans: Column) -> Column:
        ends = _running(F.transform(spans, lambda s: F.when(s["rank"] < 3, s["end"]).otherwise(0)), _max)
        back = F.transform(F.reverse(spans), lambda s: F.when(s["rank"] < 3, s["start"]).otherwise(2**31 - 1))
        starts = F.reverse(_running(back, _min))
        sides = F.zip_with(ends, starts, lambda e, b: F.struct(e.alias("before"), b.alias("behind")))
        free = lambda s, x: F.when((s["rank"] == 3) & (x["before"] <= s["start"]) & (x["behind"] >= s["end"]), s)
        return F.filter(F.zip_with(spans, sides, free), lambda s: s.isNotNull())

    return F.when((F.size(base) == 0) | (F.size(runs) == 0), runs).otherwise(_let(F.array_sort(F.concat(base, runs)), judged))


def _scan(docs: DataFrame, rows: int, nats: float, nats_per_char: float) -> DataFrame:
    """``docs``, sealed, with the results."""
    table = fit(docs, rows)
    text = F.coalesce(F.col("text"), F.lit(""))
    frame = docs.withColumns({f"__{k}": s for k, s in base_spans(text).items()})
    base = F.concat(*[_ranked(f"__{k}", n) for n, k in enumerate(KINDS[:3])])
    frame = frame.withColumn("__base", F.array_sort(base))
    run = _spans(text, RUN, lambda m: likelihood_ratio(m, table) >= F.greatest(F.lit(nats), F.length(m) * nats_per_char))
    frame = frame.withColumn("__run", _ranked(run, 3))
    frame = frame.withColumn("__added", _free(F.col("__base"), F.col("__run")))
    frame = frame.withColumn("__all", F.when(F.size("__added") > 0, F.array_sort(F.concat("__base", "__added"))).otherwise(F.col("__base")))
    names = F.array(*map(F.lit, KINDS))
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")
    results = {
        "n_assign": F.size("__assign").cast("long"),
        "n_access": F.size("__access").cast("long"),
        "n_hex": F.size("__hex").cast("long"),
        "base_sha256": F.sha2(line(F.col("__base")).cast("binary"), 256),
        "spans": line(F.col("__all")),
        "found": F.transform("__all", lambda s: F.struct(F.get(names, s["rank"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))),
    }
    return frame.select(*docs.columns, *[c.alias(k) for k, c in results.items()])


def scan_secrets(docs: DataFrame, rows: int = 8000, nats: float = 10.0, nats_per_char: float = 0.5) -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, base_sha256, spans and found (an array of kind, start, end).

    A run of 16 or more key characters that overlaps no base span is added as
    kind ``markov`` if its log-likelihood ratio is at least ``nats`` and
    ``nats_per_char`` a character.  Null and empty texts have no spans (and the
    digest of the empty string).  Rows, repeated ones too, pass one to one with
    their other columns; columns named like the results, in any case, are replaced.
    Time grows with the length of a text, also of one run or very many matches.
    An empty table gives an empty result.
    """
    seen, inner = sealed(docs, "doc_id", "text")
    return _scan(seen, rows, nats, nats_per_char).select(*unsealed(inner, RESULTS), *RESULTS)


def _cut(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with its ``spans``, sorted and merged where they overlap, replaced by ``mark``.

    A character's place in a text takes a walk to find, so the text is cut into blocks first.
    """

    def piece(blocks: Column, p: Column) -> Column:
        parts = F.sequence(F.floor(p["at"] / BLOCK).cast("int"), F.floor((p["to"] - 1) / BLOCK).cast("int"))
        first = lambda k: F.greatest(p["at"] - k * BLOCK, F.lit(0))
        part = lambda k: F.substr(F.get(blocks, k), first(k) + 1, F.least(p["to"] - k * BLOCK, F.lit(BLOCK)) - first(k))
        return F.when(p["at"] < p["to"], F.array_join(F.transform(parts, part), "")).otherwise("")

    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text)))
    ends = F.concat(F.array(F.lit(0)), _running(F.transform(spans, lambda s: s["end"]), _max))
    pieces = F.filter(F.zip_with(ends, starts, lambda a, b: F.struct(a.alias("at"), b.alias("to"))), lambda p: p["to"] >= p["at"])
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return _let(blocks, lambda b: F.array_join(F.transform(pieces, lambda p: piece(b, p)), mark))


def redact(docs: DataFrame, mark: str = "[secret]", rows: int = 8000, nats: float = 10.0, nats_per_char: float = 0.5) -> DataFrame:
    """``docs`` with every span found (overlapping ones merged) replaced by ``mark``; n_chars follows.

    Texts without a span, null ones included, stay as they are, and so do all
    other columns, whatever their names.  An empty table gives an empty result.
    """
    seen, inner = sealed(docs, "doc_id", "text", "n_chars")
    out = _scan(seen, rows, nats, nats_per_char)
    out = out.withColumn("text", F.when(F.size("found") > 0, _cut(F.col("text"), F.col("found"), mark)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("found") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*unsealed(inner))
