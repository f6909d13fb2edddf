"""Personal data: candidate spans, boosted trees over format and context, a calibrated threshold.

High-recall generators propose spans per kind; spans that pass the exact rules of their kind are
certain and stay. The rules' verdicts over the whole corpus are also the weak labels of a small
gradient-boosted model, whose features are format and context only. A failed or loose proposal
is redacted too where the model is surer than a threshold, calibrated per kind so that the
labelled proposals above it are at least ``PRECISION`` right.

All built-in expressions: matches and the text between them come from the same pattern, which
gives positions by running sums. Features take few values, so the labels are counted per feature
cell (at most ``MAX_CELLS``) and only that table reaches the driver; the fitted trees go back as
column expressions. No shuffle carries text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.llm.words import filled

KINDS = ("email", "ip", "card", "phone")
#: right labels among the proposals above a kind's threshold
PRECISION = 0.99
#: proposals of a kind that must stand behind a threshold
SUPPORT = 30
DIGITS, SEPARATORS = 20, 6
#: feature cells: kind, digits, separators and four flags
MAX_CELLS = len(KINDS) * (DIGITS + 1) * (SEPARATORS + 1) * 16
ROUNDS, RATE = 30, 0.3
FEATURES = ("digits", "seps", "paren", "glued_before", "glued_after", "named")
CONTEXT = r"(?i)(e-?mail|mail|phone|tel|call|fax|mobile|card|visa|credit|ip|host|server|contact)\W{0,3}$"

# Patterns: a match starts only where a run of its first characters starts, and every loop is
# possessive, so that long runs are read once and never nest.
#: (pattern, test that the text can hold a match)
STRICT = {
    "email": (
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
LOOSE = {
    "email": (
        r"(?<![\w.%+-])[\w.%+-]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}"
        r"(?:(?: ?[\[(]dot[\])] ?|\.)[A-Za-z0-9-]{1,63}){1,8}", r"[\[(]at[\])]"),
    "ip": (r"(?<![0-9])[0-9]{1,3} ?\. ?[0-9]{1,3} ?\. ?[0-9]{1,3} ?\. ?[0-9]{1,3}(?![0-9])",
           r"[0-9] ?\. ?[0-9]{1,3} ?\. ?[0-9]"),
    "card": (r"(?<![0-9])(?:[0-9]{4}[ ./_-]){3}[0-9]{4}(?![0-9])", r"[0-9]{4}[ ./_-][0-9]{4}"),
    "phone": (r"(?<![0-9])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
              r"[0-9]\)?[ .-][0-9]{3}[ .-][0-9]{4}"),
}


def running_sums(a: Column, block: int = 256) -> Column:
    """Inclusive running sums of an array of longs: blocks first, so that the cost stays near
    linear for very long arrays."""
    zero = F.lit(0).cast("bigint")

    def add(acc: Column, x: Column) -> Column:
        return F.concat(acc, F.array(F.element_at(acc, -1) + x))

    def scan(values: Column, head: Column) -> Column:
        return F.aggregate(values, F.array(head), add)

    def blocks(arr: Column) -> Column:
        n = F.ceil(F.size(arr) / block).cast("int")
        at = F.sequence(F.lit(0), n - 1)
        part = lambda b: F.slice(arr, b * block + 1, F.lit(block))
        totals = F.transform(at, lambda b: F.aggregate(part(b), zero, lambda s, x: s + x))
        return F.get(F.transform(F.array(scan(totals, zero)), lambda heads: F.flatten(
            F.transform(at, lambda b: F.slice(
                scan(part(b), F.get(heads, b)), F.lit(2), F.lit(block)
            ))
        )), F.lit(0))

    return F.when(F.size(a) == 0, F.array().cast("array<bigint>")).otherwise(
        F.get(F.transform(F.array(a), blocks), F.lit(0))
    )


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when(i % 2 == 0, twice).otherwise(d)

    at = F.sequence(F.lit(1), F.length(digits))
    total = F.aggregate(F.transform(at, value), F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


OCTETS = r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9]|(?<=0))(?:\.|$)){4}$"


def _passes(kind: str, match: Column) -> Column:
    """The exact rule of a kind on a match of its strict pattern."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(OCTETS)
    if kind == "card":
        return F.length(digits).between(14, 19) & _luhn(digits)
    return F.length(digits).between(10, 15)


def _proposals(text: Column, kind: str, strict: bool) -> Column:
    """Array of (start, kind number, end, base, labelled, features) of one generator."""
    pattern, hint = (STRICT if strict else LOOSE)[kind]
    found, between = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    lengths = lambda m, b: F.transform(b, lambda x, i: (
        F.length(x) + F.coalesce(F.length(F.get(m, i - 1)), F.lit(0))).cast("bigint"))
    bound = F.array(F.struct(found.alias("m"), between.alias("b")))
    placed = F.get(F.transform(bound, lambda x: F.arrays_zip(
        x["m"].alias("m"), F.slice(x["b"], F.lit(1), F.size(x["m"])).alias("before"),
        F.slice(x["b"], F.lit(2), F.size(x["m"])).alias("after"),
        F.slice(running_sums(lengths(x["m"], x["b"])), F.lit(1), F.size(x["m"])).alias("start"),
    )), F.lit(0))
    flag = lambda c: c.cast("int")

    def proposal(x: Column) -> Column:
        m, before, after = x["m"], F.right(x["before"], F.lit(24)), F.left(x["after"], F.lit(1))
        return F.struct(
            x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"),
            (x["start"] + F.length(m)).alias("end"),
            (_passes(kind, m) if strict else F.lit(False)).alias("base"),
            F.lit(strict).alias("labelled"),
            F.least(F.length(F.regexp_replace(m, "[^0-9]", "")), F.lit(DIGITS)).alias("digits"),
            F.least(F.length(F.regexp_replace(m, r"[^ .\-]", "")), F.lit(SEPARATORS)).alias("seps"),
            flag(m.contains("(")).alias("paren"),
            flag(before.rlike("[A-Za-z0-9]$")).alias("glued_before"),
            flag(after.rlike("[A-Za-z0-9]")).alias("glued_after"),
            flag(before.rlike(CONTEXT)).alias("named"),
        )

    spans = F.transform(placed, proposal)
    if kind == "card" and strict:
        spans = F.filter(spans, lambda s: s["base"] | s["digits"].between(12, 19))
    possible = text.contains(hint) if hint == "@" else text.rlike(hint)
    return F.when(possible, spans).otherwise(F.array().cast(SPANS))


SPANS = (
    "array<struct<start:bigint,kind:int,end:bigint,base:boolean,labelled:boolean,digits:int,"
    "seps:int,paren:int,glued_before:int,glued_after:int,named:int>>"
)


def proposals(text: Column) -> Column:
    """All proposals of all generators on a text, by start, then kind."""
    return F.array_sort(F.concat(*[
        _proposals(text, kind, strict).cast(SPANS) for kind in KINDS for strict in (True, False)
    ]))


# --- the model -------------------------------------------------------------------------


def feature_cells(proposed: DataFrame) -> list[dict]:
    """(_p: proposals) to label counts per feature cell; at most ``MAX_CELLS`` rows."""
    each = proposed.select(F.explode("_p").alias("p")).filter("p.labelled")
    keys = [F.col(f"p.{f}").alias(f) for f in ("kind", *FEATURES)]
    counted = each.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("p.base"), 1)).alias("good")
    )
    rows = [r.asDict() for r in counted.collect()]
    return sorted(rows, key=lambda r: [r[f] for f in ("kind", *FEATURES)])


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x))


def _best_split(rows: list[dict], grads: list[tuple[float, float]]):
    """(gain, feature, value): rows with feature <= value go left."""
    g, h = sum(x[0] for x in grads), sum(x[1] for x in grads)
    best = (1e-9, None, None)
    for f in FEATURES:
        sums: dict[int, list[float]] = {}
        for r, (a, b) in zip(rows, grads):
            s = sums.setdefault(r[f], [0.0, 0.0])
            s[0] += a
            s[1] += b
        left_g = left_h = 0.0
        for value in sorted(sums)[:-1]:
            left_g += sums[value][0]
            left_h += sums[value][1]
            gain = (left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1)
                    - g**2 / (h + 1))
            if gain > best[0]:
                best = (gain, f, value)
    return best


def _grow(rows: list[dict], grads: list[tuple[float, float]], depth: int):
    """A regression tree as a leaf value or (feature, value, left, right)."""
    _, feature, value = _best_split(rows, grads) if depth else (0, None, None)
    if feature is None:
        return -RATE * sum(x[0] for x in grads) / (sum(x[1] for x in grads) + 1)
    sides = ([], [])
    for r, x in zip(rows, grads):
        sides[r[feature] > value].append((r, x))
    return (feature, value, *(
        _grow([r for r, _ in s], [x for _, x in s], depth - 1) for s in sides
    ))


def tree_value(tree, row) -> float:
    while isinstance(tree, tuple):
        feature, value, left, right = tree
        tree = left if row[feature] <= value else right
    return tree


def boost(cells: list[dict], rounds: int = ROUNDS, depth: int = 3) -> list:
    """Newton boosting of the log loss over weighted cells."""
    score = [0.0] * len(cells)
    trees = []
    for _ in range(rounds if cells else 0):
        grads = []
        for r, s in zip(cells, score):
            p = _sigmoid(s)
            grads.append((r["n"] * p - r["good"], r["n"] * p * (1 - p)))
        tree = _grow(cells, grads, depth)
        trees.append(tree)
        score = [s + tree_value(tree, r) for s, r in zip(score, cells)]
    return trees


def calibrate(cells: list[dict], trees: list, precision: float = PRECISION,
              support: int = SUPPORT) -> float | None:
    """The lowest score from which on the labelled proposals are right often enough."""
    scored = sorted(
        ((sum(tree_value(t, r) for t in trees), r["n"], r["good"]) for r in cells), reverse=True
    )
    n = good = 0
    lowest = None
    for i, (score, count, right) in enumerate(scored):
        n, good = n + count, good + right
        tied = i + 1 < len(scored) and scored[i + 1][0] == score
        if not tied and n >= support and good >= precision * n:
            lowest = score
    return lowest


def fit(proposed: DataFrame) -> dict[int, tuple[list, float]]:
    """Per kind the trees and the threshold; a kind without a threshold adds nothing."""
    cells, models = feature_cells(proposed), {}
    for k in range(len(KINDS)):
        own = [r for r in cells if r["kind"] == k]
        trees = boost(own)
        lowest = calibrate(own, trees)
        if lowest is not None:
            models[k] = (trees, lowest)
    return models


def _tree_column(tree, span: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    feature, value, left, right = tree
    return F.when(span[feature] <= value, _tree_column(left, span)).otherwise(
        _tree_column(right, span)
    )


def _sure(span: Column, models: dict[int, tuple[list, float]]) -> Column:
    sure = F.lit(False)
    for kind, (trees, lowest) in models.items():
        total = F.lit(0.0)
        for tree in trees:
            total = total + _tree_column(tree, span)
        sure = sure | ((span["kind"] == kind) & (total >= F.lit(lowest - 1e-9)))
    return sure


# --- the operator ----------------------------------------------------------------------


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``spans``: array of (start, kind, end, base), by start, then kind, in code points.

    ``base`` spans passed the exact rules, the others the calibrated model, and those overlap no
    base span. Null text is the empty text and has none; repeated rows are treated alike; an
    empty table gives an empty result. Every text is read whole, twice: to count labels over the
    whole corpus, and to apply the model.
    """
    body = filled(F.col(text))
    models = fit(docs.select(proposals(body).alias("_p")))
    marked = docs.withColumn("_p", proposals(body)).withColumn(
        "_base", F.filter("_p", lambda s: s["base"])
    )

    def clear(s: Column) -> Column:
        return ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    added = F.filter("_p", lambda s: ~s["base"] & _sure(s, models) & clear(s))
    chosen = F.when(F.size("_base") == F.size("_p"), F.col("_base")).otherwise(
        F.array_sort(F.concat("_base", added))
    )
    return marked.withColumn("spans", F.array_distinct(F.transform(chosen, lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
        s["base"].alias("base"),
    )))).drop("_p", "_base")


def span_list(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")
    )), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans are one."""
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    body = filled(text)

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(body, acc["at"] + 1, s["start"] - acc["at"])
        inside = s["start"] < acc["at"]
        return F.struct(
            F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], gap, F.get(tags, s["kind"])))
            .alias("out"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        )

    joined = F.aggregate(spans, start, step, lambda acc: F.concat(
        acc["out"], F.substring(body, acc["at"] + 1, F.length(body))
    ))
    return F.when(F.size(spans) == 0, text).otherwise(joined)
