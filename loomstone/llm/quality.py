"""Quality rules and robust multivariate outliers, in DataFrame functions only.

Each document gets counts (words, symbols, repeated lines, words in repeated windows) and from them a vector of transformed
statistics. For each language and source the centre and covariance of these vectors are estimated by minimum covariance
determinant: from two starts (distance from the coordinatewise medians in units of the median absolute deviation, and
all rows), concentration steps keep the share SUBSET of rows with the smallest distances and estimate again until the
determinant stands still; the start with the smaller determinant wins. All estimates are grouped sums and percentile
sketches, combined before they are shuffled, over a staged table of a few numbers a document, so a source with a third
of all rows is no burden. A document is rejected when its squared Mahalanobis distance exceeds CUTOFF, the far tail of
the chi-square law.

Small groups are no special case: a group's estimates are pooled with its language's, these with the corpus's, and these with
the spreads WIDE. The own ones weigh n**2 / (n**2 + PRIOR**2) for n rows: a few odd rows alone in their group do not make
themselves its rule, and wider estimates give way as rows come in.

Statistics that are constant in most documents (no symbols, no repetition) would make the covariance singular; each has a
floor: FLOORS**2 is added to the diagonal, the regularised form of the estimator.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import SPACE, column_or_null, join_split, let, packed, staged, staged_rows, unpacked

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
#: Share of a group's rows that the estimates rest on.
SUBSET = 0.75
#: A group is done when a step lowers the logarithm of its determinant by less. It cannot fall below the floors', so steps end.
TOLERANCE = 1e-3
#: Rows at which a group's own estimates and the wider ones weigh the same.
PRIOR = 100
#: Estimates of so many groups (about 800 bytes each) are broadcast; beyond it only those of groups with many rows are.
BROADCAST_GROUPS = 10_000
#: Transformed statistics and the standard deviation added to each as a floor.
FLOORS = {"x_word_length": 0.06, "x_symbols": 0.04, "x_lines": 0.15, "x_repeats": 0.15, "x_upper": 0.05}
#: Standard deviations that are assumed where there are no rows to tell.
WIDE = {"x_word_length": 0.5, "x_symbols": 0.3, "x_lines": 0.5, "x_repeats": 0.5, "x_upper": 0.3}
#: Squared distance beyond which a document is rejected; chi-square with 5 degrees of freedom exceeds 45 once in 7e7.
CUTOFF = 45.0

_X = list(FLOORS)


def words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text that is not null."""
    return F.array_remove(F.split(text, SPACE), "")


def _repeat_words(w: Column) -> Column:
    """Words that lie in windows of WINDOW words found twice or more in the array."""

    def covered(starts: Column) -> Column:
        gaps = F.transform(F.sequence(F.lit(1), F.size(starts) - 1), lambda i: F.least(F.lit(WINDOW), starts[i] - starts[i - 1]))
        return F.when(F.size(starts) == 0, 0).otherwise(F.when(F.size(starts) == 1, F.lit(WINDOW)).otherwise(F.aggregate(gaps, F.lit(WINDOW), lambda a, b: a + b)))

    def twice(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            last = F.size(s) - 1
            found = F.filter(
                s,
                lambda x, k: ((k > 0) & (x["h"] == s[F.greatest(k - 1, F.lit(0))]["h"])) | ((k < last) & (x["h"] == s[F.least(k + 1, last)]["h"])),
            )
            return F.sort_array(F.transform(found, lambda x: x["i"]))

        return let(placed, lambda s: let(starts(s), covered))

    def doubled(hashes: Column, by: int) -> Column:
        """Hashes of runs twice as long, each from the two runs that make it up."""
        return let(hashes, lambda h: F.zip_with(F.slice(h, F.lit(1), F.size(h) - by), F.slice(h, F.lit(by + 1), F.size(h) - by), lambda a, b: F.xxhash64(a, b)))

    windows = F.transform(w, lambda x: F.xxhash64(x))
    for k in range(int(math.log2(WINDOW))):
        windows = doubled(windows, 2**k)
    repeated = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(twice(h)))
    return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(repeated)


def statistics(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row for each row of docs: `_row` (its columns `keep`, all by default, as a struct), the counts and the base
    rules' verdict.

    A null text counts as an empty one: it has no words and fails.
    """
    bare, own, row = packed(docs, keep)
    text = F.coalesce(F.col(own["text"]).cast("string"), F.lit(""))
    w = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    lines = let(F.filter(F.split(text, "\n"), lambda x: F.trim(F.translate(x, WHITE[1:], " ")) != ""), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    counted = bare.select(
        row.alias("_row"),
        column_or_null(bare, own, "lang", "string").alias("_lang"),
        column_or_null(bare, own, "source", "string").alias("_source"),
        w.alias("w"),
        symbols.cast("long").alias("n_symbols"),
        upper.cast("long").alias("n_upper"),
        lines.cast("long").alias("n_dup_lines"),
    )
    counted = counted.select("_row", "_lang", "_source", "w.*", "n_symbols", "n_upper", "n_dup_lines")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def vectors(counted: DataFrame) -> DataFrame:
    """counted with the transformed statistics; zeros where there are no words. Null languages and sources are groups too."""
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return counted.withColumns(
        {
            "x_word_length": F.ln(chars / n),
            "x_symbols": F.sqrt(F.col("n_symbols") / chars),
            "x_lines": F.sqrt(F.col("n_dup_lines") / n),
            "x_repeats": F.sqrt(F.col("n_repeat_words") / n),
            "x_upper": F.sqrt(F.col("n_upper") / chars),
        }
    )


def _moments(near: Column | None, tag: str) -> list[Column]:
    """Count, sums and sums of products of the rows where `near` holds, as aggregates named by tag."""
    x = [F.col(name) if near is None else F.when(near, F.col(name)) for name in _X]
    sums = [F.count(x[0]).alias(f"{tag}_n")] + [F.sum(x[i]).alias(f"{tag}_s_{i}") for i in range(len(_X))]
    return sums + [F.sum(x[i] * x[j]).alias(f"{tag}_q_{i}_{j}") for i in range(len(_X)) for j in range(i + 1)]


def _centre(tag: str) -> Column:
    return F.array(*[F.col(f"{tag}_s_{i}") / F.greatest(f"{tag}_n", F.lit(1)) for i in range(len(_X))])


def _covariance(tag: str) -> Column:
    """Rows of the covariance matrix."""
    n = F.greatest(f"{tag}_n", F.lit(1))

    def at(i: int, j: int) -> Column:
        return F.col(f"{tag}_q_{max(i, j)}_{min(i, j)}") / n - F.col(f"{tag}_s_{i}") / n * F.col(f"{tag}_s_{j}") / n

    return F.array(*[F.array(*[at(i, j) for j in range(len(_X))]) for i in range(len(_X))])


def _inverse(covariance: Column, factor: float) -> Column:
    """(inverse, log_det) of factor * covariance + floors, by Gauss-Jordan elimination; the floors keep every pivot positive."""
    floors = F.array(*[F.lit(f**2) for f in FLOORS.values()])
    p = len(_X)

    def unit(i: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda j: F.when(i == j, 1.0).otherwise(0.0))

    def widened(row: Column, i: Column) -> Column:
        return F.concat(F.transform(row, lambda v, j: v * factor + F.when(i == j, floors[i]).otherwise(0.0)), unit(i))

    def step(acc: Column, k: Column) -> Column:
        pivot = acc["m"][k]
        scaled = F.transform(pivot, lambda v: v / pivot[k])
        rest = F.transform(acc["m"], lambda row, i: F.when(i == k, scaled).otherwise(F.zip_with(row, scaled, lambda a, b: a - row[k] * b)))
        return F.struct(rest.alias("m"), (acc["log_det"] + F.ln(pivot[k])).alias("log_det"))

    def finish(acc: Column) -> Column:
        right = F.transform(acc["m"], lambda row: F.slice(row, p + 1, p))
        return F.struct(right.alias("inverse"), acc["log_det"].alias("log_det"))

    start = F.struct(F.transform(covariance, widened).alias("m"), F.lit(0.0).alias("log_det"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(p - 1)), start, step, finish)


def _distance(tag: str) -> Column:
    """Squared Mahalanobis distance from the estimates {tag} (a struct of centre, inverse and log_det)."""
    e = F.col(tag)
    d = [F.col(x) - e["centre"][i] for i, x in enumerate(_X)]
    parts = [(1 if i == j else 2) * e["inverse"][i][j] * d[i] * d[j] for i in range(len(_X)) for j in range(i + 1)]
    return reduce(lambda a, b: a + b, parts)


def _estimate(centre: Column, covariance: Column, factor: float, tag: str) -> Column:
    found = _inverse(covariance, factor)
    scaled = F.transform(covariance, lambda row: F.transform(row, lambda v: v * factor))
    parts = lambda f: F.struct(centre.alias("centre"), scaled.alias("covariance"), f["inverse"].alias("inverse"), f["log_det"].alias("log_det"))
    return let(found, parts).alias(tag)


def _consistency(share: float, p: int) -> float:
    """What the covariance of the nearest `share` of normal vectors is multiplied by to be that of all."""

    def below(x: float, k: int) -> float:  # chi-square distribution function, by its series
        term = total = 1 / (k / 2)
        for n in range(1, 500):
            term *= x / 2 / (k / 2 + n)
            total += term
        return math.exp(-x / 2 + k / 2 * math.log(x / 2) - math.lgamma(k / 2)) * total

    lo, hi = 0.0, 100.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid, p) < share else (lo, mid)
    return share / below(lo, p + 2)


_STARTS = ["a", "b"]


def _with_estimates(rows: DataFrame, estimates: DataFrame, group: str, groups: int, how: str = "inner") -> DataFrame:
    """rows joined with their group's estimates, which have the group's number of rows in `size`. They are sent to all tasks if they
    are few, else only those of large groups are, so that no large group meets in one task. rows should be staged."""
    if groups <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(estimates), group, how)
    return join_split(rows, estimates, [group], "size", how)


def robust_estimates(rows: DataFrame, group: str) -> DataFrame:
    """Minimum-covariance-determinant estimates (struct e: centre, covariance, inverse, log_det) by `group` over the columns of
    FLOORS, and the group's number of rows (size).

    Both starts take their steps in the same passes: a pass for the limits of the distances and one for the moments of the
    rows within them. Groups whose determinants stand still take no further part, so a pass meets fewer rows each time.
    """
    rows = rows.select(group, *_X)
    p = range(len(_X))

    def met(estimates: DataFrame) -> DataFrame:
        return _with_estimates(rows, estimates, group, groups)

    middle = F.array(*[F.percentile_approx(x, 0.5, 1000) for x in _X]).alias("middle")
    first = rows.groupBy(group).agg(F.count("*").alias("size"), middle, *_moments(None, "b"))
    first = middles = staged(first.select(group, "size", "middle", _estimate(_centre("b"), _covariance("b"), 1.0, "b")), "quality-medians")
    groups = first.count()
    apart = F.array(*[F.percentile_approx(F.abs(F.col(x) - F.col("middle")[i]), 0.5, 1000) for i, x in enumerate(_X)]).alias("apart")
    spread = met(first.select(group, "size", "middle")).groupBy(group).agg(apart)
    scales = F.array(*[F.array(*[F.pow(F.col("apart")[i] * 1.4826, 2) if i == j else F.lit(0.0) for j in p]) for i in p])
    # A start's own determinant is not comparable: its spread is not that of a subset.
    start = first.join(spread, group).select(group, "size", _estimate(F.col("middle"), scales, 1.0, "a"), "b", F.lit(True).alias("first"))
    now = staged(start, "quality-start", middles)
    factor, settled = _consistency(SUBSET, len(_X)), []
    while not now.isEmpty():
        limits = met(now).groupBy(group).agg(*[F.percentile_approx(_distance(t), SUBSET, 1000).alias(f"{t}_limit") for t in _STARTS])
        limited = staged(now.join(limits, group), "quality-limits")
        # The distance stands once for each start in the plan; the sums refer to whether a row is near.
        near = met(limited).select(group, *_X, *[(_distance(t) <= F.col(f"{t}_limit")).alias(f"{t}_near") for t in _STARTS])
        moments = near.groupBy(group).agg(*[m for t in _STARTS for m in _moments(F.col(f"{t}_near"), t)])
        after = moments.select(group, *[_estimate(_centre(t), _covariance(t), factor, f"{t}_next") for t in _STARTS])
        falls = {t: F.col("first") | (F.col(f"{t}_next.log_det") < F.col(f"{t}.log_det") - TOLERANCE) for t in _STARTS}
        better = [F.when(falls[t] | (F.col(f"{t}_next.log_det") < F.col(f"{t}.log_det")), F.col(f"{t}_next")).otherwise(F.col(t)).alias(t) for t in _STARTS]
        step = now.join(after, group).select(group, "size", *better, F.lit(False).alias("first"), reduce(lambda a, b: a | b, falls.values()).alias("moved"))
        step = staged(step, "quality-step", now, limited)
        settled.append(step.filter(~F.col("moved")))
        now = step.filter("moved").drop("moved")
    done = reduce(lambda a, b: a.unionByName(b), settled) if settled else now.withColumn("moved", F.lit(False))
    return done.select(group, "size", F.when(F.col("a.log_det") <= F.col("b.log_det"), F.col("a")).otherwise(F.col("b")).alias("e"))


def _pooled(n: Column, own: Column, wider: Column) -> Column:
    """Centre and covariance of a mixture of own, from n rows, and wider (structs with centre and covariance)."""
    n = n.cast("double")
    w = n * n / (n * n + F.lit(PRIOR * PRIOR))
    p = range(len(_X))
    apart = [own["centre"][i] - wider["centre"][i] for i in p]

    def at(i: int, j: int) -> Column:
        return w * own["covariance"][i][j] + (1 - w) * wider["covariance"][i][j] + w * (1 - w) * apart[i] * apart[j]

    centre = F.array(*[w * own["centre"][i] + (1 - w) * wider["centre"][i] for i in p])
    return F.struct(centre.alias("centre"), F.array(*[F.array(*[at(i, j) for j in p]) for i in p]).alias("covariance"))


def pooled_estimates(found: DataFrame, levels: DataFrame) -> DataFrame:
    """(own, size, e): the estimates of robust_estimates() for the groups `own` of levels (own, wide, all), pooled with those of the
    groups that they lie in."""

    def of(level: str) -> DataFrame:
        return found.select(F.col("group").alias(level), F.col("e").alias(f"e_{level}"), F.col("size").alias(f"n_{level}"))

    # The tables are smaller than the number of groups; the last has one row.
    met = levels.join(of("own"), "own").join(of("wide"), "wide").join(F.broadcast(of("all")), "all")
    spread = F.array(*[F.array(*[F.lit(v**2 if i == j else 0.0) for j in range(len(_X))]) for i, v in enumerate(WIDE.values())])
    prior = F.struct(F.col("e_all.centre").alias("centre"), spread.alias("covariance"))
    for level in ("all", "wide", "own"):
        met = met.withColumn("pooled", _pooled(F.col(f"n_{level}"), F.col(f"e_{level}"), prior))
        prior = F.col("pooled")
    return met.select("own", F.col("n_own").alias("size"), _estimate(F.col("pooled.centre"), F.col("pooled.covariance"), 1.0, "e"))


def judge(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """statistics() with `distance` (squared Mahalanobis distance, null where no row of the group passes the base rules) and `kept`.

    A document is kept if the base rules pass and its distance is at most CUTOFF or null; a distance equal to CUTOFF passes, and rows
    whose distances tie at a subset's limit all count. Null texts and texts without words fail the base rules. Null languages
    and sources form groups of their own. Texts of any length are counted whole. Repeated rows each keep a row. Other columns
    keep their values, whatever their names. No rows in: no rows out.
    """
    return _judged(staged_rows(vectors(statistics(docs, keep)), "quality-counts"))


def _judged(rows: DataFrame) -> DataFrame:
    # JSON of a struct leaves nulls out, so a null language or source is a group of its own.
    any_ = F.lit("*").alias("any")
    rows = rows.withColumns({"own": F.to_json(F.struct("_lang", "_source")), "wide": F.to_json(F.struct("_lang", any_)), "all": F.to_json(F.struct(any_))})
    clean = rows.filter(~F.col("base_failed"))
    levels = staged(clean.select("own", "wide", "all").distinct(), "quality-levels")
    grouped = staged(clean.select(F.explode(F.array("own", "wide", "all")).alias("group"), *_X), "quality-vectors")
    found = staged(robust_estimates(grouped, "group"), "quality-estimates", grouped)
    pooled = staged(pooled_estimates(found, levels), "quality-pooled", found, levels)
    met = _with_estimates(rows, pooled, "own", pooled.count(), "left").withColumn("distance", _distance("e"))
    met = met.withColumn("kept", ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= CUTOFF)))
    return met.drop("own", "wide", "all", "size", "e")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns."""
    return unpacked(judge(docs).filter("kept").select("_row"), docs.columns)
