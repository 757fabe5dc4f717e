"""Quality rules: fixed bounds on words, then robust multivariate outliers per language and source.

Every text becomes a vector of four transformed rates: the logarithm of the mean word length, and log(1 + rate) of symbols per word, of
repeated lines per line and of words in repeated 3-word windows per word. For each pair of language and source the minimum covariance
determinant is sought by concentration steps (keep the half of the texts nearest to the centre, take its mean and covariance) from three
starts: medians with quartile widths, mean and covariance of all texts, and medians with the correlations of the hyperbolic tangents of the standardised
values. After ``TRIAL`` steps each group goes on from the start with the smallest determinant; a later step counts only where the determinant does not
rise, and steps end when it falls in no group. Since floors bound it from below, they do end. Texts whose squared Mahalanobis distance exceeds the
cut-off are rejected.

The covariance of the central half is scaled to that of a normal sample (factor of the chi-square law), and a floor is added
to each variance: most texts have no symbol and no repeated line at all, so that the half has no spread there. The floors state which spread is
harmless in any source; the cut-off lies far in the tail, so that clean texts stay. Each floor is small enough that the largest value of its
dimension alone (ln 2 for lines, ln 1.5 for the repeated words that the base rule admits) lies at four times the cut-off or more.

Only built-in functions are used. A source may hold any share of the rows: every statistic is a partial aggregate, the estimates are one
row per language and source, joined in parts of a group. The vectors are written once; each step reads that narrow table.

Results for odd input: a null or empty text has no words and fails the base rules. A null language or source counts as the empty name. A
text that fails the base rules takes no part in the estimates. A group of one text, or of equal texts, is its own centre and stays.
Repeated rows and null keys give one result row each. An empty table gives an empty result. Extra columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablero.llm.common import GAP, written
from tablero.operators.spread import spread_join

#: Fewer words fail; so does a larger share (in percent) of words in repeated windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: The share of texts that the estimates keep, and the factor that makes the covariance of that half consistent in four dimensions.
HALF, CONSISTENCY = 0.5, 2.13
#: Standard deviations that are harmless in any source: word length, symbols, repeated lines, repeated words (all on the transformed scale).
FLOORS = (0.1, 0.02, 0.05, 0.03)
#: Squared distance beyond which a text is rejected (chi-square of four degrees: 4e-8).
CUTOFF = 40.0
#: Steps from every start; the fall of a determinant (its logarithm) that calls for one more step, and the rise that is only rounding.
TRIAL, FALL, ROUNDING = 2, 1e-6, 1e-9
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"
DIMENSIONS = range(4)
PAIRS = [(i, j) for i in DIMENSIONS for j in range(i + 1)]


def total(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda sum_, x: sum_ + value(x))


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Key, lang, source, n_lines and the counts of the rules."""
    name = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang, source)}
    rows = docs.select(F.col(key).alias("key"), name[lang].alias("lang"), name[source].alias("source"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select(
        "key", "lang", "source",
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        F.filter(F.split("text", "\n"), lambda x: F.translate(x, BLANKS, "") != "").alias("lines"),
        F.filter(F.split("text", GAP), lambda x: x != "").alias("words"))
    rows = rows.select(
        "key", "lang", "source", "n_symbols", "word_chars",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("words").cast("long").alias("n_words"),
        F.slice(F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))), 1, F.greatest(F.size("words") - 2, F.lit(0))).alias("windows"))
    # Only a text with any repeat has its windows ordered: equal ones then stand side by side.
    rows = rows.withColumn("ordered", F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ).otherwise(F.expr("array()").cast("array<struct<h: bigint, i: int>>"))).drop("windows")
    twice = F.filter("ordered", lambda x, k: F.coalesce(x.h == F.get("ordered", k - 1).h, F.lit(False)) | F.coalesce(x.h == F.get("ordered", k + 1).h, F.lit(False)))
    rows = rows.withColumn("starts", F.sort_array(F.transform(twice, lambda x: x.i))).drop("ordered")
    steps = F.transform("starts", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("starts", k + 1) - x, F.lit(3))))
    return rows.withColumn("n_repeat_words", total(steps, lambda x: x)).drop("starts")


def vectors(counts: DataFrame) -> DataFrame:
    """The counts with the base verdict and the vector x0 .. x3."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counts.select(
        "*", failed.alias("base_failed"),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n).alias("x0"),
        F.log1p(F.col("n_symbols") / n).alias("x1"),
        F.log1p(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("x2"),
        F.log1p(F.col("n_repeat_words") / n).alias("x3"))


GROUP = ["lang", "source"]


def factored(estimates: DataFrame, by: list[str] = GROUP) -> DataFrame:
    """Means m*, the lower triangle l** of the Cholesky factor of the covariances c**, and the logarithm of the determinant, as columns of each
    group's row."""
    out = estimates
    for i, j in PAIRS:
        rest = F.col(f"c{i}{j}")
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2))) if i == j else rest / F.col(f"l{j}{j}"))
    logs = [2 * F.log(F.col(f"l{i}{i}")) for i in DIMENSIONS]
    return out.select(*by, *(f"m{i}" for i in DIMENSIONS), *(f"l{i}{j}" for i, j in PAIRS), sum(logs[1:], logs[0]).alias("logdet"))


def with_distance(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows with their squared distance d2 from the centre of their group, null where the group has no estimate; one row per start if the groups have
    several."""
    out, solved = spread_join(rows, groups, GROUP, ["key"], "left"), []
    for i in DIMENSIONS:
        left = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            left = left - F.col(f"l{i}{k}") * F.col(f"y{k}")
        out = out.withColumn(f"y{i}", left / F.col(f"l{i}{i}"))
        solved.append(F.col(f"y{i}") * F.col(f"y{i}"))
    return out.withColumn("d2", sum(solved[1:], solved[0])).select(*rows.columns, *(c for c in groups.columns if c == "start"), "d2")


def starts(rows: DataFrame) -> DataFrame:
    """The three starting estimates of each group, numbered by ``start``."""
    def covariance(x: str, i: int, j: int) -> Column:
        return F.coalesce(F.covar_pop(f"{x}{i}", f"{x}{j}"), F.lit(0.0))

    def floor(i: int, j: int) -> float:
        return FLOORS[i] ** 2 if i == j else 0.0

    plain = written(rows.groupBy(*GROUP).agg(
        *(F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75]).alias(f"q{i}") for i in DIMENSIONS), *(F.avg(f"x{i}").alias(f"a{i}") for i in DIMENSIONS),
        *(covariance("x", i, j).alias(f"v{i}{j}") for i, j in PAIRS)))
    width = {i: (F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349 for i in DIMENSIONS}
    middle = plain.select(*GROUP, *(F.col(f"q{i}")[1].alias(f"m{i}") for i in DIMENSIONS), *(F.sqrt(width[i] * width[i] + floor(i, i)).alias(f"s{i}") for i in DIMENSIONS))
    bent = spread_join(rows, middle, GROUP, ["key"]).withColumns({f"t{i}": F.tanh((F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"s{i}")) for i in DIMENSIONS})
    shapes = bent.groupBy(*GROUP).agg(*(covariance("t", i, j).alias(f"r{i}{j}") for i, j in PAIRS)).join(middle, GROUP)

    def correlated(i: int, j: int) -> Column:
        both = F.sqrt(F.col(f"r{i}{i}") * F.col(f"r{j}{j}"))
        return F.col(f"s{i}") * F.col(f"s{j}") * (F.lit(1.0) if i == j else F.when(both > 0, F.col(f"r{i}{j}") / both).otherwise(0.0))

    centres = [f"m{i}" for i in DIMENSIONS]
    quartiles = middle.select(*GROUP, F.lit(0).alias("start"), *centres, *((F.col(f"s{i}") ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS))
    moments = plain.select(
        *GROUP, F.lit(1).alias("start"), *(F.col(f"a{i}").alias(f"m{i}") for i in DIMENSIONS), *((F.col(f"v{i}{j}") + floor(i, j)).alias(f"c{i}{j}") for i, j in PAIRS))
    tangents = shapes.select(*GROUP, F.lit(2).alias("start"), *centres, *(correlated(i, j).alias(f"c{i}{j}") for i, j in PAIRS))
    return written(factored(quartiles.unionByName(moments).unionByName(tangents), [*GROUP, "start"]))


def concentrated(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The estimates of the half of each group that is nearest to the given ones."""
    by = [*GROUP, *(c for c in groups.columns if c == "start")]
    near = with_distance(rows, groups)
    limit = near.groupBy(*by).agg(F.percentile_approx("d2", HALF).alias("limit"))
    half = spread_join(near, limit, by, ["key"]).where("d2 <= limit")
    return factored(half.groupBy(*by).agg(
        *(F.avg(f"x{i}").alias(f"m{i}") for i in DIMENSIONS),
        *((F.coalesce(F.covar_pop(f"x{i}", f"x{j}"), F.lit(0.0)) * CONSISTENCY + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in PAIRS)), by)


def estimates(rows: DataFrame) -> DataFrame:
    """Centre and factor per language and source, with the logarithm of the determinant."""
    trial = starts(rows)
    for _ in range(TRIAL):
        trial = written(concentrated(rows, trial))
    row = F.struct(*(c for c in trial.columns if c not in GROUP))
    # Of equal determinants the first start's.
    groups = written(trial.groupBy(*GROUP).agg(F.min_by(row, F.struct(F.round("logdet", 9), "start")).alias("e")).select(*GROUP, "e.*").drop("start"))
    falling = True
    while falling:
        names = [c for c in groups.columns if c not in GROUP]
        after, before = concentrated(rows, groups).select(*GROUP, F.struct(*names).alias("a")), groups.select(*GROUP, F.struct(*names).alias("b"))
        lower = F.col("a.logdet") <= F.col("b.logdet") + ROUNDING
        step = written(after.join(before, GROUP).select(
            *GROUP, F.when(lower, F.col("a")).otherwise(F.col("b")).alias("e"), (F.col("a.logdet") < F.col("b.logdet") - FALL).alias("falls")))
        falling = not step.where("falls").isEmpty()
        groups = step.select(*GROUP, "e.*")
    return groups


def judged(docs: DataFrame, cutoff: float = CUTOFF, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Per text the counts, base_failed, the squared distance d2 and the verdict kept."""
    rows = written(vectors(statistics(docs, key, text, lang, source)))
    groups = estimates(rows.where("NOT base_failed"))
    return with_distance(rows, groups).select(
        F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= cutoff)).alias("kept"), "d2")
