"""Quality rules by robust multivariate outliers, in DataFrame functions only.

Every text gets base counts and a vector of transformed statistics. For each language and source a
minimum-covariance-determinant estimate is made by concentration steps: the COVERAGE share of rows with the
smallest distances gives a mean and covariance, which give new distances, and so on. Three deterministic starts
(medians and absolute deviations; all rows; the half of the rows that is nearest to the medians) make FIRST_STEPS
steps; the one with the least determinant goes on until the determinant falls by less than TOLERANCE of itself, in
no group, and the least one stays. That is the usual fast search: it finds a local minimum, the least of those that
the starts lead to. Distances are then scaled so that their median is that of a chi-square variable, and rows beyond its
1 - TAIL quantile are rejected. Sums, cross products and quantile sketches are aggregated before the shuffle,
so a source with a third of all rows is no hot key.

FLOOR is added to the deviations: most texts have no symbol and no repeated line, and without it a first one
would be infinitely far away. Rows failing the base rule take no part in the estimates. Sources with fewer than
LEAST_ROWS other rows in a language share one estimate of that language, and languages whose rest is as small
share one too; if even that has fewer rows, it rejects nothing more. Null languages and sources are groups of
their own. Null texts count as empty. Repeated rows and doc_ids stay rows of their own; an empty table gives an empty
result; other columns are kept by `judge`, those named like its results are replaced.

Repeated windows are found by 64-bit hashes of the windows of one text: two different windows of a text of a
million words collide with a probability of 3e-8.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
COVERAGE = 0.75
FIRST_STEPS = 2
#: Of the logarithm of the determinant; MAX_STEPS only guards against a cycle by rounding.
TOLERANCE, MAX_STEPS = 1e-6, 60
TAIL = 1e-6
LEAST_ROWS = 50
#: Groups joined by broadcast at most; more go by a salted shuffle.
MAX_BROADCAST_GROUPS = 20_000
SALTS = 64

#: A group and one of the starts.
GROUP = ["g_lang", "g_source", "start"]
SPACE = " \t\n\x0b\f\r"
#: name: (statistic, floor of its deviation)
VECTOR = {
    "v_words": (lambda: F.log1p("n_words"), 0.5),
    "v_length": (lambda: F.log(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)) + 0.5), 0.15),
    "v_symbols": (lambda: F.log1p(F.lit(100.0) * F.col("n_symbols") / F.greatest(F.col("n_words"), F.lit(1))), 0.5),
    "v_lines": (lambda: F.log1p("n_dup_lines"), 0.6),
    "v_repeats": (lambda: F.log1p(F.lit(100.0) * F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1))), 0.7),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def chi_square_quantile(p: float, k: int) -> float:
    """Wilson and Hilferty's approximation."""
    from statistics import NormalDist

    return k * (1 - 2 / (9 * k) + NormalDist().inv_cdf(p) * (2 / (9 * k)) ** 0.5) ** 3


def counts(docs: DataFrame, text: Column) -> DataFrame:
    """Adds COUNTS and base_failed."""
    docs = docs.withColumn("__t", F.coalesce(text, F.lit("")))
    bare = F.btrim("__t", F.lit(SPACE))
    docs = docs.withColumn("__w", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+")))
    lines = F.filter(F.split("__t", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    docs = docs.withColumn("__l", lines).withColumn("n_words", F.size("__w").cast("long"))
    window = F.transform(F.sequence(F.lit(1), F.size("__w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__w", i, WINDOW)))
    docs = docs.withColumn("__h", F.when(F.col("n_words") >= WINDOW, window).otherwise(F.array().cast("array<bigint>")))
    docs = docs.select(
        *(c for c in docs.columns if c not in ("__t", "__w", "__l", "__h") and c not in COUNTS),
        "n_words",
        F.length(F.translate("__t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        # windows with their places, only where one is found twice
        F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array(F.transform("__h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("__p"),
    )
    twice = F.zip_with("__p", F.slice("__p", 2, F.size("__p")), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])).otherwise(F.array().cast("array<int>")))
    docs = docs.withColumn("__p", F.sort_array(F.array_distinct(F.flatten(twice))))
    covered = F.zip_with("__p", F.slice("__p", 2, F.size("__p")), lambda x, y: F.least(F.lit(WINDOW), F.coalesce(y - x, F.lit(WINDOW))))
    repeated = F.when(F.col("__p").isNull() | (F.size("__p") == 0), F.lit(0)).otherwise(F.aggregate(covered, F.lit(0), lambda a, x: a + x))
    docs = docs.withColumn("n_repeat_words", repeated.cast("long")).drop("__p")
    failed = (F.col("n_words") < WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(REPEAT_PERCENT) * F.col("n_words"))
    return docs.withColumn("base_failed", failed)


def _with_groups(rows: DataFrame, groups: DataFrame, keys: tuple[str, ...] = ("g_lang", "g_source")) -> DataFrame:
    """Rows with the columns of their group; rows without one are lost."""
    if groups.count() <= MAX_BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), [*keys])
    salted = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64(*VECTOR), F.lit(SALTS)).cast("int"))
    return rows.join(salted, [*keys, "__salt"]).drop("__salt")


def _distance(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance by the group's mean m_i and Cholesky factor l_i_j."""
    names, total = list(VECTOR), F.lit(0.0)
    for i, v in enumerate(names):
        z = F.col(v) - F.col(f"m_{i}")
        for j in range(i):
            z = z - F.col(f"l_{i}_{j}") * F.col(f"__z{j}")
        rows = rows.withColumn(f"__z{i}", z / F.col(f"l_{i}_{i}"))
        total = total + F.col(f"__z{i}") * F.col(f"__z{i}")
    return rows.withColumn("d2", total).drop(*(f"__z{i}" for i in range(len(names))))


def _estimate(rows: DataFrame) -> DataFrame:
    """Mean, Cholesky factor and half the logarithm of the determinant for each group and start of rows that carry
    their shift s_i; floors are in the diagonal."""
    names, floors = list(VECTOR), [f for _, f in VECTOR.values()]
    k = range(len(names))
    x = [F.col(v) - F.col(f"s_{i}") for i, v in enumerate(names)]
    sums = [F.avg(x[i]).alias(f"a_{i}") for i in k] + [F.avg(x[i] * x[j]).alias(f"p_{i}_{j}") for i in k for j in range(i + 1)]
    g = rows.groupBy(*GROUP).agg(*sums, *(F.first(f"s_{i}").alias(f"s_{i}") for i in k))
    for i in k:
        for j in range(i + 1):
            c = F.col(f"p_{i}_{j}") - F.col(f"a_{i}") * F.col(f"a_{j}") + (F.lit(floors[i] ** 2) if i == j else F.lit(0.0))
            for n in range(j):
                c = c - F.col(f"l_{i}_{n}") * F.col(f"l_{j}_{n}")
            g = g.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(c, F.lit(1e-6))) if i == j else c / F.col(f"l_{j}_{j}"))
    means = [(F.col(f"s_{i}") + F.col(f"a_{i}")).alias(f"m_{i}") for i in k]
    size = sum((F.log(f"l_{i}_{i}") for i in k), F.lit(0.0)).alias("half_log")
    return g.select(*GROUP, size, *means, *(F.col(f"s_{i}") for i in k), *(f"l_{i}_{j}" for i in k for j in range(i + 1)))


def _quantile(rows: DataFrame, share: float, name: str) -> DataFrame:
    return rows.groupBy(*GROUP).agg(F.percentile_approx("d2", share, F.lit(2000)).alias(name))


def _step(rows: DataFrame, now: DataFrame) -> DataFrame:
    """The estimates from the COVERAGE share of each group's rows that is nearest to the estimates `now`."""
    near = written(_quantile(_distance(_with_groups(rows, now)), COVERAGE, "q"), "mcd-quantile")
    inner = _distance(_with_groups(rows, now.join(near, GROUP))).where("d2 <= q")
    return written(_estimate(inner), "mcd-step")


def estimates(rows: DataFrame) -> DataFrame:
    """(g_lang, g_source, m_i, l_i_j, scale): the estimate of each group of the rows (g_lang, g_source, VECTOR)."""
    names, floors = list(VECTOR), [f for _, f in VECTOR.values()]
    middle = [F.percentile_approx(v, 0.5, F.lit(2000)).alias(f"s_{i}") for i, v in enumerate(names)]
    start = rows.groupBy("g_lang", "g_source").agg(*middle, F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= LEAST_ROWS).drop("rows")
    start = written(start, "mcd-medians")
    apart = [F.percentile_approx(F.abs(F.col(v) - F.col(f"s_{i}")), 0.5, F.lit(2000)).alias(f"b_{i}") for i, v in enumerate(names)]
    spread = _with_groups(rows, start).groupBy("g_lang", "g_source").agg(*apart, *(F.first(f"s_{i}").alias(f"s_{i}") for i in range(len(names))))
    diagonal = [F.lit(0.0).alias(f"l_{i}_{j}") if i != j else F.sqrt((F.col(f"b_{i}") * 1.4826) ** 2 + floors[i] ** 2).alias(f"l_{i}_{j}") for i in range(len(names)) for j in range(i + 1)]
    now = spread.select("g_lang", "g_source", F.lit(0).alias("start"), *(f"s_{i}" for i in range(len(names))), *(F.col(f"s_{i}").alias(f"m_{i}") for i in range(len(names))), *diagonal)
    now = written(now, "mcd-start")
    with_start = _with_groups(rows, now)
    gap = sum((F.abs(F.col(v) - F.col(f"m_{i}")) / F.col(f"l_{i}_{i}") for i, v in enumerate(names)), F.lit(0.0))
    half = written(_quantile(with_start.withColumn("d2", gap), 0.5, "q"), "mcd-quantile")
    nearest = _with_groups(rows, now.join(half, GROUP)).withColumn("d2", gap).where("d2 <= q")
    first = _estimate(with_start.withColumn("start", F.lit(1))).unionByName(_estimate(nearest.withColumn("start", F.lit(2))))
    now = written(now.unionByName(first.drop("half_log")), "mcd-starts")
    for _ in range(FIRST_STEPS):
        now = _step(rows, now)
    others = [c for c in now.columns if c not in ("g_lang", "g_source", "half_log")]
    least = now.groupBy("g_lang", "g_source").agg(F.min(F.struct("half_log", *others)).alias("x"))
    now = written(least.select("g_lang", "g_source", "x.*"), "mcd-least")
    for _ in range(MAX_STEPS):
        then = _step(rows, now)
        pair = now.alias("a").join(then.alias("b"), GROUP)
        fall = F.col("a.half_log") - F.col("b.half_log")
        pick = lambda c, fall=fall: F.when(fall > 0, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
        most = pair.agg(F.max(fall)).first()[0]
        now = written(pair.select(*GROUP, *(pick(c) for c in now.columns if c not in GROUP)), "mcd-least")
        if most is None or most <= TOLERANCE:
            break
    middle = _quantile(_distance(_with_groups(rows, now)), 0.5, "half")
    chi = chi_square_quantile(0.5, len(names))
    # never below 1: floors already widen the groups that hardly vary
    scaled = now.join(middle, GROUP).withColumn("scale", F.greatest(F.col("half") / chi, F.lit(1.0)))
    return written(scaled.drop("half", "start", "half_log", *(f"s_{i}" for i in range(len(names)))), "mcd")


def _pooled(rows: DataFrame) -> DataFrame:
    """The group (g_lang, g_source) that stands for each language and source (r_lang, r_source) of the rows."""
    found = rows.groupBy("r_lang", "r_source").agg(F.sum(F.when(F.col("base_failed"), 0).otherwise(1)).alias("n"))
    found = found.withColumn("g_source", F.when(F.col("n") >= LEAST_ROWS, F.col("r_source")).otherwise(F.lit("*")))
    rest = found.groupBy("r_lang", "g_source").agg(F.sum("n").alias("m"))
    found = found.join(rest, ["r_lang", "g_source"])
    return found.select("r_lang", "r_source", F.when(F.col("m") >= LEAST_ROWS, F.col("r_lang")).otherwise(F.lit("*")).alias("g_lang"), "g_source")


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents without their text, with COUNTS, base_failed, distance2 (null without an estimate) and kept."""
    drop = {text_col, "base_failed", "kept", "distance2", *COUNTS}
    group = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(n) for c, n in ((lang_col, "r_lang"), (source_col, "r_source"))]
    names = [c for c in docs.columns if c not in drop]
    own = F.struct(*(F.col(c) for c in names), F.lit(0).alias("__none")).alias("__row")
    rows = counts(docs.select(own, *group, F.col(text_col).alias("__text")), F.col("__text")).drop("__text")
    for name, (value, _) in VECTOR.items():
        rows = rows.withColumn(name, value())
    rows = written(rows, "statistics")
    rows = _with_groups(rows, written(_pooled(rows), "mcd-pools"), ("r_lang", "r_source")).drop("r_lang", "r_source")
    groups = estimates(rows.where("NOT base_failed").select("g_lang", "g_source", *VECTOR))
    limit = chi_square_quantile(1 - TAIL, len(VECTOR))
    every = rows.select("g_lang", "g_source").distinct().join(groups, ["g_lang", "g_source"], "left")
    every = written(every, "mcd-groups")
    out = _distance(_with_groups(rows, every)).withColumn("distance2", F.col("d2") / F.col("scale"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance2") <= limit, F.lit(True))
    return out.select(*(F.col("__row")[c].alias(c) for c in names), *COUNTS, "base_failed", "distance2", kept.alias("kept"))
