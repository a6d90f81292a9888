"""Quality rules: base statistics of texts, and robust multivariate outliers among them, in SQL functions only.

Statistics are turned into a vector of five logarithms: length, mean word
length, share of symbols, of repeated lines, of repeated words. Per language
and source, the minimum covariance determinant's mean and covariance are
estimated by concentration steps from three starts: medians with median
deviations, all rows' mean and covariance, and medians with the covariance of
spatial signs. A step takes the rows with the smallest Mahalanobis distances (a
share of SUPPORT, to the end of a distance bucket) and gives the next mean and
covariance; steps end when no determinant falls any more, or after STEPS. Of a
group's starts the one with the least determinant is kept, and reweighted: the
mean and covariance of the rows within the REWEIGHT point of its distances. Rows
beyond a fixed distance under that are rejected. A step is one aggregate by
group, start and distance bucket, which combines before shuffling.

Rows that fail the base rule are not used for estimates. Groups of fewer than
MIN_ROWS rows are judged by the estimate of their language's rows, or of all
rows if those are too few as well. A null language or source is a group of its
own. Each variance has a floor, so that columns without spread don't reject
ordinary texts. A null or empty text has no words, and fails the base rule. A
very long text is one row's array. A tie at the edge of a step is taken whole.
Equal rows are judged alike, whatever their doc_id. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelens.llm import common as C

SUPPORT, STEPS, MIN_ROWS, REWEIGHT = 0.75, 8, 50, 0.975
#: Models of so many groups (about 200 bytes each) are broadcast.
MOST_BROADCAST = 20_000
#: Least standard deviation of each transformed statistic.
FLOOR = (0.5, 0.08, 0.5, 0.7, 0.7)
#: Squared distances are rejected if the chance of more, for normal data, is below this.
TAIL = 1e-3
Z = ("z1", "z2", "z3", "z4", "z5")

_REPEATED = """
CASE WHEN size(w) < 6 THEN 0L ELSE
  transform(array(transform(w, x -> xxhash64(x))), g ->
    transform(array(transform(sequence(0, size(g) - 5), i -> xxhash64(g[i], g[i + 1], g[i + 2], g[i + 3], g[i + 4]))), h ->
      CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE
        transform(array(array_sort(zip_with(h, sequence(0, size(h) - 1), (a, b) -> named_struct('v', a, 'at', b)))), s ->
          aggregate(
            array_sort(transform(filter(sequence(0, size(s) - 1), i -> (i > 0 AND s[i].v = s[greatest(i, 1) - 1].v) OR (i < size(s) - 1 AND s[i].v = s[least(i + 1, size(s) - 1)].v)), i -> s[i].at)),
            named_struct('n', 0L, 'end', 0),
            (a, p) -> named_struct('n', a.n + CAST(p + 5 - greatest(p, a.end) AS BIGINT), 'end', p + 5),
            a -> a.n))[0]
      END)[0])[0]
END
"""


def statistics(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base statistics of each row."""
    blank = r"[\\x20\\x09-\\x0D]"
    df = documents.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    df = df.selectExpr(
        "doc_id",
        "lang",
        "source",
        f"filter(split(text, '{blank}+'), x -> x <> '') AS w",
        f"filter(split(text, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]') AS lines",
        r"CAST(length(translate(text, ' \t\n\u000B\u000C\r', '')) AS BIGINT) AS word_chars",
        "CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols",
    )
    return df.selectExpr("doc_id", "lang", "source", "CAST(size(w) AS BIGINT) AS n_words", "word_chars", "n_symbols", "CAST(size(lines) - size(array_distinct(lines)) AS BIGINT) AS n_dup_lines", f"{_REPEATED} AS n_repeat_words").withColumn(
        "base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    )


def _transformed(df: DataFrame) -> DataFrame:
    n = F.greatest("n_words", F.lit(1))
    z = (F.log1p("n_words"), F.log1p(F.col("word_chars") / n), F.log1p(100 * F.col("n_symbols") / F.greatest("word_chars", F.lit(1))), F.log1p(1000 * F.col("n_dup_lines") / n), F.log1p(100 * F.col("n_repeat_words") / n))
    return df.withColumns(dict(zip(Z, z, strict=True)))


def _chi2_below(x: float, k: int) -> float:
    """P(chi-squared with k degrees of freedom <= x), k odd."""
    p, term = math.erf(math.sqrt(x / 2)), 0.0
    for j in range(1, k, 2):
        term = (x / 2) ** (j / 2) * math.exp(-x / 2) / math.gamma(j / 2 + 1)
        p -= term
    return p


def _chi2_at(share: float, k: int) -> float:
    lo, hi = 0.0, 500.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_below(mid, k) < share else (lo, mid)
    return hi


def _keyed(models: DataFrame) -> DataFrame:
    """The models, marked for broadcast if there are few enough."""
    return F.broadcast(models) if models.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else models


def _distance(rows: DataFrame, model: DataFrame, key: tuple[str, ...] = ("g",)) -> DataFrame:
    """Rows with d2, the squared Mahalanobis distance, by forward substitution with the Cholesky factor l of their group; a row for each start if the model has several."""
    df = rows.join(_keyed(model), list(key), "left")
    own = [c for c in (*rows.columns, "start") if c in df.columns]
    y: list[str] = []
    for i, z in enumerate(Z):
        rest: Column = F.col(z) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(y[j])
        y.append(f"y{i}")
        df = df.withColumn(y[i], rest / F.col(f"l{i}{i}"))
    d2 = sum((F.col(x) * F.col(x) for x in y[1:]), F.col(y[0]) * F.col(y[0]))
    return df.select(*own, d2.alias("d2"))


_PAIRS = [(i, j) for i in range(len(Z)) for j in range(i + 1)]


def _factored(model: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Means m, Cholesky factors l of the covariances c with the floors added, and the logarithm of their determinants."""
    for i, j in _PAIRS:
        rest: Column = F.col(f"c{i}{j}") + F.lit(FLOOR[i] ** 2 if i == j else 0.0)
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        model = model.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOOR[i] ** 2 / 4))) if i == j else rest / F.col(f"l{j}{j}"))
    det = sum((2 * F.log(f"l{i}{i}") for i in range(1, len(Z))), 2 * F.log("l00"))
    return C.checkpointed(model.select(*key, *(f"m{i}" for i in range(len(Z))), *(f"l{i}{j}" for i, j in _PAIRS), det.alias("det")))


def _moments() -> list[Column]:
    """Sums from which means and covariances come, of what is aggregated."""
    return [F.count("*").alias("n"), *(F.sum(z).alias(f"s{i}") for i, z in enumerate(Z)), *(F.sum(F.col(Z[i]) * F.col(Z[j])).alias(f"q{i}{j}") for i, j in _PAIRS)]


def _from_moments(sums: DataFrame, key: tuple[str, ...], grow: float) -> DataFrame:
    """Means m and covariances c, times `grow`, of summed moments."""
    total = sums.groupBy(*key).agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(len(Z))), *(F.sum(f"q{i}{j}").alias(f"q{i}{j}") for i, j in _PAIRS))
    n = F.col("n")
    return total.select(*key, *((F.col(f"s{i}") / n).alias(f"m{i}") for i in range(len(Z))), *((grow * (F.col(f"q{i}{j}") / n - F.col(f"s{i}") * F.col(f"s{j}") / (n * n))).alias(f"c{i}{j}") for i, j in _PAIRS))


def _starts(rows: DataFrame) -> DataFrame:
    """The three first models of each group g."""
    p = len(Z)
    middle = C.checkpointed(rows.groupBy("g").agg(*(F.percentile_approx(z, 0.5, 1000).alias(f"m{i}") for i, z in enumerate(Z))))
    spread = rows.join(_keyed(middle), "g").groupBy("g").agg(*(F.percentile_approx(F.abs(F.col(z) - F.col(f"m{i}")), 0.5, 1000).alias(f"d{i}") for i, z in enumerate(Z)))
    scale = C.checkpointed(middle.join(spread, "g").select("g", *(f"m{i}" for i in range(p)), *(F.greatest(1.4826 * F.col(f"d{i}"), F.lit(FLOOR[i])).alias(f"d{i}") for i in range(p))))
    one = scale.select("g", F.lit(0).alias("start"), *(f"m{i}" for i in range(p)), *((F.col(f"d{i}") * F.col(f"d{i}") if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in _PAIRS))
    two = _from_moments(rows.groupBy("g").agg(*_moments()), ("g",), 1.0).withColumn("start", F.lit(1))
    # spatial signs: directions from the medians, in units of the deviations
    u = [(F.col(z) - F.col(f"m{i}")) / F.col(f"d{i}") for i, z in enumerate(Z)]
    size = F.greatest(F.sqrt(sum((x * x for x in u[1:]), u[0] * u[0])), F.lit(1e-9))
    signs = rows.join(_keyed(scale), "g").select("g", *((x / size).alias(f"u{i}") for i, x in enumerate(u)))
    turned = signs.groupBy("g").agg(*(F.avg(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"v{i}{j}") for i, j in _PAIRS))
    three = scale.join(turned, "g").select("g", F.lit(2).alias("start"), *(f"m{i}" for i in range(p)), *((F.lit(float(p)) * F.col(f"v{i}{j}") * F.col(f"d{i}") * F.col(f"d{j}")).alias(f"c{i}{j}") for i, j in _PAIRS))
    return _factored(one.unionByName(two).unionByName(three), ("g", "start"))


def _nearest(far: DataFrame) -> DataFrame:
    """Moments by group and start of the rows that a step takes, from rows with d2."""
    bucket = F.floor(16 * F.log2(F.col("d2") + 1e-6)).cast("int")
    by = far.withColumn("bucket", bucket).groupBy("g", "start", "bucket").agg(*_moments())
    w = Window.partitionBy("g", "start")  # some hundred buckets
    before = F.sum("n").over(w.orderBy("bucket")) - F.col("n")
    return by.withColumn("before", before).withColumn("all", F.sum("n").over(w)).where(F.col("before") < SUPPORT * F.col("all")).drop("before", "all", "bucket")


def estimates(rows: DataFrame) -> DataFrame:
    """The minimum covariance determinant's reweighted estimates of each group g of the rows."""
    p, both = len(Z), ("g", "start")
    # normal data: the covariance of the nearest share is too small by this factor
    grow = SUPPORT / _chi2_below(_chi2_at(SUPPORT, p), p + 2)
    model, before = _starts(rows), None
    for _ in range(STEPS):
        model = _factored(_from_moments(_nearest(_distance(rows, model)), both, grow), both)
        now = model.agg(F.sum("det")).first()[0]
        if now is None or (before is not None and abs(now - before) <= 1e-6 * max(1.0, abs(now))):
            break
        before = now
    best = model.groupBy("g").agg(F.min_by(F.struct(*(c for c in model.columns if c not in both)), F.struct("det", "start")).alias("x")).select("g", "x.*")
    best = C.checkpointed(best)
    limit = _chi2_at(REWEIGHT, p)
    near = _distance(rows, best).where(F.col("d2") <= limit).groupBy("g").agg(*_moments())
    return _factored(_from_moments(near, ("g",), REWEIGHT / _chi2_below(limit, p + 2)), ("g",))


def judged(documents: DataFrame) -> DataFrame:
    """The statistics, base_failed, kept and d2 of each row of `documents` (doc_id, text, lang, source)."""
    rows = C.checkpointed(_transformed(statistics(documents)))
    passed = rows.where("not base_failed")

    def name(level: str, *columns: str) -> Column:
        return F.to_json(F.struct(F.lit(level).alias("level"), *columns), {"ignoreNullFields": "false"})

    # of each language and source: its own estimate, its language's, or that of all rows
    count = passed.groupBy("lang", "source").agg(F.count("*").alias("n"))
    count = count.withColumn("of_lang", F.sum("n").over(Window.partitionBy("lang")))
    own, lang = F.col("n") >= MIN_ROWS, F.col("of_lang") >= MIN_ROWS
    count = count.withColumn("g", F.when(own, name("own", "lang", "source")).when(lang, name("lang", "lang")).otherwise(name("all")))
    count = C.checkpointed(count.select(F.col("lang").alias("l"), F.col("source").alias("s"), "g"))
    needed = count.select("g").distinct()
    # rows take part in each estimate that is needed and that they belong to
    levels = passed.select(*Z, F.explode(F.array(name("own", "lang", "source"), name("lang", "lang"), name("all"))).alias("g"))
    model = estimates(C.checkpointed(levels.join(_keyed(needed), "g", "left_semi")))
    placed = rows.join(_keyed(count), rows.lang.eqNullSafe(F.col("l")) & rows.source.eqNullSafe(F.col("s")), "left").drop("l", "s")
    limit = _chi2_at(1 - TAIL, len(Z))
    return _distance(placed, model).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= limit, F.lit(True)))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = judged(C.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")
