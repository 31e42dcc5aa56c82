"""Quality rules: base limits, then robust multivariate outliers by language and source.

Every text gets five statistics.  Rows that pass the base limits give a transformed vector; for each
(language, source) the minimum-covariance-determinant estimate of centre and scatter is found by
concentration steps over all rows of the group: distances under the present estimate, the share
SUBSET of smallest distances, their mean and covariance, and again.  A step is one aggregation:
distances fall in fine logarithmic bins, moments are summed by group and bin, and the bins that make
up the subset give the next estimate, so no group is ever gathered.  A group's start takes steps until
its determinant is, within SETTLED, one that it had before (bins can make it go round); of four starts (medians with floors, with median deviations, with both, and
with the mean and all variances) the one with the smallest determinant stays.  A row is rejected if its
squared Mahalanobis distance is over ``cutoff``, a quantile of the chi-square distribution.  Groups
under MIN_GROUP rows are pooled by language, and those still under it together.

Cases: a null text has no words and fails the base limits; null language or source is a value of its
own; rows with equal columns are judged alike; an empty table stays empty; a statistic that does not
vary has a floor under its variance (FLOORS), so it rejects nothing by rounding; where variances lie
under their floors, distances are smaller than chi-square and the rule is milder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .flat import WHITE, hashes, runs, slices, windows, words
from .shared import lean, lean_group, stage

MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
SUBSET, MIN_GROUP = 0.75, 100
#: Log determinants this close are equal; more than MOST_STEPS steps are an error.
SETTLED, MOST_STEPS = 1e-6, 200
#: The 1 - 6e-8 quantile of the chi-square distribution with five degrees of freedom.
CUTOFF = 42.0
#: Smallest standard deviation of each transformed statistic.
FLOORS = (0.7, 0.1, 0.05, 0.5, 0.1)
P = len(FLOORS)
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_NULL = "\x00null"
#: Bytes of texts whose words are held in memory at once.
SLICE = 1 << 19


def _distinct_runs(of: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of (of, h), and for each row of it whether it equals the row before."""
    order = np.lexsort((h, of))
    a, b = of[order], h[order]
    return order, np.r_[False, (a[1:] == a[:-1]) & (b[1:] == b[:-1])] if len(order) else np.zeros(0, bool)


def statistics(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The five statistics of each text of a slice (see flat.slices)."""
    n = len(off) - 1
    starts, ends, doc = words(data, off)
    h = hashes(data, starts, ends)
    out = {"n_words": np.bincount(doc, minlength=n)}
    for name, hit in (("word_chars", ((data & 0xC0) != 0x80) & ~WHITE[data]), ("n_symbols", _SYMBOL[data])):
        out[name] = np.diff(np.r_[0, np.cumsum(hit)][off])
    first, last = runs(data != 10, off)
    with_word = np.zeros(len(first), bool)
    if len(first):
        count = np.r_[0, np.cumsum(~WHITE[data])]
        with_word = count[last] > count[first]
    first, last = first[with_word], last[with_word]
    of = np.searchsorted(off, first, "right") - 1
    _, again = _distinct_runs(of, line := hashes(data, first, last))
    out["n_dup_lines"] = np.bincount(np.sort(of)[again] if len(line) else of, minlength=n)
    h5, at = windows(h, doc, 5)
    order, again = _distinct_runs(doc[at], h5)
    twice = again | np.r_[again[1:], False] if len(again) else again
    mark = np.zeros(len(h) + 1, np.int64)
    np.add.at(mark, at[order[twice]], 1)
    np.add.at(mark, at[order[twice]] + 5, -1)
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(mark[:-1]) > 0], minlength=n)
    return out


def column_statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """The five statistics of each text of a column, taken slice by slice."""
    parts = [statistics(data, off) for _, data, off in slices(column, SLICE)]
    return {s: np.concatenate([p[s] for p in parts]) if parts else np.zeros(0, np.int64) for s in STATS}


def with_statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all by default) and the five statistics as longs."""
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in STATS]
    source = docs.select(*[F.col(c) for c in kept], F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = column_statistics(b.column("__text"))
            cols = [pa.array(found[s], pa.int64()) for s in STATS]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *cols], schema=pa.schema([*(b.schema.field(c) for c in kept), *(pa.field(s, pa.int64()) for s in STATS)]))

    schema = source.select(*kept).withColumns({s: F.lit(0).cast("long") for s in STATS}).schema
    return source.mapInArrow(lean(run), schema)


def base_failed() -> Column:
    n, repeat = F.col("n_words"), F.col("n_repeat_words")
    return (n < MIN_WORDS) | (repeat * 100 > n * MAX_REPEAT_PERCENT)


def vector() -> list[Column]:
    """The transformed statistics: sizes as logarithms, shares as square roots."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log(n),
        F.log((F.col("word_chars") + 1) / n),
        F.sqrt(F.col("n_symbols") / (F.col("word_chars") + 1)),
        F.log1p(F.col("n_dup_lines").cast("double")),
        F.sqrt(F.col("n_repeat_words") / n),
    ]


def _group_keys(rows: DataFrame) -> DataFrame:
    """(__lang, __source, __group) for every pair that occurs."""
    pairs = rows.groupBy("__lang", "__source").agg(F.count(F.lit(1)).alias("n"))
    small = pairs.filter(F.col("n") < MIN_GROUP).groupBy("__lang").agg(F.sum("n").alias("pool"))
    own = F.concat_ws("\x01", "__lang", "__source")
    both = pairs.join(small, "__lang", "left")
    group = F.when(F.col("n") >= MIN_GROUP, own).when(F.col("pool") >= MIN_GROUP, F.concat_ws("\x01", F.col("__lang"), F.lit("\x02"))).otherwise(F.lit("\x02"))
    return stage(both.select("__lang", "__source", group.alias("__group")), "mcd-groups")


def _scaled(cov: np.ndarray, share: float) -> np.ndarray:
    """Covariance of the subset, made consistent for normal data; variances under their floors are raised to them."""
    x = np.linspace(0, 60, 60001)
    density = lambda k: x ** (k / 2 - 1) * np.exp(-x / 2)
    cdf = lambda k: np.cumsum(d := density(k)) / d.sum()
    q = int(np.searchsorted(cdf(P), share))
    cov = cov * (share / cdf(P + 2)[min(q, 60000)])
    return cov + np.diag(np.maximum(np.square(FLOORS) - np.diag(cov), 0))


def _estimate(count: float, s: np.ndarray, ss: np.ndarray, share: float) -> tuple[list[float], list[float], float]:
    """Centre, inverse scatter (flat) and log determinant from sums of a subset."""
    mean = s / count
    cov = np.zeros((P, P))
    for k, (i, j) in enumerate(PAIRS):
        cov[i, j] = cov[j, i] = ss[k] / count - mean[i] * mean[j]
    cov = _scaled(cov, share)
    return mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])


_PARAMS = "__group string, start int, mean array<double>, inverse array<double>, logdet double"


def _distance(mean: str = "mean", inverse: str = "inverse") -> Column:
    d = [F.col(f"__x{i}") - F.col(mean)[i] for i in range(P)]
    return sum((F.col(inverse)[i * P + j] * d[i] * d[j] * (1 if i == j else 2) for i, j in PAIRS), F.lit(0.0))


def _starts(rows: DataFrame) -> DataFrame:
    """Starts 0 to 2: coordinate medians, with the floors as scales, with median deviations where they are
    over the floors, and with both added; start 3: means and variances of all rows."""
    grid = 64

    def middle(values: DataFrame) -> DataFrame:
        n = values.groupBy("__group", "k", "bin").agg(F.count(F.lit(1)).alias("n"))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("bin")
            c = pdf["n"].to_numpy().cumsum()
            return pd.DataFrame({"__group": [pdf["__group"].iloc[0]], "k": [pdf["k"].iloc[0]], "m": [float(pdf["bin"].iloc[int(np.searchsorted(c, c[-1] / 2))]) / grid]})

        return n.groupBy("__group", "k").applyInPandas(lean_group(run), "__group string, k int, m double")

    long = rows.select("__group", F.posexplode(F.array(*[f"__x{i}" for i in range(P)])).alias("k", "v"))
    binned = lambda v: F.round(v * grid).cast("long").alias("bin")
    median = stage(middle(long.select("__group", "k", binned(F.col("v")))), "mcd-medians")
    spread = middle(long.join(median, ["__group", "k"]).select("__group", "k", binned(F.abs(F.col("v") - F.col("m")))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        out = []
        floor, wide = np.square(FLOORS), np.square(1.4826 * pdf["d"].to_numpy())
        middle, mean, all_ = (pdf[c].tolist() for c in ("m", "mean", "var"))
        for start, (centre, var) in enumerate(((middle, floor), (middle, np.maximum(wide, floor)), (middle, wide + floor), (mean, np.maximum(all_, floor)))):
            out.append((pdf["__group"].iloc[0], start, centre, np.diag(1 / var).ravel().tolist(), float(np.log(var).sum())))
        return pd.DataFrame(out, columns=["__group", "start", "mean", "inverse", "logdet"])

    plain = long.groupBy("__group", "k").agg(F.avg("v").alias("mean"), F.var_pop("v").alias("var"))
    both = median.join(spread.withColumnRenamed("m", "d"), ["__group", "k"]).join(plain, ["__group", "k"])
    return stage(both.groupBy("__group").applyInPandas(lean_group(run), _PARAMS), "mcd-start")


def _step(rows: DataFrame, params: DataFrame) -> DataFrame:
    d = rows.join(params, "__group").withColumn("bin", F.floor(F.log2(_distance() + F.lit(1e-9)) * 32).cast("int"))
    sums = [F.sum(f"__x{i}").alias(f"s{i}") for i in range(P)] + [F.sum(F.col(f"__x{i}") * F.col(f"__x{j}")).alias(f"s{i}{j}") for i, j in PAIRS]
    bins = d.groupBy("__group", "start", "bin").agg(F.count(F.lit(1)).alias("n"), *sums)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        n = pdf["n"].to_numpy().astype(float)
        upto = int(np.searchsorted(n.cumsum(), SUBSET * n.sum())) + 1
        part = pdf.iloc[:upto]
        sub = part["n"].sum()
        s = part[[f"s{i}" for i in range(P)]].to_numpy().sum(axis=0)
        ss = part[[f"s{i}{j}" for i, j in PAIRS]].to_numpy().sum(axis=0)
        got = _estimate(float(sub), s, ss, min(0.999, sub / n.sum()))
        return pd.DataFrame([(pdf["__group"].iloc[0], int(pdf["start"].iloc[0]), *got)], columns=["__group", "start", "mean", "inverse", "logdet"])

    return bins.groupBy("__group", "start").applyInPandas(lean_group(run), _PARAMS)


def fit_mcd(stats: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(__lang, __source, __mean, __inverse) from a table of statistics; rows that fail the base limits
    take no part."""
    rows = stats.filter(~base_failed()).select(
        F.coalesce(F.col(lang).cast("string"), F.lit(_NULL)).alias("__lang"), F.coalesce(F.col(source).cast("string"), F.lit(_NULL)).alias("__source"), *[x.alias(f"__x{i}") for i, x in enumerate(vector())]
    )
    keys = _group_keys(rows)
    rows = stage(rows.join(keys, ["__lang", "__source"]).select("__group", *[f"__x{i}" for i in range(P)]), "mcd-rows")
    params, done = _starts(rows).withColumn("seen", F.array().cast("array<double>")), None
    for _ in range(MOST_STEPS):
        moved = _step(rows, params).join(params.select("__group", "start", "seen"), ["__group", "start"])
        settled = F.exists("seen", lambda x: F.abs(x - F.col("logdet")) <= SETTLED)
        moved = stage(moved.withColumns({"settled": settled, "seen": F.concat("seen", F.array("logdet"))}), "mcd-step")
        ended, params = moved.filter("settled"), moved.filter("NOT settled").drop("settled")
        done = ended if done is None else done.unionByName(ended)
        if params.isEmpty():
            break
    else:
        raise RuntimeError(f"determinants did not settle in {MOST_STEPS} steps")
    best = done.groupBy("__group").agg(F.min_by(F.struct("mean", "inverse"), F.struct("logdet", "start")).alias("b"))
    return stage(keys.join(best, "__group").select("__lang", "__source", F.col("b.mean").alias("__mean"), F.col("b.inverse").alias("__inverse")), "mcd-fit")


def judged(stats: DataFrame, fit: DataFrame, lang: str = "lang", source: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """stats with base_failed, distance (squared; null where the base limits fail) and kept."""
    own = [c for c in stats.columns if c not in ("base_failed", "distance", "kept")]
    on = [F.coalesce(F.col(lang).cast("string"), F.lit(_NULL)) == F.col("__lang"), F.coalesce(F.col(source).cast("string"), F.lit(_NULL)) == F.col("__source")]
    x = stats.withColumns({f"__x{i}": v for i, v in enumerate(vector())}).join(fit, on, "left")
    distance = F.when(~base_failed(), _distance("__mean", "__inverse"))
    return x.select(*own, base_failed().alias("base_failed"), distance.alias("distance"), (~base_failed() & F.coalesce(distance <= cutoff, F.lit(True))).alias("kept"))


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", cutoff: float = CUTOFF, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with statistics, base_failed, distance and kept."""
    stats = stage(with_statistics(docs, text, [lang, source]), "statistics")
    return judged(with_statistics(docs, text, keep), fit_mcd(stats, lang, source), lang, source, cutoff)
