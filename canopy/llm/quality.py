"""Quality rules: robust multivariate outliers of document statistics.

Each document has a vector of transformed statistics. For each language and source a
minimum-covariance-determinant estimate gives a centre and a scatter that bad documents can't
pull; documents whose Mahalanobis distance is beyond a chi-square cut-off are rejected.

The estimate: concentration steps (take the ``SUBSET`` of nearest documents, compute their mean
and covariance, repeat) from ``STARTS`` starts, the medians and small random subsets. After a few
steps the start with the smallest determinant goes on until the determinant no longer changes.

All steps are Spark aggregations over all documents. A step is one pass: documents are counted
and summed by bins of their distance, and the nearest bins that hold the wanted share are added up,
so a group may hold any share of the rows and none is sorted or held by one task.
Sums of doubles depend on the order of rows only by their rounding. Estimates are one row per group.

Null text: no words. Null language or source: a group of its own. A group with fewer
than ``min_rows`` documents that pass the base rules uses the estimate of all documents.
Repeated rows are counted and judged like any others; an empty table gives no rows. Other columns
pass; result columns take the place of input columns of their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopy.llm.stage import held, long_rows, quoted, released, written
from canopy.llm.text import Prefix, SPACE, blocks, ngrams, spans

_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_KIND = pa.struct([(c, pa.int64()) for c in _STATS])
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True

FEATURES = ("word_length", "symbols", "dup_lines", "repeats")
#: Least spread of each feature (added to the scatter), so that features without any spread stay regular. Word length has a spread of its own;
#: the counts are 0 for most documents, so theirs says what is ordinary: a repeated line, or a few symbols or repeated words, of 100 words.
#: Small enough that each feature's range can pass the cut-off by itself (7 repeated lines, or 30 repeated words, of 100 words).
FLOOR = (0.02, 0.3, 0.3, 0.5)
#: Share of a group's documents in the concentrated subset.
SUBSET = 0.75
#: Starts, documents of a random one, steps of each before the best is chosen, and at most so many after (the determinant settles before).
STARTS, FEW, FIRST, STEPS = 4, 8, 2, 30
#: Change of the determinant's logarithm under which it has settled.
SETTLED = 1e-3
#: Medians of chi-square with len(FEATURES) = 4 degrees of freedom, and the cut-off (tail 1e-9).
CHI2_MEDIAN, CHI2_CUT = 3.3567, 47.5
_BINS = 64


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeated(keys: np.ndarray, rows: np.ndarray, first_too: bool) -> np.ndarray:
    """Which entries have a key that occurs (earlier, or anywhere) in their row again."""
    order = np.lexsort((keys, rows))
    k, r = keys[order], rows[order]
    same = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    hit = np.zeros(len(k), bool)
    hit[1:] |= same
    if first_too:
        hit[:-1] |= same
    out = np.zeros(len(k), bool)
    out[order] = hit
    return out


def _statistics(text: pa.Array) -> pa.Array:
    parts = []
    for _, data, offsets in blocks(text):
        n = len(offsets) - 1
        prefix = Prefix(data)
        at, to, rows = spans(data, offsets)
        grams, first = ngrams(prefix.of(at, to), rows, 3)
        hit = first[_repeated(grams, rows[first], True)]
        covered = np.zeros(len(at) + 2, bool)
        for k in range(3):
            covered[hit + k] = True
        line_at, line_to, line_row = spans(data, offsets, _NEWLINE)
        words_before = np.concatenate([[0], np.cumsum(~SPACE[data])])
        full = words_before[line_to] > words_before[line_at]
        line_at, line_to, line_row = line_at[full], line_to[full], line_row[full]
        dup = _repeated(prefix.of(line_at, line_to), line_row, False)
        values = [
            np.bincount(rows, minlength=n),
            _per_row(~SPACE[data] & ((data & 0xC0) != 0x80), offsets),
            _per_row(_SYMBOL[data], offsets),
            np.bincount(line_row[dup], minlength=n),
            np.bincount(rows[np.flatnonzero(covered[: len(at)])], minlength=n),
        ]
        parts.append(pa.StructArray.from_arrays([pa.array(v.astype(np.int64)) for v in values], fields=list(_KIND)))
    return pa.concat_arrays(parts) if parts else pa.array([], _KIND)


def statistics(docs: DataFrame, text_col: str = "text", result: str = "stats") -> DataFrame:
    """All columns plus ``result``: struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    long_rows(docs.sparkSession)
    udf = F.arrow_udf(_statistics, "struct<" + ",".join(f"{c}:bigint" for c in _STATS) + ">")
    return docs.select(*(quoted(c) for c in docs.columns if c.lower() != result.lower()), udf(quoted(text_col)).alias(result))


def base_failed(stats: str = "stats") -> F.Column:
    """Too few words, or more than half of them in repeated 3-word windows."""
    n = F.col(f"{stats}.n_words")
    return (n < 50) | (100 * F.col(f"{stats}.n_repeat_words") > 50 * n)


def features(stats: str = "stats") -> list[F.Column]:
    """The transformed vector; counts are per word, eased by 20 words so that short texts don't stand out."""
    n = F.col(f"{stats}.n_words") + 20.0
    s = lambda c: F.col(f"{stats}.{c}")
    return [
        F.log((s("word_chars") + 100.0) / n),
        F.log1p(100.0 * s("n_symbols") / n),
        F.log1p(100.0 * s("n_dup_lines") / n),
        F.log1p(100.0 * s("n_repeat_words") / n),
    ]


def _quantile(df: DataFrame, keys: list[str], value: F.Column, share: float, name: str) -> DataFrame:
    """For each key the bin edge that at least ``share`` of its rows are at or below; bins are counted, not sorted."""
    counts = df.select(*keys, F.floor(value * _BINS).alias("__bin")).groupBy(*keys, "__bin").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*keys)
    up = counts.withColumn("__up", F.sum("__n").over(w.orderBy("__bin"))).withColumn("__all", F.sum("__n").over(w))
    return up.filter(F.col("__up") >= share * F.col("__all")).groupBy(*keys).agg(((F.min("__bin") + 1) / _BINS).alias(name))


def _distance(x: str, centre: str, inverse: str) -> F.Column:
    p = len(FEATURES)
    d = [F.element_at(x, i + 1) - F.element_at(centre, i + 1) for i in range(p)]
    return sum((d[i] * d[j] * F.element_at(inverse, i * p + j + 1) for i in range(p) for j in range(p)), F.lit(0.0))


_ESTIMATE = "g bigint, s int, centre array<double>, inverse array<double>, det double"


def _inverted(frames):
    """Centre, inverse scatter and its log determinant, from sums (one row a group and start)."""
    p = len(FEATURES)
    floor = np.diag(np.square(FLOOR))
    for f in frames:
        out = []
        for row in f.itertuples(index=False):
            mean = np.array(row.s1, float) / row.n
            scatter = np.array(row.s2, float).reshape(p, p) / row.n - np.outer(mean, mean) + floor
            out.append((row.g, row.s, mean.tolist(), np.linalg.inv(scatter).ravel().tolist(), float(np.linalg.slogdet(scatter)[1])))
        yield pd.DataFrame(out, columns=["g", "s", "centre", "inverse", "det"])


def _sums():
    """What a mean and a covariance need, as aggregates over ``x``."""
    p, e = len(FEATURES), lambda i: F.element_at("x", i + 1)
    return [F.count("*").alias("n"), F.array(*[F.sum(e(i)) for i in range(p)]).alias("s1"), F.array(*[F.sum(e(i) * e(j)) for i in range(p) for j in range(p)]).alias("s2")]


def _added(df: DataFrame, *keys: str) -> DataFrame:
    p = len(FEATURES)
    return df.groupBy(*keys).agg(F.sum("n").alias("n"), F.array(*[F.sum(F.element_at("s1", i + 1)) for i in range(p)]).alias("s1"), F.array(*[F.sum(F.element_at("s2", i + 1)) for i in range(p * p)]).alias("s2"))


def _concentrated(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """One step: the estimate of the nearest ``SUBSET`` of each group, for each of its starts."""
    near = rows.join(estimate.drop("det"), "g").select("g", "s", "x", F.floor(_BINS * F.log2(1 + _distance("x", "centre", "inverse"))).alias("bin"))
    bins = near.groupBy("g", "s", "bin").agg(*_sums())
    w = Window.partitionBy("g", "s")
    before = F.sum("n").over(w.orderBy("bin")) - F.col("n")
    inner = bins.withColumn("before", before).withColumn("all", F.sum("n").over(w)).filter(F.col("before") < SUBSET * F.col("all"))
    return written(_added(inner, "g", "s").mapInPandas(_inverted, _ESTIMATE), "mcd")


def _starts(rows: DataFrame) -> DataFrame:
    """Start 0: medians, and a diagonal scatter from median deviations. The others: a few documents, by hash."""
    p = len(FEATURES)
    tall = rows.select("g", F.posexplode("x").alias("f", "v"))
    mid = written(_quantile(tall, ["g", "f"], F.col("v"), 0.5, "m"), "mcd")  # tables: large groups can be split in joins
    away = tall.join(mid, ["g", "f"]).select("g", "f", F.abs(F.col("v") - F.col("m")).alias("a"))
    mad = _quantile(away, ["g", "f"], F.col("a"), 0.5, "a")
    spread = F.pow(1.4826 * F.col("a"), 2) + F.pow(F.element_at(F.lit(list(FLOOR)), F.col("f") + 1), 2)
    start = mid.join(mad, ["g", "f"]).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("f", "m", (1 / spread).alias("w")))).alias("z"))
    cells = [F.element_at("z", i + 1)["w"] if i == j else F.lit(0.0) for i in range(p) for j in range(p)]
    medians = start.select("g", F.lit(0).alias("s"), F.transform("z", lambda e: e["m"]).alias("centre"), F.array(*cells).alias("inverse"), F.lit(0.0).alias("det"))
    code = F.xxhash64("x")
    cell = F.pmod(code, F.lit((STARTS - 1) * FEW)).cast("int")
    few = rows.groupBy("g", cell.alias("cell")).agg(F.min(F.struct(F.xxhash64(code, F.lit(1)), "x")).alias("m")).select("g", (1 + F.floor(F.col("cell") / FEW)).cast("int").alias("s"), "m.x")
    return medians.union(few.groupBy("g", "s").agg(*_sums()).mapInPandas(_inverted, _ESTIMATE))


def _best(estimate: DataFrame) -> DataFrame:
    first = F.min(F.struct("det", "s", "centre", "inverse")).alias("m")
    return estimate.groupBy("g").agg(first).select("g", "m.s", "m.centre", "m.inverse", "m.det")


def fit(stats: DataFrame, keys: list[str], *, min_rows: int = 50, stats_col: str = "stats") -> DataFrame:
    """MCD estimates: one row per group ``g`` (hash of the keys; 0 for all documents, if a group needs it) with centre, inverse, det and scale."""
    x = F.array(*features(stats_col))
    rows = stats.filter(~base_failed(stats_col)).select(_group(keys).alias("g"), x.alias("x"))
    sizes = written(stats.groupBy(_group(keys).alias("g")).agg(F.count_if(~base_failed(stats_col)).alias("n")), "mcd-sizes")
    small = sizes.filter(F.col("n") < min_rows).select("g")
    if not small.isEmpty():
        rows = rows.join(small, "g", "left_anti").union(rows.select(F.lit(0).cast("long"), "x"))
    estimate = written(_starts(rows), "mcd")
    for _ in range(FIRST):
        estimate = _concentrated(rows, estimate)
    estimate = written(_best(estimate), "mcd")
    for _ in range(STEPS):
        after = _concentrated(rows, estimate)
        change = after.join(estimate.select("g", F.col("det").alias("was")), "g").agg(F.max(F.col("was") - F.col("det")).alias("c")).first()["c"]
        estimate = written(_best(estimate.union(after)), "mcd")
        if change is None or change < SETTLED:
            break
    last = rows.join(estimate, "g").select("g", F.log2(1 + _distance("x", "centre", "inverse")).alias("d"))
    scale = _quantile(last, ["g"], F.col("d"), 0.5, "d").select("g", F.greatest(F.lit(1.0), (F.pow(2.0, "d") - 1) / CHI2_MEDIAN).alias("scale"))
    return written(estimate.drop("s").join(scale, "g"), "mcd")


def _group(keys: list[str]) -> F.Column:
    return F.xxhash64(*[F.coalesce(quoted(k).cast("string"), F.lit("\0")) for k in keys])


def judge(stats: DataFrame, estimates: DataFrame, keys: list[str], cut: float = CHI2_CUT, stats_col: str = "stats") -> DataFrame:
    """All columns of ``stats`` plus base_failed, distance (squared, scaled) and kept."""
    own = estimates.select("g", F.struct("centre", "inverse", "scale").alias("own"))
    every = estimates.filter("g = 0").first()  # one row
    whole = F.struct(F.lit(every["centre"]).alias("centre"), F.lit(every["inverse"]).alias("inverse"), F.lit(every["scale"]).alias("scale")) if every else F.lit(None).cast("struct<centre:array<double>,inverse:array<double>,scale:double>")
    got = held(stats, g=_group(keys), x=F.array(*features(stats_col)), failed=base_failed(stats_col)).join(own, "g", "left")
    got = got.withColumn("e", F.coalesce("own", whole))
    got = got.withColumn("far", _distance("x", "e.centre", "e.inverse") / F.col("e.scale"))
    return released(got, stats.columns, base_failed=F.col("failed"), distance=F.col("far"), kept=~F.col("failed") & F.coalesce(F.col("far") <= cut, F.lit(True)))
