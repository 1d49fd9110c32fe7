"""Quality rules: robust multivariate outliers of text statistics.

Each document is a vector of transformed statistics. For each language and source the
minimum covariance determinant is sought by concentration steps over all documents:
from two deterministic starts (medians and absolute deviations; the correlation of
squashed scores) the share H of documents nearest by Mahalanobis distance gives the next
mean and covariance, which never has a larger determinant; the better start is kept.
The estimate is made consistent by its median distance and reweighted once. Documents
further than the cutoff are rejected.

A step is two aggregations over the table of vectors: a histogram of distances by group,
whose H-quantile is read off, and the sums and products of the nearest documents. No
group is ever gathered in one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.textarrays import Words, lean, pieces, string_buffers
from newsloom.session import drop_stored, ship, store

STATISTICS = ("word_length", "upper", "marks", "spaces", "repeats")
H, STEPS, CUTOFF = 0.75, 4, 100.0
#: A text of n words shows n / (n + FEW) of its deviation from its group's median: few
#: words give noisy statistics, which say little about quality.
FEW = 40.0
#: Smaller groups are judged by their language, and languages below it by all documents.
MIN_GROUP = 100
_BIN = 40  # histogram bins for each doubling of the squared distance


def statistics(words: Words, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Transformed statistics of each text (rows x statistics); raw is the original text."""
    size = np.maximum(1, np.diff(ends)).astype(float)
    edge = ends

    def share(table: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(table[raw])]
        return (total[edge[1:]] - total[edge[:-1]]) / size

    kinds = np.zeros((3, 256), np.int64)
    for c in range(128):
        kinds[0, c], kinds[1, c] = chr(c).isupper(), chr(c).isspace()
        kinds[2, c] = not chr(c).isalnum() and not chr(c).isspace()
    n = np.maximum(1, words.count)
    lengths = np.bincount(words.doc, words.end - words.start, words.rows) / n
    order = np.lexsort((words.hash, words.doc))
    d, h = words.doc[order], words.hash[order]
    again = np.zeros(len(d), bool)
    again[1:] = (d[1:] == d[:-1]) & (h[1:] == h[:-1])
    kinds_seen = n - np.bincount(d, again, words.rows)
    # distinct words are about C * n ** 0.8 in prose of any length; the deviation is the statistic
    repeats = np.log(np.maximum(1, kinds_seen)) - 0.8 * np.log(n)
    root = np.sqrt
    upper, spaces, marks = (share(kinds[k]) for k in range(3))
    return np.stack([np.log(np.maximum(0.1, lengths)), root(upper), root(marks), root(spaces), repeats], axis=1)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            words = Words(part.column("text"))
            x = statistics(words, *string_buffers(part.column("text")))
            filled = pa.array(words.count > 0)
            columns = [part.column(n) for n in ("id", "lang", "source")] + [pa.array(np.round(x[:, k], 9)) for k in range(x.shape[1])] + [pa.array(words.count / (words.count + FEW)), filled]
            yield pa.RecordBatch.from_arrays(columns, ["id", "lang", "source", *(f"x{k}" for k in range(x.shape[1])), "seen", "filled"])


def _estimates(p: int):
    """Rows of sums (group, start, n, s*, q**) -> mean, inverse covariance, log determinant."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            n = f["n"].to_numpy(float)
            mean = f[[f"s{i}" for i in range(p)]].to_numpy(float) / n[:, None]
            cov = np.zeros((len(f), p, p))
            for i in range(p):
                for j in range(i, p):
                    cov[:, i, j] = cov[:, j, i] = f[f"q{i}_{j}"].to_numpy(float) / n - mean[:, i] * mean[:, j]
            # a statistic that doesn't vary gets a small spread, so any distance exists
            cov[:, np.arange(p), np.arange(p)] = np.maximum(cov[:, np.arange(p), np.arange(p)], 0) + 1e-5
            inverse = np.linalg.inv(cov)
            out = pd.DataFrame({"grp": f["grp"], "start": f["start"], "logdet": np.round(np.linalg.slogdet(cov)[1], 9)})
            for i in range(p):
                out[f"m{i}"] = mean[:, i]
                for j in range(i, p):
                    out[f"p{i}_{j}"] = inverse[:, i, j] * (1 if i == j else 2)
            yield out

    return run


def _chi2_quantile(prob: float, p: int) -> float:
    """Wilson-Hilferty quantile of chi-squared with p degrees."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(prob)
    return p * (1 - 2 / (9 * p) + z * math.sqrt(2 / (9 * p))) ** 3


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", h: float = H, steps: int = STEPS, cutoff: float = CUTOFF, min_group: int = MIN_GROUP) -> DataFrame:
    """(doc_id, grp, distance, keep) of every row; distance is the squared Mahalanobis distance.

    keep is false beyond `cutoff` and for texts without a word (null, empty, marks only),
    whose distance is null. grp is the JSON list of the language and source whose estimate judges
    the document, of the language alone for groups of fewer than min_group texts, and empty ([])
    where the language has too few: too few texts have no covariance of their own. Null and
    empty languages and sources are groups of their own. Repeated rows and null ids are judged
    like others. Ties at the H-quantile are all counted as near. No rows give no rows; extra
    columns of any name aren't read.
    """
    spark = docs.sparkSession
    ship(spark)
    p = len(STATISTICS)
    xs = [f"x{k}" for k in range(p)]
    picked = docs.select(F.col(id_col).alias("id"), F.to_json(F.array(F.col(lang_col).cast("string"))).alias("lang"), F.to_json(F.array(F.col(lang_col).cast("string"), F.col(source_col).cast("string"))).alias("source"), F.col(text_col).cast("string").alias("text"))
    kind = picked.dtypes[0][1]
    schema = f"id {kind}, lang string, source string, {', '.join(f'{x} double' for x in xs)}, seen double, filled boolean"
    base, p_base = store(picked.mapInArrow(lean(_vectors), schema), "statistics")
    sizes = base.where("filled").groupBy("lang", "source").count()
    by_lang = Window.partitionBy("lang")
    place = sizes.withColumn("in_lang", F.sum("count").over(by_lang)).select(
        "lang", "source", F.when(F.col("count") >= min_group, F.col("source")).when(F.col("in_lang") >= min_group, F.col("lang")).otherwise(F.lit("[]")).alias("grp")
    )
    levels = base.where("filled").join(place, ["lang", "source"])
    # a language's or the whole corpus's estimate rests on all its documents, not on the small groups alone
    wanted = place.select("grp").distinct()
    member = F.explode(F.array_distinct(F.array("grp", "lang", F.lit("[]")))).alias("grp")
    data, p_data = store(levels.select(*xs, "seen", member).join(wanted, "grp"), "members")
    medians = data.groupBy("grp").agg(*[F.percentile_approx(x, 0.5, 1000).alias(f"c{k}") for k, x in enumerate(xs)])
    centred = data.join(medians, "grp")
    shrunk = [(F.col(f"c{k}") + (F.col(x) - F.col(f"c{k}")) * F.col("seen")).alias(x) for k, x in enumerate(xs)]
    centred = centred.select("grp", *shrunk, *[f"c{k}" for k in range(p)])
    spread = centred.groupBy("grp").agg(*[F.greatest(F.percentile_approx(F.abs(F.col(x) - F.col(f"c{k}")), 0.5, 1000) * 1.4826, F.lit(1e-3)).alias(f"d{k}") for k, x in enumerate(xs)])
    robust, p_robust = store(medians.join(spread, "grp"), "robust")
    data, p_shrunk = store(data.join(robust, "grp").select("grp", *shrunk), "shrunk")
    drop_stored(spark, p_data)

    def moments(df: DataFrame, values: list) -> DataFrame:
        named = df.select("grp", "start", *[v.alias(f"v{k}") for k, v in enumerate(values)])
        sums = [F.sum(f"v{i}").alias(f"s{i}") for i in range(p)]
        products = [F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"q{i}_{j}") for i in range(p) for j in range(i, p)]
        return named.groupBy("grp", "start").agg(F.count("*").alias("n"), *sums, *products)

    cells = [f"m{i}" for i in range(p)] + [f"p{i}_{j}" for i in range(p) for j in range(i, p)]
    fit_schema = "grp string, start int, logdet double, " + ", ".join(f"{c} double" for c in cells)

    def fit(sums: DataFrame, label: str) -> tuple[DataFrame, str]:
        return store(sums.mapInPandas(_estimates(p), fit_schema), label)

    def distance(df: DataFrame, estimate: DataFrame, keys: list[str]) -> DataFrame:
        joined = df.join(estimate, keys)
        gap = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(p)]
        terms = [F.col(f"p{i}_{j}") * gap[i] * gap[j] for i in range(p) for j in range(i, p)]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return joined.withColumn("d2", F.greatest(total, F.lit(1e-12)))

    def quantile(df: DataFrame, share: float) -> DataFrame:
        """The bin in which the share of each (grp, start) is reached."""
        bins = df.groupBy("grp", "start", F.floor(F.log2("d2") * _BIN).alias("bin")).count()
        upto = Window.partitionBy("grp", "start").orderBy("bin")
        ranked = bins.withColumn("upto", F.sum("count").over(upto)).withColumn("all", F.sum("count").over(Window.partitionBy("grp", "start")))
        return ranked.where(F.col("upto") >= F.ceil(F.col("all") * share)).groupBy("grp", "start").agg(F.min("bin").alias("edge"))

    score = data.join(robust, "grp")
    z = [(F.col(x) - F.col(f"c{k}")) / F.col(f"d{k}") for k, x in enumerate(xs)]
    ball = score.withColumn("d2", F.greatest(sum((v * v for v in z[1:]), z[0] * z[0]), F.lit(1e-12))).withColumn("start", F.lit(0))
    near = ball.join(quantile(ball, h), ["grp", "start"]).where(F.floor(F.log2("d2") * _BIN) <= F.col("edge"))
    first = moments(near, [F.col(x) for x in xs])
    squash = [F.col(f"c{k}") + F.col(f"d{k}") * F.tanh(v) for k, v in enumerate(z)]
    second = moments(score.withColumn("start", F.lit(1)), squash)
    estimate, p_estimate = fit(first.unionByName(second), "mcd")
    for step in range(steps + 1):
        far = distance(data, estimate, ["grp"])
        near = far.join(quantile(far, h), ["grp", "start"]).where(F.floor(F.log2("d2") * _BIN) <= F.col("edge"))
        estimate, path = fit(moments(near, [F.col(x) for x in xs]), "mcd")
        drop_stored(spark, p_estimate)
        p_estimate = path
        if step == steps - 1:  # one start a group goes on
            order = Window.partitionBy("grp").orderBy("logdet", "start")
            estimate, path = store(estimate.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank"), "mcd")
            drop_stored(spark, p_estimate)
            p_estimate = path
    # consistency: the median distance of all documents is that of chi-squared
    far = distance(data, estimate, ["grp"])
    scale = quantile(far, 0.5).select("grp", (F.pow(F.lit(2.0), (F.col("edge") + 0.5) / _BIN) / _chi2_quantile(0.5, p)).alias("scale"))
    good = far.join(scale, "grp").where(F.col("d2") <= F.col("scale") * _chi2_quantile(0.975, p))
    final, p_final = fit(moments(good, [F.col(x) for x in xs]), "mcd")
    far = distance(data, final, ["grp"])
    scale = quantile(far, 0.5).select("grp", (F.pow(F.lit(2.0), (F.col("edge") + 0.5) / _BIN) / _chi2_quantile(0.5, p)).alias("scale"))
    centres = robust.select("grp", *[f"c{k}" for k in range(p)])
    params, p_params = store(final.drop("start").join(scale, "grp").join(centres, "grp"), "mcd")
    drop_stored(spark, p_estimate, p_final, p_shrunk, p_robust)
    placed = base.join(place.select("lang", "source", "grp"), ["lang", "source"], "left")
    joined = placed.join(params, "grp", "left")
    gap = [F.col(f"c{i}") + (F.col(f"x{i}") - F.col(f"c{i}")) * F.col("seen") - F.col(f"m{i}") for i in range(p)]
    total = sum((F.col(f"p{i}_{j}") * gap[i] * gap[j] for i in range(p) for j in range(i, p)), F.lit(0.0))
    squared = F.when(F.col("filled"), F.round(total / F.col("scale"), 4))
    out = joined.select(F.col("id").alias(id_col), "grp", squared.alias("distance"), F.coalesce(squared <= cutoff, F.lit(False)).alias("keep"))
    result, _ = store(out, "quality")  # the result itself
    drop_stored(spark, p_base, p_params)
    return result


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
