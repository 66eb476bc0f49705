"""Quality rules: base counts of a text, and robust multivariate outliers per language and source.

Each text gives five statistics, transformed so that ordinary prose is roughly elliptical:

    log(1 + words), log(characters per word), and the square roots of the share of symbol
    characters, of repeated lines and of words in repeated windows.

For each (language, source) the minimum-covariance-determinant estimate of location and
scatter is fitted, and documents whose squared Mahalanobis distance exceeds a chi-square
quantile are rejected.

Scale. The statistics are held as whole thousandths. Before any shuffle, the documents of a
group are folded into cells of a fixed grid, each with its count, sums and cross products, so
a group with a third of all rows moves no more than its occupied cells. The concentration
steps select whole cells; since the cells' sums are exact integers, every run gives the same
estimate in whatever order rows arrive.

Defined results. A null text counts as empty (no words, base_failed). Null languages and
sources form groups of their own. Only documents that pass the base rules are fitted. A
group of fewer than ``min_group`` such documents is judged by the estimate from all of its
language, and where these are fewer too, by that from all documents; so every document that
passes the base rules gets a distance. Repeated rows count as often as they occur and share one verdict. An empty
table gives an empty result. Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from termforge.functions.special import chi2_ppf, gamma_p
from termforge.llm.common import join_per_key, materialize

SYMBOLS = "#*$%&|<>"
WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: Cell widths of the grid, in thousandths of a statistic.
CELL = (250, 60, 50, 100, 100)
#: Spread (standard deviation) added to each statistic: most texts have no symbols or repeated
#: lines at all, and without it any would be an outlier.
FLOOR = (0.5, 0.08, 0.05, 0.1, 0.1)
SUPPORT = 0.75
CUTOFF = 0.99999
MIN_GROUP = 25
_P = len(CELL)
_PAIRS = [(i, j) for i in range(_P) for j in range(i, _P)]
_SLICE = 1 << 20


def _codes(values) -> np.ndarray:
    return pd.factorize(values)[0]


def count_texts(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The five base counts of each text, for a list of texts of bounded total length."""
    n = len(texts)
    out = {k: np.zeros(n, np.int64) for k in COUNTS}
    words: list[bytes] = []
    for i, text in enumerate(texts):
        if not text:
            continue
        own = text.encode().split()
        words += own
        out["n_words"][i] = len(own)
        out["word_chars"][i] = len(text) - sum(map(text.count, " \t\n\v\f\r"))
        out["n_symbols"][i] = sum(map(text.count, SYMBOLS))
        seen: set[str] = set()
        for line in text.split("\n"):
            if line.strip(" \t\v\f\r"):
                out["n_dup_lines"][i] += line in seen
                seen.add(line)
    if words:
        ids = _codes(np.array(words, dtype=object)).astype(np.int64)
        doc = np.repeat(np.arange(n), out["n_words"])
        span = len(ids) + 1
        # Windows of 2, then 4, then 5 words, each numbered exactly; windows across two texts fall away.
        two = _codes(ids[:-1] * span + ids[1:]).astype(np.int64)
        four = _codes(two[:-2] * span + two[2:]).astype(np.int64) if len(two) > 2 else two[:0]
        five = _codes(four[:-1] * span + ids[4:]).astype(np.int64) if len(four) > 1 else four[:0]
        if len(five):
            start, end = doc[: len(five)], doc[4:]
            within = np.flatnonzero(start == end)
            keys = _codes(five[within] * n + start[within])
            twice = within[np.bincount(keys)[keys] > 1]
            covered = np.zeros(len(ids) + 1, np.int64)
            np.add.at(covered, twice, 1)
            np.add.at(covered, twice + WINDOW, -1)
            out["n_repeat_words"] += np.bincount(doc[np.cumsum(covered[:-1]) > 0], minlength=n)
    return out


def _slices(texts: pd.Series) -> Iterator[list]:
    """Runs of whole texts of about a million characters, so that memory follows the longest text only."""
    run, size = [], 0
    for text in texts:
        run.append(text if isinstance(text, str) else None)
        size += len(run[-1] or "")
        if size >= _SLICE:
            yield run
            run, size = [], 0
    if run:
        yield run


def counts_of(text: Column) -> Column:
    """The five base counts of a text column, as a struct."""

    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def counts(texts: pd.Series) -> pd.DataFrame:
        parts = [pd.DataFrame(count_texts(run)) for run in _slices(texts)]
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({c: [] for c in COUNTS}, dtype="int64")

    return counts(text)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def statistics(c) -> list[Column]:
    """The transformed statistics of counts c(name), in thousandths."""
    words, chars = F.greatest(c("n_words"), F.lit(1)), F.greatest(c("word_chars"), F.lit(1))
    real = [
        F.log1p(c("n_words")),
        F.log(chars / words),
        F.sqrt(c("n_symbols") / chars),
        F.sqrt(c("n_dup_lines") / words),
        F.sqrt(c("n_repeat_words") / words),
    ]
    return [F.round(x * 1000).cast("long") for x in real]


def _sums(cells: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = cells["n"].to_numpy(float)
    first = cells[[f"s{i}" for i in range(_P)]].to_numpy(float) / 1e3
    second = np.zeros((len(n), _P, _P))
    for i, j in _PAIRS:
        second[:, i, j] = second[:, j, i] = cells[f"q{i}{j}"].to_numpy(float) / 1e6
    return n, first, second


def _moments(n, first, second, pick) -> tuple[np.ndarray, np.ndarray]:
    total = n[pick].sum()
    centre = first[pick].sum(0) / total
    return centre, second[pick].sum(0) / total - np.outer(centre, centre)


def _weighted_median(x: np.ndarray, n: np.ndarray) -> float:
    order = np.argsort(x, kind="stable")
    return float(x[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2.0)])


def mcd(cells: pd.DataFrame, support: float = SUPPORT) -> tuple[np.ndarray, np.ndarray]:
    """Reweighted minimum-covariance-determinant location and scatter of a group's cells.

    cells: n, s0.. (sums), q00.. (sums of products) in thousandths. Concentration steps run from
    three fixed starts, and that with the least determinant stands.
    """
    n, first, second = _sums(cells)
    mean = first / n[:, None]
    floor = np.diag(np.square(FLOOR))
    need = support * n.sum()

    def distance(centre, scatter):
        d = mean - centre
        return np.einsum("ij,jk,ik->i", d, np.linalg.inv(scatter + floor), d)

    def nearest(dist):
        order = np.argsort(dist, kind="stable")
        return order[: np.searchsorted(np.cumsum(n[order]), need) + 1]

    middle = np.array([_weighted_median(mean[:, i], n) for i in range(_P)])
    spread = np.array([1.4826 * _weighted_median(np.abs(mean[:, i] - middle[i]), n) for i in range(_P)])
    centred = (mean - middle) / np.maximum(spread, FLOOR)
    radius = np.maximum(np.sqrt((centred**2).sum(1)), 1e-9)
    signs = centred / radius[:, None]
    turned = (signs * n[:, None]).T @ signs / n.sum() * np.outer(np.maximum(spread, FLOOR), np.maximum(spread, FLOOR)) * _P
    starts = [np.diag(spread**2), turned, _moments(n, first, second, np.arange(len(n)))[1]]
    best = None
    for scatter in starts:
        pick = nearest(distance(middle, scatter))
        for _ in range(100):
            centre, scatter = _moments(n, first, second, pick)
            again = nearest(distance(centre, scatter))
            if np.array_equal(np.sort(again), np.sort(pick)):
                break
            pick = again
        det = np.linalg.slogdet(scatter + floor)[1]
        if best is None or det < best[0] - 1e-12:
            best = (det, centre, scatter)
    _, centre, scatter = best

    def consistent(share):
        return share / gamma_p(_P / 2.0 + 1.0, chi2_ppf(share, _P) / 2.0)

    scatter = scatter * consistent(support)
    pick = np.flatnonzero(distance(centre, scatter) <= chi2_ppf(0.975, _P))
    if n[pick].sum() > _P:
        centre, scatter = _moments(n, first, second, pick)
        scatter = scatter * consistent(0.975)
    return centre, scatter + floor


_ESTIMATE = "centre array<double>, precision array<double>"


def _fit(cells: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    cells = cells.sort_values([f"c{i}" for i in range(_P)], kind="stable").reset_index(drop=True)
    centre, scatter = mcd(cells)
    inverse = np.linalg.inv(scatter)
    return pd.DataFrame({**{k: [cells.iloc[0][k]] for k in keys}, "centre": [centre.tolist()], "precision": [inverse.ravel().tolist()]})


def _estimates(cells: DataFrame, keys: list[str], least: int) -> DataFrame:
    """keys -> centre, precision of the groups of at least so many documents."""
    names = [*keys, "centre", "precision"]
    return cells.groupBy(*keys).applyInPandas(
        lambda g: _fit(g, keys) if g["n"].sum() >= least else pd.DataFrame(columns=names, dtype=object),
        ", ".join([f"{k} string" for k in keys] + [_ESTIMATE]),
    )


def fit_outliers(counts: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """(lang, source) -> centre, precision (inverse scatter), from counts with lang and source.

    Smaller groups than min_group get the estimate of their language, or else of all documents,
    from the same cells summed further.
    """
    stats = counts.where(~base_failed(F.col("n_words"), F.col("n_repeat_words"))).select(
        "lang", "source", *[v.alias(f"v{i}") for i, v in enumerate(statistics(F.col))]
    )
    axes = [f"c{i}" for i in range(_P)]
    sums = ["n", *[f"s{i}" for i in range(_P)], *[f"q{i}{j}" for i, j in _PAIRS]]
    cells = stats.groupBy("lang", "source", *[F.floor(F.col(f"v{i}") / w).cast("int").alias(f"c{i}") for i, w in enumerate(CELL)]).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(f"v{i}").alias(f"s{i}") for i in range(_P)],
        *[F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"q{i}{j}") for i, j in _PAIRS],
    )
    cells = materialize(cells, "quality-cells")
    own = _estimates(cells, ["lang", "source"], min_group)
    small = materialize(cells.groupBy("lang", "source").agg(F.sum("n").alias("n")).where(F.col("n") < min_group).select("lang", "source"), "quality-small")
    if small.isEmpty():
        return own
    by_lang = cells.groupBy("lang", *axes).agg(*[F.sum(x).alias(x) for x in sums])
    by_lang = materialize(by_lang, "quality-lang-cells")
    pooled = materialize(_estimates(by_lang, ["lang"], min_group).withColumnsRenamed({"centre": "near", "precision": "near_precision"}), "quality-lang-params")
    whole = by_lang.groupBy(*axes).agg(*[F.sum(x).alias(x) for x in sums]).withColumn("lang", F.lit("all"))
    # One row, attached by its key.
    whole = materialize(_estimates(whole, ["lang"], 0), "quality-whole-params").withColumnsRenamed({"lang": "of", "centre": "far", "precision": "far_precision"})
    borrowed = join_per_key(small.withColumn("of", F.lit("all")), pooled, ["lang"]).join(F.broadcast(whole), "of", "left")
    return own.union(
        borrowed.select("lang", "source", F.coalesce("near", "far").alias("centre"), F.coalesce("near_precision", "far_precision").alias("precision"))
    )


def _distance(c) -> Column:
    d = [v / 1000.0 - F.col("__centre")[i] for i, v in enumerate(statistics(c))]
    total = F.lit(0.0)
    for i in range(_P):
        for j in range(_P):
            total = total + d[i] * d[j] * F.col("__precision")[i * _P + j]
    return total


def robust_verdict(rows: DataFrame, params: DataFrame, c, cutoff: float = CUTOFF) -> DataFrame:
    """rows (with lang and source) with a struct `verdict`: failed, kept, distance (squared; null where the base rules fail)."""
    failed = base_failed(c("n_words"), c("n_repeat_words"))
    out = join_per_key(rows, params.withColumnsRenamed({"centre": "__centre", "precision": "__precision"}), ["lang", "source"])
    out = out.withColumn("distance", F.when(~failed, _distance(c)))
    kept = ~failed & (F.col("distance") <= chi2_ppf(cutoff, _P))
    return out.withColumn("verdict", F.struct(failed.alias("failed"), kept.alias("kept"), "distance")).drop("__centre", "__precision", "distance")


def count_documents(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the five counts."""
    picked = docs.select("doc_id", "lang", "source", counts_of(F.col("text")).alias("c"))
    return picked.select("doc_id", "lang", "source", "c.*")


def judge_documents(docs: DataFrame, cutoff: float = CUTOFF, min_group: int = MIN_GROUP) -> DataFrame:
    """doc_id, the five counts, base_failed, kept, distance of every document."""
    counts = materialize(count_documents(docs), "quality-counts")
    params = materialize(fit_outliers(counts, min_group), "quality-params")
    out = robust_verdict(counts, params, F.col, cutoff)
    return out.select("doc_id", *COUNTS, F.col("verdict.failed").alias("base_failed"), "verdict.kept", "verdict.distance")


def filter_documents(docs: DataFrame, cutoff: float = CUTOFF, min_group: int = MIN_GROUP) -> DataFrame:
    """The documents that judge_documents keeps, with all their columns.

    Each text is counted once: rows are written with their counts beside them, so the stage needs
    no unique id and moves no text between executors.
    """
    nested = docs.select(F.struct(*docs.columns).alias("row"), counts_of(F.col("text")).alias("counts"))
    nested = materialize(nested, "quality-counted")
    counted = nested.select(F.col("row.lang").alias("lang"), F.col("row.source").alias("source"), "counts.*")
    params = materialize(fit_outliers(counted, min_group), "quality-params")
    rows = nested.select("row", "counts", F.col("row.lang").alias("lang"), F.col("row.source").alias("source"))
    return robust_verdict(rows, params, lambda name: F.col(f"counts.{name}"), cutoff).where("verdict.kept").select("row.*")
