"""URL filter: allow and block rules, and gradient-boosted trees on lexical features for all other URLs.

Rules are (host, path) prefixes. A rule fits its host and all subdomains where the URL's path
starts with the rule's path; the longest rule (host and path together) wins. Where none fits,
the trees decide.

Trees are trained from labelled URLs, which are those that a rule decides: a bounded sample,
SAMPLE distinct URLs of least MD5, of hosts that are not held out (CRC-32 of the host, modulo HELD_OUT, not 0).
Features: lengths of URL, host and path, depth, labels of the host,
digit ratio, character entropy, parameter counts, and smoothed block rates of the host's last
label, of the path's file suffix and of its first five characters. Rates count all labelled rows; those of a labelled URL
leave out the rows of its own fold of hosts (of FOLDS), so that no label is a feature of itself. Values without
labels have the rate of all labelled rows.

Scale: built-in functions but for the trees, which score batches of feature columns. Labelled URLs are made distinct and
counted by suffix; nothing else is shuffled and no text beyond URLs is read. The driver sees the sample
only. Suffix tables are joined by join_per_key.

Defined results. A null URL, or one without "://", has empty host and path, matches no
rule and is judged by the trees on zero lengths. Ports and user names are part of the host as
they stand. With no labelled URLs, or only one kind, the verdict is that kind's (allow if
there are none). Repeated rows get equal verdicts. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from termforge.llm.common import join_per_key, materialize

#: (verdict, host, path) of the standard rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
SAMPLE = 20_000
ROUNDS, DEPTH, RATE, BINS, LEAST_LEAF = 40, 3, 0.2, 32, 20
SMOOTHING = 2.0
FOLDS, HELD_OUT = 64, 5
LEXICAL = ["url_length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "entropy", "n_parameters", "n_marks"]
#: Suffixes and starts whose block rates are features.
RATES = ("domain", "file", "head")
FEATURES = [*LEXICAL, *(f"{k}_rate" for k in RATES)]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages with host, path, rule (host and path of the longest fitting rule, or null) and ruled (its verdict)."""
    out = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule = ruled = F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, ruled = F.when(fits, host + path).otherwise(rule), F.when(fits, verdict).otherwise(ruled)
    return out.withColumn("rule", rule).withColumn("ruled", ruled)


def fold(host: Column) -> Column:
    """Fold 0 to FOLDS - 1 of a host."""
    return (F.crc32(host.cast("binary")) % FOLDS).cast("int")


def held_out(host: Column) -> Column:
    """Whether a host's URLs are kept out of training."""
    return F.crc32(host.cast("binary")) % HELD_OUT == 0


def entropy(text: Column) -> Column:
    """Bits a character of a text, from its own character counts; 0 for an empty text."""
    n = F.greatest(F.length(text), F.lit(1))
    shares = F.transform(F.array_distinct(F.split(text, "")), lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.aggregate(F.filter(shares, lambda p: p > 0), F.lit(0.0), lambda total, p: total - p * F.log2(p))


def with_lexical(rows: DataFrame) -> DataFrame:
    """rows (with_rule) with the LEXICAL features and domain (the host's last label), file (the path's suffix after its last dot, or empty), head."""
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    counts = {
        "url_length": F.length(url),
        "host_length": F.length("host"),
        "path_length": F.length("path"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")),
        "host_labels": F.when(F.col("host") == "", 0).otherwise(F.regexp_count("host", F.lit(r"\.")) + 1),
        "digit_ratio": F.regexp_count(url, F.lit("[0-9]")) / F.greatest(F.length(url), F.lit(1)),
        "entropy": entropy(url),
        "n_parameters": F.when(query == "", 0).otherwise(F.regexp_count(query, F.lit("&")) + 1),
        "n_marks": F.regexp_count(url, F.lit("[-_%=~@]")),
    }
    keys = {"domain": F.substring_index("host", ".", -1), "file": F.regexp_extract("path", r"\.([^./]*)$", 1), "head": F.substring("path", 1, 5)}
    return rows.withColumns({k: v.cast("double") for k, v in counts.items()} | keys | {"fold": fold(F.col("host"))})


def suffix_rates(rows: DataFrame, key: str) -> DataFrame:
    """For each value of key: n and blocked of all labelled rows, and arrays of the same by fold."""
    blocked = (F.col("ruled") == "block").cast("long")
    by_fold = [F.sum(F.when(F.col("fold") == f, x).otherwise(0)) for x in (F.lit(1), blocked) for f in range(FOLDS)]
    own = rows.where("ruled is not null").groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(blocked).alias("blocked"), F.array(*by_fold[:FOLDS]).alias("ns"), F.array(*by_fold[FOLDS:]).alias("bs"))
    return materialize(own, f"url-{key}-rates")


@dataclass(frozen=True)
class Trees:
    """Boosted regression trees on log-odds. A tree is (feature, cut, left, right, value) arrays; feature -1 marks leaves."""

    base: float
    trees: tuple

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, cut, left, right, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[node]
                go_left = x[np.arange(len(x)), np.maximum(f, 0)] <= cut[node]
                node = np.where(f < 0, node, np.where(go_left, left[node], right[node]))
            out += value[node]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Gradient boosting of the logistic loss, with second-order leaf values and quantile-binned cuts."""
    share = y.mean() if len(y) else 0.0
    if share in (0.0, 1.0):
        return Trees(10.0 if share else -10.0, ())
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    base = float(np.log(share / (1 - share)))
    score, trees = np.full(len(y), base), []
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        nodes: list[list] = [[-1, 0.0, 0, 0, 0.0]]
        work = [(0, np.arange(len(y)), 0)]
        while work:
            at, rows, level = work.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            nodes[at][4] = rate * g / (h + 1.0)
            best = (1e-6, None)
            if level < depth and len(rows) >= 2 * LEAST_LEAF:
                for j, c in enumerate(cuts):
                    own = bins[rows, j]
                    n_l = np.cumsum(np.bincount(own, minlength=len(c) + 1))[:-1]
                    g_l = np.cumsum(np.bincount(own, grad[rows], len(c) + 1))[:-1]
                    h_l = np.cumsum(np.bincount(own, hess[rows], len(c) + 1))[:-1]
                    gain = g_l**2 / (h_l + 1.0) + (g - g_l) ** 2 / (h - h_l + 1.0) - g**2 / (h + 1.0)
                    gain = np.where((n_l >= LEAST_LEAF) & (len(rows) - n_l >= LEAST_LEAF), gain, 0.0)
                    k = int(gain.argmax()) if len(gain) else -1
                    if k >= 0 and gain[k] > best[0]:
                        best = (gain[k], (j, k))
            if best[1] is not None:
                j, k = best[1]
                goes = bins[rows, j] <= k
                nodes[at][:4] = [j, float(cuts[j][k]), len(nodes), len(nodes) + 1]
                nodes += [[-1, 0.0, 0, 0, 0.0], [-1, 0.0, 0, 0, 0.0]]
                work += [(nodes[at][2], rows[goes], level + 1), (nodes[at][3], rows[~goes], level + 1)]
        columns = list(zip(*nodes))
        tree = tuple(np.array(c, t) for c, t in zip(columns, (np.int64, float, np.int64, np.int64, float)))
        trees.append(tree)
        score = score + Trees(0.0, (tree,)).log_odds(x)
    return Trees(base, tuple(trees))


def with_rates(rows: DataFrame) -> DataFrame:
    """rows (with_lexical) with the rates; a labelled row's leave out its own fold."""
    total = rows.where("ruled is not null").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("ruled") == "block").cast("long")).alias("b")).first()
    prior = (total["b"] or 0) / max(1, total["n"])
    for key in RATES:
        rows = join_per_key(rows, suffix_rates(rows, key), [key])
        out = F.col("ruled").isNotNull()  # of the labelled row, its fold is left out
        n = F.col("n") - F.when(out, F.get("ns", F.col("fold"))).otherwise(0)
        b = F.col("blocked") - F.when(out, F.get("bs", F.col("fold"))).otherwise(0)
        rate = (b + SMOOTHING * prior) / (n + SMOOTHING)
        rows = rows.withColumn(f"{key}_rate", F.coalesce(rate, F.lit(prior))).drop("n", "blocked", "ns", "bs")
    return rows


def train(rows: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from the labelled rows (with_rates) of least MD5 of their URL, of hosts that are not held out."""
    labelled = rows.where(F.col("ruled").isNotNull() & F.col("url").isNotNull() & ~held_out(F.col("host"))).select("url", "ruled", *FEATURES).distinct()
    own = labelled.orderBy(F.md5("url"), "url").limit(sample).toPandas()
    return boost(own[FEATURES].to_numpy(float), (own["ruled"] == "block").to_numpy(float))


def judge_pages(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict, score (of the trees: probability of block) of every page."""
    rows = with_rates(with_lexical(with_rule(pages.select("page_id", "url"), rules)))
    trees = train(rows, sample)

    @F.pandas_udf("double")
    def block(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            x = np.column_stack([c.to_numpy(float) for c in columns])
            yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(trees.log_odds(x), -30, 30))))

    scored = rows.withColumn("score", block(*FEATURES))
    own = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "score")
