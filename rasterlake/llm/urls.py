"""URL filters: rules by host suffix and path prefix, and gradient-boosted trees for the rest.

The trees see lexical features only: lengths, depth, digit ratio, entropy, parameter counts,
hyphens, and how often labelled URLs of the same suffix (the last label of the host) were bad,
counted over all of them and joined.  No feature names a domain, so a verdict on a host rests on
how its URLs look.  Trees are grown on the driver from a bounded sample of distinct labelled URLs and become
one column expression, so that scoring needs no Python.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: (verdict, host, path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: A host that has one of these words between its dots and hyphens counts as labelled bad.
BAD_WORDS = ("ads", "adult", "bets", "betting", "casino", "clickbait", "loans", "malware", "phish", "pills", "porn", "poker", "spam", "tracker", "viagra", "warez", "xxx")
FEATURES = ("url_length", "host_length", "path_length", "query_length", "depth", "labels", "digit_ratio", "host_digits", "hyphens", "entropy", "parameters", "suffix_rate")
SAMPLE = 40_000
SMOOTH = 20.0


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; of null or without :// empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; of null or without :// empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as struct (verdict, rule); null if none does.  Of equally long ones the first counts."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, own, start in sorted(reversed(rules), key=lambda r: len(r[1]) + len(r[2])):  # the last that fits wins
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(own + start).alias("rule"))).otherwise(out)
    return out


def lexical(url: Column) -> dict[str, Column]:
    """Features that need no statistics."""
    url = F.coalesce(url, F.lit(""))
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    n = F.char_length(host)
    digits = lambda c: F.char_length(F.regexp_replace(c, "[^0-9]", ""))
    chars = F.split(host, "")
    entropy = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - F.when(c == "", 0.0).otherwise((n - F.char_length(F.replace(host, c, F.lit("")))) / n * F.log2((n - F.char_length(F.replace(host, c, F.lit("")))) / n)))
    count = lambda c, x: (F.char_length(c) - F.char_length(F.replace(c, F.lit(x), F.lit("")))) / len(x)
    out = {
        "url_length": F.char_length(url),
        "host_length": n,
        "path_length": F.char_length(path),
        "query_length": F.char_length(query),
        "depth": count(path, "/"),
        "labels": F.when(n > 0, count(host, ".") + 1).otherwise(0),
        "digit_ratio": digits(url) / F.greatest(F.lit(1), F.char_length(url)),
        "host_digits": digits(host),
        "hyphens": count(host, "-"),
        "entropy": F.when(n > 0, entropy).otherwise(0.0),
        "parameters": F.when(F.char_length(query) > 0, count(query, "&") + 1).otherwise(0),
    }
    return {k: v.cast("double") for k, v in out.items()}


@dataclass
class Trees:
    """Logistic gradient boosting over binned features: each tree is (feature, cut, left, right) or a number."""

    rounds: int = 40
    depth: int = 3
    rate: float = 0.3
    bins: int = 64
    least: float = 0.5  # hessian of a leaf
    base: float = 0.0
    trees: list = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        bad, total = (weight * y).sum(), weight.sum()
        p = (bad + 0.5) / (total + 1)
        self.base = float(np.log(p / (1 - p)))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) if len(np.unique(c)) > self.bins else (np.unique(c)[1:] + np.unique(c)[:-1]) / 2 for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="right") for c, v in zip(cuts, x.T)], 1) if len(y) else np.zeros((0, x.shape[1]), int)
        f = np.full(len(y), self.base)
        for _ in range(self.rounds if 0 < bad < total else 0):
            q = 1 / (1 + np.exp(-f))
            g, h = weight * (y - q), weight * q * (1 - q)

            def grow(rows: np.ndarray, depth: int):
                leaf = self.rate * g[rows].sum() / (h[rows].sum() + 1)
                best = (1e-6, None, None)
                for j, c in enumerate(cuts if depth else []):
                    gs, hs = (np.cumsum(np.bincount(binned[rows, j], v[rows], len(c) + 1)) for v in (g, h))
                    gl, hl, gr, hr = gs[:-1], hs[:-1], gs[-1] - gs[:-1], hs[-1] - hs[:-1]
                    gain = np.where((hl >= self.least) & (hr >= self.least), gl**2 / (hl + 1) + gr**2 / (hr + 1) - gs[-1] ** 2 / (hs[-1] + 1), 0) if len(c) else np.zeros(1)
                    if gain.max() > best[0]:
                        best = (gain.max(), j, int(gain.argmax()))
                if best[1] is None:
                    f[rows] += leaf
                    return float(leaf)
                _, j, k = best
                left = binned[rows, j] <= k
                return j, float(cuts[j][k]), grow(rows[left], depth - 1), grow(rows[~left], depth - 1)

            self.trees.append(grow(np.arange(len(y)), self.depth))
        return self

    def column(self, features: Sequence[Column]) -> Column:
        """The probability, as an expression."""

        def of(node):
            if isinstance(node, float):
                return F.lit(node)
            j, cut, left, right = node
            return F.when(features[j] < cut, of(left)).otherwise(of(right))

        total = reduce(lambda a, b: a + b, map(of, self.trees), F.lit(self.base))
        return 1 / (1 + F.exp(-total))


def labelled(urls: DataFrame, url_col: str = "url", words: Sequence[str] = BAD_WORDS) -> DataFrame:
    """url and label: 1 where the host has a word of the list between its dots and hyphens."""
    host = host_of(F.col(url_col))
    return urls.select(F.col(url_col).alias("url"), F.arrays_overlap(F.split(host, "[.-]"), F.array(*[F.lit(w) for w in words])).cast("int").alias("label")).filter("url is not null")


def fit(labels: DataFrame, sample: int = SAMPLE, seed: int = 4, **options) -> tuple[Trees, DataFrame, float]:
    """Learn from (url, label) rows: trees, table of rows and bad rows by suffix, base rate.

    The suffix is the last label of a host; all rows count, also for suffixes seen once.  Trees are grown from
    `sample` distinct URLs at most, by a hash of the URL, half of them bad where there are enough;
    one weighs as many rows as it stands for.  In learning, a URL's own labels do not count
    towards the rate of its suffix.
    """
    host = host_of(F.col("url"))
    rows = labels.filter("url is not null and label is not null").groupBy("url").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("bad"))
    rows = materialize(rows.select("*", F.substring_index(host, ".", -1).alias("suffix")), "urls")
    by = materialize(rows.groupBy("suffix").agg(F.sum("n").alias("of_suffix"), F.sum("bad").alias("bad_of_suffix")), "suffixes")
    totals = {r.is_bad: r for r in rows.groupBy((F.col("bad") > 0).alias("is_bad")).agg(F.count("*").alias("urls"), F.sum("n").alias("n"), F.sum("bad").alias("bad")).collect()}
    mean = float((sum(r.bad for r in totals.values()) + 1) / (sum(r.n for r in totals.values()) + 2))
    most = {k: totals[k].urls if k in totals else 0 for k in (True, False)}
    most[True] = min(most[True], max(sample // 2, sample - most[False]))
    most[False] = min(most[False], sample - most[True])
    parts = [rows.filter((F.col("bad") > 0) == F.lit(k)).orderBy(F.xxhash64("url", F.lit(seed)), "url").limit(n) for k, n in most.items()]
    some = parts[0].unionByName(parts[1]).join(by, "suffix").orderBy("url")
    some = some.select("n", "bad", "of_suffix", "bad_of_suffix", *[c.alias(k) for k, c in lexical(F.col("url")).items()]).toPandas()
    n, bad = some["n"].to_numpy(float), some["bad"].to_numpy(float)
    x = [some[k].to_numpy(float) for k in FEATURES[:-1]]
    x += [(some["bad_of_suffix"].to_numpy(float) - bad + SMOOTH * mean) / (some["of_suffix"].to_numpy(float) - n + SMOOTH)]
    weight = n.copy()
    for k, own in ((True, bad > 0), (False, bad == 0)):
        if own.any():
            weight[own] *= totals[k].n / n[own].sum()
    return Trees(**options).fit(np.stack(x, 1), bad / np.maximum(n, 1), weight), by, mean


def judge(urls: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """Verdicts on all rows of urls: page_id, host, path, rule, verdict, score.

    A rule's verdict stands; other URLs are blocked where the trees' score is `threshold` or
    more.  A null URL, or one without ://, has an empty host and path and is scored as any
    other.  Without labels of both kinds the score is the base rate.  Rows that repeat are
    judged each, and a very long URL whole.  Of an empty table the result is empty.  Other columns are not looked at.
    """
    trees, by, mean = fit(labels)
    rows = urls.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rate = (F.coalesce("bad_of_suffix", F.lit(0)) + SMOOTH * mean) / (F.coalesce("of_suffix", F.lit(0)) + SMOOTH)
    rows = rows.withColumn("suffix", F.substring_index("host", ".", -1)).join(by, "suffix", "left").withColumn("suffix_rate", rate).drop("suffix", "of_suffix", "bad_of_suffix")
    rows = rows.select("*", *[c.alias(k) for k, c in lexical(F.col("url")).items()])
    rows = rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("score", trees.column([F.col(k) for k in FEATURES]))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "score")
