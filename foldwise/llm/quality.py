"""Operator 3: quality classifier with hierarchical empirical Bayes.

A document's own evidence is the log-likelihood ratio of its binned text
features (shape, symbols, case, repetition), counted in labelled rows of either
class.  Its site has a posterior rate of good labels: hosts are shrunk towards
the global rate, paths towards their host, by prior strengths that the method of
moments takes from the spread of the rates (few labels: close to the prior).
The score is the logistic of evidence plus the path's posterior log-odds.
Everything is grouped aggregation with DataFrame functions; rates and bins are
joined by adaptive execution's measured sizes.

Defined results: a null text counts as empty; a null host or path is a value of
its own; sites without labels get their parent's rate; without any labelled row
the score is 0.5 everywhere; rows with a null label teach nothing; repeated rows
are scored each; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import saved

#: Pseudo-counts of a bin; bounds of the prior strengths; share of the summed
#: evidence that counts (the features overlap).
SMOOTH, STRENGTH, TRUST = 1.0, (2.0, 1000.0), 0.5
#: Documents with a score of this much or more are kept.
KEEP = 0.5


def features(text: str | Column = "text") -> dict[str, Column]:
    """Integer bins of a text's features (quotients of small integers, exact in doubles)."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    n = F.char_length(t)
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x != "")

    def ratio(part: Column, whole: Column, bins: int) -> Column:
        """floor(part * bins / whole); -1 where the whole is 0."""
        return F.when(whole > 0, F.floor((part * bins).cast("double") / whole)).otherwise(-1).cast("int")

    return {
        "length": F.char_length(F.bin(F.size(words))).cast("int"),
        "symbols": F.least(ratio(F.regexp_count(t, F.lit(r"[%*#$&|!<>{}=@~^+\\/]")), n, 50), F.lit(20)),
        "capitals": ratio(F.regexp_count(t, F.lit("[A-Z]")), n, 10),
        "digits": F.least(ratio(F.regexp_count(t, F.lit("[0-9]")), n, 50), F.lit(20)),
        "distinct": ratio(F.size(F.array_distinct(words)), F.size(words), 10),
        "lines": ratio(F.size(F.array_distinct(lines)), F.size(lines), 5),
        "words": F.least(ratio(n, F.size(words), 1), F.lit(20)),
    }


def evidence_table(rows: DataFrame, names: list[str]) -> DataFrame:
    """(feature, bin, llr): log P(bin | good) - log P(bin | bad), smoothed."""
    long = rows.select("y", F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("bin")) for f in names))).alias("f"))
    counts = long.groupBy("f.feature", "f.bin").agg(F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("bad"))
    total = counts.groupBy("feature").agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"), F.count("*").alias("bins"))
    return counts.join(total, "feature").select("feature", "bin", (
        F.log((F.col("good") + SMOOTH) / (F.col("all_good") + SMOOTH * F.col("bins")))
        - F.log((F.col("bad") + SMOOTH) / (F.col("all_bad") + SMOOTH * F.col("bins")))).alias("llr"))


def strength(groups: DataFrame) -> DataFrame:
    """One row ``s``: prior strength for groups with labels ``n``, good ones ``k``
    and parent rate ``prior`` (beta-binomial method of moments)."""
    p, n, mu = F.col("k") / F.col("n"), F.col("n"), F.col("prior")
    spread = F.sum(n * (p - mu) * (p - mu)) / F.sum(n)
    noise = F.sum(mu * (1 - mu)) / F.sum(n)
    level = F.sum(n * mu * (1 - mu)) / F.sum(n)
    between = spread - noise
    s = F.when(between > 0, F.least(F.greatest(level / between - 1, F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))).otherwise(F.lit(STRENGTH[1]))
    return groups.agg(F.coalesce(s, F.lit(STRENGTH[1])).alias("s"))


def site_rates(rows: DataFrame) -> DataFrame:
    """(host, path, host_rate, path_rate) of every site with labelled rows (host, path, y)."""
    one = F.broadcast(rows.agg(((F.sum("y") + SMOOTH) / (F.count("*") + 2 * SMOOTH)).alias("prior")))
    paths = rows.groupBy("host", "path").agg(F.sum("y").alias("k"), F.count("*").alias("n"))
    hosts = paths.groupBy("host").agg(F.sum("k").alias("k"), F.sum("n").alias("n")).crossJoin(one)
    hosts = hosts.crossJoin(F.broadcast(strength(hosts))).select(
        F.col("host").alias("_host"), ((F.col("k") + F.col("s") * F.col("prior")) / (F.col("n") + F.col("s"))).alias("prior"))
    under = paths.join(hosts, F.col("host").eqNullSafe(F.col("_host")))
    return under.crossJoin(F.broadcast(strength(under))).select(
        "host", "path", F.col("prior").alias("host_rate"),
        ((F.col("k") + F.col("s") * F.col("prior")) / (F.col("n") + F.col("s"))).alias("path_rate"))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text: str = "text",
             label: str = "quality", learn: Column | None = None, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``evidence``, the posterior rates of its host and
    path, ``score`` (probability of a good label) and ``keep``.  ``labels`` (id, 0/1)
    teaches where ``learn`` holds on it."""
    bins = features(text)
    rows = saved(docs.select(F.col(id_col).alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"),
                             *(c.alias(f) for f, c in bins.items()), *(c.alias(n) for n, c in (extra or {}).items())))
    known = labels.where(F.col(label).isNotNull() & (F.lit(True) if learn is None else learn))
    known = known.select(F.col(id_col).alias("_id"), (F.col(label) > 0).cast("int").alias("y"))
    taught = saved(rows.join(known, F.col("doc_id") == F.col("_id")).select("host", "path", "y", *bins))
    table = evidence_table(taught, list(bins))
    out = rows
    for f in bins:                                     # each table has a bounded number of bins
        one = F.broadcast(table.where(F.col("feature") == f).select(F.col("bin").alias("_bin"), F.col("llr").alias(f"_{f}")))
        out = out.join(one, F.col(f) == F.col("_bin"), "left").drop("_bin")
    rates = site_rates(taught)
    per_host = rates.select(F.col("host").alias("_h"), F.col("host_rate").alias("_hr")).distinct()
    per_path = rates.select(F.col("host").alias("_ph"), F.col("path").alias("_pp"), "path_rate")
    all_rows = taught.agg(F.coalesce((F.sum("y") + SMOOTH) / (F.count("*") + 2 * SMOOTH), F.lit(0.5)).alias("_prior"))
    out = (out.join(per_host, F.col("host").eqNullSafe(F.col("_h")), "left")
           .join(per_path, F.col("host").eqNullSafe(F.col("_ph")) & F.col("path").eqNullSafe(F.col("_pp")), "left")
           .crossJoin(F.broadcast(all_rows)))
    host_rate = F.coalesce("_hr", "_prior")
    path_rate = F.coalesce("path_rate", host_rate)
    evidence = sum((F.coalesce(F.col(f"_{f}"), F.lit(0.0)) for f in bins), F.lit(0.0)) * TRUST
    score = 1 / (1 + F.exp(-(evidence + F.log(path_rate / (1 - path_rate)))))
    return out.select("doc_id", "host", "path", evidence.alias("evidence"), host_rate.alias("host_rate"), path_rate.alias("path_rate"),
                      score.alias("score"), (score >= KEEP).alias("keep"), *(extra or {}))
