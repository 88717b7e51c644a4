"""Quality rules by host, in DataFrame functions only.

Every document is measured by rules; failures are counted by host (the column
``source``); each host's failure rate is shrunk by a beta prior fitted to all
hosts (method of moments); the verdict on the host is joined back.  On a host
whose shrunk rate is high every rule counts, elsewhere only the base rules do.

Defined cases: null text has no words and fails the base rules; null and empty
hosts are one host; repeated rows are judged, and counted by host, one by one;
an empty table gives an empty result.  Input columns other than doc_id, text
and source are ignored by `host_rules` and kept by `keep_good`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import SPACE, cut, let, small_enough


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    window: int = 5
    repeat_percent: int = 20
    symbol_percent: int = 10  #: symbols for each hundred words
    dup_line_percent: int = 30
    min_mean_word: int = 2  #: code points
    max_mean_word: int = 20
    host_rate: float = 0.5  #: shrunk failure rate from which a host is bad
    max_prior: float = 1e4  #: bound of alpha + beta, for hosts that hardly differ
    broadcast_hosts: int = 100_000  #: up to so many hosts the verdicts are broadcast
    salts: int = 32  #: beyond it, so many salts spread each host


#: The symbols that the contract counts.
SYMBOLS = "#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")


def _repeated(hashes: Column, window: int) -> Column:
    """Positions covered by windows whose hash occurs twice or more."""
    near = lambda s, x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = let(ordered, lambda s: F.filter(s, lambda x, k: F.coalesce(near(s, x, k), F.lit(False))))
    at = F.sort_array(F.transform(twice, lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("c"), F.lit(-window).alias("last"))
    step = lambda a, p: F.struct((a["c"] + F.least(F.lit(window), p - a["last"])).alias("c"), p.alias("last"))
    return F.aggregate(at, start, step, lambda a: a["c"])


def _word_measures(words: Column, window: int) -> Column:
    hashed = lambda hw: F.transform(
        F.slice(hw, F.lit(1), F.greatest(F.size(hw) - (window - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *(F.get(hw, i + k) for k in range(1, window))),
    )
    grams = let(F.transform(words, lambda w: F.xxhash64(w)), hashed)
    repeats = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(_repeated(g, window)))
    return F.struct(F.size(words).alias("n_words"), repeats.alias("n_repeat_words"))


def measures(text: Column, window: int = 5) -> Column:
    """A struct of MEASURES (long) of a text; a null text counts as empty."""
    whole = F.coalesce(text, F.lit(""))

    def of(t: Column) -> Column:
        by_word = let(F.array_remove(F.split(t, SPACE), ""), lambda w: _word_measures(w, window))
        lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)
        by_line = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
        return let(
            F.struct(by_word.alias("w"), by_line.alias("l")),
            lambda s: F.struct(
                s["w"]["n_words"].cast("long").alias("n_words"),
                F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
                (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                (s["l"]["n"] - s["l"]["d"]).cast("long").alias("n_dup_lines"),
                s["l"]["n"].cast("long").alias("n_lines"),
                s["w"]["n_repeat_words"].cast("long").alias("n_repeat_words"),
            ),
        )

    return let(whole, of)


def base_failed(r: Rules, m=F.col) -> Column:
    return (m("n_words") < r.min_words) | (100 * m("n_repeat_words") > r.repeat_percent * m("n_words"))


def any_failed(r: Rules, m=F.col) -> Column:
    return (
        base_failed(r, m)
        | (100 * m("n_symbols") > r.symbol_percent * m("n_words"))
        | (100 * m("n_dup_lines") > r.dup_line_percent * m("n_lines"))
        | (m("word_chars") < r.min_mean_word * m("n_words"))
        | (m("word_chars") > r.max_mean_word * m("n_words"))
    )


def host_verdicts(measured: DataFrame, r: Rules) -> DataFrame:
    """(host, host_docs, host_failed, host_bad) of rows with host and failed.  The only values that reach
    the driver are the three sums that the prior is fitted from."""
    hosts = cut(measured.groupBy("host").agg(F.count("*").alias("host_docs"), F.sum(F.col("failed").cast("long")).alias("host_failed")))
    rate = F.col("host_failed") / F.col("host_docs")
    mean, var = hosts.agg(F.avg(rate), F.var_pop(rate)).first()
    alpha, beta = beta_prior(mean, var, r.max_prior)
    shrunk = (F.col("host_failed") + F.lit(alpha)) / (F.col("host_docs") + F.lit(alpha + beta))
    return hosts.withColumn("host_bad", shrunk > r.host_rate)


def beta_prior(mean: float | None, var: float | None, most: float) -> tuple[float, float]:
    """alpha and beta of the beta distribution with this mean and variance, alpha + beta within [1, most]."""
    if mean is None:
        return 0.5, 0.5
    n = most if not var else min(most, max(1.0, mean * (1 - mean) / var - 1))
    return mean * n, (1 - mean) * n


def _join_hosts(docs: DataFrame, hosts: DataFrame, r: Rules, salt: Column) -> DataFrame:
    """docs with their host's verdict.  Many hosts are joined on (host, salt), as one may hold a third of all rows."""
    if small_enough(hosts, r.broadcast_hosts):
        return docs.join(F.broadcast(hosts), "host")
    spread = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(r.salts - 1))))
    return docs.withColumn("salt", salt).join(spread, ["host", "salt"]).drop("salt")


def host_rules(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row for each row of docs (doc_id, text, source): its measures, base_failed, kept and its host's counts."""
    m = docs.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("host"), measures(F.col("text"), rules.window).alias("m"))
    m = cut(m.select("doc_id", "host", "m.*").withColumn("failed", any_failed(rules)))
    hosts = host_verdicts(m, rules)
    out = _join_hosts(m, hosts, rules, F.pmod(F.xxhash64("doc_id"), F.lit(rules.salts)).cast("int"))
    return out.withColumn("base_failed", base_failed(rules)).withColumn("kept", ~F.when(F.col("host_bad"), F.col("failed")).otherwise(F.col("base_failed")))


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of docs, columns unchanged, that `host_rules` keeps.  The texts are measured twice, once for
    the hosts and once for the rows, which is less than shuffling them."""
    names = docs.columns
    of = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.coalesce(F.col("source"), F.lit("")).alias("host"), measures(F.col("text"), rules.window).alias("m"))
    m = lambda c: F.col(f"m.{c}")
    hosts = host_verdicts(of.select("host", any_failed(rules, m).alias("failed")), rules)
    joined = _join_hosts(of, hosts, rules, F.pmod(F.xxhash64("row.doc_id"), F.lit(rules.salts)).cast("int"))
    return joined.filter(~F.when(F.col("host_bad"), any_failed(rules, m)).otherwise(base_failed(rules, m))).select("row.*")
