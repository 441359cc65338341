"""Operator 3: rule figures per document and host verdicts, in DataFrame functions only.

Every figure is computed inside the row by higher-order functions, so no text or
word is shuffled.  Hosts: rule failures are counted per host, and the rate of each rule, and
of failing any, is shrunk with a beta prior fitted to the hosts by the method of moments.

The verdict joins the host to the document's own failures: the host's shrunk rate p of
failing any rule gives prior odds p / (1 - p) that a document of it is junk, which the
document's own outcome multiplies (``SYMBOL_ODDS``, ``LINE_ODDS``, or ``CLEAN_ODDS`` if it
fails neither).  A document is rejected when the odds exceed one, so nearly all symbol-heavy
documents go, repeated lines decide on a poor host only, and a document without failures goes
only where more than 20 of 21 of its host's documents fail.

Repeated three-word windows are found by sorting (xxhash64 of the window,
position) pairs, so a window costs O(log n) however often it repeats.  Two
different windows of one text with equal 64-bit hashes would be taken as equal
(chance under 1e-10 for a text of 20,000 words).

Results: null text counts as no words and fails the base rule.  A null host stands
for an unknown one and takes the mean host rate; without any host that is 0, and only the base rule decides.  Repeated rows and null
ids are kept, one output row each, and count once each in their host.  Only the
named columns are read.  An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.joins import small_side
from tidewater.llm.common import WORD_SPLIT, cut_lineage

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
MAX_SYMBOL_PCT = 10
MAX_DUP_LINE_PCT = 30
# How much likelier junk is than a clean document to fail these rules, or to fail neither.
SYMBOL_ODDS, LINE_ODDS, CLEAN_ODDS = 200.0, 3.0, 0.05
SYMBOLS = "#*$%&|<>"
HOST_RULES = ("short", "repetitive", "symbol_heavy", "duplicate_lines")


def rule_figures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Append n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words (all long) to ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.withColumn("_w", F.filter(F.split(text, WORD_SPLIT), lambda w: w != ""))
    d = d.withColumn("_l", F.filter(F.split(text, "\n"), lambda x: F.ltrim(x, F.lit(" \t\x0b\x0c\r")) != ""))
    n = F.size("_w")
    windows = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("_h", F.transform(windows, lambda i: F.xxhash64(
        F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))))
    # texts without any repeated window (most) stop here; a set of the hashes settles it
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    d = d.withColumn("_s", F.when(repeats, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    here = lambda k: F.get("_s", k)["h"]
    d = d.withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(F.transform(
        F.filter("_s", lambda x, k: F.coalesce(here(k - 1) == x["h"], F.lit(False))
                 | F.coalesce(here(k + 1) == x["h"], F.lit(False))), lambda x: x["i"]))))
    # windows start at the sorted positions; each covers three words up to the next start
    covered = F.aggregate(F.transform("_p", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_p", k + 1) - p, F.lit(3)))),
                          F.lit(0), lambda a, x: a + x)
    long = lambda c: c.cast("long")
    return d.withColumns({
        "n_words": long(n),
        "word_chars": long(F.length(F.translate(text, " \t\n\x0b\x0c\r", ""))),
        "n_symbols": long(F.length(text) - F.length(F.translate(text, SYMBOLS, ""))),
        "n_dup_lines": long(F.size("_l") - F.size(F.array_distinct("_l"))),
        "n_lines": long(F.size("_l")),
        "n_repeat_words": long(F.coalesce(covered, F.lit(0))),
    }).drop("_w", "_l", "_h", "_s", "_p")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))


def _rule_flags() -> dict[str, Column]:
    return {"short": F.col("n_words") < MIN_WORDS,
            "repetitive": 100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"),
            "symbol_heavy": 100 * F.col("n_symbols") > MAX_SYMBOL_PCT * F.col("word_chars"),
            "duplicate_lines": 100 * F.col("n_dup_lines") > MAX_DUP_LINE_PCT * F.col("n_lines")}


def host_rates(figures: DataFrame, host_col: str) -> tuple[DataFrame, float]:
    """One row per non-null host (host, n_docs, the shrunk rate of each rule and of any), and the mean host rate of any.

    The prior of a rule is beta(m * s, (1 - m) * s): m is the mean host rate and s
    the strength that matches the variance of the host rates beyond sampling noise
    (method of moments); without such excess variance every host takes the mean.
    """
    flags = _rule_flags()
    flags["any"] = reduce(Column.__or__, flags.values())
    hosts = (figures.where(F.col(host_col).isNotNull()).groupBy(F.col(host_col).alias("host"))
             .agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(c.cast("long")).alias(f"f_{r}") for r, c in flags.items()]))
    hosts = cut_lineage(hosts)
    rate = {r: F.col(f"f_{r}") / F.col("n_docs") for r in flags}
    moments = hosts.agg(F.avg(1 / F.col("n_docs")).alias("inv"),
                        *[F.avg(rate[r]).alias(f"m_{r}") for r in flags],
                        *[F.var_pop(rate[r]).alias(f"v_{r}") for r in flags]).first()
    out = hosts
    for r in flags:
        m, v = moments[f"m_{r}"] or 0.0, moments[f"v_{r}"] or 0.0
        noise = m * (1 - m) * (moments["inv"] or 0.0)
        between = v - noise
        s = max(m * (1 - m) / between - 1, 0.0) if between > 1e-12 else 1e9
        out = out.withColumn(f"rate_{r}", (F.col(f"f_{r}") + F.lit(m * s)) / (F.col("n_docs") + F.lit(s)))
    return out.select("host", "n_docs", *[f"rate_{r}" for r in flags]), moments["m_any"] or 0.0


def _passes(rate: Column, own: Column) -> Column:
    """The odds that the document is junk are at most one."""
    return rate * own <= 1 - rate


def own_odds() -> Column:
    flags = _rule_flags()
    symbol, line = (F.coalesce(flags[r], F.lit(False)) for r in ("symbol_heavy", "duplicate_lines"))
    return F.when(symbol | line, F.when(symbol, SYMBOL_ODDS).otherwise(1.0) * F.when(line, LINE_ODDS).otherwise(1.0)).otherwise(CLEAN_ODDS)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row: id, the figures, base_failed, host_rate (shrunk rate of failing any rule), host_ok (a document without own failures passes) and kept."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    figures = cut_lineage(rule_figures(src).drop("text").withColumn("base_failed", base_failed()))
    rates, mean = host_rates(figures, "host")
    joined = figures.join(small_side(rates.select("host", F.col("rate_any").alias("host_rate"))), "host", "left")
    return (joined.withColumn("host_rate", F.coalesce("host_rate", F.lit(mean)))
            .withColumn("host_ok", _passes(F.col("host_rate"), F.lit(CLEAN_ODDS)))
            .withColumn("kept", ~F.col("base_failed") & _passes(F.col("host_rate"), own_odds()))
            .drop("host", "n_lines"))


def keep_documents(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with their columns.

    The host table is made in a first pass; the second recomputes the figures beside
    the text, so no text is shuffled or stored.
    """
    cols = docs.columns
    work = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"),
                       F.col(text_col).alias("text"), F.col(host_col).alias("host"))
    rates, mean = host_rates(rule_figures(work.select("text", "host")).drop("text"), "host")
    # the row number, used in the filter, keeps it above the figures: pushed below, it would inline
    # them and evaluate whole arrays again for every element
    figures = rule_figures(work).withColumn("_barrier", F.monotonically_increasing_id())
    kept = (figures.where(~base_failed() & (F.col("_barrier") >= 0))
            .join(small_side(rates.select("host", F.col("rate_any").alias("host_rate"))), "host", "left")
            .where(_passes(F.coalesce("host_rate", F.lit(mean)), own_odds())))
    return kept.select(*[F.col("_row")[c].alias(c) for c in cols])
