"""Quality rules with host-level verdicts (DataFrame functions only).

Every document is measured once over its whole text. Failures are summed by host, each
host's failure rate is shrunk towards a beta prior fitted to all hosts, and a host whose
shrunk rate is beyond the limit loses its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import cut, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_DUP_PERCENT = 30
#: Symbols of the symbol rule; a fixed value.
SYMBOLS = "#*$%&|<>"
#: A host goes when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.8
SPACE_CHARS = " \t\n\x0b\x0c\r"


def measures(text: Column) -> dict[str, Column]:
    """Columns that need the text alone; a null text counts as empty."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    return {
        "word_chars": F.length(F.translate(t, SPACE_CHARS, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def repeated_words(windows: str) -> Column:
    """Words covered by 3-word windows that occur twice or more; ``windows``: array of (hash, position) by hash.

    After sorting, equal windows are neighbours; the positions found are sorted again and
    each covers three words, or as many as lie before the next position.
    """
    w = F.col(windows)
    hit = F.filter(
        w,
        lambda x, i: ((i > 0) & (F.get(w, i - 1)["h"] == x["h"])) | (F.get(w, i + 1)["h"] == x["h"]),
    )
    return F.array_sort(F.transform(hit, lambda x: x["p"]))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines (those with a word), n_dup_lines and n_repeat_words to ``docs``."""
    out = docs.withColumns(measures(F.col(text_col))).withColumn("__w", words(F.col(text_col)))
    w = F.col("__w")
    n = F.size(w)
    out = out.withColumn("n_words", n.cast("long")).withColumn(
        "__g",
        F.when(
            n >= 3,
            F.sort_array(
                F.transform(
                    F.sequence(F.lit(0), n - 3),
                    lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")),
                )
            ),
        ),
    )
    out = out.withColumn("__p", repeated_words("__g"))
    p = F.col("__p")
    covered = F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__w", "__g", "__p")


def rule_failures() -> dict[str, Column]:
    """The base rules and the softer ones, which count for the host alone."""
    return {
        "fail_short": F.col("n_words") < MIN_WORDS,
        "fail_repeats": F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words"),
        "fail_symbols": F.lit(10) * F.col("n_symbols") > F.col("n_words") * F.lit(3),
        "fail_dup_lines": F.lit(100) * F.col("n_dup_lines") > F.lit(MAX_DUP_PERCENT) * F.col("n_lines"),
    }


def host_verdicts(scored: DataFrame, host_col: str) -> DataFrame:
    """One row per host: docs, failed, shrunk rate and verdict.

    Prior: beta with the mean and variance of the hosts' rates (moments). Hosts are few
    beside documents; the sums behind the prior are map-side aggregates.
    """
    hosts = scored.groupBy(host_col).agg(
        F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("any_failed").cast("long")).alias("host_failed")
    )
    rate = F.col("host_failed") / F.col("host_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.avg(1 / F.col("host_docs")).alias("inv"))
    m, v = F.col("m"), F.col("v")
    # the spread of observed rates holds sampling noise m(1-m)/n, which is not spread of the hosts themselves
    spread = F.greatest(v - m * (1 - m) * F.col("inv"), F.lit(1e-6))
    strength = F.greatest(F.coalesce(m * (1 - m) / spread - 1, F.lit(1.0)), F.lit(1.0))
    prior = prior.select(m.alias("m"), F.least(strength, F.lit(1000.0)).alias("k"))
    shrunk = (F.col("host_failed") + F.col("m") * F.col("k")) / (F.col("host_docs") + F.col("k"))
    # one row of two numbers on the other side
    return (
        hosts.crossJoin(F.broadcast(prior))
        .select(host_col, "host_docs", "host_failed", shrunk.alias("host_rate"))
        .withColumn("host_rejected", F.col("host_rate") > MAX_HOST_RATE)
    )


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source"
) -> DataFrame:
    """Verdict per row of ``docs``.

    Returns id_col, host_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, host_rate, host_rejected and kept, one row per input row.

    Null text: empty, so it fails the word count. Null host: a host of its own kind. Null
    ids and repeated rows are measured like any other row and stay as they are. An empty
    table gives an empty result. Other columns of ``docs`` are not read, whatever they are called.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(host_col).alias("host"))
    scored = measure(rows).drop("text")
    scored = scored.withColumns(rule_failures())
    scored = scored.withColumn("base_failed", F.col("fail_short") | F.col("fail_repeats"))
    scored = scored.withColumn("any_failed", F.col("base_failed") | F.col("fail_symbols") | F.col("fail_dup_lines"))
    scored = cut(scored, "quality")  # the texts are measured once, for the hosts' sums and for the rows
    hosts = cut(host_verdicts(scored, "host"), "hosts")
    joined = scored.alias("s").join(hosts.alias("h"), F.col("s.host").eqNullSafe(F.col("h.host")), "left")
    return joined.select(
        F.col("s.id").alias(id_col),
        F.col("s.host").alias(host_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        F.round("host_rate", 6).alias("host_rate"),
        "host_rejected",
        (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"),
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with their columns.

    Rows are numbered by their id: a repeated id is judged row by row, and stays when any of
    its rows passes. Rows without an id go when no row without an id passes.
    """
    good = quality_rules(docs, id_col, text_col, host_col).where("kept").select(F.col(id_col).alias("__ok")).distinct()
    return docs.join(good.hint("merge"), docs[id_col].eqNullSafe(good["__ok"]), "left_semi")
