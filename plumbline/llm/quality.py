"""Quality rules: base rules for each document, then verdicts on hosts.

Everything is built-in SQL. Failures of the base rules are counted by host, each host's failure
rate is shrunk with a beta prior fitted to all hosts (method of moments), and a host is rejected with all
of its documents where its posterior leaves little doubt that most of what it holds fails: where the rate
less ``HOST_DEVIATIONS`` posterior standard deviations is over ``HOST_FAILURE_LIMIT``. The few host rows
are joined back to documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ._scratch import materialize

#: Words are runs of other than these, and what counts as a symbol.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"

LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
#: The share of failing documents that a host must be over, and by how many standard deviations of its posterior (1.645: 95 %).
HOST_FAILURE_LIMIT = 0.5
HOST_DEVIATIONS = 1.645
#: Copies of each host's row for the join back; a host with a third of all documents is dealt over them.
SALTS = 32


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, whatever the optimizer merges."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, size: int = 3) -> Column:
    """Words that stand in a window of ``size`` words found twice or more in ``words``."""

    def covered(w: Column) -> Column:
        # A window's words are referred to, not copied: its hash sorts it, and the words themselves tell equal hashes apart.
        def window(i: Column) -> Column:
            parts = [F.element_at(w, (i + k).cast("int")) for k in range(size)]
            return F.struct(F.xxhash64(*parts).alias("h"), *[p.alias(f"w{k}") for k, p in enumerate(parts)], i.alias("i"))

        windows = F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), window)

        def equal(x: Column, y: Column) -> Column:
            out = x["h"] == y["h"]
            for k in range(size):
                out = out & (x[f"w{k}"] == y[f"w{k}"])
            return F.coalesce(out, F.lit(False))

        def among(s: Column) -> Column:
            hits = F.filter(F.transform(s, lambda x, i: F.when(equal(F.get(s, i - 1), x) | equal(F.get(s, i + 1), x), x["i"])), lambda x: x.isNotNull())
            return F.size(F.array_distinct(F.flatten(F.transform(hits, lambda i: F.sequence(i, i + (size - 1))))))

        return let(F.sort_array(windows), among)

    return F.when(F.size(words) >= size, covered(words)).otherwise(0)


def base_metrics(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long); a null text has no words."""

    def measured(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
        words = F.filter(F.split(t, SPACE + "+"), lambda x: x != "")
        return let(words, lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.coalesce(F.aggregate(w, F.lit(0).cast("long"), lambda n, x: n + F.length(x)), F.lit(0).cast("long")).alias("word_chars"),
            F.regexp_count(t, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
            let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        ))

    return let(F.coalesce(text, F.lit("")), measured)


def base_failed(m: str = "") -> Column:
    n, r = F.col(f"{m}n_words"), F.col(f"{m}n_repeat_words")
    return (n < LEAST_WORDS) | (100 * r > MOST_REPEATED_PERCENT * n)


def beta_prior(hosts: DataFrame) -> DataFrame:
    """One row (alpha, beta) from hosts' (n, failed), by the method of moments over hosts' rates.

    Where rates don't vary, or vary beyond any beta, a prior of one document at the mean rate.
    """
    m, v = F.col("m"), F.col("v")
    strength = F.when((v > 0) & (v < m * (1 - m)), m * (1 - m) / v - 1).otherwise(F.lit(1.0))
    row = hosts.agg((F.sum("failed") / F.sum("n")).alias("m"), F.var_pop(F.col("failed") / F.col("n")).alias("v"))
    return row.select((m * strength).alias("alpha"), ((1 - m) * strength).alias("beta"))


def host_rates(measured: DataFrame, host: str = "source") -> DataFrame:
    """Per host (null is a host): n, failed, the shrunk ``rate`` and whether it is ``rejected``."""
    hosts = measured.groupBy(host).agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    prior = F.broadcast(beta_prior(hosts))  # one row
    alpha, beta = F.coalesce("alpha", F.lit(0.0)), F.coalesce("beta", F.lit(0.0))
    weight = F.col("n") + alpha + beta
    rated = hosts.join(prior, F.lit(True), "left").withColumn("rate", (F.col("failed") + alpha) / weight).withColumn("deviation", F.sqrt(F.col("rate") * (1 - F.col("rate")) / (weight + 1)))
    return rated.select(host, "n", "failed", "rate", (F.col("rate") - HOST_DEVIATIONS * F.col("deviation") > HOST_FAILURE_LIMIT).alias("rejected"))


def apply_rules(docs: DataFrame, text: str = "text", host: str = "source", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default doc_id and host) with the base metrics, base_failed, host_rate and kept.

    A null text has no words and fails. A null host is a host of its own. Repeated rows count each
    time; an empty table gives an empty one. Texts are read once: the metrics are written to the
    shared folder and both the counts by host and the join back read those narrow rows.
    """
    keep = ["doc_id", host] if keep is None else keep
    named = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)]
    rows = docs.select(*named, F.col(f"`{host}`").cast("string").alias("_host"), base_metrics(F.col(f"`{text}`").cast("string")).alias("_m"))
    measured = materialize(rows.select(*[f"_k{i}" for i in range(len(keep))], "_host", "_m.*").withColumn("base_failed", base_failed()), "quality-metrics")
    hosts = host_rates(measured, "_host").select(F.col("_host").alias("_h"), F.col("rate").alias("host_rate"), "rejected", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    salted = measured.withColumn("_salt", F.pmod(F.xxhash64("n_words", "word_chars", *[f"_k{i}" for i in range(len(keep))]), F.lit(SALTS)).cast("int"))
    out = salted.join(hosts, F.col("_host").eqNullSafe(F.col("_h")) & (F.col("_salt") == F.col("_s")))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("rejected")).drop("_host", "_h", "_s", "_salt", "rejected").withColumnsRenamed({f"_k{i}": c for i, c in enumerate(keep)})


#: So many rejected hosts may be broadcast; beyond, they are joined by shuffle.
BROADCAST_HOSTS = 20_000


def filter_documents(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass the base rules and whose host isn't rejected, all columns as they were, by any names.

    A null or empty text has no words and fails. A null host is a host of its own. Repeated rows are judged
    one by one; an empty table gives an empty one.

    Texts are measured once: rows are written to the shared folder with the verdict, failed ones
    without their text, and hosts are counted from the two narrow columns.
    """
    columns = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)]
    at_text, at_host = docs.columns.index(text), docs.columns.index(host)
    rows = docs.select(*columns, base_metrics(F.col(f"`{text}`").cast("string")).alias("_m")).withColumn("base_failed", base_failed("_m."))
    rows = rows.withColumn(f"_c{at_text}", F.when(~F.col("base_failed"), F.col(f"_c{at_text}"))).drop("_m")
    judged = materialize(rows, "quality-rows")
    rejected = host_rates(judged, f"_c{at_host}").filter("rejected").select(F.col(f"_c{at_host}").alias("_h"))
    few = rejected.count() <= BROADCAST_HOSTS
    kept = judged.filter(~F.col("base_failed")).join(F.broadcast(rejected) if few else rejected, F.col(f"_c{at_host}").eqNullSafe(F.col("_h")), "left_anti")
    return kept.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
