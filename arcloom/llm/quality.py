"""Quality rules: documents' rule failures, aggregated by host and shrunk with an empirical beta prior.

DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spare_prefix, without, written

BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Hosts up to which the host table is broadcast; beyond it, the join is a shuffle that Spark splits where hot.
MOST_BROADCAST = 100_000
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, BLANK[1:], " " * 5), " "), "")


def repeat_words(words: Column, width: int = 8) -> Column:
    """Words that lie in windows of width words found at least twice in the array.

    Windows are compared by 64-bit hashes. Equal hashes are neighbours once sorted; each window found twice adds the
    words up to the next such window, width at most."""

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.when(k + 1 < F.size(at), F.least(F.lit(width), F.get(at, k + 1) - p)).otherwise(width))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def found(hashes: Column) -> Column:
        def twice(pairs: Column) -> Column:
            own = F.filter(pairs, lambda x, k: F.coalesce(F.get(pairs, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(pairs, k + 1)["h"] == x["h"], F.lit(False)))
            return let(F.sort_array(F.transform(own, lambda x: x["i"])), covered)

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, twice))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.xxhash64(F.slice(words, i, width)))
    return F.when(F.size(words) < width + 1, F.lit(0)).otherwise(let(hashes, found))


def with_metrics(df: DataFrame, text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    has_word = lambda x: F.length(F.translate(x, BLANK, "")) > 0
    dup = let(F.filter(F.split(text, "\n"), has_word), lambda a: F.size(a) - F.size(F.array_distinct(a)))
    own = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words")))
    name = spare_prefix(df) + "own"
    return (
        df.withColumn(name, own)
        .withColumn("n_words", F.col(f"{name}.n_words"))
        .withColumn("word_chars", F.length(F.translate(text, BLANK, "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", dup.cast("long"))
        .withColumn("n_repeat_words", F.col(f"{name}.n_repeat_words"))
        .drop(name)
    )


def rules() -> dict[str, Column]:
    """Each rule as a test on the metrics. base: fails everywhere. severe: fails everywhere, by this method's choice. mild: fails where the host is bad."""
    n = F.col("n_words")
    return {
        "base": (n < 20) | (100 * F.col("n_repeat_words") > 30 * n),
        "severe": F.col("n_symbols") * 2 > n,
        "mild": (F.col("n_symbols") * 10 > n) | (100 * F.col("n_repeat_words") > 20 * n) | (F.col("n_dup_lines") * 20 > n) | (F.col("word_chars") > 10 * n) | (F.col("word_chars") < 3 * n),
    }


def host_verdicts(checked: DataFrame, bad_rate: float = 0.4) -> DataFrame:
    """host, n, failures, rate, bad: the share of each host's documents that fail a rule, shrunk to the hosts' mean.

    The prior is a beta distribution with the mean of the hosts' rates and their variance less what chance within hosts
    gives; small hosts move towards the mean, large ones keep their own rate. The prior is one row, computed by an aggregate."""
    hosts = checked.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("failures"))
    share = F.col("failures") / F.col("n")
    prior = hosts.agg(F.avg(share).alias("m"), F.var_pop(share).alias("v"), F.avg(1 / F.col("n")).alias("inverse")).select(
        "m", F.greatest(F.col("v") - F.col("m") * (1 - F.col("m")) * F.col("inverse"), F.lit(1e-6)).alias("v")
    )
    weight = F.least(F.greatest(F.try_divide(F.col("m") * (1 - F.col("m")), F.col("v")) - 1, F.lit(1.0)), F.lit(1e4))
    prior = prior.select((F.col("m") * weight).alias("a"), ((1 - F.col("m")) * weight).alias("b"))
    rate = (F.col("failures") + F.col("a")) / (F.col("n") + F.col("a") + F.col("b"))
    return hosts.join(F.broadcast(prior), how="inner").select("host", "n", "failures", rate.alias("rate"), (rate > bad_rate).alias("bad"))  # prior is one row


def host_quality(df: DataFrame, host_col: str = "source", text_col: str = "text", carry: list[str] | None = None, bad_rate: float = 0.4) -> DataFrame:
    """df's rows with their metrics, base_failed and kept.

    Metrics cover whole texts. A document is rejected where it fails a base rule, where it is severely symbolic, or
    where it fails a milder rule and its host's verdict is bad; a document that fails no rule stays on any host.
    Documents with metrics are written once to the shared folder; the host table is aggregated from that, broadcast
    only while it has at most MOST_BROADCAST hosts, and joined back.

    Columns: those in carry (all, unless given; those named like a result are replaced), the metrics, base_failed, kept.
    A null text counts as empty and so fails; a null host is a host of its own; repeated rows count as often as they
    are there; an empty table gives no rows.
    """
    own = without(df, *METRICS, "base_failed", "kept")
    carry = [c for c in (carry or own.columns) if c in own.columns]
    host = F.col(host_col).cast("string") if host_col in own.columns else F.lit(None).cast("string")
    mark = spare_prefix(own)
    judged = with_metrics(own.withColumn(f"{mark}host", host), text_col)
    own_rules = rules()
    judged = written(
        judged.select(*[F.col(f"`{c}`") for c in carry], f"{mark}host", *METRICS, *[r.alias(f"{mark}{k}") for k, r in own_rules.items()]), "quality"
    )
    base, severe, mild = (F.col(mark + k) for k in ("base", "severe", "mild"))
    failed = base | severe | mild
    hosts = written(host_verdicts(judged.select(F.coalesce(F.concat(F.lit("h"), f"{mark}host"), F.lit("-")).alias("host"), failed.alias("failed")), bad_rate), "hosts")
    verdict = hosts.select(F.col("host").alias(f"{mark}key"), F.col("bad").alias(f"{mark}bad"))
    if hosts.count() <= MOST_BROADCAST:
        verdict = F.broadcast(verdict)
    kept = ~base & ~severe & ~(mild & F.col(f"{mark}bad"))
    return (
        judged.withColumn(f"{mark}key", F.coalesce(F.concat(F.lit("h"), f"{mark}host"), F.lit("-")))
        .join(verdict, f"{mark}key")
        .select(*[F.col(f"`{c}`") for c in carry], *METRICS, base.alias("base_failed"), kept.alias("kept"))
    )
