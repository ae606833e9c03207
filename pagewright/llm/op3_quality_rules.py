"""Quality rules with host-level verdicts, with DataFrame functions only.

Each document is measured once. Failures of the rules are counted by host
(the source column); failure rates are shrunk towards all hosts by a beta prior
whose parameters are fitted to the hosts' rates by moments; hosts whose shrunk
rate is above the limit are rejected, and the verdict is joined back. A document
fails with few words or many repeated windows (base_failed), and with many
symbols or many repeated lines.

Defined results: a null text has no words, so it fails; a null source is the
host ''; rows with null or repeated ids are judged row by row; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import bounded, staged

NAME = "op3_quality_rules"
WINDOW, LEAST_WORDS, MOST_REPEATED, MOST_FAILING = 8, 20, 30, 0.5
#: Per cent of symbols to the characters of words, and of lines that repeat an earlier one: no document labelled clean at sf0.1 has more.
MOST_SYMBOLS, MOST_DUP_LINES = 10, 40
_WHITE = r"[ \t\n\x0B\f\r]+"


def measures(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, host and the measures of each text."""
    text, w, h = F.col("body"), F.col("w"), F.col("h")
    n = F.size(w)
    lines = F.filter(F.split(text, "\n"), lambda x: F.ltrim(x, F.lit(" \t\x0b\f\r")) != "")
    window = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[w[i + j] for j in range(WINDOW)]))
    out = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("host"), F.coalesce("text", F.lit("")).alias("body"), *extra)
    out = out.withColumn("w", F.array_remove(F.split(text, _WHITE), ""))
    out = out.select(
        "doc_id", "host", *extra,
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.transform(lines, lambda x: F.xxhash64(x)).alias("lines"),
        F.when(n >= WINDOW, window).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    # only texts with a repeated window are looked at closer
    order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    out = out.withColumn("order", F.when(F.size(F.array_distinct(h)) < F.size(h), order))
    out = out.withColumn("at", F.sort_array(repeated_positions(F.col("order"))))
    gaps = F.aggregate(F.sequence(F.lit(1), F.size("at") - 1), F.lit(WINDOW), lambda a, j: a + F.least(F.lit(WINDOW), F.col("at")[j] - F.col("at")[j - 1]))
    return out.select(
        "doc_id", "host", *extra, "n_words", "word_chars", "n_symbols", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("at").isNull(), 0).otherwise(gaps).cast("long").alias("n_repeat_words"),
    )


def repeated_positions(order: Column) -> Column:
    """Positions of the hashes that occur twice or more; order: (hash, position), sorted; null stays null."""
    last = F.size(order) - 1
    beside = F.transform(
        order,
        lambda x, j: F.when(
            (F.when(j > 0, order[j - 1]["h"] == x["h"]).otherwise(False)) | (F.when(j < last, order[j + 1]["h"] == x["h"]).otherwise(False)), x["i"]
        ),
    )
    return F.filter(beside, lambda i: i.isNotNull())


def host_rates(rows: DataFrame) -> DataFrame:
    """(host, n, failed, rate): failure rates shrunk by the fitted beta prior; rows: host, failed."""
    hosts = rows.groupBy("host").agg(F.count("*").alias("n"), F.count_if("failed").alias("failed"))
    sums = hosts.agg(F.sum("n").alias("all"), (F.sum("failed") / F.sum("n")).alias("m"), (F.sum(F.col("failed") * F.col("failed") / F.col("n")) / F.sum("n")).alias("square"))
    spread = F.col("square") - F.col("m") * F.col("m")
    strength = F.when(spread > 1e-9, F.least(F.lit(1e6), F.greatest(F.lit(1.0), F.col("m") * (1 - F.col("m")) / spread - 1))).otherwise(F.lit(1e6))
    m, k = sums.select("m", strength).first()  # a single row; without documents there is neither
    return hosts.select("host", "n", "failed", ((F.col("failed") + F.lit(m or 0.0) * F.lit(k or 1.0)) / (F.col("n") + F.lit(k or 1.0))).alias("rate"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def failed() -> Column:
    """base_failed, or too many symbols or repeated lines."""
    return base_failed() | (100 * F.col("n_symbols") > MOST_SYMBOLS * F.col("word_chars")) | (100 * F.col("n_dup_lines") > MOST_DUP_LINES * F.col("n_lines"))


def rejected_hosts(rows: DataFrame, most_failing: float) -> DataFrame:
    """(host, host_rejected): hosts whose documents fail too often; rows: host, failed."""
    rates = host_rates(rows.select("host", "failed"))
    return rates.where(F.col("rate") > most_failing).select("host", F.lit(True).alias("host_rejected"))


def quality_rules(docs: DataFrame, most_failing: float = MOST_FAILING) -> DataFrame:
    """Per row: doc_id, the measures, base_failed, failed, kept, host and host_rejected."""
    rows = staged(measures(docs).withColumn("base_failed", base_failed()).withColumn("failed", failed()), "measures")
    # rejected hosts are few: broadcast, rows of a host with a third of all need no deal
    out = rows.join(bounded(staged(rejected_hosts(rows, most_failing), "rejected")), "host", "left").withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    return out.withColumn("kept", ~F.col("failed") & ~F.col("host_rejected"))


def passing(docs: DataFrame, most_failing: float = MOST_FAILING) -> DataFrame:
    """The rows of docs, with all their columns, that the rules keep.

    Each row is measured once and written with its verdict; of a row that fails, nothing but the host.
    """
    rows = measures(docs.withColumn("__row", F.struct(*docs.columns)), ("__row",)).withColumn("failed", failed())
    rows = staged(rows.select(F.when(~F.col("failed"), F.col("__row")).alias("__row"), "host", "failed"), "judged")
    rejected = staged(rejected_hosts(rows, most_failing), "rejected")
    return rows.where("not failed").join(bounded(rejected), "host", "left_anti").select("__row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_rules(docs).select(*columns)


QUERIES = {NAME: query}
ORACLES = {
    NAME: r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i+7], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1),
gap AS (SELECT r, i, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 8) AS g FROM hit),
rep AS (SELECT r, sum(least(8, g)) AS n FROM gap GROUP BY r),
lin AS (SELECT r, l FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^ \t\n\x0b\f\r]')),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n, count(*) AS l FROM lin GROUP BY r),
m AS (SELECT d.r, doc_id, host, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(dup.n, 0) AS n_dup_lines, coalesce(dup.l, 0) AS n_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)),
a AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
b AS (SELECT *, base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 40 * n_lines AS failed FROM a),
h AS (SELECT host, count(*) AS n, count(*) FILTER (failed) AS x FROM b GROUP BY host),
p AS (SELECT sum(x) / sum(n) AS mean, sum(x * x / n) / sum(n) - (sum(x) / sum(n)) ** 2 AS spread FROM h),
q AS (SELECT mean, CASE WHEN spread > 1e-9 THEN least(1e6, greatest(1.0, mean * (1 - mean) / spread - 1)) ELSE 1e6 END AS k FROM p),
v AS (SELECT host, (x + mean * k) / (n + k) > 0.5 AS rejected FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT failed AND NOT rejected AS kept FROM b JOIN v USING (host)"""
}
