"""Quality rules with a verdict on the host (DataFrame functions only).

Every document gets five counts and a base verdict inside its own row, without a shuffle.
Failures are then added up by host and rule (map-side first, so a host with a third of all
rows costs no more than another). For each rule a beta prior is fitted to the hosts' rates by
moments, less what chance alone spreads them; a host's rate is shrunk towards it. A host
takes all of its documents with it where, for some rule, its posterior rate, less two
posterior deviations, is beyond three deviations of the prior and its odds of failing are at
least eight times the corpus's. Both limits come from the fitted prior: no rate is fixed.

Defined cases: a null text has no words (so it fails); a very long text is counted whole; a
null host is a host of its own; repeated rows are judged one by one; of several rules that a
host fails none goes before another; an empty table gives an empty result; columns other
than the named ones are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import DOCUMENT_COLUMNS, broadcast_if_small, materialize, split_words, table

WINDOW = 8
SYMBOLS = "#*$%&|<>"

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A document whose symbols exceed this share of its characters counts against its host.
MAX_SYMBOL_PERCENT = 10
#: As many lines that repeat another for each so many words.
WORDS_PER_DUP_LINE = 20
#: A bad host's posterior rate, less DOUBT posterior deviations, is beyond SPREAD deviations of the
#: prior, and its odds of failing are ODDS times the corpus's.
DOUBT, SPREAD, ODDS = 2.0, 3.0, 8.0
#: Weight of the prior, in documents: where the hosts' rates differ no more than by chance, and at least.
FLAT_PRIOR, LEAST_PRIOR = 1000.0, 1.0


def _repeat_words(grams: Column, runs: Column) -> Column:
    """Positions covered by windows that occur twice: ``runs`` has (window, place) sorted."""
    again = F.filter(
        runs,
        lambda x, k: ((k > 0) & (F.get(runs, k - 1)["g"] == x["g"])) | F.coalesce(F.get(runs, k + 1)["g"] == x["g"], F.lit(False)),
    )
    places = F.array_sort(F.transform(again, lambda x: x["i"]))
    return F.aggregate(
        places,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("covered")),
        lambda acc, p: F.struct(
            (p + WINDOW).alias("end"),
            (acc["covered"] + p + WINDOW - F.greatest(p, acc["end"])).alias("covered"),
        ),
        lambda acc: acc["covered"],
    )


def rule_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the counts of every whole text, by narrow projections only."""
    text = F.coalesce(F.col("__text"), F.lit(""))
    # Equal windows are found by 64-bit hashes of their words, chained in order.
    df = docs.select(*keep, F.col("text").alias("__text"))
    df = df.select(*keep, "__text", split_words(text).alias("__words"))
    df = df.select(*keep, "__text", "__words", F.transform("__words", lambda w: F.xxhash64(w)).alias("__h"))
    grams = F.when(
        F.size("__h") >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), F.size("__h") - WINDOW),
            lambda i: F.xxhash64(*[F.get(F.col("__h"), i + k) for k in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != "")
    df = df.select(
        *keep,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
        grams.alias("__grams"),
    )
    runs = F.when(
        F.size(F.array_distinct("__grams")) < F.size("__grams"),
        F.array_sort(F.transform("__grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))),
    )
    df = df.select(
        *keep, "n_words", "word_chars", "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.col("__grams"), runs.alias("__runs"),
    )
    return df.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.when(F.col("__runs").isNull(), F.lit(0)).otherwise(_repeat_words(F.col("__grams"), F.col("__runs"))).cast("long").alias("n_repeat_words"),
    ).withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    )


def failures() -> dict[str, Column]:
    """What counts against a host, by rule."""
    return {
        "short": F.col("n_words") < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars"),
        "dup_lines": WORDS_PER_DUP_LINE * F.col("n_dup_lines") > F.col("n_words"),
    }


def host_rates(counts: DataFrame, host: str) -> DataFrame:
    """(host, rule, n, f, rate, bad): a row a host and rule, from the rules' failures and the fitted prior."""
    rules = failures()
    hosts = counts.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(r) for r, c in rules.items()))
    long = hosts.select("host", "n", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).cast("double").alias("f")) for r in rules))).alias("x"))
    long = materialize(long.select("host", "n", "x.rule", "x.f"))
    rate = F.col("f") / F.col("n")
    # Chance alone gives a host of n documents the variance m (1 - m) / n.
    prior = long.groupBy("rule").agg(
        (F.sum("f") / F.sum("n")).alias("m"), F.avg(rate).alias("mean"), F.var_pop(rate).alias("v"), F.avg(1 / F.col("n")).alias("chance"),
    )
    spread = F.col("m") * (1 - F.col("m"))
    over = F.col("v") - spread * F.col("chance")
    strength = F.when(over > spread / FLAT_PRIOR, F.greatest(spread / over - 1, F.lit(LEAST_PRIOR))).otherwise(F.lit(FLAT_PRIOR))
    # A row a rule.
    prior = F.broadcast(prior.select("rule", "m", strength.alias("s")))
    m, s, n = F.col("m"), F.col("s"), F.col("n")
    shrunk = (F.col("f") + m * s) / (n + s)
    doubt = F.sqrt(shrunk * (1 - shrunk) / (n + s + 1))
    beyond = shrunk - DOUBT * doubt > m + SPREAD * F.sqrt(m * (1 - m) / (s + 1))
    bad = beyond & (shrunk * (1 - m) >= ODDS * m * (1 - shrunk))
    return long.join(prior, "rule").select("host", "rule", "n", "f", shrunk.alias("rate"), bad.alias("bad"))


def host_verdicts(counts: DataFrame, host: str) -> DataFrame:
    """(__host, __bad, __rate): a row a host; the largest of its shrunk rates."""
    return host_rates(counts, host).groupBy(F.col("host").alias("__host")).agg(F.bool_or("bad").alias("__bad"), F.max("rate").alias("__rate"))


def quality_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the host's largest shrunk rate, one row a document."""
    counts = materialize(rule_counts(docs.select("doc_id", F.col(host).alias("__source"), "text"), ["doc_id", "__source"]))
    hosts = materialize(host_verdicts(counts, "__source"))
    out = counts.join(broadcast_if_small(hosts), counts["__source"].eqNullSafe(hosts["__host"]), "left")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.coalesce("__bad", F.lit(False))).alias("kept"),
        F.col("__rate").alias("host_rate"),
    )


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """The documents that pass, with their own columns only (a pipeline stage).

    Counts are worked out once: they are written beside the texts of documents that pass, and
    without the texts of those that fail.
    """
    docs = docs.select(*DOCUMENT_COLUMNS)
    whole = docs.select(*(F.col(c).alias(f"__{c}") for c in DOCUMENT_COLUMNS), "text", F.col(host).alias("__host_of"))
    own = [f"__{c}" for c in DOCUMENT_COLUMNS]
    judged = rule_counts(whole.withColumn("__whole", F.col("__text")).drop("__text"), [*(c for c in own if c != "__text"), "__whole", "__host_of"])
    judged = judged.withColumn("__whole", F.when(~F.col("base_failed"), F.col("__whole")))
    judged = materialize(judged)
    bad = materialize(host_verdicts(judged, "__host_of")).where("__bad").select("__host")
    good = judged.where(~F.col("base_failed"))
    good = good.join(broadcast_if_small(bad), good["__host_of"].eqNullSafe(bad["__host"]), "left_anti")
    return good.select(*(F.col("__whole" if c == "text" else f"__{c}").alias(c) for c in DOCUMENT_COLUMNS))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("host_rate")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), g AS (
  SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS gram
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)
), p AS (
  SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM (
    SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1
), r AS (
  SELECT rid, sum(CASE WHEN before IS NULL THEN 8 ELSE least(8, i - before) END) AS n FROM p GROUP BY rid
), c AS (
  SELECT doc_id, source, len(ws) AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r USING (rid)
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c
), h AS (
  SELECT source, n, rule, f::DOUBLE AS f FROM (
    SELECT source, count(*) AS n, count(*) FILTER (n_words < 20) AS short, count(*) FILTER (100 * n_repeat_words > 30 * n_words) AS repeats,
           count(*) FILTER (100 * n_symbols > 10 * word_chars) AS symbols, count(*) FILTER (20 * n_dup_lines > n_words) AS dup_lines
    FROM b GROUP BY source
  ) UNPIVOT (f FOR rule IN (short, repeats, symbols, dup_lines))
), q AS (
  SELECT rule, m, CASE WHEN v - m * (1 - m) * c > m * (1 - m) / 1000.0 THEN greatest(m * (1 - m) / (v - m * (1 - m) * c) - 1, 1.0) ELSE 1000.0 END AS s
  FROM (SELECT rule, sum(f) / sum(n) AS m, var_pop(f / n) AS v, avg(1 / n) AS c FROM h GROUP BY rule)
), z AS (
  SELECT source, n, m, s, (f + m * s) / (n + s) AS x FROM h JOIN q USING (rule)
), k AS (
  SELECT source, bool_or(x - 2 * sqrt(x * (1 - x) / (n + s + 1)) > m + 3 * sqrt(m * (1 - m) / (s + 1)) AND x * (1 - m) >= 8 * m * (1 - x)) AS bad FROM z GROUP BY source
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT k.bad AS kept
FROM b JOIN k ON b.source IS NOT DISTINCT FROM k.source
"""
