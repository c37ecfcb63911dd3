"""Secret scan with corpus-wide ownership (DataFrame functions only).

Base spans (assignments, access keys, long hex runs) are found in each whole text. The
method then looks at every candidate value of the corpus, bare mixed-case tokens too:
hashes are added up by distinct repository and owner, map-side first. A value that several
owners hold, or many repositories of however few owners, is a widely copied example; a bare
token that is not is an owner-specific, live-looking credential and adds its span. Base spans
always stay.

Spans are rows, not arrays, while they are placed: a text's places are running sums of the
lengths between matches, and a bare token is held against the base spans before and after
it, so work grows with the spans of a text and not with their square. A value with very many
uses is joined by broadcast.

Defined cases: a null text is empty; very long texts are searched whole; null owners and
repositories count as one each; spans of one start are listed in the order of the kinds;
repeated rows each get their own result; empty tables give empty results; columns other
than the named ones are dropped. Places are code points, the end exclusive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm.common import DOCUMENT_COLUMNS, broadcast_if_small, join_hot, materialize, table, text_or_empty

#: Kinds in the order in which spans of one start are listed: pattern, group of the value,
#: least code points of the value. Java's (?i) without (?u) folds ASCII letters alone.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = [
    ("assign", ASSIGN, 2, 8),
    # A run of 16 or more is the same as a run of any length that is then found long enough.
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
#: What a bare token must be made of, and hold, to be a candidate.
BARE = r"[A-Za-z0-9+/_=-]{20,}"
BARE_HOLDS = ["[A-Z]", "[a-z]", "[0-9]"]

LIVE = "live"
#: Values held by at least so many owners, or in so many repositories, are examples.
EXAMPLE_OWNERS = 3
EXAMPLE_REPOSITORIES = 6
MASK = "<SECRET>"


def mixed_case(value: Column) -> Column:
    return reduce(lambda a, b: a & b, [value.rlike(p) for p in BARE_HOLDS])


def _matches(text: Column, pattern: str, group: int, order: int, kept: Column) -> Column:
    """Every match in order: length of the gap before it, its own length, and the hash of its value if ``kept``."""
    gaps = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)) if group else values
    zipped = F.arrays_zip(gaps.alias("g"), whole.alias("m"), values.alias("v"))
    one = lambda x, i: F.struct(
        F.lit(order).alias("k"), i.alias("i"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("n"),
        F.when(kept(x["v"]), F.sha2(x["v"], 256)).alias("h"),
    )
    # The last gap has no match.
    found = F.filter(F.transform(zipped, one), lambda x: x["n"].isNotNull())
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_MATCHES))


_MATCHES = "array<struct<k:int,i:int,gap:int,n:int,h:string>>"


def find_matches(df: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """``keep`` and ``__found``, the matches of all kinds; bare tokens are the last kind."""
    df = df.select(*keep, text.alias("__t"))
    parts = [_matches(F.col("__t"), p, g, k, lambda v, least=least: F.length(v) >= least) for k, (_, p, g, least) in enumerate(KINDS)]
    bare = _matches(F.col("__t"), BARE, 0, len(KINDS), mixed_case)
    return df.select(*keep, F.concat(*parts, bare).alias("__found"))


def find_spans(found: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` (with ``__row``), ``k``, ``s``, ``e``, ``h``: a row a span; bare tokens that meet a base span are left out."""
    each = found.where(F.exists("__found", lambda x: x["h"].isNotNull())).select(*keep, F.explode("__found").alias("x")).select(*keep, "x.*")
    before = Window.partitionBy("__row", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("e", F.sum(F.col("gap") + F.col("n")).over(before).cast("int"))
    each = each.where("h is not null").select(*keep, "k", (F.col("e") - F.col("n")).alias("s"), "e", "h")
    base = F.col("k") < len(KINDS)
    by_start = Window.partitionBy("__row").orderBy("s")
    earlier = F.max(F.when(base, F.col("e"))).over(by_start.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    later = F.min(F.when(base, F.col("s"))).over(by_start.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    each = each.withColumns({"__earlier": earlier, "__later": later})
    meets = (F.col("__earlier") > F.col("s")) | (F.col("__later") < F.col("e"))
    return each.where(base | ~F.coalesce(meets, F.lit(False))).select(*keep, "k", "s", "e", "h")


def ownership(candidates: DataFrame) -> DataFrame:
    """Spans, distinct repositories and owners of each hash; every step combines map-side."""
    each = candidates.groupBy("__h", "__owner", "__repo").agg(F.count(F.lit(1)).alias("n"))
    owners = each.groupBy("__h", "__owner").agg(F.count(F.lit(1)).alias("r"), F.sum("n").alias("n"))
    return owners.groupBy("__h").agg(
        F.count(F.lit(1)).alias("__owners"), F.sum("r").alias("__repos"), F.sum("n").alias("__n")
    )


def judged_spans(spans: DataFrame) -> DataFrame:
    """``spans`` with ``__owners``, ``__repos`` and ``__example``: what the corpus says of each value."""
    owned = materialize(ownership(spans.withColumnRenamed("h", "__h")))
    uses = owned.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    judged = join_hot(spans.withColumnRenamed("h", "__h"), owned, "__h", "__n", uses)
    example = (F.col("__owners") >= EXAMPLE_OWNERS) | (F.col("__repos") >= EXAMPLE_REPOSITORIES)
    return judged.withColumn("__example", example)


def scan(docs: DataFrame, owner: Column, repository: Column, key: list[str], text: Column) -> tuple[DataFrame, DataFrame]:
    """A row for each row of ``docs`` (``key``, ``__row``), and the judged spans of all of them (``__row``, k, s, e ...)."""
    keyed = docs.select(*key, owner.alias("__owner"), repository.alias("__repo"), text.alias("__text"), F.monotonically_increasing_id().alias("__row"))
    found = materialize(find_matches(keyed, F.col("__text"), [*key, "__owner", "__repo", "__row"]))
    spans = materialize(find_spans(found, ["__row", "__owner", "__repo"]))
    return found.select(*key, "__row"), judged_spans(spans)


def _listed(condition: Column) -> Column:
    """kind:start:end by start and kind, joined by commas, of the spans for which the condition holds."""
    name = F.element_at(F.array(*(F.lit(n) for n, *_ in KINDS), F.lit(LIVE)), F.col("k") + 1)
    one = F.struct("s", "k", F.concat_ws(":", name, F.col("s").cast("string"), F.col("e").cast("string")).alias("t"))
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(condition, one))), lambda x: x["t"]), ",")


def secret_scan(docs: DataFrame, owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """Counts, the digest of the base spans, all spans, how many values look live or copied, and in
    how many owners and repositories the most widely held value of the text is found."""
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.col("source"), F.col("lang")) if repository is None else repository
    rows, spans = scan(docs, owner, repository, ["doc_id"], text_or_empty())
    base = F.col("k") < len(KINDS)
    counts = {f"n_{n}": F.count_if(F.col("k") == i) for i, (n, *_) in enumerate(KINDS)}
    counts |= {"n_live": F.count_if(~F.col("__example")), "n_example": F.count_if("__example"), "n_owners": F.max("__owners"), "n_repositories": F.max("__repos")}
    told = spans.groupBy("__row").agg(*(c.alias(n) for n, c in counts.items()), _listed(base).alias("base"), _listed(base | ~F.col("__example")).alias("spans"))
    none = F.lit("")
    out = rows.join(told, "__row", "left")
    number = {n: F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in counts}
    names = [f"n_{n}" for n, *_ in KINDS]
    return out.select(
        "doc_id", *(number[n] for n in names), F.sha2(F.coalesce("base", none), 256).alias("base_sha256"), F.coalesce("spans", none).alias("spans"),
        *(number[n] for n in counts if n not in names),
    )


def mask_secrets(docs: DataFrame) -> DataFrame:
    """Documents with every reported span replaced by ``MASK``, touching ones each by their own (a pipeline stage)."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    print_of = F.xxhash64("text")
    rows, spans = scan(docs.withColumn("__print", print_of), F.col("source"), F.concat_ws("/", F.col("source"), F.col("lang")), ["doc_id", "__print"], text_or_empty())
    told = spans.where((F.col("k") < len(KINDS)) | ~F.col("__example"))
    # Overlapping spans are one: it ends where the last of them does.
    by_start = Window.partitionBy("__row").orderBy("s", "e")
    reached = F.max("e").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    told = told.withColumn("__new", F.coalesce(F.col("s") >= reached, F.lit(True)).cast("int"))
    told = told.withColumn("__island", F.sum("__new").over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = told.groupBy("__row", "__island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    merged = merged.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("__spans"))
    hits = rows.join(merged, "__row").groupBy(F.col("doc_id").alias("__doc"), F.col("__print").alias("__p")).agg(F.min("__spans").alias("__spans"))
    hits = materialize(hits)
    joined = docs.join(broadcast_if_small(hits), docs["doc_id"].eqNullSafe(hits["__doc"]) & (print_of == hits["__p"]), "left")
    text, spans_of = F.col("text"), F.col("__spans")
    before = lambda i: F.when(i > 0, F.get(spans_of, i - 1)["e"]).otherwise(0)
    pieces = F.transform(spans_of, lambda x, i: F.concat(F.substring(text, before(i) + 1, x["s"] - before(i)), F.lit(MASK)))
    cut = F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(spans_of, -1)["e"] + 1, F.length(text)))
    masked = F.when(spans_of.isNull(), text).otherwise(cut)
    # Two steps: beside an alias ``text`` the lambdas would take that for the column.
    joined = joined.select("doc_id", masked.alias("__masked"), "lang", "source")
    return joined.select("doc_id", F.col("__masked").alias("text"), "lang", "source", F.length("__masked").cast("long").alias("n_chars"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


_SQL_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+"""
_SQL_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?"""
OP1_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, lang, coalesce(text, '') AS t FROM documents),
x AS (
  SELECT rid, source, lang, kind, ord, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT d.*, 'assign' AS kind, 0 AS ord, regexp_extract_all(t, '{_SQL_ASSIGN}') AS ms, string_split_regex(t, '{_SQL_ASSIGN}') AS gs FROM d
    UNION ALL SELECT d.*, 'access', 1, regexp_extract_all(t, 'AKIA[A-Z0-9]+'), string_split_regex(t, 'AKIA[A-Z0-9]+') FROM d
    UNION ALL SELECT d.*, 'hex', 2, regexp_extract_all(t, '[0-9a-f]+'), string_split_regex(t, '[0-9a-f]+') FROM d
    UNION ALL SELECT d.*, 'live', 3, regexp_extract_all(t, '[A-Za-z0-9+/_=-]{{20,}}'), string_split_regex(t, '[A-Za-z0-9+/_=-]{{20,}}') FROM d)
), y AS (
  SELECT rid, source, lang, kind, ord, ms[i] AS m,
         sum(length(gs[i])) OVER w + sum(length(ms[i])) OVER w - length(ms[i]) AS s
  FROM x WINDOW w AS (PARTITION BY rid, kind ORDER BY i ROWS UNBOUNDED PRECEDING)
), z AS (
  SELECT *, s + length(m) AS e, CASE kind WHEN 'assign' THEN regexp_replace(m, '{_SQL_VALUE}', '') ELSE m END AS v FROM y
), b AS (
  SELECT * FROM z WHERE (kind = 'assign' AND length(v) >= 8) OR (kind = 'access' AND length(v) >= 16) OR (kind = 'hex' AND length(v) >= 32)
), c AS (
  SELECT * FROM b UNION ALL
  SELECT * FROM z WHERE kind = 'live' AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]')
     AND NOT EXISTS (SELECT 1 FROM b WHERE b.rid = z.rid AND b.s < z.e AND b.e > z.s)
), o AS (SELECT v, count(DISTINCT coalesce(source, chr(0))) AS owners, count(DISTINCT (source, concat_ws('/', source, lang))) AS repos FROM c GROUP BY v),
f AS (SELECT c.*, owners, repos, owners >= 3 OR repos >= 6 AS example FROM c JOIN o USING (v)),
a AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS na, count(*) FILTER (kind = 'access') AS nk, count(*) FILTER (kind = 'hex') AS nh,
         string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, ord) FILTER (kind <> 'live') AS base,
         string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, ord) FILTER (kind <> 'live' OR NOT example) AS spans,
         count(*) FILTER (NOT example) AS n_live, count(*) FILTER (example) AS n_example, max(owners) AS n_owners, max(repos) AS n_repositories
  FROM f GROUP BY rid
)
SELECT doc_id, coalesce(na, 0)::BIGINT AS n_assign, coalesce(nk, 0)::BIGINT AS n_access, coalesce(nh, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example,
       coalesce(n_owners, 0)::BIGINT AS n_owners, coalesce(n_repositories, 0)::BIGINT AS n_repositories
FROM d LEFT JOIN a USING (rid)
"""
