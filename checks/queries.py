"""Every operator as a query over the given tables, with its SQL where it has one."""

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from broadsheet.functions import keys, text, times
from broadsheet.functions.lexicon import DEFAULT_LEXICON, keyword_pattern
from broadsheet.operators import (
    dedup, filters, judge, merge, metrics, notes, ordering, pages, publish, relevance, resolve,
)
from broadsheet.plans import curation, jobs, listing
from broadsheet.schemas import API_RESPONSE, ARTICLE, ARTICLE_COLUMNS
from broadsheet.session import materialise, shared_dir
from broadsheet.sources import api, feeds, lists, store as stores
from broadsheet.sources.partitioned import PartitionedStore
from broadsheet.streaming.landing import stream_feeds, stream_landing
from checks import views as v
from checks.views import Tables, duck

RUN_AT = datetime(2024, 1, 20, 12, 0)
HOURS = 240.0
CUTOFF = "2024-01-10 12:00"
SITE = "site.example.org"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query given as a function of the tables."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = duck(sql)
        return build

    return register


NEWEST = "published_at DESC NULLS LAST, source ASC NULLS LAST, url"
ART_COLS = ", ".join(ARTICLE_COLUMNS)
TOPIC_TEXT = (
    "lower(concat(coalesce(title, ''), ' ', coalesce(description, ''), ' ', "
    "coalesce(source, ''), ' ', coalesce(author, '')))"
)


def _score_sql(lexicon) -> str:
    hits = [
        f"CASE WHEN regexp_matches(txt, '{keyword_pattern(k)}') THEN {w} ELSE 0.0 END"
        for k, w in lexicon
    ]
    return "cast(" + " + ".join(hits) + " AS double)"


def _scored_sql(articles: str, lexicon=None) -> str:
    """Articles with their score in place of the stored one."""
    return (
        f"SELECT * EXCLUDE (txt, relevance_score), {_score_sql(lexicon or v.LEXICON)} AS relevance_score "
        f"FROM (SELECT *, {TOPIC_TEXT} AS txt FROM ({articles}) a0) a1"
    )


def _slug_sql(title: str = "title", url: str = "url") -> str:
    base = f"trim(regexp_replace(lower(coalesce({title}, '')), '[^a-z0-9]+', '-', 'g'), '-')"
    return (
        f"CASE WHEN {base} = '' THEN left(sha1(coalesce({url}, '')), 8) "
        f"WHEN length({base}) > 60 THEN regexp_replace(left({base}, 60), '-[^-]*$', '') ELSE {base} END"
    )


def _escape_sql(c: str) -> str:
    return (
        f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), "
        f"'>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
    )


# --- keys and text -------------------------------------------------------------------------

@query("url_keys", """
SELECT page_id, lower(url) AS store_key, rtrim(lower(url), '/') AS exclusion_key,
  rtrim(split_part(lower(url), '#', 1), '/') AS removal_key,
  lower(split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '#', 1), '?', 1)) AS host
FROM {pages}""")
def _(t):
    return t["pages"].select(
        "page_id", keys.store_key("url").alias("store_key"),
        keys.exclusion_key("url").alias("exclusion_key"),
        keys.removal_key("url").alias("removal_key"), keys.host_of("url").alias("host"),
    )


@query("slug", f"SELECT url, {_slug_sql()} AS slug FROM ({v.ARTICLES}) a")
def _(t):
    return t.sql(v.ARTICLES).select("url", text.slug("title", "url").alias("slug"))


@query("html_escape", f"SELECT page_id, {_escape_sql('html')} AS escaped FROM {{pages}}")
def _(t):
    return t["pages"].select("page_id", text.html_escape("html").alias("escaped"))


@query("script_safe", "SELECT page_id, replace(html, '</', '<\\/') AS safe FROM {pages}")
def _(t):
    return t["pages"].select("page_id", text.script_safe("html").alias("safe"))


_STAMPS = """SELECT event_id, concat(strftime(ts, '%Y-%m-%dT%H:%M:%S'),
  CASE WHEN event_id % 3 = 0 THEN 'Z' WHEN event_id % 3 = 1 THEN '+02:00' ELSE '' END) AS iso FROM {events}"""


@query("iso_minute", f"""
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN concat(left(iso, 7), '-01 00:00') WHEN event_id % 11 = 1 THEN concat(left(iso, 4), '-01-01 00:00')
  WHEN event_id % 11 = 2 THEN NULL WHEN event_id % 11 = 3 THEN concat(left(iso, 10), ' 00:00')
  ELSE replace(left(iso, 16), 'T', ' ') END AS minute FROM ({_STAMPS}) s""")
def _(t):
    n = F.col("event_id")
    zone = F.when(n % 3 == 0, "Z").when(n % 3 == 1, "+02:00").otherwise("")
    stamps = t["events"].select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone).alias("iso"))
    written = (
        F.when(n % 11 == 0, F.left("iso", F.lit(7))).when(n % 11 == 1, F.left("iso", F.lit(4)))
        .when(n % 11 == 2, F.concat(F.left("iso", F.lit(16)), F.lit("garbage")))
        .when(n % 11 == 3, F.replace(F.left("iso", F.lit(10)), F.lit("-"), F.lit(""))).otherwise(F.col("iso"))
    )
    return stamps.select("event_id", times.iso_minute(written).alias("minute"))


@query("iso_minute_weeks", """
SELECT event_id, CASE WHEN event_id % 9 = 8 THEN NULL WHEN event_id % 9 IN (2, 7) THEN strftime(ts, '%Y-%m-%d 00:00')
  WHEN event_id % 9 = 3 THEN strftime(date_trunc('week', ts), '%Y-%m-%d 00:00') ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS minute
FROM {events}""")
def _(t):
    """Stamps written as days of a week or of a year, dashed, compact, without a clock, and as none of these."""
    n, week, day = F.col("event_id"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0"), (F.weekday("ts") + 1).cast("string")
    year, ordinal = F.expr("cast(extract(YEAROFWEEK FROM ts) AS string)"), F.concat(F.year("ts").cast("string"), F.lit("-"), F.lpad(F.dayofyear("ts").cast("string"), 3, "0"))
    dashed, compact, clock = F.concat(year, F.lit("-W"), week, F.lit("-"), day), F.concat(year, F.lit("W"), week, day), F.date_format("ts", "'T'HH:mm:ss")
    shapes = [
        F.concat(dashed, clock), F.concat(compact, clock, F.lit("+02:00")), dashed, F.concat(year, F.lit("-W"), week), F.concat(ordinal, clock),
        F.concat(F.replace(ordinal, F.lit("-"), F.lit("")), F.date_format("ts", "' 'HHmm")), F.concat(dashed, clock, F.lit("Z")), ordinal, F.concat(year, F.lit("-W54-1")),
    ]
    written = F.get(F.array(*shapes), (n % 9).cast("int"))
    return t["events"].select("event_id", times.iso_minute(written).alias("minute"))


@query("feed_minute", """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '2024-01-20 12:00'
  WHEN event_id % 4 = 1 THEN strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M')
  ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS minute
FROM {events}""")
def _(t):
    kind = F.col("event_id") % 4
    mail = F.date_format("ts", "d MMM yyyy HH:mm:ss")
    stamps = t["events"].select(
        "event_id",
        F.when(kind == 0, "some day soon").when(kind == 1, F.concat(mail, F.lit(" +0200")))
        .when(kind == 2, F.concat(mail, F.lit(" GMT"))).alias("published"),
        F.when(kind == 3, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("updated"),
    )
    return stamps.select("event_id", times.feed_minute("published", "updated", RUN_AT).alias("minute"))


# --- filters -------------------------------------------------------------------------------

_MARKED = f"""SELECT doc_id, CASE WHEN n % 17 = 0 THEN '[Removed]' WHEN n % 19 = 0 THEN NULL ELSE title END AS title,
  CASE WHEN n % 23 = 0 THEN 'REMOVED' ELSE source END AS source,
  CASE WHEN n % 29 = 0 THEN 'https://removed.com' ELSE url END AS url,
  CASE WHEN n % 31 = 0 THEN '1970-01-01T00:00:00Z' ELSE published_at END AS published_at
FROM (SELECT *, doc_id AS n FROM ({v.BATCH}) b) m"""


@query("drop_sentinels", f"""
SELECT doc_id, title FROM ({_MARKED}) m
WHERE coalesce(title <> '[Removed]', true) AND lower(source) <> 'removed'
  AND lower(url) <> 'https://removed.com' AND published_at <> '1970-01-01T00:00:00Z'""")
def _(t):
    return filters.drop_sentinels(t.sql(_MARKED)).select("doc_id", "title")


_LISTED = "https://SRC1.example.com/1, src2.example.com,, https://src3.example.com/3"


@query("exclude_exact", f"""
SELECT url FROM ({v.ARTICLES}) a
WHERE lower(url) NOT IN ('https://src1.example.com/1', 'src2.example.com', 'https://src3.example.com/3')""")
def _(t):
    return filters.exclude_exact(t.sql(v.ARTICLES), _LISTED).select("url")


@query("exclude_substring", f"""
SELECT url FROM ({v.ARTICLES}) a WHERE NOT contains(url, 'https://src1.example.com/1')
  AND NOT contains(url, 'src2.example.com') AND NOT contains(url, 'https://src3.example.com/3')""")
def _(t):
    return filters.exclude_substring(t.sql(v.ARTICLES), _LISTED).select("url")


_NAMED = f"""SELECT url, CASE WHEN category = 'de' THEN 'Fox News' WHEN category = 'es' THEN 'ESPN' ELSE source END AS source
FROM ({v.ARTICLES}) a"""


@query("exclude_sources", f"""
SELECT url, source FROM ({_NAMED}) a
WHERE coalesce(lower(source), '') <> 'fox news' AND NOT contains(coalesce(lower(source), ''), 'src11')
  AND NOT contains(url, 'src11')""")
def _(t):
    return filters.exclude_sources(t.sql(_NAMED), "fox-news, SRC11,").select("url", "source")


@query("apply_retention", f"""
SELECT {ART_COLS} FROM ({v.ARTICLES}) a
WHERE NOT coalesce(published_at < '{CUTOFF}' AND NOT manual_review, false)""")
def _(t):
    return filters.apply_retention(t.sql(v.ARTICLES), RUN_AT, HOURS).select(*ARTICLE_COLUMNS)


@query("recent", f"SELECT url, published_at FROM ({v.ARTICLES}) a WHERE published_at >= '{CUTOFF}'")
def _(t):
    return filters.recent(t.sql(v.ARTICLES), RUN_AT, HOURS).select("url", "published_at")


@query("by_category", f"SELECT url, title FROM ({v.ARTICLES}) a WHERE category = 'fr'")
def _(t):
    return filters.by_category(t.sql(v.ARTICLES), "fr").select("url", "title")


@query("by_url", f"SELECT {ART_COLS} FROM ({v.ARTICLES}) a WHERE url = 'https://src5.example.com/5'")
def _(t):
    return filters.by_url(t.sql(v.ARTICLES), "https://SRC5.example.com/5").select(*ARTICLE_COLUMNS)


# --- relevance -----------------------------------------------------------------------------

@query("relevance_score", f"SELECT url, relevance_score FROM ({_scored_sql(v.ARTICLES)}) s")
def _(t):
    return relevance.relevance_score(t.sql(v.ARTICLES, spread=True), v.LEXICON).select("url", "relevance_score")


@query("relevance_score_default", f"SELECT url, relevance_score FROM ({_scored_sql(v.ARTICLES, DEFAULT_LEXICON)}) s")
def _(t):
    return relevance.relevance_score(t.sql(v.ARTICLES, spread=True)).select("url", "relevance_score")


# A keyword in two tiers of one weight, one in two of different weight, a hundred phrases on one common word, one without a word character.
_TIERED = [
    *((k, w, f"t{w}") for k, w in v.LEXICON), ("the", 3.0, "again"), ("der", 0.5, "low"),
    *((f"the the{i}", 1.0, "phrases") for i in range(100)), ("the of", 1.0, "phrases"), ("of the", 1.0, "phrases"),
]
_TIERED_SQL = f"SELECT url, relevance_score FROM ({_scored_sql(v.ARTICLES, [(k, w) for k, w, _ in _TIERED])}) s"


def _twice(t) -> DataFrame:
    """Every article, and again without its url."""
    articles = t.sql(v.ARTICLES, spread=True)
    return articles.unionByName(articles.withColumn("url", F.lit(None).cast("string")))


@query("relevance_score_by_table", f"{_TIERED_SQL} UNION ALL SELECT NULL, relevance_score FROM ({_TIERED_SQL}) n")
def _(t):
    rows = [(k, tier, w) for k, w, tier in [*_TIERED, ("!!", 5.0, "none"), ("The", 3.0, "again")]]
    lexicon = t.spark.createDataFrame(rows, "keyword string, tier string, weight double")
    return relevance.score_by_table(_twice(t), lexicon).select("url", "relevance_score")


@query("relevance_score_tiers", f"{_TIERED_SQL} UNION ALL SELECT NULL, relevance_score FROM ({_TIERED_SQL}) n")
def _(t):
    lexicon = [*_TIERED, ("!!", 5.0, "none"), ("The", 3.0, "again")]
    return relevance.relevance_score(_twice(t), lexicon).select("url", "relevance_score")



@query("relevance_gate", f"""
SELECT url, title, relevance_score,
  row_number() OVER (ORDER BY relevance_score DESC, {NEWEST}) - 1 AS position
FROM ({_scored_sql(v.ARTICLES)}) s WHERE relevance_score >= 3""")
def _(t):
    kept = relevance.relevance_gate(t.sql(v.ARTICLES, spread=True), 3.0, v.LEXICON)
    slim = materialise(kept, "relevant").select("url", "title", "source", "published_at", "relevance_score")
    return ordering.positions(slim, ordering.most_relevant_first()).select(
        "url", "title", "relevance_score", "position"
    )


@query("keyword_frequency", "\nUNION ALL ".join(
    f"SELECT '{k}' AS keyword, count(*) AS articles FROM (SELECT {TOPIC_TEXT} AS txt FROM ({v.ARTICLES}) a0) a1 "
    f"WHERE regexp_matches(txt, '{keyword_pattern(k)}') HAVING count(*) > 0" for k, _ in v.LEXICON))
def _(t):
    return relevance.keyword_frequency(t.sql(v.ARTICLES, spread=True), v.LEXICON)


# --- dedup and store joins -----------------------------------------------------------------

_FIRST_SQL = f"""SELECT * EXCLUDE (nth) FROM (
  SELECT *, row_number() OVER (PARTITION BY lower(url) ORDER BY doc_id) AS nth FROM ({v.BATCH}) b) f WHERE nth = 1"""
_EXCL_KEYS = f"SELECT rtrim(lower(url), '/') FROM ({v.EXCLUSIONS}) e"
_ADDED_SQL = f"""SELECT lower(url) AS url, published_at, title, description, source, category, author,
  relevance_score, sentiment_score, manual_review FROM ({_FIRST_SQL}) f1
WHERE rtrim(lower(url), '/') NOT IN ({_EXCL_KEYS}) AND lower(url) NOT IN (SELECT url FROM ({v.STORE}) s)"""


@query("dedup_first", f"SELECT doc_id, url, title FROM ({_FIRST_SQL}) f1")
def _(t):
    return dedup.dedup_first(t.sql(v.BATCH), F.lower("url"), [F.col("doc_id")]).select("doc_id", "url", "title")


@query("not_excluded", f"""
SELECT doc_id, url FROM ({v.BATCH}) b WHERE rtrim(lower(url), '/') NOT IN ({_EXCL_KEYS})""")
def _(t):
    return merge.not_excluded(t.sql(v.BATCH), t.sql(v.EXCLUSIONS)).select("doc_id", "url")


@query("new_articles", _ADDED_SQL)
def _(t):
    return merge.new_articles(
        t.sql(v.STORE), t.sql(v.BATCH), t.sql(v.EXCLUSIONS), [F.col("doc_id")]
    ).select(*ARTICLE_COLUMNS)


@query("insert_absent", f"SELECT {ART_COLS} FROM ({v.STORE}) s UNION ALL {_ADDED_SQL}")
def _(t):
    return merge.insert_absent(
        t.sql(v.STORE), t.sql(v.BATCH), t.sql(v.EXCLUSIONS), [F.col("doc_id")]
    ).select(*ARTICLE_COLUMNS)


@query("allowed_only", """
SELECT doc_id FROM {documents} WHERE source IN (SELECT source FROM {documents} WHERE lang = 'de' GROUP BY source HAVING count(*) > 7)""")
def _(t):
    docs = t["documents"]
    often = docs.filter("lang = 'de'").groupBy("source").count().filter("count > 7")
    return merge.allowed_only(docs, often.select(F.col("source").alias("name"))).select("doc_id")


@query("with_pinned", f"""
WITH a AS ({v.ARTICLES}), kept AS (SELECT {ART_COLS} FROM a WHERE category = 'en')
SELECT url, manual_review FROM kept
UNION ALL SELECT url, manual_review FROM a WHERE manual_review AND url NOT IN (SELECT url FROM kept)""")
def _(t):
    articles = t.sql(v.ARTICLES)
    return merge.with_pinned(filters.by_category(articles, "en"), articles).select("url", "manual_review")


_TOXIC_URLS = f"SELECT rtrim(lower(url), '/') AS url FROM ({v.ARTICLE_EXCLUSIONS}) e"


@query("remove_keys", f"SELECT {ART_COLS} FROM ({v.ARTICLES}) a WHERE url NOT IN ({_TOXIC_URLS})")
def _(t):
    urls = t.sql(v.ARTICLE_EXCLUSIONS).select(keys.removal_key("url").alias("url"))
    return merge.remove_keys(t.sql(v.ARTICLES), urls).select(*ARTICLE_COLUMNS)


@query("removed_by_keys", f"SELECT url, title FROM ({v.ARTICLES}) a WHERE url IN ({_TOXIC_URLS})")
def _(t):
    urls = t.sql(v.ARTICLE_EXCLUSIONS).select(keys.removal_key("url").alias("url"))
    return merge.removed_by_keys(t.sql(v.ARTICLES), urls).select("url", "title")


@query("mark_reviewed", f"""
SELECT url, manual_review OR url IN ({_TOXIC_URLS}) AS manual_review FROM ({v.ARTICLES}) a""")
def _(t):
    urls = t.sql(v.ARTICLE_EXCLUSIONS).select(keys.removal_key("url").alias("url"))
    return merge.mark_reviewed(t.sql(v.ARTICLES), urls).select("url", "manual_review")


@query("merge_reviewed", f"""
SELECT {ART_COLS.replace('manual_review', "manual_review OR url IN (SELECT lower(url) FROM (" + _FIRST_SQL + ") f2) AS manual_review")}
FROM (SELECT {ART_COLS} FROM ({v.STORE}) s UNION ALL {_ADDED_SQL}) m""")
def _(t):
    staging = dedup.dedup_first(t.sql(v.BATCH), F.lower("url"), [F.col("doc_id")])
    staging = staging.withColumn("url", keys.store_key("url")).select(*ARTICLE_COLUMNS)
    return merge.merge_reviewed(t.sql(v.STORE), staging, t.sql(v.EXCLUSIONS)).select(*ARTICLE_COLUMNS)


_EXCL_LIST = f"SELECT rtrim(lower(url), '/') AS url, reason, excluded_at FROM ({v.EXCLUSIONS}) e"


@query("exclusions_from", """
SELECT url, reason, excluded_at FROM (
  SELECT rtrim(lower(url), '/') AS url, cast(page_id AS string) AS reason, '' AS excluded_at,
    row_number() OVER (PARTITION BY rtrim(lower(url), '/') ORDER BY page_id DESC) AS nth FROM {pages}) x
WHERE nth = 1 AND url <> ''""")
def _(t):
    rows = t["pages"].select(
        F.upper("url").alias("url"), F.col("page_id").cast("string").alias("reason"),
        F.lit(None).cast("string").alias("excluded_at"), "page_id",
    )
    return lists.exclusions_from(rows, [F.col("page_id").desc()])


@query("exclusion_file", f"SELECT * FROM ({_EXCL_LIST}) l")
def _(t):
    path = _fresh(t, "exclusions")
    lists.write_exclusions(t.sql(v.EXCLUSIONS), path)
    return lists.read_exclusions(t.spark, path)


@query("exclusion_file_multiline", f"""
SELECT url, concat('said "', coalesce(reason, ''), '",', chr(10), 'twice') AS reason, excluded_at FROM ({_EXCL_LIST}) l""")
def _(t):
    path = _fresh(t, "exclusions")
    told = F.concat(F.lit('said "'), F.coalesce("reason", F.lit("")), F.lit('",\ntwice'))
    listed = lists.exclusions_from(t.sql(v.EXCLUSIONS), [F.col("excluded_at")])
    lists.write_exclusions(listed.withColumn("reason", told).repartition(5), path)
    return lists.read_exclusions(t.spark, path)


@query("value_file", "SELECT url AS value FROM {pages}")
def _(t):
    path = _fresh(t, "values")
    t["pages"].select("page_id", "url").write.csv(path, header=True, escape='"')
    return lists.read_values(t.spark, path)


@query("add_exclusions", f"""
SELECT * FROM ({_EXCL_LIST}) l UNION ALL
SELECT DISTINCT lower(url), 'manual', '2024-01-20T12:00' FROM ({v.STORE}) s
WHERE lower(url) NOT IN (SELECT url FROM ({_EXCL_LIST}) l2)""")
def _(t):
    listed = lists.exclusions_from(t.sql(v.EXCLUSIONS), [F.col("excluded_at")])
    return merge.add_exclusions(listed, t.sql(v.STORE).select("url"), RUN_AT, "manual")


@query("drop_exclusions", f"""
SELECT * FROM ({_EXCL_LIST}) l WHERE url NOT IN (SELECT lower(url) FROM ({v.BATCH}) b WHERE category = 'en')""")
def _(t):
    listed = lists.exclusions_from(t.sql(v.EXCLUSIONS), [F.col("excluded_at")])
    return merge.drop_exclusions(listed, t.sql(v.BATCH).filter("category = 'en'").select("url"))


@query("is_excluded", f"""
SELECT doc_id, lower(url) IN ({_EXCL_KEYS}) AS excluded FROM ({v.BATCH}) b""")
def _(t):
    return merge.is_excluded(t.sql(v.BATCH), t.sql(v.EXCLUSIONS)).select("doc_id", "excluded")


# --- orders --------------------------------------------------------------------------------

@query("store_order", f"""
SELECT url, published_at, source, row_number() OVER (ORDER BY {NEWEST}) - 1 AS position
FROM ({v.ARTICLES}) a""")
def _(t):
    slim = t.sql(v.ARTICLES).select("url", "published_at", "source")
    return ordering.positions(slim, ordering.newest_first())


@query("top_articles", f"""
SELECT url, title, published_at, row_number() OVER (ORDER BY {NEWEST}) AS rank
FROM ({v.ARTICLES}) a QUALIFY rank <= 30""")
def _(t):
    return ordering.top_articles(t.sql(v.ARTICLES)).select("url", "title", "published_at", "rank")


@query("list_articles", f"""
SELECT url, relevance_score, row_number() OVER (ORDER BY relevance_score DESC, {NEWEST}) AS rank
FROM ({_scored_sql(v.ARTICLES)}) s WHERE relevance_score >= 1 AND published_at >= '{CUTOFF}' QUALIFY rank <= 100""")
def _(t):
    return listing.list_articles(
        t.sql(v.ARTICLES, spread=True), RUN_AT, HOURS, topic_only=True, limit=100, lexicon=v.LEXICON
    ).select("url", "relevance_score", "rank")


@query("unique_slugs", f"""
SELECT url, CASE WHEN nth = 1 THEN base ELSE concat(base, '-', cast(nth AS string)) END AS slug
FROM (SELECT url, base, row_number() OVER (PARTITION BY base ORDER BY {NEWEST}) AS nth
      FROM (SELECT *, {_slug_sql()} AS base FROM ({v.ARTICLES}) a) b) c""")
def _(t):
    slim = t.sql(v.ARTICLES, spread=True).select("url", "title", "published_at", "source")
    return publish.unique_slugs(slim).select("url", "slug")


# --- judge ---------------------------------------------------------------------------------

_BATCHES_SQL = f"""SELECT url, title, description, pos // 16 AS batch_id, pos % 16 AS idx FROM (
  SELECT *, row_number() OVER (ORDER BY relevance_score DESC, {NEWEST}) - 1 AS pos
  FROM ({_scored_sql(v.ARTICLES)}) s WHERE relevance_score >= 1) p"""


def _batches(t):
    relevant = relevance.relevance_gate(t.sql(v.ARTICLES, spread=True), 1.0, v.LEXICON)
    return judge.judge_batches(materialise(relevant, "relevant"), 16)


@query("judge_batches", f"SELECT url, batch_id, idx FROM ({_BATCHES_SQL}) b")
def _(t):
    return _batches(t).select("url", "batch_id", "idx")


@query("judge_prompts", f"""
SELECT batch_id, cast(count(*) AS int) AS expected_count,
  concat('Score the following articles:', chr(10), chr(10), string_agg(concat(cast(idx AS string), '. Title: ',
    coalesce(title, ''), chr(10), '   Description: ', coalesce(description, '')), chr(10) ORDER BY idx)) AS prompt
FROM ({_BATCHES_SQL}) b GROUP BY batch_id""")
def _(t):
    return judge.judge_prompts(_batches(t))


@query("score_with", f"""
SELECT batch_id, idx, url, cast(length(title) % 5 - 2 AS double) AS score, cast(NULL AS string) AS error
FROM ({_BATCHES_SQL}) b""")
def _(t):
    return judge.score_with(_batches(t), lambda batch: batch["title"].str.len() % 5 - 2)


_STATUS_SQL = """SELECT batch_id, CASE WHEN shape <= 3 THEN 'ok' WHEN shape = 4 THEN 'not_an_array'
  WHEN shape = 5 THEN 'unparsable' WHEN shape = 6 THEN 'missing_scores' ELSE 'malformed_entry' END AS status,
  cast(CASE WHEN shape <= 3 OR shape = 7 THEN 0 WHEN shape = 6 THEN 1 ELSE 2 END AS bigint) AS missing
FROM (SELECT doc_id AS batch_id, doc_id % 8 AS shape FROM {labels}) r"""


@query("score_opened", ORACLES["score_with"])
def _(t):
    def open_scorer():
        import pandas as pd

        return lambda batch: pd.Series(batch["title"]).str.len() % 5 - 2

    return judge.score_opened(_batches(t), open_scorer)


@query("judge_batch_status", _STATUS_SQL)
def _(t):
    return judge.judge_batch_status(t.sql(v.REPLIES)).select("batch_id", "status", "missing")


@query("parse_judge_replies", """
SELECT doc_id AS batch_id, i AS idx, CASE WHEN i = 0 THEN quality + 0.75 ELSE -0.5 END::double AS score
FROM {labels} CROSS JOIN (SELECT unnest([0, 1])::bigint AS i) x WHERE doc_id % 8 <= 3""")
def _(t):
    return judge.parse_judge_replies(t.sql(v.REPLIES))


_LOCAL = f"SELECT url, score FROM ({v.SCORES}) s0 WHERE target = 'local'"
_JUDGED_SQL = f"""SELECT a.* EXCLUDE (sentiment_score), score AS sentiment_score
FROM ({_scored_sql(v.ARTICLES)}) a LEFT JOIN ({_LOCAL}) l USING (url)"""


def _local(t):
    return t.sql(v.SCORES).filter("target = 'local'").select("url", "score")


@query("attach_scores", f"SELECT url, sentiment_score FROM ({_JUDGED_SQL}) j")
def _(t):
    return judge.attach_scores(t.sql(v.ARTICLES), _local(t)).select("url", "sentiment_score")


@query("sentiment_gate", f"SELECT url, sentiment_score FROM ({_JUDGED_SQL}) j WHERE sentiment_score <= 0")
def _(t):
    judged = judge.attach_scores(t.sql(v.ARTICLES), _local(t))
    return judge.sentiment_gate(judged).select("url", "sentiment_score")


@query("label_gate", f"""
SELECT url, CASE WHEN sentiment_score <= 0 THEN 'keep' ELSE 'drop' END AS verdict FROM ({_JUDGED_SQL}) j""")
def _(t):
    judged = judge.attach_scores(t.sql(v.ARTICLES), _local(t))
    return judge.label_gate(judged).select("url", "verdict")


@query("judge_listing", f"""
SELECT url, sentiment_score, CASE WHEN sentiment_score <= 0 THEN 'keep' ELSE 'drop' END AS verdict
FROM ({_JUDGED_SQL}) j WHERE relevance_score >= 1 AND published_at >= '{CUTOFF}' AND sentiment_score IS NOT NULL""")
def _(t):
    return listing.judge_listing(
        t.sql(v.ARTICLES, spread=True), _local(t), RUN_AT, HOURS, lexicon=v.LEXICON
    ).select("url", "sentiment_score", "verdict")


_COMPARE_SQL = f"""SELECT a.url, a.title, l.score AS local_score, r.score AS remote_score,
  l.score - r.score AS delta, (l.score <= 0) = (r.score <= 0) AS agree
FROM ({_scored_sql(v.ARTICLES)}) a JOIN ({v.SCORES}) l ON l.url = a.url AND l.target = 'local'
JOIN ({v.SCORES}) r ON r.url = a.url AND r.target = 'remote'
WHERE relevance_score >= 1 AND published_at >= '{CUTOFF}'"""


@query("compare_judges", f"""
SELECT url, title, local_score, remote_score, round(delta, 6) AS delta, agree FROM ({_COMPARE_SQL}) c""")
def _(t):
    rows, _s = listing.compare(t.sql(v.ARTICLES, spread=True), t.sql(v.SCORES), RUN_AT, HOURS, lexicon=v.LEXICON)
    return rows.withColumn("delta", F.round("delta", 6))


@query("compare_summary", f"""
SELECT count(*) AS articles, round(avg(abs(delta)), 6) AS mean_abs_delta,
  count(*) FILTER (NOT agree) AS disagreements FROM ({_COMPARE_SQL}) c""")
def _(t):
    _r, summary = listing.compare(t.sql(v.ARTICLES, spread=True), t.sql(v.SCORES), RUN_AT, HOURS, lexicon=v.LEXICON)
    return summary.withColumn("mean_abs_delta", F.round("mean_abs_delta", 6))


_ASKED_SQL = f"SELECT url FROM ({_scored_sql(v.ARTICLES)}) a WHERE relevance_score >= 1 AND published_at >= '{CUTOFF}'"


@query("compare_targets", f"SELECT url, 0.5::double AS local_score, -0.5::double AS remote_score, FALSE AS agree FROM ({_ASKED_SQL}) a")
def _(t):
    both = t.sql(v.ARTICLES).select("url", F.explode(F.array(*[
        F.struct(F.lit(target).alias("target"), F.lit(score).alias("score")) for target, score in (("local", 0.5), ("remote", -0.5))
    ])).alias("s")).select("s.target", "url", "s.score")
    cfg = jobs.Settings(lexicon=v.LEXICON)
    compared, _summary = jobs.compare_targets(t.sql(v.ARTICLES, spread=True), both, RUN_AT, HOURS, cfg=cfg)
    return compared.select("url", "local_score", "remote_score", "agree")


@query("compare_targets_incomplete", f"""
SELECT count(*) = (SELECT count(*) FROM ({v.SCORES}) s JOIN ({_ASKED_SQL}) a2 ON a2.url = s.url WHERE target = 'remote') AS complete FROM ({_ASKED_SQL}) a""")
def _(t):
    found = jobs.compare_targets(t.sql(v.ARTICLES, spread=True), t.sql(v.SCORES), RUN_AT, HOURS, cfg=jobs.Settings(lexicon=v.LEXICON))
    return t.spark.range(1).select(F.lit(found is not None).alias("complete"))


# --- the whole plan ------------------------------------------------------------------------

_CURATED_SQL = f"""
WITH j AS ({_JUDGED_SQL}), a AS ({v.ARTICLES}),
  kept AS (SELECT {ART_COLS} FROM j WHERE relevance_score >= 3 AND sentiment_score <= 0),
  both_sides AS (SELECT {ART_COLS} FROM kept UNION ALL
    SELECT {ART_COLS} FROM a WHERE manual_review AND url NOT IN (SELECT url FROM kept))
SELECT url, title, relevance_score, sentiment_score, manual_review FROM both_sides
WHERE url NOT IN (SELECT rtrim(lower(url), '/') FROM ({v.ARTICLE_EXCLUSIONS}) e)"""


@query("curated_articles", _CURATED_SQL)
def _(t):
    return curation.curated_articles(
        t.sql(v.ARTICLES, spread=True), _local(t), t.sql(v.ARTICLE_EXCLUSIONS), 3.0, 0.0, v.LEXICON
    ).select("url", "title", "relevance_score", "sentiment_score", "manual_review")


@query("refreshed_store", f"""
SELECT {ART_COLS} FROM ({v.STORE}) s WHERE NOT coalesce(published_at < '{CUTOFF}' AND NOT manual_review, false)
UNION ALL SELECT {ART_COLS} FROM (
  SELECT lower(url) AS url, published_at, title, description, source, category, author,
    relevance_score, sentiment_score, manual_review FROM ({_FIRST_SQL}) f1
  WHERE rtrim(lower(url), '/') NOT IN ({_EXCL_KEYS})) n
WHERE url NOT IN (SELECT url FROM ({v.STORE}) s WHERE NOT coalesce(published_at < '{CUTOFF}' AND NOT manual_review, false))""")
def _(t):
    return curation.refreshed_store(
        t.sql(v.STORE), t.sql(v.BATCH), t.sql(v.EXCLUSIONS), ["doc_id"], RUN_AT, HOURS
    ).select(*ARTICLE_COLUMNS)


@query("run_metrics", f"""
WITH s AS ({_scored_sql(v.ARTICLES)})
SELECT 'stored' AS stage, category, count(*) AS articles FROM s GROUP BY category
UNION ALL SELECT 'relevant', category, count(*) FROM s WHERE relevance_score >= 1 GROUP BY category
UNION ALL SELECT 'expired', category, count(*) FROM s WHERE published_at < '{CUTOFF}' AND NOT manual_review GROUP BY category""")
def _(t):
    articles = t.sql(v.ARTICLES, spread=True)
    return metrics.run_metrics({
        "stored": articles,
        "relevant": relevance.relevance_gate(articles, 1.0, v.LEXICON),
        "expired": filters.expired(articles, RUN_AT, HOURS),
    })


@query("stage_metrics", ORACLES["run_metrics"])
def _(t):
    scored = relevance.relevance_score(t.sql(v.ARTICLES, spread=True), v.LEXICON)
    return metrics.stage_metrics(scored, {
        "stored": F.lit(True),
        "relevant": F.col("relevance_score") >= 1.0,
        "expired": (F.col("published_at") < CUTOFF) & ~F.col("manual_review"),
    })


# --- landing -------------------------------------------------------------------------------

def _responses(t) -> DataFrame:
    """Each document as a page of an API answer with one article, in the ways these come."""
    doc = t.sql(v.BATCH, spread=True)
    n = F.col("doc_id")
    zone = F.when(n % 3 == 0, "Z").otherwise("+02:00")
    published = F.when(n % 37 == 0, "some day").otherwise(
        F.concat(F.replace("published_at", F.lit(" "), F.lit("T")), F.lit(":00"), zone)
    )
    named = F.struct(F.lit(None).cast("string").alias("id"), F.col("source").alias("name"))
    title = F.when(n % 17 == 0, "[Removed]").otherwise(F.col("title"))
    fields = [title.alias("title"), F.nullif("description", F.lit("")).alias("description"), "url", published.alias("publishedAt")]
    plain = F.to_json(F.struct("source", *fields))  # no author key
    full = F.to_json(
        F.struct(named.alias("source"), "author", *fields, F.lit("x").alias("content")),
        {"ignoreNullFields": "false"},
    )
    item = F.when(F.col("category") == "fr", plain).otherwise(full)
    state = F.when(n % 29 == 0, "error").otherwise("ok")
    order = F.when(F.col("category") == "en", 0).when(F.col("category") == "de", 1).otherwise(2)
    return doc.select(
        "category", order.alias("category_ord"), n.cast("int").alias("page"),
        F.when(n % 31 == 0, 500).otherwise(200).alias("status_code"),
        F.concat(F.lit('{"status":"'), state, F.lit('","totalResults":1,"articles":['), item, F.lit("]}")).alias("body"),
    )


# What _responses sends in good answers: pages whose status or HTTP status is an error hold nothing.
_SIGHTED = f"""SELECT doc_id, category, CASE WHEN category = 'en' THEN 0 WHEN category = 'de' THEN 1 ELSE 2 END AS category_ord,
  lower(url) AS url, CASE WHEN doc_id % 17 = 0 THEN '[Removed]' ELSE title END AS title,
  nullif(description, '') AS description, source,
  CASE WHEN category = 'fr' THEN 'Unknown Author' ELSE author END AS author,
  CASE WHEN doc_id % 37 <> 0 THEN published_at END AS published_at
FROM ({v.BATCH}) b WHERE doc_id % 29 <> 0 AND doc_id % 31 <> 0"""

_ALLOWED = "SELECT DISTINCT source FROM {documents} WHERE length(source) = 5"

_API_SQL = f"""SELECT url, published_at, title, coalesce(description, 'No description available.') AS description,
  source, category, author
FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY category_ord, doc_id) AS nth FROM ({_SIGHTED}) s) f
WHERE nth = 1 AND title <> '[Removed]' AND published_at IS NOT NULL AND source IN ({_ALLOWED})
  AND NOT contains(source, 'src11') AND NOT contains(url, 'src11')"""


def _allowed(t):
    return t.sql(f"SELECT source AS name FROM ({_ALLOWED}) a")


def _api(t):
    return api.api_articles(api.read_api_landing(_responses(t)), _allowed(t), "nowhere.com", "src11")


@query("read_api_landing", f"""
SELECT doc_id AS page, category, url, title, description, source,
  CASE WHEN category <> 'fr' THEN author END AS author, category <> 'fr' AS has_author FROM ({_SIGHTED}) s""")
def _(t):
    return api.read_api_landing(_responses(t)).select(
        F.col("page").cast("bigint").alias("page"), "category", "url", "title", "description",
        "source", "author", "has_author",
    )


@query("api_articles", _API_SQL)
def _(t):
    return _api(t).drop(*api.SIGHTING_ORDER)


@query("api_rejects", f"SELECT url, title, 'published_at' AS reason FROM ({_SIGHTED}) s WHERE published_at IS NULL")
def _(t):
    return api.api_rejects(api.read_api_landing(_responses(t))).select("url", "title", "reason")


@query("allowed_sources", "SELECT DISTINCT source AS name FROM {documents}")
def _(t):
    item = F.to_json(F.struct(F.col("source").alias("id"), F.col("source").alias("name")))
    bodies = t["documents"].select(
        F.concat(F.lit('{"status":"ok","sources":['), item, F.lit("]}")).alias("body")
    )
    return api.allowed_sources(bodies)


_FEED_TITLE = "trim(title, concat(' ', chr(10), chr(9)))"


def _feed_documents(t) -> DataFrame:
    """Each document as a feed of one entry: RSS or, for German, Atom; some failed or broken."""
    doc = t.sql(v.BATCH, spread=True)
    n = F.col("doc_id")
    when = F.to_timestamp("published_at", "yyyy-MM-dd HH:mm")
    escaped = {c: text.html_escape(c) for c in ("title", "url", "source")}

    def tag(name, value):
        return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))

    author = F.when(F.col("category") == "es", tag("dc:creator", F.lit("desk"))).otherwise("")
    pub = F.when(n % 5 == 0, "").otherwise(
        tag("pubDate", F.concat(F.date_format(when, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0200")))
    )
    rss = F.concat(
        F.lit('<?xml version="1.0"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel>'),
        tag("title", escaped["source"]), F.lit("<item>"), tag("title", escaped["title"]),
        tag("link", escaped["url"]), author, pub, F.lit("</item></channel></rss>"),
    )
    atom = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), tag("title", escaped["source"]), F.lit("<entry>"),
        tag("title", escaped["title"]), F.lit('<link rel="alternate" href="'), escaped["url"], F.lit('"/>'),
        tag("author", tag("name", F.lit("desk"))), tag("summary", F.lit("in short")),
        tag("updated", F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.lit("</entry></feed>"),
    )
    body = F.when(n % 43 == 0, "<rss><channel>").when(F.col("category") == "de", atom).otherwise(rss)
    return doc.select(
        "url", n.cast("int").alias("feed_ord"), F.when(n % 31 == 0, 404).otherwise(200).alias("status_code"),
        body.alias("body"),
    ).withColumnRenamed("url", "feed_url")


_FEED_SQL = f"""SELECT url, CASE WHEN category = 'de' THEN published_at WHEN doc_id % 5 = 0 THEN '2024-01-20 12:00'
    ELSE strftime(strptime(published_at, '%Y-%m-%d %H:%M') - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M') END AS published_at,
  coalesce(nullif({_FEED_TITLE}, ''), 'No title') AS title,
  CASE WHEN category = 'de' THEN 'in short' ELSE 'No description available.' END AS description, source,
  'politics' AS category, CASE WHEN category IN ('de', 'es') THEN 'desk' ELSE 'RSS Feed' END AS author
FROM (SELECT *, row_number() OVER (PARTITION BY lower(url) ORDER BY doc_id) AS nth FROM ({v.BATCH}) b
  WHERE doc_id % 31 <> 0 AND doc_id % 43 <> 0 AND NOT contains(lower(url), '/ab')) f WHERE nth = 1"""


def _feeds(t):
    return feeds.feed_articles(feeds.read_feed_landing(_feed_documents(t)), RUN_AT, "/AB,")


@query("read_feed_landing", f"""
SELECT doc_id AS feed_ord, url, source, nullif({_FEED_TITLE}, '') AS title,
  CASE WHEN category IN ('de', 'es') THEN 'desk' END AS author
FROM ({v.BATCH}) b WHERE doc_id % 31 <> 0 AND doc_id % 43 <> 0""")
def _(t):
    return feeds.read_feed_landing(_feed_documents(t)).select(
        F.col("feed_ord").cast("bigint").alias("feed_ord"), "url", "source", "title", "author"
    )


@query("feed_articles", _FEED_SQL)
def _(t):
    return _feeds(t).drop(*feeds.SIGHTING_ORDER)


@query("land_all", f"""
WITH api AS ({_API_SQL}), feed AS ({_FEED_SQL})
SELECT url, published_at, title, description, source, category, author FROM api
UNION ALL SELECT lower(url), published_at, title, description, source, category, author FROM feed
WHERE lower(url) NOT IN (SELECT url FROM api)""")
def _(t):
    batch = feeds.land_all(_api(t), _feeds(t))
    empty = t.spark.createDataFrame([], ARTICLE)
    none = t.spark.createDataFrame([], "url string")
    return merge.new_articles(
        empty, batch, none, [F.col(c) for c in feeds.LANDING_ORDER]
    ).drop(*feeds.LANDING_ORDER)


def _broken_feeds(t) -> DataFrame:
    """Each document as a feed that is no well-formed XML, in one of four ways, or whose items have no link element."""
    doc = t.sql(v.BATCH, spread=True)
    n = F.col("doc_id")
    title, url, source = (text.html_escape(c) for c in ("title", "url", "source"))
    day = F.date_format(F.to_timestamp("published_at", "yyyy-MM-dd HH:mm"), "yyyy-MM-dd'T'HH:mm:ss'Z'")

    def rss(*items):
        return F.concat(F.lit("<rss><channel><image><title>logo</title></image><title>"), source, F.lit("</title>"), *[F.lit(i) if isinstance(i, str) else i for i in items])

    entities = rss("<item><title>&eacute;&nbsp;", title, "&euro; &#x2013; &unknown;</title><link>", F.col("url"), "?a=1&b=2</link><pubDate>", day, "</pubDate></item></channel></rss>")
    cut = rss("<item><title>", title, "</title><link>", url, "</link><pubDate>", day, "</pubDate></item><item><title>cut</title><link>", url, "/cut</link><description>in the mid")
    guids = rss("<item><title>g</title><guid>", url, '</guid></item><item><title>h</title><guid isPermaLink="true">', url, '/h</guid></item><item><title>i</title><guid isPermaLink="false">', url, "/i</guid></item></channel></rss>")
    mixed = rss("<item><title><![CDATA[x </item> & ", F.col("title"), "]]></title><link>", url, "</link><description>a <b>b<br> c</description><dc:creator>desk</dc:creator><!-- <link>no</link> --></item></channel>")
    atom = F.concat(
        F.lit("<feed><title>"), source, F.lit("</title><entry><link rel=self href=https://self.example.com/ ><link rel='alternate' title=\"a > b\" href="), url,
        F.lit("><title>"), title, F.lit("</title><author><name>desk</name></author><updated>"), day, F.lit("</updated><content type=html>&lt;p&gt;in full</content></entry>"),
    )
    body = F.when(n % 5 == 0, entities).when(n % 5 == 1, cut).when(n % 5 == 2, guids).when(n % 5 == 3, mixed).otherwise(atom)
    return doc.select(F.col("url").alias("feed_url"), n.cast("int").alias("feed_ord"), F.lit(200).alias("status_code"), body.alias("body"))


_STRIPPED = r"regexp_replace(title, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g')"
_BROKEN = rf"""SELECT * FROM (
SELECT doc_id, 0 AS pos, published_at AS day, source,
  CASE doc_id % 5 WHEN 0 THEN concat(url, '?a=1&b=2') ELSE url END AS url,
  CASE doc_id % 5 WHEN 0 THEN concat('é', chr(160), title, '€ – &unknown;') WHEN 2 THEN 'g' WHEN 3 THEN concat('x </item> & ', regexp_replace(title, '[\s\x{{A0}}]+$', '')) ELSE nullif({_STRIPPED}, '') END AS title,
  CASE doc_id % 5 WHEN 3 THEN 'a <b>b<br> c' END AS description, CASE doc_id % 5 WHEN 4 THEN '<p>in full' END AS summary,
  CASE WHEN doc_id % 5 > 2 THEN 'desk' END AS author, doc_id % 5 IN (0, 1, 4) AS dated
FROM ({v.BATCH}) b
UNION ALL SELECT doc_id, 1, published_at, source, concat(url, '/cut'), 'cut', NULL, NULL, NULL, FALSE FROM ({v.BATCH}) b WHERE doc_id % 5 = 1
UNION ALL SELECT doc_id, 1, published_at, source, concat(url, '/h'), 'h', NULL, NULL, NULL, FALSE FROM ({v.BATCH}) b WHERE doc_id % 5 = 2
UNION ALL SELECT doc_id, 2, published_at, source, NULL, 'i', NULL, NULL, NULL, FALSE FROM ({v.BATCH}) b WHERE doc_id % 5 = 2) x"""


@query("read_broken_feeds", f"SELECT doc_id AS feed_ord, pos, source, url, title, description, summary, author FROM ({_BROKEN}) f")
def _(t):
    return feeds.read_feed_landing(_broken_feeds(t)).select(
        F.col("feed_ord").cast("bigint").alias("feed_ord"), "pos", "source", "url", "title", "description", "summary", "author"
    )


@query("broken_feed_articles", f"""
SELECT url, CASE WHEN dated THEN day ELSE '2024-01-20 12:00' END AS published_at, coalesce(title, 'No title') AS title,
  coalesce(description, summary, 'No description available.') AS description, source, 'politics' AS category, coalesce(author, 'RSS Feed') AS author
FROM (SELECT *, row_number() OVER (PARTITION BY lower(url) ORDER BY doc_id, pos) AS nth FROM ({_BROKEN}) g WHERE url IS NOT NULL AND NOT contains(lower(url), '/ab')) f
WHERE nth = 1""")
def _(t):
    return feeds.feed_articles(feeds.read_feed_landing(_broken_feeds(t)), RUN_AT, "/AB,").drop(*feeds.SIGHTING_ORDER)


# --- pages and notes -----------------------------------------------------------------------

_TITLE_SQL = (
    "trim(replace(replace(replace(replace(regexp_extract(html, '(?i)<title[^>]*>(.*?)</title>', 1), "
    "'&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'))"
)


@query("extract_page_metadata", f"""
SELECT page_id, {_TITLE_SQL} AS title, cast(NULL AS string) AS description, cast(NULL AS string) AS published_at
FROM {{pages}}""")
def _(t):
    return pages.extract_page_metadata(t["pages"]).select("page_id", "title", "description", "published_at")


# Pages with the tags these lack; urls repeat, some are stored or excluded already.
_FETCHED = """SELECT page_id,
  CASE WHEN page_id % 6 = 0 THEN 'https://press.example.org/same' ELSE url END AS url,
  CASE WHEN page_id % 9 = 0 THEN NULL WHEN page_id % 4 = 0 THEN html
       ELSE concat('<meta content=''On page ', cast(page_id AS string), ''' property="og:description">',
                   '<meta property="article:published_time" content="2024-01-05T10:00:00Z">', html) END AS html
FROM {pages}"""
_STORED_PAGES = "SELECT lower(url) AS url FROM {pages} WHERE contains(url, '.org/en')"
_BARRED_PAGES = "SELECT upper(url) AS url FROM {pages} WHERE contains(url, '.net/de')"
_INGEST_SQL = f"""
SELECT page_id, url, CASE WHEN html IS NULL THEN 'fetch_failed' WHEN page_id % 4 = 0 THEN 'missing_fields'
  WHEN page_id IN (SELECT page_id FROM (SELECT page_id, lower(url) AS k, row_number() OVER (PARTITION BY lower(url) ORDER BY page_id) AS nth
      FROM ({_FETCHED}) f WHERE html IS NOT NULL AND page_id % 4 <> 0) w WHERE nth = 1
      AND k NOT IN ({_STORED_PAGES}) AND rtrim(k, '/') NOT IN (SELECT rtrim(lower(url), '/') FROM ({_BARRED_PAGES}) x))
  THEN 'inserted' ELSE 'duplicate' END AS status
FROM ({_FETCHED}) p"""


def _classified(t):
    stored = t.sql(_STORED_PAGES)
    return pages.classify_ingest(t.sql(_FETCHED), stored, t.sql(_BARRED_PAGES))


@query("extract_tagged_pages", f"""
SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN concat('On page ', cast(page_id AS string)) END AS description,
  CASE WHEN page_id % 4 <> 0 THEN '2024-01-05' END AS day
FROM ({_FETCHED}) f WHERE html IS NOT NULL""")
def _(t):
    found = pages.extract_page_metadata(t.sql(_FETCHED).filter("html IS NOT NULL"))
    return found.select("page_id", "description", F.left("published_at", F.lit(10)).alias("day"))


# Pages whose metadata stand in attributes with brackets and quotes, in linked data, or where a page's own do not.
_MARKED_PAGES = """SELECT page_id, concat(CASE page_id % 5
  WHEN 0 THEN concat('<meta property="og:title" content="Page ', cast(page_id AS string), ' > all &amp; more"><meta content="by property=''og:title''" name="description">',
    '<meta property=article:published_time content=2024-03-0', cast(1 + page_id % 9 AS string), 'T10:00>')
  WHEN 1 THEN concat('<script type="application/ld+json">{"@context": "https://schema.org", "@graph": [{"@type": "Organization", "name": "Press"}, ',
    '{"@type": ["NewsArticle", "Thing"], "headline": "Story &quot;', cast(page_id AS string), '&quot;", "description": "told > twice", "datePublished": "2024-04-0', cast(1 + page_id % 9 AS string), '"}]}</script>')
  WHEN 2 THEN concat('<script>{"@type": "NewsArticle", "headline": "no"}</script><SCRIPT data-x="a>b" TYPE=''application/ld+json''>',
    '[{"@type": "WebPage", "name": "page"}, {"@type": "WebPage", "mainEntity": {"@type": "http://schema.org/Article", "headline": "Inner ', cast(page_id AS string), '", "dateCreated": "2024-05-01T00:00:00Z"}}]</SCRIPT>')
  WHEN 3 THEN concat('<script type="application/ld+json">{"headline": "cut off</script><!-- <meta property="og:title" content="no"> -->',
    '<script>var m = ''<meta property="og:title" content="no">'';</script><svg><title>icon</title></svg><time datetime="soon"><time class="x > y" datetime="2024-06-0', cast(1 + page_id % 9 AS string), '">')
  ELSE concat('<meta name="twitter:title" content=''Second "best" ', cast(page_id AS string), '''><meta name=date content=soon><meta itemprop=datePublished content="2024-07-01">',
    '<script type="application/ld+json">{"@type": "BreadcrumbList", "name": "crumbs"}</script>') END, html) AS html
FROM {pages}"""


@query("extract_marked_pages", f"""
SELECT page_id, CASE page_id % 5 WHEN 0 THEN concat('Page ', cast(page_id AS string), ' > all & more') WHEN 1 THEN concat('Story "', cast(page_id AS string), '"')
    WHEN 2 THEN concat('Inner ', cast(page_id AS string)) WHEN 3 THEN {_TITLE_SQL} ELSE concat('Second "best" ', cast(page_id AS string)) END AS title,
  CASE page_id % 5 WHEN 0 THEN 'by property=''og:title''' WHEN 1 THEN 'told > twice' END AS description,
  CASE page_id % 5 WHEN 0 THEN concat('2024-03-0', 1 + page_id % 9) WHEN 1 THEN concat('2024-04-0', 1 + page_id % 9) WHEN 2 THEN '2024-05-01'
    WHEN 3 THEN concat('2024-06-0', 1 + page_id % 9) ELSE '2024-07-01' END AS published_at
FROM {{pages}}""")
def _(t):
    return pages.extract_page_metadata(t.sql(_MARKED_PAGES)).select("page_id", "title", "description", "published_at")


@query("classify_ingest", f"""
SELECT page_id, url, status, CASE WHEN status = 'missing_fields' THEN 'description, published_at'
  WHEN status = 'inserted' THEN (SELECT {_TITLE_SQL} FROM {{pages}} q WHERE q.page_id = i.page_id) END AS detail
FROM ({_INGEST_SQL}) i""")
def _(t):
    return _classified(t).select("page_id", "url", "status", "detail")


@query("ingest_summary", f"""
SELECT s.status, count(i.status) AS pages
FROM (SELECT unnest(['inserted', 'duplicate', 'fetch_failed', 'missing_fields']) AS status) s
LEFT JOIN ({_INGEST_SQL}) i USING (status) GROUP BY s.status""")
def _(t):
    return pages.ingest_summary(_classified(t))


_MATCHING = f"""SELECT * FROM ({v.NOTES}) n WHERE trashed = 0 AND deleted = 0
  AND (contains(lower(tagLinks), 'press') OR contains(lower(title), 'utm_source') OR contains(lower(text), 'utm_source'))"""
_HOSTS = ("ththre.example.com", "m.ththth.example.net")
_NOTE_URL = """CASE WHEN id::bigint % 5 <> 0 THEN rtrim(split_part(text, chr(10), 3), '.,)') END"""
_RESOLVED_SQL = f"""SELECT id, title, ltrim({_NOTE_URL}) AS url,
  regexp_extract(html, 'href="(https?://[^"]+)"', 1) AS first_link FROM ({_MATCHING}) m"""
_OUTCOME = f"""CASE WHEN url IS NULL THEN 'unresolved'
  WHEN lower(split_part(split_part(split_part(url, '://', 2), '/', 1), '#', 1)) IN {_HOSTS} THEN 'excluded' ELSE 'candidate' END"""


def _resolved(t):
    return notes.resolve_notes(notes.matching_notes(t.sql(v.NOTES), "PRESS", "utm_source"), _HOSTS)


@query("matching_notes", f"SELECT id, title FROM ({_MATCHING}) m")
def _(t):
    return notes.matching_notes(t.sql(v.NOTES), "PRESS", "utm_source").select("id", "title")


@query("resolve_notes", f"""
SELECT id, url, {_OUTCOME} AS outcome, CASE WHEN url IS NULL THEN nullif(first_link, '') END AS hint_link
FROM ({_RESOLVED_SQL}) r""")
def _(t):
    return _resolved(t).select("id", "url", "outcome", "hint_link")


@query("note_candidates", f"""
SELECT min_by(id, id) AS id, url FROM (SELECT id, url, {_OUTCOME} AS outcome FROM ({_RESOLVED_SQL}) r) o
WHERE outcome = 'candidate' GROUP BY url""")
def _(t):
    return notes.note_candidates(_resolved(t)).select("id", "url")


@query("note_funnel", f"""
SELECT count(*) AS matching, count(DISTINCT CASE WHEN outcome = 'candidate' THEN url END) AS candidates,
  count(*) FILTER (outcome = 'unresolved') AS unresolved, count(*) FILTER (outcome = 'excluded') AS excluded
FROM (SELECT url, {_OUTCOME} AS outcome FROM ({_RESOLVED_SQL}) r) o""")
def _(t):
    return notes.note_funnel(_resolved(t))


# --- archive and publishing ----------------------------------------------------------------

# Two runs on one day, the second with edited titles of one language, and a run on the next day.
_SNAPSHOTS = f"""
SELECT *, cast('2024-01-19' AS date) AS snapshot_date FROM ({v.ARTICLES}) a
UNION ALL SELECT * REPLACE (CASE WHEN category = 'es' THEN concat(title, ' (edited)') ELSE title END AS title),
  cast('2024-01-19' AS date) FROM ({v.ARTICLES}) a
UNION ALL SELECT *, cast('2024-01-20' AS date) FROM ({v.ARTICLES}) a WHERE manual_review"""
_ARCHIVED_SQL = f"SELECT DISTINCT cast(snapshot_date AS string) AS snapshot_date, url, title, description, source, published_at FROM ({_SNAPSHOTS}) x"


def _snapshots(t) -> DataFrame:
    articles = t.sql(v.ARTICLES)
    edited = articles.withColumn(
        "title", F.when(F.col("category") == "es", F.concat("title", F.lit(" (edited)"))).otherwise(F.col("title"))
    )
    day = datetime(2024, 1, 19, 4, 0)
    return (
        stores.stamped(articles, "filtered_articles", day)
        .unionByName(stores.stamped(edited, "filtered_articles", day.replace(hour=12)))
        .unionByName(stores.stamped(articles.filter("manual_review"), "filtered_articles", RUN_AT))
    )


@query("snapshot_rows", f"""
SELECT url, title, 'articles' AS store, '2024-01-20' AS snapshot_date, '2024-01-20 12:00:00' AS run_at FROM ({v.ARTICLES}) a""")
def _(t):
    rows = stores.stamped(t.sql(v.ARTICLES), "articles", RUN_AT)
    return rows.select(
        "url", "title", "store", F.col("snapshot_date").cast("string").alias("snapshot_date"),
        F.date_format("run_at", "yyyy-MM-dd HH:mm:ss").alias("run_at"),
    )


@query("archive_articles", _ARCHIVED_SQL)
def _(t):
    return stores.archive_articles(_snapshots(t)).withColumn(
        "snapshot_date", F.col("snapshot_date").cast("string")
    )


@query("archive_written", f"""
SELECT 'filtered_articles' AS store, '2024-01-19' AS snapshot_date, url, title FROM ({v.ARTICLES}) a WHERE category = 'en'
UNION ALL SELECT 'articles', '2024-01-19', url, title FROM ({v.ARTICLES}) a
UNION ALL SELECT 'articles', '2024-01-20', url, title FROM ({v.ARTICLES}) a""")
def _(t):
    archive, articles = stores.Archive(t.spark, _fresh(t, "archive")), t.sql(v.ARTICLES)
    day = datetime(2024, 1, 19, 4, 0)
    archive.snapshot(filters.by_category(articles, "en"), "filtered_articles", day)
    archive.snapshot(articles, "articles", day)
    archive.snapshot(articles, "articles", RUN_AT)
    return archive.read().select(
        "store", F.col("snapshot_date").cast("string").alias("snapshot_date"), "url", "title"
    )


@query("archive_dates", f"SELECT DISTINCT cast(snapshot_date AS string) AS snapshot_date FROM ({_SNAPSHOTS}) x")
def _(t):
    return stores.archive_dates(_snapshots(t)).select(F.col("snapshot_date").cast("string").alias("snapshot_date"))


_ITEM_SQL = (
    f"""concat('  <li><a href="', {_escape_sql('url')}, '" target="_blank">', {_escape_sql("coalesce(nullif(title, ''), url)")}, """
    f"""'</a> &mdash; ', {_escape_sql("coalesce(source, '')")}, '</li>')"""
)


@query("digest_lines", f"""
SELECT snapshot_date, 2 AS section, {_ITEM_SQL} AS line FROM ({_ARCHIVED_SQL}) a
UNION ALL SELECT DISTINCT snapshot_date, 0, concat('<h2>', snapshot_date, '</h2>') FROM ({_ARCHIVED_SQL}) a
UNION ALL SELECT DISTINCT snapshot_date, 1, '<ul>' FROM ({_ARCHIVED_SQL}) a
UNION ALL SELECT DISTINCT snapshot_date, 3, '</ul>' FROM ({_ARCHIVED_SQL}) a""")
def _(t):
    rows = stores.archive_articles(_snapshots(t))
    lines = publish.digest_lines(rows, stores.archive_dates(_snapshots(t)))
    return lines.select(F.col("snapshot_date").cast("string").alias("snapshot_date"), "section", "line")


@query("published_articles", f"""
SELECT url, title, rank, CASE WHEN nth = 1 THEN base ELSE concat(base, '-', cast(nth AS string)) END AS slug
FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY rank) AS nth FROM (
  SELECT url, title, {_slug_sql()} AS base, row_number() OVER (ORDER BY {NEWEST}) AS rank
  FROM ({v.ARTICLES}) a QUALIFY rank <= 30) b) c""")
def _(t):
    return publish.published_articles(t.sql(v.ARTICLES)).select("url", "title", "rank", "slug")


@query("publish_payload", f"""
SELECT count(*) AS articles, replace(cast(to_json(list({{'url': url, 'title': title, 'description': description,
  'source': source, 'published_at': published_at, 'slug': slug}} ORDER BY rank)) AS varchar), '</', '<\\/') AS payload
FROM (SELECT *, CASE WHEN nth = 1 THEN base ELSE concat(base, '-', cast(nth AS string)) END AS slug
FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY rank) AS nth FROM (
  SELECT *, {_slug_sql()} AS base, row_number() OVER (ORDER BY {NEWEST}) AS rank
  FROM ({v.ARTICLES}) a QUALIFY rank <= 30) b) c) d""")
def _(t):
    return publish.publish_payload(publish.published_articles(t.sql(v.ARTICLES)))


# --- resolving values ----------------------------------------------------------------------

_RESOLVE_SQL = f"""
WITH a AS (SELECT url, title, source, {_slug_sql()} AS slug FROM ({v.ARTICLES}) a0),
  vals AS (SELECT value, regexp_matches(value, '(?i)^https?://site\\.example\\.org') AS anchor,
    regexp_matches(value, '(?i)^https?://') AS is_url, rtrim(split_part(lower(value), '#', 1), '/') AS needle,
    split_part(value, '#', 2) AS fragment FROM ({v.VALUES}) v0
    WHERE trim(value) <> ''),
  src AS (SELECT * FROM vals WHERE is_url AND NOT anchor),
  exact AS (SELECT s.value, a.url FROM src s JOIN a ON rtrim(a.url, '/') = s.needle),
  part AS (SELECT s.value, a.url FROM src s JOIN a ON contains(a.url, s.needle)
    WHERE s.value NOT IN (SELECT value FROM exact)),
  anchored AS (SELECT a.url FROM vals s JOIN a ON s.anchor AND s.fragment <> ''
    AND (s.fragment = a.slug OR starts_with(s.fragment, concat(a.slug, '-')))),
  bare AS (SELECT s.value, a.url FROM vals s JOIN a ON NOT s.is_url AND (contains(a.url, lower(s.value))
    OR contains(lower(a.title), lower(s.value)) OR contains(lower(coalesce(a.source, '')), lower(s.value))
    OR contains(a.slug, lower(s.value)) OR contains(lower(s.value), a.slug)))
SELECT 'matched' AS outcome, url AS key FROM (SELECT url FROM exact UNION SELECT url FROM part
  UNION SELECT url FROM anchored UNION SELECT url FROM bare) m
UNION ALL SELECT DISTINCT 'preemptive', needle FROM src
  WHERE value NOT IN (SELECT value FROM exact) AND value NOT IN (SELECT value FROM part)
UNION ALL SELECT 'warning', value FROM vals WHERE (anchor AND fragment = '')
  OR (NOT is_url AND value NOT IN (SELECT value FROM bare))"""


@query("resolve_values", _RESOLVE_SQL)
def _(t):
    return resolve.resolve_values(t.sql(v.VALUES), t.sql(v.ARTICLES, spread=True), SITE)


@query("resolve_values_by_grams", _RESOLVE_SQL)
def _(t):
    return resolve.resolve_values(t.sql(v.VALUES), t.sql(v.ARTICLES, spread=True), SITE)


@query("removal_set", f"SELECT DISTINCT key AS url FROM ({_RESOLVE_SQL}) r WHERE outcome <> 'warning'")
def _(t):
    return resolve.removal_set(resolve.resolve_values(t.sql(v.VALUES), t.sql(v.ARTICLES, spread=True), SITE))


# --- jobs over stores ----------------------------------------------------------------------

def _fresh(t, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def _store(t, name: str, articles: DataFrame) -> stores.Store:
    made = stores.Store(t.spark, _fresh(t, name))
    made.write(articles)
    return made


@query("job_curate", f"""
SELECT url, title, relevance_score, sentiment_score FROM (
  SELECT url, title, category, {_score_sql(v.LEXICON)} AS relevance_score,
    cast(length(source) - 5 AS double) AS sentiment_score
  FROM (SELECT *, {TOPIC_TEXT} AS txt FROM ({_API_SQL}) a) b) c
WHERE relevance_score >= 1 AND sentiment_score <= 0""")
def _(t):
    raw, filtered = _store(t, "raw", t.spark.createDataFrame([], ARTICLE)), stores.Store(t.spark, _fresh(t, "filtered"))
    archive = stores.Archive(t.spark, _fresh(t, "archive"))
    cfg = jobs.Settings(hours=HOURS, exclude_urls="nowhere.com", exclude_domains="src11", lexicon=v.LEXICON)
    no_feeds = _feed_documents(t).filter("status_code = 0")
    jobs.curate(
        raw, filtered, archive, _responses(t), no_feeds, _allowed(t),
        t.spark.createDataFrame([], "url string, reason string, excluded_at string"),
        lambda rows: rows.select("url", (F.length("source") - 5).cast("double").alias("score")),
        RUN_AT, cfg,
    )
    return archive.read("filtered_articles").select("url", "title", "relevance_score", "sentiment_score")


@query("job_rejects", f"SELECT url, title, 'published_at' AS reason FROM ({_SIGHTED}) s WHERE published_at IS NULL")
def _(t):
    raw, filtered = _store(t, "raw", t.spark.createDataFrame([], ARTICLE)), stores.Store(t.spark, _fresh(t, "filtered"))
    rejects = _fresh(t, "rejects")
    nothing = t.spark.createDataFrame([], "url string, reason string, excluded_at string")
    jobs.curate(
        raw, filtered, stores.Archive(t.spark, _fresh(t, "archive")), _responses(t), _feed_documents(t).filter("status_code = 0"),
        _allowed(t), nothing, None, RUN_AT, jobs.Settings(hours=HOURS, filter_enabled=False), rejects=rejects,
    )
    return t.spark.read.parquet(rejects).select("url", "title", "reason")


@query("clear_store", f"SELECT count(*) AS removed, 0 AS kept FROM ({v.ARTICLES}) a")
def _(t):
    made = _store(t, "cleared", t.sql(v.ARTICLES))
    removed = made.clear()
    return made.read().agg(F.lit(removed).cast("bigint").alias("removed"), F.count("*").cast("int").alias("kept"))


@query("job_remove_articles", f"""
SELECT {ART_COLS} FROM ({v.ARTICLES}) a WHERE url NOT IN (SELECT key FROM ({_RESOLVE_SQL}) r WHERE outcome <> 'warning')""")
def _(t):
    raw = _store(t, "raw", t.sql(v.ARTICLES))
    filtered = _store(t, "filtered", t.sql(v.ARTICLES).filter("manual_review"))
    archive = stores.Archive(t.spark, _fresh(t, "archive"))
    listed = lists.exclusions_from(t.sql(v.ARTICLE_EXCLUSIONS), [F.col("excluded_at")])
    jobs.remove_articles(t.sql(v.VALUES), raw, filtered, archive, listed, SITE, RUN_AT, "asked for")
    return raw.read()


@query("job_merge_reviewed", f"""
SELECT {ART_COLS.replace('manual_review', "manual_review OR url IN (SELECT lower(url) FROM (" + _FIRST_SQL + ") f2) AS manual_review")}
FROM (SELECT {ART_COLS} FROM ({v.STORE}) s UNION ALL {_ADDED_SQL}) m""")
def _(t):
    staging = dedup.dedup_first(t.sql(v.BATCH), F.lower("url"), [F.col("doc_id")])
    staged = _store(t, "staging", staging.withColumn("url", keys.store_key("url")))
    raw, filtered = _store(t, "raw", t.sql(v.STORE)), _store(t, "filtered", t.sql(v.STORE))
    archive = stores.Archive(t.spark, _fresh(t, "archive"))
    jobs.merge_reviewed_staging(staged, raw, filtered, archive, t.sql(v.EXCLUSIONS), RUN_AT)
    return raw.read()


@query("job_add_pages", f"""
SELECT url, TRUE AS manual_review FROM (
  SELECT DISTINCT lower(url) AS url FROM ({_FETCHED}) f WHERE html IS NOT NULL AND page_id % 4 <> 0) p""")
def _(t):
    raw = _store(t, "raw", t.sql(_STORED_PAGES))
    filtered = stores.Store(t.spark, _fresh(t, "filtered"))
    jobs.add_pages(t.sql(_FETCHED), raw, filtered, lists.exclusions_from(
        t.sql(_BARRED_PAGES).select("url", F.lit("").alias("reason"), F.lit("").alias("excluded_at")), [F.col("url")]))
    return filtered.read().select("url", "manual_review")


@query("job_import_notes", f"""
SELECT min_by(id, id) AS id, url, 'missing_fields' AS status
FROM (SELECT id, url, {_OUTCOME.replace(str(_HOSTS), str(notes.PLATFORM_HOSTS))} AS outcome FROM ({_RESOLVED_SQL}) r) o
WHERE outcome = 'candidate' GROUP BY url""")
def _(t):
    staging = stores.Store(t.spark, _fresh(t, "staging"))
    nothing = t.spark.createDataFrame([], "url string, reason string, excluded_at string")
    _funnel, outcomes = jobs.import_notes(t.sql(v.NOTES), t["pages"], staging, nothing, "press", "utm_source")
    return outcomes.select("id", "url", "status")


@query("stream_landing", _API_SQL)
def _(t):
    landing = _fresh(t, "landing")
    _responses(t).write.json(landing)
    raw = stores.Store(t.spark, _fresh(t, "raw"))
    nothing = t.spark.createDataFrame([], "url string")
    cfg = jobs.Settings(exclude_urls="nowhere.com", exclude_domains="src11")
    stream_landing(t.spark, landing, raw, _allowed(t), nothing, _fresh(t, "checkpoint"), cfg).awaitTermination()
    return raw.read().select("url", "published_at", "title", "description", "source", "category", "author")


@query("stream_feeds", _FEED_SQL.replace("SELECT url, CASE", "SELECT lower(url) AS url, CASE", 1))
def _(t):
    landing = _fresh(t, "landing")
    _feed_documents(t).write.json(landing)
    raw = stores.Store(t.spark, _fresh(t, "raw"))
    nothing = t.spark.createDataFrame([], "url string")
    stream_feeds(
        t.spark, landing, raw, nothing, _fresh(t, "checkpoint"), RUN_AT, jobs.Settings(exclude_urls="/AB,")
    ).awaitTermination()
    return raw.read().select("url", "published_at", "title", "description", "source", "category", "author")


# --- stores laid out by day and url bucket ---------------------------------------------------


def _laid_out(t, articles: DataFrame) -> PartitionedStore:
    made = PartitionedStore(t.spark, _fresh(t, "laid-out"), buckets=4)
    made.write(articles)
    return made


@query("partitioned_recent", ORACLES["recent"])
def _(t):
    return _laid_out(t, t.sql(v.ARTICLES)).recent(RUN_AT, HOURS).select("url", "published_at")


@query("partitioned_retention", ORACLES["apply_retention"])
def _(t):
    made = _laid_out(t, t.sql(v.ARTICLES))
    made.expire(RUN_AT, HOURS)
    return made.read()


@query("partitioned_insert", ORACLES["insert_absent"])
def _(t):
    made = _laid_out(t, t.sql(v.STORE))
    made.insert(merge.first_sightings(t.sql(v.BATCH), t.sql(v.EXCLUSIONS), [F.col("doc_id")]))
    return made.read()


@query("partitioned_remove", ORACLES["remove_keys"])
def _(t):
    made = _laid_out(t, t.sql(v.ARTICLES))
    made.remove(t.sql(v.ARTICLE_EXCLUSIONS).select(keys.removal_key("url").alias("url")))
    return made.read()


@query("partitioned_pin", ORACLES["mark_reviewed"])
def _(t):
    made = _laid_out(t, t.sql(v.ARTICLES))
    made.pin(t.sql(v.ARTICLE_EXCLUSIONS).select(keys.removal_key("url").alias("url")))
    return made.read().select("url", "manual_review")


_COUNTED = ["en", "de", "fr"]
_COUNTED_AS = "CASE WHEN category IN ('en', 'de', 'fr') THEN category ELSE 'other' END"
_FACTS_SQL = f"""
WITH kept AS ({ORACLES["apply_retention"]}),
stored AS (
  SELECT title, description, source, author, manual_review, {_COUNTED_AS} AS category FROM kept
  UNION ALL SELECT title, description, source, author, false, {_COUNTED_AS} FROM ({_API_SQL}) a),
scored AS (SELECT *, {_score_sql(v.LEXICON)} >= 1 AS relevant, coalesce(length(source), 0) <= 5 AS negative FROM (SELECT *, {TOPIC_TEXT} AS txt FROM stored) s)
SELECT 'removed' AS stage, {_COUNTED_AS} AS category, count(*) AS articles FROM ({v.ARTICLES}) a
  WHERE coalesce(published_at < '{CUTOFF}' AND NOT manual_review, false) GROUP BY 2
UNION ALL SELECT 'stored', category, count(*) FROM scored GROUP BY 2
UNION ALL SELECT 'relevant', category, count(*) FROM scored WHERE relevant GROUP BY 2
UNION ALL SELECT 'negative', category, count(*) FROM scored WHERE relevant AND negative GROUP BY 2
UNION ALL SELECT 'filtered', category, count(*) FROM scored WHERE relevant AND negative OR manual_review GROUP BY 2
UNION ALL SELECT 'pinned', category, count(*) FROM scored WHERE manual_review GROUP BY 2"""


def _facts(t, raw, filtered) -> DataFrame:
    """The counts of a run over stored articles, as it reports them."""
    cfg = jobs.Settings(hours=HOURS, exclude_urls="nowhere.com", exclude_domains="src11", lexicon=v.LEXICON, categories=_COUNTED)
    facts = jobs.curate(
        raw, filtered, stores.Archive(t.spark, _fresh(t, "archive")), _responses(t), _feed_documents(t).filter("status_code = 0"), _allowed(t),
        t.spark.createDataFrame([], "url string, reason string, excluded_at string"),
        lambda rows: rows.select("url", (F.coalesce(F.length("source"), F.lit(0)) - 5).cast("double").alias("score")), RUN_AT, cfg,
    )
    rows = [(stage, category, n) for stage, found in facts["by_category"].items() for category, n in found.items() if n]
    return t.spark.createDataFrame(rows, "stage string, category string, articles bigint")


@query("job_facts", _FACTS_SQL)
def _(t):
    return _facts(t, _store(t, "raw", t.sql(v.ARTICLES)), stores.Store(t.spark, _fresh(t, "filtered")))


@query("job_facts_partitioned", _FACTS_SQL)
def _(t):
    return _facts(t, _laid_out(t, t.sql(v.ARTICLES)), PartitionedStore(t.spark, _fresh(t, "filtered"), buckets=2))


@query("stream_repeats", _API_SQL)
def _(t):
    """The same responses delivered several times, each a batch of its own, some before a restart and some after."""
    landing, checkpoint = _fresh(t, "landing"), _fresh(t, "checkpoint")
    raw = PartitionedStore(t.spark, _fresh(t, "raw"), buckets=4)
    nothing = t.spark.createDataFrame([], "url string")
    cfg = jobs.Settings(exclude_urls="nowhere.com", exclude_domains="src11")
    delivered = 0
    for deliveries in (2, 1):
        for _ in range(deliveries):
            _responses(t).write.mode("append").json(landing)
        delivered += deliveries
        files = len(t.spark.read.schema(API_RESPONSE).json(landing).inputFiles()) // delivered
        stream_landing(t.spark, landing, raw, _allowed(t), nothing, checkpoint, cfg, files_per_batch=files).awaitTermination()
    return raw.read().select("url", "published_at", "title", "description", "source", "category", "author")
