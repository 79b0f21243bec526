"""The given tables as article tables, in SQL that Spark and DuckDB both run.

Tables stand in braces: Spark gets frames for them, DuckDB their names.
"""

from pyspark.sql import DataFrame, SparkSession

# Columns of the tables used, so that reading one needs no look into its files.
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}
TABLES = list(SCHEMAS)

_PUBLISHED = (
    "concat('2024-01-', lpad(cast(1 + doc_id % 28 AS string), 2, '0'), ' ', "
    "lpad(cast(doc_id % 24 AS string), 2, '0'), ':', lpad(cast(doc_id % 60 AS string), 2, '0'))"
)
_TITLE = "split_part(text, chr(10), 1)"
_REST = f"substr(text, 2 + length({_TITLE}))"

# Every document as a stored article, some undated, unsourced or pinned.
ARTICLES = f"""
SELECT concat('https://', source, '.example.com/', cast(doc_id AS string)) AS url,
  CASE WHEN n_chars % 41 <> 0 THEN {_PUBLISHED} END AS published_at,
  {_TITLE} AS title, {_REST} AS description,
  CASE WHEN source <> 'src13' THEN source END AS source,
  lang AS category, CASE WHEN lang = 'de' THEN concat('author ', source) END AS author,
  cast(NULL AS double) AS relevance_score, cast(NULL AS double) AS sentiment_score,
  n_chars % 97 = 0 AS manual_review
FROM {{documents}}"""

# Every document as a landed article; equal texts share a url, in mixed case.
BATCH = f"""
SELECT doc_id,
  CASE WHEN lang = 'fr' THEN upper(concat('https://news.example.com/', md5(text)))
       ELSE concat('https://news.example.com/', md5(text)) END AS url,
  {_PUBLISHED} AS published_at, {_TITLE} AS title, {_REST} AS description,
  source, lang AS category, CASE WHEN lang = 'de' THEN concat('author ', source) END AS author,
  cast(NULL AS double) AS relevance_score, cast(NULL AS double) AS sentiment_score,
  FALSE AS manual_review
FROM {{documents}}"""

_FIRST = (
    "row_number() OVER (PARTITION BY lower(url) ORDER BY doc_id)"
)

# The labelled documents as an older store, unique by url.
STORE = f"""
SELECT lower(url) AS url, published_at, title, 'stored' AS description, source, category, author,
  relevance_score, sentiment_score, quality = 1 AS manual_review
FROM (SELECT b.*, quality, {_FIRST} AS nth FROM ({BATCH}) b JOIN {{labels}} l USING (doc_id)) x
WHERE nth = 1"""

# Toxic documents are excluded, under a differently spelled url.
EXCLUSIONS = f"""
SELECT DISTINCT concat(upper(url), '//') AS url, 'toxic' AS reason,
  '2024-01-01T00:00' AS excluded_at
FROM ({BATCH}) b JOIN {{labels}} l USING (doc_id) WHERE toxic = 1"""

# The same for the urls of ARTICLES.
ARTICLE_EXCLUSIONS = """
SELECT upper(concat('https://', source, '.example.com/', cast(doc_id AS string), '/')) AS url,
  'toxic' AS reason, '2024-01-01T00:00' AS excluded_at
FROM {documents} d JOIN {labels} l USING (doc_id) WHERE toxic = 1"""

# Two judges over the labelled documents.
_LABELLED = """SELECT concat('https://', source, '.example.com/', cast(doc_id AS string)) AS url, n_chars,
  cast(CASE WHEN toxic = 1 THEN -0.8 WHEN quality = 1 THEN 0.4 ELSE -0.2 END AS double) AS base
FROM {documents} d JOIN {labels} l USING (doc_id)"""
SCORES = f"""
SELECT 'local' AS target, url, base AS score FROM ({_LABELLED}) s
UNION ALL
SELECT 'remote', url, cast(round(base + (n_chars % 7 - 3) / 10.0, 1) AS double) FROM ({_LABELLED}) s"""

# Pages as web clips in a note collection.
NOTES = """
SELECT cast(page_id AS string) AS id, html,
  concat('Clip ', cast(page_id AS string), chr(10), '#press', chr(10),
    CASE WHEN page_id % 5 = 0 THEN concat('see ', url) WHEN page_id % 7 = 0 THEN concat('  ', url, '.)')
         ELSE url END, chr(10), 'By somebody', chr(10), html) AS text,
  concat('Clip of ', url) AS title, cast(page_id AS double) AS createdAt,
  CASE WHEN page_id % 2 = 0 THEN '["Press"]' ELSE '[]' END AS tagLinks,
  CASE WHEN page_id % 11 = 0 THEN 1 ELSE 0 END AS trashed,
  CASE WHEN page_id % 13 = 0 THEN 1 ELSE 0 END AS deleted
FROM {pages}"""

# Replies of a judge, one per labelled document, in every shape they come in.
REPLIES = """
SELECT doc_id AS batch_id, 2 AS expected_count, shape,
  CASE WHEN shape = 0 THEN arr WHEN shape = 1 THEN concat('```json', chr(10), arr, chr(10), '```')
       WHEN shape = 2 THEN concat('Here you are: ', arr, ' as asked') WHEN shape = 3 THEN '  '
       WHEN shape = 4 THEN '{"index": 0, "sentiment_score": 0.5}' WHEN shape = 5 THEN 'no idea'
       WHEN shape = 6 THEN '[{"index": 0, "sentiment_score": 0.1}]'
       ELSE '[{"index": 0, "sentiment_score": null}, {"index": 1, "sentiment_score": 0.1}]' END AS content,
  CASE WHEN shape = 3 THEN arr END AS reasoning_content
FROM (SELECT doc_id, doc_id % 8 AS shape,
  concat('[{"index": 0, "sentiment_score": ', cast(toxic AS string), '.25}, {"index": "1", "sentiment_score": "-0.5"},',
         ' {"index": 0, "sentiment_score": ', cast(quality AS string), '.75}]') AS arr
  FROM {labels}) r"""

# What a curator types: source urls, site anchors and bare text.
VALUES = """
SELECT concat('HTTPS://', source, '.example.com/', cast(doc_id AS string), '/#top') AS value
  FROM {documents} d JOIN {labels} l USING (doc_id) WHERE toxic = 1
UNION SELECT concat('https://', source, '.example.com/', cast(doc_id AS string), '/no/such') FROM {documents} d JOIN {labels} l USING (doc_id) WHERE toxic = 1
UNION SELECT 'https://src7.example.com'
UNION SELECT concat('https://site.example.org/', cast(quality AS string)) FROM {labels}
UNION SELECT concat('https://site.example.org/#nothing-', cast(quality AS string)) FROM {labels}
UNION SELECT concat('https://site.example.org/#', replace(lower(split_part(split_part(text, chr(10), 1), '.', 1)), ' ', '-'), '-2')
  FROM {documents} d JOIN {labels} l USING (doc_id) WHERE toxic = 1
UNION SELECT concat('x ', split_part(split_part(text, chr(10), 1), ' ', 2), ' ', split_part(split_part(text, chr(10), 1), ' ', 3), ' y')
  FROM {documents} d JOIN {labels} l USING (doc_id) WHERE toxic = 1
UNION SELECT concat(split_part(split_part(text, chr(10), 1), ' ', 2), ' ', split_part(split_part(text, chr(10), 1), ' ', 3))
  FROM {documents} d JOIN {labels} l USING (doc_id) WHERE toxic = 1 AND length(text) > 40"""

# A small lexicon of words frequent in the given texts.
LEXICON = [
    ("the", 3.0), ("der", 3.0), ("que", 2.0), ("les", 2.0), ("worthless", 2.0),
    ("of the", 1.0), ("in la", 1.0), ("été", 1.0), ("und", 1.0), ("para", 1.0), ("e-mail", 1.0),
]


class Tables:
    """Frames of one scale factor's tables, and SQL over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """The table over all cores, where its file has fewer row groups than that.

        For queries that spend their time on text. A large table has more
        splits than the cluster has cores, and is read as it is.
        """
        df, cores = self[name], self.spark.sparkContext.defaultParallelism
        return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, df.columns[0])

    def sql(self, text: str, spread: bool = False) -> DataFrame:
        read = self.spread if spread else self.__getitem__
        used = {t: read(t) for t in TABLES if "{" + t + "}" in text}
        text = text.replace("{", "{{").replace("}", "}}")  # other braces are JSON
        for t in used:
            text = text.replace("{{" + t + "}}", "{" + t + "}")
        return self.spark.sql(text, **used)


def duck(text: str) -> str:
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text
