"""The registered queries over these operators, and the SQL some must equal."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path
from statistics import NormalDist

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit import sinks
from cohortkit.llm import (
    bpe, decontaminate, filter_audit, hilbert, jaccard, neighbours, phrases, pii, quality, reputation, secrets, tokens,
    toxicity,
)
from cohortkit.llm.common import table

#: A document is kept from this probability of good quality on.
KEEP = 0.5
SHARDS = 24
TOXIC = 0.7
#: A phrase counts from so many occurrences on; the best of each language are returned.
PHRASE, PHRASES = 100, 2000
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: All hosts of ``pages`` lie under these reserved names, which therefore stand for suffixes.
SUFFIXES = ("example.com", "example.net", "example.org")


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed."""
    root = str(Path(__file__).resolve().parents[2])
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", quality.score(docs, model).alias("score"))
    return scored.withColumn("keep", (F.col("score") >= KEEP).cast("int"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    carry = {
        "doc_id": F.col("doc_id"),
        "size": (F.octet_length(raw) + 8).cast("long"),
        "text_crc32": F.crc32(raw),
    }
    placed = hilbert.hilbert_runs(docs, ["source", "lang", "n_chars"], SHARDS, carry)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", secrets.scan(F.col("text")).alias("found")).select("doc_id", "found.*")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.near_duplicates(docs, words=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = decontaminate.matches(F.col("text"), table(spark, sf_dir, "benchmark"))
    return docs.select("doc_id", F.explode(found).alias("m")).select("doc_id", "m.*")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    selector = pii.fit_selector(docs)
    return docs.select("doc_id", pii.report(F.col("text"), selector).alias("found")).select("doc_id", "found.*")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = toxicity.fit(docs.where(~held), table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held.alias("held_out"), toxicity.score(F.col("text"), model).alias("s"))
    return scored.select(
        "doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), F.col("s.score").alias("score"),
        (F.col("s.score") >= TOXIC).cast("int").alias("predicted"), F.col("s.passages").alias("passages"),
    )


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sinks.shared_folder(spark)
    tokens.write_blocks(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return tokens.read_blocks(spark, path)


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = neighbours.nearest(rows, F.col("vec_id") % 50 == 0, 5)
    return found.select("query_id", "rank", "vec_id", "score")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.document_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), PHRASE, PHRASES)


def op13_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of its number: bad if toxic or of low quality."""
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return reputation.judge(table(spark, sf_dir, "pages"), outcomes, URL_RULES, SUFFIXES)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _registered(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        reachable(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: _registered(q)
    for q in (
        op1_quality, op2_sharding, op3_secrets, op4_jaccard, op5_bpe, op6_decontamination,
        op7_pii, op8_toxicity, op9_tokens, op10_neighbours, op11_filter_audit,
        op12_phrases, op13_url_reputation, pipeline,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER.format('coalesce(text, {empty})')}, '[^\x20\x09-\x0D]+')"
_WORDS = _WORDS.format(empty="''")

_HOST = "translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CONCENTRATION = f"""
    SELECT coalesce(1 / greatest(least(
        (sum((k - n * m) ** 2 / nullif(n, 0)) - sum(m * (1 - m)) FILTER (n > 0))
            / nullif(sum(m * (1 - m) * (n - 1)) FILTER (n > 0), 0),
        1 / (1 + {reputation.LOOSE})), 1 / (1 + {reputation.TIGHT})) - 1, {reputation.TIGHT}) AS s FROM {{groups}}"""
_TAIL = "(1 / (12 * y ** 2) - 1 / (120 * y ** 4) + 1 / (252 * y ** 6))"
_TAIL_2 = "1 / (2 * y ** 2) + 1 / (6 * y ** 3) - 1 / (30 * y ** 5) + 1 / (42 * y ** 7)"
_REPUTATION = rf"""
WITH parsed AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages
), placed AS (
    SELECT page_id, {_HOST} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parsed
), marks AS (
    SELECT doc_id AS page_id, max((toxic = 1 OR quality = 0)::INT) AS bad FROM labels GROUP BY doc_id
), counted AS (
    SELECT host, count(m.bad) AS n, coalesce(sum(m.bad), 0)::BIGINT AS k,
        regexp_replace(regexp_extract(host, '[^@]*$'), ':[0-9]*$', '') AS name
    FROM placed LEFT JOIN marks m USING (page_id) GROUP BY host
), suffixed AS (
    SELECT *, CASE {" ".join(f"WHEN name = '{s}' OR ends_with(name, '.{s}') THEN '{s}'" for s in SUFFIXES)}
        WHEN regexp_matches(name, '^[0-9.]*$') OR starts_with(name, '[') THEN ''
        ELSE string_split(name, '.')[-1] END AS suffix FROM counted
), hosts AS (
    SELECT *, CASE WHEN suffix = '' OR suffix = name THEN name
        ELSE string_split(substr(name, 1, len(name) - len(suffix) - 1), '.')[-1] || '.' || suffix END AS registered
    FROM suffixed
), overall AS (
    SELECT (sum(k) + 0.5) / (sum(n) + 1) AS m FROM hosts
), tops AS (
    SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(m) AS m FROM hosts, overall GROUP BY suffix
), s1 AS ({_CONCENTRATION.format(groups="tops")}
), domains AS (
    SELECT registered, sum(h.n) AS n, sum(h.k) AS k, any_value((t.k + s * t.m) / (t.n + s)) AS m
    FROM hosts h JOIN tops t USING (suffix), s1 GROUP BY registered
), s2 AS ({_CONCENTRATION.format(groups="domains")}
), leaves AS (
    SELECT host, h.n, h.k, (d.k + s * d.m) / (d.n + s) AS m FROM hosts h JOIN domains d USING (registered), s2
), s3 AS ({_CONCENTRATION.format(groups="leaves")}
), posterior AS (
    SELECT host, n, k, k + s * m AS a, n - k + s * (1 - m) AS b FROM leaves, s3
), shifted AS (
    SELECT host, n, k, unnest([1, -1]) AS sign, unnest([a, b]) AS x, x + 6 AS y FROM posterior
), moments AS (
    SELECT host, any_value(n) AS n, any_value(k) AS k,
        sum(sign * (ln(y) - 1 / (2 * y) - {_TAIL} - {" - ".join(f"1 / (x + {j})" for j in range(6))})) AS mean,
        sum(1 / y + {_TAIL_2} + {" + ".join(f"1 / (x + {j}) ** 2" for j in range(6))}) AS variance
    FROM shifted GROUP BY host
), bounds AS (
    SELECT host, n, k, 1 / (1 + exp({NormalDist().inv_cdf(reputation.CERTAIN)!r} * sqrt(variance) - mean)) AS bound FROM moments
), ruled AS (
    SELECT *, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
    FROM placed
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL
    THEN 'allow' WHEN bound >= {reputation.BAD} THEN 'block' ELSE 'allow' END AS verdict,
    n AS labelled, k AS bad, round(bound, 6) AS bound
FROM ruled JOIN bounds USING (host)
"""

ORACLES = {
    "op4_jaccard": rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, {_WORDS} AS w FROM documents
), shingles AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)] END) AS s
    FROM words
), sizes AS (
    SELECT doc_id, len(s) AS n FROM shingles
), each AS (
    SELECT doc_id, unnest(s) AS sh FROM shingles
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
    FROM each a JOIN each b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
    SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = s.a JOIN sizes y ON y.doc_id = s.b
    WHERE 100 * c >= 90 * (x.n + y.n - c)
), reach(node, other) AS (
    SELECT a, b FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT s.doc_id, s.n::BIGINT AS n_shingles, least(s.doc_id, coalesce(min(r.other), s.doc_id)) AS component_id
FROM sizes s LEFT JOIN reach r ON r.node = s.doc_id GROUP BY s.doc_id, s.n
""",
    "op6_decontamination": rf"""
WITH items AS (
    SELECT item_id, w, len(w) AS l, least(5, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)
    WHERE len(w) > 0
), docs AS (
    SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) > 0
), item_shingles AS (
    SELECT item_id, l, k, sh, count(*) AS c FROM (
        SELECT item_id, l, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, l - k + 2)]) AS sh
        FROM items) GROUP BY ALL
), doc_shingles AS (
    SELECT doc_id, n, k, unnest(range(greatest(n - least(k, n) + 1, 1))) AS pos,
        unnest([array_to_string(w[i:i + least(k, n) - 1], ' ')
            for i in range(1, greatest(n - least(k, n) + 2, 2))]) AS sh
    FROM docs, (SELECT DISTINCT k FROM items)
), windows AS (
    SELECT DISTINCT doc_id, n, item_id, l, k, greatest(0, least(pos, n - l)) AS start
    FROM doc_shingles JOIN item_shingles USING (k, sh)
), counted AS (
    SELECT w.doc_id, w.n, w.item_id, w.l, w.k, w.start, d.sh, count(*) AS c
    FROM windows w JOIN doc_shingles d ON d.doc_id = w.doc_id AND d.k = w.k
        AND d.pos BETWEEN w.start AND w.start + w.l - w.k
    GROUP BY ALL
), scored AS (
    SELECT c.doc_id, c.item_id, c.start, least(c.l, c.n) AS n_words, sum(c.c) AS own,
        any_value(c.l - c.k + 1) AS other, sum(least(c.c, coalesce(i.c, 0))) AS shared
    FROM counted c LEFT JOIN item_shingles i ON i.item_id = c.item_id AND i.sh = c.sh
    GROUP BY c.doc_id, c.item_id, c.start, c.l, c.n
), ranked AS (
    SELECT *, shared::DOUBLE / (own + other - shared) AS similarity FROM scored
)
SELECT doc_id, item_id, start::INTEGER AS start_word, n_words::INTEGER AS n_words, similarity FROM ranked
WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
""",
    "op11_filter_audit": rf"""
WITH RECURSIVE marks AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), docs AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), firsts AS (
    SELECT t, min(doc_id) AS least FROM docs GROUP BY t
), words AS (
    SELECT d.*, regexp_extract_all(d.t, '[^\x20\x09-\x0D]+') AS w, coalesce(f.least < d.doc_id, false) AS again
    FROM docs d JOIN firsts f ON f.t = d.t
), failed AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, concat(
        CASE WHEN len(w) < 200 THEN 'A' ELSE '' END,
        CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END,
        CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t) THEN 'C' ELSE '' END,
        CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
        CASE WHEN again THEN 'E' ELSE '' END) AS fails
    FROM words LEFT JOIN marks USING (doc_id)
), counts AS (
    SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
    FROM failed GROUP BY part, fails
), orders(o) AS (
    SELECT '' UNION ALL SELECT o || l FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l)
    WHERE NOT contains(o, l)
), steps AS (
    SELECT o, s, o[s] AS letter, o[:s - 1] AS before FROM orders, range(1, 6) r(s) WHERE len(o) = 5
), met AS (
    SELECT c.*, s.*, translate(fails, before, '') = fails AS there, contains(fails, letter) AS bad FROM counts c, steps s
), cells AS (
    SELECT part, o AS filter_order, s AS step, letter,
        coalesce(sum(n) FILTER (there AND NOT bad), 0) AS kept, coalesce(sum(n) FILTER (there AND bad), 0) AS removed,
        coalesce(sum(n) FILTER (bad AND NOT there), 0) AS redundant,
        coalesce(sum(n) FILTER (fails = letter), 0) AS unique_fails,
        coalesce(sum(good) FILTER (there AND bad), 0) AS good_lost,
        coalesce(sum(toxic) FILTER (there AND bad), 0) AS toxic_lost
    FROM met GROUP BY part, o, s, letter
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
    redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
    toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM cells
""",
    "op12_phrases": rf"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
        {_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
    FROM documents
), totals AS (
    SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang
), places AS (
    SELECT lang, w, len(w) AS size, unnest(range(1, len(w) + 1)) AS i FROM pieces
), found AS (
    SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS f
    FROM places, range(1, 6) r(k) WHERE i + k - 1 <= size GROUP BY ALL HAVING count(*) >= {PHRASE}
), candidates AS (
    SELECT *, string_split(phrase, ' ') AS w FROM found WHERE k >= 2
), cuts AS (
    SELECT lang, phrase, f, w, unnest(range(1, k)) AS c FROM candidates
), scored AS (
    SELECT c.lang, c.phrase, c.f AS a, l.f AS l, r.f AS r, n, c.c,
        (1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f) AS score
    FROM cuts c JOIN totals USING (lang)
    JOIN found l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[:c.c], ' ')
    JOIN found r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.c + 1:], ' ')
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), inside AS (
    SELECT DISTINCT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, f
    FROM (SELECT lang, w, f, k, unnest(range(1, k + 1)) AS i FROM candidates), range(2, 5) r(m)
    WHERE i + m - 1 <= k AND m < k
), kept AS (
    SELECT s.* FROM lowest s WHERE NOT EXISTS (
        SELECT 1 FROM inside i WHERE i.lang = s.lang AND i.phrase = s.phrase AND 100 * i.f >= 100 * s.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
    a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM kept
QUALIFY rank <= {PHRASES}
""",
    "op13_url_reputation": _REPUTATION,
}
