"""Catalog (G1-G5), snippet (N1-N2) and exposure (X1-X3) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumen.operators import catalog as G
from lumen.operators import exposure as X
from lumen.operators import search as N
from lumen.plans import inputs as I
from lumen.plans.registry import register

SALES = """
WITH sl AS (SELECT l_partkey AS item, l_orderkey AS ord, l_quantity AS qty,
                   CAST(l_shipdate AS DATE) AS day FROM lineitem)
"""

USER_EVENTS = """
WITH ue AS (SELECT user_id, event_id % 20 AS item_id,
                   CASE event_type WHEN 'click' THEN 'toggle' WHEN 'error' THEN 'remove'
                                   WHEN 'view' THEN 'rate' ELSE event_type END AS action,
                   CAST(1 + event_id % 5 AS INTEGER) AS rating, ts, event_id AS id
            FROM events)
"""

SEARCH_Q = " RED "
SNIPPET_Q = "me"

register("trending", SALES + """,
last AS (SELECT max(day) AS d FROM sl),
u AS (SELECT item, sum(qty) AS units FROM sl, last WHERE day >= d - 6 GROUP BY item
      ORDER BY units DESC, item LIMIT 12)
SELECT u.item, p_name AS title, units,
       CASE WHEN p_size IS NULL OR p_size = 0 THEN '0.0'
            ELSE printf('%.1f', CAST(p_size AS DOUBLE) / 5.0) END AS rating
FROM u JOIN part ON p_partkey = u.item""")(
    lambda spark, d: G.trending(I.sales_lines(spark, d), I.catalog_items(spark, d)))

register("search_titles", SALES + f""",
pop AS (SELECT item, sum(qty) AS popularity FROM sl GROUP BY item)
SELECT p_partkey AS item, p_name AS title, coalesce(popularity, 0.0) AS popularity
FROM part LEFT JOIN pop ON pop.item = p_partkey
WHERE p_name ILIKE '%{SEARCH_Q.strip()}%'
ORDER BY (lower(p_name) = lower('{SEARCH_Q.strip()}')) DESC, popularity DESC, p_partkey LIMIT 12""")(
    lambda spark, d: G.search_titles(I.catalog_items(spark, d), I.popularity(spark, d), SEARCH_Q))

register("recommendations", SALES + """,
targets AS (SELECT item FROM (
    SELECT item, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, item) AS rn
    FROM (SELECT item, count(*) AS n FROM sl GROUP BY item) JOIN part ON p_partkey = item) WHERE rn = 1),
t_orders AS (SELECT DISTINCT sl.ord, sl.item AS target FROM sl JOIN targets USING (item)),
co AS (SELECT target, sl.item, count(DISTINCT sl.ord) AS orders
       FROM sl JOIN t_orders USING (ord) WHERE sl.item <> target GROUP BY target, sl.item)
SELECT target, CAST(rank AS INTEGER) AS rank, item, CAST(orders AS BIGINT) AS orders FROM (
  SELECT *, row_number() OVER (PARTITION BY target ORDER BY orders DESC, item) AS rank FROM co)
WHERE rank <= 6""")(
    lambda spark, d: G.recommendations(I.sales_lines(spark, d), I.best_sellers(spark, d)))


def _twins(spark, d):
    lines = I.lines_with_twins(spark, d)
    twins = lines.where(F.col("item") < 0).select("item").distinct()
    found = G.similar_items(G.item_factors(lines), twins, n=1)
    return found.select(F.col("target").alias("twin"), "rank", "item")


# Items that are always bought together have the same factor, so each twin's
# nearest item is the one it was made from.
register("similar_items", f"""
SELECT DISTINCT -l_partkey AS twin, CAST(1 AS INTEGER) AS rank, l_partkey AS item
FROM lineitem WHERE l_partkey > 0 AND l_partkey % {I.TWINS_OF} = 0""")(_twins)

register("watchlist", USER_EVENTS + """
SELECT user_id, item_id, CAST(count(*) AS BIGINT) AS toggles
FROM ue t
WHERE action = 'toggle' AND NOT EXISTS (
  SELECT 1 FROM ue r WHERE r.action = 'remove' AND r.user_id = t.user_id AND r.item_id = t.item_id
    AND (r.ts > t.ts OR (r.ts = t.ts AND r.id > t.id)))
GROUP BY user_id, item_id HAVING count(*) % 2 = 1""")(
    lambda spark, d: G.watchlist(I.user_events(spark, d)))

register("ratings", USER_EVENTS + """,
pairs AS (SELECT DISTINCT user_id, item_id FROM ue),
lastr AS (SELECT user_id, item_id, rating FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, id DESC) AS rn
  FROM ue WHERE action = 'rate') WHERE rn = 1)
SELECT p.user_id, p.item_id, CAST(coalesce(l.rating, 0) AS INTEGER) AS rating
FROM pairs p LEFT JOIN lastr l USING (user_id, item_id)""")(
    lambda spark, d: G.ratings(I.user_events(spark, d)))

# ------------------------------------------------------------------ snippets

register("search_snippets", f"""
WITH s AS (SELECT p_partkey AS id, p_name AS title, p_brand AS code,
                  lower(p_type) || ',size' || CAST(p_size AS VARCHAR) AS tags FROM part)
SELECT id, title, code, tags FROM s WHERE title ILIKE '%{SNIPPET_Q}%' OR tags ILIKE '%{SNIPPET_Q}%'""")(
    lambda spark, d: N.search_snippets(I.snippets(spark, d), SNIPPET_Q))

register("owner_languages", """
SELECT p_brand AS owner, CAST(count(*) AS BIGINT) AS public_repos,
       coalesce(string_agg(DISTINCT lang, ',' ORDER BY lang), '') AS languages,
       CAST(count(DISTINCT lang) AS BIGINT) AS n_languages
FROM (SELECT p_brand, CASE WHEN p_size > 45 AND length(p_type) > 0 THEN p_type END AS lang FROM part)
GROUP BY p_brand""")(lambda spark, d: N.owner_languages(I.repos(spark, d)))

# ------------------------------------------------------------------ exposure

CORPUS = """
corpus AS (SELECT substring(upper(sha1(props)), 1, 5) AS prefix, substring(upper(sha1(props)), 6, 35) AS suffix,
                  count(*) AS "count" FROM events WHERE props IS NOT NULL GROUP BY 1, 2)
"""

register("hash_corpus", "WITH " + CORPUS + "SELECT prefix, suffix, CAST(\"count\" AS BIGINT) AS \"count\" FROM corpus")(
    lambda spark, d: X.hash_corpus(I.table(spark, d, "events"), "props"))

register("secret_exposure", "WITH " + CORPUS.strip() + """,
secrets AS (SELECT '{"k": ' || CAST(user_id AS VARCHAR) || '}' AS secret FROM (SELECT DISTINCT user_id FROM events)
            UNION ALL SELECT text FROM benchmark)
SELECT secret, coalesce(c."count", 0) > 0 AS breached, CAST(coalesce(c."count", 0) AS BIGINT) AS "count"
FROM secrets LEFT JOIN corpus c ON c.prefix = substring(upper(sha1(secret)), 1, 5)
                               AND c.suffix = substring(upper(sha1(secret)), 6, 35)""")(
    lambda spark, d: X.secret_exposure(I.secrets(spark, d),
                                       X.hash_corpus(I.table(spark, d, "events"), "props")))

register("email_exposure", r"""
WITH emails AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'))
                  AS email FROM documents),
breaches AS (SELECT email, 'Adobe' AS breach FROM emails WHERE length(email) % 3 <> 0
             UNION ALL SELECT email, 'Canva' FROM emails WHERE length(email) % 3 = 1)
SELECT e.email, count(b.breach) > 0 AS breached,
       coalesce(string_agg(b.breach, ', ' ORDER BY b.breach), '') AS breaches,
       CAST(count(b.breach) AS BIGINT) AS n_breaches
FROM emails e LEFT JOIN breaches b USING (email) GROUP BY e.email""")(
    lambda spark, d: X.email_exposure(I.emails(spark, d), I.breaches(spark, d)))
