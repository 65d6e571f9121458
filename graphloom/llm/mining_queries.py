"""Operators 11 to 13 applied to the driver's tables, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.collocations import mine_phrases
from graphloom.llm.prefix_trie import branch, pack_turns, prefix_trie
from graphloom.llm.url_filters import MIN_SOFT, SOFT, STRICT, filter_urls
from graphloom.tables import table


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"), max_words=3, min_count=10, cover=50, top=2000)


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), worded AS (SELECT lang, list_filter(string_split(translate(piece, chr(9), ' '), ' '), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
grams AS (
  SELECT lang, k AS words, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(generate_series(1, len(w)::BIGINT - k + 1)) AS i FROM worded, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)
), counts AS (SELECT lang, words, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(generate_series(1, words - 1)) AS k FROM (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE words > 1))
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, h.f AS l, r.f AS r, (1000000::HUGEINT * c.a * c.a) // (h.f::HUGEINT * r.f) AS score
  FROM cuts c JOIN counts h ON h.lang = c.lang AND h.phrase = c.head JOIN counts r ON r.lang = c.lang AND r.phrase = c.rest
), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, phrase, max(f) AS longer FROM (
    SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE words = 3))
  GROUP BY ALL
), kept AS (
  SELECT l.* FROM lowest l LEFT JOIN inner_ i ON i.lang = l.lang AND i.phrase = l.phrase WHERE longer IS NULL OR 100 * longer < 50 * a
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

#: A conversation takes fewer first turns than this from the first one of its hundred.
SHARED = 6


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    conversations = turns.select("conv_id").where("conv_id is not null").distinct()
    plan = conversations.select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("base_id"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int").alias("h"),
    )
    return prefix_trie(branch(pack_turns(turns), plan, SHARED - 1), conversations)


OP12_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS p FROM turns
), plan AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT c.conv_id, t.p, 0 AS own, role, text FROM plan c JOIN placed t ON t.conv_id = c.base AND t.p <= c.h
  UNION ALL SELECT c.conv_id, t.p, 1, role, text FROM plan c JOIN placed t ON t.conv_id = c.conv_id AND t.p > c.h
), deep AS (
  SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars,
    string_agg(sha256(strlen(role) || ':' || role || text), '/') OVER (PARTITION BY conv_id ORDER BY own, p) AS path
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY own, p)
), steps AS (
  SELECT * FROM deep UNION ALL SELECT conv_id, 0, 0, '' FROM plan
), ends AS (SELECT conv_id, arg_max(path, depth) AS path FROM steps GROUP BY conv_id),
nodes AS (
  SELECT path, any_value(depth) AS depth, any_value(chars) AS chars, count(*) AS n_convs, min(conv_id) AS conv_id,
    CASE WHEN path = '' THEN NULL WHEN contains(path, '/') THEN left(path, length(path) - 65) ELSE '' END AS parent FROM steps GROUP BY path
), children AS (SELECT parent AS path, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
worth AS (SELECT n.*, coalesce(c.n, 0) AS n_children, (n_convs - 1) * chars AS saved FROM nodes n LEFT JOIN children c USING (path)),
sums AS (
  SELECT s.path, sum((w.n_children = 0)::INT)::BIGINT AS n_leaves, sum(w.saved)::BIGINT AS saved_tokens
  FROM worth w JOIN steps s ON s.conv_id = w.conv_id AND s.depth <= w.depth GROUP BY s.path
), ending AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM ends GROUP BY path)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM worth w JOIN sums USING (path) LEFT JOIN nodes p ON p.path = w.parent LEFT JOIN ending e ON e.path = w.path
"""

#: (action, host, path): fixed values.
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filter_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return out.select("row.page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft")


EDGE = r"[^a-z0-9\x{80}-\x{10FFFF}]"
SOFT_SQL = " + ".join(f"regexp_matches(u, '(^|{EDGE}){t}($|{EDGE})')::INT" for t in SOFT)
OP13_SQL = rf"""
WITH parts AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u,
    CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
    {SOFT_SQL} AS n_soft,
    len(regexp_extract_all(' ' || regexp_replace(u, '({EDGE})', '\1\1', 'g') || ' ', '{EDGE}(?:{"|".join(STRICT)}){EDGE}')) AS n_strict FROM split
)
SELECT page_id, host, path, rule, n_soft::INT AS n_soft, n_strict::INT AS n_strict,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN n_strict > 0 OR n_soft >= {MIN_SOFT} THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

QUERIES = {"op11_collocations": op11_collocations, "op12_prefix_trie": op12_prefix_trie, "op13_url_filters": op13_url_filters}
SQL = {"op11_collocations": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_url_filters": OP13_SQL}
