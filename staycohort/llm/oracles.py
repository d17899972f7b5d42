"""The queries that SQL can express, as SQL for DuckDB."""

from staycohort.llm import queries as q

_HOST = r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)"
_LOWER = f"translate({_HOST}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NAMED = f"regexp_matches(host, '(^|[.-])({'|'.join(q.BLOCKED_HOST_WORDS)})([.-]|$)')"
_PARTS = " OR ".join(f"contains(path || '/', '/{part}/')" for part in q.BLOCKED_PATH_PARTS)
_BLOCKED = f"{_NAMED} OR {_PARTS}"
_BASE = ", ".join(
    f"('{verdict}', '{rule}', '{rule.split('/', 1)[0]}', '/{rule.split('/', 1)[1]}')"
    for verdict, rule in q.BASE_URL_RULES
)

OP7 = f"""
WITH located AS (
  SELECT page_id, {_LOWER} AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
),
base(b_verdict, b_rule, b_host, b_path) AS (VALUES {_BASE}),
judged AS (
  SELECT page_id, host, path,
         (SELECT max_by(struct_pack(r := b_rule, v := b_verdict), length(b_rule)) FROM base
          WHERE (host = b_host OR ends_with(host, '.' || b_host))
            AND starts_with(path, b_path)) AS best
  FROM located
)
SELECT page_id, host, path, best.r AS rule,
       CASE WHEN best IS NOT NULL THEN best.v
            WHEN {_BLOCKED} THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""

OP8 = f"""
WITH present AS (
  SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {q.MIXING_EXPONENT}) AS w FROM documents GROUP BY source
),
rates AS (
  SELECT source, CAST(printf('%.8e', w / sum(w) OVER () * sum(n) OVER () / n) AS DOUBLE) AS rate FROM present
),
steps AS (
  SELECT source, k,
         sum(exp(-rate + k * ln(rate) - lgamma(k + 1)))
           OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS total
  FROM rates, range(0, 400) AS numbers(k)
),
drawn AS (
  SELECT *, CAST('0x' || substr(md5('{q.MIXING_SEED}|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13) AS BIGINT)
            / pow(2::DOUBLE, 52) AS u
  FROM documents
),
counted AS (
  SELECT d.*, (SELECT count(*) FROM steps s
               WHERE s.source IS NOT DISTINCT FROM d.source AND s.total <= d.u) AS copies
  FROM drawn d
)
SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS copy
FROM counted WHERE copies > 0
"""

OP13 = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, ''))) AS size,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS largest
  FROM pages
)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN size >= 1000 AND page_id <> largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN size >= 1000 AND page_id <> largest THEN largest END AS refers_to
FROM payloads
"""

ORACLE_SQL = {
    "op7_url_filters": OP7,
    "op8_source_mixing": OP8,
    "op13_warc": OP13,
}
