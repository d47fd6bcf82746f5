"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATE = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws
  FROM benchmark
), spots AS (
  SELECT item_id, ws, least(13, len(ws)) size, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) i
  FROM b WHERE len(ws) > 0
), win AS (
  SELECT DISTINCT item_id, size, array_to_string(list_slice(ws, i, i + size - 1), ' ') gram FROM spots
), sizes AS (SELECT DISTINCT size FROM win),
places AS (
  SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) i FROM d, sizes WHERE len(ws) >= size
), hits AS (
  SELECT p.doc_id, p.size, p.i, w.item_id FROM (
    SELECT doc_id, size, i, array_to_string(list_slice(ws, i, i + size - 1), ' ') gram FROM places
  ) p JOIN win w USING (size, gram)
), words AS (
  SELECT doc_id, count(DISTINCT pos) n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) pos FROM (SELECT DISTINCT doc_id, size, i FROM hits)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) joined
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.ws)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items,
       sha256(coalesce(joined, '')) items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.ws) contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

MIXING = """
WITH sizes AS (
  SELECT source, sum(coalesce(length(text), 0)) chars, sqrt(sum(coalesce(length(text), 0))::DOUBLE) target
  FROM documents GROUP BY source
), rates AS (
  SELECT source, CASE WHEN chars = 0 THEN 1.0
    ELSE target / sum(target) OVER () * sum(chars) OVER () / chars END rate FROM sizes
), parts AS (
  SELECT d.*, r.rate, greatest(ceil(r.rate / 16), 1)::INT parts
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
), draws AS (
  SELECT *, rate / parts AS each,
    (('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, 'none') || ':' || part), 1, 13))::BIGINT + 0.5)
      / 4503599627370496.0 u
  FROM (SELECT *, unnest(range(1, parts + 1)) part FROM parts)
), terms AS (
  SELECT each, k, sum(p) OVER (PARTITION BY each ORDER BY k) cdf
  FROM (SELECT each, k, exp(-each + k * ln(each) - lgamma(k + 1)) p
        FROM (SELECT DISTINCT each FROM draws), range(0, 64) t(k))
), counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, d.rate, d.part, d.parts, count(t.k) n
  FROM draws d LEFT JOIN terms t ON t.each = d.each AND t.cdf < d.u
  GROUP BY ALL
), copies AS (
  SELECT doc_id, text, lang, source, n_chars, rate, sum(n)::INT mix_copies FROM counted GROUP BY ALL
)
SELECT doc_id, text, lang, source, n_chars, round(rate, 6) mix_rate, mix_copies, mix_copy::INT mix_copy,
  md5('11:' || coalesce(doc_id::VARCHAR, 'none') || ':' || mix_copy) mix_order
FROM (SELECT *, unnest(range(1, mix_copies + 1)) mix_copy FROM copies WHERE mix_copies > 0)
"""


def _decoded(text: str) -> str:
    for name, char in (
        ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"),
        ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&"),
    ):
        text = f"replace({text}, '{name.replace(chr(39), chr(39) * 2)}', '{char}')"
    return text


def _uuid(text: str) -> str:
    h = f"md5({text})"
    cuts = ", ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"'<urn:uuid:' || concat_ws('-', {cuts}) || '>'"


def _field(name: str, pattern: str) -> str:
    value = f"trim(regexp_replace({_decoded(f"regexp_extract(html, '{pattern}', 1)")}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN {value} <> '' THEN '{name}: ' || {value} || chr(13) || chr(10) ELSE '' END"


_TEXT = "regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<head\\b.*?</head\\s*>', ' ', 'g')"
_TEXT = (
    f"regexp_replace({_TEXT}, '(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|blockquote|pre)\\b[^>]*>',"
    " chr(10), 'g')"
)
_TEXT = _decoded(f"regexp_replace({_TEXT}, '(?s)<[/!?a-zA-Z][^>]*>', '', 'g')")
_TEXT = f"regexp_replace({_TEXT}, '[ \\t\\r\\f\\x0B]+', ' ', 'g')"
_TEXT = f"regexp_replace({_TEXT}, ' ?\\n[ \\n]*', chr(10), 'g')"
_TEXT = f"regexp_replace({_TEXT}, '^[ \\n]+|[ \\n]+$', '', 'g')"

WARC = f"""
WITH r AS (
  SELECT page_id, coalesce(url, '') url, coalesce(html, '') html FROM pages
), s AS (
  SELECT *, {_uuid("concat_ws(chr(31), 'response', coalesce(page_id::VARCHAR, ''), url, md5(html))")} rid FROM r
), d AS (
  SELECT *, 'metadata' kind, 'application/warc-fields' mime,
    {_field("title", "(?is)<title[^>]*>(.*?)</title")} || {_field("language", "(?i)<html[^>]*?\\slang=\"([^\"]*)\"")}
    || {_field("charset", "(?i)<meta[^>]*?charset=\"?([^\"\\s/>]+)")}
    || coalesce(array_to_string(list_transform(regexp_extract_all(html, '(?i)<a\\s[^>]*?href=\"([^\"]*)\"', 1),
         lambda u: 'outlink: ' || {_decoded("u")} || chr(13) || chr(10)), ''), '') block
  FROM s
  UNION ALL
  SELECT *, 'conversion', 'text/plain; charset=utf-8', {_TEXT} FROM s
)
SELECT page_id, kind record_type, {_uuid("concat_ws(chr(31), kind, rid)")} record_id, rid refers_to, url target_uri,
  mime content_type, strlen(block) content_length, 'sha256:' || sha256(block) block_digest,
  'sha256:' || sha256(html) source_digest,
  'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) source_headers, block
FROM d
"""

ORACLES = {"op3_decontaminate": DECONTAMINATE, "op4_poisson_mixing": MIXING, "op2_warc_derivatives": WARC}
