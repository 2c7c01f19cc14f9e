"""DuckDB SQL for the queries' rows, by the definitions alone."""

from __future__ import annotations

from tessera.llm.linededup import ORACLE_SQL as LINES

#: Bytes as hex digits, so that strings can be cut at any byte.
SUFFIX = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT rid, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT rid, h, unnest(range(greatest(len(h) // 2 - 199, 0))) AS i FROM d)
), often AS (
  SELECT k FROM w GROUP BY k HAVING count(*) > 1
), s AS (
  SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS p FROM w JOIN often USING (k)
), g AS (
  SELECT rid, i, sum(CASE WHEN p IS NULL OR i > p + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS grp FROM s
), spans AS (
  SELECT rid, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY rid, grp
), cuts AS (
  SELECT rid, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS x, a AS y FROM spans
  UNION ALL SELECT d.rid, coalesce(max(b), 0), any_value(len(h) // 2) FROM d LEFT JOIN spans USING (rid) GROUP BY d.rid
), kept AS (
  SELECT rid, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS h FROM cuts JOIN d USING (rid) GROUP BY rid
), n AS (
  SELECT rid, count(*) AS n_spans, sum(b - a) AS removed FROM spans GROUP BY rid
)
SELECT doc_id, len(d.h) // 2 AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM d JOIN kept USING (rid) LEFT JOIN n USING (rid)
"""


def _words(column: str) -> str:
    lower = f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"list_filter(string_split_regex({lower}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def _shingles(n: int) -> str:
    return f"CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')] ELSE list_transform(range(len(w) - {n - 1}), lambda i: array_to_string(w[i + 1 : i + {n}], ' ')) END"


PARTENUM = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_words("text")} AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct({_shingles(3)}) AS t FROM d
), e AS (
  SELECT doc_id, len(t) AS n, unnest(t) AS g FROM s
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS i FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM shared WHERE 100 * i >= 90 * (m + n - i)
), reach(x, y) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), low AS (
  SELECT x, min(y) AS y FROM reach GROUP BY x
)
SELECT s.doc_id, len(t) AS n_shingles, low.y AS component_id FROM s JOIN low ON low.x = s.doc_id
"""

DECONTAMINATE = f"""
WITH item AS (
  SELECT item_id, len(w) AS words, {_shingles(5)} AS t FROM (SELECT item_id, {_words("text")} AS w FROM benchmark) WHERE len(w) > 0
), weight AS (
  SELECT item_id, g, count(*) AS c FROM (SELECT item_id, unnest(t) AS g FROM item) GROUP BY ALL
), doc AS (
  SELECT row_number() OVER () AS rid, doc_id, len(w) AS words, {_shingles(5)} AS t FROM (SELECT doc_id, {_words("text")} AS w FROM documents) WHERE len(w) > 0
), place AS (
  SELECT rid, unnest(range(len(t))) AS pos, unnest(t) AS g FROM doc
), hit AS (
  SELECT rid, item_id, pos, g, c FROM place JOIN weight USING (g)
), pair AS (
  SELECT DISTINCT rid, doc_id, item_id, least(item.words, doc.words) AS len, greatest(least(item.words, doc.words) - 4, 1) AS width, len(item.t) AS total, greatest(doc.words - item.words, 0) AS last
  FROM hit JOIN doc USING (rid) JOIN item USING (item_id)
), start AS (
  SELECT *, unnest(range(last + 1)) AS s FROM pair
), part AS (
  SELECT rid, item_id, s, g, least(count(*), any_value(c)) AS n FROM start JOIN hit USING (rid, item_id) WHERE pos >= s AND pos < s + width GROUP BY ALL
), score AS (
  SELECT rid, item_id, s, sum(n) AS i FROM part GROUP BY ALL
), best AS (
  SELECT doc_id, item_id, i / (width + total - i) AS v, s, len, row_number() OVER (PARTITION BY rid, item_id ORDER BY i DESC, s) AS r FROM score JOIN pair USING (rid, item_id)
)
SELECT doc_id, item_id, round(v, 6) AS similarity, s AS first_word, len AS n_words FROM best WHERE r = 1 AND v >= 0.8
"""

MEDIA = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) AS n FROM documents),
p AS (SELECT doc_id, n, CASE WHEN n = 0 THEN 192 ELSE (192 - n % 192) % 192 END AS pad, t FROM d)
SELECT doc_id, n AS n_bytes, n + pad AS payload_bytes, sha256(t || repeat(' ', pad)) AS payload_sha256 FROM p
"""


def url_rules(rules) -> str:
    """host, path and the longest fitting rule of each page."""
    fits = " ".join(
        f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{host}{path}'"
        for host, path in sorted(((t[: t.index("/")], t[t.index("/") :]) for _, t in rules), key=lambda x: (-len(x[0] + x[1]), -len(x[0])))
    )
    lower = "translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, {lower} AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM p)
SELECT page_id, host, path, CASE {fits} END AS rule FROM q
"""


PII = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
    list_transform(regexp_extract_all(t, '[0-9]([ -]?[0-9])+'), lambda x: regexp_replace(x, '[ -]', '', 'g')) AS card,
    list_transform(regexp_extract_all(t, '\+[0-9][ ().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phone FROM d
)
SELECT doc_id, len(email)::BIGINT AS n_email,
  len(list_filter(ip, lambda x: len(list_filter(string_split(x, '.'), lambda g: length(ltrim(g, '0')) > 3 OR coalesce(TRY_CAST(ltrim(g, '0') AS INTEGER), 0) > 255)) = 0))::BIGINT AS n_ip,
  len(list_filter(card, lambda x: length(x) BETWEEN 14 AND 19 AND list_sum(list_transform(range(length(x)), lambda i:
    CASE WHEN i % 2 = 1 THEN 2 * reverse(x)[i + 1]::INTEGER - CASE WHEN reverse(x)[i + 1]::INTEGER > 4 THEN 9 ELSE 0 END ELSE reverse(x)[i + 1]::INTEGER END)) % 10 = 0))::BIGINT AS n_card,
  len(list_filter(phone, lambda x: length(x) BETWEEN 10 AND 15))::BIGINT AS n_phone FROM m
"""

ORACLE_SQL = {"op1_lines": LINES, "op2_suffix": SUFFIX, "op3_decontaminate": DECONTAMINATE, "op7_partenum": PARTENUM, "media_payloads": MEDIA, "pii_counts": PII}
