"""SQL for DuckDB that gives the rows of the queries that SQL can express."""

from loomfield.llm.common import LOWER, UPPER
from loomfield.llm.license_scan import BLOCK, KEYS, OTHER, PHRASES, TEMPLATES
from loomfield.llm.pii import CHANCE, MANY, NEAR, REACH
from loomfield.llm.url_filter import RULES

NGRAM_JOIN = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)
), z AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN z zx ON zx.doc_id = x JOIN z zy ON zy.doc_id = y WHERE 100 * k >= 80 * (zx.n + zy.n - k)
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
)
SELECT d.doc_id AS doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, r.c AS component_id
FROM documents d LEFT JOIN z USING (doc_id) JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) r ON r.x = d.doc_id
"""

DECONTAMINATION = r"""
WITH t AS (
  SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
), w AS (
  SELECT kind, id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM t
), s AS (
  SELECT DISTINCT kind, id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT kind, id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)
), z AS (
  SELECT id, count(*) AS n FROM s WHERE kind = 1 GROUP BY id
)
SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared, any_value(z.n) AS n_item, count(*)::DOUBLE / any_value(z.n) AS containment
FROM s d JOIN s b ON d.g = b.g AND d.kind = 0 AND b.kind = 1 JOIN z ON z.id = b.id
GROUP BY d.id, b.id HAVING count(*) * 100 >= any_value(z.n) * 80
"""


def _row(*values: str | None) -> str:
    return "(" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + ")"


def _key(label: str, template: str) -> str | None:
    """The key phrase of a template that holds it."""
    return KEYS[label] if f" {KEYS.get(label, '-')} " in f" {template} " else None


def license_scan() -> str:
    """Every block of every text against every template, and every place of every phrase."""
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), phrases AS (
  SELECT label, string_split(p, ' ') AS p FROM (VALUES {", ".join(_row(label, p) for p, label in PHRASES.items())}) v(label, p)
), places AS (
  SELECT r, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(p)] = p)) AS start FROM d, phrases WHERE list_contains(w, p[-1])
), templates AS (
  SELECT label, list_distinct(string_split(t, ' ')) AS t, string_split(k, ' ') AS k FROM (VALUES {", ".join(_row(label, t, _key(label, t)) for label, t in TEMPLATES)}) v(label, t, k)
), keys AS (
  SELECT r, k, list_filter(range(len(w)), lambda i: w[i + 1:i + len(k)] = k AND coalesce(w[i + len(k) + 1], '') NOT IN {_row(*OTHER)}) AS found FROM d, (SELECT DISTINCT k FROM templates WHERE k IS NOT NULL) WHERE list_contains(w, k[1])
), blocks AS MATERIALIZED (
  SELECT r, i, list_distinct(w[i + 1:i + {BLOCK}]) AS b FROM (SELECT r, w, unnest(range(0, len(w), {BLOCK // 2})) AS i FROM d)
), shares AS (
  SELECT b.r, t.label, len(list_intersect(t.t, b.b)) AS n, len(t.t) AS m
  FROM blocks b CROSS JOIN templates t LEFT JOIN keys k ON k.r = b.r AND k.k = t.k
  WHERE t.k IS NULL OR len(list_filter(k.found, lambda p: p BETWEEN b.i AND b.i + {BLOCK} - len(t.k))) > 0
), notices AS (
  SELECT r, label, n::DOUBLE / m AS share FROM shares WHERE 100 * n >= 80 * m
), base AS (
  SELECT r, count(*) AS n, min(start) AS a, max(start) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY r
), every AS (
  SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM places UNION ALL SELECT r, label FROM notices) GROUP BY r
)
SELECT d.doc_id AS doc_id, len(d.w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.a::BIGINT AS first_word, b.z::BIGINT AS last_word,
  coalesce(b.labels, '') AS base_labels, coalesce(e.labels, '') AS labels, CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(s.share, 0) END::DOUBLE AS score
FROM d LEFT JOIN base b USING (r) LEFT JOIN every e USING (r) LEFT JOIN (SELECT r, max(share) AS share FROM notices GROUP BY r) s USING (r)
"""


def url_filter() -> str:
    """All combinations of the tokens of each url that are frequent, as rules."""
    longest = sorted(RULES, key=lambda r: -len(r[1]) - len(r[2]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')" for _, h, p in longest]
    rule = " ".join(f"WHEN {f} THEN '{h}/{p}'" for f, (_, h, p) in zip(fits, longest, strict=True))
    given = " ".join(f"WHEN {f} THEN '{kind}'" for f, (kind, _, _) in zip(fits, longest, strict=True))
    last = "array_to_string(list_slice(labels, greatest(len(labels) - {} + 1, 1), len(labels)), '.')".format
    return rf"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), urls AS (
  SELECT *, CASE {rule} END AS rule, CASE {given} END AS given, list_filter(string_split(host, '.'), lambda x: x <> '') AS labels FROM parts
), sets AS (
  SELECT host, path, coalesce(any_value(given), 'none') AS given,
    list_distinct(list_transform([{last(1)}, {last(2)}, host], lambda x: 'd:' || x)
      || list_transform(flatten(list_transform(list_slice(labels, 1, greatest(len(labels) - 2, 0)), lambda x: string_split(x, '-'))), lambda x: 'h:' || x)
      || list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x, i: 'p' || (i - 1) || ':' || x)) AS tokens
  FROM urls WHERE len(labels) > 0 GROUP BY host, path, labels
), size AS (
  SELECT count(*)::DOUBLE AS n, ceil(greatest(0.002::DOUBLE, least(5 / count(*)::DOUBLE, 1)) * count(*)) AS least FROM sets
), frequent AS (
  SELECT token FROM (SELECT unnest(tokens) AS token FROM sets) GROUP BY token HAVING count(*) >= (SELECT least FROM size)
), short AS (
  SELECT host, path, given, list(token ORDER BY token) AS tokens FROM (SELECT host, path, given, unnest(tokens) AS token FROM sets) JOIN frequent USING (token) GROUP BY host, path, given
), chosen AS (
  SELECT given, list_filter(tokens, lambda x, i: mask >> (i - 1) & 1 = 1) AS ruled FROM (SELECT given, tokens, unnest(range(1, 1::BIGINT << len(tokens))) AS mask FROM short)
), counted AS (
  SELECT ruled, given AS label, count(*)::DOUBLE AS n, (sum(count(*)) OVER (PARTITION BY ruled))::DOUBLE AS n_ruled FROM chosen GROUP BY ruled, given
), mined AS (
  SELECT ruled, c.label, c.n / n_ruled AS confidence, c.n / n_ruled / (l.n / s.n) AS lift, c.n / s.n AS support
  FROM counted c JOIN (SELECT given AS label, count(*)::DOUBLE AS n FROM sets GROUP BY given) l USING (label), size s
  WHERE c.n >= s.least AND c.n / n_ruled >= 0.8::DOUBLE AND c.n / n_ruled / (l.n / s.n) >= 1.2::DOUBLE
), kept AS (
  SELECT * FROM mined a WHERE NOT EXISTS (
    SELECT 1 FROM mined b WHERE b.label = a.label AND len(b.ruled) = len(a.ruled) - 1 AND list_has_all(a.ruled, b.ruled) AND b.confidence >= a.confidence)
), best AS (
  SELECT host, path, label, array_to_string(ruled, ' ') AS mined
  FROM short JOIN kept ON list_has_all(tokens, ruled) WHERE given = 'none'
  QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY lift DESC, confidence DESC, support DESC, len(ruled) DESC, array_to_string(ruled, ' ') DESC, label DESC) = 1
)
SELECT u.page_id AS page_id, u.host AS host, u.path AS path, u.rule AS rule, coalesce(u.given, nullif(b.label, 'none'), 'allow') AS verdict, b.mined AS mined
FROM urls u LEFT JOIN best b ON u.given IS NULL AND b.host = u.host AND b.path = u.path
"""


#: Plain patterns of personal data and what their matches must hold, by kind in the order of results.
_PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(v, '.'), lambda x: len(ltrim(x, '0')) > 3 OR coalesce(try_cast(ltrim(x, '0') AS INT), 0) > 255)) = 0"),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", "len(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(len(digits)), lambda i: ord(substr(digits, len(digits) - i::INT, 1)) - 48 + i % 2 * (ord(substr(digits, len(digits) - i::INT, 1)) - 48 - CASE WHEN substr(digits, len(digits) - i::INT, 1) > '4' THEN 9 ELSE 0 END))) % 10 = 0"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "len(digits) BETWEEN 9 AND 15"),
}


def pii() -> str:
    """Spans by the plain patterns, disclosing terms over all distinct texts, and every place of these outside spans."""
    letters = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
    black = r"[^\t\n\x0B\f\r ]+"
    place = lambda text, what: f"regexp_extract_all({text}, '(?s)(.*?)({what})', 1) AS g, regexp_extract_all({text}, '(?s)(.*?)({what})', 2) AS m"
    start = "sum(len(g)) OVER (PARTITION BY {0} ORDER BY i) + coalesce(sum(len(v)) OVER (PARTITION BY {0} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)".format
    words = lambda text: f"list_filter(regexp_extract_all(lower(regexp_replace({text}, '{_PLAIN['email'][0]}', ' ', 'g')), '{letters}'), lambda w: len(w) >= 3)"
    found = " UNION ALL ".join(f"SELECT t, {k} AS o, '{kind}' AS kind, {place('text', what)} FROM texts" for k, (kind, (what, _)) in enumerate(_PLAIN.items()))
    valid = " ".join(f"WHEN '{kind}' THEN {ok}" for kind, (_, ok) in _PLAIN.items())
    return rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), texts AS MATERIALIZED (
  SELECT row_number() OVER () AS t, text FROM (SELECT DISTINCT text FROM d)
), found AS (
  SELECT t, o, kind, unnest(g) AS g, unnest(m) AS v, unnest(range(len(g))) AS i FROM ({found})
), spans AS MATERIALIZED (
  SELECT t, o, kind, v, s, s + len(v) AS e
  FROM (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS digits, ({start("t, kind")})::BIGINT AS s FROM found) WHERE CASE kind {valid} END
), sides AS (
  SELECT kind, lower(v) AS entity, t, len(text) AS n, s, e, substr(text, greatest(s - {REACH} + 1, 1), least(s, {REACH})) AS b, substr(text, e + 1, {REACH}) AS a FROM spans JOIN texts USING (t)
), cut AS (
  SELECT kind, entity, t, {words(f"CASE WHEN s > {REACH} THEN regexp_replace(b, '^{black}', '') ELSE b END")} AS b,
    {words(rf"CASE WHEN n > e + {REACH} THEN regexp_replace(a, '{black}(\r\n|[\n\r])?$', '\1') ELSE a END")} AS a FROM sides
), near AS (
  SELECT term, kind, entity, t, count(*) AS n
  FROM (SELECT kind, entity, t, unnest(list_slice(b, greatest(len(b) - {NEAR} + 1, 1), len(b)) || list_slice(a, 1, {NEAR})) AS term FROM cut) GROUP BY ALL
), places AS (
  SELECT term, count(*) AS n_all FROM (SELECT unnest({words("text")}) AS term FROM texts) GROUP BY term
), whole AS (
  SELECT sum(n_all)::DOUBLE AS total, count(*)::DOUBLE AS terms FROM places
), kinds AS (
  SELECT kind, least(sum(n) / any_value(total), 1) AS p_kind FROM near, whole GROUP BY kind
), entities AS (
  SELECT kind, entity, least(sum(n) / any_value(total), 1) AS p FROM near, whole GROUP BY kind, entity
), weighed AS (
  SELECT term, n_texts, n_near, p, p_kind FROM (SELECT term, kind, entity, count(*) AS n_texts, sum(n) AS n_near FROM near GROUP BY term, kind, entity) JOIN entities USING (kind, entity) JOIN kinds USING (kind)
  UNION ALL
  SELECT term, n_texts, n_near, p_kind, p_kind FROM (SELECT term, kind, count(DISTINCT t) AS n_texts, sum(n) AS n_near FROM near GROUP BY term, kind) JOIN kinds USING (kind)
), terms AS MATERIALIZED (
  SELECT DISTINCT term FROM weighed JOIN places USING (term), whole
  WHERE n_texts >= 2 AND p < 1 AND ln(least(n_near::DOUBLE / n_all, 1) / p) / -ln(p) >= 0.9
    AND ((n_texts - 1) * -ln(p) - ln(p_kind) >= ln(terms / {CHANCE}) OR n_texts >= {MANY})
), runs AS (
  SELECT t, v, ({start("t")})::BIGINT AS s
  FROM (SELECT t, unnest(g) AS g, unnest(m) AS v, unnest(range(len(g))) AS i FROM (SELECT t, {place("lower(text)", letters)} FROM texts WHERE list_has_any(regexp_extract_all(lower(text), '{letters}'), (SELECT coalesce(list(term), []) FROM terms))))
), every AS (
  SELECT t, o, kind, s, e FROM spans
  UNION ALL
  SELECT t, {len(_PLAIN)}, 'term', s, s + len(v) FROM runs r
  WHERE v IN (SELECT term FROM terms) AND NOT EXISTS (SELECT 1 FROM spans x WHERE x.t = r.t AND x.s < r.s + len(r.v) AND r.s < x.e)
), listed AS (
  SELECT t, {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in _PLAIN)},
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) FILTER (kind <> 'term') AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) AS spans
  FROM every GROUP BY t
)
SELECT d.doc_id AS doc_id, {", ".join(f"coalesce(n_{kind}, 0)::BIGINT AS n_{kind}" for kind in _PLAIN)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d JOIN texts USING (text) LEFT JOIN listed USING (t)
"""


#: Every term's share in every group of a language, the rarest ones too, compared group by group.
DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (
  SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 30
), g AS (
  SELECT DISTINCT lang, source FROM d
), v AS (
  SELECT l.lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN k ON k.lang = l.lang GROUP BY l.lang
), c AS (
  SELECT g.lang, g.source, k.term, count(w.i) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN w ON w.lang = g.lang AND w.source = g.source AND w.term = k.term GROUP BY ALL
), s AS (
  SELECT lang, source, term, n, (1 + 1000000000::HUGEINT * (n + 5) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v))::BIGINT AS p FROM c JOIN v USING (lang)
), l AS (
  SELECT lang, term, (1 + 1000000000::HUGEINT * (n + 5) // (sum(n) OVER (PARTITION BY lang) + 5 * v))::BIGINT AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term) JOIN v USING (lang)
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s x ON x.lang = a.lang AND x.source = a.source LEFT JOIN s y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source
  UNION ALL
  SELECT s.lang, s.source, 'term', s.term, s.p - l.q FROM s JOIN l USING (lang, term) WHERE s.n > 0 AND s.p > l.q
)
SELECT * FROM (SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r) WHERE part = 'pair' OR rank <= 50
"""
