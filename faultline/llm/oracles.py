"""SQL that must give the rows of the corpus queries that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_KEYWORD = r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_PATTERNS = (_KEYWORD, "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}", "[A-Za-z0-9+/_-]{20,}")


def _matches(kind: int, pattern: str) -> str:
    found = f"regexp_extract_all(body, '{pattern}')"
    value = f"regexp_extract_all(body, '{pattern}', 2)" if kind == 0 else found
    return (
        f"SELECT doc_id, source, {kind} AS kind, unnest(range(len({found}))) AS nth, unnest({found}) AS found, "
        f"unnest({value}) AS value, unnest(string_split_regex(body, '{pattern}')[:len({found})]) AS gap FROM texts "
        f"WHERE len({found}) > 0"
    )


SECRETS = f"""WITH texts AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS body FROM documents),
  matches AS MATERIALIZED ({" UNION ALL ".join(_matches(k, p) for k, p in enumerate(_PATTERNS))}),
  placed AS (SELECT *, sum(length(gap) + length(found)) OVER (PARTITION BY doc_id, kind ORDER BY nth) AS past FROM matches),
  spans AS MATERIALIZED (SELECT doc_id, source, kind, value, (past - length(found))::bigint AS first, past::bigint AS past
    FROM placed WHERE CASE kind WHEN 0 THEN length(value) >= 8 WHEN 3 THEN regexp_matches(value, '[A-Z]')
      AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[0-9]') ELSE true END),
  owners AS (SELECT value, count(DISTINCT source) AS n FROM spans GROUP BY value),
  base AS (SELECT * FROM spans WHERE kind < 3),
  kept AS MATERIALIZED (SELECT s.*, o.n < 3 AS live FROM spans s JOIN owners o USING (value) WHERE s.kind < 3 OR (o.n < 3
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = s.doc_id AND b.first < s.past AND b.past > s.first))),
  named AS (SELECT *, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || first || ':' || past AS span FROM kept),
  each AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
      count(*) FILTER (kind = 2) AS n_hex, string_agg(span, ',' ORDER BY first, kind) FILTER (kind < 3) AS base,
      string_agg(span, ',' ORDER BY first, kind) AS spans, count(*) FILTER (live) AS n_live,
      count(*) FILTER (NOT live) AS n_example FROM named GROUP BY doc_id)
  SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
    coalesce(n_example, 0) AS n_example FROM texts LEFT JOIN each USING (doc_id)"""

MIXING = r"""WITH sized AS MATERIALIZED (SELECT doc_id, source, md5(coalesce(text, '')) AS digest,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint AS size FROM documents),
  keyed AS (SELECT *, md5(concat_ws('|', 'mix', doc_id::varchar, digest)) AS key FROM sized),
  sources AS (SELECT source, sum(size)::bigint AS source_size FROM sized GROUP BY source),
  weighted AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight,
    3 * source_size AS room FROM sources),
  shares AS (SELECT *, sum(source_size) OVER () - coalesce(sum(room) OVER (by_room ROWS BETWEEN UNBOUNDED PRECEDING
      AND 1 PRECEDING), 0) AS rest, sum(weight) OVER (by_room ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
    FROM weighted WINDOW by_room AS (ORDER BY room::double / weight, source ASC NULLS LAST)),
  level AS (SELECT arg_max(rest, open_weight)::double AS rest, max(open_weight)::double AS open_weight FROM shares
    WHERE rest * weight <= room * open_weight),
  targets AS (SELECT s.source, s.source_size, least(s.room::double, l.rest / l.open_weight * s.weight) AS target
    FROM shares s, level l),
  budgets AS (SELECT *, floor(target)::bigint AS budget,
    CASE WHEN source_size > 0 THEN floor(target)::bigint // source_size ELSE 0 END AS passes FROM targets),
  placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM keyed)
  SELECT p.doc_id, p.size, b.source_size, b.target, (b.passes * p.size
      + greatest(0, least(p.size, b.budget - b.passes * b.source_size - p.earlier)))::bigint AS taken
    FROM placed p JOIN budgets b ON p.source IS NOT DISTINCT FROM b.source"""


def _words(table: str, key: str) -> str:
    return (
        f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), "
        rf"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table}"
    )


DECONTAMINATION = f"""WITH items AS MATERIALIZED ({_words("benchmark", "item_id")}),
  docs AS MATERIALIZED ({_words("documents", "doc_id")}),
  windows AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(
    range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS gram FROM items WHERE len(w) > 0),
  sizes AS (SELECT DISTINCT n FROM windows),
  grams AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS pos, unnest(list_transform(range(1, len(w) - n + 2),
    lambda i: array_to_string(w[i:i + n - 1], ' '))) AS gram FROM docs, sizes WHERE len(w) >= n),
  hits AS MATERIALIZED (SELECT DISTINCT doc_id, pos, n, item_id FROM grams JOIN windows USING (gram, n)),
  hit_words AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS word FROM hits)
    GROUP BY doc_id),
  found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT doc_id, item_id::varchar AS item FROM hits) GROUP BY doc_id)
  SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN found USING (doc_id)"""

ARCHIVES = """WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
  firsts AS (SELECT payload, min(page_id) AS first_id FROM payloads WHERE strlen(payload) >= 100 GROUP BY payload)
  SELECT page_id, strlen(payload)::bigint AS payload_bytes, sha256(payload) AS payload_digest,
    CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first_id <> page_id THEN first_id END AS refers_to
    FROM payloads LEFT JOIN firsts USING (payload)"""

FILTER_AUDIT = r"""WITH texts AS MATERIALIZED (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body FROM documents),
  sized AS (SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS w FROM texts),
  judged AS (SELECT doc_id, max((quality = 1)::int) AS good, max((toxic = 1)::int) AS toxic FROM labels GROUP BY doc_id),
  firsts AS (SELECT body, min(doc_id) AS least FROM texts GROUP BY body),
  marked AS MATERIALIZED (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
      (len(w) < 100)::int + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int
      + 4 * (100 * len(regexp_extract_all(body, '[A-Z]')) > 10 * length(body))::int
      + 8 * regexp_matches(body, '[#$%&*|]')::int + 16 * coalesce(doc_id > least, false)::int AS mask
    FROM sized LEFT JOIN judged USING (doc_id) JOIN firsts USING (body)),
  tallies AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM marked GROUP BY ALL),
  letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
  orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
  steps AS (SELECT filter_order, step, 1 << (instr('ABCDE', filter_order[step]) - 1) AS own,
      list_sum(list_transform(range(1, step), lambda i: 1 << (instr('ABCDE', filter_order[i]) - 1))) AS earlier
    FROM orders, (SELECT unnest(range(1, 6))::int AS step)),
  seen AS (SELECT part, filter_order, step, own, n, good, toxic, mask = own AS alone, mask & own > 0 AS fails,
      mask & coalesce(earlier, 0)::int > 0 AS gone FROM steps, tallies),
  counted AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::bigint AS kept,
      coalesce(sum(n) FILTER (fails AND NOT gone), 0)::bigint AS removed,
      coalesce(sum(n) FILTER (fails AND gone), 0)::bigint AS redundant,
      coalesce(sum(n) FILTER (alone), 0)::bigint AS unique_fails,
      coalesce(sum(good) FILTER (fails AND NOT gone), 0)::bigint AS good_lost,
      coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::bigint AS toxic_lost FROM seen GROUP BY ALL)
  SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::bigint AS shapley FROM counted"""

COLLOCATIONS = rf"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
  split AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
  grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
    FROM split, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k),
  counts AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
  totals AS (SELECT lang, sum(f)::bigint AS n FROM counts WHERE k = 1 GROUP BY lang),
  cand AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 10),
  cuts AS (SELECT lang, phrase, f AS a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS rest
    FROM cand, (SELECT unnest([1, 2]) AS cut) WHERE cut < k),
  scored AS (SELECT c.lang, c.phrase, a, cut, x.f AS l, y.f AS r, ((1000000::hugeint * a * a) // (x.f::hugeint * y.f))::bigint AS score
    FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = head JOIN counts y ON y.lang = c.lang AND y.phrase = rest),
  worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
  inner_pairs AS (SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, f FROM cand WHERE k = 3),
  longer AS (SELECT lang, phrase, max(f) AS f FROM inner_pairs GROUP BY ALL),
  kept AS (SELECT w.* FROM worst w LEFT JOIN longer g USING (lang, phrase) WHERE g.f IS NULL OR 100 * g.f < 50 * w.a)
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000"""
