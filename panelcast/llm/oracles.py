"""SQL twins of the text queries that SQL can express, for DuckDB."""

SPLIT = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP = f"""
WITH split AS (SELECT doc_id, {SPLIT} AS ws FROM documents),
starts AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM split)),
repeats AS (SELECT k, min(doc_id) AS smallest FROM starts GROUP BY k HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS p
  FROM (SELECT s.doc_id, s.i FROM starts s JOIN repeats USING (k) WHERE smallest < s.doc_id)),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM split),
kept AS (
  SELECT w.doc_id, string_agg(w, ' ' ORDER BY w.p) AS kept_text, COUNT(*) AS n_kept
  FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.p = g.p WHERE g.p IS NULL GROUP BY w.doc_id)
SELECT s.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
       CAST(len(ws) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept_text, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id
"""


def _apportion(parties: str, out: str, group: str, votes: str, seats: str, order: str) -> str:
    """Seats by highest quotients: sure ones by a large divisor, the rest by rank of what is left."""
    return f"""
{out}_total AS (
  SELECT *, SUM({votes}) OVER ({group}) AS total,
         SUM(CAST({votes} > 0 AS INTEGER)) OVER ({group}) / 2.0 + 1 AS spare FROM {parties}),
{out}_low AS (
  SELECT *, CASE WHEN {votes} > 0 THEN
    greatest(floor({votes} / total * greatest({seats} - spare, 0) + 0.5), 0) ELSE 0 END AS low,
    CASE WHEN {votes} > 0 THEN floor({votes} / total * ({seats} + spare) + 0.5) ELSE 0 END AS high
  FROM {out}_total),
{out}_seat AS (
  SELECT *, unnest(range(CAST(low AS BIGINT) + 1, CAST(high AS BIGINT) + 1)) AS seat,
         {seats} - low_sum AS left_over
  FROM (SELECT *, SUM(low) OVER ({group}) AS low_sum FROM {out}_low)),
{out}_won AS (
  SELECT {order}, COUNT(*) AS won FROM (
    SELECT *, row_number() OVER ({group} ORDER BY CAST({votes} AS DOUBLE) / (2 * seat - 1) DESC,
      {', '.join(f'{c} ASC NULLS LAST' for c in order.split(', '))}, seat) AS place FROM {out}_seat)
  WHERE place <= left_over GROUP BY {order}),
{out} AS (
  SELECT l.*, CAST(low + coalesce(won, 0) AS BIGINT) AS quota FROM {out}_low l LEFT JOIN {out}_won w
  ON {' AND '.join(f'l.{c} IS NOT DISTINCT FROM w.{c}' for c in order.split(', '))})"""


MIXTURE = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len({SPLIT}) AS BIGINT) AS size, md5(concat_ws(':', '8', doc_id)) AS place
  FROM documents),
docs AS (
  SELECT *, CAST('0x' || substr(place, 1, 12) AS BIGINT)
         % greatest(1, CAST(ceil((SELECT COUNT(*) FROM documents) / 2048.0) AS BIGINT)) AS shard
  FROM sized),
parts AS (SELECT source, shard, CAST(SUM(size) AS BIGINT) AS shard_size FROM docs GROUP BY source, shard),
ranked AS (
  SELECT source, source_size, 3 * source_size AS full_size,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight
  FROM (SELECT source, CAST(SUM(shard_size) AS BIGINT) AS source_size FROM parts GROUP BY source)),
levels AS (
  SELECT *, CAST(SUM(source_size) OVER () - coalesce(SUM(full_size) OVER b, 0) AS DOUBLE)
         / (SUM(weight) OVER () - coalesce(SUM(weight) OVER b, 0)) AS level
  FROM ranked
  WINDOW b AS (ORDER BY CAST(full_size AS DOUBLE) / weight, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least(CAST(full_size AS DOUBLE), MAX(level) OVER () * weight) AS target,
         CAST(round(SUM(source_size) OVER () / 64.0) AS BIGINT) AS blocks
  FROM levels),{_apportion('targets', 'by_source', '', 'target', 'blocks', 'source')},
shards AS (
  SELECT p.source, p.shard, p.shard_size, s.source_size, s.target, s.quota AS source_blocks
  FROM parts p JOIN by_source s ON p.source IS NOT DISTINCT FROM s.source),
{_apportion('shards', 'by_shard', 'PARTITION BY source', 'shard_size', 'source_blocks', 'source, shard')},
cut AS (
  SELECT *, words // greatest(shard_size, 1) AS whole, greatest(CAST(round(shard_size / 64.0) AS BIGINT), 1) AS pieces
  FROM (SELECT *, least(quota * 64, 3 * shard_size) AS words FROM by_shard)),
wanted AS (
  SELECT *, CAST(CASE WHEN shard_size > 0 THEN round((words - whole * shard_size) * pieces / CAST(shard_size AS DOUBLE)) ELSE 0 END AS BIGINT) AS part_blocks
  FROM cut),
blocks AS (
  SELECT source, shard, part_blocks, block, CAST(block * shard_size // pieces AS BIGINT) AS low, CAST((block + 1) * shard_size // pieces AS BIGINT) AS high,
         CAST('0x' || substr(md5(concat_ws(':', '8', coalesce(source, ''), shard, block)), 1, 12) AS BIGINT) AS chance
  FROM (SELECT *, unnest(range(0, pieces)) AS block FROM wanted WHERE part_blocks > 0)),
selected AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, shard ORDER BY chance, block) AS place FROM blocks) WHERE place <= part_blocks),
stream AS (
  SELECT *, row_number() OVER () AS r,
         coalesce(SUM(size) OVER (PARTITION BY source, shard ORDER BY place, doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun
  FROM docs),
shares AS (
  SELECT r, SUM(least(high, begun + size) - greatest(low, begun)) AS words
  FROM stream s JOIN selected b ON s.source IS NOT DISTINCT FROM b.source AND s.shard = b.shard
       AND b.low < s.begun + s.size AND s.begun < b.high AND s.size > 0 GROUP BY r)
SELECT s.doc_id, s.size, w.source_size, w.target, CAST(w.whole * s.size + coalesce(o.words, 0) AS BIGINT) AS taken
FROM stream s JOIN wanted w ON s.source IS NOT DISTINCT FROM w.source AND s.shard = w.shard LEFT JOIN shares o ON s.r = o.r
"""

BYTE_DEDUP = """
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(regexp_replace(hex(coalesce(text, '')), '(..)', '\\1 ', 'g'), ' ') AS xs
  FROM documents),
bytes AS (
  SELECT r, doc_id, unnest(xs) AS b, unnest(range(0, len(xs))) AS i FROM texts),
windows AS (
  SELECT r, doc_id, b, i, COUNT(*) OVER w AS n, string_agg(b, '') OVER w AS k
  FROM bytes WHERE b <> '' WINDOW w AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
least AS (SELECT k, MIN(doc_id) AS smallest FROM windows WHERE n = 50 GROUP BY k),
hits AS (
  SELECT w.r, w.doc_id, w.b, w.i, CAST(n = 50 AND smallest < w.doc_id AS INTEGER) AS hit
  FROM windows w LEFT JOIN least USING (k)),
covered AS (
  SELECT *, coalesce(MAX(hit) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS gone FROM hits),
edged AS (SELECT *, coalesce(LAG(gone) OVER (PARTITION BY r ORDER BY i), 0) AS before FROM covered),
sums AS (
  SELECT r, COUNT(*) AS n_bytes, SUM(gone) AS n_removed, SUM(CAST(gone = 1 AND before = 0 AS INTEGER)) AS n_spans,
         string_agg(b, '' ORDER BY i) FILTER (WHERE gone = 0) AS kept
  FROM edged GROUP BY r)
SELECT t.doc_id, CAST(coalesce(n_bytes, 0) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM texts t LEFT JOIN sums s ON t.r = s.r
"""

DIVERGENCE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
once AS (
  SELECT doc, lang, source, term, COUNT(*) AS n
  FROM (SELECT doc, lang, source, unnest(terms) AS term FROM docs) GROUP BY ALL),
counts AS (SELECT lang, source, term, SUM(n) AS n, COUNT(*) AS docs FROM once GROUP BY ALL),
kept AS (SELECT lang, term, SUM(n) AS n FROM counts GROUP BY ALL HAVING SUM(docs) >= 30),
langs AS (SELECT lang, SUM(n) AS total, COUNT(*) AS v FROM kept GROUP BY ALL),
groups AS (
  SELECT g.lang, g.source, coalesce(SUM(c.n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN (SELECT c.* FROM counts c JOIN kept USING (lang, term)) c ON g.lang = c.lang AND g.source = c.source
  GROUP BY ALL),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + CAST(1000000000 AS HUGEINT) * CAST(coalesce(c.n, 0) + 5 AS HUGEINT)
             // CAST(g.total + 5 * l.v AS HUGEINT) AS p,
         1 + CAST(1000000000 AS HUGEINT) * CAST(k.n + 5 AS HUGEINT) // CAST(l.total + 5 * l.v AS HUGEINT) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
apart AS (
  SELECT a.lang, a.source, b.source AS item, SUM(abs(a.p - b.p)) AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM cells WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM found)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""

SQL = {"op3_substring_dedup": SUBSTRING_DEDUP, "op8_mixture": MIXTURE, "op11_suffix_dedup": BYTE_DEDUP, "op13_divergence": DIVERGENCE}
