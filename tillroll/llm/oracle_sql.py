"""DuckDB statements for the operators that SQL can express."""

STATEMENTS: dict[str, str] = {}

STATEMENTS["op4_warc"] = r"""
WITH record AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
hashed AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS same,
         CAST(from_hex(sha1(payload)) AS BIT)::VARCHAR AS bits FROM record),
named AS (
  SELECT page_id, payload_bytes, max(page_id) OVER (PARTITION BY same) AS leader,
         list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
             + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT)
             + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT)
             + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS BIGINT), 1) FOR i IN range(0, 32)],
           'string_agg', '') AS payload_digest
  FROM hashed)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = leader OR leader IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = leader THEN NULL ELSE leader END AS refers_to
FROM named"""

STATEMENTS["op5_source_mix"] = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
summed AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, 3 * source_size AS most,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight
  FROM summed),
placed AS (
  SELECT *, coalesce(sum(most) OVER earlier, 0) AS most_before, coalesce(sum(weight) OVER earlier, 0) AS weight_before,
         CAST(sum(source_size) OVER () AS DOUBLE) AS amount, sum(weight) OVER () AS all_weight
  FROM weighed
  WINDOW earlier AS (ORDER BY CAST(most AS DOUBLE) / weight, source NULLS LAST
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
judged AS (
  SELECT *, most <= (amount - CAST(most_before AS DOUBLE)) * weight / CAST(all_weight - weight_before AS DOUBLE) AS stops
  FROM placed),
rest AS (
  SELECT any_value(amount) - CAST(coalesce(sum(most) FILTER (WHERE stops), 0) AS DOUBLE) AS open_amount,
         CAST(any_value(all_weight) - coalesce(sum(weight) FILTER (WHERE stops), 0) AS DOUBLE) AS open_weight
  FROM judged),
target AS (
  SELECT source, source_size, CASE WHEN stops THEN CAST(most AS DOUBLE) ELSE open_amount * weight / open_weight END AS target
  FROM judged CROSS JOIN rest),
rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 1.0 END AS rate FROM target)
SELECT doc_id, size, source_size, target,
       size * CAST(floor(rate) + CASE WHEN
         CAST(('0x' || substr(md5('5|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT)
           / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM sized JOIN rated ON sized.source IS NOT DISTINCT FROM rated.source"""

STATEMENTS["op7_chat_format"] = r"""
WITH line AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
shown AS (
  SELECT *, regexp_matches(text || chr(10) || role, '[<\[]/?(?:s>|INST\]|ROLE\])|\\')
            OR (role = 'assistant' AND (starts_with(text, '[INST] ') OR starts_with(text, '[ROLE] '))) AS hide
  FROM line),
drawn AS (
  SELECT *, CASE WHEN hide THEN regexp_replace(replace(text, '\', '\\'), '([<\[])(/?(?:s>|INST\]|ROLE\]))', '\1\\\2', 'g')
                 ELSE text END AS body FROM shown)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(7 + length(body) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 0 ELSE 16 + length(role) END)
            AS BIGINT) AS formatted_chars
FROM drawn GROUP BY conv_id"""

STATEMENTS["op11_lexical_search"] = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
word AS (
  SELECT r, any_value(doc_id) AS doc_id, term, count(*) AS tf
  FROM (SELECT r, doc_id, unnest(regexp_extract_all(
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM doc)
  GROUP BY r, term),
total AS (SELECT CAST(count(DISTINCT r) AS BIGINT) AS docs, CAST(sum(tf) AS BIGINT) AS terms FROM word),
norm AS (
  SELECT r, 100 - 75 + (75 * CAST(sum(tf) AS BIGINT) * any_value(docs)) // any_value(terms) AS m FROM word, total GROUP BY r),
weighed AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM word, total GROUP BY term),
item AS (SELECT row_number() OVER () AS i, item_id, text FROM benchmark),
asked AS (
  SELECT i, any_value(item_id) AS item_id, term, count(*) AS times
  FROM (SELECT i, item_id, unnest(regexp_extract_all(
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM item)
  GROUP BY i, term),
scored AS (
  SELECT i, r, any_value(item_id) AS item_id, any_value(doc_id) AS doc_id,
         CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN weighed USING (term) JOIN word USING (term) JOIN norm USING (r)
  GROUP BY i, r),
ranked AS (
  SELECT item_id, doc_id, score,
         row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS nth
  FROM scored WHERE score > 0)
SELECT item_id, CAST(nth AS INT) AS rank, doc_id, score FROM ranked WHERE nth <= 10"""
