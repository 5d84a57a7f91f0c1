"""DuckDB SQL of the queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op8_quality_ledger"] = r"""
WITH texts AS (
    SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS body FROM documents
), cut AS (
    SELECT k, doc_id, body,
           list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
           list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM texts
), windows AS (
    SELECT k, unnest(range(1, len(words) - 6)) AS place, words FROM cut
), keyed AS (
    SELECT k, place, list_slice(words, place, place + 7) AS part FROM windows
), repeated AS (
    SELECT k, place FROM (SELECT k, place, count(*) OVER (PARTITION BY k, part) AS n FROM keyed) WHERE n > 1
), covered AS (
    SELECT k, count(DISTINCT word) AS n_repeat_words
    FROM (SELECT k, unnest(range(place, place + 8)) AS word FROM repeated) GROUP BY k
), measured AS (
    SELECT doc_id, len(words)::BIGINT AS n_words,
           length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
           (length(body) - length(translate(body, '#*$%&|<>', '')))::BIGINT AS n_symbols,
           (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
           coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
           len(lines)::BIGINT AS n_lines
    FROM cut LEFT JOIN covered USING (k)
), bits AS (
    SELECT *, ((n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT
               + 4 * (100 * n_symbols > 30 * n_words)::BIGINT + 8 * (100 * n_dup_lines > 50 * n_lines)::BIGINT
               + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 20 * n_words)::BIGINT)::BIGINT AS failed_bits
    FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits, rule AS sole_rule,
       CASE WHEN rule IS NOT NULL THEN (SELECT count(*) FROM bits b WHERE b.failed_bits & bits.failed_bits <> 0) END
           AS rule_rejected,
       CASE WHEN rule IS NOT NULL THEN count(*) OVER (PARTITION BY failed_bits) END AS rule_kept_without
FROM bits LEFT JOIN (VALUES (1, 'too_few_words'), (2, 'too_many_repeats'), (4, 'too_many_symbols'),
                            (8, 'too_many_equal_lines'), (16, 'words_too_short'), (32, 'words_too_long')) r(bit, rule)
     ON bit = failed_bits
"""

ORACLES["op7_shards"] = """
WITH rows AS (
    SELECT doc_id, strlen(text)::INTEGER AS n_bytes,
           ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 11) || substr(md5(coalesce(text, '')), 1, 4))::BIGINT AS address
    FROM documents
), levels AS (
    SELECT depth::INTEGER AS depth, address >> (60 - depth)::BIGINT AS prefix, sum(coalesce(n_bytes, 0))::BIGINT AS bytes
    FROM rows, range(0, 61) d(depth) GROUP BY ALL
), placed AS (
    SELECT r.doc_id, r.n_bytes, l.depth, l.prefix, l.bytes, row_number() OVER (PARTITION BY r.k ORDER BY l.depth) AS place
    FROM (SELECT row_number() OVER () AS k, * FROM rows) r
    JOIN levels l ON l.prefix = r.address >> (60 - l.depth)::BIGINT
    WHERE l.bytes <= 1048576 OR l.depth = 60
)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE right(repeat('0', 60) || bin(prefix), depth) END AS shard,
       depth AS shard_depth, bytes AS shard_bytes
FROM placed WHERE place = 1
"""

ORACLES["op2_near_duplicates"] = r"""
WITH RECURSIVE cut AS (
    SELECT doc_id, list_filter(
        regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, list_slice(words, i, i + 4) AS shingle
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM cut WHERE len(words) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)
), reached AS (
    SELECT doc_id AS node, doc_id AS other FROM documents
    UNION
    SELECT node, b FROM reached JOIN links ON other = a
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT node, min(other) AS component_id FROM reached GROUP BY node) r ON r.node = d.doc_id
"""

ORACLES["op11_hard_negatives"] = """
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
           list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""

ORACLES["op13_merkle_proofs"] = """
WITH RECURSIVE keyed AS (
    SELECT row_number() OVER () AS k, doc_id, source, text,
           CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR END
           || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
           || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
           || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR END AS head,
           list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
               lambda sum, byte: list_reduce(list_prepend(xor(sum, byte), [0, 0, 0, 0, 0, 0, 0, 0]),
                   lambda x, bit: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS crc
    FROM documents
), leaves AS (
    SELECT k, doc_id, source,
           sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
           CASE WHEN xor(crc, 4294967295) % 5 = 0 AND text IS NOT NULL THEN
               sha256(head || strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
           END AS altered
    FROM keyed
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, k) - 1 AS place,
           count(*) OVER (PARTITION BY source) AS n,
           dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
    FROM leaves
), own AS (
    SELECT 0 AS level, tree, place, n, leaf AS hash FROM placed
    UNION ALL
    SELECT level + 1, tree, place // 16, (any_value(n) + 15) // 16, sha256(string_agg(hash, '' ORDER BY place))
    FROM own WHERE n > 1 GROUP BY level, tree, place // 16
), subroots AS (
    SELECT tree, level, hash FROM own WHERE n = 1
), trees AS (
    SELECT 0 AS level, tree AS place, count(*) OVER () AS n, hash FROM subroots
    UNION ALL
    SELECT level + 1, place // 16, (any_value(n) + 15) // 16, sha256(string_agg(hash, '' ORDER BY place))
    FROM trees WHERE n > 1 GROUP BY level, place // 16
), steps AS (
    SELECT tree, level, place, string_agg(hash, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lefts,
           string_agg(hash, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rights
    FROM own WHERE n > 1 WINDOW run AS (PARTITION BY tree, level, place // 16 ORDER BY place)
    UNION ALL
    SELECT -1, level, place, string_agg(hash, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           string_agg(hash, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
    FROM trees WHERE n > 1 WINDOW run AS (PARTITION BY level, place // 16 ORDER BY place)
), climbs AS (
    SELECT p.k, p.tree, 0 AS level, p.place, true AS below, '' AS proof,
            coalesce(p.altered, p.leaf) AS folded
    FROM placed p
    UNION ALL
    SELECT c.k, c.tree, CASE WHEN c.below AND s.level IS NULL THEN 0 ELSE c.level + 1 END,
           CASE WHEN c.below AND s.level IS NULL THEN c.tree ELSE c.place // 16 END,
           c.below AND s.level IS NOT NULL,
           c.proof || CASE WHEN s.level IS NULL THEN '' ELSE coalesce(s.lefts, '') || coalesce(s.rights, '') END,
           CASE WHEN s.level IS NULL THEN c.folded ELSE sha256(coalesce(s.lefts, '') || c.folded || coalesce(s.rights, '')) END
    FROM climbs c
    LEFT JOIN steps s ON s.tree = CASE WHEN c.below THEN c.tree ELSE -1 END AND s.level = c.level AND s.place = c.place
    WHERE c.below OR s.level IS NOT NULL
), done AS (
    SELECT c.k, c.proof, c.folded FROM climbs c
    WHERE NOT c.below AND NOT EXISTS (SELECT 1 FROM steps s WHERE s.tree = -1 AND s.level = c.level AND s.place = c.place)
)
SELECT p.doc_id, p.leaf, r.hash AS subroot, t.hash AS root, sha256(d.proof) AS proof_sha256, d.folded AS folded_root,
       d.folded = t.hash AS verified
FROM placed p JOIN done d USING (k) JOIN subroots r USING (tree) JOIN (SELECT hash FROM trees WHERE n = 1) t ON true
"""
