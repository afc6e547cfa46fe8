"""SQL for those of the training-data queries that SQL can express. It states what comes out, in other ways than the operators find it."""

from __future__ import annotations

#: op2: all windows of 50 bytes as hex, the least id of each, and the union of those that a smaller id has.
SUFFIX_DEDUP = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 w AS (SELECT doc_id, i, substr(h, (2 * i + 1)::BIGINT, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 49)::BIGINT)) AS i FROM d)),
 f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
 hit AS (SELECT w.doc_id, w.i, w.i - 50 > coalesce(lag(w.i) OVER (PARTITION BY w.doc_id ORDER BY w.i), -51) AS fresh FROM w JOIN f ON w.s = f.s AND f.m < w.doc_id),
 run AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hit) GROUP BY doc_id, r),
 cut AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM run),
 g AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, max(z) AS last, string_agg(substr(h, (2 * before + 1)::BIGINT, (2 * (a - before))::BIGINT), '' ORDER BY a) AS kept FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
 SELECT d.doc_id, length(h)::BIGINT // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, (2 * coalesce(last, 0) + 1)::BIGINT))) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)"""

#: op3: ranks by the seeded hash within each source, then fractional ranks, then equal cuts; crc32 byte by byte from its table.
SHARDING = """WITH t AS (SELECT list(x ORDER BY n) AS crc FROM (SELECT n, list_reduce(range(0, 8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS x FROM (SELECT unnest(range(0, 256))::BIGINT AS n))),
 d AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS h FROM documents),
 c AS (SELECT doc_id, source, length(h)::BIGINT // 2 + 1 AS size, xor(list_reduce(list_transform(range(0, length(h)::BIGINT // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT), lambda a, b: xor(t.crc[(xor(a, b) & 255) + 1], a >> 8), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32 FROM d, t),
 s AS (SELECT *, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS k, ('0x' || substr(md5(concat_ws(':', '17', doc_id::VARCHAR, text_crc32::VARCHAR, size::VARCHAR)), 1, 15))::BIGINT AS hash FROM c),
 r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY hash, doc_id, text_crc32, size) - 1 AS rank, count(*) OVER (PARTITION BY k) AS n FROM s),
 p AS (SELECT *, row_number() OVER (ORDER BY (2 * rank + 1)::DOUBLE / (2 * n), k) - 1 AS place, count(*) OVER () AS total FROM r),
 q AS (SELECT *, place * 8 // total AS shard FROM p)
 SELECT doc_id, source, size, text_crc32, 'rows' AS law, shard::INT AS shard, (place - (shard * total + 7) // 8)::BIGINT AS slot, NULL::INT AS grown_shard FROM q"""

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"
#: op6: windows of items and of documents joined as text.
DECONTAMINATION = f"""WITH b AS (SELECT item_id::VARCHAR AS item, w, least(10, len(w)) AS m FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
 p AS (SELECT DISTINCT item, m, array_to_string(w[i : i + m - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM b)),
 d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
 x AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS s FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
 h AS (SELECT doc_id, i, x.m, item FROM x JOIN p ON x.m = p.m AND x.s = p.s),
 n AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM h) GROUP BY doc_id),
 j AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
 SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN j USING (doc_id)"""

#: op9: what is read back is what went in. Only conversation -7 holds strings of the template: each of its two turns is escaped at three places.
CHAT = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, (sum(length(role) + length(text) + 14) + CASE WHEN conv_id = -7 THEN 6 ELSE 0 END)::BIGINT AS formatted_chars, CASE WHEN conv_id = -7 THEN 2 ELSE 0 END::BIGINT AS escaped_turns FROM c GROUP BY conv_id"""

#: op12: windows of 35 words joined as text; the words inside none of those that occur again.
SEED_EXTEND = r"""WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
 x AS (SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
 r AS (SELECT s FROM x GROUP BY s HAVING count(*) > 1),
 hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM x WHERE s IN (SELECT s FROM r)),
 words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
 g AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS kept, count(*) AS n FROM words ANTI JOIN hit USING (doc_id, k) GROUP BY doc_id)
 SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)"""

#: op13: all phrases of a piece joined as text and counted; each candidate's lowest cut; candidates inside longer ones by their texts.
COLLOCATIONS = r"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
 p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
 n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
 g AS (SELECT lang, m, s, count(*) AS f FROM (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS s FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m)) GROUP BY lang, m, s HAVING count(*) >= 100),
 c AS (SELECT lang, m, s, f AS a, string_split(s, ' ') AS w FROM g WHERE m > 1),
 k AS (SELECT lang, m, s, a, k, array_to_string(w[1 : k], ' ') AS left_part, array_to_string(w[k + 1 : m], ' ') AS right_part FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
 x AS (SELECT k.lang, k.m, k.s, k.a, k.k, l.f AS l, r.f AS r, n.n, ((1000::HUGEINT * k.a * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score FROM k JOIN g l ON l.lang = k.lang AND l.s = k.left_part JOIN g r ON r.lang = k.lang AND r.s = k.right_part JOIN n ON n.lang = k.lang),
 y AS (SELECT *, row_number() OVER (PARTITION BY lang, s ORDER BY score, k) AS nth FROM x),
 longer AS (SELECT lang, array_to_string(w[i : i + m2 - 1], ' ') AS s, max(a) AS most FROM (SELECT lang, w, a, m2, unnest(range(1, m - m2 + 2)) AS i FROM c, (SELECT unnest(range(2, 5)) AS m2) WHERE m2 < m) GROUP BY ALL),
 z AS (SELECT y.*, row_number() OVER (PARTITION BY y.lang ORDER BY score DESC, a DESC, y.s) AS rank FROM y LEFT JOIN longer ON longer.lang = y.lang AND longer.s = y.s WHERE nth = 1 AND coalesce(100 * most >= 100 * a, false) = false)
 SELECT lang, rank, s AS phrase, a, l, r, n, score FROM z WHERE rank <= 2000"""

ORACLES: dict[str, str] = {"op2_suffix_dedup": SUFFIX_DEDUP, "op3_sharding": SHARDING, "op6_benchmark_decontamination": DECONTAMINATION, "op9_chat_formatting": CHAT, "op12_substring_dedup": SEED_EXTEND, "op13_phrase_collocations": COLLOCATIONS}
