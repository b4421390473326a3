"""DuckDB SQL of the queries that SQL can express. Token ids, XXH64, CRC-32 and rules on tokens are beyond it."""

OP2 = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
 e AS (SELECT *, role = 'assistant' AS trained, length('<|turn|><|text|><|end|>') + length(role)
  + length(regexp_replace(regexp_replace(text, '(<\\*)(\||/?s>)', '\1\\\2', 'g'), '(\[\\*)(/?INST\])', '\1\\\2', 'g')) AS n FROM t),
 c AS (SELECT *, sum(n) OVER w AS upto, row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS final FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (WHERE trained), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE trained), '')) AS loss_sha256,
 CAST(sum(upto) FILTER (WHERE trained OR final) AS BIGINT) AS formatted_chars, count(*) FILTER (WHERE trained OR final) AS n_examples FROM c GROUP BY conv_id"""

OP4 = r"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 p AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
 g AS (SELECT doc_id, i, x, CASE WHEN lead(x, 12) OVER (PARTITION BY doc_id ORDER BY i) IS NOT NULL THEN string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) END AS win FROM p),
 f AS (SELECT win, min(doc_id) AS owner FROM g WHERE win IS NOT NULL GROUP BY win),
 h AS (SELECT g.doc_id, g.i, g.x, coalesce(f.owner < g.doc_id, FALSE) AS hit FROM g LEFT JOIN f ON g.win = f.win),
 r AS (SELECT doc_id, i, x, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM h),
 k AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM r GROUP BY doc_id)
 SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id"""

OP9 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
 SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10"""

OP10 = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
 f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
 SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST(1 + ((((strpos('0123456789abcdef', substr(hex, CAST(5 * i // 4 + 1 AS BIGINT), 1)) - 1) * 16 + strpos('0123456789abcdef', substr(hex, CAST(5 * i // 4 + 2 AS BIGINT), 1)) - 1) >> (3 - 5 * i % 4)) & 31) AS BIGINT), 1)), '') AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

OP13 = r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
 p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
 t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
 g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 6) r(k)) GROUP BY ALL HAVING count(*) >= 100),
 c AS (SELECT *, string_split(phrase, ' ') AS w FROM g WHERE k > 1),
 i AS (SELECT DISTINCT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, f FROM (SELECT lang, w, f, k, m, unnest(range(1, k - m + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS m FROM c))),
 x AS (SELECT lang, phrase, max(f) AS longer FROM i GROUP BY ALL),
 y AS (SELECT c.* FROM c LEFT JOIN x USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * f),
 z AS (SELECT lang, phrase, f AS a, cut, array_to_string(w[1:cut], ' ') AS p1, array_to_string(w[cut + 1:], ' ') AS p2 FROM (SELECT *, unnest(range(1, k)) AS cut FROM y)),
 s AS (SELECT z.lang, z.phrase, z.a, z.cut, b.f AS l, e.f AS r, n, CAST((1000::HUGEINT * a * n) // (b.f::HUGEINT * e.f) AS BIGINT) AS score FROM z JOIN g b ON b.lang = z.lang AND b.phrase = p1 JOIN g e ON e.lang = z.lang AND e.phrase = p2 JOIN t ON t.lang = z.lang),
 m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
 SELECT lang, CAST(row_number() OVER w AS INT) AS rank, phrase, a, l, r, n, score FROM m WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER w <= 2000"""


def _merkle_sql(levels: int = 7, root_levels: int = 4) -> str:
    """Trees of up to 16**7 leaves and 16**4 sources: each level's nodes (n), its runs (g), and the rows on their way up (q)."""
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)"]
    said = lambda c: f"coalesce(octet_length(encode({c})) || ':' || {c}, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(said, [*fields, text]))})"
    bits = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda c, b: {bits}), 4294967295)"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = [f"""d AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS shown FROM documents),
 q0 AS (SELECT doc_id, leaf, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, shown AS x, '' AS p FROM d),
 n0 AS (SELECT t, i, n, leaf AS h FROM q0)"""]

    def level(j: int, k: int, more: str) -> None:
        out.append(f"""g{j} AS (SELECT t, i // 16 AS i, max(n) AS n, list(h ORDER BY i) AS hs FROM n{j} GROUP BY t, i // 16),
 n{k} AS (SELECT t, i, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM g{j}),
 q{k} AS (SELECT doc_id, leaf, {more} q{j}.t, q{j}.i // 16 AS i, (q{j}.n + 15) // 16 AS n, CASE WHEN q{j}.n = 1 THEN x ELSE sha256(array_to_string(hs[:q{j}.i % 16], '') || x || array_to_string(hs[q{j}.i % 16 + 2:], '')) END AS x,
  CASE WHEN q{j}.n = 1 THEN p ELSE p || array_to_string(hs[:q{j}.i % 16], '') || array_to_string(hs[q{j}.i % 16 + 2:], '') END AS p FROM q{j} JOIN g{j} ON g{j}.t = q{j}.t AND g{j}.i = q{j}.i // 16)""")

    for j in range(levels):
        level(j, j + 1, "")
    top, last = levels + 1, levels + 1 + root_levels
    out.append(f"""n{top} AS (SELECT 0 AS t, t AS i, count(*) OVER () AS n, h FROM n{levels}),
 q{top} AS (SELECT doc_id, leaf, h AS subroot, 0 AS t, t AS i, (SELECT count(*) FROM n{levels}) AS n, x, p FROM q{levels} JOIN n{levels} USING (t))""")
    for j in range(top, last):
        level(j, j + 1, "subroot,")
    return f"WITH {', '.join(out)} SELECT doc_id, leaf, subroot, h AS root, sha256(p) AS proof_sha256, x AS folded_root, x = h AS verified FROM q{last}, (SELECT h FROM n{last})"


SQL = {"op2_prefix_targets": OP2, "op4_phrase_automata": OP4, "op9_cover_tree": OP9, "op10_warc_segments": OP10, "op11_merkle_manifest": _merkle_sql(), "op13_stripes_collocations": OP13}
