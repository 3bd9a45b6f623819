"""SQL of the corpus queries whose whole result SQL can state, for DuckDB.

The others hold what SQL can't: seeded block picks (op2), ranked profiles (op3), test batteries (op4), multiset hashes (op6),
a logistic regression (op7), a parser and a tree (op8), expectation-maximisation (op9), a tokenizer and packing (op10), an order by Spark's 64-bit hash (op11).
"""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda x: x != '')"
_UNITS = r"regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+')"


def _framed(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"coalesce(CAST(octet_length(encode({text})) AS VARCHAR) || ':' || {text}, '-')"


_FRAME = " || ".join(_framed(c) for c in ("doc_id", "source", "lang", "n_chars"))

ORACLES: dict[str, str] = {
    "op1_substring_dedup": f"""WITH w AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS.format('text')} AS ws FROM documents),
p AS (SELECT doc_id, r, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50), h AS (SELECT doc_id, r, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS first FROM h GROUP BY 1), c AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS place FROM h JOIN m USING (h) WHERE doc_id > first),
n AS (SELECT r, list(place) AS gone FROM c GROUP BY 1), k AS (SELECT doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed, CASE WHEN gone IS NULL THEN ws ELSE list_select(ws, list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(gone, i))) END AS kept FROM w LEFT JOIN n USING (r))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k""",
    "op5_near_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 1], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= 80 * (x.n + y.n - o)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT a, min(b) AS least FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(c.least, w.doc_id)) AS component_id, w.doc_id <= coalesce(c.least, w.doc_id) AS kept FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN c ON c.a = w.doc_id""",
    "op12_fill_middle": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, {_UNITS} AS us, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(us) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS lo, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS hi,
CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, CAST(n AS BIGINT) AS n, form, array_to_string(us[1:lo], '') AS pre, array_to_string(us[lo + 1:hi], '') AS mid, array_to_string(us[hi + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "op13_merkle_manifest": f"""WITH RECURSIVE bytes AS (SELECT list(list_reduce(list_prepend(CAST(i AS UBIGINT), range(8)::UBIGINT[]), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END) ORDER BY i) AS vs FROM range(256) r(i)),
ids AS (SELECT doc_id, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))), lambda c, b: xor(c // 256, vs[CAST(xor(c % 256, b) AS BIGINT) + 1]))) AS crc
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), bytes),
d AS (SELECT d.*, coalesce('=' || source, '') AS g, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents d LEFT JOIN ids ON d.doc_id = ids.doc_id),
e AS (SELECT doc_id, g, sha256({_FRAME} || {_framed('text')}) AS leaf, sha256({_FRAME} || {_framed('changed')}) AS shown FROM d),
x AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM e),
t AS (SELECT g, 0 AS l, i, leaf AS h, n FROM x UNION ALL SELECT g, l + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM t WHERE n > 1 GROUP BY g, l, i // 3, n),
s AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS si, count(*) OVER () AS n FROM t WHERE n = 1),
r AS (SELECT 0 AS l, si AS i, subroot AS h, n FROM s UNION ALL SELECT l + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM r WHERE n > 1 GROUP BY l, i // 3, n),
pt AS (SELECT g, l, i // 3 AS p, list(h ORDER BY i) AS hs FROM t WHERE n > 1 GROUP BY 1, 2, 3), pr AS (SELECT l, i // 3 AS p, list(h ORDER BY i) AS hs FROM r WHERE n > 1 GROUP BY 1, 2),
k AS (SELECT row_number() OVER () AS id, x.*, subroot, si FROM x JOIN s USING (g)),
st AS (SELECT id, l, i // CAST(power(3, l) AS BIGINT) % 3 AS slot, hs FROM k JOIN pt ON pt.g = k.g AND pt.p = k.i // CAST(power(3, l + 1) AS BIGINT)
UNION ALL SELECT id, 100 + l, si // CAST(power(3, l) AS BIGINT) % 3, hs FROM k JOIN pr ON pr.p = k.si // CAST(power(3, l + 1) AS BIGINT)),
w AS (SELECT id, list(array_to_string(hs[1:slot], '') || '|' || array_to_string(hs[slot + 2:], '') ORDER BY l) AS path FROM st GROUP BY 1),
f AS (SELECT doc_id, leaf, subroot, (SELECT h FROM r WHERE n = 1) AS root, sha256(replace(array_to_string(coalesce(path, []), ''), '|', '')) AS proof_sha256,
list_reduce(list_prepend(shown, coalesce(path, [])), lambda a, b: sha256(split_part(b, '|', 1) || a || split_part(b, '|', 2))) AS folded_root FROM k LEFT JOIN w USING (id))
SELECT *, folded_root = root AS verified FROM f""",
}
