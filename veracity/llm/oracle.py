"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op1_minhash_forest"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
    ELSE [w[i:i + 4] FOR i IN range(1, len(w) - 3)] END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * k >= 75 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, root) AS (
  SELECT DISTINCT a, a FROM edges
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.root),
comp AS (SELECT doc_id, min(root) AS component FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id,
  d.doc_id = coalesce(c.component, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes z USING (doc_id) LEFT JOIN comp c USING (doc_id)
"""

ORACLE["op2_pivot_index"] = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v WHERE list_inner_product(e, e) > 0),
edges AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.93),
reach(vec_id, root) AS (
  SELECT DISTINCT a, a FROM edges
  UNION
  SELECT r.vec_id, e.b FROM reach r JOIN edges e ON e.a = r.root),
comp AS (SELECT vec_id, min(root) AS component FROM reach GROUP BY vec_id),
links AS (SELECT a AS vec_id, count(*) AS n FROM edges GROUP BY a)
SELECT m.vec_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links, coalesce(c.component, m.vec_id) AS component_id,
  m.vec_id = coalesce(c.component, m.vec_id) AS kept
FROM embeddings m LEFT JOIN links l USING (vec_id) LEFT JOIN comp c USING (vec_id)
"""

ORACLE["op3_topk_columns"] = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLE["op7_mixing"] = r"""
WITH d AS (
  SELECT doc_id, coalesce('d' || (CAST(nullif(regexp_extract(source, '([0-9]{1,9})$', 1), '') AS INTEGER) % 4), 'unknown') AS domain,
    coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL),
t0 AS (
  SELECT *, CASE domain WHEN 'd0' THEN 4.0 WHEN 'd1' THEN 3.0 WHEN 'd2' THEN 2.0 ELSE 1.0 END::DOUBLE AS w_domain,
    CASE lang WHEN 'en' THEN 4.0 WHEN 'de' THEN 2.0 WHEN 'fr' THEN 2.0 WHEN 'es' THEN 2.0 ELSE 1.0 END::DOUBLE AS w_lang,
    1.0::DOUBLE AS w_source, tokens * 2 AS cap, least(floor(sum(tokens) OVER () * 0.6::DOUBLE), sum(tokens * 2) OVER ()) AS b0
  FROM leaves),
n0 AS (
  SELECT domain, sum(cap) AS cap, max(w_domain) AS w, max(b0) AS b FROM t0 GROUP BY domain),
f0 AS (
  SELECT *, w > 0 AND cap * sum(w) OVER (ORDER BY CASE WHEN w > 0 THEN cap / w ELSE 'inf'::DOUBLE END, cap, w
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= (b - coalesce(sum(cap) OVER (ORDER BY CASE WHEN w > 0 THEN cap / w ELSE 'inf'::DOUBLE END, cap, w
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS is_full FROM n0),
g0 AS (
  SELECT domain, CASE WHEN is_full THEN cap WHEN w > 0 THEN w
    * (b - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())
    / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () ELSE 0 END AS b1 FROM f0),
t1 AS (SELECT t.*, g.b1 FROM t0 t JOIN g0 g ON t.domain = g.domain),
n1 AS (
  SELECT domain, lang, sum(cap) AS cap, max(w_lang) AS w, max(b1) AS b FROM t1 GROUP BY domain, lang),
f1 AS (
  SELECT *, w > 0 AND cap * sum(w) OVER (PARTITION BY domain ORDER BY CASE WHEN w > 0 THEN cap / w ELSE 'inf'::DOUBLE END, cap, w
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= (b - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY CASE WHEN w > 0 THEN cap / w ELSE 'inf'::DOUBLE END, cap, w
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS is_full FROM n1),
g1 AS (
  SELECT domain, lang, CASE WHEN is_full THEN cap WHEN w > 0 THEN w
    * (b - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER (PARTITION BY domain ))
    / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER (PARTITION BY domain ) ELSE 0 END AS b2 FROM f1),
t2 AS (SELECT t.*, g.b2 FROM t1 t JOIN g1 g ON t.domain = g.domain AND t.lang = g.lang),
n2 AS (
  SELECT domain, lang, source, sum(cap) AS cap, max(w_source) AS w, max(b2) AS b FROM t2 GROUP BY domain, lang, source),
f2 AS (
  SELECT *, w > 0 AND cap * sum(w) OVER (PARTITION BY domain, lang ORDER BY CASE WHEN w > 0 THEN cap / w ELSE 'inf'::DOUBLE END, cap, w
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= (b - coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY CASE WHEN w > 0 THEN cap / w ELSE 'inf'::DOUBLE END, cap, w
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS is_full FROM n2),
g2 AS (
  SELECT domain, lang, source, CASE WHEN is_full THEN cap WHEN w > 0 THEN w
    * (b - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER (PARTITION BY domain, lang ))
    / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER (PARTITION BY domain, lang ) ELSE 0 END AS b3 FROM f2),
t3 AS (SELECT t.*, g.b3 FROM t2 t JOIN g2 g ON t.domain = g.domain AND t.lang = g.lang AND t.source = g.source),
p AS (
  SELECT domain, lang, source, tokens, floor(b3 + 1e-6) AS budget,
    CAST(CASE WHEN tokens > 0 THEN floor(floor(b3 + 1e-6) / tokens) ELSE 0 END AS BIGINT) AS whole FROM t3),
o AS (
  SELECT d.*, p.whole, p.tokens, p.budget - p.whole * p.tokens AS rest,
    sum(n_tokens) OVER (PARTITION BY domain, lang, source
      ORDER BY CAST('0x' || substr(md5('1:' || p.whole || ':' || doc_id), 1, 15) AS BIGINT), doc_id) AS run
  FROM d JOIN p USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, whole + CAST(tokens > 0 AND run <= rest AS BIGINT) AS copies FROM o
"""


def _repair_sql() -> str:
    """Conversation repair by a forward search row by row, with the least (cost, audit) and its text for each state."""
    white = r"\x20\x09-\x0D"

    def edit(x: str, cost: str, letter: str, line: str | None = None) -> str:
        text = f"{x}.t" if line is None else f"{x}.t || chr(10) || {line}"
        return f"CASE WHEN {x} IS NOT NULL THEN {{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 't': {text}}} END"

    def least(*options: str) -> str:
        return f"list_min([{', '.join(options)}])"

    def insert(x: str, role: str) -> str:
        return edit(x, "5", "I", f"'{role}:'")

    def place(x: str, kind: str, role: str) -> list[str]:
        keep = edit(x, "stays", "K", "role || ':' || text")
        return [f"CASE WHEN NOT must AND kind = '{kind}' THEN {keep} END", f"CASE WHEN NOT must THEN {edit(x, '1 + stays', 'R', f"'{role}:' || text")} END"]

    first = "s0, s1, {} AS s2, {} AS s3"
    one = first.format(least("s2", insert("s0", "user"), insert("s1", "user"), insert("s3", "user")), least("s3", insert("s2", "assistant")))
    two = first.format(least("s2", insert("s3", "user")), least("s3", insert("s2", "assistant")))
    system = f"CASE WHEN NOT must AND kind = 's' THEN {edit('s0', 'stays', 'K', "role || ':' || text")} END"
    step = (f"{edit('s0', '2', 'D')} AS s0, {least(edit('s1', '2', 'D'), system)} AS s1, "
            f"{least(edit('s2', '2', 'D'), *place('s0', 'u', 'user'), *place('s1', 'u', 'user'), *place('s3', 'u', 'user'))} AS s2, "
            f"{least(edit('s3', '2', 'D'), *place('s2', 'a', 'assistant'))} AS s3")
    state = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
    return f"""
WITH RECURSIVE codes AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS code),
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(unicode(x) AS BIGINT)) AS bytes
  FROM conversations),
marked AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, code[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS h
  FROM given, codes),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS again
  FROM marked WHERE h <> 0),
ordered AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    md5(coalesce(CAST(conv_id AS VARCHAR), '-') || ':' || length(role) || ':' || role || text), again) AS ord
  FROM damaged),
faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^{white}]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY ord) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][{white}]*\\z') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY ord) || left(role, 1) AS pair
  FROM ordered),
moves AS (
  SELECT conv_id, ord, role, text, left(role, 1) AS kind, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS stays FROM faults),
dp(conv_id, i, s0, s1, s2, s3) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), CAST({{'c': 0, 'a': '', 't': ''}} AS {state}), CAST(NULL AS {state}), CAST(NULL AS {state}), CAST(NULL AS {state}) FROM conversations
  UNION ALL
  SELECT conv_id, ord, {step} FROM (
    SELECT conv_id, ord, role, text, kind, must, stays, {two} FROM (
      SELECT d.conv_id, r.ord, r.role, r.text, r.kind, r.must, r.stays, {one}
      FROM dp d JOIN moves r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.ord = d.i + 1))),
ends AS (
  SELECT conv_id, {least('s0', 's3')} AS s FROM (
    SELECT conv_id, {two} FROM (SELECT conv_id, i, {one} FROM dp QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1))),
counts AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id)
SELECT e.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
  coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, e.s.c AS cost, e.s.a AS audit, sha256(substr(e.s.t, 2)) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


ORACLE["op13_viterbi_repair"] = _repair_sql()
