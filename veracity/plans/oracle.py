"""Oracle SQL (DuckDB) for every registered query.

The fixture views are CTEs here.  Where the Spark plan is clever (sparse BM25
with a bounded zero fill, blocked kNN) the SQL is deliberately brute force
(dense fact x passage scores, all-pairs distances) so it checks the plan
rather than repeating it.  Text rules share their patterns with
``veracity.functions.text``.
"""

from __future__ import annotations

from veracity.functions import prompts as P
from veracity.functions import segment as SG
from veracity.functions import text as T
from veracity.operators import bm25 as BM
from veracity.sources import fixtures as FXT
from veracity.sources.readers import DEFAULT_NPROBE


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def STRIP(x: str) -> str:
    return f"regexp_replace({x}, {q(T.STRIP_PATTERN)}, '', 'g')"


def CHARS(s: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in s)


def WORDS(x: str) -> str:
    return (f"list_filter(list_transform(string_split({x}, ' '), lambda t: regexp_replace(t, {q(T.AROUND_WORD)}, '', 'g')), "
            "lambda t: t <> '')")


def SENT(x: str) -> str:
    for char, code in T.ESCAPED.items():
        x = f"replace({x}, {CHARS(char)}, {CHARS(code)})"
    prot = f"regexp_replace({x}, {q(T.ABBREVIATION_PATTERN)}, '\\1' || chr(2), 'g')"
    mark = f"regexp_replace({prot}, {q(T.BREAK_PATTERN)}, '\\1\\2' || chr(1) || '\\3', 'g')"
    own = "s"
    for char, code in reversed(T.ESCAPED.items()):
        own = f"replace({own}, {CHARS(code)}, {CHARS(char)})"
    return f"list_transform(list_filter(string_split(replace({mark}, chr(2), '.'), chr(1)), lambda s: s <> ''), lambda s: {own})"


def SEGMENTS(x: str) -> str:
    """The sentence cascade; control characters of the text itself are written by their codes as in SENT."""
    for char, code in T.ESCAPED.items():
        x = f"replace({x}, {CHARS(char)}, {CHARS(code)})"
    for pattern, new in SG.CASCADE:
        mark = "' || chr(1) || '"
        x = f"regexp_replace({x}, {q(pattern)}, '{new.replace(T.BREAK, mark)}', 'g')"
    own = "s"
    for char, code in reversed(T.ESCAPED.items()):
        own = f"replace({own}, {CHARS(code)}, {CHARS(char)})"
    return f"list_transform(list_filter(string_split({x}, chr(1)), lambda s: s <> ''), lambda s: {own})"


def FACT_LIST(x: str) -> str:
    """Parsed facts before the final dot rule (needs a second step, see PARSED)."""
    piece = f"{STRIP('regexp_replace(' + STRIP('x') + ', ' + q(T.BLANK_LINE_TAIL) + ', ' + q('') + ', ' + q('g') + ')')}"
    return (f"list_filter(list_transform(string_split({x}, {q(T.FACT_BULLET)})[2:], lambda x: {piece}), "
            f"lambda x: x <> '')")


def PARSED(fl: str) -> str:
    return (f"list_transform({fl}, lambda x, i: CASE WHEN i = len({fl}) AND NOT ends_with(x, '.') "
            f"THEN x || '.' ELSE x END)")


def D2(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i]::DOUBLE - {b}[i]::DOUBLE) ** 2))"


def DECIDE(a: str) -> str:
    return (f"CASE WHEN contains(lower({a}), 'false') THEN false "
            f"WHEN contains(lower({a}), 'true') THEN true END")


def IVF(nprobe: int) -> str:
    return f"""
  SELECT entity, title_id, rk, d2 FROM (
    SELECT entity, title_id, d2, row_number() OVER (PARTITION BY entity ORDER BY d2, title_id) AS rk FROM (
      SELECT q.entity, v.title_id, {D2('q.embedding', 'v.embedding')} AS d2
      FROM entity_vectors q JOIN probes p ON p.entity = q.entity AND p.rk <= {nprobe} JOIN title_vectors v ON v.cell = p.cell))
  WHERE rk <= {K}"""


K = 2
NPROBE = 2
TOPN = BM.TOP_N
ANSWER_CASE = "CASE event_id % 6 " + " ".join(
    f"WHEN {i} THEN {q(a)}" for i, a in enumerate(FXT.ANSWER_SHAPES) if a is not None) + " END"

CTES = f"""
generations AS (
  SELECT conv_id * {FXT.GEN_ID_STRIDE} + turn AS gen_id, 'm' || CAST(conv_id % {FXT.MODEL_RUNS} AS VARCHAR) AS model, text
  FROM conversations WHERE role = 'assistant'),
knowledge AS (
  SELECT doc_id AS title_id, regexp_extract(text, {q(T.TITLE_PATTERN)}, 0) AS title, text FROM documents),
title_vectors AS (
  SELECT e.vec_id AS title_id, e.label AS cell, e.embedding FROM embeddings e
  WHERE e.vec_id IN (SELECT doc_id FROM documents)),
centroids AS (
  SELECT cell, list(m ORDER BY dim) AS centroid FROM (
    SELECT cell, dim, avg(x::DOUBLE) AS m FROM (
      SELECT cell, unnest(range(len(embedding))) AS dim, unnest(embedding) AS x FROM title_vectors)
    GROUP BY cell, dim)
  GROUP BY cell),
gazetteer AS (
  SELECT min(title) AS entity, min(title_id) AS title_id FROM knowledge WHERE title <> '' GROUP BY lower(title)),
responses AS (
  SELECT gen_id, array_to_string(list_transform({SENT('text')}, lambda s: {q(T.FACT_BULLET)} || {STRIP('s')}), chr(10)) AS response
  FROM generations),
fact_lists AS (SELECT gen_id, {FACT_LIST('response')} AS fl FROM responses),
fact_arrays AS (SELECT gen_id, {PARSED('fl')} AS fa FROM fact_lists),
raw_facts AS (SELECT gen_id, unnest(range(len(fa))) AS fact_id, unnest(fa) AS fact FROM fact_arrays),
facts AS (SELECT gen_id, min(fact_id) AS fact_id, fact FROM raw_facts GROUP BY gen_id, fact),
name_words AS (SELECT entity, {WORDS('entity')} AS w FROM gazetteer),
name_grams AS (SELECT entity, len(w) AS n, lower(array_to_string(w, ' ')) AS gram FROM name_words WHERE len(w) > 0),
fact_words AS (SELECT gen_id, fact_id, {WORDS('fact')} AS w FROM facts),
fact_starts AS (SELECT gen_id, fact_id, w, unnest(range(1, len(w) + 1)) AS i FROM fact_words),
fact_grams AS (
  SELECT DISTINCT s.gen_id, s.fact_id, lower(array_to_string(s.w[s.i:s.i + l.n - 1], ' ')) AS gram
  FROM fact_starts s, (SELECT DISTINCT n FROM name_grams) l
  WHERE s.i + l.n - 1 <= len(s.w) AND substr(s.w[s.i], 1, 1) <> lower(substr(s.w[s.i], 1, 1))),
tagged AS (SELECT DISTINCT f.gen_id, f.fact_id, n.entity FROM fact_grams f JOIN name_grams n USING (gram)),
gen_entities AS (SELECT DISTINCT gen_id, entity FROM tagged),
entity_vectors AS (
  SELECT n.entity, v.embedding FROM (SELECT DISTINCT entity FROM gen_entities) n
  JOIN gazetteer g USING (entity) JOIN title_vectors v USING (title_id)),
exact_neighbours AS (
  SELECT entity, title_id, rk, d2 FROM (
    SELECT entity, title_id, d2, row_number() OVER (PARTITION BY entity ORDER BY d2, title_id) AS rk FROM (
      SELECT q.entity, v.title_id, {D2('q.embedding', 'v.embedding')} AS d2
      FROM entity_vectors q, title_vectors v))
  WHERE rk <= {K}),
probes AS (
  SELECT q.entity, c.cell,
         row_number() OVER (PARTITION BY q.entity ORDER BY {D2('q.embedding', 'c.centroid')}, c.cell) AS rk
  FROM entity_vectors q, centroids c),
ivf_neighbours AS ({IVF(NPROBE)}),
neighbours AS ({IVF(DEFAULT_NPROBE)}),
first_text AS (
  SELECT k.title_id, f.text_id FROM knowledge k
  JOIN (SELECT title, min(title_id) AS text_id FROM knowledge GROUP BY title) f USING (title)),
hits AS (
  SELECT ge.gen_id, ge.entity, n.rk, n.title_id, ft.text_id
  FROM gen_entities ge JOIN neighbours n USING (entity) JOIN first_text ft USING (title_id)),
text_sents AS (
  SELECT text_id, unnest(range(len(s))) AS idx, unnest(s) AS sentence FROM (
    SELECT title_id AS text_id, {SENT('text')} AS s FROM knowledge
    WHERE title_id IN (SELECT text_id FROM hits))),
sent_counts AS (SELECT text_id, count(*) AS n_sents FROM text_sents GROUP BY text_id),
hit_offsets AS (
  SELECT h.gen_id, h.entity, h.rk, h.title_id, h.text_id,
         coalesce(sum(c.n_sents) OVER (PARTITION BY h.gen_id ORDER BY h.entity, h.rk
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM hits h JOIN sent_counts c USING (text_id)),
passages AS (
  SELECT o.gen_id, CAST(o.off + s.idx AS BIGINT) AS pos, o.title_id, s.sentence AS text
  FROM hit_offsets o JOIN text_sents s USING (text_id)),
ptoks AS (
  SELECT gen_id, pos, token, count(*) AS tf, max(dl) AS dl FROM (
    SELECT gen_id, pos, len(string_split(text, ' ')) AS dl, unnest(string_split(text, ' ')) AS token FROM passages)
  GROUP BY gen_id, pos, token),
cstats AS (SELECT gen_id, count(*) AS n_docs, avg(len(string_split(text, ' '))) AS avgdl FROM passages GROUP BY gen_id),
raw_idf AS (
  SELECT d.gen_id, d.token, ln(c.n_docs - d.df + 0.5) - ln(d.df + 0.5) AS raw_idf
  FROM (SELECT gen_id, token, count(*) AS df FROM ptoks GROUP BY gen_id, token) d JOIN cstats c USING (gen_id)),
idf AS (
  SELECT r.gen_id, r.token, CASE WHEN r.raw_idf < 0 THEN {BM.EPSILON} * m.mean_idf ELSE r.raw_idf END AS idf
  FROM raw_idf r JOIN (SELECT gen_id, avg(raw_idf) AS mean_idf FROM raw_idf GROUP BY gen_id) m USING (gen_id)),
qtoks AS (
  SELECT gen_id, fact_id, token, count(*) AS qn FROM (
    SELECT gen_id, fact_id, unnest(string_split(fact, ' ')) AS token FROM facts)
  GROUP BY gen_id, fact_id, token),
sparse AS (
  SELECT q.gen_id, q.fact_id, p.pos,
         sum(q.qn * (i.idf * p.tf * {BM.K1 + 1} / (p.tf + {BM.K1} * ({1 - BM.B} + {BM.B} * p.dl / c.avgdl)))) AS raw
  FROM qtoks q JOIN ptoks p USING (gen_id, token) JOIN idf i USING (gen_id, token) JOIN cstats c USING (gen_id)
  GROUP BY q.gen_id, q.fact_id, p.pos),
dense AS (
  SELECT f.gen_id, f.fact_id, p.pos, coalesce(round(s.raw, 9), 0.0) AS rank_score,
         CASE WHEN coalesce(round(s.raw, 9), 0.0) = 0 THEN 0.0 ELSE s.raw END AS score
  FROM facts f JOIN passages p USING (gen_id) LEFT JOIN sparse s USING (gen_id, fact_id, pos)),
top AS (
  SELECT * FROM (
    SELECT gen_id, fact_id, pos, score,
           row_number() OVER (PARTITION BY gen_id, fact_id ORDER BY rank_score DESC, pos DESC) AS rk FROM dense)
  WHERE rk <= {TOPN}),
lptoks AS (
  SELECT DISTINCT gen_id, pos, token FROM (
    SELECT p.gen_id, p.pos, unnest(string_split(lower(p.text), ' ')) AS token
    FROM passages p SEMI JOIN (SELECT DISTINCT gen_id, pos FROM top) u USING (gen_id, pos))),
lftoks AS (
  SELECT DISTINCT gen_id, fact_id, token FROM (
    SELECT gen_id, fact_id, unnest(string_split(lower(fact), ' ')) AS token FROM facts)),
found AS (SELECT DISTINCT t.gen_id, t.fact_id, p.token FROM top t JOIN lptoks p USING (gen_id, pos)),
answers AS (
  SELECT f.gen_id, f.fact_id,
         CASE WHEN avg(CASE WHEN fd.token IS NOT NULL THEN 1.0 ELSE 0.0 END) >= 0.5 THEN 'True' ELSE 'False' END AS answer
  FROM lftoks f SEMI JOIN (SELECT DISTINCT gen_id, fact_id FROM top) j USING (gen_id, fact_id)
  LEFT JOIN found fd USING (gen_id, fact_id, token)
  GROUP BY f.gen_id, f.fact_id),
lex_decisions AS (SELECT gen_id, fact_id, {DECIDE('answer')} AS decision FROM answers),
precision AS (
  SELECT gen_id, count(decision) AS n_decided, CAST(coalesce(sum(decision::INT), 0) AS BIGINT) AS n_supported,
         round_even(avg(decision::INT), 4) AS score
  FROM lex_decisions GROUP BY gen_id),
call_log AS (
  SELECT event_id AS row, {ANSWER_CASE} AS answer,
         CASE WHEN event_id % 5 = 0 THEN NULL ELSE value / 1000 END AS cost,
         value / 10 AS latency_s,
         CASE WHEN event_type = 'error' THEN 'HTTP 500 on call ' || CAST(event_id AS VARCHAR) END AS error
  FROM events),
ext_req AS (SELECT gen_id, gen_id * {FXT.LOG_STEP} AS log_row FROM generations),
ext_calls AS (
  SELECT r.gen_id, 
         CASE WHEN l.error IS NULL THEN l.answer END AS content,
         CASE WHEN l.error IS NULL AND l.answer IS NOT NULL THEN l.cost ELSE 0.0 END AS cost,
         coalesce(l.latency_s, 0.0) AS latency_s,
         CASE WHEN l.error IS NULL AND l.answer IS NOT NULL THEN 'ok' ELSE 'failed' END AS status
  FROM ext_req r LEFT JOIN call_log l ON l.row = r.log_row % (SELECT count(*) FROM call_log)),
ver_req AS (
  SELECT DISTINCT gen_id, fact_id, gen_id * {FXT.LOG_STEP} + fact_id + 1 AS log_row FROM top
  WHERE gen_id IN (SELECT gen_id FROM ext_calls WHERE status = 'ok')),
ver_calls AS (
  SELECT r.gen_id, r.fact_id,
         CASE WHEN l.error IS NULL THEN l.answer END AS content,
         CASE WHEN l.error IS NULL AND l.answer IS NOT NULL THEN l.cost ELSE 0.0 END AS cost,
         coalesce(l.latency_s, 0.0) AS latency_s,
         CASE WHEN l.error IS NULL AND l.answer IS NOT NULL THEN 'ok' ELSE 'failed' END AS status
  FROM ver_req r LEFT JOIN call_log l ON l.row = r.log_row % (SELECT count(*) FROM call_log)),
replayed AS (
  SELECT gen_id, fact_id, CASE WHEN status = 'ok' THEN {DECIDE('content')} END AS decision FROM ver_calls),
all_calls AS (
  SELECT gen_id, status, cost, latency_s FROM ext_calls
  UNION ALL
  SELECT gen_id, status, cost, latency_s FROM ver_calls),
totals AS (
  SELECT gen_id, sum(CASE WHEN status = 'ok' THEN coalesce(cost, 0.0) ELSE 0.0 END) AS cost,
         sum(latency_s) AS latency_s
  FROM all_calls GROUP BY gen_id),
rprecision AS (
  SELECT gen_id, count(decision) AS n_decided, round_even(avg(decision::INT), 4) AS score
  FROM replayed GROUP BY gen_id),
scores AS (
  SELECT g.gen_id, g.model, st.status,
         CASE WHEN st.status IN ('ok', 'undecided') THEN p.score ELSE 0.0 END AS score,
         CASE WHEN st.status IN ('ok', 'undecided') THEN coalesce(t.cost, 0.0) ELSE 0.0 END AS cost,
         CASE WHEN st.status IN ('ok', 'undecided') THEN round_even(coalesce(t.latency_s, 0.0), 4) ELSE 0.0 END AS process_time
  FROM generations g
  JOIN (
    SELECT g.gen_id,
           CASE WHEN e.status <> 'ok' THEN 'extraction_failed'
                WHEN g.gen_id NOT IN (SELECT gen_id FROM facts) THEN 'no_facts'
                WHEN g.gen_id NOT IN (SELECT gen_id FROM tagged) THEN 'no_entities'
                WHEN g.gen_id NOT IN (SELECT gen_id FROM passages) THEN 'no_passages'
                WHEN coalesce(p.n_decided, 0) = 0 THEN 'undecided'
                ELSE 'ok' END AS status
    FROM generations g LEFT JOIN ext_calls e USING (gen_id) LEFT JOIN rprecision p USING (gen_id)) st USING (gen_id)
  LEFT JOIN rprecision p USING (gen_id) LEFT JOIN totals t USING (gen_id))
"""


def _with(body: str) -> str:
    return "WITH" + CTES + body


def _breaks_sql() -> str:
    return f"""
paras AS (
  SELECT gen_id, unnest(range(len(p))) AS para_id, unnest(p) AS paragraph FROM (
    SELECT gen_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {STRIP('x')}), lambda x: x <> '') AS p
    FROM generations)),
para_sents AS (
  SELECT gen_id, para_id, {SENT('paragraph')} AS sents FROM paras),
para_offsets AS (
  SELECT gen_id, para_id, sents,
         coalesce(sum(len(sents)) OVER (PARTITION BY gen_id ORDER BY para_id
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM para_sents),
sent_rows AS (
  SELECT gen_id, CAST(off + idx AS BIGINT) AS sent_id, sentence FROM (
    SELECT gen_id, off, unnest(range(len(sents))) AS idx, unnest(sents) AS sentence FROM para_offsets))"""


PROMPTS = f"""
prompts AS (
 SELECT t.gen_id, t.fact_id,
        {q(P.VERIFY_HEADER)} || string_agg({q(P.VERIFY_LINE[0])} || p.text || {q(P.VERIFY_LINE[1])}, '' ORDER BY t.rk)
        || {q(P.VERIFY_QUESTION[0])} || {STRIP('any_value(f.fact)')} || {q(P.VERIFY_QUESTION[1])} AS prompt
 FROM top t JOIN passages p USING (gen_id, pos) JOIN facts f USING (gen_id, fact_id)
 GROUP BY t.gen_id, t.fact_id)"""
TAGS = """
tags AS (SELECT gen_id, fact_id, unnest(string_split(fact, ' ')) AS entity FROM facts)"""


def X(x: str) -> str:
    return f"CAST(length({x}) AS DOUBLE)"


def Y(x: str) -> str:
    return f"CAST(length({x}) - length(translate({x}, 'aeiou', '')) AS DOUBLE)"


ORACLE: dict[str, str] = {
    "knowledge_titles": _with("SELECT title_id, title FROM knowledge"),
    "paragraphs": _with("," + _breaks_sql() + " SELECT gen_id, para_id, paragraph FROM paras"),
    "sentence_split": _with(
        f" SELECT gen_id, unnest(range(len(s))) AS sent_id, unnest(s) AS sentence "
        f"FROM (SELECT gen_id, {SENT('text')} AS s FROM generations)"),
    "sentence_segments": _with(
        f" SELECT gen_id, unnest(range(len(s))) AS sent_id, unnest(s) AS sentence "
        f"FROM (SELECT gen_id, {SEGMENTS('text')} AS s FROM generations)"),
    "paragraph_breaks": _with("," + _breaks_sql() +
                              " SELECT gen_id, para_id, CAST(off AS BIGINT) AS break_at FROM para_offsets WHERE para_id > 0"),
    "parse_facts": _with(" SELECT gen_id, fact_id, fact FROM raw_facts"),
    "dedupe_facts": _with(" SELECT gen_id, fact_id, fact FROM facts"),
    "extraction_prompts": _with(
        f" SELECT gen_id, {q(P.GENERATION_INSTRUCTION + P.PASSAGE_FRAME[0])} || text || {q(P.PASSAGE_FRAME[1])} AS prompt "
        f"FROM generations"),
    "sentence_prompts": _with("," + _breaks_sql() +
                              f" SELECT gen_id, sent_id, {q(P.SENTENCE_INSTRUCTION + P.SENTENCE_FRAME[0])} || sentence || "
                              f"{q(P.SENTENCE_FRAME[1])} AS prompt FROM sent_rows"),
    "sentence_facts": _with("," + _breaks_sql() + f""",
sent_replies AS (SELECT gen_id, sent_id, {q(T.FACT_BULLET)} || {STRIP('sentence')} AS response FROM sent_rows),
sent_fl AS (SELECT gen_id, sent_id, {FACT_LIST('response')} AS fl FROM sent_replies),
sent_fa AS (SELECT gen_id, sent_id, {PARSED('fl')} AS fa FROM sent_fl)
SELECT gen_id, sent_id, unnest(range(len(fa))) AS fact_id, unnest(fa) AS fact FROM sent_fa"""),
    "fact_entities": _with(" SELECT f.gen_id, f.fact_id, t.entity FROM facts f LEFT JOIN tagged t USING (gen_id, fact_id)"),
    "distinct_entities": _with(" SELECT gen_id, entity FROM gen_entities"),
    "knn_exact": _with(" SELECT entity, title_id, rk, round(d2, 6) AS d2 FROM exact_neighbours"),
    "neighbours": _with(" SELECT entity, title_id, rk, round(d2, 6) AS d2 FROM neighbours"),
    "knn_bounded": _with(" SELECT entity, title_id, rk, round(d2, 6) AS d2 FROM exact_neighbours"),
    "lloyd_cells": _with(f"""
, start AS (SELECT cell, CAST(arg_min(embedding, title_id) AS DOUBLE[]) AS centroid FROM title_vectors GROUP BY cell),
cells_1 AS (SELECT title_id, cell FROM (
   SELECT v.title_id, c.cell, row_number() OVER (PARTITION BY v.title_id ORDER BY {D2('v.embedding', 'c.centroid')}, c.cell) AS rk
   FROM title_vectors v, start c) WHERE rk = 1),
step_1 AS (
  SELECT s.cell, coalesce(m.centroid, s.centroid) AS centroid FROM start s LEFT JOIN (
    SELECT cell, list(m ORDER BY dim) AS centroid FROM (
      SELECT cell, dim, avg(x::DOUBLE) AS m FROM (
        SELECT a.cell, unnest(range(len(v.embedding))) AS dim, unnest(v.embedding) AS x FROM title_vectors v JOIN cells_1 a USING (title_id))
      GROUP BY cell, dim)
    GROUP BY cell) m USING (cell)),
cells_2 AS (SELECT title_id, cell FROM (
   SELECT v.title_id, c.cell, row_number() OVER (PARTITION BY v.title_id ORDER BY {D2('v.embedding', 'c.centroid')}, c.cell) AS rk
   FROM title_vectors v, step_1 c) WHERE rk = 1),
step_2 AS (
  SELECT s.cell, coalesce(m.centroid, s.centroid) AS centroid FROM step_1 s LEFT JOIN (
    SELECT cell, list(m ORDER BY dim) AS centroid FROM (
      SELECT cell, dim, avg(x::DOUBLE) AS m FROM (
        SELECT a.cell, unnest(range(len(v.embedding))) AS dim, unnest(v.embedding) AS x FROM title_vectors v JOIN cells_2 a USING (title_id))
      GROUP BY cell, dim)
    GROUP BY cell) m USING (cell))
 SELECT CAST(cell AS BIGINT) AS cell, unnest(range(len(centroid))) AS dim, round(unnest(centroid), 6) AS x FROM step_2"""),
    "knn_ivf": _with(" SELECT entity, title_id, rk, round(d2, 6) AS d2 FROM ivf_neighbours"),
    "ivf_assign": _with(f"""
 SELECT title_id, CAST(cell AS BIGINT) AS cell FROM (
   SELECT v.title_id, c.cell,
          row_number() OVER (PARTITION BY v.title_id ORDER BY {D2('v.embedding', 'c.centroid')}, c.cell) AS rk
   FROM title_vectors v, centroids c)
 WHERE rk = 1"""),
    "index_shards": _with(
        " SELECT CAST(floor(title_id / 100) AS BIGINT) AS shard, count(*) AS n_titles, min(title_id) AS min_id, "
        "max(title_id) AS max_id FROM knowledge GROUP BY 1"),
    "vector_index": _with(f"""
 SELECT title_id, CAST(cell AS BIGINT) AS cell, n_dims FROM (
   SELECT v.title_id, c.cell, len(v.embedding) AS n_dims,
          row_number() OVER (PARTITION BY v.title_id ORDER BY {D2('v.embedding', 'c.centroid')}, c.cell) AS rk
   FROM title_vectors v, centroids c)
 WHERE rk = 1"""),
    "index_snapshots": _with(f"""
, assigned AS (
 SELECT title_id, CAST(cell AS BIGINT) AS cell, n_dims FROM (
   SELECT v.title_id, c.cell, len(v.embedding) AS n_dims,
          row_number() OVER (PARTITION BY v.title_id ORDER BY {D2('v.embedding', 'c.centroid')}, c.cell) AS rk
   FROM title_vectors v, centroids c)
 WHERE rk = 1)
 SELECT CAST(1 AS BIGINT) AS snapshot, * FROM assigned
 UNION ALL
 SELECT 2, * FROM assigned WHERE floor(title_id / 100) <> 1 OR cell % 2 = 0"""),
    "generation_lines": _with(" SELECT row_number() OVER (ORDER BY gen_id) - 1 AS place, text FROM generations"),
    "read_generations": _with(" SELECT text FROM generations"),
    "read_knowledge": _with(" SELECT DISTINCT title, text FROM knowledge"),
    "knowledge_source": _with(" SELECT k.title_id, k.title, CAST(v.cell AS BIGINT) AS cell FROM knowledge k LEFT JOIN title_vectors v USING (title_id)"),
    "embed_titles": _with(f" SELECT title_id, {X('title')} AS x, {Y('title')} AS y FROM knowledge WHERE length(title) <> 13"),
    "payloads": _with("""
 SELECT gen_id,
        '{"model":"judge","messages":[{"role":"user","content":"m' || length(text) || '"}],"temperature":0.0}' AS completion,
        '{"prompt":"e' || length(text) || '","model":"embedder","dimensionality":768}' AS embedding
 FROM generations"""),
    "decisions_map": _with(" SELECT r.gen_id, f.fact, r.decision FROM replayed r JOIN facts f USING (gen_id, fact_id) WHERE r.decision IS NOT NULL"),
    "complete_batch": _with("," + PROMPTS + """
 SELECT gen_id, fact_id,
        CASE WHEN length(prompt) % 7 < 5 THEN CASE WHEN length(prompt) % 7 % 2 = 0 THEN 'True' ELSE 'False' END END AS content,
        CASE WHEN length(prompt) % 7 = 6 THEN 0.0 ELSE round(length(prompt) / 1000, 6) END AS cost,
        CASE length(prompt) % 7 WHEN 6 THEN 'RuntimeError: refused' WHEN 5 THEN 'reply without content' END AS error,
        CASE WHEN length(prompt) % 7 < 5 THEN 'ok' ELSE 'failed' END AS status
 FROM prompts"""),
    "complete_rounds": _with("," + PROMPTS + """
 SELECT gen_id, fact_id,
        CASE WHEN length(prompt) % 6 < 4 THEN CASE WHEN length(prompt) % 2 = 0 THEN 'True' ELSE 'False' END END AS content,
        CASE WHEN length(prompt) % 6 < 4 THEN round(length(prompt) / 1000, 6) ELSE 0.0 END AS cost,
        CASE WHEN length(prompt) % 6 >= 4 THEN 'RuntimeError: refused 4' END AS error,
        least(length(prompt) % 6 + 1, 4) AS attempts,
        CASE WHEN length(prompt) % 6 < 4 THEN 'ok' ELSE 'failed' END AS status
 FROM prompts"""),
    "embed_all_titles": _with(f" SELECT title_id, {X('title')} AS x, {Y('title')} AS y FROM knowledge"),
    "embed_batch": _with(f"""
 SELECT entity, CASE WHEN length(entity) <> 13 THEN {X('entity')} END AS x, CASE WHEN length(entity) <> 13 THEN {Y('entity')} END AS y,
        CASE WHEN length(entity) = 13 THEN 'RuntimeError: refused' END AS error,
        CASE WHEN length(entity) = 13 THEN 'failed' ELSE 'ok' END AS status
 FROM (SELECT DISTINCT entity FROM gen_entities)"""),
    "tag_batch": _with("," + TAGS + " SELECT gen_id, fact_id, entity, CASE WHEN length(entity) = 4 THEN 'PER' ELSE 'MISC' END AS label FROM tags"),
    "person_tags": _with("," + TAGS + " SELECT DISTINCT gen_id, fact_id, entity FROM tags WHERE length(entity) = 4"),
    "missing_vectors": "SELECT d.doc_id AS title_id FROM documents d ANTI JOIN embeddings e ON d.doc_id = e.vec_id",
    "retrieved_texts": _with(" SELECT gen_id, entity, rk, title_id, text_id FROM hits"),
    "passages": _with(" SELECT gen_id, pos, title_id, text FROM passages"),
    "tokenize": _with(" SELECT gen_id, pos, len(string_split(text, ' ')) AS n_tokens FROM passages"),
    "bm25_idf": _with(" SELECT gen_id, token, round(idf, 6) + 0.0 AS idf FROM idf"),
    "bm25_top5": _with(" SELECT gen_id, fact_id, pos, rk, round(score, 6) + 0.0 AS score FROM top"),
    "verification_prompts": _with("," + PROMPTS + " SELECT gen_id, fact_id, prompt FROM prompts"),
    "lexical_answers": _with(" SELECT gen_id, fact_id, answer FROM answers"),
    "parse_answers": _with(f" SELECT row AS request_id, {DECIDE('answer')} AS decision FROM call_log"),
    "decisions": _with(" SELECT gen_id, fact_id, decision FROM replayed"),
    "responses": _with("""
 SELECT row AS request_id, CASE WHEN error IS NULL THEN answer END AS content,
        round(CASE WHEN error IS NULL THEN cost END, 6) AS cost,
        CASE WHEN error IS NOT NULL OR answer IS NULL THEN 'failed' ELSE 'ok' END AS status
 FROM call_log"""),
    "call_report": _with("""
 SELECT status, count(*) AS n_calls,
        round(sum(CASE WHEN status = 'ok' THEN coalesce(cost, 0.0) ELSE 0.0 END), 6) AS cost
 FROM all_calls GROUP BY status"""),
    "factual_precision": _with(" SELECT gen_id, n_decided, n_supported, score FROM precision"),
    "scores_all": _with(" SELECT gen_id, status, score, round(cost, 6) AS cost, process_time FROM scores"),
    "run_summary": _with("""
 SELECT model, round_even(avg(coalesce(score, 0.0)), 4) AS mean_score,
        round_even(avg(process_time), 4) AS mean_time, round_even(avg(cost), 4) AS mean_cost
 FROM scores GROUP BY model"""),
}
