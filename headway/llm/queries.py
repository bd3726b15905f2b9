"""Registered queries of the subpackage and the SQL of those that have one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (
    alignment, byte_bpe, conversations, decontamination, fingerprints, jaccard, licenses, packing, personal_data, quality, secrets, substrings,
    toxicity)
from .common import read

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PACKED = "word_bpe_49k.json"
ALIGNED = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.op1_toxicity(read(spark, d, "documents"), read(spark, d, "labels"))


def op2_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.op2_quality(read(spark, d, "documents"), read(spark, d, "labels"))


def op3_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontamination.op3_decontamination(read(spark, d, "documents"), read(spark, d, "benchmark"))


def op4_secrets(spark: SparkSession, d: str) -> DataFrame:
    return secrets.op4_secrets(read(spark, d, "documents"))


def op5_substrings(spark: SparkSession, d: str) -> DataFrame:
    return substrings.op5_substrings(read(spark, d, "documents"))


def op6_byte_bpe(spark: SparkSession, d: str) -> DataFrame:
    return byte_bpe.op6_byte_bpe(read(spark, d, "documents"), public_tokenizers.path(VOCABULARY))


def op7_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return fingerprints.op7_fingerprints(read(spark, d, "documents"))


def op8_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    return jaccard.op8_jaccard_join(read(spark, d, "documents"))


def op9_licenses(spark: SparkSession, d: str) -> DataFrame:
    return licenses.op9_licenses(read(spark, d, "documents"))


def op10_personal_data(spark: SparkSession, d: str) -> DataFrame:
    return personal_data.op10_personal_data(read(spark, d, "documents"))


def op11_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.op11_packing(read(spark, d, "documents"), public_tokenizers.path(PACKED))


def op12_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.op12_conversations(read(spark, d, "conversations"))


def op13_alignment(spark: SparkSession, d: str) -> DataFrame:
    return alignment.op13_alignment(read(spark, d, "documents"), *map(public_tokenizers.path, ALIGNED))


LLM_QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_quality, op3_decontamination, op4_secrets, op5_substrings, op6_byte_bpe,
    op7_fingerprints, op8_jaccard_join, op9_licenses, op10_personal_data, op11_packing,
    op12_conversations, op13_alignment)}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: CRC-32 of the text k, before its last inversion, a bit at a time.
_CRC = ("list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(k, ''), lambda x: ord(x)::BIGINT)), lambda v, b: "
        "list_reduce(list_concat([xor(v, b)], list_transform(range(8), lambda j: 0::BIGINT)), lambda w, j: "
        "CASE WHEN w % 2 = 1 THEN xor(w // 2, 3988292384) ELSE w // 2 END))")
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

LLM_ORACLES = {
    "op3_decontamination": f"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
 win AS (SELECT DISTINCT item_id, len(w[i:i + 12]) AS k, w[i:i + 12] AS g
         FROM item, range(1, greatest(len(w) - 12, 1) + 1) r(i) WHERE len(w) > 0),
 doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 gram AS (SELECT doc_id, i, k, w[i:i + k - 1] AS g
          FROM (SELECT doc_id, w, k FROM doc CROSS JOIN (SELECT DISTINCT k FROM win)), range(1, len(w) - k + 2) r(i)),
 hit AS (SELECT doc_id, i, k, item_id FROM gram JOIN win USING (k, g)),
 pos AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM hit, range(0, k) s(j) GROUP BY 1),
 its AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s
         FROM hit GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(pos.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
 sha256(coalesce(its.s, '')) AS items_sha256,
 coalesce(pos.n, 0) > 0 AND 20 * coalesce(pos.n, 0) >= len(w) AS contaminated
FROM doc d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op12_conversations": rf"""
WITH RECURSIVE place AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
 src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor({_CRC}, 4294967295) % 20 AS f FROM place),
 dmg AS (SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, c,
         CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
         FROM src, range(CASE f WHEN 3 THEN 2 ELSE 1 END) r(c) WHERE f <> 0),
 num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, c) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, c) AS nth FROM dmg),
 flag AS (SELECT conv_id, turn, role, text, i, role[1] AS r, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN nth > 1 THEN 'd'
         WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE 'k' END AS fault,
         lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS two FROM num),
 ins(q, p, c, l, t) AS (VALUES (0, 0, 0, '', ''), (0, 2, 3, 'I', chr(10) || 'user:'), (0, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
         (1, 1, 0, '', ''), (1, 2, 3, 'I', chr(10) || 'user:'), (1, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
         (2, 2, 0, '', ''), (2, 3, 3, 'I', chr(10) || 'assistant:'), (3, 3, 0, '', ''), (3, 2, 3, 'I', chr(10) || 'user:')),
 ed(p, l, r, n, c, s) AS (VALUES (0, 'D', '', 0, 4, ''), (1, 'D', '', 1, 4, ''), (2, 'D', '', 2, 4, ''), (3, 'D', '', 3, 4, ''),
         (0, 'K', 's', 1, 0, ''), (0, 'K', 'u', 2, 0, ''), (1, 'K', 'u', 2, 0, ''), (3, 'K', 'u', 2, 0, ''), (2, 'K', 'a', 3, 0, ''),
         (0, 'R', '', 2, 3, 'user'), (1, 'R', '', 2, 3, 'user'), (3, 'R', '', 2, 3, 'user'), (2, 'R', '', 3, 3, 'assistant')),
 st(conv_id, i, q, cost, audit, rep) AS (
   SELECT DISTINCT conv_id, 0::BIGINT, 0, 0, '', '' FROM conversations
   UNION ALL
   SELECT conv_id, i, q, cost, audit, rep FROM (
     SELECT *, row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) AS best FROM (
       SELECT st.conv_id, f.i, ed.n AS q, st.cost + ins.c + ed.c + CASE WHEN fault = 't' AND ed.l <> 'D' THEN 3 ELSE 0 END AS cost,
         st.audit || ins.l || ed.l AS audit, st.rep || ins.t || CASE ed.l WHEN 'K' THEN chr(10) || f.role || ':' || f.text
           WHEN 'R' THEN chr(10) || ed.s || ':' || f.text ELSE '' END AS rep
       FROM st JOIN flag f ON f.conv_id IS NOT DISTINCT FROM st.conv_id AND f.i = st.i + 1 JOIN ins ON ins.q = st.q
       JOIN ed ON ed.p = ins.p AND (ed.l <> 'K' OR ed.r = f.r) AND (ed.l = 'D' OR f.fault NOT IN ('b', 'd')))) WHERE best = 1),
 last AS (SELECT st.conv_id, cost + ins.c AS cost, audit || ins.l AS audit, rep || ins.t AS rep,
         row_number() OVER (PARTITION BY st.conv_id ORDER BY cost + ins.c, audit || ins.l) AS best
         FROM st JOIN (SELECT conv_id, max(i) AS i FROM st GROUP BY 1) m ON m.conv_id IS NOT DISTINCT FROM st.conv_id AND m.i = st.i
         JOIN ins ON ins.q = st.q WHERE ins.p IN (0, 3)),
 fault AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM flag GROUP BY 1)
SELECT l.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
 coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, cost::BIGINT AS cost, audit, sha256(rep[2:]) AS repaired_sha256
FROM last l LEFT JOIN fault f ON f.conv_id IS NOT DISTINCT FROM l.conv_id WHERE best = 1""",
    "op8_jaccard_join": rf"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
 sh AS (SELECT DISTINCT doc_id, w[i:i + 4] AS g FROM doc, range(1, greatest(len(w) - 4, 1) + 1) r(i) WHERE len(w) > 0),
 size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
 pair AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM sh a JOIN sh b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
 link AS (SELECT u, v FROM pair JOIN size x ON x.doc_id = u JOIN size y ON y.doc_id = v WHERE 100 * k >= 80 * (x.n + y.n - k)),
 reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT a, v FROM reach JOIN link ON b = u)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m AS component_id
FROM documents d LEFT JOIN size USING (doc_id) JOIN (SELECT a, min(b) AS m FROM reach GROUP BY 1) ON a = d.doc_id""",
    "op5_substrings": r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 win AS (SELECT doc_id, i, w[i:i + 34] AS g FROM doc, range(1, len(w) - 33) r(i)),
 dup AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
 pos AS (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN dup USING (g), range(0, 35) s(j)),
 word AS (SELECT doc_id, p, w[p] AS t FROM doc, range(1, len(w) + 1) r(p)),
 kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY p) AS s, count(*) AS n FROM word ANTI JOIN pos USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
 sha256(coalesce(s, '')) AS kept_sha256 FROM doc LEFT JOIN kept USING (doc_id)""",
}
