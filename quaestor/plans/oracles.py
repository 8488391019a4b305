"""The registered queries in SQL, for comparison. Written from the semantics, not from the jobs."""

from __future__ import annotations

import re

from quaestor import fixed_values as V
from quaestor.plans.catalog import PAGE_HOSTS, REFRESH_RUNS
from quaestor.plans.stem_sql import stems
from quaestor.sources.driver_tables import NOW, TODAY


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def fold(x: str) -> str:
    return f"replace(replace(translate(lower({x}), '{V.ACCENTED}', '{V.UNACCENTED}'), 'œ', 'oe'), 'æ', 'ae')"


def words(x: str, stop) -> str:
    return f"list_filter(regexp_extract_all({x}, '[a-z0-9]{{2,}}'), lambda w: w NOT IN ({_list(stop)}))"


def query_words(x: str) -> str:
    return words(fold(x), V.STOP_WORDS)


def index_words(x: str) -> str:
    plain = f"regexp_replace({fold(x)}, '/?[a-z0-9]+(?:/[a-z0-9]+)+|/[a-z0-9]+', ' ', 'g')"
    return words(plain, V.INDEX_STOP_WORDS)


def expanded(x: str) -> str:
    parts = [x]
    for pattern, addition in V.SYNONYM_RULES:
        parts.append(f"CASE WHEN regexp_matches({fold(x)}, '{pattern}') THEN '{addition}' ELSE '' END")
    return "(" + " || ".join(parts) + ")"


NL = "chr(10)"
BLANK = r"'\S'"

RECS = rf"""
recs AS MATERIALIZED (
  SELECT doc_id, 'D-' || doc_id AS question_id, doc_id::VARCHAR AS moncode,
    CASE WHEN trim(split_part(fl, '.', 1)) = '' THEN fl ELSE trim(split_part(fl, '.', 1)) END AS titre,
    lang AS auteur, source AS destinataire, fl AS question,
    CASE WHEN regexp_matches(rest, {BLANK}) THEN rest END AS reponse,
    (DATE '2024-01-01' + (doc_id % 700)::INT)::DATE AS date_reception,
    CASE WHEN regexp_matches(rest, {BLANK}) THEN (DATE '2024-02-10' + (doc_id % 700)::INT)::DATE END AS date_reponse,
    'http://records.example.org/detail?code=' || doc_id AS url_source
  FROM (SELECT *, split_part(text, {NL}, 1) AS fl, substr(text, length(split_part(text, {NL}, 1)) + 2) AS rest FROM documents)
)"""

PASSAGES = rf"""
bodies AS (
  SELECT question_id, section, list_aggregate(list_transform(list_filter(string_split(body, {NL}), lambda p: p <> ''),
      lambda p: CASE WHEN length(p) > 2200 THEN chr(1) || regexp_replace(ltrim(p), '\s+', ' ', 'g') ELSE p END), 'string_agg', {NL}) AS flow
  FROM (SELECT question_id, 'question' AS section, question AS body FROM recs
        UNION ALL SELECT question_id, 'reponse', reponse FROM recs WHERE reponse IS NOT NULL)
), cuts AS (
  SELECT question_id, section, 0 AS position, NULL::VARCHAR AS content, replace(flow, {NL} || chr(1), chr(1)) AS rest FROM bodies
  UNION ALL
  SELECT question_id, section, position + 1, left(seg, n)::VARCHAR,
    CASE WHEN substr(body, n + 1, 1) = ' ' THEN substr(body, n + 2) ELSE substr(body, n + 1) END
  FROM (
    SELECT *, CASE WHEN length(seg) <= 2200 THEN length(seg)
        WHEN contains(seg[1:2201], {NL}) THEN 2201 - instr(reverse(seg[1:2201]), {NL})
        WHEN contains(seg[1:2201], ' ') THEN 2201 - instr(reverse(seg[1:2201]), ' ')
        ELSE length(regexp_extract(seg, '^[^ \n]+')) END AS n
    FROM (
      SELECT question_id, section, position, body,
        CASE WHEN contains(body, chr(1)) THEN left(body, instr(body, chr(1)) - 1) ELSE body END AS seg
      FROM (SELECT *, CASE WHEN left(rest, 1) IN ({NL}, chr(1)) THEN substr(rest, 2) ELSE rest END AS body FROM cuts WHERE rest <> '')
    )
  )
), passages AS MATERIALIZED (
  SELECT question_id || ':' || section || ':' || (position - 1) AS passage_id, c.question_id, section, (position - 1)::INT AS position, content,
    titre || {NL} || auteur || {NL} || destinataire || {NL} || upper(section) || {NL} || content AS search_text
  FROM cuts c JOIN recs USING (question_id) WHERE content IS NOT NULL
)"""

TERMS = f"""
asked AS (SELECT item_id AS query_id, text, 6 AS lim FROM benchmark),
qwords AS (
  SELECT query_id, unnest(w) AS word, unnest(range(len(w))) AS pos
  FROM (SELECT query_id, {query_words(expanded('text'))} AS w FROM asked)
), qranked AS (
  SELECT query_id, word, row_number() OVER (PARTITION BY query_id ORDER BY min(pos)) AS rn
  FROM qwords WHERE word NOT IN ({_list(V.QUERY_GENERIC_WORDS)}) GROUP BY query_id, word
), terms AS MATERIALIZED (
  SELECT query_id, word AS term, rn, count(*) OVER (PARTITION BY query_id) AS n_terms FROM qranked WHERE rn <= {V.MAX_QUERY_TERMS}
)"""

RECORD_TEXT = f"titre || {NL} || auteur || {NL} || destinataire || {NL} || 'QUESTION' || {NL} || question || {NL} || 'REPONSE' || {NL} || reponse"

LEXICAL = f"""
doc_terms AS MATERIALIZED (
  SELECT question_id, unnest(list_distinct({index_words(RECORD_TEXT)})) AS term FROM recs WHERE reponse IS NOT NULL
), title_terms AS (SELECT DISTINCT question_id, unnest({index_words('titre')}) AS term FROM recs),
found AS MATERIALIZED (
  SELECT question_id, term, t.term IS NOT NULL AS in_title FROM doc_terms LEFT JOIN title_terms t USING (question_id, term) WHERE term IN (SELECT term FROM terms)
), idf AS (
  SELECT term, ln(1 + (SELECT count(*) FROM recs WHERE reponse IS NOT NULL) / (1 + count(*))) AS idf FROM found GROUP BY term
), lexical AS MATERIALIZED (
  SELECT query_id, question_id, round(sum(idf * CASE WHEN in_title THEN 3 ELSE 1 END) / sqrt(any_value(n_terms)), 9) AS lexical
  FROM terms JOIN found USING (term) JOIN idf USING (term) GROUP BY query_id, question_id
)"""

SIMILAR = """
vectors AS (SELECT 'D-' || vec_id AS question_id, 'D-' || vec_id || ':reponse:0' AS passage_id, embedding::DOUBLE[] AS e FROM embeddings),
qvec AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id IN (SELECT query_id FROM asked)),
similar_all AS (
  SELECT query_id, question_id, passage_id, list_cosine_similarity(e, q) AS similarity
  FROM vectors JOIN recs USING (question_id), qvec WHERE reponse IS NOT NULL
), near_pairs AS MATERIALIZED (SELECT * FROM similar_all WHERE similarity >= 0.35)"""

LEX_FUSED = """
fused AS (
  SELECT query_id, question_id, lexical, r AS lexical_rank, 0 AS semantic_rank, 1.0::DOUBLE / (60 + r) AS score, r = 1 AS leader
  FROM (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY lexical DESC) AS r FROM lexical)
)"""

HYBRID_FUSED = """
semantic AS (SELECT query_id, question_id, round(max(similarity), 9) AS semantic FROM near_pairs GROUP BY ALL),
fused AS (
  SELECT query_id, question_id, coalesce(lr, 0) AS lexical_rank, coalesce(sr, 0) AS semantic_rank,
    coalesce(1.0::DOUBLE / (60 + lr), 0) + coalesce(1.0::DOUBLE / (60 + sr), 0) AS score,
    coalesce(lr = 1, false) OR coalesce(sr = 1, false) AS leader
  FROM (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY lexical DESC) AS lr FROM lexical)
  FULL JOIN (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY semantic DESC) AS sr FROM semantic) USING (query_id, question_id)
)"""


def selected(limit: int) -> str:
    return f"""
selected AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, question_id) AS document_rank
  FROM (SELECT * FROM fused QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY leader DESC, round(score, 12) DESC, question_id) <= {limit})
)"""


def hits(similarity: str) -> str:
    return f"""
wanted AS (SELECT query_id, list(term) AS wanted FROM terms GROUP BY query_id),
scored AS (
  SELECT s.query_id, s.question_id, s.score, document_rank, passage_id, position, content,
    len(list_filter({index_words('content')}, lambda w: list_contains(wanted, w))) AS occurrences, {similarity} AS similarity
  FROM selected s JOIN passages p ON p.question_id = s.question_id AND section = 'reponse' JOIN wanted USING (query_id)
), best AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY query_id, question_id ORDER BY round(similarity, 9) DESC, occurrences DESC, position) AS passage_rank
  FROM scored QUALIFY passage_rank <= 2
), hits AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN document_rank = 1 THEN 0 ELSE passage_rank END, document_rank, passage_rank) AS hit_rank
  FROM best QUALIFY hit_rank <= 6
)"""


RELEVANT = f"""
own AS (
  SELECT DISTINCT query_id, unnest({query_words('text')}) AS w FROM asked
), own_terms AS (SELECT query_id, w FROM own WHERE w NOT IN ({_list(V.FILTER_GENERIC_WORDS)})),
own_lists AS (SELECT query_id, list(w) AS ws FROM own_terms GROUP BY query_id),
relevant AS (
  SELECT query_id, question_id FROM (SELECT DISTINCT query_id, question_id FROM hits) JOIN recs USING (question_id) JOIN own_lists USING (query_id)
  WHERE len(list_intersect(ws, list_distinct({query_words("titre || ' ' || question || ' ' || coalesce(reponse, '')")}))) / len(ws) >= 0.6
), filtered AS MATERIALIZED (
  SELECT * EXCLUDE (hit_rank), row_number() OVER (PARTITION BY query_id ORDER BY hit_rank) AS hit_rank
  FROM hits SEMI JOIN relevant USING (query_id, question_id)
)"""

LEX_SIMILARITY = "0.0"
HYB_SIMILARITY = """coalesce((SELECT list_cosine_similarity(e, q) FROM vectors v, qvec WHERE v.passage_id = p.passage_id AND qvec.query_id = s.query_id), 0.0)"""


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


LEX_HITS = with_(RECS, PASSAGES, TERMS, LEXICAL, LEX_FUSED, selected(6), hits(LEX_SIMILARITY))
LEX_FILTERED = with_(RECS, PASSAGES, TERMS, LEXICAL, LEX_FUSED, selected(6), hits(LEX_SIMILARITY), RELEVANT)
HYB_HITS = with_(RECS, PASSAGES, TERMS, LEXICAL, SIMILAR, HYBRID_FUSED, selected(6), hits(HYB_SIMILARITY))

# The same search by roots: every word meets its root first.
VOCABULARY = f"""
vocabulary AS (
  SELECT unnest(regexp_extract_all({fold(f"concat_ws({NL}, titre, auteur, destinataire, 'QUESTION', question, 'REPONSE', reponse)")}, '[a-z0-9]{{2,}}')) AS word FROM recs
)"""
SAID = VOCABULARY + f""",
said AS (
  SELECT word FROM vocabulary UNION SELECT unnest({query_words(expanded('text'))}) FROM benchmark
  UNION SELECT unnest([{_list([*V.QUERY_GENERIC_WORDS, *V.FILTER_GENERIC_WORDS])}])
)"""
STEMMED_TERMS = f"""
asked AS (SELECT item_id AS query_id, text, 6 AS lim FROM benchmark),
qwords AS (
  SELECT query_id, unnest(w) AS word, unnest(range(len(w))) AS pos
  FROM (SELECT query_id, {query_words(expanded('text'))} AS w FROM asked)
), qranked AS (
  SELECT query_id, stem, row_number() OVER (PARTITION BY query_id ORDER BY min(pos)) AS rn
  FROM qwords JOIN stems USING (word) WHERE stem NOT IN (SELECT stem FROM stems WHERE word IN ({_list(V.QUERY_GENERIC_WORDS)})) GROUP BY query_id, stem
), terms AS MATERIALIZED (
  SELECT query_id, stem AS term, rn, count(*) OVER (PARTITION BY query_id) AS n_terms FROM qranked WHERE rn <= {V.MAX_QUERY_TERMS}
)"""
STEMMED_LEXICAL = LEXICAL.replace(
    f"SELECT question_id, unnest(list_distinct({index_words(RECORD_TEXT)})) AS term FROM recs WHERE reponse IS NOT NULL",
    f"SELECT DISTINCT question_id, stem AS term FROM (SELECT question_id, unnest({index_words(RECORD_TEXT)}) AS word FROM recs WHERE reponse IS NOT NULL) JOIN stems USING (word)",
).replace(
    f"SELECT DISTINCT question_id, unnest({index_words('titre')}) AS term FROM recs",
    f"SELECT DISTINCT question_id, stem AS term FROM (SELECT question_id, unnest({index_words('titre')}) AS word FROM recs) JOIN stems USING (word)",
)
STEMMED_HITS = hits(LEX_SIMILARITY).replace(
    "SELECT query_id, list(term) AS wanted FROM terms GROUP BY query_id",
    "SELECT query_id, list(word) AS wanted FROM terms JOIN stems ON stem = term GROUP BY query_id",
)
STEMMED_RELEVANT = RELEVANT.replace(
    f"SELECT query_id, w FROM own WHERE w NOT IN ({_list(V.FILTER_GENERIC_WORDS)})",
    f"SELECT DISTINCT query_id, stem AS w FROM own JOIN stems ON word = w WHERE stem NOT IN (SELECT stem FROM stems WHERE word IN ({_list(V.FILTER_GENERIC_WORDS)}))",
).replace(
    "relevant AS (\n",
    f"""found_words AS (
  SELECT DISTINCT query_id, question_id, stem AS w FROM (
    SELECT query_id, question_id, unnest({query_words("titre || ' ' || question || ' ' || coalesce(reponse, '')")}) AS word
    FROM (SELECT DISTINCT query_id, question_id FROM hits) JOIN recs USING (question_id)) JOIN stems USING (word)
), relevant AS (
  SELECT query_id, question_id FROM found_words JOIN own_terms USING (query_id, w) JOIN own_lists USING (query_id)
  GROUP BY query_id, question_id HAVING count(*) / any_value(len(ws)) >= 0.6
), unused AS (
""",
)
STEMMED_FILTERED = with_(RECS, SAID, stems("said"), PASSAGES, STEMMED_TERMS, STEMMED_LEXICAL, LEX_FUSED, selected(6), STEMMED_HITS, STEMMED_RELEVANT)

INDEX = r"""
raw AS (
  SELECT CASE WHEN o_orderstatus IN ('O', 'F') THEN 'PRB' ELSE 'COCOM' END AS assembly, o_orderkey::VARCHAR AS moncode,
    CASE WHEN o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED') THEN NULL ELSE o_orderdate::DATE END AS date_reception,
    'Genre ' || o_orderstatus AS kind, 'Question écrite concernant le dossier ' || o_custkey || ' & suites' AS titre,
    'Vraag over dossier ' || o_custkey AS titre_nl, 'Auteur ' || (o_custkey % 97) AS auteur, 'Ministre' AS destinataire,
    CASE WHEN o_totalprice > 400000 THEN '2' ELSE '1' END AS type, *
  FROM orders
), rows AS (SELECT * FROM raw WHERE assembly = 'PRB' AND type = '1' AND date_reception IS NOT NULL),
current AS (
  SELECT o_orderkey::VARCHAR AS moncode, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN year(o_orderdate) < 1999 THEN '1994-1999' ELSE '1999-2004' END AS legislature,
    o_orderdate::DATE AS date_reception, CASE WHEN o_orderstatus = 'F' THEN o_orderdate::DATE + 30 END AS date_publication,
    CASE WHEN o_orderstatus <> 'O' THEN o_orderdate::DATE + 90 END AS date_reponse,
    CASE WHEN o_orderstatus <> 'O' THEN 'Texte de la réponse' END AS reponse
  FROM orders WHERE o_orderpriority <> '1-URGENT'
)"""

PLAN = f"""
plan AS (
  SELECT moncode, CASE WHEN c.moncode IS NULL THEN 'candidate'
      WHEN r.moncode IS NOT NULL AND CASE WHEN c.reponse IS NULL
          THEN c.date_reception >= DATE '{TODAY}' - 240 OR moncode::BIGINT % 4 = ((DATE '{TODAY}' - DATE '1970-01-01') + 719163) // 7 % 4
          ELSE c.date_reponse >= DATE '{TODAY}' - 14 END THEN 'recheck'
      ELSE 'kept' END AS action
  FROM current c FULL JOIN rows r USING (moncode)
)"""

OUTCOMES = """
fetched AS (
  SELECT o_orderkey::VARCHAR AS moncode, CASE WHEN o_orderpriority = '2-HIGH' THEN 'question_text_empty' WHEN o_totalprice > 380000 THEN 'question_block_missing' END AS reject
  FROM orders WHERE o_totalprice > 150000
), outcomes AS (
  SELECT moncode, action, CASE WHEN f.moncode IS NULL THEN 'network' ELSE coalesce(reject, 'ok') END AS outcome
  FROM plan LEFT JOIN fetched f USING (moncode) WHERE action <> 'kept'
)"""

STORE = r"""
stored AS (SELECT *, sha256(question_id || chr(10) || question || chr(10) || coalesce(reponse, '')) AS digest FROM recs),
members AS (
  SELECT v AS version_id, question_id,
    CASE WHEN v IN ('v1', 'v3') THEN '0' WHEN v = 'v2' AND auteur = 'fr' THEN '0' WHEN v = 'v5' AND destinataire = 'src3' THEN 'X'
      WHEN v = 'v5' THEN '0' ELSE 'A' END || ':' || digest AS content_hash
  FROM stored, (SELECT unnest(['v1', 'v2', 'v3', 'v4', 'v5']) AS v)
), doc_store AS (
  SELECT v || ':' || digest AS content_hash, question_id, titre, reponse, date_reception, date_reponse,
    CASE WHEN auteur = 'es' THEN TIMESTAMP '2024-06-01 11:30:00' ELSE TIMESTAMP '2024-05-01 08:00:00' END AS created_at
  FROM stored, (SELECT unnest(['0', 'A']) AS v)
), versions AS (
  SELECT version_id, count(*)::INT AS count, version_id = 'v1' AS active, CASE WHEN version_id = 'v5' THEN TIMESTAMP '2024-06-01 11:40:00' ELSE TIMESTAMP '2024-05-01' END AS created_at,
    CASE version_id WHEN 'v1' THEN DATE '2024-05-30' WHEN 'v2' THEN DATE '2024-05-20' WHEN 'v3' THEN DATE '2024-05-10' END AS activated_at,
    false AS activation_unknown, CASE version_id WHEN 'v2' THEN NULL WHEN 'v4' THEN 'passages-1;m-A;64' ELSE 'passages-1;sans-embeddings;64' END AS index_config
  FROM members GROUP BY version_id
)"""
PASSAGE_STORE = """
passage_store AS (
  SELECT v || ':' || digest AS content_hash, p.*, CASE WHEN v = 'A' THEN e.embedding END AS embedding, CASE WHEN v = 'A' THEN 'm-A' END AS embedding_model
  FROM passages p JOIN stored USING (question_id) LEFT JOIN embeddings e ON p.passage_id = 'D-' || e.vec_id || ':reponse:0', (SELECT unnest(['0', 'A']) AS v)
)"""
FULL_STORE = with_(RECS, PASSAGES, STORE, PASSAGE_STORE)
DOC_STORE = with_(RECS, STORE)

USAGE = """
usage AS (
  SELECT event_id, ts, user_id::VARCHAR AS session, (user_id % 20)::VARCHAR AS ip, event_type,
    event_type = 'error' AND lag(event_type) OVER w IS NOT NULL AND lag(event_type) OVER w <> 'error' AS release
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
)"""

CASES = f"""
expected AS MATERIALIZED (SELECT item_id AS query_id, 'D-' || doc_id AS question_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
cases AS (
  SELECT query_id, CASE WHEN k.query_id IS NULL THEN 'hors_sujet' WHEN length(text) > 200 THEN 'titre' ELSE 'citoyen' END AS kind,
    k.query_id IS NULL AS off_topic, CASE WHEN length(text) > 250 THEN 1 ELSE 3 END AS max_rank, contains(text, {NL}) AS gap
  FROM asked LEFT JOIN (SELECT DISTINCT query_id FROM expected) k USING (query_id)
), ranked AS (
  SELECT query_id, question_id, row_number() OVER (PARTITION BY query_id ORDER BY min(hit_rank)) AS record_rank FROM filtered GROUP BY query_id, question_id
), judged AS (
  SELECT query_id, kind, off_topic, gap, CASE WHEN NOT off_topic THEN rank END AS rank,
    CASE WHEN off_topic THEN CASE WHEN n > 0 THEN '{V.REASON_OFF_TOPIC_RESULTS}' END
      WHEN rank IS NULL THEN '{V.REASON_EXPECTED_MISSING}'
      WHEN rank > max_rank THEN 'rang ' || rank || ' au-delà de ' || max_rank END AS reason
  FROM cases LEFT JOIN (SELECT query_id, min(record_rank) AS rank FROM ranked SEMI JOIN expected USING (query_id, question_id) GROUP BY query_id) USING (query_id)
  LEFT JOIN (SELECT query_id, count(*) AS n FROM ranked GROUP BY query_id) USING (query_id)
)"""
JUDGED = LEX_FILTERED.rstrip() + "," + CASES

SQL: dict[str, str] = {}

SQL["index_scan"] = with_(INDEX) + "SELECT moncode, strftime(date_reception, '%Y-%m-%d') AS date_reception, titre, titre_nl, auteur, destinataire FROM rows"
SQL["envelope_scan"] = SQL["index_scan"]
SQL["sample_per_author"] = with_(INDEX) + """
SELECT moncode, strftime(date_reception, '%Y-%m-%d') AS date_reception, auteur FROM (
  SELECT * FROM rows WHERE date_reception <= DATE '2000-06-30' QUALIFY row_number() OVER (PARTITION BY auteur ORDER BY date_reception DESC, moncode::BIGINT DESC) = 1
) ORDER BY date_reception DESC, moncode::BIGINT DESC LIMIT 10"""
SQL["index_stats"] = with_(INDEX) + """
SELECT 'assembly' AS statistic, assembly AS value, count(*) AS rows FROM raw GROUP BY assembly
UNION ALL SELECT 'kind', kind, count(*) FROM raw GROUP BY kind
UNION ALL SELECT 'written questions', assembly, count(*) FROM raw WHERE assembly = 'PRB' AND type = '1' GROUP BY assembly"""
SQL["page_text"] = r"""
SELECT page_id, list_aggregate(list_filter(list_transform(string_split(t, chr(10)), lambda l: trim(regexp_replace(l, '\s+', ' ', 'g'))), lambda l: l <> ''), 'string_agg', chr(10)) AS text
FROM (SELECT page_id, replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?s)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', '', 'g'), '(?i)<(?:br\b[^>]*|/p|/li|/tr|/div)>', chr(10), 'g'), '<[^>]+>', '', 'g'),
    '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS t FROM pages)"""
SQL["page_extract"] = with_(RECS) + r"""
SELECT moncode, 'PRB-1-' || moncode AS id, 'https://records.example.org/detail?code=' || moncode || '&base=1' AS url_source, '2023-2024' AS session, moncode::INT AS numero,
  strftime(date_reception, '%Y-%m-%d') AS date_publication,
  CASE auteur WHEN 'de' THEN NULL WHEN 'es' THEN '' ELSE trim(regexp_replace(question, '\s+', ' ', 'g')) END AS question,
  list_aggregate(list_filter(list_transform(string_split(reponse, chr(10)), lambda l: trim(regexp_replace(l, '\s+', ' ', 'g'))), lambda l: l <> ''), 'string_agg', chr(10)) AS reponse,
  sha256('<html><section id="record-fr"><!-- <b>Session:</b> non --><b>Session:</b> 2023-2024<br><b>Date de publication:</b> ' || strftime(date_reception, '%d/%m/%Y')
    || '<br><p>question n° ' || moncode || '</p><a href="/doc/' || moncode || '.pdf">annexe</a><table>'
    || CASE auteur WHEN 'de' THEN '' ELSE '<tr><td><b>Question&nbsp;</b></td><td>' || CASE auteur WHEN 'es' THEN '' ELSE replace(replace(question, '&', '&amp;'), '<', '&lt;') END || '</td></tr>' END
    || coalesce('<tr><td><b>R&eacute;ponse</b></td><td><p>' || replace(replace(replace(reponse, '&', '&amp;'), '<', '&lt;'), chr(10), '<br>') || '</p></td></tr>', '')
    || '</table></section></html>') AS empreinte_contenu,
  CASE auteur WHEN 'de' THEN 'question_block_missing' WHEN 'es' THEN 'question_text_empty' END AS reject_reason, '/doc/' || moncode || '.pdf' AS pdf_links
FROM recs
UNION ALL SELECT 'P' || page_id, 'PRB-1-P' || page_id, 'https://records.example.org/detail?code=P' || page_id || '&base=1', NULL, -1, NULL, NULL, NULL, sha256(html), 'unknown_structure',
  coalesce(list_aggregate(list_distinct(regexp_extract_all(html, '<a[^>]+href=[''"]([^''"]*\.pdf[^''"]*)', 1)), 'string_agg', '|'), '') FROM pages"""
SQL["page_acts"] = """
SELECT o_orderkey, 1 AS position, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderstatus AS acte, CASE WHEN o_totalprice > 250000 THEN o_orderpriority END AS acteur FROM orders"""
SQL["extraction_fidelity"] = with_(RECS) + """
SELECT question_id, auteur NOT IN ('de', 'es') OR (reponse IS NOT NULL AND contains(regexp_replace(reponse, '\\s+', ' ', 'g'), question)) AS question_found,
  true AS answer_found, reponse IS NOT NULL AS complete FROM recs"""
SQL["url_rule"] = f"""
SELECT page_id, CASE WHEN regexp_extract(url, '^(?i:https?)://([^/?#]*)', 1) IN ({_list(PAGE_HOSTS)}) THEN regexp_replace(url, '^http:', 'https:') END AS official_url FROM pages"""
SQL["fold_accents"] = rf"""
SELECT doc_id, f AS folded, regexp_replace(regexp_replace(f, '([a-z0-9])[.@]([a-z0-9])', '\1 \2', 'g'), '([a-z0-9])[.@]([a-z0-9])', '\1 \2', 'g') AS searched
FROM (SELECT doc_id, {fold('text')} AS f FROM documents)"""
SQL["word_tokens"] = f"""
SELECT doc_id, len(w) AS n_words, coalesce(array_to_string(list_sort(list_distinct(w)), ' '), '') AS tokens, coalesce(array_to_string(i, ' '), '') AS indexed
FROM (SELECT doc_id, {query_words('text')} AS w, {index_words('text')} AS i FROM documents)"""
SQL["nature"] = with_(RECS) + """
SELECT doc_id, CASE WHEN r IS NULL THEN 'absente'
  WHEN regexp_matches(lower(r), 'aucune des questions ne relève|ne relève(nt)? pas de (ma|la) compétence|adresser toutes vos questions à ma collègue') THEN 'incompetence'
  WHEN length(r) < 600 AND regexp_matches(lower(r), 'renvoie|réponse à la question') THEN 'renvoi' ELSE 'fond' END AS nature
FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Aucune des questions ne relève de mes attributions. ' WHEN 1 THEN 'Cela NE RELÈVENT PAS de la compétence du ministre. '
  WHEN 2 THEN 'Je vous renvoie au site. ' WHEN 3 THEN 'Voir la réponse à la question 12. ' WHEN 4 THEN 'Veuillez adresser toutes vos questions à ma collègue. ' ELSE '' END || reponse AS r FROM recs)"""
SQL["latest_date"] = with_(INDEX) + "SELECT moncode, strftime(greatest(date_reception, date_publication, date_reponse), '%Y-%m-%d') AS latest FROM current"
SQL["display_labels"] = with_(INDEX) + f"""
SELECT moncode, replace(titre, 'Question écrite concernant ', '') AS short_title,
  CASE WHEN day(date_reception) > 2 THEN day(date_reception) || ' ' || ([{_list(V.FRENCH_MONTHS)}])[month(date_reception)] || ' ' || year(date_reception) ELSE 'date non renseignée' END AS date_label FROM rows"""
SQL["legislature_names"] = """
SELECT o_orderkey, (CASE WHEN y < 50 THEN 2000 ELSE 1900 END + y) || '-' || (CASE WHEN z < 50 THEN 2000 ELSE 1900 END + z) AS legislature
FROM (SELECT o_orderkey, year(o_orderdate) % 100 AS y, (year(o_orderdate) + 5) % 100 AS z FROM orders)"""
SQL["index_config"] = """
SELECT c_custkey, CASE WHEN c_custkey % 7 > 0 THEN config END AS config,
  CASE WHEN c_custkey % 7 = 0 THEN 'modele-ancien' WHEN m IS NULL OR c_custkey % 5 = 0 THEN NULL ELSE m END AS query_model
FROM (SELECT *, 'passages-1;' || coalesce(m, 'sans-embeddings') || ';' || CASE WHEN c_custkey % 5 = 0 THEN '3072' ELSE '1536' END AS config
  FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN 'modele-' || (c_custkey % 3) END AS m FROM customer))"""
SQL["content_hash"] = with_(RECS) + """
SELECT question_id, sha256(to_json({'question_id': question_id, 'moncode': moncode, 'titre': titre, 'auteur': auteur, 'destinataire': destinataire, 'question': question,
  'reponse': reponse, 'url_source': url_source})::VARCHAR || chr(10) || 'passages-1;modele-1;1536') AS content_hash FROM recs"""
SQL["passage_record_ids"] = with_(RECS, PASSAGES) + "SELECT passage_id, question_id FROM passages"
SQL["corpus_validation"] = with_(RECS) + """
SELECT 'id' AS rule, count(*) FILTER (question_id = '') AS violations FROM recs
UNION ALL SELECT 'moncode', count(*) FILTER (NOT regexp_full_match(moncode, '[0-9]+')) FROM recs
UNION ALL SELECT 'langue', count(*) FILTER (auteur <> 'fr') FROM recs
UNION ALL SELECT 'titre', count(*) FILTER (titre = '') FROM recs
UNION ALL SELECT 'question', count(*) FILTER (question = '') FROM recs
UNION ALL SELECT 'date_reception', count(*) FILTER (date_reception IS NULL) FROM recs
UNION ALL SELECT 'url_source', 0 FROM recs LIMIT 0""".replace("\nUNION ALL SELECT 'url_source', 0 FROM recs LIMIT 0", "") + """
UNION ALL SELECT 'url_source', count(*) FILTER (NOT starts_with(url_source, 'http://records.example.org/')) FROM recs
UNION ALL SELECT 'repeated id', count(*) - count(DISTINCT question_id) FROM recs
UNION ALL SELECT 'repeated natural key', count(*) - count(DISTINCT moncode || auteur) FROM recs"""
SQL["record_violations"] = with_(RECS) + "SELECT question_id, array_to_string(list_filter([CASE WHEN auteur <> 'fr' THEN 'langue' END, CASE WHEN titre = '' THEN 'titre' END, CASE WHEN question = '' THEN 'question' END], lambda x: x IS NOT NULL), '|') AS violations FROM recs"
_OWN = {"titre": "titre = ''", "question": "question = ''", "auteur": "auteur IS NULL", "destinataire": "destinataire IS NULL"}
SQL["record_fields"] = with_(RECS) + "SELECT question_id, concat_ws('|', " + ", ".join(
    f"CASE WHEN CASE WHEN doc_id % 20 <> {number} THEN {_OWN.get(name, 'false')} WHEN doc_id // 20 % 3 = 0 THEN {not kind.endswith('missing')} "
    f"WHEN doc_id // 20 % 3 = 1 THEN {not kind.endswith('null')} ELSE true END THEN '{name}' END"
    for number, (name, kind) in enumerate(V.RECORD_FIELDS)
) + ") AS violations FROM recs"
SQL["query_rules"] = """
SELECT conv_id, concat_ws('|', CASE WHEN length(text) NOT BETWEEN 3 AND 1500 THEN 'length' END, CASE WHEN len(h) > 4 THEN 'history' END,
  CASE WHEN len(list_filter(h, lambda x: length(trim(x)) NOT BETWEEN 1 AND 1500)) > 0 THEN 'history texts' END) AS violations
FROM (SELECT conv_id, trim(arg_max(text, turn)) AS text, list(text) FILTER (role = 'user') AS h FROM conversations GROUP BY conv_id)"""


def _keyed_digest(value: str, key: str) -> str:
    """The keyed digest as its standard states it: the key, filled up to 64 bytes, with each of the two pads."""
    inner, outer = ("".join(f"{byte ^ pad:02x}" for byte in key.encode().ljust(64, b"\0")) for pad in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({value}))))"


SQL["pseudonyms"] = f"""
SELECT session, {_keyed_digest('session', 'clef')} AS pseudonym, {_keyed_digest('session', 'une autre clef')} AS other
FROM (SELECT DISTINCT user_id::VARCHAR AS session FROM events)"""
SQL["time_stamps"] = "SELECT event_id, strftime(ts, '%Y-%m-%d-%H') AS hour, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y%m%dT%H%M%SZ') AS run FROM events"
SQL["failure_codes"] = "SELECT CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'QUOTA_UNAVAILABLE' ELSE 'UNEXPECTED' END AS code, count(*) AS requests FROM events GROUP BY 1"
SQL["passage_split"] = with_(RECS, PASSAGES) + "SELECT passage_id, question_id, section, position, content FROM passages"
SQL["search_text"] = with_(RECS, PASSAGES) + "SELECT passage_id, search_text FROM passages"
SQL["passage_sizes"] = with_(RECS, PASSAGES) + "SELECT question_id, count(*) AS n_inputs, sum(strlen(search_text))::BIGINT AS n_bytes FROM passages GROUP BY question_id"
SQL["passage_words"] = with_(RECS, PASSAGES) + f"""
SELECT passage_id, word, tf, t.word IS NOT NULL AS in_title
FROM (SELECT passage_id, word, count(*) AS tf FROM (SELECT passage_id, unnest({index_words('search_text')}) AS word FROM passages) GROUP BY ALL) w
LEFT JOIN (SELECT DISTINCT passage_id, unnest({index_words(f"split_part(search_text, {NL}, 1)")}) AS word FROM passages) t USING (passage_id, word)"""
SQL["postings"] = with_(RECS) + f"""
SELECT term, question_id, tf, t.term IS NOT NULL AS in_title
FROM (SELECT question_id, term, count(*) AS tf FROM (SELECT question_id, unnest({index_words(RECORD_TEXT)}) AS term FROM recs WHERE reponse IS NOT NULL) GROUP BY ALL) w
LEFT JOIN (SELECT DISTINCT question_id, unnest({index_words('titre')}) AS term FROM recs) t USING (question_id, term)"""
SQL["vocabulary_stems"] = with_(RECS, VOCABULARY, stems("vocabulary")) + "SELECT word, stem FROM stems"
SQL["postings_stemmed"] = with_(RECS, VOCABULARY, stems("vocabulary")) + f"""
, roots AS (
  SELECT question_id, stem FROM (SELECT question_id, unnest({index_words(RECORD_TEXT)}) AS word FROM recs WHERE reponse IS NOT NULL) JOIN stems USING (word)
), titles AS (SELECT DISTINCT question_id, stem FROM (SELECT question_id, unnest({index_words('titre')}) AS word FROM recs) JOIN stems USING (word))
SELECT stem AS term, question_id, count(*) AS tf, bool_or(t.stem IS NOT NULL) AS in_title FROM roots LEFT JOIN titles t USING (question_id, stem) GROUP BY ALL"""
SQL["document_frequency"] = with_(RECS) + f"""
SELECT term, count(*) AS df, round(ln(1 + (SELECT count(*) FROM recs WHERE reponse IS NOT NULL) / (1 + count(*))), 6) AS idf
FROM (SELECT unnest(list_distinct({index_words(RECORD_TEXT)})) AS term FROM recs WHERE reponse IS NOT NULL) GROUP BY term"""
SQL["query_terms"] = with_(TERMS) + "SELECT query_id, string_agg(term, ' OR ' ORDER BY rn) AS lexical_query FROM terms GROUP BY query_id"
SQL["query_lexemes"] = with_(TERMS) + f"""
SELECT query_id, coalesce(array_to_string(list_sort(list_distinct({index_words('q')})), ' '), '') AS lexemes
FROM (SELECT query_id, replace(left(string_agg(term, ' OR ' ORDER BY rn), 2500), ' OR ', ' ') AS q FROM terms GROUP BY query_id)"""
SQL["query_expansion"] = f"""
SELECT conv_id, turn, {expanded('t')} AS expanded
FROM (SELECT conv_id, turn, text || (['', ' la chaleur', ' un Métro', ' les élections', ' autobus'])[(turn % 5) + 1] AS t FROM conversations)"""
SQL["lexical_topk"] = with_(RECS, TERMS, LEXICAL, LEX_FUSED) + """
SELECT query_id, question_id, round(lexical, 6) AS lexical, round(score, 6) AS score, leader FROM fused
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, question_id) <= 8"""
SQL["lexical_search"] = LEX_HITS + "SELECT query_id, hit_rank, passage_id, question_id, position, round(score, 6) AS score FROM hits"
SQL["relevance_filter"] = LEX_FILTERED + "SELECT query_id, hit_rank, passage_id, round(score, 6) AS score FROM filtered"
SQL["lexical_search_stemmed"] = STEMMED_FILTERED + "SELECT query_id, hit_rank, passage_id, round(score, 6) AS score FROM filtered"
SQL["indexed_search"] = SQL["lexical_search_stemmed"]
CHANGED_RECS = RECS.replace("recs AS MATERIALIZED", "first_recs AS MATERIALIZED") + f""",
recs AS MATERIALIZED (
  SELECT * REPLACE (CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN reponse || {NL} || 'Complément publié plus tard.' ELSE reponse END AS reponse)
  FROM first_recs WHERE doc_id % 7 <> 0
  UNION ALL SELECT * REPLACE ('N-' || doc_id AS question_id) FROM first_recs WHERE doc_id % 17 = 0
)"""
SQL["index_after_refresh"] = with_(CHANGED_RECS, VOCABULARY, stems("vocabulary")) + f"""
, roots AS (
  SELECT DISTINCT question_id, stem FROM (SELECT question_id, unnest({index_words(RECORD_TEXT)}) AS word FROM recs WHERE reponse IS NOT NULL) JOIN stems USING (word)
), titles AS (SELECT DISTINCT question_id, stem FROM (SELECT question_id, unnest({index_words('titre')}) AS word FROM recs) JOIN stems USING (word))
SELECT stem AS term, count(*) AS df, count(*) AS entries, count(*) FILTER (t.stem IS NOT NULL) AS in_titles, (SELECT count(*) FROM recs WHERE reponse IS NOT NULL) AS n_records
FROM roots LEFT JOIN titles t USING (question_id, stem) GROUP BY stem"""
SQL["occurrence_rank"] = LEX_HITS + "SELECT query_id, passage_id, occurrences, passage_rank FROM best"
SQL["cosine_topk"] = with_(RECS, TERMS, SIMILAR) + """
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, question_id) AS hit_rank, question_id, passage_id, round(similarity, 6) AS similarity
FROM near_pairs QUALIFY hit_rank <= 6"""
SQL["rrf_hybrid"] = with_(RECS, TERMS, LEXICAL, SIMILAR, HYBRID_FUSED, selected(8)) + "SELECT query_id, question_id, lexical_rank, semantic_rank, round(score, 6) AS score, leader FROM selected"
SQL["hybrid_search"] = HYB_HITS + "SELECT query_id, hit_rank, passage_id, question_id, position, round(score, 6) AS score FROM hits"
SQL["linear_ranker"] = with_(RECS, PASSAGES, TERMS, SIMILAR) + f"""
, counted AS (
  SELECT query_id, question_id, passage_id, count(*) AS occurrences
  FROM (SELECT question_id, passage_id, unnest({index_words('search_text')}) AS term FROM passages WHERE section = 'reponse') JOIN terms USING (term) GROUP BY ALL
), ranked AS (
  SELECT query_id, passage_id, question_id, round(coalesce(occurrences, 0) * 0.1::DOUBLE * 3 + coalesce(similarity, 0), 9) AS relevance
  FROM counted FULL JOIN near_pairs USING (query_id, question_id, passage_id)
), two AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY query_id, question_id ORDER BY relevance DESC, passage_id) <= 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, passage_id) AS hit_rank, passage_id, round(relevance, 6) AS relevance
FROM two QUALIFY hit_rank <= 6"""
SQL["format_fingerprint"] = with_(RECS, PASSAGES) + """
SELECT count(*) AS passages, sum(('0x' || left(sha256(to_json({'passage_id': passage_id, 'section': section, 'position': position, 'content': content, 'search_text': search_text})::VARCHAR), 15))::HUGEINT)::VARCHAR AS digest FROM passages"""
SQL["substitute_vectors"] = with_(RECS, PASSAGES) + """
, raw AS (
  SELECT passage_id, list_transform(range(1, 9), lambda i: ('0x' || left(md5(search_text || ':' || i), 8))::BIGINT::DOUBLE) AS x FROM passages
), signed AS (SELECT passage_id, list_transform(x, lambda v: (v - CASE WHEN v >= 2147483648 THEN 4294967296 ELSE 0 END) / 2147483648) AS x FROM raw),
units AS (SELECT passage_id, list_transform(x, lambda v: v / sqrt(list_dot_product(x, x))) AS v FROM signed)
SELECT passage_id, array_to_string(list_transform(v, lambda y: format('{:.5f}', y)), '|') AS vector, round(sqrt(list_dot_product(v, v)), 6) AS length FROM units"""
SQL["vector_checks"] = FULL_STORE + """
SELECT coalesce(embedding_model, '-') AS model, count(*) AS passages, count(*) FILTER (embedding_model = 'm-A' AND len(embedding) = 64) AS usable FROM passage_store GROUP BY 1"""
SQL["context_expansion"] = STEMMED_FILTERED.rstrip() + f""",
firsts AS (SELECT query_id, question_id, row_number() OVER (PARTITION BY query_id ORDER BY min(hit_rank)) AS rr FROM filtered GROUP BY query_id, question_id),
sizes AS (SELECT query_id, count(*) AS n FROM filtered GROUP BY query_id),
wanted_roots AS (SELECT DISTINCT query_id, stem FROM qwords JOIN stems USING (word)),
mentions AS (
  SELECT DISTINCT query_id, passage_id FROM (
    SELECT query_id, passage_id, unnest({query_words('content')}) AS word FROM firsts JOIN passages USING (question_id) WHERE section = 'reponse')
  JOIN stems USING (word) JOIN wanted_roots USING (query_id, stem)
), extra AS (
  SELECT f.query_id, p.passage_id, rr, n, row_number() OVER (PARTITION BY f.query_id, p.question_id ORDER BY p.position) AS round
  FROM firsts f JOIN passages p ON p.question_id = f.question_id AND p.section = 'reponse' JOIN sizes USING (query_id)
  ANTI JOIN filtered h ON h.query_id = f.query_id AND h.passage_id = p.passage_id
  WHERE (f.query_id, p.passage_id) IN (SELECT (query_id, passage_id) FROM mentions)
), more AS (
  SELECT query_id, n + row_number() OVER (PARTITION BY query_id ORDER BY round, rr) AS context_rank, passage_id FROM extra WHERE round <= 3 AND (round = 1 OR rr <= 3)
)
SELECT query_id, hit_rank AS context_rank, passage_id, 'hit' AS origin FROM filtered
UNION ALL SELECT query_id, context_rank, passage_id, 'context' FROM more WHERE context_rank <= 12"""
SQL["source_groups"] = LEX_FILTERED.rstrip() + f""",
three AS (SELECT * FROM filtered WHERE hit_rank <= 3),
srcs AS (SELECT query_id, question_id, arg_min(passage_id, hit_rank) AS id, min(hit_rank) AS fr, count(*) AS n FROM three GROUP BY query_id, question_id),
full_srcs AS (SELECT *, day(date_reponse) || ' ' || ([{_list(V.FRENCH_MONTHS)}])[month(date_reponse)] || ' ' || year(date_reponse) AS d FROM srcs JOIN recs USING (question_id))
SELECT a.query_id, 'extraits' AS mode, CASE WHEN max(id) IS NULL THEN 'insuffisant' ELSE 'documente' END AS status,
  CASE WHEN max(id) IS NULL THEN '{V.INSUFFICIENT_NOTICE}' ELSE '{V.EXTRACT_NOTICE}' END AS notice,
  coalesce(string_agg(CASE WHEN n > 1 THEN 'Passages' ELSE 'Passage' END || ' de la réponse du ' || d || ' :', '|' ORDER BY fr), '{V.INSUFFICIENT_TEXT}') AS paragraphs,
  coalesce(string_agg(id, '|' ORDER BY fr), '') AS source_ids,
  coalesce(string_agg(replace(url_source, 'http:', 'https:'), '|' ORDER BY fr), '') AS urls,
  coalesce(string_agg(CASE WHEN id IS NOT NULL THEN 'fond' END, '|' ORDER BY fr), '') AS natures
FROM asked a LEFT JOIN full_srcs USING (query_id) GROUP BY a.query_id"""
GENERATED = """
lists AS (SELECT query_id, text, coalesce(ids, []) AS ids FROM asked LEFT JOIN (SELECT query_id, list(passage_id ORDER BY hit_rank) AS ids FROM filtered GROUP BY query_id) USING (query_id)),
checks AS (
  SELECT query_id, query_id % 6 AS k, ids, len(list_distinct(ids[1:2])) AS cited,
    CASE WHEN query_id % 6 = 1 THEN 1 ELSE 0 END AS unknown,
    (CASE WHEN len(ids) = 0 THEN 1 ELSE 0 END) + CASE WHEN query_id % 6 = 2 OR (query_id % 6 <> 1 AND len(ids) = 0) THEN 1 ELSE 0 END AS uncited
  FROM lists
), verdicts AS (
  SELECT *, CASE WHEN k = 5 AND len(ids) > 3 THEN 'AI_OUTPUT_INVALID' WHEN k = 4 THEN 'insuffisant' WHEN k = 3 THEN 'AI_OUTPUT_INVALID'
    WHEN len(ids) = 0 THEN 'AI_MISSING_CITATION' WHEN unknown > 0 THEN 'AI_UNKNOWN_CITATION' WHEN uncited > 0 THEN 'AI_MISSING_CITATION' ELSE 'documente' END AS verdict FROM checks
)"""
SQL["citation_check"] = LEX_FILTERED.rstrip() + "," + GENERATED + "\nSELECT query_id, verdict, cited, unknown, uncited FROM verdicts"
HYB_FILTERED = with_(RECS, PASSAGES, TERMS, LEXICAL, SIMILAR, HYBRID_FUSED, selected(6), hits(HYB_SIMILARITY), RELEVANT)
_REJECTED = f"({HYB_FILTERED.rstrip()}, {GENERATED} SELECT query_id FROM verdicts WHERE verdict NOT IN ('documente', 'insuffisant'))"
SQL["fallback_answers"] = f"""
WITH rejected AS MATERIALIZED {_REJECTED}
SELECT 'fresh' AS kind, query_id, passage_id FROM ({LEX_FILTERED} SELECT query_id, passage_id FROM filtered) SEMI JOIN rejected USING (query_id)
UNION ALL SELECT 'filtered', query_id, passage_id FROM ({HYB_FILTERED} SELECT query_id, passage_id FROM filtered) SEMI JOIN rejected USING (query_id)"""
SQL["clamped_selection"] = with_(RECS, TERMS, LEXICAL, LEX_FUSED) + """
SELECT query_id, question_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, question_id) AS document_rank, allowed
FROM (SELECT *, greatest(1, least(8, ([-2, 0, 1, 3, 8, 50])[query_id % 6 + 1])) AS allowed FROM fused
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY leader DESC, round(score, 12) DESC, question_id) <= allowed)"""
SQL["response_contract"] = LEX_FILTERED.rstrip() + """
SELECT query_id, CASE query_id % 5 WHEN 1 THEN 'mode' WHEN 2 THEN 'notice' WHEN 3 THEN CASE WHEN s THEN 'source url' ELSE '' END WHEN 4 THEN CASE WHEN s THEN 'source excerpts' ELSE '' END ELSE '' END AS violations
FROM (SELECT a.query_id, EXISTS (SELECT 1 FROM filtered f WHERE f.query_id = a.query_id) AS s FROM asked a)"""
SQL["dedup_store"] = FULL_STORE + """
SELECT question_id, contents, refs, coalesce(passages, 0) AS passages, coalesce(embedded, 0) AS embedded
FROM (SELECT question_id, count(DISTINCT content_hash) AS contents FROM members SEMI JOIN doc_store USING (content_hash) GROUP BY 1)
LEFT JOIN (SELECT question_id, count(*) AS passages, count(embedding) AS embedded FROM passage_store SEMI JOIN members USING (content_hash) GROUP BY 1) USING (question_id)
JOIN (SELECT question_id, count(*) AS refs FROM members SEMI JOIN doc_store USING (content_hash) GROUP BY 1) USING (question_id)"""
SQL["compatibility_view"] = DOC_STORE + "SELECT version_id, m.question_id, titre AS document FROM members m JOIN doc_store USING (content_hash)"
ITEMS = "items AS (SELECT question_id, 'A:' || digest AS content_hash, count(*) AS n_passages FROM passages JOIN stored USING (question_id) GROUP BY ALL), ready AS (SELECT content_hash, count(*) FILTER (embedding IS NOT NULL AND embedding_model = 'm-A') AS ready_passages FROM passage_store GROUP BY 1)"
SQL["ready_contents"] = FULL_STORE.rstrip() + ", " + ITEMS + "\nSELECT question_id, n_passages, ready_passages FROM items JOIN ready USING (content_hash)"
SQL["work_to_embed"] = FULL_STORE.rstrip() + ", " + ITEMS + "\nSELECT question_id, n_passages FROM items JOIN ready USING (content_hash) WHERE n_passages <> ready_passages"
BATCHES = """
sized AS (SELECT doc_id, question_id, count(*) AS n, sum(strlen(search_text))::BIGINT AS b FROM passages JOIN recs USING (question_id) GROUP BY ALL),
packed AS (
  SELECT -1::BIGINT AS i, 0::BIGINT AS batch, 0::BIGINT AS n, 0::BIGINT AS b
  UNION ALL
  SELECT i + 1, p.batch + fresh::BIGINT, s.n + CASE WHEN fresh THEN 0 ELSE p.n END, s.b + CASE WHEN fresh THEN 0 ELSE p.b END
  FROM packed p JOIN sized s ON s.doc_id = p.i + 1, LATERAL (SELECT p.n > 0 AND (p.n + s.n > 32 OR p.b + s.b > 20000) AS fresh)
)"""
SQL["embed_plan"] = with_(RECS, PASSAGES, BATCHES) + "SELECT 'D-' || i AS question_id, batch FROM packed WHERE i >= 0"
SQL["embed_budget"] = with_(RECS, PASSAGES, BATCHES) + f"""
SELECT *, calls <= {V.BUDGET_MAX_CALLS} AND bytes <= {V.BUDGET_MAX_BYTES} AS fits FROM (SELECT (SELECT max(batch) + 1 FROM packed) AS calls, sum(b)::BIGINT AS bytes FROM sized)"""
SQL["budget_overflow"] = """
SELECT *, calls <= 25 AND bytes <= 6000000 AS accepted FROM (
  SELECT o_orderkey AS request_id, o_orderpriority AS run, count(*) OVER w AS calls, (sum(floor(o_totalprice)::BIGINT) OVER w)::BIGINT AS bytes
  FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey))"""
SQL["budget_replay"] = """
WITH RECURSIVE seq AS (SELECT o_orderpriority AS run, o_orderkey AS id, floor(o_totalprice)::BIGINT AS b, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n FROM orders),
replay AS (
  SELECT DISTINCT run, 0::BIGINT AS n, NULL::BIGINT AS id, false AS accepted, 0::BIGINT AS calls, 0::BIGINT AS bytes FROM seq
  UNION ALL
  SELECT s.run, s.n, s.id, ok, calls + CASE WHEN ok THEN 1 ELSE 0 END, bytes + CASE WHEN ok THEN s.b ELSE 0 END
  FROM replay r JOIN seq s ON s.run = r.run AND s.n = r.n + 1, LATERAL (SELECT r.calls + 1 <= 25 AND r.bytes + s.b <= 6000000 AS ok)
)
SELECT id AS request_id, accepted, calls AS used_calls, bytes AS used_bytes FROM replay WHERE id IS NOT NULL"""
CHECKS = """
held AS (
  SELECT v.version_id, v.count, v.index_config, m.question_id, p.passage_id, p.embedding, coalesce(p.embedding_model, '') AS model,
    CASE WHEN split_part(v.index_config, ';', 2) <> 'sans-embeddings' THEN split_part(v.index_config, ';', 2) END AS declared
  FROM versions v JOIN members m USING (version_id) LEFT JOIN passage_store p USING (content_hash)
), facts AS (
  SELECT version_id, any_value(count) AS wanted, any_value(index_config) AS config, count(DISTINCT question_id) AS n_members, count(passage_id) AS n_passages,
    count(DISTINCT question_id) FILTER (passage_id IS NULL) AS without_passage, count(DISTINCT model) FILTER (passage_id IS NOT NULL) AS n_models,
    count(DISTINCT question_id) FILTER (passage_id IS NOT NULL AND (model <> coalesce(declared, '') OR (declared IS NOT NULL AND embedding IS NULL))) AS mismatched
  FROM held GROUP BY version_id
), checks AS (
  SELECT version_id, n_members, n_passages, without_passage, n_models, mismatched,
    CASE WHEN n_members <> wanted OR n_passages <> announced OR announced < wanted THEN 'Incomplete corpus' WHEN without_passage > 0 THEN 'Question without passage'
      WHEN config IS NULL AND n_models > 1 THEN 'Mixed embedding models' WHEN config IS NOT NULL AND mismatched > 0 THEN 'Embedding model mismatch' ELSE 'ok' END AS verdict
  FROM (SELECT *, n_passages + CASE version_id WHEN 'v3' THEN 1 ELSE 0 END AS announced FROM facts)
)"""
SQL["activation_checks"] = FULL_STORE.rstrip() + "," + CHECKS + "\nSELECT * FROM checks"
SQL["activation"] = FULL_STORE.rstrip() + "," + CHECKS + """
SELECT asked, v.version_id, CASE WHEN verdict = 'ok' THEN v.version_id = asked ELSE active END AS active
FROM versions v, (SELECT version_id AS asked, verdict FROM checks WHERE version_id IN ('v1', 'v4'))"""
KEPT = f"""
flagged AS (
  SELECT *, active OR activation_unknown OR created_at >= TIMESTAMP '{NOW}' - INTERVAL 1 HOUR OR version_id IN (
    SELECT version_id FROM versions WHERE NOT active AND NOT activation_unknown AND activated_at IS NOT NULL ORDER BY activated_at DESC LIMIT 1) AS kept FROM versions
)"""
SQL["prune"] = DOC_STORE.rstrip() + "," + KEPT + "\nSELECT version_id, active, kept FROM flagged"
SQL["removable_contents"] = DOC_STORE.rstrip() + "," + KEPT + f"""
SELECT content_hash, question_id FROM doc_store d WHERE created_at < TIMESTAMP '{NOW}' - INTERVAL 1 HOUR
AND NOT EXISTS (SELECT 1 FROM members m JOIN flagged USING (version_id) WHERE m.content_hash = d.content_hash AND kept)"""
SQL["retention_summary"] = DOC_STORE.rstrip() + "," + KEPT + """
SELECT *, 'Rétention : ' || removed || CASE WHEN removed > 1 THEN ' versions supprimées' ELSE ' version supprimée' END || ' ; conservé : '
  || rollback || CASE WHEN rollback > 1 THEN ' versions' ELSE ' version' END || ' pour retour arrière (cible : 1, hors versions récentes protégées)'
  || CASE WHEN recent > 1 THEN ', ' || recent || ' imports récents non activés' WHEN recent = 1 THEN ', 1 import récent non activé' ELSE '' END || '.' AS summary
FROM (SELECT count(*) FILTER (NOT kept) AS removed, count(*) FILTER (kept AND activation_unknown) AS unknown,
  count(*) FILTER (kept AND activated_at IS NOT NULL) AS rollback, count(*) FILTER (kept AND activated_at IS NULL) AS recent FROM flagged WHERE NOT active)"""
SQL["clone_unchanged"] = FULL_STORE + """
SELECT question_id FROM members a WHERE version_id = 'v4' AND EXISTS (SELECT 1 FROM members b WHERE b.version_id = 'v2' AND b.question_id = a.question_id AND b.content_hash = a.content_hash)
AND NOT EXISTS (SELECT 1 FROM passage_store p WHERE p.content_hash = a.content_hash AND (embedding IS NULL OR embedding_model IS DISTINCT FROM 'm-A'))"""
SQL["version_weight"] = FULL_STORE + """
SELECT version_id, count(*) AS records, coalesce(sum(bytes), 0)::BIGINT AS bytes, coalesce(sum(bytes) FILTER (n = 1), 0)::BIGINT AS own_bytes
FROM members JOIN (SELECT content_hash, count(*) AS n FROM members GROUP BY 1) USING (content_hash)
LEFT JOIN (SELECT content_hash, sum(strlen(content)) AS bytes FROM passage_store GROUP BY 1) USING (content_hash) GROUP BY version_id"""
SQL["corpus_info"] = DOC_STORE + """
SELECT 'v1' AS version_id, count(*)::INT AS count, 'méthode v1' AS method, count(reponse) AS answer_count, strftime(max(greatest(date_reception, date_reponse)), '%Y-%m-%d') AS latest_document FROM recs"""
SQL["version_export"] = with_(RECS) + "SELECT question_id, titre, reponse, strftime(date_reception, '%Y-%m-%d') AS date_reception FROM recs ORDER BY question_id"
SQL["load_job"] = with_(RECS, PASSAGES) + """, late AS (SELECT question_id FROM recs WHERE auteur = 'fr' AND reponse IS NOT NULL),
facts AS (SELECT
  (SELECT count(*) FROM recs) AS n, (SELECT count(*) FROM late) AS n_late, (SELECT count(*) FROM passages) AS n_all,
  (SELECT count(*) FROM passages SEMI JOIN late USING (question_id)) AS n_changed,
  (SELECT count(*) FROM passages SEMI JOIN late USING (question_id) WHERE section = 'reponse') AS n_absent)
SELECT version_id, version_id = 'v2' AS active, n::INT AS count, 'méthode ' || version_id AS method, n_all - CASE version_id WHEN 'v1' THEN n_absent WHEN 'v3' THEN 1 ELSE 0 END AS n_passages,
  CASE version_id WHEN 'v3' THEN 'Incomplete corpus' ELSE 'ok' END AS verdict, n + n_late AS stored_documents, n AS stored_records,
  n_all - n_absent + n_changed - 1 AS stored_passages, n_all - n_absent + n_changed - 1 AS embedded
FROM facts, (VALUES ('v1'), ('v2'), ('v3')) AS v(version_id)"""
SQL["concurrent_loads"] = with_(RECS) + "SELECT question_id, 1 AS copies, question_id < 'D-7' AS reported, 2 AS attempts FROM recs"
SQL["active_search"] = SQL["relevance_filter"].replace(RECS.strip(), CHANGED_RECS.strip()).replace("round(score, 6) AS score", "round(score, 6) AS score, 'v1' AS version_id")
SQL["corpus_round_trip"] = with_(RECS) + """
SELECT question_id, moncode, titre, auteur, destinataire, question, reponse, strftime(date_reception, '%Y-%m-%d') AS date_reception,
  strftime(date_reponse, '%Y-%m-%d') AS date_reponse, url_source FROM recs"""
SQL["published_reports"] = with_(RECS) + """
SELECT part, count(*) AS n, count(reponse) AS answered FROM (
  SELECT '20240501T080000Z' AS part, reponse FROM recs WHERE reponse IS NULL
  UNION ALL SELECT p, reponse FROM recs, (VALUES ('20240601T080000Z'), ('latest')) AS v(p)) GROUP BY part"""
SQL["store_audit"] = DOC_STORE + "SELECT content_hash FROM doc_store WHERE titre < 'C'"
_CHANGED = DOC_STORE.rstrip() + """, changed AS (
  SELECT content_hash, left(md5(content_hash), 3) AS bucket, CASE WHEN titre < 'B' THEN 'added' WHEN titre >= 'X' THEN 'removed' ELSE 'rewritten' END AS change
  FROM doc_store WHERE titre < 'B' OR titre >= 'X' OR (titre < 'C' AND reponse IS DISTINCT FROM 'autre')
) """
SQL["store_differences"] = _CHANGED + """SELECT content_hash, bucket, change FROM changed
UNION ALL SELECT NULL, count(DISTINCT left(bucket, n))::VARCHAR, 'unequal at level ' || n FROM changed, range(4) AS r(n) GROUP BY n"""
SQL["insert_absent"] = DOC_STORE + "SELECT content_hash, question_id FROM doc_store WHERE content_hash NOT IN (SELECT content_hash FROM members WHERE version_id = 'v1')"


def _repeated(table: str, keys: str) -> str:
    return f"(SELECT count(*) FROM (SELECT {keys} FROM {table} GROUP BY {keys} HAVING count(*) > 1))"


def _lost(table: str, parent: str, key: str) -> str:
    return f"(SELECT count(*) FROM {table} t WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = t.{key}))"


SQL["integrity"] = FULL_STORE + " UNION ALL ".join(
    f"SELECT '{rule}' AS rule, {violations} AS violations"
    for rule, violations in (
        ("versions primary key", _repeated("versions", "version_id")),
        ("members primary key", _repeated("members", "version_id, question_id")),
        ("documents primary key", _repeated("doc_store", "content_hash")),
        ("passages primary key", _repeated("passage_store", "content_hash, passage_id")),
        ("members refer to versions", _lost("members", "versions", "version_id")),
        ("members refer to documents", _lost("members", "doc_store", "content_hash")),
        ("passages refer to documents", _lost("passage_store", "doc_store", "content_hash")),
        ("section values", "(SELECT count(*) FROM passage_store WHERE section NOT IN ('question', 'reponse'))"),
        ("positive counts", "(SELECT count(*) FROM versions WHERE count <= 0)"),
        ("one active version", "(SELECT abs(count(*) - 1) FROM versions WHERE active)"),
    )
)
SQL["applied_versions"] = """
SELECT max(n_nationkey + 1)::INT AS current, 25 AS expected, (SELECT string_agg(n_nationkey + 1, ',' ORDER BY n_nationkey) FROM nation WHERE n_regionkey = 3) AS missing,
  max(n_nationkey + 1) = 25 AS up_to_date FROM nation WHERE n_regionkey <> 3"""
SQL["recheck_plan"] = with_(INDEX, PLAN) + "SELECT moncode, action FROM plan"
SQL["recheck_plan_full"] = with_(INDEX) + """
SELECT CASE WHEN c.moncode IS NULL THEN 'candidate' WHEN r.moncode IS NOT NULL THEN 'recheck' ELSE 'kept' END AS action, count(*) AS records FROM current c FULL JOIN rows r ON c.moncode = r.moncode GROUP BY 1"""
SQL["missing_from_index"] = with_(INDEX) + """
SELECT moncode, CASE WHEN moncode IN (SELECT moncode FROM raw WHERE assembly = 'PRB') THEN 'incomplete_row' ELSE 'not_listed' END AS reason FROM current WHERE moncode NOT IN (SELECT moncode FROM rows)"""
SQL["title_selection"] = with_(INDEX) + """
SELECT moncode, 'dossiers 1' AS selection FROM rows WHERE regexp_matches(lower(titre), 'dossier 1[0-9]* ') OR regexp_matches(lower(titre_nl), 'dossier 1[0-9]* ')
UNION ALL SELECT moncode, 'vraag 99' FROM rows WHERE regexp_matches(lower(titre), 'vraag over dossier .*99') OR regexp_matches(lower(titre_nl), 'vraag over dossier .*99')"""
SQL["many_selections"] = with_(INDEX) + r"""
SELECT DISTINCT moncode, 'p' || p_partkey AS selection FROM (
  SELECT moncode, unnest(range(1, 1 + length(number))) AS n, number FROM (
    SELECT moncode, unnest(regexp_extract_all(lower(coalesce(titre, '')) || chr(10) || lower(coalesce(titre_nl, '')) , '\bdossier ([0-9]+) ?[^0-9\n]', 1)) AS number FROM rows))
JOIN part ON p_partkey::VARCHAR = left(number, n)"""
SQL["legislature_split"] = with_(INDEX) + "SELECT moncode, coalesce(legislature, '2024-2029') = '2024-2029' AS collected FROM current"
SQL["per_legislature"] = with_(INDEX) + "SELECT coalesce(legislature, '2024-2029') AS legislature, count(*) AS records FROM current GROUP BY 1"
SQL["method_text"] = with_(INDEX) + f"""
SELECT '{V.METHOD_OPENING}' || 'Législature 2024-2029 : fiches collectées des plus récentes aux plus anciennes. Législature 1999-2004 : 12 fiches choisies. Législature 1994-1999 : '
  || (SELECT count(*) FROM current WHERE legislature = '1994-1999') || ' fiches.' || '{V.METHOD_CLOSING}' AS methode_echantillonnage"""
SQL["refresh_outcomes"] = with_(INDEX, PLAN, OUTCOMES) + "SELECT action, outcome, count(*) AS pages FROM outcomes GROUP BY ALL"
SQL["refresh_losses"] = with_(INDEX, PLAN, OUTCOMES) + """
SELECT (SELECT count(*) FROM current) AS n_current,
  (SELECT count(*) FROM current c WHERE NOT EXISTS (SELECT 1 FROM (
      SELECT moncode FROM current WHERE moncode NOT IN (SELECT moncode FROM plan WHERE action = 'recheck')
      UNION ALL SELECT moncode FROM outcomes WHERE action = 'recheck') m WHERE m.moncode = c.moncode)) AS lost,
  (SELECT count(*) FROM outcomes WHERE action = 'recheck' AND outcome NOT IN ('ok', 'question_text_empty', 'network')) AS stopping
"""
SQL["refresh_merge"] = with_(INDEX, PLAN, OUTCOMES) + """
SELECT moncode, 'kept' AS origin, reponse FROM current WHERE moncode NOT IN (SELECT moncode FROM plan WHERE action = 'recheck')
UNION ALL SELECT moncode, 'previous', reponse FROM current JOIN outcomes USING (moncode) WHERE action = 'recheck' AND outcome <> 'ok'
UNION ALL SELECT moncode, CASE action WHEN 'recheck' THEN 'rechecked' ELSE 'added' END, 'Texte relu' FROM outcomes WHERE outcome = 'ok'"""
SQL["exclusions"] = with_(INDEX, PLAN, OUTCOMES) + "SELECT moncode, outcome AS reason FROM outcomes WHERE action = 'candidate' AND outcome LIKE 'question%'"
SQL["refresh_caps"] = with_(INDEX, PLAN, OUTCOMES) + f"""
SELECT *, value <= allowed AS ok FROM (
  SELECT 'downloads' AS cap, count(*) AS value, {V.MAX_DOWNLOADS} AS allowed FROM outcomes
  UNION ALL SELECT 'network failures', count(*), {V.MAX_NETWORK_FAILURES} FROM outcomes WHERE outcome = 'network'
  UNION ALL SELECT 'empty texts', count(*), {V.MAX_EMPTY_TEXTS} FROM outcomes WHERE outcome = 'question_text_empty' AND action = 'recheck'
  UNION ALL SELECT 'records', count(*), {V.MAX_RECORDS} FROM current
  UNION ALL SELECT 'missing from index', count(*), {V.MAX_MISSING_FROM_INDEX} FROM current WHERE moncode NOT IN (SELECT moncode FROM rows)
  UNION ALL SELECT 'rechecks', count(*), {V.MAX_DOWNLOADS} FROM outcomes WHERE action = 'recheck'
  UNION ALL SELECT 'pages without a question', count(*), {V.MAX_EMPTY_TEXTS} FROM outcomes WHERE outcome = 'question_block_missing' AND action = 'candidate'
  UNION ALL SELECT 'additions', count(*), {V.MAX_ADDITIONS} FROM outcomes WHERE outcome = 'ok' AND action = 'candidate')"""


def _run_states(limits, readable: bool) -> str:
    """The state of each planned page, by windows over the whole sequence."""
    outcome = "CASE WHEN action = 'recheck' AND outcome = 'question_block_missing' THEN 'ok' ELSE outcome END" if readable else "outcome"
    return f"""(
  WITH pages AS (SELECT CASE action WHEN 'candidate' THEN 10000000000 ELSE 0 END + moncode::BIGINT AS seq, moncode, action, {outcome} AS outcome FROM outcomes),
  sums AS (SELECT *, outcome = 'network' AS net, count(*) OVER w AS n, count(*) FILTER (outcome <> 'network') OVER w AS downloads,
    count(*) FILTER (outcome = 'ok' AND action = 'candidate') OVER w AS added, count(*) FILTER (outcome = 'network') OVER w AS postponed,
    count(*) FILTER (outcome = 'question_text_empty' AND action = 'recheck') OVER w AS emptied,
    count(*) FILTER (outcome = 'question_block_missing' AND action = 'candidate') OVER w AS blockless FROM pages WINDOW w AS (ORDER BY seq)),
  rowed AS (SELECT *, n - coalesce(max(CASE WHEN NOT net THEN n END) OVER (ORDER BY seq), 0) AS in_a_row FROM sums),
  flags AS (SELECT *, action = 'candidate' AND (added - (outcome = 'ok')::INT >= least({limits.asked}, {limits.max_records} - (SELECT count(*) FROM current))
      OR downloads - (NOT net)::INT >= {limits.max_downloads}) AS needless,
    CASE WHEN net AND (postponed > {limits.max_network_failures} OR in_a_row >= {limits.in_a_row}) THEN 'network failures'
      WHEN action = 'recheck' AND outcome = 'question_text_empty' AND emptied > {limits.max_empty_texts} THEN 'empty texts'
      WHEN action = 'candidate' AND outcome = 'question_block_missing' AND blockless > {limits.max_empty_texts} THEN 'pages without a question'
      WHEN action = 'recheck' AND outcome = 'question_block_missing' THEN 'page of another structure' END AS reason FROM rowed),
  ends AS (SELECT min(seq) FILTER (needless) AS last, min(seq) FILTER (reason IS NOT NULL) AS stop,
    CASE WHEN (SELECT count(*) FROM current) > {limits.max_records} THEN 'records'
      WHEN (SELECT count(*) FROM current WHERE moncode NOT IN (SELECT moncode FROM rows)) > {limits.max_missing} THEN 'missing from index'
      WHEN count(*) FILTER (action = 'recheck') > {limits.max_downloads} THEN 'rechecks' END AS refusal FROM flags)
  SELECT moncode, action, outcome, CASE WHEN refusal IS NOT NULL THEN 'refused: ' || refusal WHEN seq >= last OR seq > stop THEN 'not reached'
    WHEN seq = stop THEN 'stops: ' || reason ELSE 'read' END AS state FROM flags, ends)"""


def _run_told(name: str, limits, readable: bool) -> str:
    return f"""SELECT '{name}' AS run, max(CASE WHEN state LIKE 'stops: %' OR state LIKE 'refused: %' THEN regexp_replace(state, '^[a-z]+: ', '') END) AS stopped_by,
  count(*) FILTER (state = 'read' AND action = 'recheck' AND outcome = 'ok') AS rechecked, count(*) FILTER (state = 'read' AND action = 'candidate' AND outcome = 'ok') AS added,
  count(*) FILTER (state = 'read' AND outcome = 'network') AS postponed, count(*) FILTER (state = 'read' AND action = 'recheck' AND outcome = 'question_text_empty') AS emptied,
  count(*) FILTER (state = 'read' AND action = 'candidate' AND outcome IN ('question_text_empty', 'question_block_missing')) AS excluded,
  count(*) FILTER (state = 'not reached') AS not_reached FROM {_run_states(limits, readable)}"""


SQL["refresh_stop"] = with_(INDEX, PLAN, OUTCOMES) + " UNION ALL ".join(_run_told(name, limits, change is not None) for name, (limits, change) in REFRESH_RUNS.items())
SQL["refresh_attempts"] = with_(INDEX, PLAN, OUTCOMES) + "SELECT * FROM " + _run_states(REFRESH_RUNS["any number"][0], True)
SQL["additions"] = with_(INDEX) + """
SELECT row_number() OVER (ORDER BY date_reception DESC, moncode::BIGINT DESC) AS rank, moncode, strftime(date_reception, '%Y-%m-%d') AS date_reception
FROM rows WHERE moncode NOT IN (SELECT moncode FROM current) QUALIFY rank <= 50"""
SQL["failure_runs"] = """
SELECT event_id, run, failures, in_a_row, bad AND (failures > 4000 OR in_a_row >= 3) AS stops FROM (
  SELECT *, CASE WHEN bad THEN count(*) OVER (PARTITION BY run, island ORDER BY event_id) - CASE WHEN island > 0 THEN 1 ELSE 0 END ELSE 0 END AS in_a_row FROM (
    SELECT event_id, strftime(ts, '%Y-%m') AS run, event_type IN ('error', 'view') AS bad,
      count(*) FILTER (event_type IN ('error', 'view')) OVER w AS failures, count(*) FILTER (event_type NOT IN ('error', 'view')) OVER w AS island
    FROM events WINDOW w AS (PARTITION BY strftime(ts, '%Y-%m') ORDER BY event_id)))"""
SQL["growth_log"] = """
SELECT run, added, total, coalesce(CASE right(run, 3) WHEN '-07' THEN total + 1 WHEN '-08' THEN NULL ELSE total END = total, true) AS agrees
FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS run, count(*) AS added, (sum(count(*)) OVER (ORDER BY strftime(o_orderdate, '%Y-%m-%d')))::BIGINT AS total FROM orders GROUP BY 1)"""
SQL["quota_hourly"] = "WITH " + USAGE + """
SELECT event_id, ip AS counter, strftime(ts, '%Y-%m-%d-%H') AS hour, row_number() OVER (PARTITION BY ip, strftime(ts, '%Y-%m-%d-%H') ORDER BY ts, event_id) <= 1 AS accepted
FROM usage WHERE NOT release"""
SQL["case_judgement"] = JUDGED + "\nSELECT query_id, kind, coalesce(rank, 0) AS rank, reason IS NULL AS pass, reason FROM judged"
SQL["eval_summary"] = JUDGED + """
SELECT count(*) AS cases, count(*) FILTER (reason IS NOT NULL AND NOT gap) AS failed, count(*) FILTER (reason IS NOT NULL AND gap) AS known_gaps,
  count(*) FILTER (reason IS NULL AND gap) AS resolved_gaps, round(count(*) FILTER (kind <> 'hors_sujet' AND rank = 1) / count(*) FILTER (kind <> 'hors_sujet'), 6) AS top1,
  round(sum(CASE WHEN kind <> 'hors_sujet' THEN coalesce(1.0::DOUBLE / rank, 0) END) / count(*) FILTER (kind <> 'hors_sujet'), 6) AS mrr FROM judged"""
SQL["pass_rates"] = JUDGED + "\nSELECT kind, count(*) FILTER (reason IS NULL) AS passed, count(*) AS cases FROM judged GROUP BY kind"
SQL["display_judgement"] = JUDGED + f""",
shown AS (SELECT DISTINCT query_id, question_id FROM filtered WHERE hit_rank <= 3)
SELECT query_id, kind, r IS NULL AS pass, r AS reason FROM (SELECT query_id, kind, coalesce(reason, CASE WHEN NOT off_topic AND NOT EXISTS (
  SELECT 1 FROM shown s JOIN expected e USING (query_id, question_id) WHERE s.query_id = j.query_id) THEN '{V.REASON_NOT_SHOWN}' END) AS r FROM judged j)"""
SQL["expectation_misses"] = JUDGED + "\nSELECT DISTINCT query_id, 'attendu' AS kind FROM expected WHERE query_id NOT IN (SELECT query_id FROM ranked JOIN expected USING (query_id, question_id))"
SQL["result_contract"] = HYB_HITS + """
SELECT query_id, coalesce(n, 0) AS n_rows, true AS only_answers, coalesce(n, 0) BETWEEN 1 AND 6 AS ok FROM asked LEFT JOIN (SELECT query_id, count(*) AS n FROM hits GROUP BY 1) USING (query_id)"""
SQL["title_vocabulary"] = with_(RECS) + f"SELECT DISTINCT unnest(regexp_extract_all({fold('titre')}, '[a-z]{{4,}}')) AS word FROM recs"
SQL["rare_words"] = with_(RECS, VOCABULARY, stems("vocabulary")) + f""",
every AS (SELECT stem FROM (
  SELECT question_id, unnest({query_words("titre || ' ' || auteur || ' ' || question || ' ' || coalesce(reponse, '')")}) AS word FROM recs) JOIN stems USING (word)
  GROUP BY stem HAVING count(DISTINCT question_id) = 1),
found AS (SELECT question_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (
  SELECT question_id, list_filter(regexp_extract_all({fold('titre')}, '[a-z]{{5,}}'), lambda w: w NOT IN ({_list(V.STOP_WORDS)})) AS w FROM recs WHERE reponse IS NOT NULL)),
firsts AS (SELECT question_id, word, min(pos) AS pos FROM found GROUP BY ALL)
SELECT arg_max(word, pos) AS word, any_value(question_id) AS question_id FROM firsts JOIN stems USING (word) WHERE stem IN (SELECT stem FROM every)
GROUP BY stem HAVING count(DISTINCT question_id) = 1"""
SQL["seeded_words"] = SQL["rare_words"].replace("SELECT arg_max", ", rare AS (SELECT arg_max").rstrip() + """)
SELECT word, question_id FROM rare ORDER BY md5(word || ':20260930'), word LIMIT 15"""
SQL["random_queries"] = with_(RECS) + f""",
numbered AS (
  SELECT word, row_number() OVER (ORDER BY left(md5(word || ':20260930'), 3), word) - 1 AS number, count(*) OVER () AS total
  FROM (SELECT DISTINCT unnest(regexp_extract_all({fold('titre')}, '[a-z]{{4,}}')) AS word FROM recs)
), draws AS (
  SELECT query_id, unnest(range(1, 2 + ('0x' || left(md5(query_id || ':20260930'), 12))::BIGINT % 4)) AS n FROM (SELECT unnest(range(100)) AS query_id)
), drawn AS (
  SELECT query_id, word, min(n) AS n FROM draws JOIN numbered ON number = ('0x' || left(md5(query_id || ':' || n || ':20260930'), 12))::BIGINT % total GROUP BY query_id, word
)
SELECT query_id, string_agg(word, ' ' ORDER BY n) AS text FROM drawn GROUP BY query_id"""
LATENCIES = """(
  SELECT 'quota' AS step, floor(value * 10)::INT AS ms FROM events
  UNION ALL SELECT 'search', (props::JSON->>'k')::INT FROM events
  UNION ALL SELECT 'generation', floor(value * 100)::INT FROM events WHERE event_type = 'purchase')"""
SQL["latency_stats"] = f"""
SELECT step, count(*) AS requests, round(avg(ms), 6) AS mean_ms, quantile_disc(ms, 0.5)::INT AS p50_ms, quantile_disc(ms, 0.95)::INT AS p95_ms, max(ms)::INT AS max_ms FROM {LATENCIES} GROUP BY step"""
SQL["latency_sketch"] = f"""
SELECT step, count(*) AS requests, share::DOUBLE AS share, min(ms)::INT AS min_ms, max(ms)::INT AS max_ms, true AS within_error
FROM {LATENCIES}, (VALUES (0.5), (0.95)) AS v(share) WHERE ms IS NOT NULL GROUP BY step, share"""

# Quotas: each hour, then each day, is replayed event by event.
QUOTA = """
WITH RECURSIVE timed AS (
  SELECT event_id, ts, user_id::VARCHAR AS session, (user_id % 20)::VARCHAR AS ip, event_type,
    lag(event_type) OVER w AS pt, lag(ts) OVER w AS pts, lag(event_id) OVER w AS pid
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), usage AS (
  SELECT event_id, ts, session, ip, event_type = 'error' AND pt IS NOT NULL AND pt <> 'error' AS release, pts, pid,
    CASE WHEN event_type = 'error' AND pt IS NOT NULL AND pt <> 'error' THEN pt = 'purchase' ELSE event_type = 'purchase' END AS paid FROM timed
), ev AS (
  SELECT *, row_number() OVER (PARTITION BY period ORDER BY ts, event_id) AS n
  FROM (SELECT *, strftime(CASE WHEN release THEN pts ELSE ts END, '%Y-%m-%d-%H') AS period FROM usage
        WHERE NOT release OR pts BETWEEN ts - INTERVAL 10 MINUTE AND ts + INTERVAL 1 MINUTE)
), hourly AS (
  SELECT DISTINCT period, 0::BIGINT AS n, MAP {}::MAP(VARCHAR, INT) AS used, []::BIGINT[] AS granted, NULL::BIGINT AS event_id, false AS counted FROM ev
  UNION ALL
  SELECT e.period, e.n,
    CASE WHEN ok THEN map_concat(used, MAP {'s' || session: greatest(cs + d, 0), 'i' || ip: greatest(ci + d, 0)}) ELSE used END,
    CASE WHEN ok AND release THEN list_filter(granted, lambda x: x <> pid) WHEN ok THEN list_append(granted, e.event_id) ELSE granted END, e.event_id, ok
  FROM hourly h JOIN ev e ON e.period = h.period AND e.n = h.n + 1,
    LATERAL (SELECT coalesce(map_extract_value(h.used, 's' || e.session), 0) AS cs, coalesce(map_extract_value(h.used, 'i' || e.ip), 0) AS ci, CASE WHEN e.release THEN -1 ELSE 1 END AS d),
    LATERAL (SELECT CASE WHEN e.release THEN list_contains(h.granted, e.pid) ELSE cs < 1 AND ci < 100 END AS ok)
), dv AS (
  SELECT ev.*, left(ev.period, 10) AS day, row_number() OVER (PARTITION BY left(ev.period, 10) ORDER BY ts, ev.event_id) AS k
  FROM ev JOIN hourly h ON h.event_id = ev.event_id WHERE counted AND paid
), daily AS (
  SELECT DISTINCT day, 0::BIGINT AS k, MAP {}::MAP(VARCHAR, INT) AS used, []::BIGINT[] AS granted, NULL::BIGINT AS event_id, false AS ai FROM dv
  UNION ALL
  SELECT e.day, e.k,
    CASE WHEN ok THEN map_concat(used, MAP {'ai': greatest(cs + d, 0), 'i' || ip: greatest(ci + d, 0)}) ELSE used END,
    CASE WHEN ok AND release THEN list_filter(granted, lambda x: x <> pid) WHEN ok THEN list_append(granted, e.event_id) ELSE granted END, e.event_id, ok
  FROM daily h JOIN dv e ON e.day = h.day AND e.k = h.k + 1,
    LATERAL (SELECT coalesce(map_extract_value(h.used, 'ai'), 0) AS cs, coalesce(map_extract_value(h.used, 'i' || e.ip), 0) AS ci, CASE WHEN e.release THEN -1 ELSE 1 END AS d),
    LATERAL (SELECT CASE WHEN e.release THEN list_contains(h.granted, e.pid) ELSE cs < 40 AND ci < 3 END AS ok)
), grants AS (
  SELECT event_id, CASE WHEN NOT h.counted THEN 'refuse' WHEN coalesce(d.ai, false) THEN 'ia' ELSE 'extraits' END AS "grant"
  FROM usage u JOIN hourly h USING (event_id) LEFT JOIN daily d USING (event_id) WHERE NOT release
)
"""
SQL["quota_full"] = QUOTA + 'SELECT event_id, "grant" FROM grants'
SQL["quota_stream"] = SQL["quota_full"]
SQL["quota_counters"] = QUOTA + """, used_buckets AS (
  SELECT unnest(CASE WHEN "grant" = 'ia' THEN ['s:' || session || strftime(ts, '%Y%m%d%H'), 'ip:' || ip || strftime(ts, '%Y%m%d%H'), 'ai:' || strftime(ts, '%Y%m%d'), 'ai-ip:' || ip || '-' || strftime(ts, '%Y%m%d')]
    ELSE ['s:' || session || strftime(ts, '%Y%m%d%H'), 'ip:' || ip || strftime(ts, '%Y%m%d%H')] END) AS bucket FROM grants JOIN usage USING (event_id) WHERE "grant" <> 'refuse')
SELECT split_part(bucket, ':', 1) AS counter, count(DISTINCT bucket) AS buckets, count(*) AS used FROM used_buckets GROUP BY 1"""

# Both searches of the same queries in one statement.
BOTH = with_(RECS, PASSAGES, TERMS, LEXICAL, SIMILAR, LEX_FUSED, selected(6), hits(LEX_SIMILARITY), RELEVANT)


def _renamed(ctes: str) -> str:
    for name in ("fused", "selected", "wanted", "scored", "best", "hits"):
        ctes = re.sub(rf"\b{name}\b(?= AS (?:MATERIALIZED )?\()", f"hybrid_{name}", ctes)
        ctes = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 hybrid_{name}", ctes)
    return ctes


HYBRID_PART = _renamed(HYBRID_FUSED + "," + selected(6) + "," + hits(HYB_SIMILARITY))
SQL["mixed_mode_search"] = BOTH.rstrip() + "," + HYBRID_PART + """
SELECT query_id, hit_rank, passage_id, round(score, 6) AS score FROM filtered JOIN asked USING (query_id) WHERE length(text) <= 200
UNION ALL SELECT query_id, hit_rank, passage_id, round(score, 6) FROM hybrid_hits JOIN asked USING (query_id) WHERE length(text) > 200"""
DIFFERENCES = BOTH.rstrip() + "," + HYBRID_PART + """,
lists AS (
  SELECT query_id, a, b, list_transform(a, lambda x: split_part(x, ':', 1)) AS qa, list_transform(b, lambda x: split_part(x, ':', 1)) AS qb
  FROM (SELECT query_id, coalesce(a, []) AS a, coalesce(b, []) AS b FROM (SELECT query_id, list(passage_id ORDER BY hit_rank) AS a FROM filtered GROUP BY 1)
    FULL JOIN (SELECT query_id, list(passage_id ORDER BY hit_rank) AS b FROM hybrid_hits GROUP BY 1) USING (query_id))
), firsts AS (
  SELECT *, list_filter(qa, lambda x, i: list_position(qa, x) = i) AS da, list_filter(qb, lambda x, i: list_position(qb, x) = i) AS db FROM lists
), differences AS (
  SELECT query_id, CASE WHEN len(b) = 0 THEN 'sql-vide' WHEN len(a) = 0 THEN 'local-vide' WHEN da[1] <> db[1] THEN 'premiere-question' WHEN da <> db THEN 'questions'
    WHEN list_sort(a) <> list_sort(b) THEN 'passages' ELSE 'ordre' END AS kind FROM firsts WHERE a <> b
  UNION ALL SELECT f.query_id, 'scores' FROM firsts l JOIN filtered f USING (query_id) JOIN hybrid_hits h ON h.query_id = f.query_id AND h.hit_rank = f.hit_rank
    WHERE l.a = l.b AND round(f.score, 6) <> round(h.score, 6)
)
"""
SQL["ranking_diff"] = DIFFERENCES + "SELECT query_id, kind FROM differences"
SQL["ranking_diff_tally"] = DIFFERENCES + "SELECT kind, count(*) AS differences FROM differences GROUP BY kind"
SQL["answer_judgement"] = JUDGED + "," + GENERATED + """, el AS (SELECT query_id, list(question_id) AS el FROM expected GROUP BY 1)
SELECT query_id, kind, CASE WHEN off_topic THEN verdict = 'insuffisant'
  ELSE verdict = 'documente' AND len(list_intersect(list_transform(ids[1:2], lambda x: split_part(x, ':', 1)), coalesce(el, []))) > 0 END AS pass
FROM cases JOIN verdicts USING (query_id) LEFT JOIN el USING (query_id) WHERE verdict IN ('documente', 'insuffisant')"""


def _matches(x: str, pattern: str) -> str:
    return "regexp_matches(" + x + ", '" + pattern.replace("'", "''") + "')"


SQL["followup_context"] = f"""
WITH turns AS (
  SELECT conv_id, turn, (['', '', 'Et quand ? ', 'Pourquoi ', 'Selon la réponse ministérielle, ', 'Au sujet de '])[(conv_id + turn) % 6 + 1]
    || text AS text
  FROM conversations WHERE role = 'user'
  UNION ALL
  SELECT -1 - conv_id, turn, (['', '', 'Et quand ? ', 'Pourquoi ', 'Selon la réponse ministérielle, ', 'Au sujet de '])[(conv_id + turn) % 6 + 1]
    || CASE (conv_id + turn) % 6 WHEN 3 THEN array_to_string(string_split(text, ' ')[1:3], ' ') WHEN 2 THEN '' ELSE text END
  FROM conversations WHERE role = 'user'
), uttered AS (SELECT conv_id, turn, unnest({query_words('text')}) AS word FROM turns), {stems("uttered")},
n_roots AS (SELECT conv_id, turn, count(DISTINCT stem) AS n FROM uttered JOIN stems USING (word) GROUP BY ALL),
flagged AS (
  SELECT conv_id, turn, text, NOT {_matches('f', V.NEW_TOPIC_PATTERN)} AND (({_matches('f', V.SHORT_FOLLOWUP_PATTERN)}
    AND coalesce(n, 0) < {V.FOLLOWUP_MAX_TOKENS}) OR {_matches('f', V.SOURCE_FOLLOWUP_PATTERN)}) AS followup
  FROM (SELECT *, {fold('trim(text)')} AS f FROM turns LEFT JOIN n_roots USING (conv_id, turn))
)
SELECT conv_id, turn, followup, CASE WHEN followup THEN concat_ws(' ', CASE WHEN f1 AND f2 AND f3 THEN t4 END, CASE WHEN f1 AND f2 THEN t3 END, CASE WHEN f1 THEN t2 END, t1, text) ELSE text END AS query
FROM (SELECT *, lag(text, 1) OVER w AS t1, lag(text, 2) OVER w AS t2, lag(text, 3) OVER w AS t3, lag(text, 4) OVER w AS t4,
  lag(followup, 1) OVER w AS f1, lag(followup, 2) OVER w AS f2, lag(followup, 3) OVER w AS f3 FROM flagged WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""
