"""DuckDB SQL that says the same as the registered queries, composed of shared pieces."""

from __future__ import annotations

from folioquery.functions import topics as Q
from folioquery.functions.text import REFUSAL_TEXT, WHITESPACE, WORD
from folioquery.operators.answering import SYSTEM_PROMPT

WS = WHITESPACE


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def a_list(words: list[str]) -> str:
    return "(" + ", ".join(map(quoted, words)) + ")"


def strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def clean(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '{WS}+', ' ', 'g'), '[^\x00-\x7F]+', ' ', 'g'), ' ')"


def sentences(x: str) -> str:
    parts = rf"string_split(regexp_replace({clean(x)}, '([.!?]) +', '\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({parts}, lambda s: trim(s, ' ')), lambda s: s <> '')"


def tokens(x: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({x}), '{WORD}+'), lambda w: regexp_full_match(w, '[a-z0-9]+'))"


def norm(x: str) -> str:
    return rf"regexp_replace(lower({strip(x)}), '{WS}+', ' ', 'g')"


def unmarked(x: str) -> str:
    return rf"regexp_replace({x}, '[?.!,;:]+$', '')"


def bare(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^[ ?.!,;:]+', ''), '[ ?.!,;:]+$', '')"


def swap(x: str, word: str, by: str) -> str:
    """Whole-word replacement in one pass. Every character between words is doubled meanwhile, so
    that neighbours need not share one; what was put in is not looked at again."""
    apart = r"[^\p{L}\p{N}_]"
    double = lambda y: rf"regexp_replace({y}, '({apart})', '\1\1', 'g')"
    literal = rf"replace({double(by)}, '\', '\\')"
    put = rf"regexp_replace({double(x)}, '(^|{apart}){word.replace(' ', '  ')}($|{apart})', '\1' || {literal} || '\2', 'gi')"
    return rf"regexp_replace({put}, '({apart}){apart}', '\1', 'g')"


PIECES = f"""
s AS (SELECT doc_id, source, unnest(sents) AS sent, generate_subscripts(sents, 1) AS sn
      FROM (SELECT doc_id, source, {sentences('text')} AS sents FROM documents)),
cut AS (SELECT doc_id, source, sn, unnest(range(0, (length(sent) - 1) // 300 + 1)) AS k, sent FROM s),
p AS (SELECT doc_id, source, trim(substring(sent, k * 300 + 1, 300), ' ') AS piece, sn, k FROM cut),
pieces AS (SELECT doc_id, source, piece, row_number() OVER (PARTITION BY doc_id ORDER BY sn, k) AS n FROM p WHERE piece <> '')"""

CHUNKS = f"""{PIECES},
fold AS (
  SELECT doc_id, source, n, piece AS cur, NULL::VARCHAR AS done FROM pieces WHERE n = 1
  UNION ALL
  SELECT f.doc_id, f.source, q.n,
    CASE WHEN length(f.cur) + 1 + length(q.piece) + 1 <= 700 THEN f.cur || ' ' || q.piece
         WHEN trim(right(f.cur, 120), ' ') = '' THEN q.piece ELSE trim(right(f.cur, 120), ' ') || ' ' || q.piece END,
    CASE WHEN length(f.cur) + 1 + length(q.piece) + 1 <= 700 THEN NULL ELSE f.cur END
  FROM fold f JOIN pieces q ON q.doc_id = f.doc_id AND q.n = f.n + 1),
put AS (
  SELECT doc_id, source, n, done AS text FROM fold WHERE done IS NOT NULL AND length(done) >= 80
  UNION ALL
  SELECT f.doc_id, f.source, f.n + 1, f.cur FROM fold f
  JOIN (SELECT doc_id, max(n) AS n FROM pieces GROUP BY doc_id) m ON m.doc_id = f.doc_id AND m.n = f.n WHERE length(f.cur) >= 80),
chunks AS (
  SELECT row_number() OVER (ORDER BY source, doc_id, n) AS chunk_id, source, doc_id AS page,
         row_number() OVER (PARTITION BY doc_id ORDER BY n)::INTEGER AS chunk_seq, text FROM put)"""

KEYWORDS = f"""
qt AS (SELECT item_id AS qid, t AS token, count(*) AS tf FROM (SELECT item_id, unnest({tokens('text')}) AS t FROM benchmark) GROUP BY ALL),
qn AS (SELECT qid, sum(tf) AS n FROM qt GROUP BY qid),
ct AS (SELECT doc_id AS chunk_id, t AS token, count(*) AS tf FROM (SELECT doc_id, unnest({tokens('text')}) AS t FROM documents) GROUP BY ALL),
sparse AS (SELECT qid, chunk_id, sum(least(qt.tf, ct.tf))::DOUBLE / max(n) AS sparse_score FROM qt JOIN ct USING (token) JOIN qn USING (qid) GROUP BY qid, chunk_id)"""

UNIT = """
unit AS (SELECT vec_id, list_transform(v, lambda x: (x / CASE WHEN n = 0 THEN 1.0 ELSE n END)::FLOAT::DOUBLE) AS v
         FROM (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n
               FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)))"""

POOL = f"""{KEYWORDS}, {UNIT},
pair AS (SELECT q.item_id AS qid, c.vec_id AS chunk_id, round(list_dot_product(u.v, c.v), 9) AS dense_score
         FROM benchmark q JOIN unit u ON u.vec_id = q.item_id, unit c JOIN documents d ON d.doc_id = c.vec_id),
dense AS (SELECT * FROM pair QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dense_score DESC, chunk_id) <= 28),
fused AS (SELECT qid, chunk_id, coalesce(dense_score, 0.0) AS dense_score, coalesce(sparse_score, 0.0) AS sparse_score
          FROM dense FULL JOIN sparse USING (qid, chunk_id)),
scored AS (SELECT *, 0.75 * dense_score + 0.25 * sparse_score AS score FROM fused),
firsts AS (SELECT s.*, d.source, d.doc_id AS page, d.text FROM scored s JOIN documents d ON d.doc_id = s.chunk_id
  QUALIFY row_number() OVER (PARTITION BY qid, d.source, d.doc_id, left(d.text, 120) ORDER BY round(score, 9) DESC, chunk_id) = 1),
pool AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id)::INTEGER AS pool_rank FROM firsts QUALIFY pool_rank <= 20)"""

RERANKED = f"""{POOL},
boosted AS (
  SELECT p.*, score + CASE WHEN len(qs) = 0 OR len(cs) = 0 THEN 0 ELSE 0.15 * len(list_intersect(qs, cs)) / len(qs) END AS rerank_score
  FROM (SELECT p.*, list_distinct({tokens('b.text')}) AS qs, list_distinct({tokens('p.text')}) AS cs FROM pool p JOIN benchmark b ON b.item_id = p.qid) p),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rerank_score, 9) DESC, pool_rank)::INTEGER AS rank FROM boosted QUALIFY rank <= 7)"""

def _decided(questions: str) -> str:
    """The gate over `ranked`; questions: the table of (item_id, text) asked."""
    return f"""
stats AS (SELECT qid, max(CASE WHEN rank = 1 THEN score END) AS best, count(*) FILTER (WHERE rank <= 5 AND score >= 0.38) AS support FROM ranked GROUP BY qid),
ruled AS (
  SELECT b.item_id AS qid, b.text AS question, best, coalesce(support, 0) AS support,
    CASE WHEN best >= 0.72 THEN 'High' WHEN best >= 0.52 THEN 'Medium' ELSE 'Low' END AS label,
    coalesce(best >= 0.55 OR (best >= 0.42 AND support >= 2), false) AS should_answer
  FROM {questions} b LEFT JOIN stats s ON s.qid = b.item_id),
decided AS (SELECT *, should_answer AND label <> 'Low' AS answered, CASE WHEN should_answer AND label <> 'Low' THEN label ELSE 'Low' END AS confidence FROM ruled)"""


DECIDED = f"{RERANKED}, {_decided('benchmark')}"

#: The closest sentence of the best chunk, for the questions that the gate lets through.
ANSWERED = f"""
said AS (SELECT qid, question, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos
         FROM (SELECT d.qid, question, {sentences('r.text')} AS s FROM decided d JOIN ranked r ON r.qid = d.qid AND r.rank = 1 WHERE answered)),
closest AS (SELECT qid, sentence FROM said QUALIFY row_number() OVER (
  PARTITION BY qid ORDER BY len(list_intersect(list_distinct({tokens('question')}), list_distinct({tokens('sentence')}))) DESC, pos) = 1),
plain AS (SELECT d.qid, confidence, answered, coalesce({strip('sentence')}, '') AS a FROM decided d LEFT JOIN closest c ON c.qid = d.qid),
answers AS (SELECT qid, CASE WHEN NOT answered OR a = '' OR (contains(lower(a), 'could not find') AND contains(lower(a), 'context')) THEN {quoted(REFUSAL_TEXT)} ELSE a END AS answer, confidence FROM plain)"""


def _hashed(rows: str, key: str) -> str:
    """Unit vectors (key, v) of hashed token counts of rows (key, text)."""
    return f"""(SELECT {key}, list_transform(c, lambda x: (x / CASE WHEN n = 0 THEN 1.0 ELSE n END)::FLOAT) AS v
      FROM (SELECT {key}, c, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS n
            FROM (SELECT {key}, list_transform(range(64), lambda i: len(list_filter(b, lambda x: x = i))::DOUBLE) AS c
                  FROM (SELECT {key}, list_transform({tokens('text')}, lambda t: ('0x' || left(md5(t), 8))::BIGINT % 64) AS b FROM {rows}))))"""


def _unit(rows: str, key: str) -> str:
    return f"""(SELECT {key}, list_transform(v, lambda x: (x::DOUBLE / CASE WHEN n = 0 THEN 1.0 ELSE n END)::FLOAT::DOUBLE) AS v
      FROM (SELECT {key}, v, sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM {rows}))"""


#: Every benchmark item asked against the chunks of the documents, with hashed vectors.
ASSISTED = f"""
asked AS (SELECT item_id, text FROM benchmark),
lowered AS (SELECT item_id AS qid, lower({strip('text')}) AS text FROM benchmark),
qv AS (SELECT * FROM {_hashed('lowered', 'qid')}),
cv AS (SELECT * FROM {_unit(_hashed('chunks', 'chunk_id'), 'chunk_id')}),
qt AS (SELECT item_id AS qid, t AS token, count(*) AS tf FROM (SELECT item_id, unnest({tokens('text')}) AS t FROM benchmark) GROUP BY ALL),
qn AS (SELECT qid, sum(tf) AS n FROM qt GROUP BY qid),
ct AS (SELECT chunk_id, t AS token, count(*) AS tf FROM (SELECT chunk_id, unnest({tokens('text')}) AS t FROM chunks) GROUP BY ALL),
sparse AS (SELECT qid, chunk_id, sum(least(qt.tf, ct.tf))::DOUBLE / max(n) AS sparse_score FROM qt JOIN ct USING (token) JOIN qn USING (qid) GROUP BY qid, chunk_id),
dense AS (SELECT qid, chunk_id, round(list_dot_product(qv.v::DOUBLE[], cv.v), 9) AS dense_score FROM qv, cv
          QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dense_score DESC, chunk_id) <= 28),
scored AS (SELECT qid, chunk_id, 0.75 * coalesce(dense_score, 0.0) + 0.25 * coalesce(sparse_score, 0.0) AS score FROM dense FULL JOIN sparse USING (qid, chunk_id)),
firsts AS (SELECT s.*, c.source, c.page, c.text FROM scored s JOIN chunks c USING (chunk_id)
  QUALIFY row_number() OVER (PARTITION BY qid, c.source, c.page, left(c.text, 120) ORDER BY round(score, 9) DESC, chunk_id) = 1),
pool AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id)::INTEGER AS pool_rank FROM firsts QUALIFY pool_rank <= 20),
boosted AS (
  SELECT p.*, score + CASE WHEN len(qs) = 0 OR len(cs) = 0 THEN 0 ELSE 0.15 * len(list_intersect(qs, cs)) / len(qs) END AS rerank_score
  FROM (SELECT p.*, list_distinct({tokens('b.text')}) AS qs, list_distinct({tokens('p.text')}) AS cs FROM pool p JOIN benchmark b ON b.item_id = p.qid) p),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rerank_score, 9) DESC, pool_rank)::INTEGER AS rank FROM boosted QUALIFY rank <= 7)"""


def single(q: str) -> str:
    """q: normalised without end marks."""
    topic = lambda o: bare(rf"regexp_extract({q}, '^{o} +(.+)$', 1)")
    tried = [f"CASE WHEN {topic(o)} <> '' AND {topic(o)} NOT IN {a_list(Q.PRONOUNS)} THEN {topic(o)} END" for o in Q.TOPIC_OPENINGS]
    return f"coalesce({', '.join(tried)})"


def compared(q: str) -> str:
    patterns = ["^" + o.replace("'", "''") + " +(.+?) +(?:and|vs|versus) +(.+)$" for o in Q.COMPARE_OPENINGS] + ["^(.+?) +(?:vs|versus) +(.+)$"]
    side = lambda p, g: f"trim(regexp_replace({bare(f'''regexp_extract({q}, '{p}', {g})''')}, '^the +', ''), ' ')"
    tried = [f"CASE WHEN {side(p, 1)} <> '' AND {side(p, 2)} <> '' THEN [{side(p, 1)}, {side(p, 2)}] END" for p in patterns]
    return f"coalesce({', '.join(tried)})"


#: The messages as they are, some behind an opening that names a topic or a word that follows one up.
TURNS = f"""
turns AS (
  SELECT conv_id, turn, role, CASE (conv_id + turn) % 7
    WHEN 0 THEN 'What is ' || text WHEN 1 THEN 'Compare the light and ' || text
    WHEN 2 THEN 'How does it work with ' || text WHEN 3 THEN 'Which one is better: ' || text
    WHEN 5 THEN 'Tell me of the latter and its ' || text ELSE text END AS text FROM conversations),
named AS (
  SELECT *, CASE WHEN role = 'user' THEN lone END AS one, CASE WHEN role = 'user' THEN pair END AS two
  FROM (SELECT *, {single("q")} AS lone, {compared("q")} AS pair FROM (SELECT *, {unmarked(norm('text'))} AS q FROM turns))),
explicit AS (SELECT conv_id, turn, role, text, coalesce(two, CASE WHEN one IS NOT NULL THEN [one] END) AS explicit FROM named),
state AS (SELECT *, last_value(explicit IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS topics FROM explicit)"""


def _rewritten() -> str:
    cur, low, every = "cur", "low", "evry"
    filled = cur
    for word in Q.PLAIN_PRONOUNS:
        filled = swap(filled, word, every)
    for word in Q.POSSESSIVES:
        filled = swap(filled, word, f"({every} || '''s')")
    for word in Q.LATE_PRONOUNS:
        filled = swap(filled, word, every)
    place = swap(swap(cur, "former", "topics[1]"), "latter", "topics[2]")
    choice = swap(swap(unmarked(cur), "which one", "'which'"), "which of them", "'which'")
    hints = " OR ".join(f"contains({low}, {quoted(h)})" for h in Q.CHOICE_HINTS)
    pronouns = "[" + ", ".join(map(quoted, Q.PRONOUNS)) + "]"
    return f"""
SELECT conv_id, turn, text, CASE
  WHEN cur = '' OR explicit IS NOT NULL OR topics IS NULL THEN cur
  WHEN len(topics) >= 2 AND {place} <> cur THEN {place}
  WHEN len(topics) >= 2 AND ({hints}) THEN {choice} || ': ' || topics[1] || ' or ' || topics[2] || '?'
  WHEN {low} IN {a_list(Q.BARE_FOLLOW_UPS)} THEN {unmarked(cur)} || ' of ' || {every}
  WHEN len(list_intersect(regexp_extract_all({low}, '{WORD}+'), {pronouns})) > 0 THEN {strip(f"regexp_replace({filled}, '{WS}+', ' ', 'g')")}
  ELSE cur END AS rewritten
FROM (SELECT *, {strip('text')} AS cur, {norm('text')} AS low, CASE WHEN len(topics) >= 2 THEN topics[1] || ' and ' || topics[2] ELSE topics[1] END AS evry
      FROM state WHERE role = 'user')"""


def _title(x: str) -> str:
    run = rf"list_transform(regexp_extract_all({x}, '\p{{L}}+|[^\p{{L}}]+'), lambda r: upper(substring(r, 1, 1)) || lower(substring(r, 2)))"
    return f"array_to_string({run}, '')"


NAMES = rf"""
f AS (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS filename FROM pages),
cutoff AS (SELECT *, {strip(rf"regexp_replace(translate(regexp_replace(regexp_replace(filename, '\.[^.]*$', ''), '\([^)]*\)', '', 'g'), '_-', '  '), '{WS}+', ' ', 'g')")} AS plain FROM f),
names AS (SELECT page_id, filename, CASE WHEN filename = '' OR plain = '' THEN 'Document' WHEN upper(plain) = plain AND lower(plain) <> plain THEN {_title('plain')} ELSE plain END AS name FROM cutoff)"""

CONTEXT = """string_agg('[Source ' || rank || '] ' || source || ' | Page: ' || page || chr(10) || text, chr(10) || chr(10) ORDER BY rank)"""

ORACLES = {
    "clean_text": f"SELECT doc_id, {clean('text')} AS cleaned FROM documents",
    "sentences": f"SELECT doc_id, generate_subscripts(s, 1)::INTEGER AS n, unnest(s) AS sentence FROM (SELECT doc_id, {sentences('text')} AS s FROM documents)",
    "pieces": f"WITH {PIECES} SELECT doc_id, n::INTEGER AS n, piece FROM pieces",
    "chunks": f"WITH RECURSIVE {CHUNKS} SELECT * FROM chunks",
    "chunk_stats": f"WITH RECURSIVE {CHUNKS} SELECT (SELECT count(*) FROM documents WHERE {strip('text')} <> '') AS page_count, count(*) AS chunk_count, min(length(text)) AS min_chars, max(length(text)) AS max_chars, round(avg(length(text)), 6) AS mean_chars FROM chunks",
    "window_chunks": f"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k))::INTEGER AS n, text FROM (SELECT doc_id, k, substring(c, k * 400 + 1, 500) AS text FROM (SELECT doc_id, c, unnest(range(0, (length(c) - 1) // 400 + 1)) AS k FROM (SELECT doc_id, {clean('text')} AS c FROM documents) WHERE c <> '')) WHERE length(trim(text, ' ')) >= 50",
    "blank_filter": f"SELECT source, doc_id AS page, {strip('text')} AS text FROM documents WHERE {strip('text')} <> ''",
    "tokens_tf": f"SELECT doc_id, token, count(*)::INTEGER AS tf FROM (SELECT doc_id, unnest({tokens('text')}) AS token FROM documents) GROUP BY ALL",
    "keyword_overlap": f"WITH {KEYWORDS} SELECT qid, chunk_id, round(sparse_score, 9) AS sparse_score FROM sparse",
    "lexical_boost": f"WITH {RERANKED} SELECT qid, chunk_id, round(rerank_score - score, 9) AS boost FROM boosted",
    "vector_norm": "SELECT vec_id, round(CASE WHEN n = 0 THEN 1.0 ELSE n END, 6) AS norm FROM (SELECT vec_id, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)",
    "dense_topk": f"WITH {UNIT} SELECT q.vec_id AS qid, c.vec_id AS chunk_id, round(list_dot_product(q.v, c.v), 9) AS dense_score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.v, c.v), 9) DESC, c.vec_id)::INTEGER AS rank FROM unit q, unit c QUALIFY rank <= 28",
    "legacy_topk3": f"WITH {UNIT} SELECT q.vec_id AS qid, c.vec_id AS chunk_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], c.v), 9) DESC, c.vec_id)::INTEGER AS rank FROM embeddings q, unit c QUALIFY rank <= 3",
    "hybrid_search": f"WITH {POOL} SELECT qid, pool_rank, chunk_id, round(score, 6) AS score, round(dense_score, 6) AS dense_score, round(sparse_score, 6) AS sparse_score FROM pool",
    "rerank_topk": f"WITH {RERANKED} SELECT qid, rank, chunk_id, source, page, round(score, 6) AS score, round(rerank_score, 6) AS rerank_score FROM ranked",
    "gate_confidence": f"WITH {DECIDED} SELECT qid, round(best, 6) AS best_score, support, label, should_answer, answered, confidence FROM decided",
    "source_cards": f"WITH {RERANKED} SELECT qid, rank, source AS label, page, {strip('left(text, 240)')} || CASE WHEN length(text) > 240 THEN '…' ELSE '' END AS preview, round(score, 4) AS score, round(rerank_score, 4) AS rerank FROM ranked",
    "console_lines": f"""WITH {RERANKED} SELECT qid, rank, rank || '. ' || source || ' | Page: ' || page || ' | score ' || printf('%.4f', score::DOUBLE) || ' | dense ' || printf('%.4f', dense_score::DOUBLE)
        || ' | sparse ' || printf('%.4f', sparse_score::DOUBLE) || ' | rerank ' || printf('%.4f', rerank_score::DOUBLE) AS line FROM ranked""",
    "build_context": f"WITH {RERANKED} SELECT qid, {CONTEXT} AS context FROM ranked GROUP BY qid",
    "prompt": f"""WITH {RERANKED}, c AS (SELECT qid, {CONTEXT} AS context FROM ranked GROUP BY qid)
        SELECT qid, {quoted(SYSTEM_PROMPT)} AS system_prompt, {strip("'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question:' || chr(10) || text || chr(10) || chr(10) || 'Answer:'")} AS user_prompt FROM c JOIN benchmark ON item_id = qid""",
    "confidence_classes": f"""WITH {DECIDED} SELECT qid, CASE label WHEN 'High' THEN 'conf-high' WHEN 'Medium' THEN 'conf-medium' ELSE 'conf-low' END AS label_class,
        CASE confidence WHEN 'High' THEN 'conf-high' WHEN 'Medium' THEN 'conf-medium' ELSE 'conf-low' END AS shown_class FROM decided""",
    "answers": f"WITH {DECIDED}, {ANSWERED} SELECT * FROM answers",
    "assistant_flow": f"WITH RECURSIVE {CHUNKS}, {ASSISTED}, {_decided('asked')}, {ANSWERED} SELECT * FROM answers",
    "history_append": "SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, max(turn) + 1, 'assistant', 'Noted.' FROM conversations GROUP BY conv_id",
    "history_clear": "SELECT conv_id, turn, role, text FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')",
    "document_change": """SELECT conv_id || '|' || CASE WHEN turn // 2 % 2 = 0 THEN 'a.pdf' ELSE 'b.pdf' END AS conv_id, turn, role, text FROM conversations
        QUALIFY row_number() OVER (PARTITION BY conv_id, turn // 2 % 2 ORDER BY turn DESC) <= 2""",
    "until_exit": """WITH m AS (SELECT conv_id, turn * 2 AS turn, role, text FROM conversations UNION ALL SELECT DISTINCT conv_id, conv_id % 5 * 2 + 1, 'user', ' Exit ' FROM conversations),
        e AS (SELECT conv_id, min(turn) AS e FROM m WHERE role = 'user' AND lower(trim(text)) IN ('exit', 'quit') GROUP BY conv_id)
        SELECT m.* FROM m LEFT JOIN e ON m.conv_id = e.conv_id WHERE e IS NULL OR turn < e""",
    "index_cache": f"""WITH RECURSIVE {CHUNKS} SELECT 'renamed' AS source, count(*) AS chunk_rows, sum(length(text))::BIGINT AS chars,
        (SELECT count(*) FROM documents WHERE {strip('text')} <> '') AS page_count, count(*) AS chunk_count FROM chunks""",
    "index_versions": f"WITH RECURSIVE {CHUNKS} SELECT coalesce(source, 'none') AS source, count(*) AS chunk_rows, sum(length(text))::BIGINT AS chars, 3::BIGINT AS version, 1::BIGINT AS parts FROM chunks GROUP BY ALL",
    "topic_extract": f"WITH {TURNS} SELECT conv_id, turn, explicit[1] AS first_topic, explicit[2] AS second_topic FROM explicit WHERE role = 'user'",
    "topic_state": f"WITH {TURNS} SELECT conv_id, turn, role, array_to_string(topics, '|') AS topics FROM state",
    "rewrite_query": f"WITH {TURNS} {_rewritten()}",
    "recent_history": "SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4",
    "question_kinds": f"""SELECT conv_id, turn, len(list_intersect(regexp_extract_all(low, '{WORD}+'), [{', '.join(map(quoted, Q.PRONOUNS))}])) > 0 AS has_pronoun,
        ({' OR '.join(f"contains(low, {quoted(h)})" for h in Q.COMPARISON_HINTS)}) AS is_comparison,
        regexp_replace(regexp_replace(low, '^[?.!,;:]+', ''), '[?.!,;:]+$', '') IN {a_list(Q.SHORT_QUESTIONS)} AS is_short
        FROM (SELECT conv_id, turn, {norm('text')} AS low FROM conversations WHERE role = 'user')""",
    "refusal_norm": f"SELECT conv_id, turn, CASE WHEN a = '' OR (contains(lower(a), 'could not find') AND contains(lower(a), 'context')) THEN {quoted(REFUSAL_TEXT)} ELSE a END AS answer FROM (SELECT conv_id, turn, {strip('text')} AS a FROM conversations WHERE role = 'assistant')",
    "doc_name": f"WITH {NAMES} SELECT page_id, name, CASE WHEN length(name) <= 22 THEN name ELSE left(name, 21) || '…' END AS short_name FROM names",
    "suggestions": f"""WITH {NAMES} SELECT page_id, generate_subscripts(s, 1)::INTEGER AS n, unnest(s) AS suggestion FROM (SELECT page_id, ['What is the main topic of ' || name || '?',
        'Summarize the key concepts in this document.', 'Explain an important concept from this PDF.', 'Compare two related topics mentioned here.'] AS s FROM names)""",
    "signature": "SELECT doc_id, substring(sha256(text), 1, 32) AS signature FROM documents",
    "prefix_endpoint": "SELECT (row_number() OVER (ORDER BY o))::INTEGER AS rank, p_name AS word FROM (SELECT p_partkey AS o, p_name FROM part WHERE starts_with(p_name, lower('Small')) ORDER BY p_partkey LIMIT 5)",
    "prefix_json": "SELECT to_json(list(p_name ORDER BY o))::VARCHAR AS words FROM (SELECT p_partkey AS o, p_name FROM part WHERE starts_with(p_name, lower('Small')) ORDER BY p_partkey LIMIT 5)",
    "word_list": f"SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS ordinal, p_name AS word FROM part QUALIFY {strip('p_name')} <> ''",
    "extracted_pages": f"SELECT substring(sha256(text), 1, 32) AS signature, doc_id || '.txt' AS source, 1::INTEGER AS page, {strip('text')} AS text FROM documents WHERE {strip('text')} <> ''",
    "pdf_pages": f"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents)
        SELECT doc_id || '.pdf' AS source, page::INTEGER AS page, {strip('text')} AS text FROM lines WHERE {strip('text')} <> ''""",
    "folder_pages": f"""WITH named AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\n+', chr(10), 'g') AS text, coalesce(source, 'none') || '-' || floor(doc_id / 40)::BIGINT || '.pdf' AS source FROM documents),
        pages AS (SELECT *, dense_rank() OVER (ORDER BY source) - 1 AS file_no, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page FROM named)
        SELECT file_no, source, page::INTEGER AS page, {strip('text')} AS text FROM pages WHERE {strip('text')} <> ''""",
    "trie_autocomplete": """WITH words AS (SELECT p_name AS word, min(p_partkey) AS o FROM part WHERE starts_with(p_name, 's') GROUP BY p_name),
        deep AS (SELECT word, d, min(o) OVER (PARTITION BY d, left(word, d)) AS made FROM (SELECT word, o, unnest(range(1, length(word) + 1)) AS d FROM words)),
        keys AS (SELECT word, list(made ORDER BY d) AS k FROM deep GROUP BY word)
        SELECT row_number() OVER (ORDER BY k)::INTEGER AS rank, word FROM keys QUALIFY rank <= 3""",
    "prefix_lookup": """WITH words AS (SELECT p_name AS word, min(p_partkey) AS o FROM part GROUP BY p_name),
        deep AS (SELECT word, d, min(o) OVER (PARTITION BY d, left(word, d)) AS made FROM (SELECT word, o, unnest(range(1, length(word) + 1)) AS d FROM words)),
        keys AS (SELECT word, list(made ORDER BY d) AS k FROM deep GROUP BY word),
        asked AS (SELECT DISTINCT left(p_name, n) AS prefix FROM part, range(1, 5) r(n)),
        tree AS (SELECT prefix, word, row_number() OVER (PARTITION BY prefix ORDER BY k) AS rank FROM asked JOIN keys ON starts_with(word, prefix)),
        listed AS (SELECT prefix, p_name AS word, row_number() OVER (PARTITION BY prefix ORDER BY p_partkey) AS rank FROM asked JOIN part ON starts_with(p_name, lower(prefix)))
        SELECT prefix, coalesce((SELECT string_agg(word, '|' ORDER BY rank) FROM tree t WHERE t.prefix = a.prefix AND rank <= 3), '') AS tree,
            coalesce((SELECT string_agg(word, '|' ORDER BY rank) FROM listed l WHERE l.prefix = a.prefix AND rank <= 5), '') AS listed FROM asked a""",
    "dedup_first": "SELECT doc_id AS chunk_id FROM documents QUALIFY row_number() OVER (PARTITION BY left(text, 120) ORDER BY n_chars DESC, doc_id) = 1",
}
