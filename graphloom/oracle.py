"""The same queries as SQL over the same tables, for comparison."""

from __future__ import annotations

from html.entities import codepoint2name

from .functions.text import OUT_OF_SCOPE, STOPWORDS, TOKEN, WITHHELD
from .operators.answer import ACTIONS

#: Named character references, and what counts as white space at the ends of a piece of a page.
NAMED = "MAP {" + ", ".join(f"'&{name};': chr({code})" for code, name in codepoint2name.items()) + "}"
SPACE = " || ".join(f"chr({c})" for c in range(0x3001) if chr(c).isspace())

STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def all_tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{TOKEN}')"


def tokens(x: str) -> str:
    return f"list_filter({all_tokens(x)}, lambda t: NOT list_contains({STOP}, t))"


def token_set(x: str) -> str:
    return f"list_distinct({tokens(x)})"


def unescaped(x: str) -> str:
    """Character references by name or decimal number with a semicolon."""
    return f"array_to_string(list_transform(string_split(regexp_replace({x}, '&#?[A-Za-z0-9]+;', chr(57344) || '\\0' || chr(57344), 'g'), chr(57344)), lambda y: CASE WHEN regexp_full_match(y, '&#[0-9]+;') THEN chr(substr(y, 3, length(y) - 3)::INTEGER) ELSE coalesce(named[y], y) END), '')"


#: What of a page is no text: elements without text with their content, comments and markup.
NO_TEXT = "(?is)" + "|".join(rf"<{name}\b[^>]*>.*?(?:</{name}\s*>|\z)" for name in ("script", "style", "noscript")) + r"|<!--.*?(?:-->|\z)|<[!?/]?[a-z][^>]*>"

PAGE_TEXT = f"""
WITH p AS (SELECT page_id, {NAMED} AS named, {SPACE} AS spaces, unnest(regexp_split_to_array(coalesce(html, ''), '{NO_TEXT}')) AS x, generate_subscripts(regexp_split_to_array(coalesce(html, ''), '{NO_TEXT}'), 1) AS i FROM pages),
q AS (SELECT page_id, i, trim({unescaped("x")}, spaces) AS x FROM p),
t AS (SELECT page_id, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (x <> ''), '') AS t FROM q GROUP BY page_id)
SELECT page_id, length(t)::BIGINT AS n_chars, md5(t) AS text_md5 FROM t"""


def normalized(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def sentences(x: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace(trim({x}), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


def first_kept(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def phrases(x: str, limit: int) -> tuple[str, str, str]:
    """Three steps: runs of content tokens, their windows, the first different ones."""
    marked = f"array_to_string(list_transform({all_tokens('s')}, lambda t: CASE WHEN list_contains({STOP}, t) THEN '|' ELSE t END), ' ')"
    runs = f"flatten(list_transform({sentences(x)}, lambda s: list_filter(list_transform(string_split({marked}, '|'), lambda r: list_filter(string_split(r, ' '), lambda t: t <> '')), lambda r: len(r) > 1)))"
    k = "((len(r) - 1) // 3)"
    windows = f"flatten(list_transform(runs, lambda r: list_concat(list_transform(range(0, {k}), lambda j: array_to_string(r[3 * j + 1 : 3 * j + 4], ' ')), CASE WHEN len(r) - 3 * {k} >= 2 THEN [array_to_string(r[3 * {k} + 1 : 3 * {k} + 4], ' ')] ELSE []::VARCHAR[] END)))"
    return runs, windows, f"{first_kept('windows')}[1:{limit}]"


def terms(x: str, limit: int) -> str:
    return f"list_transform(list_sort(list_transform(list_distinct({x}), lambda t: {{'n': -len(list_filter({x}, lambda v: v = t)), 't': t}})), lambda s: s.t)[1:{limit}]"


CORPUS = """corpus AS (
  SELECT doc_id, 'doc:' || doc_id AS id, source || ' ' || doc_id AS title, 'docs://' || source || '/' || doc_id AS uri, source AS domain, coalesce(text, '') AS text FROM documents)"""

#: Documents with four words or more and a reply of them; good: what keeps the limits.
REPLIES = """said AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z]{4,}')[1:4] AS w FROM documents WHERE len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]{4,}')) >= 4),
good AS (SELECT * FROM said WHERE doc_id % 11 <> 4 AND doc_id % 7 <> 3)"""


def chunked(most: int) -> str:
    return f"""flat AS (SELECT id, title, uri, domain, {normalized("text")} AS t FROM corpus),
cuts AS (
  SELECT id, title, uri, domain, t, 0 AS ordinal, 0 AS a, {_end("t", "0", most)} AS b FROM flat WHERE length(t) > 0
  UNION ALL
  SELECT id, title, uri, domain, t, ordinal + 1, n, {_end("t", "n", most)} FROM (SELECT *, b + CASE WHEN substr(t, b + 1, 1) = ' ' THEN 1 ELSE 0 END AS n FROM cuts) WHERE n < length(t)),
chunks AS (SELECT id AS document_id, title, uri, domain, ordinal, a, b, trim(substr(t, a + 1, b - a)) AS text, id || ':chunk:' || ordinal AS chunk_id FROM cuts)"""


def _end(t: str, a: str, most: int) -> str:
    w = f"substr({t}, {a} + 1, {most})"
    back = f"strpos(reverse({w}), ' .')"
    stop = f"({a} + length({w}) - {back} - 1)"
    return f"CASE WHEN {a} + {most} >= length({t}) THEN length({t}) WHEN {back} > 0 AND {stop} > {a} + 80 THEN {stop} + 1 ELSE {a} + {most} END"


def _nodes() -> str:
    runs, windows, first = phrases("text", 5)
    return f"""n1 AS (SELECT *, {tokens("text")} AS toks, {runs} AS runs FROM chunks),
n2 AS (SELECT *, {terms("toks", 5)} AS terms, {windows} AS windows FROM n1),
n3 AS (SELECT *, {first} AS phrases FROM n2),
n4 AS (SELECT *, CASE WHEN len(phrases) > 0 THEN phrases[1] WHEN len(terms) > 0 THEN array_to_string(terms[1:3], ' / ') ELSE title END AS label FROM n3),
nodes AS (SELECT *, 'concept:' || substr(sha1(chunk_id || '::' || label), 1, 12) AS id FROM n4)"""


CHUNKS = f"WITH RECURSIVE {CORPUS},\n{chunked(360)}"
NODES = f"{CHUNKS},\n{_nodes()}"
ADJACENT = f"""{NODES},
pairs AS (SELECT id AS source, lead(id) OVER (PARTITION BY document_id ORDER BY ordinal) AS target FROM nodes),
adjacent AS (SELECT 'edge:' || substr(sha1(source || '::' || target || '::adjacent_to'), 1, 12) AS id, source, target, 0.62::DOUBLE AS weight FROM pairs WHERE target IS NOT NULL AND source <> target)"""

ITEMS = f"""{CORPUS},
items AS (SELECT id AS node_id, domain, title || ' ' || text AS body, text AS evidence, uri AS source FROM corpus),
toks AS (SELECT node_id, domain, {tokens("body")} AS ts FROM items),
asked AS (SELECT item_id::VARCHAR AS query_id, text AS query, {tokens("text")} AS ts, {token_set("text")} AS terms FROM benchmark),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(ts) AS term FROM asked) GROUP BY ALL)"""


def bm25(by: str = "") -> str:
    and_by = f", {by}" if by else ""
    join = f"AND l.{by} = f.{by}" if by else ""
    sizes = f"JOIN sizes z ON l.{by} = z.{by}" if by else "CROSS JOIN sizes z"
    pick = f"l.{by}, " if by else ""
    return f"""tf AS (SELECT node_id{and_by}, term, count(*) AS tf FROM (SELECT node_id{and_by}, unnest(ts) AS term FROM toks) GROUP BY ALL),
lists AS (SELECT *, sum(tf) OVER (PARTITION BY node_id{and_by}) AS dl FROM tf),
dfs AS (SELECT term{and_by}, count(*) AS df FROM lists GROUP BY ALL),
sizes AS (SELECT {f"{by}, " if by else ""}count(*) AS n, avg(len(ts)) AS avgdl FROM toks {f"GROUP BY {by}" if by else ""}),
lexical AS (SELECT q.query_id, {pick}l.node_id, sum(ln(1 + (z.n - f.df + 0.5::DOUBLE) / (f.df + 0.5::DOUBLE)) * l.tf * 2.5::DOUBLE / (l.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.dl / greatest(z.avgdl, 1e-9::DOUBLE))) * q.times) AS score
  FROM lists l JOIN qt q USING (term) JOIN dfs f ON l.term = f.term {join} {sizes} GROUP BY ALL)"""


def hashed(source: str, key: str, body: str, name: str) -> str:
    """Hash embeddings by SHA-1 as (key, bucket, value), in single precision as they are stored."""
    return f"""{name}_w AS (SELECT {key}, unnest(string_split_regex(trim(lower({body})), '\\s+')) AS w FROM {source}),
{name}_c AS (SELECT {key}, ('0x' || substr(sha1(w), 1, 8))::BIGINT % 384 AS bucket, sum(CASE WHEN contains('02468ace', substr(sha1(w), 9, 1)) THEN 1 ELSE -1 END)::DOUBLE AS c FROM {name}_w WHERE w <> '' GROUP BY ALL),
{name} AS (SELECT {key}, bucket, (c / nullif(sqrt(sum(c * c) OVER (PARTITION BY {key})), 0))::FLOAT::DOUBLE AS v FROM {name}_c)"""


#: The dense score of every question and document.
DENSE = f"""{hashed("items", "node_id", "body", "iv")},
{hashed("asked", "query_id", "query", "qv")},
dots AS (SELECT query_id, node_id, sum(q.v * i.v) AS d FROM qv q JOIN iv i USING (bucket) GROUP BY ALL),
dense AS (SELECT q.query_id, i.node_id, coalesce(d, 0)::DOUBLE AS score FROM asked q CROSS JOIN items i LEFT JOIN dots ON dots.query_id = q.query_id AND dots.node_id = i.node_id)"""


def nearest(k: int) -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, node_id) AS rank FROM dense QUALIFY rank <= {k})"


def top(source: str, k: int, by: str = "query_id") -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round(score, 9) DESC, node_id) AS rank FROM {source} QUALIFY rank <= {k})"


CHAIN = """chain AS (
  SELECT source, target, 'related_to' AS edge_type, 0.62::DOUBLE AS weight FROM (SELECT node_id AS source, lead(node_id) OVER (PARTITION BY domain ORDER BY node_id) AS target FROM items) WHERE target IS NOT NULL
  UNION ALL SELECT source, target, 'portal', 0.66::DOUBLE FROM (SELECT node_id AS source, domain, lead(node_id) OVER (ORDER BY node_id) AS target, lead(domain) OVER (ORDER BY node_id) AS other FROM items) WHERE other <> domain),
adj AS (SELECT source AS src, target AS dst, edge_type, weight FROM chain UNION ALL SELECT target, source, edge_type, weight FROM chain),
places AS (SELECT node_id, ('0x' || substr(sha1(node_id), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE * (2 * pi()) AS theta, ('0x' || substr(sha1(node_id), 9, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE * (2 * pi()) AS phi FROM items)"""


POINTS = """raw AS (SELECT vec_id, list_sum(list_filter(embedding::DOUBLE[], lambda v, i: i % 2 = 1)) AS x, list_sum(list_filter(embedding::DOUBLE[], lambda v, i: i % 2 = 0)) AS y FROM embeddings WHERE embedding IS NOT NULL),
lim AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM raw),
points AS (SELECT vec_id, vec_id::VARCHAR AS node_id, CASE WHEN x1 > x0 THEN (x - x0) / (x1 - x0) * (2 * pi()) ELSE 0 END AS theta, CASE WHEN y1 > y0 THEN (y - y0) / (y1 - y0) * (2 * pi()) ELSE 0 END AS phi FROM raw, lim)"""
CELL = "least(3, floor((({0} % (2 * pi())) + 2 * pi()) % (2 * pi()) / (2 * pi()) * 4)::BIGINT)"


def delta(a: str, b: str) -> str:
    return f"(((({a} - {b} + pi()) % (2 * pi())) + 2 * pi()) % (2 * pi()) - pi())"


def near(a: str, b: str) -> str:
    return f"greatest(0, 1 - sqrt({delta(f'{a}.theta', f'{b}.theta')} ** 2 + {delta(f'{a}.phi', f'{b}.phi')} ** 2) / pi())"


def scored_edges(front: str) -> str:
    """The edges of (query_id, node_id, score, seed_id) with matched, s (their score) and pruned."""
    return f"""(SELECT m.*, m.score * 0.42::DOUBLE + m.weight * 0.34::DOUBLE + len(matched)::DOUBLE / greatest(1, n_terms) * 0.48::DOUBLE + near_c * 0.16::DOUBLE + near_s * 0.08::DOUBLE + CASE WHEN edge_type <> 'portal' THEN 0.0 WHEN len(matched) > 0 THEN 0.10 ELSE -0.22 END::DOUBLE AS s,
    edge_type = 'portal' AND len(matched) = 0 AS pruned
  FROM (SELECT f.query_id, f.node_id AS from_id, a.dst AS to_id, a.edge_type, a.weight, f.score, f.seed_id, list_intersect(q.terms, list_distinct(t.ts)) AS matched, len(q.terms) AS n_terms, {near("c", "d")} AS near_c, {near("z", "d")} AS near_s
    FROM {front} f JOIN adj a ON f.node_id = a.src JOIN toks t ON t.node_id = a.dst JOIN asked q ON q.query_id = f.query_id JOIN places c ON c.node_id = f.node_id JOIN places d ON d.node_id = a.dst JOIN places z ON z.node_id = f.seed_id) m)"""


WRAPPED = f"sqrt({delta('q.theta', 'p.theta')} ** 2 + {delta('q.phi', 'p.phi')} ** 2)"
FLAT = "sqrt((q.theta - p.theta) ** 2 + (q.phi - p.phi) ** 2)"

EVIDENCE = f"""best AS (SELECT query_id, node_id AS document_id, rank FROM {top("lexical", 5)}),
spans AS (SELECT DISTINCT b.query_id, c.uri, c.a AS span_start, c.b AS span_end, c.text FROM best b JOIN chunks c ON b.document_id = c.document_id),
scored AS (SELECT s.*, len(list_intersect(q.terms, {token_set("s.text")})) AS support FROM spans s JOIN asked q USING (query_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY support DESC, length(text) DESC, uri, span_start) AS rank FROM scored WHERE support > 0)"""
FOUND = f"WITH RECURSIVE {ITEMS},\n{bm25()},\n{chunked(360)},\n{EVIDENCE}"
SAID = f"""pieces AS (SELECT DISTINCT query_id, unnest({sentences("text")}) AS sentence FROM ranked WHERE rank <= 6),
weighed AS (SELECT p.query_id, sentence, len(list_intersect(q.terms, {token_set("sentence")})) AS support FROM pieces p JOIN asked q USING (query_id)),
said AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY support DESC, length(sentence) DESC, sentence) AS rank FROM weighed WHERE support > 0 QUALIFY rank <= 4)"""

TOLD = f"""facts AS (SELECT query_id, count(*) AS spans, sum(support)::BIGINT AS support, count(DISTINCT uri) AS sources, string_agg(text, ' ') AS body FROM ranked WHERE rank <= 6 GROUP BY 1),
told AS (SELECT query_id, string_agg(sentence, ' ' ORDER BY rank) AS said FROM said GROUP BY 1),
named AS (SELECT query_id, string_agg(document_id, ', ' ORDER BY rank) AS labels FROM best WHERE rank <= 3 GROUP BY 1),
r0 AS (SELECT q.query_id, q.terms, said, labels, spans, coalesce(support, 0) AS support, coalesce(sources, 0) AS sources, {token_set("coalesce(body, '')")} AS bts,
  list_has_any(q.terms, {OUT_OF_SCOPE!r}) OR said IS NULL AS withheld FROM asked q LEFT JOIN facts USING (query_id) LEFT JOIN told USING (query_id) LEFT JOIN named USING (query_id)),
r AS (SELECT *, CASE WHEN withheld THEN '{WITHHELD}' ELSE said || ' The strongest retrieved concepts are ' || coalesce(labels, '') || '. This answer is grounded in ' || sources || ' source(s).' END AS answer FROM r0)"""

RUNS = """li AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS flags, list_sort(list(l_linestatus)) AS edge_types, sum(l_quantity) AS quantity, count(*) AS lines FROM lineitem GROUP BY 1),
runs AS (SELECT o_orderkey::VARCHAR AS question_id, o_orderpriority AS strategy, CASE WHEN o_orderstatus = 'P' THEN ['F', 'O'] ELSE [o_orderstatus] END AS expected, lines > 1 AS expect_answer, flags, edge_types, lines, quantity,
  o_totalprice AS latency_ms FROM orders JOIN li ON o_orderkey = l_orderkey),
m1 AS (SELECT *, (list_contains(flags, 'A')::INT + list_contains(flags, 'N')::INT) / 2.0::DOUBLE AS term_recall, CASE WHEN lines > 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS source_recall,
  len(list_intersect(list_distinct(edge_types), expected))::DOUBLE / len(expected) AS path_recall, least(1, (len(list_filter(edge_types, lambda t: list_contains(expected, t))) + CASE WHEN lines > 1 THEN 1 ELSE 0 END)::DOUBLE / len(edge_types)) AS path_precision,
  CASE WHEN lines = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS faithfulness FROM runs),
rows AS (SELECT *, CASE WHEN NOT expect_answer THEN faithfulness >= 1 AND source_recall >= 1 ELSE term_recall >= 0.5 AND source_recall >= 0.5 AND path_recall >= 0.5 AND faithfulness >= 0.5 END AS passed, quantity > 100 AS warned FROM m1),
summary AS (SELECT strategy, count(*) AS rows, avg(passed::INT) AS pass_rate, avg(term_recall) AS term_recall, avg(source_recall) AS source_recall, avg(path_recall) AS path_recall, avg(path_precision) AS path_precision,
  avg(faithfulness) AS faithfulness, quantile_cont(latency_ms, 0.5) AS p50, quantile_cont(latency_ms, 0.95) AS p95, avg(lines) AS nodes, avg(lines % 3) AS portals, avg(len(flags)) AS crossings, avg(warned::INT) AS warned, avg((lines = 7)::INT) AS external FROM rows GROUP BY 1)"""


def _phrase_list() -> str:
    runs, windows, first = phrases("t", 8)
    return f"WITH a AS (SELECT doc_id, {normalized('text')} AS t FROM documents), b AS (SELECT doc_id, {runs} AS runs FROM a), c AS (SELECT doc_id, list_distinct(windows) AS kinds, windows FROM (SELECT doc_id, {windows} AS windows FROM b)), d AS (SELECT doc_id, list_transform(list_sort(list_transform(kinds, lambda k: {{'p': list_position(windows, k), 'k': k}})), lambda x: x.k)[1:8] AS l FROM c) SELECT doc_id, unnest(range(0, len(l)))::BIGINT AS pos, unnest(l) AS phrase FROM d"


def _level(n: int) -> str:
    """One level of the traversal in levels over the graph of documents."""
    order = "round(s, 9) DESC, to_id, from_id, edge_type"
    return f"""e{n} AS (SELECT e.* FROM {scored_edges(f"f{n}")} e WHERE NOT pruned AND NOT EXISTS (SELECT 1 FROM v{n} v WHERE v.query_id = e.query_id AND v.node_id = e.to_id) AND (len(matched) > 0 OR s >= score + 0.08)),
p{n} AS (SELECT *, row_number() OVER (PARTITION BY query_id, from_id, edge_type ORDER BY {order}) AS pp FROM e{n}),
g{n} AS (SELECT *, row_number() OVER (PARTITION BY query_id, from_id ORDER BY {order}) AS pn FROM p{n} WHERE edge_type <> 'portal' OR pp <= 1),
h{n} AS (SELECT *, row_number() OVER (PARTITION BY query_id, to_id ORDER BY {order}) AS bn FROM g{n} WHERE pn <= 3),
s{n} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS fn FROM h{n} WHERE bn = 1 QUALIFY fn <= 5),
f{n + 1} AS (SELECT query_id, to_id AS node_id, s AS score, seed_id FROM s{n}),
v{n + 1} AS (SELECT * FROM v{n} UNION ALL SELECT query_id, to_id FROM s{n})"""


REVIEWS = """reviews AS (SELECT doc_id, toxic, CASE WHEN quality = 1 AND doc_id % 3 <> 0 THEN CASE WHEN doc_id % 5 = 0 THEN 'assistant_reviewed' ELSE 'human_reviewed' END WHEN quality = 1 THEN 'reviewed_missing_metadata' ELSE 'human_rejected' END AS status, quality = 1 AND doc_id % 3 <> 0 AS signed FROM labels)"""

SQL = {
    "tokenize_documents": f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {tokens("coalesce(text, '')")} AS t FROM documents)",
    "important_terms": f"SELECT doc_id, term, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, term) AS rank FROM (SELECT doc_id, unnest({tokens('text')}) AS term FROM documents) GROUP BY doc_id, term QUALIFY rank <= 8",
    "sentence_split": f"SELECT doc_id, unnest(range(0, len(l)))::BIGINT AS pos, unnest(list_transform(l, lambda s: length(s)))::BIGINT AS n_chars, unnest(list_transform(l, lambda s: md5(s))) AS sentence_md5 FROM (SELECT doc_id, {sentences(normalized('text'))} AS l FROM documents)",
    "noun_phrases": _phrase_list(),
    "normalize_text": f"SELECT doc_id, length(t)::BIGINT AS n_chars, md5(t) AS text_md5, substr(sha256(t), 1, 12) AS sha12 FROM (SELECT doc_id, {normalized("coalesce(text, '')")} AS t FROM documents)",
    "markdown_text": "SELECT doc_id, length(t)::BIGINT AS n_chars, md5(t) AS text_md5 FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?s)```.*?```', ' ', 'g'), '`([^`]*)`', '\\1', 'g'), '!\\[[^\\]]*\\]\\([^)]*\\)', ' ', 'g'), '\\[([^\\]]+)\\]\\([^)]*\\)', '\\1', 'g'), '(?m)^\\s{0,3}#{1,6}\\s*', '', 'g') AS t FROM documents)",
    "page_html_text": PAGE_TEXT,
    "document_titles": "WITH t AS (SELECT doc_id, text, coalesce(substr(list_filter(list_transform(string_split(replace(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(10), chr(1)), chr(1)), lambda s: trim(s)), lambda s: s <> '')[1], 1, 96), 'untitled') AS title FROM documents) SELECT doc_id, title, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS slug, ceil(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) * 1.35::DOUBLE)::BIGINT AS tokens_estimated FROM t",
    "chunk_documents": f"{CHUNKS} SELECT chunk_id, a::BIGINT AS span_start, b::BIGINT AS span_end, md5(text) AS text_md5 FROM chunks",
    "url_domain": "SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS domain, regexp_replace(regexp_replace(url, '(?s)#.*$', ''), '/+$', '') AS canonical FROM pages",
    "conversation_documents": "SELECT 'chat:' || conv_id AS id, 'conversation ' || conv_id AS title, 'chat://' || conv_id AS source, length(t)::BIGINT AS n_chars, md5(t) AS text_md5 FROM (SELECT conv_id, string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS t FROM conversations GROUP BY 1)",
    "doclet_rounds": f"WITH RECURSIVE {CORPUS},\n{chunked(150)} SELECT ordinal::BIGINT AS round, count(*) AS doclets, sum(length(text))::BIGINT AS n_chars FROM chunks GROUP BY 1",
    "concept_nodes": f"{NODES} SELECT id, label, chunk_id, array_to_string(terms, ',') AS terms, array_to_string(phrases, ',') AS phrases, replace(lower(title), ' ', '-') AS second_group FROM nodes",
    "adjacency_edges": f"{ADJACENT} SELECT * FROM adjacent",
    "shared_phrase_edges": f"""{NODES},
keys AS (SELECT id, document_id || '|' || lpad(ordinal::VARCHAR, 9, '0') AS seq, unnest(list_concat(phrases, terms)) AS phrase FROM nodes),
flags AS (SELECT id, domain, {token_set("text")} AS ts, CASE WHEN contains(lower(text), 'requires') THEN 1 WHEN contains(lower(text), 'resolution') THEN 2 ELSE 0 END AS f FROM nodes),
met AS (SELECT l.id AS source, l.phrase, CASE WHEN a.domain <> b.domain THEN 'portal' WHEN a.f = 1 OR b.f = 1 THEN 'depends_on' WHEN a.f = 2 OR b.f = 2 THEN 'supports' ELSE 'related_to' END AS edge_type, len(list_intersect(a.ts, b.ts)) AS shared
  FROM keys l JOIN keys r ON l.phrase = r.phrase AND l.seq < r.seq AND l.id <> r.id JOIN flags a ON a.id = l.id JOIN flags b ON b.id = r.id)
SELECT edge_type, count(*) AS edges, round(sum(least(0.92::DOUBLE, CASE edge_type WHEN 'portal' THEN 0.66 WHEN 'depends_on' THEN 0.62 WHEN 'supports' THEN 0.64 ELSE 0.52 END::DOUBLE + least(0.12::DOUBLE, len(string_split(phrase, ' ')) * 0.03::DOUBLE) + least(0.14::DOUBLE, shared * 0.02::DOUBLE))), 2) AS weight,
  count(DISTINCT source) AS sources, sum(least(8, shared))::BIGINT AS shared_terms FROM met GROUP BY 1""",
    "capped_phrase_edges": f"""{ADJACENT},
keys AS (SELECT id, domain, document_id || '|' || lpad(ordinal::VARCHAR, 9, '0') AS seq, unnest(list_concat(phrases, terms)) AS phrase FROM nodes),
pl AS (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY seq, id) - 1 AS place, count(*) OVER (PARTITION BY phrase) AS n, row_number() OVER (PARTITION BY phrase, domain ORDER BY seq, id) - 1 AS within, count(*) OVER (PARTITION BY phrase, domain) AS own FROM keys),
small AS (SELECT l.phrase, l.id AS left_id, r.id AS right_id FROM pl l JOIN pl r ON l.phrase = r.phrase AND l.place < r.place AND l.id <> r.id WHERE l.n * (l.n - 1) / 2 <= 96),
big AS (SELECT *, greatest(1, (n - 1) // 48) AS step FROM pl WHERE n * (n - 1) / 2 > 96),
s1 AS (SELECT phrase, place AS i, place + 1 AS j, 0 AS a, place AS b, '' AS c, '' AS d FROM big WHERE place % step = 0 AND place < n - 1 QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY place) <= 48),
doms AS (SELECT DISTINCT phrase, domain, own FROM big),
rounds AS (SELECT phrase, unnest(range(0, least(max(own), 145))) AS r FROM doms GROUP BY 1),
s2 AS (SELECT x.phrase, p.place AS i, q.place AS j, 1 AS a, r AS b, x.domain AS c, y.domain AS d FROM rounds JOIN doms x USING (phrase) JOIN doms y ON y.phrase = x.phrase AND y.domain > x.domain
  JOIN big p ON p.phrase = x.phrase AND p.domain = x.domain AND p.within = r % x.own JOIN big q ON q.phrase = y.phrase AND q.domain = y.domain AND q.within = r % y.own),
s3 AS (SELECT phrase, place AS i, place + gap AS j, 2 AS a, gap AS b, lpad(place::VARCHAR, 9, '0') AS c, '' AS d FROM big, (SELECT unnest(range(2, 21)) AS gap) WHERE place % step = 0 AND place < n - gap),
every_ AS (SELECT * FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3) QUALIFY row_number() OVER (PARTITION BY phrase, least(i, j), greatest(i, j) ORDER BY a, b, c, d) = 1),
taken AS (SELECT phrase, i, j FROM every_ QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY a, b, c, d) <= 96),
both_ AS (SELECT t.phrase, x.id AS left_id, y.id AS right_id FROM taken t JOIN big x ON x.phrase = t.phrase AND x.place = t.i JOIN big y ON y.phrase = t.phrase AND y.place = t.j UNION ALL SELECT * FROM small),
flags AS (SELECT id, domain, {token_set("text")} AS ts, CASE WHEN contains(lower(text), 'requires') THEN 1 WHEN contains(lower(text), 'resolution') THEN 2 ELSE 0 END AS f FROM nodes),
met AS (SELECT p.*, CASE WHEN a.domain <> b.domain THEN 'portal' WHEN a.f = 1 OR b.f = 1 THEN 'depends_on' WHEN a.f = 2 OR b.f = 2 THEN 'supports' ELSE 'related_to' END AS edge_type, len(list_intersect(a.ts, b.ts)) AS shared FROM both_ p JOIN flags a ON a.id = left_id JOIN flags b ON b.id = right_id)
SELECT id, source, target, 'adjacent_to' AS edge_type, round(weight, 4) AS weight, '' AS phrase FROM adjacent
UNION ALL SELECT 'edge:' || substr(sha1(left_id || '::' || right_id || '::' || phrase || '::' || edge_type), 1, 12), left_id, right_id, edge_type,
  round(least(0.92::DOUBLE, CASE edge_type WHEN 'portal' THEN 0.66 WHEN 'depends_on' THEN 0.62 WHEN 'supports' THEN 0.64 ELSE 0.52 END::DOUBLE + least(0.12::DOUBLE, len(string_split(phrase, ' ')) * 0.03::DOUBLE) + least(0.14::DOUBLE, shared * 0.02::DOUBLE)), 4), phrase FROM met""",
    "graph_stats": f"{ADJACENT} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM adjacent) AS edges, 0::BIGINT AS portal_edges, (SELECT count(*) FROM (SELECT source AS id FROM adjacent UNION SELECT target FROM adjacent) WHERE id NOT IN (SELECT id FROM nodes)) AS dangling",
    "neighbors_khop": f"""{ADJACENT},
both_ways AS (SELECT source AS src, target AS dst FROM adjacent UNION SELECT target, source FROM adjacent),
w0 AS (SELECT document_id AS query_id, id AS node_id, 0 AS depth FROM nodes WHERE ordinal = 0),
w1 AS (SELECT * FROM w0 UNION ALL SELECT query_id, dst, 1 FROM w0 JOIN both_ways ON node_id = src),
w2 AS (SELECT * FROM w1 UNION ALL SELECT query_id, dst, 2 FROM w1 JOIN both_ways ON node_id = src),
w3 AS (SELECT * FROM w2 UNION ALL SELECT query_id, dst, 3 FROM w2 JOIN both_ways ON node_id = src),
w AS (SELECT query_id, node_id, min(depth) AS depth FROM w3 GROUP BY 1, 2)
SELECT query_id, count(*) AS nodes, max(depth)::BIGINT AS depth FROM w GROUP BY 1""",
    "sha1_embedding": f"""WITH {CORPUS}, {hashed("corpus", "id", "text", "v")}
SELECT id, count(*) AS buckets, round(sum(v * v), 4) AS norm, round(sum(v * (bucket + 1)), 3) AS moment FROM v WHERE v <> 0 GROUP BY 1""",
    "vector_topk": "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL), s AS (SELECT q.vec_id::VARCHAR AS query_id, v.vec_id::VARCHAR AS node_id, list_dot_product(q.e, v.e) AS score FROM v q, v WHERE q.vec_id % 50 = 0) SELECT query_id, node_id, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, node_id) AS rank FROM s QUALIFY rank <= 5",
    "vector_cells": "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL), s AS (SELECT q.vec_id::VARCHAR AS query_id, v.vec_id::VARCHAR AS node_id, list_dot_product(q.e, v.e) AS score FROM v q, v WHERE q.vec_id % 50 = 0) SELECT query_id, node_id, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, node_id) AS rank FROM s QUALIFY rank <= 5",
    "label_relations": f"""WITH {REPLIES},
n AS (SELECT doc_id, 'llm-concept:' || substr(sha1(doc_id || '::' || l), 1, 12) AS id, lower(l) AS low, l FROM (SELECT DISTINCT doc_id, unnest([w[1], w[2], w[3]]) AS l FROM good)),
b AS (SELECT doc_id, low, arg_max(id, l) AS id FROM n GROUP BY 1, 2),
r AS (SELECT doc_id, unnest([{{'a': lower(w[1]), 'b': lower(w[2]), 't': 'supports', 'c': 0.5::DOUBLE}}, {{'a': lower(w[2]), 'b': lower(w[3]), 't': 'depends_on', 'c': 1.0::DOUBLE}}, {{'a': lower(w[3]), 'b': lower(w[1]), 't': 'related_to', 'c': 0.25::DOUBLE}}, {{'a': lower(w[1]), 'b': 'nowhere', 't': 'portal', 'c': 0.9::DOUBLE}}]) AS r FROM good),
e AS (SELECT r.doc_id, x.id AS source, y.id AS target, r.r.t AS edge_type, least(0.94::DOUBLE, 0.52::DOUBLE + r.r.c * 0.38::DOUBLE) AS weight FROM r JOIN b x ON x.doc_id = r.doc_id AND x.low = r.r.a JOIN b y ON y.doc_id = r.doc_id AND y.low = r.r.b WHERE x.id <> y.id)
SELECT 'llm-edge:' || substr(sha1(doc_id || '::' || source || '::' || target || '::' || edge_type), 1, 12) AS id, source, target, edge_type, round(max(weight), 4) AS weight, 'doc:' || doc_id AS document_id FROM e GROUP BY ALL""",
    "reply_faults": f"WITH {REPLIES} SELECT CASE WHEN doc_id % 11 = 4 THEN 'the reply is not the JSON that was asked for' WHEN doc_id % 7 = 3 THEN 'a concept breaks its limits' ELSE 'none' END AS fault, count(*) AS replies FROM said GROUP BY 1",
    "document_changes": "SELECT 'doc:' || doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'added' WHEN doc_id % 11 = 0 THEN 'deleted' ELSE 'changed' END AS change FROM documents WHERE NOT (doc_id % 7 = 0 AND doc_id % 11 = 0) AND (doc_id % 7 = 0 OR doc_id % 11 = 0 OR doc_id % 5 = 0)",
    "torus_scale": f"WITH {POINTS} SELECT node_id, round(theta, 4) AS theta, round(phi, 4) AS phi FROM points",
    "torus_distance": f"WITH {POINTS} SELECT q.node_id AS query_id, round(avg({WRAPPED}), 4) AS wrapped, round(avg({FLAT}), 4) AS flat, round(max({WRAPPED}), 4) AS farthest FROM points q, points p WHERE q.vec_id % 50 = 0 GROUP BY 1",
    "shard_assign": f"WITH {POINTS} SELECT node_id, {CELL.format('phi')} AS shard_row, {CELL.format('theta')} AS shard_column, 'shard:' || {CELL.format('phi')} || ':' || {CELL.format('theta')} AS shard_id FROM points",
    "shard_fanout": f"WITH {POINTS} SELECT label, count(DISTINCT {CELL.format('phi')} * 4 + {CELL.format('theta')}) AS fanout, count(*) AS nodes FROM points JOIN embeddings USING (vec_id) GROUP BY 1",
    "layout_probe": f"""WITH {POINTS},
s AS (SELECT 'torus' AS layout, 'q' || q.node_id AS query_id, p.node_id, 0.0::DOUBLE - {WRAPPED} AS score FROM points q, points p WHERE q.vec_id % 50 = 0
  UNION ALL SELECT 'euclidean', 'q' || q.node_id, p.node_id, 0.0::DOUBLE - {FLAT} FROM points q, points p WHERE q.vec_id % 50 = 0
  UNION ALL SELECT 'random', 'q' || q.node_id, p.node_id, ('0x' || substr(sha1('q' || q.node_id || ':' || p.node_id), 1, 8))::BIGINT / 4294967295.0::DOUBLE FROM points q, points p WHERE q.vec_id % 50 = 0)
SELECT layout, query_id, node_id, round(score, 4) AS score, row_number() OVER (PARTITION BY layout, query_id ORDER BY round(score, 9) DESC, node_id) AS rank FROM s QUALIFY rank <= 5""",
    "bm25_topk": f"WITH {ITEMS},\n{bm25()} SELECT query_id, node_id, round(score, 4) AS score, rank FROM {top('lexical', 5)}",
    "hybrid_fusion": f"""WITH {ITEMS},
{bm25()},
{DENSE},
f AS (SELECT d.query_id, d.node_id, d.score AS d, coalesce(l.score, 0) AS l FROM dense d LEFT JOIN lexical l ON d.query_id = l.query_id AND d.node_id = l.node_id),
g AS (SELECT *, min(d) OVER w AS d0, max(d) OVER w AS d1, min(l) OVER w AS l0, max(l) OVER w AS l1 FROM f WINDOW w AS (PARTITION BY query_id)),
h AS (SELECT query_id, node_id, 0.58::DOUBLE * CASE WHEN d1 = d0 THEN 1 ELSE (d - d0) / (d1 - d0) END + 0.42::DOUBLE * CASE WHEN l1 = l0 THEN 1 ELSE (l - l0) / (l1 - l0) END AS score FROM g)
SELECT query_id, node_id, round(score, 4) AS score, rank FROM {top("h", 5)}""",
    "community_topk": f"""WITH {ITEMS},
{bm25("domain")},
dw AS (SELECT DISTINCT domain, unnest(ts) AS term FROM toks),
dh AS (SELECT query_id, domain, count(*) AS shared FROM qt JOIN dw USING (term) GROUP BY 1, 2),
ds AS (SELECT domain, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM items GROUP BY 1),
dc AS (SELECT query_id, domain, domain AS node_id, shared + share AS score FROM dh JOIN ds USING (domain)),
picked AS (SELECT query_id, domain FROM {top("dc", 2)}),
inside AS (SELECT * FROM lexical JOIN picked USING (query_id, domain))
SELECT query_id, domain, node_id, round(score, 4) AS score, rank FROM {top("inside", 5)}""",
    "graph_rerank": f"""WITH {ITEMS},
{bm25()},
{DENSE},
{CHAIN},
d12 AS (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM {nearest(12)}),
dn AS (SELECT query_id, node_id, rank, CASE WHEN hi = lo THEN 1 ELSE (score - lo) / (hi - lo) END AS dense FROM d12),
lq AS (SELECT query_id, CASE WHEN count(*) = (SELECT count(*) FROM items) THEN min(score) ELSE 0 END AS lo, max(score) AS hi FROM lexical GROUP BY 1),
ln_ AS (SELECT query_id, node_id, CASE WHEN hi = lo THEN 1 ELSE (score - lo) / (hi - lo) END AS lexical FROM lexical JOIN lq USING (query_id)),
seeds AS (SELECT query_id, node_id FROM dn WHERE rank <= 8 UNION SELECT query_id, node_id FROM {top("lexical", 8)} WHERE score > 0),
around AS (SELECT s.query_id, s.node_id AS src, a.dst, a.edge_type, a.weight, a.weight + CASE WHEN a.edge_type = 'portal' THEN 0.20 ELSE 0.05 END::DOUBLE + len(list_intersect(q.terms, list_distinct(t.ts))) AS worth FROM seeds s JOIN adj a ON s.node_id = a.src JOIN toks t ON t.node_id = a.dst JOIN asked q USING (query_id)),
near AS (SELECT query_id, dst AS node_id, weight * 0.10::DOUBLE + CASE WHEN edge_type = 'portal' THEN 0.18 ELSE 0.10 END::DOUBLE AS bonus FROM around QUALIFY row_number() OVER (PARTITION BY query_id, src ORDER BY round(worth, 9) DESC, dst, edge_type) <= 4),
cand AS (SELECT query_id, node_id, max(bonus) AS bonus FROM (SELECT query_id, node_id, 0.0::DOUBLE AS bonus FROM seeds UNION ALL SELECT * FROM near) GROUP BY 1, 2),
full_ AS (SELECT c.query_id, c.node_id, 0.36::DOUBLE * coalesce(dense, 0) + 0.34::DOUBLE * coalesce(lexical, 0) + 0.20::DOUBLE * len(list_intersect(q.terms, list_distinct(t.ts))) / greatest(1, len(q.terms)) + 0.10::DOUBLE * len(list_intersect(q.terms, {token_set("i.evidence")})) / greatest(1, len(q.terms)) + bonus AS score
  FROM cand c LEFT JOIN dn USING (query_id, node_id) LEFT JOIN ln_ USING (query_id, node_id) JOIN asked q USING (query_id) JOIN toks t ON t.node_id = c.node_id JOIN items i ON i.node_id = c.node_id)
SELECT query_id, node_id, round(score, 4) AS score, rank FROM {top("full_", 5)}""",
    "edge_scores": f"""WITH {ITEMS},
{DENSE},
{CHAIN},
f AS (SELECT query_id, node_id, score, node_id AS seed_id FROM {nearest(5)})
SELECT query_id, from_id, to_id, len(matched)::BIGINT AS matched, round(s, 4) AS score, pruned FROM {scored_edges("f")}""",
    "edge_components": f"""WITH {ITEMS},
{DENSE},
{CHAIN},
f AS (SELECT query_id, node_id, score, node_id AS seed_id FROM {nearest(5)})
SELECT query_id, from_id, to_id, round(s, 4) AS score, round(s, 4) AS total, 7::BIGINT AS n_components, round(len(matched)::DOUBLE / greatest(1, n_terms) * 0.48::DOUBLE, 4) AS lexical, round(near_c * 0.16::DOUBLE, 4) AS near_current, 'arrival' AS first_component
FROM {scored_edges("f")}""",
    "traverse_levels": f"""WITH {ITEMS},
{DENSE},
{CHAIN},
n5 AS (SELECT * FROM {nearest(5)}),
f0 AS (SELECT n.query_id, n.node_id, n.score, z.node_id AS seed_id FROM n5 n JOIN n5 z ON n.query_id = z.query_id AND z.rank = 1), v0 AS (SELECT query_id, node_id FROM f0),
{_level(0)},
{_level(1)}
SELECT query_id, 1::BIGINT AS depth, from_id, to_id, round(s, 4) AS score FROM s0 UNION ALL SELECT query_id, 2, from_id, to_id, round(s, 4) FROM s1""",
    "agentic_start": f"""WITH {ITEMS},
{bm25()},
{DENSE},
b AS (SELECT query_id, node_id, rank AS pos FROM {nearest(2)} UNION ALL SELECT query_id, node_id, rank + 2 FROM {top("lexical", 2)} WHERE score > 0),
o AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY min(pos)) AS rank FROM b GROUP BY 1, 2)
SELECT query_id, node_id, round(1 - 0.05::DOUBLE * (rank - 1), 4) AS score, rank FROM o""",
    "evidence_rank": f"{FOUND} SELECT query_id, uri, span_start::BIGINT AS span_start, support::BIGINT AS support, rank FROM ranked WHERE rank <= 6",
    "support_sentences": f"{FOUND},\n{SAID} SELECT query_id, md5(sentence) AS sentence_md5, support::BIGINT AS support, rank FROM said",
    "answer_rows": f"""{FOUND},
{SAID},
{TOLD}
SELECT query_id, answer, round(CASE WHEN withheld THEN 0 ELSE least(0.95::DOUBLE, 0.32::DOUBLE + spans * 0.10::DOUBLE + least(5, support) * 0.04::DOUBLE) END, 4) AS confidence, CASE WHEN withheld THEN 0 ELSE support END::BIGINT AS lexical_support, CASE WHEN withheld THEN 0 ELSE sources END::BIGINT AS sources, withheld,
  CASE WHEN withheld THEN 1 ELSE 1 + {" + ".join(f"list_has_any(list_concat(terms, bts), {list(words)!r})::INT" for words, _ in ACTIONS)} END::BIGINT AS n_actions,
  ((withheld OR sources < 2)::INT + (withheld OR support < 3)::INT + (withheld OR spans IS NULL)::INT)::BIGINT AS n_missing FROM r""",
    "answer_claims": f"""{FOUND},
{SAID},
{TOLD},
cl AS (SELECT query_id, terms, unnest(range(0, len(l)))::BIGINT AS seq, unnest(l) AS claim FROM (SELECT query_id, terms, {sentences("answer")} AS l FROM r WHERE NOT withheld)),
ct AS (SELECT *, list_filter({token_set("claim")}, lambda w: NOT list_contains(terms, w)) AS own FROM cl)
SELECT c.query_id, c.seq, count(*) FILTER (WHERE CASE WHEN len(c.own) = 0 THEN r.rank = 1 ELSE list_has_any(c.own, {token_set("r.text")}) END) > 0 AS supported, count(*) FILTER (WHERE CASE WHEN len(c.own) = 0 THEN r.rank = 1 ELSE list_has_any(c.own, {token_set("r.text")}) END) AS support_count
FROM ct c LEFT JOIN (SELECT * FROM ranked WHERE rank <= 6) r USING (query_id) GROUP BY 1, 2""",
    "source_health": f"""WITH p AS (SELECT sha256({normalized("coalesce(text, '')")}) AS sha, trim(coalesce(text, '')) = '' AS e, source, CASE WHEN length(trim(text)) < 20 THEN 'short text in ' || lang END AS w FROM documents), g AS (SELECT count(*) AS n FROM p GROUP BY sha), k AS (SELECT source, source || '=' || count(*) AS t FROM p GROUP BY source),
t AS (SELECT count(*) AS documents, count(*) FILTER (WHERE e) AS empty_documents, count(DISTINCT source) AS source_types, (SELECT count(*) FILTER (WHERE n > 1) FROM g) AS duplicate_documents, count(DISTINCT w) AS warnings, coalesce((SELECT string_agg(w, '|' ORDER BY w) FROM (SELECT DISTINCT w FROM p WHERE w IS NOT NULL)), '') AS warning_texts, (SELECT string_agg(t, '|' ORDER BY source) FROM k) AS by_type FROM p)
SELECT *, round(greatest(0, 1 - (least(0.35::DOUBLE, warnings * 0.05::DOUBLE) + least(0.25::DOUBLE, empty_documents * 0.08::DOUBLE) + least(0.20::DOUBLE, duplicate_documents * 0.04::DOUBLE) + 0.03::DOUBLE)), 4) AS quality_score FROM t""",
    "node_health": f"""{CHUNKS}, h AS (SELECT id AS document_id, sha256({normalized("text")}) AS sha FROM corpus), c AS (SELECT k.document_id, k.text, sha FROM chunks k JOIN h USING (document_id)),
t AS (SELECT count(DISTINCT document_id) AS documents, count(*) AS chunks, count(DISTINCT document_id) FILTER (WHERE trim(text) = '') AS empty_documents, (SELECT count(*) FROM (SELECT sha FROM c GROUP BY sha HAVING count(DISTINCT document_id) > 1)) AS duplicate_documents, count(DISTINCT CASE WHEN length(text) < 20 THEN 1 END) AS warnings FROM c)
SELECT *, round(greatest(0, 1 - (least(0.35::DOUBLE, warnings * 0.05::DOUBLE) + least(0.25::DOUBLE, empty_documents * 0.08::DOUBLE) + least(0.20::DOUBLE, duplicate_documents * 0.04::DOUBLE))), 4) AS quality_score FROM t""",
    "bm25_eval_rows": f"""{FOUND},
{SAID},
{TOLD},
ex AS (SELECT q.query_id, {terms("q.ts", 3)} AS expected FROM asked q JOIN benchmark b ON b.item_id::VARCHAR = q.query_id WHERE b.text <> ''),
held AS (SELECT b.item_id::VARCHAR AS query_id, list(DISTINCT 'docs://' || coalesce(d.source, 'unknown') || '/' || d.doc_id) AS sources FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> '' GROUP BY 1),
got AS (SELECT query_id, string_agg(text, ' ' ORDER BY rank) AS body, list(DISTINCT uri) AS uris FROM ranked WHERE rank <= 6 GROUP BY 1),
m AS (SELECT r.query_id, r.answer, r.withheld, r.terms, ex.expected, coalesce(h.sources, []) AS sources, coalesce(g.body, '') AS body, coalesce(g.uris, []) AS uris, list_filter({token_set("r.answer")}, lambda w: NOT list_contains(r.terms, w)) AS own FROM r JOIN ex USING (query_id) LEFT JOIN held h USING (query_id) LEFT JOIN got g USING (query_id)),
e AS (SELECT query_id AS question_id, CASE WHEN len(sources) > 1 THEN 'boundary_crossing' ELSE 'plain' END AS suite, CASE WHEN len(expected) = 0 THEN 1 ELSE len(list_filter(expected, lambda t: contains(lower(body), t)))::DOUBLE / len(expected) END AS term_recall,
  CASE WHEN len(sources) = 0 THEN CASE WHEN len(uris) = 0 THEN 1 ELSE 0 END ELSE len(list_intersect(sources, uris))::DOUBLE / len(sources) END::DOUBLE AS source_recall, 1.0::DOUBLE AS path_recall, 1.0::DOUBLE AS path_precision,
  CASE WHEN withheld OR len(uris) = 0 THEN 0 WHEN len(own) = 0 THEN 1 ELSE len(list_intersect(own, {token_set("body")}))::DOUBLE / len(own) END::DOUBLE AS faithfulness FROM m)
SELECT question_id, suite, round(term_recall, 4) AS term_recall, round(source_recall, 4) AS source_recall, path_recall, path_precision, round(faithfulness, 4) AS faithfulness, term_recall >= 0.5 AND source_recall >= 0.5 AND faithfulness >= 0.5 AS passed FROM e""",
    "eval_rows": f"WITH {RUNS} SELECT question_id, strategy, round(term_recall, 4) AS term_recall, round(source_recall, 4) AS source_recall, round(path_recall, 4) AS path_recall, round(path_precision, 4) AS path_precision, round(faithfulness, 4) AS faithfulness, passed FROM rows",
    "strategy_summary": f"WITH {RUNS} SELECT strategy, rows, round(pass_rate, 4) AS pass_rate, round(term_recall, 4) AS term_recall, round(source_recall, 4) AS source_recall, round(path_recall, 4) AS path_recall, round(path_precision, 4) AS path_precision, round(faithfulness, 4) AS faithfulness, round(p50, 4) AS p50_latency_ms, round(p95, 4) AS p95_latency_ms, round(greatest(0, pass_rate - 1.96::DOUBLE * sqrt(pass_rate * (1 - pass_rate) / rows)), 4) AS pass_ci_low, round(least(1, pass_rate + 1.96::DOUBLE * sqrt(pass_rate * (1 - pass_rate) / rows)), 4) AS pass_ci_high, round(nodes, 4) AS mean_nodes_visited, round(portals, 4) AS mean_portal_hops, round(nodes, 4) AS mean_shard_fanout, round(crossings, 4) AS mean_shard_crossings, round(warned, 4) AS warning_rate, 0.0::DOUBLE AS skipped_rate, round(external, 4) AS external_rate FROM summary",
    "failure_taxonomy": f"""WITH {RUNS},
l AS (SELECT warned, list_filter([CASE WHEN term_recall <= 0 THEN 'missing_expected_terms' END, CASE WHEN source_recall <= 0 THEN 'missing_expected_sources' END, CASE WHEN path_recall <= 0 THEN 'missing_expected_path' END, CASE WHEN path_precision < 0.5 AND len(edge_types) > 0 THEN 'low_path_precision' END,
  CASE WHEN faithfulness < 0.5 THEN 'low_faithfulness' END, CASE WHEN warned THEN 'budget_limited' END, CASE WHEN lines > 6 THEN 'high_shard_fanout' END], lambda x: x IS NOT NULL) AS labels FROM rows WHERE NOT passed OR warned)
SELECT label, count(*) AS rows FROM (SELECT unnest(CASE WHEN len(labels) = 0 AND warned THEN ['warning_only'] ELSE labels END) AS label FROM l) GROUP BY 1""",
    "thesis_check": f"WITH {RUNS}, b AS (SELECT * FROM summary WHERE strategy <> '1-URGENT' ORDER BY pass_rate DESC, source_recall DESC, path_recall DESC, p95 LIMIT 1) SELECT b.strategy AS baseline, round(s.pass_rate - b.pass_rate, 4) AS pass_rate_delta, round(s.source_recall - b.source_recall, 4) AS source_recall_delta, round(s.path_recall - b.path_recall, 4) AS path_recall_delta, round(s.faithfulness - b.faithfulness, 4) AS faithfulness_delta FROM summary s, b WHERE s.strategy = '1-URGENT'",
    "suite_breakdown": f"WITH {RUNS} SELECT CASE WHEN lines > 3 THEN 'boundary_crossing' ELSE 'plain' END AS suite, strategy, count(*) AS rows, round(avg(passed::INT), 4) AS pass_rate, round(avg(faithfulness), 4) AS faithfulness, round(quantile_cont(latency_ms, 0.95), 4) AS p95_latency_ms FROM rows GROUP BY 1, 2",
    "boundary_slice": f"WITH {RUNS} SELECT strategy, count(*) AS rows, round(avg(passed::INT), 4) AS pass_rate, round(avg(path_precision), 4) AS path_precision, round(avg(lines % 3), 4) AS mean_portal_hops, round(avg(lines), 4) AS mean_shard_fanout, round(avg(len(flags)), 4) AS mean_shard_crossings FROM rows WHERE lines > 3 GROUP BY 1",
    "cost_notes": f"WITH {RUNS} SELECT (SELECT strategy FROM summary ORDER BY nodes DESC, strategy LIMIT 1) AS widest, (SELECT round(max(nodes), 4) FROM summary) AS fanout, (SELECT strategy FROM summary ORDER BY p95 DESC, strategy LIMIT 1) AS slowest, (SELECT round(max(p95), 4) FROM summary) AS p95, (SELECT strategy FROM summary ORDER BY warned DESC, strategy LIMIT 1) AS most_warned, (SELECT round(max(warned), 4) FROM summary) AS warned",
    "status_counts": f"WITH {REVIEWS} SELECT status, count(*) AS rows FROM reviews GROUP BY 1",
    "hardest_misses": f"WITH {RUNS} SELECT question_id, strategy, row_number() OVER (ORDER BY round(term_recall + source_recall + path_recall, 9), strategy, question_id) AS place FROM rows WHERE NOT passed QUALIFY place <= 8",
    "audit_override": f"WITH {REVIEWS} SELECT d.doc_id AS id, coalesce(r.status, 'open') AS audit_status, CASE WHEN signed THEN 'reviewed' ELSE 'asked' END AS question, CASE WHEN signed THEN r.toxic::VARCHAR ELSE d.lang END AS expected_terms, coalesce(signed, false) AS expect_answer FROM documents d LEFT JOIN reviews r USING (doc_id)",
    "golden_questions": "WITH t AS (SELECT (SELECT count(*) FROM nation) AS ns, (SELECT count(*) FROM region) AS nt) SELECT c_custkey AS i, n_name AS scenario, replace(r_name || ': how does {name} recover?', '{name}', n_name) AS question, (2 + c_custkey % 2)::BIGINT AS hop_target FROM customer, t JOIN nation ON n_nationkey = c_custkey % ns JOIN region ON r_regionkey = (c_custkey // ns) % nt",
    "uri_matches": """WITH p AS (SELECT page_id, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host, regexp_replace(regexp_replace(url, '(?s)#.*$', ''), '/+$', '') AS base FROM pages),
e AS (SELECT page_id, base FROM p UNION ALL SELECT page_id, 'https://' || host FROM p),
s AS (SELECT DISTINCT 'https://' || host AS a, base AS b FROM p), s2 AS (SELECT a, b FROM s UNION SELECT b, a FROM s),
g AS (SELECT page_id, base FROM p UNION SELECT page_id, s2.b FROM p JOIN s2 ON p.base = s2.a)
SELECT page_id AS question_id, count(*) AS source_hits FROM e WHERE EXISTS (SELECT 1 FROM g WHERE g.page_id = e.page_id AND g.base = e.base) GROUP BY 1""",
}
