"""The same results in the SQL of a second engine (DuckDB dialect), by query name.

Recursive common table expressions stand for folds: packing of paragraphs, places of sentences, merges of marks.
"""

from __future__ import annotations

from spanloom.functions.text import WS
from spanloom.operators.rewrite import ABSTRACT, SECTION, STOP_WORDS

CORPUS = """c AS (SELECT coalesce(nullif(doc_id, ''), nullif(qid, '')) AS doc_id, any_value(coalesce(nullif(default_text, ''), nullif(query, ''), '')) AS text
  FROM corpus WHERE coalesce(nullif(doc_id, ''), nullif(qid, '')) IS NOT NULL GROUP BY 1)"""
ASKED = """q AS (SELECT coalesce(nullif(qid, ''), nullif(query_id, '')) AS qid, any_value(coalesce(nullif(query, ''), nullif(default_text, ''), '')) AS text
  FROM queries WHERE coalesce(nullif(qid, ''), nullif(query_id, '')) IS NOT NULL GROUP BY 1)"""
RUN = "r AS (SELECT qid, doc_id, max(score) AS score FROM run GROUP BY ALL)"
RANKED = "rr AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM r)"
QRELS = "j AS (SELECT qid, doc_id, max(rel) AS rel FROM qrels GROUP BY ALL)"
DOCS = "c AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"


def toks(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+\\z', '')"


def grams(x: str) -> str:
    return f"list_distinct(list_transform(range(1, length({x}) - 1), lambda i: substr(lower({x}), i, 3)))"


INDEX = f"""
  l AS (SELECT doc_id, len({toks('text')}) AS dl FROM c),
  st AS (SELECT count(*) AS n, coalesce(avg(dl), 1) AS avgdl FROM l),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({toks('text')}) AS term FROM c) GROUP BY ALL),
  t AS (SELECT term, df, ln(((SELECT n FROM st) - df + 0.5e0) / (df + 0.5e0) + 1e0) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY term)),
  w AS (SELECT term, doc_id, idf * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / (SELECT avgdl FROM st))) AS w FROM tf JOIN l USING (doc_id) JOIN t USING (term))"""


def pack(min_chars: int, max_chars: int, out: str = "packed", tail: str = "") -> str:
    """CTEs that end in ``out`` (qid, text, chunks)."""
    return f"""
  paras{tail} AS (SELECT qid, text, list_filter(list_transform(string_split_regex(text, '\\n{WS}*\\n'), lambda p: {strip('p')}), lambda p: p <> '') AS ps FROM q),
  steps{tail} AS (SELECT qid, 0 AS i, []::VARCHAR[] AS chunks, '' AS buf FROM paras{tail} UNION ALL
    SELECT qid, i + 1, CASE WHEN cl THEN list_append(chunks, buf) ELSE chunks END, CASE WHEN cl OR buf = '' THEN p ELSE buf || chr(10) || chr(10) || p END
    FROM (SELECT s.*, ps[i + 1] AS p, length(buf) + length(ps[i + 1]) > {max_chars} AND length(buf) > {min_chars} AS cl FROM steps{tail} s JOIN paras{tail} USING (qid) WHERE i < len(ps))),
  fin{tail} AS (SELECT s.qid, text, CASE WHEN length(buf) > {min_chars} THEN list_append(chunks, buf) ELSE chunks END AS ch FROM steps{tail} s JOIN paras{tail} USING (qid) WHERE i = len(ps)),
  {out} AS (SELECT qid, text, CASE WHEN len(ch) > 0 THEN ch ELSE [substr(text, 1, {max_chars})] END AS chunks FROM fin{tail})"""


WINDOWS = """packed AS (SELECT qid, text, CASE WHEN length(text) <= 2000 THEN [text]
  ELSE list_transform(range(0, length(text) - 1000, 1000), lambda i: substr(text, (i + 1)::BIGINT, 2000))[1:20] END AS chunks FROM q)"""
ALL_WINDOWS = WINDOWS.replace("[1:20]", "")
CHUNK_ROWS = """SELECT qid, n_chunks, chunk_no, length(chunk) AS n, md5(chunk) AS digest
  FROM (SELECT qid, len(chunks)::BIGINT AS n_chunks, unnest(range(len(chunks)))::BIGINT AS chunk_no, unnest(chunks) AS chunk FROM {src})"""


def search(terms: str, limit: str, keys: str = "qid", qtf: str = "1", top: str = "rank <= 10") -> str:
    """CTEs from asked(keys, text) to found(keys, doc_id, score, rank)."""
    return f"""
  qt0 AS (SELECT {keys}, term, min(pos) AS pos, count(*) AS qtf FROM (SELECT {keys}, unnest({toks('text')}) AS term, unnest(range(len({toks('text')}))) AS pos FROM asked) GROUP BY ALL),
  qt AS (SELECT * FROM (SELECT {keys}, term, df, {qtf} AS qtf, row_number() OVER (PARTITION BY {keys} ORDER BY df, pos) AS term_rank FROM qt0 JOIN ({terms}) USING (term)) WHERE {limit}),
  sc AS (SELECT {keys}, doc_id, round(sum(floor(w / 1e-12 + 0.5e0)::BIGINT * qtf)::DOUBLE * 1e-12, 6) AS score FROM qt JOIN w USING (term) GROUP BY ALL),
  found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE {top})"""


def segmented(packed: str, max_df: int | None, terms: tuple[int, int], lists: tuple[int, int], vote: str, at_most: int = 0, last: int = 10) -> str:
    kept = "SELECT * FROM t" + (f" WHERE df <= {max_df}" if max_df else "")
    cut = f"chunks[1:{at_most}]" if at_most else "chunks"
    return f"""WITH RECURSIVE {CORPUS}, {ASKED}, {INDEX}, {packed},
  parts AS (SELECT qid, CASE WHEN len({cut}) > 1 THEN {cut} ELSE [text] END AS p FROM packed),
  asked AS (SELECT qid, len(p) AS n_chunks, unnest(range(len(p))) AS chunk_no, unnest(p) AS text FROM parts),
  {search(kept, f'term_rank <= CASE WHEN n_chunks > 1 THEN {terms[1]} ELSE {terms[0]} END', 'qid, n_chunks, chunk_no', top=f'rank <= CASE WHEN n_chunks > 1 THEN {lists[1]} ELSE {lists[0]} END')},
  votes AS ({vote}),
  final AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM votes)
  SELECT * FROM final WHERE rank <= {last}"""


COVERAGE = """SELECT qid, doc_id, round((s * (1 + m / n_chunks))::DECIMAL(24, 9), 6)::DOUBLE AS score FROM
  (SELECT qid, n_chunks, doc_id, sum(score::DECIMAL(24, 9))::DOUBLE AS s, count(DISTINCT chunk_no)::DOUBLE AS m FROM found GROUP BY ALL)"""
RRF = "SELECT qid, doc_id, round(sum((1e0 / (60 + rank))::DECIMAL(24, 9))::DOUBLE, 9) AS score FROM found GROUP BY ALL"
BEST = "SELECT qid, doc_id, max(score) AS score FROM found GROUP BY ALL"
BEST_RR = "SELECT qid, doc_id, round(max(1e0 / (60 + rank)), 9) AS score FROM found GROUP BY ALL"

KS = "ks AS (SELECT unnest([1, 3, 5, 10, 20])::INT AS k)"
NDCG = """dcg AS (SELECT qid, k, sum((pow(2, rel) - 1) / log2(rank + 1)) AS dcg FROM rr JOIN j USING (qid, doc_id), ks WHERE rank <= k GROUP BY ALL),
  best AS (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) AS nth FROM j),
  ideal AS (SELECT qid, k, sum(CASE WHEN nth <= k THEN (pow(2, rel) - 1) / log2(nth + 1) ELSE 0 END) AS idcg FROM best, ks GROUP BY ALL),
  ndcg AS (SELECT k, round(avg((CASE WHEN idcg > 0 THEN coalesce(dcg, 0) / idcg ELSE 0 END)::DECIMAL(20, 12)), 6) AS ndcg FROM ideal LEFT JOIN dcg USING (qid, k) GROUP BY k)"""
RECALL = """good AS (SELECT * FROM j WHERE rel > 0), total AS (SELECT qid, count(*) AS n FROM good GROUP BY qid),
  hits AS (SELECT qid, k, count(*) AS h FROM rr JOIN good USING (qid, doc_id), ks WHERE rank <= k GROUP BY ALL),
  recall AS (SELECT k, round(avg((coalesce(h, 0) / n)::DECIMAL(20, 12)), 6) AS recall FROM (SELECT * FROM total, ks) LEFT JOIN hits USING (qid, k) GROUP BY k)"""
MRR = """firsts AS (SELECT qid, min(rank) AS f FROM rr JOIN (SELECT * FROM j WHERE rel > 0) USING (qid, doc_id) GROUP BY qid),
  mrr AS (SELECT round(avg(coalesce(1e0 / f, 0)::DECIMAL(20, 12)), 6) AS mrr FROM (SELECT DISTINCT qid FROM j) LEFT JOIN firsts USING (qid))"""
MAP = """good2 AS (SELECT * FROM j WHERE rel > 0),
  ap AS (SELECT qid, sum((i / rank)::DECIMAL(20, 12))::DOUBLE AS s FROM (SELECT qid, rank, row_number() OVER (PARTITION BY qid ORDER BY rank) AS i FROM rr JOIN good2 USING (qid, doc_id)) GROUP BY qid),
  map AS (SELECT round(avg((coalesce(s, 0) / n)::DECIMAL(20, 12)), 6) AS map FROM (SELECT qid, count(*) AS n FROM good2 GROUP BY qid) LEFT JOIN ap USING (qid))"""


def tagged(tag: str, name: str) -> str:
    """One select of the metric table of a run's rows with this tag."""
    run = f"r AS (SELECT qid, doc_id, max(score) AS score FROM run WHERE tag = '{tag}' GROUP BY ALL)"
    return f"""{name} AS (WITH {run}, {RANKED}, {QRELS}, {KS}, {NDCG}, {RECALL}, {MRR}, {MAP}
    SELECT 'ndcg' AS metric, k, ndcg AS value FROM ndcg UNION ALL SELECT 'recall', k, recall FROM recall UNION ALL SELECT 'mrr', 0, mrr FROM mrr UNION ALL SELECT 'map', 0, map FROM map)"""


def reported(found: str, name: str) -> str:
    """One select of the metric table of the rows (qid, doc_id, score) that another query finds."""
    return f"""{name} AS (WITH r AS (SELECT qid, doc_id, score FROM ({found})), {RANKED}, {QRELS}, {KS}, {NDCG}, {RECALL}, {MRR}, {MAP}
    SELECT 'ndcg' AS metric, k, ndcg AS value FROM ndcg UNION ALL SELECT 'recall', k, recall FROM recall UNION ALL SELECT 'mrr', 0, mrr FROM mrr UNION ALL SELECT 'map', 0, map FROM map)"""


def single(run: str, both: bool) -> str:
    truth = "truth AS (SELECT qid, max(doc_id) AS doc_id FROM j WHERE rel > 0 GROUP BY qid" + (" HAVING qid IN (SELECT qid FROM r))" if both else ")")
    mean = lambda x: f"round(avg(({x})::DECIMAL(20, 12)), 6)"
    return f"""WITH {run}, {RANKED}, {QRELS}, {truth} SELECT count(*) AS n_queries,
  {mean('CASE WHEN rank <= 10 THEN 1 ELSE 0 END')} AS recall_10, {mean('CASE WHEN rank <= 100 THEN 1 ELSE 0 END')} AS recall_100,
  {mean('CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END')} AS ndcg_10, {mean('CASE WHEN rank <= 10 THEN 1 / rank ELSE 0 END')} AS mrr_10
  FROM truth LEFT JOIN rr USING (qid, doc_id)"""


def encoded(rows: str, out: str, key: str) -> str:
    """CTE ``out`` (key, v): the hashed bag of words of ``rows`` (key, text), of length 1; word counts over 256 places."""
    return f"""{out}_w AS (SELECT {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT % 256 AS p FROM (SELECT {key}, unnest({toks('text')}) AS w FROM ({rows}))),
  {out}_c AS (SELECT {key}, p, count(*) AS n FROM {out}_w GROUP BY ALL), {out}_n AS (SELECT {key}, sqrt(sum(n * n)::DOUBLE) AS norm FROM {out}_c GROUP BY ALL),
  {out} AS (SELECT {key}, p, n / norm AS x FROM {out}_c JOIN {out}_n USING ({key}))"""


TEXT_VECTORS = f"""{encoded("SELECT doc_id AS qid, 'query: ' || text AS text FROM c WHERE doc_id % 50 = 0", 'eq', 'qid')},
  {encoded("SELECT doc_id, 'passage: ' || text AS text FROM c", 'ed', 'doc_id')},
  met AS (SELECT qid, doc_id, sum(eq.x * ed.x) AS s FROM eq JOIN ed USING (p) WHERE qid <> doc_id GROUP BY ALL),
  sims AS (SELECT a.doc_id AS qid, b.doc_id, round(coalesce(s, 0), 6) AS score FROM c a JOIN c b ON a.doc_id % 50 = 0 AND a.doc_id <> b.doc_id LEFT JOIN met ON met.qid = a.doc_id AND met.doc_id = b.doc_id)"""


VECTORS = """qv AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 50 = 0),
  sims AS (SELECT qid, vec_id AS doc_id, label AS grp, round(list_dot_product(a, embedding::DOUBLE[]), 6) AS score FROM qv, embeddings WHERE vec_id <> qid)"""


def top(src: str, k: int) -> str:
    return f"SELECT qid, doc_id, score, rank FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM {src}) WHERE rank <= {k}"


def spans(marked: str) -> str:
    """Sentence spans: ``marked`` puts chr(1) where a break is; parts are then looked up one after the other."""
    return f"""WITH RECURSIVE {CORPUS},
  cut AS (SELECT doc_id, text, list_filter(list_transform(string_split({marked}, chr(1)), lambda p: {strip('p')}), lambda p: p <> '') AS ps FROM c),
  walk AS (SELECT doc_id, 0 AS i, 0::BIGINT AS s, 0::BIGINT AS e, 0::BIGINT AS pos FROM cut UNION ALL
    SELECT doc_id, i + 1, pos + greatest(f, 1) - 1, pos + greatest(f, 1) - 1 + length(p), pos + greatest(f, 1) - 1 + length(p)
    FROM (SELECT w.*, ps[i + 1] AS p, instr(substr(text, pos + 1), ps[i + 1]) AS f FROM walk w JOIN cut USING (doc_id) WHERE i < len(ps)))
  SELECT doc_id, i - 1 AS no, s AS start, e AS "end", md5(ps[i]) AS digest FROM walk JOIN cut USING (doc_id) WHERE i > 0"""


_M1 = f"regexp_replace(text, '([.!?]){WS}+([A-Z])', '\\1' || chr(1) || '\\2', 'g')"
_M2 = f"regexp_replace({_M1}, '\\n\\n+', chr(1), 'g')"
_M3 = f"regexp_replace({_M2}, '\\n([A-Z][a-z])', chr(1) || '\\1', 'g')"

_CLEAN = "coalesce(text, '')"
for _p, _r, _f in (("<script[^>]*>.*?</script>", " ", "gis"), ("<style[^>]*>.*?</style>", " ", "gis"), ("<[^>]+>", " ", "gs")):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', '{_r}', '{_f}')"
for _e, _c in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " ")):
    _CLEAN = f"replace({_CLEAN}, '{_e}', '{_c}')"
_CLEAN = strip(f"regexp_replace(regexp_replace({_CLEAN}, '&[a-z]+;', ' ', 'g'), '{WS}+', ' ', 'g')")


def placed(shift: int, name: str) -> str:
    at = f"(doc_id * 37) % (n_chars - 300) + {shift} * (doc_id % 5)"
    return f"{name} AS (SELECT doc_id AS qid, {at} AS s, {at} + 200 AS e FROM documents WHERE n_chars >= 400)"


OVERLAP = "greatest(0, least(t.e, f.e) - greatest(t.s, f.s))"

SQL: dict[str, str] = {
    "tokenize_docs": f"WITH {CORPUS} SELECT doc_id, len({toks('text')}) AS n_tokens, md5(array_to_string({toks('text')}, ' ')) AS digest FROM c",
    "token_set_size": f"WITH {CORPUS} SELECT doc_id, len(list_distinct({toks('text')})) AS n_terms FROM c",
    "char_trigram_jaccard": f"""WITH {CORPUS}, {ASKED}, {RUN}, x AS (SELECT qid, {grams('text')} AS a FROM q), y AS (SELECT doc_id, {grams('text')} AS b FROM c),
      p AS (SELECT qid, doc_id, len(a) AS na, len(b) AS nb, len(list_intersect(a, b)) AS n FROM r JOIN x USING (qid) JOIN y USING (doc_id))
      SELECT qid, doc_id, CASE WHEN na > 0 AND nb > 0 THEN round(n / (na + nb - n), 9) ELSE 0 END AS jaccard FROM p""",
    "clean_html_texts": f"SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, {_CLEAN} AS t FROM documents)",
    "parse_source_urls": """WITH u AS (SELECT DISTINCT value, type FROM missing_sources) SELECT
      CASE WHEN type = 'clueweb_id' THEN 'http://archive.example/page?id=' || value ELSE 'http://archive.example/go?href=' || url_encode(url_encode(value)) END AS url,
      type, value, type || ':' || value AS source_key FROM u""",
    "stable_ids": f"""WITH {CORPUS}, {ASKED}, f AS (SELECT 'query' AS kind, qid || '.txt' AS filename FROM q UNION ALL SELECT 'corpus', doc_id || '.txt' FROM c)
      SELECT kind, 'train' AS split, CASE WHEN kind = 'corpus' THEN 'd-' ELSE 'q-' END || substr(sha1('books:train:' || filename), 1, 16) AS opaque_id, filename FROM f""",
    "json_repair": "SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events",
    "document_numbers": "SELECT doc_id, doc_id AS number FROM documents",
    "paragraph_chunks": f"WITH RECURSIVE {ASKED}, {pack(800, 3000)} {CHUNK_ROWS.format(src='packed')}",
    "section_chunks": f"WITH RECURSIVE {ASKED}, {pack(500, 3000)} {CHUNK_ROWS.format(src='packed')}",
    "fixed_chunks": f"WITH {ASKED}, {WINDOWS} {CHUNK_ROWS.format(src='packed')}",
    "token_windows": f"""WITH {ASKED}, tk AS (SELECT qid, text, {toks('text')} AS t FROM q),
      packed AS (SELECT qid, CASE WHEN len(t) <= 256 THEN [substr(text, 1, 3000)] ELSE list_transform(range(0, len(t), 128), lambda i: array_to_string(t[i + 1 : i + 256], ' ')) END AS chunks FROM tk)
      {CHUNK_ROWS.format(src='packed')}""",
    "semantic_sections": f"""WITH RECURSIVE {ASKED}, {pack(800, 3000)},
      se AS (SELECT qid, chunks, list_filter(list_transform(string_split_regex(text, '(?i)\\n{WS}*(?:\\d+\\.?{WS}*)?(?:abstract|introduction|related{WS}*work|method|experiment|result|discussion|conclusion|reference|acknowledg){WS}*\\n'), lambda p: {strip('p')}), lambda p: length(p) > 500)[1:15] AS parts FROM packed),
      sections AS (SELECT qid, CASE WHEN len(parts) > 0 THEN parts ELSE chunks END AS chunks FROM se) {CHUNK_ROWS.format(src='sections')}""",
    "length_gated_chunks": f"""WITH RECURSIVE {ASKED}, {pack(800, 3000)}, gated AS (SELECT qid, CASE WHEN length(text) > 6000 THEN chunks ELSE [text] END AS chunks FROM packed) {CHUNK_ROWS.format(src='gated')}""",
    "sentence_spans_v1": spans(_M2),
    "sentence_spans_v2": spans(_M3),
    "doc_length_stats": f"WITH {CORPUS}, {INDEX} SELECT n AS n_docs, round(avgdl, 6) AS avgdl FROM st",
    "postings_tf": f"WITH {CORPUS}, {INDEX} SELECT doc_id, term, tf, dl FROM tf JOIN l USING (doc_id)",
    "term_df": f"WITH {CORPUS}, {INDEX} SELECT term, df FROM t",
    "term_idf": f"WITH {CORPUS}, {INDEX} SELECT term, round(idf, 9) AS idf FROM t",
    "index_summary": f"""WITH {CORPUS}, {INDEX} SELECT (SELECT n FROM st) AS n_docs, round((SELECT avgdl FROM st), 6) AS avgdl, count(*) AS n_terms, sum(df)::BIGINT AS n_postings,
      count(*) FILTER (df <= floor((SELECT n FROM st) * 0.3e0)) AS kept_terms, count(*) FILTER (df > floor((SELECT n FROM st) * 0.3e0)) AS pruned_terms FROM t""",
    "prune_df_ratio": f"WITH {CORPUS}, {INDEX} SELECT term, df FROM t WHERE df <= floor((SELECT n FROM st) * 0.3e0)",
    "prune_max_df": f"WITH {CORPUS}, {INDEX} SELECT term, df FROM t WHERE df <= 500",
    "posting_weights": f"WITH {CORPUS}, {INDEX} SELECT term, doc_id, round(w, 6) AS w FROM w",
    "query_top_idf_terms": f"WITH {CORPUS}, {ASKED}, {INDEX}, asked AS (SELECT * FROM q), {search('SELECT * FROM t', 'term_rank <= 100')} SELECT qid, term, df, term_rank FROM qt",
    "bm25_set_top10": f"WITH {CORPUS}, {ASKED}, {INDEX}, asked AS (SELECT * FROM q), {search('SELECT * FROM t', 'term_rank <= 100')} SELECT * FROM found",
    "bm25_bag_top10": f"""WITH {CORPUS}, {ASKED}, {INDEX}, asked AS (SELECT qid, substr(text, 1, 2000) AS text FROM q),
      {search('SELECT * FROM t WHERE df <= floor((SELECT n FROM st) * 0.3e0)', 'true', qtf='qtf')} SELECT * FROM found""",
    "bm25_top100_candidates": f"""WITH {CORPUS}, {ASKED}, {INDEX}, asked AS (SELECT * FROM q), {search('SELECT * FROM t', 'term_rank <= 100', top='rank <= 100')}
      SELECT found.qid, length(substr(q.text, 1, 3000)) AS query_chars, rank - 1 AS no, found.doc_id, round(score::DECIMAL(18, 6), 4)::DOUBLE AS bm25_score, md5(substr(c.text, 1, 1500)) AS digest FROM found JOIN q USING (qid) JOIN c USING (doc_id)""",
    "bm25_segmented_coverage": segmented(pack(800, 3000), 5000, (100, 20), (10, 50), COVERAGE, 20),
    "bm25_segmented_rrf": segmented(pack(800, 3000), None, (50, 50), (10, 50), RRF),
    "bm25_segmented_max": segmented(ALL_WINDOWS, None, (50, 50), (10, 50), BEST),
    "decompose_max_rr": segmented(pack(500, 3000), None, (100, 100), (10, 50), BEST_RR),
    "dense_top10": f"WITH {VECTORS} {top('sims', 10)}",
    "dense_chunk_maxpool": f"WITH {VECTORS}, pooled AS (SELECT qid, grp::BIGINT AS doc_id, max(score) AS score FROM sims GROUP BY ALL) {top('pooled', 10)}",
    "dense_composite": f"""WITH {VECTORS}, five AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, grp ORDER BY score DESC, doc_id) AS n FROM sims) WHERE n <= 5),
      pooled AS (SELECT qid, grp::BIGINT AS doc_id, round(0.5e0 * max(score) + 0.3e0 * avg(score::DECIMAL(18, 9)) + CASE WHEN max(score) > 0.7e0 THEN 0.2e0 ELSE 0 END, 6) AS score FROM five GROUP BY ALL) {top('pooled', 10)}""",
    "hybrid_rrf": f"""WITH {DOCS}, {INDEX}, asked AS (SELECT doc_id AS qid, text FROM c WHERE doc_id % 50 = 0), {search('SELECT * FROM t', 'term_rank <= 100', top='rank <= 100')},
      {TEXT_VECTORS}, dense AS ({top('sims', 100)}), both_q AS (SELECT DISTINCT qid FROM found WHERE qid IN (SELECT qid FROM dense)),
      u AS (SELECT coalesce(f.qid, d.qid) AS qid, coalesce(f.doc_id, d.doc_id) AS doc_id, coalesce(f.score, 0) AS s, coalesce(d.rank, 200) AS dr
        FROM (SELECT * FROM found WHERE qid IN (SELECT qid FROM both_q)) f FULL JOIN (SELECT * FROM dense WHERE qid IN (SELECT qid FROM both_q)) d ON f.qid = d.qid AND f.doc_id = d.doc_id),
      v AS (SELECT qid, doc_id, round(1e0 / (20 + row_number() OVER (PARTITION BY qid ORDER BY s DESC, doc_id)) + 1e0 / (20 + dr), 9) AS score FROM u) {top('v', 10)}""",
    "dense_jaccard_rerank": f"""WITH {DOCS}, {TEXT_VECTORS}, cand AS ({top('sims', 100)}), tk AS (SELECT doc_id, list_distinct({toks('text')}) AS t FROM c),
      p AS (SELECT cand.qid, cand.doc_id, cand.score AS ip, coalesce(a.t, []) AS x, coalesce(b.t, []) AS y FROM cand LEFT JOIN tk a ON a.doc_id = cand.qid LEFT JOIN tk b ON b.doc_id = cand.doc_id),
      v AS (SELECT qid, doc_id, round(ip * (1 + 2.0e0 * CASE WHEN len(x) > 0 AND len(y) > 0 THEN len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) ELSE 0 END), 6) AS score FROM p) {top('v', 10)}""",
    "dense_window_maxpool": f"""WITH {DOCS}, tk AS (SELECT doc_id, text, {toks('text')} AS t FROM c),
      wi AS (SELECT doc_id, unnest(range(len(ch))) AS no, unnest(ch) AS text FROM (SELECT doc_id, CASE WHEN len(t) <= 256 THEN [substr(text, 1, 3000)]
        ELSE list_transform(range(0, len(t), 128), lambda i: array_to_string(t[i + 1 : i + 256], ' ')) END AS ch FROM tk)),
      {encoded("SELECT doc_id AS qid, 'query: ' || text AS text FROM c WHERE doc_id % 50 = 0", 'eq', 'qid')},
      {encoded("SELECT doc_id * 10000 + no AS part, 'passage: ' || text AS text FROM wi", 'ew', 'part')},
      met AS (SELECT qid, part, round(sum(eq.x * ew.x), 6) AS s FROM eq JOIN ew USING (p) GROUP BY ALL),
      pooled AS (SELECT a.doc_id AS qid, b.doc_id, max(coalesce(s, 0)) AS score FROM c a JOIN wi b ON a.doc_id % 50 = 0 LEFT JOIN met ON met.qid = a.doc_id AND part = b.doc_id * 10000 + b.no GROUP BY ALL) {top('pooled', 10)}""",
    "encoded_documents": f"""WITH {CORPUS}, {encoded("SELECT doc_id, 'passage: ' || text AS text FROM c", 'ed', 'doc_id')}
      SELECT doc_id, 256 AS dim, round(sum(x), 6) AS total, round(max(x), 6) AS most FROM ed GROUP BY doc_id""",
    "bm25_export100": f"""WITH {CORPUS}, {ASKED}, {INDEX}, asked AS (SELECT qid, substr(text, 1, 2000) AS text FROM q),
      {search('SELECT * FROM t WHERE df <= floor((SELECT n FROM st) * 0.3e0)', 'true', qtf='qtf', top='rank <= 100')} SELECT * FROM found""",
    "bm25_segment_full": segmented(pack(800, 3000, 'packed0') + ", packed AS (SELECT qid, text, CASE WHEN length(text) > 20000 THEN chunks ELSE [text] END AS chunks FROM packed0)", None, (30, 30), (10, 30), COVERAGE),
    "bm25_compare": segmented(pack(800, 3000), 5000, (50, 20), (100, 50), COVERAGE, 20, 100),
    "bm25_segment_eval": segmented(pack(800, 3000), None, (50, 50), (100, 50), RRF, 0, 100),
    "length_gated_20000": f"""WITH RECURSIVE {ASKED}, {pack(800, 3000)}, gated AS (SELECT qid, CASE WHEN length(text) > 20000 THEN chunks ELSE [text] END AS chunks FROM packed) {CHUNK_ROWS.format(src='gated')}""",
    "prune_max_df_5000": f"WITH {CORPUS}, {INDEX} SELECT term, df FROM t WHERE df <= 5000",
    "pair_scorer_rerank": f"""WITH {CORPUS}, {ASKED}, {RUN}, a AS (SELECT qid, list_distinct({toks('text')}) AS x FROM q), b AS (SELECT doc_id, list_distinct({toks('text')}) AS y FROM c),
      v AS (SELECT qid, doc_id, CASE WHEN len(x) > 0 AND len(y) > 0 THEN round(len(list_intersect(x, y)) / len(x), 6) ELSE 0 END AS score FROM r JOIN a USING (qid) JOIN b USING (doc_id)) {top('v', 10)}""",
    "blind_queries": f"WITH {RUN}, {RANKED}, {QRELS} SELECT qid, max(doc_id) AS doc_id FROM j WHERE rel > 0 GROUP BY qid HAVING (qid, max(doc_id)) NOT IN (SELECT (qid, doc_id) FROM rr WHERE rank <= 10)",
    "needed_docs": f"WITH {CORPUS} SELECT doc_id, length(text) AS n FROM c WHERE doc_id IN (SELECT doc_id FROM run)",
    "override_run": f"""WITH a AS (SELECT qid, doc_id, max(score) AS score FROM run WHERE tag = 'seg' GROUP BY ALL), b AS (SELECT qid, doc_id, max(score) AS score FROM run WHERE tag = 'bm25' GROUP BY ALL),
      u AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE qid NOT IN (SELECT qid FROM a)) {top('u', 1000000)}""",
    "ndcg_at_k": f"WITH {RUN}, {RANKED}, {QRELS}, {KS}, {NDCG} SELECT k, ndcg FROM ndcg",
    "recall_at_k": f"WITH {RUN}, {RANKED}, {QRELS}, {KS}, {RECALL} SELECT k, recall FROM recall",
    "mrr": f"WITH {RUN}, {RANKED}, {QRELS}, {MRR} SELECT mrr FROM mrr",
    "mean_average_precision": f"WITH {RUN}, {RANKED}, {QRELS}, {MAP} SELECT map FROM map",
    "single_rel_metrics": single(RUN, False),
    "single_rel_metrics_both": single("r AS (SELECT qid, doc_id, max(score) AS score FROM run WHERE tag = 'seg' GROUP BY ALL)", True),
    "run_delta": f"WITH {tagged('seg', 'a')}, {tagged('bm25', 'b')} SELECT metric, k, a.value, b.value AS baseline, round(a.value - b.value, 6) AS delta FROM a JOIN b USING (metric, k)",
    "span_iou_hits": f"WITH {placed(0, 't')}, {placed(25, 'f')}, p AS (SELECT t.qid, t.s, t.e, f.s AS fs, f.e AS fe, {OVERLAP} AS o FROM t JOIN f USING (qid)) SELECT qid, round(o / (e - s + fe - fs - o), 9) AS iou FROM p WHERE round(o / (e - s + fe - fs - o), 9) > 0.3",
    "alignment_prf": f"""WITH {placed(0, 't')}, {placed(45, 'f')}, p AS (SELECT DISTINCT t.qid FROM t JOIN f USING (qid) WHERE {OVERLAP} / (t.e - t.s + f.e - f.s - {OVERLAP}) > 0.3),
      n AS (SELECT (SELECT count(*) FROM t) AS n_truth, (SELECT count(*) FROM f) AS n_found, (SELECT count(*) FROM p) AS n_hit)
      SELECT n_truth, n_found, n_hit, round(n_hit / n_found, 6) AS precision, round(n_hit / n_truth, 6) AS recall, round(2 * (n_hit / n_found) * (n_hit / n_truth) / greatest(n_hit / n_found + n_hit / n_truth, 0.001), 6) AS f1 FROM n""",
    "rewrite_truncate": f"WITH {ASKED} SELECT qid, length(substr(text, 1, 3000)) AS n, md5(substr(text, 1, 3000)) AS digest FROM q",
    "collection_statistics": f"""WITH {CORPUS}, {ASKED} SELECT 'documents' AS statistic, count(*) AS n FROM c UNION ALL SELECT 'queries', count(*) FROM q
      UNION ALL SELECT 'qrels', count(*) FROM (SELECT DISTINCT qid, doc_id FROM qrels) UNION ALL SELECT 'missing', count(DISTINCT source_key) FROM missing_sources
      UNION ALL SELECT 'missing_' || type, count(DISTINCT source_key) FROM missing_sources GROUP BY type""",
    "referenced_documents": f"WITH {CORPUS}, d AS (SELECT DISTINCT doc_id FROM qrels) SELECT count(*) AS n_cited, count(*) FILTER (doc_id IN (SELECT doc_id FROM c)) AS n_present, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM c)) AS n_absent FROM d",
    "registered_sources": "SELECT DISTINCT source_key, type, value, 'd-' || substr(sha1('pages:source:' || source_key), 1, 16) AS source_doc_id FROM missing_sources",
    "trec_run_lines": f"WITH {RUN}, {RANKED} SELECT printf('%s Q0 %s %d %.6f bm25', qid, doc_id, rank, score) AS value FROM rr",
    "trec_qrels_lines": f"WITH {QRELS} SELECT printf('%s 0 %s %d', qid, doc_id, rel) AS value FROM j",
    "run_top_k": f"WITH {RUN}, {RANKED} SELECT qid, doc_id, score, rank FROM rr WHERE rank <= 2",
}

SQL["own_run_delta"] = f"""WITH {reported(SQL['bm25_segmented_coverage'], 'a')}, {reported(SQL['bm25_set_top10'], 'b')}
  SELECT metric, k, a.value, b.value AS baseline, round(a.value - b.value, 6) AS delta FROM a JOIN b USING (metric, k)"""


def located(src: str, key: str, marked: str, out: str, least: int) -> str:
    """CTE ``out`` (key, st, en, tx): starts, ends and texts of the sentences of each text with at least ``least`` of them."""
    return f"""{out}_c AS (SELECT {key}, text, list_filter(list_transform(string_split({marked}, chr(1)), lambda p: {strip('p')}), lambda p: p <> '') AS ps FROM {src}),
  {out}_w AS (SELECT {key}, 0 AS i, 0::BIGINT AS s, 0::BIGINT AS e FROM {out}_c UNION ALL
    SELECT {key}, i + 1, e + greatest(f, 1) - 1, e + greatest(f, 1) - 1 + length(p) FROM (SELECT w.*, ps[i + 1] AS p, instr(substr(text, e + 1), ps[i + 1]) AS f FROM {out}_w w JOIN {out}_c USING ({key}) WHERE i < len(ps))),
  {out} AS (SELECT {key}, list(s ORDER BY i) AS st, list(e ORDER BY i) AS en, list(ps[i] ORDER BY i) AS tx FROM {out}_w JOIN {out}_c USING ({key}) WHERE i > 0 GROUP BY {key} HAVING count(*) >= {least})"""


def marks(threshold: float, bonus: float, both_ways: bool) -> str:
    """CTE ``mk`` (qid, doc_id, i, j, score) over ``r`` (qid, doc_id), ``sa`` and ``sb`` as ``located`` makes them."""
    way = " AND abs(back - i) <= 5" if both_ways else ""
    return f"""na AS (SELECT qid, unnest(range(len(tx))) AS i, unnest(tx) AS text FROM sa), nb AS (SELECT doc_id, unnest(range(len(tx))) AS j, unnest(tx) AS text FROM sb),
  ta AS (SELECT qid, i, len(t) AS na, unnest(t) AS tok FROM (SELECT qid, i, list_distinct({toks('text')}) AS t FROM na)),
  tb AS (SELECT doc_id, j, len(t) AS nb, unnest(t) AS tok FROM (SELECT doc_id, j, list_distinct({toks('text')}) AS t FROM nb)),
  cs AS (SELECT r.qid, r.doc_id, i, j, round(count(*) / sqrt(any_value(na) * any_value(nb)), 9) AS cos FROM r JOIN ta ON ta.qid = r.qid JOIN tb ON tb.doc_id = r.doc_id AND tb.tok = ta.tok GROUP BY ALL),
  pl AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id, i ORDER BY cos DESC, j) AS place FROM cs),
  ga AS (SELECT qid, i, {grams('text')} AS x FROM na), gb AS (SELECT doc_id, j, {grams('text')} AS y FROM nb),
  jc AS (SELECT pl.qid, pl.doc_id, pl.i, pl.j, CASE WHEN len(x) > 0 AND len(y) > 0 THEN len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) ELSE 0 END AS jac
    FROM pl JOIN ga ON ga.qid = pl.qid AND ga.i = pl.i JOIN gb ON gb.doc_id = pl.doc_id AND gb.j = pl.j WHERE place <= 20 AND cos * (1 + {bonus}e0) >= {threshold}e0 - 1e-6 AND {bonus} > 0),
  s AS (SELECT pl.qid, pl.doc_id, pl.i, pl.j, CASE WHEN jac IS NULL THEN cos ELSE round(cos * (1 + {bonus}e0 * jac), 9) END AS score FROM pl LEFT JOIN jc ON (pl.qid, pl.doc_id, pl.i, pl.j) = (jc.qid, jc.doc_id, jc.i, jc.j)),
  best AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id, i ORDER BY score DESC, j) AS a, first_value(i) OVER (PARTITION BY qid, doc_id, j ORDER BY score DESC, i) AS back FROM s),
  mk AS (SELECT qid, doc_id, i, j, score FROM best WHERE a = 1 AND score >= {threshold}e0{way})"""


def merged(min_chars: int, gap: int, reach: int, coherence: float | None, second: bool) -> str:
    """CTEs after ``mk``, and the rows of blocks. ``opener`` is the mark that opened the block, ``pos`` the one looked at."""
    held, end = ("lastj", "CASE WHEN pos <= len(ii) THEN ii[pos] ELSE len(ast) END") if second else ("jj[opener]", "lasti + 1")
    unsettles = f"list_stddev_pop(list_append(sc, ss[pos])) > {coherence}e0" if coherence else "false"
    fresh = "ss[{k}] AS total, [ss[{k}]] AS sc, jj[{k}] AS lastj, ii[{k}] AS lasti, bst[jj[{k}] + 1] AS lo, ben[jj[{k}] + 1] AS hi"
    return f"""g AS (SELECT qid, doc_id, list(i ORDER BY i) AS ii, list(j ORDER BY i) AS jj, list(score ORDER BY i) AS ss FROM mk GROUP BY ALL),
  p AS (SELECT g.*, sa.st AS ast, sa.en AS aen, sb.st AS bst, sb.en AS ben FROM g JOIN sa USING (qid) JOIN sb USING (doc_id)),
  w AS (SELECT qid, doc_id, 1::BIGINT AS opener, 2::BIGINT AS pos, 1::BIGINT AS n, {fresh.format(k=1)}, NULL::BIGINT[] AS block, NULL::DOUBLE AS mean FROM p UNION ALL
    SELECT qid, doc_id, CASE WHEN stop THEN nxt ELSE opener END, CASE WHEN stop THEN nxt + 1 ELSE pos + 1 END, CASE WHEN stop THEN 1 WHEN joins THEN n + 1 ELSE n END,
      CASE WHEN stop THEN ss[nxt] WHEN joins THEN total + ss[pos] ELSE total END, CASE WHEN stop THEN [ss[nxt]] WHEN joins THEN list_append(sc, ss[pos])[-3:] ELSE sc END,
      CASE WHEN stop THEN jj[nxt] WHEN joins THEN jj[pos] ELSE lastj END, CASE WHEN stop THEN ii[nxt] WHEN joins THEN ii[pos] ELSE lasti END,
      CASE WHEN stop THEN bst[jj[nxt] + 1] WHEN joins THEN least(lo, bst[jj[pos] + 1]) ELSE lo END, CASE WHEN stop THEN ben[jj[nxt] + 1] WHEN joins THEN greatest(hi, ben[jj[pos] + 1]) ELSE hi END,
      CASE WHEN stop AND list_sum(list_transform(range(ii[opener] + 1, fin + 1), lambda x: aen[x] - ast[x])) >= {min_chars} THEN [ast[ii[opener] + 1], aen[fin], lo, hi] END, CASE WHEN stop THEN total / n END
    FROM (SELECT *, NOT stop AND NOT (abs(jj[pos] - {held}) > {reach} OR {unsettles}) AS joins, opener + 1 + len(list_filter(ii[opener + 1:], lambda x: x < fin)) AS nxt
      FROM (SELECT w.*, p.* EXCLUDE (qid, doc_id), pos > len(ii) OR ii[pos] - ii[opener] - n > {gap} AS stop, {end} AS fin FROM w JOIN p USING (qid, doc_id) WHERE opener <= len(ii))))
  SELECT qid, doc_id AS src, block[1]::INT AS susp_start, block[2]::INT AS susp_end, block[3]::INT AS src_start, block[4]::INT AS src_end, round(mean, 6) AS score FROM w WHERE block IS NOT NULL"""


CITED = "cd AS (SELECT * FROM c WHERE doc_id IN (SELECT doc_id FROM r))"
SQL["align_marked_sentences"] = f"""WITH RECURSIVE {CORPUS}, {ASKED}, {RUN}, {CITED}, {located('q', 'qid', _M3, 'sa', 2)}, {located('cd', 'doc_id', _M3, 'sb', 2)}, {marks(0.7, 0.5, True)}
  SELECT qid, doc_id AS src, i, j, round(score, 6) AS score FROM mk"""
SQL["align_blocks_v2"] = f"""WITH RECURSIVE {CORPUS}, {ASKED}, {RUN}, {CITED}, {located('q', 'qid', _M3, 'sa', 2)}, {located('cd', 'doc_id', _M3, 'sb', 2)}, {marks(0.7, 0.5, True)}, {merged(50, 2, 5, 0.15, True)}"""
SQL["align_end_to_end"] = f"""WITH RECURSIVE {CORPUS}, {ASKED}, r AS (SELECT qid, doc_id FROM ({SQL['bm25_set_top10']}) WHERE rank = 1), {CITED},
  {located('q', 'qid', _M3, 'sa', 2)}, {located('cd', 'doc_id', _M3, 'sb', 2)}, {marks(0.89, 0.0, True)}, {merged(100, 1, 5, 0.15, True)}"""

_PARAS = f"list_filter(list_transform(string_split_regex(text, '\\n{WS}*\\n'), lambda p: {strip('p')}), lambda p: p <> '')"
SQL["paragraph_spans"] = f"""WITH RECURSIVE {CORPUS}, cut AS (SELECT doc_id, text, {_PARAS} AS ps FROM c),
  walk AS (SELECT doc_id, 0 AS i, 0::BIGINT AS s, 0::BIGINT AS pos FROM cut UNION ALL
    SELECT doc_id, i + 1, pos + greatest(f, 1) - 1, pos + greatest(f, 1) - 1 + length(p) FROM (SELECT w.*, ps[i + 1] AS p, instr(substr(text, pos + 1), ps[i + 1]) AS f FROM walk w JOIN cut USING (doc_id) WHERE i < len(ps))),
  para AS (SELECT doc_id, i - 1 AS i, s, ps[i] AS text FROM walk JOIN cut USING (doc_id) WHERE i > 0),
  inner_ AS (SELECT doc_id, i, s, text, CASE WHEN length(text) > 500 THEN list_filter(list_transform(string_split({_M2}, chr(1)), lambda p: {strip('p')}), lambda p: p <> '') ELSE [text] END AS ps FROM para),
  walk2 AS (SELECT doc_id, i, 0 AS k, 0::BIGINT AS a, 0::BIGINT AS e FROM inner_ UNION ALL
    SELECT doc_id, i, k + 1, e + greatest(f, 1) - 1, e + greatest(f, 1) - 1 + length(p) FROM (SELECT w.*, ps[k + 1] AS p, instr(substr(text, e + 1), ps[k + 1]) AS f FROM walk2 w JOIN inner_ USING (doc_id, i) WHERE k < len(ps)))
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 AS no, s + a AS start, s + e AS "end" FROM walk2 JOIN inner_ USING (doc_id, i) WHERE k > 0"""

_WORDS = r"regexp_extract_all(lower({x}), '[\p{{L}}\p{{Nl}}\p{{M}}\p{{Nd}}\p{{Pc}}\x{{200c}}\x{{200d}}]{{2,}}')"


def words(x: str) -> str:
    return f"list_filter({_WORDS.format(x=x)}, lambda w: NOT list_contains({STOP_WORDS!r}, w))"


def rewritten(rows: str) -> str:
    """The columns of rewritten queries (qid, t)."""
    return f"SELECT qid, length(t) AS n, md5(t) AS digest FROM ({rows})"


SQL["rewrite_keywords"] = f"""WITH {ASKED}, w AS (SELECT qid, w, count(*) AS tf FROM (SELECT qid, unnest({words('text')}) AS w FROM q) GROUP BY ALL),
  k AS (SELECT qid, w, row_number() OVER (PARTITION BY qid ORDER BY tf DESC, w) AS place FROM w),
  l AS (SELECT qid, array_to_string(list_sort(list(w)), ' ') AS k FROM k WHERE place <= 500 GROUP BY qid)
  {rewritten("SELECT qid, substr(coalesce(k, text), 1, 3000) AS t FROM q LEFT JOIN l USING (qid)")}"""
SQL["rewrite_tfidf_sentences"] = f"""WITH {ASKED}, p AS (SELECT qid, text, string_split(regexp_replace(text, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1)) AS sents FROM q),
  lo AS (SELECT qid, text, sents, len(sents) AS ns FROM p WHERE len(sents) > 20),
  u AS (SELECT qid, ns, unnest(range(ns)) AS no, unnest(sents) AS sent FROM lo),
  un AS (SELECT * FROM u UNION ALL SELECT qid, ns, -1, text FROM lo),
  tf AS (SELECT qid, ns, no, w, count(*) AS tf FROM (SELECT qid, ns, no, unnest({words('sent')}) AS w FROM un) GROUP BY ALL),
  df AS (SELECT qid, w, count(*) AS df FROM tf GROUP BY ALL),
  we AS (SELECT qid, no, w, tf * (ln((ns + 2e0) / (df + 1e0)) + 1) AS x FROM tf JOIN df USING (qid, w)),
  nm AS (SELECT qid, no, sqrt(sum((x * x)::DECIMAL(24, 12))::DOUBLE) AS norm FROM we GROUP BY ALL),
  dt AS (SELECT a.qid, a.no, sum((a.x * b.x)::DECIMAL(24, 12))::DOUBLE AS dot FROM we a JOIN we b ON a.qid = b.qid AND a.w = b.w AND b.no = -1 AND a.no >= 0 GROUP BY ALL),
  si AS (SELECT qid, no, round(dot / norm, 9) AS sim FROM dt JOIN nm USING (qid, no)),
  pl AS (SELECT u.qid, u.no, sent, row_number() OVER (PARTITION BY u.qid ORDER BY coalesce(sim, 0) DESC, u.no) AS place FROM u LEFT JOIN si USING (qid, no)),
  a AS (SELECT qid, substr(string_agg(sent, ' ' ORDER BY no), 1, 3000) AS t FROM pl WHERE place <= 20 GROUP BY qid)
  {rewritten("SELECT * FROM a UNION ALL SELECT qid, substr(text, 1, 3000) FROM p WHERE len(sents) <= 20")}"""
SQL["rewrite_structured"] = f"""WITH {ASKED}, f AS (SELECT qid, text, list_filter(string_split(text, chr(10))[1:5], lambda x: length({strip('x')}) > 10)[1] AS title,
    list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {strip('x')}), lambda x: length(x) > 100)[1] AS para,
    CASE WHEN regexp_matches(text, '{ABSTRACT}') THEN 'Abstract: ' || substr({strip(f"regexp_extract(text, '{ABSTRACT}', 1)")}, 1, 1000) END AS abstract,
    list_filter(list_transform(regexp_extract_all(text, '{SECTION}', 1), lambda x: {strip('x')}), lambda x: length(x) > 5) AS heads FROM q),
  j AS (SELECT qid, text, substr(array_to_string(list_concat(list_filter([title, coalesce(abstract, substr(para, 1, 1000))], lambda x: x IS NOT NULL), list_transform(heads, lambda x: '[Section: ' || x || ']')), ' '), 1, 3000) AS t FROM f)
  {rewritten("SELECT qid, CASE WHEN length(t) < 200 THEN substr(text, 1, 3000) ELSE t END AS t FROM j")}"""
SQL["resolved_missing"] = f"""WITH {CORPUS}, pages AS (SELECT value, any_value(c.text) AS text FROM missing_sources m JOIN c ON c.doc_id = m.source_doc_id
    WHERE m.source_doc_id NOT IN (SELECT source_doc_id FROM fetch_errors WHERE source_doc_id IS NOT NULL) GROUP BY value),
  w AS (SELECT DISTINCT source_doc_id, type, value FROM missing_sources), j AS (SELECT w.*, pages.text IS NULL AS absent, {_CLEAN} AS t FROM w LEFT JOIN pages USING (value))
  SELECT source_doc_id, CASE WHEN length(t) > 50 THEN 'ok' WHEN absent THEN 'not fetched' ELSE 'empty body' END AS state, CASE WHEN length(t) > 50 THEN length(t) ELSE 0 END AS n FROM j"""
_PARAGRAPHS = SQL["paragraph_spans"].split("SELECT doc_id, row_number()")[0].removeprefix(f"WITH RECURSIVE {CORPUS}, ").replace("FROM c)", "FROM cd)", 1)
SQL["align_blocks_v1"] = f"""WITH RECURSIVE {CORPUS}, {ASKED}, {RUN}, {CITED}, {located('q', 'qid', _M2, 'sa', 1)}, {_PARAGRAPHS},
  sb AS (SELECT doc_id, list(s + a ORDER BY i, k) AS st, list(s + e ORDER BY i, k) AS en, list(ps[k] ORDER BY i, k) AS tx FROM walk2 JOIN inner_ USING (doc_id, i) WHERE k > 0 GROUP BY doc_id),
  {marks(0.65, 0.0, False)}, {merged(50, 2, 3, None, False)}"""
SQL["three_runs"] = f"""WITH {tagged('seg', 'a')}, {tagged('bm25', 'b')}, {reported('SELECT qid, doc_id, max(score) AS score FROM run GROUP BY ALL', 'u')}
  SELECT metric, k, a.value AS seg, b.value AS bm25, u.value AS "both" FROM a JOIN b USING (metric, k) JOIN u USING (metric, k)"""


def hits(tag: str, name: str, k: int) -> str:
    return f"""{name} AS (SELECT qid, doc_id FROM (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank
    FROM (SELECT qid, doc_id, max(score) AS score FROM run WHERE tag = '{tag}' GROUP BY ALL)) WHERE rank <= {k})"""


def recovered(k: int) -> str:
    return f"""WITH {QRELS}, truth AS (SELECT qid, max(doc_id) AS doc_id FROM j WHERE rel > 0 GROUP BY qid), {hits('seg', 'a', k)}, {hits('bm25', 'b', k)},
  m AS (SELECT (qid, doc_id) IN (SELECT (qid, doc_id) FROM a) AS x, (qid, doc_id) IN (SELECT (qid, doc_id) FROM b) AS y FROM truth)
  SELECT count(*) AS n_queries, count(*) FILTER (y) AS n_baseline, count(*) FILTER (x) AS n_run, count(*) FILTER (x AND NOT y) AS n_recovered, count(*) FILTER (y AND NOT x) AS n_lost,
  count(*) FILTER (x OR y) AS n_union, round(count(*) FILTER (x OR y) / count(*), 6) AS union_recall FROM m"""


SQL["recovered_hits"] = recovered(10)
SQL["union_recall_100"] = f"SELECT n_queries, n_union, union_recall FROM ({recovered(100)})"
SQL["alignment_prf_anywhere"] = f"""WITH {placed(0, 't')}, {placed(45, 'f')}, d AS (SELECT DISTINCT s, e FROM f),
  p AS (SELECT t.qid FROM t WHERE EXISTS (SELECT 1 FROM d f WHERE {OVERLAP} / (t.e - t.s + f.e - f.s - {OVERLAP}) > 0.3)),
  n AS (SELECT (SELECT count(*) FROM t) AS n_truth, (SELECT count(*) FROM f) AS n_found, (SELECT count(*) FROM p) AS n_hit)
  SELECT n_truth, n_found, n_hit, round(n_hit / n_found, 6) AS precision, round(n_hit / n_truth, 6) AS recall, round(2 * (n_hit / n_found) * (n_hit / n_truth) / greatest(n_hit / n_found + n_hit / n_truth, 0.001), 6) AS f1 FROM n"""
SQL["targeted_windows"] = f"""WITH {CORPUS}, {ASKED}, bl AS ({SQL['blind_queries']}), tk AS (SELECT doc_id, text, {toks('text')} AS t FROM c WHERE doc_id IN (SELECT doc_id FROM bl)),
  wi AS (SELECT doc_id, unnest(range(len(ch))) AS no, unnest(ch) AS text FROM (SELECT doc_id, CASE WHEN len(t) <= 256 THEN [substr(text, 1, 3000)]
    ELSE list_transform(range(0, len(t), 128), lambda i: array_to_string(t[i + 1 : i + 256], ' ')) END AS ch FROM tk)),
  {encoded("SELECT qid, 'query: ' || text AS text FROM q WHERE qid IN (SELECT qid FROM bl)", 'eq', 'qid')},
  {encoded("SELECT doc_id || ':' || no AS part, 'passage: ' || text AS text FROM wi", 'ew', 'part')},
  met AS (SELECT bl.qid, bl.doc_id, no, sum(eq.x * ew.x) AS s FROM bl JOIN wi USING (doc_id) JOIN eq ON eq.qid = bl.qid JOIN ew ON ew.part = bl.doc_id || ':' || no AND ew.p = eq.p GROUP BY ALL),
  a AS (SELECT bl.qid, bl.doc_id, wi.no, round(coalesce(s, 0), 6) AS score FROM bl JOIN wi USING (doc_id) LEFT JOIN met ON (met.qid, met.doc_id, met.no) = (bl.qid, bl.doc_id, wi.no)),
  five AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY score DESC, no) AS n FROM a)
  SELECT qid, doc_id, round(0.5e0 * max(score) + 0.3e0 * avg(score::DECIMAL(18, 9)) + CASE WHEN max(score) > 0.7e0 THEN 0.2e0 ELSE 0 END, 5) AS score FROM five WHERE n <= 5 GROUP BY ALL"""
