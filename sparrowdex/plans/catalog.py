"""Named queries over the shipped tables, one or more for each operator, and SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import passages as P
from ..functions.text import Analyzer, cleaned_reply
from ..operators import evaluation, feedback, ltr, reranking, retrieval
from ..operators.index import documents_index, duplicate_ids, pages_index
from ..sources import files
from .language import default_query, multi_field_query, near_query, sdm_query

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Query words seen in all sizes of the tables; k1, b, places and digits of scores.
WORDS = {"1": "the that and", "2": "ention inst eden", "3": "was with for", "4": "de la que", "5": "der die und"}
K1, B, TOP, DIGITS = 1.2, 0.75, 10, 6


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# SQL parts -------------------------------------------------------------------------------------
_SPLIT = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_PAGE = {f: rf"trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<{t}[^>]*>(.*?)</{t}>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))" for f, t in (("body", "article"), ("title", "title"), ("keywords", "h1"), ("inlink", "nav"))} | {"url": "url"}


def _base(pages: bool = False, stop: str = "''") -> str:
    """CTEs fl (field lengths), post (postings), lex, st."""
    if pages:
        src = " UNION ALL ".join(f"SELECT CAST(page_id AS VARCHAR) AS ext_id, '{f}' AS field, {_SPLIT.format(x)} AS toks FROM pages" for f, x in _PAGE.items())
    else:
        src = f"SELECT CAST(doc_id AS VARCHAR) AS ext_id, 'body' AS field, {_SPLIT.format('text')} AS toks FROM documents"
    return f"""src AS ({src}),
occ AS (SELECT ext_id, field, term, pos FROM (SELECT ext_id, field, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS pos FROM src) WHERE term NOT IN ({stop})),
post AS (SELECT ext_id, field, term, count(*) AS tf, list(pos ORDER BY pos) AS positions FROM occ GROUP BY ALL),
fl AS (SELECT s.ext_id, s.field, len(s.toks) AS len, coalesce(m, 0) AS pos_len, coalesce(n, 0) AS indexed FROM src s LEFT JOIN (SELECT ext_id, field, max(pos) + 1 AS m, count(*) AS n FROM occ GROUP BY ALL) o USING (ext_id, field)),
lex AS (SELECT field, term, count(*) AS df, sum(tf) AS ctf FROM post GROUP BY ALL),
st AS (SELECT field, count_if(indexed > 0) AS doc_count, sum(indexed) AS sum_len, count(*) AS n_docs FROM fl GROUP BY field)"""


def _bm25(k1: float = K1, b: float = B, tf: str = "tf", df: str = "df") -> str:
    return f"ln((n_docs + 1) / ({df} + 0.5)) * {tf} / ({tf} + {k1} * ({1 - b} + {b} * len / (sum_len / doc_count)))"


def _values(rows, names: str) -> str:
    lit = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({names}))"


def _terms(queries: dict[str, str], field: str = "body") -> str:
    return _values([(q, t, field) for q, text in queries.items() for t in text.split()], "qid, term, field")


def _ranked(score_cte: str, k: int = TOP) -> str:
    """The last SELECT over a CTE ``s`` (qid, ext_id, score)."""
    return f"{score_cte} SELECT qid, rank, ext_id, score FROM (SELECT qid, ext_id, round(score, {DIGITS}) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, {DIGITS}) DESC, ext_id) AS INTEGER) AS rank FROM s) WHERE rank <= {k}"


def _bm25_sum(queries: dict[str, str], k: int = TOP, k1: float = K1, b: float = B) -> str:
    return "WITH " + _base() + ", " + _ranked(f"q AS {_terms(queries)}, s AS (SELECT qid, ext_id, sum({_bm25(k1, b)}) AS score FROM q JOIN post USING (field, term) JOIN lex USING (field, term) JOIN fl USING (field, ext_id) JOIN st USING (field) GROUP BY qid, ext_id)", k)


def _run(spark, sf_dir, queries, model="BM25", k=TOP, pages=False, analyzer=Analyzer(), **args) -> DataFrame:
    index = (pages_index if pages else documents_index)(spark, sf_dir, analyzer)
    return retrieval.top(retrieval.evaluate(index, queries, retrieval.Model(model, **args)), k, DIGITS)


# ranking -----------------------------------------------------------------------------------------
@query("bm25_sum", _bm25_sum(WORDS))
def bm25_sum(spark, sf_dir):
    return _run(spark, sf_dir, WORDS)


@query("bm25_duplicate_terms", _bm25_sum({"1": "the the that", "2": "ention ention inst"}))
def bm25_duplicate_terms(spark, sf_dir):
    return _run(spark, sf_dir, {"1": "#sum( the the that )", "2": "#sum( ention #sum( ention inst ) )"})


_GRID = [(0.75, 0.3), (1.2, 0.7), (2.1, 0.75)]


@query("bm25_params_grid", " UNION ALL ".join(f"SELECT CAST({k1} AS DOUBLE) AS k1, CAST({b} AS DOUBLE) AS b, * FROM ({_bm25_sum({'1': 'the that and', '2': 'ention inst'}, 5, k1, b)})" for k1, b in _GRID))
def bm25_params_grid(spark, sf_dir):
    out = None
    for k1, b in _GRID:
        part = _run(spark, sf_dir, {"1": "the that and", "2": "ention inst"}, k=5, k1=k1, b=b).select(F.lit(k1).alias("k1"), F.lit(b).alias("b"), "qid", "rank", "ext_id", "score")
        out = part if out is None else out.unionByName(part)
    return out


def _boolean(op: str, ranked: bool) -> str:
    value = "tf" if ranked else "1.0"
    fold, having = ("min", "HAVING count(*) = (SELECT count(*) FROM q x WHERE x.qid = h.qid)") if op == "and" else ("max", "")
    return "WITH " + _base() + ", " + _ranked(f"q AS {_terms(WORDS)}, h AS (SELECT qid, ext_id, CAST({value} AS DOUBLE) AS v FROM q JOIN post USING (field, term)), s AS (SELECT qid, ext_id, {fold}(v) AS score FROM h GROUP BY qid, ext_id {having})")


for _op in ("or", "and"):
    for _ranked_model in (False, True):
        _name = f"bool_{'ranked' if _ranked_model else 'unranked'}_{_op}"
        QUERIES[_name] = lambda spark, sf_dir, op=_op, m="RankedBoolean" if _ranked_model else "UnrankedBoolean": _run(spark, sf_dir, {q: f"#{op}( {t} )" for q, t in WORDS.items()}, m)
        SQL[_name] = _boolean(_op, _ranked_model)


@query("bool_nested_fields", "WITH " + _base(True) + ", " + _ranked("h AS (SELECT ext_id, field, term, CAST(tf AS DOUBLE) AS v FROM post), o AS (SELECT ext_id, max(v) AS v FROM h WHERE (field = 'title' AND term IN ('the', 'de')) OR (field = 'body' AND term = 'der') GROUP BY ext_id), s AS (SELECT '1' AS qid, o.ext_id, least(o.v, b.v) AS score FROM o JOIN h b ON b.ext_id = o.ext_id AND b.field = 'url' AND b.term = 'example')", 20))
def bool_nested_fields(spark, sf_dir):
    return _run(spark, sf_dir, {"1": "#and( #or( the.title de.title der ) example.url )"}, "RankedBoolean", 20, pages=True)


def _wsum_fields() -> str:
    weights = {"body": 0.5, "title": 0.3, "keywords": 0.2}
    rows = _values([(q, t, f, w) for q, text in (("1", "the that"), ("2", "de la")) for f, w in weights.items() for t in text.split()], "qid, term, field, w")
    return "WITH " + _base(True) + ", " + _ranked(f"q AS {rows}, s AS (SELECT qid, ext_id, sum(w * {_bm25()}) AS score FROM q JOIN post USING (field, term) JOIN lex USING (field, term) JOIN fl USING (field, ext_id) JOIN st USING (field) GROUP BY qid, ext_id)")


@query("bm25_wsum_multifield", _wsum_fields())
def bm25_wsum_multifield(spark, sf_dir):
    weights = {"body": 0.5, "title": 0.3, "keywords": 0.2, "url": 0.0}
    return _run(spark, sf_dir, {q: multi_field_query(t.split(), weights) for q, t in (("1", "the that"), ("2", "de la"))}, pages=True)


@query("topk_tiebreak", "WITH " + _base() + ", " + _ranked(f"q AS {_terms({'1': 'the'})}, s AS (SELECT qid, ext_id, CAST(1 AS DOUBLE) AS score FROM q JOIN post USING (field, term))", 25))
def topk_tiebreak(spark, sf_dir):
    return _run(spark, sf_dir, {"1": "the"}, "UnrankedBoolean", 25)


# positional operators ------------------------------------------------------------------------------
def _near_cte(name: str, a: str, b: str, n: int) -> str:
    """Last positions of ordered matches of two terms, by recursion over the first one's."""
    return f"""{name}_w(ext_id, p, r, i, used, hits) AS (SELECT x.ext_id, x.positions, y.positions, 1, -1, CAST([] AS BIGINT[]) FROM post x JOIN post y USING (ext_id, field) WHERE x.term = '{a}' AND y.term = '{b}'
UNION ALL SELECT ext_id, p, r, i + 1, CASE WHEN ok THEN c ELSE used END, CASE WHEN ok THEN list_append(hits, c) ELSE hits END FROM (SELECT *, coalesce(c - p[i] <= {n}, false) AS ok FROM (SELECT *, list_min(list_filter(r, lambda x: x > p[i] AND x > used)) AS c FROM {name}_w WHERE i <= len(p)))),
{name} AS (SELECT ext_id, hits FROM {name}_w WHERE i = len(p) + 1 AND len(hits) > 0)"""


def _window_cte(name: str, a: str, b: str, n: int) -> str:
    return f"""{name}_w(ext_id, p, r, i, j, hits) AS (SELECT x.ext_id, x.positions, y.positions, 1, 1, CAST([] AS BIGINT[]) FROM post x JOIN post y USING (ext_id, field) WHERE x.term = '{a}' AND y.term = '{b}'
UNION ALL SELECT ext_id, p, r, i + CAST(ok OR p[i] <= r[j] AS INTEGER), j + CAST(ok OR p[i] > r[j] AS INTEGER), CASE WHEN ok THEN list_append(hits, greatest(p[i], r[j])) ELSE hits END FROM (SELECT *, abs(p[i] - r[j]) < {n} AS ok FROM {name}_w WHERE i <= len(p) AND j <= len(r))),
{name} AS (SELECT ext_id, hits FROM {name}_w WHERE (i > len(p) OR j > len(r)) AND len(hits) > 0)"""


def _positional(cte: str, name: str, model: str, stop: str = "''", k: int = TOP) -> str:
    if model == "BM25":
        s = f"d AS (SELECT count(*) AS df FROM {name}), s AS (SELECT '1' AS qid, ext_id, {_bm25(tf='len(hits)')} AS score FROM {name}, d JOIN fl USING (ext_id) JOIN st USING (field))".replace(f"{name}, d JOIN fl USING (ext_id)", f"{name} CROSS JOIN d JOIN fl USING (ext_id)")
    else:
        s = f"s AS (SELECT '1' AS qid, ext_id, CAST({'len(hits)' if model == 'RankedBoolean' else '1'} AS DOUBLE) AS score FROM {name})"
    return "WITH RECURSIVE " + _base(stop=stop) + ", " + cte + ", " + _ranked(s, k)


@query("near_ordered", _positional(_near_cte("m", "the", "and", 4), "m", "RankedBoolean"))
def near_ordered(spark, sf_dir):
    return _run(spark, sf_dir, {"1": near_query(["the", "and"], 4)}, "RankedBoolean")


@query("near_stopword_gap", _positional(_near_cte("m", "the", "that", 2), "m", "RankedBoolean", "'of', 'and', 'to'"))
def near_stopword_gap(spark, sf_dir):
    return _run(spark, sf_dir, {"1": "#near/2( the of that )"}, "RankedBoolean", analyzer=Analyzer(frozenset({"of", "and", "to"})))


@query("near_bm25", _positional(_near_cte("m", "the", "and", 3), "m", "BM25"))
def near_bm25(spark, sf_dir):
    return _run(spark, sf_dir, {"1": "#near/3( the and )"})


@query("window_unordered", _positional(_window_cte("m", "the", "that", 6), "m", "RankedBoolean"))
def window_unordered(spark, sf_dir):
    return _run(spark, sf_dir, {"1": "#window/6( the that )"}, "RankedBoolean")


@query("window_bm25", _positional(_window_cte("m", "de", "la", 8), "m", "BM25"))
def window_bm25(spark, sf_dir):
    return _run(spark, sf_dir, {"1": "#window/8( de la )"})


_THREE = "FROM post x JOIN post y USING (ext_id, field) JOIN post z USING (ext_id, field) WHERE x.term = 'the' AND y.term = 'and' AND z.term = 'of'"
_NEAR3 = f"""m_w(ext_id, p, r, q, i, u2, u3, hits) AS (SELECT x.ext_id, x.positions, y.positions, z.positions, 1, -1, -1, CAST([] AS BIGINT[]) {_THREE}
UNION ALL SELECT ext_id, p, r, q, i + 1, CASE WHEN ok THEN c2 ELSE u2 END, CASE WHEN ok THEN c3 ELSE u3 END, CASE WHEN ok THEN list_append(hits, c3) ELSE hits END FROM (SELECT *, coalesce(c2 - p[i] <= 12 AND c3 - c2 <= 12, false) AS ok FROM (SELECT *, list_min(list_filter(q, lambda v: v > c2 AND v > u3)) AS c3 FROM (SELECT *, list_min(list_filter(r, lambda v: v > p[i] AND v > u2)) AS c2 FROM m_w WHERE i <= len(p))))),
m AS (SELECT ext_id, hits FROM m_w WHERE i = len(p) + 1 AND len(hits) > 0)"""
_WINDOW3 = f"""m_w(ext_id, p, r, q, i, j, k, hits) AS (SELECT x.ext_id, x.positions, y.positions, z.positions, 1, 1, 1, CAST([] AS BIGINT[]) {_THREE}
UNION ALL SELECT ext_id, p, r, q, i + CAST(ok OR p[i] = lo AS INTEGER), j + CAST(ok OR (r[j] = lo AND p[i] <> lo) AS INTEGER), k + CAST(ok OR (q[k] = lo AND p[i] <> lo AND r[j] <> lo) AS INTEGER), CASE WHEN ok THEN list_append(hits, hi) ELSE hits END FROM (SELECT *, hi - lo < 12 AS ok FROM (SELECT *, least(p[i], r[j], q[k]) AS lo, greatest(p[i], r[j], q[k]) AS hi FROM m_w WHERE i <= len(p) AND j <= len(r) AND k <= len(q)))),
m AS (SELECT ext_id, hits FROM m_w WHERE (i > len(p) OR j > len(r) OR k > len(q)) AND len(hits) > 0)"""


@query("near_three_terms", _positional(_NEAR3, "m", "RankedBoolean"))
def near_three_terms(spark, sf_dir):
    return _run(spark, sf_dir, {"1": "#near/12( the and of )"}, "RankedBoolean")


@query("window_three_terms", _positional(_WINDOW3, "m", "RankedBoolean"))
def window_three_terms(spark, sf_dir):
    return _run(spark, sf_dir, {"1": "#window/12( the and of )"}, "RankedBoolean")


_SYN = "m AS (SELECT ext_id, list_distinct(flatten(list(positions))) AS hits FROM post WHERE term IN ('ention', 'inst', 'eden') GROUP BY ext_id)"


@query("syn_bm25", _positional(_SYN, "m", "BM25"))
def syn_bm25(spark, sf_dir):
    return _run(spark, sf_dir, {"1": "#sum( #syn( ention inst eden ) )"})


@query("syn_unranked", _positional(_SYN, "m", "UnrankedBoolean", k=30))
def syn_unranked(spark, sf_dir):
    return _run(spark, sf_dir, {"1": "#syn( ention inst eden )"}, "UnrankedBoolean", 30)


def _sdm_sql() -> str:
    parts = [("n1", 0.2), ("w1", 0.1)]
    s = f"q AS {_values([('the',), ('and',)], 'term')}, t AS (SELECT ext_id, 0.7 * sum({_bm25()}) AS v FROM q JOIN post USING (term) JOIN lex USING (field, term) JOIN fl USING (field, ext_id) JOIN st USING (field) GROUP BY ext_id)"
    for name, w in parts:
        s += f", v_{name} AS (SELECT ext_id, {w} * {_bm25(tf='len(hits)', df=f'(SELECT count(*) FROM {name})')} AS v FROM {name} JOIN fl USING (ext_id) JOIN st USING (field))"
    s += ", s AS (SELECT '1' AS qid, ext_id, sum(v) AS score FROM (SELECT * FROM t UNION ALL SELECT * FROM v_n1 UNION ALL SELECT * FROM v_w1) GROUP BY ext_id)"
    return "WITH RECURSIVE " + _base() + ", " + _near_cte("n1", "the", "and", 1) + ", " + _window_cte("w1", "the", "and", 8) + ", " + _ranked(s)


@query("bm25_sdm", _sdm_sql())
def bm25_sdm(spark, sf_dir):
    return _run(spark, sf_dir, {"1": sdm_query(["the", "and"])})


# index inspection -----------------------------------------------------------------------------------
@query("index_stats", "WITH " + _base(True) + " SELECT field, doc_count, CAST(sum_len AS BIGINT) AS sum_len, n_docs, round(sum_len / doc_count, 6) AS avg_len FROM st")
def index_stats(spark, sf_dir):
    return pages_index(spark, sf_dir).stats().withColumn("avg_len", F.round(F.col("sum_len") / F.col("doc_count"), 6))


@query("index_terms", "WITH " + _base() + " SELECT field, term, df, CAST(ctf AS BIGINT) AS ctf FROM lex")
def index_terms(spark, sf_dir):
    return documents_index(spark, sf_dir).lexicon()


@query("index_postings_sample", "WITH " + _base() + " SELECT field, term, ext_id, CAST(tf AS INTEGER) AS tf, array_to_string(positions, ',') AS positions FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY CAST(ext_id AS BIGINT)) AS n FROM post WHERE term IN ('the', 'de', 'ention')) WHERE n <= 5")
def index_postings_sample(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    rows = index.postings(spark.createDataFrame([("body", t) for t in ("the", "de", "ention")], "field string, term string"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("term").orderBy(F.col("ext_id").cast("long")))).where("n <= 5")
    return rows.select("field", "term", "ext_id", "tf", F.array_join("positions", ",").alias("positions"))


@query("index_termvector", "WITH " + _base(True) + " SELECT ext_id, field, term, CAST(tf AS INTEGER) AS tf, array_to_string(positions, ',') AS positions FROM post")
def index_termvector(spark, sf_dir):
    return pages_index(spark, sf_dir).term_vector().withColumn("positions", F.array_join("positions", ","))


@query("doc_lengths", "WITH " + _base(stop="'the', 'and', 'of'") + " SELECT field, ext_id, CAST(len AS INTEGER) AS len, CAST(pos_len AS INTEGER) AS pos_len, CAST(indexed AS INTEGER) AS indexed FROM fl")
def doc_lengths(spark, sf_dir):
    return documents_index(spark, sf_dir, Analyzer(frozenset({"the", "and", "of"}))).lengths()


@query("duplicate_ids", "SELECT ext_id, count(*) AS n FROM (SELECT CAST(doc_id AS VARCHAR) AS ext_id FROM documents UNION ALL SELECT CAST(page_id AS VARCHAR) FROM pages) GROUP BY ext_id HAVING count(*) > 1")
def duplicate_external_ids(spark, sf_dir):
    """Ids that documents and pages both have, as if they were one collection."""
    return duplicate_ids(documents_index(spark, sf_dir).docs.select("ext_id").union(pages_index(spark, sf_dir).docs.select("ext_id")))


@query("stored_attributes", "SELECT CAST(page_id AS VARCHAR) AS ext_id, url AS raw_url, CAST(length(html) AS DOUBLE) AS page_rank, " + _PAGE["title"] + " AS title FROM pages")
def stored_attributes(spark, sf_dir):
    return pages_index(spark, sf_dir).docs.select("ext_id", "raw_url", "page_rank", "title")


# files --------------------------------------------------------------------------------------------------
_NONE = {"1": "ention inst", "9": "zzzzqqqq"}


@query("run_file_format", f"SELECT q.qid, coalesce(rank, 1) AS rank, format('{{}} Q0 {{}} {{}} {{:.12f}} reference', q.qid, coalesce(ext_id, 'Nonexistent_Docid'), coalesce(rank, 1), coalesce(score, 0.0)) AS line FROM (VALUES ('1'), ('9')) q(qid) LEFT JOIN ({_bm25_sum(_NONE)}) r USING (qid)")
def run_file_format(spark, sf_dir):
    return files.run_lines(spark.createDataFrame(list(_NONE.items()), "qid string, qstring string"), _run(spark, sf_dir, _NONE), TOP)


# feedback -------------------------------------------------------------------------------------------------
_FED = {"1": "ention inst", "2": "de la"}


def _feedback_sql(how: str) -> str:
    top = f"r AS (SELECT * FROM ({_bm25_sum(_FED, 5)}))"
    if how == "okapi":
        s = "f AS (SELECT qid, term, count(DISTINCT ext_id) * greatest(0.0, ln((any_value(n_docs) - any_value(df) + 0.5) / (any_value(df) + 0.5))) AS score FROM r JOIN post USING (ext_id) JOIN lex USING (field, term) JOIN st USING (field) WHERE regexp_matches(term, '^[\\x00-\\x7F]*$') GROUP BY qid, term)"
    else:
        s = "f AS (SELECT qid, term, sum(greatest(0.0, tf / pos_len * r.score * ln(sum_len / ctf))) AS score FROM r JOIN post USING (ext_id) JOIN lex USING (field, term) JOIN fl USING (field, ext_id) JOIN st USING (field) WHERE regexp_matches(term, '^[\\x00-\\x7F]*$') GROUP BY qid, term)"
    return f"{top}, {s}, g AS (SELECT qid, term, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, term) AS INTEGER) AS rank FROM f WHERE round(score, 6) > 0)"


def _feedback(spark, sf_dir, how):
    return feedback.feedback_terms(documents_index(spark, sf_dir), _run(spark, sf_dir, _FED, k=5), how, 5, 8, digits=6)


for _how in ("okapi", "rm3"):
    QUERIES[f"prf_{_how}_terms"] = lambda spark, sf_dir, how=_how: _feedback(spark, sf_dir, how)
    SQL[f"prf_{_how}_terms"] = "WITH " + _base() + ", " + _feedback_sql(_how) + " SELECT qid, term, score, rank FROM g WHERE rank <= 8"


@query("prf_rm3_second_pass", "WITH " + _base() + ", " + _feedback_sql("rm3") + f", w AS (SELECT qid, term, score / sum(score) OVER (PARTITION BY qid) AS w FROM g WHERE rank <= 8), " + _ranked(f"s AS (SELECT qid, ext_id, sum(w * {_bm25()}) AS score FROM w JOIN post USING (term) JOIN lex USING (field, term) JOIN fl USING (field, ext_id) JOIN st USING (field) GROUP BY qid, ext_id)"))
def prf_rm3_second_pass(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    terms = feedback.weighted(_feedback(spark, sf_dir, "rm3"), "rm3")
    return retrieval.top(retrieval.weighted_terms(index, terms, retrieval.Model()), TOP, DIGITS)


@query("prf_okapi_query", "WITH " + _base() + ", " + _feedback_sql("okapi") + " SELECT qid, '#SUM( ' || string_agg(term, ' ' ORDER BY score, term) || ' )' AS qstring FROM g WHERE rank <= 8 GROUP BY qid")
def prf_okapi_query(spark, sf_dir):
    queries = spark.createDataFrame(list(_FED.items()), "qid string, qstring string")
    return feedback.expanded(queries, _feedback(spark, sf_dir, "okapi"), "okapi")


# learning to rank --------------------------------------------------------------------------------------------
_LTR = {"1": "the that and", "2": "de la de", "3": "der"}
_FEATURES = ltr.ALL_FEATURES


def _ltr_sql() -> str:
    uniq = _values([(q, t) for q, text in _LTR.items() for t in dict.fromkeys(text.split())], "qid, term")
    pairs = _values([(q, i, a, b) for q, text in _LTR.items() for i, (a, b) in enumerate(zip(text.split(), text.split()[1:]))], "qid, i, a, b")
    n_pairs = {q: max(len(t.split()) - 1, 0) for q, t in _LTR.items()}
    grid = f"""u AS {uniq}, c AS (SELECT DISTINCT qid, ext_id FROM u JOIN post USING (term) WHERE field = 'body'),
g AS (SELECT c.qid, c.ext_id, fl.field, u.term, coalesce(p.tf, 0) AS tf, p.positions, coalesce(df, 0) AS df, coalesce(ctf, 0) AS ctf, len, indexed, doc_count, sum_len, n_docs FROM c JOIN u USING (qid) JOIN fl USING (ext_id) JOIN st USING (field) LEFT JOIN lex ON lex.field = fl.field AND lex.term = u.term LEFT JOIN post p ON p.field = fl.field AND p.term = u.term AND p.ext_id = c.ext_id WHERE fl.field <> 'keywords'),
f AS (SELECT qid, ext_id, field, sum(CASE WHEN tf > 0 THEN {_bm25()} ELSE 0 END) AS bm, CAST(count_if(tf > 0) AS DOUBLE) AS ov, CASE WHEN max(tf) > 0 AND min((tf + 2500.0 * ctf / sum_len) / (len + 2500.0)) > 0 THEN exp(avg(CASE WHEN (tf + 2500.0 * ctf / sum_len) > 0 THEN ln((tf + 2500.0 * ctf / sum_len) / (len + 2500.0)) END)) ELSE 0.0 END AS ql, sum(tf) / any_value(len) AS dens, CAST(count_if(len(list_filter(positions, lambda x: x < 100)) > 0) AS DOUBLE) AS early FROM g WHERE indexed > 0 GROUP BY qid, ext_id, field),
ph AS (SELECT x.qid, x.ext_id, count(*) AS n FROM c x JOIN {pairs} t ON t.qid = x.qid JOIN post a ON a.ext_id = x.ext_id AND a.field = 'body' AND a.term = t.a JOIN post b ON b.ext_id = x.ext_id AND b.field = 'body' AND b.term = t.b WHERE list_has_any(list_transform(a.positions, lambda p: p + 1), b.positions) GROUP BY x.qid, x.ext_id)"""
    cols = ["CAST(NULL AS DOUBLE) AS f1", "CAST(length(url) - length(replace(url, '/', '')) AS DOUBLE) AS f2", "CAST(contains(lower(url), 'wikipedia.org') AS DOUBLE) AS f3", "CAST(any_value(length(html)) AS DOUBLE) AS f4".replace("any_value(length(html))", "length(html)")]
    pick = lambda f, v: f"max(CASE WHEN field = '{f}' THEN {v} END)"
    agg = [f"round({pick(f, v)}, 6) AS f{n}" for f, ns in ltr.FIELD_FEATURES.items() for n, v in zip(ns, ("bm", "ql", "ov"))]
    agg += [f"round({pick('body', 'dens')}, 6) AS f17", f"{pick('body', 'early')} AS f20"]
    f19 = " + ".join(f"CAST(coalesce({pick(f, 'bm')}, 0) > 0 AS DOUBLE)" for f in ltr.FIELD_FEATURES)
    case = " ".join(f"WHEN '{q}' THEN {n}" for q, n in n_pairs.items())
    return "WITH " + _base(True) + ", " + grid + f", m AS (SELECT qid, ext_id, {', '.join(agg)}, ({f19}) / 4 AS f19 FROM f GROUP BY qid, ext_id), v AS (SELECT m.qid, m.ext_id, {', '.join(cols)}, m.* EXCLUDE (qid, ext_id), round(CASE WHEN (CASE m.qid {case} END) > 0 THEN coalesce(ph.n, 0) / (CASE m.qid {case} END) ELSE 0.0 END, 6) AS f18 FROM m JOIN pages ON CAST(page_id AS VARCHAR) = m.ext_id LEFT JOIN ph ON ph.qid = m.qid AND ph.ext_id = m.ext_id)"


def _ltr_vectors(spark, sf_dir):
    index = pages_index(spark, sf_dir)
    asked = spark.createDataFrame([(q, "body", t) for q, text in _LTR.items() for t in text.split()], "qid string, field string, term string")
    candidates = index.postings(asked).join(F.broadcast(asked), ["field", "term"]).select("qid", "ext_id").distinct()
    found = ltr.features(index, _LTR, candidates)
    return found.select("qid", "ext_id", *((F.round(f"f{n}", 6) if n in (5, 6, 8, 9, 11, 12, 14, 15, 17, 18) else F.col(f"f{n}")).alias(f"f{n}") for n in _FEATURES))


@query("ltr_features", _ltr_sql() + f" SELECT qid, ext_id, {', '.join(f'f{n}' for n in _FEATURES)} FROM v")
def ltr_features(spark, sf_dir):
    return _ltr_vectors(spark, sf_dir)


@query("ltr_minmax", _ltr_sql() + " SELECT qid, ext_id, " + ", ".join(f"round(coalesce(CASE WHEN max(f{n}) OVER w > min(f{n}) OVER w THEN (f{n} - min(f{n}) OVER w) / (max(f{n}) OVER w - min(f{n}) OVER w) END, 0.0), 5) AS f{n}" for n in _FEATURES) + " FROM v WINDOW w AS (PARTITION BY qid)")
def ltr_minmax(spark, sf_dir):
    out = ltr.minmax(_ltr_vectors(spark, sf_dir))
    return out.select("qid", "ext_id", *(F.round(f"f{n}", 5).alias(f"f{n}") for n in _FEATURES))


@query("ltr_rerank_scores", _ltr_sql() + ", " + _ranked("s AS (SELECT qid, ext_id, coalesce(f5, 0) + 2 * coalesce(f7, 0) + 0.5 * coalesce(f8, 0) + 3 * coalesce(f18, 0) AS score FROM v)"))
def ltr_rerank_scores(spark, sf_dir):
    return retrieval.top(ltr.linear_scores(_ltr_vectors(spark, sf_dir), (1.0, 2.0, 0.5, 3.0), (5, 7, 8, 18)), TOP, DIGITS)


_PAGE_QRELS = "SELECT qid, ext_id, CASE WHEN f10 > 0 THEN 2 WHEN f7 > 1 THEN 1 ELSE -2 END AS rel FROM v"


def _page_qrels(vectors):
    """Judgments for every candidate: pages with query words in the title, then those with several in the body."""
    return vectors.select("qid", "ext_id", F.when(F.col("f10") > 0, 2).when(F.col("f7") > 1, 1).otherwise(-2).alias("rel"))


@query("ltr_training_pairs", _ltr_sql() + f", l AS (SELECT v.*, greatest(rel, 0) AS label FROM v JOIN ({_PAGE_QRELS}) USING (qid, ext_id)) SELECT a.qid, a.ext_id AS better, b.ext_id AS worse, CAST(round((coalesce(a.f5, 0) - coalesce(b.f5, 0)) * 1000000) AS BIGINT) AS d5, CAST(round((coalesce(a.f17, 0) - coalesce(b.f17, 0)) * 1000000) AS BIGINT) AS d17 FROM l a JOIN l b ON a.qid = b.qid AND a.label > b.label")
def ltr_training_pairs(spark, sf_dir):
    vectors = _ltr_vectors(spark, sf_dir)
    pairs = ltr.preference_pairs(ltr.training_rows(vectors, _page_qrels(vectors)), (5, 17))
    return pairs.select("qid", "better", "worse", *(F.round(F.col(c) * 1_000_000).cast("long").alias(c) for c in ("d5", "d17")))


def _trained(spark, sf_dir, name):
    raw = _ltr_vectors(spark, sf_dir)
    vectors = ltr.minmax(raw)
    weights = ltr.TRAINERS[name](ltr.training_rows(vectors, _page_qrels(raw)))
    return retrieval.top(ltr.linear_scores(vectors, weights), TOP, DIGITS)


for _trainer in ltr.TRAINERS:
    QUERIES[f"ltr_train_{_trainer}"] = lambda spark, sf_dir, t=_trainer: _trained(spark, sf_dir, t)


# fusion and reranking ------------------------------------------------------------------------------------------
_ONE, _TWO = {"1": "the that and", "2": "ention inst"}, {"1": "was with", "2": "eden inst"}


def _fusion_sql(key: str) -> str:
    return f"WITH a AS (SELECT * FROM ({_bm25_sum(_ONE)})), b AS (SELECT * FROM ({_bm25_sum(_TWO)})), m AS (SELECT qid, ext_id, min({key}) AS k FROM (SELECT *, 0 AS src FROM a UNION ALL SELECT *, 1 AS src FROM b) GROUP BY qid, ext_id), r AS (SELECT qid, ext_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY k, ext_id) AS INTEGER) AS rank FROM m) SELECT qid, rank, ext_id, CAST(count(*) OVER (PARTITION BY qid) - rank + 1 AS DOUBLE) AS score FROM r WHERE rank <= 15"


for _method, _key in (("union", "src * 100000 + rank"), ("interleave", "2 * (rank - 1) + src")):
    QUERIES[f"fusion_{_method}"] = lambda spark, sf_dir, m=_method: reranking.fuse(_run(spark, sf_dir, _ONE), _run(spark, sf_dir, _TWO), m, max_output=15)
    SQL[f"fusion_{_method}"] = _fusion_sql(_key)


@query("rerank_tail_merge", f"WITH o AS (SELECT * FROM ({_bm25_sum(_ONE, 20)})), n AS (SELECT qid, ext_id, -score AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY -score DESC, ext_id) AS INTEGER) AS rank FROM o WHERE rank <= 5), z AS (SELECT qid, count(*) AS n, min(score) AS least FROM n GROUP BY qid), t AS (SELECT o.qid, ext_id, o.score, rank, greatest(0.0, max(CASE WHEN rank = n + 1 THEN o.score END) OVER (PARTITION BY o.qid) + 0.1 - least) AS shift FROM o JOIN z USING (qid) WHERE rank > n) SELECT qid, rank, ext_id, round(score, 6) AS score FROM n UNION ALL SELECT qid, rank, ext_id, round(score - shift, 6) FROM t")
def rerank_tail_merge(spark, sf_dir):
    old = _run(spark, sf_dir, _ONE, k=20)
    new = retrieval.top(old.where("rank <= 5").select("qid", "ext_id", (-F.col("score")).alias("score")), 5)
    return reranking.merge_reranked(old, new).withColumn("score", F.round("score", 6))


@query("dense_topk", "WITH s AS (SELECT CAST(q.vec_id AS VARCHAR) AS qid, CAST(v.vec_id AS VARCHAR) AS ext_id, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0) SELECT qid, rank, ext_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, ext_id) AS INTEGER) AS rank FROM s) WHERE rank <= 10")
def dense_topk(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("vec_id").cast("string").alias("ext_id"), F.col("embedding").alias("vector"))
    asked = rows.where("vec_id % 20 = 0").select(F.col("ext_id").alias("qid"), "vector")  # the stated query set, against all rows
    return reranking.dense_top(asked, rows, 10, 6)


# passages, prompts, answers ---------------------------------------------------------------------------------------
_WORDS_SQL = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
_PSG = f"p AS (SELECT ext_id, unnest(range(n)) AS psg_no, w FROM (SELECT CAST(doc_id AS VARCHAR) AS ext_id, w, CASE WHEN len(w) <= 75 THEN 1 ELSE CAST(ceil((len(w) - 75) / 60.0) AS BIGINT) + 1 END AS n FROM (SELECT doc_id, {_WORDS_SQL} AS w FROM documents))), ps AS (SELECT ext_id, CAST(psg_no AS INTEGER) AS psg_no, array_to_string(w[psg_no * 60 + 1 : psg_no * 60 + 75], ' ') AS passage FROM p)"


def _passage_rows(spark, sf_dir):
    docs = documents_index(spark, sf_dir).docs
    made = P.passages(F.lit(""), F.col("body"), 75, 60, None)
    return docs.select("ext_id", F.posexplode(made).alias("psg_no", "passage"))


@query("passage_windows", f"WITH {_PSG} SELECT * FROM ps")
def passage_windows(spark, sf_dir):
    return _passage_rows(spark, sf_dir)


@query("passage_firstp_avgp_maxp", f"WITH {_PSG}, x AS (SELECT ext_id, psg_no, CAST(length(passage) % 17 AS DOUBLE) AS score FROM ps) SELECT '1' AS qid, ext_id, first(score ORDER BY psg_no) AS firstp, round(avg(score), 6) AS avgp, max(score) AS maxp FROM x GROUP BY ext_id")
def passage_firstp_avgp_maxp(spark, sf_dir):
    rows = _passage_rows(spark, sf_dir).select(F.lit("1").alias("qid"), "ext_id", "psg_no", (F.length("passage") % 17).cast("double").alias("score"))
    parts = [reranking.passage_scores(rows, how).withColumnRenamed("score", how) for how in ("firstp", "avgp", "maxp")]
    return parts[0].join(parts[1], ["qid", "ext_id"]).join(parts[2], ["qid", "ext_id"]).withColumn("avgp", F.round("avgp", 6))


@query("best_passage", f"WITH {_PSG} SELECT ext_id, arg_max(passage, (length(passage) % 17) * 1000 - psg_no) AS passage FROM ps GROUP BY ext_id")
def best_passage(spark, sf_dir):
    docs = documents_index(spark, sf_dir).docs.select("ext_id", P.passages(F.lit(""), F.col("body"), 75, 60, None).alias("p"))
    return docs.select("ext_id", P.best_passage(F.col("p"), F.transform("p", lambda x: F.length(x) % 17)).alias("passage"))


@query("prompt_build", "SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS qid, 'You answer questions.' AS system_text, 'Answer the question from the context.' || chr(10) || 'Context: ' || coalesce(text, '') || chr(10) || 'Question: ' || coalesce(first(text) OVER (PARTITION BY conv_id ORDER BY turn), '') || chr(10) || 'Answer:' AS user_text FROM conversations")
def prompt_build(spark, sf_dir):
    """Every turn as the passage of a prompt that asks its conversation's first turn."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("asked", F.first("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    made = rows.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("qid"), P.capped_prompt(F.coalesce("asked", F.lit("")), F.array(F.coalesce("text", F.lit(""))), 1).alias("p"))
    return made.select("qid", F.col("p")[0]["content"].alias("system_text"), F.col("p")[1]["content"].alias("user_text"))


_BLANK = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
_LABELS = "'answer:', 'short answer:', 'final answer:', 'exact answer:'"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


_REPLY_SQL = f"""WITH a AS (SELECT conv_id, turn, {_strip("coalesce(text, '')")} AS text FROM conversations),
b AS (SELECT *, list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: {_strip("x")}), lambda x: x <> '') AS ls FROM a),
c AS (SELECT *, CASE WHEN len(ls) > 1 AND lower(ls[1]) IN ({_LABELS}) THEN ls[2] ELSE coalesce(ls[1], '') END AS l0 FROM b),
d AS (SELECT *, CASE WHEN lower(l0) LIKE 'answer:%' THEN substr(l0, 8) WHEN lower(l0) LIKE 'short answer:%' OR lower(l0) LIKE 'final answer:%' OR lower(l0) LIKE 'exact answer:%' THEN substr(l0, 14) ELSE l0 END AS l1 FROM c),
e AS (SELECT *, {_strip("l1")} AS l FROM d)
SELECT conv_id, turn, CASE WHEN text LIKE 'EXCEPTION::%' THEN text WHEN length(l) >= 2 AND l[1] = l[-1] AND l[1] IN ('"', chr(39)) THEN {_strip("substr(l, 2, length(l) - 2)")} ELSE l END AS answer FROM e"""


@query("answer_normalize", _REPLY_SQL)
def answer_normalize(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select("conv_id", "turn", cleaned_reply(F.col("text")).alias("answer"))


_ALONE = r"'(^|[^\p{{L}}\p{{N}}])(a|an|the)([^\p{{L}}\p{{N}}]|$)', '\1 \3', 'g'"
#: Articles are taken off twice, since each takes the separator that the next one needs.
_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(replace({0}, '_', ' ')), '[!-/:-@\[-`{{-~‘’´]', ' ', 'g'), " + _ALONE + "), " + _ALONE + r"), '[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+', ' ', 'g'))"


def _qa(spark, sf_dir):
    """Each conversation's last turn as the answer, its earlier turns as truths."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text IS NOT NULL").select("turn", F.col("conv_id").cast("string").alias("qid"), "text")
    said = rows.groupBy("qid").agg(F.max_by("text", "turn").alias("answer"), F.max("turn").alias("last"))
    truths = rows.join(said.select("qid", "last"), "qid").where("turn < last").select("qid", F.col("text").alias("truth"))
    return evaluation.answer_scores(said, truths)


_QA_SQL = f"""WITH c AS (SELECT conv_id, turn, text, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations WHERE text IS NOT NULL), a AS (SELECT conv_id, {_NORM.format("text")} AS p FROM c WHERE turn = last),
t AS (SELECT conv_id, {_NORM.format("text")} AS t FROM c WHERE turn < last),
x AS (SELECT conv_id, p, t, list_filter(string_split(p, ' '), lambda z: z <> '') AS pw, list_filter(string_split(t, ' '), lambda z: z <> '') AS tw FROM a LEFT JOIN t USING (conv_id)),
y AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(pw), lambda z: least(len(list_filter(pw, lambda v: v = z)), len(list_filter(tw, lambda v: v = z))))), 0) AS same FROM x),
e AS (SELECT CAST(conv_id AS VARCHAR) AS qid, max(coalesce(CAST(p = t AS DOUBLE), 0.0)) AS em, max(coalesce(CASE WHEN same > 0 THEN 2.0 * same / (len(pw) + len(tw)) ELSE 0.0 END, 0.0)) AS f1, max(coalesce(CAST(t <> '' AND contains(p, t) AS DOUBLE), 0.0)) AS oracle FROM y GROUP BY conv_id)"""


@query("qa_em_f1", _QA_SQL + " SELECT qid, em, round(f1, 6) AS f1, oracle FROM e")
def qa_em_f1(spark, sf_dir):
    return _qa(spark, sf_dir).withColumn("f1", F.round("f1", 6))


@query("qa_report", _QA_SQL + " SELECT round(avg(em) * 100, 4) AS exact_match, round(avg(f1) * 100, 4) AS f1, round(avg(oracle) * 100, 4) AS oracle, count(*) AS n FROM e")
def qa_report(spark, sf_dir):
    out = evaluation.answer_report(_qa(spark, sf_dir))
    return out.select(*(F.round(c, 4).alias(c) for c in ("exact_match", "f1", "oracle")), "n")


# retrieval metrics -------------------------------------------------------------------------------------------------
def _judged(spark, sf_dir):
    """Graded judgments for every query: good documents, those that aren't toxic above the others."""
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("string").alias("ext_id"), F.when(F.col("quality") == 1, 2 - F.col("toxic")).otherwise(0).alias("rel"))
    return rows.select(F.explode(F.array(*(F.lit(q) for q in WORDS))).alias("qid"), "ext_id", "rel")


def _metrics_sql(run: str) -> str:
    return f"""run AS ({run}), qr AS (SELECT qid, CAST(doc_id AS VARCHAR) AS ext_id, CASE WHEN quality = 1 THEN 2 - toxic ELSE 0 END AS rel FROM labels, (VALUES ('1'), ('2'), ('3'), ('4'), ('5')) q(qid)),
nd AS (SELECT qid, count(*) AS n_rel, list(rel ORDER BY rel DESC) AS ideal FROM qr WHERE rel > 0 GROUP BY qid),
rk AS (SELECT run.qid, run.ext_id, row_number() OVER (PARTITION BY run.qid ORDER BY score DESC, run.ext_id DESC) AS r, coalesce(rel, 0) AS rel FROM run LEFT JOIN qr ON qr.qid = run.qid AND qr.ext_id = run.ext_id),
rh AS (SELECT *, CAST(rel > 0 AS INTEGER) AS hit, sum(CAST(rel > 0 AS INTEGER)) OVER (PARTITION BY qid ORDER BY r) AS hits FROM rk),
ag AS (SELECT nd.qid, n_rel, coalesce(max(CASE WHEN hit = 1 THEN 1.0 / r END), 0) AS recip_rank, coalesce(sum(CASE WHEN hit = 1 THEN hits / r END), 0) / n_rel AS map, coalesce(sum(CASE WHEN r <= 10 THEN hit END), 0) / 10.0 AS p10, coalesce(sum(CASE WHEN r <= 100 THEN hit END), 0) / n_rel AS rec, coalesce(sum(CASE WHEN r <= 10 THEN rel / log2(r + 1) END), 0) / list_sum(list_transform(ideal[1:10], lambda x, i: x / log2(i + 1))) AS nd10 FROM nd LEFT JOIN rh USING (qid) GROUP BY nd.qid, n_rel, ideal),
ev AS (SELECT unnest([{{'metric': 'recip_rank', 'value': recip_rank}}, {{'metric': 'map', 'value': map}}, {{'metric': 'P_10', 'value': p10}}, {{'metric': 'recall_100', 'value': rec}}, {{'metric': 'ndcg_cut_10', 'value': nd10}}], recursive := true), qid FROM ag)"""


def _metrics(spark, sf_dir, run):
    return evaluation.run_metrics(run, _judged(spark, sf_dir)).where(F.col("metric").isin("recip_rank", "map", "P_10", "recall_100", "ndcg_cut_10"))


@query("eval_metrics", f"WITH {_metrics_sql(_bm25_sum(WORDS, 100))} SELECT metric, qid, round(value, 6) AS value FROM ev UNION ALL SELECT metric, 'all', round(avg(value), 6) FROM ev GROUP BY metric")
def eval_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir, _run(spark, sf_dir, WORDS, k=100)).withColumn("value", F.round("value", 6))


@query("eval_wtl", f"SELECT count_if(k = 'win') AS wins, count_if(k = 'tie') AS ties, count_if(k = 'loss') AS losses FROM (SELECT CASE WHEN b = 0 THEN CASE WHEN n > 0 THEN 'win' ELSE 'tie' END WHEN (n - b) / b >= 0.02 THEN 'win' WHEN (n - b) / b <= -0.02 THEN 'loss' ELSE 'tie' END AS k FROM (WITH {_metrics_sql(_bm25_sum(WORDS, 100, 0.75, 0.3))} SELECT qid, value AS n FROM ev WHERE metric = 'map') JOIN (WITH {_metrics_sql(_bm25_sum(WORDS, 100))} SELECT qid, value AS b FROM ev WHERE metric = 'map') USING (qid))")
def eval_wtl(spark, sf_dir):
    new, base = (_metrics(spark, sf_dir, _run(spark, sf_dir, WORDS, k=100, **a)) for a in ({"k1": 0.75, "b": 0.3}, {}))
    return evaluation.win_tie_loss(new, base)


@query("metrics_pivot", f"SELECT metric, qid, round(max(CASE WHEN file = 'a' THEN value END), 6) AS a, round(max(CASE WHEN file = 'b' THEN value END), 6) AS b FROM (SELECT 'a' AS file, * FROM (WITH {_metrics_sql(_bm25_sum(WORDS, 100))} SELECT metric, qid, value FROM ev) UNION ALL SELECT 'b' AS file, * FROM (WITH {_metrics_sql(_bm25_sum(WORDS, 100, 0.75, 0.3))} SELECT metric, qid, value FROM ev)) GROUP BY metric, qid")
def metrics_pivot(spark, sf_dir):
    a, b = (_metrics(spark, sf_dir, _run(spark, sf_dir, WORDS, k=100, **x)).where("qid <> 'all'").select(F.lit(n).alias("file"), "metric", "qid", "value") for n, x in (("a", {}), ("b", {"k1": 0.75, "b": 0.3})))
    out = evaluation.pivot_metrics(a.unionByName(b))
    return out.select("metric", "qid", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query("default_operator", _bm25_sum({"1": "ention inst eden"}))
def default_operator(spark, sf_dir):
    return _run(spark, sf_dir, {"1": default_query("ention inst eden", "BM25")})
