"""One query for each operator, over the driver's tables or the fixtures, with the same query as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..functions import times as M
from ..functions.fine_intents import FINE_INTENTS, fine_intents
from ..operators import compose, corpus, dense, evaluate, gate, priors, retrieve, sparse
from ..sources import chunks as C
from ..sources import index as I
from ..sources import sinks as K
from . import fixtures as X
from .lineage import cut

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, data, schema: str) -> DataFrame:
    return spark.createDataFrame(data, schema)


# ---- pieces of DuckDB SQL -------------------------------------------------------------------------------------

WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+"


def q_squeeze(x):
    return f"trim(regexp_replace({x}, '{WS}', ' ', 'g'))"


def q_folded(x, a="", b=""):
    marks = r"[\x{0617}-\x{061A}\x{064B}-\x{0652}\x{0670}\x{06D6}-\x{06ED}]"
    return f"translate(regexp_replace(replace(coalesce({x}, ''), '{T.TATWEEL}', ''), '{marks}', '', 'g'), '{T.HAMZA_IN}{a}{T.DIGITS_IN}،٫', '{T.HAMZA_OUT}{b}{T.DIGITS_OUT},.')"


def q_norm(x):
    return q_squeeze(rf"regexp_replace({q_folded(x, 'ة', 'ه')}, '\buni[0-9A-Fa-f]{{3,6}}\b', '', 'g')")


def q_clean(x):
    return rf"regexp_replace(regexp_replace(coalesce({x}, ''), '/uni[0-9A-Fa-f]{{4}}', '', 'g'), '[\x{{200b}}-\x{{200f}}]', '', 'g')"


def q_eval(x):
    return q_squeeze(q_clean(q_folded(x)))


def q_heading(x):
    marks = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{06D6}-\x{06ED}]"
    return q_squeeze(f"translate(regexp_replace(lower(coalesce({x}, '')), '{marks}', '', 'g'), 'إأآةى', 'اااهي')")


def q_strip(x):
    return f"regexp_replace({x}, '^{WS}|{WS}$', '', 'g')"


def q_split(x):
    cut = rf"string_split(regexp_replace(coalesce({x}, ''), '([.!?؟،\n]){WS}', '\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda p: {q_strip('p')}), lambda p: p <> '')"


def q_ratio(n):
    return rf"(length(regexp_replace({n}, '[^\p{{L}}]', '', 'g'))::DOUBLE / nullif(length(replace({n}, ' ', '')), 0))"


def q_junk(raw, n):
    return f"(length({n}) < 6 OR regexp_matches({raw}, '{T.RIGHTS}') OR coalesce({q_ratio(n)}, 1.0) < 0.5)"


def q_sentences(x):
    kept = f"list_filter({q_split(x)}, lambda s: NOT {q_junk('s', q_norm('s'))})"
    whole = q_strip(f"coalesce({x}, '')")
    return f"CASE WHEN len({kept}) > 0 THEN {kept} WHEN {whole} <> '' THEN [{whole}] ELSE []::VARCHAR[] END"


def q_any(x, words):
    return "(" + " OR ".join(f"contains({x}, {X.literal(w)})" for w in words) + ")"


def q_words(x):
    return rf"list_filter(string_split_regex(lower({x}), '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '')"


def q_digit(x):
    return rf"regexp_matches({x}, '\p{{Nd}}')"


def q_intent(n, rules=L.RULES, default="general"):
    return "CASE " + " ".join("WHEN " + " AND ".join(f"regexp_matches({n}, {X.literal(p)})" for p in ps) + f" THEN '{label}'" for label, ps in rules) + f" ELSE '{default}' END"


def q_by(intent, table, missing):
    return "CASE " + intent + " " + " ".join(f"WHEN '{k}' THEN {q_any('{x}', ws)}" for k, ws in table.items()) + f" ELSE {missing} END"


def q_ngrams(ws):
    two = f"CASE WHEN len({ws}) >= 2 THEN list_transform(range(1, len({ws})), lambda i: {ws}[i] || ' ' || {ws}[i + 1]) ELSE []::VARCHAR[] END"
    return f"list_concat({ws}, {two})"


def q_chars(t):
    of = lambda n: f"CASE WHEN length({t}) >= {n} THEN list_transform(range(1, length({t}) - {n} + 2), lambda i: substr({t}, i, {n})) ELSE []::VARCHAR[] END"
    return f"flatten([{', '.join(of(n) for n in range(2, 6))}])"


Q_CLOCK = r"[0-9]{1,2}(?::|\.)?[0-9]{0,2}"


def q_pairs(n, compat=False):
    to = "الى|إلى|حتي|حتى" + ("" if compat else "|الي|إلي")
    p = rf"(?:من\s*)?({Q_CLOCK})\s*(?:[-–—]|{to})\s*({Q_CLOCK})"
    return f"list_zip(regexp_extract_all({n}, '{p}', 1), regexp_extract_all({n}, '{p}', 2))"


def q_minutes(t):
    s = f"string_split(translate({t}, '.', ':'), ':')"
    return f"(TRY_CAST({s}[1] AS INT) * 60 + coalesce(TRY_CAST({s}[2] AS INT), 0))"


def q_clock(t):
    s = f"string_split(translate({t}, '.', ':'), ':')"
    return f"printf('%d:%02d', TRY_CAST({s}[1] AS INT), coalesce(TRY_CAST({s}[2] AS INT), 0))"


def q_ranges(n, hours, compat=False):
    """[{a, b}] as in times.ranges."""
    m = f"list_transform({q_pairs(n, compat)}, lambda p: {{'a': {q_minutes('p[1]')}, 'b': {q_minutes('p[2]')}}})"
    m = m if compat else f"list_filter({m}, lambda p: p.a < 1440 AND p.b < 1440)"
    f = f"list_transform({m}, lambda p: CASE WHEN p.b > p.a THEN p WHEN p.b + 720 > p.a THEN {{'a': p.a, 'b': p.b + 720}} ELSE {{'a': p.b, 'b': p.a}} END)"
    return f"list_filter({f}, lambda p: NOT ({hours}) OR (p.b - p.a BETWEEN 360 AND 660 AND p.a BETWEEN 360 AND 1230 AND p.b BETWEEN 360 AND 1230 AND p.b > p.a))"


def q_best(r):
    return f"list_min(list_transform({r}, lambda p: {{'k': abs((p.b - p.a) * 2 - 900), 'd': p.a - p.b, 'a': p.a, 'b': p.b}}))"


def q_hhmm(m):
    return f"printf('%d:%02d', ({m} // 60)::INT, ({m} % 60)::INT)"


def q_hours(intent, a, b):
    return f"'ساعات الدوام' || CASE WHEN {intent} = 'ramadan_hours' THEN ' في شهر رمضان' ELSE '' END || ' من ' || {a} || ' إلى ' || {b} || '.'"


# ---- text ------------------------------------------------------------------------------------------------------

NOISY = "id int, t string"


def _norm_query(fn):
    def run(spark, sf_dir):
        docs = read(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).alias("id"), F.col("text").alias("t"))
        return rows(spark, X.NOISY, NOISY).select(F.col("id").cast("long").alias("id"), "t").unionByName(docs).select("id", fn("t").alias("norm"))

    return run


for _name, _fn, _sql in (("norm_retrieval", T.norm_retrieval, q_norm), ("norm_eval", T.norm_eval, q_eval), ("norm_heading", T.norm_heading, q_heading)):
    QUERIES[_name] = _norm_query(_fn)
    SQL[_name] = f"SELECT id::BIGINT AS id, {_sql('t')} AS norm FROM (SELECT * FROM {X.values(X.NOISY, 'id, t')} UNION ALL SELECT doc_id + 1000, text FROM documents)"


@query(f"SELECT doc_id, unnest(ss) AS sentence, CAST(unnest(range(len(ss))) AS INT) AS ord FROM (SELECT doc_id, {q_split('text')} AS ss FROM documents)")
def sentence_split(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.split_sentences("text")).alias("ord", "sentence"))


@query(f"SELECT doc_id, unnest(ss) AS sentence, CAST(unnest(range(len(ss))) AS INT) AS ord FROM (SELECT doc_id, {q_sentences('text')} AS ss FROM documents)")
def sentence_clean(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.clean_sentences("text")).alias("ord", "sentence"))


@query(f"""
WITH s AS (SELECT lang, unnest({q_split('text')}) AS s FROM documents), n AS (SELECT lang, s, {q_norm('s')} AS n FROM s)
SELECT lang, count(*) AS sentences, count(*) FILTER (WHERE {q_junk('s', 'n')}) AS junk, round(avg({q_ratio('n')}), 6) AS letters FROM n GROUP BY lang""")
def junk_profile(spark, sf_dir):
    s = read(spark, sf_dir, "documents").select("lang", F.explode(T.split_sentences("text")).alias("s")).withColumn("n", T.norm_retrieval("s"))
    return s.groupBy("lang").agg(F.count("*").alias("sentences"), F.count(F.when(T.is_junk("s", F.col("n")), 1)).alias("junk"), F.round(F.avg(T.letter_ratio(F.col("n"))), 6).alias("letters"))


@query(f"""
SELECT id, {q_clean('t')} AS auto, translate({q_clean('t')}, '{T.RLE}{T.PDF}', '') AS off,
  CASE WHEN starts_with({q_clean('t')}, '{T.RLE}') AND ends_with({q_clean('t')}, '{T.PDF}') THEN {q_clean('t')} ELSE '{T.RLE}' || {q_clean('t')} || '{T.PDF}' END AS forced,
  translate({q_clean('t')}, '0123456789', '٠١٢٣٤٥٦٧٨٩') AS arabic
FROM (SELECT id, t FROM {X.values(X.NOISY, 'id, t')} UNION ALL SELECT 8, '{T.RLE}12 ab{T.PDF}')""")
def display_transform(spark, sf_dir):
    t = rows(spark, [*X.NOISY, (8, f"{T.RLE}12 ab{T.PDF}")], NOISY)
    return t.select("id", T.display("t").alias("auto"), T.display("t", "off").alias("off"), T.display("t", "force").alias("forced"), T.display("t", digits="arabic").alias("arabic"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS fp FROM documents")
def fingerprint(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.fingerprint(F.coalesce("text", F.lit(""))).alias("fp"))


# ---- sparse ----------------------------------------------------------------------------------------------------

Q_TF = f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({q_words(q_norm('text'))}) AS term FROM documents) GROUP BY doc_id, term"


def _docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "text", T.norm_retrieval("text").alias("norm"), F.floor(F.col("doc_id") / 10).cast("int").alias("page"))


@query(Q_TF)
def word_tf(spark, sf_dir):
    return corpus.term_counts(read(spark, sf_dir, "documents"))


@query(f"WITH tf AS ({Q_TF}), n AS (SELECT count(*) AS n FROM documents) SELECT term, count(*) AS df, round(ln((1.0 + any_value(n)) / (1.0 + count(*))) + 1, 6) AS idf FROM tf, n GROUP BY term")
def word_idf(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return sparse.idf_of(corpus.document_counts(d), d.agg(F.count("*").alias("n"))).withColumn("idf", F.round("idf", 6))


def q_tfidf(doc_terms: str, question_terms: str | None = None, source: str = "benchmark") -> str:
    sql = f"""tf AS (SELECT doc_id AS pos, term, count(*) AS tf FROM (SELECT doc_id, unnest({doc_terms}) AS term FROM (SELECT doc_id, {q_norm('text')} AS norm FROM documents)) GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM documents), idf AS (SELECT term, ln((1.0 + any_value(n)) / (1.0 + count(*))) + 1 AS idf FROM tf, n GROUP BY term),
x AS (SELECT pos, term, tf * idf AS x FROM tf JOIN idf USING (term)), dl AS (SELECT pos, sqrt(sum(x * x)) AS l FROM x GROUP BY pos),
dv AS (SELECT pos, term, x / l AS w FROM x JOIN dl USING (pos))"""
    if question_terms:
        sql += f""", qt AS (SELECT item_id AS qid, term, count(*) AS tf FROM (SELECT item_id, unnest({question_terms}) AS term FROM (SELECT item_id, {q_norm('text')} AS norm FROM {source})) GROUP BY 1, 2),
qx AS (SELECT qid, term, tf * idf AS x FROM qt JOIN idf USING (term)), ql AS (SELECT qid, sqrt(sum(x * x)) AS l FROM qx GROUP BY qid), qv AS (SELECT qid, term, x / l AS w FROM qx JOIN ql USING (qid)),
sc AS (SELECT qid, pos, sum(qv.w * dv.w) AS score FROM qv JOIN dv USING (term) GROUP BY 1, 2)"""
    return sql


Q_BIGRAMS = q_ngrams("ws")
Q_WORD_TERMS = f"(SELECT {Q_BIGRAMS} FROM (SELECT {q_words('norm')} AS ws))"
Q_CHAR_TERMS = q_chars("lower(norm)")


def _vectors(spark, sf_dir, terms):
    d = _docs(spark, sf_dir)
    counts = sparse.term_counts(d, "pos", terms)
    weights = sparse.idf(counts, d.agg(F.count("*").alias("n")))
    return sparse.tfidf(counts, weights, "pos"), weights


def _questions(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("q"), T.norm_retrieval("text").alias("norm"))


def _terms(kind):
    return _bigrams() if kind == "words" else T.char_ngrams(F.lower("norm"))


def _cosines(spark, sf_dir, kind, k=None, pairs=None):
    """At least the k best of each question, or the given pairs; of all that share a term where the corpus can't be gone through in blocks."""
    found = corpus.cosines(read(spark, sf_dir, "documents"), _questions(spark, sf_dir), kind, k, pairs)
    if found is not None:
        return found
    dv, weights = _vectors(spark, sf_dir, _terms(kind))
    qv = sparse.tfidf(sparse.term_counts(_questions(spark, sf_dir), "qid", _terms(kind)), weights, "qid")
    return sparse.cosine(qv, dv).withColumn("score", F.round("score", 6))


def _bigrams():
    return T.word_ngrams(T.words(F.col("norm")))


@query(f"WITH {q_tfidf(Q_WORD_TERMS)} SELECT pos, term, round(w, 6) AS w FROM dv")
def word_bigram_tfidf(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    if dict(d.dtypes)["doc_id"] not in corpus.WHOLE:
        return _vectors(spark, sf_dir, _bigrams())[0].withColumn("w", F.round("w", 6))
    return corpus.word_vectors(d)


def q_top(rel: str, k: int, score: str = "round(score, 6)") -> str:
    return f"SELECT qid, pos, {score} AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY {score} DESC, pos) AS INT) AS rk FROM {rel} QUALIFY rk <= {k}"


@query(f"WITH {q_tfidf(Q_CHAR_TERMS, Q_CHAR_TERMS)} {q_top('sc', 8)}")
def char_tfidf_topk(spark, sf_dir):
    return sparse.top(_cosines(spark, sf_dir, "chars", 8), 8).select("qid", "pos", "score", "rk")


@query(f"WITH {q_tfidf(Q_WORD_TERMS, Q_WORD_TERMS)} {q_top('sc', 8)}")
def sparse_topk(spark, sf_dir):
    return sparse.top(_cosines(spark, sf_dir, "words", 8), 8).select("qid", "pos", "score", "rk")


# ---- intents and times -----------------------------------------------------------------------------------------

Q_QUESTIONS = X.values(X.QUESTIONS, "qid, q")


def _asked(spark):
    return rows(spark, X.QUESTIONS, "qid int, q string").withColumn("intent", L.classify("q"))


@query(f"SELECT qid, {q_intent(q_norm('q'))} AS intent FROM {Q_QUESTIONS}")
def intent_classify(spark, sf_dir):
    return _asked(spark).select("qid", "intent")


@query(f"SELECT {q_intent(q_norm('text'), L.LATIN_RULES)} AS intent, role, count(*) AS n FROM conversations GROUP BY ALL")
def intent_histogram(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select(L.classify("text", L.LATIN_RULES).alias("intent"), "role").groupBy("intent", "role").agg(F.count("*").alias("n"))


Q_RANGE_TEXTS = f"(SELECT id, {q_norm('t')} AS n FROM {X.values(X.RANGE_TEXTS, 'id, t')})"


def _range_texts(spark):
    return rows(spark, X.RANGE_TEXTS, NOISY).withColumn("n", T.norm_retrieval("t"))


@query(f"""
SELECT id, hours, compat, unnest(r).a AS a, unnest(r).b AS b FROM (
  SELECT id, false AS hours, false AS compat, {q_ranges('n', 'false')} AS r FROM {Q_RANGE_TEXTS} UNION ALL SELECT id, true, false, {q_ranges('n', 'true')} FROM {Q_RANGE_TEXTS}
  UNION ALL SELECT id, false, true, {q_ranges('n', 'false', True)} FROM {Q_RANGE_TEXTS})""")
def time_ranges(spark, sf_dir):
    t = _range_texts(spark)
    parts = [t.select("id", F.lit(h).alias("hours"), F.lit(c).alias("compat"), F.explode(M.ranges(F.col("n"), F.lit(h), c)).alias("r")) for h, c in ((False, False), (True, False), (False, True))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("id", "hours", "compat", "r.a", "r.b")


@query(f"SELECT id, {q_hhmm('r.a')} AS a, {q_hhmm('r.b')} AS b FROM (SELECT id, {q_best(q_ranges('n', 'false'))} AS r FROM {Q_RANGE_TEXTS}) WHERE r IS NOT NULL")
def best_range(spark, sf_dir):
    t = _range_texts(spark).select("id", M.best_range(M.ranges(F.col("n"), F.lit(False))).alias("r")).where("r is not null")
    return t.select("id", M.hhmm(F.col("r.a")).alias("a"), M.hhmm(F.col("r.b")).alias("b"))


Q_CHUNKS = X.values(X.CHUNKS, "pos, page, text")


def _chunks(spark):
    return rows(spark, X.CHUNKS, "pos int, page int, text string")


def q_range_lines(t: str) -> str:
    """From a relation (qid, intent, pos, tn)."""
    lasts = "(CASE WHEN b > a THEN b - a ELSE b + 1440 - a END)"
    pts = f"((CASE WHEN {lasts} BETWEEN 360 AND 660 THEN 2 ELSE 0 END) + (CASE WHEN a BETWEEN 420 AND 600 THEN 1 ELSE 0 END) + (CASE WHEN {q_any('tn', ['العمل', 'دوام'])} THEN 1 ELSE 0 END) + (CASE WHEN intent = 'ramadan_hours' AND contains(tn, 'رمضان') THEN 1 ELSE 0 END))"
    return f"""(SELECT qid, {q_hours('intent', 'arg_min(ta, o)', 'arg_min(tb, o)')} AS line FROM (
  SELECT qid, intent, {q_clock('x[1]')} AS ta, {q_clock('x[2]')} AS tb, (-{pts}, abs({lasts} - CASE WHEN intent = 'ramadan_hours' THEN 390 ELSE 480 END), pos, nth) AS o, {pts} AS pts FROM (
    SELECT *, {q_minutes('x[1]')} AS a, {q_minutes('x[2]')} AS b FROM (SELECT qid, intent, pos, tn, unnest(ps) AS x, unnest(range(len(ps))) AS nth FROM (SELECT *, {q_pairs('tn')} AS ps FROM {t} WHERE intent IN ('work_hours', 'ramadan_hours'))))
  WHERE a < 1440 AND b < 1440) WHERE pts > 0 GROUP BY qid, intent)"""


@query(f"SELECT qid, line FROM {q_range_lines('(SELECT i AS intent, CASE i WHEN ' + chr(39) + 'work_hours' + chr(39) + ' THEN 1 ELSE 2 END AS qid, pos, ' + q_eval('text') + ' AS tn FROM ' + Q_CHUNKS + ', (VALUES (' + chr(39) + 'work_hours' + chr(39) + '), (' + chr(39) + 'ramadan_hours' + chr(39) + ')) AS v(i))')}")
def best_range_repair(spark, sf_dir):
    t = _chunks(spark).withColumn("tn", T.norm_eval("text")).join(rows(spark, [(1, "work_hours"), (2, "ramadan_hours")], "qid int, intent string"), F.lit(True))
    return evaluate.range_lines(t)


Q_DURATION = r"[0-9]{1,3}\s*(?:دقيقه|دقائق|ساعه|ساعات)(?:[^\p{L}\p{N}_]|$)"
Q_DURATION_EVAL = r"(?:^|[^\p{L}\p{N}_])[0-9]{1,3}\s*(?:دقيقة|دقائق|ساعة|ساعات)(?:[^\p{L}\p{N}_]|$)"
Q_TOKEN = r"(?:^|[^\p{L}\p{N}_])[0-9]{1,2}(?:[:.][0-9]{1,2}(?:[^\p{L}\p{N}_]|$)|[:.][\p{L}_])"


@query(f"SELECT pos, {q_strip('text')} AS line, contains({q_eval('text')}, 'استراح') AS pause FROM {Q_CHUNKS} WHERE regexp_matches({q_eval('text')}, '{Q_DURATION_EVAL}')")
def duration_lines(spark, sf_dir):
    t = _chunks(spark).withColumn("tn", T.norm_eval("text"))
    return t.where(F.col("tn").rlike(M.DURATION_EVAL)).select("pos", T.strip("text").alias("line"), F.contains("tn", F.lit("استراح")).alias("pause"))


# ---- dense -----------------------------------------------------------------------------------------------------


def _dense(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    index = e.select(F.col("vec_id").alias("pos"), F.col("embedding").alias("v"), "label")
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid")).join(e, F.col("vec_id") == F.col("qid")).select("qid", F.col("embedding").alias("qv"), (F.col("qid") % 10).cast("int").alias("section"))
    return asked, index


Q_DENSE = """q AS (SELECT item_id AS qid, embedding::DOUBLE[] AS qv, (item_id % 10)::INT AS section FROM benchmark JOIN embeddings ON vec_id = item_id),
sc AS (SELECT qid, vec_id AS pos, round(list_dot_product(qv, embedding::DOUBLE[]), 6) AS score, label, section FROM q, embeddings)"""


@query(f"WITH {Q_DENSE} {q_top('sc', 8, 'score')}")
def dense_topk(spark, sf_dir):
    asked, index = _dense(spark, sf_dir)
    return dense.dense_top(asked.select("qid", "qv"), index, 8).select("qid", "pos", "score", "rk")


def _sections(asked, index):
    return asked.select("qid", "section").join(index.select("pos", "label"), F.col("section") == F.col("label")).select("qid", "pos")


def _rank(d, k):
    return sparse.top(d, k)


@query(f"WITH {Q_DENSE} {q_top('(SELECT * FROM sc WHERE label = section)', 8, 'score')}")
def dense_gated_topk(spark, sf_dir):
    asked, index = _dense(spark, sf_dir)
    return _rank(dense.pair_scores(asked, index, _sections(asked, index)), 8).select("qid", "pos", "score", "rk")


@query(f"WITH {Q_DENSE}, r AS ({q_top('sc', 60, 'score')}) SELECT r.* FROM r JOIN sc USING (qid, pos) WHERE label = section")
def dense_gated_compat(spark, sf_dir):
    asked, index = _dense(spark, sf_dir)
    return gate.gated(dense.dense_scores(asked.select("qid", "qv"), index), _sections(asked, index), _rank, 60, True).select("qid", "pos", "score", "rk")


@query(f"""
WITH {Q_DENSE}, ok AS (SELECT qid, pos FROM sc WHERE (label = section AND score > 0.2) OR (section >= 5 AND false)), asked AS (SELECT qid FROM q WHERE section < 8),
i AS ({q_top('(SELECT sc.* FROM sc SEMI JOIN ok USING (qid, pos) SEMI JOIN asked USING (qid))', 8, 'score')}), a AS ({q_top('sc', 8, 'score')})
SELECT qid, pos, round(score, 6) AS score, rk, 'inside' AS gate FROM i
UNION ALL SELECT qid, pos, round(score * 0.85, 6), rk, 'fallback' FROM a WHERE qid IN (SELECT qid FROM asked) AND qid NOT IN (SELECT qid FROM i)
UNION ALL SELECT qid, pos, round(score, 6), rk, 'open' FROM a WHERE qid NOT IN (SELECT qid FROM asked)""")
def gate_fallback(spark, sf_dir):
    asked, index = _dense(spark, sf_dir)
    allowed = dense.pair_scores(asked, index, _sections(asked, index)).where("score > 0.2").select("qid", "pos")
    some = asked.where("section < 8").select("qid")
    inside = _rank(dense.pair_scores(asked, index, allowed.join(some, "qid", "left_semi")), 8)
    return gate.with_fallback(inside, dense.dense_top(asked.select("qid", "qv"), index, 8), some).select("qid", "pos", F.round("score", 6).alias("score"), "rk", "gate")


def _hybrid(spark, sf_dir, k):
    asked, index = _dense(spark, sf_dir)
    near = cut(dense.dense_top(asked.select("qid", "qv"), index.join(_docs(spark, sf_dir).select("pos"), "pos", "left_semi"), 60))
    return retrieve.combine(near, *(_cosines(spark, sf_dir, kind, pairs=near) for kind in ("chars", "words")), k)


def q_hybrid(k):
    pre = lambda s, p: s.replace("tf AS", f"{p}tf AS", 1)
    names = ("tf", "n", "idf", "x", "dl", "dv", "qt", "qx", "ql", "qv", "sc")
    import re

    def renamed(sql, p):
        return re.sub(r"(?<![\w.'])(" + "|".join(names) + r")(?= AS \()|(?<=FROM )(" + "|".join(names) + r")\b|(?<=JOIN )(" + "|".join(names) + r")\b|(?<=tf, )(n)\b|\b(qv|dv)(?=\.w)", lambda m: p + m[0], sql)

    return f"""WITH {Q_DENSE.replace('sc AS', 'd AS')}, {renamed(q_tfidf(Q_CHAR_TERMS, Q_CHAR_TERMS), 'c_')}, {renamed(q_tfidf(Q_WORD_TERMS, Q_WORD_TERMS), 'w_')},
near AS ({q_top('(SELECT * FROM d WHERE pos IN (SELECT doc_id FROM documents))', 60, 'score')}),
m AS (SELECT qid, near.pos, near.score * 0.6 + coalesce(round(c.score, 6), 0) * 0.2 + coalesce(round(w.score, 6), 0) * 0.2 AS score FROM near LEFT JOIN c_sc c USING (qid, pos) LEFT JOIN w_sc w USING (qid, pos))
{q_top('m', k)}"""


@query(q_hybrid(8))
def hybrid_topk(spark, sf_dir):
    return _hybrid(spark, sf_dir, 8).select("qid", "pos", "score", "rk")


@query(f"WITH h AS ({q_hybrid(30)}), s AS (SELECT qid, pos, ((pos * 7919 + qid * 104729) % 1000)::DOUBLE AS score FROM h) {q_top('s', 8, 'score')}")
def rerank_topk(spark, sf_dir):
    scorer = ((F.col("pos") * 7919 + F.col("qid") * 104729) % 1000).cast("double")
    return retrieve.rerank(_hybrid(spark, sf_dir, 30), scorer, 8).select("qid", "pos", "score", "rk")


Q_GATED = f"""WITH {Q_DENSE.replace('sc AS', 'd AS')}, {q_tfidf(Q_WORD_TERMS, Q_WORD_TERMS)}, gated AS (SELECT qid FROM q WHERE section < 8),
i AS ({q_top('(SELECT * FROM d WHERE label = section AND score > 0.2 AND section < 8)', 60, 'score')}), a AS ({q_top('d', 60, 'score')}),
near AS (SELECT qid, pos, score FROM i UNION ALL SELECT qid, pos, score FROM a WHERE qid NOT IN (SELECT qid FROM i)),
m AS (SELECT qid, pos, near.score * 0.6 + coalesce(round(w.score, 6), 0) * 0.2 AS score FROM near LEFT JOIN sc w USING (qid, pos)), h AS ({q_top('m', 30)}),
f AS (SELECT qid, pos, score * CASE WHEN qid IN (SELECT qid FROM gated) AND qid NOT IN (SELECT qid FROM i) THEN 0.85::DOUBLE ELSE 1 END AS score FROM h),
s AS (SELECT qid, pos, CASE WHEN count(*) OVER (PARTITION BY qid) = 1 THEN score ELSE ((pos * 7919 + qid * 104729) % 1000)::DOUBLE + score END AS score FROM f)
{q_top('s', 8)}"""


@query(Q_GATED)
def retrieve_full(spark, sf_dir):
    """The gate with its fallback, weights, damping and reranking in one: as a question goes through the engine."""
    from .engine import weighted

    asked, index = _dense(spark, sf_dir)
    some = asked.where("section < 8").select("qid")
    pairs = dense.pair_scores(asked, index, _sections(asked, index).join(some, "qid", "left_semi"))
    inside = sparse.top(pairs.where("score > 0.2"), 60).drop("rk")
    near = cut(gate.with_fallback(inside, dense.dense_top(asked.select("qid", "qv"), index, 60).drop("rk"), some))
    scorer = ((F.col("pos") * 7919 + F.col("qid") * 104729) % 1000).cast("double") + F.col("score")
    best = retrieve.rerank(weighted(near, None, _cosines(spark, sf_dir, "words", pairs=near)), scorer, 8)
    return best.select("qid", "pos", F.round("score", 6).alias("score"), "rk")


# ---- headings --------------------------------------------------------------------------------------------------

Q_POSTINGS = rf"""SELECT regexp_replace(lower({q_norm('heading')}), '^section:\s*', '') AS heading, nullif(regexp_extract(posting, '^(.*)_([0-9]+)_([0-9]+)$', 1), '') AS file,
  TRY_CAST(regexp_extract(posting, '^(.*)_([0-9]+)_([0-9]+)$', 2) AS INT) AS page, TRY_CAST(regexp_extract(posting, '^(.*)_([0-9]+)_([0-9]+)$', 3) AS INT) AS ordinal,
  coalesce(TRY_CAST(posting AS INT), TRY_CAST(regexp_extract(posting, '([0-9]+)$', 1) AS INT)) AS pos FROM {X.values(X.POSTINGS, 'heading, posting')}"""


@query(Q_POSTINGS)
def posting_parse(spark, sf_dir):
    return gate.parse_postings(rows(spark, X.POSTINGS, "heading string, posting string"))


@query(rf"""
WITH p AS ({Q_POSTINGS}), a AS (SELECT lower({q_norm('c')}) AS canon, lower({q_norm('a')}) AS alias FROM {X.values(X.ALIASES, 'c, a')}), q AS (SELECT qid, lower({q_norm('q')}) AS qn FROM {Q_QUESTIONS}),
k AS (SELECT qid, unnest(list_filter(string_split_regex(qn, '[\s|:/,;]+'), lambda x: x <> '')) AS key FROM q UNION SELECT qid, canon FROM q, a WHERE contains(qn, alias) OR contains(qn, canon))
SELECT DISTINCT qid, pos FROM k JOIN p ON key = heading WHERE pos IS NOT NULL""")
def alias_gate(spark, sf_dir):
    names = rows(spark, X.ALIASES, "canon string, alias string").select(F.lower(T.norm_retrieval("canon")).alias("canon"), F.lower(T.norm_retrieval("alias")).alias("alias"))
    keys = gate.candidate_keys(rows(spark, X.QUESTIONS, "qid int, q string"), names)
    return gate.candidates(keys, gate.parse_postings(rows(spark, X.POSTINGS, "heading string, posting string")).where("pos is not null"))


Q_HEADINGS = f"(SELECT hid, coalesce(t, '') AS title, {q_heading('t')} AS tn, s, e FROM {X.values(X.HEADINGS, 'hid, t, s, e')})"
Q_FINE = X.values(FINE_INTENTS, "intent, patterns, words")


def q_bag(list_):
    return f"list_distinct(list_filter(flatten(list_transform({list_}, lambda w: string_split({q_heading('w')}, ' '))), lambda x: x <> ''))"


def q_jaccard(a, b):
    return f"(CASE WHEN len(list_distinct(list_concat({a}, {b}))) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0 END)"


def _headings(spark):
    return rows(spark, X.HEADINGS, "hid int, title string, page_start int, page_end int").withColumn("heading", F.lit(None).cast("string"))


Q_OWN = "list_distinct(list_filter(string_split(tn, ' '), lambda x: x <> ''))"


@query(f"SELECT hid, intent, round({q_jaccard(Q_OWN, q_bag('words'))}, 6) AS overlap FROM {Q_HEADINGS}, {Q_FINE}")
def heading_jaccard(spark, sf_dir):
    h = priors.headings(_headings(spark)).join(fine_intents(spark), F.lit(True))
    own = F.array_distinct(F.filter(F.split("title_norm", " "), lambda x: x != ""))
    bag = F.array_distinct(F.filter(F.flatten(F.transform("words", lambda w: F.split(T.norm_heading(w), " "))), lambda x: x != ""))
    return h.select("hid", "intent", F.round(T.jaccard(own, bag), 6).alias("overlap"))


def q_pattern(p):
    """The pattern for RE2: word limits as limits of runs of letters."""
    return f"replace(replace({p}, '\\b', '(?:^|$|[^\\p{{L}}\\p{{N}}_])'), '\\s+', '\\s+')"


@query(f"""
WITH s AS (SELECT intent, hid, title, s, e, round(CASE WHEN len(list_filter(patterns, lambda p: regexp_matches(title, {q_pattern('p')}) OR regexp_matches(tn, {q_pattern('p')}))) > 0 THEN 2.0 ELSE 0.0 END + {q_jaccard(Q_OWN, q_bag('words'))}, 6) AS score FROM {Q_HEADINGS}, {Q_FINE}),
r AS (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY score DESC, hid) AS rk FROM s WHERE score > 0 QUALIFY rk <= 5),
p AS (SELECT intent, unnest(CASE WHEN s >= 0 AND e >= s THEN range(s, e + 1) WHEN s >= 0 THEN [s::BIGINT] ELSE []::BIGINT[] END) AS page FROM r)
SELECT intent, string_agg(title, ' | ' ORDER BY rk) AS headings, coalesce((SELECT string_agg(DISTINCT page::VARCHAR, ',' ORDER BY page::VARCHAR) FROM p WHERE p.intent = r.intent), '') AS pages FROM r GROUP BY intent""")
def heading_priors(spark, sf_dir):
    p = priors.section_priors(_headings(spark), fine_intents(spark))
    return p.select("intent", F.array_join("headings", " | ").alias("headings"), F.array_join(F.array_sort(F.col("pages").cast("array<string>")), ",").alias("pages"))


# ---- answers ---------------------------------------------------------------------------------------------------

LATIN_HINT = {"question": ["what", "is"], "number": ["the ", "die ", "la "], "polite": ["of"]}
Q_TERMS = "list_distinct(list_filter(string_split({q}, ' '), lambda x: length(x) >= 3))"


def q_snippets(sents: str, hint, must, keys: str = "qid, rk") -> str:
    """From (qid, rk, q, intent, s, ord): the snippet of each hit."""
    time = f"({q_digit('sn')} AND {q_any('sn', ['من', 'حتي', ':', '.'])})"
    has_hint = q_by("intent", hint, "false").replace("{x}", "sn")
    needed = q_by("intent", must, "true").replace("{x}", "sn") if must else "true"
    over = f"len(list_intersect({Q_TERMS.format(q=q_norm('q'))}, list_distinct(string_split(sn, ' '))))"
    bonus = ", ".join(f"'{x}'" for x in L.DIGIT_BONUS)
    return f"""(SELECT {keys}, CASE WHEN length(x) > 260 THEN substr(x, 1, 260) || '…' ELSE x END AS snippet FROM (
  SELECT {keys}, coalesce(arg_max(s, (score, -ord)) FILTER (WHERE fits), arg_min(s, ord)) AS x FROM (
    SELECT *, round(overlap * 1.2::DOUBLE + CASE WHEN t THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN h THEN 0.8::DOUBLE ELSE 0 END + CASE WHEN {q_digit('sn')} AND intent IN ({bonus}) THEN 0.4::DOUBLE ELSE 0 END - CASE WHEN overlap = 0 AND NOT t AND NOT h THEN 0.6::DOUBLE ELSE 0 END, 6) AS score,
      intent NOT IN ('work_hours', 'ramadan_hours') OR (t AND {q_any('sn', compose.CONTEXT)}) AS fits FROM (
      SELECT *, {over} AS overlap, {time} AS t, {has_hint} AS h FROM (SELECT *, {q_norm('s')} AS sn FROM {sents}) WHERE NOT {q_junk('s', 'sn')} AND {needed}))
  GROUP BY {keys}))"""


def q_exploded(hits: str) -> str:
    return f"(SELECT * EXCLUDE (ss), unnest(ss) AS s, unnest(range(len(ss))) AS ord FROM (SELECT *, {q_sentences('text')} AS ss FROM {hits}))"


@query(f"""
WITH {q_tfidf(Q_WORD_TERMS, Q_WORD_TERMS)}, h AS ({q_top('sc', 3)}), t AS (SELECT h.qid, h.rk, b.text AS q, {q_intent(q_norm('b.text'), L.LATIN_RULES)} AS intent, d.text FROM h JOIN documents d ON d.doc_id = h.pos JOIN benchmark b ON b.item_id = h.qid)
SELECT qid, rk, snippet FROM {q_snippets(q_exploded('t'), LATIN_HINT, None)}""")
def best_snippet(spark, sf_dir):
    best = sparse.top(_cosines(spark, sf_dir, "words", 3), 3)
    few = _questions(spark, sf_dir).limit(dense.BROADCAST_QUESTIONS + 1).count() <= dense.BROADCAST_QUESTIONS
    hits = _docs(spark, sf_dir).select("pos", "page", "text").join(F.broadcast(best) if few else best, "pos").select("qid", "rk", "pos", "page", "text")
    asked = _questions(spark, sf_dir).select("qid", "q", L.classify("q", L.LATIN_RULES).alias("intent"))
    return compose.best_snippets(hits, asked, LATIN_HINT, {})


Q_ASKED = f"(SELECT qid, q, {q_intent(q_norm('q'))} AS intent FROM {Q_QUESTIONS})"
Q_HITS = f"(SELECT qid, rk, pos, page, text FROM {X.values(X.HITS, 'qid, rk, pos')} JOIN {Q_CHUNKS} USING (pos))"
Q_HIT_SENTENCES = f"(SELECT e.*, a.q, a.intent, {q_norm('s')} AS sn FROM {q_exploded(Q_HITS)} e JOIN {Q_ASKED} a USING (qid))"


def _hits(spark):
    return rows(spark, X.HITS, "qid int, rk int, pos int").join(_chunks(spark), "pos").select("qid", "rk", "pos", "page", "text")


@query(f"SELECT qid, rk, snippet FROM {q_snippets('(SELECT * EXCLUDE (sn) FROM ' + Q_HIT_SENTENCES + ')', L.HINT, L.MUST)}")
def snippet_fallback(spark, sf_dir):
    return compose.best_snippets(_hits(spark), _asked(spark))


Q_TESTS = {
    "procurement": q_any("sn", ["عروض", "ثلاث", "3", "سقف", "حد", "شيكل", "دينار", "دولار", "شراء", "مشتريات"]),
    "leave": f"({q_any('sn', ['اجاز'])} AND {q_digit('sn')})",
    "break": f"({q_any('sn', ['استراح', 'بريك', 'رضاع', 'رضاعه'])} AND (regexp_matches(sn, '{Q_DURATION}') OR {q_any('sn', ['نصف ساعه', 'ربع ساعه'])}))",
    "hourly_leave": f"({q_any('sn', ['مغادر', 'اذن'])} AND ({q_digit('sn')} OR {q_any('sn', ['حد', 'شهري'])}))",
}
Q_FIRST = " UNION ALL ".join(f"SELECT qid, '{k}' AS intent, arg_min(s, (rk, ord)) AS line FROM {Q_HIT_SENTENCES} WHERE {t} GROUP BY qid" for k, t in Q_TESTS.items())


@query(Q_FIRST)
def compose_first_match(spark, sf_dir):
    s = compose.sentences(_hits(spark))
    out = None
    for intent, test in compose.TESTS.items():
        part = compose.first_match(s, test, intent)
        out = part if out is None else out.unionByName(part)
    return out.select("qid", "intent", "line")


Q_SLOTS = "SELECT qid, 'overtime' AS intent, line FROM (SELECT qid, concat_ws(' ', " + ", ".join(f"arg_min(s, (rk, ord)) FILTER (WHERE {q_any('sn', ws)})" for ws in compose.SLOTS.values()) + f") AS line FROM {Q_HIT_SENTENCES} GROUP BY qid) WHERE line <> ''"


@query(Q_SLOTS)
def compose_slots(spark, sf_dir):
    return compose.slot_lines(compose.sentences(_hits(spark))).select("qid", "intent", "line")


_MUST_HOURS = q_by("intent", {k: L.MUST[k] for k in L.HOURS}, "true").replace("{x}", "sn")
Q_HOURS = f"""SELECT qid, intent, {q_hours('intent', q_hhmm('x.r.a'), q_hhmm('x.r.b'))} AS line, x.pages AS pages FROM (SELECT qid, intent, arg_min({{'r': r, 'pages': pages}}, p) AS x FROM (
  SELECT qid, intent, 1 AS p, arg_min(r, (rk, ord)) AS r, [arg_min(page, (rk, ord))] AS pages FROM (SELECT *, {q_best(q_ranges('sn', 'true'))} AS r FROM {Q_HIT_SENTENCES} WHERE intent IN ('work_hours', 'ramadan_hours') AND {q_any('sn', compose.CONTEXT)} AND {_MUST_HOURS}) WHERE r IS NOT NULL GROUP BY ALL
  UNION ALL SELECT qid, intent, 2, arg_min(r, rk), NULL FROM (SELECT h.qid, a.intent, rk, {q_best(q_ranges('tn', 'true'))} AS r FROM (SELECT *, {q_norm('text')} AS tn FROM {Q_HITS}) h JOIN {Q_ASKED} a USING (qid) WHERE a.intent IN ('work_hours', 'ramadan_hours') AND {q_any('tn', compose.CONTEXT)}) WHERE r IS NOT NULL GROUP BY ALL) GROUP BY qid, intent)"""


@query(f"SELECT qid, line, array_to_string(pages, ',') AS pages FROM ({Q_HOURS})")
def compose_hours(spark, sf_dir):
    h = _hits(spark)
    out = compose.hours_lines(h, compose.sentences(h), _asked(spark))
    return out.select("qid", "line", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


Q_ANSWERS = f"""(WITH l AS (SELECT qid, intent, line, pages FROM ({Q_HOURS}) UNION ALL SELECT qid, intent, line, NULL FROM ({Q_FIRST}) UNION ALL SELECT qid, intent, line, NULL FROM ({Q_SLOTS})),
p AS (SELECT qid, list(page ORDER BY rk) AS all_pages FROM {Q_HITS} GROUP BY qid), sn AS (SELECT qid, snippet FROM {q_snippets('(SELECT * EXCLUDE (sn) FROM ' + Q_HIT_SENTENCES + ' WHERE rk = 1)', L.HINT, L.MUST)}),
j AS (SELECT a.qid, a.q, a.intent, l.line, l.pages, all_pages, coalesce(l.line, snippet) AS t FROM {Q_ASKED} a LEFT JOIN p USING (qid) LEFT JOIN l ON l.qid = a.qid AND l.intent = a.intent LEFT JOIN sn ON sn.qid = a.qid)
SELECT qid, q, intent, CASE WHEN all_pages IS NULL THEN '{compose.NOT_FOUND}' WHEN t IS NULL THEN '{compose.UNSUITABLE}' ELSE {q_strip('t')} END AS body, all_pages IS NOT NULL AND t IS NOT NULL AS found,
  CASE WHEN all_pages IS NOT NULL AND t IS NOT NULL THEN coalesce(pages, all_pages) ELSE []::INT[] END AS pages FROM j)"""


def _answers(spark):
    return compose.answers(_hits(spark), _asked(spark))


@query(f"SELECT qid, intent, body, found, array_to_string(pages, ',') AS pages FROM {Q_ANSWERS}")
def answer_dispatch(spark, sf_dir):
    return _answers(spark).select("qid", "intent", "body", "found", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


def q_checked(rel: str) -> str:
    """Adds topical, pass_loose, pass_strict to (qid, q, intent, body, pages, found)."""
    anchors = lambda missing: q_by("intent", L.ANCHORS, missing).replace("{x}", "bn")
    toks = lambda x: f"list_filter(string_split_regex({x}, '[^ء-يa-zA-Z0-9]+'), lambda w: length(w) >= 4 AND w <> 'هناك')"
    needs = f"(CASE WHEN intent IN ('work_hours', 'ramadan_hours', 'break') THEN true WHEN intent = 'workdays' THEN false ELSE {q_digit('qn')} OR {q_any('qn', L.CUES)} END)"
    days = f"({q_any('body', L.WEEKDAYS)} OR (contains(bn, 'ايام') AND {q_any('bn', ['العمل', 'الدوام'])}))"
    rng = rf"{Q_CLOCK}\s*(?:[-–—]|الى|إلى|حتي|حتى|الي|إلي)\s*[0-9]"
    own = f"(CASE WHEN intent IN ('work_hours', 'ramadan_hours') THEN regexp_matches(bn, '{rng}') OR regexp_matches(bn, '{Q_TOKEN}') WHEN intent = 'break' THEN regexp_matches(bn, '{Q_DURATION_EVAL}') OR regexp_matches(bn, '{Q_TOKEN}') WHEN intent = 'workdays' THEN {days} WHEN intent IN ('leave', 'overtime', 'per_diem', 'procurement') THEN {q_digit('bn')} ELSE length(bn) >= 6 END)"
    return f"""(SELECT *, topical AND CASE WHEN {needs} THEN {anchors('true')} AND {own} ELSE length(bn) >= 6 END AS pass_strict FROM (
  SELECT *, bn <> '' AND ({anchors('false')} OR len(list_intersect(list_distinct({toks('qn')}), list_distinct({toks('bn')}))) > 0) AS topical, found AND NOT contains(body, 'لم أعثر') AS pass_loose FROM (SELECT *, {q_eval('q')} AS qn, {q_eval('body')} AS bn FROM {rel})))"""


@query(f"SELECT qid, topical, pass_loose, pass_strict FROM {q_checked(Q_ANSWERS)}")
def strict_loose(spark, sf_dir):
    return evaluate.checks(_answers(spark)).select("qid", "topical", "pass_loose", "pass_strict")


def q_find(test, intent):
    return f"arg_min({q_strip('text')}, pos) FILTER (WHERE intent = '{intent}' AND {test})"


_LASTS = f"regexp_matches(tn, '{Q_DURATION_EVAL}')"
_FINDS = [q_find(f"{q_any('tn', ['استراح', 'راحة', 'بريك'])} AND {_LASTS}", "break"), q_find(_LASTS, "break"), q_find(f"({q_any('text', L.WEEKDAYS)} OR (contains(tn, 'ايام') AND {q_any('text', ['العمل', 'الدوام'])}))", "workdays")]
_FINDS += [q_find(q_any("tn", ws) + (f" AND {q_digit('tn')}" if d else ""), k) for k, v in evaluate.FINDERS.items() for ws, d in v]
Q_REPAIRED = f"""WITH c AS (SELECT * FROM {q_checked(Q_ANSWERS)}), f AS (SELECT * FROM c WHERE (NOT pass_strict OR NOT topical) AND len(pages) > 0),
t AS (SELECT f.qid, f.intent, k.pos, k.text, {q_eval('k.text')} AS tn FROM (SELECT DISTINCT qid, intent, unnest(pages) AS page FROM f) f JOIN {Q_CHUNKS} k USING (page)),
l AS (SELECT qid, coalesce({', '.join(_FINDS)}) AS line FROM t GROUP BY qid, intent UNION ALL SELECT * FROM {q_range_lines('t')}), g AS (SELECT qid, any_value(line) AS line FROM l WHERE line IS NOT NULL GROUP BY qid),
n AS (SELECT c.qid, c.q, c.intent, coalesce(g.line, c.body) AS body, c.pages, c.found, c.pass_loose AS first_loose, c.qid IN (SELECT qid FROM f) AS repaired FROM c LEFT JOIN g USING (qid))
SELECT qid, body, first_loose AS pass_loose, pass_strict, repaired FROM {q_checked('n')}"""


@query(Q_REPAIRED)
def repair_on_pages(spark, sf_dir):
    return evaluate.evaluate(_answers(spark), _chunks(spark)).select("qid", "body", "pass_loose", "pass_strict", "repaired")


@query(f"SELECT count(*) AS total, sum(pass_loose::INT)::BIGINT AS loose, sum(pass_strict::INT)::BIGINT AS strict, sum(repaired::INT)::BIGINT AS repaired FROM ({Q_REPAIRED})")
def evaluation_summary(spark, sf_dir):
    return evaluate.summary(evaluate.evaluate(_answers(spark), _chunks(spark)))


@query(f"""
WITH {q_tfidf(Q_WORD_TERMS, Q_WORD_TERMS)}, h AS ({q_top('sc', 8)}) SELECT qid, string_agg(rk || '. {compose.FILE} - page ' || (pos // 10), chr(10) ORDER BY rk) AS sources, string_agg((pos // 10)::VARCHAR, ',' ORDER BY rk) AS pages FROM h GROUP BY qid""")
def source_list(spark, sf_dir):
    h = sparse.top(_cosines(spark, sf_dir, "words", 8), 8).withColumn("page", F.floor(F.col("pos") / 10).cast("int"))
    p = h.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "page"))), lambda x: x["page"]).alias("p")).withColumn("sources", compose.source_lines(F.col("p")))
    again = T.pages_of(F.concat(F.lit("x\nSources:\n"), F.col("sources")))
    return p.select("qid", "sources", F.array_join(again.cast("array<string>"), ",").alias("pages"))


@query(f"""
WITH d AS (SELECT * FROM {X.values(X.DEVSET, 'qid, n, u, s')}), a AS (SELECT d.*, {q_norm('body')} AS bn FROM d JOIN {Q_ANSWERS} USING (qid))
SELECT qid, NOT n OR {q_digit('bn')} AS numeric_ok, len(u) = 0 OR len(list_filter(u, lambda x: contains(bn, {q_norm('x')}))) > 0 AS unit_ok,
  CASE WHEN len(s) > 0 THEN round(len(list_filter(s, lambda x: contains(bn, {q_norm('x')})))::DOUBLE / len(s), 6) ELSE 1.0 END AS recall FROM a""")
def devset_eval(spark, sf_dir):
    items = rows(spark, X.DEVSET, "qid int, numeric_expected boolean, expected_units array<string>, expect_substrings array<string>")
    return evaluate.devset(items, _answers(spark))


# ---- documents in and out --------------------------------------------------------------------------------------


@query(f"""
SELECT j->>'$.source_filename' AS source_filename, CAST(nth AS INT) AS ord, s->>'$.id' AS id, CAST(s->>'$.level' AS INT) AS level, s->>'$.title' AS title,
  array_to_string(json_extract_string(s, '$.path[*]'), ' / ') AS path, coalesce(CAST(s->>'$.page_range[0]' AS INT), -1) AS page, s->>'$.content' AS content
FROM (SELECT j, unnest(ss) AS s, unnest(range(len(ss))) AS nth FROM (SELECT j::JSON AS j, json_extract(j::JSON, '$.sections[*]') AS ss FROM {X.values([(x,) for x in X.DOCS_JSON], 'j')}))""")
def sections_explode(spark, sf_dir):
    from ..sources.ingest import DOCUMENT

    docs = rows(spark, [(x,) for x in X.DOCS_JSON], "j string").select(F.from_json("j", DOCUMENT).alias("d")).select("d.*")
    return C.sections_to_chunks(docs).drop("doc_title")


@query(f"SELECT pos::BIGINT AS pos, id::BIGINT AS chunk_id, page, text FROM {X.values(X.LOADED, 'pos, id, page, text')}")
def tolerant_load(spark, sf_dir):
    lines = rows(spark, [(x,) for x in X.LINES], "raw string").coalesce(1)
    return C.chunks(C.numbered(C.records(lines))).select("pos", "chunk_id", "page", "text")


def q_stored(terms: str, relation: str) -> str:
    """pos, term and weight of a stored vector, from the words of SQL over the chunks."""
    return f"""(WITH tf AS (SELECT pos, term, count(*) AS tf FROM (SELECT pos, unnest({terms}) AS term FROM {relation}) GROUP BY ALL), n AS (SELECT count(*) AS n FROM {relation}),
idf AS (SELECT term, ln((1.0 + n) / (1.0 + count(*))) + 1 AS idf FROM tf, n GROUP BY term, n), x AS (SELECT pos, term, tf * idf AS x FROM tf JOIN idf USING (term))
SELECT pos, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY pos)), 6) AS w FROM x)"""


@query(f"""
WITH c AS (SELECT pos, page, text, {q_norm('text')} AS norm FROM {Q_CHUNKS})
SELECT 'chunk' AS part, pos, norm AS term, page::DOUBLE AS w FROM c UNION ALL SELECT 'word', * FROM {q_stored(Q_WORD_TERMS, 'c')} UNION ALL SELECT 'char', * FROM {q_stored(Q_CHAR_TERMS, 'c')}""")
def index_roundtrip(spark, sf_dir):
    """The rows of a stored index, read again; one of another corpus or model is refused."""
    import uuid

    from .lineage import shared_folder

    path = f"{shared_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    I.save(I.build(_chunks(spark).withColumn("norm", T.norm_retrieval("text")), fingerprint="f"), path)
    again = I.load(spark, path, "f", "hashed-trigrams-256", len(X.CHUNKS))
    for other in (("g", "hashed-trigrams-256", len(X.CHUNKS)), ("f", "another", len(X.CHUNKS)), ("f", "hashed-trigrams-256", len(X.CHUNKS) + 1)):
        if I.load(spark, path, *other) is not None:
            raise ValueError("an index of another corpus or model was taken")
    vectors = [t.select(F.lit(name).alias("part"), "pos", "term", F.round("w", 6).alias("w")) for name, t in (("word", again.words), ("char", again.chars))]
    rows_ = again.chunks.select(F.lit("chunk").alias("part"), "pos", F.col("norm").alias("term"), F.col("page").cast("double").alias("w"))
    return rows_.unionByName(vectors[0]).unionByName(vectors[1])


FLAGS = [(1, None), (2, "1"), (3, " TRUE "), (4, "Yes"), (5, "on\t"), (6, "0"), (7, ""), (8, "off"), (9, "y"), (10, "true x")]


@query(f"SELECT id, coalesce({q_strip('lower(t)')} IN ('1', 'true', 'yes', 'on'), true) AS yes, coalesce({q_strip('lower(t)')} IN ('1', 'true', 'yes', 'on'), false) AS no FROM {X.values(FLAGS, 'id, t')}")
def flag_values(spark, sf_dir):
    from ..functions.settings import flag_of

    return rows(spark, FLAGS, "id int, t string").select("id", flag_of(F.col("t"), True).alias("yes"), flag_of(F.col("t"), False).alias("no"))


@query("SELECT doc_id || '.json' AS name, to_base64(encode(text)) AS content, 'extract ' || doc_id || '.json' AS message FROM documents WHERE text IS NOT NULL")
def payload_base64(spark, sf_dir):
    d = read(spark, sf_dir, "documents").where("text is not null")
    return K.payload(d.select(F.concat(F.col("doc_id").cast("string"), F.lit(".json")).alias("name"), F.col("text").alias("body")))


@query("""
WITH old AS (SELECT doc_id AS name, text AS body, sha256(text) AS version FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0),
new AS (SELECT doc_id AS name, text || '!' AS body, CASE WHEN doc_id % 4 = 0 THEN sha256(text) WHEN doc_id % 5 = 0 THEN 'stale' END AS replaces FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 0),
ok AS (SELECT new.* FROM new LEFT JOIN old USING (name) WHERE version IS NOT DISTINCT FROM replaces)
SELECT name::VARCHAR AS name, sha256(body) AS version, false AS refused FROM ok UNION ALL SELECT name::VARCHAR, version, false FROM old WHERE name NOT IN (SELECT name FROM ok)
UNION ALL SELECT name::VARCHAR, NULL, true FROM new WHERE name NOT IN (SELECT name FROM ok)""")
def upsert_versions(spark, sf_dir):
    d = read(spark, sf_dir, "documents").where("text is not null").withColumn("name", F.col("doc_id").cast("string"))
    mark = F.sha2(F.encode("text", "utf-8"), 256)
    old = d.where("doc_id % 2 = 0").select("name", F.col("text").alias("body"), mark.alias("version"))
    new = d.where("doc_id % 3 = 0").select("name", F.concat("text", F.lit("!")).alias("body"), F.when(F.col("doc_id") % 4 == 0, mark).when(F.col("doc_id") % 5 == 0, "stale").alias("replaces"))
    kept, refused = K.upsert_versioned(old, new)
    return kept.select("name", "version", F.lit(False).alias("refused")).unionByName(refused.select("name", F.lit(None).cast("string").alias("version"), F.lit(True).alias("refused")))


def _file_of(spark, sf_dir, whole: bool):
    """The texts of benchmark as a file of JSON lines, or of one JSON array, in the shared folder."""
    import uuid

    from .lineage import shared_folder

    b = read(spark, sf_dir, "benchmark").where("text is not null")
    line = F.to_json(F.struct(F.col("item_id").alias("chunk_id"), (F.col("item_id") % 50).cast("string").alias("Page"), F.array(F.col("text"), F.lit(" ")).alias("lines")))
    lines = b.select("item_id", F.concat(line, F.lit(",")).alias("value"))
    if whole:  # 40 to 200 rows
        lines = lines.agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "value"))), lambda x: F.rtrim(x["value"], F.lit(","))), ","), F.lit("]")).alias("value"))
    path = f"{shared_folder(spark).rstrip('/')}/chunks-{uuid.uuid4().hex}"
    (lines if whole else lines.coalesce(1).sortWithinPartitions("item_id")).select("value").write.text(path)
    return C.load_chunks(spark, path)[0].select("pos", "chunk_id", "page", "text", "norm")


Q_FILE = f"SELECT row_number() OVER (ORDER BY item_id) - 1 AS pos, item_id AS chunk_id, (item_id % 50)::INT AS page, {q_strip('text')} AS text, {q_norm(q_strip('text'))} AS norm FROM benchmark WHERE {q_strip('text')} <> ''"


@query(Q_FILE)
def chunk_file_lines(spark, sf_dir):
    return _file_of(spark, sf_dir, False)


@query(Q_FILE)
def chunk_file_array(spark, sf_dir):
    return _file_of(spark, sf_dir, True)
