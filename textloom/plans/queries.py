"""Registered queries of the text-analytics operators and, for each that SQL can say, the same in DuckDB's SQL.

Author corpus: ``documents``; background corpus: the texts of ``conversations``; dictionary: its vocabulary.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import annotate, clean, inflect
from textloom.functions.words import CONTRACTION_FRAGMENTS, COPULAS, PREPOSITIONS, STOPWORDS
from textloom.operators import context, cooccurrence, definitions, frequency, graph, keyness, metrics, relations, rewrite, scorer, search, structure, suggest, terms

TERM = "the"
TERMS = ["and", "er", "in", "of", "on", "re", "the", "tion"]
WORDS = ["and", "in", "of", "on", "that", "the", "to", "was"]

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _oracles[f.__name__] = _with_parts(sql)
        return f

    return add


def _quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_PARTS = {
    "sents": r"""sents AS (
  SELECT doc_id, generate_subscripts(s, 1) - 1 AS sent_index, unnest(s) AS sentence FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents)
), sentences AS (SELECT * FROM sents WHERE trim(sentence) <> '')""",
    "toks": rf"""toks AS (
  SELECT *, {annotate.LEMMA_SQL} AS lemma FROM (SELECT *, {annotate.POS_SQL} AS pos FROM (
    SELECT doc_id, sent_index, generate_subscripts(w, 1) - 1 AS tok_index, unnest(w) AS token FROM (
      SELECT doc_id, sent_index, regexp_extract_all(regexp_replace(sentence, '{annotate.CONTRACTION.replace("'", "''")}', '\1 \2', 'g'), '{annotate.TOKEN.replace("'", "''")}') AS w FROM sentences)))
)""",
    "ref": rf"""ref AS (
  SELECT lower(token) AS term, count(*) AS "count" FROM (SELECT unnest(regexp_extract_all(regexp_replace(s, '{annotate.CONTRACTION.replace("'", "''")}', '\1 \2', 'g'), '{annotate.TOKEN.replace("'", "''")}')) AS token
    FROM (SELECT unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM conversations) WHERE trim(s) <> '') GROUP BY 1
)""",
    "lem": "lem AS (SELECT lemma AS term, count(*) AS n FROM toks GROUP BY 1)",
    "cmp": """cmp AS (SELECT term, n, coalesce("count", 0) AS reference_count, (n / (SELECT sum(n) FROM lem)) / (coalesce(nullif("count", 0), 0.5)::DOUBLE / (SELECT sum("count") FROM ref)) AS ratio
  FROM lem LEFT JOIN ref USING (term) WHERE n >= 3)""",
    "tvr": """tvr AS (SELECT term, CASE WHEN "count" IS NULL THEN n / (SELECT sum(n) FROM lem) * ln(2.0::DOUBLE) ELSE 0.0 END AS score FROM lem LEFT JOIN ref USING (term) WHERE n >= 3)""",
    "neo": f"""neo AS (SELECT term, n FROM lem WHERE n >= 3 AND lower(term) NOT IN ({_quoted(STOPWORDS)}) AND lower(term) NOT IN (SELECT term FROM ref) AND term NOT IN (SELECT token FROM toks WHERE pos LIKE 'NNP%'))""",
    "cap": """cap AS (SELECT token AS term, count(*) AS n FROM (SELECT *, lag(token) OVER (PARTITION BY doc_id ORDER BY sent_index, tok_index) AS before FROM toks)
  WHERE substr(token, 1, 1) <> lower(substr(token, 1, 1)) AND NOT (token = upper(token) AND length(token) > 1) AND before IS NOT NULL AND before NOT IN ('.', '!', '?', ';') GROUP BY 1 HAVING count(*) >= 3)""",
    "defs": "defs AS (SELECT doc_id, sent_index, sentence, kind, unnest(found) AS term FROM ("
    + " UNION ALL ".join(f"SELECT doc_id, sent_index, sentence, '{k}' AS kind, regexp_extract_all(sentence, '(?i){p.replace(chr(39), chr(39) * 2)}', 1) AS found FROM sentences" for k, p in definitions.PATTERNS.items())
    + "))",
    "hits": f"hits AS (SELECT *, lower(sentence) AS low FROM sentences WHERE contains(lower(sentence), '{TERM}'))",
    "occ": f"""occ AS (SELECT doc_id, sent_index, sentence, "at" FROM (SELECT *, unnest(range(0, length(low) - {len(TERM) - 1})) AS "at" FROM hits) WHERE substr(low, "at" + 1, {len(TERM)}) = '{TERM}')""",
    "kw": f"""kw AS (SELECT doc_id, sent_index, "at", keyword,
    trim(CASE WHEN instr(l, ' ') > 1 AND instr(l, ' ') < length(l) THEN substr(l, instr(l, ' ') + 1) ELSE l END) AS left_context,
    trim(CASE WHEN contains(r, ' ') AND length(r) - instr(reverse(r), ' ') + 1 > 1 THEN substr(r, 1, length(r) - instr(reverse(r), ' ')) ELSE r END) AS right_context
  FROM (SELECT doc_id, sent_index, "at", substr(sentence, greatest("at" - 50, 0) + 1, "at" - greatest("at" - 50, 0)) AS l, substr(sentence, "at" + 1, {len(TERM)}) AS keyword, substr(sentence, "at" + {len(TERM) + 1}, 50) AS r FROM occ))""",
    "content": f"""content AS (SELECT * FROM toks WHERE regexp_matches(pos, '^(NN|VB|JJ)') AND lemma NOT IN ({_quoted(STOPWORDS)}) AND regexp_matches(lemma, '[\\p{{L}}\\p{{N}}]')), freq AS (SELECT lemma AS term, count(*) AS f FROM content GROUP BY 1)""",
    "sig": f"""sig AS (SELECT doc_id, sent_index, term, score FROM (SELECT b.*, 10 * ln(1 + f) / ln(1 + (SELECT max(f) FROM freq)) AS score FROM (SELECT DISTINCT doc_id, sent_index, lemma AS term FROM content WHERE lemma <> '{TERM}' AND (doc_id, sent_index) IN (SELECT (doc_id, sent_index) FROM hits)) b JOIN freq USING (term)) WHERE score >= 0.1)""",
    "side": "side AS (SELECT * FROM (SELECT doc_id, sent_index, sentence, trim(unnest(regexp_split_to_array(lower(sentence), '\\s+')), '.,;:!?\"()[]{}') AS word FROM sentences) WHERE word <> '')",
    "coded": """coded AS (SELECT doc_id, sent_index, list(token ORDER BY tok_index) AS w, string_agg(code, '' ORDER BY tok_index) AS c FROM (
  SELECT *, CASE WHEN pos IN ('NN', 'NNS', 'NNP', 'NNPS') THEN 'N' WHEN pos = 'PRP' THEN 'P' WHEN pos = 'JJ' THEN 'J' WHEN pos = 'RB' THEN 'R' WHEN pos = 'MD' THEN 'M' WHEN pos = 'DT' THEN 'D' WHEN pos = 'IN' THEN 'I'
    WHEN pos LIKE 'VB%' THEN 'V' ELSE '-' END AS code FROM toks) GROUP BY 1, 2),
  coded_at AS (SELECT doc_id, sent_index, sentence, w, c, unnest(range(len(w))) AS i FROM coded JOIN sentences USING (doc_id, sent_index))""",
    "svo": """svo AS (SELECT doc_id, sent_index, sentence, w[i + 1] AS subject, w[i + length(regexp_extract(m, '^[NP][RM]*V'))] AS verb, w[i + length(m)] AS object
  FROM (SELECT *, regexp_extract(substr(c, i + 1), '^[NP][RM]*V[DJRI]*[NP]') AS m FROM coded_at) WHERE m <> '')""",
    "cop": f"""cop AS (SELECT doc_id, sent_index, sentence, w[i + 1] AS subject, w[j + 1] AS copula, array_to_string(w[j + 2 + skip : j + 1 + skip + take], ' ') AS complement FROM (
  SELECT *, length(regexp_extract(after, '^([^NJ]{{0,4}})[NJ]', 1)) AS skip, length(regexp_extract(after, '^[^NJ]{{0,4}}([NJ][NJI]{{0,3}})', 1)) AS take FROM (
    SELECT *, substr(c, j + 2) AS after FROM (SELECT *, list_min([x FOR x IN [i + 1, i + 2, i + 3] IF list_contains([{_quoted(COPULAS)}], lower(w[x + 1]))]) AS j FROM coded_at WHERE contains(lower(w[i + 1]), 'tion')) WHERE j IS NOT NULL)) WHERE take > 0)""",
    "prp": f"""prp AS (SELECT doc_id, sent_index, sentence, w[i + 1] AS head, w[i + 2] AS preposition, array_to_string(w[i + 3 + skip : i + 2 + skip + take], ' ') AS object FROM (
  SELECT *, length(regexp_extract(after, '^([^N]{{0,3}})N', 1)) AS skip, length(regexp_extract(after, '^[^N]{{0,3}}(N[NJ]{{0,2}})', 1)) AS take FROM (
    SELECT *, substr(c, i + 3) AS after FROM coded_at WHERE contains(lower(w[i + 1]), 'tion') AND substr(c, i + 1, 1) = 'N' AND list_contains([{_quoted(PREPOSITIONS)}], lower(w[i + 2])) QUALIFY i = min(i) OVER (PARTITION BY doc_id, sent_index))) WHERE take > 0)""",
    "inc": "inc AS (SELECT doc_id, sent_index, t FROM sentences, (SELECT unnest([" + _quoted(TERMS) + "]) AS t) WHERE contains(lower(sentence), t))",
    "pairs": """pairs AS (SELECT x.t AS t1, y.t AS t2, count(*) AS a FROM inc x JOIN inc y ON x.doc_id = y.doc_id AND x.sent_index = y.sent_index AND x.t < y.t GROUP BY 1, 2),
  each_t AS (SELECT t, count(*) AS k FROM inc GROUP BY 1),
  counted AS (SELECT t1, t2, a::DOUBLE AS a, p.k::DOUBLE AS n1, q.k::DOUBLE AS n2, (SELECT count(*) FROM sentences)::DOUBLE AS n FROM pairs JOIN each_t p ON t1 = p.t JOIN each_t q ON t2 = q.t)""",
    "half": "half AS (SELECT t1, t2, count(*)::DOUBLE AS score FROM (SELECT s.doc_id, s.sent_index, s.word AS t2, w.t AS t1 FROM side s JOIN (SELECT unnest([" + _quoted(WORDS) + "]) AS t) w ON contains(lower(s.sentence), w.t) AND w.t < s.word) WHERE t2 IN (" + _quoted(WORDS) + ") GROUP BY 1, 2)",
    "mat": "mat AS (SELECT a.t AS t1, b.t AS t2, coalesce(h.score, 0.0) AS score FROM (SELECT unnest([" + _quoted(WORDS) + "]) AS t) a, (SELECT unnest([" + _quoted(WORDS) + "]) AS t) b LEFT JOIN half h ON h.t1 = least(a.t, b.t) AND h.t2 = greatest(a.t, b.t) AND a.t <> b.t)",
    "edges": "edges AS (SELECT t1 AS src, t2 AS dst, score AS weight FROM mat WHERE t1 < t2 AND score >= 50), nodes AS (SELECT DISTINCT t1 AS id FROM mat), ends AS (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges)",
}
_NEEDS = {
    "toks": ["sents"], "lem": ["toks"], "cmp": ["lem", "ref"], "tvr": ["lem", "ref"], "neo": ["lem", "ref"], "cap": ["toks"], "defs": ["sents"], "hits": ["sents"], "occ": ["hits"], "kw": ["occ"],
    "content": ["toks"], "sig": ["content", "hits"], "side": ["sents"], "inc": ["sents"], "pairs": ["inc"], "half": ["side"], "coded": ["toks"], "svo": ["coded"], "cop": ["coded"], "prp": ["coded"], "mat": ["half"], "edges": ["mat"],
}


def _with_parts(sql: str) -> str:
    """``sql`` with the common table expressions named in its first line, ``-- a, b``, and those they need."""
    head, body = sql.strip().split("\n", 1)
    ordered: list[str] = []

    def need(name: str) -> None:
        for x in _NEEDS.get(name, []):
            need(x)
        if name not in ordered:
            ordered.append(name)

    for name in re.findall(r"\w+", head):
        need(name)
    return ("WITH " + ",\n".join(_PARTS[n] for n in ordered) + "\n" if ordered else "") + body


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


def _sents(spark: SparkSession, sf: str) -> DataFrame:
    return annotate.sentences(_docs(spark, sf))


def _toks(spark: SparkSession, sf: str) -> DataFrame:
    return annotate.tokens(_sents(spark, sf))


def _words(spark: SparkSession, sf: str) -> DataFrame:
    return annotate.words(_sents(spark, sf))


def _types(spark: SparkSession, sf: str) -> DataFrame:
    return annotate.types(_words(spark, sf))


def _ref(spark: SparkSession, sf: str) -> DataFrame:
    talk = spark.read.parquet(f"{sf}/conversations.parquet").select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "text")
    return keyness.reference_corpus(annotate.words(annotate.sentences(talk)))


def _n(spark: SparkSession, sf: str) -> int:
    return _docs(spark, sf).count()


def _r(c: str) -> object:
    return F.round(F.col(c).cast("double"), 9).alias(c)


# --- frequencies and TF-IDF


@query("""-- toks
SELECT doc_id, lower(token) AS term, count(*) AS n FROM toks GROUP BY 1, 2""")
def word_freq_by_doc(spark, sf):
    return frequency.word_frequencies(_words(spark, sf))


@query("""-- toks
SELECT doc_id, lemma AS term, count(*) AS n FROM toks WHERE pos IN ('NN', 'NNS') GROUP BY 1, 2""")
def pos_filtered_freq(spark, sf):
    return frequency.pos_filtered_frequencies(_toks(spark, sf), ["NN", "NNS"], use_lemmas=True)


@query("""-- toks
SELECT lower(token) AS term, count(*) AS n FROM toks GROUP BY 1""")
def corpus_freq(spark, sf):
    return frequency.corpus_frequencies(_words(spark, sf))


@query("""-- toks
SELECT lower(token) AS term, count(DISTINCT doc_id) AS df FROM toks GROUP BY 1""")
def doc_freq(spark, sf):
    return frequency.document_frequencies(_words(spark, sf))


@query("""-- toks
SELECT DISTINCT lower(token) AS term FROM toks""")
def vocabulary(spark, sf):
    return frequency.vocabulary(_words(spark, sf))


@query("""-- toks
SELECT doc_id, lower(token) AS term, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY doc_id), 9) AS tf FROM toks GROUP BY 1, 2""")
def tf(spark, sf):
    return frequency.tf(_words(spark, sf)).select("doc_id", "term", "n", _r("tf"))


@query("""-- toks
SELECT lower(token) AS term, count(DISTINCT doc_id) AS df, round(ln((SELECT count(*) FROM documents) / count(DISTINCT doc_id)), 9) AS idf FROM toks GROUP BY 1""")
def idf(spark, sf):
    return frequency.idf(_words(spark, sf), _n(spark, sf)).select("term", "df", _r("idf"))


_TFIDF = """SELECT doc_id, term, round(n / total, 9) AS tf, round(ln((SELECT count(*) FROM documents) / df), 9) AS idf, round(n / total * ln((SELECT count(*) FROM documents) / df), 9) AS tfidf
FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total, count(*) OVER (PARTITION BY term) AS df FROM (SELECT doc_id, lower(token) AS term, count(*) AS n FROM toks GROUP BY 1, 2))"""


@query("-- toks\n" + _TFIDF)
def tfidf_by_doc(spark, sf):
    return frequency.tfidf(_words(spark, sf), _n(spark, sf)).select("doc_id", "term", _r("tf"), _r("idf"), _r("tfidf"))


@query(f"""-- toks
SELECT term, max(tfidf) AS score FROM ({_TFIDF}) GROUP BY 1""")
def tfidf_corpus_max(spark, sf):
    return frequency.corpus_tfidf(_words(spark, sf), _n(spark, sf)).select("term", _r("score"))


@query(f"""-- toks
SELECT term, tfidf AS score FROM ({_TFIDF}) WHERE doc_id = 7""")
def tfidf_of_doc(spark, sf):
    return frequency.document_tfidf(_words(spark, sf), _n(spark, sf), 7).select("term", _r("score"))


# --- keyness


@query("""-- cmp
SELECT term, n, reference_count, round(ratio, 9) AS ratio FROM cmp""")
def keyness_ratio(spark, sf):
    return keyness.compare(_types(spark, sf), _ref(spark, sf)).select("term", "n", "reference_count", _r("ratio"))


@query("""-- cmp
SELECT term, round(ratio, 9) AS ratio FROM cmp WHERE ratio >= 10 AND reference_count <= 2""")
def keyness_threshold(spark, sf):
    return keyness.specific_terms(keyness.compare(_types(spark, sf), _ref(spark, sf)), 10.0, 2).select("term", _r("ratio"))


@query("""-- cmp
SELECT term, round(ratio, 6) AS ratio FROM cmp ORDER BY 2 DESC, 1 LIMIT 50""")
def keyness_top_n(spark, sf):
    return keyness.top_terms(keyness.compare(_types(spark, sf), _ref(spark, sf)).select("term", F.round("ratio", 6).alias("ratio")), "ratio")


@query("""-- lem, ref
SELECT term, n FROM lem WHERE n >= 3 AND term NOT IN (SELECT term FROM ref)""")
def neologism_vs_reference(spark, sf):
    return keyness.neologisms(_types(spark, sf), _ref(spark, sf))


@query("""-- lem, ref
SELECT term, n, round(n / (SELECT sum(n) FROM lem), 9) AS freq, coalesce("count", 0) AS reference_count, round(coalesce("count", 0) / (SELECT sum("count") FROM ref), 9) AS reference_freq,
  round((n / (SELECT sum(n) FROM lem)) / (coalesce("count", 0.5)::DOUBLE / (SELECT sum("count") FROM ref)), 9) AS ratio, docs, "count" IS NOT NULL AS in_reference
FROM lem LEFT JOIN ref USING (term) JOIN (SELECT lemma AS term, count(DISTINCT doc_id) AS docs FROM toks GROUP BY 1) USING (term)""")
def term_context_stats(spark, sf):
    return keyness.context_stats(_toks(spark, sf), _ref(spark, sf)).select("term", "n", _r("freq"), "reference_count", _r("reference_freq"), _r("ratio"), "docs", "in_reference")


@query("""-- tvr
SELECT term, round(score, 9) AS score FROM tvr""")
def tfidf_vs_reference(spark, sf):
    return keyness.tfidf_vs_reference(_types(spark, sf), _ref(spark, sf)).select("term", _r("score"))


@query("""-- cmp, tvr
SELECT term FROM cmp WHERE ratio >= 10 UNION SELECT term FROM tvr WHERE score >= 0.00001""")
def combined_union(spark, sf):
    return _combined(spark, sf, "union")


@query("""-- cmp, tvr
SELECT term FROM cmp WHERE ratio >= 10 INTERSECT SELECT term FROM tvr WHERE score >= 0.00001""")
def combined_intersection(spark, sf):
    return _combined(spark, sf, "intersection")


def _combined(spark, sf, method):
    toks, ref = _types(spark, sf), _ref(spark, sf)
    return keyness.combined_terms(keyness.compare(toks, ref), keyness.tfidf_vs_reference(toks, ref), 10.0, 0.00001, method)


@query("""-- neo
SELECT term, n FROM neo""")
def dictionary_neologisms(spark, sf):
    return keyness.dictionary_neologisms(_types(spark, sf), _ref(spark, sf))


@query("""-- cap
SELECT term, n FROM cap""")
def capitalized_terms(spark, sf):
    return keyness.capitalized_terms(_words(spark, sf))


@query("""-- lem, ref, neo, cap
SELECT term, bool_or(s = 'r') AS reference, bool_or(s = 'd') AS dictionary, bool_or(s = 'c') AS capitalized, count(DISTINCT s) AS signals FROM (
  SELECT term, 'r' AS s FROM lem WHERE n >= 3 AND term NOT IN (SELECT term FROM ref) UNION ALL SELECT term, 'd' FROM neo UNION ALL SELECT term, 'c' FROM cap) GROUP BY 1""")
def neologism_signals(spark, sf):
    words, ref = _words(spark, sf), _ref(spark, sf)
    return keyness.neologism_signals(annotate.types(words), ref, ref, words=words)


_FUNCTION = _quoted(keyness.FUNCTION_TAGS)
_NOUNS = _quoted(keyness.FOCUS["nouns"])


@query(f"""-- toks
SELECT lemma AS term, count(*) AS n FROM toks GROUP BY 1 HAVING bool_or(pos IN ({_NOUNS})) AND NOT bool_or(pos IN ({_FUNCTION}))""")
def pos_vocabulary(spark, sf):
    return keyness.pos_vocabulary(_types(spark, sf), keyness.FOCUS["nouns"], keyness.FUNCTION_TAGS)


_CANDIDATES = f"""SELECT lemma AS term, count(*) AS n FROM toks GROUP BY 1 HAVING bool_or(pos IN ({_NOUNS})) AND NOT bool_or(pos IN ({_FUNCTION})) AND count(*) >= 3 AND lemma NOT IN ({_quoted(STOPWORDS)})"""


@query("-- toks\n" + _CANDIDATES)
def term_candidates(spark, sf):
    return keyness.term_candidates(_types(spark, sf))


_COMPOUND = r"""SELECT term, count(*) AS n FROM (
  SELECT unnest([CASE WHEN contains(t0, '-') AND length(t0) > 3 AND regexp_matches(t0, '\p{L}') THEN lower(t0) END,
    CASE WHEN regexp_matches(p0, '^(NN|JJ)') AND p1 LIKE 'NN%' THEN lower(t0 || ' ' || t1) END,
    CASE WHEN regexp_matches(p0, '^(NN|JJ)') AND regexp_matches(p1, '^(NN|JJ)') AND p2 LIKE 'NN%' THEN lower(t0 || ' ' || t1 || ' ' || t2) END,
    CASE WHEN regexp_matches(p0, '^(NN|JJ)') AND regexp_matches(p1, '^(NN|JJ)') AND regexp_matches(p2, '^(NN|JJ)') AND p3 LIKE 'NN%' THEN lower(t0 || ' ' || t1 || ' ' || t2 || ' ' || t3) END]) AS term
  FROM (SELECT token AS t0, pos AS p0, lead(token, 1) OVER w AS t1, lead(token, 2) OVER w AS t2, lead(token, 3) OVER w AS t3, lead(pos, 1) OVER w AS p1, lead(pos, 2) OVER w AS p2, lead(pos, 3) OVER w AS p3
    FROM toks WINDOW w AS (PARTITION BY doc_id ORDER BY sent_index, tok_index))) WHERE term IS NOT NULL GROUP BY 1 HAVING count(*) >= 2"""


@query("-- toks\n" + _COMPOUND)
def compound_terms(spark, sf):
    return keyness.compound_terms(_toks(spark, sf))


@query(f"""-- toks
SELECT 'single' AS kind, term, n FROM ({_CANDIDATES}) UNION ALL SELECT 'compound', term, n FROM ({_COMPOUND.replace(">= 2", ">= 3")})""")
def filtered_candidates(spark, sf):
    return keyness.filtered_candidates(_toks(spark, sf), focus="nouns", types=_types(spark, sf))


_VALID = rf"""length(term) >= 2 AND regexp_matches(term, '\p{{L}}') AND lower(term) NOT IN ('i.e', 'e.g', 'etc', 'vs', 'cf') AND lower(term) NOT IN ({_quoted(CONTRACTION_FRAGMENTS)})
  AND NOT (length(regexp_replace(term, '[^!-/:-@\[-`{{-~]', '', 'g')) > 0 AND length(regexp_replace(term, '[^\p{{L}}]', '', 'g')) <= 2 AND length(regexp_replace(term, '[^!-/:-@\[-`{{-~]', '', 'g')) >= length(regexp_replace(term, '[^\p{{L}}]', '', 'g')))"""


@query(f"""-- lem
SELECT term FROM lem WHERE {_VALID}""")
def valid_terms(spark, sf):
    return frequency.corpus_frequencies(_types(spark, sf), use_lemmas=True).where(keyness.is_valid_term(F.col("term"))).select("term")


_ENTRIES = """SELECT b.term, b.term AS lemma, m.pos, NULL::VARCHAR AS definition, notes, coalesce(e.examples, []) AS examples FROM best b
  LEFT JOIN (SELECT term, arg_min(pos, (-c, pos)) AS pos FROM (SELECT lower(token) AS term, pos, count(*) AS c FROM toks GROUP BY 1, 2) GROUP BY 1) m ON m.term = lower(b.term)
  LEFT JOIN (SELECT term, list(trim(sentence) ORDER BY doc_id, sent_index)[1:3] AS examples FROM sentences JOIN best ON contains(lower(sentence), lower(term)) GROUP BY 1) e ON e.term = b.term"""


@query(f"""-- tvr
SELECT term, round(score, 9) AS score FROM tvr ORDER BY tvr.score DESC, 1 LIMIT 50""")
def tfidf_top_n(spark, sf):
    return keyness.top_terms(keyness.tfidf_vs_reference(_types(spark, sf), _ref(spark, sf)), "score").select("term", _r("score"))


@query(f"""-- toks, tvr
, best AS (SELECT term, 'Method: tfidf' AS notes FROM tvr ORDER BY score DESC, 1 LIMIT 20) {_ENTRIES}""")
def suggested_by_tfidf(spark, sf):
    sents = _sents(spark, sf)
    return suggest.by_method(sents, annotate.types(annotate.words(sents)), _ref(spark, sf), "tfidf", 20)


@query(f"""-- toks, defs
, best AS (SELECT lower(term) AS term, 'Method: definitional' AS notes FROM defs GROUP BY 1 HAVING count(*) >= 2 ORDER BY 1 LIMIT 20) {_ENTRIES}""")
def suggested_by_definitions(spark, sf):
    sents = _sents(spark, sf)
    return suggest.by_method(sents, annotate.types(annotate.words(sents)), _ref(spark, sf), "definitional", 20)


# --- definitions and the hybrid score


@query("""-- defs
SELECT doc_id, sent_index, sentence, kind, term FROM defs""")
def definitional_contexts(spark, sf):
    return definitions.definitional_contexts(_sents(spark, sf))


@query("""-- defs
SELECT lower(term) AS term, count(*) AS n FROM defs GROUP BY 1""")
def definition_counts(spark, sf):
    return definitions.definition_counts(definitions.definitional_contexts(_sents(spark, sf)))


@query("""-- defs
SELECT lower(term) AS term, count(*) AS n FROM defs GROUP BY 1 HAVING count(*) >= 2""")
def highly_defined(spark, sf):
    return definitions.highly_defined(definitions.definitional_contexts(_sents(spark, sf)))


@query(f"""-- defs
SELECT sentence, kind FROM defs WHERE lower(term) = '{TERM}'""")
def definitional_sentences(spark, sf):
    return definitions.definitional_sentences(definitions.definitional_contexts(_sents(spark, sf)), TERM)


@query("""-- defs
SELECT kind, count(*) AS n FROM defs GROUP BY 1""")
def definition_pattern_counts(spark, sf):
    return definitions.pattern_counts(definitions.definitional_contexts(_sents(spark, sf)))


@query(f"""-- defs
SELECT lower(term) AS term, doc_id, sent_index, sentence FROM defs WHERE lower(term) IN ({_quoted(WORDS)})""")
def terms_with_definitions(spark, sf):
    return definitions.terms_with_definitions(definitions.definitional_contexts(_sents(spark, sf)), spark.createDataFrame([(w,) for w in WORDS], "term string"))


_SCORES = f"""SELECT term, n, round(ratio, 9) AS ratio, round(tfidf, 9) AS tfidf, neologism, round(definitional, 9) AS definitional, capitalized, round(ratio + tfidf + neologism + definitional + capitalized, 9) AS total FROM (
  SELECT c.term, c.n, ratio / (SELECT max(ratio) FROM cmp) AS ratio, score / (SELECT CASE WHEN max(score) > 0 THEN max(score) ELSE 1 END FROM tvr) AS tfidf, CASE WHEN neo.term IS NULL THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS neologism,
    0.3::DOUBLE * coalesce(d.n, 0) / (SELECT max(n) FROM dn) AS definitional, CASE WHEN cap.term IS NULL THEN 0.0::DOUBLE ELSE 0.2::DOUBLE END AS capitalized
  FROM cmp c JOIN tvr USING (term) LEFT JOIN neo USING (term) LEFT JOIN dn d USING (term) LEFT JOIN cap USING (term)) WHERE {_VALID}"""
_PARTS["dn"] = "dn AS (SELECT lower(term) AS term, count(*) AS n FROM defs GROUP BY 1)"
_NEEDS["dn"] = ["defs"]


def _scores(spark, sf):
    sents = _sents(spark, sf)
    return scorer.score_all(sents, annotate.types(annotate.words(sents)), _ref(spark, sf), _ref(spark, sf))


@query("-- cmp, tvr, neo, dn, cap\n" + _SCORES)
def hybrid_score(spark, sf):
    return _scores(spark, sf).select("term", "n", *[_r(c) for c in ("ratio", "tfidf", "neologism", "definitional", "capitalized", "total")])


@query(f"""-- cmp, tvr, neo, dn, cap
SELECT term, total FROM ({_SCORES}) WHERE (ratio > 0.1)::INT + (tfidf > 0.1)::INT + (neologism > 0)::INT + (definitional > 0)::INT + (capitalized > 0)::INT >= 2 AND total >= 0.3""")
def high_confidence(spark, sf):
    return scorer.high_confidence(_scores(spark, sf), 2, 0.3).select("term", _r("total"))


@query("""-- toks
SELECT term, arg_min(pos, (-c, pos)) AS pos FROM (SELECT lower(token) AS term, pos, count(*) AS c FROM toks GROUP BY 1, 2) GROUP BY 1""")
def modal_pos(spark, sf):
    return scorer.modal_pos(_types(spark, sf))


@query("""-- inc
SELECT t AS term, doc_id, sent_index, sentence FROM inc JOIN sentences USING (doc_id, sent_index) QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id, sent_index) <= 3""")
def example_sentences(spark, sf):
    return scorer.example_sentences(_sents(spark, sf), TERMS)


# --- search


@query("""-- occ
SELECT doc_id, sent_index, sentence, list("at"::INT ORDER BY "at") AS term_positions FROM occ GROUP BY 1, 2, 3""")
def find_sentences(spark, sf):
    return search.find_sentences(_sents(spark, sf), TERM)


@query("""-- inc
SELECT t AS term, doc_id, sent_index, sentence FROM inc JOIN sentences USING (doc_id, sent_index)""")
def find_any(spark, sf):
    return search.find_any(_sents(spark, sf), TERMS)


@query("""-- sents
SELECT doc_id, sent_index, sentence FROM sentences WHERE contains(lower(sentence), 'the') AND contains(lower(sentence), 'was')""")
def find_all(spark, sf):
    return search.find_all(_sents(spark, sf), ["the", "was"])


@query("""-- occ
SELECT count(*) AS n FROM occ""")
def count_occurrences(spark, sf):
    return search.count_occurrences(_sents(spark, sf), TERM)


@query("""-- toks
SELECT doc_id, sent_index, sentence, list((instr(sentence, token) - 1)::INT ORDER BY tok_index) AS term_positions FROM toks JOIN sentences USING (doc_id, sent_index) WHERE lemma = 'be' GROUP BY 1, 2, 3""")
def find_lemma(spark, sf):
    sents = _sents(spark, sf)
    return search.find_lemma(sents, annotate.tokens(sents), "be")


@query("""-- kw
SELECT doc_id, sent_index, "at", left_context, keyword, right_context FROM kw""")
def kwic(spark, sf):
    return search.concordance(_sents(spark, sf), TERM)


@query("""-- kw
SELECT doc_id, sent_index, "at", left_context, keyword, right_context FROM kw ORDER BY reverse(lower(left_context)), doc_id, sent_index, "at" """)
def kwic_sorted(spark, sf):
    return search.concordance_sorted(search.concordance(_sents(spark, sf), TERM))


@query("""-- kw
SELECT doc_id, sent_index, "at", left_context, keyword, right_context FROM kw WHERE contains(lower(left_context || ' ' || right_context), 'was') OR contains(lower(left_context || ' ' || right_context), 'tion')""")
def kwic_filtered(spark, sf):
    return search.concordance_filtered(search.concordance(_sents(spark, sf), TERM), ["was", "tion"])


@query("""-- kw
SELECT lpad(left_context, greatest(50, length(left_context))::INT, ' ') || ' [' || keyword || '] ' || rpad(right_context, greatest(50, length(right_context))::INT, ' ') AS line FROM kw""")
def kwic_lines(spark, sf):
    return search.format_lines(search.concordance(_sents(spark, sf), TERM))


@query(f"""-- sents
SELECT doc_id, sent_index, sentence, coalesce(before, []) AS before, coalesce(after, []) AS after FROM (SELECT *, list(trim(sentence)) OVER (PARTITION BY doc_id ORDER BY sent_index ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING) AS before,
  list(trim(sentence)) OVER (PARTITION BY doc_id ORDER BY sent_index ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS after FROM sentences) WHERE contains(lower(sentence), '{TERM}')""")
def context_window(spark, sf):
    sents = _sents(spark, sf)
    return search.context_windows(sents, search.dispersion(sents, TERM))


@query(f"""-- hits
SELECT doc_id, sent_index, regexp_replace(sentence, '({TERM})', '**\\1**', 'gi') AS shown FROM hits""")
def highlights(spark, sf):
    return search.find_all(_sents(spark, sf), [TERM]).select("doc_id", "sent_index", search.highlighted(F.col("sentence"), TERM).alias("shown"))


@query("""-- hits
SELECT doc_id, sent_index FROM hits""")
def dispersion(spark, sf):
    return search.dispersion(_sents(spark, sf), TERM)


@query("""-- inc
SELECT term, total_docs, docs_with_term, round(100.0 * docs_with_term / total_docs, 9) AS coverage, total, round(CASE WHEN docs_with_term > 0 THEN total / docs_with_term ELSE 0 END, 9) AS average FROM (
  SELECT t AS term, (SELECT count(DISTINCT doc_id) FROM sentences) AS total_docs, count(DISTINCT doc_id) AS docs_with_term, count(*) AS total FROM inc GROUP BY 1)""")
def dispersion_summary(spark, sf):
    return search.dispersion_summary(_sents(spark, sf), TERMS).select("term", "total_docs", "docs_with_term", _r("coverage"), "total", _r("average"))


@query(f"""-- sents
SELECT doc_id, count(*) AS n_sentences, coalesce(list(sent_index::INT ORDER BY sent_index) FILTER (contains(lower(sentence), '{TERM}')), []) AS positions FROM sentences GROUP BY 1""")
def dispersion_plot(spark, sf):
    return search.dispersion_plot(_sents(spark, sf), TERM)


@query("""-- sents
SELECT doc_id, start, hits, round(hits / 10, 9) AS density FROM (SELECT doc_id, sent_index::INT AS start, (sum(contains(lower(sentence), 'was')::INT) OVER w)::BIGINT AS hits, count(*) OVER w AS size FROM sentences WINDOW w AS (PARTITION BY doc_id ORDER BY sent_index ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)) WHERE size = 10 AND hits >= 3""")
def dense_regions(spark, sf):
    return search.dense_regions(_sents(spark, sf), "was").select("doc_id", "start", "hits", _r("density"))


@query("""-- sig
SELECT doc_id, sent_index, term, round(score, 9) AS score FROM sig""")
def significant_terms(spark, sf):
    sents = _sents(spark, sf)
    return search.significant_terms(sents, annotate.types(annotate.words(sents)), TERM).select("doc_id", "sent_index", "term", _r("score"))


@query("""-- sig
SELECT term, round(avg(score), 9) AS score, count(*) AS n FROM sig GROUP BY 1""")
def significant_terms_agg(spark, sf):
    sents = _sents(spark, sf)
    return search.aggregate_significant(search.significant_terms(sents, annotate.types(annotate.words(sents)), TERM)).select("term", _r("score"), "n")


@query("""-- content
SELECT term, f FROM freq""")
def content_frequencies(spark, sf):
    return search.content_frequencies(_types(spark, sf))


# --- co-occurrence


@query(f"""-- side
SELECT word, count(*) AS n FROM side WHERE contains(lower(sentence), '{TERM}') AND word <> '{TERM}' GROUP BY 1""")
def cooccur_sentence(spark, sf):
    return cooccurrence.in_sentence(_sents(spark, sf), TERM)


@query(f"""-- side
SELECT word, count(*) AS n FROM side WHERE contains(lower(sentence), '{TERM}') AND word <> '{TERM}' AND word IN ({_quoted(WORDS)}) GROUP BY 1""")
def cooccur_filtered(spark, sf):
    return cooccurrence.filtered(cooccurrence.in_sentence(_sents(spark, sf), TERM), spark.createDataFrame([(w,) for w in WORDS], "term string"))


@query(f"""-- side
SELECT word, count(*) AS n FROM side WHERE (doc_id, sent_index // 5) IN (SELECT (doc_id, sent_index // 5) FROM sentences WHERE contains(lower(sentence), '{TERM}')) AND word <> '{TERM}' GROUP BY 1""")
def cooccur_paragraph(spark, sf):
    return cooccurrence.in_paragraph(_sents(spark, sf), TERM, F.floor(F.col("sent_index") / 5))


@query("""-- side
SELECT word, sum(times)::BIGINT AS n FROM side JOIN (SELECT s.doc_id, s.sent_index, count(*) AS times FROM sentences s JOIN sentences h ON s.doc_id = h.doc_id AND abs(s.sent_index - h.sent_index) <= 3 AND contains(lower(h.sentence), 'was') GROUP BY 1, 2) USING (doc_id, sent_index) WHERE word <> 'was' GROUP BY 1""")
def cooccur_within_n(spark, sf):
    return cooccurrence.within_n(_sents(spark, sf), "was")


@query("""-- pairs
SELECT t1, t2, round(log2((a / n) / ((n1 / n) * (n2 / n))), 9) AS score FROM counted""")
def pmi_pairs(spark, sf):
    return cooccurrence.pmi(cooccurrence.pair_counts(_sents(spark, sf), TERMS)).select("t1", "t2", _r("score"))


@query("""-- pairs
SELECT t1, t2, round(2 * (a * ln(a * n / (n1 * n2)) + CASE WHEN n1 > a THEN (n1 - a) * ln((n1 - a) * n / (n1 * (n - n2))) ELSE 0 END + CASE WHEN n2 > a THEN (n2 - a) * ln((n2 - a) * n / ((n - n1) * n2)) ELSE 0 END
  + CASE WHEN n - n1 - n2 + a > 0 THEN (n - n1 - n2 + a) * ln((n - n1 - n2 + a) * n / ((n - n1) * (n - n2))) ELSE 0 END), 6) AS score FROM counted""")
def llr_pairs(spark, sf):
    return cooccurrence.log_likelihood(cooccurrence.pair_counts(_sents(spark, sf), TERMS)).select("t1", "t2", F.round("score", 6).alias("score"))


@query("""-- mat
SELECT t1, t2, score FROM mat""")
def cooccur_matrix(spark, sf):
    return cooccurrence.matrix(_sents(spark, sf), WORDS)


@query(f"""-- side
SELECT word, count(*) AS n FROM side WHERE contains(lower(sentence), '{TERM}') AND word <> '{TERM}' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def top_cooccurrences(spark, sf):
    return cooccurrence.top_cooccurrences(cooccurrence.in_sentence(_sents(spark, sf), TERM))


@query(f"""-- pairs
SELECT CASE WHEN t1 = '{TERM}' THEN t2 ELSE t1 END AS word, round(log2((a / n) / ((n1 / n) * (n2 / n))), 9) AS score FROM counted WHERE '{TERM}' IN (t1, t2) ORDER BY log2((a / n) / ((n1 / n) * (n2 / n))) DESC, 1 LIMIT 5""")
def top_by_pmi(spark, sf):
    return cooccurrence.top_associations(_sents(spark, sf), TERM, TERMS, 5).select("word", _r("score"))


@query("""-- side
, w AS (SELECT unnest([""" + _quoted(WORDS) + """]) AS t),
times AS (SELECT s.doc_id, s.sent_index, w.t AS t1, count(*) AS k FROM sentences s JOIN sentences x ON x.doc_id = s.doc_id AND abs(x.sent_index - s.sent_index) <= 1 JOIN w ON contains(lower(x.sentence), w.t) GROUP BY 1, 2, 3)
SELECT t1, side.word AS t2, sum(k)::DOUBLE AS score FROM times JOIN side USING (doc_id, sent_index) WHERE side.word IN (SELECT t FROM w) AND t1 < side.word GROUP BY 1, 2""")
def cooccur_cells_near(spark, sf):
    return cooccurrence.cells(_sents(spark, sf), WORDS, "count", "n_sentences", 1)


# --- relations and contexts


def _lines(spark, sf):
    sents = _sents(spark, sf)
    return relations.coded(sents)


@query("""-- svo
SELECT doc_id, sent_index, sentence, subject, verb, object FROM svo""")
def svo_triples(spark, sf):
    return relations.svo(_lines(spark, sf))


@query("""-- svo
SELECT doc_id, sent_index, sentence, subject, verb, object FROM svo WHERE contains(lower(subject), 'tion') OR contains(lower(verb), 'tion') OR contains(lower(object), 'tion')""")
def svo_for_term(spark, sf):
    return relations.svo_for_term(relations.svo(_lines(spark, sf)), "tion")


@query("""-- cop
SELECT doc_id, sent_index, sentence, subject, copula, complement FROM cop""")
def copular_relations(spark, sf):
    return relations.copular(_lines(spark, sf), "tion")


@query("""-- prp
SELECT doc_id, sent_index, sentence, head, preposition, object FROM prp""")
def prep_relations(spark, sf):
    return relations.prepositional(_lines(spark, sf), "tion")


@query("""-- svo, cop, prp
SELECT relation_type, source, target, connector, min(role) AS role, count(*) AS n, list(sentence ORDER BY doc_id, sent_index)[1:100] AS evidence FROM (
  SELECT 'svo' AS relation_type, subject AS source, object AS target, verb AS connector, 'subject' AS role, doc_id, sent_index, sentence FROM svo WHERE contains(lower(subject), 'tion')
  UNION ALL SELECT 'svo', subject, object, verb, 'object', doc_id, sent_index, sentence FROM svo WHERE contains(lower(object), 'tion')
  UNION ALL SELECT 'copular', subject, complement, copula, NULL, doc_id, sent_index, sentence FROM cop
  UNION ALL SELECT 'prep', head, object, preposition, NULL, doc_id, sent_index, sentence FROM prp) GROUP BY 1, 2, 3, 4""")
def relations_agg(spark, sf):
    return relations.relations(_lines(spark, sf), "tion")


@query()
def contextual_relations(spark, sf):
    sents = _sents(spark, sf)
    return context.contextual_relations(sents, annotate.types(annotate.words(sents)), "tion")


# --- graphs


def _graph(spark, sf):
    return graph.from_matrix(metrics.stored(cooccurrence.matrix(_sents(spark, sf), WORDS)), 50.0)


@query("""-- edges
, RECURSIVE_EDGES AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
one AS (SELECT min(b) AS id FROM RECURSIVE_EDGES WHERE a = 'and' AND b = 'was'),
two AS (SELECT x.b AS id FROM RECURSIVE_EDGES x JOIN RECURSIVE_EDGES y ON x.b = y.a WHERE x.a = 'and' AND y.b = 'was' ORDER BY 1 LIMIT 1)
SELECT 0 AS place, 'and' AS id UNION ALL SELECT 1, id FROM two WHERE (SELECT id FROM one) IS NULL UNION ALL SELECT CASE WHEN (SELECT id FROM one) IS NULL THEN 2 ELSE 1 END, 'was'""")
def shortest_path(spark, sf):
    path = metrics.shortest_path(_graph(spark, sf), "and", "was")
    return spark.createDataFrame(list(enumerate(path)), "place int, id string")


@query("""-- edges
SELECT src, dst, weight FROM edges""")
def graph_edges(spark, sf):
    return _graph(spark, sf).edges.select("src", "dst", "weight")


@query("""-- edges
SELECT src, dst, weight FROM edges WHERE weight >= 500""")
def graph_prune(spark, sf):
    return graph.prune_edges(_graph(spark, sf), 500.0).edges.select("src", "dst", "weight")


@query("""-- edges
SELECT id FROM nodes WHERE (SELECT count(*) FROM ends WHERE ends.id = nodes.id) >= 3""")
def graph_prune_nodes(spark, sf):
    return graph.prune_nodes(_graph(spark, sf), 3).nodes.select("id")


@query("""-- half
SELECT t1 AS src, t2 AS dst, score AS weight FROM half WHERE score >= 50 AND t1 IN ('and', 'the', 'of') AND t2 IN ('and', 'the', 'of')""")
def graph_subgraph(spark, sf):
    return graph.subgraph(_graph(spark, sf), spark.createDataFrame([("and",), ("the",), ("of",)], "term string")).edges.select("src", "dst", "weight")


@query("""-- edges
SELECT src, dst, weight FROM edges UNION ALL SELECT 'new', 'the', 7.0""")
def graph_merge(spark, sf):
    more = graph.graph(spark.createDataFrame([("new",), ("the",)], "id string"), spark.createDataFrame([("the", "new", 7.0)], "src string, dst string, weight double"))
    return graph.merged(_graph(spark, sf), more).edges.select("src", "dst", "weight")


@query("""-- edges
SELECT id FROM nodes WHERE id NOT IN (SELECT id FROM ends)""")
def isolated_nodes(spark, sf):
    return graph.isolated(_graph(spark, sf)).select("id")


@query("""-- edges
SELECT id, round(count(ends.id) / (SELECT count(*) - 1 FROM nodes), 9) AS score FROM nodes LEFT JOIN ends USING (id) GROUP BY 1""")
def degree_centrality(spark, sf):
    return metrics.degree_centrality(_graph(spark, sf)).select("id", _r("score"))


@query("""-- edges
SELECT 2.0 * (SELECT count(*) FROM edges) / (count(*) * (count(*) - 1)) AS density FROM nodes""")
def density(spark, sf):
    return metrics.density(_graph(spark, sf))


@query()
def betweenness(spark, sf):
    return metrics.betweenness(_graph(spark, sf))


@query()
def closeness(spark, sf):
    return metrics.closeness(_graph(spark, sf))


@query()
def pagerank(spark, sf):
    return metrics.pagerank(_graph(spark, sf)).select("id", F.round("score", 4).alias("score"))


@query()
def eigenvector(spark, sf):
    return metrics.eigenvector(_graph(spark, sf)).select("id", F.round("score", 4).alias("score"))


@query()
def communities(spark, sf):
    return metrics.communities(_graph(spark, sf))


@query("""-- edges
SELECT id, min(r) AS component FROM (WITH RECURSIVE reach(id, r) AS (SELECT id, id FROM nodes UNION SELECT CASE WHEN src = reach.id THEN dst ELSE src END, r FROM reach JOIN edges ON src = reach.id OR dst = reach.id) SELECT * FROM reach) GROUP BY 1""")
def components(spark, sf):
    return metrics.components(_graph(spark, sf))


# --- cleaning, structure, rewriting, term lists


@query()
def clean_text(spark, sf):
    return _docs(spark, sf).select("doc_id", clean.clean_text(F.col("text")).alias("text"))


@query(r"""--
SELECT doc_id, len(regexp_extract_all(text, '[0-9]+\s+\.\s+[0-9]+')) AS spacing_in_numbers, len(regexp_extract_all(text, '[\p{L}\p{M}\p{Nd}_][!/\\|][\p{L}\p{M}\p{Nd}_]')) AS special_chars_in_words,
  len(regexp_extract_all(plain, '(?i)\b[a-z]{3,}[bcdfghjklmnpqrstvwxyz]\s+[aeiouy][a-z]{2,}\b')) + len(regexp_extract_all(plain, '(?i)\b[a-z]{3,}[aeiouy]\s+[bcdfghjklmnpqrstvwxyz][a-z]{2,}\b')) AS possible_split_words,
  len([x FOR x IN l IF regexp_full_match(x, '[0-9]{1,5}')]) AS page_numbers, len([x FOR x IN l IF NOT regexp_full_match(x, '[0-9]{1,5}') AND regexp_full_match(x, '[0-9]+(\s+[0-9]+){3,}')]) AS number_clusters
FROM (SELECT *, regexp_replace(regexp_replace(text, '[^\x00-\x7F\p{L}\p{M}\p{Nd}]', '#', 'g'), '[^\x00-\x7F]', '_', 'g') AS plain, [regexp_replace(x, '^\s+|\s+$', '', 'g') FOR x IN string_split(text, chr(10))] AS l FROM documents)""")
def ocr_issues(spark, sf):
    return _docs(spark, sf).select("doc_id", clean.ocr_issues(F.col("text")).alias("i")).select("doc_id", "i.*")


@query("""--
SELECT doc_id, p AS paragraph FROM (SELECT doc_id, regexp_replace(unnest(regexp_split_to_array(text, '\\n\\s*\\n')), '^\\s+|\\s+$', '', 'g') AS p FROM documents) WHERE p <> ''""")
def paragraphs(spark, sf):
    return _docs(spark, sf).select("doc_id", F.explode(structure.paragraphs(F.col("text"))).alias("paragraph"))


def _page_docs(spark, sf):
    """Pages as text: h1 as a markdown heading, a second heading for each page's language section."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    body = F.regexp_replace(F.regexp_replace(F.col("html"), r"(?s)^.*?<h1>(.*?)</h1>", "\n# $1\n"), r"<p[^>]*>", "\n## Part\n")
    return pages.select(F.col("page_id").alias("doc_id"), F.regexp_replace(body, r"<[^>]*>", " ").alias("text"))


@query()
def headings(spark, sf):
    return structure.headings(_page_docs(spark, sf))


@query()
def sentence_locations(spark, sf):
    docs = _page_docs(spark, sf)
    return structure.sentence_locations(annotate.sentences(docs), structure.headings(docs))


@query()
def section_filter(spark, sf):
    docs = _page_docs(spark, sf)
    found = structure.sentence_locations(annotate.sentences(docs), structure.headings(docs)).withColumn("located", F.lit(True))
    return found.where(structure.location_passes("1", "^x")).select("doc_id", "sent_index", "chapter")


def _contents(spark, sf):
    """For each document its first lines as entries of a table of contents."""
    lines = _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "title")).where("line between 3 and 6 and title <> ''")
    chapter = F.col("line") % 2 == 1
    return lines.select("doc_id", "line", F.when(chapter, "level_0").otherwise("level_1").alias("level"), F.when(chapter, F.col("line").cast("string")).otherwise(F.concat((F.col("line") - 1).cast("string"), F.lit(".1"))).alias("number"), "title")


@query()
def headings_by_contents(spark, sf):
    return structure.headings_by_contents(_docs(spark, sf), _contents(spark, sf))


@query("""-- sents
SELECT doc_id, sent_index, coalesce(list_max([i FOR b, i IN blocks IF trim(b) <> '' AND contains(b, trim(sentence))]), 1) AS paragraph
FROM sentences JOIN (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '\\n', chr(10) || chr(10), 'g'), '\\n\\s*\\n') AS blocks FROM documents) USING (doc_id)""")
def sentence_paragraphs(spark, sf):
    apart = _docs(spark, sf).select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return structure.sentence_paragraphs(_sents(spark, sf), apart)


@query("""-- hits
SELECT h.doc_id, h.sent_index AS match_index, slot::INT AS slot, s.sentence FROM (SELECT doc_id, sent_index, unnest([-1, 0, 1]) AS slot FROM hits) h LEFT JOIN sentences s ON s.doc_id = h.doc_id AND s.sent_index = h.sent_index + slot""")
def window_slots(spark, sf):
    sents = _sents(spark, sf)
    return structure.window_slots(sents, search.dispersion(sents, TERM), 1)


def _nested(spark, sf):
    sents = _sents(spark, sf)
    return annotate.nested(sents, annotate.tokens(sents))


@query("""-- toks
SELECT doc_id, start, [t0, t1] AS tokens FROM (SELECT doc_id, (row_number() OVER w - 1)::INT AS start, token AS t0, lemma AS l0, lead(token) OVER w AS t1, lead(lemma) OVER w AS l1 FROM toks WINDOW w AS (PARTITION BY doc_id ORDER BY sent_index, tok_index)) WHERE l0 = 'of' AND l1 = 'the'""")
def phrase_matches(spark, sf):
    return rewrite.phrase_matches(_nested(spark, sf), ["of", "the"]).select("doc_id", "start", "tokens")


def _inflected_sql() -> str:
    def shorter(n: int, ending: str) -> str:
        return f"left(lemma, length(lemma) - {n}) || '{ending}'"

    short, y = "regexp_full_match(lemma, '[^aeiou]?[aeiou][^aeiouwyxz]')", "regexp_matches(lemma, '[^aeiou]y$')"
    twice = lambda ending: f"lemma || right(lemma, 1) || '{ending}'"
    compare = lambda e, t: f"CASE WHEN lemma LIKE '%e' THEN lemma || '{t}' WHEN lemma LIKE '_%y' THEN {shorter(1, 'i' + e)} WHEN {short} THEN {twice(e)} ELSE lemma || '{e}' END"
    irregular = []
    for verb, forms in inflect.VERBS.items():
        past, participle, present, third = forms.split()
        irregular += [(verb, "VBD", past), (verb, "VBN", participle), (verb, "VBG", present), (verb, "VBZ", third)]
    irregular.append(("be", "VBP", "are"))
    for adjective, forms in inflect.ADJECTIVES.items():
        irregular += [(adjective, t, f) for t, f in zip(("JJR", "JJS"), forms.split(), strict=True)]
    irregular += [(noun, "NNS", plural) for noun, plural in inflect.PLURALS.items()]
    table = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in irregular)
    return f"""-- toks
SELECT lemma, tag, coalesce(irregular, CASE
  WHEN tag IN ('NNS', 'VBZ') THEN CASE WHEN regexp_matches(lemma, '(s|x|z|ch|sh)$') THEN lemma || 'es' WHEN {y} THEN {shorter(1, 'ies')} ELSE lemma || 's' END
  WHEN tag IN ('VBD', 'VBN') THEN CASE WHEN lemma LIKE '%e' THEN lemma || 'd' WHEN {y} THEN {shorter(1, 'ied')} WHEN {short} THEN {twice('ed')} ELSE lemma || 'ed' END
  WHEN tag = 'VBG' THEN CASE WHEN lemma LIKE '%e' AND lemma NOT LIKE '%ee' THEN {shorter(1, 'ing')} WHEN {short} THEN {twice('ing')} ELSE lemma || 'ing' END
  WHEN tag = 'JJR' THEN {compare('er', 'r')} WHEN tag = 'JJS' THEN {compare('est', 'st')} ELSE lemma END) AS form
FROM (SELECT DISTINCT lemma FROM toks) CROSS JOIN (SELECT unnest([{_quoted(inflect.TAGS)}]) AS tag) LEFT JOIN (VALUES {table}) AS t(lemma, tag, irregular) USING (lemma, tag)"""


@query(_inflected_sql())
def inflected_forms(spark, sf):
    lemmas = frequency.vocabulary(_types(spark, sf), use_lemmas=True).select(F.col("term").alias("lemma"))
    return inflect.all_forms(lemmas)


@query()
def replace_terms(spark, sf):
    return rewrite.replace_lemma(_nested(spark, sf), "be", "become").select("doc_id", rewrite.rebuilt(F.col("tokens")).alias("text"))


@query()
def replace_phrases(spark, sf):
    return rewrite.replace_phrase(_nested(spark, sf), ["of", "the"], ["out", "of"]).select("doc_id", rewrite.rebuilt(F.col("tokens")).alias("text"))


def _lists(spark, sf):
    toks = _types(spark, sf)
    nouns = keyness.term_candidates(toks, "nouns").select("term", F.col("n").cast("string").alias("notes"), F.lit("NN").alias("pos"))
    verbs = keyness.term_candidates(toks, "verbs").select("term", F.col("n").cast("string").alias("notes"), F.lit("VB").alias("pos"))
    return terms.shaped(nouns), terms.shaped(verbs)


_VERBS = _CANDIDATES.replace(_NOUNS, _quoted(keyness.FOCUS["verbs"]))


@query(f"""-- toks
SELECT term, 'NN' AS pos, n::VARCHAR AS notes FROM ({_CANDIDATES}) UNION ALL SELECT term, 'VB', n::VARCHAR FROM ({_VERBS}) WHERE term NOT IN (SELECT term FROM ({_CANDIDATES}))""")
def term_list_merge(spark, sf):
    return terms.merge(*_lists(spark, sf)).select("term", "pos", "notes")


@query(f"""-- toks
SELECT pos, count(*) AS n, 0::BIGINT AS with_lemma, count(*) AS with_notes FROM (SELECT term, 'NN' AS pos FROM ({_CANDIDATES}) UNION ALL SELECT term, 'VB' FROM ({_VERBS}) WHERE term NOT IN (SELECT term FROM ({_CANDIDATES}))) GROUP BY 1""")
def term_stats(spark, sf):
    return terms.statistics(terms.merge(*_lists(spark, sf))).select("pos", "n", "with_lemma", "with_notes")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
