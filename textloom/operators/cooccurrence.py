"""Words and terms that stand together: counts, PMI, log-likelihood, matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.search import contains

EDGE = ".,;:!?\"()[]{}"


def side_words(sentence: Column) -> Column:
    """Words between white space, without edge punctuation, lower-cased."""
    return F.filter(F.transform(F.split(F.lower(sentence), r"\s+"), lambda w: F.btrim(w, F.lit(EDGE))), lambda w: w != "")


def _counted(sents: DataFrame, term: str) -> DataFrame:
    return sents.select(F.explode(side_words(F.col("sentence"))).alias("word")).where(F.col("word") != term.lower()).groupBy("word").agg(F.count("*").alias("n"))


def in_sentence(sents: DataFrame, term: str, case_sensitive: bool = False) -> DataFrame:
    """(word, n): words of the sentences that contain ``term``."""
    return _counted(sents.where(contains(term, case_sensitive)), term)


def filtered(counts: DataFrame, terms: DataFrame) -> DataFrame:
    return counts.join(terms.select(F.lower("term").alias("word")).distinct(), "word", "left_semi")


def in_paragraph(sents: DataFrame, term: str, paragraph: Column, case_sensitive: bool = False) -> DataFrame:
    """As ``in_sentence`` over paragraphs: all sentences of one that has a match."""
    marked = sents.withColumn("paragraph", paragraph)
    hit = marked.where(contains(term, case_sensitive)).select("doc_id", "paragraph").distinct()
    return _counted(marked.join(hit, ["doc_id", "paragraph"], "left_semi"), term)


def within_n(sents: DataFrame, term: str, n_sentences: int = 3, case_sensitive: bool = False) -> DataFrame:
    """(word, n) over the n sentences on either side of each match; a sentence counts once for each match near it."""
    w = Window.partitionBy("doc_id").orderBy("sent_index").rangeBetween(-n_sentences, n_sentences)
    near = sents.withColumn("times", F.sum(contains(term, case_sensitive).cast("long")).over(w)).where("times > 0")
    words = near.select("times", F.explode(side_words(F.col("sentence"))).alias("word")).where(F.col("word") != term.lower())
    return words.groupBy("word").agg(F.sum("times").alias("n"))


def incidence(sents: DataFrame, terms: list[str], case_sensitive: bool = False) -> DataFrame:
    """(doc_id, sent_index, terms): the sorted terms that a sentence contains; sentences without any are left out."""
    hit = F.array_compact(F.array(*[F.when(contains(t, case_sensitive), F.lit(t)) for t in sorted(set(terms))]))
    return sents.select("doc_id", "sent_index", hit.alias("terms")).where(F.size("terms") > 0)


def pair_counts(sents: DataFrame, terms: list[str], case_sensitive: bool = False) -> DataFrame:
    """(t1, t2, a, n1, n2, n) for t1 < t2: sentences with both, with each, and in all.  Pairs are made inside a sentence, no join."""
    found = incidence(sents, terms, case_sensitive)
    pairs = F.flatten(F.transform("terms", lambda x, i: F.transform(F.slice("terms", i + 2, F.size("terms")), lambda y: F.struct(x.alias("t1"), y.alias("t2")))))
    both = found.select(F.explode(pairs).alias("p")).groupBy("p.t1", "p.t2").agg(F.count("*").alias("a"))
    each = found.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("k"))
    total = F.broadcast(sents.agg(F.count("*").alias("n")))  # one row
    # `each` has at most one row a listed term
    joined = both.join(each.select(F.col("t").alias("t1"), F.col("k").alias("n1")), "t1").join(each.select(F.col("t").alias("t2"), F.col("k").alias("n2")), "t2").join(total)
    return joined.select("t1", "t2", "a", "n1", "n2", "n")


def pmi(counts: DataFrame) -> DataFrame:
    n = F.col("n").cast("double")
    return counts.select("t1", "t2", F.log2((F.col("a") / n) / ((F.col("n1") / n) * (F.col("n2") / n))).alias("score"))


def log_likelihood(counts: DataFrame) -> DataFrame:
    """G of the 2 x 2 table of sentences."""
    n, a, n1, n2 = (F.col(c).cast("double") for c in ("n", "a", "n1", "n2"))
    part = lambda o, r, c: F.when(o > 0, o * F.ln(o * n / (r * c))).otherwise(0.0)
    g = part(a, n1, n2) + part(n1 - a, n1, n - n2) + part(n2 - a, n - n1, n2) + part(n - n1 - n2 + a, n - n1, n - n2)
    return counts.select("t1", "t2", (2 * g).alias("score"))


def exact_counts(sents: DataFrame, terms: list[str]) -> DataFrame:
    """(t1, t2, score) for t1 < t2: occurrences of the word t2 in sentences that contain t1 as a substring."""
    listed = sorted({t.lower() for t in terms})
    hit = F.array_compact(F.array(*[F.when(contains(t), F.lit(t)) for t in listed]))
    words = F.filter(side_words(F.col("sentence")), lambda w: w.isin(listed))
    pairs = sents.select(F.explode(hit).alias("t1"), words.alias("w")).select("t1", F.explode("w").alias("t2"))
    return pairs.where("t1 < t2").groupBy("t1", "t2").agg(F.count("*").cast("double").alias("score"))


def near_counts(sents: DataFrame, terms: list[str], n_sentences: int) -> DataFrame:
    """(t1, t2, score) for t1 < t2: occurrences of the word t2 within ``n_sentences`` of sentences that contain t1, once for each such sentence near it."""
    listed = sorted({t.lower() for t in terms})
    hit = F.array_compact(F.array(*[F.when(contains(t), F.lit(t)) for t in listed]))
    around = sents.select("doc_id", "sent_index", F.explode(hit).alias("t1")).withColumn("sent_index", F.explode(F.sequence(F.col("sent_index") - n_sentences, F.col("sent_index") + n_sentences)))
    times = around.groupBy("doc_id", "sent_index", "t1").agg(F.count("*").alias("times"))
    words = sents.select("doc_id", "sent_index", F.explode(F.filter(side_words(F.col("sentence")), lambda w: w.isin(listed))).alias("t2"))
    said = words.groupBy("doc_id", "sent_index", "t2").agg(F.count("*").alias("k"))
    return times.join(said, ["doc_id", "sent_index"]).where("t1 < t2").groupBy("t1", "t2").agg(F.sum(F.col("times") * F.col("k")).cast("double").alias("score"))


def cells(sents: DataFrame, terms: list[str], method: str = "count", window: str = "sentence", n_sentences: int | None = None) -> DataFrame:
    """(t1, t2, score) for t1 < t2: the pairs of listed terms that meet.  ``window``: sentence, or n_sentences (counts only)."""
    if window not in ("sentence", "n_sentences") or (window == "n_sentences") != (n_sentences is not None):
        raise ValueError("window is sentence, or n_sentences with their number")
    ways = {"count": lambda: exact_counts(sents, terms), "pmi": lambda: pmi(pair_counts(sents, terms)), "llr": lambda: log_likelihood(pair_counts(sents, terms))}
    if method not in ways:
        raise ValueError(f"unknown method {method!r}: one of {', '.join(ways)}")
    return near_counts(sents, terms, n_sentences) if method == "count" and window == "n_sentences" else ways[method]()


def matrix(sents: DataFrame, terms: list[str], method: str = "count", window: str = "sentence", n_sentences: int | None = None) -> DataFrame:
    """(t1, t2, score): every ordered pair of the listed terms; zero where they never meet, and on the diagonal."""
    half = cells(sents, terms, method, window, n_sentences)
    both = half.select(F.inline(F.array(F.struct("t1", "t2", "score"), F.struct(F.col("t2").alias("t1"), F.col("t1").alias("t2"), "score"))))
    names = sorted({t.lower() if method == "count" else t for t in terms})
    listed = sents.sparkSession.createDataFrame([(names,)], "names array<string>")
    full = listed.select(F.explode("names").alias("t1"), "names").select("t1", F.explode("names").alias("t2"))  # the list's own pairs
    return full.join(both, ["t1", "t2"], "left").select("t1", "t2", F.coalesce("score", F.lit(0.0)).alias("score"))


def top_associations(sents: DataFrame, term: str, terms: list[str], n: int = 10, method: str = "pmi") -> DataFrame:
    """(word, score): the listed terms that are most strongly tied to ``term`` by pmi or llr."""
    if method not in ("pmi", "llr"):
        raise ValueError(f"unknown method {method!r}: pmi or llr")
    t = term.lower()
    counts = pair_counts(sents, [t, *(x.lower() for x in terms)]).where((F.col("t1") == t) | (F.col("t2") == t))
    scored = pmi(counts) if method == "pmi" else log_likelihood(counts)
    named = scored.select(F.when(F.col("t1") == t, F.col("t2")).otherwise(F.col("t1")).alias("word"), "score")
    return named.orderBy(F.desc("score"), "word").limit(n)


def top_cooccurrences(counts: DataFrame, n: int = 10) -> DataFrame:
    return counts.orderBy(F.desc("n"), "word").limit(n)
