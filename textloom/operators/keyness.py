"""Terms that set a corpus apart from a background corpus, and terms that no dictionary has.

A background is a table (term, count).  All comparisons are joins on the term after both sides are aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.annotate import words_of
from textloom.functions.words import CONTRACTION_FRAGMENTS, STOPWORDS
from textloom.operators.frequency import corpus_frequencies, occurrences, term_of, word_frequencies

PUNCTUATION = r"[!-/:-@\[-`{-~]"


def reference_corpus(toks: DataFrame) -> DataFrame:
    """The background table of a token table."""
    return corpus_frequencies(toks).select("term", F.col("n").alias("count"))


def reference_size(reference: DataFrame) -> DataFrame:
    return reference.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("size"))


def _total(df: DataFrame, c: str) -> DataFrame:
    return df.agg(F.coalesce(F.sum(c), F.lit(0)).alias("total"))


def compare(toks: DataFrame, reference: DataFrame, use_lemmas: bool = True, min_author_freq: int = 3) -> DataFrame:
    """(term, n, reference_count, ratio): relative frequency here over there; half a count for what the background lacks."""
    author = corpus_frequencies(toks, use_lemmas)
    totals = F.broadcast(_total(author, "n").withColumnRenamed("total", "a")), F.broadcast(_total(reference, "count").withColumnRenamed("total", "r"))  # one row each
    return _compared(author.where(F.col("n") >= min_author_freq), reference, *totals).select("term", "n", "reference_count", "ratio")


def _compared(author: DataFrame, reference: DataFrame, author_total: DataFrame, reference_total: DataFrame) -> DataFrame:
    """``author`` (term, n, ...) with reference_count, ratio and both totals ``a`` and ``r``."""
    joined = author.join(reference, "term", "left").join(author_total).join(reference_total)
    there = F.coalesce(F.nullif("count", F.lit(0)), F.lit(0.5))
    return joined.withColumn("reference_count", F.coalesce("count", F.lit(0))).withColumn("ratio", (F.col("n") / F.col("a")) / (there / F.col("r")))


def specific_terms(compared: DataFrame, threshold: float = 10.0, most_reference: int | None = None) -> DataFrame:
    kept = compared.where(F.col("ratio") >= threshold)
    return kept if most_reference is None else kept.where(F.col("reference_count") <= most_reference)


def top_terms(scored: DataFrame, score: str, n: int = 50) -> DataFrame:
    return scored.orderBy(F.desc(score), "term").limit(n)


def neologisms(toks: DataFrame, reference: DataFrame, use_lemmas: bool = True, min_author_freq: int = 3) -> DataFrame:
    return corpus_frequencies(toks, use_lemmas).where(F.col("n") >= min_author_freq).join(reference.where("count > 0"), "term", "left_anti")


def context_stats(toks: DataFrame, reference: DataFrame, use_lemmas: bool = True) -> DataFrame:
    """(term, n, freq, reference_count, reference_freq, ratio, docs, in_reference) of every term; the tokens are read once."""
    author = word_frequencies(toks, use_lemmas).groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("df"))
    totals = F.broadcast(_total(author, "n").withColumnRenamed("total", "a")), F.broadcast(_total(reference, "count").withColumnRenamed("total", "r"))
    return _compared(author, reference, *totals).select(
        "term", "n", (F.col("n") / F.col("a")).alias("freq"), "reference_count", (F.col("reference_count") / F.col("r")).alias("reference_freq"),
        "ratio", F.col("df").alias("docs"), (F.col("reference_count") > 0).alias("in_reference"),
    )


def tfidf_vs_reference(toks: DataFrame, reference: DataFrame, use_lemmas: bool = True, min_author_freq: int = 3) -> DataFrame:
    """(term, score): tf times ln 2 for terms that the background lacks, else 0."""
    author = corpus_frequencies(toks, use_lemmas)
    joined = author.where(F.col("n") >= min_author_freq).join(reference.where("count > 0"), "term", "left").join(F.broadcast(_total(author, "n")))
    return joined.select("term", F.when(F.col("count").isNull(), F.col("n") / F.col("total") * F.ln(F.lit(2.0))).otherwise(0.0).alias("score"))


def combined_terms(compared: DataFrame, tfidf: DataFrame, ratio_threshold: float = 10.0, tfidf_threshold: float = 0.001, method: str = "union") -> DataFrame:
    a, b = specific_terms(compared, ratio_threshold).select("term"), tfidf.where(F.col("score") >= tfidf_threshold).select("term")
    ways = {"union": lambda: a.union(b).distinct(), "intersection": lambda: a.intersect(b), "ratio_only": lambda: a, "tfidf_only": lambda: b}
    if method not in ways:
        raise ValueError(f"unknown method {method!r}: one of {', '.join(ways)}")
    return ways[method]()


def proper_spellings(toks: DataFrame) -> DataFrame:
    return toks.where(F.col("pos").startswith("NNP")).select(F.col("token").alias("term")).distinct()


def dictionary_neologisms(toks: DataFrame, dictionary: DataFrame, use_lemmas: bool = True, min_author_freq: int = 3, exclude_proper_nouns: bool = True, exclude_stopwords: bool = True) -> DataFrame:
    """(term, n) of frequent terms that are in no dictionary (term), nor ever tagged as proper nouns in that spelling."""
    out = toks.groupBy(term_of(use_lemmas, lowercase=False).alias("term")).agg(occurrences(toks).alias("n")).where(F.col("n") >= min_author_freq)
    if exclude_stopwords:
        out = out.where(~F.lower("term").isin(STOPWORDS))
    out = out.join(dictionary.select(F.lower("term").alias("key")).distinct(), F.lower("term") == F.col("key"), "left_anti")
    return out.join(proper_spellings(toks), "term", "left_anti") if exclude_proper_nouns else out


def capitalized_terms(toks: DataFrame, min_author_freq: int = 3, exclude_sentence_initial: bool = True, exclude_all_caps: bool = True, exclude_proper_nouns: bool = False) -> DataFrame:
    first = F.substring("token", 1, 1)
    before = F.lag("token").over(Window.partitionBy("doc_id").orderBy("sent_index", "tok_index"))
    out = toks.withColumn("before", before).where((first != F.lower(first)))
    if exclude_all_caps:
        out = out.where(~((F.col("token") == F.upper("token")) & (F.length("token") > 1)))
    if exclude_sentence_initial:
        out = out.where(F.col("before").isNotNull() & ~F.col("before").isin(".", "!", "?", ";"))
    if exclude_proper_nouns:
        out = out.where(~F.col("pos").startswith("NNP"))
    return out.groupBy(F.col("token").alias("term")).agg(F.count("*").alias("n")).where(F.col("n") >= min_author_freq)


def capitalized_in(sents: DataFrame, min_author_freq: int = 3) -> DataFrame:
    """As ``capitalized_terms`` with its defaults, from sentences: within a sentence a token sees the one before it, so no order has to be restored."""
    words = sents.select(words_of(F.col("sentence")).alias("w"))
    pairs = words.select(F.explode(F.transform("w", lambda x, i: F.struct(x.alias("token"), F.get("w", i - 1).alias("before")))).alias("p")).select("p.*")
    first = F.substring("token", 1, 1)
    kept = pairs.where((first != F.lower(first)) & ~((F.col("token") == F.upper("token")) & (F.length("token") > 1)) & F.col("before").isNotNull() & ~F.col("before").isin(".", "!", "?", ";"))
    return kept.groupBy(F.col("token").alias("term")).agg(F.count("*").alias("n")).where(F.col("n") >= min_author_freq)


def author_terms(toks: DataFrame, use_lemmas: bool = True) -> DataFrame:
    """(term, n, spelled, proper) in one aggregation: occurrences, occurrences in that spelling (of lemmas: all), and whether that spelling is ever tagged a proper noun."""
    one, none = F.col("n") if "n" in toks.columns else F.lit(1).cast("long"), F.lit(0).cast("long")
    term, proper = term_of(use_lemmas), F.col("pos").startswith("NNP")
    roles = F.array(F.struct(term.alias("term"), one.alias("n"), (one if use_lemmas else none).alias("spelled"), F.lit(False).alias("proper")), F.struct(F.col("token").alias("term"), none.alias("n"), (none if use_lemmas else one).alias("spelled"), proper.alias("proper")))
    rows = toks.select(F.explode(roles).alias("r")).select("r.*")
    return rows.groupBy("term").agg(F.sum("n").alias("n"), F.sum("spelled").alias("spelled"), F.bool_or("proper").alias("proper")).where("n > 0")


def neologism_signals(toks: DataFrame, reference: DataFrame, dictionary: DataFrame, use_lemmas: bool = True, min_author_freq: int = 3, words: DataFrame | None = None) -> DataFrame:
    """(term, in_reference_signal, in_dictionary_signal, in_capitalized_signal, signals): which of the three signals a term has.

    ``words``: the tokens in text order, where ``toks`` are types."""
    marked = [
        neologisms(toks, reference, use_lemmas, min_author_freq).select("term", F.lit("reference").alias("signal")),
        dictionary_neologisms(toks, dictionary, use_lemmas, min_author_freq).select("term", F.lit("dictionary").alias("signal")),
        capitalized_terms(toks if words is None else words, min_author_freq).select("term", F.lit("capitalized").alias("signal")),
    ]
    both = marked[0].unionByName(marked[1]).unionByName(marked[2])
    has = lambda s: F.bool_or(F.col("signal") == s).alias(s)
    return both.groupBy("term").agg(has("reference"), has("dictionary"), has("capitalized"), F.count_distinct("signal").alias("signals"))


def is_valid_term(term: Column) -> Column:
    """Whether a term is a word: two characters at least, a letter, no punctuation heap, abbreviation or piece of a contraction."""
    letters, marks = F.regexp_count(term, F.lit(r"\p{L}")), F.regexp_count(term, F.lit(PUNCTUATION))
    return (
        (F.length(term) >= 2) & (letters > 0) & ~F.lower(term).isin("i.e", "e.g", "etc", "vs", "cf") & ~F.lower(term).isin(CONTRACTION_FRAGMENTS)
        & ~((marks > 0) & (letters <= 2) & (marks >= letters))
    )


def pos_vocabulary(toks: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, use_lemmas: bool = True, min_freq: int = 1) -> DataFrame:
    """(term, n) of terms with a tag of ``include`` and, in all the corpus, none of ``exclude``."""
    kept = toks.groupBy(term_of(use_lemmas, lowercase=False).alias("term")).agg(
        occurrences(toks).alias("n"),
        (F.bool_or(F.col("pos").isin(include)) if include else F.lit(True)).alias("wanted"),
        (F.bool_or(F.col("pos").isin(exclude)) if exclude else F.lit(False)).alias("vetoed"),
    )
    return kept.where(F.col("wanted") & ~F.col("vetoed") & (F.col("n") >= min_freq)).select("term", "n")


FOCUS = {
    "nouns": ["NN", "NNS", "NNP", "NNPS"],
    "verbs": ["VB", "VBD", "VBG", "VBN", "VBP", "VBZ"],
    "adjectives": ["JJ", "JJR", "JJS"],
}
FOCUS["all_content"] = [*FOCUS["nouns"], *FOCUS["verbs"], *FOCUS["adjectives"], "RB", "RBR", "RBS"]
FUNCTION_TAGS = ["DT", "IN", "CC", "TO", "PRP", "PRP$", "WDT", "WP", "WP$", "WRB", "EX", "MD", "PDT", "POS", "RP", "SYM", "UH"]


def term_candidates(toks: DataFrame, focus: str = "nouns", use_lemmas: bool = True, min_freq: int = 3, exclude_stopwords: bool = True) -> DataFrame:
    if focus not in FOCUS:
        raise ValueError(f"unknown focus {focus!r}: one of {', '.join(FOCUS)}")
    out = pos_vocabulary(toks, FOCUS[focus], FUNCTION_TAGS, use_lemmas, min_freq)
    return out.where(~F.lower("term").isin(STOPWORDS)) if exclude_stopwords else out


def compound_terms(toks: DataFrame, min_freq: int = 2, max_length: int = 4) -> DataFrame:
    """(term, n): hyphenated words, and runs of nouns and adjectives of 2 to ``max_length`` tokens that end in a noun."""
    w = Window.partitionBy("doc_id").orderBy("sent_index", "tok_index")
    ahead = toks.select(
        *[F.lead("token", k).over(w).alias(f"t{k}") for k in range(max_length)],
        *[F.lead("pos", k).over(w).alias(f"p{k}") for k in range(max_length)],
    )
    part = lambda k: F.col(f"p{k}").rlike("^(NN|JJ)")
    runs = []
    for n in range(2, max_length + 1):
        good = F.col(f"p{n - 1}").startswith("NN")
        for k in range(n - 1):
            good = good & part(k)
        runs.append(F.when(good, F.lower(F.concat_ws(" ", *[f"t{k}" for k in range(n)]))))
    hyphen = F.when(F.col("t0").contains("-") & (F.length("t0") > 3) & F.col("t0").rlike(r"\p{L}"), F.lower("t0"))
    terms = ahead.select(F.explode(F.array_compact(F.array(hyphen, *runs))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= min_freq)


def filtered_candidates(toks: DataFrame, min_freq: int = 3, focus: str = "all_content", include_compounds: bool = True, types: DataFrame | None = None) -> DataFrame:
    """(kind, term, n): single words, counted in ``types`` where they are given, and compounds."""
    out = term_candidates(toks if types is None else types, focus, True, min_freq).select(F.lit("single").alias("kind"), "term", "n")
    return out.unionByName(compound_terms(toks, min_freq).select(F.lit("compound").alias("kind"), "term", "n")) if include_compounds else out
