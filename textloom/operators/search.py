"""Search over sentences: matches, concordances, contexts, dispersion, significant terms.

A term matches as a substring; occurrences may overlap; offsets count from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.annotate import tokens
from textloom.functions.words import STOPWORDS
from textloom.operators.frequency import occurrences


def _folded(c: Column, case_sensitive: bool) -> Column:
    return c if case_sensitive else F.lower(c)


def contains(term: str, case_sensitive: bool = False, column: str = "sentence") -> Column:
    return _folded(F.col(column), case_sensitive).contains(term if case_sensitive else term.lower())


def positions(term: str, case_sensitive: bool = False, column: str = "sentence") -> Column:
    """All overlapping offsets of ``term``, as an array."""
    t = term if case_sensitive else term.lower()
    s = _folded(F.col(column), case_sensitive)
    if t and not any(t[:k] == t[-k:] for k in range(1, len(t))):  # it cannot overlap itself: the lengths between occurrences tell
        lengths = F.transform(F.split(s, r"\Q" + t.replace(r"\E", r"\E\\E\Q") + r"\E", -1), F.length)
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
        step = lambda x, n: F.struct((x["at"] + n + len(t)).alias("at"), F.array_append(x["found"], x["at"] + n).alias("found"))
        return F.aggregate(F.slice(lengths, F.lit(1), F.size(lengths) - 1), start, step, lambda x: x["found"])
    last = F.length(s) - len(t)
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.filter(starts, lambda p: F.substring(s, p + 1, F.lit(len(t))) == t)


def find_sentences(sents: DataFrame, term: str, case_sensitive: bool = False) -> DataFrame:
    """The sentences that contain ``term``, with ``term_positions``."""
    return sents.where(contains(term, case_sensitive)).withColumn("term_positions", positions(term, case_sensitive))


def find_lemma(sents: DataFrame, toks: DataFrame, lemma: str) -> DataFrame:
    """The sentences with a token of that lemma; positions: where each such token's spelling first stands."""
    hits = toks.where(F.col("lemma") == lemma.lower()).select("doc_id", "sent_index", "tok_index", "token")
    joined = hits.join(sents, ["doc_id", "sent_index"]).withColumn("at", F.instr("sentence", F.col("token")) - 1)
    return joined.groupBy("doc_id", "sent_index", "sentence").agg(F.transform(F.array_sort(F.collect_list(F.struct("tok_index", "at"))), lambda x: x["at"]).alias("term_positions"))


def find_any(sents: DataFrame, terms: list[str], case_sensitive: bool = False) -> DataFrame:
    """(term, doc_id, sent_index, sentence): a row for each term that a sentence contains."""
    hit = F.array_compact(F.array(*[F.when(contains(t, case_sensitive), F.lit(t)) for t in terms]))
    return sents.select(F.explode(hit).alias("term"), "doc_id", "sent_index", "sentence")


def first_hits(hits: DataFrame, n: int) -> DataFrame:
    """Each term's first ``n`` rows of ``hits`` (term, doc_id, sent_index, sentence) in text order, with their place ``k``.

    Its first ``n`` documents are found without sentences; only the sentences of those, ``n`` documents a term, are sorted."""
    by_doc = hits.groupBy("term", "doc_id").agg(F.count("*").alias("c"))
    docs = by_doc.withColumn("k", F.row_number().over(Window.partitionBy("term").orderBy("doc_id"))).where(F.col("k") <= n).select(F.col("term").alias("_t"), F.col("doc_id").alias("_d"))
    near = hits.join(F.broadcast(docs), (F.col("term") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")
    return near.withColumn("k", F.row_number().over(Window.partitionBy("term").orderBy("doc_id", "sent_index"))).where(F.col("k") <= n)


def find_all(sents: DataFrame, terms: list[str], case_sensitive: bool = False) -> DataFrame:
    out = sents
    for t in terms:
        out = out.where(contains(t, case_sensitive))
    return out


def count_occurrences(sents: DataFrame, term: str, case_sensitive: bool = False) -> DataFrame:
    return sents.where(contains(term, case_sensitive)).agg(F.coalesce(F.sum(F.size(positions(term, case_sensitive))), F.lit(0)).alias("n"))


def _trim_left(text: Column) -> Column:
    at = F.locate(" ", text)
    return F.when((at > 1) & (at < F.length(text)), F.substring(text, at + 1, F.length(text))).otherwise(text)


def _trim_right(text: Column) -> Column:
    last = F.length(text) - F.locate(" ", F.reverse(text)) + 1
    return F.when(F.contains(text, F.lit(" ")) & (last > 1), F.substring(text, F.lit(1), last - 1)).otherwise(text)


def concordance(sents: DataFrame, term: str, width: int = 50, case_sensitive: bool = False) -> DataFrame:
    """(doc_id, sent_index, at, left_context, keyword, right_context): one row an occurrence, contexts cut at words."""
    hits = sents.where(contains(term, case_sensitive)).select("doc_id", "sent_index", "sentence", F.explode(positions(term, case_sensitive)).alias("at"))
    start = F.greatest(F.col("at") - width, F.lit(0))
    left = F.substring(F.col("sentence"), start + 1, F.col("at") - start)
    right = F.substring(F.col("sentence"), F.col("at") + len(term) + 1, F.lit(width))
    keyword = F.substring(F.col("sentence"), F.col("at") + 1, F.lit(len(term)))
    cut = hits.select("doc_id", "sent_index", "at", left.alias("l"), keyword.alias("keyword"), right.alias("r"))
    return cut.select("doc_id", "sent_index", "at", F.trim(_trim_left(F.col("l"))).alias("left_context"), "keyword", F.trim(_trim_right(F.col("r"))).alias("right_context"))


def concordance_sorted(lines: DataFrame, sort_by: str = "left") -> DataFrame:
    keys = {"left": F.reverse(F.lower("left_context")), "right": F.lower("right_context")}
    if sort_by not in keys:
        raise ValueError(f"sort_by is left or right, not {sort_by!r}")
    return lines.orderBy(keys[sort_by], "doc_id", "sent_index", "at")


def concordance_filtered(lines: DataFrame, terms: list[str]) -> DataFrame:
    shown = F.lower(F.concat_ws(" ", "left_context", "right_context"))
    return lines.where(F.exists(F.lit([t.lower() for t in terms]), lambda t: F.contains(shown, t)))


def format_lines(lines: DataFrame, width: int = 50, show_doc_id: bool = False) -> DataFrame:
    """(line): ``left [keyword] right``, padded, never cut."""
    pad = lambda c, f: F.when(F.length(c) < width, f(c, width, " ")).otherwise(F.col(c))
    line = F.concat(pad("left_context", F.lpad), F.lit(" ["), F.col("keyword"), F.lit("] "), pad("right_context", F.rpad))
    return lines.select((F.concat(F.col("doc_id").cast("string"), F.lit(": "), line) if show_doc_id else line).alias("line"))


def context_windows(sents: DataFrame, matches: DataFrame, n_sentences: int = 1) -> DataFrame:
    """(doc_id, sent_index, sentence, before, after) of matches (doc_id, sent_index): frames over a document's sentences."""
    w = Window.partitionBy("doc_id").orderBy("sent_index")
    around = sents.select(
        "doc_id", "sent_index", "sentence",
        F.collect_list(F.trim("sentence")).over(w.rowsBetween(-n_sentences, -1)).alias("before"),
        F.collect_list(F.trim("sentence")).over(w.rowsBetween(1, n_sentences)).alias("after"),
    )
    return around.join(matches.select("doc_id", "sent_index").distinct(), ["doc_id", "sent_index"], "left_semi")


def highlighted(text: Column, term: str, start: str = "**", end: str = "**") -> Column:
    """Every occurrence of ``term`` between markers."""
    return F.regexp_replace(text, r"(?iu)(\Q" + term.replace(r"\E", r"\E\\E\Q") + r"\E)", start.replace("$", r"\$") + "$1" + end.replace("$", r"\$"))


def dispersion(sents: DataFrame, term: str, case_sensitive: bool = False) -> DataFrame:
    """(doc_id, sent_index) of the sentences that contain the term."""
    return sents.where(contains(term, case_sensitive)).select("doc_id", "sent_index")


def dispersion_summary(sents: DataFrame, terms: list[str], case_sensitive: bool = False) -> DataFrame:
    """(term, total_docs, docs_with_term, coverage, total, average) for each term, in one pass; ``total`` counts sentences."""
    hits = F.array(*[F.struct(F.lit(t).alias("term"), contains(t, case_sensitive).cast("int").alias("hit")) for t in terms])
    by_doc = sents.select("doc_id", F.explode(hits).alias("h")).groupBy("doc_id", "h.term").agg(F.sum("h.hit").alias("n"))
    summed = by_doc.groupBy("term").agg(F.count("*").alias("total_docs"), F.count_if(F.col("n") > 0).alias("docs_with_term"), F.sum("n").alias("total"))
    return summed.select("term", "total_docs", "docs_with_term", (100.0 * F.col("docs_with_term") / F.col("total_docs")).alias("coverage"), "total", F.coalesce(F.try_divide("total", "docs_with_term"), F.lit(0.0)).alias("average"))


def dispersion_plot(sents: DataFrame, term: str, case_sensitive: bool = False) -> DataFrame:
    """(doc_id, n_sentences, positions) of every document, also of those without a hit."""
    hit = F.when(contains(term, case_sensitive), F.col("sent_index"))
    return sents.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.array_sort(F.collect_list(hit)).alias("positions"))


def dense_regions(sents: DataFrame, term: str, window_size: int = 10, min_occurrences: int = 3, case_sensitive: bool = False) -> DataFrame:
    """(doc_id, start, hits, density): full windows of ``window_size`` sentences with enough hits."""
    w = Window.partitionBy("doc_id").orderBy("sent_index").rowsBetween(0, window_size - 1)
    hit = contains(term, case_sensitive).cast("int")
    framed = sents.select("doc_id", F.col("sent_index").alias("start"), F.sum(hit).over(w).alias("hits"), F.count("*").over(w).alias("size"))
    return framed.where((F.col("size") == window_size) & (F.col("hits") >= min_occurrences)).select("doc_id", "start", "hits", (F.col("hits") / window_size).alias("density"))


def content_frequencies(toks: DataFrame, pos_prefixes: tuple[str, ...] = ("NN", "VB", "JJ")) -> DataFrame:
    """(term, f) of content lemmas."""
    return _content(toks, pos_prefixes).groupBy("lemma").agg(occurrences(toks).alias("f")).withColumnRenamed("lemma", "term")


def _content(toks: DataFrame, pos_prefixes: tuple[str, ...]) -> DataFrame:
    return toks.where(F.col("pos").rlike("^(" + "|".join(pos_prefixes) + ")") & ~F.col("lemma").isin(STOPWORDS) & F.col("lemma").rlike(r"[\p{L}\p{N}]"))


def significant_terms(sents: DataFrame, toks: DataFrame, search_term: str, threshold: float = 0.1, pos_prefixes: tuple[str, ...] = ("NN", "VB", "JJ"), top_n: int | None = None, match_lemma: bool = False, scores: DataFrame | None = None) -> DataFrame:
    """(doc_id, sent_index, term, score): content lemmas beside the search term, 10 ln(1 + f) / ln(1 + f max).

    Only sentences with the term are tagged again; frequencies are over all of ``toks``.  ``match_lemma``: sentences with a token of that
    lemma.  ``scores`` (term, total), as the hybrid scorer gives them: those count instead of frequencies."""
    if match_lemma:
        hits = toks.where(F.col("lemma") == search_term.lower()).select("doc_id", "sent_index").distinct()
        found = toks.join(hits, ["doc_id", "sent_index"], "left_semi")
    else:
        found = tokens(sents.where(contains(search_term)))
    beside = _content(found, pos_prefixes).where(F.col("lemma") != search_term.lower()).select("doc_id", "sent_index", F.col("lemma").alias("term")).distinct()
    if scores is None:
        freq = content_frequencies(toks, pos_prefixes)
        top = F.broadcast(freq.agg(F.max("f").alias("top")))  # one row
        scored = beside.join(freq, "term").join(top).withColumn("score", 10 * F.log1p("f") / F.log1p("top"))
    else:
        scored = beside.join(scores.select("term", F.col("total").alias("score")), "term")
    out = scored.select("doc_id", "sent_index", "term", "score").where(F.col("score") >= threshold)
    if top_n is None:
        return out
    w = Window.partitionBy("doc_id", "sent_index").orderBy(F.desc("score"), "term")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n).drop("rank")


def aggregate_significant(found: DataFrame) -> DataFrame:
    """(term, score, n): averages over sentences."""
    return found.groupBy("term").agg(F.avg("score").alias("score"), F.count("*").alias("n"))
