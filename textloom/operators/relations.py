"""Grammatical relations, read from the tag sequence of a sentence.

A sentence's tokens are one array; each tag is one character of a code string (N noun, P pronoun, V verb, J adjective, R adverb, M modal, D
determiner, I preposition, - else), so a pattern of tags is a regular expression anchored at a token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.annotate import tagged_words
from textloom.functions.words import COPULAS, PREPOSITIONS
from textloom.operators.metrics import stored

_CODES = {"N": ["NN", "NNS", "NNP", "NNPS"], "P": ["PRP"], "J": ["JJ"], "R": ["RB"], "M": ["MD"], "D": ["DT"], "I": ["IN"]}


def _code(pos: Column) -> Column:
    out = F.when(pos.startswith("VB"), "V").otherwise("-")
    for code, tags in _CODES.items():
        out = F.when(pos.isin(tags), code).otherwise(out)
    return out


def coded(sents: DataFrame, toks: DataFrame | None = None) -> DataFrame:
    """(doc_id, sent_index, sentence, words, codes): a sentence's tokens in order and its code string.  Sentences are tagged where they stand; ``toks``: tags
    made elsewhere, gathered by sentence."""
    if toks is None:
        tagged = sents.select("doc_id", "sent_index", "sentence", tagged_words(F.col("sentence")).alias("t"))
        line = F.struct(F.col("t.token").alias("words"), F.array_join(F.transform("t", lambda x: _code(x["out"])), "").alias("codes"))
        # a generator of one row: what stands above reads the line and never makes it anew for each word
        return tagged.select("doc_id", "sent_index", "sentence", F.inline(F.array(line)))
    rows = toks.groupBy("doc_id", "sent_index").agg(F.array_sort(F.collect_list(F.struct("tok_index", "token", _code(F.col("pos")).alias("c")))).alias("t"))
    lined = rows.select("doc_id", "sent_index", F.transform("t", lambda x: x["token"]).alias("words"), F.array_join(F.transform("t", lambda x: x["c"]), "").alias("codes"))
    return lined.join(sents, ["doc_id", "sent_index"])


def _starts() -> Column:
    return F.sequence(F.lit(0), F.size("words") - 1)


def svo(lines: DataFrame) -> DataFrame:
    """(doc_id, sent_index, sentence, subject, verb, object): noun or pronoun, verb, noun or pronoun, from every start."""
    tail = F.substring(F.col("codes"), F.col("i") + 1, F.length("codes"))
    # rows only where a triple begins: the end of one may begin the next, so what follows is looked at, not taken
    marks = F.split(F.regexp_replace("codes", "[NP](?=[RM]*V[DJRI]*[NP])", "#"), "")
    starts = F.filter(F.transform(marks, lambda c, i: F.when(c == "#", i)), lambda i: i.isNotNull())
    at = lines.select("*", F.explode(starts).alias("i")).withColumn("m", F.regexp_extract(tail, "^[NP]([RM]*)V([DJRI]*)[NP]", 0)).where("m <> ''")
    verb = F.length(F.regexp_extract("m", "^[NP]([RM]*)V", 0)) - 1
    return at.select("doc_id", "sent_index", "sentence", F.get("words", F.col("i")).alias("subject"), F.get("words", F.col("i") + verb).alias("verb"), F.get("words", F.col("i") + F.length("m") - 1).alias("object"))


def svo_for_term(triples: DataFrame, term: str, case_sensitive: bool = False) -> DataFrame:
    fold = (lambda c: F.col(c)) if case_sensitive else (lambda c: F.lower(c))
    t = term if case_sensitive else term.lower()
    return triples.where(fold("subject").contains(t) | fold("verb").contains(t) | fold("object").contains(t))


def _words(start: Column, n: Column) -> Column:
    return F.array_join(F.slice("words", start + 1, n), " ")


def copular(lines: DataFrame, term: str) -> DataFrame:
    """(doc_id, sent_index, sentence, subject, copula, complement): a copula in the next three tokens, a noun or adjective in the five after it."""
    t = term.lower()
    marks = F.array_join(F.transform("words", lambda w: F.when(F.lower(w).isin(COPULAS), "c").otherwise("-")), "")
    hits = lines.where(F.lower("sentence").contains(t)).select("*", marks.alias("marks"), F.explode(F.filter(_starts(), lambda i: F.lower(F.get("words", i)).contains(t))).alias("i"))
    j = F.length(F.regexp_extract(F.substring(F.col("marks"), F.col("i") + 1, F.length("marks")), "^.[^c]{0,2}c", 0)) - 1
    found = hits.withColumn("j", F.col("i") + j).where(F.col("j") > F.col("i"))
    after = F.substring(F.col("codes"), F.col("j") + 2, F.length("codes"))
    shaped = found.withColumn("skip", F.length(F.regexp_extract(after, "^([^NJ]{0,4})[NJ]", 1))).withColumn("take", F.length(F.regexp_extract(after, "^[^NJ]{0,4}([NJ][NJI]{0,3})", 1))).where("take > 0")
    return shaped.select("doc_id", "sent_index", "sentence", F.get("words", F.col("i")).alias("subject"), F.get("words", F.col("j")).alias("copula"), _words(F.col("j") + 1 + F.col("skip"), F.col("take")).alias("complement"))


def prepositional(lines: DataFrame, term: str) -> DataFrame:
    """(doc_id, sent_index, sentence, head, preposition, object): the sentence's first noun with the term and a preposition next to it, if an object follows within four tokens."""
    t = term.lower()
    fits = lambda i: F.lower(F.get("words", i)).contains(t) & (F.substring(F.col("codes"), i + 1, F.lit(1)) == "N") & F.lower(F.get("words", i + 1)).isin(PREPOSITIONS)
    first = lines.where(F.lower("sentence").contains(t)).select("*", F.explode(F.slice(F.filter(_starts(), fits), 1, 1)).alias("i"))
    after = F.substring(F.col("codes"), F.col("i") + 3, F.length("codes"))
    shaped = first.withColumn("skip", F.length(F.regexp_extract(after, "^([^N]{0,3})N", 1))).withColumn("take", F.length(F.regexp_extract(after, "^[^N]{0,3}(N[NJ]{0,2})", 1))).where("take > 0")
    return shaped.select("doc_id", "sent_index", "sentence", F.get("words", F.col("i")).alias("head"), F.get("words", F.col("i") + 1).alias("preposition"), _words(F.col("i") + 2 + F.col("skip"), F.col("take")).alias("object"))


def relation_rows(lines: DataFrame, term: str, kinds: tuple[str, ...] = ("svo", "copular", "prep")) -> DataFrame:
    """(relation_type, source, target, connector, role, doc_id, sent_index, sentence): each relation of a term where it stands; a triple with the term at
    both ends stands twice.  Only sentences with the term are read, each kind of them once."""
    t, parts = term.lower(), []
    lines = lines.where(F.lower("sentence").contains(t))
    place = ("doc_id", "sent_index", "sentence")
    if "svo" in kinds:
        roles = F.array_compact(F.array(*[F.when(F.lower(r).contains(t), F.lit(r)) for r in ("subject", "object")]))
        parts.append(svo(lines).withColumn("role", F.explode(roles)).select(F.lit("svo").alias("relation_type"), F.col("subject").alias("source"), F.col("object").alias("target"), F.col("verb").alias("connector"), "role", *place))
    if "copular" in kinds:
        parts.append(copular(lines, term).select(F.lit("copular").alias("relation_type"), F.col("subject").alias("source"), F.col("complement").alias("target"), F.col("copula").alias("connector"), F.lit(None).cast("string").alias("role"), *place))
    if "prep" in kinds:
        parts.append(prepositional(lines, term).select(F.lit("prep").alias("relation_type"), F.col("head").alias("source"), F.col("object").alias("target"), F.col("preposition").alias("connector"), F.lit(None).cast("string").alias("role"), *place))
    if not parts:
        raise ValueError("kinds: some of svo, copular, prep")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def relations(lines: DataFrame, term: str, kinds: tuple[str, ...] = ("svo", "copular", "prep"), max_evidence: int = 100) -> DataFrame:
    """(relation_type, source, target, connector, role, n, evidence): relations of a term; ``n`` counts all, ``evidence`` has the first
    ``max_evidence`` sentences in text order, so that no relation's array grows with the corpus.  All of them: ``relation_rows``."""
    key = ("relation_type", "source", "target", "connector")
    # both are stored: tagged once for all kinds, found once for counts and evidence
    rows = stored(relation_rows(stored(lines.where(F.lower("sentence").contains(term.lower()))), term, kinds))
    w = Window.partitionBy(*key).orderBy("doc_id", "sent_index", "role")
    first = rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= max_evidence)
    shown = first.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "sentence"))), lambda x: x["sentence"]).alias("evidence"))
    counted = rows.groupBy(*key).agg(F.min("role").alias("role"), F.count("*").alias("n"))
    return counted.join(shown, list(key)).select(*key, "role", "n", "evidence")
