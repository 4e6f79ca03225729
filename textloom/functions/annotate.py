"""Sentences, tokens, tags and lemmas as native expressions.

Tags and lemmas come from rules written once as SQL text that any ANSI engine understands, so results can be checked
elsewhere; :func:`annotate` takes other rules as parameters.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTENCE_END = r"([.!?])\s+"
CONTRACTION = r"(?i)([a-z])(n't|'(?:s|re|ve|ll|d|m))\b"
TOKEN = r"(?i)n't|'(?:s|re|ve|ll|d|m)\b|[\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)*|[^\p{L}\p{N}_\s]"


def _list(words: str) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words.split())


#: Closed classes by tag.
CLASSES = {
    "DT": "the a an this that these those each every some any no another",
    "PRP": "i you he she it we they me him us them myself yourself himself herself itself ourselves themselves",
    "PRP$": "my your his her its our their",
    "WP": "who whom what",
    "WDT": "which whatever",
    "WRB": "where when why how",
    "CC": "and or but nor yet",
    "TO": "to",
    "MD": "can could will would shall should may might must",
    "IN": "of in for with on at from by about as into through during before after above below between under since without within along among against if than because while although though whether upon over until",
    "RB": "not n't very too also only just now then here there again even still never always often perhaps however thus therefore",
    "VBZ": "is has does 's",
    "VBP": "are am have do 're 've 'm",
    "VBD": "was were had did became seemed appeared said made went came took",
    "VB": "be become seem appear make take go come see know think give find say",
    "VBN": "been done made known given taken",
    "VBG": "being having doing",
    "JJ": "good new first last long great little own other old right big high different small large next early young important few public bad same able such many more most",
}
_CLOSED = "\n".join(f"    WHEN lower(token) IN ({_list(words)}) THEN '{tag}'" for tag, words in CLASSES.items())
#: Tag of ``token`` at ``tok_index`` of its sentence.
POS_SQL = f"""CASE
    WHEN token IN ('.', '!', '?') THEN '.'
    WHEN lower(token) = upper(token) AND substr(token, 1, 1) BETWEEN '0' AND '9' THEN 'CD'
    WHEN lower(token) = upper(token) THEN token
{_CLOSED}
    WHEN tok_index > 0 AND substr(token, 1, 1) <> lower(substr(token, 1, 1)) THEN CASE WHEN lower(token) LIKE '%s' AND lower(token) NOT LIKE '%ss' THEN 'NNPS' ELSE 'NNP' END
    WHEN lower(token) LIKE '%ly' THEN 'RB'
    WHEN lower(token) LIKE '_%ing' THEN 'VBG'
    WHEN lower(token) LIKE '__%ed' THEN 'VBD'
    WHEN lower(token) LIKE '%ous' OR lower(token) LIKE '%ful' OR lower(token) LIKE '%ive' OR lower(token) LIKE '%able' OR lower(token) LIKE '%ible' OR lower(token) LIKE '%less' OR lower(token) LIKE '%ish' OR lower(token) LIKE '__%al' OR lower(token) LIKE '__%ic' THEN 'JJ'
    WHEN lower(token) LIKE '%s' AND lower(token) NOT LIKE '%ss' AND lower(token) NOT LIKE '%us' AND lower(token) NOT LIKE '%is' THEN 'NNS'
    ELSE 'NN' END"""

IRREGULAR = {
    "be": "is are am was were been being 's 're 'm",
    "have": "has had having 've",
    "do": "does did done doing",
    "become": "became becomes",
    "say": "said says",
    "make": "made makes making",
    "go": "went goes gone going",
    "come": "came comes coming",
    "take": "took taken takes taking",
    "know": "knew known knows",
    "give": "gave given gives giving",
    "man": "men",
    "woman": "women",
    "child": "children",
    "person": "people",
    "foot": "feet",
    "tooth": "teeth",
    "mouse": "mice",
}
_IRREGULAR = "\n".join(f"    WHEN lower(token) IN ({_list(forms)}) THEN '{lemma}'" for lemma, forms in IRREGULAR.items())
#: Lemma of ``token`` tagged ``pos``; always lower case.
LEMMA_SQL = f"""CASE
{_IRREGULAR}
    WHEN pos IN ('NNS', 'NNPS', 'VBZ') AND lower(token) LIKE '__%ies' THEN concat(substr(lower(token), 1, length(token) - 3), 'y')
    WHEN pos IN ('NNS', 'NNPS', 'VBZ') AND (lower(token) LIKE '%sses' OR lower(token) LIKE '%shes' OR lower(token) LIKE '%ches' OR lower(token) LIKE '%xes') THEN substr(lower(token), 1, length(token) - 2)
    WHEN pos IN ('NNS', 'NNPS', 'VBZ') AND lower(token) LIKE '_%s' THEN substr(lower(token), 1, length(token) - 1)
    WHEN pos IN ('VBD', 'VBN') AND lower(token) LIKE '__%ied' THEN concat(substr(lower(token), 1, length(token) - 3), 'y')
    WHEN pos IN ('VBD', 'VBN') AND lower(token) LIKE '__%ed' THEN substr(lower(token), 1, length(token) - 2)
    WHEN pos = 'VBG' AND lower(token) LIKE '___%ing' THEN substr(lower(token), 1, length(token) - 3)
    ELSE lower(token) END"""

COARSE = {"NN": "noun", "VB": "verb", "JJ": "adjective", "RB": "adverb", "PRP": "pronoun", "DT": "determiner", "IN": "preposition", "CC": "conjunction", "CD": "number"}


def sentences_of(text: Column) -> Column:
    """The sentences of a text, as an array."""
    return F.split(F.regexp_replace(text, SENTENCE_END, "$1\u0001"), "\u0001")


def words_of(sentence: Column) -> Column:
    """Word and punctuation tokens; contraction endings are tokens of their own."""
    apart = F.when(F.contains(sentence, F.lit("'")), F.regexp_replace(sentence, CONTRACTION, "$1 $2")).otherwise(sentence)
    return F.regexp_extract_all(apart, F.lit(TOKEN), F.lit(0))


def words_and_lower(sentence: Column) -> Column:
    words = words_of(sentence)
    return F.struct(words.alias("tokens"), F.transform(words, F.lower).alias("lower"))


def _quick(sql: str) -> str:
    """The same rule with less work for each word: word lists that follow each other are tried only for words of any of them, patterns that fix
    an ending and a least length are read as such."""
    lists = re.compile(r"(?:^ *WHEN lower\(token\) IN \([^()]*\) THEN '[^']*'\n){2,}", re.M)
    any_of = lambda run: ", ".join(re.findall(r"IN \(([^()]*)\)", run))
    out = lists.sub(lambda m: f"    WHEN lower(token) IN ({any_of(m[0])}) THEN CASE\n{m[0]} END\n", sql)

    def ending(m: re.Match) -> str:
        ends = f"endswith(lower(token), '{m[3]}')"
        ends = f"({ends} AND length(lower(token)) >= {len(m[2]) + len(m[3])})" if m[2] else ends
        return f"NOT {ends}" if m[1] else ends

    return re.sub(r"lower\(token\) (NOT )?LIKE '(_*)%([^'%_\\]*)'", ending, out)


def _rule(items: Column, sql: str, names: tuple[str, ...], keep: tuple[str, ...] = ()) -> Column:
    """``sql`` over each struct of the array ``items`` (``names``, low): its values, or structs of ``keep`` and the value as ``out``.

    The rule stays inside one small expression, so however often the plan repeats it, generated code stays small."""
    body = re.sub(r"lower\(token\)", "x.low", _quick(sql))
    body = re.sub(r"'(?:[^']|'')*'|\b(" + "|".join(names) + r")\b", lambda m: f"x.{m[1]}" if m[1] else m[0], body)
    shape = "named_struct(" + "".join(f"'{k}', x.{k}, " for k in keep) + f"'out', {body})" if keep else body
    return F.call_function("transform", items, F.expr(f"x -> {shape}"))


def tag_of(token: Column, tok_index: Column, pos_sql: str = POS_SQL) -> Column:
    item = F.struct(token.alias("token"), F.lower(token).alias("low"), tok_index.alias("tok_index"))
    return _rule(F.array(item), pos_sql, ("token", "tok_index"))[0]


def lemma_of(token: Column, pos: Column, lemma_sql: str = LEMMA_SQL) -> Column:
    return _rule(F.array(F.struct(token.alias("token"), F.lower(token).alias("low"), pos.alias("pos"))), lemma_sql, ("token", "pos"))[0]


def tagged_words(sentence: Column, pos_sql: str = POS_SQL) -> Column:
    """The tokens of a sentence with their tags, as an array of (token, out)."""
    items = F.transform(words_of(sentence), lambda w, i: F.struct(w.alias("token"), F.lower(w).alias("low"), i.alias("tok_index")))
    return _rule(items, pos_sql, ("token", "tok_index"), keep=("token",))


def wordnet_class(pos: Column) -> Column:
    """Part of speech for a dictionary: a, v, n or r."""
    return F.when(pos.startswith("J"), "a").when(pos.startswith("V"), "v").when(pos.startswith("R"), "r").otherwise("n")


def coarse_label(pos: Column) -> Column:
    out = F.lit("other")
    for prefix, label in COARSE.items():
        out = F.when(pos.startswith(prefix), label).otherwise(out)
    return out


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sent_index, sentence), blank ones left out."""
    split = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(sentences_of(F.col(text_col))).alias("sent_index", "sentence"))
    return split.where(F.trim("sentence") != "")


def words(sents: DataFrame) -> DataFrame:
    """(doc_id, sent_index, tok_index, token) of (doc_id, sent_index, sentence): ``tokens`` without the tags."""
    return sents.select("doc_id", "sent_index", F.posexplode(words_of(F.col("sentence"))).alias("tok_index", "token"))


def tagged(rows: DataFrame, pos_sql: str = POS_SQL, lemma_sql: str = LEMMA_SQL) -> DataFrame:
    """Rows (tok_index, token, ...) with pos and lemma.

    Both rules are plain columns, so they run as generated code; a generator of one row stands between them: no filter on a tag or lemma makes the tag a
    second time, and each rule's code stays small enough for the JVM to compile."""
    rest = [c for c in rows.columns if c not in ("tok_index", "token")]
    coarse = rows.withColumn("low", F.lower("token")).withColumn("pos", _columns(pos_sql))
    apart = coarse.select(*rest, F.inline(F.array(F.struct("tok_index", "token", "low", "pos"))))
    return apart.select(*rest, "tok_index", "token", "pos", _columns(lemma_sql).alias("lemma"))


def _columns(sql: str) -> Column:
    """A rule over the columns token, low (the token in lower case), tok_index and pos."""
    return F.expr(re.sub(r"lower\(token\)", "low", _quick(sql)))


def tokens(sents: DataFrame, pos_sql: str = POS_SQL, lemma_sql: str = LEMMA_SQL) -> DataFrame:
    """(doc_id, sent_index, tok_index, token, pos, lemma) of (doc_id, sent_index, sentence)."""
    return tagged(words(sents), pos_sql, lemma_sql)


def types(split: DataFrame) -> DataFrame:
    """(tok_index, token, n, pos, lemma) of ``words``: how often each word stands first in a sentence (tok_index 0) and elsewhere (1), which is all that its tag and
    lemma depend on.  What counts tokens over a whole corpus reads these few rows, tagged once, in place of all tokens."""
    return tagged(split.groupBy(F.least("tok_index", F.lit(1)).alias("tok_index"), "token").agg(F.count("*").alias("n")))


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    sents = sentences(docs, id_col, text_col)
    return sents, tokens(sents)


def nested(sents: DataFrame, toks: DataFrame) -> DataFrame:
    """One row a document, with parallel arrays in text order."""
    s = sents.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sent_index", "sentence"))), lambda x: x["sentence"]).alias("sentences"))
    t = toks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_index", "tok_index", "token", "pos", "lemma"))).alias("t"))
    part = lambda c: F.transform("t", lambda x: x[c])
    shaped = t.select("doc_id", part("token").alias("tokens"), part("lemma").alias("lemmas"), F.transform("t", lambda x: F.struct(x["token"].alias("tok"), x["pos"].alias("pos"))).alias("pos_tags"))
    return s.join(shaped, "doc_id", "left")


def filter_by_pos(toks: DataFrame, pos_tags: list[str]) -> DataFrame:
    return toks.where(F.col("pos").isin(pos_tags))
