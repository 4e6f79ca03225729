"""Paragraphs, headings and the place of sentences under them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paragraphs(text: Column, preserve_empty: bool = False) -> Column:
    """Blocks between blank lines, cut again where an indented line follows one that is not."""
    blocks = F.split(text, r"\n\s*\n")
    cut = F.flatten(F.transform(blocks, lambda b: F.split(F.regexp_replace(b, r"(?m)^([^ \t\n].*)\n(?=[ \t])", "$1\u0001"), "\u0001")))
    trimmed = F.transform(cut, lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return trimmed if preserve_empty else F.filter(trimmed, lambda p: p != "")


def paragraph_index(paras: Column, sentence: Column) -> Column:
    """The first paragraph that holds the sentence, counted from 0; 0 if none does."""
    flags = F.transform(paras, lambda p: F.contains(p, F.trim(sentence)))
    return F.greatest(F.array_position(flags, F.lit(True)) - 1, F.lit(0)).cast("int")


def paragraph_spans(text: Column) -> Column:
    """[start, end) of each paragraph, searched forward only."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        found = F.instr(F.substring(text, acc["at"], F.length(text)), p)
        first = F.when(found > 0, acc["at"] + found - 2).otherwise(acc["at"] - 1)
        return F.struct((first + F.length(p) + 1).alias("at"), F.array_append(acc["spans"], F.struct(first.alias("start"), (first + F.length(p)).alias("stop"))).alias("spans"))

    return F.aggregate(paragraphs(text), start, step, lambda acc: acc["spans"])


ROMAN = {r: i for i, r in enumerate("I II III IV V VI VII VIII IX X".split(), 1)}

# Lines that are headings, and lines of a table of contents with the depth of what they name.
NUMBERED = r"^(\d+(?:\.\s?\d+)*)\.\s+([A-Za-z].{3,})$"
NAMED = r"(?i)^(?:(Chapter|Part|Section)\s+(\d+|[IVXLCDM]+))(?:\s*[:\-\.]?\s*(.+))?$"
MARKDOWN = r"^(#{1,6})\s+(.+)$"
CONTENTS = (
    (r"^##\s+(\d+)\.\s+(.+?)\s+—\s+\d+$", 0, True),
    (r"^##\s+([A-Z][^—]+?)\s+—\s+\d+$", 0, False),
    (r"^([A-Z][^—\-]+?)\s+—\s+\d+$", 0, False),
    (r"^-\s+(\d+\.\d+)\.\s+(.+?)\s+—\s+\d+$", 1, True),
    (r"^\s+-\s+(\d+\.\d+\.\d+)\.\s+(.+?)\s+—\s+\d+$", 2, True),
)


def headings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, position, level, number, title): headings of the first kind of which a document has two: numbered, named, markdown, capitals."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("line", "s"))
    w = Window.partitionBy("doc_id").orderBy("line")
    placed = lines.withColumn("position", F.coalesce(F.sum(F.length("s") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s, roman = F.col("s"), F.create_map(*[x for r, i in ROMAN.items() for x in (F.lit(r), F.lit(str(i)))])
    number = F.regexp_replace(F.regexp_extract(s, NUMBERED, 1), r"\s", "")
    named, ordinal, named_title = F.initcap(F.regexp_extract(s, NAMED, 1)), F.regexp_extract(s, NAMED, 2), F.regexp_extract(s, NAMED, 3)
    hashes = F.regexp_extract(s, MARKDOWN, 1)
    caps = s.rlike(r"^\s*[A-Z][A-Z ]{6,}[A-Z]\s*$") & F.trim(s).contains(" ")
    row = lambda kind, level, num, title: F.struct(F.lit(kind).alias("kind"), level.cast("int").alias("depth"), num.alias("number"), F.trim(title).alias("title"))
    found = F.array_compact(F.array(
        F.when(number != "", row("1numbered", F.regexp_count(number, F.lit(r"\.")), number, F.regexp_extract(s, NUMBERED, 2))),
        F.when(named != "", row("2named", F.when(named == "Section", 1).otherwise(0), F.coalesce(F.element_at(roman, F.upper(ordinal)), ordinal), F.when(named_title != "", named_title).otherwise(F.concat_ws(" ", named, ordinal)))),
        F.when(hashes != "", row("3markdown", F.length(hashes) - 1, F.lit(None).cast("string"), F.regexp_extract(s, r"^#{1,6}\s+(.*?)\s*#*$", 1))),
        F.when(caps, row("4capitals", F.lit(0), F.lit(None).cast("string"), F.initcap(F.trim(s)))),
    ))
    each = placed.select("doc_id", "position", F.explode(found).alias("h")).select("doc_id", "position", "h.*")
    counted = each.withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "kind"))).where("n >= 2")
    first = counted.withColumn("best", F.min("kind").over(Window.partitionBy("doc_id"))).where("kind = best")
    by = Window.partitionBy("doc_id").orderBy("position")
    run = by.rowsBetween(Window.unboundedPreceding, 0)
    chapter = F.sum((F.col("depth") == 0).cast("int")).over(run)
    numbered = first.withColumn("c", chapter)
    sec = F.sum((F.col("depth") == 1).cast("int")).over(Window.partitionBy("doc_id", "c").orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    numbered = numbered.withColumn("b", sec)
    sub = F.sum((F.col("depth") >= 2).cast("int")).over(Window.partitionBy("doc_id", "c", "b").orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    numbered = numbered.withColumn("a", sub)
    path = F.when(F.col("depth") == 0, F.col("c").cast("string")).when(F.col("depth") == 1, F.concat_ws(".", "c", "b")).otherwise(F.concat_ws(".", "c", "b", "a"))
    return numbered.select("doc_id", F.substring("kind", 2, 20).alias("kind"), "position", F.concat(F.lit("level_"), "depth").alias("level"), F.coalesce("number", path).alias("number"), "title")


def parse_toc(lines: DataFrame) -> DataFrame:
    """(line, level, number, title) of the lines (line, s) of a table of contents."""
    found = F.lit(None).cast("struct<level:string,number:string,title:string>")
    for rx, depth, numbered in reversed(CONTENTS):
        entry = F.struct(F.lit(f"level_{depth}").alias("level"), (F.regexp_extract("s", rx, 1) if numbered else F.lit("0")).alias("number"), F.regexp_extract("s", rx, 2 if numbered else 1).alias("title"))
        found = F.when(F.col("s").rlike(rx), entry).otherwise(found)
    return lines.select("line", found.alias("e")).where("e is not null").select("line", "e.*")


def located_in_text(docs: DataFrame, toc: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line, level, number, title, position) of the entries of ``toc`` (doc_id, line, level, number, title) that their document's text has.

    An entry stands where its title is a line of its own, else where a line begins with its number and title, else where its words first
    stand; the first twentieth of the text, where the contents are, does not count.  Blanks between words are one blank, case does not matter."""
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    skip = (F.length("text") * 0.05).cast("int")
    joined = toc.join(text, "doc_id").withColumn("skip", skip)
    # one character before the place where the search begins shows whether a line begins there
    rest = F.when(F.col("skip") > 0, F.substring("text", F.col("skip"), F.length("text"))).otherwise(F.concat(F.lit("\n"), "text"))
    joined = joined.withColumn("rest", rest)
    quoted = lambda c: F.concat(F.lit("\\Q"), F.regexp_replace(c, r"\\E", r"\\E\\\\E\\Q"), F.lit("\\E"))
    numbered = r"^(\d+(?:\.\d+)*)\.\s+(.+)$"
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("title", r"^\d+(?:\.\d+)*\.\s*", ""), r"\s+—\s+\d+$", ""), r"\s+", " "))
    ways = [
        F.concat(F.lit(r"(?iu)(?<=\n)"), quoted(F.col("title")), F.lit(r"(?=\n|\z)")),
        F.when(F.col("title").rlike(numbered), F.concat(F.lit(r"(?iu)(?<=\n)"), quoted(F.regexp_extract("title", numbered, 1)), F.lit(r"\.\s*"), quoted(F.regexp_extract("title", numbered, 2)))),
        F.when(plain != "", F.concat(F.lit(r"(?iu)(?<=.)(?s)\b"), quoted(plain), F.lit(r"\b"))),
    ]
    at = [F.nullif(F.regexp_instr("rest", w), F.lit(0)) for w in ways]
    place = F.coalesce(*at) - 2 + F.greatest("skip", F.lit(0))
    found = joined.select("doc_id", "line", "level", "number", "title", F.when(F.col("skip") > 0, place).otherwise(F.coalesce(*at) - 2).cast("long").alias("position"))
    return found.where("position is not null")


def chapters_first(found: DataFrame, toc: DataFrame) -> DataFrame:
    """``found`` (of ``located_in_text``) with every chapter before its first section: a chapter found behind it, or not at all, stands one character before it."""
    sections = found.where(F.col("number").contains(".")).groupBy("doc_id", F.substring_index("number", ".", 1).alias("number")).agg(F.min("position").alias("first"))
    named = toc.where("level = 'level_0'").groupBy("doc_id", "number").agg(F.max_by("title", "line").alias("title"), F.max("line").alias("line"))
    missing = named.join(found.where("level = 'level_0'"), ["doc_id", "number"], "left_anti").join(sections, ["doc_id", "number"])
    moved = found.join(sections, ["doc_id", "number"], "left")
    behind = (F.col("level") == "level_0") & (F.col("position") > F.col("first"))
    moved = moved.select("doc_id", "line", "level", "number", "title", F.when(behind, F.col("first") - 1).otherwise(F.col("position")).alias("position"))
    return moved.unionByName(missing.select("doc_id", "line", F.lit("level_0").alias("level"), "number", "title", (F.col("first") - 1).alias("position")))


def headings_by_contents(docs: DataFrame, toc: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, position, level, number, title) by tables of contents; documents in which fewer than two entries are found give none."""
    found = chapters_first(located_in_text(docs, toc, id_col, text_col), toc)
    enough = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n >= 2").select("doc_id")
    return found.join(enough, "doc_id", "left_semi").select("doc_id", F.lit("contents").alias("kind"), "position", "level", "number", "title")


def without_contents(heads: DataFrame, lengths: DataFrame) -> DataFrame:
    """``heads`` without what a table of contents in the text put there; ``lengths``: (doc_id, n_chars).

    More than ten headings that end in a page number within the first 15 % are such a table: headings up to its last one go, then those numbered
    beyond 20 and those with titles under ten characters.  Page numbers are cut off, and of equal numbers the first heading stays."""
    paged = F.col("title").rlike(r"^\S.*\s\d{1,4}$")
    early = heads.join(lengths.select("doc_id", "n_chars"), "doc_id", "left").withColumn("early", paged & (F.col("position") < (F.col("n_chars") * 0.15).cast("int")))
    all_of = Window.partitionBy("doc_id")
    seen = early.withColumn("pages", F.count_if("early").over(all_of)).withColumn("stop", F.max(F.when(F.col("early"), F.col("position"))).over(all_of))
    has = F.col("pages") > 10
    kept = seen.where(~has | (F.col("position") > F.col("stop"))).withColumn("title", F.when(paged, F.regexp_replace("title", r"\s+\d{1,4}$", "")).otherwise(F.col("title")))
    whole = F.col("number").contains(".") | F.coalesce(F.expr("try_cast(number as long)") <= 20, F.lit(False))
    kept = kept.where(~has | (whole & (F.length("title") >= 10)))
    once = kept.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "number").orderBy("position"))).where("k = 1")
    return once.select(*heads.columns)


def sentence_paragraphs(sents: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sent_index, paragraph): for texts without headings, the last block between blank lines that holds the sentence, from 1; 1 if none does."""
    blocks = docs.select(F.col(id_col).alias("doc_id"), F.split(text_col, r"\n\s*\n").alias("blocks"))
    holds = F.transform("blocks", lambda b, i: F.when((F.trim(b) != "") & F.contains(b, F.trim("sentence")), i + 1))
    return sents.join(blocks, "doc_id").select("doc_id", "sent_index", F.coalesce(F.array_max(holds), F.lit(1)).alias("paragraph"))


def parents(heads: DataFrame) -> DataFrame:
    """``heads`` with ``parent``: position of the nearest earlier heading whose number is this one's without its last part."""
    want = F.when(F.col("number").contains("."), F.regexp_replace("number", r"\.[^.]+$", ""))
    child = heads.withColumn("want", want)
    up = heads.select("doc_id", F.col("number").alias("want"), F.col("position").alias("above"))
    best = child.join(up, ["doc_id", "want"]).where("above < position").groupBy("doc_id", "position").agg(F.max("above").alias("parent"))
    return heads.join(best, ["doc_id", "position"], "left")


def sentence_locations(sents: DataFrame, heads: DataFrame, text_length: DataFrame | None = None) -> DataFrame:
    """(doc_id, sent_index, chapter, section, subsection and their titles): an as-of join, each sentence under the last heading before it.

    Without ``text_length`` (doc_id, n_chars) a sentence stands at the sum of lengths before it; with it that sum is scaled to the text.
    """
    w = Window.partitionBy("doc_id").orderBy("sent_index")
    at = F.coalesce(F.sum(F.length("sentence") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sents.select("doc_id", "sent_index", at.cast("double").alias("at"), F.sum(F.length("sentence") + 1).over(Window.partitionBy("doc_id")).alias("all"))
    if text_length is not None:
        placed = placed.join(text_length, "doc_id", "left").withColumn("at", F.coalesce(F.col("at") * F.col("n_chars") / F.col("all"), "at"))
    marks = heads.select("doc_id", F.lit(None).cast("int").alias("sent_index"), F.col("position").cast("double").alias("at"), F.struct("level", "number", "title").alias("h"))
    both = placed.select("doc_id", "sent_index", "at", F.lit(None).cast("struct<level:string,number:string,title:string>").alias("h")).unionByName(marks)
    over = Window.partitionBy("doc_id").orderBy("at", F.col("h").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    cols, above = {}, F.lit(-1)
    row = F.row_number().over(Window.partitionBy("doc_id").orderBy("at", F.col("h").isNull()))
    both = both.withColumn("row", row)
    for depth, name in enumerate(("chapter", "section", "subsection")):
        mine = F.col("h.level") == f"level_{depth}"
        cols[f"{name}_row"] = F.last(F.when(mine, F.col("row")), True).over(over)
        cols[name], cols[f"{name}_title"] = F.last(F.when(mine, F.col("h.number")), True).over(over), F.last(F.when(mine, F.col("h.title")), True).over(over)
    out = both.select("doc_id", "sent_index", *[c.alias(n) for n, c in cols.items()]).where("sent_index is not null")
    # a section holds only under the chapter that came before it
    live = {"chapter": F.lit(True)}
    live["section"] = F.col("section_row") > F.coalesce("chapter_row", F.lit(0))
    live["subsection"] = live["section"] & (F.col("subsection_row") > F.col("section_row"))
    return out.select("doc_id", "sent_index", *[F.when(live[n], F.col(c)).alias(c) for n in live for c in (n, f"{n}_title")])


def location_passes(start_section: str | None = None, exclude_pattern: str | None = None) -> Column:
    """A filter over the columns of ``sentence_locations`` and ``located`` (false: the sentence has no location, and passes)."""
    out = F.lit(True)
    if start_section is not None:
        number = F.expr("try_cast(chapter as double)")
        out = out & F.col("chapter").isNotNull() & F.coalesce(number >= F.lit(float(start_section)), F.lit(True))
    if exclude_pattern is not None:
        for c in ("chapter_title", "section_title", "subsection_title"):
            out = out & ~F.coalesce(F.col(c).rlike("(?i)" + exclude_pattern), F.lit(False))
    return ~F.coalesce("located", F.lit(True)) | out


def parse_window(spec: str) -> tuple[str, int]:
    """``s2``: two sentences, ``p1``: one paragraph, on either side."""
    kind, radius = spec[:1].lower(), spec[1:]
    if kind not in ("s", "p") or not radius.isdigit():
        raise ValueError(f"a window is s or p and a number, not {spec!r}")
    return {"s": "sentence", "p": "paragraph"}[kind], int(radius)


def window_slots(sents: DataFrame, matches: DataFrame, radius: int) -> DataFrame:
    """(doc_id, match_index, slot, sentence): the sentences around each match (doc_id, sent_index), by distance."""
    slots = matches.select("doc_id", F.col("sent_index").alias("match_index"), F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("slot"))
    return slots.withColumn("sent_index", F.col("match_index") + F.col("slot")).join(sents, ["doc_id", "sent_index"], "left").select("doc_id", "match_index", "slot", "sentence")
