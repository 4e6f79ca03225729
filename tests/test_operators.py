"""The text-analytics operators on small inline documents."""

import json

import pytest
from pyspark.sql import functions as F

from textloom.functions import annotate, clean, inflect
from textloom.operators import context, cooccurrence, definitions, frequency, graph, keyness, metrics, relations, rewrite, scorer, search, structure, terms
from textloom.sources import files, sinks

DOCS = [
    ("d1", "The dog bites the man. Being is presence. The art of being is rare."),
    ("d2", "By presence I mean a lasting form. Partial art was made by Zorns. The cats are small."),
    ("d3", "Nothing here."),
]


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame(DOCS, "doc_id string, text string")
    sents, toks = annotate.annotate(docs)
    return docs, sents.cache(), toks.cache()


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_annotation(corpus):
    _, sents, toks = corpus
    assert sents.count() == 7
    got = {(r.token, r.pos, r.lemma) for r in toks.collect()}
    assert {("The", "DT", "the"), ("is", "VBZ", "be"), ("cats", "NNS", "cat"), (".", ".", "."), ("made", "VBD", "make"), ("Zorns", "NNPS", "zorn")} <= got


def test_contractions(spark):
    one = annotate.tokens(annotate.sentences(spark.createDataFrame([(1, "It's don't well-known, 3.5!")], "doc_id long, text string")))
    assert [r.token for r in one.orderBy("sent_index", "tok_index").collect()] == ["It", "'s", "do", "n't", "well-known", ",", "3", ".", "5", "!"]


def test_tags_are_made_once_and_as_the_rules_say(spark):
    """F2 to F33: a filter on a lemma made the tag again and again; each count over the corpus tagged all its tokens."""
    text = "It's Ling, bed red. Al al Bic ic ous s ss sing Sings flies Flies dies. ied ied led 3x 42 _ing Été ÉTÉ ies THE the n't xes Foxes churches classes İs ſ"
    sents = annotate.sentences(spark.createDataFrame([(1, text), (2, text + ". The dogs")], "doc_id long, text string"))
    toks = annotate.tokens(sents)
    plain = annotate.words(sents).withColumn("pos", F.expr(annotate.POS_SQL)).withColumn("lemma", F.expr(annotate.LEMMA_SQL))
    assert toks.count() == plain.count() and toks.exceptAll(plain).isEmpty()
    plan = toks.where("lemma = 'be' and pos = 'VBZ'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("whatever") <= 2 and plan.count("regexp_extract_all") == 1
    types = annotate.types(annotate.words(sents))
    assert types.count() < toks.count()
    for count in (lambda t: frequency.corpus_frequencies(t, True), lambda t: keyness.pos_vocabulary(t, ["NN"], ["DT"]), search.content_frequencies, lambda t: keyness.author_terms(t, False)):
        assert rows(count(types), *count(types).columns) == rows(count(toks), *count(toks).columns)


def test_frequencies(corpus):
    _, _, toks = corpus
    counts = dict(rows(frequency.corpus_frequencies(toks), "term", "n"))
    assert counts["the"] == 4 and counts["art"] == 2
    idf = dict(rows(frequency.idf(toks, 3), "term", "idf"))
    assert abs(idf["art"] - 0.405465) < 1e-5 and abs(idf["nothing"] - 1.098612) < 1e-5
    assert {r.score >= 0 for r in frequency.corpus_tfidf(toks, 3).collect()} == {True}


def test_keyness_pseudocount(spark):
    toks = spark.createDataFrame([(1, 0, i, w, "NN", w) for i, w in enumerate(["new"] * 3 + ["old"] * 3)], "doc_id long, sent_index int, tok_index int, token string, pos string, lemma string")
    ref = spark.createDataFrame([("old", 10), ("other", 90)], "term string, count long")
    got = dict(rows(keyness.compare(toks, ref), "term", "ratio"))
    assert abs(got["new"] - 0.5 / (0.5 / 100)) < 1e-9 and abs(got["old"] - 5.0) < 1e-9
    assert rows(keyness.neologisms(toks, ref), "term") == [("new",)]
    with pytest.raises(ValueError):
        keyness.combined_terms(keyness.compare(toks, ref), keyness.tfidf_vs_reference(toks, ref), method="both")


def test_valid_terms(spark):
    good = spark.createDataFrame([(t,) for t in ["word", "i.e", "a", "--", "n't", "x-", "don't", "42", "É1"]], "term string").where(keyness.is_valid_term(F.col("term")))
    assert rows(good, "term") == [("don't",), ("word",), ("É1",)]


def test_definitions(corpus):
    found = {(r.kind, r.term.lower()) for r in definitions.definitional_contexts(corpus[1]).collect()}
    assert {("copular", "being"), ("explicit_mean", "presence")} <= found


def test_definitions_have_the_edges_of_their_sql(spark):
    """F11 to F14: of the terms that do not begin with an ASCII letter SQL has what follows their first ASCII edge, or nothing."""
    duckdb = pytest.importorskip("duckdb")
    texts = ["Lequeou èreauxou Is haatwh.", "oule éç Was ednt on.", "Art\u00a0is rare", "Art\x0bis rare", "caf\xe9 is été was à are 中文 is", "x-é is by é I mean", "the idea of éa", "mode\u017f i\u017f old", "\u212aelvin is A1 IS", "one \u0130s two \u0131s three", "x refer\u017f to y", "by x I mean, what we call k"]
    sents = spark.createDataFrame([(i, 0, s) for i, s in enumerate(texts)], "doc_id long, sent_index int, sentence string")
    got = sorted((r.doc_id, r.kind, r.term) for r in definitions.definitional_contexts(sents).collect())
    want = []
    for i, s in enumerate(texts):
        for kind, p in definitions.PATTERNS.items():
            want += [(i, kind, t) for t in duckdb.execute("SELECT regexp_extract_all(?, ?, 1)", [s, "(?i)" + p]).fetchone()[0]]
    assert got == sorted(want) and len(want) > 5


def test_phrases_are_replaced_in_one_walk(spark):
    """each token was compared with every span of its document."""
    def lines(*texts):
        sents, toks = annotate.annotate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
        return annotate.nested(sents, toks)

    def replaced(docs, source, target):
        out = rewrite.replace_phrase(docs, source, target)
        assert "exists(" not in out._jdf.queryExecution().optimizedPlan().toString()
        return [r.text for r in out.orderBy("doc_id").select(rewrite.rebuilt(F.col("tokens")).alias("text")).collect()]

    assert replaced(lines("Of the dog of the of the", "none", "cat of the"), ["of", "the"], ["out", "of"]) == ["Out of dog out of out of", "none", "cat out of"]
    assert replaced(lines("art art art art art"), ["art", "art"], ["new", "form"]) == ["new form new form art"]


def test_first_hits_sort_only_the_first_documents(spark):
    """all hits were sorted with their sentences."""
    sents = spark.createDataFrame([(d, i, f"the {d} {i}") for d in (5, None, 3, 9, 1) for i in range(4)], "doc_id long, sent_index int, sentence string")
    found = scorer.example_sentences(sents, ["the", "9", "zzz"], 5)
    assert sorted(((r.term, r.doc_id, r.sent_index) for r in found.collect()), key=str) == sorted([("the", None, i) for i in range(4)] + [("the", 1, 0)] + [("9", 9, i) for i in range(4)], key=str)
    assert "_d" in found._jdf.queryExecution().optimizedPlan().toString()


def test_search(corpus):
    _, sents, toks = corpus
    assert search.find_sentences(sents, "art").count() == 2  # also inside "Partial"
    assert rows(search.count_occurrences(sents, "art"), "n") == [(3,)]
    overlap = sents.sparkSession.createDataFrame([(1, 0, "aaaa")], "doc_id long, sent_index int, sentence string")
    assert search.find_sentences(overlap, "aa").first().term_positions == [0, 1, 2]
    line = search.concordance(sents, "presence", width=12).orderBy("doc_id").first()
    assert (line.left_context, line.keyword) == ("is", "presence")
    assert search.find_lemma(sents, toks, "be").count() == 4
    windows = search.context_windows(sents, search.dispersion(sents, "presence")).where("doc_id = 'd1'").first()
    assert windows.before == ["The dog bites the man."] and windows.after == ["The art of being is rare."]
    with pytest.raises(ValueError):
        search.concordance_sorted(search.concordance(sents, "a"), "middle")
    shown = sents.where("doc_id = 'd1' and sent_index = 2").select(search.highlighted(F.col("sentence"), "a").alias("s")).first().s
    assert shown == "The **a**rt of being is r**a**re."


def test_dense_regions(spark):
    ten = spark.createDataFrame([(1, i, "x" if i % 3 else "term") for i in range(10)], "doc_id long, sent_index int, sentence string")
    assert search.dense_regions(ten, "term", 4, 2).count() == 3
    assert search.dense_regions(ten, "term", 11, 1).count() == 0


def test_cooccurrence(spark):
    s = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a cat and a dog", "the cat", "a dog.", "bird"])], "doc_id long, sent_index int, sentence string")
    assert dict(rows(cooccurrence.in_sentence(s, "cat"), "word", "n")) == {"a": 2, "and": 1, "dog": 1, "the": 1}
    pairs = cooccurrence.pair_counts(s, ["cat", "dog"])
    assert tuple(pairs.first()) == ("cat", "dog", 1, 2, 2, 4) and abs(cooccurrence.pmi(pairs).first().score) < 1e-12
    full = cooccurrence.matrix(s, ["cat", "dog", "bird"])
    assert full.count() == 9 and {(r.t1, r.t2): r.score for r in full.collect()}[("dog", "cat")] == 1.0
    with pytest.raises(ValueError):
        cooccurrence.matrix(s, ["cat"], "other")


def test_relations(corpus):
    lines = relations.coded(corpus[1], corpus[2])
    assert ("Partial", "was", "made") not in rows(relations.svo(lines), "subject", "verb", "object")
    assert rows(relations.copular(lines, "being"), "subject", "copula", "complement")[0] == ("Being", "is", "presence")
    assert rows(relations.prepositional(lines, "art"), "head", "preposition", "object") == [("art", "of", "rare")]
    both = relations.relations(lines, "being")
    assert {r.relation_type for r in both.collect()} == {"copular"}
    with pytest.raises(ValueError):
        relations.relations(lines, "being", ())


def test_scorer_and_contexts(corpus):
    _, sents, toks = corpus
    ref = sents.sparkSession.createDataFrame([("the", 50), ("is", 20)], "term string, count long")
    got = scorer.score_all(sents, toks, ref, ref, min_author_freq=1)
    assert got.where("total < 0").count() == 0 and got.count() > 10
    assert context.contextual_relations(sents, toks, "being").where("relation_type = 'copular'").count() >= 1


@pytest.fixture(scope="module")
def small(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdez"], "id string")
    return graph.graph(nodes, spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("d", "e", 1.0)], "src string, dst string, weight double"))


def test_graph(small, spark):
    assert rows(graph.isolated(small), "id") == [("z",)]
    assert graph.prune_edges(small, 1.5).edges.count() == 1 and graph.prune_nodes(small, 2).nodes.count() == 1
    assert graph.subgraph(small, spark.createDataFrame([("a",), ("b",)], "term string")).edges.count() == 1
    joined = graph.merged(small, graph.graph(spark.createDataFrame([("z", "Z!")], "id string, label string"), spark.createDataFrame([("b", "a", 9.0)], "src string, dst string, weight double")))
    assert {(r.src, r.dst): r.weight for r in joined.edges.collect()}[("a", "b")] == 9.0 and joined.nodes.where("label = 'Z!'").count() == 1
    with pytest.raises(ValueError):
        graph.merged(small, graph.ConceptGraph(small.nodes, small.edges, True))
    doubled = graph.consolidated(graph.graph(spark.createDataFrame([("x", "L"), ("y", "L"), ("w", "W")], "id string, label string"), spark.createDataFrame([("x", "w", 1.0), ("y", "w", 2.0), ("x", "y", 5.0)], "src string, dst string, weight double")))
    assert [(r.src, r.dst, r.weight) for r in doubled.edges.collect()] == [("w", "x", 3.0)]


def test_metrics(small):
    between = dict(rows(metrics.betweenness(small), "id", "score"))
    assert max(between, key=between.get) == "b" and abs(between["b"] - 0.1) < 1e-9
    assert dict(rows(metrics.components(small), "id", "component")) == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "z": "z"}
    assert metrics.shortest_path(small, "a", "c") == ["a", "b", "c"]
    with pytest.raises(ValueError):
        metrics.shortest_path(small, "a", "d")
    assert abs(metrics.density(small).first().density - 0.2) < 1e-9
    assert abs(sum(r.score for r in metrics.pagerank(small).collect()) - 1) < 1e-6
    found = metrics.communities(small)
    assert found.select("community").distinct().count() == 3 and metrics.modularity(small, found) > 0.3


def test_cleaning(spark):
    text = "42\nPage 7\n3 4 5 6\nthe obsti nacy of betweenexpression  wel1 1 . 5 . 2\n\n\n\nend !  "
    got = spark.createDataFrame([(text,)], "t string").select(clean.clean_text(F.col("t")).alias("c"), clean.ocr_issues(F.col("t")).alias("i")).first()
    assert got.c == "the obstinacy of between expression well 1.5.2\n\nend!"
    assert (got.i.page_numbers, got.i.number_clusters) == (1, 1)


def test_structure(spark):
    text = "1. Opening\nbody\n1.1. Subject\nmore text. And more.\n2. Two parts\nend"
    docs = spark.createDataFrame([(1, text), (2, "# A\nx\n## B\ny\n# C\n"), (3, "plain")], "doc_id long, text string")
    heads = structure.headings(docs)
    assert rows(heads, "doc_id", "number", "level", "title") == [(1, "1", "level_0", "Opening"), (1, "1.1", "level_1", "Subject"), (1, "2", "level_0", "Two parts"), (2, "1", "level_0", "A"), (2, "1.1", "level_1", "B"), (2, "2", "level_0", "C")]
    assert {r.number: r.parent for r in structure.parents(heads).where("doc_id = 1").collect()} == {"1": None, "1.1": 0, "2": None}
    toc = structure.parse_toc(spark.createDataFrame([(0, "## 3. Name — 12"), (1, "- 3.1. Part — 13"), (2, "noise")], "line int, s string"))
    assert rows(toc, "level", "number", "title") == [("level_0", "3", "Name"), ("level_1", "3.1", "Part")]
    paras = spark.createDataFrame([("a\n\nb\n  c\n\n\n",)], "t string").select(structure.paragraphs(F.col("t")).alias("p")).first().p
    assert paras == ["a", "b", "c"]
    assert structure.parse_window("p2") == ("paragraph", 2)
    with pytest.raises(ValueError):
        structure.parse_window("x1")


def test_rewriting(spark):
    forms = spark.createDataFrame([("run", "VBG"), ("city", "NNS"), ("be", "VBD"), ("big", "JJR"), ("stop", "VBD"), ("make", "VBG")], "l string, t string").select(inflect.inflect(F.col("l"), F.col("t")).alias("f"))
    assert [r.f for r in forms.collect()] == ["running", "cities", "was", "bigger", "stoped", "making"]
    docs = spark.createDataFrame([(1, "Dogs ran out of the house. DOGS!")], "doc_id long, text string")
    sents, toks = annotate.annotate(docs)
    nested = annotate.nested(sents, toks.withColumn("lemma", F.when(F.lower("token") == "dogs", "dog").otherwise(F.col("lemma"))).withColumn("pos", F.when(F.lower("token") == "dogs", "NNS").otherwise(F.col("pos"))))
    out = rewrite.replace_phrase(rewrite.replace_lemma(nested, "dog", "cat"), ["out", "of"], ["away", "from"])
    assert out.select(rewrite.rebuilt(F.col("tokens")).alias("t")).first().t == "Cats ran away from the house. CATS!"
    assert rewrite.phrase_matches(nested, ["of", "the"]).count() == 1


def test_term_lists(spark, tmp_path):
    a = terms.shaped(spark.createDataFrame([("x", "NN"), ("y", "VB")], "term string, pos string"))
    b = terms.shaped(spark.createDataFrame([("y", "JJ"), ("z", "NN")], "term string, pos string"))
    assert rows(terms.merge(a, b), "term", "pos") == [("x", "NN"), ("y", "VB"), ("z", "NN")]
    assert rows(terms.merge(a, b, overwrite=True), "term", "pos") == [("x", "NN"), ("y", "JJ"), ("z", "NN")]
    with pytest.raises(ValueError):
        terms.add(a, b)
    with pytest.raises(KeyError):
        terms.remove(a, "nope")
    assert sinks.write_terms(a, str(tmp_path / "t"), "txt") == 2 and files.read_terms(spark, str(tmp_path / "t"), "txt").count() == 2
    with pytest.raises(sinks.EmptyOutputError):
        sinks.write_terms(a.limit(0), str(tmp_path / "e"))


def test_readers_and_writers(spark, small, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/b.txt").write_bytes("né".encode("latin-1"))
    (tmp_path / "in/a.txt").write_text("é", encoding="utf-8")
    got = files.read_texts(spark, str(tmp_path / "in")).orderBy("doc_idx").collect()
    assert [(r.text, r.encoding, r.metadata["title"]) for r in got] == [("é", "utf-8", "a"), ("né", "latin-1", "b")]
    d3 = json.load(open(sinks.write_d3_json(small, str(tmp_path / "g.json"))))
    assert len(d3["nodes"]) == 5 and len(d3["links"]) == 3
    assert files.read_graph_json(spark, str(tmp_path / "g.json")).edges.count() == 3
    for write, name, mark in ((sinks.write_graphml, "g.graphml", "<graphml"), (sinks.write_gexf, "g.gexf", "<gexf"), (sinks.write_dot, "g.dot", '"a" -- "b"'), (sinks.write_node_link_json, "n.json", '"links"')):
        assert mark in open(write(small, str(tmp_path / name))).read()
    assert "svg" in open(sinks.write_html(small, str(tmp_path / "h"))).read()
    store = files.ArtifactStore(spark, str(tmp_path / "store"))
    store.save_graph("g", small)
    assert store.load_graph("g").edges.count() == 3


def test_headings_by_contents(spark):
    lead = "Contents of the book\n" + "Opening\nBody here\n"
    text = lead + "x " * 400 + "\nThe Body\nsome text\n1.1. First Part\nmore text about  things\nThe Ending\nlast words on Closing Matters here"
    docs = spark.createDataFrame([(1, text), (2, "nothing of it"), (3, None)], "doc_id long, text string")
    toc = spark.createDataFrame(
        [(1, 0, "level_0", "1", "the body"), (1, 1, "level_1", "1.1", "1.1. First Part"), (1, 2, "level_0", "2", "Nowhere"), (1, 3, "level_1", "2.1", "Closing Matters"), (1, 4, "level_0", "3", "Absent (b*d)"), (2, 0, "level_0", "1", "The Body")],
        "doc_id long, line int, level string, number string, title string",
    )
    got = {r.number: r for r in structure.headings_by_contents(docs, toc).collect()}
    assert {n: r.position for n, r in got.items()} == {"1": text.index("The Body"), "1.1": text.index("1.1. First"), "2.1": text.index("Closing Matters"), "2": text.index("Closing Matters") - 1}
    assert {r.doc_id for r in got.values()} == {1}
    late = toc.where("number <> '1'").union(spark.createDataFrame([(1, 9, "level_0", "1", "The Ending")], toc.schema))
    moved = {r.number: r.position for r in structure.headings_by_contents(docs, late).collect()}
    assert moved["1"] == text.index("1.1. First") - 1  # a chapter stands before its first section


def test_headings_without_contents(spark):
    rows = [(1, "numbered", i * 10, "level_0", str(i + 1), f"Some long heading {i + 1}") for i in range(12)]
    rows += [(1, "numbered", 5000, "level_0", "1", "A chapter that stays 7"), (1, "numbered", 6000, "level_0", "21", "A number beyond twenty"), (1, "numbered", 7000, "level_0", "2", "Short"), (1, "numbered", 8000, "level_1", "1.1", "A section that stays"), (1, "numbered", 9000, "level_0", "1", "A chapter once more")]
    rows += [(2, "numbered", 5, "level_0", "1", "First 12"), (2, "numbered", 9, "level_0", "1", "Again")]
    heads = spark.createDataFrame(rows, "doc_id long, kind string, position long, level string, number string, title string")
    lengths = spark.createDataFrame([(1, 10000), (2, 100)], "doc_id long, n_chars long")
    got = sorted((r.doc_id, r.position, r.title) for r in structure.without_contents(heads, lengths).collect())
    assert got == [(1, 5000, "A chapter that stays"), (1, 8000, "A section that stays"), (2, 5, "First")]


def test_sentence_paragraphs(spark):
    docs = spark.createDataFrame([(1, "One here. Two here.\n\n  \n\nThree here.")], "doc_id long, text string")
    got = [r.paragraph for r in structure.sentence_paragraphs(annotate.sentences(docs), docs).orderBy("sent_index").collect()]
    assert got == [1, 1, 2]
    titles = {r.title for r in structure.headings(spark.createDataFrame([(1, "1. Title one\nx\n1. 7. Title two\n2. ab\n3. 4th thing")], "doc_id long, text string")).collect()}
    assert titles == {"Title one", "Title two"}


def test_suggestions(spark):
    from textloom.operators import suggest

    docs = spark.createDataFrame([(1, "The dasein is being. We see dasein here. Dasein is more."), (2, "Some dasein again. Nothing else.")], "doc_id long, text string")
    sents, toks = annotate.annotate(docs)
    reference = spark.createDataFrame([("the", 100), ("be", 50), ("we", 50), ("see", 20), (".", 500)], "term string, count long")
    got = {r.term: r for r in suggest.by_method(sents, toks, reference, "ratio", 1).collect()}
    assert list(got) == ["dasein"] and got["dasein"].examples == ["The dasein is being.", "We see dasein here.", "Dasein is more."] and got["dasein"].lemma == "dasein" and got["dasein"].notes == "Method: ratio"
    scores = spark.createDataFrame([("dasein", 3.456), ("here", 1.0)], "term string, total double")
    best = suggest.from_scores(scores, sents, toks, min_score=2.0, max_examples=1).collect()
    assert [(r.term, r.notes, r.examples) for r in best] == [("dasein", "Score: 3.46", ["The dasein is being."])]
    assert suggest.by_method(sents, toks, reference, "definitional", 5).where("term = 'dasein'").count() == 1
    with pytest.raises(ValueError):
        suggest.by_method(sents, toks, reference, "guess")


def test_gexf_has_every_attribute(spark, tmp_path):
    import xml.etree.ElementTree as ET

    nodes = spark.createDataFrame([("a", "A & B", 3, "NN"), ("b", "b", None, None)], "id string, label string, frequency int, pos string")
    edges = spark.createDataFrame([("a", "b", 0.5, "svo", ["one", "two"])], "src string, dst string, weight double, relation_type string, evidence array<string>")
    root = ET.parse(sinks.write_gexf(graph.ConceptGraph(nodes, edges, True), str(tmp_path / "g.gexf"))).getroot()
    at = {"g": "http://gexf.net/1.2draft"}
    names = {(c.get("class"), x.get("title")): x.get("id") for c in root.iterfind(".//g:attributes", at) for x in c}
    assert {("node", "frequency"), ("node", "pos"), ("edge", "evidence"), ("edge", "relation_type")} <= set(names)
    values = {n.get("id"): {v.get("for"): v.get("value") for v in n.iterfind(".//g:attvalue", at)} for n in root.iterfind(".//g:node", at)}
    assert values["a"][names["node", "frequency"]] == "3" and values["b"] == {}
    edge = root.find(".//g:edge", at)
    assert edge.get("weight") == "0.5" and [v.get("value") for v in edge.iterfind(".//g:attvalue", at) if v.get("for") == names["edge", "evidence"]] == ["one | two"]
