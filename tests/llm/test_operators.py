"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import bpe_codec, components, fm_decontam, media_mpeg, ngram_join, quality_gbdt, queries, token_counts, tool_chat, toxicity_knn, url_cascade, xent_lm
from textloom.llm.common import ALNUM_WORD, beginning_hashes, released, text_bytes, word_hashes, words_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Extra columns whose names clash with those the operators make.
SCHEMA = "doc_id long, text string, n long, node long, label int, score double, spans string"


def frame(spark, texts, first=0):
    rows = [(first + i, t, 1, 2, 3, 0.5, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def texts_of(seed, n, words=400, longest=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioubcdé") for _ in range(rng.randint(1, 5))) for _ in range(words)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.4:
            w = rng.choice(out).split(" ")
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w))
        else:
            out.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, longest))))
    return out


EDGE = [None, "", " ", "\n\n", "word", "Zwei  Räume\n x ", "▁▁ a", "🙂 é\x00", "the " * 20_000, "x" * 30_000, "a b c d e", "a b c d e"]


def test_token_counts(spark):
    import sentencepiece

    model = queries.tokenizer_file("piece_bpe_32k.model")
    texts = EDGE + texts_of(1, 40)
    got = {r.doc_id: r for r in token_counts.over_limit(token_counts.count_tokens(frame(spark, texts), model), 4096).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    for i, t in enumerate(texts):
        assert (got[i].n_bytes, got[i].n_tokens) == (len((t or "").encode()), len(sp.encode(t or "")))
        assert got[i].over_limit == (got[i].n_tokens > 4096)
    assert token_counts.count_tokens(frame(spark, []), model).count() == 0


def test_token_units_without_a_table(spark):
    lengths = token_counts.PieceLengths(queries.tokenizer_file("piece_bpe_32k.model"))
    rng = random.Random(3)
    for _ in range(3000):
        t = "".join(rng.choice(["a", " ", "  ", "\n", "▁", "the", "é", "\t", "　", "</s>"]) for _ in range(rng.randint(0, 12)))
        assert sum(lengths.lengths(lengths.split(t))) == len(lengths.model.encode(t)), repr(t)


def test_media_round_trip(spark):
    texts = EDGE + ["ÿ" * 400, "z" * 575, "z" * 576, "z" * 577]
    rows = media_mpeg.probe_media(media_mpeg.store_texts(frame(spark, texts))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        payload = media_mpeg.pad((texts[r.doc_id] or "").encode())
        assert len(payload) % 576 == 0 and payload
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.n_samples == len(payload) == 576 * r.n_frames and r.crc_bad == 0 and r.skipped == 0 and len(r.seek_offsets) == r.n_frames
    same = [r.media_sha256 for r in rows if r.doc_id in (10, 11)]
    assert same[0] == same[1]
    empty = spark.createDataFrame([(1, None), (2, b"no audio")], "doc_id long, media binary")
    assert [r.payload_bytes for r in media_mpeg.probe_media(empty).collect()] == [0, 0]


def test_media_damage():
    data = media_mpeg.write_stream(media_mpeg.pad(b"\xff\xfb" * 2000))
    whole = media_mpeg.read_stream(data)
    assert whole.tags["TLEN"] == "252" and whole.xing == {"frames": 7, "bytes": len(data) - 10 - 14}  # milliseconds
    cut = whole.offsets[3]
    hurt = media_mpeg.read_stream(data[:cut] + b"\0" * 40 + data[cut:])
    assert hurt.resyncs == 1 and hurt.skipped == 40 and len(hurt.offsets) == 7
    flipped = bytearray(data)
    flipped[whole.offsets[2] + 8] ^= 1
    assert media_mpeg.read_stream(bytes(flipped)).crc_bad == 1
    assert media_mpeg.read_stream(data + b"TAG" + b"song".ljust(125, b"\0")).samples == whole.samples


def url_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOWER)
    best = max(((len(h + p), h + p, a) for a, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, None, "allow"))
    return host, path, best[1], best[2]


URLS = [None, "", "no scheme", "http://", "http://com/en/", "HTTP://A.B.Example.COM/en/712?x#y", "https://xcom/en/1", "http://example.com/en", "http://m.example.net/de/8", "x://example.net/de/9#a", "http://a.org/es/?q", "http://a.org:80/es/", "ftp://u@a.net/de/", "http://example.com/en/7\n8", "a://b://com/en/", "http://com./en/"]


def bitwise_crc(bits):
    crc = 0xFFFF
    for b in bits:
        crc = (crc << 1 ^ (0x8005 if (crc >> 15) ^ int(b) else 0)) & 0xFFFF
    return crc


def test_media_checksums_of_layers_one_and_two():
    rng = random.Random(2)
    for layer, kbps, mono, fields in ((1, 192, True, [4] * 32), (1, 256, False, [4] * 64), (2, 192, False, [4] * 22 + [3] * 24 + [2] * 8), (2, 48, True, [4] * 2 + [3] * 6), (2, 128, True, [4] * 11 + [3] * 12 + [2] * 4)):
        h = media_mpeg.Header(3, layer, True, kbps, 48000, 0, mono)
        head, body = h.packed(), bytearray(rng.randbytes(h.length - 6))
        bits, at, used = "".join(f"{b:08b}" for b in body), 0, 0
        for n in fields:
            used += int(bits[at : at + n], 2) > 0
            at += n
        covered = f"{int.from_bytes(head[2:], 'big'):016b}" + bits[: at + (2 * used if layer == 2 else 0)]
        frame = head + bitwise_crc(covered).to_bytes(2, "big") + bytes(body)
        good = media_mpeg.read_stream(frame * 3)
        assert (good.crc_checked, good.crc_bad, len(good.headers)) == (3, 0, 3), (layer, kbps)
        body[0] ^= 0x10
        assert media_mpeg.read_stream(frame + frame[:6] + bytes(body) + frame).crc_bad == 1


def test_media_vbri_table():
    h = media_mpeg.Header(3, 3, False, 128, 44100, 0, False)
    steps = [1, 2, 3]
    table = b"VBRI" + (1).to_bytes(2, "big") + bytes(4) + (5000).to_bytes(4, "big") + (9).to_bytes(4, "big") + (3).to_bytes(2, "big") + (7).to_bytes(2, "big") + (2).to_bytes(2, "big") + (3).to_bytes(2, "big") + b"".join(x.to_bytes(2, "big") for x in steps)
    opening = (h.packed() + bytes(32) + table).ljust(h.length, b"\0")
    got = media_mpeg.read_stream(opening + (h.packed().ljust(h.length, b"\0")) * 9)
    assert got.xing == {"frames": 9, "bytes": 5000} and got.steps == [7, 14, 21] and len(got.headers) == 9 and got.samples == 9 * 1152


def test_media_and_encoding_of_queries(spark, tmp_path):
    docs = frame(spark, EDGE)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op2_media_mpeg(spark, str(tmp_path)).collect()}
    for i, t in enumerate(EDGE):
        raw = (t or "").encode()
        raw += b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]))
        assert len(r.seek_offsets) == r.n_frames == len(raw) // 576 and r.crc_bad == 0
    empty = frame(spark, [])
    assert media_mpeg.probe_media(media_mpeg.store_texts(empty)).count() == 0
    ranks, pattern = queries.tokenizer_file("byte_bpe_50k.tiktoken"), queries.split_pattern()
    assert bpe_codec.decode_ids(bpe_codec.encode_texts(empty, ranks, pattern), ranks, pattern).count() == 0


def test_pieces_of_long_texts_without_spaces():
    ranks, pattern = queries.tokenizer_file("byte_bpe_50k.tiktoken"), queries.split_pattern()
    plain = bpe_codec.load_encoding(ranks, pattern)
    for t in ("ab\n" * 3000, "\u4f60\u597d\u4e16\u754c\u3002" * 2000, "don't1x;'s \x1c!\x1cab\xb25" * 900):
        parts = list(bpe_codec.pieces(t, 500))
        assert max(map(len, parts)) < 600 and sum((plain.encode_ordinary(p) for p in parts), []) == plain.encode_ordinary(t)
    rng = random.Random(14)
    for _ in range(500):
        t = "".join(rng.choice([" ", "\n", "a", "Z", "'s", "'", "1", "\xb2", "!!", "_", "\xe9", "\u3000", "\x1c", "\x85", "\u4e2d", "\u3002", "\uac00", "\u0301"]) for _ in range(40))
        assert sum((plain.encode_ordinary(p) for p in bpe_codec.pieces(t, 1)), []) == plain.encode_ordinary(t), repr(t)


def test_url_cascade(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS + URLS[4:6])], "page_id long, url string, host string, keys string")
    rules = spark.createDataFrame(list(queries.URL_RULES), "action string, host string, path string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_cascade.judge_urls(pages, rules).collect()}
    assert got == {i: url_verdict(u) for i, u in enumerate(URLS + URLS[4:6])}
    assert url_cascade.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_cascade.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_url_rules_are_those_of_the_contract(spark):
    words = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    pages = spark.createDataFrame([(i, f"http://www.{rule}1") for i, rule in enumerate(words)], "page_id long, url string")
    rules = spark.createDataFrame(list(queries.URL_RULES), "action string, host string, path string")
    assert {r.rule: r.verdict for r in url_cascade.judge_urls(pages, rules).collect()} == words


def test_url_cascade_is_exact_and_equals_the_join(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 37 == 0).alias("listed"))
    cascade = url_cascade.build_cascade(keys)
    assert len(cascade.levels) > 2
    assert keys.where(cascade.holds(F.col("key")) != F.col("listed")).count() == 0
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    rules = spark.createDataFrame(list(queries.URL_RULES), "action string, host string, path string")
    a = url_cascade.judge_urls(pages, rules).collect()
    was, url_cascade.MAX_BITS = url_cascade.MAX_BITS, 1
    try:
        b = url_cascade.judge_urls(pages, rules).collect()
    finally:
        url_cascade.MAX_BITS = was
    assert sorted(map(str, a)) == sorted(map(str, b))


def leak_words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))


@pytest.mark.parametrize("symbols", [50, 1 << 20])
def test_leaks(spark, symbols, monkeypatch):
    monkeypatch.setattr(fm_decontam, "SHARD_WORDS", symbols)
    items = [(1, "Alpha beta gamma-delta " * 5 + "end"), (2, "short one"), (3, ""), (4, None), (5, "short ONE"), (6, "the " * 30)]
    texts = EDGE + ["x short one, y", "alpha beta gamma delta " * 5 + "end of it", "a ü " * 50 + "beta gamma delta " + "alpha beta gamma delta " * 4, "SHORT\none short one", "short short one one"] + texts_of(5, 30)
    found = fm_decontam.find_leaks(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: r for r in found.select("*", fm_decontam.hit_words(F.col("spans")).alias("hit")).collect()}
    windows = defaultdict(set)
    for i, t in items:
        w = leak_words(t)
        k = min(13, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[j : j + k])].add(str(i))
    for i, t in enumerate(texts):
        w, hit, own = leak_words(t), set(), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if x := windows.get(tuple(w[j : j + k])):
                    own |= x
                    hit |= set(range(j, j + k))
        assert (got[i].n_words, got[i].hit, sorted(got[i].items)) == (len(w), len(hit), sorted(own)), t
        for s in got[i].spans:
            assert leak_words((t or "").encode()[s.byte_start : s.byte_end].decode()) == w[s.word_start : s.word_end]


def test_leaks_without_items(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_words for r in fm_decontam.find_leaks(frame(spark, ["a b", None]), none).orderBy("doc_id").collect()] == [2, 0]


def test_blocks_of_phrases_add_up(spark):
    items = spark.createDataFrame([(i, f"w{i} " * 3) for i in range(20)], "item_id long, text string")
    blocks = list(fm_decontam.phrase_blocks(items, block_words=10))
    assert len(blocks) > 1 and sum(len(b.items) for b in blocks) == 20


def test_cleaned_documents(spark):
    passage = " ".join(f"q{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "keep " * 500 + passage + " tail", "en", "s", 1), (2, passage, "en", "s", 1), (3, "clean text", "en", "s", 10), (4, None, "en", "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in fm_decontam.cleaned_documents(docs, spark.createDataFrame([(1, passage)], "item_id long, text string")).collect()}
    assert set(out) == {1, 3, 4} and "q3" not in out[1].text and out[1].text.endswith("tail") and out[1].n_chars == len(out[1].text)
    assert out[3].text == "clean text" and out[4].text is None


def test_cleaned_documents_with_clashing_columns(spark):
    words = " ".join(f"w{i}" for i in range(300))
    passage = " ".join(f"p{i}" for i in range(13))
    rows = [(1, words + " " + passage, 5, "x", 7, [1], 0.5), (2, passage, 5, "x", 7, [1], 0.5), (3, None, None, None, None, None, None), (4, "", 0, "", 0, [], 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string, n_words long, items array<int>, shorter double")
    got = {r.doc_id: r for r in fm_decontam.cleaned_documents(docs, spark.createDataFrame([(1, passage)], "item_id long, text string")).collect()}
    assert sorted(got) == [1, 3, 4] and got[1].text == words + " " and got[1].n_chars == len(words) + 1
    assert (got[1].spans, got[1].n_words, got[1]["items"], got[1].shorter) == ("x", 7, [1], 0.5) and tuple(got[3]) == rows[2] and tuple(got[4]) == rows[3]
    assert fm_decontam.cleaned_documents(docs.limit(0), spark.createDataFrame([(1, passage)], "item_id long, text string")).columns == docs.columns
    assert fm_decontam.find_leaks(docs.limit(0), spark.createDataFrame([(1, passage)], "item_id long, text string")).count() == 0


def test_fitting_takes_one_text_of_an_id(spark):
    texts = [(i, "good words here. " * 20 if i % 2 else "BAD!!! " * 30) for i in range(40)]
    labels = labelled(spark, [(i, i % 2, 1 - i % 2) for i in range(40)])
    once, often = (spark.createDataFrame(rows, "doc_id long, text string") for rows in (texts, texts + texts[:3] * 200 + [(1, "zzz"), (None, "lost")]))
    a, b = (quality_gbdt.fit(d, labels, "quality", F.lit(True)) for d in (once, often))
    assert a.base == b.base and (a.cut == b.cut).all()
    assert quality_gbdt.training_rows(often, labels, "quality", F.lit(True), 100).count() == 40
    assert len(toxicity_knn.fit(often, labels, "toxic", F.lit(True)).ids) == 40
    assert quality_gbdt.score(once.limit(0), a).count() == 0


def test_fm_index_finds_what_a_scan_finds():
    rng = np.random.default_rng(1)
    text = np.concatenate([[0], rng.integers(1, 5, 300), [0], rng.integers(1, 5, 200), np.full(40, 2), [0]])
    index = fm_decontam.FMIndex(text, 5)
    for k in (1, 2, 5):
        phrases = np.unique(rng.integers(1, 5, (30, k)), axis=0)
        lo, hi = index.search(phrases)
        for p, a, b in zip(phrases, lo, hi, strict=True):
            want = [i for i in range(len(text) - k + 1) if (text[i : i + k] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def plain_losses(corpus, words):
    """P(word | word before) of Witten-Bell bigrams, by the definition; None begins a text."""
    follow = defaultdict(Counter)
    for text in corpus:
        row = [None, *(w if w in words else "?" for w in ascii_words(text))]
        for x in zip(row, row[1:]):
            follow[x[0]][x[1]] += 1
    single = sum(follow.values(), Counter())
    total, kinds = sum(single.values()), len(single)
    low = lambda w: (single[w] + kinds / (len(words) + 1)) / (total + kinds) if total else 1 / (len(words) + 1)
    return lambda v, w: (follow[v][w] + len(follow[v]) * low(w)) / (sum(follow[v].values()) + len(follow[v])) if follow[v] else low(w)


def ascii_words(text):
    return [w.decode() for w in re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER).encode())]


@pytest.mark.parametrize("share", [2.0**-18, 0.0008])
def test_language_models(spark, share):
    target, background = texts_of(41, 60, 80, 30) + [None, "ab"], texts_of(41, 90, 80, 40) + EDGE
    texts = background + ["never seen zz top", "Q!é"]
    total = lambda corpus: Counter(w for t in corpus for w in ascii_words(t))
    counts = total(target), total(background)
    words = {w for w in counts[0] if all(c[w] >= max(1, share * sum(c.values())) for c in counts)}
    assert 0 < len(words) < len(counts[0] | counts[1])
    pt, pb = plain_losses(target, words), plain_losses(background, words)
    model = xent_lm.fit(frame(spark, target), frame(spark, background), share=share)
    got = {r.doc_id: r for r in xent_lm.score(frame(spark, texts), model, keep_losses=True).collect()}
    assert len(model.vocabulary) == len(words) and len(got) == len(texts)
    for i, t in enumerate(texts):
        row = [None, *(w if w in words else "?" for w in ascii_words(t))]
        want = [np.log2(pb(*x) / pt(*x)) for x in zip(row, row[1:])]
        assert got[i].n_tokens == len(want) and np.allclose(got[i].losses, want, atol=1e-5)
        assert abs(got[i].loss_difference - (np.mean(want) if want else 0)) < 1e-5


def test_language_models_of_nothing(spark):
    empty = frame(spark, [])
    model = xent_lm.fit(empty, empty)
    assert {r.loss_difference for r in xent_lm.score(frame(spark, ["a b", None]), model).collect()} == {0.0}
    assert xent_lm.score(empty, model).count() == 0
    rows = spark.createDataFrame([("x", "a b a b"), ("x", "a b a b"), (None, "b a")], "doc_id string, text string")
    got = xent_lm.score(rows, xent_lm.fit(rows, empty)).collect()
    assert len(got) == 3 and len({r.loss_difference for r in got if r.doc_id}) == 1


def test_squeezed_numbers():
    rng = np.random.default_rng(6)
    for most in (0, 200, 300, 70_000, 1 << 25, 1 << 40):
        x = rng.integers(0, most + 1, 50).astype(np.uint64)
        assert (xent_lm.unsqueezed(xent_lm.squeezed(x)) == x).all()
        assert (xent_lm.unsqueezed_keys(xent_lm.squeezed_keys(np.sort(x))) == np.sort(x)).all()
    assert len(xent_lm.unsqueezed(xent_lm.squeezed(np.empty(0, np.uint64)))) == 0


def test_tool_calls(spark):
    tools = {"f": {"type": "object", "required": ["x"], "additionalProperties": False, "properties": {"x": {"type": "integer", "minimum": 1}, "k": {"enum": ["a", "b"]}}}}
    calls = [
        (1, "a", 0, "f", '{"x": 1, "k": "b"}', []), (1, "b", 2, "f", '{"k":"a", "x":0}', ["a", "nowhere", "b"]), (1, "c", 4, "g", "{}", ["b", "a"]), (1, "c", 9, "g", "{}", ["b"]),
        (2, "a", 0, "f", "no json", ["b"]), (2, "b", 1, "f", '{"y": 2}', ["a"]), (2, "d", 3, "f", None, None), (None, "z", 0, "f", '{"x": "s"}', []), (1, None, 0, "f", '{"x": 2}', []),
    ]
    results = [(1, "a", 1, "ok"), (1, "a", 3, "later"), (1, "q", 5, "lost"), (2, "d", 4, None), (None, "z", 1, "never")]
    got = tool_chat.link_calls(
        spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string, needs array<string>"), spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string"), tools
    ).collect()
    by = {(r.conv_id, r.call_id): r for r in got if r.status != "orphan_result"}
    assert len(got) == 10 and {(r.conv_id, r.call_id) for r in got if r.status == "orphan_result"} == {(1, "q"), (None, "z")}
    assert [by[1, x].stage for x in "abc"] == [0, 0, 0] and by[2, "a"].stage == by[2, "b"].stage == -1
    assert by[1, "a"].valid and by[1, "a"].json == '{"arguments":{"k":"b","x":1},"call_id":"a","content":"ok","conv_id":"1","name":"f","result_turn":1,"stage":0,"status":"linked","turn":0}'
    assert by[1, "b"].errors == ["$.x: breaks minimum 1"] and by[1, "c"].errors == ["unknown tool"] and by[1, "c"].repeats == 2
    assert by[2, "a"].errors == ["arguments are no JSON"] == by[2, "d"].errors and by[2, "d"].status == "linked" and sorted(by[2, "b"].errors) == ["$: has further properties", "$: lacks x"]
    assert by[None, "z"].status == "no_result" and by[None, "z"].errors == ["$.x: is not integer"]


CALLS, RESULTS = "conv_id long, call_id string, turn long, name string, arguments string, needs array<string>, level long, stage string", "conv_id long, call_id string, turn long, content string, repeats long"


def plain_stages(calls):
    """Stages of {call: (turn, needs)} by the definition; -1 on or above a cycle."""
    known = {c: [d for d in set(needs) if d in calls and d != c] for c, (_, needs) in calls.items()}
    out, active = {}, set()

    def visit(c):
        if c in out:
            return out[c]
        if c in active:
            return None
        active.add(c)
        below = [(visit(d), (calls[d][0], d) > (calls[c][0], c)) for d in known[c]]
        active.discard(c)
        bad = any(x is None or x == -1 for x, _ in below)
        value = -1 if bad else max([x + f for x, f in below], default=0)
        if not bad or not active:
            out[c] = value
        return value if not bad else (-1 if not active else None)

    for c in calls:
        visit(c)
    return out


def test_tool_calls_are_in_topological_order(spark):
    rng, rows, plain = random.Random(31), [], {}
    for conv in range(60):
        n, ahead = rng.randint(1, 12), rng.choice([0, 0.05, 0.3])
        calls = {}
        for i in range(n):
            needs = [f"c{rng.randrange(max(i, 1))}" if rng.random() > ahead else f"c{rng.randrange(n)}" for _ in range(rng.randint(0, 3))]
            calls[f"c{i}"] = (i // 2, needs)
        plain[conv] = plain_stages(calls), calls
        rows += [(conv, c, t, "f", "{}", needs, 7, "x") for c, (t, needs) in calls.items()]
    got = tool_chat.link_calls(spark.createDataFrame(rows, CALLS), spark.createDataFrame([], RESULTS), {"f": {}}).collect()
    assert len(got) == len(rows) and any(r.stage > 0 for r in got) and any(r.stage < 0 for r in got)
    for r in got:
        assert r.stage == plain[r.conv_id][0][r.call_id], (r.conv_id, r.call_id)
    for conv, (_, calls) in plain.items():
        order = sorted((r for r in got if r.conv_id == conv and r.stage >= 0), key=lambda r: (r.stage, r.turn, r.call_id))
        place = {r.call_id: i for i, r in enumerate(order)}
        assert all(place[d] < place[c] for c in place for d in calls[c][1] if d in place and d != c)


def test_tool_calls_of_a_long_conversation(spark):
    calls = [(1, f"c{i}", i, "f", "{}", [f"c{i - 1}", f"c{i - 2}"], 7, "x") for i in range(5000)]
    results = [(1, f"c{i}", i + 1, "ok", 1) for i in range(5000)] * 2
    got = tool_chat.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), {"f": {}})
    assert got.where("stage = 0 and status = 'linked' and valid and result_repeats = 2 and repeats = 1").count() == got.count() == 5000
    assert tool_chat.link_calls(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), {}).count() == 0
    lost = tool_chat.link_calls(spark.createDataFrame([], CALLS), spark.createDataFrame(results, RESULTS), {})
    assert lost.where("status = 'orphan_result' and stage is null").count() == lost.count() == 5000


def test_tool_calls_of_conversations(spark, tmp_path):
    turns = [(1, 0, "system", "rules"), (1, 1, "user", "what"), (1, 2, "assistant", "that"), (1, 3, None, ""), (2, 0, "assistant", "alone"), (2, None, "user", "when"), (None, 1, "user", None), (None, 2, "assistant", "x"), (None, 2, "assistant", "y")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op6_tool_chat(spark, str(tmp_path)).collect()
    by = {(r.conv_id, r.call_id): r for r in got if r.call_id}
    assert len(got) == 8 and sum(r.call_id is None for r in got) == 4  # rows without an identifier stand alone
    assert (by[1, "1-0"].status, by[1, "1-0"].name, by[1, "1-0"].valid) == ("no_result", "configure", True)
    assert (by[1, "1-1"].status, by[1, "1-1"].valid) == ("linked", True) and '"content":"that"' in by[1, "1-1"].json
    assert by[1, "1-3"].errors == ["$.text: breaks minLength 1"] and by[2, "2--1"].status == "orphan_result"


def test_bpe(spark):
    ranks, pattern = queries.tokenizer_file("byte_bpe_50k.tiktoken"), queries.split_pattern()
    texts = EDGE + ["don't  stop\n\n now 123", "<|endoftext|>"] + texts_of(2, 20)
    encoded = bpe_codec.encode_texts(frame(spark, texts), ranks, pattern)
    plain = bpe_codec.load_encoding(ranks, pattern)
    both = lambda df: sorted(map(str, df.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()))
    assert both(bpe_codec.round_trip(frame(spark, texts), ranks, pattern)) == both(bpe_codec.decode_ids(encoded, ranks, pattern))
    for r in bpe_codec.decode_ids(encoded, ranks, pattern).collect():
        ids = plain.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert bytes(r.decoded) == (texts[r.doc_id] or "").encode() and r.decoded_sha256 == hashlib.sha256(r.decoded).hexdigest()
    rng = random.Random(4)
    for _ in range(500):
        t = "".join(rng.choice([" ", "  ", "\n", "a", "'s", "1", "!!", "é", "　", "\x1c", "\x85"]) for _ in range(40))
        assert sum((plain.encode_ordinary(p) for p in bpe_codec.pieces(t, 3)), []) == plain.encode_ordinary(t)


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality(spark):
    rng = random.Random(7)
    good = [" ".join("".join(rng.choice("aeioubcd") for _ in range(rng.randint(2, 7))) for _ in range(60)) + "." for _ in range(200)]
    bad = [" ".join(w.upper() + "!!" for w in t.split()) for t in good[:100]]
    docs = frame(spark, good + bad + EDGE)
    labels = labelled(spark, [(i, int(i < 200), 0) for i in range(300)] + [(1, None, 0), (None, 1, 0)])
    trees = quality_gbdt.fit(docs, labels, "quality", F.col("doc_id") % 3 != 0)
    got = {r.doc_id: r for r in quality_gbdt.score(docs, trees).collect()}
    assert len(got) == 300 + len(EDGE) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert all(got[i].predicted == int(i < 200) for i in range(0, 300, 3))
    assert got[310].score == got[311].score  # equal texts
    kept = quality_gbdt.accepted(docs, trees)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}
    one_class = quality_gbdt.fit(docs, labelled(spark, [(1, 1, 0)]), "quality", F.lit(True))
    assert quality_gbdt.score(docs, one_class).where("predicted <> 1").count() == 0
    none = quality_gbdt.fit(docs, labelled(spark, []), "quality", F.lit(True))
    assert {r.score for r in quality_gbdt.score(docs, none).collect()} == {0.5}
    assert quality_gbdt.score(frame(spark, []), trees).count() == 0


def test_trees_match_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    trees = quality_gbdt.fit_trees(x, (x[:, 0] + x[:, 1] > 0).astype(float), trees=10, depth=3)
    for row, got in zip(x[:50], trees.scores(x[:50]), strict=True):
        raw = trees.base
        for f, c, leaf in zip(trees.feature, trees.cut, trees.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > c[node])
            raw += leaf[node - len(f)]
        assert abs(got - 1 / (1 + np.exp(-raw))) < 1e-12


def links_by_brute_force(texts):
    def words(t):
        return re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))

    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w := words(t)) >= 5 else frozenset([tuple(w)] if w else []) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both, union = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if both and 100 * both >= 80 * union:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("frequent", [2, 8])
def test_similarity_join(spark, frequent, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "SALT_ROWS", 3)
    base = " ".join(f"w{i}" for i in range(120))
    group = [base.replace(f"w{7 * i} ", f"v{i} ") for i in range(1, 16)]  # near copies of one text
    texts = EDGE + texts_of(11, 120) + group + [base, base, "A b C d E"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked_documents(frame(spark, texts)).collect()}
    assert got == links_by_brute_force(texts)


def test_similarity_join_repeated_ids_and_empty(spark):
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "x y z x y z"), (2, "x y z x y z"), (1, "a b c d e f"), (None, "x y z x y z"), (3, None)], "doc_id long, text string")
    got = sorted(map(str, ((r.doc_id, r.component_id) for r in ngram_join.linked_documents(rows).collect())))
    assert got == sorted(map(str, [(1, 1), (1, 1), (2, 1), (1, 1), (None, 1), (3, 3)]))
    assert ngram_join.linked_documents(frame(spark, [])).count() == 0


def test_similarity_join_counts_every_link(spark):
    """Links inside a component too, copies by number, and the pairs of different texts."""
    base = " ".join(f"w{i}" for i in range(120))
    texts = [base] + [base.replace(f"w{7 * i} ", f"v{i} ") for i in range(1, 16)] + [base.replace("w9 ", "x "), base, None, "a b", "a b", "c d"]
    sets = [frozenset(zip(*(w[i:] for i in range(5)))) if len(w := (t or "").split()) > 4 else frozenset([tuple(w)] if w else []) for t in texts]
    alike = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] & sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = Counter(x for p in alike for x in p)
    docs = frame(spark, texts)
    got = {r.doc_id: r.n_links for r in ngram_join.linked_documents(docs).collect()}
    assert got == {i: want[i] for i in range(len(texts))} and max(got.values()) > 10
    first = {s: i for i, s in reversed(list(enumerate(sets)))}
    pairs = {tuple(sorted((first[sets[i]], first[sets[j]]))) for i, j in alike if sets[i] != sets[j]}
    assert sorted(map(tuple, ngram_join.linked_pairs(docs).collect())) == sorted(pairs)


@pytest.mark.parametrize("frequent,salt", [(2, 50), (1 << 40, 4096)])
def test_similarity_join_of_a_large_group(spark, frequent, salt, monkeypatch):
    """2,000 different near copies of a text, some of which link and some not, in several blocks and salted parts."""
    for name, value in (("FREQUENT", frequent), ("SALT_ROWS", salt), ("BLOCK_SETS", 300)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(90)]
    texts = [" ".join(f"x{rng.randrange(10**6)}" if rng.random() < 0.01 * (i % 4) else w for w in base) for i in range(2000)]
    words = [t.split() for t in texts]
    names, rows = {}, []
    for w in words:
        rows.append(sorted({names.setdefault(tuple(w[i : i + 5]), len(names)) for i in range(len(w) - 4)}))
    size = np.array([len(r) for r in rows])
    of = defaultdict(list)
    for i, r in enumerate(rows):
        for x in r:
            of[x].append(i)
    both = np.zeros((len(rows), len(rows)), np.int32)
    for at in of.values():
        if len(at) > 1:
            both[np.ix_(at, at)] += 1
    link = 100 * both >= 80 * (size[:, None] + size - both)
    np.fill_diagonal(link, False)
    label = np.arange(len(rows))
    while True:
        new = np.minimum(label, np.where(link, label, len(rows)).min(axis=1))
        if (new == label).all():
            break
        label = new
    got = {r.doc_id: r for r in ngram_join.linked_documents(frame(spark, texts)).collect()}
    assert [got[i].n_links for i in range(len(rows))] == link.sum(axis=1).tolist() and 0 < link.mean() < 0.9
    assert [got[i].component_id for i in range(len(rows))] == label.tolist()


def test_similarity_join_of_text_ids(spark):
    rows = [("b", "one two three four five six"), ("a", "One two three four five six"), ("c", "x y"), ("c", "one two three four five six"), ("d", "x y"), (None, "x y"), (None, None)] + [(None, "p q r")] * 3
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.n_links) for r in ngram_join.linked_documents(spark.createDataFrame(rows, "doc_id string, text string")).collect())
    want = [("b", 2, "a", 2), ("a", 2, "a", 2), ("c", 1, "a", 2), ("c", 2, "a", 2), ("d", 1, "a", 2), ("None", 1, "a", 2), ("None", 0, "None", 0)] + [("None", 1, "None", 2)] * 3
    assert got == sorted(want)  # the id that has two texts holds them together


def test_sketches_never_differ_more_than_their_sets():
    rng = np.random.default_rng(12)
    sets = [np.unique(rng.integers(0, 2**63, int(n), dtype=np.uint64)) for n in rng.integers(1, 3000, 60)]
    sets += [np.unique(np.concatenate([s[int(rng.integers(0, len(s) // 9 + 1)) :], rng.integers(0, 2**63, len(s) // 20, dtype=np.uint64)])) for s in sets]
    drawn = ngram_join.Sketches([ngram_join.sketch_of(s) for s in sets])
    x, y = np.triu_indices(len(sets), 1)
    near = np.array([max(len(sets[a]), len(sets[b])) < 1.9 * min(len(sets[a]), len(sets[b])) for a, b in zip(x, y)])
    x, y = x[near], y[near]
    real = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(x, y)])
    found = drawn.differences(x, y)
    both = np.array([len(sets[a]) + len(sets[b]) for a, b in zip(x, y)])
    assert (found <= real).all() and (found[real > both / 3] > both[real > both / 3] / 9).mean() > 0.99  # unlike sets of any size are refused


def test_similarity_join_of_few_words(spark):
    """Chunks that hold fewer words than a shingle, down to none."""
    for n in range(7):
        text = " ".join("abcdefg"[:n])
        buf = np.frombuffer(text.encode(), np.uint8)
        assert [len(s) for s in ngram_join.shingle_sets(buf, np.array([0, len(buf)]))] == [max(n - 4, min(n, 1))]
    got = ngram_join.linked_documents(frame(spark, ["a b c"]).coalesce(1)).collect()
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in got] == [(0, 1, 0)]


def test_signatures_cover_every_link():
    """Two sets that link share a signature, whatever shingles are called frequent."""
    rng = np.random.default_rng(5)
    for trial in range(300):
        n = int(rng.integers(2, 300))
        universe = np.unique(rng.integers(0, 2**63, 2 * n, dtype=np.uint64))
        a = rng.choice(universe, min(n, len(universe)), replace=False)
        b = np.concatenate([a[int(rng.integers(0, max(1, n // 6))) :], rng.integers(0, 2**63, int(rng.integers(0, max(1, n // 8))), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if not both or 100 * both < 80 * (len(a) + len(b) - both) or (len(a) == len(b) == both):
            continue
        frequent = np.sort(rng.choice(universe, int(len(universe) * rng.random()), replace=False))
        signer = ngram_join.Signer(frequent, rng.integers(1, 50, len(frequent)))
        assert np.intersect1d(signer(a)[0], signer(b)[0]).size, trial


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(400, i) for i in range(401, 460)] + [(5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_toxicity(spark):
    rng = random.Random(9)
    plain = ["".join(rng.choice("aeioubcd") for _ in range(rng.randint(3, 7))) for _ in range(300)]
    texts = [" ".join(rng.choice(plain) for _ in range(40)) for _ in range(300)]
    texts = [t + " you zorkish zorky vile fool" if i % 4 == 0 else t for i, t in enumerate(texts)]
    docs = frame(spark, texts + EDGE)
    labels = labelled(spark, [(i, 1, int(i % 4 == 0)) for i in range(300)] + [(2, 1, None), (None, 1, 1)])
    index = toxicity_knn.fit(docs, labels, "toxic", F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r for r in toxicity_knn.score(docs, index).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(0, 300, 5))
    assert all(0 <= r.score <= 1 for r in got.values()) and all(e.label == 1 for e in got[0].evidence)
    assert got[310].score == got[311].score
    kept = toxicity_knn.accepted(docs, index)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    for rows in ([], [(1, 1, 0)]):
        assert {r.score for r in toxicity_knn.score(docs, toxicity_knn.fit(docs, labelled(spark, rows), "toxic", F.lit(True))).collect()} == {0.0}
    assert toxicity_knn.score(frame(spark, []), index).count() == 0


def test_toxicity_indexes_terms_beyond_the_strongest(spark):
    """Toxic words that hundreds of stronger terms outrank still find their neighbours."""
    rng = random.Random(4)
    plain = [f"{rng.choice('bcdfg')}{i:03d}" for i in range(600)]
    texts = [" ".join(plain) if i % 2 else "" for i in range(80)]  # 600 terms that only clean texts have
    texts = [t if i % 2 else "zork fool" if i < 20 else f"vile{i}" for i, t in enumerate(texts)] + ["zork fool"]
    docs = frame(spark, texts)
    labels = labelled(spark, [(i, 1, int(i % 2 == 0)) for i in range(80)])
    index = toxicity_knn.fit(docs, labels, "toxic", F.lit(True))
    got = {r.doc_id: r for r in toxicity_knn.score(docs, index).collect()}
    assert len(index.vocabulary) > 600 and got[80].votes > 0.9 and len(got[80].evidence) == 3


def plain_terms(text):
    words = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.translate(LOWER).encode())
    return Counter([(0, w) for w in words] + [(k, w[:k]) for w in words for k in toxicity_knn.PREFIXES if len(w) > k])


def test_toxicity_equals_plain_cosines(spark):
    """Weights from all documents, exact TF-IDF cosines over every term, neighbours, votes: against plain code, with repeated ids and rows."""
    texts = texts_of(23, 90, 120, 50) + EDGE
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 40 + [(4, "zzz zzz"), (None, "lost"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = labelled(spark, [(i, 1, int(i % 3 == 0)) for i in range(60)] * 2 + [(None, 1, 1)])
    index = toxicity_knn.fit(docs, labels, "toxic", F.lit(True))
    bags = {t: plain_terms(t or "") for _, t in rows}
    df, cf, lengths = Counter(), Counter(), Counter()
    for _, t in rows:
        df.update(bags[t].keys())
        cf.update(bags[t])
        lengths[int(np.floor(4 * np.log2(sum(bags[t].values()) + 1.0)))] += 1
    size = {c: 2 ** ((c + 0.5) / 4) - 1 for c in lengths}
    total = sum(n * size[c] for c, n in lengths.items())
    weight = lambda w: np.log((1 + len(rows)) / df[w]) * (max(np.log(sum(n * (1 - np.exp(-cf[w] * size[c] / total)) for c, n in lengths.items()) / df[w]), 0) + 0.05)
    examples = {i: min(t or "" for d, t in rows if d == i) for i in range(60)}
    known = {w for t in examples.values() for w in plain_terms(t)}
    weights = {w: weight(w) for w in known}

    def vector(t):
        v = {w: (1 + np.log(n)) * weights[w] for w, n in plain_terms(t or "").items() if w in known}
        norm = np.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    assert sorted(index.ids) == list(range(60)) and len(index.vocabulary) == len(known)
    vectors = [vector(examples[i]) for i in index.ids]
    got = toxicity_knn.score(docs, index).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i, t in enumerate(texts):
        q = vector(t)
        cosines = np.array([round(sum(x * v.get(w, 0.0) for w, x in q.items()), 8) for v in vectors])
        best = np.sort(cosines[cosines > 0])[::-1]
        if len(best) < 60 or (cosines == best[-1]).sum() == 1:
            same = [np.sort([c for c, j in zip(cosines, index.ids) if c > 0 and c >= best[-1] and (j % 3 == 0) == bool(x.predicted)])[::-1][:3] for x in by[i]] if len(best) else [[]]
            r = next((x for x, c in zip(by[i], same) if len(c) == len(x.evidence) and np.allclose([e.cosine for e in x.evidence], c, atol=1e-7)), None)
            assert r is not None and all(e.label == int(e.doc_id % 3 == 0) == r.predicted for e in r.evidence), i
            share = sum(cosines[j] ** 2 for j in range(60) if cosines[j] >= best[-1] and index.ids[j] % 3 == 0) / ((best**2).sum() + 0.1) if len(best) else 0
            assert abs(r.votes - share) < 1e-6
    assert len({(r.score, r.votes) for r in by[3]}) == 1 and {r.votes for r in by[None]} >= {0.0}


@pytest.mark.parametrize("head,first", [(9, 2), (200, 1), (1, 30)])
def test_block_max_neighbours_are_exact(head, first, monkeypatch):
    for name, value in (("HEAD", head), ("BLOCK", 4), ("QUERIES", 5), ("FIRST", first)):
        monkeypatch.setattr(toxicity_knn, name, value)
    rng = np.random.default_rng(3)
    times = rng.integers(1, 5, (503, 40)) * (rng.random((503, 40)) < 0.15 * rng.random(40) * 3)
    times[50:60] = times[40]  # ties
    times[70] = 0
    doc, term = np.nonzero(times)
    weight = rng.random(40) ** 3 + 0.05
    index = toxicity_knn.Index(np.arange(40, dtype=np.uint64), weight)
    index.post(doc, term, times[doc, term], (np.arange(503) % 2).astype(float), list(range(503)))
    rows = np.where(times > 0, 1 + np.log(np.maximum(times, 1)), 0) * weight
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
    place = np.array(index.ids)
    q = np.arange(0, 503, 7)
    d, t = np.nonzero(times[q])
    query = index.known(d, t.astype(np.uint64), times[q][d, t], len(q))
    for without in (None, np.argsort(place)[q]):
        ids, sims = index.nearest(query, k=9, without=without)
        dots = np.round(rows[q] @ rows[place].T, 10)
        if without is not None:
            dots[np.arange(len(q)), without] = 0
        for x, i, s in zip(dots, ids, sims, strict=True):
            best = [j for j in np.lexsort((np.arange(503), -x))[:9] if x[j] > 0]
            assert np.allclose(s[: len(best)], x[best], atol=1e-9) and (i[len(best) :] == -1).all()
            assert np.allclose(x[i[: len(best)]], x[best], atol=1e-9) and len(set(i[: len(best)])) == len(best)


def test_beginnings_are_hashed_with_their_words():
    """Each byte of a text is taken once; the hashes are those of the words and of their first bytes."""
    buf, off = text_bytes(pa.array([*EDGE, "Longer words wörter x"] * 2))
    starts, ends, _ = words_of(buf, off, ALNUM_WORD)
    whole, *beginnings = beginning_hashes(buf, starts, ends, (1, 4, 6))
    assert (whole == word_hashes(buf, starts, ends)).all()
    for k, h in zip((1, 4, 6), beginnings, strict=True):
        s = starts[ends - starts > k]
        assert len(s) and (h == word_hashes(buf, s, s + k)).all()
    assert [len(x) for x in beginning_hashes(buf, starts[:0], ends[:0], (4,))] == [0, 0]


@pytest.mark.parametrize("n", [0, 1, 2, 3000])
def test_terms_are_found_by_their_leading_bits(n):
    rng = np.random.default_rng(n)
    top = np.uint64(64 - toxicity_knn.KEY_BITS)
    for shift in (0, 30):  # spread, and so close together that one value of the leading bits has them all
        words = np.unique((rng.integers(0, 1 << 63, n, np.uint64) << np.uint64(1) >> top) >> np.uint64(shift))
        key = np.concatenate([words, words + np.uint64(1), rng.integers(0, 1 << 52, 500, np.uint64), np.array([0, (1 << 52) - 1], np.uint64)])
        place, there = toxicity_knn.places_of(words, toxicity_knn.buckets_of(words), key)
        assert (there == np.isin(key, words)).all() and (words[place[there]] == key[there]).all()


def test_corpus_counts_reach_the_driver_once(spark, monkeypatch):
    """However many tasks count, the driver gets one row for each range of the vocabulary."""
    monkeypatch.setattr(toxicity_knn, "RANGE", 16)
    texts = texts_of(31, 120, 90, 40)
    docs = frame(spark, texts).repartition(12)
    bags = [plain_terms(t) for t in texts]
    buf, off = text_bytes(pa.array(texts))
    vocabulary = np.unique(toxicity_knn.counted(*toxicity_knn.terms_of(buf, off))[1])
    kind, rows = type(docs), []
    monkeypatch.setattr(kind, "toArrow", lambda self, f=kind.toArrow: (rows.append(f(self)), rows[-1])[1])
    df, cf, lengths = toxicity_knn.corpus_counts(docs, vocabulary)
    assert [t.num_rows for t in rows] == [-(-len(vocabulary) // 16) + 1]
    assert sorted(df.tolist()) == sorted(Counter(w for b in bags for w in b).values())
    assert sorted(cf.tolist()) == sorted(sum(bags, Counter()).values()) and lengths.sum() == len(texts)


def test_memory_goes_back_to_the_system():
    held = lambda: int(re.search(r"Pss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read())[1]) >> 10
    before, blocks = held(), [bytearray(5000) for _ in range(20_000)]
    kept = blocks[::1000]  # in the way of a heap that only shrinks from its end
    del blocks
    released()
    assert held() - before < 30 and len(kept) == 20


def test_index_holds_frequencies_of_repeated_terms_only():
    times = np.array([[1, 0, 3], [1, 1, 0], [0, 2, 1], [1, 0, 0]])
    doc, term = np.nonzero(times)
    index = toxicity_knn.Index(np.arange(3, dtype=np.uint64), np.array([1.0, 2.0, 3.0]))
    index.post(doc, term, times[doc, term], np.zeros(4), list(range(4)))
    assert sorted(index.times) == [2, 3] and len(index.example) == 5 and len(index.example_again) == 2
    got = np.zeros((4, 3), int)
    for t in range(3):
        got[index.example[index.start[t] : index.start[t + 1]], t] = 1
        at = slice(index.start_again[t], index.start_again[t + 1])
        got[index.example_again[at], t] = index.times[at]
    assert (got == times[index.ids]).all()


def test_words_stop_at_documents():
    buf, off = np.frombuffer(b"ab cdef", np.uint8), np.array([0, 5, 5, 7])
    assert [x.tolist() for x in words_of(buf, off, ALNUM_WORD)] == [[0, 3, 5], [2, 5, 7], [0, 0, 2]]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "decontamination", "byte_bpe"]
    kept = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, kept, sf)
        out.write.parquet(str(tmp_path / name))
        new = spark.read.parquet(str(tmp_path / name))
        assert new.columns == docs.columns and new.count() <= kept.count()
        if name == "near_duplicates":
            want = links_by_brute_force([r.text for r in kept.orderBy("doc_id").collect()])
            ids = [r.doc_id for r in kept.orderBy("doc_id").collect()]
            assert sorted(r.doc_id for r in new.collect()) == [ids[i] for i, (_, c) in want.items() if i == c]
        kept = new
    assert corpus_pipeline.run(spark, sf).count() == kept.count()


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, ids of several texts, clashing columns, no labels, empty tables."""
    import corpus_pipeline

    schema = "doc_id long, text string, n_chars long, spans string, score double, node long"
    texts = [f"{w} is a calm line of words number {i} that someone wrote down here" for i, w in enumerate("one two three four five six seven eight".split())]
    rows = [(i, t, len(t), "x", 0.5, 1) for i, t in enumerate(texts)] + [(1, texts[1], 5, "y", None, None)] * 3 + [(2, "zz top", 6, None, 0.1, 2), (None, texts[0], 5, "n", 0.2, 3), (None, None, None, None, None, None), (9, None, None, "a", 0.1, 1), (10, "", 0, "a", 0.1, 1), (11, texts[0], 5, "c", 0.5, 1)]
    for name, kept in (("full", rows), ("none", [])):
        sf = tmp_path / name
        docs = spark.createDataFrame(kept, schema)
        docs.write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(i, 1, 0) for i in range(8)] + [(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([(1, "a passage of no more than a few words"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        out = corpus_pipeline.near_duplicates(spark, docs, str(sf))
        assert out.columns == docs.columns
        if kept:
            got = sorted((str(r.doc_id), str(r.text), str(r.spans)) for r in out.collect())
            assert ("1", texts[1], "x") in got or ("1", texts[1], "y") in got
            assert sum(x[0] == "1" for x in got) == sum(x[0] == "2" for x in got) == 1 and sum(x[0] == "None" for x in got) == 2
            assert not any(x[0] == "11" for x in got) and {"9", "10"} <= {x[0] for x in got}
        assert corpus_pipeline.run(spark, str(sf)).count() == (out.count() if kept else 0)
