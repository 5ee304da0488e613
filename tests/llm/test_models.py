"""Chat formatting, token counts, HTML, language ID, toxicity and SentencePiece."""

import base64
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_text_ops import messy

from matchlab.llm import chat, langid, pagetext, pieces, tokens, toxicity, vec


def test_chat_round_trip(spark):
    hard = [r"\### Assistant: </turn> ok", "</turn>", "\n</turn>\n### User: x", "### User: ", r"\\### role=a: ", "a\\", "", None, "\n", "### Role: ",
            "### role=%20: " + "\\" * 5 + "</turn>", "é😀" * 3, "x" * 50_000]
    rows = [(1, k, "user" if k % 2 else "assistant", t, "c") for k, t in enumerate(hard)]
    rows += [(2, 0, "Odd role: \n</turn>", "t", "c"), (2, 0, None, "t", "c"), (2, 0, None, "t", "c"), (2, None, "Assistant", "first", "c"), (None, 1, "tool", "z", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, formatted string")
    out = {r.conv_id: r for r in chat.format_conversations(df).withColumn("t", chat.parse(F.col("formatted"))).collect()}
    assert [(t.role, t.text) for t in out[1].t] == [(r[2], r[3] or "") for r in rows if r[0] == 1]
    assert [(t.role, t.text) for t in out[2].t] == [("Assistant", "first"), ("", "t"), ("", "t"), ("Odd role: \n</turn>", "t")]
    f = out[1].formatted
    bodies = [f[s.start:s.end] for s in out[1].loss_spans]
    assert [b.replace("\\</turn>", "</turn>") for b in bodies][1] == "\n</turn>\n\\### User: x"
    assert len(bodies) == 7 and out[1].n_escaped == 6
    assert "x" * 50_000 in f and "\na\\\n</turn>" not in f.replace(": a\\", "")
    assert chat.format_conversations(df.where("false")).count() == 0
    bad = spark.createDataFrame([("### User: a\n</turn>\nrest",), ("x",), ("### User: a",), ("",)], "f string")
    assert [r.t for r in bad.select(chat.parse(F.col("f")).alias("t")).collect()] == [None, None, None, []]


def test_token_counts_at_block_edges(spark, tmp_path):
    docs, texts = messy(spark, [(300 + k, "tok " * k) for k in range(30)])
    import tiktoken
    table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(tokens.RANKS, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=table, special_tokens={})
    want = sorted(((i, len(enc.encode_ordinary(t or ""))) for i, t in texts), key=str)
    for size in (6, 1000, 1 << 20):
        got = tokens.document_token_counts(docs, block_bytes=size)
        assert sorted(((r.doc_id, r.n_tokens) for r in got.collect()), key=str) == want
    rng = np.random.default_rng(0)
    for k in range(4):  # files made elsewhere, some without a last separator, one empty
        a = rng.choice([1, 2, 7], rng.integers(0, 60)).astype("<u4") if k else np.zeros(0, "<u4")
        (tmp_path / f"f{k}.bin").write_bytes(a.tobytes())
    for size in (4, 12, 4096):
        got = {}
        for r in tokens.count_tokens(spark, f"file://{tmp_path}", eod=7, width=4, block_bytes=size).collect():
            got.setdefault(r.path[-6:], []).append((r.doc_no, r.start, r.n_tokens, r.ended))
        for k in range(4):
            a = np.frombuffer((tmp_path / f"f{k}.bin").read_bytes(), "<u4")
            want, start = [], 0
            for at in np.flatnonzero(a == 7):
                want.append((len(want), start, at - start, True))
                start = at + 1
            if start < len(a):
                want.append((len(want), start, len(a) - start, False))
            assert sorted(got.get(f"f{k}.bin", [])) == want
    assert tokens.document_token_counts(docs.where("false")).count() == 0


def test_token_counts_of_inputs_in_any_order(spark):
    """Shuffled, de-duplicated, filtered and re-dealt inputs: every count meets its own id."""
    rng = np.random.default_rng(1)
    rows = [(int(k), "tok " * int(rng.integers(0, 40)) + "x" * int(k % 7)) for k in range(600)]
    rows += rows[:50]
    import tiktoken
    table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(tokens.RANKS, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=table, special_tokens={})
    n = {i: len(enc.encode_ordinary(t)) for i, t in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.files.maxRecordsPerFile")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "2")
    try:
        for df in (docs.repartition(7), docs.dropDuplicates(["doc_id"]), docs.where("doc_id % 3 = 1").repartition(5, "text"), docs.orderBy(F.rand()),
                   docs.withColumn("doc_id", F.col("doc_id").cast("string")).coalesce(1)):
            got = tokens.document_token_counts(df, block_bytes=64).collect()
            assert sorted((int(r.doc_id), r.n_tokens) for r in got) == sorted((int(r.doc_id), n[int(r.doc_id)]) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxRecordsPerFile", before)


PAGE = """<html><body><!-- x --><div class="menu"><a>Home</a></div><div>Our site name</div>
<p>{a}</p><p>{b} &amp; more<br>text</p><div id="sidebar"><p>side</p></div><p class=notice>We use<p>{c}
<section class="comments"><article><p>first!</p></article></section><form><p>Mail</p></form><div>All rights kept</div><script>var x="</p>"</script></body></html>"""


def test_differencing_deletes_shared_lines(spark):
    rows = [(k, f"http://h.example/{s}/{k}?q=1#f", PAGE.format(a=f"alpha {k}", b=f"beta {k}", c=f"gamma {k}")) for s in ("x", "y") for k in range(3 if s == "x" else 0, 6 if s == "x" else 3)]
    rows += [(10, "http://one.example/a", PAGE.format(a="a", b="b", c="c")), (11, None, "<p>t</p>"), (12, "http://h.example/z", None), (13, "nonsense", ""),
             (14, "http://m.example/1", "<nav>N</nav><article><h1>T</h1><p>shared</p><aside>no</aside></article><footer>F</footer>"),
             (15, "http://m.example/2", "<nav>N</nav><article><h1>U</h1><p>shared</p></article><footer>F</footer>"),
             (15, "http://m.example/2", "<nav>N</nav><article><h1>U</h1><p>shared</p></article><footer>F</footer>")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, lines string, _key int")
    got = {r.page_id: r.text for r in pagetext.main_text(df).collect()}
    assert pagetext.main_text(df).count() == len(rows)
    for k in range(6):
        assert got[k] == f"alpha {k}\nbeta {k} & more text\ngamma {k}"
    assert got[10] == "Our site name\na\nb & more text\nc\nAll rights kept"  # no neighbour: markup only
    assert got[11] == "t" and got[12] == "" and got[13] == ""
    assert got[14] == "T\nshared" and got[15] == "U\nshared"
    assert pagetext.main_text(df.where("false")).count() == 0


def main_texts(spark, pages):
    df = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pagetext.main_text(df).collect()}
    return [got[k] for k in range(len(pages))]


def test_difference_decides_on_marked_pages(spark):
    page = "<div>Site</div><div><p>body {0} one</p><p>body {0} two</p></div><article><p>teaser</p></article><div>Imprint</div>"
    got = main_texts(spark, [(f"http://a.example/{k}", page.format(k)) for k in range(3)])
    assert got == [f"body {k} one\nbody {k} two\nteaser" for k in range(3)]


def test_near_copies_are_not_compared(spark):
    page = "<div>Site name</div><p>first paragraph of {0} story</p><p>second paragraph of {0} story</p><p>{1}</p><div>Imprint</div>"

    def text(k, day):
        return f"first paragraph of {k} story\nsecond paragraph of {k} story\n{day}"
    # groups of near copies, one exact copy, single pages; a host with copies alone; a host with a long template
    pages = [(f"http://a.example/{g}/{k:02}", page.format(f"{g}{g}{g}", f"day {g}{min(k, 10)}")) for g, n in zip("pqrs", (12, 1, 2, 1)) for k in range(n)]
    want = [text(g * 3, f"day {g}{min(k, 10)}") for g, n in zip("pqrs", (12, 1, 2, 1)) for k in range(n)]
    pages += [(f"http://b.example/{k}", page.format("only", f"{k}")) for k in range(3)]
    want += [f"Site name\n{text('only', k)}\nImprint" for k in range(3)]
    menu = "".join(f"<div>entry {k} of the menu</div>" for k in range(10))
    pages += [(f"http://c.example/{k}", f"{menu}<p>what page {k} says of matter {k}, in {k} lines</p>") for k in range(4)]
    want += [f"what page {k} says of matter {k}, in {k} lines" for k in range(4)]
    assert main_texts(spark, pages) == want
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")  # rows of copies that cross ranges
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert main_texts(spark, pages) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_names_of_articles_and_wrapping_forms():
    def kept(html):
        lines, zones = pagetext.page_lines(html)
        return [t for t, z in zip(lines, zones) if z != pagetext.OUT]
    body = "<p>one</p><p>two</p>"
    for html in (f'<article class="post category-social">{body}</article>', f'<main class="sidebar-right">{body}</main>',
                 f'<html class="cookie-consent"><body>{body}</body></html>', f'<div role="main" class="widget">{body}</div>',
                 f'<form id="f"><nav>n</nav><label>Mail</label><article>{body}</article><button>Go</button></form><p></p>',
                 f'<body><form action="/x"><div>{body}</div><label>Mail</label><input></form></body>',
                 f'<article class="share"><section>{body}</section></article>',
                 f'{body}<form><p>Mail</p></form>', f'<article>{body}<form><p>Mail</p></form></article>',
                 f'{body}<article class="comment"><p>first!</p></article>', f'{body}<article class="ad"><p>buy</p></article>',
                 f'{body}<div class="comments"><article><p>first!</p></article></div>', f'{body}<form class="comment-form"><main>x</main></form>'):
        assert kept(html) == ["one", "two"], html


def test_common_is_a_longest_common_subsequence():
    rng = random.Random(0)
    for _ in range(500):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(9))] for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        c = pagetext.common(a, b)
        rest = iter(b)
        assert c.sum() == table[-1][-1] and all(any(x == y for y in rest) for x, k in zip(a, c) if k)


def labelled(spark, n=400):
    rng = random.Random(6)
    voc = {"en": ["the", "thing", "other", "which", "ought"], "de": ["der", "nicht", "schön", "zwei", "über"], "fr": ["le", "être", "quoi", "eaux", "ça"]}
    rows = []
    for k in range(n):
        lang = rng.choice(sorted(voc))
        t = [rng.choice(voc[lang]) for _ in range(rng.randrange(1, 60))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            t.insert(rng.randrange(len(t) + 1), rng.choice(["idiot", "moron"]))
        rows.append((k, " ".join(t).capitalize(), lang if k % 9 else None, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int"), rows


def test_language_id_on_held_out_rows(spark):
    df, rows = labelled(spark)
    f = langid.learn(df.where(~langid.held_out(F.col("doc_id"))).select("doc_id", "lang", "text"))
    assert f.langs == ["de", "en", "fr"]
    got = {r.doc_id: r for r in langid.predict(df, f).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2 and r[2]]
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    docs, texts = messy(spark, [(50, "123 !?"), (51, "漢字"), (52, "٣٤"), (53, "×÷")])
    odd = {(r.doc_id): r for r in langid.predict(docs, f).collect()}
    assert [odd[k].lang_pred for k in (0, 1, 2, 50, 52, 53)] == ["und"] * 6 and odd[51].lang_pred != "und"
    none = langid.learn(df.where("false").select("doc_id", "lang", "text"))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {3, 4, 5, 6, 7, 8, 9, 51, None}
    assert langid.predict(docs.where("false"), f).count() == 0


def test_texts_of_no_learned_language_go(spark):
    df, rows = labelled(spark)
    out = next(k for k in range(1000, 2000) if zlib.crc32(str(k).encode()) % 4 == 2)  # an id that isn't learned from
    docs = df.drop("toxic").unionByName(spark.createDataFrame([(out, "漢字仮名交文", "en")], "doc_id long, text string, lang string"))
    assert {r.doc_id for r in langid.keep_known(docs).collect()} == {r[0] for r in rows}


def test_language_bits_equal_sets():
    a, b = (np.arange(k, 4000, 7, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for k in (1, 2))
    f = langid.Filters(["a", "b"], [a, b])
    one = f.slices[f.place(a, 0)] & f.slices[f.place(a, 1)]
    assert (one & 1).all() and (one >> 1 & 1).mean() < 0.05


def test_toxicity_on_held_out_rows(spark):
    df, rows = labelled(spark, 900)
    m = toxicity.learn(toxicity.training_rows(df.select("doc_id", "text"), df.select("doc_id", "toxic")))
    got = {r.doc_id: r.score for r in toxicity.score(df, m).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum((got[r[0]] >= 0.5) == bool(r[3]) for r in held) >= 0.97 * len(held)
    docs, _ = messy(spark)
    s = [r.score for r in toxicity.score(docs, m).collect()]
    assert len(s) == 12 and all(0 <= x <= 1 for x in s)
    one = toxicity.learn(df.where("toxic = 1").select("doc_id", "text", F.col("toxic").alias("label")))
    assert {r.score > 0.99 for r in toxicity.score(docs, one).collect()} == {True}
    none = toxicity.learn(df.where("false").select("doc_id", "text", F.col("toxic").alias("label")))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}


def test_slope_and_shift_of_folds(spark):
    rng = np.random.default_rng(3)
    true = rng.normal(-1, 2, 4000)
    label = (rng.random(4000) < 1 / (1 + np.exp(-true))).astype(float)
    a, b = toxicity.slope_and_shift((true + 1) / 2, label)  # shrunk and shifted log-odds come back
    assert abs(a - 2) < 0.2 and abs(b + 1) < 0.2
    assert toxicity.slope_and_shift(np.array([-1.0, 1.0]), np.array([0.0, 1.0]))[0] < 10  # separable rows stay finite
    assert toxicity.slope_and_shift(-true, label) == (1.0, 0.0)
    # each fold is scored by a fit of the other: the same weights as of these rows alone
    first, f = np.arange(0, 81, 2), rng.integers(0, 6, 80)
    y, fold, scale = (rng.random(40) < 0.5).astype(float), np.arange(40) % 2, rng.normal(0, 1, 6)
    z = toxicity.out_of_fold(y, fold, first, f, scale, 1.0)
    for k in (0, 1):
        rest = np.flatnonzero(fold != k)
        w, b = toxicity.fit_logistic(y[rest], np.arange(0, 41, 2), np.concatenate([f[2 * i:2 * i + 2] for i in rest]), scale, 1.0)
        for i in np.flatnonzero(fold == k):
            assert abs(z[i] - (sum(w[j] * scale[j] for j in f[2 * i:2 * i + 2]) + b)) < 1e-9
    assert toxicity.out_of_fold(np.ones(40), fold, first, f, scale, 1.0) is None


def test_fit_equals_a_dense_fit():
    """Newton steps on the dense matrix of scaled features reach the same weights."""
    rng = np.random.default_rng(4)
    n, m = 60, 5
    has = rng.random((n, m)) < 0.4
    y = (rng.random(n) < 1 / (1 + np.exp(-(has @ rng.normal(0, 2, m))))).astype(float)
    scale = rng.normal(0, 1, m)
    w, b = toxicity.fit_logistic(y, np.append(0, np.cumsum(has.sum(1))), np.nonzero(has)[1], scale, 1.0, rounds=20_000)
    x = np.hstack([has * scale, np.ones((n, 1))])
    ridge, t = np.diag([1.0] * m + [0.0]), np.zeros(m + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ t))
        t -= np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge, x.T @ (p - y) + ridge @ t)
    assert np.abs(np.append(w, b) - t).max() < 1e-4


def test_toxicity_counts_equal_sets():
    """Features of a chunk against sets of n-grams of each text."""
    texts = ["", None, "abc", "Hello  hello\thello", "a" * 40, "straße straße", "hello"]
    buf, offs = vec.text_buffer(pa.array(texts))
    doc, f = toxicity.present(buf, offs, None)
    got = [sum(doc == k) for k in range(len(texts))]

    def grams(t):
        raw = (t or "").encode().lower()
        for c in b"\t\n\x0b\x0c\r":
            raw = raw.replace(bytes([c]), b" ")
        raw = b" " + raw + b" "
        return {raw[i:i + k] for k in toxicity.SIZES for i in range(len(raw) - k + 1)}
    assert got == [len(grams(t)) for t in texts]


TEXTS = ["", " ", "  a  b ", "x▁y", "😀é́ ﬁ\n\n\t", "a" * 100 + " " + "xy" * 60, "▁", "   ", "hello world, hello worlds; Straße über",
         "the quick brown fox jumps over the lazy dog " * 4]


def test_pieces_equal_the_library_without_dropout():
    import sentencepiece

    p = pieces.Pieces()
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    buf, offs = vec.text_buffer(pa.array(TEXTS))
    ids, at, _, _ = pieces.encode(p, buf, offs, 1, 0.0, 4)
    for k, t in enumerate(TEXTS):
        if "▁" not in t:
            assert sp.encode(t) == ids[at[k]:at[k + 1]].tolist(), t


def test_dropout_varies_and_decodes(spark, monkeypatch):
    p = pieces.Pieces()
    buf, offs = vec.text_buffer(pa.array(TEXTS))
    seen = set()
    for seed in range(5):
        ids, at, text, to = pieces.encode(p, buf, offs, seed, 0.3, 4)
        back, bo = pieces.decode(p, ids, at)
        assert pieces.same_docs(back, bo, text, to).all()
        seen.add(tuple(ids[at[-2]:].tolist()))
        with monkeypatch.context() as m:  # an agenda for each word gives the same
            m.setattr(pieces, "LONG", 0)
            assert np.array_equal(ids, pieces.encode(p, buf, offs, seed, 0.3, 4)[0])
    assert len(seen) == 5
    docs, texts = messy(spark, list(enumerate(TEXTS, 100)))
    out = pieces.encode_texts(docs)
    back = pieces.decode_pieces(out)
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == sorted(((i, t or "") for i, t in texts), key=str)
    a, b = (sorted(map(str, pieces.encode_texts(docs).collect())) for _ in range(2))
    assert a == b
    assert pieces.encode_texts(docs.where("false")).count() == 0


def test_each_occurrence_is_cut_on_its_own():
    p = pieces.Pieces()
    word = "internationalization"
    buf, offs = vec.text_buffer(pa.array([" ".join([word] * 400), " ".join([word] * 400) + " x"]))
    ids, at, _, _ = pieces.encode(p, buf, offs, 1, 0.3)
    ends = np.cumsum(p.raw_len[ids[:at[1]]])
    cuts = np.flatnonzero(ends % (len(word) + 1) == 0) + 1
    ways = {tuple(x.tolist()) for x in np.split(ids[:at[1]], cuts[:-1])}
    assert len(cuts) == 400 and len(ways) > 20  # a cap of 4 a word before
    a, b = ids[:at[1]], ids[at[1]:at[2]]
    assert not np.array_equal(a[:100], b[:100])  # another text, other skips
    # each merge is skipped at the rate: with one possible merge, a share of the occurrences stays apart
    buf, offs = vec.text_buffer(pa.array([" ".join(["a"] * 4000)]))
    n = len(pieces.encode(p, buf, offs, 1, 0.1)[0])
    assert 4300 < n < 4500


def test_words_match_the_patterns():
    rng = random.Random(1)
    alphabet = "aZ09 _-\t\n\x0b\x0c\r\x1c\x85\xa0é漢😀/:`{~\x7f"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(300)]
    buf, offs = vec.text_buffer(pa.array(texts))
    for table, pattern in ((vec.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (vec.NOT_SPACE, r"[^\x20\x09-\x0D]+")):
        low = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in texts]
        s, e, wo = vec.word_spans(vec.LOWER[buf], offs, table)
        got = [[vec.LOWER[buf][x:y].tobytes().decode() for x, y in zip(s[a:b], e[a:b])] for a, b in zip(wo[:-1], wo[1:])]
        assert got == [re.findall(pattern, t) for t in low]
