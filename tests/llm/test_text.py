import html
import os
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from halfstep.llm import html_text as H
from halfstep.llm.bpe import Bpe, digests, with_ids
from halfstep.llm.langid import Parser, held_out, identify, sample, suffix_automaton
from halfstep.llm.token_counts import TokenCounter, count_tokens

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "<|endoftext|>a <|startoftext|>ΑΣ Σ İstanbul ﬁ ½ ²3 \x1c\x1d\x85　é é it's IT'S don't we'LL",
    " \n\n  a\n  b\t\t", "x" * 3000 + "é" * 300, "", None, "日本語テキスト 🙂🙂 👨‍👩‍👧", "a<|endoftext|><|endoftext|>b", "1234 ٣٤ Ⅷ", "\x00\x01",
    "".join(map(chr, range(0x250, 0x3000, 7))), " ".join(map(chr, range(0x20, 0x2FFF))),
]


@pytest.fixture(scope="module")
def odd(spark, docs):
    rows = [(1000 + k, t, None, None, None) for k, t in enumerate(ODD)]
    return docs.union(spark.createDataFrame(rows, docs.schema))


def test_ids_and_decoded_text_equal_the_library(odd, empty, clashing):
    t = Tokenizer.from_file(WORD)
    assert with_ids(odd.select("doc_id", "text"), WORD).filter("doc_id is null").count() == odd.filter("doc_id is null").count() > 0
    for r in with_ids(odd.select("doc_id", "text", F.col("text").alias("given")), WORD).collect():
        want = t.encode(r["given"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == t.decode(want, skip_special_tokens=False)
    assert digests(with_ids(empty, WORD)).count() == 0 and digests(with_ids(clashing, WORD)).count() == clashing.count()


def test_short_and_long_words_merge_alike():
    b = Bpe(open(WORD, encoding="utf-8").read())
    r = np.random.default_rng(0)
    for n in [*r.integers(1, 60, 300), 127, 128, 129, 400, 3000]:
        w = "".join(r.choice(list("aeinrsthgl"), n))
        parts = [b.inner[x] for x in w[:-1].encode()] + [b.last[ord(w[-1])]]
        assert b.merged(list(parts)) == b.merged_long(list(parts))


def code_points(before: str, after: str) -> list[str]:
    """Texts with every code point from U+0080 on, a few hundred to a text, each between the same characters."""
    every = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x32000 or c % 97 == 0 or 0xE0000 <= c < 0xE0200)]
    return ["".join(before + c + after for c in every[k : k + 500]) for k in range(0, len(every), 500)]


def fuzzed(seed: int, count: int = 3000) -> list[str]:
    r = np.random.default_rng(seed)
    pool = [*" \n\t'", *"abzAZ09.,!'sSt", *"éßİ²½ﬁ", *map(chr, r.integers(0x2E0, 0x3400, 150)), *map(chr, r.integers(0xA000, 0xABFF, 60)), *map(chr, r.integers(0x10000, 0x1FAFF, 60)), "<|endoftext|>", "'ll"]
    return ["".join(pool[k] for k in r.integers(0, len(pool), r.integers(1, 12))) for _ in range(count)]


def test_ids_of_every_code_point_and_of_fuzzed_texts():
    b, t = Bpe(open(WORD, encoding="utf-8").read()), Tokenizer.from_file(WORD)
    texts = [*code_points("a", "'s "), *code_points(" ", ""), *fuzzed(1), "a\u0558"]
    for text, e in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(b.encode(text), np.int32).tolist() == e.ids, ascii(text[:80])


def test_counts_of_every_code_point_and_of_fuzzed_texts(monkeypatch):
    file, t = open(BYTE, encoding="utf-8").read(), Tokenizer.from_file(BYTE)
    c = TokenCounter(file, "the\0 a", bytes([1, 1]))
    texts = [*code_points("a", "'s "), *code_points(" ", ""), *fuzzed(2), "\ua7d2's"]
    want = [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [c.count(x) for x in texts] == want
    monkeypatch.setattr("halfstep.llm.token_counts.CACHE", 2000)  # a cache that is emptied, or passed by, all the time
    assert [TokenCounter(file, "", b"").count(x) for x in texts[-40:]] == want[-40:]
    assert [c.count(x) for x in texts[-400:]] == want[-400:]


def test_token_counts_equal_the_library(odd, empty, clashing):
    t = Tokenizer.from_file(BYTE)
    want = [(r["doc_id"], len((r["text"] or "").encode()), len(t.encode(r["text"] or "", add_special_tokens=False).ids)) for r in odd.collect()]
    assert sorted(map(str, map(tuple, count_tokens(odd, BYTE).collect()))) == sorted(map(str, want))
    assert count_tokens(empty, BYTE).count() == 0 and count_tokens(clashing, BYTE).count() == clashing.count()


def phrases(text: str, known: str) -> int:
    """Greedy longest phrases of text that occur in known, by search."""
    k = count = 0
    while k < len(text):
        n = 1
        while k + n < len(text) and text[k : k + n + 1] in known:
            n += 1
        k, count = k + n, count + 1
    return count


def test_phrases_by_search():
    known = {"a": "the cat sat on the mat and the hat", "b": "le chat est sur la table et le tapis"}
    p = Parser(known)
    for text in ("the cat on the table", "zzz the", "le tapis", "q", "tttthe hhat"):
        codes, lengths = p.normalised(text)
        got = p.phrases(codes, lengths)[0].tolist()
        letters = {c for t in known.values() for c in t}
        seen = "".join(c if c in letters else "~" for c in text)
        assert got == [phrases(seen, known["a"]), phrases(seen, known["b"])]


def test_automaton_reads_all_substrings():
    text = [1, 2, 1, 1, 2, 2, 1, 3]
    step = suffix_automaton(text)

    def read(s):
        at = 0
        for c in s:
            at = step[at].get(c)
            if at is None:
                return False
        return True

    every = {tuple(text[i:j]) for i in range(8) for j in range(i, 9)}
    assert all(map(read, every)) and not read((3, 1)) and not read((1, 1, 1))


def test_languages(spark, docs, empty, clashing):
    texts = sample(docs)
    assert sorted(texts) == ["en", "fr"]
    rows = {r["doc_id"]: r for r in identify(docs, texts).collect()}
    assert all(rows[k]["lang_pred"] == "und" and rows[k]["score"] == 0 for k in (1, 2, 3, 4))
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert rows[302]["lang_pred"] in ("en", "fr")
    other = identify(clashing, texts)
    assert other.columns[-4:] == ["lang_pred", "score", "phrases", "letters"] and other.count() == docs.count()
    assert sample(empty) == {} and identify(empty, {}).count() == 0
    assert {r["lang_pred"] for r in identify(docs, {}).collect()} == {"und"}
    held = {r["doc_id"]: r["h"] for r in docs.select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()}
    assert all(h == (d is not None and zlib.crc32(str(d).encode()) % 4 == 2) for d, h in held.items())


def test_held_out_accuracy(spark):
    """On labelled documents that the sample can't hold."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = identify(d.withColumn("h", held_out(F.col("doc_id"))).filter("h"), sample(d)).filter("lang is not null")
    assert found.filter("lang = lang_pred").count() >= 0.97 * found.count() > 0


def by_search(text: str, known: dict[str, str]) -> tuple[str, float, int, int]:
    """Language, score, phrases in it and characters read, by normalising and searching alone."""
    def plain(t):
        return "".join(c.lower() if c.isalpha() else "\n" for c in t)

    tidy = lambda t: re.sub("\n+", " ", plain(t))
    t = tidy(text).lstrip(" ")  # white space before the first letter isn't read; after the last one it is
    if not t.strip():
        return "und", 0.0, 0, 0
    have = {lang: tidy(x) for lang, x in known.items()}
    letters = {c for x in have.values() for c in x} | {" "}
    t = "".join(c if c in letters else "\0" for c in t)
    cost = sorted((phrases(t, x) * np.log2(max(4096, len(known[lang]))), lang) for lang, x in have.items())
    return cost[0][1], 1 - cost[0][0] / cost[1][0], phrases(t, have[cost[0][1]]), len(t)


def test_languages_and_scores_by_search(spark):
    """The query's columns against searching, with texts of many blocks, of more than LETTERS letters, and alike."""
    r = np.random.default_rng(11)
    scripts = {"a": "abcdefghijklmno ", "b": "cdefghijklmnopqrs ", "c": "".join(map(chr, range(0x4E00, 0x4E00 + 400)))}
    odds = lambda n: (lambda w: w / w.sum())(1 / np.arange(1, n + 1))
    some = lambda lang, n: "".join(r.choice(list(scripts[lang]), n, p=odds(len(scripts[lang]))))
    rows = [(4 * k + j, some(lang, int(r.integers(50, 700))), lang) for j, lang in enumerate("abc") for k in range(12)]
    rows += [(900 + k, t, None) for k, t in enumerate([some("a", 9000), some("b", 6500), rows[0][1] * 9, "x" * 5000, "abc " * 2000, some("c", 5000), "12 ?", "", None, "Abc, DEF! ghi", some("a", 40) + some("b", 40)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    known = sample(docs)
    assert sorted(known) == ["a", "b", "c"]
    for row in identify(docs, known).collect():
        lang, score, count, read = by_search(row["text"] or "", known)
        assert (row["lang_pred"], round(row["score"], 9)) == (lang, round(score, 9)), row["doc_id"]
        assert lang == "und" or (row["phrases"], row["letters"]) == (count, read)


def test_no_label_is_starved_by_repeated_rows(spark):
    rows = [(k, "one text that very many rows repeat", "en") for k in range(3000)] + [(5000 + k, f"un autre texte numéro {chr(97 + k % 26)}{chr(97 + k // 26 % 26)}", "fr") for k in range(600)]
    rows += [*((9200 + k, "lang " * 30_000, "xx") for k in range(9)), *((9100 + k, "kurz", "yy") for k in range(9)), *((9300 + k, "long " * 2_000, "zz") for k in range(9))]
    known = sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(known) == ["en", "fr", "xx", "yy", "zz"] and known["xx"] == ("lang " * 30_000)[:24_576] and known["en"].count("repeat") == 1 and known["zz"] == "long " * 2_000
    assert known["fr"].count("autre") == 48


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><!-- ad --><div class="ad">Buy this great thing now.</div>
<article><h1>A &amp; B</h1><p><b>Opening words here.<br><p>One   long
sentence &eacute; of text, with <i>inline</i> marks.</p><p>And another one.</p></article>
<section class="comments"><h3>Comments</h3><p class="comment">I liked this text very much.</p></section>
<form><label>Email</label><button>Send</button></form><footer>&copy; 2024 Example</footer></body></html>"""


def test_main_text_of_a_page():
    model = H.trained()
    assert H.main_texts(model, [PAGE, None, "", "<script>x</script>"]) == ["A & B\nOpening words here.\nOne long sentence é of text, with inline marks.\nAnd another one.", "", "", ""]


def test_labels_of_pages_made_by_other_seeds():
    test = H.made_pages(80, 4321)
    odds = H.trained().odds(H.features([b for b, _ in test]), np.array([len(b) for b, _ in test]))
    assert (((odds >= 0.5) == np.concatenate([y for _, y in test])).mean()) > 0.97


def test_gradient_by_differences():
    r = np.random.default_rng(0)
    m = H.Labeller(3)
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    lengths = np.array([3, 5, 1])
    x, y = r.normal(size=(9, H.WIDTH)), r.integers(0, 2, 9).astype(float)

    def loss():
        p = m.odds(x, lengths)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = m.gradient(x, lengths, y)
    for name in m.w:
        at = tuple(int(r.integers(0, s)) for s in m.w[name].shape)
        old, step = m.w[name][at], 1e-2
        m.w[name][at] = old + step
        up = loss()
        m.w[name][at] = old - step
        down = loss()
        m.w[name][at] = old
        assert abs((up - down) / (2 * step) - g[name][at]) < 1e-3 * max(1, abs(g[name][at]))


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (None, None, None), (2, "u", ""), (2, "u", "")], "page_id long, url string, html string")
    rows = H.extract(df).collect()
    assert len(rows) == 4 and sum(r["text"] == "" for r in rows) == 3
    assert H.extract(df.limit(0)).count() == 0
    clashing = df.withColumns({c: F.lit(7) for c in ("text", "n_chars", "_row")}).withColumnsRenamed({"page_id": "key"})
    assert sorted(r["text"] for r in H.extract(clashing, page_id="key").collect()) == sorted(r["text"] for r in rows)


def test_decoding_of_references_and_unclosed_tags():
    found = H.blocks("a<p>b &lt;c&gt; &#233;<p>d<div class='x y'>e<li>f<li>g</div><a href=q>h</a> i<textarea>no</textarea>")
    assert [b.text for b in found] == ["a", "b <c> é", "d", "e", "f", "g", "h i"]
    assert [b.path for b in H.blocks("<h2>a</h3><p>b<h1>c<h2>d</h2>e")] == [(("h2",),), (("p",),), (("h1",),), (("h2",),), ()]
    assert found[3].path == (("div", "x", "y"),) and found[-1].links == 1


@pytest.mark.parametrize("page,texts", [
    ("<p data-x=don't>Main text here. It's fine.</p><p>Second.</p>", ["Main text here. It's fine.", "Second."]),
    ("<article><video src=x><p>One</p><p>Two</p>", ["One", "Two"]), ("<svg width=3 height=4><p>One</p><p>Two", ["One", "Two"]),
    ("a<object><object>a</object>inner tail</object>b", ["ab"]), ("x &am<b></b>p; y", ["x &amp; y"]), ("<svg><![CDATA[ x > y ]]></svg>z", ["z"]),
    ("a<p title='x > y' class=\"q\">b</p><p a='>c</p>' >d</p>", ["a", "b", "d"]), ("<a href='x'y>t</a> </ bogus>u<br/>v<p class=>w", ["t u v", "w"]),
    ("<!-->a<!--x--!>b<!-- c", ["ab"]), ("a<video>x</video>b<video>c", ["abc"]), ("<svg/>a<canvas/>b</canvas>c", ["ac"]), ("<p =x>a</p><p x=\"1\"y='2'>b<p x='unclosed>c", ["a", "b"]),
    ("<title>x</title>y<textarea>z</textarea>w", ["yw"]), ("<script>var a='</scr'+'ipt>';</script >q", ["q"]), ("a &lt; b < c &#x41;", ["a < b < c A"]),
])
def test_no_text_is_lost_by_odd_markup(page, texts):
    assert [b.text for b in H.blocks(page)] == texts


def test_long_pages_go_in_lots(monkeypatch):
    pages = [H.blocks("<div><p>some words here, " + "</p><p>and more of them.".join(map(str, range(400)))), H.blocks(PAGE)]
    model, lengths = H.trained(), np.array([len(p) for p in pages])
    want, rows = model.odds(H.features(pages), lengths), H.features(pages)
    monkeypatch.setattr(H, "LOT", 37)
    assert (H.features(pages) == rows).all() and np.allclose(model.odds(list(H.feature_lots(pages)), lengths), want, atol=1e-5)
    start = time.time()
    assert len(H.main_texts(model, ["<p>a b</p>" * 60_000])) == 1 and time.time() - start < 120


@pytest.mark.parametrize("tag", sorted(H.UNSHOWN))
def test_unshown_elements_beside_blocks(tag):
    for page in (f"<p>a</p><{tag}>x</{tag}>b<p>c</p>", f"<{tag}></{tag}><p>a</p>b<p>c</p><{tag}></{tag}>", f"<h1>a</h1></{tag}>b<h2>c</h2></{tag}>", f"<p>a</p><{tag}>b<div>c</div>"):
        assert [b.text for b in H.blocks(page)] == ["a", "b", "c"]


def test_unshown_elements_through_the_operator(spark):
    df = spark.createDataFrame([(1, "u", "<p>hello</p><svg></svg>"), (2, "u", "<p>a</p></svg>"), (3, "u", PAGE.replace("</p>", "</p><video>x</video></canvas>"))], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.extract(df).collect()}
    assert len(got) == 3 and got[3] == H.main_texts(H.trained(), [PAGE])[0]


def test_no_markup_is_an_error():
    r = random.Random(8)
    pieces = [*(f"<{x}>" for x in sorted(H.BLOCK | H.RAW | H.UNSHOWN | H.VOID)), *(f"</{x}>" for x in sorted(H.BLOCK | H.RAW | H.UNSHOWN)), "<", ">", "</", "<!--", "-->", "<![CDATA[", "]]>", "<p class='a b'", "/>", "&amp;", "text ", " ", "<a href=x>", "</a>", "<div id=\"q"]
    for _ in range(1500):
        for b in H.blocks("".join(r.choice(pieces) for _ in range(r.randint(0, 60)))):
            assert b.text and len(b.path) == (b.node.depth if b.node else 0)


@pytest.mark.parametrize("unit,end", [("<div>", ""), ("<textarea>", ""), ("<svg>", ""), ("<svg>", "</svg>"), ("<ul><center>", "<li></li>"), ("<div class=a>", "</p>"), ("<title>", ""), ("</div>", "")])
def test_long_odd_pages_take_linear_time(unit, end):
    n = 1_000_000 // len(unit + end)
    page, start = "<li>" + unit * n + "x" + end * n, time.time()
    found = H.blocks(page)
    H.features([found])
    assert len(found) <= 2 and time.time() - start < 10


def test_deep_blocks_share_their_paths():
    import tracemalloc

    page = "<div class='a b'>word " * 16_000
    tracemalloc.start()
    found, start = H.blocks(page), time.time()
    rows = sum(len(lot) for lot in H.feature_lots([found]))
    assert rows == len(found) == 16_000 and found[-1].path == (("div", "a", "b"),) * 16_000
    assert tracemalloc.get_traced_memory()[1] < 150 << 20 and time.time() - start < 20
    tracemalloc.stop()


def by_template(page: str) -> str:
    """The articles of pages in the given tables, by a rule for their markup."""
    inside = "".join(re.findall(r"<article>(.*?)</article>", page, re.S)).replace("<br>", " ")
    inside = re.sub(r"<(section|div|aside|form|nav)\b.*?</\1>", "\0", inside, flags=re.S)
    parts = re.sub(r"</?(?:b|i|a|em|strong|span)\b[^>]*>", "", inside)
    return "\n".join(t for t in (" ".join(html.unescape(x).split()) for x in re.split(r"<[^>]+>|\0", parts)) if t)


@pytest.mark.parametrize("tables", ["sf0.001", "sf0.01"])
def test_main_text_of_the_given_pages(spark, tables):
    rows = H.extract(spark.read.parquet(f"/root/testdata/{tables}/pages.parquet")).collect()
    pages = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"/root/testdata/{tables}/pages.parquet").collect()}
    wrong = [r["page_id"] for r in rows if r["text"] != by_template(pages[r["page_id"]])]
    assert len(rows) == len(pages) and not wrong


def test_environment_leaves_no_threads():
    assert os.environ.get("TOKENIZERS_PARALLELISM", "false") in ("false", "0")


def test_tables_and_searched_edges_give_the_same(monkeypatch):
    """Also of scripts of many letters."""
    from halfstep.llm import langid as L

    r = np.random.default_rng(5)
    letters = [chr(0x4E00 + k) for k in range(1500)]
    odds = 1 / np.arange(1, 1501)

    def some(n, shift):
        return "".join(letters[(k + shift) % 1500] if k % 7 else " " for k in r.choice(1500, n, p=odds / odds.sum()))

    texts = {"a": some(4000, 0), "b": some(4000, 400), "c": "plain words of another script " * 20}
    probes = [texts["a"][500:900], texts["b"][3:2900], some(300, 0), some(300, 400), "plain words", "一", "龠" * 9, ""]
    tables = L.Parser(texts)
    assert all(a.table is not None for a in tables.automata)
    got = tables.predict(probes)
    monkeypatch.setattr(L, "DENSE", 0)
    edges = L.Parser(texts)
    assert all(a.table is None for a in edges.automata)
    want = edges.predict(probes)
    assert got[0] == want[0] and got[0][:5] == ["a", "b", "a", "b", "c"]
    assert all((g == w).all() for g, w in zip(got[1:], want[1:], strict=True))
    assert got[2][0] == 1  # the labelled text itself is one phrase


def test_many_labels_in_many_scripts(spark):
    """All of 300 labels are learned, and predicted as searching does, with the tables' bytes bounded."""
    from halfstep.llm import langid as L

    r, rows = np.random.default_rng(6), []
    for k in range(300):
        script = [chr(0x4E00 + 40 * k + j) for j in range(60)] if k % 3 else [chr(97 + (k + j) % 26) for j in range(14)]
        rows += [(1000 * k + 10 * j + 1, "".join(r.choice([*script, " "], 150)), f"l{k:03d}") for j in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = L.sample(docs)
    usable = docs.filter(~L.held_out(F.col("doc_id")))
    assert sorted(known) == sorted({r["lang"] for r in usable.select("lang").distinct().collect()}) and len(known) > 290
    parser = L.Parser(known)
    assert sum(a.bytes for a in parser.automata) <= L.DENSE
    probes = [rows[4 * k][1] for k in range(0, 300, 29)]
    for text, lang in zip(probes, parser.predict(probes)[0], strict=True):
        assert lang == by_search(text, known)[0]
    assert set(L.sample(docs, total=300 * 100).keys()) == set(known) and max(map(len, L.sample(docs, total=300 * 100).values())) <= 201
