import hashlib
import html as html_lib
import html.parser
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

from lumenframe.llm import bpe, chat, html_extract, language_id, quality


def test_bpe_against_the_library(spark, docs, empty):
    tk = tokenizers.Tokenizer.from_file(bpe.vocabulary())
    got = bpe.coded(docs, bpe.vocabulary(), ("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")).collect()
    assert len(got) == docs.count()
    want = {}
    for r in docs.collect():
        ids = tk.encode(r.text or "", add_special_tokens=False).ids
        want.setdefault((r.doc_id, len(ids)), []).append((ids, tk.decode(ids, skip_special_tokens=False)))
    for r in got:
        ids, text = want[r.doc_id, r.n_tokens][0]
        assert r.ids == ids and r.decoded == text
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.op8_query(empty).collect() == []


def test_bpe_small_chunks_and_small_cache():
    with open(bpe.vocabulary(), "rb") as f:
        file = f.read()
    tk = tokenizers.Tokenizer.from_file(bpe.vocabulary())
    rng = np.random.default_rng(0)
    parts = ["a", " ", "  ", "\n", "'s", "é", " the", "日本", "<|endoftext|>", "...", "\x85", "　", "1", "B"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 300))) for _ in range(200)] + ["x" * 3000, " " * 900]
    for bits in (2, 5):
        codec = bpe.Codec(file, cut_bits=bits, cache_tokens=300)
        for t in texts:
            assert codec.encode(t) == tk.encode(t, add_special_tokens=False).ids
    codec = bpe.Codec(file)
    text = " ".join(f"word{i}" for i in range(2000))
    codec.encode(text)
    before = codec.encoded
    codec.encode(text)
    assert codec.encoded == before  # every chunk was reused


def test_chat_round_trip():
    rng = np.random.default_rng(1)
    parts = ["a", "\\", "</s>", "<s>", "[INST] ", " [/INST]", "\n", "<<SYS>>\n", "\n<</SYS>>\n", "[ROLE ", "]", "[/ROLE]", "é"]
    for _ in range(2000):
        turns = [
            (str(rng.choice(["user", "assistant", "system", "tool", "", "a]b"])), "".join(rng.choice(parts, rng.integers(0, 6))))
            for _ in range(rng.integers(0, 4))
        ]
        assert chat.parse("".join(chat.render_turn(*t) for t in turns)) == turns
    assert chat.parse("[INST] open") is None


def test_chat_reader_takes_pieces_cut_anywhere():
    rng = np.random.default_rng(2)
    parts = ["a", "\\", "</s>", "[INST] ", " [/INST]", "\n<</SYS>>\n", "[/ROLE]", "]"]
    for _ in range(200):
        turns = [(str(rng.choice(["user", "assistant", "system", "x]"])), "".join(rng.choice(parts, rng.integers(0, 6)))) for _ in range(4)]
        text = "".join(chat.render_turn(*t) for t in turns)
        reader, found = chat.Reader(), []
        cuts = sorted(rng.integers(0, len(text) + 1, 9).tolist())
        for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True):
            found += reader.feed(text[a:b])
        reader.end()
        assert [f[:2] for f in found] == turns
        assert all(chat.escape(t, 0) == t and re.sub(r"\\(.)", r"\1", text[a:b], flags=re.S) == t for _, t, a, b in found)
    reader = chat.Reader()
    reader.feed("[INST] open")
    with pytest.raises(ValueError):
        reader.end()


def test_chat_formatted(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text </s> {c} {t} " + "x" * (t * 10)) for c in range(3) for t in range(8)] + [(9, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for most in (1 << 20, 60):
        got = {}
        for r in sorted(chat.formatted(df, most).collect(), key=lambda r: (r.conv_id, r.part)):
            text, told = got.setdefault(r.conv_id, ["", []])
            assert r.begin == len(text)
            told += [re.sub(r"\\(.)", r"\1", r.text[m.begin : m.end], flags=re.S) for m in r.mask]
            got[r.conv_id][0] += r.text
        for c in range(3):
            assert chat.parse(got[c][0]) == [(r[2], r[3]) for r in rows if r[0] == c]
            assert got[c][1] == [r[3] for r in rows if r[0] == c and r[2] == "assistant"]
        assert chat.parse(got[9][0]) == [("", "")]


def test_chat_query(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo </s>"), (2, 5, None, None), (1, 1, "assistant", "yo </s>"), (None, 0, "user", "x"), (3, None, "assistant", "é\\")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id bigint, turn bigint, role string, text string, piece string")
    got = {r.conv_id: r for r in chat.op9_query(df).collect()}
    assert set(got) == {1, 2, 3, None, -1}
    told = "user\nhi\nassistant\nyo </s>\nassistant\nyo </s>\n"
    assert got[1].turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
    assert got[1].loss_chars == 14 and got[1].loss_sha256 == hashlib.sha256(b"yo </s>yo </s>").hexdigest()
    assert got[2].n_turns == 1 and got[2].loss_chars == 0
    assert got[3].loss_chars == 2
    hard = "</s>[INST] ok [/INST]"
    assert got[-1].turns_sha256 == hashlib.sha256(f"user\n{hard}\nassistant\n{hard}\n".encode()).hexdigest()
    assert got[-1].loss_chars == len(hard)
    assert [r.conv_id for r in chat.op9_query(df.where("false")).collect()] == [-1]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="no-sidebar">
<header><h2>Site</h2></header><nav><ul><li><a href="/x">Home</a></li></ul></nav><div class="cookie-notice">We use cookies for the best of all sites.</div>
<main><article><header><h1>The title</h1></header><p>It was the best of times, it was the worst of times, and so on &amp; on
for   many words.<p>anstsh | theawhtion | erhast | ntingnt | atenon | edhaes | ereaon | thheeden | heheen | intintwh</p>
<aside>Related: the other one</aside><p>Short <b>o</b>ne.</p><form><label>Name</label></form></article>
<section id="comments"><p>I think that this is the best of the stories that I have read for a long time.</p></section></main>
<div id="sidebar">A text at the side of the page that is not of the article</div><footer>&copy; 2020</footer>"""


def test_html():
    text = html_extract.main_text(PAGE)
    assert text == (
        "The title It was the best of times, it was the worst of times, and so on & on for many words. "
        "anstsh | theawhtion | erhast | ntingnt | atenon | edhaes | ereaon | thheeden | heheen | intintwh Short one."
    )
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<!-- open") == ""
    assert html_extract.main_text("plain") == "plain"
    assert html_extract.main_text("<p>a<br>b") == "a b"


def test_html_hidden_blocks():
    inside = '<article><p>Shown.</p><div hidden><p>Not shown</p></div><div style="display: none">Nor this</div><div class="overflow-hidden">But this.</div></article>'
    assert html_extract.main_text(inside) == "Shown. But this."


def test_html_without_an_article():
    long = "This is the text of a page that has no marks of its own, but it is long and it reads as the prose of a man does. " * 3
    page = f"<div><a href=1>one</a> <a href=2>two</a></div><div>{long}</div><div>Then.</div><div>{long}</div><div><a href=3>more links</a></div>"
    assert html_extract.main_text(page) == f"{long.strip()} Then. {long.strip()}"


def test_html_tags_left_open():
    page = "<article><p>One is the text.<datalist><option>A<option>B</datalist><p>Two is <p>Three<ul><li class=ad>x<li>Four</ul><p class='cookie-notice'>no<p>Five</article>"
    assert html_extract.main_text(page) == "One is the text. Two is Three Four Five"
    table = "<article><table><tr><td class=promo>x<td>a<tr><td>b<tbody><tr><th>c</table><select><option>no</select> d</article>"
    assert html_extract.main_text(table) == "a b c d"


def test_html_of_languages_without_stop_words():
    prose = "\u042d\u0442\u043e \u0434\u043b\u0438\u043d\u043d\u044b\u0439 \u0442\u0435\u043a\u0441\u0442 \u0431\u0435\u0437 \u0440\u0430\u0437\u043c\u0435\u0442\u043a\u0438, \u043d\u043e \u0441 \u0442\u043e\u0447\u043a\u0430\u043c\u0438. " * 6
    cells = "12 | 13 | 14 || 15 | 16 | 17 || " * 9
    page = f"<div><a href=1>\u0434\u0430</a></div><div>{cells}</div><div>{prose}</div><div>\u0414\u0430.</div><div>{prose}</div><footer>\u043d\u0435\u0442</footer>"
    assert html_extract.main_text(page) == f"{prose.strip()} \u0414\u0430. {prose.strip()}"


class PlainPage(html_lib.parser.HTMLParser):
    """Blocks of a well-formed page, by the standard library's parser: [text, linked text, in the article, in furniture]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.path, self.blocks, self.links = [], [], False

    def cut(self):
        article = any(n in ("article", "main") for n, _ in self.path)
        self.blocks.append(["", "", article, any(f for _, f in self.path)])

    def handle_starttag(self, name, attrs):
        self.links = name == "a" or (self.links and name in html_extract.INLINE)
        if name not in html_extract.INLINE:
            if name not in html_extract.VOID and name != "p":
                named = {w for k, v in attrs if k in ("class", "id", "role") for w in (v or "").replace("-", " ").replace("_", " ").split()}
                self.path.append((name, name in html_extract.FURNITURE or name in html_extract.RAW or bool(named & html_extract.FURNITURE_WORDS)))
            self.cut()

    def handle_endtag(self, name):
        self.links = self.links and name != "a" and name in html_extract.INLINE
        if name not in html_extract.INLINE:
            while name in [n for n, _ in self.path]:
                if self.path.pop()[0] == name:
                    break
            self.cut()

    def handle_data(self, data):
        if not self.blocks:
            self.cut()
        self.blocks[-1][0] += data
        self.blocks[-1][1] += data if self.links else ""


def plain_main_text(page):
    """Both passes in plain loops over all pairs of blocks."""
    parser = PlainPage()
    parser.feed(page)
    parser.close()
    found = [(" ".join(t.split()), len(" ".join(a.split())), article, furniture) for t, a, article, furniture in parser.blocks if t.strip()]
    words = " ".join(t for t, _, _, furniture in found if not furniture).split()
    known = not words or sum(w.lower().strip(".,;:!?") in html_extract.STOP_WORDS for w in words) >= 0.03 * len(words)
    first = [html_extract.decide(html_extract.Block(*b), known) for b in found]
    kept = []
    for i, b in enumerate(found):
        near = sorted((abs(i - j), j > i, first[j]) for j, c in enumerate(found) if first[j] is not None and not c[3] and c[2] == b[2])
        if first[i] if first[i] is not None else (near[0][2] if near else True):
            kept.append(b[0])
    return " ".join(kept)


def test_html_against_the_plain_version(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.op2_query(pages).collect()}
    assert got == {r.page_id: plain_main_text(r.html or "") for r in pages.collect()}
    # The same pages without the marks of their articles: what is left to the rules about blocks.
    bare = pages.select("page_id", "url", F.regexp_replace("html", "</?article>", "").alias("html"))
    got = {r.page_id: r.text for r in html_extract.op2_query(bare).collect()}
    assert got == {r.page_id: plain_main_text(r.html or "") for r in bare.collect()}


def test_html_finds_the_articles(spark, sf_dir):
    """Words kept against words of the article: precision and recall."""
    hit = got = want = 0
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    for r in pages:
        article = re.sub(r"<[^>]*>", " ", re.search(r"<article>(.*)</article>", r.html, re.S)[1])
        a, b = Counter(html_extract.main_text(r.html).split()), Counter(html_lib.unescape(article).split())
        hit, got, want = hit + (a & b).total(), got + a.total(), want + b.total()
    assert len(pages) >= 50 and hit / got > 0.99 and hit / want > 0.99


def test_html_query(spark):
    rows = [(1, "u", PAGE, "t", 3), (1, "u", PAGE, "t", 3), (2, None, None, "t", 3), (None, "v", "", "t", 3), (3, "w", "<p>" + "word " * 50_000, "t", 3)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")
    got = html_extract.op2_query(df).collect()
    assert len(got) == 5
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.op2_query(df.where("false")).collect() == []


def test_language(spark, docs, empty, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = language_id.op3_query(table).join(table.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(out) == table.count() and held
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.9
    got = language_id.op3_query(docs).collect()
    assert len(got) == docs.count()
    for r, d in zip(sorted(got, key=str), sorted(docs.collect(), key=str), strict=True):
        assert 0 <= r.score <= 1
    texts = {d.doc_id: d.text for d in docs.collect()}
    assert {r.doc_id for r in got if r.lang_pred == "und"} >= {1, 2, 7, 9}
    assert all(any(c.isalpha() for c in texts[r.doc_id]) for r in got if r.lang_pred != "und" and r.doc_id)
    assert language_id.op3_query(empty).collect() == []
    unlabelled = docs.withColumn("lang", docs["lang"].substr(1, 0)).where("lang IS NULL")
    assert {r.lang_pred for r in language_id.op3_query(unlabelled).collect()} <= {"und"}


def test_language_of_signs_that_are_no_letters():
    net = language_id.Network(2)
    predict = language_id.predictor(["a", "b"], net)
    assert predict(["\u00bd \u00b2", "\u2460 \u2167 12", "_ - 3", "", None])[0] == ["und"] * 5
    assert "und" not in predict(["\u00bd x", "\u65e5", "\u00aa"])[0]


def test_language_against_a_plain_forward_pass():
    """Scores of whole texts by loops over windows, places and filters."""
    rng = np.random.default_rng(6)
    net = language_id.Network(3, seed=4)
    net.p = {k: (v + rng.normal(0, 0.1, v.shape)).astype(np.float32) if k != "filters" else v for k, v in net.p.items()}
    texts = ["Hello there", "é" * 200, "a b c " * 90, "x"]
    names, scores = language_id.predictor(["p", "q", "r"], net)(texts)
    for text, name, score in zip(texts, names, scores, strict=True):
        data, total = text.lower().encode(), np.zeros(3)
        for begin in range(0, len(data), language_id.LENGTH):
            window = data[begin : begin + language_id.LENGTH]
            padded = window.ljust(language_id.LENGTH, b"\0")
            tops = []
            for f in range(net.p["filters"].shape[1]):
                width = language_id.WIDTHS[f // language_id.FILTERS]
                at = [
                    sum(float(net.p["embed"][padded[i + j]] @ net.p["filters"][j * language_id.EMBEDDING : (j + 1) * language_id.EMBEDDING, f]) for j in range(width))
                    for i in range(language_id.LENGTH - max(language_id.WIDTHS) + 1)
                ]
                tops.append(max(0.0, max(at) + float(net.p["bias"][f])))
            z = np.array(tops) @ net.p["out"] + net.p["out_bias"]
            total += len(window) * np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert name == "pqr"[int(total.argmax())]
        assert abs(score - total.max() / len(data)) < 1e-4


def test_language_gradients():
    rng = np.random.default_rng(3)
    net = language_id.Network(3)
    rows = rng.integers(1, 255, (4, language_id.LENGTH)).astype(np.uint8)
    labels = np.array([0, 1, 2, 1])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    loss = lambda: -np.log(net.softmax(np.maximum(net.pooled(rows), 0) @ net.p["out"] + net.p["out_bias"])[np.arange(4), labels]).mean()
    found = net.gradients(rows, labels)
    for name in ("filters", "bias", "out", "out_bias", "embed"):
        for at in list(zip(*np.nonzero(found[name]), strict=True))[:5]:
            keep, e = net.p[name][at], 1e-6
            net.p[name][at] = keep + e
            up = loss()
            net.p[name][at] = keep - e
            down = loss()
            net.p[name][at] = keep
            assert abs((up - down) / (2 * e) - found[name][at]) < 1e-4


def test_quality(spark, docs, empty, sf_dir):
    table, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.op10_query(table, labels).join(labels.select("doc_id", "quality"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert all(r.predicted == (r.score >= 0.3) for r in out)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.9
    marks = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (3, None, 0), (None, 1, 0), (5, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert quality.op10_query(docs, marks).count() == docs.count()
    assert {r.score for r in quality.op10_query(docs, marks.where("false")).collect()} == {0.5}
    assert quality.op10_query(empty, marks).collect() == []


def test_moments_against_numpy(spark, sf_dir):
    """The model of the sums that Spark makes is that of all labelled vectors outside the held-out fold."""
    table, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.trained(quality.with_statistics(table), labels)
    texts = {r.doc_id: r.text for r in table.collect()}
    by_class = {0: [], 1: []}
    for r in labels.collect():
        if r.quality in (0, 1) and r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % 5:
            by_class[r.quality].append(quality.statistics(texts[r.doc_id]))
    x = {c: np.array(v) for c, v in by_class.items()}
    n = {c: len(v) for c, v in x.items()}
    assert abs(model.prior - n[1] / (n[0] + n[1])) < 1e-12
    pooled = sum(n[c] * np.cov(x[c].T, bias=True) for c in x) / sum(n.values())
    for c, (mean, whiten, half_log_det) in enumerate(model.classes):
        want = (1 - quality.SHRINKAGE) * np.cov(x[c].T, bias=True) + quality.SHRINKAGE * (np.diag(np.diag(pooled)) + quality.RIDGE * np.eye(len(pooled)))
        assert np.allclose(mean, x[c].mean(0)) and np.allclose(np.linalg.inv(whiten) @ np.linalg.inv(whiten).T, want, atol=1e-8)
        assert abs(2 * half_log_det - np.linalg.slogdet(want)[1]) < 1e-6


def test_discriminant_against_plain_densities():
    rng = np.random.default_rng(2)
    d = len(quality.NAMES)
    x = {c: rng.normal(c, 1 + c, (200, d)) for c in (0, 1)}
    model = quality.Discriminant({c: (len(v), v.sum(0), v.T @ v) for c, v in x.items()}, 0.1)
    pooled = sum(len(v) * np.cov(v.T, bias=True) for v in x.values()) / 400
    at = rng.normal(0.5, 1, (20, d))
    logs = []
    for c in (0, 1):
        s = 0.9 * np.cov(x[c].T, bias=True) + 0.1 * (np.diag(np.diag(pooled)) + quality.RIDGE * np.eye(d))
        diff = at - x[c].mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(s), diff) - 0.5 * np.linalg.slogdet(s)[1])
    assert np.allclose(model.scores(at), 1 / (1 + np.exp(logs[0] - logs[1])), atol=1e-9)
