"""Each operator against brute force, an exact round trip or held-out accuracy, and on odd rows."""

import hashlib
import math
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from heddle.llm import common, license_scan, queries
from heddle.llm.chat_format import chat_windows, escape, read_windows, unescape
from heddle.llm.decontaminate import contaminated
from heddle.llm.encoder import Encoder
from heddle.llm.html_extract import blocks, extract
from heddle.llm.ngram_join import apart, ngram_components, shingles
from heddle.llm.packing import Plan, best_configurations, pack
from heddle.llm.token_counts import count_tokens
from heddle.llm.token_output import Segment, document_digests, pack_segment, read_tokens, token_at, write_tokens
from heddle.llm.toxicity import PLACES, Ftrl, toxicity
from heddle.llm.vector_dedup import hadamard, vector_components

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, id long, key string, n long"  # the last three clash with names inside
ODD = ["", None, "   ", "a", "<|endoftext|> x", "a  b\n\n c ", "it's 1.5,x\n\tq  \n z ", "x ² y½.z\u001c q r", "word. " * 3000, "Ünïcödé line", "a\n\nb", "a.\n\nB c", "😀 😀,.", "same text here now", "same text here now"]


def odd_docs(spark):
    rows = [(i, t, 1, "k", 2) for i, t in enumerate(ODD)] + [(None, "null id", 1, "k", 2), (3, "a", 1, "k", 2), (3, "a", 1, "k", 2)]
    return spark.createDataFrame(rows, DOCS)


def real_docs(spark, sf):
    return common.table(spark, sf, "documents")


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def ids_of(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_encoder(tok, spark, sf):
    texts = [r.text for r in real_docs(spark, sf).limit(60).collect()] + ODD
    small = Encoder(PATH, most_bytes=1)
    for _ in range(2):
        got = small.encode(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [ids_of(tok, x) for x in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(name):
    enc = Encoder(public_tokenizers.path(name))
    assert all(len(x) % 4 == 0 for x in enc.encode(["Hello there world", "", None]))


def test_segment():
    rng = np.random.default_rng(1)
    ids = np.where(rng.random(5000) < 0.5, rng.integers(0, 200, 5000), rng.integers(0, 1 << 24, 5000)).astype(np.uint32)
    ends = [0, 10, 10, 700, 5000]
    s = Segment(pack_segment([1, 2, 3, 4, 5], ends, ids))
    assert [s.token(i) for i in range(0, 5000, 7)] == ids[::7].tolist()
    assert all((s.span(a, b) == ids[a:b]).all() for a, b in ((0, 5000), (511, 513), (512, 512), (4999, 5000), (37, 2900)))
    assert (s.document(3) == ids[10:700]).all()
    with pytest.raises(IndexError):
        s.token(5000)


def test_token_output(spark, sf, tok):
    docs = real_docs(spark, sf).select("doc_id", "text").union(spark.createDataFrame([(-5, None), (10**9, "")], "doc_id long, text string"))
    path = write_tokens(docs, PATH, segment_ids=3000)
    got = {r.doc_id: r for r in document_digests(spark, path).collect()}
    at = 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = np.array([*ids_of(tok, r.text), 0], "<u4")
        g = got.pop(r.doc_id)
        assert (g.start, g.n_tokens, g.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert not got
    last = max(docs.collect(), key=lambda r: r.doc_id)
    assert token_at(spark, path, at - 1) == 0 and token_at(spark, path, 0) == 0 and last.text == ""
    first = min((r for r in docs.collect() if r.text), key=lambda r: r.doc_id)
    assert [token_at(spark, path, 1 + k) for k in range(3)] == ids_of(tok, first.text)[:3]
    with pytest.raises(IndexError):
        token_at(spark, path, at)
    assert read_tokens(spark, path).count() > 10
    odd = document_digests(spark, write_tokens(odd_docs(spark), PATH)).collect()
    assert len(odd) == len(ODD) + 3 and next(r for r in odd if r.doc_id is None).start == 0
    assert document_digests(spark, write_tokens(docs.limit(0), PATH)).count() == 0


def test_license_scan(spark, sf):
    found = {(r.doc_id, r.license) for r in queries.op2_license_scan(spark, sf).collect()}
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT"}
    assert {(r.doc_id, name) for r in real_docs(spark, sf).collect() for line, name in lines.items() if line in r.text} <= found
    notice = license_scan.TEMPLATES["GPL-3.0"][1]
    rows = [(1, "x y z " * 500 + notice + " q" * 300, 0, "", 0), (2, notice.replace("Foundation", "Club"), 0, "", 0), (3, notice[:60], 0, "", 0), (4, None, 0, "", 0), (None, notice, 0, "", 0), (5, "", 0, "", 0)]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id for r in got} == {1, 2, None} and all(r.license == "GPL-3.0" for r in got)
    assert {r.doc_id: r.containment for r in got}[1] == 1.0
    assert license_scan.scan_licenses(spark.createDataFrame([], DOCS)).count() == 0


def licenses_by_hand(text):
    """(license: best containment, its first window) by every window of every template, with words for hashes."""
    grams = lambda x: [tuple(w[i : i + 3]) for w in [[y for y in re.split(r"[^\w]|_", x.lower()) if y]] for i in range(len(w) - 2)]
    known = [(name, set(grams(t))) for name, ts in license_scan.TEMPLATES.items() for t in ts]
    s, found = grams(text or ""), {}
    for name, t in known:
        width = max(4, 1 << (len(t) - 1).bit_length())
        rivals = [t - x for other, x in known if other != name and 0.8 <= len(t & x) / len(t) < 1]
        for start in range(0, len(s), width // 4):
            window = set(s[start : start + width + width // 4])
            share = len(t & window) / len(t)
            if share >= 0.8 and all(x & window for x in rivals):
                found[name] = max(found.get(name, (0, 0)), (share, -start))
    return {name: (share, -start) for name, (share, start) in found.items()}


def test_license_scan_equals_every_window(spark, sf):
    cc, gpl = "This work is licensed under a Creative Commons Attribution{} 4.0 International License", "This work is licensed under the GNU General Public License, version {}"
    texts = [cc.format(x) for x in ("", "-NonCommercial", "-ShareAlike")] + [gpl.format(x) for x in (2, 3, "two")] + [gpl.format(2) + " word" * 9 + " " + gpl.format(3), "x " * 77 + cc.format("") + " and " + cc.format("-ShareAlike"), "Licensed under CC BY 4.0. Licensed under the MIT License"]
    docs = [(-1 - i, x) for i, x in enumerate(texts)] + [(r.doc_id, r.text) for r in real_docs(spark, sf).collect()]
    got = license_scan.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = {(i, name): (round(x[0], 9), x[1]) for i, text in docs for name, x in licenses_by_hand(text).items()}
    assert {(r.doc_id, r.license): (round(r.containment, 9), r.word_start) for r in got} == want
    assert [sorted(n for i, n in want if i == -1 - k) for k in range(9)] == [["CC-BY-4.0"], ["CC-BY-NC-4.0"], ["CC-BY-SA-4.0"], ["GPL-2.0"], ["GPL-3.0"], [], ["GPL-2.0", "GPL-3.0"], ["CC-BY-4.0", "CC-BY-SA-4.0"], ["CC-BY-4.0", "MIT"]]


@pytest.mark.parametrize("lengths", [range(1, 2049), [5], [2048] * 3, [1] * 5000, [700, 1300, 700, 1300, 48], [1025] * 9, []])
def test_plan(lengths):
    hist = {n: list(lengths).count(n) for n in set(lengths)}
    p = Plan(hist, 2048)
    held = defaultdict(int)
    for n, content in p.closed:
        assert sum(a * b for a, b in content) <= 2048
        for a, b in content:
            held[a] += n * b
    assert held == hist
    assert p.bins <= max(1.05 * -(-sum(lengths) // 2048) + 1, sum(1 for x in lengths if x > 1024))


@pytest.mark.parametrize("hist, least", [(dict.fromkeys(range(600, 761), 600), 1.0), (dict.fromkeys(range(500, 901), 400), 1.0174), ({600: 10_000, 448: 10_000, 1000: 10_000}, 1.0), ({683: 999, 682: 999}, 1.0)])
def test_plan_of_three_and_more(hist, least):
    """Within a hundredth of the least that a fractional packing needs: the volume, times `least` where lengths leave gaps in any bin."""
    assert Plan(hist, 2048).bins <= 1.01 * least * sum(a * b for a, b in hist.items()) / 2048 + 1


def test_configurations_fill_actual_bins():
    s, d = [900, 700, 500, 448], [40, 100, 60, 100]
    for config, bins in best_configurations(s, d, 2048):
        assert bins > 0 and sum(a * b for a, b in zip(s, config)) <= 2048


def check_packed(rows, docs, tok):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    for rs in by.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for r in docs:
        ids, at = np.array([*ids_of(tok, r.text), 0], "<u4"), 0
        mine = sorted(pieces[r.doc_id], key=lambda p: p.piece)
        for k, p in enumerate(mine):
            assert (p.piece, p.start, p.ids_crc32) == (k, at, zlib.crc32(ids[at : at + p.length].tobytes())) and (p.length == 2048 or not k)
            at += p.length
        assert at == len(ids)
    return len(by), -(-sum(r.length for r in rows) // 2048)


def test_pack(spark, sf, tok):
    n, least = check_packed(queries.op3_packing(spark, sf).collect(), real_docs(spark, sf).collect(), tok)
    assert n <= 1.03 * least + 1
    odd = odd_docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    check_packed(pack(odd, PATH).collect(), odd.collect(), tok)
    assert pack(odd_docs(spark), PATH).groupBy("sequence_id", "offset").count().where("count > 1").isEmpty()
    assert pack(odd.limit(0), PATH).count() == 0


def test_token_counts(spark, sf, tok):
    cache = common.scratch(spark, "counts")
    for _ in range(2):
        got = {r.doc_id: r for r in count_tokens(real_docs(spark, sf), PATH, cache).collect()}
        assert all((got[r.doc_id].n_bytes, got[r.doc_id].n_tokens, got[r.doc_id].over_limit) == (len(r.text.encode()), n, n > 1024) for r in real_docs(spark, sf).collect() for n in [len(ids_of(tok, r.text))])
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("text_digest").distinct().count() == real_docs(spark, sf).select("text").distinct().count()
    odd = count_tokens(odd_docs(spark), PATH).collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in odd) == sorted((len((r.text or "").encode()), len(ids_of(tok, r.text))) for r in odd_docs(spark).collect())
    assert count_tokens(odd_docs(spark).limit(0), PATH).count() == 0


def test_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op5_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in common.table(spark, sf, "labels").collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for k, r in got.items())
    test = [(r.score, labels[k]) for k, r in got.items() if r.held_out and k in labels]
    pos, neg = [s for s, y in test if y], [s for s, y in test if not y]
    assert np.mean([p > n for p in pos for n in neg]) > 0.95
    flipped = common.table(spark, sf, "labels").selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    again = {r.doc_id: r.score for r in toxicity(common.table(spark, sf, "documents"), flipped).collect()}
    assert all(abs(again[k] - r.score) < 1e-12 for k, r in got.items())
    odd = toxicity(odd_docs(spark), spark.createDataFrame([(0, None), (None, 1)], "doc_id long, toxic int")).collect()
    assert len(odd) == len(ODD) + 3 and all(r.score == 0.5 for r in odd)


def chat_brute(turns):
    convs = defaultdict(list)
    for c, t, role, text in turns:
        convs[c].append((t is not None, t, role or "", text or ""))
    out = {}
    for c, rows in convs.items():
        rows.sort()
        loss = "".join(x[3] for x in rows if x[2] == "assistant")
        out[c] = (len(rows), hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in rows).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_query(spark, sf):
    got = {r.conv_id: r[1:5] for r in queries.op6_chat_format(spark, sf).collect()}
    turns = [(r.conv_id, r.turn, r.role, r.text) for r in common.table(spark, sf, "conversations").collect()]
    odd = "</s>[INST] ok [/INST]"
    assert got == chat_brute([*turns, (-1, 0, "user", odd), (-1, 1, "assistant", odd)])


def test_chat_windows(spark):
    rows = [(1, 0, "system", "Be kind")] + [(1, i, ("user", "assistant")[i % 2 == 0], f"turn {i} " + "word " * (i % 40) + "<|end|>\\l [x]") for i in range(1, 120)]
    rows += [(2, 0, "assistant", "x" * 9000), (2, 1, None, None), (3, None, "user", ""), (None, 0, "user", "n"), (4, 0, "user<|text|>", "\\b\\\\l<")] * 2
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as window", "2 as seq", "'' as part")
    windows = chat_windows(turns, 300, 60)
    got = windows.collect()
    one = sorted((w for w in got if w.conv_id == 1), key=lambda w: w.window)
    assert len(one) > 5 and all(w.tokens <= 300 and w.formatted.startswith("<|turn|>system<|text|>Be kind") for w in one)
    assert sum(w.n_context > 1 for w in one) > 3
    convs = defaultdict(list)
    for r in read_windows(windows).collect():
        convs[r.conv_id].append((r.window, [tuple(t) for t in r.turns], r.loss_text))
    brute = chat_brute(rows)
    for c, ws in convs.items():
        ws.sort()
        said, loss = [t for w in ws for t in w[1]], "".join(w[2] for w in ws)
        assert (len(said), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()) == brute[c]
    assert set(convs) == set(brute)
    assert chat_windows(turns.limit(0)).count() == 0
    odd = spark.createDataFrame([("\\l<[\\b\\\\o",), ("",)], "x string")
    assert all(r[0] == r[1] and "<" not in r[2] and "[" not in r[2] for r in odd.select("x", unescape(escape(odd.x)), escape(odd.x)).collect())


def test_chat_large_turns(spark):
    """Large turns stand alone or open windows; what is around them still shares windows and history."""
    small = [(1, i, ("user", "assistant")[i % 2], f"turn {i} " + "word " * 10) for i in range(60)]
    sizes = {20: 9000, 41: 3100}
    rows = [(c, t, r, "x" * sizes[t] if t in sizes else x) for c, t, r, x in small]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat_windows(turns)
    got = sorted((w for w in windows.collect()), key=lambda w: w.window)
    read = {r.window: [t[1] for t in r.turns] for r in read_windows(windows).collect()}
    assert [x for w in got for x in read[w.window]] == [r[3] for r in rows]
    assert all(w.tokens <= 1024 for w in got if rows[20][3] not in read[w.window]) and len(got) <= 7
    assert [len(read[w.window]) for w in got if rows[20][3] in read[w.window]] == [1]
    assert [len(read[w.window]) > 1 for w in got if rows[41][3] in read[w.window]] == [True]


def test_html_blocks():
    page = "<nav><ul><li><a href='/x'>Menu</a></ul></nav><div class='ad'>Buy</div><article><header><h1>T&amp;tle</h1></header><p><b>One\n  two<br>three<p>Four &lt;x&gt; &am<div class=comments><p>no</div><ul><li>a<li>b</ul><script>var x='</p>'</script><!-- <p>x --></article><footer>F</footer><p>out"
    assert [x[1] for x in blocks(page) if x[2] and not x[3]] == ["T&tle", "One two three", "Four <x> &am", "a", "b"]
    assert blocks(None) == [] and blocks("<p") == [] and [x[1] for x in blocks("plain <unclosed")] == ["plain"]
    assert [x[1] for x in blocks("<p>a</div></p></b>b<script>")] == ["a", "b"]


def test_html_noise_tests():
    kept = lambda page: [x[1] for x in blocks(page) if not x[3]]
    assert kept('<main class="overflow-hidden"><p>a</main>') == ["a"]
    assert kept('<div style="overflow:hidden">b</div><p hidden>c<p title="hidden" data-hidden=1>d<p hidden="">e') == ["b", "d"]
    page = '<div class=sidebar>no</div><article class="post comments-open"><header class="entry-header"><h1>T</h1></header><p>x <math><mi>E</mi><mo>=</mo><mi>m</mi></math> y<div class=related>no</div></article>'
    assert kept(f'<body class="single comments-open has-sidebar">{page}') == ["T", "x E=m y"]
    assert kept(f'<form><div id="page" class="header-fixed sidebar-right">{page}<div class=related><article>no</article></div></div></form><form>no</form>') == ["T", "x E=m y"]
    assert kept("<div class=sidebar-right>all text</div>") == ["all text"] and kept("<div class=ad>no</div><p>z") == ["z"]


def test_html_noise_by_run():
    kept = lambda page: [x[1] for x in blocks(page) if not x[3]]
    assert kept("<p>Real text <span class='ad'>x</p><p>next</p>") == ["Real text", "next"]
    assert kept("<p>a <span class='ad'>BUY</span> b</p>") == ["a b"]
    assert kept("<article><div class='article-header'>H</div><p class=related-work>w<div class=related-posts>no</div><div class=cookie-notice>no</div></article>") == ["H", "w"]
    assert kept("<p>one <b>two</i> three</b></p>4 < 5") == ["one two three", "4 < 5"]


@pytest.mark.parametrize("part", ["<a", "<div>", '<a x="', "<i \"'>\"", "<b></i>", "<div class='ad'>x", "<li>x</li><div>", "<1", "<script>", "<!--", "<article>x", "<b>x<hr>", "<a '\">", "x"])
def test_html_long_pages(part):
    began = time.thread_time()
    blocks(part * (1_000_000 // len(part)))
    assert time.thread_time() - began < 20


def test_html_extract(spark, sf):
    pages = common.table(spark, sf, "pages")
    for r in extract(pages).collect():
        assert r.n_chars == len(r.text) > 0 and "<" not in r.text and "©" not in r.text
    site = [(i, f"http://h.example/{i}", f"<div class=top><div>Same words on all pages</div></div><div class=body><div>Own story {i} {'w' * i}</div></div>") for i in range(8)]
    odd = [(100, None, None), (101, "", ""), (None, "http://z/", "<p>z"), (102, "http://q/", "<article>x</article>"), (102, "http://q/", "<article>x</article>")]
    got = extract(spark.createDataFrame([(*r, "x", 1) for r in site + odd], "page_id long, url string, html string, host string, node int")).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == 13 and all(text[i] == f"Own story {i} {'w' * i}".strip() for i in range(8))
    assert (text[100], text[101], text[None], text[102]) == ("", "", "z", "x")
    assert extract(pages.limit(0)).count() == 0


def test_html_tree_decides_in_articles(spark):
    """The tree cuts an unlabelled notice within articles and keeps real text outside; copied articles stay."""
    page = lambda i, k: f"<div class=lead>Lead of story {i}</div><div class=top>Welcome to us all</div><article><h1>Story {k}</h1><p>Own words {k} {'w' * k}<p>Same plain words<div class=x>Same notice on all pages</div></article>"
    rows = [(i, f"http://h.example/{i}", page(i, i)) for i in range(12)] + [(100 + i, f"http://c.example/{i}", "<article><h1>Copied</h1><p>One text</article>") for i in range(12)]
    rows += [(200 + i, f"http://n.example/{i}", f"<article><p>date {i}<div>One long text of all these pages that is copied, {'word ' * 40}</div></article>") for i in range(12)]
    text = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(text[i] == f"Lead of story {i}\nStory {i}\nOwn words {i} {'w' * i}".strip() for i in range(12))
    assert all(text[100 + i] == "Copied\nOne text" and text[200 + i].startswith(f"date {i}\nOne long text") for i in range(12))


def test_decontaminate(spark, sf):
    got = {(r.doc_id, r.item_id) for r in queries.op8_decontaminate(spark, sf).collect()}
    items = common.table(spark, sf, "benchmark").collect()
    plain = {(d.doc_id, b.item_id) for d in real_docs(spark, sf).collect() for b in items if b.text in d.text}
    assert plain and plain <= got
    words = [f"w{i}" for i in range(24)]
    swapped = [w if i % 6 != 4 else "other" for i, w in enumerate(words)]
    rows = [(1, " ".join(["pad"] * 50 + swapped + ["pad"] * 9), 0, "", 0), (2, " ".join(words[:9]), 0, "", 0), (3, None, 0, "", 0), (4, "", 0, "", 0), (None, " ".join(words), 0, "", 0), (5, " ".join(words).upper() + "!", 0, "", 0), (5, "other", 0, "", 0), (6, "pad " * 5000, 0, "", 0)]
    bench = spark.createDataFrame([(7, " ".join(words)), (8, None), (9, "too short"), (None, "")], "item_id long, text string")
    docs = spark.createDataFrame(rows, DOCS)
    found = {r.doc_id: (r.matched_words, r.doc_word) for r in contaminated(docs, bench).collect()}
    assert found == {1: (20, 50), None: (24, 0), 5: (24, 0)}
    import heddle.llm.decontaminate as m

    old, m.BROADCAST_ROWS = m.BROADCAST_ROWS, 0
    try:
        assert {r.doc_id: (r.matched_words, r.doc_word) for r in contaminated(docs, bench).collect()} == found
    finally:
        m.BROADCAST_ROWS = old
    assert contaminated(docs.limit(0), bench).count() == contaminated(docs, bench.limit(0)).count() == 0


def test_decontaminate_passages(spark):
    words = [f"w{i}" for i in range(59)]
    fourth = lambda k: " ".join(w if i % 4 != k else f"other{i}" for i, w in enumerate(words))
    few = [w if i % 6 != 3 else "no" for i, w in enumerate(words[30:45])]
    texts = ["pad " * 20 + " ".join(words[20:45]) + " pad" * 20, *map(fourth, range(4)), " ".join(["pad", *few, "pad"]), " ".join(words[:9]), "so What is it? yes", "it is what", "tiny"]
    docs = spark.createDataFrame([(i, t, 0, "", 0) for i, t in enumerate(texts)], DOCS)
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "what is it"), (3, "Tiny"), (4, "?")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.matched_words, r.item_words, r.doc_word) for r in contaminated(docs, bench).collect()}
    assert got[0, 1] == (25, 59, 0) and got[5, 1] == (13, 59, -29) and got[7, 2] == (3, 3, 1) and got[9, 3] == (1, 1, 0)
    assert set(got) == {(i, 1) for i in range(6)} | {(7, 2), (9, 3)}
    import heddle.llm.decontaminate as m

    old, m.BROADCAST_ROWS = m.BROADCAST_ROWS, 0
    try:
        assert {(r.doc_id, r.item_id): (r.matched_words, r.item_words, r.doc_word) for r in contaminated(docs, bench).collect()} == got
    finally:
        m.BROADCAST_ROWS = old


def jaccard_roots(texts, size, percent):
    sets = []
    for x in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in x or "").encode().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) * 100 >= percent * max(len(sets[i]), len(sets[j])) and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return [len(s) for s in sets], roots(len(sets), links)


@pytest.mark.parametrize("size,percent,rounds,hubs", [(3, 90, 3, 2), (5, 80, 1, 2), (3, 90, 0, 2), (5, 80, 0, 1), (2, 60, 1, 0)])
def test_ngram_join(spark, sf, size, percent, rounds, hubs, monkeypatch):
    monkeypatch.setattr("heddle.llm.ngram_join.HUB_CROWD", 8)
    rng = np.random.default_rng(3)
    vocab = [f"v{i}" for i in range(300)]
    texts = [r.text for r in real_docs(spark, sf).orderBy("doc_id").limit(150).collect()]
    base = rng.choice(vocab, 120).tolist()
    for _ in range(60):
        w = list(base)
        for k in rng.choice(120, rng.integers(0, 6)):
            w[k] = str(rng.choice(vocab))
        texts.append(" ".join(w))
    texts += [" ".join(["hot line that all share"] + rng.choice(vocab, rng.integers(1, 30)).tolist()) for _ in range(40)] + ODD + ["A b", "a\tB", "a", "A"]
    docs = spark.createDataFrame([(i, t, 0, "", 0) for i, t in enumerate(texts)], DOCS)
    sizes, comps = jaccard_roots(texts, size, percent)
    got = {r.doc_id: r for r in ngram_components(docs, size, percent, star_rounds=rounds, hub_rounds=hubs).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == comps


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_difference_prefixes(percent):
    """Of linked sets that do not both link with the hub the prefixes meet."""
    rng = np.random.default_rng(percent)
    freq, linked, c = rng.integers(1, 50, 1 << 20), 0, (100 - percent) / (100 + percent)
    for _ in range(4000):
        y = rng.choice(10_000, rng.integers(5, 40), replace=False)
        change = lambda s, k: np.unique(np.concatenate([rng.choice(s, max(1, len(s) - rng.integers(0, k)), replace=False), rng.choice(10_000, rng.integers(0, k))]))
        a = change(y, 12)
        b = change(a, 4)
        (an, ap, ashort, along), (bn, bp, bshort, blong) = (apart(x, np.sort(y), freq, percent) for x in (a, b))
        if len(np.setxor1d(a, b)) <= c * (len(a) + len(b)) and not (an and bn):
            linked += 1
            (i, k), (j, m) = (ashort, bshort) if an == bn else (ashort if an else along, bshort if bn else blong)
            assert len(set(ap[:i]) & set(bp[:j])) >= min(k, m) > 0
    assert linked > 100


def test_ngram_join_odd(spark):
    got = ngram_components(odd_docs(spark)).collect()
    assert len(got) == len(ODD) + 3 and [r.component_id for r in got if r.doc_id is None] == [None]
    assert ngram_components(odd_docs(spark).limit(0)).count() == 0
    assert len(shingles(None, 3)) == 0


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(i, i + 1) for i in range(500, 560)] + [(600, i) for i in range(601, 700)]
    up = roots(700, edges)
    got = {r.id: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: up[x] for a, b in edges if a != b for x in (a, b)}


@pytest.mark.parametrize("block", [1000, 7])
def test_vectors(spark, sf, block, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(r.vec_id, [float(v) for v in r.embedding]) for r in common.table(spark, sf, "embeddings").collect()]
    near = rng.normal(size=64)
    rows += [(1000 + i, (near + 0.05 * rng.normal(size=64)).astype("f4").astype(float).tolist()) for i in range(60)] + [(1100 + i, rows[0][1]) for i in range(20)]
    bad = [(2000, None), (2001, []), (2002, [0.0] * 64), (2003, [float("nan")] * 64), (2004, [None] + [1.0] * 63), (2005, [float("inf")] + [1.0] * 63), (2006, [1.0, 2.0]), (2007, [1e300, 2e300]), (None, rows[1][1])]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows + bad], "vec_id long, embedding array<double>, label int, id int")
    if block != 1000:
        import heddle.llm.vector_dedup as m

        monkeypatch.setattr(m, "BLOCK", block)
    got = {r.vec_id: r for r in vector_components(df).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    n = np.array([got[r[0]].n_links for r in rows])
    assert (n <= link.sum(1)).all() and n.sum() >= 0.97 * link.sum()
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in range(2000, 2006))
    assert got[2006].n_links == 1 and got[2007].component_id == 2006 and not got[None].kept and got[None].component_id is None
    assert vector_components(df.limit(0)).count() == 0
    assert np.allclose(hadamard(np.eye(4)) @ hadamard(np.eye(4)), 4 * np.eye(4))


def test_pipeline(spark, tok):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    clean = common.stage(p.remove_toxic(spark, docs, sf), "t")
    assert clean.columns == docs.columns
    one = common.stage(p.keep_one_of_near_copies(spark, clean, sf), "t")
    rows = sorted(clean.collect(), key=lambda r: r.doc_id)
    _, comps = jaccard_roots([r.text for r in rows], 5, 80)
    assert sorted(r.doc_id for r in one.collect()) == [rows[i].doc_id for i in range(len(rows)) if comps[i] == i]
    left = common.stage(p.remove_benchmark_text(spark, one, sf), "t")
    assert left.columns == docs.columns and left.count() < one.count()
    check_packed(p.pack_sequences(spark, left, sf).collect(), left.collect(), tok)
    odd = spark.createDataFrame([(1, None, "en", "s", 0), (None, "", "en", "s", 0), (None, "", None, None, None), (2, "x", "en", "s", 1), (2, "x", "en", "s", 1)], docs.schema)
    for _, step in p.STAGES[:3]:
        odd = common.stage(step(spark, odd, sf), "t")
        assert odd.columns == docs.columns
    assert odd.count() == 4
    assert p.pack_sequences(spark, odd.limit(0), sf).count() == 0


def test_ftrl_equals_a_plain_loop():
    """Ftrl.learn against the published update, a coordinate at a time."""
    rng, model = np.random.default_rng(4), Ftrl(alpha=0.2, beta=0.5, l1=0.7, l2=0.3)
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        l1 = 0.0 if i == PLACES else 0.7
        return 0.0 if abs(z[i]) <= l1 else (math.copysign(l1, z[i]) - z[i]) / ((0.5 + math.sqrt(n[i])) / 0.2 + 0.3)

    for _ in range(300):
        idx = np.append(rng.choice(40, 6, replace=False), PLACES)
        label = int(idx[0] < 20)
        w = {int(i): weight(int(i)) for i in idx}
        g = 1 / (1 + math.exp(-sum(w.values()))) - label
        for i, v in w.items():
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.2 * v
            n[i] += g * g
        model.learn(idx, label)
    assert all(abs(model.weights(np.array([i]))[0] - weight(i)) < 1e-9 for i in [*range(40), PLACES])
    assert sum(weight(i) == 0 for i in range(40)) > 0


def test_pipeline_decides_by_row(spark):
    """Clean rows without an id, or with an id that other texts repeat, stay."""
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    item = common.table(spark, sf, "benchmark").orderBy("item_id").first().text
    texts = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcde"}
    rows = [(3, texts["a"]), (5, texts["a"]), (5, texts["b"]), (None, texts["c"]), (None, texts["d"]), (None, texts["d"]), (None, texts["a"]), (6, texts["e"]), (6, item), (None, item), (None, ""), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], common.table(spark, sf, "documents").schema)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for again in (docs, docs.orderBy(F.desc("text"))):
        one = common.stage(p.keep_one_of_near_copies(spark, again, sf), "t")
        got = sorted(((r.doc_id, r.text) for r in one.collect()), key=key)
        assert got == sorted([(3, texts["a"]), (5, texts["b"]), (None, texts["c"]), (None, texts["d"]), (6, texts["e"]), (6, item), (None, ""), (None, "")], key=key)
    left = sorted(((r.doc_id, r.text) for r in p.remove_benchmark_text(spark, docs, sf).collect()), key=key)
    assert left == sorted([r for r in rows if r[1] != item], key=key)
