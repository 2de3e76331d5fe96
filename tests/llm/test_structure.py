"""Chat formatting, mixing, URLs, HTML and pieces: round trips, brute force, odd input."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechcurate.llm import chat, html, mixing, pieces, queries, urls
from speechcurate.session import ship_package
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    assert compare(spark, connect(FOLDER), queries.QUERIES[name], queries.ORACLES[name], FOLDER)[0] is None


TURNS = [(1, 0, "user", "<|im_start|>x\\<|im_end|>"), (1, 1, "assistant", "<|<\\|<\\\\| %3C"), (1, 2, None, None), (2, 0, "us%\ner<", "hi"), (None, None, "assistant", ""),
         (3, 1, "assistant", "b"), (3, 1, "assistant", "b"), (3, 0, "system", "\n\n"), (3, 1, "assistant", "a")]


def test_chat_round_trip(spark):
    rows = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = chat.prefix_target_examples(rows)
    read = out.select("*", chat.read_turns(F.col("formatted")).alias("t"), chat.trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("l")).collect()
    for conv in (1, 2, 3, None):
        own = sorted((r for r in read if r.conv_id == conv), key=lambda r: r.example)
        want = sorted(((t, r or "", x or "") for c, t, r, x in TURNS if c == conv), key=lambda x: (x[0] is not None, x))
        assert [(t.role, t.text) for t in own[-1].t] == [w[1:] for w in want]
        assert [r.l for r in own if r.l is not None] == [w[2] for w in want if w[1] == "assistant"]
        for r in own:
            assert len(r.t) == r.n_turns
            if r.l is not None:
                assert (r.t[-1].role, r.t[-1].text) == ("assistant", r.l)
    assert chat.prefix_target_examples(rows.limit(0)).count() == 0


def test_permutation(spark):
    for n in (1, 2, 3, 5, 17, 100, 1009):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(n))


def test_mix_meets_targets(spark):
    mix = mixing.mix_sources(queries.table(spark, FOLDER, "documents"), [5, 2, 1])
    rows = mixing.taken_words(mix).toPandas()
    again = mixing.taken_words(mixing.mix_sources(queries.table(spark, FOLDER, "documents"), [5, 2, 1])).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    assert rows[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    # Brute force: deal, cut at twice the size, deal again.
    sizes = rows.groupby("source")["size"].sum().sort_index()
    weight = dict(zip(sizes.index, [5, 2, 1] * len(sizes)))
    goal, capped = 1.5 * sizes.sum(), {}
    while True:
        free = [s for s in sizes.index if s not in capped]
        fair = {s: (goal - sum(capped.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        if not (over := {s: 2.0 * sizes[s] for s in free if fair[s] > 2 * sizes[s]}):
            break
        capped |= over
    target = {**fair, **capped}
    for s, g in rows.groupby("source"):
        assert g.target.iloc[0] == pytest.approx(target[s]) and g.source_size.iloc[0] == sizes[s]
        assert abs(g.taken.sum() - target[s]) <= max(64, 0.02 * target[s])
    assert (rows.taken <= 2 * rows["size"]).all()
    slots = mix.slots.toPandas()
    assert not slots.duplicated(["sid", "slot"]).any() and slots.groupby(["sid", "block"]).size().max() <= 2
    per_shard = slots.groupby("shard").size()
    assert abs(per_shard.iloc[0] - min(4096, len(slots))) <= 1


def test_mix_odd_rows(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, None, None), (2, "", None), (3, "d " * 1000, None), (4, "e", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    out = mixing.taken_words(mixing.mix_sources(docs, [5, 2, 1], block_words=4)).collect()
    assert len(out) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in out)
    assert {r.source_size for r in out if r.source is None} == {1000}
    empty = mixing.taken_words(mixing.mix_sources(docs.limit(0), [5, 2, 1]))
    assert empty.count() == 0


def test_mix_of_many_equal_rows(spark):
    """Equal rows, a third of all and without id, are one row of each step until they are dealt."""
    rows = [(None, "a b c d e", "x")] * 3_000 + [(i, "f g h", "x") for i in range(3_000)] + [(i, "i " * (i % 5), "y") for i in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.mix_sources(docs, [5, 2, 1], block_words=4)
    out = mixing.taken_words(mix).toPandas()
    assert len(out) == len(rows) and (out.taken <= 2 * out["size"]).all() and out.doc_id.isna().sum() == 3_000
    for _, g in out.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 8
    spans = mix.rows.filter("sid = 0 AND size > 0").orderBy("start").toPandas()
    assert (spans.start.to_numpy()[1:] == (spans.start + spans["size"]).to_numpy()[:-1]).all()


def test_mixed_text(spark):
    rows = [(1, "  a b\tc\n", "x"), (1, "  a b\tc\n", "x"), (None, "p q r s t u v", "x"), (2, "", "x"), (3, "".join(f"w{i}\n " for i in range(1003)), "y"), (4, "e f g", "y"), (5, "z " * 40, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.mix_sources(docs, [5, 2, 1], block_words=4, shard_slots=32)
    pieces = mixing.mixed_pieces(mix).toPandas()
    texts = {r[0]: r[1] for r in rows if r[0]} | {None: "p q r s t u v"}
    for r in pieces.itertuples():
        whole = texts[None if r.doc_id != r.doc_id else r.doc_id]
        assert r.text.split() == whole.split()[r.first_word:r.first_word + r.words] and r.text in whole
    for _, once in pieces.drop_duplicates(["sid", "start", "first_word"]).sort_values("first_word").groupby(["sid", "start"]):
        whole = texts[None if once.doc_id.iloc[0] != once.doc_id.iloc[0] else once.doc_id.iloc[0]]
        if once.words.sum() == len(whole.split()):
            assert "".join(once.text) == whole
    slots = mix.slots.count()
    blocks = sorted(mixing.mixed_blocks(mix).collect(), key=lambda b: (b.shard, b.place))
    assert len(blocks) == slots and [(b.shard, b.place) for b in blocks] == [(i // 32, i % 32 + 1) for i in range(slots)]
    assert all(len(b.text.split()) == sum(s.words for s in b.spans) <= 4 for b in blocks)
    assert all(b.row.doc_id == b.spans[0].doc_id for b in blocks)
    for sid in {b.sid for b in blocks}:
        assert len({b.text for b in blocks if b.sid == sid and len(b.text.split()) < 4}) <= 1
    sources = {r.sid: r for r in mix.sources.collect()}
    for sid, n in pieces.groupby("sid").words.sum().items():
        assert abs(n - sources[sid].target) <= 8


def test_pipeline_mix_meets_targets_with_long_documents(spark):
    import corpus_pipeline

    rows = [(i, "w " * (20_000 if i % 50 == 0 else 50), "en", "abc"[i % 3], 0) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    target = {r.source: r.target for r in mixing.mix_sources(docs, [5, 2, 1], share=1.5, most=2).sources.collect()}
    out = corpus_pipeline.mix(spark, docs, FOLDER)
    assert out.columns == docs.columns
    got = {r.source: r.n for r in out.groupBy("source").agg(F.sum(mixing.count_words(F.col("text"))).alias("n")).collect()}
    assert set(got) == set(target) and all(abs(got[s] - t) <= 128 for s, t in target.items())


def test_url_rules_and_list(spark):
    given = ["HTTP://WWW.Example.COM/en/a", "http://a.example.com/en/x?y#z", "http://com", "http://x.net/es/", "http://telecom/", None, "", "no scheme", "http://bad.org/p/?utm_source=1&b=2&a=1#f",
             "https://www.bad.org:443/p?a=1&b=2", "http://bad.org/q", "http://h?://x"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(given)], "page_id long, url string").withColumn("verdict", F.lit("old"))
    listed = spark.createDataFrame([("http://bad.org/p?a=1&b=2",), ("http://bad.org/p?a=1&b=2",), (None,), ("",)], "url string")
    for blocks in (1 << 18, 1):
        marked = urls.mark_listed(pages, listed, max_blocks=blocks)
        assert {r.page_id for r in marked.filter("listed").collect()} == {8, 9} and marked.count() == len(given)
    out = {r.page_id: r for r in urls.judge_urls(pages, listed, queries.URL_RULES).collect()}
    assert [(out[i].rule, out[i].verdict) for i in range(5)] == [("www.example.com/en/", "allow"), ("example.com/en/", "block"), (None, "allow"), ("net/es/", "block"), (None, "allow")]
    assert (out[5].host, out[5].path, out[7].host, out[11].host, out[11].path) == ("", "", "", "h", "")
    assert out[8].verdict == out[9].verdict == "block" and out[10].verdict == "allow"
    assert urls.judge_urls(pages.limit(0), listed.limit(0), []).count() == 0


PAGE = ("<html><head><title>t</title></head><body><header>H</header><nav>menu</nav><div class='cookie-notice'>c</div><div>Shared by all pages</div><main><h1>Title &amp; more</h1>"
        "<p>First <b>bold</b>\n line<p>Second<br>part<ul><li>one<li>two</ul><aside>side</aside><form>f</form><script>if(a<b){}</script><p>{}</p><div id=comments>reader</div></main>"
        "<footer>foot</footer></body></html>")


def test_html_text():
    page = html.parse(PAGE.replace("{}", "own"))
    shared = html.block_hash("Shared by all pages", html.AROUND)
    assert shared in html.units(page)
    assert html.text_of(page, frozenset(), {shared}) == "Title & more First bold line Second part one two own"
    assert html.text_of(page, frozenset()) == "Shared by all pages Title & more First bold line Second part one two own"
    assert html.text_of(html.parse("plain &lt;b&gt; &eacute;"), frozenset()) == "plain <b> é"
    assert html.text_of(html.parse("<p>cut <b"), frozenset()) == "cut"
    assert html.text_of(html.parse("<div>" * 5000 + "deep"), frozenset()) == "deep"
    assert html.text_of(html.parse(""), frozenset()) == "" and html.text_of(html.parse("<!-- x"), frozenset()) == ""


WRAPS = ['<div class="page has-sidebar">{}</div>', '<div class="layout with-sidebar">{}</div>', '<div id="page-header-banner-wrap">{}</div>',
         '<form id="aspnetForm">{}</form>', '<main><form><div class="menu-open">{}</div></form></main>', '<div role="form">{}</div>']


@pytest.mark.parametrize("wrap", WRAPS)
def test_html_text_in_marked_containers(spark, wrap):
    """An article keeps its text whatever the elements around it are called; on all given pages, too."""
    article = "<article><h1>Title</h1><p>One two three four.</p></article>"
    page = "<body><nav>Menu</nav>" + wrap.format(article) + '<div class="sidebar">Side</div></body>'
    assert html.text_of(html.parse(page), frozenset()) == "Title One two three four."
    pages = [r.html for r in queries.table(spark, FOLDER, "pages").select("html").collect()]
    for whole in pages[:60]:
        begin, end = whole.lower().find("<article"), whole.lower().rfind("</article>")
        if 0 <= begin < end:
            wrapped = whole[:begin] + wrap.format(whole[begin:end + 10]) + whole[end + 10:]
            assert html.text_of(html.parse(wrapped), frozenset()) == html.text_of(html.parse(whole), frozenset())


def test_html_teasers_are_no_main_region():
    page = '<body><div class="sidebar"><article>Teaser</article></div><div><p>' + "Long text. " * 20 + "</p></div></body>"
    assert "Teaser" not in html.text_of(html.parse(page), frozenset())
    assert html.text_of(html.parse("<aside><article>Only teaser</article></aside><p>Text</p>"), frozenset()) == "Text"
    deep = "<article><div>" * 3_000 + "x"
    assert html.text_of(html.parse(deep), frozenset()) == "x"


def test_html_template(spark):
    body = "<body><div>Shared words</div><div>About <b>us</b></div><p>{}</p></body>"
    rows = [(i, "http://h.org/%d" % i, body.replace("{}", f"text {i}")) for i in range(10)]
    rows += [(20, "http://other.org/", body.replace("{}", "alone")), (21, None, None), (22, "http://h.org/e", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("old"))
    for most in (100, 0):
        out = {r.page_id: r.text for r in html.extract_text(pages, max_broadcast=most).collect()}
        assert out[3] == "text 3" and out[20] == "Shared words About us alone" and out[21] == "" and out[22] == "" and len(out) == 13
    assert html.extract_text(pages.limit(0)).count() == 0


def test_html_template_inside_and_outside_main(spark):
    body = "<body><div>Menu</div>{out}<article><h1>Title {i}</h1><p>Our notice.<p>A licence all hosts quote.<p>text {i}<br>Write to us.<ul><li>Newsletter<li>own {i}</ul></article>Imprint</body>"
    rows = [(100 * h + i, f"http://h{h}.org/{i}", body.format(i=f"{h} {i}", out=f"<div>Outside {i}</div>").replace("Our notice", f"Notice of {h}").replace("Write", f"Write {h}").replace("Newsletter", f"Newsletter {h}"))
            for h in range(3) for i in range(8)]
    # What stands around the main regions of five hosts is template on the smallest host, too; what only it has is text.
    rows += [(900, "http://small.org/", body.format(i="alone", out="<div>Outside</div>")), (901, "http://tiny.org/", body.format(i="tiny", out=""))]
    # Copies of one page are no template.
    rows += [(1000 + i, f"http://copies.org/{i}", "<body><article><p>The same text.</article></body>") for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (100, 0):
        out = {r.page_id: r.text for r in html.extract_text(pages, max_broadcast=most).collect()}
        for h in range(3):
            for i in range(8):
                assert out[100 * h + i] == f"Outside {i} Title {h} {i} A licence all hosts quote. text {h} {i} own {h} {i}"
        assert out[900] == "Outside Title alone Our notice. A licence all hosts quote. text alone Write to us. Newsletter own alone"
        assert all(out[1000 + i] == "The same text." for i in range(9))


def test_html_counts_match_brute_force(spark):
    """Units of all given pages, counted in plain Python, with thresholds that some of them pass; and all of a few hosts' pages."""
    pages = queries.table(spark, FOLDER, "pages").select("url", "html")
    made = [(f"http://h{k % 7}.org/{k}", f"<body><div>Top {k % 3}</div><main><p>Note {k % 5 % 2}<p>own {k}</main>{'<i>End</i>' if k % 2 else ''}") for k in range(60)]
    for table in (pages, spark.createDataFrame(made, pages.schema)):
        rows = [(urls_host(r.url), html.parse(r.html or "")) for r in table.collect()]
        seen, sizes = {}, {}
        for host, root in rows:
            page = html._digest(root, {})
            sizes.setdefault(host, set()).add(page)
            for h, kind in html.units(root).items():
                seen.setdefault((h, kind), {}).setdefault(host, set()).add(page)
        want = set()
        for (h, kind), hosts in seen.items():
            n = {host: len(p) for host, p in hosts.items()}
            if kind == html.AROUND:
                want |= {(None, h, len(n))} if len(n) >= 3 else set()
                continue
            for host, c in n.items():
                size = len(sizes[host])
                if kind == html.INSIDE:
                    want |= {(host, h, c)} if c >= 2 and c >= 0.2 * size and c >= 0.6 * sum(n.values()) else set()
                elif c >= 2 and c >= min(0.3 * size, size ** 0.5):
                    want.add((host, h, c))
        got = html.template_hashes(table, min_pages=2, main_share=0.2, own_share=0.6, min_hosts=3).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert any(r.host is None for r in got) and any(r.host for r in got)


def urls_host(url):
    rest = (url or "").partition("://")[2]
    return re.split("[/?#]", rest)[0].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_html_templates_of_sections(spark):
    """Of 120 pages a section has 12 to 30; each has a menu, a notice and, in its main regions, a container of its own."""
    ends, rows = [12, 30, 60, 90, 120], []
    for i in range(120):
        s = next(k for k, e in enumerate(ends) if i < e)
        own = f"<div>Menu of {s}</div><p>Notice of {s}</p>"
        rows.append((i, f"http://big.org/{s}/{i}", f"<body>{own}<p>text {i}</p></body>" if i % 2 else f"<body>{own}<main><p>text {i}</p><section>More of {s}</section></main></body>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r.text for r in html.extract_text(pages).collect()}
    assert all(out[i] == f"text {i}" for i in range(120) if i % 2)
    assert all(out[i] == f"text {i}" for i in range(30, 120))


def test_pieces_round_trip(spark):
    ship_package(spark)
    v = pieces.load_vocabulary()
    given = [None, "", " ", "a  b", "▁ mark\n\n", "日本語 𝒳 é", "q" * 5000, "the end " * 9000, "x\ty\x00"]
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    coded = docs.withColumn("ids", pieces.encode(F.col("text"), F.col("doc_id"), v))
    out = coded.select("*", pieces.decode(F.col("ids"), v).alias("back")).collect()
    assert all(r.back == (r.text or "") for r in out) and out[0].ids == []
    again = docs.repartition(3).withColumn("ids", pieces.encode(F.col("text"), F.col("doc_id"), v)).collect()
    assert {r.doc_id: r.ids for r in again} == {r.doc_id: r.ids for r in out}
    other = docs.withColumn("ids", pieces.encode(F.col("text"), F.col("doc_id") + 100, v)).collect()
    assert {r.doc_id: r.ids for r in other}[7] != {r.doc_id: r.ids for r in out}[7]
    assert docs.limit(0).select(pieces.encode(F.col("text"), F.col("doc_id"), v)).count() == 0


def test_pipeline_reads_each_text_once_into_python(spark, capsys):
    import corpus_pipeline

    given = [None, "", " ", "a  b", "▁ mark\n\n", "日本語 𝒳 é", "q" * 5000, "x\ty\x00"]
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(given)], "doc_id long, text string, lang string, source string")
    out = corpus_pipeline.encode(spark, docs, FOLDER)
    out.explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1
    v = pieces.load_vocabulary()
    coded = docs.withColumn("ids", pieces.encode(F.col("text"), F.xxhash64("doc_id", "text", "lang", "source", F.lit(1).cast("long")), v)).collect()
    assert {r.doc_id: r.ids for r in out.collect()} == {r.doc_id: r.ids for r in coded}
    off, other = np.array([0, 2, 2, 5]), np.frombuffer(b"abxd", np.uint8)
    assert pieces._same_texts(np.frombuffer(b"abcde", np.uint8), off, np.frombuffer(b"abcxe", np.uint8), off).tolist() == [True, True, False]
    assert pieces._same_texts(np.frombuffer(b"abcde", np.uint8), off, other, np.array([0, 2, 3, 4])).tolist() == [True, False, False]


def test_pieces_follow_the_lattice():
    """Sampled segmentations of a short word come as often as the product of their weights says."""
    v = pieces.load_vocabulary()
    text = np.frombuffer(b"there", np.uint8)
    names = {bytes(v.data[v.offsets[i]:v.offsets[i + 1]]): i for i in range(len(v.weight)) if np.isfinite(v.weight[i]) and i not in set(v.byte_ids.tolist())}
    chance = {}

    def walk(at, ids, weight):
        if at == 5:
            chance[tuple(ids)] = np.exp(weight)
        for to in range(at + 1, 6):
            if (i := names.get(b"there"[at:to])) is not None:
                walk(to, [*ids, i], weight + v.weight[i])

    walk(0, [], 0.0)
    n = 40_000
    data, off = np.tile(text, n), np.arange(n + 1) * 5
    ids, at = pieces.encode_run(v, data, off, np.arange(n))
    got: dict = {}
    for a, b in zip(at[:-1], at[1:]):
        got[tuple(ids[a:b].tolist())] = got.get(tuple(ids[a:b].tolist()), 0) + 1 / n
    total = sum(chance.values())
    assert set(got) <= set(chance)
    assert all(abs(got.get(k, 0) - c / total) < 0.012 for k, c in chance.items())
