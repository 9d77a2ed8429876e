"""HTML extraction, embeddings and the pipeline."""

import html as library
import re

import numpy as np
import pytest

from tarn.llm import blocks, html, vectors


def article(page):
    """The article of the test tables' pages, by their own tags."""
    m = re.search("<article>(.*?)</article>", page, re.S)
    parts = re.split("</?(?:p|h1)>", m[1]) if m else []
    found = [" ".join(library.unescape(re.sub("<br>", " ", x).replace("<b>", "")).split()) for x in parts]
    return "\n\n".join(x for x in found if x)


def test_pages_query(spark, data):
    import duckdb

    rows = duckdb.sql(f"SELECT page_id, url, html FROM '{data}/pages.parquet'").fetchall()
    out = html.op5_html(spark, data).collect()
    assert {(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in out} == {(p, u, article(h), len(article(h))) for p, u, h in rows}
    assert len(out) == len(rows)


PAGE = """<!doctype html><html><head><title>No &lt;title&gt;</title><script>if (a < b) document.write("<p>no</p>")</script><style>p > a {}</style></head>
<body class="nav-open"><div id="cookie-notice">We use cookies <form><input name=q><button>no</button></form></div>
<header class="masthead"><h2>Site name</h2><ul><li><a href="/">menu</a></ul></header>
<div class="layout"><main><article class=post><header><h1>Head &amp; tail</h1><p>byline</p></header>
<p>One <b>bold</b>word&nbsp;and   a <a href='x>y'>link</a>.<p>Two<br>lines &eacute;&#233; a &lt; b 3 < 4
<ul><li>first<li>second</ul><!-- <p>no</p> --><div class="ad">Buy</div><div hidden>no</div><aside>no</aside>
<blockquote>Quote</blockquote><table><tr><td>c1<td>c2</table><pre>a
 b</pre></article>
<section class="comments"><article class="comment"><p>A reader's very long comment, longer than the article itself, on and on and on and on and on and on and on</p></article></section></main>
<div class="sidebar">no</div></div><footer>&copy; all</footer></body></html>"""
TEXT = ["Head & tail", "One boldword and a link.", "Two lines éé a < b 3 < 4", "first", "second", "Quote", "c1", "c2", "a b"]


def test_what_belongs_to_the_article():
    assert html.cut(PAGE) == "\n\n".join(TEXT)
    assert html.cut(PAGE, html.Wrapper.learn([PAGE])) == html.cut(PAGE, html.Wrapper.learn([PAGE, PAGE])) == "\n\n".join(TEXT)


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("plain text", "plain text"),
        ("<p>a<p>b", "a\n\nb"),
        ("<article><p>cut off <b>he", "cut off he"),
        ("<article>x</article", "x"),
        ("<article>x <a href=\"un closed>y</article>", "x y"),
        ("<article>a<!-- open", "a"),
        ("<article>a &amp b &am c &#x41; &bogus;</article>", "a & b &am c A &bogus;"),
        ("<nav>menu</nav><footer>foot</footer>", ""),
        ("<article></article><p>outside", ""),
        ("<div class='main wrap'><div id=post-content><div class=entry-header><h1>t</h1><p>by</p></div><p>text of the article</div><p>more</div>", "t\n\ntext of the article"),
        ("<div class=topnav>n</div><div class=text>a</div><div class='side-bar'>s</div><div class=comment-list>c</div><div class=cookiebar>k</div>", "a"),
        ("<main><div class=teaser>t</div><article>a</article><article class=comment>c</article></main>", "a"),
        ("<div>a<div>b</div>c</div>", "a\n\nb\n\nc"),
        ("<ARTICLE><P>x</P></ARTICLE><p>outside", "x"),
        ("<body><textarea><article>no</article></textarea><main>m</main>", "m"),
    ],
)
def test_markup(page, text):
    assert html.cut(page) == text


def test_wrapper_of_differing_pages():
    page = lambda *body: f"<body><nav><a>home</a></nav><div class=box>{''.join(body)}</div><p>All rights reserved</p></body>"
    pages = [page("<h2>t1</h2><p>a</p><p>b</p>"), page("<h2>t2</h2><p>c</p><ul><li>x</li><li>y</li></ul>"), page("<h2>t3</h2><p>d</p><p>e</p><p>f</p>")]
    wrapper = html.infer(pages)
    assert str(wrapper) == "<><body><nav>'home'</><div.box><h2>#</><p>#</>+<ul><li>#</>+</>?</><p>'All rights reserved'</></></>"
    places = html.Wrapper.of(wrapper, 3)
    # The same text on every page is the template's, slots are the page's own.
    assert html.cut(pages[1], places) == "t2\n\nc\n\nx\n\ny"
    assert html.cut(page("<h3>new place</h3>"), places) == "new place"
    assert "(<h3>#</> <p>#</>)+" in str(html.infer(["<div><h3>a</h3><p>b</p><h3>c</h3><p>d</p><h3>e</h3><p>f</p></div>"]))


def test_pages_are_parsed_by_the_expression():
    page = lambda t, *items, ad="": f"<body><p>Site</p><div><h2>{t}</h2>{''.join(f'<p>{x}</p><h3>{x}h</h3><ul><li>{x}1<li>{x}2</ul>' for x in items)}{ad}<p>Terms of use</p></div></body>"
    pages = [page("a", "x", "y"), page("b", "z"), page("c", "u", "v", "w")]
    wrapper = html.infer(pages)
    learned = html.Wrapper.of(wrapper, 3)
    # The group takes in any number of turns; the last p stands at their path, but is another part of the expression.
    names = lambda p: [(t, i) for t, i, _ in learned.match(html.parse(p))]
    of = dict(names(page("d", "q", "r", "s", "t")))
    assert None not in of.values() and len({of[x] for x in "qrst"} | {of["q1"], of["s2"]}) == 2 and of["Terms of use"] not in (of["q"], of["q1"])
    assert learned.freed([]).spec == learned.spec
    assert html.cut(page("d", "q", "r"), learned) == "d\n\nq\n\nqh\n\nq1\n\nq2\n\nr\n\nrh\n\nr1\n\nr2"
    assert html.cut(page("e", "q", ad="<pre>new</pre>"), learned) == "e\n\nq\n\nqh\n\nq1\n\nq2\n\nnew"


def test_parts_that_are_merged_again_keep_what_is_in_them():
    page = lambda *parts: "<body><div class=box><h1>t</h1>" + "".join(f"<{x[0]}>{x[1]}</{x[0]}>" for x in parts) + "</div></body>"
    h, p = lambda x: ("h2", x), lambda x: ("p", x)
    pages = [page(h("a"), p("b"), p("c"), h("d"), p("e"), p("f"), p("g")), page(h("i"), p("j"))]
    learned = html.Wrapper.learn(pages)
    assert html.cut(pages[0], learned) == "\n\n".join("abcdefg") and html.cut(pages[1], learned) == "i\n\nj"


def test_sequences_of_any_length_are_aligned():
    from random import Random

    r = Random(6)
    for n, cells in ((12, 1 << 18), (60, 9), (60, 400)):
        for letters in ("ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"):
            for _ in range(40):
                p, q = r.choices(letters, k=r.randrange(n)), r.choices(letters, k=r.randrange(n))
                html.CELLS, found = cells, None
                found = html._matches(p, q)
                html.CELLS = 1 << 18
                assert all(p[i] == q[j] for i, j in found) and all(a < c and b < d for (a, b), (c, d) in zip(found[:-1], found[1:]))
                if cells == 1 << 18:
                    best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
                    for i, j in ((i, j) for i in range(len(p)) for j in range(len(q))):
                        best[i + 1][j + 1] = best[i][j] + 1 if p[i] == q[j] else max(best[i][j + 1], best[i + 1][j])
                    assert len(found) == best[-1][-1]


def test_deep_and_wide_pages(spark):
    import time

    deep = lambda x, n=5000: "<article>" + "<div>" * n + f"<p>{x}" + "</div>" * n + "</article>"
    wide = lambda x, n=50_000: "<article>" + "".join(f"<div class=c{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}><p>{x}{i}</div>" for i in range(n)) + "</article>"
    flat = lambda x: "<body>" + "".join(f"<p>{x}{i}</p>" for i in range(50_000)) + "</body>"
    began = time.time()
    made = [(1, "http://d/1", deep("a")), (2, "http://d/2", deep("b", 4000)), (3, "http://d/3", "<article><p>c</article>"), (4, "http://w/1", wide("x")), (5, "http://w/2", wide("y")[:1_000_000] + "<p>end"), (6, "http://f/1", flat("u")), (7, "http://f/2", flat("v"))]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(made, "page_id long, url string, html string")).collect()}
    assert (got[1], got[2], got[3]) == ("a", "b", "c") and got[5].endswith("end")
    assert got[4] == "\n\n".join(f"x{i}" for i in range(50_000)) and got[6].split("\n\n")[-1] == "u49999" and got[7].count("\n\n") == 49_999
    # Other labels in another order: no table of 50,000 by 50,000.
    a, b = wide("x", 20_000), wide("y", 40_000).replace("class=c", "class=d", 15_000)
    assert html.cut(b, html.Wrapper.learn([a, b])).count("\n\n") == 39_999
    assert time.time() - began < 300


def boxed(title, *body):
    return f"<body><div class=box><h2>{title}</h2>{''.join(body)}</div><p>All rights reserved</p></body>"


def test_text_of_one_page_is_no_template():
    pages = [boxed("t1", "<p>a</p><p>b</p>", "<blockquote>Quote one</blockquote>"), boxed("t2", "<p>c</p><p>d</p>"), boxed("t3", "<p>e</p><p>f</p>")]
    places = html.Wrapper.learn(pages)
    assert [html.cut(p, places) for p in pages] == ["t1\n\na\n\nb\n\nQuote one", "t2\n\nc\n\nd", "t3\n\ne\n\nf"]
    assert html.cut(boxed("t4", "<p>g</p>", "<blockquote>Another</blockquote>"), places) == "t4\n\ng\n\nAnother"


def test_template_is_the_same_on_all_pages_of_the_host(spark):
    # All pages but one of the 60 have the same h3, so no sample of 8 that misses the one can tell.
    made = [(i, f"http://{h}/{i}", boxed(f"t{i}", f"<p>a{i}</p><p>b{i}</p>", "<h3>Notes</h3>" if h == "same" or i != odd else "<h3>Other notes</h3>", f"<pre>c{i}</pre>" if i == 7 else "")) for odd, h in ((11, "one"), (12, "two"), (13, "three"), (0, "same")) for i in range(60)]
    made += [(100, "http://same/100", ""), (101, "http://same/101", None), (102, "http://same/102", "<body></body>")]  # no text, so nothing that differs
    got = {(r["url"]): r["text"] for r in html.extract(spark.createDataFrame(made, "page_id long, url string, html string")).collect()}
    assert len(got) == len(made) and not any("All rights" in x for x in got.values())
    for i, url, page in made:
        if i < 60:
            notes = [] if "//same/" in url else ["Other notes" if "Other" in page else "Notes"]
            assert got[url].split("\n\n") == [f"t{i}", f"a{i}", f"b{i}", *notes, *([f"c{i}"] if i == 7 else [])]


def test_pages_edges(spark):
    made = [(1, None, PAGE, 0), (2, "", None, 0), (3, "http://h/x", "", 0), (4, "HTTP://user@H:80/y?z", "<p>one", 0), (4, "HTTP://user@H:80/y?z", "<p>one", 0), (None, "nonsense", "<article>x", 0), (5, "http://h/", "<article>" + "<p>long text " * 20_000, 0)]
    df = spark.createDataFrame(made, "page_id long, url string, html string, text int").selectExpr("*", "1 AS host", "2 AS wrapper")
    out = html.extract(df).collect()
    got = {r["page_id"]: r["text"] for r in out}
    assert len(out) == len(made) and got[1] == "\n\n".join(TEXT) and got[2] == got[3] == "" and got[4] == "one" and got[None] == "x"
    assert got[5].count("long text") == 20_000
    assert [r["host"] for r in df.select(html.host(df["url"]).alias("host")).collect()] == ["", "", "h", "h", "h", "", "h"]
    assert html.extract(df.where("false")).count() == 0
    assert {r["host"] for r in html.wrappers(df).collect()} == {"", "h"}


@pytest.mark.parametrize("block", [3, 8, 1000])
def test_blocks_meet_once(spark, block):
    import pyarrow as pa

    def pairs_of(t, pairs):
        if pairs is None:
            i, j = np.nonzero(np.triu(blocks.comparable(t)))
        else:
            i, j = pairs
        a = t["a"].to_numpy()
        return pa.RecordBatch.from_arrays([t["key"].combine_chunks().take(pa.array(i)), pa.array(np.minimum(a[i], a[j])), pa.array(np.maximum(a[i], a[j]))], ["key", "x", "y"])

    groups = {1: [0] * 40 + [1] * 9 + [2, 3, 4], 2: [5] * 20, 3: [6, 7], 4: list(range(10, 50)), 5: [8], 6: [9] * 30 + [1] * 30}
    keyed = [(k, 1000 * k + i, c) for k, own in groups.items() for i, c in enumerate(own)]
    c = {a: c for _, a, c in keyed}
    df = spark.createDataFrame(keyed, "key long, a long, c long")
    every = sorted((k, a, b) for k, own in groups.items() for i in range(len(own)) for j in range(i + 1, len(own)) for a, b in [(1000 * k + i, 1000 * k + j)])
    for frame in (df.drop("c"), df):
        got = sorted(map(tuple, blocks.in_blocks(frame, df.select("a"), pairs_of, "key long, x long, y long", block).collect()))
        assert len(got) == len(set(got)) and set(got) <= set(every)
        if "c" not in frame.columns:
            assert got == every
        else:
            assert {x for x in got if c[x[1]] != c[x[2]]} == {x for x in every if c[x[1]] != c[x[2]]}
            # What is in one part of more than a block meets nothing of its own.
            assert not any(c[a] == c[b] and list(c.values()).count(c[a]) > block and groups[k].count(c[a]) > block for k, a, b in got)


def near_brute(made, threshold=0.9):
    good = {}
    for i, v in made:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v) / np.linalg.norm(np.array(v, float))
    ids = sorted(good)
    near = {a: [b for b in ids if b != a and len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold] for a in ids}
    out = {i: (0, i, True) for i, _ in made}
    for a in ids:
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out[a] = (len(near[a]), min(seen), min(seen) == a)
    return out


@pytest.mark.parametrize("block, whole", [(512, 4096), (16, 4096), (16, 25), (512, 3)])
def test_vectors_equal_brute_force(spark, monkeypatch, block, whole):
    monkeypatch.setattr(vectors, "WHOLE", whole)  # links of larger components are counted table by table
    monkeypatch.setattr(blocks.in_blocks, "__defaults__", (block,))  # small blocks: groups are dealt to pairs of blocks
    r = np.random.default_rng(1)
    centers = r.standard_normal((6, 24))
    rows = [c + s * r.standard_normal(24) for c, n, s in zip(centers, (80, 30, 20, 5, 2, 1), (0.05, 0.2, 0.3, 0.4, 0.1, 0.1)) for _ in range(n)]
    rows += list(r.standard_normal((150, 24))) + [rows[0]] * 9 + [rows[1] * 3]
    made = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    got = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in vectors.near_vectors(spark.createDataFrame(made, "vec_id long, embedding array<double>")).collect()}
    assert got == near_brute(made)


def test_vectors_of_a_chain(spark, monkeypatch):
    monkeypatch.setattr(vectors, "WHOLE", 10)
    # Each is like some neighbours, the ends are unlike; copies count.
    made = [(i, [float(np.cos(i / 9)), float(np.sin(i / 9)), 0.0]) for i in range(50)]
    made += [(100 + i, v) for i, v in made[:20]]
    for kind in ("double", "float"):
        got = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in vectors.near_vectors(spark.createDataFrame(made, f"vec_id long, embedding array<{kind}>")).collect()}
        assert got == near_brute(made)


def test_vectors_edges(spark):
    nan, inf = float("nan"), float("inf")
    made = [(1, [1.0, 0.0]), (2, [2.0, 0.001]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0]), (10, [-1.0, 0.0]), (11, [1e-30, 0.0]), (12, [1e30, 0.0]), (0, [0.5, 0.0]), (13, [0.0, 1.0])]
    df = spark.createDataFrame([(*m, "x") for m in made] + [(None, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x")], "vec_id long, embedding array<float>, n_links string")
    out = vectors.near_vectors(df).collect()
    assert len(out) == len(made) + 2
    got = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in out}
    assert got.pop(None) == (0, None, True)
    assert got == near_brute(made) and got[2] == (4, 0, False)
    assert vectors.near_vectors(df.where("false")).count() == 0


def test_pipeline_edges(spark, documents, tmp_path):
    import corpus_pipeline as pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string, _lang long"
    some = [(d, t, x, s) for d, t, x, s in documents if t and len(t) > 300][:60]
    own = max(some, key=lambda r: len(r[1]))[1]
    line = "A line that very many of these documents share, in which forty characters stand"
    made = [(d, t, x, s, len(t), "clash", 1) for d, t, x, s in some]
    made += [(d, f"{t}\n{line}", x, s, 0, "clash", 1) for d, t, x, s in [(10_000 + i, own.replace(" ", f" x{i} ", 40), "en", None) for i in range(6)]]
    made += [(20_000, own + " end", None, "src1", 5, None, None)] * 3 + [(20_001, None, "en", "src0", 0, None, None), (20_002, "", "en", "src0", 0, None, None), (20_003, "1 2 3", "en", "src0", 0, None, None)]
    made += [(None, some[0][1], "en", "src2", 9, None, None), (None, some[0][1], None, "src2", 8, None, None), (20_004, own * 40, "en", "src3", None, None, None)]
    docs = spark.createDataFrame(made, schema)
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    assert [c for c in pipeline.run(spark, folder).columns if c == "ids"] == ["ids"]
    kept = pipeline.keep_languages(spark, docs, folder)
    assert kept.columns == list(pipeline.COLUMNS)
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(20_000) == 3 and ids.count(None) == 2 and 20_004 in ids and not {20_001, 20_002, 20_003} & set(ids)
    out = pipeline.drop_lines(spark, docs, folder).collect()
    assert len(out) == len(made) and sum(line in r["text"] for r in out) == 1 and all(r["n_chars"] == len(r["text"]) for r in out)
    once = pipeline.drop_copies(spark, docs, folder)
    assert once.columns == list(pipeline.COLUMNS)
    rows = [tuple(r) for r in once.collect()]
    assert len(rows) == len(set(rows)) and sum(r[0] is None for r in rows) == 1 and [r[2] for r in rows if r[0] is None] == [None]
    assert {20_001, 20_002, 20_003} <= {r[0] for r in rows} and not any(r[0] == 20_000 for r in rows)  # a copy of one of smaller doc_id
    # Alone, three rows that are the same are one.
    same = docs.where("doc_id = 20000")
    assert same.count() == 3 and pipeline.drop_copies(spark, same, folder).count() == 1
    mixed = pipeline.mix_sources(spark, docs, folder)
    assert mixed.columns == list(pipeline.COLUMNS) and 0 < mixed.count() < len(made)
    coded = pipeline.encode(spark, docs, folder).collect()
    assert len(coded) == len(made) and all(r["ids"] == [] and r["n_tokens"] == 0 for r in coded if r["doc_id"] in (20_001, 20_002))
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.where("false"), folder).count() == 0


def test_pipeline_equals_brute_force(spark, data, documents):
    """Stage by stage, each on what the one before kept."""
    import corpus_pipeline as pipeline
    import duckdb

    from tarn.llm import mixing
    from tests.llm.test_text_operators import near_brute as near_text

    assert [name for name, _ in pipeline.STAGES] == ["language_id", "line_dedup", "minhash", "mixing", "bpe"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = [f(spark, docs, data) for _, f in pipeline.STAGES[:1]][0]
    assert kept.columns == list(pipeline.COLUMNS) and kept.count() >= 0.97 * len(documents)
    for (name, stage), check in zip(pipeline.STAGES[1:4], ("lines", "near", "mix")):
        before = [tuple(r) for r in kept.collect()]
        after = stage(spark, kept, data)
        assert after.columns == list(pipeline.COLUMNS)
        got = sorted((r["doc_id"], r["text"], r["n_chars"]) for r in after.collect())
        if check == "lines":
            key = lambda x: x.strip(" \t\n\x0b\f\r").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).decode()
            held = {}
            for d, t, *_ in before:
                for x in t.split("\n"):
                    held.setdefault(key(x), set()).add(d)
            gone = {k: max(v) for k, v in held.items() if len(k) >= 40 and len(v) >= 5}
            cut = {d: "\n".join(x for x in t.split("\n") if gone.get(key(x), d) == d) for d, t, *_ in before}
            assert got == sorted((d, t, len(t)) for d, t in cut.items())
        elif check == "near":
            top = near_text([(d, t) for d, t, *_ in before], 5, 80, 100)
            assert [x[0] for x in got] == sorted(d for d in top if top[d][2])
        else:
            con = duckdb.connect()
            con.execute("CREATE TABLE docs (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
            con.executemany("INSERT INTO docs VALUES (?, ?, ?, ?, ?)", before)
            expected = con.sql(f"WITH {mixing.mixing_sql('docs', 1, (9, 10))} SELECT doc_id FROM mx_out WHERE n_copies > 0 ORDER BY 1").fetchall()
            assert [x[0] for x in got] == [x[0] for x in expected]
        kept = spark.createDataFrame(after.collect(), after.schema)
    out = pipeline.STAGES[4][1](spark, kept, data).collect()
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in kept.collect()} and all(len(r["ids"]) == r["n_tokens"] for r in out)
    whole = pipeline.run(spark, data)
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in whole.collect()) == sorted((r["doc_id"], r["ids_sha256"]) for r in out)
