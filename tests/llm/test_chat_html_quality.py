import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scarp.llm import ann, chat, html_blocks, quality
from tests.llm.conftest import HARD

TURNS = "conv_id long, turn long, role string, text string"


def test_conversations_read_back(spark):
    rnd = random.Random(2)
    bits = ["<|im_start|>", "<|im_end|>", "\\", "|", "<", "\n", "n", "ok", "é😀", "<|", "\\n", " "]
    rows = []
    for c in [*range(30), None]:
        for t in range(rnd.randint(1, 9)):
            rows.append((c, t, rnd.choice(["user", "assistant", "system", None, "a\nb", "x\\<|"]),
                         rnd.choice([None, "", "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 12)))])))
    rows += [(100, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(700)] + rows[:3] + [(7, None, "user", "no turn")]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS tree", "2 AS node", "3 AS score").repartition(5)
    got = {r.tree: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    for c in {r[0] for r in rows}:
        own = sorted([(-1 if t is None else t, r or "", x or "") for k, t, r, x in rows if k == c])
        loss = "".join(x for _, r, x in own if r == "assistant")
        e = got[chat.NO_ID if c is None else c]
        assert (e.n_turns, e.loss_chars) == (len(own), len(loss))
        assert e.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert e.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_trees_have_a_path_per_leaf(spark):
    #   0 - 1 - 3        5 (another tree's root with a lost parent)
    #     \ 2 - 4
    rows = [(1, 0, None, "user", "q", 0.0), (1, 1, 0, "assistant", "a1", 1.0), (1, 2, 0, "assistant", "a2", 5.0), (1, 3, 1, "user", "u1", 1.0),
            (1, 4, 2, "user", "u2", 0.0), (2, 5, 99, "user", "alone", 1.0)]
    m = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    found = chat.paths(m)
    assert sorted((r.tree, r.leaf, r.node, r.back) for r in found.collect()) == [
        (1, 3, 0, 2), (1, 3, 1, 1), (1, 3, 3, 0), (1, 4, 0, 2), (1, 4, 2, 1), (1, 4, 4, 0), (2, 5, 5, 0)]
    parts = chat.format_paths(chat.best_paths(found, m, 1), m).collect()
    assert ["".join(p.part for p in parts if p.tree == t) for t in (1, 2)] == [
        "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na2<|im_end|>\n<|im_start|>user\nu2<|im_end|>\n",
        "<|im_start|>user\nalone<|im_end|>\n"]
    assert chat.best_paths(found, m, 2).select("tree", "leaf").distinct().count() == 3
    loop = spark.createDataFrame([(1, 0, 1, "", "", 0.0), (1, 1, 0, "", "", 0.0)], m.schema)
    with pytest.raises(ValueError):
        chat.paths(loop)


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body class="with-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav><div class="ad-box">buy</div><div id="cookie-notice"><div>c</div></div>%s
<footer>&copy; all</footer></body></html>"""


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("plain text", "plain text"), ("a &lt; b &#233; &amp;amp;", "a < b é &amp;"),
    (PAGE % "<article><header><h1>Ti&nbsp;tle</h1></header><p>One <b>two</b>\n three<br>four<p>five<form>f<input></form>"
            "<section class='comments'><p>reader</section><ul><li>six</li></ul></article>", "Ti tle\nOne two three four\nfive\nsix"),
    (PAGE % "<main><p>###</p><p>x <a href=y>link</a> and so on until the end</p><p><a href=z>only a link here</a></p></main>",
     "###\nx link and so on until the end"),
    (PAGE % ("<div><h2>Head</h2><p>%s</p><p>short</p></div><div>junk <a href=q>link one</a></div>" % ("the cat and the dog of it " * 12)),
     "Head\n" + ("the cat and the dog of it " * 12).strip() + "\nshort"),
    ("<article><p>kept</p><nav>never closed<p>also kept</p></article>", "kept\nalso kept"),
    ("<article><ul><li class=ad>ad<ul><li>in ad</ul><li>kept</ul>x<div class=ad>a<div>b</div>c</div>y</article>", "kept\nx\ny"),
    ("<article><p class=ad>ad<p>kept <!-- <p>no</p> --> too</p><script>x</article>", "kept too"),
    ("<article><p title='a>b'>kept</p><p>" + "w " * 50000 + "</p></article>", "kept\n" + ("w " * 50000).strip()),
])
def test_main_text(page, text):
    assert html_blocks.main_text(page or "") == text


STORY = "the cat and the dog of it " * 12


@pytest.mark.parametrize("open_,shut", [
    ("<div class='content-sidebar-wrap'>", "</div>"), ("<div class=has-sidebar>", "</div>"), ("<div class='comments-open'>", "</div>"),
    ("<div class='site has-cookie-banner'>", "</div>"), ("<form action=x>", "</form>"), ("<div id=page-header-share>", "</div>")])
def test_wrappers_stay(open_, shut):
    story = STORY.strip()
    assert html_blocks.main_text(f"<body>{open_}<article><h1>T</h1><p>{STORY}</p></article>{shut}</body>") == f"T\n{story}"
    assert html_blocks.main_text(f"<body>{open_}<h1>T</h1><p>{STORY}</p>{shut}</body>") == f"T\n{story}"
    assert html_blocks.main_text(f"<body>{open_}<p>{STORY}</p><div class=sidebar>x</div>{shut}<div class=sidebar>y</div></body>") == story


@pytest.mark.parametrize("long,short", [
    ("кошка сидит на окне " * 12, "мало слов"), ("猫坐在窗台上看着外面的雨慢慢落下" * 8, "短句"), ("kissa istuu ikkunalla ja katsoo sadetta " * 6, "lyhyt")])
def test_other_languages_stay(long, short):
    long, links = long.strip(), "<ul><li><a href=x>One</a><li><a href=y>Two</a></ul>"
    page = f"<body><div>{links}</div><div><p>{long}</p><p>{short}</p><p>{long}</p></div><p>© all</p></body>"
    assert html_blocks.main_text(page).split("\n")[::2] == [long, long]


def test_linked_blocks_of_an_article():
    page = ("<article><h1><a href=p>Title</a></h1><p>first</p><h2><a href=q>Section</a></h2><p>second</p><p><a href=r>one link</a></p><p>third</p>"
            "<ul><li><a href=x>more</a><li><a href=y>and more</a></ul><p>last</p></article>")
    assert html_blocks.main_text(page) == "Title\nfirst\nSection\nsecond\none link\nthird\nlast"
    assert html_blocks.main_text(f"<div><h1><a href=p>Title</a></h1><p>{STORY}</p></div>") == f"Title\n{STORY.strip()}"


def test_teasers_in_article_marks():
    story = STORY.strip()
    cards = "".join(f"<article><h3><a href=x>Card {i}</a></h3><p>a teaser</p></article>" for i in range(3))
    assert html_blocks.main_text(f"<div><h1>T</h1><p>{STORY}</p><p>{STORY}</p></div><p><a href=z>More</a></p>{cards}").startswith(f"T\n{story}\n{story}")
    part = f"<main><h1>T</h1><p>{STORY}</p><p>short</p></main><p>{STORY}</p><p>outside</p>"
    assert html_blocks.main_text(part) == f"T\n{story}\nshort\n{story}"


def test_extract_rows(spark):
    rows = [(1, "u", "<article><p>a</p></article>"), (1, "u", "<article><p>a</p></article>"), (2, None, None), (None, "v", "é")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' AS text", "0 AS n_chars")
    got = sorted(map(str, map(tuple, html_blocks.extract(df).collect())))
    assert got == sorted(map(str, [(1, "u", "a", 1), (1, "u", "a", 1), (2, None, "", 0), (None, "v", "é", 1)]))
    assert html_blocks.extract(df.limit(0)).count() == 0


def test_pages_of_the_test_table(spark):
    """The article's paragraphs and nothing else, with and without the article's mark."""
    import html
    import re
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    same = 0
    for p in pages:
        inner = re.search(r"<article>(.*)</article>", p.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        expect = "\n".join(b for b in blocks if b)
        assert html_blocks.main_text(p.html) == expect
        same += html_blocks.main_text(p.html.replace("article>", "div>")) == expect
    assert same >= 0.95 * len(pages)


def plain_measure(t):
    w = (t or "").encode().split()
    three = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    under = {i + k for i, x in enumerate(three) if three.count(x) > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if x.encode().split()]
    return (len(w), sum(len(x.decode()) for x in w), sum((t or "").count(c) for c in "#*$%&|<>"),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(under), len(lines))


def test_measures():
    rnd = random.Random(1)
    for t in ["".join(rnd.choice(["a ", "b ", "c ", "é\n", "#", "\t", "a b\n"]) for _ in range(rnd.randint(0, 80))) for _ in range(300)]:
        assert quality.measure(t.encode()) == plain_measure(t)


def test_quality_by_group(make_docs):
    rnd = random.Random(3)
    clean = lambda: " ".join(rnd.choice(["this", "that", "words", "longer", "of"]) + str(rnd.randint(0, 999)) for _ in range(80))
    rows = [(1000 + i, clean()) for i in range(400)]
    rows += [(5000, " ".join(x + "###" for x in clean().split())), (5001, "word " * 100), (5002, clean().replace(" ", "z" * 9 + " "))]
    got = {r.doc_id: r for r in quality.verdicts(make_docs(rows + HARD, extra=True)).collect() if r.doc_id not in (6, None)}
    assert all(got[i].kept for i in range(1000, 1400))
    assert not any(got[i].kept for i in (5000, 5001, 5002)) and not got[5000].base_failed and got[5001].base_failed
    assert all(got[i].base_failed for i, t in HARD if i in got and len((t or "").split()) < 50)
    kept = quality.keep_good(make_docs(rows + HARD, extra=True))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(1000, 1400)) and "places" in kept.columns
    assert quality.verdicts(make_docs([])).count() == 0 and quality.keep_good(make_docs([])).count() == 0


def test_small_groups_use_wider_sketches(spark):
    rows = [(i, "a" * (i % 5 + 3) + " bb" * 60, "en", "big", 1) for i in range(200)] + [(900, "b" + " cc" * 60, "en", None, 1), (901, "b" + " cc" * 60, None, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    limits = {(r.lang, r.source): r.fence for r in quality.thresholds(quality.measures(df)).collect()}
    assert set(limits) == {("en", "big"), ("en", None), (None, "x")}
    assert all(f.word_length.high is not None for f in limits.values())


def brute(rows, queries, k=5):
    ids = [i for i, _ in rows]
    v = np.array([x for _, x in rows], float)
    n = np.sqrt((v * v).sum(1))
    out = {}
    for q in queries:
        w = v[ids.index(q)]
        s = (v * w).sum(1) / (n * np.sqrt((w * w).sum()))
        out[q] = sorted(((-x, i) for x, i in zip(s, ids) if i != q))[:k]
    return out


def test_nearest_recall_and_ties(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=32)]) for i in range(3000)]
    same = [float(x) for x in rng.normal(size=32)]
    rows += [(3000 + i, same) for i in range(500)]          # more copies than any query can take
    bad = [(9000, None), (9050, []), (9100, [0.0] * 32), (9150, [None] + [1.0] * 31), (9200, [float("nan")] * 32), (9250, [float("inf")] * 32),
           (9300, [1.0, 2.0]), (None, same)]
    df = spark.createDataFrame(rows + rows[:5] + bad, "vec_id long, embedding array<double>").selectExpr("*", "1 AS v", "2 AS file", "3 AS key")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    queries = [i for i, _ in rows if i % 50 == 0]
    expect = brute(rows, queries)
    assert set(got) == set(queries)
    hits = sum(len({i for _, i in expect[q]} & {i for _, i, _ in got[q]}) for q in queries)
    assert hits >= 0.9 * 5 * len(queries)
    for q in queries:
        assert [r for r, _, _ in sorted(got[q])] == [1, 2, 3, 4, 5]
    assert [i for _, i, _ in sorted(got[3000])] == [3001, 3002, 3003, 3004, 3005]
    assert [i for _, i, _ in sorted(got[3400])] == [3000, 3001, 3002, 3003, 3004]


def test_nearest_of_few(spark):
    kind = "vec_id long, embedding array<float>"
    assert ann.nearest(spark.createDataFrame([], kind), F.col("vec_id") % 50 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [3.0, 0.0])], kind)
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(one, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 1.0), (0, 2, 1, 0.0)]


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_on_the_test_tables(spark, sf):
    df = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    queries = [i for i, _ in rows if i % 50 == 0]
    expect, got = brute(rows, queries), {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len({i for _, i in expect[q]} & got[q]) for q in queries) >= 0.95 * 5 * len(queries)


def test_running_text_outside_the_article_needs_support():
    story = STORY.strip()
    comment = "<div class=entry><p>" + story[:len(story) // 2] + "</p></div>"
    teaser = "<div class=card><h3>Next</h3><p>" + story[:len(story) // 2] + "</p></div>"
    page = f"<article><h1>T</h1><p>{STORY}</p><p>{STORY}</p><p>{STORY}</p></article>{comment}<p><a href=x>More</a></p>{teaser}"
    assert html_blocks.main_text(page) == "\n".join(["T", story, story, story])
    part = f"<main><h1>T</h1><p>{STORY}</p><p>{STORY}</p></main><div><p>{STORY}</p></div>"       # main holds a part of the story
    assert html_blocks.main_text(part) == "\n".join(["T", story, story, story])


def test_time_is_linear_in_nested_and_unclosed_tags():
    import time
    story = f"<h1>T</h1><p>{STORY}</p>"
    for page in ("<div class='widget'>" * 40_000 + story + "</div>" * 40_000, "<p class='ad'>" * 60_000 + "</p>" + story,
                 "<div class='ad'>" * 60_000 + story, "<div class=widget>" + "<a href=x>l " * 60_000 + story + "</div>",
                 "<title>" * 60_000 + story, "<li class=ad>x" * 60_000 + story, '<a title="x>' * 20_000 + story):
        t = time.process_time()
        html_blocks.main_text(page)
        assert time.process_time() - t < 10, page[:40]
