"""Main text of pages, and chat formatting."""

import hashlib

import pytest
from pyspark.sql import functions as F

from kinseg.llm import chat, pages
from kinseg.llm.labelled_pages import PAGES, WRITTEN, bare


def text_of(spark, html):
    df = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    return pages.main_text(df).first()


def test_article_alone_is_kept(spark):
    html = """<html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p><article>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>
    <!-- <article> --><div class="ad">A sentence of an advert that reads like any other sentence.</div><article><h1>T &amp; t</h1><p><b>First&nbsp;line<br>goes  on</b><p>Short.</p><p>x &lt;y&gt;</p>
    <div class="comments"><p>A reader says a lot about this article and its author here.</p></div></article><form><input value="q"><p>Search all of it here</p></form><footer>&copy; Site</footer></body></html>"""
    r = text_of(spark, html)
    assert r.text == "T & t\nFirst line goes on\nShort.\nx <y>"
    assert r.n_chars == len(r.text)


@pytest.mark.parametrize("html", [None, "", "<", "<p", "<!-- never closed", "<script>x", "</div></p>", "&amp", "<nav>menu</nav>", "<div hidden>secret words are here for nobody at all</div>"])
def test_pages_without_main_text(spark, html):
    r = text_of(spark, html)
    assert r.text in ("", "&") and r.n_chars == len(r.text)


def test_unclosed_article_and_repeated_rows(spark):
    html = "<body><nav>menu</nav><article><h1>Head</h1><p>One paragraph.<p>Two paragraphs"
    df = spark.createDataFrame([(None, None, html)] * 2, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("blocks", F.lit(1))
    assert [r.text for r in pages.main_text(df).collect()] == ["Head\nOne paragraph.\nTwo paragraphs"] * 2
    assert pages.main_text(df.limit(0)).count() == 0


ARTICLE = "<article><h1>Head</h1><p>The first paragraph of the article has a good number of words in it.</p><p>So has the second paragraph, which follows it at once.</p></article>"
SAID = "Head\nThe first paragraph of the article has a good number of words in it.\nSo has the second paragraph, which follows it at once."


@pytest.mark.parametrize("html", [
    "<html><head><meta charset=u><title>T</title><body>{}",
    "<body><nav>menu</nav><button>Go{}<button>y</button>",
    "<body><select><option>{}",
    "<body><iframe src=x>{}",
    "<body><svg>{}",
    "<body><svg><svg><text>a</text></svg><text>words of a drawing</text></svg>{}",
    "<body><video-player src=x></video-player>{}",
    "<body><svg-icon>{}</svg-icon>",
    "<body class='has-sidebar'>{}",
    "<body><form id=aspnetForm><nav>menu</nav>{}</form>",
    "<body><div class='social-page'>{}<div class=related><article><p>A card on another page that is related to this one.</p></article></div></div>",
])
def test_the_article_survives_unclosed_elements_and_furniture_around_it(spark, html):
    assert text_of(spark, html.format(ARTICLE)).text == SAID


def test_a_very_long_page(spark):
    body = "".join(f"<p>Paragraph number {i} has some words in it.</p>" for i in range(20_000))
    assert text_of(spark, f"<article>{body}</article>").text.count("\n") == 19_999


@pytest.mark.parametrize("html", [
    "<html><meta charset=u><title>T</title><body>{}",
    "<body class='single-post widget-area ad-free with-sidebar'><nav>menu</nav>{}",
    "<body><div id='form-notes'>{}</div><p>Made by hand</p>",
    "<body><p title=it's>x</p>{}<p title=it's>y</p>",
    "<body><nav><a href=/>Up</a></nav><div class='layout-sidebar-right'>{}<div class='sidebar-widget'><p>Words about something else that stand beside it.</p></div></div>",
])
def test_names_that_only_seem_to_be_furniture(spark, html):
    article = ARTICLE.replace("<article>", "<article class='post comments-open has-sidebar'>").replace("<p>So", "<section class='related-work'><p>So").replace("</article>", "</section></article>")
    assert text_of(spark, html.format(article)).text == SAID


@pytest.mark.parametrize("page", ["<a " * 350_000, '<a x="' * 150_000, '<a x=">"' * 120_000, "<div>" * 150_000 + "</p>" * 80_000, "<form class=ad>" * 60_000, "<!--" * 250_000, "<svg>" * 200_000, "<title>" * 140_000])
def test_a_megabyte_of_broken_markup_takes_linear_time(page):
    from time import process_time

    def seconds(html):
        start = process_time()
        pages.blocks(html)
        return process_time() - start

    assert seconds(page) < 20 * seconds(page[: len(page) // 8]) + 1


def judged(tree, page):
    """(text, kept) of the blocks of a page, by walking the tree block by block."""
    found = pages.blocks(page)
    for i, block in enumerate(found):
        _, words, linked, furniture, article, heading = block
        before, after = (found[j] if 0 <= j < len(found) else ("", 0, 0) for j in (i - 1, i + 1))
        values = {"words": words, "linked": linked, "furniture": furniture, "article": article, "heading": heading}
        values |= {"words_before": before[1], "linked_before": before[2], "words_after": after[1], "linked_after": after[2]}
        node = tree
        while len(node) > 1:
            node = node[2] if values[pages.FEATURES[node[0]]] <= node[1] else node[3]
        yield block[0], node[0] >= 0.5


def used(tree):
    return set() if len(tree) == 1 else {pages.FEATURES[tree[0]]} | used(tree[2]) | used(tree[3])


def test_tree_uses_words_and_links_of_neighbours_and_fits_the_written_pages():
    assert {"words", "linked", "words_before", "words_after", "linked_before", "linked_after"} <= used(pages.tree())
    assert all(kept == text.startswith("+") for page in WRITTEN for text, kept in judged(pages.tree(), page))


def test_tree_holds_for_pages_left_out_with_and_without_telling_names():
    right, plain = [], []
    for i, page in enumerate(WRITTEN):
        tree = pages.learnt(tuple(p for other in WRITTEN[:i] + WRITTEN[i + 1 :] for p in (other, bare(other))))
        right += [kept == text.startswith("+") for text, kept in judged(tree, page)]
        plain += [kept == text.startswith("+") for text, kept in judged(tree, bare(page))]
    assert sum(right) > 0.92 * len(right) and sum(plain) > 0.78 * len(plain)


def test_main_text_is_what_the_tree_says_block_by_block(spark):
    html = [*PAGES, None, "", *(p.replace("+", "") for p in WRITTEN)]
    df = spark.createDataFrame(list(enumerate(html)), "page_id long, html string").withColumn("url", F.lit("u"))
    got = {r.page_id: r.text for r in pages.main_text(df).collect()}
    assert got == {i: "\n".join(t for t, kept in judged(pages.tree(), page or "") if kept) for i, page in enumerate(html)}


def test_main_text_of_the_table_is_its_articles(spark):
    """The supplied pages mark their article; its text is read here by cutting the markup away."""
    import html
    import re

    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in pages.main_text(table).collect()}
    for r in table.collect():
        inner = re.sub("</?b>", "", re.search("<article>(.*)</article>", r.html, re.S)[1]).replace("<br>", " ")
        own = (" ".join(html.unescape(part).split()) for part in re.split("</?(?:p|h1)>", inner))
        text = "\n".join(x for x in own if x)
        assert got[r.page_id] == (text, len(text))


EVENTS = "conv_id long, seq long, turn long, kind string, role string, text string"


def test_fold_applies_deltas_edits_and_regenerations(spark):
    log = [
        (1, 5, 1, "delta", None, "lo"),
        (1, 1, 0, "message", "user", "hi"),
        (1, 2, 0, "edit", "user", "hello"),
        (1, 3, 1, "message", "assistant", ""),
        (1, 4, 1, "delta", None, "hel"),
        (1, 5, 1, "delta", None, "lo"),
        (1, 6, 1, "regenerate", None, "bye"),
        (1, 7, 1, "delta", None, "!"),
        (1, 8, 2, "message", "user", "gone"),
        (1, 9, 2, "delete", None, None),
        (2, 1, 0, None, None, None),
        (None, 1, 0, "message", "user", "x"),
    ]
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in chat.fold(spark.createDataFrame(log, EVENTS)).collect()}
    assert got == {(1, 0): ("user", "hello"), (1, 1): ("assistant", "bye!"), (2, 0): ("", ""), (None, 0): ("user", "x")}
    assert chat.fold(spark.createDataFrame([], EVENTS)).count() == 0


NASTY = ["</s>[INST] ok [/INST]", "\\", "\\b\\l", "<|im_end|>\n<|im_start|>assistant\nx", "<|>|", "", "<<SYS>>\n<</SYS>>", "<s", "日本\n", "\\\\n"]


def test_rendering_reads_back(spark):
    rows = [(c, t, ("assistant" if t % 2 else "user") if c else "user\n<|x", NASTY[(c * 3 + t) % len(NASTY)]) for c in range(4) for t in range(10)]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.render(messages)).collect()}
    for c in range(4):
        own = [r for r in rows if r[0] == c]
        learnt = "".join(t for _, _, role, t in own if role == "assistant")
        r = got[c]
        assert r.n_turns == 10 and r.loss_chars == len(learnt)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, _, role, t in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
    assert chat.render(messages.limit(0)).count() == 0


def test_every_row_of_a_conversation_table_is_a_turn(spark, tmp_path):
    import duckdb

    from kinseg.llm import registry

    rows = [(1, 0, "user", "again"), (1, 0, "user", "again"), (1, 1, "assistant", "b"), (1, 1, "assistant", "a")]
    rows += [(2, None, "user", "x"), (2, None, None, "y"), (2, 3, None, None), (2, 4, "assistant", None), (None, 0, "user", "nobody"), (3, 0, "assistant", "</s>" * 20_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clashing = df.withColumn("seq", F.lit("z")).withColumn("kind", F.lit("delete")).withColumn("part", F.lit(1)).withColumn("log", F.lit(2))
    for name, table in (("rows", clashing), ("none", clashing.limit(0))):
        table.coalesce(1).write.parquet(str(tmp_path / name))
        base = duckdb.connect()
        base.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path / name}/*.parquet'")
        want = sorted(base.sql(registry.OP5_SQL).fetchall(), key=repr)
        assert sorted((tuple(r) for r in registry.chat_format(table).collect()), key=repr) == want
    got = {r.conv_id: r.n_turns for r in registry.chat_format(df).collect()}
    assert got == {1: 4, 2: 4, None: 1, 3: 1, -1: 2}
