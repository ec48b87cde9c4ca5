import html
import random
import re
import time

import numpy as np
import pytest

from railloom.llm import block_labeller, html_blocks, html_extract, train_labeller


@pytest.fixture(scope="module")
def labeller():
    return block_labeller.Labeller()


def test_blocks_of_messy_markup():
    page = (
        '<!doctype html><HEAD><title>no</title></HEAD><body class="x"><script>"</p>" < 3</script><nav><a href="a>b">Home</a> page</nav>'
        "<!-- <p>no</p> --><p>a &lt; b &amp c&nbsp;&#233;<b>bo</b>ld<br>next<p>two < three<P>x</p></div></section>tail<style>p{}"
    )
    got = html_blocks.read(page)
    assert got.texts == ["Home page", "a < b & c ébold", "next", "two < three", "x", "tail"]
    assert got.linked[0] == pytest.approx(4 / 9) and got.linked[1:] == [0] * 5
    assert html_blocks.read(None).texts == html_blocks.read("").texts == html_blocks.read("<p> \n</p>").texts == []
    assert html_blocks.read("plain").texts == ["plain"]
    assert html_blocks.read("<a " * 3000 + "x").texts != [] and html_blocks.read("<div>" * 5000 + "deep").texts == ["deep"]


@pytest.mark.parametrize("unit", ["<a ", '<p title="', "<b '", "<!--", "<!x ", "<script", "</", "<select>", "<svg>", "<div>", "<div", "</div>", "<p x=\"'", "<head>", "<p a='\"<"])
def test_a_megabyte_of_broken_markup_is_read_at_once(unit):
    began = time.perf_counter()
    html_blocks.read(unit * (1_000_000 // len(unit)) + "x")
    assert time.perf_counter() - began < 2


def test_text_of_embedded_elements_stays():
    read = lambda page: html_blocks.read(page).texts
    assert read("<p>one<math><mi>x</mi></math> two <svg><text>in</text></svg></p>") == ["onex two in"]
    assert read("a <noscript>b</noscript> <object>c</object> <video>d</video> <canvas>e</canvas>") == ["a b c d e"]
    assert read("<p>a<svg>b<p>c") == ["ab", "c"] and read("<p>a<textarea>b<p>c") == ["a", "b", "c"]  # without an end, both are plain elements
    assert read("<p>a<select><option>b</select>c<script>d</script>e<style>f") == ["a", "c", "e"]
    assert read("a < b, 3 <4, x<b>y</b> <p title='it's'>z") == ["a < b, 3 <4, xy", "z"] and read('<p a="x>y" b>z <i') == ["z <i"]


def test_long_pages_in_stretches(labeller, monkeypatch):
    pages, _ = train_labeller.generated(12, 8)
    whole = labeller.label(pages)
    monkeypatch.setattr(block_labeller, "BATCH_BLOCKS", 7)
    assert all((a == b).all() for a, b in zip(whole, labeller.label(pages), strict=True))


def test_gradients():
    pages, labels = train_labeller.generated(6, 5)
    own, x, lengths = next(block_labeller.batches(pages))
    y = np.zeros(x.shape[:2], bool)
    for k, i in enumerate(own):
        y[: lengths[k], k] = labels[i]
    w = {k: v.astype(float) for k, v in block_labeller.new_weights().items()}
    _, grads = block_labeller.gradients(x, lengths, y, w)
    rng = np.random.default_rng(0)
    for k in w:
        at = tuple(rng.integers(0, n) for n in w[k].shape)
        was, found = w[k][at], []
        for d in (1e-3, -1e-3):
            w[k][at] = was + d
            found.append(block_labeller.gradients(x, lengths, y, w)[0])
        w[k][at] = was
        assert (found[0] - found[1]) / 2e-3 == pytest.approx(grads[k][at], rel=1e-2, abs=1e-6)


def test_held_out_accuracy(labeller):
    blocks, pages = train_labeller.accuracy(labeller, *train_labeller.generated(600, 12345))
    assert blocks > 0.995 and pages > 0.95


def test_labels_depend_on_the_whole_page_but_not_on_the_batch(labeller):
    pages, _ = train_labeller.generated(40, 3)
    together = labeller.label(pages)
    assert all((labeller.label([p])[0] == t).all() for p, t in zip(pages, together))


def test_training_lowers_the_error():
    weights = train_labeller.train(pages=480, epochs=8, seed=2)
    assert train_labeller.accuracy(block_labeller.Labeller(weights), *train_labeller.generated(100, 9))[0] > 0.85


def test_articles_of_the_page_table(spark, labeller):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", article))).split())
        assert got[r.page_id] == want


def test_a_layout_of_divs(labeller):
    rng = random.Random(6)
    right = 0
    for n in range(200):
        say = lambda a, b: " ".join(rng.choice("river stone walk light many times under over café über".split()) for _ in range(rng.randint(a, b)))  # noqa: B023, E731
        paragraphs = [say(8, 70) + "." for _ in range(rng.randint(2, 9))]
        title = say(2, 8)
        page = (
            '<!DOCTYPE html><html><body><div class="top-nav"><ul>' + "".join(f"<li><a href='/{i}'>{say(1, 2)}</a></li>" for i in range(5)) + "</ul></div>"
            f'<div id="cookie-notice">{say(4, 12)} <button>ok</button></div><div class="content"><h1>{title}</h1>'
            + "".join(f"<p>{p}</p>" + ('<div class="advert">' + say(2, 9) + "</div>" if i == 1 else "") for i, p in enumerate(paragraphs))
            + f'</div><div class="sidebar"><h3>{say(1, 3)}</h3><p>{say(3, 20)}</p></div><div id="comments"><div class="comment"><p>{say(3, 40)}</p></div></div>'
            f'<div class="footer">&copy; 20{n % 90 + 10} {say(1, 4)}</div></body></html>'
        )
        right += labeller.main_texts([page])[0] == " ".join([title, *paragraphs])
    assert right >= 180


def test_odd_rows(spark):
    rows = [(1, None, "u", 1), (2, "", "u", 1), (3, "<nav><ul><li><a href='/x'>Home</a></li></ul></nav>", "u", 1), (4, "<article><p>" + "Long words here. " * 30_000 + "</p></article>", "u", 1), (4, "<article><p>Twice.</p></article>", "u", 1), (None, "<article><p>No id at all here.</p></article>", "u", 1)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, html string, text string, n_chars int").repartition(2)).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == sorted(
        [("1", "", 1), ("2", "", 1), ("3", "", 1), ("4", ("Long words here. " * 30_000).strip(), 1), ("4", "Twice.", 1), ("None", "No id at all here.", 1)]
    )
    assert html_extract.extract(spark.createDataFrame([], "page_id long, html string")).collect() == []
