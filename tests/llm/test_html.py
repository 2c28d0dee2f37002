import html as escapes
import random

from crystalspark.llm import html_blocks as hb


def page(rng, article=True):
    """A page and its main text."""
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n))
    main = [words(rng.randint(4, 9))] + [words(rng.choice([1, 2, 15, 40, 90])) for _ in range(rng.randint(2, 9))]
    body = f"<h1>{main[0]}</h1>"
    for i, t in enumerate(main[1:]):
        body += rng.choice(["<p>{}</p>", "<p>{}", "<p><b>{}</b></p>", "<div>{}</div>", "<p>\n {} <br/>\n"]).format(t)
        if rng.random() < 0.2:
            body += f"<div class='ad-box'>{words(12)}</div>"
    side = f"<aside><h2>{words(2)}</h2><p>{words(30)}</p></aside>"
    noise = f"<header><a href='/'>{words(1)}</a></header><nav><ul>" + "".join(f"<li><a href='/{k}'>{words(1)}</a></li>" for k in range(5)) + "</ul></nav>"
    foot = f"<section id=\"comments\"><p>{words(25)}</p></section><form><label>{words(2)}</label><textarea>{words(4)}</textarea></form><footer>&copy; {words(6)}</footer>"
    cookie = f"<div class='cookie-notice'>{words(20)}</div>"
    wrap = "<article>{}</article>" if article else "<div class=\"content\">{}</div>"
    out = f"<!DOCTYPE html><html><head><title>{words(4)}</title><style>p{{}}</style><script>var t='<p>x</p>';</script></head><body>{cookie}{noise}<!-- <p>old</p> -->{wrap.format(body)}{side}{foot}"
    return out + ("</body></html>" if rng.random() < 0.8 else ""), "\n".join(main)


def test_pages(spark):
    rng = random.Random(5)
    made = [page(rng) for _ in range(80)]
    rows = [(i, f"u{i}", p, "clash") for i, (p, _) in enumerate(made)]
    rows += [(900, "n", None, "c"), (901, "e", "", "c"), (902, "t", "plain text only here", "c"), rows[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars string")
    found = hb.extract(df).collect()
    assert len(found) == len(rows)
    by = {r.page_id: r for r in found}
    assert all(by[i].text == t for i, (_, t) in enumerate(made))
    assert by[900].text == by[901].text == "" and by[902].text == "plain text only here" and by[902].n_chars == 20
    assert hb.extract(df.limit(0)).collect() == []


def test_pages_without_article_element():
    rng, tree = random.Random(6), hb.train()
    right = total = 0
    for _ in range(100):
        p, want = page(rng, article=False)
        got = set(hb.main_text(p, tree)[0].split("\n"))
        want = set(want.split("\n"))
        right += len(got & want)
        total += len(got | want)
    assert right / total > 0.95


def test_references_and_white_space():
    tree = hb.train()
    p = f"<article><p>{escapes.escape('a < b & c')} &amp;amp; &#233;&nbsp;\n\t x</p><p>two<br>lines <b>bold</b><i>er</i></p><ul><li>one<li>two</ul></article>"
    assert hb.main_text(p, tree)[0] == "a < b & c &amp; é x\ntwo lines bolder\none\ntwo"
    assert hb.main_text("<article><p>open <b>never closed <p>next<script>if (a<b) x()</script> rest", tree)[0].startswith("open never closed\nnext")
    assert hb.main_text("<main><p>" + "word " * 50000 + "</p></main>", tree)[0].count("word") == 50000


def test_tree_fits_its_table():
    import numpy as np

    rows = np.array(hb.LABELLED, dtype=float)
    assert (hb.classify(hb.train(), rows[:, :-1]) == (rows[:, -1] > 0)).mean() > 0.97


def neighbours_of(tree):
    return set() if tree[0] == "leaf" else {hb.FEATURES[tree[0]]} | neighbours_of(tree[2]) | neighbours_of(tree[3])


def test_tree_looks_at_words_and_links_of_neighbours():
    used = neighbours_of(hb.train())
    assert {"links", "words"} <= used and used & {"before_words", "after_words"} and used & {"before_links", "after_links"}


def test_names_that_only_hold_a_part():
    tree = hb.train()
    inside = "<div class='related-work'>one two</div><p class='share-price'>three</p><h2 id='comment-on-results'>four</h2><p>x <math><mi>a</mi><mo>+</mo><mn>1</mn></math> y</p>"
    assert hb.main_text(f"<article>{inside}</article>", tree)[0] == "one two\nthree\nfour\nx a+1 y"
    assert hb.main_text("<article><p>a</p><div class='ad-box'>no</div><ul class='share-buttons'><li>no</li></ul><section id='comments'><p>no</p></section><p>b</p></article>", tree)[0] == "a\nb"
    assert hb.main_text("<article><p>a</p><span class='ad'><span>no</span>buy <b>now</b></span><p>b</p></article>", tree)[0] == "a\nb"


def test_links_between_paragraphs_of_a_bare_page():
    tree, long = hb.train(), "word " * 30
    menu = "".join(f"<li><a href='/{i}'>item {i}</a></li>" for i in range(5))
    bare = f"<body><ul>{menu}</ul><div>|</div><ul>{menu}</ul><p>{long}</p><p><a href='x'>a whole sentence that is one link</a></p><p>{long}</p><ul>{menu}</ul></body>"
    assert hb.main_text(bare, tree)[0] == "\n".join([long.strip(), "a whole sentence that is one link", long.strip()])


def test_markup_agrees_with_a_backtracking_pattern():
    import re

    pattern = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
    rng = random.Random(4)
    pieces = ["<", "<a", "</a", "<b ", "<a x='", '<a y="', "'", '"', ">", " ", "/", "x", "<!--", "-->", "<![CDATA[", "]]>", "<!", "<?", "=", "<1", "\n", "é", "\x1c"]
    for _ in range(20_000):
        page = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        expected = [(m.start(), m.end(), m.group(1) or "", m.group(2) or "", m.group(3) or "") for m in pattern.finditer(page)]
        assert list(hb.Markup(page)) == expected, page


def test_unfinished_markup_takes_linear_time():
    import time

    for unit in ("<a ", "<a x='", "<a", "<a'", "<!", '<a x="y\' '):
        took = []
        for size in (200_000, 1_600_000):
            began = time.process_time()
            hb.blocks(unit * (size // len(unit)))
            took.append(time.process_time() - began)
        assert took[1] < 30 * took[0] + 1, unit  # 64 times if it were quadratic, and far more than a second
