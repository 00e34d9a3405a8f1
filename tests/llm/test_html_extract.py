import random

from pyspark.sql import functions as F

from sparkassay.llm.html_extract import MAX_LINKS, MIN_STOPS, SHORT_CHARS, STOP_WORDS, extract_pages, main_text

LONG = "This is a long paragraph of the text that is in the article and it is for the reader to read on and on."


def test_article_without_its_surroundings():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no";</script></head>
    <body><header><h1>Site</h1></header><nav><ul><li><a href="/a">the menu of it</a></li></ul></nav>
    <div class="cookie-notice"><p>We use the cookies and this is the notice that is for you to accept it.</p></div>
    <aside class="sidebar"><p>{LONG}</p></aside><div class="ad">The ad is for you and it is in the page.</div>
    <article><h1>Title &amp; more</h1><p>One.</p><p>{LONG}<br>And&nbsp;more   of\n it.</p><ul><li>item of a list</li></ul>
    <div class="share"><a href="#">share</a></div><p>Be.</p></article>
    <section id="comments"><p>This is the comment of a reader and it is as long as the text of the article is in it.</p></section>
    <form><label>Name of the user</label><input></form><footer>&copy; the owner of it</footer></body></html>"""
    got = main_text(page).split("\n\n")
    assert got == ["Title & more", "One.", LONG + " And more of it.", "item of a list", "Be."]


def test_pages_without_article_element():
    page = f"""<body><div id="menu"><a href=x>the</a> <a href=y>menu</a></div><div class="content"><h2>Head</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>
    <div class="comments"><p>{LONG}</p></div><p><a href=z>only a link that is in the page for you to read on and on and on</a></p></body>"""
    assert main_text(page) == "\n\n".join(["Head", LONG, "Short.", LONG])


def test_names_of_wrappers_and_parts():
    wrapped = f'<body><div class="layout has-sidebar page_with_ads"><div class="main-sidebar"><article class="post"><div class="entry-header"><h1>Head</h1></div><p>{LONG}</p>'
    wrapped += f'<div class="post-comments"><article><p>{LONG}</p></article></div><div class="newsletter"><p>{LONG}</p></div></article></div></div></body>'
    assert main_text(wrapped) == f"Head\n\n{LONG}"
    assert main_text(f'<article><p hidden>{LONG}</p><p style="display: none">no</p><p>yes</p></article>') == "yes"


def test_names_are_a_prior_that_text_can_overrule():
    two = f"<p>{LONG}</p><p>Short.</p><p>{LONG}</p>"
    want = f"{LONG}\n\nShort.\n\n{LONG}"
    assert main_text(f'<div id="content" class="post comments-open"><h1>T</h1>{two}</div><div class="comments"><p>{LONG}</p></div>') == f"T\n\n{want}"
    assert main_text(f'<div class="page comments-open"><article>{two}</article></div>') == want
    assert main_text(f'<article><div class="feedback-study">{two}</div></article>') == want
    assert main_text(f'<form id="page-form"><div class="menu">menu</div><h1>T</h1>{two}</form>') == f"T\n\n{want}"
    assert main_text(f'<div class="sidebar main"><h1>T</h1>{two}</div><div class="footer"><p>{LONG}</p></div>') == f"T\n\n{want}"
    # many comments beside a short article stay out
    many = "".join(f'<article class="comment"><p>{LONG}</p></article>' for _ in range(20))
    assert main_text(f'<article><h1>T</h1><p>{LONG}</p></article><div class="comments-area">{many}</div>') == f"T\n\n{LONG}"
    for name in ("sidebar-left", "ad-slot", "postComments", "related-posts", "cookie_notice", "nav-primary", "comment-list", "google_ad"):
        assert main_text(f'<div class="post">{two}<div class="{name}"><p>{LONG}</p></div></div>') == want


def test_other_scripts():
    russian = "\u042d\u0442\u043e \u0430\u0431\u0437\u0430\u0446 \u0441\u0442\u0430\u0442\u044c\u0438, \u043a\u043e\u0442\u043e\u0440\u044b\u0439 \u0447\u0438\u0442\u0430\u044e\u0442. " * 6
    chinese = "\u8fd9\u662f\u4e00\u6bb5\u5f88\u957f\u7684\u6587\u5b57" * 8
    for text in (russian.strip(), chinese):
        page = f'<body><ul><li><a href=x>{text[:12]}</a></li><li><a href=y>{text[:9]}</a></li></ul><h1>{text[:8].strip()}</h1><p>{text}</p><p>{text[:6].strip()}.</p><p>{text}</p></body>'
        assert main_text(page) == "\n\n".join([text[:8].strip(), text, text[:6].strip() + ".", text])


def test_quotes_that_do_not_close():
    assert main_text(f'<article><p>{LONG} <a title="foo>link</a> after</p><p class="x">{LONG}</p></article>') == f"{LONG} link after\n\n{LONG}"
    assert main_text(f"<article><p>{LONG} <a title='it>link</a></p></article>") == f"{LONG} link"
    assert main_text(f'<article><p title="a > b">{LONG}</p><p data-x="<b>">x</p></article>') == f"{LONG}\n\nx"
    assert main_text("<article><p>" + '<a title="' * 20_000) == ""


def plain_labels(blocks):
    """Two-pass labels of a page without names and sections, written the long way."""
    first = []
    for text, links, heading in blocks:
        words = text.lower().split()
        stops = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words)
        if links > MAX_LINKS * len(text):
            first.append("out")
        elif heading or len(text) < SHORT_CHARS or stops / len(words) < MIN_STOPS:
            first.append("?")
        else:
            first.append("in")
    out = []
    for i, label in enumerate(first):
        if label == "?":
            near = [(abs(j - i), j > i, x) for j, x in enumerate(first) if x != "?"]
            if blocks[i][2] and any(later for _, later, _ in near):
                near = [n for n in near if n[1]]
            label = min(near)[2] if near else "out"
        out.append(label == "in")
    return out


def test_labels_against_a_plain_two_pass_form():
    rng = random.Random(3)
    for _ in range(400):
        blocks, page = [], ""
        for _ in range(rng.randint(2, 14)):
            words = [rng.choice(["the", "of", "and"] if rng.random() < 0.4 else ["stone", "river", "garden", "lamp"]) for _ in range(rng.choice([2, 5, 9, 30, 40]))]
            heading = rng.random() < 0.15
            linked = rng.choice([0, 0, 0, len(words), len(words) // 2])
            head, tail = " ".join(words[:linked]), " ".join(words[linked:])
            text = f"{head} {tail}".strip()
            blocks.append((text, len(head), heading))
            tag = "h2" if heading else "p"
            page += f"<{tag}>" + (f"<a href=x>{head}</a> " if head else "") + f"{tail}</{tag}>"
        if sum(len(t) >= SHORT_CHARS for t, *_ in blocks) and sum(any(w in STOP_WORDS for w in t.split()) for t, *_ in blocks) > 1:
            assert main_text(page) == "\n\n".join(b[0] for b, keep in zip(blocks, plain_labels(blocks)) if keep)


def test_broken_markup_and_plain_text():
    assert main_text(None) == main_text("") == main_text("<p></p>") == ""
    assert main_text("only text") == "only text"
    assert main_text("<article><p>a <b>b<p>c</article>") == "a b\n\nc"
    assert main_text("<article>1 < 2 &lt;b&gt; &#228;&#x4f60; <!-- x --> y<p>z") == "1 < 2 <b> ä你 y\n\nz"
    assert main_text("<article><script>never closed <p>x") == ""


def test_long_page_is_whole():
    page = "<article>" + "".join(f"<p>Paragraph {i} of the text.</p>" for i in range(20000)) + "</article>"
    assert main_text(page).count("\n\n") == 19999


def test_table(llm):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", 1), (1, "u", f"<article><p>{LONG}</p></article>", 1), (2, None, None, None), (None, "v", "", 2)]
    df = llm.createDataFrame(rows, "page_id long, url string, html string, N_chars int")
    out = extract_pages(df)
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in out.collect()), key=repr)
    assert got == sorted([(1, "u", LONG, len(LONG))] * 2 + [(2, None, "", 0), (None, "v", "", 0)], key=repr)
    assert extract_pages(df.where("false")).count() == 0
    assert extract_pages(df.withColumn("text", F.lit(3))).select("text").dtypes == [("text", "string")]
