import random
import time

from gramweave.llm.html_extract import main_text, op9_html_extraction

LONG = "A sentence of some length, with commas, that fills the paragraph well enough. " * 3


def test_article_without_surroundings():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no</p>";</script></head><body class="has-sidebar">
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>hid</p> -->
    <div id="main"><article class="post"><header class="entry-header"><h1>Head &amp; tail</h1></header><p>{LONG}<br>next&nbsp;line<p>Second <b>bo</b>ld
      text &#233;&lt;<ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table><form><p>Form</p></form><div class="ad-box"><p>Buy</p></div><blockquote><p>Quote</p></blockquote>
      <aside><p>Aside</p></aside><p hidden>Hidden</p></article><section id="comments"><p>{LONG}</p></section></div><div class="sidebar"><p>{LONG}{LONG}</p></div>
    <footer><p>Foot</p></footer></body></html>"""
    want = ["Head & tail", f"{LONG} next line", "Second bold text é<", "one", "two", "c1", "c2", "Quote"]
    assert main_text(page) == "\n".join(" ".join(x.split()) for x in want)


def test_container_is_found_by_score():
    links = "".join(f'<p><a href="/{i}">{LONG}</a></p>' for i in range(9))
    page = f"<body><div>{links}</div><div><div><p>{LONG}</p><p>{LONG}</p></div><div><p>{LONG}</p></div><div><p>x</p></div></div></body>"
    assert main_text(page) == "\n".join([LONG.strip()] * 3)


def test_text_beside_and_below_the_best_container():
    text = LONG.strip()
    assert main_text(f"<body><h1>Title</h1><p>Short one.</p><div><p>{LONG}</p><p>{LONG}</p></div><p>{LONG}</p><p>End.</p></body>") == "\n".join(["Title", "Short one.", text, text, text, "End."])
    assert main_text(f"<body><div><div><p>{LONG}</p></div><div><p>Brief.</p></div><div><p>{LONG}</p></div></div></body>") == "\n".join([text, "Brief.", text])
    chunks = "".join(f'<div class="c"><div><p>{LONG}{i}</p></div></div>' for i in range(6))
    assert main_text(f'<body><div><a href="/">Home</a> <a href="/n">News</a></div><div id="post">{chunks}</div></body>') == "\n".join(f"{LONG}{i}" for i in range(6))
    assert main_text('<body><ul><li><a href="/">Home</a><li><a href="/n">News</a></ul></body>') == "Home\nNews"


def test_class_words_do_not_remove_the_text():
    text = LONG.strip()
    assert main_text(f'<body><div class="no-sidebar wrap"><p>{LONG}</p></div><p>{LONG}{LONG}</p></body>') == f"{text}\n{text} {text}"
    assert main_text(f'<body><div class="header-2 related"><p>{LONG}</p><p>{LONG}</p></div><div class="sidebar"><p>Aside</p></div><p>End.</p></body>') == f"{text}\n{text}\nEnd."
    assert main_text(f'<body><div class="share-layout"><article><p>{LONG}</p></article></div><div class="ad">Buy</div></body>') == text
    comment = f'<div class="comments"><article><p>{LONG}{LONG}</p></article></div>'
    assert main_text(f"<body><article><p>{LONG}</p></article>{comment}</body>") == text
    assert main_text('<div class="ad">' * 3000 + "deep") == "deep"


def test_marked_words_within_a_block():
    assert main_text(f'<article><p>{LONG}One <span class="share">Tweet</span> two <a class="related" href="/">More</a>three.</p></article>') == f"{LONG}One two three."
    assert main_text(f'<body><span class="header">{LONG}</span></body>') == LONG.strip()
    assert main_text(f'<div class="with-sidebar"><p>{LONG}</p></div>') == LONG.strip() == main_text(f'<div class="sidebar"><p>{LONG}</p></div>')


def brute(body):
    """The method as the module states it, over a tree of (tag, class, children), children being nodes or (text, linked) blocks; every question walks the tree anew."""
    foreign, doubtful = {"ad", "ad-box", "sidebar"}, {"alert"}

    def nodes(n):
        return [n] + [x for c in n[2] if len(c) == 3 for x in nodes(c)]

    def own(n):
        return [c for c in n[2] if len(c) == 2]

    def block_points(b):
        return 0 if b[1] else 1 + b[0].count(",") + min(len(b[0]) / 100, 3)

    parents = {id(c): n for n in nodes(body) for c in n[2] if len(c) == 3}

    def chain(n):
        return [n] + (chain(parents[id(n)]) if id(n) in parents else [])

    def everything(n):
        return [b for x in nodes(n) for b in own(x)]

    def chars(n):
        return sum(len(t) for t, _ in everything(n))

    def has_article(n):
        return any(x[0] == "article" for x in nodes(n))

    def taken_out(n):
        if n is body or n[1] not in foreign | doubtful or (n[0] == "article" and n[1] in ("sidebar", "alert")):
            return False
        if 2 * chars(n) > chars(body) and (not has_article(body) or (has_article(n) and n[1] not in ("ad", "ad-box"))):
            return False
        linked = sum(len(t) for t, is_link in everything(n) if is_link)
        return n[1] in foreign or not chars(n) or 0.5 * sum(map(block_points, everything(n))) * (1 - linked / chars(n)) < 2

    def stays_in(n):
        return not any(taken_out(x) for x in chain(n))

    def text(n):
        return [b for x in nodes(n) if stays_in(x) for b in own(x)]

    def density(n):
        return sum(len(t) for t, linked in text(n) if linked) / max(1, sum(len(t) for t, _ in text(n)))

    def points(n):
        return sum(map(block_points, own(n))) + sum(points(c) / 2 for c in n[2] if len(c) == 3 and stays_in(c))

    def value(n, total=None):
        marked = n[1] in foreign or (n[1] in doubtful and n[0] != "article")
        if n[0] == "article" and n[1] == "sidebar":
            marked = False
        if total is None:
            total = points(n) * (2 if n[0] == "article" else 1)
        return total * (1 - density(n)) * (0.5 if marked else 1)

    def worth_of(n):
        return value(n, sum(map(block_points, text(n))))

    def emit(n, menus=False, parts=None):
        got = []
        for c in n[2] if parts is None else parts:
            if len(c) == 3:
                got += emit(c, menus) if stays_in(c) else []
            elif menus or not (c[1] and density(n) > 0.5):
                got.append(c[0])
        return got

    candidates = [n for n in nodes(body) if stays_in(n) and text(n)]
    if not candidates:
        return ""
    best = max(candidates, key=value)
    articles = [x for x in chain(best) if x[0] == "article"]
    kept = articles[0] if articles else best
    if not articles:
        for up in chain(best)[1:]:
            more = sum(map(block_points, text(up))) - sum(map(block_points, text(kept)))
            if more >= 0.3 * sum(map(block_points, text(kept))):
                kept = up

    def worth(c):
        if len(c) == 2:
            return not c[1]
        if not stays_in(c) or not text(c):
            return False
        if c[0] == "article":
            return density(c) <= 0.5
        plain = [x for x in kept[2] if len(x) == 3 and x[0] != "article" and stays_in(x)]
        sentence = kept is not body and density(c) == 0 and emit(c, menus=True)[-1].endswith(".")
        return worth_of(c) >= 0.2 * max(map(worth_of, plain)) or sentence

    if kept[0] == "article":
        inner = emit(kept)
    else:
        places = [i for i, c in enumerate(kept[2]) if worth(c)]
        inner = emit(kept, parts=kept[2][places[0] : places[-1] + 1]) if places else []
    got = []
    for c in parents[id(kept)][2] if id(kept) in parents else [kept]:
        if c is kept:
            got += inner or emit(kept, menus=True)
        elif len(c) == 3:
            if stays_in(c) and text(c) and worth_of(c) >= max(2, 0.2 * worth_of(kept)) and density(c) < 0.3:
                got += emit(c)
        elif not c[1] and len(c[0]) >= 80 and block_points(c) >= 2:
            got.append(c[0])
    return "\n".join(got)


def test_scoring_against_brute_force():
    r = random.Random(6)

    def grow(depth):
        tag = r.choice(["div", "div", "div", "section"] + ["article"] * with_articles)
        parts = []
        for _ in range(r.choice([1, 2, 4])):
            if depth and r.random() < 0.5:
                parts.append(grow(depth - 1))
            else:
                words = " ".join(r.choice(["one", "two,", "three", "fourteen"]) for _ in range(r.choice([1, 5, 40, 90])))
                parts.append((words.rstrip(",") + r.choice(["", "."]), r.random() < 0.2))
        return tag, r.choice(["", "", "", "", "ad", "ad-box", "sidebar", "alert", "form-of-government", "no-sidebar"]), parts

    def show(n):
        inner = "".join(show(c) if len(c) == 3 else f"<p>{f'<a>{c[0]}</a>' if c[1] else c[0]}</p>" for c in n[2])
        return f'<{n[0]} class="{n[1]}">{inner}</{n[0]}>'

    outcomes = set()
    for k in range(1200):
        with_articles = k % 2
        body = [grow(3) for _ in range(r.choice([1, 2, 3]))]
        if r.random() < 0.3:
            body.insert(r.randrange(len(body) + 1), ("loose text, here", r.random() < 0.3))
        want = brute(("body", "", body))
        assert main_text("".join(show(c) if len(c) == 3 else f"<p>{f'<a>{c[0]}</a>' if c[1] else c[0]}</p>" for c in body)) == want
        outcomes.add(min(want.count("\n"), 5))
    assert len(outcomes) > 4


def test_scores_decide_where_no_tag_does():
    text = "".join(f"<p>{LONG}{i}</p>" for i in range(3))
    want = "\n".join(f"{LONG}{i}" for i in range(3))
    for before, after in (
        ("<div>Sign in</div><div>My account</div>", "<div>All rights reserved</div>"),
        ('<div><a href="/">Home</a> <a href="/n">News</a></div><div>We use cookies to improve this, and so on.</div>', "<div>\u00a9 2024 Example. All rights reserved.</div>"),
        ("<div><div>Menu</div><div>Search</div></div>", "<div><p>Imprint</p><p>Contact</p></div>"),
    ):
        assert main_text(f"<body>{before}<div>{text}</div>{after}</body>") == want
        assert main_text(f"<body><div>{before}<div><div>{text}</div></div>{after}</div></body>") == want
        chunks = "".join(f"<div><div><p>{LONG}{i}</p></div></div>" for i in range(3))
        assert main_text(f"<body>{before}<div>{chunks}</div>{after}</body>") == want
    assert main_text(f"<body><div>Login</div><h1>Head</h1><div>{text}</div></body>") == f"Head\n{want}"


def test_class_names_count_as_a_whole():
    inner = '<section id="form-of-government"><p>Parliament sits.</p></section><div class="social-history"><p>Villages grew.</p></div><p class="alert">A storm, they said, was near the coast.</p>'
    page = f'<body><article><p>{LONG}</p>{inner}<div class="cookie-notice">We use cookies.</div><div class="alert">Log in.</div><p class="ad">Buy, buy, buy.</p></article><p>{LONG}</p><p>Imprint</p></body>'
    assert main_text(page) == "\n".join([LONG.strip(), "Parliament sits.", "Villages grew.", "A storm, they said, was near the coast.", LONG.strip()])


def test_time_grows_with_the_page():
    for piece in ("<div><p>x</p>", "<b>x", '<div class="ad">x', "<ul><li>a", "<table><tr><td>x", "<b><i></b>", '<span class="ad">x'):
        started = time.process_time()
        main_text(piece * 100_000)
        assert time.process_time() - started < 10, piece


def test_odd_pages():
    for page in (None, "", "   ", "<", "<p", "<!-- open", "<script>x", "<nav>a", "</p></div>", "<a<b>", "<p class='"):
        assert isinstance(main_text(page), str)
    assert main_text("just text & more") == "just text & more"
    assert main_text("<p>a<p>b</p></p>c") == "a\nb\nc"
    assert main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert main_text("<article>" + "<p>w</p>" * 5000 + "</article>").count("\n") == 4999
    assert main_text("<article>x &amp y &unknown; 3 < 4</article>") == "x & y &unknown; 3 < 4"


def test_query(spark):
    df = spark.createDataFrame([(1, None, None, 3), (2, "u", "<p>é漢</p>", 3), (2, "u", "<p>é漢</p>", 3), (None, "v", "", 3)], "page_id long, url string, html string, n_chars int")
    got = sorted(map(str, (tuple(r) for r in op9_html_extraction(df).collect())))
    assert got == sorted(map(str, [(1, None, "", 0), (2, "u", "é漢", 2), (2, "u", "é漢", 2), (None, "v", "", 0)]))
    assert op9_html_extraction(df.limit(0)).count() == 0
