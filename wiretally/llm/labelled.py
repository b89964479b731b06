"""Labelled pages to train the extraction on: layouts of common kinds, each block marked as main text or not."""

import random

_SYLLABLES = "ka lo mi ren tor ves da nu pel shi or an the ing ed er ly tion".split()


def _words(rng, low, high):
    return " ".join("".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high)))


def _sentences(rng, low=1, high=6):
    return " ".join(_words(rng, 1, 24).capitalize() + rng.choice(["."] * 5 + ["?", "!", "", " |", "***"]) for _ in range(rng.randint(low, high)))


def _page(rng):
    """One page: [(html before, text, html after, label)], main text 1."""
    out = []

    def put(before, text, after, label):
        out.append((before, text, after, label))

    def some(chance):
        return rng.random() < chance

    def menu(open_, close):
        put(open_, "", "", 0)
        for _ in range(rng.randint(2, 9)):
            put('<li><a href="/x">', _words(rng, 1, 3), "</a></li>", 0)
        put("", "", close, 0)

    def side(open_, close, low=1, high=4):
        put(open_, "", "", 0)
        for _ in range(rng.randint(low, high)):
            if some(0.4):
                put('<p><a href="/y">', _words(rng, 2, 9), "</a></p>", 0)
            else:
                put("<p>", _sentences(rng, 1, 3), "</p>", 0)
        put("", "", close, 0)
    if some(0.3):
        side(*rng.choice([('<div class="cookie-notice">', "</div>"), ('<div id="consent" role="dialog">', "</div>"), ('<div class="alert notice">', "</div>")]), 1, 2)
    if some(0.6):
        side(*rng.choice([("<header>", "</header>"), ('<div class="site-header">', "</div>"), ('<div id="masthead">', "</div>")]), 1, 2)
    if some(0.8):
        menu(*rng.choice([("<nav><ul>", "</ul></nav>"), ('<div class="menu"><ul>', "</ul></div>"), ('<ul id="navigation">', "</ul>")]))
    if some(0.7):
        side(*rng.choice([('<div class="ad">', "</div>"), ('<div class="ads sponsored">', "</div>"), ('<div id="promo">', "</div>"), ('<aside class="advert">', "</aside>")]), 1, 2)
    before_side = some(0.3)
    sides = [("<aside>", "</aside>"), ('<div class="sidebar">', "</div>"), ('<div id="related">', "</div>"), ('<section class="widget">', "</section>")]
    if before_side:
        side(*rng.choice(sides))
    shell = rng.choice([("<article>", "</article>"), ("<article>", "</article>"), ('<article class="post">', "</article>"), ("<main>", "</main>"),
                        ('<main><article>', "</article></main>"), ('<div class="article-content">', "</div>"), ('<div id="content"><div class="entry">', "</div></div>"),
                        ('<div class="story">', "</div>"), ('<section class="post-body">', "</section>")])
    put(shell[0], "", "", 1)
    if some(0.9):
        h = rng.choice(["h1", "h1", "h2"])
        put(f"<{h}>", _words(rng, 1, 12) + rng.choice(["", "", ".", "?"]), f"</{h}>", 1)
    for _ in range(rng.randint(1, 14)):
        kind = rng.random()
        if kind < 0.66:
            put(rng.choice(["<p>", "<p>", "<p><b>", "<p><em>"]), _sentences(rng, 1, 8), rng.choice(["</p>", "</p>", "<br>", ""]), 1)
        elif kind < 0.74:
            put("<p>", _words(rng, 1, 9).capitalize() + rng.choice([".", ".", "", " |", "***", ","]), "</p>", 1)
        elif kind < 0.82:
            put("<h2>", _words(rng, 1, 8), "</h2>", 1)
        elif kind < 0.88:
            put("<blockquote>", _sentences(rng, 1, 3), "</blockquote>", 1)
        elif kind < 0.94:
            put("<ul><li>", _sentences(rng, 1, 2), "</li></ul>", 1)
        elif kind < 0.97:
            put('<p>See <a href="/z">', _words(rng, 1, 4), "</a> " + _words(rng, 2, 9) + ".</p>", 1)
        else:
            put("<pre>", _words(rng, 3, 30), "</pre>", 1)
        if some(0.05):
            side(*rng.choice([('<div class="ad">', "</div>"), ('<div class="newsletter-signup">', "</div>"), ('<aside class="related">', "</aside>"), ('<div class="share">', "</div>")]), 1, 1)
    put("", "", shell[1], 1)
    if not before_side and some(0.4):
        side(*rng.choice(sides))
    if some(0.3):
        put('<form><label>', _words(rng, 1, 5), "</label>", 0)
        put("<button>", _words(rng, 1, 2), "</button></form>", 0)
    if some(0.4):
        side(*rng.choice([('<div class="comments">', "</div>"), ('<section id="comments">', "</section>"), ('<div class="comment-list">', "</div>")]), 1, 6)
    if some(0.85):
        side(*rng.choice([("<footer>", "</footer>"), ("<footer>&copy; ", "</footer>"), ('<div class="footer">', "</div>"), ('<div id="site-footer">&copy; 2020 ', "</div>")]), 1, 3)
    return out


def pages(count: int = 160, seed: int = 5):
    """[(html, labels of its blocks)]; each text stands as one block, so labels follow the page's blocks."""
    from wiretally.llm.html import blocks
    rng, out = random.Random(seed), []
    while len(out) < count:
        parts = _page(rng)
        page = "<html><head><title>t</title><style>p{}</style></head><body>" + "".join(f"{a}{t}{b}" for a, t, b, _ in parts) + "</body></html>"
        marks = [(text, label) for _, text, _, label in parts if text]
        labels, at = [], 0
        for text, *_ in blocks(page):
            while at < len(marks) and marks[at][0].strip() not in text:
                at += 1
            labels.append(marks[at][1] if at < len(marks) else None)
        if labels and None not in labels:
            out.append((page, labels))
    return out
