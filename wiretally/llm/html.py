"""Main text of web pages: a linear-chain conditional random field over leaf blocks, decoded by Viterbi."""

import html as entities
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose start and end bound a block; all others run inside one.
BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre
search section select summary table tbody td template tfoot th thead title tr ul video audio canvas iframe object""".split())
#: Elements whose content is not page text.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a start tag of the key ends when they are open, and the elements that stop the search.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: A tag whose quote is never closed ends at the first ">"; markup that isn't closed at all runs to the end of the page.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*(?=>|\Z)|[^>]*)(?:>|\Z)", re.S)
_MARKS = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HREF = re.compile(r"\bhref\s*=", re.I)
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[A-Za-z]+")


class Open:
    """The open elements of a page. What is asked about them takes no walk over all of them, however deep they nest."""

    def __init__(self):
        self.stack, self.at, self.names = [], {}, {}

    def last(self, *tags):
        """The depth of the innermost of ``tags``, -1 where none is open."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def push(self, tag, names):
        depth = len(self.stack)
        self.stack.append((tag, names))
        self.at.setdefault(tag, []).append(depth)
        if tag in BLOCKS:
            self.at.setdefault("", []).append(depth)
        for n in names:
            self.names[n] = self.names.get(n, 0) + 1

    def cut(self, depth):
        """Closes everything from ``depth`` on."""
        while len(self.stack) > depth:
            tag, names = self.stack.pop()
            self.at[tag].pop()
            if tag in BLOCKS:
                self.at[""].pop()
            for n in names:
                self.names[n] -= 1
                if not self.names[n]:
                    del self.names[n]

    def links(self):
        return bool(self.at.get("a"))

    def place(self):
        """Known ancestor tags, the innermost last, and known names."""
        tags = sorted((self.at[t][-1], t) for t in _TAGS if self.at.get(t))
        return tuple(t for _, t in tags), tuple(sorted(self.names))


def blocks(page: str):
    """Leaf blocks in page order: (text, known ancestor tags, known names in their class, id and role, share of link text)."""
    out, opened, pieces, linked = [], Open(), [], 0

    def end():
        nonlocal pieces, linked
        if pieces:
            text = _SPACE.sub(" ", entities.unescape("".join(pieces))).strip()
            if text:
                size = max(sum(map(len, pieces)), 1)
                out.append((text, *opened.place(), min(linked / size, 1.0)))
        pieces, linked = [], 0

    def add(text):
        nonlocal linked
        if text:
            pieces.append(text)
            if opened.links() and not text.isspace():
                linked += len(text)
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at:m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            open_at = opened.last(name)
            if name in BLOCKS:
                end()
            if open_at >= 0 and (name in BLOCKS or opened.last("") <= open_at):
                opened.cut(open_at)
            continue
        if name in RAW:
            if name in BLOCKS:
                end()
            close = re.compile(rf"</{name}\s*>?", re.I).search(page, at)
            at = close.end() if close else n
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in BLOCKS:
            end()
            paragraph = opened.last("p")
            if paragraph >= 0 and opened.last("td", "th", "button", "object") < paragraph:
                opened.cut(paragraph)
            if name in CLOSES:
                ends, stops = CLOSES[name]
                if opened.last(*ends) > opened.last(*stops):
                    opened.cut(opened.last(*ends))
        if name in VOID or m[3].endswith("/") and name not in BLOCKS:
            continue
        found = m[3] and _MARKS.findall(m[3])
        marks = [p.lower() for group in found or () for value in group if value for p in _PART.findall(value)]
        opened.push(name, tuple(m for m in marks if m in _NAME_OF))
    end()
    return out


#: Tags and name parts that speak for or against main text wherever they stand above a block; fixed values.
TAGS = "article main nav header footer aside form button select dialog menu noscript figcaption blockquote pre table li p h1 h2 h3 h4 h5 h6 section div a td dd dt label template".split()
NAMES = {
    "main": "article content entry post story main body text prose".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs skip".split(),
    "head": "header masthead banner top branding logo topbar".split(),
    "foot": "footer foot copyright legal bottom colophon".split(),
    "side": "sidebar side aside related recommended widget trending popular more rail".split(),
    "note": "cookie cookies consent gdpr notice alert modal popup overlay newsletter subscribe signup toast".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion banner dfp".split(),
    "comment": "comment comments disqus reply replies discussion respond reader".split(),
    "share": "share social sharing follow tags meta byline author".split(),
    "form": "form search login register input captcha".split()}
_NAME_OF = {}
for _kind, _words in NAMES.items():
    for _w in _words:
        _NAME_OF.setdefault(_w, []).append(_kind)
FEATURES = ([f"tag {t}" for t in TAGS] + [f"leaf {t}" for t in TAGS] + [f"name {k}" for k in NAMES]
            + ["bias", "words 1", "words 3", "words 8", "words 20", "words 60", "links some", "links most", "stops", "colon or arrow", "mark", "digits", "first", "last"])
_INDEX = {f: i for i, f in enumerate(FEATURES)}
_TAGS = frozenset(TAGS)


@lru_cache(maxsize=4096)
def _place(tags, names):
    """Features of a block's ancestors."""
    on = {_INDEX[f"tag {t}"] for t in tags if t in _TAGS}
    leaf = next((t for t in reversed(tags) if t in _TAGS and t in BLOCKS), None)
    if leaf:
        on.add(_INDEX[f"leaf {leaf}"])
    return tuple(sorted(on | {_INDEX[f"name {k}"] for n in names for k in _NAME_OF.get(n, ())}))


def featured(parts):
    """One row of 0/1 features per block."""
    x = np.zeros((len(parts), len(FEATURES)), np.float32)
    for i, (text, tags, names, links) in enumerate(parts):
        x[i, list(_place(tags, names))] = 1
        n = text.count(" ") + 1
        on = ["bias", *(f"words {k}" for k in (1, 3, 8, 20, 60) if n >= k)]
        on += ["links some"] * (links > 0.2) + ["links most"] * (links > 0.7) + ["stops"] * (text[-1] in ".!?…。\"”»")
        on += ["colon or arrow"] * (text[-1] in ":›»>|→") + ["mark"] * ("©" in text or "®" in text) + ["digits"] * text[0].isdigit()
        on += ["first"] * (i == 0) + ["last"] * (i == len(parts) - 1)
        x[i, [_INDEX[f] for f in on]] = 1
    return x


class Field:
    """A linear chain of two labels (other, main): weights per label and feature, and per pair of neighbours."""

    def __init__(self, state=None, step=None):
        self.state = np.zeros((len(FEATURES), 2)) if state is None else state
        self.step = np.zeros((2, 2)) if step is None else step

    def best(self, x):
        """The likeliest labels of a page, by Viterbi."""
        score = x @ self.state
        back, now = np.zeros((len(score), 2), int), score[0]
        for i in range(1, len(score)):
            ways = now[:, None] + self.step
            back[i] = ways.argmax(axis=0)
            now = ways.max(axis=0) + score[i]
        out = [int(now.argmax())]
        for i in range(len(score) - 1, 0, -1):
            out.append(int(back[i][out[-1]]))
        return out[::-1]

    def _slope(self, x, y):
        """Gradient of the log likelihood of one page: what is there less what is expected."""
        score, n = x @ self.state, len(x)
        ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
        ahead[0] = score[0]
        for i in range(1, n):
            ahead[i] = score[i] + np.logaddexp.reduce(ahead[i - 1][:, None] + self.step, axis=0)
        for i in range(n - 2, -1, -1):
            behind[i] = np.logaddexp.reduce(self.step + score[i + 1] + behind[i + 1], axis=1)
        total = np.logaddexp.reduce(ahead[-1])
        one = np.exp(ahead + behind - total)
        state = x.T @ (np.eye(2)[y] - one)
        step = np.zeros((2, 2))
        for i in range(1, n):
            step[y[i - 1], y[i]] += 1
            step -= np.exp(ahead[i - 1][:, None] + self.step + score[i] + behind[i] - total)
        return state, step

    @classmethod
    def trained(cls, pages, rounds: int = 60, rate: float = 0.5, ridge: float = 0.02):
        """Fitted to labelled pages [(features, labels)] by adaptive gradient steps on the penalised likelihood."""
        field = cls()
        spent = [np.full_like(field.state, 1e-6), np.full_like(field.step, 1e-6)]
        for _ in range(rounds):
            slopes = [-ridge * field.state * len(pages) / 10, -ridge * field.step * len(pages) / 10]
            for x, y in pages:
                for total, part in zip(slopes, field._slope(x, y)):
                    total += part
            for weights, slope, used in zip((field.state, field.step), slopes, spent):
                used += slope ** 2
                weights += rate * slope / np.sqrt(used)
        return field


def extracted(page: str, field: Field) -> str:
    parts = blocks(page)
    if not parts:
        return ""
    return "\n".join(text for (text, *_), label in zip(parts, field.best(featured(parts))) if label)


def main_text(pages: DataFrame, field: Field = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page: the article's blocks, joined by line feeds.

    Character references are decoded, white space inside a block becomes one space. A null or empty
    page, or one without main text, gives an empty text and 0. Repeated rows come out one by one,
    extra columns are ignored. A page is read in time proportional to its length, however deep its elements
    nest; a tag whose quote never closes ends at its first ">". Without a ``field`` the one fitted to ``labelled.pages`` is used.
    """
    if field is None:
        from wiretally.llm.labelled import pages as labelled
        field = Field.trained([(featured(blocks(p)), labels) for p, labels in labelled()])

    def run(batches):
        for b in batches:
            b["text"] = [extracted(h, field) for h in b["html"]]
            yield b[["page_id", "url", "text"]]
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    found = rows.mapInPandas(run, "page_id string, url string, text string")
    return found.select(F.col("page_id").cast("long").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
