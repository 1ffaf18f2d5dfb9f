"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its text blocks, each with hashed tokens of its tag path (tags, and the words of class, id
and role of all ancestors), hashed words, and a few counts. A bidirectional LSTM in numpy reads the whole sequence and
labels every block as main text or not. It learns from pages that this module builds: text of a bounded sample of
the corpus in layouts whose parts are known.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATHS, WORDS, PATH_SIZE, WORD_SIZE, COUNTS, HIDDEN = 1024, 512, 12, 4, 4, 12
#: Bound of the training sample: pages whose text fills the layouts, and layouts built of it.
SAMPLE_PAGES, LAYOUTS, STEPS, BATCH, RATE = 200, 900, 220, 24, 0.02
#: Blocks of one page in a training step, and cells (pages x blocks) labelled at once.
TRAIN_BLOCKS, CELLS = 48, 20_000

# HTML elements that start a block, that hold no text to read, and that have no end tag.
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
SILENT = frozenset("script style noscript template title head svg iframe object select option textarea button datalist canvas math".split())
#: Elements that may stand in a head; any other start tag, or text, ends it.
IN_HEAD = frozenset("html head title base basefont bgsound link meta style script noscript noframes template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SPACE = re.compile(r"\s+")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def hashed(token: str, size: int) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % size


class Blocks(HTMLParser):
    """Collects (text, path tokens, links' share of the characters) of the blocks of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.found: list[tuple[str, tuple[str, ...], float]] = []
        self.parts: list[str] = []
        self.path: tuple[str, ...] = ()
        self.linked = self.silent = self.links = 0

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.found.append((text, self.path, min(1.0, self.linked / len(text))))
        self.parts, self.linked = [], 0

    def _end_head(self, always: bool) -> None:
        """Ends an open head whose end tag was left out, but not from inside a silent element of it, unless `always`."""
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == "head":
                self._pop_to(i)
                return
            if self.stack[i][0] in SILENT and not always:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.silent and tag not in IN_HEAD:
            self._end_head(tag == "body")
        if tag in BLOCK:
            self.flush()
            # an element such as <p> or <li> ends its open sibling, but not one outside the parent block
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in CLOSES.get(tag, ()):
                    self._pop_to(i)
                    break
                if self.stack[i][0] in BLOCK:
                    break
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        tokens = [tag]
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                tokens += [f".{part.lower()}" for part in NAME_PARTS.findall(value)]
        self.stack.append((tag, tuple(tokens)))
        self.silent += tag in SILENT
        self.links += tag == "a"

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self._pop_to(i)
                return

    def _pop_to(self, i: int) -> None:
        for tag, _ in self.stack[i:]:
            self.silent -= tag in SILENT
            self.links -= tag == "a"
        del self.stack[i:]

    def handle_data(self, data: str) -> None:
        if self.silent and self.stack[-1][0] == "head" and data.strip():
            self._end_head(False)
        if self.silent:
            return
        if not self.parts:
            self.path = tuple(t for _, tokens in self.stack for t in tokens)
        self.parts.append(data)
        if self.links:
            self.linked += len(data)


def blocks(html: str | None) -> list[tuple[str, tuple[str, ...], float]]:
    parser = Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.found


def features(found: list[tuple[str, tuple[str, ...], float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(path counts, word counts, other counts) of a page's blocks; path and word counts sum to 1 per block."""
    paths, words, counts = np.zeros((len(found), PATHS), np.float32), np.zeros((len(found), WORDS), np.float32), np.zeros((len(found), COUNTS), np.float32)
    cache: dict[tuple[str, ...], np.ndarray] = {}
    for i, (text, path, linked) in enumerate(found):
        if path not in cache:
            row = np.zeros(PATHS, np.float32)
            for token in set(path):
                row[hashed(token, PATHS)] += 1
            cache[path] = row / max(1.0, float(np.sqrt(row.sum())))
        paths[i] = cache[path]
        words[i] = np.bincount([hashed(token, WORDS) for token in text.lower().split(" ")], minlength=WORDS)
        words[i] /= max(1.0, words[i].sum())
        counts[i] = (np.log1p(len(text)) / 6, linked, text[-1] in ".!?…»\"", np.log1p(len(found)) / 4)
    return paths, words, counts


class Lstm:
    """One direction over (time, page, input)."""

    def __init__(self, rng: np.random.Generator, size: int) -> None:
        self.x = rng.normal(0, 0.3, (size, 4 * HIDDEN)).astype(np.float32)
        self.h = rng.normal(0, 0.3, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
        self.b = np.zeros(4 * HIDDEN, np.float32)
        self.b[HIDDEN: 2 * HIDDEN] = 1       # remember at first

    def forward(self, data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, list]:
        """States; places outside a page pass the state on."""
        h = c = np.zeros((data.shape[1], HIDDEN), np.float32)
        states, kept = np.empty((*data.shape[:2], HIDDEN), np.float32), []
        projected = data @ self.x + self.b
        for t in range(len(data)):
            a = projected[t] + h @ self.h
            s = 0.5 * np.tanh(0.5 * a[:, : 3 * HIDDEN]) + 0.5
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN: 2 * HIDDEN], s[:, 2 * HIDDEN:], np.tanh(a[:, 3 * HIDDEN:])
            m = inside[t][:, None]
            new = f * c + i * g
            tc = np.tanh(new)
            kept.append((h, c, i, f, o, g, tc, m))
            h, c = np.where(m, o * tc, h), np.where(m, new, c)
            states[t] = h
        return states, kept

    def backward(self, data: np.ndarray, kept: list, grad: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Gradient of the input, and those of x, h and b."""
        dh_next, dc_next = np.zeros_like(grad[0]), np.zeros_like(grad[0])
        da_all = np.empty((*data.shape[:2], 4 * HIDDEN), np.float32)
        dh_w = np.zeros_like(self.h)
        for t in reversed(range(len(data))):
            h, c, i, f, o, g, tc, m = kept[t]
            d = grad[t] + dh_next
            do, dc = d * tc, dc_next + d * o * (1 - tc * tc)
            da = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), do * o * (1 - o), dc * i * (1 - g * g)], axis=1) * m
            da_all[t] = da
            dh_w += h.T @ da
            dh_next, dc_next = np.where(m, da @ self.h.T, d), np.where(m, dc * f, dc_next)
        return da_all @ self.x.T, [np.einsum("tbi,tbj->ij", data, da_all), dh_w, da_all.sum(axis=(0, 1))]


class Labeller:
    """Path and word vectors, a layer of both directions, and one output per block."""

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.paths = rng.normal(0, 0.1, (PATHS, PATH_SIZE)).astype(np.float32)
        self.words = rng.normal(0, 0.1, (WORDS, WORD_SIZE)).astype(np.float32)
        size = PATH_SIZE + WORD_SIZE + COUNTS
        self.ahead, self.back = Lstm(rng, size), Lstm(rng, size)
        self.out = rng.normal(0, 0.3, (2 * HIDDEN, 1)).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.paths, self.words, self.ahead.x, self.ahead.h, self.ahead.b, self.back.x, self.back.h, self.back.b, self.out, self.bias]

    def inputs(self, page: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        return np.concatenate([page[0] @ self.paths, page[1] @ self.words, page[2]], axis=1)

    @staticmethod
    def stacked(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(block, page, value) with padding, and which places are inside a page."""
        longest = max(len(r) for r in rows)
        data = np.zeros((longest, len(rows), rows[0].shape[1]), np.float32)
        inside = np.zeros((longest, len(rows)), bool)
        for k, r in enumerate(rows):
            data[: len(r), k], inside[: len(r), k] = r, True
        return data, inside

    def probabilities(self, data: np.ndarray, inside: np.ndarray) -> np.ndarray:
        ahead, _ = self.ahead.forward(data, inside)
        back, _ = self.back.forward(data[::-1], inside[::-1])
        return 1 / (1 + np.exp(-np.clip((np.concatenate([ahead, back[::-1]], axis=2) @ self.out)[:, :, 0] + self.bias, -30, 30)))

    def fit(self, pages: list[tuple], steps: int = STEPS, seed: int = 4) -> Labeller:
        """Adam by backpropagation through time; pages: ((features), labels)."""
        rng = np.random.default_rng(seed)
        first, second = [[np.zeros_like(w) for w in self.weights()] for _ in range(2)]
        for number in range(1, steps + 1):
            chosen = [pages[k] for k in rng.integers(0, len(pages), BATCH)]
            cut = [slice(0, TRAIN_BLOCKS)] * len(chosen)
            data, inside = self.stacked([self.inputs(tuple(f[c] for f in page)) for (page, _), c in zip(chosen, cut, strict=True)])
            paths, _ = self.stacked([page[0][c] for (page, _), c in zip(chosen, cut, strict=True)])
            words, _ = self.stacked([page[1][c] for (page, _), c in zip(chosen, cut, strict=True)])
            label, _ = self.stacked([y[c, None].astype(np.float32) for (_, y), c in zip(chosen, cut, strict=True)])
            ahead, kept_a = self.ahead.forward(data, inside)
            back, kept_b = self.back.forward(data[::-1], inside[::-1])
            both = np.concatenate([ahead, back[::-1]], axis=2)
            p = 1 / (1 + np.exp(-np.clip(both @ self.out + self.bias, -30, 30)))
            d = ((p - label) * inside[:, :, None] / inside.sum()).astype(np.float32)
            g = d @ self.out.T
            da, wa = self.ahead.backward(data, kept_a, g[:, :, :HIDDEN])
            db, wb = self.back.backward(data[::-1], kept_b, g[::-1, :, HIDDEN:])
            dx = da + db[::-1]
            grads = [np.einsum("tbi,tbj->ij", paths, dx[:, :, :PATH_SIZE]),
                     np.einsum("tbi,tbj->ij", words, dx[:, :, PATH_SIZE: PATH_SIZE + WORD_SIZE]),
                     *wa, *wb, np.einsum("tbi,tbj->ij", both, d), d.sum(axis=(0, 1))]
            rate = RATE * min(1, 2 * (1 - (number - 1) / steps))
            for w, grad, m, v in zip(self.weights(), grads, first, second, strict=True):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                w -= rate * (m / (1 - 0.9 ** number)) / (np.sqrt(v / (1 - 0.99 ** number)) + 1e-8)
        return self


# Parts of a layout: (opening tags, closing tags) with {} for a heading or none. Each kind is one way pages are built.
MAIN = ("<article>|</article>", "<main>|</main>", '<div class="content">|</div>', '<div id="main-content"><div class="post-body">|</div></div>',
        '<section class="story">|</section>', '<div class="entry text">|</div>', '<main role="main"><article>|</article></main>', "<div>|</div>", "|")
MENUS = ("<nav><ul>{li}</ul></nav>", '<div class="menu">{a}</div>', '<ul class="nav navbar">{li}</ul>', '<div id="top-menu"><ul>{li}</ul></div>',
         '<div role="navigation">{a}</div>', '<div class="breadcrumb">{a}</div>')
HEADS = ("<header>{t}</header>", '<div class="header">{t} {a}</div>', '<header><div class="logo">{t}</div><nav>{a}</nav></header>', '<div id="masthead">{t}</div>', '<div role="banner">{t}</div>')
FEET = ("<footer>&copy; {t}</footer>", '<div class="footer"><p>{t}</p>{a}</div>', "<footer><p>{t}</p><ul>{li}</ul></footer>", '<div id="site-footer">{t}</div>', '<div role="contentinfo">{t}</div>',
        "<footer>&copy; {w} &middot; {t}</footer>")
ASIDES = ("<aside><h3>{t}</h3><ul>{li}</ul></aside>", '<div class="sidebar"><p>{t}</p></div>', '<aside class="related">{a}<p>{t}</p></aside>', '<div id="widget">{t}{a}</div>',
          '<div class="share social">{a}</div>', '<section class="related-posts"><h2>{t}</h2>{li}</section>')
NOTICES = ('<div class="cookie-notice">{t}</div>', '<div class="alert"><p>{t}</p></div>', '<div id="gdpr-consent">{t}</div>', '<div class="newsletter-signup"><p>{t}</p></div>',
           '<div class="notice">{t}</div>', '<div role="alert">{t}</div>', '<div class="popup modal"><p>{t}</p></div>')
ADVERTS = ('<div class="ad">{t}</div>', '<div class="advert"><p>{t}</p></div>', '<div id="ad-slot">{a}{t}</div>', '<aside class="sponsored">{t}</aside>', '<div class="promo banner">{t}</div>',
           '<ins class="ads">{t}</ins>')
FORMS = ('<form><label>{w}</label><input name="q">{w}</form>', '<form class="search"><p>{t}</p><input></form>', '<form id="login"><fieldset><legend>{w}</legend><label>{t}</label></fieldset></form>')
COMMENTS = ('<div class="comments"><h3>{w}</h3><div class="comment"><p>{t}</p></div><div class="comment"><p>{l}</p></div></div>', '<section id="comments"><ol class="comment-list"><li><p>{l}</p></li><li>{t}</li></ol></section>',
            '<div id="disqus-thread"><p>{t}</p><p>{l}</p></div>', '<section class="reader-comments"><article class="comment"><p>{l}</p></article></section>', '<div class="replies"><p>{l}</p></div>')
BEFORE, AFTER, INSIDE = (MENUS, HEADS, NOTICES, ADVERTS, ASIDES, FORMS), (FEET, ASIDES, COMMENTS, ADVERTS, NOTICES, FORMS, MENUS), (ADVERTS, NOTICES, ASIDES, FORMS)
PARAGRAPHS = ("<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<p><em>{}</em></p>", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<p>{}</p>", "<p>{}</p>", "<p>{}</p>",
              "<pre>{}</pre>", "<div>{}</div>", "<h3>{}</h3>", "<table><tr><td>{}</td></tr></table>")


def layouts(texts: list[str], count: int = LAYOUTS, seed: int = 6) -> list[tuple]:
    """((features), labels) of pages built of the sentences in `texts`; every kind of part occurs with every kind of text."""
    rng = np.random.default_rng(seed)
    # \x01 and \x02 stand at the ends of main text and are taken off before features are made
    pool = [t for t in texts if t.strip()] or ["text"]
    pick = lambda options: options[rng.integers(len(options))]

    def words(low: int, high: int) -> str:
        split = pick(pool).split()
        at = rng.integers(max(1, len(split) - 1))
        return " ".join(split[at: at + rng.integers(low, high)]).replace("<", "").replace("&", "") or "text"

    def part(kinds: tuple) -> str:
        links = [f'<a href="/x">{words(1, 4)}</a>' for _ in range(rng.integers(1, 7))]
        return pick(pick(kinds)).format(t=words(2, 25), w=words(1, 3), l=words(8, 60), a=" ".join(links), li="".join(f"<li>{x}</li>" for x in links))

    def main(low: int, high: int) -> str:
        out = []
        for _ in range(rng.integers(low, high)):
            out.append(pick(PARAGRAPHS).format("\x01" + words(1, 90) + "\x01"))
            if rng.random() < 0.06:
                out.append(part(INSIDE))
        return "".join(out)

    made = []
    for _ in range(count):
        opening, closing = pick(MAIN).split("|")
        heading = f"<h1>\x01{words(1, 14)}\x01</h1>" if rng.random() < 0.8 else ""
        before = "".join(part(BEFORE) for _ in range(rng.integers(0, 4)))
        after = "".join(part(AFTER) for _ in range(rng.integers(0, 4)))
        html = f"<html><body>{before}{opening}{heading}{main(1, 14)}{closing}{after}" + ("</body></html>" if rng.random() < 0.8 else "")
        if rng.random() < 0.05:
            html = f"\x01{words(1, 200)}\x01"        # no markup at all
        found = blocks(html)
        label = np.array(["\x01" in text for text, _, _ in found])
        made.append((features([(text.replace("\x01", ""), path, linked) for text, path, linked in found]), label))
    return made


def learned(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Labeller:
    """A labeller for layouts filled with the text of `sample_pages` pages, the first by a seeded hash of the whole page."""
    sample = (pages.select("html", F.xxhash64("html", F.lit(41)).alias("order")).where("html is not null")
              .orderBy("order").limit(sample_pages).select(F.substring("html", 1, 20_000).alias("html")).toPandas())
    texts = [text for html in sample.html for text, _, _ in blocks(html)]
    return Labeller().fit(layouts(texts))


def main_texts(labeller: Labeller, pages: list[str | None]) -> list[str]:
    """The main text of each page; pages of about the same length are labelled together."""
    found = [blocks(html) for html in pages]
    rows = [labeller.inputs(features(f)) if f else None for f in found]
    order = sorted((k for k, r in enumerate(rows) if r is not None), key=lambda k: len(rows[k]))
    out = [""] * len(pages)
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and len(rows[order[stop]]) * (stop + 1 - at) <= CELLS:
            stop += 1
        group = order[at:stop]
        p = labeller.probabilities(*Labeller.stacked([rows[k] for k in group]))
        for column, k in enumerate(group):
            out[k] = " ".join(text for (text, _, _), q in zip(found[k], p[:, column], strict=False) if q >= 0.5)
        at = stop
    return out


def extract(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page from its whole html; n_chars counts code points.

    White space inside a block becomes one space, character references are decoded, blocks are joined by one space in
    page order. Null or empty html, and pages without a main block, give an empty text. Ids and urls may be null or
    repeated; each row has its own result. Other columns are ignored.
    """
    model = labeller or learned(pages)
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column("html").to_pylist()
            text = [t for lo in range(0, len(html), 256) for t in main_texts(model, html[lo: lo + 256])]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()),
                                              pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
