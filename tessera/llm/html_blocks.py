"""HTML extraction: a bidirectional LSTM in numpy labels every leaf block of a page as main text or not.

A page is a sequence of blocks. A block is read as the mean vector of its tag path (tags and the words of class and id),
the mean vector of its hashed words, and a few figures; the LSTM reads the sequence both ways, so each label
depends on the whole page. It is trained here, on made-up pages of many layouts, from a fixed seed.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import SPACED, buffers, words

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_RAW = {t: re.compile(f"</{t}(?=[\\s/>])", re.I) for t in ("script", "style", "template", "noscript", "iframe", "svg", "math", "object", "title", "textarea")}
# Of these, elements that stand in one another; in the foreign ones a slash closes.
_NESTED = {t: re.compile(rf"<(/?){t}(?=[\s/>])[^>]*?(/?)(?:>|\Z)", re.I) for t in ("template", "noscript", "svg", "math", "object")}
_FOREIGN = ("svg", "math")
# Elements that begin and end a block.
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# What an opening tag ends, up to the nearest of the elements after the colon.
_ENDS = {t: ({"p"}, _BLOCK - {"p"}) for t in _BLOCK}
_ENDS |= {"li": ({"p", "li"}, {"ul", "ol", "menu"}), "dt": ({"p", "dt", "dd"}, {"dl"}), "dd": ({"p", "dt", "dd"}, {"dl"})}
_ENDS |= {"tr": ({"p", "td", "th", "tr"}, {"table"}), "td": ({"p", "td", "th"}, {"tr", "table"}), "th": ({"p", "td", "th"}, {"tr", "table"})}
_ENDS |= {"option": ({"option"}, {"select"})}

PATHS, WORDS, WIDTH, FIGURES, HIDDEN = 4096, 4096, 20, 6, 24


@dataclass(slots=True)
class Block:
    text: str
    path: tuple[str, ...]
    linked: float


def _ends_of(page: str, tag: str) -> dict[int, int]:
    """Where elements end, by where they start; those without a closing tag of their own are left out."""
    begun: list[int] = []
    ends: dict[int, int] = {}
    for m in _NESTED[tag].finditer(page):
        if not m[1]:
            if not (m[2] and tag in _FOREIGN):
                begun.append(m.start())
        elif begun:
            ends[begun.pop()] = m.end()
    return ends


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order: their text with references decoded and white space evened out, and what they stand in."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    ends_of: dict[str, dict[int, int]] = {}
    unclosed: set[str] = set()
    linked = links = 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                path = tuple(x for tag, names in stack for x in (tag, *names))
                out.append(Block(text, path, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if links:
            linked += len(text)

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            if at < len(page):
                say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        slash, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            if tag in _BLOCK:
                close()
            elif tag != "a":
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    links -= sum(t == "a" for t, _ in stack[i:])
                    del stack[i:]
                    break
                if tag not in _BLOCK and stack[i][0] in _BLOCK:
                    break
            continue
        if tag in _RAW:
            if tag == "title" and not any(t == "svg" for t, _ in stack):
                close()
            if tag in _NESTED:  # what is never closed is read on after its opening tag
                if not (tag in _FOREIGN and rest.endswith("/")):
                    if tag not in ends_of:
                        ends_of[tag] = _ends_of(page, tag)
                    at = max(at, ends_of[tag].get(m.start(), at))
                continue
            end = None if tag in unclosed else _RAW[tag].search(page, at)
            if end is not None:
                at = page.find(">", end.end()) + 1 or len(page)
            elif tag == "script":
                at = len(page)
            else:
                unclosed.add(tag)
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in _BLOCK:
            close()
            ends, until = _ENDS[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    links -= sum(t == "a" for t, _ in stack[i:])
                    del stack[i:]
                elif stack[i][0] in until:
                    break
        if tag in _VOID or rest.endswith("/"):
            continue
        names = ()
        if tag in _BLOCK and rest:
            names = tuple("." + p.lower() for x in _NAMES.findall(rest) for p in _PARTS.findall(x[0] or x[1] or x[2]))
        if tag in _BLOCK or tag == "a":
            stack.append((tag, names))
            if tag == "a":
                links += 1
    close()
    return out


# ---------------------------------------------------------------- the network


@lru_cache(100_000)
def _path_numbers(path: tuple[str, ...]) -> list[int]:
    return [xxhash.xxh64_intdigest(x, 1) % PATHS for x in (*path, *(f"/{x}" for x in path[-1:]))]


_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in ".!?;:,"]] = True


@dataclass
class Page:
    """Numbers of path parts and words of all blocks in a row, how many each has, and figures by block."""

    paths: np.ndarray
    n_paths: np.ndarray
    words: np.ndarray
    n_words: np.ndarray
    figures: np.ndarray


def read(bs: list[Block]) -> Page:
    """A page as the network's numbers."""
    return read_all([bs])[0]


def read_all(found: list[list[Block]]) -> list[Page]:
    """Several pages; their words are hashed together."""
    data, at = buffers(pa.array([b.text for bs in found for b in bs], pa.large_string()))
    w = words(data, at, SPACED)
    number, n_words = (w.hashes >> np.uint64(64 - WORDS.bit_length() + 1)).astype(np.int32), w.counts
    marks = np.concatenate([[0], np.cumsum(_MARKS[data])])
    marks = marks[at[1:]] - marks[at[:-1]]
    out, k = [], 0
    for bs in found:
        paths, n_paths = [], []
        for b in bs:
            own = _path_numbers(b.path)
            paths += own
            n_paths.append(len(own))
        n = n_words[k : k + len(bs)]
        figures = np.ones((len(bs), FIGURES), np.float32)
        figures[:, 0] = np.log1p(n) / 4
        figures[:, 1] = [b.linked for b in bs]
        figures[:, 2] = np.minimum(1, marks[k : k + len(bs)] / np.maximum(n, 1))
        figures[:, 3] = np.arange(len(bs)) / max(1, len(bs))
        figures[:, 4] = ["p" in b.path for b in bs]
        out.append(Page(np.array(paths, np.int32), np.array(n_paths, np.int64), number[w.first[k] : w.first[k + len(bs)]], n, figures))
        k += len(bs)
    return out


def _mean(table: np.ndarray, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Mean of table rows for each block."""
    sums = np.concatenate([np.zeros((1, WIDTH)), np.cumsum(table[ids], 0, dtype=np.float64)])
    end = np.cumsum(n)
    return ((sums[end] - sums[end - n]) / np.maximum(n, 1)[:, None]).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        size = 2 * WIDTH + FIGURES
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.p = {
            "paths": rng.normal(0, 0.3, (PATHS, WIDTH)).astype(np.float32),
            "words": rng.normal(0, 0.3, (WORDS, WIDTH)).astype(np.float32),
            "out": draw(2 * HIDDEN, 1),
            "bias": np.zeros(1, np.float32),
        }
        for d in "fb":
            self.p |= {f"x{d}": draw(size, 4 * HIDDEN), f"h{d}": draw(HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1  # open forget gates at first

    def _inputs(self, pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
        """(steps, pages, features), padded, and which of them are blocks."""
        sizes = [len(x.n_words) for x in pages]
        x = np.zeros((max(sizes), len(pages), 2 * WIDTH + FIGURES), np.float32)
        mask = np.zeros(x.shape[:2], bool)
        for i, p in enumerate(pages):
            x[: sizes[i], i] = np.hstack([_mean(self.p["paths"], p.paths, p.n_paths), _mean(self.p["words"], p.words, p.n_words), p.figures])
            mask[: sizes[i], i] = True
        return x, mask

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        u, h, c = self.p[f"h{d}"], np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32)
        z0 = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        hs, kept = np.zeros((*x.shape[:2], HIDDEN), np.float32), {}
        for t in steps:
            z = z0[t] + h @ u
            g = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
            a = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c2 = np.where(m, f * c + i * a, c)
            tc = np.tanh(c2)
            h2 = np.where(m, o * tc, h)
            if keep:
                kept[t] = (h, c, i, f, o, a, tc)
            h, c = h2, c2
            hs[t] = h
        return hs, kept

    def score(self, pages: list[Page]) -> list[np.ndarray]:
        """The probability that each block is main text, page by page; pages of like length run together."""
        out: list[np.ndarray] = [np.empty(0)] * len(pages)
        order = [i for i in sorted(range(len(pages)), key=lambda i: len(pages[i].n_words)) if len(pages[i].n_words)]
        while order:
            longest = len(pages[order[-1]].n_words)
            group = order[-max(1, min(128, 400_000 // longest)) :]
            del order[-len(group) :]
            x, mask = self._inputs([pages[i] for i in group])
            both = np.concatenate([self._run(x, mask, d, False)[0] for d in "fb"], 2)
            p = _sigmoid((both @ self.p["out"])[..., 0] + self.p["bias"])
            for j, i in enumerate(group):
                out[i] = p[: len(pages[i].n_words), j]
        return out

    def gradient(self, pages: list[Page], labels: list[np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy and its gradient, by back-propagation through time."""
        x, mask = self._inputs(pages)
        runs = {d: self._run(x, mask, d, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], 2)
        p = _sigmoid((both @ self.p["out"])[..., 0] + self.p["bias"])
        y = np.zeros(mask.shape, np.float32)
        for i, l in enumerate(labels):
            y[: len(l), i] = l
        n = mask.sum()
        loss = -(np.log(np.where(y > 0, p, 1 - p) + 1e-9) * mask).sum() / n
        dz = ((p - y) * mask / n).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["out"] = (both * dz[..., None]).sum((0, 1))[:, None]
        g["bias"] = dz.sum(keepdims=True)[0]
        dboth = dz[..., None] * self.p["out"][:, 0]
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            dh_out, kept = dboth[..., k * HIDDEN : (k + 1) * HIDDEN], runs[d][1]
            steps = range(len(x) - 1, -1, -1) if d == "f" else range(len(x))
            dh, dc = np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32)
            dzs = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            for t in steps:
                h, c, i, f, o, a, tc = kept[t]
                m = mask[t][:, None]
                dh_t = dh + dh_out[t]
                dcell = np.where(m, dc + dh_t * o * (1 - tc * tc), 0)
                dzs[t] = np.where(m, np.hstack([dcell * a * i * (1 - i), dcell * c * f * (1 - f), dh_t * tc * o * (1 - o), dcell * i * (1 - a * a)]), 0)
                dh = np.where(m, dzs[t] @ self.p[f"h{d}"].T, dh_t)
                dc = np.where(m, dcell * f, dc)
                g[f"h{d}"] += h.T @ dzs[t]
            g[f"x{d}"] = np.tensordot(x, dzs, ((0, 1), (0, 1)))
            g[f"c{d}"] = dzs.sum((0, 1))
            dx += dzs @ self.p[f"x{d}"].T
        rows: dict[str, list] = {"paths": [], "words": []}
        for i, page in enumerate(pages):
            own = dx[: len(page.n_words), i]
            for name, ids, n_ids, at in (("paths", page.paths, page.n_paths, 0), ("words", page.words, page.n_words, WIDTH)):
                rows[name].append((ids, np.repeat(own[:, at : at + WIDTH] / np.maximum(n_ids, 1)[:, None], n_ids, 0)))
        for name, parts in rows.items():
            ids, value = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(ids, kind="stable")
            begin = np.flatnonzero(np.concatenate([[True], np.diff(ids[order]) > 0])) if len(ids) else []
            if len(begin):
                g[name][ids[order][begin]] = np.add.reduceat(value[order], begin)
        return float(loss), g


# ---------------------------------------------------------------- made-up pages

_SYLLABLES = "an er in the on re ti es or le la de que ei sch ung ver al os ar ci ment eau ble st nd th ou".split()
_CHROME = {
    "nav": "nav menu navbar navigation topnav breadcrumb breadcrumbs tabs toc",
    "header": "header masthead banner top site-header branding logo topbar",
    "footer": "footer bottom site-footer copyright legal colophon footnav",
    "aside": "sidebar aside side rail widget related recommended popular tags archive",
    "notice": "notice cookie cookies consent gdpr alert announcement popup modal overlay warning",
    "ad": "ad ads advert advertisement sponsor sponsored promo banner-ad adsense commercial",
    "form": "form search login subscribe newsletter signup contact",
    "comments": "comments comment comment-list discussion replies respond disqus",
    "share": "share social follow sharing meta byline pagination pager",
}
_MAIN = "content article post entry main story text body entry-content post-body article-body page-content main-content"


def made_up_page(rng: np.random.Generator) -> tuple[str, set[str]]:
    """A page of a random layout and the texts of its main blocks."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p
    main: set[str] = set()

    def prose(low: int, high: int, marks: bool = True) -> str:
        ws = ["".join(pick(_SYLLABLES) for _ in range(int(rng.integers(1, 5)))) for _ in range(int(rng.integers(low, high + 1)))]
        odd = rng.random()
        if odd < 0.04:
            return " | ".join(ws)
        if odd < 0.08:
            return " ".join(w for w in ws[: 1 + len(ws) // 3] for _ in range(3))
        if odd < 0.1:
            return " ".join(w.upper() + "!!" for w in ws)
        if odd < 0.12:
            return " ".join(w + pick(("***", "$$$", "", "&&&")) for w in ws)
        if odd < 0.14:
            return " ".join(str(int(rng.integers(10**9))) if chance(0.4) else w for w in ws)
        if marks:
            for i in range(len(ws)):
                if chance(0.12):
                    ws[i] += pick(",.,.;")
            ws[-1] += "."
        return " ".join(ws).capitalize()

    def own(text: str, is_main: bool) -> str:
        if is_main:
            main.add(text)
        return text

    def attributes(names: str) -> str:
        if chance(0.15):
            return ""
        name = pick(names.split())
        if chance(0.3):
            name += " " + pick("a b x1 wide dark col row inner box left right grid".split())
        return f' {pick(("class", "class", "id"))}="{name}"'

    def paragraph(is_main: bool, low=3, high=70) -> str:
        text = own(prose(low, high), is_main)
        end = "</p>" if chance(0.75) else ""
        if chance(0.2):
            return f"<p><b>{text}{pick(('</b>', '<br>', '</b><br>'))}{end}"
        if chance(0.2):
            a, _, b = text.partition(" ")
            return f'<p>{a} <a href="/{len(text)}">{b}</a>{end}' if chance(0.3) else f"<p><em>{a}</em> {b}{end}"
        return f"<p>{text}{end}"

    def links(n: int) -> str:
        item = lambda: f'<a href="/x">{prose(1, 4, False)}</a>'
        if chance(0.7):
            return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(n)) + "</ul>"
        return pick((" | ", " ", " &middot; ")).join(item() for _ in range(n))

    def chrome(kind: str) -> str:
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section"}.get(kind, "div")
        if chance(0.45) and kind != "form":
            tag = pick(("div", "div", "section", "td" if kind == "never" else "div"))
        if kind == "form":
            fill = f"<label>{prose(1, 3, False)}</label><input type=text><button>{prose(1, 2, False)}</button>"
            if chance(0.5):
                fill = f"<p>{prose(3, 14)}</p>" + fill
        elif kind in ("nav", "share"):
            fill = links(int(rng.integers(2, 9)))
        elif kind == "comments":
            fill = f"<h3>{prose(1, 3, False)}</h3>"
            for _ in range(int(rng.integers(1, 6))):
                inner = "".join(f"<p>{prose(2, 45)}</p>" for _ in range(int(rng.integers(1, 3))))
                fill += f'<div class="{pick(("comment", "reply", "comment-body"))}">{inner}</div>' if chance(0.7) else f"<li>{inner}</li>"
        elif kind == "header":
            fill = f"<h1>{prose(1, 4, False)}</h1>" * chance(0.4) + f"<p>{prose(2, 12)}</p>" * chance(0.4) + links(3) * chance(0.6)
        elif kind == "footer":
            fill = f"&copy; {prose(1, 3, False)} &middot; {prose(2, 14)}" + links(4) * chance(0.4) + f"<p>{prose(3, 25)}</p>" * chance(0.4)
        elif kind == "aside":
            fill = f"<h3>{prose(1, 4, False)}</h3>" + (links(5) if chance(0.6) else "".join(f"<p>{prose(3, 30)}</p>" for _ in range(2)))
        else:
            fill = prose(2, 40) if chance(0.5) else f"<p>{prose(2, 40)}</p>"
        a = attributes(_CHROME[kind])
        if tag in ("div", "section") and not a:
            a = f' class="{pick(_CHROME[kind].split())}"'
        return f"<{tag}{a}>{fill}</{tag}>"

    def article() -> str:
        out = [f"<h1>{own(prose(3, 12, chance(0.5)), True)}</h1>"] if chance(0.8) else []
        if chance(0.08):  # the same short line again and again
            out += [f"<p>{own(prose(1, 6), True)}</p>"] * int(rng.integers(5, 90))
        for _ in range(int(rng.integers(1, 14))):
            r = rng.random()
            if r < 0.72:
                out.append(paragraph(True, 1, 90))
            elif r < 0.79:
                out.append(f"<h{pick('234')}>{own(prose(1, 7, False), True)}</h2>")
            elif r < 0.86:
                tag = pick(("ul", "ol"))
                out.append(f"<{tag}>" + "".join(f"<li>{own(prose(2, 25), True)}</li>" for _ in range(int(rng.integers(2, 6)))) + f"</{tag}>")
            elif r < 0.9:
                out.append(f"<blockquote>{paragraph(True)}</blockquote>")
            elif r < 0.93:
                out.append(f"<pre>{own(prose(3, 20), True)}</pre>")
            elif r < 0.95:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{own(prose(1, 6, False), True)}</td>" for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>")
            else:
                out.append(chrome(pick(("ad", "share", "aside", "form", "notice"))))
        body = "".join(out)
        for _ in range(int(rng.integers(0, 3))):
            tag = pick(("article", "main", "section", "div", "div"))
            a = attributes(_MAIN) if tag in ("article", "main") else f' {pick(("class", "id"))}="{pick(_MAIN.split())}"'
            body = f"<{tag}{a}>{body}</{tag}>"
        return body if body.startswith(("<article", "<main", "<div", "<section")) or chance(0.3) else f"<article>{body}</article>"

    before = [chrome(pick(("nav", "header", "notice", "ad", "form", "share", "aside", "nav", "ad"))) for _ in range(int(rng.integers(0, 5)))]
    after = [chrome(pick(("footer", "comments", "aside", "share", "ad", "nav", "notice", "form", "footer", "comments"))) for _ in range(int(rng.integers(0, 5)))]
    if chance(0.5):
        before.append(f"<!-- {prose(1, 5)} --><script>var x = '<p>{prose(1, 4)}</p>';</script>")
    page = "<!DOCTYPE html><html><head><title>" + prose(2, 8) + "</title><style>p{margin:0}</style></head><body>" + "".join(before) + article() + "".join(after)
    return page + "</body></html>" * chance(0.7), main


@lru_cache(1)
def trained(n_pages: int = 600, passes: int = 7, seed: int = 11) -> Labeller:
    """The labeller, trained with Adam on made-up pages."""
    rng = np.random.default_rng(seed)
    pages, labels = [], []
    for _ in range(n_pages):
        page, main = made_up_page(rng)
        bs = blocks(page)
        if bs:
            even = {" ".join(html.unescape(x).split()) for x in main}
            pages.append(read(bs))
            labels.append(np.array([b.text in even for b in bs], np.float32))
    model = Labeller()
    m, v, t = ({k: np.zeros_like(x) for k, x in model.p.items()} for _ in range(2)), None, 0
    m, v = m
    for n in range(passes):
        rate = 0.01 if n < passes - 3 else 0.003
        order = sorted(rng.permutation(len(pages)).tolist(), key=lambda i: len(labels[i]) // 8)
        groups = [order[i : i + 20] for i in range(0, len(order), 20)]
        for j in rng.permutation(len(groups)):
            t += 1
            _, g = model.gradient([pages[i] for i in groups[j]], [labels[i] for i in groups[j]])
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            for k, x in g.items():
                x = x / max(1.0, norm)
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                model.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)
    return model


def main_texts(pages: list[str | None], model: Labeller, least: float = 0.5) -> list[str]:
    """The main text of each page: its blocks scored ``least`` or more, joined by blank lines."""
    found = [blocks(p or "") for p in pages]
    scores = model.score(read_all(found))
    return ["\n\n".join(b.text for b, s in zip(bs, ss, strict=True) if s >= least) for bs, ss in zip(found, scores, strict=True)]


def extract_main_text(pages: DataFrame, model: Labeller | None = None, html_: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` and ``text`` string, the main text of the whole page; one row per row of ``pages``, without a shuffle.

    A null or empty page has an empty text. Malformed or cut-off markup is read as far as it goes: what an opening tag implies is closed, a cut-off
    tag, comment or script ends with the page, and after any other element without a closing tag the text behind is read. Repeated rows come out alike; an empty table gives an empty result.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model or trained())  # of fixed size
    fields = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in keep)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = main_texts(part.column("__html").to_pylist(), sent.value)
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in keep} | {"text": pa.array(texts, pa.string())})

    return pages.select(*keep, F.col(html_).cast("string").alias("__html")).mapInArrow(label, f"{fields}text string")
