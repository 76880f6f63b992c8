"""Main text of HTML pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into its leaf blocks in order; each has features from its ancestors' tags, their class and id words, and
its text. A two-label chain (main text or not), trained on labelled pages, is decoded by Viterbi. Labelled pages are by default
made from a seed in many layouts; any pages with labelled blocks can be given instead.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Callable, Container, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlab.llm.batches import add_columns

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
_SPECIAL = re.compile("[>\"']")
#: Elements without text of the page, to their end tag or the page's end.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in "script style template svg noscript iframe textarea title".split()}
#: Elements that go with their content; the start tag alone goes if they are not closed before the next one.
CONTROLS = {t: re.compile(rf"<(/?){t}(?=[\s/>])", re.I) for t in ("select", "button")}
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORD = re.compile(r"[A-Za-z]{2,}")
BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Open elements that a start tag ends.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Block elements that a start tag looks past for the open element it ends.
PASSED = frozenset("p li dt dd td th tr".split())
#: Elements that name a part of a page.
PARTS = frozenset("article main aside nav footer header form section".split())
#: Words whose presence in a block's text is a feature.
TEXT_WORDS = frozenset("cookie cookies subscribe newsletter advertisement sponsored copyright rights reserved login sign comment comments reply share privacy terms menu search contact email password submit related read more".split())


class Node:
    """An open element, linked to the one around it, so that blocks share their ancestors. `held` keeps what features need of them."""

    __slots__ = ("tag", "words", "up", "held")

    def __init__(self, tag: str, words: tuple[str, ...], up: Node | None) -> None:
        self.tag, self.words, self.up, self.held = tag, words, up, None


@dataclass
class Block:
    """Text of a leaf block; its innermost open element; share of its text within links."""

    text: str
    node: Node | None
    linked: float


def _tag_ends(page: str) -> Callable[[int], int]:
    """A function of where attributes begin, in growing order: the place of the > that ends them, outside quotes, or -1.

    A quote met outside quotes from which no end was found is remembered, and so is the next special sign: all calls together
    read a page a bounded number of times.
    """
    failed: set[int] = set()
    known = [0, -1]

    def special(at: int) -> int:
        if not known[0] <= at <= known[1]:
            m = _SPECIAL.search(page, at)
            known[:] = [at, m.start() if m else len(page)]
        return known[1]

    def end(at: int) -> int:
        here, met = special(at), []
        while here < len(page) and here not in failed:
            if page[here] == ">":
                return here
            met.append(here)
            close = page.find(page[here], here + 1)
            if close < 0:
                break
            m = _SPECIAL.search(page, close + 1)
            here = m.start() if m else len(page)
        failed.update(met)
        return -1

    return end


def _tokens(page: str) -> Iterator[tuple[str | None, bool, str, str]]:
    """(text, None for a tag; whether it is an end tag; tag name; attributes) in page order, in time linear in the page's length."""
    end, at, size = _tag_ends(page), 0, len(page)
    past = lambda k: size if k < 0 else k + 1
    while at < size:
        if page[at] != "<":
            until = page.find("<", at)
            until = size if until < 0 else until
            yield page[at:until], False, "", ""
            at = until
            continue
        if page.startswith("<!--", at):
            close = page.find("-->", at + 4)
            at = size if close < 0 else close + 3
            continue
        m = _TAG.match(page, at)
        close = end(m.end()) if m else -1
        if close < 0:
            if page[at + 1 : at + 2] in ("!", "?", "/"):
                at = past(page.find(">", at + 2))
            else:
                yield "<", False, "", ""
                at += 1
            continue
        tag, attrs = m.group(2).lower(), page[m.end() : close]
        at = close + 1
        whole = not m.group(1) and (page[m.end()] in "/>" or page[m.end()].isspace())
        if whole and tag in RAW:
            if tag != "svg" or not attrs.endswith("/"):
                over = RAW[tag].search(page, at)
                at = past(page.find(">", over.end())) if over else size
        elif whole and tag in CONTROLS:
            over = CONTROLS[tag].search(page, at)
            close = page.find(">", over.end()) if over and over.group(1) else -1
            at = close + 1 if close >= 0 else at
        else:
            yield None, bool(m.group(1)), tag, attrs


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks with text, in page order. Character references are decoded, white space runs become one space.

    Pages of any length and depth are read in time linear in their length: open elements are counted by tag, never searched for.
    """
    out: list[Block] = []
    stack: list[Node] = []
    places: dict[str, list[int]] = {}
    barriers: list[int] = []
    parts: list[str] = []
    links, some, node = 0, False, None

    def cut(size: int) -> None:
        while len(stack) > size:
            places[stack.pop().tag].pop()
        while barriers and barriers[-1] >= size:
            barriers.pop()

    def flush() -> None:
        nonlocal links, some
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, node, min(1.0, links / len(text))))
        parts.clear()
        links, some = 0, False

    for data, ending, tag, attrs in _tokens(page or ""):
        if data is not None:
            if not some:
                node = stack[-1] if stack else None
            parts.append(data)
            shown = data.strip()
            some = some or bool(shown)
            if places.get("a"):
                links += len(shown)
            continue
        if tag in ("br", "wbr"):
            parts.append(" ")
            continue
        if tag in BLOCK_TAGS:
            flush()
        if ending:
            if places.get(tag):
                cut(places[tag][-1])
            continue
        ends = CLOSES.get(tag) or ({"p"} if tag in BLOCK_TAGS else ())
        last = max((places[t][-1] for t in ends if places.get(t)), default=-1)
        if last > (barriers[-1] if barriers else -1):
            cut(last)
        if tag not in VOID and not attrs.rstrip().endswith("/"):
            words = tuple(w.lower() for v in _NAMED.findall(attrs) for w in _WORD.findall(v))
            places.setdefault(tag, []).append(len(stack))
            if tag in BLOCK_TAGS and tag not in PASSED:
                barriers.append(len(stack))
            stack.append(Node(tag, words, stack[-1] if stack else None))
    flush()
    return out


def _held(node: Node | None, known: Container[str] | None) -> tuple[str, str, frozenset[str]]:
    """(innermost block tag, innermost page part, names of features of all ancestors), kept at the nodes."""
    fresh = []
    while node is not None and node.held is None:
        fresh.append(node)
        node = node.up
    own, part, names = node.held if node is not None else ("none", "none", frozenset())
    for n in reversed(fresh):
        own = n.tag if n.tag in BLOCK_TAGS else own
        part = n.tag if n.tag in PARTS else part
        new = {f for f in (f"in={n.tag}", *(f"named={w}" for w in n.words)) if known is None or f in known}
        names = names if new <= names else names | new
        n.held = own, part, names
    return own, part, names


def block_features(found: list[Block], known: Container[str] | None = None) -> list[list[str]]:
    """Names of the features that hold for each block. With `known`, features of ancestors that are not in it are left out.

    A page's blocks are described with one and the same `known`, which bounds what an element deep in a page carries.
    """
    out, n = [], len(found)
    for k, b in enumerate(found):
        own, part, names = _held(b.node, known)
        f = ["bias", f"own={own}", f"size={min(9, len(b.text).bit_length())}", f"links={int(b.linked * 4)}", f"first={k == 0}", f"place={3 * k // n}"]
        f += names
        f += [f"nearest={part}", f"end={b.text[-1] in '.!?:;)”»…'}", f"commas={min(2, b.text.count(','))}"]
        low = b.text.lower()
        long = "long" if len(low) >= 300 else "short"  # a telling word says less in a long block; the chain weighs both kinds
        f += [f"word={w},{long}" for w in set(_WORD.findall(low)) & TEXT_WORDS]
        if "©" in low or "all rights" in low:
            f.append("copyright")
        out.append(f)
    return out


@dataclass
class Chain:
    """weights[f] of both labels per feature name, label transitions."""

    index: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray

    def decode(self, names: list[list[str]]) -> list[int]:
        """The likeliest labels (Viterbi); ties go to label 1."""
        if not names:
            return []
        get, weights, back = self.index.get, self.weights.tolist(), []
        (m00, m01), (m10, m11) = self.moves.tolist()
        no = yes = 0.0
        for k, fs in enumerate(names):
            e0 = e1 = 0.0
            for f in fs:
                i = get(f)
                if i is not None:
                    w = weights[i]
                    e0 += w[0]
                    e1 += w[1]
            if k:
                a0, b0, a1, b1 = no + m00, yes + m10, no + m01, yes + m11
                back.append((int(b0 >= a0), int(b1 >= a1)))
                no, yes = max(a0, b0), max(a1, b1)
            no, yes = no + e0, yes + e1
        labels = [int(yes >= no)]
        for b in reversed(back):
            labels.append(b[labels[-1]])
        return labels[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], epochs: int = 120, rate: float = 0.2, decay: float = 1e-3) -> Chain:
    """Maximum-likelihood weights (with weight decay) by full gradients over all pages at once, forward-backward in step."""
    pages = [p for p in pages if p[0]]
    index: dict[str, int] = {}
    rows, feats, t_of, p_of = [], [], [], []
    y = []
    for p, (names, labels) in enumerate(pages):
        for t, fs in enumerate(names):
            for f in fs:
                rows.append(len(t_of))
                feats.append(index.setdefault(f, len(index)))
            t_of.append(t)
            p_of.append(p)
            y.append(labels[t])
    rows, feats, t_of, p_of, y = map(np.array, (rows, feats, t_of, p_of, y))
    n_pages, longest = len(pages), int(t_of.max()) + 1
    there = np.zeros((n_pages, longest), bool)
    there[p_of, t_of] = True
    gold = np.zeros((len(index), 2))
    np.add.at(gold, (feats, y[rows]), 1)
    label = np.zeros((n_pages, longest), int)
    label[p_of, t_of] = y
    gold_moves = np.zeros((2, 2))
    both = there[:, 1:] & there[:, :-1]
    np.add.at(gold_moves, (label[:, :-1][both], label[:, 1:][both]), 1)
    w, moves = np.zeros((len(index), 2)), np.zeros((2, 2))
    sw, sm = np.full_like(w, 1e-6), np.full_like(moves, 1e-6)
    lse = lambda a, axis: np.logaddexp.reduce(a, axis=axis)
    for _ in range(epochs):
        e = np.zeros((len(t_of), 2))
        np.add.at(e, rows, w[feats])
        emit = np.zeros((n_pages, longest, 2))
        emit[p_of, t_of] = e
        fwd, bwd = emit.copy(), np.zeros_like(emit)
        for t in range(1, longest):
            go = lse(fwd[:, t - 1, :, None] + moves, 1) + emit[:, t]
            fwd[:, t] = np.where(there[:, t, None], go, fwd[:, t - 1])
        for t in range(longest - 2, -1, -1):
            go = lse(moves + (emit[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
            bwd[:, t] = np.where(there[:, t + 1, None], go, bwd[:, t + 1])
        total = lse(fwd[:, -1], 1)
        post = np.exp(fwd + bwd - total[:, None, None])[p_of, t_of]
        expected = np.zeros_like(w)
        np.add.at(expected, feats, post[rows])
        pair = np.exp(fwd[:, :-1, :, None] + moves + (emit[:, 1:] + bwd[:, 1:])[:, :, None, :] - total[:, None, None, None])
        gw, gm = (gold - expected) / n_pages - decay * w, (gold_moves - pair[both].sum(axis=0)) / n_pages - decay * moves
        sw += gw**2
        sm += gm**2
        w, moves = w + rate * gw / np.sqrt(sw), moves + rate * gm / np.sqrt(sm)
    return Chain(index, w, moves)


#: Names of page parts in the made training pages.
MAIN_NAMES = "content main post entry article body story text maincontent prose".split()
SIDE = {
    "nav": "nav menu navbar navigation breadcrumb toc topbar".split(),
    "header": "header masthead branding top banner site".split(),
    "footer": "footer bottom copyright legal colophon".split(),
    "aside": "sidebar aside widget related recommended trending popular tags".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo banner".split(),
    "notice": "cookie notice consent alert gdpr popup modal overlay warning".split(),
    "form": "form newsletter subscribe signup login search contact".split(),
    "comments": "comments comment reply discussion respond disqus reader responses".split(),
    "share": "share social follow author byline meta".split(),
}


def made_page(rng: random.Random) -> tuple[str, dict[str, int]]:
    """A random page and the label of each of its block texts."""
    labels: dict[str, int] = {}
    syllables = "an the er on re ti es or en at ed nd ha to it is st th ou in le de que ción sch ein ver ü é ß la eau".split()

    def words(n: int) -> str:
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))

    def leaf(n: int, main: int, extra: str = "", end: str = ".") -> str:
        text = (extra + " " if extra else "") + words(n).capitalize() + (rng.choice([end, end, ""]) if n > 3 else "")
        labels[" ".join(text.split())] = main
        return html.escape(text)

    def sentences(main: int) -> str:
        return leaf(rng.choice([2, 6, 12, 30, 60, 120]), main)

    def named(tag: str, names: list[str], inner: str, p: float = 0.85) -> str:
        name = rng.choice(names) + rng.choice(["", "", "-wrap", "_box", " col"])
        attr = f' {rng.choice(["class", "id"])}="{name}"' if rng.random() < p else ""
        return f"<{tag}{attr}>{inner}</{tag}>"

    def links(main: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{leaf(rng.randint(1, 4), main, end="")}</a></li>' for k in range(rng.randint(2, 7))) + "</ul>"

    def body() -> str:
        parts = [f"<h1>{leaf(rng.randint(2, 12), 1)}</h1>"] if rng.random() < 0.9 else []
        if parts and rng.random() < 0.2:
            parts = [f"<header>{parts[0]}</header>"]
        for _ in range(rng.randint(1, 14)):
            kind = rng.random()
            text = sentences(1)
            if kind < 0.62:
                parts.append(f"<p>{text}</p>")
            elif kind < 0.72:
                parts.append(f"<p><b>{text}<br>")
            elif kind < 0.8:
                parts.append(f"<h2>{leaf(rng.randint(1, 8), 1)}</h2>")
            elif kind < 0.88:
                parts.append("<ul>" + "".join(f"<li>{sentences(1)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif kind < 0.93:
                parts.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind < 0.96:
                parts.append(f"<pre>{text}</pre>")
            elif kind < 0.98:
                parts.append(f"<div>{text}</div>")
            else:
                parts.append("<table><tr>" + "".join(f"<td>{leaf(2, 1)}</td>" for _ in range(3)) + "</tr></table>")
            if rng.random() < 0.05:
                parts.append(named("div", SIDE["ad"], f"<p>{sentences(0)}</p>" if rng.random() < 0.5 else sentences(0), 1.0))
            if rng.random() < 0.04:
                parts.append(named("aside", SIDE["aside"], links(0)))
        return "".join(parts)

    def side(kind: str) -> str:
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section"}.get(kind, "div")
        sure = tag in ("nav", "footer", "aside", "form", "header") and rng.random() < 0.6
        if kind in ("nav", "share"):
            inner = links(0)
        elif kind == "footer":
            inner = rng.choice([leaf(6, 0, "© 2024"), f"<p>{leaf(5, 0, 'Copyright')}</p>{links(0)}", leaf(rng.randint(3, 25), 0, "©")])
        elif kind == "header":
            inner = rng.choice([f"<div>{leaf(2, 0)}</div>", f"<h2>{leaf(3, 0)}</h2>{links(0)}", f"<p>{leaf(6, 0)}</p>"])
        elif kind == "form":
            inner = f"<label>{leaf(2, 0, 'Email')}</label><p>{leaf(8, 0, 'Subscribe')}</p><input type='text'>"
        elif kind == "notice":
            inner = f"<p>{leaf(rng.randint(6, 25), 0, rng.choice(['', 'This site uses cookies', 'Privacy']))}</p>"
        elif kind == "comments":
            inner = f"<h3>{leaf(1, 0, 'Comments')}</h3>" + "".join(rng.choice([f"<div class='comment'><p>{sentences(0)}</p></div>", f"<li>{sentences(0)}</li>", f"<article class='comment'><p>{sentences(0)}</p></article>"]) for _ in range(rng.randint(1, 5)))
        elif kind == "ad":
            inner = rng.choice([sentences(0), f"<p>{sentences(0)}</p>", f"<a href='/x'>{leaf(5, 0)}</a>"])
        else:
            inner = rng.choice([f"<h3>{leaf(2, 0)}</h3>{links(0)}", f"<p>{sentences(0)}</p>", f"<p>{sentences(0)}</p>{links(0)}"])
        return named(tag if sure else "div", SIDE[kind], inner, 0.5 if sure else 1.0)

    style = rng.random()
    main = body()
    if style < 0.55:
        main = f"<article>{main}</article>"
    elif style < 0.75:
        main = named("main", MAIN_NAMES, main, 0.3)
    else:
        main = named("div", MAIN_NAMES, main, 1.0)
    before = [side(k) for k in ("notice", "header", "nav", "ad", "aside", "share") if rng.random() < 0.4]
    after = [side(k) for k in ("share", "aside", "form", "comments", "ad", "notice", "footer") if rng.random() < 0.4]
    rng.shuffle(before)
    page = "".join(before) + main + "".join(after)
    if rng.random() < 0.3:
        page = f"<div class='{rng.choice(['wrapper', 'page', 'container'])}'>{page}</div>"
    head = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{words(4)}</title></head>"
    return f"{head}<body>{page}</body></html>", labels


@functools.lru_cache(maxsize=2)
def default_chain(pages: int = 600, seed: int = 17) -> Chain:
    """The chain trained on `pages` made pages."""
    rng = random.Random(seed)
    data = []
    for _ in range(pages):
        page, labels = made_page(rng)
        found = blocks(page)
        data.append((block_features(found), [labels.get(b.text, 0) for b in found]))
    return train(data)


def main_text(page: str | None, chain: Chain) -> str:
    """The blocks labelled as main text, joined by line ends; empty for null, empty or text-free pages."""
    found = blocks(page)
    return "\n".join(b.text for b, on in zip(found, chain.decode(block_features(found, chain.index)), strict=True) if on)


def extract(pages: DataFrame, chain: Chain | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row: null pages give an empty text, repeated rows and null ids are kept."""
    chain = chain or default_chain()

    def run(b: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = [main_text(h, chain) for h in b.column("html").to_pylist()]
        return {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return add_columns(rows, ["html"], "text string, n_chars long", run)
