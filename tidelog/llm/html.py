"""Main-text extraction: a recurrent labeller over the leaf blocks of a page.

A page becomes its sequence of leaf blocks (text between block-level tags). Each block is described by hashed
vectors of its tag path (tags, class and id words of all ancestors, the nearest ones again), hashed vectors of its
words, and a few sizes. A bidirectional LSTM in numpy reads the whole sequence and labels every block as main text
or not, so each decision sees the document. It is trained here, on pages written by a small seeded grammar with
menus, headers, sidebars, notices, adverts, forms, comments and footers around and inside articles of invented
words; no page of the table takes part. The fit does not depend on the input and takes some seconds.

Null html counts as empty; pages without main text give an empty text and n_chars 0. Long pages are labelled whole.
Markup that is broken or not closed is read as it stands: text belongs to the block that is open. Left out is only what
HTML reads as raw text or never shows (scripts, styles, templates, sources of formulas, titles of drawings), and only up
to an end tag that is there. A quoted value hides a > only behind an = and up to a quote that is there; once the quotes of
a tag run to the end of the page, they hide no > in the rest of it. Formulas are part of their sentence; text of drawings,
objects, canvases and choices is labelled as blocks of its own. Reading takes time and memory in proportion to the page,
however deep or broken its markup. Repeated rows give repeated results; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, map_rows

PATHS, WORDS, SIZES, HIDDEN, SEED = 256, 64, 5, 16, 5
DIM = PATHS + WORDS + SIZES
TOGETHER = 1 << 20  # characters of pages that are labelled together

# Elements that HTML reads as raw text or never shows, elements inside a block, those that end a block only
# where they have text, and elements without end tag.
RAW = "script style noscript iframe textarea template annotation annotation-xml desc metadata".split()
MATH = set("math maction menclose merror mfenced mfrac mi mlabeledtr mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
DRAWN = set("object canvas svg animate animatemotion animatetransform circle clippath defs ellipse filter foreignobject g image line lineargradient marker mask mpath path pattern polygon polyline radialgradient rect set stop switch symbol text textpath tspan use view".split())
INLINE = MATH | set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
BEGUN = re.compile(r"</?[a-zA-Z]")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in [*RAW, "title"]}


def _names(element: str) -> tuple[str, ...]:
    """Of a tag and its attributes, with a zero byte between them: the tag and the words of class, id and role."""
    tag, _, attributes = element.partition("\0")
    found = [tag]
    if "=" in attributes:
        for _, value in ATTRIBUTE.findall(attributes):
            found += [w for w in re.split(r"[^a-z0-9]+", value.strip("\"'").lower()) if w]
    return tuple(found)


_known_names = Memo(_names, 32 << 20)


def _marks(names: tuple[str, ...], seed: int = 0) -> int:
    return sum(1 << k for k in {crc32(n.encode("utf-8", "surrogatepass"), seed) % PATHS for n in names})


class Node:
    """An open element, which knows its parent, so that a path costs no more than its last element."""

    __slots__ = ("tag", "names", "parent", "above", "vector")

    def __init__(self, tag: str, names: tuple[str, ...], parent: "Node | None"):
        self.tag, self.names, self.parent = tag, names, parent
        self.above = _marks(names) | (parent.above if parent else 0)  # hashed names of all elements of the path
        self.vector = self.above | _marks(names, 1) | (_marks(parent.names, 2) if parent else 0)  # the nearest two again

    def path(self) -> list[tuple[str, ...]]:
        """Names of the elements from the outermost on."""
        out, node = [], self
        while node.parent:
            out.append(node.names)
            node = node.parent
        return out[::-1]


def blocks(page: str) -> list[tuple[str, Node, int]]:
    """(text, innermost element, characters inside links) of each leaf block with text, in page order."""
    out: list = []
    top = root = Node("", (), None)
    depth: dict[str, int] = {}  # open elements by tag
    parts: list[str] = []
    at = linked = 0
    in_link = False
    held = None  # innermost element of the open block, once a drawn element began or ended in it
    missing = set()  # raw elements without an end tag in the rest of the page
    tag_at = TAG

    def flush():
        nonlocal linked, in_link, held
        if parts:
            raw = "".join(parts)
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append((text, held or top, min(linked, len(text))))
            parts.clear()
        linked, in_link, held = 0, False, None

    def add(text):
        nonlocal linked, in_link, held
        if held and text.strip():
            if held is not top:
                link = in_link
                flush()
                in_link = link
            held = None
        parts.append(text)
        if in_link:
            linked += len(text)

    def close():
        nonlocal top
        depth[top.tag] -= 1
        top = top.parent

    end, last = len(page), page.rfind(">")
    while at < end:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        if page.startswith("<!--", start):
            if start > at:
                add(page[at:start])
            at = page.find("-->", start + 4) + 3
            if at < 3:
                break
            continue
        if page.startswith("<![CDATA[", start):
            if start > at:
                add(page[at:start])
            to = page.find("]]>", start + 9)
            add(page[start + 9 : to if to >= 0 else end].replace("&", "&amp;"))
            at = to + 3 if to >= 0 else end
            continue
        if start > last:  # no tag ends any more
            to = page.find("<!", start + 1)
            add(page[at : to if to >= 0 else end])
            at = to if to >= 0 else end
            continue
        if page[start + 1 : start + 2] in ("!", "?"):
            if start > at:
                add(page[at:start])
            at = page.index(">", start) + 1
            continue
        m = tag_at.match(page, start)
        if m is None:
            if not BEGUN.match(page, start):  # no tag
                add(page[at : start + 1])
                at = start + 1
                continue
            tag_at = PLAIN_TAG
            m = tag_at.match(page, start)
        if start > at:
            add(page[at:start])
        at = m.end()
        tag = m[2].lower()
        if tag in RAW_END and (tag != "title" or depth.get("svg")):
            if not m[1] and not m[3].endswith("/") and tag not in missing:
                shut = RAW_END[tag].search(page, at)
                if shut:
                    at = shut.end()
                else:
                    missing.add(tag)
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = not m[1]
            elif tag == "br":
                parts.append(" ")
            continue
        if tag not in DRAWN:
            flush()
        elif parts and not held:
            held = top
        if m[1]:
            if depth.get(tag):
                while top.tag != tag:
                    close()
                close()
        elif tag not in VOID and not (tag in DRAWN and m[3].endswith("/")):
            if top.tag == tag and tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
                close()
            top = Node(tag, _known_names[f"{tag}\0{m[3]}"], top)
            depth[tag] = depth.get(tag, 0) + 1
    flush()
    return out


def word_bucket(word: str) -> int:
    return crc32(word.lower().strip(".,:;!?()").encode("utf-8", "surrogatepass")) % WORDS


def describe(found: list, memo: Memo, of: int | None = None, at: int = 0) -> np.ndarray:
    """Vectors of blocks; of a page of ``of`` blocks, if these are only those from ``at`` on."""
    n = of or len(found)
    x = np.zeros((len(found), DIM), np.float32)
    if found:
        marks = np.frombuffer(b"".join(node.vector.to_bytes(PATHS // 8, "little") for _, node, _ in found), np.uint8)
        x[:, :PATHS] = np.unpackbits(marks.reshape(len(found), -1), axis=1, bitorder="little")
    for k, (text, _, linked) in enumerate(found):
        words = text.split(" ")
        row = x[k]
        row[PATHS : PATHS + WORDS] = np.bincount(np.fromiter(map(memo.__getitem__, words), np.int64, len(words)), minlength=WORDS) / len(words) ** 0.5
        row[-SIZES:] = np.log1p(len(words)) / 4, linked / len(text), np.log1p(n) / 4, (at + k) / n, text[-1] in ".!?"
    return x


def project(p: dict, found: list, memo: Memo) -> np.ndarray:
    """What the blocks of a page bring to the gates of both directions, a stretch of blocks at a time."""
    both = np.concatenate([p["wf"], p["wb"]], 1)
    return np.concatenate([describe(found[at : at + 4096], memo, len(found), at) @ both for at in range(0, len(found), 4096)] or [np.empty((0, 8 * HIDDEN), np.float32)])


# --- the network ---------------------------------------------------------------------------------------------


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _start(random: np.random.Generator) -> dict[str, np.ndarray]:
    p = {"out": random.standard_normal((2 * HIDDEN, 1)) * 0.3, "bias": np.zeros(1)}
    for d in "fb":
        p |= {f"w{d}": random.standard_normal((DIM, 4 * HIDDEN)) * 0.1, f"u{d}": random.standard_normal((HIDDEN, 4 * HIDDEN)) * 0.2, f"b{d}": np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]}
    return {k: v.astype(np.float32) for k, v in p.items()}


def _lstm(z: np.ndarray, u: np.ndarray, mask: np.ndarray, learn: bool = True):
    """z: steps x batch x 4 hidden inputs to the gates. Hidden states and, to ``learn``, what the backward pass needs."""
    steps, batch, _ = z.shape
    h = c = np.zeros((batch, HIDDEN), np.float32)
    hs, saved = np.empty((steps, batch, HIDDEN), np.float32), []
    for t in range(steps):
        g = z[t] + h @ u
        gates = _sigmoid(g[:, : 3 * HIDDEN])
        i, f, o, new = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(g[:, 3 * HIDDEN :])
        c2 = f * c + i * new
        th = np.tanh(c2)
        m = mask[t][:, None]
        if learn:
            saved.append((h, c, i, f, o, new, th))
        h, c = np.where(m, o * th, h), np.where(m, c2, c)
        hs[t] = h
    return hs, saved


def _back(dhs: np.ndarray, u: np.ndarray, mask: np.ndarray, saved) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of z and u."""
    steps, batch, _ = dhs.shape
    dz, du = np.zeros((steps, batch, 4 * HIDDEN), np.float32), np.zeros_like(u)
    dh = dc = np.zeros((batch, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, new, th = saved[t]
        m = mask[t][:, None]
        dh = dh + dhs[t]
        live, dct = dh * m, dc * m
        dct = dct + live * o * (1 - th * th)
        d = np.concatenate([dct * new * i * (1 - i), dct * c * f * (1 - f), live * th * o * (1 - o), dct * i * (1 - new * new)], 1)
        dz[t] = d
        du += h.T @ d
        dh, dc = dh * (1 - m) + d @ u.T, dc * (1 - m) + dct * f
    return dz, du


def _flip(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each sequence reversed inside its own length (steps first)."""
    t = np.arange(x.shape[0])[:, None]
    at = np.where(t < lengths, lengths - 1 - t, t)
    return x[at, np.arange(x.shape[1])]


def _padded(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(s) for s in seqs])
    x = np.zeros((lengths.max(), len(seqs), seqs[0].shape[1]), np.float32)
    for k, s in enumerate(seqs):
        x[: len(s), k] = s
    return x, lengths, np.arange(len(x))[:, None] < lengths


def probabilities(p: dict, seqs: list[np.ndarray]) -> list[np.ndarray]:
    """Of main text, for each block of each page, from what ``project`` gives. Pages of like length share a batch of
    bounded size."""
    out: list = [np.empty(0, np.float32)] * len(seqs)
    order = sorted((k for k in range(len(seqs)) if len(seqs[k])), key=lambda k: len(seqs[k]))
    at = 0
    while at < len(order):
        upto = at + 1
        while upto < len(order) and upto - at < 128 and (upto - at + 1) * len(seqs[order[upto]]) <= 8192:
            upto += 1
        part = order[at:upto]
        x, lengths, mask = _padded([seqs[k] for k in part])
        forward, _ = _lstm(x[:, :, : 4 * HIDDEN] + p["bf"], p["uf"], mask, False)
        backward, _ = _lstm(_flip(x[:, :, 4 * HIDDEN :], lengths) + p["bb"], p["ub"], mask, False)
        y = _sigmoid(np.concatenate([forward, _flip(backward, lengths)], 2) @ p["out"] + p["bias"])[:, :, 0]
        for j, k in enumerate(part):
            out[k] = y[: lengths[j], j]
        at = upto
    return out


def train(pages: int = 500, epochs: int = 8, seed: int = SEED) -> dict[str, np.ndarray]:
    random = np.random.default_rng(seed)
    memo = Memo(word_bucket)
    made = []
    for _ in range(pages):
        page, main = write_page(random)
        found = blocks(page)
        made.append((describe(found, memo), np.array([text in main for text, _, _ in found], np.float32)))
    p = _start(random)
    mean, square, step = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2)), None, 0
    mean, square = mean
    for epoch in range(epochs):
        order = random.permutation(len(made))
        for at in range(0, len(order), 20):
            part = [made[k] for k in order[at : at + 20]]
            x, lengths, mask = _padded([a for a, _ in part])
            target = _padded([b[:, None] for _, b in part])[0][:, :, 0]
            x = x * (random.random((len(x), x.shape[1], DIM)) > 0.15)  # dropout: no single sign may decide
            xr = _flip(x, lengths)
            hf, sf = _lstm(x @ p["wf"] + p["bf"], p["uf"], mask)
            hb, sb = _lstm(xr @ p["wb"] + p["bb"], p["ub"], mask)
            both = np.concatenate([hf, _flip(hb, lengths)], 2)
            y = _sigmoid(both @ p["out"] + p["bias"])[:, :, 0]
            d = ((y - target) * mask / mask.sum()).astype(np.float32)[:, :, None]
            grads = {"out": (both * d).sum((0, 1))[:, None], "bias": d.sum((0, 1))}
            dh = d @ p["out"].T
            for side, inputs, saved, g in (("f", x, sf, dh[:, :, :HIDDEN]), ("b", xr, sb, _flip(dh[:, :, HIDDEN:], lengths))):
                dz, grads[f"u{side}"] = _back(g, p[f"u{side}"], mask, saved)
                grads[f"w{side}"] = inputs.reshape(-1, DIM).T.astype(np.float32) @ dz.reshape(-1, 4 * HIDDEN)
                grads[f"b{side}"] = dz.sum((0, 1))
            step += 1
            rate = 0.01 * (1 - epoch / epochs) + 0.001
            for k, g in grads.items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                p[k] = (p[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return p


@lru_cache(1)
def trained() -> dict[str, np.ndarray]:
    """The same network for all queries of a driver, as its training depends on nothing."""
    return train()


# --- the grammar that writes training pages --------------------------------------------------------------------

# Names and words of page parts.
MAIN_NAMES = "content main article post entry story body text article-body post-content entry-content page-content".split()
SIDE_NAMES = "sidebar widget related aside secondary recommended trending".split()
NOTICE_NAMES = "cookie notice consent gdpr banner popup newsletter modal alert".split()
AD_NAMES = "ad ads advert advertisement sponsor sponsored promo promotion".split()
MENU_NAMES = "menu nav navbar navigation breadcrumb breadcrumbs topbar links".split()
COMMENT_NAMES = "comments comment replies discussion responses disqus".split()
HEAD_NAMES = "header site-header masthead top branding".split()
FOOT_NAMES = "footer site-footer bottom copyright legal".split()
SHARE_NAMES = "share social meta byline tags".split()
BOILER_WORDS = """home menu login search subscribe cookie cookies accept privacy policy terms copyright rights reserved advertisement
sponsored comment comments reply share follow contact about newsletter email password submit read more related anmelden datenschutz
impressum suche accueil connexion recherche inicio buscar contacto siguiente""".split()


def write_page(r: np.random.Generator) -> tuple[str, set[str]]:
    """A page and the texts of its main blocks."""
    syllables = ["".join(r.choice(list("bcdfghlmnprstvéüñ"))) + "".join(r.choice(list("aeiouàö"))) for _ in range(40)] + ["th", "tion", "ing", "er", "sch"]
    main: set[str] = set()
    serial = 0

    def words(n: int, boiler: float = 0.0) -> str:
        out = [r.choice(BOILER_WORDS) if r.random() < boiler else "".join(r.choice(syllables, r.integers(1, 5))) for _ in range(max(1, n))]
        return " ".join(out)

    def text(n: int, boiler: float = 0.0) -> str:
        nonlocal serial
        serial += 1
        s = words(n, boiler) + f" {serial}"  # a number tells blocks apart
        s = s.upper() if shout else s[0].upper() + s[1:]
        return s + r.choice([".", ".", ".", "", "!", "***"])

    def pick(names) -> str:
        return f' {r.choice(["class", "class", "id"])}="{r.choice(names)}"' if r.random() < 0.85 else ""

    def kept(n: int) -> str:
        s = text(n)
        main.add(s)
        return s

    shout = r.random() < 0.1
    size = lambda: int(r.choice([2, 5, 12, 30, 60, 120]))
    link = lambda n=2: f'<a href="/{words(1)}">{text(n, 0.3)}</a>'
    plain = r.random() < 0.4  # real pages often name nothing but elements

    def menu() -> str:
        items = "".join(f"<li>{link(int(r.integers(1, 3)))}</li>" for _ in range(r.integers(2, 9)))
        return f"<nav{'' if plain else pick(MENU_NAMES)}><ul>{items}</ul></nav>" if r.random() < 0.6 else f"<div{pick(MENU_NAMES)}><ul>{items}</ul></div>"

    def advert() -> str:
        return f'<div class="{r.choice(AD_NAMES)}">{text(size() // 2, 0.2)}</div>'

    def notice() -> str:
        return f'<div {r.choice(["class", "id"])}="{r.choice(NOTICE_NAMES)}"><p>{text(size() // 3, 0.4)}</p><button>{text(1, 0.9)}</button></div>'

    def form() -> str:
        return f"<form{pick(['search', 'login', 'subscribe'])}><label>{text(2, 0.8)}</label><input name='q'><button>{text(1, 0.9)}</button></form>"

    def side() -> str:
        tag = r.choice(["aside", "div", "section"])
        name = pick(SIDE_NAMES) if tag == "aside" else f' class="{r.choice(SIDE_NAMES)}"'
        return f"<{tag}{name}><h3>{text(2, 0.4)}</h3>" + "".join(f"<p>{text(size() // 3, 0.1)}</p>" if r.random() < 0.5 else f"<ul><li>{link(4)}</li></ul>" for _ in range(r.integers(1, 4))) + f"</{tag}>"

    def comments() -> str:
        tag = r.choice(["div", "section", "ul"])
        own = "li" if tag == "ul" else "div"
        return f'<{tag} {r.choice(["class", "id"])}="{r.choice(COMMENT_NAMES)}"><h3>{text(2, 0.5)}</h3>' + "".join(f'<{own} class="comment"><span>{words(1)}</span><p>{text(size() // 2)}</p></{own}>' for _ in range(r.integers(1, 5))) + f"</{tag}>"

    def head() -> str:
        tag, name = ("header", "" if plain else pick(HEAD_NAMES)) if r.random() < 0.7 else ("div", f' class="{r.choice(HEAD_NAMES)}"')
        return f"<{tag}{name}><p>{text(3, 0.2)}</p></{tag}>"

    def foot() -> str:
        tag, name = ("footer", "" if plain else pick(FOOT_NAMES)) if r.random() < 0.8 else ("div", f' class="{r.choice(FOOT_NAMES)}"')
        return f"<{tag}{name}>&copy; {text(size() // 4, 0.4)}</{tag}>" if r.random() < 0.5 else f"<{tag}{name}><p>{text(4, 0.4)}</p><p>{link()}</p></{tag}>"

    def share() -> str:
        return f'<div class="{r.choice(SHARE_NAMES)}">{link(1)} {link(1)}</div>'

    def body() -> str:
        out = [f"<h1>{kept(int(r.integers(2, 10)))}</h1>"] if r.random() < 0.85 else []
        for _ in range(int(r.choice([1, 2, 4, 8, 16, 30]))):
            kind = r.random()
            if kind < 0.72:
                a, b = ("<b>", "</b>") if r.random() < 0.1 else ("", "")
                out.append(f"<p>{a}{kept(size())}{b}{'</p>' if r.random() < 0.95 else '<br>'}")
            elif kind < 0.78:
                out.append(f"<h2>{kept(3)}</h2>")
            elif kind < 0.83:
                out.append("<ul>" + "".join(f"<li>{kept(size() // 2)}</li>" for _ in range(r.integers(2, 5))) + "</ul>")
            elif kind < 0.87:
                out.append(f"<blockquote>{kept(size())}</blockquote>")
            elif kind < 0.89:
                out.append("<table>" + "".join(f"<tr><td>{kept(2)}</td><td>{kept(2)}</td></tr>" for _ in range(2)) + "</table>")
            elif kind < 0.91:
                out.append(f"<pre>{kept(6)}</pre>")
            elif kind < 0.94:
                out.append(r.choice([advert, share, notice, form, side])())
            else:
                out.append(f"<div>{kept(size())}</div>")
        return "".join(out)

    inner = body()
    after = comments() if r.random() < 0.3 else ""
    shape = r.random()
    if shape < 0.55:
        core = f"<article{'' if plain else pick(MAIN_NAMES)}>{inner}{after if r.random() < 0.5 else ''}</article>{after}"
    elif shape < 0.75:
        core = f"<main>{inner}</main>{after}"
    else:
        core = f'<div {r.choice(["class", "id"])}="{r.choice(MAIN_NAMES)}">{inner}</div>{after}'
    if r.random() < 0.3:
        core = f"<main><section>{core}</section></main>"
    maker = [menu, advert, notice, form, side, head, share]
    before = "".join(r.choice([menu, menu, head, advert, notice, form, share, side])() for _ in range(r.integers(0, 5)))
    behind = "".join(r.choice(maker)() for _ in range(r.integers(0, 4))) + (foot() if r.random() < 0.85 else "")
    wrap = (f'<div class="{r.choice(["wrapper", "container", "page", "row"])}">', "</div>") if r.random() < 0.4 else ("", "")
    return f"<!DOCTYPE html><html><head><title>{text(4)}</title></head><body>{wrap[0]}{before}{core}{behind}{wrap[1]}</body></html>", main


def main_text(p: dict, pages: list[str]) -> list[str]:
    memo = _memo()
    out: list[str] = []
    at = 0
    while at < len(pages):  # as many pages together as have so many characters
        upto, size = at, 0
        while upto < len(pages) and (upto == at or size + len(pages[upto]) <= TOGETHER):
            size += len(pages[upto])
            upto += 1
        found = [blocks(page) for page in pages[at:upto]]
        chosen = probabilities(p, [project(p, b, memo) for b in found])
        out += ["\n".join(text for (text, _, _), y in zip(b, keep) if y >= 0.5) for b, keep in zip(found, chosen)]
        at = upto
    return out


@lru_cache(1)
def _memo() -> Memo:
    return Memo(word_bucket, 32 << 20)


def extract(pages: DataFrame, model: dict | None = None) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    p = model or trained()

    def make():
        def step(b):
            texts = main_text(p, b["html"])
            return {"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]}

        return step

    return map_rows(pages, ["page_id", "url", F.coalesce("html", F.lit("")).alias("html")], "page_id long, url string, text string, n_chars long", make)
