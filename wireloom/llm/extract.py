"""Main text of web pages: a bidirectional LSTM in numpy labels every block of a page, seeing all blocks before and after it.

A page is read as the sequence of its blocks: runs of text between tags that start or end a block. A block is described by its path of
tags, classes, ids and roles (hashed to a vector), by its words (hashed alike) and by a few counts. Pages that mark their article in the
markup teach the network; while it learns, containers are renamed, foreign blocks put in and paths hidden, so that it also reads pages that mark less.
"""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATH, WORDS, COUNTS, HIDDEN = 384, 32, 7, 16
INPUT = PATH + WORDS + COUNTS
TABLE = 4096
STEPS = 1024  # blocks of a page that are held as vectors at a time
WINDOW = 64  # blocks of a page that are learnt together

# Element names of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template svg math".split())
CLOSED_BY = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "body": {"head"}}
ARTICLE = frozenset(("article", "main", "@main", "@article"))
APART = frozenset(
    "nav header footer aside form button select textarea noscript menu dialog iframe object head title label fieldset "
    ".ad .ads .advert .advertisement .sponsor .sponsored .promo .banner .sidebar .widget .menu .nav .navbar .navigation .breadcrumb .breadcrumbs .header .masthead .footer .cookie .cookies "
    ".consent .notice .alert .popup .modal .overlay .share .social .comment .comments .reply .replies .discussion .related .recommended .newsletter .subscribe .signup .login .search .pagination .tags "
    ".copyright .legal .toolbar .author .byline .skip @navigation @banner @contentinfo @complementary @search @form @dialog @alert".split()
)
BODIES = (("main",), ("section",), ("div", ".content"), ("div", ".post"), ("div", ".entry"), ("div", ".story"), ("div", ".article"), ("div", ".text"), ("div",), ("td",))

_token = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>|<[!?/][^>]*+(?:>|\Z)", re.S)
_attr = re.compile(r"""(?<![\w-])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_word = re.compile(r"[a-z0-9]+")
_rng = np.random.default_rng(12)
_WORD_VECTORS = _rng.choice(np.array([-1, 1], np.float32), (TABLE, WORDS))


def _places_of(token: str) -> list[int]:
    """Two places for each tag, class, id or role, so that two of them hardly ever share both."""
    h = zlib.crc32(token.encode("utf-8", "surrogatepass"))
    return [h % PATH, (h // PATH) % PATH]


class Path:
    """The block elements around a text. Equal paths are one object, so each path's vector is made once."""

    __slots__ = ("parent", "tokens", "n", "article", "apart", "kids", "vector")
    made = 0

    def __init__(self, parent: Path | None, tokens: tuple[str, ...]):
        self.parent, self.tokens, self.kids = parent, tokens, {}
        self.n = 0 if parent is None else parent.n + len(tokens)
        self.article = parent is not None and (parent.article or not ARTICLE.isdisjoint(tokens))
        self.apart = parent is not None and (parent.apart or not APART.isdisjoint(tokens))
        self.vector = np.zeros(PATH, np.float32) if parent is None else parent.vector.copy()
        for t in tokens:
            self.vector[_places_of(t)] = 1
        Path.made += 1

    def child(self, tokens: tuple[str, ...]) -> Path:
        got = self.kids.get(tokens)
        if got is None:
            got = self.kids[tokens] = Path(self, tokens)
        return got

    def steps(self) -> list[tuple[str, ...]]:
        out, at = [], self
        while at.parent is not None:
            out.append(at.tokens)
            at = at.parent
        return out[::-1]


_root = Path(None, ())


def _top() -> Path:
    """The root of all paths; forgotten with all paths below when these have become many."""
    global _root
    if Path.made > 50_000:
        Path.made, _root = 0, Path(None, ())
    return _root


def _tokens(tag: str, attrs: str) -> tuple[str, ...]:
    out = [tag]
    if "=" in attrs:
        for m in _attr.finditer(attrs):
            value = (m[2] or m[3] or m[4] or "").lower()
            out += [("@" if m[1].lower() in ("role", "itemprop") else ".") + w for w in _word.findall(value.replace("articlebody", "article"))]
    return tuple(dict.fromkeys(out))


def blocks(page: str) -> list[tuple[Path, str, float]]:
    """(path, text, share of linked characters) of every block with text. References are decoded, white space is one space, ends are trimmed."""
    path, tags, linked, out = _top(), [], [False], []
    pieces, links = [], 0

    def flush():
        nonlocal pieces, links
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append((path, text, min(1.0, links / max(1, len(text)))))
        pieces, links = [], 0

    def text(raw: str):
        nonlocal links
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            pieces.append(raw)
            if linked[-1]:
                links += len(raw.strip())

    def pop():
        nonlocal path
        path = path.parent
        tags.pop()
        linked.pop()

    open_, at, size = {}, 0, len(page)
    while at < size:
        m = _token.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at, tag = m.end(), (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            if tag in INLINE:
                linked[-1] = linked[-1] and tag != "a"
            elif open_.get(tag):
                flush()
                while tags:
                    last = tags[-1]
                    open_[last] -= 1
                    pop()
                    if last == tag:
                        break
            elif tag not in VOID:
                flush()
        elif tag in SILENT:
            stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = stop.end() if stop else size
        elif tag in INLINE:
            linked[-1] = linked[-1] or tag == "a"
        elif tag == "br":
            pieces.append(" ")
        elif tag in VOID:
            if tag == "hr":
                flush()
        else:
            flush()
            closes = CLOSED_BY.get(tag, {"p"})
            while tags and tags[-1] in closes:
                open_[tags[-1]] -= 1
                pop()
            tags.append(tag)
            linked.append(linked[-1])
            open_[tag] = open_.get(tag, 0) + 1
            path = path.child(_tokens(tag, m["attrs"]))
    flush()
    return out


class _WordPlaces(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = at = zlib.crc32(word.encode("utf-8", "surrogatepass")) % TABLE
        return at


_places = _WordPlaces()


def features(some: list[tuple[Path, str, float]]) -> np.ndarray:
    """One row per block: path, words (of bounded length however often one repeats), counts."""
    out, longest = np.zeros((len(some), INPUT), np.float32), WORDS**0.5
    for k, (path, text, linked) in enumerate(some):
        ws = text.lower().split(" ")
        total = np.zeros(WORDS, np.float32)
        for at in range(0, len(ws), 65536):
            total += _WORD_VECTORS[[_places[w] for w in ws[at : at + 65536]]].sum(axis=0)
        marks = sum(map(text.count, ".,;:!?"))
        out[k, :PATH] = path.vector
        out[k, PATH : PATH + WORDS] = total / max(len(ws) ** 0.5, float(np.linalg.norm(total)) / longest)
        out[k, PATH + WORDS :] = (np.log1p(len(text)) / 6, np.log1p(len(ws)) / 5, linked, marks / (1 + len(ws)), float(text[-1:] in ".!?…\"”»"), float(text[0].isupper()), np.log1p(path.n) / 3)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _start() -> list[np.ndarray]:
    """Weights of both directions (input, state, bias) and of the output (both states, bias)."""
    rng, out = np.random.default_rng(7), []
    for _ in range(2):
        bias = np.zeros(4 * HIDDEN, np.float32)
        bias[HIDDEN : 2 * HIDDEN] = 1  # remember at first
        out += [rng.normal(0, 0.1, (INPUT, 4 * HIDDEN)).astype(np.float32), rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)).astype(np.float32), bias]
    return [*out, rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32), np.zeros(1, np.float32)]


def _step(z: np.ndarray, c: np.ndarray):
    i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
    g = np.tanh(z[:, 3 * HIDDEN :])
    new = f * c + i * g
    return i, f, o, g, new, o * np.tanh(new)


def _learn(weights: list[np.ndarray], x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean logistic loss over the marked blocks; ``x`` is time x pages x features."""
    steps, pages = mask.shape
    states, seen = [], []
    for way in range(2):
        w, u, b = weights[3 * way : 3 * way + 3]
        z, h, c, kept, all_h = x @ w + b, np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32), {}, np.zeros((steps, pages, HIDDEN), np.float32)
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            gates = _step(z[t] + h @ u, c)
            m = mask[t][:, None]
            kept[t] = (h, c, *gates)
            c, h = gates[4] * m + c * (1 - m), gates[5] * m + h * (1 - m)
            all_h[t] = h
        states.append(kept)
        seen.append(all_h)
    v, bias = weights[6], weights[7]
    logit = seen[0] @ v[:HIDDEN] + seen[1] @ v[HIDDEN:] + bias
    d = (_sigmoid(logit) - y) * mask / max(1.0, mask.sum())
    grads = [np.zeros_like(a) for a in weights]
    grads[6] = np.concatenate([np.einsum("tp,tph->h", d, s) for s in seen])
    grads[7] = np.array([d.sum()], np.float32)
    for way in range(2):
        u, kept = weights[3 * way + 1], states[way]
        dh, dc = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        dz_all = np.zeros((steps, pages, 4 * HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1) if way == 0 else range(steps):
            h, c, i, f, o, g, new, _ = kept[t]
            m = mask[t][:, None]
            out = dh + d[t][:, None] * v[way * HIDDEN : (way + 1) * HIDDEN]
            th = np.tanh(new)
            dnew = (dc + out * o * (1 - th * th)) * m
            dz = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), out * m * th * o * (1 - o), dnew * i * (1 - g * g)], axis=1)
            dz_all[t] = dz
            grads[3 * way + 1] += h.T @ dz
            dh, dc = dz @ u.T + out * (1 - m), dnew * f + dc * (1 - m)
        grads[3 * way] = np.einsum("tpi,tpk->ik", x, dz_all)
        grads[3 * way + 2] = dz_all.sum(axis=(0, 1))
    return grads


def _varied(page: list, pool: list, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A window of a page as features and labels, with the article's container renamed, foreign blocks put in, or paths hidden.

    ``page`` and ``pool`` hold pairs of a path and a block's features.
    """
    at = int(rng.integers(0, max(1, len(page) - WINDOW // 2)))
    rename = BODIES[rng.integers(len(BODIES))] if rng.random() < 0.4 else None
    out, labels = [], []
    for path, own in page[at : at + WINDOW // 2]:
        good = path.article and not path.apart
        if rename and good:
            path = _joined([rename if not ARTICLE.isdisjoint(t) else t for t in path.steps()])
        elif path.apart and rng.random() < 0.3:
            path = _joined([_foreign(rng) if not APART.isdisjoint(t) else t for t in path.steps()])
        if rng.random() < 0.2:  # e.g. comments, an advert or another header, of any words, inside the article or beside it
            steps = path.steps()[: rng.integers(1, len(path.steps()) + 1)]
            around = _joined([*(t for t in steps if t[0] not in ("p", "h1")), _foreign(rng)])
            for _ in range(min(int(rng.integers(1, 4)), WINDOW - 1 - len(out))):
                inner = ("p", "", "h2", "li", "div", "")[rng.integers(6)]
                out.append((around.child((inner,)) if inner else around, pool[rng.integers(len(pool))][1]))
                labels.append(0)
        if len(out) < WINDOW:
            out.append((path, own))
            labels.append(int(good))
    x = np.stack([own for _, own in out])
    x[:, :PATH] = [p.vector for p, _ in out]
    x[:, -1] = [np.log1p(p.n) / 3 for p, _ in out]
    if rng.random() < 0.15:
        x[:, :PATH] = 0
    return x, np.array(labels, np.float32)


_APART = sorted(APART - {"head", "title"})


def _foreign(rng: np.random.Generator) -> tuple[str, ...]:
    name = _APART[rng.integers(len(_APART))]
    return (name,) if name[0] not in ".@" else (("div", "section", "ul")[rng.integers(3)], name)


def _joined(steps: list) -> Path:
    path = _top()
    for s in steps:
        path = path.child(s)
    return path


def fit(pages: list[str], updates: int = 300, batch: int = 24) -> list[np.ndarray]:
    """Weights learnt from those pages that mark an article; all zero without such a page."""
    read = [b for b in map(blocks, pages) if any(p.article and not p.apart for p, _, _ in b)]
    weights = _start()
    if not read:
        return [np.zeros_like(w) for w in weights]
    read = [list(zip([p for p, _, _ in b], features(b), strict=True)) for b in read]
    rng, pool = np.random.default_rng(3), [x for b in read for x in b]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for n in range(1, updates + 1):
        some = [_varied(read[k], pool, rng) for k in rng.integers(len(read), size=batch)]
        steps = max(len(y) for _, y in some)
        x, y, mask = np.zeros((steps, batch, INPUT), np.float32), np.zeros((steps, batch), np.float32), np.zeros((steps, batch), np.float32)
        for k, (xs, ys) in enumerate(some):
            x[: len(ys), k], y[: len(ys), k], mask[: len(ys), k] = xs, ys, 1
        rate = 0.02 * min(1.0, 2 * (1 - n / (updates + 1)))
        for w, g, a, b in zip(weights, _learn(weights, x, y, mask), first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= rate * (a / (1 - 0.9**n)) / (np.sqrt(b / (1 - 0.99**n)) + 1e-7)
    return weights


def margins(weights: list[np.ndarray], pages: list[list]) -> list[np.ndarray]:
    """The network's logit for every block of each page; long pages go piece by piece, forwards and then backwards."""
    out = [None] * len(pages)
    order = sorted(range(len(pages)), key=lambda k: len(pages[k]))
    while order:
        longest = max(1, len(pages[order[-1]]))
        group = [order.pop() for _ in range(min(len(order), max(1, 8 * STEPS // longest)))]
        size, held, logits = np.array([len(pages[k]) for k in group]), {}, np.full((longest, len(group)), weights[7][0], np.float32)
        for way in range(2):
            w, u, b = weights[3 * way : 3 * way + 3]
            v = weights[6][way * HIDDEN : (way + 1) * HIDDEN]
            h, c = np.zeros((len(group), HIDDEN), np.float32), np.zeros((len(group), HIDDEN), np.float32)
            starts = range(0, longest, STEPS)
            for start in starts if way == 0 else reversed(starts):
                steps = min(STEPS, longest - start)
                x = held.pop(start, None)
                if x is None:
                    x = np.zeros((steps, len(group), INPUT), np.float32)
                    for j, k in enumerate(group):
                        some = features(pages[k][start : start + steps])
                        x[: len(some), j] = some
                    if longest <= STEPS:
                        held[start] = x
                z = x @ w + b
                for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                    _, _, _, _, new_c, new_h = _step(z[t] + h @ u, c)
                    on = (start + t < size)[:, None]
                    c, h = np.where(on, new_c, c), np.where(on, new_h, h)
                    logits[start + t] += h @ v
        for j, k in enumerate(group):
            out[k] = logits[: size[j], j]
    return out


def train(pages: DataFrame, rows: int = 400, id_col: str = "page_id", html_col: str = "html") -> list[np.ndarray]:
    """Weights learnt from about ``rows`` pages (at most twice as many), drawn by a hash of id and page; all pages if there are not more."""
    total = pages.count()
    drawn = pages.where(F.col(html_col).isNotNull()).select(F.xxhash64(id_col, html_col).alias("h"), F.col(html_col).alias("html"))
    if total > rows:
        drawn = drawn.where(F.pmod("h", F.lit(1 << 30)) < int(rows / total * (1 << 30)) + 1)
    drawn = drawn.limit(2 * rows).repartition(1)

    def run(batches):
        got = [t for _, t in sorted((h, t) for b in batches for h, t in zip(*(b.column(c).to_pylist() for c in ("h", "html")), strict=True))]
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes() for w in fit(got)], pa.binary())], ["w"])

    found = [np.frombuffer(r["w"], np.float32) for r in drawn.mapInArrow(run, "w binary").collect()]
    shapes = [w.shape for w in _start()]
    return [w.reshape(s) for w, s in zip(found, shapes, strict=True)] if found else [np.zeros(s, np.float32) for s in shapes]


def labelled(pages: DataFrame, weights: list[np.ndarray], html_col: str = "html") -> DataFrame:
    """All columns of ``pages`` and ``blocks``: every block in page order with its path, text and margin (0 or more: main text)."""
    return _applied(pages, weights, html_col, True)


def extracted(pages: DataFrame, weights: list[np.ndarray], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text (blocks of the main text in page order, joined by a line feed; empty if none) and n_chars.

    A null or empty page gives an empty text. Rows that repeat an id are separate pages. Other columns are ignored.
    """
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return _applied(slim, weights, "html", False).select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))


def _applied(pages: DataFrame, weights: list[np.ndarray], html_col: str, whole: bool) -> DataFrame:
    shared = pages.sparkSession.sparkContext.broadcast(weights)  # some 70 kB, of fixed size
    at = pages.columns.index(html_col)
    kind = pa.list_(pa.struct([("path", pa.string()), ("text", pa.string()), ("margin", pa.float32())]))

    def run(batches):
        for b in batches:
            for start in range(0, len(b), 128):
                some = b.slice(start, 128)
                read = [blocks(t or "") for t in some.column(at).to_pylist()]
                got = margins(shared.value, read)
                if whole:
                    made = [[{"path": "/".join("".join(s) for s in p.steps()), "text": t, "margin": float(m)} for (p, t, _), m in zip(bs, ms, strict=True)] for bs, ms in zip(read, got, strict=True)]
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(made, kind)], [*some.schema.names, "blocks"])
                else:
                    texts = ["\n".join(t for (_, t, _), m in zip(bs, ms, strict=True) if m >= 0) for bs, ms in zip(read, got, strict=True)]
                    yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    if whole:
        return pages.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in kinds.items()) + ", blocks array<struct<path string, text string, margin float>>")
    return pages.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
