"""Main text of web pages by a recurrent block labeller (operator 10).

A page is a sequence of blocks. Each has a vector of its tag path (hashed elements, their classes and ids) and one of
its words (hashed), and some lengths. A bidirectional LSTM in numpy reads the whole sequence in both directions and
says of every block whether it belongs to the article, so each decision sees the whole document.

It is trained here, on the driver, once a session: on TRAINING_PAGES pages that a seeded generator writes, with
menus, headers, footers, sidebars, notices, adverts, forms and comments in many shapes around articles. Nothing of
the corpus is looked at. Weights have a fixed size and go to executors with the task.

Defined results: null or empty html gives empty text; so does a page whose every block is something else; equal pages
give equal texts; a table without rows gives none; other columns are not read; no length is capped.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import Block, Element, blocks

BUCKETS, PATH, WORD, NUMBERS, HIDDEN = 2048, 24, 8, 6, 24
TRAINING_PAGES, EPOCHS, SEED = 900, 6, 11
#: Blocks that are labelled at a time, padding included.
BATCH_BLOCKS = 16384

_KEPT: dict[str, "Labeller"] = {}


def _bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % BUCKETS


class _Buckets(dict):
    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        b = self[token] = _bucket(token)
        return b


class _Path:
    """What is known of a path of elements: a number, the buckets of all its classes and ids, its last tags, its depth (to 12), and the buckets of all tokens."""

    __slots__ = ("buckets", "classes", "depth", "no", "tags")

    def __init__(self, no: int, classes: frozenset[int], tags: tuple[str, ...], depth: int):
        self.no, self.classes, self.tags, self.depth, self.buckets = no, classes, tags, depth, None


class Features:
    """Hashed tokens of blocks. Paths are kept in a tree by what stands under what, as pages repeat them; what is handed
    down is a set of buckets, of which there are BUCKETS."""

    def __init__(self) -> None:
        self.words = _Buckets()
        self.paths: dict[tuple, _Path] = {}
        self.made = 0

    def _below(self, above: _Path | None, e: Element) -> _Path:
        key = (above.no if above else 0, e.tag, e.names)
        if (found := self.paths.get(key)) is None:
            classes = above.classes if above else frozenset()
            own = [self.words[f"c {n}"] for n in e.names]
            if any(x not in classes for x in own):
                classes = classes.union(own)
            if len(self.paths) > 50_000:
                self.paths.clear()
            self.made += 1
            found = self.paths[key] = _Path(self.made, classes, ((above.tags if above else ()) + (e.tag,))[-8:], min(above.depth + 1 if above else 1, 12))
        return found

    def path(self, element: Element | None) -> list[int]:
        if element is None:
            return []
        new, e = [], element
        while e is not None and e.known is None:
            new.append(e)
            e = e.parent
        known = e.known if e is not None else None
        for e in reversed(new):
            known = e.known = self._below(known, e)
        if known.buckets is None:
            tokens = [f"l {known.tags[-1]}", f"d {known.depth}", *(f"t {t}" for t in known.tags)]
            known.buckets = sorted(known.classes.union(map(self.words.__getitem__, tokens)))
        return known.buckets

    def __call__(self, block: Block) -> tuple[list[int], list[int], list[float]]:
        words = list(map(self.words.__getitem__, block.text.lower().split()))
        n = len(words)
        marks = sum(map(block.text.count, ".,;:!?"))
        numbers = [min(n, 100) / 50, np.log1p(n) / 4, block.links / max(len(block.text), 1), min(marks / max(n, 1), 1), float(block.text[-1] in ".!?"), 1.0]
        return self.path(block.path), words, numbers


def _mean_rows(table: np.ndarray, lists: list[list[int]]) -> np.ndarray:
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    flat = np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=int(sizes.sum()))
    out = np.zeros((len(lists), table.shape[1]), table.dtype)
    some = np.flatnonzero(sizes)  # text outside of any element has no path
    if len(some):
        starts = (np.cumsum(sizes) - sizes)[some]
        out[some] = np.add.reduceat(table[flat], starts, axis=0) / np.sqrt(sizes[some])[:, None].astype(table.dtype)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


class Labeller:
    """Weights, inference and training of the block labeller."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        size = PATH + WORD + NUMBERS
        w = lambda *s: (r.standard_normal(s) * 0.15).astype(np.float32)
        self.w = {"path": w(BUCKETS, PATH), "word": w(BUCKETS, WORD)}
        for side in "fb":
            self.w |= {f"x{side}": w(size, 4 * HIDDEN), f"h{side}": w(HIDDEN, 4 * HIDDEN), f"c{side}": np.zeros(4 * HIDDEN, np.float32), f"o{side}": w(HIDDEN)}
            self.w[f"c{side}"][HIDDEN : 2 * HIDDEN] = 1  # gates remember at first
        self.w |= {"ox": w(size), "oc": np.zeros(1, np.float32)}

    def inputs(self, found: list[tuple]) -> np.ndarray:
        return np.concatenate([_mean_rows(self.w["path"], [f[0] for f in found]), _mean_rows(self.w["word"], [f[1] for f in found]), np.array([f[2] for f in found], dtype=np.float32)], axis=1)

    def _run(self, side: str, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """One direction over (time, pages, inputs); ``mask`` is 0 where a page has ended."""
        steps, pages, _ = x.shape
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        made, kept = np.zeros((steps, pages, HIDDEN), np.float32), []
        ahead = x @ self.w[f"x{side}"] + self.w[f"c{side}"]
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = ahead[t] + h @ self.w[f"h{side}"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            tan = np.tanh(new)
            if keep:
                kept.append((t, h, c, i, f, o, g, tan, m))
            h, c = h + m * (o * tan - h), c + m * (new - c)
            made[t] = h
        return made, kept

    def scores(self, pages: list[list[tuple]]) -> list[np.ndarray]:
        """For each page (features of its blocks) how likely each block is of the article. Pages of like length go together."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        while order:
            longest = len(pages[order[-1]])
            some = order[-max(1, BATCH_BLOCKS // longest) :]
            del order[-len(some) :]
            x, mask = self._padded([pages[k] for k in some])
            logit = x @ self.w["ox"] + self.w["oc"]
            for side in "fb":
                logit += self._run(side, x, mask, False)[0] @ self.w[f"o{side}"]
            for j, k in enumerate(some):
                out[k] = _sigmoid(logit[: len(pages[k]), j])
        return out

    def _padded(self, pages: list[list[tuple]]) -> tuple[np.ndarray, np.ndarray]:
        steps = max(map(len, pages))
        flat = self.inputs([f for p in pages for f in p])
        x, mask, at = np.zeros((steps, len(pages), flat.shape[1]), np.float32), np.zeros((steps, len(pages)), np.float32), 0
        for j, p in enumerate(pages):
            x[: len(p), j], mask[: len(p), j] = flat[at : at + len(p)], 1
            at += len(p)
        return x, mask

    def gradients(self, pages: list[list[tuple]], wanted: list[list[int]], blind: np.ndarray) -> dict[str, np.ndarray]:
        """``blind``: 0 for pages whose word vectors are left out, so that words alone decide little."""
        x, mask = self._padded(pages)
        x[:, :, PATH : PATH + WORD] *= blind[None, :, None]
        y = np.zeros(mask.shape, np.float32)
        for j, labels in enumerate(wanted):
            y[: len(labels), j] = labels
        runs = {side: self._run(side, x, mask, True) for side in "fb"}
        logit = x @ self.w["ox"] + self.w["oc"] + sum(runs[s][0] @ self.w[f"o{s}"] for s in "fb")
        d = (_sigmoid(logit) - y) * mask / mask.sum()
        grad = {"ox": np.einsum("tp,tpi->i", d, x), "oc": d.sum(keepdims=True).reshape(1)}
        dx = d[:, :, None] * self.w["ox"]
        for side in "fb":
            made, kept = runs[side]
            grad[f"o{side}"] = np.einsum("tp,tph->h", d, made)
            dz_all = np.zeros((*d.shape, 4 * HIDDEN), np.float32)
            dh, dc = np.zeros((d.shape[1], HIDDEN), np.float32), np.zeros((d.shape[1], HIDDEN), np.float32)
            gh = np.zeros_like(self.w[f"h{side}"])
            for t, h, c, i, f, o, g, tan, m in reversed(kept):
                dh = dh + d[t][:, None] * self.w[f"o{side}"]
                live, dnew = m * dh, m * dc
                do, dnew = live * tan, dnew + live * o * (1 - tan * tan)
                dz = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), do * o * (1 - o), dnew * i * (1 - g * g)], axis=1)
                dz_all[t] = dz
                gh += h.T @ dz
                dh, dc = (1 - m) * dh + dz @ self.w[f"h{side}"].T, (1 - m) * dc + dnew * f
            grad[f"h{side}"], grad[f"c{side}"] = gh, dz_all.sum(axis=(0, 1))
            grad[f"x{side}"] = np.einsum("tpi,tpz->iz", x, dz_all)
            dx += dz_all @ self.w[f"x{side}"].T
        dx[:, :, PATH : PATH + WORD] *= blind[None, :, None]
        path, word = np.zeros_like(self.w["path"]), np.zeros_like(self.w["word"])
        for j, p in enumerate(pages):
            for t, (a, b, _) in enumerate(p):
                np.add.at(path, a, dx[t, j, :PATH] / np.float32(max(len(a), 1) ** 0.5))
                np.add.at(word, b, dx[t, j, PATH : PATH + WORD] / np.float32(max(len(b), 1) ** 0.5))
        return grad | {"path": path, "word": word}

    def train(self, pages: list[list[tuple]], wanted: list[list[int]], epochs: int, rate: float = 0.01) -> None:
        r, order = random.Random(SEED), list(range(len(pages)))
        first, second, n = {k: np.zeros_like(v) for k, v in self.w.items()}, {k: np.zeros_like(v) for k, v in self.w.items()}, 0
        for _ in range(epochs):
            r.shuffle(order)
            for at in range(0, len(order), 16):
                some, n = order[at : at + 16], n + 1
                for k, g in self.gradients([pages[i] for i in some], [wanted[i] for i in some], np.array([r.random() < 0.5 for _ in some], np.float32)).items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.w[k] -= (rate * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.999**n)) + 1e-8)).astype(np.float32)


class _Writer:
    """Pages with labelled blocks for training; ``data-y`` of the nearest element that has it is the label."""

    ASIDE = ("nav menu navbar breadcrumb breadcrumbs topnav pagination pager tabs", "header masthead topbar banner branding site-header", "footer bottom copyright site-footer colophon",
             "sidebar aside related widget trending popular recommended rail", "cookie notice consent gdpr alert message popup modal newsletter-notice", "ad ads advert advertisement sponsored promo banner-ad sponsor",
             "form search login newsletter signup subscribe contact", "comments comment reply discussion responses respond disqus", "share social toolbar meta tags byline-links author-box")
    TAGS = ("nav div ul", "header div", "footer div", "aside div section", "div section aside dialog", "div aside section ins", "form div section", "section div ol", "div ul")
    SAID = ("home about contact news archive products help", "welcome to the site search log in", "copyright all rights reserved privacy terms of use imprint", "related popular more stories read next also see",
            "we use cookies accept consent this site settings reject", "advertisement buy now sponsored offer sale click here", "name email password submit subscribe your send", "reply says comments posted by likes report wrote ago", "share tweet print email tags")

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def prose(self, least: int, most: int) -> str:
        r = self.r
        n, out = r.randint(least, most), []
        kinds = r.choice(("bcdfglmnprst", "abcdefghijklmnopqrstuvwxyz", "éèàçôbclmnrst", "äöüßbcdhknst", "ñáíóbclmnrs"))
        for k in range(n):
            w = "".join(r.choice(kinds) + r.choice("aeiou") * r.randint(0, 1) for _ in range(r.randint(1, 4)))
            out.append((w.capitalize() if k % 12 == 0 else w) + (r.choice((",", ".", ".")) if k % 12 == 11 else ""))
        return " ".join(out) + r.choice((".", ".", "", "!"))

    def list_of(self, tag: str, item) -> str:
        return f"<{tag}>" + "".join(f"<li>{item()}</li>" for _ in range(self.r.randint(1, 8))) + f"</{tag}>"

    def boilerplate(self, kind: int | None = None) -> str:
        r = self.r
        kind = r.randrange(len(self.ASIDE)) if kind is None else kind
        tag = r.choice(self.TAGS[kind].split())
        name = r.choice(self.ASIDE[kind].split())
        attribute = "" if tag in ("nav", "header", "footer", "aside", "form") and r.random() < 0.5 else r.choice((f' class="{name}"', f' id="{name}"', f' class="{name} {r.choice(("box", "wrap", "block", "x1"))}"', f' class="site-{name}"'))
        said = lambda: " ".join(r.sample(self.SAID[kind].split(), r.randint(1, 4))) if r.random() < 0.4 else self.prose(1, 3)
        link = lambda: f'<a href="/{r.randint(1, 99)}">{said() if r.random() < 0.5 else self.prose(1, 4)}</a>'
        body = []
        for _ in range(r.randint(1, 3)):
            body.append(r.choice((
                lambda: self.list_of("ul", link), lambda: f"<p>{self.prose(3, 40)}</p>", lambda: f"<div>{said()} {self.prose(2, 20)}</div>", lambda: f"<h3>{said()}</h3>", lambda: self.prose(2, 25), lambda: link() + " " + link(),
                lambda: f"<p>{said()}</p>", lambda: f"<label>{said()}</label><input name=q><button>{said()}</button>" if kind == 6 else f"<span>{said()}</span>",
                lambda: "".join(f'<div class="comment"><b>{self.prose(1, 2)}</b><p>{self.prose(5, 60)}</p></div>' for _ in range(r.randint(1, 4))) if kind == 7 else self.prose(1, 12),
            ))())
        if tag in ("ul", "ol"):
            body = [f"<li>{link()}</li>" for _ in range(r.randint(2, 8))]
        return f'<{tag}{attribute} data-y="0">' + "".join(body) + f"</{tag}>"

    def article(self) -> str:
        r = self.r
        title = self.prose(3, 14)
        body = [f"<h1>{title}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.choice((1, 2, 4, 8, 16))):
            kind = r.random()
            if kind < 0.06:
                body.append(f"<p>{' '.join(r.sample(r.choice(self.SAID).split(), 4)).capitalize()}.</p>")
            elif kind < 0.09:
                body.append(f"<p>{' '.join([self.prose(1, 1).strip('.!')] * r.randint(3, 60) + [self.prose(1, 1)] * r.randint(1, 20))}</p>")
            elif kind < 0.14:
                body.append(f"<p>{self.prose(2, 60).upper().replace(' ', r.choice((' ', '!! ', ' | ', '*** ', ' %%% ')))}</p>")
            elif kind < 0.16:
                body.append(f"<p><b>{' '.join([self.prose(1, 1).strip('.!')] * r.randint(3, 60))}<br>")
            elif kind < 0.6:
                body.append(f"<p>{self.prose(2, r.choice((12, 60, 200)))}" + ("</p>" if r.random() < 0.8 else ""))
            elif kind < 0.68:
                body.append(f"<p><b>{self.prose(4, 30)}<br>")
            elif kind < 0.76:
                body.append(f"<{(h := r.choice(('h2', 'h3', 'h4')))}>{self.prose(2, 8)}</{h}>")
            elif kind < 0.84:
                body.append(self.list_of(r.choice(("ul", "ol")), lambda: self.prose(2, 25)))
            elif kind < 0.88:
                body.append(f"<blockquote>{self.prose(5, 40)}</blockquote>")
            elif kind < 0.92:
                body.append(f"<table><tr><td>{self.prose(1, 5)}</td><td>{self.prose(1, 5)}</td></tr></table>")
            elif kind < 0.96:
                body.append(f"<p>{self.prose(5, 30)} <a href='#'>{self.prose(1, 4)}</a> {self.prose(3, 30)}</p>")
            elif r.random() < 0.6:
                body.append(self.boilerplate(r.choice((5, 5, 3, 6, 8))))
            else:
                body.append(f"<figure><img src=x><figcaption>{self.prose(3, 15)}</figcaption></figure>")
        tag = r.choice(("article", "article", "article", "main", "div", "section"))
        name = r.choice(("content", "post", "entry", "article-body", "story", "main", "text", "post-content")) if tag in ("div", "section") or r.random() < 0.3 else ""
        return f'<{tag}{f" class={chr(34)}{name}{chr(34)}" if name else ""} data-y="1">' + "".join(body) + f"</{tag}>"

    def page(self) -> str:
        r = self.r
        above = [self.boilerplate(k) for k in (1, 0, 4, 5, 3) if r.random() < 0.5]
        below = [self.boilerplate(k) for k in (8, 7, 3, 6, 5, 4, 2) if r.random() < 0.45]
        r.shuffle(above)
        middle = self.article()
        if r.random() < 0.5:
            middle = f"<{(t := r.choice(('div', 'main', 'section')))} class=\"{r.choice(('container', 'wrap', 'page', 'layout', 'row'))}\">{middle}" + (self.boilerplate(3) if r.random() < 0.4 else "") + f"</{t}>"
        return "<html><body>" + "".join(above) + middle + "".join(below) + "</body></html>"


def _label(block: Block) -> int:
    return int((block.path and block.path.mark) or "0")


def labelled_pages(n: int, seed: int) -> tuple[list[list[tuple]], list[list[int]]]:
    writer, features = _Writer(seed), Features()
    found = [f for f in (blocks(writer.page(), "data-y") for _ in range(n)) if f]
    return [[features(b) for b in f] for f in found], [[_label(b) for b in f] for f in found]


def labeller() -> Labeller:
    """The trained labeller; trained at the first call in a process, the same each time."""
    if "model" not in _KEPT:
        model = Labeller()
        model.train(*labelled_pages(TRAINING_PAGES, SEED), EPOCHS)
        _KEPT["model"] = model
    return _KEPT["model"]


def main_texts(pages: list[str | None], model: Labeller, features: Features) -> list[str]:
    found = [blocks(p) if p else [] for p in pages]
    scored = model.scores([[features(b) for b in f] for f in found])
    return ["\n".join(b.text for b, s in zip(f, score) if s > 0.5) for f, score in zip(found, scored)]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and the main text of every row of ``pages``."""
    model = labeller()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            html = batch.column(2)
            for at in range(0, len(html), 1024):
                texts = main_texts(html.slice(at, 1024).to_pylist(), model, features)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1024), batch.column(1).slice(at, 1024), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")


def op10(pages: DataFrame) -> DataFrame:
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
