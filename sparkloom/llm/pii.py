"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The tagger is trained in numpy from labelled spans: made-up sentences with made-up addresses and numbers in
many notations, and numbers that are none (years, prices, versions, hex). Seeds are fixed, so every process
has the same weights; a process trains once.

A text is cut into cores of STRIDE characters; a core's window has CONTEXT characters more at each side, so windows
overlap by half. Each window is decoded by Viterbi, and all windows of a text are then reconciled: every character
takes its tag from the window in whose core it stands, and spans are read off the tags of the whole text, over any
number of windows. Every entity of the tagger holds a digit or an at sign, so only cores with one of these, and
those beside them, are decoded. A span is added if the mean probability of its tags by
forward and backward sums is LEAST_CHANCE or more, if what it says can be of its kind (check digits, parts of an address, count of digits; no notation is asked
for), and if it keeps clear of base spans.

Base patterns are matched in time linear in the text, whatever it holds: runs of characters are read once.

Defined cases: a null text is empty; a text is cut into windows 512 at a time, so one of any length takes some
40 bytes of memory a character; base spans of several kinds may overlap, and all stay; an added span is of the
first kind that its tags name; a null doc_id is carried as it is; repeated documents give repeated rows; an empty
table gives an empty result; columns that are not asked for are not read; positions are code points of the whole text.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import vectext as V
from .base import spread, table

KINDS = ("email", "ip", "card", "phone")
#: The base patterns.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
STRIDE, CONTEXT = 48, 24
WIDTH = STRIDE + 2 * CONTEXT
#: Mean probability of an added span's tags.
LEAST_CHANCE = 0.75
EMBED, HIDDEN = 12, 14
TAGS = 1 + 2 * len(KINDS)
ANCHOR = re.compile(r"[0-9@]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def passes(kind: str, s: str) -> bool:
    """The check of a base match."""
    if kind == "ip":
        return all(_at_most_255(p) for p in s.split("."))
    d = _digits(s)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(d) <= 15
    return True


def _at_most_255(part: str) -> bool:
    part = part.lstrip("0") or "0"
    return len(part) <= 3 and int(part) <= 255


_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Four or more dotted numbers, from where the first begins.
_DOTTED = re.compile(r"(?<![0-9])(?<![0-9]\.)[0-9]++(?:\.[0-9]++){3,}+")
_NUMBER = re.compile(r"[0-9]+")


def _emails(text: str):
    """The email pattern's matches. An at sign's local part is all of _LOCAL before it, back to the match before;
    no at sign is in it, so each stretch between two of them is read once."""
    end, after = 0, 0
    for m in _DOMAIN.finditer(text):
        after = max(after, text.rfind("@", end, m.start()) + 1, end)
        local = text[after : m.start()]
        n = len(local) - len(local.rstrip(_LOCAL))
        if n:
            end = m.end()
            yield m.start() - n, end


def _addresses(text: str):
    """The ip pattern's matches: dotted numbers four by four."""
    for m in _DOTTED.finditer(text):
        parts = [x.span() for x in _NUMBER.finditer(text, m.start(), m.end())]
        for i in range(0, len(parts) - 3, 4):
            yield parts[i][0], parts[i + 3][1]


def matches(kind: str, text: str):
    """Leftmost non-overlapping matches of a kind's pattern, in linear time: the card pattern takes all of what it can
    begin with, a phone number is read from its plus sign, and for the others see above."""
    if kind == "email":
        return _emails(text)
    if kind == "ip":
        return _addresses(text)
    return (m.span() for m in PATTERNS[kind].finditer(text))


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that pass, by kind and start."""
    out = []
    if ANCHOR.search(text):
        for kind in KINDS:
            if kind == "email" and "@" not in text or kind == "phone" and "+" not in text:
                continue
            out += [(kind, a, b) for a, b in matches(kind, text) if passes(kind, text[a:b])]
    return out


def possible(kind: str, s: str) -> bool:
    """Whether a span that the tagger found can be of its kind, in whatever notation."""
    d = _digits(s)
    if kind == "email":
        name, _, host = s.partition("@")
        return bool(re.search(r"\w", name) and re.search(r"\w", host))
    if kind == "ip":
        parts = _NUMBER.findall(s)
        return len(parts) == 4 and all(_at_most_255(p) for p in parts)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15


# --- characters -----------------------------------------------------------------------------------------------

_SIGNS = "@.+-()_%:/,;#=\"'<>[]{}|!?*&$\n"
_ASCII = np.ones(128, np.int64)  # 1: other signs
_ASCII[[9, 11, 12, 13, 32]] = 2
_ASCII[48:58] = 3
_ASCII[65:91] = 4
_ASCII[97:123] = 5
for _i, _c in enumerate(_SIGNS):
    _ASCII[ord(_c)] = 7 + _i
CLASSES = 7 + len(_SIGNS)  # 0: beyond the text, 6: above ASCII


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _ASCII[np.minimum(points, 127)], 6)


# --- labelled spans --------------------------------------------------------------------------------------------


def _made_up(rng: np.random.Generator, width: int) -> tuple[str, list[Span]]:
    pick = lambda xs: xs[int(rng.random() * len(xs))]
    num = lambda n: "".join(map(str, rng.integers(0, 10, n).tolist()))
    syllables = ("an", "re", "the", "ti", "on", "ed", "éa", "ou", "ü", "ñ", "ing", "or", "mi", "la", "que", "sch", "er", "ö")

    def word() -> str:
        w = "".join(pick(syllables) for _ in range(int(rng.integers(1, 4))))
        return w.capitalize() if rng.random() < 0.15 else w

    def ascii_word() -> str:
        return "".join(pick(("an", "re", "the", "ti", "on", "ed", "mi", "la", "sa")) for _ in range(int(rng.integers(1, 4))))

    def card() -> str:
        n = pick((13, 14, 15, 16, 16, 16, 16, 19))
        d = num(n - 1)
        d += next(str(c) for c in range(10) if luhn(d + str(c)))
        sep = pick(("", " ", "-", ".", "  ", "/", ". "))
        cuts = (4, 10, n) if n in (14, 15) else (4, 8, 12, 16, 19)
        return sep.join(d[i:j] for i, j in zip((0, *cuts), cuts) if i < n)

    def phone() -> str:
        lead = pick(("+" + num(1), "+" + num(2), "00" + num(2), "00 " + num(2), "0" + num(2), "0" + num(3), "0" + num(4), "(" + num(3) + ")", "(0" + num(3) + ")", "1", num(3)))
        left = int(rng.integers(9, 12)) - sum(c.isdigit() for c in lead)
        sep, first = pick((" ", " ", "-", ".", "")), pick((" ", " ", "-", "/", ""))
        parts = []
        while left > 0:
            k = min(left, int(rng.integers(2, 5)))
            k = left if left - k == 1 else k
            parts.append(num(k))
            left -= k
        out = lead + (first or sep or " ") + sep.join(parts)
        return out if sep or not lead.isdigit() or first in " /-" and first else lead + "/" + "".join(parts)

    def entity(kind: str) -> str:
        if kind == "email":
            w = lambda: word().lower() if rng.random() < 0.4 else ascii_word()
            name = pick((w() + pick((".", "_", "", "-")) + num(int(rng.integers(0, 3))), w(), w() + "." + w(), ascii_word()[0] + "." + w())).strip("._-") or "a"
            host = pick((w() + num(int(rng.integers(0, 2))), w() + "-" + w(), w() + "." + w()))
            return name + pick(("@", "@", "@", "@", " @ ")) + host + pick((".com", ".example.com", ".org", ".example.fr", ".de", ""))
        if kind == "ip":
            top = pick((256, 256, 100, 20))
            return pick((".", ".", ".", ",", ":", ". ", " . ", "-")).join(str(int(x)) for x in rng.integers(0, top, 4))
        return card() if kind == "card" else phone()

    def other() -> str:
        day, month, year = f"{int(rng.integers(1, 32))}", f"{int(rng.integers(1, 13))}", pick(("19", "20", "18", "17")) + num(2)
        two = lambda x: x.rjust(2, "0")
        return pick((
            lambda: num(4), lambda: num(2) + "." + num(2), lambda: "v" + num(1) + "." + num(1) + "." + num(1), lambda: num(1) + "," + num(3), lambda: f"20{num(2)}-0{num(1)}-1{num(1)}", lambda: "#" + num(3),
            lambda: 'token = "' + "".join(pick("0123456789abcdef") for _ in range(20)) + '"', lambda: num(3) + "%", lambda: "$" + num(2), lambda: num(12), lambda: "@" + ascii_word(), lambda: num(2) + ":" + num(2),
            lambda: num(1) + ")", lambda: num(9), lambda: f"{day}.{month}.{year}", lambda: f"{two(day)}/{two(month)}/{year}", lambda: f"{day}. {month}.", lambda: f"{month}-{day}-{year}", lambda: f"{year}-{year[:2]}{num(2)}",
            lambda: year, lambda: f"{year}, {year[:2]}{num(2)}", lambda: num(2) + ":" + num(2) + ":" + num(2), lambda: num(2) + "," + num(3) + "," + num(3), lambda: "$" + num(1) + "," + num(3) + "." + num(2),
            lambda: num(1) + "." + num(1) + "." + num(1), lambda: num(2) + "." + num(1) + "." + num(2), lambda: num(2) + "(" + num(1) + ")", lambda: word() + "(" + num(3) + ")", lambda: "@" + ascii_word() + "_" + num(2),
            lambda: "@" + word().lower(), lambda: num(1) + "-" + num(1), lambda: num(3) + "-" + num(3), lambda: num(2) + "x" + num(2), lambda: num(1) + "e-" + num(1),
            lambda: "97" + num(1) + "-" + num(1) + "-" + num(3) + "-" + num(5) + "-" + num(1), lambda: ascii_word() + "-" + num(3) + "-" + num(4), lambda: ", ".join(num(int(rng.integers(1, 4))) for _ in range(6)),
            lambda: " ".join(num(int(rng.integers(1, 3))) for _ in range(5)), lambda: num(2) + " km/" + word(), lambda: num(8), lambda: num(3) + "." + num(4) + ", " + num(2) + "." + num(4),
            lambda: "".join(pick("0123456789abcdef") for _ in range(32)), lambda: f"[{num(2)}]", lambda: num(2) + word(), lambda: word() + num(2), lambda: num(1) + " " + word() + " " + num(2),
        ))()

    text, spans = "", []
    while len(text) < width + 12:
        r = rng.random()
        if r < 0.09:
            kind = pick(KINDS)
            e = entity(kind)
            if rng.random() < 0.1 and kind == "card":  # two numbers side by side
                spans.append((kind, len(text), len(text) + len(e)))
                text += e + " "
                e = entity(kind)
            spans.append((kind, len(text), len(text) + len(e)))
            text += e
        elif r < 0.22:
            text += other()
        else:
            text += word()
        text += pick((" ", " ", " ", " ", " ", ". ", ", ", "\n", "### "))
    cut = int(rng.integers(0, 12))
    return text[cut : cut + width], [(k, max(a - cut, 0), min(b - cut, width)) for k, a, b in spans if b - cut > 0 and a - cut < width]


def labelled(n: int, seed: int, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Classes and tags (0 outside, 2k+1 begin, 2k+2 inside) of n made-up windows."""
    rng = np.random.default_rng(seed)
    x, y = np.zeros((n, width), np.int64), np.zeros((n, width), np.int64)
    for i in range(n):
        text, spans = _made_up(rng, width)
        x[i, : len(text)] = classes(text)
        for kind, a, b in spans:
            k = KINDS.index(kind)
            y[i, a:b] = 2 * k + 2
            y[i, a] = 2 * k + 1  # of what is cut off at the window's start too: a window can't begin inside
    return x, y


# --- the network -----------------------------------------------------------------------------------------------


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def _lstm(x: np.ndarray, p: dict, keep: list | None = None) -> np.ndarray:
    """Hidden states (time, batch, 2 HIDDEN) of both directions over x (time, batch, EMBED). The directions step side
    by side: the backward one reads x from its end."""
    steps, n, _ = x.shape
    pre = np.stack((x, x[::-1]), 1) @ p["W"] + p["b"]  # time, direction, batch, gates
    h = c = np.zeros((2, n, HIDDEN), x.dtype)
    out = np.empty((steps, 2, n, HIDDEN), x.dtype)
    for t in range(steps):
        a = pre[t] + h @ p["U"]
        s = _sigmoid(a[..., : 3 * HIDDEN])
        i, f, o = s[..., :HIDDEN], s[..., HIDDEN : 2 * HIDDEN], s[..., 2 * HIDDEN :]
        g = np.tanh(a[..., 3 * HIDDEN :])
        new = f * c + i * g
        tc = np.tanh(new)
        if keep is not None:
            keep.append((h, c, i, f, o, g, tc))
        c, h = new, o * tc
        out[t] = h
    return np.concatenate((out[:, 0], out[::-1, 1]), axis=2)


def _lstm_back(x: np.ndarray, p: dict, keep: list, up: np.ndarray, grads: dict) -> np.ndarray:
    steps, n, _ = x.shape
    up = np.stack((up[:, :, :HIDDEN], up[::-1, :, HIDDEN:]), 1)
    dh = dc = np.zeros((2, n, HIDDEN), x.dtype)
    da = np.empty((steps, 2, n, 4 * HIDDEN), x.dtype)
    grads["U"] = np.zeros_like(p["U"])
    back = np.ascontiguousarray(p["U"].transpose(0, 2, 1))
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, tc = keep[t]
        dh = dh + up[t]
        dc = dc + dh * o * (1 - tc * tc)
        a = da[t]
        a[..., :HIDDEN] = dc * g * i * (1 - i)
        a[..., HIDDEN : 2 * HIDDEN] = dc * c * f * (1 - f)
        a[..., 2 * HIDDEN : 3 * HIDDEN] = dh * tc * o * (1 - o)
        a[..., 3 * HIDDEN :] = dc * i * (1 - g * g)
        grads["U"] += h.transpose(0, 2, 1) @ a
        dh, dc = a @ back, dc * f
    both = np.stack((x, x[::-1]))
    flat = [da[:, d].reshape(-1, 4 * HIDDEN) for d in (0, 1)]
    grads["W"] = np.stack([both[d].reshape(-1, EMBED).T @ flat[d] for d in (0, 1)])
    grads["b"] = np.stack([f.sum(axis=0)[None] for f in flat])
    dx = [da[:, d] @ p["W"][d].T for d in (0, 1)]
    return dx[0] + dx[1][::-1]


def emissions(ids: np.ndarray, p: dict) -> np.ndarray:
    """Tag scores (time, batch, TAGS) of windows of classes (batch, time)."""
    return _lstm(p["E"][ids.T], p) @ p["O"] + p["o"]


def _allowed() -> np.ndarray:
    """0 where a tag may follow another, a large negative number elsewhere: inside follows its own kind only."""
    out = np.zeros((TAGS, TAGS))
    for k in range(len(KINDS)):
        out[:, 2 * k + 2] = -1e4
        out[2 * k + 1, 2 * k + 2] = out[2 * k + 2, 2 * k + 2] = 0
    return out


def _sums(e: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, ...]:
    """Forward and backward sums over tags, scaled so that their product is each tag's probability; exp of the tag
    scores less their greatest; scales (time, batch); and the logarithm of all paths' sum (batch). A window can't begin inside."""
    step, top = np.exp(a.astype(np.float64)), e.max(axis=2, keepdims=True)
    x = np.exp((e - top).astype(np.float64))
    x[0, :, 2::2] = 0
    ahead, behind, scale = np.empty_like(x), np.ones_like(x), np.empty(x.shape[:2])
    for t in range(len(x)):
        s = ahead[t - 1] @ step * x[t] if t else x[0]
        scale[t] = s.sum(axis=1)
        ahead[t] = s / scale[t][:, None]
    for t in range(len(x) - 2, -1, -1):
        behind[t] = (behind[t + 1] * x[t + 1]) @ step.T / scale[t + 1][:, None]
    return ahead, behind, x, scale, np.log(scale).sum(axis=0) + top[:, :, 0].sum(axis=0)


def _step(ids: np.ndarray, tags: np.ndarray, p: dict) -> tuple[float, dict]:
    """Loss (negative log likelihood a window) and gradients."""
    n, steps = ids.shape
    x = p["E"][ids.T]
    keep: list = []
    h = _lstm(x, p, keep)
    e = h @ p["O"] + p["o"]
    a = p["A"] + _allowed()
    ahead, behind, x_e, scale, z = _sums(e, a)
    gold = tags.T
    score = np.take_along_axis(e, gold[:, :, None], 2).sum(axis=(0, 2)) + a[gold[:-1], gold[1:]].sum(axis=0)
    de = ahead * behind
    np.put_along_axis(de, gold[:, :, None], np.take_along_axis(de, gold[:, :, None], 2) - 1, 2)
    after = (x_e[1:] * behind[1:] / scale[1:, :, None]).reshape(-1, TAGS)
    da = ahead[:-1].reshape(-1, TAGS).T @ after * np.exp(a)
    np.subtract.at(da, (gold[:-1].ravel(), gold[1:].ravel()), 1)
    g = {"A": da, "O": h.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS), "o": de.sum(axis=(0, 1))}
    dx = _lstm_back(x, p, keep, de @ p["O"].T, g)
    ge = np.zeros_like(p["E"])
    np.add.at(ge, ids.T.ravel(), dx.reshape(-1, EMBED))
    g["E"] = ge
    return float((z - score).mean()), {k: v / n for k, v in g.items()}


@functools.lru_cache(maxsize=2)
def trained(steps: int = 400, batch: int = 96, seed: int = 11, width: int = STRIDE, top_rate: float = 0.06) -> dict:
    """The weights, by Adam over made-up windows."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    p = {"E": rng.normal(0, 0.5, (CLASSES, EMBED)), "O": draw(2 * HIDDEN, TAGS), "o": np.zeros(TAGS), "A": np.zeros((TAGS, TAGS))}
    p |= {"W": np.stack([draw(EMBED, 4 * HIDDEN) for _ in "fr"]), "U": np.stack([draw(HIDDEN, 4 * HIDDEN) for _ in "fr"]), "b": np.zeros((2, 1, 4 * HIDDEN))}
    p["b"][..., HIDDEN : 2 * HIDDEN] = 1
    p = {k: a.astype(np.float32) for k, a in p.items()}
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    x, y = labelled(5000, seed, width)
    for t in range(1, steps + 1):
        at = rng.integers(0, len(x), batch)
        _, g = _step(x[at], y[at], p)
        rate = top_rate * (1 - 0.9 * t / steps)
        for k in p:
            gk = np.clip(g[k], -5, 5).astype(np.float32)
            m[k] = 0.9 * m[k] + 0.1 * gk
            v[k] = 0.99 * v[k] + 0.01 * gk * gk
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return {k: a.astype(np.float32) for k, a in (p | {"A": p["A"] + _allowed()}).items()}


def viterbi(e: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Best tags (batch, time) for tag scores e (time, batch, tags) and transitions a."""
    steps, n, _ = e.shape
    best, back = e[0].copy(), np.empty(e.shape, np.int8)
    best[:, 2::2] = -1e4  # a window can't begin inside
    for t in range(1, steps):
        s = best[:, :, None] + a
        back[t] = s.argmax(axis=1)
        best = s.max(axis=1) + e[t]
    tags = np.empty((n, steps), np.int64)
    tags[:, -1] = best.argmax(axis=1)
    rows = np.arange(n)
    for t in range(steps - 1, 0, -1):
        tags[:, t - 1] = back[t][rows, tags[:, t]]
    return tags


def posteriors(e: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Probability of each tag at each place (time, batch, tags)."""
    ahead, behind, *_ = _sums(e, a)
    return ahead * behind


_ANCHORS = (3, 7 + _SIGNS.index("@"))


def tag_texts(texts: list[str], p: dict, batch: int = 512) -> list[list[tuple[str, int, int, float]]]:
    """For each text its spans (kind, start, end, mean probability of their tags), none of which overlap."""
    own = [classes(t) for t in texts]
    where = []
    for i, c in enumerate(own):
        near = np.unique(np.flatnonzero((c == _ANCHORS[0]) | (c == _ANCHORS[1])) // STRIDE)
        near = np.unique(np.concatenate((near - 1, near, near + 1)))
        where += [(i, k) for k in near[(near >= 0) & (near * STRIDE < len(c))].tolist()]
    tags = [np.zeros(len(c), np.int8) for c in own]
    sure = [np.zeros(len(c), np.float32) for c in own]
    for j in range(0, len(where), batch):
        part = where[j : j + batch]
        rows = np.zeros((len(part), WIDTH), np.int64)
        for r, (i, k) in enumerate(part):
            lo = k * STRIDE - CONTEXT
            seen = own[i][max(lo, 0) : lo + WIDTH]
            rows[r, max(-lo, 0) : max(-lo, 0) + len(seen)] = seen
        e, core = emissions(rows, p), slice(CONTEXT, CONTEXT + STRIDE)
        got = viterbi(e, p["A"])
        hit = np.flatnonzero(got[:, core].any(axis=1))
        if not len(hit):
            continue
        chance = np.take_along_axis(posteriors(e[:, hit], p["A"]), got[hit].T[:, :, None], 2)[:, :, 0].T
        for r, c in zip(hit.tolist(), chance):
            i, k = part[r]
            at = slice(k * STRIDE, min((k + 1) * STRIDE, len(own[i])))
            n = at.stop - at.start
            tags[i][at], sure[i][at] = got[r, core][:n], c[core][:n]
    out = []
    for t, m in zip(tags, sure):
        kind = (t + 1) // 2  # 0: outside
        first = (kind > 0) & ((t % 2 == 1) | (np.concatenate(([0], kind[:-1])) != kind))
        last = (kind > 0) & np.append(first[1:] | (kind[1:] == 0), True)
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        total = np.concatenate(([0.0], np.cumsum(m, dtype=np.float64)))
        out.append([(KINDS[kind[x] - 1], x, y, s) for x, y, s in zip(a.tolist(), b.tolist(), ((total[b] - total[a]) / np.maximum(b - a, 1)).tolist())])
    return out


def reconcile(text: str, base: list[Span], found: list[tuple[str, int, int, float]]) -> list[Span]:
    """Base spans and the added ones that keep clear of them, by kind and start."""
    if not found:
        return base
    taken = sorted((a, b) for _, a, b in base)
    starts, ends = [a for a, _ in taken], list(itertools.accumulate((b for _, b in taken), max))
    more = []
    for k, a, b, chance in found:
        before = bisect.bisect_left(starts, b)  # base spans that begin before this one ends
        if (not before or ends[before - 1] <= a) and chance >= LEAST_CHANCE and possible(k, text[a:b]):
            more.append((k, a, b))
    return sorted([*base, *more], key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by the first one's kind in brackets."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda x: (x[1], x[2])):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


FOUND = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"]


def find_pii(docs: DataFrame, carry: list[str] = (), redact: bool = False) -> DataFrame:
    """Counts, digest and spans for every row; with redact also redacted_text. carry names columns to keep."""
    weights = docs.sparkSession.sparkContext.broadcast(trained())
    own = list(dict.fromkeys(["doc_id", *carry]))
    schema = T.StructType([docs.schema[c] for c in own])
    for name in FOUND:
        schema = schema.add(name, T.StringType() if name in ("base_sha256", "spans") else T.LongType())
    if redact:
        schema = schema.add("redacted_text", T.StringType())

    def run(batches):
        p = weights.value
        for whole in batches:
            for lo, hi, _, _ in V.chunks(whole.column("text"), 4 << 20):
                batch = whole.slice(lo, hi - lo)
                texts = batch.column("text").to_pylist()
                full = [t or "" for t in texts]
                some = [i for i, t in enumerate(full) if ANCHOR.search(t)]
                tagged = dict(zip(some, tag_texts([full[i] for i in some], p)))
                cols: dict[str, list] = {n: [] for n in FOUND}
                clean = []
                for i, t in enumerate(full):
                    base = base_spans(t) if i in tagged else []
                    spans = reconcile(t, base, tagged[i]) if i in tagged else []
                    for k in KINDS:
                        cols["n_" + k].append(sum(s[0] == k for s in base))
                    cols["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
                    cols["spans"].append(written(spans))
                    cols["n_spans"].append(len(spans))
                    if redact:
                        clean.append(redacted(t, spans) if spans else texts[i])
                arrays = [*(batch.column(c) for c in own), *(pa.array(cols[n], pa.string() if n in ("base_sha256", "spans") else pa.int64()) for n in FOUND)]
                yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(clean, pa.string())] if redact else [])], schema.names)

    return docs.select(*dict.fromkeys([*own, "text"])).mapInArrow(run, schema)


def op10_pii(spark, sf_dir: str) -> DataFrame:
    return find_pii(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"))


#: The base columns for DuckDB, which tells no places of matches: a match begins after all pieces and matches before it.
BASE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
k(o, kind) AS (VALUES (1, 'email'), (2, 'ip'), (3, 'card'), (4, 'phone')),
m AS (SELECT r, o, kind, CASE o WHEN 1 THEN regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') WHEN 2 THEN regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)')
  WHEN 3 THEN regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+') ELSE regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]') END AS ms,
  CASE o WHEN 1 THEN regexp_split_to_array(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') WHEN 2 THEN regexp_split_to_array(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)')
  WHEN 3 THEN regexp_split_to_array(t, '[0-9]([\x20-]?[0-9])+') ELSE regexp_split_to_array(t, '\+[0-9][\x20().0-9-]+[0-9]') END AS ps FROM d, k),
u AS (SELECT r, o, kind, unnest(ms) AS s, generate_subscripts(ms, 1) AS i, ms, ps FROM m WHERE len(ms) > 0),
v AS (SELECT r, o, kind, s, list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS a,
  regexp_replace(s, '[^0-9]', '', 'g') AS g FROM u),
w AS (SELECT *, CASE o WHEN 1 THEN true
  WHEN 2 THEN len(list_filter(string_split(s, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(right(x, 3) AS INT), 0) > 255)) = 0
  WHEN 3 THEN length(g) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length(g)), lambda i: CASE WHEN i % 2 = 0 THEN g[length(g) - i]::INT ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][g[length(g) - i]::INT + 1] END)) % 10 = 0
  ELSE length(g) BETWEEN 9 AND 15 END AS ok FROM v),
z AS (SELECT r, count(*) FILTER (o = 1) AS n_email, count(*) FILTER (o = 2) AS n_ip, count(*) FILTER (o = 3) AS n_card, count(*) FILTER (o = 4) AS n_phone,
  string_agg(kind || ':' || a::BIGINT || ':' || (a + length(s))::BIGINT, ',' ORDER BY o, a) AS spans FROM w WHERE ok GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(spans, '')) AS base_sha256
FROM d LEFT JOIN z USING (r)
"""
