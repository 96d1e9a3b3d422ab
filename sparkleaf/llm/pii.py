"""Personal data: rules for well-formed kinds, and a character BiLSTM with CRF transitions for what they miss.

The tagger is trained in numpy from labelled spans that a generator makes (well-formed and sloppy mentions in invented prose,
beside numbers, dates, keys and versions that are no personal data). A grid of overlapping windows covers every text; each
window is decoded on its own and each character takes its tag from the window in which it stands farthest from an edge.
Spans are read from the whole text's tags, checked for form, and added to the rules' spans where they overlap none.

Only characters of runs that a well-formed span may hold can change the result (digits with their punctuation, or a local part, an
at sign and a domain), together with one character on each side. Windows that give no such character its tag are
left out; what is found is the same as with all windows (`everywhere`), however long a run is.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Payload, releasing, row_type, sliced

KINDS = ("email", "ip", "card", "phone")
#: Tags: 0 outside; 1 + 2 * kind begins a span, 2 + 2 * kind continues it.
TAGS = 1 + 2 * len(KINDS)
WINDOW, STRIDE = 128, 64
EMBED, HIDDEN = 12, 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile("[0-9@]")
#: From a digit over all that spans of numbers may hold or that is stripped from their ends.
_NUMBERS = re.compile(r"[0-9][0-9.,()+\s-]*")
_NUMBER_CHARS = frozenset("0123456789.,()+-")
_STRIPPED = " .,-\n"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@domain.tld: from each at sign back over the local part."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))
    return out


def _ip_ok(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """The rules' spans of each kind in code points, ends exclusive."""
    out = [emails(text), [], [], []]
    out[1] = [m.span() for m in _IP.finditer(text) if _ip_ok(m[0])]
    out[2] = [m.span() for m in _CARD.finditer(text) if m.end() - m.start() <= 40 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out[3] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# ---- the tagger


@lru_cache(1)
def _classes() -> dict[str, int]:
    return {c: i + 3 for i, c in enumerate(map(chr, range(32, 127)))} | {"\n": 2}


N_CLASSES = 99


def codes(text: str) -> np.ndarray:
    """Character classes: ASCII one by one, newline, other; 0 is padding."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where((cp >= 32) & (cp < 127), cp.astype(np.int64) - 29, 1)
    out[cp == 10] = 2
    return out


@dataclass
class Tagger:
    embed: np.ndarray
    wx: np.ndarray  # direction x input x 4 hidden
    wh: np.ndarray
    b: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    trans: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [self.embed, self.wx, self.wh, self.b, self.out, self.bias, self.trans]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states (batch, time, hidden) and what the way back needs."""
    n, t, _ = x.shape
    h = np.zeros((n, HIDDEN), x.dtype)
    c = np.zeros_like(h)
    pre = x @ wx + b
    hs, kept = np.empty((n, t, HIDDEN), x.dtype), []
    for i in range(t):
        g = pre[:, i] + h @ wh
        s = _sigmoid(g[:, : 3 * HIDDEN])
        gi, gf, go = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        gc = np.tanh(g[:, 3 * HIDDEN :])
        before, h_before = c, h
        c = gf * c + gi * gc
        tc = np.tanh(c)
        h = go * tc
        hs[:, i] = h
        kept.append((gi, gf, go, gc, before, tc, h_before))
    return hs, kept


def _lstm_back(dh_all: np.ndarray, x: np.ndarray, wx: np.ndarray, wh: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, t, _ = x.shape
    dpre = np.empty((n, t, 4 * HIDDEN), x.dtype)
    dwh = np.zeros_like(wh)
    dh = np.zeros((n, HIDDEN), x.dtype)
    dc = np.zeros_like(dh)
    for i in range(t - 1, -1, -1):
        gi, gf, go, gc, before, tc, h_before = kept[i]
        dh = dh + dh_all[:, i]
        dc = dc + dh * go * (1 - tc * tc)
        d = dpre[:, i]
        d[:, :HIDDEN] = dc * gc * gi * (1 - gi)
        d[:, HIDDEN : 2 * HIDDEN] = dc * before * gf * (1 - gf)
        d[:, 2 * HIDDEN : 3 * HIDDEN] = dh * tc * go * (1 - go)
        d[:, 3 * HIDDEN :] = dc * gi * (1 - gc * gc)
        dc = dc * gf
        dwh += h_before.T @ d
        dh = d @ wh.T
    return dpre @ wx.T, np.tensordot(x, dpre, ([0, 1], [0, 1])), dwh, dpre.sum(axis=(0, 1))


def _emissions(m: Tagger, x: np.ndarray) -> tuple[np.ndarray, tuple]:
    e = m.embed[x]
    fwd, k0 = _lstm(e, m.wx[0], m.wh[0], m.b[0])
    bwd, k1 = _lstm(e[:, ::-1], m.wx[1], m.wh[1], m.b[1])
    h = np.concatenate((fwd, bwd[:, ::-1]), axis=2)
    return h @ m.out + m.bias, (e, h, k0, k1)


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _allowed() -> np.ndarray:
    """0, or a large negative number where a continuation doesn't follow its own kind."""
    out = np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(KINDS)):
        out[:, 2 + 2 * k] = -1e4
        out[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
    return out


def _step(m: Tagger, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Negative log-likelihood of the tags of a batch, and its gradients."""
    em, (e, h, k0, k1) = _emissions(m, x)
    n, t, _ = em.shape
    trans = m.trans + _allowed()
    alpha, beta = np.empty_like(em), np.zeros_like(em)
    alpha[:, 0] = em[:, 0]
    for i in range(1, t):
        alpha[:, i] = _logsum(alpha[:, i - 1, :, None] + trans, 1) + em[:, i]
    for i in range(t - 2, -1, -1):
        beta[:, i] = _logsum(trans + (em[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
    z = _logsum(alpha[:, -1], 1)
    rows = np.arange(n)
    gold = em[rows[:, None], np.arange(t), y].sum(axis=1) + trans[y[:, :-1], y[:, 1:]].sum(axis=1)
    d_em = np.exp(alpha + beta - z[:, None, None])
    d_em[rows[:, None], np.arange(t), y] -= 1
    pair = np.exp(alpha[:, :-1, :, None] + trans + (em[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum(axis=(0, 1))
    np.add.at(pair, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
    d_em /= n
    dh = d_em @ m.out.T
    de0, dwx0, dwh0, db0 = _lstm_back(dh[:, :, :HIDDEN], e, m.wx[0], m.wh[0], k0)
    de1, dwx1, dwh1, db1 = _lstm_back(dh[:, ::-1, HIDDEN:], e[:, ::-1], m.wx[1], m.wh[1], k1)
    d_embed = np.zeros_like(m.embed)
    np.add.at(d_embed, x.ravel(), (de0 + de1[:, ::-1]).reshape(-1, EMBED))
    return float((z - gold).mean()), [d_embed, np.stack((dwx0, dwx1)), np.stack((dwh0, dwh1)), np.stack((db0, db1)), np.tensordot(h, d_em, ([0, 1], [0, 1])), d_em.sum(axis=(0, 1)), (pair / n).astype(np.float32)]


def labelled(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """An invented text of WINDOW characters or more with its (kind, start, end) spans."""
    letters = "abcdefghijklmnopqrstuvwxyz" * 3 + "áéíóúñäöüßèêç"

    def word(a: int = 2, b: int = 11) -> str:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(a, b)))
        return w.capitalize() if rng.random() < 0.15 else w

    def plain() -> str:
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8)))

    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def entity(kind: int) -> str:
        if kind == 0:
            local = plain() + rng.choice(["", "." + plain(), "." + d(2), "_" + d(1), d(2)])
            domain = plain() + rng.choice(["", d(1)]) + rng.choice([".com", ".org", ".example.com", ".de", ".co.uk"])
            if rng.random() < 0.15:  # long ones
                local = rng.choice(["", local + "."]) + rng.choice("._-+").join(plain() for _ in range(rng.randint(3, 9)))
            if rng.random() < 0.15:
                domain = rng.choice(".-").join(plain() for _ in range(rng.randint(2, 8))) + "." + domain
            return local + rng.choice(["@", "@", "@", " @ ", "@ "]) + domain
        if kind == 1:
            return rng.choice([".", ".", ".", ". "]).join(str(rng.randint(0, 255)) for _ in range(4))
        if kind == 2:
            n = d(15)
            n += next(c for c in "0123456789" if luhn(n + c))
            return n if rng.random() < 0.6 else rng.choice([" ", "-", ".", "  "]).join(n[i : i + 4] for i in range(0, 16, 4))
        a, b, c = d(3), d(3), d(4)
        return rng.choice([f"+1 ({a}) {b}-{c}"] * 3 + [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"00{d(2)} {d(2)} {d(4)} {d(4)}", f"+{d(2)} {d(2)} {d(7)}", f"+{d(2)}-{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(2)} {d(7)}"])

    def other() -> str:
        y = str(rng.randint(1900, 2060))
        return rng.choice([y, d(1), d(2), d(4), d(6), d(9), d(14), d(22), f"{d(2)}.{d(2)}.{y}", f"{y}-{d(2)}-{d(2)}", f"v{d(1)}.{d(1)}", f"{d(1)}.{d(1)}.{d(1)}", f"{d(3)},{d(3)}", f"${d(2)}.{d(2)}", f"{d(2)}%", f"{d(2)}:{d(2)}:{d(2)}", "AKIA" + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ0123456789") for _ in range(16)), "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([16, 32, 40]))), f"token = \"{d(3)}{plain()}{d(4)}\"", f"version {d(1)}", f"License {d(1)}.{d(1)}", f"@{plain()}", f"@ {d(1)}.{d(2)}", f"{d(1)}-{d(1)}", f"#{d(5)}", f"({d(1)})", f"{d(3)}-{d(4)}", f"ISBN {d(3)}-{d(1)}-{d(2)}-{d(6)}-{d(1)}"])

    text, spans = "", []
    goal = rng.randint(2, 5)
    while len(text) < WINDOW or goal > 0:
        x = rng.random()
        if x < 0.30:
            kind = rng.randrange(len(KINDS))
            s = entity(kind)
            spans.append((kind, len(text), len(text) + len(s)))
            text += s
            goal -= 1
        elif x < 0.5:
            text += other()
            goal -= 1
        else:
            text += word()
            for _ in range(rng.randint(0, 4)):
                text += " " + word()
        text += rng.choice([" ", " ", " ", " ", ", ", ". ", "\n"])
    return text, spans


@lru_cache(1)
def train(steps: int = 300, batch: int = 16, seed: int = 11, rate: float = 0.015) -> Tagger:
    """A tagger trained with Adam on windows of generated texts; the same for the same arguments."""
    rng, np_rng = random.Random(seed), np.random.default_rng(seed)
    init = lambda *shape: (np_rng.standard_normal(shape) / np.sqrt(shape[-2] if len(shape) > 1 else 1)).astype(np.float32)
    b = np.zeros((2, 4 * HIDDEN), np.float32)
    b[:, HIDDEN : 2 * HIDDEN] = 1
    m = Tagger(0.5 * np_rng.standard_normal((N_CLASSES, EMBED)).astype(np.float32), init(2, EMBED, 4 * HIDDEN), init(2, HIDDEN, 4 * HIDDEN), b, init(2 * HIDDEN, TAGS), np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS), np.float32))
    one, two = [np.zeros_like(p) for p in m.params()], [np.zeros_like(p) for p in m.params()]
    for step in range(1, steps + 1):
        xs, ys = [], []
        for _ in range(batch):
            text, spans = labelled(rng)
            tags = np.zeros(len(text), np.int64)
            for kind, start, end in spans:
                tags[start:end] = 2 + 2 * kind
                tags[start] = 1 + 2 * kind
            at = rng.randint(0, len(text) - WINDOW)
            if at and tags[at] and tags[at] % 2 == 0:  # a window may begin inside a span: that is its begin there
                tags[at] -= 1
            xs.append(codes(text)[at : at + WINDOW])
            ys.append(tags[at : at + WINDOW])
        _, grads = _step(m, np.array(xs), np.array(ys))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, u, v in zip(m.params(), grads, one, two, strict=True):
            g = g * min(1.0, 5 / (norm + 1e-9))
            u += 0.1 * (g - u)
            v += 0.001 * (g * g - v)
            p -= (lr * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return m


def _states(table: np.ndarray, wh: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Hidden states of one direction; table: what each character class adds to the gates."""
    h = np.zeros((len(x), HIDDEN), table.dtype)
    c, hs = np.zeros_like(h), np.empty((x.shape[1], len(x), HIDDEN), table.dtype)
    for i in range(x.shape[1]):
        g = table[x[:, i]]
        g += h @ wh
        s = _sigmoid(g[:, : 3 * HIDDEN])
        c = s[:, HIDDEN : 2 * HIDDEN] * c + s[:, :HIDDEN] * np.tanh(g[:, 3 * HIDDEN :])
        h = s[:, 2 * HIDDEN :] * np.tanh(c)
        hs[i] = h
    return hs


def viterbi(m: Tagger, x: np.ndarray) -> np.ndarray:
    """The best tags of each window; padding is outside."""
    n, t = x.shape
    tables = m.embed @ m.wx + m.b[:, None, :]
    h = np.concatenate((_states(tables[0], m.wh[0], x), _states(tables[1], m.wh[1], x[:, ::-1])[::-1]), axis=2)
    em = h @ m.out + m.bias
    em[x.T == 0] = -1e4
    em[:, :, 0][x.T == 0] = 0
    trans = (m.trans + _allowed()).T
    score, back = em[0].copy(), np.empty((t, n, TAGS), np.int8)
    for i in range(1, t):
        all_ = score[:, None, :] + trans
        back[i] = all_.argmax(axis=2)
        score = all_.max(axis=2) + em[i]
    tags = np.empty((t, n), np.int8)
    tags[-1] = score.argmax(axis=1)
    rows = np.arange(n)
    for i in range(t - 1, 0, -1):
        tags[i - 1] = back[i, rows, tags[i]]
    return tags.T


def grid(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows over a text of n characters, and the ends of the parts whose tags they give.

    A character's tag comes from the window in which it stands farthest from an edge that isn't the text's own; the earlier of two.
    """
    starts = np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)
    starts[-1] = max(0, n - WINDOW)  # the last one ends with the text
    return starts, np.append((starts[:-1] + starts[1:] + WINDOW - 1) // 2 + 1, n)


def candidate_runs(text: str) -> list[tuple[int, int]]:
    """Runs that can hold a well-formed span, with what may be stripped from its ends and one character more on each side."""
    runs, n = [], len(text)
    for m in _NUMBERS.finditer(text):
        start = m.start()
        while start and (text[start - 1] in _NUMBER_CHARS or text[start - 1].isspace()):
            start -= 1
        runs.append((max(0, start - 1), min(n, m.end() + 1)))
    at = text.find("@")
    while at >= 0:
        start = at - (at > 0 and text[at - 1].isspace())
        while start and text[start - 1] in _LOCAL:
            start -= 1
        while start and text[start - 1] in _STRIPPED:
            start -= 1
        end = at + 1 + (at + 1 < n and text[at + 1].isspace())
        while end < n and text[end] in _LOCAL:
            end += 1
        while end < n and text[end] in _STRIPPED:
            end += 1
        runs.append((max(0, start - 1), min(n, end + 1)))
        at = text.find("@", at + 1)
    return runs


def _well_formed(kind: int, s: str) -> bool:
    """Whether a tagged span could be of its kind."""
    digits = _digits(s)
    if kind == 0:
        local, at, domain = s.partition("@")
        return bool(at) and bool(re.fullmatch(r"[A-Za-z0-9._%+-]+\s?", local)) and bool(re.fullmatch(r"\s?[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", domain))
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]{1,3}(\s?\.\s?[0-9]{1,3}){3}", s)) and all(int(p) <= 255 for p in s.split("."))
    if kind == 2:
        return 13 <= len(digits) <= 19 and bool(re.fullmatch(r"[0-9](([ .-]|  )?[0-9])+", s)) and luhn(digits)
    shape = re.fullmatch(r"(\+|00)[0-9][0-9 ().-]+[0-9]|\([0-9]{2,5}\)[0-9 .-]+[0-9]|[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}|0[0-9]([ -][0-9]{2}){4}|0[0-9]{2,4}[ -][0-9]{6,8}", s)
    return bool(shape) and 9 <= len(digits) <= 15


def _read(text: str, tags: np.ndarray, base: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
    """Well-formed spans of each kind in a text's tags that overlap no base span."""
    out: list[list[tuple[int, int]]] = [[] for _ in KINDS]
    at = np.flatnonzero(tags)
    if not len(at):
        return out
    found = tags[at].astype(np.int64)
    kinds = (found - 1) // 2
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (found[1:] % 2 == 1) | (kinds[1:] != kinds[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    taken = sorted(x for spans in base for x in spans)
    for kind, start, end in zip(kinds[first].tolist(), at[first].tolist(), (at[last] + 1).tolist(), strict=True):
        while start < end and text[end - 1] in _STRIPPED:
            end -= 1
        while start < end and text[start] in _STRIPPED:
            start += 1
        whole = (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum())
        if end > start and whole and _well_formed(kind, text[start:end]) and not any(a < end and start < b for a, b in taken):
            out[kind].append((start, end))
    return out


def added_spans(m: Tagger, texts: list[str], base: list[list[list[tuple[int, int]]]], batch: int = 256, everywhere: bool = False) -> list[list[list[tuple[int, int]]]]:
    """The tagger's spans of each text and kind that overlap no base span; everywhere: no window is left out."""
    tags: dict[int, np.ndarray] = {}
    coded: dict[int, np.ndarray] = {}
    jobs: list[tuple[int, int, int, int]] = []

    def decoded() -> None:
        x = np.zeros((len(jobs), WINDOW), np.int64)
        for k, (i, s, _, _) in enumerate(jobs):
            c = coded[i][s : s + WINDOW]
            x[k, : len(c)] = c
        for (i, s, low, high), found in zip(jobs, viterbi(m, x), strict=True):
            tags[i][low:high] = found[low - s : high - s]
        jobs.clear()

    for i, text in enumerate(texts):
        starts, ends = grid(len(text))
        if everywhere:
            chosen = np.arange(len(starts))
        else:
            runs = candidate_runs(text)
            pairs = [(int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends, b - 1, "right"))) for a, b in runs]
            chosen = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in pairs])) if pairs else np.empty(0, np.int64)
        if len(chosen) and text:
            coded[i], tags[i] = codes(text), np.zeros(len(text), np.int8)
            for k in chosen.tolist():
                jobs.append((i, int(starts[k]), int(ends[k - 1]) if k else 0, int(ends[k])))
                if len(jobs) == batch:
                    decoded()
    if jobs:
        decoded()
    return [_read(t, tags[i], base[i]) if i in tags else [[] for _ in KINDS] for i, t in enumerate(texts)]


def spans_of(model: Tagger, texts: list[str | None]) -> list[list[tuple[int, int, int, bool]]]:
    """(kind number, start, end, base) of each text, by kind, then start."""
    out: list[list[tuple[int, int, int, bool]]] = [[] for _ in texts]
    live = [i for i, t in enumerate(texts) if t and _TRIGGER.search(t)]
    base = [base_spans(texts[i]) for i in live]
    for i, b, a in zip(live, base, added_spans(model, [texts[i] for i in live], base), strict=True):
        for k in range(len(KINDS)):
            out[i] += sorted([(k, s, e, True) for s, e in b[k]] + [(k, s, e, False) for s, e in a[k]])
    return out


def masked_text(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """The text with its spans replaced by their kinds; overlapping ones go as one, under the kind that starts first."""
    merged: list[list[int]] = []
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, kind])
    parts, done = [], 0
    for start, end, kind in merged:
        parts += [text[done:start], f"<{KINDS[kind]}>"]
        done = end
    return "".join([*parts, text[done:]])


def find(df: DataFrame, text_col: str = "text", out_col: str = "pii", tagger: Tagger | None = None) -> DataFrame:
    """All columns of df, and pii array<struct<kind string, start int, end int, base boolean>> of the whole text.

    Positions count code points, ends are exclusive; spans come by kind (email, ip, card, phone), then start. base: found by the
    rules (leftmost, not overlapping within a kind), which all stay; the others are the tagger's and overlap no base span. A null text counts as
    empty and has none. An existing column of that name (in any case) is replaced, others may have any name; rows keep their number.
    """
    model = tagger or train()
    held = Payload(df, (out_col,))
    row = held.df.select(held.row(), held[text_col].cast("string").alias("text"))
    kind_type = "array<struct<kind:string,start:int,end:int,base:boolean>>"
    arrow_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            out = [[{"kind": KINDS[k], "start": s, "end": e, "base": f} for k, s, e, f in spans] for spans in spans_of(model, batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, arrow_type)], ["row", "pii"])

    return row.mapInArrow(tag, f"{row_type(row)}, pii {kind_type}").select(*held.back(), F.col("pii").alias(out_col))


def mask(df: DataFrame, text_col: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """df with every span that `find` gives for its text replaced by the kind in angle brackets; null texts stay null.

    Overlapping spans are masked as one, under the kind that starts first (longest, then by kind).
    """
    model = tagger or train()
    held = Payload(df)
    row = held.df.select(held.row(text_col), held[text_col].cast("string").alias("text"))

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            texts = batch.column("text").to_pylist()
            texts = [masked_text(t, spans) if spans else t for t, spans in zip(texts, spans_of(model, texts), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    return row.mapInArrow(releasing(masked), f"{row_type(row)}, text string").select(*held.back(**{text_col: F.col("text")}))
