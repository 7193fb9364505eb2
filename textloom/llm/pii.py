"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The tagger is trained in numpy on labelled spans in sentences that a seeded rule writes (``sentences``).  It reads windows of ``WINDOW``
characters that overlap by half.  All windows with a sign of personal data (an @ or what stands for it, or a digit) and their neighbours are read; the other windows can hold no
span, as every kind needs one of these.  What the windows say of a character is averaged, weighted by its distance from their edges, to one
sequence of scores for each stretch of such windows, however long, and one Viterbi pass over the stretch gives its tags: spans are found globally, not window by window.

A span of the tagger is added if it touches no span of the patterns, except to hold whole ones of its own kind, and passes the check of its kind (``accepted``): an address has one @ or what stands for it and a host with
dots, a number of the net four parts to 255, a card 13 to 19 digits that pass Luhn, a phone number 9 to 15 digits in groups; so that the patterns' spans stay as they are.
What the patterns cannot see: addresses with letters beyond ASCII or written with (at) and (dot), net numbers with bracketed dots, cards with
other separators, national phone numbers.

Positions are code points, end exclusive.  Null and empty texts have no spans; rows are independent, repeated ones each get their spans, and other columns, whatever their
names, are not carried; texts are read whole, in time linear in their length.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
WINDOW, EMBED, HIDDEN = 96, 12, 24
SIGNS = " @.-_%+():,/\n'\"#*&!?;|=<>[]{}$"
CODES = 5 + 26 + len(SIGNS)

_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[@0-9]|[(\[{] ?(?:at|AT) ?[)\]}]")
_AT = r"(?: ?@ ?| ?[(\[{] ?(?:at|AT) ?[)\]}] ?)"
_DOT = r"(?: ?\. ?| ?[(\[{] ?(?:dot|DOT|\.) ?[)\]}] ?)"
_MAIL = re.compile(rf"[\w%+-]+(?:\.[\w%+-]+)*{_AT}\w[\w-]*(?:{_DOT}\w[\w-]*)*{_DOT}[^\W\d_]{{2,}}")
_NET = re.compile(rf"([0-9]{{1,3}}){_DOT}([0-9]{{1,3}}){_DOT}([0-9]{{1,3}}){_DOT}([0-9]{{1,3}})")
_GROUPS = re.compile(r"[0-9]{3,6}(?:([ ./·\xa0-]) ?[0-9]{3,6}){2,5}")
_CALL = re.compile(r"(?:00 ?)?\(?0?[0-9]{2,5}\)?(?:[ ./-]{1,2}\(?[0-9]{2,8}\)?){1,5}|0[0-9]{8,14}")
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-./ ]?[01]?[0-9][-./ ][0-3]?[0-9](?![0-9])|[0-3]?[0-9][./-][01]?[0-9][./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2} ?[-/] ?(?:19|20)[0-9]{2}")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards, so that long runs without one cost nothing."""
    at, least = text.find("@"), 0
    while at >= 0:
        before = text[least:at]
        start = least + len(before.rstrip(_LOCAL))
        host = _HOST.match(text, at + 1) if start < at else None
        least = at + 1
        if host:
            yield start, host.end()
            least = host.end()
        at = text.find("@", least)


def patterns(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)]
    if _TRIGGER.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                out.append((1, *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, *m.span()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


def coded(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return _table()[np.minimum(points, 256)]


@lru_cache(1)
def _table() -> np.ndarray:
    out = np.full(257, 2, dtype=np.int32)  # 0: beyond the text, 1: digit, 2: another sign, 3: another letter
    for i in range(128, 256):
        out[i] = 3 if chr(i).isalpha() else 2
    out[256] = 3
    out[48:58] = 1
    for k in range(26):
        out[65 + k] = out[97 + k] = 5 + k
    for k, c in enumerate(SIGNS):
        out[ord(c)] = 31 + k
    return out


def sentences(n: int, seed: int = 7) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Labelled sentences: invented words, numbers that are no personal data, and labelled spans of every kind."""
    rng = random.Random(seed)
    pick = rng.choice
    word = lambda: "".join(pick("th on er an in re ed ti es la de que ie un ch st ou ma lo vi é ü ñ".split()) for _ in range(rng.randint(1, 3)))
    digits = lambda k: "".join(pick("0123456789") for _ in range(k))
    part = lambda: str(rng.randint(0, 255))

    def email():
        local = pick([word() + pick("._-+") + word(), word() + digits(2), word(), word() + "." + word() + digits(1)])
        at = pick(["@"] * 5 + ["(at)", " (at) ", "[at]", " [at] ", " @ ", " AT ".join(["[", "]"]).replace("[ ", "[").replace(" ]", "]")])
        dot = pick(["."] * 5 + [" (dot) ", "[dot]", "(dot)", "[.]"]) if at != "@" else "."
        host = [word() for _ in range(pick([1, 1, 2]))] + [pick("com org net example io de fr es info".split())]
        return local + at + dot.join(host)

    def net():
        dot = pick(["."] * 4 + ["[.]", "(.)", " . "])
        own = [part() for _ in range(4)]
        return own[0] + "." + own[1] + "." + own[2] + "[.]" + own[3] if rng.random() < 0.1 else dot.join(own)

    def card():
        body = digits(pick([14, 15, 15, 15]))
        body += next(d for d in "0123456789" if luhn(body + d))
        sep = pick(["", " ", "-", " ", ".", "/", " - "])
        return sep.join(body[i : i + 4] for i in range(0, len(body), 4))

    def phone():
        return pick([
            f"+{digits(2)} {digits(3)} {digits(3)} {digits(4)}", f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)}{digits(9)}", f"({digits(3)}) {digits(3)}-{digits(4)}",
            f"{digits(3)}-{digits(3)}-{digits(4)}", f"+{digits(2)}.{digits(3)}.{digits(6)}", f"0{digits(2)} {digits(4)} {digits(4)}", f"0{digits(3)}/{digits(7)}", f"00{digits(2)} {digits(2)} {digits(7)}",
            f"0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"(0{digits(2)}) {digits(3)} {digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"0{digits(10)}", f"0{digits(3)} {digits(6)}",
        ])

    spans = (email, net, card, phone)
    other = (
        lambda: f"{rng.randint(1900, 2030)}-{digits(2)}-{digits(2)}", lambda: f"{digits(1)}.{digits(1)}.{digits(1)}", lambda: digits(rng.randint(1, 7)), lambda: f"{digits(2)}:{digits(2)}",
        lambda: f"${digits(3)}.{digits(2)}", lambda: "@" + word(), lambda: f"v{digits(1)}.{digits(2)}", lambda: digits(32), lambda: f"{digits(3)}-{digits(2)}", lambda: f"{digits(4)} {digits(4)}",
        lambda: f"{digits(2)}.{digits(2)}.{rng.randint(1900, 2030)}", lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1900, 2030)}", lambda: f"({pick(['at', 'dot', 'see'])} {word()})",
        lambda: f"{digits(3)},{digits(3)},{digits(3)}", lambda: ".".join(part() for _ in range(5)), lambda: f"#{digits(8)}", lambda: f"{digits(2)}/{digits(2)}", lambda: "a3f" + digits(9) + "be",
    )
    before = ("call ", "tel. ", "mail: ", "card ", "from ", "ip=", "phone: ", "at ", "no. ", "to ")
    out = []
    for _ in range(n):
        text, own = "", []
        while len(text) < WINDOW + 21:
            draw = rng.random()
            if draw < 0.24:
                kind = rng.randrange(4)
                text += pick(before) if rng.random() < 0.3 else ""
                piece = spans[kind]()
                own.append((kind, len(text), len(text) + len(piece)))
            else:
                piece = pick(other)() if draw < 0.38 else word()
                piece = piece.capitalize() if rng.random() < 0.15 else piece
            text += piece + pick([" ", " ", " ", ", ", ". ", "\n", ": ", "; "])
        cut_at = rng.randint(0, 20)
        own = [(k, max(0, a - cut_at), b - cut_at) for k, a, b in own if b > cut_at]
        out.append((text[cut_at:], own))
    return out


def tags_of(spans: list[tuple[int, int, int]], length: int) -> np.ndarray:
    out = np.zeros(length, dtype=np.int64)
    for kind, a, b in spans:
        if a < length:
            out[a : min(b, length)] = 2 + 2 * kind
            out[a] = 1 + 2 * kind
    return out


def _lstm(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    """x: (time, batch, embed) -> hidden states, and what the backward pass needs."""
    steps, batch, _ = x.shape
    h, c, out, kept = np.zeros((batch, HIDDEN), x.dtype), np.zeros((batch, HIDDEN), x.dtype), np.empty((steps, batch, HIDDEN), x.dtype), []
    gates = x @ w[:EMBED] + b
    for t in range(steps):
        z = gates[t] + h @ w[EMBED:]
        s = 0.5 * np.tanh(0.5 * z[:, : 3 * HIDDEN]) + 0.5
        g = np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        before, c_before = h, c
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        kept.append((i, f, o, g, c_before, tc, before))
    return out, kept


def _lstm_back(x: np.ndarray, w: np.ndarray, kept: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps, batch, _ = x.shape
    dz = np.empty((steps, batch, 4 * HIDDEN), x.dtype)
    dh, dc = np.zeros((batch, HIDDEN), x.dtype), np.zeros((batch, HIDDEN), x.dtype)
    for t in range(steps - 1, -1, -1):
        i, f, o, g, c_before, tc, _ = kept[t]
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz[t] = np.concatenate([dc * g * i * (1 - i), dc * c_before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dh, dc = dz[t] @ w[EMBED:].T, dc * f
    before = np.stack([k[6] for k in kept])
    dw = np.concatenate([np.einsum("tbe,tbz->ez", x, dz, optimize=True), np.einsum("tbh,tbz->hz", before, dz, optimize=True)])
    return dw, dz.sum(axis=(0, 1)), dz @ w[:EMBED].T


def _emissions(p: dict, codes: np.ndarray) -> tuple[np.ndarray, tuple]:
    """codes: (time, batch) -> scores (time, batch, tag)."""
    x = p["embed"][codes]
    ahead, kept_a = _lstm(x, p["wa"], p["ba"])
    back, kept_b = _lstm(x[::-1], p["wb"], p["bb"])
    h = np.concatenate([ahead, back[::-1]], axis=2)
    return h @ p["out"] + p["bias"], (x, h, kept_a, kept_b)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _crf_gradient(e: np.ndarray, trans: np.ndarray, gold: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood, and its gradients by emissions and transitions."""
    steps, batch, _ = e.shape
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for t in range(1, steps):
        alpha[t] = e[t] + _log_sum(alpha[t - 1][:, :, None] + trans, 1)
    for t in range(steps - 2, -1, -1):
        beta[t] = _log_sum(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    z = _log_sum(alpha[-1], 1)
    rows = np.arange(batch)
    de = np.exp(alpha + beta - z[None, :, None])
    pair = np.exp(alpha[:-1, :, :, None] + trans + (e[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None])
    dt = pair.sum(axis=(0, 1))
    score = np.zeros(batch)
    for t in range(steps):
        score += e[t, rows, gold[t]]
        de[t, rows, gold[t]] -= 1
        if t:
            score += trans[gold[t - 1], gold[t]]
    np.add.at(dt, (gold[:-1].ravel(), gold[1:].ravel()), -1)
    return float((z - score).mean()), de / batch, dt / batch


@lru_cache(4)
def trained(steps: int = 520, batch: int = 48, seed: int = 3) -> dict:
    """Parameters of the tagger; always the same for the same arguments."""
    rng = np.random.default_rng(seed)
    data = sentences(steps * batch // 3, seed)
    codes, gold = np.zeros((WINDOW, len(data)), np.int32), np.zeros((WINDOW, len(data)), np.int64)
    for k, (text, spans) in enumerate(data):  # some windows begin before the text, some end behind it
        shift = max(0, int(rng.integers(-WINDOW, WINDOW // 2)))
        size = WINDOW - shift if rng.random() < 0.7 else int(rng.integers(20, WINDOW - shift))
        codes[shift : shift + size, k] = coded(text)[:size]
        gold[shift : shift + size, k] = tags_of(spans, size)
    near = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    p = {"embed": near(CODES, EMBED) * 4, "out": near(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
    for side in "ab":
        p["w" + side], p["b" + side] = near(EMBED + HIDDEN, 4 * HIDDEN), np.zeros(4 * HIDDEN, np.float32)
        p["b" + side][HIDDEN : 2 * HIDDEN] = 1
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = rng.integers(0, codes.shape[1], batch)
        c, y = codes[:, pick], gold[:, pick]
        e, (x, h, kept_a, kept_b) = _emissions(p, c)
        _, de, dt = _crf_gradient(e, p["trans"], y)
        dh = de @ p["out"].T
        wa, ba, xa = _lstm_back(x, p["wa"], kept_a, dh[:, :, :HIDDEN])
        wb, bb, xb = _lstm_back(x[::-1], p["wb"], kept_b, dh[::-1, :, HIDDEN:])
        embed = np.zeros_like(p["embed"])
        np.add.at(embed, c, xa + xb[::-1])
        grads = {"embed": embed, "out": np.einsum("tbh,tbk->hk", h, de, optimize=True), "bias": de.sum(axis=(0, 1)), "trans": dt, "wa": wa, "ba": ba, "wb": wb, "bb": bb}
        rate = 0.02 * (1 - 0.9 * step / steps)
        for k, g in grads.items():
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return p


def decode(p: dict, stretches: list[np.ndarray]) -> list[np.ndarray]:
    """Best tags of each sequence of scores (time, tag) by Viterbi; an inside tag follows only tags of its kind."""
    allowed = p["trans"].copy()
    for kind in range(len(KINDS)):
        inside = 2 + 2 * kind
        for tag in range(TAGS):
            if tag not in (inside, inside - 1):
                allowed[tag, inside] = -1e4
    first = np.array([-1e4 if k and k % 2 == 0 else 0 for k in range(TAGS)], dtype=np.float32)
    out: list = [None] * len(stretches)
    order = sorted(range(len(stretches)), key=lambda i: (len(stretches[i]), i))
    for begin in range(0, len(order), 128):  # of similar lengths; each ends where its own scores end
        some = order[begin : begin + 128]
        sizes = np.array([len(stretches[i]) for i in some])
        steps = int(sizes.max())
        e = np.zeros((steps, len(some), TAGS), dtype=np.float32)
        for k, i in enumerate(some):
            e[: sizes[k], k] = stretches[i]
        come = np.zeros((steps, len(some), TAGS), dtype=np.int8)
        score = first + e[0]
        last = np.where(sizes == 1, score.argmax(axis=1), 0)
        for t in range(1, steps):
            every = score[:, :, None] + allowed
            come[t] = every.argmax(axis=1)
            score = every.max(axis=1) + e[t]
            done = sizes == t + 1
            if done.any():
                last[done] = score[done].argmax(axis=1)
        for k, i in enumerate(some):
            tags = np.empty(sizes[k], dtype=np.int8)
            tags[-1] = tag = last[k]
            for t in range(sizes[k] - 1, 0, -1):
                tags[t - 1] = tag = come[t, k, tag]
            out[i] = tags
    return out


def tagged(p: dict, docs: list[str], at_once: int = 256) -> list[list[tuple[int, int, int]]]:
    """Spans that the tagger sees in each text."""
    step = WINDOW // 2
    weight = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None]
    parts, where, stretches = [], [], []  # windows; their stretch and place in it; (text, start, end, sums, weights)
    for n, text in enumerate(docs):
        found = [m.start() for m in _TRIGGER.finditer(text)]
        if not found:
            continue
        cells = np.unique(np.asarray(found) // step)  # a cell is half a window; windows k-1 and k hold cell k
        windows = np.unique(np.concatenate([cells - 2, cells - 1, cells, cells + 1]))
        windows = windows[(windows >= -1) & (windows * step < len(text))]
        codes = np.concatenate([np.zeros(step, np.int32), coded(text), np.zeros(WINDOW, np.int32)])
        for run in np.split(windows, np.flatnonzero(np.diff(windows) > 1) + 1):
            size = (len(run) + 1) * step
            stretches.append((n, int(run[0]) * step, np.zeros((size, TAGS), np.float32), np.zeros((size, 1), np.float32)))
            for k, w in enumerate(run):
                parts.append(codes[(w + 1) * step : (w + 1) * step + WINDOW])
                where.append((len(stretches) - 1, k * step))
    for begin in range(0, len(parts), at_once):
        e = _emissions(p, np.stack(parts[begin : begin + at_once], axis=1))[0]
        for k, (i, at) in enumerate(where[begin : begin + at_once]):
            stretches[i][2][at : at + WINDOW] += weight * e[:, k]
            stretches[i][3][at : at + WINDOW] += weight
    scores, place = [], []
    for n, start, sums, weights in stretches:
        a, b = max(0, -start), min(len(sums), len(docs[n]) - start)
        if a < b:
            scores.append(np.round(sums[a:b] / weights[a:b], 3))  # so that the last digits, which can differ with the windows beside, decide nothing
            place.append((n, start + a))
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    for (n, start), tags in zip(place, decode(p, scores), strict=True):
        at = 0
        for i in np.flatnonzero(tags).tolist():
            if i < at:
                continue
            kind, end = (int(tags[i]) - 1) // 2, i + 1
            while end < len(tags) and tags[end] == 2 + 2 * kind:
                end += 1
            out[n].append((kind, start + i, start + end))
            at = end
    return out


def accepted(kind: int, part: str) -> bool:
    """Whether a span of the tagger is of its kind for certain."""
    digits = re.sub("[^0-9]", "", part)
    if kind == 0:
        return bool(_MAIL.fullmatch(part))
    if kind == 1:
        m = _NET.fullmatch(part)
        return bool(m) and all(int(x) <= 255 for x in m.groups())
    if kind == 2:
        return bool(_GROUPS.fullmatch(part) or part.isascii() and part.isdigit()) and 13 <= len(digits) <= 19 and luhn(digits)
    return bool(_CALL.fullmatch(part)) and 9 <= len(digits) <= 15 and not _DATE.search(part)


def find(docs: list[str | None], p: dict) -> list[list[tuple[int, int, int, bool]]]:
    """(kind, start, end, from the patterns) for each text, by kind, then start."""
    docs = [t or "" for t in docs]
    out = []
    for text, more in zip(docs, tagged(p, docs), strict=True):
        base = patterns(text)
        own = [(*s, True) for s in base]
        for kind, a, b in more:
            while a < b and text[b - 1] in " \t\n.,;:!?":
                b -= 1
            while a < b and text[a] in " \t\n.,;:":
                a += 1
            if any(x < b and a < y and not (k == kind and a <= x and y <= b) for k, x, y in base):  # it may hold a span of its own kind
                continue
            alone = (a == 0 or not (text[a - 1].isalnum() or text[a - 1] in "+-.")) and (b == len(text) or not (text[b].isalnum() or text[b] == "-"))
            if alone and (kind, a, b) not in base and accepted(kind, text[a:b]):
                own.append((kind, a, b, False))
        out.append(sorted(own))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, spans array<struct<kind,start,end,base>>)`` for every row."""
    rows = texts(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(trained())
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .license_scan import grouped

        for batch in batches:
            found = [x for some in grouped(batch.column(1).to_pylist(), 300_000) for x in find(some, sent.value)]
            spans = [[{"kind": KINDS[k], "start": a, "end": b, "base": base} for k, a, b, base in own] for own in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["id", "spans"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    def joined(xs: Column) -> Column:
        return F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def of(kind: str):
        return lambda x: x["base"] & (x["kind"] == kind)

    return found.select(
        F.col("id").alias(id_col),
        *(F.size(F.filter("spans", of(k))).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(F.filter("spans", lambda x: x["base"])).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
