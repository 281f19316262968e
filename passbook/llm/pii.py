"""Personal data: e-mail addresses, IP addresses, payment cards and phone numbers.

Fixed patterns give the base spans. A character-level bidirectional LSTM with CRF transitions, trained
in numpy, adds spans written in other ways. Its labelled spans are base spans of a bounded sample of the
corpus and, mostly, made ones: every kind in every layout of ``made_span``, put between the words of
sampled windows of the corpus, next to windows that hold none and numbers of other meanings.

Every labelled kind holds a digit, an ``@`` or a bracketed ``at``. The whole text is searched for
these, and windows cover every place within ``REACH`` characters of one and the whole run of address
characters it stands in; the rest of a text cannot hold a span of any kind and is not decoded.
Overlapping windows are decoded and their labels stitched: each place takes the label of the window in
whose middle it lies, so a span may cross windows. Stitched spans and the spans of single windows
compete, and the set of non-overlapping spans with the highest total score wins.

Defined results: null text is empty and has no spans; offsets are code points, end exclusive; repeated
rows give repeated results; without any text to learn from, only base spans are returned.
"""

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passbook.llm.common import Adam, map_texts, text_slices, whole_texts

KINDS = ("email", "ip", "card", "phone")
# The base patterns. Possessive repeats and look-behinds only spare useless attempts.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
LONG_NUMBER = re.compile(r"[0-9](?:[ .()/-]{0,2}[0-9]){8,}")
TRIGGER = re.compile(r"[0-9@]|[(\[]at[)\]]")
OTHER_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|[(\[]at[)\]]) ?[A-Za-z0-9-]+(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]+)+")

WINDOW, STRIDE, REACH = 96, 48, 40
HIDDEN = 20
LABELS = 1 + 2 * len(KINDS)
SAMPLE_DOCS, PER_DOC = 1500, 4  # bounds of the training sample: documents (twice), windows of each
MADE = 6000  # windows with made spans
STEPS, BATCH = 600, 60
SURE = 0.5


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(done, at + 1))


def _valid(kind: str, piece: str) -> bool:
    digits = "".join(c for c in piece if "0" <= c <= "9")
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in piece.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by start, then kind as listed."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
            if kind != "phone" or "+" in text:
                found += [(kind, *m.span()) for m in pattern.finditer(text) if _valid(kind, m.group())]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# ---- the network

_SAME = {"0": "0123456789", "a": "abcdefghijklmnopqrstuvwxyz", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def _code_table() -> np.ndarray:
    table = np.full(128, 1, dtype=np.uint8)  # 0 is padding, 1 a control character, 2 beyond ASCII
    for c in range(32, 127):
        head = next((h for h, group in _SAME.items() if chr(c) in group), chr(c))
        table[c] = ord(head) - 29
    table[10] = 1
    return table


_CODES = _code_table()
SYMBOLS = 127 - 29


def codes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(points < 128, _CODES[np.minimum(points, 127)], 2).astype(np.int64)


def _sig(x):
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Bidirectional LSTM over characters with a linear-chain CRF."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        f32, h = np.float32, HIDDEN
        self.p = {}
        for side in "fb":
            self.p[f"in_{side}"] = rng.normal(0, 0.4, (SYMBOLS, 4 * h)).astype(f32)
            self.p[f"in_{side}"][:, h : 2 * h] += 1  # forget gates start open
            self.p[f"rec_{side}"] = rng.normal(0, 0.3 / np.sqrt(h), (h, 4 * h)).astype(f32)
        self.p["out"] = rng.normal(0, 0.2, (2 * h, LABELS)).astype(f32)
        self.p["bias"] = np.zeros(LABELS, f32)
        self.p["move"] = np.zeros((LABELS, LABELS), f32)
        self.p["start"] = np.zeros(LABELS, f32)
        self.trained = False

    def _run(self, codes, side, keep):
        x, u, h = self.p[f"in_{side}"], self.p[f"rec_{side}"], HIDDEN
        m, length = codes.shape
        order = range(length) if side == "f" else range(length - 1, -1, -1)
        state = cell = np.zeros((m, h), np.float32)
        out, past = np.empty((length, m, h), np.float32), []
        for t in order:
            z = x[codes[:, t]] + state @ u
            gates = _sig(z[:, : 3 * h])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            g = np.tanh(z[:, 3 * h :])
            before, cell_before = state, cell
            cell = f * cell + i * g
            squashed = np.tanh(cell)
            state = o * squashed
            out[t] = state
            if keep:
                past.append((t, before, cell_before, i, f, o, g, squashed))
        return out, past

    def emissions(self, codes, keep=False):
        fwd, past_f = self._run(codes, "f", keep)
        bwd, past_b = self._run(codes, "b", keep)
        both = np.concatenate([fwd, bwd], axis=2)
        return both @ self.p["out"] + self.p["bias"], both, past_f, past_b

    def decode(self, codes) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi labels (windows x length) and, where a window has labels, the probability of each."""
        e = self.emissions(codes)[0]
        length, m, _ = e.shape
        score, back = e[0] + self.p["start"], []
        for t in range(1, length):
            paths = score[:, :, None] + self.p["move"]
            back.append(paths.argmax(1))
            score = paths.max(1) + e[t]
        labels = np.empty((length, m), dtype=np.int64)
        labels[-1] = score.argmax(1)
        for t in range(length - 1, 0, -1):
            labels[t - 1] = back[t - 1][np.arange(m), labels[t]]
        sure = np.zeros((m, length))
        named = np.flatnonzero(labels.any(0))
        if len(named):
            alpha, beta, total = self._chain(e[:, named])
            marginal = np.exp(alpha + beta - total[None, :, None])
            sure[named] = np.take_along_axis(marginal, labels[:, named, None], 2)[:, :, 0].T
        return labels.T, sure

    def _chain(self, e):
        """Forward and backward log sums of the CRF, and the log of the sum over all labellings."""
        # In probabilities, scaled at every place so that nothing underflows.
        e = e.astype(np.float64)
        tops, move = e.max(2), np.exp(self.p["move"].astype(np.float64))
        seen = np.exp(e - tops[:, :, None])
        alpha, beta = np.empty_like(e), np.ones_like(e)
        up, down = np.empty(tops.shape), np.ones(tops.shape)
        now = seen[0] * np.exp(self.p["start"].astype(np.float64))
        for t in range(len(e)):
            now = (alpha[t - 1] @ move) * seen[t] if t else now
            up[t] = now.sum(1)
            alpha[t] = now / up[t][:, None]
        for t in range(len(e) - 2, -1, -1):
            now = (seen[t + 1] * beta[t + 1]) @ move.T
            down[t] = now.sum(1)
            beta[t] = now / down[t][:, None]
        tops_after = np.cumsum(tops[::-1], 0)[::-1] - tops
        log = lambda x: np.log(np.maximum(x, 1e-300))
        alpha = log(alpha) + (np.cumsum(np.log(up), 0) + np.cumsum(tops, 0))[:, :, None]
        beta = log(beta) + (np.cumsum(np.log(down)[::-1], 0)[::-1] + tops_after)[:, :, None]
        return alpha, beta, (np.log(up).sum(0) + tops.sum(0))

    def gradients(self, codes, y):
        p, m = self.p, len(codes)
        e, both, past_f, past_b = self.emissions(codes, keep=True)
        y = y.T
        alpha, beta, total = self._chain(e)
        gold = np.eye(LABELS, dtype=np.float32)[y]
        diff = (np.exp(alpha + beta - total[None, :, None]) - gold) / m
        left, right = alpha[:-1], e[1:] + beta[1:]
        tops = left.max(2, keepdims=True), right.max(2, keepdims=True)
        weighed = np.exp(left - tops[0]) * np.exp(tops[0] + tops[1] - total[None, :, None])
        pair = np.exp(p["move"]) * (weighed.reshape(-1, LABELS).T @ np.exp(right - tops[1]).reshape(-1, LABELS))
        seen = np.zeros((LABELS, LABELS))
        np.add.at(seen, (y[:-1].ravel(), y[1:].ravel()), 1)
        grads = {"move": ((pair - seen) / m).astype(np.float32), "start": diff[0].sum(0), "bias": diff.sum((0, 1))}
        grads["out"] = both.reshape(-1, 2 * HIDDEN).T @ diff.reshape(-1, LABELS)
        dboth = (diff @ p["out"].T).astype(np.float32)
        shown = np.eye(SYMBOLS, dtype=np.float32)[codes.T.ravel()]
        for side, past, dout in (("f", past_f, dboth[:, :, :HIDDEN]), ("b", past_b, dboth[:, :, HIDDEN:])):
            u = p[f"rec_{side}"]
            du, moved = np.zeros_like(u), np.empty((len(e), m, 4 * HIDDEN), np.float32)
            dh = dc = np.zeros((m, HIDDEN), np.float32)
            for t, before, cell_before, i, f, o, g, squashed in reversed(past):
                dh = dh + dout[t]
                dc = dc + dh * o * (1 - squashed**2)
                dz = np.concatenate([dc * g * i * (1 - i), dc * cell_before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2)], axis=1)
                moved[t] = dz
                du += before.T @ dz
                dh, dc = dz @ u.T, dc * f
            grads[f"in_{side}"], grads[f"rec_{side}"] = shown.T @ moved.reshape(-1, 4 * HIDDEN), du
        return grads

    def fit(self, examples: list[tuple[str, list[tuple[str, int, int]]]], steps: int = STEPS, seed: int = 3) -> "Tagger":
        """``examples``: windows with their spans (kind, start, end)."""
        marked = [i for i, (_, spans) in enumerate(examples) if spans]
        plain = [i for i, (_, spans) in enumerate(examples) if not spans]
        if not marked:
            return self
        codes = np.zeros((len(examples), WINDOW), dtype=np.int64)
        y = np.zeros((len(examples), WINDOW), dtype=np.int64)
        for k, (text, spans) in enumerate(examples):
            codes[k, : len(text)] = codes_of(text[:WINDOW])
            for kind, a, b in spans:
                y[k, a:b] = 2 + 2 * KINDS.index(kind)
                y[k, a : a + 1] = 1 + 2 * KINDS.index(kind)
        by_kind = [[i for i in marked if any(s[0] == kind for s in examples[i][1])] for kind in KINDS]
        pools = [np.array(x) for x in [*by_kind, plain] if x]
        rng, adam = np.random.default_rng(seed), Adam(self.p, 0.015)
        for step in range(steps):
            pick = np.concatenate([rng.choice(pool, BATCH // len(pools)) for pool in pools])
            adam.step(self.gradients(codes[pick], y[pick]), 0.015 * (1 - step / steps) + 0.0005)
        self.trained = True
        return self

    def added_spans(self, texts: list[str]) -> list[list[tuple[str, int, int, float]]]:
        """Spans (kind, start, end, score) of each whole text, from all windows, reconciled."""
        out: list[list] = [[] for _ in texts]
        if not self.trained:
            return out
        places = [(k, a) for k, t in enumerate(texts) for a in window_starts(t)]
        labels, sure = np.zeros((len(places), WINDOW), np.int8), np.zeros((len(places), WINDOW), np.float32)
        for at in range(0, len(places), 2048):
            part = places[at : at + 2048]
            codes = np.zeros((len(part), WINDOW), dtype=np.int64)
            for row, (k, a) in enumerate(part):
                piece = texts[k][a : a + WINDOW]
                codes[row, : len(piece)] = codes_of(piece)
            labels[at : at + 2048], sure[at : at + 2048] = self.decode(codes)
            labels[at : at + len(part)][codes == 0] = 0
        at = 0
        while at < len(places):
            k, end = places[at][0], at
            while end < len(places) and places[end][0] == k:
                end += 1
            if labels[at:end].any():
                starts = [a for _, a in places[at:end]]
                out[k] += stitched(starts, labels[at:end], sure[at:end], len(texts[k]))
                for row, a in enumerate(starts, at):
                    out[k] += [(kind, a + s, a + e, score) for kind, s, e, score in _runs(labels[row], sure[row]) if (s > 0 or a == 0) and e < WINDOW]
            at = end
        return [best_set(spans) for spans in out]


def window_starts(text: str) -> list[int]:
    """Starts of overlapping windows over every place near a trigger and the run of address characters around it."""
    starts: list[int] = []
    stop = last = -1
    for m in TRIGGER.finditer(text):
        b = m.end() + REACH
        if b <= stop:
            continue
        a = max(0, m.start() - REACH)
        # Both runs are followed only where no window lies yet, so the work stays linear.
        while a > max(stop, 0) and text[a - 1] in LOCAL:
            a -= 1
        while b < len(text) and text[b] in LOCAL:
            b += 1
        if a > stop:
            starts.append(a)
            last, stop = a, a + WINDOW - STRIDE
        while stop < b:
            last += STRIDE
            starts.append(last)
            stop = last + WINDOW - STRIDE
    return starts


def stitched(starts: list[int], labels: np.ndarray, sure: np.ndarray, size: int):
    """Spans (kind, start, end, score) over all windows of a text; ``starts`` ascend, a row of ``labels`` each."""
    i = 0
    while i < len(starts):
        j = i + 1
        while j < len(starts) and starts[j] <= starts[j - 1] + STRIDE:
            j += 1
        # A run of windows: each begins where the middle of its overlap with the one before lies.
        lead = [0, *((WINDOW - (starts[k] - starts[k - 1])) // 2 for k in range(i + 1, j))]
        ends = [starts[k + 1] + lead[k + 1 - i] - starts[k] for k in range(i, j - 1)] + [WINDOW]
        row = np.concatenate([labels[i + k, a:b] for k, (a, b) in enumerate(zip(lead, ends, strict=True))])
        odds = np.concatenate([sure[i + k, a:b] for k, (a, b) in enumerate(zip(lead, ends, strict=True))])
        row = row[: size - starts[i]]
        for kind, a, b, score in _runs(row, odds):
            yield kind, starts[i] + a, starts[i] + b, score
        i = j


def _runs(labels: np.ndarray, sure: np.ndarray):
    """Spans of one window: a begin label and the inside labels of its kind that follow."""
    i, n = 0, len(labels)
    while i < n:
        k = labels[i]
        if k == 0:
            i += 1
            continue
        kind, j = (k - 1) // 2, i + 1
        while j < n and labels[j] == 2 + 2 * kind:
            j += 1
        yield KINDS[kind], i, j, float(sure[i:j].mean())
        i = j


def best_set(spans):
    """Of overlapping spans the set with the highest total score (weighted interval scheduling)."""
    merged: dict[tuple[str, int, int], float] = {}
    for kind, a, b, score in spans:
        merged[kind, a, b] = max(score, merged.get((kind, a, b), 0.0))
    ordered = sorted(((*k, s) for k, s in merged.items()), key=lambda s: (s[2], s[1], KINDS.index(s[0])))
    ends = [s[2] for s in ordered]
    total, choice = [0.0], []
    for i, span in enumerate(ordered):
        before = int(np.searchsorted(ends[:i], span[1], "right"))
        weight = span[3] * (span[2] - span[1])
        choice.append(before if total[before] + weight > total[i] else -1)
        total.append(max(total[i], total[before] + weight))
    out, i = [], len(ordered)
    while i:
        if choice[i - 1] >= 0:
            out.append(ordered[i - 1])
            i = choice[i - 1]
        else:
            i -= 1
    return out[::-1]


OTHER_IP = re.compile(r"[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){3}")
OTHER_CARD = re.compile(r"[0-9]+(?:[ ./-]{1,2}[0-9]+)+")
OTHER_PHONE = re.compile(r"\+?[0-9]*(?:[ ./-]?\([0-9]+\))?(?:[ ./-]{1,2}[0-9]+)+|00[0-9]+")


# What may follow an address that the network cut at a bracketed dot.
MORE = re.compile(r"(?:(?<=[)\]]) ?[A-Za-z0-9-]+)?(?: ?[(\[]dot[)\]] ?[A-Za-z0-9-]+)*")
OTHER = {"email": OTHER_EMAIL, "ip": OTHER_IP, "card": OTHER_CARD, "phone": OTHER_PHONE}


def exact_part(kind: str, piece: str) -> tuple[int, int] | None:
    """The exact check that follows the network: the longest part of a span (first of equals) that its kind allows."""
    found = max(OTHER[kind].finditer(piece), key=lambda m: m.end() - m.start(), default=None)
    if found is None or (kind == "ip" and any(int(p) > 255 for p in re.findall(r"[0-9]+", found.group()))):
        return None
    return found.span() if kind in ("email", "ip") or _valid(kind, found.group()) else None


def all_spans(tagger: Tagger, texts: list[str]) -> tuple[list[list], list[list]]:
    """(base spans, all spans) of each text; an added span never touches a base span."""
    base, full = [base_spans(t) for t in texts], []
    for text, own, more in zip(texts, base, tagger.added_spans(texts), strict=True):
        kept = list(own)
        for kind, a, b, score in more:
            if kind == "email":
                b = MORE.match(text, b).end()
            part = exact_part(kind, text[a:b]) if score >= SURE else None
            if part is None and kind == "card" and text[a:b].lstrip(" .").startswith("00") and score >= SURE:
                kind, part = "phone", exact_part("phone", text[a:b])
            if part is None:
                continue
            a, b = a + part[0], a + part[1]
            outside = (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())
            if outside and not any(s < b and a < e for _, s, e in own):
                kept.append((kind, a, b))
        full.append(sorted(kept, key=lambda s: (s[1], KINDS.index(s[0]))))
    return base, full


# ---- training

def _digits(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _word(rng, low: int, high: int) -> str:
    return "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(low, high + 1)))


def made_span(kind: str, rng) -> str:
    """A made span of one kind in one of its layouts, base ones among them."""
    pick = lambda *options: options[rng.integers(len(options))]
    if kind == "email":
        parts = [_word(rng, 1, 24 if rng.random() < 0.2 else 9) for _ in range(rng.integers(1, 4))]
        name = pick(".", "_", "-", "").join(parts) + pick("", "", _digits(rng, rng.integers(1, 5)))
        name = pick(name, name, name.title(), name.upper())
        domain = [_word(rng, 2, 12) for _ in range(rng.integers(1, 3))] + [pick("com", "org", "net", "de", "fr", "es", "example", _word(rng, 2, 4))]
        at, dot = pick(("@", "."), (" @ ", "."), (" @", "."), ("(at)", "."), ("[at]", "."), (" [at] ", "."), (" (at) ", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" @ ", " . "))
        return name + at + dot.join(domain)
    if kind == "ip":
        return pick(".", " . ", ". ", " .").join(str(n) for n in rng.integers(0, 256, 4))
    if kind == "card":
        body = str(rng.integers(2, 7)) + _digits(rng, pick(13, 14, 14, 14, 14, 14, 14, 14, 14, 14, 14, 17, 10))
        whole = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        groups = [whole[i : i + 4] for i in range(0, len(whole), 4)] if len(whole) != 15 else [whole[:4], whole[4:10], whole[10:]]
        return pick("", " ", "-", ".", "/", "  ", ". ").join(groups)
    code, area, head, tail = str(rng.integers(1, 100)), str(rng.integers(200, 1000)), _digits(rng, 3), _digits(rng, 4)
    local = pick("-", ".", " ", "/").join
    return pick(
        f"+{code} ({area}) {head}-{tail}", f"+{code}{pick(' ', '-', '.')}{local([area, head, tail])}", f"({area}) {head}-{tail}", f"({area}) {head} {tail}",
        local([area, head, tail]), f"00{code}{area}{head}{tail}", f"00{code} {local([area, head, tail])}", f"+{code}/{area}/{head}{tail}", f"+{code}/{area}/{head}/{tail}",
    )


def made_other(rng) -> str:
    """Something with digits or an ``at`` that is no personal data."""
    pick = lambda *options: options[rng.integers(len(options))]
    year, month, day = str(rng.integers(1900, 2100)), f"{rng.integers(1, 13):02}", f"{rng.integers(1, 32):02}"
    return pick(
        pick("-", "/", ".").join([year, month, day]), pick("-", "/", ".").join([day, month, year]), f"{year}-{month}-{day} {day}:{month}", f"{rng.integers(0, 24)}:{day}",
        f"{rng.integers(1, 20)}.{rng.integers(0, 30)}", f"v{rng.integers(1, 20)}.{rng.integers(0, 30)}.{rng.integers(0, 30)}", f"{rng.integers(1, 1000)},{_digits(rng, 3)}.{_digits(rng, 2)}",
        _digits(rng, rng.integers(1, 8)), bytes(rng.integers(0, 256, 16, dtype=np.uint8)).hex(), f"{_word(rng, 3, 9)} @ {rng.integers(1, 99)}", f"@{_word(rng, 3, 12)}",
        f"{_word(rng, 1, 5)}{_digits(rng, 3)}", f"{rng.integers(1, 99)}-{rng.integers(1, 99)}", f"{_digits(rng, 2)}. {_digits(rng, 1)}. {_digits(rng, 1)}",
    )


def made_windows(contexts: list[str], count: int = MADE, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """``count`` windows: a made span, or something else, between two words of a context without triggers."""
    rng, out = np.random.default_rng(seed), []
    for n in range(count if contexts else 0):
        context = contexts[rng.integers(len(contexts))]
        kind = KINDS[n % 5] if n % 5 < 4 else None
        piece = made_span(kind, rng) if kind else made_other(rng)
        gaps = [m.end() for m in re.finditer(r"\s", context)] or [0]
        before, after = context[: gaps[rng.integers(len(gaps))]], context[gaps[rng.integers(len(gaps))] :]
        # Some windows begin or end inside the span, as those that cut a text do.
        before = before[max(0, len(before) - int(rng.integers(0, WINDOW - 10))) :]
        close = ("", ".", ",", ";", ")")[rng.integers(5)] if rng.random() < 0.4 else ""
        text = (before + piece + close + " " + after)[:WINDOW]
        end = min(len(before) + len(piece), WINDOW)
        out.append((text, [(kind, len(before), end)] if kind and end > len(before) else []))
    return out


def training_windows(text: str, limit: int = PER_DOC) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Up to ``limit`` windows of one text around its triggers, and one without, at places spread over all of it."""
    spans = base_spans(text)
    digest = int.from_bytes(hashlib.sha256(text.encode("utf-8", "replace")).digest()[:8], "big")
    marks = [a for _, a, _ in spans] or [m.start() for m in TRIGGER.finditer(text)]
    step = max(1, len(marks) // limit)
    out = []
    for n, a in enumerate(marks[digest % step :: step][:limit]):
        lo = max(0, a - (digest >> (8 * n)) % (REACH + 1))
        hi = lo + WINDOW
        cut = any(s < hi and e > lo and not (s >= lo and e <= hi) for _, s, e in spans)
        inside = [(k, s - lo, e - lo) for k, s, e in spans if s >= lo and e <= hi]
        # Long numbers that fail a check look like those that pass: they teach nothing.
        unsure = any(not any(s <= lo + m.start() < e for _, s, e in spans) for m in LONG_NUMBER.finditer(text[lo:hi]))
        if not cut and not unsure:
            out.append((text[lo:hi], _no_overlap(inside)))
    lo = digest % max(1, len(text) - WINDOW)
    if text[lo : lo + WINDOW].strip() and not TRIGGER.search(text[lo : lo + WINDOW]):
        out.append((text[lo : lo + WINDOW], []))
    return out


def _no_overlap(spans):
    out = []
    for s in spans:
        if not out or s[1] >= out[-1][2]:
            out.append(s)
    return out


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Tagger:
    """A tagger trained on ``MADE`` made windows and on windows of at most ``2 * sample_docs`` documents.

    Half of the documents hold a trigger, half may be any; they are chosen by hash of the id, and at most
    ``PER_DOC + 1`` windows of ``WINDOW`` characters of each go to the driver.
    """
    source = whole_texts(docs)
    known = source.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).groupBy("doc_id").agg(F.max(F.col("text").rlike("[0-9@]")).alias("marked"))
    first = lambda rows: rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    ids = first(known.where("marked")).unionAll(first(known)).distinct()

    def cut(batches):
        for batch in batches:
            rows = [w for t in batch.column(0).to_pylist() for w in training_windows(t)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in rows], pa.string()), pa.array([";".join(f"{k}:{a}:{b}" for k, a, b in s) for _, s in rows], pa.string())],
                ["text", "spans"],
            )

    rows = source.join(F.broadcast(ids), "doc_id").select("text").mapInArrow(cut, "text string, spans string").collect()
    examples = []
    for text, spans in sorted((r.text, r.spans) for r in rows):
        parts = [s.split(":") for s in spans.split(";") if s]
        examples.append((text, [(k, int(a), int(b)) for k, a, b in parts]))
    return Tagger().fit([*examples, *made_windows([t for t, _ in examples if not TRIGGER.search(t)])])


# ---- on tables

def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_spans(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end) of every whole text."""
    kind = "array<struct<kind:string,start:bigint,stop:bigint>>"
    row = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
    source = whole_texts(docs)
    key = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in text_slices(texts):
                sides = [[[dict(zip(("kind", "start", "stop"), s, strict=True)) for s in spans] for spans in side] for side in all_spans(tagger, texts[a:b])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(x, row) for x in sides)], ["doc_id", "base", "spans"])

    return source.mapInArrow(run, f"doc_id {key}, base {kind}, spans {kind}")


def mask(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets; ``n_chars`` follows where it is a column."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        values = ["" if t is None else t for t in texts]
        out = []
        for a, b in text_slices(values):
            for text, spans in zip(values[a:b], all_spans(tagger, values[a:b])[1], strict=True):
                out.append(_masked(text, spans))
        return pd.Series([None if t is None else x for t, x in zip(texts, out, strict=True)], dtype=object)

    out = docs.withColumn("text", masked("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _masked(text: str, spans) -> str:
    if not spans:
        return text
    # Overlapping spans become one gap named after the first.
    gaps = []
    for kind, a, b in spans:
        if gaps and a < gaps[-1][2]:
            gaps[-1] = (gaps[-1][0], gaps[-1][1], max(b, gaps[-1][2]))
        else:
            gaps.append((kind, a, b))
    out, at = [], 0
    for kind, a, b in gaps:
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tagger = train(docs)

    def make():
        def run(texts):
            base, full = all_spans(tagger, texts)
            counts = [[sum(s[0] == kind for s in spans) for spans in base] for kind in KINDS]
            added = [len(f) - len(b) for b, f in zip(base, full, strict=True)]
            return [*counts, [hashlib.sha256(joined(s).encode()).hexdigest() for s in base], [joined(s) for s in full], added]

        return run

    fields = ", ".join(f"n_{k} bigint" for k in KINDS)
    return map_texts(docs, make, f"{fields}, base_sha256 string, spans string, n_added bigint")
