"""Personal data: exact patterns, and a character-level bidirectional LSTM with CRF transitions.

The patterns (``base_spans``) give every plain e-mail address, IPv4 address, card number and international phone number.
The tagger adds what is written otherwise: "ann at mail dot example dot org", "10[.]0[.]2[.]9", "4111.1111.1111.1111",
"(017) 555-7713". It is trained in numpy from labelled spans (``fit``): gradients of the CRF's likelihood through both
LSTMs, by Adam. Texts are cut into windows of WINDOW characters, one every STRIDE; each is decoded by Viterbi, spans that
a window's edge cuts are left to the neighbour, and of all windows' spans of a document the set without overlaps and with
the greatest summed log odds is taken (weighted interval scheduling over the whole text). A span of the tagger has to fit
the kind it is given (``fitted``: digits, checksum, marks for "at" and "dot"; too long a span is trimmed) and to keep off the patterns' spans; it is
WINDOW - STRIDE characters long at most. Every valid span holds one of the marks of ``ANCHOR``, so windows without any are
not decoded: they can give nothing.

Training runs in one task over a bounded sample: TRAIN_WINDOWS windows at most. Only the weights come to the driver.

Defined results: a null or empty text has no spans; positions are code points, ends exclusive; equal texts get equal
spans; rows alike stay; without labelled spans the tagger is not used; an empty table gives an empty result; further
columns are kept and may have any name, those named as a new column get the prefix docs_.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, in_slices, stored

#: In the order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, HIDDEN, BATCH = 128, 80, 20, 512
TRAIN_ROWS, TRAIN_WINDOWS, EPOCHS = 3_000, 3_000, 10
TAGS = 1 + 2 * len(KINDS)  # 0 outside; 1 + 2k begins kind k; 2 + 2k goes on

# --- the patterns -------------------------------------------------------------------------

_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    doubled = sum(int(c) * 2 - 9 * (c > "4") for c in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def _digits(text: str) -> str:
    return "".join(_NUMBER.findall(text))


def _small(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all matches of the plain patterns, leftmost and without overlaps within a kind, in time linear
    in the text: an address is found from its @, and dotted numbers are cut into fours."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        left = at
        while left > free and text[left - 1] in _LEFT:
            left -= 1
        host = _HOST.match(text, at + 1) if left < at else None
        if host:
            found.append(("email", left, host.end()))
        free = host.end() if host else at + 1
        at = text.find("@", free)
    if not _NUMBER.search(text):
        return found
    for m in _DOTTED.finditer(text):
        if text.count(".", m.start(), m.end()) >= 3:
            parts = [(n.start(), n.end()) for n in _NUMBER.finditer(text, m.start(), m.end())]
            for i in range(0, len(parts) - 3, 4):
                if all(_small(text[a:b]) for a, b in parts[i : i + 4]):
                    found.append(("ip", parts[i][0], parts[i + 3][1]))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _digits(m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


_AT = r"(?:\s?[\[({]\s?(?:at|@)\s?[\])}]\s?|\s(?:at|@)\s|@)"
_DOT = r"(?:\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?|\sdot\s|\.)"
_SPELT = re.compile(rf"[a-z0-9._%+-]+{_AT}[a-z0-9-]+(?:{_DOT}[a-z0-9-]+)*{_DOT}[a-z]{{2,}}", re.I | re.A)
_SPELT_IP = re.compile(r"[0-9]+(?:\s?[\[({]?\s?(?:\.|dot)\s?[\])}]?\s?[0-9]+){3}", re.I | re.A)
_GROUPED = re.compile(r"[0-9]{4,6}(?:[./_ -]{1,2}[0-9]{2,6})+")
_LOCAL_PHONE = re.compile(r"(?:[0-9]{1,4}[ .-]?)?\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}[0-9]{2,8})+")
#: What every span that ``valid`` accepts holds, one of: an @, a mark for "at" (the bare word only before a host), a digit with
#: another one after a separator.
ANCHOR = re.compile(rf"@|[\[({{]\s?at\s?[\])}}]|\sat\s(?=[a-z0-9-]+{_DOT}[a-z0-9])|[0-9](?=(?:[^a-z0-9]|dot){{1,8}}[0-9])", re.I | re.A)


_FORMS = {"email": _SPELT, "ip": _SPELT_IP, "card": _GROUPED, "phone": _LOCAL_PHONE}


def valid(kind: str, text: str) -> bool:
    """Whether a piece of text can be of its kind."""
    digits = _digits(text)
    right = {"email": True, "ip": all(_small(p) for p in _NUMBER.findall(text)), "card": 12 <= len(digits) <= 19 and luhn(digits or "1"), "phone": 9 <= len(digits) <= 15}
    return right[kind] and _FORMS[kind].fullmatch(text) is not None


def fitted(kind: str, text: str) -> tuple[int, int] | None:
    """Start and end of what is valid in a tagged piece of text, which may be some characters too long."""
    m = _FORMS[kind].search(text)
    return m.span() if m and 2 * len(m.group()) > len(text) and valid(kind, m.group()) else None


# --- the tagger ---------------------------------------------------------------------------


def _character_table() -> np.ndarray:
    """Ids of code points below 128 and of all others together: letters without case, one for all digits, one for all
    white space, each mark its own."""
    names = [chr(c).lower() if chr(c).isalpha() else "0" if chr(c).isdigit() else " " if chr(c).isspace() or c < 32 or c == 127 else chr(c) for c in range(128)] + ["other"]
    ids = {n: i for i, n in enumerate(sorted(set(names)))}
    return np.array([ids[n] for n in names], np.int64)


CHARACTERS = _character_table()
VOCABULARY = int(CHARACTERS.max()) + 1


def encode(windows: list[str]) -> np.ndarray:
    """Character ids [WINDOW, windows]; shorter windows end in white space."""
    points = np.frombuffer("".join(w.ljust(WINDOW, "\n") for w in windows).encode("utf-32-le", "surrogatepass"), np.uint32)
    return CHARACTERS[np.minimum(points, 128)].reshape(len(windows), WINDOW).T


def allowed() -> np.ndarray:
    """Scores that forbid a kind to go on after anything but its own begin or middle."""
    out = np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(KINDS)):
        out[:, 2 + 2 * k] = -1e4
        out[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0.0
    return out


ALLOWED = allowed()
_HALVES = np.repeat(np.array([0.5, 0.5, 0.5, 1.0], np.float32), HIDDEN)  # input, forget and output gates by tanh of the half


def new_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    def normal(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    table = normal(2, VOCABULARY, 4 * HIDDEN, scale=0.3)
    table[:, :, HIDDEN : 2 * HIDDEN] += 1.0  # remembers to begin with
    return {"table": table, "back": normal(2, HIDDEN, 4 * HIDDEN, scale=HIDDEN**-0.5), "out": normal(2 * HIDDEN, TAGS, scale=0.2), "bias": np.zeros(TAGS, np.float32), "moves": np.zeros((TAGS, TAGS), np.float32)}


def _lstm(w: dict, x: np.ndarray, keep: bool = False):
    """States [steps, 2, windows, HIDDEN] of both directions, the second running backwards; with keep also gates and cells."""
    steps, n = x.shape
    h, c = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
    states, gates, cells = np.empty((steps, 2, n, HIDDEN), np.float32), [], []
    for t in range(steps):
        z = np.matmul(h, w["back"])
        z[0] += w["table"][0][x[t]]
        z[1] += w["table"][1][x[steps - 1 - t]]
        z *= _HALVES
        np.tanh(z, out=z)
        z[:, :, : 3 * HIDDEN] *= 0.5
        z[:, :, : 3 * HIDDEN] += 0.5
        i, f, o, g = (z[:, :, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
        c = f * c + i * g
        h = o * np.tanh(c)
        states[t] = h
        if keep:
            gates.append(z)
            cells.append(c)
    return states, gates, cells


def emissions(w: dict, x: np.ndarray, states: np.ndarray | None = None) -> np.ndarray:
    """Scores [steps, windows, TAGS]."""
    states = _lstm(w, x)[0] if states is None else states
    return states[:, 0] @ w["out"][:HIDDEN] + states[::-1, 1] @ w["out"][HIDDEN:] + w["bias"]


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def gradients(w: dict, x: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
    """Negative log likelihood of the tags [steps, windows] for each window, and its gradients."""
    steps, n = x.shape
    states, gates, cells = _lstm(w, x, keep=True)
    e, move = emissions(w, x, states), w["moves"] + ALLOWED
    ahead, behind = np.empty_like(e), np.zeros_like(e)
    ahead[0] = e[0]
    for t in range(1, steps):
        ahead[t] = e[t] + _logsumexp(ahead[t - 1][:, :, None] + move, 1)
    for t in range(steps - 2, -1, -1):
        behind[t] = _logsumexp((e[t + 1] + behind[t + 1])[:, None, :] + move, 2)
    total = _logsumexp(ahead[-1], 1)
    one = np.eye(TAGS, dtype=np.float32)[tags]
    pair = np.exp(ahead[:-1][..., None] + move + (e[1:] + behind[1:])[:, :, None, :] - total[None, :, None, None])
    seen = np.zeros((TAGS, TAGS), np.float32)
    np.add.at(seen, (tags[:-1], tags[1:]), 1.0)
    truth = (e * one).sum() + (move * seen).sum()
    d_move = (pair.sum((0, 1)) - seen) / n
    d_e = (np.exp(ahead + behind - total[None, :, None]) - one) / n
    grads = {"moves": np.where(ALLOWED < 0, 0.0, d_move).astype(np.float32), "bias": d_e.sum((0, 1))}
    forward, backward = states[:, 0].reshape(-1, HIDDEN), states[::-1, 1].reshape(-1, HIDDEN)
    flat = d_e.reshape(-1, TAGS)
    grads["out"] = np.concatenate([forward.T @ flat, backward.T @ flat])
    d_states = np.stack([d_e @ w["out"][:HIDDEN].T, (d_e @ w["out"][HIDDEN:].T)[::-1]], 1)
    through = np.empty((steps, 2, n, 4 * HIDDEN), np.float32)
    dh, dc = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
    back = w["back"].transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        z, c = gates[t], cells[t]
        i, f, o, g = (z[:, :, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
        bent = np.tanh(c)
        dh = dh + d_states[t]
        dc = dc + dh * o * (1 - bent * bent)
        before = cells[t - 1] if t else np.zeros_like(c)
        through[t] = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * bent * o * (1 - o), dc * i * (1 - g * g)], 2)
        dh, dc = np.matmul(through[t], back), dc * f
    seen_by, ids = np.eye(VOCABULARY, dtype=np.float32), (x, x[::-1])
    grads["table"] = np.stack([seen_by[ids[way].ravel()].T @ through[:, way].reshape(-1, 4 * HIDDEN) for way in (0, 1)])
    grads["back"] = np.stack([states[:-1, way].reshape(-1, HIDDEN).T @ through[1:, way].reshape(-1, 4 * HIDDEN) for way in (0, 1)])
    return float((total.sum() - truth) / n), grads


def train(x: np.ndarray, tags: np.ndarray, epochs: int = EPOCHS, batch: int = 60, rate: float = 0.02, seed: int = 3) -> dict[str, np.ndarray]:
    """Weights fitted to windows x and their tags [WINDOW, windows] by Adam, the rate falling to a tenth."""
    rng = np.random.default_rng(seed)
    w = new_weights(rng)
    m, v, step, n = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0, x.shape[1]
    steps = max(1, epochs * -(-n // batch))
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            take = order[at : at + batch]
            _, g = gradients(w, x[:, take], tags[:, take])
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            step += 1
            for k, a in g.items():
                a = a * min(1.0, 5.0 / (norm + 1e-9))
                m[k] += 0.1 * (a - m[k])
                v[k] += 0.01 * (a * a - v[k])
                w[k] -= (rate * (1 - 0.9 * step / steps) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return w


def viterbi(e: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best tags [steps, windows]."""
    steps, n, _ = e.shape
    came, score = np.empty((steps, n, TAGS), np.int8), e[0]
    for t in range(1, steps):
        step = score[:, :, None] + move
        came[t] = step.argmax(1)
        score = step.max(1) + e[t]
    tags = np.empty((steps, n), np.int64)
    tags[-1] = score.argmax(1)
    rows = np.arange(n)
    for t in range(steps - 1, 0, -1):
        tags[t - 1] = came[t][rows, tags[t]]
    return tags


def decode(w: dict, windows: list[str]) -> list[list[tuple[int, int, int, float]]]:
    """For each window its spans (kind's number, start, end, log odds against being outside)."""
    e, move = emissions(w, encode(windows)), w["moves"] + ALLOWED
    tags, out = viterbi(e, move), [[] for _ in windows]
    for r in np.flatnonzero(tags.any(0)):
        path, length = tags[:, r], len(windows[r])
        begins = np.flatnonzero((path > 0) & ((path % 2 == 1) | (np.concatenate([[0], path[:-1]]) == 0)))
        for a in begins:
            kind, b = (int(path[a]) - 1) // 2, int(a) + 1
            while b < WINDOW and path[b] == 2 + 2 * kind:
                b += 1
            if b > length:  # white space beyond the text
                continue
            steps = np.array([*path[a - 1 : a], *path[a:b], *path[b : b + 1]])
            flat = np.array([*path[a - 1 : a], *[0] * (b - a), *path[b : b + 1]])
            odds = float((e[a:b, r][np.arange(b - a), path[a:b]] - e[a:b, r, 0]).sum() + move[steps[:-1], steps[1:]].sum() - move[flat[:-1], flat[1:]].sum())
            out[r].append((kind, int(a), b, odds))
    return out


def window_starts(text: str) -> list[int]:
    """Starts of the windows that hold what a valid span needs."""
    last, found = max(0, -(-(len(text) - WINDOW) // STRIDE)), []
    for m in ANCHOR.finditer(text):
        low, high = max(0, -(-(m.start() + 1 - WINDOW) // STRIDE)), min(last, (m.end() - 1) // STRIDE)
        found += range(max(low, found[-1] + 1) if found else low, high + 1)
    return [k * STRIDE for k in found]


def reconcile(spans: dict[tuple[int, int, int], float]) -> list[tuple[str, int, int, float]]:
    """Of spans (kind, start, end) with their summed log odds those without overlaps that have the greatest sum."""
    order = sorted((s for s in spans.items() if s[1] > 0), key=lambda s: (s[0][2], s[0][1], s[0][0]))
    ends, best = [s[0][2] for s in order], [(0.0, None)]
    for i, ((_, start, _), odds) in enumerate(order):
        before = int(np.searchsorted(ends[:i], start, side="right"))
        best.append(max((best[i][0], None), (best[before][0] + odds, before), key=lambda b: b[0]))
    chosen, i = [], len(order)
    while i:
        before = best[i][1]
        if before is None:
            i -= 1
        else:
            (kind, start, end), odds = order[i - 1]
            chosen.append((KINDS[kind], start, end, odds))
            i = before
    return chosen[::-1]


def tagged_spans(texts: list[str], w: dict | None) -> list[list[tuple[str, int, int, float]]]:
    """Of each text the tagger's spans, before they are held against the patterns'."""
    odds: list[dict] = [{} for _ in texts]

    def flush(todo: list[tuple[int, int]]) -> None:
        cut = [texts[d][s : s + WINDOW] for d, s in todo]
        for (d, s), window, found in zip(todo, cut, decode(w, cut)):
            for kind, a, b, score in found:
                whole = (a or not s) and (b < WINDOW or s + b == len(texts[d]))
                fit = fitted(KINDS[kind], window[a:b]) if whole else None
                if fit:
                    at = (kind, s + a + fit[0], s + a + fit[1])
                    odds[d][at] = odds[d].get(at, 0.0) + score

    todo: list[tuple[int, int]] = []
    for d, text in enumerate(texts if w is not None else ()):
        for s in window_starts(text):
            todo.append((d, s))
            if len(todo) == BATCH:
                flush(todo)
                todo = []
    if todo:
        flush(todo)
    return [reconcile(o) if o else [] for o in odds]


def all_spans(texts: list[str], w: dict | None) -> list[list[tuple[str, int, int, bool, float | None]]]:
    """(kind, start, end, base, log odds) of each text: the patterns' spans, and the tagger's that keep off them."""
    out = []
    for text, tagged in zip(texts, tagged_spans(texts, w)):
        base = base_spans(text)
        spans = [(k, a, b, True, None) for k, a, b in base]
        if tagged:
            taken = np.array([(a, b) for _, a, b in base]).reshape(-1, 2)
            spans += [(k, a, b, False, o) for k, a, b, o in tagged if not ((taken[:, 0] < b) & (taken[:, 1] > a)).any()]
            spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
        out.append(spans)
    return out


# --- labelled spans -----------------------------------------------------------------------


def _luhn_number(rng: random.Random, n: int) -> str:
    body = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(body + c for c in "0123456789" if luhn(body + c))


def example(kind: str, rng: random.Random) -> str:
    """One piece of personal data of that kind, plain or written otherwise."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("aeiou" if i % 2 else "bcdfghlmnprstvw") for i in range(rng.randrange(2, 9)))
    if kind == "email":
        at, dot = rng.choice([("@", "."), (" at ", " dot "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", " (dot) "), ("(at)", "."), ("[at]", "."), (" at ", "."), (" AT ", " DOT "), (" @ ", "."), ("{at}", "{dot}")])
        local = word() + rng.choice(["", "." + word(), digits(2), "_" + word(), "." + digits(2)])
        return local + at + dot.join([word() + rng.choice(["", digits(1)]) for _ in range(rng.randrange(1, 3))] + [rng.choice(["com", "org", "net", "de", "fr", "es", "io"])])
    if kind == "ip":
        return rng.choice([".", ".", "[.]", "(.)", " . ", "[dot]", " dot "]).join(str(rng.randrange(256)) for _ in range(4))
    if kind == "card":
        n, sep = rng.choice([16, 16, 16, 15, 13, 19]), rng.choice(["", "", " ", "-", ".", "/", "_", " - "])
        number = _luhn_number(rng, n)
        return sep.join(number[i : i + 4] for i in range(0, n, 4)) if n % 4 != 1 else sep.join([number[: n - n // 4 * 4 + 4], *(number[i : i + 4] for i in range(n - n // 4 * 4 + 4, n, 4))])
    a, b, c = digits(3), digits(3), digits(4)
    return rng.choice([f"+{rng.randrange(1, 99)} ({a}) {b}-{c}", f"+{rng.randrange(1, 99)} {a} {b} {c}", f"+{digits(2)}{a}{b}{c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{rng.randrange(1, 99)} {a} {b} {c}", f"0{digits(2)}/{digits(7)}", f"1-{a}-{b}-{c}"])


def decoy(rng: random.Random) -> str:
    """Something that only looks like personal data."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    return rng.choice([digits(rng.randrange(1, 6)), digits(rng.randrange(9, 24)), "20%s-%s-%s" % (digits(2), digits(2), digits(2)), f"{digits(2)}.{digits(2)}.20{digits(2)}", f"{digits(2)}:{digits(2)}:{digits(2)}", f"${digits(3)}.{digits(2)}", f"{digits(1)},{digits(3)},{digits(3)}", "v" + ".".join(digits(1) for _ in range(3)), "%x" % rng.getrandbits(160), f'token = "{rng.getrandbits(160):040x}"', f"id={digits(12)}", " at ", " at the dot ", f"@{digits(2)}", f"{digits(3)}-{digits(2)}", f"({digits(4)})", ".".join(str(rng.randrange(300, 999)) for _ in range(4)), " ".join(digits(5) for _ in range(3)), f"{digits(4)}/{digits(2)}"])


def labelled_examples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, seed: int = 17) -> DataFrame:
    """(order, text, spans): pieces of rows texts at most, chosen by the hash of their ids, with their patterns' spans, and with
    further data of each kind and decoys put in at known places. Stored."""
    texts = docs.where(F.octet_length(text_col) > 0).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    total = max(1, texts.count())
    pieces = F.sequence(F.lit(1), F.lit(min(200, -(-rows // total))))  # several of each text where there are few
    order = F.xxhash64(F.lit(seed), "id", F.crc32("text"), "piece")
    texts = texts.withColumn("piece", F.explode(pieces)).withColumn("order", order).where(F.pmod("order", F.lit(1_000_000)) < int(min(1.0, 1.2 * rows / total) * 1_000_000) + 1)
    start = F.pmod(F.xxhash64("order"), F.greatest(F.lit(1), F.length("text") - WINDOW)).cast("int") + 1
    picked = texts.select("order", F.substring(F.col("text"), start, F.lit(WINDOW + 40)).alias("text")).orderBy("order", "text").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for order, text in zip(batch.column("order").to_pylist(), batch.column("text").to_pylist()):
                rng = random.Random(order)
                parts, known, length = [], [], 0
                cuts = sorted(rng.randrange(len(text) + 1) for _ in range(rng.randrange(0, 4)))
                for a, b in zip([0, *cuts], [*cuts, None]):
                    parts.append(text[a:b])
                    if b is None:
                        break
                    length += b - a
                    kind = rng.choice([*KINDS, *KINDS, "email", None, None, None])
                    put = decoy(rng) if kind is None else example(kind, rng)
                    put = rng.choice([" ", " ", " ", ": ", "\n", " <", " tel ", ", "]), put, rng.choice([" ", " ", ". ", ", ", "\n", "; ", ") "])
                    if kind is not None:
                        known.append((kind, length + len(put[0]), length + len(put[0]) + len(put[1])))
                    parts.append("".join(put))
                    length += len(parts[-1])
                whole = "".join(parts)
                spans = known + [s for s in base_spans(whole) if not any(s[1] < b and s[2] > a for _, a, b in known)]
                made.append((order, whole, [{"kind": k, "start": a, "end": b} for k, a, b in sorted(spans, key=lambda s: s[1])]))
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made]), pa.array([m[2] for m in made], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))], ["order", "text", "spans"])

    return stored(picked.mapInArrow(run, "order long, text string, spans array<struct<kind: string, start: int, end: int>>"), "pii-examples")


def training_windows(rows: list[tuple[str, list[tuple[str, int, int]]]], most: int = TRAIN_WINDOWS) -> tuple[np.ndarray, np.ndarray]:
    """Character ids and tags of a window from each labelled text, placed so that some spans are cut by its edges."""
    rng, windows, tags = random.Random(23), [], []
    for text, spans in rows[:most]:
        at = rng.randrange(max(1, len(text) - WINDOW + 1)) if rng.random() < 0.7 else 0
        t = np.zeros(len(text), np.int64)
        for kind, a, b in spans:
            t[a:b] = 2 + 2 * KINDS.index(kind)
            t[a] -= 1
        end = at + (WINDOW if rng.random() < 0.7 else rng.randrange(24, WINDOW))  # texts end within windows too
        windows.append(text[at:end])
        tags.append(np.pad(t[at:end], (0, WINDOW - len(windows[-1]))))
    return encode(windows), np.stack(tags, 1)


def fit(labelled: DataFrame, epochs: int = EPOCHS) -> dict[str, np.ndarray] | None:
    """The tagger's weights from (order, text, spans array<struct<kind, start, end>>): in one task over TRAIN_WINDOWS windows
    at most, the first by order. None without rows."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("order", "ascending"), ("text", "ascending")]).slice(0, TRAIN_WINDOWS)
        examples = [(t, [(s["kind"], s["start"], s["end"]) for s in spans or ()]) for t, spans in zip(rows.column("text").to_pylist(), rows.column("spans").to_pylist()) if t]
        w = train(*training_windows(examples), epochs=epochs) if examples else {}
        return pa.table({"name": pa.array(list(w), pa.string()), "shape": pa.array([list(a.shape) for a in w.values()], pa.list_(pa.int32())), "data": pa.array([a.astype(np.float32).tobytes() for a in w.values()], pa.binary())})

    bounded = labelled.orderBy("order", "text").limit(TRAIN_WINDOWS).withColumn("one", F.lit(0))
    weights = stored(bounded.groupBy("one").applyInArrow(run, "name string, shape array<int>, data binary"), "pii-weights").collect()  # five rows
    return {r["name"]: np.frombuffer(r["data"], np.float32).reshape(r["shape"]) for r in weights} or None


# --- whole tables -------------------------------------------------------------------------

_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("odds", pa.float64())]))


def find(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """docs with pii, an array of (kind, start, end, base, odds): base spans are the patterns', the others the tagger's."""
    docs, text_col = _renamed(docs, "pii", text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some 20,000 floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, text_col):
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            found = [[{"kind": k, "start": a, "end": b, "base": base, "odds": o} for k, a, b, base, o in spans] for spans in all_spans(texts, shared.value)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _SPANS)], [*batch.schema.names, "pii"])

    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType()), T.StructField("odds", T.DoubleType())]))
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("pii", kind)]))


def _renamed(docs: DataFrame, new: str, text_col: str) -> tuple[DataFrame, str]:
    other = free_name(docs, new, "docs_")
    return docs.withColumnRenamed(new, other), other if text_col == new else text_col


def redact(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """docs with redacted: the text with each span, or run of spans that overlap, as the first one's kind in brackets; null
    stays null."""
    docs, text_col = _renamed(docs, "redacted", text_col)
    found = find(docs, model, text_col)

    def step(acc, s):
        put = F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, (s["start"] - acc["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(s["start"] >= acc["at"], F.struct(put.alias("out"), s["end"].cast("int").alias("at"))).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"].cast("int")).alias("at")))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    whole = F.aggregate("pii", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, F.length(text_col))))
    return found.withColumn("redacted", whole).drop("pii")


def listed(spans) -> "F.Column":
    """kind:start:end of an array of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row; the counts are of the patterns' spans."""
    found = find(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model)
    base = F.filter("pii", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter("pii", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select(F.col("id").alias(id_col), *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))
