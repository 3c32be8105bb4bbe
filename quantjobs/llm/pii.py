"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions in numpy.

The tagger is trained on windows whose spans the base patterns label, from a bounded sample of
documents, as they stand and spelled anew: "at" for "@", "[.]" for ".", other separators of digits. So it
learns to find what the patterns miss. At decoding every window of every text is computed. Windows overlap;
each character takes its tag from the window in which it lies closest to the middle, and spans are then read
from the tags of the whole text, so that a span may cross windows. A tagged span counts if it holds a valid
item of its kind once it is spelled as usual: an address, four numbers up to 255, a number that passes Luhn,
9 to 15 digits.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantjobs.llm.common import load, small_batches, span_string, with_columns_of, without

KINDS = ["email", "ip", "card", "phone"]
# The base patterns, each written so that it scans any text in linear time.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@]")
#: Characters of a window and between windows, in decoding and in training; documents and windows to train on, at most.
WINDOW, STRIDE, TRAIN_WINDOW, TRAIN_DOCS, TRAIN_WINDOWS, EPOCHS = 256, 224, 64, 20_000, 4_000, 8
HIDDEN, EMBED, TAGS, LEAST_STEPS = 10, 8, 9, 600
#: One in so many texts gives a window without a span to train on; texts with spans are spelled anew so many times.
PLAIN, VARIANTS = 8, 3
SIGNS = "@.-+() \n_%:/,;='\"\t[]"
CLASSES = 5 + len(SIGNS) + 26
# Usual ways to write around "@", "." and the separators of digits.
SPELLED_AT, SPELLED_DOT = (" at ", " (at) ", "[at]", " [at] ", " @ "), (" dot ", "(dot)", "[dot]", " [.] ", "[.]")
ENDINGS = ("com", "org", "net", "edu", "io", "de", "co.uk")
SPELLED_SEPARATOR = (".", " . ", "/", "_", "--", "  ")
AT, DOT = re.compile(r"\s*[\[(]\s*at\s*[\])]\s*|\s+at\s+|\s+@\s+", re.I), re.compile(r"\s*[\[(]\s*(?:dot|\.)\s*[\])]\s*|\s+dot\s+|\s+\.\s+", re.I)
ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank, end) of the base kinds, leftmost non-overlapping per kind; matches that fail are dropped."""
    out, last = [], 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, 0, m.end()))
            last = m.end()
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = [int(c) for c in m[0] if c not in " -"]
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return out


def luhn(digits: list[int]) -> bool:
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits))) % 10 == 0


def valid(kind: int, text: str) -> bool:
    """Whether a tagged span holds an item of its kind once it is spelled as usual."""
    if kind == 0:
        return len(text) < 400 and ADDRESS.fullmatch(AT.sub("@", DOT.sub(".", text))) is not None
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == 1:
        parts = DOT.sub(".", text).split(".")
        return len(parts) == 4 and all(x.isascii() and x.isdigit() and len(x) <= 3 and int(x) <= 255 for x in parts)
    if any(c.isalpha() for c in text):
        return False
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15 and text.lstrip("(")[0] in "+0"


def respelled(text: str, spans: list[tuple[int, int, int]], rng) -> tuple[str, list[tuple[int, int, int]]]:
    """A text whose spans are written another way, and where they are now; of overlapping spans the first stays."""
    out, at, size, found = [], 0, 0, []
    for start, kind, end in sorted(spans):
        if start < at:
            continue
        x = text[start:end]
        if kind == 0:
            name, _, host = x.partition("@")
            if rng.random() < 0.5:  # other names and hosts than the tables' own
                draw = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 10)))
                name, host = draw(), f"{draw()}.{ENDINGS[rng.integers(len(ENDINGS))]}"
            dot = SPELLED_DOT[rng.integers(len(SPELLED_DOT))] if rng.random() < 0.7 else "."
            x = name + SPELLED_AT[rng.integers(len(SPELLED_AT))] + host.replace(".", dot)
        elif kind == 1:
            x = x.replace(".", SPELLED_DOT[rng.integers(len(SPELLED_DOT))])
        else:
            digits = "".join(c for c in x if c.isdigit())
            own = SPELLED_SEPARATOR[rng.integers(len(SPELLED_SEPARATOR))]
            sizes = [4] * (len(digits) // 4) + [len(digits) % 4] * (len(digits) % 4 > 0) if kind == 2 else [max(1, len(digits) - 10), 3, 3, 4]
            cuts = np.cumsum([0, *sizes])
            groups = [digits[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            x = own.join(groups) if kind == 2 else "00" + own.join(groups)
        out += [text[at:start], x]
        size += start - at
        found.append((size, kind, size + len(x)))
        at, size = end, size + len(x)
    return "".join([*out, text[at:]]), found


def char_classes(text: str) -> np.ndarray:
    """A small class number for each character, letters without case; 0 is padding."""
    table = np.full(128, 1, dtype=np.int8)
    table[48:58] = 2
    for k, c in enumerate(SIGNS):
        table[ord(c)] = 5 + k
    table[65:91] = table[97:123] = 5 + len(SIGNS) + np.arange(26)
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(cp < 128, table[np.minimum(cp, 127)], np.where(cp < 592, 3, 4)).astype(np.int8)


def window_starts(n: int) -> np.ndarray:
    """Starts of the windows that cover n characters."""
    return np.arange(0, max(n - (WINDOW - STRIDE), 1), STRIDE)


def cut(classes: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    padded = np.concatenate([classes, np.zeros(window, dtype=np.int8)])
    return padded[starts[:, None] + np.arange(window)]


def squash(x: np.ndarray, spare: np.ndarray | None = None) -> np.ndarray:
    """x (27 + x x) / (27 + 9 x x) between -3 and 3, within 0.024 of tanh and in half its time; writes over x."""
    np.clip(x, np.float32(-3), np.float32(3), out=x)
    s = np.multiply(x, x, out=spare)
    s += 3
    np.divide(np.float32(24 / 9), s, out=s)
    s += np.float32(1 / 9)
    x *= s
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (squash(0.5 * x) + 1)


def lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, keep: bool = False):
    """Hidden states (T, B, H) of inputs (T, B, D); with ``keep`` also what the backward pass needs."""
    t_max, n, h_dim = len(x), x.shape[1], len(wh)
    pre = x @ wx + b
    h, c = np.zeros((n, h_dim), x.dtype), np.zeros((n, h_dim), x.dtype)
    out, cache = np.empty((t_max, n, h_dim), x.dtype), []
    for t in range(t_max):
        z = pre[t] + h @ wh
        gates = sigmoid(z[:, : 3 * h_dim])
        i, f, o, g = gates[:, :h_dim], gates[:, h_dim : 2 * h_dim], gates[:, 2 * h_dim :], squash(z[:, 3 * h_dim :].copy())
        c_new = f * c + i * g
        tc = squash(c_new.copy())
        if keep:
            cache.append((i, f, o, g, c, tc, h))
        c, h = c_new, o * tc
        out[t] = h
    return out, cache


def lstm_back(d_out: np.ndarray, x: np.ndarray, wx: np.ndarray, wh: np.ndarray, cache: list):
    """Gradients of the inputs and the three weights."""
    dz_all, dwh = np.empty((len(x), x.shape[1], wh.shape[1]), x.dtype), np.zeros_like(wh)
    dh, dc = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
    for t in range(len(x) - 1, -1, -1):
        i, f, o, g, c, tc, h = cache[t]
        dh = dh + d_out[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dz_all[t] = dz
        dwh += h.T @ dz
        dh, dc = dz @ wh.T, dc * f
    flat = dz_all.reshape(-1, dz_all.shape[2])
    return dz_all @ wx.T, x.reshape(-1, x.shape[2]).T @ flat, dwh, flat.sum(0)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def crf_gradient(e: np.ndarray, trans: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the negative log likelihood of tags y (T, B) with emissions e (T, B, K)."""
    t_max, n, k = e.shape
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for t in range(1, t_max):
        alpha[t] = e[t] + log_sum(alpha[t - 1][:, :, None] + trans, 1)
    for t in range(t_max - 2, -1, -1):
        beta[t] = log_sum(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    z = log_sum(alpha[-1], 1)
    de = np.exp(alpha + beta - z[:, None])
    de[np.arange(t_max)[:, None], np.arange(n), y] -= 1
    pair = np.exp(alpha[:-1, :, :, None] + trans + (e[1:] + beta[1:])[:, :, None, :] - z[:, None, None]).sum((0, 1))
    np.subtract.at(pair, (y[:-1].ravel(), y[1:].ravel()), 1)
    return de, pair


def allowed() -> np.ndarray:
    """0 where a tag may follow another, else a large penalty; tags: 0 outside, 1 + 2k begin, 2 + 2k inside."""
    out = np.zeros((TAGS, TAGS), dtype=np.float32)
    for b in range(2, TAGS, 2):
        out[:, b] = -1e4
        out[[b - 1, b], b] = 0
    return out


class Tagger:
    """Embedding, two LSTMs and CRF transitions."""

    def __init__(self, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"emb": draw(CLASSES, EMBED), "out": draw(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
        for side in "fb":
            self.p |= {f"wx{side}": draw(EMBED, 4 * HIDDEN), f"wh{side}": draw(HIDDEN, 4 * HIDDEN), f"b{side}": np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)].astype(np.float32)}

    def emissions(self, windows: np.ndarray, keep: bool = False):
        p = self.p
        x = p["emb"][windows.T]
        fwd, cf = lstm(x, p["wxf"], p["whf"], p["bf"], keep)
        bwd, cb = lstm(x[::-1], p["wxb"], p["whb"], p["bb"], keep)
        h = np.concatenate([fwd, bwd[::-1]], axis=2)
        return h @ p["out"] + p["bias"], (x, h, cf, cb)

    def gradients(self, windows: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        e, (x, h, cf, cb) = self.emissions(windows, True)
        de, g = crf_gradient(e, p["trans"], tags.T)
        flat = de.reshape(-1, TAGS)
        dh = de @ p["out"].T
        dxf, wxf, whf, bf = lstm_back(dh[:, :, :HIDDEN], x, p["wxf"], p["whf"], cf)
        dxb, wxb, whb, bb = lstm_back(dh[::-1, :, HIDDEN:], x[::-1], p["wxb"], p["whb"], cb)
        emb = np.zeros_like(p["emb"])
        np.add.at(emb, windows.T, dxf + dxb[::-1])
        return {"emb": emb, "out": h.reshape(-1, 2 * HIDDEN).T @ flat, "bias": flat.sum(0), "trans": g, "wxf": wxf, "whf": whf, "bf": bf, "wxb": wxb, "whb": whb, "bb": bb}

    def fit(self, windows: np.ndarray, tags: np.ndarray, epochs: int = EPOCHS, batch: int = 50, rate: float = 0.01, seed: int = 5) -> Tagger:
        """Adam over shuffled batches; small samples get more epochs, so that there are LEAST_STEPS at least."""
        epochs = max(epochs, -(-LEAST_STEPS * batch // len(windows)))
        rng, m, v, step = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                own, step = order[at : at + batch], step + 1
                for k, g in self.gradients(windows[own], tags[own]).items():
                    g = np.clip(g / len(own), -1, 1)
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def states(self, windows: np.ndarray, side: str) -> np.ndarray:
        """Hidden states (T, H, B), doubled, of one direction; the inputs' share of the gates is looked up by class.

        As sigmoid(z) is (tanh(z / 2) + 1) / 2, one pass serves all gates; gates lie in rows, so that each is contiguous.
        """
        p = self.p
        table, wh = p["emb"] @ p[f"wx{side}"] + p[f"b{side}"], 0.5 * p[f"wh{side}"].T  # states are doubled
        table[:, : 3 * HIDDEN] *= 0.5
        wh[: 3 * HIDDEN] *= 0.5
        table, n = np.ascontiguousarray(table.T), len(windows)
        steps = np.ascontiguousarray(windows.T).astype(np.intp)
        c = np.zeros((HIDDEN, n), np.float32)
        out = np.empty((len(steps), HIDDEN, n), np.float32)
        z, x, ig, h = np.empty((4 * HIDDEN, n), np.float32), np.empty((4 * HIDDEN, n), np.float32), np.empty_like(c), np.zeros_like(c)
        i, f, o, g = (z[k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
        for t in range(len(steps)) if side == "f" else range(len(steps) - 1, -1, -1):
            np.matmul(wh, h, out=z)
            np.take(table, steps[t], axis=1, out=x, mode="clip")
            z += x
            squash(z, x)
            np.multiply(i, g, out=ig)
            ig += g
            f += 1
            c *= f
            c += ig
            c *= 0.5
            h = out[t]
            h[:] = c
            squash(h, ig)
            o += 1
            h *= o
        return out

    def decode(self, windows: np.ndarray) -> np.ndarray:
        """Best tags (B, T) by Viterbi. Windows in which no way in and out of a span can pay are all outside."""
        p = self.p
        e = np.matmul(0.5 * p["out"][:HIDDEN].T, self.states(windows, "f"))
        e += np.matmul(0.5 * p["out"][HIDDEN:].T, self.states(windows, "b"))
        e += p["bias"][:, None]  # (T, tags, B)
        trans = p["trans"] + allowed()
        # What a span gains over staying outside, at most: its tags, and the ways in, on and out; at a window's ends it needs no way in or out.
        enter, on, leave = (np.float32(x.max() - trans[0, 0]) for x in (trans[0, 1:], trans[1:, 1:], trans[1:, 0]))
        gain = e[:, 1:].max(1) - e[:, 0]
        run = gain[0].copy()
        most = run + leave
        for step in gain[1:]:
            run += on
            np.maximum(run, enter, out=run)
            run += step
            np.maximum(most, run + leave, out=most)
        open_ = np.flatnonzero(np.maximum(most, run) >= -1e-3)
        out = np.zeros(windows.shape, dtype=np.int8)
        if len(open_):
            out[open_] = self.viterbi(np.ascontiguousarray(e[:, :, open_].transpose(0, 2, 1)), trans)
        return out

    @staticmethod
    def viterbi(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
        t_max, n, _ = e.shape
        best = e[0].copy()
        back = np.empty(e.shape, dtype=np.int8)
        for t in range(1, t_max):
            paths = best[:, :, None] + trans
            back[t] = paths.argmax(1)
            best = np.take_along_axis(paths, back[t][:, None, :].astype(np.int64), 1)[:, 0] + e[t]
        out = np.empty((n, t_max), dtype=np.int8)
        out[:, -1] = best.argmax(1)
        for t in range(t_max - 1, 0, -1):
            out[:, t - 1] = back[t][np.arange(n), out[:, t]]
        return out


def tags_of(n: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Tags of a text of n characters; of spans that overlap, the first listed wins."""
    out = np.zeros(n, dtype=np.int8)
    for start, rank, end in sorted(spans, key=lambda s: (s[1], s[0])):
        if not out[start:end].any():
            out[start:end] = 2 + 2 * rank
            out[start] = 1 + 2 * rank
    return out


def spans_of(tags: np.ndarray, text: str) -> list[tuple[int, int, int]]:
    """Valid spans of a whole text's reconciled tags, without white space and closing marks at their ends."""
    if not tags.any():
        return []
    kind = (tags.astype(np.int32) + 1) // 2
    edges = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | ((tags[1:] % 2 == 1) & (tags[1:] > 0))])
    out = []
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(tags)], strict=True):
        if kind[a]:
            x = text[a:b]
            start = a + len(x) - len(x.lstrip())
            end = start + len(x.strip().rstrip(".,;:!?\"'"))
            if end > start and valid(int(kind[a]) - 1, text[start:end]):
                out.append((start, int(kind[a]) - 1, end))
    return out


def reconciled(n: int, starts: np.ndarray, decoded: np.ndarray) -> np.ndarray:
    """Tags of a whole text from its decoded windows: the window in whose middle a character lies decides."""
    tags, closest = np.zeros(n, dtype=np.int8), np.full(n, WINDOW, dtype=np.int16)
    off = np.abs(np.arange(WINDOW) - (WINDOW - 1) / 2).astype(np.int16)
    for s, row in zip(starts, decoded, strict=True):
        m = min(WINDOW, n - s)
        better = off[:m] < closest[s : s + m]
        tags[s : s + m][better] = row[:m][better]
        closest[s : s + m][better] = off[:m][better]
    return tags


def train(docs: DataFrame, text: str = "text", train_docs: int = TRAIN_DOCS, train_windows: int = TRAIN_WINDOWS) -> Tagger:
    """A tagger fitted on at most ``train_windows`` windows of a hash sample of about ``train_docs`` texts.

    Windows begin shortly before a span, of the text as it is and spelled anew; some hold no span.

    Without any window the tagger tags nothing that its initial weights don't, and is not fitted.
    """
    small_batches(docs.sparkSession)
    total = docs.count()
    share = int(2**30 * min(1.0, train_docs / max(total, 1)))
    sample = docs.select(F.col(text).alias("text")).where("text is not null").where(F.pmod(F.xxhash64("text"), F.lit(2**30)) < share)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in pdf["text"]:
                rng = np.random.default_rng(zlib.crc32(t.encode("utf-8", "surrogatepass")))
                spans = base_spans(t) if MARK.search(t) else []
                for text, own in [(t, spans), *[respelled(t, spans, rng) for _ in range(VARIANTS)]] if spans else [(t, [])] * (rng.random() < 1 / PLAIN):
                    c, tags = char_classes(text), tags_of(len(text), own)
                    at = [max(0, a - int(rng.integers(0, TRAIN_WINDOW // 2))) for a, _, _ in own] or [int(rng.integers(0, max(1, len(text) - TRAIN_WINDOW)))]
                    starts = np.unique(np.array(at))
                    x, y = cut(c, starts, TRAIN_WINDOW), cut(tags, starts, TRAIN_WINDOW)
                    yield pd.DataFrame({"x": [r.tobytes() for r in x], "y": [r.tobytes() for r in y]})

    rows = sample.mapInPandas(run, "x binary, y binary").distinct()
    some = rows.orderBy(F.xxhash64("x", "y"), "x", "y").limit(train_windows).toPandas()
    if not len(some):
        return Tagger()
    x, y = (np.stack([np.frombuffer(b, dtype=np.int8) for b in some[c]]) for c in "xy")
    return Tagger().fit(x.astype(np.int64), y.astype(np.int64))


def find(docs: DataFrame, tagger: Tagger, out: str = "spans", text: str = "text") -> DataFrame:
    """Adds the spans (start, rank, end, base) of every whole text: base ones, and tagged ones beside them.

    Null and empty texts have no spans; repeated rows give equal rows; other columns are kept,
    but for one named ``out``, which is replaced.
    """
    small_batches(docs.sparkSession)
    docs = without(docs, out)
    shipped = docs.sparkSession.sparkContext.broadcast(tagger)
    schema = with_columns_of(docs, f"`{out}` array<struct<start:int,rank:int,end:int,base:boolean>>")
    at = docs.columns.index(text)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def tagged(model: Tagger, texts: list[str]) -> Iterator[list[tuple[int, int, int]]]:
        """Spans of each text; windows are decoded 1024 at a time, whatever texts they belong to."""
        classes = [char_classes(t) for t in texts]
        starts = [window_starts(len(t)) for t in texts]
        rows = np.concatenate([cut(c, s) for c, s in zip(classes, starts, strict=True)])
        decoded = np.concatenate([model.decode(rows[i : i + 1024]) for i in range(0, len(rows), 1024)])
        ends = np.cumsum([len(s) for s in starts])
        for t, s, e in zip(texts, starts, ends, strict=True):
            own = decoded[e - len(s) : e]
            yield spans_of(reconciled(len(t), s, own), t) if own.any() else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            spans: list[list[dict]] = [[] for _ in texts]
            held = [i for i, t in enumerate(texts) if t]
            for i, more in zip(held, tagged(model, [texts[i] for i in held]) if held else (), strict=True):
                base = base_spans(texts[i]) if MARK.search(texts[i]) else []
                taken = np.zeros(len(texts[i]) if more else 0, dtype=bool)
                for a, _, b in base if more else ():
                    taken[a:b] = True
                spans[i] = [{"start": a, "rank": k, "end": b, "base": True} for a, k, b in base]
                spans[i] += [{"start": a, "rank": k, "end": b, "base": False} for a, k, b in more if not taken[a:b].any()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 10 over the whole documents table."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, train(docs)).select("doc_id", "spans", F.filter("spans", lambda s: s["base"]).alias("base"))
    ranks = F.transform("base", lambda s: s["rank"])
    counted = [(F.size("base") - F.size(F.array_remove(ranks, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counted, F.sha2(span_string("base", KINDS), 256).alias("base_sha256"), span_string("spans", KINDS).alias("spans"))
