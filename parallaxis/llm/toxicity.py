"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is the embedding of the word itself and the mean embedding of its character n-grams, both
hashed; so words that weren't learned are known by their characters. Windows of WINDOW words every STRIDE words
cover the whole text; in each a GRU runs forward and backward, attention weights the states, and their sum gives the
window's logit. The largest logit, the mean of the windows' chances and the number of windows give the
document's score through a logistic regression.

Only documents carry labels, so training takes those windows of toxic documents as toxic whose words' counts
speak for it, then those that the network finds so itself (at least one a document); all windows of the whole text of
each document are looked at. It learns from at most about SAMPLE documents of each label (clean, toxic), fewer if they are
long: their texts have at most SAMPLE_CHARS characters together, and documents are taken in the order of a hash of their
doc_id as long as they fit. A quarter of them is kept for the logistic regression. The model is a few MB whatever the
input. Scoring reads nothing but the text, and whole texts of any length, in runs of words.

Null and empty texts score 0, as do texts without words. Without labels of both kinds every score is 0. Labels or
documents without a doc_id aren't learned from. Of documents that share a doc_id the smallest text is learned from, and a
doc_id is toxic if any of its labels is. Repeated rows each get their row, an empty table gives an empty result, other
columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Carried, discard, give_back, pick, resident, text_batches, written
from .language import remainder

WINDOW, STRIDE = 32, 16
WORD_ROWS, CHAR_ROWS = 1 << 14, 1 << 17
WORD_DIM = CHAR_DIM = HIDDEN = 8
ORDERS = (3, 5, 7)
SAMPLE = (3_000, 1_500)
#: For clean and for toxic documents.
SAMPLE_CHARS = (16_000_000, 8_000_000)
#: Words whose projected inputs a worker keeps; words and windows that are worked on at once.
MEMO_WORDS, FLUSH_WORDS, RUN_WINDOWS = 80_000, 60_000, 1_024
THRESHOLD = 0.7

_PUNCTUATION = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words in UTF-8; ASCII characters that are neither letters nor digits stand between words."""
    return (text or "").lower().encode().translate(_PUNCTUATION).split()


def hashed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For distinct words: their rows of the word table, and n-gram rows with the word each belongs to."""
    marked = b"".join(b"\x01" + w + b"\x02" for w in words)
    raw = np.frombuffer(marked, dtype=np.uint8).astype(np.uint32)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    owner = np.repeat(np.arange(len(words)), lengths)
    # a polynomial hash of every run of n bytes, kept where the run lies within one word
    rows, owners, h = [], [], np.zeros(len(raw), dtype=np.uint32)
    for n in range(1, max(ORDERS) + 1):
        m = len(raw) - n + 1
        if m <= 0:
            break
        h = (h[:m] * np.uint32(0x01000193)) ^ (raw[n - 1 :] + np.uint32(1))
        if n in ORDERS:
            inside = owner[:m] == owner[n - 1 :]
            x = h[inside] * np.uint32(0x9E3779B1) + np.uint32(n)
            rows.append(((x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> np.uint32(15))
            owners.append(owner[:m][inside])
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(raw)) - np.repeat(starts, lengths)
    whole = np.add.reduceat((raw + np.uint32(7)) * _powers(int(lengths.max()))[place], starts, dtype=np.uint32) if len(words) else np.empty(0, np.uint32)
    whole = (whole ^ (whole >> np.uint32(13))) * np.uint32(0xC2B2AE3D)
    return (whole >> np.uint32(18)).astype(np.int64), np.concatenate(rows).astype(np.int64), np.concatenate(owners)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, 0x01000193, dtype=np.uint32)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def init(seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    d, h = WORD_DIM + CHAR_DIM, HIDDEN
    p = {"word": rng.normal(0, 0.05, (WORD_ROWS, WORD_DIM)), "char": rng.normal(0, 0.05, (CHAR_ROWS, CHAR_DIM))}
    for side in "fb":
        p |= {f"wx{side}": rng.normal(0, 0.35, (d, 3 * h)), f"b{side}": np.zeros(3 * h), f"uzr{side}": rng.normal(0, 0.2, (h, 2 * h)), f"uh{side}": rng.normal(0, 0.2, (h, h))}
    p |= {"att": rng.normal(0, 0.3, 2 * h), "out": rng.normal(0, 0.3, 2 * h), "bias": np.zeros(1)}
    return {k: v.astype(np.float32) for k, v in p.items()}


def inputs(p: dict, rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The input vectors of words with these rows, as hashed() gives them, and how many n-grams each has."""
    word_row, gram_row, owner = rows
    count = np.maximum(np.bincount(owner, minlength=len(word_row)), 1).astype(np.float32)
    chars = np.empty((len(word_row), CHAR_DIM), dtype=np.float32)
    grams = p["char"][gram_row]
    for j in range(CHAR_DIM):
        chars[:, j] = np.bincount(owner, weights=grams[:, j], minlength=len(word_row)) / count
    return np.concatenate([p["word"][word_row], chars], axis=1), count


def gru(x: np.ndarray, mask: np.ndarray | None, uzr: np.ndarray, uh: np.ndarray, order: range, keep: list | None) -> np.ndarray:
    """States for each step of x (time, batch, 3 * HIDDEN projected inputs), in the given order of time."""
    h = np.zeros((x.shape[1], HIDDEN), dtype=np.float32)
    states = np.empty((*x.shape[:2], HIDDEN), dtype=np.float32)
    for t in order:
        zr = x[t, :, : 2 * HIDDEN] + h @ uzr
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(x[t, :, 2 * HIDDEN :] + (r * h) @ uh)
        new = h + z * (c - h)
        if mask is not None:
            new = np.where(mask[t][:, None], new, h)
        if keep is not None:
            keep.append((t, h, z, r, c))
        h = states[t] = new
    return states


def pooled(p: dict, states: np.ndarray, mask: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(logits, attention weights (time, batch), context) of states (time, batch, 2 * HIDDEN)."""
    a = states @ p["att"]
    if mask is not None:
        a = np.where(mask, a, -1e9)
    a = np.exp(a - a.max(axis=0))
    a /= a.sum(axis=0)
    context = np.einsum("tb,tbh->bh", a, states)
    return context @ p["out"] + p["bias"][0], a, context


def loss_and_gradient(p: dict, rows: tuple, at: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Cross-entropy of windows at (time, batch; places among the words that rows are of) and its gradient, by back-propagation through time."""
    (word_row, gram_row, owner), (x, count) = rows, inputs(p, rows)
    n_time, n_batch = at.shape
    g = {}
    kept: dict[str, list] = {"f": [], "b": []}
    states = {}
    for side in "fb":
        steps = range(n_time) if side == "f" else range(n_time - 1, -1, -1)
        projected = (x @ p[f"wx{side}"] + p[f"b{side}"])[at]
        states[side] = gru(projected, mask, p[f"uzr{side}"], p[f"uh{side}"], steps, kept[side])
    s = np.concatenate([states["f"], states["b"]], axis=2)
    logit, a, context = pooled(p, s, mask)
    chance = sigmoid(logit)
    loss = float(-np.mean(y * np.log(chance + 1e-7) + (1 - y) * np.log(1 - chance + 1e-7)))
    d = ((chance - y) / n_batch).astype(np.float32)
    g["bias"], g["out"] = np.array([d.sum()]), context.T @ d
    d_context = d[:, None] * p["out"]
    d_a = np.einsum("bh,tbh->tb", d_context, s)
    d_score = a * (d_a - (a * d_a).sum(axis=0))
    g["att"] = np.einsum("tb,tbh->h", d_score, s)
    d_s = a[:, :, None] * d_context[None] + d_score[:, :, None] * p["att"]
    d_in = np.zeros_like(x)
    flat = at.ravel()
    by = np.argsort(flat, kind="stable")
    used, first = np.unique(flat[by], return_index=True)
    for side, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
        uzr, uh = p[f"uzr{side}"], p[f"uh{side}"]
        g_zr, g_h = np.zeros_like(uzr), np.zeros_like(uh)
        d_x = np.empty((n_time, n_batch, 3 * HIDDEN), dtype=np.float32)
        back = np.zeros((n_batch, HIDDEN), dtype=np.float32)
        for t, h, z, r, c in reversed(kept[side]):
            total = back + d_s[t, :, part]
            own = total * mask[t][:, None]
            back = (total - own) + own * (1 - z)
            d_c = own * z * (1 - c * c)
            g_h += (r * h).T @ d_c
            d_rh = d_c @ uh.T
            back += d_rh * r
            d_zr = np.concatenate([own * (c - h) * z * (1 - z), d_rh * h * r * (1 - r)], axis=1)
            g_zr += h.T @ d_zr
            back += d_zr @ uzr.T
            d_x[t] = np.concatenate([d_zr, d_c], axis=1)
        d_word = np.zeros((len(x), 3 * HIDDEN), dtype=np.float32)
        d_word[used] = np.add.reduceat(d_x.reshape(-1, 3 * HIDDEN)[by], first)
        g |= {f"uzr{side}": g_zr, f"uh{side}": g_h, f"b{side}": d_word.sum(axis=0), f"wx{side}": x.T @ d_word}
        d_in += d_word @ p[f"wx{side}"].T
    g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
    np.add.at(g["word"], word_row, d_in[:, :WORD_DIM])
    np.add.at(g["char"], gram_row, (d_in[:, WORD_DIM:] / count[:, None])[owner])
    return loss, g


class Adam:
    def __init__(self, p: dict, rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, g: dict, decay: float = 1e-5) -> None:
        self.t += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, x in self.p.items():
            d = g[k]
            self.m[k] += 0.1 * (d - self.m[k])
            self.v[k] += 0.001 * (d * d - self.v[k])
            embedding = k in ("word", "char")
            x -= rate * (0.1 if embedding else 1.0) * self.m[k] / (np.sqrt(self.v[k]) + 1e-7)
            if embedding:
                x *= 1 - decay


def window_starts(words: int) -> np.ndarray:
    """Where the windows of so many words start; together they cover all."""
    starts = np.arange(0, max(words - WINDOW, 0) + 1, STRIDE)
    return starts if starts[-1] + WINDOW >= words else np.append(starts, words - WINDOW)


class Corpus:
    """Documents to learn from: all their words as numbers, one document after the other, and all their windows."""

    def __init__(self, documents: Iterator[tuple[int, list[bytes]]]):
        number: dict[bytes, int] = {}
        toxic, flat = [], []
        for y, words in documents:
            if words:
                toxic.append(y)
                flat.append(np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int32, count=len(words)))
        self.toxic, self.length = np.array(toxic, dtype=np.int64), np.array([len(f) for f in flat], dtype=np.int64)
        self.flat = np.concatenate(flat) if flat else np.empty(0, np.int32)
        self.first = np.cumsum(self.length) - self.length
        starts = [window_starts(n) for n in self.length]
        self.document = np.repeat(np.arange(len(flat)), [len(x) for x in starts])
        self.start = np.concatenate(starts) if starts else np.empty(0, np.int64)
        self._hash(list(number))

    def _hash(self, words: list[bytes]) -> None:
        word_row, gram_row, count = [np.empty(0, np.int32)], [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for at in range(0, len(words), 20_000):
            w, g, owner = hashed(part := words[at : at + 20_000])
            word_row.append(w.astype(np.int32))
            gram_row.append(g[np.argsort(owner, kind="stable")].astype(np.int32))
            count.append(np.bincount(owner, minlength=len(part)))
        self.word_row, self.gram_row, self.grams = map(np.concatenate, (word_row, gram_row, count))
        self.gram_first = np.cumsum(self.grams) - self.grams

    def rows(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As hashed(), for words by number."""
        n = self.grams[words]
        places = np.repeat(self.gram_first[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.word_row[words], self.gram_row[places], np.repeat(np.arange(len(words)), n)

    def words(self, document: int) -> np.ndarray:
        return self.flat[self.first[document] : self.first[document] + self.length[document]]

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of windows by number: distinct words, their places (time, batch) among these, and where there is a word."""
        document, place = self.document[which], self.start[which][None, :] + np.arange(WINDOW)[:, None]
        mask = place < self.length[document]
        found = self.flat[self.first[document] + np.where(mask, place, 0)]
        words, at = np.unique(found, return_inverse=True)
        return words, at.reshape(found.shape), mask


def start_from_counts(p: dict, corpus: Corpus, errors: float = 2.0) -> None:
    """Sets the first component of the embeddings to a log-odds: how many toxic documents have a row, against how many
    would have by their lengths if its words were dealt evenly, less the same of clean ones. It is drawn towards
    zero by so many standard errors, so training starts from what the counts make certain and from nothing else."""
    seen = {"word": np.zeros((2, WORD_ROWS)), "char": np.zeros((2, CHAR_ROWS))}
    for document, toxic in enumerate(corpus.toxic):
        word_row, gram_row, _ = corpus.rows(np.unique(corpus.words(document)))
        seen["word"][toxic, np.unique(word_row)] += 1
        seen["char"][toxic, np.unique(gram_row)] += 1
    times = np.bincount(corpus.flat, minlength=len(corpus.grams)).astype(float)
    all_times = {
        "word": np.bincount(corpus.word_row, weights=times, minlength=WORD_ROWS),
        "char": np.bincount(corpus.gram_row, weights=np.repeat(times, corpus.grams), minlength=CHAR_ROWS),
    }
    grid = np.linspace(-18, 0, 73)
    have = [np.array([-np.expm1(-np.exp(r) * corpus.length[corpus.toxic == y]).sum() for r in grid]) for y in (0, 1)]
    for kind, c in seen.items():
        rate = np.log(np.maximum(all_times[kind], 0.5) / max(1, len(corpus.flat)))
        due = [np.interp(rate, grid, h) for h in have]
        odds = np.log((c[1] + 0.5) / (due[1] + 0.5)) - np.log((c[0] + 0.5) / (due[0] + 0.5))
        error = np.sqrt(1 / (c[1] + 0.5) + 1 / (c[0] + 0.5))
        p[kind][:, 0] = np.clip(np.sign(odds) * np.maximum(0, np.abs(odds) - errors * error), -4, 4)


def train(corpus: Corpus, epochs: int = 7, batch: int = 256, per_epoch: int = 6_000, seed: int = 5) -> dict[str, np.ndarray]:
    """Parameters fitted to the windows of the corpus."""
    rng, p = np.random.default_rng(seed), init()
    start_from_counts(p, corpus)
    opt = Adam(p, 0.004)
    toxic = corpus.toxic[corpus.document] == 1
    negative, positive = np.flatnonzero(~toxic), np.flatnonzero(toxic)
    if not len(negative) or not len(positive):
        return p
    positive = _evident(p, corpus, positive)
    for epoch in range(epochs):
        if epoch in (3, 5):
            positive = _convincing(p, corpus, np.flatnonzero(toxic))
        half = min(per_epoch, max(len(negative), len(positive), 8 * batch))
        chosen = np.concatenate([rng.choice(negative, half), rng.choice(positive, half)])
        y = np.repeat(np.array([0, 1], dtype=np.float32), half)
        order = rng.permutation(2 * half)
        for at in range(0, 2 * half, batch):
            part = order[at : at + batch]
            words, index, mask = corpus.windows(chosen[part])
            # a word is now and then not seen, so that no single one is relied on
            seen = mask & (rng.random(mask.shape) > 0.1) | (mask.cumsum(axis=0) == 1) & mask
            opt.step(loss_and_gradient(p, corpus.rows(words), index, seen, y[part])[1])
        opt.rate *= 0.8
    return p


def _best_or(corpus: Corpus, which: np.ndarray, value: np.ndarray, least: float) -> np.ndarray:
    """Of these windows those with at least this value, and the best of each document."""
    top = np.full(len(corpus.toxic), -np.inf)
    np.maximum.at(top, corpus.document[which], value)
    return which[(value >= least) | (value == top[corpus.document[which]])]


def _evident(p: dict, corpus: Corpus, which: np.ndarray, least: float = 1.0) -> np.ndarray:
    """Windows with a word whose counts speak for it, or the ones nearest to that of their document."""
    best = []
    for at in range(0, len(which), RUN_WINDOWS):
        words, index, mask = corpus.windows(which[at : at + RUN_WINDOWS])
        x = inputs(p, corpus.rows(words))[0]
        best.append(np.where(mask, (x[:, 0] + x[:, WORD_DIM])[index], -9.0).max(axis=0))
    return _best_or(corpus, which, np.concatenate(best), least)


def _convincing(p: dict, corpus: Corpus, which: np.ndarray) -> np.ndarray:
    """Windows with a chance of half or more, or the best of their document."""
    scorer, logit = Scorer(p), []
    for at in range(0, len(which), RUN_WINDOWS):
        words, index, mask = corpus.windows(which[at : at + RUN_WINDOWS])
        scorer.table = scorer.projected(corpus.rows(words))
        logit.append(scorer.run(index, mask))
    return _best_or(corpus, which, np.concatenate(logit), 0.0)


class Scorer:
    """Scores windows with a bounded memo of words' projected inputs."""

    def __init__(self, p: dict):
        self.p = p
        self.weights = np.concatenate([p["wxf"], p["wxb"]], axis=1)
        self.biases = np.concatenate([p["bf"], p["bb"]])
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[bytes, int] = {b"": 0}
        self.table = np.zeros((4096, 6 * HIDDEN), dtype=np.float32)

    def projected(self, rows: tuple) -> np.ndarray:
        return inputs(self.p, rows)[0] @ self.weights + self.biases

    def places(self, words: list[bytes]) -> np.ndarray:
        """Rows of the table for words; rows of an earlier call may be gone."""
        new = set(words).difference(self.memo)
        if len(self.memo) + len(new) > MEMO_WORDS:
            self._forget()
            new = set(words)
        if new:
            fresh = list(new)
            first, need = len(self.memo), len(self.memo) + len(fresh)
            if need > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((max(need, 2 * len(self.table)) - len(self.table), self.table.shape[1]), dtype=np.float32)])
            for at in range(0, len(fresh), 20_000):
                part = fresh[at : at + 20_000]
                self.table[first + at : first + at + len(part)] = self.projected(hashed(part))
            self.memo.update(zip(fresh, range(first, need), strict=True))
        return np.fromiter(map(self.memo.__getitem__, words), dtype=np.int64, count=len(words))

    def run(self, at: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """Logits of windows at (time, batch; rows of the table)."""
        x = self.table[at]
        p, n = self.p, 3 * HIDDEN
        forward = gru(x[:, :, :n], mask, p["uzrf"], p["uhf"], range(WINDOW), None)
        backward = gru(x[:, :, n:], mask, p["uzrb"], p["uhb"], range(WINDOW - 1, -1, -1), None)
        return pooled(p, np.concatenate([forward, backward], axis=2), mask)[0]

    def windows(self, windows: list[list[bytes]]) -> np.ndarray:
        """Logits of windows that are given as words."""
        flat = self.places([w for ws in windows for w in (*ws, *[b""] * (WINDOW - len(ws)))]).reshape(-1, WINDOW).T
        mask = np.array([len(ws) for ws in windows])[None, :] > np.arange(WINDOW)[:, None]
        return self.run(flat, mask)

    def documents(self, texts: list[str | None]) -> np.ndarray:
        """For each text: largest logit, mean chance, windows, first word of the largest; zeros without words."""
        out = np.zeros((len(texts), 4))
        out[:, 0] = -np.inf
        held: list[tuple[int, int, list[bytes], np.ndarray]] = []
        n = 0

        def flush() -> None:
            nonlocal held, n
            at = self.places([w for _, _, words, _ in held for w in words])
            base, index, owner, first = 0, [], [], []
            for doc, offset, words, starts in held:
                index.append(base + starts)
                owner.append(np.full(len(starts), doc))
                first.append(offset + starts)
                base += len(words)
            index, owner, first = map(np.concatenate, (index, owner, first))
            for a in range(0, len(index), RUN_WINDOWS):
                rows = at[index[a : a + RUN_WINDOWS][None, :] + np.arange(WINDOW)[:, None]]
                logit = self.run(rows, rows != 0 if (rows == 0).any() else None)
                who, start = owner[a : a + RUN_WINDOWS], first[a : a + RUN_WINDOWS]
                out[:, 1] += np.bincount(who, weights=sigmoid(logit), minlength=len(out))
                out[:, 2] += np.bincount(who, minlength=len(out))
                by = np.lexsort((start, -logit, who))
                for i in by[np.unique(who[by], return_index=True)[1]]:
                    if logit[i] > out[who[i], 0]:
                        out[who[i], 0], out[who[i], 3] = logit[i], start[i]
            held, n = [], 0

        for doc, text in enumerate(texts):
            words = words_of(text)
            if not words:
                continue
            starts = window_starts(len(words))
            words += [b""] * (WINDOW - len(words))
            step = FLUSH_WORDS // STRIDE
            for a in range(0, len(starts), step):
                part = starts[a : a + step]
                held.append((doc, int(part[0]), words[part[0] : part[-1] + WINDOW], part - part[0]))
                n += len(held[-1][2])
                if n >= FLUSH_WORDS:
                    flush()
        if held:
            flush()
        out[:, 1] /= np.maximum(out[:, 2], 1)
        return out


@dataclass
class Model:
    parameters: dict[str, np.ndarray] | None
    #: Of the logistic regression: means, scales, weights and the constant.
    final: tuple[np.ndarray, np.ndarray, np.ndarray, float] | None = None
    #: What a worker keeps of this model is known by; no two fits share one.
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def score(self, found: np.ndarray) -> np.ndarray:
        known = found[:, 2] > 0
        if self.final is None:
            return np.zeros(len(found))
        mean, scale, weight, constant = self.final
        x = (features(np.where(known[:, None], found, 0)) - mean) / scale
        return np.where(known, sigmoid(x @ weight + constant), 0.0)


def features(found: np.ndarray) -> np.ndarray:
    return np.stack([np.clip(found[:, 0], -12, 12), found[:, 1], np.log1p(found[:, 2])], axis=1)


def fit_final(found: np.ndarray, y: np.ndarray, steps: int = 50, l2: float = 0.02) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Logistic regression by Newton's method, both labels weighing the same."""
    x = features(found)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w = np.zeros(x.shape[1])
    ridge = np.diag([l2 / 10] * 3 + [1e-6])
    for _ in range(steps):
        q = sigmoid(x @ w)
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + ridge
        w -= np.linalg.solve(h, x.T @ (weight * (q - y)) + ridge @ w)
    return mean, scale, w[:-1], float(w[-1])


def _fitting(sizes: list[tuple[int, int, int]], most: tuple[int, int]) -> list[int]:
    """The ids of (id, toxic, chars) that are taken, in order, as long as those of their label fit."""
    left, taken = list(most), []
    for i, toxic, chars in sizes:
        if chars <= left[toxic]:
            left[toxic] -= chars
            taken.append(i)
    return taken


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, sample: tuple[int, int] = SAMPLE, chars: tuple[int, int] = SAMPLE_CHARS) -> Model:
    """Learns from labelled documents outside the held-out fold."""
    spark = docs.sparkSession
    truth = pick(labels, "doc_id", "toxic").where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(remainder(F.col("doc_id"), folds) != held_out)
    truth = truth.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in truth.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Model(None)
    place = F.xxhash64(F.lit(9).cast("long"), "doc_id") / 2.0**64 + 0.5
    share = F.when(F.col("toxic") == 1, min(1.0, sample[1] / sizes[1])).otherwise(min(1.0, sample[0] / sizes[0]))
    # at most about two samples of ids are broadcast
    chosen = written(truth.where(place < share).limit(2 * sum(sample)).select(F.col("doc_id").alias("id"), "toxic"), "chosen")
    rows = pick(docs, "doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    rows = sample_rows = written(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).withColumn("place", place), "sample")
    found = rows.select("doc_id", "toxic", F.char_length("text").alias("chars"), "place").where("chars > 0").orderBy("place", "doc_id").collect()
    taken = spark.createDataFrame([(i,) for i in _fitting([(r["doc_id"], r["toxic"], r["chars"]) for r in found], chars)], "id long")
    rows = rows.join(F.broadcast(taken), F.col("doc_id") == F.col("id"), "left_semi")
    part = F.pmod(F.xxhash64(F.lit(10).cast("long"), "doc_id"), F.lit(4))
    got = rows.where(part != 0).select("doc_id", "toxic", "text").toArrow()  # at most the sample's characters
    by = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    corpus = Corpus((got["toxic"][i].as_py(), words_of(got["text"][i].as_py())) for i in by.tolist())
    del got
    if len(set(corpus.toxic.tolist())) < 2:
        discard(chosen, sample_rows)
        return Model(None)
    model = Model(train(corpus))
    del corpus
    give_back()
    scored = lambda some: [(r["largest"], r["mean"], r["windows"], r["toxic"]) for r in window_scores(some.select("doc_id", "text"), model).join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).where("windows > 0").orderBy("doc_id").collect()]
    stats = scored(rows.where(part == 0))
    if len({y for *_, y in stats}) < 2:  # too few to keep any from training
        stats = scored(rows)
    model.final = fit_final(np.array(stats, dtype=float), np.array([y for *_, y in stats], dtype=float))
    discard(chosen, sample_rows)
    return model


def _worker_scorer(sent) -> tuple[Model, Scorer]:
    model = sent.value
    return model, resident(("toxicity", model.key), lambda: Scorer(model.parameters))


def window_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, largest (logit of the most toxic window), mean (chance), windows, first_word of that window."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if sent.value.parameters is None:
                found, score = np.zeros((len(texts), 4)), np.zeros(len(texts))
            else:
                model, scorer = _worker_scorer(sent)
                found = scorer.documents(texts)
                score = model.score(found)
            found[:, 0] = np.where(np.isfinite(found[:, 0]), found[:, 0], 0)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(score), "largest": pa.array(found[:, 0]), "mean": pa.array(found[:, 1]), "windows": pa.array(found[:, 2].astype(np.int64)), "first_word": pa.array(found[:, 3].astype(np.int64))})

    return text_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, score double, largest double, mean double, windows long, first_word long")


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, windows, first_word of the most toxic window."""
    found = window_scores(pick(docs, "doc_id", "text"), fit(docs, labels, folds, held_out))
    out = F.coalesce(remainder(F.col("doc_id"), folds) == held_out, F.lit(False))
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "windows", "first_word")


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is below the threshold."""
    c, sent = Carried(docs), docs.sparkSession.sparkContext.broadcast(model)
    place = c.place("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.struct_field(batch.column(0), place).to_pylist()
            if sent.value.parameters is None:
                score = np.zeros(len(texts))
            else:
                model, scorer = _worker_scorer(sent)
                score = model.score(scorer.documents(texts))
            yield batch.filter(pa.array(score < threshold))

    return c.restored(text_batches(c.rows).mapInArrow(run, c.rows.schema))
