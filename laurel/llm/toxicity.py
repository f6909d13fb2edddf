"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A text is cut into overlapping windows of words. A word enters by a hashed word embedding and by
the mean of hashed embeddings of its character trigrams. Two gated recurrent passes read a
window, attention pools their states, and one number comes out; a text's score is the calibrated
score of its strongest window, so one bad passage in a long text is enough.

The network is trained on at most ``POSITIVES + NEGATIVES`` labelled documents (chosen by a hash
of the id) with all of their windows; it has a fixed size and is shipped to the tasks. Scoring reads every window of every text, inside the scan, without a shuffle.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, STRIDE = 48, 32
HIDDEN, EMBED, ATTEND = 8, 8, 8
WORD_ROWS = TRIGRAM_ROWS = 1 << 13
#: labelled documents used for training, of either kind
POSITIVES, NEGATIVES = 1500, 3000
THRESHOLD = 0.3
#: letters stay, other ASCII characters part words
LETTERS = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))


def cut(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(LETTERS).split()


class Words:
    """Numbers the words of some texts and describes each distinct one by table rows."""

    def __init__(self) -> None:
        self.ids: defaultdict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.ids[b""]  # number 0 is padding

    def number(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word rows, trigram rows of all words one after another, and where each word starts."""
        words = list(self.ids)
        word = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % WORD_ROWS
        joined = np.frombuffer(b"".join(b"<" + w + b">#" for w in words), np.uint8).astype(np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        code = joined[:-2] * 40503 ^ joined[1:-1] * 2654435 ^ joined[2:] * 97531
        starts = np.concatenate([[0], np.cumsum(lengths + 3)])[:-1]
        # each word has len(w) trigrams of "<w>", at least one (its "<>#" if empty)
        count = np.maximum(lengths, 1)
        first = np.concatenate([[0], np.cumsum(count)])[:-1]
        at = np.arange(count.sum()) + np.repeat(starts - first, count)
        return word.astype(np.int64), ((code ^ code >> 7) % TRIGRAM_ROWS)[at].astype(np.int64), first


def windows(numbers: np.ndarray) -> np.ndarray:
    """(n, WINDOW) word numbers of the overlapping windows of one text, padded with 0."""
    n = max(1, -(-(len(numbers) - (WINDOW - STRIDE)) // STRIDE))
    padded = np.zeros((n - 1) * STRIDE + WINDOW, np.int32)
    padded[:len(numbers)] = numbers
    starts = np.arange(n) * STRIDE
    return padded[starts[:, None] + np.arange(WINDOW)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Weights and passes; float32 arrays in ``w``."""

    def __init__(self, seed: int = 6) -> None:
        rng = np.random.default_rng(seed)
        shape = {
            "word": (WORD_ROWS, EMBED), "gram": (TRIGRAM_ROWS, EMBED),
            "att": (2 * HIDDEN, ATTEND), "att_b": (ATTEND,), "att_v": (ATTEND,),
            "out": (2 * HIDDEN,), "out_b": (1,),
        }
        for d in "fb":
            shape |= {f"in_{d}": (2 * EMBED, 3 * HIDDEN), f"rec_{d}": (HIDDEN, 3 * HIDDEN),
                      f"bias_{d}": (3 * HIDDEN,)}
        self.w = {k: (rng.standard_normal(s) * (0.1 if k in ("word", "gram") else 0.3))
                  .astype(np.float32) * (len(s) > 1 or k in ("out", "att_v"))
                  for k, s in shape.items()}
        self.scale, self.shift = 1.0, 0.0

    def embed(self, rows) -> np.ndarray:
        word, gram, first = rows
        ends = np.append(first[1:], len(gram))
        out = np.empty((len(word), 2 * EMBED), np.float32)
        out[:, :EMBED] = self.w["word"][word]
        for at in range(0, len(word), 1 << 15):
            to = min(at + (1 << 15), len(word))
            part = self.w["gram"][gram[first[at]:ends[to - 1]]]
            out[at:to, EMBED:] = np.add.reduceat(part, first[at:to] - first[at], axis=0)
        out[:, EMBED:] /= (ends - first)[:, None]
        return out

    def _run(self, d: str, inputs: np.ndarray, ids: np.ndarray, keep: list | None) -> np.ndarray:
        """States (T, n, HIDDEN) of one direction; padding leaves the state as it is."""
        n, steps = ids.shape
        h = np.zeros((n, HIDDEN), np.float32)
        states = np.empty((steps, n, HIDDEN), np.float32)
        rec, H = self.w[f"rec_{d}"], HIDDEN
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            col = ids[:, t]
            g, r = inputs[col], h @ rec
            zr = _sigmoid(g[:, :2 * H] + r[:, :2 * H])
            z = zr[:, :H] + (col == 0)[:, None]
            np.minimum(z, 1, out=z)
            c = np.tanh(g[:, 2 * H:] + zr[:, H:] * r[:, 2 * H:])
            if keep is not None:
                keep.append((t, h, zr, z, c, r[:, 2 * H:]))
            h = c + z * (h - c)
            states[t] = h
        return states

    def forward(self, x: np.ndarray, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        w = self.w
        trail = {d: None if keep is None else [] for d in "fb"}
        s = np.concatenate([
            self._run(d, x @ w[f"in_{d}"] + w[f"bias_{d}"], ids, trail[d]) for d in "fb"
        ], axis=2)
        u = np.tanh(s @ w["att"] + w["att_b"])
        e = u @ w["att_v"] + np.where(ids.T == 0, np.float32(-30), np.float32(0))
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = (a[:, :, None] * s).sum(0)
        if keep is not None:
            keep.update(trail=trail, s=s, u=u, a=a, pooled=pooled)
        return pooled @ w["out"] + w["out_b"]

    def gradients(self, rows, ids: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
        """Log loss of windows and its gradients by backpropagation through time."""
        w, k, H = self.w, {}, HIDDEN
        x = self.embed(rows)
        logit = self.forward(x, ids, k)
        p = _sigmoid(logit)
        loss = float(-np.mean(np.log(np.where(labels > 0, p, 1 - p) + 1e-7)))
        dl = ((p - labels) / len(labels)).astype(np.float32)
        g = {"out": k["pooled"].T @ dl, "out_b": dl.sum(keepdims=True)}
        dpool = dl[:, None] * w["out"]
        da = (k["s"] * dpool).sum(2)
        ds = k["a"][:, :, None] * dpool
        de = k["a"] * (da - (k["a"] * da).sum(0))
        du = de[:, :, None] * w["att_v"] * (1 - k["u"] ** 2)
        g["att_v"] = (k["u"] * de[:, :, None]).sum((0, 1))
        g["att"], g["att_b"] = np.tensordot(k["s"], du, ((0, 1), (0, 1))), du.sum((0, 1))
        ds = ds + du @ w["att"].T
        dx = np.zeros_like(x)
        for d, part in (("f", ds[:, :, :H]), ("b", ds[:, :, H:])):
            rec, dh = w[f"rec_{d}"], np.zeros((len(ids), H), np.float32)
            drec, din = np.zeros_like(rec), np.zeros((len(x), 3 * H), np.float32)
            for t, before, zr, z, c, rn in reversed(k["trail"][d]):
                dh = dh + part[t]
                dc = dh * (1 - z) * (1 - c**2)
                dz = dh * (before - c) * zr[:, :H] * (1 - zr[:, :H]) * (ids[:, t] != 0)[:, None]
                dr = dc * rn * zr[:, H:] * (1 - zr[:, H:])
                gate = np.concatenate([dz, dr, dc], axis=1)
                back = np.concatenate([dz, dr, dc * zr[:, H:]], axis=1)
                drec += before.T @ back
                np.add.at(din, ids[:, t], gate)
                dh = dh * z + back @ rec.T
            g[f"rec_{d}"], g[f"bias_{d}"], g[f"in_{d}"] = drec, din.sum(0), x.T @ din
            dx += din @ w[f"in_{d}"].T
        word, gram, first = rows
        count = np.diff(np.append(first, len(gram)))
        g["word"], g["gram"] = np.zeros_like(w["word"]), np.zeros_like(w["gram"])
        np.add.at(g["word"], word, dx[:, :EMBED])
        np.add.at(g["gram"], gram, np.repeat(dx[:, EMBED:] / count[:, None], count, axis=0))
        return loss, g

    def logits(self, rows, ids: np.ndarray) -> np.ndarray:
        x = self.embed(rows)
        return np.concatenate([self.forward(x, ids[at:at + 2048])
                               for at in range(0, len(ids), 2048)])

    def strongest(self, texts: list[str | None]) -> np.ndarray:
        """The largest window logit of each text."""
        out = np.empty(len(texts))
        for low, high, words, ids, owner in _blocks(texts):
            starts = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1])
            out[low:high] = np.fmax.reduceat(self.logits(words.rows(), ids), starts)
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        return _sigmoid(self.scale * self.strongest(texts) + self.shift)


def _blocks(texts: list[str | None], most: int = 1 << 19):
    """Texts in blocks of about ``most`` words: (low, high, Words, windows, owner of each). A
    longer text is a block of its own."""
    low, words, parts, size = 0, Words(), [], 0
    for i, text in enumerate(texts):
        numbers = words.number(cut(text))
        parts.append(windows(numbers))
        size += len(numbers)
        if size >= most or i + 1 == len(texts):
            owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            yield low, i + 1, words, np.concatenate(parts), owner
            low, words, parts, size = i + 1, Words(), [], 0


class Adam:
    def __init__(self, rate: float = 0.01) -> None:
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, w: dict, g: dict) -> None:
        self.t += 1
        for k, grad in g.items():
            m = self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * grad
            v = self.v[k] = 0.999 * self.v.get(k, 0) + 0.001 * grad**2
            w[k] -= (self.rate * (m / (1 - 0.9**self.t))
                     / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-6)).astype(np.float32)


def _evidence(rows, per_doc: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Log odds of each distinct word, from how many documents of either label hold its word row
    and its trigram rows; the start of the search for telling windows."""
    word, gram, first = rows
    count = np.diff(np.append(first, len(gram)))
    grams = np.split(gram, first[1:])
    held = np.ones((2, 2, max(WORD_ROWS, TRIGRAM_ROWS)))
    for ids, y in zip(per_doc, labels):
        held[0, int(y), np.unique(word[ids])] += 1
        if len(ids):
            held[1, int(y), np.unique(np.concatenate([grams[i] for i in ids]))] += 1
    n1, n0 = labels.sum() + 2, len(labels) - labels.sum() + 2
    odds = np.log(held[:, 1] / n1) - np.log(held[:, 0] / n0)
    by_gram = np.maximum.reduceat(odds[1][gram], first)
    return np.maximum(odds[0][word], by_gram) * (count > 0)


def train(texts: list[str | None], labels: np.ndarray, rounds: int = 3, epochs: int = 4,
          steps: int = 150, seed: int = 6) -> Network:
    """Fit on labelled texts. A label belongs to a text, so each round takes the windows that
    look worst now (first by word evidence, then by the network) and fits them to it, in at
    least ``epochs`` passes and ``steps`` steps."""
    net, rng = Network(seed), np.random.default_rng(seed)
    labels = np.asarray(labels, np.float32)
    words = Words()
    per_text = [words.number(cut(t)) for t in texts]
    rows = words.rows()
    cuts = [windows(n) for n in per_text]
    owner = np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])
    every = np.concatenate(cuts)
    # distinct words in order of their number: per text the numbers without padding
    value = _evidence(rows, [np.unique(n) for n in per_text], labels)
    value[0] = -10
    worst = value[every].max(1)
    adam = Adam()
    chosen = np.zeros(len(every), bool)
    for _ in range(rounds):
        order = np.lexsort((-worst, owner))
        rank = np.arange(len(order)) - np.concatenate(
            [[0], np.cumsum([len(c) for c in cuts])])[owner[order]]
        top = order[rank < np.where(labels[owner[order]] > 0, 1, 2)]
        chosen[labels[owner] > 0] = False
        chosen[top] = True
        chosen |= (labels[owner] == 0) & (rng.random(len(every)) < 0.02)
        pool = np.flatnonzero(chosen)
        for _ in range(max(epochs, steps // -(-len(pool) // 256))):
            rng.shuffle(pool)
            for at in range(0, len(pool), 256):
                some = pool[at:at + 256]
                # some windows of padding in each step: a text without words is no toxic text
                batch = np.concatenate([every[some], np.zeros((16, WINDOW), np.int32)])
                used, local = np.unique(batch, return_inverse=True)
                _, g = net.gradients(_subset(rows, used), local.reshape(-1, WINDOW),
                                     np.append(labels[owner[some]], np.zeros(16, np.float32)))
                adam.step(net.w, g)
        worst = net.logits(rows, every)
    best = np.full(len(cuts), -np.inf)
    np.maximum.at(best, owner, worst)
    net.scale, net.shift = _platt(best, labels)
    return net


def _subset(rows, used: np.ndarray):
    word, gram, first = rows
    ends = np.append(first[1:], len(gram))
    count = (ends - first)[used]
    start = np.concatenate([[0], np.cumsum(count)])[:-1]
    at = np.arange(count.sum()) + np.repeat(first[used] - start, count)
    return word[used], gram[at], start


def _platt(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Logistic fit of labels on logits by damped Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = _sigmoid(a * x + b)
        r, q = p - y, p * (1 - p) + 1e-6
        g = np.array([(r * x).sum() + 0.01 * (a - 1), r.sum()])
        h = np.array([[(q * x * x).sum() + 0.01, (q * x).sum()], [(q * x).sum(), q.sum() + 0.01]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a - step[0], b - step[1]
    return float(max(a, 0.05)), float(b)


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learned from."""
    code = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return code % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray]:
    """Texts and labels of the bounded training sample, in the order of their id's hash."""
    usable = labels.select("doc_id", "toxic").filter(
        F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    ).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = [usable.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
            for y, n in ((1, POSITIVES), (0, NEGATIVES))]
    # at most POSITIVES + NEGATIVES ids are replicated
    wanted = F.broadcast(some[0].union(some[1]).withColumnRenamed("doc_id", "_id"))
    found = docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("_id"))
    rows = found.select(F.xxhash64("doc_id").alias("h"), "doc_id", "text", "toxic").collect()
    rows = sorted(rows, key=lambda r: (r.h, r.doc_id, r.text or ""))
    return [r.text for r in rows], np.array([r.toxic for r in rows], np.float32)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text) to (doc_id, held_out, score, predicted), one row per input row.

    Null text is the empty text, which is scored as one window of padding. Equal texts get equal
    scores. Without labels of both kinds nothing can be learned: score 0. Other columns are
    ignored.
    """
    texts, known = training_rows(docs, labels)
    net = train(texts, known) if len(set(known.tolist())) == 2 else None
    shipped = docs.sparkSession.sparkContext.broadcast(net)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                said = part.column(1).to_pylist()
                score = np.zeros(len(said)) if model is None else model.score(said)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(score, pa.float64())], ["doc_id", "score"]
                )

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
