"""Toxicity by a support vector machine with a subsequence string kernel on Nyström landmarks.

The kernel of two words sums over common subsequences of three characters, each gap or further
character that they span weakening them by DECAY, up to a span of SPAN; it is normalised to 1 for equal words.  So
``st.upid`` or ``iidiot`` stay close to the insults they are made of.  A sentence's kernel with a
landmark is the largest of its words' (values under FLOOR count as 0, and runs of single characters
count as a word too).  Landmarks are words of the training sentences; K(., landmarks) K^-1/2 is the
Nyström map, on which a linear machine is trained: sentences of clean documents are negative, and of
each toxic document the sentences that score highest, found anew in every round, and the toxic landmarks with a character put in.  A document's score
is a logistic function of its three highest sentence values, fitted on the training documents.

Training takes at most TRAIN_DOCS labelled documents of each class, chosen by a hash of their id, and
runs in one task; the logistic function weights them by the inverse of their class's share in the sample, so that
scores follow the class mix of all usable labels at every size.  Scoring covers every document and whole texts.  Null and empty texts get the score
of a text in which no word is near a landmark; without both labels in the training rows every score
is the share of toxic ones (weighted likewise); repeated rows are scored alike, and a null doc_id counts as held out
if the remainder is 0 for an empty text; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import pickle
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, kept, rows_of, ship, spread
from .rolling import mix

#: Labelled documents of each class that training reads at most.
TRAIN_DOCS = 1500
DECAY, SPAN, FLOOR, LANDMARKS, COUNTER = 0.6, 6, 0.35, 72, 24
WIDTH, STRIDE = 24, 12
#: Bytes of words and rows that a worker process keeps.
CACHE_BYTES = 144 << 20
#: How clearly a landmark must speak for toxic documents, in standard deviations of the difference of shares.
CLEAR = 3.0
ENDS = frozenset(".!?|;:")
SINGLES = re.compile(r"(?<!\S)(?:\S\s+){3,}\S(?!\S)")
EDGES = ".,;:!?\"'()[]{}|<>«»“”„…"


def occurrences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each occurrence of a three-character subsequence that spans SPAN characters at most: word, hashed subsequence, weight."""
    text = ("\0" * SPAN).join(words) + "\0" * SPAN
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.array([len(w) + SPAN for w in words])
    owner = np.repeat(np.arange(len(words)), size)
    letter = [mix(code + np.uint64(k << 32)) for k in (1, 2, 3)]
    out = []
    for last in range(2, SPAN):
        n = len(code) - last
        for middle in range(1, last):
            k = np.flatnonzero((code[:n] > 0) & (code[middle : n + middle] > 0) & (code[last:] > 0))
            f = mix(letter[0][k] + letter[1][k + middle] * np.uint64(3) + letter[2][k + last] * np.uint64(5))
            out.append((owner[k], f, np.full(len(k), DECAY ** (last + 1), np.float32)))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


def summed(word: np.ndarray, f: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row for each word and subsequence, weights added."""
    order = np.lexsort((f, word))
    word, f, weight = word[order], f[order], weight[order]
    first = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (f[1:] != f[:-1]))[: len(word)])
    return word[first], f[first], np.add.reduceat(weight, first) if len(first) else weight


class Landmarks:
    """Kernel values of words with the landmarks, from the landmarks' subsequences as a hashed table."""

    def __init__(self, words: list[str]):
        self.words = words
        word, f, weight = summed(*occurrences(words))
        self.norm = np.bincount(word, weight.astype(float) ** 2, len(words))
        order = np.argsort(f, kind="stable")
        self.word, self.weight, f = word[order], weight[order], f[order]
        self.f, self.first, self.count = np.unique(f, return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[(self.f & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
        self.known: dict[str, np.ndarray | None] = {}
        self.bare: dict[str, np.ndarray | None] = {}
        self.bytes = 0

    def matrix(self, words: list[str]) -> np.ndarray:
        """Words of any length: long ones by their windows, of which the nearest counts."""
        parts, owner = [], []
        for k, w in enumerate(words):
            for at in range(0, max(len(w) - STRIDE, 1), STRIDE):
                parts.append(w[at : at + WIDTH])
                owner.append(k)
        out, n = np.zeros((len(words), len(self.words)), np.float32), len(self.words)
        if not parts or not len(self.f):
            return out
        word, f, weight = occurrences(parts)
        least = np.bincount(word, weight.astype(float) ** 2, len(parts))  # equal subsequences only raise the norm
        hit = np.flatnonzero(self.maybe[(f & np.uint64((1 << 18) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.f, f[hit]), len(self.f) - 1)
        hit, at = hit[self.f[at] == f[hit]], at[self.f[at] == f[hit]]
        times = self.count[at]
        entry = np.repeat(self.first[at] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        raw = np.bincount(np.repeat(word[hit], times) * n + self.word[entry], np.repeat(weight[hit], times) * self.weight[entry], len(parts) * n).reshape(len(parts), n)
        value = raw / np.sqrt(np.maximum(least[:, None] * self.norm[None, :], 1e-12))
        near = np.flatnonzero(value.max(axis=1) >= FLOOR)
        if len(near):
            keep = np.zeros(len(parts), bool)
            keep[near] = True
            k = np.flatnonzero(keep[word])
            w, _, total = summed(word[k], f[k], weight[k])
            norm = np.bincount(w, total.astype(float) ** 2, len(parts))[near]
            np.maximum.at(out, np.array(owner)[near], (raw[near] / np.sqrt(np.maximum(norm[:, None] * self.norm[None, :], 1e-12))).astype(np.float32))
        out[out < FLOOR] = 0
        return out

    def of(self, words: Iterable[str]) -> None:
        """Makes known[word] the row of the word without the marks around it, or None if all of it is 0."""
        if self.bytes > CACHE_BYTES:
            self.known.clear()
            self.bare.clear()
            self.bytes = 0
        missing = {w for w in set(words) if w not in self.known}
        inner = {w: w.strip(EDGES) for w in missing}
        new = [w for w in set(inner.values()) if w not in self.bare]
        for k in range(0, len(new), 1024):
            some = new[k : k + 1024]
            m = self.matrix(some)
            hot = m.any(axis=1)
            self.bare.update((w, m[j].copy() if hot[j] else None) for j, w in enumerate(some))
            self.bytes += sum(map(len, some)) + 160 * len(some) + (4 * m.shape[1] + 120) * int(hot.sum())
        self.known.update((w, self.bare[x]) for w, x in inner.items())
        self.bytes += sum(map(len, inner)) + 160 * len(inner)

    def sentences(self, texts: list[str]) -> list[np.ndarray]:
        """For each text a row for each sentence with a word near a landmark."""
        lines = [[line.split() for line in t.lower().split("\n")] for t in texts]
        joined = [[re.sub(r"\s+", "", m) for m in SINGLES.findall(t.lower())] for t in texts]
        self.of({w for doc in lines for line in doc for w in line} | {w for doc in joined for w in doc})
        known, out = self.known, []
        for doc, more in zip(lines, joined):
            rows = [known[w] for w in more if known[w] is not None]
            for line in doc:
                found = [(k, v) for k, v in enumerate(map(known.__getitem__, line)) if v is not None]
                at, own = 0, None
                for k, v in found:
                    if own is not None and any(w[-1] in ENDS for w in line[at:k]):
                        rows.append(own)
                        own = None
                    own, at = v if own is None else np.maximum(own, v), k
                if own is not None:
                    rows.append(own)
            out.append(np.stack(rows) if rows else np.zeros((0, len(self.words)), np.float32))
        return out


def choose_landmarks(texts: list[str], toxic: list[int]) -> tuple[list[str], int]:
    """Words that speak most clearly for toxic documents, none too near to one before it; then clean words that come nearest to them.  Also the number of the former."""
    y = np.array(toxic, bool)
    in_toxic, in_clean = Counter(), Counter()
    for text, t in zip(texts, toxic):
        (in_toxic if t else in_clean).update({w.strip(EDGES) for w in text.lower().split()} - {""})
    nt, nc = y.sum(), (~y).sum()
    scored = []
    for w, a in in_toxic.items():
        if a >= 3 and 3 <= len(w) <= WIDTH:
            p, q = (a + 0.5) / (nt + 1), (in_clean[w] + 0.5) / (nc + 1)
            z = (p - q) / np.sqrt(p * (1 - p) / (nt + 1) + q * (1 - q) / (nc + 1))
            if p > 6 * q and z >= CLEAR:
                scored.append((-z, w))
    chosen: list[str] = []
    for _, w in sorted(scored)[:1500]:
        if len(chosen) == LANDMARKS:
            break
        if not chosen or Landmarks(chosen).matrix([w]).max() < 0.8:
            chosen.append(w)
    if not chosen:
        return [], 0
    toxic_words = len(chosen)
    clean = [w for w, _ in sorted(in_clean.items(), key=lambda x: (-x[1], x[0]))[:20000] if in_toxic[w] <= in_clean[w] * nt / max(nc, 1) and 3 <= len(w) <= WIDTH]
    if clean:
        near = Landmarks(chosen).matrix(clean).max(axis=1)
        chosen += [clean[k] for k in np.argsort(-near, kind="stable")[:COUNTER] if near[k] > 0]
    return chosen, toxic_words


def train_svm(x: np.ndarray, y: np.ndarray, rounds: int = 40, reg: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear machine by averaged stochastic subgradients; positives have three tenths of the weight."""
    rnd, w, b = np.random.default_rng(0), np.zeros(x.shape[1]), 0.0
    weight = np.where(y > 0, 0.3 / max((y > 0).sum(), 1), 0.7 / max((y < 0).sum(), 1)) * len(y)
    mean_w, mean_b, seen, step = np.zeros_like(w), 0.0, 0, 0
    for epoch in range(rounds):
        for part in np.array_split(rnd.permutation(len(y)), max(len(y) // 64, 1)):
            step += 1
            rate = 1 / (reg * (step + 2000))
            bad = y[part] * (x[part] @ w + b) < 1
            g = (weight[part] * y[part] * bad) / len(part)
            w += rate * 0.01 * (g @ x[part] - reg * w)
            b += rate * 0.01 * g.sum()
            if epoch >= rounds // 2:
                mean_w, mean_b, seen = mean_w + w, mean_b + b, seen + 1
    return mean_w / max(seen, 1), mean_b / max(seen, 1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method on weighted rows; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
    return w


class ToxicityModel:
    def __init__(self, texts: list[str], toxic: list[int], stands_for: tuple[float, float] = (1.0, 1.0)):
        """stands_for: how many usable labels a clean and a toxic training document stand for."""
        order = sorted(range(len(texts)), key=lambda k: (toxic[k], texts[k]))
        texts, toxic = [texts[k] for k in order], [toxic[k] for k in order]
        y = np.array(toxic)
        weight = np.where(y > 0, stands_for[1], stands_for[0]).astype(float)
        weight /= weight.mean() if len(y) else 1.0
        self.base = float((weight * y).mean()) if len(y) else 0.0
        words, count = choose_landmarks(texts, toxic) if len(set(toxic)) == 2 else ([], 0)
        self.landmarks = None
        if not words:
            return
        self.landmarks = Landmarks(words)
        square = self.landmarks.matrix(words).astype(float)
        value, vector = np.linalg.eigh((square + square.T) / 2)
        keep = value > 1e-2
        nystroem = vector[:, keep] / np.sqrt(value[keep])
        rows = [r for k in range(0, len(texts), 64) for r in self.landmarks.sentences(texts[k : k + 64])]
        docs = [r @ nystroem for r in rows]
        zero = np.zeros((1, nystroem.shape[1]))
        clean = np.concatenate([zero, *(d for d, t in zip(docs, toxic) if not t)])
        dirty = [d for d, t in zip(docs, toxic) if t and len(d)]
        w, b = nystroem.T @ np.where(np.arange(len(words)) < count, 1.0, -1.0), 0.0
        gapped = [x[:k] + c + x[k:] for x in words[:count] for k, c in ((len(x) // 2, "."), (len(x) // 3, x[len(x) // 3]), (2 * len(x) // 3, "-"))]
        gapped = self.landmarks.matrix(gapped) @ nystroem
        for _ in range(4):
            positive = np.concatenate([gapped, *(d[np.argsort(-(d @ w), kind="stable")[:2]] for d in dirty)])
            w, b = train_svm(np.concatenate([positive, clean]), np.concatenate([np.ones(len(positive)), -np.ones(len(clean))]))
        self.weights, self.bias = nystroem @ w, b
        self.link = np.zeros(4)
        self.link = logistic(np.stack([self._top(r) for r in rows]), y, weight)

    def _top(self, rows: np.ndarray) -> np.ndarray:
        """The three highest sentence values; sentences without a word near a landmark have the value of the bias."""
        value = np.sort(np.append(rows @ self.weights + self.bias, [self.bias] * 3))[::-1]
        return value[:3]

    def scores(self, texts: list[str]) -> list[float]:
        if self.landmarks is None:
            return [self.base] * len(texts)
        top = np.stack([self._top(r) for r in self.landmarks.sentences(texts)])
        return (1 / (1 + np.exp(-np.clip(top @ self.link[:3] + self.link[3], -30, 30)))).tolist()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "landmarks"} | {"words": self.landmarks and self.landmarks.words}

    def __setstate__(self, state):
        words = state.pop("words")
        self.__dict__ |= state
        self.landmarks = Landmarks(words) if words else None


def _train(stands_for: tuple[float, float]):
    def run(batches):
        texts, toxic = [], []
        for text, label in rows_of(batches):
            texts.append(text or "")
            toxic.append(int(label))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(ToxicityModel(texts, toxic, stands_for))])], names=["model"])

    return run


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> bytes:
    """A pickled model from labelled rows whose crc32(doc_id as text) modulo 5 is not 0."""
    ship(docs.sparkSession)
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    usable = usable.where(f"{REMAINDER} <> 0").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable_of = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    stands_for = tuple(max(usable_of.get(t, 0) / most, 1.0) for t in (0, 1))
    chosen = [usable.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for t in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * most rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ids, "doc_id").select("text", "toxic")
    found = rows.repartition(1).mapInArrow(_train(stands_for), "model binary").collect()
    return bytes(found[0]["model"]) if found else pickle.dumps(ToxicityModel([], []))


REMAINDER = "crc32(cast(cast(doc_id as string) as binary)) % 5"
def loaded(model: bytes) -> ToxicityModel:
    return kept((ToxicityModel, model), lambda: pickle.loads(model))


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def _score(model: bytes):
    def run(batches):
        own = loaded(model)

        def rows():
            held, total = [], 0
            for row in itertools.chain(rows_of(batches), [None]):
                if row is not None:
                    held.append(row)
                    total += len(row[2] or "")
                if held and (row is None or total >= 1 << 19):
                    for (doc_id, held_out, _), s in zip(held, own.scores([t or "" for _, _, t in held])):
                        yield doc_id, held_out, s, int(s >= 0.5)
                    held, total = [], 0

        yield from batched(rows(), SCORED)

    return run


def score_documents(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    ship(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(f"coalesce({REMAINDER} = 0, true)").alias("held_out"), F.col("text").cast("string").alias("text"))
    return spread(source).mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")
