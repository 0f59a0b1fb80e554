"""Toxicity: a support vector machine over a subsequence string kernel with Nystroem landmarks.

The kernel of two words sums, over all common subsequences of `P` letters, the decay to the
power of the stretch each takes up in either word; so an insult still matches with letters
inserted or gaps between its letters, and a stem matches with any ending; the start of a word is
a letter of its own. Values are scaled by
the landmark's kernel with itself and end at 1. A word also counts without its marks between
letters, and a run of single letters counts as one word. A word that lacks more than a quarter
(at least one) of a landmark's letters counts 0, and so does one whose kernel is below `FLOOR`,
unless it has all of the landmark's letters in order in at most twice their number (letters
between all letters): such a kernel is lifted above the floor. A sentence
has, for each landmark, its best word; these values times the inverse root of the
landmarks' own kernel matrix (of the pure kernel, so that it is positive semidefinite) are its Nystroem
features. The machine is trained on sentences: all
of clean documents, and of each toxic document the one that the machine so far finds worst. A
document scores as its worst sentence, through a logistic curve fitted to training documents.

The machine is fitted on the driver from at most `train_docs` labelled documents of each class
and `train_chars` characters. Every text is scored whole.

Edge cases: null and empty texts score as a sentence without landmark words; labels that are
null or without a document are ignored, of several labels of a document the largest counts;
without both classes all documents get the share of toxic labels (0 without labels) as score;
rows that repeat an id give a row each. Columns other than id and text are never inputs.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory, small_batches

P, DECAY, FLOOR = 3, 0.7, 0.66
LANDMARKS, CONTRASTS = 24, 8
TRAIN_DOCS, TRAIN_CHARS = 2500, 24_000_000
#: Letters of a landmark: stems and whole words.
STEM = (4, 10)
#: A letter before each word and stem, so that stems match best where words begin.
START = "^"
#: Longer words are read in pieces of this many letters that overlap by half.
PIECE = 24
#: Documents scored at once, and words remembered meanwhile.
BATCH_DOCS, CACHE_WORDS = 500, 120_000
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’¿¡…–—"
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")
_SPELLED = re.compile(r"(?<!\S)(?:\S\s){2,}\S(?!\S)")


def views(word: str) -> list[str]:
    """The letter strings under which a raw word is compared; START marks where the word begins."""
    word = word.strip(_EDGES)
    out = [START + word] if len(word) >= P else []
    if word and not word.isalnum():
        bare = "".join(c for c in word if c.isalnum())
        if len(bare) >= P:
            out.append(START + bare)
    return [w[i : i + PIECE] for w in out for i in range(0, max(1, len(w) - PIECE // 2), PIECE // 2)]


def _codes(words: list[str], width: int) -> np.ndarray:
    """Code points, a row for each word; unused places get 0."""
    flat = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return flat.reshape(len(words), width)


def subsequence_kernel(words: np.ndarray, others: np.ndarray, kind=np.float64) -> np.ndarray:
    """The kernel, before scaling, of each row of words with the same row of others (code points;
    0 and 1 pad words and others).

    x[:, i, j]: weight of common subsequences that end at letters i and j; each round extends
    them by one letter, with the decay of the letters between.
    """
    match = (words[:, :, None] == others[:, None, :]).astype(kind) * kind(DECAY * DECAY)
    n = others.shape[1]
    lag = np.array([[DECAY ** (j - k - 1) if k < j else 0.0 for j in range(n)] for k in range(n)], dtype=kind)
    x = match
    for _ in range(P - 1):
        y = np.zeros_like(x)
        down = np.zeros((len(words), n), dtype=kind)
        for i in range(1, words.shape[1]):
            down = down * kind(DECAY) + x[:, i - 1, :]
            y[:, i, :] = down @ lag
        x = y * match
    return x.sum(axis=(1, 2), dtype=np.float64)


def _spread(words: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether each row of words has all letters of the same row of others in order, from the first
    to the last in at most twice as many letters."""
    rows, sizes = np.arange(len(words)), (others != 1).sum(axis=1)
    done, first, last = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
    for i in range(words.shape[1]):
        hit = (done < sizes) & (words[:, i] == others[rows, np.minimum(done, others.shape[1] - 1)])
        first[hit & (done == 0)] = i
        last[hit] = i
        done += hit
    return (done == sizes) & (last - first < 2 * sizes)


def _letter_bits(codes: np.ndarray) -> np.ndarray:
    """Each letter as one of 63 bits (some share one)."""
    return np.where(codes != 0, np.uint64(1) << (codes % 63).astype(np.uint64), np.uint64(0))


def _letter_masks(codes: np.ndarray) -> np.ndarray:
    """The set of letters of each row, as 64 bits (letters that share a bit count as one)."""
    return np.bitwise_or.reduce(_letter_bits(codes), axis=1)


class Landmarks:
    def __init__(self, words: list[str]):
        self.words = words
        width = max(map(len, words))
        codes = _codes(words, width)
        self.masks = _letter_masks(codes)
        letters = np.bitwise_count(self.masks).astype(np.int64)
        self.need = letters - np.maximum(1, letters // 4)
        self.codes = np.where(codes == 0, np.uint32(1), codes)
        self.norms = subsequence_kernel(codes, self.codes)
        self.bits = [_letter_bits(c[None, : len(w)])[0] for c, w in zip(codes, words)]
        self._bounds: dict[tuple[int, int], float] = {}

    def bound(self, z: int, missing: int) -> float:
        """No word that has each of the landmark's letters once at most, and none of those missing, has a higher kernel."""
        if (z, missing) not in self._bounds:
            there = [i for i, b in enumerate(self.bits[z]) if not int(b) & missing]
            triples = sum(DECAY ** (P + c[-1] - c[0] + 1) for c in itertools.combinations(there, P))
            self._bounds[z, missing] = triples / self.norms[z]
        return self._bounds[z, missing]

    def matrix(self) -> np.ndarray:
        """The pure kernel of all pairs of landmarks, scaled by both; positive semidefinite."""
        n = len(self.words)
        rows, cols = np.divmod(np.arange(n * n), n)
        plain = np.where(self.codes == 1, np.uint32(0), self.codes)
        k = subsequence_kernel(plain[rows], self.codes[cols]).reshape(n, n)
        return k / np.sqrt(np.outer(self.norms, self.norms))

    def similarities(self, words: list[str]) -> np.ndarray:
        """Scaled kernel, lifted or 0 below the floor: a row for each word, a column for each landmark."""
        out = np.zeros((len(words), len(self.words)), dtype=np.float32)
        lengths = np.array([len(w) for w in words])
        for lo, width in ((0, 6), (6, 9), (9, 12), (12, 16), (16, PIECE)):
            at = np.flatnonzero((lengths > lo) & (lengths <= width))
            if not len(at):
                continue
            codes = _codes([words[i] for i in at], width)
            bits = _letter_bits(codes)
            masks = np.bitwise_or.reduce(bits, axis=1)
            near = np.empty((len(at), len(self.words)), dtype=bool)
            for z, mask in enumerate(self.masks):
                near[:, z] = np.bitwise_count(masks & mask) >= self.need[z]
                # words that lack a letter, and cannot reach the floor for it
                lack = np.flatnonzero(near[:, z] & (masks & mask != mask))
                lack = lack[((bits[lack] & mask) != 0).sum(axis=1) == np.bitwise_count(masks[lack] & mask)]
                missing, which = np.unique(mask & ~masks[lack], return_inverse=True)
                low = np.array([self.bound(z, int(m)) < FLOOR - 1e-6 for m in missing], dtype=bool)
                near[lack[low[which]], z] = False
            rows, cols = np.nonzero(near)
            for i in range(0, len(rows), 4096):
                r, c = rows[i : i + 4096], cols[i : i + 4096]
                k = subsequence_kernel(codes[r], self.codes[c], np.float32) / self.norms[c]
                # single precision may differ from one machine to the next, so what is near the floor is done again
                close = np.flatnonzero(np.abs(k - FLOOR) < 1e-4)
                k[close] = subsequence_kernel(codes[r[close]], self.codes[c[close]]) / self.norms[c[close]]
                k = np.minimum(np.round(k, 6), 1.0)
                low = np.flatnonzero(k < FLOOR)
                whole = _spread(codes[r[low]], self.codes[c[low]])
                k[low] = np.where(whole, FLOOR + (1 - FLOOR) * k[low], 0.0)
                out[at[r], c] = k
        return out


class Scorer:
    """Landmark values of raw words, remembered for up to CACHE_WORDS words."""

    def __init__(self, landmarks: Landmarks):
        # telling: the known words that are like some landmark
        self.landmarks, self.known, self.telling = landmarks, {}, set()

    def learn(self, words) -> None:
        if len(self.known) > CACHE_WORDS:
            self.known = {w: v for w, v in self.known.items() if v is not None}
            if len(self.known) > CACHE_WORDS:
                self.known, self.telling = {}, set()
        fresh = [w for w in words if w not in self.known]
        pieces, owner = [], []
        for n, w in enumerate(fresh):
            if len(w) < PIECE and w.isalnum():  # its only view
                if len(w) >= P:
                    pieces.append(START + w)
                    owner.append(n)
                continue
            for v in views(w):
                pieces.append(v)
                owner.append(n)
        self.known.update(dict.fromkeys(fresh))
        if pieces:
            values = self.landmarks.similarities(pieces)
            for i in np.flatnonzero(values.any(axis=1)):
                w = fresh[owner[i]]
                old = self.known[w]
                self.known[w] = values[i] if old is None else np.maximum(old, values[i])
                self.telling.add(w)

    def document(self, text: str, words: set[str]) -> np.ndarray:
        """Landmark values of each sentence that has any."""
        hits = {w: self.known[w] for w in words & self.telling}
        none = np.zeros((0, len(self.landmarks.words)), dtype=np.float32)
        if not hits:
            return none
        spelled, out = any(w not in text for w in hits), []
        for sentence in _SENTENCE.split(text):
            found = hits.keys() & (words_of(sentence) if spelled else set(sentence.split()))
            if found:
                out.append(np.max([hits[w] for w in found], axis=0))
        return np.array(out, dtype=np.float32) if out else none


def words_of(text: str) -> set[str]:
    out = set(text.split())
    for run in _SPELLED.findall(text):
        out.add("".join(run.split()))
    return out


@dataclass
class Machine:
    landmarks: list[str]
    root: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, values: np.ndarray) -> float:
        """Of a document's worst sentence; values: of its sentences with landmark words."""
        best = self.bias
        if len(values):
            best = max(best, float((values @ self.root @ self.weights).max() + self.bias))
        return best

    def score(self, values: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(values) + self.offset, -60, 60))))


def _stems(words: set[str]) -> set[str]:
    out = set()
    for w in words:
        for v in views(w):
            out.update(v[: n + 1] for n in range(STEM[0], min(len(v) - 1, STEM[1]) + 1))
    return out


def choose_landmarks(toxic: list[set[str]], clean: list[set[str]], n: int = LANDMARKS, contrasts: int = CONTRASTS) -> list[str]:
    """Stems and words that toxic documents have and clean ones lack, one after the other: each
    the one found in most toxic documents, which count half as much for each landmark they have
    already. Then the stems of clean documents most like those."""
    bad = Counter(v for words in toxic for v in _stems(words))
    good = Counter(v for words in clean for v in _stems(words))
    least = max(2, len(toxic) // 400)
    telling = [w for w, c in bad.items() if c >= least and c / len(toxic) > 10 * good[w] / len(clean)]
    telling = sorted(telling, key=lambda w: (-bad[w], -len(w), w))[: 200 * n]
    index = {w: [] for w in telling}
    for d, words in enumerate(toxic):
        for v in _stems(words):
            if v in index:
                index[v].append(d)
    weight, chosen = np.ones(len(toxic)), []
    while telling and len(chosen) < n:
        gain = {w: float(weight[index[w]].sum()) for w in telling}
        most = max(gain.values())
        if most < 1.5:
            break
        # of stems found about as often, the longest
        top = max((w for w in telling if gain[w] >= 0.97 * most), key=lambda w: (len(w), gain[w], w))
        chosen.append(top)
        weight[index[top]] /= 2
        telling = [w for w in telling if not (w.startswith(top) or top.startswith(w))]
    if chosen and contrasts:
        pool = sorted(good, key=lambda w: (-good[w], w))[:20_000]
        like = Landmarks(chosen).similarities(pool).max(axis=1)
        order = sorted(range(len(pool)), key=lambda i: (-like[i], pool[i]))
        chosen += [pool[i] for i in order[:contrasts] if like[i] > 0 and pool[i] not in chosen]
    return chosen


def _train_linear(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss, with the bias as one more feature; always the same result."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w, alpha, norm = np.zeros(x.shape[1]), np.zeros(len(x)), np.maximum((x * x).sum(axis=1), 1e-12)
    rng = np.random.default_rng(5)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            a = min(max(alpha[i] - (y[i] * (w @ x[i]) - 1) / norm[i], 0.0), cost[i])
            if a != alpha[i]:
                w += (a - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(a - alpha[i]))
                alpha[i] = a
        if moved < 1e-3:
            break
    return w[:-1], float(w[-1])


def fit(texts: list[str], toxic: list[int]) -> Machine | float:
    """A machine from labelled texts; without both classes, or without telling words, the share
    of toxic ones."""
    share = sum(toxic) / len(toxic) if toxic else 0.0
    texts = [(t or "").lower() for t in texts]
    sets = [words_of(t) for t in texts]
    bad = [s for s, y in zip(sets, toxic) if y]
    if not bad or len(bad) == len(sets):
        return share
    marks = choose_landmarks(bad, [s for s, y in zip(sets, toxic) if not y])
    if not marks:
        return share
    landmarks = Landmarks(marks)
    values, vectors = np.linalg.eigh(landmarks.matrix())
    keep = values > 1e-3
    root = (vectors[:, keep] / np.sqrt(values[keep])) @ vectors[:, keep].T
    scorer = Scorer(landmarks)
    docs = []
    for text, words in zip(texts, sets):
        scorer.learn(words)
        docs.append(scorer.document(text, words))
    nothing = np.zeros((1, len(marks)), dtype=np.float32)
    clean = np.vstack([nothing] + [np.unique(d, axis=0) for d, y in zip(docs, toxic) if not y and len(d)])
    bags = [d if len(d) else nothing for d, y in zip(docs, toxic) if y]
    witness = [d[int(np.argmax(d.max(axis=1)))] for d in bags]
    # toxic documents without any landmark word tell nothing of sentences
    for _ in range(4):
        pos = np.unique(np.array([w for w in witness if w.any()]), axis=0)
        if not len(pos):
            return share
        x = np.vstack([pos, clean]) @ root
        y = np.concatenate([np.ones(len(pos)), -np.ones(len(clean))])
        cost = np.where(y > 0, 10.0 * max(1.0, len(clean) / len(pos)) ** 0.5, 10.0)
        weights, bias = _train_linear(x, y, cost)
        now = [d[int(np.argmax(d @ root @ weights))] for d in bags]
        if all((a == b).all() for a, b in zip(now, witness)):
            break
        witness = now
    machine = Machine(marks, root.astype(np.float32), weights.astype(np.float32), bias, 1.0, 0.0)
    m = np.array([machine.margin(d) for d in docs])
    # Platt's targets keep the curve from becoming a step
    n1, n0 = sum(toxic), len(toxic) - sum(toxic)
    t = np.where(np.array(toxic) > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 2.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -60, 60)))
        g = np.array([((p - t) * m).sum() + 0.01 * a, (p - t).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * m * m).sum() + 0.01, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    machine.slope, machine.offset = float(max(a, 1e-3)), float(b)
    return machine


def held_out(id_col: str = "doc_id"):
    """True for the fifth of the ids that is never trained on."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train_docs: int, train_chars: int) -> tuple[list[str], list[int]]:
    """A bounded sample of labelled texts that are not held out; always the same."""
    named = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("y")).where("id is not null and y is not null")
    named = named.where(~held_out("id")).groupBy("id").agg(F.max((F.col("y") > 0).cast("int")).alias("y")).withColumn("h", F.xxhash64("id"))
    named = named.join(docs.select(F.col(f"`{id_col}`").alias("id")), "id", "left_semi")
    ids = [r for y in (0, 1) for r in named.where(F.col("y") == y).orderBy("h", "id").limit(train_docs).collect()]
    if not ids:
        return [], []
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(r["id"], r["y"], r["h"]) for r in ids], named.schema)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    texts = texts.where(F.coalesce(F.length("text"), F.lit(0)) <= train_chars)
    rows, labels_, chars = [], [], 0
    # at most train_docs rows of either class are broadcast
    for r in texts.join(F.broadcast(wanted), "id").orderBy("h", "id").select("text", "y").toLocalIterator():
        if len(rows) >= 2 * train_docs:
            break
        size = len(r["text"] or "")
        if chars + size > train_chars:  # shorter ones may still fit
            continue
        chars += size
        rows.append(r["text"])
        labels_.append(r["y"])
    return rows, labels_


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> Machine | float:
    machine = fit(*training_rows(docs, labels, id_col, text_col, label_col, train_docs, train_chars))
    release_memory()  # the sample's texts are not needed any more
    return machine


def score(docs: DataFrame, machine: Machine | float, text_col: str = "text", name: str = "__tw_score") -> DataFrame:
    """docs with a column `name`. Only texts go to the Python workers, and only scores come back."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(Landmarks(machine.landmarks)) if isinstance(machine, Machine) else None
        for whole in batches:
            out = []
            for lo in range(0, len(whole), BATCH_DOCS):
                texts = [(t or "").lower() for t in whole.slice(lo, BATCH_DOCS).to_pylist()]
                if scorer is None:
                    out += [float(machine)] * len(texts)
                else:
                    sets = [words_of(t) for t in texts]
                    scorer.learn(set().union(*sets))
                    out += [machine.score(scorer.document(t, w)) for t, w in zip(texts, sets)]
            yield pa.array(out, type=pa.float64())
        scorer = texts = sets = whole = None
        release_memory()

    return docs.withColumn(name, F.arrow_udf(run, "double")(F.col(f"`{text_col}`").cast("string")))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> DataFrame:
    """A row for each row of docs: id_col, held_out, score, predicted."""
    machine = train(docs, labels, id_col, text_col, label_col, **options)
    rows = score(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), machine, name="score")
    return rows.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, training: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> DataFrame:
    """docs without the rows that score 0.5 or more; all columns stay. training: where labelled
    texts are found, if not docs."""
    machine = train(docs if training is None else training, labels, id_col, text_col, label_col, **options)
    return score(docs, machine, text_col).where("__tw_score < 0.5").select(*[F.col(f"`{c}`") for c in docs.columns])
