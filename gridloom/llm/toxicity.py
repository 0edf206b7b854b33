"""Toxicity by weak supervision.

Many voters look at a text; each speaks for the toxic label or abstains. Lexicon voters are the words of a short list of
insults, one voter a word; pattern voters are regular expressions over spelling; induced voters are words and pieces of
words, found by counts over all labelled training rows, that fire from some number of different words on (a stem may occur
once by chance, but not in three words). A generative label model estimates how often each voter fires in either class (its
accuracy) given the voter with which it is most correlated (a tree of dependences, so that voters which fire together count
once). It is fitted by expectation-maximisation on all training rows: labelled rows start the accuracies and stay in the
counts, all training-side documents join without their labels by their expected labels. The posterior labels, which come
from the votes alone even where a label is known, train a linear (logistic) classifier over the votes. The labels of all
labelled rows then calibrate its scores: a slope that fits them, and the offset that puts 0.5 where they are told apart with
the best F1. The classifier scores every whole text. Labels, languages, sources and ids are never inputs of a score.

All these fits need sums over rows only, and rows with the same votes add alike. So every row fires its voters once, rows
are counted by their votes, and the sums run over the different sets of votes: in the driver while these are few, and by
the executors, one pass a step, beyond that.

Cases: a null or empty text fires no voter and gets the classifier's score for that; words are compared in lower case
without marks around them, so texts of any length, repeated rows and ties score alike; labels that are null or belong to
no document are left out; a document with several labels trains with their mean; without labels of both classes the
lexicon and the patterns alone are fitted and nothing is calibrated; other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .common import bounded, discard, filter_of, passes, scratch, text_batches, written

#: Cells (different sets of votes times voters) up to which sums are worked out in the driver, a byte each.
LOCAL_CELLS = 1 << 25
#: Sets of votes that are worked on at a time.
BLOCK = 4_096
#: Cells of a unit of log odds by which labelled rows are counted for calibration, and log odds where the last cells end.
CELLS, ODDS = 1_024, 64
#: What a labelled row counts in the label model against one without a label.
KNOWN_WEIGHT = 3.0
#: Induced voters at most, which bounds the model, and candidates for them that are counted by document.
VOTERS = 400
CANDIDATES = 1_600
#: Numbers of different words from which on an induced voter may fire.
LEVELS = (1, 2, 3)
#: Documents that must hold a word or piece before it may vote.
LEAST = 5
#: Log likelihood ratio (G) that its tie to the toxic label must reach.
EVIDENCE = 30.0
#: Agreement (correlation on the sample) from which on one of two induced voters is left out.
SAME = 0.95
#: Bits of the filter that tells which texts are labelled: 2 MB, whatever the input.
FILTER_BITS = 1 << 24
#: Words that a worker's cache holds before it starts anew.
WORD_CACHE = 100_000
#: What a word without voters gives, one object for all of them.
NOTHING: tuple[int, tuple[int, ...]] = (-1, ())

#: The seed lexicon.
INSULTS = (
    "idiot idiots moron morons stupid dumb loser losers scum trash garbage worthless pathetic disgusting clown fool "
    "imbecile bastard bitch asshole whore slut "
    "dummkopf arschloch abschaum schlampe wichser versager trottel "
    "imbécile connard connasse salope ordure crétin débile "
    "idiota imbécil estúpido basura escoria cabrón puta asqueroso"
).split()

#: The pattern voters, over the lower-case text, but for the shout, which sees the text as it is.
PATTERNS = {
    "second person insult": re.compile(r"\byou(?:'re| are| r)\s+(?:such |just |a |an |all )*(?:idiot|moron|stupid|dumb|worthless|pathetic|trash|scum)"),
    "masked word": re.compile(r"\b\w+[*@#$]{2,}\w+\b"),
    "hate verb": re.compile(r"\b(?:hate|despise|kill|shut up|go die)\b"),
    "shout": re.compile(r"(?:\b[A-Z]{3,}!+\s*){3}"),
    "marks": re.compile(r"[!?]{4}"),
}

_WORD = re.compile(r"[^\W_]+")


def grams(word: str) -> list[str]:
    """The word with ends marked, and its pieces of four to six characters."""
    w = f"^{word}$"
    return [w] + [w[i : i + n] for n in (4, 5, 6) if n < len(w) for i in range(len(w) - n + 1)]


class Voters:
    """Which voters fire on a text: patterns first, then the seed lexicon, then the induced (piece, level) voters."""

    def __init__(self, induced: list[tuple[str, int]]) -> None:
        self.induced = induced
        self.first = len(PATTERNS) + len(INSULTS)
        self.seed = {w: len(PATTERNS) + k for k, w in enumerate(INSULTS)}
        self.pieces: dict[str, int] = {}
        self.levels: list[list[tuple[int, int]]] = []  # by piece: (level, voter)
        for k, (piece, level) in enumerate(induced):
            if piece not in self.pieces:
                self.pieces[piece] = len(self.pieces)
                self.levels.append([])
            self.levels[self.pieces[piece]].append((level, self.first + k))
        self.cache: dict[str, tuple[int, tuple[int, ...]]] = {}

    def __len__(self) -> int:
        return self.first + len(self.induced)

    def __getstate__(self) -> list[tuple[str, int]]:
        return self.induced

    def __setstate__(self, induced: list[tuple[str, int]]) -> None:
        self.__init__(induced)

    def word(self, word: str) -> tuple[int, tuple[int, ...]]:
        """The word's own voter (-1: none) and the pieces in it that some voter counts."""
        found = {self.pieces[g] for g in grams(word) if g in self.pieces}
        out = (self.seed.get(word, -1), tuple(found)) if found or word in self.seed else NOTHING
        if len(word) <= 64:
            if len(self.cache) >= WORD_CACHE:
                self.cache.clear()
            self.cache[word] = out
        return out

    def fire(self, text: str | None) -> list[int]:
        if not text:
            return []
        low = text.lower()
        out = {k for k, (name, p) in enumerate(PATTERNS.items()) if p.search(text if name == "shout" else low)}
        words: dict[int, int] = {}
        known = self.cache.get
        for word in set(_WORD.findall(low)):
            own, pieces = known(word) or self.word(word)
            if own >= 0:
                out.add(own)
            for p in pieces:
                words[p] = words.get(p, 0) + 1
        out.update(v for p, n in words.items() for level, v in self.levels[p] if n >= level)
        return sorted(out)


class Rows:
    """Counted sets of votes: votes (sets x voters), rows without their labels, labelled rows, and the sum of their labels."""

    def __init__(self, blocks: list[tuple[np.ndarray, ...]] | DataFrame, size: int, keep: np.ndarray | None = None) -> None:
        self.blocks, self.size, self.keep = blocks, size, keep  # size: all voters; keep: those that are looked at

    def __len__(self) -> int:
        return self.size if self.keep is None else len(self.keep)

    def only(self, keep: list[int]) -> Rows:
        return Rows(self.blocks, self.size, np.array(keep))

    def total(self, f: Callable[..., np.ndarray], size: int) -> np.ndarray:
        """The sum of f(votes, free, known, gold) over all blocks; size: its length."""
        keep, voters = self.keep, self.size

        def summed(blocks: Iterable[tuple[np.ndarray, ...]]) -> np.ndarray:
            out = np.zeros(size)
            for votes, *counts in blocks:
                out += f((votes if keep is None else votes[:, keep]).astype(np.float64), *counts)
            return out

        if isinstance(self.blocks, list):
            return summed(self.blocks)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = summed(_blocks(pa.Table.from_batches([b]), voters) for b in bounded(batches, BLOCK))
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[at])], ["at", "value"])

        found = self.blocks.mapInArrow(run, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
        out = np.zeros(size)
        out[found.column(0).to_numpy()] = found.column(1).to_numpy()
        return out

    def grams(self, weights: Callable[..., tuple[np.ndarray, ...]], n: int) -> tuple[np.ndarray, np.ndarray]:
        """For each of n weights of the rows, how often each two voters fire together (n x voters x voters), and the rows."""

        def f(votes: np.ndarray, *counts: np.ndarray) -> np.ndarray:
            each = weights(votes, *counts)
            return np.concatenate([((votes * w[:, None]).T @ votes).ravel() for w in each] + [np.array([w.sum() for w in each])])

        size = len(self) * len(self)
        out = self.total(f, n * (size + 1))
        return out[: n * size].reshape(n, len(self), len(self)), out[n * size :]


def _blocks(table: pa.Table, voters: int) -> tuple[np.ndarray, ...]:
    """(votes, free, known, gold) of (on, free, known, gold) rows."""
    votes = np.zeros((table.num_rows, voters), bool)
    for k, on in enumerate(table.column(0).to_pylist()):
        votes[k, on] = True
    return votes, *(np.array(table.column(k).to_pylist(), float) for k in (1, 2, 3))


def _guess(votes: np.ndarray) -> np.ndarray:
    """What labels are taken to be before any is known."""
    return np.where(votes.any(axis=1), 0.9, 0.02)


def _tree(rows: Rows, labelled: bool) -> np.ndarray:
    """Each voter's parent: the earlier voter with which, within classes, it is most correlated; -1: none."""

    def by_label(votes: np.ndarray, free: np.ndarray, known: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, ...]:
        return (gold, known - gold) if labelled else (free * _guess(votes), free * (1 - _guess(votes)))

    both, n = rows.grams(by_label, 2)
    fired = np.diagonal(both, axis1=1, axis2=2)
    cov = (both - fired[:, :, None] * fired[:, None, :] / np.maximum(n, 1e-9)[:, None, None]).sum(axis=0)
    dev = np.sqrt(np.clip(np.diag(cov), 1e-9, None))
    corr = np.abs(cov / np.outer(dev, dev))
    return np.array([-1 if k == 0 or corr[k, :k].max() < 0.1 else int(corr[k, :k].argmax()) for k in range(len(corr))])


def _up(votes: np.ndarray, parent: np.ndarray) -> np.ndarray:
    return np.where(parent[None, :] >= 0, votes[:, np.maximum(parent, 0)], 0.0)


def posterior(votes: np.ndarray, model: dict) -> np.ndarray:
    """The expected labels of rows with such votes."""
    up = _up(votes, model["parent"])
    pairs, log = up * votes, np.zeros((2, len(votes)))
    for c in (0, 1):  # the silent voters' sum, moved by those whose parents or who themselves fired
        silent, loud = np.log1p(-model["rate"][c]), np.log(model["rate"][c])
        prior = model["prior"] if c else 1 - model["prior"]
        log[c] = np.log(prior) + silent[0].sum() + up @ (silent[1] - silent[0]) + votes @ (loud[0] - silent[0]) + pairs @ (loud[1] - silent[1] - loud[0] + silent[0])
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))


def _fitted(rows: Rows, parent: np.ndarray, known_weight: float, free_weight: float, label: Callable[[np.ndarray], np.ndarray]) -> dict:
    """The label model of rows whose labels are known or, where they aren't, given by their votes."""

    def f(votes: np.ndarray, free: np.ndarray, known: np.ndarray, gold: np.ndarray) -> np.ndarray:
        up, q = _up(votes, parent), label(votes)
        pairs, out = up * votes, []
        for c in (0, 1):
            w = known_weight * (gold if c else known - gold) + free_weight * free * (q if c else 1 - q)
            out += [w @ votes, w @ up, w @ pairs, np.array([w.sum()])]
        return np.concatenate(out)

    size = len(parent)
    sums = rows.total(f, 2 * (3 * size + 1)).reshape(2, -1)
    rate = np.zeros((2, 2, size))  # class, what the parent did: how often the voter fires
    for c in (0, 1):
        fired, loud, both, n = sums[c, :size], sums[c, size : 2 * size], sums[c, 2 * size : -1], sums[c, -1]
        alone = (fired + 0.05) / (n + 0.2)
        rate[c] = np.clip((np.array([fired - both, both]) + 4 * alone) / (np.array([n - loud, loud]) + 4), 1e-6, 1 - 1e-6)
    return {"parent": parent, "rate": rate, "prior": float(np.clip(sums[1, -1] / max(sums[:, -1].sum(), 1e-9), 1e-3, 1 - 1e-3))}


def estimated(rows: Rows, labelled: bool, rounds: int = 60) -> dict:
    """The label model: known labels, or a guess where there are none, start it, and every round then fits it to them and to
    the labels that it expects of the rows without."""
    parent = _tree(rows, labelled)
    model = _fitted(rows, parent, 1.0, 0.0 if labelled else 1.0, _guess)
    for _ in range(rounds):
        before, model = model, _fitted(rows, parent, KNOWN_WEIGHT, 1.0, partial(posterior, model=model))
        if max(np.abs(model["rate"] - before["rate"]).max(initial=0), abs(model["prior"] - before["prior"])) < 1e-9:
            break
    return model


def label_model(votes: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None = None, rounds: int = 60) -> tuple[np.ndarray, dict]:
    """Posterior labels of the rows and the model. votes: rows x voters, 0 (abstained) or 1; known: votes and labels of
    other rows, which start the accuracies and count KNOWN_WEIGHT times as much as a row without a label. Every posterior
    comes from votes alone; with known rows, theirs (the first) are returned too."""
    if known is None:
        known = np.zeros((0, votes.shape[1])), np.zeros(0)
    every, n = np.concatenate((known[0], votes)).astype(np.float64), len(known[1])
    gold, is_known = np.zeros(len(every)), np.arange(len(every)) < n
    gold[:n] = known[1]
    model = estimated(Rows([(every, (~is_known).astype(float), is_known.astype(float), gold)], votes.shape[1]), n > 0, rounds)
    q = posterior(every, model)
    hit, miss = model["prior"] * (q @ every) / max(q.sum(), 1e-9), (1 - model["prior"]) * ((1 - q) @ every) / max((1 - q).sum(), 1e-9)
    return q, model | {"accuracy": (hit + 1e-9) / (hit + miss + 2e-9)}


def classifier(rows: Rows, label: Callable[[np.ndarray], np.ndarray], penalty: float = 1.0, steps: int = 50) -> tuple[np.ndarray, float]:
    """Logistic weights and bias for the soft labels of all rows, by Newton's method with halved steps where a step does no
    good."""
    size = len(rows) + 1
    ridge = np.full(size, penalty)
    ridge[-1] = 1e-3

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss, slope and curvature."""

        def f(votes: np.ndarray, free: np.ndarray, known: np.ndarray, gold: np.ndarray) -> np.ndarray:
            x, n, q = np.concatenate((votes, np.ones((len(votes), 1))), axis=1), free + known, label(votes)
            z = x @ w
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            return np.concatenate(([(n * (np.logaddexp(0, z) - q * z)).sum()], x.T @ (n * (p - q)), ((x * (n * p * (1 - p))[:, None]).T @ x).ravel()))

        out = rows.total(f, 1 + size + size * size)
        return float(out[0] + 0.5 * (ridge * w * w).sum()), out[1 : 1 + size] + ridge * w, out[1 + size :].reshape(size, size) + np.diag(ridge)

    n, toxic = rows.total(lambda votes, free, known, gold: np.array([(free + known).sum(), ((free + known) * label(votes)).sum()]), 2)
    w = np.zeros(size)
    w[-1] = math.log(max(toxic / n, 1e-3) / max(1 - toxic / n, 1e-3))
    loss, slope, curve = at(w)
    for _ in range(steps):
        step = np.linalg.solve(curve, slope)
        for share in 0.5 ** np.arange(20):
            new = at(w - share * step)
            if new[0] <= loss:
                break
        else:
            break
        w, (loss, slope, curve) = w - share * step, new
        if share * np.abs(step).max() < 1e-5:
            break
    return w[:-1], float(w[-1])


def calibrated(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make 1 / (1 + exp(-(slope * z + offset))) fit the labels best (Newton's method)."""
    x, w, penalty = np.stack((z, np.ones(len(z)))), np.array([1.0, 0.0]), np.array([[1.0, 0.0], [0.0, 1e-3]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        slope = x @ (weight * (p - y)) + penalty @ (w - np.array([1.0, 0.0]))
        step = np.linalg.solve((x * (weight * p * (1 - p))) @ x.T + penalty, slope)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def best_cut(low: np.ndarray, high: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The value from which on rows count as toxic with the best F1, half-way to the next lower values; of equals the highest.
    Rows are given by cells of values, from low to high, in rising order."""
    low, high, y, weight = (x[::-1] for x in (low, high, y, weight))
    hit = np.cumsum(weight * y)
    k = int((2 * hit / (np.cumsum(weight) + hit[-1])).argmax())
    return float((low[k] + high[k + 1]) / 2) if k + 1 < len(low) else float(low[k])


def offset(rows: Rows, weights: np.ndarray, bias: float) -> tuple[float, float]:
    """The slope that fits the labels of all labelled rows, and the log odds where they are told apart best."""
    cells = 2 * ODDS * CELLS

    def f(votes: np.ndarray, free: np.ndarray, known: np.ndarray, gold: np.ndarray) -> np.ndarray:
        z = np.clip(votes @ weights + bias, -ODDS, ODDS)
        at = np.clip(np.floor((z + ODDS) * CELLS).astype(int), 0, cells - 1)
        return np.concatenate([np.bincount(at, w, cells) for w in (known, gold, known * z)])

    known, gold, z = rows.total(f, 3 * cells).reshape(3, -1)
    at = np.flatnonzero(known)
    y, low = gold[at] / known[at], at / CELLS - ODDS
    slope, _ = calibrated(z[at] / known[at], y, known[at])
    return slope, best_cut(low, low + 1 / CELLS, y, known[at])


def _llr(pos: np.ndarray, neg: np.ndarray, share: float) -> np.ndarray:
    """Log likelihood ratio (G) of toxic and clean rows among those where a voter fires."""
    both = pos + neg
    part = lambda c, s: np.where(c > 0, c * np.log(np.maximum(c, 1e-9) / np.maximum(both * s, 1e-9)), 0.0)
    return 2 * (part(pos, share) + part(neg, 1 - share))


def _candidates(train: DataFrame, share: float) -> list[str]:
    """The words and pieces of all labelled rows that speak most for the toxic label, by (row, word) pairs."""
    words = train.select("y", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("word")).where("word <> ''")
    words = words.groupBy("word").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).where("pos > 0")
    marked = F.concat(F.lit("^"), "word", F.lit("$"))
    pieces = [F.expr(f"case when length(m) > {n} then transform(sequence(1, length(m) - {n - 1}), i -> substring(m, i, {n})) else array() end") for n in (4, 5, 6)]
    found = words.select(marked.alias("m"), "pos", "neg").select("pos", "neg", F.explode(F.array_distinct(F.concat(F.array("m"), *pieces))).alias("g"))
    counts = found.groupBy("g").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(f"pos >= {LEAST}")
    both = F.col("pos") + F.col("neg")
    part = lambda c, s: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (both * s))).otherwise(0.0)
    counts = counts.withColumn("llr", 2 * (part("pos", share) + part("neg", 1 - share))).where((F.col("llr") >= EVIDENCE) & (F.col("pos") > 2 * share * both))
    return [r["g"] for r in counts.orderBy(F.desc("llr"), F.length("g"), "g").limit(CANDIDATES).collect()]


def _induced(train: DataFrame) -> list[tuple[str, int]]:
    """(piece, level) of the induced voters. Every candidate is counted by row at every level over all labelled rows and
    takes its best level; of voters that fire in the same rows the first stands for all."""
    total = train.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    if not total[0] or not total[1]:
        return []
    share = total[0] / (total[0] + total[1])
    every = [(g, level) for g in _candidates(train, share) for level in LEVELS]
    held = train.sparkSession.sparkContext.broadcast(Voters(every))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        pos, rows, mark = np.zeros(len(own)), np.zeros(len(own)), np.zeros(len(own), np.int64)
        for batch in bounded(batches):
            for text, y, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                on = own.fire(text)
                pos[on] += y
                rows[on] += 1
                mark[on] ^= h
        at = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(pos[at]), pa.array(rows[at]), pa.array(mark[at])], ["voter", "pos", "n", "mark"])

    found = train.select("text", "y", "h").mapInArrow(run, "voter bigint, pos double, n double, mark bigint")
    found = found.groupBy("voter").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"), F.bit_xor("mark").alias("mark")).toArrow()
    first = len(PATTERNS) + len(INSULTS)
    at = found.column(0).to_numpy() - first
    pos, n, mark = (found.column(k).to_numpy()[at >= 0] for k in (1, 2, 3))
    at = at[at >= 0]
    llr = _llr(pos, n - pos, share)
    good = (pos >= LEAST) & (llr >= EVIDENCE) & (pos > (1 + share) / 2 * n)
    best: dict[int, tuple[float, int, int]] = {}
    for k in np.flatnonzero(good).tolist():
        mine = (-llr[k], int(at[k]), k)
        piece = int(at[k]) // len(LEVELS)
        best[piece] = min(best.get(piece, mine), mine)
    out, seen = [], set()
    for _, v, k in sorted(best.values(), key=lambda x: (x[0], len(every[x[1]][0]), every[x[1]])):
        if (n[k], mark[k]) not in seen:
            seen.add((n[k], mark[k]))
            out.append(every[v])
    return out[:VOTERS]


class Model:
    def __init__(self, voters: Voters, weights: np.ndarray, bias: float) -> None:
        self.voters, self.weights, self.bias = voters, weights, bias

    def score(self, text: str | None) -> float:
        z = self.bias + float(sum(self.weights[k] for k in self.voters.fire(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def lean(self) -> Model:
        """The same scores without the induced voters that have no weight."""
        first = self.voters.first
        keep = [*range(first), *(first + np.flatnonzero(self.weights[first:]))]
        return Model(Voters([self.voters.induced[k - first] for k in keep if k >= first]), self.weights[keep], self.bias)


def _votes(docs: DataFrame, voters: Voters) -> DataFrame:
    """(id, trains, on) of (id, trains, text) rows: the voters that fire on each."""
    held = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in bounded(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([own.fire(x) for x in batch.column(2).to_pylist()], pa.list_(pa.int32()))], ["id", "trains", "on"])

    found = docs.select("id", "trains", "text")
    return written(found.mapInArrow(run, StructType([*found.schema.fields[:2], StructField("on", ArrayType(IntegerType()))])), "votes")


def _counted(votes: DataFrame, labels: DataFrame, voters: int) -> Rows:
    """The training rows by their votes."""
    found = votes.where("trains").join(labels.select("id", "y"), "id", "left").groupBy("on").agg(F.count("*").alias("free"), F.count("y").alias("known"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("gold"))
    found = written(found, "counted-votes")
    if found.count() * voters > LOCAL_CELLS:
        return Rows(found, voters)
    every = found.toArrow()
    order = sorted(range(every.num_rows), key=every.column(0).to_pylist().__getitem__)
    return Rows([_blocks(every.take(order[lo : lo + BLOCK]), voters) for lo in range(0, len(order), BLOCK)], voters)


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(h, text, y) of the documents (id, text) with labels (id, y). A filter of fixed size keeps nearly all other texts out
    of the join."""
    ids = labels.select(F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).alias("at"))
    held = docs.sparkSession.sparkContext.broadcast(filter_of(ids, FILTER_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(held.value, batch.column(2).to_numpy())))

    found = docs.select("id", F.coalesce("text", F.lit("")).alias("text"), F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).alias("at")).where("id is not null")
    found = found.mapInArrow(run, found.schema).join(labels.hint("merge"), "id")
    return written(found.select(F.xxhash64("id").alias("h"), "text", "y"), "labelled")


def _trained(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, trains: str, all_rows: bool) -> tuple[Model, DataFrame]:
    """The model, with weights for all voters of the votes beside it: those of all rows, or of the rows that train."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.expr(trains), F.lit(False)).alias("trains"))
    own = labels.where(F.expr(trains)).where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    train = _labelled(docs.where("trains"), own)
    voters = Voters(_induced(train))
    discard(train)
    votes = _votes(docs if all_rows else docs.where("trains"), voters)
    every = _counted(votes, own, len(voters))
    weights = np.zeros(len(voters))
    free, toxic, clean = every.total(lambda votes, free, known, gold: np.array([free.sum(), gold.sum(), (known - gold).sum()]), 3)
    if not free:
        return Model(voters, weights, -3.0), votes
    keep = _different(every, voters.first)
    rows, labelled = every.only(keep), bool(toxic and clean)
    weights[keep], bias = classifier(rows, partial(posterior, model=estimated(rows, labelled)))
    if labelled:
        slope, zero = offset(every, weights, bias)
        weights, bias = slope * weights, slope * (bias - zero)
    return Model(voters, weights, bias), votes


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", trains: str = "true") -> Model:
    """trains: a condition on the id column; only such documents and labels are read."""
    text_batches(docs.sparkSession)
    with scratch(docs.sparkSession):
        return _trained(docs, labels, id_col, text_col, label_col, trains, False)[0].lean()


def fitted_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", trains: str = "true") -> DataFrame:
    """(id, score) of every row, by a model fitted as by fit(); each text fires its voters once, for both."""
    text_batches(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        model, votes = _trained(docs, labels, id_col, text_col, label_col, trains, True)
        keep(votes)
    weights = ", ".join(f"{w!r}D" for w in model.weights.tolist())
    z = F.expr(f"aggregate(on, 0D, (z, k) -> z + element_at(array({weights}), k + 1))") + F.lit(model.bias)
    return votes.select(F.col("id").alias(id_col), (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))).alias("score"))


def _different(rows: Rows, first: int) -> list[int]:
    """All voters but those induced ones that fire on nearly the same rows as one before them."""
    both, n = rows.grams(lambda votes, free, known, gold: (free,), 1)
    fired = np.diag(both[0])
    cov = both[0] - np.outer(fired, fired) / n[0]
    size = np.sqrt(np.clip(np.diag(cov), 0, None))
    corr = cov / np.maximum(np.outer(size, size), 1e-12)
    keep = list(range(first))
    for k in range(first, len(corr)):
        if not len(keep) or corr[k, keep].max() < SAME:
            keep.append(k)
    return keep


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: str | None = None) -> DataFrame:
    """(id, score) of every row; keep: all columns, and the score in a column of that name, which must be a new one."""
    text_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    if keep is None:
        docs, name = docs.select(id_col, text_col), "score"
    elif keep.lower() in map(str.lower, docs.columns):
        raise ValueError(f"the documents have a column {keep} already")
    else:
        name = keep
    at = docs.columns.index(text_col)
    fields = [f for f in docs.schema.fields if keep is not None or f.name == id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in bounded(batches):
            scores = pa.array([own.score(x) for x in batch.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.columns if keep is not None else batch.columns[:1]), scores], [*(f.name for f in fields), name])

    return docs.mapInArrow(run, StructType([*fields, StructField(name, DoubleType())]))
