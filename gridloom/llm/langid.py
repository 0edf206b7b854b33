"""Language identification by interpolated Kneser-Ney character models.

Text is lower-cased; letters fold into 63 symbols and anything between letters into one gap, so a model of order four
has at most 2^24 n-grams whatever the corpus, which bounds what is collected and broadcast. The n-grams of all training
rows are counted in the tasks and summed by Spark; lower orders use continuation counts. All languages share one sorted
array of hashed n-grams for the highest order and one for the next, with a row of log probabilities per language; n-grams
that no language has seen back off by their contexts' weights. A text goes to the language with the lowest cross-entropy
per symbol. The model counts all training rows. The score's temperature and the score below which `rejected` is set come
from all of them too: each is judged by a model of the half of the rows that it isn't in.

Cases: a null text or one without letters gives `und` and score 0; ties go to the first language in order of name; rows
with a null language don't train; without training rows every text is `und`; whole texts are read whatever their length;
repeated rows get the same answer; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, scratch, text_batches, written

#: Temperatures that are tried, and steps of the score in which rows are counted for the threshold.
TEMPERATURES = np.array([0.05 * 1.3**k for k in range(24)])
BINS = 1_000
#: Share of right answers that the rejection threshold asks for.
PRECISION = 0.99
#: n-grams that a task holds before it sums them.
HELD = 2_000_000

_symbols: np.ndarray | None = None


def _table() -> np.ndarray:
    """Symbol of every code point: 1-26 for a-z, 27-63 for other letters by their code, 0 for all else."""
    global _symbols
    if _symbols is None:
        out = np.zeros(0x110000, np.uint8)
        letters = np.array([c for c in range(0x110000) if chr(c).isalpha()], np.int64)
        out[letters] = 27 + letters % 37
        out[ord("a") : ord("z") + 1] = np.arange(1, 27)
        _symbols = out
    return _symbols


def symbols(text: str | None) -> np.ndarray:
    """Symbols with one gap at either end and one between words; empty without letters."""
    if not text:
        return np.zeros(0, np.uint8)
    s = _table()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    s = np.concatenate(([0], s, [0])).astype(np.uint8)
    s = s[np.concatenate(([True], (s[1:] > 0) | (s[:-1] > 0)))]
    return s if len(s) > 2 else np.zeros(0, np.uint8)


def ngrams(s: np.ndarray) -> np.ndarray:
    """Keys of four symbols, the first ones with the leading gap repeated."""
    if not len(s):
        return np.zeros(0, np.uint32)
    s = np.concatenate(([0, 0], s)).astype(np.uint32)
    return s[:-3] << np.uint32(18) | s[1:-2] << np.uint32(12) | s[2:-1] << np.uint32(6) | s[3:]


def _hash(keys: np.ndarray) -> np.ndarray:
    return keys.astype(np.uint32) * np.uint32(0x9E3779B1)


class Sorted:
    """Hashed keys in order, and their places."""

    def __init__(self, keys: np.ndarray) -> None:
        self.hashes = np.sort(_hash(keys))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = _hash(keys)
        at = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
        return at, self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool)


def kneser_ney(keys: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Probabilities of one language: p4 of its n-grams, and by key g4, p3, g3, p2 (g: the weight of the lower order)."""

    def discount(c: np.ndarray) -> float:
        n1, n2 = (c == 1).sum(), (c == 2).sum()
        return float(n1 / (n1 + 2 * n2)) if n1 else 0.5

    def level(k: np.ndarray, c: np.ndarray, size: int, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probabilities of the seen keys, weight by context); lower: probabilities one order down, by key."""
        d, h = discount(c), k >> 6
        total = np.bincount(h, weights=c, minlength=size)
        kinds = np.bincount(h, minlength=size)
        weight = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
        return np.maximum(c - d, 0) / total[h] + weight[h] * lower[k & (size - 1)], weight

    k3, c3 = np.unique(keys & 0x3FFFF, return_counts=True)
    k2, c2 = np.unique(k3 & 0xFFF, return_counts=True)
    k1, c1 = np.unique(k2 & 0x3F, return_counts=True)
    p1 = np.full(64, 0.05 / 64)
    p1[k1] += 0.95 * c1 / c1.sum()
    got, g2 = level(k2, c2, 64, p1)
    p2 = g2[np.arange(4096) >> 6] * p1[np.arange(4096) & 63]
    p2[k2] = got
    got, g3 = level(k3, c3, 4096, p2)
    every = np.arange(1 << 18)
    p3 = g3[every >> 6] * p2[every & 0xFFF]
    p3[k3] = got
    p4, g4 = level(keys, counts, 1 << 18, p3)
    return {"p4": p4, "g4": g4, "p3": p3, "g3": g3, "p2": p2}


class Model:
    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.languages = sorted(counts)
        self.temperature, self.least = 1.0, 0.0
        if not counts:
            return
        every = {l: kneser_ney(*counts[l]) for l in self.languages}
        k4 = np.unique(np.concatenate([counts[l][0] for l in self.languages]))
        k3 = np.unique(np.concatenate((k4 & 0x3FFFF, k4 >> 6)))
        k4, k3 = k4[np.argsort(_hash(k4))], k3[np.argsort(_hash(k3))]
        self.four, self.three = Sorted(k4), Sorted(k3)
        p4 = []
        for l in self.languages:
            own, p = counts[l][0], every[l]
            row = p["g4"][k4 >> 6] * p["p3"][k4 & 0x3FFFF]
            at = np.minimum(np.searchsorted(own, k4), len(own) - 1)
            seen = own[at] == k4
            row[seen] = p["p4"][at[seen]]
            p4.append(row)
        stack = lambda rows: np.ascontiguousarray(np.log(np.array(rows)).T.astype(np.float32))
        self.p4 = stack(p4)
        self.g4 = stack([every[l]["g4"][k3] for l in self.languages])
        self.p3 = stack([every[l]["p3"][k3] for l in self.languages])
        self.g3 = stack([every[l]["g3"] for l in self.languages])
        self.p2 = stack([every[l]["p2"] for l in self.languages])

    def entropies(self, text: str | None) -> tuple[np.ndarray, int]:
        """Cross-entropy per symbol by language, and the symbols."""
        keys = ngrams(symbols(text))
        if not len(keys) or not self.languages:
            return np.zeros(len(self.languages)), 0
        total = np.zeros(len(self.languages))
        for lo in range(0, len(keys), 1 << 16):
            part = keys[lo : lo + (1 << 16)]
            at, seen = self.four.find(part)
            total += self.p4[at[seen]].sum(axis=0, dtype=np.float64)
            rest = part[~seen]
            if len(rest):
                at, seen = self.three.find(rest >> np.uint32(6))
                total += self.g4[at[seen]].sum(axis=0, dtype=np.float64)
                rest = rest & np.uint32(0x3FFFF)
                at, seen = self.three.find(rest)
                total += self.p3[at[seen]].sum(axis=0, dtype=np.float64)
                rest = rest[~seen]
                total += self.g3[rest >> np.uint32(6)].sum(axis=0, dtype=np.float64) + self.p2[rest & np.uint32(0xFFF)].sum(axis=0, dtype=np.float64)
        return -total / len(keys), len(keys)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)"""
        h, n = self.entropies(text)
        if not n or not self.languages:
            return "und", 0.0, True
        best = int(h.argmin())
        score = float(1 / np.exp(-self.temperature * np.sqrt(n) * (h - h[best])).sum())
        return self.languages[best], score, score < self.least


def _counted(rows: DataFrame) -> DataFrame:
    """(lang, key, n) of (text, lang) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[np.ndarray]] = defaultdict(list)
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        size = 0

        def add() -> None:
            for l, parts in waiting.items():
                k, c = np.unique(np.concatenate(parts), return_counts=True)
                if l in held:
                    k, at = np.unique(np.concatenate((held[l][0], k)), return_inverse=True)
                    c = np.bincount(at, weights=np.concatenate((held[l][1], c))).astype(np.int64)
                held[l] = k, c
            waiting.clear()

        for batch in bounded(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = ngrams(symbols(text))
                if len(keys):
                    waiting[lang].append(keys)
                    size += len(keys)
            if size > HELD:
                add()
                size = 0
        add()
        for l, (k, c) in held.items():
            for lo in range(0, len(k), 50_000):
                part = slice(lo, lo + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array([l] * len(k[part]), pa.string()), pa.array(k[part].astype(np.int32)), pa.array(c[part].astype(np.int64))], ["lang", "key", "n"])

    return rows.select("text", "lang").mapInArrow(run, "lang string, key int, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", trains: str = "true") -> Model:
    """trains: a condition on the id column; only such rows are read."""
    text_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.where(F.expr(trains)).where(F.col(lang_col).isNotNull()).select(F.xxhash64(id_col).alias("h"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    half = F.pmod("h", F.lit(2)) == 0
    with scratch(spark):
        found = written(_counted(rows.select("text", F.concat(half.cast("int").cast("string"), "lang").alias("lang"))), "ngrams").toArrow()
    lang = np.array(found.column(0).to_pylist(), object)
    keys, n = found.column(1).to_numpy().astype(np.int64), found.column(2).to_numpy()
    parts = {}
    for l in sorted(set(lang)):
        own = lang == l
        order = np.argsort(keys[own])
        parts[l] = keys[own][order], n[own][order]
    final = Model({l: _summed([parts[x] for x in ("0" + l, "1" + l) if x in parts]) for l in {x[1:] for x in parts}})
    if final.languages:
        _calibrated(final, [Model({l[1:]: c for l, c in parts.items() if l[0] == k}) for k in "01"], rows.withColumn("own", half.cast("int")))
    return final


def _calibrated(final: Model, halves: list[Model], rows: DataFrame) -> None:
    """Temperature and threshold from all (text, lang, own) rows, each by the model of the half that it isn't in. Their sums and
    counts by score are made in the tasks."""
    held = rows.sparkSession.sparkContext.broadcast(halves)

    def gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int]]:
        """(weighted gaps, place of the true language) of the rows that count."""
        for batch in bounded(batches):
            for text, lang, own in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                model = held.value[1 - own]
                if lang in model.languages:
                    h, n = model.entropies(text)
                    if n:
                        yield np.sqrt(n) * (h - h.min()), model.languages.index(lang)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, count = np.zeros(len(TEMPERATURES)), 0
        scores: dict[tuple[int, int, bool], int] = defaultdict(int)
        for z, true in gaps(batches):
            total = np.exp(-TEMPERATURES[:, None] * z).sum(axis=1)
            loss += np.log(total) + TEMPERATURES * z[true]
            count += 1
            for k, s in enumerate(np.floor(BINS / total).astype(int).tolist()):
                scores[k, s, bool(z[true] == 0 and z.argmin() == true)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(len(loss)), pa.int32()), pa.array([-1] * len(loss), pa.int32()), pa.array([False] * len(loss)), pa.array(loss), pa.array([count] * len(loss), pa.int64())], ["k", "bin", "right", "loss", "n"])
        at = list(scores)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in at], pa.int32()), pa.array([x[1] for x in at], pa.int32()), pa.array([x[2] for x in at], pa.bool_()), pa.array([0.0] * len(at)), pa.array([scores[x] for x in at], pa.int64())], ["k", "bin", "right", "loss", "n"])

    found = rows.select("text", "lang", "own").mapInArrow(measure, "k int, bin int, right boolean, loss double, n bigint")
    found = found.groupBy("k", "bin", "right").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n")).toArrow().to_pylist()
    if not any(r["n"] for r in found):
        return
    best = min((r for r in found if r["bin"] < 0), key=lambda r: (r["loss"], r["k"]))["k"]
    final.temperature = float(TEMPERATURES[best])
    counts = np.zeros((2, BINS + 1))
    for r in found:
        if r["k"] == best and r["bin"] >= 0:
            counts[int(r["right"]), r["bin"]] += r["n"]
    counts = counts[:, ::-1].cumsum(axis=1)
    good = np.flatnonzero(counts[1] >= PRECISION * np.maximum(counts.sum(axis=0), 1))
    final.least = float((BINS - good[-1]) / BINS) if len(good) else 1.0


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def identified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) of every row."""
    text_batches(docs.sparkSession)
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in bounded(batches):
            got = [own.predict(x) for x in batch.column(1).to_pylist()]
            columns = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, "lang_pred", "score", "rejected"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, lang_pred string, score double, rejected boolean")
