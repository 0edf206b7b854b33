"""Near-duplicate classes by an LSH forest over MinHash signatures, confirmed on full shingle sets.

Each document's distinct word shingles give a signature of 16-bit minima. Equal sets fall together first. Every tree of
the forest takes its own run of hash functions as a label; the labels of all trees are range-partitioned and sorted, so
that documents with long common prefixes lie side by side and a crowded region is dealt over several tasks. `k` leading
values are shared by two documents of similarity t with probability t^k; `k` is the largest depth at which all trees
together miss such a pair with probability 1e-4 at most.

* A run of documents that share k values and has at most RUN members gives all its pairs.
* A longer run goes deeper, until its parts are that small, and gives the pairs of those parts and of sorted neighbours.
* Links that the full sets confirm are joined into components. Where a long run still holds several components, every
  member outside the run's largest component meets every member of the other components, in salted blocks; where the
  signatures agree as such a link's would within five standard deviations, the full sets decide. So depth costs no links.

Cases: null texts count as empty; documents without words have n_shingles 0 and are linked with nothing; rows that
share an id are one document; a null id is linked with nothing and gives component_id null and kept true; ties go to the
smallest id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, bounded, components, discard, filter_of, mix64, passes, scratch, text_batches, written

TREES = 20
#: Hash functions of a tree's own; a label goes on with those of the following trees.
OWN = 8
DEPTH = 16
#: Documents that a run may have for all its pairs to be candidates.
RUN = 6
#: Trees whose long runs give the pairs of deeper parts and of sorted neighbours, and more that give neighbours alone.
FIRST_TREES = 4
SIDE_TREES = 10
#: Labels of a task.
TASK_LABELS = 100_000
#: Members of a long run in one block, and shingles in one block (8 bytes each), on either side of a comparison.
BLOCK = 500
BLOCK_SHINGLES = 4_000_000
#: Bits of the filter that tells which documents have candidates: 2 MB at most, whatever the input.
FILTER_BITS = 1 << 24

_K = TREES * OWN
_rng = np.random.default_rng(20_25)
_MUL = _rng.integers(1, 1 << 63, _K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, _K, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Sixteen bits of each hash function's minimum."""
    out = np.full(_K, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, 200_000 // _K)
    for at in range(0, len(shingles), step):
        part = shingles[at : at + step, None] * _MUL + _ADD
        np.minimum(out, part.min(axis=0), out=out)
    return (mix64(out) & np.uint64(0xFFFF)).astype(">u2")


def depth_for(num: int, den: int) -> int:
    """The longest prefix with which all trees miss a pair of similarity num/den with probability 1e-4 at most."""
    return max(1, min(OWN, int(math.log(1 - 1e-4 ** (1 / TREES)) / math.log(num / den)))) if num < den else OWN


def _signed(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in bounded(batches):
            n, fp, sig = [], [], []
            for text in batch.column(1).to_pylist():
                s = hasher.shingles((text or "").encode("utf-8", "surrogatepass").lower(), width)
                n.append(len(s))
                fp.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary())], ["id", "n", "fp", "sig"])

    return docs.select(F.col(id_col).cast("bigint"), text_col).mapInArrow(run, "id bigint, n bigint, fp binary, sig binary")


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, 2 * _K)
        for t in range(TREES):
            at = np.arange(2 * OWN * t, 2 * (OWN * t + DEPTH)) % (2 * _K)
            label = np.ascontiguousarray(sig[:, at])
            raw = pa.py_buffer(label.tobytes())
            offsets = pa.py_buffer(np.arange(0, label.size + 1, 2 * DEPTH, dtype=np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(label), t, np.int32)), pa.Array.from_buffers(pa.binary(), len(label), [None, offsets, raw]), batch.column(0), batch.column(1)], ["tree", "label", "id", "n"])


def _runs(common: np.ndarray, lo: int, hi: int, depth: int) -> list[tuple[int, int]]:
    """Cuts [lo, hi) where neighbours share fewer than `depth` values."""
    cuts = lo + 1 + np.flatnonzero(common[lo : hi - 1] < depth)
    return list(zip([lo, *cuts.tolist()], [*cuts.tolist(), hi], strict=True))


def _candidates(depth: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        tree, ids, n = t.column(0).to_numpy(), t.column(2).to_numpy(), t.column(3).to_numpy()
        label = np.frombuffer(b"".join(t.column(1).to_pylist()), ">u2").reshape(-1, DEPTH)
        same = np.concatenate((label[1:] == label[:-1], np.zeros((len(label) - 1, 1), bool)), axis=1)
        common = np.where(tree[1:] == tree[:-1], same.argmin(axis=1), 0)
        kind, a, b, key = [], [], [], []

        def pairs(i: np.ndarray, j: np.ndarray, k: np.ndarray | int) -> None:
            i, j = np.asarray(i), np.asarray(j)
            fits = (np.minimum(n[i], n[j]) * den >= num * np.maximum(n[i], n[j])) & (ids[i] != ids[j])
            i, j, k = i[fits], j[fits], np.broadcast_to(k, len(fits))[fits]
            kind.append(k)
            a.append(np.minimum(ids[i], ids[j]))
            b.append(np.maximum(ids[i], ids[j]))
            key.append(np.zeros(len(i), np.int64))

        small, total = [], len(ids)  # small: (from, to) of parts that give all pairs
        stack = []
        for lo, hi in _runs(common, 0, total, depth):
            if hi - lo > RUN or lo == 0 or hi == total:  # long, or perhaps going on in the next task
                prefix = blake2b(bytes([tree[lo]]) + label[lo, :depth].tobytes(), digest_size=8).digest()
                kind.append(np.full(hi - lo, 2))
                a.append(ids[lo:hi])
                b.append(np.full(hi - lo, tree[lo]))
                key.append(np.full(hi - lo, int.from_bytes(prefix, "little", signed=True)))
            if hi - lo > RUN:
                if tree[lo] < SIDE_TREES:
                    side = np.arange(lo, hi - 1)
                    pairs(side, side + 1, 0 if tree[lo] < FIRST_TREES else 1)
                if tree[lo] < FIRST_TREES:
                    stack.append((lo, hi, depth))
            elif hi - lo > 1:
                small.append((lo, hi))
        while stack:
            lo, hi, at = stack.pop()
            if hi - lo <= RUN:
                small.append((lo, hi))
            elif at < DEPTH:
                stack += [(x, y, at + 1) for x, y in _runs(common, lo, hi, at + 1) if y - x > 1]
        for size in range(2, RUN + 1):
            at = np.array([lo for lo, hi in small if hi - lo == size], np.int64)
            if len(at):
                i, j = np.triu_indices(size, 1)
                pairs((at[:, None] + i).ravel(), (at[:, None] + j).ravel(), 0 if size <= 3 else np.where(np.repeat(tree[at], len(i)) < FIRST_TREES, 0, 1))
        if kind:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kind).astype(np.int32)), *(pa.array(np.concatenate(x).astype(np.int64)) for x in (a, b, key))], ["kind", "a", "b", "run"])

    return run


def _sets(docs: DataFrame, id_col: str, text_col: str, width: int, wanted: DataFrame) -> DataFrame:
    """(id, set) of the documents that have candidates, and of few others."""
    held = docs.sparkSession.sparkContext.broadcast(filter_of(wanted.select(F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).alias("at")), FILTER_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bits = WordHasher(), held.value
        for batch in bounded(batches):
            batch = batch.filter(pa.array(passes(bits, batch.column(2).to_numpy())))
            sets = [hasher.shingles((x or "").encode("utf-8", "surrogatepass").lower(), width).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "set"])

    found = docs.select(F.col(id_col).cast("bigint").alias("id"), text_col, F.pmod(F.xxhash64(F.col(id_col).cast("bigint")), F.lit(FILTER_BITS)).alias("at")).where("id is not null")
    return written(found.mapInArrow(run, "id bigint, set binary"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
    return written(joined.mapInArrow(run, "a bigint, b bigint"), "links")


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose documents are in different components so far."""
    a = found.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    b = found.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    return pairs.join(a, "a", "left").join(b, "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")


def _left_over(dense: DataFrame, found: DataFrame, classes: DataFrame, sets: DataFrame, depth: int, num: int, den: int) -> DataFrame:
    """Links across the components of long runs: members outside a run's largest component meet those of the others.

    Both sides are dealt over salted blocks, so that a task holds two blocks of BLOCK members and BLOCK_SHINGLES shingles
    at most on the average, whatever the run. A pair is looked at in the first tree that puts it in one run. Where the
    signatures agree as a link's would, the full sets are compared on the spot, so that only links leave the task, one for
    each document and component."""
    members = written(dense.join(found.withColumnRenamed("node", "id"), "id", "left").join(classes.select("id", "n"), "id").select("run", "tree", "id", "n", F.coalesce("component", "id").alias("c")), "members")
    by = members.groupBy("run", "c").agg(F.count("*").alias("count"), F.sum("n").alias("n")).groupBy("run")
    by = by.agg(F.sum("count").alias("size"), F.sum("n").alias("weight"), F.count("*").alias("parts"), F.max(F.struct("count", "c", "n")).alias("largest")).where("parts > 1")
    blocks = lambda rows, shingles: F.ceil(F.greatest(1.5 * rows / BLOCK, 1.5 * shingles / BLOCK_SHINGLES)).cast("int")  # noqa: E731  hashing deals unevenly
    runs = by.select("run", F.col("largest.c").alias("most"), blocks(F.col("size"), F.col("weight")).alias("rights"), blocks(F.col("size") - F.col("largest.count"), F.col("weight") - F.col("largest.n")).alias("lefts"))
    rows = written(members.join(runs, "run").join(classes.select("id", "sig"), "id").join(sets, "id"), "left-over")
    spread = lambda side, count, salt: F.expr(f"cast(pmod(xxhash64(id, {salt}), {count}) as int)").alias(side)
    out = rows.where("c <> most").select("run", "tree", "id", "n", "c", "sig", "set", spread("i", "lefts", 0), F.explode(F.expr("sequence(0, rights - 1)")).alias("j"))
    rows = rows.select("run", "id", "n", "c", "sig", "set", spread("j", "rights", 1), F.explode(F.expr("sequence(0, lefts - 1)")).alias("i"))
    least = num / den - 5 * math.sqrt(num / den * (1 - num / den) / _K)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        links: list[tuple[int, int]] = []
        if len(left) and len(right):
            x, y = (np.frombuffer(b"".join(side["sig"]), np.uint16).reshape(-1, _K) for side in (left, right))
            ids, n, c = right["id"].to_numpy(), right["n"].to_numpy(), right["c"].to_numpy()
            full = [np.frombuffer(s, np.uint64) for s in right["set"]]
            tree = int(left["tree"].iloc[0])
            for i, own, size, part, raw in zip(range(len(x)), left["id"], left["n"], left["c"], left["set"], strict=True):
                j = np.flatnonzero((c != part) & (np.minimum(n, size) * den >= num * np.maximum(n, size)))
                same = y[j] == x[i]
                alike = same.mean(axis=1)
                first = same.reshape(-1, TREES, OWN)[:, :, :depth].all(axis=2).argmax(axis=1) == tree
                take = np.flatnonzero(first & (alike >= least))
                mine, done = np.frombuffer(raw, np.uint64), {part}
                for k in j[take[np.argsort(-alike[take], kind="stable")]]:
                    if c[k] in done:
                        continue
                    both = len(np.intersect1d(mine, full[k], assume_unique=True))
                    if den * both >= num * (len(mine) + len(full[k]) - both):
                        done.add(c[k])
                        links.append((min(own, ids[k]), max(own, ids[k])))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return written(out.groupBy("run", "i", "j").cogroup(rows.groupBy("run", "i", "j")).applyInPandas(meet, "a bigint, b bigint"), "last-links")


def _classified(docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int) -> DataFrame:
    """(id, n, component) of every row; component: null without words."""
    signed = written(_signed(docs, id_col, text_col, width), "signatures")
    classes = written(signed.where("n > 0 and id is not null").groupBy("fp").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    count = classes.count()
    rows = classes.select("id", "n", "sig").mapInArrow(_labels, "tree int, label binary, id bigint, n bigint")
    keys = ("tree", "label", "id")
    forest = rows.repartitionByRange(max(1, math.ceil(count * TREES / TASK_LABELS)), *keys).sortWithinPartitions(*keys)
    depth = depth_for(num, den)
    met = written(forest.mapInArrow(_candidates(depth, num, den), "kind int, a bigint, b bigint, run bigint"), "candidates")
    dense = met.where("kind = 2").select("run", F.col("a").alias("id"), F.col("b").cast("int").alias("tree")).distinct()
    crowded = dense.groupBy("run").count().where("count > 1").select("run")
    dense = written(dense.join(crowded, "run"), "dense")
    pairs = written(met.where("kind < 2").groupBy("a", "b").agg(F.min("kind").alias("kind")), "pairs")
    discard(met)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionAll(dense.select("id"))
    sets = _sets(docs, id_col, text_col, width, wanted)
    found = components(_confirmed(pairs.where("kind = 0").select("a", "b"), sets, num, den))
    more = _confirmed(_apart(pairs.where("kind = 1"), found), sets, num, den)
    found = components(_star(found).unionAll(more))
    last = _left_over(dense, found, classes, sets, depth, num, den)
    found = components(_star(found).unionAll(last))
    own = classes.select("fp", F.col("id").alias("node")).join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    return written(signed.select("id", "n", "fp").join(own, "fp", "left").select("id", "n", "component"), "near-classes")


def _star(found: DataFrame) -> DataFrame:
    return found.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row; linked: den * intersection >= num * union of the shingle sets."""
    text_batches(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        out = _classified(docs, id_col, text_col, width, num, den)
        keep(out)
    component = F.when(F.col("n") > 0, F.least(F.coalesce("component", "id"), "id")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
