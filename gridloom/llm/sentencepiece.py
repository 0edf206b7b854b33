"""Exact BPE encoding of SentencePiece models by backtracking, and decoding.

The encoder finds the vocabulary pieces that start at each place of a word with an Aho-Corasick automaton, tries
the longest first, accepts a piece only if it is compatible with the piece before it, and steps back where no piece
fits; a bitfield holds the places from which no encoding follows. Two pieces are compatible when merging the
characters of their concatenation by score leaves exactly those two. Words are encoded apart, which is exact as long
as no piece holds a space mark after another character; the constructor checks that. Runs of the space mark, whose
pieces all have one score, are merged by length.

Cases: a null text counts as empty; an empty text has the end id only; texts of any length are taken whole; repeated
rows give repeated results; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded, text_batches

MARK = "▁"
#: Entries that a worker's caches of words and of piece pairs hold before they start anew.
WORD_CACHE = 300_000
PAIR_CACHE = 1_000_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class BacktrackingEncoder:
    """Encodes as the library does for a BPE model with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.end = sp.eos_id()
        self.byte = {}
        self.id: dict[str, int] = {}
        self.score: dict[str, float] = {}
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.id[piece] = i
                self.score[piece] = sp.get_score(i)
        self.runs = {len(p): i for p, i in self.id.items() if not p.strip(MARK)}
        if any(MARK in p[1:] for p in self.id if p.strip(MARK)):
            raise ValueError("pieces span words: words can't be encoded apart")
        if len(self.byte) != 256:
            raise ValueError("the model has no byte fallback")
        if "\n" in self.id or any("\n" in p for p in self.id):
            raise ValueError("pieces span lines: lines can't be encoded apart")
        self.piece = {i: p for p, i in self.id.items()}
        self.mark = np.int32(self.runs[1]).tobytes()
        self.newline = np.int32(self.byte[10]).tobytes()
        self.chars = {p for p in self.id if len(p) == 1}
        self.find = ahocorasick.Automaton()
        for p, i in self.id.items():
            if p.strip(MARK) or len(p) == 1:
                self.find.add_word(p, (len(p), i))
        self.find.make_automaton()
        self.size = {i: len(p) for p, i in self.id.items()}
        self.shorter = {i: next((self.id[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.id), 0) for p, i in self.id.items()}
        self.old: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}  # what words and marked held before they were full
        self.joined = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        self.decimal = list(map(str, range(sp.vocab_size())))
        self.words: dict[str, bytes] = {}  # of a stretch of text, its ids as four bytes each
        self.marked: dict[str, bytes] = {}  # the same, after a space mark
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """Merges characters by score, the best first and the leftmost of equals: the definition that compatibility rests on."""
        parts, score, none = list(text), self.score.get, float("-inf")
        worth = [score(x + y, none) for x, y in zip(parts, parts[1:], strict=False)]
        while worth and (best := max(worth)) > none:
            i = worth.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del worth[i]
            if i:
                worth[i - 1] = score(parts[i - 1] + parts[i], none)
            if i < len(worth):
                worth[i] = score(parts[i] + parts[i + 1], none)
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves two adjacent pieces as they are; left: 0 before the first piece."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIR_CACHE:
                self.pairs.clear()
            parts = [self.piece[left], self.piece[right]] if left else [self.piece[right]]
            known = self.pairs[key] = self.merged("".join(parts)) == parts
        return known

    def backtrack(self, text: str) -> list[int]:
        """text: known characters only."""
        longest = {end + 1 - found[0]: found[1] for end, found in self.find.iter_long(text)}  # where longest matches follow each other
        n, open_ = len(text), (1 << len(text) + 1) - 1
        ids: list[int] = []
        at, piece = 0, longest[0]
        compatible, pairs, size, shorter = self.compatible, self.pairs, self.size, self.shorter
        while True:
            last = ids[-1] if ids else 0
            while piece:
                end = at + size[piece]
                if open_ >> end & 1:
                    fits = pairs.get(last << 32 | piece)
                    if compatible(last, piece) if fits is None else fits:
                        break
                piece = shorter[piece]
            if piece:
                ids.append(piece)
                at = end
                if at == n:
                    return ids
                piece = longest.get(at) or longest.setdefault(at, next(self.find.iter_long(text, at))[1][1])
            else:
                open_ &= ~(1 << at)
                piece = ids.pop()
                at -= size[piece]
                piece = shorter[piece]

    def run(self, n: int) -> bytes:
        """n space marks, merged from the left."""
        top = max(self.runs)
        out = [self.runs[top]] * (n // top)
        rest = n % top
        while rest:
            size = max(s for s in self.runs if s <= rest)
            out.append(self.runs[size])
            rest -= size
        return np.array(out, np.int32).tobytes()

    def stretch(self, text: str) -> list[int]:
        """Encodes text without spaces, cut where no piece holds the two characters that meet; characters that the vocabulary
        lacks become bytes."""
        out: list[int] = []
        joined, at = self.joined, 0
        cuts = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in joined]
        if cuts:
            for i in (*cuts, len(text)):
                part = text[at:i]
                out += np.frombuffer(self.words.get(part) or self.kept(self.words, part, self.stretch(part)), np.int32).tolist()
                at = i
            return out
        if text in self.chars or len(text) > 1:
            return self.backtrack(text)
        return [self.byte[x] for x in text.encode("utf-8", "surrogatepass")]

    def kept(self, cache: dict[str, bytes], key: str, ids: list[int]) -> bytes:
        found = np.array(ids, np.int32).tobytes()
        if len(key) <= 64:
            if len(cache) >= WORD_CACHE:
                old = self.old[cache is self.marked]
                old.clear()
                old.update(cache)
                cache.clear()
            cache[key] = found
        return found

    def line(self, text: str, first: bool) -> list[bytes]:
        """Encodes a line; a line end becomes a byte and nothing merges across it. first: it begins with the dummy mark."""
        parts = text.split(" ")
        out: list[bytes] = []
        if not first:
            if head := parts[0]:
                out.append(self.words.get(head) or self.kept(self.words, head, self.stretch(head)))
            del parts[0]
        get = self.marked.get
        found = list(map(get, parts))
        if None not in found:
            return out + found
        spaces = 0
        for part, known in zip(parts, found, strict=True):
            if not part:
                spaces += 1
                continue
            known = known or self.old[1].get(part) or self.kept(self.marked, part, self.stretch(MARK + part))
            if spaces:
                lone = known[:4] == self.mark  # the word's own mark merged with nothing in it, so it joins the run
                out.append(self.run(spaces + lone))
                known = known[4:] if lone else known
                spaces = 0
            out.append(known)
        if spaces:
            out.append(self.run(spaces))
        return out

    def encode(self, text: str | None) -> list[int]:
        """The ids, the end id last."""
        if not text:
            return [self.end]
        if MARK in text:
            text = text.replace(MARK, " ")
        out: list[bytes] = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(self.newline)
            out += self.line(line, k == 0) if line or not k else []
        ids = np.frombuffer(b"".join(out), np.int32).tolist()
        ids.append(self.end)
        return ids

    def said(self, ids: list[int]) -> str:
        """The ids as decimals joined by one space."""
        return " ".join(map(self.decimal.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


_encoders: dict[str, BacktrackingEncoder] = {}


def encoder(model_file: str) -> BacktrackingEncoder:
    """One encoder per worker process and model."""
    if model_file not in _encoders:
        _encoders[model_file] = BacktrackingEncoder(model_file)
    return _encoders[model_file]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str | None = None, ids: bool = True, decoded: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids][, decoded]) of every row. model_file: a path that each executor has."""
    text_batches(docs.sparkSession)
    model = model_file or default_model()
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded string" * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in bounded(batches):
            n, a, b, all_ids, texts = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                found = own.encode(text)
                back = own.decode(found)
                n.append(len(found))
                a.append(hashlib.sha256(own.said(found).encode()).hexdigest())
                b.append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                if ids:
                    all_ids.append(found)
                if decoded:
                    texts.append(back)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            columns += [pa.array(all_ids, pa.list_(pa.int32()))] * ids + [pa.array(texts, pa.string())] * decoded
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids + ["decoded"] * decoded
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
