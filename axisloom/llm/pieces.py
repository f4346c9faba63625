"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reads a text once. At each position its output links name every piece that ends there; each of them
relaxes the best score of a segmentation up to that position. What the score is depends on the kind of the model:

* unigram: the sum of the pieces' log-probabilities; among equal scores the longest last piece wins.
* BPE: its scores are merge ranks, whose sum means nothing. A segmentation is the one that merging finds exactly if each two
  neighbouring pieces are what merging makes of the two alone. So a piece relaxes a position (from no score to one) if it
  fits behind the last piece of the best segmentation before it; for each position there is one such piece. Whether
  two pieces fit is found by merging those two, once. Ids are those of the `sentencepiece` library.

A character that no piece covers becomes byte pieces (or the unknown piece, if the model has none). The vocabulary
file is a parameter and of fixed size; it is read by the driver and goes to the workers.

Blanks become U+2581 and one is put in front of each text, empty ones included, as the format has it; nothing else is normalised.
U+2581 itself is spelled in bytes, so that decoding gives every text back to the byte. If no piece runs over a blank
that follows another character (checked as the model is read), the best segmentation of a text is made of those of its
blank-led words; each worker then remembers words it has seen, from task to task, up to REMEMBER of them (and those of the
text at hand), and forgets those that haven't come up for longest.

Null texts have null ids, empty ones an empty list; repeated rows and ties get equal ids; other columns pass untouched.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import map_arrow

BLANK = "▁"
#: Words that a worker remembers at most: about 100 MB.
REMEMBER = 400_000


def _fields(data: bytes):
    """(number, value) of the fields of a protocol buffer message: integers and bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + size]
            at += size


def _kind(model: bytes) -> int:
    """What a model file says of itself: 1 unigram, 2 BPE, 3 words, 4 characters. Field 3 of field 2."""
    return next((v for n, spec in _fields(model) if n == 2 for m, v in _fields(spec) if m == 3), 1)


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    #: n normal, b byte, - never in a text (control, unknown, unused).
    kinds: str
    unknown: int = 0
    name: str = field(default="", compare=False)

    #: Merge ranks instead of log-probabilities.
    merging: bool = False

    @staticmethod
    def read(path: str) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        kinds = "".join("b" if m.is_byte(i) else "-" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "n" for i in ids)
        return Vocabulary(tuple(map(m.id_to_piece, ids)), tuple(map(m.get_score, ids)), kinds, m.unk_id(), merging=_kind(m.serialized_model_proto()) == 2)

    def digest(self) -> str:
        return hashlib.sha256(repr((self.pieces, self.scores, self.kinds, self.unknown, self.merging)).encode()).hexdigest()


class Coder:
    """Encodes and decodes; made once in each worker."""

    def __init__(self, v: Vocabulary):
        self.automaton = ahocorasick.Automaton()
        normal = [i for i, k in enumerate(v.kinds) if k == "n" and v.pieces[i]]
        for i in normal:
            self.automaton.add_word(v.pieces[i], (len(v.pieces[i]), v.scores[i], i))
        if normal:
            self.automaton.make_automaton()
        self.bytes = {int(v.pieces[i][3:5], 16): i for i, k in enumerate(v.kinds) if k == "b"}
        self.below = min([v.scores[i] for i in normal], default=0.0) - 10.0
        self.unknown, self.normal = v.unknown, bool(normal)
        self.text = [bytes([int(p[3:5], 16)]) if k == "b" else p.replace(BLANK, " ").encode() if k == "n" else b"" for p, k in zip(v.pieces, v.kinds, strict=True)]
        inside = any(BLANK in v.pieces[i].lstrip(BLANK) for i in normal)
        lines = any("\n" in v.pieces[i] for i in normal)
        self.word = None if inside else re.compile(r" +[^ ]*|[^ ]+" if lines else r" +[^ \n]*|\n|[^ \n]+")
        #: BPE: the rank of each piece (0 is merged first), whether pairs of pieces fit, and what a piece was merged from.
        self.rank = {v.pieces[i]: r for r, i in enumerate(sorted(normal, key=lambda i: -v.scores[i]))} if v.merging else None
        self.pieces, self.nothing = v.pieces, len(v.pieces)
        self.single = {v.pieces[i]: i for i in normal if len(v.pieces[i]) == 1}
        self.fitting: dict[int, bool] = {}
        self.halves: dict[str, tuple[str, str] | None] = {}
        #: Words seen of late, and those of the time before.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _spell(self, character: str) -> list[int]:
        data = character.encode("utf-8", "surrogatepass")
        return [self.bytes[b] for b in data] if all(b in self.bytes for b in data) else [self.unknown]

    def best(self, text: str) -> list[int]:
        """Ids of the best segmentation of `text`, in which blanks are still blanks."""
        if self.rank is not None:
            return self._fitted(text)
        shown = text.replace(BLANK, "\0").replace(" ", BLANK)  # U+2581 of the text itself must match no piece
        own = {i for i, c in enumerate(text) if c == BLANK} if BLANK in text else ()
        n = len(shown)
        score, back = [0.0] + [-np.inf] * n, [None] * (n + 1)
        done = 0  # positions up to which `score` is final

        def spell_up_to(end: int) -> None:
            nonlocal done
            while done < end:
                done += 1
                if score[done - 1] + self.below > score[done]:
                    score[done], back[done] = score[done - 1] + self.below, (1, None)

        for last, (long, gain, piece) in self.automaton.iter(shown) if self.normal else ():
            end = last + 1
            spell_up_to(end - 1)
            if own and not own.isdisjoint(range(end - long, end)):
                continue
            if score[end - long] + gain > score[end]:
                score[end], back[end] = score[end - long] + gain, (long, piece)
        spell_up_to(n)
        out, at = [], n
        while at:
            long, piece = back[at]
            out.append([piece] if piece is not None else self._spell(text[at - 1]))
            at -= long
        return [i for part in reversed(out) for i in part]

    def merged(self, text: str, least: int = 1) -> list[str]:
        """The parts that are left when the neighbours of the best rank, the leftmost first, are merged while there are any, and over `least` parts."""
        parts, none = list(text), len(self.rank)
        while len(parts) > least:
            ranks = [self.rank.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two parts that the last merge of a piece joins; none if merging doesn't lead to it."""
        if piece not in self.halves:
            parts = self.merged(piece, 2)
            self.halves[piece] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[piece]

    def _fits(self, pair: int) -> bool:
        """Whether merging leaves two pieces apart: the first, or `nothing`, times one more than all pieces, plus the second."""
        before, piece = divmod(pair, self.nothing + 1)
        if len(self.fitting) >= 2 * REMEMBER:
            self.fitting.clear()
        own = self.pieces[piece]
        found = self.fitting[pair] = (len(own) == 1 or self._halves(own) is not None) and (before == self.nothing or self._apart(self.pieces[before], own))
        return found

    def _apart(self, x: str, y: str) -> bool:
        """Going back merge by merge, the later one first, no piece over the border comes before the merge that is undone."""
        rank, none = self.rank, len(self.rank)
        until = none  # of equal ranks the leftmost is merged first: within x before over the border, there before within y
        while rank.get(x + y, none) >= until:
            of_x, of_y = rank[x] if len(x) > 1 else -1, rank[y] if len(y) > 1 else -1
            if of_x == of_y == -1:
                return True
            if of_x > of_y:
                until, x = of_x, self._halves(x)[1]
            else:
                until, y = of_y + 1, self._halves(y)[0]
        return False

    def _fitted(self, text: str) -> list[int]:
        """Ids of the only segmentation in which all neighbours fit."""
        shown = text.replace(BLANK, "\0").replace(" ", BLANK)
        n, nothing, fitting = len(shown), self.nothing, self.fitting
        each = nothing + 1
        last = [nothing] + [-1] * n
        size = [0] * (n + 1)  # of the piece that ends here; none where a character stands for itself
        for stop, (long, _, piece) in self.automaton.iter(shown) if self.normal else ():
            stop += 1
            if size[stop]:
                continue
            before = last[stop - long]
            if before < 0:  # all pieces that end there have been: none reaches it, so its character does
                before = last[stop - long] = self.single.get(shown[stop - long - 1], nothing)
            pair = before * each + piece
            fits = fitting.get(pair)
            if self._fits(pair) if fits is None else fits:
                last[stop], size[stop] = piece, long
        out: list[int] = []
        while n:
            if long := size[n]:
                out.append(last[n])
                n -= long
            else:
                out += reversed(self._spell(text[n - 1]))
                n -= 1
        out.reverse()
        return out

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        text = " " + text
        if self.word is None:
            return np.array(self.best(text), np.int32)
        known, words = self.known, self.word.findall(text)
        new = set(words).difference(known)
        if len(known) + len(new) > REMEMBER // 2:  # a text with more words than that is remembered until the next one
            self.older, self.known = known, {}
            known, new = self.known, set(words)
        older = self.older
        for w in new:
            known[w] = older.get(w) or array("i", self.best(w)).tobytes()
        ids = np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32)
        for w in new:
            if len(w) > 64:
                del known[w]
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.text.__getitem__, ids.tolist()))[1:]




_coders: dict[str, Coder] = {}


def coder(digest: str, vocabulary: Vocabulary) -> Coder:
    if digest not in _coders:
        _coders.clear()  # one vocabulary at a time
        _coders[digest] = Coder(vocabulary)
    return _coders[digest]


def _lists(ids: list[np.ndarray | None]) -> pa.Array:
    flat = np.concatenate([x for x in ids if x is not None] or [np.zeros(0, np.int32)])
    ends = np.cumsum([0] + [0 if x is None else len(x) for x in ids])
    starts = pa.array(ends, pa.int32(), mask=np.array([x is None for x in ids] + [False]))
    return pa.ListArray.from_arrays(starts, pa.array(flat, pa.int32()))


def encoded(docs: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """`docs` with the token ids of its text."""
    shipped, digest = docs.sparkSession.sparkContext.broadcast(vocabulary), vocabulary.digest()  # of fixed size: one vocabulary file
    schema = StructType([f for f in docs.schema.fields if f.name != ids] + [StructField(ids, ArrayType(IntegerType(), False), True)])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c = coder(digest, shipped.value)
        out = _lists([None if t is None else c.encode(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()])
        kept = [i for i, n in enumerate(b.schema.names) if n != ids]
        return pa.record_batch([*(b.column(i) for i in kept), out], names=[*(b.schema.names[i] for i in kept), ids])

    return map_arrow(docs, run, schema)


def decoded(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "text") -> DataFrame:
    """`rows` with the text of their token ids, null for null."""
    shipped, digest = rows.sparkSession.sparkContext.broadcast(vocabulary), vocabulary.digest()
    schema = StructType([*(f for f in rows.schema.fields if f.name != text), StructField(text, StringType(), True)])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c = coder(digest, shipped.value)
        found = b.column(b.schema.get_field_index(ids)).to_pylist()
        out = pa.array([None if x is None else c.decode(np.array(x, np.int32)).decode("utf-8", "replace") for x in found], pa.string())
        kept = [i for i, n in enumerate(b.schema.names) if n != text]
        return pa.record_batch([*(b.column(i) for i in kept), out], names=[*(b.schema.names[i] for i in kept), text])

    return map_arrow(rows, run, schema)


def report(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n_tokens, n_bytes, ids_sha256, exact) of every row: ids as little-endian 32-bit numbers in the digest;
    exact: decoding gives the text back to the byte. Null texts count as empty."""
    shipped, digest = docs.sparkSession.sparkContext.broadcast(vocabulary), vocabulary.digest()

    def run(b: pa.RecordBatch) -> dict:
        c = coder(digest, shipped.value)
        n, size, sha, exact = [], [], [], []
        for t in b.column(1).to_pylist():
            ids, data = c.encode(t), t.encode()
            n.append(len(ids))
            size.append(len(data))
            sha.append(hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest())
            exact.append(c.decode(ids) == data)
        return {"doc_id": b.column(0), "n_tokens": n, "n_bytes": size, "ids_sha256": sha, "exact": exact}

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), run, "doc_id long, n_tokens long, n_bytes long, ids_sha256 string, exact boolean")
