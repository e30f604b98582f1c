"""SentencePiece encoding and decoding with a streaming Viterbi search.

The vocabulary (pieces and scores) comes from a SentencePiece model file; the
best segmentation is the one with the highest score sum. ``StreamingViterbi``
takes text slice by slice and retains a window of characters and scores bounded
by the longest piece: no piece that is still to come starts before it. Whenever
the backpointer paths of all positions in the window meet in one boundary, the
ids up to it are committed and forgotten. Between the last commit and the
window one number (id and length of the piece before it) is kept per character, neither text nor
scores: on a run such as "aaaa...", whose paths differ in phase to its end,
they wait for that end. The next look for a boundary comes when twice as many
wait as after the last one, so the time is linear whether paths meet or not.

White space is escaped as the model does (a leading mark, blanks as U+2581).
No piece holds a mark after another character, so each word is a boundary on
which all paths converge; the ids of words come from this search by way of a
bounded cache of the shorter ones. Characters without a piece
become byte pieces with the usual penalty below the lowest score, and so does
a U+2581 that the text itself contains, which makes decoding an exact inverse.

Ties between segmentations go to the longer last piece.

Defined cases: null and empty texts give no ids and decode to the empty text;
words of any length are searched in bounded slices; a text itself and its ids
are held while it is encoded;
other columns are kept or ignored as the function says.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memo, bounded_batches, raw_texts, slices, table, worker_state

MARK = "▁"
#: Penalty of a byte-coded character below the lowest piece score.
UNKNOWN_PENALTY = 10.0
MISSING = object()
#: Characters that the search takes at a time.
SLICE = 4096
#: Words of at most 64 characters that a worker's cache holds: 200 MB at most.
CACHED = 800_000
CHUNK = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces, scores and byte ids of a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        normal = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in normal}
        self.scores = {self.pieces[i]: sp.get_score(i) for i in normal}
        self.longest = max(map(len, self.ids), default=1)
        self.bits = self.longest.bit_length()
        #: Every prefix of a piece; if it is a piece, its score and its step:
        #: id and length in one number. Characters without a piece count on
        #: from the last id.
        self.prefixes = {p[:n]: None for p in self.scores for n in range(1, len(p))} | {p: (s, self.ids[p] << self.bits | len(p)) for p, s in self.scores.items()}
        floor = min((s for s in self.scores.values() if s > -1e8), default=0.0)
        self.unknown = floor - UNKNOWN_PENALTY
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(not sp.is_byte(i) for i in self.byte_ids):
            raise ValueError("the model has no byte pieces")
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}


class StreamingViterbi:
    """Best segmentation of a character stream."""

    __slots__ = ("v", "text", "best", "at", "step", "look", "ids", "peak")

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.text = ""  # characters from the window's start on
        self.best = [0.0]  # scores of the positions before, between and after them
        self.at = 0  # the window's start, counted from the last commit
        self.step = array("q", (0,))  # by position: the piece that ends there
        self.look = 1  # waiting positions at which to look for a boundary
        self.ids: list[int] = []
        self.peak = 0  # the longest that the window ever was

    def push(self, chars: str, last: bool = False) -> None:
        for k in range(0, max(1, len(chars)), SLICE):
            self._take(chars[k : k + SLICE], last and k + SLICE >= len(chars))

    def finish(self) -> list[int]:
        self._take("", True)
        return self.ids

    def _take(self, chars: str, last: bool) -> None:
        v = self.v
        text = self.text + chars
        n, find, unknown, offset, step = len(text), v.prefixes.get, v.unknown, self.at, self.step
        best = self.best
        best += [-1e300] * (n + 1 - len(best))
        step.frombytes(bytes(8 * (offset + n + 1 - len(step))))
        stop = n if last else max(0, n - v.longest + 1)  # pieces from there on are not all seen
        for at in range(stop):
            base, end = best[at], at + 1
            hit = find(text[at:end], MISSING)
            if (hit is None or hit is MISSING) and base + unknown > best[end]:
                best[end] = base + unknown
                step[offset + end] = (len(v.pieces) + ord(text[at])) << v.bits | 1
            while hit is not MISSING:
                if hit is not None and base + hit[0] > best[end]:
                    best[end] = base + hit[0]
                    step[offset + end] = hit[1]
                if end == n:
                    break
                end += 1
                hit = find(text[at:end], MISSING)
        if len(text) - stop > self.peak:
            self.peak = len(text) - stop
        self.at = offset + stop
        if last:
            self._commit(self.at)
            self.text, self.best = "", best[stop:]
            return
        self.text, self.best = text[stop:], best[stop:]
        if self.at >= self.look:
            self._converge()

    def _converge(self) -> None:
        """Commit up to the boundary that all paths still alive share."""
        step, mask = self.step, (1 << self.v.bits) - 1
        alive = {self.at + k for k, score in enumerate(self.best) if score > -1e299}
        while len(alive) > 1:
            far = max(alive)
            alive.discard(far)
            alive.add(far - (step[far] & mask))
        self._commit(alive.pop())
        self.look = max(1, 2 * self.at)

    def _commit(self, shared: int) -> None:
        """Emit the ids up to a boundary."""
        v, step, chosen, at = self.v, self.step, [], shared
        bits, mask, last = v.bits, (1 << v.bits) - 1, len(v.pieces)
        while at:
            chosen.append(step[at] >> bits)
            at -= step[at] & mask
        for i in reversed(chosen):
            if i < last:
                self.ids.append(i)
            else:
                self.ids += [v.byte_ids[b] for b in chr(i - last).encode("utf-8", "replace")]
        if shared:
            self.step, self.at = step[shared:], self.at - shared


def viterbi(v: Vocabulary, chunk: str) -> list[int]:
    """Ids of a chunk."""
    stream = StreamingViterbi(v)
    stream.push(chunk, True)
    return stream.ids


class PieceCoder:
    """Texts to packed little-endian uint32 ids and back."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.memo = Memo(self._chunk, CACHED)
        self.literal = np.array([self.v.byte_ids[b] for b in MARK.encode()], "<u4").tobytes()
        self.surface = [self._surface(i) for i in range(len(self.v.pieces))]

    def _chunk(self, chunk: str) -> bytes:
        return np.array(viterbi(self.v, chunk), "<u4").tobytes()

    def _surface(self, i: int) -> bytes:
        if i in self.v.byte_of:
            return bytes([self.v.byte_of[i]])
        return self.v.pieces[i].replace(MARK, " ").encode() if self.v.ids.get(self.v.pieces[i]) == i else b""

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        get, out = self.memo.__getitem__, []
        for k, part in enumerate(text.split(MARK)):
            if k:
                out.append(self.literal)
            part = (MARK if not k else "") + part.replace(" ", MARK)
            out.extend(map(get, CHUNK.findall(part)))
        self.memo.trim()
        return b"".join(out)

    def decode(self, packed: bytes) -> bytes:
        joined = b"".join(map(self.surface.__getitem__, np.frombuffer(packed, "<u4").tolist()))
        return joined[1:] if joined[:1] == b" " else joined


def _coder(path: str) -> PieceCoder:
    return worker_state("pieces:" + path, lambda: PieceCoder(path))


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of every row."""
    bounded_batches(docs.sparkSession)
    path = model or default_model()

    def run(frames):
        coder = _coder(path)
        for b in slices(frames):
            packed = [coder.encode(t.decode("utf-8", "replace")) for t in raw_texts(b.column(1))]
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
            ids = pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), ids)], ["doc_id", "ids"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, model: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every row of ids."""
    bounded_batches(tokens.sparkSession)
    path = model or default_model()

    def run(frames):
        coder = _coder(path)
        for b in slices(frames):
            ids = [np.array(x or [], "<u4").tobytes() for x in b.column(1).to_pylist()]
            text = [coder.decode(x).decode("utf-8", "replace") for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return tokens.select(tokens[id_col].cast("long").alias("doc_id"), tokens[ids_col].alias("ids")).mapInArrow(run, "doc_id long, text string")


def encode_checked(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_ids and ``exact``: decoding the ids gives the text."""
    bounded_batches(docs.sparkSession)
    path = model or default_model()

    def run(frames):
        coder = _coder(path)
        for b in slices(frames):
            raws = raw_texts(b.column(1))
            packed = [coder.encode(t.decode("utf-8", "replace")) for t in raws]
            exact = [coder.decode(p) == t for p, t in zip(packed, raws, strict=True)]
            sizes = [len(p) // 4 for p in packed]
            ids = pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), ids)
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(sizes, pa.int64()), pa.array(exact, pa.bool_())], ["doc_id", "ids", "n_ids", "exact"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_ids long, exact boolean")


RESULT = "doc_id long, n_ids long, ids_crc32 long, n_chars long, decoded_crc32 long, exact boolean"


def summary(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: number and crc32 of its ids, length and crc32 of the text
    decoded from them, and whether that equals the text."""
    bounded_batches(docs.sparkSession)
    path = model or default_model()

    def run(frames):
        coder = _coder(path)
        for b in slices(frames):
            rows = []
            for raw in raw_texts(b.column(1)):
                text = raw.decode("utf-8", "replace")
                packed = coder.encode(text)
                back = coder.decode(packed)
                rows.append((len(packed) // 4, zlib.crc32(packed), len(text), zlib.crc32(back), back == raw))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 4 + [pa.bool_()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], ["doc_id", "n_ids", "ids_crc32", "n_chars", "decoded_crc32", "exact"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, RESULT)


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return summary(table(spark, sf_dir, "documents"))
