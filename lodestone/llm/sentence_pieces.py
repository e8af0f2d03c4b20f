"""SentencePiece encoding by forward filtering and backward sampling.

The pieces that match a text form a lattice over its characters.  Forward
filtering sums, for each position, the weight of all segmentations that end
there; backward sampling then draws one segmentation from the last position
to the first, each in proportion to its weight.  Random numbers are a hash of
the row key and the place in the text, so that a row's segmentation is the
same whatever batch, task or run it is in.

The lattice falls apart where no piece can lie: before a space that follows
something else (unless the vocabulary has pieces over such a place), around
characters that no longer piece holds, and, in long chunks, wherever no piece
lies across.  Distinct chunks of a batch are filtered once, all of them side by
side in numpy.  Chunks that stay long are filtered in stretches: every stretch is cut
into segments whose linear maps are worked out side by side; forward sums are
kept at the stretches' ends and worked out again on the way back.  Time and
memory follow the length of a text, whatever is in it.

A space is the piece sign U+2581, one is put before the text.  Characters
that are no piece, U+2581 itself among them, become byte pieces; decoding
gives every text back unchanged.  A null text is the empty text, which has no
pieces.  A null key is a key of its own; rows with equal keys and texts get
equal segmentations.  Very long texts are encoded whole.  Extra columns stay.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from lodestone.llm.common import small_batches, table

SIGN = "▁"
#: Characters of texts that one pass takes in at most; longer texts take a pass of their own.
PASS_CHARS = 1 << 20
#: Chunks beyond LONG are looked through for cuts; what stays longer is filtered in stretches of segments.
LONG, STRETCH, SEGMENT = 256, 1 << 17, 256
_GOLD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with spaces for the sign, log weights, and the ids of the 256 byte pieces."""

    pieces: dict[str, int]
    weights: np.ndarray
    bytes_: tuple[int, ...]

    @classmethod
    def load(cls, path: str | None = None) -> Vocabulary:
        """Read a model file.

        A unigram model's scores are log probabilities.  A BPE model's scores
        are merge ranks; the piece of rank r gets the weight 1 / (r + 2).
        """
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=str(path or default_model()))
        n = model.get_piece_size()
        pieces, byte_ids = {}, {}
        scores = np.array([model.get_score(i) for i in range(n)])
        ranked = bool((scores == np.round(scores)).all())
        weights = -np.log(2.0 - np.minimum(scores, 0)) if ranked else scores
        for i in range(n):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(name[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[name.replace(SIGN, " ")] = i
        if len(byte_ids) != 256:
            raise ValueError("the model needs byte pieces to be lossless")
        return cls(pieces, weights, tuple(byte_ids[b] for b in range(256)))

    def text_of(self) -> list[bytes]:
        """The bytes of each id."""
        out = [b""] * len(self.weights)
        for piece, i in self.pieces.items():
            out[i] = piece.encode("utf-8")
        for b, i in enumerate(self.bytes_):
            out[i] = bytes([b])
        return out


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sampler:
    """Encodes texts with one vocabulary, smoothing exponent alpha and seed."""

    def __init__(self, vocabulary: Vocabulary, alpha: float, seed: int):
        self.v, self.alpha, self.seed = vocabulary, alpha, seed
        self.longest = max(map(len, vocabulary.pieces))
        inner = {c for p in vocabulary.pieces if len(p) > 1 for c in p}
        hard = "".join(c for c in "\n\t\r" if c not in inner)
        over = any(" " in p.lstrip(" ") for p in vocabulary.pieces)
        self.chunk = re.compile(r"(?s).+" if over else rf" *[^ {hard}]+|[{hard}]| +" if hard else r" *[^ ]+| +")
        self._trie()
        self.floor = float(vocabulary.weights.min()) - 1.0
        self.logs = np.append(vocabulary.weights * alpha, -np.inf).astype(np.float32)  # the last one is for -1
        self.bytes_of = vocabulary.text_of()

    def _trie(self) -> None:
        """Transitions (state, character) -> state in an open hash table; state 0 is the root."""
        moves: dict[tuple[int, int], int] = {}
        ids = [-1]
        for piece, i in self.v.pieces.items():
            s = 0
            for c in piece:
                t = moves.get((s, ord(c)))
                if t is None:
                    t = moves[s, ord(c)] = len(ids)
                    ids.append(-1)
                s = t
            ids[s] = i
        self.ids = np.array(ids, dtype=np.int32)
        self.bits = max(10, (4 * len(moves)).bit_length())
        self.keys, self.next = np.full(1 << self.bits, -1, dtype=np.int64), np.zeros(1 << self.bits, dtype=np.int32)
        key = np.array([(s << 21) | c for s, c in moves], dtype=np.int64)
        value = np.array(list(moves.values()), dtype=np.int32)
        slot, self.rounds = self._slot(key), 0
        while len(key):
            self.rounds += 1
            free = self.keys[slot] == -1
            _, first = np.unique(slot[free], return_index=True)
            put = np.nonzero(free)[0][first]
            self.keys[slot[put]], self.next[slot[put]] = key[put], value[put]
            rest = np.ones(len(key), dtype=bool)
            rest[put] = False
            key, value, slot = key[rest], value[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The state after char, -1 if there is none."""
        key = (state.astype(np.int64) << 21) | char
        slot = self._slot(key)
        out = np.where(self.keys[slot] == key, self.next[slot], -1)
        miss = np.nonzero((out < 0) & (self.keys[slot] != -1))[0]
        for _ in range(self.rounds):
            if not len(miss):
                break
            slot[miss] = (slot[miss] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[miss]] == key[miss]
            out[miss[found]] = self.next[slot[miss[found]]]
            miss = miss[~found & (self.keys[slot[miss]] != -1)]
        return out

    def _arcs(self, chars: np.ndarray, room: np.ndarray, most: int) -> np.ndarray:
        """Ids of the pieces by (length - 1, start), -1 for none; room: how long a piece from a start may be."""
        ids = np.full((most, len(chars)), -1, dtype=np.int32)
        at, state = np.arange(len(chars)), np.zeros(len(chars), dtype=np.int64)
        for k in range(most):
            ok = room[at] > k
            at, state = at[ok], state[ok]
            state = self._step(state, chars[at + k])
            ok = state >= 0
            at, state = at[ok], state[ok]
            if not len(at):
                break
            ids[k, at] = self.ids[state]
        return ids

    def _with_bytes(self, chars: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Log weights of the arcs; characters that are no piece get byte pieces in ids (-2 - c stands for several)."""
        alone = ids[0] < 0
        width = np.where(chars < 0x80, 1, np.where(chars < 0x800, 2, np.where(chars < 0x10000, 3, 4)))
        logs = self.logs[ids]
        logs[0, alone] = self.alpha * self.floor * width[alone]
        small = alone & (chars < 0x80)
        ids[0, small] = np.array(self.v.bytes_, dtype=np.int32)[chars[small]]
        ids[0, alone & ~small] = -2 - chars[alone & ~small]
        return logs

    @staticmethod
    def _codes(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)

    def _cuts(self, chunk: str) -> list[int]:
        """The places inside a chunk that no piece lies across."""
        n, out = len(chunk), []
        open_ = np.zeros(self.longest + 1, dtype=np.int64)  # pieces that reach over a stretch's end
        for s in range(0, n, STRETCH):
            e = min(n, s + STRETCH)
            chars = self._codes(chunk[s : min(n, e + self.longest)])
            ids = self._arcs(chars, len(chars) - np.arange(len(chars)), min(self.longest, len(chars)))[:, : e - s]
            edge = np.zeros(e - s + self.longest + 1, dtype=np.int64)
            edge[: len(open_)] += open_
            for k in range(1, len(ids)):
                at = np.nonzero(ids[k] >= 0)[0]
                edge += np.bincount(at + 1, minlength=len(edge))[: len(edge)] - np.bincount(at + k + 1, minlength=len(edge))[: len(edge)]
            lies = np.cumsum(edge[: e - s])
            out += (np.nonzero(lies == 0)[0] + s).tolist()
            open_ = edge[e - s :].copy()
            open_[0] += int(lies[-1])
        return [p for p in out if 0 < p < n]

    def _lattice(self, chunks: list[str]):
        """Ids by (length, start), and for each end the cumulated chances of the last piece's length."""
        lengths = np.array([len(c) for c in chunks])
        base = np.concatenate([[0], np.cumsum(lengths)])
        n = int(base[-1])
        chars = self._codes("".join(chunks))
        ids = self._arcs(chars, np.repeat(base[1:], lengths) - np.arange(n), min(self.longest, int(lengths.max())))
        most = max(1, int(np.nonzero((ids >= 0).any(axis=1))[0].max(initial=0)) + 1)
        ids = ids[:most]
        logs = self._with_bytes(chars, ids)

        # Forward filtering, all chunks side by side; node p of a chunk is base + its number + p.
        order = np.argsort(-lengths, kind="stable")
        sorted_lengths, node0, char0 = lengths[order], (base[:-1] + np.arange(len(chunks)))[order], base[:-1][order]
        forward = np.zeros(n + len(chunks))
        chances = np.zeros((n + len(chunks), most), dtype=np.float32)
        active = len(chunks)
        for p in range(1, int(lengths.max()) + 1):
            while active and sorted_lengths[active - 1] < p:
                active -= 1
            nodes, starts, k = node0[:active], char0[:active], min(p, most)
            terms = np.stack([forward[nodes + p - j] + logs[j - 1, starts + p - j] for j in range(1, k + 1)], axis=1)
            top = terms.max(axis=1, keepdims=True)
            weights = np.exp(terms - top)
            total = weights.sum(axis=1, keepdims=True)
            forward[nodes + p] = (top + np.log(total))[:, 0]
            chances[nodes + p, :k] = np.cumsum(weights / total, axis=1)
            chances[nodes + p, k - 1 :] = 2.0
        return ids, chances, base, lengths

    def _weights(self, chunk: str, s: int, e: int, most: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids by (length - 1, start - first), and for each end s + 1 to e the weights of the last piece by length; the place of the first start."""
        first = max(0, s - most + 1)
        chars = self._codes(chunk[first:e])
        ids = self._arcs(chars, len(chars) - np.arange(len(chars)), most)
        logs = self._with_bytes(chars, ids)
        ends = np.arange(s + 1, e + 1)
        w = np.zeros((e - s, most))
        for j in range(1, most + 1):
            at = ends - j - first
            ok = at >= 0
            w[ok, j - 1] = np.exp(logs[j - 1, at[ok]])
        return ids, w, first

    def _forward(self, w: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cumulated chances of the last piece's length at each end, and the state after them; state: forward sums of the last ends, newest first."""
        n, most = w.shape
        parts = -(-n // SEGMENT)
        padded = np.zeros((parts * SEGMENT, most))
        padded[:n] = w
        padded[n:, 0] = 1.0
        steps = padded.reshape(parts, SEGMENT, most)
        # Each segment's linear map, from all unit states side by side.
        maps = np.broadcast_to(np.eye(most), (parts, most, most)).copy()
        for t in range(SEGMENT):
            new = np.matmul(maps, steps[:, t, :, None])
            maps = np.concatenate([new, maps[:, :, :-1]], axis=2)
            if t % 8 == 7:
                maps /= maps.max(axis=(1, 2), keepdims=True)
        begin = np.empty((parts, most))
        for k in range(parts):
            begin[k] = state
            state = state @ maps[k]
            state = state / state.max()
        chances = np.empty((parts, SEGMENT, most), dtype=np.float32)
        now, last = begin, n - 1 - (parts - 1) * SEGMENT
        for t in range(SEGMENT):
            terms = now * steps[:, t]
            total = terms.sum(axis=1, keepdims=True)
            chances[:, t] = np.cumsum(terms / total, axis=1)
            now = np.concatenate([total, now[:, :-1]], axis=1)
            now /= now.max(axis=1, keepdims=True)
            if t == last:
                after = now[-1].copy()
        chances = chances.reshape(-1, most)[:n]
        # The last length that is there ends at 2, so that rounding never passes it.
        there = most - 1 - np.argmax(w[:, ::-1] > 0, axis=1)
        chances[np.arange(most)[None, :] >= there[:, None]] = 2.0
        return chances, after

    def _sampled(self, chunk: str, draw) -> np.ndarray:
        """The sampled ids of a chunk of any length; draw gives the random numbers of ends."""
        n, most = len(chunk), min(self.longest, len(chunk))
        state = np.zeros(most)
        state[0] = 1.0
        states, starts = [], list(range(0, n, STRETCH))
        for s in starts:
            states.append(state)
            if s != starts[-1]:
                _, w, _ = self._weights(chunk, s, min(n, s + STRETCH), most)
                _, state = self._forward(w, state)
        out, p = [], n
        for s, state in zip(reversed(starts), reversed(states), strict=True):
            ids, w, first = self._weights(chunk, s, min(n, s + STRETCH), most)
            chances, _ = self._forward(w, state)
            lengths = ((chances <= draw(np.arange(s + 1, s + len(w) + 1))[:, None]).sum(axis=1) + 1).tolist()
            while p > s:
                k = lengths[p - s - 1]
                out.append(int(ids[k - 1, p - k - first]))
                p -= k
        return np.array(out[::-1], dtype=np.int32)

    @staticmethod
    def _draws(stream: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Random numbers of places in chunks: the same whatever a chunk was cut into."""
        return (mix(stream + at.astype(np.uint64) * _STEP) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)

    def encode(self, texts: list[str], keys: list[str]) -> list[np.ndarray]:
        """The sampled ids of each text."""
        out: list[np.ndarray] = []
        for part in _passes(texts):
            if part.stop - part.start == 1 and len(texts[part.start]) > PASS_CHARS:
                out.append(self._encode_long(texts[part.start], keys[part.start]))
            else:
                out += self._encode([self.chunk.findall(" " + t) if t else [] for t in texts[part]], keys[part], 0)
        return out

    def _encode_long(self, text: str, key: str) -> np.ndarray:
        """A text of any length, some chunks at a time."""
        out, held, size, first = [], [], 0, 0
        for m in self.chunk.finditer(" " + text):
            held.append(m[0])
            size += len(m[0])
            if size > PASS_CHARS:
                out += self._encode([held], [key], first)
                held, size, first = [], 0, first + len(held)
        return np.concatenate([*out, *self._encode([held], [key], first)])

    def _encode(self, found: list[list[str]], keys: list[str], first: int) -> list[np.ndarray]:
        """The ids of texts as lists of chunks, whose numbers in their text begin at first."""
        seeds = np.array([int.from_bytes(hashlib.blake2b(f"{self.seed}/{k}".encode(), digest_size=8).digest(), "little") for k in keys], dtype=np.uint64)
        names: dict[str, int] = {}
        where, nth, offset, counts, long_ = [], [], [], [], []
        for f in found:
            n = len(where)
            for j, c in enumerate(f):
                if len(c) <= LONG:
                    where.append(names.setdefault(c, len(names)))
                    nth.append(j)
                    offset.append(0)
                    continue
                cuts = [0, *self._cuts(c), len(c)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if b - a > LONG:
                        long_.append((len(where), c[a:b]))
                    where.append(-1 if b - a > LONG else names.setdefault(c[a:b], len(names)))
                    nth.append(j)
                    offset.append(a)
            counts.append(len(where) - n)
        where, counts = np.array(where, dtype=np.int64), np.array(counts, dtype=np.int64)
        if not len(where):
            return [np.zeros(0, dtype=np.int32) for _ in found]
        stream = mix(np.repeat(seeds, counts) + (np.array(nth, dtype=np.int64) + first).astype(np.uint64) * _GOLD)
        offset, sizes, drawn = np.array(offset, dtype=np.int64), np.zeros(len(where), dtype=np.int64), []
        if names:
            ids, chances, base, lengths = self._lattice(list(names))
            left, open_ = np.where(where >= 0, lengths[np.maximum(where, 0)], 0), np.nonzero(where >= 0)[0]
            while len(open_):
                chunk, p = where[open_], left[open_]
                u = self._draws(stream[open_], offset[open_] + p)
                length = (chances[base[chunk] + chunk + p] <= u[:, None]).sum(axis=1) + 1
                drawn.append((open_, ids[length - 1, base[chunk] + p - length]))
                left[open_] = p - length
                sizes[open_] += 1
                open_ = open_[p > length]
        apart = [(at, self._sampled(c, lambda p, at=at: self._draws(stream[at], offset[at] + p))) for at, c in long_]
        for at, x in apart:
            sizes[at] = len(x)
        ends = np.cumsum(sizes)
        out = np.empty(int(ends[-1]), dtype=np.int32)
        for s, (occurrence, piece) in enumerate(drawn):
            out[ends[occurrence] - 1 - s] = piece
        for at, x in apart:
            out[ends[at] - len(x) : ends[at]] = x
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return [self._spelled(out[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def _spelled(self, ids: np.ndarray) -> np.ndarray:
        """Byte pieces for the characters that are no piece."""
        odd = np.nonzero(ids < 0)[0]
        if not len(odd):
            return ids
        parts, last = [], 0
        for at in odd.tolist():
            parts += [ids[last:at], np.array([self.v.bytes_[b] for b in chr(-2 - int(ids[at])).encode("utf-8", "surrogatepass")], dtype=np.int32)]
            last = at + 1
        return np.concatenate([*parts, ids[last:]])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


_samplers: dict[tuple, Sampler] = {}


def _sampler(shared, alpha: float, seed: int) -> Sampler:
    """One sampler per Python worker and setting."""
    key = (shared.id if hasattr(shared, "id") else id(shared), alpha, seed)
    if key not in _samplers:
        _samplers.clear()
        _samplers[key] = Sampler(shared.value, alpha, seed)
    return _samplers[key]


def _passes(texts: list[str]) -> Iterator[slice]:
    """Slices of a batch of bounded size."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > PASS_CHARS:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


#: What encode can add: the ids, their number, a digest of them (32-bit little-endian), and whether decoding them gives the text.
ADDED = {"piece_ids": ArrayType(IntegerType()), "n_pieces": LongType(), "ids_sha256": StringType(), "lossless": BooleanType()}


def encode(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", add: tuple[str, ...] = ("piece_ids",), model: str | None = None, alpha: float = 1.0, seed: int = 1) -> DataFrame:
    """docs with the sampled piece ids of its texts, or what ADDED names of them, as further columns; no shuffle.

    Columns of these names are replaced.  lossless decodes the ids in the same
    task, so that they need not leave it.
    """
    docs = docs.drop(*add)
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(Vocabulary.load(model))
    at, key_at = docs.columns.index(text_col), docs.columns.index(key_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(shared, alpha, seed)
        for batch in batches:
            texts, keys = [t or "" for t in batch.column(at).to_pylist()], [str(k) for k in batch.column(key_at).to_pylist()]
            for part in _passes(texts):
                ids = sampler.encode(texts[part], keys[part])
                columns = {}
                if "piece_ids" in add:
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                    columns["piece_ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                if "n_pieces" in add:
                    columns["n_pieces"] = pa.array([len(x) for x in ids], pa.int64())
                if "ids_sha256" in add:
                    columns["ids_sha256"] = pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids], pa.string())
                if "lossless" in add:
                    columns["lossless"] = pa.array([sampler.decode(x.tolist()) == t for x, t in zip(ids, texts[part], strict=True)], pa.bool_())
                rows = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([*rows.columns, *(columns[c] for c in add)], names=[*batch.schema.names, *add])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *(StructField(c, ADDED[c]) for c in add)]))


def decode(rows: DataFrame, ids_col: str = "piece_ids", out_col: str = "decoded", model: str | None = None) -> DataFrame:
    """rows with the text of its piece ids as a further column, in place of one of that name."""
    rows = rows.drop(out_col)
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    at = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(shared, 1.0, 0)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([sampler.decode(x or []) for x in batch.column(at).to_pylist()], pa.string())], names=[*batch.schema.names, out_col])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *StructType().add(out_col, "string").fields]))


def op5_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: pieces, a digest of the ids, and whether decoding gave the text back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, add=("n_pieces", "ids_sha256", "lossless")).drop("text")
