"""SentencePiece encoding and decoding with a batched numpy Viterbi.

Texts are cut into units (a run of spaces with the run of other characters after it; pieces never cross units), and
each distinct unit of a batch is encoded once. Units of equal length advance together: at every position the substrings
that end there are probed by polynomial hashes in the sorted piece keys, and a vectorised maximum over the candidates
stores the backpointer.

The models read are BPE models with identity normalisation; any other file is refused. There the library's merges, not a
sum of scores, decide, so a step is allowed only if the two pieces are one another's neighbours in the merges' own
result, and the lattice has one complete path, the library's. Whether two pieces can stand side by side follows from
their merge trees alone and is remembered per pair. Characters without a piece become byte pieces. Long units are first
cut between characters that stand side by side in no piece, which no merge can join.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, slices, text_or_empty, worker_cache

SPACE, CUT = "▁", "\x1f"
#: Distinct units that a worker remembers, texts per step in bytes, positions of a chunk of units advanced together.
MEMORY_UNITS, SLICE, CHUNK_CELLS = 600_000, 2 << 20, 1 << 20
PAIR_SLOTS, SIEVE_BITS = 1 << 20, 20
#: Units of more characters are cut first.
LONG = 48
BASE = np.uint64(0x9E3779B97F4A7C15)


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protobuf message: varints, fixed32 and length-delimited fields."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[i : i + n]
            i += n
        elif kind == 5:
            yield key >> 3, struct.unpack("<f", data[i : i + 4])[0]
            i += 4
        else:
            yield key >> 3, data[i : i + 8]
            i += 8


class Model:
    """Pieces, scores and kinds of a SentencePiece model file (identity normalisation, dummy prefix, byte fallback)."""

    NORMAL, UNK, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

    def __init__(self, data: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        train, normal = {}, {}
        for no, value in _fields(data):
            if no == 1:
                piece, score, kind = "", 0.0, 1
                for k, v in _fields(value):
                    if k == 1:
                        piece = v.decode("utf-8")
                    elif k == 2:
                        score = v
                    elif k == 3:
                        kind = v
                self.pieces.append(piece)
                self.scores.append(score)
                self.kinds.append(kind)
            elif no == 2:
                train = dict(_fields(value))
            elif no == 3:
                normal = dict(_fields(value))
        self.prefix = bool(normal.get(3, 1))
        # what a file may ask for beyond this reader would give other ids without an error
        for odd, what in (
            (train.get(3, 1) != 2, "a model that is not BPE"), (train.get(24, 0), "white space as a suffix"), (normal.get(2, b""), "a character map"), (normal.get(4, 1), "removal of extra white space"),
            (not normal.get(5, 1), "white space that is not escaped"), (self.USER in self.kinds, "pieces that users define"),
        ):
            if odd:
                raise ValueError(f"unsupported SentencePiece model: it has {what}")
        self.byte0 = next((i for i, k in enumerate(self.kinds) if k == self.BYTE), None)
        self.unk = next((i for i, k in enumerate(self.kinds) if k == self.UNK), 0)
        ids = [i for i, k in enumerate(self.kinds) if k in (self.NORMAL, self.USER)]
        self.id_of = {self.pieces[i]: i for i in ids}
        self.longest = max(map(len, self.id_of), default=1)
        keys = np.array([self._hash(p) for p in self.id_of], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array(list(self.id_of.values()), np.int64)[order]
        if (np.diff(self.keys) == 0).any():
            raise ValueError("piece hashes collide")
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[self.keys >> np.uint64(64 - SIEVE_BITS)] = True
        n = len(self.pieces)
        self.hash = np.zeros(n, np.uint64)
        self.hash[self.key_ids] = self.keys
        self.size = np.array([len(p) for p in self.pieces], np.int64)
        self.power = np.ones(self.longest * 2 + 2, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(1, len(self.power)):
                self.power[i] = self.power[i - 1] * BASE
        self.text_pool, self.chunk = None, CHUNK_CELLS
        self.letters = set("".join(self.id_of))
        self.score = np.array(self.scores, np.float64)
        self.beside = {p[i : i + 2] for p in self.id_of for i in range(len(p) - 1)}
        # remembered answers of neighbours(), one per slot; a later pair takes the slot over
        self.pair_keys, self.pair_ok = np.full(PAIR_SLOTS, -1), np.empty(PAIR_SLOTS, bool)
        self._merge_trees()

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of hashes; -1 where there is none. A bit sieve spares most failing probes of the sorted keys."""
        out = np.full(h.shape, -1)
        may = np.nonzero(self.sieve[h >> np.uint64(64 - SIEVE_BITS)])
        probe = h[may]
        at = np.minimum(np.searchsorted(self.keys, probe), len(self.keys) - 1)
        out[may] = np.where(self.keys[at] == probe, self.key_ids[at], -1)
        return out

    def _merge_trees(self) -> None:
        """Left and right half of each piece's last merge (-1: a single character), by merging the piece on its own."""
        n = len(self.pieces)
        self.left, self.right = np.full(n, -1), np.full(n, -1)
        self.alone = np.zeros(n, bool)  # the merges of the piece's own text give the piece
        score, id_of = self.scores, self.id_of
        for piece, i in id_of.items():
            parts = list(piece)
            last = None
            while len(parts) > 1:
                best = None
                for j in range(len(parts) - 1):
                    k = id_of.get(parts[j] + parts[j + 1])
                    if k is not None and (best is None or score[k] > best[0]):
                        best = (score[k], j)
                if best is None:
                    break
                j = best[1]
                last = (parts[j], parts[j + 1])
                parts[j : j + 2] = [parts[j] + parts[j + 1]]
            self.alone[i] = len(parts) == 1
            if self.alone[i] and last and last[0] in id_of and last[1] in id_of:
                self.left[i], self.right[i] = id_of[last[0]], id_of[last[1]]

    def neighbours(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges leave pieces a and b side by side, for arrays of ids (-1: a character without a piece)."""
        ok = np.ones(len(a), bool)
        real = np.flatnonzero((a >= 0) & (b >= 0))
        pairs = a[real] * len(self.pieces) + b[real]
        slot = (pairs * 0x9E3779B1 >> 8) & (len(self.pair_keys) - 1)
        miss = np.flatnonzero(self.pair_keys[slot] != pairs)
        good = self.pair_ok[slot]
        if len(miss):
            new, at = np.unique(pairs[miss], return_inverse=True)
            fresh = self._apart(new // len(self.pieces), new % len(self.pieces))
            good[miss] = fresh[at]
            self.pair_keys[slot[miss]], self.pair_ok[slot[miss]] = pairs[miss], fresh[at]
        ok[real] = good
        return ok

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Follow the right edge of a's merge tree and the left edge of b's from the characters up.

        x and y are the pieces at the boundary at some time. Each next turns into its parent by a merge of that
        parent's score; if x and y form a piece that comes before both of these merges, the boundary is merged away.
        Of merges of equal score the leftmost comes first.
        """
        n = len(a)
        edge_a, edge_b = [a], [b]
        while (self.right[edge_a[-1]] >= 0).any():
            edge_a.append(np.where(self.right[edge_a[-1]] >= 0, self.right[edge_a[-1]], edge_a[-1]))
        while (self.left[edge_b[-1]] >= 0).any():
            edge_b.append(np.where(self.left[edge_b[-1]] >= 0, self.left[edge_b[-1]], edge_b[-1]))
        ea, eb = np.array(edge_a), np.array(edge_b)
        # height of each: first row at which the edge has reached a character
        ia, ib = (ea[1:] != ea[:-1]).sum(axis=0), (eb[1:] != eb[:-1]).sum(axis=0)
        ok, live = np.ones(n, bool), np.arange(n)
        with np.errstate(over="ignore"):
            while len(live):
                x, y = ea[ia[live], live], eb[ib[live], live]
                up_x = np.where(ia[live] > 0, self.score[ea[np.maximum(ia[live] - 1, 0), live]], -np.inf)
                up_y = np.where(ib[live] > 0, self.score[eb[np.maximum(ib[live] - 1, 0), live]], -np.inf)
                joined = self.find(self.hash[x] * self.power[self.size[y]] + self.hash[y])
                s = np.where(joined >= 0, self.score[joined], -np.inf)
                # x's merge lies left of the boundary's, y's right of it
                gone = (joined >= 0) & (s > up_x) & (s >= up_y)
                ok[live[gone]] = False
                first_x = (up_x >= up_y) & (ia[live] > 0)
                step_y = ~first_x & (ib[live] > 0)
                more = ~gone & (first_x | step_y)
                ia[live[more & first_x]] -= 1
                ib[live[more & step_y]] -= 1
                live = live[more]
        return ok

    def _paths(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For a matrix of code points (units x length): per unit the piece that ends at each position on the best path to it, and its length."""
        n, length = codes.shape
        with np.errstate(over="ignore"):
            prefix = np.zeros((n, length + 1), np.uint64)
            for i in range(length):
                prefix[:, i + 1] = prefix[:, i] * BASE + codes[:, i].astype(np.uint64) + np.uint64(1)
            best = np.full((n, length + 1), -np.inf)
            best[:, 0] = 0
            last = np.full((n, length + 1), -1)
            back = np.ones((n, length + 1), np.int64)
            for end in range(1, length + 1):
                widths = np.arange(1, min(self.longest, end) + 1)
                ids = self.find(prefix[:, end] - prefix[:, end - widths].T * self.power[widths][:, None])
                gain = np.full(ids.shape, -np.inf)
                k, at = np.nonzero(ids >= 0)
                came = end - widths[k]
                on = self.alone[ids[k, at]] & (best[at, came] == 0)
                k, at, came = k[on], at[on], came[on]
                # no piece comes before the first: -1 stands next to any
                gain[k, at] = np.where(self.neighbours(last[at, came], ids[k, at]), 0, -np.inf)
                bare = np.flatnonzero(ids[0] < 0)
                gain[0, bare] = best[bare, end - 1]
                pick = gain.argmax(axis=0)
                rows = np.arange(n)
                best[:, end], last[:, end], back[:, end] = gain[pick, rows], ids[pick, rows], pick + 1
        return last, back

    def _bytes(self, char: str) -> list[int]:
        return [self.byte0 + b for b in char.encode("utf-8", "surrogatepass")] if self.byte0 is not None else [self.unk]

    def _cut(self, unit: str) -> list[str]:
        """A unit's parts that no merge can join."""
        ends = [i for i in range(1, len(unit)) if unit[i - 1 : i + 1] not in self.beside]
        return [unit[i:j] for i, j in zip([0, *ends], [*ends, len(unit)])]

    def encode_units(self, units: list[str]) -> list[np.ndarray]:
        """Ids of each unit; units of equal length advance together, in chunks of bounded size."""
        long = [i for i, u in enumerate(units) if len(u) > LONG]
        if not long:
            return self._encode_units(units)
        parts = {i: self._cut(units[i]) for i in long}
        distinct = list(dict.fromkeys(p for i, u in enumerate(units) for p in parts.get(i, (u,))))
        ids = dict(zip(distinct, self._encode_units(distinct)))
        return [np.concatenate([ids[p] for p in parts[i]]) if i in parts else ids[u] for i, u in enumerate(units)]

    def _encode_units(self, units: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(units)
        by: dict[int, list[int]] = {}
        for i, u in enumerate(units):
            by.setdefault(len(u), []).append(i)
        for length, members in by.items():
            if length == 0:
                for i in members:
                    out[i] = np.empty(0, np.int32)
                continue
            step = max(1, self.chunk // (length * 24))
            for s in range(0, len(members), step):
                part = members[s : s + step]
                codes = np.frombuffer("".join(units[i] for i in part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), length)
                last, back = self._paths(codes)
                n = len(part)
                at, on = np.full(n, length), np.arange(n)
                ids, count = np.empty((n, length), np.int64), np.zeros(n, np.int64)
                starts = np.empty((n, length), np.int64)
                while len(on):
                    p = at[on]
                    at[on] = p - back[on, p]
                    ids[on, count[on]] = last[on, p]
                    starts[on, count[on]] = at[on]
                    count[on] += 1
                    on = on[at[on] > 0]
                for k, i in enumerate(part):
                    row = ids[k, : count[k]][::-1]
                    if (row < 0).any():
                        where = starts[k, : count[k]][::-1]
                        row = np.array([x for v, w in zip(row.tolist(), where.tolist()) for x in ([v] if v >= 0 else self._bytes(units[i][w]))])
                    out[i] = row.astype(np.int32)
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def _units(self, text: str) -> list[str]:
        """Units of any text: runs of spaces with what follows them."""
        t = (" " + text if self.prefix and text else text).replace(SPACE, " ")
        out, spaces = [], 0
        for k, u in enumerate(t.split(" ")):
            spaces += k > 0
            if u:
                out.append(SPACE * spaces + u)
                spaces = 0
        return [*out, SPACE * spaces] if spaces else out

    def encode_batch(self, texts: list[str], memory: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids per text)."""
        memory = {} if memory is None else memory
        lines = pa.array(texts, pa.string())
        odd = pc.or_(pc.match_substring(lines, "  "), pc.or_(pc.match_substring(lines, SPACE), pc.or_(pc.match_substring(lines, CUT), pc.or_(pc.starts_with(lines, " "), pc.equal(lines, ""))))).to_pylist()
        if self.prefix and not any(odd) and "\n" not in self.letters:
            # no run of spaces: each space starts a unit, and so may a line end, which occurs in no piece
            t = pc.replace_substring(pc.replace_substring(lines, " ", CUT + SPACE), "\n", CUT + "\n")
            split = pc.split_pattern(pc.binary_join_element_wise(SPACE, t, ""), CUT)
        else:
            split = pa.array([self._units(t) for t in texts], pa.list_(pa.string()))
        flat = split.flatten().dictionary_encode()
        units = flat.dictionary.to_pylist()
        new = [u for u in units if u not in memory]
        for u, ids in zip(new, self.encode_units(new)):
            memory[u] = ids
        coded = [memory[u] for u in units]
        if not coded:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        pool = np.concatenate(coded)
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        codes = flat.indices.to_numpy(zero_copy_only=False)
        n = size[codes]
        ends = np.concatenate(([0], np.cumsum(n)))
        out = pool[np.repeat((np.cumsum(size) - size)[codes] - ends[:-1], n) + np.arange(int(ends[-1]))]
        return out, np.diff(ends[split.offsets.to_numpy() - split.offsets[0].as_py()])

    def decode_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids' pieces, spaces restored; bytes per id)."""
        if self.text_pool is None:
            raw = []
            for i, (piece, kind) in enumerate(zip(self.pieces, self.kinds)):
                raw.append(bytes([i - self.byte0]) if kind == self.BYTE else b"" if kind == self.CONTROL else " ⁇ ".encode() if kind == self.UNK else piece.replace(SPACE, " ").encode())
            self.text_size = np.array(list(map(len, raw)))
            self.text_pool = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(self.text_size) - self.text_size
        n = self.text_size[ids]
        ends = np.cumsum(n)
        return self.text_pool[0][np.repeat(self.text_pool[1][ids] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)], n

    def decode_batch(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each run of ids, the dummy prefix dropped."""
        data, n = self.decode_bytes(ids)
        ends = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(counts)))]
        raw = data.tobytes()
        skip = 1 if self.prefix else 0
        return [raw[s + skip : e] if skip and raw[s : s + 1] == b" " and e > s else raw[s:e] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def decode(self, ids) -> str:
        return self.decode_batch(np.asarray(ids, np.int64), np.array([len(ids)]))[0].decode("utf-8", "replace")


def _model(path: str) -> Model:
    cache = worker_cache("sentencepiece")
    if path not in cache:
        with open(path, "rb") as f:
            cache[path] = Model(f.read())
    return cache[path]


def encode(docs: DataFrame, path: str, *keys: str, units: int = MEMORY_UNITS, most: int = SLICE, cells: int = CHUNK_CELLS) -> DataFrame:
    """Key columns, ``ids`` (little-endian uint32 in a binary), ``n_ids``, ``ids_crc32`` and ``exact``.

    ``exact``: decoding gives the text back (white-space marks U+2581 in a text come back as spaces). ``path`` must be
    readable on the executors. A null text is empty and has no ids; repeated rows keep their number; an empty table
    gives an empty result. Long texts are encoded whole. ``units``, ``most`` and ``cells`` trade a worker's memory for time
    and change no result.
    """
    nk = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        model.chunk = cells
        memory = worker_cache("sentencepiece units " + path)
        for b in batches:
            # only a slice of the texts at a time becomes Python strings
            for i, j in slices([range(n) for n in pc.binary_length(b.column(nk)).to_pylist()], most):
                texts = b.column(nk).slice(i, j - i).to_pylist()
                if len(memory) > units:
                    memory.clear()
                ids, n = model.encode_batch(texts, memory)
                data, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(n)
                raw = [data[e - 4 * k : e] for e, k in zip(ends.tolist(), n.tolist())]
                exact = [x == t.encode("utf-8", "surrogatepass").replace(b"\xe2\x96\x81", b" ") for x, t in zip(model.decode_batch(ids, n), texts)]
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(i, j - i) for c in b.columns[:nk]), pa.array(raw, pa.binary()), pa.array(n), pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.array(exact)],
                    [*keys, "ids", "n_ids", "ids_crc32", "exact"],
                )

    rows = text_or_empty(docs, *keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(frugal("sentencepiece", run), f"{schema}, ids binary, n_ids long, ids_crc32 long, exact boolean")


def decode(coded: DataFrame, path: str, *keys: str) -> DataFrame:
    """Key columns and the ``text`` of ``ids``; null ids give a null text."""
    nk = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for b in batches:
            coded = [np.frombuffer(x or b"", "<u4").astype(np.int64) for x in b.column(nk).to_pylist()]
            raw = model.decode_batch(np.concatenate(coded), np.array(list(map(len, coded)))) if coded else []
            texts = [x.decode("utf-8", "replace") if ok else None for x, ok in zip(raw, b.column(nk).is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:nk], pa.array(texts, pa.string())], [*keys, "text"])

    rows = coded.select(*[F.col(f"`{k}`") for k in keys], "ids")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(frugal("sentencepiece", run), f"{schema}{', ' if nk else ''}text string")
