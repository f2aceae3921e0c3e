"""Byte-level BPE encoding and decoding with a public vocabulary of ranks.

Pre-tokenisation runs no regex. Every code point has a class and every class is a transition function on eleven states; the
functions are composed block by block (composition is associative, so blocks are independent until their ends are chained),
which gives the state after each code point, and token starts follow from neighbouring states. The pieces are those of the
pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``. Each distinct piece is merged once and kept.

A worker keeps at most twice ``kept_pieces`` pieces and drops them when its task ends.

Null counts as empty: no tokens. Any Unicode text is encoded, and decoding gives back its UTF-8 bytes exactly. Texts are handled
whole; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import common

# classes: letter, number, space, other white space, other, apostrophe, s/t/m/d, r, v, l, e, end of text
_L, _N, _SP, _WS, _O, _AP, _STMD, _R, _V, _LL, _E, _END = range(12)
# states: start, letters, numbers, after a space, after other white space, others, apostrophe that begins a token, 'r, 'v, 'l, contraction done
START, LETTERS, NUMBERS, SPACE, WHITE, OTHER, APOSTROPHE, AR, AV, AL, DONE = range(11)
_S = 11


def _transitions() -> np.ndarray:
    t = np.zeros((12, _S), np.uint8)
    for c in (_L, _STMD, _R, _V, _LL, _E):
        t[c] = LETTERS
    t[_N], t[_SP], t[_WS], t[_O], t[_AP], t[_END] = NUMBERS, SPACE, WHITE, OTHER, APOSTROPHE, START
    t[_AP, [SPACE, OTHER, APOSTROPHE]] = OTHER
    t[_STMD, APOSTROPHE] = t[_LL, AL] = DONE
    t[_E, [AR, AV]] = DONE
    t[_R, APOSTROPHE], t[_V, APOSTROPHE], t[_LL, APOSTROPHE] = AR, AV, AL
    return t


def _classes() -> np.ndarray:
    of = np.full(sys.maxunicode + 1, _O, np.uint8)
    for i in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(i))[0]
        if kind in "LN":
            of[i] = _L if kind == "L" else _N
    # White_Space
    for i in (*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        of[i] = _WS
    of[32], of[39] = _SP, _AP
    for chars, c in (("stmd", _STMD), ("r", _R), ("v", _V), ("l", _LL), ("e", _E)):
        for ch in chars:
            of[ord(ch)] = c
    return of


_TABLES: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES:
        _TABLES.update(next=_transitions(), classes=_classes())
    return _TABLES["next"], _TABLES["classes"]


def states(classes: np.ndarray, block: int = 512, slab: int = 1 << 20) -> np.ndarray:
    """State after each code point, by a blocked scan over composed transition functions; a slab at a time, so that one long text needs little more than its own length."""
    step = _tables()[0].ravel()
    n, s = len(classes), START
    out = np.empty(n, np.uint8)
    for low in range(0, n, slab):
        own = classes[low : low + slab]
        rows = -(-len(own) // block)
        padded = np.full(rows * block, _END, np.uint8)
        padded[: len(own)] = own
        at = padded.reshape(rows, block).T.astype(np.intp) * _S  # one row for each place in a block
        whole = np.tile(np.arange(_S, dtype=np.uint8), (rows, 1))
        for a in at:
            whole = step[a[:, None] + whole]
        entry = np.zeros(rows, np.uint8)
        for i, f in enumerate(whole.tolist()):
            entry[i] = s
            s = f[s]
        held = np.empty((block, rows), np.uint8)
        for j, a in enumerate(at):
            entry = step[a + entry]
            held[j] = entry
        out[low : low + len(own)] = held.T.ravel()[: len(own)]
        s = int(out[low + len(own) - 1])
    return out


def token_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where tokens begin in concatenated texts; ends: places of the code point that follows each text, itself a start."""
    cls = _tables()[1][points]
    cls[ends] = _END
    s = states(cls)
    before, after = np.r_[np.uint8(START), s[:-1]], np.r_[s[1:], np.uint8(START)]
    white, white_before, white_after = (s == SPACE) | (s == WHITE), (before == SPACE) | (before == WHITE), (after == SPACE) | (after == WHITE)
    next_end = np.r_[cls[1:] == _END, True]
    start = np.empty(len(s), bool)
    # white space: first of its run, or last of it with text behind
    start[:] = white & (~white_before | (~white_after & ~next_end))
    start |= (s == OTHER) & ~np.isin(before, (OTHER, APOSTROPHE, SPACE))
    start |= s == APOSTROPHE
    start |= (s == NUMBERS) & (before != NUMBERS) & (before != SPACE)
    start |= (s == LETTERS) & ~np.isin(before, (LETTERS, AR, AV, AL, SPACE))
    start |= np.isin(s, (AR, AV, AL)) & (after != DONE)
    return start | (cls == _END)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Lowest rank first, leftmost of equals."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    n = len(parts)
    if n > 48:  # a heap over a linked list
        right, left, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(ranks[p], i, p) for i in range(n - 1) if (p := parts[i] + parts[i + 1]) in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            if not alive[i] or (j := right[i]) >= n or parts[i] + parts[j] != p:
                continue
            parts[i], alive[j], right[i] = p, False, right[j]
            if right[j] < n:
                left[right[j]] = i
            for k in (left[i], i):
                if k >= 0 and right[k] < n and (q := parts[k] + parts[right[k]]) in ranks:
                    heapq.heappush(heap, (ranks[q], k, q))
        return [ranks[p] for p, a in zip(parts, alive) if a]
    get, none = ranks.get, 1 << 62
    pairs = [get(parts[i] + parts[i + 1], none) for i in range(n - 1)]
    while pairs and (r := min(pairs)) < none:
        i = pairs.index(r)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


class _Pieces:
    """Piece to its ids, packed. Two generations of at most ``limit`` pieces each: what is used moves to the new one, the old one goes
    when that is full. Pieces of more than 64 bytes are not kept. So a worker holds some 30 MB at the default limit, whatever it reads.
    """

    def __init__(self, ranks: dict[bytes, int], limit: int):
        self.ranks, self.limit, self.new, self.old = ranks, limit, {}, {}

    def pack(self, piece: bytes) -> bytes:
        """Ids of a piece that is not in the new generation, four bytes each."""
        found = self.old.get(piece)
        if found is None:
            found = np.array(merge(piece, self.ranks), "<u4").tobytes()
            if len(piece) > 64:
                return found
        if len(self.new) >= self.limit:
            self.old, self.new = self.new, {}
        self.new[piece] = found
        return found

    def clear(self) -> None:
        self.new, self.old = {}, {}


def distinct_slices(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one place of each distinct slice, for each slice which of them it is). Slices of up to 15 bytes are compared as two words, found by a hash of them; if two
    different ones had one hash, or a slice is longer, each stands for itself.
    """
    n = end - begin
    short = np.flatnonzero(n <= 15)
    padded = np.r_[raw, np.zeros(16, np.uint8)].astype(np.uint64)
    words = []
    for low in (0, 8):
        w = np.zeros(len(short), np.uint64)
        for k in range(low, min(low + 8, 15)):
            w |= np.where(n[short] > k, padded[begin[short] + k], np.uint64(0)) << np.uint64(8 * (k - low))
        words.append(w)
    words[1] |= n[short].astype(np.uint64) << np.uint64(56)
    with np.errstate(over="ignore"):
        _, first, which = np.unique(common.mix(words[0] * np.uint64(0x9E3779B97F4A7C15) + common.mix(words[1])), return_index=True, return_inverse=True)
    if not all((w[first][which] == w).all() for w in words):
        first = which = np.arange(len(short))
    long = np.flatnonzero(n > 15)
    of = np.empty(len(n), np.int64)
    of[short], of[long] = which, len(first) + np.arange(len(long))
    return np.r_[short[first], long], of


class Codec:
    """Encoder and decoder over a rank file's content."""

    def __init__(self, content: bytes, kept_pieces: int = 80_000):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in content.splitlines() if x)}
        self.token = [b""] * (max(self.ranks.values()) + 1)
        for k, v in self.ranks.items():
            self.token[v] = k
        self.decimal = [str(i) for i in range(len(self.token))]
        self.pieces = _Pieces(self.ranks, kept_pieces)

    def tokens(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Distinct pieces of the texts are looked up or merged once, all others get their ids by gathering."""
        if not texts:
            return []
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        starts = np.flatnonzero(token_starts(points, ends))
        data = joined.encode()
        at = np.r_[0, np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), dtype=np.int64)]
        bounds = np.searchsorted(starts, ends)  # where each text's end stands among the starts
        own = np.ones(len(starts), bool)
        own[bounds] = False
        begin, end = at[starts[:-1]][own[:-1]], at[starts[1:]][own[:-1]]
        places, of = distinct_slices(np.frombuffer(data, np.uint8), begin, end)
        known, pack = self.pieces, self.pieces.pack
        packed = [known.new.get(p) or pack(p) for p in (data[i:j] for i, j in zip(begin[places].tolist(), end[places].tolist()))]
        ids, sizes = np.frombuffer(b"".join(packed), "<u4"), np.fromiter((len(x) // 4 for x in packed), np.int64, len(packed))
        offsets = np.cumsum(np.r_[0, sizes])[:-1] if len(sizes) else sizes
        counts = sizes[of]
        upto = np.cumsum(np.r_[0, counts])
        flat = ids[np.repeat(offsets[of] - upto[:-1], counts) + np.arange(upto[-1])]
        cuts = upto[bounds - np.arange(len(bounds))]  # of the starts before a text's end, one a text is itself an end
        return np.split(flat, cuts[:-1])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.tolist() for x in self.tokens(texts)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def offsets(self, ids: list[int]) -> list[int]:
        """Byte offset at which each token begins."""
        return np.cumsum([0, *[len(self.token[i]) for i in ids]])[:-1].tolist()


_CODEC: dict[int, Codec] = {}


def _codec(content) -> Codec:
    if content.id not in _CODEC:
        _CODEC.clear()
        _CODEC[content.id] = Codec(content.value)
    return _CODEC[content.id]


class _Shared:
    """A broadcast of the rank file (about 1 MB), known by its id in the workers."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as f:
            self.held = spark.sparkContext.broadcast(f.read())
        self.id = self.held._jbroadcast.id()

    def __getstate__(self):
        return {"held": self.held, "id": self.id}

    @property
    def value(self) -> bytes:
        return self.held.value


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _texts(column) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def _sliced(texts: list[str]):
    yield from common.chunks(texts, 400_000)


def _map(df: DataFrame, schema: str, work) -> DataFrame:
    """Work takes a record batch and the texts' list and yields record batches; text is the last column."""

    def run(batches):
        try:
            for b in common.small(batches):
                texts = _texts(b.columns[-1])
                for i, j in _sliced(texts):
                    yield work(b.slice(i, j - i), texts[i:j])
        finally:  # workers are reused by other stages
            for codec in _CODEC.values():
                codec.pieces.clear()
            common.release()

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids, offsets): token ids and the byte at which each begins."""
    shared = _Shared(df.sparkSession, path or default_path())

    def work(b, texts):
        import pyarrow as pa

        codec = _codec(shared)
        ids = codec.encode(texts)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([codec.offsets(x) for x in ids], pa.list_(pa.int64()))], [id, "ids", "offsets"])

    kind = df.schema[id].dataType.simpleString()
    return _map(df.select(id, text), f"{id} {kind}, ids array<int>, offsets array<long>", work)


def decode(df: DataFrame, id: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(id, bytes) of token ids; null counts as none."""
    shared = _Shared(df.sparkSession, path or default_path())

    def run(batches):
        import pyarrow as pa

        for b in batches:
            codec = _codec(shared)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec.decode(x or []) for x in b.column(1).to_pylist()], pa.binary())], [id, "bytes"])

    return df.select(id, ids).mapInArrow(run, f"{id} {df.schema[id].dataType.simpleString()}, bytes binary")


def digests(df: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encoding and decoding in one task, for round-trip checks over whole tables."""
    shared = _Shared(df.sparkSession, path or default_path())

    def work(b, texts):
        import pyarrow as pa

        codec = _codec(shared)
        counts, ids_sha, decoded_sha = [], [], []
        for ids in codec.encode(texts):
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(map(codec.decimal.__getitem__, ids)).encode()).hexdigest())
            decoded_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)], [id, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id].dataType.simpleString()
    return _map(df.select(id, text), f"{id} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", work)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))


QUERIES = {"op7_byte_bpe": op7_byte_bpe}
ORACLE: dict[str, str] = {}
