"""SentencePiece encoding and decoding of BPE models, with the span of the original that every piece comes from.

The model file is read here: pieces, scores, normaliser settings and the compiled character map, a double-array trie of byte sequences
with their replacements. Normalisation walks the text and replaces the longest prefix that the trie holds; every code point of the normalised text
carries the byte of the original at which its replaced stretch begins, so pieces are projected back to spans of original bytes.

Between two code points that no piece of the vocabulary holds side by side nothing is ever merged. The normalised texts of a batch are cut at all such places
(two table look-ups a code point); distinct slices are merged once (highest score first, leftmost of equals) and kept. A worker keeps at most
twice ``kept_slices`` slices and drops them when its task ends. Characters without a piece become one piece for each of their bytes, if the model has those.

Null counts as empty: no tokens. Texts are handled whole, at some 90 bytes of memory for each character (measured on a text of 4.8 million); repeated rows give repeated results; an empty table gives an empty result.
Models of another kind than BPE, with user-defined pieces or with white space as a suffix are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, common

SPACE = "▁"
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5


def _fields(data: bytes):
    """(number, value) of a message's fields; values are integers, or bytes for strings, messages and fixed-width numbers."""
    at, n = 0, len(data)

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < n:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            size = varint()
        yield key >> 3, data[at : at + size]
        at += size


class Model:
    """What a model file says. Field numbers are those of the published message format."""

    def __init__(self, content: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        normalizer: dict = {}
        for number, value in _fields(content):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3, 1) != 2 or trainer.get(24, 0) or any(kind == USER for _, _, kind in self.pieces):
            raise ValueError("only BPE models without user-defined pieces and with white space as a prefix are read")
        self.bytes_for_unknown = bool(trainer.get(35, 0))
        self.unknown_text = trainer[44].decode() if 44 in trainer else " ⁇ "
        self.charsmap = normalizer.get(2, b"")
        self.dummy_prefix, self.trim, self.escape = (bool(normalizer.get(k, 1)) for k in (3, 4, 5))


class CharMap:
    """A compiled character map: longest prefix of bytes to its replacement."""

    def __init__(self, compiled: bytes):
        size = struct.unpack("<I", compiled[:4])[0] if compiled else 0
        self.units = np.frombuffer(compiled[4 : 4 + size], "<u4").tolist()
        self.strings = compiled[4 + size :]
        self.first = {b for b in range(256) if self.units and self._step(self._root(), b) is not None}

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def _root(self) -> int:
        return self._offset(self.units[0])

    def _step(self, at: int, byte: int) -> int | None:
        """Place of the child by a byte, or None; at is the place that the children's bytes are combined with."""
        k = at ^ byte
        return k if k < len(self.units) and self.units[k] & 0x800000FF == byte else None

    def longest(self, data: bytes, start: int) -> tuple[int, bytes] | None:
        """(length, replacement) of the longest key that data has at start."""
        at, found = self._root(), None
        for i in range(start, len(data)):
            k = self._step(at, data[i])
            if k is None:
                break
            unit = self.units[k]
            at = k ^ self._offset(unit)
            if unit >> 8 & 1:
                found = i + 1 - start, self.units[at] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.strings[found[1] : self.strings.index(b"\0", found[1])]


class Normalizer:
    def __init__(self, model: Model):
        self.map, self.prefix, self.trim = CharMap(model.charsmap), model.dummy_prefix, model.trim
        self.space = SPACE if model.escape else " "
        self.plain = not self.map.units and not self.trim

    def chunks(self, data: bytes):
        """(replacement, place, length) of each stretch of the original: a key of the map, or else one code point as it is."""
        at = 0
        while at < len(data):
            hit = self.map.longest(data, at) if data[at] in self.map.first else None
            if hit:
                yield hit[1].decode(), at, hit[0]
                at += hit[0]
            else:
                b = data[at]
                n = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                yield data[at : at + n].decode(), at, n
                at += n

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its code points, and its end, the byte of the original where its stretch begins."""
        if not text:
            return "", np.zeros(1, np.int64)
        if self.plain:
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            places = np.cumsum(np.r_[0, widths(points)])
            out = text.replace(" ", self.space)
            return (self.space + out, np.r_[0, places]) if self.prefix else (out, places)
        out: list[str] = []
        places: list[int] = []
        data = text.encode()
        blank, end = self.trim, 0  # blank: what stands before ends with a space, at the start as well
        for s, at, n in self.chunks(data):
            end = at + n
            if not places and self.trim and s == " ":
                continue
            if not places and self.prefix:
                out.append(self.space)
                places.append(at)
            if blank:
                s = s.lstrip(" ")
            if s:
                out.extend(self.space if c == " " else c for c in s)
                places.extend([at] * len(s))
                blank = s[-1] == " "
            blank = blank and self.trim
        if self.trim:
            while out and out[-1] == self.space:
                out.pop()
                end = places.pop()
        return "".join(out), np.array([*places, end], np.int64)


def widths(points: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of each code point."""
    return 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)


def merge(parts: list[int], rank: dict[int, int], joined: dict[int, int], base: int) -> tuple[list[int], list[int]]:
    """Neighbours a, b with a rank for a * base + b are joined to joined[a * base + b], the lowest rank first, leftmost of equals, until there are none.
    What is left, and how many of the parts each of it was."""
    n, none = len(parts), 1 << 62
    wide = [1] * n
    if n > 48:  # a heap over a linked list
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, k) for i, k in enumerate([a * base + b for a, b in zip(parts, parts[1:])]) if (r := rank.get(k)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, k = heapq.heappop(heap)
            if not wide[i] or (j := right[i]) >= n or parts[i] * base + parts[j] != k:
                continue
            parts[i], right[i] = joined[k], right[j]
            wide[i], wide[j] = wide[i] + wide[j], 0
            if right[j] < n:
                left[right[j]] = i
            for at in (left[i], i):
                if at >= 0 and right[at] < n and (r := rank.get(k := parts[at] * base + parts[right[at]])) is not None:
                    heapq.heappush(heap, (r, at, k))
        return [p for p, w in zip(parts, wide) if w], [w for w in wide if w]
    get = rank.get
    pairs = [get(a * base + b, none) for a, b in zip(parts, parts[1:])]
    while pairs and (best := min(pairs)) < none:
        i = pairs.index(best)
        own = parts[i] = joined[parts[i] * base + parts[i + 1]]
        wide[i] += wide[i + 1]
        del parts[i + 1], wide[i + 1], pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] * base + own, none)
        if i < len(pairs):
            pairs[i] = get(own * base + parts[i + 1], none)
    return parts, wide


class Codec:
    """Encoder and decoder over a model file's content."""

    def __init__(self, content: bytes, kept_slices: int = 200_000):
        model = Model(content)
        self.normalize, self.unknown_text = Normalizer(model), model.unknown_text
        self.limit, self.new, self.old = kept_slices, {}, {}
        own = [(p, s, i) for i, (p, s, kind) in enumerate(model.pieces) if kind in (NORMAL, UNUSED)]
        order = {s: k for k, s in enumerate(sorted({s for _, s, _ in own}, reverse=True))}
        # numbers of all that can stand in a partly merged slice: pieces, and after them characters of pieces that are none themselves
        self.number = {p: i for p, _, i in own}
        for c in sorted({c for p, _, _ in own for c in p} - self.number.keys()):
            self.number[c] = len(model.pieces) + len(self.number)
        self.base = 2 * len(model.pieces) + len(self.number) + 1
        self.rank, self.joined = {}, {}
        for p, score, i in own:
            for k in range(1, len(p)):
                if (x := self.number.get(p[:k])) is not None and (y := self.number.get(p[k:])) is not None:
                    self.rank[x * self.base + y], self.joined[x * self.base + y] = order[score], i
        self.never = {p for p, _, kind in model.pieces if kind == UNUSED}
        self.parts_of = {i: self._split(p) for i, (p, _, kind) in enumerate(model.pieces) if kind == UNUSED}
        self.unknown = next(i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN)
        of_byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(model.pieces) if kind == BYTE}
        self.of_byte = [of_byte[b] for b in range(256)] if model.bytes_for_unknown and len(of_byte) == 256 else None
        self.kinds = np.array([kind for _, _, kind in model.pieces], np.int8)
        self.byte_of = {i: b for b, i in of_byte.items()}
        # what a piece is in decoded text; the first drops one space if the model put it there
        self.text = [b"" if kind == CONTROL else self.unknown_text.encode() if kind == UNKNOWN else bytes([self.byte_of[i]]) if kind == BYTE else p.replace(SPACE, " ").encode() for i, (p, _, kind) in enumerate(model.pieces)]
        self.decimal = [str(i) for i in range(len(model.pieces))]
        # classes of code points that stand beside others in pieces, and which classes do so
        beside = {(ord(a), ord(b)) for p, _, _ in own for a, b in zip(p, p[1:])}
        chars = sorted({c for pair in beside for c in pair})
        self.classes = np.zeros(0x110000, np.uint16)
        self.classes[chars] = np.arange(1, len(chars) + 1)
        self.together = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for a, b in beside:
            self.together[self.classes[a], self.classes[b]] = True

    # ------------------------------------------------------------ slices

    def _split(self, piece: str) -> list[str]:
        """A piece that the model lists but never gives out, as the two it is best merged from, and so on."""
        halves = [(self.rank[k], piece[:i], piece[i:]) for i in range(1, len(piece)) if (k := self.number.get(piece[:i], 0) * self.base + self.number.get(piece[i:], 0)) in self.rank]
        return [y for x in min(halves)[1:] for y in (self._split(x) if x in self.never else [x])] if halves else [piece]

    def _pack(self, piece: bytes) -> bytes:
        """(id, width) of each token of a slice, four bytes each; the width counts code points: a byte piece has 0, its character's last one 1."""
        found = self.old.get(piece)
        if found is None:
            text = piece.decode()
            number, rows, at = self.number, [], 0
            for i, w in zip(*merge([number.get(c, -1) for c in text], self.rank, self.joined, self.base)):
                if 0 <= i < len(self.kinds) and i not in self.parts_of:
                    rows += (i, w)
                else:
                    for q in self.parts_of.get(i, [text[at : at + w]]):
                        self._odd(q, rows)
                at += w
            found = np.array(rows, "<u4").tobytes()
            if len(piece) > 64:
                return found
        if len(self.new) >= self.limit:
            self.old, self.new = self.new, {}
        self.new[piece] = found
        return found

    def _odd(self, piece: str, rows: list[int]) -> None:
        """A part of an unused piece, or a character that is no piece."""
        if 0 <= (i := self.number.get(piece, -1)) < len(self.kinds):
            rows += (i, len(piece))
        elif self.of_byte is None:
            rows += (self.unknown, len(piece))
        else:
            rows += (x for b in piece.encode() for x in (self.of_byte[b], 0))
            rows[-1] = 1

    def clear(self) -> None:
        self.new, self.old = {}, {}

    # ------------------------------------------------------------ texts

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, first bytes, ends) of each text, spans in bytes of the original."""
        if not texts:
            return []
        both = [self.normalize(t) for t in texts]
        joined = "".join(s for s, _ in both)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter((len(s) for s, _ in both), np.int64, len(both))
        firsts = np.cumsum(np.r_[0, sizes])
        cls = self.classes[points]
        cut = np.ones(len(points) + 1, bool)
        if len(points):
            cut[1:-1] = ~self.together[cls[:-1], cls[1:]]
        cut[firsts] = True
        starts = np.flatnonzero(cut)
        at = np.cumsum(np.r_[0, widths(points)])
        begin, end = at[starts[:-1]], at[starts[1:]]
        data = joined.encode()
        places, of = byte_bpe.distinct_slices(np.frombuffer(data, np.uint8), begin, end)
        known, pack = self.new, self._pack
        packed = []
        for p in (data[i:j] for i, j in zip(begin[places].tolist(), end[places].tolist())):
            packed.append(known.get(p) or pack(p))
            known = self.new
        flat = np.frombuffer(b"".join(packed), "<u4").reshape(-1, 2)
        n = np.fromiter((len(x) // 8 for x in packed), np.int64, len(packed))
        offsets = np.cumsum(np.r_[0, n])[:-1]
        counts = n[of]
        upto = np.cumsum(np.r_[0, counts])
        rows = np.repeat(offsets[of] - upto[:-1], counts) + np.arange(upto[-1])
        ids, wide = flat[rows, 0], flat[rows, 1].astype(np.int64)
        bounds = upto[np.searchsorted(starts, firsts)]
        # code points before each token, in all normalised texts
        ahead = np.cumsum(np.r_[0, wide])
        out = []
        for k, (_, places) in enumerate(both):
            i, j = bounds[k], bounds[k + 1]
            own = ahead[i : j + 1] - firsts[k]
            out.append((ids[i:j], places[own[:-1]], places[own[1:]]))
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.tolist() for x, _, _ in self.tokens(texts)]

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the decoded text. Bytes of byte pieces that are no UTF-8 become U+FFFD one by one."""
        text = self.text
        out = list(map(text.__getitem__, ids))
        if out and self.normalize.prefix:
            k = next((k for k, i in enumerate(ids) if self.kinds[i] != CONTROL), None)
            if k is not None and self.kinds[ids[k]] in (NORMAL, UNUSED) and out[k][:1] == b" ":
                out[k] = out[k].lstrip(b" ") if self.normalize.trim else out[k][1:]
        whole = b"".join(out)
        try:
            whole.decode()
            return whole
        except UnicodeDecodeError:
            runs: list[bytes] = []
            at = 0
            while at < len(ids):
                end = at
                while end < len(ids) and self.kinds[ids[end]] == BYTE:
                    end += 1
                if end > at:
                    runs.append(_repaired(b"".join(out[at:end])))
                    at = end
                else:
                    runs.append(out[at])
                    at += 1
            return b"".join(runs)


def _repaired(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                data[at : at + n].decode()
            except UnicodeDecodeError:
                continue
            if len(data[at : at + n]) == n:
                out.append(data[at : at + n])
                at += n
                break
        else:
            out.append("�".encode())
            at += 1
    return b"".join(out)


_CODEC: dict[int, Codec] = {}


def _codec(content) -> Codec:
    if content.id not in _CODEC:
        _CODEC.clear()
        _CODEC[content.id] = Codec(content.value)
    return _CODEC[content.id]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _map(df: DataFrame, schema: str, work) -> DataFrame:
    """Work takes a record batch and the texts' list and gives a record batch; text is the last column."""

    def run(batches):
        try:
            for b in common.small(batches):
                texts = ["" if x is None else x for x in b.columns[-1].to_pylist()]
                for i, j in common.chunks(texts, 300_000):
                    yield work(b.slice(i, j - i), texts[i:j])
        finally:  # workers are reused by other stages
            for codec in _CODEC.values():
                codec.clear()
            common.release()

    return df.mapInArrow(run, schema)


def _shared(df: DataFrame, path: str | None):
    """A broadcast of the model file (under 1 MB for 32,000 pieces)."""
    return byte_bpe._Shared(df.sparkSession, path or default_path())


def encode(df: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids, starts, ends): token ids and the original's bytes that each comes from, ends exclusive. Of a character's byte pieces the last has its span, the others none."""
    shared = _shared(df, path)

    def work(b, texts):
        import pyarrow as pa

        found = _codec(shared).tokens(texts)
        lists = [pa.array([x[k] for x in found], pa.list_(t)) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64()))]
        return pa.RecordBatch.from_arrays([b.column(0), *lists], [id, "ids", "starts", "ends"])

    return _map(df.select(id, text), f"`{id}` {df.schema[id].dataType.simpleString()}, ids array<int>, starts array<long>, ends array<long>", work)


def decode(df: DataFrame, id: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(id, text) of token ids; null counts as none."""
    shared = _shared(df, path)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            codec = _codec(shared)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec.decode(x or []).decode() for x in b.column(1).to_pylist()], pa.string())], [id, "text"])

    return df.select(id, ids).mapInArrow(run, f"`{id}` {df.schema[id].dataType.simpleString()}, text string")


def digests(df: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, spans_sha256): encoding and decoding in one task, for checks over whole tables. The spans' digest is of
    all first bytes and then all ends, as 64-bit little-endian integers."""
    shared = _shared(df, path)

    def work(b, texts):
        import pyarrow as pa

        codec = _codec(shared)
        counts, ids_sha, decoded_sha, spans_sha = [], [], [], []
        for found, starts, ends in codec.tokens(texts):
            ids = found.tolist()
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(map(codec.decimal.__getitem__, ids)).encode()).hexdigest())
            decoded_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            spans_sha.append(hashlib.sha256(starts.astype("<i8").tobytes() + ends.astype("<i8").tobytes()).hexdigest())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha), pa.array(spans_sha)], [id, "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    return _map(df.select(id, text), f"`{id}` {df.schema[id].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string", work)


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))


QUERIES = {"op11_sentencepiece": op11_sentencepiece}
ORACLE: dict[str, str] = {}
