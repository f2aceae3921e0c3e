"""PII: base patterns, and a character-level bidirectional LSTM with CRF transitions that adds what they miss.

Base spans (code points, end exclusive) are those of the patterns below, leftmost and non-overlapping per kind, failing matches dropped. The
tagger is trained in numpy on a bounded sample of windows with base spans (``windows`` of them from about ``documents`` documents), each
also in spellings that the patterns do not cover, with the spans known by construction. Texts are read in overlapping windows;
a window is decoded only if it holds a digit or an @, which every span of these kinds does. Each window speaks for its middle, so that the
middles tile the text, and labels are joined over the whole text. A found span counts if it overlaps no base span and passes its kind's
test of digits or parts. Base spans always stay.

Null and empty texts have no spans. Without any base span in the sample there is no tagger and only base spans are returned. An empty
table gives an empty result; repeated rows give repeated results. Only windows that hold a digit or an @ are decoded, so addresses spelled out in words
are not looked for. ``digests`` adds n_spans, the number of all spans.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ["email", "ip", "card", "phone"]
WINDOW, STRIDE = 96, 64
MARGIN = (WINDOW - STRIDE) // 2
WINDOWS, DOCUMENTS = 1200, 20_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")


def _digits(s: str) -> list[int]:
    return [ord(c) - 48 for c in s if "0" <= c <= "9"]


def luhn(d: list[int]) -> bool:
    return (sum(d[-1::-2]) + sum(x * 2 - 9 * (x > 4) for x in d[-2::-2])) % 10 == 0


def valid(kind: str, s: str) -> bool:
    d = _digits(s)
    if kind == "card":
        return 14 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 10 <= len(d) <= 15
    if kind == "ip":
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts)
    return "@" in s and re.search(r"@.*[A-Za-z0-9].*\..*[A-Za-z]", s) is not None


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns, sorted by start and kind. Linear in the text."""
    out = []
    cursor, at = 0, text.find("@")
    while at >= 0:  # the run of local characters before an @ is where its leftmost match begins
        start = at
        while start > cursor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
        cursor = m.end() if m else at + 1
        at = text.find("@", cursor)
    if _TRIGGER.search(text):
        for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
            out += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if valid(kind, m.group())]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# ---------------------------------------------------------------- the tagger

_SPECIAL = "@.-+() _%:/\n\t,;#'\"=<>[]"
N_CLASSES = len(_SPECIAL) + 6
N_TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind


def char_classes(text: str) -> np.ndarray:
    p = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return _class_table()[np.minimum(p, 128)]


_CLASSES: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    if not _CLASSES:
        t = np.full(129, len(_SPECIAL), np.int64)
        for i in range(128):
            c = chr(i)
            t[i] = _SPECIAL.index(c) if c in _SPECIAL else len(_SPECIAL) + (1 if c.isdigit() else 2 if c.islower() else 3 if c.isupper() else 4)
        _CLASSES.append(t)
    return _CLASSES[0]


PAD = N_CLASSES - 1


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """Two LSTMs over character classes, a linear layer and CRF transitions; float32, time first."""

    def __init__(self, hidden: int = 24, seed: int = 7):
        r = np.random.default_rng(seed)
        g = lambda *s: (r.standard_normal(s) * 0.2).astype(np.float32)
        self.h = hidden
        self.p = {f"{n}{d}": v for d in "fb" for n, v in (("x", g(N_CLASSES, 4 * hidden)), ("r", g(hidden, 4 * hidden)))}
        for d in "fb":
            self.p["x" + d][:, hidden : 2 * hidden] += 1.0  # open forget gates
        self.p |= {"o": g(2 * hidden, N_TAGS), "ob": np.zeros(N_TAGS, np.float32), "t": g(N_TAGS, N_TAGS), "s": g(N_TAGS)}

    def _run(self, x: np.ndarray, d: str, keep: bool):
        t_n, b, h = *x.shape, self.h
        hs, c, state = np.zeros((t_n, b, h), np.float32), np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
        saved = []
        for t in range(t_n) if d == "f" else range(t_n - 1, -1, -1):
            z = self.p["x" + d][x[t]] + state @ self.p["r" + d]
            i, f, o, g = _sigmoid(z[:, :h]), _sigmoid(z[:, h : 2 * h]), _sigmoid(z[:, 2 * h : 3 * h]), np.tanh(z[:, 3 * h :])
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            if keep:
                saved.append((t, i, f, o, g, before, tc, state))
            state = o * tc
            hs[t] = state
        return hs, saved

    def _back(self, x, d, saved, dh, grads):
        h = self.h
        dstate, dc = np.zeros_like(dh[0]), np.zeros_like(dh[0])
        dz, before_ = np.empty((len(saved), dh.shape[1], 4 * h), dh.dtype), np.empty((len(saved), dh.shape[1], h), dh.dtype)
        for t, i, f, o, g, before, tc, prev in reversed(saved):
            total = dh[t] + dstate
            dc = dc + total * o * (1 - tc * tc)
            dz[t] = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), total * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
            before_[t] = prev
            dstate = dz[t] @ self.p["r" + d].T
            dc = dc * f
        flat = dz.reshape(-1, 4 * h)
        grads["x" + d] += np.eye(N_CLASSES, dtype=flat.dtype)[x.ravel()].T @ flat
        grads["r" + d] += before_.reshape(-1, h).T @ flat

    def emissions(self, x, keep=False):
        hf, sf = self._run(x, "f", keep)
        hb, sb = self._run(x, "b", keep)
        both = np.concatenate([hf, hb], 2)
        return both @ self.p["o"] + self.p["ob"], both, sf, sb

    def gradients(self, x: np.ndarray, y: np.ndarray):
        """Mean negative log likelihood and its gradients; forward-backward over the CRF, scaled at each step."""
        e, both, sf, sb = self.emissions(x, True)
        t_n, b, k = e.shape
        m = e.max(2, keepdims=True)
        pe, pt = np.exp(e - m), np.exp(self.p["t"])
        alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty((t_n, b, 1), e.dtype)
        for t in range(t_n):
            a = pe[t] * (np.exp(self.p["s"]) if t == 0 else alpha[t - 1] @ pt)
            scale[t] = a.sum(1, keepdims=True)
            alpha[t] = a / scale[t]
        for t in range(t_n - 2, -1, -1):
            beta[t] = (pe[t + 1] * beta[t + 1]) @ pt.T / scale[t + 1]
        z = (np.log(scale) + m).sum((0, 2))
        de = alpha * beta
        grads = {n: np.zeros_like(v) for n, v in self.p.items()}
        after = pe[1:] * beta[1:] / scale[1:]
        grads["t"] += pt * (alpha[:-1].reshape(-1, k).T @ after.reshape(-1, k))
        np.add.at(grads["t"], (y[:-1].ravel(), y[1:].ravel()), -1.0)
        rows = np.arange(b)
        at = np.arange(t_n)[:, None]
        gold = self.p["s"][y[0]] + e[at, rows, y].sum(0) + self.p["t"][y[:-1], y[1:]].sum(0)
        de[at, rows, y] -= 1
        grads["s"] += de[0].sum(0)
        grads["o"] += both.reshape(-1, both.shape[2]).T @ de.reshape(-1, k)
        grads["ob"] += de.sum((0, 1))
        dh = de @ self.p["o"].T
        self._back(x, "f", sf, dh[:, :, : self.h], grads)
        self._back(x, "b", sb, dh[:, :, self.h :], grads)
        return float((z - gold).mean()), {n: g / b for n, g in grads.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 700, batch: int = 96, rate: float = 0.02, seed: int = 11) -> float:
        """Adam; x and y are (window, character)."""
        r, m, v, loss = np.random.default_rng(seed), {}, {}, 0.0
        for step in range(1, steps + 1):
            pick = r.integers(0, len(x), min(batch, len(x)))
            loss, grads = self.gradients(np.ascontiguousarray(x[pick].T), np.ascontiguousarray(y[pick].T))
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for n, g in grads.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m[n] = 0.9 * m.get(n, 0) + 0.1 * g
                v[n] = 0.99 * v.get(n, 0) + 0.01 * g * g
                self.p[n] = (self.p[n] - rate * (1 - step / (steps + 1)) * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return loss

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Viterbi tags, (window, character) in and out."""
        e = self.emissions(np.ascontiguousarray(x.T))[0]
        t_n, b, k = e.shape
        back, score = np.zeros((t_n, b, k), np.int8), self.p["s"] + e[0]
        for t in range(1, t_n):
            all_ = score[:, :, None] + self.p["t"]
            back[t] = all_.argmax(1)
            score = all_.max(1) + e[t]
        tags = np.empty((t_n, b), np.int64)
        tags[-1] = score.argmax(1)
        for t in range(t_n - 1, 0, -1):
            tags[t - 1] = back[t, np.arange(b), tags[t]]
        return tags.T


def _windows(n: int) -> list[int]:
    """Starts of windows (the first begins a margin early); middles of STRIDE characters tile the text."""
    return list(range(-MARGIN, max(1, n) - MARGIN, STRIDE))


def _pad(c: np.ndarray, start: int) -> np.ndarray:
    out = np.full(WINDOW, PAD, np.int64)
    a, b = max(0, start), min(len(c), start + WINDOW)
    out[a - start : b - start] = c[a:b]
    return out


def tag_spans(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Spans of the tagger in whole texts, before any test."""
    at, xs = [], []
    for i, text in enumerate(texts):
        hits = np.unique([m.start() // STRIDE for m in _TRIGGER.finditer(text)])
        if len(hits):
            c = char_classes(text)
            near = np.unique(np.concatenate([hits - 1, hits, hits + 1]))
            for w in near[(near >= 0) & (near * STRIDE < len(text))].tolist():
                at.append((i, w))
                xs.append(_pad(c, w * STRIDE - MARGIN))
    tags: dict[int, np.ndarray] = {}
    for k in range(0, len(xs), 1024):
        for (i, w), row in zip(at[k : k + 1024], tagger.decode(np.array(xs[k : k + 1024]))):
            own = tags.setdefault(i, np.zeros(len(texts[i]), np.int64))
            part = own[w * STRIDE : (w + 1) * STRIDE]
            part[:] = row[MARGIN : MARGIN + STRIDE][: len(part)]
    out: list = [[] for _ in texts]
    for i, t in tags.items():
        kind = np.where(t > 0, (t + 1) // 2, 0)
        begin = (t % 2 == 1) & (t > 0)
        edge = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (begin[1:] & (kind[1:] == kind[:-1]) & ~begin[:-1])])
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(t)]):
            if kind[a]:
                out[i].append((a, b, KINDS[kind[a] - 1]))
    return out


def spans(tagger: Tagger | None, texts: list[str]) -> list[tuple[list, list]]:
    """For each text its base spans, and those with the tagger's additions."""
    found = tag_spans(tagger, texts) if tagger else [[] for _ in texts]
    out = []
    for text, extra in zip(texts, found):
        base = base_spans(text)
        more = [s for s in extra if valid(s[2], text[s[0] : s[1]]) and not any(s[0] < b and a < s[1] for a, b, _ in base)] if extra else []
        out.append((base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]))) if more else base))
    return out


#: How spans are also written: kind, what is replaced, by what; nothing replaced: digits in groups of four.
SPELLINGS = [("email", "@", " @ "), ("email", ".", " . "), ("phone", "+", "00"), ("phone", "+", "("), ("card", "", "."), ("card", "", "/"), ("ip", ".", " . "), ("ip", ".", "-")]


def respell(text: str, own: list[tuple[int, int, str]], rule: tuple[str, str, str]) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with its spans of one kind written differently, and where all spans are then."""
    out, at, new = [], 0, []
    size = 0
    for a, b, kind in own:
        if a < at:
            continue
        piece = text[a:b]
        if kind == rule[0] and rule[1]:
            piece = piece.replace(rule[1], rule[2])
        elif kind == rule[0]:
            d = "".join(map(str, _digits(piece)))
            piece = rule[2].join(d[i : i + 4] for i in range(0, len(d), 4))
        out += [text[at:a], piece]
        size += a - at
        new.append((size, size + len(piece), kind))
        size += len(piece)
        at = b
    out.append(text[at:])
    return "".join(out), new


def train(windows: list[str]) -> Tagger | None:
    """A tagger from texts with base spans, as they are and respelled."""
    xs, ys = [], []
    for w in windows:
        own = base_spans(w)
        forms = [(w, own)] + [respell(w, own, r) for r in SPELLINGS if any(k == r[0] for _, _, k in own)]
        for text, labelled in forms:
            y = np.zeros(max(WINDOW, len(text)), np.int64)
            for a, b, kind in labelled:
                k = KINDS.index(kind)
                y[a:b], y[a] = 2 * k + 2, 2 * k + 1
            xs.append(_pad(char_classes(text), 0))
            ys.append(y[:WINDOW])
    if not xs:
        return None
    tagger = Tagger()
    tagger.fit(np.array(xs), np.array(ys))
    return tagger


def sample_windows(docs: DataFrame, id: str = "doc_id", text: str = "text", windows: int = WINDOWS, documents: int = DOCUMENTS) -> list[str]:
    """Windows with base spans, at places drawn by hash, the first by hash, from about ``documents`` documents; at most 3 of a document and ``windows`` in all."""
    share = min(1.0, documents / max(1, docs.count()))
    h = F.md5(F.coalesce(F.col(id).cast("string"), F.lit("null")))
    picked = docs.where(F.conv(F.substring(h, 1, 8), 16, 10).cast("long") < int(share * (1 << 32))).select(h.alias("h"), text)

    def run(batches):
        import pyarrow as pa

        for b in common.small(batches):
            rows = []
            for key, t in zip(b["h"].to_pylist(), b[text].to_pylist()):
                found = base_spans(t or "")
                for kind in KINDS:
                    for a, e, _ in [s for s in found if s[2] == kind][:1]:
                        own = hashlib.md5(f"{key}{kind}".encode()).hexdigest()
                        start = max(0, (a + e) // 2 - 16 - int(own[-4:], 16) % (WINDOW - 32))  # spans stand anywhere in windows
                        rows.append((own, kind, t[start : start + WINDOW]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], ["h", "kind", "w"])

    found = picked.mapInArrow(run, "h string, kind string, w string")
    from pyspark.sql.window import Window

    each = Window.partitionBy("kind").orderBy("h", "w")
    found = found.withColumn("__n", F.row_number().over(each)).where(F.col("__n") <= windows // len(KINDS))
    return [r["w"] for r in found.orderBy("h", "w").select("w").collect()]


def find(docs: DataFrame, id: str = "doc_id", text: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """(id, base, spans): arrays of (kind, start, end) for every document."""
    span = "array<struct<kind:string,start:int,end:int>>"
    return _map(docs, id, text, tagger, f"base {span}, spans {span}", lambda base, every: ([{"kind": k, "start": a, "end": b} for a, b, k in base], [{"kind": k, "start": a, "end": b} for a, b, k in every]))


def _map(docs: DataFrame, id: str, text: str, tagger: Tagger | None, schema: str, row) -> DataFrame:
    full = f"{id} {docs.schema[id].dataType.simpleString()}, {schema}"
    names = [id, *re.findall(r"(?:^|, )(\w+) ", schema)]

    def run(batches):
        import pyarrow as pa

        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        kinds = {"base": span, "spans": span} if len(names) == 3 else {c: pa.int64() for c in names if c.startswith("n_")}
        for b in common.small(batches):
            texts = ["" if t is None else t for t in b.column(1).to_pylist()]
            for i, j in common.chunks(texts):
                rows = [row(*s) for s in spans(tagger, texts[i:j])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *[pa.array([r[k] for r in rows], kinds.get(c, pa.string())) for k, c in enumerate(names[1:])]], names)

    return docs.select(id, text).mapInArrow(run, full)


def _written(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def digests(docs: DataFrame, id: str = "doc_id", text: str = "text", tagger: Tagger | None = None) -> DataFrame:
    def row(base, every):
        return (*[sum(s[2] == k for s in base) for k in KINDS], hashlib.sha256(_written(base).encode()).hexdigest(), _written(every), len(every))

    return _map(docs, id, text, tagger, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long", row)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return digests(docs, tagger=train(sample_windows(docs)))


QUERIES = {"op8_pii": op8_pii}
ORACLE: dict[str, str] = {}
