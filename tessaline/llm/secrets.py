"""Secret scans: fixed patterns, and a character convolutional network over every further candidate with its context.

The network is trained with numpy on labelled findings: what the patterns find in a bounded sample of documents against
numbers and parts of addresses there, and generated findings of known formats against generated look-alikes. Its scores are calibrated
on findings held back from training, whose values training never sees, and the threshold is the highest that still recalls a stated
share of them. A candidate longer than the network's field is judged in overlapping pieces, and its highest score counts.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, map_rows, map_table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("passw", "secret", "token", "key")
KINDS = ("assign", "access", "hex", "cnn")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
#: Runs of one kind of character (or a capital and small letters) are candidates from this length on.
PLAIN = 16

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Matches of the three patterns that are long enough, leftmost first and without overlap within a kind."""
    spans: list[Span] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, taken: list[Span]) -> Iterator[tuple[int, int]]:
    """Runs of 8 key characters or more, apart from the spans already found (in order of their starts).

    A run shorter than 16 must mix letters with digits, or small letters with capitals beyond the first.
    """
    at, end = 0, 0  # the spans that start before a run's end, and the furthest end of these
    for m in RUN.finditer(text):
        run = m[0]
        if len(run) < PLAIN and (run.islower() or run.isupper() or run.istitle() or not any(map(str.isalpha, run))) and (run.isalpha() or not any(map(str.isdigit, run)) or not any(map(str.isalpha, run))):
            continue
        while at < len(taken) and taken[at][1] < m.end():
            end = max(end, taken[at][2])
            at += 1
        if end <= m.start():
            yield m.start(), m.end()


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


LEFT, BODY, RIGHT = 24, 48, 8
ALPHABET = {c: i + 2 for i, c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 \n\"'=:+/_.-@,;()<>|#")}


_CODES = np.ones(128, np.uint8)
for _c, _i in ALPHABET.items():
    _CODES[ord(_c)] = _i


def encode(found: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the characters before, in and after candidates (text, start, end), and the candidate of each row.

    0 pads and 1 is any other character. A candidate longer than the field gives a row for every half field, so each of its
    characters is seen with those around it.
    """
    rows, owner = [], []
    for k, (text, start, end) in enumerate(found):
        for s in range(start, max(start + 1, end - BODY // 2), BODY // 2) if end - start > BODY else (start,):
            e = min(end, s + BODY)
            parts = ((LEFT - min(LEFT, s), text[max(0, s - LEFT) : s]), (LEFT, text[s:e]), (LEFT + BODY, text[e : e + RIGHT]))
            row = np.zeros(LEFT + BODY + RIGHT, np.uint8)
            for at, part in parts:
                codes = np.frombuffer(part.encode("ascii", "replace"), np.uint8)
                row[at : at + len(part)] = _CODES[codes]
                if not part.isascii():
                    row[at : at + len(part)][[ord(c) > 127 for c in part]] = 1
            rows.append(row)
            owner.append(k)
    return np.stack(rows) if rows else np.zeros((0, LEFT + BODY + RIGHT), np.uint8), np.array(owner, np.int64)


@dataclass
class Network:
    """Embedding, one convolution, maximum and mean over positions, and a logistic output with calibration."""

    params: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    @classmethod
    def new(cls, rng: np.random.Generator, dim: int = 8, width: int = 5, filters: int = 24) -> Network:
        size = len(ALPHABET) + 2
        return cls({"E": rng.normal(0, 0.5, (size, dim)), "W": rng.normal(0, (width * dim) ** -0.5, (width * dim, filters)), "b": np.zeros(filters), "v": rng.normal(0, 0.1, 2 * filters), "c": np.zeros(1)})

    def forward(self, x: np.ndarray) -> tuple:
        p = self.params
        dim = p["E"].shape[1]
        width = p["W"].shape[0] // dim
        e = p["E"][x]
        u = np.concatenate([e[:, i : x.shape[1] - width + 1 + i] for i in range(width)], axis=2)
        z = np.maximum(u @ p["W"] + p["b"], 0)
        pooled = np.concatenate([z.max(1), z.mean(1)], axis=1)
        return u, z, pooled, pooled @ p["v"] + p["c"][0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[3]

    def scores(self, found: list[tuple[str, int, int]]) -> np.ndarray:
        """Calibrated scores of candidates: of each, the highest of its pieces."""
        out = np.full(len(found), -np.inf)
        for first in range(0, len(found), 256):
            x, owner = encode(found[first : first + 256])
            for at in range(0, len(x), 1024):
                np.maximum.at(out, first + owner[at : at + 1024], self.logits(x[at : at + 1024]))
        return 1 / (1 + np.exp(-(self.scale * out + self.shift)))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.params, len(x)
        u, z, pooled, logit = self.forward(x)
        d = (1 / (1 + np.exp(-logit)) - y) / n
        k = z.shape[2]
        dz = np.repeat((d[:, None] * p["v"][k:] / z.shape[1])[:, None, :], z.shape[1], axis=1)
        rows, cols = np.ogrid[:n, :k]
        dz[rows, z.argmax(1), cols] += d[:, None] * p["v"][:k]
        dz *= z > 0
        du = dz @ p["W"].T
        dim = p["E"].shape[1]
        de = np.zeros_like(p["E"])
        for i in range(p["W"].shape[0] // dim):
            np.add.at(de, x[:, i : i + z.shape[1]], du[:, :, i * dim : (i + 1) * dim])
        return {"E": de, "W": np.tensordot(u, dz, ([0, 1], [0, 1])), "b": dz.sum((0, 1)), "v": pooled.T @ d, "c": np.array([d.sum()])}


def fit(data: list[tuple[str, int, int, int]], recall: float = 0.95, epochs: int = 12, seed: int = 7) -> Network:
    """Adam on findings (text, start, end, label); calibration and threshold on the quarter of values that training never sees."""
    rng = np.random.default_rng(seed)
    held = [zlib.crc32(t[s:e].encode("utf-8", "surrogatepass")) % 4 == 0 for t, s, e, _ in data]
    back = [d for d, h in zip(data, held, strict=True) if h]
    x, owner = encode([d[:3] for d, h in zip(data, held, strict=True) if not h])
    y = np.array([d[3] for d, h in zip(data, held, strict=True) if not h], float)[owner]
    used = np.arange(len(x))
    net = Network.new(rng)
    m1 = {k: np.zeros_like(v) for k, v in net.params.items()}
    m2 = {k: np.zeros_like(v) for k, v in net.params.items()}
    step = 0
    for _ in range(epochs):
        rng.shuffle(used)
        for at in range(0, len(used), 64):
            step += 1
            for k, g in net.gradients(x[used[at : at + 64]], y[used[at : at + 64]]).items():
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                net.params[k] -= 0.005 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    truth = np.array([d[3] for d in back], float)
    raw = np.clip(net.scores([d[:3] for d in back]), 1e-12, 1 - 1e-12)
    logit = np.log(raw / (1 - raw))
    target = np.where(truth > 0, (truth.sum() + 1) / (truth.sum() + 2), 1 / ((1 - truth).sum() + 2))  # Platt's targets
    a, b = 1.0, 0.0
    for _ in range(500):
        err = 1 / (1 + np.exp(-(a * logit + b))) - target
        a, b = max(a - 0.05 * float((err * logit).mean()), 0.05), b - 0.05 * float(err.mean())
    net.scale, net.shift = a, b
    found = np.sort(net.scores([d[:3] for d in back])[truth > 0])
    net.threshold = float(found[int((1 - recall) * len(found))]) if len(found) else 0.5
    return net


def generated(n: int = 3000, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """Labelled findings as (text, start, end, label): keys of common formats, and look-alikes that are no secrets."""
    rng = np.random.default_rng(seed)
    sets = {"b64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "low": "abcdefghijklmnopqrstuvwxyz", "alnum": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "digit": "0123456789", "mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"}

    def draw(kind: str, k: int) -> str:
        return "".join(sets[kind][i] for i in rng.integers(0, len(sets[kind]), k))

    def words(k: int) -> list[str]:
        return [draw("low", int(rng.integers(2, 9))) for _ in range(k)]

    def syllables(k: int) -> list[str]:
        return ["bcdfghlmnprstvw"[i] + "aeiou"[j] + ("", "", "n", "r", "s", "ng", "th")[c] for i, j, c in zip(rng.integers(0, 15, k), rng.integers(0, 5, k), rng.integers(0, 7, k), strict=True)]

    out = []
    for i in range(n):
        secret = i % 2 == 0
        if secret:
            body = (draw("alnum", int(rng.integers(20, 48))), "ghp_" + draw("alnum", 36), "sk-" + draw("alnum", 40), "eyJ" + draw("b64", 44), draw("b64", int(rng.integers(40, 200))), "xoxb-" + draw("digit", 12) + "-" + draw("alnum", 24), draw("mixed", int(rng.integers(20, 40))), draw("alnum", int(rng.integers(12, 20))))[int(rng.integers(8))]
            cue = ("", "Authorization: Bearer ", "key ", "client_secret ", "export K=", "auth: ")[int(rng.integers(6))]
        else:
            body = ("-".join(words(4)) + draw("digit", 2), "/".join(words(4)) + "/" + draw("digit", 3), "_".join(words(3)) + draw("digit", 4), draw("low", 17) + draw("digit", 2), "2024-01-" + draw("digit", 2) + "-" + "-".join(words(2)), "".join(words(3)) + "-v" + draw("digit", 2), "".join(syllables(int(rng.integers(6, 11)))), "".join(syllables(6)).upper(), "".join(syllables(3)) + "".join(syllables(4)).capitalize(), "/".join("".join(syllables(2)) for _ in range(int(rng.integers(3, 12)))), "".join(syllables(3)) + draw("digit", 4))[int(rng.integers(11))]
            cue = ("", "http://", "file ", "see ", "page=", "id: ", "", "")[int(rng.integers(8))]
        left, right = " ".join(words(4)), " ".join(words(3))
        text = f"{left} {cue}{body} {right}"
        start = len(left) + 1 + len(cue)
        out.append((text, start, start + len(body), int(secret)))
    return out


def _findings():
    def step(cols: dict[str, list]) -> dict[str, list]:
        rows = []
        for doc_id, text in zip(cols["doc_id"], cols["text"], strict=True):
            spans = base_spans(text)
            for kind, s, e in spans:
                if kind == "assign":  # the value; the words before it are context
                    s = ASSIGN.match(text, s).start(2)
                rows.append((doc_id, text[max(0, s - LEFT) : s], text[s:e][:256], text[e : e + RIGHT], int(any(c.isalpha() for c in text[s:e]))))
            for s, e in candidates(text, spans):  # only those inside an address are known to be no secrets
                left, right = text[max(0, s - LEFT) : s], text[e : e + RIGHT]
                if right[:1] == "@" or left[-1:] == "@" or "://" in left.split(" ")[-1]:
                    rows.append((doc_id, left, text[s:e][:256], right, 0))
        return {n: [r[i] for r in rows] for i, n in enumerate(("doc_id", "left", "body", "right", "label"))}

    return step


def train(docs: DataFrame, sample_docs: int = 20_000, sample_findings: int = 4_000, recall: float = 0.95) -> Network:
    """Train on generated findings and on those of a bounded sample of documents.

    ``sample_docs`` bounds the expected number of documents that are searched for labelled findings and ``sample_findings``
    the findings that reach the driver; both choose by hash. Half of the findings lose the words before them, so that the shape
    of the value counts too.
    """
    rows = keyed(docs, "doc_id", "text", doc_id="long").where("text is not null")
    n = docs.count()
    some = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < 1_000_000.0 * sample_docs / max(n, 1))
    found = map_rows(some, _findings, "doc_id long, left string, body string, right string, label int").orderBy(F.xxhash64("doc_id", "left", "body"), "body").limit(sample_findings).collect()
    data = generated()
    for i, r in enumerate(sorted(found, key=lambda r: (r.body, r.left, r.right))):
        left = "" if i % 2 else r.left
        data.append((left + r.body + r.right, len(left), len(left) + len(r.body), r.label))
    return fit(data, recall)


def all_spans(texts: list[str], net: Network) -> list[tuple[list[Span], list[Span], int]]:
    """For each text the spans of the patterns, these with what the network adds, and the number of candidates that it judged."""
    base = [base_spans(t) for t in texts]
    found = [(i, s, e) for i, t in enumerate(texts) for s, e in candidates(t, base[i])]
    more: list[list[Span]] = [[] for _ in texts]
    judged = [0] * len(texts)
    for (i, s, e), p in zip(found, net.scores([(texts[i], s, e) for i, s, e in found]), strict=True):
        judged[i] += 1
        if p >= net.threshold:
            more[i].append(("cnn", s, e))
    return [(b, sorted(b + m, key=lambda s: (s[1], KINDS.index(s[0]))), n) for b, m, n in zip(base, more, judged, strict=True)]


def scan(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_cnn and n_judged for every row of ``docs``.

    ``n_judged`` counts the candidates that the network scored and ``n_cnn`` the spans that it added. Positions are code points of the whole text. A null text is an empty one and has no spans; repeated rows each get their
    row, null ids stay null, other columns are ignored and an empty table gives an empty result. A text of any length takes time
    in proportion to its length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # some thousands of numbers

    def make():
        def step(cols: dict[str, list]) -> dict[str, list]:
            found = all_spans([t or "" for t in cols["text"]], shared.value)
            count = lambda kind: [sum(s[0] == kind for s in spans) for _, spans, _ in found]
            return {"doc_id": cols["doc_id"], "n_assign": count("assign"), "n_access": count("access"), "n_hex": count("hex"), "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b, _, _ in found], "spans": [joined(a) for _, a, _ in found], "n_cnn": count("cnn"), "n_judged": [n for _, _, n in found]}

        return step

    return map_rows(keyed(docs, "doc_id", "text", doc_id="long"), make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_cnn long, n_judged long")


def redacted(text: str, spans: list[Span], mark: str = "<SECRET>") -> str:
    out, end = [], 0
    for _, s, e in spans:
        if s >= end:
            out += [text[end:s], mark]
        end = max(end, e)
    return "".join(out) + text[end:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret replaced by a mark and ``n_chars`` recounted; all rows and columns stay."""
    net = docs.sparkSession.sparkContext.broadcast(train(docs))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").to_pylist()
            clean = [t if t is None or not spans else redacted(t, spans) for t, (_, spans, _) in zip(texts, all_spans([t or "" for t in texts], net.value), strict=True)]
            for name, values in (("text", clean), ("n_chars", [None if t is None else len(t) for t in clean])):
                if (at := batch.schema.get_field_index(name)) >= 0:
                    batch = batch.set_column(at, batch.schema.field(at), pa.array(values, batch.schema.field(at).type))
            yield batch

    return map_table(docs, run)
