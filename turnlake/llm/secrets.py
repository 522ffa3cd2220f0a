"""Secret scan: patterns, and a character CNN over every further candidate.

Base findings come from three patterns and always stay. Candidates are further
runs of 8 and more secret-like characters: after a word that announces a secret
any run, elsewhere one with a letter and a digit, from 16 on one of mixed case,
from 24 on a bare one of letters. A small convolutional network in numpy reads
each with the text around it. It is trained on labelled findings, calibrated on
a second part of them by Platt scaling, and the threshold is the highest one
that keeps the demanded recall on a third part, where findings that are no
candidates count as missed. Candidates at or above it are added with the kind
``model``; base findings get their probability as score and stay whatever it is.

Labelled findings are made from fixed rules and a seed (``labelled_findings``);
callers can pass their own. Training is bounded by their number and runs once;
the weights (some 30 kB) are broadcast.

Defined results: null and empty texts have no findings. Offsets are code
points, ends exclusive. Repeated rows are scanned each on its own. An empty
table gives an empty result. Other columns, whatever their names, do not
matter to ``scan`` and pass through ``redact`` unchanged.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "model")
_ASSIGN = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.ASCII)
_HEX = re.compile(r"[0-9a-f]+", re.ASCII)
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}", re.ASCII)
_DIGIT, _LETTER, _CAPITALS = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]"), re.compile(r"[a-z][A-Z]")
_BARE = re.compile(r"[A-Za-z]{24,}", re.ASCII)
#: Words that announce a secret, a part of each to look for first, and the run after them.
_ANNOUNCED = ("pwd", "pass", "key", "auth", "bearer", "credential", "secret", "token")
_NAMED = re.compile(
    r"""(?i:pwd|pass(?:phrase|code|word|wd)|key|auth(?:orization)?|bearer|credentials?|secret|token)"""
    r"""["']?(?:\x20*[:=]\x20*|\x20)["']?([A-Za-z0-9+/_.=-]{8,})""", re.ASCII
)
LEAST = {"assign": 8, "access": 16, "hex": 32}

#: Characters of a window before, in and after the candidate; longer candidates get several windows.
LEFT, BODY, RIGHT = 20, 40, 12
WIDE = LEFT + BODY + RIGHT
SYMBOLS, EMBED, KERNEL, FILTERS = 129, 8, 5, 24


class Finding(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def base_findings(text: str) -> list[Finding]:
    """Findings of the three patterns, by start and then by kind as listed."""
    found = []
    if "=" in text or ":" in text:
        for m in _ASSIGN.finditer(text):
            if m.end(1) - m.start(1) >= LEAST["assign"]:
                found.append(Finding("assign", m.start(), m.end(), 1.0))
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= LEAST["access"]:
                found.append(Finding("access", m.start(), m.end(), 1.0))
    for run in _RUN.finditer(text):
        if run.end() - run.start() >= LEAST["hex"]:  # a long hexadecimal run lies in a run of these characters
            for m in _HEX.finditer(text, run.start(), run.end()):
                if m.end() - m.start() >= LEAST["hex"]:
                    found.append(Finding("hex", m.start(), m.end(), 1.0))
    return sorted(found, key=lambda f: (f.start, KINDS.index(f.kind)))


def _trimmed(text: str, start: int, end: int) -> int:
    """The end of a run without the punctuation of its sentence."""
    while end > start and text[end - 1] in ".-":
        end -= 1
    return end


def _union(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the places that the spans cover, in order."""
    starts, ends = [], []
    for start, end in sorted(spans):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def _free(start: int, end: int, taken: tuple[list[int], list[int]]) -> bool:
    """Whether a span overlaps none of the places in a union."""
    k = bisect_right(taken[1], start)
    return k == len(taken[0]) or taken[0][k] >= end


def _base_spans(text: str) -> list[tuple[int, int]]:
    return [(f.start, f.end) for f in base_findings(text)]


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs that may be secrets by their characters or by the word before them; they do not overlap."""
    named, lower = [], text.lower()
    for m in _NAMED.finditer(text) if any(word in lower for word in _ANNOUNCED) else ():
        end = _trimmed(text, m.start(1), m.end(1))
        if end - m.start(1) >= 8:
            named.append((m.start(1), end))
    taken, out = _union(named), named
    for m in _RUN.finditer(text):
        if m[0].isalpha() and (m.end() - m.start() < 16 or m[0].islower()) and m.end() - m.start() < 24:
            continue  # a word
        start, end = m.start(), _trimmed(text, m.start(), m.end())
        inner = text.rfind("=", start, end - 8)  # name=value: the value
        start = inner + 1 if inner >= 0 else start
        if end - start < 8 or not _free(start, end, taken):
            continue
        if _LETTER.search(text, start, end) and (
            _DIGIT.search(text, start, end)
            or end - start >= 16 and _CAPITALS.search(text, start, end)
            or end - start >= 24 and _BARE.fullmatch(text, start, end)
        ):
            out.append((start, end))
    return sorted(out)


def _windows(text: str, start: int, end: int) -> list[tuple[bytes, bytes]]:
    """(symbols, inside flags) of a candidate; the context is padded with NUL."""
    out = []
    for at in range(start, end, BODY):
        to = min(at + BODY, end)
        left, right = text[max(0, at - LEFT) : at], text[to : to + RIGHT]
        body = text[at:to]
        line = left.rjust(LEFT, "\0") + body + right
        line = line.ljust(WIDE, "\0")[:WIDE]
        flags = b"\0" * LEFT + b"\1" * len(body) + b"\0" * (WIDE - LEFT - len(body))
        out.append((bytes(min(ord(c), 128) for c in line), flags))
    return out


class Network(NamedTuple):
    embed: np.ndarray  # (SYMBOLS, EMBED)
    kernel: np.ndarray  # (KERNEL * (EMBED + 1), FILTERS)
    kernel_bias: np.ndarray
    dense: np.ndarray  # (2 * FILTERS,)
    dense_bias: np.ndarray  # (1,)
    scale: float = 1.0  # Platt
    shift: float = 0.0
    threshold: float = 0.5


def _forward(net: Network, symbols: np.ndarray, flags: np.ndarray) -> tuple:
    x = np.concatenate((net.embed[symbols], flags[..., None]), axis=2)
    n, steps = len(x), WIDE - KERNEL + 1
    columns = np.concatenate([x[:, k : k + steps] for k in range(KERNEL)], axis=2)
    hidden = np.maximum(columns @ net.kernel + net.kernel_bias, 0)
    inside = flags[:, KERNEL // 2 : KERNEL // 2 + steps, None]
    top = hidden.argmax(axis=1)
    most = np.take_along_axis(hidden, top[:, None, :], axis=1)[:, 0]
    size = np.maximum(inside.sum(axis=1), 1)
    mean = (hidden * inside).sum(axis=1) / size
    pooled = np.concatenate((most, mean), axis=1)
    return columns, hidden, inside, size, top, pooled, pooled @ net.dense + net.dense_bias[0]


def logits(net: Network, symbols: np.ndarray, flags: np.ndarray) -> np.ndarray:
    out = [_forward(net, symbols[a : a + 256], flags[a : a + 256])[-1] for a in range(0, len(symbols), 256)]
    return np.concatenate(out) if out else np.zeros(0)


def _gradients(net: Network, symbols: np.ndarray, flags: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    columns, hidden, inside, size, top, pooled, z = _forward(net, symbols, flags)
    n, steps = len(z), hidden.shape[1]
    dz = (1 / (1 + np.exp(-z)) - y) / n
    d_pooled = dz[:, None] * net.dense
    d_hidden = d_pooled[:, None, FILTERS:] * inside / size[:, None]
    rows, filters = np.arange(n)[:, None], np.arange(FILTERS)[None]
    d_hidden[rows, top, filters] += d_pooled[:, :FILTERS]
    d_hidden *= hidden > 0
    flat = d_hidden.reshape(-1, FILTERS)
    d_columns = (flat @ net.kernel.T).reshape(n, steps, -1)
    d_embed = np.zeros_like(net.embed)
    for k in range(KERNEL):
        part = d_columns[:, :, k * (EMBED + 1) : k * (EMBED + 1) + EMBED]
        np.add.at(d_embed, symbols[:, k : k + steps], part)
    return [d_embed, columns.reshape(len(flat), -1).T @ flat, flat.sum(0), pooled.T @ dz, np.array([dz.sum()])]


def labelled_findings(n: int = 6000, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): secrets, and other runs that look like them."""
    rng = random.Random(seed)
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    upper = lower.upper()
    draw = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    word = lambda: "".join(draw("bcdfghlmnprst", 1) + draw("aeiou", 1) for _ in range(rng.randint(1, 4)))
    words = lambda k: " ".join(word() for _ in range(k))
    everything = lower + upper + digits
    secret = [
        lambda: "AKIA" + draw(upper + digits, 16),
        lambda: draw("0123456789abcdef", rng.choice((24, 32, 40, 64))),
        lambda: draw(everything + "+/", rng.choice((24, 32, 40, 43))) + rng.choice(("", "=", "==")),
        lambda: rng.choice(("sk_live_", "pk_test_", "ghp_", "xoxb-", "glpat-")) + draw(everything, rng.randint(20, 36)),
        lambda: "eyJ" + draw(everything, 24) + "." + draw(everything + "_-", 32),
        lambda: draw(everything + "_-", rng.randint(18, 30)),
        lambda: draw(lower + upper, rng.randint(26, 40)),
    ]
    announced = [  # secrets by the word before them
        lambda: draw(everything, rng.randint(8, 15)),
        lambda: draw(lower + digits, rng.randint(8, 15)),
        lambda: draw(rng.choice((lower, upper, digits)), rng.randint(8, 24)),
        lambda: (word() + draw(digits, rng.randint(1, 4))).rjust(8, rng.choice(lower)),
        lambda: "".join(word() for _ in range(4)).rjust(8, rng.choice(lower)),
    ]
    plain = [
        lambda: "/".join(word() for _ in range(4)) + "/" + draw(digits, rng.randint(1, 4)) + ".html",
        lambda: "www." + word() + word() + ".example.com/" + draw(lower, 2) + "/" + draw(digits, 4),
        lambda: "_".join(word() for _ in range(3)) + "_" + draw(digits, rng.randint(1, 3)),
        lambda: f"20{draw(digits, 2)}-0{draw('123456789', 1)}-1{draw(digits, 1)}T1{draw(digits, 1)}.{draw(digits, 2)}",
        lambda: word() + word() + word() + "." + draw(digits, rng.randint(1, 3)),
        lambda: "-".join(word() for _ in range(rng.randint(3, 5))) + "-" + draw(digits, rng.randint(1, 4)),
        lambda: word().capitalize() + word().capitalize() + word().capitalize() + word() + draw(digits, rng.randint(1, 2)),
        lambda: word() + "-" + ".".join(draw("0123456789", 1) for _ in range(4)) + "-linux-x86_64",
        lambda: ".".join(word() for _ in range(4)) + "." + word() + draw(digits, 1),
        lambda: draw(digits, rng.randint(14, 20)) + rng.choice(("px", "kg", "eur", "ms")),
        lambda: draw(digits, rng.randint(4, 8)) + rng.choice(("x" + draw(digits, 4), "mhz", "k" + draw(digits, 4))),
        lambda: (word() + word() + draw(digits, rng.randint(1, 4))).rjust(8, rng.choice(lower)),
        lambda: rng.choice(lower) + draw(digits, rng.randint(7, 11)),
        lambda: "".join(word() for _ in range(8)),
        lambda: "".join(word().capitalize() for _ in range(6)),
        lambda: draw(lower + digits, rng.randint(8, 12)),
    ]
    spoken = lambda: (word() + word()).rjust(8, rng.choice(lower))
    named = ("key", "auth", "bearer", "credential", "private_key", "access_key", "pwd", "token", "secret", "passphrase", "password")
    neutral = ("id", "file", "path", "version", "page", "name", "see", "ref", "host", "url")
    out = []
    for k in range(n):
        label, form = k % 2, rng.random()
        if label and form < 0.4:
            body, before = rng.choice(announced)(), rng.choice(named) + rng.choice((" = ", ": ", '="', "='", "="))
        elif not label and form < 0.25:  # "key features", "the secret admirers of"
            body, before = spoken(), rng.choice(named) + " "
        elif not label and form < 0.35:  # the host of an address
            body = word() + rng.choice(("", draw(digits, 1))) + "." + word() + word() + rng.choice((".com", ".org", ".net", ".example"))
            before = word() + rng.choice((".", "_", "")) + rng.choice((word(), draw(digits, 2))) + "@"
        else:
            body, before = rng.choice(secret if label else plain)(), ""
            if rng.random() < 0.4:
                before = rng.choice(named if label else neutral) + rng.choice((" = ", ": ", '="', " "))
        left = words(rng.randint(0, 5)) + " " + before
        text = left + body + rng.choice(("", " ", ". ", '" ', ", ")) + words(rng.randint(0, 4))
        out.append((text, len(left), len(left) + len(body), label))
    return out


def _encoded(findings: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols and flags of all windows, and the number of the finding that each is of."""
    rows, owner = [], []
    for k, (text, start, end) in enumerate(findings):
        windows = _windows(text, start, end)
        rows += windows
        owner += [k] * len(windows)
    symbols = np.frombuffer(b"".join(r[0] for r in rows), np.uint8).reshape(-1, WIDE)
    flags = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(-1, WIDE).astype(np.float32)
    return symbols, flags, np.array(owner, np.int64)


def train(findings: list[tuple[str, int, int, int]] | None = None, recall: float = 0.97, passes: int = 6, seed: int = 5) -> Network:
    """Fit on two thirds of the findings, calibrate on a sixth, set the threshold on the last sixth."""
    findings = labelled_findings() if findings is None else findings
    symbols, flags, owner = _encoded([f[:3] for f in findings])
    y = np.array([f[3] for f in findings], np.float32)[owner]
    rng = np.random.default_rng(seed)
    part = rng.permutation(len(findings)) * 6 // len(findings)  # no finding is in two parts
    fit, held = np.flatnonzero(part[owner] < 4), np.flatnonzero(part[owner] == 4)
    weights = [
        rng.normal(0, 0.3, (SYMBOLS, EMBED)), rng.normal(0, 0.15, (KERNEL * (EMBED + 1), FILTERS)), np.zeros(FILTERS),
        rng.normal(0, 0.2, 2 * FILTERS), np.zeros(1),
    ]
    weights = [w.astype(np.float32) for w in weights]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(passes):
        for batch in np.array_split(rng.permutation(fit), max(1, len(fit) // 48)):
            step += 1
            for w, m, v, g in zip(weights, first, second, _gradients(Network(*weights), symbols[batch], flags[batch], y[batch]), strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= 0.004 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net = Network(*weights)
    z, t = logits(net, symbols[held], flags[held]).astype(float), y[held].astype(float)
    scale, shift = 1.0, 0.0
    for _ in range(200):  # Platt scaling by Newton steps
        p = 1 / (1 + np.exp(-(scale * z + shift)))
        g = np.array([((p - t) * z).mean() + 1e-3 * (scale - 1), (p - t).mean()])
        s = p * (1 - p) + 1e-6
        h = np.array([[(s * z * z).mean() + 1e-3, (s * z).mean()], [(s * z).mean(), s.mean()]])
        move = np.clip(np.linalg.solve(h, g), -1, 1)
        scale, shift = scale - move[0], shift - move[1]
        if abs(move).max() < 1e-9:
            break
    net = net._replace(scale=float(scale), shift=float(shift))
    last = [f for f, where in zip(findings, part, strict=True) if where == 5 and f[3]]
    p = probabilities(net, [f[:3] for f in last])
    offered = [not _free(start, end, _union(candidates(text))) or not _free(start, end, _union(_base_spans(text))) for text, start, end, _ in last]
    p = np.sort(p * np.array(offered, bool))
    threshold = p[int((1 - recall) * len(p))] if len(p) else 0.5
    return net._replace(threshold=float(threshold or p[p > 0].min(initial=1.0)))


@lru_cache(maxsize=1)
def default_network() -> Network:
    return train()


def probabilities(net: Network, texts_and_spans: list[tuple[str, int, int]]) -> np.ndarray:
    """Calibrated probability of every candidate, the highest of its windows."""
    if not texts_and_spans:
        return np.zeros(0)
    symbols, flags, owner = _encoded(texts_and_spans)
    p = 1 / (1 + np.exp(-np.clip(net.scale * logits(net, symbols, flags) + net.shift, -50, 50)))
    out = np.zeros(len(texts_and_spans))
    np.maximum.at(out, owner, p)
    return out


def find_all(net: Network, texts: list[str]) -> list[list[Finding]]:
    """All findings of each text, by start and then by kind as listed."""
    found, asked, owner = [], [], []
    for k, text in enumerate(texts):
        base = base_findings(text)
        taken = _union([(f.start, f.end) for f in base])
        found.append([])
        for kind, start, end, _ in base:
            asked.append((text, start, end))
            owner.append((k, kind))
        for start, end in candidates(text):
            if _free(start, end, taken):
                asked.append((text, start, end))
                owner.append((k, "model"))
    for (_, start, end), (k, kind), p in zip(asked, owner, probabilities(net, asked), strict=True):
        if kind != "model" or p >= net.threshold:
            found[k].append(Finding(kind, start, end, float(p)))
    return [sorted(f, key=lambda f: (f.start, KINDS.index(f.kind))) for f in found]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def scan(docs: DataFrame, net: Network | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, findings array<struct<kind, start, end, score>>) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(net or default_network())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = find_all(shared.value, _texts(part.column(1)))
                rows = [[f._asdict() for f in one] for one in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(_SPAN))], names=["_id", "findings"])

    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = picked.schema["_id"].dataType.simpleString()
    return picked.mapInArrow(
        run, f"_id {kind}, findings array<struct<kind:string,start:bigint,end:bigint,score:double>>"
    ).withColumnRenamed("_id", id_col)


def blanked(text: str, found: list[Finding], mark: str) -> str:
    """The text with every finding, overlapping ones together, replaced by a mark."""
    out, at = [], 0
    for start, end in sorted((f.start, f.end) for f in found):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame, net: Network | None = None, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, with the findings in the text blanked; null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(net or default_network())
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                column = part.column(place)
                found = find_all(shared.value, _texts(column))
                texts = [t if not f else blanked(t, f, mark) for t, f in zip(column.to_pylist(), found, strict=True)]
                arrays = [*part.columns]
                arrays[place] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(arrays, names=list(part.schema.names))

    return docs.mapInArrow(run, docs.schema)
