"""Personal data by a skip-chain conditional random field.

Four base patterns find e-mail addresses, network addresses, payment cards and telephone numbers. The field
then looks at the words that could be such data (words with a digit or an @, and words that repeat the local
part of an address found): each is a node with a label (none or one of the four kinds), neighbours in the text
are joined by chain edges, and words that repeat or resemble each other anywhere in the document, such as a
telephone number without its country code or a number grouped in another way, by skip edges to the next one
like them. Loopy message passing over both sorts of edges makes the labels of a document agree; words within
base spans are evidence. Runs of words that come out as one kind, outside base spans, are added spans.

The potentials are learned by pseudo-likelihood: a word's label given its own form and context and its
neighbours' labels, with the base patterns as teacher, on a bounded sample of unlike examples.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, out_batch, pieces, stored

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)  # label 0: none
# The base patterns. Possessive where giving back can't help, so that long runs take linear time.
AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Words that may be nodes by their own form.
WORD = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
EDGE = ".,;:!?\"'()[]{}<>|*#$%/\\"  # stripped from words before they are compared
FEATURES = 1 << 13  # hashed features of a node
#: Distinct examples a label that training takes at most (all of them, or the share with the smallest hashes).
EXAMPLES = 8_000
ROUNDS, DAMPING = 12, 0.3
SURE = 0.9  # belief from which on a word is taken as personal data
CLAMP = 30.0
#: Prior mean of the skip edges' log potentials: for equal labels, and its negative for unequal ones.
#: The teacher labels each mention by its own form, so it can't show that look-alikes belong together.
AGREE = 6.0


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base patterns' matches, by kind, then start."""
    out = []
    if "@" in text:
        upto, at = 0, text.find("@")
        while at >= 0:
            # the leftmost match that ends its local part here begins with the run of its characters
            start = at
            while start > upto and text[start - 1] in LOCAL:
                start -= 1
            m = AT.match(text, at) if start < at else None
            if m:
                out.append((0, start, m.end()))
                upto = m.end()
            at = text.find("@", max(at + 1, upto))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.groups()):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[0], x[1], x[2])))


@dataclass
class Graph:
    """Nodes of one or more texts: places in the text, base label (0: none), hashed features; and edges."""

    start: np.ndarray
    end: np.ndarray
    label: np.ndarray
    features: list[list[int]]
    chain: np.ndarray  # (n, 2)
    skip: np.ndarray


def shape(word: str) -> str:
    """Digits as 9, ASCII letters as a or A, other letters as they are, runs of more than four cut to four."""
    out = re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"[0-9]", "9", word[:80])))
    return re.sub(r"(.)\1{4,}", r"\1\1\1\1+", out)


def features_of(word: str, before: str, after: str) -> list[int]:
    d = digits_of(word)
    names = ["bias", "shape=" + shape(word), "groups=" + re.sub(r"(.)\1+", r"\1", shape(word)), f"digits={min(len(d), 20)}", f"at={word.count('@')}",
             f"dots={min(word.count('.'), 5)}", f"first={shape(word[:1])}", f"last={shape(word[-1:])}", f"luhn={13 <= len(d) <= 19 and luhn(d)}",
             f"octets={bool(re.fullmatch(r'(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:[.](?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}', word))}",
             "before=" + shape(before.lower()) if any("0" <= c <= "9" for c in before) else "before=" + before.lower()[-20:], f"after={shape(after[:1])}"]
    return sorted({zlib.crc32(n.encode()) % FEATURES for n in names})


def keys_of(word: str) -> list[str]:
    """What makes words alike: the word itself, the local part of an address, the last seven digits."""
    core = word.strip(EDGE).lower()
    keys = []
    if len(core) >= 3 and (len(core) > 3 or not core.isdigit()):
        keys.append(core)
    if not word.isalnum() and len(digits_of(word[:40])) >= 3 and len(core) == 3:
        keys.append(word)  # such as an area code in brackets
    if "@" in core and len(local := core.split("@")[0].lstrip("<(")) >= 4:
        keys.append(local)
    d = digits_of(core)
    if len(d) >= 7:
        keys.append("#" + d[-7:])
    return keys


def graph_of(text: str, base: list[tuple[int, int, int]]) -> Graph | None:
    """The field's graph of one text; None where nothing could be personal data."""
    found = [(m.start(), m.end()) for m in WORD.finditer(text)] if any(c in text for c in "@0123456789") else []
    locals_ = sorted({local for k, a, b in base if k == 0 and len(local := text[a:b].split("@")[0]) >= 4 and re.search(r"[._%+-]", local)})
    for local in locals_:  # words without digits that repeat a local part
        at = text.find(local) if not re.search(r"[0-9]", local) else -1
        while at >= 0:
            if (at == 0 or text[at - 1].isspace() or text[at - 1] in EDGE) and (at + len(local) == len(text) or text[at + len(local)].isspace() or text[at + len(local)] in EDGE):
                found.append((at, at + len(local)))
            at = text.find(local, at + len(local))
    if not found:
        return None
    found = sorted(set(found))
    start, end = np.array([a for a, _ in found]), np.array([b for _, b in found])
    label = np.zeros(len(found), np.int64)
    spans = sorted((a, b, k) for k, a, b in base)
    for a, b, k in reversed(spans):  # the first to begin has the last word
        lo, hi = np.searchsorted(end, a, side="right"), np.searchsorted(start, b, side="left")
        label[lo:hi] = k + 1
    words = [text[a:b] for a, b in found]
    trimmed = [w.strip(EDGE) or w for w in words]
    feats = []
    for i, (a, b) in enumerate(found):
        head, tail = text[max(0, a - 40):a].rsplit(None, 1), text[b:b + 40].split(None, 1)
        feats.append(features_of(trimmed[i], head[-1] if head else "", tail[0] if tail else ""))
    near = np.flatnonzero(np.array([text[end[i]:start[i + 1]].isspace() for i in range(len(found) - 1)], bool))
    chain = np.stack([near, near + 1], 1).reshape(-1, 2)
    last, skip = {}, set()
    for i, w in enumerate(words):
        for key in keys_of(w):
            if key in last and last[key] != i:
                skip.add((last[key], i))
            last[key] = i
    return Graph(start, end, label, feats, chain, np.array(sorted(skip), np.int64).reshape(-1, 2))


@dataclass
class Field:
    """Log potentials: of a feature and a label, and of two labels across a chain and a skip edge."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def scores(self, features: list[list[int]]) -> np.ndarray:
        size = np.array([len(f) for f in features])
        flat = np.array([x for f in features for x in f], np.int64)
        return np.add.reduceat(self.unary[flat], np.cumsum(size) - size, axis=0) if len(features) else np.zeros((0, LABELS))


def log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=-1, keepdims=True)
    return top + np.log(np.exp(x - top).sum(axis=-1, keepdims=True))


def beliefs(node: np.ndarray, edges: list[tuple[np.ndarray, np.ndarray]], rounds: int = ROUNDS, damping: float = DAMPING) -> np.ndarray:
    """Label probabilities by loopy sum-product. node: log potentials of nodes and labels; edges: sorts of
    edges, each as (from, to) pairs and the log potentials [label of from, label of to] all of them share.
    Exact where the graph is a forest no deeper than ``rounds`` (damping 0), else the usual approximation."""
    ways = [(a, b, np.exp(m)) for e, pot in edges if len(e) for a, b, m in ((e[:, 0], e[:, 1], pot), (e[:, 1], e[:, 0], pot.T))]
    sent = [np.zeros((len(a), node.shape[1])) for a, _, _ in ways]

    def gathered() -> np.ndarray:
        total = node.copy()
        for (_, b, _), x in zip(ways, sent, strict=True):
            np.add.at(total, b, x)
        return total

    for _ in range(rounds if ways else 0):
        total, new = gathered(), []
        for k, (a, _, m) in enumerate(ways):
            into = total[a] - sent[k ^ 1]  # all that the sender knows but from the receiver; ways come in pairs
            top = into.max(1, keepdims=True)
            x = np.log(np.exp(into - top) @ m) + top
            new.append(damping * sent[k] + (1 - damping) * (x - log_sum(x)))
        sent = new
    total = gathered()
    return np.exp(total - log_sum(total))


def labelled(graphs: list[Graph], field: Field) -> list[np.ndarray]:
    """Label (0: none or not sure) of the nodes of each graph, all graphs in one pass."""
    sizes = [len(g.start) for g in graphs]
    shift = np.cumsum([0, *sizes])
    label = np.concatenate([g.label for g in graphs])
    node = field.scores([f for g in graphs for f in g.features])
    node[label > 0] = -CLAMP
    node[np.flatnonzero(label > 0), label[label > 0]] = CLAMP  # base spans are evidence
    chain, skip = (np.concatenate([getattr(g, k) + s for g, s in zip(graphs, shift[:-1].tolist(), strict=True)]).astype(np.int64) for k in ("chain", "skip"))
    b = beliefs(node, [(chain, field.chain), (skip, field.skip)])
    best = b.argmax(1)
    best[b.max(1) < SURE] = 0
    # a word is not taken for its neighbour's sake alone: its own form or a look-alike must speak for the label
    own = node.argmax(1) == best
    for a, c in (skip.T, skip.T[::-1]):
        np.logical_or.at(own, a, best[a] == best[c])
    best[~own] = 0
    return [best[shift[i]:shift[i + 1]] for i in range(len(graphs))]


def plausible(kind: int, text: str) -> bool:
    """Whether a span has what its kind can't do without."""
    n = len(digits_of(text))
    return (not text.isdigit(), text.count(".") >= 3, 13 <= n <= 19 and luhn(digits_of(text)), 7 <= n <= 15)[kind]


def added_spans(text: str, base: list[tuple[int, int, int]], g: Graph, label: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of neighbouring words of one kind that touch no base span, without the punctuation at their ends."""
    out, i = [], 0
    joined_ = {(int(a), int(b)) for a, b in g.chain}
    while i < len(label):
        j = i + 1
        if label[i] and not g.label[i]:
            while j < len(label) and label[j] == label[i] and not g.label[j] and (j - 1, j) in joined_:
                j += 1
            a, b = int(g.start[i]), int(g.end[j - 1])
            while a < b and text[a] in EDGE and text[a] != "(":
                a += 1
            while a < b and text[b - 1] in EDGE and text[b - 1] != ")":
                b -= 1
            if a < b and plausible(int(label[i]) - 1, text[a:b]) and not any(x < b and a < y for _, x, y in base):
                out.append((int(label[i]) - 1, a, b))
        i = j
    return out


def example_rows(g: Graph) -> Iterator[tuple[int, tuple[int, ...], tuple[int, ...]]]:
    """(label, features, neighbours' labels: counts over chain edges out, in, and skip edges) of each node the
    teacher knows: a word outside base spans that resembles one within such a span isn't taken as none."""
    near = defaultdict(lambda: [0] * (3 * LABELS))
    unsure = set()
    for a, b in g.skip.tolist():
        if (g.label[a] > 0) != (g.label[b] > 0):
            unsure.add(b if g.label[a] else a)
    for edges, out, into in ((g.chain, 0, LABELS), (g.skip, 2 * LABELS, 2 * LABELS)):
        for a, b in edges.tolist():
            if a not in unsure and b not in unsure:
                near[a][out + int(g.label[b])] += 1
                near[b][into + int(g.label[a])] += 1
    for i, f in enumerate(g.features):
        if i in unsure:
            continue
        yield int(g.label[i]), tuple(f), tuple(min(x, 3) for x in near[i])


def agreement() -> np.ndarray:
    """Prior mean of the skip potentials."""
    return AGREE * (2 * np.eye(LABELS) - 1)


def fit(label: np.ndarray, features: list[list[int]], near: np.ndarray, weight: np.ndarray, steps: int = 300, rate: float = 0.1, shrink: float = 1e-4) -> Field:
    """Pseudo-likelihood by Adam over all examples at once. near: counts of neighbours' labels as in
    ``example_rows``; an edge's potential is one matrix, seen from both of its ends."""
    size = np.array([len(f) for f in features])
    flat, begin = np.array([x for f in features for x in f], np.int64), np.cumsum(size) - size
    rows = np.repeat(np.arange(len(size)), size)
    w = (weight / weight.sum())[:, None]
    truth = np.eye(LABELS)[label]
    prior = agreement()
    p = [np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), prior.copy()]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    out, into, skip = near[:, :LABELS], near[:, LABELS:2 * LABELS], near[:, 2 * LABELS:]
    for t in range(1, steps + 1):
        score = np.add.reduceat(p[0][flat], begin, axis=0) + out @ p[1].T + into @ p[1] + skip @ p[2]
        d = w * (np.exp(score - log_sum(score)) - truth)
        unary = np.zeros_like(p[0])
        np.add.at(unary, flat, d[rows])
        s = skip.T @ d
        grads = [unary, d.T @ out + into.T @ d, (s + s.T) / 2]
        for k, g in enumerate(grads):
            g = g + shrink * (p[k] if k < 2 else 10 * (p[k] - prior))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Field(*p)


def learn(docs: DataFrame, limit: int = EXAMPLES) -> Field:
    """The field learned from the words of all ``docs``: equal examples are counted on Spark, and of the unlike
    ones of each label about ``limit`` at most come to the driver (each some hundred bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 4 << 20):
            seen: dict[tuple, int] = defaultdict(int)
            for t in column(b, "text"):
                if t and (g := graph_of(t, base_spans(t))):
                    for e in example_rows(g):
                        seen[e] += 1
            rows = list(seen)
            yield out_batch(label=pa.array([r[0] for r in rows], pa.int32()), features=pa.array([list(r[1]) for r in rows], pa.list_(pa.int32())),
                            near=pa.array([list(r[2]) for r in rows], pa.list_(pa.int32())), n=pa.array(list(seen.values()), pa.int64()))

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "label int, features array<int>, near array<int>, n bigint")
    distinct = stored(rows.groupBy("label", "features", "near").agg(F.sum("n").alias("n")), "pii_examples")
    sizes = {r["label"]: r["n"] for r in distinct.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Field(np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), agreement())
    place = F.pmod(F.xxhash64("features", "near"), F.lit(1 << 30))
    share = F.lit(False)
    for k, n in sizes.items():
        share = share | ((F.col("label") == k) & (place < ((1 << 30) if n <= limit else int((1 << 30) * 0.9 * limit / n))))
    sample = sorted(distinct.where(share).collect(), key=lambda r: (r["label"], r["features"], r["near"]))
    # a form seen a million times still leaves the others a say
    weight = np.array([1.0 + np.log(r["n"]) for r in sample])
    return fit(np.array([r["label"] for r in sample]), [r["features"] for r in sample], np.array([r["near"] for r in sample], float), weight)


def find_personal(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 (of the
    base spans kind:start:end, by kind, then start), spans (all spans, likewise) and n_added. Places are code
    points, ends exclusive. ``field``: a learned one; None: learned from ``docs``.

    Null or empty text: no spans. Base spans of unlike kinds may overlap and are all reported; an added span
    touches none. Repeated rows give repeated results, a null doc_id is carried along, an empty table gives an
    empty result."""
    field = field or learn(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 4 << 20):
            texts = [t or "" for t in column(b, "text")]
            base = [base_spans(t) for t in texts]
            graphs = [(i, g) for i, t in enumerate(texts) if (g := graph_of(t, base[i]))]
            spans = [list(x) for x in base]
            for (i, g), label in zip(graphs, labelled([g for _, g in graphs], field) if graphs else [], strict=True):
                spans[i] += added_spans(texts[i], base[i], g, label)
            count = [[sum(s[0] == k for s in x) for x in base] for k in range(len(KINDS))]
            yield out_batch(doc_id=pa.array(column(b, "doc_id"), pa.int64()), **{f"n_{k}": pa.array(c, pa.int64()) for k, c in zip(KINDS, count, strict=True)},
                            base_sha256=pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base], pa.string()),
                            spans=pa.array([joined(x) for x in spans], pa.string()), n_added=pa.array([len(x) - len(y) for x, y in zip(spans, base, strict=True)], pa.int64()))

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint")
