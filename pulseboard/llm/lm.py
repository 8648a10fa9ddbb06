"""Document log-likelihood by a gated recurrent language model.

Words are counted over all training documents. The most frequent ``head`` words are units of the model;
every other word belongs to a class of its form (ending, letters beyond ASCII) and counts within it. The
softmax is factored: P(word) = P(class | state) P(word | class), where a class of head words has a softmax
of its own on the state and a class of form its words' smoothed counts. The state is that of a gated
recurrent unit; at scoring it runs through a whole document, window after window, reset only at its start.

Training is distributed and learns from every token of the training documents: they are dealt by hash to
groups of a fixed number of tokens, truncated backpropagation runs over each group from the current weights,
the weights are averaged in a tree of small sums, and a second round over all groups starts from the average.

Texts are split once, into stored chunks of word numbers, each with its own list of words; counting, training and
scoring read those and look up a chunk's distinct words only.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, id_crc32, out_batch, pieces, stored, text_bytes

END = b""  # closes every document; no word is empty
GROUP = 32  # head words of one class
FORMS = 16 + 3 + 32
HIDDEN = 20
SEGMENT = 1024  # tokens of a document that are learned from in one lane; longer ones go on in another
WINDOW = 64  # steps scored between two visits of the output layer
BLOCK = 512  # states whose chances are worked out at once: they stay in the processor's cache
LN10 = float(np.log(10.0))


# -- words ------------------------------------------------------------------

def tokens(data: bytes) -> list[bytes]:
    return [*data.lower().split(), END]


def form(word: bytes) -> int:
    """The class of form of a word: ASCII words by what they end with, others by their first letter beyond ASCII."""
    last = word[-1:]
    if word.isascii():
        if last.isalnum():
            return (word[-1] * 3 + (word[-2] * 7 if len(word) > 1 else 0)) % 16
        return 16 + (0 if last == b"." else 1 if last == b"," else 2)
    second = next((b for a, b in zip(word, word[1:], strict=False) if a >= 0xC0), 0)
    return 19 + (second & 15) * 2 + (last in (b".", b",") or (last < b"\x80" and not last.isalnum()))


ALNUM = np.array([bytes([k]).isalnum() for k in range(256)])


def forms(joined: bytes, words: list[bytes]) -> np.ndarray:
    """The form of each word of a list (also given joined by spaces)."""
    text = np.frombuffer(b" " + joined + b" ", np.uint8)
    gaps = np.flatnonzero(text == 32)
    begin, end = gaps[:-1] + 1, gaps[1:]
    last, second = text[end - 1].astype(np.int64), text[np.maximum(end - 2, 0)].astype(np.int64)
    out = np.where(ALNUM[last], (last * 3 + np.where(end - begin > 1, second * 7, 0)) % 16, np.where(last == 46, 16, np.where(last == 44, 17, 18)))
    for k in np.flatnonzero(np.maximum.reduceat(text, begin) >= 128).tolist():
        out[k] = form(words[k])
    return out


def is_training() -> F.Column:
    return id_crc32(F.col("doc_id")) % 7 != 2


CHUNK = "row bigint, ids array<bigint>, learn binary, deal binary, sizes binary, places binary, words binary, tally binary"


def split_texts(docs: DataFrame) -> DataFrame:
    """Documents as chunks of some 250,000 tokens, each with its own list of words, so that later steps look up a
    chunk's distinct words only. row: number of the first document; ids: of the documents; learn: whether each is a
    training one; deal: its key and number among equal rows, by eights; sizes: its tokens; places: of all tokens, in
    the list; words: the list, joined by spaces; tally: how often training documents hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, seen = TaskContext.get().partitionId() << 40, Counter()
        ids, learn, deal, lines, size = [], [], [], [], 0
        place: defaultdict = defaultdict()
        place.default_factory = place.__len__  # a new word takes the next place

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal row, size
            if ids:
                tally = np.zeros(len(place), np.int64)
                of = [x for x, k in zip(lines, learn, strict=True) if k]
                if of:
                    tally += np.bincount(np.concatenate(of), minlength=len(place))
                one = {"learn": np.array(learn), "deal": np.array(deal, np.int64), "sizes": np.array([len(x) for x in lines], np.int64), "places": np.concatenate(lines).astype(place_kind(len(place)))}
                yield out_batch(row=pa.array([row], pa.int64()), ids=pa.array([ids], pa.list_(pa.int64())), **{k: pa.array([x.tobytes()], pa.binary()) for k, x in one.items()},
                                words=pa.array([b" ".join(place)], pa.binary()), tally=pa.array([tally.tobytes()], pa.binary()))
                row, size = row + len(ids), 0
                for x in (ids, learn, deal, lines, place):
                    x.clear()

        for b in pieces(batches):
            for i, k, t in zip(column(b, "doc_id"), column(b, "learn"), text_bytes(b), strict=True):
                key = zlib.crc32(t, zlib.crc32(str(i).encode()))
                seen[key] += k
                words = tokens(t)
                ids.append(i)
                learn.append(k)
                deal.append((key, (seen[key] - 1) // 8))
                lines.append(np.fromiter(map(place.__getitem__, words), np.uint32, len(words)))
                size += len(words)
                if size >= 250_000 or len(place) > 50_000:
                    yield from flush()
        yield from flush()

    return docs.select("doc_id", is_training().alias("learn"), "text").mapInArrow(run, CHUNK)


def place_kind(words: int) -> type:
    return np.uint16 if words <= 1 << 16 else np.uint32


def as_chunks(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) as chunks; chunks as they are."""
    return split_texts(docs) if "text" in docs.columns else docs


def chunk_lines(b: pa.RecordBatch, v: Vocabulary) -> Iterator[tuple]:
    """Per chunk of a batch: (its row in the batch, tokens of each document, places of all tokens, words, units and
    known places of the words)."""
    for r, (sizes, places, joined) in enumerate(zip(column(b, "sizes"), column(b, "places"), column(b, "words"), strict=True)):
        words = joined.split(b" ")
        yield r, np.frombuffer(sizes, np.int64), np.frombuffer(places, place_kind(len(words))), words, *units_of(joined, words, v)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word, and the end, stands in the training documents; partial counts are
    made in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            if seen:
                yield out_batch(word=pa.array(list(seen), pa.binary()), n=pa.array(list(seen.values()), pa.int64()))
                seen.clear()

        for b in batches:
            for words, tally in zip(column(b, "words"), column(b, "tally"), strict=True):
                for w, n in zip(words.split(b" "), np.frombuffer(tally, np.int64).tolist(), strict=True):
                    if n:
                        seen[w] = seen.get(w, 0) + n
                if len(seen) > 250_000:
                    yield from flush()
        yield from flush()

    return as_chunks(docs).select("words", "tally").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Counts of the most frequent words (``words`` by falling count; the first ``head`` are units) and the
    totals: all tokens, all words, and tokens and words of each class of form beyond the head."""

    words: list[bytes]
    counts: np.ndarray
    head: int
    total: int
    distinct: int
    form_tokens: np.ndarray
    form_words: np.ndarray
    place: dict[bytes, int] = field(init=False, repr=False)

    def __post_init__(self):
        self.place = {w: k for k, w in enumerate(self.words)}

    @property
    def groups(self) -> int:
        return -(-self.head // GROUP)

    @property
    def units(self) -> int:
        return self.head + FORMS

    @property
    def classes(self) -> int:
        return self.groups + FORMS

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "place"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()


def vocabulary(counts: DataFrame, known: int, head: int) -> Vocabulary:
    """``known`` words come to the driver at most (the most frequent, down to a count that lets in no more
    than that); the rest only as totals by form."""
    size = F.floor(F.log2("n") * 64)  # some thousand classes of counts, whatever the input
    least, room = None, known
    for r in counts.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("size")).collect():
        room -= r["words"]
        if room < 0:
            break
        least = r["size"]
    found = counts.where(size >= least).toArrow() if least is not None else counts.limit(0).toArrow()
    top = sorted(zip(found["n"].to_pylist(), found["word"].to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
    words = [bytes(w) for _, w in top]
    head = min(head, len(words))
    first = set(words[:head])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_, words_ = [0] * FORMS, [0] * FORMS
        for b in batches:
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if w not in first:
                    k = form(w)
                    tokens_[k] += n
                    words_[k] += 1
        yield out_batch(form=pa.array(range(FORMS), pa.int32()), tokens=pa.array(tokens_, pa.int64()), words=pa.array(words_, pa.int64()))

    sums = counts.select("word", "n").mapInArrow(run, "form int, tokens bigint, words bigint").groupBy("form").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).collect()
    by_form = np.zeros((2, FORMS), np.int64)
    for r in sums:
        by_form[:, r["form"]] = r["tokens"], r["words"]
    n = np.array([k for k, _ in top], np.int64)
    return Vocabulary(words, n, head, int(by_form[0].sum() + n[:head].sum()), int(by_form[1].sum() + head), by_form[0], by_form[1])


# -- the network ------------------------------------------------------------

def shapes(v: Vocabulary) -> dict[str, tuple[int, ...]]:
    h = HIDDEN
    return {"emb": (v.units + 1, h), "wx": (h, 3 * h), "wh": (h, 3 * h), "b": (3 * h,), "wc": (h, v.classes), "bc": (v.classes,), "ww": (max(1, v.groups), GROUP, h), "bw": (max(1, v.groups), GROUP)}


def start_weights(v: Vocabulary) -> dict[str, np.ndarray]:
    """Small random weights; the output biases give the words' frequencies."""
    rng = np.random.default_rng(7)
    p = {k: (rng.normal(size=s) * 0.1).astype(np.float32) for k, s in shapes(v).items()}
    for k in ("b", "bc", "bw"):
        p[k][:] = 0
    head = np.zeros(max(1, v.groups) * GROUP)
    head[:v.head] = v.counts[:v.head]
    mass = np.concatenate([head.reshape(-1, GROUP).sum(1)[:v.groups], v.form_tokens + v.form_words + 1.0])
    p["bc"][:] = np.log(np.maximum(mass, 1) / max(1.0, mass.sum()))
    bw = np.where(head > 0, np.log(np.maximum(head, 1)), -1e9).reshape(-1, GROUP)
    p["bw"][:] = np.maximum(bw - bw.max(1, keepdims=True), -1e9)
    return p


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([x.reshape(-1) for x in p.values()]).astype(np.float32)


def unflat(x: np.ndarray, v: Vocabulary, copy: bool = True) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shapes(v).items():
        n = int(np.prod(s))
        out[k], at = x[at:at + n].reshape(s), at + n
    return {k: x.copy() for k, x in out.items()} if copy else out


def sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)  # may overflow: the result is zero then
    x += 1
    return np.reciprocal(x, out=x)


def step(xt: np.ndarray, h: np.ndarray, wh: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step of the unit: (new state, gates, candidate, its recurrent part). xt: input part of the gates.
    Rows are lanes; the results lie in memory feature by feature, which is quickest if xt and h do so too."""
    n = HIDDEN
    a = wh.T @ h.T
    gates = sigmoid(a[:2 * n] + xt.T[:2 * n])
    cand = gates[:n] * a[2 * n:]
    cand += xt.T[2 * n:]
    np.tanh(cand, out=cand)
    new = h.T - cand
    new *= gates[n:]
    new += cand
    return new.T, gates.T, cand.T, a[2 * n:].T


def class_of(unit: np.ndarray, v: Vocabulary) -> np.ndarray:
    return np.where(unit < v.head, unit // GROUP, v.groups + unit - v.head)


def output_layers(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the classes and of each class's words, the bias as a last column."""
    return np.vstack([p["wc"], p["bc"]]).T.copy(), np.concatenate([p["ww"], p["bw"][..., None]], axis=2)


def bounded(w: np.ndarray) -> np.ndarray:
    """Whether exp of w @ state neither overflows nor vanishes in all rows, whatever the state (its parts lie
    between -1 and 1, the last is 1); then the greatest need not be taken off first."""
    reach = np.abs(w[..., :-1]).sum(-1)
    return ((w[..., -1] + reach).max(-1) < 60) & ((w[..., -1] - reach).max(-1) > -60)


def by_class(unit: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order by class, units and classes in that order, where each class of head words begins, and their end)."""
    cls = class_of(unit, v).astype(np.min_scalar_type(v.classes))  # short integers sort fast
    order = np.argsort(cls, kind="stable")
    cls = cls[order]
    return order, unit[order], cls, np.searchsorted(cls, np.arange(v.groups + 1))


def output(p: dict[str, np.ndarray], h: np.ndarray, unit: np.ndarray, v: Vocabulary, at: np.ndarray | None = None) -> np.ndarray:
    """Natural log of P(unit) for each state (each at a place of ``at``, if given): of its class and, in the head,
    of the word within it."""
    out, (wc, ww) = np.empty(len(unit), h.dtype), output_layers(p)
    order, unit, cls, cuts = by_class(unit, v)
    s = np.ones((HIDDEN + 1, len(unit)), h.dtype)
    np.take(h.T, order if at is None else at[order], axis=1, out=s[:-1])

    room, count = np.empty(max(len(wc), GROUP) * BLOCK, h.dtype), np.arange(BLOCK)

    def logs(w: np.ndarray, plain: bool, a: int, b: int, row: np.ndarray) -> np.ndarray:
        line = room[:len(w) * (b - a)]
        z = np.matmul(w, s[:, a:b], out=line.reshape(len(w), b - a))
        if not plain:
            z -= z.max(0)
        got = line[row * np.int64(b - a) + count[:b - a]]
        return got - np.log(np.exp(z, out=z).sum(0))

    plain, in_class, found = bounded(wc), bounded(ww), np.empty(len(unit), h.dtype)
    for a in range(0, len(unit), BLOCK):
        b = min(a + BLOCK, len(unit))
        found[a:b] = logs(wc, plain, a, b, cls[a:b])
    for g in range(v.groups):
        for a in range(cuts[g], cuts[g + 1], BLOCK):
            b = min(a + BLOCK, cuts[g + 1])
            found[a:b] += logs(ww[g], in_class[g], a, b, unit[a:b] % GROUP)
    out[order] = found
    return out


@np.errstate(over="ignore")
def gradients(p: dict[str, np.ndarray], units: np.ndarray, targets: np.ndarray, live: np.ndarray, h0: np.ndarray, reset: np.ndarray, v: Vocabulary) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Of one window (steps x lanes): gradients of the mean negative log-likelihood, and the last state.
    ``reset``: lanes whose document starts at a step; ``live``: tokens that count. Arrays hold a row for each
    feature, tokens in order of steps and lanes (at the output layers in order of their class)."""
    n, (steps, lanes), kind = HIDDEN, units.shape, p["wh"].dtype
    table = p["emb"] @ p["wx"] + p["b"]
    xt = np.ascontiguousarray(table[units].transpose(0, 2, 1))
    fresh, going = reset.any(1).tolist(), (~reset).astype(kind)
    h, kept, hs = h0.T, [], np.empty((steps, n, lanes), kind)
    for t in range(steps):
        if fresh[t]:
            h = h * going[t]
        new, gates, cand, rec = step(xt[t].T, h.T, p["wh"])
        kept.append((h, gates.T, cand.T, rec.T))
        h = hs[t] = new.T
    at = np.flatnonzero(live)
    order, unit, cls, cuts = by_class(targets.reshape(-1)[at], v)
    at, m = at[order], len(at)
    s = np.ones((n + 1, m), kind)
    np.take(hs.transpose(1, 0, 2).reshape(n, -1), at, axis=1, out=s[:-1], mode="clip")
    wc, ww = output_layers(p)
    ds, gc, gw = np.zeros((n, m + 1), kind), np.zeros_like(wc), np.zeros_like(ww)
    room, count, share = np.empty(max(len(wc), GROUP) * BLOCK, kind), np.arange(BLOCK), kind.type(1 / max(1, m))

    def back(w: np.ndarray, grad: np.ndarray, plain: bool, a: int, b: int, row: np.ndarray) -> np.ndarray:
        line, x = room[:len(w) * (b - a)], s[:, a:b]
        z = np.matmul(w, x, out=line.reshape(len(w), b - a))
        if not plain:
            z -= z.max(0)
        np.exp(z, out=z)
        total = z.sum(0)
        line[row * np.int64(b - a) + count[:b - a]] -= total
        scale = share / total
        grad += z @ (x * scale).T
        sent = w[:, :-1].T @ z
        sent *= scale
        return sent

    plain, in_class = bounded(wc), bounded(ww)
    for a in range(0, m, BLOCK):
        b = min(a + BLOCK, m)
        ds[:, a:b] = back(wc, gc, plain, a, b, cls[a:b])
    for c in range(v.groups):
        if cuts[c] < cuts[c + 1]:
            for a in range(cuts[c], cuts[c + 1], BLOCK):
                b = min(a + BLOCK, cuts[c + 1])
                ds[:, a:b] += back(ww[c], gw[c], in_class[c], a, b, unit[a:b] % GROUP)
    place = np.full(steps * lanes, m)  # tokens that don't count take the last column, zero
    place[at] = np.arange(m)
    dhs = np.ascontiguousarray(ds.take(place, axis=1, mode="clip").reshape(n, steps, lanes).transpose(1, 0, 2))
    # sent back to the input part of candidate and gates, and to the recurrent part of gates and candidate
    sent, dh, wh = np.empty((steps, 4 * n, lanes), kind), np.zeros((n, lanes), kind), np.zeros_like(p["wh"])
    for t in range(steps - 1, -1, -1):
        h, gates, cand, rec = kept[t]
        r, u, (cand_, r_, u_, rec_) = gates[:n], gates[n:], sent[t].reshape(4, n, lanes)
        d = dhs[t]
        d += dh
        stay = d * u
        d -= stay
        np.subtract(h, cand, out=u_)
        cand *= cand
        np.subtract(1, cand, out=cand)
        np.multiply(d, cand, out=cand_)
        np.multiply(cand_, r, out=rec_)
        np.multiply(rec_, rec, out=r_)
        np.subtract(1, gates, out=gates)
        u_ *= stay
        sent[t, n:3 * n] *= gates
        da = sent[t, n:]
        wh += h @ da.T
        dh = p["wh"] @ da
        dh += stay
        if fresh[t]:
            dh *= going[t]
    g = {"wh": wh, "wc": gc[:, :n].T, "bc": gc[:, n], "ww": gw[..., :n], "bw": gw[..., n]}
    # the input layers by unit: what all places of a unit send back is added up first
    line = units.reshape(-1)
    order = np.argsort(line.astype(np.min_scalar_type(v.units)), kind="stable")
    line = line[order]
    starts = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    by_unit = np.zeros((3 * n, v.units + 1), kind)
    sums = np.add.reduceat(sent[:, :3 * n].transpose(1, 0, 2).reshape(3 * n, -1).take(order, axis=1, mode="clip"), starts, axis=1)
    by_unit[:, line[starts]] = np.concatenate([sums[n:], sums[:n]])
    g["wx"], g["b"], g["emb"] = (by_unit @ p["emb"]).T, by_unit.sum(1), (p["wx"] @ by_unit).T
    return {k: g[k] for k in p}, hs[-1].T


def train_here(p: dict[str, np.ndarray], segments: list[np.ndarray], v: Vocabulary, lanes: int = 256, steps: int = 16, rate: float = 0.01) -> tuple[dict[str, np.ndarray], int]:
    """Truncated backpropagation over segments of documents (the unit before, then the segment's units), dealt
    to at most ``lanes`` lanes; the state is carried from window to window. Adam steps; returns the weights and
    the tokens learned from."""
    lanes = max(4, min(lanes, sum(map(len, segments)) // 2048))
    queues: list[list[np.ndarray]] = [[] for _ in range(lanes)]
    load = [(0, k) for k in range(lanes)]
    for d in segments:
        n, k = heapq.heappop(load)
        queues[k].append(d)
        heapq.heappush(load, (n + len(d) - 1, k))
    longest = max((n for n, _ in load), default=0)
    size = -(-longest // steps) * steps
    units, targets = np.full((lanes, size), v.units, np.int64), np.zeros((lanes, size), np.int64)
    reset, live = np.zeros((lanes, size), bool), np.zeros((lanes, size), bool)
    for k, q in enumerate(queues):
        if q:
            line = np.concatenate([d[1:] for d in q])
            starts = np.cumsum([0] + [len(d) - 1 for d in q])[:-1]
            targets[k, :len(line)], live[k, :len(line)], reset[k, starts] = line, True, True
            units[k, :len(line)] = np.concatenate([d[:-1] for d in q])
    w = flat(p)
    p = unflat(w, v, copy=False)
    m, s = np.zeros_like(w), np.zeros_like(w)
    h = np.zeros((lanes, HIDDEN), np.float32)
    for t, a in enumerate(range(0, size, steps), 1):
        cut = slice(a, a + steps)
        parts, h = gradients(p, units[:, cut].T, targets[:, cut].T, live[:, cut].T, h, reset[:, cut].T, v)
        g = flat(parts)
        g *= min(1.0, 1.0 / (float(np.sqrt(g @ g)) + 1e-9))
        m += np.float32(0.1) * (g - m)
        g *= g
        s += np.float32(0.01) * (g - s)
        w -= np.float32(rate / (1 - 0.9**t)) * m / (np.sqrt(s / np.float32(1 - 0.99**t)) + np.float32(1e-6))
    return p, int(live.sum())


def units_of(joined: bytes, words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(units, places among the known words or -1) of the words of a list."""
    at = np.fromiter(map(v.place.get, words, repeat(-1)), np.int64, len(words))
    return np.where((at >= 0) & (at < v.head), at, v.head + forms(joined, words)), at


def training_units(docs: DataFrame, v: Vocabulary, groups: int) -> DataFrame:
    """(grp, key, units) of the segments of all training documents, grp by hash. Equal rows are numbered within
    a task and dealt on after every eighth, so that no group grows with the copies of one row."""
    kind = np.uint16 if v.units < 1 << 16 else np.int32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 4 << 20):
            flags, deals = column(b, "learn"), column(b, "deal")
            for r, sizes, places, _, unit, _ in chunk_lines(b, v):
                keys, times, parts, units = [], [], [], []
                line, deal = unit.astype(kind)[places], np.frombuffer(deals[r], np.int64).reshape(-1, 2).tolist()
                ends = np.cumsum(sizes)
                for d in np.flatnonzero(np.frombuffer(flags[r], bool)).tolist():
                    one = np.concatenate([np.array([v.units], kind), line[ends[d] - sizes[d]:ends[d]]])
                    for a in range(0, len(one) - 1, SEGMENT):
                        keys.append(deal[d][0])
                        times.append(deal[d][1])
                        parts.append(a)
                        units.append(one[a:a + SEGMENT + 1].tobytes())
                yield out_batch(key=pa.array(keys, pa.int64()), times=pa.array(times, pa.int64()), part=pa.array(parts, pa.int64()), units=pa.array(units, pa.binary()))

    rows = as_chunks(docs).select("learn", "deal", "sizes", "places", "words").mapInArrow(run, "key bigint, times bigint, part bigint, units binary")
    key = F.xxhash64("key", "times", "part")
    return rows.select(F.pmod(key, F.lit(groups)).alias("grp"), key.alias("key"), "units")


def train(docs: DataFrame, v: Vocabulary, rounds: int, budget: int) -> np.ndarray:
    """Weights after ``rounds`` rounds over all tokens of the training documents. A group of about ``budget``
    tokens is learned from between two averages, whatever the table's size and partitions; its segments
    stand in order of their hash."""
    weights = flat(start_weights(v))
    groups = max(1, -(-v.total // budget))
    kind = np.uint16 if v.units < 1 << 16 else np.int32
    source = training_units(docs, v, groups)
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            total, w, group, segments = 0, 0, None, []

            def learn():
                nonlocal total, w
                p, n = train_here(unflat(weights, v), segments, v)
                total, w = total + n, w + flat(p).astype(np.float64) * n

            for b in pieces(batches):
                for g, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if g != group and segments:
                        learn()
                        segments = []
                    group = g
                    segments.append(np.frombuffer(x, kind))
            if segments:
                learn()
                yield out_batch(n=pa.array([total], pa.int64()), w=pa.array([w.tobytes()], pa.binary()))

        dealt = source.repartition(min(groups, 4096), "grp").sortWithinPartitions("grp", "key", "units").select("grp", "units")
        sums = stored(dealt.mapInArrow(run, "n bigint, w binary"), "lm_weights")
        rows = sums.count()
        while rows > 16:  # a tree of sums, so that a few rows come to the driver
            rows = -(-rows // 16)
            sums = stored(sums.repartition(rows).mapInArrow(add_up, "n bigint, w binary"), "lm_weights")
        got = sums.collect()
        if not got:
            break
        weights = (sum(np.frombuffer(r["w"], np.float64) for r in got) / sum(r["n"] for r in got)).astype(np.float32)
    return weights


def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, w = 0, None
    for b in batches:
        for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            n, w = n + k, np.frombuffer(x, np.float64) + (0 if w is None else w)
    if w is not None:
        yield out_batch(n=pa.array([n], pa.int64()), w=pa.array([w.tobytes()], pa.binary()))


@np.errstate(over="ignore")
def log_likelihoods(p: dict[str, np.ndarray], docs: list[np.ndarray], v: Vocabulary, lanes: int = 512) -> np.ndarray:
    """Natural log of the probability of each document's units. Whole documents stand one after another in
    lanes (longest first, to the shortest lane); all lanes step together and drop out as they end."""
    order = sorted(range(len(docs)), key=lambda k: -len(docs[k]))
    lanes = min(lanes, len(docs))
    queues: list[list[int]] = [[] for _ in range(lanes)]
    load = [(0, k) for k in range(lanes)]
    for k in order:
        n, lane = heapq.heappop(load)
        queues[lane].append(k)
        heapq.heappush(load, (n + len(docs[k]), lane))
    queues.sort(key=lambda q: -sum(len(docs[k]) for k in q))
    lines = [np.concatenate([docs[k] for k in q]) for q in queues]
    owner = [np.repeat(q, [len(docs[k]) for k in q]) for q in queues]
    lengths = np.array([len(x) for x in lines])
    table = p["emb"] @ p["wx"] + p["b"]
    out, h = np.zeros(len(docs)), np.zeros((lanes, HIDDEN), np.float32)
    before = np.full(lanes, v.units)
    for a in range(0, int(lengths.max(initial=0)), WINDOW):
        n = int((lengths > a).sum())  # lanes are in order of length
        size = min(WINDOW, int(lengths[0]) - a)
        unit, doc = np.zeros((n, size), np.int64), np.full((n, size), -1, np.int64)
        for k in range(n):
            m = min(size, int(lengths[k]) - a)
            unit[k, :m], doc[k, :m] = lines[k][a:a + m], owner[k][a:a + m]
        fresh = np.zeros((n, size), bool)
        fresh[:, 1:] = doc[:, 1:] != doc[:, :-1]
        if a:
            fresh[:, 0] = doc[:, 0] != np.array([owner[k][a - 1] for k in range(n)])
        else:
            fresh[:, 0] = True
        inputs = np.concatenate([before[:n, None], unit[:, :-1]], axis=1)
        inputs[fresh] = v.units
        before, h = unit[:, -1].copy(), np.ascontiguousarray(h[:n].T).T
        states, inputs, begin = np.empty((HIDDEN, size, n), np.float32), inputs.T, [np.flatnonzero(x) for x in fresh.T]
        for t in range(size):
            if t % 16 == 0:
                xt = np.ascontiguousarray(table[inputs[t:t + 16]].transpose(0, 2, 1))
            h[begin[t]] = 0
            h = step(xt[t % 16].T, h, p["wh"])[0]
            states[:, t] = h.T
        doc = doc.T.reshape(-1)
        live = np.flatnonzero(doc >= 0)
        got = output(p, states.reshape(HIDDEN, -1).T, unit.T.reshape(-1)[live], v, live)
        out += np.bincount(doc[live], weights=got, minlength=len(docs))
    return out


# -- the operator -----------------------------------------------------------

def rare_words(places: np.ndarray, sizes: np.ndarray, words: list[bytes], rare: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Of each document of a chunk: its distinct rare words, and how often it holds each."""
    at = np.flatnonzero(rare[places])
    doc = np.repeat(np.arange(len(sizes)), sizes)[at]
    pair, times = np.unique(doc * len(words) + places[at], return_counts=True)
    ends = pa.array(np.searchsorted(pair, np.arange(len(sizes) + 1) * len(words)).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(words, pa.binary()).take(pa.array(pair % len(words)))), pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int64)))


def score_documents(docs: DataFrame, known: int = 100_000, head: int = 512, rounds: int = 1, budget: int = 960_000, chunk: int = 3_000_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out (crc32 of the id's text mod 7 is 2; not learned from),
    n_tokens, n_known, train_tokens, base_score (smoothed unigrams) and score (the model), both log10 of the
    probability of the whole text.

    Null text counts as empty: one token, the end. A word never seen in training has the chance of one
    further word of its class. A null doc_id hashes as empty text (0, not held out). Repeated rows are
    learned from and scored as often as they stand there. Without any training document the counts are
    empty and the network keeps its first weights. An empty table gives an empty result.
    ``budget``: tokens of a group, learned from between two averages; every training token is in one group.
    ``known``: words whose counts go to every task; counts of all others are joined."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = stored(split_texts(docs), "lm_chunks")
    counts = stored(count_words(chunks), "word_counts")
    v = vocabulary(counts, known, head)
    weights = train(chunks, v, rounds, budget)
    logs = np.append(np.log10(v.counts + 1.0), 0.0)  # a word not known here: its count comes by the join
    beyond = -np.log10(v.form_tokens + v.form_words + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = unflat(weights, v)
        units, rows = [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if units:
                ll = log_likelihoods(p, units, v) / LN10
                for a, row, ids, (n, known_, base, tail), rare, times in rows:
                    yield out_batch(row=pa.array(np.arange(row, row + len(ids))), doc_id=pa.array(ids, pa.int64()), n_tokens=pa.array(n), n_known=pa.array(known_),
                                    base=pa.array(base), score=pa.array(ll[a:a + len(ids)] + tail), rare=rare, times=times)
                units.clear()
                rows.clear()

        size = 0
        for b in pieces(batches, 4 << 20):
            starts, ids = column(b, "row"), column(b, "ids")
            for r, sizes, places, words, unit, at in chunk_lines(b, v):
                begin = np.cumsum(sizes) - sizes
                far = unit >= v.head
                # beyond the head: the chance within the class of form
                tail = np.where(far, logs[at] + beyond[np.where(far, unit - v.head, 0)], 0.0)
                sums = sizes, *(np.add.reduceat(x[places], begin) for x in ((at >= 0).astype(np.int64), logs[at], tail))
                rows.append((len(units), starts[r], ids[r], sums, *rare_words(places, sizes, words, at < 0)))
                units.extend(np.split(unit.astype(np.int32)[places], begin[1:]))
                size += len(places)
                if size >= chunk:
                    yield from flush()
                    size = 0
        yield from flush()

    source = chunks.select("row", "ids", "sizes", "places", "words")
    scored = stored(source.mapInArrow(run, "row bigint, doc_id bigint, n_tokens bigint, n_known bigint, base double, score double, rare array<binary>, times array<bigint>"), "lm_scores")
    rare = scored.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    # distinct words spread evenly by hash, so the counts of a task's share fit it and need no sorting
    more = rare.join(counts.hint("shuffle_hash"), "word").groupBy("row").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs"))
    z = float(np.log10(v.total + v.distinct + 1.0))
    logs_ = F.coalesce("logs", F.lit(0.0))
    return scored.drop("rare", "times").join(more, "row", "left").select(
        "doc_id", (id_crc32(F.col("doc_id")) % 7 == 2).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(v.total).cast("bigint").alias("train_tokens"), (F.col("base") + logs_ - F.col("n_tokens") * z).alias("base_score"), (F.col("score") + logs_).alias("score"))
