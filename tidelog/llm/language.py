"""Operator 10: language identification by a bidirectional GRU over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample
of labelled rows. Every byte position gets a label from the states of both
directions; a document's probabilities are the means over its positions. Each
direction reads a whole text from its one end to the other, with one state; documents
of like length are advanced side by side. A text too long to hold its positions'
states is read twice: once for the states at the borders of its blocks, then block by
block from those states, which gives the same as reading it in one go.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import map_arrow
from tidelog.llm.textbatch import flat_text, spans

#: Labelled rows used for training, per language at most.
TRAIN_ROWS_PER_LANGUAGE = 300
HIDDEN = 12
PAD = 256
#: Text bytes whose documents are sorted by length and read together; positions whose figures are held at once; positions of one array operation.
SPAN_BYTES = 16 << 20
HELD_BYTES = 4 << 20
STEP_CELLS = 16_384
#: Positions between the states that are kept of a text of more than HELD_BYTES.
BLOCK_BYTES = 8_192
#: A document is kept if the pooled probability of its language is at least this.
MIN_PROBABILITY = 0.5


@dataclass
class Model:
    """GRU parameters: for each direction d the tables E (257, 3H), U (H, 3H), candidate bias c (H) and output W (H, L); bias b (L)."""

    languages: list[str]
    params: dict[str, np.ndarray]


def initial(languages: list[str], hidden: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    p: dict[str, np.ndarray] = {}
    for d in "fb":
        p["E" + d] = rng.normal(0, 0.5, (257, 3 * hidden))
        p["E" + d][:, hidden : 2 * hidden] += 1.0  # remember at first
        p["U" + d] = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden))
        p["c" + d] = np.zeros(hidden)
        p["W" + d] = rng.normal(0, hidden**-0.5, (hidden, len(languages)))
    p["b"] = np.zeros(len(languages))
    return {k: v.astype(np.float32) for k, v in p.items()}


def _stack(p: dict[str, np.ndarray], name: str) -> np.ndarray:
    return np.stack([p[name + d] for d in "fb"])


def loss_and_gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over positions and its gradients. x (T, B) bytes, y (B) labels, mask (T, B). Both directions advance in one array."""
    steps, lanes = x.shape
    size, kind = p["Uf"].shape[0], p["b"].dtype
    u, c, w = _stack(p, "U"), _stack(p, "c")[:, None], _stack(p, "W")
    way = np.stack([x, x[::-1]], 1)  # (T, 2, B): the second direction reads from the end
    real = np.stack([mask, mask[::-1]], 1)[..., None].astype(kind)
    row = way + np.array([0, 257])[:, None]  # in the tables of both directions, one below the other
    e = np.take(_stack(p, "E").reshape(-1, 3 * size), row, 0)  # (T, 2, B, 3H)
    before, r, z, m, n, states = (np.empty((steps, 2, lanes, size), kind) for _ in range(6))
    h = np.zeros((2, lanes, size), kind)
    a, gates = np.empty((2, lanes, 3 * size), kind), np.empty((2, lanes, 2 * size), kind)
    half = kind.type(0.5)
    e[..., : 2 * size] *= half  # a sigmoid is half a tanh of half, and a half
    u_half = u.copy()
    u_half[..., : 2 * size] *= half
    for t in range(steps):
        before[t] = h
        np.matmul(h, u_half, out=a)
        np.add(e[t, ..., : 2 * size], a[..., : 2 * size], out=gates)
        np.tanh(gates, out=gates)
        gates *= half
        gates += half
        r[t], z[t] = gates[..., :size], gates[..., size:]
        np.add(a[..., 2 * size :], c, out=m[t])
        np.multiply(r[t], m[t], out=n[t])
        n[t] += e[t, ..., 2 * size :]
        np.tanh(n[t], out=n[t])
        h = h - n[t]
        h *= z[t]
        h += n[t]
        h *= real[t]  # padding leaves no trace
        states[t] = h
    logits = states[:, 0] @ w[0] + (states[:, 1] @ w[1])[::-1] + p["b"]
    logits -= logits.max(2, keepdims=True)
    probability = np.exp(logits)
    probability /= probability.sum(2, keepdims=True)
    total = mask.sum()
    loss = -(np.log(np.maximum(probability[:, np.arange(lanes), y], 1e-30)) * mask).sum() / total
    dl = probability
    dl[:, np.arange(lanes), y] -= 1
    dl *= (mask / total)[:, :, None]
    both = np.stack([dl, dl[::-1]], 1)  # (T, 2, B, L)
    dstates = np.stack([both[:, 0] @ w[0].T, both[:, 1] @ w[1].T], 1)
    # what each step multiplies the state's gradient by, for all steps at once
    keep = real * z
    into_new, into_reset, into_keep = n * n, 1 - r, before - n
    np.subtract(1, into_new, out=into_new)
    into_new *= real - keep
    into_reset *= r
    into_reset *= m
    into_keep *= keep
    np.subtract(1, z, out=z)
    into_keep *= z
    de, du = (np.empty((steps, 2, lanes, 3 * size), kind) for _ in range(2))
    back = np.ascontiguousarray(u.transpose(0, 2, 1))
    dh, kept = (np.zeros((2, lanes, size), kind) for _ in range(2))
    for t in range(steps - 1, -1, -1):
        dh += dstates[t]
        push, pull = de[t], du[t]
        dn = push[..., 2 * size :]
        np.multiply(dh, into_new[t], out=dn)
        np.multiply(dn, into_reset[t], out=push[..., :size])
        np.multiply(dh, into_keep[t], out=push[..., size : 2 * size])
        pull[..., : 2 * size] = push[..., : 2 * size]
        np.multiply(dn, r[t], out=pull[..., 2 * size :])
        np.multiply(dh, keep[t], out=kept)
        np.matmul(pull, back, out=dh)
        dh += kept
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["b"] = dl.sum((0, 1))
    for k, d in enumerate("fb"):
        pulled = du[:, k].reshape(-1, 3 * size)
        g["W" + d] = np.tensordot(states[:, k], both[:, k], ((0, 1), (0, 1)))
        g["U" + d] = before[:, k].reshape(-1, size).T @ pulled
        g["c" + d] = pulled[:, 2 * size :].sum(0)
    # gradients of the tables: rows of equal bytes together, then sums of their runs
    flat = row.astype(np.int16).ravel()
    order = np.argsort(flat, kind="stable")
    first = np.flatnonzero(np.diff(flat[order], prepend=-1))
    tables = np.zeros((514, 3 * size), kind)
    tables[flat[order[first]]] = np.add.reduceat(de.reshape(-1, 3 * size)[order], first, 0)
    g["Ef"], g["Eb"] = tables[:257], tables[257:]
    return float(loss), g


def train(texts: list[bytes], labels: list[str], hidden: int = HIDDEN, steps: int = 400, batch: int = 128, window: int = 96, seed: int = 7) -> Model:
    """A model of the languages in `labels`; equally many windows of each are drawn."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    data = np.frombuffer(b"".join(texts) + bytes(2 * window), np.uint8)
    long = np.array([len(t) for t in texts])
    begin = np.cumsum(long) - long
    by = [np.flatnonzero(np.array(labels, object) == x) for x in languages]
    many = np.array([len(i) for i in by])
    first_of = np.cumsum(many) - many
    grouped = np.concatenate(by)
    place = np.arange(window)
    p = initial(languages, hidden, rng)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        y = rng.integers(0, len(languages), batch)
        t = grouped[first_of[y] + rng.integers(0, many[y])]
        size = np.minimum(np.minimum(long[t], window), rng.integers(8, 2 * window, batch))
        at = begin[t] + rng.integers(0, long[t] - size + 1)
        x = np.where(place < size[:, None], data[at[:, None] + place], PAD).astype(np.int64)
        _, g = loss_and_gradients(p, np.ascontiguousarray(x.T), y, (x.T != PAD).astype(np.float32))
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        rate = 0.03 * (1 - step / (steps + 1)) * min(1.0, step / 10)
        for k in p:
            v = g[k] * min(1.0, 1.0 / (norm + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v * v
            p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(languages, p)


class Reader:
    """Runs a model over whole documents, both directions in one array."""

    def __init__(self, model: Model):
        p, h = model.params, model.params["Uf"].shape[0]
        self.languages, self.size = model.languages, h
        e, u = _stack(p, "E").astype(np.float32), _stack(p, "U").astype(np.float32)
        half = np.float32(0.5)  # a sigmoid is half a tanh of half, and a half
        gates = np.stack([e[..., :h], e[..., h : 2 * h]], 1) * half  # (2 ways, 2 gates, 257, H)
        self.gate_table, self.new_table = gates.reshape(-1, h), np.ascontiguousarray(e[..., 2 * h :]).reshape(-1, h)
        self.gate_u = np.ascontiguousarray(np.stack([u[..., :h], u[..., h : 2 * h]], 1) * half)
        self.new_u = np.ascontiguousarray(u[..., 2 * h :] * half)  # the gate that multiplies it comes without its half
        self.new_c = (_stack(p, "c").astype(np.float32) * half)[:, None]
        self.w, self.bias = _stack(p, "W").astype(np.float32), p["b"].astype(np.float32)
        self.gate_place = (np.arange(4) * 257).reshape(2, 2, 1)
        self.new_place = (np.arange(2) * 257).reshape(2, 1)

    def run(self, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        """States (T, 2, n, H) after each byte of x (T, 2, n); h (2, n, H) becomes the last."""
        steps, _, n = x.shape
        gates = np.take(self.gate_table, x[:, :, None, :] + self.gate_place, 0)  # (T, 2, 2, n, H)
        new = np.take(self.new_table, x + self.new_place, 0)
        out = np.empty((steps, 2, n, self.size), np.float32)
        g, m, shared = np.empty((2, 2, n, self.size), np.float32), np.empty_like(h), h[:, None]
        for t in range(steps):
            np.matmul(shared, self.gate_u, out=g)
            g += gates[t]
            np.tanh(g, out=g)
            g += 1
            np.matmul(h, self.new_u, out=m)
            m += self.new_c
            m *= g[:, 0]
            m += new[t]
            np.tanh(m, out=m)
            h -= m
            h *= g[:, 1]
            h *= 0.5
            h += m
            out[t] = h
        return out

    def held(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of probabilities and positions labelled, (n, L) each, of texts whose positions fit in memory together; length descends and is 1 at least."""
        top, labels = int(length[0]), len(self.bias)
        h, t0, used = np.zeros((2, len(length), self.size), np.float32), 0, 0
        row_at = np.empty(top, np.int64)  # where the figures of each step begin
        blocks: list[tuple[int, int, int, np.ndarray]] = []
        behind: list[np.ndarray] = []
        while t0 < top:
            n = int(np.searchsorted(-length, -t0, side="left"))  # texts that go on; those that end within the block run on over nothing
            steps = min(max(16, STEP_CELLS // n), top - t0)
            t = np.arange(t0, t0 + steps)[:, None]
            last = length[:n] - 1
            x = np.empty((steps, 2, n), np.intp)
            x[:, 0] = data[start[:n] + np.minimum(t, last)]
            x[:, 1] = data[start[:n] + np.maximum(last - t, 0)]
            h = np.ascontiguousarray(h[:, :n])
            states = self.run(x, h)
            row_at[t0 : t0 + steps] = used + np.arange(steps) * n
            used += steps * n
            blocks.append((t0, steps, n, states[:, 0].reshape(-1, self.size) @ self.w[0] + self.bias))
            behind.append(states[:, 1].reshape(-1, self.size) @ self.w[1])
            t0 += steps
        other = np.concatenate(behind)
        del behind
        probability, labelled = np.zeros((len(length), labels)), np.zeros((len(length), labels), np.int64)
        for t0, steps, n, logits in blocks:
            ahead = length[:n] - 1 - np.arange(t0, t0 + steps)[:, None]  # the step at which the other direction was here
            real = ahead >= 0
            logits += np.take(other, (row_at[np.maximum(ahead, 0)] + np.arange(n)).ravel(), 0)
            p, leads = soft(logits)
            if not real[-1].all():
                p *= real.reshape(-1, 1)
                leads &= real.reshape(-1, 1)
            probability[:n] += p.reshape(steps, -1).sum(0).reshape(n, labels)
            labelled[:n] += leads.reshape(steps, -1).sum(0).reshape(n, labels)
        return probability, labelled

    def long(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of one text of any length, (L) each: states at the borders of its blocks first, then the blocks side by side."""
        n = len(text)
        blocks = -(-n // BLOCK_BYTES)
        begin = np.arange(blocks) * BLOCK_BYTES
        size = np.minimum(BLOCK_BYTES, n - begin)
        h = np.zeros((2, 1, self.size), np.float32)
        borders = np.empty((blocks, 2, self.size), np.float32)  # before each block, in reading order
        for k in range(blocks):
            borders[k] = h[:, 0]
            ahead = text[begin[k] : begin[k] + size[k]]
            behind = text[n - begin[k] - size[k] : n - begin[k]][::-1]
            for a in range(0, int(size[k]), 1024):
                self.run(np.stack([ahead[a : a + 1024], behind[a : a + 1024]], 1)[:, :, None].astype(np.intp), h)
        probability, labelled = np.zeros(len(self.bias)), np.zeros(len(self.bias), np.int64)
        for k in range(blocks):
            # positions begin[k]... forward from their border; backward from the border of the block of the reading from the end that holds them
            lo, hi = int(begin[k]), int(begin[k] + size[k])
            states = [self._between(text, borders, lo, hi, way) for way in (0, 1)]
            logits = states[0] @ self.w[0] + states[1] @ self.w[1] + self.bias
            p, leads = soft(logits)
            probability += p.sum(0, dtype=np.float64)
            labelled += leads.sum(0)
        return probability, labelled

    def _between(self, text: np.ndarray, borders: np.ndarray, lo: int, hi: int, way: int) -> np.ndarray:
        """States of one direction at the positions lo to hi, in the text's order."""
        n = len(text)
        a, b = (lo, hi) if way == 0 else (n - hi, n - lo)  # in reading order
        first = a // BLOCK_BYTES
        h = np.zeros((2, 1, self.size), np.float32)
        h[way, 0] = borders[first, way]
        read = text if way == 0 else text[::-1]
        out = []
        for at in range(first * BLOCK_BYTES, b, 1024):
            x = read[at : min(b, at + 1024)].astype(np.intp)
            out.append(self.run(np.stack([x, x], 1)[:, :, None], h)[:, way, 0])
        states = np.concatenate(out)[a - first * BLOCK_BYTES :]
        return states if way == 0 else states[::-1]

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(mean probabilities (docs, L), positions labelled (docs, L)); an empty document has zeros."""
        sizes = np.diff(offsets)
        pooled = np.zeros((len(sizes), len(self.bias)))
        labelled = np.zeros((len(sizes), len(self.bias)), np.int64)
        order = np.argsort(-sizes, kind="stable")
        order = order[: int((sizes > 0).sum())]
        at = 0
        while at < len(order):
            i = order[at]
            if sizes[i] > HELD_BYTES:
                pooled[i], labelled[i] = self.long(data[offsets[i] : offsets[i + 1]])
                at += 1
                continue
            total = np.cumsum(sizes[order[at : at + HELD_BYTES]])
            own = order[at : at + max(1, int(np.searchsorted(total, HELD_BYTES, side="right")))]
            pooled[own], labelled[own] = self.held(data, offsets[own], sizes[own])
            at += len(own)
        return pooled / np.maximum(sizes, 1)[:, None], labelled


def soft(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities, which labels lead) of positions' logits, which it changes."""
    top = logits[:, 0].copy()
    for k in range(1, logits.shape[1]):
        np.maximum(top, logits[:, k], out=top)
    leads = logits == top[:, None]
    logits -= top[:, None]
    np.exp(logits, out=logits)
    total = logits[:, 0].copy()
    for k in range(1, logits.shape[1]):
        total += logits[:, k]
    logits /= total[:, None]
    return logits, leads


def training_rows(docs: DataFrame, label_col: str, text_col: str, id_col: str, per_label: int) -> tuple[list[bytes], list[str]]:
    """A bounded sample by hash of id and text: at most `per_label` texts of each label; null labels and empty texts are not used, repeated rows once."""
    rows = docs.where(F.col(label_col).isNotNull() & (F.length(text_col) > 0))
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(label_col).cast("string")).count().collect()}
    if not counts:
        return [], []
    share = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, 1.5 * per_label / n + 0.0005 * (n < 10_000))))])
    rank = F.pmod(F.xxhash64(id_col, text_col), F.lit(1_000_000_007))
    label = F.col(label_col).cast("string")
    picked = rows.select(label.alias("label"), F.col(text_col).cast("string").alias("text"), rank.alias("rank")).where(F.col("rank") < share[F.col("label")] * 1_000_000_007)
    picked = picked.groupBy("label", "rank").agg(F.min("text").alias("text")).select("label", "text", "rank")  # however often a row stands
    got = sorted(map(tuple, picked.collect()), key=lambda r: (r[2], r[0], r[1]))
    texts, labels, used = [], [], dict.fromkeys(counts, 0)
    for lab, text, _ in got:
        if used[lab] < per_label:
            used[lab] += 1
            texts.append(text.encode())
            labels.append(lab)
    return texts, labels


def fit(docs: DataFrame, label_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_label: int = TRAIN_ROWS_PER_LANGUAGE, **how) -> Model | None:
    """Train on labelled rows; None if there is none."""
    texts, labels = training_rows(docs, label_col, text_col, id_col, per_label)
    return train(texts, labels, **how) if texts else None


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """(id, language, probability, n_positions, agreement, keep) for every row.

    language has the greatest mean probability over all byte positions; agreement is
    the share of positions labelled with it; keep says that probability is at least
    `min_probability`.

    Cases: null and empty texts have language null, probability 0, no positions, and
    are not kept; so has every row if there is no model; equal probabilities go to the
    language that sorts first; repeated rows and null ids give a row each; an empty
    table gives no rows; other columns are not carried.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model) if model else None
        for batch in spans(batches, SPAN_BYTES, 1):
            data, offsets, null = flat_text(batch.column(1))
            sizes = np.diff(offsets)
            if reader:
                pooled, labelled = reader.documents(data, offsets)
                best = pooled.argmax(1)
                rows = np.arange(len(best))
                probability, agreement = pooled[rows, best], labelled[rows, best] / np.maximum(sizes, 1)
                names = pa.array(np.array(reader.languages, object)[best], pa.string(), mask=sizes == 0)
            else:
                probability = agreement = np.zeros(len(sizes))
                names = pa.nulls(len(sizes), pa.string())
            keep = (sizes > 0) & (probability >= min_probability)
            yield pa.RecordBatch.from_arrays([batch.column(0), names, pa.array(probability), pa.array(sizes), pa.array(agreement), pa.array(keep)], names=["id", "language", "probability", "n_positions", "agreement", "keep"])

    picked = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return map_arrow(picked, run, f"id {id_type}, language string, probability double, n_positions long, agreement double, keep boolean").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text", min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """The rows of `docs` that identify() would keep, with all their columns, in one pass without a join.

    Cases: as in identify(); rows are judged one by one, so repeated rows stay repeated
    and columns of any name pass through.
    """
    schema = docs.schema
    at = schema.names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model) if model else None
        for batch in spans(batches, SPAN_BYTES, at):
            data, offsets, _ = flat_text(batch.column(at))
            keep = np.diff(offsets) > 0
            keep &= (reader.documents(data, offsets)[0].max(1) >= min_probability) if reader else False
            yield batch.filter(pa.array(keep))

    return map_arrow(docs, run, schema)
