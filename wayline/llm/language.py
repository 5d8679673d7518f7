"""Language of a text from a bidirectional gated recurrent network over its bytes.

The network labels every byte; a document's probabilities are the mean over all
its bytes. Texts are read in windows of ``INNER`` bytes, each with ``RUN_UP``
more bytes of the text before and behind it: those only bring the states of both
directions to what precedes, their labels are not counted. So a byte's label
rests on at least ``RUN_UP`` bytes on each side (or on all there are). Windows of
many documents run side by side as lanes of one numpy step, so whole texts of any
length are read in bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from wayline.llm.common import cut_lineage, free_name, sized_join, small_batches

#: bytes of a training block
BLOCK = 64
INNER = 256
RUN_UP = 64
LANES = 1024
#: time steps whose probabilities are held at once
STEPS = 32
PAD = 256
UNKNOWN = "und"


@dataclass
class Network:
    """Weights by direction (forward, backward); gates in the order update, reset, candidate.

    ``W`` (2, 3h, 257) is the input part for each byte and the padding, ``U``
    (2, 3h, h) the state's part, ``b`` (2, h, 1) is added to the state's part of
    the candidate; ``V`` (k, 2h) and ``c`` (k, 1) give the label of a position.
    Lanes come last, so that every numpy step runs over long rows.
    """

    languages: list[str]
    W: np.ndarray
    U: np.ndarray
    b: np.ndarray
    V: np.ndarray
    c: np.ndarray

    def __post_init__(self) -> None:
        self.W[:, :, PAD] = 0
        self.W[:, : self.U.shape[2], PAD] = 60  # the update gate is 1 at padding: the state stays as it is

    def states(self, x: np.ndarray, trace: list | None = None) -> np.ndarray:
        """Hidden states (steps, 2, h, lanes) over bytes ``x`` (steps, lanes); the backward ones in order of steps too."""
        steps, lanes = x.shape
        hidden, kind = self.U.shape[2], self.W.dtype
        gate = 2 * hidden
        h = np.zeros((2, hidden, lanes), kind)
        out = np.empty((steps, 2, hidden, lanes), kind)
        a, g = np.empty((2, 3 * hidden, lanes), kind), np.empty((2, 3 * hidden, lanes), kind)
        for t in range(steps):
            np.take(self.W[0], x[t], axis=1, out=a[0], mode="clip")
            np.take(self.W[1], x[steps - 1 - t], axis=1, out=a[1], mode="clip")
            np.matmul(self.U, h, out=g)
            zr = a[:, :gate] + g[:, :gate]
            zr *= 0.5  # the logistic function by tanh, which is the cheaper one
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, r = zr[:, :hidden], zr[:, hidden:]
            inner = g[:, gate:] + self.b
            n = r * inner
            n += a[:, gate:]
            np.tanh(n, out=n)
            if trace is not None:
                trace.append((h, z, r, n, inner))
            h = h - n
            h *= z
            h += n
            out[t, 0], out[steps - 1 - t, 1] = h[0], h[1]
        return out

    def positions(self, x: np.ndarray, s: np.ndarray | None = None) -> np.ndarray:
        """Probability of each language at each position (steps, k, lanes)."""
        s = self.states(x) if s is None else s
        p = self.V @ s.reshape(len(x), -1, x.shape[1])
        p += self.c
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of all positions of lanes with labels ``y``, and its gradients through time."""
        steps, lanes = x.shape
        hidden = self.U.shape[2]
        trace: list = []
        s = self.states(x, trace)
        p = self.positions(x, s)
        live = (x != PAD).astype(self.W.dtype)
        total = max(1.0, float(live.sum()))
        each = np.arange(lanes)
        loss = float(-(np.log(p[:, y, each] + 1e-12) * live).sum() / total)
        p[:, y, each] -= 1
        p *= live[:, None] / total
        grads = {"V": np.tensordot(p, s.reshape(steps, -1, lanes), ([0, 2], [0, 2])), "c": p.sum((0, 2))[:, None]}
        grads |= {"U": np.zeros_like(self.U), "b": np.zeros_like(self.b)}
        ds = (self.V.T @ p).reshape(s.shape)
        back = self.U.transpose(0, 2, 1)
        dh = np.zeros((2, hidden, lanes), self.W.dtype)
        gates = np.empty((2, 3 * hidden, steps, lanes), self.W.dtype)
        for t in range(steps - 1, -1, -1):
            h, z, r, n, inner = trace[t]
            dh[0] += ds[t, 0]
            dh[1] += ds[steps - 1 - t, 1]
            dn = dh * (1 - z) * (1 - n * n)
            below = np.concatenate([dh * (h - n) * z * (1 - z), dn * inner * r * (1 - r), dn], axis=1)
            gates[0, :, t], gates[1, :, steps - 1 - t] = below
            below[:, 2 * hidden :] *= r
            grads["U"] += below @ h.transpose(0, 2, 1)
            grads["b"] += below[:, 2 * hidden :].sum(2, keepdims=True)
            dh = dh * z + back @ below
        order = np.argsort(x, axis=None, kind="stable")
        present, first = np.unique(x.reshape(-1)[order], return_index=True)
        grads["W"] = np.zeros_like(self.W)
        grads["W"][:, :, present] = np.add.reduceat(gates.reshape(2, 3 * hidden, -1)[:, :, order], first, axis=2)
        grads["W"][:, :, PAD] = 0
        return loss, grads


def blocks_of(data: bytes, block: int = BLOCK) -> np.ndarray:
    """Bytes in rows of ``block``, the last filled with padding."""
    raw = np.frombuffer(data, np.uint8)
    out = np.full(-(-max(1, len(raw)) // block) * block, PAD, np.int64)
    out[: len(raw)] = raw
    return out.reshape(-1, block)


def fit(texts: list[str], labels: list[str], hidden: int = 6, steps: int = 300, lanes: int = 384, rate: float = 0.03, seed: int = 7) -> Network | None:
    """Train a network by backpropagation through time with Adam on random blocks, languages in equal parts.

    The result depends on nothing but the arguments. None without any text.
    """
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    pools = [[blocks_of(t.encode("utf-8", "replace")) for t, x in zip(texts, labels, strict=True) if x == g and t] for g in languages]
    languages = [g for g, p in zip(languages, pools, strict=True) if p]
    pools = [np.concatenate(p) for p in pools if p]
    if not languages:
        return None
    k = len(languages)
    net = Network(
        languages,
        rng.normal(0, 0.3, (2, 3 * hidden, 257)).astype(np.float32),
        rng.normal(0, hidden**-0.5, (2, 3 * hidden, hidden)).astype(np.float32),
        np.zeros((2, hidden, 1), np.float32),
        rng.normal(0, 0.3, (k, 2 * hidden)).astype(np.float32),
        np.zeros((k, 1), np.float32),
    )
    moments = {n: [np.zeros_like(getattr(net, n)), np.zeros_like(getattr(net, n))] for n in ("W", "U", "b", "V", "c")}
    for step in range(1, steps + 1):
        y = np.arange(max(lanes, k)) % k
        x = np.stack([pools[g][rng.integers(len(pools[g]))] for g in y]).T
        _, grads = net.gradients(x, y)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        speed = rate * (1 - (step - 1) / steps)
        for name, g in grads.items():
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            m, v = moments[name]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            getattr(net, name)[...] -= speed * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def windows_of(data: bytes, inner: int = INNER, run_up: int = RUN_UP, lanes: int = LANES) -> Iterator[np.ndarray]:
    """All windows of a text, at most ``lanes`` in an array of rows: run-up, ``inner`` bytes, run-up; padding beyond the text."""
    for at in range(0, len(data), inner * lanes):
        stop = min(len(data), at + inner * lanes)
        raw = np.frombuffer(data, np.uint8)[max(0, at - run_up) : stop + run_up]
        n = -(-(stop - at) // inner)
        out = np.full(n * inner + 2 * run_up, PAD, np.int64)
        first = max(0, run_up - at)
        out[first : first + len(raw)] = raw
        yield np.lib.stride_tricks.sliding_window_view(out, inner + 2 * run_up)[::inner]


def labelled_sample(docs: DataFrame, text: str, label: str, fold_key: str | None, per_label: int, pieces: int) -> DataFrame:
    """Pieces ``t`` of at most ``per_label`` texts of every label ``g``, the texts chosen in an order of hashes.

    A sampled text gives at most ``pieces`` pieces of ``BLOCK`` characters,
    spread evenly from its first to its last character; a shorter one gives all
    of itself. Rows whose crc32 of ``fold_key`` is 2 modulo 4 are held out; rows
    with a null ``fold_key`` are neither learned from nor held out.
    """
    row = F.pmod(F.xxhash64(*([fold_key] if fold_key else []), text), F.lit(1 << 40))
    d = docs.select(F.col(text).alias("t"), F.col(label).cast("string").alias("g"), row.alias("h"), *([F.col(fold_key).alias("i")] if fold_key else []))
    d = d.where("t is not null and g is not null and t <> ''")
    if fold_key:
        d = d.where(F.crc32(F.col("i").cast("string").cast("binary")) % 4 != 2)
    # hashes are spread evenly: four times the wanted number lie below this bound, and only those are shuffled
    below = cut_lineage(d.groupBy("g").agg((F.lit(float(1 << 40)) * F.least(F.lit(1.0), 4.0 * per_label / F.count("*"))).alias("b")))
    near = sized_join(d, below, ["g"], "inner").where("h <= b")
    order = Window.partitionBy("g").orderBy("h", "t")
    chosen = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_label).select("g", "r", "t")
    size = F.length("t")
    n = F.least(F.lit(pieces), F.ceil(size / BLOCK).cast("int"))
    starts = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.when(n > 1, F.floor(j * (size - BLOCK) / (n - 1))).otherwise(0).cast("int"))
    cut = chosen.select("g", "r", F.posexplode(F.transform(starts, lambda at: F.substring(F.col("t"), at + 1, F.lit(BLOCK)))).alias("j", "t"))
    return cut.select("g", "r", "j", "t")


def fit_languages(
    docs: DataFrame, text: str = "text", label: str = "lang", fold_key: str | None = "doc_id", per_label: int = 150, pieces: int = 60, **training
) -> Network | None:
    """Fit a network on a bounded sample: ``per_label`` texts of every label, at most ``pieces`` pieces from all over each."""
    rows = sorted(labelled_sample(docs, text, label, fold_key, per_label, pieces).collect())
    return fit([r["t"] for r in rows], [r["g"] for r in rows], **training)


def _pooled(net: Network, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Mean probabilities of each text's positions, and for each language the number of positions it wins."""
    k = len(net.languages)
    total, wins, length = np.zeros((len(texts), k)), np.zeros((len(texts), k), np.int64), np.zeros(len(texts), np.int64)
    held: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    size = 0

    def flush() -> None:
        nonlocal held, owner, size
        if not size:
            return
        x, who = np.concatenate(held), np.concatenate(owner)
        # windows of like length run together, and steps that are padding in all lanes change no state
        order = np.lexsort(((x != PAD).sum(1), x[:, 0] == PAD))
        for at in range(0, len(x), LANES):
            lane = order[at : at + LANES]
            part = x[lane].T
            counted = part != PAD
            steps = np.flatnonzero(counted.any(1))
            counted[:RUN_UP] = counted[RUN_UP + INNER :] = False
            part, counted = np.ascontiguousarray(part[steps]), counted[steps]
            s = net.states(part)
            for t in range(0, len(steps), STEPS):
                live = counted[t : t + STEPS, None]
                if not live.any():
                    continue
                p = net.positions(part[t : t + STEPS], s[t : t + STEPS])
                best = p == p.max(1, keepdims=True)
                best &= live
                p *= live
                np.add.at(total, who[lane], p.sum(0).T)
                np.add.at(wins, who[lane], best.sum(0).T)
            np.add.at(length, who[lane], counted.sum(0))
        held, owner, size = [], [], 0

    for i, data in enumerate(texts):
        for rows in windows_of(data):
            held.append(rows)
            owner.append(np.full(len(rows), i))
            size += len(rows)
            if size >= 8 * LANES:
                flush()
    flush()
    return total / np.maximum(1, length)[:, None], wins


def position_labels(net: Network, text: str) -> list[str]:
    """The language of every byte of a text."""
    data = text.encode("utf-8", "replace")
    best = [net.positions(np.ascontiguousarray(rows.T))[RUN_UP : RUN_UP + INNER].argmax(1).T.reshape(-1) for rows in windows_of(data)]
    return [net.languages[g] for part in best for g in part][: len(data)]


def language(text: Column, net: Network | None) -> Column:
    """Struct ``lang_pred`` (``und`` for null or without letters), ``score`` 0 to 1, ``n_bytes`` and ``agreeing`` bytes.

    ``score`` is the mean probability of the predicted language over all bytes
    of the text, 0 for ``und``; ties go to the first language by name.
    """
    schema = "lang_pred string, score double, n_bytes long, agreeing long"

    @F.pandas_udf(schema)
    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in series:
            data = [x.encode("utf-8", "replace") if isinstance(x, str) else b"" for x in s]
            letters = np.array([isinstance(x, str) and any(map(str.isalpha, x)) for x in s], bool)
            out = pd.DataFrame({"lang_pred": [UNKNOWN] * len(s), "score": 0.0, "n_bytes": [len(x) for x in data], "agreeing": 0})
            if net is not None and len(s):
                mean, wins = _pooled(net, [x if ok else b"" for x, ok in zip(data, letters, strict=True)])
                best = mean.argmax(1)
                out["lang_pred"] = [net.languages[g] if ok else UNKNOWN for g, ok in zip(best, letters, strict=True)]
                out["score"] = np.where(letters, np.clip(mean.max(1), 0, 1), 0.0)
                out["agreeing"] = np.where(letters, wins[np.arange(len(s)), best], 0)
            yield out

    return run(text)


def predict_languages(docs: DataFrame, net: Network | None, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``ident`` and the fields of :func:`language`; a row per input row."""
    return docs.select(F.col(ident), language(F.col(text), net).alias("_l")).select(ident, "_l.*")


def keep_known(docs: DataFrame, net: Network | None, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows whose language is known with a score of ``least`` or more, with all their columns."""
    small_batches(docs.sparkSession)
    p = free_name(docs, "_language")
    kept = docs.withColumn(p, language(F.col(text), net))
    return kept.where((F.col(f"{p}.lang_pred") != UNKNOWN) & (F.col(f"{p}.score") >= least)).drop(p)
