"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads windows of UTF-8 bytes in both directions, labels every
position with a distribution over the languages, and a document's distribution
is the mean over all of its bytes.  It is trained here, in numpy, by
backpropagation through time on a bounded sample of labelled rows; scoring runs
in batches inside the tasks, every byte of every text, without a shuffle.

Only text and non-null lang of rows outside the held-out quarter are learned
from, and only text is scored.  Defined results: a text that is null or has no
letter gets ``und`` with score 0; where the sample has no labelled text every
document gets ``und``; repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import bounded_batches, crc_bucket, release

UNDETERMINED = "und"
#: Documents of each language, and windows of each, that are learned from at most: the bound of the sample.
SAMPLE_DOCUMENTS, SAMPLE_WINDOWS = 400, 4
#: Hidden units of a direction, bytes of a window in training and in scoring, windows scored at once.
HIDDEN, TRAIN_WINDOW, WINDOW, LANES = 8, 64, 128, 2048
STEPS, BATCH, RATE, SEED = 260, 192, 0.02, 7


@dataclass
class Network:
    """x: [2, 256, 3H] input part of the gates by byte; u: [2, H, 3H]; v: [2, H, K]; c: [K]."""

    labels: list[str]
    x: np.ndarray
    u: np.ndarray
    v: np.ndarray
    c: np.ndarray

    @classmethod
    def fresh(cls, labels: list[str], hidden: int = HIDDEN, seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(labels, draw(2, 256, 3 * hidden, scale=0.3), draw(2, hidden, 3 * hidden, scale=hidden**-0.5), draw(2, hidden, len(labels), scale=0.3), np.zeros(len(labels), np.float32))

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.x, self.u, self.v, self.c]

    def states(self, windows: np.ndarray, keep_gates: bool = False) -> tuple[np.ndarray, list]:
        """Hidden states [T, 2, B, H] in reading order of each direction, and what training needs.

        windows: [T, B] bytes.  z and r are sigmoids, n a tanh; a sigmoid is half a
        tanh of half its argument, so one call serves both gates.
        """
        hidden, (steps, lanes) = self.u.shape[1], windows.shape
        both = np.stack([windows, windows[::-1]])
        h = np.zeros((2, lanes, hidden), np.float32)
        out = np.empty((steps, 2, lanes, hidden), np.float32)
        gates = []
        a = np.empty((2, lanes, 3 * hidden), np.float32)
        for t in range(steps):
            np.take(self.x[0], both[0, t], axis=0, out=a[0])
            np.take(self.x[1], both[1, t], axis=0, out=a[1])
            hu = np.matmul(h, self.u)
            zr = a[..., : 2 * hidden] + hu[..., : 2 * hidden]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1.0
            zr *= 0.5
            z, r = zr[..., :hidden], zr[..., hidden:]
            un = hu[..., 2 * hidden :]
            n = r * un
            n += a[..., 2 * hidden :]
            np.tanh(n, out=n)
            if keep_gates:
                gates.append((h, z, r, un, n))
            h = n + z * (h - n)
            out[t] = h
        return out, gates

    def position_probabilities(self, states: np.ndarray) -> np.ndarray:
        """[T, B, K]: each position is labelled from both directions."""
        logits = states[:, 0] @ self.v[0] + states[::-1, 1] @ self.v[1] + self.c
        logits -= logits.max(axis=-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=-1, keepdims=True)
        return logits

    def gradients(self, windows: np.ndarray, mask: np.ndarray, targets: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over the marked positions, and its gradients, through time."""
        hidden, (steps, lanes) = self.u.shape[1], windows.shape
        states, gates = self.states(windows, keep_gates=True)
        p = self.position_probabilities(states)
        total = max(1.0, float(mask.sum()))
        loss = -float((np.log(p[:, np.arange(lanes), targets] + 1e-9) * mask).sum()) / total
        d = p
        d[:, np.arange(lanes), targets] -= 1.0
        d *= mask[..., None] / total
        seen = np.stack([states[:, 0], states[::-1, 1]])  # [2, T, B, H] by position
        gv = np.einsum("dtbh,tbk->dhk", seen, d, optimize=True)
        gc = d.sum(axis=(0, 1))
        out = np.stack([d @ self.v[0].T, (d @ self.v[1].T)[::-1]])  # [2, T, B, H] in reading order
        gx, gu = np.zeros_like(self.x), np.zeros_like(self.u)
        dh = np.zeros((2, lanes, hidden), np.float32)
        both = np.stack([windows, windows[::-1]])
        for t in range(steps - 1, -1, -1):
            h, z, r, un, n = gates[t]
            dh = dh + out[:, t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            da = np.concatenate([dz, dr, dn], axis=-1)
            dhu = np.concatenate([dz, dr, dn * r], axis=-1)
            for way in (0, 1):
                np.add.at(gx[way], both[way, t], da[way])
            gu += np.matmul(h.transpose(0, 2, 1), dhu)
            dh = dh * z + np.matmul(dhu, self.u.transpose(0, 2, 1))
        return loss, [gx, gu, gv, gc]

    def document_probabilities(self, texts: list[bytes]) -> np.ndarray:
        """[documents, K]: the mean over all bytes of each text."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        counts = -(-sizes // WINDOW)
        total, ends = int(counts.sum()), np.cumsum(counts)
        flat = np.zeros(total * WINDOW, np.uint8)
        lengths = np.full(total, WINDOW, np.int64)
        for text, end, n in zip(texts, ends.tolist(), counts.tolist()):
            if n:
                at = (end - n) * WINDOW
                flat[at : at + len(text)] = np.frombuffer(text, np.uint8)
                lengths[end - 1] = len(text) - (n - 1) * WINDOW
        windows = flat.reshape(total, WINDOW)
        pooled = np.zeros((total, len(self.labels)), np.float64)
        for at in range(0, total, LANES):
            part = np.ascontiguousarray(windows[at : at + LANES].T)
            states, _ = self.states(part)
            p = self.position_probabilities(states)
            inside = np.arange(WINDOW)[:, None] < lengths[None, at : at + LANES]
            pooled[at : at + LANES] = np.einsum("tbk,tb->bk", p, inside.astype(np.float32))
        owner = np.repeat(np.arange(len(texts)), counts)
        out = np.zeros((len(texts), len(self.labels)))
        np.add.at(out, owner, pooled)
        return out / np.maximum(sizes, 1)[:, None]


def train(windows: list[bytes], targets: list[int], labels: list[str], steps: int = STEPS, seed: int = SEED) -> Network:
    """Adam over shuffled batches, the languages drawn equally often."""
    net, rng = Network.fresh(labels, seed=seed), np.random.default_rng(seed)
    data = np.zeros((len(windows), TRAIN_WINDOW), np.uint8)
    mask = np.zeros((len(windows), TRAIN_WINDOW), np.float32)
    for i, w in enumerate(windows):
        data[i, : len(w)] = np.frombuffer(w[:TRAIN_WINDOW], np.uint8)
        mask[i, : len(w)] = 1
    goal = np.array(targets)
    of = [np.flatnonzero(goal == k) for k in range(len(labels))]
    of = [x for x in of if len(x)]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(x, -(-BATCH // len(of))) for x in of])
        _, grads = net.gradients(np.ascontiguousarray(data[pick].T), np.ascontiguousarray(mask[pick].T), goal[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * min(1.0, 2.0 - 2.0 * step / steps + 0.05)
        for w, g, (m, s) in zip(net.weights, grads, moments):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network from at most SAMPLE_DOCUMENTS documents a language; None without labelled text.

    The sample is drawn by a hash of the id.  What reaches the driver are the
    languages and SAMPLE_WINDOWS windows of TRAIN_WINDOW bytes of each sampled text.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where((crc_bucket("id", 4) != 2) & F.col("lang").isNotNull())
    labels = sorted(r[0] for r in rows.select("lang").distinct().collect())
    if not labels:
        return None
    # the first of each language by hash, in one pass: what is beyond the bound leaves before the shuffle
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    picked = rows.select("id", "lang").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= SAMPLE_DOCUMENTS).select(F.col("id").alias("picked_id"))

    @F.pandas_udf("array<binary>")
    def cut(texts: pd.Series) -> pd.Series:
        def windows(text: str | None) -> list[bytes]:
            raw = (text or "").encode("utf-8", "replace")
            n = min(SAMPLE_WINDOWS, -(-len(raw) // TRAIN_WINDOW))
            starts = [i * max(0, len(raw) - TRAIN_WINDOW) // max(1, n - 1) for i in range(n)]
            return [raw[s : s + TRAIN_WINDOW] for s in starts]

        return texts.map(windows)

    # at most SAMPLE_DOCUMENTS ids a language
    chosen = rows.join(F.broadcast(picked.distinct()), F.col("id") == F.col("picked_id"), "left_semi")
    sample = chosen.select("id", "lang", cut(F.col("text")).alias("windows"))
    sample = sorted(sample.dropDuplicates(["id"]).collect(), key=lambda r: (r["lang"], r["id"]))
    pairs = [(bytes(w), labels.index(r["lang"])) for r in sample for w in r["windows"]]
    return train([w for w, _ in pairs], [k for _, k in pairs], labels) if pairs else None


def identify(text: Column, net: Network | None) -> Column:
    """Struct (lang_pred, score) of a text column."""
    if net is None:
        return F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            preds, scores = [], []
            for at in range(0, len(batch), 1000):
                part = [t or "" for t in batch.iloc[at : at + 1000]]
                p = net.document_probabilities([t.encode("utf-8", "replace") for t in part])
                known = [has_letter(t) for t in part]
                preds += [net.labels[k] if ok else UNDETERMINED for k, ok in zip(p.argmax(axis=1), known)]
                scores += [float(min(1.0, x)) if ok else 0.0 for x, ok in zip(p.max(axis=1), known)]
            yield pd.DataFrame({"lang_pred": preds, "score": np.array(scores, float)})
            release()

    return predict(text)


def predictions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    bounded_batches(docs.sparkSession)
    net = fit(docs, id_col, text_col, lang_col)
    told = docs.select(F.col(id_col).alias("doc_id"), (crc_bucket(id_col, 4) == 2).alias("held_out"), identify(F.col(text_col), net).alias("p"))
    return told.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.35) -> DataFrame:
    """``docs`` without those whose language can't be told: no letter, or a score under ``least``."""
    bounded_batches(docs.sparkSession)
    names = docs.columns
    net = fit(docs, id_col, text_col, lang_col)
    told = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), identify(F.col(text_col), net).alias("p"))
    kept = told.where((F.col("p.lang_pred") != UNDETERMINED) & (F.col("p.score") >= least))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in names])
