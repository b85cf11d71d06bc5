"""Language identification by a bidirectional gated recurrent network over bytes, all in numpy.

Two recurrent layers read a window of bytes from both ends; each position is labelled from both
states, and a document's probabilities are the mean over the positions that belong to letters.
Training is backpropagation through time with Adam on a bounded, labelled sample. Prediction
covers all bytes of all texts, in windows that are batched over documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilog.llm.common import ship_code, table

#: Labelled documents per language that training reads, each one window of SAMPLE_CHARS characters.
SAMPLE_DOCS, SAMPLE_CHARS = 256, 512
HIDDEN, WIDTH = 8, 128
STEPS, BATCH, RATE = 300, 64, 0.02
LANES = 2048
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


class Network:
    """Weights of both directions and of the labels."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        small = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.weights = {}
        for way in "fb":
            self.weights |= {f"x{way}": small(256, 3 * hidden), f"u{way}": small(hidden, 3 * hidden), f"o{way}": small(hidden, len(labels))}
        self.weights["c"] = np.zeros(len(labels), np.float32)

    def walk(self, codes: np.ndarray, way: str, trace: list | None = None) -> np.ndarray:
        """States [time, lane, hidden] after each byte of codes [time, lane]; ``b`` reads backwards."""
        h, x, u = self.hidden, self.weights[f"x{way}"], self.weights[f"u{way}"]
        state = np.zeros((codes.shape[1], h), np.float32)
        out = np.empty((*codes.shape, h), np.float32)
        for t in range(len(codes)) if way == "f" else range(len(codes) - 1, -1, -1):
            inp, rec = x[codes[t]], state @ u
            gates = _sigmoid(inp[:, :2 * h] + rec[:, :2 * h])
            keep, reset = gates[:, :h], gates[:, h:]
            new = np.tanh(inp[:, 2 * h:] + reset * rec[:, 2 * h:])
            if trace is not None:
                trace.append((t, state, keep, reset, rec[:, 2 * h:], new))
            state = new + keep * (state - new)
            out[t] = state
        return out

    def positions(self, codes: np.ndarray) -> np.ndarray:
        """Probabilities [time, lane, label] of each position."""
        w = self.weights
        z = self.walk(codes, "f") @ w["of"] + self.walk(codes, "b") @ w["ob"] + w["c"]
        np.exp(z - z.max(axis=2, keepdims=True), out=z)
        z /= z.sum(axis=2, keepdims=True)
        return z

    def gradients(self, codes: np.ndarray, want: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        """(mean loss, gradients) where every position of lane j should be labelled want[j]."""
        w, h, grad, traces, states = self.weights, self.hidden, {}, {"f": [], "b": []}, {}
        for way in "fb":
            states[way] = self.walk(codes, way, traces[way])
        z = states["f"] @ w["of"] + states["b"] @ w["ob"] + w["c"]
        z = np.exp(z - z.max(axis=2, keepdims=True))
        z /= z.sum(axis=2, keepdims=True)
        total = max(1.0, float(weight.sum()))
        lanes = np.arange(len(want))
        loss = float(-(np.log(z[:, lanes, want] + 1e-12) * weight).sum() / total)
        dz = z
        dz[:, lanes, want] -= 1
        dz *= (weight / total)[:, :, None]
        dz = dz.astype(np.float32)
        grad["c"] = dz.sum(axis=(0, 1))
        for way in "fb":
            grad[f"o{way}"] = np.einsum("tlh,tlc->hc", states[way], dz)
            gx, gu, u = np.zeros_like(w[f"x{way}"]), np.zeros_like(w[f"u{way}"]), w[f"u{way}"]
            back = np.zeros((codes.shape[1], h), np.float32)
            for t, before, keep, reset, rec, new in reversed(traces[way]):
                ds = back + dz[t] @ w[f"o{way}"].T
                dn = ds * (1 - keep) * (1 - new * new)
                dk = ds * (before - new) * keep * (1 - keep)
                dr = dn * rec * reset * (1 - reset)
                inp = np.concatenate([dk, dr, dn], axis=1)
                rec_grad = np.concatenate([dk, dr, dn * reset], axis=1)
                np.add.at(gx, codes[t], inp)
                gu += before.T @ rec_grad
                back = ds * keep + rec_grad @ u.T
            grad[f"x{way}"], grad[f"u{way}"] = gx, gu
        return loss, grad


def _letters(codes: np.ndarray) -> np.ndarray:
    """Bytes that belong to letters: a-z, A-Z and all of longer UTF-8 sequences."""
    low = codes | 0x20
    return ((low >= 97) & (low <= 122)) | (codes >= 128)


def train(texts: list[str], langs: list[str], steps: int = STEPS, seed: int = 7) -> Network | None:
    """Fit a network on windows of the texts; None without any. Reruns agree.

    Labels take turns in the lanes of the batches. ``steps`` suffices for up to ``BATCH`` labels; more
    labels get more steps in proportion.
    """
    labels = sorted(set(langs))
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    raw = [np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8) for t in texts]
    by_label = [[i for i, x in enumerate(langs) if x == lab and len(raw[i])] for lab in labels]
    model = Network(labels, seed=seed)
    if len(labels) == 1 or not all(by_label):
        return model
    first, second = ({k: np.zeros_like(v) for k, v in model.weights.items()} for _ in range(2))
    steps = -(-steps * max(BATCH, len(labels)) // BATCH)
    for step in range(1, steps + 1):
        codes, want = np.full((WIDTH, BATCH), 32, np.uint8), (np.arange(BATCH) + (step - 1) * BATCH) % len(labels)
        for lane in range(BATCH):
            x = raw[rng.choice(by_label[want[lane]])]
            at = rng.integers(0, max(1, len(x) - WIDTH + 1))
            part = x[at:at + WIDTH]
            codes[:len(part), lane] = part
        _, grad = model.gradients(codes, want, _letters(codes).astype(np.float32))
        rate = RATE * (1 - 0.9 * step / steps)
        for k, g in grad.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            model.weights[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def predict(model: Network, texts: list[str]) -> np.ndarray:
    """Probabilities [text, label]: the mean over the letters of each whole text."""
    sums, counts = np.zeros((len(texts), len(model.labels))), np.zeros(len(texts))
    raw = [np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8) for t in texts]
    lanes = [(i, at) for i, x in enumerate(raw) for at in range(0, len(x), WIDTH)]
    for start in range(0, len(lanes), LANES):
        part = lanes[start:start + LANES]
        codes = np.full((len(part), WIDTH), 32, np.uint8)
        for row, (i, at) in enumerate(part):
            piece = raw[i][at:at + WIDTH]
            codes[row, :len(piece)] = piece
        codes = np.ascontiguousarray(codes.T)
        weight = _letters(codes).astype(np.float32)
        per = np.einsum("tlc,tl->lc", model.positions(codes), weight)
        who = np.array([i for i, _ in part])
        np.add.at(sums, who, per)
        np.add.at(counts, who, weight.sum(axis=0))
    return sums / np.maximum(counts, 1)[:, None]


def training_sample(docs: DataFrame, per_language: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[str]]:
    """Up to ``per_language`` labelled documents of each language, chosen by hash; one window of each.

    Only documents that are not held out. What reaches the driver is bounded for each language.
    """
    pick = F.xxhash64("doc_id")
    room = F.greatest(F.lit(1), F.length("text") - chars + 1)
    rows = docs.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.regexp("text", F.lit(r"\p{L}")))
    rows = rows.select("lang", pick.alias("pick"), F.col("doc_id"), F.substring("text", (F.pmod(pick, room) + 1).cast("int"), F.lit(chars)).alias("part"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("pick", "doc_id", "part"))
    got = rows.withColumn("place", place).filter(F.col("place") <= per_language).select("lang", "place", "part").collect()
    got.sort(key=lambda r: (r.lang, r.place))
    return [r.part for r in got], [r.lang for r in got]


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, model: Network | None) -> DataFrame:
    """Each row of docs (doc_id, text) with lang_pred and score; all other columns are kept.

    lang_pred is ``und`` with score 0 if the text is NULL or has no letter, or if there is no model.
    Texts of any length are read whole. Rows that repeat give equal rows, an empty table none. Columns
    named lang_pred or score are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    ship_code(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = pd.DataFrame({"lang": UNKNOWN, "score": 0.0}, index=texts.index)
            known = texts.notna().to_numpy()
            # Few texts at a time, so that memory does not follow the number of rows in a batch.
            places = np.flatnonzero(known)
            for at in range(0, len(places), 256):
                here = places[at:at + 256]
                odds = predict(sent.value, texts.iloc[here].tolist())
                best = odds.argmax(axis=1)
                out.iloc[here, 0] = [sent.value.labels[i] for i in best]
                out.iloc[here, 1] = np.clip(odds[np.arange(len(here)), best], 0, 1)
            yield out

    lettered = F.when(F.regexp("text", F.lit(r"\p{L}")), F.col("text"))
    out = docs.withColumn("_told", label(lettered))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("_told.lang").alias("lang_pred"), F.col("_told.score").alias("score"))


def query(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = train(*training_sample(docs))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
