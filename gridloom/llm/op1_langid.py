"""Language identification with error-correcting output codes.

Every language has a codeword of bits: all splits of the languages in two up to six of them, else random words chosen for their least
distance. For each bit a logistic classifier over hashed letter n-grams (1 to 4 bytes) tells on which side a text is. Decoding takes the
codeword of least loss, sum over bits of weight * log(1 + exp(-codeword * margin)), where the weight of a language's bit is how often that bit is right on its training texts.
If the second codeword is about as near, the answer is flagged as ambiguous.

The classifiers are fitted on the driver from at most `sample_rows` training rows (of every language the same number, by least hash of
doc_id), of which each gives its whole text and a few words of it, so that short texts are learned too. Prediction reads whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialize

DIM = 1 << 14
ORDERS = (1, 2, 3, 4)
PLAIN = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
KEYS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
LETTER = re.compile(rb"[A-Za-z]")


def letters(text: bytes | None) -> bytes | None:
    """Lower-case words of letters with single spaces around; None without any letter."""
    if text is None:
        return None
    words = text.translate(PLAIN).split()
    if not words:
        return None
    if not LETTER.search(text) and not any(c.isalpha() for c in text.decode("utf-8", "replace")):
        return None
    return b" " + b" ".join(words) + b" "


def grams(clean: bytes) -> np.ndarray:
    """Hashed n-grams of all ORDERS (numbers below DIM)."""
    b = np.frombuffer(clean, np.uint8).astype(np.uint32) + np.uint32(1)
    out = []
    for n in ORDERS:
        if len(b) < n:
            break
        m = len(b) - n + 1
        h = np.full(m, n, np.uint32) * np.uint32(0x165667B1)
        for i in range(n):
            h = (h ^ b[i : i + m]) * KEYS[i]
            h ^= h >> np.uint32(15)
        out.append(h >> np.uint32(32 - 14))
    return np.concatenate(out)


def code_book(languages: int, seed: int = 5) -> np.ndarray:
    """Codewords (languages x bits) of -1 and 1."""
    if languages <= 1:
        return np.ones((languages, 0))
    if languages <= 6:
        bits = (1 << (languages - 1)) - 1
        return np.array([[1.0 if i == 0 or not (j + 1) >> (i - 1) & 1 else -1.0 for j in range(bits)] for i in range(languages)])
    bits = max(15, int(np.ceil(10 * np.log2(languages))))
    rng, best = np.random.default_rng(seed), None
    for _ in range(50):
        c = rng.choice([-1.0, 1.0], (languages, bits))
        if (np.abs(c.sum(0)) == languages).any():
            continue
        d = (bits - c @ c.T) / 2 + np.eye(languages) * bits
        if best is None or d.min() > best[0]:
            best = (d.min(), c)
    assert best is not None
    return best[1]


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # DIM x bits
    bias: np.ndarray
    trust: np.ndarray  # languages x bits, rows sum to 1
    ambiguous: float = 0.1

    def margins(self, clean: bytes) -> np.ndarray:
        g = grams(clean)
        total = np.bincount(g, minlength=DIM) @ self.weights if len(g) > 3000 else self.weights[g].sum(0)
        return total / len(g) + self.bias

    def decode(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For rows of margins: nearest language, its share of the likelihood, whether the second is about as near, and the second."""
        loss = np.einsum("lb,nlb->nl", self.trust, np.logaddexp(0, -self.code[None] * f[:, None, :]))
        order = np.argsort(loss, axis=1, kind="stable")
        p = np.exp(-(loss - loss.min(1, keepdims=True)) * self.code.shape[1])
        p /= p.sum(1, keepdims=True)
        first, second = order[:, 0], order[:, 1]
        at = np.arange(len(f))
        return first, p[at, first], loss[at, second] - loss[at, first] < self.ambiguous, second


def train(features: np.ndarray, label: np.ndarray, languages: list[str], steps: int = 250, decay: float = 1e-4) -> Model:
    """features: n-gram shares (rows x DIM, overwritten), label: numbers of languages. Full-batch Adam: equal inputs give equal models."""
    code = code_book(len(languages))
    if not code.shape[1]:
        return Model(languages, code, np.zeros((DIM, 0)), np.zeros(0), np.ones((len(languages), 0)))
    x, mean = features, features.mean(0)  # in place: the table is the driver's largest array
    spread = np.sqrt(np.maximum(np.einsum("ij,ij->j", x, x) / len(x) - mean**2, 0)) + 1e-4
    x -= mean
    x /= spread
    np.clip(x, -4, 4, out=x)
    target = code[label].astype(np.float32)
    share = np.bincount(label, minlength=len(languages))[label]
    weight = (1.0 / share / len(languages)).astype(np.float32)[:, None]
    w, b = np.zeros((DIM, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for t in range(1, steps + 1):
        z = np.clip(target * (x @ w + b), -30, 30)
        g = -target * weight / (1 + np.exp(z))
        for k, (p, gr) in enumerate(((w, x.T @ g + decay * w), (b, g.sum(0)))):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (gr - m)
            v += 0.001 * (gr * gr - v)
            p -= 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    right = (target * (x @ w + b) > 0).astype(float)
    trust = np.stack([right[label == i].mean(0) for i in range(len(languages))]) - 0.5
    trust = np.maximum(trust, 0.01)
    return Model(languages, code, (w / spread[:, None]).astype(np.float32), (b - (mean / spread) @ w).astype(np.float32), trust / trust.sum(1, keepdims=True))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lang, ids, idx, val = [], [], [], []
        for i, l, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "lang", "text"))):
            clean = letters(t.encode() if isinstance(t, str) else t)
            if clean is None:
                continue
            words = clean.split()
            at = (int(i or 0) * 2654435761) % len(words)
            for part in (clean, b" " + b" ".join(words[at : at + 2 + int(i or 0) % 9]) + b" "):
                n = np.bincount(grams(part), minlength=DIM)
                k = np.flatnonzero(n)
                lang.append(l)
                ids.append(i)
                idx.append(k.astype(np.uint16).tobytes())
                val.append((n[k] / n.sum()).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(ids, pa.int64()), pa.array(idx, pa.binary()), pa.array(val, pa.binary())], names=["lang", "doc_id", "idx", "val"])


def fit(docs: DataFrame, sample_rows: int = 1200, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """Model from training rows (not held out; text and lang not null, a letter in the text). At most sample_rows rows in all.

    Of rows that repeat a doc_id one counts, that with the least language and text, so that the bound holds whatever the ids.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text")).filter(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = materialize(rows.select("doc_id", "lang").distinct(), "training-ids")
    counts = {r[0]: r[1] for r in ids.groupBy("lang").count().collect()}
    if not counts:
        return Model([], code_book(0), np.zeros((DIM, 0)), np.zeros(0), np.ones((0, 0)))
    each = max(4, sample_rows // len(counts))
    share = docs.sparkSession.createDataFrame([(k, int(min(1.0, (1.5 * each + 50) / n) * (1 << 20))) for k, n in counts.items()], "lang string, most long")
    hashed = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20))
    thin = ids.join(F.broadcast(share) if len(counts) < 10_000 else share, "lang").withColumn("h", hashed).filter("h <= most")
    chosen = thin.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).filter(F.col("k") <= each).select("doc_id").distinct()
    one = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("row")).select("doc_id", "row.*")
    got = one.select("doc_id", "lang", "text").mapInArrow(_features, "lang string, doc_id long, idx binary, val binary").toPandas()
    got = got.sort_values(["lang", "doc_id", "idx"], kind="stable")
    languages = sorted(set(got["lang"]))
    x = np.zeros((len(got), DIM), np.float32)
    for i, (k, v) in enumerate(zip(got["idx"], got["val"])):
        x[i, np.frombuffer(k, np.uint16)] = np.frombuffer(v, np.float32)
    label = np.array([languages.index(l) for l in got["lang"]], int)
    del got
    return train(x, label, languages)


def held_out(doc_id: str) -> F.Column:
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def predict(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1), ambiguous, second of every row; only the text is used.

    Texts that are null or have no letter are `und` with score 0; so is every text if no language was learned. A null doc_id isn't
    held out, but nothing is learned from it either. Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    names = model.languages

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean = [letters(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
            pred, score, unsure, second = ["und"] * len(clean), np.zeros(len(clean)), np.zeros(len(clean), bool), [None] * len(clean)
            known = [i for i, c in enumerate(clean) if c is not None] if names else []
            if len(names) == 1:
                for i in known:
                    pred[i], score[i] = names[0], 1.0
            elif known:
                first, p, close, other = model.decode(np.stack([model.margins(clean[i]) for i in known]).astype(float))
                score[known], unsure[known] = p, close
                for i, f, o in zip(known, first.tolist(), other.tolist()):
                    pred[i], second[i] = names[f], names[o]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pred, pa.string()), pa.array(score), pa.array(unsure), pa.array(second, pa.string())], names=["doc_id", "lang_pred", "score", "ambiguous", "second"])

    out = rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean, second string")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "ambiguous", "second")


def op1_error_correcting_codes(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs))
