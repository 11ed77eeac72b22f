"""Language identification by a bidirectional gated recurrent network over bytes, written and trained in numpy.

Each direction is a gated recurrent unit (reset gate, update gate, candidate) with piecewise linear activations. Byte embeddings and
input weights are one table of 256 columns. At every position both directions' states give the probability of each language; a
document's probabilities are the mean over all its positions. Texts are read in stretches of ``STRETCH`` bytes, each from a zero state,
so that thousands of stretches advance together and a long text needs no more memory than a short one.

Training is backpropagation through time with Adam on the positions' cross-entropy, on the driver, over a bounded sample: of each of
the ``most_languages`` most frequent languages ``per_language`` rows with small hashes of id and beginning, ``WINDOWS`` stretches of each. A share
of the rows, reckoned from the language's count, is taken by hash where they are read, so that only some thousands are ranked. Rows whose
crc32(doc_id) is divisible by 5 are held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from chronoloom.llm.common import fresh, quoted, release_memory, require, ship_by_value, slices, text_buffers

ship_by_value(__name__)

STRETCH = 96
HIDDEN = 8
PER_LANGUAGE = 200
MOST_LANGUAGES = 200
WINDOWS = 4
STEPS = 400
BATCH = 128
RATE = 0.02
SEED = 11
FOLDS = 5
UNDETERMINED = "und"
#: Stretches that advance together.
WIDTH = 4096


class ByteGru:
    """Parameters, by name: per direction the table E (3 hidden, 256) and the weights U (3 hidden, hidden); the output V, b."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        n = max(1, len(languages))
        draw = lambda *shape, scale=1.0: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"V": draw(n, 2 * hidden, scale=0.3), "b": np.zeros(n, np.float32)}
        for d in "fb":
            self.p[f"E{d}"] = draw(3 * hidden, 256, scale=0.5)
            self.p[f"U{d}"] = draw(3 * hidden, hidden, scale=0.5 / np.sqrt(hidden))

    def states(self, x: np.ndarray, d: str, keep: dict | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """Each position and the state there, in the direction's order. x: bytes by position and stretch. keep: what training needs."""
        E, U, H = self.p[f"E{d}"], self.p[f"U{d}"], self.hidden
        n = x.shape[1]
        h = np.zeros((H, n), np.float32)
        g, a, c = np.empty((3 * H, n), np.float32), np.empty((3 * H, n), np.float32), np.empty((H, n), np.float32)
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            np.take(E, x[t], axis=1, out=g, mode="clip")
            np.matmul(U, h, out=a)
            gates = a[: 2 * H]
            gates += g[: 2 * H]
            gates *= 0.25
            gates += 0.5
            np.clip(gates, 0, 1, out=gates)
            np.multiply(gates[:H], a[2 * H :], out=c)
            c += g[2 * H :]
            np.clip(c, -1, 1, out=c)
            if keep is not None:
                keep[t] = (h.copy(), gates.copy(), a[2 * H :].copy(), c.copy())
            c -= h
            c *= gates[H:]
            h += c
            yield t, h

    def probabilities(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sums over the positions of each stretch of the languages' probabilities: (languages, stretches)."""
        V, b, H = self.p["V"], self.p["b"][:, None], self.hidden
        Vf, Vb = np.ascontiguousarray(V[:, :H]), np.ascontiguousarray(V[:, H:])
        first = np.empty((len(x), len(V), x.shape[1]), np.float32)
        for t, h in self.states(x, "f"):
            np.matmul(Vf, h, out=first[t])
        total = np.zeros((len(V), x.shape[1]), np.float32)
        e = np.empty((len(V), x.shape[1]), np.float32)
        for t, h in self.states(x, "b"):
            np.matmul(Vb, h, out=e)
            e += first[t]
            e += b
            e -= e.max(0)
            np.exp(e, out=e)
            e *= (t < lengths) / e.sum(0)
            total += e
        return total

    def gradients(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of the positions, and its gradients by backpropagation through time."""
        T, n, H, p = len(x), x.shape[1], self.hidden, self.p
        kept = {"f": {}, "b": {}}
        state = {d: np.empty((T, H, n), np.float32) for d in "fb"}
        for d in "fb":
            for t, h in self.states(x, d, kept[d]):
                state[d][t] = h
        both = np.concatenate([state["f"], state["b"]], axis=1)
        logits = p["V"] @ both + p["b"][:, None]
        logits -= logits.max(1, keepdims=True)
        e = np.exp(logits)
        e /= e.sum(1, keepdims=True)
        mask = (np.arange(T)[:, None] < lengths).astype(np.float32)
        total = max(1.0, mask.sum())
        loss = float(-(np.log(e[:, y, np.arange(n)] + 1e-9) * mask).sum() / total)
        e[:, y, np.arange(n)] -= 1
        e *= mask[:, None] / total
        g = {"V": np.einsum("tln,thn->lh", e, both, optimize=True), "b": e.sum((0, 2))}
        back = p["V"].T @ e
        flat = x.ravel()
        for d in "fb":
            U, own = p[f"U{d}"], back[:, :H] if d == "f" else back[:, H:]
            dU, da = np.zeros_like(U), np.empty((T, 3 * H, n), np.float32)
            dh = np.zeros((H, n), np.float32)
            for t in reversed(range(T)) if d == "f" else range(T):
                h, gates, q, c = kept[d][t]
                r, z = gates[:H], gates[H:]
                dh = dh + own[t]
                dc = dh * z * (np.abs(c) < 1)
                dgates = np.concatenate([dc * q, dh * (c - h)]) * (0.25 * ((gates > 0) & (gates < 1)))
                da[t, : 2 * H], da[t, 2 * H :] = dgates, dc
                inner = np.concatenate([dgates, dc * r])
                dU += inner @ h.T
                dh = dh * (1 - z) + U.T @ inner
            g[f"U{d}"] = dU
            rows = da.transpose(1, 0, 2).reshape(3 * H, -1)
            g[f"E{d}"] = np.stack([np.bincount(flat, row, 256) for row in rows]).astype(np.float32)
        return loss, g


def stretches(data: np.ndarray, offsets: np.ndarray, length: int = STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of all rows' stretches, and each one's row."""
    n = np.diff(offsets)
    count = -(-n // length)
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    starts = offsets[:-1][row] + k * length
    return starts, np.minimum(length, offsets[1:][row] - starts), row


def laid_out(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, length: int = STRETCH) -> np.ndarray:
    """Bytes by position and stretch, zero after a stretch's end."""
    at = starts + np.arange(length)[:, None]
    out = data[np.minimum(at, len(data) - 1)].astype(np.intp)
    out[np.arange(length)[:, None] >= lengths] = 0
    return out


def train(texts: list[bytes], labels: list[str], hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> ByteGru:
    """A network for the labels' languages. Without texts it has no languages and predicts nothing."""
    model = ByteGru(sorted(set(labels)), hidden, seed)
    rows = [(t[:STRETCH], model.languages.index(y)) for t, y in zip(texts, labels, strict=True) if t]
    if not rows or len(model.languages) < 2:
        return model
    data = np.frombuffer(b"".join(t for t, _ in rows), np.uint8)
    lengths = np.array([len(t) for t, _ in rows])
    x, y = laid_out(data, np.cumsum(lengths) - lengths, lengths), np.array([y for _, y in rows])
    rng = np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        i = rng.integers(0, len(y), batch)
        _, g = model.gradients(x[:, i], lengths[i], y[i])
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        pace = rate * min(1.0, 2 * (1 - (step - 1) / steps))
        for k, v in g.items():
            v = v * min(1.0, 1.0 / (norm + 1e-9))
            first[k] += 0.1 * (v - first[k])
            second[k] += 0.01 * (v * v - second[k])
            model.p[k] -= pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return model


def held_out(doc_id: Column) -> Column:
    """Whether the row is kept from training. Rows without id count as held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(True))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, most_languages: int = MOST_LANGUAGES, **options) -> ByteGru:
    """Trains on stretches of at most per_language rows of each of the most_languages most frequent languages, lang null left out.

    Rows without id or text are left out. Of rows with equal hashes the smaller id and text come first; repeated rows may both be taken.
    Very long texts give the same four stretches as others. An empty table gives a model without languages.
    """
    require(docs, ["doc_id", "text", "lang"])
    n = F.length("text")
    windows = F.array(*(F.substring("text", (n * k / WINDOWS + 1).cast("int"), F.lit(STRETCH)) for k in range(WINDOWS)))
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (n > 0))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    # four times as many as are needed pass by their hash
    share = F.coalesce(*(F.when(F.col("lang") == r.lang, F.lit(min(1.0, (4.0 * per_language + 100) / r.n))) for r in sizes)) if sizes else F.lit(0.0)
    drawn = known.select("doc_id", "lang", windows.alias("windows"), F.xxhash64("doc_id", F.substring("text", 1, STRETCH)).alias("draw"))
    order = Window.partitionBy("lang").orderBy("draw", "doc_id", "windows")
    rows = (
        drawn.where(F.pmod("draw", F.lit(1 << 30)) < share * float(1 << 30))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= per_language)
        .select("lang", "windows")
        .collect()
    )
    pairs = sorted((r.lang, w) for r in rows for w in r.windows if w)
    return train([w.encode() for _, w in pairs], [y for y, _ in pairs], **options)


def predict(docs: DataFrame, model: ByteGru, language: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds to every row of docs its language and score, the share of the positions' probability that the language has.

    A null text or one without letters gives ``und`` and 0, and so does a model without languages. All bytes of all texts are read. Of
    languages with equal probability the first by name counts. Repeated rows each give a row, an empty table none. Columns named like
    the new ones are replaced; others of any name and type stay.
    """
    require(docs, ["doc_id", "text"])
    rest = [c for c in docs.columns if c.lower() not in (language.lower(), score.lower())]
    # the task sees numbered names, for some that a table may have cannot be passed on
    numbered = [f"c{k}" for k in range(len(rest))]
    kept = docs.select(*(F.col(quoted(c)).alias(k) for c, k in zip(rest, numbered, strict=True)), F.col("text").cast("binary").alias("body"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("body"))
            total = np.zeros((len(model.languages), len(offsets) - 1))
            for a, z in slices(offsets) if model.languages else ():
                starts, lengths, row = stretches(data, offsets[a : z + 1])
                for k in range(0, len(starts), WIDTH):
                    s, n = starts[k : k + WIDTH], lengths[k : k + WIDTH]
                    sums = model.probabilities(laid_out(data, s, n), n)
                    for j in range(len(total)):
                        total[j, a:z] += np.bincount(row[k : k + WIDTH], sums[j], z - a)
            size = np.diff(offsets)
            known = (size > 0) & batch.column("letters").to_numpy(zero_copy_only=False) if model.languages else np.zeros(len(size), bool)
            best = total.argmax(0) if model.languages else np.zeros(len(size), int)
            share = np.where(known, total[best, np.arange(len(size))] / np.maximum(size, 1), 0.0) if model.languages else np.zeros(len(size))
            names = [model.languages[j] if ok else UNDETERMINED for j, ok in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(names, pa.string()), pa.array(np.clip(share, 0, 1))], [*numbered, "language", "share"])
        release_memory()

    schema = StructType([StructField(f.name, f.dataType) for f in kept.schema if f.name in numbered]).add("language", StringType()).add("share", DoubleType())
    found = kept.mapInArrow(run, schema)
    return found.select(*(F.col(k).alias(c) for c, k in zip(rest, numbered, strict=True)), F.col("language").alias(language), F.col("share").alias(score))


def digest(docs: DataFrame, model: ByteGru) -> DataFrame:
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame, model: ByteGru, least_score: float = 0.3) -> DataFrame:
    """The rows of docs with a language, all columns kept: those predicted ``und``, or with a score below least_score, go."""
    language, score = fresh(docs, "lang_pred", "score")
    found = predict(docs, model, language, score).where((F.col(language) != UNDETERMINED) & (F.col(score) >= least_score))
    return found.select(*map(quoted, docs.columns))
