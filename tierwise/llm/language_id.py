"""Language identification by string kernels.

The kernel of two texts is the normalised number of character n-grams (blended spectrum, n = 1 to 3,
presence only) that both hold. Its feature space is fixed: letters fall into 63 classes, everything
else is one separator, and trigrams are hashed. ``LANDMARKS`` training texts give the Nyström map, and
kernel ridge regression is solved once for each language against the rest. As kernel, map and
regression are all linear in the presence vector, a batch of texts is scored by one matrix product.

The classifier is fitted on a bounded sample: at most ``SAMPLE`` texts of each language, those with the
smallest hash in each of as many buckets, and ``MOST`` texts in all. Every text is scored whole.

Defined results: ``und`` with score 0 for a null text, a text without a letter, or where nothing could be
learned; a null id is not held out but not learned from either; ties go to the first language by name; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwise.llm.common import map_arrow, schema_of, table

SAMPLE, MOST = 512, 8192
LANDMARKS, RIDGE = 192, 1e-2
#: Softmax factor that turns regression values into a score.
SHARPNESS = 6.0
CLASSES, HASHED = 64, 1 << 13
FEATURES = CLASSES + CLASSES * CLASSES + HASHED
BATCH = 64
_letters: np.ndarray | None = None


def letter_classes() -> np.ndarray:
    """Class of each code point of the basic plane: 0 for what is no letter, a to z for themselves, others by a rule."""
    global _letters
    if _letters is None:
        out = np.zeros(0x10000, np.uint8)
        for c in range(0x10000):
            if chr(c).isalpha():
                out[c] = c - 96 if 97 <= c <= 122 else 27 + c * 29 % 37
        _letters = out
    return _letters


def presence(text: str, flags: np.ndarray) -> bool:
    """Sets the flags of the n-grams of a text; False if it has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    kinds = letter_classes()[np.minimum(codes, 0xFFFF)].astype(np.int32)
    if len(codes) and int(codes.max()) > 0xFFFF:
        far = np.flatnonzero(codes > 0xFFFF)
        kinds[far] = [27 + int(c) * 29 % 37 if chr(c).isalpha() else 0 for c in codes[far]]
    if not kinds.any():
        return False
    # one separator before, between and after words
    kinds = np.concatenate(([0], kinds, [0]))
    kinds = kinds[np.concatenate(([True], (kinds[1:] > 0) | (kinds[:-1] > 0)))]
    flags[kinds] = 1
    pairs = kinds[:-1] * CLASSES + kinds[1:]
    flags[CLASSES + pairs] = 1
    triples = (pairs[:-1] * CLASSES + kinds[2:]).astype(np.uint32) * np.uint32(2654435761)
    flags[CLASSES + CLASSES * CLASSES + (triples >> np.uint32(32 - 13)).astype(np.int32)] = 1
    return True


class Model:
    """Languages and one weight of each n-gram for each of them."""

    def __init__(self, languages: list[str], weights: np.ndarray):
        self.languages, self.weights = languages, weights

    def scores(self, flags: np.ndarray) -> np.ndarray:
        """Softmax scores of a batch of presence vectors."""
        norm = np.sqrt(np.maximum(flags.sum(axis=1, dtype=np.float32), 1))
        values = SHARPNESS * (flags.astype(np.float32) @ self.weights) / norm[:, None]
        values = np.exp(values - values.max(axis=1, keepdims=True))
        return values / values.sum(axis=1, keepdims=True)


def fit(flags: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Nyström features from landmarks dealt over the languages, then one-versus-rest ridge regression."""
    languages = sorted(set(langs))
    if not languages:
        return None

    def unit(some: np.ndarray) -> np.ndarray:
        rows = some.astype(np.float64)
        rows /= np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))
        return rows

    at = {x: [i for i, y in enumerate(langs) if y == x] for x in languages}
    turn = [own[j] for j in range(max(map(len, at.values()))) for own in at.values() if j < len(own)]
    marks = unit(flags[turn[:landmarks]])
    values, vectors = np.linalg.eigh(marks @ marks.T)
    good = values > 1e-8 * values.max()
    to_features = marks.T @ (vectors[:, good] / np.sqrt(values[good]))
    del marks
    # the sample is never whole as numbers of 8 bytes
    phi = np.concatenate([unit(flags[i : i + BATCH]) @ to_features for i in range(0, len(flags), BATCH)])
    # languages weigh the same however many texts they have
    share = np.array([1 / len(at[x]) for x in langs])
    goal = np.array([[1.0 if x == y else -1.0 for y in languages] for x in langs])
    weights = np.linalg.solve((phi * share[:, None]).T @ phi + ridge * np.eye(phi.shape[1]), (phi * share[:, None]).T @ goal)
    return Model(languages, (to_features @ weights).astype(np.float32))


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fifth of the ids that is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, most: int = MOST) -> Model | None:
    """Fits on the sample of the rows that are not held out. Only presence bits of the sample come to the driver."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("h"))
    while True:
        picked = rows.groupBy("lang", F.pmod("h", F.lit(sample)).alias("bucket")).agg(F.min("h").alias("h")).limit(most + 1).collect()
        if len(picked) <= most or sample == 1:
            break
        sample = max(1, sample // 4)
    if not picked:
        return None
    chosen = F.broadcast(docs.sparkSession.createDataFrame([(r.lang, r.h) for r in picked[:most]], "lang string, h bigint"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = []
        for x in batch.column("text"):
            flags = np.zeros(FEATURES, np.uint8)
            bits.append(np.packbits(flags).tobytes() if presence(x.as_py(), flags) else None)
        return pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(bits, pa.binary())], names=["lang", "h", "bits"])

    found = map_arrow(rows.join(chosen, ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "h", "text"), run, "lang string, h bigint, bits binary")
    seen = sorted((r.h, r.lang, r.bits) for r in found.where("bits is not null").collect())
    bits = np.frombuffer(b"".join(b for _, _, b in seen), np.uint8).reshape(len(seen), -1) if seen else np.zeros((0, FEATURES // 8), np.uint8)
    flags = np.unpackbits(bits, axis=1)[:, :FEATURES]
    return fit(flags, [x for _, x, _ in seen])


def predictions(texts: list[str | None], model: Model | None) -> tuple[list[str], list[float]]:
    """Language and score of each text of a batch, by matrix products of BATCH texts."""
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    if model is None:
        return langs, scores
    flags, at = np.zeros((BATCH, FEATURES), np.uint8), []

    def flush() -> None:
        if at:
            found = model.scores(flags[: len(at)])
            for i, best, score in zip(at, found.argmax(axis=1).tolist(), found.max(axis=1).tolist(), strict=True):
                langs[i], scores[i] = model.languages[best], min(1.0, score)
            at.clear()
            flags[:] = 0

    for i, text in enumerate(texts):
        if text and presence(text, flags[len(at)]):
            at.append(i)
            if len(at) == BATCH:
                flush()
    flush()
    return langs, scores


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """docs with two more columns: the predicted language and its score. docs must not have columns of these names."""
    schema = schema_of(docs, docs.columns, f"{lang_name} string, {score_name} double")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(text_col)
        langs: list[str] = []
        scores: list[float] = []
        for first in range(0, len(texts), BATCH):
            a, b = predictions(texts.slice(first, BATCH).to_pylist(), model)
            langs += a
            scores += b
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return map_arrow(docs, run, schema)


def with_letters(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text has a letter: those that any model gives a language."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        flags = np.zeros(FEATURES, np.uint8)
        return batch.filter(pa.array([bool(text and presence(text, flags)) for text in batch.column(text_col).to_pylist()], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: whether it is held out, its predicted language, and a score."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs)
    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")
