"""Language identification by families, then one-versus-one linear support vector machines.

Features are hashed byte n-grams (1 to 3) of the whole text. From a bounded
sample of the labelled documents of every language the languages' mean vectors
are grouped into families (languages whose vectors are closer than those of an
average pair), one-versus-one machines are fitted between families, and others
between the languages of each family. A text is first given a family, then a
language. Means and machines are made in Spark groups: the driver holds one mean
for each language and the machines, never the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import bound_batches, release
from graphloom.scratch import discard, materialize

#: Hash buckets of n-grams, and the lengths of n-grams.
FEATURES, GRAMS = 4096, (1, 2, 3)
#: Labelled documents of one language that the fit takes at most, about (by the hash of their id and text); every
#: language takes part.
SAMPLE_PER_LANGUAGE = 600
#: Documents of one family in the machines between families at most; each of its languages gives an equal part, one document at least.
SAMPLE_PER_FAMILY = 3000
#: Languages, and families, in a block: a Spark group fits the machines of two blocks.
BLOCK, FAMILY_BLOCK = 4, 2

UNDETERMINED = "und"


def features(texts: list[str]) -> np.ndarray:
    """One row for each text: square roots of hashed n-gram counts, scaled to length 1."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for k, t in enumerate(texts):
        raw = np.frombuffer(t.encode("utf-8", "surrogatepass").lower(), np.uint8).astype(np.uint32)
        if not len(raw):
            continue
        code = raw + np.uint32(1)
        counts = np.zeros(FEATURES)
        rolled = np.zeros(len(raw), np.uint32)
        for n in range(1, max(GRAMS) + 1):
            if len(code) < n:
                break
            rolled = (rolled[: len(code) - n + 1] * np.uint32(0x01000193)) ^ code[n - 1 :] if n > 1 else code
            if n in GRAMS:
                slot = (rolled * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - FEATURES.bit_length() + 1)
                counts += np.bincount(slot, minlength=FEATURES)
        out[k] = np.sqrt(counts)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


@dataclass
class LanguageModel:
    families: list[list[str]]
    #: (positive, negative, weights, bias) of machines between families (by number) and within each family.
    between: list[tuple[int, int, np.ndarray, float]]
    within: list[list[tuple[str, str, np.ndarray, float]]]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each row: family confidence times language confidence."""
        n = len(x)
        if not self.families:
            return np.full(n, UNDETERMINED, object), np.zeros(n)
        family, sure = _vote(x, list(range(len(self.families))), self.between)
        lang, score = np.empty(n, object), np.zeros(n)
        for k, names in enumerate(self.families):
            rows = np.flatnonzero(family == k)
            if len(rows):
                best, conf = _vote(x[rows], names, self.within[k])
                lang[rows], score[rows] = best, conf * sure[rows]
        return lang, np.clip(score, 0.0, 1.0)


def _vote(x: np.ndarray, names: list, machines: list) -> tuple[np.ndarray, np.ndarray]:
    """The name with most one-versus-one votes (then margin), and the mean confidence of its machines."""
    if len(names) == 1:
        return np.full(len(x), names[0], object), np.ones(len(x))
    at = {n: k for k, n in enumerate(names)}
    votes, support = np.zeros((len(x), len(names))), np.zeros((len(x), len(names)))
    for a, b, w, bias in machines:
        m = x @ w + bias
        p = 1 / (1 + np.exp(-4 * np.clip(m, -50, 50)))
        votes[:, at[a]] += m >= 0
        votes[:, at[b]] += m < 0
        support[:, at[a]] += p
        support[:, at[b]] += 1 - p
    best = (votes * len(names) + support).argmax(axis=1)
    return np.array(names, object)[best], support[np.arange(len(x)), best] / (len(names) - 1)


def fit_machine(x: np.ndarray, y: np.ndarray, rounds: int = 40, c: float = 4.0) -> tuple[np.ndarray, float]:
    """A linear support vector machine by dual coordinate descent; y is +1 or -1, classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y) * c
    square = (x * x).sum(axis=1)
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    rng = np.random.default_rng(11)
    for _ in range(rounds):
        moved = 0.0
        for k in rng.permutation(len(x)):
            new = min(max(alpha[k] - (y[k] * (w @ x[k]) - 1) / square[k], 0.0), weight[k])
            if new != alpha[k]:
                w += (new - alpha[k]) * y[k] * x[k]
                moved = max(moved, abs(new - alpha[k]))
                alpha[k] = new
        if moved < 1e-3:
            break
    return w[:-1].astype(np.float32), float(w[-1])


def group_families(means: np.ndarray) -> list[list[int]]:
    """Languages joined while the closest two groups are closer than the mean pair (average linkage)."""
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    near = (unit @ unit.T).astype(np.float64)
    groups = [[k] for k in range(len(means))]
    if len(groups) < 3:
        return groups
    floor = near[np.triu_indices(len(means), 1)].mean()
    size, total = np.ones(len(means)), near.copy()  # total: sums of the similarities between two groups
    while len(groups) > 2:
        mean = np.where(np.tri(len(groups), dtype=bool), -np.inf, total / np.outer(size, size))
        i, j = divmod(mean.size - 1 - int(mean[::-1, ::-1].argmax()), len(groups))
        if mean[i, j] <= floor:
            break
        groups[i] += groups.pop(j)
        size[i] += size[j]
        total[i] += total[j]
        total[:, i] += total[:, j]
        size, total = np.delete(size, j), np.delete(np.delete(total, j, 0), j, 1)
    return groups


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            b = whole.slice(at, 256)
            x = features(b.column(0).to_pylist()).astype(np.float16)
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in x], pa.binary()), b.column(1), b.column(2)], names=["x", "lang", "h"])


def _rows(blobs: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.float16) for v in blobs])


def _rank(most: int):
    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        """One language's sample in order, at most `most` documents, after a row of rank -1 with the mean."""
        pdf = pdf.sort_values(["h", "x"]).head(most)
        mean = _rows(pdf.x).astype(np.float32).mean(axis=0)
        return pd.DataFrame({"lang": pdf.lang.iloc[0], "rank": np.arange(-1, len(pdf), dtype=np.int32), "x": [mean.tobytes(), *pdf.x]})

    return rank


def _fit_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """The machines of each two classes of two blocks (of one, if they are the same)."""
    pdf = pdf.sort_values(["lang", "rank"])
    cls, block, x = pdf["class"].to_numpy(), pdf["block"].to_numpy(), _rows(pdf.x)
    i, j = (int(pdf[c].iloc[0]) for c in ("i", "j"))
    left, right = (sorted(set(cls[block == k])) for k in (i, j))
    out = []
    for a, b in combinations(left, 2) if i == j else product(left, right):
        rows = (cls == a) | (cls == b)
        w, bias = fit_machine(x[rows].astype(np.float32), np.where(cls[rows] == a, 1, -1))
        out.append((int(pdf.level.iloc[0]), a, b, w.tobytes(), bias))
    del x
    release()
    return pd.DataFrame(out, columns=["level", "a", "b", "w", "bias"])


def _fit_families(sample: DataFrame, families: list[list[str]]) -> LanguageModel:
    """Machines between families (level -1) and between the languages of family k (level k), from ranked rows of all languages."""
    placed = []  # (language, level, class, its block, blocks of the level, documents of the language at most)
    for k, names in enumerate(families):
        if len(families) > 1:
            placed += [(n, -1, k, k // FAMILY_BLOCK, -(-len(families) // FAMILY_BLOCK), max(1, SAMPLE_PER_FAMILY // len(names))) for n in names]
        if len(names) > 1:
            placed += [(n, k, c, c // BLOCK, -(-len(names) // BLOCK), None) for c, n in enumerate(names)]
    between, within = [], [[] for _ in families]
    if placed:
        places = sample.sparkSession.createDataFrame(placed, "lang string, level int, class int, block int, blocks int, most int")
        dealt = sample.join(F.broadcast(places), "lang").where("most is null or rank < most")
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("lang", "rank", "x", "level", "class", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        machines = dealt.groupBy("level", "i", "j").applyInPandas(_fit_blocks, "level int, a int, b int, w binary, bias double")
        for r in sorted(machines.collect(), key=lambda r: (r.level, r.a, r.b)):
            w = np.frombuffer(r.w, np.float32)
            if r.level < 0:
                between.append((r.a, r.b, w, r.bias))
            else:
                within[r.level].append((families[r.level][r.a], families[r.level][r.b], w, r.bias))
    return LanguageModel(families, between, within)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """A model of every language from rows with a language and a text that has a letter.

    About `per_language` documents of a language are taken at most, by their hashes;
    rows of equal hash, as repeated ones, are taken or left together. Texts are read
    whole. Without such rows, as in an empty table, the model knows no language.
    """
    bound_batches(labelled)
    rows = labelled.select(F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    shares = materialize(rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(1.0 * per_language) / F.count("*")).alias("share")), "language-shares")
    picked = rows.join(F.broadcast(shares), "lang").where((F.pmod("h", F.lit(1 << 30)) / F.lit(1 << 30)) < F.col("share"))
    found = picked.select("text", "lang", "h").mapInArrow(_extract, "x binary, lang string, h long")
    sample = materialize(found.groupBy("lang").applyInPandas(_rank(per_language + per_language // 4), "lang string, rank int, x binary"), "language-sample")
    means = {r.lang: np.frombuffer(r.x, np.float32) for r in sample.where("rank < 0").select("lang", "x").collect()}
    names = sorted(means)
    if not names:
        return LanguageModel([], [], [])
    families = [[names[k] for k in g] for g in group_families(np.stack([means[n] for n in names]))]
    model = _fit_families(sample.where("rank >= 0"), families)
    discard(shares, sample)
    return model


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, lang_pred, score (0 to 1), row (all columns as they came).

    A text that is null or has no letter is `und` with score 0, as is every text
    if the model knows no language. Nothing but the text is looked at. A row
    without id takes no part; repeated rows get the same answer. Extra columns
    may have any name. A long text is read whole in its task; of languages with equal
    votes that with the larger margins is taken. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct("*").alias("row")).where("doc_id is not null")
    bound_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, scores = [], []
        for at in range(0, len(texts), 256):
            lang, score = shared.value.predict(features(texts.iloc[at : at + 256].tolist()))
            langs += lang.tolist()
            scores += score.tolist()
        return pd.DataFrame({"lang": langs, "score": scores})

    lettered = F.col("text").rlike(r"\p{L}")
    return (
        rows.withColumn("p", predict("text"))
        .select("doc_id", F.when(lettered, F.col("p.lang")).otherwise(UNDETERMINED).alias("lang_pred"), F.when(lettered, F.col("p.score")).otherwise(0.0).alias("score"), "row")
    )
