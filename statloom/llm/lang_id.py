"""Language identification in two steps: the family first, then one-versus-one linear SVMs among the family's languages.

A text's features are its character n-grams (1 to 4, letters in lower case, all else a blank), hashed into ``dims`` bins;
a bin holds the square root of its share, so each vector has length 1. Families are told apart by one-versus-one SVMs as
well. Each SVM is trained in a task of its own on at most ``sample`` texts a language, chosen by a hash of the row; that
bound and the number of bins are the only limits, and every text is read whole, in training and in prediction.

Defined cases: ``und`` with score 0 for a null text and one without a letter, and for every text if no language could be
learned; a single learned language is always predicted, with score 1; rows are predicted one by one, so repeated rows get
equal results; a null doc_id is held in (it has no remainder) and predicted like others; a very long text is read whole; an empty
table gives none; further columns, whatever their names, are not read, or stay where ``keep_columns`` asks for them (but for
columns named as the results, which are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from statloom.llm.common import cut, in_parts

#: Families of ISO 639-1 codes. A language that is not here is a family of its own.
FAMILY = {
    "romance": "ca es fr gl it la oc pt ro",
    "germanic": "af da de en is lb nl no nb nn sv",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "baltic": "lt lv",
    "turkic": "az kk tr uz",
    "indic": "bn gu hi mr ne pa ur",
    "semitic": "ar he mt",
}
FAMILY_OF = {code: family for family, codes in FAMILY.items() for code in codes.split()}


@dataclass(frozen=True)
class Settings:
    dims: int = 1 << 13
    longest: int = 4
    sample: int = 300  # texts of each language that training sees, at most


class Features:
    def __init__(self, s: Settings):
        self.s = s
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)

    def __call__(self, text: str | None) -> np.ndarray | None:
        """The vector, or None if there is no letter."""
        if not text:
            return None
        c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), np.uint32)
        letter = self.letter[c]
        if not letter.any():
            return None
        c = np.where(letter, c, np.uint32(32))[letter | np.concatenate([[True], letter[:-1]])]  # one blank between words
        counts = np.zeros(self.s.dims, np.int64)
        h = c.copy()
        for n in range(1, self.s.longest + 1):
            if n > 1:
                if len(c) < n:
                    break
                h = h[:-1] * np.uint32(0x01000193) ^ c[n - 1 :]
            mixed = (h + np.uint32(n)) * np.uint32(0x9E3779B1)
            counts += np.bincount((mixed ^ mixed >> np.uint32(15)) & np.uint32(self.s.dims - 1), minlength=self.s.dims)
        return np.sqrt(counts / counts.sum()).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, rounds: int = 150, c: float = 30.0) -> np.ndarray:
    """A linear SVM with squared hinge loss by accelerated gradient steps; y is +1 or -1, classes weigh the same."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * c
    step = 1 / (1 / c + 2 * c * 2)  # rows have length 1, and 1 for the constant
    w = ahead = np.zeros(x.shape[1])
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - step * (ahead / c - 2 * (weight * slack * y) @ x)
        ahead, w = new + k / (k + 3) * (new - w), new
    return w.astype(np.float32)


def training_rows(docs: DataFrame, s: Settings) -> DataFrame:
    """lang, text: at most s.sample rows of each language among rows that are not held out."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(~held_out()).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    n = known.groupBy("lang").agg(F.count("*").alias("n"))
    some = known.join(n, "lang").where(F.pmod("h", F.lit(1 << 20)) < F.ceil(F.lit(1 << 20) * (2.0 * s.sample + 50) / F.col("n")))  # before the window, so that it stays small
    return some.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("k") <= s.sample).select("lang", "text")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, s: Settings = Settings()) -> dict:
    """The model: languages, and for each pair (of families, or of languages of one family) a weight vector."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(s)
        for batch in batches:
            x = [(lang, v.tobytes()) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (v := features(text)) is not None]
            yield pa.record_batch([pa.array([k for k, _ in x], pa.string()), pa.array([v for _, v in x], pa.binary())], names=["lang", "x"])

    rows = training_rows(docs, s).mapInArrow(vectors, "lang string, x binary")
    rows = cut(rows)  # bounded by s.sample a language
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect())
    family = {x: FAMILY_OF.get(x, x) for x in langs}
    pairs = [("family", *p) for p in combinations(sorted(set(family.values())), 2)] + [("lang", a, b) for a, b in combinations(langs, 2) if family[a] == family[b]]
    model = {"langs": langs, "family": family, "pairs": {}}
    if not pairs:
        return model
    of = lambda p, x: family[x] if p[0] == "family" else x
    tasks = [(k, x, 1.0 if of(p, x) == p[1] else -1.0) for k, p in enumerate(pairs) for x in langs if of(p, x) in p[1:]]
    tasks = rows.sparkSession.createDataFrame(tasks, "pair int, lang string, y float")

    def fit(table: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(table["x"].to_pylist()), np.float32).reshape(table.num_rows, s.dims)
        order = np.lexsort([*x[:, :8].T, table["y"].to_numpy()])  # sums do not depend on the order of arrival
        w = fit_svm(x[order], table["y"].to_numpy()[order])
        return pa.table({"pair": pa.array([table["pair"][0].as_py()], pa.int32()), "w": [w.tobytes()]})

    for r in rows.join(tasks, "lang").groupBy("pair").applyInArrow(fit, "pair int, w binary").collect():  # a few vectors
        model["pairs"][pairs[r.pair]] = np.frombuffer(bytes(r.w), np.float32)
    return model


def vote(names: list[str], kind: str, model: dict, x: np.ndarray) -> tuple[str, float]:
    """The name that wins most duels, then by its margins; and its weakest duel as a number from 0 to 1."""
    wins, total, weakest = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0)
    for a, b in combinations(names, 2):
        w = model["pairs"][kind, a, b]
        m = float(x @ w[:-1] + w[-1])
        for name, mine in ((a, m), (b, -m)):
            wins[name] += mine > 0
            total[name] += mine
            weakest[name] = min(weakest[name], 1 / (1 + np.exp(-np.clip(4 * mine, -50, 50))))
    best = max(sorted(names), key=lambda n: (wins[n], total[n]))
    return best, float(weakest[best])


def predict(docs: DataFrame, model: dict, s: Settings = Settings(), keep_columns: bool = False) -> DataFrame:
    """lang_pred and score for each document, after its doc_id or, with keep_columns, after all its columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a vector of s.dims numbers for each pair
    rest = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score")]) if keep_columns else docs.select("doc_id", "text")
    at = rest.columns.index("text")
    kept = [i for i, c in enumerate(rest.columns) if keep_columns or c != "text"]
    names = [*(rest.columns[i] for i in kept), "lang_pred", "score"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, model = Features(s), shared.value
        families = sorted(set(model["family"].values()))
        members = {f: [x for x in model["langs"] if model["family"][x] == f] for f in families}
        for batch in in_parts(batches, at):
            out = []
            for text in batch.column(at).to_pylist():
                x = features(text) if families else None
                if x is None:
                    out.append(("und", 0.0))
                    continue
                family, sure = vote(families, "family", model, x)
                lang, surer = vote(members[family], "lang", model, x)
                out.append((lang, sure * surer))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array([x for x, _ in out], pa.string()), pa.array([p for _, p in out], pa.float64())], names=names)

    schema = rest.select(*names[:-2]).schema.add("lang_pred", StringType()).add("score", DoubleType())
    return rest.mapInArrow(rows, schema)
