"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of three lexicons (a fixed one, and words and word beginnings learned from labelled rows), how near
hits stand to second-person words, capitals, punctuation and obfuscation rates, and length.

Training reads at most TRAIN_ROWS labelled rows, chosen by a hash of their id, and none whose crc32(id) mod 5 is 0 (held
out). Everything is cross-fitted, so that each row teaches every part and none is judged by what it taught: rows are dealt
into four folds, class by class; a row's features use terms learned on the other three folds; trees are fitted on either half
of the folds and their scores of the other half are calibrated. Documents are scored with the terms of all folds and the mean
of both halves' trees. A term is kept if it is LIFT times as frequent in toxic rows, by more than chance: a rule of its own
counts, so that terms of a language with few rows do not compete with others.

Edge cases: a null or empty text has all features 0 and gets a score like any other; labels that are null or whose id
has no document are ignored, of repeated labels the larger counts; with fewer than two labelled rows of either class nothing
can be cross-fitted: every score is then the share of label 1 (0 without labels), and a warning says so; a very long text is
split into words piece by piece; repeated rows are scored each; an empty table gives no rows; further columns, whatever
their names, are kept by `drop_toxic` and ignored by `toxicity_scores`.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, releasing, written

#: Labelled rows that training reads at most; toxic rows a term must stand in; folds.
TRAIN_ROWS, SUPPORT, FOLDS = 20_000, 4, 4
#: How much commoner a term must be in toxic rows, and by how many standard deviations; words between a hit and a second-person word that are near.
LIFT, DEVIATIONS, NEAR = 8.0, 3.0, 5
#: Rows that a worker looks at at once.
GROUP_ROWS = 1024
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb fool loser losers pathetic scum trash garbage worthless disgusting clown clowns vermin filth freak creep jerk imbecile "
    "dummkopf trottel abschaum versager ekelhaft widerlich blödmann dreckig imbécile imbéciles crétin stupide ordure minable ridicule "
    "idiota idiotas imbécil estúpido estúpida basura escoria patético asqueroso inútil".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner euch euer ihr tu te toi ton vous votre vos tú ti usted ustedes vosotros".split())
_PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, "-": None, "_": None, ".": None})
_GAP = re.compile(r"\s").search
_EDGE = re.compile(r"^\W+|\W+$")
_INNER = re.compile(r"[^\W\d_][\d@$*!_.]+[^\W\d_]")
_LONG = re.compile(r"(\w)\1{3,}")
_MARK = re.compile(r"[.,;:!?]")
_HIT, _WORD, _STEM, _YOU, _CAPS, _OBFUSCATED, _LOUD, _MARKED = (1 << i for i in range(8))
CACHE_WORDS, PIECE = 150_000, 1 << 20
NAMES = ("insults", "terms", "stems", "log_terms", "log_stems", "second_person", "near_second_person", "capitals", "loud", "obfuscation", "log_words", "punctuation")


def word_lists(text: str) -> Iterator[list[str]]:
    """Words between white space, of a long text piece by piece."""
    at = 0
    while at < len(text):
        gap = _GAP(text, at + PIECE) if at + PIECE < len(text) else None
        end = gap.start() if gap else len(text)
        yield text[at:end].split()
        at = end


def bare(word: str) -> str:
    return _EDGE.sub("", word.lower())


def terms_of(text: str) -> set[str]:
    """w:word of each word and s:beginning of 4 to 6 letters."""
    words = {bare(w) for words in word_lists(text) for w in words}
    return {"w:" + w for w in words if len(w) > 2} | {f"s:{w[:n]}" for w in words for n in (4, 5, 6) if len(w) > n}


Lexicon = tuple[frozenset[str], frozenset[str]]


class _Codes(dict):
    """A word to the bits of what it is."""

    def __init__(self, words: frozenset[str], stems: frozenset[str]):
        super().__init__()
        self.words, self.stems = words, stems

    def __missing__(self, word: str) -> int:
        low = bare(word)
        plain = bare(word.lower().translate(_PLAIN))
        code = (low in INSULTS or plain in INSULTS) * _HIT | (low in self.words or plain in self.words) * _WORD
        code |= any(low[:n] in self.stems for n in (4, 5, 6)) * _STEM | (low in SECOND_PERSON) * _YOU
        code |= (len(low) > 1 and word.isupper()) * _CAPS | bool(_INNER.search(word) or _LONG.search(low)) * _OBFUSCATED
        code |= (word[-1:] in "!?") * _LOUD | bool(_MARK.search(word)) * _MARKED
        if len(word) < 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = code
        return code


def features_of(text: str, codes: _Codes) -> list[float]:
    code = np.concatenate([np.empty(0, dtype=np.uint8), *[np.array([codes[w] for w in words], dtype=np.uint8) for words in word_lists(text)]])
    n = len(code)
    if not n:
        return [0.0] * len(NAMES)
    sums = [int(np.count_nonzero(code & b)) for b in (_HIT, _WORD, _STEM, _YOU, _CAPS, _LOUD, _OBFUSCATED, _MARKED)]
    insults, terms, stems, you, caps, loud, odd, marks = sums
    near = 0
    if you and (insults or terms or stems):
        hits, spots = np.flatnonzero(code & (_HIT | _WORD | _STEM)), np.flatnonzero(code & _YOU)
        i = np.searchsorted(spots, hits)
        gap = np.minimum(np.abs(spots[np.minimum(i, len(spots) - 1)] - hits), np.abs(spots[np.maximum(i - 1, 0)] - hits))
        near = int((gap <= NEAR).sum())
    return [insults / n, terms / n, stems / n, float(np.log1p(terms)), float(np.log1p(stems)), you / n, near / n, caps / n, loud / n, odd / n, float(np.log1p(n)), marks / n]


def with_features(docs: DataFrame, lexicons: list[Lexicon], text_col: str = "text", drop: tuple[str, ...] = (), out: str = "_features", fold_col: str | None = None) -> DataFrame:
    """docs without the columns of drop, and the features; every row keeps its other columns.

    With fold_col, a row's lexicon is that of its fold; else the first.
    """
    kept = [f.name for f in docs.schema if f.name not in drop]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(out, T.ArrayType(T.DoubleType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = [_Codes(*lexicon) for lexicon in lexicons]
        for whole in batches:
            for at in range(0, whole.num_rows, GROUP_ROWS):
                batch = whole.slice(at, GROUP_ROWS)
                folds = batch.column(fold_col).to_pylist() if fold_col else [0] * batch.num_rows
                rows = [features_of(x.as_py() or "", codes[f]) for f, x in zip(folds, batch.column(text_col), strict=True)]
                made = pa.array(rows, pa.list_(pa.field("element", pa.float64(), nullable=False)))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], made], names=[*kept, out])

    return docs.mapInArrow(releasing(run), schema)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


class Model:
    """A fitted scorer: lexicon, trees and calibration, or a constant where there is nothing to learn from."""

    def __init__(self, lexicon: Lexicon | None = None, trees=(), steps=None, constant: float = 0.0):
        self.lexicon, self.trees, self.steps, self.constant = lexicon, trees, steps, constant

    def score(self, docs: DataFrame, text_col: str = "text", drop: tuple[str, ...] = (), out: str = "score") -> DataFrame:
        """docs (without drop) with a column `out` from 0 to 1."""
        if not self.trees:
            return docs.drop(*drop).withColumn(out, F.lit(float(self.constant)))
        kept = [F.col(c) for c in docs.columns if c not in drop]
        name = {n: fresh(docs, f"_toxicity_{n}") for n in ("features", "vector", "first", "calibrated")}
        made = with_features(docs, [self.lexicon], text_col, drop, name["features"]).withColumn(name["vector"], array_to_vector(name["features"]))
        scored, each = made, []
        for i, trees in enumerate(self.trees):
            own = [fresh(docs, f"_toxicity_{n}{i}") for n in ("raw", "probability", "prediction")]
            scored = trees.copy().setFeaturesCol(name["vector"]).setRawPredictionCol(own[0]).setProbabilityCol(own[1]).setPredictionCol(own[2]).transform(scored)
            each.append(vector_to_array(own[1])[1])
        scored = scored.withColumn(name["first"], reduce(Column.__add__, each) / len(each))
        scored = self.steps.copy().setFeaturesCol(name["first"]).setPredictionCol(name["calibrated"]).transform(scored)
        return scored.select(*kept, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(name["calibrated"]))).alias(out))


def learn_lexicons(rows: DataFrame) -> list[Lexicon]:
    """From rows (text, toxic, fold): the terms that mark toxic rows, learned without each fold, and last on all of them.

    One count of the terms serves all: what a fold holds is taken off.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic, fold in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                terms = list(terms_of(text.as_py() or ""))
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([toxic] * len(terms), pa.int32()), pa.array([fold] * len(terms), pa.int32())], names=["term", "toxic", "fold"])

    size = {(r["fold"], r["toxic"]): r["n"] for r in rows.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    of = lambda i, y: F.count_if((F.col("fold") == i) & (F.col("toxic") == y))
    counts = rows.select("text", F.col("toxic").cast("int"), "fold").mapInArrow(releasing(run), "term string, toxic int, fold int").groupBy("term")
    counts = counts.agg(*[of(i, y).alias(f"n{i}{y}") for i in range(FOLDS) for y in (0, 1)])
    marks = []
    for left in (*range(FOLDS), None):
        used = [i for i in range(FOLDS) if i != left]
        toxic, other = (reduce(Column.__add__, [F.col(f"n{i}{y}") for i in used]) for y in (1, 0))
        toxic_rows, other_rows = (sum(size.get((i, y), 0) for i in used) for y in (1, 0))
        share = toxic_rows / max(1, toxic_rows + other_rows)
        lift = ((toxic + 0.1) / (toxic_rows + 1)) / ((other + 0.1) / (other_rows + 1))
        chance = (toxic + other) * share
        marks.append((toxic >= SUPPORT) & (lift >= LIFT) & (toxic - chance >= DEVIATIONS * F.sqrt(chance * (1 - share) + 0.25)))
    found = counts.select("term", F.array(*marks).alias("in")).where(F.exists("in", lambda x: x)).collect()  # terms of a bounded sample
    kept = [[r["term"] for r in found if r["in"][i]] for i in range(FOLDS + 1)]
    return [(frozenset(t[2:] for t in terms if t[0] == "w"), frozenset(t[2:] for t in terms if t[0] == "s")) for terms in kept]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, seed: int = 11) -> Model:
    """Learn from documents and labels (id, toxic), at most train_rows of those that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64(F.lit(seed), "_id")).limit(train_rows)
    in_class = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64(F.lit(seed + 1), "_id")))
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id")
    rows = written(joined, "labelled")
    dealt = rows.select("_id", "toxic").distinct().withColumn("fold", (in_class % FOLDS).cast("int")).select("_id", "fold")  # a bounded sample
    rows = written(rows.join(F.broadcast(dealt), "_id"), "folds")
    seen = {r["toxic"]: r["n"] for r in dealt.join(rows.select("_id", "toxic").distinct(), "_id").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if min(seen.get(0, 0), seen.get(1, 0)) < 2:
        warnings.warn(f"toxicity: labelled rows by class: {seen}; every score is the share of class 1", stacklevel=2)
        return Model(constant=seen.get(1, 0) / max(1, sum(seen.values())))
    *without, lexicon = learn_lexicons(rows)
    made = with_features(rows, without, "text", ("text",), fold_col="fold")
    made = written(made.select((F.col("fold") % 2).alias("half"), F.col("toxic").cast("double").alias("label"), "_features").coalesce(6), "features").withColumn("_vector", array_to_vector("_features"))
    boosted = GBTClassifier(featuresCol="_vector", labelCol="label", predictionCol="_prediction", maxIter=20, maxDepth=3, stepSize=0.2, minInstancesPerNode=3, seed=seed)
    boosted = boosted.setProbabilityCol("_probability").setRawPredictionCol("_rawPrediction")
    with ThreadPoolExecutor(2) as pool:  # rounds are short jobs of few tasks: both halves run at once
        trees = list(pool.map(inheritable_thread_target(lambda h: boosted.copy().fit(made.where(F.col("half") == h))), (0, 1)))
    judged = [t.transform(made.where(F.col("half") != h)).select("label", vector_to_array("_probability")[1].alias("_raw")) for h, t in enumerate(trees)]
    # Equal scores are one row with their number as its weight, so that no task gets all rows of a frequent score.
    grouped = judged[0].unionByName(judged[1]).groupBy("_raw").agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("_weight"))
    steps = IsotonicRegression(featuresCol="_raw", labelCol="label", weightCol="_weight", predictionCol="_calibrated").fit(written(grouped, "scores"))
    return Model(lexicon, trees, steps)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    slim = docs.select("doc_id", "text")
    scored = fit(docs, labels).score(slim, "text", ("text",))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the documents scored 0.5 or more."""
    score = fresh(docs, "_score")
    return fit(docs, labels).score(docs, out=score).where(F.col(score) < 0.5).drop(score)
