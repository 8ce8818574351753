"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

* The lexicon is learned: word beginnings and words that mark toxic texts
  among the training rows.  An automaton over it gives densities of hits.
* Other features: hits close to a word of the second person, capitals,
  punctuation, and obfuscation (words of letters mixed with digits or signs,
  hits that only show once such signs are read as letters).
* Boosted trees (Spark ML) are fitted on most of the training rows, the
  isotonic calibration on the rest.

Only labelled rows whose ``crc32(doc_id as text) mod 5`` is not 0 are used
for lexicon, trees and calibration, and of these a sample of at most
``max_rows`` (chosen by a hash of the id).  Every document is scored.

Results for odd input: a null or empty text has features 0 and is scored like
any other; a null ``doc_id`` is scored, never trained on, and not held out;
repeated labels of one document count as toxic if one is; without labelled
rows of both kinds every score is the share of toxic ones among the training
rows (0 without any); other columns of the input are not read.
"""

from __future__ import annotations

import bisect
import math
import re
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmix.llm.common import arrow_schema, map_batches, map_rows, materialize, table

FOLDS = 5
# Bound of the sample that lexicon, trees and calibration are fitted on.
MAX_ROWS = 20_000
# A lexicon entry is a word's first letters (these many) or a whole word.
STEMS = (4, 5, 6)
MAX_LEXICON = 400
# Least share of toxic training texts with an entry, least number, least precision (classes weighed equally).
MIN_SHARE, MIN_TEXTS, MIN_PRECISION = 0.015, 3, 0.95
NEAR = 5

# Words of the second person in the four languages of the texts.
SECOND_PERSON = ("you your yours yourself u ur du dich dir dein deine euch euer ihr tu te toi ton ta vous votre "
                 "tú ti usted ustedes vosotros").split()
# Signs and digits commonly written for letters.
LEET = str.maketrans("013457@$!", "oieastasi")
MIXED = re.compile(r"[^\W\d_]+[0-9@$!*]+[^\W\d_]")
STRETCHED = re.compile(r"([^\W\d_])\1\1")
NOT_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
CAPITALS = bytes(range(65, 91))
NOT_PUNCTUATION = bytes(b for b in range(256) if b not in b"!?.,;:'\"-")
NOT_SHOUTS = bytes(b for b in range(256) if b not in b"!?")

FEATURES = ("hit_density", "hit_kinds", "hits", "near_second_person", "hidden_hit_density", "capitals",
            "punctuation", "shouts", "mixed_words", "stretched_words")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("bigint").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def word_line(text: str) -> tuple[str, int]:
    """The lower-cased words, a blank before and after each, one character a byte; their number."""
    words = text.lower().encode().translate(NOT_LETTERS).split()
    return (b" " + b" ".join(words) + b" ").decode("latin-1"), len(words)


def entries_of(text: str) -> set[str]:
    """Candidate lexicon entries of a text: `` stem`` (beginning of a word) and `` word ``."""
    found = set()
    for word in set(word_line(text)[0].split()):
        if len(word) >= STEMS[0]:
            found.add(f" {word} ")
            found.update(f" {word[:n]}" for n in STEMS if len(word) > n)
    return found


def learn_lexicon(sample: DataFrame) -> list[str]:
    """Entries that mark toxic texts of ``sample`` (text, toxic); at most ``MAX_LEXICON``.

    Exact copies count once.  An entry is dropped when it extends a better one.
    """
    schema = arrow_schema({"entry": pa.string(), "toxic": pa.int64()})

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256).to_pydict()
                entries, marks = [], []
                for text, toxic in zip(part["text"], part["toxic"]):
                    own = entries_of(text or "")
                    entries.extend(own)
                    marks.extend([toxic] * len(own))
                yield pa.RecordBatch.from_arrays([pa.array(entries, pa.string()), pa.array(marks, pa.int64())],
                                                 schema=schema)

    texts = sample.groupBy("text").agg(F.max("toxic").alias("toxic"))
    n = texts.agg(F.sum("toxic").alias("p"), F.count(F.lit(1)).alias("n")).first()
    toxic, clean = int(n["p"] or 0), int(n["n"]) - int(n["p"] or 0)
    if not toxic or not clean:
        return []
    counts = (map_batches(texts, run, schema).groupBy("entry")
              .agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")))
    rate_p, rate_n = F.col("p") / toxic, F.col("n") / clean
    best = (counts.where(F.col("p") >= max(MIN_TEXTS, math.ceil(MIN_SHARE * toxic)))
            .where(rate_p >= MIN_PRECISION * (rate_p + rate_n))
            .orderBy(F.desc(rate_p - 5 * rate_n), F.length("entry"), "entry").limit(MAX_LEXICON).collect())
    chosen: list[str] = []
    for row in best:
        if not any(row["entry"].startswith(c) for c in chosen):
            chosen.append(row["entry"])
    return chosen


class Features:
    """Dense features of a text; built once per task from the lexicon."""

    def __init__(self, lexicon: list[str]):
        self.automaton = ahocorasick.Automaton()
        for entry in lexicon:
            self.automaton.add_word(entry, entry)
        for word in SECOND_PERSON:
            line = word.encode().decode("latin-1")
            if f" {line} " not in self.automaton:
                self.automaton.add_word(f" {line} ", None)
        self.automaton.make_automaton()

    def _hits(self, line: str) -> tuple[list[tuple[int, str]], list[int]]:
        """(word number, entry) of lexicon hits and word numbers of the second person."""
        hits, second, seen, at = [], [], 0, 0
        for end, entry in self.automaton.iter(line):
            # Blanks up to the end: the number of words begun, or ended where the entry ends in one.
            last = end if entry is None or entry[-1] == " " else end + 1
            seen += line.count(" ", at, last)
            at = last
            (second.append(seen) if entry is None else hits.append((seen, entry)))
        return hits, second

    def of(self, text: str) -> tuple[float, ...]:
        line, n = word_line(text)
        hits, second = self._hits(line)
        near = 0
        for w, _ in hits:  # both lists ascend
            first = bisect.bisect_left(second, w - NEAR)
            near += first < len(second) and second[first] <= w + NEAR
        hidden = 0
        mixed = len(MIXED.findall(text))
        if mixed:
            hidden = max(0, len(self._hits(word_line(text.translate(LEET))[0])[0]) - len(hits))
        raw = text.encode()
        words, size = max(n, 1), max(len(raw), 1)
        return (len(hits) / words, float(len({e for _, e in hits})), float(min(len(hits), 50)), near / words,
                hidden / words, (len(raw) - len(raw.translate(None, CAPITALS))) / size,
                len(raw.translate(None, NOT_PUNCTUATION)) / size, len(raw.translate(None, NOT_SHOUTS)) / size,
                mixed / words, len(STRETCHED.findall(text)) / words)


def features(docs: DataFrame, lexicon: list[str], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The integer columns ``keep`` and the features of every text."""
    schema = arrow_schema({c: pa.int64() for c in keep} | {f: pa.float64() for f in FEATURES})

    def make():
        of = Features(lexicon).of
        return lambda text, *kept: (*kept, *of(text or ""))
    return map_rows(docs.select("text", *keep), make, schema)


@dataclass
class ToxicityModel:
    lexicon: list[str]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    share: float

    def score(self, docs: DataFrame) -> DataFrame:
        """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
        rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        if self.trees is None:
            scored = rows.select("doc_id", F.lit(self.share).alias("score"))
        else:
            raw = _raw(self.trees, features(rows, self.lexicon))
            scored = self.calibration.transform(raw).select(
                "doc_id", F.least(F.greatest("calibrated", F.lit(0.0)), F.lit(1.0)).alias("score"))
        return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                             (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _assemble(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def _raw(trees: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    scored = trees.transform(_assemble(rows))
    return scored.withColumn("raw", vector_to_array("probability")[1])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> ToxicityModel:
    """Lexicon, trees and calibration from a bounded sample of the training rows."""
    marks = (labels.where("doc_id is not null and toxic is not null")
             .groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("bigint").alias("toxic"))
             .where(~held_out(F.col("doc_id"))))
    # At most max_rows pairs of numbers: small enough to broadcast.
    chosen = F.broadcast(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = materialize(texts.join(chosen, "doc_id"))
    lexicon = learn_lexicon(sample)
    rows = materialize(features(sample, lexicon, ("doc_id", "toxic")))
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("p")).first()
    share = float(n["p"] or 0) / max(n["n"], 1)
    # One fold of the training rows is left to the calibration.
    fold = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0
    both = lambda part: part.select("toxic").distinct().count() == 2
    if not both(rows.where(~fold)) or not both(rows.where(fold)):
        return ToxicityModel(lexicon, None, None, share)
    trees = GBTClassifier(labelCol="toxic", maxDepth=3, maxIter=20, stepSize=0.3, seed=7).fit(
        _assemble(rows.where(~fold).withColumn("toxic", F.col("toxic").cast("double"))))
    raw = _raw(trees, rows.where(fold)).select("raw", F.col("toxic").cast("double").alias("label"))
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(raw)
    return ToxicityModel(lexicon, trees, calibration, share)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return train(docs, table(spark, sf_dir, "labels")).score(docs)
