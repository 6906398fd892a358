"""Toxicity by a weighted lexicon, learnt from labels and matched by Aho-Corasick.

Texts are folded first: lower case, look-alike letters of other scripts to Latin ones,
digits and signs that stand for letters to those letters. The lexicon holds whole words
(both ends at a boundary) and stems (the start at a boundary), each with the log odds of
being met in a toxic text. A match inside an exception phrase doesn't count. A text's
weight, the sum over its matches, is divided by the logarithm of its length in words, and
a logistic curve turns it into a score.

An entry's evidence is judged against the labels there are: chance alone, at the toxic share
of the rows learnt from, would give it as many toxic ones with a probability of LEAST_CHANCE
at most (a Chernoff bound, exact if all of its texts are toxic), and LEAST_TOXIC toxic texts
hold it at least.

Learning uses at most `sample` labelled rows (a parameter; of each label those of least hash),
whatever the corpus' size: all toxic ones up to half of them, or more if clean ones are few.
Shares and the curve's offset are set right for rows left out. Entries are counted in Spark,
and those with evidence come to the driver: no more than LEAST_TOXIC-th of the words and stems of
the sample's toxic texts. Scoring reads every text whole.

Cases: null and empty texts score as a text without matches; without any toxic label the
lexicon is empty and every score is 0; labels of one doc_id that differ count as toxic;
label rows with null fields are not used; repeated rows score alike; an empty table gives
no rows; lang, source, labels and doc_id take no part in a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivalent.llm.shared import batch_rows, release_memory, text_or_empty

# Characters that are drawn like, or stand for, Latin letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s",
}
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "pathetic fallacy", "stupid question", "idiot proof", "sore loser")
FOLD = {ord(a): b for a, b in LOOKALIKES.items()} | {0xFF41 + i: chr(97 + i) for i in range(26)} | {0x200B: None, 0x200D: None, 0xAD: None}
WORD = re.compile(r"[^\W\d_]+")
STEMS = range(4, 9)
LEAST_TOXIC, LEAST_SHARE, LEAST_CHANCE = 3, 0.85, 0.005
#: Entries that a task counts before it sends them on.
HELD = 500_000


def fold(text: str) -> str:
    return text.lower().translate(FOLD)


def entries_of(text: str) -> set[str]:
    """Lexicon entries that a text would match: whole words end in $, stems don't."""
    words = set(WORD.findall(fold(text)))
    return {w + "$" for w in words if len(w) >= 3} | {w[:n] for w in words for n in STEMS if len(w) > n}


@dataclass
class Model:
    weights: dict[str, float]
    slope: float = 0.0
    offset: float = -math.inf

    def matcher(self) -> Matcher:
        return Matcher(self)


class Matcher:
    def __init__(self, model: Model):
        self.model, self.automaton = model, ahocorasick.Automaton()
        by_text: dict[str, list[tuple[bool, float]]] = {}
        for entry, weight in model.weights.items():
            by_text.setdefault(entry.rstrip("$"), []).append((entry.endswith("$"), weight))
        for text, ends in by_text.items():
            self.automaton.add_word(text, (len(text), ends))
        if by_text:
            self.automaton.make_automaton()
        self.exceptions = re.compile("|".join(map(re.escape, EXCEPTIONS)))

    def weight(self, text: str) -> float:
        """Matched weight over the logarithm of the length."""
        if not self.model.weights or not text:
            return 0.0
        folded, total, spans = fold(text), 0.0, None
        for last, (size, ends) in self.automaton.iter(folded):
            start = last - size + 1
            if start and folded[start - 1].isalpha():
                continue
            closed = last + 1 == len(folded) or not folded[last + 1].isalpha()
            found = sum(w for whole, w in ends if closed or not whole)
            if found:
                if spans is None:
                    spans = [m.span() for m in self.exceptions.finditer(folded)]
                if not any(a <= start and last < b for a, b in spans):
                    total += found
        return total / math.log2(1 + sum(1 for _ in WORD.finditer(folded))) if total else 0.0

    def score(self, weight: float) -> float:
        if self.model.offset == -math.inf:
            return 0.0
        return 1 / (1 + math.exp(-min(40.0, max(-40.0, self.model.slope * weight + self.model.offset))))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, float, float]:
    """text, toxic of at most `sample` rows whose crc32(doc_id) mod 5 is not 0, and how many labels a toxic and a clean one of them stand for."""
    usable = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    fold = usable.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    # Two rows come to the driver.
    numbers = {bool(r["toxic"]): r["count"] for r in fold.groupBy((F.col("toxic") != 0).alias("toxic")).count().collect()}
    toxic, clean = numbers.get(True, 0), numbers.get(False, 0)
    some = min(toxic, max(sample // 2, sample - clean))
    rest = min(clean, sample - some)
    first, second = (fold.where(which).orderBy(F.xxhash64("doc_id"), "doc_id").limit(number) for which, number in ((F.col("toxic") != 0, some), (F.col("toxic") == 0, rest)))
    chosen = first.unionAll(second)
    # At most `sample` rows of two numbers are broadcast.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    return rows, toxic / max(1, some), clean / max(1, rest)


def learn(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> Model:
    rows, per_toxic, per_clean = labelled_sample(docs, labels, sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, all_ = Counter(), Counter()

        def counted() -> Iterator[pa.RecordBatch]:
            names = list(all_)
            for at in range(0, len(names), 50_000):
                part = names[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([toxic[e] for e in part], pa.int64()), pa.array([all_[e] for e in part], pa.int64())], ["entry", "toxic", "total"])
            toxic.clear(), all_.clear()

        for whole in batches:
            for batch in batch_rows(whole, "text"):
                for text, label in zip(text_or_empty(batch.column("text")), batch.column("toxic").to_pylist()):
                    found = entries_of(text)
                    all_.update(found)
                    if label:
                        toxic.update(found)
                if len(all_) > HELD:
                    yield from counted()
        yield from counted()
        release_memory()

    totals = rows.groupBy().agg(F.sum("toxic").alias("toxic"), F.count("*").alias("total")).first()
    if not totals["toxic"]:
        return Model({})
    counted = rows.mapInArrow(count, "entry string, toxic long, total long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("total").alias("total"))
    base = totals["toxic"] / totals["total"]
    share, standing, others = F.col("toxic") / F.col("total"), F.col("toxic") * per_toxic, (F.col("total") - F.col("toxic")) * per_clean
    divergence = share * F.log(share / base) + F.when(share < 1, (1 - share) * F.log((1 - share) / max(1 - base, 1e-300))).otherwise(0.0)
    unlikely = (share > base) & (F.col("total") * divergence >= -math.log(LEAST_CHANCE))
    telling = counted.where((F.col("toxic") >= LEAST_TOXIC) & (standing >= LEAST_SHARE * (standing + others)) & unlikely).select("entry", "toxic", "total").collect()
    weights: dict[str, float] = {}
    clean = totals["total"] - totals["toxic"]
    for row in sorted(telling, key=lambda r: (len(r["entry"].rstrip("$")), r["entry"])):
        entry = row["entry"]
        if not any(entry[:n] in weights for n in range(min(STEMS), len(entry))):  # a stem already covers it
            weights[entry] = math.log((row["toxic"] + 0.5) / (totals["toxic"] + 1)) - math.log((row["total"] - row["toxic"] + 0.5) / (clean + 1))
    model = Model(weights)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for batch in (part for whole in batches for part in batch_rows(whole, "text")):
            yield pa.RecordBatch.from_arrays([pa.array([matcher.weight(t) for t in text_or_empty(batch.column("text"))], pa.float64()), batch.column("toxic")], ["weight", "toxic"])

    # Two numbers for each of at most `sample` rows.
    pairs = rows.mapInArrow(weigh, "weight double, toxic int").toPandas()
    model.slope, model.offset = logistic(pairs["weight"].to_numpy(), pairs["toxic"].to_numpy(float))
    if clean:
        model.offset += math.log(per_toxic / per_clean)
    return model


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton's method, the slope lightly penalised."""
    design, beta = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) - penalty * beta * [1, 0]
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag([penalty, 1e-6])
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(beta[0]), 0.0), float(beta[1])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for whole in batches:
            for batch in batch_rows(whole, "text"):
                scores = [matcher.score(matcher.weight(t)) for t in text_or_empty(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores below least, all columns as they are."""
    text, schema = docs.columns.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for whole in batches:
            for batch in batch_rows(whole, text):
                yield batch.filter(pa.array([matcher.score(matcher.weight(t)) < least for t in text_or_empty(batch.column(text))], pa.bool_()))
        release_memory()

    return docs.mapInArrow(run, schema)
