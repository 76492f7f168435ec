"""Language identification, word first with backoff.

Known words score by their log frequency in each language; an unseen word is scored by the longest of its
character n-grams that are known, five characters first, then ever shorter ones. The tables come from a
bounded sample of labelled rows (SAMPLE, those with the least hash of their id), of which every word and n-gram
counts; so the model that goes to the executors is bounded by the sample's texts, not by the table. Every text is
then scored whole, however long. A word is a run of letters; numerals such as Roman ones or fractions are no letters.

A null or empty text, or one without a letter, is 'und' with score 0. With no labelled row at all every text is 'und',
and accepted() keeps none. An empty table gives no rows. Labels that are null are not learned from; of languages that
score the same the first by name is taken; rows keep their multiplicity; other columns are not looked at."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Labelled rows learned from, characters of the longest n-gram.
SAMPLE, LONGEST = 6000, 5
WORD = re.compile(r"[^\W\d_]+")
CACHE = 200_000


def words(text: str) -> list[str]:
    low = text.lower()
    found = WORD.findall(low)
    if low.isascii() or all(map(str.isalpha, found)):
        return found
    # \w takes in numerals that are no letters
    return [x for w in found for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def bounded(rows: DataFrame, doc_id: str, most: int) -> DataFrame:
    """The rows whose ids have the least hashes; most, a documented bound, is of ids, which alone are sorted and broadcast."""
    ids = rows.select(F.col(doc_id).alias("_picked")).where("_picked is not null").distinct()
    ids = ids.orderBy(F.xxhash64("_picked"), "_picked").limit(most)
    return rows.join(F.broadcast(ids), F.col(doc_id) == F.col("_picked"), "left_semi")


def learn(rows: DataFrame, lang: str = "lang", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> dict:
    """The model from a bounded sample of rows. Words are counted on the executors; the driver gets the different words
    of the sample with their counts."""
    ids = bounded(rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text")), "doc_id", sample)

    def count(batches):
        for b in batches:
            totals: dict[str, Counter] = {}
            for label, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                totals.setdefault(label, Counter()).update(words(t))
            flat = [(k, w, n) for k, c in totals.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    tasks = rows.sparkSession.sparkContext.defaultParallelism
    counts = ids.select("lang", "text").repartition(tasks).mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    got = counts.toArrow().sort_by([("lang", "ascending"), ("word", "ascending")])
    by_lang: dict[str, tuple[list[str], list[int]]] = {}
    for label, word, n in zip(*(got.column(i).to_pylist() for i in range(3))):
        held = by_lang.setdefault(label, ([], []))
        held[0].append(word)
        held[1].append(n)
    return fit(by_lang)


def fit(by_lang: dict[str, tuple[list[str], list[int]]]) -> dict:
    """by_lang: words and their counts. The model: langs; rows[0], the matrix row of each word, and rows[n], of each n-gram;
    matrix, log frequencies by language."""
    langs = sorted(by_lang)
    rows, parts, at = [], [], 0
    for n in range(LONGEST + 1):
        numbers: dict[str, int] = {}
        counts: list[list[int]] = []
        for k, lang in enumerate(langs):
            for w, m in zip(*by_lang[lang]):
                marked = f"<{w}>"
                for g in [w] if not n else {marked[i : i + n] for i in range(len(marked) + 1 - n)}:
                    if (number := numbers.get(g)) is None:
                        number = numbers[g] = len(counts)
                        counts.append([0] * len(langs))
                    counts[number][k] += m
        table = np.array(counts, dtype=np.float64).reshape(len(counts), len(langs))
        rows.append({g: number + at for g, number in numbers.items()})
        parts.append(np.log((table + 0.1) / np.maximum(table.sum(0), 1)).astype(np.float32))
        at += len(counts)
    return {"langs": langs, "rows": rows, "matrix": np.concatenate(parts)}


def word_score(model: dict, word: str) -> np.ndarray:
    """Log probability of a word by language; zero where nothing of it is known."""
    rows, matrix = model["rows"], model["matrix"]
    if (found := rows[0].get(word)) is not None:
        return matrix[found]
    marked = f"<{word}>"
    for n in range(min(LONGEST, len(marked)), 0, -1):
        known = rows[n]
        got = [known[g] for i in range(len(marked) - n + 1) if (g := marked[i : i + n]) in known]
        if got:
            return matrix[got].mean(axis=0)
    return np.zeros(len(model["langs"]), dtype=np.float32)


class Scorer:
    """Scores texts; unseen words are remembered up to CACHE of them, and scored anew beyond."""

    def __init__(self, model: dict):
        self.model, self.more, self.unseen = model, np.zeros((CACHE, len(model["langs"])), dtype=np.float32), {}

    def __call__(self, text: str | None) -> tuple[str, float]:
        langs = self.model["langs"]
        if not langs or text is None or not (found := words(text)):
            return "und", 0.0
        known, unseen, total = self.model["rows"][0], self.unseen, np.zeros(len(langs))
        rows, times, more_rows, more_times = [], [], [], []
        for w, m in Counter(found).items():
            if (k := known.get(w)) is not None:
                rows.append(k)
                times.append(m)
                continue
            if (k := unseen.get(w)) is None:
                score = word_score(self.model, w)
                if len(unseen) == CACHE:
                    total += m * score
                    continue
                k = unseen[w] = len(unseen)
                self.more[k] = score
            more_rows.append(k)
            more_times.append(m)
        if rows:
            total += np.array(times, dtype=np.float64) @ self.model["matrix"][rows]
        if more_rows:
            total += np.array(more_times, dtype=np.float64) @ self.more[more_rows]
        mean = total / math.sqrt(len(found))  # between a sum, which is always sure, and a mean, which never is
        p = np.exp(mean - mean.max())
        best = int(np.argmax(p))
        return langs[best], float(p[best] / p.sum())


def identify(docs: DataFrame, model: dict, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the columns pred and score (0 to 1) in place of any of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in (pred, score)]

    def run(batches):
        scorer = Scorer(shared.value)
        for b in batches:
            got = [scorer(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index(c)) for c in keep] + [pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], [*keep, pred, score]
            )

    schema = docs.select(*keep).schema.add(pred, "string").add(score, "double")
    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a row is in the fold that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def accepted(docs: DataFrame, lang: str = "lang", doc_id: str = "doc_id", text: str = "text", least: float = 0.35) -> DataFrame:
    """docs without those whose language is undetermined (all of them, if there is nothing to learn from) or less sure
    than least; columns stay as they were."""
    model = learn(docs.where(~held_out(F.col(doc_id))), lang, doc_id, text)
    a, b = fresh(docs, "_pred"), fresh(docs, "_score")
    return identify(docs, model, text, a, b).where((F.col(a) != "und") & (F.col(b) >= least)).select(*docs.columns)
