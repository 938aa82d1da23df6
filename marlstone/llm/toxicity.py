"""Operator 3: a toxicity classifier that is regularised by counterfactual sentences.

Features are the distinct words of a text, and the beginnings and ends of those words, so that
inflected forms of a word that was learnt count too. In labelled sentences that mention a group
of people, the mention is swapped for other groups and for none; the fit is charged for the
variance of the scores among these versions, so a mention by itself moves no score, while what
is said about the group still does. A plain sentence for each lexicon group is among them, so
the penalty holds on a corpus that mentions nobody.

A score is the logistic function of a bias plus the evidence of the distinct words. Language,
source, ids and labels are no inputs. Null, empty and blank texts get the score of the bias
alone. Very long texts and words are read whole, one row at a time. Repeated rows and ties get
equal scores; further columns are ignored; an empty table gives an empty table; without labels
the score of all texts is the share of toxic labels, or a half.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm._shared import resident, slices
from marlstone.llm.bpe import Memo
from marlstone.llm.linear import Model, choose_features, fit, held_out, labelled_sample

# Words for groups of people, by language, as they stand in ordinary sentences.
GROUPS = {
    "en": "women men girls boys muslims christians jews hindus buddhists atheists immigrants refugees foreigners gays lesbians transgender homosexuals africans asians europeans americans arabs mexicans blacks whites latinos elderly disabled deaf blind poor veterans",
    "fr": "femmes hommes filles garçons musulmans chrétiens juifs hindous bouddhistes athées immigrés réfugiés étrangers gays lesbiennes homosexuels africains asiatiques européens arabes noirs blancs handicapés sourds aveugles pauvres",
    "de": "frauen männer mädchen jungen muslime christen juden hindus buddhisten atheisten einwanderer flüchtlinge ausländer schwule lesben homosexuelle afrikaner asiaten europäer araber schwarze weiße behinderte gehörlose blinde arme",
    "es": "mujeres hombres niñas niños musulmanes cristianos judíos hindúes budistas ateos inmigrantes refugiados extranjeros gays lesbianas homosexuales africanos asiáticos europeos árabes negros blancos discapacitados sordos ciegos pobres",
}
GROUP_WORDS = {w: lang for lang, words in GROUPS.items() for w in words.split()}

WORDS = re.compile(r"\w+")
SENTENCES = re.compile(r"[^.!?\n]+")


def word_features(chunk: str) -> list[str]:
    """Features of one chunk of lower-cased text between white space."""
    out = []
    for w in WORDS.findall(chunk):
        out.append(f"w:{w}")
        out.extend(f"p:{w[:k]}" for k in (3, 4, 5, 6) if len(w) > k)
        out.extend(f"s:{w[-k:]}" for k in (4, 5) if len(w) > k)
    return out


def features(text: str) -> Counter:
    """How many distinct chunks of a text have each feature."""
    out: Counter = Counter()
    for chunk in set(text.lower().split()):
        out.update(set(word_features(chunk)))
    return out


def counterfactuals(sentence: str) -> list[str]:
    """A sentence that mentions groups: itself, without the mentions, and with each other group of the language."""
    words = sentence.lower().split()
    at = [i for i, w in enumerate(words) if w.strip(".,;:!?\"'()") in GROUP_WORDS]
    if not at:
        return []
    lang = GROUP_WORDS[words[at[0]].strip(".,;:!?\"'()")]
    versions = [" ".join(words), " ".join(w for i, w in enumerate(words) if i not in at)]
    for other in GROUPS[lang].split():
        versions.append(" ".join(other if i in at else w for i, w in enumerate(words)))
    return versions


def swapped_sentences(sample: DataFrame, most: int) -> list[list[Counter]]:
    """Feature counts of the versions of at most `most` labelled sentences that mention a group, and of one plain sentence for each language."""
    pattern = r"(?iu)\b(" + "|".join(sorted(GROUP_WORDS)) + r")\b"
    mentions = sample.where(F.col("text").rlike(pattern)).orderBy(F.xxhash64("text"), "text").limit(most)
    groups: list[list[Counter]] = [[features(f"x {w}") for w in words.split()] + [features("x")] for words in GROUPS.values()]
    for row in mentions.collect():
        for sentence in SENTENCES.findall(row["text"]):
            versions = counterfactuals(sentence)
            if versions:
                groups.append([features(v) for v in versions])
                break
    return groups


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows_per_class: int = 5_000, bytes_per_class: int = 256 << 20, max_features: int = 4_000, swaps: int = 200, swap_weight: float = 5.0, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most rows_per_class labelled rows of each class, or fewer where their texts exceed bytes_per_class; the held-out fifth is never read."""
    sample, counts = labelled_sample(docs, labels, label, rows_per_class, bytes_per_class, id_col, text_col)
    chosen = choose_features(sample, features, max_features, least_rows=2)
    return fit(sample, counts, features, chosen, l2=1.0, sure_z=6.5, ties=swapped_sentences(sample, swaps), tie_weight=swap_weight)


class Scorer:
    """Scores texts by the evidence of their distinct chunks, remembered by chunk."""

    def __init__(self, model: Model):
        self.bias, weights = model.bias, model.weights
        # sorted: a chunk's evidence is summed up in one order, whichever process does it
        self.evidence = Memo(lambda chunk: sum(weights[f] for f in sorted(set(word_features(chunk))) if f in weights), 100_000)

    def __call__(self, text: str | None) -> float:
        # fsum: the same set of words gives the same score in whatever order it is walked
        odds = self.bias + math.fsum(map(self.evidence.__getitem__, set((text or "").lower().split())))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row, from its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = resident(f"toxicity {model.key}", lambda: Scorer(model))
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(scorer, b.column(1).to_pylist()), pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = resident(f"toxicity {model.key}", lambda: Scorer(model))
        for b in slices(batches, text_col):
            yield b.filter(pa.array([scorer(t) < 0.5 for t in b.column(b.schema.get_field_index(text_col)).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
