"""Toxicity scores that don't lean on whom a sentence mentions.

A logistic model over hashed words is fitted to labelled texts together with copies in which terms that name a group are
swapped for others; the squared change of score between text and copy is part of the loss.  What a group's name adds by
itself is thereby pressed out, so a neutral mention costs nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm import hashed
from lotwise.llm.common import kept_apart

#: Terms that name groups of people, by language; a term is swapped for the next of its row.
IDENTITY_TERMS = (
    ("women", "men", "christians", "muslims", "jews", "hindus", "atheists", "immigrants", "refugees", "gays", "lesbians", "disabled", "asians", "africans", "europeans"),
    ("femmes", "hommes", "chrétiens", "musulmans", "juifs", "immigrés", "réfugiés", "homosexuels", "handicapés", "africains", "européens"),
    ("frauen", "männer", "christen", "muslime", "juden", "einwanderer", "flüchtlinge", "schwule", "behinderte", "afrikaner", "europäer"),
    ("mujeres", "hombres", "cristianos", "musulmanes", "judíos", "inmigrantes", "refugiados", "homosexuales", "discapacitados", "africanos", "europeos"),
)


@dataclass
class Model:
    """Selected columns, their weights and the offset."""

    columns: np.ndarray
    weights: np.ndarray
    offset: float


def swaps(terms=IDENTITY_TERMS) -> dict[str, str]:
    """Each term's stand-in."""
    return {a: b for row in terms for a, b in zip(row, row[1:] + row[:1], strict=True)}


def swapped(text: str, terms=IDENTITY_TERMS) -> str:
    """The text with every identity term replaced by its stand-in, lower-cased as the features are; else unchanged."""
    table = swaps(terms)
    pattern = _any_of(tuple(table))
    return pattern.sub(lambda m: table[m[0]], text.lower()) if pattern.search(text.lower()) else text


@lru_cache(maxsize=4)
def _any_of(terms: tuple[str, ...]) -> re.Pattern:
    return re.compile(r"(?<![^\W\d_])(?:" + "|".join(sorted(map(re.escape, terms), key=len, reverse=True)) + r")(?![^\W\d_])")


def _columns(terms) -> frozenset[int]:
    return frozenset(c for t in swaps(terms) for c in hashed.columns_of_token(t))


def featured(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), terms=IDENTITY_TERMS) -> DataFrame:
    """Features of each text and, where it names a group, of its copy with the terms swapped, for :func:`fit` and :func:`score`."""
    return hashed.with_features(docs, False, keep, lambda t: swapped(t, terms), _columns(terms))


def fit(docs: DataFrame, labels: DataFrame, terms=IDENTITY_TERMS, penalty: float = 4.0, ridge: float = 0.2, rows: int = hashed.FIT_ROWS, silent: float = 0.05) -> Model:
    """Fit to the texts of ``docs`` (doc_id, text) that ``labels`` (doc_id, label) marks 0 or 1.

    ``docs`` may be a table made by :func:`featured`.  Other labels and null ids take no part and null texts are empty;
    with no rows, or one class only, the model gives its smoothed share.  Which columns count follows from all rows;
    weights from the ``rows`` rows of smallest hash.  A text that says nothing counts as one that isn't toxic, with
    ``silent`` of the weight of all rows; without it the offset, and so an empty text's score, would be whatever the lack
    of known harmless words suggests.
    """
    labelled = hashed.labelled_rows(docs if hashed.AT in docs.columns else featured(docs, terms=terms), labels.where(F.col("label").isin(0, 1)))
    columns = hashed.telling(labelled, 2, _columns(terms))
    at, y, second = hashed.fit_rows(labelled, columns, rows)
    x, x2, n = hashed.Rows(at, len(columns)), hashed.Rows(second, len(columns)), len(y)
    share = (y.sum() + 0.5) / (n + 1)
    if not n or y.min() == y.max():
        return Model(columns, np.zeros(len(columns)), float(np.log(share / (1 - share))))
    ridge = ridge / n

    def objective(v: np.ndarray) -> tuple[float, np.ndarray]:
        w, b = v[:-1], v[-1]
        s = x.times(w) + b
        gap = x2.times(w) + b - s
        loss = np.mean(np.logaddexp(0, s) - y * s) + penalty * np.mean(gap * gap) + ridge / 2 * (w @ w) + silent * np.logaddexp(0, b)
        off = hashed.sigmoid(s) - y
        g = x.back(off / n - 2 * penalty * gap / n) + x2.back(2 * penalty * gap / n) + ridge * w
        return float(loss), np.append(g, np.mean(off) + silent * hashed.sigmoid(b))

    v = hashed.minimise(objective, np.append(np.zeros(len(columns)), np.log(share / (1 - share))))
    return Model(columns, v[:-1], float(v[-1]))


@kept_apart(r"score|predicted|_raw")
def score(df: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``score`` (0 to 1) and ``predicted`` (1 from a half on) of each whole text.

    ``df`` has texts, or is a table made by :func:`featured`.  Null and empty texts get the score of a text without
    telling words.  A narrow pass: any number of rows, ties and repeated rows are each scored by their text alone.
    """
    raw = hashed.linear_scores(df, model.columns, model.weights[:, None], np.array([model.offset]), False, keep)
    s = 1 / (1 + F.exp(-F.col("_raw")[0]))
    return raw.select(*keep, s.alias("score"), (s >= 0.5).cast("int").alias("predicted"))
