"""Mixing to target weights with soft domain membership, in DataFrame operations only.

A naive Bayes classifier over binned text shape and learned words is fitted on labelled rows and
gives each document a posterior over the domains. Nonnegative rates, one a document, are then fitted
by projected gradient steps so that the expected tokens of each domain meet its target. A step needs
a handful of sums over all documents; the rate itself is an expression of the text, so no join or
shuffle of documents takes place.

The misfit's gradient by a document's rate is its tokens times its posteriors' product with the
domains' shortfalls, so whatever steps are taken move a rate along its posteriors: the sum of all
steps is one move a domain. Steps are scaled by the inverse of the document's tokens, so that long and
short documents of like posteriors keep like rates, and by the inverse of the domains' Gram matrix
over the documents that are free to move; the projection is applied to the sum (lazy projection). A
pass over the documents tries several lengths of a step and keeps the one that misses the targets
least; a step that helps nothing is never taken.
Words are runs of letters and digits; tokens are runs between white space (Java's class \\s).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Labelled rows that the classifier is fitted on at most: those whose ids hash lowest.
SAMPLE_ROWS = 6000
BINS = 8
#: Words a domain may contribute to the classifier.
WORDS = 24
LEAST_DOCS = 8
STEPS = 30
#: How much larger a grown total is than the least at which no domain has to shrink: what is added for one domain is in part of others.
GROWTH = 1.02
#: Lengths of a step that a pass tries.
LENGTHS = (1.0, 0.5, 0.2, 0.05, 0.01)
TOLERANCE = 1e-4


#: Signs and capitals whose share is a feature (fixed values).
SIGNS = "#$%&*+<=>@^~!?|\\/_ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """Words in lower case; an empty one may stand at either end."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def tokens_of(text: Column) -> Column:
    """The number of runs of characters that are not white space."""
    edges = text.rlike(r"^\s").cast("int") + F.substring(text, -1, 1).rlike(r"\s").cast("int")
    return F.when(text == "", 0).otherwise(F.size(F.split(text, r"\s+")) - edges).cast("long")


def shape(text: Column, words: Column, lexicon: dict[str, list[str]]) -> dict[str, Column]:
    """The classifier's features, each a whole number from 0 to 7; words: words_of(text)."""
    n = F.greatest(F.length(text), F.lit(1))

    def level(share: Column) -> Column:
        return F.least(F.lit(BINS - 1), F.floor(F.log2(1 + share * 128))).cast("int")

    out = {
        "signs": level((F.length(text) - F.length(F.translate(text, SIGNS, ""))) / n),
        "wide": level((F.octet_length(text) - F.length(text)) / n),
        "distinct": F.least(F.lit(BINS - 1), F.floor(F.size(F.array_distinct(words)) * BINS / F.size(words))).cast("int"),
    }
    for name, some in lexicon.items():
        if some:
            found = F.size(F.array_intersect(words, F.array(*[F.lit(x) for x in some])))
            out[f"words_{name}"] = F.least(F.lit(BINS - 1), found)
    return out


class Mixture:
    """A fitted mixture: posteriors and rates as columns of any table with the text."""

    def __init__(self, domains: list[str], words: dict, prior: list[float], table: dict[str, list[list[float]]], text: str):
        self.domains, self.words, self.prior, self.table, self.text = domains, words, prior, table, text
        self.move: list[float] = [0.0] * len(domains)
        self.least_rate = 0.0
        self.totals: dict[str, float] = {}
        self.converged = True
        self.targets: dict[str, float] = {}

    def posteriors(self, df: DataFrame) -> DataFrame:
        """Adds _tokens and _p, the posteriors in the order of the domains (null texts count as empty).

        Lookups and sums are higher-order functions, so the expressions stay small however many
        features, domains and steps there are, and each is evaluated once.
        """
        text = F.coalesce(F.col("text"), F.lit(""))
        known = sorted({w for some in self.words.values() for w in some})
        words = F.col("_w")
        bins = {**shape(text, words, {}), **{k: v for k, v in shape(text, F.col("_l"), self.words).items() if k.startswith("words_")}}
        number = F.sequence(F.lit(0), F.lit(len(bins) - 1))
        tables = [F.array(*[F.array(*[F.lit(x) for x in self.table[name][i]]) for name in bins]) for i in range(len(self.domains))]

        def scores(f: Column) -> Column:
            def one(i: int) -> Column:
                return F.aggregate(number, F.lit(self.prior[i]), lambda total, j: total + F.get(F.get(tables[i], j), F.get(f, j)))

            return F.array(*[one(i) for i in range(len(self.domains))])

        def softmax(s: Column) -> Column:
            return F.transform(s, lambda x: 1 / F.aggregate(s, F.lit(0.0), lambda total, y: total + F.exp(y - x)))

        # The few learned words of a text are picked out once, and then told apart by domain.
        df = df.withColumn("_w", words_of(text)).withColumn("_l", F.array_intersect(words, F.array(*[F.lit(w) for w in known]).cast("array<string>")))
        df = df.withColumns({"_tokens": tokens_of(text), "_f": F.array(*bins.values())}).drop("_w", "_l")
        return df.withColumn("_s", scores(F.col("_f"))).withColumn("_p", softmax(F.col("_s"))).drop("_f", "_s")

    def rate(self, move: list[float] | None = None) -> Column:
        """1 moved along the posteriors, and projected to the least rate or more."""
        moved = sum((F.lit(float(x)) * F.get(F.col("_p"), F.lit(i)) for i, x in enumerate(self.move if move is None else move)), F.lit(1.0))
        return F.greatest(F.lit(self.least_rate), moved)


def fit_classifier(docs: DataFrame, labelled: DataFrame, domain: Column, domains: list[str], id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> Mixture:
    """Naive Bayes of `domain` (a column over `labelled`) on at most sample_rows labelled documents."""
    some = labelled.select(F.col(id).alias("_id"), domain.alias("_domain")).where(F.col("_domain").isin(domains) & F.col("_id").isNotNull())
    some = some.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    value = F.coalesce(F.col(text), F.lit(""))
    rows = written(docs.select(F.col(id).alias("doc_id"), value.alias("_text")).join(F.broadcast(some), F.col("doc_id") == F.col("_id")).select("_domain", "_text"), "labelled")
    sizes = {r["_domain"]: r["n"] for r in rows.groupBy("_domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    every = sum(sizes.values())

    word = rows.select("_domain", F.explode(F.array_distinct(words_of(F.col("_text")))).alias("w"))
    seen = word.groupBy("w").agg(F.count(F.lit(1)).alias("n"), *[F.sum((F.col("_domain") == d).cast("int")).alias(f"n{i}") for i, d in enumerate(domains)])
    words: dict[str, list[str]] = {}
    for i, d in enumerate(domains):
        inside, outside = sizes.get(d, 0), every - sizes.get(d, 0)
        lift = (F.col(f"n{i}") + 0.5) / (inside + 1.0) / ((F.col("n") - F.col(f"n{i}") + 0.5) / (outside + 1.0))
        top = seen.where((F.col(f"n{i}") >= LEAST_DOCS) & (lift >= 8)).orderBy((F.col(f"n{i}") * F.log(lift)).desc(), "w").limit(WORDS)
        words[d] = [r["w"] for r in top.collect()]

    features = shape(F.col("_text"), words_of(F.col("_text")), words)
    binned = rows.select("_domain", F.explode(F.array(*[F.struct(F.lit(k).alias("f"), v.alias("b")) for k, v in features.items()])).alias("x"))
    counts = {(r["_domain"], r["f"], r["b"]): r["n"] for r in binned.groupBy("_domain", "x.f", "x.b").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = {k: [[math.log((counts.get((d, k, b), 0) + 0.5) / (sizes.get(d, 0) + 0.5 * BINS)) for b in range(BINS)] for d in domains] for k in features}
    prior = [math.log((sizes.get(d, 0) + 0.5) / (every + 0.5 * len(domains))) for d in domains]
    return Mixture(domains, words, prior, table, text)


def scored(model: Mixture, docs: DataFrame, whole: bool = True, id: str = "doc_id") -> DataFrame:
    """A table written once for all steps: doc_id, _draw, _tokens, _p, and with whole=True the rows in a struct, doc.

    _draw is a number from 0 to 1 by the id and the text, so rows differ in it unless both are equal.
    """
    kept = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if whole else []
    narrow = docs.select(*kept, F.col(id).alias("doc_id"), F.col(model.text).alias("text"))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit("mix")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return written(model.posteriors(narrow.withColumn("_draw", draw)).drop("text"), "scored")


def fit_rates(model: Mixture, rows: DataFrame, weights: dict[str, float], least_rate: float = 0.0, grow: bool = False, steps: int = STEPS) -> Mixture:
    """Fits rates of at least `least_rate` (0: nonnegative) over all rows of the table that scored() wrote.

    Targets are `weights` of the documents' tokens, or with grow=True of a total a little above the
    least at which no domain has to shrink. A domain without documents keeps its shortfall. model.converged says
    whether every domain came within TOLERANCE of all tokens of its target.
    """
    k = len(model.domains)
    part = [F.get(F.col("_p"), F.lit(i)) for i in range(k)]
    share = [weights.get(d, 0.0) / sum(weights.values()) for d in model.domains]
    model.least_rate, model.move, model.converged = least_rate, [0.0] * k, True

    def tried(moves: list[list[float]], all_free: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
        """(tokens by domain, Gram matrix of the documents above the least rate) for each move, in one pass."""
        sums = []
        for n, move in enumerate(moves):
            rate = model.rate(move)
            free = F.col("_tokens") if all_free else F.when(rate > least_rate, F.col("_tokens")).otherwise(0)
            sums += [F.sum(F.col("_tokens") * rate * part[i]).alias(f"c{n}_{i}") for i in range(k)]
            sums += [F.sum(free * part[i] * part[j]).alias(f"g{n}_{i}_{j}") for i in range(k) for j in range(i, k)]
        got = rows.agg(*sums).first()
        gram = [np.array([[got[f"g{n}_{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)]) for n in range(len(moves))]
        return [(np.array([got[f"c{n}_{i}"] or 0.0 for i in range(k)]), gram[n]) for n in range(len(moves))]

    # No rate is above the least one before the first step if that is 1, so the first step takes all documents.
    have, gram = tried([model.move], all_free=True)[0]
    total = GROWTH * max((have[i] / share[i] for i in range(k) if share[i] > 0), default=0.0) if grow else float(have.sum())
    aim = np.array([total * x for x in share])
    for _ in range(steps):
        miss = aim - have
        if np.abs(miss).max() <= TOLERANCE * total:
            break
        root = np.sqrt(np.maximum(np.diag(gram), 1e-9 * total))
        step = np.linalg.pinv(gram / np.outer(root, root), rcond=1e-9) @ (miss / root) / root
        moves = [(np.array(model.move) + x * step).tolist() for x in LENGTHS]
        found = tried(moves)
        best = min(range(len(moves)), key=lambda n: float(np.linalg.norm(aim - found[n][0])))
        if np.linalg.norm(aim - found[best][0]) >= np.linalg.norm(miss):
            break
        model.move, (have, gram) = moves[best], found[best]
    model.converged = bool(np.abs(aim - have).max() <= TOLERANCE * total)
    model.totals, model.targets = dict(zip(model.domains, have.tolist())), dict(zip(model.domains, aim.tolist()))
    return model


def rates(model: Mixture, rows: DataFrame) -> DataFrame:
    """doc_id, tokens, p_<domain> ..., rate, converged for every row of the table that scored() wrote."""
    named = [F.get(F.col("_p"), F.lit(i)).alias(f"p_{d}") for i, d in enumerate(model.domains)]
    return rows.select("doc_id", F.col("_tokens").alias("tokens"), *named, model.rate().alias("rate"), F.lit(model.converged).alias("converged"))


def realised(model: Mixture, rows: DataFrame) -> DataFrame:
    """The documents repeated by their rates: the whole part, and one more by their draw for the rest.

    rows is the table that scored() wrote with whole=True.
    """
    copies = F.floor(model.rate() + F.col("_draw")).cast("int")
    # An outer explode keeps the optimizer from copying the whole expression into a filter below it.
    return rows.withColumn("_copy", F.explode_outer(F.array_repeat(F.lit(1), copies))).where(F.col("_copy").isNotNull()).select("doc.*")


def by_label() -> Column:
    """The labels table's domains: low, toxic, clean."""
    return F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean")


def by_quality() -> Column:
    return F.when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "high")
