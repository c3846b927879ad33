"""Toxicity after noisy-channel deobfuscation.

Spans that look altered (digits or signs inside words, letters set apart, long repetitions) become
character lattices; a Viterbi search under a character trigram model restores the likeliest letters.
The restored text is scored by a logistic model over words and word beginnings learned from labels;
a beginning counts again when two, and when three, different words of a document have it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, arrow_map, claim, held_out, slices, strings, written

#: Labelled rows of each class that the model is fitted on at most: those whose ids hash lowest.
SAMPLE_ROWS = 3000
#: Words and beginnings that the classifier has at most: those of the sample that tell most.
FEATURES = 1000
LEAST_DOCS, LEAST_LIFT = 4, 4.0
PREFIXES = (3, 4, 5, 6, 7)
#: A feature counts again where so many different words of a document have it.
LEVELS = (2, 3)
#: Letters that a sign may stand for (fixed values).
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t"}
#: Costs of the channel, in nats: a sign for a letter, a sign as itself, a separator inside a word, a repeated letter, a star for any letter.
SIGN, SELF, GAP, REPEAT, MASK = 0.7, 4.0, 0.5, 0.5, 1.5
#: Stars in a row that mask letters; a longer row is a ruled line.
MASKS = re.compile(r"(?<!\*)\*{1,4}(?!\*)")
#: How often each learned word counts in the character model.
LEXICON_WEIGHT = 40
_L, _S = "a-zà-öø-ÿœ", "0-9@$!|+"
_G = r"\s._*/-"
#: Letters set apart, three at least, or a run with signs or separators between letters, signs before or after letters, or a letter three times.
SUSPECT = re.compile(
    rf"(?<![{_L}{_S}])[{_L}{_S}](?:[{_G}]+[{_L}{_S}]){{2,}}(?![._*/-]*[{_L}{_S}])"
    rf"|(?<![{_L}{_S}._*-])[{_L}{_S}._*-]*(?:[{_L}][{_S}._*-]+[{_L}]|(?<![{_L}{_S}])[{_S}]+[{_L}]{{2}}|[{_L}][{_S}]+(?![{_L}{_S}])|([{_L}])\1\1)[{_L}{_S}._*-]*"
)
#: Found in whatever holds a suspect span: a sign beside a letter, separators between, a letter three times, letters set apart.
QUICK = re.compile(rf"[{_L}][{_S}]|[{_S}][{_L}]|[{_L}][._*-]+[{_L}{_S}]|([{_L}])\1\1|[{_L}{_S}][{_G}]+[{_L}{_S}][{_G}]+[{_L}{_S}]")
WORD = re.compile(r"[^\W\d_]{2,}")
EDGE = "^"
#: In trigrams, one character for every letter that no span can hold, so that their number has a bound that no corpus passes.
OTHER, FOREIGN = "?", re.compile(rf"[^{_L}]")
#: Characters of the longest span whose restoration is remembered; longer ones are decoded each time.
MEMO_SPAN = 64
#: Words that a task counts before it turns them into trigrams.
WORDS_AT_ONCE = 300_000


def trigrams(words) -> Counter:
    """Counts of three characters in a row, with two edges before a word and one after it."""
    out: Counter = Counter()
    for word, n in words.items():
        chars = EDGE * 2 + FOREIGN.sub(OTHER, word) + EDGE
        for i in range(len(chars) - 2):
            out[chars[i : i + 3]] += n
    return out


def spelled(chain: tuple | None) -> str:
    """The text of a path."""
    out = []
    while chain:
        chain, text = chain
        out.append(text)
    return "".join(reversed(out))


class Channel:
    """Restores the letters of altered spans."""

    def __init__(self, counts: dict[str, int]):
        pairs: Counter = Counter()
        for gram, n in counts.items():
            pairs[gram[:2]] += n
        self.counts, self.pairs = dict(counts), dict(pairs)
        #: The letters that the model has seen after two characters: what a star between letters can stand for.
        self.follow: dict[str, str] = {}
        for gram in sorted(counts):
            if gram[2] not in EDGE + OTHER:
                self.follow[gram[:2]] = self.follow.get(gram[:2], "") + gram[2]
        self.letters = len({g[2] for g in counts}) + 1
        self.costs = Memo(lambda gram: self.cost(gram[:2], gram[2]))
        self.memo = Memo(self._decode)

    def cost(self, state: str, char: str) -> float:
        """Of a character after two others: its negative log-likelihood, smoothed."""
        return -math.log((self.counts.get(state + char, 0) + 0.1) / (self.pairs.get(state, 0) + 0.1 * self.letters))

    def _decode(self, span: str) -> str:
        # A path is its cost and a chain of (chain before, text), which paths share.
        cost_of, paths, before = self.costs.__getitem__, {EDGE * 2: (0.0, None)}, ""
        masks = {i for m in MASKS.finditer(span) for i in range(*m.span())}
        for at, char in enumerate(span):
            further: dict[str, tuple[float, tuple | None]] = {}

            def reach(state: str, cost: float, chain: tuple | None, text: str = "") -> None:
                if state not in further or cost < further[state][0]:
                    further[state] = (cost, (chain, text) if text else chain)

            for state, (cost, chain) in paths.items():
                if char in SIGNS:
                    for letter in SIGNS[char]:
                        reach(state[1] + letter, cost + SIGN + cost_of(state + letter), chain, letter)
                        if char == before and state[1] == letter:
                            reach(state, cost + REPEAT, chain)
                    closed = 0.0 if state == EDGE * 2 else cost_of(state + EDGE)
                    # A sign that stands for itself again, as in "!!!", costs no more than a repetition.
                    reach(EDGE * 2, cost + (REPEAT if char == before and state == EDGE * 2 else SELF) + closed, chain, char)
                elif char.isalpha():
                    reach(state[1] + char, cost + cost_of(state + char), chain, char)
                    if char == before and state[1] == char:
                        reach(state, cost + REPEAT, chain)
                else:
                    if at in masks:
                        for letter in self.follow.get(state, ""):
                            reach(state[1] + letter, cost + MASK + cost_of(state + letter), chain, letter)
                    reach(state, cost + GAP, chain)
                    closed = 0.0 if state == EDGE * 2 else cost_of(state + EDGE)
                    reach(EDGE * 2, cost + GAP + closed, chain, char)
            paths, before = further, char
        ends = [(cost + (0.0 if state == EDGE * 2 else cost_of(state + EDGE)), chain) for state, (cost, chain) in paths.items()]
        least = min(cost for cost, _ in ends)
        return min(spelled(chain) for cost, chain in ends if cost == least)

    def _restored(self, match: re.Match) -> str:
        span = match.group()
        return self.memo[span] if len(span) <= MEMO_SPAN else self._decode(span)

    def restore(self, text: str) -> str:
        """The text in lower case with altered spans restored."""
        text = text.lower()
        if not QUICK.search(text):
            return text
        return SUSPECT.sub(self._restored, text)


def features_of(word: str) -> list[str]:
    return [word, *[EDGE + word[:k] for k in PREFIXES if len(word) > k]]


def graded(features: Iterable[str]) -> set[str]:
    """The features of a document's different words, and each again at the levels that it reaches."""
    n = Counter(features)
    return set(n) | {f"{f}#{k}" for f, c in n.items() if c > 1 for k in LEVELS if c >= k}


class Model:
    """What scoring needs: the channel, learned features with weights, and a bias."""

    def __init__(self, counts: dict[str, int], weights: dict[str, float], bias: float):
        self.counts, self.weights, self.bias = counts, weights, bias

    def ready(self) -> Model:
        self.channel = Channel(self.counts)
        known = {f.partition("#")[0] for f in self.weights}
        self.hits = Memo(lambda w: tuple(f for f in features_of(w) if f in known), 128 << 20)
        return self

    def found(self, text: str) -> set[str]:
        words = set(WORD.findall(self.channel.restore(text)))
        hits = filter(None, map(self.hits.__getitem__, words))
        return {f for f in graded(f for fs in hits for f in fs) if f in self.weights}

    def score(self, text: str) -> float:
        z = self.bias + sum(self.weights[f] for f in sorted(self.found(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.3, rounds: int = 50) -> tuple[np.ndarray, float]:
    """The least penalised log-loss, by Newton steps halved until they lessen it; the bias is not penalised."""
    x = np.hstack([x, np.ones((len(y), 1))]).astype(float)
    v, penalty = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, l2), 1e-6)

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.logaddexp(0, z).sum() - y @ z + (penalty * v * v).sum() / 2)

    least = loss(v)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * v)
        step = 1.0
        while (further := loss(v - step * move)) > least and step > 1e-6:
            step /= 2
        if least - further < 1e-9 * len(y):
            break
        v, least = v - step * move, further
    return v[:-1], float(v[-1])


def corpus_trigrams(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """Counts of the trigrams of the words of all documents; each task sums its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        found: Counter = Counter()
        grams: Counter = Counter()
        for batch in batches:
            for part in slices(batch):
                for x in strings(part, "text"):
                    found.update(WORD.findall(x.lower()))
                    if len(found) > WORDS_AT_ONCE:
                        grams.update(trigrams(found))
                        found.clear()
        grams.update(trigrams(found))
        yield pa.record_batch([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["name", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(count, "name string, n long")
    return {r["name"]: r["n"] for r in rows.groupBy("name").agg(F.sum("n").alias("n")).orderBy("name").collect()}


def fit(docs: DataFrame, labelled: DataFrame, label: str = "toxic", id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns words and weights from labelled rows that are not held out, at most sample_rows of each
    class, and the character model from the texts of all documents.

    Without labels of both classes the score is the share of label 1 everywhere (none: 0).
    """
    known = labelled.select(F.col(id).alias("_id"), F.col(label).cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col(id)))
    sizes = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    picked = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample_rows) for y in (0, 1)]
    sample = written(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(picked[0].union(picked[1])), F.col("doc_id") == F.col("_id")).select("_y", "text"), "labelled")
    n = {r["_y"]: r["count"] for r in sample.groupBy("_y").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        share = sizes.get(1, 0) / (sum(sizes.values()) + 1)
        return Model({}, {}, math.log(max(share, 1e-9) / (1 - share)))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for part in slices(batch):
                for y, x in zip(part.column(0).to_pylist(), strings(part, "text")):
                    seen[y].update(graded(f for w in set(WORD.findall(x.lower())) for f in features_of(w)))
        for kind, some in seen.items():
            keys = list(some)
            for at in range(0, len(keys), 50_000):
                part = keys[at : at + 50_000]
                yield pa.record_batch([pa.array([kind] * len(part), pa.int32()), pa.array(part), pa.array([some[k] for k in part], pa.int64())], ["kind", "name", "n"])

    counted = written(sample.mapInArrow(words, "kind int, name string, n long").groupBy("kind", "name").agg(F.sum("n").alias("n")), "counted")
    grams = corpus_trigrams(docs, text)
    both = counted.groupBy("name").agg(F.sum(F.when(F.col("kind") == 0, F.col("n")).otherwise(0)).alias("n0"), F.sum(F.when(F.col("kind") == 1, F.col("n")).otherwise(0)).alias("n1"))
    lift = (F.col("n1") + 0.5) / (n1 + 1) / ((F.col("n0") + 0.5) / (n0 + 1))
    top = both.where((F.col("n1") >= LEAST_DOCS) & (lift >= LEAST_LIFT)).orderBy((F.col("n1") * F.log(lift)).desc(), "name").limit(FEATURES)
    names = [r["name"] for r in top.collect()]
    total = sum(grams.values())
    lexicon = trigrams({w: LEXICON_WEIGHT + total // 20_000 for w in names if w.isalpha()})
    grams = dict(Counter(grams) + lexicon)
    place = {f: i for i, f in enumerate(names)}

    def rows():
        model = Model(grams, dict.fromkeys(names, 0.0), 0.0).ready()
        return lambda batch: pa.record_batch([batch.column(0), pa.array([sorted(place[f] for f in model.found(x)) for x in strings(batch, "text")], pa.list_(pa.int32()))], ["y", "f"])

    table = arrow_map(sample, rows, "y int, f array<int>").toArrow()
    y = table["y"].to_numpy().astype(float)
    x = np.zeros((len(y), len(names)), np.float32)
    for i, f in enumerate(table["f"].to_pylist()):
        x[i, f] = 1
    order = np.lexsort((x @ np.arange(len(names)), y))
    w, b = _fit_logistic(x[order], y[order])
    # The sample holds the classes in other shares than the labels do.
    b += math.log(sizes[1] / sizes[0]) - math.log(n1 / n0)
    return Model(grams, {f: float(v) for f, v in zip(names, w)}, float(b))


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row; null texts count as empty."""

    def make():
        ready = model.ready()
        return lambda batch: pa.record_batch([*batch.select(["doc_id", "held_out"]).columns, pa.array([ready.score(x) for x in strings(batch, "text")])], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), held_out(F.col(id)).alias("held_out"), F.col(text).alias("text"))
    return arrow_map(rows, make, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents that score below 0.5, with all their columns; no shuffle takes place."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def make():
        ready = model.ready()
        return lambda batch: batch.filter(pa.array([ready.score(x) < 0.5 for x in strings(batch, text)], pa.bool_()))

    return arrow_map(docs, make, schema)
