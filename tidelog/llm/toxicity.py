"""Toxicity by weak supervision.

Voters: each word of a fixed lexicon, word stems that occur mostly in texts labelled toxic, and patterns
(several insults, insults addressed to someone, dense insults, shouting, no insult at all). A generative label
model over all voters estimates, by expectation maximisation, how often each votes in either class and which voters
are correlated beyond what the class explains: given the class the votes form a tree (the spanning tree of greatest
conditional mutual information, found anew in each round), and a vote's rates depend on the class and on the vote of its
parent in the tree. The given labels are one more noisy voter with fixed accuracy. A linear classifier
(logistic regression, numpy) is trained on the model's posterior labels.

At most ``rows`` labelled documents and ``SAMPLE_BYTES`` of their text outside the held-out fold are used for fitting (a
bounded, documented sample); every whole text is scored. Letters are folded to lower case one by one, so places stay
(the dotted capital I counts as i). Null texts count as empty; texts without any sign of toxicity all get
the score of the classifier's base. Without labelled rows, or with one class only, the fixed lexicon and patterns decide
alone. Repeated rows get equal scores; an empty table gives an empty table; other columns are never read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, map_rows, remove, whole_text

ROWS, MIN_DOCS, MIN_SHARE, PRECISION, GOLD_TRUST = 6000, 4, 0.005, 0.7, 0.99
STEMS = range(3, 13)  # letters of a stem
WORD = re.compile(r"[^\W\d_]{3,}")
# The lexicon.
LEXICON = """idiot idiots moron morons stupid clown clowns scum trash garbage worthless pathetic disgusting loser losers
dumb fool fools imbecile vermin filth filthy freak pig pigs parasite parasites liar coward cretin degenerate
hate despise kill die ugly crap shit fuck fucking bitch bastard asshole damn retard retarded
idiota estúpido basura imbécil asqueroso mierda cabrón dumm idioten dreck abschaum ekelhaft scheiße arschloch
idiote stupide ordure connard merde salaud dégoûtant crétin""".split()
PATTERNS = ("two", "four", "addressed", "dense", "shouted", "none")
# Words that address an insult, among the three words before it.
ADDRESS = set("you your du ihr tu vous usted they those these".split())


def fold(text: str) -> str:
    """Lower case with every letter at its place; only one capital has a longer lower case."""
    return text.replace("\u0130", "i").lower()


class Finder:
    """Hits of words, and of stems (marked by a trailing ``*``) at the start of words, found by one automaton."""

    def __init__(self, words: list[str]):
        import ahocorasick

        self.words = words
        self.machine = ahocorasick.Automaton()
        self.sizes = [len(w.rstrip("*")) for w in words]
        self.stem = [w.endswith("*") for w in words]
        at: dict[str, tuple[int, ...]] = {}
        for i, w in enumerate(words):
            at[w.rstrip("*")] = (*at.get(w.rstrip("*"), ()), i)
        for w, ids in at.items():
            self.machine.add_word(w, ids)
        self.machine.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, int]]:
        """(word, start, end) in the lower-cased text."""
        out, n = [], len(text)
        for end, ids in self.machine.iter(text):
            start = end + 1 - self.sizes[ids[0]]
            if start == 0 or not text[start - 1].isalnum():
                whole = end + 1 == n or not text[end + 1].isalnum()
                out += [(i, start, end + 1) for i in ids if whole or self.stem[i]]
        return out


def signals(text: str, finder: Finder) -> np.ndarray:
    """A vote in {0, 1} for each word and pattern, then log counts for the classifier."""
    low = fold(text)
    k = len(finder.words)
    out = np.zeros(k + len(PATTERNS) + 2, np.float32)
    hits = finder.hits(low)
    for i, _, _ in hits:
        out[i] = 1
    n = len(hits)
    words = text.count(" ") + text.count("\n") + 1
    out[k] = n >= 2
    out[k + 1] = n >= 4
    if hits:
        spoken = [(m.start(), m[0]) for m in re.finditer(r"\w+", low)]
        starts = [s for s, _ in spoken]
        before = (spoken[max(0, at - 3) : at] for at in (bisect_left(starts, s) for _, s, _ in hits))
        out[k + 2] = any(w in ADDRESS for part in before for _, w in part)
    out[k + 3] = n / words >= 0.01
    out[k + 4] = any(text[s:e].isupper() for _, s, e in hits)
    out[k + 5] = n == 0
    out[k + 6] = math.log1p(n)
    out[k + 7] = math.log1p(100 * n / words)
    return out


def copies_of(words: set[str]) -> str:
    """Near copies have equal least hashes of their words."""
    return ",".join(map(str, sorted(crc32(w.encode()) for w in words)[:2]))


def choose(counts: list[tuple[str, int, int]], texts: int) -> list[str]:
    """Stems to vote, from (stem, toxic texts, clean texts) over ``texts`` toxic ones: those of most texts first, and
    of stems that begin alike only the first. All that pass the thresholds vote; the label model weighs them."""
    least = max(MIN_DOCS, MIN_SHARE * texts)
    found: dict[str, None] = {}
    begun: set[str] = set()  # all beginnings of the stems found
    for _, _, stem in sorted((-a, -len(w), w) for w, a, b in counts if a >= least and a >= PRECISION * (a + b)):
        if stem not in begun and not any(stem[:k] in found for k in STEMS if k < len(stem)):
            found[stem] = None
            begun.update(stem[:k] for k in range(1, len(stem) + 1))
    return [f + "*" for f in found]


def induce(sample: DataFrame) -> list[str]:
    """Stems of the labelled sample (label, text). Near copies count once, so that a copied text doesn't lend its own
    words. Only stems that may pass come to the driver, which the sample's bytes bound."""

    def group_of():
        return lambda b: b | {"copies": [copies_of(set(WORD.findall(fold(t)))) for t in b["text"]]}

    def stems_of():
        def step(b):
            toxic, clean = Counter(), Counter()
            for label, text in zip(b["label"], b["text"]):
                (toxic if label else clean).update({w[:k] for w in WORD.findall(fold(text)) for k in STEMS if len(w) >= k})
            stems = list(toxic.keys() | clean.keys())
            return {"stem": stems, "toxic": [toxic[w] for w in stems], "clean": [clean[w] for w in stems]}

        return step

    grouped = map_rows(sample, ["doc_id", "label", "text"], "doc_id long, label int, text string, copies string", group_of)
    once = grouped.groupBy("label", "copies").agg(F.min(F.struct("doc_id", "text")).alias("r")).select("label", "r.text")
    counted = map_rows(once, ["label", "text"], "stem string, toxic long, clean long", stems_of).groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    texts = grouped.filter("label = 1").select("copies").distinct().count()
    return choose([tuple(r) for r in counted.filter((F.col("toxic") >= MIN_DOCS) & (F.col("toxic") >= PRECISION * (F.col("toxic") + F.col("clean")))).collect()], texts)


def vote_tree(votes: np.ndarray, belief: np.ndarray) -> np.ndarray:
    """Each voter's parent (-1: the root) in the spanning tree of greatest mutual information given the class."""
    n, k = votes.shape
    info = np.zeros((k, k))
    for w in (belief, 1 - belief):
        total = w.sum() + 2
        p = (votes.T @ w + 1) / total
        q = 1 - p
        both = (votes.T @ (votes * w[:, None]) + 0.5) / total
        left, right, none = (np.maximum(x, 1e-6) for x in (p[:, None] - both, p[None] - both, 1 - p[:, None] - p[None] + both))
        info += w.sum() / n * (both * np.log(both / np.outer(p, p)) + left * np.log(left / np.outer(p, q)) + right * np.log(right / np.outer(q, p)) + none * np.log(none / np.outer(q, q)))
    parent, via = np.full(k, -1), np.zeros(k, np.int64)
    inside = np.zeros(k, bool)
    inside[0] = True
    best = info[0].copy()
    for _ in range(k - 1):
        i = int(np.where(inside, -np.inf, best).argmax())
        inside[i], parent[i] = True, via[i]
        closer = info[i] > best
        best, via = np.where(closer, info[i], best), np.where(closer, i, via)
    return parent


def log_odds(votes: np.ndarray, belief: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Of the votes of each row in class 1 against class 0, by the rates that ``belief`` gives."""
    above = np.where(parent >= 0, votes[:, parent], 0)
    total = np.zeros(len(votes))
    for sign, w in ((1, belief), (-1, 1 - belief)):
        up, both, own, size = w @ above, w @ (above * votes), w @ votes, w.sum()
        alone = (own + 0.5) / (size + 1)  # the rate whatever the parent says, to which rare cases are drawn
        on, off = (both + 2 * alone) / (up + 2), (own - both + 2 * alone) / (size - up + 2)
        rate = np.where(above > 0, on, off)
        total += sign * (votes * np.log(rate) + (1 - votes) * np.log1p(-rate)).sum(1)
    return total


def label_model(votes: np.ndarray, gold: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Posterior of class 1 for each row. votes: rows x voters in {0, 1}; gold: labels, taken as one noisy voter."""
    prior = float(np.clip(gold.mean(), 0.01, 0.99))
    belief = np.where(gold == 1, GOLD_TRUST, 1 - GOLD_TRUST)
    said = np.log(GOLD_TRUST / (1 - GOLD_TRUST)) * (2 * gold - 1)
    for _ in range(rounds):
        total = log_odds(votes, belief, vote_tree(votes, belief)) + math.log(prior / (1 - prior)) + said
        new = 1 / (1 + np.exp(-np.clip(total, -50, 50)))
        if np.abs(new - belief).max() < 1e-6:
            break
        belief = new
        prior = float(np.clip(belief.mean(), 0.01, 0.99))
    return belief


def fit_linear(x: np.ndarray, target: np.ndarray, rounds: int = 400, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by accelerated gradient descent."""
    n, k = x.shape
    rows = np.c_[x, np.ones(n)].astype(np.float64)
    pull = np.r_[np.full(k, ridge), 0]
    rate = 4 / (np.linalg.norm(rows, 2) ** 2 / n + 4 * ridge)
    w = ahead = np.zeros(k + 1)
    for i in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ ahead, -50, 50)))
        new = ahead - rate * (rows.T @ (p - target) / n + pull * ahead)
        ahead = new + (i / (i + 3)) * (new - w)
        w = new
    return w[:k], float(w[k])


class Model:
    def __init__(self, words: list[str], weights: np.ndarray, base: float):
        self.words, self.weights, self.base = words, weights, base


def fit(spark: SparkSession, docs: DataFrame, sf_dir: str, rows: int = ROWS) -> Model:
    sample = labelled_sample(spark, docs, sf_dir, "toxic", rows)
    words = [*LEXICON, *(w for w in induce(sample) if w not in LEXICON)]

    def votes_of():
        finder = Finder(words)
        return lambda b: {"doc_id": b["doc_id"], "label": b["label"], "x": [signals(t, finder).tobytes() for t in b["text"]]}

    got = sorted(map_rows(sample, ["doc_id", "label", "text"], "doc_id long, label int, x binary", votes_of).collect(), key=lambda r: (r.doc_id, bytes(r.x)))
    remove(sample)
    k = len(words) + len(PATTERNS)
    if len({r.label for r in got}) < 2:
        weights = np.zeros(k + 2)
        weights[k], weights[k + 1] = 1.0, 1.5
        return Model(words, weights, -2.5)
    x = np.array([np.frombuffer(r.x, np.float32) for r in got], np.float64)
    gold = np.array([r.label for r in got], np.float64)
    return Model(words, *fit_linear(x, label_model(x[:, :k], gold)))


def scorer(model: Model):
    finder = Finder(model.words)
    k = len(model.words) + len(PATTERNS)

    def score(text: str) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, float(signals(text, finder) @ model.weights) + model.base))))

    assert len(model.weights) == k + 2
    return score


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""

    def make():
        of = scorer(model)

        def step(b):
            s = [of(t) for t in b["text"]]
            return {"doc_id": b["doc_id"], "held_out": b["held_out"], "score": s, "predicted": [int(v >= threshold) for v in s]}

        return step

    return map_rows(docs, ["doc_id", held_out().alias("held_out"), whole_text().alias("text")], "doc_id long, held_out boolean, score double, predicted int", make)
