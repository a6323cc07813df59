"""Cross-validation of the classifiers' settings on training rows alone; the held-out fold is never read.

``python -m tests.llm.pick_settings [folder]`` prints, for each setting, what four folds of the training rows
(crc32(doc_id) mod 5 in 1 to 4) give: right and wrong answers and the mean cross entropy. Not collected by pytest.
"""

from __future__ import annotations

import sys
from collections import Counter
from concurrent.futures import ProcessPoolExecutor
from zlib import crc32

import numpy as np
import pandas as pd

from tidelog.llm import quality, toxicity

FOLDS = (1, 2, 3, 4)
VECTOR_RATES = (2.0, 5.0, 10.0, 20.0, 40.0)
PRECISIONS, TRUSTS = (0.4, 0.5, 0.6, 0.7, 0.8, 0.9), (0.9, 0.95, 0.97, 0.99)


def load(folder: str, label: str) -> pd.DataFrame:
    docs = pd.read_parquet(f"{folder}/documents.parquet", columns=["doc_id", "text"])
    rows = docs.merge(pd.read_parquet(f"{folder}/labels.parquet", columns=["doc_id", label]).dropna(), on="doc_id")
    rows["fold"] = [crc32(str(i).encode()) % 5 for i in rows.doc_id]
    rows = rows[rows.fold.isin(FOLDS)].sort_values("doc_id")
    return pd.DataFrame({"text": rows.text.fillna(""), "y": rows[label].astype(int), "fold": rows.fold})


def judged(y: np.ndarray, score: np.ndarray, threshold: float) -> tuple[int, int, int, int, float]:
    """(true positives, false positives, false negatives, rows, sum of cross entropy)."""
    p = score >= threshold
    loss = -np.log(np.clip(np.where(y == 1, score, 1 - score), 1e-9, None)).sum()
    return int((p & (y == 1)).sum()), int((p & (y == 0)).sum()), int((~p & (y == 1)).sum()), len(y), float(loss)


def quality_fold(job: tuple[str, int]) -> list[tuple]:
    folder, fold = job
    rows = load(folder, "quality")
    found = [(np.frombuffer(f, np.uint32), np.frombuffer(n, np.float32), y) for (f, n), y in zip(map(quality.feature_counts, rows.text), rows.y)]
    mine = (rows.fold == fold).to_numpy()
    out = []
    for rate in VECTOR_RATES:
        weights = quality.train([r for r, m in zip(found, mine) if not m], vector_rate=rate)
        logits = np.array([float(weights[f] @ n) / float(n.sum()) for (f, n, _), m in zip(found, mine) if m])
        out.append((f"VECTOR_RATE {rate}", *judged(rows.y.to_numpy()[mine], 1 / (1 + np.exp(-np.clip(logits, -500, 500))), 0.3)))
    return out


def stem_counts(rows: pd.DataFrame) -> tuple[list[tuple[str, int, int]], int]:
    """What ``toxicity.induce`` counts, without Spark."""
    counts, groups = (Counter(), Counter()), set()
    seen = set()
    for text, y in zip(rows.text, rows.y):
        words = set(toxicity.WORD.findall(toxicity.fold(text)))
        key = (y, toxicity.copies_of(words))
        if y:
            groups.add(key)
        if key not in seen:
            seen.add(key)
            counts[y].update({w[:k] for w in words for k in toxicity.STEMS if len(w) >= k})
    clean, toxic = counts
    return [(s, n, clean[s]) for s, n in toxic.items() if n >= toxicity.MIN_DOCS], len(groups)


def toxicity_fold(job: tuple[str, int]) -> list[tuple]:
    folder, fold = job
    rows = load(folder, "toxic")
    train, test = rows[rows.fold != fold], rows[rows.fold == fold]
    stems, groups = stem_counts(train)
    out = []
    for toxicity.PRECISION in PRECISIONS:
        words = [*toxicity.LEXICON, *(w for w in toxicity.choose(stems, groups) if w not in toxicity.LEXICON)]
        finder, k = toxicity.Finder(words), len(words) + len(toxicity.PATTERNS)
        x, z = (np.array([toxicity.signals(t, finder) for t in part.text], np.float64) for part in (train, test))
        for toxicity.GOLD_TRUST in TRUSTS:
            weights, base = toxicity.fit_linear(x, toxicity.label_model(x[:, :k], train.y.to_numpy(float)))
            score = 1 / (1 + np.exp(-np.clip(z @ weights + base, -50, 50)))
            out.append((f"PRECISION {toxicity.PRECISION} GOLD_TRUST {toxicity.GOLD_TRUST}", *judged(test.y.to_numpy(), score, 0.5)))
    return out


def main(folder: str) -> None:
    with ProcessPoolExecutor() as pool:
        for of in (quality_fold, toxicity_fold):
            found = pd.DataFrame([r for part in pool.map(of, [(folder, f) for f in FOLDS]) for r in part], columns=["setting", "tp", "fp", "fn", "n", "loss"])
            total = found.groupby("setting").sum()
            total["loss"] /= total.n
            print(total.sort_values("loss").to_string(), "\n")


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
