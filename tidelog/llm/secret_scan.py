"""Secret scans: fixed base patterns plus a guess-cost dynamic programme over credential values.

Base kinds: ``assign``, ``access`` and ``hex``. The method adds kind ``guess``: values that stand in a
credential context and would take at least ``10**MIN_COST`` guesses. A value's cost is the least sum,
over its segmentations into words, dates, repeats, keyboard walks and brute-force spans, of each
segment's log10 guesses. Words are common password words and then the words of a public tokenizer's vocabulary
in the order of its ranks (a path, a parameter); a word costs the guesses of its rank. A brute-force character
costs the size of its class: digits, small letters, capitals, printable ASCII signs, anything else. A ``guess`` span is left out only where base spans cover it wholly: a value whose
head alone is a base span keeps both. ``guess`` spans never overlap one another.

Null texts count as empty and give no spans. Texts of any length are read whole: the programme's
time is linear in a value's length. Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, whole_text

KINDS = ("assign", "access", "hex", "guess")
MIN_COST = 8.0  # log10 of guesses from which a value counts as a secret

# The base patterns.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
# Words that open a credential context.
CONTEXT_WORDS = "password passwd passphrase passcode pwd secret token api_key apikey api-key access_key private_key client_secret credential bearer authorization auth_key".split()
CONTEXT = re.compile(rf"(?<![a-z0-9])(?:{'|'.join(CONTEXT_WORDS)})s?[\"']?\x20*(?:[:=]|\x20is\x20)\x20*(?:bearer\x20|basic\x20)?[\"']?([^\s\"'`,;<>(){{}}\[\]|]{{8,}})", re.I | re.A)
# Common password words, most frequent first.
WORDS = """password qwerty admin welcome login dragon monkey master letmein princess football shadow sunshine
baseball superman iloveyou trustno changeme default secret hello access flower starwars whatever freedom michael
jordan summer winter spring autumn love user root guest test example sample demo temp public private token value
none null your here the and this that with from pass word key code name data server client system company""".split()
LEET = str.maketrans("4@310$57!", "aaeiosstl"[:9])
# Rows of keys and plain sequences.
WALKS = ["qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz"]
NEXT = {(r[i], r[i + d]) for r in WALKS for d in (1, -1) for i in range(len(r)) if 0 <= i + d < len(r)}
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")
SEGMENT = math.log10(2)  # each further segment costs at least the guess where it starts
CHANGED, CASED = math.log10(4), math.log10(3)  # for letters written as other signs, and for capitals
# log10 of how many characters a class has; the last is a rough figure for all others.
DIGIT, LETTER, SIGN, OTHER = (math.log10(n) for n in (10, 26, 33, 1000))


class Dictionary:
    """Words of three letters or more and their ranks from 1: common password words, then those of a vocabulary file."""

    def __init__(self, path: str | None = None):
        self.rank = {w: i for i, w in enumerate(dict.fromkeys(WORDS), 1)}
        if path is not None:
            with open(path, "rb") as f:
                tokens = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
            for _, token in tokens:
                if token[:1] == b" " and len(token) > 3 and token[1:].isalpha() and token.isascii():
                    self.rank.setdefault(token[1:].decode().lower(), len(self.rank) + 1)
        self.cost = {w: SEGMENT + math.log10(r + 1) for w, r in self.rank.items()}
        self.sizes = range(3, max(map(len, self.rank)) + 1)


_dictionaries: dict[str | None, Dictionary] = {}


def dictionary(path: str | None = None) -> Dictionary:
    """One for a worker process, shared by its tasks."""
    if path not in _dictionaries:
        _dictionaries[path] = Dictionary(path)
    return _dictionaries[path]


def _brute(ch: str) -> float:
    if not ch.isascii():
        return OTHER
    return DIGIT if ch.isdigit() else LETTER if ch.isalpha() else SIGN


def fold(text: str) -> str:
    """Lower case with every letter at its place; only one capital has a longer lower case."""
    return text.replace("\u0130", "i").lower()


def guess_cost(value: str, words: Dictionary | None = None) -> float:
    """log10 of the guesses of the cheapest segmentation."""
    words = words or dictionary()
    low = fold(value)
    plain = low.translate(LEET)
    forms = ((low, 0.0), (plain, CHANGED)) if plain != low else ((low, 0.0),)
    n = len(value)
    best = [0.0] + [math.inf] * n  # cheapest cover of each prefix
    brute = math.inf  # cheapest cover of the prefix whose last segment is brute force
    run = walk = 0  # where the longest repeat and walk that end here began
    runs, walks = [], []  # starts inside them that may still be the cheapest
    for i in range(1, n + 1):
        ch = _brute(value[i - 1])
        brute = min(brute, best[i - 1] + (SEGMENT if i > 1 else 0)) + ch
        least = brute
        if i > 1:
            if low[i - 1] != low[i - 2]:
                run, runs = i - 1, []
            if (low[i - 2], low[i - 1]) not in NEXT:
                walk, walks = i - 1, []
        for first, starts in (run, runs), (walk, walks):
            if i - first >= 3:
                # a start no cheaper than an earlier one stays so, as the lead of the shorter length only shrinks;
                # nor can an earlier one win whose prefix costs no less
                while starts and best[starts[-1]] >= best[i - 3]:
                    starts.pop()
                starts.append(i - 3)
                cheapest, live = math.inf, []
                for began in starts:
                    cost = best[began] + math.log10(i - began)
                    if cost < cheapest:
                        cheapest = cost
                        live.append(began)
                starts[:] = live
                least = min(least, cheapest + SEGMENT + math.log10(47))
        if value[i - 1].isdecimal():
            for size in (4, 8, 9, 10):
                if size <= i and DATE.fullmatch(value, i - size, i):
                    least = min(least, best[i - size] + SEGMENT + (math.log10(119) if size == 4 else math.log10(365 * 119)))
        for size in words.sizes:
            if size > i:
                break
            for form, extra in forms:
                cost = words.cost.get(form[i - size : i])
                if cost is not None:
                    cased = 0.0 if value[i - size : i] == low[i - size : i] else CASED
                    least = min(least, best[i - size] + cost + extra + cased)
        best[i] = least
    return best[n]


def base_spans(text: str, low: str | None = None) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns, by start and then kind as listed."""
    low = fold(text) if low is None else low
    out = []
    if any(k in low for k in ("passw", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(s, KINDS[k], e) for s, k, e in sorted(out)]


def find_spans(text: str, words: Dictionary | None = None) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]], float]:
    """Base spans, all spans, and the greatest guess cost of a credential value (0: none)."""
    low = fold(text)
    base = base_spans(text, low)
    added, most = [], 0.0
    if any(k in low for k in ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "auth")):
        covered: list[tuple[int, int]] = []  # the base spans, merged where they overlap or touch
        for s, _, e in base:
            if covered and s <= covered[-1][1]:
                covered[-1] = (covered[-1][0], max(covered[-1][1], e))
            else:
                covered.append((s, e))
        for m in CONTEXT.finditer(text):
            cost = guess_cost(m[1].rstrip(".!?:"), words)
            most = max(most, cost)
            start, end = m.start(1), m.start(1) + len(m[1].rstrip(".!?:"))
            before = bisect_right(covered, start, key=lambda c: c[0])  # merged spans that begin no later than the value
            if cost >= MIN_COST and not (before and covered[before - 1][1] >= end):
                added.append((start, "guess", end))
    return base, sorted(base + added, key=lambda x: (x[0], KINDS.index(x[1]))), most


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, counts of base kinds, base_sha256, spans, guess_log10. path: of the vocabulary."""

    def make():
        words = dictionary(path)

        def step(b):
            out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "guess_log10")}
            for text in b["text"]:
                base, spans, most = find_spans(text, words)
                kinds = [k for _, k, _ in base]
                for kind in KINDS[:3]:
                    out[f"n_{kind}"].append(kinds.count(kind))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(spans))
                out["guess_log10"].append(most)
            return out | {"doc_id": b["doc_id"]}

        return step

    return map_rows(docs, ["doc_id", whole_text().alias("text")], "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, guess_log10 double", make)


def redact_text(text: str, words: Dictionary | None = None) -> str:
    spans, out, at = find_spans(text, words)[1], [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind} secret removed]"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if spans else text


def redact(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The same documents and columns; every span found is replaced by a mark, n_chars follows the text."""
    names = docs.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)

    def make():
        words = dictionary(path)

        def step(b):
            texts = [None if t is None else redact_text(t, words) for t in b["text"]]
            if "n_chars" in b:
                b["n_chars"] = [n if t is None or t == was else len(t) for n, t, was in zip(b["n_chars"], texts, b["text"])]
            return b | {"text": texts}

        return step

    return map_rows(docs, [F.col(f"`{n}`") for n in names], schema, make)
