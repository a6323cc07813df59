"""Substring deduplication by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of one document; its minimiser is the least hash of its ``MER``-word
runs. Consecutive windows with one minimiser (a super-k-mer) are one packed string, which goes to the bucket of
the minimiser: equal windows have equal minimisers, so each bucket counts its windows exactly by sorting their
hashes and comparing the bytes of equal ones. Words covered by a window that also starts in a document with a
smaller id are removed; windows are judged on the input.

A minimiser that stands in as many windows as the average part holds would make its bucket as large as all others of
a part, whatever their number. Such hot minimisers are found first, by a count over all windows in which each task
leaves out what could not matter (see ``hot_slots``); their windows go by the hash of the whole window instead, which
divides any bucket of different windows. Equal windows still meet, as they have one minimiser and one hash.

Before the shuffle a task combines equal strings of a chunk of documents: only the smallest document's go on, as
any other document of the chunk is covered by it already. A passage in every document thus costs its bucket one
string a chunk. Chunks and buckets are held as numpy arrays; strings travel compressed. There are as many parts of the
buckets, and as many targets in which covers and texts meet, as the bytes of the texts ask for, besides some for each
shuffle partition; Spark sorts them inside its partitions, so a task holds one part or target at a time, of bounded size
(but for one window in so many chunks that its strings alone fill a part).

Null texts have no words. Texts of any length are read whole. Rows without id keep all their words and lend none.
Rows that repeat an id are judged each by its own words: a window counts as repeated only if a smaller id has it, so
rows of one id take nothing from one another, and repeated rows stay equal. An empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship
from .common import map_rows, whole_text

WINDOW, MER = 13, 3
CHUNK, PIECE, LONGEST = 6 << 20, 1 << 20, 256  # bytes of a chunk, bytes hashed at a time, windows of a string
SLOTS, SLACK = 1 << 16, 8  # slots that minimisers are counted in, at least; a task leaves out slots under 1/SLACK of a part
PARTS = 2  # parts of the buckets for each shuffle partition, at least; targets are as many as shuffle partitions, at least
PART_BYTES, TARGET_BYTES = 32 << 20, 64 << 20  # of the texts, for each part and each target, at most on average
BASE = 0x9E3779B97F4A7C15 | 1
U = np.uint64

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n of each at least."""
    size = max(1 << 16, 1 << (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        inverse = pow(BASE, -1, 1 << 64)
        _powers[size] = tuple(np.cumprod(np.r_[U(1), np.full(size - 1, U(x))]) for x in (BASE, inverse))
    return _powers[size]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(29))


class Words:
    """Word bounds and hashes of lines of words: words are separated by one space, lines end with a newline."""

    def __init__(self, data: bytes):
        a = np.frombuffer(data, np.uint8)
        self.ends = np.flatnonzero((a == 32) | (a == 10))
        self.starts = np.r_[0, self.ends[:-1] + 1] if len(self.ends) else self.ends
        self.line = np.cumsum(np.r_[0, a[self.ends[:-1]] == 10]) if len(self.ends) else self.ends
        power, self.inverse = _power(len(a) + 1)
        self.sums = np.zeros(len(a) + 1, U)
        np.cumsum((a.astype(U) + U(1)) * power[: len(a)], out=self.sums[1:])

    def runs(self, size: int) -> np.ndarray:
        """A hash of each run of ``size`` words (across lines too)."""
        n = len(self.ends) - size + 1
        if n <= 0:
            return np.empty(0, U)
        s, e = self.starts[:n], self.ends[size - 1 :]
        return mix((self.sums[e] - self.sums[s]) * self.inverse[s])

    def windows(self, size: int) -> np.ndarray:
        """First words of the windows that stay in their line."""
        n = len(self.ends) - size + 1
        return np.flatnonzero(self.line[:n] == self.line[size - 1 :]) if n > 0 else np.empty(0, np.int64)


def _slot(key: np.ndarray, slots: int) -> np.ndarray:
    return ((key >> U(32)) % U(slots)).astype(np.int64)


def super_kmers(w: Words, window: int = WINDOW, mer: int = MER, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, last word, key) of each run of windows with one key: the minimiser, or the hash of the window
    where the minimiser's slot is ``hot``."""
    at = w.windows(window)
    if not len(at):
        return at, at, np.empty(0, U)
    least, span, need = w.runs(mer), 1, window - mer + 1
    whole = least
    while span * 2 <= need:  # sliding minimum by doubling
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < need:
        least = np.minimum(least[: len(whole) - need + 1], least[need - span : need - span + len(whole) - need + 1])
    mine = least[at]
    if hot is not None and hot.any():
        mine = np.where(hot[_slot(mine, len(hot))], w.runs(window)[at], mine)
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (mine[1:] != mine[:-1])])
    ends = np.r_[first[1:], len(at)]
    if (ends - first).max() > LONGEST:  # windows stay in their bucket wherever a long run is divided
        first = np.concatenate([np.arange(a, b, LONGEST) for a, b in zip(first, ends)])
        ends = np.r_[first[1:], len(at)]
    return at[first], at[ends - 1] + window - 1, mine[first]


Row = tuple[int, bytes]  # id and tag: the tag is empty unless ids repeat, else the digest of the text


def _intervals(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[int, bytes]]:
    """Merged [start, end) word intervals of each row, packed."""
    if not len(row):
        return []
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    bounds = np.flatnonzero(np.r_[True, row[1:] != row[:-1], True])
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        s, reach = start[a:b], np.maximum.accumulate(end[a:b])
        new = np.flatnonzero(np.r_[True, s[1:] > reach[:-1]])
        last = np.r_[new[1:], b - a] - 1
        out.append((int(row[a]), np.stack([s[new], reach[last]], 1).astype("<i4").tobytes()))
    return out


def _target(row: Row, targets: int) -> int:
    """The target that a row's covers and text meet in; ``_apply`` has the same in SQL."""
    return crc32(str(row[0]).encode() + row[1]) % targets


def _pack_rows(rows: list[Row]) -> bytes:
    """Ids, then tags of one size."""
    return struct.pack("<II", len(rows), len(rows[0][1])) + np.array([d for d, _ in rows], "<i8").tobytes() + b"".join(t for _, t in rows)


def _unpack_rows(raw: bytes, at: int) -> tuple[list[Row], int]:
    """The rows and where they end."""
    n, size = struct.unpack_from("<II", raw, at)
    ids = np.frombuffer(raw, "<i8", n, at + 8).tolist()
    at += 8 + 8 * n
    return [(d, raw[at + k * size : at + (k + 1) * size]) for k, d in enumerate(ids)], at + n * size


def _blocks(found: list[tuple[Row, bytes]], targets: int):
    """(target, block) of covered intervals: rows of one target share a compressed block."""
    import zstandard

    by: dict[int, list[tuple[Row, bytes]]] = {}
    for row, data in found:
        by.setdefault(_target(row, targets), []).append((row, data))
    pack = zstandard.ZstdCompressor(level=1).compress
    for target, part in by.items():
        sizes = np.array([len(x) for _, x in part], "<i4")
        yield target, pack(_pack_rows([r for r, _ in part]) + sizes.tobytes() + b"".join(x for _, x in part))


def _read_block(block: bytes, into: dict[Row, list[bytes]]) -> None:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(block)
    rows, at = _unpack_rows(raw, 0)
    sizes = np.frombuffer(raw, "<i4", len(rows), at).tolist()
    at += 4 * len(rows)
    for row, size in zip(rows, sizes):
        into.setdefault(row, []).append(raw[at : at + size])
        at += size


class _Chunk:
    """Equal strings of a chunk combined."""

    def __init__(self, parts: int, targets: int, window: int, mer: int, hot: np.ndarray | None = None):
        self.parts, self.targets, self.window, self.mer, self.hot = parts, targets, window, mer, hot
        self.docs: list[tuple[int, bytes, bytes]] = []
        self.size = 0
        self.tagged: set[Row] = set()

    def add(self, doc: int, tag: bytes, text: bytes) -> None:
        if tag:
            if (doc, tag) in self.tagged:
                return  # a repeated row says nothing new
            self.tagged.add((doc, tag))
        self.docs.append((doc, tag, text))
        self.size += len(text)

    def flush(self):
        """Rows (part, kind, data): kind 0 a block of strings for a part of the buckets, kind 1 a block of covers."""
        import zstandard

        self.docs.sort()
        ids = np.array([d for d, _, _ in self.docs], np.int64)
        seen: dict[bytes, int] = {}
        firsts: list[int] = []
        keep_row, keep_start, keep_key, keep_text = [], [], [], []
        cover = [], [], []
        at = 0
        while at < len(self.docs):
            size, upto = 0, at
            while upto < len(self.docs) and (size == 0 or size + len(self.docs[upto][2]) <= PIECE):
                size += len(self.docs[upto][2]) + 1
                upto += 1
            data = b"".join(t + b"\n" for _, _, t in self.docs[at:upto])
            w = Words(data)
            a, z, key = super_kmers(w, self.window, self.mer, self.hot)
            row = w.line[a] + at
            line_start = np.r_[0, np.flatnonzero(np.diff(w.line)) + 1]
            place = a - line_start[w.line[a]]
            firsts.clear()
            for i, (s, e, d) in enumerate(zip(w.starts[a].tolist(), w.ends[z].tolist(), ids[row].tolist())):
                text = data[s:e]
                owner = seen.setdefault(text, d)
                if owner == d:
                    firsts.append(i)
                    keep_text.append(text)
                else:
                    cover[0].append(int(row[i]))
                    cover[1].append(int(place[i]))
                    cover[2].append(int(place[i] + z[i] - a[i] + 1))
            keep_row.append(row[firsts])
            keep_start.append(place[firsts])
            keep_key.append(key[firsts])
            at = upto
        rows = [(d, t) for d, t, _ in self.docs]
        self.docs, self.size = [], 0
        self.tagged.clear()
        seen.clear()
        if keep_text:
            row, start = np.concatenate(keep_row), np.concatenate(keep_start).astype("<i4")
            part = ((np.concatenate(keep_key) >> U(20)) % U(self.parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            bounds = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0, True])
            pack = zstandard.ZstdCompressor(level=1).compress
            for b, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                ix = order[b:e]
                used, of = np.unique(row[ix], return_inverse=True)  # rows ascend, so do their numbers
                text = b"\n".join([keep_text[i] for i in ix.tolist()]) + b"\n"
                yield int(part[ix[0]]), 0, pack(_pack_rows([rows[k] for k in used.tolist()]) + struct.pack("<I", e - b) + np.diff(of, prepend=0).astype("<u4").tobytes() + start[ix].tobytes() + text)
        found = [(rows[k], data) for k, data in _intervals(*(np.array(x, np.int64) for x in cover))]
        for target, block in _blocks(found, self.targets):
            yield target, 1, block


def _count(blobs: list[bytes], window: int) -> list[tuple[Row, bytes]]:
    """Covered intervals from the strings of one part of the buckets."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    rows: list[Row] = []
    numbers, starts, texts = [], [], []
    for blob in blobs:
        raw = unpack(blob)
        own, at = _unpack_rows(raw, 0)
        (n,) = struct.unpack_from("<I", raw, at)
        numbers.append(np.cumsum(np.frombuffer(raw, "<u4", n, at + 4), dtype=np.int64) + len(rows))
        starts.append(np.frombuffer(raw, "<i4", n, at + 4 + 4 * n).copy())
        texts.append(raw[at + 4 + 8 * n :])
        rows += own
    blobs.clear()
    place = np.uint32 if sum(map(len, texts)) < 1 << 32 else np.int64
    hashes, owner, offset, begin, end = [], [], [], [], []
    base, strings = 0, 0
    for text in texts:
        at = 0
        while at < len(text):  # hash a piece of whole strings at a time
            to = len(text) if at + PIECE >= len(text) else text.index(b"\n", at + PIECE) + 1
            w = Words(text[at:to])
            first = w.windows(window)
            line_start = np.r_[0, np.flatnonzero(np.diff(w.line)) + 1]
            hashes.append(w.runs(window)[first])
            owner.append((w.line[first] + strings).astype(np.int32))
            offset.append((first - line_start[w.line[first]]).astype(np.int32))
            begin.append((w.starts[first] + base + at).astype(place))
            end.append((w.ends[first + window - 1] + base + at).astype(place))
            strings += int(w.line[-1]) + 1
            at = to
        base += len(text)
    if not hashes:
        return []
    number, start = np.concatenate(numbers), np.concatenate(starts)
    ids = np.array([d for d, _ in rows], np.int64)
    h = np.concatenate(hashes)
    hashes.clear()
    order = np.argsort(h, kind="stable")
    h = h[order]
    same = np.r_[False, h[1:] == h[:-1]]
    del h
    if not same.any():
        return []
    twice = order[same | np.r_[same[1:], False]]
    first = ~same[same | np.r_[same[1:], False]]
    owner, offset, begin, end = (np.concatenate(x) for x in (owner, offset, begin, end))
    data = b"".join(texts)
    group = np.cumsum(first) - 1
    b, e = begin[twice].tolist(), end[twice].tolist()
    odd, head = [], b""
    for i, new in enumerate(first.tolist()):  # equal hashes are compared byte by byte
        text = data[b[i] : e[i]]
        if new:
            head = text
        elif text != head:
            odd.append((i, text))
    if odd:  # a collision of hashes: such windows form groups by their bytes
        found: dict[tuple[int, bytes], int] = {}
        count = int(group[-1]) + 1
        for i, text in odd:
            group[i] = found.setdefault((int(group[i]), text), count + len(found))
    mine = ids[number[owner[twice]]]
    least = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, mine)
    hit = twice[mine > least[group]]
    at = start[owner[hit]].astype(np.int64) + offset[hit]
    return [(rows[k], data) for k, data in _intervals(number[owner[hit]], at, at + window)]


class Plan:
    """How a table is divided: parts of the buckets, targets, Spark's partitions, and the tag that tells rows apart."""

    def __init__(self, docs: DataFrame, part_bytes: int = PART_BYTES, target_bytes: int = TARGET_BYTES):
        by_id = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"))
        row = by_id.agg(F.max("n").alias("n"), F.sum("b").alias("b")).first()
        size = row.b or 0
        self.tasks = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        self.parts, self.targets = max(PARTS * self.tasks, -(-size // part_bytes)), max(self.tasks, -(-size // target_bytes))
        self.repeated = (row.n or 0) > 1
        self.tag = F.md5(whole_text()) if self.repeated else F.lit("")


def hot_slots(docs: DataFrame, parts: int, window: int = WINDOW, mer: int = MER) -> np.ndarray:
    """Which slots of minimisers hold more windows than the average of ``parts``, as a mask.

    Every window is counted. A task reports the slots that hold at least 1/(SLACK x parts) of its own windows, so what
    all tasks leave out of a slot is under 1/SLACK of an average part: at a threshold lowered by as much no hot slot is
    missed. At most SLACK x parts rows leave a task, and no more than about ``parts`` reach the driver."""
    ship(docs.sparkSession)
    slots = max(SLOTS, 1 << (SLACK * parts - 1).bit_length())

    def tally(batches):
        counts = np.zeros(slots, np.int32 if slots > SLOTS else np.int64)

        def add(texts: list[bytes]) -> None:
            a, z, key = super_kmers(Words(b"".join(texts)), window, mer)
            np.add.at(counts, _slot(key, slots), (z - a - (window - 2)).astype(counts.dtype))

        texts, size = [], 0
        for batch in batches:
            for text in batch.column(0):
                words = text.as_py().encode().split()
                if len(words) >= window:
                    texts.append(b" ".join(words) + b"\n")
                    size += len(texts[-1])
                    if size >= PIECE:
                        add(texts)
                        texts, size = [], 0
        if texts:
            add(texts)
        total = int(counts.sum(dtype=np.int64))
        found = np.flatnonzero(counts >= max(1, total) / (SLACK * parts))
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[found, -1].astype(np.int32)), pa.array(np.r_[counts[found], total])], names=["slot", "n"])

    sums = docs.filter(F.col("doc_id").isNotNull()).select(whole_text().alias("text")).mapInArrow(tally, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    total = F.max(F.when(F.col("slot") == -1, F.col("n"))).over(Window.partitionBy())
    hot = np.zeros(slots, bool)
    for row in sums.withColumn("total", total).filter(f"slot >= 0 AND n * {SLACK * parts} > total * {SLACK - 1}").select("slot").collect():
        hot[row.slot] = True
    return hot


def covers(docs: DataFrame, plan: Plan, window: int = WINDOW, mer: int = MER) -> DataFrame:
    """(target, data): blocks of covered word intervals of the rows of a target."""
    ship(docs.sparkSession)
    parts, targets = plan.parts, plan.targets
    hot = hot_slots(docs, parts, window, mer)
    schema = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
    out = pa.schema([("target", pa.int32()), ("data", pa.binary())])

    def gather(batches):
        chunk = _Chunk(parts, targets, window, mer, hot)

        def rows():
            for row in chunk.flush():
                yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, schema)], schema=schema)

        for batch in batches:
            for doc, tag, text in zip(batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist(), batch.column("text")):
                words = text.as_py().encode().split()
                if len(words) >= window:
                    chunk.add(doc, tag.encode(), b" ".join(words))
                    if chunk.size >= CHUNK:
                        yield from rows()
        yield from rows()

    def count(batches):
        one = lambda target, data: pa.RecordBatch.from_arrays([pa.array([target], pa.int32()), pa.array([data], pa.binary())], schema=out)
        blobs: list[bytes] = []
        now = None
        for batch in batches:
            for part, kind, data in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "data"))):
                if kind:
                    yield one(part, data)
                    continue
                if part != now:  # parts come one after another
                    for found in _blocks(_count(blobs, window), targets):
                        yield one(*found)
                    blobs, now = [], part
                blobs.append(data)
        for found in _blocks(_count(blobs, window), targets):
            yield one(*found)

    packed = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", plan.tag.alias("tag"), whole_text().alias("text")).mapInArrow(gather, "part int, kind int, data binary")
    return packed.repartitionById(plan.tasks * PARTS, F.col("part") % (plan.tasks * PARTS)).sortWithinPartitions("part").mapInArrow(count, "target int, data binary")


def remove(docs: DataFrame, window: int = WINDOW, mer: int = MER) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words kept, joined by spaces)."""
    return _apply(docs, window, mer, "kept string", lambda kept: kept.decode())


def digests(docs: DataFrame, window: int = WINDOW, mer: int = MER) -> DataFrame:
    """As ``remove``, with the digest of the words kept instead of them."""
    return _apply(docs, window, mer, "kept_sha256 string", lambda kept: hashlib.sha256(kept).hexdigest())


def _apply(docs: DataFrame, window: int, mer: int, column: str, of) -> DataFrame:
    """Covers and texts meet in their target, covers first."""
    plan = Plan(docs)
    found = covers(docs, plan, window, mer)
    text = whole_text()
    rows = docs.select("doc_id", plan.tag.alias("tag"), text.alias("text"))
    # where ids repeat, repeated rows travel once, however many they are
    rows = rows.groupBy("doc_id", "tag", "text").agg(F.count("*").alias("copies")) if plan.repeated else rows.withColumn("copies", F.lit(1).cast("long"))
    # _target in SQL; rows without id go anywhere, by their text
    target = F.pmod(F.crc32(F.coalesce(F.concat(F.col("doc_id").cast("string"), "tag"), F.col("text")).cast("binary")), F.lit(plan.targets)).cast("int")
    none = lambda kind: F.lit(None).cast(kind)
    both = rows.select(target.alias("target"), F.lit(1).alias("kind"), "doc_id", "tag", "text", "copies", none("binary").alias("data")).unionByName(
        found.select("target", F.lit(0).alias("kind"), none("long").alias("doc_id"), none("string").alias("tag"), none("string").alias("text"), none("long").alias("copies"), "data")
    )
    met = both.repartitionById(plan.tasks, F.col("target") % plan.tasks).sortWithinPartitions("target", "kind")
    name = column.split()[0]

    def make():
        known: dict[Row, list[bytes]] = {}
        now = None

        def step(b):
            nonlocal now
            out: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], name: [], "copies": []}
            for target, kind, doc, tag, text, copies, data in zip(b["target"], b["kind"], b["doc_id"], b["tag"], b["text"], b["copies"], b["data"]):
                if target != now:
                    known.clear()
                    now = target
                if not kind:
                    _read_block(data, known)
                    continue
                words = text.encode().split()
                kept = words
                mine = known.get((doc, tag.encode())) if doc is not None else None
                if mine:
                    drop = np.zeros(len(words) + 1, np.int64)
                    pair = np.minimum(np.frombuffer(b"".join(mine), "<i4").reshape(-1, 2), len(words))
                    np.add.at(drop, pair[:, 0], 1)
                    np.add.at(drop, pair[:, 1], -1)
                    kept = [w for w, g in zip(words, (np.cumsum(drop[:-1]) > 0).tolist()) if not g]
                for k, v in zip(out, (doc, len(words), len(words) - len(kept), of(b" ".join(kept)), copies)):
                    out[k].append(v)
            return out

        return step

    got = map_rows(met, ["target", "kind", "doc_id", "tag", "text", "copies", "data"], f"doc_id long, n_words long, n_removed long, {column}, copies long", make)
    if plan.repeated:  # repeated rows come back, thousands at a time
        dealt = got.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(4096).cast("long")))).repartition(plan.tasks, "doc_id", "from")
        got = dealt.withColumn("one", F.explode(F.sequence("from", F.least(F.col("copies") - 1, F.col("from") + 4095))))
    return got.select("doc_id", "n_words", "n_removed", name)
