"""Finding passages of evaluation items in a corpus by greedy string tiling."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.folding import forms, plain, skeleton
from tidemark.session import dealt

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TABLE_BITS = 22
#: Letters of a text that are searched at once.
_STREAM = 400_000
#: Blocks of writing without spaces between words, two letters of which count as a word.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]{1,2}|[^\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")


@dataclass(frozen=True)
class LeakLimits:
    """Parameters. Tokens are letters and digits, since spacing does not count.

    min_words: words running that make a leak. miss: of so many of them one may be changed
    or dropped. shingle: words in a row that are looked up. seeds: letters by whose hash
    they are, the first that a shingle has; shorter ones are looked up whole. tile: shortest
    tile. drift: letters by which changed words may displace one shared shingle against the
    next. gap: letters between shared shingles beyond which they are tiled apart. block,
    block_chars: items, and characters of them, that are looked for at once, about: a bound
    on what is broadcast.
    """

    min_words: int = 20
    miss: int = 8
    shingle: int = 4
    seeds: tuple[int, ...] = (12, 8)
    tile: int = 8
    drift: int = 64
    gap: int = 250
    block: int = 16_000
    block_chars: int = 16_000_000

    @property
    def least_shared(self) -> int:
        """Shingles that any leak shares: ``n`` words, ``m = n // miss`` of them changed, fall into ``m + 1`` stretches, each of which has ``shingle - 1`` shingles less than words at most."""
        longest = self.min_words + self.miss * self.miss
        least = min(n - n // self.miss - (self.shingle - 1) * (n // self.miss + 1) for n in range(self.min_words, longest + 1))
        if least < 1:
            raise ValueError("a leak need not share a shingle of that length")
        return least


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base``, modulo 2**64."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.cumprod(np.append(np.uint64(1), np.full(max(n, 1 << 16), base)))
        _POWERS[int(base)] = have
    return have[:n]


class RollingHash:
    """Karp-Rabin hashes of any stretches of one sequence of codes."""

    def __init__(self, codes: np.ndarray) -> None:
        n = len(codes)
        with np.errstate(over="ignore"):
            terms = (codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) * _powers(_BASE, n)
            self.upto = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(terms, dtype=np.uint64)])
        self.back = _powers(_BACK, n + 1)

    def windows(self, width: int) -> np.ndarray:
        """Hash of each ``width`` codes in a row."""
        n = len(self.upto) - width
        if n <= 0:
            return np.empty(0, dtype=np.uint64)
        with np.errstate(over="ignore"):
            return (self.upto[width:] - self.upto[:n]) * self.back[:n]

    def stretches(self, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.upto[begin + length] - self.upto[begin]) * self.back[begin]


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash of each ``width`` codes in a row."""
    return RollingHash(codes).windows(width)


def _different(group: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """For each place, how many different ones its group has."""
    if not len(group):
        return group
    top = int(group.max()) + 1
    return np.bincount(np.unique(group * length + place) // length, minlength=top)[group]


def reading_words(words: Sequence[str]) -> list[str]:
    """Words as they are counted: of writing without spaces, two letters are one."""
    return [piece for w in words for piece in (_UNSPACED.findall(w) if not w.isascii() else (w,))]


class Index:
    """Shingles of words of some passages, by the hash of their first letters."""

    def __init__(self, items: list[tuple[int, list[str], np.ndarray]], lim: LeakLimits) -> None:
        shown = lim.shingle
        lead, whole, owner, place, size, seed_size = [], [], [], [], [], []
        for item, words, starts in items:
            h = RollingHash(_codes("".join(words)))
            begin = starts[: len(words) - shown + 1]
            length = starts[shown:] - begin
            width = length.copy()
            for seed in sorted(lim.seeds):
                width[length >= seed] = seed
            lead.append(h.stretches(begin, width))
            whole.append(h.stretches(begin, length))
            owner.append(np.full(len(begin), item))
            place.append(begin)
            size.append(length)
            seed_size.append(width)
        cat = lambda xs, t: np.concatenate(xs) if xs else np.empty(0, dtype=t)
        lead, whole = cat(lead, np.uint64), cat(whole, np.uint64)
        owner, place, size, seed_size = (cat(x, np.int64) for x in (owner, place, size, seed_size))
        self.tables = []  # by letters of the seed
        for width in np.unique(seed_size):
            mine = np.flatnonzero(seed_size == width)
            mine = mine[np.argsort(lead[mine], kind="stable")]
            table = np.zeros(1 << _TABLE_BITS, dtype=bool)
            table[(lead[mine] >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
            self.tables.append((int(width), table, lead[mine], whole[mine], owner[mine], place[mine], size[mine]))

    def hits(self, stream: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in the stream at which a shingle of an item stands, the items, and the shingles' places in them."""
        h = RollingHash(_codes(stream))
        n = len(h.upto) - 1
        out = []
        for width, table, lead, whole, owner, place, size in self.tables:
            seeds = h.windows(width)
            at = np.flatnonzero(table[(seeds >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
            low = np.searchsorted(lead, seeds[at], "left")
            count = np.searchsorted(lead, seeds[at], "right") - low
            doc = np.repeat(at, count)
            entry = np.repeat(low - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            fits = doc + size[entry] <= n
            doc, entry = doc[fits], entry[fits]
            same = h.stretches(doc, size[entry]) == whole[entry]
            out.append((doc[same], owner[entry[same]], place[entry[same]]))
        if not out:
            return tuple(np.empty(0, dtype=np.int64) for _ in range(3))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Passages:
    """A block of passages with an index of their shingles, as they are and by their ASCII letters."""

    def __init__(self, passages: list[str], limits: LeakLimits, min_coverage: float | None = None) -> None:
        self.limits, self.min_coverage = limits, min_coverage
        self.items: list[tuple[int, list[str], np.ndarray]] = []  # passage, words, word starts
        kinds: dict[str, list] = {"plain": [], "skeleton": []}
        for k, text in enumerate(passages):
            full, bare = reading_words(plain(text)), skeleton(text)
            ways = [("plain", full)]
            if bare != full and sum(map(len, bare)) > 0.6 * sum(map(len, full)):
                ways.append(("skeleton", bare))
            for form, words in ways:
                if len(words) >= limits.min_words:
                    starts = np.cumsum([0, *map(len, words)])
                    kinds[form].append((len(self.items), words, starts))
                    self.items.append((k, words, starts))
        self.sizes = np.array([len(words) for _, words, _ in self.items], dtype=np.int64), max((int(starts[-1]) for *_, starts in self.items), default=0) + 1
        self.index = {form: Index(items, limits) for form, items in kinds.items() if items}

    def search(self, text: str) -> dict[int, tuple[int, float, int]]:
        """Passages that a text shows: passage -> (most words running, share of its words in tiles, tiles)."""
        return next(iter(self.search_all([text]).values()), {})

    def search_all(self, texts: Sequence[str | None]) -> dict[int, dict[int, tuple[int, float, int]]]:
        """For each text, by its number, what ``search`` finds in it; texts are folded once and searched together."""
        found: dict[int, dict[int, tuple[int, float, int]]] = {}
        streams: dict[str, list[tuple[int, str]]] = {form: [] for form in self.index}
        size = dict.fromkeys(streams, 0)
        for k, text in enumerate(texts):
            for form, words in forms(text or ""):
                if form in streams and words:
                    stream = "".join(words)
                    streams[form].append((k, stream))
                    size[form] += len(stream)
                    if size[form] >= _STREAM:
                        self._search(form, streams[form], found)
                        streams[form], size[form] = [], 0
        for form, rest in streams.items():
            self._search(form, rest, found)
        return found

    def _search(self, form: str, streams: list[tuple[int, str]], found: dict) -> None:
        # no shingle holds the sign that parts the texts
        begin = np.cumsum([0, *(len(s) + 1 for _, s in streams)])
        doc, owner, place = self.index[form].hits("\0".join(s for _, s in streams))
        if not len(doc):
            return
        which = np.searchsorted(begin, doc, "right") - 1
        keep = self._worth(which * len(self.items) + owner, doc, owner, place)
        doc, owner, place, which = doc[keep], owner[keep], place[keep], which[keep]
        if not len(doc):
            return
        order = np.lexsort((place, doc, owner, which))
        doc, owner, place, which = doc[order] - begin[which[order]], owner[order], place[order], which[order]
        first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (which[1:] != which[:-1])))
        for a, b in zip(first, np.append(first[1:], len(doc)), strict=True):
            k, stream = streams[int(which[a])]
            passage = self.items[int(owner[a])][0]
            new = self._shown(int(owner[a]), stream, doc[a:b], place[a:b])
            best = found.setdefault(k, {}).get(passage, (0, 0.0, 0))
            found[k][passage] = tuple(map(max, best, new))

    def _worth(self, pair: np.ndarray, doc: np.ndarray, owner: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which shared shingles lie among enough others of their pair: nearly aligned ones, or with a share to cover, any."""
        lim, (size, length) = self.limits, self.sizes
        _, pair, n = np.unique(pair, return_inverse=True, return_counts=True)
        keep = np.zeros(len(pair), dtype=bool)
        some = np.flatnonzero(n[pair] >= lim.least_shared)  # most pairs share a phrase or two
        off = doc[some] - place[some]
        order = np.lexsort((off, pair[some]))
        some, off = some[order], off[order]
        group = np.cumsum(np.append(True, (pair[some][1:] != pair[some][:-1]) | (np.diff(off) > lim.drift)))[: len(some)]
        keep[some] = _different(group, place[some], length) >= lim.least_shared
        if self.min_coverage is not None:
            keep |= _different(pair, place, length) >= 0.5 * self.min_coverage * (size[owner] - lim.shingle + 1)
        return keep

    def _shown(self, item: int, stream: str, doc: np.ndarray, place: np.ndarray) -> tuple[int, float, int]:
        """Tiles a passage with the parts of a text around their shared shingles."""
        lim, (_, words, starts) = self.limits, self.items[item]
        length, text = int(starts[-1]), "".join(words)
        cover = np.zeros(length + 1, dtype=np.int64)
        running, n_tiles, done = 0, 0, -1
        for piece in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(doc) > lim.gap) + 1):
            low = max(0, int((doc[piece] - 1.2 * place[piece]).min()) - 60)
            high = int((doc[piece] + 1.2 * (length - place[piece])).max()) + 60
            if low < done and high <= done:
                continue  # lies within the part before
            done = max(done, high)
            region = stream[low:high]
            tiles = greedy_tiles(text, region, lim.tile)
            running = max(running, words_running(text, region, words, starts, tiles, lim))
            for a, _, n in tiles:
                cover[a : a + n] = 1
            n_tiles += len(tiles)
        whole = np.add.reduceat(cover[:-1], starts[:-1]) == np.diff(starts)
        return running, float(whole.mean()), n_tiles


def greedy_tiles(a: str, b: str, shortest: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: longest common substrings that overlap no longer one, as (place in a, place in b, length).

    Matches of a search length are found by their Karp-Rabin hashes and lengthened as far
    as they go; the search length halves until it is ``shortest``. Of equal lengths
    the first in a, then in b, is marked.
    """
    ca, cb = _codes(a), _codes(b)
    free_a, free_b = np.ones(len(ca), dtype=bool), np.ones(len(cb), dtype=bool)
    tiles: list[tuple[int, int, int]] = []
    width = max(shortest, min(64, len(a), len(b)))
    while True:
        ha, hb = window_hashes(ca, width), window_hashes(cb, width)
        again = len(ha) > 0 and len(hb) > 0
        while again:
            again = False
            wa, wb = _free_windows(free_a, width), _free_windows(free_b, width)
            ia, ib = np.flatnonzero(wa), np.flatnonzero(wb)
            order = np.argsort(hb[ib], kind="stable")
            sorted_b = hb[ib][order]
            low, up = np.searchsorted(sorted_b, ha[ia], "left"), np.searchsorted(sorted_b, ha[ia], "right")
            matches = []
            for i, lo, hi in zip(ia[up > low], low[up > low], up[up > low], strict=True):
                for j in ib[order[lo:hi]]:
                    i, j = int(i), int(j)
                    if i and j and free_a[i - 1] and free_b[j - 1] and ca[i - 1] == cb[j - 1]:
                        continue  # begins further left
                    n = 0
                    most = min(len(ca) - i, len(cb) - j)
                    stop = np.flatnonzero((ca[i : i + most] != cb[j : j + most]) | ~free_a[i : i + most] | ~free_b[j : j + most])
                    n = int(stop[0]) if len(stop) else most
                    if n >= width:
                        matches.append((-n, i, j))
            for n, i, j in sorted(matches):
                if free_a[i : i - n].all() and free_b[j : j - n].all():
                    tiles.append((i, j, -n))
                    free_a[i : i - n] = free_b[j : j - n] = False
                else:
                    again = True
        if width == shortest:
            return tiles
        width = max(shortest, width // 2)


def _free_windows(free: np.ndarray, width: int) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(free)])
    return total[width:] - total[:-width] == width


def words_running(item: str, text: str, words: list[str], starts: np.ndarray, tiles: list[tuple[int, int, int]], lim: LeakLimits) -> int:
    """Most words of the item that the text shows running, at most one in ``miss`` of them missing.

    The tiles are chained in the order of both texts, the chain that covers most; a
    word counts as shown if it lies in a tile, or between two tiles in both texts.
    """
    tiles = sorted(tiles)
    if not tiles:
        return 0
    best = [n for _, _, n in tiles]
    back = [-1] * len(tiles)
    for y, (a, b, n) in enumerate(tiles):
        for x in range(y):
            a0, b0, n0 = tiles[x]
            if a0 + n0 <= a and b0 + n0 <= b and b - b0 - n0 <= 1.5 * (a - a0 - n0) + 24 and best[x] + n > best[y]:
                best[y], back[y] = best[x] + n, x
    y = int(np.argmax(best))
    chain = []
    while y >= 0:
        chain.append(tiles[y])
        y = back[y]
    chain.reverse()
    cover = np.zeros(len(item), dtype=np.int64)
    for a, _, n in chain:
        cover[a : a + n] = 1
    shown = np.add.reduceat(cover, starts[:-1]) == np.diff(starts)
    for (a0, b0, n0), (a1, b1, _) in zip(chain[:-1], chain[1:], strict=True):
        # tiles may end inside a word that was changed, so the gap in the text reaches into them
        at = max(b0, b0 + n0 - 12)
        gap = text[:b1 + 12]
        for w in range(int(np.searchsorted(starts, a0 + n0, "right")) - 1, int(np.searchsorted(starts, a1, "left")) + 1):
            if 0 <= w < len(words) and not shown[w] and len(words[w]) > 1:
                hit = gap.find(words[w], at)
                if hit >= 0:
                    shown[w], at = True, hit + len(words[w])
    _beyond_ends(text, words, shown, chain, starts)
    at = np.flatnonzero(shown)
    longest = 0
    missing = np.concatenate([[0], np.cumsum(~shown)])
    for i in at:
        ends = at[at >= i]
        size = ends - i + 1
        good = (missing[ends + 1] - missing[i]) * lim.miss <= size
        if good.any():
            longest = max(longest, int(size[good].max()))
    return longest


def _beyond_ends(text: str, words: list[str], shown: np.ndarray, chain: list[tuple[int, int, int]], starts: np.ndarray) -> None:
    """Marks words shown outside the chain, behind a changed or dropped word at either end, that are too short for a tile."""
    at = np.flatnonzero(shown)
    if not len(at):
        return
    (_, left, _), (_, b, n) = chain[0], chain[-1]
    right, miss = b + n, 0
    for w in range(int(at[-1]) + 1, len(words)):
        size = len(words[w])
        hit = text.find(words[w], right if miss else max(b, right - size), right + 14 * miss + size) if _tells(size, miss) else -1
        if hit >= 0:
            shown[w], right, miss = True, hit + size, 0
        else:
            miss += 1
            if miss > 2:
                break
    miss = 0
    for w in range(int(at[0]) - 1, -1, -1):
        size = len(words[w])
        hit = text.rfind(words[w], max(0, left - 14 * miss - size), left if miss else left + size) if _tells(size, miss) else -1
        if hit >= 0:
            shown[w], left, miss = True, hit, 0
        else:
            miss += 1
            if miss > 2:
                break


def _tells(size: int, miss: int) -> bool:
    """Whether a word of so many letters, behind so many that are missing, is unlikely to stand there by chance."""
    return size > (1 if miss < 2 else 3)


def leaked_passages(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage",
    limits: LeakLimits | None = None, min_coverage: float | None = None,
) -> DataFrame:
    """Documents that show passages of evaluation items: (``doc_id``, ``item_id``, ``words_running``, ``coverage``, ``tiles``).

    A pair is returned if the text shows at least ``min_words`` words of the passage
    running, one in ``miss`` of them changed or dropped at most; with ``min_coverage``
    also if tiles cover that share of the passage's words, in any order and place. Case,
    marks, spacing, accents, entities and charset mistakes do not count. Of writing
    without spaces, two letters count as a word. Items that share a passage are all
    returned. Null texts and passages, and passages of under ``min_words`` words, give no
    pair; documents with equal or null ids are documents of their own. Empty tables give
    no rows.

    A pair is tiled if the text has ``least_shared`` shingles of the passage, letter by
    letter and nearly aligned. That loses no leak, since the words that stand unchanged
    between the changes of any have that many. With ``min_coverage`` it is also tiled if it
    has half that share of the passage's shingles, wherever they stand.

    Items are the stated query set: they are taken in blocks of ``block``, and each
    block is joined with all documents by an index sent to the tasks, whose size the block
    bounds, made once in each Python process. Documents are read once per block,
    column-pruned, and never shuffled if they lie in enough parts; a document's whole text
    is searched.
    """
    lim = limits or LeakLimits()
    spark = documents.sparkSession
    stated = items.select(F.col(item_id).alias("i"), F.col(passage).alias("p")).where("p IS NOT NULL")
    n, chars = stated.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("p")), F.lit(0))).first()
    blocks = max(1, -(-n // lim.block), -(-chars // lim.block_chars))
    doc_kind, item_kind = (df.schema[c].dataType.simpleString() for df, c in ((documents, doc_id), (items, item_id)))
    docs = dealt(documents.select(F.col(doc_id).alias("__tm_doc"), F.col(text).alias("__tm_text")).where("__tm_text IS NOT NULL"))
    out = None
    for b in range(blocks):
        rows = stated.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).collect()
        owners: dict[str, list] = {}
        for r in rows:
            owners.setdefault(r.p, []).append(r.i)
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, list(owners), list(owners.values())))
        part = docs.mapInArrow(_search(sent, lim, min_coverage, item_kind), f"__tm_doc {doc_kind}, __tm_item {item_kind}, words_running long, coverage double, tiles long")
        out = part if out is None else out.unionByName(part)
    return out.withColumnsRenamed({"__tm_doc": doc_id, "__tm_item": item_id})


#: The index made last in this process, and the block it is of.
_MADE: dict[str, Passages] = {}


def _passages(name: str, passages: list[str], lim: LeakLimits, min_coverage: float | None) -> Passages:
    if name not in _MADE:
        _MADE.clear()
        _MADE[name] = Passages(passages, lim, min_coverage)
    return _MADE[name]


def _search(sent, lim: LeakLimits, min_coverage: float | None, item_kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, passages, owners = sent.value
        index = _passages(name, passages, lim, min_coverage)
        for batch in batches:
            at, item, running, coverage, tiles = [], [], [], [], []
            for k, shown in sorted(index.search_all(batch.column(1).to_pylist()).items()):
                for p, (words, share, n) in shown.items():
                    if words >= lim.min_words or min_coverage is not None and share >= min_coverage:
                        for i in owners[p]:
                            at.append(k)
                            item.append(i)
                            running.append(words)
                            coverage.append(share)
                            tiles.append(n)
            if at:
                kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(item_kind)
                cols = [batch.column(0).take(pa.array(at)), pa.array(item, kind), pa.array(running, pa.int64()), pa.array(coverage, pa.float64()), pa.array(tiles, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["__tm_doc", "__tm_item", "words_running", "coverage", "tiles"])

    return run
