"""Implausible readings: impossible values, spikes and stuck values, judged against each source's own behaviour.

A source is one field (price or size) of one ticker in one recording of one feed. Its
readings, in order of time, give four features each - level, difference, seasonal and
run length - over which an isolation forest is fitted for that source. Every reading
is scored and the score decides; explicit rules state the physical limits only.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.isolation import Forest
from tidemark.operators.ordered import CHUNK, IDX, new_run, number_rows, part_count
from tidemark.session import task_count, written

TRADE_PRICE, TRADE_SIZE, L2_PRICE = 0, 1, 2
SOURCE = ["field", "recording_id", "ticker_id"]
#: Stream of readings that cannot be stuck: depth levels.
LOOSE = 9
#: Bins of logarithms in which medians and quantiles are counted: of distances, and of values over a day.
FINE, COARSE, WIDEST = 1e-6, 1e-4, 0.25
ARRIVALS = 16


@dataclass(frozen=True)
class SpikeLimits:
    """Parameters of the operator.

    reach: readings on either side whose median is a reading's normal level. side:
    readings whose median is the level before, or after, a reading.

    Units of the features, chosen so that usual readings stay within 1. level and
    difference: of prices, in the source's usual distances (75 % quantile);
    size_level and size_difference: of sizes, as a multiple of the source's median and of
    the sizes before and after. season and size_season: of the distance from the median of
    the time of day (``slot_us`` long). stuck, stuck_factor, stuck_runs: a run's
    unit is the longest expected among ``stuck_runs`` runs of the stream, times the factor,
    and at least ``stuck`` readings. per_move: readings of a run that count for each
    different value the source's other streams show meanwhile, where there are others,
    since a market at rest repeats itself. A depth level quoted twice at one moment has
    doubled units, the first and last readings of a source a quarter more, a place in the
    book that is itself more restless than the source as many times more, up to ``place``.

    steps, top, power: features are taken in ``steps`` steps a unit, up to ``top`` units, to
    that power, so that what lies within the usual range is small beside what does not.
    trees, psi: trees of a forest, and readings drawn for each out of ``trees * psi`` of
    the source that are drawn by a hash, all of them if there are fewer. trim: share of the
    drawn that stand out most and are left out, since a forest that has seen a source's
    spikes does not isolate them. quiet: points
    within the usual range added to each tree, so that a source without variation does not
    isolate the slightest. score: isolation score from which a reading is implausible.

    segment: readings of a source that are worked on in one task; its statistics, forest
    and runs are those of the whole source in any case.
    """

    reach: int = 10
    side: int = 9
    level: float = 8.0
    difference: float = 5.0
    place: float = 4.0
    size_level: float = 25.0
    size_difference: float = 15.0
    season: float = 5.0
    size_season: float = 4.0
    slot_us: int = 1_800_000_000
    stuck: int = 16
    stuck_factor: float = 1.25
    stuck_runs: int = 2000
    per_move: int = 2
    steps: int = 4
    top: float = 3.5
    power: int = 3
    trees: int = 12
    psi: int = 32
    trim: float = 0.1
    quiet: int = 12
    score: float = 0.85
    segment: int = 50_000

    @property
    def halo(self) -> int:
        return max(self.reach, self.side) + 1


@dataclass
class Piece:
    """Readings of one source in order; those from ``low`` to ``high`` are judged, the others are its neighbours."""

    field: int
    v: np.ndarray
    t: np.ndarray
    seq: np.ndarray
    stream: np.ndarray
    place: np.ndarray
    tick: float
    low: int
    high: int
    seed: int

    @property
    def own(self) -> slice:
        return slice(self.low, self.high)


@dataclass
class Facts:
    """What is known of a whole source."""

    n: int = 0
    center: float = 0.0
    offsets: tuple[np.ndarray, np.ndarray] | None = None
    bounds: dict[int, float] = field(default_factory=dict)
    edges: dict[int, tuple] = field(default_factory=dict)  # of one piece, by stream: its first and last run as a whole
    scale: float = 1.0
    spreads: tuple[np.ndarray, np.ndarray] | None = None
    seasons: tuple[np.ndarray, np.ndarray] | None = None
    season_unit: float = 1.0
    forest: Forest | None = None


# --- medians and levels


def _medians(x: np.ndarray, width: int) -> np.ndarray:
    """Median of each ``width`` (odd) values in a row."""
    return np.partition(np.lib.stride_tricks.sliding_window_view(x, width), width // 2, axis=1)[:, width // 2]


def _middle(x: np.ndarray) -> float:
    """Median of a few values, without the overhead of a general one."""
    x = np.sort(x)
    return (x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2


def _rolling_median(x: np.ndarray, reach: int) -> np.ndarray:
    """Median of each value and ``reach`` values on either side; near the ends of fewer, but of as many on either side."""
    n, width = len(x), 2 * reach + 1
    out = np.empty(n)
    if n > width:
        out[reach:-reach] = _medians(x, width)
        edge = [*range(reach), *range(n - reach, n)]
    else:
        edge = range(n)
    for i in edge:
        r = max(min(i, n - 1 - i, reach), min(3, n - 1))
        low = min(max(0, i - r), max(0, n - 1 - 2 * r))
        out[i] = _middle(x[low : low + 2 * r + 1])
    return out


def _beyond_sides(x: np.ndarray, width: int) -> np.ndarray:
    """Signed distance of each value from the levels before and after it, 0 if it lies between them.

    A level is the median of ``width`` values on that side, of fewer near the ends;
    a side with under three values has no say. So the first values of a lasting
    change lie at the level after them, while a short excursion lies off both.
    """
    n = len(x)
    before, after = np.full(n, np.nan), np.full(n, np.nan)
    if n > width:
        med = _medians(x, width)
        before[width:], after[: n - width] = med[:-1], med[1:]
    for i in range(min(n, width)):
        if i >= 3:
            before[i] = _middle(x[:i])
        j = n - 1 - i
        if i >= 3:
            after[j] = _middle(x[j + 1 :])
    low, high = np.fmin(before, after), np.fmax(before, after)
    low, high = np.where(np.isnan(low), x, low), np.where(np.isnan(high), x, high)
    return np.where(x > high, x - high, np.where(x < low, x - low, 0.0))


def _quantiles(code: np.ndarray, value: np.ndarray, weight: np.ndarray | None, share: float) -> tuple[np.ndarray, np.ndarray]:
    """The codes in order and the quantile of ``value`` in each, values counted ``weight`` times."""
    order = np.lexsort((value, code))
    c, v = code[order], value[order]
    upto = np.arange(1, len(c) + 1) if weight is None else np.cumsum(weight[order])
    start = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
    before = np.append(0, upto[start[1:] - 1])
    total = np.append(before[1:], upto[-1]) - before
    return c[start], v[np.searchsorted(upto, before + np.floor(share * (total - 1)), "right")]


def _quantile(value: np.ndarray, weight: np.ndarray | None, share: float) -> int:
    if weight is None:
        k = int(np.floor(share * (len(value) - 1)))
        return int(np.partition(value, k)[k])
    return int(_quantiles(np.zeros(len(value), dtype=np.int64), value, weight, share)[1][0])


def _bins(x: np.ndarray, width: float) -> np.ndarray:
    return np.rint(x / width).astype(np.int64)


# --- runs of equal values


@dataclass
class Runs:
    """Runs of equal values of one stream within a piece; readings recorded again at one moment count once."""

    at: np.ndarray  # positions of the stream's readings in the piece
    which: np.ndarray  # run of each
    begin: np.ndarray  # first and last position, and length, of each run
    end: np.ndarray
    length: np.ndarray


def _runs(p: Piece, stream: int) -> Runs:
    at = p.low + np.flatnonzero(p.stream[p.own] == stream)
    v, t = p.v[at], p.t[at]
    turn = np.append(True, v[1:] != v[:-1])
    fresh = turn | np.append(True, t[1:] != t[:-1])
    which = np.cumsum(turn) - 1
    first = np.flatnonzero(turn)
    return Runs(at, which, at[first], at[np.append(first[1:], len(at)) - 1], np.bincount(which, weights=fresh).astype(np.int64))


def _others(p: Piece, stream: int, low: int, high: int) -> np.ndarray:
    """Different values that other streams show between two positions."""
    part = slice(low, high)
    return np.unique(p.v[part][p.stream[part] != stream])


def _streams(p: Piece) -> list[int]:
    return [int(s) for s in np.unique(p.stream[p.own]) if s != LOOSE]


def _longest(length: np.ndarray, count: np.ndarray, lim: SpikeLimits) -> float:
    """The longest run to expect of a stream among ``stuck_runs``, were repeats independent.

    The chance of a repeat comes from the mean run length, from which runs beyond
    what it allows are taken out again, three times over.
    """
    bound = np.inf
    for _ in range(3):
        kept = length <= max(bound, 25)
        mean = max(float((length[kept] * count[kept]).sum() / count[kept].sum()), 1.0001) if kept.any() else 1.0001
        bound = np.log(lim.stuck_runs) / -np.log1p(-1 / mean)
    return float(bound)


def _run_feature(p: Piece, facts: Facts, lim: SpikeLimits) -> np.ndarray:
    """Of each own reading, the length of its run in units of what its stream shows, 0 for a run's first reading (and its repeats)."""
    out = np.zeros(len(p.v))
    for s in _streams(p):
        r = _runs(p, s)
        unit = max(lim.stuck_factor * facts.bounds[s], lim.stuck)
        length, begun = r.length.astype(float), p.t[r.begin]
        moved: dict[int, int] = {}
        if s in facts.edges:
            for k, (n, others, t0) in zip((0, len(length) - 1), facts.edges[s], strict=True):
                length[k], begun[k], moved[k] = n, t0, others
        d = length / unit
        for k in np.flatnonzero(length >= lim.stuck):
            n = moved.get(int(k), None)
            n = len(_others(p, s, r.begin[k], r.end[k])) if n is None else n
            if n:
                d[k] = min(d[k], lim.per_move * n / unit)
        out[r.at] = np.where(p.t[r.at] == begun[r.which], 0.0, d[r.which])
    return out[p.own]


# --- the stages of a source: each counts over a piece, or makes facts of the counts of all pieces


def _deviations(p: Piece, lim: SpikeLimits) -> tuple[np.ndarray, np.ndarray]:
    x = np.log(p.v)
    return x, x if p.field == TRADE_SIZE else x - _rolling_median(x, lim.reach)


def _first_counts(p: Piece, x: np.ndarray, dev: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, bin) of own readings: sizes themselves, or of prices the distance from their level by place in the book."""
    if p.field == TRADE_SIZE:
        return np.zeros(p.high - p.low, dtype=np.int64), _bins(x[p.own], COARSE)
    return p.place[p.own], _bins(np.clip(dev[p.own], -WIDEST, WIDEST), FINE)


def _first_facts(is_size: bool, code: np.ndarray, value: np.ndarray, weight: np.ndarray | None, lengths: dict[int, tuple[np.ndarray, np.ndarray]], lim: SpikeLimits) -> Facts:
    facts = Facts(n=len(value) if weight is None else int(weight.sum()))
    if is_size:
        facts.center = _quantile(value, weight, 0.5) * COARSE
    else:
        places, middle = _quantiles(code, value, weight, 0.5)
        facts.offsets = places, middle * FINE
    facts.bounds = {s: _longest(n, count, lim) for s, (n, count) in lengths.items()}
    return facts


@dataclass
class Raw:
    """Features of readings before their units are known, all arrays over own readings."""

    level: np.ndarray
    jump: np.ndarray
    x: np.ndarray
    slot: np.ndarray
    run: np.ndarray
    factor: np.ndarray
    place: np.ndarray

    def take(self, at: np.ndarray) -> Raw:
        return Raw(*(getattr(self, f.name)[at] for f in fields(self)))


def _raw(p: Piece, x: np.ndarray, dev: np.ndarray, facts: Facts, lim: SpikeLimits) -> Raw:
    n, factor = len(p.v), np.ones(len(p.v))
    if p.field == TRADE_SIZE:
        level = x - facts.center
    else:
        places, offset = facts.offsets
        off = offset[np.searchsorted(places, p.place).clip(0, len(places) - 1)]
        x, level = x - off, np.abs(dev - off)
        if p.field == L2_PRICE:
            factor = np.where(_twins(p, lim.reach), 2.0, 1.0)
        at = np.arange(n)
        begun = at if p.low < lim.halo else np.full(n, n)
        ended = at[::-1] if n - p.high < lim.halo else np.full(n, n)
        factor = np.where(np.minimum(begun, ended) < lim.side, 1.25 * factor, factor)
    jump = _beyond_sides(x, lim.side)
    slot = p.t // lim.slot_us % max(1, 86_400_000_000 // lim.slot_us)
    return Raw(level[p.own], jump[p.own], x[p.own], slot[p.own], _run_feature(p, facts, lim), factor[p.own], p.place[p.own])


def _twins(p: Piece, reach: int) -> np.ndarray:
    """Depth levels of which another price stands at one moment, within ``reach`` readings: the place was quoted twice."""
    out = np.zeros(len(p.v), dtype=bool)
    for k in range(1, min(reach, len(p.v) - 1) + 1):
        same = (p.t[k:] == p.t[:-k]) & (p.place[k:] == p.place[:-k]) & (p.v[k:] != p.v[:-k]) & (p.stream[k:] == LOOSE)
        out[k:] |= same
        out[:-k] |= same
    return out


def _priority(seq: np.ndarray) -> np.ndarray:
    """An even draw of readings: those with the lowest."""
    with np.errstate(over="ignore"):
        h = (seq.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _draw(raw: Raw, seq: np.ndarray, lim: SpikeLimits) -> np.ndarray:
    """Own readings for the forest: by a hash, of those that are not already in a run longer than expected, since a stuck value is no normal behaviour however long it lasts."""
    pool = np.flatnonzero(raw.run < 1)  # of a source, the first reading at least
    return pool[np.argsort(_priority(seq[pool]), kind="stable")[: lim.trees * lim.psi]]


def _second_facts(facts: Facts, p_field: int, tick: float, place: np.ndarray, level: np.ndarray, level_weight: np.ndarray | None, slot: np.ndarray, value: np.ndarray, weight: np.ndarray | None, lim: SpikeLimits) -> Facts:
    """Adds the usual distances, of the source and of each place in its book, and the medians of times of day."""
    slots, middle = _quantiles(slot, value, weight, 0.5)
    facts.seasons = slots, middle * COARSE
    if p_field == TRADE_SIZE:
        facts.season_unit = lim.size_season
        return facts
    price = np.exp(float(_quantile(value, weight, 0.5) * COARSE))
    floor = 0.7 * tick / price if tick > 0 else 1e-9
    facts.scale = max(_quantile(level, level_weight, 0.75) * FINE, floor, 1e-9)
    places, spread = _quantiles(place, level, level_weight, 0.75)
    facts.spreads = places, np.clip(spread * FINE / facts.scale, 1.0, lim.place)
    spread = _quantile(np.abs(value - middle[np.searchsorted(slots, slot)]), weight, 0.75) * COARSE
    facts.season_unit = lim.season * max(spread, facts.scale)
    return facts


def _features(raw: Raw, p_field: int, facts: Facts, lim: SpikeLimits) -> np.ndarray:
    if p_field == TRADE_SIZE:
        level = np.exp(np.clip(raw.level, 0, 30)) / lim.size_level
        jump = np.exp(np.clip(raw.jump, 0, 30)) / lim.size_difference
    else:
        places, spread = facts.spreads
        unit = facts.scale * raw.factor * spread[np.searchsorted(places, raw.place)]
        level, jump = raw.level / (lim.level * unit), np.abs(raw.jump) / (lim.difference * unit)
        # readings around a lasting change lie off the median of both sides, but not beyond either
        level = np.minimum(level, jump + 1)
    slots, middle = facts.seasons
    season = np.minimum(np.abs(raw.x - middle[np.searchsorted(slots, raw.slot)]) / facts.season_unit, 1)
    return np.rint(np.minimum(np.column_stack([level, jump, season, raw.run]), lim.top) * lim.steps).astype(np.int64)


def _fit(features: np.ndarray, seed: int, lim: SpikeLimits) -> Forest:
    rng = np.random.default_rng(seed)
    usual = np.argsort(features[:, [0, 1, 3]].max(axis=1), kind="stable")[: max(1, int(np.ceil(len(features) * (1 - lim.trim))))]
    features = features[usual]
    draw = rng.integers(0, len(features), (lim.trees, min(lim.psi, len(features))))
    quiet = rng.random((lim.trees, lim.quiet, features.shape[1]), dtype=np.float32)
    return Forest(np.concatenate([_raised(features[draw], lim), quiet], axis=1), seed)


def _raised(features: np.ndarray, lim: SpikeLimits) -> np.ndarray:
    return ((features / lim.steps) ** lim.power).astype(np.float32)


def _marks(p: Piece, features: np.ndarray, facts: Facts, lim: SpikeLimits) -> list[tuple[int, str, float]]:
    """(seq, reason, score) of the own readings that the forest isolates early. Readings alike in all features are scored once."""
    code = features @ (int(lim.top * lim.steps + 2) ** np.arange(features.shape[1]))
    _, one, which = np.unique(code, return_index=True, return_inverse=True)
    score = facts.forest.score(_raised(features[one], lim))[which]
    at = np.flatnonzero(score >= lim.score)
    # what sets the reading apart most
    stuck = features[at, 3] >= features[at, :2].max(axis=1)
    return [(int(p.seq[p.low + i]), "stuck" if k else "spike", float(score[i])) for i, k in zip(at, stuck, strict=True)]


def _judge(p: Piece, lim: SpikeLimits) -> list[tuple[int, str, float]]:
    """The marks of a source that is one piece."""
    x, dev = _deviations(p, lim)
    code, value = _first_counts(p, x, dev)
    lengths = {s: np.unique(_runs(p, s).length, return_counts=True) for s in _streams(p)}
    facts = _first_facts(p.field == TRADE_SIZE, code, value, None, lengths, lim)
    raw = _raw(p, x, dev, facts, lim)
    facts = _second_facts(facts, p.field, p.tick, raw.place, _level_bins(raw), None, raw.slot, _bins(raw.x, COARSE), None, lim)
    features = _features(raw, p.field, facts, lim)
    facts.forest = _fit(features[_draw(raw, p.seq[p.own], lim)], p.seed, lim)
    return _marks(p, features, facts, lim)


def _level_bins(raw: Raw) -> np.ndarray:
    return _bins(np.minimum(np.abs(raw.level), 2 * WIDEST), FINE)


# --- sources of more than one piece: the same stages, with counts summed over pieces

_COUNTS = "field int, recording_id long, ticker_id long, __tm_chunk long, stat int, code long, bin long, n long, state binary"
_MARKS = "field int, recording_id long, ticker_id long, seq long, reason string, score double"
LEVELS, LENGTHS, EDGES, DISTANCES, SEASONS, SAMPLE, KNOWN = range(7)


def _counted(table: pa.Table, rows: list[tuple[int, np.ndarray, np.ndarray]], states: list[tuple[int, bytes]]) -> pa.Table:
    out = []
    for stat, code, value in rows:
        pairs, n = np.unique(np.column_stack([code, value]), axis=0, return_counts=True)
        out += [(stat, int(c), int(v), int(k), None) for (c, v), k in zip(pairs, n, strict=True)]
    out += [(stat, None, None, None, state) for stat, state in states]
    first = {k: table.column(k)[0].as_py() for k in [*SOURCE, CHUNK]}
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    columns = [[v] * len(out) for v in first.values()] + [[r[k] for r in out] for k in range(5)]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in _COUNTS.split(", ")])


def _edge_states(p: Piece, lim: SpikeLimits) -> tuple[dict, dict[int, np.ndarray]]:
    """Of a piece: by stream, its first and last run for merging; and the lengths of the runs within.

    A run is (value, first time, last time, length, other streams' values up to its last
    reading, and up to the piece's end; from its first reading). ``None``: the piece has no reading of the stream.
    """
    states, within = {"all": {}}, {}
    streams = sorted({0, 1, *_streams(p)})
    for s in streams:
        states["all"][s] = _others(p, s, p.low, p.high)
        r = _runs(p, s) if (p.stream[p.own] == s).any() else None
        if r is None:
            continue
        one = len(r.length) == 1
        ends = []
        for k in (0, len(r.length) - 1):
            low = p.low if k == 0 else r.begin[k]
            ends.append({
                "value": p.v[r.begin[k]], "t0": int(p.t[r.begin[k]]), "t1": int(p.t[r.end[k]]), "n": int(r.length[k]),
                "upto": _others(p, s, low, r.end[k]), "own": _others(p, s, r.begin[k], r.end[k]), "rest": _others(p, s, r.begin[k], p.high),
            })
        states[s] = (one, *ends)
        within[s] = r.length[1:-1]
    return states, within


def _merge_runs(pieces: dict[int, dict], lim: SpikeLimits) -> tuple[dict[int, dict[int, tuple]], dict[int, list[int]]]:
    """Of each piece and stream, (length, others, first time) of its first and last run as wholes; and the lengths of all such runs by stream."""
    edges: dict[int, dict[int, list]] = {c: {} for c in pieces}
    lengths: dict[int, list[int]] = {}
    for s in sorted({s for states in pieces.values() for s in states if s != "all"}):
        open_run = None  # [value, t0, t1, length, others to its last reading, others since then, places to fill in]

        def close(run) -> None:
            if run is not None:
                lengths.setdefault(s, []).append(run["n"])
                for c, k in run["places"]:
                    edges[c].setdefault(s, [None, None])[k] = (run["n"], len(run["others"]), run["t0"])

        for c in sorted(pieces):
            if s not in pieces[c]:
                if open_run is not None:
                    open_run["pending"] = np.union1d(open_run["pending"], pieces[c]["all"][s])
                continue
            one, first, last = pieces[c][s]
            if open_run is not None and open_run["value"] == first["value"]:
                again = first["t0"] == open_run["t1"]  # recorded again across the border
                open_run["n"] += first["n"] - again
                open_run["others"] = np.union1d(np.union1d(open_run["others"], open_run["pending"]), first["upto"])
                open_run["pending"], open_run["t1"] = np.empty(0), first["t1"]
            else:
                close(open_run)
                open_run = {"value": first["value"], "t0": first["t0"], "t1": first["t1"], "n": first["n"], "others": first["own"], "pending": np.empty(0), "places": []}
            open_run["places"].append((c, 0))
            if one:
                open_run["places"].append((c, 1))
                open_run["pending"] = np.union1d(open_run["pending"], first["rest"])
            else:
                close(open_run)
                open_run = {"value": last["value"], "t0": last["t0"], "t1": last["t1"], "n": last["n"], "others": last["own"], "pending": last["rest"], "places": [(c, 1)]}
        close(open_run)
    return {c: {s: tuple(v) for s, v in e.items()} for c, e in edges.items()}, lengths


def _first_pass(lim: SpikeLimits):
    def run(table: pa.Table) -> pa.Table:
        p = _piece(table, lim)
        code, value = _first_counts(p, *_deviations(p, lim))
        states, within = _edge_states(p, lim)
        rows = [(LEVELS, code, value)] + [(LENGTHS, np.full(len(n), s, dtype=np.int64), n) for s, n in within.items() if len(n)]
        return _counted(table, rows, [(EDGES, pickle.dumps(states))])

    return run


def _by_stat(table: pa.Table, stat: int, *columns: str) -> list:
    part = table.filter(pa.compute.equal(table.column("stat"), stat))
    return [part.column(c).to_pylist() if c == "state" else np.asarray(part.column(c)) for c in columns]


def _first_merge(lim: SpikeLimits):
    def run(table: pa.Table) -> pa.Table:
        edges, inner = _merge_runs({c: pickle.loads(s) for c, s in zip(*_by_stat(table, EDGES, CHUNK, "state"), strict=True)}, lim)
        stream, length, count = _by_stat(table, LENGTHS, "code", "bin", "n")
        lengths = {}
        for s in {*inner, *stream.tolist()}:
            own = np.array(inner.get(s, []), dtype=np.int64)
            lengths[s] = np.append(length[stream == s], own), np.append(count[stream == s], np.ones(len(own), dtype=np.int64))
        facts = _first_facts(table.column("field")[0].as_py() == TRADE_SIZE, *_by_stat(table, LEVELS, "code", "bin", "n"), lengths, lim)
        return _known(table, facts, edges)

    return run


def _known(table: pa.Table, facts: Facts, edges: dict[int, dict[int, tuple]]) -> pa.Table:
    """The facts for each piece of the source, with the runs that are its own."""
    out = []
    for c, own in edges.items():
        facts.edges = own
        one = _counted(table, [], [(KNOWN, pickle.dumps(facts))])
        out.append(one.set_column(3, CHUNK, pa.array([c], pa.int64())))
    return pa.concat_tables(out)


def _second_pass(lim: SpikeLimits):
    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        p, facts = _piece(table, lim), pickle.loads(known.column("state")[0].as_py())
        raw = _raw(p, *_deviations(p, lim), facts, lim)
        rows = [(SEASONS, raw.slot, _bins(raw.x, COARSE))]
        if p.field != TRADE_SIZE:
            rows.append((DISTANCES, raw.place, _level_bins(raw)))
        seq = p.seq[p.own]
        at = _draw(raw, seq, lim)
        # few of a long source can be among the lowest
        share = 4 * lim.trees * lim.psi / max(facts.n, 1)
        if share < 1:
            at = at[_priority(seq[at]) < np.uint64(share * 2**63) * np.uint64(2)]
        sample = (_priority(seq[at]), raw.take(at), p.tick)
        return _counted(table, rows, [(SAMPLE, pickle.dumps(sample))])

    return run


def _second_merge(lim: SpikeLimits):
    def run(table: pa.Table) -> pa.Table:
        chunks, states = _by_stat(table, KNOWN, CHUNK, "state")
        known = {c: pickle.loads(s) for c, s in zip(chunks, states, strict=True)}
        facts, kind = next(iter(known.values())), table.column("field")[0].as_py()
        samples = [pickle.loads(s) for s in _by_stat(table, SAMPLE, "state")[0]]
        facts = _second_facts(facts, kind, samples[0][2], *_by_stat(table, DISTANCES, "code", "bin", "n"), *_by_stat(table, SEASONS, "code", "bin", "n"), lim)
        priority = np.concatenate([s[0] for s in samples])
        pool = Raw(*(np.concatenate([getattr(s[1], name) for s in samples]) for name in (f.name for f in fields(Raw))))
        lowest = np.argsort(priority, kind="stable")[: lim.trees * lim.psi]
        facts.forest = _fit(_features(pool.take(lowest), kind, facts, lim), _seed(table.column("ticker_id")[0].as_py()), lim)
        return _known(table, facts, {c: f.edges for c, f in known.items()})

    return run


def _third_pass(lim: SpikeLimits):
    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        p, facts = _piece(table, lim), pickle.loads(known.column("state")[0].as_py())
        raw = _raw(p, *_deviations(p, lim), facts, lim)
        return _marked(table, _marks(p, _features(raw, p.field, facts, lim), facts, lim))

    return run


# --- from tables to pieces and back


def _seed(ticker: int | None) -> int:
    return (ticker or 0) % 2**31


def _piece(table: pa.Table, lim: SpikeLimits) -> Piece:
    """A piece of the rows of one group, put in order."""
    if IDX in table.column_names:
        table = table.sort_by(IDX)
        at = np.asarray(table.column(IDX))
        own = np.flatnonzero(at // lim.segment == table.column(CHUNK)[0].as_py())
        low, high = int(own[0]), int(own[-1]) + 1
    else:
        low, high = 0, table.num_rows
    kind, ticker, tick = (table.column(c)[0].as_py() for c in ("field", "ticker_id", "tick"))
    cols = [np.asarray(table.column(c)) for c in ("v", "t", "seq", "stream", "place")]
    return Piece(kind, *cols, tick or 0.0, low, high, _seed(ticker))


def _marked(table: pa.Table, marks: list[tuple[int, str, float]]) -> pa.Table:
    n = len(marks)
    first = [table.column(k)[0].as_py() for k in SOURCE]
    cols = [pa.array([v] * n, t) for v, t in zip(first, (pa.int32(), pa.int64(), pa.int64()), strict=True)]
    cols += [pa.array([m[k] for m in marks], t) for k, t in ((0, pa.int64()), (1, pa.string()), (2, pa.float64()))]
    return pa.table(cols, names=[c.split()[0] for c in _MARKS.split(", ")])


#: Of a row that is no mark yet: a reading of a source that may go on elsewhere.
_OPEN = "v double, t long, stream int, place long, tick double"


def _whole_sources(lim: SpikeLimits):
    """Judges the sources that lie whole in a sorted partition; readings of its first and last source, and of one longer than a segment, are passed on."""
    mark_names, open_names = ([c.split()[0] for c in s.split(", ")] for s in (_MARKS, _OPEN))

    def passed(table: pa.Table) -> Iterator[pa.RecordBatch]:
        n = table.num_rows
        given = {"reason": pa.nulls(n, pa.string()), "score": pa.nulls(n, pa.float64())}
        out = pa.table([given[c] if c in given else table.column(c) for c in [*mark_names, *open_names]], names=[*mark_names, *open_names])
        yield from out.combine_chunks().to_batches()

    def judged(table: pa.Table) -> Iterator[pa.RecordBatch]:
        marks = _marked(table, _judge(_piece(table.combine_chunks(), lim), lim))
        for c, t in zip(open_names, (pa.float64(), pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True):
            marks = marks.append_column(c, pa.nulls(marks.num_rows, t))
        yield from marks.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        whole = False  # whether the source held began in this partition and is short enough so far
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            starts = np.flatnonzero(new_run([table.column(k) for k in SOURCE]))
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                yield from judged(table.slice(a, b - a)) if whole else passed(table.slice(a, b - a))
                whole = True
            held = table.slice(starts[-1])
            if not whole or held.num_rows > lim.segment:
                yield from passed(held.slice(0, held.num_rows - 1))
                held, whole = held.slice(held.num_rows - 1), False
        if held is not None:
            yield from passed(held)

    return run


def _lone_pieces(lim: SpikeLimits):
    """Judges the sources of one piece among sorted pieces."""

    def judged(table: pa.Table) -> Iterator[pa.RecordBatch]:
        at, chunk = table.column(IDX), table.column(CHUNK)[0].as_py()
        if chunk == 0 and pa.compute.max(at).as_py() < lim.segment:
            yield from _marked(table, _judge(_piece(table.combine_chunks(), lim), lim)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            starts = np.flatnonzero(new_run([table.column(k) for k in [*SOURCE, CHUNK]]))
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                yield from judged(table.slice(a, b - a))
            held = table.slice(starts[-1]).to_batches()
        if held:
            yield from judged(pa.Table.from_batches(held))

    return run


def _timed(df: DataFrame, time: str) -> DataFrame:
    """``df`` with ``t``: its time, or for a row without one the latest time known among the rows of its recording that arrived before its block of ``ARRIVALS`` (or within it, for the first block; 0 if none is known).

    Blocks are reduced before anything is shuffled, and scanned in two steps, so a
    recording of any length takes bounded windows.
    """
    if not df.where(F.col(time).isNull()).head(1):  # which the statistics of files tell at once
        return df.withColumn("t", F.col(time))
    block, far = F.floor(F.coalesce("seq", F.lit(0)) / F.lit(ARRIVALS)), F.floor(F.col("__tm_b") / F.lit(4096))
    blocks = df.groupBy(F.col("recording_id").alias("__tm_r"), block.alias("__tm_b")).agg(F.max(time).alias("__tm_top"), F.count_if(F.col(time).isNull()).alias("__tm_gaps")).withColumn("__tm_far", far)
    past = (Window.unboundedPreceding, -1)
    inner = F.last("__tm_top", ignorenulls=True).over(Window.partitionBy("__tm_r", "__tm_far").orderBy("__tm_b").rowsBetween(*past))
    tops = blocks.groupBy("__tm_r", "__tm_far").agg(F.max_by("__tm_top", F.when(F.col("__tm_top").isNotNull(), F.col("__tm_b"))).alias("__tm_last"))
    outer = F.last("__tm_last", ignorenulls=True).over(Window.partitionBy("__tm_r").orderBy("__tm_far").rowsBetween(*past))
    tops = tops.select(F.col("__tm_r").alias("__tm_r2"), F.col("__tm_far").alias("__tm_far2"), outer.alias("__tm_outer"))
    gaps = blocks.withColumn("__tm_inner", inner).where("__tm_gaps > 0")
    gaps = gaps.join(tops, gaps["__tm_r"].eqNullSafe(tops["__tm_r2"]) & (F.col("__tm_far") == F.col("__tm_far2")), "left")
    filled = gaps.select("__tm_r", "__tm_b", F.coalesce("__tm_inner", "__tm_outer", "__tm_top", F.lit(0)).alias("__tm_t"))
    late = df.where(F.col(time).isNull()).withColumn("__tm_own", block)
    late = late.join(filled, F.col("recording_id").eqNullSafe(F.col("__tm_r")) & (F.col("__tm_own") == F.col("__tm_b")), "left")
    names = df.columns
    return df.where(F.col(time).isNotNull()).select(*names, F.col(time).alias("t")).unionByName(late.select(*names, F.col("__tm_t").alias("t")))


def implausible_readings(trades: DataFrame, l2: DataFrame, instruments: DataFrame, limits: SpikeLimits | None = None) -> DataFrame:
    """Implausible readings of trades.price, trades.size and l2.price: a row each, with ``reason`` and isolation ``score``.

    Result: ``feed`` ('trade' or 'l2'), ``recording_id``, ``ticker_id``, ``seq``, ``field``
    ('price' or 'size'), ``reason`` and ``score``. Reasons: 'physical' (not finite, or not
    above zero; an explicit rule, score 1); of readings whose score reaches
    ``limits.score``: 'stuck' if the run feature sets them apart most, else 'spike'. The
    first reading of a run is not stuck. Repeated rows each get their mark.

    Nulls, and prices of deletes (operation 2), are no readings. A row without a time
    is placed by its arrival, see ``_timed``. Rows without a recording or ticker form
    sources of their own. An empty table gives no marks. Instruments give the tick, a
    lower bound for usual distances; an unknown ticker has none. Other columns are ignored.

    Readings are range-partitioned by (source, time). Sources that lie whole in a
    partition, nearly all, are judged there. Those cut by a border between partitions, and
    those longer than ``segment``, are numbered and cut into pieces of that many
    readings; the counts of pieces are summed, so that medians, quantiles, runs and the
    forest are the whole source's, then each piece is scored. Marks do not depend on
    ``segment`` or on the partitions, and no task holds more than a piece.
    """
    lim = limits or SpikeLimits()
    none = F.lit(None)
    good = ~F.isnan("v") & (F.abs("v") < float("inf")) & (F.col("v") > 0)
    a = _timed(trades.select("recording_id", "ticker_id", "timestamp_us", "seq", "price", "size").where("price IS NOT NULL OR size IS NOT NULL"), "timestamp_us")
    values = F.array(F.struct(F.lit(TRADE_PRICE).alias("field"), F.col("price").cast("double").alias("v")), F.struct(F.lit(TRADE_SIZE).alias("field"), F.col("size").cast("double").alias("v")))
    a = a.select("recording_id", "ticker_id", "t", "seq", F.explode(values).alias("e")).select("e.field", "recording_id", "ticker_id", "t", "seq", "e.v", F.lit(0).alias("stream"), F.lit(0).cast("long").alias("place"))
    b = _timed(l2.where("price IS NOT NULL AND NOT coalesce(operation = 2, false)").select("recording_id", "ticker_id", "timestamp", "seq", "price", "kind", "side", "position"), "timestamp")
    side = F.coalesce("side", F.lit(7))
    b = b.select(
        F.lit(L2_PRICE).alias("field"), "recording_id", "ticker_id", "t", "seq", F.col("price").cast("double").alias("v"),
        F.when(F.col("kind") == 1, side).otherwise(LOOSE).cast("int").alias("stream"),
        ((F.coalesce("kind", F.lit(-1)) * 8 + side).cast("long") * 100_000 + F.coalesce("position", F.lit(-1))).alias("place"),
    )
    kinds = {"recording_id": F.col("recording_id").cast("long"), "ticker_id": F.col("ticker_id").cast("long"), "t": F.col("t").cast("long"), "seq": F.coalesce(F.col("seq").cast("long"), F.lit(0))}
    readings = a.unionByName(b).where("v IS NOT NULL").withColumns(kinds)
    physical = readings.where(~good).select(*SOURCE, "seq", F.lit("physical").alias("reason"), F.lit(1.0).alias("score"))
    ticks = instruments.where("ticker_id IS NOT NULL").groupBy(F.col("ticker_id").cast("long").alias("ticker_id")).agg(F.max("tick_size").cast("double").alias("tick"))
    usable = readings.where(good).join(ticks, "ticker_id", "left").select(*SOURCE, "seq", "t", "v", "stream", "place", "tick")

    order = ["t", "seq", "place", "v"]
    ranged = usable.repartitionByRange(part_count(readings), *SOURCE, *order).sortWithinPartitions(*SOURCE, *order)
    # written, since the sources that are not whole in a partition must be those of one and the same partitioning
    first = written(ranged.mapInArrow(_whole_sources(lim), f"{_MARKS}, {_OPEN}"), "spikes")
    marks = first.where("reason IS NOT NULL").select(*SOURCE, "seq", "reason", "score")
    rest = first.where("reason IS NULL").select(*SOURCE, "seq", "t", "v", "stream", "place", "tick")

    numbered = number_rows(rest, SOURCE, order)
    pieces = _with_halo(numbered, lim)
    tasks = pieces.repartition(task_count(trades.sparkSession), *SOURCE, CHUNK).sortWithinPartitions(*SOURCE, CHUNK, IDX)
    marks = marks.unionByName(tasks.mapInArrow(_lone_pieces(lim), _MARKS))
    if numbered.where(F.col(IDX) >= lim.segment).head(1):
        marks = marks.unionByName(_long_sources(numbered, pieces, lim))
    feed, name = F.when(F.col("field") == L2_PRICE, "l2").otherwise("trade"), F.when(F.col("field") == TRADE_SIZE, "size").otherwise("price")
    return marks.unionByName(physical).select(feed.alias("feed"), "recording_id", "ticker_id", "seq", name.alias("field"), "reason", "score")


def _with_halo(numbered: DataFrame, lim: SpikeLimits) -> DataFrame:
    """Each row once for its own piece, and again for a neighbouring one within ``halo`` of it."""
    own = F.floor(F.col(IDX) / F.lit(lim.segment)).cast("long")
    low, high = (F.floor((F.col(IDX) + k) / F.lit(lim.segment)).cast("long") for k in (-lim.halo, lim.halo))
    near = F.array_distinct(F.array(own, F.greatest(low, F.lit(0).cast("long")), high))
    return numbered.withColumn(CHUNK, F.explode(near))


def _long_sources(numbered: DataFrame, pieces: DataFrame, lim: SpikeLimits) -> DataFrame:
    """Marks of the sources of several pieces, by the stages that ``_judge`` takes at once."""
    keys = [F.col(c) for c in [*SOURCE, CHUNK]]
    long = numbered.where(F.col(IDX) == lim.segment).select(*(F.col(c).alias(f"__tm_{c}") for c in SOURCE))
    same = F.lit(True)
    for c in SOURCE:
        same = same & F.col(c).eqNullSafe(F.col(f"__tm_{c}"))
    mine = pieces.join(long, same, "left_semi")
    # a source's last rows lie in the halo of a piece that has no row of its own
    mine = mine.withColumn("__tm_top", F.max(IDX).over(Window.partitionBy(*SOURCE, CHUNK))).where(F.col(CHUNK) * lim.segment <= F.col("__tm_top")).drop("__tm_top")

    def summed(counts: DataFrame, *stats: int) -> DataFrame:
        part = counts.where(F.col("stat").isin(*stats)).groupBy(*SOURCE, "stat", "code", "bin").agg(F.sum("n").alias("n"))
        return part.select(*SOURCE, F.lit(0).cast("long").alias(CHUNK), "stat", "code", "bin", "n", F.lit(None).cast("binary").alias("state"))

    one = written(mine.groupBy(*keys).applyInArrow(_first_pass(lim), _COUNTS), "spikes-first")
    known = summed(one, LEVELS, LENGTHS).unionByName(one.where(F.col("stat") == EDGES)).groupBy(*SOURCE).applyInArrow(_first_merge(lim), _COUNTS)
    known = written(known, "spikes-known")
    two = written(mine.groupBy(*keys).cogroup(known.groupBy(*keys)).applyInArrow(_second_pass(lim), _COUNTS), "spikes-second")
    parts = summed(two, DISTANCES, SEASONS).unionByName(two.where(F.col("stat") == SAMPLE)).unionByName(known)
    known = written(parts.groupBy(*SOURCE).applyInArrow(_second_merge(lim), _COUNTS), "spikes-fitted")
    return mine.groupBy(*keys).cogroup(known.groupBy(*keys)).applyInArrow(_third_pass(lim), _MARKS)
