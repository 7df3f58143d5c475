"""Implausible readings flagged per source of measurement, relative to its own normal behaviour.

A hidden Markov model per series has the states normal, spike, stuck and out of range. Emissions come from the
log-ratio to the series' median and from equality with the neighbouring visits. What is normal is learned per series: its
spread, how often its normal values repeat, and its transition rates come from a few steps of expectation and
maximisation that start from, and are held by, common values. Forward-backward probabilities then assign the flags; a
hard bound settles only what is impossible.

A series of up to ``LONG`` records is judged whole in one task, after one shuffle of the records. Longer ones, of which
there are at most rows / LONG, are ranked block by block and cut into chunks of visits that spread over all tasks; their
median comes from cumulative frequencies and their statistics are summed over the chunks. Both ways cut the same
chunks with the same margins, and within a task all chunks run through the recursions together as numpy arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.operators import frequencies
from freshet.session import join_dictionary, reliable_checkpoint

#: Factor to the median from which a reading is out of range, and visits of one value that count as stuck.
FACTOR, RUN = 8.0, 6
#: Visits in a chunk, and visits of margin on either side (at least RUN - 1; more lets the model forget its start).
CHUNK, MARGIN = 512, 32
#: Records of a series beyond which it is cut over several tasks, and visit numbers in a block used to rank its visits.
LONG, BLOCK = 100_000, 4096
#: Rows that one pass of the recursions holds at least.
PASS_ROWS = 150_000
#: Steps of expectation and maximisation, and the weight in records of the common values that hold the learned ones.
STEPS, HOLD = 2, 30.0
#: Probability of not being normal from which a visit is a candidate for an exact check (see ``found``).
CANDIDATE = 0.0001

NORMAL, SPIKE, STUCK, OUT = range(4)
SIGMA, SAME = 0.45, 0.06
START = np.array([0.96, 0.015, 0.015, 0.01])
STEP = np.array([[0.983, 0.010, 0.004, 0.003], [0.90, 0.09, 0.005, 0.005], [0.06, 0.005, 0.93, 0.005], [0.90, 0.02, 0.01, 0.07]])
# Bounds of what is learned. They keep the doubt about six equal visits, and about a reading beyond the factor, above CANDIDATE
# whatever a series is like: (0.97 / 0.6) ** 6 * 0.002 * 0.02 * 0.8 ** 5, and 0.002 * 0.05 over the normal density at log 8.
SIGMA_RANGE, SAME_RANGE = (0.05, 1.0), (0.005, 0.6)
STEP_LEAST = np.array([[0.5, 0.002, 0.002, 0.002], [0.05, 0.002, 0.002, 0.002], [0.02, 0.002, 0.8, 0.002], [0.05, 0.002, 0.002, 0.002]])


class Model:
    """Parameters of many series: ``sigma``, ``same`` (one each) and ``step`` (four by four each)."""

    def __init__(self, sigma: np.ndarray, same: np.ndarray, step: np.ndarray):
        self.sigma, self.same, self.step = sigma, same, step

    @classmethod
    def learned(cls, sums: np.ndarray) -> Model:
        """From the sums of ``expectations`` of each series (rows of 19)."""
        w, x2, same = sums[:, 0], sums[:, 1], sums[:, 2]
        sigma = np.clip(np.sqrt((HOLD * SIGMA**2 + x2) / (HOLD + w)), *SIGMA_RANGE)
        step = HOLD * STEP + sums[:, 3:].reshape(-1, 4, 4)
        step = np.maximum(step / step.sum(2, keepdims=True), STEP_LEAST)
        return cls(sigma, np.clip((HOLD * SAME + same) / (HOLD + w), *SAME_RANGE), step / step.sum(2, keepdims=True))


def log_ratio(value: np.ndarray, median: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        x = np.log(value / median)
    return np.where(value == median, 0.0, np.where(np.isfinite(x) | (x == np.inf), np.clip(x, -12, 12), -12))


def emissions(x: np.ndarray, same: np.ndarray, sigma: np.ndarray, usual_same: np.ndarray, factor: float = FACTOR) -> np.ndarray:
    """Likelihood of each reading in each state; ``same``: equal to a neighbouring visit, as happens normally at a rate of ``usual_same``."""
    wide = 1 / 24
    e = np.empty((len(x), 4))
    usual = np.exp(-0.5 * (x / sigma) ** 2) / (sigma * 2.5066)
    repeat = np.where(same, usual_same, 1 - usual_same)
    e[:, NORMAL] = usual * repeat
    e[:, SPIKE] = wide * repeat
    e[:, STUCK] = np.maximum(usual, wide) * np.where(same, 0.97, 0.03)
    e[:, OUT] = np.where(np.abs(x) > np.log(factor), 1.0, 1e-6) * repeat
    return np.maximum(e, 1e-12)


def posteriors(e: np.ndarray, first: np.ndarray, size: np.ndarray, step: np.ndarray | None = None, core: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over many sequences at once (``first`` row and ``size`` of each), scaled at each row.

    Returns the state probabilities of each row, and of each sequence the expected transitions into its ``core`` rows.
    """
    order = np.argsort(-size, kind="stable")
    step = np.broadcast_to(STEP, (len(size), 4, 4)) if step is None else step
    core = np.ones(len(e), bool) if core is None else core
    first, size, step = first[order], size[order], np.ascontiguousarray(step[order])
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), "left")  # sequences longer than t
    forward = np.empty_like(e)
    a = np.empty((len(size), 4))
    for t in range(longest):
        n = active[t]
        at = first[:n] + t
        a = (START if t == 0 else np.einsum("ni,nij->nj", a[:n], step[:n])) * e[at]
        a /= a.sum(1, keepdims=True)
        forward[at] = a
    post = np.empty_like(e)
    moves = np.zeros((len(size), 4, 4))
    b = np.ones((len(size), 4))
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = first[:n] + t
        p = forward[at] * b[:n]
        post[at] = p / p.sum(1, keepdims=True)
        weighed = e[at] * b[:n]
        if t:
            xi = forward[at - 1][:, :, None] * step[:n] * weighed[:, None, :]
            moves[:n] += xi * (core[at] / xi.sum((1, 2)))[:, None, None]
        nb = np.einsum("nij,nj->ni", step[:n], weighed)
        b[:n] = nb / nb.sum(1, keepdims=True)
    back = np.empty_like(moves)
    back[order] = moves
    return post, back


class Chunks:
    """Rows of many chunks, consecutive and in order of visits; ``series`` numbers the series of each chunk, ``core`` marks rows that are no margin."""

    def __init__(self, chunk: np.ndarray, value: np.ndarray, median: np.ndarray, core: np.ndarray, series: np.ndarray):
        self.value, self.median, self.core = value, median, core
        self.first = np.flatnonzero(np.concatenate((np.ones(min(1, len(chunk)), bool), chunk[1:] != chunk[:-1])))
        self.size = np.diff(np.concatenate((self.first, [len(chunk)])))
        self.series = series[self.first]  # one per chunk
        self.row_series = np.repeat(self.series, self.size)
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (chunk[1:] != chunk[:-1])
        ids = np.cumsum(new) - 1
        self.length = np.bincount(ids)[ids] if len(ids) else np.zeros(0, np.int64)
        self.same = self.length > 1
        self.x = log_ratio(value, median)

    def run(self, model: Model, factor: float) -> tuple[np.ndarray, np.ndarray]:
        e = emissions(self.x, self.same, model.sigma[self.row_series], model.same[self.row_series], factor)
        return posteriors(e, self.first, self.size, model.step[self.series], self.core)

    def expectations(self, model: Model, factor: float) -> np.ndarray:
        """Per series: weight, squared log-ratio and repeats of the normal rows, and the expected transitions."""
        post, moves = self.run(model, factor)
        w = post[:, NORMAL] * self.core
        n = len(model.sigma)
        count = lambda v: np.bincount(self.row_series, v, n)
        sums = np.zeros((n, 16))
        np.add.at(sums, self.series, moves.reshape(-1, 16))
        return np.column_stack((count(w), count(w * self.x**2), count(w * self.same), sums))

    def first_look(self, n: int) -> np.ndarray:
        """Sums like those of ``expectations`` in which every row is normal: the share of repeats, with common spread and transitions."""
        count = lambda v: np.bincount(self.row_series, v * self.core, n)
        return np.column_stack((count(np.ones(len(self.x))), count(np.full(len(self.x), SIGMA**2)), count(self.same), np.zeros((n, 16))))

    def judge(self, model: Model, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Per row the flag (0 none, 1 spike, 2 stuck, 3 out of range) and the probability of not being normal."""
        post, _ = self.run(model, factor)
        impossible = self.value < 0
        flag = np.select([impossible | (post[:, OUT] > 0.5), post[:, STUCK] > 0.5, post[:, SPIKE] > 0.5], [3, 2, 1], 0)
        return flag, np.where(impossible, 1.0, 1 - post[:, NORMAL])


def learn(chunks: Chunks, n: int, factor: float, steps: int = STEPS) -> Model:
    """The models of ``n`` whole series."""
    model = Model.learned(chunks.first_look(n))
    for _ in range(steps):
        model = Model.learned(chunks.expectations(model, factor))
    return model


def weighted_medians(series: np.ndarray, value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Median of each series (numbered from 0, in order), each value counted ``weight`` times."""
    order = np.lexsort((value, series))
    upto = np.cumsum(weight[order])
    total = np.bincount(series, weight).astype(np.int64)
    before = np.cumsum(total) - total
    pick = lambda rank: value[order][np.searchsorted(upto, before + rank)]
    return (pick((total + 1) // 2) + pick(total // 2 + 1)) / 2


def windows(size: np.ndarray, chunk: int, margin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, chunk, core) of all rows of series of these sizes laid end to end, cut into chunks with margins on both sides."""
    parts = np.maximum(1, -(-size // chunk))
    series = np.repeat(np.arange(len(size)), parts)
    at = (np.arange(len(series)) - np.repeat(np.cumsum(parts) - parts, parts)) * chunk
    begin, end = np.maximum(at - margin, 0), np.minimum(at + chunk + margin, size[series])
    n = end - begin
    start = (np.cumsum(size) - size)[series]
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
    core = (inner >= np.repeat(at, n)) & (inner < np.repeat(at + chunk, n))
    return inner + np.repeat(start, n), np.repeat(np.arange(len(series)), n), core


def _changes(t: pa.Table, names: list[str]) -> np.ndarray:
    """True where a row differs from the one before in any of the columns; the first row always."""
    new = np.ones(t.num_rows, bool)
    new[1:] = False
    for c in names:
        a = t[c].combine_chunks() if isinstance(t[c], pa.ChunkedArray) else t[c]
        new[1:] |= pc.not_equal(a.slice(1), a.slice(0, len(a) - 1)).to_numpy(zero_copy_only=False)
    return new


def _by_whole(batches: Iterator[pa.RecordBatch], names: list[str], least: int) -> Iterator[pa.Table]:
    """Tables of at least ``least`` rows that never part rows equal in ``names`` (batches come sorted by them)."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows >= least:
            t = pa.Table.from_batches(held).combine_chunks()
            cut = int(np.flatnonzero(_changes(t, names))[-1])
            if cut:
                yield t.slice(0, cut)
                held = t.slice(cut).to_batches()
                rows -= cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


_FLAGS = "flag int, doubt double, run_length bigint, median double"
_SERIES = ["station_id", "ion"]


def _with_flags(t: pa.Table, flag: np.ndarray, doubt: np.ndarray, length: np.ndarray, median: np.ndarray) -> Iterator[pa.RecordBatch]:
    cols = (flag.astype(np.int32), doubt.astype(float), length.astype(np.int64), median.astype(float))
    for name, c in zip(("flag", "doubt", "run_length", "median"), cols):
        t = t.append_column(name, pa.array(c))
    return iter(t.to_batches())


def _judge_whole(factor: float, chunk: int, margin: int, least_doubt: float, names: list[str]):
    """Over records sorted by series, visit and value: those of flagged visits (every record of them), with flag, doubt, run length and median."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_whole(batches, _SERIES, PASS_ROWS):
            new = _changes(t, _SERIES)
            number = np.cumsum(new) - 1
            value, visit = t["value"].to_numpy(), t["visit_no"].to_numpy()
            fresh = new.copy()
            fresh[1:] |= (visit[1:] != visit[:-1]) | (value[1:] != value[:-1])
            of = np.cumsum(fresh) - 1  # visit value of each record
            series, v = number[fresh], value[fresh]
            n = int(number[-1]) + 1
            median = weighted_medians(series, v, np.bincount(of))
            row, part, core = windows(np.bincount(series, minlength=n), chunk, margin)
            c = Chunks(part, v[row], median[series[row]], core, series[row])
            flag, doubt = c.judge(learn(c, n, factor), factor)
            back = np.empty(len(v), np.int64)
            back[row[core]] = np.flatnonzero(core)
            keep = np.flatnonzero((flag > 0) | (doubt >= least_doubt))
            wanted = np.zeros(len(flag), bool)
            wanted[keep] = True
            hit = np.flatnonzero(wanted[back[of]])
            at = back[of[hit]]
            yield from _with_flags(t.select(names).take(pa.array(hit)), flag[at], doubt[at], c.length[at], median[number[hit]])

    return go


def _piece(t: pa.Table) -> tuple[Chunks, Model | None, np.ndarray]:
    """Chunks of long series with the model that came with each row (none at first), and the first row of each chunk."""
    new = _changes(t, [*_SERIES, "part"])
    number = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    c = Chunks(number, t["value"].to_numpy(), t["median"].to_numpy(), t["core"].to_numpy(zero_copy_only=False), number)
    head = t.take(pa.array(first))
    if head["sigma"].null_count:
        return c, None, first
    return c, Model(head["sigma"].to_numpy(), head["same"].to_numpy(), np.array(head["step"].to_pylist(), float).reshape(-1, 4, 4)), first


def _sum_pieces(factor: float):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_whole(batches, [*_SERIES, "part"], PASS_ROWS):
            c, model, first = _piece(t)
            sums = c.expectations(model, factor) if model else c.first_look(len(first))
            yield from t.select(_SERIES).take(pa.array(first)).append_column("sums", pa.array(sums.tolist(), pa.list_(pa.float64()))).to_batches()

    return go


def _judge_pieces(factor: float, least_doubt: float):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_whole(batches, [*_SERIES, "part"], PASS_ROWS):
            c, model, _ = _piece(t)
            flag, doubt = c.judge(model, factor)
            keep = np.flatnonzero(((flag > 0) | (doubt >= least_doubt)) & c.core)
            yield from _with_flags(t.select([*_SERIES, "visit_no", "value"]).take(pa.array(keep)), flag[keep], doubt[keep], c.length[keep], c.median[keep])

    return go


def _learned_frame(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            m = Model.learned(np.array(pdf["sums"].tolist(), float))
            yield pd.DataFrame({"station_id": pdf["station_id"], "ion": pdf["ion"], "sigma": m.sigma, "same": m.same, "step": m.step.reshape(-1, 16).tolist()})


def judged(df: DataFrame, *keys: str) -> DataFrame:
    """Records that are judged: with station, ion, visit and a number, not below detection. Zero of either sign is one value."""
    v = F.col("value_mg_L")
    rows = df.filter(F.col("ion").isNotNull() & F.col("station_id").isNotNull() & F.col("visit_no").isNotNull() & v.isNotNull() & ~F.isnan(v) & (F.col("below_detection") == F.lit(False)))
    return rows.select(*keys, "station_id", "ion", F.col("visit_no").cast("bigint").alias("visit_no"), (v.cast("double") + F.lit(0.0)).alias("value"))


def long_series(rows: DataFrame, long: int) -> DataFrame:
    """``station_id, ion`` of the series of more than ``long`` records: at most rows / long of them."""
    return rows.groupBy(*_SERIES).agg(F.count("*").alias("n")).filter(F.col("n") > long).select(F.col("station_id").alias("__s"), F.col("ion").alias("__i"), F.lit(True).alias("__long"))


def _split(rows: DataFrame, long: int) -> tuple[DataFrame, DataFrame, bool]:
    """(records of short series, records of long ones, whether there are any of the latter)."""
    hot = reliable_checkpoint(long_series(rows, long))
    if hot.isEmpty():
        return rows, rows.limit(0), False
    marked = join_dictionary(rows, hot, (F.col("station_id") == F.col("__s")) & (F.col("ion") == F.col("__i")), "left")
    return marked.filter(F.col("__long").isNull()).select(*rows.columns), marked.filter(F.col("__long").isNotNull()).select(*rows.columns), True


def _flag_long(rows: DataFrame, factor: float, chunk: int, margin: int, block: int, least_doubt: float) -> DataFrame:
    """Flagged visit values of long series: ``station_id, ion, visit_no, value`` and the flag columns."""
    visits = reliable_checkpoint(rows.groupBy(*_SERIES, "visit_no", "value").agg(F.count("*").alias("n")))
    state = reliable_checkpoint(visits.groupBy(*_SERIES, "value").agg(F.sum("n").alias("n")))
    visits = join_dictionary(visits.withColumn("b", F.floor(F.col("visit_no") / block)), frequencies.medians(state, _SERIES).select(*_SERIES, "median"), _SERIES)
    # Rank the visits block by block, add the rows of the blocks before, cut by rank, copy the margins to both neighbours.
    counts = visits.groupBy(*_SERIES, "b").agg(F.count("*").alias("m"))
    before = counts.select(*_SERIES, "b", (F.sum("m").over(Window.partitionBy(*_SERIES).orderBy("b")) - F.col("m")).alias("before"))
    inside = Window.partitionBy(*_SERIES, "b").orderBy("visit_no", "value")
    ranked = join_dictionary(visits, before, [*_SERIES, "b"]).withColumn("r", F.col("before") + F.row_number().over(inside) - 1)
    home = F.floor(F.col("r") / chunk)
    parts = F.array_distinct(F.array(home, F.greatest(F.floor((F.col("r") - margin) / chunk), F.lit(0)), F.floor((F.col("r") + margin) / chunk)))
    pieces = ranked.withColumn("home", home).withColumn("part", F.explode(parts)).select(*_SERIES, "visit_no", "value", "median", "part", (F.col("part") == F.col("home")).alias("core"))
    # A last part may hold margin rows alone; it judges nothing.
    pieces = reliable_checkpoint(pieces.repartition(*_SERIES, "part").sortWithinPartitions(*_SERIES, "part", "visit_no", "value"))
    none = pieces.withColumns({"sigma": F.lit(None).cast("double"), "same": F.lit(None).cast("double"), "step": F.lit(None).cast("array<double>")})
    now = none
    for _ in range(STEPS + 1):
        sums = now.mapInArrow(_sum_pieces(factor), "station_id string, ion string, sums array<double>")
        total = sums.groupBy(*_SERIES).agg(F.array(*[F.sum(F.get("sums", F.lit(k))) for k in range(19)]).alias("sums"))
        model = reliable_checkpoint(total.mapInPandas(_learned_frame, "station_id string, ion string, sigma double, same double, step array<double>"))
        now = join_dictionary(pieces, model, _SERIES).repartition(*_SERIES, "part").sortWithinPartitions(*_SERIES, "part", "visit_no", "value").select(*none.columns)
    return now.mapInArrow(_judge_pieces(factor, least_doubt), f"station_id string, ion string, visit_no bigint, value double, {_FLAGS}")


def _check(margin: int) -> None:
    if margin < RUN - 1:
        raise ValueError("the margin must hold a run")


def flag_visits(df: DataFrame, factor: float = FACTOR, chunk: int = CHUNK, margin: int = MARGIN, long: int = LONG, block: int = BLOCK, least_doubt: float = 2.0) -> DataFrame:
    """``station_id, ion, visit_no, value, flag, doubt, run_length, median`` of the flagged visit values, and of those doubted from ``least_doubt`` on.

    Flags: 1 spike, 2 stuck, 3 out of range (0: only doubted). Copies of a reading count once as a visit, but all count
    in the median. Two values at one visit are taken in order of value. Rows that are not judged never appear; an empty
    table gives no row. ``run_length`` is that of the run of equal visits, seen within the chunk and its margins.
    """
    _check(margin)
    names = ["station_id", "ion", "visit_no", "value"]
    flags = flag_records(df, None, factor, chunk, margin, long, block, least_doubt)
    return flags.groupBy(*names).agg(*[F.first(c).alias(c) for c in ("flag", "doubt", "run_length", "median")])


def flag_records(df: DataFrame, key: str | None = "rec_id", factor: float = FACTOR, chunk: int = CHUNK, margin: int = MARGIN, long: int = LONG, block: int = BLOCK, least_doubt: float = 2.0) -> DataFrame:
    """``key, station_id, ion, visit_no, value, flag, doubt, run_length, median`` of every record, copies included, of the
    visits that ``flag_visits`` gives.

    Records of short series carry their key through the one shuffle; those of long series are joined to the visits found.
    """
    _check(margin)
    keys = [key] if key else []
    rows = judged(df, *keys)
    short, hot, any_hot = _split(rows, long)
    names = [*keys, "station_id", "ion", "visit_no", "value"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    ordered = short.repartition(*_SERIES).sortWithinPartitions(*_SERIES, "visit_no", "value")
    out = ordered.mapInArrow(_judge_whole(factor, chunk, margin, least_doubt, names), f"{schema}, {_FLAGS}")
    if not any_hot:
        return out
    flagged = _flag_long(hot.select("station_id", "ion", "visit_no", "value"), factor, chunk, margin, block, least_doubt)
    return out.unionByName(join_dictionary(hot, flagged, ["station_id", "ion", "visit_no", "value"]).select(*out.columns))


def found(df: DataFrame, **how) -> DataFrame:
    """Records below 0, beyond eight times the median of their station and ion or below its eighth, or in a run of six equal visits.

    The model gives the candidates: all records with a doubt of at least ``CANDIDATE``, which its bounds guarantee for
    every such case (see STEP_LEAST). The exact rule then decides among them.
    """
    v, m = F.col("value"), F.col("median")
    doubted = flag_records(df, least_doubt=CANDIDATE, **how)
    return doubted.filter((v < 0) | (v > FACTOR * m) | (v < m / FACTOR) | (F.col("run_length") >= RUN)).select("rec_id")
