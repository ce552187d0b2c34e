"""Pairing records by nearest time within a tolerance (problem 4).

One state machine serves streams and tables. It buffers both sides of an entity; a left row is emitted once the
watermark has passed its horizon (its time plus its tolerance), and a right row is evicted once neither a waiting left
row nor one to come can be nearest to it.

Over tables, the rows of an entity are cut into cells of time, and cells of many rows into slices, so that an entity
that holds a third of all rows is many cells. The last right row before a cell and the first after it are carried into
it, found by a window over cells, not rows: so a cell is decided on its own whatever the tolerances are. Rows of a cell
go through the state machine in order of time, and the time is the watermark.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import written

DAY = 86_400_000_000
RIGHT, LEFT = 0, 1
#: Time of a cell; rows of a cell from which it is cut into slices; slices are no more than MOST_CUT.
CELL, SLICE_ROWS, MOST_CUT = 32 * DAY, 4096, 10_000


class NearestState:
    """Both sides of one entity, or of a cell of it, between watermarks."""

    def __init__(self, rights: Iterable[tuple[int, str]] = (), lefts: Iterable[tuple[int, int, object]] = (), longest: int = 0) -> None:
        self.rights = sorted(rights)
        self.lefts = [(at + tolerance, at, tolerance, row) for at, tolerance, row in lefts]
        heapq.heapify(self.lefts)
        self.longest = max([longest, *(x[2] for x in self.lefts)])

    def right(self, at: int, key: str) -> None:
        if not self.rights or (at, key) > self.rights[-1]:
            self.rights.append((at, key))
        else:
            i = bisect_left(self.rights, (at, key))
            if self.rights[i] != (at, key):
                self.rights.insert(i, (at, key))

    def left(self, at: int, tolerance: int, row: object) -> None:
        self.longest = max(self.longest, tolerance)
        heapq.heappush(self.lefts, (at + tolerance, at, tolerance, row))

    def nearest(self, at: int, tolerance: int) -> tuple[int, str] | None:
        """The right row nearest to `at`; on a tie the earlier, then the smaller key."""
        i = bisect_left(self.rights, (at + 1,))
        after = self.rights[i] if i < len(self.rights) and self.rights[i][0] - at <= tolerance else None
        if i and at - self.rights[i - 1][0] <= tolerance:
            before = self.rights[bisect_left(self.rights, (self.rights[i - 1][0],))]
            if after is None or at - before[0] <= after[0] - at:
                return before
        return after

    def advance(self, watermark: int) -> Iterator[tuple[object, int, str]]:
        """Emits (row, time, key) for left rows whose horizon has passed, and evicts right rows out of reach.

        A left row that waits or is still to come lies at or after watermark - longest: of the right rows up to there only
        the last one can be nearest to it.
        """
        while self.lefts and self.lefts[0][0] < watermark:
            _, at, tolerance, row = heapq.heappop(self.lefts)
            near = self.nearest(at, tolerance)
            if near is not None:
                yield row, *near
        i = bisect_right(self.rights, (watermark - self.longest,))
        if i > 1:
            i = bisect_left(self.rights, (self.rights[i - 1][0],))  # of rows at one time all stay
            if 2 * i > len(self.rights):
                del self.rights[:i]

    def end(self) -> Iterator[tuple[object, int, str]]:
        """All that waits: no row is to come."""
        yield from self.advance(max((x[0] for x in self.lefts), default=0) + 1)


def micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def in_cells(rows: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """rows (qid, at, side, name, tolerance) with `cell` and `slice`, and the carried right rows of each cell with left rows.

    The cells that are cut are broadcast; they are no more than MOST_CUT, since a cut one has at least that share of all rows.
    """
    cell = F.floor(F.col("at") / F.lit(CELL))
    counts = rows.groupBy("qid", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    least = max(slice_rows, -(-rows.count() // MOST_CUT))
    cut = F.broadcast(counts.filter(F.col("n") > least).select("qid", "cell", F.ceil(F.col("n") / F.lit(least)).alias("slices")))
    inside = (F.col("at") - F.col("cell") * F.lit(CELL)).cast("double") / F.lit(float(CELL))
    placed = rows.withColumn("cell", cell).join(cut, ["qid", "cell"], "left").withColumn("slice", F.floor(inside * F.coalesce("slices", F.lit(1))).cast("int")).drop("slices")
    keys = ["qid", "cell", "slice"]
    here = F.when(F.col("side") == RIGHT, F.struct("at", "name"))
    cells = placed.groupBy(*keys).agg(F.min(here).alias("first"), F.max_by(here, F.when(F.col("side") == RIGHT, F.col("at"))).alias("last"), F.max(F.col("side") == LEFT).alias("asked"))
    along = Window.partitionBy("qid").orderBy("cell", "slice")
    before = F.last("last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing))
    asked = cells.select(*keys, "asked", before.alias("before"), after.alias("after")).filter("asked")
    carried = asked.select(*keys, F.explode(F.array("before", "after")).alias("r")).filter("r is not null").select("qid", F.col("r.at").alias("at"), F.lit(RIGHT).alias("side"), F.col("r.name").alias("name"), F.lit(0).cast("bigint").alias("tolerance"), "cell", "slice")
    return placed.join(asked.select(*keys), keys, "left_semi").unionByName(carried)


def nearest_pairs(left: DataFrame, right: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """left (private_id, qid, at, tolerance), right (key, qid, at), times in microseconds, to (private_id, qid, at, key, key_at).

    The nearest right row of the same qid within the tolerance; on a tie the earlier, then the smaller key. Rows with a
    null qid, time, key, private_id or tolerance, or a negative one, take no part. Repeated left rows give one row.
    Left rows without a neighbour give none; empty tables give no rows.
    """
    lefts = left.select("private_id", "qid", "at", "tolerance").dropna().filter("tolerance >= 0").distinct()
    # of right rows at one time the smallest key is enough
    rights = right.select("key", "qid", "at").dropna().join(lefts.select("qid").distinct(), "qid", "left_semi").groupBy("qid", "at").agg(F.min("key").alias("name"))
    rows = lefts.select("qid", "at", F.lit(LEFT).alias("side"), F.col("private_id").alias("name"), "tolerance").unionByName(
        rights.select("qid", "at", F.lit(RIGHT).alias("side"), "name", F.lit(0).cast("bigint").alias("tolerance"))
    )
    keys = ["qid", "cell", "slice"]
    stream = in_cells(written(rows, "sides"), slice_rows).select(*keys, "at", "side", "name", "tolerance").repartition(*keys).sortWithinPartitions(*keys, "at", "side", "name")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, out = None, NearestState(), []

        def shown() -> pa.RecordBatch:
            rows = [(*row, key, key_at) for row, key_at, key in out]
            columns = list(zip(*rows)) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        types, names = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()], ["private_id", "qid", "at", "key", "key_at"]
        for b in batches:
            for *cell, at, side, name, tolerance in zip(*(c.to_pylist() for c in b.columns)):
                if cell != current:
                    out += state.end()
                    current, state = cell, NearestState()
                if side == RIGHT:
                    state.right(at, name)
                else:
                    state.left(at, tolerance, (name, cell[0], at))
                out += state.advance(at)
            yield shown()
            out.clear()
        out += state.end()
        yield shown()

    return stream.mapInArrow(run, "private_id string, qid string, at bigint, key string, key_at bigint")


def match_events(matches: DataFrame, events: DataFrame) -> DataFrame:
    """private_id, anchor_qid, public_id, days_apart (event's date minus the private one), n_days (its size) and distance.

    One row for each private_id and anchor_qid with an event; of several rows of matches for them the nearest counts.
    """
    left = matches.select("private_id", F.col("anchor_qid").alias("qid"), micros("private_ts").alias("at"), (F.col("window_days").cast("bigint") * DAY).alias("tolerance"))
    right = events.select(F.col("doc_id").alias("key"), F.explode("qids").alias("qid"), micros("event_ts").alias("at"))
    found = nearest_pairs(left, right).withColumn("distance", F.abs(F.col("key_at") - F.col("at")))
    best = found.groupBy("private_id", "qid").agg(F.min(F.struct("distance", "key_at", "key", "at")).alias("b"))
    days = (F.floor(F.col("b.key_at") / DAY) - F.floor(F.col("b.at") / DAY)).cast("int")
    return best.select("private_id", F.col("qid").alias("anchor_qid"), F.col("b.key").alias("public_id"), days.alias("days_apart"), F.abs(days).alias("n_days"), F.col("b.distance").alias("distance"))


STATE = "rights array<struct<at: long, key: string>>, lefts array<struct<at: long, tolerance: long, name: string>>"
OUTPUT = "private_id string, qid string, at long, key string, key_at long"


def nearest_stream(left: DataFrame, right: DataFrame, longest_days: int, late: str = "1 day") -> DataFrame:
    """The same join over two streams with a timestamp column `ts`: left (private_id, qid, ts, tolerance), right (key, qid, ts).

    Both sides are buffered until the watermark (`late` behind the newest time) has passed them; a left row is
    emitted once the watermark has passed its horizon, and candidates out of reach are evicted. The state is that of an
    entity's cell of longest_days, with the right rows of the cells beside it, so a state value is bounded in time. Left
    rows of a tolerance over longest_days are an error.
    """
    longest = max(1, longest_days) * DAY
    a = left.select("qid", "ts", F.lit(LEFT).alias("side"), F.col("private_id").alias("name"), F.col("tolerance").cast("bigint").alias("tolerance"))
    b = right.select("qid", "ts", F.lit(RIGHT).alias("side"), F.col("key").alias("name"), F.lit(0).cast("bigint").alias("tolerance"))
    both = a.unionByName(b).dropna().withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    bound = F.when(F.col("tolerance") > longest, F.raise_error(F.lit("a tolerance over longest_days"))).otherwise(F.col("tolerance"))
    own = F.floor(F.col("at") / F.lit(longest))
    cells = F.when(F.col("side") == RIGHT, F.array(own - 1, own, own + 1)).otherwise(F.array(own))
    both = both.withColumn("tolerance", bound).withColumn("cell", F.explode(cells))

    def step(key, frames: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rights, lefts = ([], []) if not state.exists else state.get
        machine = NearestState(map(tuple, rights), [(at, tolerance, (name, at)) for at, tolerance, name in lefts], longest)
        for f in frames:
            for at, side, name, tolerance in zip(f["at"], f["side"], f["name"], f["tolerance"]):
                if side == RIGHT:
                    machine.right(int(at), name)
                else:
                    machine.left(int(at), int(tolerance), (name, int(at)))
        now = state.getCurrentWatermarkMs() * 1000
        out = [(name, key[0], at, k, k_at) for (name, at), k_at, k in machine.advance(now)]
        over = (int(key[1]) + 1) * longest  # no left row of this cell comes after
        if machine.lefts or (machine.rights and now < over):
            state.update((machine.rights, [(at, tolerance, name) for _, at, tolerance, (name, _) in machine.lefts]))
            state.setTimeoutTimestamp(max(now, machine.lefts[0][0] if machine.lefts else over) // 1000 + 1)
        else:
            state.remove()
        yield pd.DataFrame(out, columns=["private_id", "qid", "at", "key", "key_at"])

    return both.groupBy("qid", "cell").applyInPandasWithState(step, OUTPUT, STATE, "append", "EventTimeTimeout")
