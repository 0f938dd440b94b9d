"""State machine and fixed-window counting over events."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.keys import uuid5

# Each state's only step forward; any of these states may also fail.
FORWARD = {
    "created": "uploading",
    "uploading": "uploaded",
    "uploaded": "identifying",
    "identifying": "awaiting_confirmation",
    "awaiting_confirmation": "analyzing",
    "analyzing": "calculating",
    "calculating": "completed",
}
TERMINAL = ("completed", "failed")


def transitions(spark: SparkSession) -> DataFrame:
    rows = [*FORWARD.items(), *((s, "failed") for s in FORWARD)]
    return spark.createDataFrame(rows, "from_status string, to_status string")


def legal(source, target):
    """Whether a status may follow another."""
    return F.create_map(*(x for k, v in FORWARD.items() for x in (F.lit(k), F.lit(v))))[source].eqNullSafe(target) | (
        target.eqNullSafe(F.lit("failed")) & source.isin(*FORWARD)
    )


def apply_requests(analyses: DataFrame, requests: DataFrame) -> DataFrame:
    """One conditional update per analysis: the first request that is legal from its status wins."""
    spark = analyses.sparkSession
    reachable = analyses.join(F.broadcast(transitions(spark)), F.col("status") == F.col("from_status"))
    met = reachable.alias("a").join(
        requests.alias("r"), (F.col("a.id") == F.col("r.analysis_id")) & (F.col("a.to_status") == F.col("r.target"))
    )
    first = met.groupBy(F.col("a.id").alias("id")).agg(
        F.min_by(F.struct("r.event_id", "r.target", "r.ts"), F.struct("r.ts", "r.event_id")).alias("won")
    )
    return first.select(
        "id",
        F.col("won.event_id").alias("event_id"),
        F.col("won.target").alias("status"),
        F.when(F.col("won.target").isin(*TERMINAL), F.col("won.ts")).alias("completed_at"),
    )


def predecessors(target: Column) -> Column:
    """The statuses from which a status may be reached, in order; none for the one that analyses start with."""
    step = F.create_map(*(F.lit(x) for pair in FORWARD.items() for x in reversed(pair)))
    failing = F.array(*map(F.lit, sorted(FORWARD)))
    return F.when(target == "failed", failing).otherwise(F.array_compact(F.array(F.try_element_at(step, target))))


def successors(status: Column) -> Column:
    """The statuses that may follow a status, in order."""
    step = F.create_map(*(F.lit(x) for pair in FORWARD.items() for x in pair))
    return F.when(status.isin(*FORWARD), F.array_sort(F.array(F.try_element_at(step, status), F.lit("failed")))).otherwise(F.array().cast("array<string>"))


STATUSES = (*FORWARD, "completed", "failed")


def _moves() -> np.ndarray:
    """By target and status: the status after a request for the target. The last row is a target that isn't a status."""
    moves = np.tile(np.arange(len(STATUSES)), (len(STATUSES) + 1, 1))
    for source, target in FORWARD.items():
        moves[STATUSES.index(target), STATUSES.index(source)] = STATUSES.index(target)
        moves[STATUSES.index("failed"), STATUSES.index(source)] = STATUSES.index("failed")
    return moves


def _composed(batches: Iterator[pa.RecordBatch], last: int) -> Iterator[pa.RecordBatch]:
    """For each analysis' requests in a row, sorted: what they make of every status, and how many of them apply."""
    part = TaskContext.get().partitionId()
    moves, n = _moves(), len(STATUSES)
    names = {s: i for i, s in enumerate(STATUSES)}
    key, to, applied, count = None, np.arange(n), np.zeros(n, np.int64), 0

    def row(kind: pa.DataType) -> pa.RecordBatch:
        lists = [pa.array([v.tolist()], pa.list_(pa.int64())) for v in (to, applied)]
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], kind), pa.array([part], pa.int32()), *lists, pa.array([count], pa.int64())],
            names=["analysis_id", "part", "to", "applied", "requests"],
        )

    for batch in batches:
        kind = batch.schema.field(0).type
        for own, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != (own,):
                if key is not None:
                    yield row(kind)
                key, to, applied, count = (own,), np.arange(n), np.zeros(n, np.int64), 0
            after = moves[names.get(target, last)][to]
            applied = applied + (after != to)
            to, count = after, count + 1
    if key is not None:
        yield row(kind)


def compositions(requests: DataFrame) -> DataFrame:
    """(analysis_id, part, to, applied, requests): an analysis' requests as functions of its status, one for each run of them.

    `to` has the status after the run for each status before it, `applied` how many requests were legal. Functions
    can be composed in any grouping, so requests are dealt in ranges of (analysis, time): one analysis with a third
    of all requests is many tasks' work, and each of them gives one row of it. `part` tells the runs' order.
    """
    spark = requests.sparkSession
    kind = requests.schema["analysis_id"].dataType.simpleString()
    order = ["analysis_id", "ts", "event_id", "target"]
    dealt = requests.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    last = len(STATUSES)
    return dealt.select("analysis_id", "target").mapInArrow(
        lambda b: _composed(b, last), f"analysis_id {kind}, part int, to array<long>, applied array<long>, requests long"
    )


def replay(requests: DataFrame, start: str = "created") -> DataFrame:
    """Each analysis' requests in order of time, folded from the start status; illegal ones change nothing.

    Runs are composed where they lie; an analysis' few runs - at most one a task - are then taken in turn. A target
    that isn't a status changes nothing; requests without an analysis are one's, and those without a time come first.
    """
    runs = F.array_sort(F.collect_list(F.struct("part", "to", "applied", "requests")))
    at = F.struct(F.lit(STATUSES.index(start)).cast("long").alias("at"), F.lit(0).cast("long").alias("applied"))

    def step(acc: Column, r: Column) -> Column:
        here = acc["at"].cast("int")
        return F.struct(F.get(r["to"], here).alias("at"), (acc["applied"] + F.get(r["applied"], here)).alias("applied"))

    folded = compositions(requests).groupBy("analysis_id").agg(F.aggregate(runs, at, step).alias("s"), F.sum("requests").alias("requests"))
    status = F.get(F.array(*map(F.lit, STATUSES)), F.col("s.at").cast("int"))
    return folded.select("analysis_id", status.alias("status"), F.col("s.applied").cast("int").alias("applied"), "requests")


def run(analyses: DataFrame, images: DataFrame, versions: DataFrame, application_version: str, as_of: Column) -> DataFrame:
    """Every analysis after its run: (id, status, claimed, application_version, card_database_version, verdict, completed_at).

    A run claims an analysis that may be identified and no other, records the application's version and that of the
    newest catalogue (null if none is published), and takes the worst status of the analysis' images (good without any).
    Unusable images end it as failed, at as_of; else it awaits confirmation. Others stay as they are, with no record.
    analyses: (id, status); images: (analysis_id, status); versions: (version, ordinal).
    """
    severity = F.array_position(F.array(*(F.lit(s) for s in ("good", "acceptable", "poor", "unusable"))), F.col("status"))
    worst = images.groupBy("analysis_id").agg(F.max(severity).alias("worst"))
    current = versions.agg(F.max_by("version", "ordinal").alias("card_database_version"))  # one row
    claimed = F.coalesce(F.array_contains(predecessors(F.lit("identifying")), F.col("status")), F.lit(False))
    own = analyses.select("id", F.col("status").alias("was"), claimed.alias("claimed"))
    joined = own.join(worst, F.col("id") == F.col("analysis_id"), "left").join(F.broadcast(current), F.lit(True), "left")
    verdict = F.get(F.array(*(F.lit(s) for s in ("good", "acceptable", "poor", "unusable"))), F.coalesce("worst", F.lit(1)).cast("int") - 1)
    status = F.when(~F.col("claimed"), F.col("was")).when(verdict == "unusable", "failed").otherwise("awaiting_confirmation")
    only = lambda c: F.when(F.col("claimed"), c)
    return joined.select(
        "id", status.alias("status"), "claimed", only(F.lit(application_version)).alias("application_version"),
        only(F.col("card_database_version")).alias("card_database_version"), only(verdict).alias("verdict"),
        F.when(F.col("claimed") & (verdict == "unusable"), as_of).alias("completed_at"),
    )


def _fixed_windows(batches: Iterator[pa.RecordBatch], seconds: int) -> Iterator[pa.RecordBatch]:
    """Adds opened and place to (user_id, event_id, s) sorted by user and time; only the open window is held."""
    client, opened, place = None, None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        users = batch.column(0)
        s = batch.column(2).to_numpy(zero_copy_only=False)
        starts, places = np.full(n, np.nan), np.ones(n, np.int32)
        changed = pc.invert(pc.fill_null(pc.equal(users[1:], users[:-1]), False)).to_numpy(zero_copy_only=False)
        changed &= ~(pc.is_null(users[1:]).to_numpy(zero_copy_only=False) & pc.is_null(users[:-1]).to_numpy(zero_copy_only=False))
        for first, end in itertools.pairwise([0, *(np.flatnonzero(changed) + 1).tolist(), n]):
            own = (users[first].as_py(),)
            if own != client:
                client, opened, place = own, None, 0
            at = first + int(np.isnan(s[first:end]).sum())  # events without a time come first
            while at < end:
                if opened is None or s[at] >= opened + seconds:
                    opened, place = float(s[at]), 0
                last = at + int(np.searchsorted(s[at:end], opened + seconds))
                starts[at:last], places[at:last] = opened, place + 1 + np.arange(last - at)
                place, at = place + last - at, last
        columns = [*batch.columns, pa.array(starts, from_pandas=True), pa.array(places)]
        yield pa.RecordBatch.from_arrays(columns, names=["user_id", "event_id", "s", "opened", "place"])


def rate_windows(events: DataFrame, limit: int, seconds: int) -> DataFrame:
    """Each event with its place in its client's fixed window, whether it is allowed, and the wait if not.

    A window opens at a client's first event outside an open one and lasts `seconds`; an event at its very
    end opens the next. Refused events count. An event without a time is a first event of its own and opens
    no window; events without a client are one client's. Sorted events stream by, however many a client has.
    """
    spark = events.sparkSession
    seconds_of = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = events.select("user_id", "event_id", seconds_of.alias("s"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "user_id")
    placed = dealt.sortWithinPartitions("user_id", "s", "event_id").mapInArrow(
        lambda b: _fixed_windows(b, seconds),
        f"user_id {kinds['user_id']}, event_id {kinds['event_id']}, s double, opened double, place int",
    )
    wait = F.greatest(F.lit(1), F.ceil(F.col("opened") + seconds - F.col("s")))
    return placed.select(
        "user_id",
        "event_id",
        "place",
        (F.col("place") <= limit).alias("allowed"),
        F.when(F.col("place") > limit, wait.cast("long")).alias("retry_after"),
    )


ACCEPTS_IMAGES = ("created", "uploading", "uploaded")


def gates(status: Column) -> dict[str, Column]:
    """What an analysis in a status may be asked for."""
    return {
        "accepts_images": status.isin(*ACCEPTS_IMAGES),
        "runnable": status == "uploaded",
        "confirmable": status == "awaiting_confirmation",
    }


def failure(status: Column, sides: Column) -> Column:
    """Why a failed analysis failed, from the array of its unusable sides; null for others."""
    return F.when(status == "failed", F.when(F.size(sides) > 0, "image_quality_failure").otherwise("analysis_failed"))


TTL_SECONDS = 604_800


def open_sessions(tokens: DataFrame, as_of: Column, application_version: str, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """(id, token, status, created_at, expires_at, application_version): a new session for each token, times in seconds.

    Ids come from the token and the time, so that a task that is run again opens the same session.
    """
    name = F.concat_ws("/", F.lit("session"), "token", as_of.cast("string"))
    return tokens.select(
        uuid5(name).alias("id"), "token", F.lit("active").alias("status"), as_of.cast("long").alias("created_at"),
        (as_of.cast("long") + ttl_seconds).alias("expires_at"), F.lit(application_version).alias("application_version"),
    )


def open_analyses(sessions: DataFrame, as_of: Column) -> DataFrame:
    """(id, session_id, status, created_at, completed_at, card_id): a new analysis for each of sessions (id)."""
    return sessions.select(
        uuid5(F.concat_ws("/", F.lit("analysis"), F.col("id").cast("string"), as_of.cast("string"))).alias("id"), F.col("id").alias("session_id"),
        F.lit("created").alias("status"), as_of.cast("long").alias("created_at"), F.lit(None).cast("long").alias("completed_at"), F.lit(None).cast("string").alias("card_id"),
    )


def resolve_sessions(sessions: DataFrame, presented: DataFrame, as_of: Column) -> DataFrame:
    """presented (token) with the id of its session: only an active one that expires later than as_of is one.

    Whether there is no such token or a session that is over can't be told apart. A null token is none.
    """
    live = sessions.where((F.col("status") == "active") & (F.col("expires_at") > as_of)).select("token", F.col("id").alias("session_id"))
    return presented.join(live, "token", "left")


def held_objects(original: Column, normalised: Column) -> Column:
    """Keys of what is stored for an image, the original first."""
    return F.array_compact(F.array(original, normalised))


def superseded_objects(held: Column, new: Column) -> Column:
    """Keys that nothing names once an image's original is `new`; all of them if it is null."""
    return F.filter(held, lambda x: ~x.eqNullSafe(new))


def side_keys(images: DataFrame) -> DataFrame:
    """(analysis_id, keys): a map from side to key of each analysis' images (analysis_id, side, key); sides are unique and few."""
    return images.groupBy("analysis_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("side", "key")))).alias("keys"))


def image_verdicts(images: DataFrame) -> DataFrame:
    """(analysis_id, verdicts): (side, quality_status, quality_score) of all images of an analysis, in order of side."""
    return images.groupBy("analysis_id").agg(F.array_sort(F.collect_list(F.struct("side", "quality_status", "quality_score"))).alias("verdicts"))


def reproducibility(analyses: DataFrame, images: DataFrame) -> DataFrame:
    """analyses (id, six versions) with image_sha256: a map from side to digest, empty without images."""
    own = images.groupBy("analysis_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("side", "sha256")))).alias("image_sha256"))
    empty = F.create_map().cast("map<string,string>")
    joined = analyses.join(own, F.col("id") == F.col("analysis_id"), "left")
    return joined.select(*analyses.columns, F.coalesce("image_sha256", empty).alias("image_sha256"))
