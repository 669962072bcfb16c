"""Streams with keyed state that take events in any order: violations, fiscal duplicates, file admissions, children of splits.

A file source, a shuffle or a retry may bring an event after later ones. These
operators keep, by key, what a late event needs to correct results that are out
already, and put out changes: a row for whatever is new or has changed, with the
key's running number ``change``. The last change of a row is its truth, as
:func:`latest` takes it. What has come in order takes the short way: it reads a
single value of the state, whatever the length of the key's history.

State is in RocksDB (:func:`session_for`), so that it need not fit into memory.
An event that comes twice changes nothing.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.duplicates import ADMITTED_AGAIN, INACTIVE
from ..operators.events import TRANSITIONS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ALLOWED = {f"{a}>{b}" for a, after in TRANSITIONS.items() for b in after}


def session_for(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A session of the same application for streams with keyed state; ``partitions`` is fixed for a stream's life."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    if partitions:
        own.conf.set("spark.sql.shuffle.partitions", str(partitions))
    return own


class Numbered(StatefulProcessor):
    """A processor that numbers the changes of its key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.changes = handle.getValueState("changes", "n long")

    def number(self) -> int:
        n = (self.changes.get() or (0,))[0] + 1
        self.changes.update((n,))
        return n

    def close(self) -> None:
        pass


def _none(x):
    return None if pd.isna(x) else x


class Steps(Numbered):
    """The steps of one document's log. State: the last event, and all events by number."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "seq long, status string")
        self.log = handle.getListState("log", "seq long, status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = dict(sorted((int(s), _none(x)) for batch in rows for s, x in zip(batch["seq"], batch["status"])))
        last = self.last.get()
        out: list[tuple] = []
        if last is None or min(new) > last[0]:  # in order: what lies before isn't read
            self.log.appendList(list(new.items()))
            before = last[1] if last else None
            for s, status in new.items():
                out.append((s, before, status))
                before = status
            self.last.update((s, status))
        else:
            held = dict(self.log.get())
            new = {s: x for s, x in new.items() if s not in held}
            if not new:
                return
            order = sorted(held | new)
            touched = set(new) | {order[k + 1] for k in (bisect.bisect_left(order, s) for s in new) if k + 1 < len(order)}
            status = held | new
            for s in sorted(touched):  # the late ones, and those that now have another before them
                k = bisect.bisect_left(order, s)
                out.append((s, status[order[k - 1]] if k else None, status[s]))
            self.log.put([(s, status[s]) for s in order])
            self.last.update((order[-1], status[order[-1]]))
        n = self.number()
        yield pd.DataFrame([(key[0], s, a, b, f"{a or ''}>{b}" in _ALLOWED, n) for s, a, b in out], columns=[self.key, "seq", "previous_status", "status", "allowed", "change"])


def steps(stream: DataFrame, key: str = "doc_id") -> DataFrame:
    """Changes (key, seq, previous_status, status, allowed, change): each event with the status before it, once known and again when an earlier event comes late.

    The stream has key, seq and status. Of two events of one number the first to come counts.
    """
    schema = f"{key} long, seq long, previous_status string, status string, allowed boolean, change long"
    return stream.select(key, "seq", "status").groupBy(key).transformWithStateInPandas(Steps(key), schema, "append", "None")


#: Fixed value: parts that the folders of one fiscal hash are dealt over, each one value of the state.
FOLDER_PARTS = 64


class Holders(Numbered):
    """The folders of one fiscal hash. State: the first active folder, and of each folder its number, version and whether it is active.

    Folders are kept by part, so that a trigger reads and writes a part once,
    however many of its folders come.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.first = handle.getValueState("first", "seq long, folder string")
        self.parts = handle.getMapState("parts", "part int", "folders string")

    @staticmethod
    def facts(rows: Iterator[pd.DataFrame]) -> dict[int, dict[str, list]]:
        """By part, the newest fact [seq, version, active] of each folder."""
        out: dict[int, dict[str, list]] = {}
        for batch in rows:
            active = ~batch["status"].isin(INACTIVE) & ~batch["rejected"].eq(True)
            for folder, *fact in zip(batch["folder"].tolist(), batch["finalized_seq"].tolist(), batch["version"].tolist(), active.tolist()):
                part = out.setdefault(zlib.crc32(folder.encode()) % FOLDER_PARTS, {})
                if folder not in part or part[folder][1] < fact[1]:
                    part[folder] = fact
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        facts: dict[str, list] = {}
        some = self.parts.exists()
        for part, new in self.facts(rows).items():
            held = json.loads(self.parts.getValue((part,))[0]) if some and self.parts.containsKey((part,)) else {}
            new = {folder: fact for folder, fact in new.items() if folder not in held or held[folder][1] < fact[1]}
            if new:
                self.parts.updateValue((part,), (json.dumps(held | new),))
                facts |= new
        if not facts:
            return
        before = self.first.get()
        active = [(seq, folder) for folder, (seq, _, on) in facts.items() if on]
        if before and before[1] in facts:  # the holder may be free, or has another number: the next is looked for
            active = [(seq, folder) for folder, (seq, _, on) in self.held() if on]
        elif before:
            active.append(tuple(before))
        first = min(active, default=None)
        if first:
            self.first.update(first)
        elif before:
            self.first.clear()
        if first != (tuple(before) if before else None):  # another holder: all active folders name it
            facts |= {folder: fact for folder, fact in self.held() if fact[2]}
        n = self.number()
        out = [(key[0], seq, folder, first[1] if on and first and (seq, folder) > first else None, n) for folder, (seq, _, on) in facts.items()]
        yield pd.DataFrame(out, columns=["fiscal_hash", "finalized_seq", "folder", "duplicate_of", "change"])

    def held(self) -> Iterator[tuple[str, list]]:
        for _, part in self.parts.iterator():
            yield from json.loads(part[0]).items()


def holders(stream: DataFrame) -> DataFrame:
    """Changes (fiscal_hash, finalized_seq, folder, duplicate_of, change) of folders whose hash another active folder has first.

    The stream has facts (fiscal_hash, folder, finalized_seq, status, rejected,
    version); of a folder's facts the one with the greatest version holds. A
    holder that is cancelled, fails or is rejected frees its hash: the next
    active folder holds it, and those after it are put out anew, as they are
    when a smaller number comes late. In random order a hash of n folders
    changes its holder about ln(n) times.
    """
    facts = stream.where("fiscal_hash is not null").select("fiscal_hash", "folder", "finalized_seq", "status", "rejected", "version")
    schema = "fiscal_hash string, finalized_seq long, folder string, duplicate_of string, change long"
    return facts.groupBy("fiscal_hash").transformWithStateInPandas(Holders(), schema, "append", "None")


class Admissions(Numbered):
    """The uploads of one file digest. State: the last event with the holder after it, and all events by number."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "seq long, holder long, status string")
        self.log = handle.getListState("log", "seq long, doc_id long, status string")

    @staticmethod
    def run(events: list[tuple], holder: int | None, status: str | None) -> tuple[list[tuple], int | None, str | None]:
        """What becomes of events in order: the verdicts on uploads, and who holds the file in the end."""
        out = []
        for seq, doc, what in events:
            if what != "uploaded":
                status = what if doc == holder else status
            elif holder is None or status in ADMITTED_AGAIN:
                out.append((seq, doc, True, None, None))
                holder, status = doc, what
            else:
                out.append((seq, doc, False, holder, status))
        return out, holder, status

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = {int(s): (int(s), int(d), x) for batch in rows for s, d, x in zip(batch["seq"], batch["doc_id"], batch["status"])}
        last = self.last.get()
        if last is None or min(new) > last[0]:
            events = [new[s] for s in sorted(new)]
            self.log.appendList(events)
            out, holder, status = self.run(events, *(last[1:] if last else (None, None)))
        else:
            held = {e[0]: tuple(e) for e in self.log.get()}
            if not set(new) - set(held):
                return
            events = [e for _, e in sorted((new | held).items())]
            known = {x[0]: x for x in self.run(sorted(held.values()), None, None)[0]}
            out, holder, status = self.run(events, None, None)
            out = [x for x in out if known.get(x[0]) != x]
            self.log.put(events)
        self.last.update((events[-1][0], holder, status))
        n = self.number()
        yield pd.DataFrame([(key[0], *x, n) for x in out], columns=["sha256", "seq", "doc_id", "admitted", "original", "original_status", "change"]).astype({"original": "Int64"})


def admissions(stream: DataFrame) -> DataFrame:
    """Changes (sha256, seq, doc_id, admitted, original, original_status, change): of each upload whether its file is let in.

    The stream has events (sha256, seq, doc_id, status); ``uploaded`` is an
    upload. A file is let in if none like it was, or if the document that was
    let in last has failed, was cancelled or failed its first scan; otherwise
    that document and its status at the time are named. Events of other
    documents with the digest change nothing.
    """
    schema = "sha256 string, seq long, doc_id long, admitted boolean, original long, original_status string, change long"
    return stream.where("sha256 is not null").select("sha256", "seq", "doc_id", "status").groupBy("sha256").transformWithStateInPandas(Admissions(), schema, "append", "None")


def children(stream: DataFrame) -> DataFrame:
    """(doc_id, child, book, sha256_file, change) of the children of split events (doc_id, seq, book, sha256_file, split_into), each child of a parent once, however often its split is read.

    Children are told apart by Spark's own deduplication, with a row of state for
    each: parents have few children, so that a call by parent would cost more
    than the work. A child never changes once it is out: its change is the first.
    Of events that name it in one trigger, any may give its book and digest.
    """
    each = stream.select("doc_id", F.explode("split_into").alias("child"), "book", "sha256_file")
    return each.dropDuplicates(["doc_id", "child"]).withColumn("change", F.lit(1).cast("long"))


def latest(changes: DataFrame, *keys: str) -> DataFrame:
    """The last change of each row that ``keys`` name, without its number."""
    rest = [c for c in changes.columns if c not in (*keys, "change")]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "change").alias("last")).select(*keys, "last.*")


def replayed(
    rows: DataFrame, operator: Callable[[DataFrame], DataFrame], root: str, mode: str = "append", session: SparkSession | None = None, files: int = 12, triggers: int = 3
) -> DataFrame:
    """All that the operator puts out over rows as a stream of files, in ``triggers`` triggers, in the folder ``root``.

    Rows are dealt over files by their hash, so that they come in no order.
    Each trigger writes a folder of its own: one that runs again replaces it.
    Operators with keyed state need a ``session`` of :func:`session_for`.
    """
    rows.repartition(files, F.xxhash64(*rows.columns)).write.parquet(f"{root}/in")
    stream = (session or rows.sparkSession).readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-files // triggers)).parquet(f"{root}/in")

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/trigger={number}")

    writer = operator(stream).writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{root}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.read.parquet(f"{root}/out").drop("trigger")
