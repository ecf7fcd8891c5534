"""Documents whose blocks arrive one by one: list state, numbering and parents kept by document between micro-batches.

All that looks at one block alone (cuts, classes, events, sentences) stays column expressions on the stream. What looks over blocks is a state a document of some
twenty numbers and words, by `transformWithState`: it holds what the batch plan's windows tell of the rows so far. Blocks that arrive out of order wait in the
state until those before them are there, or until a timer on event time says that they will not come.

Each call of the state store is a message to the JVM and back, and each key an Arrow batch of its own, which cost more than a document's blocks do. So documents are
dealt into groups by a hash of their ids: a group's documents are read once and written once in a micro-batch, and have one timer, put off when it rings. What waits
lies beside them while it is small, in a map of its own beyond that.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import batched

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from statutegrid.functions import patterns as P
from statutegrid.functions.ship import ship
from statutegrid.operators import segments as G
from statutegrid.operators.model import Scorer
from statutegrid.operators.pipeline import judged
from statutegrid.operators.review import table
from statutegrid.operators.sentences import raw_sentences, split_sentences

LATE = "late_block"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EVENT = ("sub_no", "piece_no", "emit_no", "kind", "type", "text", "parts", "family", "title", "chapter", "article", "source_base", "language")
_EMPTY = dict.fromkeys(_EVENT)
_OUT = "source_base string, language string, segment_id string, parent_segment_id string, segment_order int, title string, chapter string, article string, \
segment_type string, is_list_item boolean, is_substantive boolean, segment_text string, notes string"
_NAMES = [column.split()[0] for column in _OUT.split(", ")]
#: As segments leave the state: a row of arrays, a column each, so that no segment is a row of its own on the way.
_ARRAYS = "doc_id string, " + ", ".join("{} array<{}>".format(*column.split()) for column in _OUT.split(", "))
_SEGMENT = _PACKED = Row("doc_id", *_NAMES)
#: Groups of documents, the same for a stream's whole life; characters of waiting blocks beside a group's documents; segments in a row of arrays.
GROUPS, HELD_CHARS, PACKED = 1 << 14, 1 << 22, 1000
#: Of a document's id as text, and back.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


@dataclass
class Progress:
    """What the rows of a document so far leave behind; run numbers and places count from 1, 0 or None: not yet.

    held: blocks that wait, by number as text; waiting: how many more do in the map of the state. due: when the document's patience ends. gaps: blocks given up, from and until.
    """

    expected: int = 0
    quiet: int = 0
    waiting: int = 0
    due: int = 0
    run: int = 0
    placed: int = 0
    opener: str | None = None
    opener_family: str | None = None
    seen: int | None = None
    first_run: int | None = None
    first_family: str | None = None
    broke: int | None = None
    header: int | None = None
    paragraph_run: int | None = None
    paragraph_at: int | None = None
    title: str | None = None
    chapter: str | None = None
    article: str | None = None
    held: dict = field(default_factory=dict)
    gaps: list = field(default_factory=list)

    def take(self, event: dict) -> Iterator[tuple[int, int | None, str, str]]:
        """(place, parent's place, type, text) of an event's segments; the state moves on."""
        kind, family = event["kind"], event["family"]
        opens, item = kind in ("X", "T", "H", "L", "S"), kind == "I"
        self.run += opens
        judged_in = self.run - 1 if kind == "S" else self.run
        if item and self.seen != self.run:
            self.first_run, self.first_family = self.run, family
        own = self.opener_family or (self.first_family if self.first_run == judged_in else None)
        differs = (item or kind == "S") and None not in (family, own) and family != own
        if item and differs:
            self.broke = self.run
        closed = self.opener not in ("H", "L", "S") or differs or self.broke == judged_in
        splits = item and closed and event["parts"] is not None
        parent = None
        if kind == "C" or (kind in ("I", "S") and not closed):
            parent = self.header
        elif item and not splits:
            parent = self.paragraph_at if self.paragraph_run == self.run else self.header if self.opener == "T" else None
        for name in ("title", "chapter", "article"):
            if event[name] is not None:
                setattr(self, name, event[name])
        for text in event["parts"] if splits else [event["text"]]:
            self.placed += 1
            yield self.placed, parent, "body_sentence" if splits else event["type"], text
            if splits:
                self.paragraph_run, self.paragraph_at = self.run, self.placed
        if item:
            self.seen = self.run
        if opens:
            self.opener, self.opener_family, self.header = kind, family if kind == "L" else None, self.placed


def _named(place: int | None) -> str | None:
    return None if place is None else f"seg_{place:04d}"


class Pieces(StatefulProcessor):
    """Event rows of a group's documents as segments, a document's blocks in order. patience: milliseconds of event time until a missing block is given up."""

    def __init__(self, patience: int) -> None:
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.documents = handle.getValueState("documents", "timer bigint, progress string")
        self.waiting = handle.getMapState("waiting", "doc_id string, block_no int", "events string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        timer, group = self._read()
        arrived: dict[str, dict[int | None, dict[tuple, tuple[str, dict]]]] = {}
        newest: dict[str, int] = {}
        for row in rows:
            doc, line = row["doc_id"], row["event"]
            event = _EMPTY | json.loads(line)
            arrived.setdefault(doc, {}).setdefault(row["block_no"], {})[event["sub_no"], event["piece_no"], event["emit_no"]] = line, event
            newest[doc] = max(newest.get(doc, 0), row["_arrived_ms"])
        watermark, self.room = timerValues.getCurrentWatermarkInMs(), HELD_CHARS - sum(len(x) for now in group.values() for x in now.held.values())
        for doc, blocks in arrived.items():
            now = group.setdefault(doc, Progress())
            yield from _packed(self._taken(doc, now, blocks))
            now.quiet, now.due = 0, max(newest[doc], watermark) + self.patience
        self._write(timer, group)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        _, group = self._read()
        rung, watermark = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        for doc, now in list(group.items()):
            if now.due > rung and now.due >= watermark:
                continue
            if now.quiet:
                del group[doc]
            else:
                yield from _packed(self._given(doc, now))
                now.quiet, now.due = 1, now.due + self.patience
        self._write(0, group)

    def _taken(self, doc: str, now: Progress, blocks: dict) -> Iterator[Row]:
        """Segments that come of arriving blocks."""
        for number in sorted(blocks, key=lambda n: (n is None, n or 0)):
            events = [blocks[number][at] for at in sorted(blocks[number])]
            if number is None or (number < now.expected and self._given_up(now, number)):
                yield from self._segments((doc,), now, [event for _, event in events], LATE)
            elif number == now.expected:
                yield from self._segments((doc,), now, [event for _, event in events])
                now.expected += 1
            elif number > now.expected and not self._waits(doc, now, number):
                self._hold(doc, now, number, f"[{','.join(line for line, _ in events)}]")
            yield from self._next(doc, now)

    def _given(self, doc: str, now: Progress) -> Iterator[Row]:
        """Segments of all that waits; what is missing before it is given up."""
        more = [k[1] for k in self.waiting.keys() if k[0] == doc] if now.waiting else []
        for number in sorted([*map(int, now.held), *more]):
            if number > now.expected:
                now.gaps.append([now.expected, number])
                now.expected = number
            yield from self._next(doc, now)

    def _read(self) -> tuple[int, dict[str, Progress]]:
        """When the group is looked at next, 0 if never, and its documents."""
        timer, documents = self.documents.get() or (0, "{}")
        return timer, {doc: Progress(*now) for doc, now in json.loads(documents).items()}

    def _write(self, timer: int, group: dict[str, Progress]) -> None:
        """Keep the group, and be called when the first document's patience ends; a timer that rings before that is left, and put off when it rings."""
        due = min((now.due for now in group.values()), default=0)
        if timer > due:
            self.handle.deleteTimer(timer)
            timer = 0
        if group and not timer:
            self.handle.registerTimer(due)
            timer = due
        if group:
            self.documents.update((timer, json.dumps({doc: list(vars(now).values()) for doc, now in group.items()}, ensure_ascii=False, separators=(",", ":"))))
        else:
            self.documents.clear()

    def _waits(self, doc: str, now: Progress, number: int) -> bool:
        return str(number) in now.held or bool(now.waiting and self.waiting.containsKey((doc, number)))

    def _hold(self, doc: str, now: Progress, number: int, events: str) -> None:
        """Keep a block's events, as JSON, until those before it are there."""
        if len(events) <= self.room:
            now.held[str(number)] = events
            self.room -= len(events)
        else:
            now.waiting += 1
            self.waiting.updateValue((doc, number), (events,))

    def _next(self, doc: str, now: Progress) -> Iterator[Row]:
        """Segments of the blocks that waited for the one just taken."""
        while self._waits(doc, now, now.expected):
            events = now.held.pop(str(now.expected), None)
            if events is None:
                events = self.waiting.getValue((doc, now.expected))[0]
                self.waiting.removeKey((doc, now.expected))
                now.waiting -= 1
            yield from self._segments((doc,), now, [_EMPTY | event for event in json.loads(events)])
            now.expected += 1

    @staticmethod
    def _given_up(now: Progress, number: int) -> bool:
        """Whether a block is one of those given up; it is taken off them then, so that a second copy counts as delivered."""
        for n, (start, until) in enumerate(now.gaps):
            if start <= number < until:
                now.gaps[n : n + 1] = [[low, high] for low, high in ((start, number), (number + 1, until)) if low < high]
                return True
        return False

    @staticmethod
    def _segments(key: tuple, now: Progress, events: list[dict], note: str | None = None) -> Iterator[Row]:
        for event in events:
            if event["kind"] == "X" and event["text"] == "":  # the mark behind a block
                continue
            for place, parent, type_, text in now.take(event):
                yield _SEGMENT(*key, event["source_base"], event["language"], _named(place), _named(parent), place, now.title, now.chapter, now.article, type_, type_ == "list_item", type_ in P.SUBSTANTIVE, text, note)


def _packed(segments: Iterator[Row]) -> Iterator[Row]:
    """A document's segments as rows of arrays."""
    for some in batched(segments, PACKED):
        doc, *columns = zip(*some)
        yield _PACKED(doc[0], *map(list, columns))


def piece_segments(blocks: DataFrame, language: str = "es", patience: str = "1 hour", raw: Callable[[Column], Column] = raw_sentences) -> DataFrame:
    """A stream of blocks (doc_id, source_base, block_no from 0, text, arrived) as a stream of the segments that `segment` gives for whole documents.

    arrived: a timestamp; a null one is the batch's own time. A block waits for those before it, patience at most after the document's newest block; then the gap
    is given up, and what waited comes out. A block that fills such a gap later, or has no number, is judged and numbered where the document stands, and its
    segments are noted `late_block`. A block that was delivered before is passed over; of two with one number in a batch one counts. A document without blocks for
    another patience is forgotten; what comes after that begins anew. Blocks older than the watermark (the newest block of all less patience) are dropped by Spark.
    A null text is an empty block; a null doc_id is a document of its own. Other columns do not travel. The language is given, as no block knows the whole document.
    A task holds the blocks of one group of documents in one micro-batch at a time: of GROUPS, dealt by a hash of doc_id.
    """
    if language not in ("es", "en"):
        raise ValueError(f"language must be es or en for blocks that arrive one by one, not {language!r}")
    ship(blocks.sparkSession)
    arrived = F.coalesce(F.col("arrived"), F.current_timestamp()).alias("arrived")
    timed = blocks.select(F.to_json(F.struct("doc_id"), _JSON).alias("doc_id"), "source_base", F.col("block_no").cast("int").alias("block_no"), "text", arrived).withWatermark("arrived", patience)
    found = G.events(G.pieces(G.sub_blocks(timed.withColumn("language", F.lit(language)), ends=True)), raw)
    long = (F.col("kind") == "I") & (F.length("text") >= P.PARAGRAPH_ITEM_CHARS)
    rows = found.select(
        "doc_id", "block_no", *_EVENT[:6], F.when(long, split_sentences(F.col("text"), raw)).alias("parts"), "family", "ref.title", "ref.chapter", "ref.article",
        "source_base", "language", "arrived",
    )
    # an event as one text: a column costs the Python worker a call a row
    group = F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS)).alias("_group")
    rows = rows.select(group, "doc_id", "block_no", F.to_json(F.struct(*_EVENT)).alias("event"), "arrived", F.unix_millis("arrived").alias("_arrived_ms"))
    millis = blocks.sparkSession.sql(f"SELECT unix_millis(TIMESTAMP '1970-01-02' + INTERVAL {patience}) - unix_millis(TIMESTAMP '1970-01-02')").first()[0]
    packed = rows.groupBy("_group").transformWithState(Pieces(millis), _ARRAYS, outputMode="Append", timeMode="EventTime")
    named = F.from_json("doc_id", T.StructType([T.StructField("doc_id", blocks.schema["doc_id"].dataType)]), _JSON | {"mode": "FAILFAST"})["doc_id"].alias("doc_id")
    return packed.select(named, F.arrays_zip(*_NAMES).alias("_segments")).select("doc_id", F.inline("_segments"))


def start_pieces(
    blocks: DataFrame, out: str, checkpoint: str, language: str = "es", patience: str = "1 hour", load_model: Callable[[], object] | Scorer | None = None, **trigger
) -> StreamingQuery:
    """Append the 21 columns of arriving blocks' segments to Parquet under out, each once, whatever restarts lie between.

    The state lies in RocksDB, with its changelog in the checkpoint: executors that are lost take nothing with them.
    """
    conf = blocks.sparkSession.conf
    before = conf.get(_PROVIDER)
    conf.set(_PROVIDER, _ROCKS)
    try:
        rows = table(judged(piece_segments(blocks, language, patience), load_model))
        writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
        return writer.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        conf.set(_PROVIDER, before)
