"""Blocks that arrive one by one give the rows of whole documents."""

import random
from datetime import datetime, timedelta

import pytest

from statutegrid.operators.blocks import blocks_of
from statutegrid.operators.pipeline import analysed
from statutegrid.operators.review import table
from statutegrid.plans.derived import regulations
from statutegrid.streaming.pieces import piece_segments, start_pieces

SCHEMA = "doc_id string, source_base string, block_no int, text string, arrived timestamp"
NOON = datetime(2026, 1, 1, 12)


class Stream:
    """A folder that files are put into, one a micro-batch, and the table that comes of them."""

    def __init__(self, spark, folder, schema=SCHEMA, **options):
        self.spark, self.folder, self.schema, self.options, self.files = spark, folder, schema, options, 0
        (folder / "in").mkdir()

    def put(self, rows):
        self.files += 1
        frame = rows if hasattr(rows, "toPandas") else self.spark.createDataFrame(rows, self.schema)
        frame.coalesce(1).write.parquet(str(self.folder / "in" / f"{self.files:03d}"))

    def run(self):
        source = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.folder / "in" / "*"))
        query = start_pieces(source, str(self.folder / "out"), str(self.folder / "state"), **self.options)
        assert query.awaitTermination(300)
        return query

    def rows(self):
        return self.spark.read.parquet(str(self.folder / "out"))


def short(stream):
    return [(r.doc_id, r.segment_id, r.parent_segment_id, r.segment_text, r.review_reason) for r in stream.rows().orderBy("doc_id", "segment_order").collect()]


def block(number, text, minutes=0, doc="d"):
    return (doc, "1. x.md", number, text, NOON + timedelta(minutes=minutes))


def test_blocks_over_three_batches_and_a_restart_equal_whole_documents(spark, tmp_path):
    blocks = blocks_of(regulations(spark, "/root/testdata/sf0.001").drop("lang")).selectExpr("CAST(doc_id AS STRING) AS doc_id", "source_base", "block_no", "page", "text").cache()
    stream = Stream(spark, tmp_path)
    for third in (1, 0, 2):  # blocks 1, 4, 7 first: they wait for those before them
        stream.put(blocks.where(f"(block_no + length(doc_id)) % 3 = {third}").selectExpr("doc_id", "source_base", "block_no", "text", "TIMESTAMP '2026-01-01 12:00:00' AS arrived"))
        if third != 0:
            stream.run()
    want = table(analysed(blocks, "es"))
    assert stream.rows().count() == want.count() > 3000
    assert stream.rows().exceptAll(want).count() == 0


def test_lists_go_on_over_batches(spark, tmp_path):
    stream = Stream(spark, tmp_path)
    for n, text in enumerate(["Los derechos de los socios son:", "- a) votar", "- b) hablar"]):
        stream.put([block(n, text)])
    stream.run()
    assert [r[1:4] for r in short(stream)] == [("seg_0001", None, "Los derechos de los socios son:"), ("seg_0002", "seg_0001", "- a) votar"), ("seg_0003", "seg_0001", "- b) hablar")]


def test_a_gap_is_given_up_and_what_fills_it_later_is_noted(spark, tmp_path):
    stream = Stream(spark, tmp_path, patience="10 minutes")
    stream.put([block(0, "Los socios deben votar siempre."), block(2, "Los socios deben pagar la cuota.")])
    stream.put([block(0, "Otro texto de otra norma.", 21, "e")])  # the watermark passes 12:10
    stream.put([block(0, "Nada nuevo en otra norma.", 21, "f")])
    stream.run()
    assert [r[3] for r in short(stream) if r[0] == "d"] == ["Los socios deben votar siempre.", "Los socios deben pagar la cuota."]
    stream.put([block(1, "Los socios deben asistir a todo.", 12), block(2, "Los socios deben pagar la cuota.", 12)])
    stream.put([block(1, "Los socios deben asistir a todo.", 13)])
    stream.run()
    got = [r for r in short(stream) if r[0] == "d"]
    assert [r[3] for r in got] == ["Los socios deben votar siempre.", "Los socios deben pagar la cuota.", "Los socios deben asistir a todo."]
    assert [r[1] for r in got] == ["seg_0001", "seg_0002", "seg_0003"] and "late_block" in got[2][4] and "late_block" not in got[0][4] + got[1][4]


def test_a_document_is_forgotten_after_two_patiences(spark, tmp_path):
    stream = Stream(spark, tmp_path, patience="10 minutes")
    for n, doc in enumerate("defg"):
        stream.put([block(0, f"Los socios de {doc} deben votar.", 31 * n, doc)])
    query = stream.run()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] < 4 * 3 and {r[0] for r in short(stream)} == set("defg")


def test_odd_blocks(spark, tmp_path):
    stream = Stream(spark, tmp_path)
    stream.put([block(0, None), block(1, ""), block(2, "<!-- nada -->"), block(3, "Los socios deben votar."), block(3, "Los socios deben votar."), block(None, "Sin número de bloque."), (None, None, 0, "Los socios de nadie votan.", None)])
    stream.put([block(3, "Los socios deben votar."), block(4, "x " * 60_000 + "fin.")])
    stream.run()
    got = short(stream)
    assert [r[3] for r in got if r[0] is None] == ["Los socios de nadie votan."]
    own = [r for r in got if r[0] == "d"]
    assert [(r[1], len(r[3]) > 100_000, "late_block" in r[4]) for r in own] == [("seg_0001", False, False), ("seg_0002", False, True), ("seg_0003", True, False)]


def test_an_empty_stream_and_a_language_that_no_block_knows(spark, tmp_path):
    stream = Stream(spark, tmp_path)
    stream.put(spark.createDataFrame([], SCHEMA))
    stream.run()
    with pytest.raises(ValueError, match="one by one"):
        piece_segments(spark.createDataFrame([], SCHEMA), "auto")


def test_running_state_equals_the_windows_on_random_events(spark):
    from pyspark.sql import functions as F

    from statutegrid.operators import segments as G
    from statutegrid.streaming.pieces import Pieces, Progress

    dice = random.Random(5)
    kinds = {"X": "heading", "T": "body_sentence", "H": "list_header", "L": "list_header", "C": "list_item", "I": "list_item", "S": "list_header"}
    rows = []
    for doc in range(200):
        for n in range(dice.randint(1, 25)):
            kind = dice.choice("XTHLCIIIIS")
            long = kind == "I" and dice.random() < 0.3
            text = ("1) " + "Los socios deben votar en la asamblea. " * (6 if long else 1)).strip()
            ref = {"title": None, "chapter": dice.choice([None, "2"]), "article": dice.choice([None, "7"])} if kind == "X" else None
            rows.append((doc, n, 0, 0, 0, kind, kinds[kind], text, ref, dice.choice(["letter", "number", "bullet"]) if kind in "LIS" else None))
    frame = spark.createDataFrame(rows, "doc_id int, block_no int, sub_no int, piece_no int, emit_no int, kind string, type string, text string, ref struct<title:string,chapter:string,article:string>, family string")
    want = [tuple(r) for r in G.number(G.list_state(frame)).select("doc_id", "segment_id", "parent_segment_id", "chapter", "article", "segment_type", "segment_text").orderBy("doc_id", "segment_order").collect()]
    from statutegrid.functions import patterns as P
    from statutegrid.operators.sentences import split_sentences

    parts = F.when((F.col("kind") == "I") & (F.length("text") >= P.PARAGRAPH_ITEM_CHARS), split_sentences(F.col("text")))
    states, got = {}, []
    for r in frame.withColumn("parts", parts).orderBy("doc_id", "block_no").collect():
        refs = r["ref"].asDict() if r["ref"] else {"title": None, "chapter": None, "article": None}
        event = r.asDict() | refs | {"source_base": None, "language": "es"}
        got += [(r["doc_id"], s[3], s[4], s[7], s[8], s[9], s[12]) for s in Pieces._segments((r["doc_id"],), states.setdefault(r["doc_id"], Progress()), [event])]
    assert got == want and any(w[2] for w in want)


class Store:
    """A group's state as a processor sees it, and how often it was asked."""

    def __init__(self):
        self.values, self.maps, self.timers, self.calls = {}, {}, set(), 0

    def getValueState(self, name, schema):  # noqa: N802
        store = self

        class Value:
            def get(self):
                store.calls += 1
                return store.values.get(name)

            def update(self, value):
                store.calls += 1
                store.values[name] = tuple(value)

            def clear(self):
                store.calls += 1
                store.values.pop(name, None)

            def exists(self):
                store.calls += 1
                return name in store.values

        return Value()

    def getMapState(self, name, key, value):  # noqa: N802
        held, store = self.maps.setdefault(name, {}), self

        class Map:
            def __getattr__(self, call):
                store.calls += 1
                return {"containsKey": held.__contains__, "getValue": held.get, "removeKey": held.pop, "updateValue": held.__setitem__, "keys": lambda: iter(list(held)), "clear": held.clear, "iterator": lambda: iter(list(held.items()))}[call]

        return Map()

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.discard(at)


def arriving(numbers, docs, at=1000):
    import json

    event = {"sub_no": 0, "piece_no": 0, "emit_no": 0, "kind": "T", "type": "body_sentence", "source_base": "x", "language": "es"}
    return [{"doc_id": d, "block_no": n, "event": json.dumps(event | {"text": f"{d}: {n}"}), "_arrived_ms": at} for d in docs for n in numbers]


def clock(watermark):
    from types import SimpleNamespace

    return SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark, getExpiryTimeInMs=lambda: watermark - 1)


def texts(rows):
    return [(r["doc_id"], at, text) for r in rows for at, text in zip(r["segment_order"], r["segment_text"])]


@pytest.mark.parametrize("room", [1 << 20, 100, 0])
def test_the_store_is_asked_by_group_not_by_document_or_block(monkeypatch, room):
    from statutegrid.streaming import pieces

    monkeypatch.setattr(pieces, "HELD_CHARS", room)
    store, docs, got = Store(), [f"d{n}" for n in range(40)], []
    for part in ((2, 5, 8), (0, 3, 6), (1, 4, 7)):
        processor = pieces.Pieces(500)  # each micro-batch has its own
        processor.init(store)
        before = store.calls
        got += texts(processor.handleInputRows((7,), iter(arriving(part, docs)), clock(0)))
        assert room <= 100 or store.calls - before <= 3
    assert sorted(got) == sorted((d, n + 1, f"{d}: {n}") for d in docs for n in range(9))
    assert not store.maps["waiting"] and len(store.timers) == 1


def test_each_document_of_a_group_has_its_own_patience(monkeypatch):
    from statutegrid.streaming import pieces

    store = Store()
    processor = pieces.Pieces(500)
    processor.init(store)
    assert texts(processor.handleInputRows((7,), iter(arriving([2], ["a"], 1000) + arriving([2], ["b"], 1300)), clock(0))) == [] and store.timers == {1500}
    ring = lambda at: texts(processor.handleExpiredTimer((7,), clock(at + 1), clock(at + 1)))
    assert ring(1500) == [("a", 1, "a: 2")] and 1800 in store.timers  # b's patience ends later
    assert texts(processor.handleInputRows((7,), iter(arriving([0], ["b"], 1600)), clock(1501))) == [("b", 1, "b: 0")]
    assert ring(1800) == [] and ring(2000) == [] and 2100 in store.timers  # a is forgotten, b waits for block 1 up to 2100
    assert ring(2100) == [("b", 2, "b: 2")] and ring(2600) == [] and not store.values
