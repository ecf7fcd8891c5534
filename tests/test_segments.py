import random

from pyspark.sql import functions as F

from statutegrid.operators import blocks as B
from statutegrid.operators import segments as G


def segments(spark, text, form="md"):
    docs = spark.createDataFrame([("d", "1. x.md", text)], "doc_id string, source_base string, text string")
    return [r.asDict() for r in G.segment(B.blocks_of(docs, form)).orderBy("segment_order").collect()]


def short(rows):
    return [(r["segment_type"], r["segment_text"], r["parent_segment_id"]) for r in rows]


def test_header_adopts_items_over_blank_lines(spark):
    assert short(segments(spark, "Los derechos de los socios son:\n\n- a) votar\n\n- b) hablar")) == [
        ("list_header", "Los derechos de los socios son:", None), ("list_item", "- a) votar", "seg_0001"), ("list_item", "- b) hablar", "seg_0001"),
    ]


def test_sub_headers(spark):
    assert short(segments(spark, "Se debe llevar siempre:\n- a) ropa\n- b) Su equipo:\n- casco"))[2:] == [("list_header", "- b) Su equipo:", "seg_0001"), ("list_item", "- casco", "seg_0003")]


def test_long_numbered_paragraphs_are_body_text(spark):
    long = "1) " + "El comité administra los recursos de la comunidad con cuidado. " * 2 + "Los socios lo vigilan en cada asamblea."
    got = segments(spark, long)
    assert [r["segment_type"] for r in got] == ["body_sentence"] * 3 and all(r["parent_segment_id"] is None for r in got)
    got = short(segments(spark, f"Las faltas de los socios son:\na) robar\nb) mentir\n3{long[1:]}\n4) corto"))
    assert [g[0] for g in got] == ["list_header", "list_item", "list_item", "body_sentence", "body_sentence", "body_sentence", "list_item"] and got[-1][2] == "seg_0006"


def test_roman_lists_close_after_the_first_item(spark):
    assert [g[2] for g in short(segments(spark, "Los motivos de la baja son:\ni) uno\nii) dos\niii) tres"))] == [None, "seg_0001", None, None]


def test_orphans_and_bodies(spark):
    assert short(segments(spark, "- suelto")) == [("list_item", "- suelto", None)]
    assert short(segments(spark, "Los socios tienen los derechos siguientes.\n- votar"))[1][2] == "seg_0001"
    assert short(segments(spark, "Los socios votan siempre.\nCONSIDERANDO eso\n- votar"))[2] == ("list_item", "- votar", None)


def test_short_document_is_swallowed_by_its_first_words(spark):
    assert short(segments(spark, "CONSIDERANDO esto.\nArtículo 1. Los socios deben votar.")) == [("preamble", "CONSIDERANDO esto.\nArtículo 1. Los socios deben votar.", None)]


def test_whole_regulation(spark):
    text = (
        "CONSIDERANDO la necesidad de ordenar el uso del agua en esta comunidad de regantes y vecinos, que de antiguo la comparten.\n"
        "Capítulo 1. De los socios\nArtículo 1. Los socios pagarán la cuota anual fijada por la asamblea. La asamblea fija la cuota cada año.\n"
        "Artículo 2. Son obligaciones de los socios:\n- a) asistir a la asamblea\n- b) cuidar las acequias\n<!-- AUDIT -->\nAnexo I\nTabla de cuotas de la comunidad\nEn Málaga, a 5 de mayo de 2020\nEl Presidente\n"
        "Las demás cuestiones se resolverán por la asamblea general en la primera sesión que celebre después de que se planteen."
    )
    assert len(text) > 400
    got = segments(spark, text)
    kinds = [(r["segment_type"], r["article"]) for r in got]
    assert kinds[:6] == [("preamble", None), ("heading", None), ("heading", "1"), ("body_sentence", "1"), ("body_sentence", "1"), ("heading", "2")]
    assert [r["segment_type"] for r in got][-4:] == ["body_sentence", "signature", "signature", "body_sentence"]
    assert "annex" in [r["segment_type"] for r in got] and not any("AUDIT" in r["segment_text"] for r in got)
    items = [r for r in got if r["is_list_item"]]
    assert len(items) == 2 and len({r["parent_segment_id"] for r in items}) == 1 and items[0]["parent_segment_id"]
    assert all(r["chapter"] == "1. De los socios" for r in got[1:]) and [r["segment_order"] for r in got] == list(range(1, len(got) + 1))


def fold(rows):
    """The list state as a plain loop: (closed, splits, parent position) of each event."""
    header = body = family = None
    out = []
    for n, (kind, fam, long) in enumerate(rows):
        closed, parent = None, None
        if kind == "X":
            header = body = family = None
        elif kind == "T":
            header, body = None, n
        elif kind == "H":
            header, body, family = n, None, None
        elif kind == "L":
            header, family = n, fam
        else:
            if header is not None and family is not None and fam != family:
                header = body = family = None
            closed = header is None
            if kind == "S":
                parent, header, body, family = header, n, None, None
            elif header is not None:
                parent, family = header, family or fam
            elif long:
                body = n
            else:
                parent, family = body, family or fam
        out.append((closed, bool(closed and kind == "I" and long), parent))
    return out


def test_windows_equal_the_fold_on_random_streams(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for doc in range(300):
        stream = []
        for _ in range(rng.randint(1, 25)):
            kind = rng.choice("XTHLSIIIIII")
            stream.append((kind, rng.choice(["letter", "number", "bullet"]) if kind in "LSI" else None, rng.random() < 0.2))
        want[doc] = fold(stream)
        for n, (kind, fam, long) in enumerate(stream):
            rows.append((doc, 0, 0, 0, n, kind, {"I": "list_item", "T": "body_sentence", "X": "heading"}.get(kind, "list_header"), "x" * 130 if long else "corto", None, fam))
    schema = "doc_id int, block_no int, sub_no int, piece_no int, emit_no int, kind string, type string, text string, ref struct<title:string,chapter:string,article:string>, family string"
    state = G.list_state(spark.createDataFrame(rows, schema).repartition(3)).cache()
    got = {}
    for r in state.collect():
        got[r["doc_id"], r["emit_no"]] = (r["closed"], r["splits"])
    assert got == {(d, n): w[:2] for d, stream in want.items() for n, w in enumerate(stream)}
    # every text is one sentence, so places are numbers
    for r in G.number(state).collect():
        parent = want[r["doc_id"]][r["segment_order"] - 1][2]
        assert r["parent_segment_id"] == (None if parent is None else f"seg_{parent + 1:04d}")


def test_blocks(spark):
    docs = spark.createDataFrame([(1, "a\nb\n\n\n c \n\n \n")], "doc_id int, text string")
    assert [r["text"] for r in B.blocks_of(docs, "txt").orderBy("block_no").collect()] == ["a b", "c"]
    md = "uno\n\n**dos** y [tres](http://x)\n---\n# Título \ncuatro\n##sin\n####### siete\n–––\n"
    docs = spark.createDataFrame([(1, md), (2, None), (3, "")], "doc_id int, text string")
    assert [(r["doc_id"], r["text"]) for r in B.blocks_of(docs).orderBy("block_no").collect()] == [(1, "uno\ndos y tres"), (1, "Título"), (1, "cuatro\n##sin\n####### siete")]
    assert G.segment(B.blocks_of(docs).withColumn("source_base", F.lit("x")).limit(0)).count() == 0
