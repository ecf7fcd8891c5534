import pytest
from pyspark.sql import functions as F

from statutegrid.operators import structure as S
from statutegrid.operators.sentences import split_sentences

CLASSES = [
    ("CONSIDERANDO que es necesario", "SKIP"), ("Vistos los antecedentes", "SKIP"), ("Preámbulo general", "SKIP"), ("preambulo", "SKIP"), ("Por lo tanto, se acuerda", "SKIP"),
    ("Dado en Lima el lunes", "SKIP"), ("El Presidente", "SKIP"), ("El Presidente.", "SKIP"), ("El Presidente convocará a la asamblea", "RELEVANT"), ("La Secretaria,", "SKIP"),
    ("En Málaga, a 5 de mayo", "SKIP"), ("Firma del socio", "SKIP"), ("Lugar y fecha:", "SKIP"), ("WHEREAS the members", "SKIP"), ("We the households come together", "SKIP"),
    ("We " + "x" * 90 + " come together", "RELEVANT"), ("The above rules at a general meeting held", "SKIP"), ("This regulation when drafted", "SKIP"), ("", "SKIP"), ("  \n", "SKIP"),
    ("Artículo 5", "METADATA"), ("ARTÍCULO 5", "METADATA"), ("Art. 12. Texto", "METADATA"), ("Capítulo IV", "METADATA"), ("Título II", "METADATA"), ("Sección 3", "METADATA"),
    ("Disposición final", "METADATA"), ("Anexo I", "METADATA"), ("Anexo", "RELEVANT"), ("Section 4.2", "METADATA"), ("Sec. 3", "METADATA"), ("Annex A", "METADATA"),
    ("MEMBERSHIP", "METADATA"), ("Membership.", "METADATA"), ("MEMBERSHIP 2024", "METADATA"), ("Membership is open", "RELEVANT"), ("MEMBERSHIP RULES", "RELEVANT"), ("QUORUMS", "RELEVANT"),
    ("Article members", "METADATA"), ("Capítulo introductorio", "METADATA"), ("Los socios pagarán", "RELEVANT"),
]


def column(spark, texts, f, *more):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"), *more)).collect()]


def test_classes(spark):
    assert column(spark, [t for t, _ in CLASSES], S.classify_block) == [c for _, c in CLASSES]


def test_subtypes(spark):
    assert column(spark, ["Firmado por", "El Tesorero", "CONSIDERANDO", "Dated today"], S.skip_subtype) == ["signature", "signature", "preamble", "signature"]
    assert column(spark, ["Anexo II", "Annexes", "Artículo 1"], S.metadata_subtype) == ["annex", "heading", "heading"]


def test_references(spark):
    texts = ["Título II. De todo. Capítulo 3. Las reglas.\nArtículo 5º. x", "Chapter 4: Fees\nSection 2.1", "a título individual", "nada", "Chapter 1. A\nCapítulo 2. B", "Capítulo 2: B", None]
    got = [r and tuple(r) for r in column(spark, texts, S.article_ref)]
    assert got == [("II. De todo", "3. Las reglas", "5"), (None, "4: Fees", "2.1"), ("i", None, None), (None, None, None), (None, "1. A", None), (None, "2", None), (None, None, None)]


def test_markers(spark):
    lines = ["- uno", "a) uno", "(b) dos", "1. tres", "12) x", "iv) y", "i) z", "civil. w", "x uno", "a)", "-x", "123) no"]
    assert column(spark, lines, S.is_item) == [True, True, True, True, True, True, True, True, False, False, False, False]
    assert column(spark, ["- a) x", "ii) x", "i) x", "3) x", "- x", "• iv. x", "x"], S.marker_family) == ["letter", "roman", "letter", "number", "bullet", "roman", "bullet"]


def test_page_blocks(spark):
    long = "x" * 300 + " Artículo 5. " + "y" * 100 + " véase la Section 4 aquí, subsection 3"
    parts = column(spark, [long, "corto Artículo 5. y"], S.page_blocks)
    assert [p[:10] for p in parts[0]] == ["x" * 10, "Artículo 5", "Section 4 "] and "".join(parts[0]).replace(" ", "") == long.replace(" ", "")
    assert parts[1] == ["corto Artículo 5. y"]


def test_inline_article_and_heading(spark):
    texts = ["Art. 5. Para el control de aguas", "Artículo 3 – corto", "Capítulo 3: Conservación", "Article 2: The members shall meet"]
    assert [tuple(r) for r in column(spark, texts, S.inline_article)] == [
        ("Art. 5", "Para el control de aguas"), ("Artículo 3 – corto", ""), ("Capítulo 3: Conservación", ""), ("Article 2:", "The members shall meet"),
    ]
    long = "Section 15(6)).\n" + "The members pay. " * 10
    assert [tuple(r) for r in column(spark, [long, "Capítulo 1\nalgo", texts[0]], S.heading_body)] == [("Section 15(6)).", long.split("\n")[1].strip()), ("Capítulo 1\nalgo", ""), ("Art. 5.", "Para el control de aguas")]


def test_pieces(spark):
    got = column(spark, ["Uno:\n- a\n  sigue\nDos\r\nii) b\n\n tres\x1cCuatro", "minúscula\notra", ""], S.block_pieces)
    assert [tuple(p) for p in got[0]] == [("text", "Uno:"), ("item", "- a sigue"), ("text", "Dos"), ("item", "ii) b tres"), ("text", "Cuatro")]
    assert [tuple(p) for p in got[1]] == [("text", "minúscula otra")] and got[2] == []


def test_inline_lists(spark):
    got = column(spark, ["Se prohíbe: a) pescar; b) cazar.", "Se prohíbe: a) pescar, b) cazar", "Sin dos puntos a) x; b) y", "Uno: a) solo", "Pasos: 1. uno. 2. dos: 3) tres", "Upper: A) x; B) y"], S.inline_list)
    assert (got[0]["header"], got[0]["items"]) == ("Se prohíbe:", ["a) pescar;", "b) cazar."])
    assert (got[4]["header"], got[4]["items"]) == ("Pasos:", ["1. uno.", "2. dos:", "3) tres"])
    assert [got[i] for i in (1, 2, 3, 5)] == [None] * 4


def test_sentences(spark):
    texts = [
        "Los socios pagan la cuota anual. El comité decide sobre ello! Y nada más pasa?", "2. DUES: Members pay the yearly dues in May.", "El comité decide sobre el agua. a) con voto secreto y directo",
        "Los socios pagan la cuota anual. Sí.", "", None, "1. El primero de todos los puntos.", "Se paga según Sect. 1 by paying the amount of dues.",
    ]
    assert column(spark, texts, split_sentences) == [
        ["Los socios pagan la cuota anual.", "El comité decide sobre ello! Y nada más pasa?"], ["2. DUES: Members pay the yearly dues in May."], ["El comité decide sobre el agua. a) con voto secreto y directo"],
        ["Los socios pagan la cuota anual. Sí."], [], [], ["1. El primero de todos los puntos."], ["Se paga según Sect. 1 by paying the amount of dues."],
    ]


@pytest.mark.parametrize("text,want", [("a <!-- x\ny --> b <!--z-->", "a   b"), ("<!-- a -->", ""), ("<!-- open", "<!-- open")])
def test_comments(spark, text, want):
    assert column(spark, [text], S.strip_comments) == [want]
