import re

from pyspark.sql import functions as F

import pytest

from statutegrid.llm import surrogates
from tests.llm import plain_surrogates

MIXED = [
    "Dr Anna Kovacs and Mrs. Anna Smith met Prof. Dr. Maria Garcia. Later Anna's friend Smith left; Maria agreed, and so did Kovacs-Smith.",
    "Mr John Smith signed. Later Smith left; John Smith agreed, a smith and a Smithson did not. Fräulein Schmidt, Herr Dr. Karl Lang.",
    "Κυρία Μαρία Παπαδοπούλου και Κύριος Νίκος Ρίτσος: Ρίτσος. Госпожа Анна Петрова и Петрова.",
    "212-555-0188 is (212) 555-0188 is +1 (212) 555-0188 is 212.555.0188, not 1212-555-01888; 123-45-6789 and 20-2125-550188",
    "IBAN DE89 3704 0044 0532 0130 00, DE89370400440532013000 or GB82 WEST 1234 5698 7654 32 WORD; order AB12 CD34 EF56 GH78, DE88 3704 0044 0532 0130 00",
    "Mail John.Doe@Example.com, john.doe@example.com and JOHN.DOE@EXAMPLE.COM",
    "a \ufdd0 and a \ufdd0\ufdd2 stay, 8.8.8.8\ufdd0 goes: \ufdd0123-45-6789",
    "Mr Martin met Martin Luther and Dr Martin Luther; Mr O'Brien-Lee's car, O'Brien-Lee's house",
    "Ms Petra Zoll and DR. PETRA ZOLL; ZOLL-X, Zoll, zollfrei; Dr Petra Zoll",
    "password = correct-horse-battery-staple; no card 1234567890123456 but 378282246310005 and 4111-1111-1111-1111",
    "", " \n ", None, "nothing here",
]


def run(spark, texts, **more):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kind string").repartition(3)
    return {r["doc_id"]: r for r in surrogates.pseudonymised(df, **more).collect()}


def luhn(number):
    digits = [int(c) for c in reversed(number)]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def test_types_formats_and_coreference(spark):
    texts = [
        "Write to Anna.B-1@Mail.Example.org or ANNA.B-1@MAIL.EXAMPLE.ORG!!",
        "Card 4111 1111 1111 1111 or 4111111111111111, 7536784127813050 4845168114407329 no 1234567890123456",
        "from 93.184.216.34, not 1.2.3.4.5 or 300.1.1.1; +1 (743) 555-3824 and +1### (743)*** 555-3824&&& then 10.20.30.40",
        'token = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b" TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"',
        "Mrs. Anna Smith met Mr. John Smith. MR. SMITH left. Госпожа Анна Петрова; Frau Özil-Weiß.",
        "DE89 3704 0044 0532 0130 00, 123-45-6789",
    ]
    got = run(spark, texts)
    t = [got[i]["text"] for i in range(len(texts))]
    low, up = re.match(r"Write to ([\w.-]+@[\w.]+\.example) or ([\w.-]+@[\w.]+\.EXAMPLE)!!$", t[0]).groups()
    assert low.upper() == up and "anna" not in low.lower()
    spaced, solid, decoy, second, last = re.match(r"Card (\d{4} \d{4} \d{4} \d{4}) or (\d{16}), (\d{16}) (\d{16}) no (\d{16})$", t[1]).groups()
    assert spaced.replace(" ", "") == solid != "4111111111111111" and luhn(solid) and solid[0] == "4"
    assert decoy == "7536784127813050" and last == "1234567890123456" and second != "4845168114407329" and luhn(second)
    assert re.match(r"from 10\.\d+\.\d+\.\d+, not 1\.2\.3\.4\.5 or 300\.1\.1\.1; \+1 \((\d{3})\) (\d{3}-\d{4}) and \+1### \(\1\)\*\*\* \2&&& then 10\.", t[2])
    assert "743" not in t[2] and "10.20.30.40" not in t[2]
    a, b = re.match(r'token = "([0-9a-f]{40})" TOKEN = "([0-9A-F]{40})"$', t[3]).groups()
    assert a.upper() == b and a != texts[3][9:49]
    f, s1, m, s2, loud, g, n = re.match(r"Mrs\. (\w+) (\w+) met Mr\. (\w+) (\w+)\. MR\. (\w+) left\. Госпожа (\w+) (\w+); Frau [\w-]+\.$", t[4]).groups()
    assert s1 == s2 != "Smith" and loud == s1.upper() and f != "Anna" and m != "John" and "Özil" not in t[4]
    assert re.fullmatch("[А-Я][а-я]+", g) and re.fullmatch("[А-Я][а-я]+", n) and g != "Анна" and n != "Петрова"
    assert re.fullmatch(r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d, \d{3}-\d{2}-\d{4}", t[5]) and "3704" not in t[5]
    assert [got[i]["n_entities"] for i in range(6)] == [2, 3, 4, 2, 4, 2]


def test_each_kind_is_found_in_a_text_with_nothing_else(spark):
    value = "correct-horse-battery-staple"
    words = "token secret password passwd apikey api_key api-key accesskey access_key access-key Password PASSWD".split()
    texts = [f"{w}{mark}{value}" for w in words for mark in (" = ", ": ", "=", ' : "')]
    texts += [f"the {w} = {value} of host number 7" for w in words]  # found before, as it holds a digit
    got = run(spark, texts)
    assert all(r["n_entities"] == 1 and value not in r["text"] for r in got.values())
    drawn = {re.search(r"[=:]\s?\"?([a-z-]+)", r["text"])[1] for r in got.values()}
    assert len(drawn) == 1  # one secret, one surrogate
    names = [f"{t}{dot} Özil" for t in (surrogates._MALE + "|" + surrogates._FEMALE).split("|") for dot in ("", ".")]
    got = run(spark, names + ["no password here, only tokens: short"])
    assert [got[i]["n_entities"] for i in range(len(names) + 1)] == [1] * len(names) + [0]


def test_genders_and_keys(spark):
    texts = [f"Herr {n} und Frau {n}" for n in ("Karl Lang", "Eva Kurz")]
    got = run(spark, texts)
    ends = {k: v.split() for k, v in surrogates._ENDS.items()}
    for r in got.values():
        he, she = re.match(r"Herr (\w+) \w+ und Frau (\w+) \w+$", r["text"]).groups()
        assert he.endswith(tuple(ends["latin", "given_m"])) and she.endswith(tuple(ends["latin", "given_f"]))
    assert run(spark, texts) == got and run(spark, texts, key="other") != got


def test_distinct_entities_stay_apart_where_first_draws_collide(spark):
    # two-letter names leave little room: many draws collide
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b for a in letters for b in letters]
    texts = [f"{w}@x.org und {w}@x.org" for w in words] * 2
    got = run(spark, texts)
    pairs = {}
    for i, t in enumerate(texts):
        one, two = got[i]["text"].split(" und ")
        assert one == two
        pairs.setdefault(t, set()).add(one)
    assert all(len(v) == 1 for v in pairs.values())
    drawn = [next(iter(v)) for v in pairs.values()]
    assert len(set(drawn)) == len(words)
    names = [f"Mr. {a}{b}" for a in "ABCDEFGHIJ" for b in ("da", "do", "na", "ne", "ro", "ru", "sa", "si")]
    got = run(spark, names * 30)
    assert len({r["text"] for r in got.values()}) == len(names)


def test_a_name_is_one_entity_in_all_texts_whatever_its_titles(spark):
    texts = ["Ms Anna Kovacs came", "Dr Anna Kovacs went", "Prof. Anna Lang", "Mr Kim Bo", "Mr Kim Bo again", "Mrs Kim Bo", "Dr Kim Bo", "Dr Alex Bo", "DR. ANNA left Dr Anna"]
    got = run(spark, texts, key="k")
    given = [re.sub(r"^(?:Ms|Dr|Mr|Mrs|Prof\.) ", "", got[i]["text"]).split(" ")[0] for i in range(8)]
    assert given[0] == given[1] == given[2] and given[3] == given[4] == given[6] != given[5]
    assert given[0].endswith(tuple(surrogates._ENDS["latin", "given_f"].split())) and given[7].endswith(tuple(surrogates._ENDS["latin", "given_n"].split()))
    assert not re.search("(?i)anna|kovacs", " ".join(got[i]["text"] for i in (0, 1, 2, 8)))
    assert [(got[i]["text"], got[i]["n_entities"]) for i in range(len(texts))] == plain_surrogates.pseudonymised(texts, "k")


def test_odd_rows(spark, odd_docs, no_docs):
    out = surrogates.private_documents(odd_docs)
    assert out.columns == odd_docs.columns
    key = lambda r: (str(r["doc_id"]), str(r["lang"]))
    for a, b in zip(sorted(odd_docs.collect(), key=key), sorted(out.collect(), key=key), strict=True):
        assert a["text"] == b["text"] and b["n_chars"] == (None if a["text"] is None else len(a["text"]))
    assert surrogates.pseudonymised(no_docs).count() == 0
    long = "8.8.8.8 " * 20_000
    df = spark.createDataFrame([(1, long, 3), (1, "a@b.org", 3), (None, "a@b.org", 3)], "doc_id long, text string, n_entities int")
    got = surrogates.pseudonymised(df).collect()
    assert max(r["n_entities"] for r in got) == 20_000 and len({r["text"] for r in got if r["n_entities"] == 1}) == 1
    assert not any("8.8.8.8" in r["text"] for r in got)
    assert surrogates.private_documents(df).columns == df.columns


def test_native(spark, odd_docs):
    plan = surrogates.pseudonymised(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and F.lit(1) is not None


def test_texts_are_those_of_the_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    texts = MIXED + [r["text"] for r in docs]
    got, want = run(spark, texts, key="k"), plain_surrogates.pseudonymised(texts, "k")
    for i, (text, n) in enumerate(want):
        assert (got[i]["text"], got[i]["n_entities"]) == (text, n)
    assert sum(n > 0 for _, n in want) > 30


def test_names_found_once_go_wherever_they_stand(spark):
    got = run(spark, MIXED, key="k")
    text = [got[i]["text"] for i in range(len(MIXED))]
    assert not re.search(r"\b(Anna|Kovacs|Smith|Maria|Garcia)\b", text[0].replace("Kovacs-Smith", ""))
    anna, kovacs, anna2, smith, maria, _, anna3, smith2, maria2 = re.match(
        r"Dr (\w+) (\w+) and Mrs\. (\w+) (\w+) met Prof\. Dr\. (\w+) (\w+)\. Later (\w+)'s friend (\w+) left; (\w+) agreed", text[0]
    ).groups()
    assert anna == anna2 == anna3 and smith == smith2 and maria == maria2 and kovacs != smith
    assert anna.endswith(tuple(surrogates._ENDS["latin", "given_f"].split())) and maria.endswith(tuple(surrogates._ENDS["latin", "given_n"].split()))
    assert "John" not in text[1] and not re.search(r"\bSmith\b", text[1]) and "a smith and a Smithson did not" in text[1] and "Schmidt" not in text[1]
    assert re.match(r"Κυρία (\p{Greek}+ ){2}και Κύριος \p{Greek}+ (\p{Greek}+): \2\. Госпожа \p{Cyrillic}+ (\p{Cyrillic}+) и \3\.$".replace(r"\p{Greek}", "[Ͱ-Ͽ]").replace(r"\p{Cyrillic}", "[Ѐ-ӿ]"), text[2])
    a, b, c, d = re.match(r"([\d-]{12}) is \((\d{3}\) \d{3}-\d{4}) is \+1 \((\d{3}\) \d{3}-\d{4}) is ([\d.]{12}), not 1212-555-01888; \d{3}-\d\d-\d{4} and 20-2125-550188$", text[3]).groups()
    assert len({re.sub(r"\D", "", x) for x in (a, b, c, d)}) == 1 and a != "212-555-0188"
    one, two, three = re.match(r"IBAN (DE[\d ]{25}), (DE\d{20}) or (GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d) WORD; order AB12 CD34 EF56 GH78, DE88 3704 0044 0532 0130 00$", text[4]).groups()
    assert one.replace(" ", "") == two != "DE89370400440532013000"
    assert all(plain_surrogates.mod_97(x.replace(" ", "")[4:] + x[:4]) == 1 for x in (one, three))
    assert re.match(r"Mail [A-Z][a-z]{3}\.[A-Z][a-z]{2}@[A-Z][a-z]{6}\.example, [a-z.]+@[a-z]+\.example and [A-Z.]+@[A-Z]+\.EXAMPLE$", text[5])
    assert text[6].startswith("a \ufdd0 and a \ufdd0\ufdd2 stay, 10.") and "123-45" not in text[6] and "8.8.8.8" not in text[6]


def test_a_dense_kind_gets_longer_forms(spark, monkeypatch):
    monkeypatch.setattr(surrogates, "ATTEMPTS", 1)
    entities = spark.createDataFrame([("ssn", f"{i}") for i in range(10)], "kind string, norm string")
    other = {r["norm"]: r["core"] for r in surrogates.redraws(entities, "k").collect()}
    assert len(other) == 10 and len(set(other.values())) == 10 and all(len(x) > 1 and x.isdigit() for x in other.values())
    assert other == {n: c for (_, n), c in plain_surrogates.settled({("ssn", f"{i}") for i in range(10)}, "k").items()}


def test_a_key_is_required_where_others_could_guess_it(spark):
    class Elsewhere:
        class sparkContext:
            master = "yarn"

        class conf:
            get = staticmethod(lambda name, default: default)

    with pytest.raises(RuntimeError, match="key"):
        surrogates.secret_key(Elsewhere)
    assert surrogates.secret_key(Elsewhere, "given") == "given"
    assert surrogates.secret_key(spark) == surrogates.secret_key(spark) != surrogates.QUERY_KEY


def test_columns_of_any_name_come_through(spark):
    own = "row new redrawn h text2 kind core m _found _redrawn _given a.b".split()
    docs = spark.createDataFrame([(1, "8.8.8.8", *range(len(own)))], "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in own))
    out = surrogates.private_documents(docs, "k")
    assert out.columns == docs.columns and tuple(out.first())[2:] == tuple(range(len(own)))
