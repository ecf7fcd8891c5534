import random

from pyspark.sql import functions as F

from statutegrid.llm import line_rules
from tests.llm.brute import WORDS


def repeated(words, window=8):
    grams = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
    hit = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            hit |= set(range(i, i + window))
    return len(hit)


def test_repeat_words_against_brute_force():
    rng = random.Random(1)
    for n in list(range(0, 20)) + [40, 80]:
        for letters in ("ab", "abc", "abcdefgh"):
            words = [rng.choice(letters).encode() for _ in range(n)]
            assert line_rules.repeat_words(words) == repeated(words)


def test_common_lines_go_and_depleted_documents_are_rejected(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    body = lambda i: " ".join(letters[i // 26] + letters[i % 26] + letters[k] for k in range(25))
    shared = "the same footer line 2024 on every page of this very host here"
    rows = [(i, f"{body(i)}\n{shared.upper() if i % 2 else shared}", "h", i) for i in range(60)]
    rows += [(100, f"{shared}\n{shared}\n{shared} ", "h", 0)]  # nothing else in it
    rows += [(200 + i, f"{shared}\n{body(400 + i)}", "other", 0) for i in range(5)]  # on every page of a small host
    rows += [(500 + i, f"{shared}\n{body(i)}" if i < 5 else body(i), "large", 0) for i in range(200)]  # rare on its host
    rows += [(300 + i, body(600), "h", 0) for i in range(50)]  # copies of one document are one document
    got = {r["doc_id"]: r for r in line_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int"), F.col("source")).collect()}
    assert all(got[i]["kept"] and got[i]["lines_removed"] == 1 and got[i]["words_removed"] == 13 for i in range(60))
    assert not got[100]["kept"] and got[100]["lines_removed"] == 3
    assert all(got[200 + i]["lines_removed"] == 1 for i in range(5)) and all(got[500 + i]["lines_removed"] == 0 for i in range(200))
    assert all(got[300 + i]["kept"] for i in range(50))
    assert line_rules.clean(rows[1][1], got[1]["removed"]) == body(1)


def test_one_law_at_all_host_sizes(spark):
    """The least number of documents that makes a line common grows by one for each 50 documents of the host, from the smallest host on."""
    made = lambda host, docs, n: [(0, f"{host} own text {chr(97 + i // 26)}{chr(97 + i % 26)}" + ("\nthe line" if i < n else ""), host) for i in range(docs)]
    for docs in (4, 5, 49, 50, 51, 400):
        least = int((docs + line_rules.MORE_DOCS) * line_rules.MAX_SHARE) + 1
        rows = made("in", docs, min(least, docs)) + made("out", docs, min(least - 1, docs))
        got = line_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), F.col("source"))
        assert got.where("lines_removed > 0").count() == min(least, docs)


def test_odd_rows(spark, odd_docs, no_docs):
    got = line_rules.judge(odd_docs, F.col("source")).collect()
    assert len(got) == 10
    by = {r["doc_id"]: r for r in got}
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    for i, r in by.items():
        words = WORDS.findall(texts[i] or "")
        assert r["n_words"] == len(words) and r["word_chars"] == sum(map(len, words))
        assert r["base_failed"] == (len(words) < 20 or 100 * r["n_repeat_words"] > 30 * len(words)) and not r["kept"]
    assert by[6]["n_repeat_words"] == by[6]["n_words"] == 40000
    assert by[8]["n_symbols"] == 4
    assert line_rules.judge(no_docs, F.col("source")).count() == 0
