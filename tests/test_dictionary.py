"""Terms found by the automaton, against regular expressions and one expression a term."""

import random
import re
import time

from pyspark.sql import functions as F

from sediment.functions import scalar as S
from sediment.functions import vocabulary as V
from sediment.operators import dictionary


def by_expressions(text, entries, whole_words, once=False):
    out = []
    for i, (term, label) in enumerate(entries):
        inner = "".join(f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() else re.escape(c) for c in term)
        edge = (r"(?<![^\W_])", r"(?![^\W_])") if whole_words else ("", "")
        places = [(m.start(), m[0]) for m in re.finditer(edge[0] + inner + edge[1], text or "")]
        out += [(i, term, label, *p) for p in places[: 1 if once else None]]
    return [(k, *x[1:]) for k, x in enumerate(sorted(out, key=lambda x: (x[0], x[3])))]


def test_places_equal_expressions(spark):
    rng = random.Random(2)
    entries = [("API", "a"), ("api key", "b"), ("key", "c"), ("aa", "d"), ("aaa", "e"), ("C++", "f"), ("naïve", "g"), ("Api", "h"), ("ß", "i"), ("x.y", "j"), ("東京", "k")]
    bits = ["api", "API", " ", "key", "aaaa", "a", "C++", "naïve", "NAÏVE", "ß", "x.y", "x,y", "東京", "_", "é", "1", ".", "\n", "😀"]
    texts = [None, "", "api"] + ["".join(rng.choices(bits, k=rng.randint(1, 40))) for _ in range(300)]
    rows = spark.createDataFrame([(i, t, i % 3, "x") for i, t in enumerate(texts)], "id int, text string, more int, term string")
    for whole_words in (True, False):
        for once in (True, False):
            got = dictionary.found(rows, "text", entries, whole_words, once)
            assert got.columns == ["id", "more", "index", "term", "label", "start", "value"]
            have = {}
            for r in got.collect():
                assert r["more"] == r["id"] % 3
                have.setdefault(r["id"], []).append((r["index"], r["term"], r["label"], r["start"], r["value"]))
            for i, t in enumerate(texts):
                assert sorted(have.get(i, [])) == by_expressions(t, entries, whole_words, once), (t, whole_words, once)


def test_places_equal_one_expression_a_term(spark):
    rng = random.Random(3)
    bits = [*V.TECH_TERMS, *[t.lower() for t in V.TECH_TERMS], " ", " ", "_", "é", "9", "-", "."]
    rows = spark.createDataFrame([(i, "".join(rng.choices(bits, k=30))) for i in range(200)], "id int, text string")
    want = rows.select("id", F.posexplode(S.tech_places(F.col("text"))).alias("index", "e")).select("id", "index", "e.value", "e.start").collect()
    got = dictionary.found(rows, "text", [(t, "TECH") for t in V.TECH_TERMS]).select("id", "index", "value", "start").collect()
    assert want and sorted(got) == sorted(want)


def test_long_lists_go_in_passes(spark, monkeypatch):
    monkeypatch.setattr(dictionary, "MOST_CHARS", 5)
    assert [len(p) for p in dictionary.passes([("abc", ""), ("de", ""), ("fghijkl", ""), ("m", "")], 5)] == [2, 1, 1]
    rows = spark.createDataFrame([(1, "abc de m")], "id int, text string")
    assert dictionary.found(rows, "text", []).count() == 0
    assert dictionary.found(rows.limit(0), "text", [("abc", "")]).count() == 0


def test_time_does_not_follow_the_number_of_terms(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    rows = spark.createDataFrame([(i, " ".join(word() for _ in range(3000))) for i in range(300)], "id int, text string").repartition(8).cache()
    rows.count()

    def seconds(n):
        entries = [(word(), "") for _ in range(n)]
        dictionary.found(rows, "text", entries).count()
        start = time.time()
        for _ in range(3):
            dictionary.found(rows, "text", entries).count()
        return time.time() - start

    few = seconds(50)
    assert seconds(5000) < 2 * few + 1
