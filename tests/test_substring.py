"""Substring index against plain search."""

import random

from pricemesh.operators import substring


def test_equals_plain_search(spark, tmp_path):
    r = random.Random(3)
    letters = "aAbBß𝄞 é.%_\\"
    texts = [(i, "".join(r.choice(letters) for _ in range(r.randrange(12))), "x") for i in range(120)]
    texts += [(200, None, "x"), (201, "", "x"), (202, "ab" * 100_000 + "needle", "x"), (None, "needle", "x"), (5, "needle again", "x")]
    needles = ["a", "B", "ab", "ß", "𝄞", "𝄞a", "a𝄞b", "  needle ", "needle again and more", "%", "_", "\\", "é.", "", "   ", None, "zz", "zzz", "NEEDLE", "abababab", " a b"]
    df = spark.createDataFrame(texts, "doc long, text string, needle string")
    asked = spark.createDataFrame([(n, 1) for n in needles + needles[:4]], "word string, id int")
    folder = str(tmp_path / "index")
    for part, rows in enumerate((df.filter("doc < 60"), df.filter("doc >= 60"), df.filter("doc is null"), df.limit(0))):
        substring.write_index(rows, "doc", "text", folder, part)
        substring.write_index(rows, "doc", "text", folder, part)  # a repeated run changes nothing
    got = sorted(map(tuple, substring.find_substrings(asked, "word", df, "doc", "text", folder).collect()))
    plain = sorted({n.strip().lower() for n in needles if n and n.strip()})
    want = sorted((n, i) for n in plain for i, t, _ in texts if i is not None and t and n in t.lower())
    assert got == want and len({n for n, _ in want}) >= 10
    assert substring.find_substrings(asked.limit(0), "word", df, "doc", "text", folder).count() == 0


def test_an_index_takes_the_grams_of_a_text_once(spark, tmp_path):
    taken = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            taken.add(batch.num_rows)
            yield batch

    rows = spark.range(50).selectExpr("id", "concat('bolt ', id) text").mapInArrow(counted, "id long, text string")
    substring.write_index(rows, "id", "text", str(tmp_path / "index"))
    assert taken.value == 50
