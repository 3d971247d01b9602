"""Cutting running text at field marks, against a search for every field on its own."""

import random

import pytest

from cohortry.operators import clean as c


def searched(text, field, fields, mark):
    at = text.find(field + mark)
    if at < 0:
        return None
    start = at + len(field + mark)
    stops = [text.find(f + mark, start) for f in fields if f != field]
    return text[start:min([s for s in stops if s >= 0], default=len(text))]


def cut(spark, texts, fields, mark="："):
    df = spark.createDataFrame(list(enumerate(texts)), "key int, text string")
    return sorted(map(tuple, c.field_blocks(df, "key", "text", fields, mark).collect()))


def test_random_texts(spark):
    fields, rng = ["ab", "b", "aab", "cab", "c", "a.c"], random.Random(3)
    texts = ["".join(rng.choice(["a", "b", "c", ".", "：", "：", "ab：", "aab：", "x"]) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    want = [(i, f, b) for i, t in enumerate(texts) for f in fields if (b := searched(t, f, fields, "：")) is not None]
    assert cut(spark, texts, fields) == sorted(want) and len(want) > 1000


def test_edges(spark):
    long = "name：" + "x" * 300_000 + "name：y" * 1000
    assert cut(spark, [None, "", "no mark", "name：", "name：1name：2age：3", long], ["name", "age"]) == [
        (3, "name", ""), (4, "age", "3"), (4, "name", "1name：2"), (5, "name", long[5:])]
    assert cut(spark, ["n[1]^x"], ["n", "n[1]"], "^") == [(0, "n[1]", "x")]
    for bad in ([], [""], ["a：b"]):
        with pytest.raises(ValueError):
            c.field_blocks(spark.createDataFrame([(1, "a")], "id int, t string"), "id", "t", bad)


def test_blocks_become_labels_of_several_columns(spark):
    df = spark.createDataFrame([(0, "sight：good0 bad1 hearing：fine0 lost1")], "id int, text string")
    book = c.codebook_extract(c.field_blocks(df, "id", "text", ["sight", "hearing"]), "label_code")
    targets = c.targets_by_part(["left sight", "right sight", "hearing"], {"sight": "sight", "hearing": "hearing"})
    got = {(r["field"], r["code"]): r["label"] for r in c.fan_out(book, targets).collect()}
    assert got == {(f, k): v for f, a, b in (("left sight", "good", "bad"), ("right sight", "good", "bad"), ("hearing", "fine", "lost"))
                   for k, v in (("0", a), ("1", b))}
