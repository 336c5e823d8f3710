"""Column expressions against plain Python, and the invariants of packing."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkwell.functions import text as tx


def one(spark, expr, **columns):
    kinds = {k: ("array<array<string>>" if isinstance(v, list) and v and isinstance(v[0], list) else "array<string>" if isinstance(v, list) and (not v or isinstance(v[0], str)) else "array<double>" if isinstance(v, list) else "string") for k, v in columns.items()}
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {t}" for k, t in kinds.items())).select(expr.alias("x")).first()["x"]


def packed(units, most):
    out, size = [], 0
    for u in (u.strip() for u in units):
        if not u:
            continue
        if out and size + len(u) + 1 <= most:
            out[-1] += "\n" + u
            size += len(u) + 1
        else:
            out.append(u)
            size = len(u) + 1
    return out


@pytest.mark.parametrize("units, most", [(["a" * 4, "b" * 4], 10), (["a" * 4, "b" * 5], 10), (["a" * 99, "b"], 10), ([" ", "", "a", "b "], 10), ([], 10)])
def test_pack(spark, units, most):
    assert one(spark, tx.pack(F.col("u"), most), u=units) == packed(units, most)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab \t", max_size=12), max_size=12))
def test_pack_keeps_units_in_order(spark, units):
    got = one(spark, tx.pack(F.col("u"), 10), u=units)
    assert got == packed(units, 10)
    assert "\n".join(got).split("\n") == [u.strip() for u in units if u.strip()] or not got


def test_strip_takes_what_a_pattern_calls_white(spark):
    """Each code point but surrogates at both ends, doubled and beside a line end, as ``\\s`` with ``(?U)`` has it."""
    points = spark.range(0x110000).filter("id < 55296 or id > 57343").select(F.decode(F.encode(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')"), "UTF-8"), "UTF-8").alias("c"))
    texts = points.select(F.explode(F.array(F.concat("c", F.lit("a"), "c", F.lit("b"), "c", "c"), F.concat("c", F.lit("\n"), "c"), F.concat(F.lit("a"), "c", F.lit("\r\n")))).alias("t"))
    assert texts.filter(~tx.strip(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0
    assert texts.filter(tx.strip(F.col("t")) == "").count() > 20 and one(spark, tx.strip(F.col("t")), t=None) is None


def test_split_long(spark):
    split = lambda t, n=20: one(spark, tx.split_long(F.col("t"), n), t=t)
    assert split("  short ") == ["short"] and split(" \n ") == []
    assert split("a" * 15 + "\n\n" + "b" * 15 + "\nc") == ["a" * 15, "b" * 15 + "\nc"]
    assert split("a" * 15 + "\n" + "b" * 15) == ["a" * 15, "b" * 15]
    assert split("One is here. Two is here! Three") == ["One is here.", "Two is here!\nThree"]
    assert split("x" * 50) == ["x" * 50]


def test_links_and_titles(spark):
    assert one(spark, tx.clean_links(F.col("t")), t="[[ A b |shown]] and [[C#part]] [[D]]") == "A b and C D"
    for stem in ("the_old-tower", "o'neil 2nd", "ÉTÉ_bleu"):
        assert one(spark, tx.file_title(F.col("t")), t=stem) == re.sub("[_-]", " ", stem).strip().title()
    assert one(spark, tx.page_title(F.col("t")), t="A\nTitle\n\nbody") == "A Title"
    assert one(spark, tx.page_title(F.col("t")), t="First line\n" + "x" * 200) == "First line"
    assert one(spark, tx.page_title(F.col("t")), t="y" * 200) is None


def test_tables(spark):
    rows = [["a", None], ["b"], []]
    assert one(spark, tx.table_text(F.col("t")), t=rows) == "a | \nb\n"
    assert one(spark, tx.search_text(F.lit(None).cast("string"), F.col("t")), t=rows) == "a \nb\n\n"
    assert one(spark, tx.search_text(F.lit(""), F.col("t")), t=rows) == ""


def test_cosine(spark):
    from chunkwell.operators import vectors

    pairs = [([1.0, 2.0], [1.0, 2.0], 1), ([1.0, 0.0], [0.0, 1.0], 0), ([1.0, 0.0], [-1.0, 0.0], -1), ([1.0, 1.0], [3.0, 3.0], 1), ([1.0], [1.0, 2.0], 0), ([0.0, 0.0], [1.0, 1.0], 0), ([], [1.0], 0), (None, [1.0], 0)]
    asked = spark.createDataFrame([(i, b) for i, (_, b, _) in enumerate(pairs)], "qid int, query array<float>")
    found = vectors.search(spark.createDataFrame([(i, a) for i, (a, _, _) in enumerate(pairs)], "id int, embedding array<float>"), asked, 0).filter("qid = id").collect()
    assert {r["id"]: r["score"] for r in found} == {i: want for i, (_, _, want) in enumerate(pairs)}
