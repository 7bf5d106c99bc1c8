"""Columns of the input that are called like helper columns pass through unchanged."""

from quire.llm import mixing, near_dup


def test_near_duplicates_and_mixture(spark):
    rows = [(1, "a b c d e f", "s", "x", 7, "y"), (2, "a b c d e f", "s", "x2", 8, "y"), (3, None, None, "z", 9, None), (None, "a b", "s", "n", 1, "q")]
    names = "doc_id long, text string, source string, __text_id string, __i int, text_id string"
    docs = spark.createDataFrame(rows, names)
    kept = near_dup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[2], rows[3]], key=str)
    more = docs.withColumnRenamed("__i", "__copy").withColumnRenamed("text_id", "copy").withColumnRenamed("__text_id", "row")
    out = mixing.repeated(mixing.mix(more))
    assert out.columns == more.columns and {r["__copy"] for r in out.collect()} <= {7, 8, 9, 1}
    assert {r["row"] for r in out.collect()} <= {"x", "x2", "z", "n"}
