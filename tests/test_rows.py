import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from weftspark import delimited
from weftspark.functions import rows


def write(tmp_path, *text):
    path = tmp_path / "rows.txt"
    path.write_text("".join(f"{x}\n" for x in text))
    return str(path)


def test_header_and_types(spark, tmp_path):
    got = delimited(spark, write(tmp_path, "id,name,score,ok", "1,x,2.5,true"), header=True, kinds=["INT", "STRING", "DOUBLE", "BOOLEAN"])
    assert [tuple(r) for r in got.df.collect()] == [(1, "x", 2.5, True)]


def test_generated_names_and_literal_separators(spark, tmp_path):
    got = delimited(spark, write(tmp_path, "a|b|"), sep="|").df
    assert got.columns == ["col0", "col1", "col2"] and tuple(got.first()) == ("a", "b", "")
    assert tuple(delimited(spark, write(tmp_path, "a||b.*c"), sep="||").df.first()) == ("a", "b.*c")
    assert tuple(delimited(spark, write(tmp_path, '"a,b"')).df.first()) == ('"a', 'b"')


def test_extra_and_missing_fields(spark, tmp_path):
    two, three = (rows.schema_from("x,y,z"[: 2 * n - 1], header=True) for n in (2, 3))
    assert tuple(delimited(spark, write(tmp_path, "a,b,c"), schema=two).df.first()) == ("a", "b")
    with pytest.raises(PySparkException):
        delimited(spark, write(tmp_path, "a,b"), schema=three).df.collect()
    assert tuple(delimited(spark, write(tmp_path, "a,b"), schema=three, lenient=True).df.first()) == ("a", "b", None)


@pytest.mark.parametrize(("text", "want"), [("TRUE", True), ("true", True), ("yes", False), ("1", False), ("", False)])
def test_booleans(spark, tmp_path, text, want):
    schema = rows.schema_from("a,b", header=True, kinds=["STRING", "BOOLEAN"])
    assert delimited(spark, write(tmp_path, f"x,{text}"), schema=schema).df.first()["b"] is want


@pytest.mark.parametrize(("text", "want"), [("12", 12), ("-3", -3), ("+4", 4), ("1x", None), (" 1", None), ("", None), ("2147483648", None)])
def test_integers_are_strict(spark, tmp_path, text, want):
    schema = rows.schema_from("a,b", header=True, kinds=["STRING", "INT"])
    path = write(tmp_path, f"x,{text}")
    assert delimited(spark, path, schema=schema, lenient=True).df.first()["b"] == want
    if want is None:
        with pytest.raises(PySparkException):
            delimited(spark, path, schema=schema).df.collect()


def test_doubles(spark, tmp_path):
    schema = rows.schema_from("a,b", header=True, kinds=["STRING", "DOUBLE"])
    got = delimited(spark, write(tmp_path, "x,1e3", "x,-.5", "x,nope"), schema=schema, lenient=True).df
    assert [r["b"] for r in got.collect()] == [1000.0, -0.5, None]


def test_getters_do_not_convert(spark):
    df = spark.createDataFrame([(1, "x")], "n int, s string")
    assert df.select(rows.typed(df, "n", "INT")).first()[0] == 1
    with pytest.raises(TypeError):
        rows.typed(df, "s", "INT")
    with pytest.raises(KeyError):
        rows.typed(df, "none", "INT")


def test_schema_rules():
    assert rows.index_of(rows.schema_from("a,b", header=True), "b") == 1
    assert rows.index_of(rows.schema_from("a,b", header=True), "c") is None
    for bad in (dict(first_line="a,a", header=True), dict(first_line="a,b", header=True, kinds=["INT"])):
        with pytest.raises(ValueError):
            rows.schema_from(**bad)


def test_render_keeps_places(spark):
    from weftspark.functions.scalars import render

    df = spark.createDataFrame([(1, None, "x")], "a int, b string, c string")
    assert df.select(render(*df.columns, sep=";").alias("t")).first()["t"] == "1;;x"
    assert df.select(render("a", F.lit(2.5)).alias("t")).first()["t"] == "1,2.5"
