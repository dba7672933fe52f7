import pytest

from weftline import operators as op

TEXTS = [
    (0, '<r id="5"><a>1</a><b u="x">text &amp; more</b><c>1.5</c><c>2</c><t>true</t></r>'), (1, None), (2, "  "),
    (3, "<r><a>2</a><b>plain</b><d><e>007</e><e>8</e></d></r>"), (4, "<r><a>3</a><b>"), (5, "no markup"), (6, "<q><a/><c>7</c></q>"),
    (7, '<?xml version="1.0"?><r xmlns:k="urn:k" id="9"><k:z>123456789012345678901</k:z></r>'),
]


def test_type_covers_all_rows(spark):
    df = spark.createDataFrame(TEXTS, "i int, x string")
    want = "struct<_id:bigint,a:bigint,b:struct<_VALUE:string,_u:string>,c:array<double>,d:struct<e:array<string>>,k:z:string,t:boolean>"
    assert op.infer_xml_type(df, "x").simpleString() == want
    assert op.infer_xml_type(df.repartition(7), "x").simpleString() == want
    assert op.infer_xml_type(df.limit(0), "x").simpleString() == "struct<>"


def test_columns(spark):
    df = spark.createDataFrame(TEXTS, "i int, x string")
    got = {r["i"]: r for r in op.xml_parse(df, "x", on_error="null").collect()}
    assert set(got) == set(range(8))
    assert tuple(got[0])[1:] == (5, 1, ("text & more", "x"), [1.5, 2.0], None, None, True)
    assert got[3]["b"] == ("plain", None) and got[3]["d"]["e"] == ["007", "8"]
    assert got[6]["a"] is None and got[6]["c"] == [7.0]
    assert got[7]["k:z"] == "123456789012345678901" and got[7]["_id"] == 9
    for i in (1, 2, 4, 5):
        assert tuple(got[i])[1:] == (None,) * 7


def test_broken_text_fails_unless_told(spark):
    df = spark.createDataFrame(TEXTS, "i int, x string")
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        op.xml_parse(df, "x").collect()
    assert op.xml_parse(df.where("i in (0, 1)"), "x").count() == 2


def test_given_schema_and_names(spark):
    df = spark.createDataFrame(TEXTS, "i int, x string")
    out = op.xml_parse(df, "x", "a string, c array<int>", keep_original=True, on_error="null")
    assert out.columns == ["i", "x", "a", "c"]
    assert [tuple(r) for r in out.where("i = 3").select("a", "c").collect()] == [("2", None)]
    with pytest.raises(ValueError, match="clash"):
        op.xml_parse(df, "x", "i int")
    assert op.xml_parse(df.limit(0), "x").columns == ["i"]
