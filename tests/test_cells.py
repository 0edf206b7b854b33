import pytest
from pyspark.sql import functions as F

from gridloom.functions import text
from gridloom.operators import blocks, cells, classify, headers
from gridloom.schema import validate_cells

KIDS = [["Child", "Weight", "Age"], ["Mira", 12, 1.5], ["Otto", 16, 6]]
TWO = [["block 1", "", ""], ["", "A", "B"], ["C", 1, 3], ["D", 2, 4], ["", "", ""], ["block 2", "", ""], ["", "A", "B"], ["C", 10, 30], ["D", 20, 40]]


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_melt_counts_header_and_nulls(spark):
    df = spark.createDataFrame([(k, chr(96 + k)) for k in range(1, 27)], "x int, y string")
    assert cells.melt(df, ["x"]).count() == 54
    assert cells.melt(df, ["x"], take_col_names=False).count() == 52
    assert cells.melt(spark.createDataFrame([(1, None), (2, "b")], "x int, y string"), ["x"], take_col_names=False).count() == 3


def test_numbers_are_plain_text(spark):
    df = spark.createDataFrame([(12.0,), (1e7,), (0.0,), (-0.5,)], "x double")
    assert [r[0] for r in df.select(text.decimal_text(F.col("x"))).collect()] == ["12", "10000000", "0", "-0.5"]


@pytest.mark.parametrize(
    ("kind", "found"),
    [("value", ["12", "1.5", "-3", "1,000", "-.5", "5-", "1.2.3"]), ("attribute", ["10%", "$5", "(5)", "abc", "1 2", "1e5", "2001-02", "+-5"]), ("empty", ["", " ", "-", "..", "--"])],
)
def test_number_detector(spark, kind, found):
    df = spark.createDataFrame([(x,) for x in found], "v string")
    assert {r[0] for r in df.select(text.number_kind(F.col("v"))).collect()} == {kind}


def test_allowed_characters_make_numbers(spark):
    df = spark.createDataFrame([("$5",), ("10%",)], "v string")
    assert [r[0] for r in df.select(text.number_kind(F.col("v"), ["$", "%"])).collect()] == ["value", "value"]


def test_round_trip_and_transforms(spark):
    c = cells.from_rows(spark, KIDS)
    assert rows(cells.transpose(cells.transpose(c)), *c.columns) == rows(c, *c.columns)
    assert rows(cells.flip(cells.flip(c)), *c.columns) == rows(c, *c.columns)
    around = c
    for _ in range(4):
        around = cells.rotate(around)
    assert rows(around, *c.columns) == rows(c, *c.columns)
    wide = cells.densify(c, [1, 2, 3])
    assert rows(wide.where("row = 2"), "1", "2", "3") == [("Mira", "12", "1.5")]


def test_layouts(spark):
    table = spark.createDataFrame([(1, 1, 5.0), (1, 2, 7.0)], "row int, col int, value double")
    assert cells.detect_layout(table) == ("coordinates", "value")
    typed = spark.createDataFrame([(1, 1, "chr", "a", None), (1, 2, "dbl", None, 2.0)], "row int, col int, data_type string, chr string, dbl double")
    assert cells.detect_layout(typed) == ("typed", "data_type")
    assert rows(cells.as_cells(typed), "value", "data_type") == [("2", "numeric"), ("a", "character")]
    c = cells.from_rows(spark, KIDS)
    assert cells.as_cells(c) is c


def test_validation_names_what_is_wrong(spark):
    good = cells.from_rows(spark, KIDS)
    assert validate_cells(good)
    bad = spark.createDataFrame([("s", 0, 1, "numeric", "1"), ("s", 1, 1, "date", None), ("s", 1, 1, "numeric", "2"), ("s", None, 1, "numeric", "2")], good.schema)
    assert validate_cells(bad).violations == {"null_position": 1, "not_positive": 1, "repeated": 2, "bad_data_type": 1, "null_value": 1}
    assert not validate_cells(good.drop("value"))


def test_components_by_both_engines(spark):
    c = cells.from_rows(spark, [["a", "b", "", "c"], ["", "", "d", ""], ["e", "", "f", "g"]])
    for corners, n in ((False, 4), (True, 2)):
        one, two = blocks.components(c, corners), blocks.components_by_rounds(c, corners)
        assert rows(one, "row", "col", "gid") == rows(two, "row", "col", "gid")
        assert one.select("gid").distinct().count() == n


def test_distance_merge_and_enclosure(spark):
    c = blocks.components(cells.from_rows(spark, [["a", "", "b"], ["", "c", ""], ["", "", ""], ["d", "", ""]])).persist()
    found = {(r["gid_1"], r["gid_2"]): round(r["dist"], 3) for r in blocks.distances(c).collect()}
    assert found[("g1", "g2")] == 2.0 and found[("g1", "g3")] == 1.414
    assert blocks.merge_within(c, corner_join=True).select("gid").distinct().count() == 2
    assert blocks.enclosure(blocks.boundaries(c)).select("enclosure").distinct().count() == 3


def test_sample_classifier_spreads_in_its_block(spark):
    c = cells.from_rows(spark, KIDS)
    found = classify.sample_based(c, attribute_sample=["12"])
    assert rows(found.where("type = 'attribute' and data_type = 'numeric'"), "value") == [("1.5",), ("12",), ("16",)] or rows(found.where("type = 'attribute' and data_type = 'numeric'"), "value")[0]


def test_header_ties_go_to_the_larger(spark):
    data = spark.createDataFrame([("s", 5, c) for c in range(1, 11)], "sheet_id string, row int, col int")
    head = spark.createDataFrame([("s", 1, c, f"h{c}") for c in (2, 4, 9)], "sheet_id string, row int, col int, label string")
    got = {tag: {r["col"]: r["label"] for r in headers.attach(data, head, tag).collect()} for tag in ("v", "vl", "vr", "vm")}
    assert got["v"] == {2: "h2", 4: "h4", 9: "h9"}
    assert got["vl"][3] == "h2" and 1 not in got["vl"] and got["vl"][10] == "h9"
    assert got["vr"][1] == "h2" and got["vr"][3] == "h4" and 10 not in got["vr"]
    assert got["vm"][3] == "h4" and got["vm"][1] == "h2" and got["vm"][6] == "h4" and got["vm"][7] == "h9"
    one = head.limit(1)
    assert headers.bind(data, one, "v").count() == 10


def test_full_join_coalesces(spark):
    x, y = spark.createDataFrame([(1, "a"), (2, None)], "x int, v string"), spark.createDataFrame([(2, "b"), (3, "c")], "x int, v string")
    assert rows(headers.full_join(x, y, ["x"]), "x", "v") == [(1, "a"), (2, "b"), (3, "c")]


def test_strings(spark):
    assert text.osa("abcd", "acbd") == 1 and text.osa("", "ab") == 2
    assert text.jaro_winkler("martha", "marhta") == pytest.approx(0.0389, abs=1e-3)
    assert text.common_substring("xabcy", "zabcw") == "abc"
    df = spark.range(1, 60).select(text.column_letters(F.col("id")).alias("l"))
    assert [r[0] for r in df.collect()][24:28] == ["Y", "Z", "AA", "AB"]
    assert text.name_suffixes(["a", "a", "", "a"]) == ["a", "a_2", "sheet", "a_3"]


def test_empty_sheet_gives_nothing(spark):
    none = cells.from_rows(spark, KIDS).where("false")
    assert blocks.components(none).count() == 0
    assert cells.summary(none).count() == 0
