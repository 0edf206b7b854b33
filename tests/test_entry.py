import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
SOME = ["cells_melt", "va_numeric", "blocks_components4", "hdr_vl", "hdr_vm", "footprint_dedupe", "html_tables", "magic_types", "read_cells_csv_golden", "roundtrip_crosstab"]
SOME += ["typed_table", "human_sizes", "filter_blocks_by_content", "va_sample_partial", "blocks_by_rounds", "sheet_overview", "hdr_bind", "coalescing_full_join", "split_by_side", "attribute_join", "redirected_edges", "name_conflicts"]
SOME += ["orientation_override", "cell_roles", "collate_by_block", "collate_with_tuner", "similarity_extended", "name_suggestions", "stack_folded", "magic_families", "office_tables", "read_folder", "dialect_detect_hard"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 50


def test_the_engine_does_not_need_the_training_subpackage():
    for path in Path(entry.__file__).parent.joinpath("gridloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", path.read_text(), re.M), path


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    got = entry.queries()[name](spark, str(DATA)).toPandas()
    want = con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    text = lambda df: sorted(tuple(str(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert text(got) == text(want)
