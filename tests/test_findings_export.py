"""Files of many clients in archives, and files too large for one task among small ones."""

from ledgerloom.operators import export
from ledgerloom.sources import folders

from test_operators import bulk


def test_packed_files_are_the_files(spark, tmp_path):
    folders.register(spark)
    docs, lines = bulk(spark)
    placed = export.file_lines(docs, lines, most=100)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(placed) == rows(export.file_lines(docs, lines, 5)) == rows(export.file_lines(docs, lines))
    export.write_packed(placed, str(tmp_path / "out"), fan=6)
    assert rows(export.read_packed(spark, str(tmp_path / "out"))) == rows(export.leaves(placed, fan=6))
    assert {p.suffix for p in (tmp_path / "out").iterdir()} == {".zip"}
