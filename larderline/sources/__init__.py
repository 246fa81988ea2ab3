from larderline.sources.delimited import (
    files_named,
    number_lines,
    read_aligned,
    read_csv,
    read_delimited,
    read_named,
    write_csv,
)
from larderline.sources.tables import read_table, write_table

__all__ = [
    "files_named",
    "number_lines",
    "read_aligned",
    "read_csv",
    "read_delimited",
    "read_named",
    "read_table",
    "write_csv",
    "write_table",
]
