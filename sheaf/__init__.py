"""sheaf: a Spark-native engine for wrangling delimited text and string tables.

Load text (or wrap any DataFrame), chain verbs – promote/demote a header, cut,
split and extract text by position, literal, regex or range, edit, delete,
drop, merge, fill, wrap, fold/unfold, transpose, translate, partition and
union – and write the result. Every verb compiles to DataFrame expressions.
"""

from .frame import PART, ColumnHandle, Wrangler
from .match import Regex, re_
from .sources.tables import read_table
from .sources.text import lines_from, read_lines, read_text
from .streaming.live import stream_table, stream_text, write_stream

__all__ = ["Wrangler", "ColumnHandle", "PART", "Regex", "re_", "read_text", "read_lines",
           "lines_from", "read_table", "stream_text", "stream_table", "write_stream"]
