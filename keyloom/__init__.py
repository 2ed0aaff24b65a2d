"""An indexed DataFrame interface whose every operator is a Spark plan."""

from .operators.frame import Frame
from .operators.grouper import Grouper
from .operators.index import Index
from .operators.joins import join
from .operators.setops import concat, intersect
from .sources.interchange import CorruptedBuffer, deserialize, json_dumps, read_parquet, serialize, write_parquet

__all__ = ["CorruptedBuffer", "Frame", "Grouper", "Index", "concat", "deserialize", "intersect", "join", "json_dumps", "read_parquet", "serialize", "write_parquet"]
