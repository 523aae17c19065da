"""A DataFrame-first engine for chained data pipelines on Spark."""

from weftspark.dataset import MISSING, Dataset, PyDataset
from weftspark.session import session
from weftspark.sources.readers import cached, delimited, from_frame, lines, objects, py_objects, random_ints

__all__ = ["MISSING", "Dataset", "PyDataset", "cached", "delimited", "from_frame", "lines", "objects", "py_objects", "random_ints", "session"]
