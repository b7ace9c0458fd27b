"""Tables written to the shared folder, connected components over them, and rows without an id told apart."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lepidus.operators.lineage import components, folder, forget, written

__all__ = ["components", "folder", "forget", "numbered", "written"]


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """``docs`` and a column ``row``: a number of its own for each row without a doc_id, null for the others.

    Rows without an id are written to the shared folder with their numbers, so these are the same whenever they are read.
    """
    none = written(docs.where("doc_id is null").withColumn(row, F.monotonically_increasing_id()), "unnamed")
    return docs.where("doc_id is not null").withColumn(row, F.lit(None).cast("long")).unionAll(none)
