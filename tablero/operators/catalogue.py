"""Every row of a table once per row of a catalogue (habits, criteria, parameters), without a cartesian product.

The dense grids of the domain (person x day x habit and the like) are results in their own right. There is one plan for any size of the
catalogue and no job while it is built: the rows are divided into parts and the catalogue is repeated once per part, so that
Spark broadcasts it where it measures it as small and shares the work among the parts where it does not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tablero.operators.spread import spread_join


def per_catalogue_row(df: DataFrame, catalogue: DataFrame, slots: int | None = None) -> DataFrame:
    """The columns of ``df`` followed by those of ``catalogue``, for each pair of rows."""
    return spread_join(df, catalogue, [], df.columns, slots=slots).select(*df.columns, *catalogue.columns)
