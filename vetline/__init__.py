"""vetline: screening place reviews with Spark DataFrames.

Sub-packages: ``functions`` (Column -> Column scalars), ``operators``
(DataFrame -> DataFrame transforms), ``sources`` (readers, converters,
sinks, model IO), ``plans`` (end-to-end jobs and test views) and
``streaming`` (the row-local part of screening on a stream).
"""

__version__ = "0.1.0"
