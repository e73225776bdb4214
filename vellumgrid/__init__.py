"""vellumgrid: a PySpark engine that treats document corpora as tables of nodes."""
