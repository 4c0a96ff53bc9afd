"""Operations of a large-scale training-data pipeline, each over whole Spark tables.

Nothing else in the library imports this subpackage.
"""
