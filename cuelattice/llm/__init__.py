"""Operations of a training-data pipeline, written as Spark jobs.

Nothing outside this subpackage imports it.
"""
