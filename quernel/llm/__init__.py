"""Operations of a large-scale training-data pipeline, as DataFrame operators.

Nothing outside this subpackage imports it. Every operator takes DataFrames
and returns DataFrames; `queries` binds them to the tables of a data folder.
"""
