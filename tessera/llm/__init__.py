"""Operations of a training-data pipeline over a ``documents`` table.

Nothing else in the package imports this subpackage.
"""
