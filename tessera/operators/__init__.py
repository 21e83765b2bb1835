"""Operators: each is ``fit(df, ...) -> params`` (a small aggregate) and/or
``transform(df, params) -> df`` (pure column expressions)."""
