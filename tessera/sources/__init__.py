from .tables import read_table, normalize_nan, TABLES
from .csv import read_csv

__all__ = ["read_table", "normalize_nan", "TABLES", "read_csv"]
