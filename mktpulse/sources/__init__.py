from mktpulse.sources.bindings import Binding
from mktpulse.sources.readers import read_csv_raw, read_parquet, register_views, table

__all__ = ["Binding", "read_csv_raw", "read_parquet", "register_views", "table"]
