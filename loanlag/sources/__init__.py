from .colocated import read_colocated, write_colocated
from .fixture import load_fixture
from .readers import (LoanTables, conform, jdbc_bounds_query, jdbc_options, jdbc_quantile_query,
                      range_predicates, read_jdbc_table, read_jdbc_table_split, read_table, read_tables)
from .schemas import SCHEMAS

__all__ = [
    "LoanTables", "SCHEMAS", "conform", "jdbc_bounds_query", "jdbc_options", "jdbc_quantile_query",
    "load_fixture", "range_predicates", "read_colocated", "read_jdbc_table", "read_jdbc_table_split", "read_table", "read_tables",
    "write_colocated",
]
