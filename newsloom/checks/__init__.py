"""The given Parquet tables seen as news data, the registered queries and their SQL twins."""
