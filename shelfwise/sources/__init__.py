"""Table contracts, readers (CSV by header name, Parquet, TPC-H fixture) and landing."""
