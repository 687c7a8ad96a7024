"""File scans and the Parquet tables that hold chunks, vectors and the ledger."""
