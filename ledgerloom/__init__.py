"""Spark-first analytics for invoice documents and the ledger built from them."""
