"""Month-by-month batches over a transaction table."""
