"""sheetflow: declarative sheet-to-table data movement and replication analytics on Spark."""
