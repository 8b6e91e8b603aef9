"""tallyloom: record matching, document reconciliation and corpus preparation on Spark DataFrames."""
