"""Analytics over function lists: wide tables to cell facts, row rules, summaries and reconciliation, as DataFrames."""
