"""Analytics over caption- and text-factuality records, declared with DataFrames."""
