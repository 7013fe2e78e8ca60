"""Table operators as pure functions of DataFrames."""
