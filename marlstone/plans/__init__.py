"""The dialect: text to tuples to DataFrames."""
