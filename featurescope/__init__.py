"""featurescope: diagnostics of labelled feature spaces, on Spark DataFrames."""
