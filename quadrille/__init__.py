"""quadrille: verifiable spatial scenarios, declared as Spark DataFrames."""
