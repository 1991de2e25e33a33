"""lattice: tabular profiling, dense linear algebra and classical machine learning on Spark DataFrames."""
