"""lexloom: text-lattice analytics on Spark DataFrames."""
