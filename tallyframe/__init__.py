"""Product and market analytics on Spark DataFrames.

``sources`` reads and writes tables, ``functions`` holds column expressions,
``operators`` holds DataFrame-to-DataFrame steps, ``plans`` the complete
analyses built from them and ``oracles`` the SQL they are checked against.
"""
