"""The complete analyses.

Every function takes the tables of its study as DataFrames and returns one lazy
result, so it runs on the real tables as well as on the local stand-ins.
``registry`` binds them to the stand-ins.
"""
