"""Analytics over a project memory and its code graph, on Spark DataFrames.

Operators are functions from DataFrames to a DataFrame; nothing here runs at
import. ``basalt.plans`` binds them to the tables of a folder.
"""
