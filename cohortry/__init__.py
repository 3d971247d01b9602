"""Cohort analytics as PySpark DataFrame operators.

``sources`` reads and stores tables, ``functions`` holds Column expressions and
distributed statistics, ``operators`` the DataFrame-in / DataFrame-out steps and
``plans`` the multi-step analyses composed from them.
"""
