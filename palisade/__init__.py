"""Palisade: change-verification analytics on Spark DataFrames.

``operators``  relational operators over snapshots, hunks, facts and findings
``functions``  column builders and the few UDFs that have no built-in form
``sources``    readers that turn Git trees, diffs, policies and cases into rows
``plans``      the five checks, the gate, and the driver's query catalogue
``streaming``  file-stream wrapper that gates change batches as they arrive
"""
