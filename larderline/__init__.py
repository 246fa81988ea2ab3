"""Larderline: intake-diary analytics written as Spark DataFrame jobs.

``functions``  column expressions (casts, keyword matching, ratios, labels)
``operators``  DataFrame -> DataFrame building blocks, generic over column names
``sources``    delimited-file readers and writers, table sinks
``plans``      the intake-diary jobs, assembled from the operators
``queries``    every operator and job run over the benchmark tables, with its SQL twin
"""

__version__ = "0.1.0"
