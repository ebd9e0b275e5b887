"""harbormill: a Spark-first engine for recommendation studies and training-data preparation.

Everything is expressed with DataFrames.  Python code runs on executors only
inside Arrow-batched functions; ``session.ship`` takes the package there.
"""
