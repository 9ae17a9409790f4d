"""arcweave: graph analytics on Spark DataFrames, with a toolbox for training-data pipelines in ``arcweave.llm``."""

__version__ = "0.1.0"
