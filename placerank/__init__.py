"""placerank — place and region scoring on Spark DataFrames.

Column functions live in ``placerank.functions``, DataFrame operators in
``placerank.operators``, readers/writers in ``placerank.sources``, composite
indices and the query catalogue in ``placerank.plans`` and stream variants in
``placerank.streaming``.
"""

__version__ = "0.1.0"
