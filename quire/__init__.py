"""quire: a Spark-native engine for turning books into chapters, notes and cards.

Every operator takes DataFrames and returns DataFrames; nothing is collected and
nothing is written until the caller asks for it.
"""

__version__ = "0.1.0"
