"""headline_signals: timestamped text -> daily signals, as Spark DataFrame operators.

Every public operator is a function ``DataFrame -> DataFrame`` built from Catalyst
expressions, so that a chain of them is one lazy plan that Spark optimises and runs
across the cluster. Python workers are used only for HTML extraction, for finding listed
words in texts and for external models plugged into the scorer.
"""

__version__ = "0.1.0"
