"""pulsegrid: wearable-sensor and health-survey analytics as Spark DataFrame operators.

Every operator takes DataFrames (plus plain arguments) and returns a DataFrame.
Nothing is collected on the driver, so a chain of operators stays one lazy
plan until the caller writes or reads it.
"""

__version__ = "0.1.0"
