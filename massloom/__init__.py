"""massloom: Spark-native operators for measured signals and the candidates that explain them."""

__version__ = "0.1.0"
