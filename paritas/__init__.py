"""A Spark-native engine for auditing ranked selections, and for preparing training data (subpackage ``llm``)."""
