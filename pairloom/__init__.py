"""pairloom: a Spark-native engine for pairwise entity resolution data."""
