"""Spark-native analytics over corpora of programs and their minimal grammars."""
