"""lakeweave: a Spark-native engine for collections of tables, their vectors and their scores."""
