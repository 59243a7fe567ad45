"""noteloom: a Spark-native engine for collections of linked, tagged notes."""
