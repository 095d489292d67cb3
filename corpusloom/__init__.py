"""corpusloom: a PySpark-native engine for collections of long documents and their summaries."""
