"""folium: a document-library analytics engine written as Spark DataFrame operators."""
