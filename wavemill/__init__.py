"""Spark-native analytics for segmented multichannel recordings and the tables around them."""
