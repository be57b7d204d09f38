"""Page analytics on Spark: lazy DataFrame operators over page, line and token tables."""
