"""Data valuation and subset selection as Spark jobs over tables of vectors."""
