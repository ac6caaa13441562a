"""Document-layout and OCR analytics on Spark DataFrames."""
