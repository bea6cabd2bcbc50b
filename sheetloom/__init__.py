"""sheetloom: document text-layer analytics expressed as Spark DataFrame operators."""
