"""leadlake: customer-relationship analytics for healthcare, as Spark jobs over whole tables."""
