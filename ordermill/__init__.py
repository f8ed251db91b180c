"""Order, delivery, review and customer analytics for retail marketplaces, as Spark jobs."""
