"""Panel analytics on Spark: spectral typology of entity x period x category panels
plus the data-preparation operators a large training-data pipeline needs."""
