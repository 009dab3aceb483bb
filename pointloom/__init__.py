"""Point-cloud and road-corridor analytics expressed as Spark DataFrame plans."""
