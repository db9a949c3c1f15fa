"""kinfold: entity resolution over delimited references as Spark plans."""
