"""cataloom: catalogue and review analytics declared as Spark plans."""
