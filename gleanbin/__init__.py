"""gleanbin: analytics over corpora of compiled functions, declared as Spark plans."""
