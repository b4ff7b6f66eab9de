"""mixedframe: cleaning, profiling, association and modelling of mixed-type tables on Spark."""
